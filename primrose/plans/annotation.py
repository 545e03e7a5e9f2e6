"""The annotation loop: batches out, ratings in, what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame

from primrose.operators import annotate, ratings
from primrose.operators.validity import candidates_by_flag, drop_registration_wall
from primrose.session import pin


def build_batches(
    articles: DataFrame, submitted: DataFrame, min_words: int = 100, seed: int = 42
) -> DataFrame:
    """Rows of three links of unflagged articles, long enough and among the
    submitted ids, in seeded order inside the row.

    Page texts are read once, to choose; ids and links go on.
    """
    unflagged = candidates_by_flag(articles).filter("sensitive_flag = 0")
    chosen = annotate.only_known_ids(
        annotate.long_enough(annotate.add_content_columns(unflagged), min_words),
        annotate.distinct_ids(submitted),
    )
    narrow = pin(
        chosen.select("id", annotate.compose_link_id(chosen.link, chosen.id).alias("link"))
    )
    placed = annotate.shuffle_in_batch(annotate.batch_slots(narrow), seed)
    return annotate.batch_grid(placed)


def load_results(
    articles: DataFrame, results: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles with their slots filled, the audit log, and ratings of unknown
    articles. ``results`` is a scan of result files."""
    incoming = ratings.parse_ratings(ratings.unpivot_ratings(results))
    return (
        ratings.fill_rating_slots(articles, incoming),
        ratings.rating_audit_log(ratings.assign_slots(articles, incoming)),
        ratings.unmatched_ratings(incoming, articles),
    )


def analyse(articles: DataFrame) -> dict[str, DataFrame]:
    """Rating statistics by name."""
    rated = ratings.add_rating_columns(drop_registration_wall(articles))
    out = {
        "total": ratings.total_ratings(rated),
        "bins": ratings.binned_counts(rated),
        "agreed": ratings.agreed_sensitive(rated),
    }
    for col in ("count_turk_ratings", "avg_turk_ratings"):
        out[f"describe_{col}"] = ratings.describe_column(rated, col)
        out[f"values_{col}"] = ratings.value_counts(rated, col)
    return out
