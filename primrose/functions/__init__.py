"""Column functions. Each takes and returns a ``Column``."""

from primrose.functions.links import (
    compose_link_id,
    extract_links,
    link_key,
    split_link,
    split_link_key,
)
from primrose.functions.names import parse_snapshot_time, stamp_name
from primrose.functions.ratings import (
    count_ratings_expr,
    mean_rating_expr,
    rating_bin,
    sensitive_label,
)
from primrose.functions.text import (
    adjacent_bigrams,
    bigram_length_filter,
    clip80,
    content_terms,
    html_to_text,
    ngram_tokens,
    none_to_null,
    simple_tokens,
    term_counts,
    tfidf_tokens,
    word_count,
    word_tokens,
)

__all__ = [
    "adjacent_bigrams",
    "bigram_length_filter",
    "clip80",
    "compose_link_id",
    "content_terms",
    "count_ratings_expr",
    "extract_links",
    "html_to_text",
    "link_key",
    "mean_rating_expr",
    "ngram_tokens",
    "none_to_null",
    "parse_snapshot_time",
    "rating_bin",
    "sensitive_label",
    "simple_tokens",
    "split_link",
    "split_link_key",
    "stamp_name",
    "term_counts",
    "tfidf_tokens",
    "word_count",
    "word_tokens",
]
