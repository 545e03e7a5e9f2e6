"""Views of the given tables in the shape the operators expect.

The given tables hold no articles, messages or ratings, so these are derived
from whole tables by fixed expressions. Each list of expressions is valid both
for ``selectExpr`` and as the select list of the checking SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from primrose.functions.links import link_key
from primrose.functions.names import stamp_name
from primrose.operators.feeds import adult_flag, key_items
from primrose.operators.messages import explode_links
from primrose.schemas import RATING_SLOTS
from primrose.sources.scans import spread_small

_BLANK_SLOTS = [f"'' AS {c}" for c in RATING_SLOTS]

ARTICLE_COLS = [
    "doc_id AS id",
    "'https://example.org/' || source || '/' || CAST(doc_id AS STRING) AS link",
    "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'Report ' || CAST(doc_id AS STRING) END AS title",
    "'<p>' || text || '</p>' AS parser_content",
    "CASE doc_id % 10 WHEN 0 THEN 'None' WHEN 1 THEN NULL"
    " WHEN 2 THEN text || ' Thanks for Registering!' ELSE text END AS reporter_content",
    "CAST(coalesce(toxic, 0) AS INT) AS sensitive_flag",
    *_BLANK_SLOTS,
]

SLOT_COLS = [
    "o_orderkey AS id",
    "'https://example.org/o/' || CAST(o_orderkey AS STRING) AS link",
    "CASE WHEN o_orderkey % 5 = 0 THEN '0' ELSE '' END AS turk_rating0",
    "CASE WHEN o_orderkey % 3 = 0 THEN '1' ELSE '' END AS turk_rating1",
    *_BLANK_SLOTS[2:],
]

RATING_COLS = [
    "l_orderkey AS link_id",
    "CASE WHEN l_quantity < 5 THEN NULL WHEN l_quantity < 15 THEN ''"
    " WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS rating",
    "l_linestatus AS file",
    "l_linenumber AS row_no",
    "l_partkey AS pos",
    "l_suppkey AS tie1",
    "l_extendedprice AS tie2",
    "l_shipdate AS tie3",
]
RATING_ORDER = ["file", "row_no", "pos", "tie1", "tie2", "tie3"]


def _site(kind: str, key: str) -> str:
    return (
        f"'https://example.org/{kind}/' || CAST({key} AS STRING) || '#' || CAST({key} AS STRING)"
    )


GRID_COLS = [
    "l_linestatus AS file",
    "l_orderkey * 10 + l_linenumber AS row_no",
    f"{_site('o', 'l_orderkey')} AS site1",
    f"{_site('p', 'l_partkey')} AS site2",
    f"{_site('s', 'l_suppkey')} AS site3",
    "CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS answer1",
    "CASE WHEN l_linestatus = 'O' THEN '1' ELSE '0' END AS answer2",
    "CASE WHEN l_quantity > 25 THEN '1' ELSE '' END AS answer3",
]

MESSAGE_COLS = [
    "event_id AS id",
    "ts",
    "CASE WHEN user_id % 4 = 0 THEN 'fr' ELSE 'en' END AS lang",
    "event_type"
    " || CASE WHEN event_id % 6 = 0 THEN ''"
    " ELSE ' http://t.co/' || CAST(event_id AS STRING) || '.' END"
    " || CASE WHEN event_id % 5 = 0 THEN ' https://m.site-x.org/a?b' ELSE '' END"
    " || CASE WHEN event_id % 7 = 0 THEN ' http://www.example.org/p/'"
    " || CAST(2 * user_id AS STRING) || '#c' ELSE '' END AS text",
    "CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN true ELSE false END"
    " AS possibly_sensitive",
    "props AS source",
    "event_id % 2 = 0 AS crawled",
]

FETCHED_COLS = [
    "'http://www.example.org/p/' || CAST(page_id AS STRING) AS link",
    "url AS link_actual",
    "CASE WHEN page_id % 2 = 0 THEN html"
    " ELSE replace(replace(html, '{', '('), '}', ')') END AS page_text",
]

# Three listings of the same pages: the first feed, a second feed for pages
# with a query string, and a repeat in the first feed for pages with a fragment.
FEED_PARTS = [
    (
        "page_id % 4",
        "page_id * 10",
        "CASE page_id % 5 WHEN 0 THEN array('adult') WHEN 1 THEN array('nonadult', 'adult')"
        " WHEN 2 THEN array('nonadult') ELSE NULL END",
        "true",
    ),
    (
        "(page_id + 1) % 4",
        "page_id * 10 + 1",
        "CASE WHEN page_id % 5 IN (0, 1) THEN array('nonadult') ELSE array('adult') END",
        "url LIKE '%?%'",
    ),
    ("page_id % 4", "page_id * 10 + 2", "array('nonadult')", "url LIKE '%#%'"),
]

STORED_RULE = "url LIKE 'https://%'"
STORED_TWICE_RULE = "url LIKE 'https://www.%'"

REPLY_EXPR = (
    "CASE page_id % 4"
    " WHEN 0 THEN '{\"title\":\"Reply ' || CAST(page_id AS STRING) || '\"}'"
    " WHEN 1 THEN '{\"content\":\"Body ' || CAST(page_id AS STRING) || '\"}'"
    " WHEN 2 THEN '{\"title\":\"Reply ' || CAST(page_id AS STRING)"
    " || '\",\"content\":\"Body ' || CAST(page_id AS STRING) || '\"}'"
    " ELSE '{}' END"
)

SCORED_COLS = [
    "doc_id",
    "CAST(toxic AS INT) AS label",
    "CAST(1 - quality AS INT) AS prediction",
]


# Tables whose rows are costly to process, with their keys.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


class Views:
    """The derived frames of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        """A given table; small text tables are spread over the cores."""
        read = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread_small(read, TEXT_TABLES[name]) if name in TEXT_TABLES else read

    def stream(self, name: str) -> DataFrame:
        """The files of a table as a stream; a table is one file or a folder
        of files."""
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        # A stream takes a folder or a pattern; the pattern finds either kind.
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}[.]parquet")

    @cached_property
    def articles(self) -> DataFrame:
        joined = self.table("documents").join(self.table("labels"), "doc_id", "left")
        return joined.selectExpr(*ARTICLE_COLS)

    @cached_property
    def slots(self) -> DataFrame:
        return self.table("orders").selectExpr(*SLOT_COLS)

    @cached_property
    def ratings(self) -> DataFrame:
        lines = spread_small(self.table("lineitem"), "l_orderkey")
        return lines.selectExpr(*RATING_COLS)

    @cached_property
    def grid(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*GRID_COLS)

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("events").selectExpr(*MESSAGE_COLS)

    @cached_property
    def links(self) -> DataFrame:
        """The stored (message, link) table: one id per row."""
        rows = explode_links(self.messages)
        return rows.select(
            (F.col("id") * 100 + F.col("pos")).alias("id"),
            "lang", "text", "source", "link", "possibly_sensitive", "crawled",
            F.lit(None).cast("string").alias("page_text"),
            F.lit(None).cast("string").alias("errors"),
            F.lit(None).cast("string").alias("link_actual"),
        )

    @cached_property
    def fetched(self) -> DataFrame:
        return self.table("pages").selectExpr(*FETCHED_COLS)

    def feed_listing(self, pages: DataFrame) -> DataFrame:
        """Feed entries of pages: link, rating, feed_ord, item_ord."""
        parts = [
            pages.filter(F.expr(rule)).select(
                F.col("url").alias("link"),
                F.expr(rating).alias("rating"),
                F.expr(f"CAST({feed} AS INT)").alias("feed_ord"),
                F.expr(item).alias("item_ord"),
            )
            for feed, item, rating, rule in FEED_PARTS
        ]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    @cached_property
    def feed_items(self) -> DataFrame:
        """Entries with id and flag."""
        return key_items(adult_flag(self.feed_listing(self.table("pages")))).drop("rating")

    @cached_property
    def stored(self) -> DataFrame:
        once = self.table("pages").filter(STORED_RULE)
        twice = self.table("pages").filter(STORED_TWICE_RULE)
        return once.union(twice).select(
            link_key(F.col("url")).alias("id"), F.col("url").alias("link")
        )

    @cached_property
    def replies(self) -> DataFrame:
        return self.table("pages").select(
            link_key(F.col("url")).alias("id"), F.expr(REPLY_EXPR).alias("reply")
        )

    @cached_property
    def snapshot_names(self) -> DataFrame:
        return self.table("events").select(
            F.concat(
                F.col("event_type"), F.lit("_@"), stamp_name(F.col("ts")), F.lit(".pk1")
            ).alias("name")
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text")

    @cached_property
    def labelled_documents(self) -> DataFrame:
        labels = self.table("labels").select("doc_id", F.col("toxic").alias("label"))
        return self.documents.join(labels, "doc_id")

    @cached_property
    def labels(self) -> DataFrame:
        return self.table("labels").select("doc_id", F.col("toxic").alias("label"))

    @cached_property
    def scored(self) -> DataFrame:
        return self.table("labels").selectExpr(*SCORED_COLS)

    @cached_property
    def folds(self) -> DataFrame:
        return self.scored.withColumn("fold", (F.col("doc_id") % 10).cast("int"))
