"""Fixed table schemas shared by scans, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATING_SLOTS = [f"turk_rating{i}" for i in range(5)]

MESSAGES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("possibly_sensitive", T.BooleanType()),
        T.StructField("crawled", T.BooleanType()),
        T.StructField("page_text", T.StringType()),
        T.StructField("errors", T.StringType()),
        T.StructField("link_actual", T.StringType()),
    ]
)

# What a captured message looks like before links are extracted.
CAPTURE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("possibly_sensitive", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
    ]
)

ARTICLES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("link", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("parser_content", T.StringType()),
        T.StructField("reporter_content", T.StringType()),
        T.StructField("sensitive_flag", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in RATING_SLOTS],
    ]
)

REPLY = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

FEED_ITEM = T.StructType(
    [
        T.StructField("link", T.StringType()),
        T.StructField("rating", T.ArrayType(T.StringType())),
    ]
)

# The header of an annotation result file, in file order.
ANNOTATION_HEADER = [
    "HITId", "HITTypeId", "Title", "Description", "Keywords", "Reward",
    "CreationTime", "MaxAssignments", "RequesterAnnotation",
    "AssignmentDurationInSeconds", "AutoApprovalDelayInSeconds", "Expiration",
    "NumberOfSimilarHITs", "LifetimeInSeconds", "AssignmentId", "WorkerId",
    "AssignmentStatus", "AcceptTime", "SubmitTime", "AutoApprovalTime",
    "ApprovalTime", "RejectionTime", "RequesterFeedback", "WorkTimeInSeconds",
    "LifetimeApprovalRate", "Last30DaysApprovalRate", "Last7DaysApprovalRate",
    "Input.site1", "Input.site2", "Input.site3",
    "Answer.Q1", "Answer.Q2", "Answer.Q3", "Approve", "Reject",
]

ANNOTATION_RESULT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ANNOTATION_HEADER]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast what is there, null for the rest."""

    def one(field: T.StructField) -> Column:
        if field.name in df.columns:
            return F.col(field.name).cast(field.dataType).alias(field.name)
        return F.lit(None).cast(field.dataType).alias(field.name)

    return df.select(*[one(f) for f in schema.fields])
