"""The operators on Structured Streaming."""

from primrose.streaming.streams import (
    rated_articles,
    read_message_table,
    stream_appends,
    stream_bounded,
    stream_capture,
    stream_crawl,
    stream_links,
    stream_new_articles,
    stream_rating_changes,
    stream_ratings,
)

__all__ = [
    "rated_articles",
    "read_message_table",
    "stream_appends",
    "stream_bounded",
    "stream_capture",
    "stream_crawl",
    "stream_links",
    "stream_new_articles",
    "stream_rating_changes",
    "stream_ratings",
]
