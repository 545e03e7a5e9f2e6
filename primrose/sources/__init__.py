"""Scans and sinks."""

from primrose.sources.scans import (
    scan_annotation_batches,
    scan_articles,
    scan_feed_items,
    scan_id_grid,
    scan_latest_snapshot,
    scan_message_json,
    scan_messages,
    spread_small,
)
from primrose.sources.sinks import (
    append_messages,
    insert_new_articles,
    split_bad_messages,
    write_annotation_csv,
    write_capture_files,
    write_chunked_json,
    write_link_flags_csv,
    write_messages_json,
    write_probabilities,
    write_split_snapshot,
    write_table_version,
)

__all__ = [
    "append_messages",
    "insert_new_articles",
    "scan_annotation_batches",
    "scan_articles",
    "scan_feed_items",
    "scan_id_grid",
    "scan_latest_snapshot",
    "scan_message_json",
    "scan_messages",
    "split_bad_messages",
    "spread_small",
    "write_annotation_csv",
    "write_capture_files",
    "write_chunked_json",
    "write_link_flags_csv",
    "write_messages_json",
    "write_probabilities",
    "write_split_snapshot",
    "write_table_version",
]
