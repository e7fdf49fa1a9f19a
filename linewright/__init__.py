"""Batch PySpark operators for text lines and keyed tables.

Every operator takes DataFrames (or columns) and returns a DataFrame (or a column)
built from Spark's own expressions, joins and aggregations.
"""

from linewright.operators.integrity import (
    IncompleteInputs,
    assert_complete,
    missing_inputs,
    reconcile_digests,
)
from linewright.operators.kept import (
    found_registry,
    free_intervals,
    keep_latest,
    read_latest,
    reserve_names,
)
from linewright.operators.keyed import (
    append_if_absent,
    latest_per_key,
    lookup_with_default,
    rows_to_append,
)
from linewright.operators.lines import (
    count_matching_lines,
    count_matching_rows,
    ensure_header,
    having_marker,
    header_rows,
    neutralise_lines,
)
from linewright.operators.naming import allocate_free_names, stem_counts
from linewright.operators.replies import classify_replies
from linewright.sinks import (
    AlreadyThere,
    append_batch,
    append_rows,
    drop_replaced,
    drop_staged,
    publish_groups,
    read_batches,
    read_groups,
    replace_groups,
)
from linewright.sources import (
    digest_chunks,
    digest_files,
    index_members,
    list_files,
    read_lines,
    read_manifest,
    read_member_lines,
    read_texts,
    reconcile_chunks,
)

__all__ = [
    "AlreadyThere",
    "IncompleteInputs",
    "allocate_free_names",
    "append_batch",
    "append_if_absent",
    "append_rows",
    "assert_complete",
    "classify_replies",
    "count_matching_lines",
    "count_matching_rows",
    "digest_chunks",
    "digest_files",
    "drop_replaced",
    "drop_staged",
    "ensure_header",
    "found_registry",
    "free_intervals",
    "having_marker",
    "header_rows",
    "index_members",
    "keep_latest",
    "latest_per_key",
    "list_files",
    "lookup_with_default",
    "missing_inputs",
    "neutralise_lines",
    "publish_groups",
    "read_batches",
    "read_groups",
    "read_latest",
    "read_lines",
    "read_manifest",
    "read_member_lines",
    "read_texts",
    "reconcile_chunks",
    "reconcile_digests",
    "replace_groups",
    "reserve_names",
    "rows_to_append",
    "stem_counts",
]
