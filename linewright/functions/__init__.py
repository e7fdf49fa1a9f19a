"""Column expressions: each takes a column (or its name) and returns a column."""

from linewright.functions.paths import path_stem
from linewright.functions.replies import is_yes, reply_outcome
from linewright.functions.text import has_marker, matching_lines, neutralised

__all__ = [
    "has_marker",
    "is_yes",
    "matching_lines",
    "neutralised",
    "path_stem",
    "reply_outcome",
]
