"""Expressions over text whose lines end in ``\\n`` and nothing else.

All of them are plain JVM expressions inside whole-stage codegen. The byte-level
``contains`` comes first, so a text without the needle is never decoded or split.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def require_one_line(name: str, value: str) -> None:
    """Needles and marks are looked for within one line, so they must fit into one."""
    if not value or "\n" in value:
        raise ValueError(f"{name} must be non-empty and free of newlines: {value!r}")


def has_marker(text: Column | str, needle: str) -> Column:
    """True where some line of ``text`` contains ``needle``.

    For a needle without newline this is ``contains`` on the whole text, which Parquet
    takes as a ``StringContains`` filter.
    """
    require_one_line("needle", needle)
    return _column(text).contains(needle)


def matching_lines(text: Column | str, needle: str) -> Column:
    """Number of lines of ``text`` that contain ``needle``; 0 for a ``NULL`` text."""
    text = _column(text)
    # A match takes the rest of its line along, so every matching line counts once.
    rest_of_line = F.lit(re.escape(needle) + r"[^\n]*+")
    return (
        F.when(has_marker(text, needle), F.regexp_count(text, rest_of_line))
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def neutralised(text: Column | str, needle: str, mark: str = "#") -> Column:
    """``text`` with ``mark`` put before each line that has something before ``needle``.

    A line that begins with ``mark`` stays as it is, and so does one whose only
    ``needle`` is at its very beginning. A second run changes nothing.
    """
    require_one_line("mark", mark)
    text = _column(text)
    # (?d) lets only \n end a line, (?m) lets ^ match at each line. The match runs up to
    # the needle, and the search goes on behind it.
    unmarked = rf"(?dm)^(?!{re.escape(mark)})..*?{re.escape(needle)}"
    marked = re.sub(r"([\\$])", r"\\\1", mark) + "$0"
    return F.when(
        has_marker(text, needle),
        F.regexp_replace(text, F.lit(unmarked), F.lit(marked)),
    ).otherwise(text)
