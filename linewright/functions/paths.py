"""Expressions over slash-separated paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_stem(path: Column | str, default: str) -> Column:
    """What follows the last ``/``, cut before its last ``.``; ``default`` for ``NULL``."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.substring_index(path, "/", -1)
    return F.coalesce(F.regexp_replace(name, r"\.[^.]*\z", ""), F.lit(default))
