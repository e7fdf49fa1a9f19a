"""Expressions over typed yes/no replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The replies taken as consent, in any letter case.
YES = ("y", "yes")


def is_yes(reply: Column | str) -> Column:
    """True for exactly ``y`` or ``yes`` in any case, blanks and tabs around it aside."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    return F.coalesce(
        F.lower(F.btrim(reply, F.lit(" \t"))).isin(*YES), F.lit(False)
    )


def reply_outcome(reply: Column | str, optional: Column | str | bool) -> Column:
    """``proceed`` on consent; without it ``skip`` an optional step, else ``abort``.

    ``optional`` is a column, or a plain ``bool`` where it is the same for all replies.
    """
    if isinstance(optional, bool):
        optional = F.lit(optional)
    elif isinstance(optional, str):
        optional = F.col(optional)
    return F.when(is_yes(reply), "proceed").when(optional, "skip").otherwise("abort")
