"""Operators over typed replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import reply_outcome


def classify_replies(
    df: DataFrame, reply: Column | str, optional: Column | str | bool
) -> DataFrame:
    """Rows ``(outcome, n)``: how many replies mean ``proceed``, ``skip`` or ``abort``."""
    outcome = reply_outcome(reply, optional).alias("outcome")
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
