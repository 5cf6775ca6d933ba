"""Status of chunks: missing and unknown statuses count as current."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_superseded(status: Column) -> Column:
    return F.coalesce(status, F.lit("")) == "superseded"


def visible(status: Column, include_superseded: bool = False) -> Column:
    """Filter of the rows that a search may see, in a form that reaches the scan."""
    return F.lit(True) if include_superseded else status.isNull() | (status != "superseded")


def plain_status(status: Column) -> Column:
    return F.when(is_superseded(status), "superseded").otherwise("current")
