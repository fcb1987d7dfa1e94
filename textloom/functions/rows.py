"""Python functions of a row. Spark hands them to a worker a hundred rows at a time; a pandas function gets ten thousand,
which with long texts is most of a worker's memory however small its own work is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def by_row(kind: DataType) -> Callable[[Callable], Callable]:
    return lambda f: F.udf(f, kind, useArrow=False)
