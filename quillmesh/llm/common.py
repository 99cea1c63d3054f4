"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.plans.components import durable

__all__ = ["bound", "cut", "durable", "pieces_of", "table"]

#: Signs in a piece of a text that spans are cut out of.
PIECE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pieces_of(text: Column) -> Column:
    """A text in pieces of PIECE code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points start to end, in time that doesn't grow with their distance from the beginning."""
    first = F.floor(start / PIECE).cast("int")
    joined = F.array_join(F.slice(pieces, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
    return F.substring(joined, (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))
