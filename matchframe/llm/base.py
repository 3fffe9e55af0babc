"""Registration, session settings and small helpers shared by the text operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import materialize, scratch_dir, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Texts differ in length by four orders of magnitude: small batches of the reader and of Arrow
# keep a batch of long ones within the memory of an executor and its Python workers. A writing
# task holds a row group until it is full.
TEXT_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.parquet.columnarReaderBatchSize": "500",
             "parquet.block.size": str(32 << 20)}

__all__ = ["ORACLES", "QUERIES", "by_rows", "held", "let", "materialize", "prepare", "query", "read", "running", "scratch_dir", "unused", "whole_text"]


def prepare(spark: SparkSession) -> SparkSession:
    tune(spark)
    for key, value in TEXT_CONF.items():
        spark.conf.set(key, value)
    return spark


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with its SQL where one exists."""
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


_tables: dict = {}


def held(name: str, make: Callable):
    """A Python worker's tables of one operator, made at its first row. Workers outlive their
    stage: those of another operator are let go first, so that a chain of operators takes no
    more memory than the largest of them."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = make()
    return _tables[name]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """zero, then the values combined up to each one: one element more than the array has.

    Blocks are folded first and then their insides, so no step copies all that came before it
    and a very long array costs little more than a linear scan.
    """
    width = 256
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / width).cast("int")), lambda b: F.slice(values, b * width + 1, F.lit(width)))

    def fold(array: Column, first: Column) -> Column:
        return F.aggregate(array, F.array(first), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def inside(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, zero, combine))
        return let(fold(totals, zero), lambda heads: F.concat(F.array(zero), F.flatten(
            F.transform(parts, lambda part, i: F.slice(fold(part, F.get(heads, i)), 2, width)))))
    return let(blocks, inside)


def by_rows(make: Callable[[], Callable], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: make() is called once a task and gives a function from the
    columns of a row (Python values) to the tuple of output values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            if batch.num_rows:
                rows = [one(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run
