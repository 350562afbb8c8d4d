"""Helpers for operators that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow whose function yields columns as lists."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def cogroup_batches(left: DataFrame, right: DataFrame, key: str, function: Callable[[pa.Table, pa.Table], dict[str, list]], schema: str) -> DataFrame:
    """applyInArrow over cogroups of a key, for groups of bounded size, with results as lists; groups without rows on both sides are left out."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        columns = function(a, b) if a.num_rows and b.num_rows else {f.name: [] for f in arrow}
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return left.groupBy(key).cogroup(right.groupBy(key)).applyInArrow(run, struct)


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small input spread over all cores. Inputs of at least as many partitions as cores, all large ones, are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
