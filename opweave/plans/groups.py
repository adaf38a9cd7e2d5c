"""Small groups through one Arrow stream: no per-group DataFrame, one group in memory at a time."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Rows = list[tuple]


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[tuple, Rows], Rows], schema: str) -> DataFrame:
    """fn(key values, rows in ``order``) -> result rows of ``schema``, for each group of ``keys``.

    Rows are the columns of ``df`` after the keys.  Groups must be small by construction (clusters, islands)."""
    rest = [c for c in df.columns if c not in keys]
    n = len(keys)
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    types = {"string": pa.string(), "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    out_schema = pa.schema([(c.strip().split(" ")[0], types[c.strip().split(" ")[1]]) for c in schema.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        rows: Rows = []
        for b in batches:
            out: Rows = []
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[:n] != key:
                    if key is not None:
                        out += fn(key, rows)
                    key, rows = r[:n], []
                rows.append(r[n:])
            yield _batch(out)
        if key is not None:
            yield _batch(fn(key, rows))

    def _batch(out: Rows) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
