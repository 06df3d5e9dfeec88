"""Small helpers of the Arrow functions that run inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_ROWS = 256  # rows that a task's Python holds at once, whatever Arrow batches Spark sends


_TYPES = {"long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "string": T.StringType,
          "boolean": T.BooleanType, "binary": T.BinaryType}


def schema_of(columns: str) -> T.StructType:
    """``name type, ...`` as a schema, without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]()) for n, t in (c.split() for c in columns.split(","))])


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column has it (Spark's names ignore case)."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def map_rows(df: DataFrame, schema: T.StructType | str, fn: Callable[[pa.RecordBatch], list[list]]) -> DataFrame:
    """``fn`` turns a slice of rows into the columns of ``schema``; any number of rows may come out."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in slices(batches):
            cols = fn(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows for which ``keep`` says so, with all their columns."""

    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(keep(b), pa.bool_()))

    return df.mapInArrow(run, df.schema)
