"""Columns made by plain Python over Arrow batches, beside whatever columns a frame has."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows that are handed over at once, and bytes of them at most (a larger row stands alone).
ROWS, SIZE = 256, 1 << 22
#: Rows that a work on whole columns takes at once.
MANY = 4096


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def structs(rows: Sequence[Sequence[tuple]], kind: pa.ListType) -> pa.Array:
    """Lists of tuples as an array of lists of structs."""
    of = kind.value_type
    flat = [x for row in rows for x in row]
    columns = list(zip(*flat, strict=True)) if flat else [()] * of.num_fields
    offsets = np.r_[0, np.cumsum([len(row) for row in rows])].astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(c, of.field(i).type) for i, c in enumerate(columns)], fields=list(of))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(most, batch.num_rows * SIZE // max(1, batch.nbytes)))
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def added(df: DataFrame, ddl: str, reads: Sequence[str], work: Callable[..., Sequence], each: bool = True, kept: Sequence[str] | None = None) -> DataFrame:
    """df (kept: only those columns of it) with the columns of ddl in place of any of the same names. work(*values of the columns read) gives a row's
    new values (not each: work(*lists of values) those of many rows); a list of structs is given as a list of tuples."""
    new = fields(ddl)
    names = {f.name for f in new}
    stay = [f for f in df.schema.fields if f.name not in names and (kept is None or f.name in kept)]
    kinds, order = [to_arrow_type(f.dataType) for f in new], [f.name for f in stay] + [f.name for f in new]

    def column(values: Sequence, kind: pa.DataType) -> pa.Array:
        if pa.types.is_list(kind) and pa.types.is_struct(kind.value_type):
            return structs(values, kind)
        return pa.array(values, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, ROWS if each else MANY):
                values = [part.column(c).to_pylist() for c in reads]
                got = [work(*row) for row in zip(*values, strict=True)] if each else work(*values)
                made = [column(list(v), k) for v, k in zip(zip(*got, strict=True) if got else [()] * len(kinds), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in stay), *made], names=order)

    return df.mapInArrow(run, T.StructType(stay + new))
