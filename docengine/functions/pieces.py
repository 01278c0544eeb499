"""Columns worked out in Python a piece of an Arrow batch at a time, so that a worker's memory doesn't grow with the rows of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import ship

#: Bytes of a piece, if it has more than one row.
PIECE = 1 << 20


def pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch in slices of so many bytes, or of one row that has more."""
    todo = [batch]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > most:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        elif part.num_rows:
            yield part


def computed(rows: DataFrame, inputs: Sequence[str], one: Callable[..., dict[str, Any] | None], new: str | T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """The columns `keep` of rows, and new ones by a function of a row's inputs that gives them as a dictionary; rows it gives None for are left out."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(rows.sparkSession)
    fields = T.StructType.fromDDL(new) if isinstance(new, str) else new
    kinds = to_arrow_schema(fields)
    some = rows.select(*dict.fromkeys([*keep, *inputs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = [one(*row) for row in zip(*(part.column(c).to_pylist() for c in inputs), strict=True)]
                if keep and None in out:
                    part = part.filter(pa.array([x is not None for x in out]))
                out = [x for x in out if x is not None]
                if out:
                    made = [pa.array([x[f.name] for x in out], f.type) for f in kinds]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *kinds.names])
                    del made
                del out, part

    return some.mapInArrow(run, T.StructType([*(some.schema[c] for c in keep), *fields]))
