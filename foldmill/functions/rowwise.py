"""Python functions of a row as columns, in pieces, so that memory is that of a piece and not of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows and bytes of a piece; a row that is longer is a piece by itself.
PIECE_ROWS, PIECE_BYTES = 256, 4 << 20
#: Of paragraphs their score, negative, and their place.
SCORES = "array<struct<less:bigint,at:int>>"
_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), SCORES: pa.list_(pa.struct([("less", pa.int64()), ("at", pa.int32())]))}


def pieces(n: int, width: float) -> Iterator[tuple[int, int]]:
    """Begin and length of pieces of ``n`` rows that have ``width`` bytes on average."""
    rows = max(1, min(PIECE_ROWS, int(PIECE_BYTES / max(1.0, width))))
    return ((at, min(rows, n - at)) for at in range(0, n, rows))


def by_row(f: Callable, kind: str, *columns: Column) -> Column:
    """``f`` of each row of the columns. Values become Python objects a piece at a time; what waits is Arrow."""

    def run(*arrays):
        n, out = len(arrays[0]), []
        for at, k in pieces(n, sum(a.nbytes for a in arrays) / max(1, n)):
            rows = zip(*(a.slice(at, k).to_pylist() for a in arrays))
            out.append(pa.array([f(*r) for r in rows], _ARROW[kind]))
        return pa.concat_arrays(out) if out else pa.array([], _ARROW[kind])

    return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR)(*columns)
