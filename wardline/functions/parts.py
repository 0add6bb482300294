"""Arrow batches in parts, so that what a worker holds as Python objects has a bound, however many rows a batch has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of a part at most, unless it is one row.
PART_BYTES = 1 << 20


def parts(*columns: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of one length, cut into consecutive rows of at most so many bytes, or single rows."""
    n = len(columns[0])
    if n < 2 or sum(c.nbytes for c in columns) <= most:
        yield columns
    else:
        yield from parts(*(c.slice(0, n // 2) for c in columns), most=most)
        yield from parts(*(c.slice(n // 2) for c in columns), most=most)


def by_parts(batches: Iterator[pa.Array | tuple[pa.Array, ...]], kind: pa.DataType, each: Callable[..., list]) -> Iterator[pa.Array]:
    """For Arrow UDFs over iterators: what `each` makes of the lists of a part's values, as an array of `kind`, a part at a time."""
    for batch in batches:
        for part in parts(*(batch if isinstance(batch, tuple) else (batch,))):
            yield pa.array(each(*(c.to_pylist() for c in part)), kind, from_pandas=True)
