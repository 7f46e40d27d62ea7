"""Array kernels over batches of texts, shared by the operators of this subpackage.

A batch of texts is one ``uint8`` array plus the offsets at which the texts
start.  All hashes are polynomial (Rabin-Karp) hashes modulo 2**64 over values
taken from a fixed random table, finished by an avalanche step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are taken in slices of about this many bytes, which bounds the temporaries of a task.
SLICE_BYTES = 1_000_000
#: Powers that a worker keeps between tasks; a longer text has its own for as long as its task runs.
KEPT_POWERS = 1 << 20

_BASE = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n at least, modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        inverse = U64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, base)]), dtype=U64)
            down = np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, inverse)]), dtype=U64)
        have = _POWERS[int(base)] = (up, down)
    return have


def forget_powers() -> None:
    """Lets the powers go that only very long texts need."""
    for base, (up, down) in list(_POWERS.items()):
        if len(up) > KEPT_POWERS:
            _POWERS[base] = (up[:KEPT_POWERS].copy(), down[:KEPT_POWERS].copy())


def prefix_hash(values: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """P with P[i] = sum of values[j] * base**j over j < i."""
    out = np.zeros(len(values) + 1, U64)
    if len(values):
        np.cumsum(values * powers(len(values) + 1, base)[0][: len(values)], out=out[1:])
    return out


def byte_prefix(data: np.ndarray) -> np.ndarray:
    return prefix_hash(_BYTE[data])


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of values[start:end], the same wherever the values stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), base)[1][start]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its int64 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive runs of rows holding about ``most`` bytes of text, one row at least."""
    for batch in batches:
        data, offs = texts(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            to = min(to, n, at + 4096)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offs] = True
    start = np.flatnonzero(~space & edge[:-1])
    edge[:-1] = space
    edge[-1] = True
    edge[offs] = True
    end = np.flatnonzero(~space & edge[1:]) + 1
    return start, end, np.searchsorted(start, offs)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(span_hash(byte_prefix(data), start, end) + (end - start).astype(U64))


_WORD_BASE = U64(0xA0761D6478BD642F)


def window_hashes(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every ``width`` consecutive values within one text.

    Returns the hashes, the index of each window's first value, and for each
    text the index of its first window (one more at the end).
    """
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    begins = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])
    at = ragged(first[:-1], counts)
    prefix = prefix_hash(values, _WORD_BASE)
    return mix(span_hash(prefix, at, at + width, _WORD_BASE)), at, begins


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] values), then the same for the next pair, and so on."""
    count = np.asarray(count, np.int64)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.repeat(np.asarray(start, np.int64) - (np.cumsum(count) - count), count)
    out += np.arange(total)
    return out


def slide(x: np.ndarray, width: int, pick: np.ufunc, fill: np.uint64) -> np.ndarray:
    """pick over x[i : i + width] for every i (shorter at the end)."""
    n = len(x)
    rows = -(-n // width) + 1
    padded = np.full(rows * width, fill, U64)
    padded[:n] = x
    blocks = padded.reshape(rows, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; a run never crosses a position of ``breaks``."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[breaks] = True
    before = np.concatenate([[False], mask[:-1]])
    after = np.concatenate([mask[1:], [False]])
    return np.flatnonzero(mask & (~before | cut[:-1])), np.flatnonzero(mask & (~after | cut[1:])) + 1


def bytes_of(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, by which numbers of buckets are set."""
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def table(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array,)) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def list_of(values: np.ndarray, offs: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(offs, np.int32)), pa.array(values, kind))


def binary_of(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column from bytes and offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
