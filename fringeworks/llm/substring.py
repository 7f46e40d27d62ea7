"""Substring de-duplication: Rabin-Karp hashes of every window of words.

Every window of ``width`` consecutive words is hashed.  The hashes go, packed by
the thousand, to the bucket that the smallest hash of a short word sequence
within the window names, so neighbouring windows mostly share a bucket.  A bucket
finds for each window hash the smallest document that holds it, and every other
document's window is repeated.  Repeated windows merge into maximal removal
intervals.

Within a task's block of documents a window that a smaller document of the
block holds is settled on the spot, so a passage of a third of all documents
sends one hash for each block and not one for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import _WORD_BASE, U64, binary_of, bytes_of, list_of, mix, prefix_hash, ragged, runs, slices, slide, span_hash, table, window_hashes, word_hashes, words
from ._worker import tidy

WIDTH = 50
#: Slices of text that form a block.
BLOCK_SLICES = 4
#: Buckets for each shuffle partition at least, and bytes of text for each at most.
BUCKETS = 8
BUCKET_BYTES = 2 << 20
#: Words of the sequences of which a window's smallest names its bucket.
GRAM_WORDS = 5

_PACKED = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("gaps", pa.binary()), ("hashes", pa.binary())])
_HITS = pa.schema([("doc_id", pa.int64()), ("at", pa.list_(pa.int32()))])


def _packed(bucket: np.ndarray, doc: np.ndarray, at: np.ndarray, hashes: np.ndarray | None) -> pa.RecordBatch:
    """Windows in the order of bucket, document, position: one row for each bucket."""
    n = len(bucket)
    new_bucket = np.append(True, bucket[1:] != bucket[:-1])
    new_doc = new_bucket | np.append(True, doc[1:] != doc[:-1])
    gap = at.astype(np.int32)
    gap[1:][~new_doc[1:]] = np.diff(at)[~new_doc[1:]]
    rows, groups = np.flatnonzero(new_bucket), np.flatnonzero(new_doc)
    inner = np.append(np.searchsorted(groups, rows), len(groups))
    outer = np.append(rows, n)
    sizes = np.diff(np.append(groups, n)).astype(np.int32)
    view = lambda x, w, o: binary_of(np.ascontiguousarray(x).view(np.uint8), o * w)
    h = view(hashes, 8, outer) if hashes is not None else pa.array([b""] * len(rows), pa.binary())
    return table(_PACKED, [bucket[rows].astype(np.int32), view(doc[groups].astype(np.int64), 8, inner), view(sizes, 4, inner), view(gap, 4, outer), h])


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, positions and hashes (those that have one come first) of packed rows."""
    get = lambda name, kind: [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
    docs, counts, gaps, hashes = get("docs", np.int64), get("counts", np.int32), get("gaps", np.int32), get("hashes", np.uint64)
    order = sorted(range(len(docs)), key=lambda i: not len(hashes[i]))
    join = lambda x, kind: np.concatenate([x[i] for i in order]) if order else np.zeros(0, kind)
    docs, counts, gaps, hashes = join(docs, np.int64), join(counts, np.int32), join(gaps, np.int32), join(hashes, np.uint64)
    total = np.cumsum(gaps, dtype=np.int64)
    begin = np.cumsum(counts, dtype=np.int64) - counts
    before = (total - gaps)[begin] if len(begin) else begin
    return np.repeat(docs, counts), total - np.repeat(before, counts), hashes


def _least_grams(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """For windows of words that begin at ``at``: the smallest hash of a short sequence within."""
    size = min(GRAM_WORDS, width)
    if len(hashes) < width:
        return np.zeros(0, U64)
    begin = np.arange(len(hashes) - size + 1)
    grams = mix(span_hash(prefix_hash(hashes, _WORD_BASE), begin, begin + size, _WORD_BASE))
    return mix(slide(grams, width - size + 1, np.minimum, U64(0xFFFFFFFFFFFFFFFF))[at])


def _smaller_elsewhere(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Mask of the windows whose hash a smaller document has."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.argsort(hashes, kind="stable")
    begin = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    least = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.append(begin, len(order))))
    out = np.zeros(len(hashes), bool)
    out[order] = doc[order] > least
    return out


def repeated_windows(docs: DataFrame, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """Rows (doc_id, at): the first words of windows that a document with a smaller id holds too; some rows for each document."""
    n = buckets or max(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), bytes_of(docs) // BUCKET_BYTES)

    def block(held: list[tuple[np.ndarray, ...]], turn: int) -> Iterator[pa.RecordBatch]:
        hashes, doc, at, name = (np.concatenate(x) for x in zip(*held, strict=True))
        if not len(hashes):
            return
        known = _smaller_elsewhere(hashes, doc)
        for settled in (False, True):
            mine = np.flatnonzero(known == settled)
            if len(mine):
                bucket = (name[mine] % U64(n)).astype(np.int32) if not settled else (mine // 65536 + turn) % n
                order = np.lexsort((at[mine], doc[mine], bucket))
                mine, bucket = mine[order], bucket[order]
                yield _packed(bucket, doc[mine], at[mine], None if settled else hashes[mine])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, turn = [], 0
        for batch, data, offs in slices(batches):
            start, end, first = words(data, offs)
            each = word_hashes(data, start, end)
            hashes, at, begins = window_hashes(each, first, width)
            of = np.repeat(np.arange(len(offs) - 1), np.diff(begins))
            held.append((hashes, batch.column(0).to_numpy()[of], at - first[of], _least_grams(each, at, width)))
            if len(held) == BLOCK_SLICES:
                yield from block(held, turn)
                held, turn = [], turn + 1
        if held:
            yield from block(held, turn)

    def settle(rows: pa.Table) -> pa.Table:
        doc, at, hashes = _unpacked(rows)
        hit = np.ones(len(doc), bool)
        hit[: len(hashes)] = _smaller_elsewhere(hashes, doc[: len(hashes)])
        doc, at = doc[hit], at[hit]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        return pa.Table.from_batches([table(_HITS, [doc[new], list_of(at.astype(np.int32), np.append(new, len(doc)), pa.int32())])])

    rows = docs.filter("doc_id is not null").mapInArrow(tidy(hashed), "bucket int, docs binary, counts binary, gaps binary, hashes binary")
    return rows.groupBy("bucket").applyInArrow(settle, "doc_id long, at array<int>")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, n_words, spans, kept_text) for every document.

    spans: maximal removal intervals, in words, as structs (start, end).
    kept_text: the other words joined by one space.

    docs: doc_id, text; other columns are ignored.  A null or empty text has no
    words and keeps the empty text; one with fewer words than ``width`` keeps
    all.  Rows with a null doc_id are returned and never compared.  Of equal
    passages the one in the smallest doc_id stays, every one that stands in it.
    Repeated rows of a doc_id each get their row.  Windows are compared by
    64-bit hashes of 64-bit word hashes.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    hits = repeated_windows(plain, width).groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("at"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            start, end, first = words(data, offs)
            at = batch.column(2)
            counts = np.nan_to_num(at.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            begin = np.repeat(first[:-1], counts) + at.flatten().to_numpy(zero_copy_only=False)
            change = np.zeros(len(start) + width + 1, np.int32)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + width, -1)
            gone = np.cumsum(change)[: len(start)] > 0
            a, b = runs(gone, first)
            of = np.searchsorted(first, a, "right") - 1
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(offs))).astype(np.int32)), pa.StructArray.from_arrays([pa.array((a - first[of]).astype(np.int32)), pa.array((b - first[of]).astype(np.int32))], ["start", "end"]))
            keep = ~gone
            s, e = start[keep], end[keep]
            size = e - s + 1
            done = np.cumsum(size)
            out = np.append(data, np.uint8(32))[ragged(s, size)]
            out[done - 1] = 32
            kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[first]
            bounds = np.concatenate([np.zeros(1, np.int64), done])[kept]
            full = np.diff(bounds) > 0
            drop = np.ones(len(out), bool)
            drop[bounds[1:][full] - 1] = False
            bounds = bounds - np.concatenate([np.zeros(1, np.int64), np.cumsum(full)])
            yield table(schema, [batch.column(0), np.diff(first), spans, binary_of(out[drop], bounds).cast(pa.string())])

    joined = plain.join(hits.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "at")
    return joined.mapInArrow(tidy(cut), "doc_id long, n_words long, spans array<struct<start:int,end:int>>, kept_text string")
