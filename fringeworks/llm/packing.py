"""Packing documents into fixed token windows: concatenate and cut.

Pass one tokenizes each partition and numbers its tokens from 0; the table of
tokens is written once.  The totals of the partitions, one row each, give by a
prefix sum the global offset of every partition.  Pass two adds the offsets and
cuts at the multiples of the sequence length: a document that crosses a
boundary becomes several pieces (boundary records).  No token is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import stored
from ._text import binary_of, list_of, ragged, slices, table
from ._units import encoder
from ._worker import tidy

SEQUENCE_TOKENS = 2048
END_OF_DOCUMENT = 1

_TOKENS = "part int, within long, doc_id long, ids array<int>"
_PIECES = "doc_id long, start long, length long, ids {}, doc_tokens long, sequence_id long, offset long"


def tokenized(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """Rows (part, within, doc_id, ids): ids of every document with ``end_id`` last, numbered within their partition."""
    schema = pa.schema([("part", pa.int32()), ("within", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, code = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch, data, offs in slices(batches):
            ids, first = code.encode(data, offs)
            ends = first[1:] + np.arange(1, len(first))  # with one more id for each document
            out = np.full(int(ends[-1]), end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            offsets = np.concatenate([np.zeros(1, np.int64), ends])
            yield table(schema, [np.full(len(ends), part), at + offsets[:-1], batch.column(0), list_of(out, offsets, pa.int32())])
            at += len(out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run, keeps=True), _TOKENS)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", sequence_tokens: int = SEQUENCE_TOKENS, end_id: int = END_OF_DOCUMENT, ids_as: str = "array<int>") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents.

    docs: doc_id, text; other columns are ignored.  A null or empty text is the
    end token alone.  ids is an array of int or, with ids_as="binary", the ids as
    little-endian unsigned 32-bit integers.  Rows with a null doc_id are packed
    like others, under a null doc_id.  A text of any length is packed whole, in as
    many pieces as it needs.  Repeated rows are packed as often as they occur.  An
    empty table gives no pieces.  Sequences are full but for the last one.
    """
    tokens = stored(tokenized(docs, tokenizer, end_id), "tokens")
    totals = tokens.groupBy("part").agg(F.sum(F.size("ids").cast("long")).alias("n"))
    # one row for each partition of the tokens table
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary() if ids_as == "binary" else pa.list_(pa.int32())), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                ids = batch.column(1).combine_chunks() if isinstance(batch.column(1), pa.ChunkedArray) else batch.column(1)
                flat, offs = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy().astype(np.int64))])
                begin = batch.column(2).to_numpy()
                size = np.diff(offs)
                first, last = begin // sequence_tokens, (begin + size - 1) // sequence_tokens
                pieces = last - first + 1
                row = np.repeat(np.arange(len(size)), pieces)
                seq = ragged(first, pieces)
                lo = np.maximum(begin[row], seq * sequence_tokens)
                hi = np.minimum(begin[row] + size[row], (seq + 1) * sequence_tokens)
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(hi - lo)])
                cells = binary_of(np.ascontiguousarray(flat, "<i4").view(np.uint8), bounds * 4) if ids_as == "binary" else list_of(flat, bounds, pa.int32())
                yield table(schema, [batch.column(0).take(pa.array(row)), lo - begin[row], hi - lo, cells, size[row], seq, lo - seq * sequence_tokens])

    placed = tokens.join(F.broadcast(before), "part").select("doc_id", "ids", (F.col("before") + F.col("within")).alias("begin"))
    return placed.mapInArrow(cut, _PIECES.format(ids_as))
