"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last bytes says so, so
copied passages give equal chunks wherever they stand.  Chunks that several
documents hold are encoded once: within a chunk only its body counts, from its
first white space to its last, for its ends may be parts of words.  A document
takes the ids of the bodies of its shared chunks from there and encodes what is
left.  Where a body meets its neighbour the join is encoded anew as one string,
and its ids must be those that both sides have at their ends; where they differ
the join is widened into the body, word by word, until they agree exactly.

No text is shuffled.  Documents are known by the partition of the scan that
reads them and their row in it.  What a partition needs, the names of chunks that
it is to encode and the ids of shared ones, lies in the shared folder beside it,
one folder for each partition.  Ids are used only where the 128-bit name of a
chunk is that of the text at hand, so should a scan deal out rows anew, chunks
are encoded where they stand and the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, new_folder, stored
from ._text import _BYTE, _SPACE, U64, binary_of, byte_prefix, mix, prefix_hash, ragged, slices, span_hash, table
from ._units import REMEMBERED as REMEMBERED_UNITS
from ._units import UnitEncoder, cuts, tokenizer_path
from ._worker import held, tidy

#: Mean bytes of a chunk, and bytes that the rolling hash sees.
CHUNK_BYTES = 512
ROLLING = 24
_SECOND_BASE = U64(0xC2B2AE3D27D4EB4F)

#: Units that a worker remembers: it holds no texts beside them, so twice as many as others do.
UNITS = 2 * REMEMBERED_UNITS
#: Joins whose answer a worker remembers.
REMEMBERED = 100_000

_CHUNKS = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("chunks", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))])
_BODIES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("body", pa.binary())])


def chunks(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray, mean: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of some texts; none crosses texts or cuts a character."""
    n = len(data)
    begin = np.zeros(n + 1, bool)
    if n > ROLLING:
        at = np.arange(ROLLING, n)
        inside = at - offs[np.searchsorted(offs, at, "right") - 1] >= ROLLING
        begin[ROLLING:n] = (mix(span_hash(prefix, at - ROLLING, at)) % U64(mean) == 0) & inside & ((data[at] & 0xC0) != 0x80)
    begin[offs] = True
    begin[n] = False
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n) if len(starts) else starts


def bodies(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each chunk the part from its first ASCII white space to the last run of it (empty if there is one run at most)."""
    if not len(starts):
        return starts, ends
    space = _SPACE[data]
    run = space.copy()
    run[1:] &= ~space[:-1]
    run[starts] = space[starts]
    at = np.append(np.flatnonzero(run), len(data))
    first = at[np.searchsorted(at, starts)]
    last = at[np.maximum(np.searchsorted(at, ends) - 1, 0)]
    empty = (first >= ends) | (last <= first)
    return np.where(empty, starts, first), np.where(empty, starts, last)


def chunk_keys(docs: DataFrame, mean: int = CHUNK_BYTES) -> DataFrame:
    """(part, row, chunks): 128-bit names (a, b) of the chunks of every row of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch, data, offs in slices(batches):
            prefix = byte_prefix(data)
            starts, ends = chunks(data, offs, prefix, mean)
            a, b = _keys(data, prefix, starts, ends)
            cells = pa.StructArray.from_arrays([pa.array(a), pa.array(b)], fields=list(_CHUNKS.field(2).type.value_type))
            n = batch.num_rows
            yield table(_CHUNKS, [np.full(n, part), row + np.arange(n), pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offs).astype(np.int32)), cells)])
            row += n

    return docs.select("text").mapInArrow(tidy(run), "part int, row long, chunks array<struct<a:long,b:long>>")


def _keys(data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = (ends - starts).astype(U64)
    second = prefix_hash(_BYTE[data], _SECOND_BASE)
    return mix(span_hash(prefix, starts, ends) + size).view(np.int64), mix(span_hash(second, starts, ends, _SECOND_BASE) ^ size).view(np.int64)


class Decoder:
    """Texts of ids: the tokens' strings joined by one space, as a tokenizer without a decoder gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path(path))
        if tokenizer.decoder is not None:
            raise ValueError("this decoder is for tokenizers that state none")
        names = [(tokenizer.id_to_token(i) or "").encode() + b" " for i in range(tokenizer.get_vocab_size())]
        self.size = np.array([len(x) for x in names], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(names), np.uint8)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[ids]
        data = self.flat[ragged(self.start[ids], size)]
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[offs]
        full = np.diff(bounds) > 0
        keep = np.ones(len(data), bool)
        keep[bounds[1:][full] - 1] = False  # the space after the last token
        return data[keep], bounds - np.concatenate([np.zeros(1, np.int64), np.cumsum(full)])


class Codec:
    """Encoder and decoder of a file, and the joins met so far: whether their ids are those of their two sides."""

    def __init__(self, path: str):
        self.encoder, self.decoder = UnitEncoder(path, UNITS), Decoder(path)
        self.whole = self.encoder.tokenizer
        self.joins: dict[tuple[bytes, bytes], bool] = {}
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"

    def side(self, text: bytes) -> list[int]:
        """Ids of a text by itself."""
        data = np.frombuffer(text, np.uint8)
        return self.encoder.encode(data, np.array([0, len(data)]))[0].tolist()

    def agrees(self, left: bytes, right: bytes) -> bool:
        """Does the tokenizer give for both in one string the ids that it gives for each?"""
        key = (left, right)
        if key not in self.joins:
            if len(self.joins) >= REMEMBERED:
                self.joins.clear()
            self.joins[key] = self.whole.encode((left + right).decode(), add_special_tokens=False).ids == self.side(left) + self.side(right)
        return self.joins[key]


def codec(path: str) -> Codec:
    return held(("codec", path), lambda: Codec(path))


def lay_beside(rows: DataFrame, name: str) -> str:
    """Writes rows so that the task of a partition finds its own: rows have a column part."""
    folder = new_folder(rows.sparkSession, name)
    rows.repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def found_beside(folder: str, part: int, schema: pa.Schema) -> pa.Table:
    """The rows of one partition."""
    system, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/part={part}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return schema.empty_table()
    return dataset.dataset(path, filesystem=system, format="parquet").to_table(columns=schema.names).cast(schema)


class Named:
    """Rows by the 128-bit names of chunks."""

    def __init__(self, rows: pa.Table):
        a, b = (rows.column(c).to_numpy() for c in ("a", "b"))
        self.order = np.lexsort((b, a))
        self.a, self.b = a[self.order], b[self.order]

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The row of each name, or -1.  Of rows with equal first halves the first one alone is found."""
        if not len(self.a):
            return np.full(len(a), -1)
        at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        return np.where((self.a[at] == a) & (self.b[at] == b), self.order[at], -1)


def _repaired(code: Codec, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, offs: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bodies after their joins agree: lo, hi, and the ids to leave out at both ends.  begins: where units begin, and the end of the data."""
    lo, hi, skip, drop = lo.copy(), hi.copy(), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    raw = data.tobytes()
    edge = set(offs.tolist())
    for k in range(len(lo)):
        while lo[k] < hi[k] and int(lo[k]) not in edge:
            p = int(lo[k])
            i = int(np.searchsorted(begins, p))
            before, after = int(begins[i - 1]), min(int(begins[np.searchsorted(begins, p, "right")]), int(hi[k]))
            if code.agrees(raw[before:p], raw[p:after]):
                break
            skip[k] += len(code.side(raw[p:after]))
            lo[k] = after
        while lo[k] < hi[k] and int(hi[k]) not in edge:
            p = int(hi[k])
            i = int(np.searchsorted(begins, p))
            before, after = max(int(begins[i - 1]), int(lo[k])), int(begins[np.searchsorted(begins, p, "right")])
            if code.agrees(raw[before:p], raw[p:after]):
                break
            drop[k] += len(code.side(raw[before:p]))
            hi[k] = before
    return lo, hi, skip, drop


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", mean: int = CHUNK_BYTES) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, and the text decoded from them.

    docs: doc_id, text; other columns are ignored.  A null or empty text has no
    ids and decodes to the empty text.  Rows with a null doc_id are encoded like
    others.  Repeated rows each get their row, and share their chunks.  Texts of
    any length are encoded whole.  An empty table gives an empty one.  The
    tokenizer must be one that drops white space, as pre-tokens, from the ids.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    keys = stored(chunk_keys(plain, mean), "chunks")
    each = keys.select("part", F.shiftleft(F.col("part").cast("long"), 36).bitwiseOR(F.col("row")).alias("place"), F.explode("chunks").alias("x")).select("part", "place", "x.*")
    held_by = each.groupBy("a", "b").agg(F.min("place").alias("p"), F.max("place").alias("q"), F.collect_set("part").alias("parts")).filter("p < q")
    shared = stored(held_by.select("a", "b", "parts"), "shared")
    discard(keys)
    owned = lay_beside(shared.select(F.array_min("parts").alias("part"), "a", "b"), "owned")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = found_beside(owned, TaskContext.get().partitionId(), pa.schema(list(_BODIES)[:2]))
        named, done, code = Named(mine), np.zeros(mine.num_rows, bool), codec(tokenizer)
        for _, data, offs in slices(batches):
            if done.all():
                continue
            prefix = byte_prefix(data)
            starts, ends = chunks(data, offs, prefix, mean)
            a, b = _keys(data, prefix, starts, ends)
            row = named.find(a, b)
            chunk = np.flatnonzero(row >= 0)
            row, first = np.unique(row[chunk], return_index=True)
            chunk = chunk[first][~done[row]]
            done[row] = True
            lo, hi = (v[chunk] for v in bodies(data, starts, ends))
            ids, bounds = code.encoder.encode(data[ragged(lo, hi - lo)], np.concatenate([np.zeros(1, np.int64), np.cumsum(hi - lo)]))
            yield table(_BODIES, [a[chunk], b[chunk], binary_of(np.ascontiguousarray(ids, code.kind).view(np.uint8), bounds * np.dtype(code.kind).itemsize)])

    dictionary = stored(plain.select("text").mapInArrow(tidy(once, keeps=True), "a long, b long, body binary").filter("octet_length(body) > 0"), "dictionary")
    given = lay_beside(shared.join(dictionary, ["a", "b"]).select(F.explode("parts").alias("part"), "a", "b", "body"), "given")
    discard(shared, dictionary)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        mine = found_beside(given, TaskContext.get().partitionId(), _BODIES)
        named, held_ids = Named(mine), mine.column("body").to_pylist()
        size = np.fromiter(map(len, held_ids), np.int64, len(held_ids)) // np.dtype(code.kind).itemsize
        bank = np.frombuffer(b"".join(held_ids), code.kind)
        del mine, held_ids
        place = np.cumsum(size) - size
        for batch, data, offs in slices(batches):
            prefix = byte_prefix(data)
            starts, ends = chunks(data, offs, prefix, mean)
            row = named.find(*_keys(data, prefix, starts, ends))
            known = np.flatnonzero(row >= 0)
            k0 = place[row[known]]
            k1 = k0 + size[row[known]]
            lo, hi = (v[known] for v in bodies(data, starts, ends))
            lo, hi, skip, drop = _repaired(code, data, lo, hi, offs, np.append(cuts(data, offs), len(data)))
            full = lo < hi
            lo, hi, k0, k1 = lo[full], hi[full], (k0 + skip)[full], (k1 - drop)[full]
            # what no shared body covers: from each text's start or a body's end to a body's start or the text's end
            begin = np.sort(np.concatenate([offs[:-1], hi]))
            stop = np.sort(np.concatenate([offs[1:], lo]))
            ids, bounds = code.encoder.encode(data[ragged(begin, stop - begin)], np.concatenate([np.zeros(1, np.int64), np.cumsum(stop - begin)]))
            # pieces in the order of the text; an empty one at the same place comes first
            at = np.concatenate([begin, lo])
            source = np.concatenate([bounds[:-1], len(ids) + k0])
            length = np.concatenate([np.diff(bounds), k1 - k0])
            order = np.lexsort((np.concatenate([np.zeros(len(begin), int), np.ones(len(lo), int)]), at))
            picked = ragged(source[order], length[order])
            flat = np.empty(len(picked), np.uint32)
            new = picked < len(ids)
            flat[new], flat[~new] = ids[picked[new]], bank[picked[~new] - len(ids)]
            total = np.concatenate([np.zeros(1, np.int64), np.cumsum(length[order])])
            first = total[np.searchsorted(at[order], offs)]
            text, ends_ = code.decoder.decode(flat, first)
            yield table(schema, [batch.column(0), np.diff(first), binary_of(np.ascontiguousarray(flat, "<u4").view(np.uint8), first * 4), binary_of(text, ends_).cast(pa.string())])

    return plain.mapInArrow(tidy(whole, keeps=True), "doc_id long, n_tokens long, ids binary, decoded string")
