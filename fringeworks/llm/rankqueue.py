"""Byte-level BPE by a queue of merge ranks, and decoding.

All pre-tokens that a task has not met before are merged together.  Their bytes
are the nodes of linked lists, one list for each pre-token.  A merge rank has a
bucket of the nodes that begin a pair of that rank, and a hierarchical bitmap
tells which buckets hold anything: its first set bit is the next rank.  Of a
bucket the leftmost node comes first.  A node whose pair has changed since it
was put there is stale and skipped.  A merge puts at most two nodes into buckets,
so a pre-token of n bytes takes about n steps, be it a word or megabytes long.

A merged pair can form a pair of a lower rank with its neighbour, which must be
merged before the rest of the bucket; the rest then goes back.  New pairs spell
more bytes than the pair just merged, so they never go into the same bucket.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import binary_of, list_of, ragged, slices, table
from ._units import REMEMBERED_BYTES, UnitEncoder, tokenizer_path
from ._worker import held, tidy

#: Bits of a word of the bitmap.
WORD = 64
#: Pre-tokens of a worker's memory.
REMEMBERED = 400_000
#: Bytes of text that a task takes together: the more, the fuller the buckets.
SLICE_BYTES = 4_000_000
#: Nodes of a bucket from which on they are merged at once.
MANY = 400


class Bitmap:
    """A set of numbers below ``size``: words of 64 bits, and above them words that mark words which are not empty."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = -(-size // WORD)
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, x: int) -> None:
        for words in self.levels:
            at, bit = x >> 6, 1 << (x & 63)
            if words[at] & bit:
                return
            words[at] |= bit
            x = at

    def drop(self, x: int) -> None:
        for words in self.levels:
            at = x >> 6
            words[at] &= ~(1 << (x & 63))
            if words[at]:
                return
            x = at

    def first(self) -> int:
        """The least number, or -1: one find-first-set for each level."""
        x = 0
        for words in reversed(self.levels):
            word = words[x]
            if not word:
                return -1
            x = x << 6 | (word & -word).bit_length() - 1
        return x


class Lists(NamedTuple):
    """Nodes: token, rank of the pair that begins there, neighbours (or -1), whether it still is one, and its pre-token."""

    token: np.ndarray
    rank_at: np.ndarray
    after: np.ndarray
    before: np.ndarray
    alive: np.ndarray
    owner: np.ndarray


class RankQueueEncoder(UnitEncoder):
    """Ids of many texts at once by the ranks of a ``tiktoken`` file, and the bytes of ids."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import public_tokenizers

        self.split = regex.compile(public_tokenizers.PATTERN).findall
        with open(tokenizer_path(path), "rb") as lines:
            self.whole = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.size = max(self.whole.values()) + 1
        #: Rank of the merge of two tokens, by left * size + right.
        self.pairs = {}
        for token, rank in self.whole.items():
            for cut in range(1, len(token)):
                left, right = self.whole.get(token[:cut]), self.whole.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left * self.size + right] = rank
        keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[k] for k in keys.tolist()] + [self.size], np.int32)
        self.pair_keys = np.append(keys, np.iinfo(np.int64).max)
        self.of_byte = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)
        self.of_bytes = np.array([self.whole.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        self.used_ranks, self.buckets = Bitmap(self.size), [None] * self.size
        names = [b""] * self.size
        for token, rank in self.whole.items():
            names[rank] = token
        self.spelled = Spelling(names)
        self.decimal = Spelling([b"%d," % i for i in range(self.size)])
        self.remembered, self.part_bytes = remembered, 0
        self.old_parts: dict[str, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        kept = getattr(self, "parts", {})
        super()._forget()
        self.parts = kept  # pre-tokens are let go by themselves

    def merged(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens that lie one after the other in ``data``, and the number of ids before each end."""
        n, size, pairs, used = len(data), self.size, self.pairs, self.used_ranks
        ids = self.of_byte[data]
        ranks = np.full(n, -1, np.int32)
        ranks[:-1] = self.of_bytes[data[:-1].astype(np.int32) * 256 + data[1:]]
        ranks[ends - 1] = -1
        following, previous = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        following[ends - 1] = -1
        previous[np.append(0, ends[:-1])] = -1
        ranks[ranks < 0] = size
        order = np.argsort(ranks, kind="stable")
        order = order[: np.searchsorted(ranks[order], size)]
        starts = np.flatnonzero(np.append(True, np.diff(ranks[order]) != 0)) if len(order) else order
        buckets, begun, none = self.buckets, {}, order[:0]
        for rank, nodes in zip(ranks[order[starts]].tolist(), np.split(order, starts[1:])):
            begun[rank] = nodes
            used.add(rank)
        owner = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
        # the loop and the steps on many nodes share these
        token, rank_at, after, before = (array("i", x.tobytes()) for x in (ids, ranks, following, previous))
        alive, find = bytearray(b"\1") * n, pairs.get
        lists = Lists(*(np.frombuffer(x, np.int32) for x in (token, rank_at, after, before)), np.frombuffer(alive, np.uint8), owner)

        def put(rank: int, node: int) -> None:
            if buckets[rank]:
                buckets[rank].append(node)
            else:
                buckets[rank] = [node]
                used.add(rank)

        while (rank := used.first()) >= 0:
            used.drop(rank)
            bucket, buckets[rank] = buckets[rank] or [], None
            nodes = begun.pop(rank, none)
            if len(bucket) + len(nodes) < MANY:
                bucket += nodes.tolist()
            else:
                bucket = self._merge_many(lists, rank, np.concatenate([nodes, np.array(bucket, np.int64)]), put)
            bucket.sort()
            for k, node in enumerate(bucket, 1):
                if rank_at[node] != rank:
                    continue  # stale: merged away, or its pair is another one by now
                gone = after[node]
                right, left = after[gone], before[node]
                token[node], after[node] = rank, right
                alive[gone], rank_at[gone] = 0, size
                up = down = size
                if right >= 0:
                    before[right] = node
                    up = find(rank * size + token[right], size)
                    if up < size:
                        put(up, node)
                rank_at[node] = up
                if left >= 0:
                    rank_at[left] = down = find(token[left] * size + rank, size)
                    if down < size:
                        put(down, left)
                if up < rank or down < rank:
                    if k < len(bucket):
                        buckets[rank] = bucket[k:]
                        used.add(rank)
                    break
        keep = lists.alive.astype(bool)
        return lists.token[keep], np.cumsum(keep)[ends - 1]

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, or ``size``."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.size)

    def _merge_many(self, lists: Lists, rank: int, nodes: np.ndarray, put: Callable[[int, int], None]) -> list[int]:
        """Merges the nodes of a bucket at once, but for those of pre-tokens where their order matters; returns these."""
        token, rank_at, after, before, alive, owner = lists
        nodes = np.unique(nodes[rank_at[nodes] == rank])
        gone = after[nodes]
        right, left = after[gone], before[nodes]
        twice = self.pairs.get(rank * self.size + rank, self.size)
        alive[gone] = 0
        beside = (left >= 0) & (alive[left] == 0)  # the node before is merged away in this step
        down = np.where(left < 0, self.size, np.where(beside, twice, self._ranks_of(token[left], np.int64(rank))))
        up = np.where(right < 0, self.size, self._ranks_of(np.int32(rank), token[right]))
        ordered = (rank_at[gone] == rank) | (up < rank) | (down < rank)
        rest = []
        if ordered.any():
            slow = np.isin(owner[nodes], owner[nodes[ordered]])
            alive[gone[slow]] = 1
            rest = nodes[slow].tolist()
            nodes, gone, right, left, beside, down, up = (x[~slow] for x in (nodes, gone, right, left, beside, down, up))
        up = np.where((right >= 0) & (rank_at[right] == rank), twice, up)
        token[nodes], after[nodes], rank_at[gone] = rank, right, self.size
        before[right[right >= 0]] = nodes[right >= 0]
        rank_at[nodes] = up
        alone = (left >= 0) & ~beside
        left, down = left[alone], down[alone]
        rank_at[left] = down
        for new, at in ((up, nodes), (down, left)):
            some = new < self.size
            for q, node in zip(new[some].tolist(), at[some].tolist()):
                put(q, node)
        return rest

    def _ids_of(self, parts: list[str]) -> None:
        """Remembers the ids of pre-tokens: one id if the whole is a token, else by merges."""
        raw, rest = [x.encode() for x in parts], []
        for x, y in zip(parts, raw):
            one = self.whole.get(y)
            if one is not None:
                self.parts[x] = [one]
            elif y:
                rest.append((x, y))
        if rest:
            ends = np.cumsum(np.fromiter((len(y) for _, y in rest), np.int64, len(rest)))
            ids, counts = self.merged(np.frombuffer(b"".join(y for _, y in rest), np.uint8), ends)
            flat, at = ids.tolist(), 0
            for (x, _), to in zip(rest, counts.tolist()):
                self.parts[x] = flat[at:to]
                at = to

    def _learn(self, units: list[str]) -> None:
        """Pre-tokens are remembered in two generations, of which the older one goes when the younger is full."""
        if len(self.parts) > self.remembered // 2 or self.part_bytes > REMEMBERED_BYTES:
            self.old_parts, self.parts, self.part_bytes = self.parts, {}, 0
        on = gc.isenabled()
        gc.disable()  # many small lists are made and none of them is garbage
        try:
            cut = [self.split(x) for x in units]
            new = []
            for x in dict.fromkeys(chain.from_iterable(cut)):
                if x not in self.parts:
                    known = self.old_parts.get(x)
                    if known is None:
                        new.append(x)
                    else:
                        self.parts[x] = known
            self._ids_of(new)
            self.part_bytes += sum(map(len, new))
            self.turn = iter(cut)
            super()._learn(units)
            del self.turn
        finally:
            if on:
                gc.enable()

    def _ids(self, unit: str) -> list[int]:
        parts = next(self.turn)
        return self.parts[parts[0]] if len(parts) == 1 else [i for part in parts for i in self.parts[part]]


class Spelling:
    """A byte string for each id."""

    def __init__(self, names: list[bytes]):
        self.size = np.array([len(x) for x in names], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(names), np.uint8)

    def of(self, ids: np.ndarray, offs: np.ndarray, less: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Strings of lists of ids, one after the other, and their offsets; each that is not empty without its last ``less`` bytes."""
        size = self.size[ids]
        data = self.flat[ragged(self.start[ids], size)]
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])[offs]
        if less:
            full = np.diff(bounds) > 0
            keep = np.ones(len(data), bool)
            for k in range(1, less + 1):
                keep[bounds[1:][full] - k] = False
            data, bounds = data[keep], bounds - less * np.concatenate([np.zeros(1, np.int64), np.cumsum(full)])
        return data, bounds


def rank_queue(path: str) -> RankQueueEncoder:
    """The encoder of a file, which a Python worker keeps from task to task."""
    return held(("rank queue", path), lambda: RankQueueEncoder(path))


def round_trip(docs: DataFrame, tokenizer: str = "byte_bpe_multi_50k.tiktoken", ids_as: str = "array<int>") -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded): ids of every text, and the bytes decoded from them.

    docs: doc_id, text; other columns are ignored.  ids is an array of int or,
    with ids_as="decimal", the decimal ids joined by commas.  A null or empty
    text has no ids and decodes to no bytes.  Strings of special tokens are
    ordinary text.  Rows with a null doc_id are encoded like others, and repeated
    rows each get their row.  Texts and pre-tokens of any length are encoded whole.
    An empty table gives an empty one.  No row is shuffled.  Letters and digits are those of
    the installed ``regex``; code points of a newer Unicode may be cut elsewhere.
    """
    decimal = ids_as == "decimal"
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary() if decimal else pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = rank_queue(tokenizer)
        for batch, data, offs in slices(batches, most=SLICE_BYTES):
            ids, first = code.encode(data, offs)
            cells = binary_of(*code.decimal.of(ids, first, less=1)) if decimal else list_of(ids.astype(np.int32), first, pa.int32())
            yield table(schema, [batch.column(0), np.diff(first), cells, binary_of(*code.spelled.of(ids, first))])

    kind = "binary" if decimal else "array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run, keeps=True), f"doc_id long, n_tokens long, ids {kind}, decoded binary")
