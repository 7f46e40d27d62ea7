"""Exact removal of repeated byte strings by sorting suffixes.

Any ``width`` bytes hold an anchor: the start of the short string (a gram) whose
hash is smallest within them, the first of equal ones.  Equal strings have equal
anchors at the same place, so only suffixes that begin at anchors of equal grams
are compared, about one in 185 for strings of 400 bytes.  The surroundings of an
anchor are the bytes of the strings whose anchor it is.

Anchors with equal grams and surroundings form a class; the 64-bit hashes of both
must be equal, and members of a class are not compared byte by byte.
Of a window around an anchor half its bytes at least stand before the anchor or
from it on, so a class matters to others only if they share that half; of those
classes one surrounding each goes to a task that
sorts the suffixes to the right and those to the left of the anchors: merge sort,
where two suffixes are compared by their common extension, found by binary
search over hashes of prefixes.  Common extensions of neighbours are verified
byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from ._text import _BYTE, U64, binary_of, byte_prefix, list_of, mix, powers, ragged, runs, slices, slide, span_hash, table
from ._worker import tidy

WIDTH = 400
GRAM = 32
#: One gram in so many is looked at first when anchors are sought.
FEW = 16
#: Classes of one gram that a task sorts at most, which bounds its memory; those of a gram with more are spread over all tasks
#: by the hashes of their windows, with the same result.
SORTED_CLASSES = 32768
#: Classes that a task sorts together, unless one gram has more.
TOGETHER = 2048
BUCKETS = 8

_TOP = U64(0xFFFFFFFFFFFFFFFF)


def anchors(data: np.ndarray, offs: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Positions of the anchors, numbers of bytes of their surroundings before and from them, hashes of their grams, and prefix hashes of the data.

    A window nearly always holds grams whose hashes are in the lowest FEW-th of
    all, and then one of those is its anchor; so only they are looked at.  Texts
    with a window that holds none are gone through whole.
    """
    prefix = byte_prefix(data)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none, np.zeros(0, U64), prefix
    hashes = _gram_hashes(prefix, gram)
    low = np.flatnonzero(hashes < _TOP // U64(2 * FEW))
    text = np.searchsorted(offs, low, "right") - 1
    inside = low + gram <= offs[text + 1]
    low, text = low[inside], text[inside]
    small = hashes[low]
    # windows that begin between two of these places hold the same of the low grams
    reach = width - gram + 1
    long_ = np.flatnonzero(np.diff(offs) >= width)
    enters, leaves = low - reach + 1, low + 1
    start = np.unique(np.concatenate([offs[long_], enters[enters >= offs[text]], leaves[leaves + width <= offs[text + 1]]]))
    of = np.searchsorted(offs, start, "right") - 1
    lo, hi = np.searchsorted(low, start), np.searchsorted(low, start + reach)
    bare = np.unique(of[lo == hi])
    if len(bare):
        kept = ~np.isin(of, bare)
        start, of, lo, hi = start[kept], of[kept], lo[kept], hi[kept]
    best = _first_of_least(small, lo, hi)
    first = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (of[1:] != of[:-1]))) if len(best) else none
    pos, begin = low[best[first]], start[first]
    end = offs[of[first] + 1] - width  # the last window of each anchor: the one before the next anchor's first, or the text's
    same = of[first[1:]] == of[first[:-1]]
    end[:-1][same] = begin[1:][same] - 1
    before, after = pos - begin, end + width - pos
    if len(bare):
        size = np.diff(offs)[bare]
        own = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        at, b, a = _anchors_of_all(data[ragged(offs[bare], size)], own, width, gram)
        at += np.repeat(offs[bare] - own[:-1], np.diff(np.searchsorted(at, own)))
        pos, before, after = np.concatenate([pos, at]), np.concatenate([before, b]), np.concatenate([after, a])
        order = np.argsort(pos)
        pos, before, after = pos[order], before[order], after[order]
    return pos, before, after, hashes[pos], prefix


def _gram_hashes(prefix: np.ndarray, gram: int) -> np.ndarray:
    """Hashes, below 2**63, of the grams at all positions."""
    n = len(prefix) - gram
    return mix((prefix[gram:] - prefix[:-gram]) * powers(len(prefix))[1][:n]) >> U64(1)


def _first_of_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each range lo..hi (not empty) the index of its least value, the first of equal ones."""
    if not len(lo):
        return lo
    level = np.frexp((hi - lo).astype(float))[1] - 1  # 2**level values fit in the range
    best = np.empty_like(lo)
    least = np.arange(len(values))  # of 2**k values from each place on
    for k in range(int(level.max()) + 1):
        mine = np.flatnonzero(level == k)
        x, y = least[lo[mine]], least[hi[mine] - (1 << k)]
        best[mine] = np.where(values[x] <= values[y], x, y)
        x, y = least[: -(1 << k)], least[1 << k :]
        least = np.where(values[x] <= values[y], x, y)
    return best


def _anchors_of_all(data: np.ndarray, offs: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and surroundings of the anchors among all grams; every text has ``width`` bytes or more."""
    reach = width - gram + 1
    hashes = _gram_hashes(byte_prefix(data), gram)
    at = np.arange(len(hashes))
    end = np.repeat(offs[1:], np.diff(offs))  # of each position's text
    hashes[at + gram > end[at]] = _TOP
    least = slide(hashes, reach, np.minimum, _TOP)
    window = at[: len(data) - width + 1]
    window = window[window + width <= end[window]]
    least = least[window]
    # a window's anchor: the first of its positions with its least hash, looked for among all positions that are one's
    some = np.unique(_first_least(hashes, window, least, reach))
    chosen = np.searchsorted(some, window)
    while (behind := np.flatnonzero(hashes[some[chosen]] != least)).size:
        chosen[behind] += 1
    text = np.searchsorted(offs, window, "right") - 1
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(chosen)) - 1
    pos = some[chosen[first]]
    return pos, pos - window[first], window[last] + width - pos


def _first_least(hashes: np.ndarray, window: np.ndarray, least: np.ndarray, reach: int) -> np.ndarray:
    """Positions that have the least hash of a window that holds them."""
    low = np.zeros(len(hashes), U64)
    low[window] = least
    best = slide(low[::-1], reach, np.maximum, U64(0))[::-1]
    return np.flatnonzero((best == hashes) & (hashes != _TOP) & (best > 0))


class Suffixes:
    """Surroundings of anchors in one array: point[i] is where the i-th anchor stands."""

    def __init__(self, around: list[bytes], left: np.ndarray, group: np.ndarray, salt: int = 0):
        self.data = np.frombuffer(b"".join(around) or b"\0", np.uint8)
        size = np.fromiter(map(len, around), np.int64, len(around))
        self.left, self.right = left.astype(np.int64), size - left
        self.point = np.cumsum(size) - size + left
        self.group = group
        values = _BYTE[self.data]
        if salt:
            values = mix(values + U64(salt))
        # powers count from the start of each surrounding, so few are needed
        self.start = self.point - left
        up, self.down = powers(int(size.max(initial=0)) + 1)
        if len(size):
            values *= up[np.arange(len(values), dtype=np.int32) - np.repeat(self.start.astype(np.int32), size)]
        self.prefix = np.zeros(len(values) + 1, U64)
        np.cumsum(values, out=self.prefix[1:])

    def hashes(self, rows: np.ndarray, begin: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.prefix[begin + size] - self.prefix[begin]) * self.down[begin - self.start[rows]]

    def equal(self, side: int, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Are the n bytes from (side 1) or before (side -1) two anchors equal, by their hashes?"""
        back = 0 if side > 0 else n
        return self.hashes(i, self.point[i] - back, n) == self.hashes(j, self.point[j] - back, n)

    def common(self, side: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of two anchors, by binary search."""
        room = self.right if side > 0 else self.left
        lo, hi = np.zeros(len(i), np.int64), np.minimum(room[i], room[j])
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) // 2
            same = self.equal(side, i, j, mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, side: int, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Does suffix i come before suffix j; equal ones as ``ties`` says?"""
        n = self.common(side, i, j)
        room = self.right if side > 0 else self.left
        last = len(self.data) - 1
        step = (lambda k: self.point[k] + n) if side > 0 else (lambda k: self.point[k] - n - 1)
        a = np.where(n < room[i], self.data[np.clip(step(i), 0, last)].astype(np.int64), -1)
        b = np.where(n < room[j], self.data[np.clip(step(j), 0, last)].astype(np.int64), -1)
        return np.where(a == b, ties, a < b)

    def order(self, side: int) -> np.ndarray:
        """Merge sort of the suffixes of every group at once; groups are contiguous.

        At each level every suffix finds by binary search how many of its
        neighbouring run come before it, which gives its place in the merged run.
        """
        n = len(self.point)
        begin = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1]))
        sizes = np.diff(np.append(begin, n))
        start, stop = np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)
        order, within = np.arange(n), np.arange(n) - start
        level = 0
        while (1 << level) < sizes.max(initial=0):
            block = within >> level
            lo = np.minimum(start + ((block ^ 1) << level), stop)
            hi = np.minimum(lo + (1 << level), stop)
            active = np.flatnonzero(lo < hi)
            rank = np.zeros(n, np.int64)
            a, b = lo[active], hi[active]
            item, later = order[active], (block[active] & 1) == 1
            while (open_ := np.flatnonzero(a < b)).size:
                mid = (a[open_] + b[open_]) // 2
                # an equal suffix of the earlier run stays in front
                less = self.before(side, order[mid], item[open_], later[open_])
                a[open_] = np.where(less, mid + 1, a[open_])
                b[open_] = np.where(less, b[open_], mid)
            rank[active] = a - lo[active]
            place = start + ((block >> 1) << (level + 1)) + (within & ((1 << level) - 1)) + rank
            merged = np.empty_like(order)
            merged[place] = order
            order, level = merged, level + 1
        return order

    def verified(self, side: int, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> bool:
        """Are the common extensions right, byte by byte?"""
        for part in np.array_split(np.arange(len(i)), 1 + len(i) // 4096):
            lo = 0 if side > 0 else n[part]
            x = ragged(self.point[i[part]] - lo, n[part])
            y = ragged(self.point[j[part]] - lo, n[part])
            if not np.array_equal(self.data[x], self.data[y]):
                return False
        return True


def extents(around: list[bytes], left: np.ndarray, group: np.ndarray, several: np.ndarray, width: int) -> np.ndarray:
    """For each class the bytes before and from its anchor that repeated windows cover, or -1, -1.

    Groups are contiguous; ``several`` marks classes of more than one anchor.
    """
    for salt in range(8):
        s = Suffixes(around, left, group, salt)
        n = len(s.point)
        seen, sides_ok = [], True
        most = {}
        for side in (1, -1):
            order = s.order(side)
            x, y = order[:-1], order[1:]
            same = group[x] == group[y]
            x, y = x[same], y[same]
            common = s.common(side, x, y)
            sides_ok &= s.verified(side, x, y, common)
            top = np.zeros(n, np.int64)
            np.maximum.at(top, x, common)
            np.maximum.at(top, y, common)
            most[side] = top
            seen += [(x, y), (y, x)]
        if sides_ok:
            break
    else:
        raise ValueError("hashes of different strings stay equal")
    before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    for x, y in seen:
        l, r = s.common(-1, x, y), s.common(1, x, y)
        enough = l + r >= width
        np.maximum.at(before, x[enough], l[enough])
        np.maximum.at(after, x[enough], r[enough])
    before[several], after[several] = s.left[several], s.right[several]
    possible = most[1] + most[-1] >= width
    settled = several | ~possible | ((before == most[-1]) & (after == most[1]))
    if not settled.all():
        # neighbours do not bound these: try the windows themselves, one offset after the other
        rows = np.flatnonzero(np.isin(group, np.unique(group[~settled])))
        low, high = _repeated_offsets(s, rows, width)
        hit = high >= 0
        mine = rows[hit]
        before[mine] = np.maximum(before[mine], high[hit])
        after[mine] = np.maximum(after[mine], width - low[hit])
    return np.stack([before, after], axis=1)


def _repeated_offsets(s: Suffixes, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes before the anchor of a window that two of these classes share, or -1."""
    low, high = np.full(len(rows), -1), np.full(len(rows), -1)
    for a in range(int(s.left[rows].max(initial=0)) + 1):
        fit = np.flatnonzero((s.left[rows] >= a) & (s.right[rows] >= width - a))
        if len(fit) < 2:
            continue
        h = mix(s.hashes(rows[fit], s.point[rows[fit]] - a, width) + s.group[rows[fit]].astype(U64) * U64(0x9E3779B97F4A7C15))
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        hit = fit[count[back] > 1]
        low[hit] = np.where(low[hit] < 0, a, low[hit])
        high[hit] = a
    return low, high


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, start, end), in bytes: repeated strings of ``width`` bytes and more, overlapping each other."""
    spark = docs.sparkSession
    found = pa.schema([("doc_id", pa.int64()), ("anchors", pa.list_(pa.struct([("pos", pa.int32()), ("gram", pa.int64()), ("around", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16()), ("ahead", pa.int64()), ("behind", pa.int64())])))])
    half = (width + 1) // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            pos, lo, hi, grams, prefix = anchors(data, offs, width, gram)
            around = mix(mix(span_hash(prefix, pos - lo, pos + hi) + lo.astype(U64)) + hi.astype(U64))
            # the half of a window from the anchor on, and the half before it with the gram; null where the text has less
            ahead = pa.array(mix(span_hash(prefix, pos, np.minimum(pos + half, len(data)))).view(np.int64), mask=hi < half)
            behind = pa.array(mix(span_hash(prefix, np.maximum(pos - half, 0), pos + (gram if len(pos) else 0))).view(np.int64), mask=lo < half)
            first = np.searchsorted(pos, offs)
            cells = pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip([pos - offs[np.searchsorted(offs, pos, "right") - 1], grams.view(np.int64), around.view(np.int64), lo, hi, ahead, behind], found.field(1).type.value_type, strict=True)], fields=list(found.field(1).type.value_type))
            full = np.flatnonzero(np.diff(first))
            yield table(found, [batch.column(0).take(pa.array(full)), pa.ListArray.from_arrays(pa.array(np.append(first[full], len(pos)).astype(np.int32)), cells)])

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    kind = "doc_id long, anchors array<struct<pos:int,gram:long,around:long,lo:short,hi:short,ahead:long,behind:long>>"
    light = stored(plain.filter("doc_id is not null").mapInArrow(tidy(find), kind), "anchors").select("doc_id", F.explode("anchors").alias("x")).select("doc_id", "x.*")
    sized = light.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "lo", "hi")).alias("one"), F.min("ahead").alias("ahead"), F.min("behind").alias("behind"))
    grams = sized.groupBy("gram").agg(F.sum("n").alias("all"), F.count("*").alias("classes")).filter("all > 1")
    classes = stored(sized.join(grams.select("gram", "classes"), "gram").select("gram", "around", "n", "classes", "one.*", "ahead", "behind"), "classes")
    # classes that share half a window with another class
    multiple = classes.filter("classes > 1")
    columns = ["gram", "around", "n", "doc_id", "pos", "lo", "hi"]

    def with_others(half: str) -> DataFrame:
        whole = multiple.filter(F.col(half).isNotNull())  # a text may end before the half does
        shared = whole.groupBy(half).agg(F.count("*").alias("sharing")).filter("sharing > 1").select(half)
        return whole.join(shared, half, "left_semi").select(*columns)

    sharing = with_others("ahead").union(with_others("behind")).distinct()
    again = sharing.groupBy("gram").agg(F.count("*").alias("classes")).filter("classes > 1")
    compared = stored(sharing.join(again, "gram"), "compared")

    # one surrounding of each
    wanted = compared.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "gram", "around", "n", "classes", "lo", "hi")).alias("wanted"))
    shown = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("several", pa.bool_()), ("classes", pa.int64()), ("lo", pa.int32()), ("bytes", pa.binary())])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            lists = batch.column(2)
            x = lists.flatten()
            get = lambda k: x.field(k).to_numpy(zero_copy_only=False)
            pos = np.repeat(offs[:-1], lists.value_lengths().to_numpy().astype(np.int64)) + get(0)
            lo, hi = get(5).astype(np.int64), get(6).astype(np.int64)
            size = lo + hi
            yield table(shown, [x.field(1), x.field(2), get(3) > 1, x.field(4), lo.astype(np.int32), binary_of(data[ragged(pos - lo, size)], np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]))])

    texts = plain.join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "wanted")
    contexts = texts.mapInArrow(tidy(show), "gram long, around long, several boolean, classes long, lo int, bytes binary")
    out = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("before", pa.int32()), ("after", pa.int32())])
    result = "gram long, around long, before int, after int"

    def sort(rows: pa.Table) -> pa.Table:
        rows = rows.select(["gram", "around", "several", "lo", "bytes"]).sort_by([("gram", "ascending"), ("around", "ascending")])
        gram_, around_, lo = (rows.column(k).to_numpy() for k in ("gram", "around", "lo"))
        new = np.append(True, (gram_[1:] != gram_[:-1]) | (around_[1:] != around_[:-1])) if len(gram_) else np.zeros(0, bool)
        rows = rows.filter(pa.array(new))  # repeated rows of a document show a class twice
        gram_, around_, lo = gram_[new], around_[new], lo[new]
        several, done, at = rows.column("several").to_numpy(), [], 0
        group = np.cumsum(np.append(True, gram_[1:] != gram_[:-1])) - 1
        while at < len(gram_):
            to = int(np.searchsorted(group, group[min(at + TOGETHER, len(group) - 1)], "left"))
            to = to if to > at else int(np.searchsorted(group, group[at], "right"))
            if at + TOGETHER >= len(group):
                to = len(group)
            done.append(extents(rows.column("bytes").slice(at, to - at).to_pylist(), lo[at:to], group[at:to], several[at:to], width))
            at = to
        both = np.concatenate(done) if done else np.zeros((0, 2), np.int64)
        hit = both[:, 0] >= 0
        return pa.Table.from_batches([table(out, [gram_[hit], around_[hit], both[hit, 0].astype(np.int32), both[hit, 1].astype(np.int32)])])

    buckets = max(BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), compared.count() // TOGETHER)
    sortable = contexts.filter(F.col("classes") <= SORTED_CLASSES).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    sorted_ = sortable.groupBy("bucket").applyInArrow(sort, result)
    hot = _hot_extents(contexts.filter(F.col("classes") > SORTED_CLASSES), width, buckets)
    # anchors of one class share all that windows around them can hold
    alone = classes.filter("n > 1").select("gram", "around", F.col("lo").cast("int").alias("before"), F.col("hi").cast("int").alias("after"))
    extent = alone.union(sorted_).union(hot)  # a class of several anchors can be in two of these
    spans = light.join(extent, ["gram", "around"])
    return spans.select("doc_id", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("end"))


def _hot_extents(contexts: DataFrame, width: int, buckets: int) -> DataFrame:
    """Extents for grams of very many classes: hashes of their windows, packed into buckets and counted there.

    Nothing of a gram meets in one task but equal windows' hashes, one for each class.
    """
    packed = pa.schema([("bucket", pa.int32()), ("gram", pa.int64()), ("around", pa.int64()), ("offsets", pa.list_(pa.int16())), ("hashes", pa.list_(pa.int64()))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram_, around_, several, _, lo, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = len(data)
                begin = np.arange(0, size - width + 1)
                offsets = (lo - begin).astype(np.int16)
                if several:  # all its windows are repeated, and so are others' equal ones
                    begin, offsets = np.concatenate([begin, begin]), np.concatenate([offsets, offsets])
                raw = np.frombuffer(data, np.uint8)
                h = mix(span_hash(byte_prefix(raw), begin, begin + width) + offsets.astype(np.int64).view(U64) + U64(gram_ & (2**64 - 1)))
                of = (h % U64(buckets)).astype(np.int32)
                order = np.argsort(of, kind="stable")
                rows = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
                ends = np.append(rows, len(order))
                yield table(packed, [of[order][rows], np.full(len(rows), gram_), np.full(len(rows), around_), list_of(offsets[order], ends, pa.int16()), list_of(h[order].view(np.int64), ends, pa.int64())])

    out = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def count(rows: pa.Table) -> pa.Table:
        hashes = np.concatenate([c.flatten().to_numpy() for c in rows.column("hashes").chunks])
        offsets = np.concatenate([c.flatten().to_numpy() for c in rows.column("offsets").chunks])
        row = np.repeat(np.arange(rows.num_rows), rows.column("offsets").combine_chunks().value_lengths().to_numpy())
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        hit = np.zeros(len(hashes), bool)
        hit[order[1:]] = same
        hit[order[:-1]] |= same
        low, high = np.full(rows.num_rows, 1 << 20), np.full(rows.num_rows, -1)
        np.minimum.at(low, row[hit], offsets[hit])
        np.maximum.at(high, row[hit], offsets[hit])
        some = np.flatnonzero(high >= 0)
        return pa.Table.from_batches([table(out, [rows.column("gram").to_numpy()[some], rows.column("around").to_numpy()[some], low[some].astype(np.int32), high[some].astype(np.int32)])])

    rows = contexts.mapInArrow(tidy(spread), "bucket int, gram long, around long, offsets array<short>, hashes array<long>")
    found = rows.groupBy("bucket").applyInArrow(count, "gram long, around long, low int, high int")
    return found.groupBy("gram", "around").agg(F.max("high").alias("before"), (F.lit(width) - F.min("low")).cast("int").alias("after"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Rows (doc_id, n_bytes, spans, kept) for every document: its UTF-8 bytes without the repeated strings.

    spans: maximal removed runs of bytes, as structs (start, end).  kept: binary.

    docs: doc_id, text; other columns are ignored.  A null or empty text, or one
    shorter than ``width`` bytes, keeps all it has.  Rows with a null doc_id are
    returned whole and never compared.  Repeated rows of one doc_id are copies of
    each other; should their texts differ, each loses the spans of all.  An empty
    table gives an empty one.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    spans = repeated_spans(docs, width, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("hits"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            hits = batch.column(2)
            x = hits.flatten()
            of = np.repeat(np.arange(len(offs) - 1), np.nan_to_num(hits.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64))
            change = np.zeros(len(data) + 1, np.int32)
            begin, end = (np.minimum(offs[of] + x.field(k).to_numpy(zero_copy_only=False), offs[of + 1]) for k in (0, 1))
            np.add.at(change, begin, 1)
            np.add.at(change, end, -1)
            gone = np.cumsum(change)[: len(data)] > 0
            a, b = runs(gone, offs)
            of = np.searchsorted(offs, a, "right") - 1
            cells = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(offs))).astype(np.int32)), pa.StructArray.from_arrays([pa.array((a - offs[of]).astype(np.int32)), pa.array((b - offs[of]).astype(np.int32))], ["start", "end"]))
            kept = np.concatenate([np.zeros(1, np.int64), np.cumsum(~gone)])[offs]
            yield table(schema, [batch.column(0), np.diff(offs), cells, binary_of(data[~gone], kept)])

    joined = plain.join(spans.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "hits")
    return joined.mapInArrow(tidy(cut), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
