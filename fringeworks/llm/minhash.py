"""Near-duplicates by min-max hashing of word shingles.

Each permutation of the shingles gives two values, its minimum and its maximum,
so a signature of 160 values takes 80 hash evaluations of a shingle.  Bands of
four values (two permutations) name buckets; documents that meet in a bucket
are candidates, and every candidate is confirmed on the full shingle sets.

Documents with equal sets are one member.  Each bucket has a hub, the member
that meets most others over all its buckets, so a group of near copies has the
same hub in most of them, and every member is compared with the hubs of its
buckets: a group costs a comparison or so for each member.  Two members x, y of
a bucket that are in different components after that have a hub h in common,
whose overlaps with them, i(x) and i(y), are known.  To be linked they need

- an overlap o(x, y) = ceil(percent / (100 + percent) * (n(x) + n(y))) of i(x)
  and of i(y) at least, or
- shingles in common that h does not have, the first of which is then among
  the first n - ceil(percent * n / 100) + 1 of such shingles of both, in any
  fixed order, with enough of them behind it to reach o(x, y) with i(x), i(y).

Both are joins on keys, with the hub and a class of sizes or with the hub and a
shingle, of the members outside the hub's component with the others.  Within the
joins the signatures of two members are looked at, a byte of each value: of linked
ones fewer agree than ``least_agreeing`` says with a probability of one in a
million, so only pairs that are linked or nearly so come out of the joins, and are
compared by their full sets.  Members of one hub that are not linked with it
are looked at pair by pair there, one class of sizes at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, stored
from ._text import U64, _WORD_BASE, list_of, lower_ascii, mix, prefix_hash, ragged, slices, span_hash, table, texts, window_hashes, word_hashes, words
from ._worker import tidy

SHINGLE_WORDS = 5
PERCENT = 75
BANDS = 40
#: Permutations for each band; each gives a minimum and a maximum.
PER_BAND = 2
#: Sizes of one class differ by a twentieth at most.
CLASS = 1.05

_SALT = U64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offs: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and the offset of each text's first (one more at the end)."""
    low = lower_ascii(data)
    start, end, first = words(low, offs)
    hashes = word_hashes(low, start, end)
    grams, at, begins = window_hashes(hashes, first, width)
    n = len(offs) - 1
    of = np.repeat(np.arange(n), np.diff(begins))
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):  # the whole sequence is the one shingle
        whole = span_hash(prefix_hash(hashes, _WORD_BASE), first[short], first[short + 1], _WORD_BASE)
        grams = np.append(grams, mix(whole + count[short].astype(U64) * _SALT))
        of = np.append(of, short)
    order = np.lexsort((grams, of)) if len(short) else np.argsort(mix(grams + of.astype(U64) * _SALT), kind="stable")
    if not len(short):  # equal shingles of a text stand together; the texts are then put in order
        order = order[np.argsort(of[order], kind="stable")]
    grams, of = grams[order], of[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])) if len(grams) else np.zeros(0, bool)
    grams, of = grams[new], of[new]
    return grams, np.searchsorted(of, np.arange(n + 1))


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, n + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)
    return a, mix(a)


def min_max(grams: np.ndarray, first: np.ndarray, permutations: int) -> np.ndarray:
    """(texts, 2 * permutations): minimum and maximum under each permutation; texts need a shingle."""
    out = np.empty((len(first) - 1, 2 * permutations), U64)
    value = np.empty_like(grams)
    for k, (a, b) in enumerate(zip(*multipliers(permutations), strict=True)):
        np.multiply(grams, a, out=value)
        value += b
        out[:, 2 * k] = np.minimum.reduceat(value, first[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(value, first[:-1])
    return out


def signatures(docs: DataFrame, width: int = SHINGLE_WORDS, bands: int = BANDS, per_band: int = PER_BAND) -> DataFrame:
    """Rows (doc_id, n_shingles, set_a, set_b, bands, sketch): size and 128-bit hash of the shingle set, its bands, and a byte of each value."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int8()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            grams, first = shingles(data, offs, width)
            n = len(offs) - 1
            size = np.diff(first)
            sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams ^ U64(s)), dtype=U64)]) for s in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35)]
            full = np.flatnonzero(size > 0)
            keys, sketch = np.zeros((len(full), bands), np.int64), np.zeros(0, np.int8)
            if len(full):
                values = min_max(grams, np.append(first[full], len(grams)), bands * per_band).reshape(len(full), bands, 2 * per_band)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * _SALT, keys.shape)
                for k in range(2 * per_band):
                    key = mix(key ^ values[:, :, k]) + U64(k)
                keys = key.view(np.int64)
                sketch = (mix(values.ravel()) >> U64(56)).astype(np.uint8).view(np.int8)
            yield table(schema, [batch.column(0), size, *((s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums), *(list_of(x.ravel(), np.concatenate([np.zeros(1, np.int64), np.cumsum((size > 0) * each)]), kind) for x, each, kind in ((keys, bands, pa.int64()), (sketch, 2 * per_band * bands, pa.int8())))])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<tinyint>")


def least_agreeing(values: int, percent: int = PERCENT) -> int:
    """How many of the values of two linked documents agree but for a probability of one in a million: 4.75 deviations below the mean."""
    share = percent / 100
    return math.floor(values * share - 4.75 * math.sqrt(values * share * (1 - share)))


def _agreeing(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, same: n + same)


def confirmed(pairs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """pairs: a, b, text_a, text_b.  Rows (a, b, na, nb, both, linked, rest).

    na, nb, both: sizes of the full sets and of their intersection; linked: 100 *
    both >= percent * union.  rest: the first of those shingles of b that a does
    not have, as many as a set linked with b must share one of.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("both", pa.int64()), ("linked", pa.bool_()), ("rest", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches, "text_b"):
            hubs, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            n = len(of)
            seen = np.zeros(len(hubs), np.int64)
            seen[of[::-1]] = np.arange(n)[::-1]
            left, la = shingles(*texts(batch.column(2).take(pa.array(seen))), width)
            right, rb = shingles(data, offs, width)
            na, nb = np.diff(la)[of], np.diff(rb)
            pair = np.concatenate([np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)])
            grams = np.concatenate([left[ragged(la[:-1][of], na)], right])
            order = np.argsort(mix(grams + pair.astype(U64) * _SALT), kind="stable")
            same = (grams[order][1:] == grams[order][:-1]) & (pair[order][1:] == pair[order][:-1])
            both = np.bincount(pair[order][1:][same], minlength=n)
            shared = np.zeros(len(grams), bool)
            shared[order[1:][same]] = True
            mine = np.flatnonzero(~shared[len(grams) - len(right) :])
            rest, row = right[mine], np.repeat(np.arange(n), nb)[mine]
            order = np.lexsort((rest, row))
            rest, row = rest[order], row[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            few = place < (nb - -(-percent * nb // 100) + 1)[row]
            yield table(schema, [batch.column(0), batch.column(1), na, nb, both, 100 * both >= percent * (na + nb - both), list_of(rest[few].view(np.int64), np.searchsorted(row[few], np.arange(n + 1)), pa.int64())])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long, na long, nb long, both long, linked boolean, rest array<long>")


def with_texts(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs (a, b) with the texts of both; held: doc_id, text."""
    right = pairs.join(held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return right.join(held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")


def smallest_reachable(links: DataFrame) -> DataFrame:
    """(node, root) for every end of a link (a, b): the smallest node of its component.

    Smallest labels travel along the links and then along the labels
    themselves, so the number of rounds grows with the logarithm of a
    component's diameter.
    """
    edges = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "edges")
    state = stored(edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near")).select("node", F.least("node", "near").alias("root")), "roots")
    while True:
        near = edges.join(state.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        step = state.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        moved = stored(step.join(jump, "next").select("node", F.least("next", "further").alias("root"), (F.least("next", "further") < F.col("root")).alias("moved")), "roots")
        discard(state)
        state = moved
        if not moved.filter("moved").take(1):
            discard(edges)
            return moved.select("node", "root")


def _class_of(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(CLASS)))


def undecided_pairs(compared: DataFrame, roots: DataFrame, sketches: DataFrame, percent: int, values: int) -> DataFrame:
    """Pairs (a, b) that share a hub, are in different components, and may be linked for all that is known.

    compared: what ``confirmed`` gives for pairs of a hub a and a member b.
    sketches: doc, sketch, with a byte of each of so many values.
    """
    label = F.coalesce("root", "b")
    members = compared.join(roots.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("hub"), F.col("b").alias("doc"), F.col("nb").alias("n"), F.col("both").alias("i"), label.alias("label"), "rest", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("likeness"))
    counts = members.groupBy("hub", "label").agg(F.count("*").alias("members"))
    several = counts.groupBy("hub").agg(F.count("*").alias("labels"), F.max_by("label", F.struct("members", -F.col("label"))).alias("main")).filter("labels > 1").select("hub", "main")
    # two members whose likest hub is the same one are decided there
    home = members.groupBy("doc").agg(F.max_by("hub", F.struct("likeness", -F.col("hub"))).alias("home"))
    open_ = stored(members.drop("likeness").join(several, "hub").join(home, "doc"), "open")
    light = open_.drop("rest").join(sketches, "doc")
    alike = _agreeing(F.col("sketch"), F.col("sketch_y")) >= least_agreeing(values, percent)
    other = lambda df: df.select(*(F.col(c).alias({"hub": "of"}.get(c, c) if c in ("hub", "class", "gram") else f"{c}_y") for c in df.columns if c != "main"))
    once = (F.col("label_y") == F.col("main")) | (F.col("doc") < F.col("doc_y"))
    here = (F.col("label") != F.col("label_y")) & once & ((F.col("home") != F.col("home_y")) | (F.col("home") == F.col("hub")))
    near = F.least("n", "n_y") * 100 >= F.greatest("n", "n_y") * percent
    pair = [F.least("doc", "doc_y").alias("a"), F.greatest("doc", "doc_y").alias("b")]

    # within the hub: an overlap that both have with it
    enough = lambda n, m, i: (100 + percent) * i >= percent * (n + m)
    least = F.ceil(F.col("n") * percent / 100)
    sized = light.filter(enough(F.col("n"), least, F.col("i"))).withColumn("class", _class_of(F.col("n")))
    reach = F.sequence(_class_of(least) - 1, _class_of(F.col("n") * 100 / percent) + 1)
    minor = sized.filter("label <> main").withColumn("class", F.explode(reach))
    minor = minor.filter(enough(F.col("n"), F.floor(F.pow(F.lit(CLASS), F.col("class"))) - 1, F.col("i")))
    y = other(sized).withColumnRenamed("class", "class_y")
    inner = minor.join(y, (F.col("hub") == F.col("of")) & (F.col("class") == F.col("class_y")) & here & near & enough(F.col("n"), F.col("n_y"), F.least("i", "i_y")) & alike).select(*pair)

    # beyond the hub: one of the first shingles that it lacks; the first one in common leaves ``left`` more at most
    grams = open_.select("hub", "doc", "n", "i", "label", "main", "home", F.posexplode("rest").alias("place", "gram")).withColumn("left", F.col("n") - F.col("i") - F.col("place") - 1).drop("place")
    common = grams.groupBy("hub", "gram").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.min("home").alias("h"), F.max("home").alias("k")).filter("p < q and (h < k or h = hub)").select("hub", "gram")
    grams = grams.join(common, ["hub", "gram"], "left_semi").join(sketches, "doc")
    y = other(grams).withColumnRenamed("gram", "gram_y")
    possible = enough(F.col("n"), F.col("n_y"), F.least("i", "i_y") + 1 + F.least("left", "left_y"))
    outer = grams.filter("label <> main").join(y, (F.col("hub") == F.col("of")) & (F.col("gram") == F.col("gram_y")) & here & near & possible & alike).select(*pair)
    return inner.union(outer).distinct()


def components(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    docs: doc_id, text; other columns are ignored.  Linked documents and those
    with equal shingle sets form components, named by their smallest doc_id; kept
    marks that document.  A text without words, or null, is linked with nothing.
    Rows with a null doc_id get a null component and are not kept.  Repeated rows
    of a doc_id each get their row; should their texts differ in their shingles,
    the greatest text stands for the document.  Texts of any length are compared
    whole.  An empty table gives an empty one.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    keys = ["n_shingles", "set_a", "set_b"]
    signed = stored(signatures(plain, width, bands), "signatures")
    light = signed.drop("bands", "sketch")
    one = light.filter("doc_id is not null").groupBy("doc_id").agg(*(f(c).alias(f"{c}_{k}") for c in keys for k, f in (("p", F.min), ("q", F.max))))
    if one.filter(" or ".join(f"{c}_p < {c}_q" for c in keys)).take(1):  # one doc_id, several texts
        whole = components(plain.filter("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text")), width, percent, bands)
        return light.select("doc_id", "n_shingles").join(whole.drop("n_shingles"), "doc_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    full = signed.filter("n_shingles > 0 and doc_id is not null")
    sets = stored(full.groupBy(*keys).agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sets")
    each = sets.select("doc_id", F.explode("bands").alias("bucket"))
    sizes = each.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    met = stored(each.join(sizes, "bucket"), "buckets")
    weight = met.groupBy("doc_id").agg(F.sum("members").alias("weight"))
    hubs = met.join(weight, "doc_id").groupBy("bucket").agg(F.max_by("doc_id", F.struct("weight", -F.col("doc_id"))).alias("hub"))
    pairs = met.select("bucket", "doc_id").join(hubs, "bucket").filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    held = stored(plain.join(met.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    compared = stored(confirmed(with_texts(pairs, held), width, percent), "compared")
    roots = smallest_reachable(compared.filter("linked"))
    sketches = sets.select(F.col("doc_id").alias("doc"), "sketch")
    more = stored(undecided_pairs(compared, roots, sketches, percent, 2 * PER_BAND * bands), "undecided")
    links = compared.filter("linked").select("a", "b")
    if more.take(1):
        found = stored(confirmed(with_texts(more, held), width, percent).filter("linked").select("a", "b"), "found")
        if found.take(1):
            roots = smallest_reachable(links.union(found))
    discard(met, held, compared)
    named = sets.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select(*keys, F.coalesce("root", "doc_id").alias("component"), "doc_id", "last")
    named = named.filter("component <> doc_id or doc_id <> last").drop("doc_id", "last")
    out = light.filter("n_shingles > 0 and doc_id is not null").join(named, keys, "left")
    out = out.unionByName(light.filter("n_shingles = 0 or doc_id is null").withColumn("component", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))
