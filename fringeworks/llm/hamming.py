"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into m segments and indexed by (segment, value): a row of
the index holds the codes of a value in an array, and a value of very many codes
has several rows.  A query probes all values within radius 0 of its segments,
then 1, and so on, one segment after the other.  After radius r in segments 0 to
j every code within distance m * r + j has been met, for it differs in r bits at
most in one of these segments or in r - 1 in another; a query ends once its k-th
verified distance is within that.  Codes are verified inside the row: of an
array only those no farther than the k-th so far, and of these the k nearest,
leave it.
"""

from __future__ import annotations

from math import comb, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, stored

BITS = 64
K = 10
#: Codes of a value on average, and of a row of the index at most or so.
MEAN = 32
CHUNK = 256
#: Values that a query probes in one step, unless one segment has more.
PROBES = 128


def sign_code(embedding: Column) -> Column:
    """Signs of 64 numbers as one long: bit i is set if number i is above 0.

    Numbers beyond the 64th are added to the one 64 places before them; missing
    and null ones count as 0.
    """
    folded = lambda i: F.aggregate(F.filter(embedding, lambda x, k: k % BITS == i), F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    value = lambda i: F.when(F.size(embedding) > BITS, folded(i)).otherwise(F.coalesce(F.get(embedding, i).cast("double"), F.lit(0.0)))
    bit = lambda i: F.call_function("shiftleft", F.when(value(i) > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), i)
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda code, i: code.bitwiseOR(bit(i)))


def segments(rows: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment: as many bits as give a value MEAN codes, however many rows there are."""
    bits = max(4, min(26, int(log2(max(1, rows / MEAN)))))
    m = -(-BITS // bits)
    sizes = [BITS // m + (i < BITS % m) for i in range(m)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def steps(cut: list[tuple[int, int]], probes: int = PROBES) -> list[list[tuple[int, int]]]:
    """(radius, segment) in order, in runs of about ``probes`` values."""
    out: list[list[tuple[int, int]]] = []
    held = probes
    for radius in range(max(n for _, n in cut) + 1):
        for j, (_, bits) in enumerate(cut):
            if radius > bits:
                continue
            size = comb(bits, radius)
            if held + size > probes:
                out.append([])
                held = 0
            out[-1].append((radius, j))
            held += size
    return out


def part(code: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _key(segment: int, value: Column) -> Column:
    """(segment, value) in one number; values have 26 bits at most."""
    return F.lit(segment << 40).bitwiseOR(value)


def packed_index(codes: DataFrame, cut: list[tuple[int, int]]) -> DataFrame:
    """(key, codes): arrays of about CHUNK codes at most.  codes: code, least, size."""
    entries = codes.select(F.explode(F.array(*(_key(j, part(F.col("code"), *s)) for j, s in enumerate(cut)))).alias("key"), "code", "least", "size")
    many = entries.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > CHUNK)
    rows = F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1)).cast("long")
    dealt = entries.join(many, "key", "left").withColumn("row", F.pmod(F.xxhash64("code"), rows)).repartition("key", "row")
    return dealt.groupBy("key", "row").agg(F.collect_list(F.struct("code", "least", "size")).alias("codes")).drop("row")


def probed(open_: DataFrame, cut: list[tuple[int, int]], step: list[tuple[int, int]]) -> DataFrame:
    """(query, kth, key): the values that a step looks at.  open_: query, kth."""
    out: DataFrame | None = None
    for radius, j in step:
        shift, bits = cut[j]
        # one changed bit after the other, each above the last: the tasks make the masks, whose number the plan does not hold
        keys = open_.select("query", "kth", part(F.col("query"), shift, bits).alias("value"), F.lit(-1).alias("bit"))
        for i in range(radius):
            keys = keys.select("query", "kth", "value", F.explode(F.sequence(F.col("bit") + 1, F.lit(bits - radius + i))).alias("bit"))
            keys = keys.withColumn("value", F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))))
        keys = keys.select("query", "kth", _key(j, F.col("value")).alias("key"))
        out = keys if out is None else out.union(keys)
    return out


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Rows (query_id, rank, vec_id, distance): the k nearest rows of each query, ties by vec_id.

    embeddings and queries: vec_id, embedding; other columns are ignored.  Rows
    with a null embedding or vec_id are neither found nor asked for.  A query that
    is a row itself finds itself.  Repeated rows count as often as they occur in
    the table; a repeated query is asked once.  Fewer than k rows are all found.
    Empty tables give an empty one.
    """
    coded = lambda df: df.filter("vec_id is not null and embedding is not null").select("vec_id", sign_code(F.col("embedding")).alias("code"))
    rows = stored(coded(embeddings), "codes")
    total = rows.count()
    need = min(k, total)
    asked = stored(coded(queries).select("vec_id", "code").distinct(), "asked")
    if not need:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).alias("distance")).limit(0)
    # of equal codes only the k smallest ids can be among any k nearest
    by_code = Window.partitionBy("code").orderBy("vec_id")
    ids = stored(rows.withColumn("place", F.row_number().over(by_code)).filter(F.col("place") <= k).drop("place"), "ids")
    codes = stored(ids.groupBy("code").agg(F.min("vec_id").alias("least"), F.count("*").alias("size")), "distinct-codes")
    cut = segments(codes.count())
    m = len(cut)
    index = stored(packed_index(codes, cut), "index")
    open_ = asked.select(F.col("code").alias("query")).distinct().withColumn("kth", F.lit(BITS).cast("long"))
    best: DataFrame | None = None
    near = Window.partitionBy("query").orderBy("distance", "least", "code")
    sofar = Window.partitionBy("query").orderBy("distance")
    for step in steps(cut):
        # the masks make probes many more than Spark expects, so never a broadcast of them
        met = probed(open_, cut, step).hint("merge").join(index, "key")
        apart = F.transform("codes", lambda c: F.struct(F.bit_count(F.col("query").bitwiseXOR(c["code"])).cast("long").alias("distance"), c["least"].alias("least"), c["code"].alias("code"), c["size"].alias("size")))
        nearest = F.slice(F.array_sort(F.filter(apart, lambda c: c["distance"] <= F.col("kth"))), 1, k)
        new = met.select("query", F.explode(nearest).alias("c")).select("query", "c.*")
        both = (new if best is None else best.union(new)).distinct()
        held, best = best, stored(both.withColumn("place", F.row_number().over(near)).filter(F.col("place") <= k).drop("place"), "best")
        reached = best.groupBy("query", "distance").agg(F.sum("size").alias("n")).withColumn("n", F.sum("n").over(sofar)).filter(F.col("n") >= need)
        kth = reached.groupBy("query").agg(F.min("distance").alias("found"))
        radius, segment = step[-1]
        rest = open_.join(kth, "query", "left").filter(F.coalesce("found", F.lit(BITS + 1)) > m * radius + segment)
        open_ = stored(rest.select("query", F.coalesce("found", "kth").alias("kth")), "open")
        if held is not None:
            discard(held)
        if not open_.take(1):
            break
    found = asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("query")).join(best.select("query", "code", "distance"), "query").join(ids.select("code", "vec_id"), "code")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("distance").cast("int").alias("distance"))
