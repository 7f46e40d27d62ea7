"""A Merkle tree over the rows of a dataset, by the preimages of its parents.

Every row is a leaf; the leaves of a group (a language) stand in the order of
their ids, two children make a parent, and the groups' roots are the leaves of a
last tree.  What is stored of a parent is its preimage, the hex digests of its
children one after the other.  A leaf joined with the preimages of its ancestors
has its proof: cutting its own 64 characters out of each leaves the siblings, and
writing another digest over them and hashing again folds the path to a root.

Levels are taken in tiers of ``BITS``: the ``2**BITS`` nodes below a node of the
next tier are a block, raised in one task, so a tree of any size takes a few
rounds, and no group, however large, comes to one task.  Paths are handed down
the same way, from the last tree to the leaves, by block.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a tier.
BITS = 10
DIGEST = 64

_PATH = "array<struct<slot:int,preimage:string>>"
_PARENTS = "group string, block long, level int, index long, preimage string"


def digest_of(*fields: Column) -> Column:
    """SHA-256 of fields: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""

    def cell(x: Column) -> Column:
        text = x.cast("string")
        return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(cell, fields)), 256)


def tampered_row(doc_id: Column) -> Column:
    """Rows whose unsigned CRC-32 of the decimal id is a multiple of seven; none without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, group, leaf, changed): group is a null lang's ``-`` or ``v`` and the lang, whose order is that of langs."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    leaf = digest_of(*(F.col(c) for c in FIELDS))
    changed = digest_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS))
    group = F.coalesce(F.concat(F.lit("v"), "lang"), F.lit("-"))
    return rows.select("doc_id", group.alias("group"), leaf.alias("leaf"), F.when(tampered_row(F.col("doc_id")), changed).otherwise(leaf).alias("changed"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with their place in their group (pos, from 0) and its size (total), in the order of some columns, nulls first.

    Rows are sorted by ranges; sizes of groups in partitions, about one row for
    each, give by prefix sums what to add in each.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = rows.repartitionByRange("group", *order, "tie").sortWithinPartitions("group", *order, "tie").drop("tie")
    placed = stored(placed.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "placed")
    sizes = placed.groupBy("part", "group").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    whole = Window.partitionBy("group")
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    starts = sizes.select("part", "group", (F.col("first") - before).alias("first"), F.sum("n").over(whole).alias("total"))
    return placed.join(starts, ["part", "group"]).withColumn("pos", F.col("place") - F.col("first")).drop("part", "place", "first")


def _levels(total: int, bits: int) -> int:
    """Levels that a block is raised: to the next tier, or to the group's root."""
    return min(bits, int(total - 1).bit_length())


def parents_of(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """The parents of a tier: (group, block, level, index, preimage), level from 1 and index within the block.

    nodes: group, pos, total, hash.
    """
    schema = pa.schema([("group", pa.string()), ("block", pa.int64()), ("level", pa.int32()), ("index", pa.int64()), ("preimage", pa.string())])

    def raised(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        level, hashes, out = 0, rows.column("hash").to_pylist(), []
        for level in range(1, _levels(rows.column("total")[0].as_py(), bits) + 1):
            joined = ["".join(hashes[i : i + 2]) for i in range(0, len(hashes), 2)]
            hashes = [sha256(x.encode()).hexdigest() for x in joined]
            out += [(level, i, x) for i, x in enumerate(joined)]
        group, block = (x.as_py() for x in key)
        columns = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array([group] * len(out), pa.string()), pa.array([block] * len(out), pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:]))], schema=schema)

    blocks = nodes.select("group", F.shiftright("pos", bits).alias("block"), "pos", "total", "hash")
    return blocks.groupBy("group", "block").applyInArrow(raised, _PARENTS)


def _descend(nodes: DataFrame, parents: DataFrame, above: DataFrame, keep: list[str], bits: int) -> DataFrame:
    """Columns ``keep`` of a tier's nodes with (path, subroot, root): from each node up to the root of all.

    above: group, pos, path, subroot, root of the next tier's nodes, whose pos is the block here.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    cells = pa.struct([("slot", pa.int32()), ("preimage", pa.string())])

    def hand_down(rows: pa.Table, others: pa.Table) -> pa.Table:
        pos = rows.column("pos").to_numpy() & ((1 << bits) - 1)
        level, index, images = others.column("level").to_numpy(), others.column("index").to_numpy(), others.column("preimage").to_pylist()
        top = others.slice(int(np.flatnonzero(level == 0)[0]), 1)
        at = {key: k for k, key in enumerate(zip(level.tolist(), index.tolist()))}
        upper, height, n = top.column("path")[0].as_py(), int(level.max()), rows.num_rows
        slots = np.empty((n, height + len(upper)), np.int32)
        which = np.empty((n, height + len(upper)), np.int64)
        for k in range(height):
            slots[:, k] = (pos >> k) & 1
            which[:, k] = [at[k + 1, i] for i in (pos >> (k + 1)).tolist()]
        for k, step in enumerate(upper, height):
            slots[:, k], which[:, k] = step["slot"], len(images) + k - height
        images = pa.array(images + [x["preimage"] for x in upper], pa.string()).take(pa.array(which.ravel()))
        path = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * slots.shape[1]), pa.StructArray.from_arrays([pa.array(slots.ravel()), images], fields=list(cells)))
        same = [pa.array([top.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")]
        out = [rows.column(c).combine_chunks() for c in keep] + [path, *same]
        return pa.table(out, names=[*keep, "path", "subroot", "root"])

    left = nodes.withColumn("block", F.shiftright("pos", bits)).select(*dict.fromkeys(["group", "block", "pos", *keep]))
    none = F.lit(None)
    right = parents.select("group", "block", "level", "index", "preimage", none.cast(_PATH).alias("path"), none.cast("string").alias("subroot"), none.cast("string").alias("root"))
    right = right.unionByName(above.select("group", F.col("pos").alias("block"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("index"), F.lit("").alias("preimage"), "path", "subroot", "root"))
    result = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", path {_PATH}, subroot string, root string"
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(hand_down, result)


def _tiers(nodes: DataFrame, bits: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Nodes and stored parents of each tier, and the roots of the groups (group, pos, total, hash)."""
    tiers = []
    largest = nodes.agg(F.max("total")).first()[0] or 0
    while True:
        parents = stored(parents_of(nodes.filter("total > 1"), bits), "parents")
        tiers.append((nodes, parents))
        tops = nodes.filter("total > 1").filter(F.col("pos") % (1 << bits) == 0).select("group", F.shiftright("pos", bits).alias("block"), "total")
        height = F.least(F.lit(bits), F.length(F.bin(F.col("total") - 1)))
        tops = tops.withColumn("level", height).join(parents.filter("index = 0"), ["group", "block", "level"])
        tops = tops.select("group", F.col("block").alias("pos"), F.ceil(F.col("total") / (1 << bits)).cast("long").alias("total"), F.sha2("preimage", 256).alias("hash"))
        # a group of one node is done and goes along
        nodes = stored(tops.unionByName(nodes.filter("total = 1").select("group", "pos", "total", "hash")), "nodes")
        largest = -(-largest // (1 << bits))
        if largest <= 1:
            return tiers, nodes


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, leaf, changed, path, subroot, root) for every document.

    path: the preimages of a leaf's ancestors, from its parent to the root, each
    with the place of its own digest there.  changed: the leaf of the document as
    it is found later; here that of ``tampered_row``.

    docs: doc_id, source, lang, n_chars, text; other columns are ignored.  Nulls
    are leaves' fields like others; a null lang is a group of its own, the first
    one, and null ids come first in theirs.  Rows of equal ids stand in the order of their
    leaves, and repeated rows are leaves each.  Texts of any length are hashed
    whole.  An empty table gives an empty one.
    """
    hashed = stored(leaves(docs), "leaves")
    first = stored(numbered(hashed, "doc_id", "leaf").withColumn("hash", F.col("leaf")), "first")
    discard(hashed)
    tiers, subroots = _tiers(first, bits)
    langs = subroots.select(F.col("group").alias("name"), F.col("hash"), F.lit("all").alias("group"))
    langs = stored(numbered(langs, "name"), "subroots")
    last, roots = _tiers(langs, bits)
    above = roots.select(F.lit("all").alias("group"), F.lit(0).cast("long").alias("pos"), F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    for nodes, parents in reversed(last):
        own = ["group", "pos", *(["name", "hash"] if nodes is langs else [])]
        above = _descend(nodes, parents, above, own, bits).select(*own, "path", "subroot", "root")
    above = above.select(F.col("name").alias("group"), F.lit(0).cast("long").alias("pos"), "path", F.col("hash").alias("subroot"), "root")
    for nodes, parents in reversed(tiers):
        own = ["doc_id", "leaf", "changed"] if nodes is first else ["group", "pos"]
        above = _descend(nodes, parents, stored(above, "above"), own, bits)
    return above


def siblings(path: Column) -> Column:
    """The siblings' digests on a path, from the leaf's to the subroots': preimages without the own digest."""
    cut = lambda x: F.concat(F.substring(x["preimage"], F.lit(1), x["slot"] * DIGEST), F.substring(x["preimage"], x["slot"] * DIGEST + DIGEST + 1, F.lit(DIGEST)))
    return F.transform(path, cut)


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf has under a path: its digest is written over the own one, level by level."""
    return F.aggregate(path, leaf, lambda own, x: F.sha2(F.overlay(x["preimage"], own, x["slot"] * DIGEST + 1, F.lit(DIGEST)), 256))


def verified(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every document, some of them tampered with."""
    rows = manifest(docs, bits)
    rows = rows.withColumn("folded_root", folded(F.col("path"), F.col("changed")))
    proof = F.sha2(F.array_join(siblings(F.col("path")), ""), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
