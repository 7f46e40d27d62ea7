"""Repair of conversations by signatures.

After damage a conversation is a sequence of rows with roles and faults; which
edits are cheapest depends on these alone.  So every run of rows is written as a
short string, its signature, each distinct signature is solved once by a
memoised recursion over its suffixes, and the answers, strings of edits called
audits, are joined back and replayed on the rows.

Rows are sorted by ranges, so a conversation of any length is spread over tasks;
a signature is of rows of one conversation in one block of ``1 << BLOCK`` rows.  A
conversation in several blocks is solved from its end: the costs from each state
at the start of a part are the end's costs of the part before it, which needs four
numbers for each pair of states of a part, found once for each signature.  Then the states at
the parts' starts follow from the front.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from ._worker import tidy

#: Rows of a block, as a power of two.
BLOCK = 9
#: Suffixes that the recursion goes through in one go.
DEPTH = 64
SPACE = " \t\n\x0b\x0c\r"

#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: at the start, after a system row, after a user's, after an assistant's.  Which role comes next, and where an own role leads.
NEXT = ((2, "user"), (2, "user"), (3, "assistant"), (2, "user"))
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Costs from each state where no row is left: rows are inserted until an assistant's is the last.
END = (0, 2 * INSERT, INSERT, 0)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, lost) after a damage that the CRC-32 of ``conv_id:turn`` chooses, modulo 20.

    0: the row is lost; 1: its text is empty; 2: it has no ``.!?``; 3: it occurs
    twice; 4: its role is user.  Nulls count as one space; conv_id and turn stay null.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(one("text"), ".!?", "")).otherwise(one("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(kind == 4, "user").otherwise(one("role"))
    return rows.select("conv_id", F.col("turn").cast("long"), role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), copies.alias("copy")).drop("copy")


def costs_of(signature: str, ends: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each suffix the least costs from the four states, inserts before it included; ends: those behind the last row."""
    memo: dict[int, tuple[int, ...]] = {len(signature): ends}

    def costs(i: int) -> tuple[int, ...]:
        if i not in memo:
            own = tuple(min(price + costs(i + 1)[to] for _, price, to in _row_edits(signature[i], state)) for state in range(4))
            user, answered = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
            memo[i] = (min(own[0], INSERT + user), min(own[1], INSERT + user), user, answered)
        return memo[i]

    for i in range(len(signature), 0, -DEPTH):
        costs(i)  # answers on the way bound the depth of the recursion
    costs(0)
    return [memo[i] for i in range(len(signature) + 1)]


def _row_edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a row: the edit's initial, its cost and the state after it."""
    out = [("D", DELETE, state)]
    if symbol != "d":
        more = TRUNCATED if symbol.isupper() else 0
        if symbol.lower() in KEEPS[state]:
            out.append(("K", more, KEEPS[state][symbol.lower()]))
        out.append(("R", REROLE + more, NEXT[state][0]))
    return out


def audit_of(signature: str, costs: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """The cheapest edits from a state, the ASCII-least ones of equal cost, and the state behind them."""
    out, i = [], 0
    while i < len(signature):
        left = costs[i][state]
        edits = [(e, i + 1, to) for e, price, to in _row_edits(signature[i], state) if price + costs[i + 1][to] == left]
        if INSERT + costs[i][NEXT[state][0]] == left:
            edits.append(("I", i, NEXT[state][0]))
        edit, i, state = min(edits)
        out.append(edit)
    while last and END[state]:
        out.append("I")
        state = NEXT[state][0]
    return "".join(out), state


_SOLVED = "signature string, ends array<int>, last boolean, audits array<string>, exits array<int>, costs array<int>"


def solved(questions: DataFrame) -> DataFrame:
    """Distinct (signature, ends, last) with an audit, the state behind it and its cost for each state before."""
    schema = pa.schema([("signature", pa.string()), ("ends", pa.list_(pa.int32())), ("last", pa.bool_()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("costs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for q in batch.to_pylist():
                costs = costs_of(q["signature"], tuple(q["ends"]))
                ways = [audit_of(q["signature"], costs, s, q["last"]) for s in range(4)]
                price = [costs[0][s] - (0 if q["last"] else q["ends"][to]) for s, (_, to) in enumerate(ways)]
                out.append(q | {"audits": [a for a, _ in ways], "exits": [to for _, to in ways], "costs": price})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return questions.select("signature", "ends", "last").distinct().mapInArrow(tidy(run), _SOLVED)


#: Costs of an end that cannot be chosen.
_NEVER = 1 << 28


def _crossings(signatures: DataFrame) -> DataFrame:
    """(signature, cross): least costs from each state before to each state behind, row by row."""
    schema = pa.schema([("signature", pa.string()), ("cross", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cross = []
            for x in batch.column(0).to_pylist():
                to = [costs_of(x, tuple(0 if s == t else _NEVER for s in range(4)))[0] for t in range(4)]
                cross.append([to[t][s] for s in range(4) for t in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cross, schema.field(1).type)], schema=schema)

    return signatures.distinct().mapInArrow(tidy(run), "signature string, cross array<int>")


def _with_ends(parts: DataFrame) -> DataFrame:
    """(key, block, signature, ends, last) of conversations in several parts, each from its end; ends less their least."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("signature", pa.string()), ("ends", pa.list_(pa.int32())), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = None, list(END)
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                last = x["key"] != key
                key, ends = x["key"], list(END) if last else [v - min(ends) for v in ends]
                rows.append([key, x["block"], x["signature"], ends, last])
                ends = [min(x["cross"][4 * s + t] + ends[t] for t in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ordered = parts.repartition("key").sortWithinPartitions("key", F.col("block").desc()).select("key", "block", "signature", "cross")
    return ordered.mapInArrow(tidy(run), "key string, block long, signature string, ends array<int>, last boolean")


def _with_starts(parts: DataFrame) -> DataFrame:
    """(key, block, start): the state before each part, from the front."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("start", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, 0
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                state = state if x["key"] == key else 0
                key = x["key"]
                rows.append([key, x["block"], state])
                state = x["exits"][state]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ordered = parts.repartition("key").sortWithinPartitions("key", "block").select("key", "block", "exits")
    return ordered.mapInArrow(tidy(run), "key string, block long, start int")


def _parts(placed: DataFrame) -> DataFrame:
    """What counts of the rows of each conversation in each block: signature, initials, faults and turns."""
    present = placed.filter("not lost").select("key", "place", "turn", "role", "named", "end")
    firsts = present.groupBy("key", "role", "named").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    rows = present.join(firsts, "place", "left")
    initial = F.substring("role", 1, 1)
    who = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    fault = F.when(F.col("end") == "", "b").when(F.col("first").isNull(), "d").when(~F.col("end").isin(".", "!", "?"), "t").otherwise("-")
    symbol = F.when(fault.isin("b", "d"), "d").when(fault == "t", F.upper(who)).otherwise(who)
    rows = rows.select("key", F.shiftright("place", BLOCK).alias("block"), "turn", F.struct("place", symbol.alias("symbol"), who.alias("who")).alias("x"), fault.alias("fault"))
    several = rows.groupBy("key", "block").agg(
        F.array_sort(F.collect_list("x")).alias("xs"),  # of one block's rows at most
        *(F.sum((F.col("fault") == f).cast("long")).alias(name) for name, f in (("blank", "b"), ("duplicate", "d"), ("truncated", "t"))),
        F.min("turn").alias("least"),
        F.max("turn").alias("most"),
        F.count_distinct("turn").alias("turns"),
    )
    joined = lambda c: F.array_join(F.transform("xs", lambda x: x[c]), "")
    return several.select("key", "block", joined("symbol").alias("signature"), joined("who").alias("who"), "blank", "duplicate", "truncated", "least", "most", "turns")


def audits(parts: DataFrame) -> DataFrame:
    """``parts`` with the state before each, its audit and its cost."""
    counts = parts.groupBy("key").agg(F.count("*").alias("parts"))
    counted = parts.select("key", "block", "signature").join(counts, "key")
    alone = counted.filter("parts = 1").select("key", "block", "signature", F.array(*map(F.lit, END)).alias("ends"), F.lit(True).alias("last"))
    several = counted.filter("parts > 1")
    several = _with_ends(several.join(_crossings(several.select("signature")), "signature"))
    asked = stored(alone.unionByName(several), "asked")
    answers = stored(solved(asked), "answers")
    given = asked.join(answers, ["signature", "ends", "last"])
    split = given.join(counts.filter("parts > 1").select("key"), "key", "left_semi")
    starts = _with_starts(split)
    given = given.join(starts, ["key", "block"], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    chosen = given.select("key", "block", "start", F.get("audits", F.col("start")).alias("audit"), F.get("costs", F.col("start")).cast("long").alias("cost"))
    return parts.drop("signature").join(chosen, ["key", "block"])


class _Replay:
    """A conversation while its parts and rows pass by in their order."""

    def __init__(self, key: str):
        self.key, self.conv_id, self.faults = key, None, [0, 0, 0]
        self.illegal = self.cost = self.turns = self.lines = 0
        self.least = self.most = None
        self.who, self.audits, self.digest = "", [], sha256()
        self.edits, self.at, self.state = "", 0, 0

    def part(self, x: dict) -> None:
        self.rest()
        whos = self.who[-1:] + x["who"]
        self.illegal += sum(whos[i : i + 2] not in ("su", "ua", "au") for i in range(len(whos) - 1))
        self.who = whos
        self.faults = [a + x[c] for a, c in zip(self.faults, ("blank", "duplicate", "truncated"))]
        self.cost += x["cost"]
        if x["least"] is not None:
            self.turns += x["turns"] - (self.most == x["least"])
            self.least, self.most = x["least"] if self.least is None else self.least, x["most"]
        self.audits.append(x["audit"])
        self.edits, self.at, self.state = x["audit"], 0, x["start"]

    def line(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + role.encode() + b":" + text.encode())
        self.lines += 1

    def inserts(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.state, role = NEXT[self.state]
            self.line(role, "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit, self.at = self.edits[self.at], self.at + 1
        if edit == "K":
            self.state = KEEPS[self.state][role[0]]
            self.line(role, text)
        elif edit == "R":
            self.state, role = NEXT[self.state]
            self.line(role, text)

    def rest(self) -> None:
        self.inserts()

    def result(self) -> list:
        self.rest()
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return [self.conv_id, gaps, *self.faults, self.illegal, self.cost, "".join(self.audits), self.digest.hexdigest()]


def repaired(rows: DataFrame, lost: str | None = "lost") -> DataFrame:
    """Rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one for each conv_id.

    rows: conv_id, turn, role, text, and a column ``lost`` (None: without one) that
    marks rows which count for nothing but that their conversation is named; other
    columns are ignored.  Rows go by turn, nulls first, those of equal turns by role
    and by the SHA-256 of their texts.  A null conv_id is a conversation.  A null
    role or text counts as one space; a role of another initial than s, u, a can be
    given another role or deleted, but not kept.  An empty table gives an
    empty one.  Conversations and texts of any length are taken whole; since a
    SHA-256 is one chain, a conversation's texts pass through one task, row after row.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("-"))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col(lost), F.lit(False)) if lost else F.lit(False)
    plain = rows.select(key.alias("key"), "conv_id", F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), gone.alias("lost"))
    named = plain.withColumn("named", F.sha2(F.col("text").cast("binary"), 256)).withColumn("end", F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1)))
    keys = ["key", "turn", "role", "named", "tie"]
    placed = named.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    placed = stored(placed.withColumn("place", F.monotonically_increasing_id()), "placed")
    parts = stored(_parts(placed), "parts")
    edited = audits(parts)
    none = lambda t: F.lit(None).cast(t)
    # a part comes before its rows
    steps = edited.select("key", F.shiftleft("block", BLOCK).alias("place"), F.lit(0).alias("order"), none(kind).alias("conv_id"), none("string").alias("role"), none("string").alias("text"), F.lit(False).alias("lost"), "who", "blank", "duplicate", "truncated", "least", "most", "turns", "start", "audit", "cost")
    texts = placed.select("key", "place", F.lit(1).alias("order"), "conv_id", F.when(~F.col("lost"), F.col("role")).alias("role"), F.when(~F.col("lost"), F.col("text")).alias("text"), "lost")
    both = steps.unionByName(texts, allowMissingColumns=True).repartition("key").sortWithinPartitions("key", "place", "order")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv = None, None
        for batch in batches:
            conv, done = batch.schema.field("conv_id").type, []
            for x in batch.to_pylist():
                if now is None or now.key != x["key"]:
                    done += [now.result()] if now else []
                    now = _Replay(x["key"])
                if x["order"] == 0:
                    now.part(x)
                else:
                    now.conv_id = x["conv_id"]
                    if not x["lost"]:
                        now.row(x["role"], x["text"])
            if done:
                yield _records(done, conv)
        if now:
            yield _records([now.result()], conv)

    def _records(done: list[list], conv: pa.DataType) -> pa.RecordBatch:
        kinds = [conv] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

    result = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return both.mapInArrow(tidy(run), result)
