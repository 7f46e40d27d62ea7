"""Merkle manifests, repair of conversations and rank-queue BPE against brute force, and in SQL where there is some."""

import base64
import hashlib
import random
import zlib
from functools import lru_cache

import duckdb
import pytest
from fringeworks.llm import merkle, queries, rankqueue, repair
from pyspark.sql import functions as F
from test_operators import corpus

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, `group` int, pos long, part int, leaf string, tie int"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def documents(n=70):
    r = random.Random(3)
    out = []
    for i, t in enumerate(corpus(2, n)):
        out.append((None if i == 9 else i, t, [None, "de", "en", "en", "en", "en", "", "één"][r.randrange(8)], [None, "s"][i % 2], None if i % 6 == 0 else len(t or ""), "x", 1, 2, 3, "y", 4))
    out += [out[5], out[5], out[9]]
    out.append((11, "other text of a known id", "en", None, 3, "x", 1, 2, 3, "y", 4))
    return out


def brute_tree(hashes, slots):
    """The root, and for each leaf its siblings from bottom to top."""
    proofs = [[] for _ in hashes]
    level, at = list(hashes), list(slots)
    while len(level) > 1:
        for k, p in enumerate(at):
            pair = level[p - p % 2 : p - p % 2 + 2]
            proofs[k].append((p % 2, [x for j, x in enumerate(pair) if j != p % 2]))
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], proofs


def brute_merkle(rows):
    def leaf(r, more=0):
        fields = [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields))

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *brute_tree([leaf(r) for r in mine], range(len(mine)))))
    root, upper = brute_tree([t[1] for t in trees], range(len(trees)))
    out = []
    for (mine, subroot, proofs), above in zip(trees, upper):
        for r, proof in zip(mine, proofs):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            own = leaf(r, 1) if bad else leaf(r)
            steps = proof + above
            for slot, others in steps:
                own = sha(own + "".join(others) if slot == 0 else "".join(others) + own)
            out.append((r[0], leaf(r), subroot, root, sha("".join(x for _, o in steps for x in o)), own, own == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 3, merkle.BITS])
def test_merkle(spark, bits):
    rows = documents()
    got = merkle.verified(spark.createDataFrame(rows, DOCS).repartition(3), bits)
    assert sorted(map(tuple, got.collect()), key=str) == brute_merkle(rows)


def test_merkle_of_few_rows(spark):
    rows = documents()[:1]
    assert list(map(tuple, merkle.verified(spark.createDataFrame(rows, DOCS)).collect())) == brute_merkle(rows)
    assert merkle.verified(spark.createDataFrame([], DOCS)).collect() == []


def test_merkle_of_one_long_group(spark):
    rows = [(i // 2, f"t{i}", "en", None, i, "x", 1, 2, 3, "y", 4) for i in range(1300)] + [(7, "é" * 1_000_000, "fr", "s", 1, "x", 1, 2, 3, "y", 4)]
    got = merkle.verified(spark.createDataFrame(rows, DOCS), 4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_merkle(rows)


def test_siblings_leave_the_own_digest_out(spark):
    row = merkle.manifest(spark.createDataFrame(documents()[:6], DOCS)).withColumn("siblings", merkle.siblings(F.col("path"))).collect()
    assert all(len(p.preimage) in (64, 128) and p.preimage[64 * p.slot : 64 * p.slot + 64] not in s for r in row for p, s in zip(r.path, r.siblings))
    assert all(r.path[0].preimage[64 * r.path[0].slot :][:64] == r.leaf for r in row)


TALKS = "conv_id long, turn long, role string, text string, audit string, key int, place long, lost string, who int, `start` int"


def talks(seed, conversations=40, most=9):
    r = random.Random(seed)
    out = []
    for c in range(conversations):
        for t in range(r.randint(1, most)):
            role = r.choice(["user", "assistant"] if r.random() < 0.2 else [["user", "assistant"][t % 2]])
            role = r.choice([role] * 8 + ["system", "tool", None, "", "Ärger", "umpire"])
            text = r.choice(["Yes.", "no", " \t", "", None, "What?\n ", "well!", "fine;\x0b", "\x1c", f"t{t}.", "é。"])
            out.append((None if c == 3 else c, r.choice([t] * 9 + [None, t + 2, -5]), role, text))
    return [(*x, "x", 1, 2, "y", 3, 4) for x in out + out[:5]]


def brute_repair(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        mine = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, mine in by.items():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), sha(x[2])))
        seen, faults = set(), []
        for _, role, text in mine:
            left = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(None)
        def best(i, last, inserts, mine=tuple(mine), faults=tuple(faults)):
            """Least (cost, audit, lines) after i rows, the last role's initial being ``last``; two inserts at most between rows."""
            ways = []
            if i == len(mine):
                if last in ("", "a"):
                    ways.append((0, "", ()))
            else:
                more = 5 * (faults[i] == "truncated")
                _, role, text = mine[i]
                cost, audit, lines = best(i + 1, last, 0)
                ways.append((cost + 2, "D" + audit, lines))
                if faults[i] not in ("blank", "duplicate"):
                    for edit, price, name in [("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")]:
                        if name and last + name[:1] in ("s", "u", "su", "ua", "au"):
                            cost, audit, lines = best(i + 1, name[:1], 0)
                            ways.append((cost + price + more, edit + audit, (f"{name}:{text}", *lines)))
            if inserts < 2:
                for name in ("user", "assistant"):
                    if last + name[0] in ("u", "su", "ua", "au"):
                        cost, audit, lines = best(i, name[0], inserts + 1)
                        ways.append((cost + 5, "I" + audit, (name + ":", *lines)))
            return min(ways, default=(10**9, "", ()))

        cost, audit, lines = best(0, "", 0)
        turns = {t for t, *_ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        who = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(who, who[1:]))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,block", [(0, 9), (1, 9), (2, 1), (3, 2)])
def test_repair(spark, monkeypatch, seed, block):
    monkeypatch.setattr(repair, "BLOCK", block)  # small blocks: conversations in several parts
    rows = talks(seed)
    got = repair.repaired(repair.damaged(spark.createDataFrame(rows, TALKS).repartition(3)))
    assert sorted(map(tuple, got.collect()), key=str) == brute_repair(rows)


def test_repair_like_sql(spark):
    rows = talks(5, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    want = con.execute(queries._repair_sql()).fetchall()
    assert sorted(want, key=str) == brute_repair(rows)


def test_repair_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)
    rows = [(1, *x[1:]) for x in talks(7, 60)][:300]
    rows += [(2, i, "user", "a" * 1_000_000, "x", 1, 2, "y", 3, 4) for i in range(2)]
    got = repair.repaired(repair.damaged(spark.createDataFrame(rows, TALKS)))
    assert sorted(map(tuple, got.collect()), key=str) == brute_repair(rows)


def test_costs_of_long_signatures():
    signature = "".join(random.Random(1).choices("suaxdSUAX", k=5000))
    costs = repair.costs_of(signature, repair.END)
    audit, state = repair.audit_of(signature, costs, 0, True)
    assert len(costs) == 5001 and state in (0, 3) and len(audit.replace("I", "")) == 5000


def test_repair_of_no_rows(spark):
    assert repair.repaired(repair.damaged(spark.createDataFrame([], TALKS))).collect() == []
    lost = spark.createDataFrame([(4, 0, "user", "Hi.", True)], "conv_id long, turn long, role string, text string, lost boolean")
    assert tuple(repair.repaired(lost).first()) == (4, 0, 0, 0, 0, 0, 0, "", sha(""))


def brute_encoding():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(1)
    ranks, _ = brute_encoding()
    tokens = sorted(ranks)
    out = corpus(4, 50)
    for _ in range(40):
        words = ["".join(r.choice("abcdeéßñ的是一") for _ in range(r.randint(1, 200))), " " * r.randint(1, 5) + " \n\x1c\x85"[: r.randint(0, 4)], "a" * r.randint(1, 300) + "<|endoftext|>", "it's 'tis ' 's"]
        words += ["".join(r.choice(tokens).decode("utf8", "replace") for _ in range(r.randint(1, 6))) for _ in range(5)]
        r.shuffle(words)
        out.append(" ".join(words))
    return [*out, out[0], "ab" * 100_000, "".join(r.choice("abcdefgh") for _ in range(100_000)), "x y " * 50_000]


def test_rank_queue(spark, monkeypatch):
    texts = odd_texts()
    _, code = brute_encoding()
    rows = [(None if i == 2 else i, t, "en", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row int, decoded int").repartition(3)
    got = {r.doc_id: r for r in rankqueue.round_trip(docs).collect()}
    decimal = {r.doc_id: r for r in rankqueue.round_trip(docs, ids_as="decimal").collect()}
    assert len(got) == len(texts)
    for i, t, *_ in rows:
        want = code.encode_ordinary(t or "")
        assert got[i].ids == want and got[i].n_tokens == len(want) and got[i].decoded == (t or "").encode()
        assert decimal[i].ids == ",".join(map(str, want)).encode()
    assert rankqueue.round_trip(docs.limit(0)).collect() == []


@pytest.mark.parametrize("many", [1, 20, 10**9])
def test_steps_of_the_rank_queue(monkeypatch, many):
    """Nodes merged one after the other or many at once give the same ids."""
    monkeypatch.setattr(rankqueue, "MANY", many)
    _, code = brute_encoding()
    mine = rankqueue.RankQueueEncoder("byte_bpe_multi_50k.tiktoken", remembered=50)
    for t in odd_texts():
        ids, first = mine.encode(*rankqueue_texts([t]))
        assert ids.tolist() == code.encode_ordinary(t or "") and first[-1] == len(ids)


def rankqueue_texts(texts):
    import pyarrow as pa
    from fringeworks.llm._text import texts as arrays

    return arrays(pa.array(texts, pa.string()))


def test_bitmap():
    r, have = random.Random(0), set()
    bits = rankqueue.Bitmap(50_256)
    for _ in range(3000):
        x = r.randrange(50_256)
        (have.add if r.random() < 0.6 else have.discard)(x)
        (bits.add if x in have else bits.drop)(x)
        assert bits.first() == min(have, default=-1)
