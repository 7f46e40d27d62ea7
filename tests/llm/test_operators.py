"""Each operator against a brute-force version on small texts with nulls, copies, ties and odd characters."""

import hashlib
import math
import random
import re
import struct
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
from fringeworks.llm import bpe, chat, hamming, langid, minhash, packing, quality, substring, suffix, warc
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n long, bucket int"


def corpus(seed=0, n=60):
    r = random.Random(seed)
    syl = ["an", "the", "é", "ou", "ver", "it", "ß", "on", "zu", "la"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    passage = " ".join(word() for _ in range(120))
    out = []
    for i in range(n):
        text = "\n".join(" ".join(word() for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 8)))
        if i % 7 == 0:
            text += "  " + passage
        if i % 5 == 1 and out:
            text = out[-1]
        if i % 11 == 3 and out:
            w = out[-1].split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        out.append(text)
    out[3], out[4], out[5], out[6] = None, "", " \n\t ", "one two"
    out[8] = "a" * 900
    out[9] = "😀 x " * 30 + passage[:450]
    out[10] = "the same eight words are here again now . " * 6
    return out


def frame(spark, texts, ids=None):
    rows = [(i, t, ["en", "fr", None][i % 3], ["s", None][i % 2], 0, "x", 1, 2) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def result(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_packing(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    texts = corpus()
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = packing.pack(frame(spark, texts), sequence_tokens=64).collect()
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert sum((p.ids for p in mine), []) == ids
        assert [p.start for p in mine] == list(np.cumsum([0] + [p.length for p in mine])[:-1])
        assert all(p.doc_tokens == len(ids) for p in mine)
    by = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert by.get(p.sequence_id, 0) == p.offset
        by[p.sequence_id] = p.offset + p.length
    assert [v for _, v in sorted(by.items())][:-1] == [64] * (len(by) - 1)


def test_packing_of_the_digest_form(spark):
    texts = corpus(1, 12)
    a = packing.pack(frame(spark, texts)).collect()
    b = {(r.doc_id, r.start): r.c for r in packing.pack(frame(spark, texts), ids_as="binary").withColumn("c", F.crc32("ids")).collect()}
    assert all(b[p.doc_id, p.start] == zlib.crc32(struct.pack(f"<{p.length}I", *p.ids)) for p in a)


def brute_components(texts):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates(spark):
    texts = dict(enumerate(corpus(2)))
    got = result(minhash.components(frame(spark, list(texts.values()))))
    want = brute_components(texts)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_family_of_near_copies(spark):
    """Copies with few and many changes: some link only through others, some with none."""
    r = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
            w[r.randrange(150)] = f"x{r.randrange(40)}"
        texts[i] = " ".join(w)
    got = result(minhash.components(frame(spark, list(texts.values()))))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == brute_components(texts)


def test_link_beside_the_hub(spark):
    """Of h < x < y, y links with x alone: most of what x and the hub share is not in y."""
    texts = {}
    for t in range(12):
        h = [f"t{t}w{k}" for k in range(404)]
        x = list(h)
        x[50] = f"t{t}x"  # 5 of 400 shingles
        y = list(x)
        y[200:253] = [f"t{t}y{k}" for k in range(53)]  # 57 others
        texts |= {3 * t: " ".join(h), 3 * t + 1: " ".join(x), 3 * t + 2: " ".join(y)}
    want = brute_components(texts)
    assert {c for _, c in want.values()} == set(range(0, 36, 3))
    got = result(minhash.components(frame(spark, list(texts.values()))))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want


def test_base_statistics(spark):
    texts = corpus(3)
    got = result(quality.quality(frame(spark, texts)))
    for i, t in enumerate(texts):
        t = t or ""
        w = WORD.findall(t)
        lines, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), failed), i
        assert not (failed and x.kept)


def brute_failed(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    return len(w) < 20 or 100 * len(hit) > 30 * len(w)


def brute_verdict(rows, limit, share):
    """(n_removed_words, enough) of rows (doc_id, text, host), by sets of documents."""
    lines = lambda t: [(re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(WORD.findall(x))), len(WORD.findall(x))) for x in (t or "").split("\n") if WORD.search(x)]
    held = {}
    for k, (i, t, host) in enumerate(rows):
        for x, _ in lines(t):
            held.setdefault((host, x), set()).add(("row", k) if i is None else i)
    out = []
    for _, t, host in rows:
        n, gone = sum(m for _, m in lines(t)), sum(m for x, m in lines(t) if len(held[host, x]) > limit)
        out.append((gone, n - gone >= n * share))
    return out


def test_line_verdicts(spark):
    r = random.Random(0)
    own = lambda n: " ".join(str(r.random()) for _ in range(n))
    stock = [own(r.randint(1, 9)).upper() + " The End" for _ in range(12)]
    rows = []
    for i in range(400):
        body = [r.choice(stock).lower() if r.random() < 0.5 else r.choice(stock) for _ in range(r.randint(0, 5))] + [own(r.randint(1, 30))]
        r.shuffle(body)
        rows.append((None if i % 50 == 7 else i // 2 if i % 9 == 0 else i, "\n".join(body), r.choice(["a", "b", None])))
    rows += [rows[3], rows[3], (900, None, "a"), (901, "", "a")]
    df = spark.createDataFrame([(i, t, "en", h, 0, "", 0, 0) for i, t, h in rows], SCHEMA)
    got = sorted((x.doc_id is None, x.doc_id or 0, x.n_words, x.n_removed_words, x.base_failed, x.kept) for x in quality.quality(df, max_documents=9, kept_share=0.6).collect())
    verdicts = zip(rows, brute_verdict(rows, 9, 0.6), strict=True)
    want = sorted((i is None, i or 0, len(WORD.findall(t or "")), gone, brute_failed(t), enough and not brute_failed(t)) for (i, t, _), (gone, enough) in verdicts)
    assert got == want
    assert sum(not x[-1] and not x[-2] for x in want) > 10


def brute_windows(texts, width):
    seen, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[k : k + width]), i) < i:
                gone[k : k + width] = [True] * width
        out[i] = (len(w), " ".join(x for x, g in zip(w, gone) if not g), sum(gone))
    return out


def test_substring_removal(spark):
    texts = dict(enumerate(corpus(4)))
    got = result(substring.remove_repeats(frame(spark, list(texts.values())), width=10))
    assert {i: (x.n_words, x.kept_text, sum(s.end - s.start for s in x.spans)) for i, x in got.items()} == brute_windows(texts, 10)


def brute_bytes(texts, width):
    seen, hit = {}, {}
    data = {i: (t or "").encode() for i, t in texts.items()}
    for i, b in data.items():
        hit[i] = [False] * len(b)
        for k in range(len(b) - width + 1):
            first = seen.setdefault(b[k : k + width], (i, k))
            if first != (i, k):
                hit[i][k] = hit[first[0]][first[1]] = True
    out = {}
    for i, b in data.items():
        until, kept, n, spans, before = 0, bytearray(), 0, 0, False
        for k in range(len(b)):
            if hit[i][k]:
                until = k + width
            gone = k < until
            n, spans, before = n + gone, spans + (gone and not before), gone
            if not gone:
                kept.append(b[k])
        out[i] = (len(b), n, spans, bytes(kept))
    return out


@pytest.mark.parametrize("limit", [8192, 1])
def test_byte_strings(spark, monkeypatch, limit):
    """limit 1 sends every gram of several classes the way of very frequent ones."""
    monkeypatch.setattr(suffix, "SORTED_CLASSES", limit)
    texts = dict(enumerate(corpus(5)))
    got = result(suffix.remove_repeats(frame(spark, list(texts.values())), width=100, gram=16))
    assert {i: (x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), bytes(x.kept)) for i, x in got.items()} == brute_bytes(texts, 100)


def test_suffix_order():
    r = random.Random(1)
    around = [bytes(r.choice(b"ab") for _ in range(r.randint(2, 30))) for _ in range(200)]
    left = np.array([r.randint(0, len(x)) for x in around])
    group = np.sort(np.array([r.randint(0, 5) for _ in around]))
    s = suffix.Suffixes(around, left, group)
    for side in (1, -1):
        key = lambda i: around[i][left[i] :] if side > 0 else around[i][: left[i]][::-1]  # noqa: E731, B023
        got = s.order(side)
        for g in range(6):
            mine = [i for i in got if group[i] == g]
            assert [key(i) for i in mine] == sorted(key(i) for i in np.flatnonzero(group == g))


def test_bpe_round_trip(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path("word_bpe_49k.json"))
    texts = [*corpus(6), "It's <|endoftext|> don't we  ÀÉ ﬁ é 12 345 ...!", "\x1c a\x85\n b"]
    got = result(bpe.round_trip(frame(spark, texts), mean=64))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert list(np.frombuffer(got[i].ids, "<u4")) == ids, t
        assert got[i].decoded == tok.decode(ids, skip_special_tokens=False)


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "Hello there everyone.\nHow does the first engine work?", "x"),
        (1, 1, "assistant", "> How does  the FIRST engine work?\nIt burns fuel in a chamber.", "x"),
        (1, 2, "user", "Another matter entirely, please.", "x"),
        (1, 3, "user", "On Monday, X wrote:\n> > How does the first engine work?\n> It burns fuel in a chamber.\nThanks for that.", "x"),
        (1, 4, None, None, "x"),
        (2, 0, "user", "> It burns fuel in a chamber.\nquoted from elsewhere", "x"),
        (2, 0, "user", "> It burns fuel in a chamber.\nquoted from elsewhere", "x"),
        (None, 3, "user", "no conversation", "x"),
    ]
    out = chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    assert [got[1, k].reply_to for k in range(5)] == [None, 0, None, 1, None]
    assert got[1, 3].path == [0, 1, 3] and got[1, 3].depth == 2 and got[1, 3].thread == 0
    assert got[1, 3].text == "Thanks for that." and got[1, 1].text == "It burns fuel in a chamber."
    assert sorted(k for k in got if k[0] == 1) and [k for k in sorted((r.path, r.turn) for r in out if r.conv_id == 1)][:3] == [([0], 0), ([0, 1], 1), ([0, 1, 3], 3)]
    assert got[2, 0].reply_to is None and got[None, 3].path == []


def test_short_quotations(spark):
    """Whole quoted levels link at any length; short lines of a longer quote, and empty ones, do not."""
    rows = [
        (1, 0, "user", "Hello.\nIt rained all day long.", "x"),
        (1, 1, "assistant", "Are you ok?", "x"),
        (1, 2, "user", "> Are  you OK?\n>\nYes, please", "x"),
        (1, 3, "assistant", "> > Are you ok?\n> Yes, please\nFine.", "x"),
        (1, 4, "user", "> Fine.\nGood", "x"),
        (1, 5, "user", "> Fine.\n> and words from elsewhere\nHm", "x"),
        (1, 6, "user", ">\n>\nNothing quoted", "x"),
        (1, 7, "user", "> Hello.\nA line of a longer message", "x"),
    ]
    got = result(chat.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string")), "turn")
    assert [got[k].reply_to for k in range(8)] == [None, None, 1, 2, 3, None, None, 0]
    assert got[4].path == [1, 2, 3, 4] and got[4].thread == 1


def test_quotations_like_sql(spark, tmp_path):
    """Conversations of the driver in which every second message quotes earlier ones, some of them quoting themselves."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq
    from fringeworks.llm import queries

    rows = sorted(pq.read_table("/root/testdata/sf0.001/conversations.parquet").to_pylist(), key=lambda x: (x["conv_id"], x["turn"]))
    r, sent = random.Random(5), {}
    for x in rows:
        earlier = sent.setdefault(x["conv_id"], [])
        if earlier and r.random() < 0.7:
            quoted = r.choice(earlier)
            lines = ["> " + y for y in quoted.split("\n")] if r.random() < 0.6 else ["> " + r.choice(quoted.split("\n")).upper()]
            x["text"] = r.choice(["On Monday Ann wrote:\n", ""]) + "\r\n".join(lines) + "\n\n\n\n" + (x["text"] or "")
        earlier.append(x["text"] or "")
    rows += [rows[0], rows[0] | {"turn": None}, rows[1] | {"text": None, "role": None, "turn": 99}, rows[2] | {"conv_id": None}]
    pq.write_table(pa.Table.from_pylist(rows), f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    want = con.execute(queries.SQL["op6_chat"]).to_arrow_table().to_pylist()
    got = [x.asDict() for x in queries.op6_chat(spark, f"file://{tmp_path}").collect()]
    order = lambda x: [str(x[k]) for k in sorted(x)]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert sum(x["reply_to"] is not None for x in got) > 20 and max(x["depth"] for x in got) > 1


def test_hamming_top_k(spark):
    r = np.random.default_rng(0)
    vectors = r.normal(size=(400, 64))
    vectors[50:60] = vectors[0]
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)] + [(1000, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    got = hamming.top_k(df, df.filter("vec_id % 100 = 0")).collect()
    bits = vectors > 0
    for q in range(0, 400, 100):
        want = sorted((int((bits[q] != b).sum()), i) for i, b in enumerate(bits))[:10]
        assert sorted((x.rank, x.distance, x.vec_id) for x in got if x.query_id == q) == [(k + 1, d, i) for k, (d, i) in enumerate(want)]
    few = hamming.top_k(df.filter("vec_id < 3"), df.filter("vec_id = 0")).collect()
    assert len(few) == 3


def test_hamming_probes_every_value_of_a_radius_once(spark):
    """Masks are made in tasks: the plan of a wide radius is short."""
    cut = [(0, 5), (5, 24)]
    open_ = spark.createDataFrame([(0b1011_01101, 64), (-1, 3)], "query long, kth long")
    for radius, j in [(0, 0), (1, 1), (3, 0), (5, 0), (4, 1)]:
        df = hamming.probed(open_, cut, [(radius, j)])
        got = [(r.query, r.key) for r in df.collect()]
        shift, bits = cut[j]
        want = {(q, (j << 40) | ((q >> shift & (1 << bits) - 1) ^ sum(1 << b for b in c))) for q in (0b1011_01101, -1) for c in combinations(range(bits), radius)}
        assert len(got) == len(set(got)) and set(got) == want
    wide = hamming.probed(open_, cut, [(12, 1)])
    assert len(wide._jdf.queryExecution().analyzed().toString()) < 20_000
    assert wide.count() == 2 * math.comb(24, 12)


def test_warc(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 200)
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["<p>a</p>", None, "", "<p>a</p>", "é" * 300, "<p>b</p>", "<p>a</p>"])]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, size int")
    index, records, folder = warc.archive(df, f"file://{tmp_path}/w")
    got = result(records, "page_id")
    for i, _, h in pages:
        b = (h or "").encode()
        last = max(j for j, _, x in pages if (x or "").encode() == b)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].whole) == (len(b), warc.digest(b), True)
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if last == i else ("revisit", last))
    one = warc.read_records(index.filter(f"record_id = '{warc.record_id(4)}'"), folder).collect()
    assert len(one) == 1 and "é".encode() * 300 in bytes(one[0].record)


def test_language(spark):
    r = random.Random(3)
    words = {"en": ["the", "thing", "with", "reading", "those"], "fr": ["le", "pour", "chose", "avec", "éteint"], "de": ["der", "schon", "nicht", "über", "straße"]}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(12)), k) for i in range(90) for k in [["en", "fr", "de"][i % 3]]]
    rows += [(900, None, "en"), (901, "123 456 !", "fr"), (902, "", None), (904, "x" * 5000, None)]
    out = result(langid.identify(spark.createDataFrame([(*x, "y", 1.0) for x in rows], "doc_id long, text string, lang string, lang_pred string, score double")))
    assert all(out[i].lang_pred == k for i, _, k in rows[:90])
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= x.score <= 1 for x in out.values()) and out[904].lang_pred in words
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in out.items())


def test_forward_sums_all_segmentations():
    p = langid.Pieces("piece_bpe_32k.model")
    r = np.random.default_rng(0)
    prob = np.concatenate([r.uniform(1e-4, 1e-2, (p.size, 2)), np.full((1, 2), langid.UNKNOWN)])
    known = {n: prob[i] for i, n in enumerate(p.names)}
    scorer = langid.Scorer("piece_bpe_32k.model", prob)

    def log_total(word):  # one place after the other, in logarithms
        logs = [np.zeros(2)]
        for end in range(1, len(word) + 1):
            ways = [logs[k] + np.log(known.get(word[k:end], prob[-1])) for k in range(max(0, end - p.longest), end) if end - k == 1 or word[k:end] in known]
            logs.append(np.logaddexp.reduce(ways))
        return logs[-1]

    words = ["than", "a", "internationalization", "x\u4e2d" * 9, "thisisalongwordwithoutanyspace" * 11, "\u4e2d" * 200, "t" * 63, "t" * 64, "ing" * 43]
    assert p.longest > 8
    assert np.allclose(scorer.scores(words), [log_total("▁" + w) for w in words])
    assert np.array_equal(scorer.scores(words[::-1]), scorer.scores(words)[::-1])


def test_fit_sums_whole_words():
    """Expected numbers of pieces in words of many blocks, against one place after the other in logarithms."""
    p = langid.Pieces("piece_bpe_32k.model")
    r = np.random.default_rng(1)
    prob = np.append(r.uniform(1e-5, 1e-2, p.size), langid.UNKNOWN)
    known = {n: i for i, n in enumerate(p.names)}
    words = ["internationalization" * 5, "x\u4e2d" * 40, "t" * 63, "t" * 64, "t" * 127, "thisisalongword" * 30, "\u4e2d" * 200, "ing" * 43]
    counts = np.array([1.0, 2, 3, 1, 5, 1, 2, 7])
    want = np.zeros(p.size + 1)
    for word, n in zip(("▁" + w for w in words), counts, strict=True):
        arcs = [(k, end, known.get(word[k:end], p.size)) for k in range(len(word)) for end in range(k + 1, min(len(word), k + p.longest) + 1) if end == k + 1 or word[k:end] in known]
        ahead, back = np.full(len(word) + 1, -np.inf), np.full(len(word) + 1, -np.inf)
        ahead[0] = back[-1] = 0
        for k, end, i in arcs:
            ahead[end] = np.logaddexp(ahead[end], ahead[k] + np.log(prob[i]))
        for k, end, i in reversed(arcs):
            back[k] = np.logaddexp(back[k], back[end] + np.log(prob[i]))
        for k, end, i in arcs:
            want[i] += n * np.exp(ahead[k] + np.log(prob[i]) + back[end] - ahead[-1])
    assert np.allclose(langid.Blocks(p, words).expected(counts, prob), want, rtol=1e-9, atol=1e-12)
    # short words meet the same sums whichever way they take
    few, n = ["the", "words", "ofmanycharacters"] + words, np.arange(1, 12)
    whole = langid.fit_pieces(few, n, "piece_bpe_32k.model", 1)
    assert np.isclose(whole.sum(), 1) and np.isfinite(whole).all()
    uniform = np.append(np.full(p.size, 1 / p.size), langid.UNKNOWN)
    smooth = langid.Blocks(p, few).expected(n.astype(float), uniform)[:-1] + 0.05
    assert np.allclose(whole, smooth / smooth.sum(), rtol=1e-9)


def test_fit_of_a_word_of_a_megabyte():
    began = time.time()
    assert np.isfinite(langid.fit_pieces(["ab\u4e2dc" * 250_000, "the"], np.array([1, 2]), "piece_bpe_32k.model", 1)).all()
    assert time.time() - began < 60


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for f in (packing.pack, minhash.components, quality.quality, substring.remove_repeats, suffix.remove_repeats, bpe.round_trip, langid.identify):
        assert f(docs).count() == 0, f
    assert chat.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hamming.top_k(vectors, vectors).count() == 0
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))[1].count() == 0


def test_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(120))
    docs = frame(spark, [text, text, "short one"], ids=[1, 1, 2])
    assert sorted((r.doc_id, r.component_id) for r in minhash.components(docs).collect()) == [(1, 1), (1, 1), (2, 2)]
    assert sorted((r.doc_id, len(r.spans)) for r in substring.remove_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 0)]
    assert sorted((r.doc_id, len(r.kept)) for r in suffix.remove_repeats(docs).collect()) == [(1, 0), (1, 0), (2, 9)]
    assert sorted(r.n_tokens for r in bpe.round_trip(docs).collect())[0] == 2
    assert quality.quality(docs).count() == 3
    assert hashlib.sha256(bytes(bpe.round_trip(docs).filter("doc_id = 1").first().ids)).hexdigest()


def test_null_ids_and_clashing_columns(spark):
    """Rows without an id beside others, in a table whose other columns have names that operators use inside."""
    text = " ".join(f"w{k}" for k in range(120))
    rows = [(1, text), (2, text), (None, text), (None, None), (2**60 + 1, "last one"), (4, "")]
    names = ["label", "hits", "at", "part", "row", "n", "bucket", "a", "b", "gram", "hub", "doc", "root", "place", "share", "documents", "ids", "line", "host"]
    df = spark.createDataFrame([(i, t, "en", "s", *[7] * len(names)) for i, t in rows], "doc_id long, text string, lang string, source string, " + ", ".join(f"{x} int" for x in names))
    ids = sorted(str(i) for i, _ in rows)
    for f in (minhash.components, quality.quality, substring.remove_repeats, suffix.remove_repeats, bpe.round_trip, langid.identify):
        assert sorted(str(r.doc_id) for r in f(df).collect()) == ids, f
    pieces = packing.pack(df).collect()
    assert sorted(str(p.doc_id) for p in pieces if p.start == 0) == ids
    assert {r.doc_id: (r.component_id, r.kept) for r in minhash.components(df).collect()} == {1: (1, True), 2: (1, False), None: (None, False), 4: (4, True), 2**60 + 1: (2**60 + 1, True)}
    assert sorted(len(r.kept) for r in suffix.remove_repeats(df).filter("doc_id is null").collect()) == [0, len(text)]


def test_one_id_with_several_texts(spark):
    """The greatest text stands for the document."""
    same = " ".join(f"v{k}" for k in range(60))
    other = " ".join(f"w{k}" for k in range(60))
    docs = frame(spark, [same, other, other, same, "few"], ids=[5, 5, 6, 7, 8])
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs).collect()) == [(5, 56, 5, True), (5, 56, 5, True), (6, 56, 5, False), (7, 56, 7, True), (8, 1, 8, True)]


def test_very_long_texts(spark):
    """Texts of some megabytes, with and without white space, beside a short one."""
    long_ = " ".join(f"w{k * 7919 % 100003}" for k in range(300_000))
    solid = "".join(chr(97 + k * k % 23) for k in range(300_000))
    docs = frame(spark, [long_, long_ + " end", solid, "short text"])
    assert [r.component_id for r in sorted(minhash.components(docs).collect())] == [0, 0, 2, 3]
    assert {r.doc_id: r.n_words for r in quality.quality(docs).collect()} == {0: 300_000, 1: 300_001, 2: 1, 3: 2}
    assert {r.doc_id: sum(s.end - s.start for s in r.spans) for r in substring.remove_repeats(docs).collect()} == {0: 0, 1: 300_000, 2: 0, 3: 0}
    assert all(0 <= r.score <= 1 for r in langid.predict(docs, {"x": np.full(langid.Pieces("piece_bpe_32k.model").size, 1e-4)}).collect())


def test_undecided_pairs_of_selections(spark, monkeypatch):
    """Of documents that select paragraphs of one long document, none alike, few pairs are left to compare in full."""
    r = random.Random(0)
    paragraphs = [" ".join(f"w{r.randrange(5000)}" for _ in range(60)) for _ in range(60)]
    texts = ["\n".join(paragraphs)] + ["\n".join(paragraphs[k] for k in sorted(r.sample(range(60), 38))) for _ in range(60)]
    texts.append(texts[1].replace(" ", " x ", 40))  # a near copy of a selection
    made, stored = [], minhash.stored

    def counted(df, name):
        out = stored(df, name)
        made.extend([out.count()] if name == "undecided" else [])
        return out

    monkeypatch.setattr(minhash, "stored", counted)
    got = result(minhash.components(frame(spark, texts)))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == brute_components(dict(enumerate(texts)))
    assert made[0] <= len(texts)


def test_signatures_of_linked_documents_agree():
    """The bound that undecided pairs are held to leaves out no pair at the threshold."""
    r = np.random.default_rng(1)
    least = minhash.least_agreeing(160)
    for _ in range(200):
        both, own = r.integers(0, 2**63, 600, dtype=np.int64).astype(np.uint64), r.integers(0, 2**63, 200, dtype=np.int64).astype(np.uint64)
        sets = [np.concatenate([both, own[:100]]), np.concatenate([both, own[100:]])]  # 600 of 800
        x, y = (minhash.min_max(s, np.array([0, len(s)]), 80)[0] for s in sets)
        assert (x == y).sum() >= least
