"""The stages of the pipeline on a small table: columns, decisions, and the whole against brute force."""

import corpus_pipeline as cp
import numpy as np
from test_operators import brute_bytes, brute_components, corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(corpus(7, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, cp.stored(stage(spark, docs, ""), name)
        assert docs.columns == COLUMNS
        kept[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in docs.collect()})
    a, b = kept["language"]
    assert set(a) - set(b) == {i for i, t in a.items() if not any(c.isalpha() for c in t or "")}
    a, b = kept["near_duplicates"]
    assert set(b) == {i for i, (_, c) in brute_components(a).items() if c == i}
    a, b = kept["repeated_passages"]
    want = brute_bytes(a, 400)
    assert set(a) == set(b) and all(b[i] == want[i][3].decode("utf-8", "replace") for i in a)
    pieces = cp.STAGES[-1][1](spark, docs, "").collect()
    assert {p.doc_id for p in pieces} == set(b)
    ends = {}
    for p in pieces:
        ends[p.doc_id] = ends.get(p.doc_id, 0) + p.length
    assert all(ends[p.doc_id] == p.doc_tokens for p in pieces)
    assert np.all([p.offset + p.length <= 2048 for p in pieces])
