"""Units and pre-tokens that an encoder remembers."""

import numpy as np
from fringeworks.llm import _units


def test_pre_tokens_outlast_units():
    code = _units.UnitEncoder("word_bpe_49k.json", remembered=40)
    texts = [" ".join(f"ab{k % 7} wörd{k} x\ty{k}," for k in range(n, n + 30)) for n in range(0, 300, 30)]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, _ = code.encode(data, np.array([0, len(data)]))
        assert ids.tolist() == code.tokenizer.encode(text, add_special_tokens=False).ids
    code._forget()
    assert not code.known and code.parts


def test_new_pre_tokens_in_one_call(monkeypatch):
    """Whatever the units are, plain ones' new pre-tokens take one call for all and their ids are the tokenizer's."""
    code = _units.UnitEncoder("word_bpe_49k.json", remembered=300)
    calls = []
    monkeypatch.setattr(code.endings, "encode", lambda parts, f=code.endings.encode: calls.append(len(parts)) or f(parts))
    texts = ["It's DON'T we'Ll 12345 \t\n ...!?(x) a", " \n ", "", "x", "ﬁ é <|endoftext|> ÀÉß 日本 a\x01b \x02 c", *(" ".join(f"w{k}é{k * n}'s," for k in range(40)) for n in range(1, 9))]
    for mine in (texts, texts[::-1], texts[:4], texts[4:5]):
        calls.clear()
        raw = [x.encode() for x in mine]
        ids, bounds = code.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [code.tokenizer.encode(x, add_special_tokens=False).ids for x in mine]
        assert len(calls) <= 1


def test_merges_that_are_ranks():
    assert _units._makes_all([("a", "b"), ("ab", "c</w>"), ("ab", "ab")], "</w>")
    assert not _units._makes_all([("a", "b"), ("b", "c"), ("a", "bc")], "</w>")  # abc becomes ab, c
    assert not _units._makes_all([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")], "</w>")  # one string twice
