"""Tokenizing through units: pieces of text between safe cutting points.

The pre-tokenizers of both public BPE files never join text across the start
of a white-space run, so a text's ids are the ids of its units, one after the
other.  Units repeat far more often than texts do: each distinct unit goes
through the ``tokenizers`` library once and its ids are reused.
"""

from __future__ import annotations

import gc
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ._text import _SPACE, ragged
from ._worker import held

#: Distinct units that a Python worker remembers before it starts afresh, and their bytes: a memory of some 60 MB at most.
REMEMBERED = 200_000
REMEMBERED_BYTES = 8 << 20


def tokenizer_path(path: str) -> str:
    """``path`` itself if it is a file, else the public file of that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def cuts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where units begin: at each text and at each run of ASCII white space.

    A run that may follow a white-space character outside ASCII starts no
    unit: neither after a character of three bytes led by E1-E3 nor after one
    led by C2.
    """
    n = len(data)
    begin = np.zeros(n + 1, bool)
    if n:
        space = _SPACE[data]
        begin[1:n] = space[1:] & ~space[:-1]
        begin[3:n] &= ~((data[: n - 3] >= 0xE1) & (data[: n - 3] <= 0xE3))[: max(0, n - 3)]
        begin[2:n] &= ~(data[: n - 2] == 0xC2)[: max(0, n - 2)]
    begin[offs] = True
    begin[n] = False
    return np.flatnonzero(begin)


#: Characters whose treatment by both normalisers is the same everywhere; other units go through the whole tokenizer.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]*")
#: The byte-level pre-tokenizer's documented pattern.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Stand for the end of a pre-token, and for a place between two units; plain units hold neither.
_END, _BETWEEN = "\x01", "\x02"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _room(x: np.ndarray, size: int) -> np.ndarray:
    """x with room for ``size`` values."""
    while size > len(x):
        x = np.concatenate([x, np.zeros_like(x)])
    return x


class Endings:
    """A byte-level vocabulary whose last letters bear a suffix, for ``tiktoken``: many pre-tokens in one call.

    A pre-token goes there with a byte for its end, which joins the last letter
    before all other merges.  ``tiktoken`` takes any two neighbours whose
    string it knows, the model only those of its merges; both come to the same
    if the merges make every string of theirs from its letters, which is tried.
    """

    def __init__(self, model: dict, bytes_of: dict[str, int]):
        import tiktoken

        suffix, vocab, end = model["end_of_word_suffix"], model["vocab"], _END.encode()
        merges = [tuple(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or not _makes_all(merges, suffix):
            raise ValueError("the merges are not those of ranks")
        letters = [*bytes_of]
        names = [*(c + suffix for c in letters), *letters, *(a + b for a, b in merges)]
        raw = lambda x: bytes(map(bytes_of.__getitem__, x))
        ranks = {raw(x.removesuffix(suffix)) + end if x.endswith(suffix) else raw(x): i for i, x in enumerate(names)}
        if len(ranks) < len(names):
            raise ValueError("two strings have the same bytes")
        self.ids = np.array([vocab[x] for x in names], np.uint32)
        self.last = np.array([x.endswith(suffix) for x in names])
        self.encoding = tiktoken.Encoding("endings", pat_str=f"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens (none is empty) one after the other, and the number of ids up to the end of each."""
        got = self.encoding.encode_to_numpy(_END.join([*parts, ""]))
        return self.ids[got], np.flatnonzero(self.last[got]) + 1


def _makes_all(merges: list[tuple[str, str]], suffix: str) -> bool:
    """Do the merges, the first one that fits at a time, make each one's result out of its letters, and no result twice?"""
    rank = {x: i for i, x in enumerate(merges)}
    none = len(merges)
    if len({a + b for a, b in merges}) < none:
        return False
    for a, b in merges:
        left = [*(a + b).removesuffix(suffix)]
        if b.endswith(suffix):
            left[-1] += suffix
        while len(left) > 1:
            fits = [rank.get(x, none) for x in zip(left, left[1:])]
            k = fits.index(least := min(fits))
            if least == none:
                return False
            left[k : k + 2] = [left[k] + left[k + 1]]
    return True


def _plain(unit: str) -> bool:
    return "<|" not in unit and (unit.isascii() and unit.isprintable() or _PLAIN.fullmatch(unit) is not None)


class UnitEncoder:
    """Ids of many texts at once; keeps the ids of the units met so far."""

    endings: Endings | None = None

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        splits = [x["pattern"]["Regex"] for x in (spec["pre_tokenizer"].get("pretokenizers") or []) if x["type"] == "Split"]
        self.split = regex.compile(splits[0] if splits else _BYTE_LEVEL).findall
        self.lower = "Lowercase" in str(spec.get("normalizer"))
        self.letters = byte_letters()
        self.ranked = self._ranked(spec["model"])
        self.endings = self._endings(spec["model"])
        self.remembered = remembered
        # pre-tokens outlast units, and those in use outlast the others; with ``endings`` they are places in part_ends
        self.parts: dict[str, list[int]] | dict[str, int] = {}
        self.older: dict[str, list[int]] = {}
        if self.endings:
            self._forget_parts()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.used = self.held_bytes = 0

    def _ranked(self, model: dict):
        """The same byte-level vocabulary for ``tiktoken``, if its ids follow the order of its merges; its BPE is the faster one."""
        bytes_of = {c: b for b, c in self.letters.items()}
        merged = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        if model.get("end_of_word_suffix") or [model["vocab"].get(x) for x in merged] != list(range(256, 256 + len(merged))):
            return None
        import tiktoken

        ranks = {bytes(map(bytes_of.__getitem__, x)): i for x, i in model["vocab"].items() if i < 256 + len(merged)}
        return tiktoken.Encoding("units", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _endings(self, model: dict) -> Endings | None:
        """The same for a vocabulary of pre-tokens with a suffix, if the pattern sets apart what stands between units."""
        if not model.get("end_of_word_suffix") or self.split(f"a {_BETWEEN} b") != ["a", _BETWEEN, "b"]:
            return None
        try:
            return Endings(model, {c: b for b, c in self.letters.items()})
        except (KeyError, ValueError):
            return None

    def _ids(self, unit: str) -> list[int]:
        """Ids of one unit: of its pre-tokens one after the other."""
        if not _plain(unit):
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        if self.ranked:
            return self.ranked(unit)
        out: list[int] = []
        for part in self.split(unit.lower() if self.lower else unit):
            ids = self.parts.get(part)
            if ids is None:
                ids = self.older.get(part)
                if ids is None:
                    plain = part.isascii() and part.isprintable()
                    letters = part.replace(" ", "\u0120") if plain else part.encode().decode("latin-1").translate(self.letters)
                    ids = [x.id for x in self.tokenizer.model.tokenize(letters)]
                self.parts[part] = ids
            out += ids
        return out

    def _each(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of some units, and their ids, unit by unit."""
        on = gc.isenabled()
        gc.disable()  # many small lists are made and none of them is garbage
        try:
            got = [self._ids(x) for x in units]
        finally:
            if on:
                gc.enable()
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        return lengths, np.fromiter(chain.from_iterable(got), np.uint32, int(lengths.sum()))

    def _forget_parts(self) -> None:
        self.parts = {_BETWEEN: 0}
        self.part_ids = np.zeros(1 << 16, np.uint32)
        self.part_ends = np.zeros(1 << 16, np.int64)  # the ids of the pre-token at place i end where i + 1 says
        self.part_bytes = 0

    def _together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, with one pass over the plain units and one call for all their new pre-tokens."""
        others = {} if _plain("\n".join(units)) else {k: self._ids(x) for k, x in enumerate(units) if not _plain(x)}
        text = f" {_BETWEEN} ".join([x if k not in others else "" for k, x in enumerate(units)] if others else units)
        found = self.split(text.lower() if self.lower else text)
        if len(self.parts) > self.remembered or self.part_bytes > REMEMBERED_BYTES:
            self._forget_parts()
        parts = self.parts
        new = [x for x in dict.fromkeys(found) if x not in parts]
        if new:
            ids, ends = self.endings.encode(new)
            n, used = len(parts), int(self.part_ends[len(parts)])
            self.part_ids = _room(self.part_ids, used + len(ids))
            self.part_ends = _room(self.part_ends, n + len(new) + 1)
            self.part_ids[used : used + len(ids)] = ids
            self.part_ends[n + 1 : n + 1 + len(new)] = used + ends
            parts.update(zip(new, range(n, n + len(new))))
            self.part_bytes += sum(map(len, new))
        at = np.fromiter(map(parts.__getitem__, found), np.int64, len(found))
        start = self.part_ends[at]
        size = self.part_ends[at + 1] - start
        flat = self.part_ids[ragged(start, size)]
        done = np.cumsum(size)
        lengths = np.diff(np.concatenate([np.zeros(1, np.int64), done[at == 0], done[-1:] if len(done) else np.zeros(1, np.int64)]))
        if others:
            before = np.cumsum(lengths)
            flat = np.insert(flat, np.repeat(before[[*others]], [*map(len, others.values())]), [*chain.from_iterable(others.values())])
            lengths[[*others]] = [*map(len, others.values())]
        return lengths, flat

    def _learn(self, units: list[str]) -> None:
        if not units:
            return
        lengths, flat = self._together(units) if self.endings else self._each(units)
        k = len(self.known)
        self.ids = _room(self.ids, self.used + len(flat))
        self.ends = _room(self.ends, k + len(units) + 1)
        self.ids[self.used : self.used + len(flat)] = flat
        self.ends[k + 1 : k + 1 + len(units)] = self.used + np.cumsum(lengths)
        self.used += len(flat)
        self.known.update(zip(units, range(k, k + len(units))))
        self.held_bytes += sum(map(len, units))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in ``data``, and the offset of each text's first id (one more at the end)."""
        begins = cuts(data, offs)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if len(self.known) > self.remembered or self.held_bytes > REMEMBERED_BYTES:
            self._forget()
        if not self.endings and 2 * len(self.parts) > self.remembered:
            self.older, self.parts = self.parts, {}
        bounds = np.append(begins, len(data)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pc.dictionary_encode(units)
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        self._learn([x for x in names if x not in known])
        slot = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        start, end = self.ends[slot], self.ends[slot + 1]
        done = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)])
        return self.ids[ragged(start, end - start)], done[np.searchsorted(begins, offs)]


def encoder(path: str) -> UnitEncoder:
    """The encoder of a file, which a Python worker keeps from task to task."""
    return held(("encoder", path), lambda: UnitEncoder(path))
