"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary.  The
probability of a word, however long, is the sum over all its segmentations into
pieces of any length, found by a forward algorithm; a text's is the product over
its words.  The piece
probabilities are fitted by expectation maximisation (forward-backward) on a
bounded sample of labelled documents, one Spark task for each language.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import U64, list_of, lower_ascii, ragged, slices, table, words
from ._units import tokenizer_path
from ._worker import held, rest, tidy

#: Labelled documents of each language that the fit reads at most, those with the smallest hashes of their ids.
FIT_DOCUMENTS = 1500
ROUNDS = 3
#: Probability of a character that is no piece, the same in every language.
UNKNOWN = 1e-7
#: Words of more characters are summed in blocks of so many.
BLOCK = 64
#: Sums are held times this for each character, so that those of a block stay within the range of doubles.
SCALE = 1e4
_WORD_START = "▁"
_CHAR_BASE = U64(0x8CB92BA72F3D8DD7)
#: No character: stands behind the end of a word.
_NONE = U64(0x110000)
#: Words whose scores a worker remembers.
REMEMBERED = 200_000
#: Words of one length that are summed at once, which bounds the temporaries of a sum.
TOGETHER = 5_000


class Pieces:
    """The vocabulary, and the beginnings of its pieces, as a sorted table of hashes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(path))
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        self.names = sorted({x.lower() for x in names})
        self.size, self.longest = len(self.names), max(map(len, self.names))
        slot = {x: i for i, x in enumerate(self.names)}
        every = sorted({x[:k] for x in self.names for k in range(1, len(x) + 1)})
        hashes = self._hash(every)
        order = np.argsort(hashes)
        self.hashes, self.slot = hashes[order], np.array([slot.get(x, -1) for x in every], np.int32)[order]

    @staticmethod
    def codes(words: list[str], width: int) -> np.ndarray:
        """Code points, one row for each word of exactly ``width`` characters."""
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width).astype(U64)

    def _hash(self, names: list[str]) -> np.ndarray:
        out = np.zeros(len(names), U64)
        lengths = np.array([len(x) for x in names])
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            value = np.zeros(len(rows), U64)
            for column in self.codes([names[i] for i in rows], n).T:
                value = value * _CHAR_BASE + column + U64(1)
            out[rows] = value
        return out

    def parts(self, codes: np.ndarray, begins: int | None = None) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, pieces): which words have a piece there, and which; ``size`` for a character that is none."""
        out, width = [], codes.shape[1]
        for begin in range(width if begins is None else begins):
            rows, value = np.arange(len(codes), dtype=np.int32), np.zeros(len(codes), U64)
            for end in range(begin + 1, min(width, begin + self.longest) + 1):
                value = value * _CHAR_BASE + codes[rows, end - 1] + U64(1)
                at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
                known = self.hashes[at] == value
                piece = np.where(known, self.slot[at], np.int32(-1))
                if end == begin + 1:
                    out.append((begin, end, rows, np.where(piece < 0, np.int32(self.size), piece)))
                elif (hit := piece >= 0).any():
                    out.append((begin, end, rows[hit], piece[hit]))
                rows, value = rows[known], value[known]
                if not len(rows):
                    break
        return out


def by_width(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words grouped by their length: their indices, and their code points after the mark of a word's start."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        for rows in np.array_split(np.flatnonzero(lengths == n), 1 + int((lengths == n).sum()) // TOGETHER):
            yield rows, Pieces.codes([_WORD_START + words[i] for i in rows], int(n) + 1)


def forward(parts: list, width: int, probability: np.ndarray) -> np.ndarray:
    """alpha[j] (words, languages): probability of the first j characters, over all segmentations, times SCALE**j.

    probability: a row for each piece, and one more for characters that are none.
    """
    alpha = np.zeros((width + 1, len(parts[0][2]), probability.shape[1]))
    alpha[0] = 1
    scaled = {n: probability * SCALE**n for n in {end - begin for begin, end, *_ in parts}}
    for begin, end, rows, piece in parts:
        alpha[end, rows] += alpha[begin, rows] * scaled[end - begin][piece]
    return alpha


def log_of_word(table_of: Pieces, codes: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Logarithm of the probability of one word of any length, in each language.

    What reaches the first ``longest`` places of a block makes what reaches those
    of the next one, by a matrix that is found for many blocks at once.
    """
    n, reach, langs = len(codes), table_of.longest, probability.shape[1]
    blocks = -(-n // BLOCK)
    padded = np.concatenate([codes, np.full(blocks * BLOCK + reach - n, _NONE, U64)])
    scaled = [probability * SCALE**k for k in range(reach + 1)]
    state, log = np.zeros((reach, langs)), np.zeros(langs)
    state[0] = 1
    for some in np.array_split(np.arange(blocks), 1 + blocks * (BLOCK + reach) * reach * langs // (2 << 20)):
        at = np.zeros((BLOCK + reach, len(some), reach, langs))
        for k in range(reach):
            at[k, :, k] = 1
        window = padded[some[:, None] * BLOCK + np.arange(BLOCK + reach)]
        for begin, end, rows, piece in table_of.parts(window, BLOCK):
            at[end, rows] += at[begin, rows] * scaled[end - begin][piece][:, None]
        for k, block in enumerate(some):
            if block == blocks - 1:
                last = (state * at[n - block * BLOCK, k]).sum(0)
                return log + np.log(np.maximum(last, 1e-300)) - n * np.log(SCALE)
            state = np.einsum("kl,jkl->jl", state, at[BLOCK:, k])
            most = np.maximum(state.max(0), 1e-300)
            state /= most
            log += np.log(most)
    raise AssertionError("a word has a last block")


class Blocks:
    """Long words of one language, cut into blocks whose borders any piece may cross.

    Row i is a block of a word and what reaches beyond it; ``last`` is where the
    word ends in its last block, or -1 in the others.
    """

    def __init__(self, table_of: Pieces, words: list[str]):
        self.table_of, self.reach = table_of, table_of.longest
        lengths = np.fromiter((len(x) + 1 for x in words), np.int64, len(words))
        blocks = -(-lengths // BLOCK)
        room = blocks * BLOCK + self.reach
        self.codes = np.full(int(room.sum()), int(_NONE), np.uint32)
        begin = np.cumsum(room) - room
        self.codes[ragged(begin, lengths)] = np.frombuffer("".join(_WORD_START + x for x in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.word = np.repeat(np.arange(len(words)), blocks)
        within = np.arange(len(self.word)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        self.start = begin[self.word] + within * BLOCK
        self.last = np.where(within == blocks[self.word] - 1, lengths[self.word] - within * BLOCK, -1)
        self.first = within == 0
        self.some = np.array_split(np.arange(len(self.word)), 1 + len(self.word) * (BLOCK + self.reach) * self.reach // (2 << 20))

    def parts(self, some: np.ndarray) -> list:
        return self.table_of.parts(self.codes[self.start[some][:, None] + np.arange(BLOCK + self.reach)].astype(U64), BLOCK)

    def across(self, parts: list, some: np.ndarray, scaled: dict[int, np.ndarray]) -> np.ndarray:
        """at[j, i, k]: what reaches place j of block i from its place k."""
        at = np.zeros((BLOCK + self.reach, len(some), self.reach))
        for k in range(self.reach):
            at[k, :, k] = 1
        for begin, end, rows, piece in parts:
            at[end, rows] += at[begin, rows] * scaled[end - begin][piece][:, None]
        return at

    def expected(self, counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
        """Expected numbers of the pieces, over all segmentations of the whole words.

        What comes into a block from the left, and from the right, is carried from
        block to block; the sums within all blocks are then taken at once.
        """
        scaled = {k: probability * SCALE**k for k in range(1, self.reach + 1)}
        out = np.zeros(len(probability))
        left = np.zeros((len(self.word), self.reach))
        state = left[0]
        for some in self.some:
            at = self.across(self.parts(some), some, scaled)[BLOCK:]
            for k, i in enumerate(some):
                if self.first[i]:
                    state = np.eye(1, self.reach)[0]
                left[i] = state
                state = at[:, k] @ state
                state = state / max(state.max(), 1e-300)
        state = np.zeros(self.reach)
        for some in reversed(self.some):
            parts = self.parts(some)
            at = self.across(parts, some, scaled)
            beta = np.zeros((BLOCK + self.reach, len(some)))
            for k in range(len(some) - 1, -1, -1):
                i = some[k]
                if self.last[i] >= 0:
                    beta[self.last[i], k] = 1
                    state = at[self.last[i], k]
                else:
                    beta[BLOCK:, k] = state
                    state = state @ at[BLOCK:, k]
                state = state / max(state.max(), 1e-300)
            alpha = np.zeros_like(beta)
            alpha[: self.reach] = left[some].T
            for begin, end, rows, piece in parts:
                alpha[end, rows] += alpha[begin, rows] * scaled[end - begin][piece]
            # so far beta is only where ways leave the block, or the word ends, and each way does so once
            total = np.einsum("jk,jk->k", alpha, beta)
            share = counts[self.word[some]] / np.maximum(total, 1e-300)
            for begin, end, rows, piece in reversed(parts):
                through = beta[end, rows] * scaled[end - begin][piece]
                beta[begin, rows] += through
                out += np.bincount(piece, alpha[begin, rows] * through * share[rows], len(out))
        return out


def fit_pieces(words: list[str], counts: np.ndarray, path: str, rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities of one language, by expectation maximisation over the counted words, whole at any length."""
    table_of = pieces(path)
    size = table_of.size
    short, long_ = [i for i, x in enumerate(words) if len(x) < BLOCK], [i for i, x in enumerate(words) if len(x) >= BLOCK]
    blocks = Blocks(table_of, [words[i] for i in long_]) if long_ else None
    long_counts = counts[long_].astype(float)
    words, counts = [words[i] for i in short], counts[short]
    probability = np.append(np.full(size, 1 / size), UNKNOWN)
    for _ in range(rounds):
        expected = blocks.expected(long_counts, probability) if blocks else np.zeros(size + 1)
        for at, codes in by_width(words):  # pieces are found anew each round: kept, they would grow with the sample
            n, width, parts = counts[at].astype(float), codes.shape[1], table_of.parts(codes)
            alpha = forward(parts, width, probability[:, None])[:, :, 0]
            beta = np.zeros_like(alpha)
            beta[width] = 1
            scale = n / np.maximum(alpha[width], 1e-300)
            for begin, end, rows, piece in reversed(parts):
                through = beta[end, rows] * probability[piece] * SCALE ** (end - begin)
                beta[begin, rows] += through
                expected += np.bincount(piece, alpha[begin, rows] * through * scale[rows], size + 1)
        smooth = expected[:size] + 0.05
        probability[:size] = smooth / smooth.sum()
    return probability[:size]


def pieces(path: str) -> Pieces:
    """The vocabulary of a file, which a Python worker keeps from task to task."""
    return held(("pieces", path), lambda: Pieces(path))


class Scorer:
    """A model in a worker: logarithms of the probabilities of words in each language, and those met so far."""

    def __init__(self, vocabulary: str, probability: np.ndarray):
        self.pieces, self.probability = Pieces(vocabulary), probability
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.probability.shape[1]))

    def of(self, words: list[str]) -> np.ndarray:
        """(words, languages)"""
        out = np.zeros((len(words), self.probability.shape[1]))
        for at, codes in by_width(words):
            if codes.shape[1] > BLOCK:
                out[at] = [log_of_word(self.pieces, x, self.probability) for x in codes]
            else:
                out[at] = np.log(np.maximum(forward(self.pieces.parts(codes), codes.shape[1], self.probability)[-1], 1e-300)) - codes.shape[1] * np.log(SCALE)
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """The same for distinct words, by memory; only words within a block are remembered."""
        if len(self.known) > REMEMBERED:
            self._forget()
        k = len(self.known)
        new = [x for x in words if x not in self.known and len(x) < BLOCK]
        while k + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        if new:
            self.rows[k : k + len(new)] = self.of(pc.utf8_lower(pa.array(new, pa.string())).to_pylist())
        self.known.update(zip(new, range(k, k + len(new)), strict=True))
        out = self.rows[np.fromiter((self.known.get(x, 0) for x in words), np.int64, len(words))]
        if long_ := [i for i, x in enumerate(words) if len(x) >= BLOCK]:
            out[long_] = self.of(pc.utf8_lower(pa.array([words[i] for i in long_], pa.string())).to_pylist())
        return out


def _coded(data: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some texts, ASCII letters lowered, as a dictionary; and each text's first word."""
    low = lower_ascii(data)
    start, end, first = words(low, offs)
    tiles = np.empty(2 * len(start) + 1, np.int32)  # words and what stands between them
    tiles[0:-1:2], tiles[1::2], tiles[-1] = start, end, len(low)
    every = pa.StringArray.from_buffers(2 * len(start), pa.py_buffer(tiles), pa.py_buffer(np.ascontiguousarray(low)))
    return pc.dictionary_encode(every.take(pa.array(np.arange(0, 2 * len(start), 2)))), first


def fit(labelled: DataFrame, vocabulary: str = "piece_bpe_32k.model", fit_documents: int = FIT_DOCUMENTS) -> dict[str, np.ndarray]:
    """Piece probabilities of each language.  labelled: doc_id, text, lang.

    Reads at most ``fit_documents`` documents of a language.  The result has one
    number for each language and piece of the vocabulary.
    """
    known = labelled.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    # of each language a fifth more than are wanted by their hashes, and of these few the first; a number for each language
    sizes = {r.lang: r.documents for r in known.groupBy("lang").agg(F.count("*").alias("documents")).collect()}
    limits = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, (1.2 * fit_documents + 30) / n)))
    share = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(1 << 62)
    few = known.withColumn("share", share).filter(F.col("share") <= limits[F.col("lang")]) if sizes else known.limit(0).withColumn("share", share)
    order = Window.partitionBy("lang").orderBy("share", "doc_id")
    sample = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= fit_documents).select("lang", "text")
    counted = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in slices(batches):
            coded, first = _coded(data, offs)
            if not len(coded):
                continue
            langs = pc.dictionary_encode(batch.column(batch.schema.get_field_index("lang")))
            of = np.repeat(langs.indices.to_numpy(), np.diff(first)).astype(np.int64)
            key, n = np.unique(of * len(coded.dictionary) + coded.indices.to_numpy(), return_counts=True)
            yield table(counted, [langs.dictionary.take(pa.array(key // len(coded.dictionary))), coded.dictionary.take(pa.array(key % len(coded.dictionary))), n])

    per_word = sample.mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    fitted = pa.schema([("lang", pa.string()), ("probability", pa.list_(pa.float64()))])

    def learn(rows: pa.Table) -> pa.Table:
        lang = rows.column("lang")[0].as_py()
        words, counts = pc.utf8_lower(rows.column("word").combine_chunks()).to_pylist(), rows.column("n").to_numpy()
        p = fit_pieces(words, counts, vocabulary)
        rest()
        return pa.Table.from_batches([table(fitted, [[lang], list_of(p, np.array([0, len(p)]), pa.float64())])])

    rows = per_word.groupBy("lang").applyInArrow(learn, "lang string, probability array<double>").collect()
    return {r["lang"]: np.array(r["probability"]) for r in sorted(rows, key=lambda r: r["lang"])}


def predict(docs: DataFrame, model: dict[str, np.ndarray], vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced).

    score: probability of the predicted language under equal priors, by the
    mean over the words of the text, so that long texts do not all score 1.
    ``und`` with score 0 for a null text, one without a letter, or no language
    learned.  Of equal scores the first language in order of names wins.  Texts
    and words of any length are scored whole.
    """
    names = sorted(model)
    # languages side by side; the last row is for parts that are no piece
    size = len(model[names[0]]) if names else 0
    probability = np.full((size + 1, len(names)), UNKNOWN)
    for k, name in enumerate(names):
        probability[:size, k] = model[name]
    shared = docs.sparkSession.sparkContext.broadcast(probability)
    key = ("language", uuid.uuid4().hex)
    rest_ = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*rest_)
    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(key, lambda: Scorer(vocabulary, shared.value)) if names else None
        for batch, data, offs in slices(batches):
            n = len(offs) - 1
            ascii_letters = np.cumsum((data | 32) - 97 < 26, dtype=np.int32)
            letter = np.diff(np.where(offs > 0, ascii_letters[offs - 1], 0) if len(data) else offs) > 0
            del ascii_letters
            for i in np.flatnonzero(~letter):
                letter[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
            best, score = np.full(n, -1), np.zeros(n)
            coded, first = _coded(data, offs)
            if len(coded) and names:
                word = scorer.scores(coded.dictionary.to_pylist())
                total = np.zeros((len(coded) + 1, len(names)))
                np.cumsum(word[coded.indices.to_numpy()], axis=0, out=total[1:])
                logs = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)[:, None]
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                best = np.where(letter, odds.argmax(axis=1), -1)
                score = np.where(letter, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            pred = pa.array([names[b] if b >= 0 else "und" for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pred, pa.array(score, pa.float64())], names=[*rest_, "lang_pred", "score"])

    return docs.mapInArrow(tidy(run, keeps=True), schema)


def training_part(doc_id: str = "doc_id", parts: int = 4, held_out: int = 2):
    """Whether a document is held out: crc32 of its id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == held_out, F.lit(False))


def identify(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", fit_documents: int = FIT_DOCUMENTS) -> DataFrame:
    """doc_id, text, held_out, lang_pred, score: learned from the documents that are not held out.

    docs: doc_id, text, lang; other columns are ignored.  Documents with a null
    lang, text or id are not learned from.  Repeated rows each get their row.  An
    empty table gives an empty one.
    """
    plain = docs.select("doc_id", "text", "lang")
    model = fit(plain.filter(~training_part()), vocabulary, fit_documents)
    return predict(plain.select("doc_id", "text", training_part().alias("held_out")), model, vocabulary)
