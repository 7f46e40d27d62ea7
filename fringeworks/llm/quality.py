"""Quality rules: base statistics of a text, and cross-document line frequency.

Each line is normalised (ASCII letters lowered, words joined by one space) and
hashed; for each host the distinct documents that hold it are counted; lines
above the limit go, and a document that keeps too little of itself is rejected.
The limit is a number of documents, whatever the size of the host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stored
from ._text import _SPACE, U64, byte_prefix, list_of, lower_ascii, mix, prefix_hash, ragged, slices, span_hash, table, window_hashes, word_hashes, words
from ._worker import tidy

#: A line is removed if more documents of its host hold it.
MAX_DOCUMENTS = 50
#: A document is depleted if it keeps a smaller share of its words.
KEPT_SHARE = 0.4
MIN_WORDS = 20
REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_STATS = "row long, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def _per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask)])
    return np.diff(total[offs])


def _seen_before(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: is it equal to an earlier one of its text; and to any other one of its text."""
    key = mix(hashes + text.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    earlier, other = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return earlier, other


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row for each document: the base counts, and its normalised lines with their numbers of words."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("host", pa.string()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("lines", pa.list_(pa.int64())), ("line_words", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch, data, offs in slices(batches):
            n = len(offs) - 1
            start, end, first = words(data, offs)
            n_words = np.diff(first)
            of_word = np.repeat(np.arange(n), n_words)
            prefix = byte_prefix(data)
            # lines: they begin at each text and after each line feed
            begins = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], np.flatnonzero(data == 10) + 1]))
            begins = begins[begins < len(data)]
            ends = np.append(begins[1:], len(data))
            of_line = np.searchsorted(offs, begins, "right") - 1
            ends = np.minimum(ends, offs[of_line + 1])
            raw_ends = ends - ((ends > begins) & (data[np.maximum(ends, 1) - 1] == 10)) if len(data) else ends
            w0 = np.searchsorted(start, begins)
            w1 = np.searchsorted(start, ends)
            full = w1 > w0
            begins, raw_ends, of_line, w0, w1 = begins[full], raw_ends[full], of_line[full], w0[full], w1[full]
            raw = mix(span_hash(prefix, begins, raw_ends) + (raw_ends - begins).astype(U64))
            repeated, _ = _seen_before(raw, of_line)
            low = word_hashes(lower_ascii(data), start, end)
            normal = mix(span_hash(prefix_hash(low), w0, w1) + (w1 - w0).astype(U64))
            # windows of words that the text holds more than once
            exact = mix(span_hash(prefix, start, end) + (end - start).astype(U64))
            windows, at, _ = window_hashes(exact, first, REPEAT_WINDOW)
            _, again = _seen_before(windows, of_word[at])
            cover = np.zeros(len(start) + 1, np.int32)
            np.add.at(cover, at[again], 1)
            np.add.at(cover, at[again] + REPEAT_WINDOW, -1)
            repeats = np.cumsum(cover[:-1]) > 0
            count = lambda m, k: np.bincount(k[m], minlength=n).astype(np.int64)
            lines = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(of_line, minlength=n))])
            yield table(schema, [
                row + np.arange(n), batch.column(0), batch.column(1), n_words,
                _per_text(~_SPACE[data] & ((data & 0xC0) != 0x80), offs), _per_text(_SYMBOL[data], offs),
                count(repeated, of_line), count(repeats, of_word), list_of(normal.view(np.int64), lines, pa.int64()), list_of((w1 - w0).astype(np.int32), lines, pa.int32()),
            ])
            row += n

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), "text").mapInArrow(tidy(run), _STATS)


def quality(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, kept_share: float = KEPT_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept.

    docs: doc_id, text, source (the host); other columns are ignored.  A null or
    empty text has no words, so it fails the base rules; null hosts form one
    host.  Rows with a null doc_id are one document each.  Repeated rows each get
    their row and count as one document.  Texts of any length are gone through
    whole.  An empty table gives an empty one.  Counts of a line are summed before
    they are shuffled; the join with the lines above the limit is one that Spark
    can split where a line is very common.
    """
    stats = stored(text_statistics(docs), "statistics").withColumn("host", F.struct(F.col("host").isNull().alias("none"), F.coalesce("host", F.lit("")).alias("name")))
    held = stats.select("host", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", "row").alias("id")).alias("document"), F.explode(F.array_distinct("lines")).alias("line"))
    above = held.groupBy("host", "line").agg(F.countDistinct("document").alias("n")).filter(F.col("n") > max_documents).select("host", "line")
    each = stats.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = each.join(above, ["host", "line"], "left_semi").groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = stats.drop("lines", "line_words", "host").join(removed, "row", "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    enough = (F.col("n_words") - F.col("n_removed_words")) >= F.col("n_words") * kept_share
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_removed_words", (~failed & enough).alias("kept"))
