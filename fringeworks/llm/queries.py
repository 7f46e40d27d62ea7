"""Queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hamming, langid, merkle, minhash, packing, quality, rankqueue, repair, substring, suffix, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts differ much in length, so batches for Python workers are bounded in bytes.

    A table that Spark reads in fewer parts than there are cores is dealt out to all of them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    rows, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenate-and-cut packing of all documents; each piece's ids as a CRC-32."""
    pieces = packing.pack(read(spark, sf_dir, "documents"), ids_as="binary")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return minhash.components(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and the cross-document line-frequency verdict."""
    out = quality.quality(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of 50-word windows that a document with a smaller id holds too."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return substring.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of all documents and decoding of their ids, as digests."""
    coded = bpe.round_trip(read(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the order of replies, without quotes; paths as turns joined by points."""
    return chat.reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("path", F.concat_ws(".", F.col("path").cast("array<string>")))


def op7_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every hundredth vector."""
    rows = read(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.filter("vec_id % 100 = 0"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as seekable WARC bundles and read back from them."""
    _, records, _ = warc.archive(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    return langid.identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of byte strings of 400 bytes and more that occur twice."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return suffix.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents, and their proofs folded, some after tampering."""
    return merkle.verified(read(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired by the cheapest edits."""
    return repair.repaired(repair.damaged(read(spark, sf_dir, "conversations")))


def op13_rankqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level encoding of all documents and decoding of their ids, as digests."""
    coded = rankqueue.round_trip(read(spark, sf_dir, "documents"), ids_as="decimal")
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_minhash": op2_minhash,
    "op3_quality": op3_quality,
    "op4_substring": op4_substring,
    "op5_bpe": op5_bpe,
    "op6_chat": op6_chat,
    "op7_hamming": op7_hamming,
    "op8_warc": op8_warc,
    "op9_language": op9_language,
    "op10_suffix": op10_suffix,
    "op11_merkle": op11_merkle,
    "op12_repair": op12_repair,
    "op13_rankqueue": op13_rankqueue,
}

#: In SQL: the table of the reflected CRC-32 polynomial, and the CRC-32 of an ASCII string over it.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _merkle_sql() -> str:
    def leaf(more: str) -> str:
        fields = ("doc_id", "source", "lang", f"n_chars + {more}", "text")
        return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in fields) + ")"

    def tree(name: str, source: str) -> str:
        return f"""{name} AS (SELECT 0 AS level, g, pos, total, hash FROM {source} UNION ALL
            SELECT level + 1, g, pos // 2, (total + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM {name} WHERE total > 1 GROUP BY level, g, pos // 2, total)"""

    def walk(name: str, start: str, nodes: str) -> str:
        return f"""{name} AS (SELECT id, g, 0 AS level, pos, total, proof, own FROM ({start}) UNION ALL
            SELECT id, w.g, w.level + 1, w.pos // 2, (w.total + 1) // 2, proof || coalesce(hash, ''), sha256(CASE WHEN w.pos % 2 = 1 THEN hash || own ELSE own || coalesce(hash, '') END)
            FROM {name} w LEFT JOIN {nodes} t ON t.g = w.g AND t.level = w.level AND t.pos = xor(w.pos, 1) WHERE w.total > 1)"""

    return f"""
        WITH RECURSIVE {_CRC_TABLE},
        hashed AS (SELECT doc_id, coalesce('v' || lang, '-') AS g, {leaf("0")} AS hash, CASE WHEN doc_id IS NOT NULL AND {_crc("doc_id::VARCHAR")} % 7 = 0 THEN {leaf("1")} ELSE {leaf("0")} END AS changed FROM documents, crc),
        leaves AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY g) AS total FROM hashed),
        {tree("tree", "leaves")},
        langs AS (SELECT g AS lang, '' AS g, hash, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1),
        {tree("upper_tree", "langs")},
        {walk("walk", "SELECT id, g, pos, total, '' AS proof, changed AS own FROM leaves", "tree")},
        {walk("upper_walk", "SELECT w.id, l.g, l.pos, l.total, w.proof, w.own FROM walk w JOIN langs l ON l.lang = w.g WHERE w.total = 1", "upper_tree")},
        root AS (SELECT hash AS root FROM upper_tree WHERE total = 1)
        SELECT doc_id, l.hash AS leaf, s.hash AS subroot, root, sha256(w.proof) AS proof_sha256, w.own AS folded_root, w.own = root AS verified
        FROM leaves l JOIN langs s ON s.lang = l.g JOIN upper_walk w ON w.id = l.id AND w.total = 1, root"""


def _repair_sql() -> str:
    def edits(state: int) -> str:
        """The least of the edits of a row from a state, before rows are inserted."""
        keep = {0: "WHEN 's' THEN f1 WHEN 'u' THEN f2", 1: "WHEN 'u' THEN f2", 2: "WHEN 'a' THEN f3", 3: "WHEN 'u' THEN f2"}[state]
        role = "f3" if state == 2 else "f2"
        return f"""least({{'c': f{state}.c + 2, 'a': 'D' || f{state}.a}},
            CASE WHEN NOT gone THEN {{'c': {role}.c + 1 + more, 'a': 'R' || {role}.a}} ELSE never END,
            CASE WHEN NOT gone AND (CASE who {keep} END) IS NOT NULL THEN {{'c': (CASE who {keep} END).c + more, 'a': 'K' || (CASE who {keep} END).a}} ELSE never END)"""

    insert = lambda g: f"{{'c': {g}.c + 5, 'a': 'I' || {g}.a}}"
    return f"""
        WITH RECURSIVE {_CRC_TABLE},
        kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc),
        present AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
                    FROM kinds, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
        rows AS (SELECT coalesce('v' || conv_id, '-') AS k, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
                        CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS who, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM present),
        told AS (SELECT *, min(i) OVER (PARTITION BY k, role, text) < i AS again FROM rows),
        faults AS (SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS truncated FROM told),
        symbols AS (SELECT *, blank OR duplicate AS gone, CASE WHEN truncated THEN 5 ELSE 0 END AS more FROM faults),
        sizes AS (SELECT coalesce('v' || c.conv_id, '-') AS k, c.conv_id, coalesce(max(i), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows r ON r.k = coalesce('v' || c.conv_id, '-') GROUP BY ALL),
        best AS (SELECT k, n AS i, {{'c': 0::BIGINT, 'a': ''}} AS f0, {{'c': 10::BIGINT, 'a': 'II'}} AS f1, {{'c': 5::BIGINT, 'a': 'I'}} AS f2, {{'c': 0::BIGINT, 'a': ''}} AS f3 FROM sizes UNION ALL
            SELECT k, i - 1, least(g0, {insert("h2")}), least(g1, {insert("h2")}), h2, h3 FROM (
                SELECT *, least(g2, {insert("g3")}) AS h2, least(g3, {insert("g2")}) AS h3 FROM (
                    SELECT k, i, {edits(0)} AS g0, {edits(1)} AS g1, {edits(2)} AS g2, {edits(3)} AS g3
                    FROM best JOIN symbols USING (k, i), (SELECT {{'c': 1000000000::BIGINT, 'a': 'Z'}} AS never)))),
        plans AS (SELECT k, conv_id, n, f0.c AS cost, f0.a AS audit FROM best JOIN sizes USING (k) WHERE best.i = 0),
        replay AS (SELECT k, audit, 1 AS step, 1::BIGINT AS i, '' AS before, []::VARCHAR[] AS lines FROM plans UNION ALL
            SELECT p.k, audit, step + 1, CASE WHEN audit[step] = 'I' THEN p.i ELSE p.i + 1 END,
                   CASE audit[step] WHEN 'D' THEN before WHEN 'K' THEN r.who ELSE CASE before WHEN 'u' THEN 'a' ELSE 'u' END END,
                   CASE audit[step] WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, r.role || ':' || r.text)
                        ELSE list_append(lines, CASE before WHEN 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN audit[step] = 'R' THEN r.text ELSE '' END) END
            FROM replay p LEFT JOIN rows r ON r.k = p.k AND r.i = p.i WHERE step <= length(audit)),
        pairs AS (SELECT k, lag(who) OVER (PARTITION BY k ORDER BY i) || who AS pair FROM rows),
        counted AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated FROM symbols GROUP BY k)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               (SELECT count(*) FROM pairs q WHERE q.k = p.k AND pair NOT IN ('su', 'ua', 'au')) AS illegal, cost, p.audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
        FROM plans p JOIN replay r USING (k) LEFT JOIN counted USING (k) WHERE r.step = length(p.audit) + 1"""


#: DuckDB SQL for those queries that SQL can express on whole tables.
SQL: dict[str, str] = {
    "op11_merkle": _merkle_sql(),
    "op12_repair": _repair_sql(),
    "op6_chat": r"""
        WITH RECURSIVE messages AS (SELECT row_number() OVER () AS id, * FROM conversations),
        split AS (SELECT id, conv_id, turn, string_split_regex(coalesce(text, ''), '\r?\n') AS parts FROM messages),
        lines AS (SELECT id, conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
        levels AS (SELECT id, conv_id, turn, i, regexp_replace(line, '^[ \t]{0,3}((?:>[ \t]?)+)', '') AS body,
                          CASE WHEN regexp_matches(line, '(?i)^on .+ wrote:\s*$') THEN -1
                               ELSE length(regexp_replace(regexp_extract(line, '^[ \t]{0,3}((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) END AS level FROM lines),
        raw AS (SELECT id, conv_id, turn, level, string_agg(body, ' ' ORDER BY i) AS said, true AS whole FROM levels WHERE level >= 0 GROUP BY ALL
                UNION ALL SELECT id, conv_id, turn, level, body, false FROM levels WHERE level >= 0),
        passages AS (SELECT conv_id, turn, level, trim(regexp_replace(lower(said), '\s+', ' ', 'g')) AS passage, whole FROM raw WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        quotes AS (SELECT conv_id, turn, passage, min(level) AS level FROM passages WHERE level > 0 AND passage <> '' AND (whole OR length(passage) >= 12) GROUP BY ALL),
        originals AS (SELECT conv_id, passage, min(turn) AS original FROM passages WHERE level = 0 AND passage <> '' GROUP BY ALL),
        strength AS (SELECT q.conv_id, q.turn, original, min(level) AS level, sum(length(passage)) AS size
                     FROM quotes q JOIN originals USING (conv_id, passage) WHERE original < turn GROUP BY ALL),
        replies AS (SELECT conv_id, turn, original AS reply_to FROM strength
                    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, size DESC, original DESC) = 1),
        walks AS (SELECT conv_id, turn, reply_to AS top, [reply_to, turn] AS path FROM replies
                  UNION ALL SELECT w.conv_id, w.turn, r.reply_to, list_prepend(r.reply_to, w.path) FROM walks w JOIN replies r ON r.conv_id = w.conv_id AND r.turn = w.top),
        paths AS (SELECT conv_id, turn, path FROM walks QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY len(path) DESC) = 1),
        bodies AS (SELECT id, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0), '') AS body, count(*) FILTER (level > 0) AS n_quoted FROM levels GROUP BY id),
        found AS (SELECT m.conv_id, m.turn, coalesce(m.role, 'user') AS role, regexp_replace(trim(regexp_replace(body, '\n{3,}', chr(10) || chr(10), 'g')), '^\n+|\n+$', '', 'g') AS text, reply_to,
                         coalesce(p.path, CASE WHEN m.conv_id IS NOT NULL AND m.turn IS NOT NULL THEN [m.turn] ELSE [] END) AS path, n_quoted
                  FROM messages m JOIN bodies USING (id) LEFT JOIN paths p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN replies r ON r.conv_id = m.conv_id AND r.turn = m.turn)
        SELECT conv_id, turn, role, text, reply_to, path[1] AS thread, CAST(len(path) - 1 AS BIGINT) AS depth, array_to_string(path, '.') AS path, n_quoted,
               '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS formatted FROM found""",
    "op7_hamming": """
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
                SELECT q.vec_id AS query_id, e.vec_id,
                       len(list_filter(range(1, 65), lambda i: (q.embedding[i] > 0) <> (e.embedding[i] > 0))) AS distance
                FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0))
        WHERE rank <= 10""",
}
