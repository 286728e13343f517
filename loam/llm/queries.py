"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.llm.common import text_or_empty


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, lanes=1, max_distance=4, segments=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.exact import exact_dedup

    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.withColumnRenamed("digest", "text_sha256")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.lines import apply_bitmaps, line_dedup

    docs = table(spark, sf_dir, "documents")
    kept = apply_bitmaps(docs, line_dedup(docs, min_chars=40, min_docs=5))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20, scale=64)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.suffix import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"), window=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.warc import archive_pages

    found = archive_pages(table(spark, sf_dir, "pages"), payloads=False, min_revisit_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), capacity=4096, per_source=4)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loam.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.importance import resample

    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=2, buckets=10_000, percent=25, min_words=20, seed=7, carry=("doc_id",))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.llm.conversations import repair

    return repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_topk": op5_topk,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_quality": op10_quality,
    "op11_token_counts": op11_token_counts,
    "op12_importance": op12_importance,
    "op13_conversations": op13_conversations,
}

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"



def _crc_table() -> str:
    """The 256 steps of CRC-32, from its polynomial, as an SQL list."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return f"{out}::BIGINT[]"


def _crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes; ``text`` is a column's name."""
    byte = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c >> 8, ({_crc_table()})[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def _way(state: str, cost: str, letter: str, line: str = "''") -> str:
    """SQL for a path of op13 that goes on by an edit."""
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {line}}}"


_NO_WAY = "{'c': 1000000000, 'a': '', 't': ''}"
_SPACES = "e' \\t\\n\\x0b\\f\\r'"
_KEEP, _AS_USER, _AS_ASSISTANT = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"


def _turned(states: str, to: str, initial: str) -> str:
    """SQL for the rows of op13 that are kept or get another role, from each of the states."""
    found = []
    for s in states.split():
        found.append(f"CASE WHEN fault NOT IN (1, 2) THEN {_way(s, '2 + cut', 'R', to)} ELSE {_NO_WAY} END")
        found.append(f"CASE WHEN fault NOT IN (1, 2) AND ini = '{initial}' THEN {_way(s, 'cut', 'K', _KEEP)} ELSE {_NO_WAY} END")
    return ", ".join(found)


ORACLE_SQL = {
    "op2_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)""",
    "op3_mixing": f"""
        WITH sized AS (
            SELECT doc_id, source, {WORDS}::BIGINT AS size,
                   ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
            FROM documents),
        per_source AS (
            SELECT source, sum(size)::BIGINT AS total,
                   [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
                   row_number() OVER (ORDER BY source NULLS LAST) AS turn
            FROM sized GROUP BY source),
        level AS (
            SELECT *, (1.5::DOUBLE * (SELECT sum(total) FROM per_source)::DOUBLE
                       - coalesce(sum(2.0::DOUBLE * total) OVER (ORDER BY 2.0::DOUBLE * total / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
                      / sum(weight) OVER (ORDER BY 2.0::DOUBLE * total / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
            FROM per_source),
        target AS (
            SELECT source, total, least(2.0::DOUBLE * total, weight * (
                       SELECT arg_min(lvl, (2.0::DOUBLE * total / weight, turn)) FROM level WHERE lvl <= 2.0::DOUBLE * total / weight)) AS target
            FROM level),
        plan AS (
            SELECT *, CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS copies FROM target),
        walk AS (
            SELECT s.doc_id, s.size, p.total, p.target, p.copies, p.target - p.copies * p.total AS budget,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE UNBOUNDED PRECEDING) AS upto,
                   sum(s.size) OVER (PARTITION BY s.source, s.h) AS own
            FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
        chosen AS (
            SELECT *, CASE WHEN upto <= budget THEN 1
                           WHEN upto - own <= budget AND 2 * (budget - upto + own) >= own THEN 1 ELSE 0 END AS more
            FROM walk)
        SELECT doc_id, size, total AS source_size, target, (copies + more)::BIGINT AS copies, ((copies + more) * size)::BIGINT AS taken
        FROM chosen""",
    "op4_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, i AS pos, l[i] AS line, translate(trim(l[i], e' \\t\\n\\x0b\\f\\r'), {AZ}) AS k
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) t, range(1, len(l) + 1) r(i)),
        shared AS (
            SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (
            SELECT doc_id, pos, line, coalesce(doc_id <> keep, false) AS lost FROM lines LEFT JOIN shared USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda z: z[1] * z[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (
            SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
                   max(page_id) OVER (PARTITION BY body) AS keep FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda b:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (5 * g + 1)::INT, 5))::BIGINT >> b) & 31)::INT + 1, 1)), '')), '')
                   AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
        FROM d""",
    "op12_importance": f"""
        WITH texts AS (
            SELECT false AS target, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
            UNION ALL SELECT true, item_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
        grams AS (
            SELECT target, id, unnest(w) AS f FROM texts
            UNION ALL SELECT target, id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) FROM texts WHERE len(w) > 1),
        hashed AS (SELECT f, {_crc('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM grams)),
        features AS (SELECT target, id, bucket FROM grams JOIN hashed USING (f)),
        counts AS (
            SELECT b.bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t
            FROM range(10000) b(bucket) LEFT JOIN features USING (bucket) GROUP BY b.bucket),
        gain AS (
            SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
            FROM counts),
        weighed AS (
            SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM features JOIN gain USING (bucket) WHERE NOT target GROUP BY id),
        scored AS (
            SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
                   coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)::BIGINT AS weight,
                   ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT AS h
            FROM texts LEFT JOIN weighed USING (id) WHERE NOT target),
        noisy AS (
            SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM noisy)
        SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM ranked""",
    "op13_conversations": f"""
        WITH RECURSIVE told AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS label FROM conversations),
        kinds AS (SELECT *, {_crc('label')} % 20 AS kind FROM told),
        hurt AS (
            SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS k, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM kinds, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
        placed AS (
            SELECT *, left(role, 1) AS ini, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM hurt),
        marked AS (
            SELECT *, lag(ini) OVER (PARTITION BY k ORDER BY i) || ini AS pair,
                   CASE WHEN trim(text, {_SPACES}) = '' THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2
                        WHEN right(rtrim(text, {_SPACES}), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault
            FROM placed),
        faults AS (SELECT *, CASE fault WHEN 3 THEN 1 ELSE 0 END AS cut FROM marked),
        walk AS (
            SELECT DISTINCT k, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS s0, {_NO_WAY} AS s1, {_NO_WAY} AS s2, {_NO_WAY} AS s3 FROM faults
            UNION ALL
            SELECT k, i,
                   {_way('s0', '3', 'D')},
                   least({_way('s1', '3', 'D')}, CASE WHEN fault NOT IN (1, 2) AND ini = 's' THEN {_way('s0', 'cut', 'K', _KEEP)} ELSE {_NO_WAY} END),
                   least({_way('u', '3', 'D')}, {_turned('s0 s1 s3', _AS_USER, 'u')}, {_turned('a', _AS_USER, 'u')}),
                   least({_way('a', '3', 'D')}, {_turned('u', _AS_ASSISTANT, 'a')})
            FROM (SELECT *, least(s3, {_way('u', '2', 'I', "chr(10) || 'assistant:'")}) AS a
                  FROM (SELECT w.s0, w.s1, w.s3, f.*, least(w.s2, {_way('w.s0', '2', 'I', "chr(10) || 'user:'")}, {_way('w.s1', '2', 'I', "chr(10) || 'user:'")}, {_way('w.s3', '2', 'I', "chr(10) || 'user:'")}) AS u
                        FROM walk w JOIN faults f ON f.k = w.k AND f.i = w.i + 1))),
        sums AS (
            SELECT k, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                   count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY k),
        ended AS (
            SELECT sums.*, least(s0, s3, {_way('u', '2', 'I', "chr(10) || 'assistant:'")}) AS e
            FROM (SELECT *, least(s2, {_way('s0', '2', 'I', "chr(10) || 'user:'")}, {_way('s1', '2', 'I', "chr(10) || 'user:'")}, {_way('s3', '2', 'I', "chr(10) || 'user:'")}) AS u FROM walk) w
            JOIN sums ON sums.k = w.k AND sums.n = w.i)
        SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS k FROM conversations) LEFT JOIN ended USING (k)""",
}
