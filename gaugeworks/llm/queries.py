"""The thin queries of the language-model data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import link_scores
from .byte_bpe import round_trip_digests
from .exact_dedup import exact_dedup
from .fingerprints import edited_likeness
from .html_text import extract_main_text
from .mixing import mix
from .packing import pack
from .quality import decisions
from .simhash import near_duplicates
from .spelling import spelling_variants
from .tables import table
from .token_counts import token_counts
from .token_file import token_file_digest
from .url_filter import judge_urls
from .url_filter import oracle as url_oracle


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op5_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digest(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_scores(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_token_counts": op2_token_counts,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_id_output": op5_token_id_output,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_url_filter": op9_url_filter,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLES: dict[str, str] = {
    "op1_source_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(source, '<null>') AS source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens
            FROM documents),
        t AS (
            SELECT source, sum(n_tokens)::BIGINT AS source_tokens, count(*) AS source_docs,
                   sum(n_tokens)::DOUBLE / (SELECT sum(n_tokens) FROM d)::DOUBLE AS p
            FROM d GROUP BY source),
        total AS (SELECT sum(n_tokens)::BIGINT AS budget FROM d),
        b(i, lo, hi) AS (
            SELECT 0, 0::DOUBLE, 1::DOUBLE
            UNION ALL
            SELECT i + 1,
                   CASE WHEN max(pow(p, (lo + hi) / 2 - 1)) / sum(pow(p, (lo + hi) / 2)) <= 1.25 + 1e-12 THEN lo ELSE (lo + hi) / 2 END,
                   CASE WHEN max(pow(p, (lo + hi) / 2 - 1)) / sum(pow(p, (lo + hi) / 2)) <= 1.25 + 1e-12 THEN (lo + hi) / 2 ELSE hi END
            FROM b, t WHERE i < 45 GROUP BY i, lo, hi),
        a AS (
            SELECT CASE WHEN (SELECT max(pow(p, -1)) / count(*) FROM t) <= 1.25 + 1e-12 THEN 0
                        ELSE (SELECT round(hi, 6) FROM b WHERE i = 45) END AS e),
        w AS (SELECT t.*, pow(p, e) / sum(pow(p, e)) OVER () AS weight FROM t, a),
        plan AS (
            SELECT source, source_tokens, weight, floor(weight * budget) AS part,
                   ceil(floor(weight * budget) / source_tokens)::INT AS epochs
            FROM w, total),
        passes AS (
            SELECT doc_id, source, n_tokens, weight, part, epoch,
                   ('0x' || substr(md5('1|' || epoch || '|' || doc_id), 1, 8))::UBIGINT AS u, source_tokens
            FROM d JOIN plan USING (source), LATERAL (SELECT unnest(range(epochs)) AS epoch)),
        placed AS (
            SELECT *, epoch * source_tokens + coalesce(sum(n_tokens) OVER (
                PARTITION BY source, epoch ORDER BY u, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM passes),
        taken AS (
            SELECT *, (start::HUGEINT * greatest(1, ceil(budget / 1000000.0))::HUGEINT // part::HUGEINT)::BIGINT AS block
            FROM placed, total WHERE start < part)
        SELECT doc_id, source, epoch::BIGINT AS epoch, n_tokens, round(weight, 9) AS weight, block,
               row_number() OVER (PARTITION BY block ORDER BY
                   ('0x' || substr(md5('1|slot|' || epoch || '|' || doc_id), 1, 8))::UBIGINT, doc_id, epoch) AS slot
        FROM taken""",
    "op9_url_filter": url_oracle(),
    "op10_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        w AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc AS (SELECT list(list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
        runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
                 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
        h AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END)), lambda b: b::BIGINT)),
                     lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc),
        v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word, n FROM h) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        gaps AS (SELECT word, n, i, left(word, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
        pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
            UNION SELECT g.word, v.word, v.n FROM gaps g JOIN v ON v.word = g.head || g.tail
            UNION SELECT v.word, g.word, g.n FROM gaps g JOIN v ON v.word = g.head || g.tail),
        best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
        chain AS (SELECT word, coalesce(form, word) AS root FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL AND chain.root <> chain.word),
        last AS (SELECT word, root FROM chain WHERE root IN (SELECT word FROM f WHERE form IS NULL))
        SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)""",
}
