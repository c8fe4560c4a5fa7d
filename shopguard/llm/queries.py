"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can say it.

Each query reads its whole table and returns one row per document, vector or
copy. ``ORACLES`` has no entry for an operator that SQL cannot express; those
are tested against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopguard.llm import (
    alignment, bpe, decontaminate, exact_dedup, mixing, negatives, pii, quality, repeats, secrets, simhash, topk, warc)
from shopguard.llm.common import read_table

# Target weights of the mix: the one large source at four times the share of any other.
MIX_WEIGHTS = {"src0": 4.0}
MIX_SEED = 42


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole replicated corpus in its shuffled order, with each copy's place key."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.assign_components(read_table(spark, sf_dir, "documents"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of a crawl of all pages with the response it stands for."""
    pages = read_table(spark, sf_dir, "pages")
    return warc.digest(warc.resolve_revisits(warc.captures_of_pages(pages)))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of their decoding."""
    return bpe.digest_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every vector whose id is divisible by 100."""
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and randomness-test secrets of every document."""
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of it that stays."""
    return exact_dedup.assign_groups(read_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern and semi-Markov CRF personal data of every document."""
    return pii.digest(pii.find_personal_data(read_table(spark, sf_dir, "documents")))


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 400-byte strings that occur elsewhere."""
    return repeats.digest(repeats.remove_repeats(read_table(spark, sf_dir, "documents")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, site and combined quality of every document."""
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    return decontaminate.digest(decontaminate.find_contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive; every seventh row first takes the next label."""
    rows = read_table(spark, sf_dir, "embeddings")
    turned = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", turned))


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers in every document."""
    return alignment.digest(alignment.align(read_table(spark, sf_dir, "documents"), tokenizer_path(),
                                            tokenizer_path("piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_simhash_near_dedup, op3_warc_revisits, op4_bpe_round_trip,
                            op5_exact_top_k, op6_secret_scan, op7_exact_dedup, op8_personal_data, op9_repeat_removal,
                            op10_quality_classifier, op11_decontaminate, op12_hard_negatives, op13_align_tokenizers)}

# Words of normalised benchmark and document texts.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', " \
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_mix_sources": f"""
WITH RECURSIVE
counts AS (SELECT source, count(*) AS n,
                  CASE WHEN source = 'src0' THEN {MIX_WEIGHTS['src0']}::DOUBLE ELSE 1.0::DOUBLE END AS w
           FROM documents GROUP BY source),
rates AS (SELECT source, (((SELECT sum(n) FROM counts)::DOUBLE / (SELECT sum(w) FROM counts)) * w) / n AS rate
          FROM counts),
parts AS (SELECT source, ceil(rate / {mixing.PIECE}::DOUBLE)::BIGINT AS pieces,
                 rate / ceil(rate / {mixing.PIECE}::DOUBLE) AS mean FROM rates WHERE rate > 0),
steps AS (SELECT source, pieces, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM parts
          UNION ALL
          SELECT source, pieces, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1)
          FROM steps WHERE k + 1 < {mixing.STEPS}),
thresholds AS (SELECT source, any_value(pieces) AS pieces,
                      list(floor(c * {mixing.UNIT}::DOUBLE)::BIGINT ORDER BY k) AS t
               FROM steps GROUP BY source),
draws AS (SELECT d.*, th.t, unnest(range(1, th.pieces + 1)) AS j
          FROM documents d JOIN thresholds th ON d.source IS NOT DISTINCT FROM th.source),
hashed AS (SELECT * EXCLUDE (j), ('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null')
                  || ':' || j), 1, 13))::BIGINT AS u FROM draws),
counted AS (SELECT doc_id, text, lang, source, n_chars,
                   sum(len(list_filter(t, lambda x: x <= u)))::BIGINT AS copies
            FROM hashed GROUP BY ALL),
copied AS (SELECT doc_id, text, lang, source, n_chars,
                  unnest(range(1, copies + 1))::INTEGER AS copy FROM counted)
SELECT *, md5('order:{MIX_SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) AS mix_key
FROM copied""",
    "op3_warc_revisits": f"""
WITH base AS (SELECT page_id, url, sha256(coalesce(html, '')) AS d, length(coalesce(html, '')) AS size,
                     unnest(range(0, {warc.ROUNDS}))::INTEGER AS r FROM pages),
dealt AS (SELECT *, instr('0123456789abcdef', substr(md5(page_id || ':' || r), 1, 1)) - 1 AS kind,
                 instr('0123456789abcdef', substr(md5(page_id::VARCHAR), 1, 1)) - 1 AS tagged, r // 2 AS gen,
                 {warc.FIRST} + r::BIGINT * {warc.WEEK} + page_id % 86400 AS ts FROM base),
kinds AS (SELECT *, CASE r WHEN 0 THEN kind < 14 WHEN 1 THEN kind >= 12 WHEN 2 THEN kind < 8 ELSE false END AS is_full,
                 '"' || substr(md5(page_id || 'g' || gen), 1, 12) || '"' AS strong,
                 CASE r WHEN 1 THEN regexp_replace(url, '^https?', 'HTTPS') || '#r1'
                        WHEN 3 THEN regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
                                    || 'utm_source=crawl'
                        ELSE url END AS spelled FROM dealt),
captures AS (SELECT page_id * {warc.ROUNDS} + r AS record_id, ts, is_full, size, r, trim(spelled) AS u,
                    CASE WHEN tagged < 8 OR (tagged < 12 AND is_full) THEN strong
                         WHEN tagged < 12 THEN 'W/' || strong END AS etag,
                    CASE WHEN tagged < 15 THEN 'generation ' || gen END AS modified,
                    CASE WHEN is_full THEN sha256(d || gen) END AS payload_sha256 FROM kinds),
split AS (SELECT *, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)(\\?[^#]*)?' AS pat FROM captures),
params AS (SELECT *, list_sort(list_filter(string_split(substr(regexp_extract(u, pat, 3), 2), '&'),
                  lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|gclid|fbclid)(=|$)'))) AS q FROM split),
keyed AS (SELECT *, CASE WHEN regexp_matches(u, pat) THEN
                 regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, pat, 1)), '^.*@', ''),
                                ':(80|443)$', ''), '^www[0-9]*\\.', '')
                 || regexp_replace(regexp_extract(u, pat, 2), '/+$', '')
                 || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END
                 ELSE u END AS url_key FROM params),
pairs AS (SELECT v.*, b.record_id AS base_id, b.ts AS base_ts, b.etag AS b_etag, b.modified AS b_modified,
                 b.size AS b_size, b.payload_sha256 AS b_sha,
                 row_number() OVER (PARTITION BY v.record_id ORDER BY b.ts DESC NULLS LAST, b.record_id DESC) AS latest
          FROM keyed v LEFT JOIN keyed b ON b.is_full AND b.url_key = v.url_key AND b.ts < v.ts WHERE NOT v.is_full),
checked AS (SELECT *, CASE WHEN base_id IS NULL THEN NULL WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN 'etag'
                           WHEN modified IS NOT NULL AND b_modified IS NOT NULL THEN 'last_modified' ELSE 'none' END
                      AS validator FROM pairs WHERE latest = 1),
stated AS (SELECT *, CASE WHEN url_key IS NULL THEN 'no_url' WHEN base_id IS NULL THEN 'no_earlier_response'
                          WHEN (validator = 'etag' AND replace(etag, 'W/', '') <> replace(b_etag, 'W/', ''))
                            OR (validator = 'last_modified' AND modified <> b_modified) THEN 'validator_mismatch'
                          ELSE 'resolved' END AS state FROM checked)
SELECT record_id, url_key, ts, state, validator, base_id, base_ts,
       CASE WHEN state = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=' || (r * 60),
            'content-length: ' || b_size, 'content-type: text/html', 'date: ' || ts,
            'etag: ' || coalesce(etag, b_etag), 'last-modified: ' || coalesce(modified, b_modified)) END AS headers,
       CASE WHEN state = 'resolved' THEN b_sha END AS payload_sha256
FROM stated""".replace("\\\\", "\\"),
    "op5_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT vec_id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
           FROM cells q JOIN cells c ON q.i = c.i AND q.vec_id <> c.vec_id
           WHERE q.vec_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank
           FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op7_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256({_LOWER}) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY {_LOWER})""",
    "op11_decontaminate": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
places AS (SELECT *, least({decontaminate.WINDOW}, len(w)) AS m,
                  unnest(range(1, len(w) - least({decontaminate.WINDOW}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM places),
sizes AS (SELECT DISTINCT m FROM windows),
starts AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs CROSS JOIN sizes WHERE len(w) >= m),
grams AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM starts),
hits AS (SELECT r, m, i, item_id FROM grams JOIN windows USING (m, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN named USING (r)""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (SELECT vec_id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v),
scores AS (SELECT a.vec_id AS anchor_id, c.vec_id, sum(a.x * c.x)::BIGINT AS score
           FROM cells a JOIN cells c ON a.i = c.i AND a.vec_id <> c.vec_id
           WHERE a.vec_id % 100 = 0 GROUP BY ALL),
labelled AS (SELECT s.*, a.label = c.label AS same FROM scores s JOIN v a ON a.vec_id = s.anchor_id
             JOIN v c ON c.vec_id = s.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM labelled WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER pair)::INTEGER AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM positives p JOIN labelled n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW pair AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER pair <= 10""",
}
