"""The operators over the given tables: one query each, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from smeltery.llm import bpe, decontamination, divergence, language, licenses, near_dups, packing, quality, substrings, toxicity, urls, warc, whitening
from smeltery.llm.folders import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import sys

    if "/opt/tokenizers" not in sys.path:
        sys.path.append("/opt/tokenizers")
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048))


@query(
    "op2_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM d),
    g AS (SELECT *, list_transform(range(8), lambda g: CAST(('0x' || substr(hex, CAST(5 * g + 1 AS BIGINT), 5)) AS BIGINT)) AS parts FROM f)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
           list_aggregate(list_transform(parts, lambda v:
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15), 1) ||
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1) ||
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1) ||
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM g
    """,
)
def warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = warc.archive_pages(table(spark, sf_dir, "pages"), folder)
    records = warc.page_records(archives, f"{folder}/archives/warc")
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


@query(
    "op6_url_rules",
    r"""
    WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, coalesce(rest, '') AS rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw_host FROM a),
    c AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM b),
    r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')) v(verdict, rule_host, rule_path)),
    m AS (SELECT page_id, max_by(rule_host || rule_path, len(string_split(rule_host, '.')) * 1000000 + length(rule_path)) AS rule,
                 max_by(verdict, len(string_split(rule_host, '.')) * 1000000 + length(rule_path)) AS verdict
          FROM c JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
    SELECT page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM c LEFT JOIN m USING (page_id)
    """,
)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op7_language")
def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    known = language.train(docs, ~toxicity.held_out())
    found = language.identify(docs.drop("lang"), known)
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "lang_pred", "score", "accepted")


@query("op10_substring_dedup")
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_near_dups")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85, shingle=3)


@query(
    "op5_decontamination",
    r"""
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    bl AS (SELECT item_id, w, least(10, len(w)) AS l FROM bw WHERE len(w) > 0),
    bs AS (SELECT item_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM bl),
    bg AS (SELECT DISTINCT item_id, l, array_to_string(w[s + 1 : s + l], ' ') AS g FROM bs),
    ds AS (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM dw, (SELECT DISTINCT l FROM bg) WHERE len(w) >= l),
    dg AS (SELECT doc_id, s, l, array_to_string(w[s + 1 : s + l], ' ') AS g FROM ds),
    hits AS (SELECT doc_id, s, l, item_id FROM dg JOIN bg USING (l, g)),
    places AS (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hits),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM places GROUP BY doc_id),
    i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
           sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
    """,
)
def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_benchmark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return decontamination.decontamination_digest(found)


@query("op8_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query(
    "op9_licenses",
    r"""
    WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n')) AS line FROM documents),
    s AS (SELECT doc_id, CASE trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g'))
            WHEN 'licensed under the apache license version 2 0' THEN 'Apache-2.0'
            WHEN 'released under the mit license' THEN 'MIT'
            WHEN 'this work is licensed under the gnu general public license version 3' THEN 'GPL-3.0-only'
            WHEN 'licensed under cc by nc 4 0' THEN 'CC-BY-NC-4.0' END AS license FROM p),
    g AS (SELECT doc_id, count(license) AS n, list_sort(list(DISTINCT license) FILTER (license IS NOT NULL)) AS l FROM s GROUP BY doc_id)
    SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, coalesce(array_to_string(l, ','), '') AS licenses FROM g
    """,
)
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join(F.array_sort("licenses"), ",").alias("licenses"))


@query("op11_bpe")
def bpe_ids_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    decoded = bpe.decode_ids(encoded, tokenizer_path())
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_whitening")
def whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query(
    "op13_source_divergence",
    r"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
    l AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
    lv AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang),
    c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN l ON l.lang = o.lang AND l.term = o.term GROUP BY ALL),
    t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
    f AS (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n,
                 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * lv.v) AS p
          FROM g JOIN l ON l.lang = g.lang JOIN lv ON lv.lang = g.lang
          LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM f a JOIN f b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
              FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 2)) // (lv.total + 2 * lv.v) AS q FROM l JOIN lv ON lv.lang = l.lang),
    terms AS (SELECT f.lang, f.source, 'term' AS part, f.term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value
              FROM f JOIN q ON q.lang = f.lang AND q.term = f.term WHERE f.n > 0 AND p > q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
               FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
)
def source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))
