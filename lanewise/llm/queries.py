"""The queries of this subpackage and the SQL that some of them equal."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import inner_products, lexical, licenses, minhash, mixing, neighbours, packing, pii, quality, secrets, sharding, urls, whitening
from lanewise.llm.common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*columns)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"])


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_minhash_dedup, op2_source_mixing, op3_nearest_neighbours, op4_url_filter, op5_quality_rules, op6_license_scan, op7_packing, op8_pii, op9_sharding,
        op10_secret_scan, op11_exact_topk, op12_lexical_search, op13_whitening, pipeline,
    )
    return {f.__name__: f for f in found}


def _quoted(values: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _url_sql() -> str:
    rules = sorted(urls.HOST_RULES, key=lambda r: -len(r.host + r.path))
    cases = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in rules]
    rule = " ".join(f"WHEN {c} THEN '{r.host}{r.path}'" for c, r in cases)
    verdict = " ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in cases)
    topics = "|".join(urls.TOPICS)
    return rf"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN regexp_matches(host || path, '(?s)^([^/]*\.)?({topics})[^/]*\.[^/]*(/.*)?$') THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


def _quality_sql() -> str:
    stop = _quoted(sorted({w for line in quality.STOP_WORDS.values() for w in line.split()}))
    rules = []
    for r in quality.RULES:
        rules += [f"{r.numerator} >= {r.low}::DOUBLE * {r.denominator}"] if r.low is not None else []
        rules += [f"{r.numerator} <= {r.high}::DOUBLE * {r.denominator}"] if r.high is not None else []
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM again) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stop}))) AS n_stop_words,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM w LEFT JOIN covered ON covered.r = w.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(rules)} AS kept FROM f"""


def _license_sql() -> str:
    def plain(text: str) -> str:
        copyright_line = r"(?m)^[^\p{L}\p{N}\n]*(copyright\b|\(c\)|©)[^\n]*$"
        out = f"concat(' ', trim(regexp_replace(regexp_replace(lower({text}), '{copyright_line}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
        for old, new in licenses.SPELLINGS:
            end = "" if old[-1] == " " else " "
            out = f"replace({out}, ' {old}{end}', ' {new}{end}')"
        return f"trim({out})"

    known = ", ".join(f"({_quoted([k, t])})" for part in (licenses.KNOWN, licenses.WHOLE) for k, texts in part.items() for t in texts)
    return f"""
WITH known AS (SELECT plain, min(license) AS license FROM (SELECT {plain("t")} AS plain, license FROM (VALUES {known}) AS k(license, t)) GROUP BY plain),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1)::INTEGER AS line FROM documents),
units AS (SELECT doc_id, line, t FROM lines UNION ALL SELECT doc_id, 0, coalesce(text, '') FROM documents)
SELECT doc_id, line, license FROM (SELECT doc_id, line, {plain("t")} AS plain FROM units) JOIN known USING (plain) WHERE plain <> ''"""


def _shard_sql() -> str:
    held = ",".join(map(str, sharding.lookup_table(sharding.shard_names())))
    return f"""
WITH held AS (SELECT string_split('{held}', ',') AS shards),
placed AS (SELECT doc_id, source, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS})::INTEGER AS slot FROM documents)
SELECT doc_id, source, slot, shards[slot + 1]::INTEGER AS shard FROM placed, held"""


def _products_sql() -> str:
    return """
WITH rows AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM rows q JOIN rows c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def _lexical_sql() -> str:
    def terms(text: str) -> str:
        return rf"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{lexical.TERM}')"

    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {terms("text")} AS ts FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0),
corpus AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM sizes),
asked AS (SELECT DISTINCT item_id, unnest({terms("text")}) AS term FROM benchmark),
postings AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
weights AS (SELECT term, floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM postings GROUP BY term), corpus),
scored AS (SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // l)))))::BIGINT AS score
           FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (r), corpus GROUP BY item_id, r),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored JOIN sizes USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    rest = {"op11_exact_topk": _products_sql(), "op12_lexical_search": _lexical_sql()}
    return rest | {"op4_url_filter": _url_sql(), "op5_quality_rules": _quality_sql(), "op6_license_scan": _license_sql(), "op9_sharding": _shard_sql()}
