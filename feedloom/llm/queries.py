"""The registered queries of this subpackage: thin contracts over the operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    return language_id(docs, train=~F.col("held_out"), keep=["doc_id", "held_out"])


#: The tree of op10: four domains by the source's number, languages, sources.
MIX_LEVELS = {"domain": "concat('d', try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4)", "lang": "lang", "source": "source"}
MIX_WEIGHTS = {("d0",): 0.3, ("d1",): 0.25, ("d2",): 0.25, ("d3",): 0.2}
LANG_WEIGHTS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}


def mix_arguments() -> dict:
    weights = dict(MIX_WEIGHTS) | {(*d, x): w for d in MIX_WEIGHTS for x, w in LANG_WEIGHTS.items()}
    return {"levels": {k: F.expr(v) for k, v in MIX_LEVELS.items()}, "weights": weights, "share": 0.8, "max_epochs": 2, "seed": 17}


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    out = mix_sources(_table(spark, sf_dir, "documents"), **mix_arguments())
    return out.select("doc_id", "lang", "source", "mix_tokens", "mix_epochs", "mix_copies", "leaf_budget")


def _mix_level(k: int, own: list[str]) -> str:
    parent = ", ".join(own[:k]) or "0"
    weight = ["CASE domain WHEN 'd0' THEN 0.3 WHEN 'd1' THEN 0.25 WHEN 'd2' THEN 0.25 WHEN 'd3' THEN 0.2 ELSE 1.0 END", "CASE WHEN domain IN ('d0', 'd1', 'd2', 'd3') AND language = 'en' THEN 0.55 WHEN domain IN ('d0', 'd1', 'd2', 'd3') AND language IN ('fr', 'de', 'es') THEN 0.15 ELSE 1.0 END", "1.0"][k]
    cols = ", ".join(own[: k + 1])
    before = "given" if k else "(SELECT least(sum(supply) * 0.8, sum(supply * 2.0)) FROM leaf)"
    source = f"(SELECT leaf.*, budget AS given FROM leaf JOIN b{k - 1} USING ({', '.join(own[:k])}))" if k else "leaf"
    return f"""n{k} AS (SELECT {cols}, CAST(sum(supply) * 2.0 AS DOUBLE) AS lim, {"first(given)" if k else before} AS given, CAST({weight} AS DOUBLE) AS w FROM {source} GROUP BY {cols}),
r{k} AS (SELECT *, lim / w AS ratio, (given - coalesce(sum(lim) OVER (PARTITION BY {parent} ORDER BY lim / w, {own[k]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (PARTITION BY {parent} ORDER BY lim / w, {own[k]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM n{k}),
t{k} AS (SELECT *, max(CASE WHEN lev <= ratio THEN lev END) OVER (PARTITION BY {parent}) AS top FROM r{k}),
b{k} AS (SELECT {cols}, CASE WHEN top IS NULL OR ratio <= top THEN lim ELSE greatest(0.0, top * w) END AS budget FROM t{k})"""


def _mix_sql() -> str:
    own = ["domain", "language", "src"]
    return f"""WITH base AS (SELECT doc_id, lang, source, CAST(ceil(coalesce(octet_length(encode(text)), 0) / 4.0) AS BIGINT) AS tok,
 coalesce('d' || (TRY_CAST(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4), '(null)') AS domain, coalesce(lang, '(null)') AS language, coalesce(source, '(null)') AS src FROM documents),
leaf AS (SELECT domain, language, src, CAST(sum(tok) AS DOUBLE) AS supply FROM base GROUP BY ALL HAVING sum(tok) > 0),
{", ".join(_mix_level(k, own) for k in range(3))},
plan AS (SELECT leaf.*, budget, CAST(floor(round(budget, 6) / supply) AS INT) AS e FROM leaf JOIN b2 USING (domain, language, src)),
cut AS (SELECT base.*, budget, e, CAST(floor(round(budget - e * supply, 6)) AS BIGINT) AS rest, md5('17:' || e || ':' || doc_id) AS ord FROM base LEFT JOIN plan USING (domain, language, src)),
cum AS (SELECT *, coalesce(sum(tok) OVER (PARTITION BY domain, language, src ORDER BY ord, doc_id, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cut)
SELECT doc_id, lang, source, tok AS mix_tokens, coalesce(e, 0) AS mix_epochs, coalesce(e, 0) + CAST(coalesce(before < rest, false) AS INT) AS mix_copies, round(coalesce(budget, 0.0), 3) AS leaf_budget FROM cum"""


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import suffix_dedup

    out = suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = _table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), k=5)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op7_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hamming import sign_code, top_k_codes

    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    out = top_k_codes(rows, rows.where("id % 50 = 0"), k=10)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


OP7_SQL = """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: abs(z[1] - z[2]))) AS INT) AS distance FROM b q JOIN b c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, distance FROM r WHERE rank <= 10"""

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


#: Says the rules; aliases (of which these tables hold none) are held against plain Python in the tests.
OP8_SQL = """WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(action, h, p)),
m AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)"""

def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quantise import codebooks_digest, vector_codes

    out, books = vector_codes(_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _op11_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    def nearest(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT id, part, CAST(min(v) % 1000 AS INT) AS entry, CAST(min(v) // 1000 AS BIGINT) AS d FROM
 (SELECT id, x.part, CAST(list_sum(list_transform(list_zip(x.ints, b.ints), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) * 1000 + b.entry AS v FROM x JOIN b{k} b USING (part)) GROUP BY id, part)"""

    def renewed(k: int) -> str:
        mean = f"SELECT part, entry, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT x.part, entry, place, CAST(sum(ints[place]) AS HUGEINT) AS s, count(*) AS n FROM x JOIN a{k - 1} USING (id, part), range(1, (SELECT max(len(ints)) FROM x) + 1) r(place) GROUP BY ALL)"
        return f"""m{k} AS (SELECT part, entry, list(m ORDER BY place) AS ints FROM ({mean}) GROUP BY part, entry),
b{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.ints, b.ints) AS ints FROM b{k - 1} b LEFT JOIN m{k} m USING (part, entry))"""

    steps = ",\n".join(f"{nearest(k - 1)},\n{renewed(k)}" for k in range(1, rounds + 1))
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT id, CAST(part AS INT) AS part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS ints FROM kept, range({parts}) t(part)),
b0 AS MATERIALIZED (SELECT part, CAST(id - 1 AS INT) AS entry, ints FROM x WHERE id <= {entries}),
{steps},
{nearest(rounds)},
own AS (SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY id),
digest AS (SELECT sha256(string_agg(array_to_string(ints, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN own USING (id), digest"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT k, lang, source, unnest(terms) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM kept GROUP BY lang),
sizes AS (SELECT lang, source, sum(n) AS all_n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (coalesce(sizes.all_n, 0) + v) AS p, 1 + 1000000000 * (total + 1) // (langs.all_n + v) AS q
 FROM g JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN sizes ON sizes.lang = g.lang AND sizes.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0) AS value FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = o.source
 UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = quality_scores(docs, labels, train=~F.col("held_out"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


_ALL = (op1_substring_dedup, op2_ngram_jaccard_join, op3_suffix_dedup, op4_nearest_neighbours, op5_packing, op6_lm_scoring, op7_hamming_top_k, op8_url_filters, op9_language_id, op10_source_mixing, op11_vector_codes, op12_source_divergence, op13_quality_classifier)
QUERIES: dict[str, Query] = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op7_hamming_top_k": OP7_SQL, "op8_url_filters": OP8_SQL, "op10_source_mixing": _mix_sql(), "op11_vector_codes": _op11_sql(), "op12_source_divergence": OP12_SQL}
