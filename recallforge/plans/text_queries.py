"""Text and content-address queries over documents, pages and conversations."""

# ruff: noqa: E501
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text, vectors
from ..operators import search, store
from .registry import query, table

_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NOT_WS = _WS.replace("[", "[^", 1)


def _one_line(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _shortened(x: str, n: int) -> str:
    line = _one_line(x)
    return f"CASE WHEN length({line}) > {n} THEN substr({line}, 1, {n}) || '…' ELSE {line} END"


def _trim_all(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_SLUG = r"""COALESCE(NULLIF(translate(regexp_replace(regexp_replace(substr({x}, 1, 40), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g'),
 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), 'memory') || '-' || substr(sha256({x}), 1, 6)"""


def slug_sql(x: str) -> str:
    return _SLUG.format(x=x)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("SELECT source AS bank_id, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS slug, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents ORDER BY bank_id, slug")
def wiki_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slug = F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return docs.select(F.col("source").alias("bank_id"), slug.alias("slug"), F.octet_length("text").cast("long").alias("n_bytes")).orderBy("bank_id", "slug")


@query(f"SELECT doc_id, {slug_sql('text')} AS slug FROM documents")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query(f"SELECT slug, max(doc_id) AS last_write, count(*) AS writes, arg_max(strlen(text), doc_id)::BIGINT AS n_bytes FROM (SELECT *, {slug_sql('text')} AS slug FROM documents) GROUP BY slug")
def retain_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store.retain(_documents(spark, sf_dir).withColumnRenamed("text", "content"), "doc_id")
    return kept.select("slug", "last_write", "writes", F.octet_length("content").cast("long").alias("n_bytes"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT doc_id, 'ccr_' || substr(sha256(text), 1, 16) AS handle FROM documents")
def ccr_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", hashing.blob_handle(F.col("text")).alias("handle"))


_ODD_HANDLES = """SELECT doc_id, CASE substr(h, 5, 1) WHEN '0' THEN upper(h) WHEN '1' THEN substr(h, 1, 12) WHEN '2' THEN substr(h, 5) WHEN '3' THEN h || '0' ELSE h END AS handle
 FROM (SELECT doc_id, 'ccr_' || substr(sha256(text), 1, 16) AS h FROM documents)"""


def odd_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles of documents, some of them spoilt by rule."""
    h = hashing.blob_handle(F.col("text"))
    first = F.substring(h, 5, 1)
    spoilt = F.when(first == "0", F.upper(h)).when(first == "1", F.substring(h, 1, 12)).when(first == "2", F.substring(h, 5, 99)).when(first == "3", F.concat(h, F.lit("0"))).otherwise(h)
    return _documents(spark, sf_dir).select("doc_id", spoilt.alias("handle"))


@query(f"SELECT doc_id, handle, regexp_matches(handle, '^ccr_[0-9a-f]{{16}}$') AS valid FROM ({_ODD_HANDLES})")
def ccr_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_handles(spark, sf_dir).select("doc_id", "handle", hashing.is_handle(F.col("handle")).alias("valid"))


@query("SELECT doc_id, 'objects/' || substr(h, 1, 2) || '/' || substr(h, 3, 2) || '/' || h || '.bin' AS path FROM (SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents)")
def ccr_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", hashing.shard_path(hashing.blob_handle(F.col("text"))).alias("path"))


@query(f"SELECT doc_id, {_shortened('text', 60)} AS summary FROM documents")
def summarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.summarize(F.col("text")).alias("summary"))


@query(f"SELECT doc_id, {_shortened('text', 120)} AS snippet FROM documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


_FRONT = "CASE lang WHEN 'en' THEN chr(45)||'--' || chr(10) || 'lang: ' || lang || chr(10) || '---' || chr(10) || chr(10) || text WHEN 'fr' THEN '---' || chr(10) || '---' || chr(10) || text ELSE text END"


@query(rf"SELECT doc_id, regexp_replace({_FRONT}, '(?s)\A---\n.*?\n---\n{_WS}*', '') AS body FROM documents")
def strip_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    front = F.when(F.col("lang") == "en", F.concat(F.lit("---\nlang: "), "lang", F.lit("\n---\n\n"), "text")).when(F.col("lang") == "fr", F.concat(F.lit("---\n---\n"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", text.strip_frontmatter(front).alias("body"))


_SENTENCES = rf"""SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+'), lambda s: {_trim_all('s')}),
 lambda s: len(regexp_extract_all(s, '{_NOT_WS}+')) BETWEEN 8 AND 40) AS found FROM documents"""


@query(f"SELECT doc_id, CAST(i - 1 AS BIGINT) AS n, found[i] AS sentence FROM (SELECT doc_id, found, unnest(range(1, len(found) + 1)) AS i FROM ({_SENTENCES}))")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence")).withColumn("n", F.col("n").cast("long"))


_DISTINCT = rf"""(WITH s AS (SELECT doc_id, i, found[i] AS sentence FROM (SELECT doc_id, found, unnest(range(1, len(found) + 1)) AS i FROM ({_SENTENCES}))),
k AS (SELECT *, {_trim_all("regexp_replace(lower(sentence), '" + _WS.replace("[", "[^" + chr(92) + "p{L}" + chr(92) + "p{N}", 1) + "', '', 'g')")} AS key FROM s)
SELECT doc_id, i, sentence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY i) AS r FROM k WHERE key <> '') WHERE r = 1)"""


@query(f"SELECT doc_id, sentence FROM {_DISTINCT}")
def concept_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.explode(text.distinct_sentences(text.sentences(F.col("text")))).alias("sentence"))


@query(r"SELECT doc_id, CAST(i - 1 AS BIGINT) AS n, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\f\r]+') AS w FROM documents))")
def word_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(text.window_words(F.col("text"))).alias("n", "word")).withColumn("n", F.col("n").cast("long"))


@query(rf"""WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[ \t\n\f\r]*[^ \t\n\f\r]+') AS w FROM documents),
i AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 80 THEN 1 ELSE 1 + CAST(ceil((len(w) - 80) / 60.0) AS BIGINT) END)) AS i FROM t WHERE len(w) > 0),
o AS (SELECT doc_id, i, CASE WHEN len(w) <= 80 THEN text ELSE regexp_replace(regexp_replace(array_to_string(w[i * 60 + 1 : i * 60 + 80], ''), '^[ \t\n\f\r]+', ''), '{_WS}+$', '') END AS body,
 CASE WHEN len(w) <= 80 THEN 0 ELSE strlen(array_to_string(w[1 : i * 60], '')) + strlen(regexp_extract(w[i * 60 + 1], '^[ \t\n\f\r]*')) END AS "offset" FROM i)
SELECT doc_id, CAST(i AS BIGINT) AS n, CAST("offset" AS BIGINT) AS "offset", CAST("offset" + strlen(body) AS BIGINT) AS end_offset, body AS "window" FROM o""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _documents(spark, sf_dir).select("doc_id", F.posexplode(text.windows(F.col("text"))).alias("n", "w"))
    return cut.select("doc_id", F.col("n").cast("long").alias("n"), "w.offset", "w.end_offset", F.col("w.text").alias("window"))


@query(r"SELECT page_id, array_to_string(p[greatest(len(p) - 1, 1) : len(p)], '-') AS slug FROM (SELECT page_id, regexp_split_to_array(regexp_replace(regexp_replace(url, '(?:\.git)+$', ''), '/+$', ''), '[/:]') AS p FROM pages)")
def remote_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.remote_slug(F.col("url")).alias("slug"))


@query("""WITH q AS (SELECT arg_min(embedding, vec_id) AS q FROM embeddings)
SELECT vec_id, round(CAST(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS DOUBLE), 9) AS score FROM embeddings, q""")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.agg(F.min_by("embedding", "vec_id").alias("q"))
    score = vectors.cosine(vectors.doubles(F.col("embedding")), vectors.doubles(F.col("q")))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(score, 9).alias("score"))


@query("""WITH p AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
m AS (SELECT label, i, avg(e[i]) AS x FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM p) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
SELECT label, CAST(i - 1 AS INTEGER) AS i, round(x / n, 9) AS x FROM m JOIN n USING (label)""")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label, at length 1."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode(vectors.doubles(F.col("embedding"))).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return means.select("label", F.posexplode(vectors.l2_normalize(F.col("v"))).alias("i", "x")).withColumn("x", F.round("x", 9))


_TF = """SELECT {k}, CAST('0x' || substr(md5(term), 1, 4) AS INTEGER) % 256 AS bucket, count(*) AS tf
 FROM (SELECT {k}, unnest(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {f}) GROUP BY ALL"""


def hashed_sql(keys: str, text_: str, source: str) -> str:
    """(keys, bucket, weight) of the offline embedder."""
    return f"SELECT {keys}, bucket, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {keys})) AS weight FROM ({_TF.format(k=keys, t=text_, f=source)})"


@query(f"SELECT doc_id, bucket, round(CAST(weight AS DOUBLE), 9) AS weight FROM ({hashed_sql('doc_id', 'text', 'documents')})")
def embed_hashed_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hashed_terms(_documents(spark, sf_dir), ["doc_id"]).withColumn("weight", F.round("weight", 9))


#: (id, n, concept): a document's distinct sentences, but those that are similar to a kept one before them.
CONCEPTS_SQL = f"""WITH s AS {_DISTINCT}, v AS ({hashed_sql('doc_id, i', 'sentence', 's')}),
p AS (SELECT x.doc_id, x.i AS earlier, y.i FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.bucket = y.bucket AND x.i < y.i GROUP BY ALL HAVING round(CAST(sum(x.weight * y.weight) AS DOUBLE), 12) >= 0.8),
e AS (SELECT doc_id, i, list(earlier) AS earlier FROM p GROUP BY doc_id, i),
f AS (SELECT doc_id, list({{'kept': []::BIGINT[], 'i': i, 'earlier': coalesce(earlier, [])}} ORDER BY i) AS items FROM s LEFT JOIN e USING (doc_id, i) GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(list_prepend({{'kept': []::BIGINT[], 'i': 0::BIGINT, 'earlier': []::BIGINT[]}}, items),
 lambda a, x: {{'kept': CASE WHEN list_has_any(a.kept, x.earlier) THEN a.kept ELSE list_append(a.kept, x.i) END, 'i': 0::BIGINT, 'earlier': []::BIGINT[]}}).kept) AS i FROM f)
SELECT doc_id AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS n, sentence AS concept FROM k JOIN s USING (doc_id, i)"""


@query(CONCEPTS_SQL)
def concept_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.concept_split(_documents(spark, sf_dir).toDF("id", "content"))
