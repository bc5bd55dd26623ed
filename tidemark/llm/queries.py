"""The registered queries of this subpackage, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate,
    exact_dedup,
    hnsw,
    html_wrappers,
    licenses,
    mixing,
    ngram_join,
    runs,
    shards,
    token_counts,
    toxicity,
    warc_zip,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def _canonical_sql(text: str) -> str:
    """The canonical form of ``licenses`` in DuckDB's dialect."""
    out = f"regexp_replace(lower({text}), '{licenses.COPYRIGHT_LINE}', '', 'g')"
    out = f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    for _, pattern, plain in licenses.SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{plain.replace('$', chr(92))}', 'g')"
    return out


_KNOWN = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in licenses.KNOWN)


@query(f"""
WITH k AS (
  SELECT sha256(c) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_canonical_sql("t")} AS c FROM (VALUES {_KNOWN}) v(license_id, t)) WHERE c <> '' GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line FROM d),
n AS (
  SELECT doc_id, t, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT doc_id, t, sha256({_canonical_sql("line")}) AS digest FROM lines) JOIN k USING (digest) GROUP BY ALL)
SELECT d.doc_id, sha256({_canonical_sql("d.t")}) AS text_digest, k.license_id,
       coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM d LEFT JOIN k ON k.digest = sha256({_canonical_sql("d.t")}) LEFT JOIN n ON n.doc_id = d.doc_id AND n.t = d.t
""")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def vocabulary() -> str:
    """Path of the tokenizer file the queries count with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = token_counts.prefix_tables(table(spark, sf_dir, "documents"), vocabulary())
    return tables.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY 1)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = q.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> q.page_id THEN f.first_id END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
""")
def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_zip.archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op8_main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_wrappers.main_texts(table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for documents labelled good, a half for those labelled bad."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


@query("""
WITH l AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS weight FROM labels GROUP BY 1),
d AS (
  SELECT d.doc_id, d.source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 'w', 'g'), '[\\x20\\x09-\\x0D]', '', 'g')) AS size,
         -ln((('0x' || substr(md5('mix|' || d.doc_id), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0::DOUBLE) / coalesce(l.weight, 1.0::DOUBLE) AS k
  FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::HUGEINT AS z FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, sum(z) OVER () AS total FROM s),
o AS (
  SELECT *, coalesce(sum(z) OVER p, 0) AS zb, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS wl
  FROM w WINDOW p AS (ORDER BY z::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT *, min(CASE WHEN 200 * z * wl <= w * (150 * total - 200 * zb) THEN 1 ELSE 0 END) OVER (ORDER BY z::DOUBLE / w, source NULLS LAST) = 1 AS full_
  FROM o),
t AS (
  SELECT source, z, CASE WHEN full_ THEN (2 * z)::DOUBLE
         ELSE (w * (150 * total - 200 * sum(CASE WHEN full_ THEN z ELSE 0 END) OVER ()))::DOUBLE
              / (100 * sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ())::DOUBLE END AS target FROM f),
e AS (SELECT *, CASE WHEN z > 0 THEN floor(target)::BIGINT // z ELSE 0 END AS epochs FROM t),
b AS (
  SELECT d.doc_id, d.size, e.z, e.target, e.epochs, floor(e.target)::BIGINT - e.epochs * e.z AS left_,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id::VARCHAR, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, z::BIGINT AS source_size, target,
       (epochs * size + greatest(0, least(size, left_ - before_)))::BIGINT AS taken FROM b
""")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = mixing.with_taken(docs, quality_weights(table(spark, sf_dir, "labels")))
    return taken.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.shard_rows(table(spark, sf_dir, "documents"), 24)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query(r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
i AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
n AS (SELECT DISTINCT n FROM i),
x AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.s, x.n, i.item_id FROM x JOIN i ON x.n = i.n AND x.t = i.t),
p AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS i FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
""")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
  FROM (SELECT * FROM s SEMI JOIN f USING (g)) a JOIN (SELECT * FROM s SEMI JOIN f USING (g)) b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (
  SELECT x, y FROM o JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * o >= 75 * (p.n + q.n - o)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""")
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened(table(spark, sf_dir, "embeddings"), components=8)
    # the contract's deviation is that of the row's vector; the table's total is the operator's own
    return found.select(
        "vec_id", "component", "n", F.col("row_deviation").alias("deviation"), "whitened", "explained", "identity_error",
        F.col("row_deviation_digits").alias("deviation_digits"),
    )


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.with_repeated_tails(table(spark, sf_dir, "documents"))
    return runs.document_runs(docs).drop("collapsed")


@query()
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_copies(table(spark, sf_dir, "embeddings"), least=0.93)


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
