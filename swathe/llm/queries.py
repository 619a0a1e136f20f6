"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
c = F.col


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .repeats import without_repeats

    removed = without_repeats(_table(spark, folder, "documents").select("doc_id", "text"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import scored_documents

    scored = scored_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_words", F.size("passages").alias("n_passages"))


@query
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    from .near import jaccard_classes

    return jaccard_classes(_table(spark, folder, "documents"))


@query
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(_table(spark, folder, "documents"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_counts

    counted = token_counts(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from .decontaminate import contained_items

    return contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@query
def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .pieces import encoded

    return encoded(_table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    from .warc import archived

    return archived(_table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op7_warc"] = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 1000 AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""


@query
def op1_chat_threads(spark: SparkSession, folder: str) -> DataFrame:
    from .quotes import threads

    return threads(_table(spark, folder, "conversations"))


@query
def op5_hilbert_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from .nearest import nearest

    return nearest(_table(spark, folder, "embeddings"))


@query
def op12_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from .centroids import centroid_clusters

    found = centroid_clusters(_table(spark, folder, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(c("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def _rounds_sql(rounds: int) -> str:
    """Every round of op12 as its own pair of steps: nearest centroid, then floored means."""
    near = "SELECT row, vec_id, q, arg_min(cl, (d, cl)) AS cl, min(d) AS d FROM (SELECT v.row, v.vec_id, v.q, g.cl, list_sum(list_transform(list_zip(v.q, g.q), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT))) AS d FROM v, c{i} g) GROUP BY row, vec_id, q"
    mean = "SELECT cl, list(m ORDER BY j) AS q FROM (SELECT cl, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT cl, j, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cl, unnest(q) AS x, generate_subscripts(q, 1) AS j FROM a{i}) GROUP BY cl, j)) GROUP BY cl"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        steps.append(f"m{i} AS ({mean.format(i=i)})")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT o.cl, coalesce(n.q, o.q) AS q FROM c{i} o LEFT JOIN m{i} n USING (cl))")
    steps.append(f"a{rounds} AS MATERIALIZED ({near.format(i=rounds)})")
    return ",\n".join(steps)


ORACLE["op12_centroid_clusters"] = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS INTEGER) AS cl, q FROM v QUALIFY cl < 16),
{_rounds_sql(3)}
SELECT vec_id, cl AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY cl)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c3.q, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (cl)
"""


@query
def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from .simhash import simhash_components

    found = simhash_components(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from .collocations import collocations

    return collocations(_table(spark, folder, "documents"))


ORACLE["op11_collocations"] = r"""
WITH texts AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS p, piece FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)),
words AS MATERIALIZED (SELECT lang, p, row_number() OVER (PARTITION BY p ORDER BY i) AS i, w FROM (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces))),
one AS MATERIALIZED (SELECT lang, w AS phrase, count(*) AS f FROM words GROUP BY ALL),
two AS MATERIALIZED (SELECT x.lang, x.w AS w1, y.w AS w2, count(*) AS f FROM words x JOIN words y ON x.p = y.p AND y.i = x.i + 1 GROUP BY ALL),
three AS MATERIALIZED (SELECT x.lang, x.w AS w1, y.w AS w2, z.w AS w3, count(*) AS f FROM words x JOIN words y ON x.p = y.p AND y.i = x.i + 1 JOIN words z ON x.p = z.p AND z.i = x.i + 2 GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, sum(f) AS n FROM one GROUP BY lang),
around AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT two.lang, two.w1 || ' ' || two.w2 AS phrase, 1 AS k, two.f AS a, x.f AS l, y.f AS r FROM two JOIN one x ON x.lang = two.lang AND x.phrase = two.w1 JOIN one y ON y.lang = two.lang AND y.phrase = two.w2 LEFT JOIN around o ON o.lang = two.lang AND o.w1 = two.w1 AND o.w2 = two.w2
  WHERE two.f >= 10 AND (most IS NULL OR 100 * most < 50 * two.f)
  UNION ALL SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), 1, t.f, x.f, y.f FROM three t JOIN one x ON x.lang = t.lang AND x.phrase = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, concat_ws(' ', t.w1, t.w2, t.w3), 2, t.f, x.f, y.f FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.phrase = t.w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score
FROM least JOIN totals USING (lang) QUALIFY rank <= 2000
"""
