"""The corpus queries over the driver tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchsieve.llm.clustering import CENTROIDS, COMPONENTS, ROUNDS, clustered
from patchsieve.llm.common import table
from patchsieve.llm.decontaminate import contaminated
from patchsieve.llm.fingerprints import fingerprints
from patchsieve.llm.html import extracted
from patchsieve.llm.licenses import license_scan
from patchsieve.llm.near_dups import near_duplicates
from patchsieve.llm.packing import packed
from patchsieve.llm.quality import quality
from patchsieve.llm.sharding import sharded
from patchsieve.llm.simhash import simhash_groups
from patchsieve.llm.spelling import spelling_variants
from patchsieve.llm.token_matrices import segments, token_matrices
from patchsieve.llm.warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


@query("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query("op3_warc_revisits", """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS bytes, sha1(coalesce(html, '')) AS digest FROM pages
), firsts AS (SELECT digest, max(page_id) AS first_id FROM p WHERE bytes >= 1000 GROUP BY digest)
SELECT p.page_id, bytes AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> p.page_id THEN first_id END AS refers_to, true AS intact
FROM p LEFT JOIN firsts ON p.digest = firsts.digest AND bytes >= 1000
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_order_minhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


@query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


@query("op8_token_matrices")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments(token_matrices(table(spark, sf_dir, "documents")))


def files_of(documents: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language, fifty ids a folder.

    Every fourth document that mentions a licence is the licence file of its folder.
    """
    mentions = F.coalesce(F.col("text").rlike("(?i)licen[cs]e"), F.lit(False)) & (F.col("doc_id") % 4 == 0)
    number = F.col("doc_id").cast("string")
    name = F.when(mentions, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    folder = F.floor(F.col("doc_id") / 50).cast("string")
    return documents.select("doc_id", F.concat_ws("/", "source", "lang", folder, name).alias("path"), "text")


@query("op9_license_scan")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(files_of(table(spark, sf_dir, "documents")))


@query("op10_minhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# the checksum of a run is the exclusive or of one table value for each byte, told by the byte and its distance
# from the end, and of one value for the length; near words share a word with one code point taken out
@query("op11_spelling_variants", """
WITH RECURSIVE steps AS (
  SELECT b AS byte, b::BIGINT AS v, 0 AS step FROM range(256) t(b)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM steps WHERE step < 8
), base AS MATERIALIZED (SELECT byte, v FROM steps WHERE step = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) AS run FROM documents)
  GROUP BY doc_id, run
), keyed AS MATERIALIZED (SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS bytes FROM runs),
far AS (
  SELECT byte, v, 0 AS away FROM base
  UNION ALL SELECT far.byte, xor(far.v >> 8, base.v), away + 1 FROM far JOIN base ON base.byte = far.v & 255
  WHERE away < (SELECT max(length(bytes)) / 2 FROM keyed)
), start AS (
  SELECT 4294967295::BIGINT AS v, 0 AS length
  UNION ALL SELECT xor(start.v >> 8, base.v), length + 1 FROM start JOIN base ON base.byte = start.v & 255
  WHERE length < (SELECT max(length(bytes)) / 2 FROM keyed)
), places AS (SELECT doc_id, run, n, length(bytes) // 2 AS size, bytes, unnest(range(length(bytes) // 2)) AS i FROM keyed),
sums AS (
  SELECT doc_id, run, any_value(n) AS n, any_value(size) AS size, bit_xor(far.v) AS v
  FROM places JOIN far ON far.byte = ('0x' || substr(bytes, 2 * i + 1, 2))::INTEGER AND far.away = size - 1 - i GROUP BY doc_id, run
), hashed AS (SELECT run, n, xor(xor(sums.v, start.v), 4294967295) AS h FROM sums JOIN start ON start.length = size),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest
), best AS (SELECT word, count(*) AS n_near, arg_min({'other': other, 'n': n}, {'n': -n, 'other': other}) AS best FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * w.n THEN best.other END AS form, CASE WHEN best.n >= 2 * w.n THEN best.n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, walk.root FROM forms f JOIN walk USING (word) JOIN forms last ON last.word = walk.root AND last.form IS NULL
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def clustering_sql(k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS) -> str:
    """The clustering with one pair of steps for each round."""
    steps = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (SELECT r, unnest(range({components})) AS i, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT k, i, x AS c FROM x JOIN (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k FROM kept QUALIFY k < {k}) USING (r))"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, k, d FROM (SELECT r, k, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{n} USING (i) GROUP BY r, k)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{n}
  LEFT JOIN (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} JOIN x USING (r) GROUP BY k, i) USING (k, i))""")
    return "WITH " + ",\n".join(steps) + f""",
names AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN names USING (k)"""


@query("op12_centroid_clustering", clustering_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


@query("op13_simhash_near_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
