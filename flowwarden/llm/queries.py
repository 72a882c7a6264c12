"""The operators applied to the given tables, with their SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.llm import (divergence, lines, mixing, nbsvm, order_minhash, pii, runs, segmentation, setsketch, sharding,
                            substring, topk, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_top_k", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors)


@query("op2_copied_passages", r"""
WITH d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM s),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE again),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
k AS (
  SELECT p.doc_id, count(c.j) AS n_removed,
         coalesce(string_agg(p.word, ' ' ORDER BY p.j) FILTER (WHERE c.j IS NULL), '') AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.j = c.j GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_copies(table(spark, sf_dir, "documents")))


@query("op3_personal_data")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    return found.select("doc_id", *[f"n_{kind}" for kind in pii.KINDS],
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


@query("op4_uniform_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.uniform_shards(table(spark, sf_dir, "documents"), 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


_TWENTY = ["CAST('0x' || substr(hex, {}, 5) AS INTEGER)".format(start) for start in range(1, 41, 5)]
_BASE32 = " || ".join(f"substr('{warc.BASE32}', ({twenty} >> {shift}) % 32 + 1, 1)"
                      for twenty in _TWENTY for shift in (15, 10, 5, 0))


@query("op5_warc_archive", f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    return warc.rebuild(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_order_minhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.fingerprints(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op7_setsketch_near_duplicates", r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 2 THEN w ELSE list_slice(w, i, i + 1) END, ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
l AS MATERIALIZED (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
pairs AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM d
  UNION SELECT r.node, b.y FROM reach r JOIN pairs b ON b.x = r.seen),
m AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.node = d.doc_id
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: Vocabulary of the token queries; see the README of that folder.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations that the token queries draw of each text.
SAMPLES = 2


@query("op8_sampled_segmentations")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = segmentation.encode(table(spark, sf_dir, "documents"), segmentation.Vocabulary.read(MODEL), samples=SAMPLES, verify=True)
    return drawn.select("doc_id", "rank", F.size("ids").alias("n_pieces"), "ids", "log_prob", "perturbed", "inclusion",
                        "decoded_sha256", "lossless")


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_systematic_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                        "source", "copies")


def planted_periods(docs: DataFrame) -> DataFrame:
    """The texts of op11: of documents whose crc32 of the id ends in 0, a tail repeats its first words."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(code % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    g = F.call_function("div", F.col("code"), F.lit(10))
    marked = docs.withColumn("code", code).withColumn("words", words).withColumn("n", F.size("words"))
    placed = marked.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    period = (1 + F.call_function("div", F.col("n") - F.col("a"), 3 + g % 8)).cast("int")
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), 1, F.col("n") - F.col("a"))
    text = F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " "))
    return placed.withColumn("p", period).withColumn("text", F.coalesce(text, F.col("text"))).select(*docs.columns)


_CRC32_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda z:
  CAST(0 AS BIGINT))), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


@query("op11_periodic_runs", rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, {_CRC32_SQL} AS h,
         CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
e AS (SELECT doc_id, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN h // 10 END AS g FROM d),
t AS (SELECT doc_id, n, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM e),
word AS MATERIALIZED (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
x AS MATERIALIZED (
  SELECT q.doc_id, n, q.i, word FROM (SELECT *, unnest(range(n)) AS i FROM t) q JOIN word s
  ON s.doc_id = q.doc_id AND s.i = CASE WHEN q.i >= a THEN a + (q.i - a) % p ELSE q.i END),
equal AS (SELECT b.doc_id, b.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i
          WHERE 4 * (b.i - a.i) <= b.n),
stretch AS MATERIALIZED (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM equal)
  GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
run AS MATERIALIZED (
  SELECT * FROM stretch r WHERE NOT EXISTS (
    SELECT 1 FROM stretch s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start
    AND s.start + s.length >= r.start + r.length)),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
           FROM run GROUP BY doc_id),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / q DESC, start, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) FILTER (WHERE gone.i IS NULL) AS text, count(gone.i) AS n_dropped
         FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256, n AS n_words,
       coalesce(n_dropped, 0) AS n_dropped
FROM e LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))

    def first(x, y):  # greatest exact length / period, then the smallest start and period
        cross = y.length * x.period - x.length * y.period
        return (F.when(cross != 0, F.signum(cross)).when(x.start != y.start, F.signum(x.start - y.start))
                .otherwise(F.signum(x.period - y.period)).cast("int"))

    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    best = found.withColumn("best", F.get(F.array_sort("runs", first), F.lit(0)))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words", "n_dropped")


@query("op12_repeated_lines", r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, i, s[i] AS line, translate(regexp_replace(s[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM t)),
r AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.doc_id, i, line, last IS NOT NULL AND last <> l.doc_id AS gone FROM l LEFT JOIN r ON r.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op13_source_divergence", r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, lang, source, term, count(*) AS n FROM (SELECT doc_id, lang, source, unnest(w) AS term FROM d)
      GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM t GROUP BY lang, term HAVING count(*) >= 3),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS MATERIALIZED (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(total.total, 0) + v.v) AS BIGINT) AS p,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (kept.n + 1) // (v.total + v.v) AS BIGINT) AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN total USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
QUALIFY part = 'pair' OR rank <= 200
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
