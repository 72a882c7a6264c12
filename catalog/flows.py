"""Neighbour search, calibration and classification."""

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import FLOWS_SQL, NETFLOWS_SQL, halves, netflows, r6, raw_vector, table
from flowwarden.functions import scoring
from flowwarden.operators import calibration, knn, threats
from flowwarden.plans import classify, preprocessing, similar
from flowwarden.plans.reference_index import reconcile_counts
from flowwarden.operators.splitting import split_counts
from flowwarden.session import spread_small

# squared distances in the raw space, every test flow against every index flow of each class
NEIGHBOURS_SQL = f"""
{FLOWS_SQL},
pairs AS (
  SELECT q.flow_id AS query_id, r.traffic_class AS grp, r.flow_id AS row_id,
         (q.value - r.value) * (q.value - r.value) + (q.k - r.k) * (q.k - r.k) + (q.hr - r.hr) * (q.hr - r.hr) AS dist
  FROM halves q, halves r WHERE q.split = 'test' AND r.split = 'index'),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY dist, row_id) AS rank FROM pairs)
  WHERE rank <= 10)
"""
SIMILARITY_SQL = """CASE WHEN {d} > 1000 THEN 0 WHEN {d} > 100 THEN 0.1 WHEN {d} > 10 THEN 0.3 + 0.4 * exp(-{d} / 50)
                    ELSE 0.7 + 0.3 * exp(-{d} / 5) END"""
DECISION_SQL = """
decided AS (
  SELECT *, CASE WHEN attack_score > 0.4 THEN 'malicious' WHEN attack_score > 0.25 THEN 'suspicious' ELSE 'benign' END
              AS classification,
         CASE WHEN attack_score > 0.4 THEN least(0.95, greatest(0.70, attack_score + 0.2))
              WHEN attack_score > 0.25 THEN least(0.85, greatest(0.55, attack_score + 0.15))
              WHEN benign_score > 0.3 THEN least(0.90, greatest(0.60, benign_score + 0.1)) ELSE 0.5 END AS confidence,
         CASE WHEN attack_score > 0.25 THEN best END AS attack_type
  FROM per_query)
"""
CLASSIFY_SQL = f"""
per_class AS (SELECT query_id, grp, bool_and(dist = 0) AS zero, min(dist) FILTER (dist > 0) AS d FROM top GROUP BY ALL),
scored AS (SELECT query_id, grp, CASE WHEN zero THEN 0 ELSE {SIMILARITY_SQL.format(d='d')} END AS score FROM per_class),
per_query AS (
  SELECT query_id, coalesce(max(score) FILTER (grp = 'benign'), 0) AS benign_score,
         coalesce(max(score) FILTER (grp <> 'benign'), 0) AS attack_score,
         first(grp ORDER BY score DESC, grp) FILTER (grp <> 'benign') AS best
  FROM scored GROUP BY query_id),
{DECISION_SQL}
"""


def _raw_refs(spark, sf_dir):
    return knn.reference_rows(halves(spark, sf_dir).where("split = 'index'"), "flow_id", raw_vector(), "traffic_class")


def _raw_queries(spark, sf_dir, group=None):
    held_out = spread_small(halves(spark, sf_dir).where("split = 'test'"), "flow_id")
    return knn.query_rows(held_out, "flow_id", raw_vector(), group)


def _round_result(df):
    return df.select(F.col("query_id").alias("flow_id"), "classification",
                     r6(F.col("confidence")).alias("confidence"), "attack_type")


@query("classify_flows", f"""
WITH {NEIGHBOURS_SQL}, {CLASSIFY_SQL}
SELECT query_id AS flow_id, classification, round(confidence, 6) AS confidence, attack_type FROM decided""")
def classify_flows(spark, sf_dir):
    """Flagship: label every held-out flow from its neighbours in every class."""
    index = knn.build_cells(_raw_refs(spark, sf_dir))
    return _round_result(classify.classify_flows(index, _raw_queries(spark, sf_dir)))


@query("classify_flows_scaled", f"""
WITH {FLOWS_SQL},
codes AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS code
          FROM (SELECT weekday AS word FROM halves WHERE split = 'index' UNION SELECT 'unknown')),
enc AS (SELECT h.*, CAST(coalesce(code, (SELECT code FROM codes WHERE word = 'unknown')) AS DOUBLE) AS wd
        FROM halves h LEFT JOIN codes ON weekday = word),
s AS (SELECT avg(hr) m1, stddev_pop(hr) s1, avg(k) m2, stddev_pop(k) s2, avg(value) m3, stddev_pop(value) s3,
             avg(wd) m4, stddev_pop(wd) s4 FROM enc WHERE split = 'index'),
z AS (SELECT flow_id, traffic_class, split, (hr - m1) / s1 AS a, (k - m2) / s2 AS b, (value - m3) / s3 AS c,
             (wd - m4) / s4 AS d FROM enc, s),
pairs AS (
  SELECT q.flow_id AS query_id, r.traffic_class AS grp, r.flow_id AS row_id,
         (q.a - r.a) * (q.a - r.a) + (q.b - r.b) * (q.b - r.b) + (q.c - r.c) * (q.c - r.c)
         + (q.d - r.d) * (q.d - r.d) AS dist
  FROM z q, z r WHERE q.split = 'test' AND r.split = 'index'),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY dist, row_id) AS rank FROM pairs)
  WHERE rank <= 10), {CLASSIFY_SQL}
SELECT query_id AS flow_id, classification, round(confidence, 6) AS confidence, attack_type FROM decided""")
def classify_flows_scaled(spark, sf_dir):
    """The whole pipeline: fit on the index half, featurize both halves, classify."""
    both = halves(spark, sf_dir)
    index_half = both.where("split = 'index'")
    space = preprocessing.fit(index_half.drop("flow_id", "ts", "user_id"), categorical=["weekday"])
    refs = knn.reference_rows(space.featurize(index_half, ["flow_id", "traffic_class"]), "flow_id", "features",
                              "traffic_class")
    held_out = spread_small(both.where("split = 'test'"), "flow_id")
    queries = knn.query_rows(space.featurize(held_out, ["flow_id"]), "flow_id", "features")
    return _round_result(classify.classify_flows(knn.build_cells(refs), queries))


@query("classify_flows_legacy", f"""
WITH {NEIGHBOURS_SQL},
per_class AS (
  SELECT query_id, grp, 1 / (1 + avg(dist)) AS s FROM top
  WHERE rank <= CASE WHEN grp = 'benign' THEN 5 ELSE 3 END GROUP BY ALL),
per_query AS (
  SELECT query_id, max(s) FILTER (grp = 'benign') AS b, max(s) FILTER (grp <> 'benign') AS a,
         first(grp ORDER BY s DESC, grp) FILTER (grp <> 'benign') AS best
  FROM per_class GROUP BY query_id)
SELECT query_id AS flow_id,
       CASE WHEN b > 0.85 THEN 'benign' WHEN a > 0.75 THEN 'malicious' WHEN a > 0.4 THEN 'suspicious' ELSE 'benign'
            END AS classification,
       round(CASE WHEN b > 0.85 THEN b WHEN a > 0.4 THEN a ELSE 1 - a END, 6) AS confidence,
       CASE WHEN NOT b > 0.85 AND a > 0.4 THEN best END AS attack_type
FROM per_query""")
def classify_flows_legacy(spark, sf_dir):
    index = knn.build_cells(_raw_refs(spark, sf_dir))
    return _round_result(classify.classify_flows_legacy(index, _raw_queries(spark, sf_dir)))


@query("knn_flows", f"""
WITH {NEIGHBOURS_SQL}
SELECT query_id, grp, row_id, rank, round(dist, 6) AS dist FROM top""")
def knn_flows(spark, sf_dir):
    found = knn.knn_join(_raw_queries(spark, sf_dir), _raw_refs(spark, sf_dir), 10, strategy="cells")
    return found.withColumn("dist", r6(F.col("dist")))


@query("knn_flows_two_rounds", f"""
WITH {NEIGHBOURS_SQL}
SELECT query_id, grp, row_id, rank, round(dist, 6) AS dist FROM top""")
def knn_flows_two_rounds(spark, sf_dir):
    """The home cell first, as for large groups."""
    index = knn.build_cells(_raw_refs(spark, sf_dir))
    found = knn.search_cells(index, _raw_queries(spark, sf_dir), 10, rounds=2)
    return found.withColumn("dist", r6(F.col("dist")))


@query("classify_flows_two_rounds", f"""
WITH {NEIGHBOURS_SQL}, {CLASSIFY_SQL}
SELECT query_id AS flow_id, classification, round(confidence, 6) AS confidence, attack_type FROM decided""")
def classify_flows_two_rounds(spark, sf_dir):
    index = knn.build_cells(_raw_refs(spark, sf_dir))
    return _round_result(classify.classify_flows(index, _raw_queries(spark, sf_dir), rounds=2))


_COARSE_SQL = "floor(q.k / 16) - floor(r.k / 16)", "floor(q.hr / 4) - floor(r.hr / 4)"


@query("classify_flows_copies", f"""
WITH {FLOWS_SQL},
pairs AS (
  SELECT q.flow_id AS query_id, r.traffic_class AS grp, r.flow_id AS row_id,
         pow({_COARSE_SQL[0]}, 2) + pow({_COARSE_SQL[1]}, 2) AS dist
  FROM halves q, halves r WHERE q.split = 'test' AND r.split = 'index'),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY dist, row_id) AS rank FROM pairs)
  WHERE rank <= 10), {CLASSIFY_SQL}
SELECT query_id AS flow_id, classification, round(confidence, 6) AS confidence, attack_type FROM decided""")
def classify_flows_copies(spark, sf_dir):
    """Coarse vectors with about ten copies of each in every class: k neighbours that are all copies score 0."""
    coarse = F.array(F.floor(F.col("k") / 16).cast("double"), F.floor(F.col("hr") / 4).cast("double"))
    both = halves(spark, sf_dir)
    index = knn.build_cells(knn.reference_rows(both.where("split = 'index'"), "flow_id", coarse, "traffic_class"))
    return _round_result(classify.classify_flows(index, knn.query_rows(both.where("split = 'test'"), "flow_id", coarse)))


_SIMILAR = f"""
WITH {FLOWS_SQL},
pairs AS (
  SELECT q.flow_id AS query_id, r.traffic_class AS grp, r.flow_id AS row_id, r.value AS similar_value,
         (q.value - r.value) * (q.value - r.value) + (q.k - r.k) * (q.k - r.k) + (q.hr - r.hr) * (q.hr - r.hr) AS dist
  FROM halves q JOIN halves r ON q.traffic_class = r.traffic_class
  WHERE q.split = 'test' AND r.split = 'index'),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS rank FROM pairs
                 WHERE grp <> 'benign') WHERE rank <= 5),
own AS (
  SELECT a.flow_id AS query_id, a.traffic_class AS grp,
         (a.value - b.value) * (a.value - b.value) + (a.k - b.k) * (a.k - b.k) + (a.hr - b.hr) * (a.hr - b.hr) AS dist,
         row_number() OVER (PARTITION BY a.flow_id ORDER BY dist, b.flow_id) AS rank
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY traffic_class
                        ORDER BY md5('42|' || CAST(flow_id AS VARCHAR)), flow_id) AS rn
                       FROM halves WHERE split = 'index') WHERE rn <= 3000) a
  JOIN halves b ON a.traffic_class = b.traffic_class AND b.split = 'index'),
cal AS (
  SELECT grp, quantile_cont(m, 0.05) AS p5, quantile_cont(m, 0.95) AS p95
  FROM (SELECT query_id, grp, avg(dist) AS m FROM own WHERE rank BETWEEN 2 AND 6 GROUP BY ALL) GROUP BY grp)
"""


@query("similar_flows", f"""{_SIMILAR}
SELECT query_id, grp, row_id, rank, similar_value,
       round(CASE WHEN p95 <= p5 THEN 0.5 ELSE least(1, greatest(0, (p95 - dist) / (p95 - p5))) END, 6) AS similarity
FROM top JOIN cal USING (grp)""")
def similar_flows(spark, sf_dir):
    refs = _raw_refs(spark, sf_dir)
    index = knn.build_cells(refs)
    rows = halves(spark, sf_dir).where("split = 'index'").select(
        F.col("traffic_class").alias("grp"), F.col("flow_id").alias("row_id"), F.struct("value").alias("flow"))
    found = similar.similar_flows(index, _raw_queries(spark, sf_dir, "traffic_class"), 5,
                                  calibration.calibrate(index, refs), rows)
    return found.select("query_id", "grp", "row_id", "rank", F.col("flow.value").alias("similar_value"),
                        r6(F.col("similarity")).alias("similarity"))


@query("similar_flows_legacy", f"""{_SIMILAR}
SELECT query_id, grp, row_id, rank, round(1 / (1 + dist), 6) AS similarity FROM top""")
def similar_flows_legacy(spark, sf_dir):
    index = knn.build_cells(_raw_refs(spark, sf_dir))
    found = similar.similar_flows_legacy(index, _raw_queries(spark, sf_dir, "traffic_class"), 5)
    return found.select("query_id", "grp", "row_id", "rank", r6(F.col("similarity")).alias("similarity"))


@query("flow_calibration", f"""{_SIMILAR}
SELECT grp, round(p5, 6) AS p5, round(p95, 6) AS p95 FROM cal""")
def flow_calibration(spark, sf_dir):
    refs = _raw_refs(spark, sf_dir)
    return calibration.calibrate(knn.build_cells(refs), refs).select(
        "grp", r6(F.col("p5")).alias("p5"), r6(F.col("p95")).alias("p95"))


EMBED_TOP = """
WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, q.grp AS qgrp, r.vec_id AS row_id, r.grp,
                 list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
          FROM e q, e r)
"""


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))


@query("knn_exact", f"""{EMBED_TOP}
SELECT query_id, row_id, rank, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS rank FROM pairs) WHERE rank <= 10""")
def knn_exact(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    found = knn.knn_join(knn.query_rows(e, "vec_id", "embedding"), knn.reference_rows(e, "vec_id", "embedding"), 10,
                         strategy="blocks")
    return found.select("query_id", "row_id", "rank", r6(F.col("dist")).alias("dist"))


@query("knn_filtered", f"""{EMBED_TOP}
SELECT query_id, grp, row_id, rank, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS rank FROM pairs WHERE qgrp = grp)
WHERE rank <= 10""")
def knn_filtered(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    found = knn.knn_join(knn.query_rows(e, "vec_id", "embedding", "label"),
                         knn.reference_rows(e, "vec_id", "embedding", "label"), 10, strategy="blocks")
    return found.select("query_id", "grp", "row_id", "rank", r6(F.col("dist")).alias("dist"))


def _lloyd_sql(rounds):
    """Centres of every class after that many rounds, as CTEs c0, c1, ..."""
    near = ("SELECT r.row_id, r.grp, first(c.cell ORDER BY (r.value - c.value) * (r.value - c.value) + (r.k - c.k) * (r.k - c.k) "
            "+ (r.hr - c.hr) * (r.hr - c.hr), c.cell) AS cell FROM refs r JOIN c{i} c ON c.grp = r.grp GROUP BY r.row_id, r.grp")
    out = []
    for i in range(rounds):
        out.append(f"a{i} AS MATERIALIZED ({near.format(i=i)})")
        out.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT o.grp, o.cell, coalesce(m.value, o.value) AS value, coalesce(m.k, o.k) AS k, coalesce(m.hr, o.hr) AS hr
  FROM c{i} o LEFT JOIN (SELECT a.grp, a.cell, avg(value) AS value, avg(k) AS k, avg(hr) AS hr
                         FROM a{i} a JOIN refs r ON r.row_id = a.row_id GROUP BY a.grp, a.cell) m
  ON m.grp = o.grp AND m.cell = o.cell)""")
    return ",\n".join([*out, f"a{rounds} AS MATERIALIZED ({near.format(i=rounds)})"])


@query("knn_clustered", f"""
WITH {FLOWS_SQL},
refs AS MATERIALIZED (
  SELECT flow_id AS row_id, traffic_class AS grp, value, k, hr,
         row_number() OVER (PARTITION BY traffic_class, value, k, hr ORDER BY flow_id) AS copy
  FROM halves WHERE split = 'index' QUALIFY copy <= 10),
wanted AS (SELECT grp, CASE WHEN grp = 'benign' THEN least(100, greatest(10, count(*) // 50)) WHEN count(*) < 1000 THEN 1
                            ELSE least(50, greatest(10, count(*) // 20)) END AS wanted FROM refs GROUP BY grp),
c0 AS MATERIALIZED (
  SELECT grp, value, k, hr, row_number() OVER (PARTITION BY grp ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), row_id) AS cell
  FROM refs JOIN wanted USING (grp) WHERE copy = 1 QUALIFY cell <= wanted),
{_lloyd_sql(3)},
queries AS (SELECT flow_id AS query_id, value, k, hr FROM halves WHERE split = 'test'),
probed AS (
  SELECT query_id, q.value, q.k, q.hr, c.grp, c.cell
  FROM queries q, c3 c JOIN (SELECT DISTINCT grp, cell FROM a3) f ON f.grp = c.grp AND f.cell = c.cell
  QUALIFY row_number() OVER (PARTITION BY query_id, c.grp ORDER BY (q.value - c.value) * (q.value - c.value)
    + (q.k - c.k) * (q.k - c.k) + (q.hr - c.hr) * (q.hr - c.hr), c.cell) <= 10),
pairs AS (
  SELECT query_id, p.grp, r.row_id, (p.value - r.value) * (p.value - r.value) + (p.k - r.k) * (p.k - r.k)
         + (p.hr - r.hr) * (p.hr - r.hr) AS dist
  FROM probed p JOIN a3 a ON a.grp = p.grp AND a.cell = p.cell JOIN refs r ON r.row_id = a.row_id)
SELECT query_id, grp, row_id, rank, round(dist, 6) AS dist
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY dist, row_id) AS rank FROM pairs) WHERE rank <= 10""")
def knn_clustered(spark, sf_dir):
    """Approximate: k-means cells after three rounds, the class-size rule for their number, at most 10 probed."""
    index = knn.build_cells(_raw_refs(spark, sf_dir), cells_for=calibration.clustered_cells("benign"), train="kmeans",
                            train_rounds=3)
    return knn.search_cells(index, _raw_queries(spark, sf_dir), 10, nprobe=10).withColumn("dist", r6(F.col("dist")))


@query("knn_clustered_all_cells", f"""
WITH {NEIGHBOURS_SQL}
SELECT query_id, grp, row_id, rank, round(dist, 6) AS dist FROM top""")
def knn_clustered_all_cells(spark, sf_dir):
    """The same clustering with every cell probed equals the exact search."""
    index = knn.build_cells(_raw_refs(spark, sf_dir), cells_for=calibration.clustered_cells("benign"), train="kmeans")
    return knn.search_cells(index, _raw_queries(spark, sf_dir), 10, nprobe=100).withColumn("dist", r6(F.col("dist")))


@query("knn_distance_calibration", f"""{EMBED_TOP},
m AS (SELECT query_id, grp, avg(dist) AS m
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS rank FROM pairs
            WHERE qgrp = grp) WHERE rank BETWEEN 2 AND 6 GROUP BY ALL)
SELECT grp, round(quantile_cont(m, 0.05), 6) AS p5, round(quantile_cont(m, 0.95), 6) AS p95 FROM m GROUP BY grp""")
def knn_distance_calibration(spark, sf_dir):
    refs = knn.reference_rows(_embeddings(spark, sf_dir), "vec_id", "embedding", "label")
    return calibration.calibrate(knn.build_cells(refs), refs).select(
        "grp", r6(F.col("p5")).alias("p5"), r6(F.col("p95")).alias("p95"))


@query("mean_distance_diagnostic", f"""{EMBED_TOP}
SELECT query_id, round(avg(dist), 6) AS mean_distance, round(exp(-avg(dist) / 10), 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS rank FROM pairs)
WHERE rank <= 5 GROUP BY query_id""")
def mean_distance_diagnostic(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    found = knn.knn_join(knn.query_rows(e, "vec_id", "embedding"), knn.reference_rows(e, "vec_id", "embedding"), 5,
                         strategy="blocks")
    mean = found.groupBy("query_id").agg(F.avg("dist").alias("m"))
    return mean.select("query_id", r6(F.col("m")).alias("mean_distance"),
                       r6(scoring.decay_similarity(F.col("m"))).alias("similarity"))


@query("similarity_bands", f"""
SELECT o_orderkey, round({SIMILARITY_SQL.format(d='d')}, 6) AS similarity
FROM (SELECT o_orderkey, o_totalprice / 300 AS d FROM orders)""")
def similarity_bands(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", r6(scoring.distance_similarity(F.col("o_totalprice") / 300)).alias("similarity"))


@query("decision", f"""
WITH per_query AS (
  SELECT o_orderkey, o_orderpriority AS best, {SIMILARITY_SQL.format(d='(o_totalprice / 300)')} AS attack_score,
         {SIMILARITY_SQL.format(d='(o_totalprice / 900)')} AS benign_score FROM orders),
{DECISION_SQL}
SELECT o_orderkey, classification, round(confidence, 6) AS confidence, attack_type FROM decided""")
def decision(spark, sf_dir):
    price = F.col("o_totalprice")
    d = scoring.decision(scoring.distance_similarity(price / 900), scoring.distance_similarity(price / 300),
                         F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d")).select(
        "o_orderkey", "d.classification", r6(F.col("d.confidence")).alias("confidence"), "d.attack_type")


@query("softmax_confidence", """
WITH s AS (SELECT o_orderkey, o_totalprice / 500000 AS a, 0.5 AS b FROM orders),
e AS (SELECT *, exp((a - greatest(a, b)) / 0.35) AS ea, exp((b - greatest(a, b)) / 0.35) AS eb FROM s)
SELECT o_orderkey, round(ea / (ea + eb), 6) AS p1, round(eb / (ea + eb), 6) AS p2 FROM e""")
def softmax_confidence(spark, sf_dir):
    p = scoring.softmax_pair(F.col("o_totalprice") / 500000, F.lit(0.5))
    return table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select(
        "o_orderkey", r6(F.col("p.p1")).alias("p1"), r6(F.col("p.p2")).alias("p2"))


@query("index_metadata", f"""
WITH {FLOWS_SQL}
SELECT traffic_class, n AS num_samples, 3 AS feature_dim, nlist, CASE WHEN nlist IS NOT NULL THEN least(10, nlist) END AS nprobe,
       CASE WHEN traffic_class = 'benign' THEN 'IVFFlat' WHEN n < 1000 THEN 'Flat'
            ELSE 'IVFFlat_nlist' || CAST(nlist AS VARCHAR) END AS index_type
FROM (SELECT traffic_class, count(*) AS n,
             CAST(CASE WHEN traffic_class = 'benign' THEN least(100, greatest(10, count(*) // 50))
                       WHEN count(*) >= 1000 THEN least(50, greatest(10, count(*) // 20)) END AS INTEGER) AS nlist
      FROM halves WHERE split = 'index' GROUP BY traffic_class)""")
def index_metadata(spark, sf_dir):
    return calibration.index_metadata(_raw_refs(spark, sf_dir), None, "benign")


@query("reconcile_counts", f"""
WITH {FLOWS_SQL},
kept AS (SELECT traffic_class, count(*) AS num_samples FROM halves
         WHERE split = 'index' AND NOT (traffic_class = 'error' AND value > 50) GROUP BY 1),
wanted AS (SELECT traffic_class, count(*) AS index_rows FROM halves WHERE split = 'index' GROUP BY 1)
SELECT traffic_class, num_samples, index_rows FROM kept FULL JOIN wanted USING (traffic_class)
WHERE num_samples IS DISTINCT FROM index_rows""")
def reconcile(spark, sf_dir):
    both = halves(spark, sf_dir)
    partial = both.where("split = 'index' AND NOT (traffic_class = 'error' AND value > 50)")
    refs = knn.reference_rows(partial, "flow_id", raw_vector(), "traffic_class")
    return reconcile_counts(calibration.index_metadata(refs, None, "benign"), split_counts(both, "traffic_class"))


@query("threat_routing", f"""
WITH {NETFLOWS_SQL}
SELECT event_id, attack_type FROM netflows
WHERE classification = 'malicious' OR (classification = 'suspicious' AND attack_type IS NOT NULL)""")
def threat_routing(spark, sf_dir):
    return threats.route(netflows(spark, sf_dir), first_of_type=True).select("event_id", "attack_type")


@query("first_of_type", f"""
WITH {NETFLOWS_SQL}
SELECT event_id, attack_type FROM (
  SELECT *, row_number() OVER (PARTITION BY attack_type ORDER BY CAST(timestamp AS BIGINT), event_id) AS rn
  FROM netflows WHERE classification = 'malicious') WHERE rn = 1""")
def first_of_type(spark, sf_dir):
    routed = threats.route(netflows(spark, sf_dir)).withColumn("at", F.col("timestamp").cast("bigint"))
    return threats.first_per_type(routed, "at", "event_id").select("event_id", "attack_type")


@query("skip_analysed", f"""
WITH {NETFLOWS_SQL}
SELECT event_id, attack_type FROM netflows n WHERE classification = 'malicious'
AND NOT EXISTS (SELECT 1 FROM netflows d WHERE d.attack_type = n.attack_type AND d.dst_port = 80)
AND attack_type NOT IN ('error')""")
def skip_analysed(spark, sf_dir):
    n = netflows(spark, sf_dir)
    done = n.where("dst_port = 80 OR attack_type = 'error'").select("attack_type").distinct()
    return threats.not_yet_analysed(threats.route(n), done).select("event_id", "attack_type")


@query("flow_records", f"""
WITH {NETFLOWS_SQL}
SELECT timestamp, src_ip, dst_ip, src_port, dst_port, protocol, bytes_count AS bytes, packets_count AS packets,
       classification, round(confidence, 6) AS confidence, attack_type,
       'flow_' || sha256(timestamp || '|' || src_ip || '|' || dst_ip || '|' || src_port || '|' || dst_port) AS id
FROM netflows""")
def flow_records(spark, sf_dir):
    return threats.flow_record(netflows(spark, sf_dir)).withColumn("confidence", r6(F.col("confidence")))


@query("counters", f"""
WITH {NETFLOWS_SQL}
SELECT classification, count(*) AS flows FROM netflows GROUP BY classification""")
def counters(spark, sf_dir):
    return threats.counters(netflows(spark, sf_dir))
