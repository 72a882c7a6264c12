"""Profiles, coverage, health and system statistics."""

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import FLOWS_SQL, halves, r6, table
from flowwarden.operators import quality
from flowwarden.sources import flow_csv
from flowwarden.streaming.detect import throughput

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
WIDTHS = {"region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
          "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4}


@query("quality_profile", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS rows, {WIDTHS[t]} AS columns, "
    f"CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) < 100 THEN 'small' ELSE 'ok' END AS status, "
    f"'{'text' if t not in ('documents', 'benchmark', 'conversations') else ''}' AS missing_columns FROM {t}"
    for t in TABLES))
def quality_profile(spark, sf_dir):
    return quality.table_profile({t: table(spark, sf_dir, t) for t in TABLES}, ["text"])


def _expected(spark):
    return spark.createDataFrame([("View",), ("CLICK",), ("error",), ("synscan",)], "traffic_class string")


_EXPECTED_SQL = "expected AS (SELECT unnest(['View', 'CLICK', 'error', 'synscan']) AS traffic_class)"


@query("coverage", f"""
WITH {_EXPECTED_SQL}
SELECT traffic_class, lower(traffic_class) IN (SELECT event_type FROM events) AS found FROM expected""")
def coverage(spark, sf_dir):
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("traffic_class"))
    return quality.coverage(_expected(spark), found)


@query("missing_classes", f"""
WITH {_EXPECTED_SQL}
SELECT traffic_class FROM expected WHERE lower(traffic_class) NOT IN (SELECT event_type FROM events)""")
def missing_classes(spark, sf_dir):
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("traffic_class"))
    return quality.missing_classes(_expected(spark), found)


@query("vector_health", """
WITH v AS (
  SELECT vec_id, CASE WHEN label = 3 THEN list_transform(embedding, lambda x: x * 0) ELSE embedding END AS e
  FROM embeddings)
SELECT vec_id, list_bool_and(list_transform(e, lambda x: x = 0)) AS all_zero,
       round(CAST(list_min(e) AS DOUBLE), 6) AS smallest, round(CAST(list_max(e) AS DOUBLE), 6) AS largest
FROM v""")
def vector_health(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    zeroed = F.when(F.col("label") == 3, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    out = quality.vector_health(e.withColumn("embedding", zeroed), "vec_id", "embedding")
    return out.withColumns({c: r6(F.col(c)) for c in ("smallest", "largest")})


@query("index_health", f"""
WITH {FLOWS_SQL},
expected AS (SELECT unnest(['benign', 'click', 'error', 'synscan']) AS traffic_class),
n AS (SELECT traffic_class, count(*) AS vectors FROM halves WHERE split = 'index' GROUP BY 1)
SELECT traffic_class, coalesce(vectors, 0) AS vectors, CASE WHEN vectors IS NULL THEN 'missing' ELSE 'ok' END AS status
FROM expected LEFT JOIN n USING (traffic_class)""")
def index_health(spark, sf_dir):
    expected = spark.createDataFrame([("benign",), ("click",), ("error",), ("synscan",)], "traffic_class string")
    return quality.index_health(expected, halves(spark, sf_dir).where("split = 'index'"), "traffic_class")


@query("system_stats", """
SELECT count(*) AS flows, round(epoch(max(ts)) - epoch(min(ts)), 3) AS uptime_seconds,
       round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS flows_per_second,
       (SELECT count(*) FROM conversations) AS stored_analyses
FROM events""")
def system_stats(spark, sf_dir):
    s = quality.system_stats(table(spark, sf_dir, "events"), analyses=table(spark, sf_dir, "conversations"))
    return s.withColumns({"uptime_seconds": F.round("uptime_seconds", 3),
                          "flows_per_second": r6(F.col("flows_per_second"))})


@query("throughput", """
SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, count(*) AS flows,
       round(count(*) / 3600, 6) AS flows_per_second
FROM events GROUP BY 1""")
def throughput_query(spark, sf_dir):
    t = throughput(table(spark, sf_dir, "events"))
    return t.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "flows",
                    r6(F.col("flows_per_second")).alias("flows_per_second"))


@query("file_naming", """
WITH f AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Benign_' || page_id WHEN 1 THEN 'attack_type_custom_index'
                  WHEN 2 THEN 'my_SynScan_' || page_id WHEN 3 THEN 'udp_flood' WHEN 4 THEN 'test_stream'
                  ELSE 'udpflood_synscan' END || '.csv' AS file_name FROM pages)
SELECT page_id,
       CASE page_id % 6 WHEN 0 THEN 'benign' WHEN 1 THEN 'custom' WHEN 2 THEN 'synscan' WHEN 5 THEN 'udpflood' END
         AS traffic_class,
       CASE page_id % 6 WHEN 0 THEN 'benign' WHEN 3 THEN 'udpflood' WHEN 2 THEN 'synscan' WHEN 5 THEN 'udpflood' END
         AS legacy_class,
       CASE page_id % 6 WHEN 0 THEN 'benign' WHEN 1 THEN 'unknown' WHEN 4 THEN 'unknown' ELSE 'attack' END AS category
FROM f""")
def file_naming(spark, sf_dir):
    p = F.col("page_id") % 6
    n = F.col("page_id").cast("string")
    name = (F.when(p == 0, F.concat(F.lit("Benign_"), n)).when(p == 1, "attack_type_custom_index")
            .when(p == 2, F.concat(F.lit("my_SynScan_"), n)).when(p == 3, "udp_flood").when(p == 4, "test_stream")
            .otherwise("udpflood_synscan"))
    f = F.concat(name, F.lit(".csv"))
    return table(spark, sf_dir, "pages").select(
        "page_id", flow_csv.class_from_file_name(f).alias("traffic_class"),
        flow_csv.class_from_file_name_legacy(f).alias("legacy_class"), flow_csv.file_category(f).alias("category"))
