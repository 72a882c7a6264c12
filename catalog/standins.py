"""Stand-in tables derived from the given ones, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.operators.splitting import split


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# -- labelled flows: class = event type (view is benign), features value, k and hour, category weekday

FLOWS_SQL = """
flows AS (
  SELECT event_id AS flow_id, ts, user_id,
         CASE WHEN event_type = 'view' THEN 'benign' ELSE event_type END AS traffic_class,
         value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(hour(ts) AS DOUBLE) AS hr,
         strftime(ts, '%a') AS weekday
  FROM events),
halves AS (
  SELECT *, CASE WHEN CAST('0x' || substr(md5('42|' || traffic_class || '|' || CAST(flow_id AS VARCHAR)), 1, 8)
                           AS BIGINT) / 4294967296.0 < 0.5 THEN 'test' ELSE 'index' END AS split
  FROM flows)
"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return shape_flows(events)


def shape_flows(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("flow_id"), "ts", "user_id",
        F.when(F.col("event_type") == "view", "benign").otherwise(F.col("event_type")).alias("traffic_class"),
        "value", F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.hour("ts").cast("double").alias("hr"), F.date_format("ts", "E").alias("weekday"))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the 50/50 split; together the halves are the whole table."""
    return split(flows(spark, sf_dir), "traffic_class", "flow_id")


def raw_vector() -> Column:
    return F.array("value", "k", "hr")


# -- flow events: network fields derived from the event row

NETFLOWS_SQL = """
netflows AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS timestamp,
         '10.0.' || CAST(user_id // 256 % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS src_ip,
         '192.168.1.' || CAST(event_id % 250 AS VARCHAR) AS dst_ip,
         CAST(1024 + event_id % 60000 AS INTEGER) AS src_port,
         CASE event_type WHEN 'view' THEN 443 WHEN 'click' THEN 80 ELSE 22 END AS dst_port,
         CASE event_type WHEN 'view' THEN 'TCP' WHEN 'click' THEN 'udp' WHEN 'error' THEN 'ICMP'
              WHEN 'signup' THEN 'SCTP' ELSE 'tcp' END AS protocol,
         CAST(floor(value * 100) AS BIGINT) AS bytes_count,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS packets_count,
         value / 50 AS duration,
         CASE event_type WHEN 'view' THEN 'SYN' WHEN 'click' THEN 'SYN+ACK' WHEN 'error' THEN 'ICMP'
              WHEN 'signup' THEN 'URG' ELSE 'RST' END AS tcp_flags,
         CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS attack_type,
         CASE event_type WHEN 'view' THEN 'benign' WHEN 'click' THEN 'suspicious' ELSE 'malicious' END
           AS classification,
         floor(value) / 128 AS confidence
  FROM events)
"""


def netflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_netflows(table(spark, sf_dir, "events"))


def shape_netflows(events: DataFrame) -> DataFrame:
    e = F.col("event_type")
    text = lambda c: c.cast("string")
    uid = F.col("user_id")
    return events.select(
        "event_id", text(F.col("event_id")).alias("timestamp"),
        F.concat(F.lit("10.0."), text(F.shiftright(uid, 8) % 256), F.lit("."), text(uid % 256)).alias("src_ip"),
        F.concat(F.lit("192.168.1."), text(F.col("event_id") % 250)).alias("dst_ip"),
        (1024 + F.col("event_id") % 60000).cast("int").alias("src_port"),
        F.when(e == "view", 443).when(e == "click", 80).otherwise(22).alias("dst_port"),
        F.when(e == "view", "TCP").when(e == "click", "udp").when(e == "error", "ICMP")
        .when(e == "signup", "SCTP").otherwise("tcp").alias("protocol"),
        F.floor(F.col("value") * 100).cast("bigint").alias("bytes_count"),
        F.get_json_object("props", "$.k").cast("bigint").alias("packets_count"),
        (F.col("value") / 50).alias("duration"),
        F.when(e == "view", "SYN").when(e == "click", "SYN+ACK").when(e == "error", "ICMP")
        .when(e == "signup", "URG").otherwise("RST").alias("tcp_flags"),
        F.when(e != "view", e).alias("attack_type"),
        F.when(e == "view", "benign").when(e == "click", "suspicious").otherwise("malicious").alias("classification"),
        (F.floor("value") / 128).alias("confidence"))


# -- analysis history: documents with their embeddings, type = source, time = document id

HISTORY_SQL = """
docs AS (
  SELECT doc_id AS doc_index, text, lower(source) AS attack_type, doc_id AS ts,
         CAST(embedding AS DOUBLE[]) AS v
  FROM documents JOIN embeddings ON doc_id = vec_id),
unit AS (
  SELECT * EXCLUDE (v), list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM docs)
"""


ALL_DOCS_SQL = "docs AS (SELECT doc_id AS doc_index, text, lower(source) AS attack_type, doc_id AS ts FROM documents)"


def all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history without embeddings: every document."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc_index"), "text", F.lower("source").alias("attack_type"), F.col("doc_id").alias("ts"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return docs.join(vectors, docs.doc_id == vectors.vec_id).select(
        F.col("doc_id").alias("doc_index"), "text", F.lower("source").alias("attack_type"),
        F.col("doc_id").alias("ts"), F.col("embedding").cast("array<double>").alias("embedding"))
