"""Cleaning, encoding, scaling, selection and feature projection."""

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import (FLOWS_SQL, NETFLOWS_SQL, flows, halves, netflows, r6, table)
from flowwarden.functions import records, times
from flowwarden.functions.flow_features import feature_row, flow_features
from flowwarden.functions.vectors import finite_or
from flowwarden.operators import cleaning, encoding, scaling, splitting
from flowwarden.plans import preprocessing

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("split_counts", f"""
WITH {FLOWS_SQL}
SELECT traffic_class, count(*) FILTER (split = 'index') AS index_rows,
       count(*) FILTER (split = 'test') AS test_rows, count(*) AS total_rows
FROM halves GROUP BY ROLLUP (traffic_class)""")
def split_counts(spark, sf_dir):
    return splitting.split_counts(halves(spark, sf_dir), "traffic_class")


@query("sample_per_class", f"""
WITH {FLOWS_SQL}
SELECT traffic_class, flow_id FROM (
  SELECT *, row_number() OVER (PARTITION BY traffic_class
                               ORDER BY md5('42|' || CAST(flow_id AS VARCHAR)), flow_id) AS rn FROM flows)
WHERE rn <= 3000""")
def sample_per_class(spark, sf_dir):
    return splitting.sample_per_group(flows(spark, sf_dir), "traffic_class", "flow_id").select(
        "traffic_class", "flow_id")


@query("clean_coerce", """
SELECT event_id AS row_id,
       CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE coalesce(value, 0) END AS "Dur",
       CASE WHEN event_type = 'error' THEN 0.0 ELSE coalesce(TRY_CAST(replace(props, '{"k": ', '') AS DOUBLE), 0)
            END AS "Rate",
       CASE WHEN event_type = 'view' THEN 'nan' ELSE event_type END AS "Proto",
       CASE WHEN event_id % 5 = 0 THEN '0.0' ELSE CAST(user_id AS VARCHAR) END AS "sTos",
       coalesce(nullif(event_type, 'click'), 'nan') AS other
FROM events""")
def clean_coerce(spark, sf_dir):
    # numbers arrive as text, padded, absent or broken
    e = table(spark, sf_dir, "events")
    dirty = e.select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("event_id") % 3 == 0, F.lit("n/a")).otherwise(
            F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" "))).alias("Dur"),
        F.when(F.col("event_type") == "error", F.lit("")).otherwise(
            F.replace("props", F.lit('{"k": '), F.lit(""))).alias("Rate"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("Proto"),
        F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("sTos"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("other"))
    return cleaning.clean_flows(dirty)


@query("fill_missing", """
SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(lang, 'nan') AS lang
FROM (SELECT d.doc_id, quality, CASE WHEN lang = 'en' THEN NULL ELSE lang END AS lang
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def fill_missing(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    sparse = d.join(labels, "doc_id", "left").select(
        "doc_id", "quality", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"))
    return cleaning.fill_missing(sparse)


@query("align_schema", """
SELECT l_quantity, 0.0::DOUBLE AS missing_feature, l_tax, l_orderkey FROM lineitem""")
def align_schema(spark, sf_dir):
    return cleaning.align(table(spark, sf_dir, "lineitem"), ["l_quantity", "missing_feature", "l_tax", "l_orderkey"])


CODES_SQL = """
vals AS (
  SELECT 'l_returnflag' AS feature, l_returnflag AS value FROM lineitem
  UNION SELECT 'l_linestatus', l_linestatus FROM lineitem
  UNION SELECT 'l_returnflag', 'unknown' UNION SELECT 'l_linestatus', 'unknown'),
codes AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM vals)
"""


@query("category_codes", """
WITH vals AS (
  SELECT 'p_brand' AS feature, p_brand AS value FROM part
  UNION SELECT 'p_type', p_type FROM part
  UNION SELECT 'p_brand', 'unknown' UNION SELECT 'p_type', 'unknown')
SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM vals""")
def category_codes(spark, sf_dir):
    return encoding.category_codes(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("label_encode", f"""
WITH {CODES_SQL}
SELECT l_orderkey, l_linenumber,
       CAST(coalesce(a.code, (SELECT code FROM codes WHERE feature = 'l_returnflag' AND value = 'unknown'))
            AS DOUBLE) AS l_returnflag_le,
       CAST(coalesce(b.code, (SELECT code FROM codes WHERE feature = 'l_linestatus' AND value = 'unknown'))
            AS DOUBLE) AS l_linestatus_le
FROM (SELECT *, CASE WHEN l_quantity > 45 THEN 'never seen' ELSE l_returnflag END AS flag FROM lineitem) l
LEFT JOIN codes a ON a.feature = 'l_returnflag' AND a.value = l.flag
LEFT JOIN codes b ON b.feature = 'l_linestatus' AND b.value = l.l_linestatus""")
def label_encode(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    cols = ["l_returnflag", "l_linestatus"]
    codes = encoding.category_codes(lines, cols)
    flows_ = lines.withColumn("l_returnflag", F.when(F.col("l_quantity") > 45, "never seen")
                              .otherwise(F.col("l_returnflag")))
    return encoding.encode(flows_, codes, cols).select(
        "l_orderkey", "l_linenumber", "l_returnflag_le", "l_linestatus_le")


@query("label_encode_legacy", f"""
WITH {FLOWS_SQL},
codes AS (SELECT weekday AS word, row_number() OVER (ORDER BY weekday) - 1 AS code
          FROM (SELECT DISTINCT weekday FROM flows WHERE traffic_class = 'benign' AND weekday < 'T'))
SELECT flow_id, CAST(coalesce(code, 0) AS DOUBLE) AS weekday_le
FROM flows LEFT JOIN codes ON weekday = word""")
def label_encode_legacy(spark, sf_dir):
    f = flows(spark, sf_dir)
    codes = encoding.first_class_codes(f.where(F.col("weekday") < "T"), ["weekday"], "traffic_class", "benign")
    return encoding.encode(f, codes, ["weekday"], unseen=0).select("flow_id", "weekday_le")


def _scaler_sql(columns):
    return "\nUNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS feature, round(avg({c}), 5) AS mean, round(stddev_pop({c}), 5) AS std, "
        f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 5) AS scale FROM lines"
        for i, c in enumerate(columns))


@query("scaler_fit", f"""
WITH lines AS (SELECT *, 7.0 AS constant FROM lineitem)
{_scaler_sql([*LINE_FEATURES, "constant"])}""")
def scaler_fit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(7.0))
    fitted = scaling.scaler_fit(lines, [*LINE_FEATURES, "constant"])
    return fitted.select("pos", "feature", *[F.round(c, 5).alias(c) for c in ("mean", "std", "scale")])


@query("scale_features", """
SELECT l_orderkey, l_linenumber, """ + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem), 6) AS {c}_scaled"
    for c in LINE_FEATURES) + " FROM lineitem")
def scale_features(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    stats = {r["feature"]: r for r in scaling.scaler_fit(lines, LINE_FEATURES).collect()}
    return lines.select("l_orderkey", "l_linenumber", *[
        r6(scaling.scale(F.col(c), stats[c]["mean"], stats[c]["scale"])).alias(f"{c}_scaled")
        for c in LINE_FEATURES])


def _anova_sql(columns, group, source):
    parts = "\nUNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS feature, {group} AS g, CAST({c} AS DOUBLE) AS x FROM {source}"
        for i, c in enumerate(columns))
    return f"""
long AS ({parts}),
classes AS (SELECT pos, feature, g, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM long GROUP BY ALL),
grand AS (SELECT pos, avg(x) AS gm FROM long GROUP BY pos),
scores AS (
  SELECT c.pos, feature,
         (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f_score
  FROM classes c JOIN grand USING (pos) GROUP BY c.pos, feature)"""


@query("anova_f", f"""
WITH {_anova_sql(LINE_FEATURES, 'l_returnflag', 'lineitem')}
SELECT pos, feature, round(f_score, 6) AS f_score FROM scores""")
def anova_f(spark, sf_dir):
    scores = scaling.anova_f(table(spark, sf_dir, "lineitem"), LINE_FEATURES, "l_returnflag")
    return scores.withColumn("f_score", r6(F.col("f_score")))


@query("select_k_best", f"""
WITH {_anova_sql(LINE_FEATURES, 'l_returnflag', 'lineitem')}
SELECT pos, feature FROM (SELECT * FROM scores ORDER BY f_score DESC, pos DESC LIMIT 2)""")
def select_k_best(spark, sf_dir):
    scores = scaling.anova_f(table(spark, sf_dir, "lineitem"), LINE_FEATURES, "l_returnflag")
    return scaling.select_k_best(scores, 2).select("pos", "feature")


_SPACE = ["hr", "k", "user_id", "value", "weekday_le"]


@query("fit_preprocessing", f"""
WITH {FLOWS_SQL},
codes AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS code
          FROM (SELECT weekday AS word FROM halves WHERE split = 'index' UNION SELECT 'unknown')),
enc AS (SELECT h.*, CAST(code AS DOUBLE) AS weekday_le FROM halves h JOIN codes ON weekday = word
        WHERE split = 'index'),
{_anova_sql(_SPACE, 'traffic_class', 'enc')}
SELECT feature, round(f_score, 6) AS f_score, row_number() OVER (ORDER BY f_score DESC, pos DESC) <= 3 AS selected
FROM scores""")
def fit_preprocessing(spark, sf_dir):
    index = halves(spark, sf_dir).where("split = 'index'").drop("flow_id", "ts")
    space = preprocessing.fit(index, k=3, categorical=["weekday"])
    return spark.createDataFrame(
        [(n, round(space.scores[n], 6), n in space.selected) for n in space.names],
        "feature string, f_score double, selected boolean")


@query("featurize", f"""
WITH {FLOWS_SQL},
codes AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS code
          FROM (SELECT weekday AS word FROM halves WHERE split = 'index' UNION SELECT 'unknown')),
enc AS (SELECT h.*, CAST(coalesce(code, (SELECT code FROM codes WHERE word = 'unknown')) AS DOUBLE) AS weekday_le
        FROM halves h LEFT JOIN codes ON weekday = word),
s AS (SELECT avg(hr) AS m1, stddev_pop(hr) AS s1, avg(k) AS m2, stddev_pop(k) AS s2, avg(value) AS m3,
             stddev_pop(value) AS s3, avg(weekday_le) AS m4, stddev_pop(weekday_le) AS s4
      FROM enc WHERE split = 'index')
SELECT flow_id, round((hr - m1) / s1, 6) AS f0, round((k - m2) / s2, 6) AS f1,
       round((value - m3) / s3, 6) AS f2, round((weekday_le - m4) / s4, 6) AS f3
FROM enc, s WHERE split = 'test'""")
def featurize(spark, sf_dir):
    both = halves(spark, sf_dir)
    index = both.where("split = 'index'").drop("flow_id", "ts", "user_id")
    space = preprocessing.fit(index, k=25, categorical=["weekday"])
    out = space.featurize(both.where("split = 'test'"), ["flow_id"])
    return out.select("flow_id", *[r6(F.col("features")[i]).alias(f"f{i}") for i in range(4)])


@query("flow_features", f"""
WITH {NETFLOWS_SQL},
h AS (SELECT *, md5(src_ip || '|' || dst_ip || '|' || timestamp) AS d,
             CASE upper(protocol) WHEN 'UDP' THEN 'udp' WHEN 'ICMP' THEN 'icmp' ELSE 'tcp' END AS proto
      FROM netflows)
SELECT event_id, CAST(('0x' || substr(d, 1, 8)) AS BIGINT) % 1000000 AS "Seq", duration AS "Dur", duration AS "Max",
       proto AS "Proto",
       CASE tcp_flags WHEN 'SYN' THEN 'REQ' WHEN 'FIN' THEN 'FIN' WHEN 'RST' THEN 'RST' WHEN 'ICMP' THEN 'ECO'
            ELSE 'CON' END AS "State",
       '0.0' AS "sTos", 'cs0' AS "sDSb", 'Start' AS "Cause",
       50 + CAST(('0x' || substr(d, 9, 4)) AS BIGINT) % 206 AS "sTtl",
       50 + CAST(('0x' || substr(d, 13, 4)) AS BIGINT) % 206 AS "dTtl",
       1 + CAST(('0x' || substr(d, 17, 4)) AS BIGINT) % 20 AS "sHops",
       1 + CAST(('0x' || substr(d, 21, 4)) AS BIGINT) % 20 AS "dHops",
       1000 + CAST(('0x' || substr(d, 25, 8)) AS BIGINT) % 199001 AS "Offset",
       packets_count AS "TotPkts", greatest(1, packets_count // 2) AS "SrcPkts",
       greatest(1, packets_count - packets_count // 2) AS "DstPkts",
       bytes_count AS "TotBytes", greatest(1, bytes_count // 2) AS "SrcBytes",
       greatest(1, bytes_count - bytes_count // 2) AS "DstBytes",
       round(bytes_count / greatest(packets_count, 1), 6) AS "sMeanPktSz",
       round(bytes_count / greatest(duration, 0.001), 6) AS "Rate",
       round(bytes_count / 2 / greatest(duration, 0.001), 6) AS "DstRate",
       round(CASE WHEN proto = 'tcp' THEN duration * 1000 ELSE 0 END, 6) AS "TcpRtt",
       CAST(CASE WHEN proto = 'tcp' THEN bytes_count ELSE 0 END AS DOUBLE) AS "AckDat"
FROM h""")
def flow_features_query(spark, sf_dir):
    f = flow_features(netflows(spark, sf_dir), ["event_id"])
    rounded = ("sMeanPktSz", "Rate", "DstRate", "TcpRtt")
    names = ["event_id", "Seq", "Dur", "Max", "Proto", "State", "sTos", "sDSb", "Cause", "sTtl", "dTtl", "sHops",
             "dHops", "Offset", "TotPkts", "SrcPkts", "DstPkts", "TotBytes", "SrcBytes", "DstBytes", *rounded,
             "AckDat"]
    return f.select(*[r6(F.col(n)).alias(n) if n in rounded else F.col(n) for n in names])


@query("feature_row", """
SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_type = 'click' THEN 'many' ELSE CAST(value AS VARCHAR) END
                                   AS DOUBLE), 0) AS "Dur",
       0.0::DOUBLE AS "Rate", event_type AS "Proto", 'unknown' AS "State"
FROM events""")
def feature_row_query(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    partial = e.select("event_id", F.create_map(
        F.lit("Dur"), F.when(F.col("event_type") == "click", "many").otherwise(F.col("value").cast("string")),
        F.lit("Proto"), F.col("event_type")).alias("m"))
    return partial.select("event_id", *feature_row(F.col("m"), ["Dur", "Rate"], ["Proto", "State"]))


@query("flow_event_clean_legacy", """
SELECT event_id AS row_id, CAST(event_id AS DOUBLE) AS "Seq",
       coalesce(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS DOUBLE), 0) AS "sTos",
       CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END AS "Proto"
FROM events""")
def clean_legacy(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = e.select(F.col("event_id").alias("row_id"), F.col("event_id").alias("Seq"),
                   F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string")).alias("sTos"),
                   F.when(F.col("event_type") != "view", F.col("event_type")).alias("Proto"))
    return cleaning.clean_flows_legacy(raw)


@query("stack_classes", """
SELECT 'order' AS traffic_class, o_orderkey AS id, o_totalprice AS value, NULL::VARCHAR AS extra FROM orders
UNION ALL SELECT 'part', p_partkey, p_retailprice, p_brand FROM part""")
def stack_classes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.lit("order").alias("traffic_class"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    parts = table(spark, sf_dir, "part").select(
        F.lit("part").alias("traffic_class"), F.col("p_partkey").alias("id"),
        F.col("p_retailprice").alias("value"), F.col("p_brand").alias("extra"))
    return orders.unionByName(parts, allowMissingColumns=True)


@query("non_empty_classes", """
SELECT source AS traffic_class, count(*) AS rows FROM documents GROUP BY source""")
def non_empty_classes(spark, sf_dir):
    return cleaning.non_empty_classes(
        table(spark, sf_dir, "documents").withColumnRenamed("source", "traffic_class"))


@query("featurize_selected", f"""
WITH {FLOWS_SQL},
codes AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS code
          FROM (SELECT weekday AS word FROM halves WHERE split = 'index' UNION SELECT 'unknown')),
enc AS (SELECT h.*, CAST(coalesce(code, (SELECT code FROM codes WHERE word = 'unknown')) AS DOUBLE) AS weekday_le
        FROM halves h LEFT JOIN codes ON weekday = word),
long AS (SELECT flow_id, split, traffic_class, unnest([0, 1, 2, 3]) AS pos, unnest([hr, k, value, weekday_le]) AS x FROM enc),
whole AS (SELECT pos, avg(x) AS m, stddev_pop(x) AS s, count(*) AS n, sum(x * x) - sum(x) * sum(x) / count(*) AS total
          FROM long WHERE split = 'index' GROUP BY pos),
between_ AS (SELECT pos, sum(n * (cm - m) * (cm - m)) AS ssb, count(*) AS classes FROM (
  SELECT l.pos, traffic_class, avg(x) AS cm, count(*) AS n FROM long l WHERE split = 'index' GROUP BY l.pos, traffic_class)
  JOIN (SELECT pos, m FROM whole) USING (pos) GROUP BY pos),
chosen AS (SELECT pos, m, s FROM whole JOIN between_ USING (pos)
           QUALIFY row_number() OVER (ORDER BY (ssb / (classes - 1)) / ((total - ssb) / (n - classes)) DESC, pos) <= 2),
out_ AS (SELECT flow_id, list(round((x - m) / s, 6) ORDER BY pos) AS f FROM long JOIN chosen USING (pos)
         WHERE split = 'test' GROUP BY flow_id)
SELECT flow_id, f[1] AS f0, f[2] AS f1, len(f) AS kept FROM out_""")
def featurize_selected(spark, sf_dir):
    """Two of four features are kept, those of the highest ANOVA F."""
    both = halves(spark, sf_dir)
    index = both.where("split = 'index'").drop("flow_id", "ts", "user_id")
    space = preprocessing.fit(index, k=2, categorical=["weekday"])
    out = space.featurize(both.where("split = 'test'"), ["flow_id"])
    return out.select("flow_id", *[r6(F.col("features")[i]).alias(f"f{i}") for i in range(2)], F.size("features").alias("kept"))


@query("finite_distances", """
SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 1 THEN 1000000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000 ELSE o_totalprice END, 6) AS dist
FROM orders""")
def finite_distances(spark, sf_dir):
    """NaN and infinite distances read as a large one."""
    rest = F.col("o_orderkey") % 4
    odd = F.when(rest == 1, float("nan")).when(rest == 2, float("inf")).when(rest == 3, float("-inf")).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(finite_or(odd)).alias("dist"))


@query("time_conversions", """
SELECT event_id, epoch(ts) AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
         ELSE strftime(ts, '.%f') END AS iso,
       strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, true AS same FROM events""")
def time_conversions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    seconds = times.to_epoch(F.col("ts"))
    return e.select("event_id", seconds.alias("seconds"), times.iso(F.col("ts")).alias("iso"), times.to_stamp(F.col("ts")).alias("stamp"),
                    times.display(F.col("ts")).alias("shown"), (times.from_epoch(seconds) == F.col("ts")).alias("same"))


@query("json_records", """
SELECT event_id, '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0
         THEN '' ELSE strftime(ts, '.%f') END || '","event_type":"' || event_type || '","odd":'
       || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE CAST(event_id AS VARCHAR) || '.5' END || ',"nested":{"list":['
       || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE '1.0' END || ',2.0]},"none":null}' AS record
FROM events""")
def json_records(spark, sf_dir):
    """Rows as JSON text, with what JSON has no form for."""
    odd = F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("event_id") + 0.5)
    pair = F.array(F.when(F.col("event_id") % 2 == 0, float("inf")).otherwise(1.0), F.lit(2.0))
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", odd.alias("odd"),
                                              F.struct(pair.alias("list")).alias("nested"), F.lit(None).cast("date").alias("none"))
    return e.select("event_id", records.json_record(e.schema).alias("record"))
