"""Round trips: what is written to files is read back and compared with the table it came from."""

import os
import urllib.parse
import uuid

from pyspark.sql import functions as F

from catalog import query
from catalog.flows import CLASSIFY_SQL, NEIGHBOURS_SQL, _raw_refs, _round_result
from catalog.history import ALL_DOCS_SQL
from catalog.quality import table
from catalog.responses import answers
from catalog.standins import FLOWS_SQL, all_documents, halves, netflows, r6
from flowwarden import session
from flowwarden.operators import calibration, quality, splitting
from flowwarden.operators.cleaning import clean_flows
from flowwarden.plans import classify, data_quality, preprocessing, reference_index
from flowwarden.sources import flow_csv, history_store, response_log


def fresh_path(spark, name):
    """A new folder of the shared file system, deleted with the materialised tables."""
    path = os.path.join(session.shared_dir(spark), "flowwarden", f"{name}-{uuid.uuid4().hex}")
    session._created.append(path)
    return path


# a folder a day with a file a class: reordered, padded, quoted, missing and extra columns, an unnamed or no row index,
# line breaks in quotes, blank lines, rows of a wrong width, equal file names
_NAMES = {"view": "benign", "click": "synscan", "error": "udpflood", "purchase": "httpflood", "signup": "slowratedos"}
_HEADERS = {"view": ",Proto,Dur,TotPkts,note", "click": '"Dur", note ,Proto,extra', "error": "Unnamed: 0,Proto,TotPkts",
            "purchase": ",Proto,Dur,note", "signup": "Proto,Dur"}
CSV_SQL = """
e AS (SELECT event_id AS i, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type,
             CASE event_type WHEN 'view' THEN 'benign' WHEN 'click' THEN 'synscan' WHEN 'error' THEN 'udpflood'
                             WHEN 'purchase' THEN 'httpflood' ELSE 'slowratedos' END AS traffic_class,
             'd' || strftime(ts, '%d') AS day FROM events),
records AS (
  SELECT day || '/' || traffic_class || '.csv' AS file, traffic_class, i, event_type,
         day || '/' || traffic_class || '.csv:' || CASE WHEN event_type IN ('view', 'error', 'purchase') THEN CAST(i AS VARCHAR)
           ELSE 'r' || CAST(row_number() OVER (PARTITION BY day, traffic_class ORDER BY i) - 1 AS VARCHAR) END AS row_id,
         CASE event_type WHEN 'click' THEN 'udp' WHEN 'error' THEN 'icmp' ELSE 'tcp' END AS Proto,
         CASE WHEN event_type <> 'error' THEN CAST(u AS VARCHAR) END AS Dur,
         CASE WHEN event_type IN ('view', 'error') THEN CAST(k AS VARCHAR) END AS TotPkts,
         CASE event_type WHEN 'view' THEN 'plain' WHEN 'click' THEN 'say "' || i || '"'
                         WHEN 'purchase' THEN 'first' || chr(10) || chr(10) || i || ' last' END AS note,
         CASE WHEN event_type = 'click' THEN 'x' || i END AS extra,
         CASE WHEN event_type = 'signup' AND i % 5 = 0 THEN 'tcp,' || u || ',surplus' END AS corrupt_record,
         CASE event_type
           WHEN 'view' THEN i || ',tcp,' || u || ',' || k || ',plain'
           WHEN 'click' THEN CASE WHEN i % 5 = 0 THEN chr(10) ELSE '' END || u || ',"say ""' || i || '""' || '",udp,x' || i
           WHEN 'error' THEN i || ',icmp,' || k
           WHEN 'purchase' THEN i || ',tcp,' || u || ',"first' || chr(10) || chr(10) || i || ' last"'
           ELSE 'tcp,' || u || CASE WHEN i % 5 = 0 THEN ',surplus' ELSE '' END END AS line
  FROM e)
"""


def csv_folder(spark, sf_dir):
    """The files, written by Spark and then given their names."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("i"), F.col("user_id").cast("string").alias("u"), F.get_json_object("props", "$.k").alias("k"),
        "event_type", F.date_format("ts", "dd").alias("day"))
    i, kind = F.col("i").cast("string"), F.col("event_type")
    fifth = F.col("i") % 5 == 0
    text = {
        "view": F.concat(i, F.lit(",tcp,"), "u", F.lit(","), "k", F.lit(",plain")),
        "click": F.concat(F.when(fifth, "\n").otherwise(""), "u", F.lit(',"say ""'), i, F.lit('""",udp,x'), i),
        "error": F.concat(i, F.lit(",icmp,"), "k"),
        "purchase": F.concat(i, F.lit(",tcp,"), "u", F.lit(',"first\n\n'), i, F.lit(' last"')),
        "signup": F.concat(F.lit("tcp,"), "u", F.when(fifth, ",surplus").otherwise("")),
    }
    line, name, header = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for own in _NAMES:
        line = F.when(kind == own, text[own]).otherwise(line)
        name = F.when(kind == own, _NAMES[own]).otherwise(name)
        header = F.when(kind == own, _HEADERS[own]).otherwise(header)
    rows = e.select(F.concat(F.lit("d"), "day", F.lit("/"), name, F.lit(".csv")).alias("file"), "i", line.alias("line"),
                    header.alias("header"))
    heads = rows.select("file", F.lit(-1).cast("long").alias("i"), F.col("header").alias("line")).distinct()
    written, root = fresh_path(spark, "csv-parts"), fresh_path(spark, "csv")
    (rows.drop("header").unionByName(heads).repartition("file").sortWithinPartitions("file", "i").select("file", "line")
     .write.partitionBy("file").text(written))
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = make(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in files.listStatus(make(written)):
        own = folder.getPath().getName()
        if own.startswith("file="):
            to = make(f"{root}/{urllib.parse.unquote(own[5:])}")
            files.mkdirs(to.getParent())
            part = next(p.getPath() for p in files.listStatus(folder.getPath()) if p.getPath().getName().startswith("part-"))
            files.rename(part, to)
    return root


@query("csv_by_header", f"""
WITH {CSV_SQL}
SELECT row_id, traffic_class, Proto, Dur, TotPkts, note, extra, corrupt_record FROM records""")
def csv_by_header(spark, sf_dir):
    """Columns found by the names in each file's header, rows numbered by index column or position."""
    read = flow_csv.read_flow_csv(spark, csv_folder(spark, sf_dir))
    return read.select("row_id", "traffic_class", "Proto", "Dur", "TotPkts", "note", "extra", "corrupt_record")


@query("csv_clean_flows", f"""
WITH {CSV_SQL}
SELECT row_id, traffic_class, Proto, coalesce(CAST(Dur AS DOUBLE), 0) AS Dur, coalesce(CAST(TotPkts AS DOUBLE), 0) AS TotPkts
FROM records""")
def csv_clean_flows(spark, sf_dir):
    flows = clean_flows(flow_csv.read_flow_csv(spark, csv_folder(spark, sf_dir)))
    return flows.select("row_id", "traffic_class", "Proto", "Dur", "TotPkts")


_PROFILE_SQL = f"""
{CSV_SQL},
heads AS (SELECT unnest([{', '.join(f"'{k}'" for k in _NAMES)}]) AS event_type,
                 unnest([{', '.join("'" + h + "'" for h in _HEADERS.values())}]) AS header, unnest([5, 4, 3, 4, 2]) AS columns,
                 unnest(['TotBytes', 'TotPkts,TotBytes', 'TotBytes,Dur', 'TotPkts,TotBytes', 'TotPkts,TotBytes']) AS missing_columns),
files AS (
  SELECT traffic_class || '.csv' AS file_name, count(*) AS rows, columns, missing_columns,
         CASE WHEN traffic_class = 'benign' THEN 'benign' ELSE 'attack' END AS category, traffic_class,
         CASE WHEN count(*) < 100 THEN 'small' ELSE 'ok' END AS status,
         round((sum(octet_length(encode(line)) + 1) + octet_length(encode(header)) + 1) / 1048576.0, 6) AS size_mb
  FROM records JOIN heads USING (event_type) GROUP BY file, traffic_class, columns, missing_columns, header)
"""


@query("csv_file_profile", f"""
WITH {_PROFILE_SQL}
SELECT file_name, rows, columns, missing_columns, category, traffic_class, status, size_mb FROM files""")
def csv_file_profile(spark, sf_dir):
    """Records as a parser counts them, columns, size and missing columns of every file."""
    files = quality.file_profile(spark, csv_folder(spark, sf_dir))
    return files.select("file_name", "rows", "columns", F.array_join("missing_columns", ",").alias("missing_columns"), "category",
                        "traffic_class", "status", r6(F.col("size_mb")).alias("size_mb"))


@query("data_quality_report", f"""
WITH {_PROFILE_SQL},
expected AS (SELECT unnest(['benign', 'httpflood', 'icmpflood', 'slowratedos', 'synflood', 'synscan', 'tcpconnectscan',
                            'udpflood', 'udpscan']) AS traffic_class)
SELECT 'category' AS part, category AS name, count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows FROM files GROUP BY category
UNION ALL SELECT CASE WHEN traffic_class IN (SELECT traffic_class FROM files) THEN 'found' ELSE 'not found' END, traffic_class, NULL, NULL
FROM expected
UNION ALL SELECT 'missing', traffic_class, NULL, NULL FROM expected WHERE traffic_class NOT IN (SELECT traffic_class FROM files)
UNION ALL SELECT 'summary', CASE WHEN count(*) < 5 THEN 'few' ELSE 'enough' END, count(*), CAST(sum(rows) AS BIGINT) FROM files""")
def data_quality_report(spark, sf_dir):
    report = data_quality.data_quality_report(spark, csv_folder(spark, sf_dir))
    none = F.lit(None).cast("long")
    parts = [
        report["categories"].select(F.lit("category").alias("part"), F.col("category").alias("name"), "files", "rows"),
        report["coverage"].select(F.when(F.col("found"), "found").otherwise("not found"), "traffic_class", none, none),
        report["missing"].select(F.lit("missing"), "traffic_class", none, none),
        report["summary"].select(F.lit("summary"), F.when(F.col("few_files"), "few").otherwise("enough"), "files", "rows")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("reference_round_trip", f"""
WITH {NEIGHBOURS_SQL}, {CLASSIFY_SQL}
SELECT query_id AS flow_id, classification, round(confidence, 6) AS confidence, attack_type FROM decided""")
def reference_round_trip(spark, sf_dir):
    """Classify with an index that was saved and loaded; the feature space leaves the features as they are."""
    from flowwarden.operators import knn

    refs = _raw_refs(spark, sf_dir)
    index = knn.build_cells(refs)
    space = preprocessing.fit(halves(spark, sf_dir).where("split = 'index'").drop("flow_id", "ts", "user_id"), categorical=["weekday"])
    metadata = calibration.index_metadata(refs, None, "benign").withColumn("calibration", F.struct(
        F.lit(0.0).alias("p5"), F.lit(1.0).alias("p95")))
    rows = halves(spark, sf_dir).where("split = 'index'").select(
        F.col("traffic_class").alias("grp"), F.col("flow_id").alias("row_id"), F.struct("value").alias("flow"))
    cal = refs.select("grp").distinct().select("grp", F.lit(0.0).alias("p5"), F.lit(1.0).alias("p95"))
    path = fresh_path(spark, "reference")
    reference_index.save(reference_index.ReferenceIndex(space, index, cal, metadata, rows), path)
    loaded = reference_index.load(spark, path)
    held_out = halves(spark, sf_dir).where("split = 'test'")
    asked = knn.query_rows(held_out, "flow_id", F.array("value", "k", "hr"))
    return _round_result(classify.classify_flows(loaded.index, asked))


@query("index_info_round_trip", f"""
WITH {FLOWS_SQL}
SELECT traffic_class, n AS num_samples, 3 AS feature_dim,
       CAST(CASE WHEN traffic_class = 'benign' THEN least(100, greatest(10, n // 50))
                 WHEN n >= 1000 THEN least(50, greatest(10, n // 20)) END AS INTEGER) AS nlist, 0.25::DOUBLE AS p5, 0.75::DOUBLE AS p95
FROM (SELECT traffic_class, count(*) AS n FROM halves WHERE split = 'index' GROUP BY traffic_class)""")
def index_info_round_trip(spark, sf_dir):
    """The metadata document, written and read again."""
    refs = _raw_refs(spark, sf_dir)
    cal = refs.select("grp").distinct().select("grp", F.lit(0.25).alias("p5"), F.lit(0.75).alias("p95"))
    space = preprocessing.fit(halves(spark, sf_dir).where("split = 'index'").drop("flow_id", "ts", "user_id"), categorical=["weekday"])
    path = fresh_path(spark, "info")
    reference_index.export_metadata_json(calibration.index_metadata(refs, cal, "benign"), space, path)
    read = reference_index.read_metadata_json(spark, path)
    return read.select("traffic_class", "num_samples", "feature_dim", "nlist", "calibration.p5", "calibration.p95")


@query("split_summary_round_trip", f"""
WITH {FLOWS_SQL}
SELECT traffic_class, count(*) FILTER (split = 'index') AS index_rows, count(*) FILTER (split = 'test') AS test_rows,
       count(*) AS total_rows FROM halves GROUP BY ROLLUP (traffic_class)""")
def split_summary_round_trip(spark, sf_dir):
    path = fresh_path(spark, "summary")
    counts = splitting.split_counts(halves(spark, sf_dir), "traffic_class")
    splitting.split_summary(counts).coalesce(1).write.json(path)
    return splitting.read_split_summary(spark, path)


@query("response_log_round_trip", """
WITH n AS (SELECT event_id, strftime(to_timestamp(event_id), '%Y%m%d_%H%M%S') AS timestamp FROM events)
SELECT 'f' || CAST(event_id AS VARCHAR) AS flow_id, timestamp, CASE WHEN event_id % 2 = 0 THEN 'analysis' ELSE 'question' END AS request_type,
       event_id % 50 AS prompt_length
FROM n ORDER BY timestamp DESC, flow_id DESC LIMIT 1000""")
def response_log_round_trip(spark, sf_dir):
    """Requests of both kinds, written to the log, read again and cut to the newest 1000."""
    path = fresh_path(spark, "log")
    e = answers(spark, sf_dir).select(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("flow_id"), F.timestamp_seconds("event_id").alias("ts"),
        F.repeat(F.lit("p"), (F.col("event_id") % 50).cast("int")).alias("prompt"), "response", "event_id",
        F.struct(F.col("attack_type").alias("attack_vector")).alias("parsed_result"))
    for kind, rest in (("analysis", 0), ("question", 1)):
        response_log.append(response_log.log_records(e.where(F.col("event_id") % 2 == rest), kind), path)
    kept = response_log.retain(response_log.read(spark, path), row_id="flow_id", keep=1000)
    return kept.select("flow_id", "timestamp", "request_type", "prompt_length")


@query("export_round_trip", f"""
WITH {ALL_DOCS_SQL}
SELECT doc_index AS index, md5(text) AS text_md5, attack_type, (SELECT count(*) FROM docs) AS total_documents, 'stand-in' AS model_name
FROM docs""")
def export_round_trip(spark, sf_dir):
    """Exported documents with the header of the export."""
    path = fresh_path(spark, "export")
    docs = all_documents(spark, sf_dir).withColumn("metadata", F.struct("attack_type"))
    history_store.export(docs, path, "stand-in")
    header = spark.read.json(f"{path}/metadata").first()
    read = spark.read.schema("index bigint, text string, metadata struct<attack_type: string>").json(f"{path}/documents")
    return read.select("index", F.md5(F.col("text").cast("binary")).alias("text_md5"), "metadata.attack_type",
                       F.lit(header["total_documents"]).alias("total_documents"), F.lit(header["model_name"]).alias("model_name"))


@query("logged_model_calls", """
SELECT count(*) AS total_analyses, 0 AS total_questions, count(*) AS total_requests, true AS timed, count(*) FILTER (event_id % 10 = 0) AS failed
FROM events WHERE event_type NOT IN ('view', 'click')""")
def logged_model_calls(spark, sf_dir):
    """Analyses by a model that fails on some prompts, logged as they are made; statistics come from the log."""
    from flowwarden.operators.threats import route
    from flowwarden.plans import analyze

    path = fresh_path(spark, "calls")
    threats = route(netflows(spark, sf_dir)).withColumn("flow_id", F.col("event_id").cast("string")).withColumn(
        "tcp_flags", F.when(F.col("event_id") % 10 == 0, "UNANSWERABLE").otherwise(F.col("tcp_flags")))
    done = analyze.analyze_threats(threats, generator=_failing_model, log_path=path)
    stats = response_log.model_stats(response_log.read(spark, path))
    failed = done.agg(F.count(F.when(F.col("model_error").contains("cannot") & (F.col("attempts") == 3)
                                     & F.col("response").isNull(), 1)).alias("failed"))
    return stats.select("total_analyses", "total_questions", "total_requests", (F.col("total_inference_time") > 0).alias("timed"),
                        F.lit(failed.first()[0]).alias("failed"))


def _failing_model():
    def generate(prompts):
        if any("UNANSWERABLE" in p for p in prompts):
            raise ValueError("cannot answer")
        return ['{"threat_level": "LOW"}' for _ in prompts]

    return generate
