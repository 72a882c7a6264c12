"""Analysis history: search, listings, statistics, retention."""

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import ALL_DOCS_SQL, FLOWS_SQL, HISTORY_SQL, all_documents, flows, history, r6
from flowwarden.functions.models import embed
from flowwarden.operators import history as hist
from flowwarden.operators import recency
from flowwarden.sources import history_store

_SCORES = """
scores AS (SELECT q.doc_index AS query_id, q.attack_type AS qtype, r.doc_index, r.attack_type, r.ts,
                  list_dot_product(q.u, r.u) AS score FROM unit q, unit r)"""


def _queries(docs):
    return docs.select(F.col("doc_index").alias("query_id"), "attack_type", "embedding")


def _scored(df, *cols):
    return df.select("query_id", *cols, "doc_index", "rank", r6(F.col("score")).alias("score"))


@query("history_search", f"""
WITH {HISTORY_SQL}, {_SCORES}
SELECT query_id, doc_index, rank, round(score, 6) AS score, attack_type
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index) AS rank FROM scores)
WHERE rank <= 5""")
def history_search(spark, sf_dir):
    docs = history(spark, sf_dir)
    return _scored(hist.search(docs, _queries(docs), 5), "attack_type")


@query("history_search_cells", f"""
WITH {HISTORY_SQL}, {_SCORES}
SELECT query_id, doc_index, rank, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index) AS rank FROM scores)
WHERE rank <= 5""")
def history_search_cells(spark, sf_dir):
    """The same search through cells, as for vectors of few dimensions."""
    docs = history(spark, sf_dir)
    return _scored(hist.search(docs, _queries(docs), 5, strategy="cells", attach=False))


@query("history_search_within_type", f"""
WITH {HISTORY_SQL}, {_SCORES}
SELECT query_id, attack_type, doc_index, rank, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index) AS rank FROM scores
      WHERE qtype = attack_type) WHERE rank <= 5""")
def history_search_within_type(spark, sf_dir):
    docs = history(spark, sf_dir)
    return _scored(hist.search_within_types(docs, _queries(docs), 5), "attack_type")


@query("history_search_one_type", f"""
WITH {HISTORY_SQL}, {_SCORES}
SELECT query_id, doc_index, rank, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index) AS rank FROM scores
      WHERE attack_type = 'src3') WHERE rank <= 5""")
def history_search_one_type(spark, sf_dir):
    docs = history(spark, sf_dir)
    return _scored(hist.search(docs, _queries(docs), 5, attack_type="SRC3", recent_only=True, attach=False))


@query("history_recent_search", f"""
WITH {HISTORY_SQL}, {_SCORES},
newest AS (SELECT doc_index FROM unit ORDER BY ts DESC, doc_index LIMIT 100)
SELECT query_id, doc_index, rank, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_index) AS rank FROM scores
      WHERE doc_index IN (SELECT doc_index FROM newest)) WHERE rank <= 5""")
def history_recent_search(spark, sf_dir):
    docs = history(spark, sf_dir)
    return _scored(hist.search(docs, _queries(docs), 5, recent_only=True, attach=False))


@query("history_by_type", f"""
WITH {HISTORY_SQL}
SELECT attack_type, doc_index, rank, round(score, 6) AS score
FROM (SELECT *, u[1] AS score, row_number() OVER (PARTITION BY attack_type ORDER BY u[1] DESC, doc_index) AS rank
      FROM unit) WHERE rank <= 5""")
def history_by_type(spark, sf_dir):
    docs = history(spark, sf_dir)
    empty = spark.range(1).select(embed(F.lit("")).alias("embedding"))
    return hist.by_type(docs, empty, 5).withColumn("score", r6(F.col("score")))


@query("history_recent", f"""
WITH {ALL_DOCS_SQL}
SELECT doc_index, attack_type, 1.0::DOUBLE AS score FROM docs ORDER BY ts DESC, doc_index LIMIT 10""")
def history_recent(spark, sf_dir):
    return hist.recent(all_documents(spark, sf_dir)).select("doc_index", "attack_type", "score")


@query("history_stats", f"""
WITH {ALL_DOCS_SQL}
SELECT attack_type, count(*) AS documents, max(ts) AS most_recent, min(ts) AS oldest
FROM docs GROUP BY ROLLUP (attack_type)""")
def history_stats(spark, sf_dir):
    return hist.stats(all_documents(spark, sf_dir))


@query("type_listing", f"""
WITH {ALL_DOCS_SQL}
SELECT attack_type, count(*) AS documents FROM docs GROUP BY attack_type ORDER BY attack_type""")
def type_listing(spark, sf_dir):
    return hist.type_listing(all_documents(spark, sf_dir))


@query("type_index", "SELECT lower(source) AS attack_type, doc_id AS doc_index FROM documents")
def type_index(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hist.type_index(docs.select(F.col("source").alias("attack_type"), F.col("doc_id").alias("doc_index")))


@query("retention", """
SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 1000""")
def retention(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return recency.keep_newest(events, "ts", "event_id").select("event_id")


@query("retention_report", """
SELECT count(*) AS total, least(count(*), 1000) AS kept, count(*) - least(count(*), 1000) AS removed FROM events""")
def retention_report(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return recency.retention_report(events, "ts", "event_id")


@query("renumber", """
SELECT doc_id AS old_index, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index
FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 300)""")
def renumber(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("doc_index"), F.col("n_chars").alias("ts"))
    return hist.retain(docs, 300).select("old_index", "doc_index")


@query("append_numbered", """
SELECT doc_id, (SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY n_chars, doc_id) AS doc_index
FROM documents""")
def append_numbered(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stored = docs.select(F.col("doc_id").alias("doc_index"))
    return hist.append_numbered(stored, docs.select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select(
        "doc_id", "doc_index")


@query("evict_oldest", """
SELECT event_id FROM events
WHERE event_id NOT IN (SELECT event_id FROM events ORDER BY ts, event_id LIMIT 50)""")
def evict_oldest(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return recency.evict_oldest(events, "ts", "event_id").select("event_id")


@query("export_documents", f"""
WITH {ALL_DOCS_SQL}
SELECT doc_index AS index, text, attack_type AS metadata FROM docs""")
def export_documents(spark, sf_dir):
    return history_store.export_rows(all_documents(spark, sf_dir).withColumn("metadata", F.col("attack_type")))


@query("last_n_flows", f"""
WITH {FLOWS_SQL}
SELECT flow_id, traffic_class FROM (SELECT * FROM flows ORDER BY ts DESC, flow_id DESC LIMIT 200)""")
def last_n_flows(spark, sf_dir):
    return recency.last_in_arrival_order(flows(spark, sf_dir), "ts", "flow_id", recency.FLOW_HISTORY).select(
        "flow_id", "traffic_class")


@query("running_number", f"""
WITH {FLOWS_SQL}
SELECT flow_id, row_number() OVER (ORDER BY ts, flow_id) AS analysis_number FROM flows""")
def running_number(spark, sf_dir):
    return recency.numbered(flows(spark, sf_dir), ["ts", "flow_id"], "analysis_number").select(
        "flow_id", "analysis_number")


@query("newest_first", f"""
WITH {FLOWS_SQL}
SELECT flow_id, ts FROM flows ORDER BY ts DESC, flow_id""")
def newest_first(spark, sf_dir):
    return recency.newest_first(flows(spark, sf_dir).select("flow_id", "ts"), "ts", "flow_id")
