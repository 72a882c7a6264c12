"""Model answers, prompts, document text and the response log."""

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import ALL_DOCS_SQL, HISTORY_SQL, NETFLOWS_SQL, all_documents, history, netflows, r6, table
from flowwarden.functions import responses as resp
from flowwarden.functions import text as txt
from flowwarden.operators import history as hist
from flowwarden.plans import analyze, similar
from flowwarden.session import spread_small
from flowwarden.sources import response_log

# one answer per event, in nine shapes: good, cut off, no JSON, odd types, two objects, blanks, absent, ...
SHAPES = [
    "'Let me think about it. {\"threat_level\": \"LOW\", \"risk_score\": ' || k || ', \"attack_vector\": \"port scan\", "
    "\"immediate_actions\": [\"block\", \"watch\"], \"technical_analysis\": \"a longer analysis of what happened, ' || k"
    " || ' times in a row\", \"rag_assisted\": true} That is all.'",
    "'{\"threat_level\": \"HIGH\", \"risk_score\": ' || k",
    "'No structure here, only ' || k || ' words.'",
    "'{\"threat_level\": \"SEVERE\", \"risk_score\": \" ' || k || ' \", \"potential_impact\": \"loss\"}'",
    "'{\"threat_level\": \"MEDIUM\", \"risk_score\": ' || k || '.7, \"investigation_steps\": \"only one\"}'",
    "'{\"risk_score\": ' || k || '} and {\"risk_score\": 1}'",
    "'{\"threat_level\": \"\", \"risk_score\": \"high\", \"attack_vector\": null, \"prevention_measures\": [], "
    "\"technical_analysis\": ' || k || '}'",
    "CAST(NULL AS VARCHAR)",
    "'```json' || chr(10) || '{\"threat_level\": \"CRITICAL\", \"risk_score\": ' || k || '99, \"rag_assisted\": \"yes\"}'"
    " || chr(10) || '```'",
]
RESPONSES_SQL = f"""
{NETFLOWS_SQL},
answers AS (
  SELECT n.*, CASE event_id % 9 {' '.join(f'WHEN {i} THEN {s}' for i, s in enumerate(SHAPES))} END AS response
  FROM (SELECT *, CAST(packets_count AS VARCHAR) AS k FROM netflows) n),
blocks AS (SELECT *, nullif(regexp_extract(response, '\\{{.*\\}}', 0, 's'), '') AS block FROM answers),
objects AS (SELECT *, CASE WHEN json_valid(block) THEN block END AS j FROM blocks)
"""


def answers(spark, sf_dir):
    shapes = [s.replace("VARCHAR", "STRING") for s in SHAPES]
    whens = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes))
    flows = spread_small(netflows(spark, sf_dir), "event_id").withColumn("k", F.col("packets_count").cast("string"))
    return flows.withColumn("response", F.expr(f"CASE event_id % 9 {whens} END"))


@query("json_extract", f"""
WITH {RESPONSES_SQL}
SELECT event_id, block, j IS NOT NULL AS valid FROM objects""")
def json_extract(spark, sf_dir):
    block = resp.json_block(F.col("response"))
    return answers(spark, sf_dir).select("event_id", block.alias("block"),
                                         resp.parse_object(block).isNotNull().alias("valid"))


def _pick(name, default):
    return (f"CASE WHEN json_extract_string(j, '$.{name}') IS NULL OR json_extract_string(j, '$.{name}') IN ('', '[]') "
            f"THEN '{default}' ELSE json_extract_string(j, '$.{name}') END")


def _pick_list(name, default):
    return (f"CASE WHEN json_extract_string(j, '$.{name}') IS NULL OR json_extract_string(j, '$.{name}') = '[]' "
            f"THEN '{'|'.join(default)}' WHEN json_type(j, '$.{name}') = 'ARRAY' "
            f"THEN array_to_string(CAST(json_extract(j, '$.{name}') AS VARCHAR[]), '|') "
            f"ELSE json_extract_string(j, '$.{name}') END")


_D = resp.DEFAULTS
ANALYSES_SQL = f"""
{RESPONSES_SQL},
analyses AS (
  SELECT event_id, timestamp, attack_type, src_ip, dst_ip, response, 'llm_parsed' AS response_source,
         CASE WHEN json_extract_string(j, '$.threat_level') IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL')
              THEN json_extract_string(j, '$.threat_level') ELSE 'HIGH' END AS threat_level,
         CASE WHEN json_type(j, '$.risk_score') <> 'VARCHAR' OR
                   regexp_full_match(trim(json_extract_string(j, '$.risk_score')), '[+-]?[0-9]+')
              THEN CAST(least(100, greatest(0, trunc(
                     CAST(trim(json_extract_string(j, '$.risk_score')) AS DOUBLE)))) AS INTEGER)
              ELSE 80 END AS risk_score,
         {_pick('attack_vector', _D['attack_vector'])} AS attack_vector,
         {_pick('potential_impact', _D['potential_impact'])} AS potential_impact,
         {_pick('technical_analysis', _D['technical_analysis'])} AS technical_analysis,
         {_pick_list('immediate_actions', _D['immediate_actions'])} AS immediate_actions,
         {_pick_list('investigation_steps', _D['investigation_steps'])} AS investigation_steps,
         {_pick_list('prevention_measures', _D['prevention_measures'])} AS prevention_measures,
         coalesce(json_extract_string(j, '$.rag_assisted') IN ('true', 'yes'), false) AS rag_assisted
  FROM objects WHERE j IS NOT NULL
  UNION ALL
  SELECT event_id, timestamp, attack_type, src_ip, dst_ip, response, 'fallback_parsed', 'HIGH', 75,
         coalesce(attack_type, '') || ' attack detected', 'Network security threat from ' || src_ip,
         left(response, 500),
         'Block source IP ' || src_ip || '|Monitor for similar attack patterns|Alert security team immediately',
         'Review full packet capture|Check for indicators of compromise|Analyze network logs for persistence',
         'Update intrusion detection signatures|Implement network segmentation|Enhanced monitoring and alerting', false
  FROM objects WHERE j IS NULL AND response IS NOT NULL
  UNION ALL
  SELECT event_id, timestamp, attack_type, src_ip, dst_ip, response, 'fallback_analysis', 'HIGH', 72,
         'Detected ' || coalesce(attack_type, '') || ' attack pattern', 'Potential compromise of ' || dst_ip,
         'System-generated analysis for ' || coalesce(attack_type, '') || ' attack',
         'Immediately block ' || src_ip || '|Monitor traffic to ' || dst_ip || '|Escalate to security team',
         'Full network traffic analysis|Endpoint security scan|Check for attack persistence',
         'Update security policies|Implement rate limiting|Deploy additional monitoring', false
  FROM objects WHERE response IS NULL)
"""
_LISTS = ("immediate_actions", "investigation_steps", "prevention_measures")
_SHOWN = ["threat_level", "risk_score", "attack_vector", "potential_impact", "technical_analysis", "rag_assisted",
          "response_source"]


def analyses(spark, sf_dir):
    return resp.parse_responses(answers(spark, sf_dir))


def _flat(df, *keep):
    a = F.col("analysis")
    return df.select(*keep, *[a[c].alias(c) for c in _SHOWN], *[F.array_join(a[c], "|").alias(c) for c in _LISTS])


_COLUMNS = ", ".join(["event_id", *_SHOWN, *_LISTS])


@query("validate_analysis", f"WITH {ANALYSES_SQL} SELECT {_COLUMNS} FROM analyses")
def validate_analysis(spark, sf_dir):
    """Every shape of answer through parse, validate and fall back."""
    return _flat(analyses(spark, sf_dir), "event_id")


@query("fallback_analysis", f"""
WITH {ANALYSES_SQL} SELECT {_COLUMNS} FROM analyses WHERE response_source <> 'llm_parsed'""")
def fallback_analysis(spark, sf_dir):
    return _flat(analyses(spark, sf_dir), "event_id").where("response_source <> 'llm_parsed'")


@query("simulated_analysis", f"""
WITH {NETFLOWS_SQL}
SELECT event_id, 70 + CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 26 AS risk_score,
       coalesce(attack_type, '') || ' attack detected' AS attack_vector,
       'Potential ' || coalesce(attack_type, '') || ' network security threat' AS potential_impact,
       'Simulated analysis for ' || coalesce(attack_type, '') || ' attack pattern' AS technical_analysis
FROM netflows""")
def simulated_analysis(spark, sf_dir):
    a = netflows(spark, sf_dir).withColumn("a", resp.simulated_analysis(F.col("event_id")))
    return a.select("event_id", "a.risk_score", "a.attack_vector", "a.potential_impact", "a.technical_analysis")


@query("response_quality", f"""
WITH {ANALYSES_SQL},
flags AS (SELECT a.event_id, coalesce(a.response, '') AS r, a.technical_analysis AS t, o.j
          FROM analyses a JOIN objects o USING (event_id))
SELECT event_id, length(r) > 0 AS has_text, contains(r, '{{') AND contains(r, '}}') AS has_json,
       j IS NOT NULL AS valid_json, contains(t, 'System-generated analysis') OR length(t) < 50 AS looks_fallback
FROM flags""")
def response_quality(spark, sf_dir):
    a = analyses(spark, sf_dir)
    flags = resp.quality(F.col("response"), F.col("analysis.technical_analysis"))
    return a.select("event_id", *[c.alias(n) for n, c in flags.items()])


@query("response_report", f"""
WITH {ANALYSES_SQL}
SELECT event_id, threat_level, length(technical_analysis) AS technical_length,
       replace(CASE WHEN length(response) > 200 THEN left(response, 200) || '...' ELSE coalesce(response, '') END,
               chr(10), ' ') AS preview
FROM analyses ORDER BY CAST(timestamp AS BIGINT) DESC, event_id DESC LIMIT 10""")
def response_report(spark, sf_dir):
    log = analyses(spark, sf_dir).select(
        F.col("timestamp").cast("bigint").alias("at"), "event_id", F.col("response").alias("full_response"),
        F.length("response").alias("response_length"), F.col("analysis").alias("parsed_result"))
    return response_log.report(log, order="at", row_id="event_id").select(
        "event_id", "threat_level", "technical_length", "preview")


@query("log_records", f"""
WITH {RESPONSES_SQL}
SELECT event_id AS flow_id, strftime(ts, '%Y%m%d_%H%M%S') AS timestamp, 'analysis' AS request_type,
       length(response) AS response_length, length(k) AS prompt_length
FROM objects JOIN events USING (event_id)""")
def log_records(spark, sf_dir):
    times = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = analyses(spark, sf_dir).join(times, "event_id").select(
        F.col("event_id").alias("flow_id"), "ts", F.col("k").alias("prompt"), "response",
        F.col("analysis").alias("parsed_result"))
    return response_log.log_records(rows, "analysis").select(
        "flow_id", "timestamp", "request_type", "response_length", "prompt_length")


@query("model_stats", """
SELECT count(*) FILTER (event_type <> 'view') AS total_analyses, count(*) FILTER (event_type = 'view') AS total_questions,
       count(*) AS total_requests, round(sum(value) FILTER (event_type <> 'view'), 4) AS total_inference_time,
       round(avg(value) FILTER (event_type <> 'view'), 6) AS average_inference_time
FROM events""")
def model_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    log = e.select(
        F.when(F.col("event_type") == "view", "question").otherwise("analysis").alias("request_type"),
        F.struct(F.col("value").alias("inference_time")).alias("parsed_result"))
    s = response_log.model_stats(log)
    return s.withColumns({"total_inference_time": F.round("total_inference_time", 4),
                          "average_inference_time": r6(F.col("average_inference_time"))})


@query("display_text", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS short_text,
       left(text, 1000) AS full_text
FROM documents""")
def display_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", txt.shorten(F.col("text"), txt.PREVIEW).alias("short_text"),
                    F.substring("text", 1, txt.FULL_TEXT).alias("full_text"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _template(text: str, values: dict[str, str]) -> str:
    out = _quote(text)
    for name, sql in values.items():
        out = out.replace("{" + name + "}", f"' || {sql} || '")
    return out


_FLOW_VALUES = {
    **{n: f"coalesce(CAST({n} AS VARCHAR), '')" for n in
       ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "bytes_count", "packets_count", "tcp_flags",
        "attack_type", "duration")},
    "confidence": "printf('%.2f', confidence)"}


@query("search_text", f"""
WITH {NETFLOWS_SQL} SELECT event_id, {_template(txt.SEARCH_TEXT, _FLOW_VALUES)} AS search_text FROM netflows""")
def search_text(spark, sf_dir):
    return netflows(spark, sf_dir).select("event_id", txt.search_text().alias("search_text"))


_CONTEXT_SQL = f"""
{HISTORY_SQL},
hits AS (SELECT q.doc_index AS query_id, r.doc_index, r.text, list_dot_product(q.u, r.u) AS score,
                row_number() OVER (PARTITION BY q.doc_index ORDER BY list_dot_product(q.u, r.u) DESC, r.doc_index) AS rank
         FROM unit q, unit r),
context AS (
  SELECT query_id, {_quote(txt.CONTEXT_TITLE)} || string_agg(
           '[Analysis ' || CAST(rank AS VARCHAR) || '] (Relevance: ' || printf('%.2f', score) || ') '
           || replace(left(text, 400), chr(10), ' '), chr(10) ORDER BY rank) || chr(10) || chr(10) AS block
  FROM hits WHERE rank <= 3 GROUP BY query_id)"""


@query("prompt_context", f"WITH {_CONTEXT_SQL} SELECT query_id, block FROM context")
def prompt_context(spark, sf_dir):
    """Past analyses rendered for a prompt: top 3 of every document."""
    return _context(spark, sf_dir).select("query_id", txt.context_block(F.col("context")).alias("block"))


def _context(spark, sf_dir):
    docs = history(spark, sf_dir)
    queries = docs.select(F.col("doc_index").alias("query_id"), "embedding")
    return analyze.context_of(hist.search(docs, queries, 3, attach=False), docs)


_SIMILAR_SQL = """CASE WHEN packets_count > 50 THEN 'Similar Attack Patterns:' || chr(10) || '- Pattern 1: similarity='
 || printf('%.2f', packets_count / 128.0) || chr(10) || '- Pattern 2: similarity=' || printf('%.2f', packets_count / 256.0)
 || chr(10) || chr(10) ELSE '' END"""


@query("prompt_analysis", f"""
WITH {NETFLOWS_SQL}, {_CONTEXT_SQL}
SELECT event_id, {_quote(txt.SYSTEM_ANALYST)} || {_template(txt.FLOW_BLOCK, _FLOW_VALUES)} || coalesce(block, '')
       || {_SIMILAR_SQL}
       || CASE WHEN block IS NULL THEN {_quote(txt.JSON_CONTRACT % 'false')}
               ELSE {_quote(txt.JSON_CONTRACT % 'true')} END AS prompt
FROM netflows LEFT JOIN context ON event_id = query_id""")
def prompt_analysis(spark, sf_dir):
    k = F.col("packets_count")
    patterns = F.array(*[F.struct(F.lit(i).alias("rank"), (k / d).alias("similarity"))
                         for i, d in ((1, 128.0), (2, 256.0), (3, 512.0))])
    flows = netflows(spark, sf_dir).withColumn("similar_flows", F.when(k > 50, patterns).otherwise(F.slice(patterns, 1, 0)))
    joined = flows.join(_context(spark, sf_dir), F.col("event_id") == F.col("query_id"), "left")
    none = F.array().cast("array<struct<rank:int,score:double,text:string,doc_index:bigint>>")
    context = F.coalesce(F.col("context"), none)
    return joined.select("event_id", txt.analysis_prompt(context, F.col("similar_flows")).alias("prompt"))


_DOC_VALUES = {
    "attack_type": "coalesce(attack_type, '')", "risk_score": "CAST(risk_score AS VARCHAR)",
    **{n: n for n in ("threat_level", "attack_vector", "potential_impact", "technical_analysis")},
    **{n: f"replace({n}, '|', ', ')" for n in _LISTS}}


@query("document_text", f"""
WITH {ANALYSES_SQL} SELECT event_id, {_template(txt.DOCUMENT_TEXT, _DOC_VALUES)} AS text FROM analyses""")
def document_text(spark, sf_dir):
    return analyses(spark, sf_dir).select(
        "event_id", txt.document_text(F.col("attack_type"), F.col("analysis")).alias("text"))


@query("document_metadata", f"""
WITH {ANALYSES_SQL}
SELECT event_id, a.attack_type, threat_level, risk_score, CAST(event_id AS DOUBLE) AS timestamp, protocol,
       packets_count AS total_packets, bytes_count AS total_bytes, round(duration, 6) AS duration, tcp_flags,
       'gpu_llm_analysis' AS analysis_source
FROM analyses a JOIN netflows USING (event_id)""")
def document_metadata(spark, sf_dir):
    meta = txt.document_metadata(F.col("attack_type"), F.col("analysis"), F.col("event_id"))
    return analyses(spark, sf_dir).select("event_id", meta.alias("m")).select("event_id", "m.*").withColumn(
        "duration", r6(F.col("duration")))


@query("analysis_payload", f"""
WITH {ANALYSES_SQL}
SELECT event_id, threat_level, risk_score, attack_vector, potential_impact AS description, technical_analysis,
       immediate_actions AS recommendations, rag_assisted
FROM analyses""")
def analysis_payload(spark, sf_dir):
    a = analyses(spark, sf_dir).withColumns({
        "flow_id": F.col("event_id"), "analysis_number": F.col("event_id"), "rag_context_used": F.lit(False)})
    p = analyze.analysis_payload(a)
    shown = ["threat_level", "risk_score", "attack_vector", "description", "technical_analysis", "rag_assisted"]
    return p.select(F.col("flow.id").alias("event_id"), *[F.col(f"analysis.{c}") for c in shown],
                    F.array_join("analysis.recommendations", "|").alias("recommendations"))


@query("standard_fields", """
SELECT event_id AS flow_id, event_type AS attack_type, '' AS src_ip, CAST(user_id AS VARCHAR) AS dst_ip, 0 AS src_port,
       0 AS dst_port, event_type AS protocol, 0 AS bytes_count, event_id AS packets_count, value AS duration,
       '' AS tcp_flags, 0.0::DOUBLE AS confidence
FROM events""")
def standard_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("flow_id"), F.col("event_type").alias("attack_type"),
        F.col("user_id").cast("string").alias("DstIP"), F.col("event_type").alias("Proto"),
        F.col("event_id").alias("TotPkts"), F.col("value").alias("duration"))
    return analyze.standard_fields(e)


# the stand-in embedder counts letters, so that SQL can say it
_LETTERS_SQL = """list_prepend(1.0, list_transform(range(97, 123), lambda c:
  CAST(length({text}) - length(replace(lower({text}), chr(CAST(c AS INTEGER)), '')) AS DOUBLE)))"""


def _letter_embedder():
    import numpy as np

    def embed(texts):
        return np.array([[1.0, *(t.lower().count(chr(c)) for c in range(97, 123))] for t in texts])

    return embed


def _length_generator():
    import json

    def generate(prompts):
        return ["Assessment follows.\n" + json.dumps({
            "threat_level": "LOW" if len(p) % 2 else "CRITICAL", "risk_score": len(p) % 120, "attack_vector": "Vector",
            "potential_impact": "Impact", "immediate_actions": ["Review flow"], "investigation_steps": ["Collect logs"],
            "prevention_measures": ["Review rules"], "technical_analysis": f"Prompt of {len(p)} characters",
            "rag_assisted": "HISTORICAL" in p}) if len(p) % 7 else "no answer" for p in prompts]

    return generate


@query("analyze_threats", f"""
WITH {NETFLOWS_SQL}, {ALL_DOCS_SQL},
threats AS (SELECT *, {_template(txt.SEARCH_TEXT, _FLOW_VALUES)} AS search_text FROM netflows WHERE classification = 'malicious'),
asked AS (SELECT DISTINCT search_text, {_LETTERS_SQL.format(text='search_text')} AS v FROM threats),
q AS (SELECT search_text, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM asked),
vectors AS (SELECT doc_index, text, {_LETTERS_SQL.format(text='text')} AS v
            FROM (SELECT doc_index, coalesce(text, '') AS text FROM docs)),
r AS (SELECT doc_index, text, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM vectors),
hits AS (SELECT *, row_number() OVER (PARTITION BY search_text ORDER BY score DESC, doc_index) AS rank
         FROM (SELECT search_text, doc_index, text, round(list_dot_product(q.u, r.u), 9) AS score FROM q, r)),
context AS (
  SELECT search_text, {_quote(txt.CONTEXT_TITLE)} || string_agg(
           '[Analysis ' || CAST(rank AS VARCHAR) || '] (Relevance: ' || printf('%.2f', score) || ') '
           || replace(left(text, 400), chr(10), ' '), chr(10) ORDER BY rank) || chr(10) || chr(10) AS block,
         string_agg(CAST(doc_index AS VARCHAR), ',' ORDER BY rank) AS context_ids, round(sum(score), 6) AS context_score
  FROM hits WHERE rank <= 3 GROUP BY search_text),
prompts AS (
  SELECT event_id, context_ids, context_score, {_quote(txt.SYSTEM_ANALYST)} || {_template(txt.FLOW_BLOCK, _FLOW_VALUES)}
         || coalesce(block, '') || CASE WHEN block IS NULL THEN {_quote(txt.JSON_CONTRACT % 'false')}
                                        ELSE {_quote(txt.JSON_CONTRACT % 'true')} END AS prompt
  FROM threats LEFT JOIN context USING (search_text))
SELECT event_id AS flow_id, context_ids, context_score, sha256(prompt) AS prompt_sha256,
       CASE WHEN length(prompt) % 7 = 0 THEN 'HIGH' WHEN length(prompt) % 2 = 1 THEN 'LOW' ELSE 'CRITICAL' END AS threat_level,
       CASE WHEN length(prompt) % 7 = 0 THEN 75 ELSE least(100, length(prompt) % 120) END AS risk_score,
       CASE WHEN length(prompt) % 7 = 0 THEN 'no answer' ELSE 'Prompt of ' || length(prompt) || ' characters' END AS technical_analysis,
       CASE WHEN length(prompt) % 7 = 0 THEN 'fallback_parsed' ELSE 'llm_parsed' END AS response_source,
       context_ids IS NOT NULL AS rag_context_used,
       length(prompt) % 7 <> 0 AND contains(prompt, 'HISTORICAL') AS rag_assisted
FROM prompts""")
def analyze_threats(spark, sf_dir):
    """Whole chain over all documents, with stand-in models: embed, retrieve, render, call, parse."""
    from flowwarden.functions.models import embed, spread
    from flowwarden.operators.threats import route

    threats = route(netflows(spark, sf_dir)).withColumnRenamed("event_id", "flow_id")
    docs = spread(all_documents(spark, sf_dir), "doc_index").withColumn("embedding", embed(F.col("text"), _letter_embedder))
    out = analyze.analyze_threats(threats, docs, embedder=_letter_embedder, generator=_length_generator)
    ids = F.array_join(F.transform("context", lambda c: c["doc_index"].cast("string")), ",")
    score = F.aggregate("context", F.lit(0.0), lambda total, c: total + F.round(c["score"], 9))
    return out.select("flow_id", ids.alias("context_ids"), r6(score).alias("context_score"),
                      F.sha2(F.col("prompt").cast("binary"), 256).alias("prompt_sha256"),
                      *[F.col(f"analysis.{c}") for c in ("threat_level", "risk_score", "technical_analysis", "response_source")],
                      "rag_context_used", "analysis.rag_assisted")


@query("attach_similar", """
WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
hits AS (SELECT q.vec_id, r.vec_id AS row_id,
                list_sum(list_transform(list_zip(q.v, r.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist,
                row_number() OVER (PARTITION BY q.vec_id ORDER BY dist, r.vec_id) AS rank
         FROM e q JOIN e r ON q.grp = r.grp AND q.grp <> '0')
SELECT vec_id, string_agg(printf('%.2f', 1 / (1 + dist)), ',' ORDER BY rank) AS shown
FROM e LEFT JOIN hits USING (vec_id) WHERE rank <= 2 OR rank IS NULL GROUP BY vec_id""")
def attach_similar(spark, sf_dir):
    from flowwarden.operators import knn

    e = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    index = knn.build_cells(knn.reference_rows(e, "vec_id", "embedding", "label"))
    found = similar.similar_flows(index, knn.query_rows(e, "vec_id", "embedding", "label"), 3, benign="0")
    out = similar.attach_similar(e, found, "vec_id")
    shown = F.array_join(F.transform("similar_flows", lambda s: txt.fixed2(s["similarity"])), ",")
    return out.select("vec_id", shown.alias("shown"))
