"""Questions about stored analyses, from conversation turns."""

from pyspark.sql import functions as F

from catalog import query
from catalog.standins import table
from flowwarden.functions import text as txt
from flowwarden.operators import questions as qs
from flowwarden.operators import recency
from flowwarden.schemas import ANALYSIS

# user turns ask; conversations with an assistant turn have a stored analysis; some questions are broken
QUESTIONS_SQL = """
asked AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id, turn,
         CASE WHEN turn % 4 = 2 THEN '   ' ELSE '  ' || text || ' ' END AS question,
         CASE WHEN conv_id % 7 = 3 THEN ' ' ELSE ' ' || CAST(conv_id AS VARCHAR) || ' ' END AS flow_id
  FROM conversations WHERE role = 'user'),
stored AS (
  SELECT CAST(conv_id AS VARCHAR) AS flow_id, min(turn) AS ts, min(text) AS attack_vector
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
clean AS (SELECT id, turn, trim(question, ' ' || chr(9) || chr(10) || chr(13)) AS question, trim(flow_id) AS flow_id
          FROM asked)
"""


def asked(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    text = lambda x: F.col(x).cast("string")
    return c.select(
        F.concat(text("conv_id"), F.lit(":"), text("turn")).alias("id"), "turn",
        F.when(F.col("turn") % 4 == 2, "   ").otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" ")))
        .alias("question"),
        F.when(F.col("conv_id") % 7 == 3, " ").otherwise(F.concat(F.lit(" "), text("conv_id"), F.lit(" ")))
        .alias("flow_id"))


def stored(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    a = c.groupBy(F.col("conv_id").cast("string").alias("flow_id")).agg(
        F.min("turn").alias("ts"), F.min("text").alias("attack_vector"))
    values = {"attack_vector": F.col("attack_vector"), "risk_score": F.col("ts").cast("int"),
              "threat_level": F.when(F.col("ts") == 1, "HIGH"),
              "immediate_actions": F.array(F.lit("block"), F.concat(F.lit('say "no" to '), F.col("flow_id")))}
    fields = [values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in ANALYSIS.fields]
    return a.select("flow_id", F.col("ts").alias("timestamp"), F.struct(*fields).alias("analysis"))


@query("question_join", f"""
WITH {QUESTIONS_SQL}
SELECT id, question, flow_id, attack_vector FROM clean JOIN stored USING (flow_id) WHERE question <> ''""")
def question_join(spark, sf_dir):
    return qs.admitted(asked(spark, sf_dir), stored(spark, sf_dir)).select(
        "id", "question", "flow_id", "analysis.attack_vector")


@query("question_rejects", f"""
WITH {QUESTIONS_SQL}
SELECT id, CASE WHEN question = '' THEN 'Question is required' WHEN flow_id = '' THEN 'Flow ID is required'
                ELSE 'No analysis found for flow_id: ' || flow_id END AS reason
FROM clean WHERE question = '' OR flow_id = '' OR flow_id NOT IN (SELECT flow_id FROM stored)""")
def question_rejects(spark, sf_dir):
    return qs.rejected(asked(spark, sf_dir), stored(spark, sf_dir)).select("id", "reason")


@query("question_order", f"""
WITH {QUESTIONS_SQL}
SELECT id, row_number() OVER (ORDER BY priority, ts, id) AS served
FROM (SELECT id, turn AS ts, 0 AS priority FROM asked UNION ALL SELECT flow_id, ts, 1 FROM stored)""")
def question_order(spark, sf_dir):
    questions = asked(spark, sf_dir).select("id", F.col("turn").alias("ts"), F.lit(qs.PRIORITY_QUESTION).alias("priority"))
    work = questions.unionByName(stored(spark, sf_dir).select(
        F.col("flow_id").alias("id"), F.col("timestamp").alias("ts"), F.lit(qs.PRIORITY_ANALYSIS).alias("priority")))
    return recency.numbered(work, ["priority", "ts", "id"], "served").select("id", "served")


_ANALYSIS_JSON = """'{' || chr(10) || CASE WHEN ts = 1 THEN '  "threat_level": "HIGH",' || chr(10) ELSE '' END
 || '  "risk_score": ' || CAST(ts AS VARCHAR) || ',' || chr(10)
 || '  "attack_vector": ' || CAST(to_json(attack_vector) AS VARCHAR) || ',' || chr(10)
 || '  "immediate_actions": [' || chr(10) || '    "block",' || chr(10)
 || '    "say \\"no\\" to ' || flow_id || '"' || chr(10) || '  ]' || chr(10) || '}'"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("prompt_question", f"""
WITH {QUESTIONS_SQL}
SELECT id, {_quote(txt.QUESTION_HEAD)} || {_ANALYSIS_JSON} || chr(10) || chr(10) || 'USER QUESTION: ' || question
       || {_quote(txt.QUESTION_TAIL)} AS prompt
FROM clean JOIN stored USING (flow_id) WHERE question <> ''""")
def prompt_question(spark, sf_dir):
    good = qs.admitted(asked(spark, sf_dir), stored(spark, sf_dir))
    return good.select("id", txt.question_prompt(F.col("analysis"), F.col("question")).alias("prompt"))


@query("question_answers", f"""
WITH {QUESTIONS_SQL}
SELECT 'q_' || sha256(id) AS question_id, flow_id, question, {_quote(qs.NO_MODEL_ANSWER)} AS answer,
       CAST(turn AS VARCHAR) AS timestamp, 0.1::DOUBLE AS inference_time, false AS error
FROM clean JOIN stored USING (flow_id) WHERE question <> ''""")
def question_answers(spark, sf_dir):
    good = qs.admitted(asked(spark, sf_dir), stored(spark, sf_dir)).withColumns({
        "question_id": qs.question_id("id"), "timestamp": F.col("turn").cast("string")})
    return qs.payload(qs.answer(good))


@query("available_analyses", f"""
WITH {QUESTIONS_SQL}
SELECT flow_id, attack_vector AS attack_type, CASE WHEN ts = 1 THEN 'HIGH' ELSE 'Unknown' END AS threat_level,
       CAST(ts AS VARCHAR) AS timestamp, false AS rag_assisted
FROM stored""")
def available_analyses(spark, sf_dir):
    return qs.available(stored(spark, sf_dir))


def _counting_model():
    def generate(prompts):
        if any(len(p) % 11 == 0 for p in prompts):
            raise ValueError("cannot answer")
        return [f"{len(p)} characters" for p in prompts]

    return generate


@query("question_answers_model", f"""
WITH {QUESTIONS_SQL},
prompts AS (SELECT *, length({_quote(txt.QUESTION_HEAD)} || {_ANALYSIS_JSON} || chr(10) || chr(10) || 'USER QUESTION: ' || question
                             || {_quote(txt.QUESTION_TAIL)}) AS n FROM clean JOIN stored USING (flow_id) WHERE question <> '')
SELECT id AS question_id, flow_id, question, 'r' || id AS requester_id, true AS timed, n % 11 = 0 AS error,
       CASE WHEN n % 11 = 0 THEN 'Error processing question: model call failed' ELSE n || ' characters' END AS answer
FROM prompts""")
def question_answers_model(spark, sf_dir):
    """Answers of a model that fails on some prompts, with their requester; the time of a call is kept."""
    q = asked(spark, sf_dir).withColumns({"question_id": F.col("id"), "timestamp": F.col("turn").cast("string"),
                                          "requester_id": F.concat(F.lit("r"), "id")})
    answers, _ = qs.answer_questions(q, stored(spark, sf_dir), _counting_model)
    return answers.select("question_id", "flow_id", "question", "requester_id", (F.col("inference_time") > 0).alias("timed"),
                          "error", "answer")
