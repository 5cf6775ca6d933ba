"""Queries of the agent's audit log, and of what models write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import audit, graph, parsing, store
from corpuscle.sources.tables import table
from corpuscle.streaming import pairing


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "audit_log")


def audit_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return audit.outcomes(_log(spark, folder))


def audit_tail(spark: SparkSession, folder: str) -> DataFrame:
    return audit.tail(_log(spark, folder), 50).select("rec_no", "ts", "call_id", "phase", "tool")


def repeated_calls(spark: SparkSession, folder: str) -> DataFrame:
    return audit.repeated_calls(_log(spark, folder))


def tool_use(spark: SparkSession, folder: str) -> DataFrame:
    return audit.by_tool(_log(spark, folder))


def stream_audit(spark: SparkSession, folder: str) -> DataFrame:
    return pairing.drain(pairing.paired_calls(pairing.log_stream(spark, f"{folder}/audit_log.parque[t]", _log(spark, folder).schema)))


def react_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Replies written from the log's intents, read back."""
    written = F.concat_ws("\n", F.concat(F.lit("Thought: "), "phase"), F.concat(F.lit("**Action:** `"), "tool", F.lit("`")), F.concat(F.lit("action input： \""), "arg", F.lit("\"")))
    steps = _log(spark, folder).select("rec_no", written.alias("reply")).select("rec_no", parsing.agent_step(F.col("reply")).alias("s"))
    return steps.select("rec_no", "s.thought", "s.action", "s.argument", "s.final")


def triples_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the graph written as text, one text for each head, read back."""
    edges = graph.linked_terms(table(spark, folder, "mentions"))
    written = edges.groupBy("head").agg(F.array_join(F.collect_list(F.concat(F.lit("（"), "head", F.lit("，"), "relation", F.lit(", "), "tail", F.lit("）"))), "\n").alias("text"))
    return parsing.triples(written.withColumnRenamed("head", "about"), "about", "text").select("head", "relation", "tail")


def citations(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of chunks by title, written into a sentence, read back and resolved to documents."""
    written = F.concat(F.lit("依据["), "title", F.lit(" (块 "), "chunk_index", F.lit(")]，另见"), F.coalesce("context", F.lit("")))
    cited = parsing.citations(table(spark, folder, "chunks").select("chunk_row", written.alias("text")).where("text IS NOT NULL"), "chunk_row", "text")
    return parsing.resolve_citations(cited, table(spark, folder, "kb_docs")).select("chunk_row", "name", "chunk_index", "doc_id")


def json_parse(spark: SparkSession, folder: str) -> DataFrame:
    written = F.concat(F.lit("Here it is [see below:\n```json\n"), "props", F.lit("\n``` done {"))
    return table(spark, folder, "events").where("props IS NOT NULL").select("event_id", parsing.extract_json(written).alias("found"))


def latest_records(spark: SparkSession, folder: str) -> DataFrame:
    once = store.latest(_log(spark, folder), ["call_id", "phase"], F.desc_nulls_last("ts"), F.desc("rec_no"))
    return once.select("rec_no", "call_id", "phase", "ok")


NAMES = "audit_outcomes audit_tail repeated_calls tool_use stream_audit react_parse triples_parse citations json_parse latest_records".split()
QUERIES = {name: globals()[name] for name in NAMES}
ORACLES = {
    "audit_outcomes": """WITH o AS (SELECT DISTINCT call_id, ts, phase, tool, actor, ok, detail FROM audit_log WHERE call_id IS NOT NULL)
      SELECT call_id, min(tool) AS tool, min(actor) AS actor, count(*) AS n_records, CASE WHEN NOT bool_or(coalesce(phase = 'intent', false)) THEN 'orphan' WHEN bool_or(coalesce(phase = 'denied', false)) THEN 'denied'
        WHEN bool_or(phase = 'result' AND NOT coalesce(ok, false)) THEN 'failed' WHEN bool_or(coalesce(phase = 'result', false)) THEN 'done' ELSE 'open' END AS outcome FROM o GROUP BY call_id""",
    "audit_tail": "SELECT rec_no, ts, call_id, phase, tool FROM audit_log WHERE ts IS NOT NULL ORDER BY ts DESC, rec_no DESC LIMIT 50",
    "repeated_calls": """SELECT rec_no, actor, tool, arg, nth FROM (SELECT *, row_number() OVER (PARTITION BY actor, lower(tool), trim(arg) ORDER BY ts NULLS FIRST, rec_no) AS nth FROM audit_log WHERE phase = 'intent' AND tool IS NOT NULL) WHERE nth > 1""",
    "tool_use": "SELECT tool, phase, count(*) AS n, count(DISTINCT actor) AS n_actors FROM (SELECT DISTINCT call_id, ts, phase, tool, actor, detail FROM audit_log) GROUP BY ALL",
    "stream_audit": """WITH l AS (SELECT DISTINCT call_id, phase, tool, CAST(epoch(CAST(ts AS TIMESTAMPTZ)) AS BIGINT) AS t, ok FROM audit_log WHERE call_id IS NOT NULL AND try_cast(ts AS TIMESTAMPTZ) IS NOT NULL),
      p AS (SELECT i.call_id, i.tool, i.t, r.t - i.t AS seconds, CASE WHEN r.call_id IS NULL THEN 'open' WHEN r.phase = 'denied' THEN 'denied' WHEN coalesce(r.ok, false) THEN 'done' ELSE 'failed' END AS outcome
        FROM (FROM l WHERE phase = 'intent') i LEFT JOIN (FROM l WHERE phase IN ('result', 'denied')) r ON r.call_id = i.call_id AND r.t BETWEEN i.t AND i.t + 3600)
      SELECT call_id, tool, min(seconds) AS seconds, arg_min(outcome, list_position(['denied', 'failed', 'done', 'open'], outcome)) AS outcome FROM p
      WHERE outcome <> 'open' OR t + 7200 < (SELECT max(t) FROM l) GROUP BY ALL""",
    "react_parse": """WITH c AS (SELECT rec_no, phase, tool, trim(regexp_replace('"' || replace(replace(arg, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || '"', '(?s)\\n\\n.*$', '')) AS a FROM audit_log)
      SELECT rec_no, nullif(trim(phase), '') AS thought, CASE WHEN a IS NOT NULL THEN tool END AS action,
        CASE WHEN tool IS NOT NULL THEN trim(regexp_replace(CASE WHEN length(a) > 1 AND ends_with(a, '"') THEN a[2:-2] ELSE a END, '\\s+', ' ', 'g')) END AS argument, CAST(NULL AS VARCHAR) AS final FROM c""",
    "triples_parse": """WITH p AS (SELECT DISTINCT chunk_id, entity_id FROM mentions), e AS (SELECT DISTINCT entity_id AS head, 'next' AS relation, tail FROM (SELECT *, lead(entity_id) OVER (PARTITION BY chunk_id ORDER BY encode(entity_id)) AS tail FROM p) WHERE tail IS NOT NULL)
      SELECT * FROM e WHERE octet_length(encode(head)) <= 128 AND octet_length(encode(tail)) <= 128""",
    "citations": """WITH names AS (SELECT name, arg_min(doc_id, k || doc_id) AS doc_id FROM (SELECT title AS name, '1' AS k, doc_id FROM kb_docs UNION ALL SELECT source, '2', doc_id FROM kb_docs
        UNION ALL SELECT regexp_extract(source, '([^/\\\\]*)$', 1), '3', doc_id FROM kb_docs) WHERE name <> '' GROUP BY name)
      SELECT chunk_row, trim(title) AS name, CAST(chunk_index AS BIGINT) AS chunk_index, n.doc_id FROM chunks LEFT JOIN names n ON n.name = trim(title) WHERE title IS NOT NULL AND title <> ''""",
    "json_parse": "SELECT event_id, replace(replace(props, ': ', ':'), ', ', ',') AS found FROM events WHERE props IS NOT NULL",
    "latest_records": "SELECT rec_no, call_id, phase, ok FROM (SELECT *, row_number() OVER (PARTITION BY call_id, phase ORDER BY ts DESC NULLS LAST, rec_no DESC) AS p FROM audit_log) WHERE p = 1",
}
