"""Ingest, status changes, segmentation, graph, parsing, files and streams on small cases."""

import json
import uuid

from pyspark.sql import functions as F

from corpuscle.functions import ids, models, text
from corpuscle.operators import audit, graph, parsing, segment, store
from corpuscle.plans import collection
from corpuscle.sources import files
from corpuscle.streaming import ingest, pairing


def test_ids_equal_the_standard_library(spark):
    df = spark.createDataFrame([("d1", 0), ("ü文", 12)], "d string, i int")
    for r in df.select("d", "i", ids.chunk_id(F.col("d"), F.col("i")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.UUID(ids.CHUNK_NAMESPACE), f"{r.d}::{r.i}"))


def test_text_functions(spark):
    df = spark.createDataFrame([(" a\r\n\r\n\r\n\r\nb \t\nc　﻿", "x/细则v2_2025-06-01.md"), ("", "1234v1.2"), (None, None)], "t string, p string")
    got = df.select(text.normalize_text(F.col("t")).alias("n"), text.version_hint(F.col("p")).alias("v"), text.sentences(F.col("t")).alias("s")).collect()
    assert [r.n for r in got] == ["a\n\nb\nc", "", None]
    assert (got[0].v.doc_version, got[0].v.effective_from, got[1].v.doc_version) == ("v2", "2025-06-01", None)
    marks = spark.createDataFrame([("他说：“好。”然后！？走了\n\n3.5kV",)], "t string")
    assert marks.select(text.sentences(F.col("t"))).first()[0] == ["他说：“好。”", "然后！？", "走了", "3.5kV"]
    long = marks.select(text.truncate_middle(F.lit("x" * 50 + "y" * 50), 20, 0.6, "..")).first()[0]
    assert long == "x" * 10 + ".." + "y" * 8


def test_segmentation(spark):
    body = "第一章 总则\n" + "甲" * 300 + "。" + "乙" * 40 + "。" + "丙" * 300 + "。\n## 附则\n" + "丁" * 1200
    spans = segment.chunk_spans(body)
    pieces = [body[s:e] for s, e, _ in spans]
    assert pieces[0].startswith("第一章") and pieces[1].startswith("乙") and spans[0][2] == "第一章 总则" and spans[-1][2] == "## 附则"
    assert all(len(p) <= 512 + 64 + 2 for p in pieces) and sum(p.count("丁") for p in pieces) == 1200
    assert segment.chunk_spans("  \n ") == []
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "id long, text string")
    assert segment.chunk_documents(df, "id", "text").groupBy("id").count().collect()[0]["count"] == len(spans)


def test_document_states(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, chunk_index int, h string")
    stored = make([("same", 0, "a"), ("same", 1, "a"), ("shrunk", 0, "a"), ("shrunk", 1, "b"), ("gone", 0, "a"), ("moved", 0, "x")])
    new = make([("same", 0, "a"), ("same", 1, "a"), ("shrunk", 0, "a"), ("fresh", 0, "a"), ("moved", 1, "x")])
    got = {r.doc_id: r.state for r in store.document_state(stored, new).collect()}
    assert got == {"same": "unchanged", "shrunk": "changed", "fresh": "new", "moved": "changed"}


def test_upsert_keeps_null_keys_once(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([("a", 3), ("a", 4), (None, 5)], "k string, v int")
    assert {tuple(r) for r in store.upsert(old, new, ["k"], F.desc("v")).collect()} == {("a", 4), (None, 5)}


def test_mark_and_restore(spark):
    rows = [("d", 0, 1, "current", "v1", "t"), ("d", 1, 2, None, "", None), ("m", 0, 3, "superseded", None, ""), ("m", 1, 4, "current", None, "x"), ("s", 0, 5, "superseded", "v1", "y"), ("o", 0, 6, None, None, None)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, chunk_row long, status string, doc_version string, title string")
    listed = {r.doc_id: (r.status, r.mixed, r.title) for r in store.list_documents(chunks).collect()}
    assert listed["m"] == ("superseded", True, "x") and listed["d"] == ("current", False, "t") and listed["o"] == ("current", False, None)
    marked = store.mark_superseded(chunks, chunks.where("doc_id <> 'o'"), "why")
    assert {r.doc_id: r.outcome for r in marked.collect()} == {"d": "marked", "m": "denied", "s": "unchanged", "o": None}
    back = store.restore(marked, marked.where("outcome = 'marked'"))
    assert {r.chunk_row: r.status for r in back.collect()} == {1: "current", 2: "current", 3: "superseded", 4: "current", 5: "superseded", 6: None}


def test_graph_walks_cycles_and_merges(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("c", "r", "b"), ("c", "r", "d"), ("d", "r", "a"), ("a", "r", "b")], "head string, relation string, tail string")
    seeds = spark.createDataFrame([(1, "a", 0.8)], "query_id long, node string, score double")
    hops = {(r.head, r.tail): r.hop for r in graph.expand(seeds, edges, 2).collect()}
    assert hops == {("a", "b"): 1, ("d", "a"): 1, ("c", "b"): 2, ("c", "d"): 2}
    scored = {(r.head, r.tail): r.score for r in graph.score_facts(graph.expand(seeds, edges, 2), seeds).collect()}
    assert scored[("a", "b")] == 0.8 and scored[("c", "d")] == 0.0
    mentions = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "a"), ("y", "b"), ("z", "q")], "chunk_id string, entity_id string")
    chunks = spark.createDataFrame([("x",), ("y",)], "chunk_id string")
    nodes = spark.createDataFrame([(1, "a"), (1, "b"), (1, "q")], "query_id long, node string")
    found = [(r.chunk_id, r.hits, r.rank) for r in graph.mentioning(nodes, mentions, chunks, 5).orderBy("rank").collect()]
    assert found == [("x", 2, 0), ("y", 1, 1)]
    vector = spark.createDataFrame([(1, "x", 0.5), (1, "w", 0.4)], "query_id long, chunk_id string, score double")
    merged = {r.chunk_id: (r.score, r.graph_hits, r.from_graph) for r in graph.merge_candidates(vector, graph.mentioning(nodes, mentions, chunks, 5)).collect()}
    assert merged == {"x": (0.5, 2, False), "w": (0.4, 0, False), "y": (0.0, 1, True)}
    assert {r.id for r in graph.orphans(nodes.select(F.col("node").alias("id")).union(spark.createDataFrame([("e",), ("d",)], "id string")), mentions, edges).collect()} == {"e"}


def test_alike_entities(spark):
    rows = [("e1", "“开关柜A”", None), ("e2", "开关柜Ａ", ["x"]), ("e3", "别名", ["开 关柜A", None]), ("e4", None, None)]
    entities = spark.createDataFrame(rows, "id string, name string, aliases array<string>")
    links = graph.alike_names(entities)
    assert {tuple(r) for r in links.collect()} == {("e1", "e2"), ("e1", "e3")}
    groups = graph.components(links)
    assert {tuple(r) for r in groups.collect()} == {("e1", "e1"), ("e2", "e1"), ("e3", "e1")}
    names = graph.canonical(groups, spark.createDataFrame([("e3", 4)], "id string, degree long"), entities)
    edges = spark.createDataFrame([("e1", "位于", "z"), ("e2", "位于", "z"), ("e1", "r", "e2"), ("s", "r", "s")], "head string, relation string, tail string")
    assert {tuple(r) for r in graph.relabel(edges, names).collect()} == {("e3", "位于", "z"), ("s", "r", "s")}
    assert graph.components(links.limit(0)).count() == 0


def test_long_chain_is_one_component(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.group_id for r in graph.components(chain).collect()} == {0}


def test_parsing(spark):
    reply = "**Thought:** look\n**Action**：`search`\nAction Input: “锅炉”\n"
    df = spark.createDataFrame([(1, reply), (2, "Final Answer: 一\n二"), (3, "prose"), (4, None)], "id long, t string")
    got = {r.id: r.s for r in df.select("id", parsing.agent_step(F.col("t")).alias("s")).collect()}
    assert (got[1].thought, got[1].action, got[1].argument) == ("look", "search", "锅炉") and got[2].final == "一\n二"
    assert got[3] == got[4] == (None, None, None, None)
    cites = spark.createDataFrame([(1, "见[甲 (块 3)]与【乙（块 4）】"), (2, None)], "id long, t string")
    assert {(r.name, r.chunk_index) for r in parsing.citations(cites, "id", "t").collect()} == {("甲", 3), ("乙", 4)}
    triples = spark.createDataFrame([(1, "（甲，位于，乙）\n(a, b, c, d)\n(a, , c)\n(" + "长" * 50 + ", b, c)")], "id long, t string")
    assert {tuple(r)[1:] for r in parsing.triples(triples, "id", "t").collect()} == {("甲", "位于", "乙"), ("a", "b, c", "d")}
    replies = spark.createDataFrame([(1, 'ok [["a", "r", "b"], ["a", "r"], ["", "r", "b"]]'), (2, '[{"head": "x", "relation": "r", "tail": " y "}, {"head": "x"}]'), (3, "none"), (4, None)], "id long, t string")
    assert {tuple(r) for r in parsing.json_triples(replies, "id", "t").collect()} == {(1, "a", "r", "b"), (2, "x", "r", "y")}
    assert json.loads(parsing.first_json('x [1, {"a": "}"}] y')) == [1, {"a": "}"}] and parsing.first_json("{broken") is None and parsing.first_json(None) is None


def test_models_are_deterministic(spark):
    df = spark.createDataFrame([(1, "泵站 巡检"), (2, ""), (3, None)], "id long, t string")
    got = {r.id: r.e for r in df.select("id", models.embed(F.col("t")).alias("e")).collect()}
    assert len(got[1].dense) == 64 and abs(sum(x * x for x in got[1].dense) - 1) < 1e-5 and got[2].sparse == got[3].sparse == {}
    scores = df.select(models.rerank_score(F.lit("泵站"), F.col("t")).alias("s")).collect()
    assert [r.s for r in scores] == [1.0, 0.0, 0.0]


def test_audit_outcomes(spark):
    rows = [(1, "1", "c1", "intent", None), (2, "2", "c1", "result", True), (2, "2", "c1", "result", True), (3, "3", "c2", "intent", None), (4, "4", "c2", "denied", None), (5, "5", "c3", "intent", None), (6, "6", "c4", "result", False), (7, "7", None, "intent", None)]
    log = spark.createDataFrame(rows, "rec_no long, ts string, call_id string, phase string, ok boolean").select("*", F.lit("t").alias("tool"), F.lit("a").alias("actor"), F.lit("x").alias("arg"), F.lit(None).cast("string").alias("detail"))
    assert {r.call_id: r.outcome for r in audit.outcomes(log).collect()} == {"c1": "done", "c2": "denied", "c3": "open", "c4": "orphan"}
    assert [r.rec_no for r in audit.tail(log, 2).collect()] == [7, 6] and audit.repeated_calls(log).count() == 3


def test_files_and_encodings(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a_v1.md").write_text("﻿# 标题\n正文。", "utf-8")
    (tmp_path / "sub" / "b.txt").write_bytes("规程内容若干".encode("gb18030"))
    (tmp_path / "e.txt").write_bytes(b" \n")
    (tmp_path / "zero.log").write_bytes(b"")
    for skipped in (".hidden.md", "~$lock.md", "d.csv"):
        (tmp_path / skipped).write_text("x")
    got = {r.source.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a_v1.md", "b.txt", "e.txt", "d.csv", "zero.log"}
    assert (got["d.csv"].error, got["d.csv"].text) == ("unsupported suffix .csv", None) and (got["zero.log"].error, got["zero.log"].text, got["zero.log"].encoding) == ("no text", "", "utf-8")
    assert (got["a_v1.md"].title, got["a_v1.md"].doc_version, got["b.txt"].encoding, got["e.txt"].error) == ("标题", "v1", "gb18030", "no text")
    assert files.decode(b"\xff\xfe\xfa\x80\xff")[1] in ("latin-1", "big5", "gb18030")


def test_question_sets(spark, tmp_path):
    lines = ["# meta: {}", "", '{"id": "q1", "question": "?", "type": "single", "status": "keep", "expected": [{"file": "a", "chunk_index": 1, "grade": 9}]}', '{"id": "q1", "question": "?", "status": "keep"}', "{bad"]
    (tmp_path / "qa.jsonl").write_text("\n".join(lines))
    items = files.read_questions(spark, str(tmp_path / "qa.jsonl"))
    assert [r.error for r in items.orderBy("value").collect()].count("not JSON") == 1
    problems = {tuple(r) for r in files.question_problems(items.where("error IS NULL")).collect()}
    assert ("q1", "repeated id") in problems and ("q1", "grade out of range") in problems and ("q1", "bad path") not in problems
    (tmp_path / "meta.jsonl").write_text('# meta: {"schema_version": 2, "corpus": "x"}\n# other\n' + lines[2].replace('"file": "a"', '"file": "/a"'))
    assert [r.meta for r in files.read_question_meta(spark, str(tmp_path / "meta.jsonl")).collect()] == [{"schema_version": "2", "corpus": "x"}]
    assert ("q1", "bad path") in {tuple(r) for r in files.question_problems(files.read_questions(spark, str(tmp_path / "meta.jsonl"))).collect()}


def test_stream_of_documents_replaces_by_document(spark, tmp_path):
    schema = "doc_id string, doc_row long, text string, loaded_at timestamp"
    source = str(tmp_path / "in")
    table = str(tmp_path / "table")
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    spark.createDataFrame([("a", 1, "一。" * 600, None), ("b", 2, "二。", None)], schema).write.mode("append").parquet(source)
    assert ingest.current(spark, table) is None
    ingest.ingest_stream(stream(), table, 4).awaitTermination()
    assert ingest.current(spark, table).groupBy("doc_id").count().count() == 2
    ingest.ingest_stream(stream(), table, 4).awaitTermination()
    assert ingest.current(spark, table).groupBy("doc_id").count().count() == 2
    spark.createDataFrame([("a", 3, "新。", None)], schema).write.mode("append").parquet(source)
    ingest.ingest_stream(stream(), table, 4).awaitTermination()
    got = lambda: {(r.doc_id, r.text) for r in ingest.current(spark, table).select("doc_id", "text").collect()}
    assert got() == {("a", "新。"), ("b", "二。")} and ingest.current(spark, table, 0).where("doc_id = 'a'").count() > 1
    # A document that becomes blank loses its chunks, and only the part of the table that it lies in is written.
    spark.createDataFrame([("a", 4, " \n", None)], schema).write.mode("append").parquet(source)
    ingest.ingest_stream(stream(), table, 4).awaitTermination()
    assert got() == {("b", "二。")}
    assert spark.read.parquet(f"{table}/manifest/batch=2").count() == 1


def test_stream_pairs_calls(spark, tmp_path):
    rows = [("c1", "intent", "2024-01-01T00:00:00+00:00", None), ("c1", "result", "2024-01-01T00:00:05+00:00", True), ("c1", "result", "2024-01-01T00:00:05+00:00", True), ("c2", "intent", "2024-01-01T01:00:00+00:00", None), ("c3", "result", "bad", True)]
    log = spark.createDataFrame(rows, "call_id string, phase string, ts string, ok boolean").withColumn("tool", F.lit("t"))
    log.write.parquet(str(tmp_path / "log"))
    got = pairing.drain(pairing.paired_calls(pairing.log_stream(spark, str(tmp_path / "log"), log.schema))).collect()
    assert {tuple(r) for r in got} == {("c1", "t", 5, "done")}


def test_stream_gives_open_and_denied_calls(spark, tmp_path):
    at = lambda h, s: f"2024-01-01T{h:02}:00:{s:02}+00:00"
    rows = [("c1", "intent", at(0, 0), None), ("c2", "intent", at(0, 1), None), ("c2", "denied", at(0, 2), None), ("c3", "intent", at(1, 0), None), ("c3", "result", at(1, 9), False), ("late", "intent", at(9, 0), None)]
    log = spark.createDataFrame(rows, "call_id string, phase string, ts string, ok boolean").withColumn("tool", F.lit("t"))
    log.write.parquet(str(tmp_path / "log"))
    stream = pairing.log_stream(spark, str(tmp_path / "log"), log.schema)
    got = {(r.call_id, r.seconds, r.outcome) for r in pairing.drain(pairing.paired_calls(stream, "10 minutes", "30 minutes")).collect()}
    assert got == {("c1", None, "open"), ("c2", 1, "denied"), ("c3", 9, "failed")}  # the last intent may still get a result


def test_changed_docs_keeps_every_first_load(spark, tmp_path):
    rows = [(10, "a", "old", 1), (11, "a", "new", 2), (20, "b", "same", 1), (21, "b", "same", 3), (30, "c", "once", 1), (13, "d", "x", 1), (14, "d", "y", 2)]
    spark.createDataFrame(rows, "doc_row long, doc_id string, text string, loaded_at long").write.parquet(f"{tmp_path}/kb_docs.parquet")
    got = {r.doc_id: r.state for r in collection.changed_docs(spark, str(tmp_path)).collect()}
    assert got == {"a": "changed", "b": "unchanged", "c": "unchanged", "d": "changed"}


def test_set_payload_merges(spark):
    from corpuscle.operators import store

    chunks = spark.createDataFrame([("a", 0, "s", "t"), ("a", 1, None, "t"), ("b", 0, "s", None)], "doc_id string, chunk_index int, section string, title string")
    changes = spark.createDataFrame([("a", None, "new", None), ("a", 1, None, "own"), ("gone", 0, "x", "x"), ("a", None, "new", None)], "doc_id string, chunk_index int, section string, title string")
    got = {(r.doc_id, r.chunk_index): (r.section, r.title, r.n_set) for r in store.set_payload(chunks, changes, ["section", "title"]).collect()}
    assert got == {("a", 0): ("new", "t", 1), ("a", 1): ("new", "own", 2), ("b", 0): ("s", None, 0)}
