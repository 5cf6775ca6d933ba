"""What models write, in the spellings they use: hand-made replies and what must be read from them."""

from pyspark.sql import functions as F

from corpuscle.operators import parsing

STEPS = [
    # reply, (thought, action, argument, final)
    ("思考：先查规程\n动作：search\n动作输入：锅炉 检修", ("先查规程", "search", "锅炉 检修", None)),
    ("推理: a\n工具: read_chunk extra\n工具输入: 「甲」", ("a", "read_chunk", "甲", None)),
    ("Thought: one\ntwo\nAction: search\nAction Input: first line\nsecond line\n\nmore prose", ("one two", "search", "first line second line", None)),
    ("Action: search\nAction_Input: x\nObservation: made up\nThought: on", ("on", "search", "x", None)),
    ("> **Action**: `search`\n> **Action Input**: \"\"quoted\"\"", (None, "search", '"quoted"', None)),
    ("Action: search\nAction Input: “a” and “b”", (None, "search", "a” and “b", None)),
    ("Action: search", (None, None, None, None)),
    ("Action Input: x", (None, None, None, None)),
    ("Action Input: before\nAction: search", (None, None, None, None)),
    ("Thought: done\n最终答案：一\n\n二", ("done", None, None, "一\n\n二")),
    ("**Final Answer**: ok", (None, None, None, "ok")),
    ("答案：不算", (None, None, None, None)),
    ("Thought: 最终答案是什么", ("最终答案是什么", None, None, None)),
    ("action：s\r\naction input：y\r\n", (None, "s", "y", None)),
    ("Thought: " + "长" * 400 + "\nFinal Answer: ", ("长" * 300, None, None, "")),
    ("", (None, None, None, None)),
    (None, (None, None, None, None)),
]


def test_agent_steps(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(STEPS)], "id int, t string")
    got = {r.id: tuple(r.s) for r in df.select("id", parsing.agent_step(F.col("t")).alias("s")).collect()}
    for i, (text, want) in enumerate(STEPS):
        assert got[i] == want, text


TRIPLES = [
    ('{"triplets": [["甲", "位于", "乙"]]}', [("甲", "位于", "乙")]),
    ('x {"三元组": [{"头实体": "a", "关系": "r", "尾实体": "b"}]} y', [("a", "r", "b")]),
    ('[{"subject": "s", "predicate": "p", "object": 3}, {"subject": "s"}, 7, "z"]', [("s", "p", "3")]),
    ('[{"实体1": "a", "关系": "r", "实体2": " b "}, ["1", "2", "3"], ["1", "2"]]', [("a", "r", "b"), ("1", "2", "3")]),
    ('{"other": [["a", "b", "c"]]}', []),
    ("（110kV、甲线，连接，乙站）\n(a, b, c, d)\n1. (\"x\", 'r', y) (p, q, r)\nnone", [("110kV、甲线", "连接", "乙站"), ("a", "b, c", "d"), ("x", "r", "y")]),
    ("(a, , c)\n(" + "长" * 50 + ", b, c)\n(a、b、c)\n)(", []),
    ('[["", "r", "b"]]\n(a, b, c)', []),
    (None, []),
    ("", []),
]


def test_triples_in_every_spelling(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TRIPLES)], "id int, reply string").withColumns({"head": F.lit("clash"), "j": F.lit(1)})
    got = {}
    for r in parsing.parsed_triples(df, "id", "reply").collect():
        got.setdefault(r.id, []).append((r["head"], r.relation, r.tail))
    for i, (text, want) in enumerate(TRIPLES):
        assert sorted(got.get(i, [])) == sorted(want), text


def test_citations_are_resolved_from_exact_to_loose(spark):
    docs = spark.createDataFrame(
        [("d1", "《绝缘子 检测》作业指导书", "/kb/a/v1.md"), ("d2", "绝缘子检测作业指导书 v2", "/kb/a/v2.md"), ("d3", None, "/kb/b/巡视办法（试行）.md"), ("d4", "规程", "/kb/c/x.md")], "doc_id string, title string, source string"
    )
    names = ["绝缘子检测作业指导书", "绝缘子检测作业指导书　V2", "/KB/A/v1.md", "v2.md", "巡视办法（试行）", "规程", "安全规程汇编", "规", "办法", "无此文件", "检测作业指导书"]
    cited = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.doc_id for r in parsing.resolve_citations(cited, docs).collect()}
    assert got == dict(zip(names, ["d1", "d2", "d1", "d2", "d3", "d4", "d4", None, None, None, "d1"], strict=True))
