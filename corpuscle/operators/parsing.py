"""Reading what models write: agent steps, triples, citations and JSON, as plans over whole columns."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 128


# The labels of an agent's step in either language, what may stand around them, where an input ends, and pairs of quotes.
_LABELS = {
    "thought": "thought|思考|推理", "action": "action|动作|工具", "input": r"action[ \t_]*input|动作输入|工具输入|输入",
    "final": r"final[ \t]*answer|最终答案|最终回答|最终作答",
}
_BEFORE, _AROUND = r"^[ \t>*#`]*", r"[ \t*`]*"
_INPUT_ENDS = r"\n\n|\nObservation[:：]|\nThought:|\n思考:|\nAction:|\nFinal Answer:"
_QUOTES = ('""', "''", "``", "“”", "‘’", "「」", "『』", "《》")
_THOUGHT_CHARS = 300


def _labelled(name: str, rest: str, flags: str = "im") -> str:
    return rf"(?{flags}){_BEFORE}(?:{_LABELS[name]}){_AROUND}[:：]{_AROUND}{rest}"


def _one_line(text: Column) -> Column:
    """Without outer blanks, inner ones (line feeds too) as one blank each."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def unquoted(text: Column) -> Column:
    """Without one pair of enclosing quotes; quotes that are no pair stay."""
    out = F.trim(text)
    inner = F.trim(F.substring(out, F.lit(2), F.length(out) - 2))
    paired = F.lit(False)
    for pair in _QUOTES:
        paired = paired | (F.startswith(out, F.lit(pair[0])) & F.endswith(out, F.lit(pair[1])))
    return F.when((F.length(out) >= 2) & paired, inner).otherwise(out)


def agent_step(text: Column) -> Column:
    """struct(thought, action, argument, final) of a reply; labels in English or Chinese, any case, with markup around them, either colon.

    An action counts only with an input behind it; both are null otherwise. The input may go over several lines, which are joined by
    blanks, up to an empty line or the next label; one pair of quotes around it is taken off.  The thought ends
    at the next label of an action or answer, and has at most 300 characters.  Everything behind the first
    label of a final answer is the answer.  Parts that are not there are null.
    """
    text = F.regexp_replace(text, "\r\n?", "\n")
    part = lambda pattern: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))
    ends = "|".join(_LABELS[n] for n in ("action", "final"))
    thought = part(_labelled("thought", rf"(.*?)(?={_BEFORE}(?:{ends}){_AROUND}[:：]|\z)", "ims"))
    # The action's line and what follows it, in which its input is looked for.
    name_line = part(_labelled("action", r"(\S[^\n]*)"))
    behind = part(_labelled("action", r"\S[^\n]*((?s:.*))"))
    pattern = _labelled("input", "(.*)", "ims")
    given = F.when(behind.rlike(pattern), F.regexp_extract(behind, pattern, 1))
    cut = F.regexp_replace(given, rf"(?s)(?:{_INPUT_ENDS}).*$", "")
    argument = _one_line(F.regexp_replace(unquoted(F.regexp_replace(cut, r"^\s+|\s+$", "")), "^`+|`+$", ""))
    action = F.nullif(F.regexp_extract(F.regexp_replace(name_line, "^[\\s`'\"*]+|[\\s`'\"*]+$", ""), r"^(\S*)", 1), F.lit(""))
    called = action.isNotNull() & argument.isNotNull()
    final = F.regexp_replace(part(_labelled("final", "(.*)", "ims")), r"^\s+|\s+$", "")
    return F.struct(
        F.nullif(F.substring(_one_line(thought), 1, _THOUGHT_CHARS), F.lit("")).alias("thought"), F.when(called, action).alias("action"),
        F.when(called, argument).alias("argument"), final.alias("final"),
    )


def citations(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, name, chunk_index) of ``[name (块 n)]`` marks with either family of brackets; names of up to 140 characters."""
    marks = F.regexp_extract_all(F.col(text), F.lit(r"[\[【][^\[\]【】\n]{1,140}?\s*[(（]\s*块\s*\d+\s*[)）]\s*[\]】]"), 0)
    found = df.select(F.col(row), F.explode(marks).alias("mark"))
    pattern = r"^[\[【]\s*(.*?)\s*[(（]\s*块\s*(\d+)\s*[)）]"
    return found.select(row, F.regexp_extract("mark", pattern, 1).alias("name"), F.regexp_extract("mark", pattern, 2).cast("long").alias("chunk_index"))


#: Shortest name that may be found inside another, and the key that such names meet by.
CONTAINED = 4


def plain_name(name: Column) -> Column:
    """A cited name without blanks, title marks and quotes, in lower case."""
    return F.lower(F.regexp_replace(name, "[\\s　《》「」\"']+", ""))


def resolve_citations(cited: DataFrame, documents: DataFrame) -> DataFrame:
    """``cited`` (with name) and ``doc_id``: by equal title, then source, then file name, then by containment; the smallest doc_id of the best kind.

    Documents have doc_id, title and source.  Names are compared as ``plain_name``.  Containment counts for names of four characters or
    more: in a title or source, or a title in the name; such pairs meet by the first characters of the contained one, never all with all.
    A name that nothing bears has a null doc_id.
    """
    base = F.regexp_extract("source", r"([^/\\]*)$", 1)
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), plain_name(c).alias("plain"))
    named = documents.select("doc_id", F.inline(F.array(kind(1, F.col("title")), kind(2, F.col("source")), kind(3, base)))).where("plain <> ''")
    best = named.groupBy("plain").agg(F.min(F.struct("kind", "doc_id")).alias("best")).select("plain", F.col("best.doc_id").alias("doc_id"))
    asked = cited.select("name").distinct().select("name", plain_name(F.col("name")).alias("plain"))
    equal = asked.join(best, "plain", "left")
    open_names = equal.where("doc_id IS NULL").where(F.length("plain") >= CONTAINED).select("name", "plain")
    holders = named.where("kind < 3").select("doc_id", "kind", F.col("plain").alias("holder")).distinct()
    windows = lambda c, n: F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    # The name inside a title or source: both have the name's first characters.
    inside = holders.where(F.length("holder") >= CONTAINED).withColumn("key", F.explode(F.array_distinct(windows(F.col("holder"), CONTAINED))))
    first = inside.join(open_names.withColumn("key", F.substring("plain", 1, CONTAINED)), "key").where(F.contains("holder", "plain"))
    # A title inside the name.
    sizes = [open_names.where(F.length("plain") >= n).select("name", "plain", F.explode(F.array_distinct(windows(F.col("plain"), n))).alias("key")) for n in range(1, CONTAINED + 1)]
    parts = reduce(DataFrame.unionByName, sizes)
    titles = holders.where("kind = 1").withColumn("key", F.substring("holder", 1, CONTAINED))
    second = parts.join(titles, "key").where(F.contains("plain", "holder"))
    loose = first.select("name", "doc_id").unionByName(second.select("name", "doc_id")).groupBy("name").agg(F.min("doc_id").alias("loose"))
    found = equal.join(loose, "name", "left").select("name", F.coalesce("doc_id", "loose").alias("doc_id"))
    return cited.join(found, "name", "left")


def _clean_triples(parts: DataFrame, row: str) -> DataFrame:
    """Trimmed triples; one with an empty part or a part of over 128 UTF-8 bytes is left out."""
    plain = parts.select(row, *(F.regexp_replace(n, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "").alias(n) for n in ("head", "relation", "tail")))
    good = lambda c: F.coalesce((F.length(c) > 0) & (F.octet_length(c) <= MOST_BYTES), F.lit(False))
    return plain.where(good("head") & good("relation") & good("tail"))


def triples(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, head, relation, tail) of lines with ``(a, b, c)`` in ASCII or full-width brackets, cut at the first and the last comma.

    A line's first bracket counts, commas are ``,`` and ``，`` (the enumeration mark belongs to names), quotes around
    parts are taken off; see `_clean_triples` for what is left out.
    """
    lines = df.select(F.col(row), F.explode(F.split(F.col(text), "\r\n?|\n")).alias("line"))
    inside = F.regexp_extract("line", r"^[^(（]*(?:\(([^)]*)\)|（([^）]*)）)", 0)
    found = lines.select(row, F.regexp_extract(inside, r"^[^(（]*[(（](.*)[)）]$", 1).alias("g")).where(F.col("g").rlike("[,，].*[,，]"))
    pattern = r"^([^,，]*)[,，](.*)[,，]([^,，]*)$"
    bare = lambda c: F.regexp_replace(c, "^[\\s\\p{Z}]*[\"']*|[\"']*[\\s\\p{Z}]*$", "")
    return _clean_triples(found.select(row, *(bare(F.regexp_extract("g", pattern, i)).alias(n) for i, n in ((1, "head"), (2, "relation"), (3, "tail")))), row)


def first_json(text: str | None) -> str | None:
    """The first JSON object or array inside a reply, in compact form; null if there is none."""
    decoder, at = json.JSONDecoder(), 0
    while text and (starts := [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]):
        at = min(starts)
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            at += 1
    return None


def extract_json(text: Column) -> Column:
    """``first_json`` of a column, in Arrow batches."""

    def parse(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(first_json, na_action="ignore")

    return F.pandas_udf(parse, "string")(text)


# Keys that a list of triples may stand under, and keys of the parts of a triple, in the order in which they are tried.
_WRAPPERS = ("triplets", "triples", "结果", "三元组")
_KEYS = (("头实体", "关系", "尾实体"), ("subject", "predicate", "object"), ("实体1", "关系", "实体2"), ("head", "relation", "tail"))


def json_triples(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, head, relation, tail) of the first JSON in a reply: a list, also under one of a few keys, of lists of three or of objects.

    Objects have their parts under one of the known sets of keys.  Numbers count as their text; the cleaning
    is that of ``triples``; anything else gives no rows.
    """
    found = df.select(F.col(row), extract_json(F.col(text)).alias("j"))
    wrapped = F.from_json("j", "map<string,string>")
    inner = F.coalesce(*(F.when(F.try_element_at(wrapped, F.lit(k)).startswith("["), F.try_element_at(wrapped, F.lit(k))) for k in _WRAPPERS))
    whole = F.when(F.col("j").startswith("["), F.col("j")).otherwise(inner)
    items = found.select(row, F.explode(F.from_json(whole, "array<string>")).alias("item"))
    listed, named = F.from_json("item", "array<string>"), F.from_json("item", "map<string,string>")
    of_list = F.when(F.col("item").startswith("[") & (F.size(listed) == 3), listed)
    of_keys = (F.when(F.forall(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key("named", k)), F.array(*(F.element_at("named", F.lit(k)) for k in keys))) for keys in _KEYS)
    parts = items.withColumn("named", F.when(F.col("item").startswith("{"), named)).select(row, F.coalesce(of_list, *of_keys).alias("p")).where("p IS NOT NULL")
    return _clean_triples(parts.select(row, *(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(("head", "relation", "tail")))), row)


def parsed_triples(df: DataFrame, row: str, text: str) -> DataFrame:
    """(row, head, relation, tail) of replies: from their JSON if they have a list of triples there, else from their lines."""
    read = df.select(F.col(row), F.col(text).alias("reply"), extract_json(F.col(text)).alias("j"))
    wrapped = F.from_json("j", "map<string,string>")
    listed = F.coalesce(F.col("j").startswith("["), F.lit(False))
    for key in _WRAPPERS:
        listed = listed | F.coalesce(F.try_element_at(wrapped, F.lit(key)).startswith("["), F.lit(False))
    marked = read.withColumn("listed", listed)
    return json_triples(marked.where("listed"), row, "j").unionByName(triples(marked.where("NOT listed"), row, "reply"))
