"""Document files, question sets and logs as tables."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions.ids import content_hash, path_id
from corpuscle.functions.text import file_name, guess_title, normalize_text, relative_path, version_hint

# Suffixes of text files, and the encodings in the order in which they are tried.
SUFFIXES = (".md", ".markdown", ".txt", ".text", ".log")
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "big5")


def decode(content: bytes | None) -> tuple[str, str]:
    """Text and encoding: the first encoding that reads all bytes, else Latin-1; empty content is ``""`` in UTF-8."""
    for name in ENCODINGS:
        try:
            return (content or b"").decode(name), "utf-8" if not content else name
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1"), "latin-1"


def _decoded(content: Column) -> Column:
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([decode(c) for c in part], columns=["text", "encoding"])

    return F.pandas_udf(read, "text string, encoding string")(content)


def read_documents(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(doc_id, source, title, text, content_hash, char_count, ext, encoding, doc_version, effective_from, effective_to, error).

    All files under ``root`` but hidden ones and ``~$`` lock files. A file that holds no text or is of no
    supported suffix has its reason in ``error`` (and null or "" as text) and stays in the table, so that no file fails the others or gets lost.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    plain_path = F.regexp_replace("path", "^file:/+", "/")
    # Spark plans no read for files without bytes; their names come from its own listing.
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").select(plain_path.alias("source"))
    full = files.select(plain_path.alias("source"), "content")
    every = full.unionByName(listed.join(full.select("source"), "source", "left_anti").withColumn("content", F.lit(b"")))
    name = file_name(F.col("source"))
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    known = ext.isin(*SUFFIXES)
    wanted = every.where(~name.rlike(r"^(~\$|\.)")).select("source", ext.alias("ext"), F.when(known, F.col("content")).alias("content"), known.alias("known"))
    read = wanted.withColumn("d", _decoded(F.col("content")))
    plain = read.select("source", "ext", "known", F.when(F.col("known"), F.col("d.encoding")).alias("encoding"), F.when(F.col("known"), normalize_text(F.col("d.text"))).alias("text"), path_id(F.col("source")).alias("doc_id"))
    hint = version_hint(F.col("source"))
    error = F.when(~F.col("known"), F.concat(F.lit("unsupported suffix "), "ext")).when(F.col("text") == "", "no text")
    return plain.select(
        "doc_id", "source", guess_title(F.col("text"), F.col("source"), F.col("doc_id")).alias("title"), "text", content_hash(F.col("text")).alias("content_hash"),
        F.length("text").alias("char_count"), "ext", "encoding", hint["doc_version"].alias("doc_version"), hint["effective_from"].alias("effective_from"),
        hint["effective_to"].alias("effective_to"), error.alias("error"),
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON-lines question set with their line; blank lines and ``#`` lines are skipped, bad lines have an ``error``."""
    item = "id string, question string, type string, status string, expected array<struct<file: string, chunk_index: int, grade: int, snippet: string>>, _bad string"
    lines = spark.read.text(path).where("trim(value) <> '' AND trim(value) NOT LIKE '#%'")
    read = lines.select("value", F.from_json("value", item, {"columnNameOfCorruptRecord": "_bad"}).alias("i")).select("value", "i.*")
    missing = F.when(F.col("_bad").isNotNull(), "not JSON").when(F.col("id").isNull() | F.col("question").isNull(), "id or question missing")
    return read.withColumn("error", missing).drop("_bad")


def read_question_meta(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta): the ``# meta:`` records of question sets as maps of strings; a set without one has no row, a broken one a null map."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.regexp_extract("value", r"^\s*#\s*meta:\s*(.+)$", 1).alias("m")).where("m <> ''")
    return lines.select("path", F.from_json("m", "map<string,string>").alias("meta"))


def question_problems(items: DataFrame) -> DataFrame:
    """(id, problem) of a question set: repeated ids, gold rows where none belong or none where some do, grades outside 1 to 3, repeated gold, paths that are not relative."""
    gold = F.coalesce("expected", F.array().cast("array<struct<file: string, chunk_index: int, grade: int, snippet: string>>"))
    keys = F.transform(gold, lambda g: F.struct(g["file"], g["chunk_index"]))
    grade = lambda g: F.coalesce(g["grade"], F.lit(1))
    kept, negative = F.col("status") == "keep", F.col("type") == "negative"
    checks = F.array_compact(F.array(
        F.when(kept & negative & (F.size(gold) > 0), "gold on a negative"), F.when(kept & ~negative & (F.size(gold) == 0), "no gold"),
        F.when(F.exists(gold, lambda g: (grade(g) < 1) | (grade(g) > 3)), "grade out of range"), F.when(F.size(F.array_distinct(keys)) < F.size(keys), "repeated gold"),
        F.when(F.exists(gold, lambda g: F.coalesce(g["chunk_index"] < 0, F.lit(True))), "bad chunk index"),
        F.when(F.exists(gold, lambda g: relative_path(g["file"])["error"].isNotNull()), "bad path"),
    ))
    repeated = items.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("problem"))
    return items.select("id", F.explode(checks).alias("problem")).unionByName(repeated)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Audit records of JSON lines; lines that are no record are dropped."""
    schema = "rec_no long, ts string, call_id string, phase string, tool string, arg string, actor string, ok boolean, detail string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
