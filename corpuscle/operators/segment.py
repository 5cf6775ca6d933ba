"""Cutting documents into anchored chunks: whole sentences up to a size, with an overlap carried on."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import HEADING, HEADING_CHARS, SENTENCE, truncate_middle

_SPAN, _HEAD = re.compile(SENTENCE), re.compile(HEADING)
_SOFT = "，,、）) 　"  # fixed value: marks at which an oversized sentence may be cut
SIZE, OVERLAP = 512, 64


def _hard_cuts(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """Windows of ``size``, drawn back to the last soft mark in their second half."""
    while end - start > size:
        cut = max((text.rfind(mark, start + size // 2, start + size) for mark in _SOFT), default=-1) + 1
        cut = cut if cut > start + size // 2 else start + size
        yield start, cut
        start = cut
    yield start, end


def chunk_spans(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, section) of the chunks of a text.

    Sentences are gathered while their lengths sum up to ``size``; the next chunk starts with the
    last sentences of up to ``overlap`` characters. A heading starts a new chunk without overlap, an
    oversized sentence is cut by itself. A chunk's section is the last heading at its first sentence.
    As a chunk also holds the blanks between its sentences, it may exceed ``size`` by these and the overlap.
    """
    size = max(64, size)
    overlap = min(max(0, overlap), size // 2)
    out: list[tuple[int, int, str]] = []
    held: list[tuple[int, int, str]] = []
    section = ""

    def flush(start: int, end: int, name: str) -> None:
        body = text[start:end]
        if body.strip():
            out.append((start + len(body) - len(body.lstrip()), end - len(body) + len(body.rstrip()), name))

    fresh = 0  # sentences held that no chunk has yet
    for m in _SPAN.finditer(text):
        start, end = m.span()
        if not m.group().strip():
            continue
        line = m.group().strip()
        heading = len(line) <= HEADING_CHARS and _HEAD.match(line) is not None
        section = line if heading else section
        long = end - start > size
        if held and (long or heading or sum(e - s for s, e, _ in held) + end - start > size):
            if fresh:
                flush(held[0][0], held[-1][1], held[0][2])
            carried: list[tuple[int, int, str]] = []
            if not long and not heading:
                for span in reversed(held):
                    if sum(e - s for s, e, _ in carried) + span[1] - span[0] > overlap:
                        break
                    carried.insert(0, span)
            held, fresh = carried, 0
        if long:
            for a, b in _hard_cuts(text, start, end, size):
                flush(a, b, section)
        else:
            held.append((start, end, section))
            fresh += 1
    if held and fresh:
        flush(held[0][0], held[-1][1], held[0][2])
    return out


def chunk_documents(df: DataFrame, row: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(row, chunk_index, start_pos, end_pos, section, text) of every row's whole text; null and blank texts have no chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (r, k, s, e, name, t[s:e])
                for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for k, (s, e, name) in enumerate(chunk_spans(t or "", size, overlap))
            ]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "chunk_index", "start_pos", "end_pos", "section", "text"])

    texts = df.select(F.col(row).cast("long").alias("row"), F.col(text).alias("text"))
    return texts.mapInArrow(cut, "row long, chunk_index long, start_pos long, end_pos long, section string, text string").withColumnRenamed("row", row)


#: Characters of a document and of a chunk that a model for contexts sees, and of the context that is kept.
DOCUMENT_VIEW, CHUNK_VIEW, CONTEXT_CHARS = 24_000, 4_000, 200


def first_line(document: Column, chunk: Column) -> Column:
    """The default model for contexts: the document's first line. Another one can be any expression or Arrow function of both columns."""
    return F.when(F.length(chunk) > 0, F.substring_index(F.regexp_replace(document, "\r\n?", "\n"), "\n", 1))


def with_context(chunks: DataFrame, documents: DataFrame, model: Callable[[Column, Column], Column] = first_line, enabled: bool = True) -> DataFrame:
    """``chunks`` (doc_id, text, ...) with a ``context`` line from a model that sees the document (doc_id, whole) and the chunk.

    A long document is seen by its head and tail, a long chunk by its head.  Contexts are trimmed and have at most CONTEXT_CHARS
    characters.  Blank chunks, unknown documents and a model that gives nothing have the context ``""``; so has everything if not ``enabled``.
    """
    if not enabled:
        return chunks.withColumn("context", F.lit(""))
    view = truncate_middle(F.col("whole"), DOCUMENT_VIEW, 0.7, "\n…\n")
    both = chunks.join(documents.select("doc_id", view.alias("_whole")), "doc_id", "left")
    made = model(F.col("_whole"), F.substring(F.trim("text"), 1, CHUNK_VIEW))
    plain = F.substring(F.regexp_replace(made, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), 1, CONTEXT_CHARS)
    return both.withColumn("context", F.coalesce(plain, F.lit(""))).drop("_whole")
