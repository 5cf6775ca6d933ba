"""Encoding a corpus with a public byte-level BPE vocabulary through its distinct words.

Documents are split into pre-tokens in place.  Each *block* (some megabytes of text in one
task) numbers its distinct pre-tokens and keeps, for every document, the positions as a
list of those numbers; only (block, number, word) rows travel.  All blocks' words meet in
one shuffle, sorted, so each distinct word of the corpus is encoded once and every row gets its ids
on the spot; they go back to their blocks, which reassemble their documents by position.  A word that stands millions of
times in the corpus thus crosses the network once a block, not once an occurrence.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import shared_table

#: Where the vocabulary files of the public tokenizers lie on every machine.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of text in a block; a longer document is a block of its own.
BLOCK_CHARS = 5_000_000

_SPLIT = "block long, doc long, codes binary, code int, word string"


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


class _Numbers(dict):
    """Numbers words in the order of their first occurrence."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _pack(numbers: list[int]) -> bytes:
    """Numbers as bytes: first the lower halves of all, then the upper halves, most of them zero."""
    return np.asarray(numbers, "<u4").view("<u2").reshape(-1, 2).T.tobytes()


def _split_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex
    from pyspark import TaskContext

    find = regex.compile(PATTERN).findall
    block = TaskContext.get().partitionId() << 32
    schema = pa.schema([("block", pa.int64()), ("doc", pa.int64()), ("codes", pa.binary()), ("code", pa.int32()), ("word", pa.string())])
    numbers, docs, codes, chars = _Numbers(), [], [], 0

    def emit() -> Iterator[pa.RecordBatch]:
        n = len(docs)
        yield pa.record_batch([pa.array(np.full(n, block)), pa.array(docs, pa.int64()), pa.array(codes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], schema=schema)
        m = len(numbers)
        yield pa.record_batch([pa.array(np.full(m, block)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(np.arange(m, dtype=np.int32)), pa.array(list(numbers), pa.string())], schema=schema)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            docs.append(doc)
            codes.append(_pack(list(map(numbers.__getitem__, find(text)))))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield from emit()
                numbers, docs, codes, chars = _Numbers(), [], [], 0
                block += 1
    if docs:
        yield from emit()


def split_words(df: DataFrame, doc: str, text: str) -> DataFrame:
    """Blocks of documents: rows (block, doc, codes) and rows (block, code, word), written once."""
    return shared_table(df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(_split_blocks, _SPLIT))


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """(at, code, ids) of the words (block, code, word) of all blocks; ids are packed as 16 or 32 bits each.

    Equal words of all blocks meet, one after another, in one task, where a word is encoded once for all of its rows,
    so its ids need not be joined back.  A word has at most one row for each block, and tasks stream over their rows.
    """
    width = id_width(vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        last, ids = None, b""
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(2).dictionary_encode()
            distinct = own.dictionary.to_pylist()
            found = [ids if word == last else np.asarray(encoding.encode_ordinary(word), width).tobytes() for word in distinct]
            last, ids = distinct[-1], found[-1]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary()).take(own.indices)], names=["at", "code", "ids"])

    return words.select("block", "code", "word").repartition("word").sortWithinPartitions("word").mapInArrow(encode, "at long, code int, ids binary")


def id_width(vocabulary: str) -> str:
    """The integer type that holds every id of a vocabulary."""
    return "<u2" if max(_ranks(vocabulary).values()) < 1 << 16 else "<u4"


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (in items) and items of a column of packed integers."""
    values = column.to_pylist()
    size = np.dtype(kind).itemsize
    return np.concatenate([[0], np.cumsum([len(v) // size for v in values])]).astype(np.int64), np.frombuffer(b"".join(values), kind)


def _codes(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the documents and their word numbers, one after another."""
    bounds, halves = _flat(docs.column("codes"), "<u2")
    bounds = bounds // 2
    size = np.diff(bounds)
    low = np.arange(bounds[-1]) + np.repeat(bounds[:-1], size)
    return bounds, halves[low].astype(np.int64) | (halves[low + np.repeat(size, size)].astype(np.int64) << 16)


def _reassemble(width: str):
    """Ids of the documents of one block, from the ids of its words and the documents' positions."""

    def reassemble(words: pa.Table, docs: pa.Table) -> pa.Table:
        order = np.argsort(words.column("code").to_numpy())
        starts, ids = _flat(words.column("ids"), width)
        lengths, starts = np.diff(starts)[order], starts[:-1][order]
        bounds, codes = _codes(docs)
        size = lengths[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(starts[codes] - ends[:-1], size) + np.arange(ends[-1])
        lists = pa.ListArray.from_arrays(pa.array(ends[bounds].astype(np.int32)), pa.array(ids[take].astype(np.int32)))
        return pa.table({"doc": docs.column("doc").combine_chunks(), "ids": lists})

    return reassemble


def _count(words: pa.Table, docs: pa.Table) -> pa.Table:
    lengths = np.zeros(words.num_rows, np.int64)
    lengths[words.column("code").to_numpy()] = words.column("n").to_numpy()
    bounds, codes = _codes(docs)
    ends = np.concatenate([[0], np.cumsum(lengths[codes])])
    return pa.table({"doc": docs.column("doc").combine_chunks(), "n_tokens": np.diff(ends[bounds])})


def encode_corpus(df: DataFrame, doc: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, ids): token ids of every row's whole text, without special tokens.

    Null and empty texts have an empty list.  Every row is kept, also with a null or
    repeated id; an empty table gives an empty result.
    """
    split = split_words(df, doc, text)
    words = split.select("block", "code", "word").where("word IS NOT NULL")
    back = encode_words(words, f"{tokenizers}/{vocabulary}")
    docs = split.select("block", "doc", "codes").where("codes IS NOT NULL")
    found = back.groupBy("at").cogroup(docs.groupBy("block")).applyInArrow(_reassemble(id_width(f"{tokenizers}/{vocabulary}")), "doc long, ids array<int>")
    return found.withColumnRenamed("doc", doc)


def token_counts(df: DataFrame, doc: str, text: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, n_tokens) by the same way; only the number of a word's ids travels back."""
    split = split_words(df, doc, text)
    words = split.select("block", "code", "word").where("word IS NOT NULL")
    path = f"{tokenizers}/{vocabulary}"
    size = np.dtype(id_width(path)).itemsize
    back = encode_words(words, path).select("at", "code", F.expr(f"length(ids) div {size}").alias("n"))
    docs = split.select("block", "doc", "codes").where("codes IS NOT NULL")
    return back.groupBy("at").cogroup(docs.groupBy("block")).applyInArrow(_count, "doc long, n_tokens long").withColumnRenamed("doc", doc)


@lru_cache(maxsize=2)
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table of a vocabulary: where each id's bytes start, how many it has (-1: no such id), and all bytes; its size is fixed (some 50,000 tokens)."""
    ranks = _ranks(path)
    size = np.full(max(ranks.values()) + 1, -1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    known = np.maximum(size, 0)
    return np.cumsum(known) - known, size, np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)


def _decode_part(path: str):
    """Task function over (doc, ids): joins the ids with the token-byte table where they lie, and puts each row's bytes together."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, sizes, data = _token_table(path)
        for batch in batches:
            lists = batch.column(1)
            ids = lists.flatten().drop_null().to_numpy().astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum([0 if x is None else x - n for x, n in zip(lists.value_lengths().to_pylist(), _nulls(lists), strict=True)])]).astype(np.int64)
            wrong = ids[(ids < 0) | (ids >= len(sizes))]
            wrong = wrong if len(wrong) else ids[sizes[ids] < 0]
            if len(wrong):
                raise ValueError(f"no token has the id {wrong[0]}")
            size = sizes[ids]
            ends = np.concatenate([[0], np.cumsum(size)])
            whole = data[np.repeat(starts[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
            at = ends[bounds].tolist()
            texts = [whole[start:end].decode("utf-8", "replace") for start, end in zip(at, at[1:], strict=False)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc", "text"])

    return decode


def _nulls(lists: pa.Array) -> list[int]:
    """How many null ids each list has."""
    if not lists.flatten().null_count:
        return [0] * len(lists)
    return [0 if x is None else x.count(None) for x in lists.to_pylist()]


def decode_corpus(encoded: DataFrame, doc: str, ids: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, text): the texts that token ids stand for, by a join with the token-byte table, which every task has (its size is fixed), so nothing is shuffled.

    A null or empty list gives ``""``, null ids in a list are left out; an id that the vocabulary does not have raises an error.  Every row
    is kept, also with a null or repeated doc.
    """
    rows = encoded.select(F.col(doc).cast("long").alias("doc"), F.col(ids).cast("array<long>").alias("ids"))
    return rows.mapInArrow(_decode_part(f"{tokenizers}/{vocabulary}"), "doc long, text string").withColumnRenamed("doc", doc)
