"""Splitting oversized texts at natural boundaries, by balanced targets.

A text is a row of *stretches* between line breaks and sentence ends.  A section (from one
heading to the next) is cut into the least number of pieces that could hold it: equal-length targets
are placed, and each is snapped to the strongest boundary near it (line break before sentence
end, then the nearest); if a piece would exceed the limit, the section is tried again with
more pieces.  A stretch that is itself over the limit is cut the same way at commas, brackets and
blanks, and between any two characters only where it has none near a target.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions.text import CLOSERS, ENDS, HEADING, HEADING_CHARS

_STRETCH = re.compile(rf"[^\r\n{ENDS}]*[{ENDS}][{ENDS}{CLOSERS}]*|[^\r\n{ENDS}]+")
_SOFT = re.compile(r"[，,、）)|/\s]+")
_HEADING = re.compile(HEADING)

SIZE, OVERLAP = 512, 64
#: Whitespace as Python's ``isspace`` has it.
BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"


def stretches(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, ends_line) of the stretches without outer whitespace; blank ones are left out."""
    found, n = [], len(text)
    for m in _STRETCH.finditer(text):
        start, end = m.span()
        while start < end and text[start].isspace():
            start += 1
        stop = end
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        if start < stop:
            found.append((start, stop, end >= n or text[end] in "\r\n"))
    return found


def _choose(marks: list[int], low: int, high: int, target: float, reach: float, strong) -> int | None:
    """Index of the mark within [low, high] that is strongest within reach of the target, else nearest to it."""
    first, last = bisect_left(marks, low), bisect_right(marks, high)
    if first >= last:
        return None
    near = range(max(first, bisect_left(marks, target - reach)), min(last, bisect_right(marks, target + reach)))
    if near:
        return max(near, key=lambda i: (strong(i), -abs(marks[i] - target)))
    at = bisect_left(marks, target, first, last)
    return min((i for i in (at - 1, at) if first <= i < last), key=lambda i: abs(marks[i] - target))


def _least(starts: list[int], ends: list[int], size: int) -> int:
    """The least number of pieces of at most ``size``: each takes as many stretches as fit."""
    count, i = 0, 0
    while i < len(starts):
        i = max(i + 1, bisect_right(ends, starts[i] + size))
        count += 1
    return count


def _balance(spans: list[tuple[int, int, bool]], size: int) -> list[tuple[int, int]]:
    """Pieces (start, end) of at most ``size`` over stretches of at most ``size``."""
    starts, ends = [s for s, _, _ in spans], [e for _, e, _ in spans]
    whole = ends[-1] - starts[0]
    count = _least(starts, ends, size)
    while count < len(spans):
        pieces, i = [], 0
        for k in range(1, count):
            target, high = starts[0] + whole * k / count, starts[i] + size
            j = _choose(ends, max(ends[i], ends[-1] - (count - k) * size - size // 8), high, target, whole / count / 4, lambda i: spans[i][2])
            if j is None or j >= len(spans) - 1:
                break
            pieces.append((starts[i], ends[j]))
            i = j + 1
        if ends[-1] - starts[i] <= size:
            return [*pieces, (starts[i], ends[-1])]
        count += 1
    return [(s, e) for s, e, _ in spans]


def _break(text: str, start: int, end: int, size: int) -> list[tuple[int, int, str]]:
    """Pieces (start, end, cut) of a stretch over the limit, cut at soft marks near equal targets, else anywhere."""
    count = -(-(end - start) // size)
    soft = [m.end() for m in _SOFT.finditer(text, start, end)]
    pieces, at = [], start
    for k in range(1, count):
        target = start + (end - start) * k / count
        low, high = max(at + 1, end - (count - k) * size), at + size
        i = _choose(soft, low, min(high, end - 1), target, (end - start) / count / 4, lambda i: 0)
        cut, how = (soft[i], "soft") if i is not None else (min(max(round(target), low), high), "hard")
        pieces.append((at, cut, how))
        at = cut
    return [*pieces, (at, end, "end")]


def _sections(text: str, spans: list[tuple[int, int, bool]]) -> Iterator[tuple[str, list[tuple[int, int, bool]]]]:
    """Sections with their heading; the heading is the first stretch of its section."""
    name, own, new_line = "", [], True
    for span in spans:
        start, end, ends_line = span
        if new_line and ends_line and end - start <= HEADING_CHARS and text[end - 1] not in ENDS and _HEADING.match(text, start, end):
            if own:
                yield name, own
            name, own = text[start:end], []
        own.append(span)
        new_line = ends_line
    if own:
        yield name, own


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str, int | None, str]]:
    """(start, end, section, stretch, cut) of the pieces of a text.

    ``stretch`` is the start of the oversized stretch that a piece was cut from; ``cut``
    is how a piece ends: at a line or sentence (``natural``), at a soft mark, or hard.
    Consecutive pieces of a section overlap by at most ``overlap``, from a boundary within that distance
    if there is one, else from a soft mark, else not at all.
    """
    out = []
    for name, spans in _sections(text, stretches(text)):
        pieces: list[tuple[int, int, int | None, str]] = []
        run: list[tuple[int, int, bool]] = []
        for span in [*spans, None]:
            if span and span[1] - span[0] <= size:
                run.append(span)
                continue
            if run:
                pieces += [(s, e, None, "natural") for s, e in _balance(run, size)]
                run = []
            if span:
                pieces += [(s, e, span[0], "natural" if how == "end" else how) for s, e, how in _break(text, span[0], span[1], size)]
        starts = [s for s, _, _ in spans]
        last = None
        for start, end, stretch, cut in pieces:
            begin = start
            if last is not None:
                least = max(last[1] - overlap, end - size, last[0] + 1)
                i = bisect_left(starts, least)
                if i < len(starts) and starts[i] < start:
                    begin = starts[i]
                elif least < start:
                    soft = _SOFT.search(text, least, last[1])
                    begin = soft.end() if soft and soft.end() < last[1] else start
            while end > begin and text[end - 1].isspace():
                end -= 1
            while begin < end and text[begin].isspace():
                begin += 1
            out.append((begin, end, name, stretch, cut))
            last = (begin, end)
    return out


def _split(size: int, overlap: int, with_text: bool):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (start, end, section, stretch, cut) in enumerate(split_text(text or "", size, overlap)):
                    for column, value in zip(columns, (doc, k, start, end, section, stretch, cut, text[start:end] if with_text else None), strict=True):
                        column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_PIECE_NAMES)

    return split


_PIECE_NAMES = ["doc", "piece_no", "start_pos", "end_pos", "section", "stretch_pos", "cut", "text"]
_PIECES = "doc long, piece_no long, start_pos long, end_pos long, section string, stretch_pos long, cut string, text string"


def split_texts(df: DataFrame, doc: str, text: str, size: int = SIZE, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(doc, piece_no, start_pos, end_pos, section, stretch_pos, cut, text): pieces of every row's whole text.

    A text within the limit is one piece for each section; null and blank texts have none.
    Positions are 0-based characters; ``stretch_pos`` marks pieces of a stretch that natural
    boundaries cannot keep under the limit.  Repeated rows are split each for itself.
    """
    texts = df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return texts.mapInArrow(_split(size, overlap, with_text), _PIECES).withColumnRenamed("doc", doc)


def oversized_stretches(pieces: DataFrame, doc: str) -> DataFrame:
    """(doc, start_pos): each stretch that had to be cut inside, once."""
    return pieces.where("stretch_pos IS NOT NULL").select(doc, F.col("stretch_pos").alias("start_pos")).distinct()


def checked_pieces(pieces: DataFrame, texts: DataFrame, doc: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc, n_kept, n_wrong): what holds for the pieces of each row, to be compared with the texts themselves.

    ``n_kept`` is the number of characters other than blanks that the pieces hold, overlaps counted once; ``n_wrong`` that
    of pieces over the size, with a text other than that of their place, with too much overlap, or out of order.
    ``doc`` must be unique; rows without pieces count 0 and 0.
    """
    order = Window.partitionBy(doc).orderBy("piece_no")
    before = F.coalesce(F.lag("end_pos").over(order), F.lit(0))
    same = F.col("text") == F.substring(F.col("whole"), F.col("start_pos").cast("int") + 1, F.length("text"))
    placed = pieces.join(texts.select(doc, F.col(text).alias("whole")), doc).withColumn("before", before)
    good = same & (F.length("text") == F.col("end_pos") - F.col("start_pos")) & (F.length("text") <= size) & (F.col("before") - F.col("start_pos") <= overlap) & (F.col("end_pos") > F.col("before"))
    new = F.substring("text", F.greatest(F.lit(0), F.col("before") - F.col("start_pos")).cast("int") + 1, F.length("text"))
    each = placed.groupBy(doc).agg(F.sum(F.length(F.regexp_replace(new, BLANK, ""))).alias("n_kept"), F.count_if(~good).alias("n_wrong"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return texts.select(doc).join(each, doc, "left").select(doc, zero("n_kept"), zero("n_wrong"))
