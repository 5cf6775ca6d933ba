"""Reduced texts: what is left of a text when its formatting is taken away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Full-width forms and their ASCII forms, whitespace and zero-width characters.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_SPACES = r"\s\x1c-\x1f\x85\p{Z}"
BLANKS = _SPACES + r"\u200b-\u200d\ufeff"
# The mark is looked at before its neighbours, which most characters spare.
_MARKS = r"\p{P}(?:(?![0-9])|(?<![0-9].))"
_ITEM = r"^[^：:]{1,12}[：:][^：:]+$"
# What every list of items begins with; most texts fail here and are never split.
_FIRST_ITEM = rf"^[{_SPACES}；;]*[^：:；;\n]{{1,12}}[：:][^：:；;\n]"


def reduce_plain(text: Column) -> Column:
    """Full width to ASCII, lower case, without blanks and without marks (but for those directly between two ASCII digits)."""
    folded = F.lower(F.translate(text, _WIDE, _ASCII))
    return F.regexp_replace(F.regexp_replace(folded, f"[{BLANKS}]+", ""), _MARKS, "")


def reduced_text(text: Column) -> Column:
    """The reduced text; lists of three or more ``name：value`` items do not depend on their order.

    Items are what stands between ``；``, ``;`` and line feeds, without outer whitespace;
    blank items are ignored (one of zero-width characters is not blank, and so no list).  Null gives null, a text of blanks and marks alone ``""``.
    """
    trimmed = F.transform(F.split(text, "[；;\n]"), lambda x: F.regexp_replace(x, f"^[{_SPACES}]+|[{_SPACES}]+$", ""))
    items = F.filter(trimmed, lambda x: x != "")
    fields = text.rlike(_FIRST_ITEM) & (F.size(items) >= 3) & F.forall(items, lambda x: x.rlike(_ITEM))
    return F.when(fields, F.concat_ws("", F.array_sort(F.transform(items, reduce_plain)))).otherwise(reduce_plain(text))
