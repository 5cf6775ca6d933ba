"""Personal information inside free text: found in a normalised copy, replaced in the source.

A chain of small transducers writes a text in plain signs: full-width and look-alike
characters become ASCII one by one, then ``[at]`` / ``(dot)`` disguises, blanks around ``@``,
spelled digits and zero-width characters are rewritten.  Every step keeps, for each
character of its output, the place in the source that it stands for, so identifiers are
detected in the plain copy and their spans are mapped back to the source characters.

Names of persons have no form of their own.  A first pass of Spark counts, over all texts, how often
each Han character stands in running text and how often in names behind labels
(姓名：, 联系人：), and which Latin words are written small; the second pass weighs every family
name with one or two characters behind it, and every run of capitalised words, by those
counts, by general knowledge (common family and given names, frequent characters) and by what stands left and
right of it.  Both tables have a size bound that does not depend on the data (`NameModel`).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.names import NameModel, chinese_names, english_names, name_model

KINDS = ("email", "identity", "phone", "address", "person")

# Full-width forms, other blanks, dashes and dots, and Cyrillic or Greek letters that look like Latin ones.
_PLAIN = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_PLAIN |= dict.fromkeys((0x00A0, 0x2002, 0x2003, 0x2009, 0x202F, 0x3000), " ")
_PLAIN |= dict.fromkeys((0x2010, 0x2011, 0x2012, 0x2013, 0x2212), "-")
_PLAIN |= {0xFE6B: "@", 0x2024: ".", 0xFE52: "."}
_PLAIN |= dict(zip(map(ord, "АВЕКМНОРСТУХаеорсухіјѕ"), "ABEKMHOPCTYXaeopcyxijs", strict=True))
_PLAIN |= dict(zip(map(ord, "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο"), "ABEZHIKMNOPTYXo", strict=True))

_TABLE = np.arange(0x10000, dtype=np.uint32)
_TABLE[list(_PLAIN)] = [ord(c) for c in _PLAIN.values()]

# Digits as words.
_HAN_DIGITS = str.maketrans("〇零一幺二两三四五六七八九壹贰叁肆伍陆柒捌玖", "0011223456789123456789")
_WORD_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}

_HIDDEN = re.compile("[\u200b-\u200d\ufeff]")
_AT = re.compile(r"(?<=[A-Za-z0-9])(?:\s*[\[({<【]\s*(?:at|AT|At|@|艾特)\s*[\])}>】]\s*| +@ *| *@ +| +at +(?=[A-Za-z0-9-]+ +dot +))(?=[A-Za-z0-9])")
_DOT = re.compile(r"(?<=[A-Za-z0-9])(?:\s*[\[({<【]\s*(?:dot|DOT|Dot|点)\s*[\])}>】]\s*| +dot +)(?=[A-Za-z0-9])")
_HAN_RUN = re.compile("[〇零一幺二两三四五六七八九壹贰叁肆伍陆柒捌玖][〇零一幺二两三四五六七八九壹贰叁肆伍陆柒捌玖 -]{5,}[〇零一幺二两三四五六七八九壹贰叁肆伍陆柒捌玖]")
_AT_HINT = re.compile(r"[\[({<【]\s*(?:at|AT|At|@|艾特)|@ | @| dot ")
_DOT_HINT = re.compile(r"[\[({<【]\s*(?:dot|DOT|Dot|点)\s*[\])}>】]| dot ")
_WORD_HINT = re.compile(r"(?:[Zz]ero|[Oo]h|[Oo]ne|[Tt]wo|[Tt]hree|[Ff]our|[Ff]ive|[Ss]ix|[Ss]even|[Ee]ight|[Nn]ine)[ ,-]+(?:[Zz]ero|[Oo]h|[Oo]ne|[Tt]wo|[Tt]hree|[Ff]our|[Ff]ive|[Ss]ix|[Ss]even|[Ee]ight|[Nn]ine)[ ,-]")
_WORD_RUN = re.compile(r"\b(?:(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[ ,-]+){6,}(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)\b", re.I)

_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+(?:[a-z]{2,}|[A-Z]{2,}|[A-Za-z]{2,})")

#: Where telephone and identity numbers can be: stretches of digits and the signs that group them.
_FIGURES = re.compile(r"[+(\d][\d ().+-]{7,}+")

# A number ends before anything but a digit, or before the number of a thing (1 or 2 digits and 号) set right behind it.
_END = r"(?:(?!\d)|(?=\d{1,2}号))"
_CHINA = r"(?:\(\+?86\)|\+86|0086)[ -]?"
_GAP = r"(?: - |[ .-])?"
_PHONE = re.compile(
    rf"(?<![\dA-Za-z])(?:(?:{_CHINA}|(?<!\d)86[ -])?1{_GAP}[3-9](?:{_GAP}\d){{9}}{_END}"  # mobile, in any grouping
    rf"|(?:{_CHINA})?(?:\(0\d{{2,3}}\)|0\d{{2,3}}-?)[ ]?(?:\d{{4}}[ -]?\d{{4}}|\d{{3}}[ -]?\d{{4}}){_END}"  # with area code
    rf"|{_CHINA}\(?[1-9]\d{{1,2}}\)?[ -]?\d{{4}}[ -]?\d{{3,4}}{_END}"
    rf"|(?:\+|00)44[ -]?(?:\(0\)[ ]?)?\d{{2,4}}[ -]?\d{{3,4}}[ -]?\d{{3,4}}{_END}|\(?0\d{{2,4}}\)?[ -]\d{{3,4}}[ -]\d{{3,4}}{_END}"  # UK
    rf"|(?:\+?1[ .-]?)?(?:\([2-9]\d{{2}}\)[ ]?|[2-9]\d{{2}}[ .-])\d{{3}}[ .-]\d{{4}}{_END})"  # US
)
#: Usual groupings; a number grouped otherwise is none of a telephone behind the words for another kind of number.
_USUAL = re.compile(r".*1[3-9]\d[ -]?\d{4}[ -]?\d{4}|(?!.*1[ .-]?[3-9](?:(?: - |[ .-])?\d){9}).*")
_OTHER_NUMBER = re.compile(r"(?:\b(?:part|serial|order|item|invoice|batch|model|ticket|tracking|account)(?: (?:number|no\.?|id|code))?|流水号|单号|编号|条码|工单|订单|型号|批号|件号)[:#]? ?$", re.I)
_IDENTITY = re.compile(r"(?<![\dA-Za-z])\d(?:[ -]?\d){16}[ -]?[\dXx](?!\d)")
_SOCIAL = re.compile(r"(?<![\dA-Za-z-])(?<!\d )\d{3}([ -])\d{2}\1\d{4}(?![\d-]| \d)|(?:(?<=ID )|(?<=number )|(?<=holder )|(?<=SSN )|(?<=ID: )|(?<=SSN: ))\d{3} ?\d{2} ?\d{4}(?!\d)")
_WEIGHTS = [pow(2, 17 - i, 11) for i in range(17)]

_WAY = "大街|大道|街道|胡同|路|街|巷|弄|里|村"
_FIGURE = r"(?:[0-9]+[A-Za-z]?(?:-[0-9]+[A-Za-z]?)?|[一二三四五六七八九十百零〇]+)"
_NUMBERED = re.compile(rf"(?:{_WAY}) ?(?:第 ?)?{_FIGURE} ?(?:号|組|组|弄)(?:院)?")
_REST = re.compile(rf" ?(?:附 ?{_FIGURE} ?号| ?{_FIGURE} ?(?:号楼|号|幢|栋|座|单元|层|楼|室)|\d+(?!\d*[-年月日])(?=[^\d.]|$))*")
_ROAD = re.compile(
    r"\d{1,5}[A-Z]?,? (?:[A-Z][a-z']+ ){1,3}(?:Road|Street|Lane|Avenue|Close|Way|Court|Drive|Square|Row|Terrace|Rd|St|Ave|Ln)\b\.?"
    r"(?:, (?:Flat|Apt|Unit|Suite) \w+)?(?:, [A-Z][a-z]+(?: [A-Z]{1,2}\d[\dA-Z]? \d[A-Z]{2})?)?"
)

# What large units of places end with, and words that an address stands behind.
_UNIT = re.compile("自治区|自治州|自治县|特别行政区|地区|新区|[省市州盟区县旗镇乡]")
_CUE = re.compile("住址|地址|家住|人住|寄至|寄到|送至|送到|时放|住在|位于|放在|设在|坐落在|坐落于|门牌|[在到至于往住距从沿经过去找寄送放](?=..)")
_TAIL_OF_CUE = re.compile("[为是在] ?")
#: A place without a boundary or a word like those before it: units with names of two characters, the most common length.
_SHORT = re.compile(r"((?:[一-鿿]{2}省 ?)?(?:[一-鿿]{2}市 ?)?(?:[一-鿿]{2}[区县旗] ?)?(?:[一-鿿]{2}[镇乡] ?)?[一-鿿]{2}[东西南北中]?)$")


#: For each character of a rewritten text, where in the source that which it stands for starts and ends.
Places = tuple[np.ndarray, np.ndarray]


def _rewrite(text: str, at: Places | None, pattern: re.Pattern, put) -> tuple[str, Places | None]:
    """Replace the matches of a pattern, and keep the source places of every character."""
    parts, starts, ends, last = [], [], [], 0
    for m in pattern.finditer(text):
        at = (np.arange(len(text)), np.arange(1, len(text) + 1)) if at is None else at
        new, (begin, end) = put(m), m.span()
        parts += [text[last:begin], new]
        same = len(new) == end - begin
        starts += [at[0][last:begin], at[0][begin:end] if same else np.full(len(new), at[0][begin])]
        ends += [at[1][last:begin], at[1][begin:end] if same else np.full(len(new), at[1][end - 1])]
        last = end
    if not parts:
        return text, at
    return "".join([*parts, text[last:]]), (np.concatenate([*starts, at[0][last:]]), np.concatenate([*ends, at[1][last:]]))


def plain_signs(texts: list[str]) -> list[str]:
    """Texts with full-width and look-alike characters in ASCII, character by character, all in one pass."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < len(_TABLE)
    joined = np.where(low, _TABLE[np.where(low, points, 0)], points).tobytes().decode("utf-32-le", "surrogatepass")
    ends = np.cumsum([len(t) for t in texts]).tolist()
    return [joined[start:end] for start, end in zip([0, *ends], ends, strict=False)]


def normalise(plain: str) -> tuple[str, Places | None]:
    """A text in plain signs without disguises, and the source places of its characters (None: the same places)."""
    at = None
    if _HIDDEN.search(plain):
        plain, at = _rewrite(plain, at, _HIDDEN, lambda m: "")
    if _AT_HINT.search(plain):
        plain, at = _rewrite(plain, at, _AT, lambda m: "@")
    if _DOT_HINT.search(plain):
        plain, at = _rewrite(plain, at, _DOT, lambda m: ".")
    if _HAN_RUN.search(plain):
        plain, at = _rewrite(plain, at, _HAN_RUN, lambda m: m.group().translate(_HAN_DIGITS))
    if _WORD_HINT.search(plain):
        plain, at = _rewrite(plain, at, _WORD_RUN, lambda m: "".join(_WORD_DIGITS[w] for w in re.findall("[a-z]+", m.group().lower())))
    return plain, at


def _is_resident(number: str) -> bool:
    """Whether the last of 18 characters is the check character of the first 17 (GB 11643)."""
    return "10X98765432"[sum(int(d) * w for d, w in zip(number, _WEIGHTS, strict=False)) % 11] == number[17].upper()


def _is_birthday(eight: str) -> bool:
    try:
        return 1850 <= date(int(eight[:4]), int(eight[4:6]), int(eight[6:])).year <= 2100
    except ValueError:
        return False


def _identities(plain: str, figures: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for begin, end in figures:
        for m in _IDENTITY.finditer(plain, begin, end):
            bare = re.sub("[ -]", "", m.group())
            if _is_resident(bare) and (len(m.group()) == 18 or _is_birthday(bare[6:14])):
                yield m.span()
        for m in _SOCIAL.finditer(plain, begin, end):
            yield m.span()


def _phones(plain: str, figures: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for begin, end in figures:
        for m in _PHONE.finditer(plain, begin, end):
            if _USUAL.fullmatch(m.group()) or not _OTHER_NUMBER.search(plain, max(0, m.start() - 24), m.start()):
                yield m.span()


def _is_han(char: str) -> bool:
    return "一" <= char <= "鿿"


def _place_start(plain: str, end: int) -> int | None:
    """Where the place begins whose last name ends at ``end``: behind a boundary or a word like 位于, else by the usual length of names."""
    begin, low = end, max(0, end - 40)
    while begin > low and (_is_han(plain[begin - 1]) or (plain[begin - 1] == " " and begin - 2 >= low and _UNIT.match(plain[begin - 2]))):
        begin -= 1
    cued = False
    for cue in _CUE.finditer(plain, begin, end):
        # Within a place, behind one of its units, such a character belongs to a name.
        if end - cue.end() >= 2 and not (cue.start() > begin and _UNIT.match(plain[cue.start() - 1])):
            tail = _TAIL_OF_CUE.match(plain, cue.end(), end) if len(cue.group()) > 1 else None
            begin, cued = (tail.end() if tail else cue.end()), True
    first = next((m for m in _UNIT.finditer(plain, begin, end) if m.start() >= begin + 2), None)
    length = (first.start() if first else end) - begin
    longest = 6 if cued or (first and len(first.group()) > 1) else 4 if first else 3 + (plain[end - 1] in "东西南北中")
    if 2 <= length <= longest:
        return begin
    short = _SHORT.search(plain[max(0, end - 24) : end])
    return end - len(short.group(1)) if short else None


def _addresses(plain: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBERED.finditer(plain):
        start = _place_start(plain, m.start())
        if start is not None:
            yield start, _REST.match(plain, m.end()).end()
    for m in _ROAD.finditer(plain):
        if not m.start() or not plain[m.start() - 1].isalnum():
            yield m.span()


def find_spans(plain: str, model: NameModel = NameModel()) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the items in a text of ``plain_signs``, in order and without overlap, in source characters."""
    plain, at = normalise(plain)
    taken: list[tuple[int, int, str]] = []
    emails = (m.span() for m in _EMAIL.finditer(plain)) if "@" in plain else ()
    # Each stretch with what may follow it: a check character, or the number of a thing with 号.
    figures = [(m.start(), m.end() + 3) for m in _FIGURES.finditer(plain)]
    persons = (*chinese_names(plain, model), *english_names(plain, model))
    for kind, spans in zip(KINDS, (emails, _identities(plain, figures), _phones(plain, figures), _addresses(plain), persons), strict=True):
        for start, end in spans:
            i = bisect_left(taken, (start,))
            if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                taken.insert(i, (start, end, kind))
    if at is None:
        return [(kind, s, e) for s, e, kind in taken]
    return [(kind, int(at[0][s]), int(at[1][e - 1])) for s, e, kind in taken]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with ``[KIND]`` in the place of each span, and otherwise unchanged."""
    parts, last = [], 0
    for kind, start, end in spans:
        parts += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join([*parts, text[last:]])


def _scan(with_text: bool, model: NameModel):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_spans(t, model) if t else [] for t in plain_signs([t or "" for t in texts])]
            kinds = [[k for k, _, _ in spans] for spans in found]
            starts, ends = [[s for _, s, _ in spans] for spans in found], [[e for _, _, e in spans] for spans in found]
            columns = [batch.column(0), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
            names = ["doc", "kinds", "starts", "ends"]
            if with_text:
                columns.append(pa.array([t if t is None else redact(t, spans) for t, spans in zip(texts, found, strict=True)], pa.string()))
                names.append("redacted")
            yield pa.record_batch(columns, names=names)

    return scan


_FOUND = "doc long, kinds array<string>, starts array<long>, ends array<long>"


def _texts(df: DataFrame, doc: str, text: str) -> DataFrame:
    return df.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))


def _plain_texts(texts: list[str]) -> list[str]:
    return [normalise(t)[0] for t in plain_signs(texts)]


def personal_items(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, kind, start_pos, end_pos): every item in the whole text of every row, as source characters.

    Null and empty texts have no items; repeated rows are searched each for itself.
    """
    found = _texts(df, doc, text).mapInArrow(_scan(False, name_model(df, text, _plain_texts)), _FOUND)
    items = found.select("doc", F.explode(F.arrays_zip("kinds", "starts", "ends")).alias("i"))
    return items.select(F.col("doc").alias(doc), F.col("i.kinds").alias("kind"), F.col("i.starts").alias("start_pos"), F.col("i.ends").alias("end_pos"))


def redacted_texts(df: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, text, n_items): texts with typed placeholders for their items; null stays null, other text is unchanged."""
    found = _texts(df, doc, text).mapInArrow(_scan(True, name_model(df, text, _plain_texts)), f"{_FOUND}, redacted string")
    return found.select(F.col("doc").alias(doc), F.col("redacted").alias("text"), F.size("kinds").cast("long").alias("n_items"))
