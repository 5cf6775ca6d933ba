"""Names of persons in running text, weighed by counts over the whole corpus.

A name has no form of its own: 高压 begins with a family name, and so does 高昀.  Spark counts, over
all texts, how often each Han character stands in running text and how often in names behind
labels (姓名：, 联系人：), and which Latin words are written small.  A family name with one or
two characters behind it is then weighed by how much likelier those characters are in a name than in
text, and by what stands left and right of it; a run of capitalised words by whether they are words of
the language, and by the kind of thing that the run ends with.  Where a corpus is too
small to say anything, general knowledge decides: common family and given names, frequent and rare characters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import shared_table

# The most common Chinese family names, compound ones, frequent characters of given names, and of text.
FAMILY = (
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
    "庞樊兰殷施陶洪翟安颜倪严牛温芦季俞章鲁葛伍韦申尤毕聂焦向柳邢骆岳齐梅庄涂祁耿詹关费纪靳童欧甄裴祝霍宁尚符单柴路冉盛覃莫肖"
)
COMPOUND = "欧阳|慕容|司徒|上官|皇甫|尉迟|司马|诸葛|夏侯|令狐|端木|东方|公孙|长孙|宇文|轩辕|钟离|独孤"
COMMON_GIVEN = (
    "伟芳娜秀敏静丽强磊军洋勇艳杰娟涛明超霞平刚桂英华玉兰红梅建国志文德春海峰龙飞鹏辉斌波宁凤云莉玲燕萍婷雪琳慧佳颖欣怡梦雨晨宇浩博子轩梓涵思嘉俊凯健鑫旭阳晓小光荣福贵庆祥兴成忠义仁礼信诚林森松柏清江洪永振家世"
    "正学立新胜利民康安东南山川河亮星月彬莹晶璐瑶珍珠翠芬淑惠爱美香菊莲荷蓉薇蕾倩楠帆航昊然睿哲翔瑞泽鸿彦"
)
FREQUENT = (
    "的一是在不了有和人这中大为上个我以要他时来用们生到作地于出就分对会可主发年动同工也能下过说产种面而方后多定行法所经十三之进着等部度电力里如水化自二理起物现实加量都两体制机当使点从业本去把性好应开它合还因由其些然前外天四"
    "日那社事此位及样问应者全将与"
)
# What stands left of a name (labels, persons, verbs and prepositions) and right of it.
_LABEL = (
    "姓名|联系人|经办人|登记人|申请人|负责人|起草人|值班人|报告人|收件人|签收人|责任人|审核人|批准人|审批人|当事人|签发人|监护人|记录人|审核|批准|审批|拟稿|校对|签名|签字|联络人|申报人|投诉人|来信人|户主|乘客|患者|业主|作者|主讲|主任|经理|师傅|工程师|"
    "班长|队长|所长|厂长|站长|教授|老师|医生|律师|同事|经办|员工|职工|居民|村民|市民|客户|学生"
)
_BEFORE = "据由给交派请找和与跟同向被对让叫为经问托约代及归是称于后"
_AFTER = (
    "同志|先生|女士|小姐|师傅|主任|经理|老师|教授|医生|律师|班长|队长|所长|工程师|说|称|回忆|反映|表示|介绍|认为|告诉|指出|签|负责|保管|留下|打|来|在|到|去|于|和|与|及|等|的|已|也|将|向|把|今|昨|明天|是|为|担任|住|手机|电话|联系|提出|要求|报告|完成|主持|办理|处理|接|带|从|同"
)

HAN = "一-鿿"
_FAMILY_AT = re.compile(rf"{COMPOUND}|[{FAMILY}]")
_IS_HAN = re.compile(f"[{HAN}]")
_LABELLED = re.compile(rf"(?:{_LABEL})$")
_LABEL_SIGN = re.compile(r"[:|\t] ?$")
_FOLLOWED = re.compile(_AFTER)
# What makes the name before it one of a place, a body or a matter.
_NO_PERSON = re.compile("[东西南北中][路街巷]|省|市|区|县|镇|乡|村|路|街|巷|段|站|厂|桥|港|河|江|湖|山|岛|片区|项目|公司|集团|医院|学校|大学|中学|小学|银行|小区|广场|大厦|工业|机场|码头|水库|灯|泵|变电|机房|电厂|枢纽|油库|管理")
#: Names right behind a label and its colon, ended by something that is no Han character.
_SEED = re.compile(rf"[:|\t] ?(?:{COMPOUND}|[{FAMILY}])[ ·]?([{HAN}]{{1,2}})(?![{HAN}])")
#: A family name where a name may begin, with what follows it.
_POSSIBLE = re.compile(rf"(?:(?<![{HAN}])|(?<=[{_BEFORE}]))({COMPOUND}|[{FAMILY}])[ ·]?(?=([{HAN}])([{HAN}])?)")
_SMALL = re.compile(r"(?<![A-Za-z0-9'@._-])[a-z]{2,}(?![A-Za-z0-9'@_-]|\.[A-Za-z])")

#: Pseudo-counts of general knowledge against those of the corpus: names behind labels, characters of text.
PRIOR_NAMES, PRIOR_TEXT = 200.0, 5_000.0
#: A Latin word is one of the language if its small form makes up one in so many small words (so at most so many words are).
ORDINARY = 100_000
#: Weight from which a Chinese name is accepted, least weight of its given name without a label, bounds of single weights.
ACCEPT, ACCEPT_GIVEN, FAMILY_WEIGHT, GIVEN_WEIGHT = 5.0, 1.0, 3.0, 6.0


@lru_cache(maxsize=1)
def _prior() -> tuple[dict[str, float], dict[str, float], float, float]:
    """Chances of characters in given names and in text without a corpus: listed ones, and any other one of a rare kind or not."""
    text = {c: 0.4 / len(FREQUENT) for c in FREQUENT}
    given = {c: 0.6 / len(COMMON_GIVEN) for c in COMMON_GIVEN}
    return given, text, 1.8e-4, 2e-5


@lru_cache(maxsize=1 << 15)
def _is_rare(char: str) -> bool:
    """Whether a character is outside the first level (3,755 characters in common use) of GB 2312."""
    try:
        return char.encode("gb2312")[0] >= 0xD8
    except UnicodeEncodeError:
        return True


@dataclass
class NameModel:
    """Counts of a corpus that names are weighed by.

    ``text`` and ``begun`` are, for each Han character, its occurrences and those of them that could belong to a name
    (behind a family name where a name may begin), but for those with the most frequent partner: 措 always follows 安 in 安全措施, while
    names pair freely.  ``given`` counts characters of names behind labels.  The three have at
    most 20,992 entries (the Han block). ``words`` holds the Latin words whose small form makes up at
    least 1 / ORDINARY of all small words, so at most ORDINARY words, whatever the corpus's size.
    """

    text: dict[str, int] = field(default_factory=dict)
    begun: dict[str, int] = field(default_factory=dict)
    given: dict[str, int] = field(default_factory=dict)
    words: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self._texts, self._names = float(sum(self.text.values())), float(sum(self.given.values()))
        self._weights: dict[str, float] = {}
        self._families: dict[str, float] = {}

    def _in_text(self, char: str) -> float:
        _, text, usual, rare = _prior()
        prior = text.get(char) or (rare if _is_rare(char) else usual)
        return (max(0, self.text.get(char, 0) - self.begun.get(char, 0)) + PRIOR_TEXT * prior) / (self._texts + PRIOR_TEXT)

    def given_weight(self, char: str) -> float:
        """Log of how much likelier a character is in a given name than in text."""
        weight = self._weights.get(char)
        if weight is None:
            prior = _prior()[0].get(char, 1.0e-4)
            chance = (self.given.get(char, 0) + PRIOR_NAMES * prior) / (self._names + PRIOR_NAMES)
            self._weights[char] = weight = max(-GIVEN_WEIGHT, min(GIVEN_WEIGHT, log(chance / self._in_text(char))))
        return weight

    def family_weight(self, family: str) -> float:
        """The same for a family name; that of two characters has the greatest weight."""
        if len(family) > 1:
            return FAMILY_WEIGHT
        weight = self._families.get(family)
        if weight is None:
            self._families[family] = weight = max(-FAMILY_WEIGHT, min(FAMILY_WEIGHT, log(1 / len(FAMILY) / self._in_text(family))))
        return weight


def _left(plain: str, at: int) -> tuple[float, bool]:
    """Weight of what stands left of a name, and whether it is a label."""
    before = plain[max(0, at - 8) : at]
    sign = _LABEL_SIGN.search(before)
    if _LABELLED.search(before[: sign.start()] if sign else before.rstrip(" ")):
        return (4.0 if sign else 3.0), True
    if not before or not _IS_HAN.match(before[-1]):
        return 1.5, False
    return (1.0 if before[-1] in _BEFORE else 0.0 if before[-1] == "的" else -1.5), False


def _right(plain: str, at: int) -> float:
    if at >= len(plain) or not _IS_HAN.match(plain[at]):
        return 1.5
    if _NO_PERSON.match(plain, at):
        return -6.0
    return 1.5 if _FOLLOWED.match(plain, at) else -0.5


def chinese_names(plain: str, model: NameModel) -> Iterator[tuple[int, int]]:
    """Spans of Chinese names in plain text, those of greater weight first where two overlap."""
    found = []
    size = len(plain)
    for m in _FAMILY_AT.finditer(plain):
        start, at = m.span()
        spaced = at + 1 < size and plain[at] in " ·"
        at += spaced
        if at >= size or not _IS_HAN.match(plain[at]):
            continue
        first = model.given_weight(plain[at])
        two = at + 1 < size and bool(_IS_HAN.match(plain[at + 1]))
        second = model.given_weight(plain[at + 1]) if two else 0.0
        if first + max(0.0, second) < ACCEPT_GIVEN - 4:
            continue
        left, labelled = _left(plain, start)
        if spaced and left < 0.0:
            continue
        base = model.family_weight(m.group()) + left
        least = -3.0 if labelled else ACCEPT_GIVEN
        options = []
        if first >= least:
            options.append((base + first + _right(plain, at + 1), at + 1))
        if two and first + second >= least and second >= -3.0:
            options.append((base + first + second + _right(plain, at + 2), at + 2))
        if options and (best := max(options))[0] >= ACCEPT:
            found.append((-best[0], start, best[1]))
    taken: list[tuple[int, int]] = []
    for _, start, end in sorted(found):
        if all(end <= s or start >= e for s, e in taken[-8:]) and all(end <= s or start >= e for s, e in taken):
            taken.append((start, end))
    yield from taken


# English words that begin sentences or stand beside names, titles, heads of names of places and bodies, first words of place names.
_PLAIN_WORDS = frozenset(
    "the a an this that these those my our your his her its their we you he she they it i and or but if when while as at by for from in into of off on onto over per through to under up upon with within without after before during since until "
    "between yesterday today tomorrow now then there here please dear thanks thank regards hello hi contact call ask reply see note unit clause section form plan table figure page chapter appendix sheet records record applicant keys copies subject "
    "according monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december not no yes all any each every both some such only also chief general deputy senior junior "
    "chinese english american british french german european asian".split()
)
_TITLES = frozenset("mr mrs ms miss dr prof professor sir madam captain engineer inspector officer director manager".split())
_PLACE_HEADS = frozenset(
    "road street lane avenue close way court drive square row terrace park hill bridge river lake bay island port harbour airport valley city town village county state province district region building house hall tower centre center works depot "
    "terminal station substation store stores plant factory mill mine yard dock wharf warehouse hospital clinic school college university institute library museum hotel bank group company corporation limited ltd inc llc plc association "
    "committee council ministry department office bureau agency authority court church society foundation union league club cold pumping power north south east west central project system service services act law code standard".split()
)
_PLACE_STARTS = frozenset("new san santa los las saint st north south east west great old upper lower united mount lake fort port cape royal national international central".split())
COMMON_FIRST = frozenset(
    "james john robert michael william david richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric "
    "jonathan stephen larry justin scott brandon benjamin samuel frank gregory raymond alexander patrick jack dennis peter adam henry simon philip martin alan oliver harry luke mary patricia jennifer linda elizabeth barbara susan jessica sarah "
    "karen lisa nancy betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca laura sharon cynthia kathleen amy angela shirley anna brenda pamela emma nicole helen samantha katherine christine "
    "maria rachel olivia julia alice grace sophie charlotte lucy jane kate claire hannah victoria juan jose carlos luis wei ming".split()
)
_WORD = r"(?:O'|Mc|Mac|D')?[A-Z][a-z]+(?:-[A-Z][a-z]+)?"
_RUN = re.compile(rf"(?<![A-Za-z0-9@'/_-])(?<![a-z]\.){_WORD}(?:,? (?:{_WORD}|[A-Z]\.?)(?![A-Za-z0-9@]))+")
_TOKEN = re.compile(rf"{_WORD}|[A-Z]\.?|,")
_CUED = re.compile(r"(?:\b(?:by|for|with|to|from|and|contact|ask|call|called|met|told|says|said|mr|mrs|ms|dr|prof|attn|applicant|name|holder|signed|author|owner)[.:]? |[:(/|] ?)$", re.I)


def _is_ordinary(word: str, model: NameModel) -> bool:
    low = word.lower()
    return low in _PLAIN_WORDS or low in _TITLES or (low in model.words and low not in COMMON_FIRST)


def english_names(plain: str, model: NameModel) -> Iterator[tuple[int, int]]:
    """Spans of names in Latin letters: given (initial) family, or family, given (initial)."""
    for run in _RUN.finditer(plain):
        part: list[re.Match] = []
        tokens = list(_TOKEN.finditer(plain, run.start(), run.end()))
        for k, token in enumerate([*tokens, None]):
            word = token.group() if token else ""
            inner = part and token and (word == "," or len(word.rstrip(".")) == 1)
            if token and (inner or (len(word.rstrip(".")) > 1 and not _is_ordinary(word, model))):
                part.append(token)
                continue
            # A run before the head of a place or body (Cold Store, Road) is a name of that.
            headed = word.lower() in _PLACE_HEADS if token else False
            if part and not headed:
                yield from _english_part(plain, part)
            part = []


def _english_part(plain: str, part: list[re.Match]) -> Iterator[tuple[int, int]]:
    while part and part[-1].group() == ",":
        part = part[:-1]
    words = [t.group() for t in part]
    start = 0
    while start < len(part):
        stop = start
        while stop < len(part) and words[stop] != ",":
            stop += 1
        own = words[start:stop]
        whole = [w for w in own if len(w.rstrip(".")) > 1]
        known = bool(whole) and whole[0].lower() in COMMON_FIRST
        places = any(w.lower() in _PLACE_HEADS for w in whole) or (whole and whole[0].lower() in _PLACE_STARTS)
        cued = bool(_CUED.search(plain, max(0, part[start].start() - 14), part[start].start()))
        turned = None
        if len(own) == 1 and whole and not places and stop + 1 < len(part):
            # Family, Given (Initial): one word on either side of the comma.
            end = stop + 1
            while end < len(part) and words[end] != ",":
                end += 1
            right = words[stop + 1 : end]
            names = [w for w in right if len(w.rstrip(".")) > 1]
            follows = re.match(r" (?:[a-z(/]|at )", plain[part[end - 1].end() : part[end - 1].end() + 4])
            if len(names) == 1 and right[0] == names[0] and names[0].lower() not in _PLACE_HEADS and (names[0].lower() in COMMON_FIRST or cued or (follows and not plain[: part[start].start()].rstrip().endswith(","))):
                turned = end
        if turned:
            yield part[start].start(), part[turned - 1].end()
            start = turned + 1
            continue
        if 2 <= len(whole) <= 3 and not places and len(own[0].rstrip(".")) > 1 and len(own[-1].rstrip(".")) > 1 and (len(whole) == 2 or known or cued):
            yield part[start].start(), part[stop - 1].end()
        start = stop + 1


def _counts(batches: Iterator[pa.RecordBatch], plain_texts) -> Iterator[pa.RecordBatch]:
    """(kind, word, n) of the texts of a task; flushed whenever the held words become many."""
    held = {name: Counter() for name in ("text", "begun", "family", "given", "small")}

    def flush() -> Iterator[pa.RecordBatch]:
        for name, counter in held.items():
            if counter:  # no empty batches
                yield pa.record_batch([pa.array([name] * len(counter)), pa.array(list(counter), pa.string()), pa.array(list(counter.values()), pa.int64())], names=["kind", "word", "n"])
                counter.clear()

    for batch in batches:
        plains = plain_texts([t for t in batch.column(0).to_pylist() if t])
        points = np.frombuffer("".join(plains).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.bincount(points[(points >= ord("一")) & (points <= ord("鿿"))] - ord("一"))
        held["text"].update({chr(ord("一") + k): int(seen[k]) for k in np.flatnonzero(seen)})
        for plain in plains:
            for m in _POSSIBLE.finditer(plain):
                family, first, second = m.groups()
                held["family"][family + first] += 1
                held["begun"][first + family] += 1
                if second:
                    held["begun"][second + family] += 1
            for m in _SEED.finditer(plain):
                if _LABELLED.search(plain[max(0, m.start() - 8) : m.start()].rstrip(" ")):
                    held["given"].update(m.group(1))
            held["small"].update(_SMALL.findall(plain))
        if len(held["small"]) > 100_000:
            yield from flush()
    yield from flush()


def name_model(texts: DataFrame, text: str, plain_texts) -> NameModel:
    """The counts of all texts; what comes to the driver has the bounds that `NameModel` names."""
    parts = texts.select(F.col(text).alias("text")).mapInArrow(lambda b: _counts(b, plain_texts), "kind string, word string, n long")
    counted = shared_table(parts.groupBy("kind", "word").agg(F.sum("n").alias("n")))
    small = counted.where("kind = 'small'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    paired = F.col("kind").isin("begun", "family")
    pairs = counted.where(paired).groupBy(F.substring("word", 1, 1).alias("word")).agg((F.sum("n") - F.max("n")).alias("n"))
    single = counted.where(~paired & ((F.col("kind") != "small") | (F.col("n") * ORDINARY >= small)))
    tables: dict[str, dict[str, int]] = {name: {} for name in ("text", "begun", "given", "small")}
    for kind, word, n in single.unionByName(pairs.withColumn("kind", F.lit("begun"))).collect():
        tables[kind][word] = n
    return NameModel(tables["text"], tables["begun"], tables["given"], frozenset(tables["small"]))
