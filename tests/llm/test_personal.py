"""Items in free text: kinds, places, disguises, traps, and placeholders."""

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import personal


def items(text):
    spans = personal.find_spans(personal.plain_signs([text])[0])
    return [(kind, text[start:end]) for kind, start, end in spans]


CASES = [
    ("邮箱：li.wang+kb@ops.example.com。", [("email", "li.wang+kb@ops.example.com")]),
    ("发 xu-qin [at] corp [dot] example [dot] net 收", [("email", "xu-qin [at] corp [dot] example [dot] net")]),
    ("chen＠gw-3．fengxi．example和wang(at)zhan.test", [("email", "chen＠gw-3．fengxi．example"), ("email", "wang(at)zhan.test")]),
    ("write jane.doe at example dot com now", [("email", "jane.doe at example dot com")]),
    ("mаil@exаmple.com", [("email", "mаil@exаmple.com")]),  # Cyrillic а
    ("箍筋采用8@130，见@值班群，3@37mm, see", []),
    ("手机１６８９６４４３０３９，电话(0481) 7650 6805", [("phone", "１６８９６４４３０３９"), ("phone", "(0481) 7650 6805")]),
    ("（+86）154 94551617转3；+86-164-0358-6036", [("phone", "（+86）154 94551617"), ("phone", "+86-164-0358-6036")]),
    ("手机：169576064022号升降平台", [("phone", "16957606402")]),
    ("电话一三八零零一三八零零零。", [("phone", "一三八零零一三八零零零")]),
    ("call one three eight zero zero one three eight zero zero zero today", [("phone", "one three eight zero zero one three eight zero zero zero")]),
    ("Call 617.555.0144 or +44 20 7946 0769, (206) 555-0168", [("phone", "617.555.0144"), ("phone", "+44 20 7946 0769"), ("phone", "(206) 555-0168")]),
    ("工单44777249856，流水号501609610805650，执行0488-2019号标准", []),
    ("证件：11010519491231002X，资产条码325503943031847890", [("identity", "11010519491231002X")]),
    ("110105-19491231-002x (ID 666-27-2144)", [("identity", "110105-19491231-002x"), ("identity", "666-27-2144")]),
    ("住址：榆井市 洛垭区 岭潭东路 180 号附2号；", [("address", "榆井市 洛垭区 岭潭东路 180 号附2号")]),
    ("家住柏潭巷２５号3幢2单元408室的", [("address", "柏潭巷２５号3幢2单元408室")]),
    ("来信地址为峪岛区樟潭村3组54号。柳汊东路沿线11处", [("address", "峪岛区樟潭村3组54号")]),
    ("lives at 164B Old Quay Road, Flat 3, Quenby TB4 2QX. The Saltmarsh Road", [("address", "164B Old Quay Road, Flat 3, Quenby TB4 2QX")]),
    ("联系人：任　皓，经办人慕容邈说", [("person", "任　皓"), ("person", "慕容邈")]),
    ("Contact O'Farrowby, Corwin and Quilla T. Merrowdale", [("person", "O'Farrowby, Corwin"), ("person", "Quilla T. Merrowdale")]),
    ("先校验固定式轴承座，再测温", []),
]


@pytest.mark.parametrize(("text", "found"), CASES)
def test_items(text, found):
    assert items(text) == found


def test_places_are_those_of_the_source():
    text = "甲​乙 wang [at] zhan [dot] test，再​打 138​0013 8000"
    assert items(text) == [("email", "wang [at] zhan [dot] test"), ("phone", "138​0013 8000")]


def test_placeholders_and_edges(spark):
    rows = [(1, "联系人：任皓，电话：194 7358 2970。"), (2, None), (3, ""), (4, "无。" * 100_000 + "a@b.example"), (1, "任皓"), (5, "((((" * 20_000 + "x@" + "a" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "kinds": F.lit("k"), "start_pos": F.lit(2)})
    texts = sorted((r.doc_id, r.text or "", r.n_items) for r in personal.redacted_texts(df, "doc_id", "text").where("doc_id < 4").collect())
    assert texts == [(1, "[PERSON]", 1), (1, "联系人：[PERSON]，电话：[PHONE]。", 2), (2, "", 0), (3, "", 0)]
    found = personal.personal_items(df, "doc_id", "text")
    assert {(r.doc_id, r.kind, r.start_pos) for r in found.collect()} == {(1, "person", 4), (1, "phone", 10), (1, "person", 0), (4, "email", 200_000)}
    assert found.limit(0).count() == 0 and personal.personal_items(df.limit(0), "doc_id", "text").count() == 0


# Hand-made sentences that have nothing to do with the test data: items in double brackets, with their kind.
HELD_OUT = """
[[person:王小明]]今天来电，说[[person:张伟]]和[[person:刘洋]]在现场。
经办人[[person:陈建国]]签字后交给[[person:李娜]]。
参加会议的有[[person:王芳]]、[[person:李强]]、[[person:赵敏]]。
请[[person:孙丽华]]同志联系[[person:周杰]]先生，手机[[phone:138.0013.8000]]。
[[person:欧阳文静]]老师住在[[address:北京市朝阳区建国路88号3号楼]]。
[[address:石景山路5号]]的[[person:吴军]]反映噪声大。
联系人：[[person:郑晓峰]]，电话：[[phone:1380-0138-000]]，邮箱 [[email:zheng.xf@mail.example.org]]。
客户[[person:黄志强]]于昨天在[[address:黑龙江省哈尔滨市南岗区学府路12号]]签收。
寄到[[address:上海市浦东新区世纪大道100号]]，收件人：[[person:何雪梅]]。
据[[person:马文博]]介绍，[[address:内蒙古自治区呼和浩特市新城区新华大街1号]]已拆迁。
[[person:李雷]]说[[person:韩梅梅]]不在。
由[[person:诸葛明]]担任主任，[[person:徐晨]]负责记录。
地址：[[address:文三路12-3号]]，电话[[phone:0571-8888 1234]]。
家住[[address:广州市天河区体育西路103号]]的[[person:林嘉欣]]今天报告。
[[address:解放路12A号]]门口有人等[[person:胡国庆]]。
身份证号[[identity:11010519491231002X]]，姓名：[[person:朱秀英]]。
任何人不得擅自操作高压设备，方案另行通知，安全第一，万一停电时间不够。
金属软管与石油管道应分开，于是高度、温度、江水都要记录，白天施工。
订单号44777249856已发货，流水号 20240101123，版本3.2.1。
[[person:John Smith]] called yesterday, then [[person:Maria Garcia]] wrote to us.
Yesterday [[person:Emma Watson]] came with [[person:Priya Raman]] to the office.
Contact [[person:O'Brien, Patrick]] at [[phone:+44 20 7946 0018]] or [[email:pob [at] firm [dot] example]].
Dr. [[person:Robert Brown]] lives at [[address:12 Station Road]]; SSN [[identity:666 27 2144]].
The report was drafted by [[person:Anna-Lena Kovacs]], not by the New York Times.
Machine Learning Group visited San Francisco and Oxford University on Monday.
The White House and Union Station are closed until June. Part number 136532-93289 is obsolete.
Dear [[person:Thomas K. Miller]], your order left Springfield Depot.
Regards, [[person:Tom Hardy]]
According to [[person:Yusuf Demir]] the valve failed at [[address:221B Baker Street]].
Signed: [[person:McAllister, Joan]] and [[person:David Lee]], [[phone:(312) 555-0142]].
"""


def test_held_out_precision_and_recall():
    """Sentences from outside the corpus, each kind's precision and recall (shown with ``-s``); a single text without counts of a corpus."""
    import re
    from collections import Counter

    true, found, both = Counter(), Counter(), Counter()
    for line in HELD_OUT.strip().splitlines():
        wanted, text, last = set(), "", 0
        for m in re.finditer(r"\[\[(\w+):(.*?)\]\]", line):
            text += line[last : m.start()]
            wanted.add((m.group(1), len(text)))
            text, last = text + m.group(2), m.end()
        text += line[last:]
        got = {(kind, start) for kind, start, _ in personal.find_spans(personal.plain_signs([text])[0])}
        true.update(k for k, _ in wanted), found.update(k for k, _ in got), both.update(k for k, _ in wanted & got)
    for kind in personal.KINDS:
        recall, precision = both[kind] / true[kind], both[kind] / found[kind]
        print(f"{kind}: {true[kind]} true, recall {recall:.3f}, precision {precision:.3f}")
        assert recall >= 0.9 and precision >= 0.9, kind


def test_counts_of_the_corpus_decide(spark):
    """高压 and 安全措施 are words where a corpus uses them as such; rare given names are learnt from names behind labels."""
    texts = [f"检查高压设备{i}，落实安全措施。再查高压柜。联系人：{f}{g}，已到。" for i, (f, g) in enumerate([("钱", "翀"), ("孙", "翀"), ("李", "彧"), ("周", "彧")] * 20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "高压。安全措施。", "此事交高翀办理。", None, ""])], "doc_id long, text string")
    found = personal.personal_items(df, "doc_id", "text").where("doc_id >= 80").collect()
    assert [(r.doc_id, r.kind, r.start_pos) for r in found] == [(81, "person", 3)]
    labelled = personal.personal_items(df, "doc_id", "text").where("kind = 'person' AND doc_id < 80")
    assert labelled.count() == 80
