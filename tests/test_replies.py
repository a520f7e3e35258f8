from pyspark.sql import functions as F

from quillmere.functions import numbers as N
from quillmere.operators import approval, materials, replies, requests


def texts(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, text string")


def test_plain_decimal(spark):
    got = texts(spark, "1000", "10.50", "0", "1234567.891", None).select(N.plain_decimal(F.col("text").cast("decimal(18,3)")).alias("x")).collect()
    assert [r.x for r in got] == ["1,000", "10.5", "0", "1,234,567.89", None]


def test_approval_reply(spark):
    d = texts(spark, "采购电脑预算60000元谁审批", "采购设备谁审批", "你好", None).withColumn("notes", F.array(F.lit("一"))).withColumn("sources", F.array(F.lit("S1"), F.lit("S2")))
    got = [r.reply.split("\n") for r in replies.approval_reply(approval.check(d)).orderBy("id").collect()]
    assert got[0] == ["审批层级：重要采购。", "规则计算金额：60,000元。", "审批路线：", "1. 直属经理（审批）", "2. 部门负责人（审批）", "3. 信息技术部（技术评审）", "4. 采购管理部（审批）", "5. 财务管理部（审批）", "6. 分管副总经理（审批）", "触发条件：涉及信息技术类采购。", "提示：一", "制度依据：[S1] [S2]"]
    assert got[1][:2] == ["还需要补充信息后才能准确判断审批路线。", "请补充预计采购总金额（应包含税费、运输、安装、培训和维护等必要费用）。"]
    assert got[2][1] == got[3][1] == replies.APPROVAL_QUESTIONS["application_type"]


def test_material_reply(spark):
    d = texts(spark, "采购设备预算60000元需要什么材料", "请病假3天，我有诊断证明，材料齐全吗", "请病假3天，还缺什么材料，没有任何材料", "年假需要什么材料", "你好")
    got = [r.reply.split("\n") for r in replies.material_reply(materials.check(d)).orderBy("id").collect()]
    assert got[0][0] == "需要准备的材料如下：" and any("供应商报价单（至少3份）" in x for x in got[0])
    assert got[1] == ["按当前提供的信息，必需材料已齐全。"]
    assert got[2] == ["按当前提供的信息，材料尚未齐全，还缺：", "1. 医疗证明（敏感材料）"]
    assert got[3] == ["现有制度没有列出固定的必交证明附件。"]
    assert got[4] == [replies.MATERIAL_QUESTIONS["application_type"]]


FULL = (
    "帮我生成采购申请草稿，采购10台显示器，每台1200元，采购目的为日常办公，采购类别为IT设备，规格为27寸，预算编号为B-100，交付日期为2026-09-01，使用地点为三楼，推荐供应商为甲公司，推荐理由为价格低，普通采购。",
    "帮我生成差旅报销草稿，出差申请编号为T-7，出发地为北京，目的地为上海，开始日期为2026-08-01，结束日期为2026-08-03，出差事由为培训，项目名称为甲，报销总金额为1,500元，费用明细为机票。",
    "帮我生成请假申请草稿，请2天年假，开始日期为2026-08-01，结束日期为2026-08-02，全天，请假原因为休息，交接人为李四，紧急联系人为王五，普通请假。",
    "帮我生成费用报销草稿，费用类别为会议费，报销金额为800元，业务目的为季度会，发生日期为2026-07-01，预算编号为B-1，收款对象为酒店，不涉及合同，不涉及采购。",
    "帮我生成采购申请草稿",
    "你好",
)


def drafted(df):
    return requests.drafts(df.withColumn("employee_id", F.lit("e")).withColumn("session_id", F.lit("s")))


def test_draft_reply(spark):
    got = replies.draft_reply(drafted(texts(spark, *FULL))).orderBy("id").collect()
    assert got[2].reply.startswith("已生成请假申请草稿") and "请假天数：2" in got[2].reply and "王五" not in got[2].reply
    assert got[4].clarification.startswith("请补充以下必填信息：采购事项、采购数量") and "待补字段：采购事项" in got[4].reply
    assert got[4].reply.endswith("安全状态：未确认、未提交；当前版本不会自动发起审批。")
    assert got[5].reply == got[5].clarification and got[5].summary is None


def test_a_rendered_request_gives_the_same_draft(spark):
    first = drafted(texts(spark, *FULL[:4])).select("id", "application_type", "fields")
    again = drafted(first.select("id", replies.request_text(F.col("application_type"), F.col("fields")).alias("text")))
    want = {r.id: (r.application_type, r.fields) for r in first.collect()}
    for r in again.collect():
        assert (r.application_type, r.fields) == want[r.id], r.text


def test_revisions(spark):
    d = texts(spark, "数量改成5台", "采购数量：十二", "物品名称改为键盘，谢谢", "好的", None)
    got = [r.m for r in d.orderBy("id").select(replies.revision_fields(F.col("text")).alias("m")).collect()]
    assert got[:4] == [{"quantity": "5", "unit": "台"}, {"quantity": "12"}, {"item_name": "键盘"}, {}] and not got[4]
    one = spark.range(1).select(replies.revised_request(F.lit("leave"), F.create_map(F.lit("reason"), F.lit("休息")), F.array(F.lit(" 补一句 "), F.lit(""))).alias("t")).first().t
    assert one == "帮我生成请假申请草稿，请假原因为休息。\n历史补充记录：\n补一句"
