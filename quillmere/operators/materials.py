"""Required, provided and missing materials of a request.

Requirements are arrays of types with counts, exploded and joined to a small rules table of
names, aliases and sources; what is missing is a left join of required with provided counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.text import has_any, strip
from .approval import IT_CUES, LEAVE_CUES, first_cue

#: Type, aliases (longest first where it matters), sensitive, source document and article.
MATERIALS = (
    ("approved_travel_application", ("已审批的出差申请单", "出差审批单", "出差申请单"), False, "TRAVEL_POLICY_001", "第十六条"),
    ("travel_itinerary", ("差旅行程单", "行程单", "差旅行程"), False, "TRAVEL_POLICY_001", "第十六条"),
    ("transportation_receipts", ("交通票据", "电子客票", "车票", "机票", "交通凭证"), False, "TRAVEL_POLICY_001", "第十六条"),
    ("accommodation_invoice", ("住宿发票", "酒店发票"), False, "TRAVEL_POLICY_001", "第十六条"),
    ("hotel_detail", ("酒店住宿明细", "住宿明细", "酒店明细"), False, "TRAVEL_POLICY_001", "第十六条"),
    ("payment_records", ("支付记录", "付款记录", "支付截图", "付款截图"), False, "TRAVEL_POLICY_001", "第十六条"),
    ("business_trip_result", ("出差成果", "工作说明", "出差总结", "会议纪要"), False, "TRAVEL_POLICY_001", "第十六条"),
    ("technical_requirement", ("技术需求说明", "技术需求"), False, "PROCUREMENT_POLICY_001", "第十条"),
    ("product_specification", ("产品规格说明", "规格说明", "产品规格"), False, "PROCUREMENT_POLICY_001", "第十条"),
    ("service_scope", ("服务范围说明", "服务范围", "服务需求说明"), False, "PROCUREMENT_POLICY_001", "第十条"),
    ("budget_proof", ("项目预算证明", "预算证明", "预算材料"), False, "PROCUREMENT_POLICY_001", "第十条"),
    ("market_inquiry", ("市场询价材料", "询价材料", "询价记录"), False, "PROCUREMENT_POLICY_001", "第十条"),
    ("historical_price", ("历史采购价格", "历史价格"), False, "PROCUREMENT_POLICY_001", "第十条"),
    ("quotation", ("供应商报价单", "供应商报价", "报价单", "报价"), False, "PROCUREMENT_POLICY_001", "第十七条"),
    ("comparison_record", ("书面比价记录", "比价记录", "比价表"), False, "PROCUREMENT_POLICY_001", "第十八条"),
    ("emergency_purchase_explanation", ("紧急采购说明", "紧急说明"), False, "PROCUREMENT_POLICY_001", "第十条"),
    ("it_review_opinion", ("信息技术评审意见", "IT评审意见", "技术评审意见"), False, "PROCUREMENT_POLICY_001", "第十条"),
    ("tender_document", ("招标文件", "投标文件", "竞争性采购材料"), False, "PROCUREMENT_POLICY_001", "第十九条"),
    ("expense_reimbursement_form", ("费用报销单", "报销单"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十三条"),
    ("valid_invoice", ("合规发票", "有效凭证", "发票", "报销凭证"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十三条"),
    ("expense_details", ("费用明细", "消费明细", "费用清单"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十三条"),
    ("business_purpose_statement", ("业务事由说明", "业务事由", "用途说明"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十三条"),
    ("prior_approval_record", ("事前审批记录", "审批记录", "事前审批"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十三条"),
    ("budget_reference", ("预算编号", "成本中心", "预算信息"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十三条"),
    ("meeting_notice", ("会议通知", "会议议程", "议程"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十四条"),
    ("attendee_list", ("参会人员名单", "参会名单", "人员名单"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十四条"),
    ("venue_or_service_order", ("会议场地订单", "会议服务订单", "场地订单", "服务订单"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十四条"),
    ("training_notice", ("培训通知", "课程介绍", "培训介绍"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十五条"),
    ("registration_record", ("报名记录", "报名凭证"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十五条"),
    ("completion_proof", ("完课证明", "结业证明", "考试结果", "培训证书"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十五条"),
    ("entertainment_parties", ("招待对象", "参与人员", "客户名单"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十六条"),
    ("dining_invoice", ("餐饮发票", "餐费发票"), False, "EXPENSE_REIMBURSEMENT_GUIDE_001", "第十六条"),
    ("medical_proof", ("医疗证明", "诊断证明", "病假建议书", "门诊记录", "住院记录", "医院证明"), True, "LEAVE_POLICY_001", "第十二条"),
    ("marriage_registration_certificate", ("结婚登记证明", "结婚证", "婚姻证明"), True, "LEAVE_POLICY_001", "第十六条"),
)
TRAVEL = tuple(m[0] for m in MATERIALS[:7])
EXPENSE = ("expense_reimbursement_form", "valid_invoice", "payment_records", "expense_details", "business_purpose_statement", "prior_approval_record", "budget_reference")
BY_CATEGORY = {"meeting": ("meeting_notice", "attendee_list", "venue_or_service_order"), "training": ("training_notice", "registration_record", "completion_proof"), "business_entertainment": ("entertainment_parties", "dining_invoice")}
#: Cues.
COMPARISON = ("齐全", "还缺", "缺什么", "缺哪些", "帮我检查", "检查一下", "我有", "已有", "已经有", "准备了", "已准备", "提供了", "已提供", "提交了", "手上有", "还没有", "目前没有", "尚未提供", "未提供")
NOTHING = ("没有任何材料", "什么材料都没有", "还没准备材料", "尚未准备材料")
NEGATIVE = ("没有", "还没有", "没准备", "未准备", "未提供", "没提供", "缺少")
TRAVEL_PAPERS = ("申请单", "行程单", "交通票据", "住宿发票", "住宿明细", "出差成果")
EXPENSE_KINDS = ("会议费", "培训费", "招待费", "办公费", "通信费", "市内交通费", "餐费")
PURCHASE_CUES = ("采购", "购买", "买电脑", "买显示器", "买设备")
LEAVE_WORDS = ("请假", "年假", "病假", "婚假", "丧假", "事假", "调休", "产假", "陪产假", "育儿假", "工伤假")
GOODS, SERVICES = ("电脑", "显示器", "服务器", "设备", "用品", "商品", "硬件"), ("服务", "咨询", "外包", "订阅", "培训", "维修")
CATEGORIES = (("meeting", ("会议",)), ("training", ("培训", "课程")), ("business_entertainment", ("招待", "客户餐费")))
AMOUNT_LABELS, AMOUNT_NOUNS = ("总金额", "总价", "预算", "金额", "预计"), ("采购", "电脑", "设备", "服务")
QUOTE_COUNTS = (("一家", 1), ("一份", 1), ("两家", 2), ("二家", 2), ("两份", 2), ("二份", 2), ("三家", 3), ("三份", 3))


def application_type(t: Column) -> Column:
    """The type as the material check sees it; its cues differ from those of the approval route."""
    trip = has_any(t, ("差旅", "出差")) & (t.contains("报销") | has_any(t, TRAVEL_PAPERS))
    cost = t.contains("费用报销") | (t.contains("报销") & has_any(t, EXPENSE_KINDS))
    return F.when(trip, "travel_reimbursement").when(cost, "expense_reimbursement").when(has_any(t, PURCHASE_CUES), "purchase").when(has_any(t, LEAVE_WORDS), "leave")


def _items(*pairs: tuple[Column | bool, str, int]) -> Column:
    return F.array_compact(F.array(*[F.when(F.lit(c) if isinstance(c, bool) else c, F.struct(F.lit(m).alias("material"), F.lit(n).alias("required"))) for c, m, n in pairs]))


def purchase_requirements(amount: Column, it: Column, goods: Column, service: Column, emergency: Column) -> Column:
    a = F.coalesce(amount, F.lit(0))
    return _items(
        (it, "technical_requirement", 1),
        (it, "it_review_opinion", 1),
        (goods, "product_specification", 1),
        (~goods & service, "service_scope", 1),
        (emergency, "emergency_purchase_explanation", 1),
        (a > 200_000, "tender_document", 1),
        ((a > 50_000) & (a <= 200_000), "quotation", 3),
        ((a > 50_000) & (a <= 200_000), "comparison_record", 1),
        ((a > 5_000) & (a <= 50_000), "quotation", 2),
    )


def leave_requirements(kind: Column, days: Column) -> Column:
    sick = F.coalesce((kind == "sick") & (days > 1), F.lit(False)) | F.coalesce(kind == "work_injury", F.lit(False))
    return _items((sick, "medical_proof", 1), (F.coalesce(kind == "marriage", F.lit(False)), "marriage_registration_certificate", 1))


#: How a number of quotations is said, in order of precedence.
QUOTATIONS = (r"(\d+)\s*家(?:供应商)?(?:的)?(?:有效)?报价", r"(\d+)\s*份(?:供应商)?报价", r"(?:报价|报价单)(\d+)\s*份")


def quotation_count(t: Column) -> Column:
    """How many quotations a text speaks of; null if it doesn't say."""
    found = [F.regexp_extract(t, p, 1) for p in QUOTATIONS]
    digits = F.coalesce(*[F.when(x != "", x).cast("int") for x in found])
    words = None
    for token, n in QUOTE_COUNTS:
        hit = t.contains(token) & t.contains("报价")
        words = F.when(hit, n) if words is None else words.when(hit, n)
    return F.coalesce(digits, words)


def _claimed(t: Column, aliases: tuple[str, ...]) -> Column:
    """Whether some alias occurs, not within eight characters after a negation."""
    out = F.lit(False)
    for a in sorted(aliases, key=len, reverse=True):
        at = F.instr(t, a)
        before = F.when(at > 1, t.substr(F.greatest(at - 8, F.lit(1)), at - F.greatest(at - 8, F.lit(1)))).otherwise("")
        out = out | ((at > 0) & ~has_any(before, NEGATIVE))
    return out


def provided(t: Column) -> Column:
    """array of (material, n) that a text claims to have."""
    rows = []
    for name, aliases, *_ in MATERIALS:
        n = F.coalesce(quotation_count(t), F.lit(1)) if name == "quotation" else F.lit(1)
        rows.append(F.when(_claimed(t, aliases), F.struct(F.lit(name).alias("material"), n.cast("int").alias("n"))))
    return F.array_compact(F.array(*rows))


def check(requests: DataFrame, text: str = "text") -> DataFrame:
    """``requests`` with application_type, mode, required, provided, missing, complete (null when only
    requirements are asked for) and clarify (the fact that is needed first)."""
    t = F.col("__text")
    d = requests.withColumn("__text", strip(F.col(text))).withColumn("application_type", application_type(t)).withColumn("mode", F.when(has_any(t, COMPARISON), "comparison").otherwise("requirements"))
    d = d.withColumn("amount", N.money(t, AMOUNT_LABELS, AMOUNT_NOUNS, commas=False)).withColumn("leave_type", first_cue(t, LEAVE_CUES)).withColumn("leave_days", N.leave_days(t)).withColumn("category", first_cue(t, CATEGORIES))
    kind, none = F.col("application_type"), F.array().cast("array<struct<material:string,required:int>>")
    general = _items(*[(True, m, 1) for m in EXPENSE], *[(F.coalesce(F.col("category") == c, F.lit(False)), m, 1) for c, ms in BY_CATEGORY.items() for m in ms])
    need = F.when(kind == "travel_reimbursement", _items(*[(True, m, 1) for m in TRAVEL])).when(kind == "purchase", purchase_requirements(F.col("amount"), has_any(F.lower(t), IT_CUES), has_any(t, GOODS), has_any(t, SERVICES), t.contains("紧急"))).when(kind == "expense_reimbursement", general).when(kind == "leave", leave_requirements(F.col("leave_type"), F.col("leave_days"))).otherwise(none)
    d = d.withColumn("required", need).withColumn("provided", F.when(F.col("mode") == "comparison", provided(t)).otherwise(F.array().cast("array<struct<material:string,n:int>>")))
    first = F.when(kind.isNull(), "application_type").when((kind == "purchase") & F.col("amount").isNull(), "amount").when((kind == "leave") & F.col("leave_type").isNull(), "leave_type").when((kind == "leave") & (F.col("leave_type") == "sick") & F.col("leave_days").isNull(), "leave_days")
    mentions = has_any(t, [a for _, aliases, *_ in MATERIALS for a in aliases])
    silent = (F.col("mode") == "comparison") & kind.isNotNull() & (F.size("provided") == 0) & ~has_any(t, NOTHING) & ~mentions
    d = d.withColumn("clarify", F.coalesce(first, F.when(silent, "materials")))
    have = F.map_from_entries("provided")
    lacking = F.filter(F.transform("required", lambda r: F.struct(r["material"].alias("material"), F.greatest(r["required"] - F.coalesce(have[r["material"]], F.lit(0)), F.lit(0)).alias("lacking"))), lambda r: r["lacking"] > 0)
    judged = (F.col("mode") == "comparison") & F.col("clarify").isNull()
    d = d.withColumn("missing", F.when(judged, lacking).otherwise(F.array().cast("array<struct<material:string,lacking:int>>")))
    return d.withColumn("complete", F.when(judged, F.size("missing") == 0)).drop("__text")


def rules(spark) -> DataFrame:
    """The rules table: material, sensitive, document_id, article_label."""
    rows = F.array(*[F.struct(F.lit(m).alias("material"), F.lit(s).alias("sensitive"), F.lit(d).alias("document_id"), F.lit(a).alias("article_label")) for m, _, s, d, a in MATERIALS])
    return spark.range(1).select(F.inline(rows))


def missing_counts(required: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """key, material, lacking from tables of required (key, material, required) and given (key, material, n)."""
    have = given.groupBy(key, "material").agg(F.sum("n").alias("n"))
    j = required.join(have, [key, "material"], "left").withColumn("lacking", F.greatest(F.col("required") - F.coalesce("n", F.lit(0)), F.lit(0)))
    return j.where("lacking > 0").select(key, "material", F.col("lacking").cast("bigint"))


def distinct_requirements(rows: DataFrame, key: str) -> DataFrame:
    """One row for each material: its first position, and the larger count."""
    return rows.groupBy(key, "material").agg(F.min("position").alias("position"), F.max("required").alias("required"))


def without_article(references: DataFrame, articles: DataFrame) -> DataFrame:
    """References (document_id, article_label) that no article answers; must be empty."""
    return references.join(articles, ["document_id", "article_label"], "left_anti")
