"""Approval routes as columns: request features, level, ordered steps, conditions.

A route is an array of optional steps in positional order, with the absent ones compacted away;
an inserted step therefore has its place in the array from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.text import has_any, strip

#: The cues of each application type, in order of precedence, and of request features.
TYPE_CUES = (
    ("travel", ("差旅", "出差")),
    ("expense_reimbursement", ("费用报销", "办公费报销", "会议费报销", "培训费报销", "招待费报销", "通信费报销", "市内交通费报销")),
    ("purchase", ("采购", "购买", "购置", "买电脑", "买显示器", "买设备")),
    ("leave", ("请假", "年假", "年休假", "病假", "婚假", "丧假", "事假", "调休", "产假", "陪产假", "育儿假", "工伤假")),
)
LEAVE_CUES = (
    ("sick", ("病假",)),
    ("marriage", ("婚假",)),
    ("bereavement", ("丧假",)),
    ("parental", ("产假", "陪产假", "育儿假")),
    ("work_injury", ("工伤假", "工伤休假")),
    ("annual", ("年假", "年休假")),
    ("compensatory", ("调休",)),
    ("personal", ("事假",)),
)
IT_CUES = ("电脑", "显示器", "服务器", "软件", "系统", "云服务", "数据服务", "网络设备", "计算机", "it设备", "it采购")
AMOUNT_LABELS = ("预计总金额", "预计总费用", "报销金额", "费用金额", "总金额", "总费用", "总价", "预算", "金额", "预计")
AMOUNT_NOUNS = ("采购", "电脑", "设备", "服务", "出差", "差旅", "报销", "费用", "业务招待", "招待费", "培训费")
EXPENSE_SPECIAL = (
    (("无发票", "没有发票", "无法取得发票"), "无发票费用"),
    (("业务招待", "招待费", "客户招待"), "业务招待费"),
    (("超时报销", "超过报销时限", "逾期报销"), "超过报销时限"),
    (("费用类型难以判断", "费用类型不明"), "费用类型难以判断"),
    (("付款人和报销人不一致", "他人代付", "代付"), "付款人与报销人不一致"),
    (("个人敏感信息", "敏感信息"), "涉及个人敏感信息"),
    (("高风险费用", "高风险"), "财务系统识别为高风险"),
)
PREAPPROVAL_CUES = ("业务招待", "招待费", "外部培训", "会议场地", "大额办公支出", "软件订阅", "市场活动", "咨询服务", "专业服务")
OVER_STANDARD, OVERSEAS, ADVANCE = ("超出标准", "超过标准", "超标"), ("境外", "国外", "海外", "港澳台", "香港", "澳门", "台湾"), ("预借差旅备用金", "差旅备用金", "预借备用金")
HEAD_CUES, DISPUTE, CONFLICT = ("我是部门负责人", "部门负责人请假", "部门负责人申请"), ("争议", "有误", "不一致"), ("矛盾", "冲突", "不一致")
#: Condition texts.
COND_IT, COND_EMERGENCY, COND_COMMITTEE = "涉及信息技术类采购", "紧急采购", "需提交公司管理委员会审议"
COND_TRAVEL = ("预计总费用超过30,000元", "出差时间超过15个自然日", "交通工具或住宿超出制度标准", "前往境外或港澳台地区", "需要预借差旅备用金")
COND_LEAVE = ("单次请假超过3个工作日", "连续病假超过1个工作日", "申请特殊假期", "假期余额存在争议", "请假材料存在明显矛盾")
COND_TRAVEL_REIMBURSEMENT, COND_PREAPPROVAL = "差旅报销审核", "该费用原则上需要事前审批"


def first_cue(text: Column, table) -> Column:
    """The name of the first entry whose cues occur."""
    out = None
    for name, cues in table:
        out = F.when(has_any(text, cues), name) if out is None else out.when(has_any(text, cues), name)
    return out


def request(text: Column) -> dict[str, Column]:
    """The features of a request that its route depends on."""
    kind, days = first_cue(text, TYPE_CUES), N.days(text)
    return {
        "application_type": kind,
        "amount": N.money(text, AMOUNT_LABELS, AMOUNT_NOUNS, commas=True),
        "leave_days": F.when(kind == "leave", days),
        "travel_days": F.when(kind == "travel", days),
        "is_it": has_any(F.lower(text), IT_CUES),
        "is_emergency": F.coalesce(kind == "purchase", F.lit(False)) & text.contains("紧急"),
        "is_major": text.contains("重大项目"),
        "is_reimbursement": F.coalesce(kind == "travel", F.lit(False)) & text.contains("报销"),
        "over_standard": has_any(text, OVER_STANDARD),
        "overseas": has_any(text, OVERSEAS),
        "advance": has_any(text, ADVANCE),
        "expense_special": _present(*[(has_any(text, cues), d) for cues, d in EXPENSE_SPECIAL]),
        "preapproval": has_any(text, PREAPPROVAL_CUES),
        "leave_type": first_cue(text, LEAVE_CUES),
        "is_head": has_any(text, HEAD_CUES),
        "balance_disputed": text.contains("余额") & has_any(text, DISPUTE),
        "materials_conflict": text.contains("材料") & has_any(text, CONFLICT),
    }


FEATURES = ("application_type", "amount", "leave_days", "travel_days", "is_it", "is_emergency", "is_major", "is_reimbursement", "over_standard", "overseas", "advance", "expense_special", "preapproval", "leave_type", "is_head", "balance_disputed", "materials_conflict")


def _present(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in pairs])) if pairs else F.array().cast("array<string>")


def _route(*steps: tuple[Column | bool, str, str | Column]) -> Column:
    rows = [F.when(F.lit(c) if isinstance(c, bool) else c, F.struct(F.lit(who).alias("approver"), (F.lit(a) if isinstance(a, str) else a).alias("action"))) for c, who, a in steps]
    return F.array_compact(F.array(*rows))


def purchase(amount: Column, it: Column, emergency: Column, major: Column) -> tuple[Column, Column, Column]:
    committee = (amount > 1_000_000) | major
    level = F.when(emergency, "emergency_purchase").when(amount <= 5_000, "small_purchase").when(amount <= 50_000, "general_purchase").when(amount <= 200_000, "important_purchase").otherwise("major_purchase")
    normal = _route(
        (True, "DIRECT_MANAGER", "approve"),
        (amount > 5_000, "DEPARTMENT_HEAD", "approve"),
        (it, "IT_DEPARTMENT", "technical_review"),
        (amount > 5_000, "PROCUREMENT_DEPARTMENT", "approve"),
        (amount > 50_000, "FINANCE_DEPARTMENT", "approve"),
        (amount > 50_000, "BUSINESS_VICE_PRESIDENT", "approve"),
        (amount > 200_000, "GENERAL_MANAGER", "approve"),
        (committee, "MANAGEMENT_COMMITTEE", "deliberate"),
    )
    urgent = _route(
        (True, "DEPARTMENT_HEAD", "approve"),
        (it, "IT_DEPARTMENT", "technical_review"),
        (True, "PROCUREMENT_DEPARTMENT", "confirm"),
        (True, "FINANCE_DEPARTMENT", "confirm"),
        (amount > 50_000, "BUSINESS_VICE_PRESIDENT", "approve"),
        (amount > 200_000, "GENERAL_MANAGER", "approve"),
        (committee, "MANAGEMENT_COMMITTEE", "deliberate"),
    )
    conditions = _present((emergency, COND_EMERGENCY), (it, COND_IT), (~emergency & committee, COND_COMMITTEE))
    return level, F.when(emergency, urgent).otherwise(normal), conditions


def travel(amount: Column, days: Column, over: Column, overseas: Column, advance: Column, reimbursement: Column) -> tuple[Column, Column, Column]:
    special = (amount > 30_000, F.coalesce(days > 15, F.lit(False)), over, overseas, advance)
    finance = special[0] | special[1] | special[2] | special[3] | special[4]
    level = F.when(reimbursement, "travel_reimbursement").when(amount <= 5_000, "small_travel").when(amount <= 20_000, "general_travel").otherwise("large_travel")
    route = _route((True, "DIRECT_MANAGER", "approve"), (amount > 5_000, "DEPARTMENT_HEAD", "approve"), (finance, "FINANCE_DEPARTMENT", "review"), (amount > 20_000, "BUSINESS_VICE_PRESIDENT", "approve"))
    repaid = _route((True, "DIRECT_MANAGER", "approve"), (True, "DEPARTMENT_HEAD", "approve"), (True, "FINANCE_DEPARTMENT", "review"))
    return level, F.when(reimbursement, repaid).otherwise(route), F.when(reimbursement, F.array(F.lit(COND_TRAVEL_REIMBURSEMENT))).otherwise(_present(*zip(special, COND_TRAVEL, strict=True)))


def expense(amount: Column, special: Column, preapproval: Column) -> tuple[Column, Column, Column]:
    level = F.when(amount <= 1_000, "small_expense").when(amount <= 5_000, "general_expense").when(amount <= 20_000, "large_expense").otherwise("major_expense")
    route = _route(
        (True, "DIRECT_MANAGER", "approve"),
        (amount > 1_000, "DEPARTMENT_HEAD", "approve"),
        (True, "FINANCE_DEPARTMENT", F.when(amount <= 5_000, "review").otherwise("approve")),
        (amount > 20_000, "BUSINESS_VICE_PRESIDENT", "approve"),
        (amount > 100_000, "GENERAL_MANAGER", "approve"),
    )
    return level, route, F.array_distinct(F.concat(special, _present((preapproval, COND_PREAPPROVAL))))


def leave(days: Column, kind: Column, head: Column, disputed: Column, conflict: Column) -> tuple[Column, Column, Column]:
    sick = F.coalesce((kind == "sick") & (days > 1), F.lit(False))
    rare = F.coalesce(kind.isin("marriage", "bereavement", "parental", "work_injury"), F.lit(False))
    reasons = (days > 3, sick, rare, disputed, conflict)
    hr = reasons[0] | sick | rare | disputed | conflict
    level = F.when(head, "department_head_leave").when(days <= 1, "short_leave").when(days <= 3, "medium_leave").when(days <= 5, "extended_leave").otherwise("long_term_leave")
    normal = _route(
        (True, "DIRECT_MANAGER", "approve"),
        (days > 1, "DEPARTMENT_HEAD", "approve"),
        (hr, "HUMAN_RESOURCES", "review"),
        (days > 5, "BUSINESS_VICE_PRESIDENT", "approve"),
        (days > 15, "GENERAL_MANAGER", "approve"),
    )
    heads = _route((hr, "HUMAN_RESOURCES", "review"), (True, "BUSINESS_VICE_PRESIDENT", "approve"), (days > 15, "GENERAL_MANAGER", "approve"))
    return level, F.when(head, heads).otherwise(normal), _present(*zip(reasons, COND_LEAVE, strict=True))


def decide(df: DataFrame) -> DataFrame:
    """``df`` with the columns of FEATURES -> level, steps (sequence, approver, action), conditions and
    missing: the fact (type, amount or days) without which no route exists."""
    c = {n: F.col(n) for n in FEATURES}
    none = F.array().cast("array<string>")
    routes = {
        "purchase": purchase(c["amount"], c["is_it"], c["is_emergency"], c["is_major"]),
        "travel": travel(c["amount"], c["travel_days"], c["over_standard"], c["overseas"], c["advance"], c["is_reimbursement"]),
        "expense_reimbursement": expense(c["amount"], c["expense_special"], c["preapproval"]),
        "leave": leave(c["leave_days"], c["leave_type"], c["is_head"], c["balance_disputed"], c["materials_conflict"]),
    }
    kind = c["application_type"]
    missing = F.when(kind.isNull(), "application_type").when((kind == "leave") & c["leave_days"].isNull(), "leave_days").when((kind != "leave") & c["amount"].isNull() & ~c["is_reimbursement"], "amount")
    d = df.withColumn("missing", missing)
    known = F.col("missing").isNull()
    pick = lambda i: F.coalesce(*[F.when(known & (kind == k), r[i]) for k, r in routes.items()])
    early = F.when((kind == "purchase") & c["is_it"], F.array(F.lit(COND_IT))).when(kind == "expense_reimbursement", c["expense_special"]).otherwise(none)
    d = d.withColumn("level", pick(0)).withColumn("__s", pick(1)).withColumn("conditions", F.when(known, F.coalesce(pick(2), none)).otherwise(early))
    numbered = F.transform("__s", lambda s, i: F.struct((i + 1).alias("sequence"), s["approver"].alias("approver"), s["action"].alias("action")))
    return d.withColumn("steps", F.coalesce(numbered, F.array().cast("array<struct<sequence:int,approver:string,action:string>>"))).drop("__s")


def check(requests: DataFrame, text: str = "text") -> DataFrame:
    """The route of free-text requests."""
    f = request(F.col("__text"))
    return decide(requests.withColumn("__text", strip(F.col(text))).select("*", *[f[n].alias(n) for n in FEATURES]).drop("__text"))
