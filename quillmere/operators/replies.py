"""Texts of rule results, and the request text that a draft's fields stand for.

Every text is one column: an array of optional lines joined by newlines, or of optional clauses
joined by commas. Names of levels, roles, materials and fields are literal maps.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from .materials import MATERIALS

#: Display names.
LEVELS = {
    "small_purchase": "小额采购",
    "general_purchase": "一般采购",
    "important_purchase": "重要采购",
    "major_purchase": "重大采购",
    "emergency_purchase": "紧急采购",
    "small_travel": "普通出差（5,000元及以下）",
    "general_travel": "普通出差（5,000元至20,000元）",
    "large_travel": "较大金额出差",
    "travel_reimbursement": "差旅报销审核",
    "small_expense": "小额费用报销",
    "general_expense": "一般费用报销",
    "large_expense": "较大费用报销",
    "major_expense": "大额费用报销",
    "short_leave": "短期请假",
    "medium_leave": "一般请假",
    "extended_leave": "较长请假",
    "long_term_leave": "长期请假",
    "department_head_leave": "部门负责人请假",
}
ROLES = {
    "DIRECT_MANAGER": "直属经理",
    "DEPARTMENT_HEAD": "部门负责人",
    "IT_DEPARTMENT": "信息技术部",
    "PROCUREMENT_DEPARTMENT": "采购管理部",
    "FINANCE_DEPARTMENT": "财务管理部",
    "HUMAN_RESOURCES": "人力资源部",
    "BUSINESS_VICE_PRESIDENT": "分管副总经理",
    "GENERAL_MANAGER": "总经理",
    "MANAGEMENT_COMMITTEE": "公司管理委员会",
}
ACTIONS = {"approve": "审批", "review": "复核", "technical_review": "技术评审", "confirm": "确认", "deliberate": "审议"}
TITLES = {"purchase": "采购申请草稿", "travel_reimbursement": "差旅报销草稿", "leave": "请假申请草稿", "expense_reimbursement": "费用报销草稿"}
LEAVE_TYPES = {"sick": "病假", "marriage": "婚假", "bereavement": "丧假", "parental": "育儿假", "work_injury": "工伤假", "annual": "年假", "compensatory": "调休", "personal": "事假"}
PURCHASE_KINDS = {"IT_EQUIPMENT": "IT设备", "SERVICE": "服务", "GOODS": "货物"}
EXPENSE_KINDS = {"BUSINESS_ENTERTAINMENT": "业务招待费", "MEETING": "会议费", "TRAINING": "培训费", "OFFICE": "办公费", "COMMUNICATION": "通信费", "LOCAL_TRANSPORTATION": "市内交通费"}
FIELDS = {
    "purchase": {"item_name": "采购事项", "quantity": "采购数量", "purpose": "采购目的和业务背景", "category": "采购类别", "specification": "规格、型号或服务范围", "estimated_unit_price": "预计单价", "estimated_total_amount": "预计总金额", "budget_or_cost_center": "预算编号或成本中心", "expected_delivery_date": "期望交付日期", "delivery_location": "使用地点", "supplier_name": "推荐供应商", "supplier_reason": "供应商推荐理由", "involves_it_or_data": "是否涉及信息系统或数据处理", "is_emergency": "是否属于紧急采购"},
    "travel_reimbursement": {"travel_application_id": "已审批出差申请编号", "departure_city": "出发地", "destination_city": "目的地", "start_date": "出差开始日期", "end_date": "出差结束日期", "business_purpose": "出差事由", "project_or_cost_center": "项目名称或成本中心", "total_reimbursement_amount": "报销总金额", "expense_details": "费用明细"},
    "leave": {"leave_type": "请假类型", "start_date": "请假开始日期", "end_date": "请假结束日期", "start_period": "开始时段", "end_period": "结束时段", "leave_days": "请假天数", "reason": "请假原因", "handover_person": "工作交接人", "emergency_contact": "紧急联系人", "is_emergency": "是否属于紧急请假"},
    "expense_reimbursement": {"expense_category": "费用类别", "amount": "报销金额", "business_purpose": "业务目的", "expense_date": "费用发生日期", "budget_or_cost_center": "预算编号或成本中心", "payee": "收款对象", "involves_contract": "是否涉及合同", "involves_purchase": "是否涉及采购"},
}
#: Questions for the fact that a result lacks.
APPROVAL_QUESTIONS = {
    "application_type": "请说明要判断哪类审批：采购、出差申请、差旅报销、普通费用报销还是请假。",
    "purchase": "请补充预计采购总金额（应包含税费、运输、安装、培训和维护等必要费用）。",
    "travel": "请补充本次出差的预计总费用。",
    "expense_reimbursement": "请补充本张费用报销单的总金额。",
    "leave": "请补充本次申请的请假工作日数。",
}
MATERIAL_QUESTIONS = {
    "application_type": "请说明要办理的事项：采购、差旅报销、普通费用报销还是请假。",
    "amount": "请补充预计采购总金额，以便确定报价数量和采购材料。",
    "leave_type": "请说明具体假期类型，例如年假、病假、婚假或调休。",
    "leave_days": "请补充连续请病假的工作日数。",
    "materials": "请列出你已经准备的材料，我才能逐项检查缺失内容。",
}


def _named(table: Mapping[str, object], key: Column) -> Column:
    """The entry of a literal map, null if there is none."""
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _names(table: Mapping[str, str], keys: Column) -> Column:
    return F.transform(keys, lambda k: _named(table, k))


def _lines(*parts: Column) -> Column:
    """Strings and arrays of strings as one array without nulls."""
    return F.array_compact(F.concat(*parts))


def _line(c: Column) -> Column:
    return F.array(c)


def _closing(df: DataFrame, notes: str, sources: str) -> tuple[Column, Column]:
    """The lines of notes, and the line of source ids; both columns are optional arrays."""
    none = F.array().cast("array<string>")
    said = F.transform(F.coalesce(F.col(notes), none), lambda n: F.concat(F.lit("提示："), n)) if notes in df.columns else none
    cited = F.coalesce(F.col(sources), none) if sources in df.columns else none
    marks = F.array_join(F.transform(cited, lambda s: F.concat(F.lit("["), s, F.lit("]"))), " ")
    return said, F.when(F.size(cited) > 0, F.concat(F.lit("制度依据："), marks))


def approval_reply(routes: DataFrame, notes: str = "notes", sources: str = "sources") -> DataFrame:
    """``routes`` (see ``approval.check``) with clarification and reply. Arrays ``notes`` and
    ``sources`` (ids of cited articles) are used where the input has them."""
    kind, missing = F.col("application_type"), F.col("missing")
    asked = F.when(missing.isNotNull(), _named(APPROVAL_QUESTIONS, F.when(missing == "application_type", missing).otherwise(kind)))
    step = lambda s: F.concat(s["sequence"].cast("string"), F.lit(". "), _named(ROLES, s["approver"]), F.lit("（"), _named(ACTIONS, s["action"]), F.lit("）"))
    level = F.concat(F.lit("审批层级："), _named(LEVELS, F.col("level")), F.lit("。"))
    amount = F.concat(F.lit("规则计算金额："), N.plain_decimal(F.col("amount")), F.lit("元。"))
    days = F.concat(F.lit("规则计算请假天数："), N.plain_decimal(F.col("leave_days")), F.lit("个工作日。"))
    route = _lines(_line(level), _line(amount), _line(days), _line(F.lit("审批路线：")), F.transform("steps", step))
    question = F.array(F.lit("还需要补充信息后才能准确判断审批路线。"), F.col("clarification"))
    conditions = F.when(F.size("conditions") > 0, F.concat(F.lit("触发条件："), F.array_join("conditions", "；"), F.lit("。")))
    said, cited = _closing(routes, notes, sources)
    body = F.when(F.col("clarification").isNull(), route).otherwise(question)
    return routes.withColumn("clarification", asked).withColumn("reply", F.array_join(_lines(body, _line(conditions), said, _line(cited)), "\n"))


def _material_lines(items: Column, count: str, phrase: str) -> Column:
    """Numbered names with a count above one and a mark for sensitive papers."""
    names, sensitive = {m[0]: m[1][0] for m in MATERIALS}, {m[0]: m[2] for m in MATERIALS}

    def line(r: Column, i: Column) -> Column:
        many = F.when(r[count] > 1, F.concat(F.lit(f"（{phrase}"), r[count].cast("string"), F.lit("份）"))).otherwise("")
        secret = F.when(_named(sensitive, r["material"]), "（敏感材料）").otherwise("")
        return F.concat((i + 1).cast("string"), F.lit(". "), _named(names, r["material"]), many, secret)

    return F.transform(items, line)


def material_reply(checks: DataFrame, notes: str = "notes", sources: str = "sources") -> DataFrame:
    """``checks`` (see ``materials.check``) with clarification and reply; notes and sources as in ``approval_reply``."""
    need, lack = _material_lines(F.col("required"), "required", "至少"), _material_lines(F.col("missing"), "lacking", "还缺")
    listed = F.when(F.size("required") > 0, F.concat(F.array(F.lit("需要准备的材料如下：")), need)).otherwise(F.array(F.lit("现有制度没有列出固定的必交证明附件。")))
    judged = F.when(F.col("complete").isNull(), F.array(F.lit("还需要补充信息后才能完成精确材料检查。"))).when(F.col("complete"), F.array(F.lit("按当前提供的信息，必需材料已齐全。")))
    judged = judged.otherwise(F.concat(F.array(F.lit("按当前提供的信息，材料尚未齐全，还缺：")), lack))
    said, cited = _closing(checks, notes, sources)
    body = F.when(F.col("mode") == "requirements", listed).otherwise(judged)
    text = F.array_join(_lines(body, said, _line(F.col("clarification")), _line(cited)), "\n")
    asked = checks.withColumn("clarification", _named(MATERIAL_QUESTIONS, F.col("clarify")))
    return asked.withColumn("reply", F.when(F.col("application_type").isNull(), F.coalesce("clarification", F.lit("请补充办理事项。"))).otherwise(text))


def draft_reply(drafts: DataFrame, sources: str = "sources", hidden: tuple[str, ...] = ("emergency_contact",)) -> DataFrame:
    """``drafts`` (see ``requests.drafts``) with title, summary (lines), clarification and reply. Values
    of ``hidden`` fields stay out of the summary."""
    kind = F.col("application_type")
    title, summary, lacking = _named(TITLES, kind), None, None
    for name, labels in FIELDS.items():
        shown = F.array(*[F.concat(F.lit(f"{label}："), _shown(F.col("fields")[f])) for f, label in labels.items() if f not in hidden])
        names = _names(labels, F.col("missing_fields"))
        summary = F.when(kind == name, shown) if summary is None else summary.when(kind == name, shown)
        lacking = F.when(kind == name, names) if lacking is None else lacking.when(kind == name, names)
    gaps = F.array_join(lacking, "、")
    waits = F.when(F.size("missing_fields") > 0, F.concat(F.lit("待补字段："), gaps))
    d = drafts.withColumn("title", title).withColumn("summary", F.when(kind.isNotNull(), _lines(_line(F.concat(F.lit("草稿类型："), F.col("title"))), summary, _line(waits))))
    asked = F.when(kind.isNull(), "请说明要生成哪类草稿：采购、差旅报销、普通费用报销还是请假。").when((F.size("issues") == 0) & (F.size("missing_fields") > 0), F.concat(F.lit("请补充以下必填信息："), gaps, F.lit("。")))
    ready = F.when(F.col("status") == "waiting_for_confirmation", F.concat(F.lit("已生成"), F.col("title"), F.lit("，内容已具备人工核对条件。")))
    opening = F.coalesce(ready, F.concat(F.lit("已生成"), F.col("title"), F.lit("的部分草稿，但还不能进入确认环节。")))
    _, cited = _closing(drafts, "", sources)
    lines = _lines(_line(opening), F.col("summary"), _line(F.col("clarification")), _line(F.lit("安全状态：未确认、未提交；当前版本不会自动发起审批。")), _line(cited))
    return d.withColumn("clarification", asked).withColumn("reply", F.when(kind.isNull(), F.col("clarification")).otherwise(F.array_join(lines, "\n")))


def _shown(v: Column) -> Column:
    """A field's value as read by people: truth values as words, amounts with separators."""
    amount = F.when(v.rlike(r"^\d+\.\d+$"), N.plain_decimal(v.cast(N.MONEY)))
    return F.when(v == "true", "是").when(v == "false", "否").otherwise(F.coalesce(amount, v))


# --- the request that a draft stands for -------------------------------------------------------


def _told(f: Column, *labels: tuple[str, str]) -> list[Column]:
    return [F.concat(F.lit(f"{label}为"), _shown(f[name])) for name, label in labels]


def _either(v: Column, yes: str, no: str) -> Column:
    return F.when(v == "true", yes).when(v == "false", no)


def _request(kind: str, f: Column) -> list[Column]:
    if kind == "purchase":
        unit = F.coalesce(f["unit"], F.lit("件"))
        price, total = f["estimated_unit_price"].cast(N.MONEY), f["estimated_total_amount"].cast(N.MONEY)
        follows = F.coalesce(total == (price * f["quantity"].cast("int")).cast(N.MONEY), F.lit(False))
        return [
            F.concat(F.lit("采购"), f["quantity"], unit, f["item_name"]),
            F.concat(F.lit("每"), unit, _shown(f["estimated_unit_price"]), F.lit("元")),
            F.when(~follows, F.concat(F.lit("预计总金额为"), _shown(f["estimated_total_amount"]), F.lit("元"))),
            *_told(f, ("purpose", "采购目的")),
            F.concat(F.lit("采购类别为"), F.coalesce(_named(PURCHASE_KINDS, f["category"]), f["category"])),
            *_told(f, ("specification", "规格"), ("budget_or_cost_center", "预算编号"), ("expected_delivery_date", "交付日期"), ("delivery_location", "使用地点"), ("supplier_name", "推荐供应商"), ("supplier_reason", "推荐理由")),
            _either(f["involves_it_or_data"], "涉及信息系统或数据处理", "不涉及信息系统，不涉及数据处理"),
            _either(f["is_emergency"], "紧急采购", "普通采购"),
        ]
    if kind == "travel_reimbursement":
        amount = F.concat(F.lit("报销总金额为"), _shown(f["total_reimbursement_amount"]), F.lit("元"))
        places = _told(f, ("travel_application_id", "出差申请编号"), ("departure_city", "出发地"), ("destination_city", "目的地"), ("start_date", "开始日期"), ("end_date", "结束日期"), ("business_purpose", "出差事由"), ("project_or_cost_center", "项目名称"))
        return [*places, amount, *_told(f, ("expense_details", "费用明细"))]
    if kind == "leave":
        name = F.coalesce(_named(LEAVE_TYPES, f["leave_type"]), f["leave_type"])
        whole = F.coalesce((f["start_period"] == "FULL_DAY") & (f["end_period"] == "FULL_DAY"), F.lit(False))
        periods = [F.when(~whole, c) for c in _told(f, ("start_period", "开始时段"), ("end_period", "结束时段"))]
        days = N.plain_decimal(f["leave_days"].cast(N.MONEY))
        return [F.coalesce(F.concat(F.lit("请"), days, F.lit("天"), name), name), *_told(f, ("start_date", "开始日期"), ("end_date", "结束日期")), F.when(whole, "全天"), *periods, *_told(f, ("reason", "请假原因"), ("handover_person", "交接人"), ("emergency_contact", "紧急联系人")), _either(f["is_emergency"], "紧急请假", "普通请假")]
    return [
        F.concat(F.lit("费用类别为"), F.coalesce(_named(EXPENSE_KINDS, f["expense_category"]), f["expense_category"])),
        F.concat(F.lit("报销金额为"), _shown(f["amount"]), F.lit("元")),
        *_told(f, ("business_purpose", "业务目的"), ("expense_date", "发生日期"), ("budget_or_cost_center", "预算编号"), ("payee", "收款对象")),
        _either(f["involves_contract"], "涉及合同", "不涉及合同"),
        _either(f["involves_purchase"], "涉及采购", "不涉及采购"),
    ]


def request_text(kind: Column, fields: Column) -> Column:
    """A request whose draft has these fields. A purchase total that follows from quantity and price is
    left out, as a draft computes it. Null where the type is unknown."""
    out = None
    for name, title in TITLES.items():
        text = F.concat(F.array_join(F.array_compact(F.array(F.lit(f"帮我生成{title}"), *_request(name, fields))), "，"), F.lit("。"))
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return out


def revision_fields(c: Column) -> Column:
    """Map of quantity, unit and item_name that a short revision of a purchase sets."""
    set_to = r"\s*(?:修改|更改|调整|变更|改)?(?:成|为|到|是|：|:)?\s*"
    amount = rf"数量{set_to}(\d+|[一二两三四五六七八九十]+)\s*(台|个|套|件|份)?"
    n = N.small_number(F.regexp_extract(c, amount, 1))
    whole = F.when(n == F.floor(n), n.cast("int").cast("string"))
    unit = F.when(whole.isNotNull(), F.nullif(F.regexp_extract(c, amount, 2), F.lit("")))
    item = F.nullif(F.trim(F.regexp_extract(c, rf"(?:采购事项|采购物品|物品名称|商品名称){set_to}([^，,；;。\n]+)", 1)), F.lit(""))
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("quantity", whole), ("unit", unit), ("item_name", item))])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def revised_request(kind: Column, fields: Column, context: Column) -> Column:
    """The request of the fields, followed by the earlier messages (array) that supplement it."""
    said = F.filter(F.transform(context, lambda m: F.trim(m)), lambda m: m != "")
    return F.concat(request_text(kind, fields), F.when(F.size(said) > 0, F.concat(F.lit("\n历史补充记录：\n"), F.array_join(said, "\n"))).otherwise(""))
