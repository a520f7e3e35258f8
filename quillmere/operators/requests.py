"""Intent, application drafts, draft state and idempotent submission."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..session import cut
from . import approval
from .safety import command

#: Cues of each intent in order of precedence.
DRAFT = ("生成采购申请", "生成差旅报销", "生成费用报销", "生成请假申请", "生成申请草稿", "填写采购申请", "填写报销申请", "填写请假申请", "创建申请草稿", "新建申请草稿")
DRAFT_VERBS = ("生成", "填写", "创建", "新建")
INTENTS = (
    ("material_check", ("哪些材料", "什么材料", "材料齐全", "缺什么材料", "还缺什么", "需要发票", "需要证明", "附件要求")),
    ("approval_query", ("谁审批", "谁批准", "谁批", "走什么审批", "哪些审批", "审批流程", "审核流程", "要经过", "怎么审批")),
    ("policy_query", ("制度", "规定", "标准", "上限", "时限", "额度", "差旅", "出差", "采购", "报销", "请假", "年假", "病假", "信息安全", "公司数据", "公共大模型")),
)
#: Commands and cues of a turn on a draft.
CONFIRM = ("确认", "确认草稿", "确认无误", "我确认", "同意")
SUBMIT = ("提交", "提交审批", "提交申请", "正式提交", "确认提交", "确认提交审批")
CANCEL = ("取消", "取消草稿", "放弃草稿", "撤销草稿")
UPDATE = ("修改", "更改", "调整", "改成", "改为", "补充", "更新草稿")
STANDALONE = ("哪些材料", "什么材料", "材料要求", "谁审批", "谁批", "审批流程", "走什么审批", "制度", "规定", "标准", "额度", "生成新的", "新建")
#: Draft types in order of precedence, and the prefixes of their ids.
TYPES = (
    ("travel_reimbursement", ("差旅报销", "出差报销")),
    ("expense_reimbursement", ("费用报销", "办公费报销", "会议费报销", "培训费报销", "招待费报销", "通信费报销", "市内交通费报销")),
    ("purchase", ("采购", "购买", "购置", "买电脑", "买显示器", "买设备")),
    ("leave", ("请假", "年假", "病假", "婚假", "丧假", "事假", "调休", "产假", "陪产假", "育儿假", "工伤假")),
)
EXPENSE_CATEGORIES = (
    ("BUSINESS_ENTERTAINMENT", ("业务招待", "招待费", "客户餐费")),
    ("MEETING", ("会议费", "会议费用")),
    ("TRAINING", ("培训费", "培训费用", "课程费")),
    ("OFFICE", ("办公费", "办公费用")),
    ("COMMUNICATION", ("通信费", "网络费")),
    ("LOCAL_TRANSPORTATION", ("市内交通费", "打车费", "出租车费")),
)
#: An item with its count in either order, its price, and a pair of cities.
COUNTED = r"(?:采购|购买|购置|买)\s*(\d+|[一二两三四五六七八九十]+)\s*(台|个|套|件|份)\s*([^，,；;。\n]{1,40})"
NAMED = r"(?:采购|购买|购置|买)\s*([^，,；;。\n]{1,30}?)\s*(\d+|[一二两三四五六七八九十]+)\s*(台|个|套|件|份)"
PRICES = (r"每(?:台|个|套|件|份)?(?:单价)?\s*(?:是|为|：|:)?\s*([\d,]+(?:\.\d+)?)\s*(万元|万|元|块)", r"(?:预计单价|单价)(?:\s*(?:是|为|：|:))?\s*([\d,]+(?:\.\d+)?)\s*(万元|万|元|块)")
DATE = r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{4}年\d{1,2}月\d{1,2}日"
AMOUNT = r"([\d,]+(?:\.\d+)?)\s*(万元|万|元|块)"
ITEM_ENDS = "：:，,；;。.!！?？\"'“”‘’"
CITIES = r"从([一-龥]{2,12})(?:出发)?(?:到|前往)([一-龥]{2,12})(?:出差|差旅)"
PREFIX = {"travel_reimbursement": "TRAVEL-RMB", "expense_reimbursement": "EXPENSE", "purchase": "PURCHASE", "leave": "LEAVE"}


def intent(c: Column) -> Column:
    """Draft before material before approval before policy; else unknown."""
    t = T.strip(c)
    out = F.when((t.contains("草稿") & T.has_any(t, DRAFT_VERBS)) | T.has_any(t, DRAFT), "draft_generation")
    for name, cues in INTENTS:
        out = out.when(T.has_any(t, cues), name)
    return out.otherwise("unknown")


def intent_from_json(c: Column, allowed: tuple[str, ...], least: float = 0.6) -> Column:
    """The intent of a model's JSON answer (perhaps fenced); unknown if it is malformed, reserved or unsure."""
    j = F.from_json(T.json_body(c), "intent string, confidence double")
    ok = j["intent"].isin(*allowed) & (j["confidence"] >= least) & (j["confidence"] <= 1)
    return F.when(F.coalesce(ok, F.lit(False)), j["intent"]).otherwise("unknown")


def _labelled_date(c: Column, labels: tuple[str, ...]) -> Column:
    raw = F.regexp_extract(c, rf"(?:{'|'.join(labels)})(?:\s*(?:是|为|：|:))?\s*({DATE})", 1)
    return F.get(N.dates(raw), F.lit(0))


def _labelled_money(c: Column, labels: tuple[str, ...]) -> Column:
    p = rf"(?:{'|'.join(labels)})(?:\s*(?:是|为|：|:|约))?\s*{AMOUNT}"
    raw, unit = F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)
    v = F.when(raw != "", F.regexp_replace(raw, ",", "")).cast(N.WIDE)
    return F.when(unit.isin("万", "万元"), v * 10000).otherwise(v).cast(N.MONEY)


def _flag(no: Column, yes: Column) -> Column:
    return F.when(no, False).when(yes, True)


def _about(t: Column, subject: str) -> Column:
    return _flag(T.has_any(t, (f"不涉及{subject}", f"没有{subject}", f"无{subject}")), t.contains(f"涉及{subject}"))


def draft_fields(c: Column) -> dict[str, dict[str, Column]]:
    """For each type the fields of a draft in order; a group of alternatives shares one requirement.
    ``c`` is read many times, so it should be a column that is stripped already."""
    t = c
    label, code, text = T.labelled_value, T.labelled_code, lambda col: col.cast("string")
    first = t.rlike(COUNTED)
    item = F.btrim(T.strip(F.when(first, F.regexp_extract(t, COUNTED, 3)).otherwise(F.regexp_extract(t, NAMED, 1))), F.lit(ITEM_ENDS))
    count = N.small_number(F.when(first, F.regexp_extract(t, COUNTED, 1)).otherwise(F.regexp_extract(t, NAMED, 2)))
    count = F.when(count == F.floor(count), count.cast("int"))
    prices = [F.when(F.regexp_extract(t, p, 1) != "", F.regexp_replace(F.regexp_extract(t, p, 1), ",", "").cast(N.WIDE) * F.when(F.regexp_extract(t, p, 2).isin("万", "万元"), 10000).otherwise(1)) for p in PRICES]
    price = F.coalesce(*prices).cast(N.MONEY)
    total = F.coalesce(_labelled_money(t, ("预计总金额", "采购总金额", "总金额", "总价", "预算金额")), (price * count).cast(N.MONEY))
    it = T.has_any(F.lower(t), approval.IT_CUES)
    category = F.when(it, "IT_EQUIPMENT").when(T.has_any(t, ("服务", "咨询", "外包", "订阅", "培训", "维修")), "SERVICE").when(T.has_any(t, ("设备", "用品", "商品", "硬件", "耗材")), "GOODS").otherwise(label(t, ("采购类别", "类别")))
    uses_it = F.when(it, True).when(T.has_any(t, ("不涉及信息系统", "不涉及数据处理", "非IT采购")), False).when(T.has_any(t, ("涉及信息系统", "涉及数据处理", "涉及公司数据")), True)
    found, request = N.dates(t), approval.request(t)
    start = lambda ls: F.coalesce(_labelled_date(t, ls), F.get(found, F.lit(0)))
    end = lambda ls: F.coalesce(_labelled_date(t, ls), F.get(found, F.lit(1)))
    leave_from, leave_to = label(t, ("出发城市", "出发地")), label(t, ("目的城市", "目的地"))
    by_pair = leave_from.isNull() & leave_to.isNull()
    city = lambda own, g: F.when(by_pair, F.nullif(F.regexp_extract(t, CITIES, g), F.lit(""))).otherwise(own)
    whole = T.has_any(t, ("全天", "整天"))
    budget = F.coalesce(code(t, ("预算编号", "预算代码")), code(t, ("成本中心",)))
    return {
        "purchase": {"item_name": F.nullif(item, F.lit("")), "quantity": text(count), "purpose": label(t, ("采购目的", "业务背景", "用途", "用于")), "category": category, "specification": label(t, ("规格型号", "技术规格", "规格", "型号", "服务范围")), "estimated_unit_price": text(price), "estimated_total_amount": text(total), "budget_or_cost_center": budget, "expected_delivery_date": text(_labelled_date(t, ("期望交付日期", "预计交付日期", "交付日期"))), "delivery_location": label(t, ("使用地点", "交付地点", "使用位置")), "supplier_name": label(t, ("推荐供应商", "供应商名称", "供应商")), "supplier_reason": label(t, ("推荐理由", "供应商理由")), "involves_it_or_data": text(uses_it), "is_emergency": text(_flag(T.has_any(t, ("非紧急采购", "不属于紧急采购", "普通采购")), t.contains("紧急采购")))},
        "travel_reimbursement": {"travel_application_id": code(t, ("出差申请编号", "出差申请单号", "差旅申请编号")), "departure_city": city(leave_from, 1), "destination_city": city(leave_to, 2), "start_date": text(start(("出差开始日期", "开始日期"))), "end_date": text(end(("出差结束日期", "结束日期"))), "business_purpose": label(t, ("出差事由", "出差目的", "业务目的", "事由")), "project_or_cost_center": F.coalesce(label(t, ("项目名称", "所属项目")), code(t, ("成本中心",))), "total_reimbursement_amount": text(F.coalesce(request["amount"], _labelled_money(t, ("报销总金额", "总报销金额", "报销金额", "总金额")))), "expense_details": label(t, ("费用明细", "报销明细"))},
        "leave": {"leave_type": request["leave_type"], "start_date": text(start(("请假开始日期", "开始日期"))), "end_date": text(end(("请假结束日期", "结束日期"))), "start_period": F.when(whole, "FULL_DAY").otherwise(label(t, ("开始时段", "开始时间"))), "end_period": F.when(whole, "FULL_DAY").otherwise(label(t, ("结束时段", "结束时间"))), "leave_days": text(request["leave_days"]), "reason": label(t, ("请假原因", "原因", "事由")), "handover_person": label(t, ("工作交接人", "交接人", "代办人")), "emergency_contact": label(t, ("紧急联系人",)), "is_emergency": text(_flag(T.has_any(t, ("非紧急请假", "不是紧急请假", "普通请假")), t.contains("紧急请假")))},
        "expense_reimbursement": {"expense_category": F.coalesce(approval.first_cue(t, EXPENSE_CATEGORIES), label(t, ("费用类别", "报销类别"))), "amount": text(F.coalesce(request["amount"], _labelled_money(t, ("报销总金额", "费用金额", "报销金额", "总金额")))), "business_purpose": label(t, ("业务目的", "业务事由", "费用用途", "用途")), "expense_date": text(_labelled_date(t, ("费用发生日期", "发生日期", "消费日期"))), "budget_or_cost_center": budget, "payee": label(t, ("收款对象", "收款方", "商户", "供应商")), "involves_contract": text(_about(t, "合同")), "involves_purchase": text(_about(t, "采购"))},
    }


def drafts(requests: DataFrame, text: str = "text", employee: str = "employee_id", session: str = "session_id") -> DataFrame:
    """``requests`` with application_type, draft_id, idempotency_key, fields (map of found values),
    missing_fields (in order), blocking issues, and status."""
    requests = requests.withColumn("__text", T.strip(F.col(text)))
    t = F.col("__text")
    kind = approval.first_cue(t, TYPES)
    digest = F.upper(F.sha2(F.concat_ws("\0", kind, F.col(employee), F.col(session), t), 256))
    prefix = F.create_map(*[F.lit(x) for kv in PREFIX.items() for x in kv])[kind]
    d = requests.withColumn("application_type", kind)
    # The fields of the row's own type, as a column of its own, so that each is looked for once.
    entries = None
    for name, fields in draft_fields(t).items():
        all_of = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields.items()])
        mine = F.col("application_type") == name
        entries = F.when(mine, all_of) if entries is None else entries.when(mine, all_of)
    d = d.withColumn("__entries", entries)
    d = d.withColumn("fields", F.map_from_entries(F.filter("__entries", lambda e: e["value"].isNotNull())))
    d = d.withColumn("missing_fields", F.transform(F.filter("__entries", lambda e: e["value"].isNull()), lambda e: e["key"])).drop("__entries")
    late = F.coalesce(F.col("fields")["start_date"] > F.col("fields")["end_date"], F.lit(False))
    count, price, total = (F.col("fields")[k].cast(N.MONEY) for k in ("quantity", "estimated_unit_price", "estimated_total_amount"))
    wrong = (F.col("application_type") == "purchase") & F.coalesce(count * price != total, F.lit(False))
    issue = F.array_compact(F.array(F.when(late, "DATE_ORDER_INVALID"), F.when(wrong, "PURCHASE_TOTAL_MISMATCH")))
    d = d.withColumn("issues", issue)
    status = F.when(kind.isNull(), "no_type").when((F.size("missing_fields") > 0) | (F.size("issues") > 0), "waiting_for_information").otherwise("waiting_for_confirmation")
    return d.withColumn("draft_id", F.concat(prefix, F.lit("-DRAFT-"), F.substring(digest, 1, 12))).withColumn("idempotency_key", F.concat_ws(":", F.lit("draft"), kind, F.col(employee), F.substring(digest, 1, 20))).withColumn("status", status).drop("__text")


def turn_action(c: Column, draft_status: Column) -> Column:
    """What a turn does, given the status of the active draft (null: none)."""
    k = command(c)
    explicit = F.when(k.isin(*CONFIRM), "confirm_draft").when(k.isin(*CANCEL), "cancel_draft").when(T.has_any(k, UPDATE), "update_draft")
    waiting = draft_status.isin("waiting_for_information", "waiting_for_materials")
    return F.when(k.isin(*SUBMIT), "submit_draft").when(draft_status.isNull(), "new_request").when(explicit.isNotNull(), explicit).when(T.has_any(c, STANDALONE), "new_request").when(waiting, "update_draft").otherwise("new_request")


#: Preconditions of a first submission, in order of checking.
PRECONDITIONS = ("draft_not_confirmed", "confirmation_missing", "inconsistent_submission_state", "draft_not_ready", "missing_fields", "blocking_validation_issue", "missing_materials", "approval_route_incomplete", "approval_route_empty")


def first_failure(checks: list[Column]) -> Column:
    """The code of the first precondition that fails; ``checks`` are true where it holds."""
    out = None
    for name, ok in zip(PRECONDITIONS, checks, strict=True):
        out = F.when(~ok, name) if out is None else out.when(~ok, name)
    return out


def _first_come(pairs: list[tuple]) -> list[tuple]:
    """Of pairs (t, k, d) those that bind, taken in order of t: neither key nor draft is bound before."""
    keys, drafts, out = set(), set(), []
    for t, k, d in sorted(pairs):
        if k not in keys and d not in drafts:
            keys.add(k)
            drafts.add(d)
            out.append((t, k, d))
    return out


def _bindings(pairs: DataFrame, fold_pairs: int) -> DataFrame:
    """The pairs (k, d, w) that bind, w ordering them. Rounds settle what comes first for key and draft alike;
    once at most ``fold_pairs`` pairs are open, their order is folded in one go, so that a chain of clashes
    costs no round a link. Every round binds the first of all open pairs at least."""
    spark, left, bound = pairs.sparkSession, cut(pairs), []
    while (n := left.count()) > fold_pairs:
        by_key, by_draft = left.groupBy("k").agg(F.min("w").alias("kw")), left.groupBy("d").agg(F.min("w").alias("dw"))
        new = cut(left.join(by_key, "k").join(by_draft, "d").where((F.col("w") == F.col("kw")) & (F.col("w") == F.col("dw"))).select("k", "d", "w"))
        bound.append(new)
        left = cut(left.join(new.select("k"), "k", "left_anti").join(new.select("d"), "d", "left_anti"))
    if n:
        # At most fold_pairs rows: places in order, keys and drafts by hash would do, but are short.
        placed = cut(left.withColumn("t", F.row_number().over(Window.orderBy("w"))))
        chosen = [(t,) for t, _, _ in _first_come([tuple(r) for r in placed.select("t", "k", "d").collect()])]
        bound.append(placed.join(F.broadcast(spark.createDataFrame(chosen, "t int")), "t", "left_semi").select("k", "d", "w"))
    return reduce(DataFrame.unionAll, bound) if bound else left


def submit(attempts: DataFrame, key: str = "idempotency_key", draft: str = "draft_id", owner: str = "owner", at: str = "at", session: str | None = None, tie: str | None = None, fold_pairs: int = 20_000) -> DataFrame:
    """outcome of each attempt in order of ``at``: created, replayed, key_conflict, draft_conflict or invalid.

    An attempt without a key, a draft or a time (null, or blank text) is invalid and binds nothing. An
    attempt whose key is bound replays if draft, owner and session are those of the binding, and is a
    key conflict otherwise. With a free key, a draft that is bound is a draft conflict; else the attempt
    creates, and binds key, draft, owner and session. Attempts of one time go by owner, session, key,
    draft and ``tie``; of attempts alike in all of these one creates and the others replay.

    Keys and drafts may be mixed up at will, so that what an attempt meets hangs on all before it.
    """
    session_of = F.col(session) if session else F.lit(None).cast("string")
    given = [~F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True)) for c in (key, draft, at)]
    whole = reduce(Column.__and__, given)
    own = F.struct(F.col(at).alias("at"), F.col(owner).alias("o"), session_of.alias("s"), F.col(key).alias("k"), F.col(draft).alias("d"), *([F.col(tie).alias("i")] if tie else []))
    asked = attempts.withColumn("__w", F.when(whole, own))
    pairs = asked.where("__w is not null").groupBy(F.col("__w.k").alias("k"), F.col("__w.d").alias("d")).agg(F.min("__w").alias("w"))
    bindings = _bindings(pairs, fold_pairs)
    by_key = bindings.select(F.col("k").alias("__k"), F.col("w").alias("__kw"))
    by_draft = bindings.select(F.col("d").alias("__d"), F.col("w").alias("__dw"))
    # Invalid attempts have no key to meet by; they stay out of the joins, where they would be one hot key.
    j = asked.where("__w is not null").join(by_key, F.col("__w.k") == F.col("__k"), "left").join(by_draft, F.col("__w.d") == F.col("__d"), "left")
    place = F.row_number().over(Window.partitionBy("__w").orderBy(F.lit(0)))
    first = F.col("__w") == F.col("__kw")
    same = (F.col("__kw.d") == F.col("__w.d")) & F.col("__kw.o").eqNullSafe(F.col("__w.o")) & F.col("__kw.s").eqNullSafe(F.col("__w.s"))
    before = F.col("__kw") < F.col("__w")
    outcome = F.when(first & (F.col("__n") == 1), "created").when((before | first) & same, "replayed").when(before, "key_conflict").when(F.col("__dw") < F.col("__w"), "draft_conflict")
    done = j.withColumn("__n", place).withColumn("outcome", outcome).select(*[F.col(f"`{c}`") for c in attempts.columns], "outcome")
    return done.unionByName(asked.where("__w is null").select(*[F.col(f"`{c}`") for c in attempts.columns], F.lit("invalid").alias("outcome")))
