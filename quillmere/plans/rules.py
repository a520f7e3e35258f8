"""Business-rule, draft and state queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import approval, evaluation, folds, materials, requests, revisions, safety, state, workflow
from ..session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _values(rows, *names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows) + f") AS v({', '.join(names)})"


# --- approval and materials over orders ----------------------------------------------------------

_ORDERS = "o AS (SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS amount, o_orderpriority = '1-URGENT' AS emergency, o_orderpriority = '2-HIGH' AS it, o_orderstatus = 'P' AS major FROM orders)"


def _orders(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(18,2)").alias("amount"), (p == "1-URGENT").alias("emergency"), (p == "2-HIGH").alias("it"), (F.col("o_orderstatus") == "P").alias("major"))


def _routed(spark, d):
    level, steps, conditions = approval.purchase(F.col("amount"), F.col("it"), F.col("emergency"), F.col("major"))
    return _orders(spark, d).select("o_orderkey", level.alias("level"), steps.alias("steps"), conditions.alias("conditions"))


@query(f"""WITH {_ORDERS} SELECT CASE WHEN emergency THEN 'emergency_purchase' WHEN amount <= 5000 THEN 'small_purchase' WHEN amount <= 50000 THEN 'general_purchase' WHEN amount <= 200000 THEN 'important_purchase' ELSE 'major_purchase' END AS level, count(*) AS n FROM o GROUP BY 1""")
def approval_tier(spark, d):
    return _routed(spark, d).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ORDERS} SELECT o_orderkey, array_to_string(list_filter(CASE WHEN emergency THEN
  ['DEPARTMENT_HEAD:approve', CASE WHEN it THEN 'IT_DEPARTMENT:technical_review' END, 'PROCUREMENT_DEPARTMENT:confirm', 'FINANCE_DEPARTMENT:confirm', CASE WHEN amount > 50000 THEN 'BUSINESS_VICE_PRESIDENT:approve' END, CASE WHEN amount > 200000 THEN 'GENERAL_MANAGER:approve' END, CASE WHEN amount > 1000000 OR major THEN 'MANAGEMENT_COMMITTEE:deliberate' END]
  ELSE ['DIRECT_MANAGER:approve', CASE WHEN amount > 5000 THEN 'DEPARTMENT_HEAD:approve' END, CASE WHEN it THEN 'IT_DEPARTMENT:technical_review' END, CASE WHEN amount > 5000 THEN 'PROCUREMENT_DEPARTMENT:approve' END, CASE WHEN amount > 50000 THEN 'FINANCE_DEPARTMENT:approve' END, CASE WHEN amount > 50000 THEN 'BUSINESS_VICE_PRESIDENT:approve' END, CASE WHEN amount > 200000 THEN 'GENERAL_MANAGER:approve' END, CASE WHEN amount > 1000000 OR major THEN 'MANAGEMENT_COMMITTEE:deliberate' END] END, lambda x: x IS NOT NULL), '>') AS route,
  array_to_string(list_filter([CASE WHEN emergency THEN '{approval.COND_EMERGENCY}' END, CASE WHEN it THEN '{approval.COND_IT}' END, CASE WHEN NOT emergency AND (amount > 1000000 OR major) THEN '{approval.COND_COMMITTEE}' END], lambda x: x IS NOT NULL), ';') AS conditions FROM o""")
def approval_steps(spark, d):
    route = F.array_join(F.transform("steps", lambda s: F.concat(s["approver"], F.lit(":"), s["action"])), ">")
    return _routed(spark, d).select("o_orderkey", route.alias("route"), F.array_join("conditions", ";").alias("conditions"))


_REQUIRED = f"""{_ORDERS}, need AS (SELECT o_orderkey, unnest(list_filter([
  CASE WHEN it THEN {{'material': 'technical_requirement', 'required': 1}} END, CASE WHEN it THEN {{'material': 'it_review_opinion', 'required': 1}} END,
  CASE WHEN emergency THEN {{'material': 'emergency_purchase_explanation', 'required': 1}} END,
  CASE WHEN amount > 200000 THEN {{'material': 'tender_document', 'required': 1}} END,
  CASE WHEN amount > 50000 AND amount <= 200000 THEN {{'material': 'quotation', 'required': 3}} END,
  CASE WHEN amount > 50000 AND amount <= 200000 THEN {{'material': 'comparison_record', 'required': 1}} END,
  CASE WHEN amount > 5000 AND amount <= 50000 THEN {{'material': 'quotation', 'required': 2}} END], lambda x: x IS NOT NULL)) AS r FROM o),
required AS (SELECT o_orderkey, r.material AS material, CAST(r.required AS INTEGER) AS required FROM need)"""


def _required(spark, d):
    need = materials.purchase_requirements(F.col("amount"), F.col("it"), F.lit(False), F.lit(False), F.col("emergency"))
    return _orders(spark, d).select("o_orderkey", F.inline(need))


@query(f"WITH {_REQUIRED} SELECT o_orderkey, material, required FROM required")
def required_materials(spark, d):
    return _required(spark, d)


@query(f"""WITH {_REQUIRED}, given AS (SELECT l_orderkey AS o_orderkey, 'quotation' AS material, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, material, CAST(greatest(required - coalesce(n, 0), 0) AS BIGINT) AS lacking FROM required LEFT JOIN given USING (o_orderkey, material) WHERE required > coalesce(n, 0)""")
def missing_materials(spark, d):
    given = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_suppkey").alias("n")).withColumn("material", F.lit("quotation"))
    return materials.missing_counts(_required(spark, d), given, "o_orderkey")


@query(f"""WITH {_REQUIRED}, rules AS (SELECT * FROM {_values([(m, d, a) for m, _, _, d, a in materials.MATERIALS], "material", "document_id", "article_label")})
SELECT document_id, article_label, count(*) AS n FROM required JOIN rules USING (material) GROUP BY ALL""")
def cited_articles(spark, d):
    r = materials.rules(spark).drop("sensitive")
    return _required(spark, d).join(F.broadcast(r), "material").groupBy("document_id", "article_label").agg(F.count(F.lit(1)).alias("n"))


_LEAVE = "w AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity / 2 AS DECIMAL(18, 2)) AS days, l_returnflag = 'R' AS sick, l_linestatus = 'F' AND l_linenumber = 1 AS head FROM lineitem)"


@query(f"""WITH {_LEAVE}, h AS (SELECT *, days > 3 OR (sick AND days > 1) AS hr FROM w), r AS (SELECT
  CASE WHEN head THEN 'department_head_leave' WHEN days <= 1 THEN 'short_leave' WHEN days <= 3 THEN 'medium_leave' WHEN days <= 5 THEN 'extended_leave' ELSE 'long_term_leave' END AS level,
  array_to_string(list_filter(CASE WHEN head THEN [CASE WHEN hr THEN 'HUMAN_RESOURCES' END, 'BUSINESS_VICE_PRESIDENT', CASE WHEN days > 15 THEN 'GENERAL_MANAGER' END]
  ELSE ['DIRECT_MANAGER', CASE WHEN days > 1 THEN 'DEPARTMENT_HEAD' END, CASE WHEN hr THEN 'HUMAN_RESOURCES' END, CASE WHEN days > 5 THEN 'BUSINESS_VICE_PRESIDENT' END, CASE WHEN days > 15 THEN 'GENERAL_MANAGER' END] END, lambda x: x IS NOT NULL), '>') AS route FROM h)
SELECT level, route, count(*) AS n FROM r GROUP BY ALL""")
def leave_routes(spark, d):
    q = F.col("l_quantity")
    w = table(spark, d, "lineitem").select((q / 2).cast("decimal(18,2)").alias("days"), F.when(F.col("l_returnflag") == "R", "sick").alias("kind"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("head"))
    level, steps, _ = approval.leave(F.col("days"), F.col("kind"), F.col("head"), F.lit(False), F.lit(False))
    return w.select(level.alias("level"), F.array_join(F.transform(steps, lambda s: s["approver"]), ">").alias("route")).groupBy("level", "route").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT CAST(round(o_totalprice, 2) AS DECIMAL(18, 2)) AS a, o_shippriority FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 4 AS o_shippriority FROM orders)),
r AS (SELECT CASE WHEN a <= 5000 THEN 'small_travel' WHEN a <= 20000 THEN 'general_travel' ELSE 'large_travel' END AS level,
  array_to_string(list_filter(['DIRECT_MANAGER', CASE WHEN a > 5000 THEN 'DEPARTMENT_HEAD' END, CASE WHEN a > 30000 OR o_shippriority > 15 THEN 'FINANCE_DEPARTMENT' END, CASE WHEN a > 20000 THEN 'BUSINESS_VICE_PRESIDENT' END], lambda x: x IS NOT NULL), '>') AS route FROM o)
SELECT level, route, count(*) AS n FROM r GROUP BY ALL""")
def travel_routes(spark, d):
    o = table(spark, d, "orders").select(F.round("o_totalprice", 2).cast("decimal(18,2)").alias("a"), (F.substring("o_orderpriority", 1, 1).cast("int") * 4).alias("days"))
    no = F.lit(False)
    level, steps, _ = approval.travel(F.col("a"), F.col("days"), no, no, no, no)
    return o.select(level.alias("level"), F.array_join(F.transform(steps, lambda s: s["approver"]), ">").alias("route")).groupBy("level", "route").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT CAST(round(l_extendedprice, 2) AS DECIMAL(18, 2)) AS a FROM lineitem),
r AS (SELECT CASE WHEN a <= 1000 THEN 'small_expense' WHEN a <= 5000 THEN 'general_expense' WHEN a <= 20000 THEN 'large_expense' ELSE 'major_expense' END AS level,
  array_to_string(list_filter(['DIRECT_MANAGER:approve', CASE WHEN a > 1000 THEN 'DEPARTMENT_HEAD:approve' END, CASE WHEN a <= 5000 THEN 'FINANCE_DEPARTMENT:review' ELSE 'FINANCE_DEPARTMENT:approve' END, CASE WHEN a > 20000 THEN 'BUSINESS_VICE_PRESIDENT:approve' END, CASE WHEN a > 100000 THEN 'GENERAL_MANAGER:approve' END], lambda x: x IS NOT NULL), '>') AS route FROM o)
SELECT level, route, count(*) AS n FROM r GROUP BY ALL""")
def expense_routes(spark, d):
    a = table(spark, d, "lineitem").select(F.round("l_extendedprice", 2).cast("decimal(18,2)").alias("a"))
    level, steps, _ = approval.expense(F.col("a"), F.array().cast("array<string>"), F.lit(False))
    return a.select(level.alias("level"), F.array_join(F.transform(steps, lambda s: F.concat(s["approver"], F.lit(":"), s["action"])), ">").alias("route")).groupBy("level", "route").agg(F.count(F.lit(1)).alias("n"))


# --- free text -----------------------------------------------------------------------------------

#: A request for each order: count, price or days come from its columns, wording from its key.
_ASKS = (
    ("purchase", "采购{n}台电脑，每台{price}元，谁审批？", "approval_query"),
    ("purchase", "紧急采购{n}套服务器，预算{price}元，走什么审批", "approval_query"),
    ("leave", "我要请病假{n}天，需要哪些材料", "material_check"),
    ("none", "出差去香港，预计总费用{price}元，怎么审批", "approval_query"),
    ("expense_reimbursement", "费用报销金额{price}元，有发票和报销单，材料齐全吗", "material_check"),
    ("purchase", "生成采购申请草稿，采购{n}台电脑", "draft_generation"),
    ("none", "今天天气怎么样", "unknown"),
    ("leave", "年假{n}天的标准是多少", "policy_query"),
)
_ASKED = f"""asked AS (SELECT o_orderkey, CAST(o_orderkey % {len(_ASKS)} AS INTEGER) AS w, 1 + o_orderkey % 9 AS n, 100 + o_orderkey * 7919 % 300000 AS price FROM orders),
req AS (SELECT *, replace(replace([{", ".join("'" + a[1] + "'" for a in _ASKS)}][w + 1], '{{n}}', CAST(n AS VARCHAR)), '{{price}}', CAST(price AS VARCHAR)) AS request FROM asked)"""


def _requests(spark, d):
    k = F.col("o_orderkey")
    wording = F.get(F.array(*[F.lit(a[1]) for a in _ASKS]), (k % len(_ASKS)).cast("int"))
    text = F.replace(F.replace(wording, F.lit("{n}"), (1 + k % 9).cast("string")), F.lit("{price}"), (100 + k * 7919 % 300000).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", text.alias("request"))


@query(f"WITH {_ASKED} SELECT o_orderkey, request, [{', '.join(repr(a[2]) for a in _ASKS)}][w + 1] AS intent FROM req")
def intent_by_cues(spark, d):
    return _requests(spark, d).select("o_orderkey", "request", requests.intent(F.col("request")).alias("intent"))


@query(f"""WITH {_ASKED}, a AS (SELECT *, CASE w WHEN 0 THEN n * price ELSE price END AS amount FROM req WHERE w IN (0, 1, 3, 4))
SELECT o_orderkey, CASE WHEN w = 1 THEN 'emergency_purchase'
  WHEN w = 0 THEN CASE WHEN amount <= 5000 THEN 'small_purchase' WHEN amount <= 50000 THEN 'general_purchase' WHEN amount <= 200000 THEN 'important_purchase' ELSE 'major_purchase' END
  WHEN w = 3 THEN CASE WHEN amount <= 5000 THEN 'small_travel' WHEN amount <= 20000 THEN 'general_travel' ELSE 'large_travel' END
  ELSE CASE WHEN amount <= 1000 THEN 'small_expense' WHEN amount <= 5000 THEN 'general_expense' WHEN amount <= 20000 THEN 'large_expense' ELSE 'major_expense' END END AS level FROM a""")
def approval_requests(spark, d):
    """Levels of worded requests with generated counts and prices."""
    k = F.col("o_orderkey") % len(_ASKS)
    return approval.check(_requests(spark, d).where(k.isin(0, 1, 3, 4)), "request").select("o_orderkey", "level")


@query(f"""WITH {_ASKED} SELECT o_orderkey, nullif([{', '.join(repr(a[0]) for a in _ASKS)}][w + 1], 'none') AS application_type FROM req""")
def material_requests(spark, d):
    return materials.check(_requests(spark, d), "request").select("o_orderkey", "application_type")


#: Clauses of a purchase draft; each order leaves one of them out, by its key, or none.
_CLAUSES = (("purpose", "用途：研发测试"), ("specification", "规格：27寸"), ("budget_or_cost_center", "预算编号：B-01"), ("expected_delivery_date", "期望交付日期：2026-09-01"), ("delivery_location", "使用地点：上海"), ("supplier_name", "供应商：甲公司"), ("supplier_reason", "推荐理由：价格低"), ("is_emergency", "普通采购"))


@query(f"""WITH r AS (SELECT o_orderkey, CAST(o_orderkey % {len(_CLAUSES) + 1} AS INTEGER) AS gap, 1 + o_orderkey % 9 AS n, 100 + o_orderkey % 2900 AS price, o_orderkey % 7 = 0 AS wrong FROM orders)
SELECT o_orderkey, CAST(n AS VARCHAR) AS quantity, CAST(price AS VARCHAR) || '.00' AS unit_price, CAST(n * price + CASE WHEN wrong THEN 1 ELSE 0 END AS VARCHAR) || '.00' AS total, [{', '.join(repr(k) for k, _ in _CLAUSES)}, ''][gap + 1] AS missing,
  CASE WHEN wrong THEN 'PURCHASE_TOTAL_MISMATCH' ELSE '' END AS issues, CASE WHEN gap < {len(_CLAUSES)} OR wrong THEN 'waiting_for_information' ELSE 'waiting_for_confirmation' END AS status FROM r""")
def draft_requests(spark, d):
    """Purchase drafts with generated counts and prices, a clause left out, and some totals that don't add up."""
    k = F.col("o_orderkey")
    gap, n, price = (k % (len(_CLAUSES) + 1)).cast("int"), 1 + k % 9, 100 + k % 2900
    clauses = F.array_join(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (_, c) in enumerate(_CLAUSES)]), lambda x: x["i"] != gap)["c"], "，")
    total = F.when(k % 7 == 0, F.concat(F.lit("，总金额"), (n * price + 1).cast("string"), F.lit("元"))).otherwise("")
    text = F.concat(F.lit("采购"), n.cast("string"), F.lit("台显示器，每台"), price.cast("string"), F.lit("元"), total, F.lit("，"), clauses)
    rows = table(spark, d, "orders").select(k, text.alias("request"), F.lit("E1").alias("employee_id"), F.lit("S1").alias("session_id"))
    f = F.col("fields")
    return requests.drafts(rows, "request").select(k, f["quantity"].alias("quantity"), f["estimated_unit_price"].alias("unit_price"), f["estimated_total_amount"].alias("total"), F.array_join("missing_fields", ",").alias("missing"), F.array_join("issues", ",").alias("issues"), "status")


#: What leans on earlier turns, and what doesn't, around a generated subject.
_FOLLOWS = (("那{x}需要哪些材料", True), ("确认", False), ("{x}标准是多少", True), ("差旅标准是多少，{x}", False), ("{x}呢", True), ("公司采购制度有哪些规定{x}", False), ("提交审批。", False), ("另外{x}", True))


@query(f"""SELECT c_custkey, replace([{', '.join(repr(t) for t, _ in _FOLLOWS)}][CAST(c_custkey % {len(_FOLLOWS)} AS INTEGER) + 1], '{{x}}', c_mktsegment) AS request,
  [{', '.join(str(y).lower() for _, y in _FOLLOWS)}][CAST(c_custkey % {len(_FOLLOWS)} AS INTEGER) + 1] AS needs_context FROM customer""")
def follow_up_flag(spark, d):
    k = F.col("c_custkey")
    text = F.replace(F.get(F.array(*[F.lit(t) for t, _ in _FOLLOWS]), (k % len(_FOLLOWS)).cast("int")), F.lit("{x}"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select(k, text.alias("request")).withColumn("needs_context", safety.needs_context(F.col("request")))


# --- state ---------------------------------------------------------------------------------------


def _messages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", "text")


_MESSAGES = "m AS (SELECT conv_id AS session_id, turn, role, text FROM conversations)"
_SNAP = f"""{_MESSAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC, (role = 'assistant') DESC, role DESC, text DESC) AS back FROM m),
s AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY back DESC) AS position FROM b WHERE back <= 4)"""


@query(f"WITH {_MESSAGES} SELECT session_id, turn, role, md5(text) AS text_md5 FROM m JOIN (SELECT session_id, max(turn) AS newest FROM m GROUP BY session_id) USING (session_id) WHERE turn > newest - 2")
def memory_retention(spark, d):
    return state.retained(_messages(spark, d), 2).select("session_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {_SNAP} SELECT session_id, CAST(position AS INTEGER) AS position, turn, role FROM s")
def memory_snapshot(spark, d):
    return state.snapshot(_messages(spark, d), 4).select("session_id", "position", "turn", "role")


@query(f"""WITH {_SNAP}, u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY session_id ORDER BY position DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM s)
SELECT session_id, CAST(position AS INTEGER) AS position, CAST(least(length(text), 400 - used) AS BIGINT) AS n_chars, length(text) > 400 - used AS was_cut FROM u WHERE used < 400""")
def context_budget(spark, d):
    c = state.within_budget(_messages(spark, d), 4, 400, content="text")
    return c.select("session_id", "position", F.length("text").cast("bigint").alias("n_chars"), "was_cut")


@query(f"WITH {_MESSAGES} SELECT session_id, CAST(max(turn) + 1 AS BIGINT) AS next_turn FROM m GROUP BY session_id")
def next_turn(spark, d):
    return state.next_turn(_messages(spark, d))


@query(f"WITH {_MESSAGES} SELECT 'memory-' || substr(sha256(CAST(session_id || chr(0) || turn || chr(0) || role AS VARCHAR)), 1, 24) AS message_id, session_id, turn FROM m")
def message_ids(spark, d):
    return _messages(spark, d).select(state.message_id(F.col("session_id"), F.col("turn"), F.col("role")).alias("message_id"), "session_id", "turn")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def latest_revision(spark, d):
    return state.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


#: Attempts whose keys several drafts share: neighbours in threes, by status.
#: Some lack a key, a draft or a time, or have a blank key; a few share their time with the one before.
_ATTEMPTS = """every AS (SELECT o_orderkey AS attempt, o_custkey // 3 AS g, CASE WHEN o_orderkey % 89 <> 4 THEN o_custkey END AS draft,
  CASE o_orderkey % 97 WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE (o_custkey // 3) || ':' || o_orderstatus || ':' || (o_orderkey % 2) END AS k, o_orderpriority AS owner, o_orderkey % 3 AS session,
  CASE WHEN o_orderkey % 83 <> 5 THEN o_orderkey // 64 END AS moment FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY moment, owner, session, k, draft, attempt) AS n FROM every WHERE k <> ' ' AND draft IS NOT NULL AND moment IS NOT NULL)"""


@query(f"""WITH RECURSIVE {_ATTEMPTS}, fold AS (
  SELECT g, n, attempt, 'created' AS outcome, [{{'k': k, 'draft': draft, 'owner': owner, 'session': session}}] AS bound FROM a WHERE n = 1
  UNION ALL
  SELECT a.g, a.n, a.attempt, o.outcome, CASE WHEN o.outcome = 'created' THEN list_append(f.bound, {{'k': a.k, 'draft': a.draft, 'owner': a.owner, 'session': a.session}}) ELSE f.bound END
  FROM fold f JOIN a ON a.g = f.g AND a.n = f.n + 1,
    LATERAL (SELECT CASE WHEN len(list_filter(f.bound, lambda b: b.k = a.k)) > 0
        THEN CASE WHEN len(list_filter(f.bound, lambda b: b.k = a.k AND b.draft = a.draft AND b.owner = a.owner AND b.session = a.session)) > 0 THEN 'replayed' ELSE 'key_conflict' END
      WHEN len(list_filter(f.bound, lambda b: b.draft = a.draft)) > 0 THEN 'draft_conflict' ELSE 'created' END AS outcome) o)
SELECT attempt, outcome FROM fold UNION ALL SELECT attempt, 'invalid' FROM every WHERE attempt NOT IN (SELECT attempt FROM a)""")
def idempotent_submit(spark, d):
    """Submissions whose keys clash over drafts, owners and sessions, checked against a fold attempt by attempt."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    key = F.when(k % 97 == 2, " ").when(k % 97 != 1, F.concat_ws(":", F.floor(c / 3).cast("string"), "o_orderstatus", (k % 2).cast("string")))
    a = table(spark, d, "orders").select(k.alias("attempt"), F.when(k % 89 != 4, c).alias("draft_id"), key.alias("idempotency_key"), F.col("o_orderpriority").alias("owner"), (k % 3).alias("session"), F.when(k % 83 != 5, F.floor(k / 64)).alias("at"))
    return requests.submit(a, session="session", tie="attempt").select("attempt", "outcome")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def session_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return state.deleted(table(spark, d, "orders").select("o_custkey", "o_orderkey"), gone, "o_custkey").select("o_orderkey")


#: Turns of a session and their (intent, action without a draft, while information is awaited, with a draft).
_TURNS = (
    ("生成采购申请草稿", "draft_generation", "new_request", "update_draft", "new_request"),
    ("修改数量为3台", "unknown", "new_request", "update_draft", "update_draft"),
    ("确认", "unknown", "new_request", "confirm_draft", "confirm_draft"),
    ("提交审批。", "unknown", "submit_draft", "submit_draft", "submit_draft"),
    ("取消草稿", "unknown", "new_request", "cancel_draft", "cancel_draft"),
    ("谁审批", "approval_query", "new_request", "new_request", "new_request"),
    ("预算编号 B-01", "unknown", "new_request", "update_draft", "new_request"),
)
_PLACE = f"(session_id * 5 + turn * turn * 3 + turn) % {len(_TURNS)}"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id AS session_id, turn FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
m AS (SELECT session_id, turn, CAST({_PLACE} AS INTEGER) + 1 AS p, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM t),
w AS (SELECT m.*, [{', '.join(repr(t[1]) for t in _TURNS)}][p] AS intent, [{', '.join(repr(t[2]) for t in _TURNS)}][p] AS bare, [{', '.join(repr(t[3]) for t in _TURNS)}][p] AS waiting, [{', '.join(repr(t[4]) for t in _TURNS)}][p] AS held FROM m),
s AS (
  SELECT session_id, 0 AS n, CAST(NULL AS INTEGER) AS turn, CAST(NULL AS VARCHAR) AS intent, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS draft_status, CAST(0 AS BIGINT) AS revision FROM (SELECT DISTINCT session_id FROM t)
  UNION ALL
  SELECT w.session_id, w.n, w.turn, w.intent, x.action,
    CASE WHEN x.action = 'new_request' AND w.intent = 'draft_generation' THEN 'waiting_for_information'
         WHEN x.action = 'update_draft' AND s.draft_status IN ('waiting_for_information', 'confirmed') THEN 'waiting_for_information'
         WHEN x.action = 'confirm_draft' AND s.draft_status = 'waiting_for_information' THEN 'confirmed'
         WHEN x.action = 'cancel_draft' AND s.draft_status IS NOT NULL AND s.draft_status <> 'submitted' THEN 'cancelled'
         WHEN x.action = 'submit_draft' AND s.draft_status = 'confirmed' THEN 'submitted' ELSE s.draft_status END,
    CASE WHEN x.action = 'new_request' AND w.intent = 'draft_generation' THEN 1 WHEN x.action = 'update_draft' AND s.draft_status IN ('waiting_for_information', 'confirmed') THEN s.revision + 1 ELSE s.revision END
  FROM s JOIN w ON w.session_id = s.session_id AND w.n = s.n + 1,
    LATERAL (SELECT CASE WHEN s.draft_status IS NULL THEN w.bare WHEN s.draft_status = 'waiting_for_information' THEN w.waiting ELSE w.held END AS action) x)
SELECT session_id, turn, intent, action, draft_status, revision FROM s WHERE n > 0""")
def session_workflow(spark, d):
    """Sessions of commands: the turns of the conversations, worded by session and turn."""
    m = table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn").distinct()
    text = F.get(F.array(*[F.lit(t[0]) for t in _TURNS]), F.expr(_PLACE).cast("int"))
    return folds.session_workflow(m.withColumn("text", text))


@query(f"""WITH r AS (SELECT o_custkey AS draft_id, o_orderkey AS revision, o_orderkey % 5 AS kind, 1 + o_orderkey % 9 AS n, 100 + o_orderkey * 37 % 29000 AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS first FROM orders),
c AS (SELECT *, CASE WHEN first OR kind = 0 THEN n END AS said_n, CASE WHEN first OR kind = 1 THEN price END AS said_price, CASE WHEN NOT first AND kind = 2 THEN n * price END AS said_total, CASE WHEN first THEN FALSE WHEN kind = 3 THEN TRUE END AS said_urgent FROM r),
h AS (SELECT draft_id, revision, {', '.join(f"last_value(said_{x} IGNORE NULLS) OVER (PARTITION BY draft_id ORDER BY revision ROWS UNBOUNDED PRECEDING) AS {x}" for x in ('n', 'price', 'total', 'urgent'))} FROM c),
f AS (SELECT *, CAST(coalesce(total, n * price) AS DECIMAL(18, 2)) AS amount, coalesce(total <> n * price, FALSE) AS wrong FROM h)
SELECT draft_id, revision, CAST(n AS VARCHAR) AS quantity, CAST(amount AS VARCHAR) AS total, CASE WHEN wrong THEN 'PURCHASE_TOTAL_MISMATCH' ELSE '' END AS issues, CASE WHEN wrong THEN 'waiting_for_information' ELSE 'waiting_for_confirmation' END AS status,
  CASE WHEN urgent THEN 'emergency_purchase' WHEN amount <= 5000 THEN 'small_purchase' WHEN amount <= 50000 THEN 'general_purchase' WHEN amount <= 200000 THEN 'important_purchase' ELSE 'major_purchase' END AS level,
  array_to_string(list_filter(CASE WHEN urgent THEN ['DEPARTMENT_HEAD', 'IT_DEPARTMENT', 'PROCUREMENT_DEPARTMENT', 'FINANCE_DEPARTMENT', CASE WHEN amount > 50000 THEN 'BUSINESS_VICE_PRESIDENT' END, CASE WHEN amount > 200000 THEN 'GENERAL_MANAGER' END]
    ELSE ['DIRECT_MANAGER', CASE WHEN amount > 5000 THEN 'DEPARTMENT_HEAD' END, 'IT_DEPARTMENT', CASE WHEN amount > 5000 THEN 'PROCUREMENT_DEPARTMENT' END, CASE WHEN amount > 50000 THEN 'FINANCE_DEPARTMENT' END, CASE WHEN amount > 50000 THEN 'BUSINESS_VICE_PRESIDENT' END, CASE WHEN amount > 200000 THEN 'GENERAL_MANAGER' END] END, lambda x: x IS NOT NULL), '>') AS route,
  array_to_string(list_filter(['technical_requirement:1', 'it_review_opinion:1', CASE WHEN urgent THEN 'emergency_purchase_explanation:1' END, CASE WHEN amount > 200000 THEN 'tender_document:1' END, CASE WHEN amount > 50000 AND amount <= 200000 THEN 'quotation:3' END, CASE WHEN amount > 50000 AND amount <= 200000 THEN 'comparison_record:1' END, CASE WHEN amount > 5000 AND amount <= 50000 THEN 'quotation:2' END], lambda x: x IS NOT NULL), ',') AS materials FROM f""")
def purchase_revisions(spark, d):
    """A customer's orders as revisions of a draft: counts, prices, totals and urgency change, and what hangs on them follows."""
    k, first = F.col("o_orderkey"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) == 1
    n, price = (1 + k % 9).cast("string"), (100 + k * 37 % 29000).cast("string")
    whole = F.concat(F.lit("采购"), n, F.lit("台显示器，每台"), price, F.lit("元，"), F.lit("，".join(c for _, c in _CLAUSES)))
    says = F.array(F.concat(F.lit("数量改成"), n, F.lit("台")), F.concat(F.lit("每台改为"), price, F.lit("元")), F.concat(F.lit("总金额调整为"), ((1 + k % 9) * (100 + k * 37 % 29000)).cast("string"), F.lit("元")), F.lit("改为紧急采购"), F.concat(F.lit("用途：扩容"), n))
    rows = table(spark, d, "orders").withColumn("first", first).select(F.col("o_custkey").alias("draft_id"), k.alias("revision"), F.when(F.col("first"), whole).otherwise(F.get(says, (k % 5).cast("int"))).alias("text"))
    done = revisions.purchases(rows)
    return done.select("draft_id", "revision", F.col("fields")["quantity"].alias("quantity"), F.col("total").cast("string").alias("total"), F.array_join("issues", ",").alias("issues"), "status", "level", F.array_join(F.transform("steps", lambda s: s["approver"]), ">").alias("route"), F.array_join(F.transform("materials", lambda m: F.concat(m["material"], F.lit(":"), m["required"].cast("string"))), ",").alias("materials"))


#: Golden cases: the category of each wording, and what is expected of it; every 13th case expects a wrong intent.
_CATEGORY = ("approval", "approval", "material", "approval", "material", "draft", "draft", "material")
_GOLDEN = f"""{_ASKED}, cases AS (SELECT o_orderkey AS case_id, w, n, price, [{', '.join(repr(c) for c in _CATEGORY)}][w + 1] AS category, o_orderkey % 13 <> 4 AS fine FROM req),
amounts AS (SELECT *, CASE w WHEN 0 THEN n * price ELSE price END AS amount FROM cases),
dims AS (SELECT case_id, 'intent' AS metric, fine AS passed FROM amounts
  UNION ALL SELECT case_id, 'approval_level', CASE w WHEN 0 THEN amount <= 50000 WHEN 1 THEN TRUE ELSE amount <= 20000 END FROM amounts WHERE category = 'approval'
  UNION ALL SELECT case_id, 'material_type', w <> 7 OR n > 2 FROM amounts WHERE category = 'material')"""


def _golden(spark, d):
    k = F.col("o_orderkey")
    w, n = (k % len(_ASKS)).cast("int"), 1 + k % 9
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), w)
    intent = F.when(k % 13 == 4, "another").otherwise(pick([a[2] for a in _ASKS]))
    # Levels and types that hold up to an amount or a count; beyond it the case expects what it doesn't get.
    levels = {"approval": F.when(w == 0, F.array(F.lit("small_purchase"), F.lit("general_purchase"))).when(w == 1, F.array(F.lit("emergency_purchase"))).otherwise(F.array(F.lit("small_travel"), F.lit("general_travel")))}
    kind = F.when((w == 7) & (n <= 2), "another").otherwise(F.nullif(pick([a[0] for a in _ASKS]), F.lit("none")))
    cases = _requests(spark, d).select(k.alias("case_id"), "request", pick(_CATEGORY).alias("category"), intent.alias("want_intent"), levels["approval"].alias("want_levels"), kind.alias("want_type"))
    said = lambda c: c.withColumn("intent", requests.intent(F.col("request")))
    right = {"intent": lambda: F.col("intent") == F.col("want_intent")}
    runners = {"approval": lambda c: approval.check(said(c), "request"), "material": lambda c: materials.check(said(c), "request"), "draft": said}
    metrics = {"approval": right | {"approval_level": lambda: F.array_contains("want_levels", F.col("level"))}, "material": right | {"material_type": lambda: F.col("application_type") == F.col("want_type")}, "draft": right}
    return evaluation.golden(cases, runners, metrics)


@query(f"WITH {_GOLDEN} SELECT case_id, metric, passed FROM dims")
def golden_cases(spark, d):
    """Cases of three categories through their runners: each dimension of each case."""
    return _golden(spark, d)


@query(f"""WITH {_GOLDEN}, m(metric, target) AS (VALUES ('intent', 0.9), ('approval_level', 1.0), ('material_type', 0.9), ('citation', 1.0)),
s AS (SELECT metric, count(*) FILTER (passed) AS passed, count(*) AS total FROM dims GROUP BY metric)
SELECT m.metric, coalesce(passed, 0) AS passed, coalesce(total, 0) AS total, CASE WHEN total > 0 THEN round(passed / total, 6) ELSE 0.0 END AS accuracy, coalesce(total > 0 AND round(passed / total, 6) >= target, FALSE) AS met FROM m LEFT JOIN s USING (metric)""")
def golden_metrics(spark, d):
    """Accuracy of each metric over all golden cases, against its target; a metric without cases is not met."""
    return evaluation.metric_summary(_golden(spark, d), {"intent": 0.9, "approval_level": 1.0, "material_type": 0.9, "citation": 1.0})


#: Turns of the workflow: text, intent, explicit command, whether it asks for something of its own.
_SAYS = (
    ("生成采购申请草稿", "draft_generation", "", False),
    ("修改数量为3台", "unknown", "update_draft", False),
    ("确认", "unknown", "confirm_draft", False),
    ("提交审批。", "unknown", "submit_draft", False),
    ("取消草稿", "unknown", "cancel_draft", False),
    ("谁审批", "approval_query", "", True),
    ("预算编号 B-01", "unknown", "", False),
    ("报销需要哪些材料", "material_check", "", True),
    ("出差怎么安排", "policy_query", "", False),
)
#: Which of them a turn is, by session and turn; sessions of the conversations are laid together, seven to one.
_SAID = f"(session_id * 5 + turn * turn * 3 + turn * 7 + turn // 5) % {len(_SAYS)}"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id // 7 AS session_id, (conv_id % 7) * 100 + turn AS turn FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
m AS (SELECT session_id, turn, CAST({_SAID} AS INTEGER) + 1 AS p, (session_id + turn) % 3 <> 1 AS ready, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM t),
w AS (SELECT m.*, [{', '.join(repr(t[1]) for t in _SAYS)}][p] AS intent, nullif([{', '.join(repr(t[2]) for t in _SAYS)}][p], '') AS said, [{', '.join(str(t[3]).upper() for t in _SAYS)}][p] AS alone FROM m),
s AS (
  SELECT session_id, 0 AS n, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS draft_status, CAST(0 AS BIGINT) AS revision, '' AS outcome, '' AS nodes FROM (SELECT DISTINCT session_id FROM t)
  UNION ALL
  SELECT w.session_id, w.n, w.turn,
    CASE WHEN o.outcome = 'draft_ready' THEN 'waiting_for_confirmation' WHEN o.outcome = 'draft_incomplete' AND x.action IN ('new_request', 'update_draft') THEN 'waiting_for_information'
         WHEN o.outcome IN ('confirmed', 'submitted', 'cancelled') THEN o.outcome ELSE s.draft_status END,
    CASE WHEN x.action = 'new_request' AND w.intent = 'draft_generation' THEN 1 WHEN x.action = 'update_draft' AND o.outcome <> 'rejected_after_submission' THEN s.revision + 1 ELSE s.revision END,
    o.outcome,
    CASE WHEN x.action = 'pending' THEN '' ELSE 'resolve_turn' || CASE WHEN x.gate THEN '>human_confirmation_gate' ELSE '' END
      || CASE x.action WHEN 'new_request' THEN '>classify_intent>' || CASE w.intent WHEN 'draft_generation' THEN 'generate_draft' WHEN 'unknown' THEN 'request_clarification' WHEN 'approval_query' THEN 'check_approval' WHEN 'material_check' THEN 'check_materials' ELSE 'answer_policy' END
           WHEN 'submit_draft' THEN '>submit_approval' ELSE '>' || x.action END
      || CASE WHEN o.outcome = 'draft_ready' OR (x.action = 'submit_draft' AND x.gate) THEN '>await_confirmation>human_confirmation_gate' ELSE '' END END
  FROM s JOIN w ON w.session_id = s.session_id AND w.n = s.n + 1,
    LATERAL (SELECT coalesce(s.draft_status = 'waiting_for_confirmation', FALSE) AS gate, CASE WHEN s.draft_status = 'waiting_for_confirmation' AND w.said IS NULL THEN 'pending' WHEN w.said = 'submit_draft' OR (s.draft_status IS NOT NULL AND w.said IS NOT NULL) THEN w.said
      WHEN s.draft_status = 'waiting_for_information' AND NOT w.alone THEN 'update_draft' ELSE 'new_request' END AS action) x,
    LATERAL (SELECT CASE x.action WHEN 'pending' THEN 'confirmation_pending'
      WHEN 'new_request' THEN CASE w.intent WHEN 'draft_generation' THEN CASE WHEN w.ready THEN 'draft_ready' ELSE 'draft_incomplete' END WHEN 'unknown' THEN 'clarification' ELSE 'answered' END
      WHEN 'update_draft' THEN CASE WHEN s.draft_status = 'submitted' THEN 'rejected_after_submission' WHEN w.ready THEN 'draft_ready' ELSE 'draft_incomplete' END
      WHEN 'confirm_draft' THEN CASE s.draft_status WHEN 'waiting_for_confirmation' THEN 'confirmed' WHEN 'confirmed' THEN 'confirmed' WHEN 'submitted' THEN 'already_submitted' WHEN 'cancelled' THEN 'draft_cancelled' ELSE 'draft_incomplete' END
      WHEN 'cancel_draft' THEN CASE WHEN s.draft_status = 'submitted' THEN 'already_submitted' ELSE 'cancelled' END
      ELSE CASE WHEN s.draft_status IS NULL THEN 'draft_missing' WHEN s.draft_status = 'cancelled' THEN 'draft_cancelled' WHEN s.draft_status = 'confirmed' THEN 'submitted' WHEN s.draft_status = 'submitted' THEN 'replayed' ELSE 'confirmation_required' END END AS outcome) o)
SELECT session_id, turn, draft_status, coalesce(draft_status = 'waiting_for_confirmation', FALSE) AS pending, revision, outcome, nodes FROM s WHERE n > 0""")
def workflow_turns(spark, d):
    """The conversation workflow over long sessions: drafts, the gate that interrupts, and what resumes it."""
    m = table(spark, d, "conversations").select("conv_id", "turn").distinct().select(F.floor(F.col("conv_id") / 7).alias("session_id"), ((F.col("conv_id") % 7) * 100 + F.col("turn")).alias("turn"))
    place = F.expr(_SAID.replace("turn // 5", "turn div 5")).cast("int")
    text = F.get(F.array(*[F.lit(t[0]) for t in _SAYS]), place)
    done = workflow.workflow(m.withColumn("text", text), ready=(F.col("session_id") + F.col("turn")) % 3 != 1)
    return done.withColumn("nodes", F.array_join("nodes", ">"))


@query("""WITH r AS (SELECT o_custkey AS draft_id, o_orderkey AS revision, o_orderstatus, o_orderpriority FROM orders),
f AS (SELECT draft_id, revision, 'status' AS k, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS v FROM r UNION ALL SELECT draft_id, revision, 'urgent', CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END FROM r),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY draft_id, k ORDER BY revision ROWS UNBOUNDED PRECEDING) AS x FROM f)
SELECT draft_id, revision, string_agg(k || '=' || x, ';' ORDER BY k) AS fields FROM w WHERE x IS NOT NULL GROUP BY draft_id, revision""")
def draft_revisions(spark, d):
    e = F.array(F.struct(F.lit("status").alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("value")), F.struct(F.lit("urgent").alias("key"), F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("value")))
    r = table(spark, d, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("revision"), F.map_from_entries(F.filter(e, lambda x: x["value"].isNotNull())).alias("fields"))
    m = folds.revise(r)
    return m.select("draft_id", "revision", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("fields"))
