"""Prompt-injection rules, secret redaction and follow-up detection, as regular expressions in the JVM."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T

#: Rule id, category and pattern, in rule order.
INJECTION_RULES = (
    ("PI001", "instruction_override", r"\b(?:ignore|disregard|forget|override|bypass)\b.{0,48}\b(?:previous|prior|above|system|developer|security|safety)\b.{0,32}\b(?:instructions?|prompts?|rules?|policies|guardrails?)\b"),
    ("PI002", "instruction_override", r"(?:忽略|无视|忘掉|覆盖|绕过).{0,20}(?:之前|以上|前面|系统|开发者|安全|权限).{0,16}(?:指令|提示词?|规则|限制|策略)"),
    ("PI003", "secret_exfiltration", r"\b(?:reveal|print|repeat|dump|expose|return)\b.{0,48}(?:system prompt|developer message|hidden instructions?|api[- ]?keys?|access tokens?|secret keys?|passwords?)"),
    ("PI004", "secret_exfiltration", r"(?:给出|输出|打印|复述|暴露|告诉我).{0,28}(?:系统提示词?|开发者消息|隐藏指令|API.?Key|访问令牌|密钥|密码)"),
    ("PI005", "privilege_escalation", r"\b(?:i am|i'm|treat me as|make me|grant me)\b.{0,28}\b(?:administrator|admin|root|finance|security officer|hr manager)\b.{0,40}\b(?:access|permission|privilege|confidential|restricted|core)\b"),
    ("PI006", "privilege_escalation", r"(?:我是|将我设为|把我当作|授予我).{0,20}(?:管理员|财务|人力|安全员|最高权限|核心权限).{0,24}(?:查看|访问|给我|权限|核心|敏感|保密)"),
    ("PI007", "role_override", r"\b(?:you are now|act as|switch to)\b.{0,32}\b(?:unrestricted|developer|system|administrator|root|dan|jailbroken)\b"),
    ("PI008", "role_override", r"(?:你现在是|扮演|切换为|进入).{0,20}(?:无约束|开发者|系统|管理员|DAN|越狱)(?:模式|角色|身份)?"),
    ("PI009", "tool_manipulation", r"\b(?:call|invoke|execute|run)\b.{0,32}\b(?:tool|function|command)\b.{0,32}\b(?:without|bypass|ignore|skip)\b"),
    ("PI010", "tool_manipulation", r"(?:调用|执行|运行).{0,24}(?:工具|函数|命令).{0,24}(?:无需|绕过|跳过|忽略)(?:确认|权限|审批|限制)?"),
    ("PI011", "encoded_instruction", r"\b(?:decode|base64|rot13)\b.{0,32}\b(?:execute|follow|obey)\b.{0,24}\b(?:content|instructions?)\b"),
    ("PI012", "encoded_instruction", r"(?:解码|Base64|ROT13).{0,24}(?:执行|遵循|服从).{0,16}(?:内容|指令)"),
    ("PI013", "prompt_boundary_spoofing", r"(?:<system>|\[system\]|###\s*system|###\s*developer).{0,80}(?:ignore|execute|instruction|you are)"),
)
#: Credential-shaped values, in order.
SECRET_PATTERNS = (
    r"(?i)\b(?:api[_ -]?key|access[_ -]?token|token|secret|password|passwd|pwd)\s*[:=]\s*[^\s,;]+",
    r"(?i)\b(?:bearer)\s+[A-Za-z0-9._~+/=-]{8,}",
    r"\bsk-[A-Za-z0-9_-]{8,}\b",
    r"密码\s*[:=：]\s*[^\s，。；;]+",
)
SUFFIX = "…[已截断]"
#: What makes a request depend on history, and what doesn't.
STANDALONE = ("确认", "确认草稿", "确认无误", "提交", "提交审批", "提交申请", "取消", "取消草稿", "放弃草稿")
PREFIXES = ("那", "那么", "这个", "这种", "这些", "它", "上述", "刚才", "前面", "还有", "另外")
MARKERS = ("呢", "还需要", "又需要", "分别是多少", "具体是什么", "怎么处理", "怎么办理")
DEPENDENT = ("需要哪些材料", "需要什么材料", "要哪些材料", "谁审批", "谁来审批", "怎么审批", "审批流程是什么", "标准是多少", "额度是多少", "可以报销吗")
TOPICS = ("差旅", "出差", "住宿费", "交通费", "采购", "请假", "年休假", "病假", "事假", "费用报销", "信息安全", "数据安全")


#: Words of which a match of each rule holds at least one from every group; a fast test before the pattern.
NEEDED = {
    "PI001": (("ignore", "disregard", "forget", "override", "bypass"), ("previous", "prior", "above", "system", "developer", "security", "safety"), ("instruction", "prompt", "rule", "policies", "guardrail")),
    "PI002": (("忽略", "无视", "忘掉", "覆盖", "绕过"),),
    "PI003": (("reveal", "print", "repeat", "dump", "expose", "return"), ("prompt", "message", "instruction", "key", "token", "password")),
    "PI004": (("给出", "输出", "打印", "复述", "暴露", "告诉我"),),
    "PI005": (("admin", "root", "finance", "security officer", "hr manager"), ("access", "permission", "privilege", "confidential", "restricted", "core")),
    "PI006": (("我是", "将我设为", "把我当作", "授予我"),),
    "PI007": (("you are now", "act as", "switch to"),),
    "PI008": (("你现在是", "扮演", "切换为", "进入"),),
    "PI009": (("tool", "function", "command"), ("without", "bypass", "ignore", "skip")),
    "PI010": (("调用", "执行", "运行"),),
    "PI011": (("decode", "base64", "rot13"),),
    "PI012": (("解码", "base64", "rot13"),),
    "PI013": (("system", "developer"), ("<system>", "[system]", "###")),
}
#: A part of a rule that no match is without, where its words alone turn up in most texts.
NEEDED_PART = {"PI007": r"\b(?:unrestricted|developer|system|administrator|root|dan|jailbroken)\b"}
SECRET_NEEDED = (("key", "token", "secret", "passw", "pwd"), ("bearer",), ("sk-",), ("密码",))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out = out | c.contains(w)
    return out


def scan_text(c: Column) -> Column:
    """What the rules look at: NFKC, no zero-width characters, single spaces."""
    return T.collapse(F.regexp_replace(T.nfkc(c), T.ZERO_WIDTH, ""))


def injection(scanned: Column) -> Column:
    """Matched rules in order: array of (rule, category)."""
    # Letters that case-insensitive matching takes for i and s.
    low = F.lower(F.translate(scanned, "\u0130\u0131\u017f", "iis"))

    def rules(x: Column) -> Column:
        rows = []
        for rule, category, pattern in INJECTION_RULES:
            may = F.lit(True)
            for group in NEEDED[rule]:
                may = may & _any(x["low"], group)
            rows.append(F.when(may & x["text"].rlike("(?iu)" + pattern), F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"))))
        return F.array_compact(F.array(*rows))

    # A lambda's variable is computed once; as plain columns both texts would be made again for each test.
    return F.transform(F.array(F.struct(scanned.alias("text"), low.alias("low"))), rules)[0]


def harmless(c: Column) -> Column:
    """A fast test of the text as it is: of characters that scanning leaves alone, and for no rule all the words
    that a match holds. White space may stand between the words of a phrase, so only its longest word is
    asked for."""

    def held(low: Column) -> Column:
        out = F.lit(False)
        for rule, groups in NEEDED.items():
            words = [tuple(w for w in (max(word.split(), key=len) for word in g) if w.isascii()) for g in groups]
            if all(words):
                may = _any(low, words[0])
                for g in words[1:]:
                    may = may & _any(low, g)
                out = out | (may & low.rlike("(?iu)" + NEEDED_PART[rule]) if rule in NEEDED_PART else may)
        return out

    return T.is_stable(c) & ~F.transform(F.array(F.lower(c)), held)[0]


def assess(df: DataFrame, text: str) -> DataFrame:
    """``df`` with rules, categories (distinct, in rule order) and blocked. Most texts end at the fast test."""
    c = F.col(text)
    none = F.array().cast("array<struct<rule:string,category:string>>")
    m = df.withColumn("__m", F.when(harmless(c), none).otherwise(injection(scan_text(c))))
    return m.withColumn("rules", F.col("__m.rule")).withColumn("categories", F.array_distinct("__m.category")).withColumn("blocked", F.size("__m") > 0).drop("__m")


def guard_counts(assessed: DataFrame) -> DataFrame:
    """checked, blocked and llm_calls_avoided."""
    blocked = F.count_if("blocked")
    return assessed.agg(F.count(F.lit(1)).alias("checked"), blocked.alias("blocked"), blocked.alias("llm_calls_avoided"))


def evidence_counts(assessed: DataFrame) -> DataFrame:
    """checked and quarantined: evidence passages that a rule matches are left out of every context."""
    return assessed.agg(F.count(F.lit(1)).alias("checked"), F.count_if("blocked").alias("quarantined"))


def observed(assessed: DataFrame, name: str = "guard") -> tuple[DataFrame, Observation]:
    """``assessed`` as it is, with the counters of ``guard_counts`` and ``evidence_counts`` taken in passing by
    whatever reads it: no scan of their own. The observation has checked, blocked, llm_calls_avoided and
    quarantined once an action on the result (or on a plan above it) is done; on a stream they come
    with each batch's progress, under ``name``."""
    blocked = F.count_if("blocked")
    counters = [F.count(F.lit(1)).alias("checked"), blocked.alias("blocked"), blocked.alias("llm_calls_avoided"), blocked.alias("quarantined")]
    if assessed.isStreaming:
        return assessed.observe(name, *counters), None
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    return assessed.observe(seen, *counters), seen


def redact(c: Column, limit: int = 2000) -> Column:
    """struct(content, redacted, truncated). White space of any kind at the ends goes; blank content is null."""

    def once(value: Column, f) -> Column:
        """``f`` of a value that is computed once, as a lambda's variable is."""
        return F.transform(F.array(value), f)[0]

    def scrubbed(x: Column) -> Column:
        r, hit = x["text"], F.lit(False)
        for p, words in zip(SECRET_PATTERNS, SECRET_NEEDED, strict=True):
            may = _any(x["low"], words)
            hit = hit | F.coalesce(may & x["text"].rlike(p), F.lit(False))
            r = F.when(may, F.regexp_replace(r, p, "[REDACTED]")).otherwise(r)
        return F.struct(r.alias("text"), hit.alias("hit"))

    def shortened(x: Column) -> Column:
        long = F.length(x["text"]) > limit
        kept = F.when(long, F.concat(F.substring(x["text"], 1, limit - len(SUFFIX)), F.lit(SUFFIX))).otherwise(x["text"])
        return F.struct(kept.alias("content"), x["hit"].alias("redacted"), F.coalesce(long, F.lit(False)).alias("truncated"))

    stripped = once(T.strip(c), lambda t: F.struct(F.nullif(t, F.lit("")).alias("text"), F.lower(t).alias("low")))
    return once(once(stripped, scrubbed), shortened)


def command(c: Column) -> Column:
    return F.btrim(T.strip(c), F.lit("。.!！?？ ，,"))


def needs_context(c: Column) -> Column:
    """Whether a request leans on earlier turns."""
    n = command(c)
    starts = n.rlike("^(?:" + "|".join(PREFIXES) + ")")
    depends = T.has_any(n, DEPENDENT) & ~T.has_any(n, TOPICS)
    return F.when(n.isin(*STANDALONE) | (F.length(n) > 160), False).otherwise(starts | T.has_any(n, MARKERS) | depends)
