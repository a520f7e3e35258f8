"""Numbers, money, days and dates in running text. Values are decimals throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The small Chinese numerals.
NUMERALS = {"一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
_DIGITS = "".join(NUMERALS)
MONEY = "decimal(18,2)"
WIDE = "decimal(28,6)"


def _digit(c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv])[c]


def small_number(raw: Column) -> Column:
    """An Arabic number, or a Chinese one from 1 to 99; null for anything else."""
    plain = F.when(raw.rlike(r"^[\d,]*\d[\d,]*(\.\d+)?$"), F.regexp_replace(raw, ",", "")).cast(WIDE)
    n = F.length(raw)
    first, mid, last = raw.substr(1, 1), raw.substr(2, 1), raw.substr(n, F.lit(1))
    chinese = (
        F.when(~raw.rlike(f"^[{_DIGITS}]{{1,3}}$"), None)
        .when(n == 1, _digit(raw))
        .when((n == 2) & (first == "十"), 10 + _digit(last))
        .when((n == 2) & (last == "十"), 10 * _digit(first))
        .when((n == 3) & (mid == "十"), 10 * _digit(first) + _digit(last))
    )
    return F.coalesce(plain, chinese.cast(WIDE))


def _found(c: Column, pattern: str, group: int) -> Column:
    v = F.regexp_extract(c, pattern, group)
    return F.when(v != "", v)


def _scaled(amount: Column, unit: Column) -> Column:
    v = F.regexp_replace(amount, ",", "").cast(WIDE)
    return F.when(unit.isin("万", "万元"), v * 10000).otherwise(v)


def money(c: Column, labels: tuple[str, ...], nouns: tuple[str, ...], commas: bool) -> Column:
    """An amount in yuan: quantity times unit price, else a labelled amount, else an amount before
    one of ``nouns``. ``commas`` allows thousands separators."""
    # How a price for each, a labelled amount and an amount before its noun are written.
    num = r"[\d,]+(?:\.\d+)?" if commas else r"\d+(?:\.\d+)?"
    priced = rf"(\d+(?:\.\d+)?|[{_DIGITS}]+)\s*(?:台|个|套|件|份).{{0,20}}?每(?:台|个|套|件|份)?\s*({num})\s*元"
    labelled = rf"(?:{'|'.join(labels)})[为是约大概:\s]*({num})\s*(万元|万|元|块)"
    trailing = rf"({num})\s*(万元|万|元|块)(?:的)?(?:{'|'.join(nouns)})"
    product = small_number(_found(c, priced, 1)) * F.regexp_replace(_found(c, priced, 2), ",", "").cast(WIDE)
    by_label = _scaled(_found(c, labelled, 1), _found(c, labelled, 2))
    by_noun = _scaled(_found(c, trailing, 1), _found(c, trailing, 2))
    return F.coalesce(product.cast(MONEY), F.when(_found(c, labelled, 1).isNotNull(), by_label).otherwise(by_noun).cast(MONEY))


def days(c: Column) -> Column:
    """Days of leave or travel; half a day is 0.5. Takes working, calendar and plain days."""
    # How half a day and a number of days are written, here and in leave_days.
    half = c.contains("半天") | c.contains("半个工作日")
    return F.when(half, F.lit("0.5").cast(MONEY)).otherwise(small_number(_found(c, rf"(\d+(?:\.\d+)?|[{_DIGITS}]+)\s*(?:个)?(?:工作|自然)?(?:日|天)", 1)).cast(MONEY))


def leave_days(c: Column) -> Column:
    """The narrower rule of the material check: only the unit 天."""
    return small_number(_found(c, rf"(\d+(?:\.\d+)?|[{_DIGITS}]+)\s*(?:个)?(?:工作)?天", 1)).cast(MONEY)


def plain_decimal(c: Column) -> Column:
    """Thousands separators, at most two decimals, no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_number(c, 2), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def dates(c: Column) -> Column:
    """Distinct dates in order, written with -, / or . or as 年月日. A month or day of one digit is no date."""
    # Fixed value: how a date is written.
    tokens = F.regexp_extract_all(c, F.lit(r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{4}年\d{1,2}月\d{1,2}日)"), F.lit(1))

    def parse(t: Column) -> Column:
        iso = F.regexp_replace(F.regexp_replace(t, "日", ""), "[年月/.]", "-")
        return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(iso, "yyyy-MM-dd"))

    return F.array_distinct(F.array_compact(F.transform(tokens, parse)))


def plain(c: Column) -> Column:
    """A decimal in plain notation, without trailing zeros."""
    t = c.cast(WIDE).cast("string")
    return F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)


def hash_score(query: Column, text: Column) -> Column:
    """A deterministic score from 0 to 1 of a pair, for tests of rerankers."""
    h = F.sha2(F.concat_ws("\x00", query, text).cast("binary"), 256)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12 - 1)
