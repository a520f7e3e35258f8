"""Revisions of purchase drafts: each turn's words are laid over what the draft holds, and all that hangs on
it is decided anew.

Fields are found in every revision's own text, once, as columns. A window carries each field's last value
forward, so a draft of any number of revisions is sorted, not gathered. A total that was given stays until
another is given; a total that was worked out follows count and price. Missing fields, issues, the
approval route and the materials are those of the fields as they stand after the revision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from . import approval, materials, requests

#: How a revision names a count, an item and a total, once its verbs are one (see ``normalized_revision``).
COUNT = r"数量\s*[为是：:]?\s*(\d+|[一二两三四五六七八九十]+)"
ITEM = r"(?:采购事项|采购物品|物品名称|商品名称)\s*[为是：:]?\s*([^，,；;。\n]+)"
TOTALS = ("预计总金额", "采购总金额", "总金额", "总价", "预算金额")


def _words(c: Column) -> Column:
    return F.nullif(T.strip(c), F.lit(""))


def found_fields(text: Column) -> dict[str, Column]:
    """What a revision says of each field of a purchase draft; ``text`` is stripped and normalised. A total is
    only what the text gives as one."""
    said = dict(requests.draft_fields(text)["purchase"])
    count = N.small_number(F.regexp_extract(text, COUNT, 1))
    said["quantity"] = F.coalesce(F.when(count == F.floor(count), count.cast("int").cast("string")), said["quantity"])
    said["item_name"] = F.coalesce(_words(F.regexp_extract(text, ITEM, 1)), said["item_name"])
    said["estimated_total_amount"] = requests._labelled_money(text, TOTALS).cast("string")
    return said


def purchases(revisions: DataFrame, draft: str = "draft_id", order: str = "revision", text: str = "text") -> DataFrame:
    """draft, revision, fields, missing_fields, issues, status, total, level, steps, materials after each revision.

    Blank and null texts change nothing, and their revision stands with what came before. The order of a
    draft's revisions is unique."""
    words = revisions.select(draft, order, T.normalized_revision(F.coalesce(F.col(text), F.lit(""))).alias("__t"))
    said = found_fields(F.col("__t"))
    # A column a field, found once, before the one shuffle; a revision without draft or place adds nothing.
    known = F.col(draft).isNotNull() & F.col(order).isNotNull()
    found = words.select(draft, order, *[F.when(known, v).alias(f"__{k}") for k, v in said.items()])
    so_far = Window.partitionBy(draft).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = found.select(draft, order, *[F.last(f"__{k}", ignorenulls=True).over(so_far).alias(f"__{k}") for k in said])
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"__{k}").alias("value")) for k in sorted(said)])
    every = held.select(draft, order, F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("fields"))
    f = F.col("fields")
    count, price, given = (f[k].cast(N.MONEY) for k in ("quantity", "estimated_unit_price", "estimated_total_amount"))
    worked_out = (price * count).cast(N.MONEY)
    d = every.withColumn("total", F.coalesce(given, worked_out))
    d = d.withColumn("issues", F.array_compact(F.array(F.when(given != worked_out, "PURCHASE_TOTAL_MISMATCH"))))
    has = lambda k: f[k].isNotNull() | (F.col("total").isNotNull() if k == "estimated_total_amount" else F.lit(False))
    d = d.withColumn("missing_fields", F.array_compact(F.array(*[F.when(~has(k), k) for k in said])))
    done = (F.size("missing_fields") == 0) & (F.size("issues") == 0)
    d = d.withColumn("status", F.when(done, "waiting_for_confirmation").otherwise("waiting_for_information"))
    yes = lambda k: F.coalesce(f[k] == "true", F.lit(False))
    it, urgent = yes("involves_it_or_data"), yes("is_emergency")
    level, steps, _ = approval.purchase(F.col("total"), it, urgent, F.lit(False))
    goods, service = (F.coalesce(f["category"] == c, F.lit(False)) for c in ("GOODS", "SERVICE"))
    known = F.col("total").isNotNull()
    return d.select(
        draft, order, "fields", "missing_fields", "issues", "status", "total",
        F.when(known, level).alias("level"), F.when(known, steps).alias("steps"), materials.purchase_requirements(F.col("total"), it, goods, service, urgent).alias("materials"),
    )


def latest_purchase(revised: DataFrame, draft: str = "draft_id", order: str = "revision") -> DataFrame:
    """A draft as its last revision leaves it."""
    others = [c for c in revised.columns if c != draft]
    return revised.groupBy(draft).agg(F.max_by(F.struct(*others), F.col(order)).alias("r")).select(draft, "r.*")
