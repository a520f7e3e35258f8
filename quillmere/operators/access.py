"""Row-level access control with an as-of date. What isn't known is denied.

Every denial is a Column that is null where the row passes, so the reasons of a row are an array
in fixed order and an allowed row is one whose array is empty. A null or unknown status, date of
effect, level or scope denies, and so does every scope for an identity that lacks the value; an
identity without department, roles, clearance or region is incomplete and refused as a whole.

Many identities share few profiles (department, roles, clearance, region). Profiles are numbered,
each value of a scope is a mask of the profiles that have it, and a row's own masks are combined
bit by bit where the row lies: no row is joined or shuffled, and open scopes are no hot key.
Identities get the rows of their profile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: The clearance levels in order.
LEVELS = ("public", "internal", "sensitive", "core")
REASONS = ("document_not_effective", "not_yet_effective", "expired", "clearance", "department", "role", "region")


def level_rank(level: Column) -> Column:
    """Place of a level from 0; null for a level that isn't known."""
    place = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower(strip(level))) - 1
    return F.when(place >= 0, place).cast("int")


def scope(values: Column) -> Column:
    """Upper-case entries without blanks; null stays null."""
    return F.filter(F.transform(values, lambda x: F.upper(strip(x))), lambda x: x.isNull() | (x != ""))


def _open(s: Column) -> Column:
    """A scope without entries, or with ALL, is open; one that isn't known is not."""
    return F.coalesce((F.size(s) == 0) | F.exists(s, lambda x: F.coalesce(x == "ALL", F.lit(False))), F.lit(False)) & s.isNotNull()


def _has(s: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(s, value), F.lit(False))


def _named(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def denial_reasons(c: dict[str, Column], who: dict[str, Column], as_of: Column) -> Column:
    """Reasons in fixed order. ``c``: status, effective, expiry, rank, departments, roles, region of a
    row; ``who``: department, roles, rank, region of an identity."""
    departments, roles = scope(c["departments"]), scope(c["roles"])
    region = _named(F.lower(c["region"]))
    passes = (
        c["status"] == "effective",
        c["effective"] <= as_of,
        c["expiry"].isNull() | (c["expiry"] >= as_of),
        c["rank"] <= who["rank"],
        _open(departments) | _has(departments, F.upper(_named(who["department"]))),
        _open(roles) | F.arrays_overlap(roles, F.coalesce(scope(who["roles"]), F.array().cast("array<string>"))),
        region.isNull() | (region == _named(F.lower(who["region"]))),
    )
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(r)) for ok, r in zip(passes, REASONS, strict=True)]))


COLUMNS = ("status", "effective", "expiry", "rank", "departments", "roles", "region")


def _mine(df: DataFrame, names) -> dict[str, Column]:
    return {n: df[n] for n in names}


def _complete(identity: dict[str, object]) -> None:
    for name in ("department", "region"):
        if not str(identity.get(name) or "").strip():
            raise ValueError(f"an identity has a {name}")
    if identity.get("rank") is None or not [r for r in identity.get("roles") or [] if str(r or "").strip()]:
        raise ValueError("an identity has roles and a clearance")


def decide(rows: DataFrame, identity: dict[str, object], as_of: str) -> DataFrame:
    """``rows`` with denial_reasons and allowed for one identity; no join. An incomplete identity is an error."""
    _complete(identity)
    who = {"department": F.lit(identity["department"]), "roles": F.array(*[F.lit(r) for r in identity["roles"]]), "rank": F.lit(identity["rank"]), "region": F.lit(identity["region"])}
    d = rows.withColumn("denial_reasons", denial_reasons(_mine(rows, COLUMNS), who, F.lit(as_of).cast("date")))
    return d.withColumn("allowed", F.size("denial_reasons") == 0)


def restrict(rows: DataFrame, identity: dict[str, object], as_of: str) -> DataFrame:
    """The rows that an identity may see: a filter that stands before any scoring or statistics."""
    return decide(rows, identity, as_of).where("allowed").drop("denial_reasons", "allowed")


def _with_profile(identities: DataFrame) -> DataFrame:
    roles = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(scope(F.col("roles")), F.array().cast("array<string>")))))
    p = identities.withColumn("__dep", F.upper(_named(F.col("department")))).withColumn("__roles", roles).withColumn("__rank", F.col("rank")).withColumn("__reg", _named(F.lower(F.col("region"))))
    known = F.col("__dep").isNotNull() & (F.size("__roles") > 0) & F.col("__rank").isNotNull() & F.col("__reg").isNotNull()
    return p.withColumn("profile", F.when(known, F.sha2(F.to_json(F.struct("__dep", "__roles", "__rank", "__reg")), 256)))


def profiles(identities: DataFrame, who_key: str) -> DataFrame:
    """who, profile of the complete identities: equal department, roles, rank and region, equal profile."""
    return _with_profile(identities).where("profile is not null").select(who_key, "profile")


def incomplete(identities: DataFrame, who_key: str) -> DataFrame:
    """Identities that lack a department, roles, rank or region; they see nothing."""
    return _with_profile(identities).where("profile is null").select(who_key)


#: Profiles in a word of a mask; one bit of a signed integer stays free.
WORD = 62


def _mask(numbers: list[int], words: int) -> list[int]:
    out = [0] * words
    for i in numbers:
        out[i // WORD] |= 1 << (i % WORD)
    return out


def _masks(spark, block: list) -> DataFrame:
    """One row with the names of a block's profiles and the masks of every department, role and region that
    they have, and of every clearance (the profiles that reach it); the mask of all, and of none."""
    words, of = -(-len(block) // WORD), {"deps": {}, "roles": {}, "regions": {}}
    for i, r in enumerate(block):
        for kind, values in (("deps", [r["__dep"]]), ("regions", [r["__reg"]]), ("roles", r["__roles"])):
            for v in values:
                of[kind].setdefault(v, []).append(i)
    ranks = [(n, _mask([i for i, r in enumerate(block) if r["__rank"] >= n], words)) for n in sorted({r["__rank"] for r in block})]
    row = [[r["profile"] for r in block], *({v: _mask(n, words) for v, n in of[k].items()} for k in ("deps", "roles", "regions")), ranks, _mask(list(range(len(block))), words), [0] * words]
    mask = "array<bigint>"
    return spark.createDataFrame([tuple(row)], f"__names array<string>, __deps map<string, {mask}>, __rols map<string, {mask}>, __regs map<string, {mask}>, __ranks array<struct<rank: int, mask: {mask}>>, __all {mask}, __none {mask}")


def _either(masks: Column, values: Column) -> Column:
    """The profiles that have one of the values."""
    return F.aggregate(values, F.col("__none"), lambda found, v: F.zip_with(found, F.coalesce(F.try_element_at(masks, F.coalesce(v, F.lit(""))), F.col("__none")), lambda a, b: a.bitwiseOR(b)))


def _bits(word: Column) -> Column:
    """The places of a word's set bits, in order."""
    places = F.array(*[F.lit(b) for b in range(WORD)])
    return F.when(word == 0, F.array().cast("array<int>")).otherwise(F.filter(places, lambda b: F.call_function("getbit", word, b) == 1))


def _both(*masks: Column) -> Column:
    out = masks[0]
    for m in masks[1:]:
        out = F.zip_with(out, m, lambda a, b: a.bitwiseAND(b))
    return out


def allowed_profiles(rows: DataFrame, identities: DataFrame, as_of: str, key: str, profile_block: int = 4096) -> DataFrame:
    """profile, row key of what each profile of ``identities`` may see.

    Profiles are taken in blocks of ``profile_block``; a block's masks are one broadcast row, of at most
    that many values of a scope, and roles, with a bit for each profile.
    """
    spark, day, last, done = rows.sparkSession, F.lit(as_of).cast("date"), None, []
    mine = _with_profile(identities).where("profile is not null").groupBy("profile").agg(*[F.first(c).alias(c) for c in ("__dep", "__roles", "__rank", "__reg")])
    r = rows.where((F.col("status") == "effective") & (F.col("effective") <= day) & (F.col("expiry").isNull() | (F.col("expiry") >= day)) & F.col("rank").isNotNull())
    r = r.select(key, F.col("rank").alias("__need"), scope(F.col("departments")).alias("__d"), scope(F.col("roles")).alias("__r"), _named(F.lower("region")).alias("__g"))
    while True:
        block = (mine if last is None else mine.where(F.col("profile") > last)).orderBy("profile").limit(profile_block).collect()
        if block:
            last, m = block[-1]["profile"], r.join(F.broadcast(_masks(spark, block)))
            nobody = F.lit(None).cast("array<string>")
            departments, roles = (F.when(_open(F.col(c)), F.col("__all")).otherwise(_either(F.col(k), F.coalesce(F.col(c), nobody, F.array().cast("array<string>")))) for c, k in (("__d", "__deps"), ("__r", "__rols")))
            region = F.when(F.col("__g").isNull(), F.col("__all")).otherwise(F.coalesce(F.try_element_at("__regs", F.col("__g")), F.col("__none")))
            cleared = F.coalesce(F.get(F.filter("__ranks", lambda x: x["rank"] >= F.col("__need")), F.lit(0))["mask"], F.col("__none"))
            seen = m.select(key, "__names", _both(departments, roles, region, cleared).alias("__m"))
            bits = F.flatten(F.transform("__m", lambda w, i: F.transform(_bits(w), lambda b: b + i * WORD)))
            done.append(seen.select(key, "__names", F.explode(bits).alias("__n")).select(F.get("__names", F.col("__n")).alias("profile"), key))
        if len(block) < profile_block:
            break
    return reduce(DataFrame.unionAll, done) if done else mine.select("profile").join(rows.select(key).limit(0))


def allowed_pairs(rows: DataFrame, identities: DataFrame, as_of: str, key: str, who_key: str) -> DataFrame:
    """(identity, row) pairs that pass."""
    return profiles(identities, who_key).join(allowed_profiles(rows, identities, as_of, key), "profile").select(who_key, key)


def narrowed(rows: DataFrame, ids: list | None = None, types: list | None = None, departments: list | None = None, effective: str | None = None, key: str = "document_id", kind: str = "document_type") -> DataFrame:
    """The rows that a caller asks for within its scope: by id, type, department and day of effect."""
    if ids is not None:
        rows = rows.where(F.col(key).isin(ids))
    if types is not None:
        rows = rows.where(F.col(kind).isin(types))
    if departments is not None:
        rows = rows.where(F.arrays_overlap(scope(F.col("departments")), F.array(*[F.upper(F.lit(d)) for d in departments])))
    if effective is not None:
        day = F.lit(effective).cast("date")
        rows = rows.where((F.col("effective") <= day) & (F.col("expiry").isNull() | (F.col("expiry") >= day)))
    return rows
