"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Targets. Source weights share the whole size; a target stops at ``max_repeats`` times its
source's size and the excess is shared again by weight. That is a water level: the target is
the smaller of the cap and level * weight.

Schedule. The cumulative weights give each source a share of a fixed total of slots, two at
least, in proportion to its target. Slot i is the golden-ratio point i * phi mod 1, mapped
through the cumulative weights to a source; the slots of a source are ranked. The slots that a
source wins are the number of equal-token blocks that its shuffled stream is cut to, up to its
target: the r-th slot takes the r-th block. A stream repeats when it is used up, and a block may
begin and end inside a document. What is taken of a document is the sum over its won blocks; a
source that won no slot would give nothing (two slots' width always holds a point).

Scale. Texts are read once, for their sizes. Rows are shuffled by a hash into cells of a source;
offsets come from prefix sums over cells and then inside one cell, so a source with a third of
all rows is never in one task. Points are generated, counted and ranked in runs of slots. A
block holds at most ``block_words`` words however large the input is. Sources are one row each
in a table; none of it goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WORD = r"[^\x20\x09-\x0D]+"
WEIGHT_CYCLE = (5, 2, 1)
#: The golden ratio's fraction in 62 bits, in two halves, so that points are exact integers.
BITS = 31
PHI_HIGH, PHI_LOW = divmod(2850178704830799621, 1 << BITS)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_level(sizes: list[int], weights: list[float], max_repeats: int) -> list[float]:
    """min(cap, level * weight) for each source, with the level at which targets sum to all sizes."""
    total, caps = sum(sizes), [max_repeats * s for s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, open_weight, level = total, sum(weights), 0.0
    for i in order:
        level = left / open_weight
        if level <= caps[i] / weights[i]:
            break
        left -= caps[i]
        open_weight -= weights[i]
    return [min(float(c), level * w) for c, w in zip(caps, weights, strict=True)]


def source_plan(sizes: DataFrame, cycle: tuple[float, ...], max_repeats: int, slots: int, block_words: int) -> DataFrame:
    """sid, source, source_size, target, take, lo, hi, n_slots of every source of ``sizes`` (source,
    source_size). Sources are ordered by code point, null last; the windows run over one row a source.
    ``lo`` and ``hi`` bound the source's share of the points in 62-bit integers."""
    ranked = sizes.withColumn("sid", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1).cast("bigint"))
    place = F.pmod(F.col("sid"), F.lit(len(cycle)))
    weight = F.lit(float(cycle[-1]))
    for i, w in reversed(list(enumerate(cycle[:-1]))):
        weight = F.when(place == i, float(w)).otherwise(weight)
    cap = (max_repeats * F.col("source_size")).cast("double")
    by_ratio = Window.orderBy("ratio", "sid")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    r = ranked.withColumn("weight", weight).withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    r = r.withColumn("total", F.sum("source_size").over(everything)).withColumn("capped", F.coalesce(F.sum(max_repeats * F.col("source_size")).over(before), F.lit(0))).withColumn("open_weight", F.sum("weight").over(after))
    level = (F.col("total") - F.col("capped")).cast("double") / F.col("open_weight")
    # The level is that of the first source, by cap over weight, whose cap it doesn't pass.
    r = r.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", "sid", level.alias("level")))).over(everything)["level"])
    r = r.withColumn("target", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("weight"))).withColumn("take", F.least(F.floor(F.col("target") + 0.5).cast("bigint"), max_repeats * F.col("source_size")))
    block = F.least(F.lit(block_words), F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(slots))))
    # Slots in proportion to the target, rounded up, and two at least for a source with words.
    share = F.when(F.col("take") > 0, F.greatest(F.lit(2), F.ceil(F.col("take") / block))).otherwise(F.lit(0)).cast("bigint")
    upto = F.sum("share").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    r = r.withColumn("share", share).withColumn("n_slots", F.sum("share").over(everything)).withColumn("upto", upto)
    scale = F.lit(1 << 2 * BITS).cast("decimal(20,0)")
    edge = lambda c: F.floor(c.cast("decimal(18,0)") * scale / F.greatest(F.col("n_slots"), F.lit(1)).cast("decimal(18,0)")).cast("bigint")
    return r.select("sid", "source", "source_size", "target", "take", edge(F.col("upto") - F.col("share")).alias("lo"), edge(F.col("upto")).alias("hi"), "n_slots")


def golden_point(slot: Column) -> Column:
    """slot * phi mod 1 in 62-bit integers, for slots below 2**31; no product passes 63 bits."""
    half = 1 << BITS
    return ((slot * PHI_HIGH % half) * half + slot * PHI_LOW) % (1 << 2 * BITS)


def schedule(points: DataFrame, plan: DataFrame, run: int = 1 << 16) -> DataFrame:
    """sid, rank, slot: the source of every slot in ``points`` (slot), ranked within its source.

    A point meets its source by an equi-join on cells of the unit interval, so the number of
    sources may be large. Ranks come from counts of runs of slots and a window inside one run.
    """
    grid = 1 << 12
    cell = lambda c: F.floor(c / F.lit(1 << (2 * BITS - 12)))
    cells = plan.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), F.least(cell(F.col("hi")), F.lit(grid - 1)))).alias("cell"))
    u = points.withColumn("u", golden_point(F.col("slot"))).withColumn("cell", cell(F.col("u")))
    hits = u.join(cells, "cell").where("u >= lo and u < hi").select("sid", "slot", F.expr(f"slot div {run}").alias("run"))
    per_run = hits.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    before = per_run.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0))).drop("c")
    inside = F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot"))
    return hits.withColumn("r", inside).join(before, ["sid", "run"]).select("sid", (F.col("r") + F.col("before")).cast("bigint").alias("rank"), "slot")


def streams(sized: DataFrame, cells: int) -> DataFrame:
    """Each row's offset in its source's shuffled stream of words (__at), with its place (__cell, __place)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = sized.withColumn("__key", key).withColumn("__cell", F.floor(F.conv(F.substring("__key", 1, 8), 16, 10).cast("bigint") * cells / F.lit(1 << 32)).cast("bigint"))
    earlier = Window.partitionBy("source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cell_sums = d.groupBy("source", "__cell").agg(F.sum("size").alias("__sum")).select(F.col("source").alias("__s"), F.col("__cell").alias("__c"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    within = Window.partitionBy("source", "__cell").orderBy("__key", "doc_id", "size")
    d = d.withColumn("__place", F.row_number().over(within)).withColumn("__in", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = d.join(cell_sums, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__cell") == F.col("__c")))
    return placed.withColumn("__at", F.col("__base") + F.col("__in")).drop("__s", "__c", "__base", "__in", "__key")


class Mix:
    """The mix of ``docs``; ``pieces`` is the schedule itself, ``taken`` the count per row.

    ``slots`` is the least number of blocks where the words allow it, ``block_words`` the most
    words of a block: a small input is cut finely and a large one never more coarsely than that.
    A null text has size 0 and very long texts are cut at block borders like any other; rows with
    a null or repeated id each count; an empty table gives no row. Only id, source and text are
    read, so other columns of any name don't matter.
    """

    def __init__(self, docs: DataFrame, doc_id="doc_id", source="source", text="text", slots=1 << 17, block_words=1 << 14, cell_rows=1 << 15, cycle=WEIGHT_CYCLE, max_repeats=3):
        spark, space = docs.sparkSession, Workspace(docs.sparkSession, "mixing")
        sized = space.write(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")), "sized")
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.plan = space.write(source_plan(sizes, cycle, max_repeats, slots, block_words).coalesce(1), "plan")
        n = self.plan.agg(F.max("n_slots")).first()[0] or 0
        if n >= 1 << BITS:
            raise ValueError("block_words is too small for this input: it takes 2**31 slots or more")
        points = spark.range(1, n + 1).select(F.col("id").alias("slot"))
        self._slots = space.write(schedule(points, self.plan), "slots")
        won = self._slots.groupBy("sid").agg(F.count(F.lit(1)).alias("won"))
        # Blocks are equal to a word: the first ``longer`` of the won ones have size ``short`` + 1.
        src = self.plan.join(won, "sid", "left").select("sid", F.col("source").alias("__src"), "source_size", "target", F.when(F.col("won") > 0, F.col("take")).otherwise(0).alias("take"), F.coalesce("won", F.lit(0)).alias("won"))
        src = src.withColumn("short", F.when(F.col("won") > 0, F.expr("take div won")).otherwise(0)).withColumn("longer", F.when(F.col("won") > 0, F.col("take") % F.col("won")).otherwise(0))
        placed = streams(sized, max(64, -(-sized.count() // cell_rows)))
        rows = placed.join(src, F.col("source").eqNullSafe(F.col("__src"))).drop("__src")
        # Copies of a row on the unrolled stream: one for each pass that the source's words allow.
        passes = F.when(F.col("take") > 0, F.sequence(F.lit(0).cast("bigint"), F.expr("(take - 1) div greatest(source_size, 1)"))).otherwise(F.array(F.lit(0).cast("bigint")))
        unrolled = rows.withColumn("pass", F.explode(passes)).withColumn("lo", F.col("__at") + F.col("pass") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("take")))
        ranks = F.when(F.col("hi") > F.col("lo"), F.sequence(self._block_of("lo"), self._block_of("hi - 1")))
        self._rows, self._unrolled = rows, unrolled.withColumn("rank", F.explode_outer(ranks))

    @staticmethod
    def _block_of(word: str) -> Column:
        """The rank of the block that holds a word of the unrolled stream."""
        return F.expr(f"case when {word} < longer * (short + 1) then ({word}) div (short + 1) + 1 else longer + ({word} - longer * (short + 1)) div greatest(short, 1) + 1 end")

    def pieces(self) -> DataFrame:
        """The mix in order: slot, sid, rank, doc_id, pass, from (word of the document), words, and the row's place."""
        begin = F.expr("(rank - 1) * short + least(rank - 1, longer)")
        end = F.expr("rank * short + least(rank, longer)")
        p = self._unrolled.where("rank is not null").withColumn("__from", F.greatest(F.col("lo"), begin)).withColumn("words", F.least(F.col("hi"), end) - F.col("__from"))
        won = p.join(self._slots, ["sid", "rank"])
        return won.select("slot", "sid", "rank", "doc_id", "source", "pass", (F.col("__from") - F.col("lo")).alias("from_word"), "words", "__cell", "__place")

    def taken(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken, source_slots and first_slot of every row."""
        got = self.pieces().groupBy("sid", "__cell", "__place").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
        return self._rows.join(got, ["sid", "__cell", "__place"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.col("won").alias("source_slots"), "first_slot")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    m = Mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.taken().select("doc_id", "size", "source_size", "target", "taken", "source_slots", "first_slot")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1 AS sid
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s
), o AS (
  SELECT *, cap / weight AS ratio,
         sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w
), level AS (
  SELECT arg_min(CAST(total - capped AS DOUBLE) / CAST(open_weight AS DOUBLE), (ratio, sid)) AS level
  FROM o WHERE CAST(total - capped AS DOUBLE) / CAST(open_weight AS DOUBLE) <= ratio
), t AS (
  SELECT sid, source, source_size, total, least(cap, coalesce((SELECT level FROM level), 0) * weight) AS target FROM o
), u AS (
  SELECT *, CAST(least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS BIGINT) AS take,
         least(16384, greatest(1, CAST(ceil(total / 131072) AS BIGINT))) AS block FROM t
), n AS (
  SELECT *, CASE WHEN take > 0 THEN greatest(2, (take + block - 1) // block) ELSE 0 END AS share FROM u
), e AS (
  SELECT *, sum(share) OVER () AS n_slots, sum(share) OVER (ORDER BY sid ROWS UNBOUNDED PRECEDING) AS upto FROM n
), iv AS (
  SELECT sid, source, source_size, target, take,
         (CAST(upto - share AS HUGEINT) * 4611686018427387904) // n_slots AS lo, (CAST(upto AS HUGEINT) * 4611686018427387904) // n_slots AS hi
  FROM e
), points AS (
  SELECT slot, (CAST(slot AS HUGEINT) * 2850178704830799621) % 4611686018427387904 AS u
  FROM (SELECT unnest(range(1, 1 + CAST((SELECT max(n_slots) FROM e) AS BIGINT))) AS slot)
), ranked AS (
  SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) AS rank FROM points JOIN iv ON u >= lo AND u < hi
), won AS (
  SELECT iv.*, count(slot) AS won FROM iv LEFT JOIN ranked ON iv.sid = ranked.sid GROUP BY ALL
), blocks AS (
  SELECT won.sid, slot, (rank - 1) * (take // won) + least(rank - 1, take % won) AS b0, rank * (take // won) + least(rank, take % won) AS b1
  FROM ranked JOIN won ON ranked.sid = won.sid
), p AS (
  SELECT doc_id, source, size,
         CAST(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a,
         row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size) AS place
  FROM d
), passes AS (
  SELECT sid, place, a + pass * source_size AS lo, a + pass * source_size + size AS hi
  FROM p JOIN won ON p.source IS NOT DISTINCT FROM won.source, (SELECT unnest(range(0, 3)) AS pass)
), pieces AS (
  SELECT passes.sid, place, slot, least(hi, b1) - greatest(lo, b0) AS words
  FROM passes JOIN blocks ON passes.sid = blocks.sid AND b0 < hi AND b1 > lo
), got AS (
  SELECT sid, place, sum(words) AS taken, min(slot) AS first_slot FROM pieces GROUP BY sid, place
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, won AS source_slots, first_slot
FROM p JOIN won ON p.source IS NOT DISTINCT FROM won.source LEFT JOIN got ON got.sid = won.sid AND got.place = p.place
"""
