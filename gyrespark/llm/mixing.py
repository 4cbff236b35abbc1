"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the budget in proportion to its weight; targets
above ``max_epochs`` times the source's size are clamped and the excess is
reshared by weight until none is above.  A document is repeated as often as the
whole part of its source's epochs says, and once more if its seeded number lies
below the source's cut, which is set where the taken words come nearest to the
target.

The cut is found from sums of 1,024 bins of the seeded number and of 1,024 finer
ones inside the decisive bin, so no task sorts a source's documents.  Levels are
one-row sums over the sources.

Cases: a null text has size 0; null sources form the last source; a null id has
a number of its own, and rows of equal id and source go together; sources of
size 0 have target 0.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrespark.llm.common import global_rank, persisted, words_of

WEIGHTS = [3, 1, 2]
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 42
FEW_SOURCES = 10_000  # up to so many sources their table is broadcast


def seeded(id_col: str, seed: int = SEED) -> Column:
    """52-bit number of an id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def source_key(column: str) -> Column:
    """Join key of a source that keeps null apart."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to (source_size, weight): shares of a budget, clamped at ``max_epochs`` sizes."""
    cap = F.col("source_size") * max_epochs
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = budget * total / weight if weight else 0.0
    while weight:
        over = F.lit(level) * F.col("weight") > cap
        spent, left = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        following = (budget * total - (spent or 0)) / left if left else level
        if following <= level:
            break
        level = following
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def cuts(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``cut`` to the sources: documents whose number's upper 20 bits lie below it are taken once more."""
    own = sources.select("k", F.floor(F.try_divide("target", "source_size")).alias("whole"), "target", "source_size")
    own = own.select("k", (F.col("target") - F.coalesce("whole", F.lit(0)) * F.col("source_size")).alias("need"))
    by_source = Window.partitionBy("k").orderBy("b")
    first = docs.groupBy("k", F.shiftright("u", 42).alias("b")).agg(F.sum("size").alias("s"))
    first = first.withColumn("after", F.sum("s").over(by_source)).join(own, "k").where("need > 0 AND after >= need")
    first = first.groupBy("k").agg(F.min(F.struct("b", (F.col("after") - F.col("s")).alias("before"), "need")).alias("f")).select("k", "f.*")
    inside = docs.groupBy("k", F.shiftright("u", 42).alias("b"), F.shiftright("u", 32).alias("fine")).agg(F.sum("size").alias("s"))
    inside = inside.join(first, ["k", "b"])
    running = F.sum("s").over(Window.partitionBy("k").orderBy("fine")) + F.col("before")
    edges = inside.select("k", "need", (F.col("fine") + 1).alias("edge"), running.alias("cum")).union(
        first.select("k", "need", F.shiftleft("b", 10).alias("edge"), F.col("before").alias("cum")))
    best = edges.groupBy("k").agg(F.min(F.struct(F.abs(F.col("cum") - F.col("need")).alias("off"), "edge")).alias("e"))
    return sources.join(best.select("k", F.col("e.edge").alias("cut")), "k", "left").withColumn("cut", F.coalesce("cut", F.lit(0)))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: list[float] = WEIGHTS,
         budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """(k, source_size, target, cut, whole) of every source."""
    own = docs.select(source_key(source_col).alias("k"), F.col(source_col).alias("source"), seeded(id_col, seed).alias("u"),
                      F.size(words_of(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("size"))
    own = persisted(own.groupBy("k", "source", F.shiftright("u", 32).alias("fine")).agg(F.sum("size").alias("size")).withColumn("u", F.shiftleft("fine", 32)))
    sources = own.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    sources = global_rank(sources, "source", "rank")
    pick = F.get(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int"))
    sources = water_fill(sources.withColumn("weight", pick), budget, max_epochs)
    whole = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    return persisted(cuts(own, sources).select("k", "source_size", "target", "cut", whole.alias("whole")))


def with_times(docs: DataFrame, sources: DataFrame, id_col: str, source_col: str, seed: int = SEED) -> DataFrame:
    """Join the plan of its source to every row and add ``times``."""
    if sources.count() <= FEW_SOURCES:
        sources = F.broadcast(sources)
    rows = docs.withColumn("k", source_key(source_col)).join(sources, "k")
    return rows.withColumn("times", F.col("whole") + (F.shiftright(seeded(id_col, seed), 32) < F.col("cut")).cast("int"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with its own columns only."""
    sources = plan(docs)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"))
    times = with_times(row, sources, "doc_id", "source").where("times > 0")
    return times.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("row.*")


def op6(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "source", F.size(words_of(F.coalesce("text", F.lit("")))).cast("long").alias("size"))
    return with_times(rows, plan(docs), "doc_id", "source").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0) AS size,
    CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS u FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY 1),
s1 AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s0),
s2 AS (SELECT *, sum(2 * ss) OVER o - 2 * ss AS cap_before, sum(w) OVER () - (sum(w) OVER o - w) AS w_left, 1.5 * sum(ss) OVER () AS budget,
    row_number() OVER (ORDER BY 2.0 * ss / w, source NULLS LAST) AS i
  FROM s1 WINDOW o AS (ORDER BY 2.0 * ss / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT CAST(budget - cap_before AS DOUBLE) / CAST(w_left AS DOUBLE) AS l FROM s2
  WHERE CAST(budget - cap_before AS DOUBLE) / CAST(w_left AS DOUBLE) * w <= 2 * ss ORDER BY i LIMIT 1),
s3 AS (SELECT source, ss, least(2.0::DOUBLE * ss, l * w) AS target FROM s2, lev),
s4 AS (SELECT *, coalesce(floor(target / nullif(ss, 0)), 0) AS whole, target - coalesce(floor(target / nullif(ss, 0)), 0) * ss AS need FROM s3),
g AS (SELECT source, u >> 42 AS b, sum(size) AS s FROM d GROUP BY 1, 2),
g1 AS (SELECT *, sum(s) OVER (PARTITION BY source ORDER BY b) AS after FROM g),
f AS (SELECT g1.source, arg_min(b, b) AS b, arg_min(after - s, b) AS before, any_value(need) AS need
  FROM g1 JOIN s4 ON g1.source IS NOT DISTINCT FROM s4.source WHERE need > 0 AND after >= need GROUP BY 1),
h AS (SELECT d.source, u >> 32 AS fine, sum(size) AS s, any_value(before) AS before, any_value(need) AS need
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.u >> 42 = f.b GROUP BY 1, 2),
e AS (SELECT source, fine + 1 AS edge, abs(before + sum(s) OVER (PARTITION BY source ORDER BY fine) - need) AS off FROM h
  UNION ALL SELECT source, b << 10, abs(before - need) FROM f),
c AS (SELECT source, (min({'off': off, 'edge': edge})).edge AS cut FROM e GROUP BY 1)
SELECT d.doc_id, d.size, s4.ss AS source_size, s4.target,
  CAST(d.size * (whole + CASE WHEN (u >> 32) < coalesce(cut, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
