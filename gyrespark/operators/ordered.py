"""Ordered-sequence primitives that do not gather a whole key in one task.

A plain ``Window.partitionBy(track)`` sorts every row of a track in one task,
which stalls when one track holds a large share of the table.  Here a sequence
is cut into chunks of its ordering column.  Rows are shuffled and sorted by
(key, chunk); a small summary (one row per key and chunk) is scanned over the
chunks and joined back on the same (key, chunk) distribution, so results are
exactly those of the plain window while no task sees more than one chunk.

``chunk`` is a Column that never decreases along the order, for example
``time_chunk("ts", "30 days")``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrespark.functions.text import micros
from gyrespark.session import cut_lineage

CHUNK = "_chunk"
_UNITS = {"hour": 3600, "day": 86400, "minute": 60, "second": 1}


def time_chunk(time: str, width: str = "30 days") -> Column:
    """Chunk number of a timestamp; ``width`` such as ``"12 hours"``."""
    number, unit = width.split()
    seconds = int(number) * _UNITS[unit.rstrip("s")]
    return F.floor(micros(time) / F.lit(seconds * 1_000_000))


def value_chunk(value: str, width: float) -> Column:
    """Chunk number of a numeric ordering column."""
    return F.floor(F.col(value).cast("double") / F.lit(float(width)))


def _order(order: list[str], descending: bool = False) -> list[Column]:
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]


def _join_summary(df: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, CHUNK]
    right = summary.withColumnsRenamed({k: f"_s_{k}" for k in keys})
    cond = [df[k].eqNullSafe(right[f"_s_{k}"]) for k in keys]
    joined = cond[0]
    for c in cond[1:]:
        joined = joined & c
    return df.join(right, joined, "left").drop(*[f"_s_{k}" for k in keys])


def _over_chunks(by: list[str]):
    return Window.partitionBy(*by).orderBy(CHUNK)


def neighbours(df: DataFrame, by: list[str], order: list[str], values: list[str],
               offsets: list[int], chunk: Column) -> DataFrame:
    """Add ``<value>_lag<k>`` (negative offsets) and ``<value>_lead<k>``."""
    reach_back = max([-o for o in offsets if o < 0], default=0)
    reach_on = max([o for o in offsets if o > 0], default=0)
    base = df.withColumn(CHUNK, chunk).withColumn("_pay", F.struct(*values))
    inside = Window.partitionBy(*by, CHUNK).orderBy(*_order(order))
    whole = Window.partitionBy(*by, CHUNK)
    numbered = base.withColumn("_rn", F.row_number().over(inside)).withColumn("_n", F.count(F.lit(1)).over(whole))

    item = F.struct(F.col("_rn").alias("rn"), F.col("_pay").alias("pay"))
    edges = (
        numbered.where((F.col("_rn") <= reach_on) | (F.col("_n") - F.col("_rn") < reach_back))
        .groupBy(*by, CHUNK)
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_rn") <= reach_on, item))).alias("_head"),
            F.array_sort(F.collect_list(F.when(F.col("_n") - F.col("_rn") < reach_back, item))).alias("_tail"),
        )
    )
    over = _over_chunks(by)
    summary = edges
    if reach_back:
        summary = summary.withColumn("_before", F.flatten(F.collect_list("_tail").over(over.rowsBetween(-reach_back, -1))))
    if reach_on:
        summary = summary.withColumn("_after", F.flatten(F.collect_list("_head").over(over.rowsBetween(1, reach_on))))
    out = _join_summary(numbered, summary.drop("_head", "_tail"), by)

    for offset in sorted(set(offsets)):
        k = abs(offset)
        if offset < 0:
            local = F.lag("_pay", k).over(inside)
            edge = F.try_element_at("_before", F.col("_rn").cast("int") - k - 1)
            own = F.col("_rn") > k
            name = f"_lag{k}"
        else:
            local = F.lead("_pay", k).over(inside)
            edge = F.try_element_at("_after", (F.col("_rn") + k - F.col("_n")).cast("int"))
            own = F.col("_rn") + k <= F.col("_n")
            name = f"_lead{k}"
        out = out.withColumn(name, F.when(own, local).otherwise(F.when(~own, edge)["pay"]))
        out = out.withColumns({f"{v}{name}": F.col(name)[v] for v in values}).drop(name)
    return out.drop(CHUNK, "_pay", "_rn", "_n", "_before", "_after")


def running(df: DataFrame, by: list[str], order: list[str], chunk: Column,
            sums: dict[str, Column] | None = None, number: str | None = None,
            total: str | None = None) -> DataFrame:
    """Add inclusive running sums, a 1-based row number and the group size."""
    sums = sums or {}
    base = df.withColumn(CHUNK, chunk).withColumns({f"_v_{n}": c for n, c in sums.items()})
    base = base.withColumn("_v__one", F.lit(1).cast("long"))
    names = [*sums, "_one"]
    inside = Window.partitionBy(*by, CHUNK).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    over = _over_chunks(by)
    summary = base.groupBy(*by, CHUNK).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns({f"_p_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)) for n in names})
    if total:
        summary = summary.withColumn("_all", F.sum("_t__one").over(Window.partitionBy(*by)))
    summary = summary.drop(*[f"_t_{n}" for n in names])
    out = _join_summary(base, summary, by)
    outputs = {n: F.sum(f"_v_{n}").over(inside) + F.col(f"_p_{n}") for n in sums}
    if number:
        outputs[number] = F.sum("_v__one").over(inside) + F.col("_p__one")
    if total:
        outputs[total] = F.col("_all")
    out = out.withColumns(outputs)
    return out.drop(CHUNK, "_all", *[f"_v_{n}" for n in names], *[f"_p_{n}" for n in names])


def sum_before(df: DataFrame, column: str, name: str, value: Column | None = None) -> DataFrame:
    """Add the sum of ``value`` (default: 1 a row) over the rows before each in the order of a unique column.

    Rows are range-partitioned and summed within their part; the offset of a
    part is the total of those before it, of which there is one figure a part.
    """
    value = F.lit(1) if value is None else value
    dealt = df.withColumn("_value", value.cast("long")).repartitionByRange(F.col(column))
    dealt = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    totals = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.sum("_value").alias("n")).collect()}
    if not totals:
        return df.withColumn(name, F.lit(0).cast("long"))
    starts, before = {}, 0
    for part in sorted(totals):
        starts[part], before = before, before + totals[part]
    start = F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("_part"))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn(name, (F.coalesce(inside, F.lit(0)) + start).cast("long")).drop("_value", "_part")


def carry(df: DataFrame, by: list[str], order: list[str], values: list[str], chunk: Column,
          forward: bool = True, suffix: str | None = None, inclusive: bool = True) -> DataFrame:
    """Nearest earlier (``forward``) or later non-null value of each column.

    Adds ``<value>_<suffix>``; ``inclusive`` lets a row see its own value.
    """
    suffix = suffix or ("prev" if forward else "next")
    base = df.withColumn(CHUNK, chunk).withColumn("_ord", F.struct(*order))
    pick = F.max_by if forward else F.min_by
    summary = base.groupBy(*by, CHUNK).agg(*[
        pick(F.when(F.col(v).isNotNull(), F.struct(F.col(v).alias("v"))),
             F.when(F.col(v).isNotNull(), F.col("_ord"))).alias(f"_e_{v}") for v in values])
    over = _over_chunks(by)
    if forward:
        frame, take = over.rowsBetween(Window.unboundedPreceding, -1), F.last
    else:
        frame, take = over.rowsBetween(1, Window.unboundedFollowing), F.first
    summary = summary.withColumns({f"_c_{v}": take(F.col(f"_e_{v}"), True).over(frame) for v in values})
    out = _join_summary(base, summary.drop(*[f"_e_{v}" for v in values]), by)
    inside = Window.partitionBy(*by, CHUNK).orderBy(*_order(order))
    edge = 0 if inclusive else 1
    if forward:
        frame_in, take_in = inside.rowsBetween(Window.unboundedPreceding, -edge), F.last
    else:
        frame_in, take_in = inside.rowsBetween(edge, Window.unboundedFollowing), F.first
    out = out.withColumns({
        f"{v}_{suffix}": F.coalesce(take_in(F.col(v), True).over(frame_in), F.col(f"_c_{v}")["v"]) for v in values})
    return out.drop(CHUNK, "_ord", *[f"_c_{v}" for v in values])


def number_rows(df: DataFrame, by: list[str], order: list[str], chunk: Column,
                name: str = "point_seq") -> DataFrame:
    return running(df, by, order, chunk, number=name)


def best_row(df: DataFrame, by: list[str], rank: list[Column], columns: list[str]) -> DataFrame:
    """Row with the smallest ``rank`` per key, as a partial aggregate.

    ``min_by`` combines on the map side, so a hot key costs one value per
    input partition instead of a sort of the whole key.
    """
    keyed = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*columns), keyed).alias("_best"))
    return picked.select(*by, *[F.col("_best")[c].alias(c) for c in columns])


def exact_percentiles(df: DataFrame, by: list[str], value: str, outputs: dict[str, float],
                      bins: int = 1024, weight: str | None = None) -> DataFrame:
    """Exact linear-interpolated percentiles without one task per key; a row counts ``weight`` times, if given.

    Equal values are counted first; each key's value range is cut into bins;
    a scan over the bin totals finds the bins that hold the wanted ranks and
    only those are ranked in detail.  Every later step starts from the counted
    values, whose exchange Spark reuses, so the input is read once.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    counted = rows.groupBy(*by, "_v").agg(F.sum("_w").alias("_k"))
    span = counted.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_k").alias("_n"))
    placed = _left_on(counted, span, by)
    width = (F.col("_hi") - F.col("_lo")) / bins
    placed = placed.withColumn(CHUNK, F.when(width > 0, F.floor((F.col("_v") - F.col("_lo")) / width)).otherwise(F.lit(0)).cast("long"))
    over = _over_chunks(by)
    totals = placed.groupBy(*by, CHUNK).agg(F.sum("_k").alias("_t"), F.max("_n").alias("_bn"))
    totals = totals.withColumn("_p", F.coalesce(F.sum("_t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    wanted = []
    for q in outputs.values():
        at = (F.col("_bn") - 1) * F.lit(float(q))
        for r in (F.floor(at), F.ceil(at)):
            wanted.append((r >= F.col("_p")) & (r < F.col("_p") + F.col("_t")))
    keep = wanted[0]
    for w in wanted[1:]:
        keep = keep | w
    hit = totals.where(keep).select(*by, CHUNK, "_p")
    detail = _left_on(hit, placed, [*by, CHUNK])
    inside = Window.partitionBy(*by, CHUNK).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = detail.withColumn("_end", F.sum("_k").over(inside) + F.col("_p")).withColumn("_start", F.col("_end") - F.col("_k"))
    aggs = []
    for name, q in outputs.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        value_at = [F.max(F.when((r >= F.col("_start")) & (r < F.col("_end")), F.col("_v"))) for r in (low, high)]
        part = F.max(at - low)
        aggs.append((value_at[0] + (value_at[1] - value_at[0]) * part).alias(name))
    return ranked.groupBy(*by).agg(*aggs)


def exact_percentiles_of(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact percentiles of several columns in one pass: ``{output: (column, q)}``."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    quantiles = {f"_q{i}": q for i, q in enumerate(dict.fromkeys(q for _, q in wanted.values()))}
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    long = df.select(*by, items.alias("_i")).select(*by, F.col("_i.c").alias("_name"), F.col("_i.v").alias("_val"))
    found = exact_percentiles(long, [*by, "_name"], "_val", quantiles)
    slot = {q: n for n, q in quantiles.items()}
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == c, F.col(slot[q]))).alias(out) for out, (c, q) in wanted.items()])


def _left_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on null-safe equality of ``keys`` (or a cross join with one row)."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # the key-less summary has exactly one row
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = term if cond is None else cond & term
    return left.join(renamed, cond, "left").drop(*[f"_r_{k}" for k in keys])
