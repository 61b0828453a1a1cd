"""Grouped statistics: exact quantiles, describe, histogram, KDE, box
statistics, IQR filtering, duplicate groups and corpus profile."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.text import normalise_text, space_words
from parley.operators.shaping import join_groups
from parley.session import stored
from parley.schemas import IQR_FACTOR, KDE_CUT, KDE_POINTS, READERS, READING_WPM


# -- exact quantiles -----------------------------------------------------------

def value_counts(df: DataFrame, keys: list[str], value: str, slices: int | None = None) -> DataFrame:
    """(keys, v, c, _slice): distinct non-NULL, non-NaN values per group
    with their counts, computed in one pass and stored by ranges of (keys,
    v), so later branches neither recompute the input nor carry its plan.
    ``_slice`` numbers the ranges upwards."""
    v = df.select(*keys, F.col(value).cast("double").alias("v"))
    v = v.where(F.col("v").isNotNull() & ~F.isnan("v"))
    return _sliced(v.groupBy(*keys, "v").agg(F.count("*").alias("c")), keys, slices)


def _sliced(vc: DataFrame, keys: list[str], slices: int | None = None) -> DataFrame:
    by = [*keys, "v"]
    run = vc.repartitionByRange(*([slices] if slices else []), *by).sortWithinPartitions(*by)
    return stored(run.withColumn("_slice", F.spark_partition_id()), "value-counts")


def _values_at(vc: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """Values of 0-based ranks (keys, _r): (keys, _r, _v).

    A group's slices are in order, so running sums over one count per
    (group, slice) tell which slice holds a rank; all ranks are then picked
    in the same pass over the slices that hold one."""
    sums = vc.groupBy(*keys, "_slice").agg(F.sum("c").alias("_sc"))
    sums = sums.withColumn("_upto", F.sum("_sc").over(Window.partitionBy(*keys).orderBy("_slice")))
    first = F.col("_upto") - F.col("_sc")
    held = (ranks.join(sums, keys).where((first <= F.col("_r")) & (F.col("_r") < F.col("_upto")))
            .groupBy(*keys, "_slice").agg(F.collect_list(F.struct("_r", (F.col("_r") - first).alias("at"))).alias("_want")))
    run = vc.join(held, [*keys, "_slice"]).withColumn("_cum", F.sum("c").over(Window.partitionBy(*keys, "_slice").orderBy("v")))
    here = F.filter("_want", lambda x: (F.col("_cum") - F.col("c") <= x["at"]) & (x["at"] < F.col("_cum")))
    return run.select(*keys, "v", F.explode(here).alias("_x")).select(*keys, F.col("_x._r").alias("_r"), F.col("v").alias("_v"))


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    buckets: int | None = None, levels: int = 1, counts: DataFrame | None = None) -> DataFrame:
    """Exact quantiles per group with linear interpolation between order
    statistics (numpy 'linear', Spark ``percentile``, DuckDB
    ``quantile_cont``): one row per group, one column per name in
    ``probs``. NULL and NaN values are ignored.

    Values are first reduced to (group, value, count) in range slices
    (``value_counts``; pass ``counts`` to reuse one); the order statistics
    of all groups are then picked in one pass (``_values_at``). A task holds
    one slice: ``buckets ** levels`` of them are made, or as many as the
    session's shuffle partitions.
    """
    slices = buckets ** levels if buckets else None
    vc = value_counts(df, keys, value, slices) if counts is None else counts
    if "_slice" not in vc.columns:
        vc = _sliced(vc, keys, slices)
    per = vc.groupBy(*keys).agg(F.sum("c").alias("_n"))
    at = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in probs.items()}
    ends = F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)])
    ranks = per.select(*keys, F.explode(F.array_distinct(ends)).alias("_r"))
    found = _values_at(vc, keys, ranks).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_vals"))
    out = {}
    for name, x in at.items():
        lo, hi = (F.element_at("_vals", f(x).cast("long")) for f in (F.floor, F.ceil))
        out[name] = lo + (x - F.floor(x)) * (hi - lo)
    return per.join(found, keys).select(*keys, *[c.alias(name) for name, c in out.items()])


def moments(vc: DataFrame, keys: list[str]) -> DataFrame:
    """count, mean, std (n-1), min, max per group of a (keys, v, c) table;
    std = sqrt(sum c (v - mean)^2 / (n - 1)) with the mean joined back."""
    m = vc.groupBy(*keys).agg(F.sum("c").alias("count"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"),
                              F.min("v").alias("min"), F.max("v").alias("max"))
    d = F.col("v") - F.col("mean")
    dev = (join_groups(vc, m.select(*keys, "mean"), keys, ["v"])
           .groupBy(*keys).agg(F.sum(F.col("c") * d * d).alias("_m2")))
    std = F.when(F.col("count") > 1, F.sqrt(F.col("_m2") / (F.col("count") - 1)))
    return m.join(dev, keys).select(*keys, "count", "mean", std.alias("std"), "min", "max")


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """E-7: count, mean, std (n-1), min, 25/50/75 %, max per group, all
    from one (group, value, count) table: the input is read once."""
    vc = value_counts(df, keys, value)
    q = group_quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, counts=vc)
    return moments(vc, keys).join(q, keys, "left").select(
        *keys, F.col("count").cast("long").alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max")


def long_scores(df: DataFrame, keys: list[str], metrics: list[str],
                name: str = "metric", value: str = "score") -> DataFrame:
    """G-7 / F-7: wide score columns -> (keys..., metric, score)."""
    cast = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(keys, metrics, name, value)


# -- histogram -------------------------------------------------------------------

def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """F-1: numpy 'auto' bins per group (width = min of Sturges and
    Freedman-Diaconis, Sturges when the IQR is 0), counts per bin with the
    last edge inclusive, empty bins kept. (keys, bin, lo, hi, n)."""
    vc = value_counts(df, keys, value)
    st = vc.groupBy(*keys).agg(F.sum("c").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    q = group_quantiles(df, keys, value, {"q25": 0.25, "q75": 0.75}, counts=vc)
    st = st.join(q, keys)
    n, mn, mx = F.col("n"), F.col("mn"), F.col("mx")
    ptp = mx - mn
    sturges = ptp / (F.log2(n) + F.lit(1.0))
    fd = F.lit(2.0) * (F.col("q75") - F.col("q25")) * F.pow(n, F.lit(-1.0 / 3.0))
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    nb = F.when(width > 0, F.ceil(ptp / width)).otherwise(F.lit(1)).cast("long")
    lo = F.when(ptp == 0, mn - 0.5).otherwise(mn)
    hi = F.when(ptp == 0, mx + 0.5).otherwise(mx)
    edges = st.select(*keys, nb.alias("nb"), lo.alias("lo"), hi.alias("hi"))
    j = join_groups(vc, edges, keys, ["v"]).withColumnRenamed("v", "x")
    edge = lambda i: F.col("lo") + i * ((F.col("hi") - F.col("lo")) / F.col("nb"))
    b0 = F.least(F.floor((F.col("x") - F.col("lo")) * (F.col("nb") / (F.col("hi") - F.col("lo")))),
                 F.col("nb") - 1)
    j = j.withColumn("b", b0)
    j = j.withColumn("b", F.when(F.col("x") < edge(F.col("b")), F.col("b") - 1).otherwise(F.col("b")))
    j = j.withColumn("b", F.when((F.col("x") >= edge(F.col("b") + 1)) & (F.col("b") != F.col("nb") - 1),
                                 F.col("b") + 1).otherwise(F.col("b")))
    counts = j.groupBy(*keys, "b").agg(F.sum("c").alias("cnt"))
    grid = edges.select(*keys, "nb", "lo", "hi", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b"))
    out = grid.join(counts, keys + ["b"], "left")
    return out.select(*keys, F.col("b").cast("long").alias("bin"), edge(F.col("b")).alias("lo"),
                      edge(F.col("b") + 1).alias("hi"), F.coalesce("cnt", F.lit(0)).cast("long").alias("n"))


# -- kernel density --------------------------------------------------------------

def kde(df: DataFrame, keys: list[str], value: str, points: int = KDE_POINTS,
        cut: float = KDE_CUT) -> DataFrame:
    """F-2: Gaussian KDE per group, each group normalised on its own.

    h = sd * n^(-1/5) (Scott), grid of ``points`` from min-cut*h to
    max+cut*h. Exact: equal values are counted first, then every distinct
    value adds its weighted kernel to all grid points; the per-grid-point
    sums are partial aggregates (map side), so the shuffle carries at most
    groups x points rows per task. Groups with n < 2 or sd = 0 give no rows.
    """
    vc = value_counts(df, keys, value)
    st = moments(vc, keys).select(*keys, F.col("count").alias("n"), F.col("std").alias("sd"),
                                  F.col("min").alias("mn"), F.col("max").alias("mx"))
    st = st.where((F.col("n") >= 2) & (F.col("sd") > 0))
    h = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    st = st.select(*keys, "n", h.alias("h"), (F.col("mn") - F.lit(cut) * h).alias("g0"),
                   (F.col("mx") + F.lit(cut) * h).alias("g1"))
    step = (F.col("g1") - F.col("g0")) / F.lit(points - 1)
    j = join_groups(vc, st, keys, ["v"]).select(*keys, F.col("v").alias("x"), F.col("c").alias("w"), "n", "h", "g0", step.alias("step"),
                                 F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    gx = F.col("g0") + F.col("i") * F.col("step")
    z = (gx - F.col("x")) / F.col("h")
    contrib = F.col("w") * F.exp(F.lit(-0.5) * z * z)
    dens = j.groupBy(*keys, "i").agg(F.sum(contrib).alias("s"), F.first("n").alias("n"),
                                     F.first("h").alias("h"), F.first("g0").alias("g0"),
                                     F.first("step").alias("step"))
    norm = F.col("n") * F.col("h") * F.lit(math.sqrt(2.0 * math.pi))
    return dens.select(*keys, F.col("i").cast("long").alias("point"),
                       (F.col("g0") + F.col("i") * F.col("step")).alias("x"),
                       (F.col("s") / norm).alias("density"))


# -- box statistics / outliers ---------------------------------------------------

def fences(df: DataFrame, keys: list[str], value: str, factor: float = IQR_FACTOR,
           counts: DataFrame | None = None) -> DataFrame:
    q = group_quantiles(df, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, counts=counts)
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, "q1", "q2", "q3", (F.col("q1") - F.lit(factor) * iqr).alias("lo_fence"),
                    (F.col("q3") + F.lit(factor) * iqr).alias("hi_fence"))


def box_stats(df: DataFrame, keys: list[str], value: str, factor: float = IQR_FACTOR) -> DataFrame:
    """F-3: quartiles, whisker ends (most extreme observation inside the
    fences) and the number of fliers, per group, from one table of value
    counts."""
    vc = value_counts(df, keys, value)
    f = fences(df, keys, value, factor, counts=vc)
    x = F.col("v")
    inside = (x >= F.col("lo_fence")) & (x <= F.col("hi_fence"))
    agg = join_groups(vc, f, keys, ["v"]).groupBy(*keys).agg(
        F.min(F.when(inside, x)).alias("whisker_lo"), F.max(F.when(inside, x)).alias("whisker_hi"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("c"))).cast("long").alias("n_fliers"))
    return f.join(agg, keys).select(*keys, "q1", "q2", "q3", "whisker_lo", "whisker_hi", "n_fliers")


def remove_outliers(df: DataFrame, keys: list[str], value: str, factor: float = IQR_FACTOR) -> DataFrame:
    """C-6: keep rows with q1 - 1.5 IQR <= x <= q3 + 1.5 IQR of their group.
    The fence table has one row per group and is joined back."""
    f = fences(df, keys, value, factor).select(*keys, "lo_fence", "hi_fence")
    j = join_groups(df, f, keys, df.columns)
    return j.where((F.col(value) >= F.col("lo_fence")) & (F.col(value) <= F.col("hi_fence"))) \
            .drop("lo_fence", "hi_fence")


# -- duplicates and corpus profile -------------------------------------------------

def duplicate_groups(df: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """E-5: rows whose normalised text occurs more than once:
    (key, n_copies). Texts are told apart by 128 bits, two hashes with
    different seeds (two different ones meet in some 10^-17 of tables with
    10^11 texts), so only keys and hashes are shuffled, never a text; they
    are stored, so each text is made and hashed once."""
    norm = normalise_text(F.col(text), strict=strict)
    h = df.select(key, norm.alias("_t")).select(key, F.xxhash64(F.lit(1), "_t").alias("_a"), F.xxhash64(F.lit(2), "_t").alias("_b"))
    h = stored(h, "text-digests")
    multi = h.groupBy("_a", "_b").agg(F.count("*").alias("n_copies")).where(F.col("n_copies") > 1)
    return h.join(multi, ["_a", "_b"]).select(key, F.col("n_copies").cast("long").alias("n_copies"))


def duplicate_summary(dups: DataFrame) -> DataFrame:
    """Number of duplicate texts and the excess rows sum(count - 1)."""
    g = dups.groupBy("n_copies").agg(F.count("*").alias("rows"))
    return g.agg(F.sum(F.col("rows") / F.col("n_copies")).cast("long").alias("duplicate_texts"),
                 F.sum(F.col("rows") - F.col("rows") / F.col("n_copies")).cast("long").alias("excess_rows"))


def reading_stats(df: DataFrame, text: str, keys: list[str] | None = None) -> DataFrame:
    """E-6: words by single-space split; ceil of mean, median and total;
    reading hours at 236 words/minute and hours per reader of 4.

    One chain: word counts are reduced to (count, frequency) first, then one
    aggregation gives mean, total and the exact median (its buffer holds
    the distinct word counts, bounded by the longest text)."""
    keys = keys or []
    wc = df.select(*keys, F.size(space_words(text)).alias("w"))
    vc = wc.groupBy(*keys, "w").agg(F.count("*").alias("c"))
    agg = vc.groupBy(*keys).agg(
        (F.sum(F.col("w") * F.col("c")) / F.sum("c")).alias("mean"),
        F.percentile(F.col("w"), F.lit(0.5), F.col("c")).alias("median"),
        F.sum(F.col("w") * F.col("c")).alias("total"))
    hours = F.ceil(F.col("total") / F.lit(float(READING_WPM)) / F.lit(60.0))
    return agg.select(
        *keys, F.ceil("mean").cast("long").alias("mean_words"), F.ceil("median").cast("long").alias("median_words"),
        F.col("total").cast("long").alias("total_words"), hours.cast("long").alias("hours"),
        F.ceil(hours / F.lit(float(READERS))).cast("long").alias("hours_per_reader"))


def median_order(df: DataFrame, group: str, value: str) -> DataFrame:
    """E-9: groups ordered by their median (rank 1 = smallest); the window
    runs over one row per group."""
    m = group_quantiles(df, [group], value, {"median": 0.5})
    return m.withColumn("rank", F.row_number().over(Window.orderBy("median", group)).cast("long"))

