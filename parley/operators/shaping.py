"""Column shaping, positions, pivots and joins (B, D, G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.session import stored


def add_constant(df: DataFrame, **cols) -> DataFrame:
    """B-1 / B-2: constant (or typed NULL: pass ``(None, "string")``)."""
    out = {}
    for name, val in cols.items():
        if isinstance(val, tuple) and val[0] is None:
            out[name] = F.lit(None).cast(val[1])
        else:
            out[name] = F.lit(val)
    return df.withColumns(out)


def rename_positional(df: DataFrame, names: list[str]) -> DataFrame:
    """B-4: rename by position (``toDF``)."""
    return df.toDF(*names)


def rename_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """B-4: rename by map; names not present are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_trailing(df: DataFrame, k: int) -> DataFrame:
    """B-6: drop the last ``k`` columns (resolved to names first)."""
    return df.drop(*df.columns[len(df.columns) - k:]) if k else df


def flatten_struct(df: DataFrame, col: str) -> DataFrame:
    """B-9: struct column -> top-level columns."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, f"{col}.*")


#: Copies of a table with few rows per group, so that a group's rows are dealt over tasks.
SALTS = 32


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` joined to a table with few rows per group (statistics, a
    registry). The group table is repeated per salt and rows take theirs
    from the columns ``by``: a group with a third of all rows is dealt over
    ``SALTS`` tasks instead of one."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def ordinal(df: DataFrame, order: str | list[str], parts: tuple[str, ...] = (), width: int | None = None,
            name: str = "position", tie: Column | None = None) -> DataFrame:
    """1-based position of each row within ``parts`` by ``order`` (columns
    of any sortable type, nulls first), and ``_total`` rows per part: a
    ``row_number`` that never puts a whole part, or the whole table, into
    one task.

    One shuffle deals the rows to range slices of (parts, order), cut by
    Spark's sample, so sparse keys, strings and large parts give even
    slices. A sorted slice numbers its rows as it is written to the shared
    folder; what comes before a slice of a part is a running sum over one
    count per (part, slice). Null parts are a part of their own. Rows equal
    in ``order`` stay in one slice in any order, unless ``tie`` tells them
    apart (``monotonically_increasing_id()`` if ``df`` is a stored table,
    whose rows have the same number when they are read again). ``width``:
    rows wanted in a slice (counts ``df`` first); None leaves the number of
    slices to the session's shuffle partitions."""
    keys = [order] if isinstance(order, str) else list(order)
    by = [F.col(c).asc_nulls_first() for c in (*parts, *keys)]
    if tie is not None:
        df = df.withColumn("_ord_tie", tie)
        by.append(F.col("_ord_tie").asc())
    slices = [] if width is None else [max(1, -(-df.count() // width))]
    run = df.repartitionByRange(*slices, *by).sortWithinPartitions(*by).drop("_ord_tie")
    run = stored(run.withColumn("_ord_at", F.monotonically_increasing_id()), "ordinal")
    run = run.withColumn("_ord_slice", F.shiftright("_ord_at", 33))     # its slice; the rest numbers its rows
    counts = run.groupBy(*parts, "_ord_slice").agg(F.min("_ord_at").alias("_ord_first"), F.count(F.lit(1)).alias("_ord_n"))
    part = Window.partitionBy(*parts)
    before = part.orderBy("_ord_slice").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*[F.col(c).alias(f"_ord_{c}") for c in parts], F.col("_ord_slice").alias("_ord_s"),
                         (F.coalesce(F.sum("_ord_n").over(before), F.lit(0)) - F.col("_ord_first")).alias("_ord_off"),
                         F.sum("_ord_n").over(part).alias("_total"))
    same = F.col("_ord_slice") == F.col("_ord_s")
    for c in parts:
        same &= F.col(c).eqNullSafe(F.col(f"_ord_{c}"))
    return (run.join(offs, same).withColumn(name, (F.col("_ord_at") + F.col("_ord_off") + 1).cast("long"))
               .select(*[c for c in df.columns if c not in ("_ord_tie", name)], "_total", name))


def ntile_parts(df: DataFrame, order: str, n: int, name: str = "part") -> DataFrame:
    """B-14: split into ``n`` near-equal contiguous parts by ``order``; the
    first ``total % n`` parts get one row more (as ``ntile`` and numpy
    ``array_split``). Parts are 1-based."""
    p = ordinal(df, order)
    total = F.col("_total")
    q, r = F.floor(total / n), total % n
    i = F.col("position") - 1
    big = r * (q + 1)
    part = F.when(i < big, F.floor(i / (q + 1))).otherwise(r + F.floor((i - big) / q))
    return p.withColumn(name, (part + 1).cast("long")).drop("_total")


def align_by_position(left: DataFrame, right: DataFrame, order_left: str, order_right: str,
                      suffix: str = "_r") -> DataFrame:
    """D-5: attach ``right`` to ``left`` row by row in their orders (the
    positional attach of a column from another file). Key joins are the
    safe form; this keeps the positional semantics explicitly."""
    lp = ordinal(left, order_left).drop("_total")
    rp = ordinal(right, order_right).drop("_total")
    rp = rp.select("position", *[F.col(c).alias(c + suffix) for c in right.columns])
    return lp.join(rp, "position", "full")


def wide_by_position(df: DataFrame, group: str, order: str, value: str, groups: list[str]) -> DataFrame:
    """D-7 / G-4: one column per group, rows aligned by position within the
    group, ragged ends padded with NULL. Pivot values are given, so no
    extra job collects them."""
    p = ordinal(df, order, parts=(group,)).drop("_total")
    wide = p.groupBy("position").pivot(group, groups).agg(F.first(value))
    return wide.withColumnsRenamed({g: g.replace(" ", "_") for g in groups})


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """G-5: keep the first row per key by an explicit order.

    An aggregate (``min_by`` of the row) rather than a ``row_number``
    window: partial aggregation keeps one candidate per key and task
    before the shuffle, so a key holding a large share of the rows does
    not land whole in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return best.select(*keys, *[F.col("_first")[c].alias(c) for c in rest])


def key_lookup(df: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """D-8: first matching row of ``table`` per key (by ``order``), left
    joined to ``df``."""
    first = first_per_key(table, [key], order)
    return df.join(first, key, "left")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """D-4: join on all common column names."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common)


def resolve_fk(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """D-9: resolve a foreign key against a dimension; the planner chooses
    the join by the dimension's size."""
    return df.join(dim, key)
