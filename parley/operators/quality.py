"""A-13: constraint checks the table store does not enforce for Spark.

``check_declared`` compiles a list of declared rules (table, column, rule,
value) into one job over any number of tables. ``check_constraints`` is the
older report on three tables: each is scanned once for its row-level checks
(one aggregation with ``count_if`` per rule); key uniqueness is a grouped
count and foreign keys are anti joins. The result has one row per (table,
check), zeros kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.schemas import DECLARED, LABEL_DOMAINS, LABELS, VARCHAR_LIMITS


def _row_checks(df: DataFrame, table: str, not_null=(), lengths=None, domain=()) -> DataFrame:
    rules = {}
    for c in not_null:
        rules[f"not_null:{c}"] = F.count_if(F.col(c).isNull())
    for c, n in (lengths or {}).items():
        rules[f"max_length:{c}"] = F.count_if(F.length(c) > n)
    for c in domain:
        rules[f"domain:{c}"] = F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*LABELS))
    agg = df.agg(*[e.cast("long").alias(k) for k, e in rules.items()])
    return agg.unpivot([], list(rules), "check", "n_violations").withColumn("table_name", F.lit(table))


def _pk_check(df: DataFrame, table: str, key: str) -> DataFrame:
    dup = df.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > 1)
    return dup.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n_violations")) \
              .select(F.lit(table).alias("table_name"), F.lit(f"primary_key:{key}").alias("check"),
                      "n_violations")


def _fk_check(df: DataFrame, table: str, key: str, ref: DataFrame, ref_name: str) -> DataFrame:
    missing = df.select(key).where(F.col(key).isNotNull()).join(ref.select(key).distinct(), key, "left_anti")
    return missing.agg(F.count("*").cast("long").alias("n_violations")) \
                  .select(F.lit(table).alias("table_name"), F.lit(f"foreign_key:{key}->{ref_name}").alias("check"),
                          "n_violations")


def check_constraints(dialogues: DataFrame, sentiments: DataFrame, models: DataFrame) -> DataFrame:
    parts = [
        _row_checks(dialogues, "dialogues", not_null=("dataset", "dialogue_text", "actual_summary"),
                    lengths=VARCHAR_LIMITS["dialogues"], domain=("actual_sentiment",)),
        _pk_check(dialogues, "dialogues", "dialogue_id"),
        _row_checks(sentiments, "sentiments", lengths=VARCHAR_LIMITS["sentiments"],
                    domain=("generated_sentiment",)),
        _fk_check(sentiments, "sentiments", "dialogue_id", dialogues, "dialogues"),
        _fk_check(sentiments, "sentiments", "model_id", models, "models"),
        _row_checks(models, "models", not_null=("model_id",), lengths=VARCHAR_LIMITS["models"]),
        _pk_check(models, "models", "model_id"),
    ]
    out = parts[0].select("table_name", "check", "n_violations")
    for p in parts[1:]:
        out = out.unionByName(p.select("table_name", "check", "n_violations"))
    return out


# -- compiled rules ------------------------------------------------------------

def _breaks(col: str, rule: str, value) -> Column | None:
    """Condition of a row that breaks a row rule; None for rules on keys."""
    c = F.col(f"`{col}`")
    if rule in ("not_null", "primary_key"):
        return c.isNull()
    if rule == "max_length":
        return F.length(c) > value
    if rule == "domain":
        return c.isNotNull() & ~c.isin(*value)
    return None


def _digest(col: str) -> tuple[Column, Column]:
    """128 bits of a key, from two hashes with different seeds."""
    c = F.col(f"`{col}`").cast("string")
    return F.xxhash64(F.lit(1), c), F.xxhash64(F.lit(2), c)


def check_declared(tables: dict[str, DataFrame], declared: Sequence[tuple] = DECLARED + LABEL_DOMAINS,
                   registries: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(table_name, check, n_violations) for every declared rule of the
    tables given, zeros kept.

    Each table is scanned once. A row becomes one item with a flag per row
    rule, which partial aggregation folds to one row per task, and one item
    per key, a digest of 128 bits: its own key and the keys it refers to
    meet in one grouped count by (key space, digest), where a key counted
    twice is a duplicate and a reference without an owner an orphan. So no
    text and no key column is shuffled, and a key that a third of the rows
    refer to arrives as one count per task.

    A foreign key into a table named in ``registries`` (fixed lists of ids)
    is a row rule, a literal set. A primary key also counts as not null; a
    null reference is no orphan; a rule on a table that is not given, or a
    reference into one, is left out."""
    registries = registries or {}
    owner = {t: c for t, c, rule, _ in declared if rule == "primary_key"}
    checks: list[tuple[str, str, str, str]] = []       # table, check, tag, column of the sums
    refs: list[str] = []
    scans = []
    width = max(2 * len(declared), 1)
    tags: set[str] = set()
    for table, df in tables.items():
        flags, keys, tag = [], [], f"rows:{table}"
        for _, col, rule, value in (d for d in declared if d[0] == table):
            broken = _breaks(col, rule, value)
            if rule == "foreign_key":
                name = f"foreign_key:{col}->{value}"
                if value in registries:
                    c = F.col(f"`{col}`")
                    checks.append((table, name, tag, f"r{len(flags)}"))
                    flags.append(c.isNotNull() & ~c.isin(*registries[value]))
                elif value in tables and value in owner:
                    checks.append((table, name, f"key:{value}", f"orphans{len(refs)}"))
                    keys.append((f"key:{value}", col, len(refs)))
                    refs.append(name)
                continue
            checks.append((table, f"not_null:{col}" if rule == "primary_key" else f"{rule}:{col}", tag, f"r{len(flags)}"))
            flags.append(broken)
            if rule == "primary_key":
                checks.append((table, f"primary_key:{col}", f"key:{table}", "repeats"))
                keys.append((f"key:{table}", col, None))
        none = F.lit(None).cast("long")
        ones = [F.when(b, 1).otherwise(0).cast("long") for b in flags]
        pad = [F.lit(0).cast("long")] * width

        def item(tag_, h, own, ref, bad):
            return F.struct(F.lit(tag_).alias("tag"), h[0].alias("h1"), h[1].alias("h2"), F.lit(own).cast("long").alias("own"),
                            F.lit(ref).cast("int").alias("ref"), F.array(*(bad + pad)[:width]).alias("bad"))
        items = [item(tag, (none, none), 0, None, ones)]
        items += [F.when(F.col(f"`{c}`").isNotNull(), item(t, _digest(c), int(r is None), r, [])) for t, c, r in keys]
        scans.append(df.select(F.explode(F.array(*items)).alias("x")).where("x is not null").select("x.*"))
        tags |= {tag, *(t for t, _, _ in keys)}
    if not scans:
        raise ValueError("no tables")
    every = scans[0]
    for s in scans[1:]:
        every = every.unionByName(s)
    sums = [F.sum("own").alias("own"), *[F.sum(F.col("bad")[i]).alias(f"r{i}") for i in range(width)],
            *[F.count_if(F.col("ref") == k).alias(f"refs{k}") for k in range(len(refs))]]
    by_key = every.groupBy("tag", "h1", "h2").agg(*sums)
    total = by_key.groupBy("tag").agg(
        F.sum(F.greatest(F.col("own") - 1, F.lit(0))).alias("repeats"), *[F.sum(f"r{i}").alias(f"r{i}") for i in range(width)],
        *[F.sum(F.when(F.col("own") == 0, F.col(f"refs{k}")).otherwise(0)).alias(f"orphans{k}") for k in range(len(refs))])
    spark = every.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in sorted(tags)])).alias("tag"))     # zeros of empty tables
    rows = F.explode(F.array(*[F.when(F.col("tag") == tag, F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("check"),
                                                                    F.coalesce(F.col(col), F.lit(0)).cast("long").alias("n_violations")))
                               for t, c, tag, col in checks]))
    return wanted.join(total, "tag", "left").select(rows.alias("x")).where("x is not null").select("x.*")
