"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at ``virtual_nodes`` points of a ring of 2 ** 32 places;
a key belongs to the first point at or after its hash. Shards have quotas:
with ``slack`` 0 the number of rows over the number of shards, the first
shards taking the rest, so counts are at most one apart; else up to
1 + slack times that. A key whose shard is full goes on clockwise to the
next point with room. Most keys stay with the owner of their arc, so a
further shard moves few rows besides those it takes.

Only counts walk the ring. Rows stand in clockwise order (hash, key, size,
checksum); each point, in order, takes from the rows before it that are
still waiting, oldest first, what its shard has room for, so it takes one
interval of that order. One fold over the counts of all arcs, twice round
the ring (rows past the last point go on at the first; after one more round
every shard was offered the rest), gives these intervals. Its size is the
ring's, shards times virtual nodes, whatever the number of rows. A row then
finds the interval that holds its number.

Native DataFrame functions only. Texts are read once, for size and checksum;
the slim rows are stored, numbered by ``ordinal`` (one range shuffle, cut by
a sample, with ties told apart, so a repeated key is dealt too) and meet
the intervals by blocks of numbers, whose table has the ring's size as well.

Edge cases: a null key is a key like any other; a null text has no bytes and
checksum 0; rows with equal key, size and checksum change places without
effect; an empty table gives no rows; fewer rows than shards leave shards
empty; extra columns are left out unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators.shaping import ordinal
from parley.session import stored

#: Places of the ring.
RING = 1 << 32
VIRTUAL_NODES = 256
#: Bytes that a row takes besides its text.
OVERHEAD = 16


def place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(RING))


def points(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """(at, shard, arc): the ring's points, numbered clockwise; of two at
    one place the lower shard's counts."""
    p = spark.range(shards * virtual_nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        place(F.concat_ws("#", (F.col("id") % shards).cast("string"), F.floor(F.col("id") / shards).cast("string"))).alias("at"))
    p = p.groupBy("at").agg(F.min("shard").alias("shard"))
    return p.withColumn("arc", F.row_number().over(Window.orderBy("at")) - 1)      # of the ring's size


def _arcs(rows: DataFrame, ring: DataFrame, cells: int) -> DataFrame:
    """Rows with the arc that holds their place: points per cell of the
    ring as a sorted list, and the points before the cell."""
    width = RING // cells
    by_cell = ring.groupBy(F.floor(F.col("at") / width).alias("cell")).agg(F.array_sort(F.collect_list("at")).alias("ats"))
    table = rows.sparkSession.range(cells).select(F.col("id").alias("cell")).join(by_cell, "cell", "left") \
        .withColumn("ats", F.coalesce("ats", F.array().cast("array<bigint>")))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("base", F.coalesce(F.sum(F.size("ats")).over(before), F.lit(0)))
    n = F.sum(F.size("ats")).over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    table = table.withColumn("n_arcs", n).withColumnRenamed("cell", "_cell")
    found = rows.withColumn("_cell", F.floor(F.col("at") / width)).join(F.broadcast(table), "_cell")     # cells rows
    arc = F.col("base") + F.size(F.filter("ats", lambda a: a < F.col("at")))
    return found.withColumn("arc", (arc % F.col("n_arcs")).cast("int")).drop("_cell", "ats", "base", "n_arcs")


def walk(counts: DataFrame, ring: DataFrame, shards: int, slack: float) -> DataFrame:
    """(step, shard, taken) of each point twice round the ring, from the
    rows (arc, n) of the arcs."""
    arcs = ring.join(counts, "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    lap = F.array_sort(F.collect_list(F.struct("arc", "shard", "n")))
    again = F.transform(lap, lambda x: F.struct(x["arc"], x["shard"], F.lit(0).cast("long").alias("n")))
    one = arcs.agg(F.concat(lap, again).alias("laps"), F.sum("n").alias("total"))
    rest = F.col("total") % shards
    quota = (lambda s: F.floor(F.col("total") / shards) + F.when(s < rest, 1).otherwise(0)) if not slack else \
        (lambda s: F.ceil(F.col("total") * (1 + slack) / shards))
    free = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: quota(s).cast("long"))
    none = F.array().cast("array<bigint>")

    def offer(state: Column, x: Column) -> Column:
        waiting = state["waiting"] + x["n"]
        take = F.least(waiting, F.get(state["free"], x["shard"]))
        left = F.transform(state["free"], lambda f, s: F.when(s == x["shard"], f - take).otherwise(f))
        return F.struct(left.alias("free"), (waiting - take).alias("waiting"),
                        F.concat(state["taken"], F.array(take)).alias("taken"))

    start = F.struct(free.alias("free"), F.lit(0).cast("long").alias("waiting"), none.alias("taken"))
    one = one.withColumn("taken", F.aggregate("laps", start, offer, lambda end: end["taken"]))
    one = one.withColumn("shard", F.col("laps.shard"))
    steps = one.select(F.posexplode(F.arrays_zip("taken", "shard")).alias("step", "x"))
    return steps.select("step", "x.shard", "x.taken").where("taken > 0")


def _intervals(steps: DataFrame, width: Column) -> DataFrame:
    """(block, list): the intervals of row numbers that meet each block of
    ``width`` numbers; ``slot``: of an interval's first row in its shard."""
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    mine = Window.partitionBy("shard").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    cut = steps.select("shard", F.coalesce(F.sum("taken").over(upto), F.lit(0)).alias("lo"), "taken",
                       F.coalesce(F.sum("taken").over(mine), F.lit(0)).alias("slot"))
    cut = cut.withColumn("hi", F.col("lo") + F.col("taken")).withColumn("width", width)
    block = F.explode(F.sequence(F.floor(F.col("lo") / F.col("width")), F.floor((F.col("hi") - 1) / F.col("width"))))
    return cut.select("shard", "lo", "hi", "slot", block.alias("block")) \
        .groupBy("block").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot")).alias("cuts"))


def assign(docs: DataFrame, shards: int, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0, key: str = "doc_id",
           carry: tuple[str, ...] = ()) -> DataFrame:
    """Every row's shard and slot, its place in the shard from 0: columns
    key, size, text_crc32, shard, slot and, of those named in ``carry``, the
    struct ``carried``."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    slim = docs.select(F.col(f"`{key}`").alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
                       F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
                       place(F.col(f"`{key}`").cast("string")).alias("at"),
                       *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])
    cells = 1 << max(0, (shards * virtual_nodes - 1).bit_length() - 1)
    ring = stored(points(spark, shards, virtual_nodes), "ring")
    rows = ordinal(_arcs(stored(slim, "slim"), ring, cells), ["arc", "at", "key", "size", "text_crc32"], name="number",
                   tie=F.monotonically_increasing_id())
    rows = rows.withColumn("number", F.col("number") - 1)
    steps = stored(walk(rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")), ring, shards, slack), "ring-steps")
    total = steps.agg(F.sum("taken")).first()[0] or 0
    width = max(1, -(-total // cells))
    cuts = _intervals(steps, F.lit(width))
    placed = rows.withColumn("block", F.floor(F.col("number") / width)).join(F.broadcast(cuts), "block")  # cells rows
    cut = F.get(F.filter("cuts", lambda c: (F.col("number") >= c["lo"]) & (F.col("number") < c["hi"])), F.lit(0))
    placed = placed.withColumn("cut", cut)
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.col("cut.shard").alias("shard"),
                         (F.col("cut.slot") + F.col("number") - F.col("cut.lo")).cast("long").alias("slot"),
                         *([F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)]).alias("carried")] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> str:
    """All columns of docs as Parquet, a folder for each shard; returns the
    name of the folders' column, ``shard`` with underscores if docs has one."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    placed = assign(docs, shards, carry=tuple(docs.columns), **options)
    placed.select("carried.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
