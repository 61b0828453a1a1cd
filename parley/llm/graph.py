"""Connected components of an edge list as Spark joins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parley.llm import textvec as tv
from parley.session import stored


def _least(edges: DataFrame) -> DataFrame:
    """Smallest neighbour (itself included) of every u; combined map-side."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _pairs(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (u, v), one for each of ``pairs`` of a row of ``df``. A union
    would have the whole plan of ``df`` once for each: a round of
    ``components`` then had 16 scans, and the driver held and planned them."""
    each = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return df.select(F.explode(each).alias("_x")).select("_x.u", "_x.v")


#: Nodes of the forest that a task keeps at once.
FOREST_NODES = 200_000


def _forest(batches):
    """Edges of a spanning forest of the edges that a task sees, each from
    a node to the least node of its tree: one pass with union-find, given
    out whenever it holds ``FOREST_NODES`` nodes."""
    root: dict = {}

    def find(x):
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def out(schema):
        pairs = [(x, find(x)) for x in root]
        root.clear()
        u, v = zip(*((x, r) for x, r in pairs if x != r)) if any(x != r for x, r in pairs) else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(u, schema.field(0).type), pa.array(v, schema.field(1).type)], ["u", "v"])

    schema = None
    for b in batches:
        schema = b.schema
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, c = find(u), find(v)
            if a != c:
                root[max(a, c)] = min(a, c)
        if len(root) > FOREST_NODES:
            yield out(schema)
    if root:
        yield out(schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over ``edges``
    (u, v). Nodes without an edge are not listed. Nulls are dropped.

    Each task first replaces its edges by a forest of stars. Then the
    large-star and the small-star step alternate until nothing changes; a
    round is one job, an aggregate and a join on the node each (a hot node
    is a skewed join side, which AQE splits), whose result is stored and
    counted as it is written, so lineage stays short and a lost executor
    costs one round at most (a task counted twice can only add a round).
    """
    given = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema)
    e = stored(given.mapInArrow(tv.tidy(_forest), types).distinct(), "edges")
    state = None
    while True:
        both = _pairs(e, ("u", "v"), ("v", "u"))
        large = (both.join(_least(both), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _pairs(down.join(_least(down), "u"), ("v", "m"), ("u", "m")).where("u <> v").distinct()
        seen = Observation()
        e = stored(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        new = (seen.get["n"], seen.get["sum"])
        if new == state:
            return _pairs(e, ("u", "v"), ("v", "v")).distinct().toDF("node", "label")
        state = new
