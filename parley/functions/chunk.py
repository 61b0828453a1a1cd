"""Greedy newline chunking of long dialogues as one array expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.text import _c, strip_ws
from parley.schemas import MAX_DIALOGUE_CHARS


def chunk_array(text, max_length: int = MAX_DIALOGUE_CHARS) -> Column:
    """Chunks of one dialogue, in order.

    A text of at most ``max_length`` characters is one chunk, unchanged.
    A longer text is cut into its newline-separated parts, and parts are
    packed greedily: a part joins the current chunk while
    ``len(current) + len(part) < max_length`` (each part keeps its
    newline); otherwise the stripped current chunk is emitted and a new one
    starts with the part. The last chunk is always emitted. Consequences
    kept on purpose: a part longer than the limit stays one over-long
    chunk, and an over-long *first* part emits an empty chunk first.
    Runs inside the row (``aggregate``), so no shuffle and no Python.
    """
    t = _c(text)
    lim = F.lit(max_length)
    init = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, part):
        fits = F.length(acc["cur"]) + F.length(part) < lim
        return F.when(
            fits,
            F.struct(acc["done"].alias("done"), F.concat(acc["cur"], part, F.lit("\n")).alias("cur")),
        ).otherwise(
            F.struct(F.concat(acc["done"], F.array(strip_ws(acc["cur"]))).alias("done"),
                     F.concat(part, F.lit("\n")).alias("cur")))

    packed = F.aggregate(F.split(t, "\n", -1), init, step,
                         lambda acc: F.concat(acc["done"], F.array(strip_ws(acc["cur"]))))
    return F.when(F.length(t) <= lim, F.array(t)).otherwise(packed)
