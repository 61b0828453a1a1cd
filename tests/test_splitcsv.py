"""Quoted CSV by splits against the whole-file reader and Python's csv."""

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from parley.sources import files as FI
from parley.sources import splitcsv as C

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "c")])


def rows(n, seed):
    rng = random.Random(seed)
    field = lambda: "".join(rng.choice(["x", "yz", " ", ",", "\n", '"', "é", "\r\n", ""]) for _ in range(rng.randint(0, 12)))
    out = [[f"id{i}", field(), field()] for i in range(n)]
    out[n // 2][1] = '"' + "long, \n" * 400 + '""'                    # a record over many splits
    return out


def text_of(data, end="\n"):
    buf = io.StringIO()
    w = csv.writer(buf, lineterminator=end)
    w.writerows([["a", "b", "c"], *data])
    return buf.getvalue()


def test_ends_of_lines():
    """Against parsing the line's signs one by one."""
    def rule(line, state):
        inside, start, i = state == C.INSIDE, state == C.RECORD, 0
        plain = False
        while i < len(line):
            ch = line[i]
            if inside:
                if ch == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        inside, plain = False, True
            elif ch == ",":
                start, plain = True, False
                i += 1
                continue
            elif ch == '"' and start and not plain:
                inside = True
            start = False
            i += 1
        return C.INSIDE if inside else C.RECORD
    rng = random.Random(3)
    for _ in range(20000):
        line = "".join(rng.choice('a",') for _ in range(rng.randint(0, 9)))
        for state in (C.RECORD, C.INSIDE):
            assert C.line_end(line, state) == rule(line, state), (line, state)


@pytest.mark.parametrize("split_bytes,end", [(64, "\n"), (700, "\r\n"), (1 << 20, "\n")])
def test_splits_equal_the_whole_file(spark, tmp_path, split_bytes, end):
    """Splits far smaller than a record, and one split; two files, one
    without a last line end."""
    data = [rows(120, 1), rows(40, 2)]
    (tmp_path / "a.csv").write_text(text_of(data[0], end), newline="")
    (tmp_path / "b.csv").write_text(text_of(data[1], end)[:-len(end)], newline="")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = sorted(map(tuple, C.read_csv(spark, str(tmp_path), SCHEMA, FI.CSV_READ).collect()), key=str)
        if split_bytes == 64:
            assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 50
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    whole = sorted(map(tuple, spark.read.options(**FI.CSV_READ).schema(SCHEMA).csv(str(tmp_path)).collect()), key=str)
    assert got == whole and len(got) == 160
    assert sorted(r[0] for r in got) == sorted(r[0] for d in data for r in d)


def test_odd_files(spark, tmp_path):
    """Empty lines, quotes within fields, spaces before quotes, signs after
    a closing quote, an empty file, a header alone."""
    (tmp_path / "a.csv").write_text('a,b,c\n\n1,5" disk,"x"\n2,"a"b"c, d\n3, "q,"r"\n\n4,"",\\N\n5,"l1\n\nl3",\n')
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text("a,b,c")
    options = {**FI.CSV_READ, "mode": "PERMISSIVE"}
    got = sorted(map(tuple, C.read_csv(spark, str(tmp_path), SCHEMA, options).collect()), key=str)
    whole = sorted(map(tuple, spark.read.options(**options).schema(SCHEMA).csv(str(tmp_path)).collect()), key=str)
    assert got == whole and len(got) == 5
