"""Lines that are cut at their commas give the fields that the CSV parser gives."""

import itertools
import random

from pyspark.sql import functions as F

from navstead.sources import scans


def test_cut_lines_equal_parsed_lines(spark, monkeypatch):
    fields = ["a", " b ", "", '""', '"c"', '" d "', '"e,f"', '"g""h"', '"i\\"j"', 'k"l', '"m"n', '"', "o\\p", "é", "1.5", '"\t"', "#x", '"q']
    lines = [",".join(c) for n in (1, 2) for c in itertools.product(fields, repeat=n)]
    draw = random.Random(0)
    lines += [",".join(draw.choice(fields) for _ in range(k)) for k in (3, 4, 5, 63, 64, 65, 80, 3000) for _ in range(20)]
    lines += [",".join(draw.choice(["a", '"c"', "", "1.5"]) for _ in range(k)) for k in (3, 64, 65, 80, 5000) for _ in range(5)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string")
    parsed = [f"c{i}" for i in range(scans.DISCLOSURE_COLUMNS)]
    want = {r.i: [r.s[c] for c in parsed] for r in rows.select("i", F.explode(F.array(F.from_csv("v", ", ".join(f"{c} string" for c in parsed)))).alias("s")).collect()}
    got = {r.i: r.f for r in scans._fields(rows, F.col("v"), "f").collect()}
    wrong = [(lines[i][:60], want[i][:5], got[i][:5]) for i in want if (got[i] + [None] * 64)[:64] != want[i] or len(got[i]) > 64]
    assert not wrong, wrong[:5]


def test_plain_and_quoted_lines_are_not_parsed(spark):
    easy = ['"100","0.25","EQUITY"', "x,y,", '"","a b",1', "a"]
    hard = ['"a,b",1', '"a""b",1', 'a"b', '"a"b', "a\\b", '"a', 'a,"', '"a"" ,b']
    rows = spark.createDataFrame([(v,) for v in easy + hard], "v string")
    assert [r[0] for r in rows.select(F.col("v").rlike(scans._HARD_LINE)).collect()] == [False] * len(easy) + [True] * len(hard)
