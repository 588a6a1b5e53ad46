"""Blocks of hot keys: equal row counts whatever the instants, results that do not depend on them."""

import random

import pytest
from pyspark.sql import functions as F

from kickline.operators import windows
from kickline.operators.asof import History, asof_attach
from kickline.operators.blocks import BLOCK, HOT, ROWS_PER_BLOCK, hot_spans, with_block


@pytest.fixture()
def limit(spark):
    spark.conf.set(ROWS_PER_BLOCK, "40")
    yield 40
    spark.conf.unset(ROWS_PER_BLOCK)


def rows():
    r = random.Random(2)
    out = [("burst", r.randrange(10**9) if i % 2 else 500_000_000 + r.randrange(1000), i, r.randrange(50)) for i in range(800)]
    out += [("second", 7, i, r.randrange(50)) for i in range(600)]  # all rows at one instant
    out += [("mixed", 100 if i % 3 else i, i // 2, r.randrange(50)) for i in range(400)]  # repeated ties
    out += [("cold", i, i, i) for i in range(30)] + [(None, i // 4, i, 1) for i in range(90)] + [("second", None, 5, 1)]
    r.shuffle(out)
    return out


def frame(spark):
    return spark.createDataFrame(rows(), "k string, t long, tie long, x long").repartition(5)


def test_blocks_hold_about_equal_rows(spark, limit):
    df = frame(spark)
    spans = hot_spans(df, ["k"], ["t", "tie"])
    sized = with_block(df, ["k"], ["t", "tie"], spans).groupBy("k", BLOCK, HOT).count().collect()
    assert {r.k for r in sized if r[HOT]} == {"burst", "second", "mixed", None} and all(r["count"] <= limit for r in sized)
    assert len([r for r in sized if r.k == "second"]) >= 600 / limit
    # without a tie-break equal instants stay together, all else is cut
    alone = with_block(df, ["k"], "t", hot_spans(df, ["k"], "t")).groupBy("k", BLOCK).count().collect()
    assert max(r["count"] for r in alone if r.k == "burst") <= limit and sorted(r["count"] for r in alone if r.k == "second") == [601]
    assert hot_spans(df.filter("k = 'cold'"), ["k"], ["t", "tie"]) is None and hot_spans(df.limit(0), ["k"], "t") is None


def test_blocks_follow_the_order(spark, limit):
    df = frame(spark).withColumn("tie", F.when(F.col("tie") % 11 != 0, F.col("tie")))
    got = with_block(df, ["k"], ["t", "tie"], hot_spans(df, ["k"], ["t", "tie"])).collect()
    low = -1
    for k in {r.k for r in got}:
        order = [r[BLOCK] for r in sorted((r for r in got if r.k == k), key=lambda r: (low if r.t is None else r.t, low if r.tie is None else r.tie))]
        assert order == sorted(order)


def test_windows_equal_their_whole_form(spark, limit):
    df = frame(spark).withColumn("tie", F.col("tie") * 1000 + F.col("x"))  # one order of the rows of a key
    df = df.dropDuplicates(["k", "t", "tie"])

    def all_of(split):
        a = windows.rolling_mean(df, ["k"], ["t", "tie"], {"m3": ("x", 3), "m9": ("x", 9)}, split=split)
        a = windows.running(a, ["k"], ["t", "tie"], sums={"s": "x"}, maxima={"top": "x"}, ordinal="n", split=split)
        return sorted(map(str, a.select("k", "t", "tie", "x", "m3", F.round("m9", 9).alias("m9"), "s", "top", "n").collect()))
    assert all_of(True) == all_of(False)
    objectives = df.select("k", (F.col("t") + 1).alias("at"), "tie").distinct()

    def seen(split):
        return sorted(map(str, asof_attach(objectives, ["k"], "at", [History(df, "t", ["x"], tie="tie", used_time="u")], split=split).collect()))
    assert seen(True) == seen(False)
