import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarack.functions import duration_label, parse_fractions, progress_bar, rate_label, run_name
from tamarack.functions.labels import progress_percent, remaining_label
from tamarack.functions.text import contains_any, marker_line, marker_placement, markers_found


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "rate,label",
    [
        (0.005, "5p00e-03"),
        (0.5, "0p5000"),
        (5.0, "5p00"),
        (0.0, "0p00e+00"),
        (0.00999, "9p99e-03"),
        (0.009999, "1p00e-02"),
        (0.00099999, "1p00e-03"),
        (0.01, "0p0100"),
        (100.0, "100p00"),
        (1.0, "1p00"),
    ],
)
def test_rate_label(spark, rate, label):
    assert one(spark, rate_label(F.col("r")), r=rate) == label


@pytest.mark.parametrize(
    "seconds,label",
    [(0.5, "0.50 seconds"), (59.99, "59.99 seconds"), (60.0, "1.00 minutes"), (3599.0, "59.98 minutes"), (7200.0, "2.00 hours")],
)
def test_duration_label(spark, seconds, label):
    assert one(spark, duration_label(F.col("s")), s=seconds) == label


def test_remaining_label(spark):
    assert one(spark, remaining_label(F.col("s")), s=59.4) == "59 seconds"
    assert one(spark, remaining_label(F.col("s")), s=90.0) == "1.5 minutes"
    assert one(spark, remaining_label(F.col("s")), s=5400.0) == "1.5 hours"


@pytest.mark.parametrize("done,total,full", [(0, 10, 0), (1, 3, 6), (10, 10, 20), (5, 0, 0), (12, 10, 20)])
def test_progress_bar(spark, done, total, full):
    bar = one(spark, progress_bar(F.col("d"), F.col("t")), d=done, t=total)
    assert bar == "█" * full + "░" * (20 - full)
    if total == 0:
        assert one(spark, progress_percent(F.col("d"), F.col("t")), d=done, t=total) == 0.0


def test_parse_fractions(spark):
    df = spark.createDataFrame([("0.1, 0.5,1",), ("0.1,x",), (None,)], "s string")
    got = [r[0] for r in df.select(parse_fractions(F.col("s"), [0.25])).collect()]
    assert got == [[0.1, 0.5, 1.0], [0.25], [0.25]]


def test_run_name(spark):
    name = one(spark, run_name(F.col("p"), F.col("t")), p="org/model-7b/", t=dt.datetime(2024, 1, 2, 3, 4, 5))
    assert name == "model-7b_20240102_030405"


def test_marker_in_two_fields_counts_once(spark):
    df = spark.createDataFrame(
        [("zz_marker", "zz_marker"), ("a", None), ("ZZ_Marker", "b"), (None, None)], "p string, r string"
    )
    fields = [F.col("p"), F.col("r")]
    assert [r[0] for r in df.select(contains_any(fields, ["zz_marker"])).collect()] == [True, False, False, False]
    loose = df.select(contains_any(fields, ["zz_MARKER"], ignore_case=True)).collect()
    assert [r[0] for r in loose] == [True, False, True, False]
    assert df.select(markers_found(fields, ["zz_marker", "a"])).first()[0] == ["a", "zz_marker"]


def test_long_watch_list_gives_the_same(spark):
    df = spark.createDataFrame([("has w7 and w150", None), ("none", "W3"), (None, None)], "p string, r string")
    fields, many = [F.col("p"), F.col("r")], [f"w{i}" for i in range(200)]
    rows = df.select(
        contains_any(fields, many), contains_any(fields, many, ignore_case=True), markers_found(fields, many)
    ).collect()
    assert [tuple(r) for r in rows] == [
        (True, True, ["w1", "w15", "w150", "w7"]),
        (False, True, []),
        (False, False, []),
    ]


@pytest.mark.parametrize(
    "text,line,place",
    [
        ("zz_marker\nx", 1, "top"),
        ("#!/bin/sh\nzz_marker\n", 2, "after_shebang"),
        ("#!/bin/sh zz_marker\n", 1, "top"),
        ("x\nzz_marker", 2, "elsewhere"),
        ("x\n\ny zz_marker zz_marker", 3, "elsewhere"),
        ("x\ny", None, "absent"),
        (None, None, "absent"),
    ],
)
def test_marker_placement(spark, text, line, place):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(marker_line(F.col("t"), "zz_marker"), marker_placement(F.col("t"), "zz_marker")).first()
    assert tuple(row) == (line, place)
