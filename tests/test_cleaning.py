"""Cleaning functions and estimates, with values worked out by hand or by plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sedge.functions import cleaning as L
from sedge.operators import estimators as E


def many(spark, c, values):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string").orderBy("i").select(c.alias("x")).collect()]


def test_cleaning(spark):
    c = F.col("t")
    codes = {"VIE": "vi", " English ": "en", "fr-FR": "fr", "pt_br": "pt", "unknown": None, "": None, "klingon": None, "x1": None, "Tiếng Việt": "vi"}
    assert many(spark, L.language_code(c), list(codes)) == list(codes.values())
    cells = {"": True, " 3.5 ± 0.2 ": True, "[1, 2–4]": True, "(Smith, 2020a)": True, "doi: 10.1234/x.y": True, "https://doi.org/10.1000/a": True, "p < 0.05": True, "χ² = 3.1": True, "95% CI [0.1, 0.2]": True, r"\alpha{x}": True, "mean 3": False, "p is low": False}
    assert many(spark, L.plain_cell(c), list(cells)) == list(cells.values()) and many(spark, L.plain_cell(c), [None]) == [True]
    captions = {"Supplementary Fig. 3A shows": "3a", "Bảng 12": "12", "Tabs. 4": "4", "Tables 4": "", "none 5": ""}
    assert many(spark, L.caption_number(c), list(captions)) == list(captions.values())
    lines = {"a ﬁne\n  day": "a fine day", "infor-\nmation": "information", "a Self-\nreport of pre-\n  2020": "a Self-report of pre- 2020", "x\n\n y": "x y", "": "", "myself-\nmade": "myselfmade", "end -\nnext": "end - next"}
    assert many(spark, L.reflowed(c), list(lines)) == list(lines.values())
    assert many(spark, L.like_case(c, F.lit("word")), ["ABC", "Abc", "abc", "12"]) == ["WORD", "Word", "word", "word"]
    assert many(spark, L.year(c), [" 1999 ", "99", "n.d.", "3000", None]) == [1999, None, None, None, None]
    assert many(spark, L.signal(c, [("a", ["x", "y"], [], ["z"]), ("b", [], ["p", "q"], [])], "none"), ["yx", "xyz", "q", "xyzp", ""]) == ["a", "none", "b", "b", "none"]


def plain_interval(samples):
    lower = lambda a: sorted(a)[(len(a) - 1) // 2]
    m = lower(samples)
    d = lower([abs(v - m) for v in samples])
    near = [v for v in samples if d == 0 or abs(v - m) <= 3.5 * d]
    m = lower(near)
    d = lower([abs(v - m) for v in near])
    return max(5000, int(m * 0.72 + 0.5)), max(15000, int(m + min(m * 0.08, d * 0.25) + 0.5))


def test_estimates(spark):
    rng = random.Random(2)
    rows = [([rng.uniform(1000, 90_000) for _ in range(rng.randint(1, 16))] + ([1_000_000.0] if i % 3 else []),) for i in range(60)]
    got = spark.createDataFrame(rows, "a array<double>").select("a", E.run_interval(F.col("a")).alias("r")).collect()
    assert [tuple(r.r) for r in got] == [plain_interval(r.a) for r in got]
    history = spark.createDataFrame([("d", 1, 100.0, 10, False, True), ("d", 2, 9.0, 10, False, False), ("d", 3, 500.0, 10, True, True)], "d string, order int, seconds double, pages int, ocr boolean, succeeded boolean")
    rate = E.page_rate(history, ["d"]).where("not ocr")
    assert rate.select(E.import_seconds(F.lit(10), F.lit(0), F.lit(False), F.col("rate")).alias("x")).first().x == 81
    assert many(spark, E.import_seconds(F.lit(10), F.lit(0), F.lit(False), F.lit(None).cast("double")), ["x"]) == [24]
    assert many(spark, E.analysis_seconds(F.lit(1000), F.lit(None).cast("double")), ["x"]) == [105] and many(spark, E.analysis_seconds(F.lit(1000), F.lit(0.1)), ["x"]) == [133]
    assert many(spark, E.scaled_duration(F.lit(1000.0), F.lit(0), F.lit(100_000)), ["x"]) == [pytest.approx(1650)]
