"""Library operators on small frames, with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sedge.functions import text as T, vectors as V
from sedge.operators import estimators as E, ordered as O, predicates as P, tables as K
from sedge.operators.components import components
from sedge.session import stored
from sedge.sources import html


def one(spark, c, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(c.alias("x")).first().x


def test_text(spark):
    c = F.col("t")
    assert one(spark, T.symbol_key(c), t="  Ünï-code, 2 Words! ") == "ünï code 2 words"
    assert one(spark, T.fold(c), t="Đường Ế") == "duong e"
    assert one(spark, T.overlap(T.token_set(T.fold(c)), T.token_set(T.fold(F.lit("giac mo nuoc")))), t="Giấc mơ NƯỚC") == 1.0
    for word, want in (("stories", "story"), ("running", "run"), ("stopped", "stop"), ("boxes", "boxe"), ("foxholes", "foxhol"), ("dreams", "dream"), ("gas", "gas")):
        assert one(spark, T.stem(c), t=word) == want
    assert one(spark, T.excerpt(c, 5), t="abc  def") == "abc …"
    assert one(spark, T.js_round(c), t=-2.5) == -2
    assert one(spark, T.isbn10(c), t="0-306-40615-2") and not one(spark, T.isbn10(c), t="0-306-40615-3")
    assert one(spark, T.isbn13(c), t="978-0-306-40615-7") and not one(spark, T.isbn13(c), t="978-0-306-40615-8")
    assert one(spark, T.clean_claim(c), t="- **Bold** [link](http://x) says  <b>so</b> [?] .") == "Bold link says so."
    assert one(spark, T.redacted(c), t='Bearer abc.def otp 123456 {"token": "x"}') == 'Bearer [REDACTED] otp [REDACTED] {"token": "[REDACTED]"}'
    assert one(spark, T.redacted(c), t="call 123456") == "call 123456"
    assert one(spark, T.sentences(c), t="One. Two!\nThree") == ["One.", "Two!", "Three"]
    for line, key in (("Page 3 of  9", "page #"), ("12", "#"), ("Total 45 of 60 items, 7", "total 45 of 60 items #"), ("3 Results: p. 4/9 (x)", "# results p # x"), ("stop 3a", "stop 3a")):
        assert one(spark, T.line_key(c), t=line) == key
    assert one(spark, T.fold(c), t="E\u0302\u0301 đ") == "e d" and one(spark, T.normal_url(c), t=" HTTPS://www.X.org/a/#b/ ") == "x.org/a/#b"
    assert one(spark, T.strip_markup(c), t="<b>a</b> &amp; b") == "a & b"


def test_vectors(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, V.cosine(a(1, 0), a(1, 0))) == 1.0
    assert one(spark, V.cosine(a(0, 0), a(1, 0))) == -1.0
    assert one(spark, V.cosine(a(1, 0), a(1, 0, 0))) == -1.0
    assert one(spark, V.blended(F.lit(False), F.lit(0.8), F.lit(0.4))) == pytest.approx(0.74)
    assert one(spark, V.blended(F.lit(True), F.lit(0.1), F.lit(0.1))) == 1.0


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", True, None), (2, "b", True, "private"), (3, "b", False, None), (4, "a", None, "private")], "id int, o string, p boolean, v string")
    ids = lambda viewer: sorted(r.id for r in df.where(P.visible_to(viewer, F.col("o"), F.col("p"), F.col("v"))).collect())
    assert ids(None) == [1] and ids("a") == [1, 4] and ids("b") == [1, 2, 3]
    assert one(spark, P.phrase(F.col("t"), "a.b c"), t="xx A.B   C") and not one(spark, P.phrase(F.col("t"), "a.b"), t="axb")
    assert one(spark, P.holds_none(F.lit(None).cast("array<int>"), 3))
    assert one(spark, P.holds_all(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))))


def test_ordered(spark):
    days = spark.createDataFrame([(1, dt.date(2024, 1, d)) for d in (1, 2, 3, 5, 6, 6)], "u int, d date")
    assert sorted((r.days for r in O.streaks(days, "u", "d").collect())) == [2, 3]
    at = [dt.datetime(2024, 1, 1, 0, 0, s) for s in (0, 20, 40, 50)] + [dt.datetime(2024, 1, 2, 0, 0, 0)]
    beats = spark.createDataFrame([(1, t) for t in at], "u int, t timestamp_ntz")
    assert [r.at.second for r in O.accepted(beats, "u", "t", 45).orderBy("at").collect()] == [0, 50, 0]
    seq = spark.createDataFrame([(1, i, n) for i, n in enumerate((5, 5, 5, 20, 1))], "k int, i int, n int")
    assert [r.bin for r in O.packed(seq, "k", "i", "n", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    assert [r.i for r in O.budget_tail(seq, "k", "i", F.col("n"), 21).orderBy("i").collect()] == [3, 4]
    toks = spark.createDataFrame([(1, list(map(str, range(25))))], "k int, t array<string>")
    assert [(r.start, len(r.tokens)) for r in O.sliding(toks, "k", "t", 10, 8, 2).orderBy("chunk").collect()] == [(0, 10), (8, 10), (16, 9)]
    w = O.first_event_windows(beats, "u", "t", 45, 2).orderBy("at").collect()
    assert [(r["count"], r.allowed) for r in w] == [(1, True), (2, True), (3, False), (1, True), (1, True)]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, K.upserted(old, new, ["k"], ["v"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, K.inserted_if_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert K.same_rows(old, old) and not K.same_rows(old, new)
    K.atomic_replace(old, str(tmp_path / "x"), "k")
    K.atomic_replace(new.where("k = 2"), str(tmp_path / "x"), "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "x")).collect()) == [(1, "a"), (2, "c")]


def test_estimates(spark):
    none = F.lit(None).cast("double")
    assert one(spark, E.import_seconds(F.lit(10), F.lit(0), F.lit(False), none)) == 24
    assert one(spark, E.import_seconds(F.lit(10), F.lit(0), F.lit(False), F.lit((100 - 18) / 10))) == 81
    assert one(spark, E.application_tier(F.lit(80), F.lit(1))) == "exploratory" and one(spark, E.application_tier(F.lit(60), F.lit(2))) == "supported"
    assert [one(spark, E.streak_points(F.lit(d))) for d in (1, 10, 11, 300)] == [10, 11, 13, 35]
    assert one(spark, E.interval_error(F.lit(10.0), F.lit(20.0), F.lit(25.0))) == 20.0


def test_retrieval_metrics(spark):
    claims = [("x", ["a"], True), ("y", [], False)]
    df = spark.createDataFrame(
        [("1", ["a", "b"], ["c", "a"], [], claims, 0.75), ("2", [], [], ["z"], [], 2.0), ("3", ["a"], ["z", "a"], ["z"], [], None)],
        "id string, relevant array<string>, retrieved array<string>, forbidden array<string>, claims array<struct<text:string,citationIds:array<string>,supported:boolean>>, relevance double",
    )
    got = {r.id: r for r in E.retrieval_metrics(df).collect()}
    assert tuple(got["1"])[1:] == (0.5, 0.5, 0.5, 0.5, 0.5, True, 0.75)
    assert tuple(got["2"])[1:7] == (0.0, 1.0, 0.0, 1.0, 1.0, True)
    assert not got["3"].privacy and got["3"].recall == 1.0


def test_components(spark):
    pairs = [(1, 2), (2, 3), (5, 4), (9, 9), (7, None)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(31)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_html(spark):
    got = html.read("<nav>x</nav><h2>Head</h2><p>One <b>two</b></p><p>One two</p><ul><li>a<li>b</ul>tail")
    assert [(k, t) for k, _, t in got] == [("heading", "Head"), ("paragraph", "One two"), ("paragraph", "One two"), ("list_item", "a"), ("list_item", "b"), ("paragraph", "tail")]
    pages = spark.createDataFrame([(1, "<p>a</p><p>a</p>"), (2, None)], "page_id long, html string")
    assert html.blocks(pages).count() == 1


def test_stored(spark):
    assert stored(spark.range(3)).count() == 3
