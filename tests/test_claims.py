"""Claims, rule ranking, relations and folds, with values worked out by hand or by plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sedge.functions import claims as C, text as T
from sedge.operators import estimators as E, evidence as V, ordered as O, retrieval as R, tables as K
from sedge.session import shared_folder

PLAN_VI, PLAN_EN = "Lập kế hoạch hành động có thể làm giảm căng thẳng.", "Action planning may support stress reduction."
WEAK = "Weak associations during dreaming may support creative thinking."


def likeness(spark, a, b):
    return spark.createDataFrame([(a, b)], "a string, b string").select(C.similarity(C.prepared(F.col("a")), C.prepared(F.col("b"))).alias("x")).first().x


def test_claims(spark):
    assert likeness(spark, PLAN_VI, PLAN_EN) >= 0.5 and likeness(spark, PLAN_VI, WEAK) <= 0.24
    assert likeness(spark, "alpha beta gamma", "beta gamma delta epsilon") == pytest.approx(2 / 3) and likeness(spark, "", "x") == 0
    rows = [(PLAN_VI,), (PLAN_EN,), ("- **Weak associations** in [dreams](u) may relate to creative thinking [?].",), ("Memory fragments in dreams and future tasks.",), ("beta alpha the alpha",)]
    got = [r.k for r in spark.createDataFrame(rows, "t string").select(C.cluster_key(F.col("t")).alias("k")).collect()]
    assert got == ["relation:action-planning__outcome:stress-reduction"] * 2 + ["mechanism:weak-association__outcome:creative-divergent-thinking", "mechanism:memory-recombination__context:future-oriented-dream", "alpha beta"]
    c = spark.createDataFrame([("c1", PLAN_VI), ("c2", WEAK), ("c3", "one two three")], "id string, text string")
    r = spark.createDataFrame([("r1", PLAN_EN), ("r2", "three two one zero"), ("r3", "")], "id string, text string")
    assert {(x.claim_id, x.rule_id) for x in R.matching_claims(c, r, 0.28).collect()} == {("c1", "r1"), ("c3", "r2")}


def test_overlapping_finds_all(spark):
    rng = random.Random(3)
    draw = lambda n: [(i, rng.sample("abcdefghijklmnopqrst", rng.randint(1, 9))) for i in range(n)]
    left, right = draw(60), draw(60)
    dfs = [spark.createDataFrame(x, "id long, items array<string>") for x in (left, right)]
    for least in (0.28, 0.5, 1.0):
        want = {(a, b) for a, x in left for b, y in right if len(set(x) & set(y)) / min(len(x), len(y)) >= least}
        assert want <= {(r.a, r.b) for r in R.overlapping(*dfs, least).collect()}


def test_rule_ranking(spark):
    shape = "id string, statement string, subject string, outcome string, conditions array<string>, tags array<string>, parts array<string>, embedding array<double>, evidence_score double, source_language string"
    rows = [
        ("match", "Threat dreams can reflect fear and avoidance.", "threat dream", "fear", [], ["threat", "fear", "being chased"], [], [1.0, 0.0], 80.0, "en"),
        ("other", "Memory may support future event construction.", "memory", "future event", [], ["memory", "future"], [], [0.0, 1.0], 95.0, "en"),
        ("never", "Threat dreams can reflect fear.", "threat dream", "fear", ["long awakening latency"], ["threat"], [], [1.0, 0.0], 80.0, "vi"),
        ("late", "Threat dreams can reflect fear.", "threat dream", "fear", ["later in the night"], ["threat"], [], [1.0, 0.0], 80.0, "vi"),
    ]
    rules = spark.createDataFrame(rows, shape)
    got = R.ranked_rules(rules, "I was chased and felt fear in the dream.", [1.0, 0.0]).orderBy(F.desc("score")).collect()
    assert [r.id for r in got] == ["match"] and got[0].score > 0.5 and not got[0].cross_language
    got = {r.id: r for r in R.ranked_rules(rules, "Chased near dawn, the fear and the threat", [1.0, 0.0]).collect()}
    assert set(got) == {"match", "late"} and got["late"].cross_language
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(C.query_language(F.lit(t))) for t in ("Tôi mơ thấy nước", "the dream", "xyz")] == ["vi", "en", "unknown"]
    assert one(C.features(F.lit("Yesterday I flew; tomorrow, in the future"))) == ["past_time", "future_time", "multiple_future_horizons"]
    assert "episodic sources" in one(C.expanded(F.lit("past and future"))) and one(C.expanded(F.lit("xyz"))) == "xyz"


def plain_jaccard(a, b):
    left, matched = list(b), 0
    for x in a:
        for y in left:
            k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            if x == y or (k >= 5 and k / min(len(x), len(y)) >= 0.75):
                left.remove(y)
                matched += 1
                break
    return matched / (len(a) + len(b) - matched) if a and b else 0


def test_relations(spark):
    rng = random.Random(5)
    words = ["memory", "memories", "memorial", "memorize", "dream", "dreamer", "dreams", "stress", "stressor", "a", "ab"]
    rows = [(rng.sample(words, rng.randint(0, 6)), rng.sample(words, rng.randint(0, 6))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", C.fuzzy_jaccard(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(r.x == pytest.approx(plain_jaccard(r.a, r.b)) for r in got)
    shape = "subject string, outcome string, statement string, polarity string, null_finding boolean, conditions string"
    rule = lambda s, o, st="", p="positive", n=False, c="": (s, o, st, p, n, c)
    cases = [
        (rule("stress", "sleep loss"), rule("stress", "sleep loss"), False, "equivalent"), (rule("stress", "sleep loss"), rule("stress", "sleep loss", p="negative"), False, "contradictory"),
        (rule("stress", "sleep loss", c="in children"), rule("stress", "sleep loss", c="adults only"), False, "overlapping"), (rule("stress", "recall"), rule("recall", "stress"), False, "reverse_direction"),
        (rule("predictable events", "recall"), rule("unpredictable events", "panic"), False, "scope_tension"), (rule("stress", "recall"), rule("stress", "panic"), False, "complementary"),
        (rule("stress", "recall"), rule("light", "panic"), True, "shared_context"), (rule("stress", "recall"), rule("light", "panic"), False, "unrelated"),
    ]
    df = spark.createDataFrame([(*a, *b, x) for a, b, x, _ in cases], ", ".join(f"{k}{c}" for k in "ab" for c in shape.split(", ")) + ", x boolean")
    of = lambda k: F.struct(*[F.col(k + c.split()[0]).alias(c.split()[0]) for c in shape.split(", ")])
    assert [r.r for r in df.select(C.relationship(C.rule_stems(of("a")), C.rule_stems(of("b")), F.col("x")).alias("r")).collect()] == [w for *_, w in cases]


def test_folds(spark):
    """Folds against plain loops: accepted events, fixed windows, bins with flushes and row limits, pages."""
    rng = random.Random(7)
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 200_000)) for _ in range(300)]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(at)], "k long, at timestamp_ntz")
    for k in range(3):
        mine = sorted(t for i, t in enumerate(at) if i % 3 == k)
        kept = []
        for t in mine:
            if not kept or kept[-1].date() != t.date() or (t - kept[-1]).total_seconds() >= 3000:
                kept.append(t)
        assert sorted(r.at for r in O.accepted(df, "k", "at", 3000).where(F.col("key") == k).collect()) == kept
        opened, want, n = None, [], 0
        for t in mine:
            if opened is None or (t - opened).total_seconds() >= 5000:
                opened, n = t, 0
            n += 1
            want.append((t, opened, n, n <= 2))
        got = O.first_event_windows(df, "k", "at", 5000, 2).where(F.col("key") == k).collect()
        assert sorted((r["at"], r["opened"], r["count"], r["allowed"]) for r in got) == want
    sizes = [(1, i, rng.randint(0, 60), rng.random() < 0.1) for i in range(100)]
    bins, bin_, held, n = [], -1, 0, 0
    for _, i, size, flush in sizes:
        if bin_ < 0 or flush or (held and held + size > 100) or n >= 3:
            bin_, held, n = bin_ + 1, 0, 0
        held, n = held + size, n + 1
        bins.append((i, bin_))
    rows = spark.createDataFrame(sizes, "k long, o long, n long, f boolean")
    assert sorted((r.o, r.bin) for r in O.packed(rows, "k", "o", "n", 100, F.col("f"), 3).collect()) == bins
    pages, held = 0, 0
    for _, _, size, head in sizes:
        if head and held >= 100:
            pages, held = pages + 1, 0
        held += size
        if not head and held >= 150:
            pages, held = pages + 1, 0
    assert O.page_counts(rows, "k", "o", "n", "f", 100, 150).first().pages == pages + (held > 0)


def test_metrics(spark):
    """The two calibration cases, worked out by hand."""
    claim = "array<struct<text:string,citationIds:array<string>,supported:boolean>>"
    rows = [
        ("1", ["rm", "cm"], ["rm", "cm", "cn"], ["p"], [("a", ["rm", "cm"], True)], 1.0), ("2", ["rt"], ["cn", "rt"], ["p"], [("b", ["rt"], True), ("c", [], False)], 0.5),
        ("3", ["x"], ["x", "p"], ["p"], [("d", ["x"], True)], None), ("4", [], [], None, [("e", ["zz"], True)], 7.0),
    ]
    cases = spark.createDataFrame(rows, f"id string, relevant array<string>, retrieved array<string>, forbidden array<string>, claims {claim}, relevance double")
    got = {r.id: r for r in E.retrieval_metrics(cases).collect()}
    values = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r[1:])
    assert values(got["1"]) == (0.666667, 1, 1, 1, 1, True, 1) and values(got["2"]) == (0.5, 1, 0.5, 0.5, 0.5, True, 0.5)
    assert values(got["3"]) == (0.5, 1, 1, 1, 1, False, None) and values(got["4"]) == (0, 1, 0, 0, 0, True, 1)
    s = E.metrics_summary(E.retrieval_metrics(cases.where("id < '3'"))).first()
    assert (round(s.precision, 6), s.recall, s.reciprocal_rank, s.faithfulness, s.traceability, s.privacy_rate, s.relevance) == (0.583333, 1, 0.75, 0.75, 0.75, 1, 0.75)


def test_tables(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(at, i) for i in range(5)] + [(at - dt.timedelta(days=1), 9)], "at timestamp_ntz, id long")
    first = [r.id for r in K.keyset_page(df, "at", None, 2, "id").collect()]
    assert first == [4, 3, 2] and [r.id for r in K.keyset_page(df, "at", (at, 3), 9, "id").collect()] == [2, 1, 0, 9]
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1), (5, 9), (9, None), (7, 7)], "id long, parent long")
    assert sorted(r.id for r in K.below(tree, F.col("id") == 2).collect()) == [2, 3] and K.below(tree, F.col("id") == 77).count() == 0
    votes = spark.createDataFrame([("a", "supports"), ("a", "supports"), ("b", "weakens")], "rule_id string, effect string")
    quotes = spark.createDataFrame([("a", "q"), ("b", "q"), ("b", "q2"), ("c", "q2"), ("a", None)], "rule_id string, quote string")
    scores = spark.createDataFrame([("a", 50, "limited"), ("b", 50, "limited"), ("c", 50, "limited")], "rule_id string, score int, tier string")
    assert {r.rule_id: r.adjustment for r in V.voted(scores, V.propagated(votes, quotes)).collect()} == {"a": 4 - 1, "b": -2 + 2, "c": -1}
    ranges = spark.createDataFrame([("aXbbXxc",), ("",), ("none",)], "t string").select(T.ranges(F.col("t"), "(?i)x").alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in ranges] == [[(1, 2), (4, 5), (5, 6)], [], []]


def test_shared_folder(spark):
    """A session that names no folder gets one of its own, without a change to its static settings."""

    class Session:
        conf, sparkContext = {}, spark.sparkContext

    assert shared_folder(Session) == shared_folder(Session) and spark.conf.get("spark.checkpoint.dir", None) in (None, shared_folder(spark))
