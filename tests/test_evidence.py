"""Scores of evidence and sealed messages, with values worked out by hand or by the standard library."""

import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from sedge.functions import envelopes, text as T
from sedge.operators import evidence as V

RULES = "rule_id string, claim_type string, accepted boolean, readiness string, has_conditions boolean, has_limitations boolean"
FOUND = "rule_id string, position int, source_id string, chunk_id string, quote string, stance string, exactness string, verification double, research_type string, certainty string, standing string"


def found(rule, position, source, chunk, stance="supports", exact="canonical_exact", kind="mixed", sure="high", standing="peer_reviewed"):
    return (rule, position, source, chunk, None, stance, exact, 1.0, kind, sure, standing)


@pytest.fixture(scope="module")
def scores(spark):
    rules = spark.createDataFrame(
        [("a", "association", True, "direct", True, True), ("b", "association", True, "conditional", False, None), ("c", "association", False, "direct", True, True),
         ("d", "association", True, "direct", True, True), ("e", "intervention_effect", True, "not_usable", False, False)], RULES,
    )
    rows = [
        found("a", 0, "s1", "k1"), found("a", 1, "s1", "k1", kind="case_report"), found("a", 2, "s2", "k2", sure="medium"), found("a", 3, "s3", "k3", sure="low", exact="fuzzy"),
        found("b", 0, "s1", "k1"), found("b", 1, "s2", "k2"), found("b", 2, "s3", "k3"), found("b", 3, "s4", "k4"), found("b", 4, "s5", "k5", "refutes"),
        found("c", 0, "s1", "k1"), found("c", 1, "s2", "k2"),
        found("e", 0, "s1", None, standing=None), found("e", 1, "s1", None, standing="informal"), found("e", 2, None, "k"), found("zz", 0, "s", "k"),
    ]
    return V.scored(rules, spark.createDataFrame(rows, FOUND))


def test_scores(scores):
    got = {r.rule_id: r for r in scores.collect()}
    assert len(got) == 5
    a = got["a"]  # 20 + 9 + round((25 + 18) / 2) + 15 + 15
    assert (a.source_breadth, a.evidence_breadth, a.research_fit, a.scope_definition, a.conflict_handling) == (20, 9, 22, 15, 15)
    assert (a.score, a.tier, a.eligible, a.usefulness, a.supports, a.independent_sources) == (81, "moderate", True, 100, 2, 2)
    b = got["b"]  # 30 + 15 + 25 + 0 + 5, capped
    assert (b.score, b.tier, b.eligible, b.usefulness, b.refutes, b.contradicting_sources) == (65, "mixed", True, 65, 1, 1)
    assert got["c"].score == 20 and not got["c"].eligible and got["d"].score == 0 and got["d"].tier == "weak" and not got["d"].eligible
    e = got["e"]  # one source that speaks once; rows without a chunk or quote are places of their own
    assert (e.source_breadth, e.evidence_breadth, e.research_fit, e.conflict_handling, e.supports) == (8, 12, 16, 7, 3) and not e.eligible


def test_composites_and_votes(spark, scores):
    parts = scores.where("rule_id IN ('a', 'b')").withColumn("composite_id", F.lit("x")).withColumn("position", F.ascii("rule_id"))
    w = V.weakest(parts).first()
    assert (w.score, w.weakest_rule_id, w.tier, w.usefulness, w.eligible, w.supports, w.refutes) == (65, "b", "mixed", 65, True, 6, 1)
    votes = [("a", "direct", "supports")] * 2 + [("a", "shared_quote", "supports"), ("a", "direct", "unresolved"), ("b", "direct", "weakens"), ("d", "direct", "weakens")]
    after = {r.rule_id: r for r in V.voted(scores, spark.createDataFrame(votes, "rule_id string, relation string, effect string")).collect()}
    assert (after["a"].score, after["a"].adjustment, after["a"].tier) == (86, 5, "strong")
    assert (after["b"].score, after["b"].tier) == (63, "mixed") and after["d"].score == 0 and after["c"].adjustment == 0


def test_envelopes(spark):
    keys = {"v1": b"k" * 32, "v2": b"l" * 32}
    rows = spark.createDataFrame([(1, "hello đ 😀"), (2, ""), (3, None)], "i int, t string")
    context = [F.lit("message"), F.col("i")]
    sealed = rows.select("i", "t", envelopes.sealed(F.col("t"), context, keys, "v2").alias("e"))
    got = sealed.select("t", "e", envelopes.opened(F.col("e"), context, keys).alias("x"), envelopes.opened(F.col("e"), [F.lit("message"), F.col("i") + 1], keys).alias("other"),
                        envelopes.opened(F.col("e"), context, {"v1": keys["v1"]}).alias("unknown"),
                        envelopes.opened(F.col("e").withField("authTag", F.base64(F.lit(bytearray(16)))), context, keys).alias("forged"),
                        envelopes.opened(F.col("e").withField("iv", F.lit("AA==")), context, keys).alias("short")).collect()
    assert all(r.x == r.t and r.other is r.unknown is r.forged is r.short is None for r in got)
    assert len(base64.b64decode(got[0].e.iv)) == 12 and len(base64.b64decode(got[0].e.authTag)) == 16 and got[2].e is None
    with pytest.raises(ValueError):
        envelopes.sealed(F.col("t"), context, {"v1": b"short"}, "v1")
    key = b"s" * 32
    want = [base64.urlsafe_b64encode(hmac.new(key, f"message-search:v1:{g}".encode(), hashlib.sha256).digest()).decode().rstrip("=") for g in ("muo", "uon")]
    tokens = spark.range(1).select(envelopes.search_tokens(F.lit("MƯỜN"), key, "v1").alias("x"), envelopes.search_tokens(F.lit("  "), key, "v1").alias("none")).first()
    assert tokens.x == want and tokens.none == []


def test_redacted_map(spark):
    m = spark.range(1).select(T.redacted_values(F.create_map(F.lit("Token"), F.lit("x"), F.lit("url"), F.lit("http://a?code=1&b=2#c"), F.lit("n"), F.lit(None).cast("string"))).alias("m")).first().m
    assert m == {"Token": "[REDACTED]", "url": "http://a?code=[REDACTED]&b=2#c", "n": None}
