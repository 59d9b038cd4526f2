"""Scores of claims from the evidence found for them, and how votes move them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sedge.functions.text import js_round

# Research types that fit a kind of claim.
EMPIRICAL = ["quantitative_empirical", "mixed", "systematic_review", "meta_analysis"]
FITTING = {
    "association": EMPIRICAL,
    "prediction": EMPIRICAL,
    "intervention_effect": EMPIRICAL,
    "moderation": EMPIRICAL,
    "mediation": EMPIRICAL,
    "null_finding": EMPIRICAL,
    "qualitative_theme": ["qualitative_empirical", "mixed", "case_report"],
    "theoretical_proposition": ["theoretical_or_conceptual", "book_or_monograph", "narrative_review"],
    "review_synthesis": ["systematic_review", "meta_analysis", "narrative_review"],
}
# Points by number of sources and of places, by certainty of the research type, and the caps.
SOURCE_POINTS, PLACE_POINTS = (0, 8, 20, 30), (0, 4, 9, 12, 15)
CERTAINTY, CERTAINTY_ELSE = {"high": 25, "medium": 18}, 11
STANDING, STANDING_UNKNOWN, INTERVENTION = {"preprint": 20, "informal": 10}, 16, 17
CONDITIONS, LIMITATIONS, DISPUTED, AGREED, ALONE = 7, 8, 5, 15, 7
REJECTED_CAP, DISPUTED_CAP = 20, 65
USEFULNESS = {"direct": 100, "conditional": 65, "background": 25}
TIERS = ((85, "strong"), (65, "moderate"), (45, "limited"))


def _ladder(n: Column, points: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in points]), F.least(n, F.lit(len(points) - 1)).cast("int") + 1)


def _looked_up(c: Column, values: dict, otherwise: Column) -> Column:
    out = otherwise
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def certainty(score: Column) -> Column:
    out = F.lit("weak")
    for least, name in reversed(TIERS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def research_fit(claim: Column, research: Column, sure: Column, standing: Column) -> Column:
    """Points of one source's kind of research for a kind of claim."""
    fits = F.lit(False)
    for kind, types in FITTING.items():
        fits = fits | ((claim == kind) & research.isin(types))
    value = _looked_up(sure, CERTAINTY, F.lit(CERTAINTY_ELSE))
    value = F.when(claim == "intervention_effect", F.least(value, F.lit(INTERVENTION))).otherwise(value)
    cap = F.when(F.coalesce(standing, F.lit("")) == "", STANDING_UNKNOWN).otherwise(_looked_up(standing, STANDING, F.lit(100)))
    return F.when(F.coalesce(fits, F.lit(False)), F.least(value, cap)).otherwise(0)


def scored(rules: DataFrame, evidence: DataFrame) -> DataFrame:
    """rules (rule_id, claim_type, accepted, readiness, has_conditions, has_limitations) and evidence -> one row of scores for each rule.

    evidence: rule_id, position (its order), source_id, chunk_id, quote, stance (supports, refutes, limits), exactness,
    verification, research_type, certainty, standing. Only exact and verified evidence counts; passages of one chunk count
    once. Rules without evidence have 0. Evidence is counted by rule, source and place before it is counted by rule, so a
    rule with very much of it is spread over many tasks.
    """
    text = lambda c: F.when(F.length(c) > 0, F.col(c))
    exact = evidence.where((F.col("exactness") == "canonical_exact") & (F.col("verification") == 1)).withColumn(
        "place", F.concat_ws(":", F.coalesce("source_id", F.lit("")), F.coalesce(text("chunk_id"), text("quote"), F.col("position").cast("string")))
    )
    exact = exact.withColumn("source_id", text("source_id"))
    known = exact.join(rules.select("rule_id", "claim_type"), "rule_id")
    # The first supporting row of each source speaks for it.
    fit = F.when((F.col("stance") == "supports") & F.col("source_id").isNotNull(), research_fit(*[F.col(c) for c in ("claim_type", "research_type", "certainty", "standing")]))
    places = known.groupBy("rule_id", "source_id", "place", "stance").agg(F.min_by(fit, F.col("position")).alias("fit"), F.min("position").alias("position"))
    supports = F.col("stance") == "supports"
    kinds = ("supports", "limits", "refutes")
    sources = places.groupBy("rule_id", "source_id").agg(
        F.min_by("fit", F.when(supports, F.col("position"))).alias("fit"),
        *[F.count_if(F.col("stance") == k).alias(k) for k in kinds],
    )
    has = lambda k: F.count_if((F.col(k) > 0) & F.col("source_id").isNotNull())
    per = sources.groupBy("rule_id").agg(
        *[F.sum(k).alias(k) for k in kinds],
        has("supports").alias("supporting_sources"),
        has("refutes").alias("contradicting_sources"),
        F.count("source_id").alias("independent_sources"),
        F.coalesce(js_round(F.avg(F.when(F.col("supports") > 0, F.col("fit")))), F.lit(0)).alias("research_fit"),
    )
    counts = [*kinds, "supporting_sources", "contradicting_sources", "independent_sources", "research_fit"]
    all_rules = rules.join(per, "rule_id", "left").fillna(0, counts)
    disputed = F.col("refutes") > 0
    flag = lambda c, points: F.when(F.col(c), points).otherwise(0)
    out = all_rules.select(
        "*",
        _ladder(F.col("supporting_sources"), SOURCE_POINTS).alias("source_breadth"),
        _ladder(F.col("supports"), PLACE_POINTS).alias("evidence_breadth"),
        (flag("has_conditions", CONDITIONS) + flag("has_limitations", LIMITATIONS)).alias("scope_definition"),
        F.when(F.col("supports") == 0, 0).when(disputed, DISPUTED).when(F.col("supporting_sources") >= 2, AGREED).otherwise(ALONE).alias("conflict_handling"),
    )
    total = sum((F.col(c) for c in ("evidence_breadth", "research_fit", "scope_definition", "conflict_handling")), F.col("source_breadth"))
    accepted = F.coalesce(F.col("accepted"), F.lit(False))
    total = F.when(accepted, total).otherwise(F.least(total, F.lit(REJECTED_CAP)))
    total = F.when(disputed, F.least(total, F.lit(DISPUTED_CAP))).otherwise(total)
    out = out.withColumn("score", F.when(F.col("supports") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).cast("int"))
    usable = F.coalesce(F.col("readiness") != "not_usable", F.lit(True))
    return out.withColumns(
        {
            "usefulness": _looked_up(F.col("readiness"), USEFULNESS, F.lit(0)),
            "eligible": accepted & usable & (F.col("score") >= 60) & (F.col("supporting_sources") >= 2),
            "tier": F.when(disputed & (F.col("supports") > 0), "mixed").otherwise(certainty(F.col("score"))),
        }
    )


def weakest(components: DataFrame) -> DataFrame:
    """components (composite_id, position, and the columns of `scored`) -> one row each: the weakest part's score and tier, all parts' eligibility and counts."""
    first = F.struct("score", "position")
    kinds = ("supports", "limits", "refutes")
    return components.groupBy("composite_id").agg(
        F.min("score").alias("score"),
        F.min_by("rule_id", first).alias("weakest_rule_id"),
        F.min_by("tier", first).alias("tier"),
        F.min("usefulness").alias("usefulness"),
        F.bool_and("eligible").alias("eligible"),
        *[F.sum(k).alias(k) for k in kinds],
    )


# What a vote weighs on the claim asked about, and on one that shares its quote.
VOTE_WEIGHT = {"direct": 2, "shared_quote": 1}


def voted(scores: DataFrame, votes: DataFrame) -> DataFrame:
    """scores (rule_id, score, tier) and votes (rule_id, relation, effect, and n of them if there is such a column) -> rule_id, score, adjustment, tier after the votes. Undecided votes weigh nothing."""
    sign = F.when(F.col("effect") == "supports", 1).when(F.col("effect") == "weakens", -1).otherwise(0)
    n = F.col("n") if "n" in votes.columns else F.lit(1)
    moved = votes.groupBy("rule_id").agg(F.sum(n * sign * _looked_up(F.col("relation"), VOTE_WEIGHT, F.lit(0))).alias("adjustment"))
    out = scores.select("rule_id", "score", "tier").join(moved, "rule_id", "left").fillna(0, ["adjustment"])
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("score") + F.col("adjustment"))).cast("int")
    out = out.withColumn("score", score)
    return out.withColumn("tier", F.when(F.col("tier") == "mixed", "mixed").otherwise(certainty(F.col("score"))))


def propagated(votes: DataFrame, evidence: DataFrame) -> DataFrame:
    """votes (rule_id, effect), evidence (rule_id, quote: a hash) -> rule_id, relation, effect, n: on the rule asked about, and on each that shares a quote with it.

    Votes are counted by rule before they move to others; a rule that shares several quotes gets a vote once.
    """
    counted = votes.groupBy("rule_id", "effect").agg(F.count("*").alias("n"))
    e = evidence.where("quote is not null").select("rule_id", "quote").distinct()
    asked = e.join(counted.select("rule_id").distinct(), "rule_id", "left_semi")
    shared = asked.join(e.withColumnRenamed("rule_id", "other"), "quote").where("rule_id <> other").select("rule_id", "other").distinct()
    on_others = counted.join(shared, "rule_id").select(F.col("other").alias("rule_id"), F.lit("shared_quote").alias("relation"), "effect", "n")
    return counted.select("rule_id", F.lit("direct").alias("relation"), "effect", "n").unionByName(on_others)
