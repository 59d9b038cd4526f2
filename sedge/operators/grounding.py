"""Quotes cut from texts, claims judged by quotes, citation marks judged by their citations, claims bound to rules and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sedge.functions import grounding as G
from sedge.operators.ordered import gap_clusters, numbered
from sedge.operators.retrieval import matching_claims
from sedge.session import stored


def evidence_spans(docs: DataFrame, least: int = G.QUOTE_LEAST, most: int = G.QUOTE_MOST, cut: int = G.QUOTE_CUT) -> DataFrame:
    """docs (id: unique, text) -> id, start_offset, end_offset (characters from 0), quote, evidence_id: the sentences of each text, none longer than `most`.

    A sentence ends after an end mark before white space, but for abbreviations, and between two line feeds; white space at its ends is not part of
    it, sentences under `least` characters are left out. Longer ones than `most` are cut at white space. Null and blank texts have none. Texts move once,
    as sentences: offsets are running sums in the order of the parts.
    """
    parts = docs.select("id", F.posexplode(G.sentence_parts(F.col("text"))).alias("part", "text"))
    by = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("base", F.coalesce(F.sum(F.length("text").cast("long")).over(by), F.lit(0)))
    placed = placed.withColumn("sentence", F.coalesce(F.sum((~G.shortened(F.col("text"))).cast("int")).over(by), F.lit(0)))
    whole = placed.groupBy("id", "sentence").agg(F.min("base").alias("base"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"))
    pattern = G.bounded_pattern(most, cut)
    # Trailing white space goes first, so that the last piece ends with the sentence.
    whole = whole.withColumn("text", F.rtrim("text", F.lit(G.SPACE)))
    pieces = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("quote"))
    cuts = whole.select("id", "sentence", "base", F.posexplode(pieces).alias("piece", "p")).where("p.quote is not null").select("id", "sentence", "base", "piece", "p.gap", "p.quote")
    inside = Window.partitionBy("id", "sentence").orderBy("piece")
    before = F.coalesce(F.sum(F.length("quote")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("base") + F.sum(F.length("gap")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) + before
    spans = cuts.withColumn("start_offset", start).withColumn("quote", F.rtrim("quote", F.lit(G.SPACE))).withColumn("end_offset", F.col("start_offset") + F.length("quote"))
    named = F.concat(F.lit("eva_"), F.left(F.sha2(F.concat_ws(":", "id", "start_offset", "end_offset", "quote"), 256), F.lit(20)))
    return spans.where(F.length("quote") >= least).select("id", "start_offset", "end_offset", "quote", named.alias("evidence_id"))


def entailment(claims: DataFrame, evidence: DataFrame, gap: int = 240) -> DataFrame:
    """claims (id, statement, subject, outcome), evidence (id, chunk, start, end, quote, stance) -> id, level, score, quote of each claim.

    Supporting quotes of a chunk with gaps of at most `gap` characters are one passage. The first passage that supports a claim directly decides;
    where none does, the one that covers most of statement, subject and outcome together. A claim without quotes has none, with 0 and a null quote.
    """
    e = evidence.where((F.col("stance") == "supports") & (F.length(F.trim("quote")) > 0)).withColumn("key", F.struct("id", "chunk"))
    clustered = gap_clusters(e, "key", "start", "end", gap)
    quotes = F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "quote"))), lambda q: F.trim(q["quote"]))
    passages = clustered.groupBy("id", "chunk", "cluster").agg(F.array_join(quotes, " ").alias("quote"))
    met = claims.join(passages, "id").withColumn("s", G.support(F.struct("statement", "subject", "outcome"), F.col("quote")))
    total = F.col("s.statement") + F.col("s.subject") + F.col("s.outcome")
    row = F.struct("s", "quote")
    # The first that is direct, else the first of those that cover most.
    rank = F.struct((~F.col("s.direct")).alias("d"), F.when(F.col("s.direct"), 0.0).otherwise(-total).alias("t"), "chunk", "cluster")
    found = met.groupBy("id").agg(F.min_by(row, rank).alias("one"))
    judged = claims.select("id").join(found, "id", "left")
    none = F.col("one").isNull()
    return judged.select(
        "id", F.when(none, "none").otherwise(G.support_level(F.col("one.s"))).alias("level"), F.when(none, 0.0).otherwise(G.support_score(F.col("one.s"))).alias("score"), F.col("one.quote").alias("quote")
    )


def checked_answers(answers: DataFrame, citations: DataFrame, *said: str) -> DataFrame:
    """answers (id, text), citations (id, index, excerpt, and columns of what else a citation says) -> id, text, marks.

    Marks [index] of citations that don't support the claim before them read [?]; marks tells what was found for each. Citations are taken by
    index. An answer without citations stays as it is, without marks.
    """
    scope = citations.select("id", F.struct(F.col("index").cast("long").alias("index"), G.scope_of(F.col("excerpt"), *map(F.col, said)).alias("scope")).alias("c"))
    of = scope.groupBy("id").agg(F.array_sort(F.collect_list("c"), lambda a, b: (a["index"] - b["index"]).cast("int")).alias("citations"))
    none = F.array().cast(of.schema["citations"].dataType)
    met = answers.join(of, "id", "left").withColumn("citations", F.coalesce("citations", none))
    return met.select("id", F.inline(F.array(G.checked(F.col("text"), F.col("citations")))))


def grounded_claims(answers: DataFrame, rules: DataFrame, evidence: DataFrame, least: float = G.GROUNDED) -> DataFrame:
    """answers (id, text), rules (id, text), evidence (rule_id, source_id, evidence_id, quote) -> id, place, claim, rule_id, source_id, evidence_id, citation_index, status.

    The first eight claims of each answer, each bound to the rule that is most like it (ties to the lesser rule id) by `least` or more, and to that
    rule's first source with a quote. Sources are numbered in the order in which an answer's claims cite them, each once. Claims without such
    a rule and source are unresolved, and only those that sources can be sought for stay.
    """
    each = stored(answers.select("id", F.posexplode(G.claim_sentences(F.col("text"))).alias("place", "claim")), "answers")  # sentences are judged once, their claims read several times
    # Equal claims of many answers are matched once, and judged once.
    distinct = stored(each.select("claim").distinct(), "distinct")
    best = matching_claims(distinct.select(F.col("claim").alias("id"), F.col("claim").alias("text")), rules, least).groupBy("claim_id").agg(F.min_by("rule_id", F.struct(-F.col("score"), "rule_id")).alias("rule_id"))
    quoted = evidence.where(F.length(F.trim("quote")) > 0).groupBy("rule_id").agg(F.min(F.struct("source_id", "evidence_id")).alias("first"))
    bound = best.join(quoted, "rule_id").select(F.col("claim_id").alias("claim"), "rule_id", "first.*")
    judged = distinct.select("claim", (G.claim_kind(F.col("claim")) == "searchable").alias("searchable"))
    met = each.join(stored(judged.join(bound, "claim", "left"), "bound"), "claim")
    cited = met.where("source_id is not null").groupBy("id", "source_id").agg(F.min("place").alias("first_place"))
    cited = numbered(cited, ["id"], ["first_place", "source_id"], "citation_index").drop("first_place")
    whole = met.join(cited, ["id", "source_id"], "left").withColumn("status", F.when(F.col("source_id").isNull(), "unresolved").otherwise("resolved"))
    kept = whole.where((F.col("status") == "resolved") | F.col("searchable"))
    return kept.select("id", "place", "claim", "rule_id", "source_id", "evidence_id", "citation_index", "status")



def captured_gaps(gaps: DataFrame, claims: DataFrame) -> DataFrame:
    """gaps (user, key, claim, variants, occurrences, rule_id, score), claims (user, key, claim) -> gaps with the claims added: a row for each user and key.

    A known gap keeps its claim, rule and score and gains variants and occurrences; the shortest claim, the first among equals, names a new one.
    """
    first = F.min_by("claim", F.struct(F.length("claim"), "claim"))
    new = claims.where("key <> ''").groupBy("user", "key").agg(first.alias("claim"), F.collect_set("claim").alias("variants"), F.count("*").alias("occurrences"))
    old = gaps.select("user", "key", *[F.col(c).alias(f"old_{c}") for c in ("claim", "variants", "occurrences", "rule_id", "score")])
    none, zero = F.array().cast("array<string>"), F.lit(0)
    met = old.join(new, ["user", "key"], "full")
    variants = F.array_sort(F.array_union(F.coalesce("old_variants", none), F.coalesce("variants", none)))
    return met.select(
        "user", "key", F.coalesce("old_claim", "claim").alias("claim"), variants.alias("variants"), (F.coalesce("old_occurrences", zero) + F.coalesce("occurrences", zero)).alias("occurrences"),
        F.col("old_rule_id").alias("rule_id"), F.col("old_score").alias("score"),
    )


def _best(gaps: DataFrame, rules: DataFrame, least: float) -> DataFrame:
    """gap, best (struct of worst: the negative score, and rule_id) of each claim that a rule is like."""
    claims = gaps.select(F.col("claim").alias("id"), F.col("claim").alias("text")).distinct()
    found = matching_claims(claims, rules, least).groupBy("claim_id").agg(F.min(F.struct((-F.col("score")).alias("worst"), "rule_id")).alias("best"))
    return found.withColumnRenamed("claim_id", "claim")


def matched_gaps(gaps: DataFrame, rules: DataFrame, least: float = G.GROUNDED) -> DataFrame:
    """gaps (claim, ...) with rule_id and score of the rule (id, text) that is most like each by `least` or more, ties to the lesser id; null where there is none."""
    met = gaps.drop("rule_id", "score").join(_best(gaps, rules, least), "claim", "left")
    return met.withColumn("rule_id", F.col("best.rule_id")).withColumn("score", -F.col("best.worst")).drop("best").select(*gaps.columns)


def reconciled_gaps(gaps: DataFrame, rules: DataFrame, changed: DataFrame, least: float = G.GROUNDED) -> DataFrame:
    """matched_gaps after rules have changed (changed: id of those added, altered or gone), without matching what they don't touch.

    A gap whose rule changed is matched with all rules again. Any other keeps its rule unless a changed one is more like it: those alone are
    compared. So the work follows the change, and the result is that of matching everything anew.
    """
    ids = changed.select(F.col("id").alias("rule_id")).distinct()
    lost, rest = gaps.join(ids, "rule_id", "left_semi").select(*gaps.columns), gaps.join(ids, "rule_id", "left_anti").select(*gaps.columns)
    altered = rules.join(ids.withColumnRenamed("rule_id", "id"), "id", "left_semi")
    met = rest.join(_best(rest, altered, least), "claim", "left")
    own = F.when(F.col("rule_id").isNotNull(), F.struct((-F.col("score")).alias("worst"), "rule_id"))
    met = met.withColumn("best", F.least(own, F.col("best")))
    kept = met.withColumn("rule_id", F.col("best.rule_id")).withColumn("score", -F.col("best.worst")).select(*gaps.columns)
    return matched_gaps(lost, rules, least).unionByName(kept)


def pruned_gaps(gaps: DataFrame, live: DataFrame) -> DataFrame:
    """gaps that a rule resolves, or that some answer still states (live: user, key)."""
    return gaps.where("rule_id is not null").unionByName(gaps.where("rule_id is null").join(live.select("user", "key").distinct(), ["user", "key"], "left_semi").select(*gaps.columns))
