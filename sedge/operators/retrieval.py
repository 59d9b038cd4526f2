"""Search among claims and rules: ranking for one query, likeness joins, groups of related rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sedge.functions import claims as C, text as T, vectors as V
from sedge.operators.components import components
from sedge.session import stored


def ranked_rules(rules: DataFrame, query: str, embedding: list[float]) -> DataFrame:
    """rules with the scores of their overlaps with a query, their cosine and their evidence; only applicable ones whose words meet it.

    rules: subject, outcome, statement, conditions, tags (arrays of text), parts (array of text: the texts of a composite's components),
    embedding, evidence_score, source_language. A column cross_language tells rules in another language than the query's.
    """
    spark, q = rules.sparkSession, F.lit(query)
    one = spark.range(1).select(C.content(C.expanded(q)).alias("wanted"), C.features(q).alias("have"), C.query_language(q).alias("spoken")).first()
    texts = lambda of: F.array(*map(F.lit, of)).cast("array<string>")
    near = lambda *c: T.capped_overlap(texts(one.wanted), C.content(F.concat_ws(" ", *c, "parts")))
    made = {
        "lexical": near("subject", "outcome", "conditions"), "tag_overlap": near("tags"), "statement_overlap": near("statement"),
        "vector": V.cosine(F.array(*[F.lit(float(v)) for v in embedding]), F.col("embedding")), "applicable": C.applicable(F.col("conditions"), texts(one.have)),
    }
    # Made once and filtered where they are made: a filter over columns would be pushed below them and make them again.
    shown = lambda x: x["applicable"] & (F.greatest(x["tag_overlap"], x["lexical"], x["statement_overlap"]) >= C.GATE)
    x = rules.select("*", F.inline(F.filter(F.array(F.struct(*[v.alias(c) for c, v in made.items()])), shown))).drop("applicable")
    at_most_1 = lambda c: F.least(F.lit(1.0), F.col(c))
    score = (
        at_most_1("tag_overlap") * C.TAGS + at_most_1("lexical") * C.LEXICAL + at_most_1("statement_overlap") * C.STATEMENT
        + F.greatest(F.lit(0.0), F.col("vector")) * C.VECTOR + F.col("evidence_score") / 100 * C.EVIDENCE
    )
    foreign = F.lit(one.spoken != "unknown") & F.coalesce((F.col("source_language") != "") & (F.col("source_language") != one.spoken), F.lit(False))
    return x.withColumn("score", score).withColumn("cross_language", foreign)


def _probes(sets: DataFrame, rarity: DataFrame, least: float) -> DataFrame:
    """sets (id, items) -> id, item, n, probe: of a set of n, of which `least` must agree, any n - least n + 1 items hold one that agrees; the rarest are probes."""
    items = sets.select("id", F.size("items").alias("n"), F.explode("items").alias("item")).join(rarity, "item")
    place = F.row_number().over(Window.partitionBy("id").orderBy("holders", "item"))
    return items.select("id", "item", "n", (place <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1).alias("probe"))


def overlapping(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """left, right (id, items: array of different texts) -> a, b: at least all pairs whose overlap over the smaller set is `least` or more.

    The smaller set's rarest items lead to its partners, so a word that every text holds brings no pairs together.
    """
    rarity = left.select(F.explode("items").alias("item")).unionByName(right.select(F.explode("items").alias("item")))
    rarity = rarity.groupBy("item").agg(F.count("*").alias("holders"))
    l, r = _probes(left, rarity, least), _probes(right, rarity, least)
    names = lambda df, x: df.select(F.col("id").alias(x), "item", F.col("n").alias(f"n_{x}"))
    first = names(l.where("probe"), "a").join(names(r, "b"), "item").where("n_a <= n_b")
    second = names(l, "a").join(names(r.where("probe"), "b"), "item").where("n_b < n_a")
    return first.select("a", "b").unionByName(second.select("a", "b")).distinct()


def matching_claims(claims: DataFrame, rules: DataFrame, least: float) -> DataFrame:
    """claims, rules (id, text) -> claim_id, rule_id, score of all pairs that are alike by `least` or more (above 0).

    A pair can only be so if it shares words, canonical words, two concepts or a key: each is an equality join, and the score is
    computed for what these bring.
    """
    c, r = [stored(x.select("id", C.prepared(F.col("text")).alias("p")), "claims") for x in (claims, rules)]  # read several times
    of = lambda x, field: x.select("id", F.col(f"p.{field}").alias("items"))
    met = overlapping(of(c, "words"), of(r, "words"), least).unionByName(overlapping(of(c, "canonical"), of(r, "canonical"), least))

    def keyed(x: DataFrame, name: str) -> DataFrame:
        pairs = F.transform("p.concepts", lambda a: F.transform(F.filter("p.concepts", lambda b: b > a), lambda b: F.concat_ws("+", a, b)))
        return x.select(F.col("id").alias(name), F.explode(F.concat(F.flatten(pairs), F.array("p.key"))).alias("key")).where("key <> ''")

    met = met.unionByName(keyed(c, "a").join(keyed(r, "b"), "key").select("a", "b")).distinct()
    scored = met.join(c.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(r.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
    scored = scored.select(F.col("a").alias("claim_id"), F.col("b").alias("rule_id"), C.similarity(F.col("pa"), F.col("pb")).alias("score"))
    return scored.where(F.col("score") >= least)


def related_rules(rules: DataFrame) -> DataFrame:
    """rules (id: each once, subject, outcome, statement, polarity, null_finding, conditions, chunks) -> a, b, relation of all pairs that have one, a < b.

    Every relation needs subjects or statements alike by a known least, a subject like the other's outcome, a few words in common where one rule
    negates, or a common chunk: each is a join through rare words, and what they bring is judged. Other pairs are unrelated and not returned.
    """
    fields = ("subject", "outcome", "statement", "polarity", "null_finding", "conditions", "chunks")
    own = stored(rules.select("id", F.struct(*fields).alias("r")).select("id", "r.chunks", C.rule_stems(F.col("r")).alias("r")), "rules")
    items = lambda field, df=own: df.select("id", C.likeness_items(F.col(f"r.{field}")).alias("items"))
    placed = own.select("id", F.explode(F.array_distinct("chunks")).alias("chunk"))
    pairs = overlapping(items("subject"), items("subject"), C.SUBJECT)
    pairs = pairs.unionByName(overlapping(items("statement"), items("statement"), C.STATEMENTS)).unionByName(overlapping(items("subject"), items("outcome"), C.SAME))
    pairs = pairs.unionByName(overlapping(items("every", own.where("r.negated")), items("every", own.where("not r.negated")), C.TENSION))
    pairs = pairs.unionByName(placed.select(F.col("id").alias("a"), "chunk").join(placed.select(F.col("id").alias("b"), "chunk"), "chunk").select("a", "b"))
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda n: own.select(F.col("id").alias(n), F.struct("r", "chunks").alias(f"of_{n}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.coalesce(F.arrays_overlap(F.col("of_a.chunks"), F.col("of_b.chunks")), F.lit(False))
    return met.select("a", "b", C.relationship(F.col("of_a.r"), F.col("of_b.r"), shared).alias("relation")).where("relation <> 'unrelated'")


def mergeable_rules(rules: DataFrame) -> DataFrame:
    """rules (id: each once, subject, outcome, statement, polarity, null_finding, chunks, question, source) -> a, b, reasons, signals of all pairs that may merge, a < b.

    question is null or 'none' where a rule has no kind of question. Each reason needs a common paragraph, or subjects, outcomes or statements
    that are alike by a known least: every one of these is a join through rare words, and only pairs that one of them brings are judged.
    """
    fields = ("subject", "outcome", "statement", "polarity", "null_finding")
    own = stored(rules.select("id", "chunks", "question", "source", C.merge_stems(F.struct(*fields)).alias("r")), "rules")
    items = lambda field: own.select("id", C.likeness_items(F.col(f"r.{field}")).alias("items"))
    near = {"subject": C.EQUIVALENT, "bare_subject": C.MEANINGFUL, "bare_outcome": C.MEANINGFUL, "statement": C.QUESTION}
    met = [overlapping(items(f), items(f), least) for f, least in near.items()]
    placed = own.select("id", F.explode(F.array_distinct("chunks")).alias("chunk"))
    met.append(placed.select(F.col("id").alias("a"), "chunk").join(placed.select(F.col("id").alias("b"), "chunk"), "chunk").select("a", "b"))
    pairs = met[0]
    for more in met[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.where("a < b").distinct()
    side = lambda n: own.select(F.col("id").alias(n), F.struct("r", "chunks", "question", "source").alias(f"of_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    a, b = F.col("of_a"), F.col("of_b")
    paragraph = F.coalesce(F.arrays_overlap(a["chunks"], b["chunks"]), F.lit(False))
    question = F.coalesce((a["question"] == b["question"]) & (a["question"] != "none"), F.lit(False))
    judged = both.select("a", "b", C.merge_assessment(a["r"], b["r"], paragraph, question, F.coalesce(a["source"] == b["source"], F.lit(False))).alias("m"))
    return judged.where("m.can_merge").select("a", "b", "m.reasons", "m.signals")


def merge_groups(ids: DataFrame, compatible: DataFrame, most: int = 12, in_task: int = 200_000) -> DataFrame:
    """ids (id), compatible (a, b) -> id, group_id: seeds in order of id, each with all later ones that are compatible with every member so far.

    A seed takes, in order, whichever of the rest fits all it has; a group of two to `most` members leaves the rest and is named after its
    seed, others change nothing. Ids in no group are absent. What a seed takes depends on its component alone: components of at most in_task pairs
    are worked through in one task each, larger ones in rounds over all seeds that no earlier seed can still affect.
    """
    e = stored(compatible.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "compatible")
    placed = e.join(components(e).withColumnRenamed("node", "a"), "a")
    sized = placed.groupBy("root").agg(F.count("*").alias("pairs"))
    shape = f"id {e.schema['a'].dataType.simpleString()}, group_id {e.schema['a'].dataType.simpleString()}"

    def in_order(frame):
        near: dict = {}
        for a, b in zip(frame["a"].tolist(), frame["b"].tolist()):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        gone, out = set(), []
        for seed in sorted(near):
            if seed in gone:
                continue
            group = [seed]
            for c in sorted(near[seed] - gone):
                if near[c].issuperset(group):
                    group.append(c)
            if 2 <= len(group) <= most:
                gone.update(group)
                out += [(x, seed) for x in group]
        return pd.DataFrame(out, columns=["id", "group_id"])

    small = placed.join(sized.where(F.col("pairs") <= in_task).select("root"), "root", "left_semi").groupBy("root").applyInPandas(in_order, shape)
    large = stored(placed.join(sized.where(F.col("pairs") > in_task).select("root"), "root", "left_semi").select("a", "b"), "large")
    found = small if large.isEmpty() else small.unionByName(_merged_in_rounds(large, most))
    return found.join(ids, "id", "left_semi")


def _merged_in_rounds(e: DataFrame, most: int) -> DataFrame:
    """merge_groups of pairs (a < b): in each round the seeds with no earlier open seed within two steps of them."""
    near = stored(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near")
    open_, made = stored(near.select(F.col("a").alias("id")).distinct(), "open"), []
    while not open_.isEmpty():
        hop = near.join(open_.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("b").alias("low"))
        own = near.select(F.col("a").alias("id")).distinct().join(hop.withColumnRenamed("a", "id"), "id", "left").join(open_.withColumn("me", F.col("id")), "id", "left")
        own = own.select("id", F.least("low", "me").alias("low"))
        two = near.join(own.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("low").alias("low2")).withColumnRenamed("a", "id")
        first = open_.join(own, "id").join(two, "id", "left").where((F.col("id") <= F.col("low")) & (F.col("id") <= F.coalesce("low2", "id"))).select(F.col("id").alias("seed"))
        first = stored(first, "seeds")
        left = stored(first.join(near.withColumnRenamed("a", "seed").withColumnRenamed("b", "c"), "seed"), "candidates")
        members = [first.select("seed", F.col("seed").alias("id"))]
        for _ in range(most):
            if left.isEmpty():
                break
            taken = stored(left.groupBy("seed").agg(F.min("c").alias("id")), "taken")
            members.append(taken)
            rest = left.join(taken, "seed").where("c > id")
            left = stored(rest.join(near.select(F.col("a").alias("id"), F.col("b").alias("c")), ["id", "c"]).select("seed", "c"), "candidates")
        whole = members[0]
        for m in members[1:]:
            whole = whole.unionByName(m)
        fits = whole.groupBy("seed").agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= most))
        made.append(stored(whole.join(fits.select("seed"), "seed").select("id", F.col("seed").alias("group_id")), "groups"))
        gone = made[-1].select("id")
        open_ = stored(open_.join(first.withColumnRenamed("seed", "id"), "id", "left_anti").join(gone, "id", "left_anti"), "open")
        near = stored(near.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"), "near")
    found = made[0]
    for m in made[1:]:
        found = found.unionByName(m)
    return found
