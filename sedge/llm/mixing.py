"""Mixing documents to target weights of domains they belong to in part.

A naive Bayes classifier, learned from the labelled table, gives each document a posterior over domains, in steps of 1 / GRID.
Rates 0 <= r (<= most) of documents then solve

    min  sum_k (sum_d share_d p_dk r_d - w_k)^2 / q_k + ridge sum_d share_d (r_d - 1)^2

where share_d is the document's part of all tokens, q_k the domain's and w_k its target, by projected gradient in the
metric of the shares: with the weights 1 / q_k the steps shrink the error fast, however rare a domain is.
Documents of one posterior have one rate: one pass sums the tokens of each posterior, the iterations run over that table, each
one aggregate that hands K sums to the driver, and the rate of a document is an expression of its posterior and of those
sums: no rows are joined or collected for it. Over K domains the table has at most C(GRID + K - 1, K - 1) rows (5,151 for
three and GRID 100) and never more than there are documents; it stays a distributed table however many they are. A
posterior lies less than K / GRID from the classifier's own. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sedge.session import stored

#: Domains by labels, and the part of all tokens that each should have.
DOMAINS = {"plain": "quality = 1 and toxic = 0", "poor": "quality = 0 and toxic = 0", "toxic": "toxic = 1"}
TARGETS = {"plain": 0.9, "poor": 0.1, "toxic": 0.0}
#: Labelled documents learned from at most; words and marks kept as evidence at most, and how telling they must be; the pull of rates to 1; iterations and their end.
LABELLED, VOCABULARY, TELLING, RIDGE, ROUNDS, SETTLED = 6_000, 256, 16.0, 1e-4, 40, 1e-4
#: Steps of a posterior from 0 to 1.
GRID = 100
#: What a document shows besides its words.
MARKS = {
    "#shout": "length(text) > 0 and length(replace(text, '!!', '')) < 0.9 * length(text)",
    "#upper": "length(text) > 0 and length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) < 0.6 * length(text)",
    "#table": "length(text) - length(replace(text, '|', '')) > 0.01 * length(text)",
    "#digits": "length(translate(text, '0123456789', '')) < 0.8 * length(text)",
    "#short": "length(text) < 60",
}


def evidence(text: Column) -> Column:
    """The different lower-case words of a text, and the marks that hold for it."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    marks = F.array(*[F.when(F.expr(x.replace("text", "__text")), F.lit(m)) for m, x in MARKS.items()])
    return F.concat(words, F.array_compact(marks))


def learned(docs: DataFrame, labels: DataFrame, domains: dict[str, str], labelled: int, vocabulary: int) -> tuple[list, list, list]:
    """(prior log odds, words, weights of each word by domain) of a Bernoulli naive Bayes over the most telling words.

    Learned from at most `labelled` labelled documents, drawn by a hash of doc_id; doc_ids labelled twice count once, by
    the domain named first.
    """
    names = list(domains)
    which = reduce(lambda acc, kv: acc.when(F.expr(kv[1]), kv[0]), enumerate(domains.values()), F.when(F.lit(False), -1))
    chosen = (
        labels.where("doc_id is not null")
        .select(F.col("doc_id").cast("long").alias("id"), which.alias("k"))
        .where("k is not null")
        .groupBy("id")
        .agg(F.min("k").alias("k"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(labelled)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    rows = stored(rows.join(F.broadcast(chosen), "id").groupBy("id", "k").agg(F.min("__text").alias("__text")), "labelled")
    n = {r.k: r.n for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect()}
    total = sum(n.values())
    k_of = [n.get(k, 0) for k in range(len(names))]
    prior = [math.log((x + 1) / (total + len(names))) for x in k_of]
    if not total:
        return prior, [], []
    seen = rows.select("k", F.explode(evidence(F.col("__text"))).alias("w")).where("w <> ''")
    by = seen.groupBy("w").agg(*[F.sum((F.col("k") == k).cast("long")).alias(f"n{k}") for k in range(len(names))])
    all_n = reduce(lambda a, b: a + b, [F.col(f"n{k}") for k in range(len(names))])
    # Log-likelihood ratio of the word's documents by domain against all labelled ones.
    telling = reduce(
        lambda a, b: a + b,
        [
            F.when(F.col(f"n{k}") > 0, 2 * F.col(f"n{k}") * F.log(F.col(f"n{k}") * F.lit(float(total)) / (all_n * F.lit(float(max(1, k_of[k]))))))
            .otherwise(0.0)
            for k in range(len(names))
        ],
    )
    best = by.withColumn("telling", telling).where(F.col("telling") > TELLING).orderBy(F.desc("telling"), "w").limit(vocabulary).collect()
    words, weights = [r.w for r in best], []
    base = list(prior)
    for r in best:
        row = []
        for k in range(len(names)):
            p = (r[f"n{k}"] + 0.5) / (k_of[k] + 1)
            row.append(math.log(p) - math.log(1 - p))
            base[k] += math.log(1 - p)
        weights.append(row)
    return base, words, weights


def _let(value: Column, use) -> Column:
    """use(value), with value made once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _constant(value, kind: str) -> Column:
    """A literal of any size that is one node of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def posteriors(docs: DataFrame, names: list[str], model: tuple[list, list, list], grid: int = GRID) -> DataFrame:
    """docs with a column p_<name> for each domain: posteriors in steps of 1 / grid that add up to 1."""
    base, words, weights = model
    vocabulary = _constant(words, "array<string>")
    tables = _constant([[base[k], *[w[k] for w in weights]] for k in range(len(names))], "array<array<double>>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.withColumn("__text", text)
    places = F.transform(F.array_intersect(evidence(F.col("__text")), vocabulary), lambda w: F.array_position(vocabulary, w).cast("int") + 1)

    def score(at):
        return F.transform(tables, lambda row: F.element_at(row, 1) + F.aggregate(at, F.lit(0.0), lambda total, i: total + F.element_at(row, i)))

    def shares(s):
        e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
        return _let(e, lambda e: F.transform(e, lambda x: F.floor(grid * x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b) + 0.5 / len(names)) / grid))

    d = d.withColumn("__p", _let(_let(places, score), shares))
    for k in range(1, len(names)):
        d = d.withColumn(f"p_{names[k]}", F.element_at("__p", k + 1))
    rest = reduce(lambda a, b: a + b, [F.col(f"p_{x}") for x in names[1:]], F.lit(0.0))
    return d.withColumn(f"p_{names[0]}", F.round((1 - rest) * grid) / grid).drop("__text", "__p")


def tokens(text: Column) -> Column:
    """Words of a text, as a measure of its tokens: runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fitted(cells: DataFrame, names: list[str], targets: dict[str, float], ridge: float, rounds: int, volume: float | None, most: float | None = None) -> Column:
    """The rate, between 0 and most, as an expression of the posteriors, from cells (p_..., n: tokens)."""
    p = [F.col(f"p_{x}") for x in names]
    sums = cells.agg(F.coalesce(F.sum("n"), F.lit(0)), *[F.sum(F.col("n") * c) for c in p]).first()
    total = float(sums[0])
    if not total:
        return F.lit(1.0)
    q = [max(float(x) / total, 1e-9) for x in sums[1:]]
    if volume is None:
        volume = max([a / targets[x] for x, a in zip(names, q) if targets[x] > 0], default=1.0)
    want = [volume * targets[x] for x in names]

    def rate(steps: list[list[float]]) -> Column:
        def step(r, over):
            pull = reduce(lambda a, b: a + b, [c * F.element_at(over, k + 1) for k, c in enumerate(p)])
            up = F.greatest(F.lit(0.0), (r + F.lit(ridge) - pull) / F.lit(1 + ridge))
            return up if most is None else F.least(up, F.lit(float(most)))

        return F.aggregate(_constant(steps, "array<array<double>>"), F.lit(1.0), step)

    steps: list[list[float]] = []
    for _ in range(rounds):
        at = cells.withColumn("rate", rate(steps))
        got = at.agg(*[F.sum(F.col("n") * c * F.col("rate")) for c in p]).first()
        over = [(float(g) / total - w) / a for g, w, a in zip(got, want, q)]
        if steps and max(abs(a - b) for a, b in zip(over, steps[-1])) < SETTLED:
            break
        steps.append(over)
    return rate(steps)


def rates(
    docs: DataFrame,
    labels: DataFrame,
    domains: dict[str, str] | None = None,
    targets: dict[str, float] | None = None,
    labelled: int = LABELLED,
    ridge: float = RIDGE,
    rounds: int = ROUNDS,
    volume: float | None = 1.0,
    kept: list[str] | None = None,
    vocabulary: int = VOCABULARY,
    grid: int = GRID,
    most: float | None = None,
) -> DataFrame:
    """docs (doc_id, text, ...) -> row (docs' columns, or those named in kept, as a struct), p_<domain>, tokens, rate, copies.

    targets are parts of volume times all tokens; without a volume, of the least one at which no wanted domain must be
    thinned; no document is repeated more than `most` times, if it is given, and targets are then missed by as little as that
    allows: missed() tells by how much. copies is the rate rounded up or down by a hash of doc_id and text, so that its mean is the rate: 0 drops a document.
    One row for each row. Null and empty texts have the prior as posterior and no tokens; without labelled documents all
    posteriors are the same; without tokens every rate is 1; doc_id may be null or repeat; docs' other columns may have
    any names. A target that no document can meet is missed by as little as the others allow.
    """
    domains, targets = domains or DOMAINS, targets or TARGETS
    names = list(domains)
    held = docs.select(F.struct(*(kept or ["*"])).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learned(held, labels, domains, labelled, vocabulary)
    columns = [f"p_{x}" for x in names]
    draw = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    scored = posteriors(held, names, model, grid).withColumn("tokens", tokens(F.col("text")))
    scored = stored(scored.select("row", *columns, "tokens", draw.alias("draw")), "scored")  # texts are read once
    cells = stored(scored.groupBy(*columns).agg(F.sum("tokens").alias("n")), "cells")
    rate = fitted(cells, names, targets, ridge, rounds, volume, most)
    draw = F.col("draw")
    return (
        scored.withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
        .select("row", *columns, "tokens", "rate", "copies")
    )


def missed(rated: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """rates' rows -> domain, target, got: the part of all tokens, documents at their rates, that each domain should have and has; one row a domain."""
    targets = targets or TARGETS
    total = F.sum(F.col("tokens") * F.col("rate"))
    sums = rated.agg(*[(F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{x}")) / total).alias(x) for x in targets])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(x).alias("domain"), F.lit(float(w)).alias("target"), F.col(x).alias("got")) for x, w in targets.items()])))


def mixed(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs, each row as often as its rate says, with docs' own columns."""
    return (
        rates(docs, labels, **how)
        .where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("row.*")
    )
