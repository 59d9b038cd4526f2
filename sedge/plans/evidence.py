"""Queries over claims, rules and the evidence for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import claims as C, text as T
from sedge.operators import evidence as V, retrieval as R
from sedge.sources import table as t

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 3))"


def _cleaned(x: str) -> str:
    for pattern, to in T.CLAIM_MARKS:
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return f"trim({x})"


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ASKED = "the thand and onen nicht heon que tion with erthe src3"
ASKED_VECTOR = [float(i % 3) for i in range(64)]


def _content(x: str) -> str:
    return f"list_filter({_words(x)}, lambda w: NOT list_contains({_listed(C.SEARCH_STOP)}, w))"


NEAR = "CASE WHEN len({0}) > 0 THEN len(list_intersect({0}, q)) / least(12, len({0})) ELSE 0 END"


@query(f"""WITH x AS (SELECT d.doc_id, {_content("d.source || ' ' || d.lang")} AS lx, {_content("d.source")} AS tg, {_content("d.text")} AS st, {_content(f"'{ASKED}'")} AS q,
20 + 60 * coalesce(l.quality, 0) AS ev, CAST(e.embedding AS DOUBLE[]) AS v, CAST({ASKED_VECTOR} AS DOUBLE[]) AS a, d.lang FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
y AS (SELECT doc_id, lang, {NEAR.format('lx')} AS lx, {NEAR.format('tg')} AS tg, {NEAR.format('st')} AS st, ev, coalesce(list_dot_product(v, a) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(a, a))), -1) AS cos FROM x)
SELECT doc_id, round(least(1, tg) * 0.4 + least(1, lx) * 0.23 + least(1, st) * 0.12 + greatest(0, cos) * 0.15 + ev / 100 * 0.1, 6) AS score, lang <> 'en' AS cross_language FROM y WHERE greatest(tg, lx, st) >= 0.1""")
def rule_ranking(s, d):
    docs = t(s, d, "documents").join(t(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    docs = docs.join(t(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    rules = docs.select(
        "doc_id", F.col("source").alias("subject"), F.col("lang").alias("outcome"), F.col("text").alias("statement"), F.array().cast("array<string>").alias("conditions"), F.array("source").alias("tags"),
        F.array().cast("array<string>").alias("parts"), "embedding", (20 + 60 * F.coalesce("quality", F.lit(0))).alias("evidence_score"), F.col("lang").alias("source_language"),
    )
    return R.ranked_rules(rules, ASKED, ASKED_VECTOR).select("doc_id", F.round("score", 6).alias("score"), "cross_language")


@query(f"""SELECT item_id, array_to_string(list_sort(list_filter({_words(_cleaned('text'))}, lambda w: NOT list_contains({_listed(C.STOP)}, w))), ' ') AS key FROM benchmark""")
def claim_keys(s, d):
    return t(s, d, "benchmark").select("item_id", C.cluster_key(F.col("text")).alias("key"))


@query(f"""WITH c AS (SELECT item_id AS claim_id, {_words(_cleaned('text'))} AS w FROM benchmark), r AS (SELECT conv_id * 1000 + turn AS rule_id, {_words(_cleaned('text'))} AS w FROM conversations WHERE role = 'user'),
p AS (SELECT claim_id, rule_id, CASE WHEN least(len(c.w), len(r.w)) > 0 THEN len(list_intersect(c.w, r.w)) / least(len(c.w), len(r.w)) ELSE 0 END AS o,
list_sort(list_filter(c.w, lambda w: NOT list_contains({_listed(C.STOP)}, w))) AS ck, list_sort(list_filter(r.w, lambda w: NOT list_contains({_listed(C.STOP)}, w))) AS rk FROM c, r)
SELECT claim_id, rule_id, round(score, 6) AS score FROM (SELECT claim_id, rule_id, CASE WHEN ck = rk AND len(ck) > 0 THEN greatest(o, 0.72) ELSE o END AS score FROM p) WHERE score >= 0.28""")
def claim_matches(s, d):
    c = t(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    r = t(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return R.matching_claims(c, r, 0.28).select("claim_id", "rule_id", F.round("score", 6).alias("score"))


@query(f"""WITH c AS (SELECT item_id AS claim_id, {_words(_cleaned('text'))} AS w FROM benchmark), r AS (SELECT conv_id * 1000 + turn AS rule_id, {_words(_cleaned('text'))} AS w FROM conversations WHERE role = 'user'),
p AS (SELECT claim_id, rule_id, array_to_string(list_sort(list_filter(r.w, lambda w: NOT list_contains({_listed(C.STOP)}, w))), ' ') AS key, round(CASE WHEN least(len(c.w), len(r.w)) > 0 THEN len(list_intersect(c.w, r.w)) / least(len(c.w), len(r.w)) ELSE 0 END, 6) AS score FROM c, r)
SELECT key, claim_id, rule_id, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, claim_id, rule_id) AS n FROM p WHERE score >= 0.28) WHERE n = 1 ORDER BY score DESC, key LIMIT 8""")
def claims_needed(s, d):
    """The best match of each key, and of these the eight best."""
    from sedge.operators.ordered import first_wins

    r = t(s, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    met = R.matching_claims(t(s, d, "benchmark").select(F.col("item_id").alias("id"), "text"), r, 0.28).withColumn("score", F.round("score", 6))
    met = met.join(r.select(F.col("id").alias("rule_id"), C.cluster_key(F.col("text")).alias("key")), "rule_id")
    return first_wins(met, ["key"], [F.desc("score"), "claim_id", "rule_id"]).orderBy(F.desc("score"), "key").limit(8).select("key", "claim_id", "rule_id", "score")


RELATIONS = """WITH p AS (SELECT min(p_partkey) AS id, split_part(p_name, ' ', 1) AS s, split_part(p_name, ' ', 2) AS o, lower(p_type) AS k, list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)]) AS w, CASE p_type WHEN 'ECONOMY' THEN 'positive' WHEN 'SMALL' THEN 'negative' ELSE 'neutral' END AS pol FROM part GROUP BY p_name, p_type),
r AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.s = b.s AND a.o = b.o THEN CASE WHEN list_sort([a.pol, b.pol]) = ['negative', 'positive'] THEN 'contradictory' ELSE 'equivalent' END
WHEN a.s = b.s OR len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.38 THEN 'complementary' ELSE 'unrelated' END AS relation FROM p a JOIN p b ON a.id < b.id)
"""


def _rules(s, d):
    p = t(s, d, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id"))
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    polarity = F.when(F.col("p_type") == "ECONOMY", "positive").when(F.col("p_type") == "SMALL", "negative").otherwise("neutral")
    return p.select(
        "id", word(1).alias("subject"), word(2).alias("outcome"), F.concat_ws(" ", "p_name", "p_type").alias("statement"), polarity.alias("polarity"),
        F.lit(False).alias("null_finding"), F.lit("").alias("conditions"), F.array().cast("array<string>").alias("chunks"), F.lower("p_type").alias("kind"),
    )


@query(RELATIONS + "SELECT a, b, relation FROM r WHERE relation <> 'unrelated'")
def rule_relations(s, d):
    return R.related_rules(_rules(s, d))


def _merge_rules(s, d):
    """Rules of part names and types, in singular and plural and with endings, with paragraphs, questions and sources."""
    p = t(s, d, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id"))
    k = F.col("id")
    subject = F.concat("p_name", F.when(k % 2 == 1, "s").otherwise(""))
    outcome = F.concat(F.lit("q"), F.lower("p_type"), F.get(F.array(F.lit(""), F.lit("ly"), F.lit("s")), (k % 3).cast("int")), F.lit(" effect"))
    polarity = F.when(F.col("p_type") == "ECONOMY", "positive").when(F.col("p_type") == "SMALL", "negative").otherwise("neutral")
    x = p.select("id", subject.alias("subject"), outcome.alias("outcome"), polarity.alias("polarity"))
    return x.select(
        "*", F.concat(F.lit("The "), "subject", F.lit(" relates to "), "outcome").alias("statement"), F.lit(False).alias("null_finding"), F.array((k % 50).cast("string")).alias("chunks"),
        F.when(k % 4 == 0, "timing").otherwise("none").alias("question"), (k % 3).alias("source"),
    )


_CLASS = """list_distinct(list_transform(list_filter(string_split(lower({0}), ' '), lambda w: w NOT IN ('the', 'to', '')), lambda w:
 left(CASE WHEN length(w) > 5 AND right(w, 2) = 'es' THEN left(w, -2) WHEN length(w) > 4 AND right(w, 1) = 's' THEN left(w, -1) ELSE w END, 5)))"""
_JACCARD = "len(list_intersect(a.{0}, b.{0})) / (len(a.{0}) + len(b.{0}) - len(list_intersect(a.{0}, b.{0})))"
MERGES = f"""p AS (SELECT p_name, p_type, min(p_partkey) AS id FROM part GROUP BY 1, 2),
x AS (SELECT id, p_name || CASE WHEN id % 2 = 1 THEN 's' ELSE '' END AS subject, 'q' || lower(p_type) || ['', 'ly', 's'][CAST(id % 3 AS INTEGER) + 1] || ' effect' AS outcome, p_type FROM p),
y AS (SELECT id, p_type, {_CLASS.format("subject")} AS s, {_CLASS.format("outcome")} AS o, {_CLASS.format("'The ' || subject || ' relates to ' || outcome")} AS t FROM x),
z AS (SELECT a.id AS a, b.id AS b, {_JACCARD.format("s")} AS s, {_JACCARD.format("o")} AS o, {_JACCARD.format("t")} AS t, a.id % 50 = b.id % 50 AS paragraph, a.id % 4 = 0 AND b.id % 4 = 0 AS question, a.id % 3 = b.id % 3 AS source
 FROM y a JOIN y b ON a.id < b.id WHERE list_sort([a.p_type, b.p_type]) <> ['ECONOMY', 'SMALL']),
m AS (SELECT a, b, list_filter([CASE WHEN paragraph THEN 'same_canonical_paragraph' END, CASE WHEN s >= 0.65 AND o >= 0.65 THEN 'equivalent_subject_and_outcome' END,
 CASE WHEN s >= 0.72 AND (o >= 0.15 OR t >= 0.25) THEN 'same_meaningful_subject' END, CASE WHEN o >= 0.72 AND (s >= 0.15 OR t >= 0.25) THEN 'same_meaningful_outcome' END,
 CASE WHEN t >= 0.55 AND s >= 0.3 AND o >= 0.3 THEN 'same_statement_semantics' END, CASE WHEN question AND t >= 0.45 THEN 'same_question_and_semantics' END], lambda r: r IS NOT NULL) AS reasons,
 list_filter([CASE WHEN source THEN 'same_source_document' END, CASE WHEN paragraph THEN 'same_canonical_paragraph' END, CASE WHEN s >= 0.3 THEN 'related_subject' END, CASE WHEN o >= 0.3 THEN 'related_outcome' END,
 CASE WHEN t >= 0.25 THEN 'similar_statement' END, CASE WHEN question THEN 'same_question_kind' END], lambda r: r IS NOT NULL) AS signals FROM z)
"""


@query("WITH " + MERGES + "SELECT a, b, array_to_string(reasons, ',') AS reasons, array_to_string(signals, ',') AS signals FROM m WHERE len(reasons) > 0")
def mergeable_rules(s, d):
    """Pairs of rules that may become one, with the reasons for it and what else they share."""
    return R.mergeable_rules(_merge_rules(s, d)).select("a", "b", F.array_join("reasons", ",").alias("reasons"), F.array_join("signals", ",").alias("signals"))


@query("WITH RECURSIVE " + MERGES + """, n AS (SELECT a AS id, b FROM m WHERE len(reasons) > 0 AND 1 + a % 5 <> b % 5 UNION SELECT b, a FROM m WHERE len(reasons) > 0 AND 1 + a % 5 <> b % 5), near AS (SELECT id, list(b ORDER BY b) AS nb FROM n GROUP BY id),
every AS (SELECT map(list(id), list(nb)) AS of FROM near),
g AS (SELECT CAST(-1 AS BIGINT) AS seed, CAST([] AS BIGINT[]) AS grp, CAST([] AS BIGINT[]) AS gone
 UNION ALL SELECT seed, grp, CASE WHEN len(grp) BETWEEN 2 AND 12 THEN list_concat(gone, grp) ELSE gone END FROM
 (SELECT seed, list_reduce(list_transform(list_filter(of[seed], lambda c: NOT list_contains(gone, c)), lambda c: [c]), lambda h, c: CASE WHEN list_has_all(of[c[1]], h) THEN list_concat(h, c) ELSE h END, [seed]) AS grp, gone FROM
  (SELECT (SELECT min(id) FROM near WHERE id > g.seed AND NOT list_contains(g.gone, id)) AS seed, gone FROM g), every) WHERE seed IS NOT NULL)
SELECT unnest(grp) AS id, seed AS group_id FROM g WHERE len(grp) BETWEEN 2 AND 12""")
def merge_groups(s, d):
    """Groups of rules of which each may merge with all others; pairs that a reviewer has refused are left out."""
    pairs = R.mergeable_rules(_merge_rules(s, d)).where("1 + a % 5 <> b % 5")
    return R.merge_groups(_merge_rules(s, d).select("id"), pairs.select("a", "b"))


@query(RELATIONS + """, e AS (SELECT a, b FROM r WHERE relation IN ('equivalent', 'contradictory') UNION SELECT b, a FROM r WHERE relation IN ('equivalent', 'contradictory')), w AS (SELECT a AS node, least(min(b), a) AS root FROM e GROUP BY a)
SELECT 'rule-cluster:' || root AS cluster_id, count(*) AS members FROM w GROUP BY root""")
def concept_clusters(s, d):
    """Rules that are about the same as one: the components of their relations, named after the least member."""
    from sedge.operators.components import components

    e = rule_relations(s, d).where(F.col("relation").isin("equivalent", "overlapping", "contradictory", "reverse_direction", "scope_tension", "shared_context"))
    return components(e.select("a", "b")).groupBy(F.concat(F.lit("rule-cluster:"), "root").alias("cluster_id")).agg(F.count("*").alias("members"))


@query("""WITH e AS (SELECT DISTINCT l_suppkey AS rule_id, l_partkey % 500 AS quote FROM lineitem WHERE l_quantity > 45), v AS (SELECT event_id, user_id % 100 + 1 AS rule_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS sign FROM events),
s AS (SELECT DISTINCT a.rule_id, b.rule_id AS other FROM e a JOIN e b USING (quote) WHERE a.rule_id <> b.rule_id), m AS (SELECT rule_id, 2 * sign AS w FROM v UNION ALL SELECT s.other, sign FROM v JOIN s USING (rule_id))
SELECT s_suppkey AS rule_id, CAST(coalesce(sum(w), 0) AS BIGINT) AS adjustment, CAST(greatest(0, least(100, 50 + coalesce(sum(w), 0))) AS INTEGER) AS score, CASE WHEN greatest(0, least(100, 50 + coalesce(sum(w), 0))) >= 85 THEN 'strong' WHEN greatest(0, least(100, 50 + coalesce(sum(w), 0))) >= 65 THEN 'moderate' WHEN greatest(0, least(100, 50 + coalesce(sum(w), 0))) >= 45 THEN 'limited' ELSE 'weak' END AS tier
FROM supplier LEFT JOIN m ON m.rule_id = s_suppkey GROUP BY s_suppkey""")
def propagated_votes(s, d):
    """Votes move the rule asked about, and by less each rule that rests on one of the same quotes."""
    evidence = t(s, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("rule_id"), F.sha2((F.col("l_partkey") % 500).cast("string"), 256).alias("quote"))
    effect = F.when(F.col("event_type") == "purchase", "supports").when(F.col("event_type") == "error", "weakens").otherwise("undecided")
    votes = t(s, d, "events").select((F.col("user_id") % 100 + 1).alias("rule_id"), effect.alias("effect"))
    scores = t(s, d, "supplier").select(F.col("s_suppkey").alias("rule_id"), F.lit(50).alias("score"), F.lit("limited").alias("tier"))
    return V.voted(scores, V.propagated(votes, evidence)).select("rule_id", "adjustment", "score", "tier")


SCORES = """WITH r AS (SELECT s_suppkey AS rule_id, CASE s_nationkey % 3 WHEN 0 THEN 'association' WHEN 1 THEN 'intervention_effect' ELSE 'qualitative_theme' END AS claim, s_acctbal > 0 AS accepted, s_nationkey % 2 = 0 AS cond, s_nationkey % 5 = 0 AS lim, CASE s_nationkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'conditional' WHEN 2 THEN 'background' ELSE 'not_usable' END AS ready FROM supplier),
e AS (SELECT l_suppkey AS rule_id, l_orderkey * 10 + l_linenumber AS pos, CAST(l_orderkey % 4 AS VARCHAR) AS src, CAST(l_orderkey % 4 AS VARCHAR) || ':' || CAST(l_partkey % 3 AS VARCHAR) AS place, CASE WHEN l_returnflag = 'R' AND l_quantity > 48 THEN 'refutes' WHEN l_returnflag = 'A' THEN 'limits' ELSE 'supports' END AS stance,
CASE l_linenumber % 3 WHEN 0 THEN 'mixed' WHEN 1 THEN 'case_report' ELSE 'meta_analysis' END AS kind, CASE WHEN l_tax > 0.05 THEN 'high' WHEN l_tax > 0.02 THEN 'medium' ELSE 'low' END AS sure, CASE WHEN l_discount > 0.08 THEN 'preprint' WHEN l_discount > 0.02 THEN 'peer_reviewed' END AS standing FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_orderkey, l_linenumber ORDER BY l_partkey) = 1),
f AS (SELECT e.*, CASE WHEN CASE claim WHEN 'qualitative_theme' THEN kind IN ('mixed', 'case_report') ELSE kind IN ('mixed', 'meta_analysis') END THEN least(CASE WHEN claim = 'intervention_effect' THEN least(17, CASE sure WHEN 'high' THEN 25 WHEN 'medium' THEN 18 ELSE 11 END) ELSE CASE sure WHEN 'high' THEN 25 WHEN 'medium' THEN 18 ELSE 11 END END, CASE WHEN standing IS NULL THEN 16 WHEN standing = 'preprint' THEN 20 ELSE 100 END) ELSE 0 END AS fit FROM e JOIN r USING (rule_id)),
n AS (SELECT rule_id, count(DISTINCT place) FILTER (WHERE stance = 'supports') AS sup, count(DISTINCT place) FILTER (WHERE stance = 'refutes') AS ref, count(DISTINCT src) FILTER (WHERE stance = 'supports') AS ssrc FROM f GROUP BY rule_id),
g AS (SELECT rule_id, floor(avg(fit) + 0.5) AS fit FROM (SELECT rule_id, src, arg_min(fit, pos) AS fit FROM f WHERE stance = 'supports' GROUP BY rule_id, src) GROUP BY rule_id),
s AS (SELECT r.*, coalesce(sup, 0) AS sup, coalesce(ref, 0) AS ref, coalesce(ssrc, 0) AS ssrc, [0, 8, 20, 30][least(coalesce(ssrc, 0), 3) + 1] + [0, 4, 9, 12, 15][least(coalesce(sup, 0), 4) + 1] + coalesce(fit, 0) + CASE WHEN cond THEN 7 ELSE 0 END + CASE WHEN lim THEN 8 ELSE 0 END
+ CASE WHEN coalesce(sup, 0) = 0 THEN 0 WHEN ref > 0 THEN 5 WHEN ssrc >= 2 THEN 15 ELSE 7 END AS raw FROM r LEFT JOIN n USING (rule_id) LEFT JOIN g USING (rule_id)),
z AS (SELECT *, CAST(CASE WHEN sup = 0 THEN 0 ELSE least(CASE WHEN accepted THEN raw ELSE least(raw, 20) END, CASE WHEN ref > 0 THEN 65 ELSE 100 END, 100) END AS INTEGER) AS score FROM s)
"""


def _scored(s, d):
    p, l = t(s, d, "supplier"), t(s, d, "lineitem")
    one_of = lambda c, n, names: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % n + 1).cast("int"))
    rules = p.select(
        F.col("s_suppkey").alias("rule_id"), one_of("s_nationkey", 3, ["association", "intervention_effect", "qualitative_theme"]).alias("claim_type"), (F.col("s_acctbal") > 0).alias("accepted"),
        one_of("s_nationkey", 4, ["direct", "conditional", "background", "not_usable"]).alias("readiness"), (F.col("s_nationkey") % 2 == 0).alias("has_conditions"), (F.col("s_nationkey") % 5 == 0).alias("has_limitations"), "s_nationkey",
    )
    l = l.groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.min_by(F.struct("*"), "l_partkey").alias("x")).select("x.*")
    evidence = l.select(
        F.col("l_suppkey").alias("rule_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), (F.col("l_orderkey") % 4).cast("string").alias("source_id"), (F.col("l_partkey") % 3).cast("string").alias("chunk_id"),
        F.lit(None).cast("string").alias("quote"), F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48), "refutes").when(F.col("l_returnflag") == "A", "limits").otherwise("supports").alias("stance"),
        F.lit("canonical_exact").alias("exactness"), F.lit(1.0).alias("verification"), one_of("l_linenumber", 3, ["mixed", "case_report", "meta_analysis"]).alias("research_type"),
        F.when(F.col("l_tax") > 0.05, "high").when(F.col("l_tax") > 0.02, "medium").otherwise("low").alias("certainty"), F.when(F.col("l_discount") > 0.08, "preprint").when(F.col("l_discount") > 0.02, "peer_reviewed").alias("standing"),
    )
    return V.scored(rules, evidence)


@query(SCORES + """SELECT rule_id, score, sup AS supports, ssrc AS supporting_sources, CASE WHEN ref > 0 AND sup > 0 THEN 'mixed' WHEN score >= 85 THEN 'strong' WHEN score >= 65 THEN 'moderate' WHEN score >= 45 THEN 'limited' ELSE 'weak' END AS tier, accepted AND ready <> 'not_usable' AND score >= 60 AND ssrc >= 2 AS eligible FROM z""")
def evidence_scores(s, d):
    return _scored(s, d).select("rule_id", "score", "supports", "supporting_sources", "tier", "eligible")


@query(SCORES + """SELECT s_nationkey AS composite_id, min(score) AS score, arg_min(rule_id, (score, rule_id)) AS weakest_rule_id, CAST(sum(sup) AS BIGINT) AS supports, bool_and(accepted AND ready <> 'not_usable' AND score >= 60 AND ssrc >= 2) AS eligible FROM z JOIN supplier ON s_suppkey = rule_id GROUP BY s_nationkey""")
def composite_scores(s, d):
    parts = _scored(s, d).withColumn("composite_id", F.col("s_nationkey")).withColumn("position", F.col("rule_id"))
    return V.weakest(parts).select("composite_id", "score", "weakest_rule_id", "supports", "eligible")
