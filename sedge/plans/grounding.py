"""Queries over quotes, the claims they support and the citation marks of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import grounding as G, text as T
from sedge.operators import grounding as R
from sedge.plans.evidence import _listed
from sedge.session import stored
from sedge.sources import table as t

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _picked(of: tuple[str, ...], k):
    """The k-th of some texts, from 0, in Spark and in SQL."""
    return F.get(F.array(*map(F.lit, of)), (k % len(of)).cast("int"))


def _picked_sql(of: tuple[str, ...], k: str) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in of) + f"][CAST(({k}) % {len(of)} AS INTEGER) + 1]"


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_Q = "[\"''“”‘’()\\[\\]]*"
#: Sentences of documents by their marks, long ones cut at white space one after the other.
SPANS = rf"""mark AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])([ \t\n\x0b\f\r])', '\1' || chr(1) || '\2', 'g'), '\n\n', chr(10) || chr(1) || chr(10), 'g'), chr(1)) AS p FROM documents),
part AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM mark),
placed AS (SELECT *, coalesce(sum(length(x)) OVER w, 0) AS base, coalesce(sum(CASE WHEN regexp_matches(x, '(^|\s){_Q}(\pL{_Q}){{1,3}}\.$') THEN 0 ELSE 1 END) OVER w, 0) AS s
 FROM part WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
whole AS (SELECT doc_id, s, min(base) AS base, string_agg(x, '' ORDER BY k) AS x FROM placed GROUP BY 1, 2),
cut AS (SELECT doc_id, CAST(base + length(x) - length(ltrim(x, {_WHITE})) AS BIGINT) AS pos, trim(x, {_WHITE}) AS rest, '' AS quote, CAST(0 AS BIGINT) AS start_offset FROM whole
 UNION ALL SELECT doc_id, pos + n + length(substr(rest, n + 1)) - length(ltrim(substr(rest, n + 1), {_WHITE})), ltrim(substr(rest, n + 1), {_WHITE}), left(rest, n), pos
 FROM (SELECT *, CASE WHEN length(rest) <= 900 THEN length(rest) WHEN back > 0 AND 901 - back >= 585 THEN 901 - back ELSE 900 END AS n
  FROM (SELECT *, strpos(reverse(translate(left(rest, 901), chr(10) || chr(9), '  ')), ' ') AS back FROM cut WHERE rest <> ''))),
span AS (SELECT doc_id, start_offset, start_offset + length(q) AS end_offset, q AS quote FROM (SELECT *, rtrim(quote, {_WHITE}) AS q FROM cut) WHERE length(q) >= 10)"""


def _spans(s, d):
    return R.evidence_spans(t(s, d, "documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "doc_id")


@query(f"WITH RECURSIVE {SPANS} SELECT doc_id, start_offset, end_offset, quote, 'eva_' || left(sha256(doc_id || ':' || start_offset || ':' || end_offset || ':' || quote), 20) AS evidence_id FROM span")
def sentence_spans(s, d):
    """Quotes that evidence can be: each sentence of each document, at most 900 characters, with its offsets."""
    return _spans(s, d)


def _covered(x: str, hay: str) -> str:
    words = lambda y: f"list_filter(list_distinct(string_split(trim(regexp_replace(lower({y}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')), lambda w: length(w) >= 2 AND NOT list_contains({_listed(list(G.COVERAGE_STOP))}, w))"
    return f"CASE WHEN len({words(x)}) > 0 THEN len(list_intersect({words(x)}, {words(hay)})) / len({words(x)}) ELSE 0 END"


_KEY = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"""WITH RECURSIVE {SPANS},
c AS (SELECT doc_id, left(d.text, 80) || ' ' || left(b.text, CAST(15 + 12 * (doc_id % 9) AS INTEGER)) AS statement, left(b.text, 40) AS subject, left(d.text, 50) AS outcome
 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
e AS (SELECT *, start_offset - max(end_offset) OVER (PARTITION BY doc_id ORDER BY start_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM span WHERE (start_offset + doc_id) % 3 <> 0),
g AS (SELECT *, count(*) FILTER (WHERE gap > 240) OVER (PARTITION BY doc_id ORDER BY start_offset) AS cluster FROM e),
p AS (SELECT doc_id, cluster, string_agg(quote, ' ' ORDER BY start_offset) AS passage FROM g GROUP BY 1, 2),
m AS (SELECT doc_id, cluster, passage, {_covered("statement", "passage")} AS st, {_covered("subject", "passage")} AS su, {_covered("outcome", "passage")} AS ou,
 contains({_KEY.format("passage")}, {_KEY.format("statement")}) OR contains({_KEY.format("statement")}, {_KEY.format("passage")}) AS exact FROM p JOIN c USING (doc_id)),
r AS (SELECT *, exact OR st >= 0.62 OR (su >= 0.6 AND ou >= 0.55) AS direct FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY NOT direct, CASE WHEN direct THEN 0 ELSE -(st + su + ou) END, cluster) AS n FROM r)
SELECT c.doc_id, CASE WHEN o.doc_id IS NULL THEN 'none' WHEN direct THEN 'direct' WHEN st >= 0.4 OR (su >= 0.5 AND ou >= 0.3) THEN 'partial' ELSE 'none' END AS level,
 round(CASE WHEN o.doc_id IS NULL THEN 0 WHEN exact THEN 1 WHEN direct THEN least(1, greatest(st, (su + ou) / 2)) WHEN st >= 0.4 OR (su >= 0.5 AND ou >= 0.3) THEN least(0.6, greatest(st, (su + ou) / 2)) ELSE least(0.35, greatest(st, (su + ou) / 2)) END, 6) AS score,
 passage AS quote FROM c LEFT JOIN o ON o.doc_id = c.doc_id AND o.n = 1""")
def entailment_levels(s, d):
    """How far a document's sentences support a claim of its beginning and of a benchmark passage."""
    docs, items = t(s, d, "documents"), t(s, d, "benchmark")
    met = docs.withColumn("item_id", F.col("doc_id") % items.count()).join(items.select("item_id", F.col("text").alias("b")), "item_id")
    claims = met.select(
        F.col("doc_id").alias("id"), F.concat(F.left("text", F.lit(80)), F.lit(" "), F.left("b", (15 + 12 * (F.col("doc_id") % 9)).cast("int"))).alias("statement"),
        F.left("b", F.lit(40)).alias("subject"), F.left("text", F.lit(50)).alias("outcome"),
    )
    spans = _spans(s, d).where((F.col("start_offset") + F.col("doc_id")) % 3 != 0)
    evidence = spans.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("chunk"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), "quote", F.lit("supports").alias("stance"))
    return R.entailment(claims, evidence).select(F.col("id").alias("doc_id"), "level", F.round("score", 6).alias("score"), "quote")


SAID = (
    "Sleep may help memory", "Những giấc mơ về tương lai", "Nothing of the kind is claimed", "They recall the meeting and feel pressure", "Fear of danger in dreams of work. A new feeling", "Creative answers come after sleep",
)
SOURCES = ("memory during sleep and after awakening", "stress at work, the job and the project", "threat and fear, creativity and emotion", "trí nhớ, tương lai và giấc ngủ")
DETAILS = ("", "a feeling for the future", "pressure")


def _answers(s, d):
    """Documents as answers with marks, and two citations of benchmark passages for each."""
    k, docs, items = F.col("doc_id"), t(s, d, "documents"), t(s, d, "benchmark")
    text = F.concat("text", F.lit("\n"), _picked(SAID, k), F.lit(" [1]. "), _picked(SAID, k + 1), F.lit(" [2] and "), _picked(SAID, F.floor(k / 3)), F.lit(" [1], "), _picked(SAID, F.floor(k / 5)), F.lit(" [3] [2]"))
    answers = docs.select(F.col("doc_id").alias("id"), text.alias("text"))
    met = docs.select("doc_id", (k % items.count()).alias("item_id")).join(items.select("item_id", F.col("text").alias("b")), "item_id")
    cite = lambda i, x, y: F.struct(F.lit(i).cast("long").alias("index"), x.alias("excerpt"), y.alias("detail"))
    first = cite(1, F.concat("b", F.lit(" "), _picked(SOURCES, k)), _picked(DETAILS, k))
    second = cite(2, F.when(k % 7 == 0, F.left("b", F.lit(20))).otherwise(F.concat(_picked(SOURCES, F.floor(k / 2)), F.lit("  "), F.left("b", F.lit(60)))), _picked(DETAILS, F.floor(k / 4)))
    return answers, met.select(F.col("doc_id").alias("id"), F.inline(F.array(second, first)))


def _concepts_sql(x: str) -> str:
    """English and Vietnamese words of each concept, as a list of names."""
    said = {
        "memory": r"\bmemory|memories|remember|recall\b|trí nhớ", "future": r"\bfuture|upcoming\b|tương lai", "stress": r"\bstress|anxiety|pressure|worry\b", "work": r"\bwork|job|project|presentation|meeting\b",
        "emotion": r"\bemotion|affect|feeling\b", "creativity": r"\bcreative|creativity", "threat": r"\bthreat|danger|fear\b", "sleep": r"\bsleep|awakening|rem|nrem\b|giấc ngủ",
    }
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '(?i){p}') THEN '{n}' END" for n, p in said.items()) + "], lambda c: c IS NOT NULL)"


ANSWERS = rf"""a AS (SELECT doc_id, text || chr(10) || {_picked_sql(SAID, "doc_id")} || ' [1]. ' || {_picked_sql(SAID, "doc_id + 1")} || ' [2] and ' || {_picked_sql(SAID, "doc_id // 3")} || ' [1], ' || {_picked_sql(SAID, "doc_id // 5")} || ' [3] [2]' AS text FROM documents),
z AS (SELECT doc_id, 1 AS i, b.text || ' ' || {_picked_sql(SOURCES, "doc_id")} AS excerpt, {_picked_sql(DETAILS, "doc_id")} AS detail FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
 UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 7 = 0 THEN left(b.text, 20) ELSE {_picked_sql(SOURCES, "doc_id // 2")} || '  ' || left(b.text, 60) END, {_picked_sql(DETAILS, "doc_id // 4")} FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
y AS (SELECT doc_id, i, {_concepts_sql("excerpt || ' ' || detail")} AS has, length(trim(regexp_replace(excerpt, '\s+', ' ', 'g'))) >= 60 AS enough FROM z),
f AS (SELECT a.doc_id, text, 1 AS i, 1 AS pos, CAST(NULL AS VARCHAR) AS claim, CAST(NULL AS DOUBLE) AS coverage, CAST(NULL AS BOOLEAN) AS supported, 0 AS place FROM a
 UNION ALL SELECT doc_id, CASE WHEN hit = 0 OR supported THEN text ELSE left(text, pos + hit - 2) || '[?]' || substr(text, pos + hit + 2) END, CASE WHEN hit = 0 THEN i + 1 ELSE i END, CASE WHEN hit = 0 THEN 1 ELSE pos + hit + 2 END,
  CASE WHEN hit > 0 THEN claim END, CASE WHEN hit > 0 THEN share END, CASE WHEN hit > 0 THEN supported END, CASE WHEN hit = 0 THEN 0 ELSE place + 1 END
 FROM (SELECT *, enough AND share >= 0.75 AS supported FROM (SELECT *, CASE WHEN len(own) > 0 THEN len(list_intersect(own, has)) / len(own) ELSE 0 END AS share FROM (SELECT *, {_concepts_sql("claim")} AS own FROM
  (SELECT *, trim(regexp_replace(regexp_replace(right(left(text, pos + hit - 2), 700), '(?s)^.*[\n.!?]', ''), '\s+', ' ', 'g')) AS claim FROM
   (SELECT f.doc_id, f.text, f.i, f.pos, f.place, y.has, y.enough, strpos(substr(f.text, f.pos), '[' || f.i || ']') AS hit FROM f JOIN y ON y.doc_id = f.doc_id AND y.i = f.i))))))"""


@query(rf"WITH RECURSIVE {ANSWERS} SELECT doc_id, i AS citation, place, claim, round(coverage, 6) AS coverage, supported FROM f WHERE place > 0")
def citation_support(s, d):
    """Each citation mark of each answer: the claim before it, the share of its concepts that the citation has, whether it is supported."""
    found = R.checked_answers(*_answers(s, d), "detail")
    m = found.select(F.col("id").alias("doc_id"), F.inline("marks"))
    return m.select("doc_id", F.col("index").cast("int").alias("citation"), "place", "claim", F.round("coverage", 6).alias("coverage"), "supported")


@query(rf"WITH RECURSIVE {ANSWERS} SELECT doc_id, arg_max(text, i * 1000 + place) FILTER (WHERE i = 3) AS text FROM f GROUP BY doc_id")
def validated_answers(s, d):
    """Answers whose unsupported citation marks are open again."""
    return R.checked_answers(*_answers(s, d), "detail").select(F.col("id").alias("doc_id"), "text")


#: Sentences of answers; what each is as a claim, and the rule of RULES that it is most like, worked out by hand.
SENTENCES = (
    ("Sleep may consolidate memory and is associated with later recall of events.", "searchable", 0),
    ("Turning anxiety into concrete planning may reduce stress before an exam.", "searchable", 1),
    ("Daytime stress is often related to poor sleep quality in large samples of adults.", "searchable", 2),
    ("Exercise in the morning makes people happy and strong for the whole day.", "none", None),
    ("The dream suggests that stress is related to the meeting at work today.", "none", None),
    ("While you sleep, the house and the garden become related to old roads.", "none", None),
    ("Sleep occurs with slow waves that process the traces of the day in order.", "researchable", 3),
    ("Sleep is related to it.", "none", None),
    ("Is dreaming associated with memory in people who sleep badly at night?", "none", None),
    ("Creative dreams may help solutions to become more common in later years [3].", "searchable", None),
    ("Creative dreams may help solutions to become more common in later years [5].", "searchable", None),
    ("Giấc mơ hướng tới tương lai có thể phổ biến hơn vào cuối đêm của người lớn.", "searchable", 4),
    ("Awakening occurs where the traces of the whole day are processed in silence.", "researchable", None),
    ("Bạn nên ngủ sớm vì giấc ngủ có thể liên quan đến trí nhớ của người lớn.", "none", None),
    *((f"Daytime stress is often related to poor sleep quality in adults aged {n}.", "searchable", 2) for n in (20, 30, 40, 50, 60)),
)
RULES = (
    "Sleep may consolidate memory and is associated with later recall", "Concrete planning may reduce anxiety and stress", "Poor sleep quality is related to daytime stress in adults",
    "Slow waves of sleep occur in order", "Future-oriented dreams are more common later in the night",
)


@query("SELECT doc_id, [" + ", ".join(f"'{kind}'" for _, kind, _ in SENTENCES) + f"][CAST(doc_id % {len(SENTENCES)} AS INTEGER) + 1] AS kind FROM documents")
def claim_kinds(s, d):
    """Whether a sentence states something that research can answer, and whether sources can be sought for it; sources are named after it."""
    x = F.concat(F.lit("- **"), _picked(tuple(x for x, *_ in SENTENCES), F.col("doc_id")), F.lit("**"))
    return t(s, d, "documents").select("doc_id", G.claim_kind(x).alias("kind"))


@query(f"""WITH said AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x}', '{kind}', {'NULL' if r is None else r}, {9 if i == 10 else i})" for i, (x, kind, r) in enumerate(SENTENCES))}) AS v(i, claim, kind, r, key)),
u AS (SELECT doc_id, j, (doc_id * 7 + j * 3) % {len(SENTENCES)} AS i FROM documents, unnest(range(0, 4 + doc_id % 16)) AS g(j)),
c AS (SELECT doc_id, key, min(j) AS j, arg_min(claim, j) AS claim, arg_min(kind, j) AS kind, arg_min(r, j) AS r FROM u JOIN said USING (i) WHERE kind <> 'none' GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS place FROM c QUALIFY place < 8),
e AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS rule_id, min((doc_id % 11) * 1000000 + doc_id) AS v FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1),
b AS (SELECT r, min(item_id) AS rule_id FROM (SELECT item_id, item_id % 6 AS r FROM benchmark) GROUP BY 1),
m AS (SELECT p.*, e.rule_id, v // 1000000 AS source_id, v % 1000000 AS evidence_id FROM p LEFT JOIN b USING (r) LEFT JOIN e USING (rule_id)),
n AS (SELECT doc_id, source_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(place), source_id) AS citation_index FROM m WHERE source_id IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, CAST(place AS INTEGER) AS place, claim, rule_id, source_id, evidence_id, citation_index, CASE WHEN source_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
FROM m LEFT JOIN n USING (doc_id, source_id) WHERE source_id IS NOT NULL OR kind = 'searchable'""")
def grounded_claims(s, d):
    """Claims of answers bound to the rules they are cases of and to the sources of these, numbered as they are cited."""
    k, docs, items = F.col("doc_id"), t(s, d, "documents"), t(s, d, "benchmark")
    every = F.array(*[F.lit(x) for x, *_ in SENTENCES])
    said = F.transform(F.sequence(F.lit(0).cast("long"), 3 + k % 16), lambda j: F.get(every, ((k * 7 + j * 3) % len(SENTENCES)).cast("int")))
    answers = docs.select(k.alias("id"), F.array_join(said, " ").alias("text"))
    rules = items.select(F.col("item_id").alias("id"), F.coalesce(_picked((*RULES, ""), F.col("item_id")), F.lit("")).alias("said"), "text")
    rules = rules.select("id", F.when(F.col("said") == "", F.col("text")).otherwise(F.col("said")).alias("text"))
    evidence = docs.select((k % items.count()).alias("rule_id"), (k % 11).alias("source_id"), k.alias("evidence_id"), F.when(k % 3 == 0, " ").otherwise(F.col("text")).alias("quote"))
    return R.grounded_claims(answers, rules, evidence).withColumnRenamed("id", "doc_id")


_GAPS = f"""said AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{x}', '{kind}', {'NULL' if r is None else r})" for i, (x, kind, r) in enumerate(SENTENCES))}) AS v(i, claim, kind, r)),
c AS (SELECT doc_id % 20 AS user, claim, r, doc_id FROM documents JOIN said ON i = (doc_id // 20) % {len(SENTENCES)} WHERE kind = 'searchable')"""


def _claims(s, d):
    k = F.col("doc_id")
    x = t(s, d, "documents").select((k % 20).alias("user"), _picked(tuple(x for x, *_ in SENTENCES), F.floor(k / 20)).alias("claim"), k.alias("doc_id"))
    return x.where(G.claim_kind(F.col("claim")) == "searchable").withColumn("key", T.symbol_key(T.clean_claim(F.col("claim"))))


@query(f"""WITH {_GAPS}, n AS (SELECT item_id, item_id % 6 AS r FROM benchmark WHERE item_id % 5 <> 0), b AS (SELECT r, min(item_id) AS rule_id FROM n GROUP BY r)
SELECT user, claim, count(*) AS occurrences, any_value(rule_id) AS rule_id FROM c LEFT JOIN b USING (r) GROUP BY user, claim HAVING any_value(rule_id) IS NOT NULL OR count(*) FILTER (WHERE doc_id % 3 > 0) > 0""")
def evidence_gaps(s, d):
    """Claims that lack evidence, captured in two rounds, matched with rules, and reconciled after a fifth of the rules has gone and a third come; dead ones pruned."""
    claims, items = _claims(s, d), t(s, d, "benchmark")
    empty = claims.limit(0).select("user", "key", "claim", F.array("claim").alias("variants"), F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("rule_id"), F.lit(0.0).alias("score"))
    gaps = R.captured_gaps(R.captured_gaps(empty, claims.where("doc_id % 2 = 0")), claims.where("doc_id % 2 = 1"))
    rules = items.select(F.col("item_id").alias("id"), F.coalesce(_picked((*RULES, ""), F.col("item_id")), F.lit("")).alias("said"), "text")
    rules = rules.select("id", F.when(F.col("said") == "", F.col("text")).otherwise(F.col("said")).alias("text"))
    matched = stored(R.matched_gaps(gaps, rules.where("id % 3 <> 0")), "gaps")
    now = R.reconciled_gaps(matched, rules.where("id % 5 <> 0"), rules.where("(id % 3 <> 0) <> (id % 5 <> 0)").select("id"))
    return R.pruned_gaps(now, claims.where("doc_id % 3 > 0")).select("user", "claim", "occurrences", "rule_id")
