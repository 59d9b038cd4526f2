"""Queries over the blocks of documents: their lines as blocks, some of them headings, references, tables and enumerations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import blocks as B, genres as G
from sedge.operators import blocks as O
from sedge.plans.grounding import _picked, _picked_sql
from sedge.sources import table as t

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


HEADINGS = (
    "Introduction", "Rights and permissions", "A heading of its own", "Related articles", "Results and more", "Acknowledgements", "Author information", "Open access", "Discussion", "Another heading", "Funding", "Methods", "Subject terms",
    "Cookie settings", "References", "Empty",
)
LINES = (
    "METHODS We took samples of all", "1,2 Department of Letters", "page 3 of 9", "© 2020 The authors, all rights reserved.", "contact: a.b@example.org", "Funding was given by no one.", "12 34 / 5", "Abstract: what this is about, in short.", "short.", "RESULTS 12 of them",
)
KINDS = ("reference", "table", "list_item", "figure")

#: A document's lines in order: every third a heading, every fifth a planted line, every eleventh of another kind.
BLOCKS = f"""line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents),
block AS (SELECT doc_id AS doc, position, CASE WHEN (doc_id + position) % 3 = 0 THEN 'heading' WHEN (doc_id + position) % 11 = 0 THEN {_picked_sql(KINDS, "position")} ELSE 'paragraph' END AS kind,
 CASE WHEN (doc_id + position) % 3 = 0 THEN {_picked_sql(HEADINGS, "doc_id * 5 + position // 3")} WHEN (doc_id + position) % 5 = 0 THEN {_picked_sql(LINES, "doc_id + position // 5")} ELSE x END AS text FROM line),
other AS (SELECT DISTINCT doc, lower(text) AS heading FROM block WHERE kind = 'heading' AND doc % 3 > 0 AND (doc + position) % 2 = 0)"""


def _blocks(s, d):
    x = t(s, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("position", "x")).withColumn("position", F.col("position").cast("long"))
    k, p = F.col("doc"), F.col("position")
    heading = (k + p) % 3 == 0
    kind = F.when(heading, "heading").when((k + p) % 11 == 0, _picked(KINDS, p)).otherwise("paragraph")
    text = F.when(heading, _picked(HEADINGS, k * 5 + F.floor(p / 3))).when((k + p) % 5 == 0, _picked(LINES, k + F.floor(p / 5))).otherwise(F.col("x"))
    return x.select("doc", "position", kind.alias("kind"), text.alias("text"))


def _other(blocks):
    """Headings of another rendition: every second one of two documents in three."""
    return blocks.where("kind = 'heading' and doc % 3 > 0 and (doc + position) % 2 = 0").select("doc", F.lower("text").alias("heading")).distinct()


def _any(words) -> str:
    return "(" + "|".join(w.replace(r"\s+", " +") for w in words) + ")"


_L = "lower(trim(text))"
CLASS = f"""CASE WHEN trim(text) = '' THEN 'unknown_noise' WHEN kind IN ('reference', 'figure', 'table') THEN 'article_' || kind WHEN regexp_matches({_L}, 'related articles|open access|cookie|history|metrics|sign +in|log +in|subscribe') THEN 'navigation_or_widget'
WHEN regexp_matches({_L}, '^(page \\d+( of \\d+)?|\\d+\\s*)$') THEN 'pdf_page_marker' WHEN regexp_matches({_L}, '© the author|© \\d{{4}}|all rights reserved|^open$|^article$') AND length(trim(text)) < 250 THEN 'pdf_header_footer'
WHEN regexp_matches({_L}, '^([0-9():;,. /#+*_-]+|[a-z])$') THEN 'garbage_noise' WHEN contains(text, '@') AND length(trim(text)) < 250 AND regexp_matches({_L}, 'email|correspondence|contact|orcid|^[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{{2,}}$') THEN 'correspondence_email'
WHEN kind <> 'heading' AND length(trim(text)) < 400 AND (regexp_matches({_L}, 'university|department|institute|hospital|school of|academy|clinic|center for|laborator|universiteit|universidad|faculdade|faculty')
 OR (NOT regexp_matches(trim(text), '[.!?]$') AND (regexp_matches({_L}, '^(\\d|[a-z]\\d)') OR length(trim(text)) < 150))) THEN 'author_affiliation'
WHEN kind = 'heading' AND regexp_matches({_L}, 'rights and permissions|author information|acknowledgements|subject') THEN 'publisher_boilerplate' WHEN i < 12 AND starts_with({_L}, 'abstract') THEN 'article_abstract'
WHEN kind = 'heading' THEN 'article_heading' WHEN kind = 'paragraph' AND length(trim(text)) < 15 THEN 'garbage_noise' ELSE 'article_paragraph' END"""
_STATE = "last_value({} IGNORE NULLS) OVER (PARTITION BY doc ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
KEPT = f"""kept AS (SELECT doc, position, kind, text, row_number() OVER (PARTITION BY doc ORDER BY position) - 1 AS i FROM (SELECT *, {_STATE.format(f"CASE WHEN kind = 'heading' AND regexp_matches({_L}, 'rights and permissions|acknowledgements|funding|author information|related articles') THEN 1 WHEN kind = 'heading' AND regexp_matches({_L}, 'introduction|methods|results|discussion|references') THEN 0 END")} AS off FROM block)
 WHERE coalesce(off, 0) = 0 AND NOT (kind = 'paragraph' AND starts_with({_L}, 'funding') AND length(trim(text)) < 300))"""


@query(f"WITH {BLOCKS}, n AS (SELECT *, position AS i FROM block) SELECT doc, position, {CLASS} AS class FROM n")
def block_classes(s, d):
    """What each block is: a part of the article, or of its margins, its navigation, its authors, or noise."""
    return _blocks(s, d).select("doc", "position", B.block_class(F.col("kind"), F.col("text"), F.col("position")).alias("class"))


@query(f"""WITH {BLOCKS}, {KEPT}, c AS (SELECT k.*, {CLASS} AS class, o.doc IS NOT NULL AS known FROM kept k LEFT JOIN other o ON o.doc = k.doc AND o.heading = {_L}),
f AS (SELECT *, {_STATE.format(f"CASE WHEN kind = 'heading' AND regexp_matches({_L}, 'related articles|open access|cookie') THEN 1 WHEN kind = 'heading' AND (known OR regexp_matches({_L}, 'introduction|methods|results|discussion|references')) THEN 0 END")} AS off FROM c)
SELECT doc, position, kind, text, class FROM f WHERE coalesce(off, 0) = 0 AND starts_with(class, 'article_')""")
def article_blocks(s, d):
    """The article's own blocks, without end matter and navigation."""
    b = _blocks(s, d)
    return O.article_blocks(b, _other(b))


@query(f"""WITH {BLOCKS}, h AS (SELECT b.*, CASE WHEN kind <> 'heading' THEN NULL WHEN NOT regexp_matches({_L}, 'rights and permissions|author information|acknowledgements|subject') THEN 0 WHEN {_L} = 'rights and permissions' THEN 1
 WHEN doc NOT IN (SELECT doc FROM other) THEN 1 WHEN EXISTS (SELECT 1 FROM other o WHERE o.doc = b.doc AND (contains(o.heading, {_L}) OR contains({_L}, o.heading))) THEN 0 ELSE 1 END AS gone FROM block b)
SELECT doc, position, kind, text FROM (SELECT *, {_STATE.format("gone")} AS off FROM h) WHERE coalesce(off, 0) = 0""")
def without_boilerplate(s, d):
    """Blocks outside boilerplate that another rendition of the document doesn't have."""
    b = _blocks(s, d)
    return O.without_boilerplate(b, _other(b))


@query(f"""WITH {BLOCKS}, x AS (SELECT *, CASE WHEN kind = 'paragraph' AND text LIKE 'METHODS We%' THEN 'METHODS' WHEN kind = 'paragraph' AND text LIKE 'RESULTS 12%' THEN 'RESULTS' END AS h FROM block),
p AS (SELECT doc, position, 0 AS part, 'heading' AS kind, h AS text FROM x WHERE h IS NOT NULL UNION ALL SELECT doc, position, 1, kind, CASE WHEN h IS NULL THEN text ELSE trim(substr(text, 8)) END FROM x)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY position, part) - 1 AS position, kind, text FROM p""")
def headings_apart(s, d):
    """Paragraphs that begin with a heading as heading and paragraph."""
    return O.with_headings_apart(_blocks(s, d))


@query(f"""WITH RECURSIVE {BLOCKS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY position DESC) AS n FROM block WHERE (doc + position) % 6 <> 1),
r AS (SELECT doc, n, position, kind, text, true AS kept, kind <> 'heading' AS content FROM k WHERE n = 1 AND kind <> 'heading' UNION ALL SELECT doc, n, position, kind, text, regexp_matches({_L}, 'introduction|methods|results|discussion|references'), false FROM k WHERE n = 1 AND kind = 'heading'
 UNION ALL SELECT k.doc, k.n, k.position, k.kind, k.text, k.kind <> 'heading' OR r.content OR regexp_matches(lower(trim(k.text)), 'introduction|methods|results|discussion|references'),
  CASE WHEN k.kind <> 'heading' THEN true WHEN r.content OR regexp_matches(lower(trim(k.text)), 'introduction|methods|results|discussion|references') THEN false ELSE r.content END FROM r JOIN k ON k.doc = r.doc AND k.n = r.n + 1)
SELECT doc, position, kind, text FROM r WHERE kept""")
def without_orphans(s, d):
    """Blocks without headings that nothing follows; a block in six is left out beforehand, so that there are such headings."""
    return O.without_orphans(_blocks(s, d).where("(doc + position) % 6 <> 1"))


STYLES = ("{} (a) {} (b) {}, (c) {};", "{} 1. {} 2. {} 3. {}", "{} x) {} a) {}; b) {}", "{} (c) {} (d) {} (f) {}", "(1) {} (2) {}; (4) {} (5) {} ", "{} (i) {} (j) {} (B) {}")


def _numbered(parts, k):
    """Four parts with marks between them, in one of STYLES."""
    made = []
    for style in STYLES:
        pieces, out = style.split("{}"), F.lit(style.split("{}")[0])
        for p, after in zip(parts, pieces[1:]):
            out = F.concat(out, p, F.lit(after))
        made.append(out)
    return F.get(F.array(*made), (k % len(STYLES)).cast("int"))


def _numbered_sql(parts: list[str], k: str) -> str:
    made = []
    for style in STYLES:
        pieces = style.split("{}")
        made.append("'" + pieces[0] + "' || " + " || ".join(f"{p} || '{after}'" for p, after in zip(parts, pieces[1:])))
    return "[" + ", ".join(made) + f"][CAST(({k}) % {len(STYLES)} AS INTEGER) + 1]"


def _marks_sql(pattern: str, turn: int) -> str:
    m = f"regexp_extract_all(text, '{pattern}')"
    return f"""SELECT doc, position, {turn} AS turn, j, lower(regexp_extract_all(text, '{pattern}', 1)[j]) AS v,
 list_sum(list_transform(string_split_regex(text, '{pattern}')[1:j], lambda g: length(g))) + coalesce(list_sum(list_transform({m}[1:j-1], lambda g: length(g))), 0) + CASE WHEN left({m}[j], 1) = ' ' THEN 1 ELSE 0 END AS pos
 FROM e, unnest(range(1, len({m}) + 1)) AS u(j)"""


@query(f"""WITH {BLOCKS}, e AS (SELECT doc, position, {_numbered_sql(["left(text, 12)", "substr(text, 13, 9)", "substr(text, 22, 7)", "substr(text, 29)"], "doc + position")} AS text FROM block WHERE kind = 'paragraph'),
m AS ({_marks_sql("(?:^|[ ]|[.,;()-])[(]([a-zA-Z0-9])[)][ ]", 1)} UNION ALL {_marks_sql("(?:^|[ ]|[.,;()-])([a-zA-Z0-9])[)][ ]", 2)} UNION ALL {_marks_sql("(?:^|[ ]|[.,;()-])([1-9])[.][ ]", 3)}),
b AS (SELECT *, CASE WHEN ascii(v) = 1 + lag(ascii(v)) OVER w THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY doc, position, turn ORDER BY j)),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc, position, turn ORDER BY j) AS run FROM b), r AS (SELECT doc, position, turn, run, count(*) AS n, list(pos ORDER BY j) AS pos, arg_min(v, j) AS v FROM g GROUP BY 1, 2, 3, 4),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc, position, turn ORDER BY n DESC, run) = 1), f AS (SELECT * FROM l WHERE n >= 2 AND v IN ('a', 'b', '1', '2', 'i') QUALIFY row_number() OVER (PARTITION BY doc, position ORDER BY turn) = 1),
p AS (SELECT e.doc, e.position, CAST(unnest(range(0, coalesce(n, 0) + 1)) AS INTEGER) AS k, text, pos, n FROM e LEFT JOIN f ON f.doc = e.doc AND f.position = e.position),
q AS (SELECT doc, position, k, CASE WHEN k = 0 THEN 'paragraph' ELSE 'list_item' END AS kind, CASE WHEN n IS NULL THEN text WHEN k = 0 THEN trim(left(text, CAST(pos[1] AS BIGINT))) ELSE trim(substr(text, CAST(pos[k] AS BIGINT) + 1, CAST(coalesce(pos[k + 1], 1000000) - pos[k] AS BIGINT))) END AS x, n FROM p)
SELECT doc, position, CAST(row_number() OVER (PARTITION BY doc, position ORDER BY k) - 1 AS INTEGER) AS part, kind, CASE WHEN k > 0 AND regexp_matches(x, '[;,]$') THEN trim(left(x, -1)) ELSE x END AS text FROM q WHERE n IS NULL OR k > 0 OR x <> ''""")
def enumerations(s, d):
    """Paragraphs that enumerate inline, taken apart; marks are planted in every paragraph, in six styles."""
    x, b = F.col("text"), _blocks(s, d).where("kind = 'paragraph'")
    parts = [F.left(x, F.lit(12)), F.substring(x, 13, 9), F.substring(x, 22, 7), F.substring(x, F.lit(29), F.length(x))]
    return O.enumerations_apart(b.select("doc", "position", "kind", _numbered(parts, F.col("doc") + F.col("position")).alias("text")))


SCANNED = f"""b AS (SELECT d.lang AS scope, l.doc_id AS doc, position, CASE WHEN (l.doc_id + position) % 7 = 0 THEN translate(l.x, 'üéñáíóè', 'uenaioe') WHEN (l.doc_id + position) % 7 = 1 THEN upper(replace(left(l.x, 20), 'ß', 's')) || substr(l.x, 21) ELSE l.x END AS text FROM line l JOIN documents d USING (doc_id)),
s AS (SELECT scope, doc, position, j, w[j] AS token, lower(w[j]) AS form, strip_accents(lower(w[j])) AS skeleton, CASE WHEN j > 1 THEN strip_accents(lower(w[j - 1])) ELSE '^' END AS l, CASE WHEN j < len(w) THEN strip_accents(lower(w[j + 1])) ELSE '$' END AS r
 FROM (SELECT *, regexp_extract_all(text, '\\pL{{2,}}') AS w FROM b), unnest(range(1, len(w) + 1)) AS u(j)),
f AS (SELECT scope, skeleton, form, count(*) AS n, row_number() OVER (PARTITION BY scope, skeleton ORDER BY count(*) DESC, form DESC) AS rn FROM s GROUP BY 1, 2, 3),
p AS (SELECT a.scope, a.skeleton, a.form AS pf, a.n >= 4 AND a.n >= 3 * c.n AS strong FROM f a JOIN f c ON a.scope = c.scope AND a.skeleton = c.skeleton AND a.rn = 1 AND c.rn = 2 WHERE a.n >= 3 AND a.n >= 1.5 * c.n AND regexp_matches(a.form, '[à-ỹăâêôơưđ]')),
c3 AS (SELECT scope, l, r, form, count(*) AS n FROM s GROUP BY ALL), cl AS (SELECT scope, l, form, count(*) AS n FROM s GROUP BY ALL), cr AS (SELECT scope, r, form, count(*) AS n FROM s GROUP BY ALL),
o AS (SELECT s.*, pf, strong, 3 * coalesce(a.n, 0) + coalesce(b1.n, 0) + coalesce(c1.n, 0) AS own, 3 * coalesce(a2.n, 0) + coalesce(b2.n, 0) + coalesce(c2.n, 0) AS other FROM s JOIN p USING (scope, skeleton)
 LEFT JOIN c3 a ON (a.scope, a.l, a.r, a.form) = (s.scope, s.l, s.r, s.form) LEFT JOIN cl b1 ON (b1.scope, b1.l, b1.form) = (s.scope, s.l, s.form) LEFT JOIN cr c1 ON (c1.scope, c1.r, c1.form) = (s.scope, s.r, s.form)
 LEFT JOIN c3 a2 ON (a2.scope, a2.l, a2.r, a2.form) = (s.scope, s.l, s.r, pf) LEFT JOIN cl b2 ON (b2.scope, b2.l, b2.form) = (s.scope, s.l, pf) LEFT JOIN cr c2 ON (c2.scope, c2.r, c2.form) = (s.scope, s.r, pf) WHERE s.form <> pf),
g AS (SELECT doc, position, map(list(j), list(CASE WHEN token = upper(token) THEN upper(pf) WHEN left(token, 1) = upper(left(token, 1)) THEN upper(left(pf, 1)) || substr(pf, 2) ELSE pf END)) AS put FROM o WHERE other > 0 AND (other > own OR strong) GROUP BY 1, 2)"""


@query(f"""WITH {BLOCKS}, {SCANNED} SELECT doc, position, CASE WHEN put IS NULL THEN text ELSE list_reduce(list_transform(range(1, len(string_split_regex(text, '\\pL{{2,}}')) + 1),
 lambda k: string_split_regex(text, '\\pL{{2,}}')[k] || coalesce(put[k], regexp_extract_all(text, '\\pL{{2,}}')[k], '')), lambda x, y: x || y) END AS text, CAST(coalesce(cardinality(put), 0) AS INTEGER) AS n_repaired FROM b LEFT JOIN g USING (doc, position)""")
def repaired_texts(s, d):
    """Lines whose words lost their diacritics, repaired by what all texts of their language tell; every seventh line has lost them."""
    x = t(s, d, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("position", "x")).withColumn("position", F.col("position").cast("long"))
    turn = (F.col("doc") + F.col("position")) % 7
    text = F.when(turn == 0, F.translate("x", "üéñáíóè", "uenaioe")).when(turn == 1, F.concat(F.upper(F.replace(F.left("x", F.lit(20)), F.lit("ß"), F.lit("s"))), F.substring("x", F.lit(21), F.length("x")))).otherwise(F.col("x"))
    return O.repaired(x.withColumn("text", text).drop("x")).drop("scope")


TITLES = ("A randomized cohort", "Lived experience in focus groups", "A meta-analysis of sleep", "A theory of dreams", "Plain title", "A case report", "Editorial", "Literature review of dreams")
ABSTRACTS = ("Regression and odds ratio were used", "In-depth interview and thematic analysis", "PRISMA search strategy", "", "A conceptual framework")
HEADS = ("1. Methods", "Results", "D i s c u s s i o n", "Themes found", "2) A chapter", "Case presentation", "Section 3 A model of sleep", "Background", "R e s u l t s", "4. Another chapter", "Notes", "Forest plot", "Funding")
#: What each of HEADS is, worked out by hand.
ROLES = ("methods", "results", "discussion", "qualitative_findings", "body", "body", "body", "introduction", "results", "body", "body", "body", "metadata")
SAMPLES = ("p < 0.05 was found in ", "Themes of the ", "plain words ", "Heterogeneity was ", "plain words ")


def _sections(s, d):
    k = F.col("doc_id")
    each = t(s, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), (k * 7) % 12)).alias("j"))
    heading = _picked(HEADS, k * 3 + F.col("j") * 5)
    return each.select("doc_id", "j", heading.alias("heading"), G.section_role(heading).alias("role"), F.concat(_picked(SAMPLES, F.floor(k / 2) + F.col("j") * 3), F.left("text", F.lit(30))).alias("sample"))


SECTIONS = f"""s AS (SELECT doc_id, j, {_picked_sql(HEADS, "doc_id * 3 + j * 5")} AS heading, {_picked_sql(ROLES, "doc_id * 3 + j * 5")} AS role, {_picked_sql(SAMPLES, "doc_id // 2 + j * 3")} AS sample FROM documents, unnest(range(0, (doc_id * 7) % 12 + 1)) AS u(j))"""


@query(f"WITH {SECTIONS} SELECT doc_id, j, role FROM s")
def section_roles(s, d):
    """What each section is by its heading."""
    return _sections(s, d).select("doc_id", "j", "role")


@query(f"""WITH {SECTIONS}, x AS (SELECT doc_id, {_picked_sql(TITLES, "doc_id")} AS t, lower({_picked_sql(ABSTRACTS, "doc_id // 3")}) AS a FROM documents),
f AS (SELECT doc_id, bool_or(role = 'methods') AS m, bool_or(role = 'results') AS r, bool_or(role = 'discussion') AS d, bool_or(role = 'qualitative_findings') AS q, bool_or(heading = 'Forest plot') AS forest, bool_or(heading = 'Case presentation') AS cases,
 bool_or(contains(heading, 'model')) AS model, count(*) AS n, count(*) FILTER (WHERE regexp_matches(heading, '^[0-9]+[.)]')) AS chapters, bool_or(sample LIKE 'p <%') AS p, bool_or(sample LIKE 'Themes%') AS themes, bool_or(sample LIKE 'Het%') AS het FROM s GROUP BY doc_id),
c AS (SELECT doc_id, unnest([{{'i': 1, 'g': 'meta_analysis', 't': contains(t, 'meta-'), 'a': false, 's': forest, 'k': het}}, {{'i': 2, 'g': 'systematic_review', 't': false, 'a': contains(a, 'prisma'), 's': false, 'k': false}},
 {{'i': 3, 'g': 'qualitative_empirical', 't': contains(t, 'Lived'), 'a': contains(a, 'interview'), 's': q, 'k': themes}}, {{'i': 4, 'g': 'quantitative_empirical', 't': contains(t, 'cohort'), 'a': contains(a, 'regression'), 's': m AND r, 'k': p}},
 {{'i': 5, 'g': 'theoretical_or_conceptual', 't': contains(t, 'theory'), 'a': contains(a, 'framework'), 's': model, 'k': false}}, {{'i': 6, 'g': 'case_report', 't': contains(t, 'case'), 'a': false, 's': cases, 'k': false}},
 {{'i': 7, 'g': 'narrative_review', 't': contains(t, 'Literature'), 'a': false, 's': NOT m AND NOT r AND d, 'k': false}}, {{'i': 8, 'g': 'non_research', 't': t = 'Editorial', 'a': false, 's': false, 'k': false}},
 {{'i': 9, 'g': 'book_or_monograph', 't': false, 'a': false, 's': n >= 8 AND chapters >= 2 AND NOT m AND NOT r, 'k': false}}]) AS z FROM x JOIN f USING (doc_id)),
l AS (SELECT doc_id, z.i AS i, z.g AS g, list_filter([CASE WHEN z.t THEN 'title' END, CASE WHEN z.a THEN 'abstract' END, CASE WHEN z.s THEN 'section_structure' END, CASE WHEN z.k THEN 'chunk_sample' END], lambda v: v IS NOT NULL) AS ch FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(ch) DESC, i) AS n FROM l),
b AS (SELECT a.doc_id, a.g AS g1, a.ch AS c1, z.g AS g2, z.ch AS c2, qn.ch AS cn, ql.ch AS cl FROM o a JOIN o z ON z.doc_id = a.doc_id AND a.n = 1 AND z.n = 2 JOIN l qn ON qn.doc_id = a.doc_id AND qn.i = 4 JOIN l ql ON ql.doc_id = a.doc_id AND ql.i = 3),
u AS (SELECT *, len(cn) >= 2 AND len(cl) >= 2 AS twice, len(c1) = len(c2) AS tie, len(c1) = len(c2) AND ((g1 IN ('quantitative_empirical', 'systematic_review', 'meta_analysis') AND g2 = 'qualitative_empirical') OR (g1 = 'qualitative_empirical' AND g2 IN ('quantitative_empirical', 'systematic_review', 'meta_analysis'))) AS crossed FROM b)
SELECT doc_id, CASE WHEN twice THEN 'mixed' WHEN len(c1) = 0 THEN 'unknown' WHEN crossed THEN 'mixed' ELSE g1 END AS type, CASE WHEN twice THEN 'high' WHEN len(c1) = 0 THEN 'low' WHEN tie THEN 'medium' WHEN len(c1) >= 2 THEN 'high' ELSE 'medium' END AS confidence,
 array_to_string(list_sort(CASE WHEN twice THEN list_distinct(list_concat(cn, cl)) WHEN len(c1) = 0 THEN [] WHEN crossed THEN list_distinct(list_concat(c1, c2)) ELSE c1 END), ',') AS channels, NOT twice AND len(c1) > 0 AND tie AS conflicting FROM u""")
def document_genres(s, d):
    """The genre of each document by its title, abstract, headings and samples; rows of sections are gathered by document."""
    x = _sections(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("j", "heading", "role", "sample"))).alias("sections"))
    k = F.col("doc_id")
    return x.select("doc_id", F.inline(F.array(G.genre(_picked(TITLES, k), _picked(ABSTRACTS, F.floor(k / 3)), F.col("sections"))))).withColumn("channels", F.array_join(F.array_sort("channels"), ","))


@query("""WITH n AS (SELECT conv_id, turn, regexp_replace(lower(split_part(text, ' ', 1) || CASE WHEN turn % 3 = 0 THEN '' ELSE ' ' || split_part(text, ' ', 2) END), '[^\\pL\\pN%]+', ' ', 'g') AS s0, role AS e FROM conversations WHERE turn < 24 UNION ALL
SELECT conv_id, turn + 100, regexp_replace(lower(split_part(text, ' ', 1)), '[^\\pL\\pN%]+', ' ', 'g'), role FROM conversations WHERE turn % 2 = 0),
k AS (SELECT conv_id, turn, trim(s0) AS s, e, row_number() OVER (PARTITION BY conv_id ORDER BY length(trim(s0)), turn) AS i FROM n),
f AS (SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.conv_id = k.conv_id AND o.e = k.e AND o.i < k.i AND contains(' ' || k.s || ' ', ' ' || o.s || ' ')))
SELECT conv_id, string_agg(turn, ',' ORDER BY i) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS n FROM f) WHERE n <= 8 GROUP BY conv_id""")
def distinct_motifs(s, d):
    """Notes of conversations, named by a message's first words, without those that another with the same evidence holds; the shortest eight."""
    c = t(s, d, "conversations")
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    first = c.where("turn < 24").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, word(1)).otherwise(F.concat(word(1), F.lit(" "), word(2))).alias("symbol"), F.col("role").alias("evidence"))
    notes = first.unionByName(c.where("turn % 2 = 0").select("conv_id", (F.col("turn") + 100).alias("turn"), word(1).alias("symbol"), F.col("role").alias("evidence")))
    x = notes.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "symbol", "evidence"))).alias("notes"))
    return x.select("conv_id", F.array_join(F.transform(G.distinct_motifs(F.col("notes")), lambda n: n["turn"].cast("string")), ",").alias("kept"))
