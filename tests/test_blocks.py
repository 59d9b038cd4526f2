"""Blocks cleaned, taken apart and repaired, genres and motifs, against plain Python walks over each document's blocks."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sedge.functions import blocks as B, genres as G
from sedge.operators import blocks as O

SHAPE = "doc long, position long, kind string, text string"


def many(spark, c, values, shape="i long, t string"):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], shape).orderBy("i").select(c.alias("x")).collect()]


def made(rng, docs=40):
    heads = ["Introduction", "Funding", "Related articles", "Own title", "Rights and permissions", "Author information", "Discussion", "", "Open access"]
    lines = ["This is a long enough paragraph that ends properly, with more than one hundred and fifty characters in it so that nobody takes it for a line of an affiliation.", "Funding was given.", "University of X", "page 4", "short", None]
    return [
        (d, p * 2, *((k := rng.choice(["heading", "heading", "paragraph", "paragraph", "table", "note"])) and (k, rng.choice(heads if k == "heading" else lines))))
        for d in range(docs) for p in range(rng.randint(0, 14))
    ]


def by_doc(rows):
    out = defaultdict(list)
    for d, p, k, t in sorted(rows, key=lambda r: r[:2]):
        out[d].append((p, k, t))
    return out


def low(t):
    return (t or "").strip().lower()


def test_cleaning(spark):
    rows = made(random.Random(71))
    df = spark.createDataFrame(rows, SHAPE)
    other = [(d, h) for d in range(0, 40, 2) for h in random.Random(d).sample(["own title", "author information and more", "permissions"], 2)]
    others, given = spark.createDataFrame(other, "doc long, heading string"), defaultdict(set)
    for d, h in other:
        given[d].add(h)
    orphans, matter, boiler = set(), set(), set()
    for d, blocks in by_doc(rows).items():
        left = list(blocks)
        for _ in range(3):  # passes from the end, as long as headings go
            for i in range(len(left) - 1, -1, -1):
                if left[i] and left[i][1] == "heading":
                    rest = [b for b in left[i + 1 :]]
                    end = next((j for j, b in enumerate(rest) if b and b[1] == "heading"), len(rest))
                    if not any(b and b[1] in B.CONTENT for b in rest[:end]) and not any(w in low(left[i][2]) for w in B.PROTECTED):
                        left[i] = None
            left = [b for b in left if b]
        orphans |= {(d, b[0]) for b in left}
        off = False
        for p, k, t in blocks:
            if k == "heading":
                off = True if any(w in low(t) for w in B.ENDMATTER) else False if any(w in low(t) for w in B.CORE) else off
            if not off and not (k == "paragraph" and any(low(t).startswith(w) for w in B.END_NOTES) and len((t or "").strip()) < 300):
                matter.add((d, p))
        off = False
        for p, k, t in blocks:
            if k == "heading":
                off = bool(re.search("|".join(B.BOILERPLATE), low(t))) and (any(w in low(t) for w in B.HARD) or (not any(h in low(t) or low(t) in h for h in given[d]) if d in given else True))
            if not off:
                boiler.add((d, p))
    places = lambda x: {(r.doc, r.position) for r in x.collect()}
    assert places(O.without_orphans(df)) == orphans and places(O.without_endmatter(df)) == matter and places(O.without_boilerplate(df, others)) == boiler
    kept = O.article_blocks(df, others).collect()
    assert kept and {(r.doc, r.position) for r in kept} <= matter and all(r["class"].startswith("article_") for r in kept)
    for op in (O.without_orphans, O.without_endmatter, O.with_headings_apart, O.enumerations_apart):
        assert op(df.limit(0)).count() == 0
    assert O.article_blocks(df.limit(0), others).count() == 0 and O.without_boilerplate(df, others.limit(0)).count() > 0


def test_classes(spark):
    kind, text = F.get(F.split("t", "::"), F.lit(0)), F.get(F.split("t", "::"), F.lit(1))
    want = {
        "paragraph::": "unknown_noise", "reference::x": "article_reference", "table::": "unknown_noise", "table::a": "article_table", "paragraph::Please sign in now.": "navigation_or_widget", "paragraph::Page 3 of 12": "pdf_page_marker",
        "paragraph::© 2020 Someone": "pdf_header_footer", "paragraph::12:34 - 5": "garbage_noise", "paragraph::access denied!": "challenge_or_block_page", "paragraph::a.b@c.org": "correspondence_email", "paragraph::12 Some Lab": "author_affiliation",
        "paragraph::The hospital gave its consent to the study of all.": "author_affiliation", "heading::Author contributions": "publisher_boilerplate", "title::The title of it.": "article_title", "heading::Anything": "article_heading", "paragraph::It ends.": "garbage_noise",
        "paragraph::Abstract: it is short, and ends.": "article_abstract", "paragraph::It is long enough, and ends.": "article_paragraph",
    }
    assert dict(zip(want, many(spark, B.block_class(kind, text, F.lit(3)), list(want)))) == want
    heads = {"METHODS We took": "METHODS", "RESULTS": None, "METHODS and": None, "CONCLUSIONS 12 of": "CONCLUSIONS", " ABSTRACT © x": "ABSTRACT", "Results 12": None}
    assert many(spark, B.embedded_heading(F.col("t")), list(heads)) == list(heads.values())


def plain_enumeration(text):
    for pattern in (r"(?:^|\s|[.,;\-()])\(([a-zA-Z0-9])\)\s", r"(?:^|\s|[.,;\-()])([a-zA-Z0-9])\)\s", r"(?:^|\s|[.,;\-()])([1-9])\.\s"):
        found = [(ord(m[1].lower()), m.start() + (1 if m[0][0].isspace() else 0)) for m in re.finditer(pattern, text)]
        best, now = [], []
        for f in found:
            if now and now[-1][0] + 1 == f[0]:
                now.append(f)
            else:
                best, now = (now if len(now) > len(best) else best), [f]
        best = now if len(now) > len(best) else best
        if len(best) < 2 or chr(best[0][0]) not in "ab12i":
            continue
        out = [("paragraph", text[: best[0][1]].strip())] if text[: best[0][1]].strip() else []
        for (_, a), b in zip(best, [x for _, x in best[1:]] + [len(text)]):
            item = text[a:b].strip()
            out.append(("list_item", item[:-1].strip() if item[-1:] in (";", ",") and item else item))
        return out
    return None


def test_enumeration(spark):
    rng = random.Random(72)
    atoms = ["(a) ", "(b) ", "(c) ", " a) ", " b) ", " c) ", " 1. ", " 2. ", " 3. ", "word", " ", "; ", ",", "é", "(1) ", "(2) ", "-(b) ", " i) ", " j) ", " x. "]
    texts = ["".join(rng.choices(atoms, k=rng.randint(0, 14))) for _ in range(400)] + [None]
    got = many(spark, B.enumeration(F.col("t")), texts)
    assert [None if g is None else [tuple(x) for x in g] for g in got] == [plain_enumeration(t) if t is not None else None for t in texts]
    assert sum(g is not None for g in got) > 60


def test_repaired(spark):
    rng = random.Random(73)
    fold = lambda w: w.lower().translate(str.maketrans("éüê", "eue"))
    words = ["café", "cafe", "Café", "CAFE", "für", "fur", "FUR", "the", "big", "lân", "fête", "fete", "x", "12"]
    rows = [(d % 2, d, p, " ".join(rng.choices(words, weights=[6, 1, 1, 1, 5, 1, 1, 6, 4, 1, 3, 2, 1, 1], k=rng.randint(0, 8)))) for d in range(30) for p in range(4)] + [(0, 99, 0, None)]
    toks = {(d, p): re.findall(r"[^\W\d_]{2,}", t or "") for _, d, p, t in rows}
    forms, ctx = defaultdict(Counter), Counter()
    for s, d, p, _ in rows:
        w = toks[d, p]
        for i, x in enumerate(w):
            f, l, r = x.lower(), fold(w[i - 1]) if i else "^", fold(w[i + 1]) if i + 1 < len(w) else "$"
            forms[s, fold(x)][f] += 1
            ctx.update([(s, l, f, r), (s, l, f, None), (s, None, f, r)])
    best = {}
    for k, c in forms.items():
        (f, n), *rest = c.most_common()
        if rest and n >= 3 and n >= 1.5 * rest[0][1] and re.search("[à-ỹâêôđ]", f):
            best[k] = (f, n >= 4 and n >= 3 * rest[0][1])
    want = {}
    for s, d, p, t in rows:
        w, i = toks[d, p], iter(range(1000))

        def put(m, s=s, w=w, i=i):
            k, x = next(i), m[0]
            b = best.get((s, fold(x)))
            if not b or b[0] == x.lower():
                return x
            l, r = fold(w[k - 1]) if k else "^", fold(w[k + 1]) if k + 1 < len(w) else "$"
            score = lambda f: 3 * ctx[s, l, f, r] + ctx[s, l, f, None] + ctx[s, None, f, r]
            if score(b[0]) == 0 or (score(b[0]) <= score(x.lower()) and not b[1]):
                return x
            return b[0].upper() if x.isupper() else b[0].capitalize() if x[0].isupper() else b[0]

        want[d, p] = re.sub(r"[^\W\d_]{2,}", put, t) if t is not None else None
    got = {(r.doc, r.position): r.text for r in O.repaired(spark.createDataFrame(rows, "scope long, doc long, position long, text string")).collect()}
    assert got == want and sum(got[d, p] != t for _, d, p, t in rows) > 15


def test_genres_and_motifs(spark):
    roles = {"1.2 Methods": "methods", "R E S U L T S": "results", "Funding sources": "metadata", "3. References": "references", "Themes of it": "qualitative_findings", "Tóm tắt": "abstract", "Whatever": "body", "Section 2 Conflict of interest": "metadata"}
    assert many(spark, G.section_role(F.col("t")), list(roles)) == list(roles.values())
    section = "array<struct<heading:string,role:string,sample:string>>"
    docs = [
        ("A cohort", "regression", [("m", "methods", ""), ("r", "results", "")], ("quantitative_empirical", "high", ["title", "abstract", "section_structure"], False)),
        ("A cohort", "lived experience", [("m", "methods", "themes"), ("r", "results", "p < 0.1")], ("mixed", "high", ["title", "section_structure", "chunk_sample", "abstract"], False)),
        ("Nothing", None, [], ("unknown", "low", [], False)),
        ("A cohort of interviews", "lived experience", [("x", "body", "y")], ("mixed", "medium", ["abstract", "title"], True)),
        ("Editorial", "theory", [("x", "body", "y")], ("theoretical_or_conceptual", "medium", ["abstract"], True)),
        ("T", "", [(f"{i}. Part", "body", "") for i in range(9)], ("book_or_monograph", "medium", ["section_structure"], False)),
    ]
    df = spark.createDataFrame([(i, t, a, s) for i, (t, a, s, _) in enumerate(docs)], f"i long, t string, a string, s {section}").orderBy("i")
    got = [r.g for r in df.select(G.genre(F.col("t"), F.col("a"), F.col("s")).alias("g")).collect()]
    assert [(g.type, g.confidence, sorted(g.channels), g.conflicting) for g in got] == [(w[0], w[1], sorted(w[2]), w[3]) for *_, w in docs]
    notes = [[("Red bird", "e1"), ("bird", "E1!"), ("birds", "e1"), ("bird", "e2"), ("", "e1"), (None, "e1"), ("big bird", "")], [], None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(notes)], "i long, n array<struct<symbol:string,evidence:string>>").orderBy("i")
    got = [r.x and [tuple(n) for n in r.x] for r in df.select(G.distinct_motifs(F.col("n")).alias("x")).collect()]
    assert got == [[("", "e1"), ("bird", "E1!"), ("bird", "e2"), ("birds", "e1"), ("big bird", "")], [], None]
