"""What a block of a document is, from its kind and its text, as Columns; a block's parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sedge.functions import text as T
from sedge.operators.predicates import first_match

# Headings of boilerplate, signs of navigation, of pages and of pages' margins, characters that are no text, institutions.
BOILERPLATE = (
    r"rights\s+and\s+permissions", r"about\s+this\s+article", r"cite\s+this\s+article", r"download\s+references", r"author\s+information", r"authors\s+and\s+affiliations", r"ethics\s+declarations",
    r"competing\s+interests", r"additional\s+information", r"corresponding\s+authors", r"author\s+contributions", r"contributions", r"acknowledgements", r"acknowledgments", r"similar\s+content", r"subject",
)
HARD = ("rights and permissions", "about this article", "cite this article", "download references", "similar content", "sign in", "log in", "subscribe")
NAVIGATION = (
    r"trang\s+sau", r"trang\s+trước", r"save\s+article", "advertisement", "cookie", r"verify\s+you\s+are\s+human", r"ddos\s+protection", "cloudflare", r"sign\s+in", r"log\s+in", "subscribe", "metrics", "altmetric",
    r"view\s+article\s+impact", r"download\s+pdf", r"browser\s+version", r"limited\s+support", r"similar\s+content", r"related\s+articles", r"recommended\s+articles", r"you\s+may\s+also\s+like",
    r"article\s+recommendations", r"other\s+articles", r"latest\s+articles", r"trending\s+articles", r"featured\s+articles", r"open\s+access", r"publication\s+history", "history",
)
PAGE_MARKER = r"^(?:page\s+\d+|page\s+\d+\s+of\s+\d+|\d+\s*)$"
MARGIN = (r"^article$", r"^open$", r"^opinion$", r"www\.nature\.com/tp", r"translational\s+psychiatry", r"journal\s+pre-proof", r"published\s+online", r"accepted\s+manuscript", r"©\s+the\s+author", r"©\s+\d{4}", r"all\s+rights\s+reserved", r"springer\s+nature", r"https://doi\.org/10\.")
GARBAGE = r"^(?:[0-9():;,.\s\-/#+*\\_]+|[a-z]\s*)$"
CHALLENGE = ("client challenge", "access denied")
INSTITUTIONS = ("university", "department", "institute", "hospital", "school of", "academy", "clinic", "center for", "laboratory", "laboratories", "universiteit", "universidad", "faculdade", "faculty")
# Headings that end an article, those of its parts, those that stay without content, those found at a paragraph's start, and what begins an end note.
ENDMATTER = (
    "acknowledgements", "acknowledgments", "funding", "author contributions", "contributions", "correspondence", "ethics declarations", "competing interests", "conflict of interest", "supplementary information",
    "additional information", "rights and permissions", "open access license", "publisher’s note", "equal contribution notes", "author information", "affiliations", "share this article", "search", "quick links",
    "download references", "download citation", "related articles", "similar content",
)
CORE = ("introduction", "methods", "results", "discussion", "abstract", "data availability", "code availability", "references", "tài liệu tham khảo")
SECTIONS = ("introduction", "methods", "results", "discussion", "references", "data availability", "materials and methods", "abstract")
PROTECTED = ("references", "tài liệu tham khảo", "introduction", "methods", "results", "discussion", "conclusion", "abstract", "data availability", "materials and methods")
EMBEDDED = (
    "INTRODUCTION", "METHODS", "MATERIALS AND METHODS", "RESULTS", "DISCUSSION", "CONCLUSION", "CONCLUSIONS", "REFERENCES", "GIỚI THIỆU", "PHƯƠNG PHÁP", "KẾT QUẢ", "THẢO LUẬN", "KẾT LUẬN", "TÀI LIỆU THAM KHẢO",
    "ABSTRACT", "TÓM TẮT",
)
END_NOTES = ("acknowledgements", "acknowledgments", "funding", "author contributions", "competing interests", "conflict of interest", "correspondence to", "equal contribution", "supplementary information", "additional information")
CONTENT = ("paragraph", "table", "figure", "list_item", "reference")


def holds(x: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(x, F.lit(w))
    return out


def shows(x: Column, patterns: tuple[str, ...]) -> Column:
    return x.rlike("(?i)" + "|".join(patterns))


def block_class(kind: Column, text: Column, index: Column) -> Column:
    """The class of a block from its kind, its text and its place among the blocks, from 0; those of an article begin with article_."""
    x = F.trim(F.coalesce(text, F.lit("")))
    low, n = F.lower(x), F.length(x)
    mail = (F.contains(x, F.lit("@")) | F.contains(low, F.lit("orcid"))) & (n < 250)
    mail = mail & (low.rlike("email|correspondence|contact|✉|orcid") | x.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"))
    pointer = x.rlike(r"^\d+[,\d*✉]*\s*") | low.rlike(r"^[a-z]\d+")
    affiliation = (kind != "heading") & (n < 400) & (holds(low, INSTITUTIONS) | (~x.rlike(r"[.!?]$") & (pointer | (n < 150))))
    return first_match(
        [
            ("unknown_noise", n == 0), ("article_reference", kind.isin("reference", "reference_item")), ("article_figure", kind == "figure"), ("article_table", kind == "table"), ("article_caption", kind == "caption"),
            ("navigation_or_widget", shows(low, NAVIGATION)), ("pdf_page_marker", low.rlike(PAGE_MARKER) & (n < 30)), ("pdf_header_footer", (shows(low, MARGIN) | low.rlike(PAGE_MARKER)) & (n < 250)),
            ("garbage_noise", low.rlike(GARBAGE)), ("challenge_or_block_page", holds(low, CHALLENGE)), ("correspondence_email", mail), ("author_affiliation", affiliation),
            ("publisher_boilerplate", (kind == "heading") & shows(low, BOILERPLATE)), ("article_title", kind == "title"), ("article_abstract", (kind == "abstract") | ((index < 12) & F.startswith(low, F.lit("abstract")))),
            ("article_heading", kind == "heading"), ("garbage_noise", (kind == "paragraph") & (n < 15)),
        ],
        "article_paragraph",
    )


def embedded_heading(text: Column) -> Column:
    """The heading that a paragraph begins with, in capitals before a capital, a digit or ©; else null."""
    x = F.trim(text)
    found = F.array_compact(F.array(*[F.when(x.rlike(rf"^{h}\s+[A-Z\d©]"), F.lit(h)) for h in EMBEDDED]))
    return F.get(found, F.lit(0))


# Marks of enumerations, tried in this order, and those that the first of a run may have.
MARKS = (r"(?:^|\s|[.,;\-()])\(([a-zA-Z0-9])\)\s", r"(?:^|\s|[.,;\-()])([a-zA-Z0-9])\)\s", r"(?:^|\s|[.,;\-()])([1-9])\.\s")
FIRST_MARKS = ("a", "b", "1", "2", "i", "ii")


def _longest_run(marks: Column) -> Column:
    """The longest stretch of marks (structs of code, start) that follow each other, the first of equally long ones."""
    empty = F.slice(marks, 1, 0)
    longer = lambda s: F.when(F.size(s["now"]) > F.size(s["best"]), s["now"]).otherwise(s["best"])

    def step(s, m):
        goes_on = (F.size(s["now"]) > 0) & (F.element_at(s["now"], -1)["code"] + 1 == m["code"])
        return F.struct(F.when(goes_on, F.array_append(s["now"], m)).otherwise(F.array(m)).alias("now"), F.when(goes_on, s["best"]).otherwise(longer(s)).alias("best"))

    return F.aggregate(marks, F.struct(empty.alias("now"), empty.alias("best")), step, longer)


def _run_of(text: Column, pattern: str) -> Column:
    """Where the marks of the longest run start, if it has two or more and a first mark; else null."""
    values = F.regexp_extract_all(text, F.lit(pattern), 1)

    def placed(at):
        white = lambda r: F.substring(text, (r["start"] + 1).cast("int"), F.lit(1)).rlike(r"^\s").cast("int")
        return F.transform(F.arrays_zip(values.alias("v"), at.alias("r")), lambda m: F.struct(F.ascii(F.lower(m["v"])).alias("code"), (m["r"]["start"] + white(m["r"])).cast("int").alias("start")))

    run = _longest_run(T.let(T.ranges(text, pattern), placed))
    fits = lambda r: (F.size(r) >= 2) & F.char(F.get(r, F.lit(0))["code"]).isin(*FIRST_MARKS)
    return F.when(F.size(values) >= 2, T.let(run, lambda r: F.when(fits(r), F.transform(r, lambda m: m["start"]))))


def enumeration(text: Column) -> Column:
    """The parts of a text that enumerates inline, as array of structs (kind, text): what comes before, then an item for each mark; null without marks that follow each other."""
    starts = F.coalesce(*[_run_of(text, p) for p in MARKS])

    def parts(at):
        ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.length(text)))
        items = F.transform(F.arrays_zip(at.alias("s"), ends.alias("e")), lambda p: F.trim(F.substring(text, p["s"] + 1, p["e"] - p["s"])))
        items = F.transform(items, lambda t: F.struct(F.lit("list_item").alias("kind"), F.when(t.rlike("[;,]$"), F.trim(F.left(t, F.length(t) - 1))).otherwise(t).alias("text")))
        before = F.array(F.struct(F.lit("paragraph").alias("kind"), F.trim(F.left(text, F.get(at, F.lit(0)))).alias("text")))
        return F.concat(F.filter(before, lambda b: F.length(b["text"]) > 0), items)

    return T.let(starts, lambda at: F.when(at.isNotNull(), parts(at)))
