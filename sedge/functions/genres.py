"""What a section is by its heading, and of what genre a document is by what its title, abstract, sections and samples show, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sedge.functions import text as T
from sedge.functions.blocks import holds
from sedge.operators.predicates import first_match

# Beginnings of metadata headings, headings of references, whole headings and words of headings by role, in order.
METADATA = ("author note", "credit authorship", "declaration of competing", "conflict of interest", "data availability", "author contributions", "funding", "acknowledgement", "acknowledgments", "ethics statement")
REFERENCES = ("references", "bibliography", "literature cited", "works cited", "tài liệu tham khảo")
WHOLE = {
    "abstract": ("abstract",), "introduction": ("introduction",), "methods": ("methods", "method", "methodology"), "results": ("results", "findings"), "qualitative_findings": ("qualitative_findings", "qualitative findings", "thematic findings"),
    "discussion": ("discussion",), "conclusion": ("conclusion", "conclusions"), "limitations": ("limitations",), "supplementary": ("supplementary", "supplement", "appendix"),
}
WORDS = {
    "abstract": ("abstract", "tóm tắt", "résumé"),
    "introduction": ("introduction", "background", "giới thiệu", "đặt vấn đề"),
    "methods": ("method", "methodology", "study design", "participants", "data collection", "phương pháp", "thiết kế nghiên cứu"),
    "qualitative_findings": ("theme", "thematic", "narrative", "lived experience", "participant experience", "qualitative finding", "chủ đề", "trải nghiệm"),
    "results": ("result", "finding", "outcome", "kết quả", "phát hiện"),
    "discussion": ("discussion", "interpretation", "thảo luận"),
    "conclusion": ("conclusion", "kết luận", "summary"),
    "limitations": ("limitation", "hạn chế"),
    "supplementary": ("supplement", "appendix", "additional material", "supporting information", "phụ lục", "bổ sung"),
}
# What title and abstract of a genre say, what its headings and what its samples show.
SAYS = {
    "meta_analysis": ("meta-analysis", "pooled effect", "forest plot", "heterogeneity", "i²", "i2", "weighted mean", "funnel plot", "publication bias", "meta analysis", "phân tích tổng hợp"),
    "systematic_review": ("systematic review", "prisma", "cochrane", "inclusion criteria", "exclusion criteria", "search strategy", "eligible studies", "study selection", "tổng quan hệ thống"),
    "qualitative_empirical": (
        "thematic analysis", "grounded theory", "phenomenolog", "content analysis", "saturation", "lived experience", "interpretive", "participant experience", "in-depth interview", "focus group", "phỏng vấn", "phân tích nội dung", "chủ đề",
    ),
    "quantitative_empirical": ("prevalence", "cohort", "randomized", "rct", "controlled trial", "controlled study", "statistical", "regression", "correlation", "odds ratio", "confidence interval"),
    "theoretical_or_conceptual": ("theory", "theoretical", "conceptual", "framework", "model", "self-organization", "self organization", "self-organizing", "self organizing", "predictions of the model"),
    "case_report": ("case report", "case presentation", "case discussion", "case series", "a case of", "ca lâm sàng", "báo cáo ca"),
    "narrative_review": ("narrative review", "literature review", "review article", "tổng quan tài liệu"),
    "non_research": ("editorial", "commentary", "opinion", "letter to the editor", "correspondence", "news", "bình luận", "thư gửi biên tập"),
}
HEADED = {
    "meta_analysis": ("forest plot", "heterogeneity", "pooled effect", "meta-analysis"), "systematic_review": ("systematic review", "prisma", "inclusion criteria", "search strategy"),
    "case_report": ("case presentation", "case report", "case discussion"), "non_research": ("editorial", "commentary"),
}
SAMPLED = {
    "meta_analysis": ("forest plot", "heterogeneity", "pooled effect", "meta-analysis", "meta analysis", "phân tích tổng hợp"), "qualitative_empirical": ("lived experience", "themes", "focus group", "interviews"),
    "quantitative_empirical": ("p <", "p=", "regression", "odds ratio", "confidence interval"),
}
GENRES = (*SAYS, "book_or_monograph")
BOOK_SECTIONS, BOOK_CHAPTERS = 8, 2


def normal_heading(x: Column) -> Column:
    """A heading in lower case on one line; those of letters set apart are closed up."""
    flat = F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))
    closed = F.replace(flat, F.lit(" "), F.lit(""))
    apart = closed.isin("abstract", "introduction", "results", "discussion", "references") & (F.length(flat) == 2 * F.length(closed) - 1)
    return F.when(apart, closed).otherwise(flat)


def bare_heading(x: Column) -> Column:
    """A heading without its number."""
    return F.trim(F.regexp_replace(x, r"(?i)^(?:chapter|section|part)?\s*\d+(?:\.\d+)*\.?\s*", ""))


def section_role(heading: Column) -> Column:
    """What a section that has text is by its heading: metadata and references by the heading without its number, else by the whole heading, by words in it, or body."""
    def of(h):
        own, whole = h["own"], h["whole"]
        rules = [("metadata", own.rlike("^(?:" + "|".join(METADATA) + ")")), ("references", own.isin(*REFERENCES))]
        rules += [(role, whole.isin(*of)) for role, of in WHOLE.items()] + [(role, whole.rlike("|".join(of))) for role, of in WORDS.items()]
        return first_match(rules, "body")

    return T.let(F.struct(normal_heading(bare_heading(heading)).alias("own"), normal_heading(heading).alias("whole")), of)


def chapter(heading: Column) -> Column:
    """Whether a heading is that of a numbered chapter."""
    return F.trim(heading).rlike(r"(?i)^(?:chapter|chương)?\s*\d+\s*[.):-]\s+\S")


def genre(title: Column, abstract: Column, sections: Column) -> Column:
    """struct<type, confidence, channels, conflicting> of a document; sections: array of structs (heading, role, sample).

    A genre's channels are where it shows: title, abstract, section_structure, chunk_sample. Most channels win, the earlier of GENRES among equals;
    numbers and interviews that both show twice, or tie for the first place, are mixed.
    """
    heads = F.array_join(F.transform(sections, lambda s: normal_heading(s["heading"])), " ")
    roles, low = F.transform(sections, lambda s: s["role"]), lambda x: F.lower(F.coalesce(x, F.lit("")))
    has = lambda role: F.array_contains(roles, role)
    tested = has("methods") & has("results")
    structure = {k: holds(heads, of) for k, of in HEADED.items()} | {
        "qualitative_empirical": has("qualitative_findings"), "quantitative_empirical": tested,
        "theoretical_or_conceptual": F.exists(sections, lambda s: holds(low(bare_heading(s["heading"])), SAYS["theoretical_or_conceptual"])),
        "narrative_review": ~has("methods") & ~has("results") & has("discussion"),
        "book_or_monograph": (F.size(sections) >= BOOK_SECTIONS) & (F.size(F.filter(sections, lambda s: chapter(s["heading"]))) >= BOOK_CHAPTERS) & ~has("methods") & ~has("results"),
    }
    no = F.lit(False)
    sampled = lambda of: F.exists(sections, lambda s: holds(low(s["sample"]), of))
    channels = []
    for g in GENRES:
        shown = {"title": holds(low(title), SAYS.get(g, ())), "abstract": holds(low(abstract), SAYS.get(g, ())), "section_structure": structure.get(g, no), "chunk_sample": sampled(SAMPLED[g]) if g in SAMPLED else no}
        channels.append(F.struct(F.lit(g).alias("type"), F.array_compact(F.array(*[F.when(F.coalesce(v, no), F.lit(k)) for k, v in shown.items()])).alias("channels")))

    def of(found):
        by = lambda name: F.get(F.filter(found, lambda c: c["type"] == name), F.lit(0))["channels"]
        ranked = F.array_sort(F.transform(found, lambda c, i: F.struct((-F.size(c["channels"])).alias("least"), i.alias("i"), c["type"].alias("type"), c["channels"].alias("channels"))))

        def judged(r):
            best, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
            numbers, tie = ("quantitative_empirical", "systematic_review", "meta_analysis"), best["least"] == second["least"]
            crossed = tie & ((best["type"].isin(*numbers) & (second["type"] == "qualitative_empirical")) | ((best["type"] == "qualitative_empirical") & second["type"].isin(*numbers)))
            both = (F.size(by("quantitative_empirical")) >= 2) & (F.size(by("qualitative_empirical")) >= 2)
            row = lambda t, c, ch, x: F.struct(t.alias("type"), F.lit(c).alias("confidence") if isinstance(c, str) else c.alias("confidence"), ch.alias("channels"), F.lit(x).alias("conflicting"))
            return (
                F.when(both, row(F.lit("mixed"), "high", F.array_union(by("quantitative_empirical"), by("qualitative_empirical")), False))
                .when(best["least"] == 0, row(F.lit("unknown"), "low", F.slice(best["channels"], 1, 0), False))
                .when(crossed, row(F.lit("mixed"), "medium", F.array_union(best["channels"], second["channels"]), True))
                .when(tie, row(best["type"], "medium", best["channels"], True))
                .otherwise(row(best["type"], F.when(best["least"] <= -2, "high").otherwise("medium"), best["channels"], False))
            )

        return T.let(ranked, judged)

    return T.let(F.array(*channels), of)


def distinct_motifs(notes: Column, most: int = 8) -> Column:
    """Notes (array of structs with symbol and evidence) without those whose symbol holds, or lies in, that of a shorter one with the same evidence; the first `most`.

    Symbols are compared as whole words. Of one evidence a note goes exactly if an accepted one, no longer, overlaps it: the notes are taken in order
    of length, ties in their own order.
    """
    key = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}%]+", " "))
    placed = F.transform(notes, lambda n, i: F.struct(F.length(key(n["symbol"])).alias("length"), i.alias("i"), key(n["symbol"]).alias("s"), key(n["evidence"]).alias("e"), n.alias("note")))
    within = lambda a, b: F.contains(F.concat(F.lit(" "), b, F.lit(" ")), F.concat(F.lit(" "), a, F.lit(" ")))

    def step(kept, n):
        met = F.exists(kept, lambda k: (within(n["s"], k["s"]) | within(k["s"], n["s"])) & (n["e"] == k["e"]) & (n["e"] != ""))
        return F.when(met, kept).otherwise(F.array_append(kept, n))

    return T.let(F.array_sort(placed), lambda p: F.slice(F.transform(F.aggregate(p, F.slice(p, 1, 0), step), lambda n: n["note"]), 1, most))
