"""Operators on the ordered blocks of documents: (doc, position, kind, text), positions unique within a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sedge.functions import blocks as B, cleaning as L, text as T
from sedge.session import stored


def _so_far(value: Column) -> Column:
    """The last value that isn't null up to this block of its document."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy("doc").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))


def _low() -> Column:
    return F.lower(F.trim(F.coalesce("text", F.lit(""))))


def with_headings_apart(blocks: DataFrame) -> DataFrame:
    """Paragraphs that begin with a heading in capitals as two blocks; positions are numbered anew from 0."""
    h = F.when(F.col("kind") == "paragraph", B.embedded_heading(F.col("text")))
    rest = F.trim(F.substring(F.trim("text"), F.length("h") + 1, F.length("text")))
    parts = F.when(F.col("h").isNull(), F.array(F.struct("kind", "text"))).otherwise(F.array(F.struct(F.lit("heading").alias("kind"), F.col("h").alias("text")), F.struct(F.lit("paragraph").alias("kind"), rest.alias("text"))))
    each = blocks.withColumn("h", h).select("doc", "position", F.posexplode(parts).alias("part", "b")).select("doc", "position", "part", "b.kind", "b.text")
    place = F.row_number().over(Window.partitionBy("doc").orderBy("position", "part")) - 1
    return each.withColumn("position", place.cast("long")).select("doc", "position", "kind", "text")


def without_endmatter(blocks: DataFrame) -> DataFrame:
    """Blocks outside the sections that end an article, without short paragraphs that begin like end notes. A heading of the article's parts ends such a section."""
    heading, low = F.col("kind") == "heading", _low()
    off = F.coalesce(_so_far(F.when(heading & B.holds(low, B.ENDMATTER), True).when(heading & B.holds(low, B.CORE), False)), F.lit(False))
    note = (F.col("kind") == "paragraph") & low.rlike("^(?:" + "|".join(B.END_NOTES) + ")") & (F.length(F.trim("text")) < 300)
    return blocks.withColumn("_off", off).where(~F.col("_off")).where(~F.coalesce(note, F.lit(False))).drop("_off")


def article_blocks(blocks: DataFrame, other: DataFrame) -> DataFrame:
    """Blocks of the article alone, with their class: no end matter, no groups under a heading of navigation, nothing of another class.

    other (doc, heading): headings of another rendition, in lower case. A group of navigation ends at a heading of the article's parts or of other.
    """
    kept = without_endmatter(blocks)
    index = F.row_number().over(Window.partitionBy("doc").orderBy("position")) - 1
    known = other.select("doc", F.col("heading").alias("_low")).distinct().withColumn("_known", F.lit(True))
    x = kept.withColumn("class", B.block_class(F.col("kind"), F.col("text"), index)).withColumn("_low", _low()).join(known, ["doc", "_low"], "left")
    heading = F.col("kind") == "heading"
    real = B.holds(F.col("_low"), B.SECTIONS) | F.coalesce("_known", F.lit(False))
    off = _so_far(F.when(heading & B.shows(F.col("_low"), B.NAVIGATION), True).when(heading & real, False))
    x = x.withColumn("_off", F.coalesce(off, F.lit(False))).where(~F.col("_off") & F.startswith("class", F.lit("article_")))
    return x.select("doc", "position", "kind", "text", "class")


def without_boilerplate(blocks: DataFrame, other: DataFrame, html: bool = True) -> DataFrame:
    """Blocks without the sections under headings of boilerplate that another rendition doesn't have; some go whatever it has.

    other (doc, heading): headings of the other rendition, in lower case; a document without any has none to be compared with, and loses all such
    sections if its blocks come from HTML. A heading is had where one of the two holds the other.
    """
    headings = other.groupBy("doc").agg(F.collect_set("heading").alias("_had"))  # the headings of one document
    x = blocks.join(headings, "doc", "left").withColumn("_low", _low())
    heading, boiler = F.col("kind") == "heading", B.shows(F.col("_low"), B.BOILERPLATE)
    met = F.exists("_had", lambda h: F.contains(h, F.col("_low")) | F.contains(F.col("_low"), h))
    gone = boiler & (B.holds(F.col("_low"), B.HARD) | F.when(F.col("_had").isNull(), F.lit(html)).otherwise(~met))
    off = F.coalesce(_so_far(F.when(heading, gone)), F.lit(False))
    return x.withColumn("_off", off).where(~F.col("_off")).select("doc", "position", "kind", "text")


def without_orphans(blocks: DataFrame) -> DataFrame:
    """Blocks without headings that no content follows before the next heading that stays, but for protected ones.

    A heading with none before the very next one has none before any that stays, as all between lose their content's lack alike: one look ahead
    settles what passes over the blocks would.
    """
    heading = F.col("kind") == "heading"
    section = F.count(F.when(heading, 1)).over(Window.partitionBy("doc").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    full = F.max(F.col("kind").isin(*B.CONTENT)).over(Window.partitionBy("doc", "_section"))
    x = blocks.withColumn("_section", section).withColumn("_full", full)
    return x.where(~heading | F.col("_full") | B.holds(_low(), B.PROTECTED)).drop("_section", "_full")


def enumerations_apart(blocks: DataFrame) -> DataFrame:
    """Paragraphs that enumerate inline as what comes before and an item for each mark: doc, position, part (from 0), kind, text."""
    parts = F.coalesce(F.when(F.col("kind") == "paragraph", B.enumeration(F.col("text"))), F.array(F.struct("kind", "text")))
    return blocks.select("doc", "position", F.posexplode(parts).alias("part", "b")).select("doc", "position", "part", "b.kind", "b.text")


# Letters that only a form with its marks has; times that a form is seen at least, its lead over the next, times and lead of one that needs little support; weight of both neighbours.
MARKED = "[ăâêôơưđà-ỹ]"
FORM_LEAST, FORM_LEAD, STRONG, STRONG_LEAD, BOTH = 3, 1.5, 4, 3, 3
_TOKEN = r"\p{L}{2,}"


def repaired(blocks: DataFrame) -> DataFrame:
    """blocks (scope, doc, position, text) -> the same with text whose words have the marks that their scope's other texts give them, and n_repaired.

    Of the forms of one skeleton (lower case without diacritics) the dominant one with a mark is preferred. A word of another form takes it, in
    its own case, if the preferred form is seen between the same neighbours' skeletons, and more than the word's own form, or if it dominates strongly.
    Blocks are unique by doc and position; blocks without such words move once, with none to join. Null texts stay.
    """
    tokens = F.transform(F.regexp_extract_all("text", F.lit(_TOKEN), 0), lambda w: F.struct(w.alias("token"), T.fold(w).alias("skeleton")))
    held = blocks.select("scope", "doc", "position", tokens.alias("ts"))
    near = lambda i, other: F.coalesce(F.get("ts", i)["skeleton"], F.lit(other))
    rows = F.transform("ts", lambda w, i: F.struct(i.alias("at"), w["token"].alias("token"), F.lower(w["token"]).alias("form"), w["skeleton"].alias("skeleton"), F.when(i > 0, near(i - 1, "^")).otherwise("^").alias("left"), near(i + 1, "$").alias("right")))
    seen = held.select("scope", "doc", "position", F.inline(rows))

    every = stored(seen.groupBy("scope", "skeleton", "form").agg(F.count("*").alias("n")), "forms")
    marked = F.col("form").rlike(f"(?iu){MARKED}")
    led = stored(every.where(marked & (F.col("n") >= FORM_LEAST)).select("scope", "skeleton").distinct(), "led")  # other skeletons have no preferred form
    forms = every.join(led, ["scope", "skeleton"], "left_semi")
    most = forms.groupBy("scope", "skeleton").agg(F.max(F.struct("n", "form")).alias("top"), F.count("*").alias("forms")).where(f"forms > 1 and top.n >= {FORM_LEAST}")
    lead = forms.join(most, ["scope", "skeleton"]).where("form <> top.form").groupBy("scope", "skeleton", "top").agg(F.max("n").alias("next"))
    lead = lead.where((F.col("top.n") >= F.col("next") * FORM_LEAD) & F.col("top.form").rlike(f"(?iu){MARKED}"))
    strong = (F.col("top.n") >= STRONG) & (F.col("top.n") >= F.greatest(F.lit(1), F.col("next")) * STRONG_LEAD)
    preferred = stored(lead.select("scope", "skeleton", F.col("top.form").alias("preferred"), strong.alias("strong")), "preferred")  # its size is known then: a short list is broadcast

    told = seen.join(preferred, ["scope", "skeleton"])  # words of skeletons with a preferred form alone
    # Words between the same neighbours are judged once, in a table of their own; what is judged meets the words at the end.
    between = stored(told.groupBy("scope", "left", "right", "form", "preferred", "strong").agg(F.count("*").alias("n")), "between")
    counts = {("left", "right"): BOTH, ("left",): 1, ("right",): 1}
    odd = between.where("form <> preferred").drop("n")
    for form, of in (("form", between.where("form <> preferred")), ("preferred", between.where("form = preferred"))):
        total = F.lit(0)
        for sides, weight in counts.items():
            keys, name = ["scope", *sides, form], f"_{form}_{'_'.join(sides)}"
            n = of.groupBy("scope", *sides, "form").agg(F.sum("n").alias(name)).withColumnRenamed("form", form)
            odd = odd.join(n, keys, "left")
            total = total + F.coalesce(name, F.lit(0)) * weight
        odd = odd.withColumn(f"in_{form}", total)
    judged = odd.where((F.col("in_preferred") > 0) & ((F.col("in_preferred") > F.col("in_form")) | F.col("strong")))
    judged = stored(judged.select("scope", "left", "right", "form"), "judged")
    change = told.where("form <> preferred").join(judged, ["scope", "left", "right", "form"])
    put = change.groupBy("doc", "position").agg(F.map_from_entries(F.collect_list(F.struct("at", L.like_case(F.col("token"), F.col("preferred")).alias("put")))).alias("put"))  # words of one block
    gaps, words = F.split("text", _TOKEN, -1), F.regexp_extract_all("text", F.lit(_TOKEN), 0)
    whole = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at(F.col("put"), i), F.get(words, i), F.lit(""))))
    met = blocks.join(put, ["doc", "position"], "left")
    text = F.when(F.col("put").isNull(), F.col("text")).otherwise(F.array_join(whole, ""))
    return met.select("scope", "doc", "position", text.alias("text"), F.coalesce(F.size("put"), F.lit(0)).alias("n_repaired"))
