"""Lines that many documents share, dropped from all of them, with DataFrame functions only.

Lines are exploded with their positions and keyed by two 64-bit hashes of their normalised form. The documents of a key are counted over
distinct (key, document) rows, so a line of every document is spread by its documents before it is one row. Keys found in enough documents
meet the positions that hold them: the HOT most frequent keys by a broadcast of that many rows at most, so that no other key holds more than
1 / HOT of all rows, and those by a shuffle. A document's dropped positions are gathered, fewer than its own lines, and its text is put together
again from the others. No text is shuffled but once, to meet its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sedge.session import stored

#: Documents that must hold a line for it to go; code points of a key at least; keys that are broadcast.
DOCUMENTS, LENGTH, HOT = 10, 1, 10_000
#: What is stripped from a line, and the letters that are lower-cased.
SPACE, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without the white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """texts (doc, text_hash, lines) -> doc, text_hash, at, h, g: the lines whose key has `length` code points at least, their place and the key's hashes."""
    each = texts.select("doc", "text_hash", F.posexplode("lines").alias("at", "line")).withColumn("key", line_key(F.col("line")))
    return each.where(F.length("key") >= length).select("doc", "text_hash", "at", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))


def repeated(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """lines_of -> h, g, documents: the keys that so many different documents hold."""
    n = lines.select("h", "g", "doc").distinct().groupBy("h", "g").agg(F.count("*").alias("documents"))
    return n.where(F.col("documents") >= documents)


def without_repeated_lines(docs: DataFrame, documents: int = DOCUMENTS, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """docs (doc_id, text, ...) -> row (all its columns), n_lines (before dropping), n_dropped, kept (the text of the other lines).

    One row for each row of docs, which may have any other columns. Lines end at \\n; null and empty texts are one empty line. Rows of one
    doc_id are one document, however often they repeat, and so are all rows without a doc_id. Lines that repeat inside a document count once
    and all go. Keys shorter than `length` are never dropped. A text of which nothing stays is ''; no rows give none.
    """
    if documents < 1 or length < 1:
        raise ValueError("documents and length must be at least 1")
    texts = docs.select(F.struct("*").alias("row")).withColumn("doc", F.col("row.doc_id").cast("long"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    held = texts.select("row", "doc", F.xxhash64(text).alias("text_hash"))
    lines = lines_of(held.select("doc", "text_hash", F.split(text, "\n", -1).alias("lines")), length)
    keys = stored(repeated(lines, documents), "repeated-lines")
    common = keys.orderBy(F.desc("documents"), "h", "g").limit(hot).select("h", "g")
    rest = keys.select("h", "g").join(F.broadcast(common), ["h", "g"], "left_anti")
    met = lines.join(F.broadcast(common), ["h", "g"], "left_semi").unionByName(
        lines.join(F.broadcast(common), ["h", "g"], "left_anti").join(rest, ["h", "g"], "left_semi")
    )
    # Rows that repeat have the same places.
    gone = met.groupBy("doc", "text_hash").agg(F.collect_set("at").alias("gone"))
    gone = gone.select(F.col("doc").alias("gone_doc"), F.col("text_hash").alias("gone_hash"), "gone")
    found = held.join(gone, held["doc"].eqNullSafe(gone["gone_doc"]) & (held["text_hash"] == gone["gone_hash"]), "left")
    found = found.select("row", F.split(text, "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    n = F.size("lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), "gone"), lambda i: F.get("lines", i))
    return found.select("row", n.cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))
