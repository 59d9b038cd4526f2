"""Language of texts, in two steps: the family first, then one-versus-one linear SVMs between its languages.

Features are the square roots of the shares of letter trigrams (bytes of lower-cased UTF-8, all else a space), hashed to
BINS. The models learn from a bounded sample: of each language at most SAMPLE documents, and fewer if all languages together would
have more than MOST, the least by a hash of doc_id; a prediction sees the text alone, all of it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BINS, SAMPLE, MOST = 4096, 300, 20_000
#: Families known beforehand; a language of none is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_KEEP = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def family(lang: str) -> str:
    return next((f for f, of in FAMILIES.items() if lang in of), lang)


def features(text: str | None) -> np.ndarray | None:
    """The feature vector of a text, of length 1; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    b = _KEEP[np.frombuffer(f"  {text.lower()}  ".encode(), np.uint8)]
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    code = code[b[1:-1] != 32] >> np.uint32(20)
    if not len(code):
        return None
    return np.sqrt(np.bincount(code, minlength=BINS) / len(code)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, classes weighted alike, by accelerated gradient descent; y is 1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    y = y.astype(np.float32)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * share * y
        grad = np.append(l2 * v[:-1] - 2 * (slack @ x), -2 * slack.sum()).astype(np.float32)
        new = v - grad / (4 + l2)
        v, w = new + (k / (k + 3)) * (new - w), new
    return w


class Model:
    """families: name -> its learned languages; of: (kind, a, b) -> weights, positive for a."""

    def __init__(self, langs: list[str], x: np.ndarray, lang: np.ndarray):
        self.families: dict[str, list[str]] = {}
        for a in sorted(langs):
            self.families.setdefault(family(a), []).append(a)
        self.names = sorted(self.families)
        fam = np.array([family(a) for a in lang]) if len(lang) else np.zeros(0, "U1")
        self.keys, rows = [], []
        if len(self.names) == 2:
            self.keys.append(("family", *self.names))
            rows.append(linear_svm(x, np.where(fam == self.names[0], 1, -1)))
        elif len(self.names) > 2:
            for a in self.names:
                self.keys.append(("family", a, ""))
                rows.append(linear_svm(x, np.where(fam == a, 1, -1)))
        for of in self.families.values():
            for a, b in combinations(of, 2):
                own = (lang == a) | (lang == b)
                self.keys.append(("language", a, b))
                rows.append(linear_svm(x[own], np.where(lang[own] == a, 1, -1)))
        self.weights = np.array(rows, np.float32).reshape(len(rows), BINS + 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): und and 0 without a letter or without learned languages."""
        x = features(text)
        if x is None or not self.names:
            return "und", 0.0
        margin = dict(zip(self.keys, (self.weights[:, :-1] @ x + self.weights[:, -1]).tolist()))
        sure = lambda m: float(1 / (1 + np.exp(-4 * np.clip(m, -20, 20))))
        name, score = self.names[0], 1.0
        if len(self.names) == 2:
            m = margin["family", *self.names]
            name, score = (self.names[0], sure(m)) if m >= 0 else (self.names[1], sure(-m))
        elif self.names[1:]:
            score, name = max((sure(margin["family", a, ""]), a) for a in self.names)
        of = self.families[name]
        if len(of) == 1:
            return of[0], score
        votes = {a: [0, 0.0] for a in of}
        for a, b in combinations(of, 2):
            m = margin["language", a, b]
            won = votes[a if m >= 0 else b]
            won[0] += 1
            won[1] += abs(m)
        best = max(of, key=lambda a: votes[a])
        least = min(margin["language", a, b] * (1 if a == best else -1) for a, b in combinations(of, 2) if best in (a, b))
        return best, score * sure(least)


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = MOST) -> Model:
    """A model from docs (doc_id, text, lang) that are not held out and have a lang: of every language at most `sample` documents.

    With more than most / sample languages each has most / languages, one at least. Of rows that repeat a doc_id the one with the least hash of its text counts first.
    """
    known = docs.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    languages = known.select("lang").distinct().count()
    each = max(1, min(sample, most // max(1, languages)))
    by = [F.xxhash64(F.lit("language"), "id"), "id", "print"]
    places = known.select("lang", "id", F.xxhash64("text").alias("print")).distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*by)))
    chosen = places.where(F.col("place") <= each)  # at most `most` rows, or one a language

    def run(batches):
        for b in batches:
            rows = [(lang, at, x) for lang, at, t in zip(*[b.column(i).to_pylist() for i in (0, 1, 2)]) if (x := features(t)) is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].astype(np.float16).tobytes() for r in rows], pa.binary())],
                names=["lang", "at", "x"],
            )

    met = known.withColumn("print", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "id", "print"]).dropDuplicates(["lang", "place"])
    rows = met.select("lang", F.col("place").cast("long").alias("at"), "text").mapInArrow(run, "lang string, at long, x binary").collect()
    kept = sorted((r.lang, r.at, bytes(r.x)) for r in rows)
    x = np.array([np.frombuffer(b, np.float16) for *_, b in kept], np.float32).reshape(len(kept), BINS)
    lang = np.array([r[0] for r in kept])
    return Model(sorted(set(lang.tolist())), x, lang)


def predicted(spark, model: Model, text: Column) -> Column:
    """A struct of lang_pred and score for each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        made = [shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["lang_pred", "score"]
        )

    return of(text.cast("string"))


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text, lang, ...) -> doc_id, held_out, lang_pred, score.

    One row for each row. Null texts and texts without a letter are und with score 0; so is everything when no language
    can be learned. A null doc_id is not held out and never learned from; doc_ids may repeat; other columns are ignored.
    """
    model = fit(docs, sample)
    p = predicted(docs.sparkSession, model, F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), p.alias("p")
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")
