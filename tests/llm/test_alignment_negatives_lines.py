"""Alignment of tokenizers, hard negatives and line dedup against brute force, with nulls, ties, repeats, long texts, no rows and clashing columns."""

import collections
import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.llm import alignment, linededup, negatives
from sedge.llm.packing import _byte_letters, default_tokenizer
from sedge.llm.tokencount import default_model

SHAPE = "doc_id long, text string, row long, a int, b int, h long, g long, at int, lines string, doc string, text_hash long"
LONG = "word and line\n" * 20_000 + "x" * 50_000
TEXTS = [
    (1, "Ünï cödé 日本語 😀 text"), (2, None), (3, ""), (4, " "), (5, "\n"), (6, LONG), (7, "▁x takes a space"), (8, "<|endoftext|> <s> </s> text"), (9, "a  b   c \n\n d\t\te"),
    (10, "12345 678.90 C3PO don't"), (10, "12345 678.90 C3PO don't"), (10, "another text of ten"), (None, "no id here"), (None, "no id\nhere"), (11, "\x00\x01a"), (12, "word " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, "l", "d", 7) for i, t in TEXTS], SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def plain_alignment(rows):
    """The columns of each row by the libraries themselves and a merge of token ends, one token at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, letter = Tokenizer.from_file(default_tokenizer()), sentencepiece.SentencePieceProcessor(model_file=default_model()), _byte_letters()
    a.encode_special_tokens = True
    a_bytes = lambda i: bytes(letter[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    held, counts = [], collections.Counter()
    for _, t in rows:
        x, y = ([(i, a_bytes(i)) for i in a.encode(f" {t}", add_special_tokens=False).ids], [(i, b_bytes(i)) for i in b.encode(t)]) if t else ([], [])
        raw = f" {t}".encode()
        if not t or any(b"".join(p for _, p in side) != raw for side in (x, y)):
            held.append(None)
            continue
        groups, end, sides = [], [0, 0], [iter(x), iter(y)]
        while end[0] < len(raw) or not groups:
            group = ([], [])
            while not group[0] or end[0] != end[1]:
                s = 0 if end[0] <= end[1] else 1
                i, p = next(sides[s])
                group[s].append(i)
                end[s] += len(p)
            groups.append(group)
        held.append((len(x), len(y), groups))
        counts.update({p for g in groups for p in itertools.product(*g)})
    best = [collections.Counter(), collections.Counter()]
    for p, n in counts.items():
        for s in (0, 1):
            best[s][p[s]] = max(best[s][p[s]], n)
    want = collections.Counter()
    for (i, _), h in zip(rows, held):
        if not h:
            want[i, 0, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        links = [p for g in h[2] for p in itertools.product(*g)]
        shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in h[2])
        sums = [sum(counts[p] == best[s][p[s]] for p in links) for s in (0, 1)]
        want[i, h[0], h[1], len(h[2]), len(links), *sums, sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()] += 1
    return want


def test_alignment(spark, docs, none):
    rng = np.random.default_rng(31)
    atoms = ["word ", " ", "\n", "é", "日本", "x" * 40, "  ", "the ", "▁", "and", "123", "  two", "\t", "😀 ", "'s", "0.5%", "<unk>"]
    more = [(100 + i, "".join(rng.choice(atoms, rng.integers(0, 60), p=[0.1] * 3 + [0.05] * 5 + [0.005] + [0.445 / 8] * 8))) for i in range(60)]
    every = docs.select("doc_id", "text", "row", "a").unionByName(spark.createDataFrame([(i, t, 1, 2) for i, t in more], "doc_id long, text string, row long, a int"))
    want = plain_alignment(TEXTS + more)
    assert sum(n for r, n in want.items() if r[1]) > 50 and sum(n for r, n in want.items() if not r[1]) > 3
    for hot in (1, 20, 100_000):
        assert collections.Counter(tuple(r) for r in alignment.alignments(every.repartition(3), hot=hot).collect()) == want
    assert alignment.alignments(none).count() == 0 and alignment.alignments(docs.where("text is null")).count() == 1


def test_alignment_in_parts(monkeypatch):
    """Texts cut at safe places, groups taken by their different ids and links in slices give what the whole gives."""
    rng = np.random.default_rng(32)
    aligner = alignment.Aligner.of(default_tokenizer(), default_model())
    texts = ["".join(rng.choice(["word ", "\n", "é", "日本", "  ", "12", "x" * 30], rng.integers(0, 300))) for _ in range(30)] + ["ab" * 3000]
    want = [x if isinstance(x, dict) else x.tolist() for x in aligner.align(texts)]
    assert max(want[2]) > 1 and max(want[0]["n_links"]) > 300
    for small, chunk in ((1, 50), (3, 1000), (0, 7)):
        monkeypatch.setattr(alignment, "SMALL", small)
        monkeypatch.setattr(alignment, "CHUNK", chunk)
        assert [x if isinstance(x, dict) else x.tolist() for x in aligner.align(texts)] == want


def plain_negatives(rows, low=80, high=100, k=5):
    """(anchor, positive, rank, negative, scores) by all pairs of Python integers; rows: (id, vector, label)."""
    fit = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fit = [(i, list(v), lab) for i, v, lab in {(i, tuple(v), lab) for i, v, lab in fit}]
    want = set()
    for i, a, lab in fit:
        if i % 4:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, v)), j, other) for j, v, other in fit if len(v) == len(a))
        for p, j, _ in [s for s in scores if s[2] == lab and s[1] != i][:k]:
            inside = [s for s in scores if s[2] != lab and low * -p <= 100 * -s[0] <= high * -p][:k]
            want |= {(i, j, n, m, -p, -s) for n, (s, m, _) in enumerate(inside, 1)}
    return want


def test_negatives(spark):
    rng = np.random.default_rng(33)
    rows = [(i, rng.normal(0, 0.2, 6).tolist(), int(rng.integers(3))) for i in range(250)]
    rows += [(300 + i, rows[i % 9][1], int(rng.integers(3))) for i in range(60)]  # copies: ties
    rows += [(400 + i, rng.normal(0, 0.2, 3).tolist(), int(rng.integers(2))) for i in range(40)] + [(500 + i, [0.0] * 6, i % 2) for i in range(20)] + [(600, [], 1), (604, [], 1), (605, [], 2)]
    rows += [(700, None, 1), (704, [0.1] * 6, None), (708, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1), (712, [0.1, math.nan, 0.1, 0.1, 0.1, 0.1], 1), (716, [math.inf] * 6, 1), (None, [0.5] * 6, 1)]
    rows += [(4, rows[4][1], rows[4][2])] * 7 + [(720, [1e6, -2e6, 3.0, 0.5, 0.0, 0.0], 1), (721, [1e6, -2e6, 0.0, 0.0, 0.0, 0.0], 2), (723, [1e6, -2e6, 1.0, 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame([(i, v, lab, 1, 2, 3) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, cell int, anchor int, h int")
    want = plain_negatives(rows)
    assert len(want) > 300
    for cells in ({}, {"anchors_a_cell": 7, "rows_a_cell": 20}):
        got = [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 4 == 0, F.col("label"), **cells).collect()]
        assert len(got) == len(want) and set(got) == want
    got = negatives.hard_negatives(df, F.col("vec_id") % 4 == 0, F.col("label"), 3, 3, 50, 90).collect()
    assert {tuple(r) for r in got} == plain_negatives(rows, 50, 90, 3)
    assert negatives.hard_negatives(df.limit(0), F.lit(True), F.col("label")).count() == 0 and negatives.hard_negatives(df, F.lit(None).cast("boolean"), F.col("label")).count() == 0


def test_bounds_are_rigorous():
    """No exact score leaves its interval, the intervals of fitted centroids are far narrower than those of none, and numbers survive their bytes."""
    rng = np.random.default_rng(34)
    x, y = negatives.whole(rng.normal(0, 0.3, (3000, 17)).tolist()), negatives.whole(rng.normal(0, 0.3, (20, 17)).tolist())
    exact = y @ x.T
    widths = []
    for book in (negatives.fit(x[:1000]), negatives.fit(x[:3]), np.zeros((9, 1, 2))):
        codes = negatives.coded(x, book)
        residual = np.sqrt(((x - negatives.decoded(codes, book, 17)) ** 2).sum(axis=1))
        low, high = negatives.bounds(y, codes, residual, book)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths[0] < widths[2] / 5
    assert (negatives.from_bytes(negatives.as_bytes(x), 17) == x).all()
    big = np.concatenate([x[:3], x[:3] * 2.0**40])
    assert (negatives.from_bytes(negatives.as_bytes(big), 17) == big).all()
    assert negatives.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0]])).tolist() == [2**60 + 3]


def plain_lines(rows, documents, length):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    of = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            of[key(line)].add(i)
    drop = {k for k, ids in of.items() if len(k) >= length and len(ids) >= documents}
    want = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in drop]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return want


def test_lines(spark, docs, none):
    rng = np.random.default_rng(35)
    atoms = ["License", " license\t", "LICENSE\r", "Ünï", "ÜNÏ", "a", "", " ", " ", "\x0b\x0cend", "end", "日本", "once 1", "x" * 300]
    more = [(100 + i, "\n".join([*rng.choice(atoms, rng.integers(0, 9)), f"own {i}"])) for i in range(50)] + [(200, "license\n" * 3000), (None, "License"), (101, "License"), (101, "License")]
    every = docs.select("doc_id", "text", "at", "lines", "h").unionByName(spark.createDataFrame([(i, t, 1, "l", 2) for i, t in more], "doc_id long, text string, at int, lines string, h long"))
    for documents, length, hot in ((10, 1, 10_000), (2, 1, 1), (3, 4, 2), (1, 1, 3)):
        got = linededup.without_repeated_lines(every, documents, length, hot)
        assert got.select("row.*").columns == every.columns
        assert collections.Counter((r.row.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == plain_lines(TEXTS + more, documents, length)
    assert linededup.without_repeated_lines(none).count() == 0
