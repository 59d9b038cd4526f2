"""The stages of the corpus pipeline, each on what the one before kept, and all of them against plain Python."""

import collections
import os
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from sedge.llm import langid, mixing, packing, pii
from sedge.session import stored
from tokenizers import Tokenizer

DATA = "/root/testdata/sf0.001"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, row string, rate double, root long, kept_id long"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], DATA), "stage"))
    start, language, unique, clean, mixed, packed = seen
    assert all(x.columns == docs.columns for x in seen[:5])
    assert language.count() >= 0.98 * docs.count()
    rows = sorted(language.collect(), key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == [rows[g].doc_id for g in sorted(set(plain_groups([r.text for r in rows])))]
    assert clean.count() == unique.count() and not any(s[4] for r in clean.collect() for s in pii.scan(r.text))
    assert mixed.select("doc_id").distinct().count() <= clean.count()
    tokens = packed.groupBy("sequence_id").sum("length").collect()
    assert all(r[1] & (r[1] - 1) == 0 for r in tokens)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_language_rejects(spark):
    """Gibberish and texts in none of the learned languages go, the others stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(0)
    odd = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 9))) for _ in range(60)) for _ in range(20)]
    odd += ["Stary rybak mieszka nad jeziorem w lesie ze swoim psem i opowiada dzieciom bajki", "Tämä on suomenkielinen lause joka kertoo metsästä ja järvestä"]
    more = spark.createDataFrame([(10_000_000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    kept = [r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more), "").select("doc_id").collect()]
    assert len(kept) >= 0.99 * docs.count() and not [i for i in kept if i is not None and i >= 10_000_000]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with nulls, blanks, copies, near copies, personal data, repeated rows, a very long text and columns of any name."""
    rng = np.random.default_rng(21)
    words = {"en": "the and of thing with that river stone", "de": "der und die nicht ein ich fluss stein", "fr": "le la et une dans être pierre eau"}
    rows = []
    for i in range(150):
        lang = list(words)[i % 3]
        rows.append((i, " ".join(rng.choice(words[lang].split(), 60)), lang))
    rows += [(200, rows[0][1], "en"), (201, rows[1][1].upper(), "de"), (202, rows[3][1] + " mail a.b@c.de and 10.0.0.1", "en"), (203, rows[2][1] + " tel +33 1 23 45 67 89", None)]
    rows += [(204, None, "en"), (205, "", "de"), (206, " \n", None), (None, rows[4][1], "de"), (5, rows[5][1], "fr"), (207, "der und die " * 20_000, "de"), (208, "0" * 5000 + "1.2.3.4 the and of thing with that", "en")]
    folder = tmp_path_factory.mktemp("planted")
    docs = [(i, t, lang, "s", len(t) if t is not None else None, "r", 1.0, 7, i) for i, t, lang in rows]
    spark.createDataFrame(docs, SHAPE).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(lang != "fr"), int(i % 10 == 0)) for i, _, lang in rows[:150]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def plain_groups(texts):
    """The least index of each text's group: texts with a Jaccard similarity of 0.8 or more over 5-word shingles, and what they connect, by all pairs."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    sets, up = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words], list(range(len(texts)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= 4 * len(a | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def test_against_brute_force(spark, planted):
    """Each stage's rows from its predecessor's by plain loops; the models that language and mixing learn are the operators' own."""
    docs = spark.read.schema(SHAPE).parquet(f"{planted}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    stage = lambda name, given: stored(dict(corpus_pipeline.STAGES)[name](spark, given, planted), "stage")
    count = lambda found: collections.Counter(tuple(r) for r in found)

    model = langid.fit(docs)
    want = [r for r in rows if (p := model.predict(r.text))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE]
    language = stage("language", docs)
    assert count(language.collect()) == count(want) and {r.doc_id for r in rows} - {r.doc_id for r in want} >= {204, 205, 206}

    given = sorted(count(want), key=lambda r: (r[0] is None, r[0] or 0))
    groups = plain_groups([r[1] for r in given])
    unique = stage("near-duplicates", language)
    assert count(unique.collect()) == count(given[g] for g in set(groups)) and {200, 201, None}.isdisjoint(r.doc_id for r in unique.collect())

    clean = stage("personal data", unique)
    at = columns.index("text")
    want = []
    for r in unique.collect():
        t = pii.redacted(r.text)
        want.append((*r[:at], t, *r[at + 1 : 4], len(t), *r[5:]))
    assert count(clean.collect()) == count(want) and not any("a.b@c.de" in r.text or "1.2.3.4" in r.text or "+33" in r.text for r in clean.collect())

    labels = spark.read.parquet(f"{planted}/labels.parquet")
    rated = mixing.rates(clean, labels, volume=None, most=corpus_pipeline.MOST_COPIES).collect()
    tokens, p = np.array([len((r.row.text or "").split()) for r in rated], float), np.array([[r[f"p_{x}"] for x in mixing.TARGETS] for r in rated])
    share, w = tokens / tokens.sum(), np.array(list(mixing.TARGETS.values()))
    q, rate = np.maximum(p.T @ share, 1e-9), np.ones(len(rated))
    want = max(a / b for a, b in zip(q, w) if b > 0) * w
    for _ in range(20_000):
        rate = np.clip(rate - (p @ ((p.T @ (share * rate) - want) / q) + mixing.RIDGE * (rate - 1)) / (1 + mixing.RIDGE), 0, corpus_pipeline.MOST_COPIES)
    assert np.abs(p.T @ (share * rate) - p.T @ (share * np.array([r.rate for r in rated]))).max() < 0.02
    mixed = stage("mixing", clean)
    assert count(mixed.collect()) == collections.Counter({k: n for r in rated for k, n in [(tuple(r.row), r.copies)] if n})

    tok = Tokenizer.from_file(packing.default_tokenizer())
    ids = {t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in {r.text for r in mixed.collect()}}
    total, pieces = sum(len(ids[r.text]) for r in mixed.collect()), stage("packing", mixed).collect()
    of = collections.defaultdict(set)
    for r in mixed.collect():
        of[r.doc_id].add(r.text)
    assert sum(r.length for r in pieces) == total
    assert all(any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in (ids[t] for t in of[r.doc_id])) for r in pieces)
    full = collections.Counter()
    for r in pieces:
        full[r.sequence_id] += r.length
    assert all(n <= 1024 and n & (n - 1) == 0 for n in full.values())
    assert corpus_pipeline.run(spark, planted).agg({"length": "sum"}).first()[0] == total


def test_stages_on_no_documents(spark, planted):
    none = spark.read.schema(SHAPE).parquet(f"{planted}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, planted).count() == 0, name
