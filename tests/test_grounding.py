"""Quotes, entailment, citation marks and claims against plain Python, with values worked out by hand."""

import random
import re

from pyspark.sql import functions as F

from sedge.functions import grounding as G
from sedge.operators import grounding as R


def plain_spans(text, least=10, most=900):
    """Sentences of a text by walking over its characters."""
    out, white = [], " \t\n\x0b\x0c\r"

    def push(start, end):
        while start < end and text[start] in white:
            start += 1
        while end > start and text[end - 1] in white:
            end -= 1
        if end - start < least:
            return
        while end - start > most:
            window = text[start : start + most + 1]
            last = max(window.rfind(c) for c in " \n\t")
            at = start + last if last >= int(most * 0.65) else start + most
            push(start, at)
            start = at
            while start < end and text[start] in white:
                start += 1
        if end - start >= least:
            out.append((start, end, text[start:end]))

    begin = 0
    for i, c in enumerate(text):
        after = text[i + 1 : i + 2]
        token = re.sub("[\"'“”‘’()\\[\\]]", "", re.search(r"[^ \t\n\x0b\x0c\r]*\Z", text[:i])[0])
        short = c == "." and 1 <= len(token) <= 3 and token.isalpha()
        paragraph = c == "\n" and after == "\n"
        if (c in ".!?" and (not after or after in white) and not short) or paragraph:
            push(begin, i + 1)
            begin = i + 2 if paragraph else i + 1
    push(begin, len(text))
    return out


def test_evidence_spans(spark):
    rng = random.Random(51)
    atoms = ["word", " ", " ", " ", "\n", "\n\n", ". ", "? ", "!", " Dr. ", " (Mr. ", "e.g. ", " é", "😀", "x" * 40, " \t", "3.5", ".", "“No.” "]
    texts = ["".join(rng.choices(atoms, k=rng.randint(0, 300))) for _ in range(150)] + [None, "", " \n\n ", "x" * 3000, "ab " * 2000, ("long " * 100 + "y" * 950 + " end") * 3, "A short one. Another sentence here!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for limits in ({}, {"least": 3, "most": 40, "cut": 26}):
        got = {}
        for r in R.evidence_spans(df, **limits).collect():
            assert texts[r.id][r.start_offset : r.end_offset] == r.quote
            got.setdefault(r.id, []).append((r.start_offset, r.end_offset, r.quote))
        for i, t in enumerate(texts):
            assert sorted(got.get(i, [])) == sorted(plain_spans(t or "", limits.get("least", 10), limits.get("most", 900))), repr(t)


def test_entailment(spark):
    claims = [(1, "Sleep helps memory a lot", "sleep", "memory"), (2, "Sleep helps memory", "deep sleep waves", "better memory scores"), (3, "cats chase dogs", "cats", "dogs"), (4, "never quoted here", "x1", "y1"), (5, "sleep helps old people remember dreams", "sleep", "dreams")]
    evidence = [
        (1, 1, 0, 20, "In all, sleep helps memory a lot, they say", "supports"), (2, 1, 0, 10, "deep waves of sleep", "supports"), (2, 1, 200, 210, "and better memory in scores", "supports"), (2, 2, 0, 5, "sleep helps memory", "supports"),
        (3, 1, 0, 9, "nothing of this", "supports"), (3, 1, 20, 30, "cats chase dogs", "contradicts"), (5, 1, 0, 5, "dreams come in sleep", "supports"), (5, 2, 0, 5, "old people sleep", "supports"), (4, 1, 0, 3, "  ", "supports"),
    ]
    got = {r.id: r for r in R.entailment(spark.createDataFrame(claims, "id long, statement string, subject string, outcome string"), spark.createDataFrame(evidence, "id long, chunk long, start long, end long, quote string, stance string")).collect()}
    assert [got[i].level for i in range(1, 6)] == ["direct", "direct", "none", "none", "direct"]
    assert got[1].score == 1.0 and got[2].quote == "deep waves of sleep and better memory in scores" and got[2].score == 1.0 and (got[4].score, got[4].quote) == (0.0, None) and got[3].score == 0.0
    few = spark.createDataFrame([(1, "alpha beta gamma delta eta", "zeta", "theta")], "id long, statement string, subject string, outcome string")
    for quote, level, score in (("alpha beta", "partial", 0.4), ("alpha", "none", 0.2), ("zeta alpha beta gamma", "partial", 0.6)):
        ev = spark.createDataFrame([(1, 1, 0, 9, quote + " other words", "supports")], "id long, chunk long, start long, end long, quote string, stance string")
        r = R.entailment(few, ev).first()
        assert (r.level, round(r.score, 6)) == (level, score)
    assert R.entailment(few, ev.limit(0)).first().level == "none"


def plain_checked(text, citations):
    """citations: (index, concepts, enough) in order."""
    rows = []
    for index, has, enough in sorted(citations):
        at, place, mark = 0, 0, f"[{index}]"
        while (hit := text.find(mark, at)) >= 0:
            before = text[max(0, hit - 700) : hit]
            claim = re.sub(r"\s+", " ", before[max(before.rfind(c) for c in "\n.!?") + 1 :]).strip()
            own = {n for n, p in G.CITED_CONCEPTS.items() if re.search(p, claim, re.I)}
            share = len(own & has) / len(own) if own else 0.0
            place += 1
            rows.append((index, place, claim, round(share, 6), bool(own) and share >= 0.75 and enough))
            if not rows[-1][-1]:
                text = f"{text[:hit]}[?]{text[hit + len(mark):]}"
            at = hit + (len(mark) if rows[-1][-1] else 3)
    return text, rows


def test_checked_answers(spark):
    rng = random.Random(52)
    said = ["memory of sleep", "the future", "work and stress", "a feeling", "danger", "no such thing", "ký ức", ".", "\n", "?", " [1]", " [2]", "[12]", " [1]", " [3]", "x" * 400, " and "]
    answers = [(i, " ".join(rng.choices(said, k=rng.randint(0, 25)))) for i in range(120)]
    excerpts = ["memory and sleep for the future of work and stress in the long run of life", "a feeling of danger, and the rest of it is long enough to prove something", "memory", "trí nhớ và tương lai " * 4]
    citations = [(i, k, rng.choice(excerpts), rng.choice(["", "work", "danger and memory"])) for i in range(120) for k in (12, 1, 2) if rng.random() < 0.8]
    got = R.checked_answers(spark.createDataFrame(answers, "id long, text string"), spark.createDataFrame(citations, "id long, index int, excerpt string, detail string"), "detail").collect()
    assert len(got) == 120
    concepts = lambda x: {n for n, p in G.CITED_CONCEPTS.items() if re.search(p, x, re.I)}
    for r in got:
        own = [(k, concepts(f"{e} {x}"), len(re.sub(r"\s+", " ", e).strip()) >= 60) for i, k, e, x in citations if i == r.id]
        want = plain_checked(answers[r.id][1], own)
        assert (r.text, [(m["index"], m.place, m.claim, round(m.coverage, 6), m.supported) for m in r.marks]) == want


def test_claims(spark):
    many = lambda c, values: [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string").orderBy("i").select(c.alias("x")).collect()]
    kinds = {
        "Sleep may consolidate memory and is associated with later recall.": "searchable",
        "Hình ảnh dòng sông trong giấc mơ phản ánh sự xuất hiện của nước trong đời.": "none",
        "Căng thẳng có thể liên quan đến giấc ngủ kém ở người lớn tuổi.": "searchable",
        "You should sleep more, since sleep is associated with good health.": "none",
        "Your stress is related to sleep and this may suggest a change at home.": "none",
        "The combination of sleep and stress occurs in many adults of all ages": "researchable",
        "When they dream of it, the dream suggests that stress increased in them all.": "researchable",
        "Researchers asked: is sleep related to memory in any way at all?": "none",
        "Sleep is related to it": "none",
        "Biển: thường tượng trưng cho tiềm thức và liên quan đến giấc mơ của họ.": "none",
    }
    assert dict(zip(kinds, many(G.claim_kind(F.col("t")), list(kinds)))) == kinds
    a, b = list(kinds)[0], list(kinds)[2]
    assert many(G.claim_sentences(F.col("t")), [f"{a} Short. {b}\n{a} [2] {a}", "", None])[:2] == [[a, b], []]


def test_grounded_claims_without_rules(spark):
    a = "Sleep may consolidate memory and is associated with later recall."
    answers = spark.createDataFrame([(1, a), (2, None)], "id long, text string")
    rules = spark.createDataFrame([], "id long, text string")
    evidence = spark.createDataFrame([], "rule_id long, source_id long, evidence_id long, quote string")
    assert [(r.id, r.claim, r.status) for r in R.grounded_claims(answers, rules, evidence).collect()] == [(1, a, "unresolved")]


def test_gaps(spark):
    """Reconciling what changed gives what matching everything anew gives; variants and occurrences add up."""
    rng = random.Random(53)
    words = "sleep memory stress planning creative dream future work fear waves slow deep night adults recall river stone".split() + [f"w{i}x" for i in range(70)]
    text = lambda: " ".join(rng.sample(words, rng.randint(2, 5)))
    gaps = spark.createDataFrame([(i % 5, f"k{i}", text(), [f"v{i}"], 1, None, None) for i in range(60)], "user long, key string, claim string, variants array<string>, occurrences long, rule_id long, score double")
    old = [(i, text()) for i in range(40)]
    new = [(i, text() if i % 6 == 0 else t) for i, t in old if i % 7] + [(i, text()) for i in range(40, 50)]
    changed = sorted({i for i, _ in old} ^ {i for i, _ in new} | {i for i, t in new if dict(old).get(i, t) != t})
    rules = lambda rows: spark.createDataFrame(rows, "id long, text string")
    before = R.matched_gaps(gaps, rules(old))
    rows = lambda df: sorted((r.user, r.key, r.rule_id, r.score and round(r.score, 9)) for r in df.collect())
    want = rows(R.matched_gaps(gaps, rules(new)))
    assert rows(R.reconciled_gaps(before, rules(new), rules([(i, "") for i in changed]))) == want
    assert 3 < sum(r[2] is None for r in want) < 57 and rows(before) != want
    claims = spark.createDataFrame([(0, "k0", "other words"), (0, "k0", "other words"), (9, "n", "longer claim"), (9, "n", "claim b"), (9, "", "none")], "user long, key string, claim string")
    got = {(r.user, r.key): r for r in R.captured_gaps(gaps, claims).collect()}
    assert len(got) == 61 and got[0, "k0"].occurrences == 3 and got[0, "k0"].variants == ["other words", "v0"] and got[9, "n"].claim == "claim b" and got[9, "n"].rule_id is None
    assert {(r.user, r.key) for r in R.pruned_gaps(before, claims).collect()} == {(r.user, r.key) for r in before.collect() if r.rule_id is not None} | ({(0, "k0")})
