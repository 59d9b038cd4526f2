"""Which rules may merge and into what groups, and all relations of rules, against all pairs in plain Python."""

import itertools
import random

from sedge.operators import retrieval as R

STOP = "a an and are as at be by for from in is of on or that the to with".split()
GENERIC = "content dream orient process relate".split()


def stems(text):
    def stem(w):
        single = lambda x: x[:-1] if len(x) > 1 and x[-1] == x[-2] else x
        for end, least, put, one in (("ies", 6, "y", 0), ("ing", 7, "", 1), ("ied", 6, "y", 0), ("ed", 6, "", 1), ("es", 6, "", 0), ("s", 5, "", 0)):
            if w.endswith(end) and len(w) >= least:
                return single(w[: -len(end)]) if one else w[: -len(end)] + put
        return w

    return list(dict.fromkeys(x for w in text.lower().split() if len(x := stem(w)) >= 2 and x not in STOP))


def like(a, b):
    if not a or not b:
        return 0.0
    rest = list(b)
    for x in a:
        same = lambda y: x == y or sum(1 for _ in itertools.takewhile(lambda p: p[0] == p[1], zip(x, y))) >= max(5, 0.75 * min(len(x), len(y)))  # noqa: E731, B023
        hit = next((y for y in rest if same(y)), None)
        if hit is not None:
            rest.remove(hit)
    m = len(b) - len(rest)
    return m / (len(a) + len(b) - m)


def reasons(a, b):
    bare = lambda t: [w for w in stems(t) if w not in GENERIC]
    s, o, t = [like(stems(a[k]), stems(b[k])) for k in (1, 2, 3)]
    bs, bo = [like(bare(a[k]), bare(b[k])) for k in (1, 2)]
    if {a[4], b[4]} == {"positive", "negative"} or a[5] != b[5]:
        return []
    question = a[7] == b[7] and a[7] not in (None, "none")
    found = {
        "same_canonical_paragraph": bool(set(a[6] or []) & set(b[6] or [])), "equivalent_subject_and_outcome": s >= 0.65 and o >= 0.65, "same_meaningful_subject": bs >= 0.72 and (bo >= 0.15 or t >= 0.25),
        "same_meaningful_outcome": bo >= 0.72 and (bs >= 0.15 or t >= 0.25), "same_statement_semantics": t >= 0.55 and bs >= 0.3 and bo >= 0.3, "same_question_and_semantics": question and t >= 0.45,
    }
    return [k for k, v in found.items() if v]


def made(rng, n):
    words = "sleeping sleep dreams dream memory memories related relations fears fearful content process waking insomnia stress stressful rest resting recall unstable inflexible creative".split()
    draw = lambda k: " ".join(rng.choices(words, k=rng.randint(0, k)))
    rows = []
    for i in range(n):
        subject, outcome, statement = draw(3), draw(3), draw(6)
        if rows and rng.random() < 0.5:  # much like an earlier one
            _, subject, outcome, statement, *_ = rng.choice(rows)
            subject, outcome, statement = rng.choice([(subject, outcome, draw(5)), (subject + " rests", outcome, statement), (draw(2) + " " + subject, draw(1) + " " + outcome, statement + " waking")])
        rows.append((i, subject, outcome, statement, rng.choice(["positive", "negative", "neutral"]), rng.random() < 0.1, rng.choice([None, [], [str(rng.randint(0, 30))]]), rng.choice([None, "none", "when", "who"]), rng.randint(0, 3)))
    return rows


def test_mergeable(spark):
    rules = made(random.Random(61), 70)
    df = spark.createDataFrame(rules, "id long, subject string, outcome string, statement string, polarity string, null_finding boolean, chunks array<string>, question string, source long")
    want = {(a[0], b[0]): r for a, b in itertools.combinations(rules, 2) if (r := reasons(a, b))}
    assert len({x for r in want.values() for x in r}) == 6
    assert {(r.a, r.b): r.reasons for r in R.mergeable_rules(df).collect()} == want
    assert R.mergeable_rules(df.limit(0)).count() == 0


def test_merge_groups(spark):
    rng = random.Random(62)
    for n, p, most in ((25, 0.15, 12), (14, 0.6, 3)):
        edges = [(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < p]
        near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
        gone, want = set(), {}
        for seed in range(n):
            if seed in gone:
                continue
            group = [seed]
            for c in sorted(near[seed] - gone):
                if all(c in near[x] for x in group):
                    group.append(c)
            if 2 <= len(group) <= most:
                gone |= set(group)
                want |= {x: seed for x in group}
        ids, df = spark.range(n), spark.createDataFrame([(b, a) for a, b in edges] + edges[:3], "a long, b long")
        for in_task in (200_000, 0):
            assert {r.id: r.group_id for r in R.merge_groups(ids, df, most, in_task).collect()} == want
