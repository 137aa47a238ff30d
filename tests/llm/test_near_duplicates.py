"""Operator 7 against all pairs."""

from __future__ import annotations

import random
import re

from cohortlens.llm import near_duplicates as N
from cohortlens.llm import queries
from cohortlens.llm.common import table

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, n):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(ws) <= n:
        return frozenset([tuple(ws)] if ws else [])
    return frozenset(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))


def expected(docs, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in docs]
    root = {i: i for i, _ in docs if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if i is None or j is None or not a or not b or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = rows(queries.op7_near_duplicates(spark, sf))
    assert got == expected(docs, 2)
    assert any(not r[3] for r in got)


def group(rng, n, words=60, swaps=2, vocabulary=4000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, swaps)):
            text[rng.randrange(words)] = f"w{rng.randrange(vocabulary)}"
        yield " ".join(text)


def planted(spark):
    rng = random.Random(5)
    texts = [t for n in (120, 9, 4, 2, 2, 1, 1, 1) for t in group(rng, n)] + ["same text here"] * 40
    chain = [f"c{i}" for i in range(50)]
    for k in range(12):  # each step near the one before, the ends far apart
        texts.append(" ".join(chain))
        chain[4 * k % 50] = f"d{k}"
    rng.shuffle(texts)
    return spark.createDataFrame([(i * 7 % 1000, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_planted_groups(spark):
    docs = planted(spark)
    want = expected([tuple(r) for r in docs.collect()], 2)
    for hub_rounds, block in ((2, 512), (0, 8)):  # with 0 every bucket is compared in blocks
        assert rows(N.near_duplicates(docs, shingle=2, hub_rounds=hub_rounds, block=block)) == want


def test_hard_rows(spark, hard_docs):
    assert rows(N.near_duplicates(hard_docs, shingle=5)) == expected([(r.doc_id, r.text) for r in hard_docs.collect()], 5)
    assert rows(N.near_duplicates(hard_docs.limit(0))) == []
    nothing = hard_docs.filter("text is null or trim(text) = ''")
    assert rows(N.near_duplicates(nothing)) == expected([(r.doc_id, r.text) for r in nothing.collect()], 5)


def test_one_of_each_group(spark, hard_docs):
    docs = planted(spark)
    kept = {r[0] for r in expected([tuple(r) for r in docs.collect()], 5) if r[3]}
    left = N.one_of_each_group(docs)
    assert sorted(r.doc_id for r in left.collect()) == sorted(kept) and left.columns == docs.columns
    hard = N.one_of_each_group(hard_docs)
    assert hard.columns == hard_docs.columns
    assert sorted(str(r.doc_id) for r in hard.collect()) == sorted(
        {str(r.doc_id) for r in hard_docs.collect()} - {str(r[0]) for r in expected([(r.doc_id, r.text) for r in hard_docs.collect()], 5) if not r[3]})


def test_pruning_bounds():
    bounds = N.least_matches(80, 1e-6)
    assert len(bounds) == N.COMPARED // N.BATCH and bounds == sorted(bounds)
    assert 0 < bounds[-1] < 0.8 * N.COMPARED
