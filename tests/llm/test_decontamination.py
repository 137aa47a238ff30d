"""Operator 2 against a window-by-window scan."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cohortlens.llm import decontamination as D
from cohortlens.llm import queries
from cohortlens.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(doc, items, window):
    """Hit positions and items of one document."""
    hit, found = set(), set()
    for item, ws in items:
        m = min(window, len(ws))
        if not m:
            continue
        for k in range(len(ws) - m + 1):
            for at in range(len(doc) - m + 1):
                if doc[at:at + m] == ws[k:k + m]:
                    hit |= set(range(at, at + m))
                    found.add(item)
    return hit, found


def expected(docs, items, window):
    windows: dict[tuple, set] = {}
    for item, ws in items:
        m = min(window, len(ws))
        for k in range(len(ws) - m + 1 if m else 0):
            windows.setdefault(tuple(ws[k:k + m]), set()).add(str(item if item is not None else ""))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        ws, hit, found = words(text), set(), set()
        for m in sizes:
            for at in range(len(ws) - m + 1):
                owners = windows.get(tuple(ws[at:at + m]))
                if owners:
                    hit |= set(range(at, at + m))
                    found |= owners
        out.append((doc_id, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


sequences = st.lists(st.sampled_from("abc"), max_size=9)


@settings(max_examples=400, deadline=None)
@given(st.lists(sequences, max_size=5), st.lists(st.sampled_from("abcx"), max_size=25), st.integers(1, 4))
def test_automaton_equals_window_scan(items, doc, window):
    coded = [(str(i), [w.encode() for w in ws]) for i, ws in enumerate(items)]
    spans, found = D.SuffixAutomaton(coded, window).scan([w.encode() for w in doc])
    hit, owners = brute(doc, [(str(i), ws) for i, ws in enumerate(items)], window)
    assert {i for a, b in spans for i in range(a, b)} == hit and found == owners
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def rows(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def test_whole_tables(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, words(r.text)) for r in table(spark, sf, "benchmark").collect()]
    got = rows(queries.op2_decontamination(spark, sf))
    assert got == expected(docs, items, 10)
    assert any(r[5] for r in got)


def test_hard_rows_and_blocks(spark, hard_docs):
    texts = ["the the", "Lorem ipsum dolor sit amet", None, "", "a", "façade ß Σίσυφος", "日本語"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "no id", 2), (1, texts[1], 3)],
                                  "item_id long, text string, doc_id long")
    docs = [(r.doc_id, r.text) for r in hard_docs.collect()]
    items = [(r.item_id, words(r.text)) for r in bench.collect()]
    for block_bytes in (1 << 20, 20):
        assert rows(D.contamination(hard_docs, bench, 3, block_bytes)) == expected(docs, items, 3)
    assert not any(r[5] for r in rows(D.contamination(hard_docs, bench.limit(0))))
    assert rows(D.contamination(hard_docs.limit(0), bench)) == []


def test_removal(spark, sf, hard_docs):
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    clean = D.remove_contamination(docs, bench).cache()
    assert clean.columns == docs.columns
    assert not any(r.contaminated for r in D.contamination(clean, bench).collect())
    hits = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    left = {r.doc_id: r for r in clean.collect()}
    for r in docs.collect():
        h = hits[r.doc_id]
        if not h.contaminated:
            assert left[r.doc_id] == r
        elif h.n_hit > D.MAX_COVERAGE * h.n_words:
            assert r.doc_id not in left
        else:
            assert len(words(left[r.doc_id].text)) <= h.n_words - h.n_hit and left[r.doc_id].n_chars == len(left[r.doc_id].text)
    assert D.remove_contamination(hard_docs, bench.limit(0)).count() == hard_docs.count()


def test_cut_that_joins_a_window(spark):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "x y a b, A B C D c d z w u v t")], "doc_id long, text string")
    assert [words(r.text) for r in D.remove_contamination(docs, bench, 4, 0.9).collect()] == [list("xyzwuvt")]
