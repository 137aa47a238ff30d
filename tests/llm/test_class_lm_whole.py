"""Operator 6 beyond the head: all training words are clustered, and words outside the head score by their classes."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cohortlens.llm import class_lm
from cohortlens.llm.common import table


def test_words_outside_the_head_are_clustered(spark):
    rng = random.Random(3)
    texts = [" ".join(f"x{rng.randrange(30)} y{rng.randrange(30)}" for _ in range(40)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = class_lm.class_lm_scores(docs, F.col("doc_id") % 10 == 0, head_size=1, n_classes=2, rounds=8, tail_rounds=8).collect()
    held = [r for r in rows if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.8 * math.log10(2)  # x and y alternate; one class for both gives no gain


def test_scores_are_the_model_s(spark, sf, hard_docs):
    for docs in (table(spark, sf, "documents"), hard_docs):
        held_out = class_lm.by_crc(F.col("doc_id"))
        rows = docs.select("doc_id", "text", held_out.alias("held_out"))
        _, fitted, model = class_lm.fitted_classes(docs, held_out, 50, 4, 3, 2)
        lexicon, counts = fitted.lexicon, class_lm.count_words(rows.filter(~F.col("held_out")))
        head = {w: i for i, w in enumerate(model.words)}
        tail = {bytes(r.word): (r["c"], r["class"]) for r in lexicon.collect()}
        every = {bytes(r.word): r["c"] for r in counts.collect()}
        assert dict(fitted.head) | {w: c for w, (c, _) in tail.items()} == every and not head.keys() & tail.keys()
        matrix = np.zeros((6, 6))
        for r in rows.filter(~F.col("held_out")).collect():  # class bigrams over all training tokens
            words = [class_lm.END, *class_lm.words_of((r.text or "").encode()), class_lm.END]
            of = [model.classes[head[w]] if w in head else tail[w][1] for w in words]
            np.add.at(matrix, (of[:-1], of[1:]), 1)
        assert np.allclose(model.transitions(matrix), model.transition)

        def plain(text):
            before, total = model.classes[head[class_lm.END]], 0.0
            for w in [*class_lm.words_of((text or "").encode()), class_lm.END]:
                if w in head:
                    now, emission = model.classes[head[w]], model.emission[head[w]]
                else:
                    c, now = tail.get(w, (0, 5))
                    emission = math.log10(c + class_lm.ADD) - model.log_total[now]
                total += model.transition[before, now] + emission
                before = now
            return total

        got = class_lm.class_lm_scores(docs, class_lm.by_crc(F.col("doc_id")), 50, 4, 3, 2).collect()
        want = sorted((str(r.doc_id), round(plain(r.text), 5)) for r in rows.collect())
        assert sorted((str(r.doc_id), round(r.score, 5)) for r in got) == want


def test_rounds_of_the_head_come_to_rest(spark, sf):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    counts = class_lm.count_words(docs)
    fitted = class_lm.Fitted(docs, counts, 2000, 16, class_lm.ROUNDS)
    assert len(fitted.gains) < class_lm.ROUNDS and fitted.gains[-1] < class_lm.STILL < min(fitted.gains[:-1])
    assert sorted(set(fitted.classes[:-1].tolist())) == list(range(17))


def test_tail_moves_equal_single_ones(spark):
    """Cells are opened as arrays; words with one cell, several cells and equal cells move as each alone would."""
    rng, n_classes = np.random.default_rng(3), 4
    total = n_classes + 2
    matrix = rng.integers(1, 60, (total, total)).astype(float)
    rows, vectors = [], {}
    for i in range(150):
        word = b"w%d" % (i % 90)
        codes = np.sort(rng.choice(2 * total, rng.integers(1, 7), replace=False)).astype(np.uint8)
        counts = rng.integers(1, 70_000, len(codes)).astype("<u4")
        rows.append((bytearray(word), n_classes + 1, bytearray(codes.tobytes() + counts.tobytes())))
        vectors.setdefault(word, np.zeros(2 * total))[codes] += counts
    row, code, n = class_lm.opened(pa.array([bytes(r[2]) for r in rows], pa.binary()).slice(10))
    assert n.sum() == sum(np.frombuffer(r[2], "<u4", len(r[2]) // 5, len(r[2]) // 5).sum() for r in rows[10:]) and code.max() < 2 * total
    assert row.tolist() == sorted(row.tolist()) and row[-1] == len(rows) - 11
    frame = spark.createDataFrame(rows, class_lm.TAIL_ROWS).repartition(3)
    got = {bytes(r["word"]): (r["c"], r["class"]) for r in class_lm.moved_tail(frame, matrix, n_classes, 90, None).collect()}
    want = {}
    for word, v in vectors.items():
        best = class_lm.best_classes(matrix, np.array([n_classes + 1]), v[None, total:], v[None, :total], n_classes)[0]
        want[word] = (int(v[total:].sum()), int(best) if best <= n_classes else class_lm.hash_of(word) // 2 % n_classes)
    assert got == want


def test_words_are_looked_up_for_a_range_of_files_at_a_time(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 9))) for i in range(40)]
    docs = spark.createDataFrame(rows + [(40, None)], "doc_id long, text string").repartition(4, "doc_id")

    def scores(slices):
        monkeypatch.setattr(class_lm, "SLICES", slices)
        found = class_lm.class_lm_scores(docs, F.col("doc_id") % 10 == 0, head_size=5, n_classes=3, rounds=2)
        return {r["doc_id"]: (r["n_tokens"], r["n_known"], round(r["base_score"], 9), round(r["score"], 9)) for r in found.collect()}

    names = []
    plain = class_lm.written
    monkeypatch.setattr(class_lm, "written", lambda df, name: names.append(name) or plain(df, name))
    sliced = scores(2)
    assert names.count("classes") == 2  # the shuffle files of one lookup are gone before the next one begins
    assert len(sliced) == 41 and sliced == scores(1)
    row, code, n = np.array([0, 0, 2, 2, 2]), np.array([3, 130, 0, 7, 66]), np.array([1, 70000, 5, 2, 1 << 30])
    cells = class_lm.closed(row, code, n, 4)
    assert [a.tolist() for a in class_lm.opened(cells)] == [row.tolist(), code.tolist(), n.tolist()] and cells[1].as_py() == cells[3].as_py() == b""
