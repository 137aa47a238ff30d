"""Language-model scores by a Brown class-based bigram model.

``log10 P(text) = sum over tokens of log10 P(class | previous class) + log10 P(word | class)``.

* Counts of all training words are aggregated by Spark (tasks pre-aggregate).
* Exchange clustering starts with the ``HEAD`` most frequent words.  Their neighbours' counts are one table of bounded
  size; in each half round every word of one half moves to the class that raises the likelihood of class bigrams most,
  given the other words' classes, until a round raises the likelihood by less than ``STILL``.
* Every other training word is then exchanged in turn: tasks gather the classes beside all its tokens, and it moves to
  its best class among those of the head words; ``TAIL_ROUNDS`` further half rounds may see the other words' classes too.
* Class bigrams are counted over all training tokens with the classes of all words.  Words outside the head get
  their classes by a join on the word; they travel in the documents' class sequences.  A word that training does not
  have gets its base probability after any class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from itertools import chain as chained, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, most_frequent, ship_package, utf8, written

HEAD = 1 << 14
CLASSES = 64
ROUNDS = 12  # at most, of two half rounds each, over the head words
STILL = 0.002  # nats a token that a round must gain for another to follow
TAIL_ROUNDS = 0  # half rounds over the words outside the head, after their first move
PARTS = 16  # partitions of the table of the head's neighbours, which is bounded by HEAD
ADD = 0.1
PRIOR = 50.0  # weight of the classes' unigram distribution in a transition
END = b"\n"  # no word can hold a line break
PENDING = 500_000
GATHERED = 100_000  # words whose neighbours a task holds before it sends them on
MAX_HEAD_WORD = 100  # bytes; with HEAD this bounds the broadcast
SHARE = 8192  # words that a task moves at once
FEW = 3  # different neighbours of a word whose choice is remembered
AT_ONCE = 1024  # texts whose words a task holds as Python objects
STEP = 4096  # neighbours of the words that are compared with all classes at once
SLICES = 2  # shares of the documents whose words are looked up one after the other; the shuffle files of one lie on disk at a time


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text in lower case (A-Z only)."""
    return text.lower().split()


def few_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``AT_ONCE`` rows."""
    for batch in batches:
        for low in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(low, AT_ONCE)


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), c of all tokens of ``docs``, the end of each text included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()),
                                              "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in few_texts(batches):
            for text in utf8(batch.column(0)):
                seen.update(words_of(text))
                if len(seen) > PENDING:
                    yield flush()
            seen[END] += batch.num_rows
        if seen:
            yield flush()

    ship_package(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


class _Ids(dict):
    """word -> id; a word outside the head has the id after the last."""

    def __init__(self, words: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.rare = len(words)

    def __missing__(self, word):
        return self.rare


class _Places(dict):
    """word -> place; new words get the next place."""

    def __missing__(self, word):
        self[word] = place = len(self)
        return place


def count_head_pairs(docs: DataFrame, sent, end: int) -> DataFrame:
    """before, after, n over ids of all training tokens: places in the head, or ``len(head)`` for the other words; an
    end stands before a text's first token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, waiting, n = _Ids(sent.value), [], 0

        def flush():
            codes, counts = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_pydict({"before": pa.array((codes >> 32).astype(np.int32)), "after": pa.array((codes & 0xFFFFFFFF).astype(np.int32)),
                                               "n": pa.array(counts.astype(np.int64))})

        for batch in few_texts(batches):
            for text in utf8(batch.column(0)):
                row = _row(words_of(text), ids, end)
                waiting.append(row[:-1] << 32 | row[1:])
                n += len(row)
                if n > 2 * PENDING:
                    yield flush()
                    waiting, n = [], 0
        if waiting:
            yield flush()

    return (docs.select("text").mapInArrow(run, "before int, after int, n long")
            .groupBy("before", "after").agg(F.sum("n").alias("n")))


def _row(words: list[bytes], ids: dict, end: int) -> np.ndarray:
    row = np.full(len(words) + 2, end, np.int64)
    row[1:-1] = np.fromiter(map(ids.get, words, repeat(ids.rare)), np.int64, len(words))
    return row


def neighbours(pairs: DataFrame) -> DataFrame:
    """word, others, counts (bytes) per head word and side 0 (before it) or 1 (after it): at most ``HEAD`` + 1 numbers a
    row and 2 * (``HEAD`` + 1) rows, however large the corpus is."""
    sides = (pairs.select(F.col("after").alias("word"), F.lit(0).alias("side"), F.col("before").alias("other"), "n")
             .union(pairs.select(F.col("before").alias("word"), F.lit(1).alias("side"), F.col("after").alias("other"), "n")))
    grouped = sides.groupBy("word", "side").agg(F.collect_list(F.struct("other", "n")).alias("beside"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            others, counts = [], []
            for cell in batch.column(2):
                others.append(cell.values.field("other").to_numpy().astype("<i4").tobytes())
                counts.append(cell.values.field("n").to_numpy().astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(others, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["word", "side", "others", "counts"])

    packed = grouped.mapInArrow(pack, "word int, side int, others binary, counts binary")
    return written(packed.repartition(PARTS, "word"), "neighbours")


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(matrix: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, movable: int) -> np.ndarray:
    """For each word, the class among the first ``movable`` that gives the class bigrams the highest likelihood, the
    other words staying where they are.  ``own``: the words' classes; ``after[w, c]`` and ``before[w, c]``: tokens of
    class c after and before them.  Only the classes beside a word change a term, so the work follows their number."""
    words = np.arange(len(own))

    def side(m: np.ndarray, here: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Change of sum(m log m) over the rows' cells in the columns beside each word, for each row it may join."""
        w, c = np.nonzero(here)
        cells, n = m[:, c], here[w, c]
        cells[own[w], np.arange(len(w))] -= n  # the matrix without the word
        crossing = c == own[w]
        cells[:, crossing] -= there[w[crossing]].T
        cells = np.maximum(cells, 0)
        change = _xlogx(cells + n) - _xlogx(cells)
        out = np.zeros((len(own), len(m)))
        if len(w):
            first = np.flatnonzero(np.diff(w, prepend=-1))
            out[w[first]] = np.add.reduceat(change, first, axis=1).T
        return out

    def total(sums: np.ndarray, here: np.ndarray) -> np.ndarray:
        n = here.sum(axis=1)
        rest = np.tile(sums, (len(own), 1))
        rest[words, own] -= n
        return _xlogx(rest + n[:, None]) - _xlogx(np.maximum(rest, 0))

    diagonal = np.tile(np.diag(matrix), (len(own), 1))
    diagonal[words, own] -= after[words, own] + before[words, own]
    diagonal = np.maximum(diagonal, 0)
    crossing = _xlogx(diagonal + after + before) - _xlogx(diagonal + after) - _xlogx(diagonal + before) + _xlogx(diagonal)
    gain = (side(matrix, after, before) + side(matrix.T, before, after) + crossing
            - total(matrix.sum(axis=1), after) - total(matrix.sum(axis=0), before))
    best = gain[:, :movable].argmax(axis=1)
    return np.where(gain[words, best] > gain[words, own] + 1e-9, best, own)


class Exchange:
    """Rounds of exchange over the head words; the driver holds their classes and the matrix, both of fixed size."""

    def __init__(self, beside: DataFrame, n_head: int, end: int, n_classes: int):
        self.beside, self.end, self.n_classes, self.total = beside, end, n_classes, n_classes + 2
        self.classes = np.append(np.arange(n_head) % n_classes, n_classes + 1)  # head ids are by falling frequency
        self.classes[end] = n_classes
        self.matrix = self.count()

    def vectors(self, batch: pa.RecordBatch, classes: np.ndarray):
        """Ids of the batch's words and their tokens of each class before (0) and after (1) them."""
        word, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
        out = np.zeros((2, len(word), self.total))
        for place, side, others, counts in zip(at.tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            out[side, place] += np.bincount(classes[np.frombuffer(others, "<i4")], np.frombuffer(counts, "<i8"), self.total)
        return word, out

    def count(self) -> np.ndarray:
        """Tokens of each pair of classes; every task sends one matrix."""
        classes, total, vectors = self.classes, self.total, self.vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrix = np.zeros((total, total))
            for batch in batches:
                word, beside = vectors(batch, classes)
                np.add.at(matrix, classes[word], beside[1])
            yield pa.RecordBatch.from_pydict({"matrix": pa.array([matrix.tobytes()], pa.binary())})

        plan = self.beside.mapInArrow(run, "matrix binary")
        return sum((np.frombuffer(r["matrix"]).reshape(total, total) for r in plan.collect()), np.zeros((total, total)))

    def half_round(self, half: int) -> None:
        """Move the words of one half to their best classes."""
        classes, total, movable, end, matrix, vectors = self.classes, self.total, self.n_classes, self.end, self.matrix, self.vectors

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [[np.zeros(0, np.int64), np.zeros((2, 0, total))]]
            for batch in batches:
                parts.append(vectors(batch, classes))
            # both sides of a word lie in one partition, but not always in one batch
            word, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            beside = np.zeros((2, len(word), total))
            for side in (0, 1):
                np.add.at(beside[side], at, np.concatenate([p[1][side] for p in parts]))
            mine = np.flatnonzero((word != end) & (word < len(classes) - 1) & ((word * 0x9E3779B1 >> 7) % 2 == half))
            for k in range(0, len(mine), 256):
                some = mine[k:k + 256]
                own = classes[word[some]]
                best = best_classes(matrix, own, beside[1][some], beside[0][some], movable)
                moved = best != own
                yield pa.RecordBatch.from_pydict({"id": pa.array(word[some][moved], pa.int64()), "best": pa.array(best[moved], pa.int32())})

        moves = self.beside.mapInArrow(run, "id long, best int").collect()  # at most the head's words
        self.classes = self.classes.copy()
        for r in moves:
            self.classes[r["id"]] = r["best"]
        self.matrix = self.count()

    def likelihood(self) -> float:
        """Of the class bigrams, in nats a token."""
        m = self.matrix
        return float((_xlogx(m).sum() - _xlogx(m.sum(axis=0)).sum() - _xlogx(m.sum(axis=1)).sum()) / max(1.0, m.sum()))

    def run(self, rounds: int) -> None:
        """Until a round raises the likelihood by less than ``STILL``, or ``rounds`` are over; a round that lowers it is
        taken back (words that move at the same time can get in each other's way)."""
        self.gains = []
        for _ in range(rounds):
            before = self.classes, self.matrix, self.likelihood()
            for half in (0, 1):
                self.half_round(half)
            self.gains.append(self.likelihood() - before[2])
            if self.gains[-1] < 0:
                self.classes, self.matrix = before[:2]
            if self.gains[-1] < STILL:
                break

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "beside"}


def gathered(ids_of, classes_of, total: int):
    """A function from batches to rows (word, own, beside): for each word outside the head its class before the move
    and, for each side and class, its tokens; one short row per word and task, whatever the word's frequency."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, waiting, n, own = _Places(), [], 0, []

        def flush():
            codes, counts = np.unique(np.concatenate(waiting), return_counts=True)
            place, code = np.divmod(codes, 2 * total)
            now = np.zeros(len(places), np.int32)
            for at, classes in own:
                now[at] = classes
            return pa.RecordBatch.from_pydict({"word": pa.array(list(places), pa.binary()), "own": pa.array(now), "beside": closed(place, code, counts, len(places))})

        find = ids_of()
        for batch in few_texts(batches):
            for words, outside, codes in classes_of(batch, find):
                if len(outside):
                    place = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                    own.append((place, codes[outside]))
                    place = place * (2 * total)
                    waiting.append(np.concatenate([place + codes[outside - 1], place + total + codes[outside + 1]]))
                    n += 2 * len(outside)
                    if n > 2 * PENDING or len(places) > GATHERED:
                        yield flush()
                        places, waiting, n, own = _Places(), [], 0, []
        if waiting:
            yield flush()

    return run


def moved_tail(rows: DataFrame, matrix: np.ndarray, n_classes: int, n_tail: int, half: int | None) -> DataFrame:
    """word, c, class of the words outside the head after each of one half (None: all) has moved to its best class.
    Words are dealt by hash, about ``SHARE`` to a group."""
    total = n_classes + 2
    shares = max(128, -(-n_tail // SHARE))
    known: dict[tuple, int] = {}  # class by own class and tokens beside, of words with few tokens; one per task

    def move(some: pa.Table) -> pa.Table:
        some = some.combine_chunks()
        word, own, cells = (some.column(c).chunk(0) if some.column(c).num_chunks else pa.array([], some.schema.field(c).type) for c in ("word", "own", "beside"))
        encoded = word.dictionary_encode()
        named, index = encoded.dictionary, encoded.indices.to_numpy()
        now = np.zeros(len(named), np.int64)
        now[index] = own.to_numpy()  # one class per word
        row, code, n = opened(cells)
        at = index[row]
        # every token has one neighbour after it
        c = np.bincount(at[code >= total], n[code >= total], len(named)).astype(np.int64)
        neighbours, rows_of = np.bincount(at, minlength=len(named)), np.bincount(index, minlength=len(named))
        alone = np.zeros(len(named), np.int64)
        alone[index] = np.arange(len(index))  # the row of a word that has one
        lone = np.flatnonzero((rows_of == 1) & (neighbours <= FEW))
        texts = cells.take(pa.array(alone[lone])).dictionary_encode()
        kinds, first, of = np.unique(now[lone] * (len(texts.dictionary) + 1) + texts.indices.to_numpy(), return_index=True, return_inverse=True)
        values = texts.dictionary.to_pylist()
        keys = [(o, values[i]) for o, i in zip(now[lone[first]].tolist(), texts.indices.to_numpy()[first].tolist())]
        new = np.array([k not in known for k in keys], bool)
        # words with few neighbours first, so that the words of a step are alike
        ask = np.concatenate([lone[first[new]], np.setdiff1d(np.arange(len(named)), lone)]).astype(np.int64)
        rank = np.full(len(named), -1)
        rank[ask] = np.arange(len(ask))
        order = np.argsort(rank[at], kind="stable")
        order = order[np.searchsorted(rank[at[order]], 0):]
        ranked, code, n = rank[at[order]], code[order], n[order]
        ends = np.searchsorted(ranked, np.arange(len(ask) + 1))
        chosen, low = np.zeros(len(named), np.int64), 0
        while low < len(ask):
            high = min(low + 256, max(low + 1, int(np.searchsorted(ends, ends[low] + STEP, "right")) - 1), len(ask))
            here, of_here = ask[low:high], slice(ends[low], ends[high])
            vectors = np.bincount((ranked[of_here] - low) * (2 * total) + code[of_here], n[of_here], len(here) * 2 * total).reshape(len(here), 2 * total)
            chosen[here] = best_classes(matrix, now[here], vectors[:, total:], vectors[:, :total], n_classes)
            low = high
        known.update((keys[i], int(chosen[lone[first[i]]])) for i in np.flatnonzero(new).tolist())
        chosen[lone] = np.array([known[k] for k in keys], np.int64)[of]
        # a word that no class gains from at first (all words beside it are outside the head) goes by its hash
        lost = np.flatnonzero(chosen > n_classes)
        chosen[lost] = [hash_of(w) // 2 % n_classes for w in named.take(pa.array(lost)).to_pylist()]
        if half is not None:
            chosen = np.where(np.array([hash_of(w) % 2 == half for w in named.to_pylist()], bool), chosen, now)
        if len(known) > GATHERED:
            known.clear()
        return pa.table({"word": named, "c": c, "class": chosen.astype(np.int8)})

    return written(rows.groupBy(F.pmod(F.xxhash64("word"), F.lit(shares)).alias("share")).applyInArrow(move, "word binary, c long, class byte"),
                   "lexicon")


def closed(row: np.ndarray, code: np.ndarray, n: np.ndarray, rows: int) -> pa.Array:
    """The column of cells that ``opened`` reads, from its neighbours in the order of their rows."""
    size = np.bincount(row, minlength=rows)
    first = np.cumsum(size) - size
    place = np.arange(len(row)) - first[row]
    data = np.empty(5 * len(row), np.uint8)
    start = 5 * first[row]
    data[start + place] = code
    start += size[row] + 4 * place
    for i in range(4):
        data[start + i] = (n >> 8 * i & 255).astype(np.uint8)
    ends = (5 * np.append(first, len(row))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def opened(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, code, n of all neighbours in a column of cells, each of which has its codes in a byte and then its counts in four."""
    ends = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1, 4 * cells.offset).astype(np.int64)
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)
    size = np.diff(ends) // 5
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    code = data[ends[row] + place].astype(np.int64)
    at = ends[row] + size[row] + 4 * place
    return row, code, sum(data[at + i].astype(np.int64) << 8 * i for i in range(4))


def hash_of(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=4).digest(), "little")


TAIL_ROWS = "word binary, own int, beside binary"


def beside_in_texts(docs: DataFrame, sent, end: int, classes: np.ndarray, total: int) -> DataFrame:
    """The tokens beside the words outside the head, these words themselves in one class of their own."""
    def classes_of(batch, ids):
        for text in utf8(batch.column(0)):
            words = words_of(text)
            row = _row(words, ids, end)
            outside = np.flatnonzero(row == ids.rare)
            yield [words[i - 1] for i in outside.tolist()], outside, classes[row]

    return docs.select("text").mapInArrow(gathered(lambda: _Ids(sent.value), classes_of, total), TAIL_ROWS)


def beside_in_chains(joined: DataFrame, n_codes: int) -> DataFrame:
    """The same from the documents' class sequences, where all words have their classes."""
    def classes_of(batch, _):
        for chain, found, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            codes, own = resolved(chain, found, n_codes)
            outside = np.flatnonzero(codes >= n_codes)
            yield [words[i] for i in (codes[outside] - n_codes).tolist()], outside, own

    training = joined.filter(~F.col("held_out")).select("chain", "classes", "words")
    return training.mapInArrow(gathered(lambda: None, classes_of, n_codes), TAIL_ROWS)


def resolved(chain: bytes, found: pa.Scalar, n_codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a document's sequence and the classes they stand for."""
    codes = np.frombuffer(chain, f"<u{chain[0]}", offset=1).astype(np.int64)
    tail = found.values.to_numpy(zero_copy_only=False) if found.is_valid else np.zeros(0, np.int64)
    return codes, np.concatenate([np.arange(n_codes), tail]).astype(np.int64)[codes]


def count_classes(joined: DataFrame, n_codes: int) -> np.ndarray:
    """Training tokens of each pair of classes.  A task sends the cells that it met; they are summed by cell, so the
    driver gets ``n_codes`` squared numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = np.zeros(n_codes * n_codes, np.int64)
        for batch in batches:
            for chain, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = resolved(chain, found, n_codes)[1]
                matrix += np.bincount(own[:-1] * n_codes + own[1:], minlength=n_codes * n_codes)
        cells = np.flatnonzero(matrix)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int64()), "n": pa.array(matrix[cells])})

    training = joined.filter(~F.col("held_out")).select("chain", "classes")
    matrix = np.zeros(n_codes * n_codes)
    for cell, n in training.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        matrix[cell] = n
    return matrix.reshape(n_codes, n_codes)


class ClassModel:
    """Log10 tables of a fitted model; all of fixed size."""

    def __init__(self, head: list[tuple[bytes, int]], classes: np.ndarray, matrix: np.ndarray, n_tokens: int, n_distinct: int,
                 members: tuple[np.ndarray, np.ndarray]):
        """``classes``: the classes of the head words and of a word outside.  ``members``: tokens and distinct words of
        each class; the last class is that of unknown words."""
        counts = np.array([c for _, c in head], float)
        self.base_total = float(n_tokens + ADD * (n_distinct + 1))
        in_class, words = members[0].copy(), members[1].copy()
        words[-1] = 1
        self.unigram = in_class + ADD
        self.unigram[-1] = 0
        self.unigram /= self.unigram.sum()
        total = in_class + ADD * words
        self.log_total = np.log10(np.maximum(total, 1e-300))  # a class may be empty
        # The class of the end token has no other word: its emission is 1.
        self.emission = np.append(np.log10((counts + ADD) / total[classes[:-1]]), 0.0)
        self.base = np.append(np.log10((counts + ADD) / self.base_total), 0.0)
        self.classes = classes
        self.words = [w for w, _ in head]
        self.transition = self.transitions(matrix)

    def transitions(self, matrix: np.ndarray) -> np.ndarray:
        """Log10 of the next class's probability, smoothed by the classes' shares; an unknown word has its base
        probability after any class."""
        transition = (matrix + PRIOR * self.unigram) / (matrix.sum(axis=1, keepdims=True) + PRIOR)
        unknown = ADD / self.base_total if self.base_total > ADD else 0.5  # without training: either known or not
        transition *= 1 - unknown
        transition[:, -1] = unknown
        return np.log10(transition)


class Fitted:
    """Head words with their counts and classes, the number of tokens and distinct words of the training texts, and
    ``lexicon``: word, c, class of the other words."""

    def __init__(self, training: DataFrame, counts: DataFrame, head_size: int, n_classes: int, rounds: int):
        self.n_classes, self.n_codes = n_classes, n_classes + 2
        self.n_tokens, self.n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        if not self.n_tokens:  # no training text: everything is unknown
            self.head, self.classes = [(END, 0)], np.array([n_classes, n_classes + 1])
            self.lexicon = counts.select("word", "c", F.lit(n_classes + 1).cast("byte").alias("class"))
            self.gains = []
            return
        short = counts.filter((F.octet_length("word") <= MAX_HEAD_WORD) | (F.col("word") == F.lit(bytearray(END))))
        self.head = [(bytes(w), c) for w, c in most_frequent(short, "word", "c", head_size).collect()]
        if END not in [w for w, _ in self.head]:
            self.head[-1] = (END, counts.filter(F.col("word") == F.lit(bytearray(END))).first()["c"])
        end = [w for w, _ in self.head].index(END)
        sent = training.sparkSession.sparkContext.broadcast([w for w, _ in self.head])
        pairs = count_head_pairs(training, sent, end)
        exchange = Exchange(neighbours(pairs), len(self.head), end, n_classes)
        exchange.run(rounds)
        self.classes, self.gains = exchange.classes, exchange.gains
        beside = beside_in_texts(training, sent, end, self.classes, self.n_codes)
        self.lexicon = moved_tail(beside, exchange.matrix, n_classes, self.n_distinct - len(self.head), None)

    def model(self, matrix: np.ndarray) -> ClassModel:
        """The tables for the lexicon's present classes; each class's sums are at most ``n_codes`` rows."""
        members = np.zeros((2, self.n_codes))
        if self.n_tokens:
            for (_, c), k in zip(self.head, self.classes):
                members[:, k] += c, 1
            for k, tokens, words in self.lexicon.groupBy("class").agg(F.sum("c"), F.count("*")).collect():
                members[:, k] += tokens, words
        return ClassModel(self.head, self.classes, matrix, self.n_tokens, self.n_distinct if self.n_tokens else 0, (members[0], members[1]))


def sequences(rows: DataFrame, fitted: Fitted) -> DataFrame:
    """doc_id, held_out, n_tokens, n_head, head_log (sum of log10(c + 0.1) of head words), row,
    tail (place, word, n of the distinct other words) and chain: the classes of all tokens, or for another word
    its place after them."""
    n_codes, known = fitted.n_codes, fitted.n_tokens > 0
    log = np.append(np.log10(np.array([c for _, c in fitted.head], float) + ADD), 0.0)
    sent = rows.sparkSession.sparkContext.broadcast(([w for w, _ in fitted.head], fitted.classes, log))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of_head, classes, head_log = sent.value
        ids = _Ids(words_of_head)
        end, rare = ids[END], ids.rare
        for batch in few_texts(batches):
            n_all, n_head, logs, chains, tail_words, tail_n, sizes = [], [], [], [], [], [], [0]
            for text in utf8(batch.column(1)):
                words = words_of(text)
                row = _row(words, ids, end)
                codes, tokens = classes[row], row[1:]
                outside = np.flatnonzero(row == rare)
                n_all.append(len(tokens))
                n_head.append((len(tokens) - len(outside)) * known)
                logs.append(float(head_log[tokens].sum()))
                found = [words[i - 1] for i in outside.tolist()]
                seen = dict.fromkeys(found)
                place = dict(zip(seen, range(len(seen))))
                at = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
                codes[outside] = n_codes + at
                wide = n_codes + len(seen) > 1 << 16
                chains.append((b"\4" + codes.astype("<u4").tobytes()) if wide else (b"\2" + codes.astype("<u2").tobytes()))
                tail_words.append(seen)
                tail_n.append(np.bincount(at, minlength=len(seen)))
                sizes.append(len(seen))
            ends = np.cumsum(sizes)
            places = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes[1:])
            tails = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(list(chained.from_iterable(tail_words)), pa.binary()),
                                                pa.array(np.concatenate([np.zeros(0, np.int64), *tail_n]), pa.int64())], ["place", "word", "n"])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(n_all, pa.int64()), pa.array(n_head, pa.int64()), pa.array(logs, pa.float64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tails),
                pa.array(chains, pa.binary())], names=["doc_id", "held_out", "n_tokens", "n_head", "head_log", "tail", "chain"])

    schema = ("doc_id long, held_out boolean, n_tokens long, n_head long, head_log double, "
              "tail array<struct<place: int, word: binary, n: long>>, chain binary")
    return written(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "sequences")


def with_classes(scored: DataFrame, lexicon: DataFrame, n_classes: int, words: bool) -> DataFrame:
    """The sequences with the classes of their other words, n_known and log_all, the sum of log10(c + 0.1) of all tokens.
    Ranges of ``row``, which are whole files of the sequences, are worked one after the other, so that only one range's
    words lie in shuffle files."""
    last = scored.agg(F.max("row")).first()[0]
    files = 1 if last is None else (last >> 33) + 1  # the task of a row is in the bits from the 33rd
    steps = min(SLICES, files)
    bounds = [(files * k // steps) << 33 for k in range(steps + 1)]
    return reduce(DataFrame.union, [classes_of_rows(scored.filter((F.col("row") >= low) & (F.col("row") < high)), lexicon, n_classes, words)
                                    for low, high in zip(bounds, bounds[1:])])


def classes_of_rows(scored: DataFrame, lexicon: DataFrame, n_classes: int, words: bool) -> DataFrame:
    """``with_classes`` for some rows.  No word is a hot key: a document sends each of its words once, and frequent words
    are in the head.  A word's place and class travel as one number."""
    tail = (scored.select("row", F.explode("tail").alias("t")).select("row", "t.place", "t.word", "t.n")
            .join(lexicon, "word", "left"))
    placed = F.shiftleft(F.col("place").cast("long"), 8) + F.coalesce("class", F.lit(n_classes + 1).cast("byte"))
    by_row = tail.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ADD)).alias("tail_log"),
        F.transform(F.sort_array(F.collect_list(placed)), lambda x: x.bitwiseAND(255).cast("byte")).alias("classes"))
    kept = [F.transform("tail", lambda t: t["word"]).alias("words")] if words else []
    return written(scored.join(by_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0))).alias("log_all"), "chain", "classes", *kept), "classes")


def class_lm_scores(docs: DataFrame, held_out: Column, head_size: int = HEAD, n_classes: int = CLASSES, rounds: int = ROUNDS,
                    tail_rounds: int = TAIL_ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row of ``docs``
    (doc_id, text); rows with ``held_out`` take no part in the counts.

    A null text is empty: one end token.  Repeated rows are scored one by one and each counts in training.  Without
    any training row the counts are 0 and every token but the end is unknown.  Between equally good classes the first
    one holds; a word stays where it is unless another class is better.
    """
    joined, fitted, model = fitted_classes(docs, held_out, head_size, n_classes, rounds, tail_rounds)
    sent = docs.sparkSession.sparkContext.broadcast((model.transition, model.log_total))
    kept, n_codes = ["doc_id", "held_out", "n_tokens", "n_known", "log_all"], fitted.n_codes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transition, log_total = sent.value
        for batch in batches:
            added = []
            for chain, found in zip(batch.column("chain").to_pylist(), batch.column("classes")):
                own = resolved(chain, found, n_codes)[1]
                added.append(float(transition[own[:-1], own[1:]].sum() - log_total[own[1:]].sum()))
            score = pc.add(batch.column("log_all"), pa.array(added, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), score], names=[*kept, "score"])

    scored = joined.select(*kept, "chain", "classes").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, log_all double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(fitted.n_tokens).cast("long").alias("train_tokens"),
        (F.col("log_all") - F.col("n_tokens") * F.log10(F.lit(model.base_total))).alias("base_score"), "score",
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def fitted_classes(docs: DataFrame, held_out: Column, head_size: int, n_classes: int, rounds: int, tail_rounds: int) -> tuple[DataFrame, Fitted, ClassModel]:
    """The documents' class sequences, the classes and the model after all rounds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    fitted = Fitted(training, written(count_words(training), "counts"), head_size, n_classes, rounds)
    scored = sequences(rows, fitted)
    if not fitted.n_tokens:
        tail_rounds = 0
    joined = with_classes(scored, fitted.lexicon, n_classes, tail_rounds > 0)
    matrix = count_classes(joined, fitted.n_codes)
    for turn in range(tail_rounds):
        beside = beside_in_chains(joined, fitted.n_codes)
        fitted.lexicon = moved_tail(beside, matrix, n_classes, fitted.n_distinct - len(fitted.head), turn % 2)
        joined = with_classes(scored, fitted.lexicon, n_classes, turn + 1 < tail_rounds)
        matrix = count_classes(joined, fitted.n_codes)
    return joined, fitted, fitted.model(matrix)


def by_crc(doc_id: Column) -> Column:
    """Held out: crc32 of the id as text is a multiple of 10."""
    return crc32_mod(doc_id, 10) == 0
