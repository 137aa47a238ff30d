"""Operators 1, 5 and 10 against the libraries' whole-text encodings."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm import bin_packing, queries, token_counts, token_output
from cohortlens.llm.common import shared_path, table
from cohortlens.llm.tokenizing import piece_bpe, word_bpe

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(WORD)
PIECES = sentencepiece.SentencePieceProcessor(model_file=PIECE)


def encode(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\t\r'svel.,!<|>0²ªéÉßΣİ́　▁\x1c\x85\x00ABñ日"), max_size=20))
def test_cached_ids_equal_whole_text_ids(text):
    assert np.frombuffer(word_bpe(WORD).ids(text), np.uint32).tolist() == encode(text)
    assert np.frombuffer(piece_bpe(PIECE).ids(text), np.uint32).tolist() == PIECES.encode(text)


def expected_output(rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*encode(text), 2]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_token_output_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").orderBy("doc_id").collect()]
    got = sorted(tuple(r) for r in queries.op1_token_output(spark, sf).collect())
    assert got == expected_output(rows)


def test_token_files(spark, hard_docs):
    folder = shared_path(spark, "files")
    shards = token_output.write_token_files(hard_docs, WORD, folder, 2, sequence=16, batch_rows=4, shard_bytes=40_000)
    rows = sorted(((r.doc_id, r.text) for r in hard_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    expected = expected_output(rows)
    got = sorted((tuple(r) for r in token_output.read_documents(shards).collect()), key=lambda r: r[1])
    assert got == expected
    listed = shards.orderBy("shard").collect()
    assert len(listed) > 1 and sum(r.n_docs for r in listed) == len(rows)
    for r in listed:
        shard = token_output.TokenShard(r.path)
        stream = np.concatenate([shard.sequence(i) for i in range(len(shard))])
        mask = np.concatenate([shard.mask(i).to_numpy(zero_copy_only=False) for i in range(len(shard))])
        assert mask.sum() == r.n_tokens and mask[:r.n_tokens].all()
        assert len(shard.sequence(0)) == 16 and not shard.sequence(0).flags["OWNDATA"]
        whole = [t for _, text in rows for t in [*encode(text), 2]]
        assert stream[mask].tolist() == whole[r.base:r.base + r.n_tokens]


def test_token_output_empty(spark, hard_docs):
    assert token_output.token_output(spark, hard_docs.limit(0), WORD, 2).collect() == []


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_whole_table(spark, sf):
    rows = queries.op5_bin_packing(spark, sf).collect()
    expected = {}
    for r in table(spark, sf, "documents").collect():
        ids = [*encode(r.text), 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            expected[r.doc_id, k] = (at, len(part), crc(part))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected
    assert len(rows) == len(expected)
    used, total = check_packing(rows, 4096), sum(r.length for r in rows)
    assert used <= -(-total // 4096) + 1


def test_packing_hard_rows(spark, hard_docs):
    rows = bin_packing.pack_documents(hard_docs, WORD, 1, capacity=64).collect()
    check_packing(rows, 64)
    assert sum(r.length for r in rows) == sum(len(encode(r.text)) + 1 for r in hard_docs.collect())
    assert bin_packing.pack_documents(hard_docs.limit(0), WORD, 1).collect() == []


def test_packing_hot_length(spark):
    pieces = spark.createDataFrame([(i, 0, 7 if i % 3 else 5 + i % 11) for i in range(3000)],
                                   "doc_id long, piece int, length long")
    rows = bin_packing.pack(pieces, capacity=40, rank_rows=64).collect()
    assert len(rows) == 3000
    room = []
    for size in sorted((r.length for r in rows), reverse=True):  # first-fit decreasing
        k = next((k for k, left in enumerate(room) if left >= size), None)
        if k is None:
            room.append(40 - size)
        else:
            room[k] -= size
    assert check_packing(rows, 40) <= len(room)


def best_fill(lengths, capacity):
    """Fullest sum with the largest length in it, by trying all subsets."""
    lengths = sorted(lengths, reverse=True)
    sums = {lengths[0]}
    for size in lengths[1:]:
        sums |= {s + size for s in sums if s + size <= capacity}
    return max(sums)


def test_fullest_bin_is_fullest():
    rng = random.Random(3)
    for _ in range(300):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        pattern = bin_packing.fullest(dict(Counter(lengths)), 40)
        taken = Counter(dict(pattern))
        assert all(taken[s] <= Counter(lengths)[s] for s in taken) and taken[max(lengths)] >= 1
        assert sum(s * k for s, k in pattern) == best_fill(lengths, 40)


def check_counts(rows, texts):
    got = Counter(tuple(r) for r in rows)
    want = Counter((i, len((t or "").encode()), len(PIECES.encode(t or "")), len(PIECES.encode(t or "")) > 4096)
                   for i, t in texts)
    assert got == want


def test_token_counts(spark, sf, hard_docs):
    check_counts(queries.op10_token_counts(spark, sf).collect(),
                 [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    check_counts(token_counts.count_tokens(hard_docs, PIECE, top=5).collect(),
                 [(r.doc_id, r.text) for r in hard_docs.collect()])
    assert token_counts.count_tokens(hard_docs.limit(0), PIECE).collect() == []


def test_ids_of_every_character_below_u0250():
    """Control characters too, in several places of a word and of a text, for both tokenizers."""
    from cohortlens.llm import tokenizing
    word, piece = tokenizing.word_bpe(queries.WORD_BPE), tokenizing.piece_bpe(queries.PIECE_BPE)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f"a {c} b", f"{c}word", f"Word{c}", f"it{c}s {c}{c}"):
            assert np.frombuffer(word.ids(text), np.uint32).tolist() == word.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
            assert np.frombuffer(piece.ids(text), np.uint32).tolist() == piece.model.encode(text), repr(text)
