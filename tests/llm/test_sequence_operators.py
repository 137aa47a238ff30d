"""Operators 11, 12 and 13."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest

from cohortlens.llm import fill_in_middle as M
from cohortlens.llm import prefix_trie as T
from cohortlens.llm import queries, warc
from oracle import compare, duck

NEW = ("op11_prefix_trie", "op12_warc", "op13_fill_in_middle")


@pytest.mark.parametrize("name", NEW)
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_whole_tables_against_sql(spark, name, folder):
    assert compare(spark, duck(folder), name, queries.QUERIES[name], queries.ORACLE[name], folder) == []


# --- 11 -------------------------------------------------------------------------------------------------------------

def plain_trie(rows):
    """Nodes by a dictionary of all prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), key, role, text))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(c - int(c - 100 * int(c / 100)), [])[:h] + turns[h:])
    node = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            node[turns[:d]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in node:
        if p:
            kids[p[:-1]] += 1
    for p, cs in node.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    return sorted((min(cs), len(p), min(node[p[:-1]]) if p else -1, len(cs), kids.get(p, 0), leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(cs) if full[c] == p).encode()).hexdigest())
                  for p, cs in node.items())


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(330), -5, -100, -99, 10**12, 10**12 + 7]:
        if c == 100:
            continue  # an absent base
        for t in range(90 if c == 203 else rng.choice([1, 1, 2, 3, 7, 12, 25])):
            rows.append((c, rng.choice([t, t, None, t // 2]), rng.choice(["user", None, "a"]), rng.choice(["x", "", "yé", None])))
    rows += [(c, t, "u", f"same{t}") for c in range(2000, 4100) for t in range(9)]
    rows += [(None, 1, "u", "nobody"), (2001, 3, "u", "same3")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,batch", [(512, 10000), (24, 7), (40, 1)])
def test_trie_by_blocks_and_batches(spark, block, batch):
    """Cut into short blocks and batches, the forests must still join to the same trie."""
    rows = conversations(block)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, `key` string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(tuple(-1 if v is None else v for v in r) for r in T.prefix_trie(df.repartition(6), block).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == plain_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert T.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(c, 0, "u", "t") for c in range(101, 140)]  # the base is absent: most lose their only turn
    got = sorted(tuple(-1 if v is None else v for v in r) for r in T.prefix_trie(spark.createDataFrame(rows, schema)).collect())
    assert got == plain_trie(rows) and len(got) == 2


# --- 12 -------------------------------------------------------------------------------------------------------------

def page_rows():
    rows = [(i, f"http://u/{i} \n", ["", None, "a", "b", "é" * 9, "b" * 100_000][i % 6], "extra") for i in range(300)]
    return rows + [(None, None, "a", None), (None, None, "zz", None), (None, None, "zz", None), (5, "x", "a", ""), (5, "x", "a", ""),
                   (4000, "x", "q", ""), (4000, "x", "q", "")]


def test_archives_against_sql(spark):
    rows = page_rows()
    con = duck("/root/testdata/sf0.001")
    con.register("given", pd.DataFrame(rows, columns=["page_id", "url", "html", "digest"]).astype({"page_id": "Int64"}))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(5)
    got = warc.deduplicated_pages(spark, df)
    want = con.sql(queries.OP12_SQL.replace("FROM pages", "FROM given")).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert warc.deduplicated_pages(spark, df.limit(0)).collect() == []


def test_archives_roll_and_small_payloads_stay(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(2)
    first, second = warc.shared_path(spark, "t1"), warc.shared_path(spark, "t2")
    headers = warc.write_archives(df, first, "2020-01-01T00:00:00Z", archive_bytes=400)
    assert headers.select("archive").distinct().count() > 10
    resolved = warc.resolve_revisits(headers, min_bytes=2)
    out = warc.read_archives(warc.deduplicate_archives(resolved, first, second, "2021-01-01T00:00:00Z")).collect()
    assert len(out) == len(rows)
    by_kind = {(r.record_type, r.payload_bytes) for r in out}
    assert ("revisit", 1) not in by_kind and ("revisit", 0) not in by_kind and ("revisit", 18) in by_kind
    assert {r.refers_to for r in out if r.payload_bytes == 100_000 and r.record_type == "revisit"} == {299}


def test_records_are_standard_warc():
    raw = zlib.decompress(warc.record("response", "<urn:page:7:0-0>", "http://x/a b", "2020-01-01T00:00:00Z",
                                      warc.payload_digest(b"\r\n\r\nhi"), 6, b"\r\n\r\nhi", {}), 31)
    fields, http, payload = warc.parse_record(raw)
    assert raw.startswith(b"WARC/1.1\r\n") and payload == b"\r\n\r\nhi" and http["content-length"] == "6"
    assert fields["warc-target-uri"] == "http://x/a%20b" and warc.page_of(fields["warc-record-id"]) == 7
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-1])


# --- 13 -------------------------------------------------------------------------------------------------------------

def plain_fim(doc_id, text, options):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if options.unit == "line" else list(text)
    hx = hashlib.sha256(f"{options.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hx[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= options.rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < options.spm
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("options", [M.FimOptions(), M.FimOptions(11, 60, 30, "char"), M.FimOptions(3, 0)])
def test_fim_rows(spark, hard_docs, options):
    more = ["😀é\nß日\n", "\n", "a\n\nb", "<P>", "x<S", "S>x\n<", "<\n<\n<", "a\r\nb", "no <M> ever", "é" * 3000 + "\n" + "a" * 3000]
    docs = hard_docs.unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(more, 100)], "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumn("form", docs.doc_id).withColumn("output", docs.doc_id)
    made = M.fill_in_middle(docs, options)
    assert [c for c in docs.columns if c not in ("form", "output")] == made.columns[:-5]
    rows = made.withColumn("restored", M.restore(made.output, made.form)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, r.text, options), r.text
        assert r.restored == (r.text or "")
    assert M.fill_in_middle(docs.limit(0), options).collect() == []


def test_exception_index_both_ways():
    import numpy as np
    for text in ("", "abc", "aé日😀b" * 50, "😀", "x" * 100 + "ß"):
        index = M.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
        cuts = [len(text[:i].encode()) for i in range(len(text) + 1)]
        assert index.byte_of(np.arange(len(text) + 1)).tolist() == cuts
        assert index.char_of(np.array(cuts)).tolist() == list(range(len(text) + 1))
        assert len(index.at_byte) == sum(ord(c) > 127 for c in text)
