"""Repeated passages against a table of all windows."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from presstide.llm import repeats as rp


def plain(docs):
    """docs: (doc_id, text). Rows by the definition."""
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for s in range(len(b) - 99):
            at = (d is None, d or 0, s)
            first[b[s : s + 100]] = min(first.get(b[s : s + 100], at), at)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - 99):
            if first[b[s : s + 100]] < (d is None, d or 0, s):
                gone[s : s + 100] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((d, len(b), int(gone.sum()), int((gone[:-1] & ~gone[1:]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "t", 2) for d, t in docs], "doc_id long, text string, key int, tag string, lo int")


def passages(seed, n=60, share=0.5):
    """Texts of shared and own passages of many lengths, some of them hot."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    pool = [prose(k) for k in (3, 10, 17, 18, 19, 20, 21, 22, 25, 40, 90, 300)] + ["ab" * 150, "x" * 250, "abc" * 40]
    return [(d, " ".join(r.choice(pool) if r.random() < share else prose(r.randint(0, 40)) for _ in range(r.randint(0, 6)))) for d in range(n)]


@pytest.mark.parametrize("seed,chunk,block", [(1, rp.CHUNK, rp.BLOCK), (2, 3000, 5), (3, 400, 2)])
def test_passages(spark, seed, chunk, block):
    docs = passages(seed)
    random.Random(seed).shuffle(docs)
    want = plain(docs)
    assert got(rp.without_repeats(frame(spark, docs).repartition(3), chunk=chunk, block=block, digest=True)) == want
    assert sum(r[2] for r in want) > 1000


def test_odd_rows(spark):
    long = "".join(random.Random(5).choice("abcdefgh") for _ in range(700))
    docs = [
        (5, long), (3, None), (4, ""), (None, long[:300]), (None, long[200:500] + "z"), (5, long), (5, "q" + long), (-(2**63), long[100:250]),
        (2**63 - 1, long[:99]), (6, long[:100]), (7, "\U0001f600" * 60), (8, "\U0001f600" * 200), (9, "a" * 99), (10, "a" * 100), (11, "a" * 101), (12, "\x00" * 300),
    ]
    assert got(rp.without_repeats(frame(spark, docs), digest=True)) == plain(docs)


def test_empty_table(spark):
    assert rp.without_repeats(frame(spark, [])).count() == 0


def test_hot_line_in_many_texts(spark):
    r = random.Random(9)
    line = "all rights reserved, no part of this may be copied or kept in any form without leave of its owner, who can be asked " * 2
    docs = [(d, "".join(r.choice("abcdefg ") for _ in range(150)) + line + "".join(r.choice("abcdefg ") for _ in range(150))) for d in range(300)]
    assert got(rp.without_repeats(frame(spark, docs).repartition(4), chunk=5000, block=40, digest=True)) == plain(docs)


def test_whole_table(spark, small):
    docs = [(d["doc_id"], d["text"]) for d in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    assert got(entry.queries()["op11_repeats"](spark, small)) == plain(docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.lists(st.integers(0, 6), min_size=40, max_size=40))
def test_previous_factors(rank, place):
    rank, place = np.array(rank), np.array(place[: len(rank)])
    want = [any(rank[j] == rank[i] and place[j] < place[i] for j in range(len(rank))) for i in range(len(rank))]
    assert rp.has_previous_factor(rank, place).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"ab", b"a", b"b" * 60, b"abc" * 30, bytes(range(120))]), min_size=1, max_size=8))
def test_runs_cover_all_windows_and_suffixes_are_sorted(parts):
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    key, ctx, lo, n = rp.runs(data, ends)
    starts = [s for a, b in zip([0, *ends[:-1]], ends) for s in range(a, b - 99)]
    assert [s for a, k in zip(lo, n) for s in range(a, a + k)] == starts and (n <= rp.CHOICE).all()
    body, rank = data.tobytes(), rp.suffix_ranks(data, np.array(starts, np.int64))
    strings = [body[s : s + 100] for s in starts]
    order = sorted(set(strings))
    assert rank.tolist() == [order.index(x) for x in strings]


