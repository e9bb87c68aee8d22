"""Collocations against counting by hand and against SQL."""

import collections
import glob
import os
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

import __spark_entry__ as entry
from check_oracle import normal
from presstide.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(docs, least=10, longest=3, top=2000):
    """docs: (lang, text). Rows by the definition."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    rows = collections.defaultdict(list)
    for (lang, ws), a in cand.items():
        if any(o != ws and m == lang and 100 * b >= 50 * a and any(o[i : i + len(ws)] == ws for i in range(len(o) - len(ws) + 1)) for (m, o), b in cand.items() if len(o) > len(ws)):
            continue
        cuts = [(10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        rows[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    out = []
    for lang, found in rows.items():
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(spark, docs, **options):
    df = spark.createDataFrame([(lang, text, "c", 1) for lang, text in docs], "lang string, text string, block string, n int")
    return sorted(tuple(r) for r in co.collocations(df, **options).select(*COLUMNS).collect())


TEXTS = [
    ("en", "The Big cat. the big cat, the big dog"), ("en", None), (None, "a a a a\tb"), ("und", "a a a! a b"), ("en", ""), ("en", " \t "),
    ("de", "é Ü é Ü\x0bé Ü; É é"), ("en", ".,;:"), ("fr", "x"), ("en", "the big cat the\x0cbig"), ("en", "the big cat the big cat"), ("en", "q\x00 w\x1f q\x00 w\x1f"),
] + [("en", "of the of the of the big. new york city new york")] * 4


@pytest.mark.parametrize("options", [{"least": 2}, {"least": 2, "block_bytes": 20}, {"least": 3, "longest": 4}, {"least": 1, "longest": 2}, {"least": 2, "top": 3}])
def test_small_cases(spark, options):
    want = plain(TEXTS, **{k: v for k, v in options.items() if k != "block_bytes"})
    assert got(spark, TEXTS, **options) == want and len(want) > 3


def test_empty_tables(spark):
    assert got(spark, []) == [] and got(spark, [("en", None), (None, "")]) == []


def test_a_hot_phrase_and_large_counts(spark):
    docs = [("en", "alpha beta gamma " * 400)] * 40 + [("en", "beta gamma. delta beta gamma")] * 30
    assert got(spark, docs, block_bytes=5000) == plain(docs)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["en", None]), st.text(alphabet="ab .\t", max_size=30)), max_size=8))
def test_generated(spark, docs):
    assert got(spark, docs, least=2, block_bytes=16) == plain(docs, least=2)


def test_against_sql(spark, small):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(small, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    rows = normal(entry.queries()["op12_collocations"](spark, small).toPandas())
    want = normal(con.execute(entry.oracle_sql()["op12_collocations"]).df())
    assert len(rows) > 50 and list(rows.columns) == list(want.columns) and rows.equals(want)


def test_runs_of_texts_are_bounded_and_whole():
    import pyarrow as pa

    from presstide.llm.collocations import _runs

    texts = pa.array(["a" * n for n in (3, 0, 9, 30, 1, 1, 8, 0)], pa.string())
    runs = [r.to_pylist() for r in _runs(texts, 10)]
    assert [t for r in runs for t in r] == texts.to_pylist() and len(runs) > 2
    assert all(sum(map(len, r)) < 10 + 30 for r in runs)
    assert list(_runs(texts.slice(0, 0), 10)) == []
