"""Fill-in-the-middle outputs against a plain version and exact round trips."""

import hashlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
from presstide.llm import fill_middle as fm


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(doc_id, text):
    """One row by the definition, in one go."""
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = h1 % (n + 1), h2 % (n + 1)
    a, b = min(a, b), max(a, b)
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, a, b - a, sha(out), sha(text)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()), key=repr)


HARD = [
    (1, "abc"), (2, None), (3, ""), (4, "has <M> inside"), (None, "no id"), (None, "no id"), (5, "\U0001f600é" * 5000),
    (5, "\U0001f600é" * 5000), (6, "<P"), (7, "<<S"), (8, "x"), (-(2**63), "least id"), (9, "<" * 300), (10, ">" * 300), (11, "<S<P<M" * 50),
] + [(k, "word " * (k % 40)) for k in range(20, 120)]


@pytest.mark.parametrize("units", [1, 7, 4096])
def test_small_cases(spark, units):
    df = spark.createDataFrame([(d, t, "r", "h") for d, t in HARD], "doc_id long, text string, row string, home string")
    assert rows(fm.digests(df, units=units)) == sorted((plain(d, t) for d, t in HARD), key=repr)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fm.digests(df).count() == 0 and fm.transformed(df).count() == 0


def test_whole_table(spark, small):
    docs = pq.read_table(f"{small}/documents.parquet").to_pylist()
    got = rows(entry.queries()["op13_fill_middle"](spark, small))
    assert got == sorted((plain(d["doc_id"], d["text"]) for d in docs), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_outputs_restore(spark):
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    got = fm.transformed(df, units=5).collect()
    assert sorted(((r.doc_id, fm.restore(r.output, r.form)) for r in got), key=repr) == sorted(((d, t or "") for d, t in HARD), key=repr)


@settings(max_examples=200, deadline=None)
@given(st.integers(-(2**63), 2**63 - 1), st.text(alphabet="<>PSMa é\U0001f600", max_size=60), st.integers(1, 9))
def test_cut_and_restore(doc_id, text, units):
    form, prefix, middle = fm.plan(doc_id, text)
    out = "".join(fm.cut(text, form, prefix, middle, units))
    assert fm.restore(out, form) == text and sha(out) == plain(doc_id, text)[5]
