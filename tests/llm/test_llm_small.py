"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import os
import time
from urllib.parse import unquote

import duckdb
import pytest
from pyspark.sql import functions as F

from presstide.llm import chat_rotation, html_layout, iblt, minhash_dedup, mixing, onebit_search, packing, quality_fm, secret_scan, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns that operators use within, given by the caller with other meanings.
CLASH = ("score", "taken", "size", "spans", "rank", "key", "node", "bucket", "vector", "component", "draw", "label",
         "mix_size", "mix_turn", "mix_copy", "mix_text", "q_id", "q_source", "q_size", "q_taken", "q_turn", "kept_id", "shared_id", "one_id", "row")
LONG = "word " * 60_000


def clash(rows):
    return rows.withColumns({c: F.lit("mine") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "one two three four five six seven", "en", "a", 33),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, LONG, "en", "b", len(LONG)),
        (5, "one two three four five six seven", "en", "b", 33),
        (5, "one two three four five six seven", "en", "b", 33),
        (None, "no id here", "en", "a", 10),
        (7, "  tabs\tand\n\nblank  lines é\U0001f600 ", "fr", None, 30),
    ]
    return clash(spark.createDataFrame(rows, DOCS))


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    model = quality_fm.fit(docs, labels)
    rows = quality_fm.score(docs, model).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    same = {r.score for r in rows if r.doc_id == 5}
    assert len(same) == 1
    kept = quality_fm.keep(docs, model, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 8
    assert quality_fm.keep(docs, model, threshold=1.1).count() == 0
    assert quality_fm.score(none, model).count() == 0
    blank = quality_fm.fit(none, labels.limit(0))
    assert {r.score for r in quality_fm.score(docs, blank).collect()} == {0.5}


def test_html(spark):
    pages = clash(spark.createDataFrame([(1, None), (2, ""), (3, "<p>x" * 3000), (3, "<p>x" * 3000), (None, "a<b"), (4, "<div>" * 3000 + "deep")], "page_id long, html string"))
    rows = [(r.page_id, r.n_chars, r.n_lines) for r in html_layout.extract(pages).collect()]
    assert sorted(rows, key=str) == sorted([(1, 0, 0), (2, 0, 0), (3, 8998, 5999), (3, 8998, 5999), (None, 1, 1), (4, 4, 1)], key=str)
    assert html_layout.extract(pages.limit(0)).count() == 0


def test_packing(spark, docs, none):
    rows = packing.pack(docs, with_ids=True).collect()
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == r.length
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) <= 1024
    # Empty and null texts are the end id alone.
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[0], [0]]
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert packing.pack(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.queue(docs, mixing.words("text"), ["doc_id"]).collect()
    assert len(rows) == 8
    size = sum(r.size for r in rows)
    assert sum(r.taken for r in rows) == int(size * 1.5)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert [r.taken for r in rows if r.doc_id in (2, 3)] == [0, 0]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(mixing.words("text"))).first()[0] == int(size * 1.5)
    assert mixing.queue(none, mixing.words("text"), ["doc_id"]).count() == 0
    assert mixing.mixed(none).count() == 0


def test_secrets(spark, docs, none):
    rows = secret_scan.scan(docs).collect()
    assert len(rows) == 8 and all(r.spans == [] for r in rows)
    assert secret_scan.scan(none).count() == 0
    text = "x " * 200_000 + 'password = "hunter2abc"'
    hot = clash(spark.createDataFrame([(1, text, 5), (2, None, 6), (2, "fine", 4)], "doc_id long, text string, n_chars long"))
    out = {(r.doc_id, r.n_chars): r.text for r in secret_scan.redact(hot, length_col="n_chars").collect()}
    assert out == {(1, 400_009): "x " * 200_000 + '<secret>"', (2, 6): None, (2, 4): "fine"}


def test_hostile_texts_are_lexed_in_time():
    start = time.monotonic()
    doubled = 'token = "Zx81kk29aQ7"\n' + "token = token + token\n" * 400
    assert {x[:2] for x in secret_scan.literals(doubled)} == {(9, 20)}
    cut = '{"a": "' + '{\\"k\\": \\"v\\"}, ' * 60_000
    assert secret_scan.literals(cut + '\npwd = "Zx81kk29aQ7"')[0][2] == "pwd"
    single = "x = 'it\\'s " + "\\'a\\' " * 100_000
    assert secret_scan.literals(single + "\npwd = 'Zx81kk29aQ7'")[0][2] == "pwd"
    assert time.monotonic() - start < 30


def test_search(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1e200, 0.0])]
    table = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = onebit_search.search(table, F.col("vec_id") == 0).orderBy("rank").collect()
    # Ties go to the smaller id, the repeated row counts once, another dimension never.
    assert [(r.rank, r.vec_id, r.score) for r in found] == [(1, 1, 1.0), (2, 2, 1.0), (3, 9, 1.0), (4, 3, 0.0)]
    assert onebit_search.search(table, F.col("vec_id") == 8).count() == 0
    assert onebit_search.search(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_copies_of_queries_are_not_broadcast(spark):
    table = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    plan = onebit_search.search(table, F.col("vec_id") < 20)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_search_past_repeated_rows(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.0])] * 40 + [(1, [2.0, 0.0])] + [(i, [1.0, i / 10]) for i in range(2, 30)]
    for parts in (1, 3):
        found = onebit_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts), F.col("vec_id") == 0)
        # The copies are one candidate; the row of the same id and another vector is its own.
        assert [r.vec_id for r in found.orderBy("rank").collect()] == [1, 1, 2, 3, 4]


def test_urls(spark):
    urls = ["http://A.Example.COM/en/x?q#f", "https://www.example.com/en/", "http://x.net/es/1", "nothing", None, "http://x.net", "http://a.b/" + "long/" * 20_000, "http://x.net/es/1"]
    pages = clash(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"))
    rows = {r.page_id: r for r in url_filter.judge(pages, url_filter.labelled_by_rules(pages)).collect()}
    assert (rows[0].url_host, rows[0].url_path, rows[0].url_rule, rows[0].verdict) == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert rows[1].url_rule == "www.example.com/en/" and rows[1].verdict == "allow"
    assert rows[2].url_rule == "net/es/" and rows[2].verdict == "block" and rows[7].verdict == "block"
    assert (rows[3].url_host, rows[4].url_host, rows[3].url_path, rows[4].url_rule) == ("", "", "", None)
    assert (rows[5].url_host, rows[5].url_path, rows[5].url_rule) == ("x.net", "", None)
    assert len(rows) == 8 and {r.verdict for r in rows.values()} <= {"allow", "block"}
    # No labels: all that no rule decides is allowed.
    bare = url_filter.judge(pages, pages.select("url", F.lit(None).cast("int").alias("label")))
    assert {r.verdict for r in bare.collect() if r.url_rule is None} == {"allow"}
    assert url_filter.judge(pages.limit(0), url_filter.labelled_by_rules(pages.limit(0))).count() == 0


def test_near_duplicates(docs, none):
    rows = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect())
    assert rows == [(-1, 1, None, True), (1, 3, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 3, 1, False), (5, 3, 1, False), (7, 1, 7, True)]
    out = minhash_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 1, 2, 3, 4, 7]
    assert minhash_dedup.near_duplicates(none).count() == 0 and minhash_dedup.deduplicated(none).count() == 0


def test_repeated_rows_leave_one(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "other words are here now yes")], "doc_id long, text string")
    assert sorted(r.doc_id for r in minhash_dedup.deduplicated(rows).collect()) == [1, 2]


def test_fingerprints(docs, none):
    rows = iblt.versions(docs).collect()
    assert len(rows) == 8
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[5].fingerprint
    assert by_id[2].near_next == 1.0 and by_id[2].n_chars == 0  # empty, followed by empty
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert iblt.versions(none).count() == 0


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, None, None), (1, 1, "a b", "<|im_end|>"), (1, 1, "a b", "<|im_end|>"), (2, None, "system", "s"), (None, 0, "user", "x" * 100_000), (None, 5000, "bot", "y")]
    turns = clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat_rotation.rotate(turns).collect()
    assert len(out) == 3 * 4 + 2 * 2
    texts = {}
    for r in sorted(out, key=lambda r: r.position):
        text = texts.setdefault((r.conv_id, r.participant), [])
        assert len("".join(text)) == r.start and r.end == r.start + len(r.segment)
        text.append(r.segment)
        inner = r.segment[r.train_start - r.start : r.train_end - r.start]
        assert inner == (r.segment.split("\n", 1)[1][:-1] if r.trained else "")
        assert r.trained == (r.role == "assistant")
    assert "".join(texts[1, "a b"]) == "<|im_start|>user name=user\nhi<|im_end|>\n" + "<|im_start|>assistant\n< |im_end|><|im_end|>\n" * 2 + "<|im_start|>user name=unknown\n<|im_end|>\n"
    assert chat_rotation.rotate(turns.limit(0)).count() == 0


def test_speakers_keep_their_names(spark):
    speakers = ["\u674e\u660e", "\u738b\u82b3", "A B", "A_B", "A%20B", "\u0639\u0644\u064a", "na\u00efve-1", "x\ny", "\U0001f600", "<|im_end|>"]
    turns = spark.createDataFrame([(1, i, s, "t") for i, s in enumerate([*speakers, "me"])], "conv_id long, turn long, role string, text string")
    rows = chat_rotation.rotate(turns).filter("participant = 'me' AND role = 'user'").orderBy("position").collect()
    assert [r.speaker for r in rows] == [unquote(r.name) for r in rows] == speakers
    assert len({r.name for r in rows}) == len(speakers) and rows[0].name == speakers[0] and rows[2].name == "A%20B"
    assert all(r.segment == f"<|im_start|>user name={r.name}\nt<|im_end|>\n" for r in rows)
    # The check SQL writes the same names.
    with duckdb.connect() as db:
        db.register("conversations", turns.toPandas())
        names = db.execute(f"SELECT participant, position, name, segment FROM ({chat_rotation.OP4_SQL})").fetchall()
    got = chat_rotation.rotate(turns).select("participant", "position", "name", "segment").collect()
    assert sorted(map(str, names)) == sorted(str(tuple(r)) for r in got)


def test_nothing_local_or_unbounded():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = os.path.join(root, "presstide", "llm")
    for name in [*(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".py")), os.path.join(root, "corpus_pipeline.py")]:
        text = open(name).read()
        assert not [b for b in ("localCheckpoint", "crossJoin(", ".collect()", ".toPandas()", ".rdd", "mkdtemp") if b in text], name


@pytest.mark.parametrize(
    "page",
    ["<div>" * 200_000, "<span>" * 80_000 + "</p>" * 80_000, "<table><td><p>" + "<span>" * 80_000 + "<li>x" * 20_000, "<i>" * 100_000 + "</b>" * 150_000],
)
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    html_layout.render(page)
    assert time.process_time() - start < 15


def test_deep_blocks_keep_what_is_seen():
    inner = "a<details>no<summary>yes</summary></details><p hidden>no</p><img alt=pic><ol start=3><li>q<li hidden>no<li>r</ol><hr>z"
    assert html_layout.render("<div>" * 300 + inner) == "a yes pic 3. q 4. r --- z"


def test_packing_encoder_is_made_once_and_remembers_nothing():
    import numpy as np
    import pyarrow as pa

    from presstide.llm import packing

    coder = packing.encoder(packing.tokenizer_path())
    assert packing.encoder(packing.tokenizer_path()) is coder

    def sizes():
        return {k: len(v) for k, v in vars(coder).items() if hasattr(v, "__len__")}

    before = sizes()
    texts = [" ".join(f"{w}{i}" for w in ("tide", "été", "字")) + f"\nrow {i}  <|endoftext|>x" for i in range(2000)] + ["", " ", None, "\n"]
    ids, lens = coder.encode(pa.array(texts))
    assert sizes() == before
    # A run's words are encoded together; the ids are those of each text by itself.
    alone = [coder.encode(pa.array([t], pa.string())) for t in texts]
    assert np.array_equal(ids, np.concatenate([a for a, _ in alone])) and lens.tolist() == [int(n[0]) for _, n in alone]
