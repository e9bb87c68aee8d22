import gzip
import io
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from presstide.sources import crawlindex as ci
from presstide.sources import records as rc
from presstide.sources import tables as tb


def test_delimited(spark, tmp_path):
    path = str(tmp_path / "list.csv")
    open(path, "w").write('url,type,name,bias\na.test,site,"A, the ""best""",left\nb.test,,B   ,\n')
    rows = tb.read_delimited(spark, path, tb.BIAS_A_SCHEMA).collect()
    assert [tuple(r) for r in rows] == [("a.test", "site", 'A, the "best"', "left"), ("b.test", None, "B", None)]
    assert tb.read_delimited(spark, path, tb.BIAS_A_SCHEMA, columns=["bias"]).columns == ["bias"]


def test_delimited_rejects_bad_rows(spark, tmp_path):
    path = str(tmp_path / "ranks.csv")
    open(path, "w").write("rank,host\n1,a.test\nsecond,b.test\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        tb.read_ranks(spark, one=path).collect()


def test_tab_separated_padding_and_ranks(spark, tmp_path):
    iso = str(tmp_path / "iso.tab")
    header = "Id\tPart2B\tPart2T\tPart1\tScope\tLanguage_Type\tRef_Name\tComment"
    open(iso, "w").write(header + "\neng\teng\teng\ten\tI\tL\tEnglish\t\nzzj\t\t\t  \tI\tL\tZuojiang Zhuang\t\n")
    with_names = tb.ISO639_SCHEMA
    rows = spark.read.schema(with_names).option("sep", "\t").option("header", True).csv(iso).count()
    assert rows == 2
    paths = {}
    for name in ("x", "y"):
        paths[name] = str(tmp_path / f"{name}.csv")
        open(paths[name], "w").write("rank,host\n1,a.test\n")
    got = tb.read_ranks(spark, **paths).orderBy("list_name").collect()
    assert [tuple(r) for r in got] == [(1, "a.test", "x"), (1, "a.test", "y")]


def test_json_and_catalogue(spark, tmp_path):
    docs = str(tmp_path / "docs.jsonl")
    open(docs, "w").write('{"url":"a","timestamp.published":{"best":{"value":{"lo":"2020"}}}}\n{"url":null}\n')
    df = tb.read_json_docs(spark, docs)
    got = df.select(F.try_variant_get("doc", "$['timestamp.published'].best.value.lo", "string").alias("lo")).collect()
    assert [r.lo for r in got] == ["2020", None]
    cat = str(tmp_path / "collinfo.json")
    open(cat, "w").write('[\n {"id": "C-2", "name": "two"},\n {"id": "C-1"}\n]')
    assert [r.id for r in tb.read_catalogue(spark, cat).collect()] == ["C-2", "C-1"]


# Crawl index -----------------------------------------------------------------

def expected_outcomes(files):
    """files: newest first, lists of (id, url, mime, status).

    By the definition: the usable rows of a page, newest file first and in file order,
    are one kept row, then repeats, told apart by whether they are in the kept row's file.
    """
    usable = {i for rows in files for i, _, mime, status in rows if (mime, status) == ("text/html", "200")}
    out = {i: "status" if mime == "text/html" else "mime" for rows in files for i, _, mime, _ in rows if i not in usable}
    pages = {}
    for place, rows in enumerate(files):
        for i, url, _, _ in rows:
            if i in usable:
                pages.setdefault(re.sub(r"^\w+://|\?.*$", "", url), []).append((place, i))
    for group in pages.values():
        in_file = [p for p, _ in group]
        out |= {i: "kept" if n == 0 else "dup_cdx" if p in in_file[:n] and p == in_file[0] else "dup_all" for n, (p, i) in enumerate(group)}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_index_files_and_outcomes(spark, tmp_path, seed):
    rng = random.Random(seed)
    files, i = {}, 0
    for crawl in ("C-2020-05", "C-2021-10", "C-2021-43"):
        rows = []
        for _ in range(80):
            url = f"https://a.test/p{rng.randint(0, 25)}" + rng.choice(["", "?x=1"])
            rows.append((i, url, rng.choice(["text/html"] * 5 + ["image/png", None]), rng.choice(["200"] * 5 + ["301", None])))
            i += 1
        files[crawl] = rows
        folder = tmp_path / "test,a"
        folder.mkdir(exist_ok=True)
        with gzip.open(folder / f"test,a-{crawl}.cdx.gz", "wt") as f:
            for n, url, mime, status in rows:
                extra = "".join(f', "{k}": "{v}"' for k, v in (("mime", mime), ("status", status)) if v)
                f.write(f'test,a)/k 20200101 {{"url": "{url}", "filename": "f", "offset": "{n}", "length": "5"{extra}}}\n')
    index = ci.read_crawl_index(spark, str(tmp_path), partitions=3)
    labelled = ci.label_outcomes(index).collect()
    expected = expected_outcomes([files[c] for c in sorted(files, reverse=True)])
    assert {r.offset: r.outcome for r in labelled} == expected
    assert {r.site for r in labelled} == {"test,a"} and {r.crawl for r in labelled} == set(files)
    counts = {r.outcome: r.n for r in ci.outcome_counts(index).collect()}
    assert counts == {k: list(expected.values()).count(k) for k in set(expected.values())}
    assert {r.offset for r in ci.dedup_index(index).collect()} == {k for k, v in expected.items() if v == "kept"}
    one = ci.read_crawl_index(spark, str(tmp_path), "test,a", "C-2020-05")
    assert {r.crawl for r in one.select("crawl").distinct().collect()} == {"C-2020-05"} and one.count() == 80


@pytest.mark.parametrize("prefix,expected", [
    ("com,b", [1, 2]), ("com,c)/5", [3]), ("com,a", [0]), ("aaa", []), ("zzz", [4]), ("com,", [0, 1, 2, 3, 4]), ("com,d)", [4]),
])
def test_select_blocks(spark, prefix, expected):
    starts = ["com,a)/1", "com,a)/9", "com,b)/4", "com,c)/1", "com,d)/2"]
    lines = [(f"{s} 2020\tf{i}.gz\t{i * 10}\t10\t{i}", "C") for i, s in enumerate(starts)]
    lines = [(v.replace(" 2020", "\t2020"), c) for v, c in lines]
    blocks = ci.parse_block_lines(spark.createDataFrame(lines, "value string, crawl string"))
    got = sorted(int(r.offset) // 10 for r in ci.select_blocks(blocks, prefix).collect())
    # Complete: every block that could hold a key with the prefix is there.
    assert set(expected) <= set(got) and len(got) <= len(expected) + 1


def test_block_slices(spark, tmp_path):
    keys = [f"com,{h})/{n}" for h in "abc" for n in range(4)]
    data, blocks = b"", []
    for at in range(0, len(keys), 3):
        packed = gzip.compress("".join(f"{k} 2020 {{}}\n" for k in keys[at : at + 3]).encode())
        blocks.append((keys[at], "t", "cdx.gz", len(data), len(packed), "C-1"))
        data += packed
    (tmp_path / "cdx.gz").write_bytes(data)
    table = spark.createDataFrame(blocks, "surt string, time string, file string, offset long, length long, crawl string").drop("time")
    got = rc.read_blocks(ci.select_blocks(table, "com,b)"), "com,b)", str(tmp_path)).collect()
    assert sorted(r.value.split()[0] for r in got) == [k for k in keys if k.startswith("com,b)")]
    assert {r.crawl for r in got} == {"C-1"}


def test_worker_labels_cover_and_repeat(spark):
    df = spark.range(1000).select("id", ci.worker_label(4, "id").alias("w"))
    assert {r.w for r in df.collect()} == {0, 1, 2, 3}
    assert df.collect() == df.repartition(7).orderBy("id").collect()


# Records ---------------------------------------------------------------------

def warc(kind="response", status="200 OK", mime="text/html", url="https://a.test/", body="<p>hi</p>"):
    head = f"HTTP/1.1 {status}\r\n" + (f"Content-Type: {mime}\r\n" if mime is not None else "")
    payload = (head + "\r\n" + body).encode()
    meta = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nContent-Length: {len(payload)}\r\n\r\n"
    return meta.encode() + payload + b"\r\n\r\n"


@pytest.fixture()
def archive(tmp_path):
    plain = [
        warc(url="https://a.test/1"), warc("request", url="https://a.test/2"), warc(status="404 Not Found", url="https://a.test/3"),
        warc(mime="image/png", url="https://a.test/4"), warc(mime="", url="https://a.test/5"), warc(mime=None, url="https://a.test/6"),
        warc(url="https://a.test/7", body="x" * 3_000_000), b"garbage that is not a record",
    ]
    packed = [gzip.compress(p) for p in plain]
    broken = packed[0][: len(packed[0]) // 2] + b"\x00" * 20
    members = packed[:3] + [broken] + packed[3:]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    return str(path), members


def test_whole_archive(spark, archive):
    path, members = archive
    rows = rc.read_archives(spark, path)
    pages = rows.filter(rc.is_page()).collect()
    assert sorted(r.url[-1] for r in pages) == ["1", "5", "6", "7"]
    assert {len(r.html) for r in pages if r.url.endswith("7")} == {3_000_000}
    assert {r.accessed_at for r in pages} == {"2020-01-02T03:04:05Z"}
    errors = [r.error for r in rows.filter("error IS NOT NULL").collect()]
    assert any("gzip" in e for e in errors) and any("not a record" in e for e in errors)


def test_byte_ranges(spark, archive, tmp_path):
    _, members = archive
    starts = [sum(len(m) for m in members[:i]) for i in range(len(members))]
    wanted = [7, 0, 6]
    index = spark.createDataFrame([("a.warc.gz", starts[i], len(members[i])) for i in wanted], "filename string, offset long, length long")
    plan = ci.fetch_plan(index)
    assert {(r.range_start, r.range_end) for r in plan.collect()} == {(starts[i], starts[i] + len(members[i]) - 1) for i in wanted}
    got = rc.fetch_records(plan, str(tmp_path)).collect()
    assert {r.position for r in got} == {starts[i] for i in wanted} and all(r.error is None for r in got)


def test_older_archive_dialect(spark):
    body = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>old</p>"
    record = f"https://a.test/old 1.2.3.4 20090102030405 text/html {len(body)}\n{body}\n"
    df = spark.createDataFrame([("s", bytearray(gzip.compress(record.encode())))], "s string, m binary")
    r = rc.decode_members(df, "s", "m").filter(rc.is_page()).first()
    assert (r.url, r.accessed_at, r.html) == ("https://a.test/old", "2009-01-02T03:04:05Z", "<p>old</p>")


def test_members_across_read_chunks(monkeypatch):
    data = b"".join(gzip.compress(os.urandom(50) * n) for n in range(1, 40))
    monkeypatch.setattr(rc, "CHUNK", 7)
    parts = list(rc._members(io.BytesIO(data)))
    assert len(parts) == 39 and all(e is None for _, _, e in parts)
    assert all(data[o : o + 2] == b"\x1f\x8b" for o, _, _ in parts)


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_cut_members_hide_no_neighbour(monkeypatch, chunk):
    monkeypatch.setattr(rc, "CHUNK", chunk)
    good = [gzip.compress(os.urandom(40) * (n + 1)) for n in range(4)]
    for cut in range(1, len(good[1])):
        data = good[0] + good[1][:cut] + good[2] + good[3]
        found = {o for o, d, e in rc._members(io.BytesIO(data)) if e is None}
        start = len(good[0]) + cut
        assert {0, start, start + len(good[2])} <= found


def test_damaged_block_gives_a_row(spark, tmp_path):
    (tmp_path / "cdx.gz").write_bytes(b"\x1f\x8b\x08 this is no block")
    table = spark.createDataFrame([("cdx.gz", 0, 20)], "file string, offset long, length long")
    got = rc.read_blocks(table, "com,b)", str(tmp_path)).collect()
    assert [(r.value, r.error is not None) for r in got] == [(None, True)] * len(got) and got


def test_write_then_read(spark, tmp_path):
    from presstide.session import persist_table

    df = spark.createDataFrame([(i, bytearray(gzip.compress(warc(url=f"https://a.test/{i}")))) for i in range(20)], "k int, m binary")
    index = persist_table(rc.write_members(df.repartition(3), "k", "m", str(tmp_path / "out")), "index")
    got = rc.fetch_records(ci.fetch_plan(index), str(tmp_path / "out")).collect()
    assert {r.url for r in got} == {f"https://a.test/{i}" for i in range(20)}


def test_pages_are_packed_a_few_at_a_time(spark, monkeypatch):
    from presstide.plans.testbed import Tables

    rows = spark.range(200).selectExpr(
        "id AS page_id", "concat('http://a.test/', id) AS url", "concat('<p>', id, '</p>') AS html",
        "'view' AS event_type", "TIMESTAMP '2020-01-01 00:00:00' AS ts",
    )
    members = Tables(spark, "none")._packed(rows.coalesce(1))
    assert "MapInArrow" in members._jdf.queryExecution().executedPlan().toString()
    got = rc.decode_members(members, "page_id", "member").collect()
    assert sorted((r.url, r.html) for r in got) == sorted((f"http://a.test/{i}", f"<p>{i}</p>") for i in range(200))
