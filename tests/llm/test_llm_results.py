"""Whole results against brute force, check SQL, round trips and held-out accuracy."""

import collections
import glob
import hashlib
import os
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st

import __spark_entry__ as entry
import corpus_pipeline
from check_oracle import normal
from presstide.llm import html_layout, iblt, minhash_dedup, mixing, onebit_search, packing, secret_scan

WORD = re.compile("[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def run(spark, small):
    return lambda name: entry.queries()[name](spark, small).toPandas()


@pytest.fixture(scope="module")
def docs(small):
    return pq.read_table(f"{small}/documents.parquet").to_pandas().sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("name", ["op4_rotate_chats", "op5_mix_sources"])
def test_check_sql(run, small, name):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(small, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = normal(run(name)), normal(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def reshared(sizes, share=1.5, weights=(5, 2, 1)):
    """Targets by handing on the excess until none is above its cap."""
    total, w = int(share * sum(sizes)), [weights[i % len(weights)] for i in range(len(sizes))]
    capped = set()
    while True:
        left = total - sum(2 * sizes[i] for i in capped)
        rest = sum(w[i] for i in range(len(sizes)) if i not in capped)
        want = [2 * s if i in capped else left * w[i] / rest for i, s in enumerate(sizes)]
        over = {i for i in range(len(sizes)) if i not in capped and want[i] > 2 * sizes[i]}
        if not over:
            return want
        capped |= over


@pytest.mark.parametrize("sizes", [[10], [0, 7], [100, 100, 100], [3000, 10, 10, 10, 500], [1, 1000, 1, 1000, 2, 30], list(range(1, 40))])
def test_targets(spark, sizes):
    names = sorted(f"s{i:02d}" for i in range(len(sizes)))
    rows = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")).orderBy("source").collect()
    assert [r.target for r in rows] == pytest.approx(reshared(sizes))


def test_mix_meets_its_targets(run):
    rows = run("op5_mix_sources")
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), most=("size", "max"))
    assert (by.target <= 2 * by["size"]).all() and (by.target >= 0).all()
    assert ((by.taken - by.target).abs() <= by.most.max()).all()
    assert by.taken.sum() == int(1.5 * by["size"].sum()) and by.target.tolist() == pytest.approx([t for _, t in sorted(zip(sorted(by.index), reshared(by.sort_index()["size"].tolist())))])


def test_quality_is_learned(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    rows = entry.queries()["op1_quality"](spark, folder).toPandas().merge(pq.read_table(f"{folder}/labels.parquet").to_pandas(), on="doc_id")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.itertuples())
    held = rows[rows.held_out]
    assert (held.predicted == held.quality).mean() > 0.9  # some 80 rows
    assert ((held.score >= 0.3).astype(int) == held.predicted).all()


def test_packed_ids(run, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    rows = run("op3_pack")
    ids = {d: np.array(model.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for d, t in zip(docs.doc_id, docs.text)}
    for d, pieces in rows.sort_values("start").groupby("doc_id"):
        assert pieces.length.sum() == len(ids[d]) == pieces.doc_tokens.iloc[0]
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
    used = rows.groupby("sequence_id").length.sum()
    assert set(rows.doc_id) == set(docs.doc_id) and used.max() <= 1024
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used)
    assert padding < 0.02 * used.sum()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab c'\n\t\r.d7é \U0001f600<|", max_size=40), max_size=5))
def test_encoder_equals_its_library(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _pair
    if "_pair" not in globals():
        path = public_tokenizers.path("byte_bpe_50k.json")
        _pair = packing.Encoder(path), Tokenizer.from_file(path)
    ids, lens = _pair[0].encode(pa.array(texts, pa.string()))
    want = [[*_pair[1].encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and lens.tolist() == [len(w) for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "a", "b c", " ", "\n", "\t", "é."]), max_size=12).map("".join), max_size=4))
def test_added_tokens_have_their_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _added
    if "_added" not in globals():
        path = public_tokenizers.path("byte_bpe_50k.json")
        _added = packing.Encoder(path), Tokenizer.from_file(path)
    texts = ["a<|endoftext|> b c", *texts]
    ids, lens = _added[0].encode(pa.array(texts, pa.string()))
    want = [[*_added[1].encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and lens.tolist() == [len(w) for w in want]
    assert 50256 in ids and len(_added[0].ends) > ids.max()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 6)), min_size=1, max_size=11))
def test_layout_is_optimal(steps):
    window, charge = 16, 2.0
    pos = np.cumsum([0, *(s for s, _ in steps)]).tolist()
    penalty = [0.0, *(float(p) for _, p in steps)]

    def cost(cuts):
        total = 0.0
        for a, b in zip(cuts, cuts[1:]):
            n = pos[b] - pos[a]
            if n > window:
                return float("inf")
            total += (0 if n & (n - 1) == 0 else window - n) + penalty[b] + charge
        return total

    inner = range(1, len(pos) - 1)
    every = ([0, *(i for i in inner if mask >> (i - 1) & 1), len(pos) - 1] for mask in range(1 << len(inner)))
    assert cost(packing.lay_out(pos, penalty, window, charge)) == min(map(cost, every))


def test_secrets_base(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    docs = pq.read_table(f"{folder}/documents.parquet").to_pandas()
    rows = entry.queries()["op6_secrets"](spark, folder).toPandas().set_index("doc_id")
    found = 0
    for d, t in zip(docs.doc_id, docs.text):
        spans = []
        for order, (kind, pattern, group, least) in enumerate((
            ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
        )):
            spans += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "") if len(m[group]) >= least]
        base = [s[2] for s in sorted(spans)]
        found += len(base)
        assert rows.loc[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in rows.loc[d].spans.split(",") if s and not s.startswith("literal")] == base
    assert found


@pytest.mark.parametrize("text,names", [
    ('k = "hunter2abcXYZ99"\npassword = k', ["password"]), ('a = "AKIA"+"ABCDEFGHIJKLMNOP12"\nclientSecret = a', ["clientSecret"] * 2),
    ('{"api_key": "Zx81kk29aQ"}', ["api_key"]), ('if token == "abc123XYZ9": pass', []), ('password = "aaaaaaaa"', []), ('greeting = "hunter2abcXYZ99"', []),
    ('k = "hunter2abcXYZ99"\nk = other\npassword = k', []), ('# password = "hunter2abcXYZ99"', []), ('passwords_seen = 3', []),
])
def test_assignments(text, names):
    assert [n for *_, n, _ in secret_scan.literals(text)] == names


@pytest.mark.parametrize("text,found", [
    ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG", ["wJalrXUtnFEMI/K7MDENG"]), ("export DB_PWD=xK9fQ2mL7pR4", ["xK9fQ2mL7pR4"]),
    ("db.pwd: aB+c/d9=.-_Q==\nport: 80", ["aB+c/d9=.-_Q=="]), ("pwd=\nDB_PWD = p@ss!W0rd#9\n", ["p@ss!W0rd#9"]), ("{db_pwd: Zx81kk29aQ7, n: 1}", ["Zx81kk29aQ7"]),
    ("k = Zx81kk29aQ7\ndb_pwd = k;", ["Zx81kk29aQ7"]), ('x = db_pwd = "Zx81kk29aQ7"', ["Zx81kk29aQ7"]), ('f(x=1)(db_pwd="Zx81kk29aQ7")', ["Zx81kk29aQ7"]),
    ("u=http://h/?a=b&db_pwd=Zx81kk29aQ7", ["Zx81kk29aQ7"]), ("pwd = read_it(a, b)", []), ("pwd = ${FROM_OUTSIDE}", []), ("std::string pwd", []),
    ('k="Zx81kk"\npwd=k+"29aQ7"', ["Zx81kk", "29aQ7"]),
])
def test_unquoted_values(text, found):
    assert [text[a:b] for a, b, *_ in secret_scan.literals(text)] == found


@pytest.mark.parametrize("text,found", [
    ('see http://a.b and db_pwd = "Zx81kk29aQ7"', ["Zx81kk29aQ7"]), ("it's db_pwd = \"Zx81kk29aQ7\" and it's", ["Zx81kk29aQ7"]),
    ('# Notes # db_pwd = "Zx81kk29aQ7"', ["Zx81kk29aQ7"]), ("x = 1  // db_pwd=Zx81kk29aQ7 ## pwd2=yZ81kk29aQ7\nn = 2", ["Zx81kk29aQ7", "yZ81kk29aQ7"]),
    ('k = "Zx81kk29aQ7"\n# k = none\ndb_pwd = k', ["Zx81kk29aQ7"]), ('k = "Zx81kk29aQ7"\n# db_pwd = k', ["Zx81kk29aQ7"]), ('db_pwd = # why\n "Zx81kk29aQ7"', ["Zx81kk29aQ7"]),
    ('db_pwd = b"Zx81kk29aQ7"', ["Zx81kk29aQ7"]), ("'tis so: db_pwd = 'Zx81kk29aQ7', don't", ["Zx81kk29aQ7"]), ("# " * 200 + "db_pwd=Zx81kk29aQ7", ["Zx81kk29aQ7"]),
])
def test_comments_and_apostrophes(text, found):
    assert [text[a:b] for kind, a, b, *_ in secret_scan.scan_text(text, frozenset(), True) if kind == "literal"] == found


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(sorted(secret_scan.SENSITIVE)), st.integers(0, 9), st.sampled_from([*"._-$ é(", "", "--", "._"]), st.booleans(), st.text(alphabet="ab_.X9", max_size=5))
def test_filter_passes_every_sensitive_name(key, at, between, camel, rest):
    name = rest + key[:at] + between + (key[at:].capitalize() if camel else key[at:]) + rest
    if secret_scan.sensitivity(name):
        assert pc.match_substring_regex(pa.array([name]), secret_scan._NAMES)[0].as_py()


@pytest.mark.parametrize("line", ['aws.access.key = "Zx81kk29aQ7"', 'private.key: "Zx81kk29aQ7"', 'api.key = "Zx81kk29aQ7"', 'pass_word = "Zx81kk29aQ7"'])
def test_names_in_parts_are_scanned(line):
    assert [[line[a:b] for _, a, b, *_ in spans] for spans in secret_scan._scan(pa.array([line]))] == [["Zx81kk29aQ7"]]


def test_long_runs_are_read_once():
    for text in ("token=" * 50_000, "pwd=" + "a=" * 50_000, "x=f(" * 50_000, "pwd:" + "Ab1/" * 50_000, "a=b;pwd=" * 30_000, "# " * 100_000, "pwd = // " * 30_000, "' " * 100_000):
        start = time.perf_counter()
        secret_scan.literals(text, comments=True)
        assert time.perf_counter() - start < 10


def test_nearest(run, small):
    table = pq.read_table(f"{small}/embeddings.parquet").to_pandas()
    x, ids = np.array(table.embedding.tolist(), np.float64), table.vec_id.to_numpy()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows, hits, total = run("op7_nearest"), 0, 0
    for i in np.flatnonzero(ids % 50 == 0):
        score = np.where(ids == ids[i], -9, unit @ unit[i])
        want = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        mine = rows[rows.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and mine.score.is_monotonic_decreasing
        assert np.allclose(mine.score, [score[ids == v][0] for v in mine.vec_id])
        hits, total = hits + len(want & set(mine.vec_id)), total + 5
    assert hits >= 0.9 * total


def test_estimates_stay_within_bounds():
    x = onebit_search._unit(np.random.default_rng(3).normal(size=(4000, 96)))
    turn = onebit_search.rotation(96)
    codes, scalars = onebit_search.encode(x, turn)
    near, bound = onebit_search.estimate(codes, scalars, x[0], turn)
    assert (np.abs(near - x @ x[0]) > bound).mean() < 0.01 and abs((near - x @ x[0])[1:].mean()) < 0.01


def test_urls(run, small):
    pages = pq.read_table(f"{small}/pages.parquet").to_pandas().set_index("page_id")
    rules = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
    rows = run("op8_url_filter")
    for r in rows.itertuples():
        _, _, rest = pages.loc[r.page_id].url.partition("://")
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = host.translate(UPPER)
        fits = sorted((len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p))
        assert (r.host, r.path, r.rule) == (host, path, fits[-1][1] if fits else None)
        assert r.verdict == (fits[-1][2] if fits else "block" if r.block_score >= 0.5 else "allow")
    assert len(rows) == len(pages)


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(texts, percent=75):
    """id -> least reachable id, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    having = collections.defaultdict(list)
    for i in sorted(sets):
        common = collections.Counter(j for s in sets[i] for j in having[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in sets[i]:
            having[s].append(i)
    return {i: find(i) for i in sets}, sets


def test_near_duplicates(run, docs):
    want, sets = components(dict(zip(docs.doc_id, docs.text)))
    rows = run("op9_near_dedup")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows.itertuples()} == {i: (len(sets[i]), c, c == i) for i, c in want.items()}


def test_near_duplicates_at_the_threshold(spark, monkeypatch):
    """Chains, hot groups and pairs right at 0.75; buckets and clusters larger than a block."""
    monkeypatch.setattr(minhash_dedup, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 50)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(160):
        words = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            words[k] = f"x{rng.integers(1 << 30)}"
        texts[i] = " ".join(words)
    for i in range(160, 200):  # each a few words on from the one before
        texts[i] = " ".join(f"c{k}" for k in range((i - 160) * 3, (i - 160) * 3 + 30))
    for i in range(200, 260):
        texts[i] = texts[i - 200]
    want, _ = components(texts)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.3, 0.75, 0.95):
        both = rng.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64)
        rest = [rng.integers(0, 1 << 63, (4000 - len(both)) // 2, dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([both, r])) for r in rest]
        sig = minhash_dedup.signatures(minhash_dedup.minima(sets)).view(np.uint64)
        assert abs(minhash_dedup.similarity(sig[0], sig[1]) - share) < 0.13


def paragraphs(text):
    return set(re.findall(rf"(?a:(?:\S+[ \t]+){{0,{iblt.RUN - 1}}}\S+\s*|\s+)", text))


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_fingerprints(run, docs):
    rows = run("op10_fingerprints").set_index("doc_id")
    texts = docs.text.fillna("").tolist()
    seen = {}
    for i, (d, t) in enumerate(zip(docs.doc_id, texts)):
        after, half, r = texts[(i + 1) % len(texts)], len(t) // 2, rows.loc[d]
        edited = t[: len(t) - half] + after[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - likeness(t, edited)) < 1e-9 and abs(r.near_next - likeness(t, after)) < 1e-9
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
    assert rows.near_edited.mean() > 0.3 > rows.near_next.mean()


def test_peeling_recovers_the_difference(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i, (n, m, both) in enumerate([(0, 0, 0), (1, 0, 0), (0, 0, 50), (3, 2, 400), (40, 60, 10), (500, 300, 100)]):
        x = rng.integers(-(1 << 63), 1 << 63, n + m + both).tolist()
        rows.append((i, x[: n + both], x[n:]))
    table = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    got = table.select("i", iblt.difference(table.a, table.b).alias("d")).collect()
    for r in got:
        a, b = map(set, rows[r.i][1:])
        assert (sorted(r.d.left), sorted(r.d.right)) == (sorted(a - b), sorted(b - a))


def test_next_keys(spark):
    keys = [-(1 << 62), -700, -1, 0, 1, 255, 256, 1 << 40, (1 << 62) + 5]
    got = {r.key: r.next for r in iblt.next_keys(spark.createDataFrame([(k,) for k in keys], "key long"), 1 << 20).collect()}
    assert got == dict(zip(keys, keys[1:] + keys[:1]))


@pytest.mark.parametrize("page,text", [
    ("<p>One<p>Two<b> bold</b><br>line", "One\n\nTwo bold\nline"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>x<li>y</ol>", "9. x\n10. y"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple pie<td>1</table>", "Name       Qty\napple pie  1"),
    ("a<script>x</p></script><div hidden>no</div><span style='display: none'>no</span>b", "ab"),
    ("<pre>\n a  b\n  c</pre>", " a  b\n  c"),
    ("<title>no</title><body>&lt;x&gt; &amp &copy;", "<x> & ©"),
    ("<details><summary>s</summary>no</details><details open>yes</details>", "s\nyes"),
])
def test_layout(page, text):
    assert html_layout.render(page) == text


@pytest.mark.parametrize("page,text", [
    ("<table><tr><form><td>a</td></form></tr></table>", "a"), ("<table><tr><form><td>a<td>b</form></tr><tr><td>c<td>d</table>", "a  b\nc  d"),
    ("<table><tbody><form><tr><td>a<td>b</tr></form></tbody></table>", "a  b"), ("<table><form><td>a</td><td>b</td></form></table>", "a  b"),
    ("<table><tr><td>a</td>loose<b>Total</b></tr><tr>more</tr></table>", "a\nlooseTotal\nmore"), ("<table><tr><div hidden><td>no</td></div><td>a</table>", "a"),
    ("<table><tr><table><tr><td>in</table></tr></table>", "in"), ("<table><tr>" + "<i>" * 3000 + "<td>deep", "deep"),
    ("x<svg><title>no</title><desc>no</desc><style>no</style><path/><desc/><text>Sales</text><text>Cost</text></svg>y", "x\nSales\nCost\ny"),
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
])
def test_all_that_is_seen_is_kept(page, text):
    assert html_layout.render(page) == text


def test_pages_keep_all_words(run, small):
    pages = pq.read_table(f"{small}/pages.parquet").to_pandas().set_index("page_id").html
    import html

    for r in run("op2_html_text").itertuples():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", "", pages[r.page_id])
        assert re.sub(r"[-\s]+", "", r.text) == re.sub(r"[-\s]+", "", html.unescape(re.sub(r"<[a-zA-Z/!][^>]*(?:>|$)", "", body)))


def test_pipeline(spark, small, docs):
    """Each stage by brute force on what the stage before it kept."""
    columns, rows = docs.columns.tolist(), spark.read.parquet(f"{small}/documents.parquet")
    out = []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, small)
        out.append(rows.toPandas())
        if len(out) < 5:
            assert rows.columns == columns
            rows = spark.createDataFrame(out[-1], rows.schema)
    good, single, clean, mix, pieces = out
    labels = pq.read_table(f"{small}/labels.parquet").to_pandas().set_index("doc_id").quality
    kept = set(good.doc_id)
    assert np.mean([(d in kept) == q for d, q in labels.items()]) > 0.95
    want, _ = components(dict(zip(good.doc_id, good.text)))
    assert sorted(single.doc_id) == sorted(set(want.values()))
    before, after = single.set_index("doc_id").text, clean.set_index("doc_id").text
    kinds = frozenset(secret_scan._FILTER)
    assert set(before.index) == set(after.index)
    for d, t in before.items():
        spans = secret_scan.scan_text(t, kinds, True)
        assert after[d] == secret_scan.replaced(t, spans, "<secret>")
    words = lambda texts: sum(len(WORD.findall(t)) for t in texts)
    assert words(mix.text) == int(1.5 * words(clean.text))
    assert mix.groupby("doc_id").size().max() <= 2
    cut = [t for t in mix.text if t not in set(clean.text)]
    assert len(cut) <= 1
    copies = collections.Counter(mix.doc_id)
    assert pieces[pieces.start == 0].groupby("doc_id").size().to_dict() == dict(copies)
    assert pieces.groupby("sequence_id").length.sum().max() <= 1024
