import random

import pytest
from pyspark.sql import functions as F

from presstide.functions import text as tx

VECTOR = "array<struct<pos:int,lexeme:string>>"


def brute_ngrams(vector, max_n, min_n=1):
    vector, out = sorted(vector), []
    for i, (pos, _) in enumerate(vector):
        for size in range(1, max_n + 1):
            if i - size + 1 < 0 or any(vector[i - k][0] != pos - k for k in range(size)):
                break
            if size >= min_n:
                out.append(" ".join(v[1] for v in vector[i - size + 1 : i + 1]))
    return out


@pytest.mark.parametrize("max_n,min_n", [(1, 1), (2, 1), (3, 1), (3, 2), (5, 1)])
def test_ngrams_against_brute_force(spark, max_n, min_n):
    rng = random.Random(max_n * 10 + min_n)
    vectors = [[], [(7, "solo")]]
    for _ in range(60):
        positions = sorted(rng.sample(range(1, 30), rng.randint(1, 20)))
        vectors.append([(p, rng.choice("abc")) for p in positions])
    df = spark.createDataFrame(list(enumerate(vectors)), f"i int, v {VECTOR}")
    got = df.select(
        "i", tx.ngrams("v", max_n, min_n, unique=False).alias("g"), tx.ngrams("v", max_n, min_n).alias("u")
    ).collect()
    for r in got:
        expected = brute_ngrams(vectors[r.i], max_n, min_n)
        assert r.g == expected
        assert r.u == list(dict.fromkeys(expected))


@pytest.mark.parametrize("max_n", [1, 2, 3, 5])
def test_exploded_ngrams_are_the_distinct_ones(spark, max_n):
    rng = random.Random(max_n)
    vectors = [None, [], [(7, "solo")], [(1, "a"), (2, "a"), (3, "a"), (4, "a")]]
    for _ in range(80):
        positions = sorted(rng.sample(range(1, 40), rng.randint(1, 30)))
        vectors.append([(p, rng.choice("abcé")) for p in positions])
    df = spark.createDataFrame(list(enumerate(vectors)), f"i int, v {VECTOR}").coalesce(2)
    rows = tx.explode_ngrams(df, "v", "g", max_n)
    assert rows.columns == ["i", "g"]
    got = sorted(tuple(r) for r in rows.collect())
    assert got == sorted((i, g) for i, v in enumerate(vectors) if v for g in set(brute_ngrams(v, max_n)))


def test_vector_text(spark):
    text = "'bake':4 'crisp':8 'ever':14 'rich':1,9 'tart':3A,10,18"
    df = spark.createDataFrame([(text,), ("",)], "t string").withColumn("v", tx.parse_vector("t"))
    got = df.select("v", tx.vector_text("v").alias("x")).collect()
    assert got[0].x == "rich:1 bake:4 crisp:8 rich:9 tart:10 ever:14 tart:18"
    assert got[1].v == []


def test_gap_breaks_an_ngram(spark):
    df = spark.createDataFrame([("storm:1 in:2 town:3   38:5 north:6",)], "t string").withColumn("v", tx.parse_vector("t"))
    grams = df.select(tx.ngrams("v", 3, 2, unique=False).alias("g")).first().g
    assert grams == ["storm in", "in town", "storm in town", "38 north"]


def test_words_drop_marks_and_keep_lines_apart(spark):
    df = spark.createDataFrame([("Ünder-dog's\nDAY…\t50% €5 ​end now",), (None,)], "t string")
    got = df.select(tx.raw_words("t").alias("w")).collect()
    assert got[0].w == ["ünderdogs", "day", "50", "5", "end", "now"]
    assert got[1].w is None


def test_stops_keep_positions_and_fall_back(spark):
    rows = [("en", "the cat of the house"), ("pt", "the cat xx"), (None, "a"), ("en", None)]
    df = spark.createDataFrame(rows, "lang string, t string")
    out = tx.with_tokens(df, "t", "lang", stops={"en": ["the", "of"], "xx": ["xx"]})
    got = [r.v for r in out.select(tx.vector_text("tokens").alias("v")).collect()]
    assert got == ["cat:2 house:5", "the:1 cat:2", None, None]


def test_many_stops(spark):
    df = spark.createDataFrame([("en", "a 7 b 20500")], "lang string, t string")
    out = tx.with_tokens(df, "t", "lang", stops={"en": [str(i) for i in range(21_000)]})
    assert out.select(tx.vector_text("tokens")).first()[0] == "a:1 b:3"


def test_lemmas_keep_rows_and_columns(spark):
    rows = [(1, "en", "cats were running", "x"), (2, "pt", "cats be", "y"), (3, "en", "", "z"), (4, "en", None, "w")]
    df = tx.with_tokens(spark.createDataFrame(rows, "id int, lang string, t string, other string"), "t", "lang", stops={})
    lemmas = spark.createDataFrame(
        [("en", "cats", "cat"), ("en", "were", "be"), ("xx", "cats", "katz"), ("en", "running", ""), ("en", "cats", "cat")],
        "lang string, form string, lemma string",
    )
    out = tx.with_lemmas(df, "id", "tokens", "lang", lemmas)
    got = {r.id: (r.v, r.other, r.t) for r in out.select("id", tx.vector_text("tokens").alias("v"), "other", "t").collect()}
    assert got == {
        1: ("cat:1 be:2", "x", "cats were running"), 2: ("katz:1 be:2", "y", "cats be"), 3: ("", "z", ""), 4: (None, "w", None),
    }


def test_concat_shifts_positions(spark):
    df = spark.createDataFrame([([(2, "a")], [(1, "b"), (3, "c")]), ([], [(1, "b")]), (None, [(1, "b")])], f"x {VECTOR}, y {VECTOR}")
    got = [r.v for r in df.select(tx.vector_text(tx.concat_tokens("x", "y")).alias("v")).collect()]
    assert got == ["a:2 b:3 c:5", "b:1", None]


NAUGHTY = [
    "undefined", "null", "NaN", "1/0", "0x0", "\\", "' OR 1=1 --", "<script>alert(0)</script>", "${jndi:x}", "%s%n", "../../etc",
    "  ", "ﷺ", "𝕿𝖍𝖊", "ﾟ･✿ヾ╲(｡◕‿◕｡)╱✿･ﾟ", "🏳️‍🌈", "الكل", "이것은", "﻿", "é", "a\x00b", '"', "site:", "& | !", " ",
]


def test_no_text_fails(spark):
    from presstide.operators import search as se

    df = spark.createDataFrame([(i, s, "en") for i, s in enumerate(NAUGHTY)], "id int, t string, lang string")
    tokens = tx.with_tokens(df, "t", "lang")
    assert tokens.select(tx.ngrams("tokens").alias("g"), tx.query_text("tokens").alias("q")).count() == len(NAUGHTY)
    tokens.select(tx.ngrams("tokens").alias("g"), tx.query_text("tokens").alias("q")).collect()
    se.parse_queries(df.select("id", F.col("t").alias("query"))).collect()
