"""What the registered queries move, on tables of a few rows."""

import pytest
from pyspark.sql import functions as F

from presstide.plans import catalogue
from presstide.plans.testbed import Tables


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("given"))
    docs = [(i, f"Title {i % 3}. more\nWhat it is {i}. rain rain fog", ["en", "de", None][i % 3], f"src{i % 2}", 30 + i % 4) for i in range(12)]
    docs.append((12, None, "en", None, 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, f"1998-{i % 12 + 1:02d}-02") for i in range(13)], "o_orderkey long, day string").select(
        "o_orderkey", F.col("day").cast("date").alias("o_orderdate")
    ).write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(i, f"https://www.h{i % 2}.test/p{i}?q=1") for i in range(0, 12, 2)], "page_id long, url string").write.parquet(f"{path}/pages.parquet")
    return path


def above(df, node: str) -> str:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan[: plan.index(node)]


def test_joins_of_articles_do_not_move_texts_for_their_titles(spark, given):
    arts = Tables(spark, given).articles()
    titled = arts.select("id", "title", "description")
    assert "regexp_extract" not in above(titled, "Join") and "text#" not in above(titled, "Join")
    got = {r.id: (r.title, r.description) for r in titled.collect()}
    assert got[4] == ("Title 1", "What it is 4") and got[12] == (None, None) and len(got) == 13


@pytest.mark.parametrize("name,keys", [("agg27_lexeme_host_month", ["alltext", "host", "timestamp_published"]), ("agg28_lexeme_month", ["alltext", "timestamp_published"])])
def test_keys_of_an_article_are_worked_out_before_its_lexemes_are_rows(spark, given, name, keys):
    df = catalogue.QUERIES[name](spark, given)
    assert df.columns == [*keys, "url", "hostpathquery", "hostpath"]
    assert "regexp" not in above(df, "Generate") and "split" not in above(df, "Generate")
    rain = df.filter("alltext = 'rain'").agg(F.sum("url")).first()[0]
    # Ids 0 to 11, of which those without a language have no words; urls of the odd ones repeat at most within a source.
    assert rain == sum(1 for i in range(12) if i % 3 != 2)
