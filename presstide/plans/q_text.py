"""Tokens, n-grams, text rollups, trends and search over the article view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import text as tx
from ..functions import urlkeys as uk
from ..operators import captures as cp
from ..operators import requests as rq
from ..operators import rollups as ru
from ..operators import search as se
from ..operators import textrollups as tr
from ..operators import textstore as ts
from ..operators import trends as td
from ..session import persist_table, scratch_dir
from . import duck as d
from .q_keys import ARTICLE_BODY
from .registry import query
from .testbed import Tables, alltext_vectors

LO, HI = "1995-01-01", "2002-01-01"
TERMS = ["er", "anea eriner"]
ONE_TERM = ["ha"]


# Tokens and n-grams ----------------------------------------------------------

@query(
    "txt01_tokens",
    f"SELECT id, pos, lexeme FROM ({d.tokens('SELECT * FROM documents', 'text', 'doc_id', 'lang')})",
)
def txt01(t: Tables):
    rows = tx.with_tokens(t.read("documents").select("doc_id", "text", "lang").hint("rebalance"), "text", "lang")
    rows = tx.explode_tokens(rows, "tokens", F.col("doc_id").alias("id"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


# A lemma table out of the data: a plural-like form stands for its stem.
_LEMMAS = "SELECT DISTINCT language AS lang, lexeme AS form, left(lexeme, length(lexeme) - 1) AS lemma FROM tt WHERE lexeme LIKE '___%s'"


@query(
    "txt01_lemmas",
    f"""WITH arts AS MATERIALIZED ({d.ARTICLES}), tt AS MATERIALIZED ({d.tokens('SELECT * FROM arts', 'content')}),
      lem AS ({_LEMMAS})
      SELECT t.id, string_agg(coalesce(l.lemma, t.lexeme) || ':' || t.pos, ' ' ORDER BY t.pos) AS vector
      FROM tt t LEFT JOIN lem l ON l.lang = t.language AND l.form = t.lexeme GROUP BY t.id""",
)
def txt01_lemmas(t: Tables):
    texts = t.articles().select("id", "language", "content").hint("rebalance")
    # Stored, since both the forms and the vectors are made of the tokens.
    texts = persist_table(tx.with_tokens(texts, "content", "language").drop("content"), "tokens")
    forms = texts.select(F.col("language").alias("lang"), F.explode(tx.lexemes("tokens")).alias("form")).distinct()
    lemmas = forms.filter(F.col("form").like("___%s")).withColumn("lemma", F.expr("left(form, length(form) - 1)"))
    out = tx.with_lemmas(texts, "id", "tokens", "language", lemmas)
    return out.filter(F.size("tokens") > 0).select("id", tx.vector_text("tokens").alias("vector"))


@query(
    "txt02_query_lemmas",
    f"SELECT id, string_agg(lexeme, ' & ' ORDER BY pos) AS q FROM ({d.tokens('SELECT * FROM (' + d.ARTICLES + ')', 'title')}) GROUP BY id",
)
def txt02(t: Tables):
    """Titles as queries: words joined by ``&``."""
    rows = tx.with_tokens(t.articles(), "title", "language")
    return rows.filter(F.size("tokens") > 0).select("id", tx.query_text("tokens").alias("q"))


@query(
    "txt03_extra_stop_words",
    f"SELECT conv_id, turn, CAST(len(list_filter({d.words('text')}, lambda x: x NOT IN ('de', 'le', 'la'))) AS BIGINT) AS n FROM conversations",
)
def txt03(t: Tables):
    """Words added to one language's list."""
    rows = t.read("conversations").withColumn("lang", F.lit("xx"))
    return tx.with_tokens(rows, "text", "lang", stops={"xx": ["de", "le", "la"]}).select(
        "conv_id", "turn", F.size("tokens").cast("bigint").alias("n")
    )


@query(
    "txt04_fallback_language",
    f"SELECT doc_id, CAST(len(list_filter({d.words('text')}, lambda x: NOT (lang = 'en' AND x IN ('the', 'of')) AND NOT (lang <> 'en' AND x = 'de'))) AS BIGINT) AS n FROM documents",
)
def txt04(t: Tables):
    """Languages without a list of their own use the multilingual one."""
    rows = tx.with_tokens(t.read("documents"), "text", "lang", stops={"en": ["the", "of"], "xx": ["de"]})
    return rows.select("doc_id", F.size("tokens").cast("bigint").alias("n"))


@query(
    "txt05_unparsed_rows_kept",
    f"SELECT doc_id, CASE WHEN lang <> 'fr' THEN CAST(len({d.words('text')}) AS BIGINT) ELSE -1 END AS n FROM documents",
)
def txt05(t: Tables):
    """Texts of one language cannot be read; their rows stay, without a vector."""
    rows = t.read("documents").withColumn("body", F.when(F.col("lang") != "fr", F.col("text")))
    rows = tx.with_tokens(rows, "body", "lang", stops={})
    return rows.select("doc_id", F.when(F.col("tokens").isNull(), -1).otherwise(F.size("tokens")).cast("bigint").alias("n"))


@query(
    "txt06_ngrams",
    d.TEXT_CTES + " SELECT a.id, count(term) AS n, coalesce(sum(length(term)), 0)::BIGINT AS chars FROM arts a LEFT JOIN grams g ON g.id = a.id GROUP BY a.id",
)
def txt06(t: Tables):
    """N-grams per document, counted inside the row."""
    rows = t.alltext().select("id", tx.ngrams("tokens").alias("grams"))
    chars = F.aggregate("grams", F.lit(0).cast("bigint"), lambda total, g: total + F.length(g))
    return rows.select("id", F.size("grams").cast("bigint").alias("n"), chars.alias("chars"))


@query(
    "txt07_ngrams_from_two",
    d.TEXT_CTES + """ SELECT x.id, count(g.id) AS n FROM arts x LEFT JOIN (
      SELECT a.id FROM tc a JOIN tc b ON a.id = b.id AND b.pos = a.pos + 1
      UNION ALL SELECT a.id FROM tc a JOIN tc b ON a.id = b.id AND b.pos = a.pos + 1
        JOIN tc c ON a.id = c.id AND c.pos = a.pos + 2) g ON g.id = x.id GROUP BY x.id""",
)
def txt07(t: Tables):
    """Bigrams and longer, repeats kept, from the text form of the vectors."""
    rows = t.tokenised().select("id", tx.vector_text("tsv_content").alias("lemmas"))
    rows = rows.withColumn("tokens", tx.parse_vector("lemmas"))
    return rows.select("id", F.size(tx.ngrams("tokens", 3, 2, unique=False)).cast("bigint").alias("n"))


@query("txt08_concat_vectors", d.TEXT_CTES + " SELECT a.id, coalesce(max(pos), 0) AS last, count(pos) AS n FROM arts a LEFT JOIN tok t ON t.id = a.id GROUP BY a.id")
def txt08(t: Tables):
    last = F.array_max(F.transform("tokens", lambda x: x["pos"]))
    return t.alltext().select(
        "id",
        F.coalesce(last, F.lit(0)).cast("bigint").alias("last"),
        F.size("tokens").cast("bigint").alias("n"),
    )


@query("txt09_lexemes", d.TEXT_CTES + " SELECT a.id, count(DISTINCT lexeme) AS n FROM arts a LEFT JOIN tok t ON t.id = a.id GROUP BY a.id")
def txt09(t: Tables):
    return t.alltext().select("id", F.size(tx.lexemes("tokens")).cast("bigint").alias("n"))


@query("txt10_terms_per_document", d.TEXT_CTES + " SELECT term, count(*) AS docs FROM grams GROUP BY term")
def txt10(t: Tables):
    return t.alltext().select(F.explode(tx.ngrams("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


# Text rollups ----------------------------------------------------------------

def _rollup_sql(unit: str, terms: bool, by_host: bool) -> str:
    keys = (["term"] if terms else []) + ["language", "time"] + (["host"] if by_host else [])
    out = {"term": "term AS alltext", "time": f"time AS timestamp_published_{unit}"}
    rows = "grams g JOIN arts a ON a.id = g.id" if terms else "arts a"
    ctes = d.TEXT_CTES if terms else f"WITH arts AS ({d.ARTICLES})"
    inner = (
        f"SELECT {'g.term, ' if terms else ''}a.language, CAST(date_trunc('{unit}', a.timestamp_published) AS TIMESTAMP) AS time, "
        f"{d.unsurt_host('a.hostpath_surt')} AS host, a.hostpath_surt FROM {rows}"
    )
    return f"{ctes} SELECT {', '.join(out.get(k, k) for k in keys)}, MEASURE AS hostpath_surt FROM ({inner}) GROUP BY {', '.join(keys)}"


_FAMILY = [  # name, unit, terms, by host
    ("agg15_language_month", "month", False, False),
    ("agg16_language_month_host", "month", False, True),
    ("agg17_term_language_month", "month", True, False),
    ("agg18_term_language_month_host", "month", True, True),
    ("agg23_language_day", "day", False, False),
    ("agg24_language_day_host", "day", False, True),
    ("agg25_term_language_day", "day", True, False),
    ("agg26_term_language_day_host", "day", True, True),
]


def _text_query(name, unit, terms, by_host):
    @query(name, _rollup_sql(unit, terms, by_host).replace("MEASURE", "count(hostpath_surt)"))
    def run(t: Tables):
        return tr.text_rollup(t.articles(), unit, terms, by_host, vectors=alltext_vectors)


def _theta_query(name, terms, by_host):
    @query(name, _rollup_sql("month", terms, by_host).replace("MEASURE", "count(DISTINCT hostpath_surt)"))
    def run(t: Tables):
        stored = tr.text_rollup(t.articles(), "month", terms, by_host, sketch=True, vectors=alltext_vectors)
        return stored.withColumn("hostpath_surt", F.theta_sketch_estimate("hostpath_surt"))


for _args in _FAMILY:
    _text_query(*_args)
_theta_query("agg19_language_month_theta", False, False)
_theta_query("agg20_language_month_host_theta", False, True)
_theta_query("agg21_term_language_month_theta", True, False)
_theta_query("agg22_term_language_month_host_theta", True, True)


def _family_sql(terms: bool, unit: str = "month") -> str:
    """Both groupings of the family, stacked."""
    term = "g.term, " if terms else ""
    rows = "grams g JOIN arts a ON a.id = g.id" if terms else "arts a"
    ctes = d.TEXT_CTES if terms else f"WITH arts AS ({d.ARTICLES})"
    keys = ("term, " if terms else "") + "language, time"
    names = ("term AS alltext, " if terms else "") + f"language, time AS timestamp_published_{unit}"
    return f"""{ctes}, x AS (SELECT {term}a.language, CAST(date_trunc('{unit}', a.timestamp_published) AS TIMESTAMP) AS time,
        {d.unsurt_host('a.hostpath_surt')} AS host, a.hostpath_surt FROM {rows})
      SELECT {names}, host, true AS by_host, count(*) AS docs, count(DISTINCT hostpath_surt) AS urls FROM x GROUP BY {keys}, host
      UNION ALL SELECT {names}, NULL, false, count(*), count(DISTINCT hostpath_surt) FROM x GROUP BY {keys}"""


def _family_query(name, terms, unit="month"):
    @query(name, _family_sql(terms, unit))
    def run(t: Tables):
        both = tr.text_rollup_family(t.articles(), unit, terms, vectors=alltext_vectors)
        return both.withColumn("urls", F.theta_sketch_estimate("hostpath_surt")).drop("hostpath_surt")


_family_query("agg50_family", False)
_family_query("agg50_family_terms", True)
_family_query("agg50_family_days", False, "day")

_LEXEME_BUNDLE = d.TEXT_CTES + """ SELECT {keys}, count(DISTINCT url) AS url, count(DISTINCT hostpathquery_surt) AS hostpathquery,
  count(DISTINCT hostpath_surt) AS hostpath FROM (SELECT DISTINCT id, lexeme AS alltext FROM tok) g JOIN
  (SELECT *, CAST(date_trunc('month', timestamp_published) AS TIMESTAMP) AS month FROM arts) a ON a.id = g.id GROUP BY ALL"""


def _lexeme_rollup(t: Tables, keys: dict):
    """Keys and measures are those of an article, so they are worked out before its lexemes become rows."""
    measures = ru.url_measures("url")
    columns = [c.alias(f"_{k}") for k, c in (keys | measures).items()]
    rows = t.alltext().select(*columns, tx.lexemes("tokens").alias("_lexemes"))
    rows = rows.select(*[f"_{k}" for k in keys | measures], F.explode_outer("_lexemes").alias("_alltext")).filter("_alltext IS NOT NULL")
    spec = ru.RollupSpec({k: F.col(f"_{k}") for k in ("alltext", *keys)}, {m: F.col(f"_{m}") for m in measures})
    return ru.rollup(rows, spec)


@query("agg27_lexeme_host_month", _LEXEME_BUNDLE.replace("{keys}", "alltext, host, month AS timestamp_published"))
def agg27(t: Tables):
    return _lexeme_rollup(t, {"host": uk.url_host("url"), "timestamp_published": sc.month_of("timestamp_published")})


@query("agg28_lexeme_month", _LEXEME_BUNDLE.replace("{keys}", "alltext, month AS timestamp_published"))
def agg28(t: Tables):
    return _lexeme_rollup(t, {"timestamp_published": sc.month_of("timestamp_published")})


# Trends ----------------------------------------------------------------------

def _store(t: Tables, terms: bool):
    """The monthly rollup as a stored table, which an application writes once for all its requests."""

    def make():
        rows = ts.build(t.articles(), "month", terms, vectors=alltext_vectors)
        return ts.write_batch(rows, scratch_dir(t.spark, "text-rollup"), dealt=terms)

    path = ts.once(t.spark, (t.dir, "month", terms), make)
    return ts.open_store(t.spark, path, "month", terms, merged=True)


def _total(t: Tables):
    return ts.counts(_store(t, False))


def _counts(t: Tables):
    return ts.counts(_store(t, True))


def _sketches(t: Tables):
    return _store(t, True).drop("docs")


_STORED_MEASURES = "count(hostpath_surt) AS docs, count(DISTINCT hostpath_surt)"


@query("snk5_text_rollup_batches", _rollup_sql("month", True, False).replace("MEASURE", _STORED_MEASURES))
def snk5_text(t: Tables):
    """The n-gram rollup stored in two batches, one of them run twice, and opened as one."""
    path, arts = scratch_dir(t.spark, "text-rollup"), t.articles()
    for batch, part in ((0, arts.filter("id % 2 = 0")), (1, arts.filter("id % 2 <> 0")), (1, arts.filter("id % 2 <> 0"))):
        ts.write_batch(ts.build(part, "month", True, vectors=alltext_vectors), path, batch=batch, dealt=True)
    opened = ts.open_store(t.spark, path, "month", True)
    return opened.withColumn("hostpath_surt", F.theta_sketch_estimate("hostpath_surt"))


@query("snk5_text_rollup_compacted", _rollup_sql("day", False, True).replace("MEASURE", _STORED_MEASURES))
def snk5_text_day(t: Tables):
    """The daily rollup by host, stored in three batches and compacted to one."""
    path = scratch_dir(t.spark, "text-rollup")
    for batch in range(3):
        ts.write_batch(ts.build(t.articles().filter(F.col("id") % 3 == batch), "day", False, True), path, "day", batch)
    whole = ts.compact(t.spark, path, scratch_dir(t.spark, "text-rollup"), "day", False, True)
    opened = ts.open_store(t.spark, whole, "day", False, True, merged=True)
    return opened.withColumn("hostpath_surt", F.theta_sketch_estimate("hostpath_surt"))


_CAL = f"SELECT CAST(unnest(generate_series(TIMESTAMP '{LO}', TIMESTAMP '{HI}', INTERVAL 1 MONTH)) AS TIMESTAMP) AS time"
_TOTALS = f"""SELECT CAST(date_trunc('month', timestamp_published) AS TIMESTAMP) AS time, count(*) AS total FROM arts
  WHERE language = 'en' AND timestamp_published >= '{LO}' AND timestamp_published < '{HI}' GROUP BY 1"""


def _cooc_sql(terms) -> str:
    names = ", ".join(f"'{x}'" for x in terms)
    return f"""SELECT CAST(date_trunc('month', a.timestamp_published) AS TIMESTAMP) AS time, count(DISTINCT a.hostpath_surt) AS n
      FROM arts a SEMI JOIN (SELECT hostpath_surt, m FROM (
          SELECT b.hostpath_surt, date_trunc('month', b.timestamp_published) AS m, g.term FROM arts b JOIN grams g ON g.id = b.id
          WHERE g.term IN ({names}) AND b.language = 'en')
        GROUP BY 1, 2 HAVING count(DISTINCT term) = {len(terms)}) x
        ON x.hostpath_surt = a.hostpath_surt AND x.m = date_trunc('month', a.timestamp_published)
      WHERE a.language = 'en' AND a.timestamp_published >= '{LO}' AND a.timestamp_published < '{HI}' GROUP BY 1"""


def _trend_sql(terms, divisor=None) -> str:
    over = f" / ({divisor} + 1e-10)" if divisor else ""
    n = f"CAST(coalesce(s.n, 0) AS DOUBLE){over}"
    return f"""{d.TEXT_CTES}, cal AS ({_CAL}), tot AS ({_TOTALS}), s AS ({_cooc_sql(terms)}), o AS ({_cooc_sql(ONE_TERM)})
      SELECT cal.time, coalesce(total, 0) AS total, round({n}, 6) AS estimate, round({n}, 6) AS lower, round({n}, 6) AS upper
      FROM cal LEFT JOIN tot USING (time) LEFT JOIN s USING (time) LEFT JOIN o USING (time)"""


def _series(df):
    return df.select("time", "total", *[F.round(c, 6).alias(c) for c in td.SERIES])


@query("tsr1_month_calendar", f"SELECT time, count(id) AS n FROM ({_CAL}) LEFT JOIN (SELECT doc_id AS id, o_orderdate FROM documents JOIN orders ON doc_id = o_orderkey) ON date_trunc('month', o_orderdate) = time GROUP BY time")
def tsr1(t: Tables):
    """Calendar with the article count of each month, empty months included."""
    per = t.articles().groupBy(sc.month_of("timestamp_published").alias("time")).agg(F.count(F.lit(1)).alias("n"))
    return td.fill(per, td.calendar(t.spark, LO, HI), ["n"])


@query("tsr2_day_calendar", "SELECT time, count(o_orderkey) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY)) AS TIMESTAMP) AS time) LEFT JOIN orders ON date_trunc('day', o_orderdate) = time GROUP BY time")
def tsr2(t: Tables):
    per = t.read("orders").groupBy(sc.day_of(F.col("o_orderdate").cast("timestamp")).alias("time")).agg(F.count(F.lit(1)).alias("n"))
    return td.fill(per, td.calendar(t.spark, "1996-01-01", "1996-12-31", "day"), ["n"])


_FILL_SQL = f"WITH arts AS ({d.ARTICLES}), cal AS ({_CAL}), tot AS ({_TOTALS}) SELECT time, coalesce(total, 0) AS total FROM cal LEFT JOIN tot USING (time)"


@query("tsr2_month_calendar", "SELECT time, count(o_orderkey) AS n FROM (SELECT CAST(unnest(generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2020-12-01', INTERVAL 1 MONTH)) AS TIMESTAMP) AS time) LEFT JOIN orders ON date_trunc('month', o_orderdate) = time GROUP BY time")
def tsr2_months(t: Tables):
    """The 252 months of 2000 to 2020, most of them empty here."""
    per = t.read("orders").groupBy(sc.month_of(F.col("o_orderdate").cast("timestamp")).alias("time")).agg(F.count(F.lit(1)).alias("n"))
    return td.fill(per, td.calendar(t.spark, "2000-01-01", "2020-12-01"), ["n"])


@query("tsr3_gap_fill", _FILL_SQL)
def tsr3(t: Tables):
    return td.fill(td.totals(_total(t), "en", LO, HI), td.calendar(t.spark, LO, HI), ["total"])


@query("tsr4_totals_series", _FILL_SQL.replace("SELECT time, coalesce(total, 0) AS total", "SELECT CAST(epoch(time) AS BIGINT) AS x, coalesce(total, 0) AS total") + " ORDER BY x")
def tsr4(t: Tables):
    return tsr3(t).select(sc.epoch("time").alias("x"), "total").orderBy("x")


@query("jon3_calendar_left_join", f"SELECT * FROM ({_FILL_SQL})")
def jon3(t: Tables):
    joined = td.calendar(t.spark, LO, HI).join(td.totals(_total(t), "en", LO, HI), "time", "left")
    return joined.select("time", F.coalesce("total", F.lit(0)).alias("total"))


@query(
    "jon4_calendar_full_join",
    f"{d.TEXT_CTES}, cal AS ({_CAL}), s AS ({_cooc_sql(ONE_TERM)}) SELECT time, coalesce(n, 0) AS n FROM cal FULL JOIN s USING (time)",
)
def jon4(t: Tables):
    rows = td.term_sketches(_sketches(t), ONE_TERM, "en", LO, HI)
    rows = rows.select("time", F.theta_sketch_estimate("hostpath_surt").alias("n"))
    return td.calendar(t.spark, LO, HI).join(rows, "time", "full").select("time", F.coalesce("n", F.lit(0)).alias("n"))


@query("tsr5_cooccurrence_trend", _trend_sql(TERMS))
def tsr5(t: Tables):
    return _series(td.trend(_total(t), _sketches(t), TERMS, "en", LO, HI))


@query("tsr6_normalised_by_total", _trend_sql(TERMS, "coalesce(total, 0)"))
def tsr6(t: Tables):
    return _series(td.trend(_total(t), _sketches(t), TERMS, "en", LO, HI, "total"))


@query("tsr7_normalised_by_query", _trend_sql(TERMS, "coalesce(o.n, 0)"))
def tsr7(t: Tables):
    return _series(td.trend(_total(t), _sketches(t), TERMS, "en", LO, HI, ONE_TERM))


@query("agg44_sketch_intersection", f"{d.TEXT_CTES} SELECT time, CAST(n AS DOUBLE) AS estimate FROM ({_cooc_sql(TERMS)})")
def agg44(t: Tables):
    rows = td.cooccurrence(_sketches(t), TERMS, "en", LO, HI)
    return rows.select("time", "estimate").filter("estimate > 0")


@query("set3_exact_intersection", f"{d.TEXT_CTES} {_cooc_sql(TERMS)}")
def set3(t: Tables):
    """The exact twin: months' documents that hold every term."""
    rows = tr.keyed(t.alltext(), "month", terms=True).filter(
        F.col("alltext").isin(TERMS) & (F.col("language") == "en") & sc.time_in("timestamp_published_month", LO, HI)
    )
    docs = rows.groupBy(F.col("timestamp_published_month").alias("time"), "hostpath_surt").agg(F.count_distinct("alltext").alias("k"))
    return docs.filter(F.col("k") == len(TERMS)).groupBy("time").agg(F.count(F.lit(1)).alias("n"))


def _ratio_sql(terms) -> str:
    parts = ", ".join(
        f"round(coalesce(sum(CASE WHEN term = '{x}' THEN n END) / max(total), 0), 6) AS y{i}" for i, x in enumerate(terms)
    )
    names = ", ".join(f"'{x}'" for x in terms)
    return f"""{d.TEXT_CTES}, cal AS ({_CAL}),
      tot AS (SELECT CAST(date_trunc('month', timestamp_published) AS TIMESTAMP) AS time, count(*) AS total FROM arts WHERE language = 'en' GROUP BY 1),
      c AS (SELECT CAST(date_trunc('month', a.timestamp_published) AS TIMESTAMP) AS time, term, count(*) AS n
        FROM grams g JOIN arts a ON a.id = g.id WHERE language = 'en' AND term IN ({names}) GROUP BY ALL)
      SELECT CAST(epoch(time) AS BIGINT) AS x, {parts} FROM cal LEFT JOIN tot USING (time) LEFT JOIN c USING (time) GROUP BY time"""


@query("tsr8_term_ratios", _ratio_sql(["er", "ha", "anea eriner"]))
def tsr8(t: Tables):
    out = td.ratio_series(_total(t), _counts(t), ["er", "ha", "anea eriner"], "en", LO, HI)
    return out.select("x", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    "jon5_terms_side_by_side",
    d.TEXT_CTES + """ SELECT CAST(date_trunc('month', timestamp_published) AS TIMESTAMP) AS time,
      count(CASE WHEN term = 'er' THEN 1 END) AS er, count(CASE WHEN term = 'ha' THEN 1 END) AS ha
      FROM grams JOIN arts USING (id) WHERE term IN ('er', 'ha') GROUP BY 1""",
)
def jon5(t: Tables):
    """Several terms' series as columns: one read and a pivot, not a join per term."""
    rows = _counts(t).filter(F.col("alltext").isin("er", "ha"))
    wide = rows.groupBy(F.col("timestamp_published_month").alias("time")).pivot("alltext", ["er", "ha"]).agg(F.sum("hostpath_surt"))
    return wide.select("time", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("er", "ha")])


@query(
    "set2_union_of_series",
    d.TEXT_CTES + """ SELECT term, CAST(date_trunc('month', timestamp_published) AS TIMESTAMP) AS time, count(*) AS n
      FROM grams JOIN arts USING (id) WHERE term IN ('er', 'ha') GROUP BY ALL""",
)
def set2(t: Tables):
    rollup = _counts(t)
    monthly = rollup.groupBy("alltext", F.col("timestamp_published_month").alias("time")).agg(F.sum("hostpath_surt").alias("n"))
    one = monthly.filter("alltext = 'er'").withColumnRenamed("alltext", "term")
    two = monthly.filter("alltext = 'ha'").withColumnRenamed("alltext", "term")
    return one.unionByName(two)


@query(
    "flt16_term_lookup",
    d.TEXT_CTES + " SELECT term AS alltext, language, CAST(date_trunc('month', timestamp_published) AS TIMESTAMP) AS timestamp_published_month, count(*) AS hostpath_surt FROM grams JOIN arts USING (id) WHERE term = 'anea eriner' GROUP BY ALL",
)
def flt16(t: Tables):
    return _counts(t).filter("alltext = 'anea eriner'")


@query(
    "tsr9_month_window",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS time_lo, CAST(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH AS TIMESTAMP) AS time_hi FROM orders",
)
def tsr9(t: Tables):
    """A selection of one month from each order's date, widened to whole months."""
    rows = t.read("orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("lo"),
        F.add_months(F.date_trunc("MONTH", "o_orderdate"), 1).cast("timestamp").alias("hi"),
    )
    return td.month_window(rows, "lo", "hi").select("o_orderkey", "time_lo", "time_hi")


@query(
    "top6_series_by_time",
    "SELECT CAST(epoch(CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)) AS BIGINT) AS x, count(*) AS n FROM orders GROUP BY 1 ORDER BY x",
)
def top6(t: Tables):
    month = sc.month_of(F.col("o_orderdate").cast("timestamp"))
    return t.read("orders").groupBy(sc.epoch(month).alias("x")).agg(F.count(F.lit(1)).alias("n")).orderBy("x")


@query("mono_cooccurrence_below_single", f"{d.TEXT_CTES} SELECT time, true AS holds FROM ({_cooc_sql(TERMS)})")
def mono(t: Tables):
    """A pair's count never exceeds either term's own."""
    stored = _sketches(t)
    pair = td.cooccurrence(stored, TERMS, "en", LO, HI).filter("estimate > 0").select("time", "estimate")
    single = td.term_sketches(stored, TERMS, "en", LO, HI).groupBy("time").agg(
        F.min(F.theta_sketch_estimate("hostpath_surt")).alias("least")
    )
    return pair.join(single, "time").select("time", (F.col("estimate") <= F.col("least")).alias("holds"))


# Search ----------------------------------------------------------------------

def _stored(t: Tables):
    """Articles with their vectors as a table, and the index stored by term."""
    arts = persist_table(t.tokenised().withColumn("doc_len", F.size("tsv_content")), "articles")
    return arts, se.write_index(se.build_index(arts), scratch_dir(t.spark, "index"))


_TC = f"WITH arts AS MATERIALIZED ({d.ARTICLES}), tc AS MATERIALIZED ({d.tokens('SELECT * FROM arts', 'content')})"
_SCORED = """, len AS (SELECT a.id, count(c.pos) AS dl FROM arts a LEFT JOIN tc c ON c.id = a.id GROUP BY a.id),
  st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM len),
  tf AS (SELECT id, lexeme, count(*)::DOUBLE AS tf FROM tc WHERE lexeme IN (%s) GROUP BY ALL),
  df AS (SELECT lexeme, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
  sc AS (SELECT tf.id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) AS score
    FROM tf JOIN df USING (lexeme) JOIN len ON len.id = tf.id CROSS JOIN st GROUP BY tf.id)"""


@query("txt11_index", f"{_TC} SELECT lexeme AS term, id AS doc, count(*) AS tf, min(pos) AS first FROM tc GROUP BY ALL")
def txt11_index(t: Tables):
    index = se.build_index(t.tokenised())
    return index.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").cast("bigint").alias("first"))


@query(
    "txt11_boolean_match",
    f"""{_TC} SELECT id AS doc FROM tc WHERE lexeme IN ('er', 'ha') GROUP BY id HAVING count(DISTINCT lexeme) = 2
      INTERSECT SELECT id FROM tc WHERE lexeme IN ('es', 'ti') EXCEPT SELECT id FROM tc WHERE lexeme IN ('wh')""",
)
def txt11(t: Tables):
    """(er & ha) & (es | ti) & !wh"""
    _, index = _stored(t)
    return se.match(index, all_of=["er", "ha"], any_of=["es", "ti"], none_of=["wh"])


@query(
    "txt11_phrase_match",
    f"{_TC} SELECT DISTINCT a.id AS doc FROM tc a JOIN tc b ON b.id = a.id AND b.pos = a.pos + 1 JOIN tc c ON c.id = a.id AND c.pos = a.pos + 2 WHERE a.lexeme = 'anea' AND b.lexeme = 'eriner' AND c.lexeme = 'thanea'",
)
def txt11_phrase(t: Tables):
    return se.docs_with_phrase(se.build_index(t.tokenised()), ["anea", "eriner", "thanea"])


@query(
    "txt12_query_terms",
    r"""SELECT page_id, ord, CASE WHEN p LIKE '"%' THEN 'phrase' WHEN p LIKE 'site:%' THEN 'site' ELSE 'word' END AS kind,
      CASE WHEN p LIKE '"%' THEN trim(p, '" ') WHEN p LIKE 'site:%' THEN substr(p, 6) ELSE p END AS term FROM (
      SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS ord FROM (
        SELECT page_id, list_transform(regexp_extract_all('News "' || split_part(url, '/', 4) || ' today" site:' || split_part(url, '/', 3), '"[^"]*"|[^\s"]+'), lambda x: lower(x)) AS l FROM pages))""",
)
def txt12(t: Tables):
    """A request per page: a word, a phrase and a site."""
    part = F.split_part("url", F.lit("/"), F.lit(4))
    host = F.split_part("url", F.lit("/"), F.lit(3))
    text = F.concat(F.lit('News "'), part, F.lit(' today" site:'), host)
    rows = t.read("pages").select("page_id", text.alias("query"))
    return se.parse_queries(rows).withColumn("ord", F.col("ord").cast("bigint"))


# Requests made of the articles' own titles: a phrase, a word and a word to avoid.
_REQ = f"""{_TC}, tt AS MATERIALIZED ({d.tokens('SELECT * FROM arts', 'title')}),
  q AS MATERIALIZED (SELECT id AS request_id, language, max(lexeme) FILTER (pos = 1) AS p1, max(lexeme) FILTER (pos = 2) AS p2,
    max(lexeme) FILTER (pos = 3) AS w, max(lexeme) FILTER (pos = 6) AS x FROM tt GROUP BY ALL),
  m AS MATERIALIZED (SELECT DISTINCT request_id, c.id FROM q JOIN tc c ON c.lexeme = coalesce(p1, p2, w) AND c.language = q.language
    WHERE (p1 IS NULL OR p2 IS NULL OR EXISTS (SELECT 1 FROM tc b WHERE b.id = c.id AND b.pos = c.pos + 1 AND b.lexeme = p2))
      AND (w IS NULL OR EXISTS (SELECT 1 FROM tc b WHERE b.id = c.id AND b.lexeme = w))
      AND (x IS NULL OR NOT EXISTS (SELECT 1 FROM tc b WHERE b.id = c.id AND b.lexeme = x)))"""


def _title_requests(arts):
    w = tx.raw_words("title")

    def word(i):
        return F.coalesce(F.get(w, F.lit(i)), F.lit(""))

    text = F.concat(F.lit('"'), word(0), F.lit(" "), word(1), F.lit('" '), word(2), F.lit(" -"), word(5))
    return arts.select(F.col("id").alias("request_id"), "language", text.alias("query"))


@query(
    "txt12_bulk_search",
    f"""{_REQ}, len AS (SELECT a.id, count(c.pos) AS dl FROM arts a LEFT JOIN tc c ON c.id = a.id GROUP BY a.id),
      st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM len),
      tf AS (SELECT id, lexeme, count(*)::DOUBLE AS tf FROM tc GROUP BY ALL), df AS (SELECT lexeme, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
      asked AS (SELECT DISTINCT id AS request_id, lexeme FROM tt WHERE pos <= 3),
      sc AS (SELECT request_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))) AS score
        FROM m JOIN asked USING (request_id) JOIN tf USING (id, lexeme) JOIN df USING (lexeme) JOIN len USING (id) CROSS JOIN st GROUP BY ALL)
      SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY round(1 / score, 9), id) AS place, id, title, round(1 / score, 6) AS rank
      FROM sc JOIN arts USING (id) QUALIFY place <= 10""",
)
def txt12_bulk(t: Tables):
    """Every article's title as a request; the ten best hits of each, all in one job."""
    arts, index = _stored(t)
    hits = rq.bulk_search(arts, index, _title_requests(arts))
    return hits.select("request_id", F.col("place").cast("bigint").alias("place"), "id", "title", F.round("rank", 6).alias("rank"))


@query(
    "txt12_bulk_trend",
    f"""{_REQ}, tot AS (SELECT language, date_trunc('month', timestamp_published)::TIMESTAMP AS time, count(*) AS total FROM arts GROUP BY ALL)
      SELECT request_id, time, docs, total FROM (
        SELECT request_id, date_trunc('month', timestamp_published)::TIMESTAMP AS time, count(*) AS docs FROM m JOIN arts USING (id) GROUP BY ALL)
      JOIN q USING (request_id) JOIN tot USING (language, time)""",
)
def txt12_trend(t: Tables):
    """The same requests as monthly series."""
    arts, index = _stored(t)
    return rq.bulk_trend(arts, index, _title_requests(arts))


@query("txt13_relevance", f"{_TC}{_SCORED % repr('er') + ''} SELECT id AS doc, round(1 / score, 6) AS distance FROM sc")
def txt13(t: Tables):
    arts, index = _stored(t)
    scored = se.bm25(index, se.corpus_stats(arts), ["er"])
    return scored.select("doc", F.round(1 / F.col("score"), 6).alias("distance"))


@query(
    "txt14_term_subsets",
    f"""WITH q AS (SELECT page_id AS query_id, list_append(string_split(host, '.'), split_part(url, '/', 4) || ' today') AS terms FROM ({d.PAGES})),
      m AS (SELECT query_id, terms, unnest(generate_series(1, (1 << len(terms)) - 2)) AS mask FROM q)
      SELECT query_id, len(p) AS n_terms, array_to_string(p, ' ') AS subset FROM (
        SELECT query_id, list_transform(list_filter(terms, lambda x, i: (mask >> (i - 1)) & 1 = 1),
          lambda x: CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END) AS p FROM m)""",
)
def txt14(t: Tables):
    """A query per page: its host's labels and a phrase."""
    phrase = F.concat(F.split_part("url", F.lit("/"), F.lit(4)), F.lit(" today"))
    terms = t.read("pages").select(
        F.col("page_id").alias("query_id"), F.array_append(F.split(uk.url_host("url"), r"\."), phrase).alias("terms")
    )
    return td.term_subsets(terms).withColumn("n_terms", F.col("n_terms").cast("bigint"))


_HIT = f"id, {d.unsurt_host('hostpath_surt')} || split_part(hostpath_surt, ')', 2) AS url, {d.unsurt_host('hostpath_surt')} AS host, title, description, language, CAST(CAST(timestamp_published AS DATE) AS VARCHAR) AS date_published"


def _hits(df):
    return df.withColumn("date_published", F.col("date_published").cast("string")).withColumn("rank", F.round("rank", 6))


def _search_sql(order: str) -> str:
    return f"""{_TC}{_SCORED % "'er', 'ha'"} SELECT {_HIT}, round(1 / score, 6) AS rank FROM arts JOIN sc USING (id)
      SEMI JOIN (SELECT id FROM tc WHERE lexeme IN ('er', 'ha') GROUP BY id HAVING count(DISTINCT lexeme) = 2) m USING (id)
      WHERE timestamp_published >= '1995-01-01' AND timestamp_published < '2000-01-01' ORDER BY {order} LIMIT 10"""


for _name, _order in {
    "none": "id", "time_desc": "timestamp_published DESC, id", "time_asc": "timestamp_published, id", "rank": "round(1 / score, 9), id"
}.items():
    def _search_query(name=_name, order=_order):
        @query(f"top2_search_{name}", _search_sql(order))
        def run(t: Tables):
            arts, index = _stored(t)
            return _hits(se.search(arts, index, all_of=["er", "ha"], lo="1995-01-01", hi="2000-01-01", orderby=name))

    _search_query()


@query(
    "top3_article_search",
    f"""SELECT id, title, description FROM (
      SELECT id, trim(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g'), '&amp;', '&')) AS title,
        CAST(NULL AS VARCHAR) AS description, {ARTICLE_BODY} AS body FROM ({d.CAPTURES}) WHERE type = 'article' AND language IS NOT NULL)
      WHERE title <> '' AND body <> '' AND list_contains({d.words('body')}, 'er') ORDER BY id LIMIT 10""",
)
def top3(t: Tables):
    """Ten captures of type article that hold a word, with their descriptions."""
    captures = t.stored_captures().filter(cp.best("doc", "type") == "article")
    arts = cp.to_articles(captures)
    docs = se.docs_with_all(se.build_index(arts), ["er"]).withColumnRenamed("doc", "id")
    return arts.join(docs, "id", "left_semi").orderBy("id").limit(10).select("id", "title", "description")


@query(
    "flt11_site_filter",
    f"SELECT id FROM ({d.ARTICLES}) WHERE host_surt IN ('org,example,src3)', 'org,example,src5)')",
)
def flt11(t: Tables):
    return t.articles().filter(se.on_sites("hostpath_surt", ["src3.example.org", "www.src5.example.org"])).select("id")


@query(
    "flt13_empty_query_matches_all",
    f"SELECT id, {_HIT.split(', ', 1)[1]} FROM ({d.ARTICLES}) WHERE host_surt = 'org,example,src3)' AND timestamp_published >= '1980-01-01' AND timestamp_published < '2022-01-01' ORDER BY timestamp_published DESC, id LIMIT 10",
)
def flt13(t: Tables):
    arts, index = _stored(t)
    hits = se.search(arts, index, sites=["src3.example.org"], orderby="time_desc")
    return _hits(hits).drop("rank")


@query("prj6_hit_projection", f"SELECT {_HIT} FROM ({d.ARTICLES})")
def prj6(t: Tables):
    arts = t.articles()
    return arts.select(*se.hit_columns(arts)).withColumn("date_published", F.col("date_published").cast("string"))
