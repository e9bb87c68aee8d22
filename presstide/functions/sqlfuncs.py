"""The scalar functions under their own names for SQL text.

Each is a temporary SQL function, so the optimizer sees through it as it does
through the Column form.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# name -> (argument and return types, body), in dependency order.
FUNCTIONS = {
    "url_remove_scheme": ("url STRING", "STRING", "IF(instr(url, '//') > 0, substring(url, instr(url, '//') + 2), url)"),
    "url_host": ("url STRING", "STRING", r"regexp_extract(url_remove_scheme(url), r'^[^/?:]*', 0)"),
    "url_path": ("url STRING", "STRING", r"IF(url IS NULL, NULL, coalesce(regexp_substr(url_remove_scheme(url), r'(?<=[^/?])/[^;#?]*'), '/'))"),
    "url_query": ("url STRING", "STRING", r"regexp_extract(url, r'\?([^?#]*)', 1)"),
    "host_simplify": ("host STRING", "STRING", r"regexp_replace(host, r'^(?:www\d*|m)\.', '')"),
    "host_surt": ("host STRING", "STRING", r"concat(array_join(reverse(split(host, r'\.')), ','), ')')"),
    "host_unsurt": ("host STRING", "STRING", "array_join(reverse(split(substring(host, 1, length(host) - 1), ',')), '.')"),
    "unsurt": ("surt STRING", "STRING", "concat(host_unsurt(concat(split_part(surt, ')', 1), ')')), split_part(surt, ')', 2))"),
    "path_simplify": ("path STRING", "STRING", r"regexp_replace(regexp_replace(path, r'(?s)(?<=/)index.\w{3,4}\z', ''), r'/\z', '')"),
    "query_simplify": ("query STRING", "STRING", "array_join(array_sort(filter(split(query, '&'), t -> t NOT LIKE 'utm_%')), '&')"),
    "btree_sanitize": ("t STRING", "STRING", "substring(t, 1, 2048)"),
    "url_host_surt": ("url STRING", "STRING", "btree_sanitize(host_surt(host_simplify(url_host(lower(url)))))"),
    "url_hostpath_surt": ("url STRING", "STRING", "btree_sanitize(concat(host_surt(host_simplify(url_host(lower(url)))), path_simplify(url_path(lower(url)))))"),
    "url_hostpathquery_surt": (
        "url STRING", "STRING",
        "btree_sanitize(concat(host_surt(host_simplify(url_host(lower(url)))), path_simplify(url_path(lower(url))), "
        "IF(length(query_simplify(url_query(lower(url)))) > 0, concat('?', query_simplify(url_query(lower(url)))), '')))",
    ),
    "array_uniq": ("a ARRAY<STRING>", "ARRAY<STRING>", "array_distinct(a)"),
    "array_reverse": ("a ARRAY<STRING>", "ARRAY<STRING>", "reverse(a)"),
    "language_iso639": (
        "language STRING", "STRING",
        r"""(SELECT CASE WHEN length(c) <= 3 THEN c
             WHEN substring(c, 3, 1) IN (':', '_', '-', ' ') THEN substring(c, 1, 2)
             WHEN substring(c, 4, 1) IN (':', '_', '-', ' ') THEN substring(c, 1, 3)
             WHEN c IS NOT NULL THEN 'invalid' END
             FROM (SELECT lower(btrim(language, '"\' \t:-_,\n')) AS c))""",
    ),
}


def register(spark: SparkSession) -> None:
    for name, (args, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
