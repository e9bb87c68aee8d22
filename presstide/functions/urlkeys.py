"""URL and host keys as native Column expressions.

Every function takes a Column (or column name) and returns a Column; null in
gives null out. All are string built-ins, so they stay inside generated code
and can be pushed below joins and aggregates. Each mentions its input as few
times as it can: an input that is itself an expression is inlined at every
mention, and generated code is limited in size. Malformed URLs are accepted on
purpose: nothing here raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY_MAX_CHARS = 2048


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_remove_scheme(url: Column | str) -> Column:
    """Everything after the first ``//``, wherever it is; else the input."""
    return F.regexp_replace(as_col(url), r"(?s)^.*?//", "")


def url_host(url: Column | str) -> Column:
    """Text before the first ``/``, ``?`` or ``:`` after the scheme.

    A ``#`` directly after the host stays in it.
    """
    return F.regexp_extract(url_remove_scheme(url), r"^[^/?:]*", 0)


def url_path(url: Column | str) -> Column:
    """From the first ``/`` that follows a host character to ``;``, ``#`` or ``?``.

    The appended ``?x/`` supplies the ``/`` an address without a path has; it
    is out of reach for any path of the address itself.
    """
    probe = F.concat(url_remove_scheme(url), F.lit("?x/"))
    return F.regexp_extract(probe, r"(?<=[^/?])/[^;#?]*", 0)


def url_query(url: Column | str) -> Column:
    """Between the first ``?`` and the next ``?`` or ``#``; empty if none."""
    return F.regexp_extract(as_col(url), r"\?([^?#]*)", 1)


def host_simplify(host: Column | str) -> Column:
    """Drop one leading ``www<digits>.`` or ``m.`` label."""
    return F.regexp_replace(as_col(host), r"^(?:www\d*|m)\.", "")


def host_surt(host: Column | str) -> Column:
    """``a.b.com`` -> ``com,b,a)``."""
    labels = F.reverse(F.split(as_col(host), r"\."))
    return F.concat(F.array_join(labels, ","), F.lit(")"))


def host_unsurt(surt: Column | str) -> Column:
    """Inverse of :func:`host_surt`; the last character is dropped unseen."""
    s = as_col(surt)
    labels = F.split(F.substring(s, F.lit(1), F.length(s) - 1), ",")
    return F.array_join(F.reverse(labels), ".")


def unsurt(surt: Column | str) -> Column:
    """Any key back to a URL without scheme; text after a second ``)`` is lost."""
    s = as_col(surt)
    labels = F.split(F.split_part(s, F.lit(")"), F.lit(1)), ",")
    return F.concat(F.array_join(F.reverse(labels), "."), F.split_part(s, F.lit(")"), F.lit(2)))


def path_simplify(path: Column | str) -> Column:
    """Drop a trailing default page (``index.html`` and kin), then one slash."""
    p = F.regexp_replace(as_col(path), r"(?s)(?<=/)index.\w{3,4}\z", "")
    return F.regexp_replace(p, r"/\z", "")


def query_simplify(query: Column | str) -> Column:
    """Sort the terms and drop campaign-tracking ones (LIKE ``utm_%``)."""
    terms = F.filter(F.split(as_col(query), "&"), lambda t: ~t.like("utm_%"))
    return F.array_join(F.array_sort(terms), "&")


def key_truncate(key: Column | str) -> Column:
    """Bound a key to ``KEY_MAX_CHARS`` characters."""
    return F.substring(as_col(key), 1, KEY_MAX_CHARS)


def url_host_surt(url: Column | str) -> Column:
    return key_truncate(host_surt(host_simplify(url_host(F.lower(as_col(url))))))


def url_hostpath_surt(url: Column | str) -> Column:
    u = F.lower(as_col(url))
    return key_truncate(
        F.concat(host_surt(host_simplify(url_host(u))), path_simplify(url_path(u)))
    )


def url_hostpathquery_surt(url: Column | str) -> Column:
    u = F.lower(as_col(url))
    query = F.concat(F.lit("?"), query_simplify(url_query(u)))
    return key_truncate(
        F.concat(
            host_surt(host_simplify(url_host(u))),
            path_simplify(url_path(u)),
            F.regexp_replace(query, r"^\?\z", ""),
        )
    )


def index_hostpath(url: Column | str) -> Column:
    """Lower-cased host without port, plus the path up to ``;``, ``?`` or ``#``.

    The key crawl-index rows are deduplicated on. A URL without a host keeps
    its raw text as key, so no row is lost.
    """
    u = as_col(url)
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*\z", "")
    return F.when(F.length(host) > 0, F.concat(host, path)).otherwise(u)


def with_url_keys(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, host_surt, hostpath_surt and hostpathquery_surt columns."""
    return df.withColumns(
        {
            "host": url_host(url_col),
            "host_surt": url_host_surt(url_col),
            "hostpath_surt": url_hostpath_surt(url_col),
            "hostpathquery_surt": url_hostpathquery_surt(url_col),
        }
    )

