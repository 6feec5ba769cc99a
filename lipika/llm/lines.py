"""Line deduplication by site-relative frequency [native].

A line is boilerplate of a site if the share of the site's pages that contain it exceeds a ratio.  With ``distinct``, pages with the
same lines count once, in the share's numerator and denominator, so that copies of one page don't make its own text boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lipika.llm.common import broadcast_if_small, free_name, materialize

#: Between two lines of a page: tags, scripts, style sheets, comments and line ends.  Java and RE2 read it alike.
LINE_END = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|[\r\n]"
#: The host of an absolute URL.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SPACE = " \t\r\n\x0b\x0c"


def page_lines(html: Column) -> Column:
    """The lines of a page's text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(html, F.lit("")), LINE_END), lambda x: F.btrim(x, F.lit(SPACE))), lambda x: x != "")


def url_host(url: Column) -> Column:
    """The lower-case host of a URL; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def boilerplate(pages: DataFrame, ratio: float, least_pages: int, distinct: bool) -> DataFrame:
    """(host, hashes) of boilerplate lines, from pages (host, hashes: the distinct lines' hashes).

    A line and its host are counted with partial sums before any exchange, so a common line or a large host is no large group.  A
    host has at most (lines of a page / ratio) such lines.
    """
    if distinct:
        pages = pages.groupBy("host", F.xxhash64("hashes").alias("page")).agg(F.first("hashes").alias("hashes"))
    pages = materialize(pages.select("host", "hashes"), "lines")
    totals = pages.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("total"))
    common = pages.select("host", F.explode("hashes").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    common = common.join(totals, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > F.col("total") * ratio)
    return materialize(common.groupBy("host").agg(F.collect_list("line").alias("boiler")), "boilerplate")


def mark_boilerplate(df: DataFrame, host: Column, lines: Column, ratio: float, least_pages: int, distinct: bool, name: str) -> DataFrame:
    """``df`` with an array column ``name`` of its host's boilerplate hashes (null if none).

    The table of hosts is broadcast if its counted bytes are few; beyond that the join is a shuffled one, whose large hosts
    Spark's adaptive execution splits.
    """
    hashes = F.array_distinct(F.transform(F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE)) != ""), lambda x: F.xxhash64(F.btrim(x, F.lit(SPACE)))))
    found = boilerplate(df.select(host.alias("host"), hashes.alias("hashes")), ratio, least_pages, distinct)
    of = free_name(df, "of_host")
    found = found.select(F.col("host").alias(of), F.col("boiler").alias(name))
    return df.join(broadcast_if_small(found), host.eqNullSafe(F.col(of)), "left").drop(of)


def _kept(lines: Column, boiler: str) -> Column:
    return F.when(F.col(boiler).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(boiler, F.xxhash64(F.btrim(x, F.lit(SPACE))))))


def dedup_page_lines(
    pages: DataFrame, ratio: float = 0.1, least_pages: int = 3, distinct: bool = False, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """(key, host, n_lines, n_dropped, kept_md5) of every page: its lines without its site's boilerplate.

    ``kept_md5`` is of the kept lines joined by line feeds, in UTF-8.  A null page has no lines; pages without host share the
    empty one; a null key stays null; repeated rows are pages each; an empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    base = pages.select(F.col(key).alias("page"), url_host(F.col(url)).alias("host"), page_lines(F.col(html)).alias("lines"))
    marked = mark_boilerplate(base, F.col("host"), F.col("lines"), ratio, least_pages, distinct, "boiler")
    kept = marked.withColumn("kept", _kept(F.col("lines"), "boiler"))
    return kept.select(
        F.col("page").alias(key),
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.md5(F.array_join("kept", "\n").cast("binary")).alias("kept_md5"),
    )


def drop_boilerplate_lines(
    docs: DataFrame, ratio: float = 0.05, least_pages: int = 3, distinct: bool = True, text: str = "text", host: str = "source", n_chars: str = "n_chars"
) -> DataFrame:
    """``docs`` with their texts' boilerplate lines dropped (lines between line feeds, compared without outer white space).

    Documents with the same lines count once unless ``distinct`` is off: a large group of copies would lose its own text otherwise.  Blank lines stay.
    All rows and columns come back; ``n_chars``, if there is one, is the new length.  A null text stays null;
    rows with a null host are a site of their own; repeated rows stay; an empty table stays empty; no column name is taken.
    """
    boiler = free_name(docs, "boiler")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    marked = mark_boilerplate(docs, F.col(host), lines, ratio, least_pages, distinct, boiler)
    changed = F.when(F.col(text).isNotNull() & F.col(boiler).isNotNull(), F.array_join(_kept(lines, boiler), "\n")).otherwise(F.col(text))
    out = marked.withColumn(text, changed).drop(boiler)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.when(F.col(text).isNotNull(), F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return out.select(*docs.columns)


#: DuckDB's form of ``dedup_page_lines`` with its default parameters.
PAGES_SQL = f"""
WITH base AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    list_filter(list_transform(regexp_split_to_array(coalesce(html, ''), '{LINE_END}'), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(11) || chr(12))), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS total FROM base GROUP BY host),
boiler AS (
  SELECT c.host, list(line) AS boiler FROM (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM base) GROUP BY host, line) c
  JOIN totals t ON t.host = c.host WHERE n >= 3 AND n > total * 0.1 GROUP BY c.host),
kept AS (SELECT page_id, b.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boiler, []), x)) AS kept FROM base b LEFT JOIN boiler o ON o.host = b.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, md5(array_to_string(kept, chr(10))) AS kept_md5
FROM kept
"""
