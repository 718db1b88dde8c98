"""Line dedup by site-relative frequency: a line on too large a share of a site's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, stage


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _hash(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(" \t\r")))


def boilerplate(df: DataFrame, *, text: str = "text", host: str = "source", ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """Per host (column 'host', null for the null host) the hashes of its boilerplate lines (column 'lines').

    A line counts once for each page that holds it. It is boilerplate if at least min_pages pages
    of the host hold it and they are more than ratio of the host's pages. A page of L lines can
    hold at most L of them, so a host has at most L / ratio such lines, however many pages it has:
    that bounds the array. Counts are summed on each task before the shuffle, so neither a host with
    a third of the pages nor a line on all of them meets in one task.
    """
    h, n_pages = "page_host", "pages"
    pages = df.groupBy(F.col(host).alias(h)).agg(F.count(F.lit(1)).alias(n_pages))
    of_page = F.array_distinct(F.transform(_lines(text), _hash))
    counts = df.select(F.col(host).alias("host"), F.explode(of_page).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter(F.col("n") >= min_pages).join(pages, F.col("host").eqNullSafe(F.col(h))).filter(F.col("n") > F.col(n_pages) * F.lit(ratio))
    return found.groupBy("host").agg(F.collect_list("line").alias("lines"))


def dedup_lines(df: DataFrame, *, text: str = "text", host: str = "source", ratio: float = 0.1, min_pages: int = 3, dropped: str | None = None, broadcast_lines: int = 1_000_000) -> DataFrame:
    """df with the boilerplate lines of each host taken out of text; dropped names an added count of them.

    Lines are what stands between newlines, compared without the blanks around them; empty lines
    are never boilerplate. The table of boilerplate lines is written and counted: up to broadcast_lines lines and hosts
    it is broadcast, and no text is shuffled; beyond, it is joined by host, where Spark may split a host's pages.

    A null text stays null (and counts as a page), a null host is a host of its own, an empty text
    stays empty, a page repeated counts as often as it stands. A page of boilerplate alone becomes
    an empty text. Columns of any other name pass through.
    """
    h, lines, all_lines = fresh(df, "host", "lines", "all")
    bad = boilerplate(df, text=text, host=host, ratio=ratio, min_pages=min_pages)
    bad = stage(bad.select(F.col("host").alias(h), F.col("lines").alias(lines)), "line-boilerplate")
    hosts, found = bad.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lines)), F.lit(0))).first()
    bad = F.broadcast(bad) if hosts + found <= broadcast_lines else bad
    joined = df.join(bad, F.col(host).eqNullSafe(F.col(h)), "left")
    keep = F.filter(F.col(all_lines), lambda x: (F.btrim(x, F.lit(" \t\r")) == "") | ~F.array_contains(F.col(lines), _hash(x)))
    out = joined.withColumn(all_lines, F.when(F.col(lines).isNotNull() & F.col(text).isNotNull(), _lines(text)))
    new = F.when(F.col(all_lines).isNotNull(), F.array_join(keep, "\n")).otherwise(F.col(text))
    columns = [new.alias(text) if c == text else F.col(c) for c in df.columns]
    if dropped:
        columns.append(F.when(F.col(all_lines).isNotNull(), F.size(all_lines) - F.size(keep)).otherwise(0).cast("bigint").alias(dropped))
    return out.select(*columns)
