"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import settled

NOT_BLANK = r"[^\x20\x09-\x0D]"


def host_of(url: Column) -> Column:
    """The lower-cased host of a URL, null where it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def boilerplate_lines(docs: DataFrame, host: Column, text: Column, ratio: float, least_pages: int) -> DataFrame:
    """(host, lines): the hashes of each host's boilerplate lines, for hosts that have any.

    A page counts once for a line. The pair (host, line) is counted map-side first, so a host with
    a third of all pages is no hot group. A host's list holds at most its lines per page / ratio.
    """
    pages = docs.select(host.alias("host"), text.alias("text")).filter("host is not null")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = F.transform(F.array_distinct(F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_BLANK))), lambda x: F.xxhash64(x))
    seen = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    often = seen.filter(F.col("n") >= least_pages).join(settled(totals), "host").filter(F.col("n") > F.col("pages") * F.lit(ratio))
    return settled(often.groupBy("host").agg(F.collect_set("line").alias("lines")))


def drop_boilerplate_lines(
    docs: DataFrame,
    *,
    host: Column | None = None,
    text: str = "text",
    ratio: float = 0.03,
    least_pages: int = 3,
) -> DataFrame:
    """``docs`` with ``text`` rid of boilerplate lines, plus ``lines_total`` and ``lines_removed``.

    Site-relative frequency: of a host's pages, those holding a line (compared whole, by a 64-bit
    hash within the host) are divided by all of them; lines above ``ratio`` go wherever they stand
    on that host, short ones too. A line that fewer than ``least_pages`` pages of the host hold stays: one page
    is no recurrence, and two may be a page and its copy, of which one is to survive. Blank lines stay.
    ``host`` defaults to column ``source``.

    Defined cases: a null text is empty and stays null; a page without host keeps all lines and
    counts for no host; repeated rows are pages of their own; a page may end up empty but stays;
    existing columns of the two new names are replaced, all others, whatever their names, stay.
    """
    host = F.col("source") if host is None else host
    body = F.col(f"`{text}`")
    named = boilerplate_lines(docs, host, body, ratio, least_pages)
    known = F.struct(F.col("host"), F.col("lines")).alias("__site")
    joined = docs.withColumn("__host", host).join(named.select(known), F.col("__host") == F.col("__site.host"), "left")
    lines = F.split(body, "\n")
    stays = lambda x: ~F.array_contains(F.col("__site.lines"), F.xxhash64(x))
    kept = F.when(F.col("__site").isNull(), lines).otherwise(F.filter(lines, stays))
    out = joined.withColumn("__kept", kept)
    total = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    return (
        out.withColumn("lines_total", F.when(body.isNull(), F.lit(0)).otherwise(total).cast("long"))
        .withColumn("lines_removed", F.when(body.isNull(), F.lit(0)).otherwise(total - F.size("__kept")).cast("long"))
        .withColumn(text, F.array_join("__kept", "\n"))
        .drop("__host", "__site", "__kept")
    )
