"""Line de-duplication by site-relative frequency: a line that a large share of a site's pages contain is boilerplate.

DataFrame functions only. Each page gives its distinct lines (as hashes) to a count by site and line, folded
before the shuffle, so a site with a third of all pages is no hot key. The lines over the limit are few: a site has at
most (lines per page / ratio) of them. They are written to the shared folder and come back to the pages as one array for
each site, by a join which Spark broadcasts if they are small and whose skewed side it splits otherwise; the texts are
not grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import saved, spare

MAX_RATIO = 0.10
MIN_PAGES = 5


def _line_key(site: Column, line: Column) -> Column:
    """128 bits for a line of a site."""
    return F.struct(F.xxhash64(site, line).alias("x"), F.xxhash64(F.lit(1), line, F.lit(2), site).alias("y"))


def _judged(line: Column) -> Column:
    return F.length(F.trim(F.translate(line, "\t\r\x0b\x0c", "    "))) > 0


def boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """``site, line struct<x,y>, pages, ratio``: the lines over the limit."""
    pages = df.select(F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    lines = pages.select("site", F.explode(F.array_distinct(F.split("text", "\n"))).alias("l")).filter(_judged(F.col("l")))
    found = lines.select("site", _line_key(F.col("site"), F.col("l")).alias("k")).select("site", "k.x", "k.y").groupBy("site", "x", "y").agg(
        F.count(F.lit(1)).alias("pages"))
    total = pages.groupBy("site").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("site", "of")
    return (found.filter(F.col("pages") >= min_pages).join(total, F.col("site").eqNullSafe(F.col("of")))
            .withColumn("ratio", F.col("pages") / F.col("total")).filter(F.col("ratio") > max_ratio)
            .select("site", F.struct("x", "y").alias("line"), "pages", "ratio"))


def drop_boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO,
                     min_pages: int = MIN_PAGES, n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``df`` with the boilerplate lines taken out of ``text_col``; all columns and rows stay, repeated ones too.

    A line (exact, between newlines) goes if at least ``min_pages`` pages of its site and more than ``max_ratio`` of
    them contain it; blank lines always stay. Pages without a site form one site. Null texts stay null and have no
    lines but count as pages. ``n_lines`` and ``n_removed`` name optional columns with the counts of lines.
    """
    site, bad, kept = spare(df, "bad_site", "bad_lines", "kept_lines")
    # written once, so that the plan of the join knows its size and the texts are not shuffled beside it
    by_site = saved(boilerplate(df, site_col, text_col, max_ratio, min_pages).groupBy("site").agg(F.collect_list("line").alias(bad)), "lines")
    joined = df.join(by_site.withColumnRenamed("site", site), F.col(site_col).eqNullSafe(F.col(site)), "left")
    lines = F.split(text_col, "\n")
    good = F.filter(lines, lambda l: ~(_judged(l) & F.array_contains(F.col(bad), _line_key(F.col(site_col), l))))
    joined = joined.withColumn(kept, F.when(F.col(bad).isNotNull(), good).otherwise(lines))
    out = [F.array_join(kept, "\n").alias(c) if c == text_col else F.col(c) for c in df.columns]
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("bigint")
    if n_lines:
        out.append(size(lines).alias(n_lines))
    if n_removed:
        out.append((size(lines) - size(F.col(kept))).alias(n_removed))
    return joined.select(*out)
