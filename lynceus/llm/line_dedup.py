"""Cross-site line deduplication: lines spread over many sites are boilerplate. DataFrame functions only.

The spread of a line is its number of distinct sites, estimated by a HyperLogLog sketch per line hash; sketches of one
line merge by aggregation, so a line on every page is combined map-side. Lines whose estimate is within the sketch's
error of the threshold get an exact distinct count before anything is removed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from lynceus.llm.base import stored

LG_K = 12
#: Relative standard error of a sketch (1.04 / sqrt of its registers), times the deviations that count as near.
ERROR = 5 * 1.04 / math.sqrt(1 << LG_K)
BLANKS = " \t\r"


def near_margin(min_sites: int) -> int:
    return max(1, math.ceil(ERROR * min_sites))


def line_rows(docs: DataFrame, text_col: str, site_col: str, key: list) -> DataFrame:
    """(row key, pos, site, h1, h2) of every line that is not blank; the two hashes make one of 128 bits."""
    lines = docs.select(*key, F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(BLANKS))
    lines = lines.where(trimmed != "")
    return lines.select(*[c for c in lines.columns if c != "line"], F.xxhash64(trimmed).alias("h1"), F.xxhash64(F.lit(1), trimmed).alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first) of the lines on at least ``min_sites`` sites; first: their smallest (row key, pos)."""
    margin = near_margin(min_sites)
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("rid", "t1", "t2", "pos")).alias("first"),
        F.count(F.lit(1)).alias("n"))
    spread = spread.where(F.col("n") >= min_sites).withColumn("estimate", F.hll_sketch_estimate("sketch"))
    spread = stored(spread.where(F.col("estimate") >= min_sites - margin).drop("sketch", "n"), "spread")
    near = spread.where(F.col("estimate") <= min_sites + margin)
    exact = (
        lines.join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").agg(F.count("site").alias("sites")).where(F.col("sites") >= min_sites))
    sure = spread.where(F.col("estimate") > min_sites + margin).select("h1", "h2", "first")
    return stored(sure.unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"]).select("h1", "h2", "first")), "boilerplate")


def line_dedup(docs: DataFrame, min_sites: int = 8, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with the text cleaned, plus n_lines and n_removed (existing ones are replaced).

    A line, blanks at its ends aside, found on ``min_sites`` or more distinct sites stays where it occurs first (by id,
    then place) and goes everywhere else; so no passage is lost to the corpus. Blank lines stay. Rows without a site add
    nothing to a spread but are cleaned. A null text stays null with 0 lines, an empty one has 1. Rows equal in id and
    text get equal results; rows that only share an id are cleaned on their own. Empty tables give empty results.
    """
    key = [F.col(id_col).alias("rid"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit(1), text_col).alias("t2")]
    lines = line_rows(docs, text_col, site_col, key)
    found = boilerplate(lines, min_sites)
    hits = lines.join(found, ["h1", "h2"]).where(~F.struct("rid", "t1", "t2", "pos").eqNullSafe(F.col("first")))
    gone = hits.groupBy("rid", "t1", "t2").agg(F.collect_set("pos").alias("__gone"))
    gone = gone.select(F.col("rid").alias("__rid"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2"), "__gone")
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*names, *[c.alias(f"__k{i}") for i, c in enumerate(key)])
    joined = keyed.join(
        gone, F.col("__k0").eqNullSafe(F.col("__rid")) & (F.col("__k1") == F.col("__t1")) & (F.col("__k2") == F.col("__t2")), "left")
    parts = F.split(text_col, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: parts[i]), "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in names],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
