"""Statistics of reports: two-way tables, exact and stratified tests, characteristics, flow counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.columns import count_if, ladder, ratio
from dossier.functions.median import median_by


def log_factorial(n: Column) -> Column:
    """ln n!: exact product for small n, else the asymptotic series (error under 1e-10)."""
    x = n.cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    return F.when(n <= 16, F.ln(F.factorial(F.greatest(n, F.lit(0)).cast("int")).cast("double"))).otherwise(series)


def two_by_two(rows: DataFrame, group: str, flag: str) -> DataFrame:
    return rows.groupBy(F.col(group).alias("row_value"), F.col(flag).alias("column_value")).agg(F.count("*").alias("n"))


def cells(rows: DataFrame, group: Column, flag: Column, *by: str) -> DataFrame:
    """a, b, c, d of the table group x flag, one row or one per stratum."""
    g = {"a": group & flag, "b": group & ~flag, "c": ~group & flag, "d": ~group & ~flag}
    return rows.groupBy(*by).agg(*(count_if(c).alias(n) for n, c in g.items()))


def fisher(tables: DataFrame, key: str) -> DataFrame:
    """Two-sided exact p: the sum over all tables with the same margins that are no likelier than this one."""
    a, b, c, d = (F.col(x) for x in "abcd")
    support = F.sequence(F.greatest(F.lit(0).cast("long"), a + b - (b + d)), F.least(a + b, a + c))
    x = tables.select(key, "a", (a + b).alias("r1"), (c + d).alias("r2"), (a + c).alias("c1"), (a + b + c + d).alias("n"), F.explode(support).alias("_k"))

    def log_choose(n: Column, k: Column) -> Column:
        return log_factorial(n) - log_factorial(k) - log_factorial(n - k)

    def pmf(k: Column) -> Column:
        return F.exp(log_choose(F.col("r1"), k) + log_choose(F.col("r2"), F.col("c1") - k) - log_choose(F.col("n"), F.col("c1")))

    p = x.withColumn("p", pmf(F.col("_k"))).withColumn("seen", pmf(F.col("a")))
    return p.groupBy(key).agg(F.least(F.lit(1.0), F.sum(F.when(F.col("p") <= F.col("seen") * (1 + 1e-7), F.col("p")).otherwise(0.0))).alias("p_value"))


def cmh(strata: DataFrame) -> DataFrame:
    """Mantel-Haenszel statistic over strata (a, b, c, d each) and common odds ratio; strata of one row add nothing."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = F.nullif(a + b + c + d, F.lit(0.0))
    x = strata.select(
        (a - (a + b) * (a + c) / n).alias("excess"), F.when(n > 1, (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))).otherwise(0.0).alias("variance"), (a * d / n).alias("up"), (b * c / n).alias("down")
    )
    return x.agg(F.count("*").alias("strata"), (F.pow(F.sum("excess"), 2) / F.nullif(F.sum("variance"), F.lit(0.0))).alias("statistic"), (F.sum("up") / F.nullif(F.sum("down"), F.lit(0.0))).alias("odds_ratio"))


def characteristics(rows: DataFrame, value: str, *by: str) -> DataFrame:
    g = rows.groupBy(*by).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return g.join(median_by(rows, value, *by), list(by)).select(*by, "n", "median", "lowest", "highest")


def flow_categories(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Categories by pattern, which may overlap, with their share and whether they add up to the total."""
    g = rows.agg(F.count("*").alias("total"), *(count_if(F.lower(text).rlike(p)).alias(n) for n, p in patterns.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in patterns)))
    covered = sum((F.col(n) for n in patterns), F.lit(0))
    out = g.select("total", covered.alias("covered"), each.alias("c"))
    return out.select("c.category", "c.n", F.round(100.0 * F.col("c.n") / F.greatest("total", F.lit(1)), 1).alias("percent"), (F.col("covered") == F.col("total")).alias("adds_up"))


def cmh_exact(strata: DataFrame) -> DataFrame:
    """Two-sided exact p of the stratified test: how likely a sum of the first cells at least as far from its mean is.

    ``strata`` has a row for each stratum (a few), so one task convolves their hypergeometric distributions; tails under
    1e-18 of a stratum's peak add nothing and are cut, which leaves a length of about the square root of its count.
    """

    def exact(frame: pd.DataFrame) -> pd.DataFrame:
        total, low, seen, mean = np.ones(1), 0, 0, 0.0
        lf = np.vectorize(math.lgamma)
        for a, b, c, d in frame[["a", "b", "c", "d"]].astype(float).itertuples(index=False):
            r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
            if n == 0:
                continue
            k = np.arange(max(0.0, c1 - r2), min(r1, c1) + 1)
            log = lf(r1 + 1) - lf(k + 1) - lf(r1 - k + 1) + lf(r2 + 1) - lf(c1 - k + 1) - lf(r2 - c1 + k + 1) - (lf(n + 1) - lf(c1 + 1) - lf(n - c1 + 1))
            keep = np.flatnonzero(log > log.max() - 41.5)
            p = np.exp(log[keep[0] : keep[-1] + 1])
            total, low = np.convolve(total, p), low + int(k[keep[0]])
            seen, mean = seen + a, mean + r1 * c1 / n
        far = np.abs(np.arange(len(total)) + low - mean) >= abs(seen - mean) - 1e-9
        return pd.DataFrame({"strata": [len(frame)], "p_value": [min(1.0, float(total[far].sum()))]})

    return strata.select(*(F.col(x).cast("double").alias(x) for x in "abcd")).groupBy().applyInPandas(exact, "strata long, p_value double")


def weighted_cells(rows: DataFrame, group: Column, flag: Column, weight: Column, *by: str) -> DataFrame:
    """cells() of rows that stand for ``weight`` rows each."""
    g = {"a": group & flag, "b": group & ~flag, "c": ~group & flag, "d": ~group & ~flag}
    return rows.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(c, weight)), F.lit(0)).alias(n) for n, c in g.items()))


def marginals(rows: DataFrame, *flags: str) -> DataFrame:
    """Sums of ``count`` per agency and value of each flag, with its share in percent of the agency's total."""
    total = rows.groupBy("agency").agg(F.sum("count").alias("total"))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).alias("value")) for f in flags)))
    g = rows.select("agency", "count", each.alias("e")).groupBy("agency", "e.flag", "e.value").agg(F.sum("count").alias("n"))
    return g.join(total, "agency").select("agency", "flag", "value", "n", F.round(100.0 * F.col("n") / F.greatest("total", F.lit(1)), 1).alias("percent"))


# Reasons of an exclusion by pattern; they may overlap.
FLOW = {
    "baseline": r"(?i)\bbaseline\b", "implementation": r"(?i)\bimplementation\b|\bimplement\b", "methods": r"(?i)\bmethods?\b|\bmethodology\b", "not_group_randomized": r"(?i)not a group.{0,10}random|not group.{0,10}random", "pilot": r"(?i)\bpilot\b",
    "qualitative": r"(?i)\bqualitative\b", "secondary_data": r"(?i)secondary.{0,10}(?:data|analys)", "second_study": r"(?i)second.{0,5}study|same.{0,5}group", "stepped_wedge": r"(?i)stepped.{0,5}wedge", "review": r"(?i)\breview\b",
    "secondary_outcomes": r"(?i)secondary.{0,5}outcome",
}


def first_number(c: Column) -> Column:
    """The number that a cell begins with, up to a blank or one of ~/<>; null for cells that say it isn't reported."""
    text = F.trim(F.coalesce(c, F.lit("")))
    first = F.regexp_extract(text, r"^[ ~/<>]*([^ ~/<>]+)", 1)
    return F.when(~F.upper(text).isin("", ".", "NR", "UNKNOWN"), first.try_cast("double"))


def derive_design(rows: DataFrame) -> DataFrame:
    """Per paper of the review: excluded, correctness as numbers, whether randomisation was restricted, the design, and what each analysis ignored."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    kept = F.coalesce("exclude_reason", F.lit("")) == ""
    right = lambda c: ladder([(low(c) == "yes", 1), (low(c) == "no", 0)])
    x = rows.withColumn("excluded", F.when(kept, 0).otherwise(1)).withColumn("data_correct_n", right("data_correct")).withColumn("power_correct_n", right("power_correct"))
    x = x.withColumn("rr_flag", ladder([(~kept, ""), (low("restricted_rand").isin("none", "no", ""), "no")], "yes"))
    x = x.withColumn("design_type", ladder([(F.col("rr_flag") == "no", "Clustering alone"), (F.col("rr_flag") == "yes", "Clustering + RR")], ""))

    def ignored(flag: str, done: str) -> Column:
        f = F.col(flag)
        restricted = F.col("design_type") == "Clustering + RR"
        return ladder([(F.col("design_type") == "", ""), (f == 1, "correct"), (f.isNull(), ""), (~restricted, "ignored clustering"), (~F.contains(low(done), F.lit("clustering")), "ignored both")], "ignored RR only")

    return x.withColumn("ignored_data_c", ignored("data_correct_n", "data_done")).withColumn("ignored_power_c", ignored("power_correct_n", "power_done"))


def ignored_rows(rows: DataFrame, column: str) -> DataFrame:
    """What was ignored as rows of strata: one paper stands in up to two."""
    one = lambda stratum, flag: F.struct(F.lit(stratum).alias("stratum"), F.lit(flag).alias("ignored"))
    what, alone = F.col(column), F.col("design_type") == "Clustering alone"
    found = ladder([
        (what == "ignored clustering", F.array(one("Clustering alone", 1))), ((what == "correct") & alone, F.array(one("Clustering alone", 0))), (what == "correct", F.array(one("Ignored RR only", 0), one("Ignored both", 0))),
        (what == "ignored RR only", F.array(one("Ignored RR only", 1), one("Ignored both", 0))), (what == "ignored both", F.array(one("Ignored both", 1), one("Ignored RR only", 0))),
    ], F.array().cast("array<struct<stratum:string,ignored:int>>"))
    return rows.where("excluded = 0").select("paper_id", F.explode(found).alias("r")).select("paper_id", "r.stratum", "r.ignored")


def review_counts(rows: DataFrame) -> DataFrame:
    """The characteristics table: kinds of restriction, levels and stepped wedges among included papers, with their share in percent."""
    text, rr, levels = F.lower(F.coalesce("restricted_rand", F.lit(""))), F.col("rr_flag"), F.col("n_levels")
    has = lambda w: F.contains(text, F.lit(w))
    named = {
        "clustering_alone": F.col("design_type") == "Clustering alone", "clustering_rr": F.col("design_type") == "Clustering + RR", "stratified": has("stratif"), "constrained": has("constrain"), "paired": has("pair") | has("match"),
        "other_restriction": (rr == "yes") & ~has("stratif") & ~has("constrain") & ~has("pair") & ~has("match"), "levels_1": levels == 1, "levels_2": levels == 2, "levels_3": levels == 3, "levels_4_plus": levels >= 4, "levels_missing": levels.isNull(),
        "stepped_wedge": F.lower(F.trim(F.coalesce("stepped_wedge", F.lit("")))) == "yes",
    }
    g = rows.where("excluded = 0").agg(F.count("*").alias("total"), *(count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in named.items()))
    return g.select("total", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in named))).alias("x")).select("x.name", "x.n", F.round(100.0 * ratio(F.col("x.n"), F.greatest("total", F.lit(1))), 1).alias("percent"))


def flow_counts(rows: DataFrame) -> DataFrame:
    """Excluded papers by reason; baseline analyses of secondary data count as the latter only."""
    text = F.coalesce("exclude_reason", F.lit(""))
    match = {n: text.rlike(p) for n, p in FLOW.items()}
    match["baseline"] = match["baseline"] & ~text.rlike("(?i)secondary data")
    g = rows.where("excluded = 1").agg(*(count_if(c).alias(n) for n, c in match.items()))
    return g.select(F.explode(F.array(*(F.struct(F.lit(n).alias("category"), F.col(n).alias("n")) for n in match))).alias("x")).select("x.*")
