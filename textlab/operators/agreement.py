"""Agreement statistics: Cohen's kappa and rank/absolute agreement.

Both start with one distributed pass that collapses the rows into a joint
count table ``(a, b, n)`` (partial aggregation map-side, so a value holding a
third of all rows is reduced inside each map task).  Everything after that is
computed from the count table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from . import tables


def joint_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def two_passes(first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """(key, a, b) for the keys that both annotation passes hold.  Keys are
    unique within a pass; rows without a key meet nothing."""
    return (first.select(key, F.col(label).alias("a"))
            .join(second.select(key, F.col(label).alias("b")), key))


def disagreements(passes: DataFrame) -> DataFrame:
    """The rows of :func:`two_passes` that both label, and label differently."""
    return passes.where(F.col("a") != F.col("b"))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, observed agreement p_o, chance agreement p_e, kappa.

    kappa = (n·agree − Σ n_a·n_b) / (n² − Σ n_a·n_b), an exact integer ratio;
    null when p_e = 1 (Cohen 1960).  Rows where either label is null are
    dropped (both annotations are required).  One chain of aggregations: the
    joint counts are split into per-label marginals (each joint cell feeds
    its row label and its column label), then summed.
    """
    jc = joint_counts(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b)
    cells = jc.select(F.explode(F.array(
        F.struct(F.col("a").cast("string").alias("label"), F.col("n").alias("na"), F.lit(0).cast("long").alias("nb"),
                 F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("agree")),
        F.struct(F.col("b").cast("string").alias("label"), F.lit(0).cast("long").alias("na"), F.col("n").alias("nb"),
                 F.lit(0).cast("long").alias("agree")))).alias("c")).select("c.*")
    marg = cells.groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("agree").alias("agree"))
    j = marg.agg(F.sum("na").alias("n"), F.sum("agree").alias("agree"),
                 F.sum(F.col("na").cast("decimal(19,0)") * F.col("nb").cast("decimal(18,0)")).alias("chance"))
    n = F.col("n").cast("double")
    num = F.col("agree").cast("double") * n - F.col("chance").cast("double")
    den = n * n - F.col("chance").cast("double")
    return j.select(F.col("n").cast("long").alias("n"),
                    (F.col("agree") / n).alias("p_observed"),
                    (F.col("chance").cast("double") / (n * n)).alias("p_expected"),
                    F.when(den != 0, num / den).alias("kappa"))


def running_total(df: DataFrame, order_col: str, value_col: str, out_col: str,
                  partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value_col`` in ``order_col`` order, without a
    single-partition window (see :func:`tables.exclusive_running_sum`)."""
    return tables.exclusive_running_sum(df, [order_col], value_col, out_col, partitions)


def average_ranks(values: DataFrame, value_col: str, count_col: str = "n") -> DataFrame:
    """(value, rank): average rank of each distinct value with ties, from
    value counts -- rank = (#rows with a smaller value) + (count + 1) / 2."""
    rt = running_total(values, value_col, count_col, "_below")
    return rt.select(F.col(value_col), (F.col("_below") + (F.col(count_col) + 1) / 2.0).alias("rank"))


def rho_band(rho: Column) -> Column:
    expr = None
    for lo, name in P.RHO_BANDS:
        expr = F.when(rho >= lo, F.lit(name)) if expr is None else expr.when(rho >= lo, F.lit(name))
    return F.when(rho.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(F.lit(P.RHO_BAND_ELSE)))


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 10."""
    s = z + 10
    series = 1 / (12 * s) - 1 / (360 * s * s * s) + 1 / (1260 * s * s * s * s * s)
    down = z
    for k in range(1, 10):
        down = down * (z + k)
    return (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi) + series - F.log(down)


def incomplete_beta(a: Column, b: Column, x: Column, steps: int = 400) -> Column:
    """Regularised incomplete beta function by its continued fraction, which is
    evaluated front to back; for x above (a + 1) / (a + b + 2) from the other
    end, where it converges in about the square root of the larger parameter."""
    def tail(a, b, x):
        def term(k):  # k = 1, 2, ...: odd and even terms
            m = F.floor(k / 2)
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            return F.when(k % 2 == 1, odd).otherwise(even)

        def step(s, k):
            d = 1 / (1 + term(k) * s["d"])
            c = 1 + term(k) / s["c"]
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        start = F.struct(F.lit(1e300).alias("c"), F.lit(1.0).alias("d"), F.lit(1.0).alias("h"))  # the first term has no c
        h = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])
        front = log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x)
        return F.exp(front) * h / a

    inner = F.when(x < (a + 1) / (a + b + 2), tail(a, b, x)).otherwise(1 - tail(b, a, 1 - x))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)


def t_p_value(t: Column, freedom: Column) -> Column:
    """Two-sided tail of Student's t distribution; null without a degree of freedom."""
    v = freedom.cast("double")
    return F.when(v > 0, incomplete_beta(v / 2, F.lit(0.5), v / (v + t * t)))


def rank_agreement(df: DataFrame, judge: str, human: str) -> DataFrame:
    """Judge vs human scores, one row: n, means, Spearman rho (average ranks),
    t statistic and its two-sided p-value (0 for |rho| = 1), MAE, exact and within-1 rates, interpretation band, bias.

    Rows with a null on either side are dropped.  Constant input -> rho null.
    """
    jc = joint_counts(df.where(F.col(judge).isNotNull() & F.col(human).isNotNull()), judge, human)
    ra = average_ranks(jc.groupBy("a").agg(F.sum("n").alias("n")), "a").withColumnRenamed("rank", "ra")
    rb = average_ranks(jc.groupBy("b").agg(F.sum("n").alias("n")), "b").withColumnRenamed("rank", "rb")
    # joint table x rank tables: the rank tables have one row per distinct value
    j = jc.join(ra, "a").join(rb, "b")
    n = F.col("n")
    s = j.agg(
        F.sum(n).alias("n"),
        F.sum(n * F.col("a")).alias("sa"), F.sum(n * F.col("b")).alias("sb"),
        F.sum(n * F.col("ra")).alias("sx"), F.sum(n * F.col("rb")).alias("sy"),
        F.sum(n * F.col("ra") * F.col("ra")).alias("sxx"),
        F.sum(n * F.col("rb") * F.col("rb")).alias("syy"),
        F.sum(n * F.col("ra") * F.col("rb")).alias("sxy"),
        F.sum(n * F.abs(F.col("a") - F.col("b"))).alias("sabs"),
        F.sum(F.when(F.col("a") == F.col("b"), n).otherwise(0)).alias("nexact"),
        F.sum(F.when(F.abs(F.col("a") - F.col("b")) <= 1, n).otherwise(0)).alias("nwithin"))
    N = F.col("n").cast("double")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / N
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / N
    vy = F.col("syy") - F.col("sy") * F.col("sy") / N
    rho = F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    out = s.select(
        F.col("n").cast("long").alias("n"),
        (F.col("sa") / N).alias("judge_mean"), (F.col("sb") / N).alias("human_mean"),
        rho.alias("rho"),
        (F.col("sabs") / N).alias("mae"),
        (F.col("nexact") / N).alias("exact"),
        (F.col("nwithin") / N).alias("within1"))
    t = F.when(F.abs(F.col("rho")) < 1,
               F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho"))))
    bias = (F.when(F.col("judge_mean") > F.col("human_mean") + P.BIAS_MARGIN, F.lit("generous"))
            .when(F.col("judge_mean") < F.col("human_mean") - P.BIAS_MARGIN, F.lit("harsh"))
            .otherwise(F.lit("close")))
    out = out.withColumn("t_stat", t)
    p = (F.when(F.abs(F.col("rho")) >= 1, F.when(F.col("n") > 2, F.lit(0.0)))
         .otherwise(t_p_value(F.col("t_stat"), F.col("n") - 2)))
    return out.select("*", p.alias("p_value"), rho_band(F.col("rho")).alias("band"), bias.alias("bias"))
