"""Descriptive tables, tests, regressions, tree models and their checks, over wallet-level rows."""

from __future__ import annotations

from functools import reduce
from math import erf, exp, lgamma, log, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.ranks import exact_quantiles, numbered, places, with_quantiles
from tessera.sources.tables import saved

QS = [0.05, 0.25, 0.5, 0.75, 0.95]


def t_tail(t: float | None, df: float) -> float | None:
    """Two-sided tail of Student's t: the regularised incomplete beta function, by its continued fraction."""
    if t is None or t != t or df <= 0:
        return None
    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front / b * _fraction(b, a, 1 - x)
    return front / a * _fraction(a, b, x)


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def normal_tail(z: float | None) -> float | None:
    """Two-sided tail of the normal distribution."""
    return None if z is None or z != z else 1 - erf(abs(z) / sqrt(2))


def unpivoted(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    """ids, col, v: one row for each column's value."""
    return df.select(*ids, F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(*ids, "x.*")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """col, n, mean, std, least, quantiles, greatest, shares of positive and negative values."""
    v = F.col("v")
    long = unpivoted(df, [], cols).filter(v.isNotNull())
    rows = long.groupBy("col").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg((v > 0).cast("int")).alias("share_pos"), F.avg((v < 0).cast("int")).alias("share_neg"))
    rows = rows.join(exact_quantiles(long, ["col"], "v", QS).withColumnRenamed("q", "_q"), "col")
    return rows.select("col", "n", "mean", "std", "min", *[F.col("_q")[i].alias(f"p{int(q * 100):02d}") for i, q in enumerate(QS)], "max", "share_pos", "share_neg")


def versus(df: DataFrame, base: str, cols: list[str], same: dict[str, str] | None = None, tol: float = 0.02) -> DataFrame:
    """strategy, n, shares that win, tie and lose against a base, mean and median difference: a row for each strategy, with n 0 and nulls if no row has both.

    same names, for a strategy, the column with its distance to the base; within tol the two count as one portfolio: a tie.
    """
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "strategy string")
    pairs = F.array(*[F.struct(F.lit(c).alias("strategy"), F.col(c).alias("v"), (F.col(same[c]) if same and c in same else F.lit(None).cast("double")).alias("l1")) for c in cols])
    rows = df.select(F.col(base).alias("b"), F.explode(pairs).alias("x")).select("b", "x.*").filter("b IS NOT NULL AND v IS NOT NULL").withColumn("diff", F.col("v") - F.col("b"))
    tie, diff = F.coalesce(F.col("l1") <= tol, F.lit(False)) | (F.col("v") == F.col("b")), F.col("diff")
    shares = rows.groupBy("strategy").agg(F.count("*").alias("n"), F.avg((~tie & (diff > 0)).cast("int")).alias("win"), F.avg(tie.cast("int")).alias("tie"), F.avg((~tie & (diff < 0)).cast("int")).alias("loss"), F.avg(diff).alias("mean_diff"))
    shares = with_quantiles(shares, rows, ["strategy"], {"median_diff": ("diff", 0.5)})
    return names.join(shares, "strategy", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hit_rate(df: DataFrame, keys: list[str], base: str, col: str, distance: str, tol: float = 0.02) -> DataFrame:
    """keys, n, hit_rate, tie: the share of rows where col beats base, a tie counting half; portfolios within tol of each other are one, so a tie."""
    rows = df.filter(F.col(base).isNotNull() & F.col(col).isNotNull())
    tie = F.coalesce(F.col(distance) <= tol, F.lit(False)) | (F.col(col) == F.col(base))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(tie, 0.5).when(F.col(col) > F.col(base), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(tie.cast("int")).alias("tie"))


def beat_margin(df: DataFrame, keys: list[str], strategies: list[str], bench: str, qs: list[float]) -> DataFrame:
    """keys, strategy, n, share that beats the benchmark, and quantiles of the margin."""
    rows = unpivoted(df, [*keys, bench], strategies).withColumn("m", F.col("v") - F.col(bench)).filter("m IS NOT NULL").withColumnRenamed("col", "strategy")
    by = [*keys, "strategy"]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("m") > 0).cast("int")).alias("beat")).join(exact_quantiles(rows, by, "m", qs), by)
    return out.select(*by, "n", "beat", F.posexplode("q").alias("_i", "margin")).withColumn("q", F.array(*map(F.lit, qs))[F.col("_i")]).drop("_i")


def average_ranks(df: DataFrame, col: str, into: str, keys: list[str] | None = None) -> DataFrame:
    """df with the rank of col, ties sharing their mean: the places of its values, dealt by magnitude, joined back; no task sorts all values of a key."""
    keys = keys or []
    ranks = places(df, keys, col).select(*keys, col, (F.col("_end") - (F.col("_c") - 1) / 2).alias(into))
    return df.join(ranks, [*keys, col])


def least_correlation(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """keys, n and the least correlation of any two of the columns, over the rows of each key; null where no pair has one."""
    pairs = [F.corr(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    # A column that does not vary has no correlation.
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.nanvl(c, F.lit(None).cast("double")).alias(f"_c{i}") for i, c in enumerate(pairs)])
    names = [f"_c{i}" for i in range(len(pairs))]
    return found.withColumn("least", F.array_min(F.array(*names))).drop(*names)


def spearman(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Rank correlation of two columns over the rows that have both."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(rows, x, "_rx", keys), y, "_ry", keys)
    return ranked.groupBy(*(keys or [])).agg(F.corr("_rx", "_ry").alias("rho"), F.count("*").alias("n"))


def paired_tests(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: paired t with its p-value, Cohen's d, and Wilcoxon's signed-rank statistic with its normal approximation under ties and that one's p-value.

    Of no pairs n and w_plus are 0, all else is null. The result's single row goes through the driver for its tails.
    """
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).alias("d"))
    moments = rows.agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), F.stddev("d").alias("sd"))
    signed = average_ranks(rows.filter("d <> 0").withColumn("_a", F.abs("d")), "_a", "_r")
    ranks = signed.agg(F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("_r")).otherwise(0.0)), F.lit(0.0)).alias("w_plus"), F.count("*").alias("m"))
    ties = rows.filter("d <> 0").groupBy(F.abs("d").alias("_a")).agg(F.count("*").alias("t")).agg(F.coalesce(F.sum(F.pow("t", F.lit(3)) - F.col("t")), F.lit(0.0)).alias("ties"))
    out = moments.crossJoin(ranks).crossJoin(ties)  # one row each
    m, t = F.col("m"), F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))
    spread = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48)
    row = out.select("n", "mean_diff", t.alias("t"), F.try_divide("mean_diff", "sd").alias("cohen_d"), "w_plus", F.try_divide(F.col("w_plus") - m * (m + 1) / 4, spread).alias("z")).first()
    schema = "n long, mean_diff double, t double, cohen_d double, w_plus double, z double, p_t double, p_wilcoxon double"
    return df.sparkSession.createDataFrame([(*row, t_tail(row.t, row.n - 1), normal_tail(row.z))], schema)


def distance_thresholds(df: DataFrame, snapshot: str, n: str, value: str, cuts: tuple[int, ...] = (3, 4, 5, 6, 7)) -> DataFrame:
    """threshold and paired_tests of the snapshots' means of value below and from each threshold of n."""
    parts = []
    for k in cuts:
        means = df.groupBy(snapshot).agg(F.round(F.avg(F.when(F.col(n) < k, F.col(value))), 9).alias("a"), F.round(F.avg(F.when(F.col(n) >= k, F.col(value))), 9).alias("b"))
        parts.append(paired_tests(means, "a", "b").select(F.lit(k).alias("threshold"), "*"))
    return reduce(DataFrame.unionByName, parts)


def winsorise(df: DataFrame, keys: list[str], cols: list[str], q: float = 0.05) -> DataFrame:
    """cols clipped at their quantiles q and 1 - q, over all rows or within keys; null stays null."""
    joined = df
    for c in cols:
        cuts = saved(exact_quantiles(df, keys, c, [q, 1 - q]).withColumnRenamed("q", f"_q_{c}"), "cuts")
        joined = joined.join(cuts, keys, "left") if keys else joined.crossJoin(F.broadcast(cuts))  # one row
    clip = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(f"_q_{c}")[0], F.least(F.col(f"_q_{c}")[1], F.col(c)))) for c in cols}
    return joined.withColumns(clip).drop(*[f"_q_{c}" for c in cols])


def normal_equations(rows: DataFrame, terms: list[str], y: str, weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(X'WX, X'Wy, y'Wy, rows) in one aggregation."""
    p, w = len(terms), F.lit(1.0) if weight is None else weight
    sums = rows.withColumn("_w", w).agg(*[F.sum(F.col("_w") * F.col(terms[i]) * F.col(terms[j])).alias(f"x{i}_{j}") for i in range(p) for j in range(i, p)], *[F.sum(F.col("_w") * F.col(t) * F.col(y)).alias(f"y{i}") for i, t in enumerate(terms)], F.sum(F.col("_w") * F.col(y) * F.col(y)).alias("yy"), F.count("*").alias("n")).first()
    a = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            a[i, j] = a[j, i] = sums[f"x{i}_{j}"] or 0.0
    return a, np.array([sums[f"y{i}"] or 0.0 for i in range(p)]), sums["yy"] or 0.0, sums["n"]


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """term, coef, std_error, t, p, and r2, adj_r2 and n, by normal equations: one aggregation of products, a small system on the driver.

    Of no rows, n is 0 and all else null; a constant y has no r2.
    """
    terms = ["const", *xs]
    rows = df.select(F.lit(1.0).alias("const"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).na.drop()
    a, b, yy, n = normal_equations(rows, terms, y)
    schema = "term string, coef double, std_error double, t double, p double, r2 double, adj_r2 double, n long"
    if not n:
        return df.sparkSession.createDataFrame([(t, None, None, None, None, None, None, 0) for t in terms], schema)
    inverse = np.linalg.pinv(a)
    coef, p = inverse @ b, len(terms)
    rss, tss = max(yy - coef @ b, 0.0), yy - b[0] ** 2 / n
    r2 = float(1 - rss / tss) if tss > 0 else None
    adjusted = 1 - (1 - r2) * (n - 1) / (n - p) if r2 is not None and n > p else None
    error = np.sqrt(np.maximum(np.diag(inverse) * rss / (n - p), 0)) if n > p else [None] * p
    out = []
    for term, c, e in zip(terms, coef, error, strict=True):
        t = float(c / e) if e else None
        out.append((term, float(c), None if e is None else float(e), t, t_tail(t, n - p), r2, adjusted, n))
    return df.sparkSession.createDataFrame(out, schema)


#: Rows of a quantile regression that the driver solves at a time.
BAND = 20_000


def vertex(x: np.ndarray, y: np.ndarray, w: np.ndarray, q: float, pull: np.ndarray) -> np.ndarray | None:
    """The coefficients b that minimise sum w rho_q(y - x b) + pull b, by exchanging one of the rows that the fit passes through at a time; None if there is no least value."""
    n, p = x.shape
    if n < p:
        return None
    y = y + 1e-11 * (np.abs(y).max() or 1.0) * np.random.default_rng(0).random(n)  # no two rows tie
    start = np.linalg.lstsq(x * w[:, None] ** 0.5, y * w**0.5, rcond=None)[0]
    basis: list[int] = []
    rest = np.zeros((0, p))
    for i in np.argsort(np.abs(y - x @ start), kind="stable"):
        if np.linalg.matrix_rank(np.vstack([rest, x[i]])) > len(basis):
            basis, rest = [*basis, int(i)], np.vstack([rest, x[i]])
            if len(basis) == p:
                break
    if len(basis) < p:
        return None
    for _ in range(50 * p + 20 * int(np.sqrt(n)) + 200):
        inverse = np.linalg.inv(x[basis])
        b = inverse @ y[basis]
        r = y - x @ b
        r[basis] = 0
        u = inverse.T @ (pull - (w * np.where(r > 0, q, np.where(r < 0, q - 1, 0))) @ x)
        over, under = u - q * w[basis], (q - 1) * w[basis] - u
        worst = int(np.argmax(np.maximum(over, under)))
        if max(over[worst], under[worst]) <= 1e-9 * w.sum():
            return b
        step = -inverse[:, worst] if over[worst] >= under[worst] else inverse[:, worst]
        slope, along = -max(over[worst], under[worst]), x @ step
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where((np.abs(along) > 1e-14) & (r * along > 0), r / along, np.inf)
        order = np.argsort(t, kind="stable")[: int(np.isfinite(t).sum())]
        passed = np.flatnonzero(slope + np.cumsum(w[order] * np.abs(along[order])) >= 0)
        if not len(passed):
            return None
        basis[worst] = int(order[passed[0]])
    return None


def quantile_coefficients(rows: DataFrame, terms: list[str], y: str, q: float, n: int, band: int = BAND) -> tuple[np.ndarray, bool, int]:
    """(coefficients, whether they are the optimum, passes over the rows) of a quantile regression over n rows.

    A sample is solved; rows far from its fit keep their side and count as sums alone, those in a band about it are solved
    anew, and the fit stands once every far row is on the side that it was given. A band of more than ``band`` rows is
    solved on a sample of them first, which narrows it.
    """

    def fitted(b: np.ndarray) -> Column:
        return F.col(y) - reduce(lambda acc, t: acc + F.lit(float(t[1])) * F.col(t[0]), zip(terms, b, strict=True), F.lit(0.0))

    def taken(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = df.select(*terms, y).toArrow()
        return np.column_stack([table[t].to_numpy() for t in terms]), table[y].to_numpy()

    hashed = F.xxhash64(*terms, y, F.lit(13))
    few = rows if n <= band else rows.filter(F.abs(hashed % (1 << 30)) < int(band * 0.8 / n * (1 << 30)))
    x, v = taken(few)
    none = np.zeros(len(terms))
    b, passes = vertex(x, v, np.ones(len(v)), q, none), 1
    if b is None:
        return (np.linalg.pinv(x) @ v if len(v) else none), False, passes
    if n <= band:
        return b, True, passes
    share = max(4 * np.sqrt(len(terms) / len(v)), 0.25 * band / n)
    for _ in range(12):
        half = float(np.quantile(np.abs(v - x @ b), min(share, 1.0)))
        e = fitted(b)
        inside = F.abs(e) <= half
        sides = rows.agg(F.count_if(inside).alias("m"), *[F.sum(F.when(e > half, F.col(t)).otherwise(0.0)).alias(f"a{i}") for i, t in enumerate(terms)], *[F.sum(F.when(e < -half, F.col(t)).otherwise(0.0)).alias(f"b{i}") for i, t in enumerate(terms)]).first()
        k = range(len(terms))
        pull = -q * np.array([sides[f"a{i}"] for i in k]) + (1 - q) * np.array([sides[f"b{i}"] for i in k])
        whole = sides.m <= band
        near = rows.filter(inside) if whole else rows.filter(inside & (F.abs(hashed % (1 << 30)) < int(band * 0.8 / sides.m * (1 << 30))))
        xs, vs = taken(near)
        passes += 2
        # pull is the gradient of the far rows' share of the loss; the solver wants it as a linear term.
        new = vertex(xs, vs, np.full(len(vs), 1.0 if whole else sides.m / max(len(vs), 1)), q, pull)
        if new is None:
            share *= 3
            continue
        if not whole:
            x, v, b, share = xs, vs, new, max(8 * np.sqrt(len(terms) / len(vs)) , 0.25 * band / sides.m)
            continue
        after = fitted(new)
        wrong = rows.agg(F.count_if((e > half) & (after < 0) | (e < -half) & (after > 0))).first()[0]
        passes += 1
        if not wrong:
            return new, True, passes
        b, share = new, share * 2
    return b, False, passes


def quantile_reg(df: DataFrame, y: str, xs: list[str], q: float, band: int = BAND) -> DataFrame:
    """term, coef, std_error, t, p of a quantile regression at its exact optimum, and whether that was reached (settled).

    Errors are of the sandwich form: the density of residuals at zero by an Epanechnikov kernel, its width by Hall and
    Sheather's rule. Of no rows all is null.
    """
    terms = ["const", *xs]
    rows = df.select(F.lit(1.0).alias("const"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)]).na.drop().persist()
    spread = rows.agg(F.stddev(y), F.count("*")).first()
    scale, n, p = spread[0] or 1.0, spread[1], len(terms)
    schema = "term string, coef double, std_error double, t double, p double, settled boolean, n long"
    if not n:
        return df.sparkSession.createDataFrame([(t, None, None, None, None, None, 0) for t in terms], schema)

    def residual(coef: np.ndarray) -> Column:
        return F.col(y) - reduce(lambda acc, x: acc + F.lit(float(x[1])) * F.col(x[0]), zip(terms, coef, strict=True), F.lit(0.0))

    coef, settled, _ = quantile_coefficients(rows, terms, y, q, n, band)
    left = rows.withColumn("_e", residual(coef))
    quarters = exact_quantiles(left, [], "_e", [0.25, 0.75]).first().q
    normal = NormalDist()
    z, tail = normal.inv_cdf(q), normal.inv_cdf(0.975)
    width = n ** (-1 / 3) * tail ** (2 / 3) * (1.5 * normal.pdf(z) ** 2 / (2 * z * z + 1)) ** (1 / 3)
    width = min(width, q - 1e-6, 1 - q - 1e-6)
    h = min(scale, (quarters[1] - quarters[0]) / 1.34 or scale) * (normal.inv_cdf(q + width) - normal.inv_cdf(q - width))
    u = F.col("_e") / F.lit(float(h))
    density = left.agg(F.sum(F.when(F.abs(u) <= 1, 0.75 * (1 - u * u)).otherwise(0.0))).first()[0] / (n * h)
    errors: list[float | None] = [None] * p
    if density:
        whole, _, _, _ = normal_equations(left, terms, y)
        middle, _, _, _ = normal_equations(left, terms, y, F.when(F.col("_e") > 0, (q / density) ** 2).otherwise(((1 - q) / density) ** 2))
        inverse = np.linalg.pinv(whole)
        errors = [float(x) for x in np.sqrt(np.maximum(np.diag(inverse @ middle @ inverse), 0))]
    rows.unpersist()
    out = []
    for term, c, e in zip(terms, coef, errors, strict=True):
        t = float(c) / e if e else None
        out.append((term, float(c), e, t, t_tail(t, n - p), settled, n))
    return df.sparkSession.createDataFrame(out, schema)


def forest(df: DataFrame, y: str, xs: list[str], seed: int = 7, trees: int = 20, depth: int = 6):
    """(model, table of feature, importance, r2 and mae on the held-out fifth); without rows to fit or to hold out the model is None and all else null."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=xs, outputCol="features").transform(df.select(*xs, F.col(y).cast("double").alias("label")).na.drop()).persist()
    held = F.pmod(F.xxhash64(*xs, "label"), F.lit(5)) == 0
    schema = "feature string, importance double, r2 double, mae double"
    if rows.filter(~held).isEmpty() or rows.filter(held).isEmpty():
        return None, df.sparkSession.createDataFrame([(x, None, None, None) for x in xs], schema)
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(rows.filter(~held))
    scored = model.transform(rows.filter(held))
    r2, mae = (RegressionEvaluator(metricName=m).evaluate(scored) for m in ("r2", "mae"))
    rows.unpersist()
    out = [(x, float(v), float(r2), float(mae)) for x, v in zip(xs, model.featureImportances.toArray(), strict=True)]
    return model, df.sparkSession.createDataFrame(out, schema)


def permutation_importance(model, df: DataFrame, y: str, xs: list[str], seed: int = 7, repeats: int = 3) -> DataFrame:
    """feature, mean and standard deviation over repeats of the drop in r2 when its values are dealt to other rows, by pairing two orders of the rows by hash; null without a model."""
    if model is None:
        return df.sparkSession.createDataFrame([(x, None, None) for x in xs], "feature string, drop double, spread double")
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler

    rows = df.select(*xs, F.col(y).cast("double").alias("label")).na.drop().persist()
    score = lambda d: RegressionEvaluator(metricName="r2").evaluate(model.transform(VectorAssembler(inputCols=xs, outputCol="features").transform(d)))
    dealt = numbered(rows, F.xxhash64(*xs, "label", F.lit(seed))).persist()
    n, whole = dealt.count(), score(rows)
    out = []
    for i, x in enumerate(xs):
        drops = []
        for k in range(repeats):
            moved = dealt.select(F.col(x).alias("_x"), (F.pmod(F.col("_n") + F.lit(1 + (i + 1) * (n // 3 + 1) + k * (n // 7 + 1)), F.lit(n)) + 1).alias("_n"))
            drops.append(float(whole - score(dealt.join(moved, "_n").withColumn(x, F.col("_x")))))
        out.append((x, float(np.mean(drops)), float(np.std(drops))))
    dealt.unpersist()
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, "feature string, drop double, spread double")


def _forest_scores(train: DataFrame, test: DataFrame, y: str, xs: list[str], trees: int, depth: int, seed: int) -> tuple[DataFrame, dict]:
    """(test with prediction, r2 against the training mean, mae, rows) of a forest."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    assembled = VectorAssembler(inputCols=xs, outputCol="_features")
    model = RandomForestRegressor(featuresCol="_features", labelCol=y, predictionCol="_fit", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled.transform(train))
    mean = train.agg(F.avg(y)).first()[0]
    scored = model.transform(assembled.transform(test)).drop("_features")
    s = scored.agg(F.sum(F.pow(F.col(y) - F.col("_fit"), 2)).alias("rss"), F.sum(F.pow(F.col(y) - F.lit(mean), 2)).alias("tss"), F.avg(F.abs(F.col(y) - F.col("_fit"))).alias("mae"), F.count("*").alias("n")).first()
    return scored, {"r2": float(1 - s.rss / s.tss) if s.tss else None, "mae": s.mae, "n": s.n}


def between_r2(scored: DataFrame, y: str, group: str) -> float | None:
    """r2 of the groups' mean predictions against their mean outcomes, each group counting once."""
    means = scored.groupBy(group).agg(F.avg(y).alias("y"), F.avg("_fit").alias("f"))
    s = means.agg(F.sum(F.pow(F.col("y") - F.col("f"), 2)).alias("rss"), (F.var_pop("y") * F.count("*")).alias("tss")).first()
    return float(1 - s.rss / s.tss) if s.tss else None


def grouped_cv(df: DataFrame, y: str, xs: list[str], group: str, folds: int = 5, trees: int = 20, depth: int = 6, seed: int = 7) -> DataFrame:
    """fold, n, r2, mae of a forest, and in each row the r2 over all out-of-fold predictions and that between the groups' means.

    Whole groups (months) fall into one fold, dealt in the order of their hash; one row per group is ranked. A fold whose
    rows, or whose complement, are none has no row.
    """
    order = W.orderBy(F.crc32(F.col(group).cast("string").cast("binary")), group)
    dealt = saved(df.select(group).distinct().withColumn("_f", F.row_number().over(order) % folds), "folds")
    rows = df.select(group, F.col(y).cast("double").alias(y), *xs).na.drop().join(dealt, group).persist()  # each fold reads it several times
    sizes = {r["_f"]: r["count"] for r in rows.groupBy("_f").count().collect()}
    out, parts = [], []
    for f in (f for f in range(folds) if 0 < sizes.get(f, 0) < sum(sizes.values())):
        scored, found = _forest_scores(rows.filter(F.col("_f") != f), rows.filter(F.col("_f") == f), y, xs, trees, depth, seed)
        parts.append(scored.select(group, y, "_fit"))
        out.append((f, found["n"], found["r2"], found["mae"]))
    schema = "fold int, n long, r2 double, mae double, oof_r2 double, between_r2 double"
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    every = reduce(DataFrame.unionByName, parts).persist()
    s = every.agg(F.sum(F.pow(F.col(y) - F.col("_fit"), 2)).alias("rss"), (F.var_pop(y) * F.count("*")).alias("tss")).first()
    whole, between = float(1 - s.rss / s.tss) if s.tss else None, between_r2(every, y, group)
    every.unpersist()
    rows.unpersist()
    return df.sparkSession.createDataFrame([(*row, whole, between) for row in out], schema)


def forward_chain(df: DataFrame, y: str, xs: list[str], year: str, group: str | None = None, trees: int = 20, depth: int = 6, seed: int = 7) -> DataFrame:
    """year, n, r2, mae and, of groups (months) within it, between_r2 of a forest trained on all years before and tested on the year."""
    rows = df.select(*dict.fromkeys([year, *([group] if group else [])]), F.col(y).cast("double").alias(y), *xs).na.drop().persist()
    years = sorted(r[0] for r in rows.select(year).distinct().collect())
    out = []
    for t in years[1:]:
        scored, found = _forest_scores(rows.filter(F.col(year) < t), rows.filter(F.col(year) == t), y, xs, trees, depth, seed)
        out.append((t, found["n"], found["r2"], found["mae"], between_r2(scored, y, group) if group else None))
    rows.unpersist()
    return df.sparkSession.createDataFrame(out, f"{year} int, n long, r2 double, mae double, between_r2 double")


def variance_shares(df: DataFrame, key: str, y: str) -> DataFrame:
    """One row: shares of y's variance between and within groups, weighted by rows and by groups."""
    groups = df.filter(F.col(y).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    total = groups.agg(F.sum("n").alias("whole"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean_rows"), F.avg("m").alias("mean_groups"))
    rows = groups.crossJoin(F.broadcast(total)).agg((F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean_rows"), 2)) / F.max("whole")).alias("between"), (F.sum(F.col("n") * F.col("v")) / F.max("whole")).alias("within"), F.avg(F.pow(F.col("m") - F.col("mean_groups"), 2)).alias("between_g"), F.avg("v").alias("within_g"))
    b, w, bg, wg = (F.col(c) for c in ("between", "within", "between_g", "within_g"))
    return rows.select(F.try_divide(b, b + w).alias("between_rows"), F.try_divide(w, b + w).alias("within_rows"), F.try_divide(bg, bg + wg).alias("between_groups"), F.try_divide(wg, bg + wg).alias("within_groups"))


def demean(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """df with each column less its mean within keys, as <col>_dm."""
    means = saved(df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols]), "means")
    return df.join(means, keys).withColumns({f"{c}_dm": F.col(c) - F.col(f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def power_fit(df: DataFrame, keys: list[str], n: str, d: str, weight: str, grid: list[float] | None = None) -> DataFrame:
    """keys, a, b, c, sse, r2, mae of d = c - a * n^-b with c at most 100: for each b of a grid a closed weighted fit, the least error kept."""
    grid = grid or [i / 20 for i in range(1, 61)]
    x, y, w = F.pow(F.col(n).cast("double"), -F.col("b")), F.col(d), F.col(weight).cast("double")
    rows = df.withColumn("b", F.explode(F.array(*map(F.lit, grid))))
    s = rows.groupBy(*keys, "b").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"), F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy"), F.sum(w * y * y).alias("wyy"))
    det = F.col("w") * F.col("wxx") - F.col("wx") * F.col("wx")
    slope = F.try_divide(F.col("w") * F.col("wxy") - F.col("wx") * F.col("wy"), det)
    level = (F.col("wy") - slope * F.col("wx")) / F.col("w")
    a = F.when(level > 100, (100 * F.col("wx") - F.col("wxy")) / F.col("wxx")).otherwise(-slope)
    c = F.least(F.lit(100.0), level)
    sse = F.col("wyy") - 2 * c * F.col("wy") + 2 * a * F.col("wxy") + c * c * F.col("w") - 2 * a * c * F.col("wx") + a * a * F.col("wxx")
    fitted = s.filter(det > 1e-12).select(*keys, "b", a.alias("a"), c.alias("c"), sse.alias("sse"), (F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")).alias("tss"))
    best = fitted.groupBy(*keys).agg(F.min_by(F.struct("a", "b", "c", "sse", "tss"), F.struct("sse", "b")).alias("x"))
    best = best.select(*keys, "x.a", "x.b", "x.c", "x.sse", (1 - F.try_divide(F.col("x.sse"), F.col("x.tss"))).alias("r2"))
    off = F.abs(y - (F.col("c") - F.col("a") * F.pow(F.col(n).cast("double"), -F.col("b"))))
    return best.join(df.join(best, keys).groupBy(*keys).agg((F.sum(w * off) / F.sum(w)).alias("mae")), keys)


def best_strategy(df: DataFrame, cols: list[str], tol: float = 0.0) -> DataFrame:
    """strategy, share of rows where it is at least as good as all others."""
    top = F.greatest(*cols)
    row = df.na.drop(subset=cols).agg(F.count("*").alias("n"), *[F.avg((F.col(c) >= top - tol).cast("int")).alias(c) for c in cols])
    return row.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("strategy"), F.col(c).alias("share")) for c in cols])).alias("x")).select("x.*", "n")


def direction(df: DataFrame, pairs: list[tuple[str, str]], tol: float = 0.001) -> DataFrame:
    """pair, n, shares of rows where the second is closer (less), farther, or unchanged against the first: a row for each pair, with n 0 and nulls if no row has both."""
    names = df.sparkSession.createDataFrame([(f"{a}>{b}",) for a, b in pairs], "pair string")
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(f"{a}>{b}").alias("pair"), (F.col(b) - F.col(a)).alias("d")) for a, b in pairs])).alias("x")).select("x.*").filter("d IS NOT NULL")
    shares = rows.groupBy("pair").agg(F.count("*").alias("n"), F.avg((F.col("d") < -tol).cast("int")).alias("closer"), F.avg((F.col("d") > tol).cast("int")).alias("farther"), F.avg((F.abs("d") <= tol).cast("int")).alias("unchanged"))
    return names.join(shares, "pair", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def change_by_n(df: DataFrame, n: str, before: str, after: str, most: int = 30, least_rows: int = 200) -> DataFrame:
    """n, rows, mean and median change from before to after, and the share of rows that come closer to 1, of sizes up to ``most`` with enough rows."""
    rows = df.filter((F.col(n) <= most) & F.col(before).isNotNull() & F.col(after).isNotNull()).withColumn("_d", F.col(after) - F.col(before))
    out = rows.groupBy(n).agg(F.count("*").alias("rows"), F.avg("_d").alias("mean_change"), F.avg((F.abs(F.col(after) - 1) < F.abs(F.col(before) - 1)).cast("int")).alias("share_closer"))
    return with_quantiles(out.filter(F.col("rows") >= least_rows), rows, [n], {"median_change": ("_d", 0.5)})


def accuracy(joined: DataFrame, ours: str, truth: str, tol: float, by: list[str]) -> DataFrame:
    """by: rows, exact, within tolerance, median, 95th percentile and greatest relative error, and how many lie over and under."""
    a, t = F.col(ours).cast("double"), F.col(truth).cast("double")
    error = F.when(t == 0, F.when(a == 0, 0.0).otherwise(1.0)).otherwise(F.abs(a - t) / F.abs(t))
    rows = joined.withColumn("_e", error)
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col(ours) == F.col(truth)).alias("exact"), F.count_if(F.col("_e") <= tol).alias("within"), F.max("_e").alias("max_error"), F.count_if(a > t).alias("n_over"), F.count_if(a < t).alias("n_under"))
    return with_quantiles(counts, rows, by, {"median_error": ("_e", 0.5), "p95_error": ("_e", 0.95)})


def coverage_stats(df: DataFrame, snapshot: str, cols: list[str]) -> DataFrame:
    """One row: rows, snapshots, and each column's share of values, mean and median."""
    counts = df.agg(F.count("*").alias("n_rows"), F.countDistinct(snapshot).alias("n_snapshots"), *[x for c in cols for x in (F.avg(F.col(c).isNotNull().cast("int")).alias(f"share_{c}"), F.avg(c).alias(f"mean_{c}"))])
    return with_quantiles(counts, df, [], {f"median_{c}": (c, 0.5) for c in cols})


def over_snapshots(df: DataFrame, keys: list[str], stat: str) -> DataFrame:
    """keys, median, 1st plus 99th percentile (a skew), and number of a per-snapshot statistic."""
    return df.groupBy(*keys).agg(F.median(stat).alias("median"), (F.percentile(stat, F.lit(0.99)) + F.percentile(stat, F.lit(0.01))).alias("skew"), F.count(stat).alias("n"))


def minmax(df: DataFrame, key: list[str], col: str) -> DataFrame:
    """df with col clipped to its 5th to 95th percentile within key and scaled to 0..1."""
    cuts = saved(exact_quantiles(df, key, col, [0.05, 0.95]).withColumnRenamed("q", "_q"), "cuts")
    lo, hi = F.col("_q")[0], F.col("_q")[1]
    joined = df.join(cuts, key) if key else df.crossJoin(F.broadcast(cuts))  # one row
    return joined.withColumn(f"{col}_scaled", F.try_divide(F.greatest(lo, F.least(hi, F.col(col))) - lo, hi - lo)).drop("_q")


def smallest_portfolios(df: DataFrame, n: str, distance: str) -> DataFrame:
    """One row: the least and the most frequent number of assets, and the share at distance 0 among portfolios of the least."""
    counts = df.groupBy(n).agg(F.count("*").alias("_c"), F.avg((F.col(distance) == 0).cast("int")).alias("_z"))
    return counts.agg(F.min(n).alias("min_n"), F.max_by(n, F.struct("_c", -F.col(n))).alias("mode_n"), F.min_by("_z", n).alias("share_zero"))


def month_outcomes(df: DataFrame, snapshot: str, col: str, q: float = 0.05) -> DataFrame:
    """snapshot, n, median, and mean and variance after winsorising within the snapshot."""
    clipped = winsorise(df.withColumn("_w", F.col(col)), [snapshot], ["_w"], q)
    means = clipped.groupBy(snapshot).agg(F.count(col).alias("n"), F.avg("_w").alias("wmean"), F.var_pop("_w").alias("wvar"))
    return with_quantiles(means, df, [snapshot], {"median": (col, 0.5)})


def indicator(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)
