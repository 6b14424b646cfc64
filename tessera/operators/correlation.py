"""Association between columns: Pearson's r, correlation ratio, Theil's U, entropy, and the mixed matrix.

Pairs of columns are processed by class of pair, each class in one aggregation over the table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoding import quantiles

#: Share of distinct values above which a nominal column is highly unique; the value that stands for a missing one.
HIGH_UNIQUE, MISSING = 0.1, "\0missing"


def entropy_of(counts: str, total: str) -> Column:
    p = F.col(counts) / F.col(total)
    return F.sum(-p * F.ln(p))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, entropy: Shannon's, natural log, without nulls."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))).filter("value IS NOT NULL")
    counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    return counts.join(totals, "column").groupBy("column").agg(entropy_of("n", "total").alias("entropy"))


def pearson(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """x, y, r over rows where both are there; at most one such row, or a constant side, gives 0."""
    facts = []
    for x, y in pairs:
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
        moves = (F.count(a) > 1) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
        facts.append(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.coalesce(F.when(moves, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))), F.lit(0.0)).alias("r")))
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def _category(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def correlation_ratio(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """x (nominal), y (numeric), eta: the root of the share of y's variance between categories of x.

    The numeric columns of a nominal one are summed up in one aggregation.
    """
    parts = []
    for x in dict.fromkeys(x for x, _ in pairs):
        fact = lambda y: F.struct(F.lit(y).alias("y"), F.count(F.col(y).cast("double")).alias("n"), F.avg(F.col(y).cast("double")).alias("mean"), F.var_pop(F.col(y).cast("double")).alias("var"))
        facts = df.groupBy(_category(x).alias("a")).agg(F.array(*[fact(y) for z, y in pairs if z == x]).alias("facts"))
        parts.append(facts.select(F.lit(x).alias("x"), "a", F.inline("facts")).filter("n > 0"))
    groups = reduce(DataFrame.unionByName, parts)
    whole = groups.groupBy("x", "y").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    sums = groups.join(F.broadcast(whole), ["x", "y"]).groupBy("x", "y").agg(F.first("total").alias("total"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("between"), F.sum(F.col("n") * F.col("var")).alias("within"))
    eta = F.when((F.col("total") < 2) | (F.col("between") + F.col("within") <= 0), 0.0).otherwise(F.sqrt(F.col("between") / (F.col("between") + F.col("within"))))
    return sums.select("x", "y", eta.alias("eta"))


def theils_u(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """x, y, u = U(x|y) and u_back = U(y|x), from one table of joint counts; a constant side gives 1.

    Rows that are alike in all these columns are counted before they are taken apart into pairs.
    """
    alike = df.groupBy(*dict.fromkeys(c for p in pairs for c in p)).agg(F.count(F.lit(1)).alias("_n"))
    cells = alike.select("_n", F.inline(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), _category(x).alias("a"), _category(y).alias("b")) for x, y in pairs])))
    joint = cells.groupBy("x", "y", "a", "b").agg(F.sum("_n").alias("n"))
    part = lambda side: joint.groupBy("x", "y", side).agg(F.sum("n").alias("n")).withColumn("side", F.lit(side)).select("x", "y", "side", "n")
    every = joint.select("x", "y", F.lit("ab").alias("side"), "n").unionByName(part("a")).unionByName(part("b"))
    plogp = F.sum(F.col("n") * F.ln("n"))
    h = every.groupBy("x", "y", "side").agg(F.sum("n").alias("total"), plogp.alias("s")).withColumn("h", F.ln("total") - F.col("s") / F.col("total"))
    wide = h.groupBy("x", "y").agg(*[F.max(F.when(F.col("side") == k, F.col("h"))).alias(k) for k in ("a", "b", "ab")])
    share = lambda own, other: F.when(F.col(own) <= 1e-12, 1.0).otherwise((F.col(own) + F.col(other) - F.col("ab")) / F.col(own))
    return wide.select("x", "y", share("a", "b").alias("u"), share("b", "a").alias("u_back"))


def mixed_correlation(df: DataFrame, nominal: list[str], numeric: list[str]) -> DataFrame:
    """x, y, value for every ordered pair of columns.

    nominal x nominal: U(y|x) at (x, y); nominal x numeric: correlation ratio both ways, or Theil's U with
    numbers as categories where the nominal column is highly unique; numeric x numeric: Pearson's r.  A
    column with one value: 0, and 1 with itself.
    """
    one = lambda c: (F.count(c) == 0) | ((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)))
    n, flat = df.agg(F.count(F.lit(1)), F.array(*[one(c) for c in numeric]).cast("array<boolean>")).first()
    values = [df.select(F.col(c).alias("v")).distinct().agg(F.lit(c).alias("c"), F.count(F.lit(1)).alias("n")) for c in nominal]
    distinct = {r["c"]: r["n"] for r in reduce(DataFrame.unionByName, values).collect()} if values else {}
    constant = {c for c, fits in zip(numeric, flat) if fits} | {c for c in nominal if distinct[c] <= 1}
    unique = {c for c in nominal if distinct[c] > HIGH_UNIQUE * n} - constant
    nom, num = [c for c in nominal if c not in constant], [c for c in numeric if c not in constant]
    as_category = list(combinations(nom, 2)) + [(c, y) for c in nom if c in unique for y in num]
    parts = []
    if as_category:
        u = theils_u(df, as_category)
        parts += [u.select("x", "y", F.col("u_back").alias("value")), u.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("u").alias("value"))]
    ratio = [(c, y) for c in nom if c not in unique for y in num]
    if ratio:
        eta = correlation_ratio(df, ratio)
        parts += [eta.select("x", "y", F.col("eta").alias("value")), eta.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("eta").alias("value"))]
    if len(num) > 1:
        r = pearson(df, list(combinations(num, 2)))
        parts += [r.select("x", "y", F.col("r").alias("value")), r.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("r").alias("value"))]
    every = [*nominal, *numeric]
    fixed = [(x, y, 1.0 if x == y else 0.0) for x in every for y in every if x == y or x in constant or y in constant]
    out = df.sparkSession.createDataFrame(fixed, "x string, y string, value double")
    for p in parts:
        out = out.unionByName(p)
    return out


def correlation_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """mae: mean over columns of the mean absolute difference of two matrices, the diagonal included."""
    both = a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), ["x", "y"])
    return both.groupBy("x").agg(F.avg(F.abs(F.col("va") - F.col("vb"))).alias("e")).agg(F.avg("e").alias("mae"))


def count_encoded(df: DataFrame, fit: DataFrame, column: str, out: str) -> DataFrame:
    """out: how often the fitted side has the value (missing is a value); 0 for a value it has not."""
    counts = fit.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(MISSING)).alias("_v")).agg(F.count(F.lit(1)).alias(out))
    return df.withColumn("_v", F.coalesce(F.col(column).cast("string"), F.lit(MISSING))).join(counts, "_v", "left").withColumn(out, F.coalesce(out, F.lit(0))).drop("_v")


def median_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of numeric columns as their median, cut to a whole number for integers.  Columns without nulls need none."""
    nulls = df.agg(F.lit(0).alias("_"), *[F.count_if(F.col(c).isNull()).alias(f"_m_{c}") for c in columns]).first()
    medians, kinds = {c: quantiles(df, c, 2) for c in columns if nulls[f"_m_{c}"]}, dict(df.dtypes)
    return df.withColumns({c: F.coalesce(c, F.lit(m[1]).cast(kinds[c])) for c, m in medians.items() if m}) if medians else df
