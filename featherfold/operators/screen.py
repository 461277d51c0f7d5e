"""Feature screening: correlation, distance correlation, ANOVA, model importances, selection."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import as_col, hash_bucket
from ..models.metrics import auc
from ..models.training import assemble, positive_score, random_forest
from .combine import minus_names, union_names
from .gram import lasso_path
from .ordered import number_rows, running_sums
from .profile import to_long

def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both are present; NULL where one of them does not vary."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def label_correlations(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, importance): Pearson correlation with the label, pairwise complete, in one aggregate."""
    y = as_col(label).cast("double")
    exprs = [correlation(as_col(c).cast("double"), y).alias(f"{i}_importance") for i, c in enumerate(columns)]
    return to_long(df.agg(*exprs), columns, ["importance"], "feature")


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, a before b; a pair skips rows where one of the two is missing.

    One pass over the data for any number of columns: each task adds up, for all pairs at once,
    the counts, sums, squares and products of the rows where both are present, of values less the
    column's mean in units of its deviation.  The scan runs in as many tasks as a shuffle is wide, so what is
    shuffled grows with the cluster and not with the data.  r is NULL where a column does not vary.
    """
    columns = list(columns)
    k = len(columns)
    if k < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    wide = df.select(*[as_col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    stats = wide.agg(*[f(f"c{i}") for i in range(k) for f in (F.avg, F.stddev_pop)]).first()
    shift = np.array([0.0 if v is None else v for v in stats[0::2]])
    scale = np.array([v or 1.0 for v in stats[1::2]])
    names = ["at", "n", "x", "xx", "xy"]
    schema = "at int, n array<double>, x array<double>, xx array<double>, xy array<double>"

    def rows(total: dict) -> Iterator[pa.RecordBatch]:
        for at, parts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), *[pa.array([p]) for p in parts]], names=names)

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            there = ~np.isnan(x)
            x, there = np.where(there, (x - shift) / scale, 0.0), there.astype(float)
            total += np.stack([there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x])
        yield from rows({i: total[:, i] for i in range(k)})

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, *parts in zip(*[c.to_pylist() for c in batch.columns]):
                total[at] = total.get(at, 0) + np.array(parts)
        yield from rows(total)

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sums = wide.coalesce(width).mapInArrow(add_up, schema).repartition("at").mapInArrow(merge, schema)
    # a pair needs the row of either column: what column a sums up where b is present, and the other way round
    cell = sums.select("at", F.posexplode(F.arrays_zip("n", "x", "xx", "xy")).alias("with", "s"))
    one = cell.where("at < with").select(F.col("at").alias("i"), F.col("with").alias("j"), F.col("s").alias("p"))
    two = cell.where("at > with").select(F.col("with").alias("i"), F.col("at").alias("j"), F.col("s").alias("q"))
    p, q = F.col("p"), F.col("q")
    spread_a, spread_b = p["n"] * p["xx"] - p["x"] * p["x"], q["n"] * q["xx"] - q["x"] * q["x"]
    flat = lambda spread, s: spread <= 1e-13 * s["n"] * s["xx"]  # noqa: E731  nothing but rounding
    r = F.when(flat(spread_a, p) | flat(spread_b, q), None).otherwise(
        F.try_divide(p["n"] * p["xy"] - p["x"] * q["x"], F.sqrt(F.greatest(spread_a, F.lit(0.0)) * F.greatest(spread_b, F.lit(0.0))))
    )
    label = F.lit(columns)
    return one.join(two, ["i", "j"]).select(
        F.element_at(label, F.col("i") + 1).alias("a"), F.element_at(label, F.col("j") + 1).alias("b"),
        F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
    )


def correlated_columns(df: DataFrame, columns: Sequence[str], limit: float = 0.97, absolute: bool = False) -> list[str]:
    """Columns to drop so that no kept pair correlates above ``limit``; the earlier column stays."""
    columns = list(columns)
    r = F.abs("r") if absolute else F.col("r")
    edges: dict[str, set[str]] = {}
    for e in correlation_pairs(df, columns).where(r > limit).collect():
        edges.setdefault(e["b"], set()).add(e["a"])
    kept, gone = set(), []
    for c in columns:
        if edges.get(c, set()) & kept:
            gone.append(c)
        else:
            kept.add(c)
    return gone


def distance_correlations(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, importance): exact distance correlation of each column with a 0/1 label.

    Pair distances are never formed.  With values counted per class and put in order,
    every sum over pairs follows from running counts and running totals.
    """
    y = as_col(label).cast("int")
    rows = df.where(y.isNotNull())
    # the measure knows neither shift nor scale: without them, sums of squares do not cancel
    scales = rows.agg(*[f(as_col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    items = []
    for i, c in enumerate(columns):
        x, mean, dev = as_col(c).cast("double"), scales[f"m{i}"], scales[f"d{i}"]
        scaled = (x - F.lit(mean)) / F.lit(dev) if dev else F.when(x.isNotNull(), 0.0)
        items.append(F.struct(F.lit(c).alias("column"), scaled.alias("value")))
    long = rows.select(y.alias("__y"), F.inline(F.array(*items))).where(F.col("value").isNotNull()).select("column", "value", "__y")
    counts = long.groupBy("column", "value").agg(
        F.sum(1.0 - F.col("__y")).alias("c0"), F.sum(F.col("__y").cast("double")).alias("c1")
    )
    x = F.col("value")
    sums = {"r0": F.col("c0"), "r1": F.col("c1"), "p0": F.col("c0") * x, "p1": F.col("c1") * x}
    ordered = running_sums(counts, ["column"], "value", sums, split_by=["column"], bounds_from=long)
    totals = counts.groupBy("column").agg(
        F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), F.sum(F.col("c0") * x).alias("s0"), F.sum(F.col("c1") * x).alias("s1"),
        F.sum((F.col("c0") + F.col("c1")) * x * x).alias("xx"),
    )
    d = ordered.join(F.broadcast(totals), "column")  # one row per listed column
    n, s = F.col("n0") + F.col("n1"), F.col("s0") + F.col("s1")
    a = x * (2 * (F.col("r0") + F.col("r1")) - n) + s - 2 * (F.col("p0") + F.col("p1"))
    w0 = x * (2 * F.col("r0") - F.col("n0")) + F.col("s0") - 2 * F.col("p0")
    w1 = x * (2 * F.col("r1") - F.col("n1")) + F.col("s1") - 2 * F.col("p1")
    c0, c1 = F.col("c0"), F.col("c1")
    g = d.groupBy("column").agg(
        F.first("n0").alias("n0"), F.first("n1").alias("n1"), F.first(s).alias("s"), F.first("xx").alias("xx"),
        F.sum((c0 + c1) * a).alias("a"),
        F.sum((c0 + c1) * a * a).alias("aa"),
        F.sum(c1 * a * F.col("n0") + c0 * a * F.col("n1")).alias("ab"),
        F.sum(c0 * (a - w0) + c1 * (a - w1)).alias("cross"),
    )
    n = F.col("n0") + F.col("n1")
    b = 2 * F.col("n0") * F.col("n1")
    bb = F.col("n1") * F.col("n0") * F.col("n0") + F.col("n0") * F.col("n1") * F.col("n1")
    n2, n3, n4 = n * n, n * n * n, n * n * n * n
    cov = F.col("cross") / n2 - 2 * F.col("ab") / n3 + F.col("a") * b / n4
    var_x = (2 * n * F.col("xx") - 2 * F.col("s") * F.col("s")) / n2 - 2 * F.col("aa") / n3 + F.col("a") * F.col("a") / n4
    var_y = b / n2 - 2 * bb / n3 + b * b / n4
    spread = F.sqrt(F.greatest(var_x, F.lit(0.0)) * F.greatest(var_y, F.lit(0.0)))
    value = F.sqrt(F.try_divide(F.greatest(cov, F.lit(0.0)), spread))
    return g.select(F.col("column").alias("feature"), F.coalesce(value, F.lit(0.0)).alias("importance"))


def independent_columns(ranks: DataFrame) -> list[str]:
    return [r["feature"] for r in ranks.where(F.col("importance") == 0).collect()]


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, importance): one-way F statistic of each column by class."""
    exprs = []
    for i, c in enumerate(columns):
        x = as_col(c).cast("double")
        exprs += [F.count(x).alias(f"{i}_n"), F.avg(x).alias(f"{i}_m"), (F.var_pop(x) * F.count(x)).alias(f"{i}_q")]
    per_class = to_long(df.where(as_col(label).isNotNull()).groupBy(label).agg(*exprs), columns, ["n", "m", "q"], "feature")
    per_class = per_class.where(F.col("n") > 0)
    # one row per class and column from here on
    w = Window.partitionBy("feature")
    centre = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    t = per_class.withColumn("b", F.col("n") * (F.col("m") - centre) * (F.col("m") - centre)).groupBy("feature").agg(
        F.sum("b").alias("b"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")
    )
    between = F.try_divide(F.col("b"), (F.col("k") - 1).cast("double"))
    within = F.try_divide(F.col("q"), (F.col("n") - F.col("k")).cast("double"))
    return t.select("feature", F.try_divide(between, within).alias("importance"))


def scaled_ranks(table: DataFrame, order: int = 1) -> DataFrame:
    """Min-max scale ``order * importance`` to [0, 1], round to 5 places, sort; one row per feature."""
    x = F.col("importance") * F.lit(float(order))
    w = Window.partitionBy()
    scaled = F.coalesce(F.try_divide(x - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)), F.lit(0.0))
    return table.select("feature", F.round(scaled, 5).alias("importance")).orderBy(F.desc("importance"), "feature")


def _ranked(spark, names: Sequence[str], values) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return scaled_ranks(spark.createDataFrame(rows, "feature string, importance double"))


def lasso_ranks(
    df: DataFrame, columns: Sequence[str], label: str, penalties: Sequence[float], folds: int = 3, key: Sequence[str] | None = None
) -> DataFrame:
    """Absolute coefficients of an L1 linear fit whose penalty is chosen by cross-validation.

    Folds are a seeded hash of the columns ``key``, or of all of ``columns`` where no key is named.  One
    pass gives the cross products of each fold; all fits and held-out errors follow from these.
    """
    coefficients, _, _ = lasso_path(df, columns, label, penalties, hash_bucket(list(key or columns), folds, 0))
    return _ranked(df.sparkSession, columns, np.abs(coefficients))


def forest_ranks(df: DataFrame, columns: Sequence[str], label: str, **params) -> DataFrame:
    """Random-forest importances."""
    model = random_forest("__y", **params).fit(
        assemble(df.withColumn("__y", as_col(label).cast("double")), columns).select("features", "__y")
    )
    return _ranked(df.sparkSession, columns, model.featureImportances.toArray())


def top_features(ranks: DataFrame, k: int) -> list[str]:
    """The names of the ``k`` highest-ranked features."""
    return [r["feature"] for r in ranks.orderBy(F.desc("importance"), "feature").limit(k).collect()]


def combined_selection(
    rankings: Sequence[DataFrame], k: int, independent: Sequence[str] = (), add: Sequence[str] = (),
    remove: Sequence[str] = (),
) -> list[str]:
    """Union of each ranking's top ``k``, minus independent features, with manual changes."""
    best = union_names(*[top_features(r, k) for r in rankings])
    return minus_names(union_names(minus_names(best, independent), add), remove)


def permutation_importance(
    model, df: DataFrame, features: Sequence[str], key: str, label: str, seed: int = 0
) -> DataFrame:
    """(feature, importance): loss in AUC of a fitted pipeline when one column is shuffled.

    Two seeded numberings of the rows are joined on the number, which hands every row the feature values
    of another row.  Each feature is then swapped in on its own: one pass scores all variants of a row, side by
    side in an array, and one aggregate gives the AUC of each.
    """
    rows = number_rows(df, [key], "__row", f"{seed}a")
    donors = number_rows(df.select(key, *features), [key], "__row", f"{seed}b")
    donors = donors.select("__row", *[as_col(f).alias(f"__other_{f}") for f in features])
    both = rows.join(donors, "__row", "inner")
    variant = F.explode(F.sequence(F.lit(0), F.lit(len(features)))).alias("__variant")  # 0: as it is
    both = both.select(*[c for c in both.columns if c != "__row"], variant)
    swapped = {f: F.when(F.col("__variant") == i, F.col(f"__other_{f}")).otherwise(F.col(f)) for i, f in enumerate(features, 1)}
    scored = positive_score(model.transform(both.withColumns(swapped)))
    names = F.element_at(F.lit(["", *features]), F.col("__variant") + 1)
    found = auc(scored.select(names.alias("feature"), label, "score"), "score", label, ["feature"])
    base = F.max(F.when(F.col("feature") == "", F.col("auc"))).over(Window.partitionBy())  # one row per feature
    lost = found.select("feature", (base - F.col("auc")).alias("importance"))
    return lost.where(F.col("feature") != "")


def mean_importance(tables: Sequence[DataFrame]) -> DataFrame:
    """Mean of several (feature, importance) tables, e.g. one per fold."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("feature").agg(F.avg("importance").alias("importance"))


def rank_union(rankings: Mapping[str, DataFrame]) -> DataFrame:
    """All rankings under each other with their name."""
    out = None
    for name, t in rankings.items():
        part = t.withColumn("ranking", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
