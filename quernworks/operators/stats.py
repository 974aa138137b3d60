"""Exact statistics of columns: quantiles, bins, cross-tabs, correlations, sweeps, summaries.

A quantile aggregation holds all distinct values of a group in one task, so it is used only for groups
that a count has found small. Those of larger groups come from counts by ranges of values, which are
narrowed down to the range that holds the wanted place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BINS
from ..session import written
from .dedup import keep_last

QUARTILES = (0.25, 0.5, 0.75)
_QUARTERS = {f"q{round(100 * p)}": p for p in QUARTILES}


#: Values that a group may have for its quantiles to be taken in one task.
MOST_IN_A_TASK = 1 << 18


def quantile(x: Column | str, p: float) -> Column:
    """Linearly interpolated, exact; holds all distinct values of a group."""
    return F.percentile(x, F.lit(float(p)))


def _order_statistics(df: DataFrame, keys: list[str], limits: dict[tuple, tuple[float, float]], wanted: dict[tuple, set[int]], most: int, bins: int) -> dict[tuple, dict[int, float]]:
    """The k-th values (from 0) of column x of each group, by narrowing; limits: least and greatest value."""
    spark, found = df.sparkSession, {g: {} for g in wanted}
    # open ranges of a group: a number, limits, values before it, and places wanted in it
    open_ = [(g, *limits[g], 0, ks) for g, ks in wanted.items() if ks]
    rows = df.withColumn("__range", F.lit(0))
    while open_:
        listed = [(i, *g, float(lo), float(hi)) for i, (g, lo, hi, _, _) in enumerate(open_)]
        kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
        ranges = F.broadcast(spark.createDataFrame(listed, ", ".join(["__at int", *kinds, "__lo double", "__hi double"])))
        same = F.col("x").between(F.col("r.__lo"), F.col("r.__hi"))
        for k in keys:
            same = same & F.col(f"v.{k}").eqNullSafe(F.col(f"r.{k}"))
        step = F.least(F.floor((F.col("x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1))
        inside = df.alias("v").join(ranges.alias("r"), same).select("__at", "x", F.when(F.col("__hi") > F.col("__lo"), step).otherwise(0).alias("__bin"))
        counts = inside.groupBy("__at", "__bin").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        after, few = [], []
        for i, (g, _, _, before, ks) in enumerate(open_):
            for r in sorted((r for r in counts if r["__at"] == i), key=lambda r: r["__bin"]):
                here = {k for k in ks if before <= k < before + r.n}
                if here and r.lo == r.hi:
                    found[g] |= dict.fromkeys(here, r.lo)
                elif here:
                    (few if r.n <= most else after).append((g, r.lo, r.hi, before, here))
                before += r.n
        if few:
            listed = [(i, *g, float(lo), float(hi)) for i, (g, lo, hi, _, _) in enumerate(few)]
            ranges = F.broadcast(spark.createDataFrame(listed, ", ".join(["__at int", *kinds, "__lo double", "__hi double"])))
            values = df.alias("v").join(ranges.alias("r"), same).groupBy("__at").agg(F.sort_array(F.collect_list("x")).alias("xs"))
            place = F.explode(F.array(*[F.lit(k) for k in sorted({k - before for *_, before, ks in few for k in ks})]))
            for r in values.select("__at", "xs", place.alias("k")).select("__at", "k", F.get("xs", F.col("k")).alias("x")).collect():
                g, _, _, before, ks = few[r["__at"]]
                if before + r.k in ks:
                    found[g][before + r.k] = r.x
        open_ = after
    return found


def exact_quantiles(df: DataFrame, keys: list[str], column: str, ps: tuple[float, ...], most: int = MOST_IN_A_TASK, bins: int = 1024) -> DataFrame:
    """keys and q0, q1, ...: linearly interpolated quantiles of the non-null values of each group.

    NaN is greater than all numbers; a group without values has nulls. Groups are those of a report: a
    row of each comes to the driver, and a count by range of those with over ``most`` values.
    """
    spark = df.sparkSession
    named = [f"q{i}" for i in range(len(ps))]
    rows = df.select(*keys, F.col(column).cast("double").alias("x"))
    whole = F.when(~F.isnan("x"), F.col("x"))
    sizes = rows.groupBy(*keys).agg(F.count("x").alias("n"), F.count(whole).alias("m"), F.min(whole).alias("lo"), F.max(whole).alias("hi")).collect()
    if all(r.n <= most for r in sizes):
        both = F.percentile("x", F.array(*[F.lit(float(p)) for p in ps]))
        return rows.groupBy(*keys).agg(both.alias("q")).select(*keys, *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(named)])
    group = lambda r: tuple(r[k] for k in keys)
    places = {group(r): [(r.n - 1) * float(p) for p in ps] for r in sizes if r.n}
    finite = {group(r): r.m for r in sizes}
    wanted = {g: {k for h in hs for k in (int(h), min(int(h) + 1, int(-(-h // 1)))) if k < finite[g]} for g, hs in places.items()}
    found = _order_statistics(rows.filter(~F.isnan("x")), keys, {group(r): (r.lo, r.hi) for r in sizes}, wanted, most, bins)
    nan, out = float("nan"), []
    for r in sizes:
        g, values = group(r), [None] * len(ps)
        for i, h in enumerate(places.get(g, ())):
            low, high = (found[g].get(k, nan) for k in (int(h), int(-(-h // 1))))
            values[i] = low if low == high else low + (high - low) * (h - int(h))
        out.append((*g, *values))
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return F.broadcast(spark.createDataFrame(out, ", ".join([*kinds, *[f"{c} double" for c in named]])))


def _with_quantiles(made: DataFrame, df: DataFrame, keys: list[str], column: str, names: dict[str, float]) -> DataFrame:
    """``made``, one row a group, with the quantiles of df's column by name."""
    found = exact_quantiles(df, keys, column, tuple(names.values()))
    found = found.select(*[F.col(k).alias(f"__q_{k}") for k in keys], *[F.col(f"q{i}").alias(n) for i, n in enumerate(names)])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__q_{k}"))
    return made.join(F.broadcast(found), same).drop(*[f"__q_{k}" for k in keys])


def tertile_bounds(df: DataFrame, score: str) -> tuple[float | None, float | None]:
    """The scores' lower and upper tertile; NaN if any score is NaN, null without scores."""
    if df.agg(F.coalesce(F.bool_or(F.isnan(score)), F.lit(False))).first()[0]:
        return float("nan"), float("nan")
    found = exact_quantiles(df, [], score, (1 / 3, 2 / 3)).first()
    return (found.q0, found.q1) if found else (None, None)


def with_tertile_bins(df: DataFrame, score: str, out: str = "difficulty_bin") -> DataFrame:
    """easy up to the lower tertile, hard above the upper one, else medium; all are medium if any score is NaN.

    The rows are written to the scratch folder first, so what scores cost is spent once.
    """
    df = written(df.sparkSession, df, "scored")
    low, high = (F.lit(x).cast("double") for x in tertile_bounds(df, score))
    s = F.col(score)
    nan = F.isnan(low)
    return df.withColumn(out, F.when(s.isNull(), None).when(nan, "medium").when(s <= low, "easy").when(s > high, "hard").otherwise("medium"))


def score_summary(df: DataFrame, score: str, bin_: str = "difficulty_bin") -> DataFrame:
    """One row: n, mean, std (of the population), q33, q66, and the bins' counts."""
    counts = [F.count_if(F.col(bin_) == b).alias(f"n_{b}") for b in BINS]
    made = df.agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), *counts)
    return _with_quantiles(made, df, [], score, {"q33": 1 / 3, "q66": 2 / 3}).select("n", "mean", "std", "q33", "q66", *[f"n_{b}" for b in BINS])


def crosstab(df: DataFrame, row: str, column: str, values: tuple[str, ...] = BINS) -> DataFrame:
    """Counts by row of each of ``values``, zeros filled in; null labels are left out."""
    counted = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row).pivot(column, list(values)).count()
    return counted.fillna(0, list(values))


def crosstab_percent(counts: DataFrame, row: str, values: tuple[str, ...] = BINS) -> DataFrame:
    """Counts as percent of each row's sum; null for an empty row."""
    total = F.col(values[0])
    for v in values[1:]:
        total = total + F.col(v)
    return counts.select(row, *[F.try_divide(100.0 * F.col(v), total).alias(v) for v in values])


def crosstab_latex(counts: DataFrame, row: str, values: tuple[str, ...] = BINS) -> DataFrame:
    """One LaTeX table line a row."""
    name = F.regexp_replace(row, "_", r"\\\\_")
    cells = [F.lit(" & ") if i % 2 == 0 else F.col(values[i // 2]).cast("string") for i in range(2 * len(values))]
    return counts.select(row, F.concat(F.lit("\\texttt{"), name, F.lit("}"), *cells, F.lit(" \\\\")).alias("line"))


def flat_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(pair, n): counts of a__b for all observed labels of both, zeros included."""
    counted = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    labels = counted.agg(F.collect_set(a).alias("as"), F.collect_set(b).alias("bs"))  # labels are few: an enumeration
    grid = labels.select(F.explode("as").alias(a), "bs").select(a, F.explode("bs").alias(b))
    return grid.join(counted, [a, b], "left").select(F.concat_ws("__", a, b).alias("pair"), F.coalesce("n", F.lit(0)).alias("n"))


def key_histogram(df: DataFrame, label: Column) -> DataFrame:
    """(label, n, percent of all rows) of trimmed labels; blank and missing ones are one row with a null label."""
    from ..functions.exact import strip

    clean = strip(label)
    rows = df.select(F.when(F.length(clean) > 0, clean).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("percent", 100.0 * F.col("n") / total)


def key_summary(df: DataFrame, label: Column) -> DataFrame:
    from ..functions.exact import strip

    clean = strip(label)
    present = F.when(F.length(clean) > 0, clean)
    return df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(present.isNull()).alias("n_missing"), F.count_distinct(present).alias("n_unique"))


def _stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (component, x)")


def component_stats(df: DataFrame, columns: list[str], zero_share: tuple[str, ...] = ()) -> DataFrame:
    """By component: n, mean, std (of the population), min, quartiles, max, and the share of zeros where asked for."""
    zero = F.avg(F.when(F.col("x") == 0, 1.0).otherwise(0.0))
    rows = _stacked(df, columns)
    made = rows.groupBy("component").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"), zero.alias("frac_eq_0"))
    made = _with_quantiles(made, rows, ["component"], "x", _QUARTERS)
    return made.withColumn("frac_eq_0", F.when(F.col("component").isin(list(zero_share)), F.col("frac_eq_0")))


def pearson_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) of all pairs; no rows for under two rows, NaN or null for a constant column."""
    pairs = [(a, b) for a in columns for b in columns]
    made = df.agg(F.count(F.lit(1)).alias("_n"), *[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).filter("_n >= 2")
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return made.select(F.explode(cells).alias("c")).select("c.a", "c.b", "c.r")


def with_scopes(df: DataFrame, scope: str, out: str = "scope", names: tuple[str, ...] = ("global", "local")) -> DataFrame:
    """Each row for the subset of all rows, ``all``, and for that of its scope, if it is one of ``names``."""
    own = F.when(F.col(scope).isin(*names), F.array(F.lit("all"), F.col(scope))).otherwise(F.array(F.lit("all")))
    return df.withColumn(out, F.explode(own))


def text_table(rows: DataFrame, most: int = 200, digits: int = 4) -> str:
    """A small report as lines of text: a heading, and the rows with numbers to the right; at most ``most`` rows."""
    found = rows.limit(most).collect()
    shown = [[("" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)) for v in r] for r in found]
    right = [any(isinstance(r[i], (int, float)) for r in found) for i in range(len(rows.columns))]
    width = [max(map(len, column)) for column in zip(rows.columns, *shown, strict=True)]
    line = lambda cells: "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, width, right, strict=True)).rstrip()
    return "\n".join([line(rows.columns), line(["-" * w for w in width]), *map(line, shown)])


def weighted_spread(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Mean and standard deviation of the weighted sum, from means and population covariances."""
    names = list(weights)
    variance = F.lit(0.0)
    for a in names:
        for b in names:
            variance = variance + weights[a] * weights[b] * F.covar_pop(a, b)
    mean = F.lit(0.0)
    for a in names:
        mean = mean + weights[a] * F.avg(a)
    return df.agg(F.count(F.lit(1)).alias("n"), mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"))


def with_average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks with ties at their mean, null first and NaN last.

    Counts by value are dealt by ranges of values; a range's ranks begin after the counts of all before
    it, so only one number a range is summed up in one place.
    """
    values = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(column)
    values = written(df.sparkSession, values.withColumn("_part", F.spark_partition_id()), "ranked")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    parts = values.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    parts = parts.select("_part", (F.sum("_sum").over(upto(Window.orderBy("_part"))) - F.col("_sum")).alias("_before"))
    inner = F.sum("_n").over(upto(Window.partitionBy("_part").orderBy(column)))
    ranks = values.withColumn("_in", inner).join(F.broadcast(parts), "_part").select(F.col(column).alias("_v"), (F.col("_before") + F.col("_in") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    ranked = with_average_rank(with_average_rank(df.select(a, b), a, "_ra"), b, "_rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))


def threshold_sweep(df: DataFrame, value: str, thresholds: list[float], run: str | None = None) -> DataFrame:
    """(run, threshold, n, count, rate) of values at or above each threshold, in one pass over the rows."""
    steps = sorted(thresholds)
    keys = [run] if run else []
    made = df.groupBy(*keys).agg(F.count(value).alias("n"), *[F.count_if(F.col(value) >= t).alias(f"c{i}") for i, t in enumerate(steps)])
    cells = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{i}").alias("count")) for i, t in enumerate(steps)])
    out = made.select(*keys, "n", F.explode(cells).alias("c")).select(*keys, "c.threshold", "n", "c.count")
    return out.withColumn("rate", F.try_divide(F.col("count"), F.col("n")))


def candidate_thresholds(sweep: DataFrame, targets: list[float], run: str | None = None) -> DataFrame:
    """(run, target, threshold): the least swept threshold with a rate of at most the target, null for none."""
    keys = [run] if run else []
    made = sweep.groupBy(*keys).agg(*[F.min(F.when(F.col("rate") <= t, F.col("threshold"))).alias(f"t{i}") for i, t in enumerate(targets)])
    cells = F.array(*[F.struct(F.lit(f"{t:.2f}").alias("target"), F.col(f"t{i}").alias("threshold")) for i, t in enumerate(targets)])
    return made.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.target", "c.threshold")


def sweep_stats(df: DataFrame, value: str, scope: str, run: str | None = None) -> DataFrame:
    keys = [run] if run else []
    whole = F.count_if(F.col(scope) == "global")
    made = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), whole.alias("n_global"), F.try_divide(whole, F.count(F.lit(1))).alias("global_rate"))
    return _with_quantiles(made, df, keys, value, {f"p{round(100 * p)}": p for p in QUARTILES})


def overlap_summary(df: DataFrame, by: str | None = None, iou: str = "iou", dice: str = "dice") -> DataFrame:
    """n, means, quartiles, five bins (the last closed) and the share of IoU >= 0.6; grouped also gives all rows, as '(all)'."""
    edges = [0.0, 0.2, 0.4, 0.6, 0.8]
    x = F.col(iou)
    bins = [F.count_if((x >= lo) & (x < hi)) for lo, hi in zip(edges, edges[1:], strict=False)] + [F.count_if((x >= edges[-1]) & (x <= 1.0))]
    aggregates = [
        F.count(F.lit(1)).alias("n"), F.avg(iou).alias("mean_iou"), F.avg(dice).alias("mean_dice"),
        *[b.alias(f"bin{i}") for i, b in enumerate(bins)], F.avg(F.when(x >= 0.6, 1.0).otherwise(0.0)).alias("frac_iou_06"),
    ]
    if by is None:
        return _with_quantiles(df.agg(*aggregates), df, [], iou, _QUARTERS)
    named = df.select(iou, dice, F.explode(F.array(F.lit("(all)"), F.col(by))).alias(by))
    return _with_quantiles(named.groupBy(by).agg(*aggregates), named, [by], iou, _QUARTERS)


def segment_summary(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row about two runs: segment counts, and means over the rows that both call global."""
    ga, gb = F.col(f"edit_scope_{a}") == "global", F.col(f"edit_scope_{b}") == "global"
    both = ga & gb
    mean = lambda c: F.avg(F.when(both, F.col(c)))
    out = [F.count(F.lit(1)).alias("n"), F.count_if(both).alias("confirmed_global"), F.count_if(ga & ~gb).alias("a_only"), F.count_if(~ga & gb).alias("b_only")]
    out.append(F.count_if((F.col(f"edit_scope_{a}") == "local") & (F.col(f"edit_scope_{b}") == "local")).alias("both_local"))
    for label in (a, b):
        out += [mean(f"mask_area_frac_{label}").alias(f"mean_area_{label}"), F.avg(F.when(both, F.when(F.col(f"mask_area_frac_{label}") >= 0.999, 1.0).otherwise(0.0))).alias(f"full_area_{label}"), mean(f"combined_diff_mean_{label}").alias(f"mean_cdm_{label}")]
    return pairs.agg(*out)


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """Accuracies of category, place and bin, and of all three at once."""
    names = ("category", "spatial", "bin")
    whole = F.col("category_match") & F.col("spatial_match") & F.col("bin_match")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return rows.agg(F.count(F.lit(1)).alias("n"), *[share(F.col(f"{n}_match")).alias(f"{n}_accuracy") for n in names], share(whole).alias("joint_accuracy"))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The share of rows in which each column was found."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)).alias(f"{c}_rate") for c in columns])


def deduped_runs(runs: dict[str, DataFrame], key: str, order: list[str]) -> DataFrame:
    """Several runs as one table with a column ``run``, each with its last row of a key."""
    out = None
    for name, df in runs.items():
        one = keep_last(df, [key], order).withColumn("run", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out
