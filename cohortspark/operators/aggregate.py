"""Grouped aggregation by column -> function names, plain or per time index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.dates import defined_index, time_index
from cohortspark.operators.ranks import exact_quantiles, one_row, running_totals, same_keys

FUNCTIONS = (
    "avg", "mean", "collect_list", "collect_set", "concat_ws", "count", "first", "last", "max", "min", "median",
    "stddev", "sum",
)
NUMERIC_ONLY = ("avg", "mean", "median", "stddev", "sum")


def _as_list(x) -> list:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _checked(df: DataFrame, keys, spec, order_by):
    if not isinstance(df, DataFrame):
        raise TypeError("df must be a DataFrame")
    keys, order = _as_list(keys), _as_list(order_by)
    spec = {c: _as_list(f) for c, f in spec.items()}
    missing = [c for c in [*keys, *order, *spec] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the frame: {missing}")
    unknown = sorted({f for fs in spec.values() for f in fs} - set(FUNCTIONS))
    if unknown:
        raise ValueError(f"unknown aggregate functions: {unknown}")
    return keys, spec, order


def _ordered_list(col: str, order: Sequence[str]) -> Column:
    item = F.when(F.col(col).isNotNull(), F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)],
                                                   F.col(col).alias("v")))
    return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])


def _expression(df: DataFrame, col: str, fn: str, order: Sequence[str]) -> Column:
    c = F.col(col)
    if fn in NUMERIC_ONLY and isinstance(df.schema[col].dataType, T.BooleanType):
        c = c.cast("int")
    position = F.struct(*[F.col(o) for o in order], F.col(col))
    return {
        "avg": lambda: F.avg(c), "mean": lambda: F.avg(c), "sum": lambda: F.sum(c), "stddev": lambda: F.stddev(c),
        "count": lambda: F.count(c), "max": lambda: F.max(c), "min": lambda: F.min(c),
        "collect_list": lambda: _ordered_list(col, order),
        "collect_set": lambda: F.sort_array(F.collect_set(c)),
        "concat_ws": lambda: F.array_join(F.transform(_ordered_list(col, order), lambda x: x.cast("string")), ";"),
        "first": lambda: F.min_by(c, position), "last": lambda: F.max_by(c, position),
    }[fn]()


def aggregate(df: DataFrame, keys, spec: dict[str, str | list[str]], order_by=None) -> DataFrame:
    """One row per key with a column ``<col>_<fn>`` for every requested aggregate.

    Lists and first/last follow ``order_by`` and break ties by value, so results do not depend on the
    partitioning. Lists skip nulls, first/last keep them, null keys form a group. A list is as long as its
    group by definition; for groups too large for one row use ``ordered_elements``, its row form.
    """
    keys, spec, order = _checked(df, keys, spec, order_by)
    names = [(c, f, f"{c}_{f}") for c, fs in spec.items() for f in fs]
    plain = [_expression(df, c, f, order).alias(n) for c, f, n in names if f != "median"]
    out = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct() if keys else None
    for c, f, n in names:
        if f == "median":
            number = df.withColumn(c, F.col(c).cast("double") if not isinstance(df.schema[c].dataType, T.BooleanType)
                                   else F.col(c).cast("int").cast("double"))
            middle = exact_quantiles(number, keys, c, {n: 0.5})
            out = same_keys(out, middle, keys, "left") if keys else middle if out is None else one_row(out, middle)
    return out.select(*keys, *[n for _, _, n in names])


def ordered_elements(df: DataFrame, keys, col: str, order_by) -> DataFrame:
    """Row form of an ordered list: (keys, position, value), with no group gathered in one place.

    Rows that agree in order and value are counted together and expanded after ranking.
    """
    keys, _, order = _checked(df, keys, {col: []}, order_by)
    same = df.where(F.col(col).isNotNull()).groupBy(*{k: 0 for k in [*keys, *order, col]}).agg(
        F.count(F.lit(1)).alias("_n"))
    placed = running_totals(same, keys, [F.col(o).asc() for o in [*order, col]], {"_hi": F.col("_n")})
    steps = F.sequence(F.col("_hi") - F.col("_n") + 1, F.col("_hi"))
    return placed.select(*keys, F.explode(steps).alias("position"), F.col(col).alias("value"))


def aggregate_per_person(df: DataFrame, spec, keys=(), person=("pat_id", "instance"), order_by=None) -> DataFrame:
    """``aggregate`` with the person columns put in front of the keys."""
    every = [*person, *[k for k in _as_list(keys) if k not in person]]
    return aggregate(df, every, spec, order_by)


OTHER = "other"


def aggregate_by_index(df: DataFrame, keys, index: str, spec, order_by=None, names: Sequence[str] | None = None,
                       wide: Sequence | None = None) -> DataFrame:
    """Aggregates per (keys, index): a row each with the index and its label, null indexes included.

    With ``wide``, the indexes to spread out, one row per key with columns ``<col>_<fn>_<label>`` for each of them; the rows of all
    other indexes, null too, are aggregated together in ``<col>_<fn>_other``. So the columns follow from the arguments alone.
    """
    keys, spec, order = _checked(df, keys, spec, order_by)
    idx = F.col(index)
    columns = [f"{c}_{f}" for c, fs in spec.items() for f in fs]

    def name_of(v) -> str:
        return str(names[v]) if names is not None and isinstance(v, int) and 0 <= v < len(names) else str(v)

    if wide is None:
        text = idx.cast("string")
        if names is not None:
            text = F.coalesce(F.get(F.array(*[F.lit(str(n)) for n in names]), idx.cast("int")), text)
        return aggregate(df, [*keys, index], spec, order).select(*keys, index, text.alias(f"{index}_label"), *columns)
    slot = F.coalesce(*[F.when(idx == F.lit(v), F.lit(i)) for i, v in enumerate(wide)], F.lit(len(wide)))
    long = aggregate(df.withColumn("_slot", slot), [*keys, "_slot"], spec, order)
    spread = [F.first(F.when(F.col("_slot") == i, F.col(c)), ignorenulls=True).alias(f"{c}_{label}")
              for i, label in enumerate([*map(name_of, wide), OTHER]) for c in columns]
    return long.groupBy(*keys).agg(*spread)


def aggregate_regular(df: DataFrame, keys, spec, ts: str, kind: str = "day", index: str | None = None) -> DataFrame:
    """Per calendar block (year, month, day, 12-hour, 6-hour, hour), ordered by time inside a block; a row per block."""
    index = index or f"time_index_{kind.replace('-', '_')}"
    return aggregate_by_index(df.withColumn(index, time_index(F.col(ts), kind)), keys, index, spec, ts)


def aggregate_relative(df: DataFrame, keys, spec, ts: str, reference: str, bounds: Sequence[int],
                       names: Sequence[str] | None = None, index: str = "time_index", wide: bool = True) -> DataFrame:
    """Per period between day bounds that are relative to a reference date on the row: columns for every period, or rows."""
    marked = df.withColumn(index, defined_index(F.col(ts), F.col(reference), bounds))
    return aggregate_by_index(marked, keys, index, spec, ts, names, range(len(bounds) + 1) if wide else None)


REST = "none of these"


def category_counts(df: DataFrame, measures: Mapping[str, tuple[Column, Sequence[str]]], by: Sequence[str] = ()) -> DataFrame:
    """(by, measure, category, n) over fixed domains, zero cells included, from one aggregate over one scan.

    ``measures`` has a label column and its domain per name. Rows with another label, or null, are in the category ``REST``.
    """
    cells = [(m, label, c, d) for m, (c, domain) in measures.items() for label, d in [*((v, None) for v in domain), (REST, list(domain))]]
    sums = [F.count_if(F.coalesce(c == label, F.lit(False)) if d is None else ~F.coalesce(c.isin(d), F.lit(False))).alias(f"_v{i}")
            for i, (_, label, c, d) in enumerate(cells)]
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(label).alias("category"), F.col(f"_v{i}").alias("n")) for i, (m, label, _, _) in enumerate(cells)])
    return df.groupBy(*by).agg(*sums).select(*by, F.inline(rows))


def proportions(counts: DataFrame, by: Sequence[str] = (), n: str = "n") -> DataFrame:
    """Adds each category's share of its group; ``counts`` is already one row per category."""
    total = F.sum(n).over(Window.partitionBy(*by))
    return counts.withColumn("share", F.when(total > 0, F.col(n) / total))


def describe(df: DataFrame, keys, value: str, accuracy: int | None = None) -> DataFrame:
    """Median, quartiles, spread and range per group; exact, or in one pass from sketches when ``accuracy`` is given."""
    if accuracy:
        at = F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), accuracy)
        df = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"), at.alias("_q"))
        df = df.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(("q1", "median", "q3"))}).drop("_q")
        return df.withColumn("iqr", F.col("q3") - F.col("q1"))
    probs = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    return exact_quantiles(df, keys, value, probs, "n").withColumn("iqr", F.col("q3") - F.col("q1"))


def histogram(df: DataFrame, value: Column, low: float | None = None, high: float | None = None, bins: int = 10) -> DataFrame:
    """Rows per fixed-width bin; every bin appears, and every row with a value is counted.

    Without bounds they are the least and greatest value, the last bin closed. With bounds, [low, high): values below are
    bin -1 (no start), values from ``high`` on are bin ``bins``. One bin of width 1 stands for a column of one value.
    """
    held = df.select(value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    open_ = low is None or high is None
    if open_:
        least, most = held.agg(F.min("v"), F.max("v")).first()
        low, high = (least if low is None else low), (most if high is None else high)
        low, high = (0.0, 1.0) if low is None else (low, high if high > low else low + 1)
    width = (high - low) / bins
    bucket = F.when(F.col("v") < low, -1).when(F.col("v") > high, bins).when(F.col("v") == high, bins - 1 if open_ else bins).otherwise(
        F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)))
    counted = held.select(bucket.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(-1, bins + 1).select(F.col("id").cast("int").alias("bin")).where(F.lit(not open_) | F.col("bin").between(0, bins - 1))
    return spine.join(counted, "bin", "left").select(
        "bin", F.when(F.col("bin") >= 0, F.lit(float(low)) + F.col("bin") * F.lit(float(width))).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n"))


def weekly_rate(df: DataFrame, day: str, event: Column, start: str, weeks: int = 0, min_denominator: int = 10,
                by: Sequence[str] = (), offset: int = 0) -> DataFrame:
    """100 * events / rows per 7-day bucket counted from ``start``; 0 when a bucket has too few rows.

    The buckets reach from the first to the last that holds a row, week 0 and ``weeks`` buckets at least; those before
    ``start`` are negative. Rows without a day are left out. ``offset=6`` gives the uneven first bucket (one day) of the
    original report.
    """
    since = F.datediff(F.col(day), F.to_date(F.lit(start)))
    week = F.floor((since + offset) / 7).cast("int")
    per_day = df.where(since.isNotNull()).select(*by, week.alias("week"), event.cast("bigint").alias("_e"))
    counted = per_day.groupBy(*by, "week").agg(F.count(F.lit(1)).alias("n"), F.sum("_e").alias("n_events"))
    first, last = per_day.agg(F.min("week"), F.max("week")).first()
    spine = F.explode(F.sequence(F.lit(min(first or 0, 0)), F.lit(max(last or 0, weeks - 1, 0))))
    groups = counted.select(*by).distinct() if by else df.sparkSession.range(1)
    grid = groups.select(*by, spine.alias("week"))
    joined = same_keys(grid, counted, [*by, "week"], "left")
    n = F.coalesce("n", F.lit(0))
    rate = F.when(n >= min_denominator, F.lit(100.0) * F.col("n_events") / n).otherwise(0.0)
    return joined.select(*by, "week", n.alias("n"), F.coalesce("n_events", F.lit(0)).alias("n_events"), rate.alias("rate"))
