"""Comparison groups: covariates, propensity, one-to-one matching, nearest neighbours, risk sets."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import partial, reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.operators import nearest
from cohortspark.operators.ranks import exact_quantiles, ranked, running_totals
from cohortspark.session import durable, scratch_path


def fill_with_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls and NaN replaced by the column's exact median; all columns' medians come from one pass."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    if not clean:
        return df
    cells = F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in clean.items()])
    found = exact_quantiles(df.select(F.inline(cells)), ["column"], "value", {"m": 0.5})
    middle = {r["column"]: r["m"] for r in found.collect()}
    return df.withColumns({c: F.coalesce(v, F.lit(middle.get(c)).cast("double")) for c, v in clean.items()})


def feature_frame(df: DataFrame, impute: Sequence[str], flip: Sequence[str] = ()) -> DataFrame:
    """Covariates ready for matching: medians for missing values, chosen indexes turned round, other nulls to 0."""
    out = fill_with_medians(df, impute)
    for c in flip:
        out = out.withColumn(c, F.lit(1) - F.col(c))
    return out.na.fill(0)


def propensity(df: DataFrame, treated: str, covariates: Sequence[str], balanced: bool = True) -> DataFrame:
    """Adds the propensity of treatment and its logit from a (class-balanced) logistic regression."""
    if balanced:
        n = df.agg(F.sum(F.col(treated)).alias("t"), F.count(F.lit(1)).alias("n")).first()
        t, c = float(n["t"] or 0), float(n["n"] - (n["t"] or 0))
        weight = F.when(F.col(treated) == 1, (t + c) / (2 * t) if t else 1.0).otherwise((t + c) / (2 * c) if c else 1.0)
    else:
        weight = F.lit(1.0)
    ready = VectorAssembler(inputCols=list(covariates), outputCol="_x").transform(df.withColumn("_w", weight))
    model = LogisticRegression(featuresCol="_x", labelCol=treated, weightCol="_w", maxIter=1000, tol=1e-14, standardization=True).fit(ready)
    # The margin is the logit itself, so certain cases (propensity 0 or 1) keep a finite value.
    return model.transform(ready).withColumn("propensity", vector_to_array("probability")[1]).withColumn(
        "logit", vector_to_array("rawPrediction")[1]).select(*df.columns, "propensity", "logit")


def match_one_to_one(df: DataFrame, key: str, treated: str, score: str, caliper: float,
                     rows_per_partition: int = 100_000) -> DataFrame:
    """Greedy one-to-one matching without replacement: always the closest remaining treated/control pair.

    On a line the closest pair is made of neighbours, so no candidate pairs are generated. Rows are range-partitioned
    by score (ties in the order of a hash of the key), so partitions stay even whatever the scores. Every partition
    settles the pairs that no row outside it could change. Then one round over all rows lets each look at the nearest
    row of the other kind on either side, across partitions: mutual choices are matched (the overall closest pair is
    always one), and rows that see nobody inside the caliper are dropped, since neighbours only leave. The rest is
    partitioned anew. Equally distant pairs go by the right row, then the nearest left one. Result: (treated_id, control_id, distance).
    """
    base = df.select(F.col(key).alias("id"), F.col(treated).cast("int").alias("t"), F.col(score).cast("double").alias("s"))
    free = durable(base.where("s is not null").withColumn("h", F.xxhash64("id")))
    columns = ["id", "t", "s", "h"]
    mate_type = free.schema["id"].dataType.simpleString()
    pairs = []
    # Every round matches a pair or drops a row, so the loop ends.
    while rows := free.count():
        n = -(-rows // rows_per_partition)
        cut = free.repartitionByRange(n, "s", "h", "id").sortWithinPartitions("s", "h", "id")
        near = durable(cut.mapInPandas(partial(_settle, caliper=caliper, alone=n == 1),
                                       f"id {mate_type}, t int, s double, h bigint, mate {mate_type}, gap double").withColumn(
            "part", F.spark_partition_id()))
        pairs.append(near.where("mate is not null and t = 1").select(
            F.col("id").alias("treated_id"), F.col("mate").alias("control_id"), F.col("gap").alias("distance")))
        state = durable(_choose(near.where("mate is null").select(*columns, "part"), caliper))
        pairs.append(state.where("mutual and t = 1").select(
            F.col("id").alias("treated_id"), F.col("pair.mate").alias("control_id"), F.col("pair.gap").alias("distance")))
        free = state.where("not mutual").select(*columns)
    if not pairs:
        return base.limit(0).select(F.col("id").alias("treated_id"), F.col("id").alias("control_id"), F.col("s").alias("distance"))
    return reduce(DataFrame.unionByName, pairs)


def _settle(batches: Iterator[pd.DataFrame], caliper: float, alone: bool) -> Iterator[pd.DataFrame]:
    """Closest-pair matching inside one sorted partition, for pairs closer to each other than to its unsettled edges."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    s, t, n = rows["s"].to_numpy(), rows["t"].to_numpy(), len(rows)
    low, high = (-np.inf, np.inf) if alone else (s[0], s[-1])
    before, after = list(range(-1, n - 1)), list(range(1, n)) + [-1]
    mate, taken = np.full(n, -1), np.zeros(n, dtype=bool)
    heap = [(s[i + 1] - s[i], i + 1, -i) for i in range(n - 1) if t[i] != t[i + 1] and s[i + 1] - s[i] <= caliper]
    heapq.heapify(heap)
    while heap:
        gap, j, i = heapq.heappop(heap)
        i = -i
        if taken[i] or taken[j] or after[i] != j:
            continue
        if not (gap < s[i] - low and gap < high - s[j]):
            # An outside row may be as close: from here on this stretch counts as outside as well.
            if not gap < s[i] - low:
                low = max(low, s[j])
            if not gap < high - s[j]:
                high = min(high, s[i])
            continue
        mate[i], mate[j], taken[i], taken[j] = j, i, True, True
        p, q = before[i], after[j]
        if p >= 0:
            after[p] = q
        if q >= 0:
            before[q] = p
        if p >= 0 and q >= 0 and t[p] != t[q] and s[q] - s[p] <= caliper:
            heapq.heappush(heap, (s[q] - s[p], q, -p))
    ids = rows["id"]
    rows["mate"] = [ids[m] if m >= 0 else None for m in mate]
    rows["gap"] = [abs(s[k] - s[m]) if m >= 0 else None for k, m in enumerate(mate)]
    if rows["mate"].notna().any():
        rows["mate"] = rows["mate"].astype(pd.Int64Dtype() if ids.dtype.kind == "i" else object)
    yield rows[["id", "t", "s", "h", "mate", "gap"]]


def _choose(free: DataFrame, caliper: float) -> DataFrame:
    """Rows with somebody inside the caliper, the pair they prefer, and whether the other member prefers it too."""
    order, me = ["s", "h", "id"], F.struct("s", "h", "id")
    kinds = {k: F.when(F.col("t") == k, me) for k in (0, 1)}
    # First and last row of either kind per partition, carried over to the partitions after and before.
    ends = free.groupBy("part").agg(*[f(kinds[k]).alias(f"{n}{k}") for k in kinds for n, f in (("lo", F.min), ("hi", F.max))])
    prior = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("part", *[F.last(f"hi{k}", ignorenulls=True).over(prior).alias(f"before{k}") for k in kinds],
                        *[F.last(f"lo{k}", ignorenulls=True).over(later).alias(f"after{k}") for k in kinds])
    up = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("part").orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    look = free.select("*", *[F.last(kinds[k], ignorenulls=True).over(up).alias(f"l{k}") for k in kinds],
                       *[F.last(kinds[k], ignorenulls=True).over(down).alias(f"r{k}") for k in kinds]).join(carry, "part")

    def side(name: str, carried: str):
        other = [F.coalesce(F.col(f"{name}{k}"), F.col(f"{carried}{k}")) for k in (0, 1)]
        return F.when(F.col("t") == 1, other[0]).otherwise(other[1])

    def pair(first, second, there):
        gap = F.abs(F.col("s") - there["s"])
        return F.when(there.isNotNull() & (gap <= caliper), F.struct(
            gap.alias("gap"), second.alias("b"), first.alias("a"), there["id"].alias("mate")))

    look = look.withColumn("_l", side("l", "before")).withColumn("_r", side("r", "after"))
    chosen = look.select(*free.columns, F.least(pair(F.col("_l"), me, F.col("_l")), pair(me, F.col("_r"), F.col("_r"))).alias("pair"))
    # A chosen pair contains its chooser, so at most two rows share one: both members when the choice is mutual.
    both = Window.partitionBy("pair.a.id", "pair.b.id")
    return chosen.where("pair is not null").withColumn("mutual", F.count(F.lit(1)).over(both) == 2)


def effect_sizes(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Standardized mean difference (group 1 minus group 0) of each covariate, in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.col(group).cast("int").alias("_g"), F.inline(cells))
    side = lambda f, k: f(F.when(F.col("_g") == k, F.col("v")))
    out = long.groupBy("covariate").agg(
        side(F.avg, 1).alias("mean_1"), side(F.avg, 0).alias("mean_0"),
        side(F.var_samp, 1).alias("_v1"), side(F.var_samp, 0).alias("_v0"))
    pooled = F.sqrt((F.col("_v1") + F.col("_v0")) / 2)
    return out.select("covariate", "mean_1", "mean_0",
                      F.when(pooled > 0, (F.col("mean_1") - F.col("mean_0")) / pooled).alias("smd"))


def standardized(df: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """Adds the standardized covariates as an array ``x``."""
    ready = VectorAssembler(inputCols=list(covariates), outputCol="_v").transform(df)
    scaled = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(ready).transform(ready)
    return scaled.select(*df.columns, vector_to_array("_z").alias("x"))


def nearest_controls(df: DataFrame, key: str, treated: str, covariates: Sequence[str], n: int = 1,
                     cell_rows: int = 256) -> DataFrame:
    """The n nearest controls of each treated row on standardized covariates, with replacement: (treated_id,
    control_id, distance, place), ties to the smaller id. Exact; see ``nearest.search``.

    Of controls with equal covariates only the n smallest ids can be wanted, and equal treated rows are looked up once.
    """
    placed = durable(standardized(df.select(F.col(key).alias("id"), F.col(treated).cast("int").alias("t"), *covariates), covariates).select("id", "t", "x"))
    controls = ranked(placed.where("t = 0").select("x", "id"), ["x"], ["id"], "copy").where(F.col("copy") <= n).select(F.col("id").alias("hit_id"), "x")
    wanted = placed.where("t = 1")
    points = durable(wanted.groupBy("x").agg(F.min("id").alias("id")))
    found = nearest.search(points, controls, len(covariates), n, cell_rows)
    rows = wanted.select(F.col("id").alias("treated_id"), "x").join(points, "x")
    return rows.join(found, "id").select("treated_id", F.col("hit_id").alias("control_id"), "distance", "place")


def match_risk_set(cases: DataFrame, pool: DataFrame, key: str, start: str, end: str, index: str,
                   horizon: int = 182, max_shift: int | None = None, seed: str = "0:", local_rows: int = 200_000) -> DataFrame:
    """A control per case, drawn at random: same (else nearest) start day, under observation at the case's index date for
    ``horizon`` days; without replacement; the control inherits the index date. Every case is in the result once: those
    without a control have nulls. Keys are unique; rows with a null take no part as controls and stay unmatched as cases.

    For one day shift the control's start is fixed, so the rule is a threshold on its end: end >= index + horizon, and the
    sets of controls open to the cases of a day lie inside each other. As many pairs are made as can be (``_ends_above``),
    with the cases of the smallest thresholds, ties by md5 of the key; the strictest of these draws first, and every
    control open to it that is left has the same chance (``_drawn``). Shifts go 0, -1, 1, -2, 2 and on until no control is left
    that a case left could take; ``max_shift`` ends earlier where a calliper on the start day is wanted.

    Controls are numbered once, along each start day by falling end; from then on they are one line per start and end day and the
    places that are gone. For every case it is worked out at which shift it can find a control at the earliest (``_plan``). The next
    shifts, as many as have at most ``local_rows`` such cases (and controls whose key repeats), are gone through in one task with
    these cases; a shift with more of them is a few jobs over its cases. Rule and draws are the same, so the pairs are the same
    wherever they are made.
    """
    everyone = durable(cases.select(F.col(key).alias("case_id"), F.col(start).alias("case_start"), F.col(index).alias("index_date")))
    p = pool.select(F.col(key).alias("control_id"), F.col(start).alias("control_start"), F.col(end).alias("control_end")).dropna()
    numbered = durable(ranked(p, ["control_start"], [F.col("control_end").desc(), F.md5(F.col("control_id").cast("string")), "control_id"], "place"))
    whole = durable(numbered.groupBy("control_start", "control_end").agg(F.max("place").alias("upto")))
    twice = numbered.groupBy("control_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = durable(numbered.join(twice, "control_id", "left_semi").select("control_id", "control_start", "place"))
    spark, kept, steps = everyone.sparkSession, scratch_path(everyone.sparkSession, "riskset"), 0
    repeated, c, done, gone, turn = again.count(), everyone.dropna(), None, None, 0
    while True:
        lines = _left(whole, gone)
        when, counts = _plan(c, lines, turn, horizon, max_shift)
        if not counts:
            break
        # How many of the turns ahead fit one task; the task goes on to the turn before the next one, or to the end.
        fit = sum(n + repeated <= local_rows for n in accumulate(n for _, n in counts))
        turn, until = counts[0][0], counts[fit][0] - 1 if fit < len(counts) else None
        ready = c.join(when.where(F.col("turn") <= counts[max(fit, 1) - 1][0]), ["case_start", "index_date"], "left_semi")
        if fit:
            new = _settled_in_one_task(ready, lines, _still(again, gone) if repeated else again, turn, until, horizon, max_shift, seed)
        else:
            new, until = _settled_at_once(ready, lines, _shift(turn), horizon, seed), turn
        # In files, each step beside those before: a checkpoint of a union would hold them all again, and its size would be estimated from the last one's, squared.
        new, steps = _placed(new, gone), steps + 1
        new.write.parquet(f"{kept}/pairs/{steps}")
        done = spark.read.schema(new.schema).parquet(*[f"{kept}/pairs/{n + 1}" for n in range(steps)])
        if until is None:
            break
        gone = done.select("control_start", "place")
        if repeated:
            keys = again.join(gone, ["control_start", "place"], "left_semi").select("control_id")
            gone = durable(gone.unionByName(again.join(keys, "control_id", "left_semi").select("control_start", "place")).distinct())
        c = durable(c.join(done.select("case_id"), "case_id", "left_anti"))
        turn = until + 1
    if done is None:
        pairs = numbered.limit(0).select(F.lit(None).cast(everyone.schema["case_id"].dataType).alias("case_id"), "control_id", "control_start")
    else:
        pairs = durable(done.join(numbered, ["control_start", "place"]).select("case_id", "control_id", "control_start"))
    return everyone.join(pairs, "case_id", "left").select("case_id", "control_id", "index_date", "case_start", "control_start")


def _chance(seed: str) -> Column:
    """A case's number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("case_id").cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def _shift(turn: int) -> int:
    """Turns 0, 1, 2, 3, 4 are the shifts 0, -1, 1, -2, 2."""
    return -(turn + 1) // 2 if turn % 2 else turn // 2


def _past(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Adds ``_past``: how many of the day's places up to ``place`` are gone."""
    marks = rows.withColumn("_g", F.lit(0)).unionByName(gone.withColumn("_g", F.lit(1)), allowMissingColumns=True)
    return running_totals(marks, ["control_start"], ["place", F.col("_g").desc()], {"_past": F.col("_g")}).where("_g = 0").drop("_g")


def _left(whole: DataFrame, gone: DataFrame | None) -> DataFrame:
    """``control_start, control_end, n``: the controls left, per start and end day."""
    lines = whole.withColumnRenamed("upto", "place")
    if gone is not None:
        lines = _past(lines, gone).withColumn("place", F.col("place") - F.col("_past"))
    longer = Window.partitionBy("control_start").orderBy(F.col("control_end").desc())
    n = F.col("place") - F.coalesce(F.lag("place").over(longer), F.lit(0))
    return lines.select("control_start", "control_end", n.alias("n")).where("n > 0")


def _still(again: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Controls whose key repeats, those that are left, with their place among the controls left."""
    if gone is None:
        return again
    left = again.join(gone, ["control_start", "place"], "left_anti").select("control_id", "control_start", "place")
    return _past(left, gone).select("control_id", "control_start", (F.col("place") - F.col("_past")).alias("place"))


def _placed(new: DataFrame, gone: DataFrame | None) -> DataFrame:
    """``case_id, control_start, place``: from a place ``_j`` among the controls left to one among all, which has as many more
    before it as there are places gone with fewer than ``_j`` left before them."""
    if gone is None:
        return new.select("case_id", "control_start", F.col("_j").alias("place"))
    before = ranked(gone, ["control_start"], ["place"], "_i").select("control_start", (F.col("place") - F.col("_i")).alias("_j"), F.lit(1).alias("_g"))
    marks = new.select("case_id", "control_start", "_j", F.lit(0).alias("_g")).unionByName(before, allowMissingColumns=True)
    found = running_totals(marks, ["control_start"], ["_j", "_g"], {"_before": F.col("_g")}).where("_g = 0")
    return found.select("case_id", "control_start", (F.col("_j") + F.col("_before")).alias("place"))


def _plan(c: DataFrame, lines: DataFrame, turn: int, horizon: int, max_shift: int | None) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``case_start, index_date, turn``: the first turn, from ``turn`` on, at which such cases can find a control among those left, and
    the number of cases per turn; cases without such a turn are left out. Since controls only leave, no case finds one earlier.

    Works on one line per start and index day; what reaches the driver is one line per day or turn.
    """
    day = F.unix_date
    best = {r[0]: r[1] for r in lines.groupBy(day("control_start")).agg(F.max(day("control_end"))).collect()}
    low, high = min(best, default=0), max(best, default=-1)
    ends = np.full(high - low + 1, -(1 << 40))
    for d, e in best.items():
        ends[d - low] = e
    longest = max((e - d for d, e in best.items()), default=0)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            start, t = b["start"].to_numpy(dtype=np.int64), b["index_day"].to_numpy(dtype=np.int64) + horizon
            found, left, at = np.full(len(b), -1, dtype=np.int32), np.arange(len(b) if best else 0), turn
            while len(left) and (max_shift is None or abs(_shift(at)) <= max_shift):
                there, need, far = start[left] + _shift(at), t[left], abs(_shift(at))
                hit = (there >= low) & (there <= high) & (there + horizon <= need) & (ends[np.clip(there, low, high) - low] >= need)
                found[left[hit]] = at
                # From here on all days are too early to reach the case's threshold or begin after its index day, or lie outside.
                over = (start[left] - far < np.maximum(need - longest, low)) & (start[left] + far > np.minimum(need - horizon, high))
                left = left[~(hit | over)]
                at += 1
            yield b[["case_start", "index_date", "n"]].assign(turn=found)[found >= 0]

    days = c.groupBy("case_start", "index_date").agg(F.count(F.lit(1)).alias("n")).withColumns({"start": day("case_start"), "index_day": day("index_date")})
    kinds = ", ".join(f"{k} {c.schema[k].dataType.simpleString()}" for k in ("case_start", "index_date"))
    when = durable(days.mapInPandas(first, f"{kinds}, n bigint, turn int"))
    return when, sorted((r[0], r[1]) for r in when.groupBy("turn").agg(F.sum("n")).collect())


def _settled_at_once(c: DataFrame, lines: DataFrame, shift: int, horizon: int, seed: str) -> DataFrame:
    """The pairs of one shift, of any number of cases: ``case_id, control_start, _j`` with the place among the day's controls left."""
    a = c.select("case_id", F.date_add("case_start", shift).alias("_day"), F.date_add("index_date", horizon).alias("_at"))
    above = durable(_ends_above(a, lines.select(F.col("control_start").alias("_day"), F.col("control_end").alias("_at"), "n")))
    most = above.groupBy("_day").agg(F.least(F.min("_room"), F.max("_cases")).alias("_k")).where("_k > 0")
    a = ranked(a, ["_day"], ["_at", F.md5(F.col("case_id").cast("string")), "case_id"], "_i")
    # One line per calendar day.
    a = a.join(F.broadcast(most), "_day").where("_i <= _k").withColumn("_q", F.col("_k") + 1 - F.col("_i"))
    a = a.join(above.select("_day", "_at", "_ends"), ["_day", "_at"])
    return _drawn(a, seed).withColumnRenamed("_day", "control_start")


def _settled_in_one_task(c: DataFrame, lines: DataFrame, again: DataFrame, turn: int, until: int | None, horizon: int, max_shift: int | None,
                         seed: str) -> DataFrame:
    """The pairs of the turns from ``turn`` to ``until`` (null: to the end) of a bounded number of cases: ``case_id, control_start, _j``
    with the place among the day's controls left.

    Controls of the same days differ by their place only, so the task gets one line per start and end day, bounded by the calendar,
    and answers with a place among the start day's controls by falling end. Controls with the same key and day leave together,
    so the task is told their places too.
    """
    def run(cases: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(cases) and len(lines):
            cases = cases.assign(t=cases["index_day"] + horizon).sort_values(["start", "t", "h", "case_id"], ignore_index=True)
            again = lines[lines["place"] > 0]
            twins = {(d, x): g["place"].to_numpy() - 1 for (d, _), g in again.groupby(["start", "first"]) for x in g["place"] - 1}
            doubled = bool(cases.duplicated(["start", "case_id"]).any())
            lines = lines[lines["place"] == 0].sort_values(["start", "end"], ascending=[True, False], ignore_index=True)
            ids, t, u = cases["case_id"].to_numpy(), cases["t"].to_numpy(dtype=np.int64), cases["u"].to_numpy()
            low, high = int(min(cases["start"].min(), lines["start"].min())), int(max(cases["start"].max(), lines["start"].max()))
            # Per start day: the cases left; and falling ends, how many controls reach each, and the places taken, in order.
            open_ = {int(d): g.to_numpy() for d, g in cases.index.to_series().groupby(cases["start"])}
            ends = {int(d): (-g["end"].to_numpy(dtype=np.int64), np.concatenate([[0], np.cumsum(g["n"].to_numpy(dtype=np.int64))])) for d, g in lines.groupby("start")}
            used = {d: np.zeros(0, dtype=np.int64) for d in ends}
            never = 1 << 40
            best, least, latest = np.full(high - low + 1, -never), np.full(high - low + 1, never), np.full(high - low + 1, -never)
            for d, (e, _) in ends.items():
                best[d - low] = -e[0]
            for d, rows in open_.items():
                least[d - low], latest[d - low] = t[rows[0]], t[rows[-1]]
            widest = max(max(open_) - min(ends), max(ends) - min(open_), 0)
            widest = widest if max_shift is None else min(widest, max_shift)
            for at in map(_shift, range(turn, (2 * widest if until is None else until) + 1)):
                starts = np.array(sorted(open_), dtype=np.int64)
                starts = starts[(starts + at >= low) & (starts + at <= high)]
                day = starts + at
                ready = (day + horizon <= latest[starts - low]) & (best[day - low] >= np.maximum(least[starts - low], day + horizon))
                for start in starts[ready].tolist():
                    day, rows = start + at, open_[start]
                    e, reached = ends[day]
                    first = np.searchsorted(t[rows], day + horizon)
                    asked, taken = rows[first:], used[day]
                    # Controls left that reach each threshold; the cases of the smallest thresholds find a place, as many as there is room for.
                    reach = reached[np.searchsorted(e, -t[asked], side="right")]
                    reach = reach - np.searchsorted(taken, reach)
                    k = min(len(asked), int((np.searchsorted(t[asked], t[asked]) + reach).min()))
                    if not k:
                        continue
                    q = np.arange(k)
                    drawn = q + np.floor(u[asked[k - 1 - q]] * (reach[k - 1 - q] - q)).astype(np.int64)
                    moved, place = {}, np.zeros(k, dtype=np.int64)
                    for i, x in enumerate(drawn.tolist()):
                        place[i] = moved.get(x, x)
                        moved[x] = moved.get(i, i)
                    # From a place among the controls left to one among all.
                    place += np.searchsorted(taken - np.arange(len(taken)), place, side="right")
                    out.append(pd.DataFrame({"case_id": ids[asked[k - 1 - q]], "day": day, "place": place + 1}))
                    if twins:
                        place = np.unique(np.concatenate([twins.get((day, x), np.array([x])) for x in place.tolist()]))
                    used[day] = taken = np.sort(np.concatenate([taken, place]))
                    front = int(np.searchsorted(taken - np.arange(len(taken)), 0, side="right"))
                    best[day - low] = -e[np.searchsorted(reached, front, side="right") - 1] if front < reached[-1] else -never
                    rows = np.concatenate([rows[:first], asked[k:]])
                    rows = open_[start] = rows[~np.isin(ids[rows], ids[asked[:k]])] if doubled else rows
                    if len(rows):
                        least[start - low], latest[start - low] = t[rows[0]], t[rows[-1]]
                    else:
                        del open_[start]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"case_id": cases["case_id"].iloc[:0], "day": [], "place": []})

    day, text = F.unix_date, lambda c: F.md5(F.col(c).cast("string"))
    left = c.select(F.lit(0).alias("g"), "case_id", day("case_start").alias("start"), day("index_date").alias("index_day"), text("case_id").alias("h"), _chance(seed).alias("u"))
    none = F.lit(0).cast("bigint")
    lines = lines.select(F.lit(0).alias("g"), day("control_start").alias("start"), day("control_end").alias("end"), "n", none.alias("place"), none.alias("first"))
    # At most ``local_rows`` in all.
    copies = again.groupBy("control_start", "control_id").agg(F.collect_list("place").alias("places")).where(F.size("places") > 1).select(
        F.lit(0).alias("g"), day("control_start").alias("start"), F.lit(0).alias("end"), none.alias("n"), F.explode("places").alias("place"), F.array_min("places").alias("first"))
    found = left.groupBy("g").cogroup(lines.unionByName(copies).groupBy("g")).applyInPandas(run, f"case_id {c.schema['case_id'].dataType.simpleString()}, day int, place bigint")
    return durable(found.select("case_id", F.date_from_unix_date("day").alias("control_start"), F.col("place").alias("_j")))


def _drawn(steps: DataFrame, seed: str) -> DataFrame:
    """``_day, case_id, _j``: the place, among a day's controls by falling end, of each case's control.

    ``steps`` has per day the cases numbered by ``_q`` from 1, the strictest first, and how many controls are open to each
    (``_ends``, so the places 1.._ends). One after the other they would shuffle the places: step q takes what lies at a place p
    drawn from q.._ends, and puts what lies at q there instead; the places behind q then hold what is left. What lies at p is
    therefore what the latest earlier step that drew p moved there from its own place, and so on back to a control that was
    never moved. Those links are followed by doubling, in rounds of one join; equal draws of a day are few.
    """
    drawn = durable(steps.select("_day", "case_id", "_q", (F.col("_q") + F.floor(_chance(seed) * (F.col("_ends") - F.col("_q") + 1))).alias("_p")))
    before = Window.partitionBy("_day", "_p").orderBy("_q")
    asked = drawn.withColumn("_from", F.lag("_q").over(before))
    links = durable(drawn.where("_q < _p").groupBy("_day", F.col("_p").alias("_from")).agg(F.max("_q").alias("_to")))
    while True:
        onward = links.select("_day", F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        links, was = durable(links.join(onward, ["_day", "_to"], "left").select("_day", "_from", F.coalesce("_next", "_to").alias("_to"), "_next")), links
        if not links.where("_next IS NOT NULL").limit(1).count():
            links = was
            break
        links = links.drop("_next")
    return asked.join(links, ["_day", "_from"], "left").select("_day", "case_id", F.coalesce("_to", "_from", "_p").alias("_j"))


def _ends_above(a: DataFrame, b: DataFrame) -> DataFrame:
    """``_day, _at, _ends, _room, _cases`` for every threshold ``_at`` of the cases ``a``: the ends among ``b`` (``n`` at ``_at``) that reach it, how many
    cases can be matched as far as it is concerned, and the day's cases.

    Of the k smallest thresholds those at or above x must not outnumber the ends at or above x; so the most pairs of a day
    are the least of (cases below x + ends not below x) over all x, and at most the number of cases.
    """
    marks = a.select("_day", "_at", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select("_day", "_at", F.lit(0).alias("_a"), F.col("n").alias("_b")))
    counts = marks.groupBy("_day", "_at").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    run = running_totals(counts, ["_day"], ["_at"], {"_ta": F.col("_a"), "_tb": F.col("_b")}, grand="_all")
    ends = F.col("_all_tb") - (F.col("_tb") - F.col("_b"))
    return run.where("_a > 0").select("_day", "_at", ends.alias("_ends"), (F.col("_ta") - F.col("_a") + ends).alias("_room"), F.col("_all_ta").alias("_cases"))


def keep_matched(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full rows of the matched keys."""
    return df.join(ids.select(*keys).distinct(), list(keys), "left_semi")
