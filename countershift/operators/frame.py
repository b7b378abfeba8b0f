"""The engine's aggregates and order statistics as DataFrame plans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countershift.errors import DecompositionError
from countershift.functions.curves import isotonic
from countershift.functions.ranks import tolerance, type7_positions


def grid(value: str | Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number from 0 to bins - 1; the upper bound belongs to the last bin."""
    v = F.col(value) if isinstance(value, str) else value
    at = F.floor((v - low) / (high - low) * bins)
    return F.when(high == low, F.lit(0)).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1))).cast("long")


def weighted_histogram(frame: DataFrame, value: str, weight: str, bins: int, low: float, high: float, by: list[str] | None = None) -> DataFrame:
    """Weight and count by bin, combined before the shuffle."""
    at = grid(value, F.lit(float(low)), F.lit(float(high)), bins)
    return frame.groupBy(*(by or []), at.alias("bin")).agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))


def exact_quantiles(frame: DataFrame, value: str, weight: str, probs, by: str, kind: str = "type7", bins: int = 4096, candidates: int = 200_000) -> DataFrame:
    """Exact weighted quantiles by group without a global sort: ranges are divided into bins until the bins that hold the ranks have few values.

    A pass puts the rows of each open range into bins of equal width; the bins
    that hold a rank, from their least to their largest value, are the next
    ranges. So an outlier costs a pass and no more. The driver sees bins and at
    most ``candidates`` values (a range of a single value needs none); groups must be few.
    Type 7 interpolates ranks of the group's row count; type 2 averages at exact ties.
    """
    spark, key = frame.sparkSession, f"g {frame.schema[by].dataType.simpleString()}"
    rows = frame.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v"), F.col(weight).cast("double").alias("w")).where("v is not null and w > 0")
    groups = {r["g"]: r for r in rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.sum("w").alias("w")).collect()}
    if len(groups) > 1000:
        raise DecompositionError("too many groups")
    # a rank: where it is looked for, and the value behind that range
    targets = [(g, t[0]) for g in groups for p in probs for t in _targets(groups[g], [p], kind)]
    ranges = {(g, r["lo"], r["hi"]): (0.0, r["n"], r["w"]) for g, r in groups.items()}
    held = {(g, t): ((g, groups[g]["lo"], groups[g]["hi"]), None) for g, t in targets}
    width = max(16, min(bins, candidates // max(1, len(ranges))))
    while sum(n for (_, lo, hi), (_, n, _) in ranges.items() if lo < hi) > candidates:
        open_ = [k for k in ranges if k[1] < k[2]]
        bound = spark.createDataFrame([(i, *k) for i, k in enumerate(open_)], f"i int, {key}, lo double, hi double")
        placed = rows.join(F.broadcast(bound), "g").where("v between lo and hi").groupBy("i", grid("v", F.col("lo"), F.col("hi"), width).alias("bin"))
        found: dict = {}
        for r in placed.agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            found.setdefault(open_[r["i"]], []).append((r["bin"], r["w"], r["n"], r["lo"], r["hi"]))
        following, places = {k: x for k, x in ranges.items() if k[1] == k[2]}, {}
        for k, cells in found.items():
            cells.sort()
            places[k] = cells, ranges[k][0] + np.cumsum([w for _, w, *_ in cells])
        for at, (k, behind) in held.items():
            if k not in places:
                continue
            cells, sums = places[k]
            i = min(int(np.searchsorted(sums, at[1], side="left")), len(cells) - 1)
            own = (k[0], cells[i][3], cells[i][4])
            following[own] = (float(sums[i] - cells[i][1]), cells[i][2], cells[i][1])
            held[at] = own, cells[i + 1][3] if i + 1 < len(cells) else behind
        # ranges whose rank has moved into a smaller one are closed
        ranges = {k: x for k, x in following.items() if any(k == r for r, _ in held.values())}
        width = max(16, min(bins, candidates // max(1, len(ranges))))
    values = {k: (np.array([k[1]]), np.array([below + w])) for k, (below, _, w) in ranges.items() if k[1] == k[2]}
    open_ = [k for k in ranges if k[1] < k[2]]
    if open_:
        bound = spark.createDataFrame([(i, *k) for i, k in enumerate(open_)], f"i int, {key}, lo double, hi double")
        inside: dict = {}
        for r in rows.join(F.broadcast(bound), "g").where("v between lo and hi").groupBy("i", "v").agg(F.sum("w").alias("w")).collect():
            inside.setdefault(open_[r["i"]], []).append((r["v"], r["w"]))
        for k, found in inside.items():
            found.sort()
            values[k] = np.array([v for v, _ in found]), ranges[k][0] + np.cumsum([w for _, w in found])

    def pick(g, t: float) -> float:
        k, behind = held[g, t]
        v, running = values[k]
        i = min(int(np.searchsorted(running, t, side="left")), len(v) - 1)
        if kind != "type2" or running[i] != t:
            return float(v[i])
        after = v[i + 1] if i + 1 < len(v) else v[i] if behind is None else behind
        return float((v[i] + after) / 2)

    out = []
    for g, r in groups.items():
        for p in probs:
            got = [pick(g, t[0]) for t in _targets(r, [p], kind)]
            share = 0.0 if kind == "type2" else float(type7_positions(float(r["n"]), np.array([p]))[2][0])
            out.append((g, float(p), got[0] if len(got) == 1 else (1 - share) * got[0] + share * got[1]))
    return spark.createDataFrame(out, f"{by} {frame.schema[by].dataType.simpleString()}, p double, q double")


def _targets(r, probs, kind: str) -> list[tuple[float]]:
    """Cumulative weights to reach, in the weights' own unit."""
    if kind == "type2":
        return [(p * r["w"],) for p in probs]
    low, high, _ = type7_positions(float(r["n"]), np.asarray(probs, float))
    scale, slack = r["w"] / r["n"], tolerance(float(r["n"]))
    return [((t - slack) * scale,) for pair in zip(low, high) for t in pair]


RANGES = 64


def range_of(rows: DataFrame, column: str) -> Column:
    """The number of the range, of about equal ones, in which a row's value lies: a tree of comparisons, six deep, inside generated code.

    Cuts come from one pass over ``rows``; pass rows that are summed by the column already, where that makes them few.
    """
    cuts = sorted(set(rows.approxQuantile(column, [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES)))

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(F.col(column) < float(cuts[middle]), tree(lo, middle)).otherwise(tree(middle + 1, hi))

    return tree(0, len(cuts))


def running_sums(rows: DataFrame, order: str, sums: dict[str, Column], by: list[str], descending: bool = False) -> DataFrame:
    """Add running sums (each row's own included) along ``order`` within groups, in two levels.

    The column ``range_`` (:func:`range_of`) divides the rows, whatever their
    group: a window sees one range, and one over the few totals of ranges
    carries the rest, so that no task holds a large group.
    """
    placed = rows.withColumns({f"in_{name}": c for name, c in sums.items()})
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    totals = placed.groupBy(*by, "range_").agg(*[F.sum(f"in_{n}").alias(f"all_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy(way("range_")).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*[F.col(c).alias(f"k_{c}") for c in by], F.col("range_").alias("k_range_"), *[F.coalesce(F.sum(f"all_{n}").over(before), F.lit(0.0)).alias(f"carry_{n}") for n in sums])
    same = F.col("range_") == F.col("k_range_")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    inside = Window.partitionBy(*by, "range_").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    full = placed.select("*", *[F.sum(f"in_{n}").over(inside).alias(f"own_{n}") for n in sums]).join(carry, same)
    return full.select(*rows.columns, *[(F.col(f"own_{n}") + F.col(f"carry_{n}")).alias(n) for n in sums])


def corrected_cdf(table: DataFrame, method: str, by: list[str], threshold: str = "t", cdf: str = "cdf") -> DataFrame:
    """Clipped and monotone values of step functions, by windows over each function's few thresholds."""
    ordered = Window.partitionBy(*by).orderBy(threshold)
    clipped = table.withColumn("c", F.least(F.greatest(F.col(cdf), F.lit(0.0)), F.lit(1.0)))
    if method == "none":
        return clipped.withColumnRenamed("c", "corrected")
    if method == "cummax":
        return clipped.withColumn("corrected", F.max("c").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("c")
    if method == "rearrange":
        ranks = clipped.withColumn("place_", F.row_number().over(ordered))
        values = clipped.select(*by, "c", F.row_number().over(Window.partitionBy(*by).orderBy("c")).alias("place_")).withColumnRenamed("c", "corrected")
        return ranks.drop("c").join(values, [*by, "place_"]).drop("place_")
    if method == "isotonic":
        # a function has as many rows as thresholds; neighbours that decrease are pooled in one pass over them
        def pooled(rows):
            rows = rows.sort_values(threshold, kind="stable")
            return rows.assign(corrected=np.clip(isotonic(rows["c"].to_numpy()), 0.0, 1.0)).drop(columns="c")

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        return clipped.groupBy(*by).applyInPandas(pooled, f"{types}, corrected double")
    raise DecompositionError(f"unknown correction {method!r}")


def inverted(table: DataFrame, probs, by: list[str], threshold: str = "t", cdf: str = "corrected") -> DataFrame:
    """First threshold whose value reaches each probability, else the last."""
    aggregates = [F.coalesce(F.min(F.when(F.col(cdf) >= p, F.col(threshold))), F.max(threshold)).alias(f"q{k}") for k, p in enumerate(probs)]
    wide = table.groupBy(*by).agg(*aggregates)
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q{k}").alias("q")) for k, p in enumerate(probs)])
    return wide.select(*by, F.explode(pairs).alias("x")).select(*by, "x.p", "x.q")


def crossing(frame: DataFrame, coefficients: np.ndarray, x: list[str], weight: str, by: list[str], tolerance_: float = 1e-8) -> DataFrame:
    """Crossing counts of fixed coefficients (p x m), as array expressions inside one aggregate."""
    columns = [F.lit(1.0), *(F.col(c) for c in x)]
    draws = []
    for k in range(coefficients.shape[1]):
        value = F.lit(0.0)
        for c, b in zip(columns, coefficients[:, k]):
            value = value + c * float(b)
        draws.append(value)
    falls = F.array(*[draws[k] - draws[k + 1] for k in range(len(draws) - 1)])
    rows = frame.select(*by, F.col(weight).alias("w"), F.filter(falls, lambda d: d > tolerance_).alias("d"))
    crossed = F.size("d") > 0
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum(crossed.cast("long")).alias("crossing_rows"), (F.sum(F.when(crossed, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("weighted_share"),
        F.sum(F.size("d").cast("long")).alias("crossing_pairs"), F.coalesce(F.max(F.array_max("d")), F.lit(0.0)).alias("max_crossing"),
        F.coalesce(F.sum(F.aggregate("d", F.lit(0.0), lambda a, v: a + v)), F.lit(0.0)).alias("sum_crossing"),
    )


def breslow(frame: DataFrame, time: str, event: str, weight: str, predictor: Column, by: list[str]) -> DataFrame:
    """Breslow baseline hazard of a fixed linear predictor: rows are summed by time before windows run over distinct times."""
    risk = F.col(weight) * F.exp(predictor)
    at = frame.groupBy(*by, F.col(time).alias("time")).agg(F.sum(F.col(weight) * F.col(event)).alias("d"), F.sum(risk).alias("s")).persist()
    at = at.withColumn("range_", range_of(at, "time"))
    at_risk = running_sums(at, "time", {"r": F.col("s")}, by, descending=True)
    return running_sums(at_risk, "time", {"hazard": F.col("d") / F.col("r")}, by).select(*by, "time", "d", "r", "hazard").where("d > 0")


_PRIME = 2147483647
#: Factors of the mixing rounds: each product of two numbers below 2**31 fits 64 bits, so any engine gives the same.
_ROUNDS = (1597334677, 1223106847, 1389796)


def hash_exponential(key: Column, replication: Column) -> Column:
    """An Exp(1) number of key and replication by rounds of multiplication modulo a prime and shifts: the same in any engine with 64-bit integers."""
    prime = F.lit(_PRIME).cast("long")
    h = F.pmod(F.pmod(key.cast("long"), prime) + F.shiftright(key.cast("long"), 31) * 69621, prime)
    for k, factor in enumerate(_ROUNDS):
        h = F.pmod(h.bitwiseXOR(F.shiftright(h, 15 - k)) * F.lit(factor).cast("long") + replication.cast("long") * (40503 + 2 * k) + 11, prime)
    return -F.ln((h + F.lit(0.5)) / F.lit(float(_PRIME)))


def multipliers(frame: DataFrame, key: str, weight: str, reps: int, keep: list[str]) -> DataFrame:
    """Rows repeated for every replication ``rep`` with their multiplied weight ``w`` and the columns ``keep``."""
    rows = frame.select(*keep, F.col(key).alias("k_"), F.col(weight).cast("double").alias("w_"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    return rows.select(*keep, "rep", (F.col("w_") * hash_exponential(F.col("k_"), F.col("rep"))).alias("w"))


def multiplier_draws(frame: DataFrame, key: str, y: str, group: str, weight: str, reps: int) -> DataFrame:
    """The difference of weighted group means in every replication of a multiplier bootstrap: rep, effect. One aggregate."""
    rows = multipliers(frame.select(F.col(key), F.col(y).alias("y"), F.col(group).alias("g"), F.col(weight)), key, weight, reps, ["y", "g"])
    sums = rows.groupBy("rep", "g").agg(F.sum(F.col("w") * F.col("y")).alias("s"), F.sum("w").alias("w"))
    mean = lambda g: F.max(F.when(F.col("g") == g, F.col("s") / F.col("w")))
    return sums.groupBy("rep").agg((mean(1) - mean(0)).alias("effect"))


def multiplier_quantile_draws(frame: DataFrame, key: str, y: str, group: str, weight: str, reps: int, probs) -> DataFrame:
    """The total effect at each quantile in every replication of a multiplier bootstrap: rep, quantile, estimate.

    Quantiles are exact and need no sort; replications times groups are limited to 1000.
    """
    rows = multipliers(frame.select(F.col(key), F.col(y).alias("y"), F.col(group).cast("int").alias("g"), F.col(weight)), key, weight, reps, ["y", "g"])
    found = exact_quantiles(rows.withColumn("cell", F.col("rep") * 2 + F.col("g")), "y", "w", probs, "cell", "type2")
    side = lambda g: F.max(F.when(F.col("cell") % 2 == g, F.col("q")))
    return found.groupBy(F.floor(F.col("cell") / 2).cast("int").alias("rep"), F.col("p").alias("quantile")).agg((side(1) - side(0)).alias("estimate"))


def bands(draws: DataFrame, point: DataFrame, alpha: float, z: float, by: list[str] | None = None) -> DataFrame:
    """Standard errors and bands of draws (rep, quantile, estimate) around points (quantile, estimate), by aggregates; ``by`` keeps curves apart."""
    by = by or []
    se = draws.groupBy(*by, "quantile").agg(F.stddev_samp("estimate").alias("se"), F.count("estimate").alias("reps_effective"))
    joint = point.join(se, [*by, "quantile"])
    largest = draws.withColumnRenamed("estimate", "d").join(joint, [*by, "quantile"]).where("se > 0").groupBy(*by, "rep").agg(F.max(F.abs(F.col("d") - F.col("estimate")) / F.col("se")).alias("t"))
    critical = largest.groupBy(*by).agg(F.percentile("t", F.lit(1 - alpha)).alias("c"))
    e, s, c = F.col("estimate"), F.col("se"), F.coalesce("c", F.lit(0.0))
    both = joint.join(critical, by, "left") if by else joint.join(F.broadcast(critical))
    return both.select(
        *by, "quantile", "estimate", F.col("se").alias("std_error"), (e - z * s).alias("pointwise_lower"), (e + z * s).alias("pointwise_upper"), (e - c * s).alias("uniform_lower"), (e + c * s).alias("uniform_upper"), "reps_effective"
    )


def curve_tests(draws: DataFrame, point: DataFrame) -> DataFrame:
    """KS and CMS statistics of the zero hypothesis with p-values, by aggregates."""
    joint = draws.withColumnRenamed("estimate", "d").join(F.broadcast(point), "quantile").withColumn("centred", F.col("d") - F.col("estimate"))
    variance = joint.groupBy("quantile").agg(F.var_samp("centred").alias("v"))
    own = point.join(variance, "quantile").agg(F.sqrt(F.max(F.col("estimate") ** 2 / F.col("v"))).alias("ks"), F.avg(F.col("estimate") ** 2 / F.col("v")).alias("cms"))
    each = joint.join(F.broadcast(variance), "quantile").groupBy("rep").agg(F.sqrt(F.max(F.col("centred") ** 2 / F.col("v"))).alias("k"), F.avg(F.col("centred") ** 2 / F.col("v")).alias("c"))
    return each.join(F.broadcast(own)).groupBy("ks", "cms").agg(F.avg((F.col("k") > F.col("ks")).cast("double")).alias("ks_p"), F.avg((F.col("c") > F.col("cms")).cast("double")).alias("cms_p"))
