"""Average ranks and rank correlation without sorting a column in one task.

Equal values are counted first, so a value that fills a third of the rows is a
single row from then on. The distinct values are cut into ranges at approximate
quantiles and each range is ordered by itself. The cuts only balance the work;
ranks are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefops import constants as K
from prefops.operators.sums import added
from prefops.schema import require
from prefops.sources.io import written

HOT_VALUES = 2048


def _default_buckets(df: DataFrame, groups: int = 1) -> int:
    """A power of two; over all groups at least twice the shuffle partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(16, 1 << (2 * partitions // groups).bit_length())


def _probabilities(buckets: int) -> list[float]:
    return [i / buckets for i in range(1, buckets)]


def _quantiles(df: DataFrame, columns: list[str], buckets: int) -> list[list[float]]:
    """Cuts of several columns, read to the driver: buckets - 1 numbers each."""
    return df.approxQuantile(columns, _probabilities(buckets), 0.25 / buckets)


def _literal(numbers: Sequence[float]) -> Column:
    """Numbers as one literal, which is folded once and not built number by number."""
    return F.split(F.lit(" ".join(map(repr, numbers))), " ").try_cast("array<double>")


def _range_of(value: Column, cuts: Column, buckets: int) -> Column:
    """How many of the buckets - 1 sorted cuts are below the value, by bisection."""
    steps = [buckets >> i for i in range(1, buckets.bit_length())]
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(F.get(cuts, at + step - 1) < value, at + step).otherwise(at),
    )
    return F.coalesce(found, F.lit(0))


def average_ranks(
    df: DataFrame, value: str, buckets: int | None = None, cuts: Sequence[float] | None = None
) -> DataFrame:
    """One row per distinct value: (value, n, rank, rows), ranks from 1, ties averaged.

    `rows` is the number of all ranked rows. Without `cuts` they are computed
    when this is called.
    """
    require(df, value)
    buckets = buckets or _default_buckets(df)
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias(value))
    cuts = _quantiles(known, [value], buckets)[0] if cuts is None else cuts
    counts = known.groupBy(value).agg(F.count("*").alias("n"))
    ranged = counts.withColumn("_b", _range_of(F.col(value), _literal(cuts), buckets))
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # At most `buckets` rows.
    offsets = (
        ranged.groupBy("_b")
        .agg(F.sum("n").alias("_n"))
        .select("_b", F.sum("_n").over(before).alias("_before"), F.sum("_n").over(whole).alias("rows"))
    )
    placed = ranged.withColumn("_inside", F.sum("n").over(inside)).join(F.broadcast(offsets), "_b")
    rank = F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0)) + (F.col("n") + 1) / 2
    return placed.select(value, "n", rank.alias("rank"), "rows")


def with_average_rank(
    df: DataFrame,
    value: str,
    key: str,
    name: str = "rank",
    buckets: int | None = None,
    centred: bool = False,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Add the average rank of `value` to every row, less the mean rank when `centred`.

    Ranks of frequent values, at most HOT_VALUES of them, are broadcast. The
    rows that found theirs there are spread over a salt in the join for the
    rest.
    """
    require(df, value, key)
    ranks = average_ranks(df, value, buckets, cuts)
    if centred:
        ranks = ranks.withColumn("rank", F.col("rank") - (F.col("rows") + 1) / 2)
    is_hot = F.col("n") * HOT_VALUES > F.col("rows")
    hot = ranks.where(is_hot).select(F.col(value).alias("_hv"), F.col("rank").alias("_hot"))
    cold = ranks.where(~is_hot).select(F.col(value).alias("_cv"), F.lit(0).alias("_cs"), F.col("rank").alias("_cold"))
    met = df.join(F.broadcast(hot), df[value] == hot["_hv"], "left")
    salt = F.when(F.col("_hot").isNull() & F.col(value).isNotNull(), F.lit(0)).otherwise(
        (F.pmod(F.xxhash64(key), F.lit(65536)) + 1).cast("int")
    )
    met = met.withColumn("_salt", salt)
    met = met.join(cold, (met[value] == cold["_cv"]) & (met["_salt"] == cold["_cs"]), "left")
    return met.select(*df.columns, F.coalesce("_hot", "_cold").alias(name))


def _rank_correlation(
    rows: DataFrame, cuts: DataFrame | Sequence[float], by: Sequence[str], x: str, y_rank: str, buckets: int
) -> DataFrame:
    """Correlation of the ranks of `x` with given centred ranks, per group of `by`.

    With N rows the mean rank is (N + 1) / 2, so all sums are taken around it.
    Each range of x is summed up with ranks counted from its own start; its
    offset enters afterwards, on a table of at most `buckets` rows per group.
    `cuts` are numbers, or a table of them per group (column `_cuts`) that is
    broadcast, so the number of groups must be bounded.
    """
    keys = list(by)
    values = rows.groupBy(*keys, x).agg(
        F.count("*").alias("n"),
        F.sum(y_rank).alias("_y"),
        F.sum(F.col(y_rank) * F.col(y_rank)).alias("_yy"),
    )
    if isinstance(cuts, DataFrame):
        values, cut_array = values.join(F.broadcast(cuts), keys), F.col("_cuts")
    else:
        cut_array = _literal(cuts)
    ranged = values.withColumn("_b", _range_of(F.col(x).cast("double"), cut_array, buckets))
    inside = Window.partitionBy(*keys, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select(
        *keys,
        "_b",
        "n",
        (F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2).alias("_r"),
        "_y",
        "_yy",
    )
    sums = local.groupBy(*keys, "_b").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("_r")).alias("_r"),
        F.sum(F.col("n") * F.col("_r") * F.col("_r")).alias("_rr"),
        F.sum("_y").alias("_y"),
        F.sum("_yy").alias("_yy"),
        F.sum(F.col("_r") * F.col("_y")).alias("_ry"),
    )
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - (F.sum("n").over(whole) + 1) / 2
    moved = sums.withColumn("_s", shift)
    s = F.col("_s")
    per_group = moved.groupBy(*keys).agg(
        F.sum(F.col("_ry") + s * F.col("_y")).alias("_cov"),
        F.sum(F.col("_rr") + 2 * s * F.col("_r") + F.col("n") * s * s).alias("_vx"),
        F.sum("_yy").alias("_vy"),
    )
    corr = F.try_divide(F.col("_cov"), F.sqrt("_vx") * F.sqrt("_vy"))
    return per_group.select(*keys, corr.alias("corr"))


def spearman(df: DataFrame, x: str, y: str, key: str = "id", buckets: int | None = None) -> DataFrame:
    """Rank correlation of two columns over the rows that have both; null for a constant column."""
    require(df, x, y, key)
    buckets = buckets or _default_buckets(df)
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        key, *[F.col(c).cast("double").alias(c) for c in (x, y)]
    )
    cuts = _quantiles(both, [x, y], buckets)
    ranked = with_average_rank(both, y, key, "_ry", buckets, centred=True, cuts=cuts[1])
    return _rank_correlation(ranked, cuts[0], [], x, "_ry", buckets)


def verbosity_penalties(
    df: DataFrame,
    rewards: str = "rewards",
    key: str = "id",
    objectives: int | None = None,
    dim: int = K.VERBOSITY_DIM,
    threshold: float = 0.03,
    grid: Sequence[float] = K.VERBOSITY_GRID,
    per_pass: int = 64,
    decimals: int = 9,
    buckets: int | None = None,
    ranges: int = 256,
) -> DataFrame:
    """Smallest penalty per objective that frees it from the verbosity objective.

    (objective, penalty, corr): the least p of the grid for which the rank
    correlation of r_j - p · r_dim with r_dim is at most `threshold`. When none
    is, the penalty is 1 and corr the least correlation seen; `dim` itself keeps
    1 and 1. A correlation that is undefined never passes.

    One scan bounds the correlation of every objective and penalty from both
    sides (`_bounds`); only points that the bounds leave open are ranked
    exactly, `per_pass` at a time, usually one per objective. The driver gets
    3 × `ranges` numbers per point. The rewards, and then the rewards with the
    rank of `dim`, are written to the shared folder, so that a pass starts from
    a table.
    """
    require(df, rewards, key)
    spark = df.sparkSession
    r = F.col(rewards)
    n_obj = objectives or df.select(F.max(F.size(rewards))).first()[0] or 0
    rounded = df.select(
        key, F.transform(r, lambda v: F.round(v.cast("double"), decimals)).alias("_r")
    ).withColumn("_v", F.get("_r", F.lit(dim)))
    rounded = written(rounded, "rewards")
    ranked = with_average_rank(rounded, "_v", key, "_ry", buckets, centred=True).select("_r", "_v", "_ry")
    ranked = written(ranked, "ranked-rewards")
    points = [(j, float(p)) for j in range(n_obj) if j != dim for p in sorted(grid)]
    found, least = {}, {j: 1.0 for j in range(n_obj)}
    if points:
        per_pass = max(1, per_pass)
        exact_ranges = buckets or _default_buckets(ranked, min(per_pass, len(points)))
        sample = _reward_sample(ranked, n_obj, max(SAMPLE, 16 * exact_ranges))
        bounds = _bounds(ranked, points, sample, dim, decimals, ranges)
        open_points = _open_points(points, bounds, threshold)
        for at in range(0, len(open_points), per_pass):
            chunk = [(j, p) for j, p in open_points[at : at + per_pass] if j not in found]
            for row in _exact(ranked, chunk, sample, dim, decimals, exact_ranges) if chunk else []:
                if row.j in found or row.corr is None:
                    continue
                if row.corr <= threshold:
                    found[row.j] = (row.p, row.corr)
                else:
                    least[row.j] = min(least[row.j], row.corr)
    return _penalty_table(spark, n_obj, found, least)


#: Rows drawn to place cuts. Cuts only decide how tight bounds and how even parts are, never a result.
SAMPLE = 16_384


def _reward_sample(ranked: DataFrame, n_obj: int, size: int) -> np.ndarray:
    """About `size` rows of rewards, drawn by chance; all rows when there are no more than that."""
    n = ranked.count()
    drawn = ranked if n <= size else ranked.sample(size / n, seed=0)
    rows = drawn.select(*[F.get("_r", F.lit(j)).alias(f"r{j}") for j in range(n_obj)]).toArrow()
    return np.column_stack([rows[c].to_numpy().astype(float) for c in rows.column_names])


def _cuts_of(sample: np.ndarray, j: int, p: float, dim: int, decimals: int, ranges: int) -> np.ndarray:
    """ranges - 1 cuts of r_j - p · r_dim, each between two numbers of so many decimals."""
    x = sample[:, j] - p * sample[:, dim]
    x = x[np.isfinite(x)]
    if not x.size:
        return np.arange(ranges - 1, dtype=float)
    cuts = np.quantile(x, _probabilities(ranges), method="lower")
    return (np.floor(cuts * 10.0**decimals) + 0.5) / 10.0**decimals


def _bounds(
    ranked: DataFrame, points: list, sample: np.ndarray, dim: int, decimals: int, ranges: int
) -> list[tuple[float, float]]:
    """Least and greatest possible rank correlation of x = r_j - p · r_dim with r_dim, per point (j, p).

    The ranks y of r_dim are known. The values x are cut into ranges, and per
    range the number of rows, the sum of y and that of y² are added up. Ranges
    are in order, so the mean rank of x in each is known, and ranks differ from
    it by at most what n rows without ties do; by Cauchy and Schwarz, the rest
    of the covariance is at most sqrt(n (n² - 1) / 12 · sum (y - mean y)²) per
    range. Two ranges become one where a value lies so close to the cut between
    them that rounding decides its side. Where a value is missing or not finite
    nothing is known: -1 and 1.
    """
    all_cuts = np.array([_cuts_of(sample, j, p, dim, decimals, ranges) for j, p in points])
    sent = ranked.sparkSession.sparkContext.broadcast((points, all_cuts))
    dims = sorted({j for j, _ in points} | {dim})
    unit = 10.0**-decimals

    def summed(batches):
        points, cuts = sent.value
        sums = np.zeros((len(points), 3, ranges))
        close = np.zeros((len(points), ranges + 1))
        unknown = np.zeros(len(points))
        edges = np.pad(cuts, ((0, 0), (1, 1)), constant_values=((0, 0), (-np.inf, np.inf)))
        for batch in batches:
            r = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in batch.schema.names}
            y = r["_ry"]
            for i, (j, p) in enumerate(points):
                x = r[f"r{j}"] - p * r[f"r{dim}"]
                known = np.isfinite(x) & np.isfinite(y)
                if not known.all():
                    unknown[i] += 1
                    continue
                at = np.searchsorted(cuts[i], x)
                near = np.maximum(unit / 1000, 8 * np.spacing(np.abs(x)))
                close[i] += np.bincount(at[x - edges[i][at] <= near], minlength=ranges + 1)
                close[i] += np.bincount(at[edges[i][at + 1] - x <= near] + 1, minlength=ranges + 1)
                sums[i, 0] += np.bincount(at, minlength=ranges)
                sums[i, 1] += np.bincount(at, y, minlength=ranges)
                sums[i, 2] += np.bincount(at, y * y, minlength=ranges)
        flat = np.hstack([sums.reshape(len(points), -1), close, unknown[:, None]])
        yield pa.RecordBatch.from_pydict(
            {"point": pa.array(range(len(points)), pa.int32()), "v": pa.array(list(flat), pa.list_(pa.float64()))}
        )

    columns = ranked.select("_ry", *[F.get("_r", F.lit(j)).alias(f"r{j}") for j in dims])
    total = added(columns.mapInArrow(summed, "point int, v array<double>"), "point").collect()
    out = [(-1.0, 1.0)] * len(points)
    for row in total:
        v = np.array(row.v)
        if not v[-1]:
            out[row.point] = _corr_bounds(v[: 3 * ranges].reshape(3, ranges), v[3 * ranges + 1 : 4 * ranges] > 0)
    return out


def _corr_bounds(sums: np.ndarray, merged: np.ndarray) -> tuple[float, float]:
    """Bounds from (rows, sum of y, sum of y²) per range; `merged` says which cuts don't count."""
    first = np.flatnonzero(np.concatenate([[True], ~merged]))
    n, y, yy = np.add.reduceat(sums, first, axis=1)
    n, y, yy = n[n > 0], y[n > 0], yy[n > 0]
    mean_rank = np.cumsum(n) - n + (n + 1) / 2 - (n.sum() + 1) / 2
    within = n * (n * n - 1) / 12
    cov = (mean_rank * y).sum()
    rest = np.sqrt(within * np.maximum(yy - y * y / np.maximum(n, 1), 0)).sum()
    least_vx = (n * mean_rank**2).sum()
    if least_vx <= 0 or yy.sum() <= 0:
        return -1.0, 1.0
    least, greatest = np.sqrt(least_vx * yy.sum()), np.sqrt((least_vx + within.sum()) * yy.sum())
    low, high = cov - rest, cov + rest
    slack = 1e-9  # sums of doubles
    return (
        max(-1.0, low / (least if low < 0 else greatest) - slack),
        min(1.0, high / (greatest if high < 0 else least) + slack),
    )


def _open_points(points: list, bounds: list, threshold: float) -> list:
    """The points that must be ranked exactly to know each objective's penalty and correlation, by ascending penalty."""
    by_objective: dict[int, list] = {}
    for (j, p), (low, high) in zip(points, bounds):
        by_objective.setdefault(j, []).append((p, low, high))
    chosen = []
    for j, tried in by_objective.items():
        sure = min((p for p, low, high in tried if high <= threshold and low > -1), default=None)
        if sure is not None:
            chosen += [(j, p) for p, low, _ in tried if p == sure or p < sure and low <= threshold]
        else:
            least = min((high for _, low, high in tried if (low, high) != (-1.0, 1.0)), default=1.0)
            chosen += [(j, p) for p, low, _ in tried if low <= max(threshold, least)]
    return sorted(chosen, key=lambda point: (point[1], point[0]))


def _exact(ranked: DataFrame, points: list, sample: np.ndarray, dim: int, decimals: int, ranges: int) -> list:
    """Rows (j, p, corr) of the given points, by ascending penalty."""
    tried = F.array(
        *[
            F.struct(
                F.lit(j).alias("j"),
                F.lit(p).alias("p"),
                F.round(F.get("_r", F.lit(j)) - F.lit(p) * F.col("_v"), decimals).alias("x"),
            )
            for j, p in points
        ]
    )
    rows = ranked.select("_ry", F.inline(tried))
    placed = [(j, p, _cuts_of(sample, j, p, dim, decimals, ranges).tolist()) for j, p in points]
    cuts = ranked.sparkSession.createDataFrame(placed, "j int, p double, _cuts array<double>")
    corrs = _rank_correlation(rows, cuts, ["j", "p"], "x", "_ry", ranges).collect()
    return sorted(corrs, key=lambda row: (row.p, row.j))


def _penalty_table(spark: SparkSession, n_obj: int, found: dict, least: dict) -> DataFrame:
    rows = [(j, *found.get(j, (1.0, least[j]))) for j in range(n_obj)]
    rows = [(j, float(p), float(c)) for j, p, c in rows]
    return spark.createDataFrame(rows, "objective int, penalty double, corr double")
