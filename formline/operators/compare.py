"""Paired comparison of two out-of-fold prediction sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import scores
from formline.operators import metrics

# Resamples and seed of a comparison.
N_BOOTSTRAP = 10_000
SEED = 42
#: Modulus of the weight arithmetic, and where in its range Poisson(1) reaches 1, 2, 3 and so on.
PRIME = 2 ** 31 - 1
POISSON_LIMITS = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k))) for k in range(1, 10)]
BUCKETS = 4096
#: Rows and replicates of a block of weights, and tasks of the bootstrap.
ROWS_AT_ONCE, DRAWS_AT_ONCE, TASKS_PER_CORE = 256, 128, 3
_PRIME, _BITS = np.uint64(PRIME), np.uint64(31)
MEASURES = ("ll_delta", "brier_delta")


def paired(baseline: DataFrame, variant: DataFrame) -> DataFrame:
    """Per-match loss differences (variant minus baseline). Unequal row sets or
    labels stop the job."""
    def losses(df: DataFrame, tag: str) -> DataFrame:
        return df.select("pos", F.col("fold").alias(f"fold_{tag}"), F.col("y_true").alias(f"y_{tag}"),
                         metrics.log_loss().alias(f"ll_{tag}"), metrics.brier().alias(f"brier_{tag}"))
    both = losses(baseline, "b").join(losses(variant, "v"), "pos", "full_outer")
    same_rows = F.col("y_b").isNotNull() & F.col("y_v").isNotNull()
    guard = (F.when(~same_rows, F.raise_error("prediction row sets differ; not comparable").cast("long"))
             .when(F.col("y_b") != F.col("y_v"), F.raise_error("labels differ; not comparable").cast("long"))
             .otherwise(F.col("pos")))
    return both.select(guard.alias("pos"), F.col("fold_b").alias("fold"), F.col("y_b").alias("y_true"),
                       (F.col("ll_v") - F.col("ll_b")).alias("ll_delta"),
                       (F.col("brier_v") - F.col("brier_b")).alias("brier_delta"))


def fold_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("ll_delta").alias("ll_delta"),
                                      F.avg("brier_delta").alias("brier_delta"))


def _mixed(item: Column, replicate: Column, seed: int) -> Column:
    """A number below ``PRIME``: item and replicate mixed by squares, in numbers below 2^62,
    so any engine with 64-bit integers repeats it."""
    x = (item % PRIME * 48271 + replicate * 69621 + F.lit(seed * 16807)) % PRIME
    for add in (replicate + 1, F.lit(104729)):
        x = (x * x % PRIME * 40692 + x * 30269 + add) % PRIME
    return x


def poisson_weight(mixed: Column) -> Column:
    """Poisson(1) weight of an evenly spread number below ``PRIME``."""
    return scores.total((mixed >= limit).cast("int") for limit in POISSON_LIMITS)


def bootstrap_buckets(deltas: DataFrame, seed: int = SEED) -> DataFrame:
    """``bucket, n, ll_delta, brier_delta``: counts and sums of the rows of every bucket, a hash of the position."""
    bucket = _mixed(F.col("pos"), F.lit(0), seed + 1) % BUCKETS
    return deltas.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ll_delta").alias("ll_delta"), F.sum("brier_delta").alias("brier_delta"))


def _fold(x: np.ndarray, spare: np.ndarray) -> None:
    """``x`` to a smaller number of the same remainder modulo ``PRIME``, in place: the prime is 2^31 - 1, so high bits count as low ones."""
    np.right_shift(x, _BITS, out=spare)
    np.bitwise_and(x, _PRIME, out=x)
    np.add(x, spare, out=x)


def _least(x: np.ndarray, spare: np.ndarray) -> None:
    """Numbers below twice the prime to their remainders, in place: below the prime the difference wraps around to a large one."""
    np.subtract(x, _PRIME, out=spare)
    np.minimum(x, spare, out=x)


def bootstrap_sums(pos: np.ndarray, values: np.ndarray, n_boot: int, seed: int = SEED) -> np.ndarray:
    """Sums of the rows' ``values`` (a line per measure) in every replicate, each row taken with ``poisson_weight`` of
    ``_mixed``; worked off in blocks of rows and replicates that stay in the processor's cache."""
    total = np.zeros((len(values), n_boot))
    rows, draws = (pos % PRIME * 48271 % PRIME).astype(np.uint64), np.arange(n_boot, dtype=np.uint64)
    start, adds = (draws * np.uint64(69621) + np.uint64(seed * 16807)) % _PRIME, draws + np.uint64(1)
    size = ROWS_AT_ONCE * DRAWS_AT_ONCE
    wide, narrow, bits, count, weight = (np.empty((3, size), np.uint64), np.empty(size, np.uint32), np.empty(size, bool),
                                         np.empty(size, np.uint8), np.empty(size))
    for i in range(0, len(rows), ROWS_AT_ONCE):
        row = rows[i:i + ROWS_AT_ONCE, None]
        for j in range(0, n_boot, DRAWS_AT_ONCE):
            add = adds[None, j:j + DRAWS_AT_ONCE]
            shape = len(row), add.shape[1]
            used = shape[0] * shape[1]
            x, y, spare = (w[:used].reshape(shape) for w in wide)
            np.add(row, start[None, j:j + DRAWS_AT_ONCE], out=x)
            _least(x, spare)
            for more in (add, np.uint64(104729)):
                np.multiply(x, x, out=y)
                _fold(y, spare)
                np.multiply(y, np.uint64(40692), out=y)
                np.multiply(x, np.uint64(30269), out=x)
                np.add(x, y, out=x)
                np.add(x, more, out=x)
                _fold(x, spare)
            _least(x, spare)
            mixed, over, w, real = (a[:used].reshape(shape) for a in (narrow, bits, count, weight))
            np.copyto(mixed, x, casting="unsafe")
            np.greater_equal(mixed, np.uint32(POISSON_LIMITS[0]), out=w.view(bool))
            for limit in POISSON_LIMITS[1:]:
                np.greater_equal(mixed, np.uint32(limit), out=over)
                np.add(w, over.view(np.uint8), out=w)
            np.copyto(real, w)
            total[:, j:j + DRAWS_AT_ONCE] += values[:, i:i + ROWS_AT_ONCE] @ real
    return total


def bootstrap_ci(deltas: DataFrame, n_boot: int = N_BOOTSTRAP, seed: int = SEED) -> DataFrame:
    """Mean differences with their 95% bootstrap intervals, one row per measure.

    Rows are resampled at every size: a row counts in a replicate with a Poisson(1) weight of its position, which
    needs no pass to know the number of rows. Tasks add up their rows for all replicates; one small aggregate adds the tasks.
    """
    def draw(batches):
        total = np.zeros((1 + len(MEASURES), n_boot))
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", *MEASURES)]
            total += bootstrap_sums(columns[0], np.vstack([np.ones(len(batch)), *columns[1:]]), n_boot, seed)
        yield pa.RecordBatch.from_pydict({"replicate": np.arange(n_boot), "n": total[0]} | dict(zip(MEASURES, total[1:])))

    tasks = deltas.sparkSession.sparkContext.defaultParallelism * TASKS_PER_CORE
    schema = "replicate long, n double, " + ", ".join(f"{m} double" for m in MEASURES)
    sums = deltas.select("pos", *MEASURES).repartition(tasks, "pos").mapInArrow(draw, schema).groupBy("replicate").agg(
        *[F.sum(c).alias(c) for c in ("n", *MEASURES)]).where(F.col("n") > 0)
    spread = sums.select(*[(F.col(m) / F.col("n")).alias(m) for m in MEASURES])
    bounds = spread.agg(*[F.percentile(m, p).alias(f"{m}_{tag}") for m in MEASURES
                          for p, tag in ((0.025, "ci_low"), (0.975, "ci_high"))])
    means = deltas.agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"{m}_mean_delta") for m in MEASURES])

    def by_measure(row: DataFrame, carry: tuple[str, ...], *names: str) -> DataFrame:
        return row.select(*carry, F.inline(F.array(*[
            F.struct(F.lit(m).alias("measure"), *[F.col(f"{m}_{n}").alias(n) for n in names]) for m in MEASURES])))

    return by_measure(means, ("n",), "mean_delta").join(by_measure(bounds, (), "ci_low", "ci_high"), "measure")


def with_verdict(intervals: DataFrame) -> DataFrame:
    verdict = (F.when(F.col("ci_high") < 0, "IMPROVEMENT").when(F.col("ci_low") > 0, "DEGRADATION")
               .otherwise("INCONCLUSIVE"))
    return intervals.withColumn("verdict", verdict)
