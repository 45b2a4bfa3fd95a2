"""Initial centres: explicit, random rows, k-means++, or a callable.

Row order is the order of ids. Random numbers come from the driver's streams,
so a seed gives the same rows however the samples are partitioned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..functions.rng import streams
from ..operators.blocks import dense, numbers

RENEW_EVERY = 16


def race_uniform(seed: int):
    """A uniform number in (0, 1) for each id."""
    return (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def random_rows(samples: DataFrame, k: int, seed: int) -> DataFrame:
    """(id, features): k rows drawn without replacement with chances by weight, by an exponential race in one pass."""
    arrival = -F.log(race_uniform(seed)) / F.col("weight")
    return samples.where("weight > 0").withColumn("arrival", arrival).orderBy("arrival", "id").limit(k).select("id", "features")


def as_centers(rows: DataFrame, k: int) -> tuple[np.ndarray, list[int]]:
    found = rows.collect()
    if len(found) < k:
        raise ValueError(f"{k} centres are asked for, but only {len(found)} samples have weight")
    return np.array([r["features"] for r in found], np.float64), [r["id"] for r in found]


class Potentials:
    """Samples in id order with each one's weighted squared distance to the closest centre so far."""

    def __init__(self, samples: DataFrame):
        parts = max(1, samples.rdd.getNumPartitions())
        ordered = samples.select("id", "features", "weight").repartitionByRange(parts, "id").sortWithinPartitions("id")
        self.rows = ordered.withColumn("pot", F.lit(float("inf"))).persist()
        self.fresh: list[np.ndarray] = []
        self.sizes = self._per_partition(lambda x, w, pot: np.array([len(x)], float), 1)[:, 0].astype(np.int64)

    def _per_partition(self, measure, width: int) -> np.ndarray:
        """One row for each partition, in order: sums over its batches of ``measure(x, w, pot)``."""
        fresh = list(self.fresh)

        def run(batches):
            total = np.zeros(width)
            for batch in batches:
                total = total + measure(*_closest(batch, fresh))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["part", "total"])

        found = sorted(self.rows.mapInArrow(run, "part int, total array<double>").collect(), key=lambda r: r["part"])
        return np.array([r["total"] for r in found]).reshape(len(found), width)

    def row_at(self, position: int) -> tuple[int, np.ndarray]:
        """Id and features of the row at a place in id order."""
        ends = np.cumsum(self.sizes)
        part = int(np.searchsorted(ends, position, side="right"))
        return self._pick({part: [(0, float(position - (ends[part] - self.sizes[part])))]}, by_count=True)[0]

    def _pick(self, wanted: dict[int, list[tuple[int, float]]], by_count: bool = False) -> dict[int, tuple[int, np.ndarray]]:
        """For each (trial, target) of a partition the row at which the running sum reaches the target, or the last row."""
        fresh = list(self.fresh)

        def run(batches):
            left = {t: v for t, v in wanted.get(TaskContext.get().partitionId(), [])}
            last = None
            ids, vectors, trials = [], [], []

            def give(trial: int, row: tuple) -> None:
                trials.append(trial)
                ids.append(row[0])
                vectors.append(row[1].tolist())

            for batch in batches:
                if not left:
                    continue
                x, _, pot = _closest(batch, fresh)
                own = numbers(batch, "id")
                sums = np.arange(len(own), dtype=float) if by_count else np.cumsum(pot)
                for trial, target in list(left.items()):
                    at = int(np.searchsorted(sums, target, side="left"))
                    if at < len(own):
                        give(trial, (own[at], x[at]))
                        del left[trial]
                    else:
                        left[trial] = target - (len(own) if by_count else sums[-1]) if len(own) else target
                if len(own):
                    last = (own[-1], x[-1])
            for trial in left:
                if last is not None:
                    give(trial, last)
            yield pa.RecordBatch.from_arrays([pa.array(trials, pa.int32()), pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], ["trial", "id", "features"])

        rows = self.rows.mapInArrow(run, "trial int, id long, features array<double>").collect()
        return {r["trial"]: (r["id"], np.array(r["features"])) for r in rows}

    def add(self, center: np.ndarray) -> None:
        """Adopts a centre; every RENEW_EVERY centres the stored distances are brought up to date."""
        self.fresh.append(center)
        if len(self.fresh) < RENEW_EVERY:
            return
        fresh = list(self.fresh)

        def run(batches):
            for batch in batches:
                yield batch.set_column(batch.schema.get_field_index("pot"), "pot", pa.array(_closest(batch, fresh)[2]))

        renewed = self.rows.mapInArrow(run, self.rows.schema).persist()
        renewed.count()
        self.rows.unpersist()
        self.rows, self.fresh = renewed, []

    def totals(self) -> np.ndarray:
        return self._per_partition(lambda x, w, pot: np.array([pot.sum()]), 1)[:, 0]

    def totals_with(self, candidates: np.ndarray) -> np.ndarray:
        """(partition, candidate): total potential if the candidate were adopted."""

        def measure(x, w, pot):
            return np.array([np.minimum(w * ((x - c) ** 2).sum(axis=1), pot).sum() for c in candidates])

        return self._per_partition(measure, len(candidates))

    def pick(self, totals: np.ndarray, targets: list[float]) -> list[tuple[int, np.ndarray]]:
        """The row at which the running potential reaches each target."""
        ends = np.cumsum(totals)
        filled = np.flatnonzero(self.sizes)
        wanted: dict[int, list[tuple[int, float]]] = {}
        for trial, target in enumerate(targets):
            part = int(min(np.searchsorted(ends, target, side="left"), filled[-1]))
            while self.sizes[part] == 0:
                part += 1
            wanted.setdefault(part, []).append((trial, float(target - (ends[part] - totals[part]))))
        found = self._pick(wanted)
        return [found[i] for i in range(len(targets))]

    def close(self) -> None:
        self.rows.unpersist()


def _closest(batch: pa.RecordBatch, fresh: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, w, pot = dense(batch), numbers(batch, "weight"), numbers(batch, "pot")
    for c in fresh:
        pot = np.minimum(pot, w * ((x - c) ** 2).sum(axis=1))
    return x, w, pot


def kmeans_plusplus(samples: DataFrame, k: int, seed: int) -> tuple[np.ndarray, list[int]]:
    """k centres and their sample ids, greedy with 2 + floor(ln k) candidates for each centre after the first.

    The first centre is uniform and ignores weights; potentials are weighted.
    Two jobs a centre, each answering for all candidates at once.
    """
    trials = 2 + int(math.log(k))
    draw = streams(trials, seed)
    state = Potentials(samples)
    try:
        n = int(state.sizes.sum())
        if n < k:
            raise ValueError(f"{k} centres are asked for, but there are {n} samples")
        sample_id, center = state.row_at(draw[0].raw() % n)
        ids, centers = [sample_id], [center]
        state.add(center)
        totals = state.totals()
        for _ in range(1, k):
            candidates = state.pick(totals, [s.uniform() * totals.sum() for s in draw])
            outcome = state.totals_with(np.array([x for _, x in candidates]))
            best = int(np.argmin(outcome.sum(axis=0)))
            totals = outcome[:, best]
            ids.append(candidates[best][0])
            centers.append(candidates[best][1])
            state.add(candidates[best][1])
        return np.array(centers), ids
    finally:
        state.close()
