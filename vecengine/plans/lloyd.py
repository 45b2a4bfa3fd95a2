"""Lloyd iterations: one job each, which gives back K x (d + 1) sums and the number of changed labels.

Labels are a function of samples and centres, so a pass evaluates the centres of
this iteration and of the one before in the same batches and counts where the
labels differ; no labels are kept between iterations.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.assign import block_labels, block_squares
from ..operators.blocks import dense, map_sum, numbers

log = logging.getLogger(__name__)


@dataclass
class Fitted:
    centers: np.ndarray
    inertia: float
    n_iter: int
    reason: str
    used: int
    history: list[dict] = field(default_factory=list)


def column_sums(samples: DataFrame, d: int) -> np.ndarray:
    def partial(batches):
        return sum((dense(b).sum(axis=0) for b in batches), np.zeros(d))

    return map_sum(samples.select("features"), partial, d)


def squares_sum(samples: DataFrame, shift: np.ndarray) -> float:
    def partial(batches):
        return np.array([sum(float(((dense(b) - shift) ** 2).sum()) for b in batches)])

    return float(map_sum(samples.select("features"), partial, 1)[0])


def one_pass(samples: DataFrame, centers: np.ndarray, before: np.ndarray | None, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sizes, weighted sums and the number of labels that differ from those of ``before``."""
    k, d = centers.shape

    def partial(batches):
        out = np.zeros((k, d + 1))
        changed = 0
        for batch in batches:
            x, w = dense(batch) - shift, numbers(batch, "weight")
            own = block_labels(x, centers)
            if before is not None:
                changed += int((own != block_labels(x, before)).sum())
            hot = np.zeros((k, len(x)))
            hot[own, np.arange(len(x))] = w
            out[:, :d] += hot @ x
            out[:, d] += hot.sum(axis=1)
        return np.append(out.ravel(), changed)

    total = map_sum(samples.select("features", "weight"), partial, k * (d + 1) + 1)
    table = total[:-1].reshape(k, d + 1)
    return table[:, d].copy(), table[:, :d].copy(), int(total[-1])


def farthest_samples(samples: DataFrame, labels_from: np.ndarray, means: np.ndarray, m: int, shift: np.ndarray) -> list:
    """The m samples farthest (unweighted) from the new mean of their label, ties to the lower id; m rows leave each partition."""

    def run(batches):
        best: list[tuple] = []
        for batch in batches:
            x = dense(batch) - shift
            own = block_labels(x, labels_from)
            d2 = block_squares(x, means, own)
            ids, w = numbers(batch, "id"), numbers(batch, "weight")
            for i in np.lexsort((ids, -d2))[:m]:
                best.append((-float(d2[i]), int(ids[i]), int(own[i]), float(w[i]), x[i].tolist()))
            best = sorted(best, key=lambda r: r[:2])[:m]
        d2, ids, own, w, x = zip(*best, strict=True) if best else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(d2, pa.float64()), pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array(w, pa.float64()), pa.array(x, pa.list_(pa.float64()))],
            ["order", "id", "label", "weight", "x"],
        )

    return samples.mapInArrow(run, "order double, id long, label int, weight double, x array<double>").orderBy("order", "id").limit(m).collect()


def relocate(samples: DataFrame, centers: np.ndarray, sizes: np.ndarray, sums: np.ndarray, shift: np.ndarray) -> None:
    """Gives each empty cluster, by rising id, one of the farthest samples, and takes that from its old cluster."""
    empty = np.flatnonzero(sizes == 0)
    if not len(empty):
        return
    means = means_of(sizes, sums, centers)
    for cluster, row in zip(empty, farthest_samples(samples, centers, means, len(empty), shift), strict=False):
        w, x = row["weight"], np.array(row["x"])
        sums[row["label"]] -= w * x
        sizes[row["label"]] -= w
        sums[cluster] = w * x
        sizes[cluster] = w


def means_of(sizes: np.ndarray, sums: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Sums over sizes; a cluster without weight keeps its centre."""
    kept = sizes == 0
    return np.where(kept[:, None], old, sums / np.where(kept, 1, sizes)[:, None])


def total_inertia(samples: DataFrame, centers: np.ndarray, shift: np.ndarray) -> tuple[float, int]:
    """The weighted sum of squared distances to the nearest centres, and how many of these any sample has."""

    def partial(batches):
        total = np.zeros(len(centers) + 1)
        for batch in batches:
            x = dense(batch) - shift
            own = block_labels(x, centers)
            total[0] += float((numbers(batch, "weight") * block_squares(x, centers, own)).sum())
            total[1:] += np.bincount(own, minlength=len(centers))
        return total

    found = map_sum(samples.select("features", "weight"), partial, len(centers) + 1)
    return float(found[0]), int((found[1:] > 0).sum())


def lloyd(samples: DataFrame, start: np.ndarray, max_iter: int = 300, tol: float = 0.0, shift: np.ndarray | None = None, verbose: bool = False) -> Fitted:
    """Iterates from ``start`` until labels repeat, the squared shift is within ``tol`` (already scaled), or ``max_iter``.

    ``shift`` is subtracted from every sample; centres are in shifted coordinates.
    """
    centers = np.array(start, np.float64)
    shift = np.zeros(centers.shape[1]) if shift is None else shift
    before: np.ndarray | None = None
    moved, n_iter, reason, history = np.inf, 0, "max_iter", []
    while n_iter < max_iter and moved > tol:
        sizes, sums, changed = one_pass(samples, centers, before, shift)
        relocate(samples, centers, sizes, sums, shift)
        new = means_of(sizes, sums, centers)
        n_iter += 1
        step = {"iteration": n_iter, "changed": changed if before is not None else None}
        if verbose:
            step["inertia"], _ = total_inertia(samples, centers, shift)
            log.info("iteration %d, inertia %s", n_iter, step["inertia"])
        strict = before is not None and changed == 0
        if not strict:
            moved = float(((new - centers) ** 2).sum())
            step["shift"] = moved
        before, centers = centers, new
        history.append(step)
        if strict:
            reason = "labels repeat"
            break
    else:
        if moved <= tol:
            reason = "shift within tolerance"
    if verbose:
        log.info("stopped after iteration %d: %s", n_iter, reason)
    inertia, used = total_inertia(samples, centers, shift)
    return Fitted(centers, inertia, n_iter, reason, used, history)
