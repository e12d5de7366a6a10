"""Change points of a series of window vectors, one series per group: penalised (PELT) or with a given number of breaks.

Cost of a segment [s, e): (e - s) - sum of K over its square / (e - s), with a Gaussian kernel K whose width comes from the median
squared distance. Sums over squares grow by a row of the kernel at a time, so no more than a few rows of it are ever held: memory
follows the number of windows, not its square, and the results are those of the whole matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Squared distances held at once, and bits of a number that a pass over them settles.
CHUNK, BITS = 1 << 20, 16


def standardize(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)


def squares(x: np.ndarray) -> Iterator[np.ndarray]:
    """Squared distances of all pairs, some rows at a time."""
    step = max(1, CHUNK // max(1, len(x)))
    for a in range(0, len(x) - 1, step):
        z = min(a + step, len(x) - 1)
        d = sum((x[a:z, k, None] - x[None, a + 1 :, k]) ** 2 for k in range(x.shape[1]))
        yield np.ascontiguousarray(d[np.arange(a, z)[:, None] < np.arange(a + 1, len(x))])


def median_square(x: np.ndarray) -> float:
    """The median of all squared distances. Numbers that are not negative are ordered as their bits are: each pass over the pairs
    counts the next BITS of those that begin as the middle ones do, so four passes settle them and none is sorted."""
    n = len(x) * (len(x) - 1) // 2
    if not n:
        return 0.0
    if n <= CHUNK:  # all of them may be held
        return float(np.median(np.concatenate(list(squares(x)))))
    middle = {rank: (0, rank) for rank in ((n - 1) // 2, n // 2)}  # rank -> bits known so far, rank among those that begin with them
    for shift in range(64 - BITS, -1, -BITS):
        counts = {known: np.zeros(1 << BITS, np.int64) for known, _ in middle.values()}
        for d in squares(x):
            bits = d.view(np.uint64)
            for known, c in counts.items():
                own = bits if shift + BITS == 64 else bits[bits >> np.uint64(shift + BITS) == np.uint64(known)]
                c += np.bincount((own >> np.uint64(shift)) & np.uint64((1 << BITS) - 1), minlength=1 << BITS)
        for rank, (known, left) in middle.items():
            upto = np.cumsum(counts[known])
            k = int(np.searchsorted(upto, left, side="right"))
            middle[rank] = (known << BITS | k, left - int(upto[k - 1] if k else 0))
    return float(np.mean([np.array(known, np.uint64).view(np.float64) for known, _ in middle.values()]))


def kernel_sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums of the whole kernel matrix: the plain form, for short series, that the tests hold the rest against."""
    squared = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    above = squared[np.triu_indices(len(x), 1)]
    k = np.exp(-np.clip(squared / ((np.median(above) if len(above) else 0.0) or 1.0), 1e-2, 1e2))
    np.fill_diagonal(k, 1.0)
    out = np.zeros((len(x) + 1, len(x) + 1))
    out[1:, 1:] = k.cumsum(axis=0).cumsum(axis=1)
    return out


def cost(sums: np.ndarray, s: int, e: int) -> float:
    """A segment's cost from the plain form."""
    return (e - s) - (sums[e, e] - sums[s, e] - sums[e, s] + sums[s, s]) / (e - s)


class Kernel:
    """Rows of the Gaussian kernel of some vectors; exponents are clipped to [0.01, 100] off the diagonal, which is 1."""

    def __init__(self, x: np.ndarray):
        self.x, self.width = x, median_square(x) or 1.0

    def __len__(self) -> int:
        return len(self.x)

    def row(self, i: int, a: int, z: int) -> np.ndarray:
        """K of window i and those from a to before z; i is not among them."""
        return np.exp(-np.clip(((self.x[a:z] - self.x[i]) ** 2).sum(axis=1) / self.width, 1e-2, 1e2))


def penalised(x: np.ndarray, penalty: float, min_size: int) -> list[int]:
    """Ends of the segments that make cost plus penalty per break least. Starts that can no longer win are pruned, and rows of
    the kernel reach back to the first start that is left alone."""
    n = len(x)
    if n < 2 * min_size:
        return [n]
    kernel, sums = Kernel(x), np.ones(n)
    best, last, starts = {0: -penalty}, {}, [0]
    for e in range(1, n + 1):
        low = starts[0]
        # sums[s]: the sum over the square of [s, e), for starts from `low` on.
        sums[low : e - 1] += 1 + 2 * np.cumsum(kernel.row(e - 1, low, e - 1)[::-1])[::-1]
        if e < min_size or (e < n and n - e < min_size):
            continue
        tried = [(best[s] + (e - s) - sums[s] / (e - s) + penalty, s) for s in starts if e - s >= min_size]
        if not tried:
            continue
        best[e], last[e] = min(tried)
        waiting = [s for s in starts if e - s < min_size]
        starts = [s for value, s in tried if value - penalty <= best[e]] + waiting + [e]
    out, e = [], n
    while e:
        out.append(e)
        e = last[e]
    return out[::-1]


def best_split(kernel: Kernel, s: int, e: int, min_size: int) -> tuple[float, int]:
    """The split of [s, e) that lowers the cost most, and by how much; (0, -1) if none does."""
    before, after = np.zeros(e - s), np.zeros(e - s)
    for i in range(s, e):
        row = kernel.row(i, s, i)
        before[i - s] = row.sum()
        after[: i - s] += row
    size = np.arange(1, e - s)
    left, right = np.cumsum(1 + 2 * before), np.cumsum((1 + 2 * after)[::-1])[::-1]
    cost = lambda total, n: n - total / n
    gain = cost(left[-1], e - s) - cost(left[:-1], size) - cost(right[1:], e - s - size)
    gain[(size < min_size) | (e - s - size < min_size)] = -1
    found, at = 0.0, -1
    for k in np.flatnonzero(gain > 1e-12).tolist():
        if gain[k] > found + 1e-12:
            found, at = float(gain[k]), s + k + 1
    return found, at


def with_breaks(x: np.ndarray, breaks: int, min_size: int) -> list[int]:
    """Binary segmentation: the split that lowers the cost most, again and again, as long as segments are long enough."""
    kernel, ends = Kernel(x), [len(x)]
    held: dict[tuple[int, int], tuple[float, int]] = {}
    for _ in range(breaks):
        best = (0.0, -1)
        for s, e in zip([0, *ends], ends, strict=False):
            if (s, e) not in held:
                held[s, e] = best_split(kernel, s, e, min_size)
            if held[s, e][0] > best[0] + 1e-12:
                best = held[s, e]
        if best[1] < 0:
            break
        ends = sorted([*ends, best[1]])
    return ends


def change_points(windows: DataFrame, key: str, idx: str, t: str, features: list[str], penalty: float = 10.0, min_size: int = 5, breaks: int = 0) -> DataFrame:
    """(key, boundary_idx, boundary_t): the window that ends each segment but the last, and its time.

    A group is one series' windows, and a task's memory follows their number. The search goes from the first window to the last, so a
    series is one task's work; windows are far fewer than samples, and close starts are pruned.
    """
    kind = dict(windows.dtypes)[key]

    def find(series: pa.Table) -> pa.Table:
        order = np.argsort(series.column(idx).to_numpy(), kind="stable")
        columns = np.stack([series.column(f).to_numpy().astype(float) for f in features], axis=1)
        x = np.nan_to_num(standardize(columns[order]))  # a feature without a mean tells nothing apart
        size = max(2, min_size)
        ends = with_breaks(x, breaks, size) if breaks else penalised(x, penalty, size)
        inner = np.array([e for e in ends if 0 < e <= len(x) - 1], np.int64)
        at = order[inner - 1]
        return pa.Table.from_arrays([series.column(key).take(pa.array(at)), pa.array(inner), pa.array(series.column(t).to_numpy().astype(float)[at])], [key, "boundary_idx", "boundary_t"])

    # Arrow tables: for short series, making data frames would be most of the work.
    return windows.select(key, idx, t, *features).groupBy(key).applyInArrow(find, f"`{key}` {kind}, boundary_idx long, boundary_t double")
