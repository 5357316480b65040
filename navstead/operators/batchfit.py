"""Many elastic-net logistic fits in shared passes over one table.

Folds, purged months, settings and bootstrap replicates differ only in how often they count each
month.  A fit is therefore a target, a setting and a weight per month; all fits share each scan:

* counts and sums per (month, feature) are taken once, and every fit adds up its months, which leaves
  purged months out without reading them again;
* weighted medians of all fits are found digit by digit: a scan counts values by their leading binary
  digits, and only those that agree with a median so far are counted by more of them;
* a pass reads the rows once, and each task adds up loss and gradient of all fits as matrix products;
* curvature costs features^2 a row and fit.  At zero coefficients it is the same for all fits up to
  weights per month and class, so one scan serves them all; later passes learn it from the gradients
  (BFGS), and fits that are still open after some passes take their exact one.

What reaches the driver is bounded by fits x features^2, where the penalised quadratics are solved by
coordinate descent, all fits at a time.  The optimality condition is always that of the whole loss.

Preprocessing belongs to the fit (median for a missing value, then mean and deviation over its own
months), but rows are never rewritten for it: a standardised value is linear in the raw value and in
whether it is missing, so coefficients are moved to the raw scale before each pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..functions.numeric import finite
from ..session import cut_lineage

TOLERANCE = 1e-7  # of the optimality condition, per unit of weight
MOST_PASSES = 40
EXACT_EVERY = 10  # passes after which open fits take their exact curvature
LEADING, MORE = 17, 10  # binary digits of a value in the first count (sign, exponent and five more), and in each later one
PIECE = 1024  # rows of a matrix product, so that its intermediate results stay in the cache
FEW = 1_000_000  # values that are counted as they are


@dataclass
class Fit:
    """What to fit: months are ISO dates of month-ends with the number of times that each counts."""

    name: str
    target: str
    months: dict[str, int]
    C: float
    l1_ratio: float


@dataclass
class Fitted:
    fit: Fit
    n: int
    positives: int
    medians: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    violation: float = float("inf")

    def raw(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Coefficients of the raw values, of being missing, and the constant."""
        a = self.coefficients / self.deviations
        return a, a * self.medians, self.intercept - float(a @ self.means)


def _samples(fits: Sequence[Fit]) -> tuple[list[int], list[Fit]]:
    """Per fit the place of its rows among the distinct ones: settings of one target and the same months share their medians."""
    first: dict[tuple, int] = {}
    place = [first.setdefault((f.target, tuple(sorted((m, w) for m, w in f.months.items() if w))), len(first)) for f in fits]
    return place, [fits[place.index(k)] for k in range(len(first))]


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; both zeros are one."""
    bits = (values + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)


def _value_of(code: int) -> float:
    bits = code ^ (1 << 63) if code >> 63 else ~code & 0xFFFFFFFFFFFFFFFF
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _medians(table: DataFrame, features: Sequence[str], strata: Sequence[tuple[str, int]], weights: np.ndarray) -> np.ndarray:
    """Median of every (feature, sample), 0 without values; ``weights`` says how often a row of a stratum (month, known targets) counts in a sample.

    Each scan counts the values by more leading digits, only where a median lies.  A group of one count holds at
    most 2^MORE different digits per stratum, or FEW values in all, whatever the number of rows.
    """
    place = {s: i for i, s in enumerate(strata)}
    n_samples, width = weights.shape[1], len(features)
    spots: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}  # (feature, leading digits so far) -> what is asked for there: its number and rank
    found: dict[tuple[int, int], float] = {}
    done, goal = 0, LEADING
    while done < 64:
        parents: dict[int, np.ndarray] = {}
        for i, prefix in spots:
            parents.setdefault(i, []).append(prefix)
        parents = {i: np.array(sorted(p), np.uint64) for i, p in parents.items()}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in _bundles(batches):
                months, masks = group.column(0).combine_chunks().dictionary_encode(), group.column(1).to_numpy()
                row_month, names = months.indices.to_numpy(), months.dictionary.to_pylist()
                kinds, kind = np.unique(row_month.astype(np.int64) << 40 | masks, return_inverse=True)
                stratum = np.array([place.get((names[k >> 40], int(k & ((1 << 40) - 1))), -1) for k in kinds], np.int64)[kind]
                for i in range(width):
                    if done and i not in parents:
                        continue
                    v = group.column(2 + i).to_numpy()
                    used = ~np.isnan(v) & (stratum >= 0)
                    code, at = _ordered(v[used]), stratum[used]
                    if done:
                        prefix = code >> np.uint64(64 - done)
                        spot = np.minimum(np.searchsorted(parents[i], prefix), len(parents[i]) - 1)
                        hit = parents[i][spot] == prefix
                        code, at = code[hit], at[hit]
                    child = code >> np.uint64(64 - goal)
                    if goal + len(strata).bit_length() <= 64:  # one number sorts faster than two
                        key = np.sort(child * np.uint64(len(strata)) + at.astype(np.uint64))
                        child, at = key // np.uint64(len(strata)), (key % np.uint64(len(strata))).astype(np.int64)
                    else:
                        order = np.lexsort((at, child))
                        child, at = child[order], at[order]
                    first = np.flatnonzero(np.append(True, (child[1:] != child[:-1]) | (at[1:] != at[:-1]))) if len(child) else np.zeros(0, int)
                    head = child[first] >> np.uint64(goal - done) if done else np.zeros(len(first), np.uint64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(first), i, np.int32)), pa.array(head.view(np.int64)), pa.array(child[first].view(np.int64)), pa.array(at[first].astype(np.int32)),
                        pa.array(np.diff(np.append(first, len(child))))], names=["feature", "parent", "child", "stratum", "cnt"])

        def choose(group: pa.Table) -> pa.Table:
            i, parent = group.column("feature")[0].as_py(), group.column("parent")[0].as_py() & 0xFFFFFFFFFFFFFFFF
            children, at = np.unique(group.column("child").to_numpy().view(np.uint64), return_inverse=True)
            stratum, cnt = group.column("stratum").to_numpy(), group.column("cnt").to_numpy()
            asked = spots.get((i, parent), {}) if done else {}
            total = np.bincount(at, cnt, len(children))
            out = []
            for j in range(n_samples) if not done else sorted({q // 2 for q in asked}):
                below = np.cumsum(np.bincount(at, cnt * weights[stratum, j], len(children)))
                all_of = int(below[-1])
                for side in (0, 1):
                    rank = (all_of - 1 + side) // 2 if not done else asked.get(2 * j + side)
                    if rank is None or not all_of:
                        continue
                    k = int(np.searchsorted(below, rank, side="right"))
                    out.append((i, 2 * j + side, int(children[k : k + 1].view(np.int64)[0]), rank - int(below[k - 1] if k else 0), int(total[k])))
            columns = list(zip(*out)) if out else [[]] * 5
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["feature", "asked", "child", "rank", "held"])

        counts = table.select("month", "known", *features).mapInArrow(count, "feature int, parent bigint, child bigint, stratum int, cnt bigint")
        summed = counts.groupBy("feature", "parent", "child", "stratum").agg(F.sum("cnt").alias("cnt"))
        got = summed.groupBy("feature", "parent").applyInArrow(choose, "feature int, asked int, child bigint, rank bigint, held bigint").collect()  # features x samples x 2
        spots, held = {}, {}
        for r in got:
            prefix = r["child"] & 0xFFFFFFFFFFFFFFFF
            spots.setdefault((r["feature"], prefix), {})[r["asked"]] = r["rank"]
            held[r["feature"], prefix] = r["held"]
            if goal == 64:
                found[r["feature"], r["asked"]] = _value_of(prefix)
        if not got:
            break
        done, goal = goal, 64 if sum(held.values()) <= FEW else min(goal + MORE, 64)
    return np.array([[(found[i, 2 * j] + found[i, 2 * j + 1]) / 2 if (i, 2 * j) in found else 0.0 for j in range(n_samples)] for i in range(width)]).reshape(width, n_samples)


def _bundles(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """Batches put together, so that equal digits are counted before they are sent."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _statistics(table: DataFrame, features: Sequence[str], targets: Sequence[str], fits: Sequence[Fit]) -> list[Fitted]:
    """Counts, medians, means and deviations of every fit: one scan for the sums, a few for the medians."""
    sums = table.groupBy("month", "known").agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f"_y{i}"), F.lit(0.0)).alias(f"p_{i}") for i in range(len(targets))],
        *[e for i, f in enumerate(features) for e in (F.count(f).cast("double").alias(f"h_{i}"), F.sum(f).alias(f"s_{i}"), F.sum(F.col(f) * F.col(f)).alias(f"q_{i}"))]).collect()  # months x known targets
    strata = [(r["month"], r["known"]) for r in sums]
    table_of = np.array([[[r[f"{c}_{i}"] or 0.0 for c in "hsq"] for i in range(len(features))] for r in sums]).reshape(len(sums), len(features), 3)

    def weights_of(fit: Fit) -> np.ndarray:
        bit = targets.index(fit.target)
        return np.array([float(fit.months.get(m, 0) * (known >> bit & 1)) for m, known in strata])

    place_of, samples = _samples(fits)
    medians = _medians(table, features, strata, np.array([weights_of(f) for f in samples]).T.reshape(len(strata), len(samples)))
    out = []
    for j, f in enumerate(fits):
        i, w = targets.index(f.target), weights_of(f)
        n, positives = (int(round(sum(a * r[c] for a, r in zip(w, sums)))) for c in ("n", f"p_{i}"))
        have, s, ss = np.einsum("m,mfc->cf", w, table_of)
        median = medians[:, place_of[j]]
        s, ss = s + (n - have) * median, ss + (n - have) * median**2
        mean = s / max(n, 1)
        deviation = np.sqrt(np.maximum(ss - n * mean**2, 0) / max(n - 1, 1))
        out.append(Fitted(f, n, positives, median, mean, np.where(deviation > 1e-9, deviation, 1.0), np.zeros(len(features))))
    return out


def _blocks(batch: pa.RecordBatch, width: int, row_of: dict[str, int], n_targets: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """((values, their being missing, one), labels per target with -1 for none, month of each row with the last place for others) of a batch."""
    months = batch.column(0).dictionary_encode()
    at = np.array([row_of.get(m, len(row_of)) for m in months.dictionary.to_pylist()], int)[months.indices.to_numpy()]
    wide = np.ones((batch.num_rows, 2 * width + 1))
    for i in range(width):
        wide[:, i] = batch.column(1 + i).to_numpy(zero_copy_only=False)
    gone = np.isnan(wide[:, :width])
    wide[:, width:2 * width] = gone
    wide[:, :width][gone] = 0.0
    labels = [np.nan_to_num(batch.column(1 + width + i).to_numpy(zero_copy_only=False).astype(float), nan=-1.0) for i in range(n_targets)]
    return wide, labels, at


def _shares(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 / (1 + exp(-z)) and log(1 + exp(z)), without overflow."""
    small = np.exp(-np.abs(z))
    share = 1 / (1 + small)
    return np.where(z >= 0, share, small * share), np.log1p(small) + np.maximum(z, 0)


def _added(table: DataFrame, run, key: str) -> dict[int, np.ndarray]:
    """The sums of every key over all tasks of ``run``."""

    def added(group: pa.Table) -> pa.Table:
        sums = np.sum(np.stack([s.values.to_numpy() for s in group.column("sums")]), axis=0)
        return pa.table([pa.array([group.column(key)[0].as_py()], pa.int32()), pa.array([sums], pa.list_(pa.float64()))], names=[key, "sums"])

    shape = f"{key} int, sums array<double>"
    return {r[key]: np.array(r["sums"]) for r in table.mapInArrow(run, shape).groupBy(key).applyInArrow(added, shape).collect()}


def _balance(s: Fitted) -> list[float]:
    return [s.n / (2.0 * max(s.n - s.positives, 1)), s.n / (2.0 * max(s.positives, 1))]


def _raw_table(state: Sequence[Fitted]) -> np.ndarray:
    """Raw coefficients, a column per fit."""
    return np.array([np.concatenate([a, b, [c]]) for a, b, c in (s.raw() for s in state)]).T


def _columns(table: DataFrame, features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    return table.select("month", *features, *[f"_y{i}" for i in range(len(targets))])


def _pass(table: DataFrame, features: Sequence[str], state: Sequence[Fitted], months: Sequence[str], weights: np.ndarray, targets: Sequence[str]) -> dict[int, np.ndarray]:
    """Per fit: loss and gradient in (values, missing, one), summed over all rows in one scan."""
    width, row_of, moved = len(features), {m: i for i, m in enumerate(months)}, _raw_table(state)
    which = np.array([targets.index(s.fit.target) for s in state])
    balance, counts = np.array([_balance(s) for s in state]), np.vstack([weights, np.zeros((1, len(state)))])
    owners = [(t, np.flatnonzero(which == t)) for t in np.unique(which)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(state), 2 * width + 2))
        for batch in batches:
            wide, labels, at = _blocks(batch, width, row_of, len(targets))
            for t, own in owners:
                used = np.flatnonzero(labels[t] >= 0)
                for start in range(0, len(used), PIECE):
                    rows = used[start : start + PIECE]
                    x, y = wide[rows], labels[t][rows][:, None]
                    z = x @ moved[:, own]
                    p, grown = _shares(z)
                    w = counts[:, own][at[rows]] * np.where(y > 0, balance[own, 1], balance[own, 0])
                    grown -= y * z
                    total[own, 0] += np.einsum("rf,rf->f", w, grown)
                    p -= y
                    p *= w
                    total[own, 1:] += p.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(len(state)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["fit", "sums"])

    return _added(_columns(table, features, targets), run, "fit")


def _curvature(table: DataFrame, features: Sequence[str], months: Sequence[str], targets: Sequence[str], parts: Sequence[tuple[int, np.ndarray, np.ndarray, Sequence[float]]]) -> dict[int, np.ndarray]:
    """Curvature in (values, missing, one) of every part, in one scan; a part is a target, raw coefficients, weights per month and weights of the two classes."""
    width, row_of = len(features), {m: i for i, m in enumerate(months)}
    size = 2 * width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(parts), size, size))
        for batch in batches:
            wide, labels, at = _blocks(batch, width, row_of, len(targets))
            for j, (t, point, weights, classes) in enumerate(parts):
                y = labels[t]
                w = np.append(weights, 0.0)[at] * np.where(y > 0, classes[1], np.where(y == 0, classes[0], 0.0))
                used = np.flatnonzero(w)
                if len(used):
                    x = wide[used]
                    p = _shares(x @ point)[0] if point.any() else 0.5
                    total[j] += (x * (w[used] * p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(list(total.reshape(len(parts), -1)), pa.list_(pa.float64()))], names=["part", "sums"])

    return {j: s.reshape(size, size) for j, s in _added(_columns(table, features, targets), run, "part").items()}


def _first_curvature(table: DataFrame, features: Sequence[str], state: Sequence[Fitted], months: Sequence[str], weights: np.ndarray, targets: Sequence[str]) -> list[np.ndarray]:
    """Curvature of every fit at zero coefficients: added up from one matrix per target, class, and months that all fits count alike."""
    zero, which, parts, used = np.zeros(2 * len(features) + 1), [targets.index(s.fit.target) for s in state], [], []
    for t in sorted(set(which)):
        own = [j for j, w in enumerate(which) if w == t]
        kinds, kind = np.unique(weights[:, own], axis=0, return_inverse=True)
        for k in range(len(kinds)):
            if kinds[k].any():
                for c in (0, 1):
                    parts.append((t, zero, (kind.ravel() == k).astype(float), [1.0 - c, float(c)]))
                    used.append({j: kinds[k][i] * _balance(state[j])[c] for i, j in enumerate(own)})
    got = _curvature(table, features, months, targets, parts)
    return [sum(u.get(j, 0.0) * got[i] for i, u in enumerate(used) if j in u) for j in range(len(state))]


def _move(s: Fitted) -> np.ndarray:
    """From (values, missing, one) to the fit's own standardised features and the intercept: z = (x + median * missing - mean) / deviation."""
    k = len(s.coefficients)
    move, at = np.zeros((k + 1, 2 * k + 1)), np.arange(k)
    move[at, at], move[at, k + at], move[at, 2 * k], move[k, 2 * k] = 1 / s.deviations, s.medians / s.deviations, -s.means / s.deviations, 1
    return move


def _violation(gradient: np.ndarray, beta: np.ndarray, ridge: float, lasso: float) -> float:
    """Distance of zero from the subgradient."""
    slope = gradient[:-1] + ridge * beta
    free = np.where(beta != 0, np.abs(slope + lasso * np.sign(beta)), np.maximum(np.abs(slope) - lasso, 0))
    return float(max(free.max(initial=0.0), abs(gradient[-1])))


def _toward(slope: np.ndarray, curve: np.ndarray, start: np.ndarray, now: np.ndarray, ridge: float, lasso: float) -> tuple[np.ndarray, bool]:
    """A point no worse than ``now``, the least of its zeros and signs, and whether it is the minimum of all; a sign that would turn becomes a zero on the way."""
    last, now = len(now) - 1, now.copy()
    while True:
        used = np.flatnonzero((now != 0) | (np.arange(len(now)) == last))
        free, signs = used == last, np.sign(now[used])
        bent = curve[np.ix_(used, used)] + np.diag(np.where(free, 0.0, ridge))
        try:
            at = np.linalg.solve(bent, (curve @ start - slope)[used] - np.where(free, 0.0, lasso * signs))
        except np.linalg.LinAlgError:
            return now, False
        if not np.isfinite(at).all():
            return now, False
        crossed = ~free & (at * signs <= 0)
        if not crossed.any():
            break
        reach = np.where(crossed, now[used] / np.where(crossed, now[used] - at, 1.0), 1.0)
        now[used] = np.where(crossed & (reach <= reach.min()), 0.0, now[used] + reach.min() * (at - now[used]))
    now[used] = at
    pull = np.abs(slope + curve @ (now - start))
    pull[used] = 0.0
    return now, bool((pull <= lasso * (1 + 1e-12)).all())


def _descend(slopes: np.ndarray, curves: np.ndarray, starts: np.ndarray, ridge: np.ndarray, lasso: np.ndarray) -> np.ndarray:
    """Minima of penalised quadratics around their starts (a row per fit, the intercept last).

    One coordinate at a time in all of them; every few rounds each takes the linear system of its zeros and signs.
    """
    out, left = starts.copy(), np.arange(len(starts))
    new, slope, curve, r, s = starts.copy(), slopes.copy(), curves, ridge, lasso
    for turn in range(2000):
        most = np.zeros(len(new))
        for i in range(new.shape[1]):
            h = curve[:, i, i] + 1e-12
            pull = h * new[:, i] - slope[:, i]
            to = pull / h if i == new.shape[1] - 1 else np.sign(pull) * np.maximum(np.abs(pull) - s, 0.0) / (h + r)
            step = to - new[:, i]
            slope += curve[:, :, i] * step[:, None]
            new[:, i] = to
            np.maximum(most, np.abs(step), out=most)
        go = most >= 1e-12
        if turn % 4 == 3:
            for k in np.flatnonzero(go):
                j = left[k]
                new[k], done = _toward(slopes[j], curves[j], starts[j], new[k], ridge[j], lasso[j])
                slope[k], go[k] = slopes[j] + curves[j] @ (new[k] - starts[j]), not done
        out[left] = new
        if not go.any():
            break
        if not go.all():
            left, new, slope, curve, r, s = left[go], new[go], slope[go], curve[go], r[go], s[go]
    return out


def _learned(curve: np.ndarray, step: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Curvature that maps the last step to the change of the gradient (BFGS); it stays positive."""
    along, bent = float(step @ change), curve @ step
    size = float(step @ bent)
    if not along > 1e-10 * np.linalg.norm(step) * np.linalg.norm(change) or not size > 0:
        return curve
    return curve - np.outer(bent, bent) / size + np.outer(change, change) / along


def fit_all(rows: DataFrame, features: Sequence[str], fits: Sequence[Fit]) -> list[Fitted]:
    """Fit everything together.  A fit without rows of both classes keeps zero coefficients and an infinite violation."""
    targets = sorted({f.target for f in fits})
    known = sum((F.col(t).isNotNull().cast("bigint") * F.lit(1 << i) for i, t in enumerate(targets)), F.lit(0).cast("bigint"))
    table = cut_lineage(rows.select(F.col("anchor").cast("string").alias("month"), known.alias("known"), *[finite(f).cast("double").alias(f) for f in features],
                                    *[F.col(t).cast("boolean").cast("double").alias(f"_y{i}") for i, t in enumerate(targets)]))
    state = _statistics(table, features, targets, fits)
    months = sorted({m for f in fits for m in f.months})
    open_fits = [s for s in state if 0 < s.positives < s.n]

    def weights_of(some: Sequence[Fitted]) -> np.ndarray:
        return np.array([[float(s.fit.months.get(m, 0)) for s in some] for m in months])

    moves = {id(s): _move(s) for s in open_fits}
    curves: dict[int, np.ndarray] = {}
    if open_fits:
        for s, c in zip(open_fits, _first_curvature(table, features, open_fits, months, weights_of(open_fits), targets)):
            curves[id(s)] = moves[id(s)] @ c @ moves[id(s)].T
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # penalised loss, where, gradient
    for turn in range(MOST_PASSES):
        if not open_fits:
            break
        weights = weights_of(open_fits)
        if turn and turn % EXACT_EVERY == 0:
            points = _raw_table(open_fits)
            exact = _curvature(table, features, months, targets, [(targets.index(s.fit.target), points[:, j], weights[:, j], _balance(s)) for j, s in enumerate(open_fits)])
            for j, s in enumerate(open_fits):
                curves[id(s)] = moves[id(s)] @ exact[j] @ moves[id(s)].T
        sums = _pass(table, features, open_fits, months, weights, targets)
        left, solve = [], []
        for j, s in enumerate(open_fits):
            ridge, lasso = (1 - s.fit.l1_ratio) / s.fit.C, s.fit.l1_ratio / s.fit.C  # of the summed loss
            loss, gradient = sums[j][0], moves[id(s)] @ sums[j][1:]
            total = loss + lasso * np.abs(s.coefficients).sum() + ridge / 2 * float(s.coefficients @ s.coefficients)
            s.violation = _violation(gradient, s.coefficients, ridge, lasso) / s.n
            if s.violation <= TOLERANCE:
                continue
            left.append(s)
            before, here = best.get(id(s)), np.append(s.coefficients, s.intercept)
            if before is not None and turn % EXACT_EVERY:
                curves[id(s)] = _learned(curves[id(s)], here - before[1], gradient - before[2])
            if before is not None and total > before[0] * (1 + 1e-12):  # too far: half the way back
                half = (here + before[1]) / 2
                s.coefficients, s.intercept = half[:-1], float(half[-1])
            else:
                best[id(s)] = (total, here, gradient)
                solve.append((s, gradient, here, ridge, lasso))
        if solve:
            some, slopes, starts, ridges, lassos = zip(*solve)
            found = _descend(np.array(slopes), np.array([curves[id(s)] for s in some]), np.array(starts), np.array(ridges), np.array(lassos))
            for s, at in zip(some, found):
                s.coefficients, s.intercept = at[:-1], float(at[-1])
        open_fits = left
    return state


def scores(rows: DataFrame, features: Sequence[str], fitted: Sequence[Fitted], asked: Sequence[dict[str, int]], keep: Sequence[str]) -> DataFrame:
    """(keep, fit, p) of every row under each fit that asks for its month, in one scan: a matrix product, whatever the number of fits."""
    usable = [j for j, s in enumerate(fitted) if np.isfinite(s.violation)]
    months = sorted({m for j in usable for m in asked[j]})
    wanted = np.array([[m in asked[j] for j in usable] for m in [*months, ""]]).reshape(len(months) + 1, len(usable))
    table, names = _raw_table([fitted[j] for j in usable]) if usable else np.zeros((2 * len(features) + 1, 0)), pa.array([fitted[j].fit.name for j in usable], pa.string())
    row_of, first = {m: i for i, m in enumerate(months)}, len(features) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, _, at = _blocks(batch, len(features), row_of, 0)
            row, fit = np.nonzero(wanted[at])
            p = _shares(wide @ table)[0][row, fit]
            kept = [batch.column(first + i).take(pa.array(row)) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, names.take(pa.array(fit)), pa.array(p)], names=[*keep, "fit", "p"])

    source = rows.select(F.col("anchor").cast("string").alias("_month"), *[finite(f).alias(f"_x{i}") for i, f in enumerate(features)], *keep)
    shape = StructType([*[rows.schema[c] for c in keep], StructField("fit", StringType()), StructField("p", DoubleType())])
    return source.mapInArrow(run, shape)
