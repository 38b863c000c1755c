"""Many linear fits at once: every pass over the rows serves all folds, candidates and segments.

A fit is a candidate on the train rows of a fold. Each Newton step is one pass in which tasks add up the
gradients of all fits that have not met their optimum, then one grouping by fit and
entry; the small systems are solved on the driver. So the number of jobs does not depend on the number of fits.

A bounded sample of the rows says where the steps start, so that few are needed, and nothing else: every step is over all train
rows, up to the same optimum. All folds of a candidate start at one place, so the first pass takes a row's curvature once for
all of them; later steps keep that curvature until they no longer shrink to a tenth.
Rows are held as ``u``, values and indicators of missing ones about the sample's middle, of which every fold's own columns are
linear combinations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.splits import stratified_parts
from tessera.sources.arrow import map_arrow
from tessera.sources.scratch import written

#: Newton steps at most, and the largest change of a coefficient that counts as none.
STEPS, STILL = 60, 1e-9
#: Rows of the sample that fits start from, folds in one word of a row's membership, values that a task holds, and scores in one range.
SAMPLE, WORD, HELD, RANGE = 65_536, 62, 2_000_000, 250_000


@dataclass(frozen=True)
class Linear:
    """A candidate: L2 logistic or ridge regression on ``columns``; the intercept is not penalised.

    The penalty is 1 / (2c) times the squared coefficients against the sum of losses (of squared errors over 2 for ridge).
    Missing numbers are -1; with ``scaled`` they are the train median, beside a 0/1 column for each column that
    train lacks somewhere, and all are less their train mean over their train deviation.
    ``balanced`` weighs rows by n / (2 n_class). A candidate is a fit of its own too: called with train rows it gives a scorer.
    """

    columns: tuple[str, ...]
    c: float = 1.0
    balanced: bool = False
    scaled: bool = False
    ridge: bool = False
    label: str = "label"

    def __call__(self, train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        here = rows_of(train, None, self.label, self.columns)
        fits = fit_all(here, [(0, self)])

        def score(df: DataFrame) -> DataFrame:
            x, names = _values(self.columns), df.columns

            def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in parts:
                    p = fits.scores(0, _matrix(batch.column("_x"), len(self.columns)))
                    yield pa.RecordBatch.from_arrays([*batch.column("_row").flatten(), pa.array(p)], [*names, "probability"])

            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
            return map_arrow(df.select(F.struct("*").alias("_row"), x.alias("_x")), batches, f"{kinds}, probability double")

        return score


@dataclass
class Sample:
    """Up to about SAMPLE rows: x, y, membership of folds, and the share of the rows that they are."""

    x: np.ndarray
    y: np.ndarray
    train: np.ndarray
    valid: np.ndarray
    share: float


@dataclass
class Rows:
    """Rows written once, (id, y, x, train, valid), the folds by number, and the columns of x.

    Bit k % WORD of word k // WORD of ``train`` and ``valid`` says whether the row is of fold k.
    """

    table: DataFrame
    folds: list[tuple]
    columns: tuple[str, ...]

    @cached_property
    def sample(self) -> Sample:
        share = min(1.0, SAMPLE / max(1, self.table.count()))
        some = self.table.select("y", "x", "train", "valid")
        found = (some.sample(share, 42) if share < 1 else some).toArrow()
        words = [_members(found.column(c).combine_chunks(), len(self.folds)) for c in ("train", "valid")]
        return Sample(_matrix(found.column("x").combine_chunks(), len(self.columns)), found.column("y").to_numpy(), *words, share)


def _values(columns: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]).cast("array<double>")


def _membership(manifest: DataFrame, folds: list[tuple], id_: str) -> DataFrame:
    """(id, train, valid): the folds that each row of a manifest trains and validates."""
    kinds = {f.name: f.dataType.simpleString() for f in manifest.schema}
    numbered = manifest.sparkSession.createDataFrame([(k // WORD, 1 << k % WORD, *f) for k, f in enumerate(folds)], f"_w int, _bit long, mode {kinds['mode']}, fold {kinds['fold']}")
    each = manifest.join(F.broadcast(numbered), ["mode", "fold"])
    words = range(max(1, -(-len(folds) // WORD)))
    bits = [F.bit_or(F.when((F.col("role") == role) & (F.col("_w") == w), F.col("_bit"))).alias(f"_{name}{w}") for role, name in (("train", "train"), ("validation", "valid")) for w in words]
    found = each.groupBy(F.col("id").alias(id_)).agg(*bits)
    return found.select(id_, *[F.array(*[F.coalesce(f"_{name}{w}", F.lit(0).cast("long")) for w in words]).alias(name) for name in ("train", "valid")])


def _folds(manifest: DataFrame) -> list[tuple]:
    return [tuple(r) for r in manifest.select("mode", "fold").distinct().orderBy("mode", "fold").collect()]


def rows_of(df: DataFrame, manifest: DataFrame | None, label: str, columns: Sequence[str], id_: str = "id") -> Rows:
    """``df`` with the numbers of the folds that each row trains and validates; without a manifest all rows train fold 0."""
    base = df.select(*([F.col(id_).alias("id")] if manifest is not None else []), F.col(label).cast("double").alias("y"), _values(columns).alias("x"))
    if manifest is None:
        return Rows(written(base.select(F.lit(0).alias("id"), "y", "x", *[F.array(F.lit(i).cast("long")).alias(c) for c, i in (("train", 1), ("valid", 0))])), [(None, None)], tuple(columns))
    folds = _folds(manifest)
    return Rows(written(base.join(_membership(manifest, folds, "id").hint("merge"), "id")), folds, tuple(columns))


def nested_rows(df: DataFrame, outer: DataFrame, parts: int, seed: str, label: str, columns: Sequence[str], id_: str = "id") -> tuple[Rows, int]:
    """``df`` with its outer folds, then ``parts`` inner folds (number of the outer fold, part) of each; and the number of outer folds.

    The inner parts are those that ``stratified_folds`` deals the train rows of each outer fold, from one order of the rows for all.
    """
    folds = _folds(outer)
    m = len(folds)
    base = df.select(F.col(id_).alias("id"), F.col(label).alias("_label"), F.col(label).cast("double").alias("y"), _values(columns).alias("x"))
    held = written(base.join(_membership(outer, folds, "id").hint("merge"), "id"))
    member = {f"_s{k}": F.get("train", F.lit(k // WORD)).bitwiseAND(F.lit(1 << k % WORD)) != 0 for k in range(m)}
    dealt = stratified_parts(held, "id", "_label", parts, seed, member)
    folds += [(k, j) for k in range(m) for j in range(parts)]

    def word(w: int, role: str) -> Column:
        """Outer bits as they are; of an outer fold's inner ones that of the row's part, or for train the others. Few terms, as Java compiles small methods alone."""
        terms = [F.coalesce(F.get(role, F.lit(w)), F.lit(0).cast("long"))]
        for k in range(m):
            part, first = F.col(f"_s{k}"), m + k * parts
            if first // WORD == (first + parts - 1) // WORD == w:
                bit = F.call_function("shiftleft", F.lit(1).cast("long"), part + F.lit(first % WORD))
                terms.append(F.coalesce(F.lit((1 << parts) - 1 << first % WORD).cast("long") - bit if role == "train" else bit, F.lit(0).cast("long")))
            elif first // WORD <= w <= (first + parts - 1) // WORD:
                here = [j for j in range(parts) if (first + j) // WORD == w]
                terms += [F.when(part != j if role == "train" else part == j, F.lit(1 << (first + j) % WORD).cast("long")).otherwise(F.lit(0).cast("long")) for j in here]
        return reduce(Column.__add__, terms)

    words = {role: F.array(*[word(w, role) for w in range(-(-len(folds) // WORD))]).alias(role) for role in ("train", "valid")}
    return Rows(written(dealt.select("id", "y", "x", *words.values())), folds, tuple(columns)), m


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def _members(column: pa.Array, folds: int) -> np.ndarray:
    """Which rows are of which fold."""
    words = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    at = np.arange(folds)
    return (words[:, at // WORD] >> (at % WORD) & 1).astype(bool)


def _logistic(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-m))


@dataclass
class Fits:
    """Fits of ``pairs`` (fold, candidate) with what each fold's train rows say: fills, means, deviations, classes.

    ``places`` are the coefficients over ``u``.
    """

    pairs: list[tuple[int, Linear]]
    columns: tuple[str, ...]
    middle: np.ndarray
    spread: np.ndarray
    fills: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    sizes: np.ndarray
    positives: np.ndarray
    places: np.ndarray = field(default=None)

    def units(self, x: np.ndarray) -> np.ndarray:
        """``u``: values about the middle, 0 where missing, then indicators and a one for the intercept."""
        missing = np.isnan(x)
        return np.hstack([np.where(missing, 0.0, (x - self.middle) / self.spread), missing, np.ones((len(x), 1))])

    def own(self, fold: int, scaled: bool) -> np.ndarray:
        """The matrix that makes a fold's columns of ``u``: values with missing ones filled, indicators and a one."""
        w = len(self.columns)
        out = np.zeros((2 * w + 1, 2 * w + 1))
        j, out[-1, -1] = np.arange(w), 1.0
        if not scaled:
            out[j, j], out[j, w + j], out[j, -1] = self.spread, -1.0 - self.middle, self.middle
            return out
        deviation, mean = self.deviations[fold], self.means[fold]
        out[j, j], out[j, w + j], out[j, -1] = self.spread / deviation[:w], (self.fills[fold] - self.middle) / deviation[:w], (self.middle - mean[:w]) / deviation[:w]
        out[w + j, w + j], out[w + j, -1] = 1 / deviation[w:], -mean[w:] / deviation[w:]
        return out

    def space(self, i: int) -> np.ndarray:
        """The matrix that makes coefficients over ``u`` of those that the fit has; an indicator of what train never lacks is constant and has none."""
        fold, spec = self.pairs[i]
        some = np.array([c in spec.columns for c in self.columns])
        free = np.hstack([some, some & spec.scaled & (self.means[fold, len(some) :] > 0), [True]])
        return self.own(fold, spec.scaled).T[:, free]

    def weights(self, fold: int, y: np.ndarray) -> np.ndarray:
        n, pos = self.sizes[fold], self.positives[fold]
        return np.where(y == 1, n / (2 * max(1, pos)), n / (2 * max(1, n - pos)))

    def scores(self, i: int, x: np.ndarray) -> np.ndarray:
        return self.scored([i], self.units(x))[0]

    def scored(self, here: Sequence[int], u: np.ndarray) -> np.ndarray:
        """Scores of some fits, a line for each. Term by term, as a matrix product may round equal rows apart by their place in a batch, and ties count."""
        margins, places = np.zeros((len(here), len(u))), self.places[here]
        for j, column in enumerate(np.ascontiguousarray(u.T)):
            if (some := np.flatnonzero(places[:, j])).size:
                margins[some] += places[some, j : j + 1] * column
        logistic = [j for j, i in enumerate(here) if not self.pairs[i][1].ridge]
        margins[logistic] = _logistic(margins[logistic])
        return margins

    def sums(self, active: Sequence[int], bent: set[int], batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        """Of each active fit: loss and gradient over ``u`` at its place, without the penalty, then the Hessian of those of ``bent``, in one array."""
        total: dict[int, np.ndarray] = {}
        by_fold: dict[int, list[int]] = {}
        for i in active:
            by_fold.setdefault(self.pairs[i][0], []).append(i)
        for batch in batches:
            u, y, train = self.units(_matrix(batch.column("x"), len(self.columns))), batch.column("y").to_numpy(zero_copy_only=False), _members(batch.column("train"), len(self.sizes))
            for fold, here in by_fold.items():
                rows = np.flatnonzero(train[:, fold])
                if not len(rows):
                    continue
                z, t = u[rows], y[rows]
                loss, slope, bend = _terms(z @ self.places[here].T, t[:, None], np.array([self.pairs[i][1].ridge for i in here]))
                even = [j for j, i in enumerate(here) if self.pairs[i][1].balanced]
                if even:
                    weight = self.weights(fold, t)[:, None]
                    for part in (loss, slope, bend):
                        part[:, even] *= weight
                losses, slopes = loss.sum(0), (z.T @ slope).T
                for j, i in enumerate(here):
                    found = np.concatenate([losses[j : j + 1], slopes[j], *([(z.T @ (bend[:, j : j + 1] * z)).ravel()] if i in bent else [])])
                    total[i] = total[i] + found if i in total else found
        return total

    def shared_sums(self, starts: Mapping[Linear, np.ndarray], batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        """``sums`` with Hessians at a place that all folds of a candidate have in common, so that a row's terms are found once for all."""
        size = 2 * len(self.columns) + 1
        folds = sorted({k for k, _ in self.pairs})
        numbers: dict[tuple[int, Linear], list[int]] = {}
        for i, pair in enumerate(self.pairs):
            numbers.setdefault(pair, []).append(i)
        a, b = np.triu_indices(size)
        total = {spec: np.zeros((len(folds), 1 + size + len(a))) for spec in starts}
        for batch in batches:
            u, y = self.units(_matrix(batch.column("x"), len(self.columns))), batch.column("y").to_numpy(zero_copy_only=False)
            plain = _members(batch.column("train"), len(self.sizes))[:, folds].astype(float)
            balanced = plain * np.stack([self.weights(k, y) for k in folds], 1) if any(s.balanced for s in starts) else plain
            products = u[:, a] * u[:, b]
            for spec, place in starts.items():
                loss, slope, bend = _terms(u @ place, y, spec.ridge)
                of = balanced if spec.balanced else plain
                total[spec] += np.hstack([(loss @ of)[:, None], (of * slope[:, None]).T @ u, (of * bend[:, None]).T @ products])
        out = {}
        for spec, found in total.items():
            for k, values in zip(folds, found, strict=True):
                for i in numbers.get((k, spec), []):
                    bend = np.zeros((size, size))
                    bend[a, b] = bend[b, a] = values[1 + size :]
                    out[i] = np.concatenate([values[: 1 + size], bend.ravel()])
        return out


def _terms(m: np.ndarray, t: np.ndarray, ridge: np.ndarray | bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of margins against labels, its slope and bend; ``ridge`` by column."""
    e = np.exp(-np.abs(m))
    p = np.where(m >= 0, 1.0, e) / (1 + e)
    loss, slope, bend = np.log1p(e) + np.maximum(m, 0) - t * m, p - t, p * (1 - p)
    if np.any(ridge):
        loss, slope, bend = np.where(ridge, (m - t) ** 2 / 2, loss), np.where(ridge, m - t, slope), np.where(ridge, 1.0, bend)
    return loss, slope, bend


def _by_entry(table: DataFrame, of: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], keys: int, size: int) -> np.ndarray:
    """Arrays that tasks make by key, summed: a matrix keys x size."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, values in of(parts).items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k)), pa.array(np.arange(len(values))), pa.array(values)], ["k", "j", "v"])

    found = map_arrow(table, batches, "k bigint, j bigint, v double").groupBy("k", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((keys, size))
    out[found.column("k").to_numpy(), found.column("j").to_numpy()] = found.column("v").to_numpy()
    return out


def _fills(rows: Rows, folds: Sequence[int]) -> np.ndarray:
    """The exact median of each column over each fold's train rows, 0 without values.

    The sample gives two values with the median between them almost surely; a pass counts those below and above and groups those between, about
    a fiftieth. Where the middle is not between them, a second pass groups all.
    """
    width, number = len(rows.columns), len(rows.folds)
    out, bounds = np.zeros((number, width)), {}
    for k in folds:
        here = rows.sample.x[rows.sample.train[:, k]]
        for j in range(width):
            v = here[~np.isnan(here[:, j]), j]
            away = min(0.5, 2.5 / np.sqrt(max(1, len(v))))
            bounds[k, j] = tuple(np.quantile(v, [0.5 - away, 0.5 + away], method="nearest")) if len(v) > 100 else (-np.inf, np.inf)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between: dict[tuple[int, int], list[np.ndarray]] = {}
        outside = {key: [0, 0] for key in bounds}
        held = 0

        def row(k: int, j: int, z: int, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(np.full(len(v), i, np.int32)) for i in (k, j, z)], pa.array(v), pa.array(n)], ["k", "j", "z", "v", "n"])

        def grouped() -> Iterator[pa.RecordBatch]:
            for (k, j), values in between.items():
                yield row(k, j, 1, *np.unique(np.concatenate(values), return_counts=True))
            between.clear()

        for batch in parts:
            x, train = _matrix(batch.column("x"), width), _members(batch.column("train"), number)
            for k in {k for k, _ in bounds}:
                here = x[train[:, k]]
                for j in range(width):
                    if (k, j) in bounds:
                        v, (low, high) = here[:, j], bounds[k, j]
                        below, above = v < low, v > high
                        outside[k, j][0] += int(below.sum())
                        outside[k, j][1] += int(above.sum())
                        some = v[~(below | above | np.isnan(v))]
                        between.setdefault((k, j), []).append(some)
                        held += len(some)
            if held > HELD:
                yield from grouped()
                held = 0
        yield from grouped()
        for (k, j), n in outside.items():
            for z, count in zip((0, 2), n, strict=True):
                if count:
                    yield row(k, j, z, np.zeros(1), np.array([count]))

    while bounds:
        counts = map_arrow(rows.table.select("x", "train"), batches, "k int, j int, z int, v double, n bigint").groupBy("k", "j", "z", "v").agg(F.sum("n").alias("n"))
        each = Window.partitionBy("k", "j")
        placed = counts.withColumns({"upto": F.sum("n").over(each.orderBy("z", "v").rowsBetween(Window.unboundedPreceding, Window.currentRow)), "total": F.sum("n").over(each)})
        at = [F.max(F.when((F.col("z") == 1) & (place < F.col("upto")) & (place >= F.col("upto") - F.col("n")), F.col("v"))) for place in (F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))]
        found = {(r["k"], r["j"]): r["m"] for r in placed.groupBy("k", "j").agg(((at[0] + at[1]) / 2).alias("m")).collect()}  # one row per fold and column
        for (k, j), value in found.items():
            out[k, j] = 0.0 if value is None else value
        bounds = {key: (-np.inf, np.inf) for key, value in found.items() if value is None}
    return out


def _learned(rows: Rows, pairs: list[tuple[int, Linear]]) -> Fits:
    """Medians, means, deviations and class counts of each fold's train rows: two or three jobs for all folds."""
    folds, width, used = len(rows.folds), len(rows.columns), sorted({k for k, _ in pairs})
    seen = [x[np.isfinite(x)] for x in rows.sample.x.T]
    middle = np.array([np.median(x) if len(x) else 0.0 for x in seen])
    spread = np.array([x.std() if len(x) else 0.0 for x in seen])
    spread = np.where(spread > 1e-12 * np.abs(middle), spread, 1.0)
    fills = _fills(rows, used) if any(spec.scaled for _, spec in pairs) else np.zeros((folds, width))

    def of(parts: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total: dict[int, np.ndarray] = {}
        for batch in parts:
            x, y, train = _matrix(batch.column("x"), width), batch.column("y").to_numpy(zero_copy_only=False), _members(batch.column("train"), folds)
            for k in used:
                at = np.flatnonzero(train[:, k])
                if not len(at):
                    continue
                here = x[at]
                missing = np.isnan(here)
                away = np.where(missing, 0.0, here - fills[k])  # about the median, so that squares lose nothing
                found = np.concatenate([[len(here), (y[at] == 1).sum()], away.sum(0), missing.sum(0), (away * away).sum(0)])
                total[k] = total[k] + found if k in total else found
        return total

    found = _by_entry(rows.table.select("y", "x", "train"), of, folds, 2 + 3 * width)
    n = np.maximum(found[:, :1], 1)
    away, lacks, squares = (found[:, 2 + k * width : 2 + (k + 1) * width] / n for k in range(3))
    deviations = np.sqrt(np.maximum(np.hstack([squares - away**2, lacks * (1 - lacks)]), 0.0))
    # a column that does not vary is left as it is, up to rounding
    size = np.hstack([np.abs(fills) + np.sqrt(squares), np.ones_like(lacks)])
    return Fits(pairs, rows.columns, middle, spread, fills, np.hstack([fills + away, lacks]), np.where(deviations > 1e-12 * size, deviations, 1.0), found[:, 0], found[:, 1])


def _starts(rows: Rows, fits: Fits) -> dict[Linear, np.ndarray]:
    """A place over ``u`` for each candidate: about its optimum on the sample, whatever the fold."""
    used = sorted({k for k, _ in fits.pairs})
    some = rows.sample.train[:, used].any(1) & ~np.isnan(rows.sample.y)
    u, t, size = fits.units(rows.sample.x[some]), rows.sample.y[some], 2 * len(rows.columns) + 1
    out = {}
    for spec in dict.fromkeys(spec for _, spec in fits.pairs):
        chosen = np.array([c in spec.columns for c in rows.columns])
        space = np.eye(size)[:, np.hstack([chosen, chosen, [True]])] if spec.scaled else fits.own(0, False).T[:, np.hstack([chosen, np.zeros_like(chosen), [True]])]
        z, pos = u @ space, max(1, (t == 1).sum())
        weight = np.where(t == 1, len(t) / (2 * pos), len(t) / (2 * max(1, len(t) - pos))) if spec.balanced else np.ones(len(t))
        penalty = np.full(z.shape[1], rows.sample.share / spec.c)
        penalty[-1] = 1e-6
        at, step, least, base = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.inf, np.zeros(z.shape[1])
        for _ in range(30):
            loss, slope, bend = _terms(z @ at, t, spec.ridge)
            value = weight @ loss + (penalty * at * at).sum() / 2
            if value > least * (1 + 1e-12):
                step = step / 2
            else:
                base, least = at, value
                step = -np.linalg.lstsq(z.T @ ((weight * bend)[:, None] * z) + np.diag(penalty), z.T @ (weight * slope) + penalty * at, rcond=None)[0]
            at = base + step
            if np.abs(step).max() < 1e-6:
                break
        out[spec] = space @ at if np.isfinite(at).all() else np.zeros(size)
    return out


def fit_all(rows: Rows, pairs: list[tuple[int, Linear]]) -> Fits:
    """The optimum of every (fold, candidate), by Newton steps that are halved where the loss would rise.

    An error for a logistic fit whose train rows lack a class, as it has no optimum.
    """
    fits = _learned(rows, pairs)
    bad = [rows.folds[k] for k, spec in pairs if not spec.ridge and not 0 < fits.positives[k] < fits.sizes[k]]
    if bad:
        raise ValueError(f"train rows of {bad[0]} lack a class")
    if not pairs:
        return fits
    size, table = 2 * len(rows.columns) + 1, rows.table.select("y", "x", "train")
    starts, spaces = _starts(rows, fits), [fits.space(i) for i in range(len(pairs))]
    at = [np.linalg.lstsq(space, starts[spec], rcond=None)[0] for space, (_, spec) in zip(spaces, pairs, strict=True)]
    base, step, bends = list(at), [np.zeros_like(b) for b in at], [np.empty(0)] * len(pairs)
    fits.places = np.array([space @ b for space, b in zip(spaces, at, strict=True)])
    least, active, bent = np.full(len(pairs), np.inf), list(range(len(pairs))), set(range(len(pairs)))
    for taken in range(STEPS):
        now, curved = list(active), set(bent)
        found = _by_entry(table, lambda parts: fits.sums(now, curved, parts) if taken else fits.shared_sums(starts, parts), len(pairs), 1 + size + size * size)  # noqa: B023
        if not np.isfinite(found[now]).all():
            raise ValueError("train rows hold labels or values that are not finite")
        active, bent = [], set()
        for i in now:
            penalty = np.full(len(at[i]), 1 / pairs[i][1].c)
            penalty[-1] = 0.0
            loss = found[i, 0] + (penalty * at[i] * at[i]).sum() / 2
            if loss > least[i] * (1 + 1e-12) and np.abs(step[i]).max() > STILL:
                step[i] = step[i] / 2
                if i in curved:
                    bent.add(i)
            else:
                base[i], least[i], last = at[i], min(loss, least[i]), np.abs(step[i]).max()
                slope = spaces[i].T @ found[i, 1 : 1 + size] + penalty * at[i]
                if i in curved:
                    bends[i] = spaces[i].T @ found[i, 1 + size :].reshape(size, size) @ spaces[i] + np.diag(penalty)
                step[i] = -np.linalg.lstsq(bends[i], slope, rcond=None)[0]
                if taken and np.abs(step[i]).max() > last / 10:
                    bent.add(i)
            at[i] = base[i] + step[i]
            fits.places[i] = spaces[i] @ at[i]
            if np.abs(step[i]).max() > STILL * max(1.0, np.abs(base[i]).max()):
                active.append(i)
        if not active:
            break
    return fits


def ranked(rows: Rows, fits: Fits) -> DataFrame:
    """(i, auc, brier) of each fit over its fold's validation rows, as ``metric_bundle`` has them but unrounded.

    Tasks sort the scores of a fit and cut them at places that the sample gives (they decide what lies together, not the result); each
    range is counted on its own, and a positive of a range wins over all negatives of the ranges before it.
    """
    by_fold: dict[int, list[int]] = {}
    cuts = []
    for i, (k, _) in enumerate(fits.pairs):
        by_fold.setdefault(k, []).append(i)
        found = np.sort(fits.scores(i, rows.sample.x[rows.sample.valid[:, k]]))
        ranges = int(len(found) / rows.sample.share / RANGE) + 1
        cuts.append(np.unique(found[[len(found) * r // ranges for r in range(1, ranges)]]) if len(found) else found)
    width, folds = len(rows.columns), len(rows.folds)

    def packed(v: np.ndarray) -> tuple[bytes, bytes]:
        """Sorted values, and their counts where they repeat so often that this is less."""
        values, counts = np.unique(v, return_counts=True) if len(v) else (v, v)
        return (values.tobytes(), counts.astype(np.int64).tobytes()) if 2 * len(values) < len(v) else (v.tobytes(), b"")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[tuple[int, int], list[np.ndarray]] = {}
        squares, known, held = np.zeros(len(fits.pairs)), np.zeros(len(fits.pairs), np.int64), 0

        def out() -> Iterator[pa.RecordBatch]:
            for k, here in by_fold.items():
                if (k, 0) not in classes:
                    continue
                both = [np.sort(np.concatenate(classes[k, c], axis=1), axis=1) for c in (0, 1)]
                for j, i in enumerate(here):
                    split = [np.split(v[j], np.searchsorted(v[j], cuts[i])) for v in both]
                    lines = [(i, r, *packed(neg), *packed(pos), squares[i] if r == 0 else 0.0, int(known[i]) if r == 0 else 0) for r, (neg, pos) in enumerate(zip(*split, strict=True)) if r == 0 or len(neg) or len(pos)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines, strict=True), _RANGES.values(), strict=True)], list(_RANGES))
            classes.clear()
            squares[:], known[:] = 0.0, 0

        for batch in parts:
            u, y, valid = fits.units(_matrix(batch.column("x"), width)), batch.column("y").to_numpy(zero_copy_only=False), _members(batch.column("valid"), folds)
            for k, here in by_fold.items():
                at = np.flatnonzero(valid[:, k])
                if not len(at):
                    continue
                t, p = y[at], fits.scored(here, u[at])
                squares[here] += np.nansum((p - t) ** 2, axis=1)
                known[here] += int((~np.isnan(t)).sum())
                for c in (0, 1):
                    classes.setdefault((k, c), []).append(p[:, t == c])
                held += p.size
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    def merged(blobs: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted values, and how many lie at or before each place."""
        values = [np.frombuffer(b) for b in blobs]
        number = [np.frombuffer(c, np.int64) if c else np.ones(len(v), np.int64) for v, c in zip(values, counts, strict=True)]
        v, n = np.concatenate(values), np.concatenate(number)
        order = np.argsort(v, kind="stable") if len(n) != n.sum() else None
        return (v[order], np.concatenate([[0], np.cumsum(n[order])])) if order is not None else (np.sort(v), np.arange(len(v) + 1))

    def wins(group: pa.Table) -> pa.Table:
        neg, before = merged(*(group.column(c).to_pylist() for c in ("neg", "neg_n")))
        pos, upto = merged(*(group.column(c).to_pylist() for c in ("pos", "pos_n")))
        here = before[np.searchsorted(neg, pos)] + before[np.searchsorted(neg, pos, side="right")]
        found = {"i": group.column("i")[0].as_py(), "r": group.column("r")[0].as_py(), "p": int(upto[-1]), "n": int(before[-1]), "w": int((np.diff(upto) * here).sum()), "s": pc.sum(group.column("squares")).as_py(), "c": pc.sum(group.column("known")).as_py()}
        return pa.Table.from_pylist([found], pa.schema([("i", pa.int32()), ("r", pa.int32()), ("p", pa.int64()), ("n", pa.int64()), ("w", pa.int64()), ("s", pa.float64()), ("c", pa.int64())]))

    cut = map_arrow(rows.table.select("y", "x", "valid").filter(F.exists("valid", lambda w: w != 0)), batches, "i int, r int, neg binary, neg_n binary, pos binary, pos_n binary, squares double, known bigint")
    by_range = cut.groupBy("i", "r").applyInArrow(wins, "i int, r int, p bigint, n bigint, w bigint, s double, c bigint")
    below = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # twice the wins, as ties count half; in doubles, as the product of two counts may be beyond a long
    totals = by_range.withColumn("w", F.col("w").cast("double") + 2.0 * F.col("p") * below).groupBy("i").agg(*[F.sum(c).alias(c) for c in ("p", "n", "w", "s", "c")])
    both = F.col("p").cast("double") * F.col("n")
    return totals.select("i", F.when(both > 0, F.col("w") / 2 / both).alias("auc"), F.try_divide("s", "c").alias("brier"))


_RANGES = {"i": pa.int32(), "r": pa.int32(), "neg": pa.binary(), "neg_n": pa.binary(), "pos": pa.binary(), "pos_n": pa.binary(), "squares": pa.float64(), "known": pa.int64()}


def _predictions(rows: Rows, fits: Fits, names: Sequence[str], df: DataFrame, manifest: DataFrame, id_: str, label: str) -> DataFrame:
    """(mode, fold, candidate, id, label, probability) of the validation rows of each fit's fold."""
    width, folds = len(rows.columns), len(rows.folds)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x, valid = _matrix(batch.column("x"), width), _members(batch.column("valid"), folds)
            for i, (k, _) in enumerate(fits.pairs):
                at = np.flatnonzero(valid[:, k])
                if len(at):
                    taken = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), batch.column("id").take(taken), batch.column("y").take(taken), pa.array(fits.scores(i, x[at]))], ["_i", "id", "label", "probability"])

    kinds = {f.name: f.dataType.simpleString() for f in manifest.schema}
    given = {f.name: f.dataType for f in df.schema}
    named = df.sparkSession.createDataFrame([(i, *rows.folds[k], name) for i, ((k, _), name) in enumerate(zip(fits.pairs, names, strict=True))], f"_i int, mode {kinds['mode']}, fold {kinds['fold']}, candidate string")
    held = rows.table.select("id", "y", "x", "valid").filter(F.exists("valid", lambda w: w != 0))
    out = map_arrow(held, batches, f"_i int, id {given[id_].simpleString()}, label double, probability double")
    return out.join(F.broadcast(named), "_i").select("mode", "fold", "candidate", "id", F.col("label").cast(given[label]).alias("label"), "probability")


def _columns(candidates: Mapping[str, Linear]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(c for spec in candidates.values() for c in spec.columns))


def validate_all(df: DataFrame, manifest: DataFrame, id_: str, label: str, candidates: Mapping[str, Linear], pairs: Sequence[tuple[tuple, str]] | None = None) -> DataFrame:
    """(mode, fold, candidate, id, label, probability) of the validation rows of each fold by fits on its train rows.

    All fits are made at once. ``pairs`` ((mode, fold), candidate) are those to fit; all if not given.
    """
    rows = rows_of(df, manifest, label, _columns(candidates), id_)
    number = {f: k for k, f in enumerate(rows.folds)}
    wanted = [(number[f], name) for f, name in pairs if f in number] if pairs is not None else [(k, name) for k in range(len(rows.folds)) for name in candidates]
    return _predictions(rows, fit_all(rows, [(k, candidates[name]) for k, name in wanted]), [name for _, name in wanted], df, manifest, id_, label)


def nested_all(df: DataFrame, outer: DataFrame, parts: int, seed: str, id_: str, label: str, candidates: Mapping[str, Linear], choose: Callable[[DataFrame], Mapping[int, str]]) -> DataFrame:
    """Predictions as of ``validate_all`` by the candidate that ``choose`` names for each outer fold, by its number.

    It is given (mode, fold, candidate, auc, brier) over the inner folds, ``mode`` being that number as text. Rows with their outer
    and inner folds are written once and serve both rounds of fits; inner scores are ranked where they are made.
    """
    rows, m = nested_rows(df, outer, parts, seed, label, _columns(candidates), id_)
    inner = [(k, name) for k in range(m, len(rows.folds)) for name in candidates]
    fits = fit_all(rows, [(k, candidates[name]) for k, name in inner])
    named = df.sparkSession.createDataFrame([(i, str(rows.folds[k][0]), rows.folds[k][1], name) for i, (k, name) in enumerate(inner)], "i int, mode string, fold int, candidate string")
    scores = ranked(rows, fits).join(named, "i").select("mode", "fold", "candidate", F.round("auc", 6).alias("auc"), F.round("brier", 6).alias("brier"))
    chosen = sorted(choose(scores).items())
    return _predictions(rows, fit_all(rows, [(k, candidates[name]) for k, name in chosen]), [name for _, name in chosen], df, outer, id_, label)
