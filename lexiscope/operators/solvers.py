"""Linear classifiers fitted over partitions: trust-region Newton, SGD, naive Bayes.

Rows are ``(y, fold, indices, values)``: a class, the model that the row is
held out from (-1: none) and a sparse vector. Several models are fitted in
step, so that a pass over the rows serves all of them; model k tells its class
``targets[k]`` (1 unless given) from all others.

Weights are never held as one array, since they grow with the terms. The
weights of a penalised linear model are a sum of its training rows, ``w = X'a``,
and so are all gradients and directions of its solver; solvers keep the
coefficients ``a`` (models x rows) and the intercepts, and all they need of the
columns is the product ``X X'a``, the margins of the rows. For it the entries
are kept in tiles of whole columns: a task makes the weights of its columns from
``a``, adds up their part of the margins and forgets them; the parts of all tasks
are added up by a shuffle (by the driver, if together they are small). What
reaches the driver are arrays of models x labelled rows. A fitted model is a
table ``(idx, w array<double>)``, written by the tasks.

The objective of a model is ``|w|^2 / 2 + C * sum(loss)``; the intercept is
part of w where ``penalise_intercept`` says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.operators.terms import written

SLICE = 1 << 13
DIRECT = 64 << 20
CHUNK = 1 << 20         # entries of a tile, beyond which it ends with its column
PER_PART = 1 << 22      # entries of a partition of tiles


class Training:
    """The rows of a fit, numbered from 0, and their tiles.

    ``rows`` are ``(row, part, y, fold, indices, values)``, ``tiles`` packed
    entries by column; ``y`` and ``fold`` are arrays over the rows."""

    def __init__(self, rows: DataFrame, targets: list[int]):
        spark = rows.sparkSession
        self.held = rows.withColumn("_at", F.monotonically_increasing_id()).persist()
        placed = self.held.withColumn("part", F.shiftright("_at", 33).cast("int"))
        counts = sorted((r[0], r[1], r[2] or 0) for r in placed.groupBy("part").agg(
            F.count(F.lit(1)), F.sum(F.size("indices"))).collect())
        before = dict(zip([c[0] for c in counts], np.cumsum([0, *[c[1] for c in counts]]).tolist()))
        starts = F.broadcast(spark.createDataFrame(list(before.items()), "part int, _before long"))
        self.rows = (placed.join(starts, "part").withColumn("row", (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("int"))
                     .select("row", "part", "y", "fold", "indices", "values"))
        self.n, self.longest = sum(c[1] for c in counts), max([c[1] for c in counts], default=1)
        entries = self.rows.select("row", F.explode(F.arrays_zip("indices", "values")).alias("e")).select(
            F.col("e.indices").alias("idx"), "row", F.col("e.values").alias("value"))
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + sum(c[2] for c in counts) // PER_PART)
        tiles = entries.repartition(wanted, "idx").sortWithinPartitions("idx", "row")
        self.tiles = written(tiles.mapInArrow(_pack, "ids binary, starts binary, row binary, value binary"), "tiles")
        self.partitions, self.targets, self.passes = wanted, targets, 0
        # a label and a fold per row
        got = self.rows.select("row", "y", "fold").toArrow()
        order = np.argsort(got["row"].to_numpy())
        y, fold = (got[c].to_numpy()[order] for c in ("y", "fold"))
        self.label, self.fold = y, fold
        # models x rows, a byte each
        self.y = np.where(y[None, :] == np.array(targets)[:, None], np.int8(1), np.int8(-1))
        self.use = fold[None, :] != np.arange(len(targets))[:, None]

    def release(self) -> None:
        self.held.unpersist()

    def product(self, a: np.ndarray) -> np.ndarray:
        """(models x rows) margins without intercept of the weights ``X'a``."""
        self.passes += 1
        if not self.n or not a.any():
            return np.zeros(a.shape)

        def part(batches: Iterator[pa.RecordBatch], now: dict) -> np.ndarray | None:
            total = None
            for t in _tiles(batches):
                one = np.stack([np.bincount(t.row, np.repeat(w, t.sizes) * t.value, now["a"].shape[1])
                                for w in t.weights(now["a"])])
                total = one if total is None else total + one
            return total

        got = array_sum(self.tiles, part, {"a": a}, len(a), 8 * a.size * self.partitions > DIRECT)
        return got if got.size else np.zeros(a.shape)

    def weights(self, a: np.ndarray) -> DataFrame:
        """The weights ``X'a`` as a written table ``(idx, w)``."""
        shared = self.tiles.sparkSession.sparkContext.broadcast(a)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _tiles(batches):
                w = t.weights(shared.value)
                ends = pa.array(np.arange(len(t.ids) + 1, dtype=np.int32) * len(w))
                yield pa.RecordBatch.from_pydict({"idx": pa.array(t.ids), "w": pa.ListArray.from_arrays(ends, pa.array(w.T.ravel()))})

        out = written(self.tiles.mapInArrow(run, "idx int, w array<double>"), "weights")
        shared.destroy()
        return out


class _Tile:
    def __init__(self, ids, starts, row, value):
        self.ids, self.starts, self.row, self.value = ids, starts, row, value
        self.sizes = np.diff(np.append(starts, len(row)))

    def weights(self, a: np.ndarray) -> np.ndarray:
        """(models x columns) of the tile."""
        return np.stack([np.add.reduceat(x[self.row] * self.value, self.starts) for x in a])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tile]:
    for b in batches:
        for k in range(b.num_rows):
            yield _Tile(*[np.frombuffer(b.column(c)[k].as_buffer(), t) for c, t in (
                ("ids", np.int32), ("starts", np.int64), ("row", np.int32), ("value", np.float64))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by column as tiles of whole columns."""
    def tile(idx, row, value):
        starts = np.flatnonzero(np.concatenate([[True], np.diff(idx) != 0]))
        return pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (
            ("ids", idx[starts].astype(np.int32)), ("starts", starts.astype(np.int64)), ("row", row.astype(np.int32)), ("value", value))})

    held, size = [], 0
    for b in batches:
        held.append([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
        size += b.num_rows
        if size >= CHUNK:
            idx, row, value = (np.concatenate(x) for x in zip(*held))
            cut = np.searchsorted(idx, idx[-1])
            if cut:
                yield tile(idx[:cut], row[:cut], value[:cut])
            held = [[idx[cut:], row[cut:], value[cut:]]]
            size = len(idx) - cut
    if size:
        yield tile(*(np.concatenate(x) for x in zip(*held)))


def array_sum(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch], dict], np.ndarray | None], state: dict,
              height: int, by_shuffle: bool) -> np.ndarray:
    """Sum of the arrays (height x any width) that ``part`` makes of the
    record batches of each partition."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = part(batches, shared.value)
        if total is not None:
            for k in range(0, total.shape[1], SLICE):
                piece = np.ascontiguousarray(total[:, k:k + SLICE])
                if piece.any():
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([k // SLICE], pa.int32()),
                                                      "width": pa.array([total.shape[1]], pa.int64()),
                                                      "sums": pa.array([piece.tobytes()], pa.binary())})

    def add(pieces: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_buffer()) for s in pieces["sums"])
        return pa.table({"slice": pieces["slice"].slice(0, 1), "width": pieces["width"].slice(0, 1),
                         "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "slice int, width long, sums binary"
    pieces = rows.mapInArrow(run, schema)
    if by_shuffle:
        pieces = pieces.groupBy("slice").applyInArrow(add, schema)
    got = pieces.collect()
    shared.destroy()        # the driver's copy as well: every pass has one
    out = np.zeros((height, max((r.width for r in got), default=0)))
    for r in got:
        piece = np.frombuffer(r.sums).reshape(height, -1)
        out[:, r.slice * SLICE:r.slice * SLICE + piece.shape[1]] += piece
    return out


# ---- trust-region Newton

def loss_terms(loss: str, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, derivative and second derivative by the margin y w.x."""
    if loss == "squared_hinge":
        gap = np.maximum(0.0, 1.0 - margin)
        return gap * gap, -2.0 * gap, 2.0 * (gap > 0)
    if loss == "logistic":
        p = np.where(margin >= 0, 1.0, np.exp(-np.abs(margin))) / (1.0 + np.exp(-np.abs(margin)))
        return np.logaddexp(0.0, -margin), p - 1.0, p * (1.0 - p)
    raise ValueError(f"unknown loss {loss!r}")


class Losses:
    """Losses of models that each tell one class from the rest."""

    def __init__(self, data: Training, loss: str):
        self.data, self.loss = data, loss

    def at(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per model the sum of the losses; their derivatives by the margins."""
        d = self.data
        value, first, self.second = loss_terms(self.loss, d.y * margin)
        self.second = d.use * self.second
        return (d.use * value).sum(axis=1), d.use * first * d.y

    def curve(self, change: np.ndarray) -> np.ndarray:
        """The derivatives' change with the margins, at the last ``at``."""
        return self.second * change


class Softmax:
    """The loss of one multinomial model, its classes as the models in step."""

    def __init__(self, data: Training):
        self.hit = data.y > 0

    def at(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = margin.max(axis=0)
        e = np.exp(margin - top)
        self.p = e / e.sum(axis=0)
        value = np.where(self.hit, top + np.log(e.sum(axis=0)) - margin, 0.0)
        known = self.hit.any(axis=0)        # rows of another class than the targets have no loss
        self.p = self.p * known
        return value.sum(axis=1), self.p - self.hit

    def curve(self, change: np.ndarray) -> np.ndarray:
        return self.p * (change - (self.p * change).sum(axis=0))


class Vector:
    """Weights ``X'a`` and intercepts ``b`` of models, with the margins that
    the rows have of ``X'a`` (``m``)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, m: np.ndarray):
        self.a, self.b, self.m = a, b, m

    def plus(self, by: np.ndarray, other: "Vector") -> "Vector":
        k = by[:, None]
        return Vector(self.a + k * other.a, self.b + by * other.b, self.m + k * other.m)

    def where(self, ok: np.ndarray, other: "Vector") -> "Vector":
        k = ok[:, None]
        return Vector(np.where(k, self.a, other.a), np.where(ok, self.b, other.b), np.where(k, self.m, other.m))


def newton_rows(data: Training, losses, c: float = 1.0, penalise_intercept: bool = True, tol: float = 1e-4,
                max_iter: int = 1000, joint: bool = False) -> tuple[Vector, dict]:
    """The weights that minimise the objective, by Newton steps in a trust
    region: each step solves the quadratic model by conjugate gradients, whose
    products with the Hessian are one product for all models. Stops where the
    gradient's norm is below ``tol`` times that at zero weights. ``joint``: the
    models are the classes of one, with common steps. Returns the weights and,
    per model, the gradient's norms."""
    models, weight = len(data.targets), 1.0 if penalise_intercept else 0.0
    zero = Vector(np.zeros((models, data.n)), np.zeros(models), np.zeros((models, data.n)))

    def together(x):
        return np.full(models, x.sum()) if joint else x

    def dots(u, v):
        return together((u.a * v.m).sum(axis=1) + u.b * v.b)

    def vector(a, b):
        return Vector(a, b, data.product(a))

    def evaluate(w):
        value, first = losses.at(w.m + w.b[:, None])
        f = together(0.5 * ((w.a * w.m).sum(axis=1) + weight * w.b * w.b) + c * value)
        return f, vector(w.a + c * first, weight * w.b + c * first.sum(axis=1))

    def norm_of(v):
        return np.sqrt(np.maximum(dots(v, v), 0.0))

    w = zero
    f, g = evaluate(w)
    first = norm_of(g)
    norms, radius = [first], first.copy()
    for _ in range(max_iter):
        norm = norms[-1]
        open_ = norm > tol * np.maximum(first, 1e-300)
        if not open_.any():
            break
        # conjugate gradients for all open models in step
        losses.at(w.m + w.b[:, None])
        r = zero.plus(-open_.astype(float), g)
        s, d, rr, going = zero, r, dots(r, r), open_.copy()
        goal = 0.1 * norm
        for _ in range(200):
            going &= np.sqrt(np.maximum(rr, 0.0)) > goal
            if not going.any():
                break
            d_now = d.where(going, zero)
            h = losses.curve(d_now.m + d_now.b[:, None])
            hd = vector(d_now.a + c * h, weight * d_now.b + c * h.sum(axis=1))
            curve = dots(d_now, hd)
            alpha = np.where(going & (curve > 0), rr / np.where(curve > 0, curve, 1.0), 0.0)
            # steps that leave the region end on its border
            out = going & ((norm_of(s.plus(alpha, d_now)) > radius) | (curve <= 0))
            if out.any():
                sd, dd, ss = dots(s, d_now), dots(d_now, d_now), dots(s, s)
                root = np.sqrt(np.maximum(sd * sd + dd * np.maximum(radius * radius - ss, 0.0), 0.0))
                alpha = np.where(out, (root - sd) / np.where(dd > 0, dd, 1.0), alpha)
            s, r = s.plus(alpha, d_now), r.plus(-alpha, hd)
            going &= ~out
            new = dots(r, r)
            d = r.plus(np.where(rr > 0, new / np.where(rr > 0, rr, 1.0), 0.0), d)
            rr = np.where(going | out, new, rr)
        ahead = w.plus(np.ones(models), s)
        f_new, g_new = evaluate(ahead)
        # the quadratic model's decrease is -g.s/2 + r.s/2
        foreseen = -0.5 * (dots(g, s) - dots(s, r))
        ratio = np.where(foreseen > 0, (f - f_new) / np.where(foreseen > 0, foreseen, 1.0), 0.0)
        length = norm_of(s)
        radius = np.where(open_ & (ratio < 0.25), np.minimum(radius, length) * 0.5,
                          np.where(open_ & (ratio > 0.75), np.maximum(radius, 4 * length), radius))
        taken = open_ & (ratio > 1e-4)
        if not taken.any() and (length[open_] <= 1e-12 * (1 + norm_of(w)[open_])).all():
            break       # no step changes the objective any more
        w, f, g = ahead.where(taken, w), np.where(taken, f_new, f), g_new.where(taken, g)
        norms.append(norm_of(g))
    return w, {"norms": np.stack(norms), "objective": f, "passes": data.passes}


def dense(table: DataFrame, columns: int, intercepts: np.ndarray) -> np.ndarray:
    """A small model's weights (models x columns), the intercept last."""
    out = np.zeros((len(intercepts), columns))
    for r in table.toLocalIterator():
        out[:, r.idx] = r.w
    out[:, -1] = intercepts
    return out


def newton(rows: DataFrame, columns: int, targets: list[int], loss: str = "squared_hinge", **args) -> tuple[np.ndarray, dict]:
    """``newton_rows`` with the weights as one array, for small models."""
    data = Training(rows, targets)
    w, info = newton_rows(data, Losses(data, loss), **args)
    data.release()
    return dense(data.weights(w.a), columns, w.b), info


# ---- stochastic gradient descent

def _epoch(batches: Iterator[pa.RecordBatch], state: dict) -> np.ndarray | None:
    """One pass of SGD over the partition's rows, each batch in a random order,
    from shared weights of which the rows' margins are known. Sums, over the
    rows and six more columns: what each row adds to the weights, times the
    rows of the partition; the factor and the intercept reached, times the
    rows; the rows; the losses before each step; the rows in use."""
    alpha, t, n, y, use = state["alpha"], state["t"], 0, state["y"], state["use"]
    models, total = y.shape
    b = state["b"].copy()
    scale, losses, seen = np.ones(models), np.zeros(models), np.zeros(models)
    added, number, own = np.zeros((models, total)), {}, np.zeros((1 << 16, models))
    rng = np.random.default_rng(state["seed"])
    for batch in batches:
        rows = batch.column("row").to_numpy(zero_copy_only=False)
        ends = batch.column("indices").offsets.to_numpy()
        ends = ends - ends[0]
        at = batch.column("indices").flatten().to_numpy(zero_copy_only=False)
        values = batch.column("values").flatten().to_numpy(zero_copy_only=False)
        # the partition's columns, numbered as they come
        names, local = np.unique(at, return_inverse=True)
        places = np.array([number.setdefault(x, len(number)) for x in names.tolist()], np.int64)
        local = places[local] if len(at) else local
        if len(number) > len(own):
            own = np.concatenate([own, np.zeros((max(len(number), 2 * len(own)) - len(own), models))])
        n += len(rows)
        for i in rng.permutation(len(rows)):
            k, x, j = local[ends[i]:ends[i + 1]], values[ends[i]:ends[i + 1]], rows[i]
            margin = y[:, j] * (scale * (state["m"][:, j] + x @ own[k]) + b)
            losses += use[:, j] * np.maximum(0.0, 1.0 - margin)
            seen += use[:, j]
            eta = 1.0 / (alpha * (state["t0"] + t))
            t += 1
            # weights are scale * (shared + own); the intercept is not shrunk
            scale *= np.where(use[:, j] > 0, 1.0 - eta * alpha, 1.0)
            hit = use[:, j] * (margin < 1.0)
            if hit.any():
                step = y[:, j] * eta * hit
                own[k] += x[:, None] * (step / scale)
                added[:, j] += step / scale
                b += step
    if not n:
        return None
    return np.column_stack([added * scale[:, None] * n, scale * n, b * n, np.full(models, n), losses, seen])


def sgd_rows(data: Training, alpha: float = 1e-4, tol: float = 1e-3, patience: int = 5, max_iter: int = 1000,
             seed: int = 42) -> tuple[np.ndarray, np.ndarray, dict]:
    """Hinge loss with L2 penalty ``alpha``: rounds in which every partition
    passes over its rows once from the same weights and the weights reached
    are averaged by rows. The step size falls as 1 / (alpha (t0 + t)), t
    counting the steps of a partition; a model stops after ``patience`` rounds
    without a mean loss below its best by ``tol``; stopped models keep their
    weights. Returns the rows' coefficients, the intercepts and the rounds."""
    typical = np.sqrt(1.0 / np.sqrt(alpha))
    t0 = 1.0 / (typical * alpha)    # the loss's derivative at -typical is 1
    # a round has the steps of the longest partition
    models, n_rows, k = len(data.targets), data.n, -1
    a, b = np.zeros((models, n_rows)), np.zeros(models)
    best, calm, open_ = np.full(models, np.inf), np.zeros(models, int), np.ones(models, bool)
    rows = data.rows.select("row", "indices", "values")
    parts = rows.rdd.getNumPartitions()
    for k in range(max_iter):
        state = {"m": data.product(a), "b": b, "y": data.y, "use": data.use, "alpha": alpha, "t0": t0,
                 "t": k * data.longest, "seed": (seed, k)}
        got = array_sum(rows, _epoch, state, models, 8 * a.size * parts > DIRECT)
        if not got.size:
            break
        factor, level, n, losses, seen = got[:, n_rows:].T
        n = np.maximum(n, 1)
        a = np.where(open_[:, None], (a * factor[:, None] + got[:, :n_rows]) / n[:, None], a)
        b = np.where(open_, level / n, b)
        loss = losses / np.maximum(seen, 1)
        calm = np.where(loss > best - tol, calm + 1, 0)
        best = np.minimum(best, loss)
        open_ &= calm < patience
        if not open_.any():
            break
    return a, b, {"rounds": k + 1, "loss": best}


def sgd(rows: DataFrame, columns: int, targets: list[int], **args) -> tuple[np.ndarray, dict]:
    """``sgd_rows`` with the weights as one array, for small models."""
    data = Training(rows, targets)
    a, b, info = sgd_rows(data, **args)
    data.release()
    return dense(data.weights(a), columns, b), info


# ---- naive Bayes

def naive_bayes(rows: DataFrame, columns: int, models: list[tuple[int, int]], smoothing: float = 1.0) -> tuple[DataFrame, np.ndarray]:
    """Multinomial naive Bayes: per model ``(class, fold)`` the log
    probability of each column in the class, learnt from the rows outside the
    fold, as a table ``(idx, w)``, and the class's log share. Sums per column,
    class and fold are taken once for all models."""
    n = {(r.y, r.fold): r.n for r in rows.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    entries = rows.select("y", "fold", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    sums = written(entries.groupBy(F.col("e.indices").alias("idx"), "y", "fold").agg(F.sum("e.values").alias("s")), "sums")
    total = {(r.y, r.fold): r.s for r in sums.groupBy("y", "fold").agg(F.sum("s").alias("s")).collect()}

    def of(got: dict, y: int, fold: int) -> float:
        return float(sum(v for (c, f), v in got.items() if c == y and f != fold))

    each, shares = [], []
    for y, fold in models:
        base = np.log(of(total, y, fold) + smoothing * columns)
        part = F.sum(F.when((F.col("y") == y) & (F.col("fold") != fold), F.col("s")).otherwise(0.0))
        each.append(F.log(part + smoothing) - float(base))
        rest = {(c, f): v for (c, f), v in n.items() if f != fold}
        classes = len({c for c, _ in rest})
        shares.append(np.log(of(n, y, fold) + smoothing) - np.log(sum(rest.values()) + smoothing * classes))
    return written(sums.groupBy("idx").agg(F.array(*each).alias("w")), "weights"), np.array(shares)


def labelled(features: DataFrame, label: str, fold) -> DataFrame:
    """Rows of the solvers from ``indices`` and ``values``."""
    return features.select(F.col(label).cast("int").alias("y"), fold.cast("int").alias("fold"), "indices", "values")


def margins(features: DataFrame, weights: DataFrame, intercepts: np.ndarray, out: str = "margins") -> DataFrame:
    """All columns and the array of the models' margins w.x + b. The entries
    of the rows meet the weights of their columns in a join; a row's are added
    in the order of the columns."""
    rows = written(features.withColumn("_row", F.monotonically_increasing_id()), "scored")
    e = rows.select("_row", F.explode(F.arrays_zip("indices", "values")).alias("e"))
    e = e.select("_row", F.col("e.indices").alias("idx"), F.col("e.values").alias("v")).join(weights, "idx")
    one = F.struct("idx", F.transform("w", lambda x: x * F.col("v")).alias("p"))
    zero = F.array(*[F.lit(0.0)] * len(intercepts))
    total = F.aggregate(F.array_sort(F.collect_list(one)), zero, lambda s, x: F.zip_with(s, x["p"], lambda p, q: p + q))
    sums = e.groupBy("_row").agg(total.alias("_sums"))
    b = F.array(*[F.lit(float(x)) for x in intercepts])
    return (rows.join(sums, "_row", "left")
            .withColumn(out, F.zip_with(F.coalesce("_sums", zero), b, lambda p, q: p + q)).drop("_row", "_sums"))
