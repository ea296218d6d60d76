"""Gradient-boosted trees grown from histograms of gradients.

Features are cut in bins once and the rows written so.  A tree grows a level at a time: every task adds up its
rows' gradients and curvatures by (node, feature, bin) and sends one packed row a (node, feature); those of one meet, are added up,
of very many tasks in two steps, and give its best split, of which the driver takes the best a node.  Rows never travel, and what
the driver holds is the model.  Margins are written anew after every few trees; in between, tasks add the trees since then.

Losses: mse, msle (squared error of log(1 + y)), huber (pseudo-Huber of a width), logistic, and multinomial, whose
classes each grow a tree a round together.  Missing feature values (null or NaN) are tried on both sides of every split.

Rows: those without a target (or with NaN) take no part in training; an empty table is an error.  Extra columns are kept when
predicting; repeated rows count as often as they occur.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.sources.tables import dropped, written

LOSSES = ("mse", "msle", "huber", "logistic", "multinomial")
FIELDS = ("feature", "threshold", "missing_left", "left", "right", "value", "cover", "gain")


@dataclass(frozen=True)
class Parameters:
    trees: int = 20
    depth: int = 5
    eta: float = 0.3  # share of a tree's step that is taken
    eta_growth: float = 1.0  # by which eta grows from tree to tree, to one at most
    leaf_weight: float = 1.0  # lambda: on squared leaf values
    tree_size: float = 0.0  # gamma: on each split
    depth_cost: float = 0.0  # alpha: on splits deeper than the soft limit
    soft_depth: float = 4.0
    soft_width: float = 0.5
    bins: int = 64
    least_rows: int = 1
    sample: float = 1.0  # share of rows that a tree sees
    bag: float = 1.0  # share of features that a tree may use
    rewrite: int = 8  # trees after which margins are written anew
    seed: int = 1


@dataclass
class Model:
    loss: str
    width: float
    features: list[str]
    classes: list
    base: list[float]
    edges: list[list[float]]
    trees: list[dict] = field(default_factory=list)  # arrays by FIELDS, and the number of the class

    def margins(self, x: np.ndarray, without: tuple[int, ...] = ()) -> np.ndarray:
        """(rows, outputs): the base and the values of all trees but some."""
        out = np.tile(np.array(self.base, float), (len(x), 1))
        for i, t in enumerate(self.trees):
            if i not in without:
                out[:, t["class"]] += tree_values(t, x)
        return out

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def read_model(text: str) -> Model:
    """A model that can be trained on, from to_json(); what is wrong with the text is said in a ValueError."""
    try:
        d = json.loads(text)
        model = Model(**d)
    except (json.JSONDecodeError, TypeError) as e:
        raise ValueError(f"not a model: {e}") from e
    if model.loss not in LOSSES or len(model.edges) != len(model.features):
        raise ValueError("loss or edges don't fit")
    for i, t in enumerate(model.trees):
        n = len(t.get("feature", ()))
        if any(len(t.get(f, ())) != n for f in FIELDS) or not 0 <= t.get("class", -1) < len(model.base):
            raise ValueError(f"tree {i} is incomplete")
        if any(f >= len(model.features) or (f >= 0 and not (a < l < n and a < r < n)) for a, (f, l, r) in enumerate(zip(t["feature"], t["left"], t["right"]))):
            raise ValueError(f"tree {i} has a split that leads nowhere")
    return model


def goes_left(tree: dict, at, x: np.ndarray) -> np.ndarray:
    """Whether values of the split feature at these nodes go left; NaN goes where missing values do."""
    return np.where(np.isnan(x), np.array(tree["missing_left"], bool)[at], x <= np.array(tree["threshold"])[at])


def tree_values(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf value of every row."""
    f, left, right = (np.array(tree[k], int) for k in ("feature", "left", "right"))
    at = np.zeros(len(x), int)
    while (inner := f[at] >= 0).any():
        r = np.flatnonzero(inner)
        at[r] = np.where(goes_left(tree, at[r], x[r, f[at[r]]]), left[at[r]], right[at[r]])
    return np.array(tree["value"], float)[at]


def gradients(loss: str, width: float, m: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First derivatives of the loss by each output, and curvatures (second derivatives, but for huber)."""
    if loss in ("mse", "msle"):
        return m - y[:, None], np.ones_like(m)
    if loss == "huber":
        r = m - y[:, None]
        s = 1 + (r / width) ** 2
        return r / np.sqrt(s), 1 / np.sqrt(s)  # the parabola that touches the loss from above: a step never overshoots
    if loss == "logistic":
        p = 1 / (1 + np.exp(-np.clip(m, -500, 500)))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-6)
    p = np.exp(m - m.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p - (np.arange(m.shape[1]) == y[:, None]), np.maximum(p * (1 - p), 1e-6)


def losses(loss: str, width: float, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The loss of each row."""
    if loss in ("mse", "msle"):
        return (m[:, 0] - y) ** 2
    if loss == "huber":
        return width**2 * (np.sqrt(1 + ((m[:, 0] - y) / width) ** 2) - 1)
    if loss == "logistic":
        return np.logaddexp(0, m[:, 0]) - y * m[:, 0]
    top = m.max(1)
    return top + np.log(np.exp(m - top[:, None]).sum(1)) - m[np.arange(len(m)), y.astype(int)]


def values(batch: pa.RecordBatch, wide: int) -> np.ndarray:
    """The column x as rows of numbers, NaN where nothing is known."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, wide)


def prepared(df: DataFrame, features: list[str], target: str, loss: str, classes: list) -> DataFrame:
    """(x, y) of the rows that have a target."""
    y = F.col(target).cast("double")
    if loss in ("logistic", "multinomial"):
        y = F.array_position(F.array(*map(F.lit, classes)), F.col(target)).cast("double") - 1
    elif loss == "msle":
        y = F.log1p(F.greatest(y, F.lit(0.0)))
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    return df.where(F.col(target).isNotNull()).select(x.alias("x"), y.alias("y")).where((F.col("y") >= 0) & ~F.isnan("y") if loss in ("logistic", "multinomial") else ~F.isnan("y"))


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Each feature's distinct quantiles, from one mergeable sketch a feature."""
    typed = df.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f"f{i}") for i, f in enumerate(features)])
    cuts = typed.approxQuantile([f"f{i}" for i in range(len(features))], [k / bins for k in range(1, bins)], 1 / (4 * bins))
    return [sorted(set(c)) for c in cuts]


def binned(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """The bin of each value: 0 where missing, else from 1 by the edges below it."""
    cut = np.stack([np.searchsorted(np.array(e), x[:, i], "left") + 1 for i, e in enumerate(edges)], axis=1)
    return np.where(np.isnan(x), 0, cut).astype(np.uint8)


def packed(b: np.ndarray, y, now: np.ndarray, old: np.ndarray) -> pa.RecordBatch:
    """Rows of bins, target, margins so far and the margins of the model that is trained again."""

    def rows(a: np.ndarray) -> pa.Array:
        wide = a.itemsize * a.shape[1]
        ends = np.arange(0, (len(a) + 1) * wide, wide, dtype=np.int32) if wide else np.zeros(len(a) + 1, np.int32)
        return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(a))])

    return pa.RecordBatch.from_arrays([rows(b), y, rows(now), rows(old)], ["b", "y", "m", "old"])


def unpacked(batch: pa.RecordBatch, pending: list[dict], wide: int, outputs: int):
    """The arrays of packed(), the margins with the trees that are not yet in them."""

    def whole(c: str, kind, k: int) -> np.ndarray:
        column = batch.column(c)
        _, ends, data = column.buffers()
        start = int(np.frombuffer(ends, np.int32, 1, 4 * column.offset)[0])
        return np.frombuffer(data, np.uint8)[start : start + len(column) * k * np.dtype(kind).itemsize].view(kind).reshape(len(column), k)

    b, m = whole("b", np.uint8, wide), whole("m", float, outputs).copy()
    for t in pending:
        m[:, t["class"]] += np.array(t["value"])[walk(t, b)]
    return b, batch.column("y").to_numpy(), m, whole("old", float, outputs)


def sampled(b: np.ndarray, y: np.ndarray, tree: int, p: Parameters) -> np.ndarray:
    """Which rows a tree sees: by what they hold and their place in the batch, so that another reading of the table sees the same."""
    u = lambda n: np.uint64(n)
    mark = b.astype(np.uint64) @ (np.arange(1, b.shape[1] + 1, dtype=np.uint64) * u(2654435761)) + y.view(np.uint64) * u(40503) + np.arange(len(b), dtype=np.uint64) * u(2246822519) + u(tree * 7919 + p.seed)
    mark = (mark ^ (mark >> u(29))) * u(0x9E3779B97F4A7C15)
    return (mark >> u(44)) < p.sample * (1 << 20)


def added(table: pa.Table) -> np.ndarray:
    """The sums of the rows' packed numbers."""
    return sum(np.frombuffer(r, float) for r in table.column("sums").to_pylist())


def best_cut(s: np.ndarray, leaf_weight: float, least_rows: int, cost: float) -> tuple[float, int, bool, float, float, float]:
    """(gain, bin, missing_left, left g, h, n) of the best split by one feature of sums (g, h, n) by bin; bin -1 where none gains."""
    whole, upto = s.sum(1), np.cumsum(s, axis=1)
    score = lambda v: v[0] ** 2 / (v[1] + leaf_weight + 1e-12)
    best = (0.0, -1, True, 0.0, 0.0, 0.0)
    # missing values, in bin 0, go left with the lower values or are taken from them
    for missing_left, left in ((True, upto), (False, upto - s[:, :1])):
        right = whole[:, None] - left
        gain = (score(left) + score(right) - score(whole)) / 2 - cost
        gain = np.where((left[2] >= least_rows) & (right[2] >= least_rows), gain, -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > best[0] + 1e-12 * abs(best[0]):
            best = (float(gain[b]), b, missing_left, *left[:, b].tolist())
    return best


PACKED = "b binary, y double, m binary, old binary"
HISTOGRAM = pa.schema([("k", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("part", pa.int32()), ("sums", pa.binary())])
SPREAD = 32  # parts that tasks' sums are added up in first, where there are more than SPREAD squared


class Training:
    """The rows of a table, in bins, and the margins of a model that grows on them."""

    def __init__(self, rows: DataFrame, model: Model, p: Parameters, removed: tuple[int, ...] = (), keep: float = 0.0):
        self.model, self.p, self.keep, self.wide, self.outputs = model, p, keep, len(model.features), len(model.base)
        self.spark, self.pending, self.size = rows.sparkSession, [], max(map(len, model.edges)) + 2
        shared, wide = self.spark.sparkContext.broadcast(model), self.wide

        def first(batches):
            m = shared.value
            for batch in batches:
                x = values(batch, wide)
                now, old = m.margins(x, removed), m.margins(x)
                yield packed(binned(x, m.edges), batch.column("y"), now, old)

        self.table = written(rows.mapInArrow(first, PACKED))

    def rewrite(self) -> None:
        """Write the margins with the trees grown since the last time."""
        pending, wide, outputs = self.pending, self.wide, self.outputs

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    b, _, m, old = unpacked(batch, pending, wide, outputs)
                    yield packed(b, batch.column("y"), m, old)

        before, self.pending = self.table, []
        self.table = written(before.mapInArrow(run, PACKED))
        dropped(before)

    def histograms(self, growing: list[dict], tree: int) -> DataFrame:
        """(k, node, feature, part, sums): gradients, curvatures and rows by bin, of each task's rows in the open nodes of the trees that grow."""
        p, pending, keep, loss, width, wide, outputs = self.p, self.pending, self.keep, self.model.loss, self.model.width, self.wide, self.outputs
        rng = np.random.default_rng([p.seed, tree])
        bag = np.sort(rng.permutation(wide)[: max(1, round(p.bag * wide))])
        size = self.size

        def run(batches):
            from pyspark import TaskContext

            sums: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                b, y, m, old = unpacked(batch, pending, wide, outputs)
                g, h = gradients(loss, width, m, y)
                if keep:
                    g, h = g + keep * (m - old), h + keep
                if p.sample < 1:
                    seen = sampled(b, y, tree, p)
                    b, g, h = b[seen], g[seen], h[seen]
                for k, t in enumerate(growing):
                    at = walk(t, b)
                    for node in t["open"]:
                        r = at == node
                        if not r.any():
                            continue
                        own = sums.setdefault((k, node), np.zeros((len(bag), 3, size)))
                        for i, f in enumerate(bag.tolist()):
                            for j, w in enumerate((g[r, k], h[r, k], None)):
                                own[i, j] += np.bincount(b[r, f], w, size)
            part = TaskContext.get().partitionId() % SPREAD
            rows = [{"k": k, "node": node, "feature": f, "part": part, "sums": own[i].tobytes()} for (k, node), own in sums.items() for i, f in enumerate(bag.tolist())]
            yield pa.RecordBatch.from_pylist(rows, HISTOGRAM)

        sums = self.table.mapInArrow(run, "k int, node int, feature int, part int, sums binary")
        if len(self.table.inputFiles()) <= SPREAD**2:
            return sums
        # of very many tasks, a part each first
        one = lambda t: pa.Table.from_pylist([t.slice(0, 1).to_pylist()[0] | {"sums": added(t).tobytes()}], HISTOGRAM)
        return sums.groupBy("k", "node", "feature", "part").applyInArrow(one, "k int, node int, feature int, part int, sums binary")

    def best_splits(self, sums: DataFrame, depth: int) -> dict:
        """(k, node) -> (gain, feature, bin, missing_left, left sums, all sums): ties to the smaller feature, then the smaller bin; feature -1 for none."""
        p, size = self.p, self.size
        cost = p.tree_size + p.depth_cost * float(np.exp((depth / p.soft_depth - 1) / p.soft_width))
        schema = "k int, node int, feature int, gain double, bin int, missing_left boolean, g double, h double, n double, all_g double, all_h double, all_n double"
        names = [c.split()[0] for c in schema.split(", ")]

        def split(table: pa.Table) -> pa.Table:
            key = table.slice(0, 1).to_pylist()[0]
            s = added(table).reshape(3, size)
            found = best_cut(s, p.leaf_weight, p.least_rows, cost)
            kinds = [pa.int32()] * 3 + [pa.float64(), pa.int32(), pa.bool_()] + [pa.float64()] * 6
            row = [key["k"], key["node"], key["feature"], *found, *s.sum(1).tolist()]
            return pa.table([pa.array([v], kind) for v, kind in zip(row, kinds)], names)

        best: dict = {}
        for r in sums.groupBy("k", "node", "feature").applyInArrow(split, schema).collect():  # (nodes x features) rows
            at = (r["k"], r["node"])
            if at not in best or (-r["gain"], r["feature"]) < (-best[at]["gain"], best[at]["feature"]):
                best[at] = r
        return best

    def grow(self, tree: int, eta: float) -> list[dict]:
        """A tree for each output, all grown together."""
        p = self.p
        new = [{**{f: [0] for f in (*FIELDS, "cut")}, "class": k, "open": [0]} for k in range(self.outputs)]
        for t in new:
            t["feature"][0], t["missing_left"][0], t["value"][0] = -1, True, 0.0
        for depth in range(p.depth):
            if not any(t["open"] for t in new):
                break
            found = self.best_splits(self.histograms(new, tree), depth)
            for t in new:
                t["open"] = []
            value = lambda g, h: -eta * g / (h + p.leaf_weight + 1e-12)
            for (k, at), r in sorted(found.items()):
                t, f, b = new[k], r["feature"], r["bin"]
                t["value"][at], t["cover"][at] = value(r["all_g"], r["all_h"]), r["all_n"]
                if b < 0:
                    continue
                edges = self.model.edges[f]
                # bin b holds values up to its edge; the last bin has none, so only missing values go apart there
                t["feature"][at], t["cut"][at], t["missing_left"][at], t["gain"][at] = f, b, r["missing_left"], r["gain"]
                t["threshold"][at] = edges[b - 1] if 1 <= b <= len(edges) else (-1.7e308 if b == 0 else 1.7e308)
                own = (r["g"], r["h"], r["n"])
                rest = (r["all_g"] - r["g"], r["all_h"] - r["h"], r["all_n"] - r["n"])
                for side, (g, h, n) in (("left", own), ("right", rest)):
                    child = len(t["feature"])
                    for name, v in zip((*FIELDS, "cut"), (-1, 0.0, True, 0, 0, value(g, h), n, 0.0, 0)):
                        t[name].append(v)
                    t[side][at] = child
                    if depth + 1 < p.depth:
                        t["open"].append(child)
        for t in new:
            t["open"] = []
        self.pending += new
        if len(self.pending) >= p.rewrite * self.outputs:
            self.rewrite()
        return [{k: v for k, v in t.items() if k not in ("open", "cut")} for t in new]


def walk(t: dict, b: np.ndarray) -> np.ndarray:
    """The node of each row of bins in a tree with cuts by bin."""
    f, cut, left, right = (np.array(t[k], int) for k in ("feature", "cut", "left", "right"))
    missing = np.array(t["missing_left"], bool)
    at = np.zeros(len(b), int)
    while (inner := f[at] >= 0).any():
        r = np.flatnonzero(inner)
        n = at[r]
        v = b[r, f[n]]
        at[r] = np.where(np.where(v == 0, missing[n], v <= cut[n]), left[n], right[n])
    return at


def base_values(rows: DataFrame, loss: str, outputs: int) -> list[float]:
    """Constant outputs to start from: the best ones, of huber the median."""
    if loss != "multinomial":
        mean = rows.agg(F.percentile_approx("y", 0.5, 1000) if loss == "huber" else F.avg("y")).first()[0]
        if mean is None:
            raise ValueError("no row has a target")
        return [float(np.log(mean / (1 - mean))) if loss == "logistic" and 0 < mean < 1 else float(mean)]
    counts = {int(r["y"]): r["count"] for r in rows.groupBy("y").count().collect()}  # as many rows as classes
    return [float(np.log(counts.get(k, 0) + 1e-3)) for k in range(outputs)]


def fit(df: DataFrame, features: list[str], target: str, loss: str = "mse", width: float = 1.0, p: Parameters = Parameters(), most_classes: int = 30) -> Model:
    """A model of the rows that have a target."""
    if loss not in LOSSES:
        raise ValueError(loss)
    classes: list = []
    if loss in ("logistic", "multinomial"):
        classes = sorted(r[0] for r in df.where(F.col(target).isNotNull()).select(target).distinct().limit(most_classes + 1).collect())
        if len(classes) > most_classes:
            raise ValueError(f"more than {most_classes} classes")
        if loss == "logistic" and len(classes) > 2:
            raise ValueError("logistic loss is for two classes")
    rows = prepared(df, features, target, loss, classes)
    outputs = max(1, len(classes)) if loss == "multinomial" else 1
    model = Model(loss, width, list(features), classes, base_values(rows, loss, outputs), bin_edges(df.where(F.col(target).isNotNull()), features, min(p.bins, 253)))
    training, eta = Training(rows, model, p), p.eta
    for i in range(p.trees):
        model.trees += training.grow(i, min(1.0, eta))
        eta *= p.eta_growth
    dropped(training.table)
    return model


def loss_without(model: Model, df: DataFrame, target: str) -> tuple[float, list[float]]:
    """The mean loss over the rows, and that with each tree left out in turn, in one pass."""
    rows = prepared(df, model.features, target, model.loss, model.classes)
    shared, wide = df.sparkSession.sparkContext.broadcast(model), len(model.features)

    def run(batches):
        m = shared.value
        sums, n = np.zeros(1 + len(m.trees)), 0
        for batch in batches:
            x, y = values(batch, wide), batch.column("y").to_numpy()
            whole = m.margins(x)
            sums[0] += losses(m.loss, m.width, whole, y).sum()
            for i, t in enumerate(m.trees):
                less = whole.copy()
                less[:, t["class"]] -= tree_values(t, x)
                sums[1 + i] += losses(m.loss, m.width, less, y).sum()
            n += len(y)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(sums)), pa.int32()), "s": pa.array(sums), "n": pa.array([n] * len(sums), pa.int64())})

    found = rows.mapInArrow(run, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean")).orderBy("i").collect()
    means = [r["mean"] for r in found]
    return means[0], means[1:]


def retrain(model: Model, df: DataFrame, target: str, trees: int | list[int], p: Parameters = Parameters(), keep: float = 0.1) -> Model:
    """The model with some trees grown anew on the rows of df, and all others as they were.

    trees: which ones, or how many, then those whose loss would cost least on these rows.  Each new tree takes its old place and
    eta.  keep: the cost of a squared change of the old model's margin, so that what still holds stays.
    """
    if isinstance(trees, int):
        whole, each = loss_without(model, df, target)
        trees = sorted(np.argsort(np.array(each) - whole, kind="stable")[:trees].tolist())
    outputs = len(model.base)
    rounds = sorted({i // outputs for i in trees})  # of several classes, a round's trees go together
    chosen = tuple(r * outputs + k for r in rounds for k in range(outputs))
    out = replace_trees(model, {})
    training = Training(prepared(df, model.features, target, model.loss, model.classes), model, p, chosen, keep)
    for r in rounds:
        grown = training.grow(r, min(1.0, p.eta * p.eta_growth**r))
        out = replace_trees(out, {r * outputs + k: t for k, t in enumerate(grown)})
    dropped(training.table)
    return out


def replace_trees(model: Model, new: dict[int, dict]) -> Model:
    return replace(model, trees=[new.get(i, t) for i, t in enumerate(model.trees)])


def predict(model: Model, df: DataFrame, name: str = "margins") -> DataFrame:
    """df with the model's outputs, an array: predicted values (of msle, their own scale), log odds or logs of class weights."""
    shared, wide, loss = df.sparkSession.sparkContext.broadcast(model), len(model.features), model.loss  # as large as the model
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in model.features])

    def run(column: pd.Series) -> pd.Series:
        m = shared.value.margins(np.concatenate(column.to_numpy()).astype(float).reshape(-1, wide) if len(column) else np.empty((0, wide)))
        return pd.Series(list(np.expm1(m) if loss == "msle" else m))

    return df.withColumn(name, F.pandas_udf(run, "array<double>")(x))
