"""Gradient-boosted trees with pluggable losses, stopped on validation rows.

One Newton boosting loop serves every loss (logistic, Tweedie, squared, Cox partial likelihood).
The rows stay distributed: they are binned once, written, and kept as one block of arrays per task in the
executors' storage (on disk where memory ends); beside them a fit keeps its scores only.  A level of a tree is one pass: every task sums gradients and hessians of
its rows per (node, feature, bin) with numpy, counting by the joint bin of several features at once, and the sums meet in one shuffle dealt by ranges of features, and the best split
of every node in each range is found there.  The driver receives one candidate per (node, range), whatever the number of rows and bins, and
sends the tree along with the next pass.  Starting a task costs more than summing some ten thousand rows, so blocks are large and ranges few:
fits that run side by side share the cores.  The first pass of a round adds the last tree to the scores and keeps them;
every ``CHECKPOINT`` rounds they are written, so a lost executor repeats a bounded number of trees.

The Cox loss needs the risk sets: one more pass a round sums exp(score) per distinct
duration (whole days, so that table is bounded by the calendar).

Fitting stops when the validation loss has not fallen for ``patience`` rounds, and the model is cut
at its best round.  ``history`` holds both losses of every round.  A fitted model is
plain data (``to_json`` / ``from_json``).

Defined cases: NULL and NaN inputs fall into the lowest bin; a category index outside
0 .. cardinality - 1 counts as the last one; rows with a NULL label are left out of the fit
(``n_rows`` tells how many were used); without validation rows all rounds are kept; a training set without
rows raises ValueError.
"""

from __future__ import annotations

import json
import math
import threading
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.session import checkpoint_dir, materialize

#: Rounds after which the scores are written.
CHECKPOINT = 32
#: Rows of a block: no fewer than the first while there are cores to spare, no more than the second.
FEW_ROWS, PART_ROWS = 1 << 17, 1 << 19
#: Cells (node, joint bin of a group of features) into which the rows of a block are summed at once: what a core's cache holds.
CELLS = 1 << 15
#: Blocks for which one more range of features is made for the choice of the splits.
MERGE_BLOCKS = 8
LIMIT = 30.0                  # scores of a log or logit link stay within +- LIMIT


# ---- losses: gradient and hessian in the score f, value per row, prediction ----

class Logistic:
    def start(self, mean):
        p = min(max(mean, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def grad(self, y, f):
        p = 1.0 / (1.0 + np.exp(-f))
        return p - y, np.maximum(p * (1.0 - p), 1e-12)

    def value(self, y, f):
        return np.logaddexp(0.0, f) - y * f

    def predict(self, f):
        return 1.0 / (1.0 + np.exp(-f))


class Squared:
    def start(self, mean):
        return mean

    def grad(self, y, f):
        return f - y, np.ones_like(f)

    def value(self, y, f):
        return (f - y) ** 2

    def predict(self, f):
        return f


class Tweedie:
    """Compound Poisson-gamma deviance with log link; 1 < power < 2."""

    def __init__(self, power: float = 1.5):
        if not 1.0 < power < 2.0:
            raise ValueError("the variance power lies between 1 and 2")
        self.power = power

    def start(self, mean):
        return math.log(max(mean, 1e-9))

    def grad(self, y, f):
        a, b = np.exp((1.0 - self.power) * f), np.exp((2.0 - self.power) * f)
        return b - y * a, (2.0 - self.power) * b + (self.power - 1.0) * y * a

    def value(self, y, f):
        p = self.power
        return 2.0 * (y ** (2 - p) / ((1 - p) * (2 - p)) - y * np.exp((1 - p) * f) / (1 - p) + np.exp((2 - p) * f) / (2 - p))

    def predict(self, f):
        return np.exp(f)


class Cox:
    """Negative log partial likelihood (Breslow ties) per event; the score is the log relative risk.
    Gradients need the cumulative hazard at every row's duration, ``hazard`` (days, values), set in each round."""

    hazard = None

    def start(self, mean):
        return 0.0

    def grad(self, y, f, days, t):
        known, values = self.hazard
        at = np.searchsorted(known, days, side="right") - 1
        risk = np.exp(f) * np.where(at >= 0, values[np.maximum(at, 0)], 0.0)[t]
        return risk - y, np.maximum(risk, 1e-12)

    def predict(self, f):
        return f


def make_loss(name: str, power: float = 1.5):
    return {"logistic": Logistic, "squared": Squared, "cox": Cox}[name]() if name != "tweedie" else Tweedie(power)


# ---- trees over bins ----

def _left(split, width: int) -> np.ndarray:
    """Whether each bin goes left: bins up to a number, or a list of bins."""
    go = np.zeros(width, bool)
    go[:split + 1 if isinstance(split, int) else 0] = True
    if not isinstance(split, int):
        go[split] = True
    return go


def _route(tree: dict, x: np.ndarray, widths: list[int]) -> np.ndarray:
    """The node (heap order) at which each row ends; ``x`` holds one line of bins per feature."""
    n = x.shape[1]
    node = np.zeros(n, np.int64)
    if not tree["splits"]:
        return node
    size, wide = 2 * max(map(int, tree["splits"])) + 3, max(widths)
    feature, go = np.full(size, -1), np.zeros((size, wide), bool)
    for i, (j, split) in tree["splits"].items():
        feature[int(i)] = j
        go[int(i), :widths[j]] = _left(split, widths[j])
    rows, flat, go = np.arange(n), x.ravel(), go.ravel()
    for _ in range((size // 2).bit_length()):
        j = feature[node]
        left = go[node * wide + flat[np.maximum(j, 0) * n + rows]]
        node = np.where(j >= 0, 2 * node + 2 - left, node)
    return node


def _groups(widths: list[int], cells: int) -> list[list[int]]:
    """Features in groups whose joint bins are at most ``cells``, wide ones first; a feature with more stands alone."""
    out: list = []
    for j in sorted(range(len(widths)), key=lambda j: -widths[j]):
        fits = [g for g in out if g[0] * widths[j] <= cells]
        if fits:
            g = max(fits, key=lambda g: g[0])
            g[0] *= widths[j]
            g[1].append(j)
        else:
            out.append([widths[j], [j]])
    return [js for _, js in out]


def _add(trees: list[dict], x: np.ndarray, widths: list[int], f: np.ndarray) -> np.ndarray:
    for t in trees:
        values = np.zeros(1 << (t["depth"] + 1))
        values[[int(k) for k in t["values"]]] = list(t["values"].values())
        f = f + values[_route(t, x, widths)]
    return f


def _bins(cols: list[np.ndarray], edges: list, widths: list[int]) -> np.ndarray:
    """One line of bins per feature."""
    out = np.zeros((len(cols), len(cols[0]) if cols else 0), np.uint8 if max(widths, default=0) <= 256 else np.uint16)
    for j, (c, e) in enumerate(zip(cols, edges)):
        c = np.asarray(c, float)
        if e is None:                       # a category index
            out[j] = np.where(np.isfinite(c) & (c >= 0) & (c < widths[j]), c, widths[j] - 1).astype(np.uint16)
        else:
            out[j] = np.where(np.isnan(c), 0, np.searchsorted(np.asarray(e, float), c, side="left"))
    return out


@dataclass
class BoostedTrees:
    """A fitted model: plain data."""
    loss: str
    power: float
    cols: list[str]
    edges: list                 # per feature: upper edges of the bins but the last, or None for a category index
    widths: list[int]
    scale: float
    start: float
    trees: list[dict] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    best_round: int = 0
    stopped: bool = False
    n_rows: int = 0
    params: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "BoostedTrees":
        return cls(**json.loads(text))

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with the prediction (a probability, amount, value or log risk) as ``out``, never NULL."""
        loss, edges, widths, trees, start, scale = make_loss(self.loss, self.power), self.edges, self.widths, self.trees, self.start, self.scale
        clip = self.loss != "squared"

        def predict(*cols: pd.Series) -> pd.Series:
            x = _bins([c.to_numpy(float, na_value=np.nan) for c in cols], edges, widths)
            f = _add(trees, x, widths, np.full(x.shape[1], start))
            return pd.Series(loss.predict(np.clip(f, -LIMIT, LIMIT) if clip else f) * scale)

        return df.withColumn(out, F.pandas_udf(predict, "double")(*[F.col(c).cast("double") for c in self.cols]))

    def importance(self) -> dict[str, float]:
        """Share of the total gain by input."""
        gain = dict.fromkeys(self.cols, 0.0)
        for t in self.trees:
            for i, (feature, _) in t["splits"].items():
                gain[self.cols[feature]] += t["gains"][i]
        total = sum(gain.values()) or 1.0
        return {c: g / total for c, g in gain.items()}

    def rounds(self, name: str, spark) -> DataFrame:
        """One row per round: model, round, train_loss, val_loss, kept."""
        rows = [(name, h["round"], h["train"], h["val"], h["round"] <= self.best_round) for h in self.history]
        return spark.createDataFrame(rows, "model string, round long, train_loss double, val_loss double, kept boolean")


# ---- fitting ----

class Pace:
    """The rounds that a fit has found worth keeping so far, for fits of as many rounds: these grow along with it and never beyond."""

    def __init__(self):
        self._news, self._rounds, self._ended = threading.Condition(), 0, False

    def tell(self, rounds: int = 0, ended: bool = False) -> None:
        with self._news:
            self._rounds, self._ended = max(self._rounds, rounds), self._ended or ended
            self._news.notify_all()

    def reaches(self, rounds: int) -> bool:
        """Whether that many rounds are kept, as soon as it is known."""
        with self._news:
            self._news.wait_for(lambda: self._ended or self._rounds >= rounds)
            return self._rounds >= rounds


def _quantile_edges(train: DataFrame, cols: list[str], max_bins: int) -> list[list[float]]:
    """Least value and distinct approximate quantiles of each column, one aggregate of bounded summaries."""
    if not cols:
        return []
    probs = [0.0, *[i / max_bins for i in range(1, max_bins)]]
    got = train.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10_000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return [sorted({float(v) for v in (q or []) if v is not None and v == v}) for q in got]


@dataclass
class Prepared:
    """Rows ready for any number of fits: the empty model with their bins, and their blocks in the executors' storage.
    A block is (number, sides); a side is (validation?, label, days, index of the row's day, bins)."""
    model: BoostedTrees
    blocks: RDD

    def release(self):
        self.blocks.unpersist()


def _kept(rows: RDD) -> RDD:
    """Kept in the executors' storage, every element by itself, so that ``zip`` of two takes them as they are."""
    return rows._reserialize(BatchedSerializer(CPickleSerializer(), 1)).persist(StorageLevel.MEMORY_AND_DISK)


class _Fit:
    """The rows' scores beside the blocks, and one pass over both."""

    def __init__(self, ready: Prepared, model: BoostedTrees, loss, base: list[dict]):
        self.model, self.loss, self.rounds, self.last = model, loss, 0, None
        self.tasks = max(1, min(1 + ready.blocks.getNumPartitions() // MERGE_BLOCKS, len(model.cols)))
        self.blocks = ready.blocks
        start, widths = model.start, model.widths

        def scored(block):
            return [_add(base, side[4], widths, np.full(len(side[1]), start)) for side in block[1]]

        self.data = _kept(ready.blocks.map(scored))

    def add(self, tree: dict):
        """Scores with one more tree, kept from the next pass on."""
        widths = self.model.widths

        def grown(both):
            (_, sides), scores = both
            return [_add([tree], side[4], widths, f) for side, f in zip(sides, scores)]

        self.last, self.rounds = self.data, self.rounds + 1
        self.data = _kept(self.blocks.zip(self.last).map(grown))
        if self.rounds % CHECKPOINT == 0:
            self.data.checkpoint()

    def release(self):
        for d in (self.last, self.data):
            if d is not None:
                d.unpersist()

    def _merged(self, partial, merge, deal, pick=list) -> list:
        """``partial`` of every block gives (key, value); ``merge(key, values in the order of the blocks)`` gives a result per key,
        ``pick`` what is told of those of a task, in the order of their keys; ``deal(key)`` is the number of a key's task."""
        def merged(pairs):
            got: dict = {}
            for k, v in pairs:
                got.setdefault(k, []).append(v)
            return pick((k, merge(k, [x for _, x in sorted(got[k], key=lambda e: e[0])])) for k in sorted(got))

        def told(both):
            (pid, sides), scores = both
            return [(k, (pid, v)) for k, v in partial([(*side, f) for side, f in zip(sides, scores)])]

        out = self.blocks.zip(self.data).flatMap(told) \
            .partitionBy(self.tasks, deal).mapPartitions(merged).collect()
        if self.last is not None:
            self.last.unpersist()
            self.last = None
        return out

    def _clipped(self):
        return (lambda f: np.clip(f, -LIMIT, LIMIT)) if self.model.loss != "squared" else (lambda f: f)

    def splits(self, tree: dict, level: int, open_: list[int], with_loss: bool, l2: float, min_rows: int):
        """(the best split (gain, feature, split, left sums, right sums) of each open node that has one, {val: (loss, rows)})."""
        loss, widths, edges, cox, clipped = self.loss, self.model.widths, self.model.edges, isinstance(self.loss, Cox), self._clipped()
        first, nodes = (1 << level) - 1, 1 << level

        def partial(sides):
            told = np.zeros((2, 2))
            for v, y, days, t, x, f in sides:
                f = clipped(f)
                if with_loss and not cox:
                    told[int(v)] += loss.value(y, f).sum(), len(y)
                if v:
                    continue
                node = _route(tree, x, widths) - first
                use = node >= 0
                use = slice(None) if use.all() else np.flatnonzero(use)
                g, h = loss.grad(y, f, days, t) if cox else loss.grad(y, f)
                node, g, h = node[use], g[use], h[use]
                for js in _groups(widths, min(CELLS, len(node)) // nodes):
                    cell, size = node, nodes
                    for j in js:
                        cell, size = cell * widths[j] + x[j][use], size * widths[j]
                    sums = np.stack([np.bincount(cell, k, size) for k in (g, h)] + [np.bincount(cell, minlength=size)])
                    sums = sums.reshape(3, nodes, *[widths[j] for j in js])
                    for i, j in enumerate(js):
                        yield j, sums.sum(axis=tuple(2 + k for k in range(len(js)) if k != i))
            if with_loss and not cox:
                yield -1, told

        def merge(j, parts):
            total = parts[0]
            for p in parts[1:]:
                total = total + p
            if j < 0:
                return total
            g, h, n = total.reshape(3, nodes, widths[j])
            return {i: _best_split(g[i - first], h[i - first], n[i - first], edges[j] is None, l2, min_rows) for i in open_}

        def pick(results):
            best = {}
            for j, found in results:
                if j < 0:
                    yield j, found
                    continue
                for i, s in found.items():
                    if s is not None:
                        best[i] = _better(best.get(i), (s[0], j, *s[1:]))
            yield from best.items()

        tasks, n_cols = self.tasks, len(widths)
        told, best = np.zeros((2, 2)), {}
        for i, s in self._merged(partial, merge, lambda j: max(j, 0) * tasks // n_cols, pick):   # ranges in the order of the features
            if i < 0:
                told = s
            else:
                best[i] = _better(best.get(i), s)
        return best, {v: (float(told[int(v)][0]), float(told[int(v)][1])) for v in (False, True)}

    def risk(self):
        """Cox: sets the hazard of the training rows; returns {val: negative log partial likelihood per event}."""
        tasks, clipped = self.tasks, self._clipped()

        def partial(sides):
            for v, y, days, t, _, f in sides:
                f = clipped(f)
                sums = np.stack([np.bincount(t, k, len(days)) for k in (np.exp(f), y, y * f)])
                for k in range(tasks):
                    at = days % tasks == k
                    if at.any():
                        yield 2 * k + int(v), (days[at], sums[:, at])

        def merge(_, parts):
            days, at = np.unique(np.concatenate([d for d, _ in parts]), return_inverse=True)
            sums = np.concatenate([s for _, s in parts], axis=1)
            return days, np.stack([np.bincount(at, s, len(days)) for s in sums])

        got, out = self._merged(partial, merge, lambda k: k // 2), {}
        for side in (False, True):
            mine = [v for k, v in got if k % 2 == side]
            days = np.concatenate([d for d, _ in mine]) if mine else np.zeros(0, np.int64)
            order = np.argsort(days, kind="stable")
            r, d, s = np.concatenate([x for _, x in mine], axis=1)[:, order] if mine else np.zeros((3, 0))
            at_risk = r[::-1].cumsum()[::-1]
            out[side] = float(((d * np.log(np.maximum(at_risk, 1e-300))).sum() - s.sum()) / max(d.sum(), 1.0))
            if not side:
                self.loss.hazard = (days[order], np.cumsum(d / np.maximum(at_risk, 1e-300)))
        return out


def _better(a, b):
    """The split with more gain; of two that differ by rounding only, the first."""
    return b if a is None or b[0] > a[0] + 1e-12 else a


def _best_split(g, h, n, category: bool, l2: float, min_rows: int):
    """(gain, split, left sums, right sums) of one feature in one node, or None."""
    order = None
    if category:                        # categories in the order of their mean step
        with np.errstate(divide="ignore", invalid="ignore"):
            order = np.argsort(g / (h + l2), kind="stable")
        g, h, n = g[order], h[order], n[order]
    cg, ch, cn = np.cumsum(g), np.cumsum(h), np.cumsum(n)
    if len(cg) < 2:
        return None
    lg, lh, ln = cg[:-1], ch[:-1], cn[:-1]
    rg, rh, rn = cg[-1] - lg, ch[-1] - lh, cn[-1] - ln
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = lg ** 2 / (lh + l2) + rg ** 2 / (rh + l2) - cg[-1] ** 2 / (ch[-1] + l2)
    gain = np.where((ln >= min_rows) & (rn >= min_rows), gain, -np.inf)
    k = int(np.argmax(gain))
    if not gain[k] > 1e-12:
        return None
    split = k if order is None else sorted(int(b) for b in order[:k + 1])
    return float(gain[k]), split, (float(lg[k]), float(lh[k])), (float(rg[k]), float(rh[k]))


def prepare(train: DataFrame, val: DataFrame | None, cols, label: str, loss: str = "logistic", *, categories: dict[str, int] | None = None,
            duration: str | None = None, power: float = 1.5, max_bins: int = 64, like: BoostedTrees | None = None) -> Prepared:
    """Bin the rows once for one or more calls of ``fit``; ``like`` gives the bins of a fitted model instead of new ones."""
    cols, categories = list(cols), categories or {}
    if like is not None:
        model = BoostedTrees(like.loss, like.power, like.cols, like.edges, like.widths, like.scale, like.start, n_rows=like.n_rows)
    else:
        numbers = [c for c in cols if c not in categories]
        edges = dict(zip(numbers, _quantile_edges(train, numbers, max_bins)))
        stat = train.where(F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double")), F.count("*")).first()
        if not stat[1]:
            raise ValueError("no training rows")
        scale = (stat[0] or 1.0) if loss == "tweedie" else 1.0
        model = BoostedTrees(loss, power, cols, [edges.get(c) for c in cols],
                             [max(2, categories[c]) if c in categories else len(edges[c]) + 1 for c in cols], scale,
                             make_loss(loss, power).start(stat[0] / scale), n_rows=stat[1])
    return Prepared(model, _blocks(train, val, model, label, duration))


def fit(train: DataFrame, val: DataFrame | None, cols, label: str, loss: str = "logistic", *, categories: dict[str, int] | None = None,
        duration: str | None = None, power: float = 1.5, rounds: int = 1000, patience: int = 20, rate: float = 0.1, depth: int = 4,
        l2: float = 1.0, min_rows: int = 5, max_bins: int = 64, max_step: float = 4.0, begin: BoostedTrees | None = None, prepared: Prepared | None = None,
        tells: Pace | None = None, follows: Pace | None = None) -> BoostedTrees:
    """Fit on ``train``, stop on ``val``.

    ``categories`` gives the cardinality of the inputs that are category indices.  ``label`` is the event for the Cox loss,
    whose ``duration`` is in whole days.  ``begin`` continues a fitted model on the same data: its bins and trees are kept
    and ``rounds`` counts the rounds added.  ``prepared`` gives the rows of ``train`` and ``val`` as ``prepare`` left them.
    ``tells`` is told the rounds worth keeping as they are found; a fit that ``follows`` one takes as many (``rounds`` at most).
    """
    try:
        return _fitted(train, val, cols, label, loss, categories, duration, power, rounds, patience, rate, depth, l2, min_rows, max_bins,
                       max_step, begin, prepared, tells, follows)
    finally:
        if tells is not None:
            tells.tell(ended=True)


def _fitted(train, val, cols, label, loss, categories, duration, power, rounds, patience, rate, depth, l2, min_rows, max_bins, max_step,
            begin, prepared, tells, follows) -> BoostedTrees:
    ready = prepared or prepare(train, val, cols, label, loss, categories=categories, duration=duration, power=power, max_bins=max_bins,
                                like=begin)
    model = BoostedTrees.from_json((begin or ready.model).to_json())
    if begin is None:
        model.power = power
    else:
        model.trees = model.trees[:model.best_round]
        model.history = model.history[:model.best_round + 1]
    model.params = {"rate": rate, "depth": depth, "l2": l2, "patience": patience, "rounds": rounds, "min_rows": min_rows}
    run = _Fit(ready, model, make_loss(loss, power), list(model.trees))
    try:
        _grow(run, model, val is not None, rounds, patience, rate, depth, l2, min_rows, max_step, tells, follows)
    finally:
        run.release()
        if prepared is None:
            ready.release()
    return model


def _grow(run: _Fit, model: BoostedTrees, has_val: bool, rounds: int, patience: int, rate: float, depth: int, l2: float,
          min_rows: int, max_step: float, tells: Pace | None, follows: Pace | None) -> None:
    """Trees up to the best round of the validation rows."""
    cox, known = isinstance(run.loss, Cox), len(model.trees)
    best, best_round = math.inf, known
    for r in range(known, known + rounds + 1):
        told = run.risk() if cox else None
        tree = {"depth": depth, "splits": {}, "values": {}, "gains": {}}
        nodes, open_ = {0: None}, [0]
        for level in range(depth):
            found, said = run.splits(tree, level, open_, level == 0, l2, min_rows)
            if level == 0:
                if not cox:
                    told = {k: (v[0] / v[1] if v[1] else float("nan")) for k, v in said.items()}
                if len(model.history) <= r:
                    model.history.append({"round": r, "train": told[False], "val": told[True] if has_val else None})
                now = told[True] if has_val else -r
                if now < best - 1e-9:
                    best, best_round = now, r
                    if tells is not None:
                        tells.tell(r)
                if r - best_round >= patience or r == known + rounds or (follows is not None and not follows.reaches(r + 1)):
                    model.stopped = r - best_round >= patience
                    open_ = []
                    break
            after = []
            for i in open_:
                if i not in found:
                    continue
                gain, j, split, lo, hi = found[i]
                tree["splits"][str(i)], tree["gains"][str(i)] = [j, split], gain
                for k, (sg, sh) in ((2 * i + 1, lo), (2 * i + 2, hi)):
                    nodes[k] = float(np.clip(-sg / (sh + l2), -max_step, max_step))
                    after.append(k)
            open_ = after
            if not open_:
                break
        if not tree["splits"]:
            break
        leaves = [k for k in nodes if str(k) not in tree["splits"]]
        tree["values"] = {str(k): rate * nodes[k] for k in leaves if nodes[k] is not None}
        model.trees.append(tree)
        run.add(tree)
    model.best_round = min(best_round, len(model.trees))
    model.trees = model.trees[:model.best_round]
    if follows is not None:
        model.params["rounds"] = model.best_round


def _blocks(train: DataFrame, val: DataFrame | None, model: BoostedTrees, label: str, duration: str | None) -> RDD:
    """The binned rows, written in small pieces and gathered into one block per task."""
    def side(df, v):
        return df.where(F.col(label).isNotNull()).select(
            (F.col(label).cast("double") / model.scale).alias("y"),
            (F.col(duration).cast("long") if duration else F.lit(0).cast("long")).alias("t"), F.lit(v).alias("v"),
            *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(model.cols)])
    edges, widths, n = model.edges, model.widths, len(model.cols)

    def pack(batches):
        for b in batches:
            if b.num_rows:
                x = _bins([b.column(f"c{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(n)], edges, widths)
                y, t = b.column("y").to_numpy(zero_copy_only=False), b.column("t").to_numpy(zero_copy_only=False)
                yield pa.record_batch([pa.array([b.num_rows], pa.int64()), pa.array([b.column("v")[0].as_py()]),
                                       *[pa.array([a.tobytes()], pa.binary()) for a in (y.astype(float), t.astype(np.int64), x)]],
                                      names=["n", "v", "y", "t", "x"])

    def block(pid, rows):
        parts: dict = {False: [], True: []}
        for r in rows:
            parts[r.v].append((np.frombuffer(r.y), np.frombuffer(r.t, np.int64), np.frombuffer(r.x, kind).reshape(n, r.n)))
        sides = []
        for v, p in parts.items():
            if p:
                days, at = np.unique(np.concatenate([t for _, t, _ in p]), return_inverse=True)
                sides.append((v, np.concatenate([y for y, _, _ in p]), days, at.astype(np.int32), np.concatenate([x for _, _, x in p], axis=1)))
        yield pid, sides

    kind = np.uint8 if max(widths, default=0) <= 256 else np.uint16
    sides = [side(train, False)] + ([side(val, True)] if val is not None else [])
    packed = [d.mapInArrow(pack, "n long, v boolean, y binary, t binary, x binary") for d in sides]
    pieces = materialize(packed[0] if val is None else packed[0].unionByName(packed[1]))
    checkpoint_dir(pieces.sparkSession)
    rows, cores = pieces.agg(F.sum("n")).first()[0] or 0, pieces.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-rows // FEW_ROWS))
    if tasks > cores:
        tasks = cores * -(-rows // (cores * PART_ROWS))
    return _kept(pieces.repartition(tasks).rdd.mapPartitionsWithIndex(block))
