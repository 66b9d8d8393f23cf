"""Models for every set of left-out folds, fitted together from the same scans.

Nested stacking needs one model per base and pair of folds. Fitting them one after the other scans the data once per model
and step. Here each step is one scan for all of them: a task holds a block of rows as arrays, adds up what the rows
contribute to each model that may see their fold, and Spark sums these vectors by model. The driver sees sums only:
their size follows from the number of features, bins and models, never from the number of rows.

The blocks are written once and held as arrays by an RDD: fits take hundreds of steps over a few numbers, and what a step costs is
the job, which is a single stage this way. Lost blocks are read again from the table.

* Means, covariances and principal components come from moments kept per fold; a model uses the total without its folds.
* Logistic regression takes Newton steps on summed gradients and curvatures.
* Boosting and the forest sum histograms of binned features, level by level; the forest grows many trees in one pass.
* The perceptron takes full-batch steps.

Bin edges are quantiles of the features of all rows; they use no label. Rows enter samples by a hash of their key, so
a repeated task gives the same sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..session import written

BLOCK_ROWS = 4096
BINS = 32
#: Boosting rounds between two stored margins: what a scan must add up again.
KEPT_ROUNDS = 10
#: Trees of all models whose histograms one pass of the forest sums.
FOREST_BATCH = 50
_U = np.uint64

#: Sums of more tasks than this are first added up on the executors.
DIRECT_TASKS = 32
BLOCKS = "keys array<string>, fold binary, y binary, h binary, x binary, bins binary"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) from row hashes and whole numbers."""
    for s in salt:
        h = _mix(h + _U((s * 0x9E3779B97F4A7C15 + 1) % (1 << 64)))
    return (h >> _U(11)).astype(np.float64) / float(1 << 53)


@dataclass(frozen=True)
class Block:
    """Rows of one block; ``x`` has one row per entry."""

    keys: list[str]
    fold: np.ndarray
    y: np.ndarray
    h: np.ndarray
    x: np.ndarray
    bins: np.ndarray
    margin: np.ndarray | None = None


def _block(row: Row) -> Block:
    n = len(row.keys)
    numbers = (np.frombuffer(row[k + 1], kind) for k, kind in enumerate((np.int32, np.float64, np.uint64)))
    return Block(list(row.keys), *numbers, np.frombuffer(row.x, np.float64).reshape(n, -1), np.frombuffer(row.bins, np.uint8).reshape(n, -1))


Blocks = RDD  # of Block


def pack(rows: DataFrame, positive: str, features: Sequence[str], key: str = "user_id", label: str = "label") -> Blocks:
    """Rows (``key``, ``label``, ``fold``, number columns) as stored blocks of arrays; NULL and NaN count as 0."""
    clean = [F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features]
    flat = rows.select(F.col(key).cast("string").alias("k"), F.col("fold").cast("int"), (F.col(label) == positive).cast("double").alias("y"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.array(*clean).alias("x"))
    names = [f"f{i}" for i in range(len(features))]
    edges = _edges(flat.select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)]), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, BLOCK_ROWS) for i in range(0, len(batch), BLOCK_ROWS)):
                fold, y, h = (part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
                x = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                bins = np.stack([np.searchsorted(e, x[:, i], "left") for i, e in enumerate(edges)], axis=1)
                raw = (fold.astype(np.int32), y.astype(np.float64), h.astype(np.int64), x.astype(np.float64), bins.astype(np.uint8))
                keys = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array([r.tobytes()], pa.binary()) for r in raw)], names=["keys", "fold", "y", "h", "x", "bins"])

    return _held(written(flat.mapInArrow(run, BLOCKS)).rdd.map(_block))


def _held(blocks: Blocks) -> Blocks:
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def _edges(columns: DataFrame, names: list[str]) -> list[np.ndarray]:
    """Different inner quantiles of each feature: ``BINS`` bins at most."""
    got = columns.approxQuantile(names, [k / BINS for k in range(1, BINS)], 0.001)
    return [np.unique(g) if g else np.zeros(0) for g in got]


def _merged(a: dict, b: dict) -> dict:
    for at, v in b.items():
        a[at] = a[at] + v if at in a else v
    return a


def summed(blocks: Blocks, contribute: Callable[[Block], Iterator[tuple[int, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Sum over all blocks of the vectors that ``contribute`` gives for each number (a fold or a model)."""

    def run(held: Iterator[Block]) -> Iterator[dict[int, np.ndarray]]:
        total: dict[int, np.ndarray] = {}
        for block in held:
            _merged(total, dict(contribute(block)))
        yield total

    parts = blocks.mapPartitions(run)
    return parts.reduce(_merged) if parts.getNumPartitions() <= DIRECT_TASKS else parts.treeReduce(_merged)


@dataclass
class Exclusions:
    """The models of a base: one for each set of left-out folds, with class weights from the counts of the others."""

    sets: list[tuple[int, ...]]
    counts: dict[int, tuple[float, float]]  # fold -> rows of the negative and of the positive class

    def rows(self, m: int) -> tuple[float, float]:
        kept = [c for f, c in self.counts.items() if f not in self.sets[m]]
        return sum(c[0] for c in kept), sum(c[1] for c in kept)

    def weights(self, m: int, power: int = 1) -> np.ndarray:
        """Balanced weight n / (2 count) of the negative and the positive class, raised to ``power``."""
        neg, pos = self.rows(m)
        return np.array([(neg + pos) / (2 * max(neg, 1)), (neg + pos) / (2 * max(pos, 1))]) ** power

    def constant(self, m: int) -> float | None:
        neg, pos = self.rows(m)
        return None if neg and pos else float(pos > 0)

    def seen(self, m: int, fold: np.ndarray) -> np.ndarray:
        return ~np.isin(fold, self.sets[m])


def fold_counts(blocks: Blocks) -> dict[int, tuple[float, float]]:
    def count(b: Block) -> Iterator[tuple[int, np.ndarray]]:
        for f in np.unique(b.fold):
            yield int(f), np.array([((b.fold == f) & (b.y == 0)).sum(), ((b.fold == f) & (b.y == 1)).sum()], float)

    return {f: (v[0], v[1]) for f, v in sorted(summed(blocks, count).items())}


def moments(blocks: Blocks) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of products of the features, per fold."""

    def add(b: Block) -> Iterator[tuple[int, np.ndarray]]:
        for f in np.unique(b.fold):
            x = b.x[b.fold == f]
            yield int(f), np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))

    out = {}
    for f, v in summed(blocks, add).items():
        d = int((-1 + np.sqrt(1 + 4 * (len(v) - 1))) / 2)
        out[f] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return out


def standardised(per_fold: dict, left_out: Sequence[int], picked: Sequence[int], groups: Sequence[tuple[Sequence[int], int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Map ``z = x @ a + b`` of a model: columns ``picked`` as they are, each group as its first principal
    components, all with mean 0 and deviation 1 over the rows that the model sees."""
    kept = [m for f, m in per_fold.items() if f not in left_out]
    n = sum(m[0] for m in kept)
    mean = sum(m[1] for m in kept) / n
    cov = (sum(m[2] for m in kept) - n * np.outer(mean, mean)) / max(n - 1, 1)
    parts = []
    for columns, k in groups:
        columns = list(columns)
        _, vectors = np.linalg.eigh(cov[np.ix_(columns, columns)])
        top = vectors[:, ::-1][:, : min(k, int(n) - 1, len(columns))]
        top = top * np.where(top[np.abs(top).argmax(axis=0), np.arange(top.shape[1])] < 0, -1, 1)
        part = np.zeros((len(mean), top.shape[1]))
        part[columns] = top
        parts.append(part)
    own = np.zeros((len(mean), len(picked)))
    own[list(picked), np.arange(len(picked))] = 1
    a = np.hstack([*parts, own])
    spread = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", a, cov, a), 0))
    a = a * np.where(spread > 1e-12, 1 / np.maximum(spread, 1e-12), 0)
    return a, -mean @ a


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


# --- logistic regression -------------------------------------------------------------


@dataclass
class Linear:
    maps: list[tuple[np.ndarray, np.ndarray]]
    beta: list[np.ndarray]

    def score(self, m: int, b: Block) -> np.ndarray:
        a, shift = self.maps[m]
        return sigmoid((b.x @ a + shift) @ self.beta[m][:-1] + self.beta[m][-1])


def fit_linear(blocks: Blocks, ex: Exclusions, maps: list[tuple[np.ndarray, np.ndarray]], c: float = 1.0, steps: int = 60, tolerance: float = 1e-9, power: int = 1) -> Linear:
    """Balanced L2 logistic regression: Newton steps, halved while the mean loss rises. ``1 / (c n)`` is the strength."""
    models = range(len(ex.sets))
    beta = [np.zeros(a.shape[1] + 1) for a, _ in maps]
    before, loss_before = [b.copy() for b in beta], [np.inf] * len(beta)
    weight, open_ = [ex.weights(m, power) for m in models], [m for m in models if ex.constant(m) is None]
    for _ in range(steps):
        if not open_:
            break
        now, active = [b.copy() for b in beta], list(open_)

        def add(b: Block, now=now, active=active) -> Iterator[tuple[int, np.ndarray]]:
            for m in active:
                seen = ex.seen(m, b.fold)
                z = b.x[seen] @ maps[m][0] + maps[m][1]
                z = np.hstack([z, np.ones((len(z), 1))])
                y, w = b.y[seen], weight[m][b.y[seen].astype(int)]
                t = z @ now[m]
                p = sigmoid(t)
                loss = (w * (np.logaddexp(0, t) - y * t)).sum()
                yield m, np.concatenate(([w.sum(), loss], z.T @ (w * (p - y)), (z.T @ (z * (w * p * (1 - p))[:, None])).ravel()))

        for m, v in summed(blocks, add).items():
            q = len(beta[m])
            ridge = np.append(np.full(q - 1, 1 / (c * sum(ex.rows(m)))), 0.0)
            loss = v[1] / v[0] + 0.5 * (ridge * beta[m] ** 2).sum()
            slope = v[2 : 2 + q] / v[0] + ridge * beta[m]
            if np.abs(slope).max() < tolerance:
                open_.remove(m)
            elif loss > loss_before[m] + 1e-12:
                beta[m] = (beta[m] + before[m]) / 2
            else:
                before[m], loss_before[m] = beta[m].copy(), loss
                beta[m] = beta[m] - np.linalg.solve(v[2 + q :].reshape(q, q) / v[0] + np.diag(ridge + 1e-12), slope)
    return Linear(maps, beta)


# --- perceptron ----------------------------------------------------------------------


@dataclass
class Perceptron:
    maps: list[tuple[np.ndarray, np.ndarray]]
    params: list[list[np.ndarray]]

    def score(self, m: int, b: Block) -> np.ndarray:
        w1, b1, w2, b2 = self.params[m]
        return sigmoid(sigmoid((b.x @ self.maps[m][0] + self.maps[m][1]) @ w1 + b1) @ w2 + b2[0])


def fit_perceptron(blocks: Blocks, ex: Exclusions, maps: list[tuple[np.ndarray, np.ndarray]], hidden: int = 32, steps: int = 500, rate: float = 0.01, seed: int = 42) -> Perceptron:
    """One hidden layer without class weights; ``steps`` full-batch Adam steps."""
    params, state = [], []
    for m, (a, _) in enumerate(maps):
        rng = np.random.default_rng((seed, *ex.sets[m]))
        bound = np.sqrt(6 / (a.shape[1] + hidden))
        params.append([rng.uniform(-bound, bound, (a.shape[1], hidden)), np.zeros(hidden), rng.uniform(-bound, bound, hidden), np.zeros(1)])
        state.append([[np.zeros_like(p), np.zeros_like(p)] for p in params[-1]])
    active = [m for m in range(len(maps)) if ex.constant(m) is None]
    for step in range(1, steps + 1):
        now = [[p.copy() for p in ps] for ps in params]

        def add(b: Block, now=now) -> Iterator[tuple[int, np.ndarray]]:
            for m in active:
                seen = ex.seen(m, b.fold)
                w1, b1, w2, b2 = now[m]
                z = b.x[seen] @ maps[m][0] + maps[m][1]
                hid = sigmoid(z @ w1 + b1)
                d = sigmoid(hid @ w2 + b2[0]) - b.y[seen]
                back = d[:, None] * w2 * hid * (1 - hid)
                yield m, np.concatenate(([len(d)], (z.T @ back).ravel(), back.sum(axis=0), hid.T @ d, [d.sum()]))

        for m, v in summed(blocks, add).items():
            at = 1
            for i, p in enumerate(params[m]):
                g = v[at : at + p.size].reshape(p.shape) / v[0]
                at += p.size
                s = state[m][i]
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                params[m][i] = p - rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)
    return Perceptron(maps, params)


# --- trees ---------------------------------------------------------------------------


@dataclass
class Tree:
    """Full binary tree: a node without a split sends all rows left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def node(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """Place of each row among the nodes of a level."""
        at = np.zeros(len(bins), np.int64)
        for level in range(levels):
            inner = (1 << level) - 1 + at
            f = self.feature[inner]
            at = 2 * at + ((f >= 0) & (bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[inner]))
        return at


def _histogram(bins: np.ndarray, node: np.ndarray, nodes: int, values: Sequence[np.ndarray]) -> np.ndarray:
    """Sums of the values by node, feature and bin."""
    d = bins.shape[1]
    cell = ((node[:, None] * d + np.arange(d)) * BINS + bins).ravel()
    return np.stack([np.bincount(cell, np.repeat(v, d), minlength=nodes * d * BINS).reshape(nodes, d, BINS) for v in values])


def _best(gain: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Feature (-1: none above ``least``) and cut of the largest gain of each node."""
    flat = np.round(gain.reshape(len(gain), -1), 9)  # sums in another order must not turn a tie
    best = flat.argmax(axis=1)
    found = flat[np.arange(len(flat)), best] > least
    return np.where(found, best // BINS, -1), np.where(found, best % BINS, 0)


def _sides(running: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the two children of each node, from running sums over bins; without a split all is left."""
    whole = running[:, 0, -1]
    left = np.where(feature >= 0, running[np.arange(len(feature)), np.maximum(feature, 0), cut], whole)
    return left, whole - left


@dataclass
class Boosted:
    trees: list[list[Tree]]
    start: list[float]
    depth: int

    def margin(self, m: int, bins: np.ndarray, first: int = 0) -> np.ndarray:
        out = np.full(len(bins), self.start[m] if first == 0 else 0.0)
        for t in self.trees[m][first:]:
            out += t.value[t.node(bins, self.depth)]
        return out

    def score(self, m: int, b: Block) -> np.ndarray:
        return sigmoid(self.margin(m, b.bins))


def fit_boosted(
    blocks: Blocks, ex: Exclusions, rounds: int = 250, depth: int = 3, rate: float = 0.05, subsample: float = 0.85, columns: float = 0.85, min_leaf: int = 2, ridge: float = 1.0, seed: int = 42
) -> Boosted:
    """Second-order boosting of the balanced logistic loss on histograms; one scan per level of a round serves all models."""
    models = [m for m in range(len(ex.sets)) if ex.constant(m) is None]
    out = Boosted([[] for _ in ex.sets], [0.0] * len(ex.sets), depth)
    weight, inner = [ex.weights(m) for m in range(len(ex.sets))], (1 << depth) - 1
    kept, base, stores = 0, blocks, []
    for r in range(rounds):
        grown = {m: Tree(np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(1 << depth)) for m in models}
        for level in range(depth):
            since, so_far = {m: Boosted([out.trees[m][kept:]], [out.start[m]], depth) for m in models}, dict(grown)

            def add(b: Block, level=level, r=r, since=since, so_far=so_far) -> Iterator[tuple[int, np.ndarray]]:
                taken = uniform(b.h, seed, r) < subsample
                for m in models:
                    rows = np.flatnonzero(ex.seen(m, b.fold) & taken)
                    old = 0.0 if b.margin is None else b.margin[rows, m]
                    p = sigmoid(old + since[m].margin(0, b.bins[rows]))
                    w = weight[m][b.y[rows].astype(int)]
                    node = so_far[m].node(b.bins[rows], level)
                    yield m, _histogram(b.bins[rows], node, 1 << level, (w * (p - b.y[rows]), w * p * (1 - p), np.ones(len(rows))))

            for m, sums in summed(base, add).items():
                allowed = np.random.default_rng((seed, r, m)).permutation(sums.shape[2])[: max(1, int(np.ceil(columns * sums.shape[2])))]
                g, h, n = np.cumsum(sums, axis=3)
                gain = g**2 / (h + ridge) + (g[..., -1:] - g) ** 2 / (h[..., -1:] - h + ridge) - g[..., -1:] ** 2 / (h[..., -1:] + ridge)
                gain = np.where((n >= min_leaf) & (n[..., -1:] - n >= min_leaf), gain, -np.inf)
                tried = np.zeros(gain.shape[1], bool)
                tried[allowed] = True
                feature, cut = _best(np.where(tried[:, None], gain, -np.inf), 1e-9)
                at = slice((1 << level) - 1, (1 << (level + 1)) - 1)
                grown[m].feature[at], grown[m].cut[at] = feature, cut
                if level == depth - 1:
                    (gl, gr), (hl, hr) = _sides(g, feature, cut), _sides(h, feature, cut)
                    grown[m].value = -rate * np.stack([gl, gr], axis=1).ravel() / (np.stack([hl, hr], axis=1).ravel() + ridge)
        for m in models:
            out.trees[m].append(grown[m])
        if (r + 1) % KEPT_ROUNDS == 0 and r + 1 < rounds:
            # The new store adds the rounds since the last one to its margins; that one is held until the new one has been read.
            since = Boosted([t[kept:] for t in out.trees], [0.0] * len(ex.sets) if kept else list(out.start), depth)
            base, kept = _with_margins(base, since), r + 1
            stores.append(base)
            if len(stores) > 2:
                stores[-3].unpersist()
    for held in stores:
        held.unpersist()
    return out


def _with_margins(blocks: Blocks, since: Boosted) -> Blocks:
    """The blocks with the margin of every model, so that later rounds need not add up old trees; ``since`` has the new ones."""

    def add(b: Block) -> Block:
        new = np.stack([since.margin(m, b.bins) for m in range(len(since.trees))], axis=1)
        return replace(b, margin=new if b.margin is None else b.margin + new)

    return _held(blocks.map(add))


@dataclass
class Forest:
    trees: list[list[Tree]]
    depth: int

    def score(self, m: int, b: Block) -> np.ndarray:
        return np.mean([t.value[t.node(b.bins, self.depth)] for t in self.trees[m]], axis=0)


def _poisson(u: np.ndarray) -> np.ndarray:
    """Poisson draws of mean 1: the weights of a bootstrap sample."""
    return np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)])), u, "right").astype(float)


def fit_forest(blocks: Blocks, ex: Exclusions, trees: int = 400, depth: int = 5, min_leaf: int = 10, seed: int = 42) -> Forest:
    """Bootstrapped trees on balanced Gini impurity, a root of the features tried per node.

    Histograms of one level of ``FOREST_BATCH`` trees of all models are summed by Spark, and the splits are chosen where
    the sums are, so only splits reach the driver.
    """
    models = [m for m in range(len(ex.sets)) if ex.constant(m) is None]
    out, inner = Forest([[] for _ in ex.sets], depth), (1 << depth) - 1
    weight = [ex.weights(m) for m in range(len(ex.sets))]
    for first in range(0, trees, FOREST_BATCH):
        last = min(first + FOREST_BATCH, trees)
        grown = {(m, t): Tree(np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(1 << depth)) for m in models for t in range(first, last)}
        for level in range(depth):
            so_far = dict(grown)

            def add(held: Iterator[Block], so_far=so_far, level=level, first=first, last=last) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
                total: dict[tuple[int, int], np.ndarray] = {}
                for b in held:
                    drawn = [_poisson(uniform(b.h, seed, t)) for t in range(first, last)]
                    for m in models:
                        seen = ex.seen(m, b.fold)
                        w = weight[m][b.y.astype(int)]
                        for t, draw in zip(range(first, last), drawn):
                            rows = np.flatnonzero(seen & (draw > 0))
                            n, node = draw[rows], so_far[m, t].node(b.bins[rows], level)
                            _merged(total, {(m, t): _histogram(b.bins[rows], node, 1 << level, (n * w[rows] * (1 - b.y[rows]), n * w[rows] * b.y[rows], n))})
                yield from total.items()

            def choose(item: tuple[tuple[int, int], np.ndarray], level=level) -> tuple:
                (m, t), sums = item
                return m, t, *_gini_splits(sums, min_leaf, np.random.default_rng((seed, m, t, level)))

            tasks = max(1, min(blocks.getNumPartitions(), len(grown)))
            for m, t, feature, cut, value in blocks.mapPartitions(add).reduceByKey(np.add, tasks).map(choose).collect():
                tree, at = grown[m, t], slice((1 << level) - 1, (1 << (level + 1)) - 1)
                tree.feature[at], tree.cut[at] = feature, cut
                if level == depth - 1:
                    tree.value = value
        for (m, _), tree in grown.items():
            out.trees[m].append(tree)
    return out


def _gini_splits(sums: np.ndarray, min_leaf: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1: none) and cut of each node with the largest fall of the weighted Gini impurity, and the positive share of its children."""
    nodes, d = sums.shape[1], sums.shape[2]
    neg, pos, n = np.cumsum(sums, axis=3)
    purity = lambda a, b: (a**2 + b**2) / np.maximum(a + b, 1e-300)
    gain = purity(neg, pos) + purity(neg[..., -1:] - neg, pos[..., -1:] - pos) - purity(neg[..., -1:], pos[..., -1:])
    gain = np.where((n >= min_leaf) & (n[..., -1:] - n >= min_leaf), gain, -np.inf)
    tried = np.argsort(rng.random((nodes, d)), axis=1) < max(1, int(np.ceil(np.sqrt(d))))
    feature, cut = _best(np.where(tried[..., None], gain, -np.inf), 1e-12)
    a, b = np.stack(_sides(neg, feature, cut), axis=1).ravel(), np.stack(_sides(pos, feature, cut), axis=1).ravel()
    return feature, cut, np.where(a + b > 1e-9, b / np.maximum(a + b, 1e-9), 0.5)


# --- nested stacking -----------------------------------------------------------------


@dataclass(frozen=True)
class Base:
    """A base model over packed features: columns taken as they are, and groups reduced to principal components."""

    model_id: str
    family: str
    columns: tuple[int, ...]
    groups: tuple[tuple[tuple[int, ...], int], ...] = ()
    params: dict = field(default_factory=dict)
    seed: int = 42


def _restricted(b: Block, columns: Sequence[int]) -> Block:
    """Trees look at the bins of their own columns alone; keys and entries would be sent to every step for nothing."""
    return replace(b, keys=[], x=np.zeros((len(b.fold), 0)), bins=np.ascontiguousarray(b.bins[:, list(columns)]))


def fit_base(blocks: Blocks, ex: Exclusions, base: Base, per_fold: dict):
    """All models of one base, one per set of left-out folds."""
    p = base.params
    if base.family in ("logreg", "mlp"):
        maps = [standardised(per_fold, left_out, base.columns, base.groups) for left_out in ex.sets]
        if base.family == "logreg":
            return fit_linear(blocks, ex, maps, c=float(p.get("c", 1.0)))
        return fit_perceptron(blocks, ex, maps, hidden=int(p.get("hidden", 32)), steps=int(p.get("max_iter", 500)), seed=base.seed)
    if base.family not in ("boost", "trees"):
        raise ValueError(f"unsupported family: {base.family}")
    narrow = _held(blocks.map(lambda b: _restricted(b, base.columns)))
    try:
        if base.family == "boost":
            return fit_boosted(
                narrow, ex, int(p.get("rounds", 250)), int(p.get("max_depth", 3)), float(p.get("learning_rate", 0.05)), float(p.get("subsample", 0.85)), float(p.get("columns", 0.85)), int(p.get("min_leaf", 2)), seed=base.seed
            )
        return fit_forest(narrow, ex, int(p.get("trees", 400)), int(p.get("max_depth", 5)), int(p.get("min_leaf", 10)), base.seed)
    finally:
        narrow.unpersist()


def nested_scores(spark: SparkSession, blocks: Blocks, bases: Sequence[Base], meta_c: float = 1.0) -> tuple[DataFrame, list[tuple]]:
    """Scores of strict nested stacking (``key, fold, y, score``) and the provenance of every base model.

    A base model leaves two folds out. A row of fold f has, for every other fold g, the scores of the models without f and g: the
    meta model of outer fold g learns from them; the mean over g is what the meta model of outer fold f scores.
    """
    counts = fold_counts(blocks)
    folds = sorted(counts)
    ex = Exclusions(list(combinations(folds, 2)), counts)
    per_fold = moments(blocks)
    # The fits do not depend on each other: the steps of one fill the gaps of the others.
    with ThreadPoolExecutor(len(bases)) as pool:
        fitted = list(pool.map(lambda base: fit_base(blocks, ex, base, per_fold), bases))
    at, k = {s: m for m, s in enumerate(ex.sets)}, len(bases)

    def combine(b: Block) -> Block:
        x = np.zeros((len(b.fold), len(folds), k))
        for j, (base, model) in enumerate(zip(bases, fitted)):
            seen = b if base.family in ("logreg", "mlp") else _restricted(b, base.columns)
            for (f, g), m in at.items():
                constant = ex.constant(m)
                score = np.full(len(b.fold), constant) if constant is not None else model.score(m, seen)
                for own, other in ((f, g), (g, f)):
                    rows = b.fold == own
                    x[rows, folds.index(other), j] = score[rows]
                    x[rows, folds.index(own), j] += score[rows] / (len(folds) - 1)
        return replace(b, x=x.reshape(len(x), -1), bins=np.zeros((len(x), 0), np.uint8))

    stacked = _held(blocks.map(combine))
    outer = Exclusions([(f,) for f in folds], counts)
    meta_moments = moments(stacked)
    maps = [standardised(meta_moments, (f,), range(i * k, (i + 1) * k)) for i, f in enumerate(folds)]
    meta = fit_linear(stacked, outer, maps, c=meta_c)

    def final(b: Block) -> Iterator[tuple]:
        score = np.zeros(len(b.fold))
        for m, f in enumerate(folds):
            constant, rows = outer.constant(m), b.fold == f
            score[rows] = constant if constant is not None else meta.score(m, b)[rows]
        return zip(b.keys, b.fold.tolist(), b.y.tolist(), score.tolist())

    records = [
        (o, i, base.model_id, [f for f in folds if f not in (o, i)]) for o in folds for base in bases for i in folds if i != o
    ]
    return spark.createDataFrame(stacked.flatMap(final), "key string, fold int, y double, score double"), records
