"""Decision trees from label histograms: many trees, columns and folds in one job.

Columns are cut into equal-frequency bins once.  A split needs no more than the
label sums by bin, so

* :func:`single_feature_scores` grows a tree on every column alone (H1, H2, F15):
  one pass sums labels by (feature, fold, bin), and each feature's trees, leaves
  and scores follow from its own small table;
* :class:`Forests` scores many column subsets (X1, X3, X5): all trees of all
  subsets and folds grow together, one histogram pass for each level, so the
  number of jobs depends on the depth, not on the candidates;
* :func:`boost` grows second-order boosted trees with an evaluation set (L4).

With label sums G and weights H a split is judged by
``G_l^2 / (H_l + l2) + G_r^2 / (H_r + l2)``; for l2 = 0 that orders splits as the
variance does, and for a 0/1 label as the Gini impurity does.  Ties go to the
earlier column, then to the lower bin.  Missing values (null or NaN) have a bin of
their own and go to the side that judges better.

Bags are Poisson weights from a hash of the row's key and the tree's number, so
they do not depend on the partition layout.  Sums over tasks are added in the
order of the tasks' own partial sums, which may differ in the last bits between
layouts; labels that are whole numbers give the same trees everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import stats as ST

MISSING = -1


# --- bins ---------------------------------------------------------------------------

def inner_cuts(df: DataFrame, cols, bins: int) -> list[np.ndarray]:
    """The cut points of each column between its bins (equal frequency, repeated ones dropped)."""
    edges = ST.quantile_edges(df, cols, bins)
    return [np.array(edges[c][1:-1], float) for c in cols]


def coded(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin numbers: how many cuts lie below the value; ``MISSING`` for NaN."""
    return np.where(np.isnan(x), MISSING, np.searchsorted(cuts, x, side="left"))


# --- one split ------------------------------------------------------------------------

def best_split(g: np.ndarray, h: np.ndarray, l2: float = 0.0, min_child: float = 0.0, min_gain: float = 0.0):
    """Best split of each node; ``g`` and ``h`` are (nodes, features, 1 + bins), the first bin holding missing values.

    Returns ``feature, bin, missing_left, g_left, h_left, g, h``; feature -1
    where no split gains anything.  Rows with a bin up to ``bin`` go left.
    """
    total_g, total_h = g[:, :1].sum(axis=2), h[:, :1].sum(axis=2)                     # (nodes, 1)
    low_g, low_h = np.cumsum(g[:, :, 1:], axis=2), np.cumsum(h[:, :, 1:], axis=2)
    left_g = np.stack([low_g + g[:, :, :1], low_g], axis=3)                           # missing values left, right
    left_h = np.stack([low_h + h[:, :, :1], low_h], axis=3)
    right_g, right_h = total_g[:, :, None, None] - left_g, total_h[:, :, None, None] - left_h
    few = 1e-9 * np.maximum(total_h, 1e-300)[:, :, None, None]
    may = (h[:, :, 1:] > 0)[..., None] & (left_h > few) & (right_h > few) & (left_h >= min_child) & (right_h >= min_child)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(may, left_g ** 2 / (left_h + l2) + right_g ** 2 / (right_h + l2), -np.inf)
        parent = np.where(total_h > 0, total_g ** 2 / (total_h + l2), 0.0)[:, 0]
    flat = score.reshape(len(score), -1)
    at = flat.argmax(axis=1)
    nodes = np.arange(len(at))
    best = flat[nodes, at]
    feature, b, side = np.unravel_index(at, score.shape[1:])
    good = best > parent * (1 + 1e-12) + 2 * min_gain
    return (np.where(good, feature, -1), b, side == 0, left_g[nodes, feature, b, side], left_h[nodes, feature, b, side],
            total_g[:, 0], total_h[:, 0])


@dataclass
class Tree:
    """Nodes in heap order: children of ``i`` are ``2 i + 1`` (left) and ``2 i + 2``."""

    depth: int
    feature: np.ndarray = None
    bin: np.ndarray = None
    missing_left: np.ndarray = None
    value: np.ndarray = None

    def __post_init__(self):
        if self.feature is None:
            size = (2 << self.depth) - 1
            self.feature, self.bin = np.full(size, -1), np.zeros(size, int)
            self.missing_left, self.value = np.zeros(size, bool), np.zeros(size)

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node in which each row of codes ends."""
        inner = np.flatnonzero(self.feature >= 0)
        node = np.zeros(len(codes), np.intp)
        if not len(inner):
            return node
        # Where a node sends each code (missing ones first); leaves send all to themselves.
        width = int(self.bin[inner].max()) + 3
        after = np.repeat(np.arange(len(self.feature))[:, None], width, axis=1)
        left = np.arange(width - 1)[None, :] <= self.bin[inner][:, None]
        after[inner] = 2 * inner[:, None] + np.where(np.concatenate([self.missing_left[inner][:, None], left], axis=1), 1, 2)
        after, column = after.ravel(), np.maximum(self.feature, 0)
        flat, row = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        levels = int(np.log2(inner[-1] + 1)) + 1
        for _ in range(levels):
            c = np.minimum(flat.take(row + column.take(node)), width - 2)
            node = after.take(node * width + c + 1)
        return node

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(codes)]

    def set_split(self, node: int, feature: int, b: int, missing_left: bool, left: float, right: float) -> None:
        self.feature[node], self.bin[node], self.missing_left[node] = feature, b, missing_left
        self.value[2 * node + 1], self.value[2 * node + 2] = left, right


def grow_small(codes: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> Tree:
    """A tree over few weighted rows (``codes``: rows x features), all in memory."""
    tree, width = Tree(depth), int(codes.max(initial=0)) + 2
    tree.value[0] = g.sum() / h.sum() if h.sum() else 0.0
    for level in range(depth):
        node, first = tree.leaves(codes), (1 << level) - 1
        for i in range(first, 2 * first + 1):
            mine = node == i
            if not mine.any():
                continue
            hist = [np.stack([np.bincount(codes[mine, f] + 1, w[mine], width) for f in range(codes.shape[1])])[None] for w in (g, h)]
            f, b, side, gl, hl, gt, ht = (x[0] for x in best_split(*hist))
            if f >= 0:
                tree.set_split(i, f, b, side, gl / hl, (gt - gl) / (ht - hl))
    return tree


# --- a tree on each column alone ---------------------------------------------------------

def auc(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float | None:
    """Exact ROC-AUC of scores with counts of positives and negatives."""
    values, which = np.unique(score, return_inverse=True)
    p, n = np.bincount(which, pos, len(values)), np.bincount(which, neg, len(values))
    return float((p * (np.cumsum(n) - n + 0.5 * n)).sum() / (p.sum() * n.sum())) if p.sum() and n.sum() else None


def histograms(df: DataFrame, cols, label: str, fold: str, cuts: list[np.ndarray]) -> DataFrame:
    """``feature, fold, bin, n, s, ss``: counts, sums and squares of the label, one pass for all columns."""
    cols, width = list(cols), max((len(c) for c in cuts), default=0) + 2
    table = df.select(F.col(fold).cast("int").alias("fold"), F.col(label).cast("double").alias("y"),
                      *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).where("y IS NOT NULL")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            y_all, folds = part["y"].to_numpy(), part["fold"].to_numpy()
            for f in np.unique(folds):
                mine = folds == f
                y = y_all[mine]
                into = sums.setdefault(int(f), np.zeros((3, len(cols), width)))
                for i in range(len(cols)):
                    code = coded(part[f"c{i}"].to_numpy(dtype=float, na_value=np.nan)[mine], cuts[i]) + 1
                    for k, w in enumerate((None, y, y * y)):
                        into[k, i] += np.bincount(code, w, width)
        for f, into in sums.items():
            i, b = np.nonzero(into[0])
            yield pd.DataFrame({"feature": np.array(cols, object)[i], "fold": np.int32(f), "bin": (b - 1).astype(np.int32),
                                "n": into[0][i, b], "s": into[1][i, b], "ss": into[2][i, b]})

    return (table.mapInPandas(partial, "feature string, fold int, bin int, n double, s double, ss double")
            .groupBy("feature", "fold", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]))


def single_feature_scores(df: DataFrame, cols, label: str, fold: str, metric: str, depth: int = 3, bins: int = 32,
                          folds=None, cuts: list[np.ndarray] | None = None) -> DataFrame:
    """``feature, fold, score``: a tree on each column alone, trained without a fold and scored on it.

    ``metric`` is ``roc_auc`` (0/1 label) or ``mse``; ``folds`` restricts the
    held-out folds (a train and test split has one of two).  A fold without
    rows, or of one class, scores null.  Quantile passes and one histogram pass
    serve any number of columns; what each feature's trees need, at most folds
    x bins rows, is one small group.
    """
    if metric not in ("roc_auc", "mse"):
        raise ValueError(metric)
    cuts = inner_cuts(df, cols, bins) if cuts is None else cuts
    hist = histograms(df, cols, label, fold, cuts)

    def score(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for f in sorted(part["fold"].unique()) if folds is None else folds:
            train, test = part[part["fold"] != f].groupby("bin", as_index=False).sum(), part[part["fold"] == f].sort_values("bin")
            tree = grow_small(train[["bin"]].to_numpy(), train["s"].to_numpy(), train["n"].to_numpy(), depth)
            p = tree.predict(test[["bin"]].to_numpy())
            n, s, ss = (test[c].to_numpy() for c in ("n", "s", "ss"))
            if metric == "roc_auc":
                value = auc(p, s, n - s)
            else:
                value = float((ss - 2 * p * s + n * p * p).sum() / n.sum()) if n.sum() else None
            out.append((part["feature"].iloc[0], int(f), value))
        return pd.DataFrame(out, columns=["feature", "fold", "score"]).astype({"score": float})

    scored = hist.groupBy("feature").applyInPandas(score, "feature string, fold int, score double")
    return scored.withColumn("score", F.nanvl("score", F.lit(None)))


# --- many trees at once ------------------------------------------------------------------

def binned(df: DataFrame, cols, label: str, key: str, cuts: list[np.ndarray], fold: str | None = None, trees: int = 0, seed: int = 0,
           by_label: bool = False) -> DataFrame:
    """Rows of equal fold (0 without one) and bin numbers ``c0, c1, ...`` as one row, written once.

    ``n, s, ss`` are their count and the sums and squares of the label; ``w0, g0,
    w1, g1, ...`` the summed weights and weighted labels in the bags of so many
    ``trees``.  A pass over this table costs by the different rows, however many
    rows are equal.  With ``by_label`` only rows of the same label are one, as ``y``.
    """
    from kestrel.session import ensure_checkpoint_dir
    cols = list(cols)
    table = df.select(F.xxhash64(key).alias("kh"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                      F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(len(cols)):
                part[f"c{i}"] = coded(part[f"c{i}"].to_numpy(dtype=float, na_value=np.nan), cuts[i]).astype(np.int16)
            kh = part.pop("kh").to_numpy()
            yield part.assign(**{f"w{t}": bag(kh, t, seed).astype(np.int16) for t in range(trees)})

    schema = "fold int, y double" + "".join(f", c{i} short" for i in range(len(cols))) + "".join(f", w{t} short" for t in range(trees))
    ensure_checkpoint_dir(df.sparkSession)
    sums = [F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("ss")]
    for t in range(trees):
        sums += [F.sum(f"w{t}").cast("double").alias(f"w{t}"), F.sum(F.col(f"w{t}") * F.col("y")).alias(f"g{t}")]
    same = ["fold", *(["y"] if by_label else []), *[f"c{i}" for i in range(len(cols))]]
    out = table.where("y IS NOT NULL").mapInPandas(code, schema).groupBy(*same).agg(*sums).checkpoint(eager=True)
    # Growing trees costs far more than reading codes: a table of few files is spread over all cores.
    cores = df.sparkSession.sparkContext.defaultParallelism
    return out if out.rdd.getNumPartitions() >= cores else out.repartition(cores).checkpoint(eager=True)


def bag(kh: np.ndarray, number: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of the rows with these key hashes for one tree."""
    with np.errstate(over="ignore"):
        z = kh.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(1 + number + (seed << 20))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(POISSON, (z >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


class Batch:
    """Rows of the binned table as arrays."""

    def __init__(self, part: pd.DataFrame):
        codes = [c for c in part.columns if c[0] == "c"]
        self.codes = part[codes].to_numpy(dtype=np.int16)
        self.columns = {c: part[c].to_numpy() for c in part.columns if c[0] != "c"}

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]


# The distribution function of Poisson(1) at 0, 1, ..., 12.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])


@dataclass(frozen=True)
class Spec:
    """One tree to grow: its columns, the fold it leaves out (-1: none) and its number."""

    columns: tuple[int, ...]
    fold: int = -1
    number: int = 0


Gradients = Callable[[Batch, Spec], tuple[np.ndarray, np.ndarray]]


def grow(table: DataFrame, specs: list[Spec], gradients: Gradients, depth: int, width: int, l2: float = 0.0, min_child: float = 0.0,
         min_gain: float = 0.0, tried: Callable[[Spec, int], np.ndarray] | None = None, buckets: int = 32) -> list[Tree]:
    """Grow all trees level by level; ``gradients`` gives label sums G and weights H of the rows of a batch.

    Each level is one job: tasks add up histograms of all open nodes, the sums
    are made and the splits chosen in groups of trees, and the driver receives
    one row for each open node.  ``tried`` gives the positions among a tree's
    columns that a node may use (default: all).
    """
    trees = [Tree(depth) for _ in specs]
    open_nodes: list[set[int]] = [{0} for _ in specs]
    schema = "bucket int, spec int, node int, hist array<double>"
    for level in range(depth):
        first, at_level = (1 << level) - 1, 1 << level
        todo = [i for i, nodes in enumerate(open_nodes) if nodes]
        if not todo:
            break

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {i: np.zeros((2, len(specs[i].columns), at_level * width)) for i in todo}
            for part in batches:
                batch = Batch(part)
                for i in todo:
                    g, h = gradients(batch, specs[i])
                    rows = np.flatnonzero(h)
                    local = trees[i].leaves(batch.codes[rows]) - first
                    rows, local = rows[local >= 0], local[local >= 0]          # finished leaves lie above
                    for k, c in enumerate(specs[i].columns):
                        at = local * width + batch.codes[rows, c] + 1
                        sums[i][0, k] += np.bincount(at, g[rows], at_level * width)
                        sums[i][1, k] += np.bincount(at, h[rows], at_level * width)
            for i, s in sums.items():
                s = s.reshape(2, len(specs[i].columns), at_level, width)
                nodes = [n for n in sorted(open_nodes[i]) if s[1, 0, n - first].any()]
                if nodes:
                    yield pd.DataFrame({"bucket": np.int32(i % buckets), "spec": np.int32(i), "node": np.array(nodes, np.int32),
                                        "hist": [s[:, :, n - first].ravel() for n in nodes]})

        def choose(part: pd.DataFrame) -> pd.DataFrame:
            out = []
            for (i, node), rows in part.sort_values(["spec", "node"]).groupby(["spec", "node"]):
                columns = specs[i].columns
                g, h = np.sum(np.stack(rows["hist"].to_list()), axis=0).reshape(2, len(columns), width)
                use = np.arange(len(columns)) if tried is None else tried(specs[i], node)
                f, b, side, gl, hl, gt, ht = (x[0] for x in best_split(g[None, use], h[None, use], l2, min_child, min_gain))
                out.append((i, node, columns[use[f]] if f >= 0 else -1, int(b), bool(side), gl, hl, gt, ht))
            return pd.DataFrame(out, columns=["spec", "node", "feature", "bin", "missing_left", "gl", "hl", "g", "h"])

        chosen = table.mapInPandas(partial, schema).groupBy("bucket").applyInPandas(
            choose, "spec int, node int, feature int, bin int, missing_left boolean, gl double, hl double, g double, h double").collect()
        open_nodes = [set() for _ in specs]
        for r in chosen:
            tree = trees[r["spec"]]
            if r["node"] == 0:
                tree.value[0] = r["g"] / (r["h"] + l2) if r["h"] + l2 else 0.0
            if r["feature"] >= 0:
                tree.set_split(r["node"], r["feature"], r["bin"], r["missing_left"], r["gl"] / (r["hl"] + l2), (r["g"] - r["gl"]) / (r["h"] - r["hl"] + l2))
                open_nodes[r["spec"]] |= {2 * r["node"] + 1, 2 * r["node"] + 2}
    return trees


@dataclass
class Forests:
    """Cross-validated forests on many column subsets of one binned table.

    ``trees`` = 1 without bags is a single decision tree.  A node of a forest
    tries ``sqrt`` of the columns (a third for ``r2``), drawn by a hash of tree
    and node.  :meth:`score_many` gives the mean over folds of ``roc_auc`` (of
    scores kept to 16 bits) or ``r2``, whatever the number of subsets in
    ``depth + 1`` jobs.
    """

    df: DataFrame
    cols: list[str]
    label: str
    key: str
    fold: str
    metric: str = "roc_auc"
    trees: int = 10
    depth: int = 4
    bins: int = 32
    seed: int = 0
    bagged: bool = True
    _table: DataFrame = field(default=None, repr=False)

    def __post_init__(self):
        cuts = inner_cuts(self.df, self.cols, self.bins)
        self.width = max((len(c) for c in cuts), default=0) + 2
        self._table = binned(self.df, self.cols, self.label, self.key, cuts, self.fold, self.trees if self.bagged else 0, self.seed)
        self.folds = [r[0] for r in self._table.select("fold").distinct().orderBy("fold").collect()]

    def _specs(self, subsets) -> list[Spec]:
        at = {c: i for i, c in enumerate(self.cols)}
        return [Spec(tuple(at[c] for c in s), f, t) for s in subsets for f in self.folds for t in range(self.trees)]

    def grown(self, subsets) -> list[Tree]:
        """The trees of all subsets, folds and numbers, in this order."""
        seed, bagged, share = self.seed, self.bagged, self.metric

        def gradients(batch: Batch, spec: Spec):
            w, g = (batch[f"w{spec.number}"], batch[f"g{spec.number}"]) if bagged else (batch["n"], batch["s"])
            used = batch["fold"] != spec.fold
            return g * used, w * used

        def tried(spec: Spec, node: int) -> np.ndarray:
            n = len(spec.columns)
            m = max(1, math.isqrt(n) if share == "roc_auc" else n // 3) if bagged else n
            return np.sort(np.random.default_rng([seed, spec.number, node]).permutation(n)[:m])

        return grow(self._table, self._specs(subsets), gradients, self.depth, self.width, tried=tried)

    def fold_scores(self, subsets) -> DataFrame:
        """``subset, fold, score``: every subset (by its number) scored on every held-out fold, in one job."""
        subsets = [list(s) for s in subsets]
        trees, per = self.grown(subsets), self.trees
        folds, metric = self.folds, self.metric
        at = {f: i for i, f in enumerate(folds)}

        def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                batch = Batch(part)
                for f in np.unique(batch["fold"]):
                    mine = batch["fold"] == f
                    codes, n, y, yy = batch.codes[mine], batch["n"][mine], batch["s"][mine], batch["ss"][mine]
                    for s in range(len(subsets)):
                        begin = (s * len(folds) + at[int(f)]) * per
                        p = np.mean([t.predict(codes) for t in trees[begin:begin + per]], axis=0)
                        if metric == "roc_auc":
                            level, which = np.unique(np.rint(p * 65536).astype(np.int64), return_inverse=True)
                            yield pd.DataFrame({"subset": np.int32(s), "fold": np.int32(f), "level": level,
                                                "a": np.bincount(which, y), "b": np.bincount(which, n - y), "c": 0.0, "d": 0.0})
                        else:
                            yield pd.DataFrame({"subset": np.int32([s]), "fold": np.int32([f]), "level": [0], "a": [n.sum()],
                                                "b": [y.sum()], "c": [yy.sum()], "d": [(yy - 2 * p * y + n * p * p).sum()]})

        sums = (self._table.mapInPandas(scored, "subset int, fold int, level long, a double, b double, c double, d double")
                .groupBy("subset", "fold", "level").agg(*[F.sum(c).alias(c) for c in "abcd"]))

        def judged(part: pd.DataFrame) -> pd.DataFrame:
            if metric == "roc_auc":
                value = auc(part["level"].to_numpy(), part["a"].to_numpy(), part["b"].to_numpy())
            else:
                n, s, ss, left = (float(part[c].iloc[0]) for c in "abcd")
                spread = ss - s * s / n
                value = 1 - left / spread if spread > 0 else None
            return pd.DataFrame({"subset": [part["subset"].iloc[0]], "fold": [part["fold"].iloc[0]], "score": [np.nan if value is None else value]})

        return sums.groupBy("subset", "fold").applyInPandas(judged, "subset int, fold int, score double")   # at most 65,537 levels each

    def score_many(self, subsets) -> list[float]:
        """Mean score over the folds of every subset (a scorer of :mod:`kestrel.operators.wrapper`)."""
        found: dict[int, list[float]] = {}
        for r in self.fold_scores(subsets).orderBy("subset", "fold").collect():
            found.setdefault(r["subset"], []).append(r["score"])
        return [float(np.mean(found[i])) for i in range(len(subsets))]


# --- boosting --------------------------------------------------------------------------------

@dataclass
class Boosted:
    """A boosted model: start value, trees (leaf values already shrunken), cuts, and the log of its rounds."""

    objective: str
    start: float
    trees: list[Tree]
    cols: list[str]
    cuts: list[np.ndarray]
    log: list[tuple[int, float, float]]
    best_round: int

    def margin(self, codes: np.ndarray, rounds: int | None = None) -> np.ndarray:
        out = np.full(len(codes), self.start)
        for t in self.trees[: self.best_round if rounds is None else rounds]:
            out += t.predict(codes)
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction of the best round (a probability for ``logistic``)."""
        cols, cuts, model = self.cols, self.cuts, self

        @F.pandas_udf("double")
        def predict(part: pd.DataFrame) -> pd.Series:
            codes = np.stack([coded(part[f"c{i}"].to_numpy(dtype=float, na_value=np.nan), cuts[i]) for i in range(len(cols))], axis=1)
            m = model.margin(codes)
            return pd.Series(1 / (1 + np.exp(-m)) if model.objective == "logistic" else m)

        return df.withColumn(out, predict(F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])))


def loss_of(objective: str, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Squared error, or the log loss of a 0/1 label."""
    return (y - margin) ** 2 if objective == "squared" else np.logaddexp(0, margin) - y * margin


def boost(df: DataFrame, cols, label: str, key: str, is_eval: str, objective: str = "squared", rounds: int = 100, depth: int = 3,
          eta: float = 0.3, l2: float = 1.0, min_child: float = 1.0, gamma: float = 0.0, patience: int = 10, bins: int = 32) -> Boosted:
    """Second-order boosting with an evaluation set.

    Trees grow on rows where ``is_eval`` is false, from sums of first and
    second derivatives of the loss; a leaf is ``eta * G / (H + l2)``, a split must
    gain ``gamma``, and missing values follow the better side.  After each
    round the mean loss on both sets is logged (its root for ``squared``);
    training ends when the evaluation loss has not improved for ``patience``
    rounds, and the best round stays.  A round takes ``depth`` histogram jobs and
    one for the losses.  Current predictions are recomputed from the trees in
    each pass, so nothing but the binned table is stored, with equal rows as one.
    """
    if objective not in ("squared", "logistic"):
        raise ValueError(objective)
    cols = list(cols)
    cuts = inner_cuts(df.where(~F.col(is_eval)), cols, bins)
    width = max((len(c) for c in cuts), default=0) + 2
    table = binned(df, cols, label, key, cuts, is_eval, by_label=True)
    first = table.where("fold = 0").agg(F.sum("s"), F.sum("n")).first()
    if not first[1]:
        raise ValueError("no training rows")
    mean = first[0] / first[1]
    start = mean if objective == "squared" else math.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6)))
    model = Boosted(objective, start, [], cols, cuts, [], 0)

    def gradients(batch: Batch, spec: Spec):
        m, train = model.margin(batch.codes, len(model.trees)), np.where(batch["fold"] == 0, batch["n"], 0.0)
        if objective == "squared":
            return (batch["y"] - m) * train, train
        p = 1 / (1 + np.exp(-m))
        return (batch["y"] - p) * train, p * (1 - p) * train

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            batch = Batch(part)
            n = batch["n"]
            each, fold = n * loss_of(objective, batch["y"], model.margin(batch.codes, len(model.trees))), batch["fold"]
            yield pd.DataFrame({"fold": [0, 1], "s": [each[fold == f].sum() for f in (0, 1)], "n": [n[fold == f].sum() for f in (0, 1)]})

    best = math.inf
    for r in range(1, rounds + 1):
        tree = grow(table, [Spec(tuple(range(len(cols))))], gradients, depth, width, l2, min_child, gamma)[0]
        tree.value *= eta
        model.trees.append(tree)
        sums = {x["fold"]: x["s"] / x["n"] if x["n"] else math.nan for x in table.mapInPandas(losses, "fold int, s double, n double")
                .groupBy("fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}
        train, held = (sums.get(f, math.nan) for f in (0, 1))
        if objective == "squared":
            train, held = math.sqrt(train), math.sqrt(held) if held == held else held
        model.log.append((r, train, held))
        watched = train if held != held else held
        if watched < best:
            best, model.best_round = watched, r
        elif r - model.best_round >= patience:
            break
    return model
