"""LambdaMART by distributed histograms: boosted trees that rank each disease, all folds of a batch in step.

The training table is a row a disease: its labels, its features as bins of one byte, and for each
fold the scores and gradients of its genes (a disease trains with at most `most` genes, so a row is
bounded). It stays in tasks. Of each tree a job a level sends histograms: a partition's sums of
gradients by (fold, node, feature, bin), which are added in a tree, a block of features at a time.
The task that adds the last finds each node's best cut, and only cuts reach the driver, which picks
the best, grows the trees and sends them back. A last job moves the scores. What a level or tree
costs is a pass over the bins; no task and not the driver holds the training table or a fold's.

Trees grow level by level up to `leaves` leaves, the best cuts first. Cuts between bins are quantiles
of all training rows, from mergeable sketches; the tested disease's features help to place them, its
labels don't. The gradients are those of LambdaRank with truncation at `top`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import discard, keep

#: Bytes of bins a partition, bytes of a block of histograms, columns whose quantiles are taken in one job, partitions whose histograms are added at a time.
PARTITION, BLOCK, COLUMNS, FAN = 32 << 20, 16 << 20, 64, 64


class Tree:
    """A regression tree on bins: nodes (feature, cut, left, right), feature -1 for a leaf, and a value a node."""

    def __init__(self) -> None:
        self.nodes = np.array([[-1, 0, 0, 0]])
        self.values = np.zeros(1)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(self.nodes[at, 0] >= 0)
            if not len(inner):
                return at
            f, cut, left, right = self.nodes[at[inner]].T
            at[inner] = np.where(bins[inner, f] <= cut, left, right)

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> tuple[int, int]:
        left = len(self.nodes)
        self.nodes = np.vstack([self.nodes, [[-1, 0, 0, 0]] * 2])
        self.nodes[node] = feature, cut, left, left + 1
        self.values = np.append(self.values, values)
        return left, left + 1


def lambdas(y: np.ndarray, s: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and second derivatives of one disease's genes, for labels y and scores s."""
    g, h = np.zeros(len(y)), np.zeros(len(y))
    gain = 2.0**y - 1
    ideal = (np.sort(gain)[::-1][:top] / np.log2(np.arange(2, min(top, len(y)) + 2))).sum()
    if ideal <= 0 or y.min() == y.max():
        return g, h
    rank = np.empty(len(y), np.int64)
    rank[np.argsort(-s, kind="stable")] = np.arange(len(y))
    weight = 1 / np.log2(rank + 2)
    for v in np.unique(y)[1:]:
        hi, lo = np.flatnonzero(y == v), np.flatnonzero(y < v)
        for part in np.array_split(lo, max(1, len(lo) * len(hi) // 1_000_000)):
            near = np.minimum(rank[hi][:, None], rank[part][None, :]) < top
            delta = np.abs((gain[hi][:, None] - gain[part][None, :]) * (weight[hi][:, None] - weight[part][None, :])) / ideal * near
            p = 1 / (1 + np.exp(np.clip(s[hi][:, None] - s[part][None, :], -50, 50)))
            g[hi] += (p * delta).sum(1)
            g[part] -= (p * delta).sum(0)
            h[hi] += (p * (1 - p) * delta).sum(1)
            h[part] += (p * (1 - p) * delta).sum(0)
    return g, h


def quantiles(train: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """The cuts of each feature: at most bins - 1 values, a bin is what lies up to its cut."""
    shares = [i / bins for i in range(1, bins)]
    out: list[np.ndarray] = []
    for lo in range(0, width, COLUMNS):
        some = train.agg(*(F.percentile_approx(F.get("x", F.lit(i)), shares, 40 * bins).alias(f"q{i}") for i in range(lo, min(width, lo + COLUMNS)))).first()
        out += [np.unique(np.array(q if q is not None else [], float)) for q in some]
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)]).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _grouped(train: DataFrame, cuts, width: int, kind: str) -> DataFrame:
    """(mesh, y, bins): a row a disease, its genes in order of pos, over partitions of PARTITION bytes of bins."""

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = binned(_matrix(batch.column(3), width), cuts.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in rows], pa.binary())], ["mesh", "pos", "y", "b"])

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        return pa.table({"mesh": t.column("mesh").slice(0, 1), "y": pa.array([t.column("y").to_numpy().astype(float).tobytes()], pa.binary()), "bins": pa.array([b"".join(t.column("b").to_pylist())], pa.binary())})

    rows = train.select("mesh", F.col("pos").cast("int").alias("pos"), F.col("y").cast("double").alias("y"), "x").mapInArrow(to_bins, f"mesh {kind}, pos int, y double, b binary")
    d = keep(rows.groupBy("mesh").applyInArrow(whole, f"mesh {kind}, y binary, bins binary"), "groups")
    size = d.agg(F.sum(F.octet_length("bins"))).first()[0] or 0
    parts = max(-(-size // PARTITION), min(d.sparkSession.sparkContext.defaultParallelism, d.count()), 1)
    return keep(d.repartition(parts, "mesh"), "groups")


def _moved(state: DataFrame, folds: list, trees, kind: str, rate: float, top: int, width: int) -> DataFrame:
    """The groups with scores s, moved by the last trees, and gradients g and h, a row of numbers a fold; a fold's own disease has none."""
    fresh = "s" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mesh, raw_y, raw, *old = (c[i].as_py() for c in batch.columns)
                y, bins = np.frombuffer(raw_y), np.frombuffer(raw, np.uint8).reshape(-1, width)
                s = np.zeros((len(folds), len(y))) if fresh else np.frombuffer(old[0]).reshape(len(folds), -1).copy()
                g, h = np.zeros_like(s), np.zeros_like(s)
                for k, fold in enumerate(folds):
                    if fold == mesh:
                        continue
                    if trees is not None:
                        s[k] += rate * trees.value[k].values[trees.value[k].leaf_of(bins)]
                    g[k], h[k] = lambdas(y, s[k], top)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([x], pa.binary()) for x in (raw_y, raw, s.tobytes(), g.tobytes(), h.tobytes()))], ["mesh", "y", "bins", "s", "g", "h"])

    return state.select("mesh", "y", "bins", *([] if fresh else ["s"])).mapInArrow(run, f"mesh {kind}, y binary, bins binary, s binary, g binary, h binary")


def _best_cuts(state: DataFrame, folds: list, trees, active: list[list[int]], width: int, bins: int, least: int, ridge: float) -> list[tuple]:
    """(fold, node, gain, feature, cut, left g, left h, g, h) of each active node: the best cut of each block of features."""
    most = max(map(len, active))
    wide = max(1, min(width, BLOCK // (most * bins * 24)))
    node_rows = [{n: k for k, n in enumerate(a)} for a in active]
    shape = "fold int, block int, part int, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, meshes = TaskContext.get().partitionId(), [], []
        for batch in batches:
            for i in range(batch.num_rows):
                mesh, raw, g, h = (c[i].as_py() for c in batch.columns)
                own.append((np.frombuffer(raw, np.uint8).reshape(-1, width), np.frombuffer(g).reshape(len(folds), -1), np.frombuffer(h).reshape(len(folds), -1)))
                meshes.append(mesh)
        for k, fold in enumerate(folds):
            used = [o for o, mesh in zip(own, meshes, strict=True) if mesh != fold]
            if not used or not active[k]:
                continue
            rows, g, h = np.concatenate([o[0] for o in used]), np.concatenate([o[1][k] for o in used]), np.concatenate([o[2][k] for o in used])
            slot = np.full(len(trees.value[k].nodes), -1)
            slot[active[k]] = range(len(active[k]))
            at = slot[trees.value[k].leaf_of(rows)]
            inside = at >= 0
            rows, g, h, at = rows[inside], g[inside], h[inside], at[inside] * bins
            if not len(rows):
                continue
            size = len(active[k]) * bins
            for block, lo in enumerate(range(0, width, wide)):
                cells = (at + rows[:, f] for f in range(lo, min(width, lo + wide)))
                sums = np.stack([np.stack([np.bincount(c, w, size) for w in (g, h, None)]) for c in cells])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["fold", "block", "part", "sums"])

    def total(t: pa.Table) -> np.ndarray:
        out = None
        for raw in t.column("sums"):
            x = np.frombuffer(raw.as_buffer())
            out = x.copy() if out is None else np.add(out, x, out=out)
        return out

    def added(t: pa.Table) -> pa.Table:
        return pa.table({**{c: t.column(c).slice(0, 1) for c in ("fold", "block", "part")}, "sums": pa.array([total(t).tobytes()], pa.binary())})

    def best(t: pa.Table) -> pa.Table:
        k, block = t.column("fold")[0].as_py(), t.column("block")[0].as_py()
        sums = total(t).reshape(-1, 3, len(active[k]), bins)  # feature, kind, node, bin
        left = sums.cumsum(3)
        all_ = left[..., -1:]
        lg, lh, ln = left[:, 0], left[:, 1], left[:, 2]
        g, h, n = all_[:, 0], all_[:, 1], all_[:, 2]
        gain = lg**2 / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - g**2 / (h + ridge)
        gain[(ln < least) | (n - ln < least)] = 0
        lines = []
        for node, a in node_rows[k].items():
            f, cut = np.unravel_index(int(gain[:, a].argmax()), gain[:, a].shape)
            lines.append((k, node, gain[f, a, cut], block * wide + f, cut, lg[f, a, cut], lh[f, a, cut], g[f, a, 0], h[f, a, 0]))
        return pa.table([pa.array([x[i] for x in lines], kind) for i, kind in enumerate(kinds)], names=names)

    names = ["fold", "node", "gain", "feature", "cut", "lg", "lh", "g", "h"]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
    d, parts = state.select("mesh", "bins", "g", "h").mapInArrow(run, shape), state.rdd.getNumPartitions()
    while parts > FAN:
        parts = -(-parts // FAN)
        d = d.withColumn("part", F.expr(f"part div {FAN}").cast("int")).groupBy("fold", "block", "part").applyInArrow(added, shape)
    found = d.groupBy("fold", "block").applyInArrow(best, "fold int, node int, gain double, feature int, cut int, lg double, lh double, g double, h double")
    return [tuple(r) for r in found.collect()]  # a row a node and block of features


def _grown(state: DataFrame, folds: list, width: int, bins: int, leaves: int, depth: int, least: int, ridge: float) -> list[Tree]:
    """A tree a fold on the gradients in state."""
    sc = state.sparkSession.sparkContext
    trees, active, level = [Tree() for _ in folds], [[0] for _ in folds], 0
    room = [leaves - 1] * len(folds)
    while any(active) and (depth <= 0 or level < depth):
        held = sc.broadcast(trees)  # of bounded size: folds x leaves
        best: dict[tuple[int, int], tuple] = {}
        for k, node, *cut in sorted(_best_cuts(state, folds, held, active, width, bins, least, ridge)):
            if cut[0] > 1e-12 and ((k, node) not in best or cut[0] > best[k, node][0]):
                best[k, node] = tuple(cut)
        held.destroy()
        active = [[] for _ in folds]
        for (k, node), (_, feature, cut, lg, lh, g, h) in sorted(best.items(), key=lambda x: (x[0][0], -x[1][0], x[0][1])):
            if room[k] > 0:
                active[k] += trees[k].split(node, feature, cut, (lg / (lh + ridge), (g - lg) / (h - lh + ridge)))
                room[k] -= 1
        active = [a if r else [] for a, r in zip(active, room, strict=True)]
        level += 1
    return trees


def lambdamart_loo(matrix: DataFrame, most: int = 10_000, trees: int = 100, rate: float = 0.1, leaves: int = 31, depth: int = -1, least: int = 20, top: int = 30, bins: int = 128, ridge: float = 1e-3, at_once: int = 32) -> DataFrame:
    """(mesh, gene, score) from (mesh, gene, y, pos, x): each disease is scored by a ranker trained on all others, `most` genes of each.

    at_once folds train in step, which is what a job is shared by; a disease's row holds 24 bytes a
    gene and such a fold. Folds that have nothing to learn from score 0. Null diseases are one more
    disease; a null feature counts as 0.
    """
    spark, kind = matrix.sparkSession, dict(matrix.dtypes)["mesh"]
    gene = dict(matrix.dtypes)["gene"]
    if not 2 <= bins <= 256:
        raise ValueError("bins must fit in a byte")
    data = keep(matrix.select("mesh", "gene", "y", "pos", F.transform("x", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("x")), "matrix")
    width = data.agg(F.max(F.size("x"))).first()[0] or 0
    empty = spark.createDataFrame([], f"mesh {kind}, gene {gene}, score double")
    if not width:
        return data.select("mesh", "gene", F.lit(0.0).alias("score"))
    train = data.where(F.col("pos") <= most)
    cuts = spark.sparkContext.broadcast(quantiles(train, width, bins))  # width x bins numbers
    groups = _grouped(train, cuts, width, kind)
    folds_of = sorted((r[0] for r in data.select("mesh").distinct().collect()), key=lambda m: (m is None, m))  # a row a disease
    out = empty
    for lo in range(0, len(folds_of), at_once):
        folds = folds_of[lo : lo + at_once]
        state, last, model = groups, None, [[] for _ in folds]
        for _ in range(trees):
            moved = keep(_moved(state, folds, last, kind, rate, top, width), "state")
            if state is not groups:
                discard(state)
            state, grown = moved, _grown(moved, folds, width, bins, leaves, depth, least, ridge)
            if all(len(t.nodes) == 1 for t in grown):
                break
            last = spark.sparkContext.broadcast(grown)
            for own, t in zip(model, grown, strict=True):
                own.append(t)
        if state is not groups:
            discard(state)
        of = spark.sparkContext.broadcast(dict(zip(folds, model, strict=True)))  # folds x trees x leaves

        def scored(batches: Iterator[pa.RecordBatch], of=of) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mesh, rows = batch.column(0).to_pylist(), binned(_matrix(batch.column(2), width), cuts.value)
                score = np.zeros(len(mesh))
                for m in set(mesh):
                    own = np.array([i for i, v in enumerate(mesh) if v == m])
                    for t in of.value[m]:
                        score[own] += rate * t.values[t.leaf_of(rows[own])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["mesh", "gene", "score"])

        known = [m for m in folds if m is not None]
        tested = data.where(F.col("mesh").isin(known) | (F.col("mesh").isNull() if None in folds else F.lit(False)))
        out = out.unionByName(keep(tested.select("mesh", "gene", "x").mapInArrow(scored, f"mesh {kind}, gene {gene}, score double"), "scores"))
    return out
