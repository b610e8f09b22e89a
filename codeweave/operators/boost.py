"""Second-order boosted trees for many fits over one table of candidates: logistic, pairwise and NDCG objectives.

Rows are binned once and packed by source. A tree grows level by level: gradients and hessians are summed by (node, feature, bin), the best split of a node is the
largest gain with at least `least` of hessian on either side. Gradients are whole multiples of 1 / UNIT, so sums, splits and trees are the same however rows are dealt.
Each fit is a task of its own, which is sent the rows that the fit learns from. Where those of the largest fit, counted first, are more than `memory` bytes, all fits
advance together: each level is one job in which every task sums its own rows for all fits and a shuffle adds the sums by (fit, node). Both grow the same trees.

Columns are drawn by tree, rows by tree and key. The rate of a category (a chapter pair) is fitted to each fit's training rows: (positives + weight * prior) / (n + weight).
Missing features count as 0. A source's rows must fit in one task: they are its candidates, bounded by the retrieval that made them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import keep_freed

UNIT = 1 << 20
#: Fits of one run; their training and scored rows are bits of two longs.
MOST_FITS = 63
#: Distinct categories that may be encoded.
MOST_CATEGORIES = 4096
#: Cells of a joint histogram of several features, rows from which it pays, pairs of ranked rows at a time, and sources of a fit's rows sent together.
CELLS, JOINT, PAIRS, TOGETHER = 4096, 4096, 1 << 20, 256


@dataclass(frozen=True)
class Boost:
    """Parameters; the defaults are the full setting. `least` is the least sum of hessians of a child."""

    depth: int = 6
    rate: float = 0.1
    rounds: int = 200
    rows: float = 0.8
    columns: float = 0.8
    least: float = 5.0
    l2: float = 1.0
    bins: int = 64
    objective: str = "logistic"
    weight: float = 20.0
    seed: int = 20260819


@dataclass
class Fit:
    """One fit: which rows it learns from and which it scores, and what it may look at."""

    name: str
    train: Column
    apply: Column
    features: list[str]
    encoded: bool = True
    setting: Boost = field(default_factory=Boost)


# --- numpy on a task's rows ----------------------------------------------------------------------------------------------------


@dataclass
class Rows:
    """Rows of whole sources, in the order of sources: bins (features, rows), start of each source."""

    bins: np.ndarray
    y: np.ndarray
    key: np.ndarray
    cat: np.ndarray
    train: np.ndarray
    apply: np.ndarray
    starts: np.ndarray

    def of(self, i: int, rates: np.ndarray | None, features: np.ndarray) -> tuple[Rows, np.ndarray]:
        """The rows that fit i learns from, with the fit's features as bins, and their places."""
        at = np.flatnonzero(self.train >> np.uint64(i) & np.uint64(1))
        return self.take(at, rates, features), at

    def take(self, at: np.ndarray, rates: np.ndarray | None, features: np.ndarray) -> Rows:
        bins = self.bins.take(at, axis=1)
        if len(features) != len(bins) or (features != np.arange(len(bins))).any():
            bins = bins[features]
        if rates is not None:
            bins = np.vstack([bins, rates[self.cat[at]][None]])
        source = np.searchsorted(self.starts, at, "right")
        starts = np.flatnonzero(np.diff(source, prepend=-1))
        return Rows(bins, self.y[at], self.key[at], self.cat[at], self.train[at], self.apply[at], starts)


def gradients(margin: np.ndarray, rows: Rows, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, hessian) of each row in multiples of 1 / UNIT."""
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margin))
        return np.rint((p - rows.y) * UNIT), np.rint(np.maximum(p * (1 - p), 1e-16) * UNIT)
    n = len(margin)
    g, h = np.zeros(n), np.zeros(n)
    sizes = np.diff(np.append(rows.starts, n))
    source = np.repeat(np.arange(len(sizes)), sizes)
    good, bad = np.flatnonzero(rows.y == 1), np.flatnonzero(rows.y == 0)
    n_good, n_bad = (np.bincount(source[x], minlength=len(sizes)) for x in (good, bad))
    gain = 1.0
    if objective == "ndcg":
        # the places that the model's own margins give in this round, ties in the rows' order
        place = np.empty(n, np.int64)
        for size in np.unique(sizes):
            at = rows.starts[sizes == size][:, None] + np.arange(size)
            own = np.empty(at.shape, np.int64)
            np.put_along_axis(own, np.argsort(-margin[at], axis=1, kind="stable"), np.broadcast_to(np.arange(size), at.shape), 1)
            place[at] = own
        discount = 1 / np.log2(place + 2)
        ideals = {k: (1 / np.log2(np.arange(k) + 2)).sum() for k in np.unique(n_good).tolist()}
        ideal = np.array([ideals[k] for k in n_good.tolist()])
    # pairs of a true row and a false one of its source, so many at a time
    each, first = n_bad[source[good]], (np.cumsum(n_bad) - n_bad)[source[good]]
    ends = np.cumsum(each)
    a = 0
    while a < len(good):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] - each[a] + PAIRS, "right")))
        count = each[a:b]
        up = np.repeat(good[a:b], count)
        down = bad[np.arange(len(up)) + np.repeat(first[a:b] - (np.cumsum(count) - count), count)]
        apart = 1 / (1 + np.exp(margin[up] - margin[down]))
        if objective == "ndcg":
            gain = np.abs(discount[up] - discount[down]) / ideal[source[up]]
        pull, bend = apart * gain, np.maximum(apart * (1 - apart), 1e-16) * gain
        # a row's pairs are added one by one in the rows' order, whatever stands between
        for at, sign in ((up, -1), (down, 1)):
            np.add.at(g, at, sign * pull)
            np.add.at(h, at, bend)
        a = b
    return np.rint(g * UNIT), np.rint(h * UNIT)


def sampled(key: np.ndarray, turn: int, setting: Boost) -> np.ndarray:
    """Which rows a tree sees, by their keys."""
    x = key.astype(np.uint64) ^ np.uint64((setting.seed * 1_000_003 + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(setting.rows * ((1 << 64) - 1)))


def drawn(n_features: int, turn: int, setting: Boost) -> np.ndarray:
    """The features of a tree, in order."""
    n = max(1, int(setting.columns * n_features))
    return np.sort(np.random.default_rng([setting.seed, turn]).permutation(n_features)[:n])


class Tree:
    """A heap of nodes: feature (-1: a leaf), last bin of the left side, value."""

    def __init__(self, depth: int):
        size = (2 << depth) - 1
        self.feature, self.bin, self.value, self.gain = np.full(size, -1, np.int16), np.zeros(size, np.uint8), np.zeros(size), np.zeros(size)

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """Each row's node after so many levels, or the leaf above."""
        node = np.zeros(bins.shape[1], np.int64)
        for _ in range(depth):
            at = np.flatnonzero(self.feature[node] >= 0)
            if not len(at):
                break
            n = node[at]
            node[at] = 2 * n + 1 + (bins[self.feature[n], at] > self.bin[n])
        return node


def histograms(rows: Rows, at: np.ndarray, local: np.ndarray, n_nodes: int, g: np.ndarray, h: np.ndarray, features: np.ndarray, n_bins: int) -> np.ndarray:
    """(2, nodes, features, bins): sums of g and h over rows `at`, whose nodes are `local`."""
    out = np.zeros((2, n_nodes, len(features), n_bins))
    base, gs, hs = local * n_bins, g[at], h[at]
    for j, f in enumerate(features):
        key = base + rows.bins[f, at]
        out[0, :, j] = np.bincount(key, gs, n_nodes * n_bins).reshape(n_nodes, n_bins)
        out[1, :, j] = np.bincount(key, hs, n_nodes * n_bins).reshape(n_nodes, n_bins)
    return out


#: (feature or -1, bin, gain, gradient, hessian, gradient and hessian of the left side) of a node.
Found = tuple[int, int, float, float, float, float, float]
NOTHING: Found = (-1, 0, 0.0, 0.0, 0.0, 0.0, 0.0)


def split(sums: np.ndarray, features: np.ndarray, setting: Boost) -> list[Found]:
    """The best split of each node of histograms; the first feature and bin on ties."""
    left = np.cumsum(sums, 3)[..., :-1] / UNIT
    total = sums[:, :, :1].sum(3) / UNIT
    g, h = total[0, :, 0], total[1, :, 0]
    right = total[..., None] - left
    score = lambda x: x[0] ** 2 / (x[1] + setting.l2)
    gain = score(left) + score(right) - (g**2 / (h + setting.l2))[:, None, None]
    gain[(left[1] < setting.least) | (right[1] < setting.least)] = -np.inf
    flat = gain.reshape(len(g), -1)
    best = flat.argmax(1)
    sides = left.reshape(2, len(g), -1)
    out = []
    for i, b in enumerate(best):
        ok = flat[i, b] > 1e-6
        out.append((int(features[b // left.shape[3]]) if ok else -1, int(b % left.shape[3]), float(flat[i, b]) if ok else 0.0, float(g[i]), float(h[i]), float(sides[0, i, b]), float(sides[1, i, b])))
    return out


def _settle(tree: Tree, node: int, found: Found, level: int, setting: Boost) -> list[int]:
    """Writes a node and its children's values; the children that may split again: sums are exact, so less than twice the least hessian never does."""
    feature, cut, gain, g, h, gl, hl = found
    tree.value[node] = -setting.rate * g / (h + setting.l2)
    if feature < 0:
        return []
    tree.feature[node], tree.bin[node], tree.gain[node] = feature, cut, gain
    out = []
    for child, cg, ch in ((2 * node + 1, gl, hl), (2 * node + 2, g - gl, h - hl)):
        tree.value[child] = -setting.rate * cg / (ch + setting.l2)
        if level + 1 < setting.depth and ch >= 2 * setting.least:
            out.append(child)
    return out


class Grower:
    """The trees of one fit, level by level, whoever sums the histograms."""

    def __init__(self, n_features: int, setting: Boost):
        self.n, self.setting, self.trees = n_features, setting, []
        self.tree, self.level, self.open = Tree(setting.depth), 0, [0]
        self.columns = drawn(n_features, 0, setting)

    @property
    def done(self) -> bool:
        return len(self.trees) == self.setting.rounds

    def take(self, found: list[Found]) -> None:
        """The splits of the open nodes."""
        last = self.level == self.setting.depth
        self.open = [c for node, x in zip(self.open, found, strict=True) for c in _settle(self.tree, node, (-1, *x[1:]) if last else x, self.level, self.setting)]
        self.level += 1
        if not self.open:
            self.trees.append(self.tree)
            self.tree, self.level, self.open = Tree(self.setting.depth), 0, [0]
            self.columns = drawn(self.n, len(self.trees), self.setting)


def divided(at: np.ndarray, bins: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows `at` whose bin is at most `cut`, and the others, in their order."""
    right = bins.take(at) > cut
    return at[~right], at[right]


def margins(trees: list[Tree], bins: np.ndarray, depth: int, start: np.ndarray | None = None) -> np.ndarray:
    out = np.zeros(bins.shape[1]) if start is None else start.copy()
    every = np.arange(bins.shape[1])
    for tree in trees:
        if len(every) < JOINT:
            out += tree.value[tree.nodes(bins, depth)]
            continue
        todo = [(0, every)]
        while todo:
            node, at = todo.pop()
            if tree.feature[node] < 0:
                out[at] += tree.value[node]
            elif len(at):
                todo += zip((2 * node + 1, 2 * node + 2), divided(at, bins[tree.feature[node]], tree.bin[node]), strict=True)
    return out


def _level_sums(grower: Grower, rows: Rows, seen: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = np.full((2 << grower.setting.depth) - 1, -1)
    place[grower.open] = np.arange(len(grower.open))
    local = place[node]
    at = np.flatnonzero(seen & (local >= 0))
    return histograms(rows, at, local[at], len(grower.open), g, h, grower.columns, grower.setting.bins)


class TreeSums:
    """Histograms (2, features, bins) of one tree's rows. Many rows are summed by the joint bins of several features, as many as have CELLS joint bins at most,
    from which each feature's own sums follow; sums are whole numbers, so the way doesn't matter."""

    def __init__(self, bins: np.ndarray, wide: np.ndarray, columns: np.ndarray, g: np.ndarray, h: np.ndarray, n_bins: int):
        self.bins, self.columns, self.g, self.h, self.n_bins, self.groups = bins, columns, g, h, n_bins, []
        if len(g) < JOINT:
            return
        packs: list[list[int]] = []
        size: list[int] = []
        for j in sorted(range(len(columns)), key=lambda j: -wide[columns[j]]):
            fits = [p for p in range(len(packs)) if size[p] * wide[columns[j]] <= CELLS]
            if not fits:
                packs.append([])
                size.append(1)
            p = fits[0] if fits else len(packs) - 1
            packs[p].append(j)
            size[p] *= int(wide[columns[j]])
        for pack in packs:
            key = bins[columns[pack[0]]].astype(np.uint16)
            for j in pack[1:]:
                key *= np.uint16(wide[columns[j]])
                key += bins[columns[j]]
            self.groups.append((pack, tuple(int(wide[columns[j]]) for j in pack), key))

    def every(self, seen: np.ndarray) -> np.ndarray:
        """Over all rows that are seen."""
        if not self.groups:
            return self.of(np.flatnonzero(seen))
        return self._joint(None, self.g * seen, self.h * seen)

    def of(self, at: np.ndarray) -> np.ndarray:
        g, h = self.g.take(at), self.h.take(at)
        if len(at) >= JOINT:
            return self._joint(at, g, h)
        n, size = len(self.columns), len(self.columns) * self.n_bins
        key = (self.bins.take(at, axis=1)[self.columns] + (np.arange(n) * self.n_bins)[:, None]).ravel()
        return np.stack([np.bincount(key, np.tile(x, n), size).reshape(n, self.n_bins) for x in (g, h)])

    def _joint(self, at: np.ndarray | None, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = np.zeros((2, len(self.columns), self.n_bins))
        for pack, shape, key in self.groups:
            key = (key if at is None else key.take(at)).astype(np.intp)
            for i, x in enumerate((g, h)):
                sums = np.bincount(key, x, int(np.prod(shape))).reshape(shape)
                for k, j in enumerate(pack):
                    out[i, j, : shape[k]] = sums.sum(tuple(a for a in range(len(shape)) if a != k))
        return out


def grow(rows: Rows, setting: Boost) -> list[Tree]:
    """All trees of one fit over rows in memory. Of a split node's children the one with fewer rows is summed, the other has the rest."""
    grower, n = Grower(len(rows.bins), setting), len(rows.y)
    margin = np.zeros(n)
    wide = rows.bins.max(1).astype(np.int64) + 1 if n else np.ones(len(rows.bins), np.int64)
    while not grower.done:
        turn = len(grower.trees)
        g, h = gradients(margin, rows, setting.objective)
        seen = sampled(rows.key, turn, setting)
        sums = TreeSums(rows.bins, wide, grower.columns, g, h, setting.bins)
        # rows of each node: those that the tree sees, and the others
        own, held = {0: (np.flatnonzero(seen), np.flatnonzero(~seen))}, {0: sums.every(seen)}
        while len(grower.trees) == turn:
            nodes = grower.open
            grower.take(split(np.stack([held[x] for x in nodes], 1), grower.columns, setting))
            grown = len(grower.trees) > turn
            tree, open_, before, held = grower.trees[-1] if grown else grower.tree, set() if grown else set(grower.open), held, {}
            for node in nodes:
                if tree.feature[node] < 0:
                    continue
                parts = [divided(at, rows.bins[tree.feature[node]], tree.bin[node]) for at in own.pop(node)]
                few, many = 2 * node + 1, 2 * node + 2
                own[few], own[many] = zip(*parts, strict=True)
                if len(own[few][0]) > len(own[many][0]):
                    few, many = many, few
                if few in open_ or many in open_:
                    held[few] = sums.of(own[few][0])
                if many in open_:
                    held[many] = before[node] - held[few]
        for node, parts in own.items():
            for at in parts:
                margin[at] += grower.trees[-1].value[node]
    return grower.trees


# --- on Spark ------------------------------------------------------------------------------------------------------------------


def kept(df: DataFrame) -> DataFrame:
    """The table, computed now and read many times, whose plan begins here: a reliable checkpoint where a folder is set, blocks of this process where the master is
    local and none can be lost; else it is held in memory and on disk with its whole plan."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    if context.master.startswith("local") and "cluster" not in context.master:
        return df.localCheckpoint()
    df = df.persist()
    df.count()
    return df


def edges(df: DataFrame, features: list[str], bins: int) -> dict[str, np.ndarray]:
    """Upper bounds of each feature's bins: distinct quantiles over all rows, by one aggregation."""
    at = [i / bins for i in range(1, bins)]
    row = df.agg(*[F.percentile_approx(_plain(f), F.array(*map(F.lit, at)), 10_000).alias(f) for f in features]).first()
    return {f: np.unique(np.array(row[f] or [0.0], float)) for f in features}


def _plain(feature: str) -> Column:
    return F.coalesce(F.nanvl(F.col(feature).cast("double"), F.lit(0.0)), F.lit(0.0))


def binned(df: DataFrame, features: list[str], *, bins: int = Boost.bins, keep: list[str]) -> DataFrame:
    """Columns `keep` with column bins: a byte for each feature, the number of bounds below its value."""
    known = edges(df, features, bins)
    bounds = [known[f] for f in features]
    names = [f"__f{i}" for i in range(len(features))]
    rows = df.select(*keep, *[_plain(f).alias(n) for f, n in zip(features, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.stack([np.searchsorted(b, batch.column(n).to_numpy(zero_copy_only=False), "left") for b, n in zip(bounds, names, strict=True)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([x.tobytes() for x in found], pa.binary())], names=[*keep, "bins"])

    return rows.mapInArrow(run, df.select(*keep).schema.add("bins", "binary"))


def _packed(table: DataFrame, fits: list[Fit], source: str, target: str, y: str, category: str | None) -> DataFrame:
    """(source, rows): a source's rows in the order of their keys, with bits of the fits that learn from them and score them."""
    bits = lambda which: sum((F.when(F.coalesce(getattr(f, which), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(fits)), F.lit(0).cast("long"))
    cat = F.col(category).cast("int") if category else F.lit(0)
    row = F.struct(F.xxhash64(source, target).alias("key"), F.col(target).alias("target"), F.col(y).cast("int").alias("y"), cat.alias("cat"), bits("train").alias("train"), bits("apply").alias("apply"), F.col("bins"))
    return table.select(F.col(source).alias("source"), row.alias("row")).groupBy("source").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def _read(batch: pa.RecordBatch | pa.Table) -> Rows:
    col = batch.column("rows")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten()
    get = lambda name, kind: flat.field(name).to_numpy(zero_copy_only=False).astype(kind)
    bins = np.frombuffer(b"".join(flat.field("bins").to_pylist()), np.uint8).reshape(len(flat), -1).T.copy() if len(flat) else np.zeros((0, 0), np.uint8)
    sizes = np.diff(col.offsets.to_numpy())
    return Rows(bins, get("y", np.int64), get("key", np.int64), get("cat", np.int64), get("train", np.uint64), get("apply", np.uint64), np.cumsum(sizes) - sizes)


def _rates(packed: DataFrame, fits: list[Fit]) -> dict[int, np.ndarray]:
    """For each fit the bin of each category by its rate, from sums over the fit's training rows."""
    known = [i for i, f in enumerate(fits) if f.encoded]
    if not known:
        return {}
    rows = packed.select(F.explode("rows").alias("r")).groupBy(F.col("r.cat").alias("cat"))
    on = lambda i: F.getbit(F.col("r.train"), F.lit(i))
    sums = rows.agg(*[x for i in known for x in (F.sum(on(i)).alias(f"n{i}"), F.sum(on(i) * F.col("r.y")).alias(f"p{i}"))]).limit(MOST_CATEGORIES + 1).collect()
    if len(sums) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    size, out = max((r["cat"] for r in sums), default=0) + 1, {}
    for i in known:
        n, p = np.zeros(size), np.zeros(size)
        for r in sums:
            n[r["cat"]], p[r["cat"]] = r[f"n{i}"], r[f"p{i}"]
        setting = fits[i].setting
        prior = p.sum() / max(n.sum(), 1)
        rate = (p + setting.weight * prior) / (n + setting.weight)
        values, at = np.unique(rate, return_inverse=True)
        below = np.cumsum(np.bincount(at, n, len(values))) - np.bincount(at, n, len(values))
        out[i] = np.floor(below / max(n.sum(), 1) * (setting.bins - 1))[at].astype(np.uint8)
    return out


def _grown_by_levels(packed: DataFrame, growers: list[Grower], rates: dict[int, np.ndarray], places: list[np.ndarray], store, every: int) -> None:
    """Grows all fits together, a job a level; every few rounds the margins so far are stored with the rows."""
    spark, based = packed.sparkSession, 0
    table = packed.withColumn("base", F.lit(None).cast("binary"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while not all(g.done for g in growers):
        turn = min(len(g.trees) for g in growers)
        if turn - based >= every:
            sent = spark.sparkContext.broadcast((growers, rates, places, based))

            def rebase(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                growers, rates, places, based = sent.value
                for batch in batches:
                    base, rows = _bases(batch, growers), _read(batch)
                    for i, grower in enumerate(growers):
                        own = rows.take(np.arange(len(rows.y)), rates.get(i), places[i])
                        base[i] = margins(grower.trees[based:turn], own.bins, grower.setting.depth, base[i])
                    ends = np.append(rows.starts[1:], len(rows.y))
                    out = [base[:, a:b].tobytes() for a, b in zip(rows.starts, ends, strict=True)]
                    yield batch.set_column(batch.schema.get_field_index("base"), "base", pa.array(out, pa.binary()))

            table, based = store(table.mapInArrow(rebase, table.schema)), turn
        sent = spark.sparkContext.broadcast((growers, rates, places, based))

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            growers, rates, places, based = sent.value
            held: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                base, rows = _bases(batch, growers), _read(batch)
                for i, grower in enumerate(growers):
                    if grower.done:
                        continue
                    own, at = rows.of(i, rates.get(i), places[i])
                    if not len(at):
                        continue
                    margin = margins(grower.trees[based:], own.bins, grower.setting.depth, base[i, at])
                    g, h = gradients(margin, own, grower.setting.objective)
                    node = grower.tree.nodes(own.bins, grower.level)
                    found = _level_sums(grower, own, sampled(own.key, len(grower.trees), grower.setting), node, g, h)
                    for j, n in enumerate(grower.open):
                        held[i, n] = held.get((i, n), 0) + found[:, j]
            if held:
                keys = list(held)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([held[k].tobytes() for k in keys], pa.binary())], names=["fit", "node", "sums"])

        def best(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            growers, held = sent.value[0], {}
            for batch in batches:
                for i, n, x in zip(batch.column("fit").to_pylist(), batch.column("node").to_pylist(), batch.column("sums"), strict=True):
                    held[i, n] = held.get((i, n), 0) + np.frombuffer(x.as_buffer())
            if held:
                out = []
                for (i, _), x in held.items():
                    x = x.reshape(2, 1, -1, growers[i].setting.bins)
                    out.append(split(x, growers[i].columns[: x.shape[2]], growers[i].setting)[0])
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held]), pa.array([pickle.dumps(x) for x in out], pa.binary())], names=["fit", "node", "found"])

        summed = table.mapInArrow(sums, "fit long, node long, sums binary").repartition(tasks, "fit", "node").mapInArrow(best, "fit long, node long, found binary")
        found = {(r["fit"], r["node"]): pickle.loads(bytes(r["found"])) for r in summed.collect()}
        for i, grower in enumerate(growers):
            if not grower.done:
                grower.take([found.get((i, n), NOTHING) for n in list(grower.open)])
        sent.unpersist()


def _grown_alone(packed: DataFrame, fits: list[Fit], counts: list[int], rates: dict[int, np.ndarray], places: list[np.ndarray]) -> list[list[Tree]]:
    """Each fit in a task of its own, which is sent the fit's training rows only; the largest begin first."""
    spark, order = packed.sparkSession, sorted(range(len(fits)), key=lambda i: -counts[i])
    turn = {i: k for k, i in enumerate(order)}
    sent = spark.sparkContext.broadcast((rates, places, turn, [f.setting for f in fits]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rates, places, turn, _ = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                rows, found = _read(batch.slice(a, TOGETHER)), []
                for i in turn:
                    own, at = rows.of(i, rates.get(i), places[i])
                    if len(at):
                        found.append((i, pickle.dumps((own.bins, own.y.astype(np.int8), own.key, own.starts), protocol=5)))
                for i, x in found:
                    yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([turn[i]], pa.int32()), pa.array([x], pa.binary())], names=["fit", "turn", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        keep_freed()
        for batch in batches:
            for i, x in zip(batch.column("fit").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                held.setdefault(i, []).append(pickle.loads(x))
        while held:
            i, parts = held.popitem()
            bins, y, key, starts = zip(*parts, strict=True)
            sizes = np.cumsum([0, *map(len, y)])[:-1]
            n = sum(map(len, y))
            none = np.zeros(0, np.int64)
            rows = Rows(np.concatenate(bins, 1), np.concatenate(y), np.concatenate(key), none, none, none, np.concatenate([s + a for s, a in zip(starts, sizes, strict=True)]))
            del parts, bins, y, key, starts
            assert rows.bins.shape[1] == n
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(grow(rows, sent.value[3][i]))], pa.binary())], names=["fit", "trees"])

    dealt = packed.mapInArrow(deal, "fit long, turn int, rows binary").repartitionById(len(fits), "turn")
    grown = {r["fit"]: pickle.loads(bytes(r["trees"])) for r in dealt.mapInArrow(run, "fit long, trees binary").collect()}
    sent.unpersist()
    none = np.zeros(0, np.int64)
    empty = lambda i: Rows(np.zeros((len(places[i]) + (i in rates), 0), np.uint8), none, none, none, none, none, none)
    return [grown[i] if i in grown else grow(empty(i), f.setting) for i, f in enumerate(fits)]


def _bases(batch: pa.RecordBatch, growers: list[Grower]) -> np.ndarray:
    """(fits, rows): margins stored with the rows."""
    sizes = np.diff(batch.column("rows").offsets.to_numpy())
    parts = [np.frombuffer(x.as_buffer()).reshape(len(growers), -1) if x.is_valid else np.zeros((len(growers), n)) for x, n in zip(batch.column("base"), sizes.tolist(), strict=True)]
    return np.concatenate([np.zeros((len(growers), 0)), *parts], 1).copy()


@dataclass
class Fitted:
    """Trees by fit, and what turns a row into a fit's bins."""

    fits: list[Fit]
    trees: list[list[Tree]]
    rates: dict[int, np.ndarray]
    places: list[np.ndarray]
    packed: DataFrame

    def scores(self) -> DataFrame:
        """(fit, source, target, y, score) of the rows that each fit scores: a probability for logistic fits, else a margin."""
        sent = self.packed.sparkSession.sparkContext.broadcast((self.trees, self.rates, self.places, [f.setting for f in self.fits]))
        rows = self.packed.schema["rows"].dataType.elementType
        schema = f"fit int, source {self.packed.schema['source'].dataType.simpleString()}, target {rows['target'].dataType.simpleString()}, y int, score double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, rates, places, settings = sent.value
            for batch in batches:
                rows, flat = _read(batch), batch.column("rows").flatten()
                ends = np.append(rows.starts[1:], len(rows.y))
                source = pa.array(np.repeat(np.arange(len(ends)), ends - rows.starts))
                for i, setting in enumerate(settings):
                    at = np.flatnonzero(rows.apply >> np.uint64(i) & np.uint64(1))
                    if not len(at):
                        continue
                    score = margins(trees[i], rows.take(at, rates.get(i), places[i]).bins, setting.depth)
                    score = 1 / (1 + np.exp(-score)) if setting.objective == "logistic" else score
                    own = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), batch.column("source").take(source.take(own)), flat.field("target").take(own), pa.array(rows.y[at].astype(np.int32)), pa.array(np.round(score, 9))], names=["fit", "source", "target", "y", "score"])

        return self.packed.mapInArrow(run, schema)

    def importance(self) -> DataFrame:
        """(fit, feature, gain, splits): share of a fit's gain, for the features that it splits by."""
        out = []
        for i, (fit, trees) in enumerate(zip(self.fits, self.trees, strict=True)):
            names = [*fit.features, "category_rate"]
            feature, gain = np.concatenate([t.feature for t in trees]), np.concatenate([t.gain for t in trees])
            on = feature >= 0
            sums, n = np.bincount(feature[on], gain[on], len(names)), np.bincount(feature[on], minlength=len(names))
            out += [(i, names[j], float(sums[j] / max(sums.sum(), 1e-300)), int(n[j])) for j in np.flatnonzero(n)]
        return self.packed.sparkSession.createDataFrame(out, "fit int, feature string, gain double, splits int")


def fit_all(table: DataFrame, features: list[str], fits: list[Fit], *, source: str = "source", target: str = "target", y: str = "y", category: str | None = None, memory: int = 192 << 20, every: int = 10, store=None) -> Fitted:
    """Fits over a table that `binned` made with these features (and the columns that the fits' conditions name); at most 63 of them.

    store: keeps a table that is read many times (default: `kept`)."""
    if len(fits) > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} fits at once")
    store = store or kept
    if category is None:
        fits = [replace(f, encoded=False) for f in fits]
    packed = store(_packed(table, fits, source, target, y, category))
    places = [np.array([features.index(x) for x in f.features], np.int64) for f in fits]
    rates = _rates(packed, fits)
    count = packed.select(F.explode("rows.train").alias("train")).agg(F.count("*"), *[F.sum(F.getbit("train", F.lit(i))) for i in range(len(fits))]).first()
    counts = [int(x or 0) for x in count[1:]]
    if max(counts, default=0) * (len(features) + 16) > memory:
        growers = [Grower(len(p) + (i in rates), f.setting) for i, (p, f) in enumerate(zip(places, fits, strict=True))]
        _grown_by_levels(packed, growers, rates, places, store, every)
        return Fitted(fits, [g.trees for g in growers], rates, places, packed)
    return Fitted(fits, _grown_alone(packed, fits, counts, rates, places), rates, places, packed)
