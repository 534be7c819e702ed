"""Hard negatives by a multiway hyperplane tree that knows the distances of its subtrees to their siblings' split points.

Rows with a label, an id and a finite vector take part; where vec_id is divisible by 7 the label becomes (label + 1) % 10, and
entries become x = floor(256 c). Equal vectors of one label are one point that keeps its six smallest ids: a search returns five
rows besides the anchor at most, and among equal scores the smallest ids come first, so no other id of a point can be returned.

The tree is made on a sample of at most about SAMPLE points (those with the smallest hashes): each node has FAN split points,
spread by farthest-first choice, and a point belongs to the nearest one (the hyperplanes between them bound its subtree). All
points then go down the tree, and each node records, over all points, the range of distances from each of its split points to
each of its subtrees, and the range of norms there. Both tables depend on the size of the tree alone.

A score window [s, t] is an annulus of distances, since |q - x|^2 = |q|^2 + |x|^2 - 2 q.x. A subtree is left out if, for any
split point, no distance in its range can meet the annulus by the triangle inequality. What is left is looked up exactly in the
leaves: points and anchors of a leaf are dealt to blocks, and each block of both is one product of two matrices.

Positives and negatives each take two steps: an anchor's own leaf gives a bound on what the last one returned must score, and
the other leaves are searched within it. Results are exact, so recall against brute force is 1.

Edge cases: rows without a label, an id or a vector, or with null or non-finite entries, or of another length than the commonest,
take no part. Equal rows count once; rows that share an anchor's id are never its positives. An anchor without positives, or
whose positives score 0 or less and have no row in the window, gives no rows. Empty tables give an empty result. Other columns are
ignored. Ids and labels are whole numbers. Scores and squared distances are exact up to 2 ^ 53 (entries of 2 ^ 23 in 64 dimensions).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solargrid.llm import vectors as V
from solargrid.llm.storage import input_partitions, stored

POSITIVES, NEGATIVES, ANCHORS = 5, 3, 50
#: Points that the tree is made on, children of a node, points of a leaf (more where the sample is too small for that).
SAMPLE, FAN, LEAF = 16_384, 8, 1024
#: Levels of the tree; where they do not part a sample, its leaf is larger, and dealt to more blocks.
DEPTH = 60
#: Points and anchors of a block of a leaf.
BLOCK = 4096
SLACK = 1e-6


class Tree:
    """Split points by node; children are nodes, leaves have no split points."""

    def __init__(self, sample: np.ndarray, n: int):
        self.splits: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        least = max(8.0, LEAF * len(sample) / max(n, 1))
        self._grow(sample.astype(np.float64), least)
        self.far = self.norms = None

    def _grow(self, x: np.ndarray, least: float, depth: int = 0) -> int:
        node = len(self.splits)
        self.splits.append(None)
        self.children.append([])
        if len(x) <= least or depth == DEPTH or (x == x[0]).all():
            return node
        some = x[np.linspace(0, len(x) - 1, min(len(x), 3 * FAN)).astype(int)]
        chosen, gap = [0], np.full(len(some), np.inf)
        while len(chosen) < FAN:
            gap = np.minimum(gap, np.linalg.norm(some - some[chosen[-1]], axis=1))
            if not gap.max():
                break
            chosen.append(int(gap.argmax()))
        if len(chosen) == 1:  # all of the chosen few are equal: take another that is not
            some = np.vstack([some[:1], x[(x != x[0]).any(axis=1)][:1]])
            chosen = [0, 1]
        self.splits[node] = some[chosen]
        own = self.distances(node, x).argmin(axis=1)
        self.children[node] = [self._grow(x[own == j], least, depth + 1) if (own == j).any() else self._leaf() for j in range(len(chosen))]
        return node

    def _leaf(self) -> int:
        self.splits.append(None)
        self.children.append([])
        return len(self.splits) - 1

    def distances(self, node: int, x: np.ndarray) -> np.ndarray:
        """From rows to the node's split points; squares are whole numbers, so equal ones compare equal."""
        p = self.splits[node]
        sq = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)
        return np.sqrt(np.maximum(sq, 0))

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(node, rows that come there, their distances to its split points); at a leaf the distances are empty."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.splits[node] is None:
                yield node, rows, np.zeros((len(rows), 0))
                continue
            d = self.distances(node, x[rows])
            own = d.argmin(axis=1)
            yield node, rows, d
            todo += [(c, rows[own == j]) for j, c in enumerate(self.children[node]) if (own == j).any()]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for node, rows, d in self.walk(x):
            if not d.shape[1]:
                out[rows] = node
        return out

    def search(self, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves that may hold a point with a score in one of an anchor's windows: (leaf, anchors).

        low and high have a column for each window; an empty one has low > high.
        """
        sq = (q * q).sum(axis=1)
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if self.splits[node] is None:
                yield node, rows
                continue
            d = self.distances(node, q[rows])
            for child in self.children[node]:
                small, large = self.norms[child]
                if small > large:
                    continue  # no point came here
                near, far = self.far[child]
                # No point of the child is nearer than `least` or farther than `most`, whatever split point is asked.
                least = np.maximum(np.maximum(d - far, near - d), 0).max(axis=1)[:, None] - SLACK
                most = (d + far).min(axis=1)[:, None] + SLACK
                outer = large * large + sq[rows][:, None] - 2 * low[rows]
                inner = small * small + sq[rows][:, None] - 2 * high[rows]
                open_ = (low[rows] <= high[rows]) & (outer >= -SLACK) & (least <= np.sqrt(np.maximum(outer, 0)) + SLACK) & (most >= np.sqrt(np.maximum(inner, 0)) - SLACK)
                kept = rows[open_.any(axis=1)]
                if len(kept):
                    todo.append((child, kept))


def prepared(rows: DataFrame, id_col: str, vec_col: str, label_col: str, d: int) -> DataFrame:
    """id, label (moved where the rule says so) and packed x of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = V.matrix(b.column(2), d)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), V.packed(x)], ["id", "label", "x"])

    moved = F.when(F.col("q_id") % 7 == 0, (F.col("q_label") + 1) % 10).otherwise(F.col("q_label"))
    own = rows.select(F.col(id_col).cast("long").alias("q_id"), F.col(label_col).cast("long").alias("q_label"), F.col(vec_col).alias("q_vec")).where("q_id IS NOT NULL AND q_label IS NOT NULL")
    return own.select("q_id", moved.alias("q_label"), "q_vec").mapInArrow(run, "id long, label long, x binary")


def first(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; tasks keep k of each before the shuffle."""
    return df.withColumn("s_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("s_no") <= k)


def grown(points: DataFrame, d: int) -> Tree:
    """The tree, with its ranges over all points."""
    n = points.count()
    share = min(1.0, SAMPLE / max(n, 1))
    some = points.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("x").distinct().orderBy("x").toArrow()
    tree = Tree(V.unpacked(some["x"].combine_chunks(), d), n)
    shared = points.sparkSession.sparkContext.broadcast((tree.splits, tree.children))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tree.__new__(Tree)
        own.splits, own.children = shared.value
        low, high = {}, {}
        for b in batches:
            x = V.unpacked(b.column(0), d).astype(np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            for node, rows, dist in own.walk(x):
                values = np.column_stack([dist, norm[rows]])
                nearest = dist.argmin(axis=1) if dist.shape[1] else None
                for j, child in enumerate(own.children[node]):
                    v = values[nearest == j]
                    if len(v):
                        low[child] = np.minimum(low.get(child, np.inf), v.min(axis=0))
                        high[child] = np.maximum(high.get(child, -np.inf), v.max(axis=0))
        for child in low:
            k = len(low[child])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, child)), pa.array(np.arange(k)), pa.array(low[child]), pa.array(high[child])], ["child", "split", "low", "high"])

    got = points.select("x").mapInArrow(run, "child long, split long, low double, high double").groupBy("child", "split").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("child", "split").collect()
    tree.norms, tree.far = {}, {}
    for node, children in enumerate(tree.children):
        for child in children:
            tree.norms[child], tree.far[child] = (np.inf, -np.inf), (np.full(len(children), np.inf), np.full(len(children), -np.inf))
    for r in got:
        near, far = tree.far[r["child"]]
        if r["split"] < len(near):
            near[r["split"]], far[r["split"]] = r["low"], r["high"]
        else:
            tree.norms[r["child"]] = (r["low"], r["high"])
    return tree


def with_leaf(points: DataFrame, tree: Tree, d: int) -> DataFrame:
    """Points with their leaf."""
    shared, names = points.sparkSession.sparkContext.broadcast(tree), points.columns
    at = names.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaves(V.unpacked(b.column(at), d).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], [*names, "leaf"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"{fields}, leaf long")


def routed(anchors: DataFrame, tree: Tree, d: int) -> DataFrame:
    """Anchors (x, label, low and high: arrays of windows, own: their leaf) for each other leaf that may hold an answer."""
    shared = anchors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = V.unpacked(b.column(0), d).astype(np.float64)
            low, high = padded(b.column(2), np.inf), padded(b.column(3), -np.inf)
            own = b.column(4).to_numpy()
            for leaf, rows in shared.value.search(q, low, high):
                take = pa.array(rows[own[rows] != leaf])
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(4)], pa.array(np.full(len(take), leaf))], ["x", "label", "low", "high", "leaf"])

    return anchors.select("x", "label", "low", "high", "own").mapInArrow(run, "x binary, label long, low array<double>, high array<double>, leaf long")


def padded(column: pa.Array, fill: float) -> np.ndarray:
    """A list column as a matrix."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists), default=0) or 1), fill)
    for row, v in zip(out, lists, strict=True):
        row[: len(v)] = v
    return out


def best(score: np.ndarray, ok: np.ndarray, ids: list, k: int) -> list[tuple[int, int]]:
    """The first k (score, id) by falling score and rising id among points that are ok."""
    at = np.flatnonzero(ok)
    if len(at) > k:
        at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        if len(at) > 4 * k:  # many points with equal scores: their first ids decide
            heads = np.array([ids[i][0] for i in at])
            at = at[np.lexsort((heads, -score[at]))[:k]]
    return sorted(((int(score[i]), j) for i in at for j in ids[i]), key=lambda p: (-p[0], p[1]))[:k]


def looked_up(anchors: DataFrame, points: DataFrame, d: int, same: bool, k: int) -> DataFrame:
    """x, label, window, score, id: the first k answers of each anchor and window in its leaf's points.

    anchors has x, label, low, high and leaf; points x, label, ids and leaf. Blocks of a leaf are dealt by hash.
    """
    # How many blocks a leaf's points and anchors make; a row for each leaf.
    sizes = points.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pb")).join(anchors.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ab")), "leaf")
    sizes = F.broadcast(stored(sizes, "negatives-blocks"))  # at most a row for each leaf of the tree
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("x", "label"), F.col(n)).cast("int")
    a = anchors.join(sizes, "leaf").withColumn("aq", one("ab")).withColumn("pq", spread("pb")).select("leaf", "aq", "pq", "x", "label", "low", "high")
    p = points.join(sizes, "leaf").withColumn("pq", one("pb")).withColumn("aq", spread("ab")).select("leaf", "aq", "pq", "x", "label", "ids")
    parts, keys = input_partitions(points.sparkSession), ["leaf", "aq", "pq"]

    def answer(q: pa.Table, t: pa.Table) -> pa.Table:
        rows = []
        if q.num_rows and t.num_rows:
            x = V.unpacked(t["x"].combine_chunks(), d).astype(np.float64)
            label, ids = t["label"].to_numpy(), t["ids"].to_pylist()
            qx, ql = V.unpacked(q["x"].combine_chunks(), d).astype(np.float64), q["label"].to_numpy()
            low, high = padded(q["low"].combine_chunks(), np.inf), padded(q["high"].combine_chunks(), -np.inf)
            for s in range(0, len(qx), 256):
                product = qx[s : s + 256] @ x.T
                for i, score in enumerate(product, s):
                    fits = (label == ql[i]) if same else (label != ql[i])
                    for w in range(low.shape[1]):
                        if low[i, w] <= high[i, w]:
                            rows += [(i, w, *b) for b in best(score, fits & (score >= low[i, w]) & (score <= high[i, w]), ids, k)]
        at = np.array(rows, dtype=np.int64).reshape(-1, 4)
        return pa.table({"x": q["x"].take(pa.array(at[:, 0])), "label": q["label"].take(pa.array(at[:, 0])), "no": at[:, 1], "score": at[:, 2], "id": at[:, 3]})

    dealt = a.repartition(parts, *keys).groupBy(*keys).cogroup(p.repartition(parts, *keys).groupBy(*keys))
    return dealt.applyInArrow(answer, "x binary, label long, no long, score long, id long")


def searched(asked: DataFrame, points: DataFrame, tree: Tree, d: int, same: bool, k: int) -> DataFrame:
    """x, label, no, score, id, s_no: the first k answers of each window of asked (x, label, low, high, own), over all points."""
    own = stored(looked_up(asked.withColumnRenamed("own", "leaf"), points, d, same, k), "negatives-own")
    # The k-th score of a full window is a bound for the rest.
    full = own.groupBy("x", "label", "no").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("bound")).where(F.col("n") >= k)
    bounds = full.groupBy("x", "label").agg(F.map_from_entries(F.collect_list(F.struct("no", "bound"))).alias("bounds"))
    raised = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.try_element_at(F.col("bounds"), i.cast("long")), v)))
    rest = routed(asked.join(bounds, ["x", "label"], "left").withColumn("low", raised), tree, d)
    other = looked_up(stored(rest, "negatives-routed"), points, d, same, k)
    return stored(first(own.unionByName(other), ["x", "label", "no"], k, F.desc("score"), F.col("id")), "negatives-found")


def mine(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the anchors (ids divisible by `every`)."""
    d = V.dimension(rows, vec_col)
    use = stored(prepared(rows, id_col, vec_col, label_col, d).distinct(), "negatives-rows")
    kept = first(use, ["x", "label"], POSITIVES + 1, F.col("id"))
    points = stored(kept.groupBy("x", "label").agg(F.array_sort(F.collect_list("id")).alias("ids")), "negatives-points")
    anchors = use.where(F.col("id") % every == 0)
    if points.isEmpty():
        return anchors.select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(0).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))
    tree = grown(points, d)
    points = stored(with_leaf(points, tree, d), "negatives-leaves")

    # Anchors with one vector and label ask once.
    asking = stored(with_leaf(anchors.select("x", "label").distinct(), tree, d).withColumnRenamed("leaf", "own"), "negatives-anchors")
    least, most = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    positives = searched(asking.withColumn("low", least).withColumn("high", most), points, tree, d, True, POSITIVES + 1)

    scores = positives.where("score >= 0").groupBy("x", "label").agg(F.array_sort(F.collect_set("score")).alias("scores"))
    low = F.transform("scores", lambda s: F.ceil(s / 2).cast("double"))
    high = F.transform("scores", lambda s: F.floor(s * 95 / 100).cast("double"))
    windows = stored(asking.join(scores, ["x", "label"]).withColumn("low", low).withColumn("high", high), "negatives-windows")
    found = searched(windows.select("x", "label", "low", "high", "own"), points, tree, d, False, NEGATIVES)

    score_of = F.element_at("scores", (F.col("no") + 1).cast("int"))
    negatives = found.join(windows.select("x", "label", "scores"), ["x", "label"]).withColumn("of", score_of)
    negatives = negatives.groupBy("x", "label").agg(F.collect_list(F.struct("of", "s_no", "id", "score")).alias("negatives"))
    answers = positives.groupBy("x", "label").agg(F.array_sort(F.collect_list(F.struct("s_no", "id", "score"))).alias("positives")).join(negatives, ["x", "label"])
    mine_ = anchors.join(stored(answers, "negatives-answers"), ["x", "label"])
    others = F.slice(F.filter("positives", lambda p: p["id"] != F.col("id")), 1, POSITIVES)
    each = mine_.withColumn("p", F.explode(others)).withColumn("g", F.explode(F.filter("negatives", lambda g: g["of"] == F.col("p.score"))))
    return each.select(F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("g.s_no").alias("rank"), F.col("g.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("g.score").alias("negative_score"))


_DOT = "CAST(list_dot_product(a.x, b.x) AS BIGINT)"
ORACLE = f"""WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
 FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
a AS (SELECT * FROM r WHERE vec_id % 50 = 0),
p AS (SELECT a.vec_id AS anchor_id, a.label, a.x, b.vec_id AS positive_id, {_DOT} AS positive_score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS k FROM a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id),
n AS (SELECT a.anchor_id, a.positive_id, b.vec_id AS negative_id, a.positive_score, {_DOT} AS negative_score, row_number() OVER (PARTITION BY a.anchor_id, a.positive_id ORDER BY {_DOT} DESC, b.vec_id) AS rank
 FROM p a JOIN r b ON a.label <> b.label AND 50 * a.positive_score <= 100 * {_DOT} AND 100 * {_DOT} <= 95 * a.positive_score WHERE a.k <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
