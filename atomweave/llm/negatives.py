"""Hard negatives by an STR-packed R-tree over vectors of whole numbers.

Rows are dealt into tiles by sort-tile-recursive packing: slabs of the coordinate that varies most, in each slab strips of
the next one, and inside a tile runs of the following ones down to leaves of LEAF rows.  Every node keeps the least and
the greatest value of each coordinate, so that the inner product of an anchor with anything below it lies in an interval:
each coordinate adds its factor times the nearer or the farther side.  Bundles of tiles are trees of their own; a block of
anchors meets each bundle once.  There a best-first queue opens the node of the greatest possible score and drops nodes
whose interval misses all score windows or lies strictly below the k-th score found; equal scores are still opened, since
ties go to the least id.

Positives are searched first (same label, no window), then negatives (other labels, a window for each positive).  Each
bundle answers with its k best, and the k best of these are the result.

Defined results: rows with a null label or vector, an empty vector, or a null, NaN or infinite component take no part, nor
do rows without a key; a vector meets those of its own length only.  A key that several rows repeat counts once in a
result, with its highest score.  Scores must fit 64 bits.  Equal vectors are split over tiles by their keys, so that copies fill no task.  An anchor
without another row of its label, and a positive without a row in its window, give no row.  An empty table gives none.
Other columns aren't looked at, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm.common import staged

#: Rows of a leaf, of a tile, tiles of a bundle, and anchors of a block.
LEAF, TILE, BUNDLE, BLOCK = 128, 4096, 2, 512
#: Positives of an anchor and negatives of a positive; a negative's score lies between LOW and 100 hundredths of the positive's.
POSITIVES, NEGATIVES, LOW = 5, 5, 80
#: Relabelled rows and anchors of the query, by divisors of the key.
WRONG_LABEL, ANCHOR, LABELS = 7, 100, 10
#: Each component times SCALE is rounded down.
SCALE = 256


def prepared(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v, dim) of the rows that take part, with components as whole numbers."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ok = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce((F.size(vector) > 0) & finite, F.lit(False))
    return rows.where(ok).select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"), F.transform(wide, lambda x: F.floor(x * scale)).alias("v"), F.size(vector).alias("dim"))


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the fewest bytes that hold them all."""
    return x.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if not x.size or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max))


def _matrix(packed: dict) -> np.ndarray:
    """The vectors of a tile, whose length says how wide a number is."""
    n, dim = len(packed["ids"]) // 8, packed["dim"]
    return np.frombuffer(packed["v"], f"i{len(packed['v']) // (n * dim)}").astype(np.int64).reshape(n, dim)


def _leaves(x: np.ndarray, order: np.ndarray, axes: list[int]) -> list[np.ndarray]:
    """Places of the rows of each leaf: runs along one axis after another, halving towards LEAF rows."""
    if len(order) <= LEAF or not axes:
        order = order[np.argsort(x[order, axes[0]], kind="stable")] if axes else order
        return [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    runs = max(2, round((len(order) / LEAF) ** (1 / len(axes))))
    order = order[np.argsort(x[order, axes[0]], kind="stable")]
    return [leaf for part in np.array_split(order, runs) for leaf in _leaves(x, part, axes[1:])]


def _packer(axes: list[int], dim: int):
    def pack(table: pa.Table) -> pa.Table:
        """The rows of a tile in the order of its leaves."""
        x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        order = np.lexsort((labels, ids))
        leaves = _leaves(x[order], np.arange(len(order)), axes[2:] + axes[:2])
        order, ends = order[np.concatenate(leaves)], np.cumsum([len(a) for a in leaves])
        place = [dim, table.column("tile")[0].as_py(), table.column("piece")[0].as_py()]
        blobs = [ids[order].astype(np.int64).tobytes(), labels[order].astype(np.int32).tobytes(), _narrow(x[order]).tobytes(), ends.astype(np.int32).tobytes()]
        return pa.table({c: pa.array([value], kind) for c, value, kind in zip(["dim", "tile", "piece", "ids", "labels", "v", "ends"], place + blobs, [pa.int32()] * 3 + [pa.binary()] * 4)})

    return pack


def tiles(rows: DataFrame) -> DataFrame:
    """(dim, number, bundle, ids, labels, v, ends): packed tiles of ``prepared`` rows; leaves are runs of rows that stop at ``ends``."""
    shape = rows.groupBy("dim").agg(F.count("*").alias("n")).collect()  # as many as there are lengths of vectors
    parts = []
    for dim, n in sorted((r["dim"], r["n"]) for r in shape):
        own = rows.where(F.col("dim") == dim)
        spread = own.agg(*[F.var_pop(F.get("v", F.lit(i)).cast("double")).alias(f"s{i}") for i in range(dim)]).first()
        axes = sorted(range(dim), key=lambda i: -(spread[i] or 0))[:4]
        slabs = max(1, round((n / TILE) ** 0.5))
        marks = [i / slabs for i in range(1, slabs)]
        value = lambda i: F.get("v", F.lit(axes[i % len(axes)]))  # noqa: B023, E731

        def place(c, borders):
            return F.size(F.filter(borders, lambda b: b < c))

        if marks:
            first = own.agg(F.percentile_approx(value(0), marks, 1000).alias("b")).first()["b"]
            own = own.withColumn("slab", place(value(0), F.array(*[F.lit(b) for b in first])))
            strips = own.groupBy("slab").agg(F.percentile_approx(value(1), marks, 1000).alias("borders"))  # a row for each slab
            own = own.join(F.broadcast(strips), "slab").withColumn("tile", F.col("slab") * slabs + place(value(1), F.col("borders"))).drop("slab", "borders")
        else:
            own = own.withColumn("tile", F.lit(0))
        # a tile of many equal vectors is split by keys
        heavy = own.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("pieces"))
        own = own.join(F.broadcast(heavy), "tile").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
        parts.append(own.groupBy("tile", "piece").applyInArrow(_packer(axes, dim), "dim int, tile int, piece int, ids binary, labels binary, v binary, ends binary"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "dim int, tile int, piece int, ids binary, labels binary, v binary, ends binary, bundle long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = staged(out)
    bundles = max(1, -(-out.count() // BUNDLE))
    # neighbouring tiles stay together, pieces of a split tile don't
    return staged(out.withColumn("bundle", F.pmod(F.floor(F.col("tile") / BUNDLE) + F.col("piece"), F.lit(bundles))))


class Tree:
    """A bundle of tiles: the root's children are tiles, theirs are leaves."""

    def __init__(self, packed: list[dict]):
        self.ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in packed])
        self.labels = np.concatenate([np.frombuffer(p["labels"], np.int32) for p in packed])
        self.x = np.concatenate([_matrix(p) for p in packed])
        ends, children, at = [], [], 0
        for p in packed:
            e = np.frombuffer(p["ends"], np.int32) + at
            children.append(range(len(ends), len(ends) + len(e)))
            ends += e.tolist()
            at = ends[-1]
        self.ends, self.starts, self.children = ends, [0, *ends[:-1]], children
        heads = np.array(self.starts)
        self.low, self.high = np.minimum.reduceat(self.x, heads), np.maximum.reduceat(self.x, heads)
        tops = np.array([c[0] for c in children])
        self.tile_low, self.tile_high = np.minimum.reduceat(self.low, tops), np.maximum.reduceat(self.high, tops)
        # products are exact in doubles up to 2 ** 53, which BLAS multiplies faster
        self.most = int(np.abs(self.x).max(initial=0))
        self.wide = self.x.astype(np.float64)

    def scores(self, a: np.ndarray, leaf: int) -> np.ndarray:
        s, e = self.starts[leaf], self.ends[leaf]
        if self.most * int(np.abs(a).sum()) < 1 << 53:
            return (self.wide[s:e] @ a.astype(np.float64)).astype(np.int64)
        return self.x[s:e] @ a

    def intervals(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each anchor with a point of each box; widened where doubles may round."""
        up, down = np.maximum(anchors, 0).astype(np.float64), np.minimum(anchors, 0).astype(np.float64)
        low, high = low.astype(np.float64), high.astype(np.float64)
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        slack = 0 if int(np.abs(anchors).sum(1).max(initial=0)) * self.most < 1 << 53 else np.maximum(np.abs(least), np.abs(most)) * 1e-9 + 1
        return least - slack, most + slack


class Best:
    """The k best (score, id) of a window [low, high]; the floor is what a score must reach to be among them."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.low, self.high, self.floor = k, low, high, low if low <= high else np.inf
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = (scores >= self.floor) & (scores <= self.high)
        if not ok.any():
            return
        s, i = np.concatenate([self.scores, scores[ok]]), np.concatenate([self.ids, ids[ok]])
        order = np.lexsort((i, -s))
        s, i = s[order], i[order]
        _, first = np.unique(i, return_index=True)  # of a repeated key the highest score
        keep = np.sort(first)[: self.k]
        self.scores, self.ids = s[keep], i[keep]
        if len(keep) == self.k:
            self.floor = max(self.low, int(self.scores[-1]))


def search(tree: Tree, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, same: bool, windows: list[list[tuple[float, float]]], k: int) -> list[list[Best]]:
    """For each anchor and window the k best rows of the tree, of the anchor's label (itself left out) or of any other."""
    least, most = tree.intervals(anchors, tree.low, tree.high)
    tile_least, tile_most = tree.intervals(anchors, tree.tile_low, tree.tile_high)
    out = []
    for n in range(len(ids)):
        best = [Best(k, low, high) for low, high in windows[n]]
        queue = [(-tile_most[n, t], 0, t) for t in range(len(tree.children))] if best else []
        heapq.heapify(queue)
        while queue:
            top, leaf, node = heapq.heappop(queue)
            if -top < min(b.floor for b in best):
                break  # nothing left reaches any k-th score
            bottom = least[n, node] if leaf else tile_least[n, node]
            if not any(bottom <= b.high and -top >= b.floor for b in best):
                continue
            if leaf:
                s, e = tree.starts[node], tree.ends[node]
                kind = (tree.labels[s:e] == labels[n]) == same
                if same:
                    kind &= tree.ids[s:e] != ids[n]
                scores = tree.scores(anchors[n], node)[kind]
                for b in best:
                    b.add(scores, tree.ids[s:e][kind])
            else:
                for child in tree.children[node]:
                    heapq.heappush(queue, (-most[n, child], 1, child))
        out.append(best)
    return out


def _blocks(anchors: DataFrame, extra: list[str]) -> DataFrame:
    """(dim, block, anchors): blocks of about BLOCK anchors as arrays of rows."""
    sizes = {r["dim"]: r["n"] for r in anchors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    n = F.create_map(*[F.lit(x) for d, c in sizes.items() for x in (d, max(1, -(-c // BLOCK)))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    return anchors.groupBy("dim", F.pmod(F.xxhash64("id"), F.get(F.array(n), F.lit(0))[F.col("dim")]).alias("block")).agg(F.collect_list(F.struct("id", "label", "v", *extra)).alias("anchors"))


def _met(blocks: DataFrame, packed: DataFrame, run, schema: str) -> DataFrame:
    """``run`` of every block of anchors and every bundle of tiles of its dimension: the stated query set against all rows, in blocks."""
    tile = F.struct("dim", "tile", "piece", "ids", "labels", "v", "ends")
    bundles = staged(packed.groupBy("dim", "bundle").agg(F.collect_list(tile).alias("tiles")))
    tasks = max(1, bundles.count())  # few rows, but each is much work
    asked = bundles.groupBy("dim").agg(F.collect_list("bundle").alias("bundles"))
    pairs = blocks.join(asked, "dim").withColumn("bundle", F.explode("bundles")).drop("bundles")
    dealt = pairs.repartition(tasks, "dim", "bundle").hint("merge").join(bundles.repartition(tasks, "dim", "bundle"), ["dim", "bundle"])
    return dealt.select("bundle", "anchors", "tiles").mapInArrow(run, schema)


def _pairs(batches):
    """The anchors and the tree of each pair; the tree of a bundle is kept while its blocks go by."""
    name = tree = None
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            bundle = one.column(0)[0].as_py()
            packed = one.column(2)[0].as_py()
            here = (bundle, packed[0]["dim"])
            if here != name:
                packed.sort(key=lambda p: (p["tile"], p["piece"]))
                name, tree = here, Tree(packed)
            yield one.column(1)[0].as_py(), tree


def mine(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", anchor: int = ANCHOR, wrong_label: int | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a key divisible by
    ``anchor``) and each of its positives the negatives whose score lies in ``low`` to 100 hundredths of the positive's.

    ``wrong_label``: where it divides the key, the label first becomes the next of LABELS, as a test of label noise."""
    own = prepared(rows, key, vector, label)
    if wrong_label:
        own = own.withColumn("label", F.when(F.col("id") % wrong_label == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    own = staged(own)
    packed = tiles(own)
    anchors = own.where(F.col("id") % anchor == 0)

    def near(batches):
        for asked, tree in _pairs(batches):
            ids, labels, a = np.array([r["id"] for r in asked]), np.array([r["label"] for r in asked]), np.array([r["v"] for r in asked], np.int64)
            found = search(tree, ids, labels, a, True, [[(-np.inf, np.inf)]] * len(ids), positives)
            got = [(int(i), int(lab), int(p), int(s)) for i, lab, (b,) in zip(ids, labels, found) for p, s in zip(b.ids, b.scores)]
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(4)], ["anchor_id", "anchor_label", "positive_id", "positive_score"])

    from_bundles = staged(_met(_blocks(anchors, []), packed, near, "anchor_id long, anchor_label long, positive_id long, positive_score long"))
    best = lambda c: F.array_sort(F.collect_set(F.struct((-F.col(f"{c}_score")).alias("s"), F.col(f"{c}_id").alias("i"))))
    from_bundles = from_bundles.groupBy("anchor_id", "anchor_label", "positive_id").agg(F.max("positive_score").alias("positive_score"))
    chosen = from_bundles.groupBy("anchor_id", "anchor_label").agg(F.slice(best("positive"), 1, positives).alias("positives"))
    asked = anchors.join(chosen, (F.col("id") == F.col("anchor_id")) & (F.col("label") == F.col("anchor_label"))).drop("anchor_id", "anchor_label")

    def hard(batches):
        for asked, tree in _pairs(batches):
            ids, labels, a = np.array([r["id"] for r in asked]), np.array([r["label"] for r in asked]), np.array([r["v"] for r in asked], np.int64)
            # 100 * negative >= low * positive, in whole numbers
            windows = [[(-(low * p["s"] // 100), -p["s"]) for p in r["positives"]] for r in asked]
            found = search(tree, ids, labels, a, False, windows, negatives)
            got = [(int(i), int(lab), p["i"], -p["s"], int(x), int(s)) for i, lab, r, bs in zip(ids, labels, asked, found) for p, b in zip(r["positives"], bs) for x, s in zip(b.ids, b.scores)]
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.int64()) for j in range(6)], ["anchor_id", "anchor_label", "positive_id", "positive_score", "negative_id", "negative_score"])

    met = staged(_met(_blocks(asked, ["positives"]), packed, hard, "anchor_id long, anchor_label long, positive_id long, positive_score long, negative_id long, negative_score long"))
    pair = ["anchor_id", "anchor_label", "positive_id", "positive_score"]
    met = met.groupBy(*pair, "negative_id").agg(F.max("negative_score").alias("negative_score"))
    ranked = met.groupBy(*pair).agg(F.slice(best("negative"), 1, negatives).alias("n"))
    out = ranked.select("anchor_id", "positive_id", "positive_score", F.posexplode("n").alias("pos", "n"))
    return out.select("anchor_id", "positive_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("n.i").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))
