"""Embedding near-dedup by dual traversal of cover trees: every pair of vectors whose cosine reaches a threshold, exactly.

On unit vectors a cosine of at least t is a distance of at most sqrt(2 - 2 t). Equal vectors are one node, which
stands for all their ids. The top of the tree is a set of pivots; each node belongs to the cell of its nearest.
A task builds the tree of a cell: a tree node covers its points with centres that lie more than half its radius
apart, the first of which is its own (nested levels, halving radii; levels on which nothing happens are left
out, and a node whose first centres take hardly any points stays whole, as halving prunes nothing there). Two
tree nodes are left aside if their centres are farther apart than both covering radii and the threshold's
distance; of those that aren't, the points are compared in blocks.

A cell's tree travels in subtrees of about ``SUBTREE`` points. Cells are put together in groups of about
``group`` points, near ones first, and a task compares two groups; a subtree goes to another group's task only
if its ball comes near one of that group's cells. Cells that hold more than ``cell`` points, as when a third of
all vectors are alike, are split by hash, so no task holds more than two groups however the vectors lie. The
pivots, at most ``PIVOTS``, are broadcast: with more cells than that, each is split in more parts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sextant.llm.common import blocks, cut, map_batches, shared_groups

LEAST_COSINE = 0.95
#: Vectors in a part of a cell, about, and pivots at most.
CELL = 2048
PIVOTS = 4096
#: Vectors of a group at most; a task compares two.
GROUP = 1 << 16
SUBTREE, LEAF = 256, 64
#: After so many centres a node stays whole if these took fewer than ``_FEW`` points each.
_PROBE, _FEW = 32, 4
_COLUMNS = 8192


def _slack(dim: int) -> float:
    """Bound of the error of a distance that is computed from products of 32-bit unit vectors."""
    return 2 * float(np.sqrt((dim + 8) * 2.0**-23))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


class Node:
    """A centre, the largest distance to a point below, and either children or the points themselves."""

    __slots__ = ("centre", "radius", "points", "children")

    def __init__(self, centre: int, radius: float, points: np.ndarray, children: list[Node]):
        self.centre, self.radius, self.points, self.children = centre, radius, points, children


def build(x: np.ndarray, points: np.ndarray, leaf: int = 1) -> Node:
    """The cover tree of these rows of ``x``; nodes of at most ``leaf`` points aren't split."""
    todo: list[tuple[int, np.ndarray, list]] = [(int(points[0]), points, top := [])]
    made = []
    squares = (x * x).sum(1)
    while todo:  # down: covers; children are put together on the way up, as made has parents before children
        centre, points, home = todo.pop()
        far = np.sqrt(np.maximum(((x[points] - x[centre]) ** 2).sum(1), 0))
        radius = float(far.max())
        below: list = []
        made.append((centre, radius, points, below, home))
        if len(points) <= leaf or radius <= 1e-6:
            continue
        reach = 2.0 ** np.ceil(np.log2(radius)) / 2
        left, chosen, farthest, covers = points, centre, int(points[int(far.argmax())]), []
        while len(left):
            rows = x[left]
            if reach < 0.05:  # products are too coarse there
                near = ((rows - x[chosen]) ** 2).sum(1) <= reach * reach
            else:
                near = squares[left] + squares[chosen] - 2 * (rows @ x[chosen]) <= reach * reach
            near |= left == chosen
            if chosen == centre:
                near &= left != farthest  # rounding mustn't leave all points with one centre for ever
            covers.append((chosen, left[near], below))
            left = left[~near]
            if leaf > 1 and len(covers) == _PROBE and len(points) - len(left) < _FEW * _PROBE and len(left):
                covers = []
                break
            if len(left):
                chosen = int(left[0])
        todo += covers
    for centre, radius, points, below, home in reversed(made):
        home.append(Node(centre, radius, points, below))
    return top[0]


def traverse(x: np.ndarray, a: Node, y: np.ndarray, b: Node, limit: float, visit: Callable[[Node, list[Node]], None], same: bool = False) -> None:
    """Calls ``visit`` with each leaf of the one tree and the leaves of the other that have points within ``limit``, about.

    A node of the one tree goes down with all the nodes of the other that lie near it, so that their children
    are compared in one product. If the trees are the ``same``, of two leaves it is the one with the lesser first
    point that is called with both.
    """
    limit += _slack(x.shape[1])
    todo: list[tuple[Node, list[Node]]] = [(a, [b])]
    while todo:
        p, others = todo.pop()
        ps = p.children or [p]
        qs = [c for q in others for c in (q.children or (q,))]
        pr, qr = np.array([c.radius for c in ps], np.float32), np.array([c.radius for c in qs], np.float32)
        near = _distances(x[[c.centre for c in ps]], y[[c.centre for c in qs]]) <= pr[:, None] + qr[None, :] + limit
        if same:  # points are runs of rows here
            near &= np.array([c.points[-1] for c in qs])[None, :] >= np.array([c.points[0] for c in ps])[:, None]
        for i in np.flatnonzero(near.any(1)).tolist():
            mine = [qs[j] for j in np.flatnonzero(near[i]).tolist()]
            if ps[i].children or any(q.children for q in mine):
                todo.append((ps[i], mine))
            else:
                visit(ps[i], mine)


def _subtrees(x: np.ndarray, root: Node) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """Runs of about SUBTREE rows, in the order of the tree, and their nodes (centre, radius, start, end, parent) within the run."""

    def run(nodes: list[Node]) -> tuple[np.ndarray, list[tuple]]:
        rows = np.concatenate([n.points for n in nodes])
        radius = float(np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(1)).max())
        order: list[np.ndarray] = []
        flat: list[list] = [[int(rows[0]), radius, 0, len(rows), -1]]
        todo, at = [(n, 0) for n in reversed(nodes)], 0
        while todo:
            n, parent = todo.pop()
            flat.append([n.centre, n.radius, at, at + len(n.points), parent])
            if n.children:
                todo += [(c, len(flat) - 1) for c in reversed(n.children)]
            else:
                order.append(n.points)
                at += len(n.points)
        rows = np.concatenate(order)
        place = {r: i for i, r in enumerate(rows.tolist())}
        return rows, [(place[c], *rest) for c, *rest in (flat if len(nodes) > 1 else [[*f[:4], f[4] - 1] for f in flat[1:]])]

    todo: list[Node] = [root]
    held: list[Node] = []
    size = 0
    while todo:
        n = todo.pop()
        if len(n.points) > SUBTREE:
            todo += n.children or [Node(int(n.points[i]), float(np.sqrt(((x[n.points[i : i + SUBTREE]] - x[n.points[i]]) ** 2).sum(1)).max()), n.points[i : i + SUBTREE], []) for i in range(0, len(n.points), SUBTREE)]
            continue
        if size + len(n.points) > SUBTREE:
            yield run(held)
            held, size = [], 0
        held.append(n)
        size += len(n.points)
    if held:
        yield run(held)


def _forest(trees: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Node]:
    """Ids, weights and unit vectors of these subtrees' rows, and a node above them all."""
    ids, weights = np.concatenate([t[0] for t in trees]), np.concatenate([t[1] for t in trees])
    x = _units(np.concatenate([t[2] for t in trees]))
    every, below, base = np.arange(len(ids)), [], 0
    for _, _, raw, flat in trees:
        made: list[Node] = []
        for centre, radius, start, end, parent in flat:
            made.append(Node(base + centre, radius, every[base + start : base + end], []))
            if parent >= 0:
                made[parent].children.append(made[-1])
        below.append(made[0])
        base += len(raw)
    return ids, weights, x, Node(0, 4.0, every, below)


def _units(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _usable(values: pa.ListArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a direction, and their vectors; raises ValueError if lengths differ."""
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    whole = np.flatnonzero(lengths > 0)
    if len(np.unique(lengths[whole])) > 1:
        raise ValueError("embeddings differ in length")
    if not len(whole):
        return whole, np.zeros((0, 0), kind)
    flat = values.take(pa.array(whole)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(len(whole), -1)  # nulls become NaN
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return whole[good], np.ascontiguousarray(x[good])


def _chain(centres: np.ndarray) -> np.ndarray:
    """An order in which each centre is followed by the nearest of those left."""
    left = np.arange(len(centres))
    out = [0]
    left = left[1:]
    while len(left):
        k = int((centres[left] @ centres[out[-1]]).argmax())
        out.append(int(left[k]))
        left = np.delete(left, k)
    return np.array(out)


def _compared(vectors: DataFrame, least: float, cell: int, group: int, pivots: int, found: Callable, schema: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (``id, v``; v is null where there is no direction), nodes (``v, node, m``), and what ``found`` makes of all pairs within the threshold."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    spark = vectors.sparkSession
    limit = float(np.sqrt(max(0.0, 2 - 2 * least)))
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType())
    kind: type = np.float32 if single else np.float64
    wanted = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v")).where("id is not null")

    def read(batches):
        for batch in batches:
            rows, x = _usable(batch.column(1), kind)
            out: list[bytes | None] = [None] * batch.num_rows
            for i, v in zip(rows.tolist(), x):
                out[i] = v.tobytes()
            yield [batch.column(0), pa.array(out, pa.binary())]

    rows = map_batches(wanted, read, "id long, v binary")
    nodes = cut(rows.where("v is not null").distinct().groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("m")))
    size = nodes.agg(F.count(F.lit(1)).alias("n"), F.min(F.length("v")).alias("a"), F.max(F.length("v")).alias("b")).first()
    if not size.n:
        return rows, nodes, None
    if size.a != size.b:
        raise ValueError("embeddings differ in length")
    count = max(1, min(pivots, -(-size.n // cell)))
    top = nodes.orderBy(F.xxhash64("v"), "v").limit(count).toArrow().column("v").to_pylist()
    top = _units(np.frombuffer(b"".join(top), kind).reshape(len(top), -1))
    top = top[_chain(top)].astype(np.float32)
    shared = spark.sparkContext.broadcast(top)

    def assign(batches):
        for batch in batches:
            x = _units(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(batch.num_rows, -1)).astype(np.float32)
            nearest = np.concatenate([(x[i : i + 4096] @ shared.value.T).argmax(1) for i in range(0, len(x), 4096)]).astype(np.int32)
            far = np.sqrt(((x - shared.value[nearest]) ** 2).sum(1))
            yield [nearest, far, *batch.columns]

    cells = map_batches(nodes, assign, "cell int, far double, v binary, node long, m long")
    balls = cells.groupBy("cell").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("cell").toArrow()
    number, radius = balls["cell"].to_numpy(), balls["radius"].to_numpy()
    parts = -(-balls["n"].to_numpy() // cell)
    first = np.cumsum(parts) - parts
    # groups: small enough to hold, and enough of them to keep all cores busy
    groups = min(int(parts.sum()), max(-(-size.n // group), int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))))
    per_group = -(-int(parts.sum()) // groups)
    slots, many = np.zeros(len(top), np.int64), np.ones(len(top), np.int64)
    slots[number], many[number] = first, parts
    layout = spark.sparkContext.broadcast((number, radius, first // per_group, (first + parts - 1) // per_group))
    slot = F.element_at(F.lit(slots.tolist()).cast("array<long>"), F.col("cell") + 1) + F.pmod(F.xxhash64("v"), F.element_at(F.lit(many.tolist()).cast("array<long>"), F.col("cell") + 1))

    def grow(batches):
        for table in blocks(batches, 0):
            at = table.column("slot").to_numpy()
            for a, b in shared_groups(at):
                own = table.slice(a, b - a)
                ids, m = own.column("node").to_numpy(), own.column("m").to_numpy()
                raw = np.frombuffer(b"".join(own.column("v").to_pylist()), kind).reshape(b - a, -1)
                order = np.argsort(ids, kind="stable")
                ids, m, raw = ids[order], m[order], raw[order]
                x = _units(raw).astype(np.float32)
                trees = [(ids[r], m[r], raw[r], flat) for r, flat in _subtrees(x, build(x, np.arange(len(x)), LEAF))]
                yield from route(int(at[a]) // per_group, trees)

    def route(g: int, trees: list[tuple]) -> Iterator[list]:
        number, radius, low, high = layout.value
        centres = _units(np.stack([raw[flat[0][0]] for _, _, raw, flat in trees])).astype(np.float32)
        reach = np.array([flat[0][1] for _, _, _, flat in trees])
        near = _distances(centres, shared.value[number]) <= reach[:, None] + radius[None, :] + limit + _slack(centres.shape[1])
        last = int(high.max()) + 1
        goes = np.zeros((len(trees), last + 1), np.int64)
        for t, c in zip(*np.nonzero(near)):
            goes[t, low[c]] += 1
            goes[t, high[c] + 1] -= 1
        goes = np.cumsum(goes, 1)[:, :last] > 0
        for h in np.flatnonzero(goes.any(0)).tolist():
            blob = pickle.dumps([trees[t] for t in np.flatnonzero(goes[:, h])], 5)
            yield [[min(g, h) * last + max(g, h)], [g > h], pa.array([blob], pa.binary())]

    def compare(batches):
        for table in blocks(batches, 0, 1):
            pair = table.column(0).to_numpy()
            for start, end in shared_groups(pair):
                sides: list[list] = [[], []]
                for second, blob in zip(table.column(1).slice(start, end - start).to_pylist(), table.column(2).slice(start, end - start).to_pylist()):
                    sides[second] += pickle.loads(blob)
                last = int(layout.value[3].max()) + 1
                same = pair[start] // last == pair[start] % last
                if sides[0] and (same or sides[1]):
                    one = _forest(sides[0])
                    yield from found(one, one if same else _forest(sides[1]), same, limit, least)

    placed = cells.select(slot.alias("slot"), "v", "node", "m")
    # the tree of a part is built by the task that gets its rows; its subtrees then go to the tasks of the pairs of groups
    trees = map_batches(placed.repartition(max(1, min(int(parts.sum()), 4096)), "slot").sortWithinPartitions("slot"), grow, "pair long, second boolean, trees binary")
    tasks = max(1, min(groups * (groups + 1) // 2, 4096))
    return rows, nodes, map_batches(cut(trees).repartition(tasks, "pair").sortWithinPartitions("pair"), compare, schema)


def _hits(one: tuple, two: tuple, same: bool, limit: float, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the two forests whose cosine is at least ``least``; in one and the same, each pair once."""
    x, y = one[2], two[2]
    f, g = x.astype(np.float32), y.astype(np.float32)
    error = (x.shape[1] + 8) * 2.0**-22
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def visit(p: Node, others: list[Node]) -> None:
        rows, columns = p.points, np.concatenate([q.points for q in others])
        for a in range(0, len(columns), _COLUMNS):
            some = columns[a : a + _COLUMNS]
            cosine = f[rows] @ g[some].T
            at = np.flatnonzero(cosine.ravel() >= least - error)
            i, j = rows[at // len(some)], some[at % len(some)]
            unsure = cosine.ravel()[at] < least + error
            keep = j > i if same else np.ones(len(i), bool)
            unsure &= keep
            keep[unsure] = np.einsum("ij,ij->i", x[i[unsure]], y[j[unsure]]) >= least
            out.append((i[keep], j[keep]))

    todo = [(p, [q for q in two[3].children]) for p in one[3].children]
    for p, others in todo:  # a subtree of the one at a time bounds what is held
        traverse(f, Node(p.centre, p.radius, p.points, [p]), g, Node(0, 4.0, two[3].points, others), limit, visit, same)
        yield from out
        out.clear()


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of rows after ``i`` and ``j`` are linked: the least row of each group."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def _counted(one: tuple, two: tuple, same: bool, limit: float, least: float) -> Iterator[list]:
    n, m = len(one[0]), 0 if same else len(two[0])
    ids, weight = (one[0], one[1]) if same else (np.concatenate([one[0], two[0]]), np.concatenate([one[1], two[1]]))
    label, counts = np.arange(n + m), np.zeros(n + m, np.int64)
    for i, j in _hits(one, two, same, limit, least):
        j = j if same else j + n
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        label = _joined(label, i, j)
    hit = np.flatnonzero(counts)
    if len(hit):
        yield [ids[hit], counts[hit], ids[label[hit]]]


def _paired(one: tuple, two: tuple, same: bool, limit: float, least: float) -> Iterator[list]:
    for i, j in _hits(one, two, same, limit, least):
        for a in range(0, len(i), 100_000):
            p, q = i[a : a + 100_000], j[a : a + 100_000]
            u, v = one[0][p], two[0][q]
            yield [np.minimum(u, v), np.maximum(u, v), np.minimum(np.einsum("ij,ij->i", one[2][p], two[2][q]), 1.0)]


def near_pairs(vectors: DataFrame, least: float = LEAST_COSINE, cell: int = CELL, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """``vec_id_a < vec_id_b, cosine`` of every two different vectors whose cosine is at least ``least``.

    Equal vectors stand under the least of their ids (``near_groups`` has the membership). Null, empty and zero
    vectors, those with a null or an infinite element and null ids are in no pair. Vectors of different lengths
    raise ValueError. An id isn't paired with itself. Other columns aren't read. Pairs at the very threshold
    count; ties have no order.
    """
    schema = "vec_id_a long, vec_id_b long, cosine double"
    _, _, found = _compared(vectors, least, cell, group, pivots, _paired, schema)
    return vectors.sparkSession.createDataFrame([], schema) if found is None else found.where("vec_id_a <> vec_id_b").groupBy("vec_id_a", "vec_id_b").agg(F.max("cosine").alias("cosine"))


def near_groups(vectors: DataFrame, least: float = LEAST_COSINE, cell: int = CELL, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """``vec_id, class_id, n_links`` of every id: its class, named by the least id in it, and how many others are near it.

    Vectors are of one class if chains of pairs whose cosine is at least ``least`` join them; ``n_links`` is the
    number of other vectors that near, copies counted each. Null, empty and zero vectors and those with a null or
    an infinite element are alone, without links; rows with a null id are left out. Rows that share an id and a
    vector count once; an id with several vectors counts the links of each, those between them too, and has the
    least of their classes. Vectors of different lengths raise ValueError. Other columns aren't read. No rows
    give none.
    """
    from sextant.llm.minhash import components

    rows, nodes, found = _compared(vectors, least, cell, group, pivots, _counted, "node long, n long, root long")
    if found is None:
        return rows.select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")).distinct()
    found = cut(found)
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("n").alias("links"))
    classes = nodes.join(links, "node", "left").join(labels, "node", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.coalesce("label", "node").alias("label"))
    named = rows.distinct().join(classes, "v", "left")
    return named.groupBy(F.col("id").alias("vec_id")).agg(F.min(F.coalesce("label", "id")).alias("class_id"), F.sum(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
