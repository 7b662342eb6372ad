"""Problem 4: the most similar vectors for every vector.

Method: a hierarchical k-means tree is trained on a sample in proportion to the leaves it shall have
(``PER_LEAF`` vectors a leaf, ``SAMPLE`` in all at most) and every vector is assigned to a leaf. Queries
traverse the tree best bin first: a priority queue of nodes, ordered by their likeness, is kept for each
query (for a whole batch at once), the best node is taken out, its children are put in, and leaves are
visited in that order until the best node left, with its ancestors, is less like the query than its best
siblings are by more than a margin. The margin is calibrated: for ``ASKED`` sampled queries a field the true nearest neighbours are
found among all vectors, and visits are widened until ``recall`` of them lie in a visited leaf. In a leaf
the query meets all members by matrix products.

A leaf is one key: its members come first, at most ``LEAF_MAX``, and queries are streamed past them, so
that a worker's memory does not depend on how many there are. A leaf with more members is split into
blocks, each a key of its own that all its queries visit, so it is searched whole. Fields with at most
``leaf`` vectors are one leaf each and need no tree.

Beyond ``SAMPLE / PER_LEAF`` leaves (150 million vectors at the default size of a leaf) the number of
leaves grows no more and leaves are searched in more blocks.

Vectors that are null, zero, not of ``dim`` numbers, or hold numbers that are not finite belong to no
result; a repeated vec_id counts once; equal vectors are one class that is searched once by its least
id, and its copies are each other's nearest. Units are kept as 24-bit fixed-point numbers; this changes a
cosine by about 1e-7.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.util import settle

DIM = 64
#: Vectors of the sample, at least (if there are as many) and at most, and for each leaf that is wanted.
SAMPLE_LEAST, SAMPLE, PER_LEAF = 20_000, 400_000, 16
#: Sampled queries whose true neighbours calibrate the visits, of each field; neighbours from which no synthetic ones are added.
ASKED, ENOUGH = 2000, 100
BRANCH = 6
#: Members that a leaf is meant to hold, and beyond which it is searched in blocks.
LEAF, LEAF_MAX = 6_000, 18_000
#: Bytes that a task of the search is meant to read.
TASK_BYTES = 24 << 20


class Tree:
    """Centroids of all nodes, children of each inner node, the number of each leaf and the way to it."""

    def __init__(self, sample: np.ndarray, leaf_sample: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        centroids, children, parent, self.leaf_node = [np.zeros(DIM, np.float32)], [[]], [-1], []
        leaf = [-1]
        todo = [(0, sample)]
        while todo:
            node, x = todo.pop()
            parts = [] if len(x) <= max(leaf_sample, 2 * BRANCH) else self._split(x, rng)
            if len(parts) < 2:
                leaf[node] = len(self.leaf_node)
                self.leaf_node.append(node)
                continue
            for c, part in parts:
                children[node].append(len(centroids))
                centroids.append(c)
                children.append([])
                parent.append(node)
                leaf.append(-1)
                todo.append((len(centroids) - 1, part))
        self.n_leaves = len(self.leaf_node)
        self.c, self.leaf = np.stack(centroids).astype(np.float32), np.array(leaf)
        self.kids = np.full((len(children), BRANCH), -1, dtype=np.int32)
        for i, c in enumerate(children):
            self.kids[i, : len(c)] = c
        ways = []
        for node in self.leaf_node:
            way = []
            while node > 0:
                way.append(node)
                node = parent[node]
            ways.append(way)
        depth = max(1, *map(len, ways)) if len(ways) > 1 else 1
        self.way = np.array([w + [0] * (depth - len(w)) for w in ways], dtype=np.int32)
        self.parent = np.array(parent)

    @staticmethod
    def _split(x: np.ndarray, rng) -> list:
        k = min(BRANCH, max(2, len(x) // 2))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            at = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[at == i].sum(axis=0) if (at == i).any() else x[rng.integers(len(x))] for i in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        at = np.argmax(x @ c.T, axis=1)
        return [(c[i], x[at == i]) for i in range(k) if (at == i).any()]

    def visit(self, q: np.ndarray, margin: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home, row, leaf): each row's first leaf, best bin first, and the leaves that rows visit, the first
        among them. A node's place in the queue is how much less like the query it and its ancestors are than
        their best siblings, in sum; visits end beyond ``margin``. None stops at the first leaf."""
        n = len(q)
        home = np.full(n, -1, dtype=np.int64)
        rows, leaves = [home[:0]], [home[:0]]
        width = 4 * BRANCH
        queue, behind = np.full((n, width), -1, dtype=np.int32), np.full((n, width), np.inf, dtype=np.float32)
        queue[:, 0], behind[:, 0] = 0, 0.0
        filled, live = np.ones(n, dtype=np.int64), np.arange(n)
        while len(live):
            at = np.argmin(behind[live], axis=1)
            top = behind[live, at]
            ok = top <= (margin or 0.0)
            live, at, top = live[ok], at[ok], top[ok]
            node = queue[live, at]
            behind[live, at] = np.inf
            number = self.leaf[node]
            done = number >= 0
            r = live[done]
            rows.append(r), leaves.append(number[done])
            new = home[r] < 0
            home[r[new]] = number[done][new]
            r, node, top = live[~done], node[~done], top[~done]
            for below in np.unique(node).tolist():  # the rows at one node meet its children at once
                here = node == below
                mine, kid = r[here], self.kids[below]
                kid = kid[kid >= 0]
                if filled[mine].max() + len(kid) > width:
                    queue = np.pad(queue, ((0, 0), (0, width)), constant_values=-1)
                    behind = np.pad(behind, ((0, 0), (0, width)), constant_values=np.inf)
                    width *= 2
                to = filled[mine][:, None] + np.arange(len(kid))
                like = q[mine] @ self.c[kid].T
                queue[mine[:, None], to] = kid
                behind[mine[:, None], to] = top[here][:, None] + like.max(axis=1, keepdims=True) - like
                filled[mine] += len(kid)
            if margin is None:
                live = live[home[live] < 0]
        return home, np.concatenate(rows), np.concatenate(leaves)

    def needed(self, q: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The margin with which each row of ``q`` gets to its ``leaf``."""
        out = np.zeros(len(q), np.float32)
        for d in range(self.way.shape[1]):
            node = self.way[leaf, d]
            on = np.flatnonzero(node > 0)
            family = self.kids[self.parent[node[on]]]
            like = np.where(family >= 0, np.einsum("ij,ikj->ik", q[on], self.c[family]), -2)
            out[on] += like.max(axis=1) - like[family == node[on][:, None]]
        return out


def synthetic(tree: Tree, x: np.ndarray, cosine: float, seed: int = 11) -> np.ndarray:
    """Margins needed for targets at ``cosine`` in random directions, where true ones are too few."""
    rng = np.random.default_rng(seed)
    noise = rng.standard_normal(x.shape).astype(np.float32)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    y = (cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * noise).astype(np.float32)
    return tree.needed(y, tree.visit(x, None)[0])


def pack(x: np.ndarray) -> np.ndarray:
    """Numbers from -1 to 1 as 24-bit fixed-point bytes."""
    whole = np.clip(np.rint(x * float(1 << 23)), 1 - (1 << 23), (1 << 23) - 1).astype("<i4")
    return np.ascontiguousarray(whole.view(np.uint8).reshape(len(x), DIM, 4)[:, :, :3]).reshape(len(x), 3 * DIM)


def unpack(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, DIM, 3)
    out = np.zeros((len(b), DIM, 4), np.uint8)
    out[:, :, 1:] = b
    return out.view("<i4")[:, :, 0].astype(np.float32) * np.float32(2.0**-31)


def _blobs(x: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values, without Python objects."""
    flat = np.ascontiguousarray(x).reshape(-1)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _joined(column: pa.Array) -> bytes:
    """The bytes of a binary column one after another."""
    if not len(column):
        return b""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[int(offsets[0]) : int(offsets[-1])]


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, field_name, unit): usable vectors, scaled to length 1, as packed bytes."""

    def run(batches):
        for b in batches:
            lens = np.array([len(x) if x.is_valid else -1 for x in b.column("embedding")])
            flat = b.column("embedding").filter(pa.array(lens == DIM)).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)
            ok = np.isfinite(x).all(axis=1)
            x[~ok] = 0
            top = np.abs(x).max(axis=1, initial=0)
            ok &= top > 0
            x = x / np.where(ok, top, 1)[:, None]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            rows = pa.array(np.flatnonzero(lens == DIM)[ok])
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(rows), b.column("field_name").take(rows), _blobs(pack(x[ok]))], ["vec_id", "field_name", "unit"])

    return vectors.where("vec_id is not null and field_name is not null and embedding is not null").select(F.col("vec_id").cast("bigint"), "field_name", F.col("embedding").cast("array<float>")).mapInArrow(run, "vec_id bigint, field_name string, unit binary")


class Index:
    """The trees of the fields with more than a leaf of vectors, their margins and their crowded leaves."""

    def __init__(self):
        self.fields: list[str] = []
        self.trees: list[Tree] = []
        self.asked: list[np.ndarray] = []
        self.kth: list[np.ndarray] = []
        self.margins: list[float] = []
        self.blocks: dict[int, int] = {}

    def split(self, field: np.ndarray):
        """(number of the field's tree, rows) over a batch's fields; None for rows that need no tree."""
        rest = np.ones(len(field), bool)
        for number, f in enumerate(self.fields):
            at = np.flatnonzero(field == f)
            if len(at):
                rest[at] = False
                yield number, at
        if rest.any():
            yield None, np.flatnonzero(rest)


def index(units: DataFrame, k: int, cosine: float, recall: float, leaf: int, both: bool, least: float) -> Index:
    """Trees and margins. Three passes: counts by field, the sample, and true neighbours with sizes of leaves."""
    out = Index()
    # A field with a tree has more than ``leaf`` vectors, so these rows are fewer than the leaves.
    sizes = {r["field_name"]: r["count"] for r in units.groupBy("field_name").count().where(F.col("count") > leaf).collect()}
    if not sizes:
        return out
    total = sum(sizes.values())
    wanted = min(SAMPLE, max(SAMPLE_LEAST * len(sizes), PER_LEAF * total // leaf))
    cut = int(1e6 * min(1.0, 1.05 * wanted / total)) + 1
    out.fields = sorted(sizes)
    rows = units.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < cut).where(F.col("field_name").isin(out.fields)).select("field_name", "unit").limit(int(1.5 * wanted)).collect()
    got: dict[str, list] = {f: [] for f in out.fields}
    for r in rows:
        got[r["field_name"]].append(bytes(r["unit"]))
    rng = np.random.default_rng(3)
    for f in out.fields:
        x = unpack(b"".join(got[f])) if got[f] else np.eye(1, DIM, dtype=np.float32)
        out.trees.append(Tree(x, leaf * len(x) / sizes[f]))
        asked = x[rng.choice(len(x), min(len(x), ASKED), replace=False)]
        like = asked @ x.T
        like[like > SAME] = -2
        out.asked.append(asked)
        out.kth.append(np.maximum(np.sort(like, axis=1)[:, -min(k, len(x))], least) - 1e-6)

    shipped = units.sparkSession.sparkContext.broadcast(out)

    def run(batches):
        held = shipped.value
        kth, at_home = [x.copy() for x in held.kth], [t.visit(a, None)[0] for t, a in zip(held.trees, held.asked)]
        counted: dict[int, np.ndarray] = {}
        for b in batches:
            x = unpack(_joined(b.column("unit")))
            for number, at in held.split(b.column("field_name").to_numpy(zero_copy_only=False)):
                if number is None:
                    continue
                tree, asked, own = held.trees[number], held.asked[number], kth[number]
                home = tree.visit(x[at], None)[0]
                counted[number] = counted.get(number, 0) + np.bincount(home, minlength=tree.n_leaves)
                like = asked @ x[at].T
                q, t = np.nonzero((like >= own[:, None]) & (like <= SAME))
                if len(q):
                    need = tree.needed(asked[q], home[t])
                    if both:
                        need = np.minimum(need, tree.needed(x[at[t]], at_home[number][q]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), number, np.int32)), pa.array(q.astype(np.int64)), pa.array(like[q, t].astype(np.float64)), pa.array(need.astype(np.float64))], ["field", "item", "like", "need"])
                    for i in np.unique(q):  # what is found raises what is looked for
                        best = np.sort(like[i][(like[i] >= own[i]) & (like[i] <= SAME)])
                        if len(best) >= k:
                            own[i] = max(own[i], best[-k])
        for number, n in counted.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), -1 - number, np.int32)), pa.array(np.arange(len(n))), pa.array(n.astype(np.float64)), pa.array(np.zeros(len(n)))], ["field", "item", "like", "need"])

    seen = settle(units.select("field_name", "unit").mapInArrow(run, "field int, item bigint, like double, need double"))
    for r in seen.where("field < 0").groupBy("field", "item").agg(F.sum("like").alias("n")).where(F.col("n") > LEAF_MAX).collect():
        out.blocks[(-1 - r["field"] << 40) + r["item"]] = math.ceil(r["n"] / leaf)
    w = Window.partitionBy("field", "item").orderBy(F.desc("like"))
    needs: dict[int, list] = {}
    for r in seen.where("field >= 0").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("field", "need").collect():
        needs.setdefault(r["field"], []).append(r["need"])
    for number, (tree, asked) in enumerate(zip(out.trees, out.asked)):
        need = np.array(needs.get(number, []))
        if len(need) < ENOUGH:
            need = np.concatenate([need, synthetic(tree, asked, cosine)])
        out.margins.append(float(np.quantile(need, recall, method="higher")) + 1e-6)
    return out


#: From this likeness vectors count as copies where neighbours are sampled.
SAME = 1 - 2e-6
#: Digits to which cosines count as equal; single precision and this rounding change a cosine by less than CLOSE.
DIGITS, CLOSE = 6, 2e-6
#: Candidates kept per leaf beyond k where they are not crowded.
MORE = 3


def _top(x: np.ndarray, ids: np.ndarray, mx: np.ndarray, mi: np.ndarray, k: int, low: float):
    """(row, column, cosine): for each of the queries ``x`` all members ``mx`` that can be among its k nearest,
    equal cosines by id. Where the candidates beyond the k-th are too close to tell, all members are compared
    in double precision."""
    sim = x @ mx.T
    sim[ids[:, None] == mi[None, :]] = -2
    n = min(k + MORE, len(mi))
    top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
    kept = np.sort(np.take_along_axis(sim, top, axis=1), axis=1)
    crowded = (kept[:, 0] >= max(low, -1.5) - CLOSE) & (kept[:, 0] >= kept[:, -min(k, n)] - CLOSE) if n < len(mi) else np.zeros(len(x), bool)
    row, col = np.repeat(np.flatnonzero(~crowded), n), top[~crowded].ravel()
    ok = sim[row, col] >= max(low - CLOSE, -1.5)
    row, col = row[ok], col[ok]
    exact = np.einsum("ij,ij->i", x[row].astype(np.float64), mx[col].astype(np.float64))
    rows, cols, cosines = [row], [col], [exact]
    if crowded.any():
        order = np.argsort(mi, kind="stable")
        far = mx[order].astype(np.float64).T
        at = np.flatnonzero(crowded)
        for s in range(0, len(at), 256):
            q = at[s : s + 256]
            near = x[q].astype(np.float64) @ far
            # Rounded cosine first, then place by id, as one whole number.
            rank = -np.round(near * 10**DIGITS).astype(np.int64) * len(mi) + np.arange(len(mi))
            rank[ids[q][:, None] == mi[order][None, :]] = np.iinfo(np.int64).max
            best = np.argpartition(rank, k - 1, axis=1)[:, :k]
            r = np.repeat(np.arange(len(q)), k)
            rows.append(q[r]), cols.append(order[best.ravel()]), cosines.append(near[r, best.ravel()])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(cosines)


def _rows(key, ids, role, ask, x) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(key, len(ids)).astype(np.int64)), pa.array(np.full(len(ids), role, np.int8)), pa.array(ask), pa.array(ids), _blobs(x)], SENT)


SENT = ["key", "role", "ask", "vec_id", "unit"]


def _sent(row, home, leaf, ids, ask, raw, n_blocks):
    """Rows to ship: a vector goes to its home as a member (role 0) that may ask there too, and to the other
    leaves that it visits as a query (role 1). A crowded leaf has a key for each block: a member lies in one and
    asks in all."""
    blocks = np.array([n_blocks.get(int(k), 1) for k in np.unique(home)], np.int64)[np.unique(home, return_inverse=True)[1]]
    own = ids % blocks
    yield _rows(home + (own << 20), ids, 0, ask, raw)
    asking = ask[row] & (leaf != home[row])
    row, leaf = row[asking], leaf[asking]
    more = np.flatnonzero(ask & (blocks > 1))  # the other blocks of the home
    row, leaf = np.concatenate([row, more]), np.concatenate([leaf, home[more]])
    if not len(row):
        return
    each, back = np.unique(leaf, return_inverse=True)
    n = np.array([n_blocks.get(int(k), 1) for k in each], np.int64)[back]
    at = np.repeat(np.arange(len(row)), n)
    block = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    row, leaf = row[at], leaf[at]
    there = (leaf == home[row]) & (block == own[row])
    row, leaf, block = row[~there], leaf[~there], block[~there]
    for lo in range(0, len(row), 8192):
        r = row[lo : lo + 8192]
        yield _rows(leaf[lo : lo + 8192] + (block[lo : lo + 8192] << 20), ids[r], 1, np.ones(len(r), bool), raw[r])


def nearest(vectors: DataFrame, k: int = 5, cosine: float = 0.9, recall: float = 0.998, queries=None, leaf: int = LEAF, least: float = -1.0) -> DataFrame:
    """(vec_a, vec_b, cosine, place): for each query the ``k`` others of its field most alike, place 1 the
    nearest; cosines equal to six digits go by id. ``recall`` is what visits are calibrated for, over the
    sampled queries' true neighbours down to ``least``; where these are too few, targets at ``cosine`` are added.
    ``queries`` is a condition on vec_id, all rows by default; then each of two vectors looks for the
    other, and what one finds counts for both.

    Equal vectors are searched as one class: of a class, each query's nearest copies are those with the
    least ids, so at most k + 1 members of a class ever matter to others."""
    units = settle(unit_vectors(vectors).withColumn("row", F.monotonically_increasing_id()))
    hashes = F.struct(F.xxhash64("unit").alias("h"), F.xxhash64(F.lit("again"), "unit").alias("m"), "row")
    ids = settle(units.groupBy("field_name", "vec_id").agg(F.min(hashes).alias("kept"), F.count(F.lit(1)).alias("times")).select("field_name", "vec_id", "kept.*", "times"))
    # Repeated ids go before the leaves: else each row would take a place in one.
    repeated = settle(ids.where("times > 1").select("field_name", "vec_id", F.col("row").alias("kept")))
    once = units.join(repeated, ["field_name", "vec_id"], "left").where("kept is null or kept = row").drop("kept", "row")
    classes = ids.groupBy("field_name", "h", "m").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    w = Window.partitionBy("rep").orderBy("vec_id")
    copies = settle(ids.join(classes, ["field_name", "h", "m"]).select("field_name", "vec_id", "rep", F.row_number().over(w).alias("nth")))
    reps = once.join(copies.where("vec_id <> rep").select("vec_id"), "vec_id", "left_anti")
    half = queries is None
    made = index(units, k, cosine, recall, leaf, half, least)
    # A class asks if any member of it does.
    asking = reps.withColumn("ask", F.lit(True)) if half else reps.join(copies.where(queries).select(F.col("rep").alias("vec_id"), F.lit(True).alias("by_copy")).distinct(), "vec_id", "left").withColumn("ask", F.coalesce("by_copy", queries))
    shipped = units.sparkSession.sparkContext.broadcast(made)
    # Fields without a tree are a leaf each, in blocks by what they may hold.
    alone = F.when(~F.col("field_name").isin(made.fields), -1 - F.pmod(F.xxhash64("field_name"), F.lit(1 << 62))) if made.fields else -1 - F.pmod(F.xxhash64("field_name"), F.lit(1 << 62))

    def send(batches):
        held = shipped.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                raw = np.frombuffer(_joined(b.column("unit")), np.uint8).reshape(-1, 3 * DIM)
                ids, ask, own = b.column("vec_id").to_numpy(), b.column("ask").to_numpy(zero_copy_only=False).astype(bool), b.column("alone").to_numpy(zero_copy_only=False)
                for number, at in held.split(b.column("field_name").to_numpy(zero_copy_only=False)):
                    if number is None:
                        yield _rows(own[at].astype(np.int64), ids[at], 0, ask[at], raw[at])
                        continue
                    x, base = unpack(raw[at].tobytes()), np.int64(number) << 40
                    home = held.trees[number].visit(x, None)[0] if not ask[at].all() else None
                    here = np.flatnonzero(ask[at])
                    first, row, leaf_no = held.trees[number].visit(x[here], held.margins[number])
                    if home is None:
                        home = first
                    yield from _sent(here[row], base + home, base + leaf_no, ids[at], ask[at], raw[at], held.blocks)

    sent = asking.select("vec_id", "field_name", "unit", "ask", alone.alias("alone")).mapInArrow(send, "key bigint, role tinyint, ask boolean, vec_id bigint, unit binary")
    visits = 1.0
    for tree, asked, margin in zip(made.trees, made.asked, made.margins):
        visits = max(visits, len(tree.visit(asked, margin)[1]) / len(asked))
    rows = units.count() * (visits if half else 1 + visits / 20)
    parts = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * 3.2 * DIM / TASK_BYTES))

    def search(batches):
        key, held, members = None, [], None
        for b in batches:
            keys, roles = b.column("key").to_numpy(), b.column("role").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1]), [True]])) if len(keys) else []
            for lo, hi in zip(edge[:-1], edge[1:]):
                part, part_key, role = b.slice(lo, hi - lo), keys[lo], roles[lo]
                if held and (part_key != key or role):
                    members = _members(held)
                    yield from _asked(members, members[0][members[2]], members[1][members[2]], k, least)
                    held = []
                if part_key != key:
                    key, members = part_key, None
                if role == 0:
                    held.append(part)
                elif members is not None:
                    yield from _asked(members, unpack(_joined(part.column("unit"))), part.column("vec_id").to_numpy(), k, least)
        if held:
            members = _members(held)
            yield from _asked(members, members[0][members[2]], members[1][members[2]], k, least)

    found = sent.repartition(parts, "key").sortWithinPartitions("key", "role").mapInArrow(search, "vec_a bigint, vec_b bigint, cosine double")
    if least > -1:
        found = found.where(F.col("cosine") >= least)
    if half:
        found = settle(found)  # read in both directions
        found = found.unionByName(found.select(F.col("vec_b").alias("vec_a"), F.col("vec_a").alias("vec_b"), "cosine"))
    members = copies.where(F.col("nth") <= k + 1)
    target = members.select(F.col("rep").alias("vec_b"), F.col("vec_id").alias("mb"))
    found = _best(found, k).drop("place")
    found = found.join(target, "vec_b", "left").select("vec_a", F.coalesce("mb", "vec_b").alias("vec_b"), "cosine")
    source = copies.select(F.col("rep").alias("vec_a"), F.col("vec_id").alias("ma"))
    found = found.join(source, "vec_a", "left").select(F.coalesce("ma", "vec_a").alias("vec_a"), "vec_b", "cosine")
    same = copies.select("rep", F.col("vec_id").alias("vec_a")).join(members.select("rep", F.col("vec_id").alias("vec_b")), "rep").where("vec_a <> vec_b").select("vec_a", "vec_b", F.lit(1.0).alias("cosine"))
    if queries is not None:
        asks = units.where(queries).select(F.col("vec_id").alias("vec_a")).distinct()
        same = same.join(asks, "vec_a", "left_semi")
        found = found.join(asks, "vec_a", "left_semi")
    return _best(found.unionByName(same), k)


def _members(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.concatenate([unpack(_joined(p.column("unit"))) for p in parts])
    return x, np.concatenate([p.column("vec_id").to_numpy() for p in parts]), np.concatenate([p.column("ask").to_numpy(zero_copy_only=False) for p in parts])


def _asked(members, x: np.ndarray, ids: np.ndarray, k: int, least: float):
    """What queries find among a leaf's members; these in blocks too, so that one key of any size is held once only."""
    mx, mi, _ = members
    for lo in range(0, len(mi), LEAF_MAX):
        for s in range(0, len(ids), 1024):
            row, col, exact = _top(x[s : s + 1024], ids[s : s + 1024], mx[lo : lo + LEAF_MAX], mi[lo : lo + LEAF_MAX], k, least)
            yield pa.RecordBatch.from_arrays([pa.array(ids[s : s + 1024][row]), pa.array(mi[lo : lo + LEAF_MAX][col]), pa.array(exact)], ["vec_a", "vec_b", "cosine"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each vec_a, repeated pairs once; cosines equal to DIGITS digits go by id."""
    once = found.groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("vec_a").orderBy(F.desc(F.round("cosine", DIGITS)), "vec_b")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mutual(vectors: DataFrame, k: int = 5, cosine: float = 0.9) -> DataFrame:
    """p4_found: (vec_a, vec_b), vec_a < vec_b, with at least the cosine, each among the other's k nearest."""
    near = nearest(vectors, k, cosine, least=cosine).where(F.col("cosine") >= cosine)
    return near.groupBy(F.least("vec_a", "vec_b").alias("vec_a"), F.greatest("vec_a", "vec_b").alias("vec_b")).agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
