"""Problem 5: near-duplicate chunks that differ by small edits.

Method: chosen-path set similarity join. Each chunk is the set of its three-word shingles. In each of
``TREES`` independent trees a chunk branches at every node to the nodes of ``CHOSEN`` tokens, the least
under hash functions of the node's own. A node that holds few chunks is compared exhaustively; a larger one
branches on. Where branching would compare as many pairs as the node itself, its chunks are mostly alike,
and it is compared there block by block, so that no chunk is dropped and every level lessens the work.

Two chunks of similarity s go on together from a node with 1 - (1 - s p)^CHOSEN, if p is what they have
below it. At s = 0.6 and two tokens this branching does not die out: the chance that they meet in a tree is
0.84 at depth 1 and more than 0.55 at any depth, hence 0.9999 and 0.98 over five trees.

Comparison is by a sketch of minwise bytes; pairs that may reach the threshold are then verified on the
shingles themselves. Chunks with the same shingles are one class, searched once by its least id.

Defined results: null texts and texts under ``min_words`` words belong to no pair; a repeated chunk_id
counts once; owners may be null.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.util import runs, settle

TREES, CHOSEN, SKETCH = 5, 2, 40
#: A node branches if its children compare less than this share of its own pairs.
PROGRESS = 0.8
#: Chunks that are compared exhaustively at a node; those of a block of a node that does not branch; and chunks of which
#: more make a shingle one that is counted by matrices.
NODE, WHOLE, OFTEN = 600, 1200, 24
WORDS = re.compile(r"\w+")
MIX = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes; words' hashes are remembered."""

    LIMIT = 400_000

    def __init__(self, size: int = 3):
        self.size = size
        self.known: dict[str, int] = {}

    def shingles(self, text: str, min_words: int) -> np.ndarray | None:
        import xxhash

        words = WORDS.findall(text.lower())
        if len(words) < max(min_words, self.size):
            return None
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array([known[w] for w in words], dtype=np.uint64)
        n = len(h) - self.size + 1
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.size):
            out = _mix(out * np.uint64(MIX) + h[k : k + n])
        return np.unique(out).astype("<u8")


SHINGLER = Shingler()


def shingle_sets(chunks: DataFrame, min_words: int = 40) -> DataFrame:
    """(chunk_id, digest, shingles): the chunks long enough, with their sets as bytes of 64-bit hashes."""

    def run(batches):
        import xxhash

        from tessera.llm.near import SHINGLER

        for b in batches:
            ids, digests, sets = [], [], []
            for i, text in zip(b.column("chunk_id").to_pylist(), b.column("text").to_pylist()):
                if i is None or text is None or (s := SHINGLER.shingles(text, min_words)) is None:
                    continue
                raw = s.tobytes()
                ids.append(i), digests.append(xxhash.xxh3_128_digest(raw)), sets.append(raw)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], ["chunk_id", "digest", "shingles"])

    return chunks.select(F.col("chunk_id").cast("bigint"), "text").mapInArrow(run, "chunk_id bigint, digest binary, shingles binary")


def _signed(sets: DataFrame) -> DataFrame:
    """(chunk_id, sketch, keys): a chunk's sketch and its nodes below the roots of all trees."""

    def run(batches):
        rng = np.random.default_rng(20240501)
        mul, add = _hashes(rng, SKETCH)
        for b in batches:
            raw = b.column("shingles").to_pylist()
            if not raw:
                continue
            flat, starts = _flat(raw)
            least = [np.minimum.reduceat(flat * m + a, starts) for m, a in zip(mul, add)]
            sketch = np.stack([(_mix(x) & np.uint64(255)).astype(np.uint8) for x in least], axis=1)
            roots = np.arange(1, TREES + 1, dtype=np.uint64)
            keys = np.concatenate([_children(flat, starts, np.full(len(raw), _mix(roots[t : t + 1])[0])) for t in range(TREES)], axis=1)
            offsets = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * keys.shape[1])
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), pa.array([r.tobytes() for r in sketch], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))], ["chunk_id", "sketch", "keys"])

    return sets.select("chunk_id", "shingles").mapInArrow(run, "chunk_id bigint, sketch binary, keys array<bigint>")


def _hashes(rng, n: int) -> tuple[np.ndarray, np.ndarray]:
    return (rng.integers(1, 2**63, n, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _flat(raw: list) -> tuple[np.ndarray, np.ndarray]:
    """The sets one after another, mixed, and where each begins."""
    lens = np.array([len(r) // 8 for r in raw])
    return _mix(np.frombuffer(b"".join(raw), dtype="<u8") + np.uint64(1)), np.concatenate([[0], np.cumsum(lens)[:-1]])


def _children(flat: np.ndarray, starts: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each set, at the node of this path, the nodes of its chosen tokens: the least under each of
    ``CHOSEN`` hash functions that belong to the node, so that branches are independent of each other."""
    lens = np.diff(np.concatenate([starts, [len(flat)]]))
    out = np.empty((len(starts), CHOSEN), dtype=np.uint64)
    for c in range(CHOSEN):
        salt = _mix(node + np.uint64(c + 1) * np.uint64(MIX))
        token = np.minimum.reduceat(_mix(flat ^ np.repeat(salt, lens)), starts)
        out[:, c] = _mix(salt + token * np.uint64(MIX))
    return out


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs that share a node where they are compared and whose sketches allow the threshold.
    Level by level: small nodes are compared; a large node branches while this lessens the pairs to compare,
    else, as its chunks are mostly alike, it is compared block by block."""
    signed = settle(_signed(sets))
    # A chunk_id that was delivered twice is there twice; deeper levels take it once.
    sketch, once = signed.dropDuplicates(["chunk_id"]).select("chunk_id", "sketch"), sets.select("chunk_id", "shingles").dropDuplicates(["chunk_id"])
    rows = signed.select("chunk_id", "sketch", F.explode("keys").alias("key"), F.lit(0).cast("bigint").alias("parent"))
    found, held, level = [], None, None
    while True:
        counted = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"))
        # Few: a node of these holds more than NODE rows.
        large = settle(counted.where(F.col("n") > NODE))
        if held is not None:  # what a parent's children would compare, against what it would itself
            work = counted.groupBy("parent").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("below"))
            stuck = settle(held.join(work, held["key"] == work["parent"]).where(F.col("below") > PROGRESS * F.col("n").cast("double") * F.col("n")).select(held["key"], held["n"]))
            found.append(_compared_whole(level.join(stuck, "key").join(once, "chunk_id").withColumn("blocks", F.ceil(F.col("n") / WHOLE).cast("int")), threshold))
            gone = stuck.select(F.col("key").alias("parent"))
            rows, large = rows.join(gone, "parent", "left_anti"), large.join(gone, "parent", "left_anti")
        small = rows.join(large.select("key"), "key", "left_anti")
        found.append(_compared(small if held is None else small.join(sketch, "chunk_id"), threshold))
        held = settle(large.select("key", "n"))
        if held.isEmpty():
            break
        level = settle(rows.join(held.select("key"), "key", "left_semi").select("key", "chunk_id"))
        rows = settle(_branched(level, once))
    return reduce(DataFrame.unionByName, found).distinct()


def _branched(level: DataFrame, sets: DataFrame) -> DataFrame:
    """(chunk_id, key, parent): the children of chunks at large nodes; a set is moved once for all its nodes."""

    def run(batches):
        for b in batches:
            nodes = b.column("nodes")
            n = np.array([len(x) for x in nodes])
            which = np.repeat(np.arange(len(n)), n)
            at = nodes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            raw, ids = b.column("shingles").to_pylist(), b.column("chunk_id").to_numpy()
            for lo in range(0, len(at), 512):
                w = which[lo : lo + 512]
                flat, starts = _flat([raw[i] for i in w])
                keys = _children(flat, starts, at[lo : lo + 512]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[w], CHOSEN)), pa.array(keys.ravel()), pa.array(np.repeat(at[lo : lo + 512].view(np.int64), CHOSEN))], ["chunk_id", "key", "parent"])

    nodes = level.groupBy("chunk_id").agg(F.collect_set("key").alias("nodes"))
    return nodes.join(sets, "chunk_id").select("chunk_id", "shingles", "nodes").mapInArrow(run, "chunk_id bigint, key bigint, parent bigint")


def _in_pairs_of_blocks(placed: DataFrame, carried: str) -> DataFrame:
    """(key, chunk_id, carried, side): every pair of a node's blocks at its own key; side 0 meets itself, 1 meets 2."""
    mine = F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int")
    rows = placed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return rows.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "chunk_id", carried, side.alias("side"))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share: elements of many sets by a matrix product, those of few by their pairs."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    size = np.diff(np.concatenate([first, [len(flat)]]))
    out = np.zeros((n, n), np.float32)
    often = np.flatnonzero(size > OFTEN)
    for lo in range(0, len(often), 4096):
        part = often[lo : lo + 4096]
        m = np.zeros((n, len(part)), np.float32)
        m[owner[_spans(first[part], size[part])], np.repeat(np.arange(len(part)), size[part])] = 1
        out += m @ m.T
    for f in np.unique(size[(size > 1) & (size <= OFTEN)]).tolist():
        held = owner[first[size == f][:, None] + np.arange(f)]
        i, j = np.triu_indices(f, 1)
        for lo in range(0, len(held), max(1, 2_000_000 // len(i))):
            rows = held[lo : lo + max(1, 2_000_000 // len(i))]
            np.add.at(out, (rows[:, i].ravel(), rows[:, j].ravel()), 1)
    upper = np.triu(out, 1)  # owners are in order within an element
    return upper + upper.T


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs, one run after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _compared_whole(placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: the pairs of large nodes (key, chunk_id, shingles, blocks) that reach the threshold, on the sets
    themselves: where most chunks are alike, sketches would let too many through."""

    def compare(batches):
        for t in runs(batches):
            keys, ids, side = t.column("key").to_numpy(), t.column("chunk_id").to_numpy(), t.column("side").to_numpy()
            raw = t.column("shingles").to_pylist()
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo < 2:
                    continue
                sets = [np.frombuffer(raw[k], "<u8") for k in range(lo, hi)]
                size = np.array([len(x) for x in sets], np.float32)
                both = common(sets)
                near = both >= (threshold - 1e-6) * (size[:, None] + size[None, :] - both)
                i, j = np.nonzero(np.triu(near, 1))
                ok = ((side[lo:hi][i] == 0) | (side[lo:hi][i] != side[lo:hi][j])) & (ids[lo:hi][i] != ids[lo:hi][j])
                x, y = ids[lo:hi][i[ok]], ids[lo:hi][j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    rows = _in_pairs_of_blocks(placed, "shingles").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(compare, "a bigint, b bigint")


def _compared(placed: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b, perhaps repeated: the pairs that meet at these small nodes (key, chunk_id, sketch)."""
    # With sketches of SKETCH bytes the share of equal bytes lies 3.5 standard deviations below at the least.
    least = int(SKETCH * (threshold - 3.5 * (threshold * (1 - threshold) / SKETCH) ** 0.5))

    def compare(batches):
        for t in runs(batches):
            keys = t.column("key").to_numpy()
            ids = t.column("chunk_id").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), SKETCH)
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            left, right = [], []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo < 2:
                    continue
                if hi - lo == 2:
                    if (sketch[lo] == sketch[lo + 1]).sum() >= least:
                        left.append(ids[lo : lo + 1]), right.append(ids[lo + 1 : lo + 2])
                    continue
                s, own = sketch[lo:hi], ids[lo:hi]
                for k in range(0, hi - lo, 64):
                    same = (s[k : k + 64, None, :] == s[None, k:, :]).sum(axis=2, dtype=np.uint8) >= least
                    i, j = np.nonzero(same)
                    i, j = i + k, j + k
                    ok = i < j
                    left.append(own[i[ok]]), right.append(own[j[ok]])
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                ok = x != y
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[ok]), pa.array(np.maximum(x, y)[ok])], ["a", "b"])

    rows = placed.select("key", "chunk_id", "sketch").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(compare, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs that reach the threshold on their shingles. Only the sets that occur in a
    pair are moved."""

    def run(batches):
        for b in batches:
            out = []
            for x, y, p, q in zip(*[b.column(c).to_pylist() for c in ("a", "b", "sa", "sb")]):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                j = both / (len(p) + len(q) - both)
                if j >= threshold - 1e-12:
                    out.append((x, y, j))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "jaccard"])

    pairs = settle(pairs)
    ids = pairs.select(F.col("a").alias("chunk_id")).union(pairs.select(F.col("b").alias("chunk_id"))).distinct()
    needed = settle(sets.join(settle(ids), "chunk_id", "left_semi").dropDuplicates(["chunk_id"]))
    sa, sb = needed.select(F.col("chunk_id").alias("a"), F.col("shingles").alias("sa")), needed.select(F.col("chunk_id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint, jaccard double")


def linked(chunks: DataFrame, threshold: float = 0.6, min_words: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, copies, ids): verified links (a, b, jaccard) between representatives of different sets; the
    copies (chunk_id, rep, n) of classes with more than one chunk; and all ids long enough."""
    sets = settle(shingle_sets(chunks, min_words))
    ids = sets.select("chunk_id", "digest").distinct()
    classes = ids.groupBy("digest").agg(F.min("chunk_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = settle(ids.join(classes, "digest").select("chunk_id", "rep", "n"))
    # A chunk_id delivered twice is there twice: pairs of equal ids are no pairs, and pairs are made distinct.
    single = sets.join(copies.where("chunk_id <> rep").select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "shingles")
    links = settle(_verified(candidates(single, threshold), single, threshold))
    return links, copies, ids.select("chunk_id")


def pairs(chunks: DataFrame, threshold: float = 0.6, min_words: int = 40) -> DataFrame:
    """p5_found: (chunk_a, chunk_b). Links hold for all members of both classes, and all members of a class
    are pairs, so that rows grow with the square of the largest class; ``groups`` gives membership instead."""
    links, copies, _ = linked(chunks, threshold, min_words)
    a, b = copies.select(F.col("rep").alias("a"), F.col("chunk_id").alias("ma")), copies.select(F.col("rep").alias("b"), F.col("chunk_id").alias("mb"))
    across = links.select("a", "b").join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
    within = copies.select("rep", F.col("chunk_id").alias("x")).join(copies.select("rep", F.col("chunk_id").alias("y")), "rep").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("chunk_a"), F.greatest("x", "y").alias("chunk_b"))


def groups(chunks: DataFrame, threshold: float = 0.6, min_words: int = 40) -> DataFrame:
    """(chunk_id, group_id, owner_fqn, n_links): every chunk that is near another, with its group and the
    number of links of its class to other classes."""
    links, copies, _ = linked(chunks, threshold, min_words)
    edges = links.select("a", "b").union(copies.where("chunk_id <> rep").select(F.col("rep").alias("a"), F.col("chunk_id").alias("b")))
    found = components(edges).select(F.col("node").alias("chunk_id"), F.col("component").alias("group_id"))
    degree = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    owner = chunks.groupBy("chunk_id").agg(F.min("owner_fqn").alias("owner_fqn"))
    rep = found.join(copies.select("chunk_id", "rep"), "chunk_id", "left").withColumn("rep", F.coalesce("rep", "chunk_id"))
    return rep.join(degree, "rep", "left").join(owner, "chunk_id", "left").select("chunk_id", "group_id", "owner_fqn", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def owners(chunks: DataFrame) -> DataFrame:
    """(group_id, n_chunks, n_owners): the owners that each group spans."""
    return groups(chunks).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("owner_fqn").alias("n_owners"))
