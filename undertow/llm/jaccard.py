"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its word shingles, hashed to 64 bits. Shingles fall into groups by hash and a
set's group counts are a point; the overlap of two sets is at most the sum of the smaller counts, and a
box of points bounds it for all points within. R-trees over the points find the pairs that may be
similar enough; exact set intersection decides them. No pair is verified that a tree has not found.

One tree over a large corpus would be one task, so the points are first dealt to blocks without loss.
Sets of a size band are cut into parts by hash; linked sets differ in at most d elements, so of more
than d parts that have elements one is the same in both (see ``part_keys``). Blocks of one set end there,
and of blocks with the same members one stays. The trees are then asked in rounds:

1. twice for the neighbours of one point of each block that lie in other components (a row for each
   member at most; copies end up in one component after few comparisons),
2. for all pairs that are still in different components; a pair is told in one of its blocks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertow.llm.common import Scratch, raw_bytes, space_words_of, texts_in
from undertow.llm.graph import components

SHINGLE, NUMER, DENOM = 3, 90, 100
LEAST_GROUPS, MOST_GROUPS = 32, 4096  # dimensions of a point: about one for two elements of the set
BAND = 1.5  # ratio of set sizes that share a number of parts
LEAF = 16  # points in a leaf of the tree
TILE = 4096  # points of a block that one task holds at a time; larger blocks go through all pairs of their tiles
LOW = 8  # of a set's blocks, those of least number, by which the block that tells a pair is known
BROADCAST_KEYS = 4_000_000  # of 8 bytes each
KNOWN = 100_000  # sets that a task remembers, so as to deal copies out once
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of fewer words, the whole sequence's; of none, nothing."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * M3 + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def need(m, n, numer: int = NUMER, denom: int = DENOM):
    """The least overlap of linked sets of m and n: denom * x >= numer * (m + n - x)."""
    return -((-numer * (m + n)) // (denom + numer))


def bands(n: int, numer: int, denom: int) -> list[tuple[int, int]]:
    """(band, d) for a set of n: its own band, and the next ones if a linked set may stand there.

    Linked sets of a band differ in at most ``d`` elements.
    """
    out = []
    band = 0
    top = 1
    while top < n:
        band, top = band + 1, max(top + 1, floor(top * BAND))
    largest = n * denom // numer  # of a linked set
    while True:
        out.append((band, 2 * top * (denom - numer) // (denom + numer)))
        if largest <= top:
            return out
        band, top = band + 1, max(top + 1, floor(top * BAND))


def part_keys(s: np.ndarray, band: int, d: int, numer: int, denom: int) -> np.ndarray:
    """Keys of the set's parts: of the band, the part and the part's content.

    There are some more parts than d. A linked set differs in at most ``own`` elements. A set with more than
    ``own`` parts that aren't empty shares one of those with each linked set, so its empty parts, in which
    many unlike sets would meet, have no key. A set with fewer has keys for all parts, and so shares one
    with every linked set of that kind too.
    """
    parts = d + 1 + (ceil(0.06 * d) + 1 if d else 0)
    own = min(d, len(s) * (denom - numer) // numer)
    part = ((s >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
    sums = np.zeros(parts, np.uint64)
    np.add.at(sums, part, mix(s ^ M3))
    keys = mix(sums + mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 32)))
    full = np.bincount(part, minlength=parts) > 0
    return keys[full] if full.sum() > own else keys


def digest(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=np.uint64).view(np.int64))


def groups_of(n: int) -> int:
    """Groups of the point of a set of n: a power of two, so that finer points fold to coarser ones."""
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << max(0, (n - 1).bit_length() - 1)))


def point_of(s: np.ndarray) -> bytes:
    """Group counts in one byte each, or two or four where a count asks for it."""
    g = groups_of(len(s))
    counts = np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g)
    most = counts.max()
    return counts.astype(np.uint8 if most < 256 else "<u2" if most < 65536 else "<u4").tobytes()


def folded(raw: bytes, n: int, groups: int) -> np.ndarray:
    own = groups_of(n)
    counts = np.frombuffer(raw, {1: np.uint8, 2: "<u2", 4: "<u4"}[len(raw) // own]).astype(np.int32)
    return counts.reshape(-1, groups).sum(axis=0) if own > groups else counts


def featurise(text: str, k: int, numer: int, denom: int):
    """Of a task's equal sets, the first has the keys and the point (of many different ones, some more have)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), set()
        for batch in texts_in(batches):
            n, node, check, point, keys = [], [], [], [], []
            for raw in raw_bytes(batch.column(text)):
                s = shingle_set(space_words_of(raw), hashes, k)
                n.append(len(s))
                own = (digest(s), digest(s ^ M2)) if len(s) else (None, None)
                node.append(own[0]), check.append(own[1])
                if not len(s) or own in known:
                    point.append(None), keys.append(None)
                    continue
                if len(known) >= KNOWN:
                    known.clear()
                known.add(own)
                point.append(point_of(s))
                keys.append(np.unique(np.concatenate([part_keys(s, *b, numer, denom) for b in bands(len(s), numer, denom)])).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(point, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["key", "n", "node", "check", "point", "keys"],
            )

    return run


def sets_of(text: str, k: int):
    """``first, check, set`` of every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in texts_in(batches):
            sets = [s for raw in raw_bytes(batch.column(text)) if len(s := shingle_set(space_words_of(raw), hashes, k))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in sets], pa.int64()), pa.array([digest(s ^ M2) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["first", "check", "set"],
            )

    return run


def intersect(numer: int, denom: int):
    """Pairs of sets that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_in(batches, 256):  # two sets a row
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(denom * same >= numer * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class CountTree:
    """An R-tree over group counts, packed by sorting on size and on the widest dimensions."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, numer: int = NUMER, denom: int = DENOM) -> None:
        self.points, self.sizes, self.ratio = points, sizes, (numer, denom)
        order = np.argsort(sizes, kind="stable")
        if len(points) > LEAF:
            wide = np.argsort(-points.var(axis=0), kind="stable")[:2]
            slab = ceil((len(points) / LEAF) ** 0.5) * LEAF
            order = np.concatenate([o[np.lexsort((points[o, wide[1]], points[o, wide[0]]))] for o in np.split(order, range(slab, len(order), slab))])
        self.levels = []  # from the leaves up: largest counts, least and largest sizes
        self.order = order
        high, lo, hi = points[order], sizes[order], sizes[order]
        while len(high):
            cut = np.arange(0, len(high), LEAF)
            high, lo, hi = np.maximum.reduceat(high, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)
            self.levels.append((high, lo, hi))
            if len(high) == 1:
                break

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Indices of the points whose overlap with ``point`` may be large enough to link."""
        numer, denom = self.ratio
        least, most = -(-numer * size // denom), size * denom // numer
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, lo, hi = self.levels[depth]
            at = at[(hi[at] >= least) & (lo[at] <= most)]
            bound = np.minimum(high[at], point).sum(axis=1)
            at = at[bound >= need(np.maximum(lo[at], least), size, numer, denom)]
            width = len(self.levels[depth - 1][0]) if depth else len(self.order)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < width]
        at = self.order[at]
        bound = np.minimum(self.points[at], point).sum(axis=1)
        sizes = self.sizes[at]
        return at[(bound >= need(sizes, size, numer, denom)) & (sizes >= least) & (sizes <= most)]


class Rows:
    """Members of one block (or of two tiles of one) as arrays; points are folded to the coarsest among them."""

    def __init__(self, table: pa.Table) -> None:
        self.block, self.node, self.root, self.n = (table.column(c).to_numpy() for c in ("block", "node", "root", "n"))
        self.raw = table.column("point").to_pylist()
        self.low = table.column("low").to_pylist() if "low" in table.column_names else None
        self.tile = table.column("tile").to_numpy() if "tile" in table.column_names else None

    def points(self, at: np.ndarray, more: int) -> np.ndarray:
        """``more``: the size of a further set that these are compared with."""
        groups = groups_of(min(int(self.n[at].min()), more))
        return np.stack([folded(self.raw[i], int(self.n[i]), groups) for i in at])

    def told_elsewhere(self, block: int, x: int, ys: np.ndarray) -> np.ndarray:
        """Whether a block of lower number, which tells the pair, has both."""
        lower = {b for b in self.low[x] if b < block}
        return np.array([not lower.isdisjoint(self.low[y]) for y in ys], bool)


def neighbours(numer: int, denom: int):
    """(a, b) for each member b of a block in the tree's answer to the block's first row a, of another root.

    Rows come in the order of the block. One batch and one point are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first = None
        for batch in texts_in(batches, 2048):  # a point of up to MOST_GROUPS counts a row
            rows = Rows(pa.Table.from_batches([batch]))
            a, b = [], []
            cut = [0, *(np.flatnonzero(rows.block[1:] != rows.block[:-1]) + 1), len(rows.block)]
            for x, y in zip(cut, cut[1:], strict=False):
                if x == y:
                    continue
                if rows.block[x] != block:
                    block, first = rows.block[x], (rows.node[x], rows.root[x], int(rows.n[x]), rows.raw[x])
                node, root, n, raw = first
                at = np.arange(x, y)[rows.root[x:y] != root]
                if len(at):
                    points = rows.points(at, n)
                    hit = at[CountTree(points, rows.n[at], numer, denom).search(folded(raw, n, points.shape[1]), n)]
                    a.append(np.full(len(hit), node)), b.append(rows.node[hit])
            a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def across(numer: int, denom: int):
    """All pairs (a, b) of different roots in the trees' answers, each told by one block.

    Rows come in the order of (block, i, j): one block, or two tiles of one, is held at a time.
    """

    def pairs(rows: Rows, at: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left, right = at[rows.tile[at] == i], at[rows.tile[at] == j]
        if not len(left) or not len(right) or (rows.root[at] == rows.root[at[0]]).all():
            return
        roots, count = np.unique(rows.root[at], return_counts=True)
        home = roots[count.argmax()]  # of the pairs of different roots, each has a member of another root than this
        ask = left[rows.root[left] != home] if i == j else left
        points = rows.points(at, int(rows.n[at[0]]))
        own = np.searchsorted(at, right)
        tree = CountTree(points[own], rows.n[right], numer, denom)
        for x in ask:
            y = right[tree.search(points[np.searchsorted(at, x)], int(rows.n[x]))]
            y = y[(rows.root[y] != rows.root[x])]
            if i == j:
                y = y[(rows.root[y] == home) | (rows.node[y] > rows.node[x])]
            if len(y):
                y = y[~rows.told_elsewhere(int(rows.block[x]), x, y)]
                yield np.full(len(y), rows.node[x]), rows.node[y]

    def answer(table: pa.Table) -> pa.RecordBatch:
        rows = Rows(table)
        i, j = (table.column(c).to_numpy() for c in "ij")
        cut = [0, *(np.flatnonzero((rows.block[1:] != rows.block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1), len(i)]
        found = [pair for x, y in zip(cut, cut[1:], strict=False) for pair in pairs(rows, np.arange(x, y), i[x], j[x])]
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            same = np.ones(rows.num_rows, bool)
            for c in ("block", "i", "j"):
                same &= rows.column(c).to_numpy() == rows.column(c)[-1].as_py()
            start = int(np.argmax(same))
            if start:
                yield answer(rows.slice(0, start))
            held = rows.slice(start)
        if held is not None and held.num_rows:
            yield answer(held)

    return run


def jaccard_components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, numer: int = NUMER, denom: int = DENOM
) -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``; the component's smallest key names it.

    Links: denom * intersection >= numer * union of the sets of ``shingle`` consecutive words (A-Z
    lower-cased, split at ASCII white space). Null, empty or blank texts have empty sets and link with
    nothing: component_id is their own key. Repeated rows come back as often as they came, rows with one
    key and several texts too. Rows with a null key link as all others do; a component whose keys are all
    null has a null component_id. An empty table gives no rows; other columns play no part.

    Sets are known by 128 bits: where two share the first 64, both get another number.
    """
    disk = Scratch(docs.sparkSession, "jaccard")
    texts = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    f = disk.write(texts.mapInArrow(featurise("text", shingle, numer, denom), "key long, n long, node long, check long, point binary, keys array<long>"))
    first = numbered(f)
    known = first.where("keys is not null")
    ids = disk.write(first.select("key", "n", "node"))

    members = _members(disk, known.select("node", F.explode("keys").alias("block")))
    low = members.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("block")), 1, LOW).alias("low"))
    named = ids.where("node is not null").groupBy("node").agg(F.min("key").alias("key"))
    points = disk.write(known.select("node", "first", "check", "n", "point").dropDuplicates(["node"]).join(low, "node").join(named, "node"))
    disk.drop(f)

    order = ["block", "root", F.xxhash64("node", "block")]
    pairs, roots = Pairs(disk, texts, points, shingle, numer, denom), points.select("node", F.col("node").alias("root"))
    rooted = lambda roots: points.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    for _ in range(2):
        rows = _mixed(disk, members, rooted(roots)).join(points.select("node", "n", "point"), "node")
        found = _dealt(rows, ["block"], order).mapInArrow(neighbours(numer, denom), "a long, b long").distinct()
        roots = pairs.roots(found)

    placed = _mixed(disk, members, rooted(roots))
    tiles = placed.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, F.col("tile")).alias("i"), F.greatest(t, F.col("tile")).alias("j")))
    rows = placed.join(tiles, "block").withColumn("tile", tile).select("block", "node", "root", "tile", F.explode(met).alias("m"))
    rows = rows.select("block", "node", "root", "tile", "m.i", "m.j").join(points.select("node", "n", "point", "low"), "node")
    found = _dealt(rows, ["block", "i", "j"], ["block", "i", "j"]).mapInArrow(across(numer, denom), "a long, b long").distinct()
    roots = pairs.roots(found)
    disk.drop(pairs.sets, points, members)

    own = ids.join(roots, "node", "left").select("key", "n", F.coalesce("root", "node").alias("root"))
    names = own.where("root is not null").groupBy("root").agg(F.min("key").alias("component_id"))
    return own.join(names, "root", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"),
    )


def numbered(f: DataFrame) -> DataFrame:
    """``f`` plus ``first``, its ``node``; a node that has several checks gets a new one for each of them."""
    f, round_ = f.withColumn("first", F.col("node")), 0
    while True:
        clash = f.where("node is not null").groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y")
        if clash.isEmpty():
            return f
        round_ += 1
        new = F.when(F.col("_clash"), F.xxhash64("node", "check", F.lit(round_))).otherwise(F.col("node"))
        f = f.join(clash.select("node", F.lit(True).alias("_clash")), "node", "left").withColumn("node", new).drop("_clash")


def _dealt(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(spread, *by).sortWithinPartitions(*order)


def _members(disk: Scratch, rows: DataFrame) -> DataFrame:
    """``block, node`` of the blocks with at least two sets; of blocks with the same members, the least.

    Blocks have the same members if their number, ends and 120 bits of sums of hashes agree.
    """
    block = Window.partitionBy("block")
    h, g = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    part = lambda x, at: F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << 30) - 1))
    told = [F.min("node").over(block).alias("first"), F.max("node").over(block).alias("last"), F.count("*").over(block).alias("c")]
    told += [F.sum(part(x, at)).over(block).alias(f"s{i}") for i, (x, at) in enumerate([(h, 2), (h, 33), (g, 2), (g, 33)])]
    shared = disk.write(rows.select("block", "node", *told).where("first <> last"))
    same = ["first", "last", "c", "s0", "s1", "s2", "s3"]
    kept = shared.where("node = first").groupBy(*same).agg(F.min("block").alias("block")).select("block")
    out = disk.write(shared.join(kept, "block").select("block", "node").distinct())
    disk.drop(shared)
    return out


def _mixed(disk: Scratch, members: DataFrame, roots: DataFrame) -> DataFrame:
    """``block, node, root`` of the blocks that have sets of several components."""
    placed = members.join(roots, "node")
    mixed = placed.groupBy("block").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    return disk.write(placed.join(mixed.select("block"), "block"))


class Pairs:
    """The pairs that the trees have found so far: which were verified, and which link."""

    def __init__(self, disk: Scratch, texts: DataFrame, points: DataFrame, shingle: int, numer: int, denom: int) -> None:
        self.disk, self.texts, self.points, self.shingle, self.ratio = disk, texts, points, shingle, (numer, denom)
        self.tried = self.linked = self.sets = None

    def roots(self, found: DataFrame) -> DataFrame:
        """Verifies the pairs of ``found`` that were not tried yet; the roots of all linked nodes."""
        found = self.disk.write(found if self.tried is None else found.join(self.tried, ["a", "b"], "left_anti"))
        self._fetch(found.select(F.col("a").alias("node")).union(found.select("b")).distinct())
        a = self.sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
        b = self.sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
        fresh = self.disk.write(found.join(a, "a").join(b, "b").mapInArrow(intersect(*self.ratio), "a long, b long"))
        self.linked = fresh if self.linked is None else self.linked.unionByName(fresh)
        self.tried = found if self.tried is None else self.tried.unionByName(found)
        return components(self.linked)

    def _fetch(self, nodes: DataFrame) -> None:
        """Adds the sets of ``nodes`` that aren't there: from the text of one key each, or of all null keys where a
        node has no other. The keys are broadcast up to BROADCAST_KEYS; more are joined by a shuffle of the texts."""
        old = self.sets
        new = nodes if old is None else nodes.join(old.select("node"), "node", "left_anti")
        wanted = self.disk.write(self.points.select("node", "first", "check", "key").join(new, "node", "left_semi"))
        keys = wanted.where("key is not null").select("key").distinct()
        few = wanted.count() <= BROADCAST_KEYS
        chosen = self.texts.join(F.broadcast(keys) if few else keys.hint("merge"), "key", "left_semi").select("text")
        if not wanted.where("key is null").isEmpty():
            chosen = chosen.unionByName(self.texts.where("key is null").select("text"))
        sets = chosen.mapInArrow(sets_of("text", self.shingle), "first long, check long, set binary")
        sets = sets.join(wanted.select("node", "first", "check"), ["first", "check"]).select("node", "set").dropDuplicates(["node"])
        self.sets = self.disk.write(sets if old is None else old.unionByName(sets))
        self.disk.drop(wanted, *([] if old is None else [old]))
