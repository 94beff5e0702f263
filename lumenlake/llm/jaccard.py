"""N-gram Jaccard join over count vectors.

A document's set holds its distinct k-word shingles.  Documents with equal sets form a class, which
one of them stands for from then on.  The join goes by blocks: two sets of the wanted similarity
share one of their first n - ceil(t n) + 1 shingles in any order common to all sets.  The order puts
frequent shingles last, so that a passage that many documents share makes no block.  A block takes sets
of like sizes only, by what the place of the shingle leaves to share; of blocks of equal sets one is kept.

Sets are points of group counts, and R-trees over them give the pairs whose summed coordinate minima
allow the similarity.  First the points that share a block with some block's least document are
indexed per such document, and searched with its point; what that links needs no further test.  If
documents of several components remain in a block, an R-tree over its points is joined with itself.
What the pairs of that connect is a group; a group's sets meet in a task, where the R-tree join is done
once more and its pairs are verified, until all are joined or told apart.  Bounds are taken on coarse
points first and then on fine ones, whose number of groups grows with the set, so that long texts are
told apart as well.

All links lie inside components.  Once those are known, every two sets of a component are compared, to
count each document's links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _text
from ._store import bound_batches, materialize, set_aside, tidy
from .graph import components
from .rtree import CountTree, needed, search_runs

#: Coordinates of a coarse point; a fine one has as many times two as leave 8 tokens or more in each.
GROUPS = 64
#: Frequent shingles known to every task; they only set the order, so the bound costs no result.
HOT_SHINGLES = 500_000
#: Shingles that one task counts at a time, and rows of a block that one R-tree holds.
COUNT_CHUNK, BLOCK_ROWS = 1_500_000, 4_096
#: Rows of a chunk of a block at least.
LEAST_CHUNK = 256
#: Shingles of the sets that one task compares with each other.
GROUP_SHINGLES = 2_000_000
#: Sets of a component that one task compares with as many others, and shingles that it looks at together.
LINK_ROWS, LINK_COLUMNS = 1_024, 4_096
#: Least logarithm of the ratio of the largest to the smallest size of a range.
LEAST_RANGE = 0.01
#: Bits per id of the filters that pick documents whose sets are compared and tokens of several sets, and log2 of a filter's
#: bits at least and at most (16 MB).  More documents than that are picked by a join; of more tokens more pass.
NODE_BITS, LEAST_BITS, MOST_BITS = 8, 16, 27


def shingle_sets(column, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text of a column."""
    for i, j, data, offsets in _text.each_slice(column):
        words, at = _text.word_hashes(data, offsets, _text.NON_SPACE)
        for row in range(i, j):
            yield row, _text.distinct(_text.shingle_hashes(words[at[row - i] : at[row - i + 1]], k))


def _hot(docs: DataFrame, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent shingles, `most` at most, sorted by hash.

    A task reports the shingles that it meets in two documents or more; a shingle that stays
    unreported is in fewer documents than there are chunks.  All texts are counted.
    """

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            twice = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[twice].view(np.int64)), pa.array(counts[twice])], ["h", "n"])

        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                held.append(s)
                size += len(s)
                if size >= COUNT_CHUNK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    found = materialize(docs.select("text").mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "hot")
    level = F.floor(F.log2("n") * 4).cast("int")
    rows = found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    least, total = None, 0
    for row in rows:
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    table = found.where(level >= least).toArrow()
    h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def point(s: np.ndarray) -> np.ndarray:
    """Tokens per group, 255 at most, of a set of hashes; what a group has beyond is found from the size."""
    groups = GROUPS
    while 16 * groups <= len(s):
        groups *= 2
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def folded(raw: np.ndarray, groups: int) -> np.ndarray:
    """A point with fewer groups."""
    return raw.reshape(-1, groups).sum(axis=0, dtype=np.uint32)


class Points:
    """Points of some rows, folded to whatever number of groups is asked for."""

    def __init__(self, column, sizes: np.ndarray):
        self.data, offsets = _text.utf8(column)
        self.sizes, self.groups = sizes, np.diff(offsets)
        self.beyond = sizes - (np.add.reduceat(self.data, offsets[:-1], dtype=np.int64) if len(sizes) else sizes)
        self.at: dict[int, np.ndarray] = {}

    def matrix(self, groups: int) -> np.ndarray:
        """All points of at least so many groups, folded; zeros for the others."""
        if groups not in self.at:
            out = np.zeros((len(self.sizes), groups), np.uint32)
            for own in _text.distinct(self.groups[self.groups >= groups]).tolist():
                rows = self.groups == own
                whole = self.data[np.repeat(rows, self.groups)].reshape(-1, own // groups, groups)
                out[rows] = whole.sum(axis=1, dtype=np.uint32)
            self.at[groups] = out
        return self.at[groups]

    def bounds(self, i: np.ndarray, other: Points, j: np.ndarray) -> np.ndarray:
        """The most tokens that rows i and rows j of the other can share, at the finer of what both have."""
        groups = np.minimum(self.groups[i], other.groups[j])
        out = np.minimum(self.beyond[i], other.beyond[j])
        for g in _text.distinct(groups).tolist():
            at = np.flatnonzero(groups == g)
            out[at] += np.minimum(self.matrix(g)[i[at]], other.matrix(g)[j[at]]).sum(axis=1, dtype=np.int64)
        return out


def sketch(docs: DataFrame, k: int, num: int, den: int, hot=None, hot_shingles: int = HOT_SHINGLES) -> DataFrame:
    """Per document: n (set size), h1, h2 (hashes of the set), coarse and point (group counts) and prefix
    (the shingles that it is found by)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(_hot(docs, k, hot_shingles) if hot is None else hot)

    @tidy
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = shared.value
        for batch in batches:
            n, h1, h2, coarse, points, prefixes = [], [], [], [], [], []
            for _, s in shingle_sets(batch.column(1), k):
                size = len(s)
                n.append(size)
                h1.append(int(_text.mix(s).sum().view(np.int64)) if size else 0)
                h2.append(int(_text.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)) if size else 0)
                fine = point(s)
                points.append(fine.tobytes())
                coarse.append(np.minimum(folded(fine, GROUPS), 255).astype(np.uint8).tobytes())
                length = size - -(-num * size // den) + 1 if size else 0
                if size and len(hashes):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    frequent = np.where(hashes[at] == s, counts[at], 0)
                    s = s[np.argsort(frequent, kind="stable")[:length]] if frequent.any() else s[:length]
                else:
                    s = s[:length]
                prefixes.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(coarse, pa.binary()), pa.array(points, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "n", "h1", "h2", "coarse", "point", "prefix"],
            )

    return docs.select("doc_id", "text").mapInArrow(sketched, "doc_id long, n long, h1 long, h2 long, coarse binary, point binary, prefix array<long>")


def _coarse(column, sizes: np.ndarray) -> np.ndarray:
    """Coarse points as rows; a coordinate of its own holds what saturated counts leave out."""
    out = np.empty((len(sizes), GROUPS + 1), np.int32)
    out[:, :GROUPS] = _text.utf8(column)[0].reshape(-1, GROUPS)
    out[:, GROUPS] = sizes - out[:, :GROUPS].sum(axis=1)
    return out


def _bounded(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose summed coordinate minima allow the similarity.

    The coarse points of all b of an a are packed in an R-tree, which the point of a searches; what it finds
    is bounded again by the fine points.  An a of very many b may be cut by Spark: each part is a tree."""

    @tidy
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sizes = [batch.column(c).to_numpy() for c in (2, 3)]
                queries, points = (_coarse(batch.column(c), n) for c, n in zip((4, 5), sizes, strict=True))
                found = search_runs(batch.column(0).to_numpy(), points, sizes[1], queries, sizes[0], num, den)
                yield batch.select([0, 1]).filter(pa.array(found))

    @tidy
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(batch.num_rows)
            sizes = [batch.column(c).to_numpy() for c in (2, 3)]
            bound = Points(batch.column(4), sizes[0]).bounds(rows, Points(batch.column(5), sizes[1]), rows)
            yield batch.select([0, 1]).filter(pa.array(bound >= needed(*sizes, num, den)))

    for grain, test in (("coarse", searched), ("point", kept)):
        for end in ("b", "a"):  # the join with a comes last and leaves the rows in its order
            pairs = pairs.join(reps.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col(grain).alias(f"point_{end}")), end)
        pairs = pairs.select("a", "b", "n_a", "n_b", "point_a", "point_b").mapInArrow(test, "a long, b long")
    return pairs.distinct()


def _filter_places(ids: np.ndarray, size: int) -> np.ndarray:
    """Three of 2^size bits of a Bloom filter for each id."""
    h = _text.mix(ids.astype(np.int64).view(np.uint64))
    return np.stack([h, h >> np.uint64(64 - size), h >> np.uint64(32 - size // 2)]) & np.uint64((1 << size) - 1)


def _id_filter(ids: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of 2^size bits over the first column of ids, as an array of longs.

    It only spares work: what it lets through by mistake, a join leaves out later."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _filter_places(batch.column(0).to_numpy(), size).ravel()
            order = np.argsort(at)
            word, bit = (at[order] >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at[order] & np.uint64(63))
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            merged = np.bitwise_or.reduceat(bit, starts) if len(starts) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(merged.view(np.int64))], ["word", "bits"])

    bits = np.zeros(1 << (size - 6), np.int64)
    table = ids.mapInArrow(placed, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits[table["word"].to_numpy()] = table["bits"].to_numpy()
    return bits


def _held(bits: np.ndarray, ids: np.ndarray, size: int) -> pa.Array:
    """Which ids a filter of 2^size bits lets through."""
    at = _filter_places(ids, size)
    return pa.array((((bits.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)) > 0).all(axis=0))


def _alike(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return den * shared >= num * (len(x) + len(y) - shared)


def _sets(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The shingle sets of the documents among nodes (node, shingles), and a few others.  Texts are read
    once more rather than shuffled, unless there are more nodes than a filter of bounded size can tell apart."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    size = max(LEAST_BITS, int(nodes.count() * NODE_BITS).bit_length())
    shared = None
    if size > MOST_BITS:
        texts = texts.join(nodes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(_id_filter(nodes, size))

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared is not None:
                batch = batch.filter(_held(shared.value, batch.column(0).to_numpy(), size))
            if batch.num_rows:
                raw = [s.tobytes() for _, s in shingle_sets(batch.column(1), k)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["node", "shingles"])

    return materialize(texts.mapInArrow(sets, "node long, shingles binary"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""

    @tidy
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in (2, 3))
            ok = [_alike(x, y, num, den) for x, y in zip(*sets, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    found = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, k)
    both = pairs
    for end in ("a", "b"):
        both = both.join(found.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}")), end)
    return both.select("a", "b", "set_a", "set_b").mapInArrow(linked, "a long, b long").distinct()


def _cells(reps: DataFrame, num: int, den: int) -> DataFrame:
    """(node, token, own): the prefix shingles of every set, by the range of sizes of the sets that it may be alike there.

    Where p shingles come before the first one that two sets share, the smaller set, of n, shares n - p at most, which
    bounds the other's size.  So the smaller is in all ranges from its own to that of the bound; the larger in its own."""
    width = max(math.log(den / num), LEAST_RANGE)
    at = lambda size: F.floor(F.log(size) / width)
    most = F.floor((den * F.col("n") - (num + den) * F.col("pos")) / num)
    placed = reps.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    ranges = placed.select("node", "shingle", at(F.col("n")).alias("own"), F.explode(F.sequence(at(F.col("n")), at(F.greatest("n", most)))).alias("range"))
    return ranges.select("node", F.xxhash64("shingle", "range").alias("token"), (F.col("range") == F.col("own")).alias("own"))


def _blocks(cells: DataFrame) -> DataFrame:
    """(token, node, size, hub): the cells of several sets, one of them of the range itself, with their number and the
    least; of cells of the same sets only one.

    Nearly all cells are of one set.  They are shuffled once, as a token and its count; a filter of bounded size over the
    tokens of several then leaves out nearly all others before any join."""
    several = materialize(cells.groupBy("token").agg(F.count("*").alias("size"), F.bool_or("own").alias("own")).where("size > 1 and own").select("token"), "tokens")
    size = min(MOST_BITS, max(LEAST_BITS, int(several.count() * NODE_BITS).bit_length()))
    shared = cells.sparkSession.sparkContext.broadcast(_id_filter(several, size))

    @tidy
    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_held(shared.value, batch.column(0).to_numpy(), size))

    # sums per token combine before the shuffle, and the joins can be split, so a frequent token is no large task
    held = materialize(cells.select("token", "node").mapInArrow(picked, "token long, node long").join(several, "token"), "blocks")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark_{k}") for k in (1, 2)]
    sizes = held.groupBy("token").agg(F.count("*").alias("size"), F.min("node").alias("hub"), *marks)
    one = sizes.groupBy("size", "hub", "mark_1", "mark_2").agg(F.min("token").alias("token")).select("token", "size", "hub")
    return materialize(held.join(one, "token"), "blocks")


def _tiles(rows: DataFrame, key: str, chunks: Column) -> DataFrame:
    """rows with `chunk` and `tile`: a key's rows are dealt to chunks, and every two of them meet in a tile."""
    return (
        rows.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
        .withColumn("tile", F.shiftleft(F.least("chunk", "other"), 32).bitwiseOR(F.greatest("chunk", "other")))
        .drop("other")
        .repartition(key, "tile")
        .sortWithinPartitions(key, "tile", "node")
    )


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, tile), the first two columns, which come one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key, tile = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = (np.flatnonzero((np.diff(key) != 0) | (np.diff(tile) != 0)) + 1).tolist()
        for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            if lo == hi:
                continue
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (key[lo], tile[lo]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Union-find over labels."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (y := self.up.get(top, top)) != top:
            top = y
        while x != top:
            self.up[x], x = top, self.up.get(x, x)
        return top

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _candidates(points: Points, component: np.ndarray, chunk: np.ndarray, tile: int, forest: _Forest, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Rows (i, j) of a tile, of components that the forest has not joined yet, that may be alike."""
    sizes = points.sizes
    # a group of its own holds what saturated counts leave out, so that no bound is too low
    coarse = np.column_stack([points.matrix(GROUPS).astype(np.int64), points.beyond])
    for i, j in CountTree(coarse, sizes).self_join(num, den):
        ok = component[i] != component[j]
        if tile >> 32 != tile & 0xFFFFFFFF:
            ok &= chunk[i] != chunk[j]
        i, j = i[ok], j[ok]
        if len(i):
            ok = points.bounds(i, points, j) >= needed(sizes[i], sizes[j], num, den)
            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                if forest.root(int(component[x])) != forest.root(int(component[y])):
                    yield x, y


def _block_edges(rows: DataFrame, num: int, den: int, block_rows: int) -> DataFrame:
    """Edges (a, b) between components of which two documents share a block and pass the bound.

    Per block they are a spanning forest of all such pairs of components, so a block of many documents
    makes no more edges than it has documents.  rows: token, node, n, point, component, size."""

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            component, forest, found = table["component"].to_numpy(), _Forest(), []
            points = Points(table["point"], table["n"].to_numpy())
            for i, j in _candidates(points, component, table["chunk"].to_numpy(), table["tile"][0].as_py(), forest, num, den):
                a, b = sorted((int(component[i]), int(component[j])))
                forest.join(a, b)
                found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], ["a", "b"])

    # a middling block is cut as well, so that no task gets many times the rows of others
    chunk = F.greatest(F.least(F.col("size") / 16, F.lit(block_rows)), F.lit(min(block_rows, LEAST_CHUNK)))
    tiled = _tiles(rows, "token", F.ceil(F.col("size") / chunk)).select("token", "tile", "chunk", "node", "n", "point", "component")
    return tiled.mapInArrow(joined, "a long, b long").distinct()


def _group_links(members: DataFrame, docs: DataFrame, k: int, num: int, den: int, group_shingles: int) -> DataFrame:
    """Links (a, b) that join components within groups of them: a spanning forest of all links there are.

    members: group, node, component, n.  A group's sets meet once; an R-tree over their points gives the
    pairs to verify, and pairs that earlier links have joined are left out.  A group of more than
    group_shingles is cut into chunks."""

    @tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            component, node, forest, found = table["component"].to_numpy(), table["node"].to_numpy(), _Forest(), []
            data, at = _text.utf8(table["shingles"])
            sets = [data[x:y].view(np.uint64) for x, y in zip(at[:-1], at[1:], strict=True)]
            raw = pa.array([point(s).tobytes() for s in sets], pa.binary())
            points = Points(raw, np.array([len(s) for s in sets]))
            for i, j in _candidates(points, component, table["chunk"].to_numpy(), table["tile"][0].as_py(), forest, num, den):
                if _alike(sets[i], sets[j], num, den):
                    forest.join(int(component[i]), int(component[j]))
                    found.append(sorted((int(node[i]), int(node[j]))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found]), pa.array([b for _, b in found])], ["a", "b"])

    total = members.groupBy("group").agg(F.sum("n").alias("total"))
    found = _sets(members.select("node").distinct(), docs, k)
    rows = members.join(total, "group").join(found, "node").withColumn("chunks", F.ceil(F.col("total") / group_shingles))
    tiled = _tiles(rows, "group", F.col("chunks")).select("group", "tile", "chunk", "node", "component", "shingles")
    return tiled.mapInArrow(joined, "a long, b long").distinct()


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of the one list shares with each of the other."""
    out = np.zeros((len(left), len(right)), np.float32)  # exact below 2 ** 24, and added up per block
    total = np.zeros((len(left), len(right)), np.int64)
    sets = left + right
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    held = counts[column] > 1
    row, column = row[held], (np.cumsum(counts > 1) - 1)[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, LINK_COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + LINK_COLUMNS])
        block = np.zeros((len(sets), min(LINK_COLUMNS, int(column[-1]) + 1 - first)), np.float32)
        block[row[lo:hi], column[lo:hi] - first] = 1
        np.matmul(block[: len(left)], block[len(left) :].T, out=out)
        total += out.astype(np.int64)
    return total


def _degrees(component: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int, group_shingles: int, link_rows: int) -> DataFrame:
    """(node, n_links) for the nodes of component (node, component): the other nodes that each links with.

    All links of a node are in its component, so every two sets of a component meet, in one tile each, and
    are compared.  Tiles give counts, not pairs.  In a component of two both have the link that made it."""

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _tables(batches):
            node, chunk, tile = table["node"].to_numpy(), table["chunk"].to_numpy(), table["tile"][0].as_py()
            data, at = _text.utf8(table["shingles"])
            sets = [data[x:y].view(np.uint64) for x, y in zip(at[:-1], at[1:], strict=True)]
            ends = [np.flatnonzero(chunk == c) for c in (tile >> 32, tile & 0xFFFFFFFF)]
            if not all(len(e) for e in ends):
                continue
            sizes = [np.array([len(sets[i]) for i in e], np.int64) for e in ends]
            shared = _shared(*([sets[i] for i in e] for e in ends))
            alike = den * shared >= num * (sizes[0][:, None] + sizes[1][None] - shared)
            # a doc_id of several texts is one document
            nodes, starts = zip(*(np.unique(node[e], return_index=True) for e in ends), strict=True)
            alike = np.logical_or.reduceat(np.logical_or.reduceat(alike, starts[0], axis=0), starts[1], axis=1)
            if tile >> 32 == tile & 0xFFFFFFFF:
                np.fill_diagonal(alike, False)
                found, n = nodes[0], alike.sum(axis=1)
            else:
                found, n = np.concatenate(nodes), np.concatenate([alike.sum(axis=1), alike.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["node", "n_links"])

    members = materialize(component.join(reps.groupBy("node").agg(F.sum("n").alias("n")), "node"), "members")
    total = members.groupBy("component").agg(F.count("*").alias("nodes"), F.sum("n").alias("total"))
    placed = members.join(total, "component")
    large = placed.where("nodes > 2")
    found = _sets(large.select("node"), docs, k)
    chunks = F.greatest(F.ceil(F.col("total") / group_shingles), F.ceil(F.col("nodes") / link_rows))
    rows = large.select("component", "node", chunks.alias("chunks")).join(found, "node")
    tiled = _tiles(rows, "component", F.col("chunks")).select("component", "tile", "chunk", "node", "shingles")
    counts = tiled.mapInArrow(counted, "node long, n_links long").groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return counts.unionByName(placed.where("nodes = 2").select("node", F.lit(1).cast("long").alias("n_links")))


def classes(
    docs: DataFrame,
    k: int = 5,
    num: int = 8,
    den: int = 10,
    hot_shingles: int = HOT_SHINGLES,
    block_rows: int = BLOCK_ROWS,
    group_shingles: int = GROUP_SHINGLES,
    link_rows: int = LINK_ROWS,
    counted: bool = True,
) -> DataFrame:
    """Per document of docs (doc_id, text, ...): n_shingles, component_id and n_links.

    Two documents link when den x shared shingles >= num x shingles in either; component_id is the
    least doc_id within reach, the document's own included.  n_links counts all classes of equal sets that
    the document's class links with; the class itself is not counted.  Without `counted` there is no
    n_links, and only the links that components need are verified.  A set
    without shingles (null, empty or blank text) links with nothing.  Rows of equal doc_id count as
    one document whatever their texts; a null doc_id links with nothing and has a null component_id.
    Other columns of docs do not matter, whatever their names; an empty table gives no rows; a long text is
    taken whole, its words as hashes.
    """
    docs = docs.select("doc_id", "text")
    seen = materialize(sketch(docs, k, num, den, hot_shingles=hot_shingles), "sketch")
    reps = materialize(
        seen.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.any_value("coarse").alias("coarse"), F.any_value("point").alias("point"), F.any_value("prefix").alias("prefix")),
        "classes",
    )
    blocks = _blocks(_cells(reps, num, den))
    first = materialize(_bounded(blocks.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), reps, num, den), "pairs")
    links = materialize(_verified(first, docs, k, num, den), "links")
    component = components(links)
    known = materialize(blocks.where("size > 2").join(component, "node", "left").withColumn("component", F.coalesce("component", "node")), "blocks")
    several = materialize(known.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token"), "tokens")
    placed = known.join(several, "token", "left_semi").join(reps.select("node", "n", "point"), "node")
    edges = materialize(_block_edges(placed, num, den, block_rows), "edges")
    if edges.limit(1).count():
        group = components(edges).select(F.col("node").alias("component"), F.col("component").alias("group"))
        members = materialize(placed.select("node", "component", "n").distinct().join(group, "component"), "members")
        more = materialize(_group_links(members, docs, k, num, den, group_shingles), "links")
        if more.limit(1).count():
            links = links.unionByName(more)
            component = components(links)
    member = reps.select("h1", "h2", "n", "node").join(component, "node", "left")
    own = ["doc_id", "n_shingles", "component_id"]
    if counted:
        member = member.join(_degrees(component, reps, docs, k, num, den, group_shingles, link_rows), "node", "left")
        own.append("n_links")
    else:
        member = member.withColumn("n_links", F.lit(None).cast("long"))
    member = member.select("h1", "h2", "n", F.coalesce("component", "node").alias("component"), "n_links")
    return seen.select("doc_id", "n", "h1", "h2").join(member, ["h1", "h2", "n"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("n_links")).alias("n_links"),
    ).select(*own[:3], *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in own[3:]))


def dedupe(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each component: the one of the least doc_id.

    Documents without shingles and rows without doc_id all stay; of repeated rows of one doc_id the
    least text stays.
    """
    docs, restored = set_aside(docs, "doc_id", "text")
    found = classes(docs, counted=False, **options)
    least = found.where("n_shingles > 0 and doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.join(least, docs.doc_id == F.col("__kept"), "left").withColumn("__words", words)
    row = F.row_number().over(Window.partitionBy("doc_id", "__words").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")]))
    single = marked.where("not __words or doc_id is null or __kept is not null").withColumn("__row", row)
    return single.where("not __words or doc_id is null or __row = 1").select(*restored)
