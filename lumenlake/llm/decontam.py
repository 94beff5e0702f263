"""Benchmark decontamination with suffix arrays over the training text.

Words are alphanumeric runs, lower-cased.  Each shard of documents (a bounded run of words inside one
task) gets a suffix array over its words, ordered by word hash; every suffix of every benchmark item
is binary-searched in it.  The range of suffixes that begin with a window gives all places where the
window occurs; from there matches are followed to their end, which gives the longest verbatim ones.

Texts are scanned once per block of benchmark items, and one block is with the tasks at a time.  A
block holds BLOCK_WORDS words, or one item of more, so what tasks receive is bounded however many
items the benchmark has.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._store import bound_batches, materialize, set_aside, tidy

#: Words of a window; an item with fewer is one window.
WINDOW = 13
#: Bytes of text per shard, words that one suffix array covers, and benchmark words per block.
SHARD_BYTES, SEGMENT_WORDS, BLOCK_WORDS = 4 << 20, 1_000_000, 400_000


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of words in the order of their first `depth` words at least.

    Prefix doubling: ranks by 2, 4, 8, ... words.  Most suffixes soon stand apart, so each round sorts
    only those that still share their rank.
    """
    n = len(words)
    by_word = np.argsort(words)
    word = np.empty(n, np.int64)
    word[by_word] = _starts_of_runs(words[by_word]) + 1
    pair = word << 32
    pair[:-1] |= word[1:]
    order = np.argsort(pair)
    rank = np.empty(n, np.int64)
    rank[order] = _starts_of_runs(pair[order])
    size = 2
    while size < depth:
        tied = _tied(rank[order])
        if not len(tied):
            break
        at = order[tied]
        ahead = at + size
        key = rank[at] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        inner = np.argsort(key)
        order[tied], key = at[inner], key[inner]
        fresh = np.ones(len(inner), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, 0))
        size *= 2
    return order


def _starts_of_runs(ordered: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))


def _tied(ranks: np.ndarray) -> np.ndarray:
    same = np.zeros(len(ranks) + 1, bool)
    same[1:-1] = ranks[1:] == ranks[:-1]
    return np.flatnonzero(same[1:] | same[:-1])


@dataclass
class Block:
    """Benchmark items: their ids, word hashes, the offsets of each item's words, and the number that stands for a
    null id, which no item has."""

    items: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    missing: int | None = None
    cut: tuple | None = None

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """suffixes() of a window's width, made once in a worker."""
        if self.cut is None:
            self.cut = self.suffixes(WINDOW)
        return self.cut

    def suffixes(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All suffixes cut to `width` words: a matrix, their lengths, the item of each, and whether
        each begins a window."""
        sizes = np.diff(self.offsets)
        item = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(self.words))
        left = self.offsets[1:][item] - start
        cells = start[:, None] + np.arange(width)
        matrix = self.words[np.minimum(cells, len(self.words) - 1)]
        whole = np.minimum(sizes, WINDOW)[item]
        return matrix, np.minimum(left, width), item, left >= whole


def _compare(text: np.ndarray, at: np.ndarray, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that the suffixes at `at` share with the queries (up to their lengths), and whether the
    suffix is below its query at the first difference."""
    width = matrix.shape[1]
    common = np.zeros(len(at), np.int64)
    below = np.zeros(len(at), bool)
    live = np.arange(len(at))
    for k in range(width):
        live = live[lengths[live] > k]
        if not len(live):
            break
        pos = at[live] + k
        inside = pos < len(text)
        here = text[np.minimum(pos, len(text) - 1)]
        same = inside & (here == matrix[live, k])
        differ = live[~same]
        below[differ] = (~inside | (here < matrix[live, k]))[~same]
        live = live[same]
        common[live] += 1
    return common, below


def search(text: np.ndarray, order: np.ndarray, matrix: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every query (a row of matrix, cut to its length) the range of order whose suffixes begin with it."""
    lo, hi = np.zeros(len(matrix), np.int64), np.full(len(matrix), len(order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        _, below = _compare(text, order[mid], matrix[open_], lengths[open_])
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
    left = lo.copy()
    hi = np.full(len(matrix), len(order), np.int64)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) // 2
        common, _ = _compare(text, order[mid], matrix[open_], lengths[open_])
        full = common == lengths[open_]
        lo[open_[full]] = mid[full] + 1
        hi[open_[~full]] = mid[~full]
    return left, lo


def _extend(text: np.ndarray, at: int, query: np.ndarray) -> int:
    """Words that the text from `at` shares with the query."""
    n = min(len(query), len(text) - at)
    differ = np.flatnonzero(text[at : at + n] != query[:n])
    return int(differ[0]) if len(differ) else n


def scan(words: np.ndarray, offsets: np.ndarray, block: Block) -> tuple[list[np.ndarray], list[list[int]], np.ndarray]:
    """Per text of a shard: the sorted positions of its hit words, the items with an occurring window,
    and (length, item, position) of its longest match of a window's length or more."""
    n = len(offsets) - 1
    hits: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    items: list[list[int]] = [[] for _ in range(n)]
    longest = np.zeros((n, 3), np.int64)
    if not len(words) or not len(block.words):
        return hits, items, longest
    # a separator after each text, greater than any word, keeps matches inside one text
    text = np.insert(words, offsets[1:], np.uint64(0xFFFFFFFFFFFFFFFF))
    begins = offsets + np.arange(n + 1)
    matrix, lengths, item, window = block.windows()
    queries, places = [], []
    for lo in range(0, len(text), SEGMENT_WORDS):  # a window that begins in a segment ends in its overlap
        part = text[lo : lo + SEGMENT_WORDS + WINDOW - 1]
        order = suffix_array(part, WINDOW)
        left, right = search(part, order, matrix, lengths)
        found = np.flatnonzero(window & (right > left))
        counts = (right - left)[found]
        query = np.repeat(found, counts)
        at = order[np.repeat(left[found], counts) + np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts)]
        queries.append(query[at < SEGMENT_WORDS])
        places.append(at[at < SEGMENT_WORDS] + lo)
    query, at = np.concatenate(queries), np.concatenate(places)
    if not len(query):
        return hits, items, longest
    doc = np.searchsorted(begins, at, "right") - 1
    by_doc = np.lexsort((at, doc))
    query, at, doc = query[by_doc], at[by_doc], doc[by_doc]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=n))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        d = int(doc[lo])
        places, sizes = at[lo:hi] - begins[d], lengths[query[lo:hi]]
        mark = np.zeros(int(offsets[d + 1] - offsets[d]) + 1, np.int64)
        np.add.at(mark, places, 1)
        np.add.at(mark, places + sizes, -1)
        hits[d] = np.flatnonzero(np.cumsum(mark)[:-1])
        items[d] = np.unique(block.items[item[query[lo:hi]]]).tolist()
        # maximal matches begin where no window of the same item hit one word earlier
        q, p = query[lo:hi], at[lo:hi]
        diagonal = np.lexsort((p, p - q))
        first = np.ones(hi - lo, bool)
        first[1:] = (np.diff((p - q)[diagonal]) != 0) | (np.diff(p[diagonal]) != 1)
        for k in diagonal[first]:
            end = block.offsets[item[q[k]] + 1]
            size = _extend(text, int(p[k]), block.words[q[k] : end])
            one = (size, -block.items[item[q[k]]], begins[d] - p[k])  # of equally long ones the least item, then place
            if not longest[d, 0] or one > (longest[d, 0], -longest[d, 1], -longest[d, 2]):
                longest[d] = (one[0], -one[1], -one[2])
    return hits, items, longest


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks of bounded size, read one after the other."""
    spark = benchmark.sparkSession
    bound_batches(spark)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in _text.each_slice(batch.column(1)):
                words, at = _text.word_hashes(data, offsets, _text.ALNUM)
                raw = [words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(raw, pa.binary())], ["item_id", "n", "words"])

    items = materialize(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(tokens, "item_id long, n long, words binary").where("n > 0"), "benchmark-words")
    total = items.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // block_words))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == part).orderBy("item_id", "words").collect()
        if rows:
            words = [np.frombuffer(r.words, np.uint64) for r in rows]
            ids = {r.item_id for r in rows}
            missing = next(k for k in itertools.count(1 - 2**63) if k not in ids)
            named = np.array([missing if r.item_id is None else r.item_id for r in rows], np.int64)
            yield Block(named, np.concatenate(words), np.concatenate([[0], np.cumsum([len(w) for w in words])]), missing)


_FOUND = ["n_words", "hit", "items", "longest", "longest_item", "longest_at"]
_TYPES = "n_words long, hit array<int>, items array<long>, longest int, longest_item long, longest_at int"


def _scanned(block_of, text_at: int, only_found: bool):
    @tidy
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block | None = block_of.value if block_of else None
        for batch in batches:
            for i, j, data, offsets in _text.each_slice(batch.column(text_at), SHARD_BYTES):
                words, at = _text.word_hashes(data, offsets, _text.ALNUM)
                n = j - i
                hits, items, longest = scan(words, at, block) if block else ([np.zeros(0, int)] * n, [[]] * n, np.zeros((n, 3), np.int64))
                none = longest[:, 0] == 0
                missing = block.missing if block else None
                items = [[None if x == missing else x for x in found] for found in items]
                own = batch.slice(i, n)
                out = pa.RecordBatch.from_arrays(
                    [
                        *own.columns,
                        pa.array(np.diff(at)),
                        pa.array(hits, pa.list_(pa.int32())),
                        pa.array(items, pa.list_(pa.int64())),
                        *(pa.array(longest[:, k], kind, mask=none | (longest[:, k] == missing) if k == 1 else none) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int32()))),
                    ],
                    [*own.schema.names, *_FOUND],
                )
                yield out.filter(pa.array(~none)) if only_found else out

    return f


def matches(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with, per document: n_words, hit (positions of hit words), items (ids of the items with a
    window in it) and its longest verbatim match (`longest` words of longest_item from word longest_at, of
    equally long ones that of the least item and then the first; nulls if no window occurs).

    Null texts have no words; items without words and an empty benchmark hit nothing; items with a null id count
    as one item, whose id is null and which comes before all others; an empty table gives
    no rows; equal rows stay rows of their own; columns of docs that have such a name are replaced.  A long
    text has suffix arrays of bounded segments.  One pass over the texts per block of benchmark items,
    without a shuffle if there is one block; with more, docs is written down first, so that its rows keep
    their numbers.
    """
    docs = docs.drop(*_FOUND)
    spark = docs.sparkSession
    bound_batches(spark)
    blocks = _blocks(benchmark, block_words)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(_TYPES).fields])
        return docs.mapInArrow(_scanned(spark.sparkContext.broadcast(first) if first else None, docs.columns.index("text"), False), schema)
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "decontam-rows")
    found: DataFrame | None = None
    for block in itertools.chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(block)
        scanned = rows.select("__row", "text").mapInArrow(_scanned(shared, 1, found is not None), f"__row long, text string, {_TYPES}").drop("text")
        part = materialize(scanned, "decontam-block")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("longest", F.col("longest_item").isNull().alias("unnamed"), (-F.col("longest_item")).alias("item"), (-F.col("longest_at")).alias("at")))
    found = found.groupBy("__row").agg(
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        best.alias("best"),
    )
    found = found.select("__row", "n_words", "hit", "items", F.col("best.longest"), (-F.col("best.item")).alias("longest_item"), (-F.col("best.at")).alias("longest_at"))
    return rows.join(found, "__row").drop("__row")


def flagged(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """matches() with n_hit, n_items and `contaminated`: a word is hit, and at least one in `share`."""
    n_hit = F.size("hit").cast("long")
    return matches(docs, benchmark, **options).withColumns({"n_hit": n_hit, "n_items": F.size("items").cast("long"), "contaminated": (n_hit > 0) & (n_hit * share >= F.col("n_words"))})


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones."""
    docs, restored = set_aside(docs, "text")
    return flagged(docs, benchmark, **options).where("not contaminated").select(*restored)


def oracle() -> str:
    """The digest of flagged() in DuckDB's SQL, by all windows of both tables."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
starts AS (SELECT item_id, w, least({WINDOW}, len(w)) AS k, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
wins AS MATERIALIZED (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM starts),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wins)),
found AS MATERIALIZED (SELECT doc_id, item_id, i, p.k FROM (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM places) p JOIN wins ON wins.k = p.k AND wins.s = p.s),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(item.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""
