"""English full-text search: a positional inverted index over stems, and ranks by frequency and nearness.

A record matches a query if each word of the query, without stop words and brought to its stem, begins one of the
record's stems.  For a query of one word the rank sums over the matching stems the falling weights of their
occurrences; for one of several words it grows with every two occurrences of different words that are near.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.english import STOP_WORDS, is_stop_word, lexicon, stem, stem_of
from ..functions.text import tokens
from . import links
from .common import live, page_size, top_n

# The weight of a plain word; the sum of 1 / n^2; the rank of a match without near words.
WEIGHT, LIMIT, LEAST_RANK = 0.1, 1.64493406685, 1e-20
#: Words between which nearness counts; beyond, it is below 1e-29.
REACH = 100
#: Steps of 1 in which the terms of ranks are added up: of frequencies, and of the logarithms of nearness, which are less;
#: these are added up to MOST, where the rank has long been 1.
STEPS, FINE, MOST = 1e12, 1e16, 10**18
#: Words whose stems a task keeps, and bytes of an Arrow batch of texts.
HELD_WORDS, BATCH_BYTES = 1_000_000, 4 << 20
#: Words of the records that one task searches, the least for which another task is worth it, and queries that it answers;
#: letters of a word, with what parts it from the next.
PART_WORDS, LEAST_WORDS, PART_QUERIES, WORD_LETTERS = 6_000_000, 50_000, 100_000, 6
#: Pairs of places that are looked at at once.
PAIRS = 2_000_000
#: The terms of nearness by distance, in whole steps, in two parts whose sums are exact as doubles; none for one place.
HALF = 1 << 26
_NEAR = [0] + [round(FINE * math.log1p(-WEIGHT * math.sqrt(1.0 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))) for d in range(1, REACH + 1)]
_HIGH, _LOW = (np.array(x, float) for x in zip(*(divmod(t, HALF) for t in _NEAR), strict=True))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, key, positions) of each row's words, by sorting them by row and stem.  A stem is worked out once per word of
    a task, as long as the words held are not too many."""
    stems: dict[str, str | None] = {"": None} | dict.fromkeys(STOP_WORDS)
    least = len(stems)

    def known(word: str) -> str | None:
        if word not in stems:
            stems[word] = stem_of(word)
        return stems[word]

    for batch in batches:
        lists = batch.column(1)
        words = lists.flatten().dictionary_encode()
        distinct, code = words.dictionary.to_pylist(), words.indices.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
        # what a separator at an end of a text leaves is no word
        is_word = np.array([w != "" for w in distinct], bool)[code] if len(code) else np.zeros(0, bool)
        row, code = row[is_word], code[is_word]
        pos = np.arange(len(row)) - np.searchsorted(row, row)
        terms = pa.array([known(w) for w in distinct], pa.string()).dictionary_encode()
        term = terms.indices.fill_null(-1).to_numpy()[code]
        row, pos, term = row[term >= 0], pos[term >= 0], term[term >= 0]
        order = np.argsort(row * max(1, len(terms.dictionary)) + term, kind="stable")
        row, pos, term = row[order], pos[order], term[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(term, prepend=-1))
        positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), pa.array(pos, pa.int32()))
        yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(term[starts])), batch.column(0).take(pa.array(row[starts])), positions], ["term", batch.schema.names[0], "positions"])
        if len(stems) > HELD_WORDS:
            stems = dict(list(stems.items())[:least])


def _words(text: str) -> Column:
    return F.split(F.lower(F.col(text)), "[^\\p{L}\\p{N}]+").alias("words")


def _by_record(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, positions) of each row of texts by itself."""
    spark = texts.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, _words(text)).mapInArrow(_postings, f"term string, `{key}` {kind}, positions array<int>")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of (term, key, positions), which come in order, with those of equal term and key as one."""
    held: pa.Table | None = None

    def out(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(starts) < rows.num_rows:
            lists = rows.column(2).combine_chunks()
            sizes = np.add.reduceat(lists.value_lengths().to_numpy(), starts)
            values, group = lists.flatten().to_numpy(), np.repeat(np.arange(len(starts)), sizes)
            at = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            positions = pa.ListArray.from_arrays(at, pa.array(values[np.lexsort((values, group))], pa.int32()))
            rows = rows.take(pa.array(starts)).set_column(2, "positions", positions)
        yield from rows.to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in (0, 1):
            now, last = rows.column(c).slice(1), rows.column(c).slice(0, rows.num_rows - 1)
            same = pc.or_(pc.equal(now, last).fill_null(False), pc.and_(pc.is_null(now), pc.is_null(last)))
            new[1:] |= ~same.to_numpy()
        starts = np.flatnonzero(new)
        held = rows.slice(starts[-1])  # its record may go on in the next batch
        if len(starts) > 1:
            yield from out(rows.slice(0, starts[-1]), starts[:-1])
    if held is not None:
        yield from out(held, np.zeros(1, np.int64))


def _merged(dealt: DataFrame, key: str) -> DataFrame:
    """The postings of an index in order of term and key, of postings whose equal terms and keys are in one task."""
    rows = dealt.sortWithinPartitions("term", key)
    return rows.mapInArrow(_joined, rows.schema)


def index(texts: DataFrame, key: str = "image_id", text: str = "raw_text") -> DataFrame:
    """(term, key, positions): per stem and record the places of its words, counted over all words.

    Stop words count as places and are left out.  The words of a text are gathered by stem before the shuffle.  Null
    and empty texts have no rows; rows of one key are one record."""
    return _merged(_by_record(texts, key, text).repartition("term", key), key)


def write_index(texts: DataFrame, path: str, key: str = "image_id", text: str = "raw_text") -> DataFrame:
    """Write an index in order of term, so that a search by terms reads little else, and read it back.

    The records of one term are spread over files, however many they are.  Postings are written down as they come, since
    ranges are found by reading them twice; one shuffle then brings them in order."""
    spark = texts.sparkSession
    found = _by_record(texts, key, text)
    found.write.mode("overwrite").parquet(f"{path}-unsorted")
    found = spark.read.schema(found.schema).parquet(f"{path}-unsorted")
    built = _merged(found.repartitionByRange("term", key), key)
    built.write.mode("overwrite").parquet(path)
    return spark.read.schema(built.schema).parquet(path)


def _whole(x: Column, steps: float) -> Column:
    """A term of a rank in whole steps: sums of these do not depend on their order, so that equal ranks are equal."""
    return F.rint(x * steps).cast("long")


def _frequency(n: Column) -> Column:
    """The falling weights of n occurrences."""
    return WEIGHT / LIMIT * F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, j: s + 1.0 / (j * j))


def _nearness(lists: Column) -> Column:
    """The rank of the places of two or more words."""

    def two(a: Column, b: Column) -> Column:
        apart = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: (x != y) & (F.abs(x - y) <= REACH)), lambda y: F.abs(x - y).cast("double"))))
        return F.aggregate(apart, F.lit(0).cast("long"), lambda s, d: F.greatest(F.lit(-MOST), s + _whole(F.log1p(-WEIGHT * F.sqrt(1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))), FINE)))

    size = F.size(lists)
    total = F.aggregate(
        F.sequence(F.lit(0), size - 2),
        F.lit(0).cast("long"),
        lambda s, i: F.greatest(F.lit(-MOST), s + F.aggregate(F.sequence(i + 1, size - 1), F.lit(0).cast("long"), lambda t, j: F.greatest(F.lit(-MOST), t + two(F.get(lists, i), F.get(lists, j))))),
    )
    return F.greatest(1 - F.exp(total / FINE), F.lit(LEAST_RANK))


def query_terms(queries: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """(query, q, n): the distinct stems of each query's words, and their number."""
    words = queries.select(query, F.explode(F.array_distinct(tokens(text))).alias("word"))
    terms = words.join(lexicon(words), "word").select(query, F.col("term").alias("q")).distinct()
    return terms.join(terms.groupBy(query).agg(F.count("*").alias("n")), query)


def ranked(index: DataFrame, queries: DataFrame, key: str = "image_id", query: str = "query", text: str = "text") -> DataFrame:
    """(query, key, rank): all records that match each query.  A query of stop words alone finds nothing.

    Queries meet the terms of the index by prefix and its rows by term; nothing reads a text."""
    terms = query_terms(queries, query, text)
    vocabulary = index.select("term").distinct()
    prefixes = vocabulary.withColumn("q", F.explode(F.transform(F.sequence(F.lit(1), F.length("term")), lambda n: F.substring("term", F.lit(1), n))))
    wanted = prefixes.join(terms, "q").select(query, "q", "n", "term")
    hits = index.join(wanted, "term").groupBy(query, key, "q").agg(F.first("n").alias("n"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("at"), (F.sum(_whole(_frequency(F.size("positions")), STEPS)) / STEPS).alias("own"))
    found = hits.groupBy(query, key).agg(F.first("n").alias("n"), F.count("*").alias("__m"), F.sort_array(F.collect_list(F.struct("q", "at"))).alias("each"), F.sum("own").alias("own")).where("__m = n")
    places = F.transform("each", lambda x: x["at"])
    return found.select(query, key, F.when(F.col("n") == 1, F.col("own")).otherwise(_nearness(places)).alias("rank"))


def find(index: DataFrame, queries: DataFrame, limit: int = 50, key: str = "image_id", query: str = "query", text: str = "text", order: DataFrame | None = None) -> DataFrame:
    """(query, key, rank, rn): the first `limit` records of each query by rank, then by what `order` (key, at), a row a key,
    says, the latest first, then by key."""
    words = index.agg(F.sum(F.size("positions"))).first()[0]
    return _first(index.select(key, "term", "positions"), words, queries, limit, key, query, text, order)


def find_texts(texts: DataFrame, queries: DataFrame, limit: int = 50, key: str = "image_id", column: str = "raw_text", query: str = "query", text: str = "text", order: DataFrame | None = None) -> DataFrame:
    """find() in the index of texts, which is built in parts, by records, where it is searched and is not written down."""
    letters = texts.agg(F.sum(F.length(column))).first()[0]
    rows = texts.where(F.col(column).isNotNull()).select(key, F.col(column).alias("__text"))
    return _first(rows, -(-(letters or 0) // WORD_LETTERS), queries, limit, key, query, text, order)


def _first(rows: DataFrame, words: int | None, queries: DataFrame, limit: int, key: str, query: str, text: str, order: DataFrame | None) -> DataFrame:
    """find() in the rows (key, term, positions) of an index, or in texts (key, __text), of about so many words.

    Records are dealt to parts, and each part answers all queries and gives its first records of each.  What is shuffled is
    the records, once for PART_QUERIES queries, and the first records; the records that match are not."""
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    asked = links.settle(query_terms(queries, query, text).groupBy(query).agg(F.collect_set("q").alias("terms")))
    blocks = max(1, -(-asked.count() // PART_QUERIES))
    parts = max(1, -(-(words or 0) // PART_WORDS), min(spark.sparkContext.defaultParallelism, (words or 0) // LEAST_WORDS))
    part, block = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"), F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int")
    each_part, each_block = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__block")
    kind = rows.schema[key].dataType
    at = order.toDF(key, "__at") if order is not None else rows.select(key, F.lit(None).cast("int").alias("__at")).limit(0)
    dealt = rows.unionByName(at.withColumn(key, F.col(key).cast(kind)), allowMissingColumns=True).select("*", part.alias("__part"), each_block)
    dealt = dealt.unionByName(asked.withColumnRenamed(query, "__query").select("*", F.pmod(F.xxhash64("__query"), F.lit(blocks)).cast("int").alias("__block"), each_part), allowMissingColumns=True)
    dealt = dealt.repartitionById(parts * blocks, F.col("__part") * blocks + F.col("__block")).drop("__part", "__block")
    if "__text" in rows.columns:  # split where they are searched: words take more room than their text
        dealt = dealt.select(*[c for c in dealt.columns if c != "__text"], _words("__text"))
    kinds = dict(dealt.dtypes)
    found = dealt.mapInArrow(partial(_answers, key, limit), f"__query {kinds['__query']}, __key {kinds[key]}, __at {kinds['__at']}, rank double")
    return top_n(found, ["__query"], [F.desc("rank"), F.desc_nulls_last("__at"), F.desc("__key")], limit).select(F.col("__query").alias(query), F.col("__key").alias(key), "rank", "rn")


def _answers(key: str, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first records of each query (__query, terms) in a part of an index: rows (key, words) or (key, term, positions),
    and (key, __at), the time of a record."""
    asked, times, held = [], [], []
    schema = None

    def rows() -> Iterator[pa.RecordBatch]:
        nonlocal schema
        for batch in batches:
            schema = batch.schema
            asked.append(batch.filter(batch["terms"].is_valid()).select(["__query", "terms"]))
            times.append(batch.filter(batch["__at"].is_valid()).select([key, "__at"]))
            if "words" in schema.names:
                yield batch.filter(batch["words"].is_valid()).select([key, "words"])
            else:
                held.append(batch.filter(batch["term"].is_valid()).select(["term", key, "positions"]))

    held += [b for b in _postings(rows()) if b.num_rows]
    held = [b for b in held if b.num_rows]
    if not held:
        return
    part = _Part(pa.Table.from_batches(held), pa.Table.from_batches(times), key)
    held.clear()
    by_terms: dict[tuple, list] = {}
    for b in asked:
        for q, terms in zip(b["__query"].to_pylist(), b["terms"].to_pylist(), strict=True):
            by_terms.setdefault(tuple(sorted(terms)), []).append(q)
    kinds = [schema.field(n).type for n in ("__query", key, "__at")]
    some, size = [], 0

    def out() -> pa.RecordBatch:
        record = pa.array(np.concatenate([r for _, r, _ in some]))
        query = pa.array([q for q, r, _ in some for _ in range(len(r))], kinds[0])
        return pa.RecordBatch.from_arrays([query, part.keys.take(record), part.times.take(record), pa.array(np.concatenate([x for *_, x in some]))], ["__query", "__key", "__at", "rank"])

    for terms, asking in by_terms.items():
        record, rank = part.first(terms, limit)
        if len(record):
            some += [(q, record, rank) for q in asking]
            size += len(asking) * len(record)
        if size > 100_000:
            yield out()
            some, size = [], 0
    if some:
        yield out()


class _Part:
    """Some records' index in memory.  Records are numbered in the order in which they come at equal rank."""

    def __init__(self, postings: pa.Table, times: pa.Table, key: str):
        coded = postings[key].combine_chunks().dictionary_encode(null_encoding="encode")
        keys = coded.dictionary
        known = times[key].combine_chunks()
        at = times["__at"].combine_chunks().take(pc.index_in(keys, value_set=known, skip_nulls=True))
        order = pc.sort_indices(pa.table({"at": at, "key": keys}), sort_keys=[("at", "descending"), ("key", "descending")], null_placement="at_end").to_numpy()
        self.keys, self.times = keys.take(pa.array(order)), at.take(pa.array(order))
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        words = postings["term"].combine_chunks().dictionary_encode()
        self.terms = sorted(words.dictionary.to_pylist())
        place = {t: k for k, t in enumerate(self.terms)}
        rank_of = np.array([place[t] for t in words.dictionary.to_pylist()], np.int32)
        lists = postings["positions"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        term = np.repeat(rank_of[words.indices.to_numpy()], sizes)
        record = np.repeat(number[coded.indices.to_numpy()], sizes)
        self.pos = lists.flatten().to_numpy()
        self.span = int(self.pos.max(initial=0)) + REACH + 1
        order = np.argsort(term.astype(np.int64) * len(number) + record, kind="stable")
        term, record, self.pos = term[order], record[order], self.pos[order]
        self.starts = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(record, prepend=-1) != 0))
        self.sizes = np.diff(np.append(self.starts, len(term)))
        self.record = record[self.starts]
        self.begins = np.searchsorted(term[self.starts], np.arange(len(self.terms) + 1))
        weights = WEIGHT / LIMIT * np.append(0.0, np.cumsum(1.0 / np.arange(1, self.sizes.max() + 1, dtype=float) ** 2))
        self.own = np.rint(weights * STEPS)
        self.kept: dict[str, np.ndarray] = {}
        self.room = len(self.pos)

    def _range(self, term: str) -> slice:
        """The postings of the terms that one begins."""
        return slice(self.begins[bisect_left(self.terms, term)], self.begins[bisect_left(self.terms, term + chr(0x10FFFF))])

    def _records(self, term: str, some: slice) -> np.ndarray:
        """The distinct records of postings, in order."""
        record = self.record[some]
        if len(record) < 2 or bool((record[1:] > record[:-1]).all()):
            return record
        if term not in self.kept:
            if self.room < len(record):
                self.kept, self.room = {}, len(self.pos)
            self.kept[term] = np.unique(record)
            self.room -= len(record)
        return self.kept[term]

    def first(self, terms: tuple[str, ...], limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The first records that match all terms, and their ranks."""
        ranges = [self._range(t) for t in terms]
        if any(r.start == r.stop for r in ranges):
            return np.zeros(0, np.int32), np.zeros(0)
        lists = [self._records(t, r) for t, r in zip(terms, ranges, strict=True)]
        record = min(lists, key=len)
        for other in lists:
            if other is not record:
                at = np.searchsorted(other, record)
                record = record[other[np.minimum(at, len(other) - 1)] == record]
        if not len(record):
            return record, np.zeros(0)
        if len(terms) == 1:
            rank = np.bincount(np.searchsorted(record, self.record[ranges[0]]), self.own[self.sizes[ranges[0]]], len(record)) / STEPS
        else:
            rank = self._near(record, ranges)
        if len(record) > limit:
            least = np.partition(rank, len(rank) - limit)[len(rank) - limit]
            record, rank = record[rank >= least], rank[rank >= least]
        best = np.lexsort((record, -rank))[:limit]
        return record[best], rank[best]

    def _near(self, record: np.ndarray, ranges: list[slice]) -> np.ndarray:
        """_nearness() of the places of some terms in the records given, which are in order."""
        places = []
        for some in ranges:
            found = self.record[some]
            at = np.minimum(np.searchsorted(record, found), len(record) - 1)
            hit = record[at] == found
            n, start = self.sizes[some][hit], self.starts[some][hit]
            ends = np.cumsum(n)
            spot = np.arange(ends[-1]) + np.repeat(start - ends + n, n)
            places.append(np.sort(np.repeat(at[hit], n) * self.span + self.pos[spot]))
        high, low = np.zeros(len(record)), np.zeros(len(record))
        for i, x in enumerate(places):
            for y in places[i + 1 :]:
                x, z = (x, y) if len(x) <= len(y) else (y, x)
                first, last = np.searchsorted(z, x - REACH), np.searchsorted(z, x + REACH, "right")
                ends = np.cumsum(last - first)
                for cut in range(0, int(ends[-1]), PAIRS):
                    a, b = np.searchsorted(ends, [cut, cut + PAIRS], "right") if ends[-1] > PAIRS else (0, len(x))
                    n = (last - first)[a:b]
                    if not n.sum():
                        continue
                    to = np.cumsum(n)
                    apart = np.abs(z[np.arange(to[-1]) + np.repeat(first[a:b] - to + n, n)] - np.repeat(x[a:b], n))
                    of = np.repeat(x[a:b] // self.span, n)
                    high += np.bincount(of, _HIGH[apart], len(record))
                    low += np.bincount(of, _LOW[apart], len(record))
                x = places[i]
        about = high * HALF + low
        total = np.where(about < -MOST, -MOST, (np.maximum(high, -2.0 * MOST / HALF)).astype(np.int64) * HALF + low.astype(np.int64))
        each, of = np.unique(np.maximum(total, -MOST), return_inverse=True)
        return np.array([max(1 - math.exp(t / FINE), LEAST_RANK) for t in each.tolist()])[of]


def page(index: DataFrame, images: DataFrame, text: str, owner, limit: int | None = None, offset: int = 0, key: str = "image_id") -> DataFrame:
    """A page of an owner's live images that a text finds: the columns of images, `rank`, and `has_next`.

    By rank, then the latest created, then key; one image more than the page is looked for to know of a next one."""
    size = page_size(limit)
    own = live(images).where(F.col("user_id") == owner)
    found = ranked(_of_terms(index, text), _one(index, text), key).drop("query").join(own, key)
    order = [F.desc("rank"), F.desc_nulls_last("created_at"), F.desc(key)]
    probe = found.orderBy(*order).offset(offset).limit(size + 1)
    place = F.row_number().over(Window.orderBy(*order))
    some = probe.withColumns({"__place": place, "has_next": F.count("*").over(Window.partitionBy()) > size})
    return some.where(F.col("__place") <= size).select(*images.columns, "rank", "has_next")


def _one(index: DataFrame, text: str) -> DataFrame:
    return index.sparkSession.range(1).select(F.lit(0).alias("query"), F.lit(text).alias("text"))


def _of_terms(index: DataFrame, text: str) -> DataFrame:
    """The rows of the index that a text may find; its terms become ranges that reach the scan."""
    terms = stems_of(index.sparkSession, text)
    begins = [(F.col("term") >= t) & (F.col("term") < t + chr(0x10FFFF)) for t in terms]
    return index.where(reduce(lambda a, b: a | b, begins)) if terms else index.limit(0)


def find_one(index: DataFrame, text: str, limit: int = 50, key: str = "image_id") -> DataFrame:
    """find() for one query given as a string, which reads no more of a written index than its terms."""
    return find(_of_terms(index, text), _one(index, text), limit, key).drop("query")


def stems_of(spark: SparkSession, text: str) -> list[str]:
    """The distinct stems of a text's words, without stop words."""
    words = F.array_distinct(tokens(F.lit(text)))
    row = spark.range(1).select(F.array_distinct(F.transform(F.filter(words, lambda w: ~is_stop_word(w)), stem)).alias("t")).first()
    return row["t"]


def scan_one(texts: DataFrame, text: str, key: str = "image_id", column: str = "raw_text") -> DataFrame:
    """The records that find_one() finds, by their texts alone: (key); what an index must agree with."""
    terms = stems_of(texts.sparkSession, text)
    stems = F.transform(F.filter(tokens(column), lambda w: ~is_stop_word(w)), stem)
    rows = texts.withColumn("__stems", stems)

    def begun(term: str) -> Column:
        return F.exists("__stems", lambda s: F.startswith(s, F.lit(term)))

    return rows.where(reduce(lambda a, b: a & b, map(begun, terms), F.lit(bool(terms)))).select(key)


def oracle_ctes(texts: str, queries: str) -> dict[str, str]:
    """CTEs of DuckDB's SQL from texts (image_id, raw_text) and queries (query, text) to ranked (query, image_id, rank)."""
    from ..functions.english import stem_sql

    split = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    near = f"ln(1 - {WEIGHT} * sqrt(1 / (1.005 + 0.05 * exp(abs(x.pos - y.pos) / 1.5 - 2))))"
    return {
        "spots": f"SELECT image_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT image_id, {split.format('raw_text')} AS w FROM {texts})",
        "asked": f"SELECT DISTINCT query, unnest({split.format('text')}) AS word FROM {queries}",
        "lexicon": stem_sql("word", "(SELECT DISTINCT word FROM spots UNION SELECT DISTINCT word FROM asked)"),
        "stemmed": "SELECT image_id, term, pos FROM spots JOIN lexicon USING (word)",
        "terms": "SELECT DISTINCT query, term AS q FROM asked JOIN lexicon USING (word)",
        "met": "SELECT terms.query, q, v.term FROM terms JOIN (SELECT DISTINCT term FROM stemmed) v ON starts_with(v.term, q)",
        "hits": "SELECT query, q, s.image_id, s.term, s.pos FROM met JOIN stemmed s ON s.term = met.term",
        "whole": "SELECT query, image_id, n FROM (SELECT query, image_id, count(DISTINCT q) AS m FROM hits GROUP BY 1, 2) JOIN (SELECT query, count(*) AS n FROM terms GROUP BY 1) USING (query) WHERE m = n",
        "single": f"SELECT query, image_id, sum(CAST({WEIGHT} AS DOUBLE) / (CAST(k AS DOUBLE) * k) / CAST({LIMIT} AS DOUBLE)) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query, image_id, term ORDER BY pos) AS k FROM hits) JOIN whole USING (query, image_id) WHERE n = 1 GROUP BY 1, 2",
        "several": f"SELECT query, image_id, greatest(1 - exp(coalesce(t, 0)), CAST({LEAST_RANK} AS DOUBLE)) AS rank FROM (SELECT w.query, w.image_id, sum({near}) AS t FROM (SELECT * FROM whole WHERE n > 1) w LEFT JOIN hits x ON x.query = w.query AND x.image_id = w.image_id LEFT JOIN hits y ON y.query = x.query AND y.image_id = x.image_id AND x.q < y.q AND x.pos <> y.pos AND abs(x.pos - y.pos) <= {REACH} GROUP BY 1, 2)",
        "ranked": "SELECT * FROM single UNION ALL SELECT * FROM several",
    }


def harmonic(n: int) -> float:
    """_frequency() in plain Python, for tests."""
    return WEIGHT / LIMIT * math.fsum(1 / (j * j) for j in range(1, n + 1))
