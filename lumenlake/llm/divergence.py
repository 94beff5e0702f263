"""How far the sources of a language differ in what they write about.

Every document is a sparse vector of term counts over the vocabulary of its language, as a count vectoriser with a
least document frequency and the largest integer as size of the vocabulary makes it.  The vectors are summed by
group (language and source), and the groups' smoothed term shares are compared: every two sources of a language,
and each source with its whole language.

Spark ML's own vectoriser brings the vocabulary to the driver and from there to each task, and with the largest
integer as its size nothing bounds that.  So here the vocabulary is a table, and a vector's indices are the terms
themselves; the counts are those of Spark ML's class, against which the tests hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import bound_batches, materialize, tidy

#: Documents of its language that a term of the vocabulary is in at least, and the most terms of a vocabulary.
MIN_DF, VOCAB_SIZE = 30, 2**31 - 1
#: Added to each count, and what shares are fractions of.
SMOOTHING, SCALE = 5, 1_000_000_000
#: Ranks of part `term`.
TOP_TERMS = 50
#: Rows that a task sums before it hands them on; sums of one block of terms; sources of one tile of pairs.
HELD_ROWS, BLOCK_ROWS, TILE = 500_000, 10_000, 256

_TABLE = _text.folding(_text._flags([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]), _text.LOWER)
_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])


def count_matrix(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The sparse count vectors of texts as one matrix: its terms, and the text, term and count of each entry."""
    data, offsets = _text.utf8(texts)
    words, parents = _text.tokens(data, offsets, _TABLE)
    coded = words.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    keys = np.sort(parents * size + coded.indices.to_numpy().astype(np.int64))
    fresh = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(fresh, append=len(keys))
    return coded.dictionary, keys[fresh] // size, keys[fresh] % size, counts


def document_vectors(docs: DataFrame) -> DataFrame:
    """docs with `terms` and `counts`: the sparse vector of each text, without a vocabulary's limits.

    A null text is empty; columns of these names are replaced."""
    docs = docs.drop("terms", "counts")
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    @tidy
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms, rows, cols, counts = count_matrix(b.column(at))
            ends = np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32)
            spelled = terms.take(pa.array(cols)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, spelled), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))], [*b.schema.names, "terms", "counts"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(vectors, f"{names}, terms array<string>, counts array<bigint>")


def group_sums(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): the sums of the documents' vectors, and the documents that have the term.

    Each task sums the vectors of its documents by group; what it hands on are sums, and groups of any size are
    spread over their terms.  Null text, lang and source are empty."""
    docs = docs.select("lang", "source", "text")
    bound_batches(docs.sparkSession)

    def summed(tables: list[pa.Table]) -> pa.Table:
        found = pa.concat_tables(tables).combine_chunks().group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("df", "sum")])
        return pa.table([found.column(c) for c in ("lang", "source", "term", "n_sum", "df_sum")], schema=_SUMS)

    @tidy
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for b in batches:
            langs, sources = (b.column(k).fill_null("").cast(pa.string()).dictionary_encode() for k in (0, 1))
            codes = langs.indices.to_numpy().astype(np.int64) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
            present, of = np.unique(codes, return_inverse=True)
            terms, rows, cols, counts = count_matrix(b.column(2))
            size = max(len(terms), 1)
            keys = of[rows] * size + cols
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            if not len(first):
                continue
            n, df = np.add.reduceat(counts[order], first), np.diff(first, append=len(keys))
            group, term = present[keys[first] // size], pa.array(keys[first] % size)
            of_lang, of_source = pa.array(group // len(sources.dictionary)), pa.array(group % len(sources.dictionary))
            columns = [langs.dictionary.take(of_lang), sources.dictionary.take(of_source), terms.take(term).cast(pa.string()), n, df]
            held.append(pa.table(columns, schema=_SUMS))
            rows_held += len(first)
            if rows_held > HELD_ROWS:
                held = [summed(held)]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield from held[0].to_batches(20_000)
                    held = []
                rows_held = sum(t.num_rows for t in held)
        if held:
            yield from summed(held).to_batches(20_000)

    each = docs.mapInArrow(sums, "lang string, source string, term string, n bigint, df bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def vocabulary(sums: DataFrame, min_df: int = MIN_DF, vocab_size: int = VOCAB_SIZE) -> DataFrame:
    """(lang, term, lang_n): the terms of each language in at least min_df of its documents; of more than
    vocab_size, those that occur most, of equally frequent ones the first."""
    kept = sums.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("__df")).where(F.col("__df") >= min_df).drop("__df")
    if vocab_size >= VOCAB_SIZE:
        return kept
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("lang_n"), "term"))
    return kept.withColumn("__rank", rank).where(F.col("__rank") <= vocab_size).drop("__rank")


def _share(count, total, size):
    """The smoothed share of a count, in exact integers."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + {SMOOTHING} as decimal(19, 0))) div ({total} + {SMOOTHING} * {size})")


def _pairs_of_block(table: pa.Table) -> pa.Table:
    """Over the terms of a block, for every two sources of one tile or of two: the sum of the differences where one of
    them has the term at least, and the number of such terms.

    table: (lang, low, high, source, tile, term, p, zero), zero being the share of a term that the source lacks, and each
    source of the tiles once with a null term, as it may have none in the block.  A source is compared with the others
    over the terms that it has, and over no others."""
    lang, low, high = (table.column(c)[0] for c in ("lang", "low", "high"))
    sources = table.column("source").combine_chunks().dictionary_encode()
    of, names = sources.indices.to_numpy().astype(np.int64), sources.dictionary.to_pylist()
    size = len(names)
    zero, tile = np.zeros(size, np.int64), np.zeros(size, np.int64)
    zero[of], tile[of] = table.column("zero").to_numpy(), table.column("tile").to_numpy()
    known = table.column("term").is_valid().to_numpy(zero_copy_only=False)
    of, table = of[known], table.filter(pa.array(known))
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.argsort(term, kind="stable")
    of, term, p = of[order], term[order], table.column("p").to_numpy()[order]
    # of the terms of s: against the share in r, against r's zero; where r has them too, the share in r against s's zero
    direct, alone, again, both = (np.zeros((size, size), np.int64) for _ in range(4))
    n_terms = int(term[-1]) + 1 if len(term) else 0
    step = max(1, (2 << 20) // size)
    for lo in range(0, n_terms, step):
        width = min(step, n_terms - lo)
        part = slice(*np.searchsorted(term, [lo, lo + width]))
        dense, has = np.repeat(zero[:, None], width, 1), np.zeros((size, width), bool)
        dense[of[part], term[part] - lo], has[of[part], term[part] - lo] = p[part], True
        for s in range(size):
            own = np.flatnonzero(has[s])
            mine, theirs, shared = dense[s, own], dense[:, own], has[:, own]
            direct[s] += np.abs(theirs - mine).sum(1)
            alone[s] += np.abs(mine[None, :] - zero[:, None]).sum(1)
            again[s] += (np.abs(theirs - zero[s]) * shared).sum(1)
            both[s] += shared.sum(1)
    value = direct + alone.T - again
    union = np.diag(both)[:, None] + np.diag(both)[None, :] - both
    rows = [(a, b) if names[a] < names[b] else (b, a) for a in range(size) for b in range(a + 1, size) if low == high or tile[a] != tile[b]]
    a, b = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    return pa.table({"lang": pa.array([lang.as_py()] * len(rows), pa.string()), "a": pa.array([names[k] for k in a], pa.string()), "b": pa.array([names[k] for k in b], pa.string()), "f": value[a, b], "n": union[a, b]})


def _differences(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, f, n): of every two sources a < b of a language with a vocabulary, the sum of differences over the
    terms that either has, and their number.

    Blocks of terms are compared source by source in tiles of sources; a block gives one row a pair, whatever the
    number of its terms."""
    blocks = F.ceil(F.col("lang_rows") / BLOCK_ROWS)
    tiles = F.ceil(F.col("n_sources") / TILE)
    placed = [F.col("zero"), F.pmod(F.xxhash64("source"), tiles).alias("tile"), tiles.alias("__tiles")]
    tiled = shares.select("lang", "source", "term", "p", *placed, F.pmod(F.xxhash64("term"), blocks).alias("block"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block")
    tiled = tiled.unionByName(groups.where("lang_rows > 0").select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), *placed, every))
    met = tiled.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tiles") - 1)))
    met = met.select("lang", "block", F.least("tile", "__other").alias("low"), F.greatest("tile", "__other").alias("high"), "source", "tile", "term", "p", "zero")
    each = met.groupBy("lang", "block", "low", "high").applyInArrow(_pairs_of_block, "lang string, a string, b string, f bigint, n bigint")
    return each.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), F.sum("n").alias("n"))


def audit(docs: DataFrame, min_df: int = MIN_DF, vocab_size: int = VOCAB_SIZE, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source of a language differs from the others.

    Part `pair`: item is another source of the language, value the sum over the vocabulary of the differences of
    their shares.  Part `term`: item is a term that the source has and uses more than its language does, value by
    how much its share is larger, for the top_terms first ranks.  Larger values rank first, of equal ones the first
    item in UTF-8.  A share is 1 + floor(SCALE * (count + SMOOTHING) / (N + SMOOTHING * V)), in exact integers.

    Null lang and source are empty names and a null text is empty; rows count as often as they occur; a document
    of any length is one vector; a source without terms still has its pairs; a language without a vocabulary has
    pairs of value 0; an only source has none; an empty table gives no rows; further columns are left out.  Sums
    are of groups and terms, so a group of any size is spread; the pairs of a language are as many as the square of
    its sources, as they are the result.
    """
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    sums = materialize(group_sums(docs), "divergence-sums")
    kept = materialize(sums.join(vocabulary(sums, min_df, vocab_size), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "divergence-kept")
    of_terms = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(F.count("*").alias("size"), F.sum("lang_n").alias("lang_total"))
    of_groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    groups = docs.select("lang", "source").distinct().join(of_groups, ["lang", "source"], "left").join(of_terms, "lang", "left").fillna(0, ["total", "rows", "size", "lang_total"])
    of_langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources"), F.sum("rows").alias("lang_rows"))
    groups = materialize(groups.join(of_langs, "lang").withColumn("zero", F.when(F.col("size") > 0, _share("0", "total", "size"))), "divergence-groups")

    shares = kept.join(groups.drop("rows"), ["lang", "source"]).withColumns({"p": _share("n", "total", "size"), "q": _share("lang_n", "lang_total", "size")})
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    mine = groups.select("lang", "source", "size", "zero")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("__zero"))
    pairs = mine.join(theirs, "lang").where(F.col("source") != F.col("item"))
    pairs = pairs.withColumns({"a": F.least("source", "item"), "b": F.greatest("source", "item")}).join(_differences(shares, groups), ["lang", "a", "b"], "left")
    neither = (F.col("size") - F.coalesce("n", F.lit(0))) * F.abs(F.col("zero") - F.col("__zero"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("f", F.lit(0)) + F.coalesce(neither, F.lit(0))).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(by_value)).unionByName(terms)


def oracle(table: str = "documents") -> str:
    """The same rows in DuckDB's SQL, with every term of a vocabulary for every two sources."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def share(count: str, total: str) -> str:
        return f"1 + ({SCALE}::HUGEINT * ({count} + {SMOOTHING})) // ({total} + {SMOOTHING}::HUGEINT * v)"

    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({lower}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM {table}),
t AS MATERIALIZED (SELECT lang, source, r, unnest(w) AS term FROM d),
vocab AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DF}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM vocab GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM t JOIN vocab USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(total, 0) AS total, v, lang_total FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN totals ON totals.lang = g.lang AND totals.source = g.source LEFT JOIN langs ON langs.lang = g.lang),
shares AS MATERIALIZED (
  SELECT groups.lang, groups.source, vocab.term, coalesce(n, 0) AS n, {share('coalesce(n, 0)', 'total')} AS p, {share('lang_n', 'lang_total')} AS q
  FROM groups JOIN vocab ON vocab.lang = groups.lang LEFT JOIN counts ON counts.lang = groups.lang AND counts.source = groups.source AND counts.term = vocab.term),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
