"""How filters interact: what each removes, at each place of every order in which they can run.

A document's failures are a mask of the filters.  Each mask has big integers with one field for each of the 600 steps
of the 120 orders of five filters; a field is 1 if the outcome it counts happens at that step.  The integers of all
documents of a part are summed, each mask's times the documents that have it, and the fields of the sum are the counts.
A field has 64 bits, and no table has 2^64 rows, so no field runs over into the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import bound_batches, materialize, tidy

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_SHARE, UPPER_SHARE, SYMBOLS = 200, 50, 3, "#$%&*|"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
STEPS = [(order, k) for order in ORDERS for k in range(len(FILTERS))]
FIELD_BYTES = 8

_WORDS = _text.folding(_text.NON_SPACE)
_UPPER = _text._flags(range(0x41, 0x5B))
_SYMBOL = _text._flags(SYMBOLS.encode())
_FIRST_BYTE = ~_text._flags(range(0x80, 0xC0))


def _failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mask of what each text fails of A to D."""
    words, parents = _text.tokens(data, offsets, _WORDS)
    n = len(offsets) - 1
    n_words = np.bincount(parents, minlength=n)
    coded = words.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    n_distinct = np.bincount(_text.distinct(parents * size + coded.indices.to_numpy().astype(np.int64)) // size, minlength=n)

    def count(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
        return np.diff(upto[offsets])

    fails = [n_words < LEAST_WORDS, 100 * n_distinct < DISTINCT_SHARE * n_words, 100 * count(_UPPER) > UPPER_SHARE * count(_FIRST_BYTE), count(_SYMBOL) > 0]
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def failures(docs: DataFrame) -> DataFrame:
    """docs without text, with `mask` (bit k for filter k of A to D) and `digest` (SHA-256 of the text, which stands
    for it)."""
    docs = docs.drop("mask", "digest")
    bound_batches(docs.sparkSession)
    at, names = docs.columns.index("text"), [c for c in docs.columns if c != "text"]

    @tidy
    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask, digest = [np.zeros(0, np.int32)], []
            for _, _, data, offsets in _text.each_slice(b.column(at)):
                mask.append(_failures(data, offsets))
                digest += [hashlib.sha256(data[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            kept = [b.column(k) for k in range(b.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(mask), pa.int32()), pa.array(digest, pa.binary())], [*names, "mask", "digest"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(masks, f"{types}, mask int, digest binary")


def _packed(fields: list[bool]) -> int:
    return int.from_bytes(b"".join(int(x).to_bytes(FIELD_BYTES, "little") for x in fields), "little")


def _unpacked(total: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(FIELD_BYTES * len(STEPS), "little"), np.int64)


def _outcomes(mask: int) -> dict[str, int]:
    """What happens to a document of a mask at each step, as big integers of 600 fields."""
    fails = {f for k, f in enumerate(FILTERS) if mask >> k & 1}
    earlier = [bool(fails & set(order[:k])) for order, k in STEPS]
    own = [order[k] in fails for order, k in STEPS]
    return {
        "kept": _packed([not e and not o for e, o in zip(earlier, own)]),
        "removed": _packed([o and not e for e, o in zip(earlier, own)]),
        "redundant": _packed([o and e for e, o in zip(earlier, own)]),
        "unique_fails": _packed([fails == {order[k]} for order, k in STEPS]),
    }


_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _summed(table: pa.Table) -> pa.Table:
    """The 600 steps of one part, from the documents of each mask and label: 128 rows at most."""
    totals = dict.fromkeys(_COUNTS[:-1], 0)
    for row in table.to_pylist():
        outcome = _outcomes(row["mask"])
        for name, packed in outcome.items():
            totals[name] += row["n"] * packed
        totals["good_lost"] += row["n"] * row["good"] * outcome["removed"]
        totals["toxic_lost"] += row["n"] * row["toxic"] * outcome["removed"]
    counts = {name: _unpacked(total) for name, total in totals.items()}
    own = np.array([FILTERS.index(order[k]) for order, k in STEPS])
    counts["shapley"] = np.array([counts["removed"][own == k].sum() for k in range(len(FILTERS))], np.int64)[own]
    part = pa.array([table.column("part")[0].as_py()] * len(STEPS), pa.string())
    return pa.table({"part": part, "filter_order": [order for order, _ in STEPS], "step": pa.array([k + 1 for _, k in STEPS], pa.int32()), **{c: counts[c] for c in _COUNTS}})


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every
    language, order of the filters and step of it, with zeros.

    A document fails A with under 200 words, B if fewer than half of its words are distinct, C if more than 3% of its
    code points are A-Z, D with any of #$%&*|, and E if a document of a smaller doc_id, anywhere in the table, has the
    same text.  removed: fails the step's filter and no earlier one; redundant: fails it and an earlier one;
    unique_fails: fails it alone; good_lost, toxic_lost: removed here with labels.quality or labels.toxic 1; shapley:
    what the filter removes, over all orders.

    A null text is empty and a null lang the empty part.  A null doc_id is neither smaller than another nor has it a
    smaller one, and no label.  Repeated rows count each; those of one doc_id and text are not copies of each other.
    If labels repeat a doc_id, any 1 counts.  An empty table gives no rows.  Further columns are left out.

    Copies of any number meet in a sum of their digest and are joined by it; counts of masks, not documents, reach a part.
    """
    each = docs.select(F.col("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    each = materialize(failures(each), "interactions-masks")
    first = each.groupBy("digest").agg(F.min("doc_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    marks = labels.groupBy("doc_id").agg(*(F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    joined = each.join(marks, "doc_id", "left").join(first, "digest", "left")
    copy = F.coalesce(F.col("__first") < F.col("doc_id"), F.lit(False)).cast("int")
    masks = joined.select("part", (F.col("mask") + copy * (1 << FILTERS.index("E"))).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counts = masks.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    return counts.groupBy("part").applyInArrow(_summed, schema)


def oracle(table: str = "documents", labels: str = "labels") -> str:
    """The same rows in DuckDB's SQL, step by step for every mask."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM {table}),
f AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM {labels} GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first_id < f.doc_id THEN 'E' ELSE '' END AS fails
  FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
c AS MATERIALIZED (SELECT part, fails, good, toxic, count(*) AS n FROM m GROUP BY ALL),
steps AS (SELECT filter_order, step, filter_order[step] AS letter, left(filter_order, step - 1) AS earlier FROM (SELECT unnest([{', '.join(f"'{o}'" for o in ORDERS)}]) AS filter_order), (SELECT unnest(range(1, 6)) AS step)),
o AS (SELECT *, contains(fails, letter) AS own, translate(fails, earlier, '') <> fails AS gone FROM c, steps),
s AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (own AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = letter), 0) AS unique_fails, coalesce(sum(n * good) FILTER (own AND NOT gone), 0) AS good_lost, coalesce(sum(n * toxic) FILTER (own AND NOT gone), 0) AS toxic_lost
  FROM o GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM s
"""
