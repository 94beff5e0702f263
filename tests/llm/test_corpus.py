"""Mixing, near duplicates, decontamination, scores and rules against brute force on small tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenlake.llm import _text, ctw, decontam, graph, jaccard, mixing, nbsvm, rules
from lumenlake.llm.rtree import CountTree, needed, search_runs

WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# ---- mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, budget = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def mixed_docs(spark, n=400):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([1, 5, 30, 200])), rng.choice(["a", "a", "a", "b", "c", "Z", "é", None]), 1) for i in range(n)]
    rows += [(n, None, "a", 1), (n + 1, "", "b", 1), (n + 2, " \n\t", None, 1), (3, "same id", "a", 1), (3, "same id", "a", 1), (None, "no id", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int"), rows


def test_mix_meets_its_targets(spark):
    docs, rows = mixed_docs(spark)
    sizes = collections.Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(WORD, text or ""))
    want = brute_targets(sizes)
    for bucket_rows in (1_000, 20):
        got = mixing.copies(docs, bucket_rows=bucket_rows, fan_in=3).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((i is None, i or 0, len(re.findall(WORD, t or ""))) for i, t, _, _ in rows)
        taken = collections.Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            assert r["copies"] in (0, 1, 2) and (r["size"] or not r["copies"])
            taken[r["source"]] += r["copies"] * r["size"]
        for source, target in want.items():
            assert abs(taken[source] - target) <= 100  # half the largest document


def test_mix_agrees_with_itself_and_keeps_columns(spark):
    docs, _ = mixed_docs(spark)
    key = lambda rows: sorted(tuple(r) for r in rows)
    plan = [(str(r["doc_id"]), r["size"], r["copies"]) for r in mixing.copies(docs).collect()]
    again = [(str(r["doc_id"]), r["size"], r["copies"]) for r in mixing.copies(docs.repartition(7)).collect()]
    assert sorted(plan) == sorted(again)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counts = collections.Counter(str(r["doc_id"]) for r in out.collect())
    expected = collections.Counter()
    for doc_id, _, copies in plan:
        expected[doc_id] += copies
    assert counts == +expected and all(r["size"] == 1 for r in out.limit(5).collect())
    assert mixing.copies(docs.limit(0)).count() == 0 and key(mixing.mix(docs.limit(0)).collect()) == []


def test_mix_does_not_depend_on_partitions(spark):
    """Equal ids of different texts, and equal rows, however they are dealt out."""
    rng = random.Random(9)
    rows = [(7, f"{k % 90:04d} " + "w " * 30, "a", k) for k in range(200)] + [(k, prose(rng, 40), rng.choice("ab"), 0) for k in range(60)]
    make = lambda r, n: spark.createDataFrame(r, "doc_id long, text string, source string, mark int").repartition(n)
    results = [sorted(map(tuple, mixing.mix(make(r, n)).collect())) for r, n in ((rows, 3), (rows[::-1], 211), (rows, 1))]
    assert results[0] == results[1] == results[2] and len({r[1] for r in results[0] if r[0] == 7}) > 50
    plan = mixing.copies(make(rows, 5), bucket_rows=20).collect()
    sevens = {r["n_row"] for r in plan if r["doc_id"] == 7}
    assert len({k % 10 for k in sevens}) > 5  # not all in one bucket


def plain_rounding(rows, target, bucket_rows, fan_in, seed):
    """Copies per row key of (key, doc_id, source, size), pair by pair and level by level, with dictionaries."""
    taken, open_, nodes = {}, {}, {}
    for source in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == source]
        ratio = target[source] / sum(r[3] for r in own) if sum(r[3] for r in own) else 0.0
        nodes[source] = -(-len(own) // bucket_rows)
        for r in own:
            whole = math.floor(ratio + 1e-9) if r[3] else 0
            taken[r] = taken.get(r, 0) + whole
            open_.setdefault(source, []).append([r, max(ratio - whole, 0.0) if r[3] else 0.0, r[0] % nodes[source]])
    while any(open_.values()):
        for source, items in open_.items():
            later = []
            for bucket in sorted({b for _, _, b in items}):
                group = sorted((x for x in items if x[2] == bucket), key=lambda x: (-x[0][3], x[0][0], x[0][1] is not None, x[0][1] or 0))
                for x in group:
                    x[1] = 0.0 if x[1] < 1e-9 else 1.0 if x[1] > 1 - 1e-9 else x[1]
                free, kept, seen = [], [], collections.Counter()
                for x in reversed([x for x in group if 0 < x[1] < 1]):
                    seen[x[0][3].bit_length()] += 1
                    (kept if seen[x[0][3].bit_length()] <= 2 else free).insert(0, x)
                waiting = None
                for x in free:
                    if waiting is None:
                        waiting = x
                        continue
                    (a, b), u = (waiting, x), mixing._noise(x[0][0] ^ (waiting[0][0] << 1), seed)
                    sa, sb = a[0][3], b[0][3]
                    up, down = min((1 - a[1]) * sa, b[1] * sb), min(a[1] * sa, (1 - b[1]) * sb)
                    move = up if u * (up + down) < down else -down
                    for y, p in ((a, a[1] + move / sa), (b, b[1] - move / sb)):
                        y[1] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
                    waiting = a if 0 < a[1] < 1 else b if 0 < b[1] < 1 else None
                if nodes[source] == 1:
                    error, rest = 0.0, kept + [waiting] * (waiting is not None)
                    for x in sorted(rest, key=lambda x: (-x[0][3], group.index(x))):
                        up, down = error + (1 - x[1]) * x[0][3], error - x[1] * x[0][3]
                        x[1], error = (1.0, up) if abs(up) < abs(down) else (0.0, down)
                for x in group:
                    if nodes[source] > 1 and 0 < x[1] < 1:
                        later.append(x)
                    else:
                        taken[x[0]] += round(x[1])
            open_[source] = later
            nodes[source] = -(-nodes[source] // fan_in)
            for x in later:
                x[2] %= nodes[source]
        seed += 1
    return taken


def test_copies_are_those_of_a_plain_rounding(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.choice([1, 3, 9, 40, 130])), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(500)] + [(1000, "", "a"), (1001, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for bucket_rows, fan_in in ((1_000, 64), (20, 3), (7, 2)):
        got = mixing.copies(docs.repartition(5), bucket_rows=bucket_rows, fan_in=fan_in).collect()
        target = {r["source"]: r["target"] for r in got}
        want = plain_rounding([(r["n_row"], r["doc_id"], r["source"], r["size"]) for r in got], target, bucket_rows, fan_in, 17)
        assert {(r["n_row"], r["doc_id"], r["source"], r["size"]): r["copies"] for r in got} == want


def test_pivot_keeps_mass():
    rng = random.Random(1)
    for _ in range(300):
        a, b, s, t = rng.random(), rng.random(), rng.randint(1, 50), rng.randint(1, 50)
        p, q = mixing.pivot(a, s, b, t, rng.random())
        assert p * s + q * t == pytest.approx(a * s + b * t, abs=1e-6) and (p in (0, 1) or q in (0, 1))


# ---- near duplicates


def brute_components(rows, k, num, den):
    sets = {}
    for doc_id, text in rows:
        w = re.findall(WORD, lower(text))
        sets[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if shared and den * shared >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_rows(seed=2):
    rng, rows = random.Random(seed), []
    passage = prose(rng, 40, 10_000)
    for family in range(30):
        base = prose(rng, rng.choice([3, 9, 14, 60, 150]), rng.choice([6, 5_000])).split()
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
            rows.append((" ".join(words) + (" " + passage if family % 3 == 0 else "")).upper() if rng.random() < 0.1 else " ".join(words))
    rows += ["", None, " \n ", "one", "One", "one two", "the the the the the the", passage, passage]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


def test_sets_by_a_filter_and_by_a_join(spark, monkeypatch):
    rows = [(k, f"one two three four five {k} six") for k in range(400)] + [(None, "x y z"), (3, "again and again and so on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = spark.createDataFrame([(k,) for k in range(0, 400, 3)], "node long")
    asked = set(range(0, 400, 3))
    results = []
    for most in (27, 8):  # a filter, and more nodes than one may have bits for
        monkeypatch.setattr(jaccard, "MOST_BITS", most)
        found = [(r["node"], bytes(r["shingles"])) for r in jaccard._sets(nodes, docs, 3).collect()]
        results.append(sorted(f for f in found if f[0] in asked))
        assert asked <= {f[0] for f in found} and len(found) < 200
    assert results[0] == results[1] and len(results[0]) == len(asked) + 1


@pytest.mark.parametrize("k,num,den,hot,block", [(3, 90, 100, 1000, 4096), (5, 8, 10, 0, 4), (2, 6, 10, 50, 3)])
def test_components_match_brute_force(spark, k, num, den, hot, block):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    got = jaccard.classes(docs, k, num, den, hot_shingles=hot, block_rows=block, group_shingles=2_000_000 if block > 9 else 300).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k, num, den)


def test_dedupe_keeps_one_of_each(spark):
    rows = near_rows(5)
    want = brute_components(rows, 5, 8, 10)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)] + [(rows[0][0], rows[0][1], 999), (None, "no id", 7), (None, "no id", 7)], "doc_id long, text string, node long")
    got = jaccard.dedupe(docs)
    assert got.columns == docs.columns
    ids = collections.Counter(r["doc_id"] for r in got.collect())
    assert ids == collections.Counter({d: 1 for d, (n, c) in want.items() if c == d or not n}) + collections.Counter({None: 2})
    assert jaccard.classes(docs.limit(0)).count() == 0 and jaccard.dedupe(docs.limit(0)).count() == 0


def test_tree_misses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 9, (40, 64))
    points = np.maximum(0, np.repeat(base, 10, axis=0) + rng.integers(-1, 2, (400, 64)))
    sizes = points.sum(axis=1)
    got = {(min(a, b), max(a, b)) for i, j in CountTree(points, sizes).self_join(9, 10) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if np.minimum(points[a], points[b]).sum() >= needed(sizes[a], sizes[b], 9, 10) and 10 * min(sizes[a], sizes[b]) >= 9 * max(sizes[a], sizes[b])}
    assert got == want


def test_searched_runs_miss_nothing_and_cut_boxes():
    rng = np.random.default_rng(4)
    points = np.maximum(0, np.repeat(rng.integers(0, 9, (60, 16)), 20, axis=0) + rng.integers(-1, 2, (1200, 16)))
    keys = np.sort(rng.integers(0, 7, 1200)) + (np.arange(1200) == 600)
    sizes = points.sum(axis=1)
    query = np.array([points[np.flatnonzero(keys == k)[0]] for k in keys])
    got = search_runs(keys, points, sizes, query, query.sum(axis=1), 9, 10)
    bound = np.minimum(points, query).sum(axis=1)
    big, small = np.maximum(sizes, query.sum(axis=1)), np.minimum(sizes, query.sum(axis=1))
    assert (got == ((bound >= needed(sizes, query.sum(axis=1), 9, 10)) & (10 * small >= 9 * big))).all() and 0 < got.sum() < 1200


def test_every_link_of_different_sets_comes_through_the_tree(spark, monkeypatch):
    """With trees that find nothing there is no link between different texts; equal sets are no links."""
    rows = [r for r in near_rows() if r[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert any(c != d for d, (_, c) in brute_components(rows, 5, 8, 10).items())
    monkeypatch.setattr(jaccard, "search_runs", lambda keys, *_: np.zeros(len(keys), bool))
    monkeypatch.setattr(jaccard, "_candidates", lambda *_: iter(()))
    got = jaccard.classes(docs, 5, 8, 10, counted=False).collect()
    words = {d: re.findall(WORD, lower(t)) for d, t in rows}
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for d, w in words.items()}
    assert all(sets[r["doc_id"]] == sets[r["component_id"]] for r in got if words[r["doc_id"]])


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200 - i, 199 - i) for i in range(40)] + [(500, 400), (500, 450), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 160 for i in range(160, 201)}, 400: 400, 450: 400, 500: 400}


# ---- decontamination


def test_items_without_an_id(spark):
    words = [f"w{k}" for k in range(60)]
    bench = spark.createDataFrame([(None, " ".join(words[:20])), (-1, " ".join(words[10:30])), (None, " ".join(words[40:])), (5, "nowhere at all")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[40:])), (3, "w1"), (4, " ".join(words[12:30]))], "doc_id long, text string")
    for size in (400_000, 25):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"], sorted(r["items"], key=str), r["longest_item"]) for r in decontam.flagged(docs, bench, block_words=size).collect()}
        assert got == {1: (50, 2, [-1, None], None), 2: (20, 1, [None], None), 3: (0, 0, [], None), 4: (18, 1, [-1], -1)}



def brute_hits(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w, hit, found = re.findall(pattern, lower(text)), set(), set()
    for item_id, body in items:
        b = re.findall(pattern, lower(body))
        k = min(13, len(b))
        windows = {tuple(b[i : i + k]) for i in range(len(b) - k + 1)} if b else set()
        for i in range(len(w) - k + 1 if b else 0):
            if tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add(item_id)
    return len(w), sorted(hit), sorted(found)


@pytest.mark.parametrize("block_words", [400_000, 40])
def test_hits_match_brute_force(spark, block_words):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("ab c, é D".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 4, 12, 13, 14, 25]))) for i in range(12)] + [(20, ""), (21, None), (3, "a a a a a a a a a a a a a a")]
    rows = [(i, text(rng.randint(0, 70))) for i in range(120)] + [(500, None), (501, ""), (502, "a " * 400), (5, "a b c"), (5, "a b c")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, items string").repartition(7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.flagged(docs, bench, block_words=block_words).collect()
    assert sorted((r["doc_id"], r["n_words"], sorted(r["hit"]), sorted(r["items"])) for r in got) == sorted((i, *brute_hits(t, items)) for i, t in rows)
    kept = decontam.remove(docs, bench, block_words=block_words)
    assert kept.columns == docs.columns
    clean = [i for i, t in rows if not (h := brute_hits(t, items))[1] or 20 * len(h[1]) < h[0]]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(clean)
    assert decontam.remove(docs, bench.limit(0)).count() == len(rows) and decontam.flagged(docs.limit(0), bench).count() == 0


def test_long_texts_and_ties(monkeypatch):
    rng = random.Random(3)
    words = np.array([rng.randrange(3) for _ in range(900)], np.uint64)
    offsets = np.array([0, 700, 700, 900])
    item = words[[*range(40, 70), *range(40, 70), *range(300, 312)]]
    block = decontam.Block(np.array([9, 4, 7]), item, np.array([0, 30, 60, 72]))
    whole = decontam.scan(words, offsets, block)
    assert tuple(whole[2][0]) == (30, 4, 40)  # items 4 and 9 have the same words
    for size in (13, 50, 333):
        monkeypatch.setattr(decontam, "SEGMENT_WORDS", size)
        part = decontam.scan(words, offsets, block)
        assert all((a == b).all() for a, b in zip(whole[0], part[0])) and whole[1] == part[1] and (whole[2] == part[2]).all()


def test_longest_match_is_followed_beyond_its_window(spark):
    words = [f"q{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "x y " + " ".join(words[5:35]) + " z"), (2, " ".join(words[:12]))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = {r["doc_id"]: (r["longest"], r["longest_item"], r["longest_at"]) for r in decontam.matches(docs, bench).collect()}
    assert got == {1: (30, 9, 2), 2: (None, None, None)}


# ---- context-tree weighting


def brute_ctw(train, texts):
    """log10 probabilities by a dictionary of nodes, each weighted by recursion over its children."""
    depth = ctw.DEPTH
    counts, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def steps(text):
        data = bytes(depth) + lower(text).encode() + b"\0"
        for p in range(depth, len(data)):
            context = data[p - depth : p][::-1]
            for bit in range(8):
                yield context, (1 << bit) | (data[p] >> (8 - bit)), data[p] >> (7 - bit) & 1

    for text in train:
        for context, prefix, one in steps(text):
            for d in range(depth + 1):
                counts[context[:d], prefix][one] += 1
                if d:
                    children[context[: d - 1], prefix].add((context[:d], prefix))

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(node):
        if node not in memo:
            own = log_kt(*counts.get(node, (0, 0)))
            if len(node[0]) == depth:
                memo[node] = own, 1.0
            else:
                below = sum(weighted(c)[0] for c in children.get(node, ()))
                top = np.logaddexp(own, below) - math.log(2)
                memo[node] = top, math.exp(own - math.log(2) - top)
        return memo[node]

    out = []
    for text in texts:
        total = 0.0
        for context, prefix, one in steps(text):
            mixed = 0.0
            for d in range(depth, -1, -1):
                a, b = counts.get((context[:d], prefix), (0, 0))
                share = weighted((context[:d], prefix))[1]
                mixed = share * ((b if one else a) + 0.5) / (a + b + 1) + (1 - share) * mixed
            total += math.log10(mixed)
        out.append(total)
    return out


def test_scores_match_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 12), 6) + rng.choice(["", " É!", " New"])) for i in range(40)] + [(100, None), (101, ""), (3, "twice"), (None, "no id")]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    train = [t or "" for (_, t), h in zip(rows, held, strict=True) if not h]
    counts = collections.Counter(w for t in train for w in [*re.findall(WORD, lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, t), h, s in zip(rows, held, brute_ctw(train, [t or "" for _, t in rows]), strict=True):
        words = [*re.findall(WORD, lower(t)), None]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want.append((i is None, i or 0, h, len(words), sum(w in counts for w in words), n, round(base, 6), round(s, 6)))
    assert any(held)
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    for near in (10_000, 20):  # with all rows at hand, and with most of them joined
        got = ctw.score(docs, local_grams=near, local_words=near, upper_rows=100 * near).collect()
        rows_ = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
        for a, b in zip(rows_, sorted(want), strict=True):
            assert a[:6] == b[:6] and a[6:] == pytest.approx(b[6:], abs=1e-5)
    assert ctw.score(docs.limit(0)).count() == 0


# ---- classifier and rules

JUNK = [lambda w: " ".join(x.upper() + "!!" for x in w), lambda w: " ".join(x + "$$$" for x in w), lambda w: " | ".join(w), lambda w: " ".join(x for x in w for _ in range(9))]


def labelled(spark, n=240):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(60, 120), 3_000).split()
        bad = rng.random() < 0.3
        docs.append((i, JUNK[i % 4](words) if bad else " ".join(words), 1))
        labels.append((i, 0 if bad else 1))
    docs += [(n, None, 1), (n + 1, "", 1), (n + 2, "short", 1), (7, "again", 1)]
    labels += [(0, labels[0][1]), (9_999, 1), (None, 1), (5, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels[:n])


def test_classifier_on_held_out_documents(spark):
    docs, labels, truth = labelled(spark)
    got = nbsvm.score(docs, nbsvm.fit(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["text"] != "again"]
    assert len(out) > 30 and sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.95 * len(out)
    for some in (labels.limit(0), labels.where("quality = 1")):
        flat = nbsvm.score(docs, nbsvm.fit(docs, some)).select("score").distinct().collect()
        assert len(flat) == 1 and 0 < flat[0]["score"] < 1
    assert nbsvm.score(docs.limit(0), nbsvm.fit(docs.limit(0), labels)).count() == 0


def brute_features(text):
    """The hashed n-grams of one text, gram by gram."""
    raw, bits, out = (text or "").encode(), nbsvm.FEATURE_BITS, set()
    for i in range(len(raw) - 2):
        out.add((int.from_bytes(raw[i : i + 3], "little") * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits))

    def add(value, kind):
        out.add(int(_text.mix(np.array([(value + (kind << 56)) % (1 << 64)], np.uint64))[0]) >> (64 - bits))

    def size(w, chars):
        return sum(c in chars for c in w)

    shapes, before = [], None
    marks = {c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,'-"}
    for w in re.findall(rb"[^\x20\x09-\x0D]+", raw):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in w)
        data = np.frombuffer(low, np.uint8)
        add(int(_text.span_hashes(data, np.array([0]), np.array([len(low)]))[0]), 2)
        upper, lower, digit, mark = size(w, range(65, 91)), size(w, range(97, 123)), size(w, range(48, 58)), size(w, marks)
        shapes.append((upper > 1 and not lower) | (upper > 0 and lower > 0) << 1 | (digit > 0) << 2 | min(mark, 3) << 3 | (low == before) << 5 | (mark == len(w)) << 6)
        before = low
    for n in (1, 2, 3):
        for i in range(len(shapes) - n + 1):
            add(sum(s << 8 * (n - 1 - k) for k, s in enumerate(shapes[i : i + n])), 2 + n)
    return out


def test_features_and_scores_match_brute_force(monkeypatch):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["a", "Bc", "é", "1", "!", "$$", " ", "\n", "word word ", "NO "]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "x", "xy", " \t ", "same same", "w" * 700]
    want = [brute_features(t) for t in texts]
    weights = np.random.default_rng(1).normal(size=1 << nbsvm.FEATURE_BITS)
    model = nbsvm.Model(weights, 1.3, -0.2)
    scores = [1 / (1 + math.exp(-(1.3 * sum(weights[f] for f in w) / math.sqrt(max(1, len(w))) - 0.2))) for w in want]
    for size in (1 << 19, 40):
        monkeypatch.setattr(_text, "SLICE_BYTES", size)
        for i, j, data, offsets in _text.each_slice(pa.array(texts, pa.string()), 500):
            row, feats = nbsvm.features(data, offsets)
            assert [set(feats[row == k].tolist()) for k in range(j - i)] == want[i:j] and len(row) == sum(map(len, want[i:j]))
            assert model.scores(row, feats, j - i) == pytest.approx(scores[i:j])


def test_fit_matches_a_plain_solver():
    """Ratios by counting, and the hinge-loss optimum by many rounds of a plain dual coordinate ascent."""
    rng = np.random.default_rng(7)
    rows = [np.sort(rng.choice(60, 8, replace=False)) for _ in range(60)]
    labels = np.array([int((r < 20).sum() + rng.random() > 2.9) for r in rows])
    ratios = nbsvm.log_count_ratios(rows, labels)
    counts = [collections.Counter(int(f) for r, y in zip(rows, labels) if y == c for f in r) for c in (0, 1)]
    total = [sum(c.values()) + (1 << nbsvm.FEATURE_BITS) for c in counts]
    assert all(ratios[f] == pytest.approx(math.log((counts[1][f] + 1) / total[1]) - math.log((counts[0][f] + 1) / total[0])) for f in range(60))
    dense = np.zeros((60, 60))
    for i, r in enumerate(rows):
        dense[i, r] = ratios[r]
    sign, alpha, w = np.where(labels > 0, 1.0, -1.0), np.zeros(60), np.zeros(60)
    for _ in range(3_000):
        for i in range(60):
            step = min(max(alpha[i] + (1 - sign[i] * (dense[i] @ w)) / (dense[i] @ dense[i]), 0.0), 1.0) - alpha[i]
            alpha[i], w = alpha[i] + step, w + step * sign[i] * dense[i]

    def loss(v):
        return 0.5 * v @ v + np.maximum(0, 1 - sign * (dense @ v)).sum()

    got = nbsvm.dual_descent(rows, [ratios[r] for r in rows], labels, 60, rounds=400)
    assert loss(got) == pytest.approx(loss(w), rel=1e-3) and loss(got) < loss(np.zeros(60))


def test_a_bounded_fit_still_learns(spark):
    docs, labels, truth = labelled(spark)
    got = nbsvm.score(docs, nbsvm.fit(docs, labels, class_features=20_000)).collect()
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["text"] != "again"]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.9 * len(out)


def test_dual_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(50, 10, replace=False)) for _ in range(200)]
    labels = np.array([int((r < 10).sum() > (r >= 40).sum()) for r in rows])
    weights = nbsvm.dual_descent(rows, [np.ones(10)] * 200, labels, 50, rounds=60)
    margin = np.array([weights[r].sum() for r in rows])
    assert ((margin > 0) == (labels > 0)).mean() > 0.9


def brute_statistics(text):
    text = text or ""
    w = re.findall(WORD, text)
    grams, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if grams[w[i], w[i + 1], w[i + 2]] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_statistics_match_brute_force(spark):
    rng = random.Random(10)
    alphabet = ["a", "bb", "é", "ccc", "\n", " ", "\t", "#", "|", "\x0b", "x y z x y z"]
    cases = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    cases += [None, "", " \n \n", "a b c", "a b c a b c", "a a a a", "line\nline\n line\n\n\n", "\x85  ", "w " * 3_000, prose(rng, 5_000, 30)]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(cases)], "doc_id long, text string, n_words int")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in rules.statistics(docs).collect()}
    assert got == {i: brute_statistics(t) for i, t in enumerate(cases)}


def test_rules_are_learned_and_keep_clean_documents(spark):
    docs, labels, truth = labelled(spark)
    got = rules.judge(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] in truth and r["text"] != "again":
            assert r["kept"] == bool(truth[r["doc_id"]]), (r["rule"], r["text"][:80])
        assert not (r["kept"] and r["base_failed"])
    assert all(r["rule"] is None for r in rules.judge(docs, labels, most_rules=0).collect())
    none = rules.judge(docs, labels.limit(0)).collect()
    assert all(r["kept"] != r["base_failed"] for r in none)
    assert rules.judge(docs.limit(0), labels).count() == 0


def test_documents_are_kept_as_the_list_says(spark):
    """Every document against the learned list, read condition by condition over statistics of its own text."""
    docs, labels, _ = labelled(spark)
    more = [(5_000 + i, t, 1) for i, t in enumerate([prose(random.Random(i), 80, 9 + i) + (" #$%" * i) + ("!" * 9 * i) for i in range(12)] + ["A " * 70, "1 22 333 " * 40, "line of words\n" * 30])]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, score int"))
    learned = rules.fit(docs, labels)
    assert learned

    def features(text):
        n, chars, symbols, dup, repeat, failed = brute_statistics(text)
        text, w = text or "", re.findall(WORD, text or "")
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        count = lambda pattern: len(re.findall(pattern, text))
        over = lambda part, whole: part / whole if whole else 0.0
        return failed, dict(
            symbol_share=over(symbols, chars), dup_line_share=over(dup, len(lines)), repeat_share=over(repeat, n), upper_share=over(count("[A-Z]"), chars), mean_word=over(chars, n), bang_share=over(count("[!?]"), chars), digit_share=over(count("[0-9]"), chars), distinct_share=over(len(set(w)), n)
        )

    for r in rules.judge(docs, labels).collect():
        failed, f = features(r["text"])
        hit = next((" and ".join(map(str, rule)) for rule in learned if all((f[c.feature] > c.bound) == c.above for c in rule)), None)
        assert (r["base_failed"], r["kept"], r["rule"]) == (failed, not failed and hit is None, None if failed else hit)


def test_grown_rules_are_conjunctions_of_thresholds():
    rng = random.Random(2)
    rows = [{"x": rng.random(), "y": rng.random()} for _ in range(900)]
    for r in rows:
        r["bad"] = int(r["x"] > 0.7 and r["y"] <= 0.4)
    learned = rules.learn(rows, "bad", ("x", "y"))
    wrong = sum(any(all(c.holds(r) for c in rule) for rule in learned) != bool(r["bad"]) for r in rows)
    assert learned and wrong <= 20 and all(len(rule) <= 4 for rule in learned)


def brute_links(rows, k, num, den):
    """Per doc_id the number of distinct other shingle sets that its own links with."""
    sets = {}
    for doc_id, text in rows:
        w = re.findall(WORD, lower(text))
        sets[doc_id] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset({tuple(w)} if w else ())
    distinct = set(sets.values()) - {frozenset()}
    return {d: sum(den * len(s & t) >= num * len(s | t) for t in distinct if t != s) if s else 0 for d, s in sets.items()}


@pytest.mark.parametrize("k,num,den,shingles,link_rows", [(3, 90, 100, 2_000_000, 1024), (5, 8, 10, 300, 1024), (2, 6, 10, 2_000_000, 3)])
def test_all_links_are_counted(spark, k, num, den, shingles, link_rows):
    rng, rows = random.Random(4), near_rows()
    base = prose(rng, 200, 5_000).split()
    for i in range(12):  # a family whose members all link with each other
        rows.append((len(rows), " ".join([*base[:100], f"own{i}", *base[100:]])))
    want = brute_links(rows, k, num, den)
    assert max(want.values()) >= 11
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.classes(docs, k, num, den, group_shingles=shingles, link_rows=link_rows).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == want


def test_counts_of_a_large_point_do_not_wrap():
    raw = np.full(64 * 300, 255, np.uint8)  # 76,500 tokens in each of 64 groups
    n = int(raw.sum()) + 7
    points = jaccard.Points(pa.array([raw.tobytes()] * 2, pa.binary()), np.array([n, n]))
    assert points.matrix(64).sum() == 2 * raw.sum(dtype=np.int64)
    one = np.zeros(1, np.int64)
    small = jaccard.Points(pa.array([np.full(64, 255, np.uint8).tobytes()], pa.binary()), np.array([n]))
    assert points.bounds(one, small, one)[0] >= 64 * 255
