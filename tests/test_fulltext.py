"""English stems against a procedural version of the algorithm, and the index against the texts themselves."""

import math
import random
import re

from pyspark.sql import functions as F

from lumenlake.functions import english
from lumenlake.operators import fulltext

VOWELS = "aeiouy"


def region(word):
    for begin in ("gener", "commun", "arsen"):
        if word.startswith(begin):
            return len(begin)
    return after(word, 0)


def after(word, start):
    for k in range(start + 1, len(word)):
        if word[k] not in VOWELS and word[k - 1] in VOWELS:
            return k + 1
    return len(word)


def short_end(word):
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS + "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def plain_stem(word):
    known = dict(skis="ski", skies="sky", dying="die", lying="lie", tying="tie", idly="idl", gently="gentl", ugly="ugli", early="earli", only="onli", singly="singl")
    if word in known or word in "sky news howe atlas cosmos bias andes".split() or len(word) <= 2:
        return known.get(word, word)
    w = list(word)
    for k, c in enumerate(w):
        if c == "y" and (k == 0 or w[k - 1] in VOWELS):
            w[k] = "Y"
    w = "".join(w)
    r1 = region(w)
    r2 = after(w, r1)

    def ends(*suffixes):
        return next((s for s in sorted(suffixes, key=len, reverse=True) if w.endswith(s)), None)

    s = ends("sses", "ied", "ies", "us", "ss", "s")
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in "inning outing canning herring earring proceed exceed succeed".split():
        return w
    s = ends("eed", "eedly", "ed", "edly", "ing", "ingly")
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in "bb dd ff gg mm nn pp rr tt".split():
            w = w[:-1]
        elif short_end(w) and r1 >= len(w):
            w += "e"
    if w[-1] in "yY" and len(w) > 2 and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    pairs = dict(tional="tion", enci="ence", anci="ance", abli="able", entli="ent", izer="ize", ization="ize", ational="ate", ation="ate", ator="ate", alism="al", aliti="al", alli="al", fulness="ful", ousli="ous", ousness="ous", iveness="ive", iviti="ive", biliti="ble", bli="ble", ogi="og", fulli="ful", lessli="less", li="")
    s = ends(*pairs)
    if s and len(w) - len(s) >= r1:
        before = w[: -len(s)][-1:]
        if (s != "ogi" or before == "l") and (s != "li" or (before and before in "cdeghkmnrt")):
            w = w[: -len(s)] + pairs[s]
    pairs = dict(tional="tion", ational="ate", alize="al", icate="ic", iciti="ic", ical="ic", ful="", ness="", ative="")
    s = ends(*pairs)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + pairs[s]
    s = ends(*"al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split())
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w.endswith("ll"):
        w = w[:-1]
    return w.replace("Y", "y")


SAMPLE = dict(
    consign="consign", consigned="consign", consigning="consign", consignment="consign", consist="consist", consisted="consist", consistency="consist", consistent="consist", consistently="consist", consisting="consist", consists="consist",
    consolation="consol", consolations="consol", consolatory="consolatori", console="consol", consoled="consol", consoles="consol", consolidate="consolid", consolidated="consolid", consolidating="consolid", consoling="consol",
    consolingly="consol", consols="consol", consonant="conson", consort="consort", consorted="consort", conspicuous="conspicu", conspicuously="conspicu", conspiracy="conspiraci", conspirator="conspir", constable="constabl", constancy="constanc",
    constant="constant", knack="knack", knackeries="knackeri", knacks="knack", knag="knag", knave="knave", knaves="knave", knavish="knavish", kneaded="knead", kneading="knead", knee="knee", kneel="kneel", kneeled="kneel", kneeling="kneel",
    kneels="kneel", knees="knee", knell="knell", knelt="knelt", knew="knew", knick="knick", knif="knif", knife="knife", knight="knight", knightly="knight", knights="knight", knit="knit", knits="knit", knitted="knit", knitting="knit",
    knives="knive", knob="knob", knock="knock", knocked="knock", knocker="knocker", knots="knot", runs="run", running="run", runner="runner", generate="generat", generates="generat", generically="generic", communism="communism",
    community="communiti", arsenal="arsenal", hopping="hop", hoping="hope", sayings="say", boy="boy", cries="cri", ties="tie", happily="happili", relational="relat", skies="sky", proceeds="proceed", innings="inning", beautiful="beauti",
)


def words():
    rng = random.Random(2)
    ends = "sses ied ies us ss s eed eedly ed edly ing ingly tional enci anci abli entli izer ization ational ation ator alism aliti alli fulness ousli ousness iveness iviti biliti bli ogi fulli lessli li alize icate iciti ical ful ness ative al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion e l y".split()
    parts = "b at el y gener commun arsen ee str ing ou k yy ay tt ll bb iz bl ment ion w x a i sh cr on".split()
    made = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + "".join(rng.choice(ends) for _ in range(rng.randint(0, 2))) for _ in range(6000)}
    return sorted(made | set(SAMPLE) | set(english.KNOWN) | {"a", "is", "y", "yes", "été", "ñandúes", "2023s", "b2b"})


def test_the_plain_version_knows_the_published_sample():
    assert {w: plain_stem(w) for w in SAMPLE} == SAMPLE


def test_stems_equal_the_plain_version_in_both_engines(spark):
    import duckdb

    some = words()
    frame = spark.createDataFrame([(w,) for w in some], "word string").repartition(4)
    got = {r["word"]: r["term"] for r in frame.withColumn("term", english.stem("word")).collect()}
    assert got == {w: plain_stem(w) for w in some}
    con = duckdb.connect()
    con.execute("create table words (word varchar)")
    con.executemany("insert into words values (?)", [(w,) for w in some])
    kept = {w: plain_stem(w) for w in some if w not in english.STOP_WORDS}
    assert dict(con.execute(english.stem_sql()).fetchall()) == kept
    assert {r["word"]: r["term"] for r in english.lexicon(frame).collect()} == kept


def records(n=300):
    rng = random.Random(6)
    vocabulary = "run runs running runner the a of connection connected connecting house houses and hope hopes beauty beautiful x y 2023".split()
    return [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for k in range(n)] + [(1000, None), (1001, ""), (1002, "the of and"), (1003, "Running! RUNS; (house)")]


QUERIES = ["running", "the running of", "beautiful houses", "conn hop", "run conn hope", "the of", "", "nowhere", "2023 x", "run run running"]


def plain_search(rows, query):
    tokens = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    terms = sorted({plain_stem(w) for w in tokens(query) if w not in english.STOP_WORDS})
    out = {}
    for key, text in rows:
        places = [(plain_stem(w), k) for k, w in enumerate(tokens(text)) if w not in english.STOP_WORDS]
        each = [[(s, k) for s, k in places if s.startswith(t)] for t in terms]
        if not terms or not all(each):
            continue
        if len(terms) == 1:
            out[key] = sum(fulltext.harmonic(sum(s == x for s, _ in each[0])) for x in {s for s, _ in each[0]})
        else:
            miss = 1.0
            for i in range(len(terms)):
                for j in range(i + 1, len(terms)):
                    for _, p in each[i]:
                        for _, q in each[j]:
                            if p != q and abs(p - q) <= 100:
                                miss *= 1 - 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(abs(p - q) / 1.5 - 2)))
            out[key] = max(1 - miss, 1e-20)
    return out


def test_index_scan_and_plain_search_agree(spark, tmp_path):
    rows = records()
    texts = spark.createDataFrame(rows, "image_id long, raw_text string").withColumn("term", F.lit("x")).repartition(5)
    index = fulltext.write_index(texts, str(tmp_path / "index"))
    asked = spark.createDataFrame(list(enumerate(QUERIES)) + [(50, None)], "query int, text string")
    got = {}
    for r in fulltext.find(index, asked, 1000).collect():
        got.setdefault(r["query"], {})[r["image_id"]] = round(r["rank"], 9)
    for k, q in enumerate(QUERIES):
        want = {i: round(x, 9) for i, x in plain_search(rows, q).items()}
        assert got.get(k, {}) == want, q
        if k not in (2, 4, 5):  # each is some jobs
            continue
        assert {r[0] for r in fulltext.scan_one(texts, q).collect()} == set(want), q
        assert {r["image_id"] for r in fulltext.find_one(index, q, 1000).collect()} == set(want), q
    assert 50 not in got and got[0] and not got.get(5) and 1003 in got[0]
    assert fulltext.find(index, asked.limit(0)).count() == 0
    assert fulltext.find(fulltext.index(texts.limit(0)), asked).count() == 0


def test_a_search_for_words_reads_ranges_of_terms(spark, tmp_path):
    texts = spark.createDataFrame(records(), "image_id long, raw_text string")
    index = fulltext.write_index(texts, str(tmp_path / "index"))
    plan = fulltext.find_one(index, "beautiful")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(term,beauti)" in plan


def test_ties_go_to_the_latest(spark):
    texts = spark.createDataFrame([(1, "run"), (2, "run"), (3, "run"), (4, "walk run run")], "image_id long, raw_text string")
    order = spark.createDataFrame([(1, 30), (2, 10), (3, 20)], "image_id long, at int")
    found = fulltext.find(fulltext.index(texts), spark.createDataFrame([(0, "running")], "query int, text string"), 3, order=order)
    assert [r["image_id"] for r in found.orderBy("rn").collect()] == [4, 1, 3]
