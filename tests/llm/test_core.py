"""Tokenising, encoding, records, archives and licences, each against a plain version."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenlake.llm import _encode, _text, ctw, licences, nbsvm, records, warc
from lumenlake.llm._encode import PieceEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "B", "é", "ß", "1", "23", " ", "  ", "\n", "\t", "'", "'s", "!", "!!", "$", "—", "×", "中", "😀", "\r\n", ".", "<|endoftext|>", "\x85", "ñ", "_"]


def texts(n, seed=1, size=25):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, size))) for _ in range(n)] + [None, ""]


def test_words_match_a_regular_expression():
    rows = texts(500)
    for inside, pattern in ((_text.NON_SPACE, r"[^\x20\x09-\x0D]+"), (_text.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        for i, j, data, offsets in _text.each_slice(pa.array(rows, pa.string()), 300):
            starts, ends, at = _text.spans(data, offsets, inside)
            raw = data.tobytes()
            got = [raw[s:e].decode() for s, e in zip(starts, ends)]
            for k in range(j - i):
                # the pattern for words of the decontamination contract sees lower-cased text
                text = re.sub("[A-Z]", lambda m: m.group().lower(), rows[i + k] or "")
                assert [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in got[at[k] : at[k + 1]]] == re.findall(pattern, text)


def test_hashes_depend_on_the_word_alone():
    data, offsets = _text.utf8(pa.array(["one two ONE", "xx two", "two"]))
    h, at = _text.word_hashes(data, offsets, _text.NON_SPACE)
    assert h[0] == h[2] and h[1] == h[4] == h[5] and len(set(h.tolist())) == 3 and at.tolist() == [0, 3, 5, 6]


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n)), "".join("ba"[i.bit_count() & 1] for i in range(n))


def test_hashes_of_long_words_and_windows(monkeypatch):
    for n in (100, 255, 256, 257, 2048):
        a, b = thue_morse(n)
        data, offsets = _text.utf8(pa.array([f"{a} {b}", f"{b} x{a} {a.upper()}"]))
        h, _ = _text.word_hashes(data, offsets, _text.NON_SPACE)
        assert h[0] == h[4] and h[1] == h[2] and len(set(h.tolist())) == 3
    rows = [t * 40 for t in texts(30, 8) if t]
    data, offsets = _text.utf8(pa.array(rows))
    whole = [*_text.spans(data, offsets, _text.NON_SPACE), *_text.word_hashes(data, offsets, _text.NON_SPACE), *nbsvm.features(data, offsets)]
    many = [k for i in range(len(rows)) for k, _ in ctw.gram_parts(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))]
    for size in (5, 64, 1000):
        monkeypatch.setattr(_text, "SLICE_BYTES", size)
        part = [*_text.spans(data, offsets, _text.NON_SPACE), *_text.word_hashes(data, offsets, _text.NON_SPACE), *nbsvm.features(data, offsets)]
        assert all((a == b).all() for a, b in zip(whole, part))
        cut = [k for i in range(len(rows)) for k, _ in ctw.gram_parts(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))]
        assert (np.concatenate(many) == np.concatenate(cut)).all()


def test_pieces_of_equal_hashes_keep_their_ids(monkeypatch):
    encoder = PieceEncoder(BPE)
    a, b = thue_morse(200)
    rows = [f"{a} {b} one two", f"{b} one {'long' * 300}", *[t or "" for t in texts(100, 5)]]
    monkeypatch.setattr(_text, "span_hashes", lambda data, starts, ends, fold=None: (ends - starts).astype(np.uint64) % np.uint64(3))
    for size in (1 << 19, 50):
        monkeypatch.setattr(_text, "SLICE_BYTES", size)
        data, offsets = _text.utf8(pa.array(rows))
        ids, at = encoder.encode(data, offsets)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(rows))] == [e.ids for e in encoder.tokenizer.encode_batch(rows, add_special_tokens=False)]


def test_a_full_cache_starts_again(monkeypatch):
    monkeypatch.setattr(_encode, "CACHE_PIECES", 20)
    encoder = PieceEncoder(BPE)
    for t in texts(60, 6):
        data, offsets = _text.utf8(pa.array([t], pa.string()))
        assert encoder.encode(data, offsets)[0].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_wide_ids_take_four_bytes(spark, tmp_path):
    """A vocabulary whose ids pass 65,535: the public one with its ids moved up."""
    import json

    model = json.loads(open(BPE, encoding="utf-8").read())
    model["model"]["vocab"] = {k: v if v < 300 else v + 40_000 for k, v in model["model"]["vocab"].items()}
    for token in model["added_tokens"]:
        token["id"] = model["model"]["vocab"].get(token["content"], token["id"] + 40_000)
    path = tmp_path / "wide.json"
    path.write_text(json.dumps(model), encoding="utf-8")
    assert records.ids_fit_short(BPE, 2) and not records.ids_fit_short(str(path), 2) and not records.ids_fit_short(BPE, 1 << 16)
    docs = spark.createDataFrame([(1, "the antidisestablishmentarianism of words"), (2, "")], "doc_id long, text string")
    records.write(docs, f"file://{tmp_path}/out", str(path))
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in records.read(spark, f"file://{tmp_path}/out").collect()}
    assert got[2] == [2] and max(got[1]) > 65_535 and got[1] == PieceEncoder(str(path)).tokenizer.encode("the antidisestablishmentarianism of words").ids + [2]


@pytest.mark.parametrize("special", [False, True])
def test_pieces_encode_like_whole_texts(special):
    encoder = PieceEncoder(BPE, special)
    rows = texts(4000)
    for i, j, data, offsets in _text.each_slice(pa.array(rows, pa.string()), 2000):
        ids, at = encoder.encode(data, offsets, 2)
        whole = encoder.tokenizer.encode_batch([t or "" for t in rows[i:j]], add_special_tokens=False)
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(j - i)] == [w.ids + [2] for w in whole]


def test_records_round_trip(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(texts(60, 3))] + [(5, "again", "y"), (5, "again", "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = sorted(records.encode_and_read(docs, BPE, f"file://{tmp_path}", shards=3).collect(), key=lambda r: r["start"])
    encoder, start = PieceEncoder(BPE), 0
    for r, (doc_id, text, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
        ids = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    back = records.read(spark, f"file://{tmp_path}").where("doc_id = 5").collect()
    assert len(back) == 3 and all(len(r["ids"]) == 4 * r["n_tokens"] for r in back)
    assert records.encode_and_read(docs.limit(0), BPE).count() == 0


def test_a_damaged_record_is_refused():
    good = records.frame(b"payload")
    assert records.unframe(good) == b"payload"
    for bad in (good[:-1], good[:14] + b"X" + good[15:], b"\x00" + good[1:]):
        with pytest.raises(ValueError):
            records.unframe(bad)


def test_archives_round_trip(spark, tmp_path):
    import hashlib

    long = "<html>" + "word " * 60
    rows = [(7, "http://a/1", long), (3, "http://a/2", long), (9, None, long), (1, "u\r\nv", "short"), (2, "u", "short"), (4, "u", None), (5, "u", ""), (3, "http://a/2", long), (None, "u", long)]
    rows += [(100 + i, f"http://b/{i}", f"<p>page {i}</p>" * 40) for i in range(80)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive(pages, f"file://{tmp_path}", files=2, sample_bytes=4000).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[0] == r["page_id"]][0]
        body = (mine[2] or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha256(body).hexdigest())
    kinds = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got if (r["page_id"] or 0) < 100), key=str)
    assert kinds == sorted([(0, "revisit", 3), (1, "response", None), (2, "response", None), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "response", None), (7, "revisit", 3), (9, "revisit", 3)], key=str)
    whole = warc.read(spark, f"file://{tmp_path}").where("page_id = 100").collect()[0]
    assert bytes(whole["payload"]) == b"<p>page 0</p>" * 40
    assert warc.archive(pages.limit(0)).count() == 0


def test_records_of_one_page_have_ids_of_their_own(spark, tmp_path):
    """Null and repeated page_ids: spread over files by their payloads, and no id twice."""
    rows = [(None, "u", f"<p>payload {k % 150}</p>" * 20) for k in range(300)] + [(5, "u", f"<p>five {k % 2}</p>" * 20) for k in range(6)] + [(6, "u", "short")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.write(pages, f"file://{tmp_path}", files=4)
    sizes = [r["count"] for r in index.where("page_id is null").groupBy("file").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 150
    seen = []
    for r in index.collect():
        with open(f"{tmp_path}/data/part-{r['file']:06d}.warc.zst", "rb") as f:
            unpack = warc.decompressor(f)
            f.seek(r["offset"])
            seen.append(re.search(rb"WARC-Record-ID: (\S+)", unpack.decompress(f.read(r["length"])))[1])
    assert len(seen) == len(set(seen)) == len(rows)
    got = warc.read(spark, f"file://{tmp_path}").collect()
    assert sorted(str(r["refers_to"]) for r in got if r["page_id"] == 5) == ["5"] * 4 + ["None"] * 2
    assert sum(r["record_type"] == "response" for r in got if r["page_id"] is None) == 300


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""

CASES = {
    1: (MIT, "MitGrant,MitNotice", "MIT"),
    2: ("Some text.\nReleased under the MIT License.\nMore.", "MitShort", "MIT"),
    3: ("A.\nLicensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", "CcByNc4,Apache2Short", "Apache-2.0,CC-BY-NC-4.0"),
    4: ("nothing about a licence", "", ""),
    5: (None, "", ""),
    6: ("", "", ""),
    7: ("See the License for the specific language governing permissions and limitations under the License.", "ApacheSee", ""),
    8: ("All rights reserved. All rights reserved.", "AllRights,AllRights", "All-Rights-Reserved"),
}


NOTICES = {
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Example & Sons, Ltd nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
}


def like_the_oracle(docs, got):
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    cur = con.execute(licences.oracle())
    names = [c[0] for c in cur.description]
    return sorted(cur.fetchall()) == sorted(tuple(r[n] for n in names) for r in got)


def test_licence_sentences(spark):
    rows = [(k, v[0]) for k, v in CASES.items()]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, licences string")
    found = licences.scan(docs).collect()
    got = {r["doc_id"]: r for r in found}
    assert {k: (r["sentence_ids"], r["licences"]) for k, r in got.items()} == {k: v[1:] for k, v in CASES.items()}
    assert got[7]["unknown"] == 1 and got[1]["unknown"] == 0
    assert like_the_oracle(rows, found)
    assert licences.scan(docs.limit(0)).count() == 0


def test_whole_notices_are_taken_up_by_rules(spark):
    rows = [(i, f"Title\n\n{t}\n\nmore of it. " * (1 + i % 2)) for i, t in enumerate(NOTICES.values())] + [(0, list(NOTICES.values())[0]), (0, list(NOTICES.values())[0]), (99, "word " * 300_000 + "\n\n" + MIT)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    names = list(NOTICES)
    assert all(r["licences"] == (names[r["doc_id"]] if r["doc_id"] < 99 else "MIT") for r in found)
    left = {names[r["doc_id"]]: r["unknown"] for r in found if r["doc_id"] < 99}
    assert left == {**dict.fromkeys(names, 0), "ISC": left["ISC"]} and left["ISC"] <= 2
    assert like_the_oracle(rows, found)


def test_every_known_sentence_has_a_trigger_and_every_rule_known_sentences():
    assert all(re.search(licences.TRIGGER, s) for s in licences.SENTENCES)
    assert all(set(rule.split(",")) <= set(licences.SENTENCES.values()) for _, rule in licences.RULES)


def test_wrapped_and_one_line_sentences_of_one_text(spark):
    notice = "A heading without an end mark\nReleased under the MIT License\nmore words"
    cases = {1: (f"{notice}\n\n{MIT}", "MitShort,MitGrant,MitNotice"), 2: (f"{MIT}\n\n{notice}", "MitGrant,MitNotice,MitShort"), 3: ("All rights\nreserved. All rights reserved\nx", "AllRights,AllRights")}
    docs = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")
    found = licences.scan(docs).collect()
    assert {r["doc_id"]: r["sentence_ids"] for r in found} == {k: v[1] for k, v in cases.items()}
    assert like_the_oracle([(k, v[0]) for k, v in cases.items()], found)


BSD = NOTICES["BSD-3-Clause"].split("\n\n")
PROBES = {
    "long holder": ("\n\n".join(BSD[:4]).replace("Example & Sons, Ltd", "the very long name " * 30), "BSD-3-Clause", 0),
    "wrapped rights": ("A book.\nAll rights\nreserved.", "All-Rights-Reserved", 0),
    "wrapped domain": ("This work has been released into the public\ndomain.", "Public-Domain", 0),
    "signs in a trigger": ("ALL RIGHTS -- RESERVED", "All-Rights-Reserved", 0),
    "interrupted": ("\n\n".join([BSD[0], MIT, *BSD[1:3]]), "MIT", 3),
    "far apart": ("\n\n".join([BSD[0], *["Some other words."] * 50, *BSD[1:3]]), "", 3),
    "near enough": ("\n\n".join([BSD[0], *["Some other words."] * 3, *BSD[1:3]]), "BSD-2-Clause", 0),
    "just too far": ("\n\n".join([BSD[0], *["Some other words."] * 4, *BSD[1:3]]), "", 3),
    "numbers do not part": ("\n\n".join([BSD[0], *["12.", "--", "(3)"] * 5, *BSD[1:3]]), "BSD-2-Clause", 0),
    "twice": (f"{MIT}\n\n{MIT}", "MIT", 0),
    "grant alone": (MIT.split("\n\n")[0], "MIT", 0),
    "spdx": ("# SPDX-License-Identifier: Apache-2.0\nimport x", "Apache-2.0", 0),
    "spdx and a notice": (f"// spdx-license-identifier : MIT\n\n{MIT}", "MIT", 0),
    "unknown spdx": ("SPDX-License-Identifier: Nobody-1.0", "", 0),
    "an order that no rule has": ("\n\n".join([BSD[2], BSD[1], BSD[0]]), "", 3),
}


def plain_scan(text):
    """Rules over a list of places, sentence by sentence."""
    sentences, spdx = {**licences.SENTENCES, **licences._spdx()[0]}, licences._spdx()[1]
    ids, unknown = [], 0
    for paragraph in re.split(r"\n[ \t\r]*\n", re.sub("(?i)(spdx-license-identifier)[ \t]*:[ \t]*", r"\1 ", text or "")):
        start = 0
        for end in [m.end(1) for m in re.finditer(r"([.!?:;])(?=[ \t\r\n])", paragraph)] + [len(paragraph)]:
            s, start = paragraph[start:end], end
            look = lambda x: sentences.get(re.sub(r"^neither the name of .+? nor the names", "neither the name of the holder nor the names", licences.normal(x)))
            lines = [i for i in map(look, s.split("\n")) if i] if "\n" in s else []
            for i in lines or [look(s)]:
                if i:
                    ids.append((i, unknown > licences.GAP))
                    unknown = 0
                elif re.search("[a-z]", licences.normal(s)):
                    unknown += 1
    places, at = [], 0
    for i, parted in ids:
        at += 2 if parted else 1
        places.append((at, i))
    names = []
    for licence, rule in [*licences.RULES, *spdx]:
        rule, k = rule.split(","), 0
        while k + len(rule) <= len(places):
            some = places[k : k + len(rule)]
            if [i for _, i in some] == rule and some[-1][0] - some[0][0] == len(rule) - 1:
                del places[k : k + len(rule)]
                names += [licence] * (licence not in names)
            else:
                k += 1
    return ",".join(i for i, _ in ids), ",".join(names), len(places)


def test_licences_against_a_plain_version(spark):
    rng = random.Random(5)
    parts = [*BSD, *MIT.split("\n\n"), "Words of a text.", "More. Of it.", "1.", "All rights reserved.", "Licensed under the ISC license.\nand so on"]
    rows = [(k, v[0]) for k, v in enumerate(PROBES.values())] + [(100 + k, "\n\n".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))) for k in range(150)]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["licences"], r["unknown"]) for r in found}
    assert {n: got[k] for k, n in enumerate(PROBES)} == {n: v[1:] for n, v in PROBES.items()}
    whole = {r["doc_id"]: (r["sentence_ids"], r["licences"], r["unknown"]) for r in found}
    assert whole == {k: plain_scan(t) for k, t in rows}
    assert like_the_oracle(rows, found)


def test_whole_licence_texts_as_a_table(spark):
    poem = "Roses are red, and this licence is yours.\nUse the poem as you like.\n\nNever sell it to the moon."
    sentences, rules = licences.table_of({"Poem-1.0": poem, "Short": "Use the poem as you like."})
    docs = spark.createDataFrame([(1, f"Title\n\n{poem}\n\nmore"), (2, "Use the poem as you like. Yes."), (3, MIT)], "doc_id long, text string")
    got = {r["doc_id"]: r["licences"] for r in licences.scan(docs, sentences, rules).collect()}
    assert got == {1: "Poem-1.0", 2: "Short", 3: "MIT"}
