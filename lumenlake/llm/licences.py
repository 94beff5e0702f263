"""Licence scans by sentence rules, with DataFrame functions alone.

A text is cut into sentences, each sentence is normalised and looked up among known licence sentences,
and the sequence of their identifiers is matched against ordered rules.  A rule that matches takes its
sentences away, so that a later, more general rule does not name the same words again, and leaves a mark that
no rule reaches over.  Up to GAP unknown sentences between two known ones do not part them, as texts are
numbered and name addresses; more leave a mark too.

The tables here name notices and short licences.  Whole texts of further licences are given as a table, from
which table_of() makes sentences and rules.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.  A normalised sentence is in lower
# case and has single spaces between runs of a-z and 0-9; where a holder is named it says "the holder".
# Notices are cut at colons and semicolons, so some sentences stand in several parts.
SENTENCES = {
    "released under the mit license": "MitShort",
    "licensed under the mit license": "MitShort",
    "this project is licensed under the mit license": "MitShort",
    "this software is released under the mit license": "MitShort",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MitLiability",
    "licensed under the apache license version 2 0": "Apache2Short",
    "licensed under the apache license version 2 0 the license": "Apache2Grant",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at": "ApacheCopy",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "this work is licensed under the gnu general public license version 3": "Gpl3Short",
    "this work is licensed under the gnu general public license version 2": "Gpl2Short",
    "licensed under the gnu general public license version 3": "Gpl3Short",
    "licensed under the gnu general public license version 2": "Gpl2Short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "Gpl2Short",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "Lgpl21Later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Later",
    "you can redistribute it and or modify it under the same terms as perl itself": "PerlTerms",
    "either version 2 of the license or at your option any later version": "Either2",
    "either version 2 1 of the license or at your option any later version": "Either21",
    "either version 3 of the license or at your option any later version": "Either3",
    "licensed under the gnu lesser general public license version 2 1": "Lgpl21Short",
    "licensed under the gnu lesser general public license version 3": "Lgpl3Short",
    "licensed under the gnu affero general public license version 3": "Agpl3Short",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplWarranty",
    "this library is distributed in the hope that it will be useful but without any warranty": "GplWarranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GplImplied",
    "see the gnu general public license for more details": "GplSee",
    "see the gnu lesser general public license for more details": "LgplSee",
    "see the gnu affero general public license for more details": "AgplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplReceived",
    "you should have received a copy of the gnu lesser general public license along with this library": "LgplReceived",
    "you should have received a copy of the gnu affero general public license along with this program": "AgplReceived",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdDisclaimer",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BsdLiability",
    "in no event shall the copyright owner or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services": "BsdLiability",
    "loss of use data or profits": "BsdLosses",
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BsdInterruption",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "BsdAdvertising",
    "this product includes software developed by the holder": "BsdAcknowledgement",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheBasis",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ZeroBsdGrant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscWarranty",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "IscLiability",
    "licensed under the isc license": "IscShort",
    "this source code form is subject to the terms of the mozilla public license v": "Mpl2Terms",
    "this source code form is subject to the terms of the mozilla public license version 2 0": "Mpl2Terms",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "Mpl2Obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "Mpl2Obtain",
    "licensed under the mozilla public license version 2 0": "Mpl2Short",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "Epl2Terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "Epl1Terms",
    "licensed under the eclipse public license version 2 0": "Epl2Short",
    "licensed under the artistic license 2 0": "Artistic2Short",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "VerbatimLicence",
    "distributed under the boost software license version 1 0": "Boost1Short",
    "this software is provided as is without any express or implied warranty": "ZlibWarranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "to the extent possible under law the holder has waived all copyright and related or neighboring rights to this work": "Cc0Waiver",
    "licensed under cc0 1 0": "Cc0Short",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseGrant",
    "licensed under cc by 4 0": "CcBy4",
    "licensed under cc by sa 4 0": "CcBySa4",
    "licensed under cc by nc 4 0": "CcByNc4",
    "licensed under cc by nc sa 4 0": "CcByNcSa4",
    "licensed under cc by nd 4 0": "CcByNd4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CcBy4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CcBySa4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "CcByNc4",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "CcByNcSa4",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "CcByNd4",
    "all rights reserved": "AllRights",
    "this work has been released into the public domain": "PublicDomain",
    "this is free and unencumbered software released into the public domain": "Unlicense",
}

# Licences and the sentence sequences that name them, in the order in which they apply.
RULES = [
    ("MIT", "MitGrant,MitNotice,MitWarranty,MitLiability"),
    ("MIT", "MitGrant,MitNotice"),
    ("MIT", "MitGrant"),
    ("MIT", "MitShort"),
    ("Apache-2.0", "Apache2Grant,ApacheComply,ApacheCopy,ApacheBasis,ApacheSee"),
    ("Apache-2.0", "Apache2Grant,ApacheComply"),
    ("Apache-2.0", "Apache2Grant"),
    ("Apache-2.0", "Apache2Short"),
    ("Apache-2.0", "ApacheBasis,ApacheSee"),
    ("AGPL-3.0-or-later", "Agpl3Later,GplWarranty,GplImplied,AgplSee,AgplReceived"),
    ("AGPL-3.0-or-later", "Agpl3Later"),
    ("AGPL-3.0", "Agpl3Short"),
    ("LGPL-2.1-or-later", "LgplTerms,Either21,GplWarranty,GplImplied,LgplSee,LgplReceived"),
    ("LGPL-2.1-or-later", "LgplTerms,Either21"),
    ("LGPL-2.1-or-later", "Lgpl21Later"),
    ("LGPL-3.0-or-later", "LgplTerms,Either3"),
    ("LGPL-3.0-or-later", "Lgpl3Later"),
    ("LGPL-2.1", "Lgpl21Short"),
    ("LGPL-3.0", "Lgpl3Short"),
    ("GPL-3.0-or-later", "Gpl3Later,GplWarranty,GplImplied,GplSee,GplReceived"),
    ("GPL-3.0-or-later", "GplTerms,Either3"),
    ("GPL-3.0-or-later", "Gpl3Later"),
    ("GPL-2.0-or-later", "GplTerms,Either2,GplWarranty,GplImplied,GplSee,GplReceived"),
    ("GPL-2.0-or-later", "GplTerms,Either2"),
    ("GPL-2.0-or-later", "Gpl2Later"),
    ("GPL-3.0", "Gpl3Short"),
    ("GPL-2.0", "Gpl2Short"),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", "PerlTerms"),
    ("BSD-4-Clause", "BsdGrant,BsdSource,BsdBinary,BsdAdvertising,BsdAcknowledgement,BsdEndorse"),
    ("BSD-3-Clause", "BsdGrant,BsdSource,BsdBinary,BsdEndorse,BsdDisclaimer,BsdLiability,BsdLosses,BsdInterruption"),
    ("BSD-3-Clause", "BsdGrant,BsdSource,BsdBinary,BsdEndorse"),
    ("BSD-2-Clause", "BsdGrant,BsdSource,BsdBinary,BsdDisclaimer,BsdLiability,BsdLosses,BsdInterruption"),
    ("BSD-2-Clause", "BsdGrant,BsdSource,BsdBinary"),
    ("ISC", "IscGrant,IscWarranty,IscLiability"),
    ("ISC", "IscGrant"),
    ("ISC", "IscShort"),
    ("0BSD", "ZeroBsdGrant"),
    ("MPL-2.0", "Mpl2Terms,Mpl2Obtain"),
    ("MPL-2.0", "Mpl2Terms"),
    ("MPL-2.0", "Mpl2Short"),
    ("EPL-2.0", "Epl2Terms"),
    ("EPL-2.0", "Epl2Short"),
    ("EPL-1.0", "Epl1Terms"),
    ("Artistic-2.0", "Artistic2Short"),
    ("BSL-1.0", "Boost1Short"),
    ("Zlib", "ZlibWarranty,ZlibLiability,ZlibGrant"),
    ("CC0-1.0", "Cc0Waiver"),
    ("CC0-1.0", "Cc0Short"),
    ("CC-BY-NC-SA-4.0", "CcByNcSa4"),
    ("CC-BY-NC-4.0", "CcByNc4"),
    ("CC-BY-SA-4.0", "CcBySa4"),
    ("CC-BY-ND-4.0", "CcByNd4"),
    ("CC-BY-4.0", "CcBy4"),
    ("Unlicense", "Unlicense,UnlicenseGrant"),
    ("Unlicense", "Unlicense"),
    ("Public-Domain", "PublicDomain"),
    ("All-Rights-Reserved", "AllRights"),
]

# What stands before and behind the name of a holder.
HOLDERS = [
    ("^neither the name of .+? nor the names of its contributors ", "neither the name of the holder nor the names of its contributors "),
    ("^this product includes software developed by .+$", "this product includes software developed by the holder"),
    ("^to the extent possible under law .+? has waived all copyright ", "to the extent possible under law the holder has waived all copyright "),
]

#: Unknown sentences between two known ones that do not part them.
GAP = 3
# Identifiers of licences that stand behind "SPDX-License-Identifier:".
SPDX = sorted({name for name, _ in RULES if " " not in name and not name.endswith(("Domain", "Reserved"))} | {"GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only", "BSD-4-Clause", "BSL-1.0", "MPL-1.1", "EPL-1.0", "Artistic-2.0", "WTFPL"})

#: Every known sentence has one of these; a text without any is not cut at all.  Any white space and signs may stand
#: between the words, as between those of a sentence.
TRIGGER = "(?i)" + re.sub(" ", "[^a-z0-9]+", "licens|copyright|software|rights reserved|public domain|modification|warrant|loss of use|perl itself|advertising materials|copy of the mpl")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    """A sentence as the tables have it."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), sentence)).strip()


def _sentences(text: str) -> list[str]:
    return re.split(r"(?<=[.!?:;])[ \t\r\n]+|\n[ \t\r]*\n", text)


def table_of(texts: dict[str, str], least_words: int = 4) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Sentences and rules that recognise whole licence texts, given by name, beside those of this module.

    A sentence that these tables have already keeps its identifier; one of fewer than least_words is left out.
    A text is known by all its sentences in order."""
    sentences, rules = dict(SENTENCES), []
    for name, text in texts.items():
        own = [s for s in map(normal, _sentences(text)) if len(s.split()) >= least_words]
        for k, sentence in enumerate(own):
            sentences.setdefault(sentence, re.sub("[^A-Za-z0-9]", "", name.title()) + f"S{k + 1}")
        rules.append((name, ",".join(sentences[s] for s in own)))
    rules.sort(key=lambda r: -r[1].count(","))
    return sentences, rules + RULES


def _spdx() -> tuple[dict[str, str], list[tuple[str, str]]]:
    named = {name: "Spdx" + re.sub("[^A-Za-z0-9]", "", name) for name in SPDX}
    return {normal(f"SPDX-License-Identifier {name}"): known for name, known in named.items()}, list(named.items())


def _ids(text: Column, known: Column) -> Column:
    """The identifiers of the sentences of a text, in order: "" for one without a letter, "-" for an unknown one."""

    def look(s: Column) -> Column:
        plain = F.btrim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), "[^a-z0-9]+", " "))
        # few sentences begin like one that names a holder; the others are looked up as they are
        begins = reduce(lambda a, b: a | b, (F.startswith(plain, F.lit(re.match("[a-z0-9 ^]+", p)[0].strip("^"))) for p, _ in HOLDERS))
        named = reduce(lambda t, h: F.regexp_replace(t, h[0], h[1]), HOLDERS, plain)
        found = F.try_element_at(known, F.when(begins, named).otherwise(plain))
        return F.coalesce(found, F.when(plain.rlike("[a-z]"), F.lit("-")).otherwise(F.lit("")))

    def own(s: Column) -> Column:
        lines = F.filter(F.transform(F.split(s, "\\n"), look), lambda i: (i != "-") & (i != ""))
        return F.struct(F.when(F.contains(s, F.lit("\n")), lines).alias("lines"), look(s).alias("whole"))

    text = F.regexp_replace(text, "(?i)(spdx-license-identifier)[ \\t]*:[ \\t]*", "$1 ")
    both = F.transform(F.split(text, "(?<=[.!?:;])[ \\t\\r\\n]+|\\n[ \\t\\r]*\\n"), own)
    found = F.transform(both, lambda x: F.when(F.size(x["lines"]) > 0, x["lines"]).otherwise(F.array(x["whole"])))
    return F.filter(F.flatten(found), lambda i: i != "")


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs with `sentence_ids` (comma-joined identifiers of known sentences, in order), `n_sentences`
    (their number), `licences` (comma-joined, in the order of the rules that named them; empty if none),
    `n_licences` and `unknown` (known sentences that no rule took).  sentences and rules replace the tables of
    this module, as those of table_of() do.

    A sentence ends with .!?:; before white space, or with its paragraph, as licence texts are often
    wrapped.  If lines of it are known sentences, those count, and else the whole; so a text may have
    sentences of both kinds, in text order.  A null text has no sentences, like an empty one; repeated rows
    are judged alike; an empty table gives none; columns of docs with such a name are replaced; a long text
    is read whole.
    """
    known_spdx, spdx_rules = _spdx()
    known = F.create_map(*[F.lit(x) for pair in ((sentences or SENTENCES) | known_spdx).items() for x in pair])
    text = F.when(F.col("text").rlike(TRIGGER if sentences is None else "[a-zA-Z]"), F.col("text"))
    step = docs.withColumn("__all", F.coalesce(_ids(text, known), F.array().cast("array<string>")))
    step = step.withColumn("__ids", F.filter("__all", lambda i: i != "-"))
    # one mark for a long run of unknown sentences, nothing for a short one; a doubled comma between sentences lets
    # equal neighbours match one after the other
    run = F.regexp_replace(F.concat(F.array_join("__all", ","), F.lit(",")), f"(?:-,){{{GAP + 1},}}", "|,")
    line = F.replace(F.replace(run, F.lit("-,"), F.lit("")), F.lit(","), F.lit(",,"))
    step = step.withColumn("__left", F.when(F.size("__ids") > 0, F.concat(F.lit(","), line)))
    found: list[Column] = []
    left = F.col("__left")
    for licence, sequence in [*(rules or RULES), *spdx_rules]:
        pattern = F.lit("," + sequence.replace(",", ",,") + ",")
        found.append(F.when(F.contains(left, pattern), F.lit(licence)))
        left = F.replace(left, pattern, F.lit(",|,"))
    step = step.withColumns({"__found": F.when(F.size("__ids") > 0, F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))), "__rest": F.when(F.size("__ids") > 0, left)})
    rest = F.coalesce(F.size(F.filter(F.split("__rest", ","), lambda x: (x != "") & (x != "|"))), F.lit(0))
    return step.withColumns(
        {
            "sentence_ids": F.array_join("__ids", ","),
            "n_sentences": F.size("__ids").cast("long"),
            "licences": F.coalesce(F.array_join("__found", ","), F.lit("")),
            "n_licences": F.coalesce(F.size("__found"), F.lit(0)).cast("long"),
            "unknown": rest.cast("long"),
        }
    ).drop("__all", "__ids", "__left", "__found", "__rest")


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def oracle(table: str = "documents") -> str:
    """The same scan in DuckDB's SQL, by other means: sentences are rows, found by matching them rather than by
    cutting between them, and rules are tried one after the other by recursion over numbered places of the text."""
    known_spdx, spdx_rules = _spdx()
    known = ", ".join(f"({_sql(s)}, {_sql(i)})" for s, i in (SENTENCES | known_spdx).items())
    rules = ", ".join(f"({k}, {_sql(licence)}, [{', '.join(map(_sql, sequence.split(',')))}])" for k, (licence, sequence) in enumerate([*RULES, *spdx_rules]))
    plain = f"trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, named in HOLDERS:
        plain = f"regexp_replace({plain}, {_sql(pattern)}, {_sql(named)})"
    # a sentence: runs without a mark, or with marks that no white space follows, up to one that it does follow
    piece = "[^.!?:;]*(?:[.!?:;]+[^.!?:; \\t\\r\\n][^.!?:;]*)*[.!?:;]*"
    return f"""
WITH RECURSIVE known(sentence, id) AS (VALUES {known}), rules(k, licence, seq) AS (VALUES {rules}),
t AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(CASE WHEN regexp_matches(text, {_sql(TRIGGER)}) THEN text ELSE '' END, '(spdx-license-identifier)[ \\t]*:[ \\t]*', '\\1 ', 'gi') AS text FROM {table}),
paragraphs AS (SELECT r, p, unnest(regexp_extract_all(par, {_sql(piece)})) AS s, generate_subscripts(regexp_extract_all(par, {_sql(piece)}), 1) AS q FROM (SELECT r, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS par, generate_subscripts(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), 1) AS p FROM t)),
lines AS (SELECT r, p, q, unnest(string_split(s, chr(10))) AS s, generate_subscripts(string_split(s, chr(10)), 1) AS l FROM paragraphs WHERE contains(s, chr(10))),
of_lines AS MATERIALIZED (SELECT r, p, q, l, id FROM (SELECT r, p, q, l, {plain} AS n FROM lines) x JOIN known ON sentence = n),
of_wholes AS (SELECT r, p, q, 0 AS l, coalesce(id, '-') AS id FROM (SELECT r, p, q, {plain} AS n FROM paragraphs) x LEFT JOIN known ON sentence = n
  WHERE regexp_matches(n, '[a-z]') AND NOT EXISTS (SELECT 1 FROM of_lines o WHERE o.r = x.r AND o.p = x.p AND o.q = x.q)),
placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY p, q, l) AS place FROM (SELECT * FROM of_lines UNION ALL SELECT * FROM of_wholes)),
-- a known sentence begins a stretch if more than GAP unknown ones are before it
spaced AS (SELECT r, id, place, CASE WHEN place - lag(place) OVER (PARTITION BY r ORDER BY place) > {GAP + 1} THEN 1 ELSE 0 END AS fresh FROM placed WHERE id <> '-'),
stretches AS (SELECT r, id, place, row_number() OVER (PARTITION BY r ORDER BY place) + sum(fresh) OVER (PARTITION BY r ORDER BY place) AS spot FROM spaced),
docs AS (SELECT r, list(id ORDER BY spot) AS ids, list(CAST(spot AS BIGINT) ORDER BY spot) AS ats FROM stretches GROUP BY r),
-- each rule takes its sentences, which stand at neighbouring places, from the left, and leaves their places empty
steps AS (
  SELECT r, ids, ats, 0 AS k, CAST([] AS VARCHAR[]) AS found FROM docs
  UNION ALL
  SELECT r, list_filter(ids, lambda x, i: NOT list_contains(gone, ats[i])), list_filter(ats, lambda x: NOT list_contains(gone, x)), k + 1, CASE WHEN len(gone) > 0 THEN list_append(found, licence) ELSE found END
  FROM (SELECT s.*, rules.licence, flatten(list_transform(list_reduce(list_prepend([0::BIGINT], list_transform(
      list_filter(range(1, len(s.ids) - len(seq) + 2), lambda i: s.ids[i : i + len(seq) - 1] = seq AND s.ats[i + len(seq) - 1] - s.ats[i] = len(seq) - 1), lambda i: [s.ats[i]])),
      lambda a, b: CASE WHEN a[-1] = 0 OR b[1] >= a[-1] + len(seq) THEN list_concat(a, b) ELSE a END)[2:], lambda x: range(x, x + len(seq)))) AS gone
    FROM steps s JOIN rules ON rules.k = s.k)),
ends AS (SELECT r, len(ids) AS unknown, found FROM steps WHERE k = (SELECT count(*) FROM rules)),
named AS (SELECT r, string_agg(licence, ',' ORDER BY n) AS licences, count(*) AS n_licences FROM (SELECT r, licence, min(n) AS n FROM (SELECT r, unnest(found) AS licence, generate_subscripts(found, 1) AS n FROM ends) GROUP BY 1, 2) GROUP BY r)
SELECT t.doc_id, coalesce(array_to_string(docs.ids, ','), '') AS sentence_ids, CAST(coalesce(len(docs.ids), 0) AS BIGINT) AS n_sentences, coalesce(licences, '') AS licences, coalesce(n_licences, 0) AS n_licences, CAST(coalesce(unknown, 0) AS BIGINT) AS unknown
FROM t LEFT JOIN docs ON docs.r = t.r LEFT JOIN ends ON ends.r = t.r LEFT JOIN named ON named.r = t.r
"""
