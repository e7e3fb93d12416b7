"""License scans by sentence rules, with DataFrame operations only.

A text is cut into pieces (line ends, and white space after . , ; : ! or ?), each normalised to
lower-case words. A known sentence is a run of whole pieces with its words, so it may be wrapped over
lines (comment marks and all), and hold 'v. 2.0' or a semicolon; it may be a clause between commas, and doesn't go on beyond an empty line. Of two
that start at one piece the longer counts. Known sentences have identifiers; a document becomes the sequence of its known
sentences' identifiers, other sentences between them notwithstanding. Licence rules are ordered
sequences of identifiers; they are tried in order, longer and more specific rules first, and what a
rule has matched is not matched again.

Sentences and rules are data: `scan` takes any, up to `MOST_SENTENCES`, and has those of well-known licences (`KNOWN`, `RULES`) else.
The dictionary becomes one pattern, factored by common beginnings, held in the expressions themselves: no join, no
shuffle, no broadcast; one pass over the text. Nothing depends on other rows.

Defined results: null or empty text has no sentences and no licences. A sentence repeated in a
text counts each time. Extra columns and repeated rows don't matter; a row is returned for each row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import let, table

# Sentences of well-known licences and notices, normalised (words in lower case, one space between).
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-grant": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software",
    "gpl3-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-short": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "licensed under cc0 1 0",
    "gpl-library": "this library is free software",
    "lgpl21-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-later": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-later": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
}
#: Licence and the sentences that say it, in the order in which rules are tried.
RULES = [
    ("Apache-2.0", ["apache-grant", "apache-comply", "apache-copy", "apache-basis"]),
    ("Apache-2.0", ["apache-grant", "apache-comply"]),
    ("MIT", ["mit-title", "mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later", "gpl-hope"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-later", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-later"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("Apache-2.0", ["apache-short"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-short"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"]),
    ("CC-BY-ND-4.0", ["cc-by-nd"]),
    ("CC0-1.0", ["cc0"]),
    ("LGPL-2.1-or-later", ["gpl-library", "lgpl21-later"]),
    ("LGPL-3.0-or-later", ["gpl-library", "lgpl3-later"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-later"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-later"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("EPL-2.0", ["epl2"]),
    ("0BSD", ["0bsd-grant"]),
]
#: Notices of one sentence, which may have a subject, and what they may have before them.
NOTICES = ("apache-short", "mit-short", "mit-licensed", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nc-sa", "cc-by-nd", "cc0")
SUBJECTS = ("this is", *(f"{the} {what} is" for the in ("this", "the") for what in ("work", "project", "software", "code", "program", "library", "package", "file")))

#: How many sentences a dictionary may have: they and their identifiers are part of the query's expressions.
MOST_SENTENCES = 5_000


def normalised(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def _known() -> dict[str, str]:
    """Identifiers by sentence: the fixed sentences, notices with subjects, and SPDX lines of all licences that the rules name."""
    out = {s: i for i, s in SENTENCES.items()}
    out |= {f"{subject} {SENTENCES[i]}": i for i in NOTICES for subject in SUBJECTS}
    return out | {f"spdx license identifier {normalised(name)}": f"spdx-{name}" for name, _ in RULES}


KNOWN = _known()
SPDX_RULES = [(name, [f"spdx-{name}"]) for name in dict.fromkeys(name for name, _ in RULES)]


def pattern(sentences: list[str]) -> str:
    """Any of the sentences from the start of a piece to the end of one, longer ones first, sentences of one beginning sharing it."""
    tree: dict = {}
    for s in sentences:
        node = tree
        for word in s.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def after(node: dict) -> str:
        """What may follow a node's word, words between blanks or line ends."""
        ways, tails = [], sorted(w for w in node if w)
        for w in tails:
            run, below = [w], node[w]
            while len(below) == 1 and "" not in below:  # a stretch without forks
                ((word, below),) = below.items()
                run.append(word)
            ways.append("[ \\n]".join(run) + after(below))
        if not ways:
            return ""
        one = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"
        return f"(?:[ \\n]{one})?" if "" in node else f"[ \\n]{one}"

    return "(?m)^(" + after(tree).removeprefix("[ \\n]") + ")$"


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def sentence_ids(text: Column, known: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order, each in angle brackets, as one string. known: identifiers by normalised sentence."""
    known = KNOWN if known is None else known
    if not known:
        return F.lit("")
    if len(known) > MOST_SENTENCES:
        raise ValueError(f"{len(known)} sentences; at most {MOST_SENTENCES}")
    ended = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"([.,;:!?])[\x20\x09-\x0D]+", "$1\n")
    plain = F.regexp_replace(F.regexp_replace(ended, r"[^\p{L}\p{N}\n]+", " "), r" *\n *", "\n")
    ids = F.create_map(*[F.lit(x) for s, i in known.items() for x in (s, f"<{i}>")])
    found = F.regexp_extract_all(F.trim(plain), F.lit(pattern(list(known))), F.lit(1))
    return F.array_join(F.transform(found, lambda s: F.element_at(ids, F.translate(s, "\n", " "))), "")


def licenses(ids: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """array<struct<license, n>>: what the rules match in a sequence, each sentence used once."""
    rules = [*RULES, *SPDX_RULES] if rules is None else rules
    rules = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(_sequence(seq)).alias("seq")) for name, seq in rules])
    start = F.struct(ids.alias("left"), F.array().cast("array<struct<license:string,n:int>>").alias("found"))

    def apply(state, rule):
        n = ((F.length(state["left"]) - F.length(F.replace(state["left"], rule["seq"], F.lit("")))) / F.length(rule["seq"])).cast("int")
        # a mark stays where a rule matched, so that its neighbours don't become a sequence
        left = F.replace(state["left"], rule["seq"], F.lit("|"))
        return F.when(F.contains(state["left"], rule["seq"]), F.struct(left.alias("left"), F.concat(state["found"], F.array(F.struct(rule["license"].alias("license"), n.alias("n")))).alias("found"))).otherwise(state)

    return F.aggregate(rules, start, apply, lambda s: s["found"])


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """(doc_id, sentences, licenses, matches): known sentences, distinct licences by code point joined by commas, rules matched."""
    seen = docs.select("doc_id", sentence_ids(F.col("text"), known).alias("ids"))
    got = let(licenses(F.col("ids"), rules), lambda a: F.struct(
        F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["license"]))), ",").alias("licenses"),
        F.aggregate(a, F.lit(0), lambda n, x: n + x["n"]).cast("long").alias("matches"),
    ))
    none = F.struct(F.lit("").alias("licenses"), F.lit(0).cast("long").alias("matches"))
    out = seen.select("doc_id", F.col("ids").alias("sentence_ids"), F.when(F.col("ids") == "", none).otherwise(got).alias("got"))
    return out.select("doc_id", "sentence_ids", "got.licenses", "got.matches")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {quoted(s)} THEN {quoted(f'<{i}>')}" for i, s in SENTENCES.items())
    steps, names, counts = [], [], []
    for k, (name, seq) in enumerate(RULES):
        s = quoted(_sequence(seq))
        steps.append(f"s{k + 1} AS (SELECT *, replace(l{k}, {s}, '|') AS l{k + 1}, CAST((length(l{k}) - length(replace(l{k}, {s}, ''))) / {len(_sequence(seq))} AS BIGINT) AS n{k + 1} FROM s{k})")
        names.append(f"CASE WHEN n{k + 1} > 0 THEN {quoted(name)} END")
        counts.append(f"n{k + 1}")
    return f"""
WITH s0 AS (
  SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(lower(coalesce(text, '')), '([.;:!?])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)),
    lambda s: trim(s, ' ')), lambda s: s IN ({', '.join(map(quoted, SENTENCES.values()))})), lambda s: CASE s {whens} END), '') AS l0
  FROM documents),
{', '.join(steps)}
SELECT doc_id, l0 AS sentence_ids,
  array_to_string(list_sort(list_distinct(list_filter([{', '.join(names)}], lambda x: x IS NOT NULL))), ',') AS licenses,
  {' + '.join(counts)} AS matches
FROM s{len(RULES)}
"""


OP4_SQL = _oracle()
