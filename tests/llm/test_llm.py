"""The training-data operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import os
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import chat_format, decontaminate, html_extract, language_id, license_scan, mixing, simhash_dedup, spotsigs, token_counts, warc
from larkspur.llm.components import components

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def long_text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), size=rng.integers(2, 7))) for _ in range(n))


# 1 token counts


@needs_data
def test_token_counts_equal_the_tokenizer(spark):
    got = token_counts.op1_token_counts(spark, SF).collect()
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.encoder(f.read()).encode_ordinary
    want = {r.doc_id: len(encode(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(want) and all(r.terminated for r in got)


def test_scan_stitches_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = set()
    for k, n in enumerate((1, 7, 64, 1000, 2500)):
        ids = rng.integers(0, 4, n).astype("<u2")
        if k == 3:
            ids[:] = 1  # one document over all blocks, not terminated
        (tmp_path / f"f{k}.bin").write_bytes(ids.tobytes())
        start = 0
        for o, e in enumerate([*np.flatnonzero(ids == 0), n]):
            if e < n or start < n:
                want.add((f"f{k}.bin", o, start, int(e - start), bool(e < n)))
            start = int(e) + 1
    (tmp_path / "empty.bin").write_bytes(b"")
    old, token_counts.GROUP = token_counts.GROUP, 3
    try:
        got = token_counts.scan(spark, f"file://{tmp_path}", eod=0, block_tokens=16)
        assert {tuple(r) for r in got.collect()} == want
    finally:
        token_counts.GROUP = old


def test_tokens_of_nulls_empties_and_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (2, "")], "doc_id long, text string")
    manifest = token_counts.write_tokens(docs, f"file://{tmp_path}/a")
    got = token_counts.scan(spark, f"file://{tmp_path}/a").join(manifest, ["file", "ordinal"])
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got.collect()) == [(0, 2), (1, 0), (2, 0), (2, 0)]
    token_counts.write_tokens(docs.limit(0), f"file://{tmp_path}/b")
    assert token_counts.scan(spark, f"file://{tmp_path}/b").count() == 0


# 2 language ID


@needs_data
def test_language_on_held_out_fold(spark):
    rows = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords_differ_in_many_bits():
    for n in (2, 4, 7, 12, 60):
        code = language_id.codewords(n).astype(int)
        least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        assert least >= (1 if n < 4 else 4), n


def test_language_edges(spark):
    docs = documents(spark, ["the cat and the dog", None, "", "12 34 !!", "x" * 300_000])
    got = {r.doc_id: r for r in language_id.identify(docs.withColumn("score", F.lit("clash"))).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["en", "und", "und", "und", "en"]
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(docs.limit(0)).count() == 0


def test_features_do_not_depend_on_chunks():
    text = long_text(1, 400)
    old, language_id.CHUNK = language_id.CHUNK, 64
    try:
        small = language_id.features(text)
    finally:
        language_id.CHUNK = old
    assert np.allclose(small, language_id.features(text))


# 3 decontamination


def brute(items, text, least, overlap, ix):
    ws, out = decontaminate.words(text), {}
    for p in range(0, max(1, -(-len(ws) // ix.longest))):
        lo, hi = p * ix.longest, (p + 2) * ix.longest
        have = {ix.vocabulary[w] for w in ws[lo:hi] if w in ix.vocabulary}
        for i, (_, q, a) in enumerate(ix.items):
            score = sum(ix.postings[t].get(i, 0.0) for t in have)
            if score >= least - 1e-9 and decontaminate.found_in(q, ws[lo:hi]) >= overlap and decontaminate.found_in(a, ws[lo:hi]) >= overlap:
                out[i] = True
    return set(out)


def test_wand_finds_what_brute_force_finds(spark):
    rng = np.random.default_rng(5)
    items = [(i, long_text(i, int(rng.integers(8, 30))) + ". " + long_text(100 + i, 6) + ".") for i in range(50)]
    texts = []
    for k in range(60):
        parts = [long_text(1000 + k, int(rng.integers(0, 200)))]
        for i in rng.choice(50, size=int(rng.integers(0, 3)), replace=False):
            ws = items[i][1].split()
            for _ in range(int(rng.integers(0, 4))):
                ws[int(rng.integers(0, len(ws)))] = "zzz"
            parts += [" ".join(ws), long_text(2000 + k, 20)]
        texts.append(" ".join(parts))
    bench = spark.createDataFrame(items, "item_id long, text string")
    (ix,) = decontaminate.indexes(bench)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    want = {(d, ix.items[i][0]) for d, t in enumerate(texts) for i in brute(items, t, 0.7, 0.5, ix)}
    assert got == want and len(want) > 20
    blocks = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, texts), bench, block_bytes=2000).collect()}
    assert blocks == got
    old = ix.matches(texts[0] + " " + texts[1], 0.7, 0.5)
    ws_all = decontaminate.words(texts[0] + " " + texts[1])
    ids = np.array([ix.vocabulary.get(w, -1) for w in ws_all])
    assert sorted(ix.everywhere(ids, 0.3)) == sorted(ix.everywhere(ids, 0.3, stretch=2))
    assert old is not None


def test_parts_of_the_index_find_the_same(spark):
    rng = np.random.default_rng(21)
    # a question and its answer far apart, so that a passage sized by short items alone would not hold both
    items = [(i, long_text(5000 + i, int(rng.integers(10, 20))) + ". " + long_text(5100 + i, 5) + ".") for i in range(24)] + [(99, long_text(5999, 400) + ". " + long_text(5998, 6) + ".")]
    texts = []
    for i in range(0, 24, 2):
        question, answer = items[i][1].split(". ")
        texts.append(f"{long_text(6000 + i, 50)} {question} {long_text(6100 + i, int(rng.integers(20, 300)))} {answer} {long_text(6200 + i, 500)}")
    docs = documents(spark, [*texts, items[-1][1], None, ""])
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **o: sorted(map(tuple, decontaminate.contaminated(docs, bench, **o).collect()))
    whole = rows()
    assert len(whole) >= 10 and (12, 99) in {r[:2] for r in whole}
    for block_bytes in (100, 1000, 32 << 20):
        assert rows(block_bytes=block_bytes) == whole, block_bytes
    clean = sorted(r.doc_id for r in decontaminate.keep_clean(docs, bench, block_bytes=300).collect())
    assert clean == sorted(set(range(len(texts) + 3)) - {r[0] for r in whole})
    named = spark.createDataFrame([(f"q{i}", t) for i, t in items], "item_id string, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, named, block_bytes=500).collect()} == {(d, f"q{i}") for d, i, *_ in whole}


def test_long_texts_and_clashing_columns(spark):
    item = long_text(5000, 15) + ". " + long_text(5100, 5) + "."
    text = f"{long_text(1, 60_000)} {item} {long_text(2, 60_000)}"
    docs = documents(spark, [text, long_text(3, 120_000)]).withColumn("item_id", F.lit("clash")).withColumn("score", F.lit(None).cast("string"))
    bench = spark.createDataFrame([(7, item, "clash")], "item_id long, text string, doc_id string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(0, 7)]
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


@needs_data
def test_planted_passages_are_found_and_clean_documents_kept(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda t: f" {' '.join(decontaminate.words(t))} "
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in norm(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op3_decontamination(spark, sf).collect()}
    assert want and got == want
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six. seven eight."), (3, "one two three four five six. seven eight.")], "item_id long, text string")
    docs = documents(spark, [None, "", "x one two three four five six. Seven eight. y", "one two three"])
    got = decontaminate.contaminated(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(2, 3), (2, 3)]
    assert decontaminate.keep_clean(docs.withColumn("extra", F.lit(1)), bench).count() == 3
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


# 4 license scans


def test_license_rules_in_order(spark):
    s = license_scan.SENTENCES
    mit = ". ".join(s[i] for i in ("mit-title", "mit-grant", "mit-notice", "mit-as-is"))
    bsd3 = ".\n".join(s[i].upper() for i in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"))
    texts = [mit, bsd3, f"word. {s['bsd-grant']}; {s['bsd-source']}: {s['bsd-binary']}. end", "Released under the MIT License. Licensed under CC BY-NC 4.0. Released under the MIT License.", s["bsd-source"], None, "", "a" * 200_000]
    got = {r.doc_id: (r.licenses, r.matches) for r in license_scan.scan(documents(spark, texts)).collect()}
    assert got == {0: ("MIT", 1), 1: ("BSD-3-Clause", 1), 2: ("BSD-2-Clause", 1), 3: ("CC-BY-NC-4.0,MIT", 3), 4: ("", 0), 5: ("", 0), 6: ("", 0), 7: ("", 0)}
    assert license_scan.scan(documents(spark, texts).limit(0)).count() == 0


MIT_TEXT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE_TEXT = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
"""
GPL_TEXT = """    This program is free software{0} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{1} either version {2} of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
"""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL_TEXT = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_published_licenses_as_they_are_wrapped(spark):
    published = {"MIT": MIT_TEXT, "BSD-3-Clause": BSD_TEXT, "Apache-2.0": APACHE_TEXT, "GPL-3.0-or-later": GPL_TEXT.format(":", ",", 3), "GPL-2.0-or-later": GPL_TEXT.format(";", ";", 2), "ISC": ISC_TEXT, "MPL-2.0": MPL_TEXT}
    marked = [t.replace("\n", "\r\n") for t in published.values()] + ["/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */" for t in published.values()]
    marked += ["".join(f"# {x}\n" for x in t.splitlines()) for t in published.values()]
    got = [(r.licenses, r.matches) for r in license_scan.scan(documents(spark, [*published.values(), *marked])).orderBy("doc_id").collect()]
    assert got == [(name, 1) for name in published] * 4
    ids = [r.sentence_ids for r in license_scan.scan(documents(spark, [APACHE_TEXT, "released under\n\nthe MIT License", "not released under the MIT License", "x\nReleased under the\nMIT License\ny"])).orderBy("doc_id").collect()]
    assert ids == ["<apache-grant><apache-comply><apache-copy><apache-basis>", "<mit-title>", "", "<mit-short>"]


LGPL_TEXT = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
AGPL_TEXT = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
ZLIB_TEXT = """  This software is provided 'as-is', without any express or implied
  warranty.  In no event will the authors be held liable for any damages
  arising from the use of this software.

  Permission is granted to anyone to use this software for any purpose,
  including commercial applications, and to alter it and redistribute it
  freely, subject to the following restrictions:
"""


def test_more_licenses_notices_and_near_misses(spark):
    want = {
        LGPL_TEXT: "LGPL-2.1-or-later", AGPL_TEXT: "AGPL-3.0-or-later", ZLIB_TEXT: "Zlib", "This is licensed under the MIT license.": "MIT", "Released under the MIT license, see LICENSE": "MIT",
        "The software is\nlicensed under the Apache License, Version 2.0, whatever.": "Apache-2.0", "// SPDX-License-Identifier: GPL-3.0-or-later\nint x;": "GPL-3.0-or-later", "# SPDX-License-Identifier: MIT": "MIT",
        LGPL_TEXT.replace("any later", "no later"): "", AGPL_TEXT.replace("Affero", "Afferent"): "", ZLIB_TEXT.replace("commercial", "some"): "", "nothing here is licensed under the MIT license.": "", "SPDX-License-Identifier: MIT-like": "",
    }
    got = [r.licenses for r in license_scan.scan(documents(spark, list(want))).orderBy("doc_id").collect()]
    assert got == list(want.values())


def test_sentences_and_rules_are_data(spark):
    rng = np.random.default_rng(4)
    known = {" ".join(str(rng.integers(0, 4)) for _ in range(int(rng.integers(1, 6)))): None for _ in range(300)}
    known = {s: f"s{k}" for k, s in enumerate(known)}
    lines = ["\n".join(" ".join(str(rng.integers(0, 4)) for _ in range(int(rng.integers(1, 6)))) for _ in range(6)) for _ in range(200)]
    long = "\n".join(["1 2", "no", "x " * 50_000, "0 1"])
    got = license_scan.scan(documents(spark, [*lines, long, lines[0]]).withColumn("licenses", F.lit("clash")), known, [("Both", ["s0", "s1"]), ("One", ["s0"])]).orderBy("doc_id").collect()
    for r, text in zip(got, [*lines, long, lines[0]], strict=True):
        pieces, at, ids = text.split("\n"), 0, ""
        while at < len(pieces):
            runs = [(n, " ".join(pieces[at : at + n])) for n in range(len(pieces) - at, 0, -1) if " ".join(pieces[at : at + n]) in known]
            ids += f"<{known[runs[0][1]]}>" if runs else ""
            at += runs[0][0] if runs else 1
        assert r.sentence_ids == ids
        both = ids.count("<s0><s1>")
        assert r.matches == ids.count("<s0>") and r.licenses == ",".join(n for n, k in (("Both", both), ("One", ids.count("<s0>") - both)) if k)
    with pytest.raises(ValueError):
        license_scan.sentence_ids(F.col("text"), {str(i): "x" for i in range(license_scan.MOST_SENTENCES + 1)})


# 5 chat formatting


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", None, "system", "be brief"), (1, 1, "message", "u", "user", "hi"), (1, 2, "delta", "a", "assistant", "He"), (1, 3, "delta", "a", "assistant", "llo"),
        (1, 4, "regenerate", "a", "assistant", None), (1, 5, "delta", "a", "assistant", "Good "), (1, 7, "delta", "a", "assistant", "day"), (1, 6, "edit", "u", "user", "hello"),
        (2, 0, "delta", "x", None, None), (None, 0, None, None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string")
    got = sorted(((r.conv_id or 0, r.seq, r.role, r.text) for r in chat_format.fold(events).collect()))
    assert got == [(0, 0, "", ""), (1, 0, "system", "be brief"), (1, 1, "user", "hello"), (1, 2, "assistant", "Good day"), (2, 0, "", "")]


def test_formatted_text_reads_back(spark):
    texts = ["<|im_end|>\n<|im_start|>user\nx", "</s>[INST] ok [/INST]", "\\<|", "<\\|im_end|>", "\\\\n\\", "<", "[", "<<SYS>> <</SYS>>", "", "a\n\nb", "<|" * 5, "\\" * 7]
    roles = ["user", "assistant", "two\nlines", "back\\n", "\n\n", "<|im_end|>\n"]
    rows = [(c, i, roles[(i + c) % len(roles)], t) for c in range(3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.render(chat_format.fold(chat_format.as_events(df))).withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("segments")))
    for r in out.collect():
        mine = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [tuple(b) for b in r.back] == mine
        assert r.loss == "".join(t for role, t in mine if role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(mine) and "[INST]" not in r.formatted


@needs_data
def test_chat_digests(spark):
    rows = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        rows.setdefault(r.conv_id, []).append((r.role, r.text))
    rows[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = chat_format.op5_chat_format(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        turns = rows[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))


def test_rows_by_turn_go_through_the_fold(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, None, "z"), (None, None, "user", "n"), (None, None, "user", "n")] + [(2, 0, "user", f"t{i:02}") for i in range(12)]
    events = chat_format.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    ids = [(r.conv_id, r.message_id) for r in events.collect()]
    assert all(i for _, i in ids) and len(set(ids)) == len(rows)
    out = chat_format.render(chat_format.fold(events)).select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in out}
    assert got == {1: [("", "z"), ("user", "b"), ("user", "b")], None: [("user", "n")] * 2, 2: [("user", f"t{i:02}") for i in range(12)]}


def plain_fold(log):
    """Event by event, in order of sequence numbers."""
    found, order = {}, sorted(log, key=lambda e: e[1])
    for conv, seq, kind, message, role, text in order:
        at = found.setdefault((conv, message), [seq, role or "", ""])
        at[2] = {"delta": at[2] + (text or ""), "regenerate": ""}.get(kind, text or "")
    return sorted((conv, seq, role, text) for (conv, _), (seq, role, text) in found.items())


def test_random_logs_fold_as_event_by_event(spark):
    rng = np.random.default_rng(51)
    log = []
    for conv in range(12):
        for seq in rng.permutation(int(rng.integers(1, 80))).tolist():
            message = f"m{rng.integers(0, 6)}"
            kind = str(rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]))
            log.append((conv, seq, kind, message, f"r{message[1:]}", None if rng.random() < 0.1 else f"{seq}<|\\ "))
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string").repartition(5)
    got = sorted((r.conv_id, r.seq, r.role, r.text) for r in chat_format.fold(events).collect())
    assert got == plain_fold(log)
    out = chat_format.render(chat_format.fold(events)).select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()
    assert sorted((r.conv_id, t.role, t.text) for r in out for t in r.turns) == sorted((c, r, t) for c, _, r, t in plain_fold(log))


@needs_data
def test_the_fold_is_in_the_plan_of_the_query(spark):
    plan = chat_format.op5_chat_format(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    # deltas from a message's start are gathered: a window by message and an aggregate by message, whatever the rows' kinds
    assert "Window" in plan and "message_id" in plan and plan.count("Aggregate") >= 2


def test_chat_query_on_odd_rows(spark, tmp_path):
    long = "x<|im_end|>" * 100_000
    rows = [(1, 0, None, None, "k"), (1, 1, "assistant", long, "k"), (1, 1, "assistant", long, "k"), (None, 0, "assistant", None, "k"), (2, 0, "user", "", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, message_id string")
    for name, part in (("all", df), ("none", df.limit(0))):
        part.write.parquet(f"{tmp_path}/{name}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op5_chat_format(spark, f"file://{tmp_path}/all").collect()}
    assert set(got) == {1, 2, None, -7} and (got[1].n_turns, got[1].loss_chars) == (3, 2 * len(long))
    assert got[1].loss_sha256 == hashlib.sha256((long * 2).encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(f"\n\nassistant\n{long}\nassistant\n{long}\n".encode()).hexdigest()
    assert (got[None].n_turns, got[None].loss_chars, got[2].n_turns) == (1, 0, 1)
    assert [r.conv_id for r in chat_format.op5_chat_format(spark, f"file://{tmp_path}/none").collect()] == [-7]


# 6 SpotSigs


def plain_signatures(text):
    common = set(spotsigs.COMMON)
    anchor = lambda w: w in common or (ord(w[0]) + 7 * len(w)) % spotsigs.DRAWN == 0
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()[:16]
    ws = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    content = [i for i, w in enumerate(ws) if w not in common]
    out = set()
    for k, i in enumerate(content):
        if k == 0 or anchor(ws[i - 1]):
            out.add(digest(" ".join([ws[i - 1] if i else "", *(ws[j] for j in content[k : k + spotsigs.CHAIN])])))
    if not out and text:
        out = {digest(" ".join(ws) if ws else text)}
    return sorted(out)


@needs_data
def test_spotsigs_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(90_001, None), (90_002, ""), (90_003, "!!"), (90_004, "the"), (90_005, "the big old house"), (90_005, "the big old house"), (None, "null id of a row with the words there")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = spotsigs.with_next(df, range_rows=40).collect()
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    want = [(d, t or "", order[(i + 1) % len(order)][1] or "") for i, (d, t) in enumerate(order)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    df = df.unionAll(spark.createDataFrame([(1, "| ".join(f"zq{i}x" for i in range(200))), (2, "? " * 400), (3, "the of and " * 100)], df.schema))
    sigs = df.select("text", spotsigs.signatures(F.col("text")).alias("s")).collect()
    for r in sigs:
        assert r.s == plain_signatures(r.text or "")


@needs_data
def test_no_length_breaks_likeness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) >= 600")
    cut = lambda n: spotsigs.signatures(F.substring("text", 1, n))
    alike = lambda n: spotsigs.likeness(cut(n - 1), cut(n + 1)).alias(f"at_{n}")
    got = docs.select(*[F.avg(alike(n)).alias(f"at_{n}") for n in (250, 300, 350, 500)]).first().asDict()
    assert got["at_300"] > 0.9 and got["at_250"] <= got["at_300"] + 0.02 <= got["at_350"] + 0.04 <= got["at_500"] + 0.06


def test_spots_of_long_texts_and_clashing_columns(spark):
    text = " ".join(f"the w{i} x{i % 7}" for i in range(60_000))
    docs = documents(spark, [text, text + " tail", "short"]).withColumn("own", F.lit("clash")).withColumn("r", F.lit(1)).withColumn("halo", F.lit(9))
    got = {r.doc_id: (r.own, r.next_own) for r in spotsigs.with_next(docs, carry={"own": F.size(spotsigs.signatures(F.col("text")))}).collect()}
    assert got[2][1] == got[1][0] and got[1][1] == got[0][0] > 50_000 and got[0][1] == got[2][0] == 1


def test_likeness_and_length_classes(spark):
    pairs = [([], []), (["a"], []), (["a", "b"], ["b", "c"]), (list("abcdefghij"), list("abcdefghi")), (["a"], ["a"])]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>")
    assert [r[0] for r in df.select(spotsigs.likeness(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3, 0.9, 1.0]
    assert [r[0] for r in df.select(spotsigs.likeness(F.col("a"), F.col("b"), 0.8)).collect()] == [1.0, 0.0, 1 / 3, 0.9, 1.0]


def test_near_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = []
    for k in range(25):
        base = long_text(3000 + k, int(rng.integers(60, 400))).split()
        base = [w if rng.random() > 0.2 else str(rng.choice(["the", "of", "and"])) for w in base]
        for _ in range(int(rng.integers(1, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 8))):
                copy[int(rng.integers(0, len(copy)))] = "changed"
            texts.append(" ".join(copy))
    texts += [texts[0], None, "", "short text", "short text here"]
    docs = documents(spark, texts)
    sets, first = {i: frozenset(plain_signatures(t or "")) for i, t in enumerate(texts)}, {}
    for i, x in sets.items():
        first.setdefault(x, i)
    reps = {i: x for x, i in first.items() if x}
    want = {(a, b): len(reps[a] & reps[b]) / len(reps[a] | reps[b]) for a, b in itertools.combinations(sorted(reps), 2)}
    want = {k: v for k, v in want.items() if v >= 0.8}
    got = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(docs).collect()}
    split = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(docs, hot_rows=2).collect()}
    assert split == got
    assert got.keys() == want.keys() and len(want) > 15 and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert {r.doc_id: r.class_id for r in spotsigs.classes(docs).collect()} == {i: first[x] for i, x in sets.items()}
    assert spotsigs.near_pairs(docs.limit(0)).count() == 0


def test_with_next_of_one_and_of_none(spark):
    one = spark.createDataFrame([(5, "x y")], "doc_id long, text string")
    assert [tuple(r) for r in spotsigs.with_next(one).collect()] == [(5, "x y", "x y")]
    assert spotsigs.with_next(one.limit(0)).count() == 0


# 7 SimHash


def plain_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), seed=42) for i in range(max(1, len(ws) - 3))] if ws else []
    return sum(1 << b for b in range(64) if hs and sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints(spark):
    texts = [None, "", " \n", "One", "a b c", "É a b c d e f g", "x " * 100_000, long_text(4, 500), "a\x0bb\x1cc\x85d e f"]
    for t in texts:
        assert simhash_dedup.fingerprint(t) == plain_fingerprint(t)


def plain_components(fps, radius):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            up[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("bucket_rows", [20_000, 12])
def test_links_equal_all_pairs(spark, bucket_rows):
    rng = np.random.default_rng(11)
    seeds = [int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)]
    fps = [0, 2**64 - 1, 1, 3]
    for s in seeds:
        for _ in range(int(rng.integers(1, 15))):
            s ^= sum(1 << int(b) for b in rng.choice(64, size=int(rng.integers(0, 7)), replace=False))
            fps.append(s)
    signed = [f - 2**64 if f >= 2**63 else f for f in set(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash_dedup.near_links(df, 4, bucket_rows)).collect()}
    unsigned = [f % 2**64 for f in signed]
    want = plain_components(unsigned, 4)
    groups = lambda ids: sorted(sorted(unsigned[i] for i in range(len(ids)) if ids[i] == k) for k in set(ids))
    assert groups([roots.get(f, f) for f in signed]) == groups(want)


@pytest.mark.parametrize("n, cut", [(2, None), (17, None), (900, None), (4000, None), (900, 300), (900, 1)])
def test_the_gray_tree_prunes_groups_and_loses_no_link(n, cut):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**64, n // 2, dtype=np.uint64)
    near = fps[rng.integers(0, len(fps), n - len(fps))].copy()
    for _ in range(6):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    fps = np.unique(np.concatenate((fps, near)))
    fps = fps[np.argsort(simhash_dedup.gray_rank(fps))]
    if cut is not None:  # two runs, each in Gray order
        side = rng.permutation(len(fps)) < cut
        fps, cut = np.concatenate((fps[side], fps[~side])), int(side.sum())
    pruned = []
    edges = simhash_dedup.link(fps, 4, cut, pruned)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    up = simhash_dedup.Forest(len(fps))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if a < b and (cut is None or a < cut <= b):
            up.join(a, b)
    got = simhash_dedup.Forest(len(fps))
    for a, b in edges:
        assert int(fps[a] ^ fps[b]).bit_count() <= 4 and (cut is None or a < cut <= b)
        got.join(a, b)
    assert len(got.edges) == len(edges) and np.array_equal(got.roots(), up.roots())


def test_the_gray_tree_drops_groups_far_apart():
    # 16 families of 256 near fingerprints, as hot buckets have them: most pairs of leaves go with an upper node
    rng = np.random.default_rng(41)
    fps = np.repeat(rng.integers(0, 2**64, 16, dtype=np.uint64), 256)
    for _ in range(3):
        fps ^= np.uint64(1) << rng.integers(0, 24, len(fps), dtype=np.uint64)
    fps = np.unique(fps)
    fps = fps[np.argsort(simhash_dedup.gray_rank(fps))]
    tree, pruned = simhash_dedup.GrayTree(fps), []
    left, right = simhash_dedup.leaf_pairs(tree, tree, 4, pruned)
    leaves = -(-len(fps) // simhash_dedup.LEAF)
    assert len(tree.levels) >= 4 and sum(n > 0 for n in pruned) >= 2
    assert len(left) < leaves * leaves / 8
    near = {(i // simhash_dedup.LEAF, j // simhash_dedup.LEAF) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)), strict=True)}
    assert near <= set(zip(left.tolist(), right.tolist(), strict=True))


def test_a_hot_bucket_is_dealt_out_anew(spark):
    rng = np.random.default_rng(31)
    n = 6000
    fps = rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(13) << np.uint64(13)  # all agree on the first block of five
    fps[1::2] = fps[::2] ^ (np.uint64(1) << rng.integers(13, 64, n // 2, dtype=np.uint64))
    signed = np.unique(fps).view(np.int64)
    df = spark.createDataFrame([(int(f),) for f in signed], "fp long")
    # the rows of the hot bucket are copied once for each table of the next level, not once for each run
    assert simhash_dedup.keyed_by(df, simhash_dedup.block_masks(6, 4)).count() == 15 * len(signed)
    links = simhash_dedup.near_links(df, 4, bucket_rows=500).collect()
    assert len(links) <= 20 * len(signed)
    have = {(min(r.a, r.b), max(r.a, r.b)) for r in links}
    roots = {r.node: r.root for r in components(spark.createDataFrame(list(have), "a long, b long")).collect()}
    unsigned = signed.view(np.uint64)
    up = simhash_dedup.Forest(len(signed))
    for lo in range(0, len(signed), 1000):
        for a, b in zip(*np.nonzero(np.bitwise_count(unsigned[lo : lo + 1000, None] ^ unsigned[None, :]) <= 4), strict=True):
            up.join(lo + int(a), int(b))
    want = {}
    for i, r in enumerate(up.roots().tolist()):
        want.setdefault(r, set()).add(int(signed[i]))
    got = {}
    for f in map(int, signed):
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_pairs_of_runs_are_pruned_by_their_patterns(spark):
    nodes = [(0, 0, 0, 0b0000, 0b0011), (0, 0, 1, 0b1100, 0b1111), (0, 0, 2, 0b1111100, 0b1111100), (0, 1, 3, 0, 0)]
    got = simhash_dedup.node_pairs(spark.createDataFrame(nodes, "t int, k long, run long, both long, some long"), 2).collect()
    assert sorted((r.i, r.j) for r in got) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 3)] or sorted((r.i, r.j) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (3, 3)]
    ranks = spark.createDataFrame([(int(f),) for f in np.arange(-40, 40)], "fp long").select("fp", simhash_dedup.gray_column(F.col("fp")).alias("r")).orderBy("r").collect()
    assert [r.fp for r in ranks] == sorted((r.fp for r in ranks), key=lambda f: int(simhash_dedup.gray_rank(np.array([f], np.int64).view(np.uint64))[0]))


def test_near_duplicates_edges(spark):
    base = long_text(9, 400)
    texts = [base, base, base + " tail", None, "", long_text(10, 300)]
    docs = documents(spark, texts).withColumn("fp", F.lit("clash"))
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_gray_rank_is_the_place_in_gray_order():
    codes = np.array([i ^ (i >> 1) for i in range(64)], np.uint64)
    assert simhash_dedup.gray_rank(codes).tolist() == list(range(64))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {k: 1000 for k in range(1001, 1300)}


# 8 WARC


def test_warc_round_trip(spark, tmp_path):
    long = "ü" * 300_000
    rows = [(5, "http://b.org/x", "same"), (3, "http://www.a.org/", "same"), (9, None, None), (4, "http://a.org", ""), (8, "http://b.org/x#f", long), (7, "bad\r\nurl", "q\r\n\r\nWARC/1.1"), (3, "http://www.a.org/", "same"), (None, "http://c.org/", "same"), (None, "http://c.org/", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).withColumn("sha1", F.lit("clash"))
    index = warc.merge_runs(warc.write_archives(pages, f"file://{tmp_path}/w"), range_rows=2)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(index, f"file://{tmp_path}/w").collect()), key=str)
    d = lambda t: warc.digest((t or "").encode())
    want = [(3, 4, d("same"), "response", None)] * 2 + [(5, 4, d("same"), "revisit", 3), (0, 4, d("same"), "revisit", 3), (0, 5, d("alone"), "response", None), (4, 0, d(""), "response", None), (9, 0, d(""), "revisit", 4), (8, 600_000, d(long), "response", None), (7, 13, d("q\r\n\r\nWARC/1.1"), "response", None)]
    assert got == sorted(want, key=str)
    keys = [tuple(r) for r in index.orderBy("part", "place").select("url_key", "stamp", "file", "offset").collect()]
    assert keys == sorted(keys)
    small = warc.write_archives(pages, f"file://{tmp_path}/v", min_bytes=5)
    assert {r.record_type for r in warc.read_archives(warc.merge_runs(small), f"file://{tmp_path}/v").collect()} == {"response"}
    none = warc.merge_runs(warc.write_archives(pages.limit(0), f"file://{tmp_path}/u"))
    assert warc.read_archives(none, f"file://{tmp_path}/u").count() == 0


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(3, "a", "same"), (3, "a", "same"), (3, "a", "other"), (5, "b", "same"), (None, "c", "x"), (None, "c", "x"), (None, "c", "same"), (6, "d", "y"), (7, "e", "y")]
    folder = f"{tmp_path}/w"
    runs = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), f"file://{folder}").collect()
    heads = {}
    for r in runs:
        with open(f"{folder}/{r.file}", "rb") as f:
            f.seek(r.offset)
            member = f.read(r.length)
        text = zlib.decompress(member, 31).decode()
        heads[re.search(r"WARC-Record-ID: (<[^>]*>)", text)[1]] = warc.parse(member), re.search(r"WARC-Refers-To: (<[^>]*>)", text)
    assert len(runs) == len(heads) == len(rows) and {k for k in heads if k.count(":") == 3} == {f"<urn:capture:page:{i}>" for i in (5, 6, 7)}
    assert sorted(str(m["page_id"]) for m, _ in heads.values()) == sorted(str(i) for i, _, _ in rows)
    assert heads["<urn:capture:page:7>"][1][1] == "<urn:capture:page:6>" and heads["<urn:capture:page:5>"][0]["refers_to"] == 3


def test_loser_tree():
    rng = np.random.default_rng(2)
    for k in range(1, 12):
        lists = [sorted(rng.integers(0, 30, int(rng.integers(0, 20))).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(lists)) == sorted(itertools.chain(*lists))


@needs_data
def test_warc_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in warc.op8_warc(spark, SF).collect()}
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html, p.page_id)
    for p in pages:
        r = got[p.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p.html.encode()), warc.digest(p.html.encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if first[p.html] == p.page_id else ("revisit", first[p.html]))


# 9 HTML extraction


@needs_data
def test_articles_of_the_table(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = html_extract.op9_html_extraction(spark, SF).collect()
    assert len(got) == len(html)
    for r in got:
        inside = html[r.page_id].split("<article>")[1].split("</article>")[0]
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_article_among_the_rest(spark):
    prose = "A sentence, with commas, and enough length to be taken for prose by anyone who reads it."
    page = f"""<html><body><header><h1>Site</h1></header><div id=cookie-notice><p>{prose}</p></div><ul class=main-menu><li><a href=a>Home</a></ul>
    <div id=content><h2>Title &amp; more</h2><p>{prose}<div><p>Second&nbsp;one, <a href=b>link</a><br>tail</div><aside>side</aside><p>Short.<ul><li>one<li>two &lt;b&gt;</ul>
    <form>Name <input></form><section class="post-comments"><p>{prose * 3}</p></section></div><div class=sidebar><p>{prose}</p></div><footer>{prose}</footer>"""
    assert html_extract.extract(page).split("\n") == ["Title & more", prose, "Second one, link tail", "Short.", "one", "two <b>"]


def test_what_names_do_not_cut():
    page = '<article><header><h1>T</h1></header><div class="elementor-widget"><p>one</p></div><section id=discussion><p>two</p></section><figure><figcaption>cap</figcaption></figure><blockquote>q</blockquote><pre>a\n b</pre><div class="ad">x</div><div class=cookieNotice>y</div></article>'
    assert html_extract.extract(page) == "T\none\ntwo\ncap\nq\na b"


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("no markup", "no markup"), ("<p>a<p>b<br>c", "a\nb c"), ("<script>x", ""), ("<div" * 3, ""), ("<div>" * 3000 + "x", "x"), ("<!-- a", ""), ("a &lt; b &amp;amp", "a < b &amp"), ("<article><p>x, y</p></article><p>&copy; z</p>", "x, y")])
def test_broken_pages(page, text):
    assert html_extract.extract(page) == text


def test_siblings_of_the_best_container_stay():
    long, quote = "A long text, with commas, and more. " * 20, "Quoted, at some length, from elsewhere. " * 5
    page = f"<div>Loose <b>text</b><h2>T</h2><section>{long}</section><blockquote>{quote}</blockquote><pre>a\n b</pre><section><p>third</section><ul><li><a href=x>link</a></ul><p><a href=y>more</a></p><p>Short end.</p></div>"
    assert html_extract.extract(page).split("\n") == ["Loose text", "T", long.strip(), quote.strip(), "a b", "third", "Short end."]


@pytest.mark.parametrize("tag", ["div class='content no-sidebar'", "div class=has-sidebar", "article class='post category-social'", "div class=tag-cookies", "div id=ads-free", "form id=form1 action=x", "div class=social", "article class=sidebar"])
def test_wrappers_are_not_cut_for_their_names(tag):
    prose = "A sentence, with commas, and enough length to be taken for prose by anyone who reads it."
    page = f"<body><div class=sidebar><p>Aside.</div><ul class=main-menu><li><a href=a>{prose}</a></ul><{tag}><p>{prose}</p><p>{prose}</p><input><div class=related-posts>x</div></{tag.split()[0]}></body>"
    assert html_extract.extract(page) == f"{prose}\n{prose}"


@pytest.mark.parametrize("tag", ["div class=comments", "div id=cookie-consent", "div class='wp-sidebar-2'", "div class=sidebar-left"])
def test_names_still_cut_beside_an_article(tag):
    page = f"<body><main><p>Short text.</p></main><{tag}><p>{'Long, long text. ' * 30}</p></div></body>"
    assert html_extract.extract(page) == "Short text."


PROSE = "A sentence, with commas, and enough length to be taken for prose by anyone who reads it."


@needs_data
@pytest.mark.parametrize("tag", ["div", "section", "div class='content has-sidebar'"])
def test_scores_find_articles_without_an_article_element(spark, tag):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        plain = r.html.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag.split()[0]}>")
        assert "<article" not in plain and html_extract.extract(plain) == html_extract.extract(r.html)


@pytest.mark.parametrize("wrap", ["<article class='post has-comments'>{}</article>", "<div class='content has-sidebar'><article>{}</article></div>", "<div class='layout sidebar-right'><main>{}</main></div>", "<form action=x><input><article>{}</article></form>"])
def test_layout_names_do_not_empty_the_page(wrap):
    assert html_extract.extract(wrap.format(f"<p>{PROSE}</p>")) == PROSE


def test_names_inside_an_article_do_not_cut():
    page = f"<article><p>{PROSE}</p><section id=related-work><p>RW</p></section><p class=reply-text>RT</p><table class=share-price><tr><td>SP</table><div class=alert>AL</div></article>"
    assert html_extract.extract(page) == f"{PROSE}\nRW\nRT\nSP\nAL"


def test_a_small_article_does_not_hide_the_text():
    page = f"<body><article><p>Teaser.</p></article><div><p>{PROSE}</p><p>{PROSE}</p><p>{PROSE}</p></div></body>"
    assert html_extract.extract(page).split("\n")[-3:] == [PROSE] * 3


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "<b><p>y" * 50_000, "<ul><li>z" * 50_000, "<b><div></div>" * 50_000 + "q", "<thead>" * 50_000 + "<li>a" * 50_000, "<i>" * 50_000 + "</b>" * 50_000 + "t"])
def test_time_does_not_grow_with_the_square_of_the_depth(page):
    began = time.thread_time()
    assert html_extract.extract(page)
    assert time.thread_time() - began < 15  # a page of this size takes a second or two; with the square of its depth, minutes


def test_pages_table_edges(spark):
    rows = [(1, None, f"<p>{PROSE}"), (1, None, f"<p>{PROSE}"), (None, "u", None), (2, "u", ""), (3, "u", f"<p>{PROSE}</p>" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in html_extract.main_text(pages).collect()), key=str)
    long = "\n".join([PROSE] * 3000)
    assert got == sorted([(1, None, PROSE, len(PROSE))] * 2 + [(0, "u", "", 0), (2, "u", "", 0), (3, "u", long, len(long))], key=str)
    assert html_extract.main_text(pages.limit(0)).count() == 0


# 10 mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, full = set(names), {}
    budget = 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(full.values())
        over = {s for s in left if weight[s] * rest / max(1, sum(weight[x] for x in left)) > 2 * sizes[s]}
        if not over:
            return full | {s: weight[s] * rest / sum(weight[x] for x in left) for s in left}
        full |= {s: 2 * sizes[s] for s in over}
        left -= over


def test_mixture_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" * int(rng.integers(0, 60))), ["a", "b", "c", "D", None][min(4, int(rng.exponential(1.2)))], "clash") for i in range(3000)]
    rows += [(i, None, "a", None) for i in range(3)] + [(7, "x y", "only", None)] * 2 + [(None, "z", "b", None), (1, "", "empty", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs, cell_rows=20).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = plain_targets(sizes), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-6)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.001 * t), s
    again = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(docs, cell_rows=20).collect())
    assert again == sorted((str(r.doc_id), r.size, r.taken) for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_one_of_repeated_rows_changes(spark):
    rng = np.random.default_rng(5)
    rows = [(5 if k % 2 else None, "w", s) for k in range(301) for s in "abcdef"] + [(1000 + i, "w " * int(rng.integers(2, 60)), s) for i in range(400) for s in "abcdef"]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), cell_rows=20).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abcdef"}
    for s, t in plain_targets(sizes).items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= max(3, 0.001 * t), s


def test_many_rows_without_an_id(spark):
    rng = np.random.default_rng(6)
    rows = [(None, "w", "a")] * 2000 + [(i, "w " * int(rng.integers(1, 90)), "a" if i % 3 else "b") for i in range(300)] + [(7, "q r s", "b")] * 1500
    rows += [(i, "w " * int(rng.integers(1, 40)), "c") for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), cell_rows=20).collect()
    assert len(got) == len(rows) and sorted((r.doc_id or 0, r.size) for r in got) == sorted((i or 0, len(t.split())) for i, t, _ in rows)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    for s, t in plain_targets(sizes).items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 0.001 * t, s


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(16)
    sizes = {f"h{rng.integers(10**9)}é"[: int(rng.integers(3, 10))]: int(10 ** rng.uniform(0, 7)) for _ in range(400)} | {None: 55, "zero": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, range_rows=30).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-9) for s in want)


def test_crossing_constraints_equal_the_plain_dual(spark):
    rng = np.random.default_rng(17)
    rows = [("abc"[int(rng.integers(3))], [None, "x", "y", "z"][int(rng.integers(4))], int(rng.integers(0, 200))) for _ in range(900)]
    words = lambda i: {v: float(sum(s for *k, s in rows if k[i] == v)) for v in {r[i] for r in rows}}
    # one set of rates meets both columns' targets: take a tilted mix's own sums, and let z go free
    tilt = [{"a": 0.3, "b": -2.0, "c": 0.9}, {None: 0.2, "x": -0.7, "y": 0.4, "z": 0.0}]
    kept = [float(sum(s * np.exp(tilt[0][a] + tilt[1][b]) for a, b, s in rows if (a, b)[i] == v)) for i in (0, 1) for v in sorted(words(i), key=lambda v: (v is None, v or ""))]
    values = [sorted(words(i), key=lambda v: (v is None, v or "")) for i in (0, 1)]
    goal = [dict(zip(values[0], kept[:3], strict=True)), {v: k for v, k in zip(values[1], kept[3:], strict=True) if v != "z"}]
    docs = spark.createDataFrame(rows, "source string, lang string, size long")
    frames = {c: spark.createDataFrame(list(g.items()), "value string, target double") for c, g in zip(("source", "lang"), goal, strict=True)}
    got = {c: {r["value"]: r["lambda"] for r in t.collect()} for c, t in mixing.balance(docs, frames).items()}
    # the plain dual: cyclic scaling of rates, document by document
    rate = np.ones(len(rows))
    size = np.array([s for *_, s in rows], float)
    for _ in range(3000):
        for i in (0, 1):
            for v, t in goal[i].items():
                mine = np.array([r[i] == v for r in rows])
                rate[mine] *= t / (size * rate)[mine].sum()
    mine = np.exp([got["source"][a] + got["lang"].get(b, 0.0) for a, b, _ in rows])
    assert np.allclose(mine, rate, rtol=1e-6)
    with pytest.raises(ValueError):
        mixing.balance(docs, frames, most_constraints=5)
    one = {c: {r["value"]: r["lambda"] for r in mixing.balance(docs, {"source": frames["source"]}, most_constraints=m)["source"].collect()} for c, m in (("solved", 10), ("in rows", 2))}
    assert all(one["solved"][v] == pytest.approx(one["in rows"][v], abs=1e-8) == pytest.approx(np.log(t / words(0)[v]), abs=1e-8) for v, t in goal[0].items())
    both = {"source": spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "value string, target double"), "lang": spark.createDataFrame([(v, 9.0) for v in values[1]], "value string, target double")}
    with pytest.raises(ValueError):
        mixing.balance(docs, both)


# pipeline


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert ORDER == [name for name, _ in corpus_pipeline.STAGES]
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "/root/testdata/sf0.01")
        assert now.columns == docs.columns
    kept = {r.doc_id: r.text for r in now.collect()}
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    ids = sorted(fps)
    root = plain_components([fps[i] for i in ids], 4)
    least = {}
    for i, k in zip(ids, root, strict=True):
        least[k] = min(i, least.get(k, i))
    norm = lambda t: f" {' '.join(decontaminate.words(t))} "
    items = [norm(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    want = {r.doc_id for r in docs.collect() if r.doc_id in least.values() and not any(t in norm(r.text) for t in items) and re.search(r"[^\W\d_]", r.text)}
    assert set(kept) == want
    final = corpus_pipeline.run(spark, "/root/testdata/sf0.01")
    assert {r.doc_id for r in final.collect()} == want


@needs_data
def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    base = long_text(77, 200)
    rows = [(1, base, "en", "a", 1), (2, base, "en", None, None), (3, None, None, None, None), (4, "", "en", "a", 0), (5, "12 %", "fr", "b", 4), (6, long_text(78, 300), "fr", "b", 1), (6, long_text(78, 300), "fr", "b", 1), (None, long_text(79, 90), "en", "a", 1), (8, f"x {bench} y", "fr", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("component_id", F.lit(0))
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect())
    assert ids(stages["language ID"](spark, docs.withColumn("lang", F.lit(None).cast("string")), SF)) == [0, 1, 2, 6, 6, 8]
    deduped = stages["SimHash near-dedup"](spark, docs, SF)
    assert deduped.columns == corpus_pipeline.COLUMNS and ids(deduped) == [0, 1, 3, 5, 6, 8]  # null and empty texts are alike
    assert ids(stages["benchmark decontamination"](spark, docs, SF)) == [0, 1, 2, 3, 4, 5, 6, 6]
    assert ids(stages["mixing to target weights"](spark, docs, SF)) == [0, 1, 2, 3, 4, 5, 6, 6, 8]
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, now, SF).count() == 0


ORDER = ["language ID", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights"]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from larkspur.llm.common import scratch_root
    from larkspur.sources.store import scratch_folder

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    for find in (scratch_root, scratch_folder):
        with pytest.raises(Exception, match="must name a folder"):
            find(session)


def plain_decode(model, x):
    """Bit by bit: the codeword with the least loss, each bit's loss weighted by how far it is trusted."""
    loss = {}
    for lang, word in zip(model.langs, model.code.tolist(), strict=True):
        loss[lang] = sum(t * np.log1p(np.exp(-c * (float(w @ x) + float(b)))) for c, w, b, t in zip(word, model.weights.astype(float), model.bias, model.trust.astype(float), strict=True))
    share = {lang: np.exp(-v) for lang, v in loss.items()}
    ranked = sorted(share, key=lambda v: (-share[v], model.langs.index(v)))
    return ranked[0], share[ranked[0]] / sum(share.values()), (share[ranked[0]] - share[ranked[1]]) / sum(share.values())


def test_decoding_equals_the_plain_decoder():
    rng = np.random.default_rng(71)
    langs = [f"l{i}" for i in range(5)]
    code = language_id.codewords(5)
    bits, dims = code.shape[1], 40
    model = language_id.Model(langs, code, rng.normal(size=(bits, dims)).astype(np.float32), rng.normal(size=bits).astype(np.float32), rng.uniform(0.05, 1, bits).astype(np.float32))
    for _ in range(200):
        x = rng.normal(size=dims).astype(np.float32) / 6
        lang, score, lead = model.decode(x)
        want = plain_decode(model, x)
        assert lang == want[0] and score == pytest.approx(want[1], rel=1e-4) and lead == pytest.approx(want[2], abs=1e-4)
    # bits that contradict each other: what trusted bits say wins, and codewords at equal loss are flagged by a lead of nothing
    flat = language_id.Model(langs, code, np.zeros((bits, dims), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32))
    assert flat.decode(np.ones(dims, np.float32)) == ("l0", pytest.approx(0.2), pytest.approx(0.0))
    sure = language_id.Model(langs, code, np.zeros((bits, dims), np.float32), 9 * code[3].astype(np.float32), np.ones(bits, np.float32))
    assert sure.decode(np.ones(dims, np.float32))[0] == "l3"
    sure.bias[0] *= -1  # one wrong bit is corrected
    assert sure.decode(np.ones(dims, np.float32))[0] == "l3"


def test_repeated_rows_and_ties_of_languages(spark):
    rows = [(i % 40, "the cat sat on the mat", "en" if i % 2 else "fr", "s", 1) for i in range(80)]
    got = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 80 and len({(r.lang_pred, r.score, r.ambiguous) for r in got}) == 1 and got[0].ambiguous


def test_tokens_of_long_texts_and_clashing_columns(spark, tmp_path):
    long = long_text(81, 60_000)
    docs = spark.createDataFrame([(1, long, "x"), (2, "a", "y")], "doc_id long, text string, ordinal string").withColumn("file", F.lit("clash"))
    manifest = token_counts.write_tokens(docs, f"file://{tmp_path}/t")
    got = {r.doc_id: r.n_tokens for r in token_counts.scan(spark, f"file://{tmp_path}/t", block_tokens=1000).join(manifest, ["file", "ordinal"]).collect()}
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.encoder(f.read()).encode_ordinary
    assert got == {1: len(encode(long)), 2: len(encode("a"))}


@needs_data
def test_stages_take_very_long_texts(spark):
    import corpus_pipeline

    long = long_text(91, 150_000)
    docs = spark.createDataFrame([(1, long, "en", "a", len(long)), (2, long + " tail", "en", "a", 1), (3, long_text(92, 200), "fr", "b", 1)], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        kept = {r.doc_id for r in stage(spark, docs, SF).collect()}
        assert kept == ({1, 3} if name == "SimHash near-dedup" else {1, 2, 3}), name


def test_no_local_checkpoint():
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for d, _, names in os.walk(os.path.join(here, "larkspur")):
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(d, n)) as f:
                    assert "localCheckpoint(" not in f.read(), n
