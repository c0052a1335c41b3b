import hashlib
import json
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from twinscope.llm import bpe, langid, license_scan, packing, quality, queries

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_id_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict_languages(odd_docs).collect()}
    for i in (0, 1, 2, 12, 13):
        assert rows[i] == ("und", 0.0)
    assert rows[3][0] == "en"
    assert langid.predict_languages(no_docs).count() == 0
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2, 12, 13})


def test_no_labels_give_und(odd_docs):
    assert {r.lang_pred for r in langid.predict_languages(odd_docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def brute_buckets(text):
    code, mask = [ord(c) for c in text.lower()], (1 << 64) - 1
    for at in range(len(code)):
        h = 0
        for n in (1, 2, 3):
            if at + n > len(code):
                break
            h = (h + code[at + n - 1] + n) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
            yield (h * 0xC2B2AE3D27D4EB4F & mask) >> 48


def test_language_id_is_plain_naive_bayes(spark, sf):
    """Every label and score against a naive Bayes in plain Python, fitted on the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    found = langid.predict_languages(docs).collect()
    fitted = [r for r in rows.values() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None]
    langs = sorted({r.lang for r in fitted})
    counts = {x: Counter(b for r in fitted if r.lang == x and r.text for b in brute_buckets(r.text)) for x in langs}
    sums = {x: sum(counts[x].values()) + 0.5 * langid.N_BUCKETS for x in langs}
    weight = lambda x, b: round(4096 * math.log((counts[x][b] + 0.5) / sums[x]))
    prior = {x: round(4096 * math.log(sum(r.lang == x for r in fitted) / len(fitted))) for x in langs}
    for r in found:
        text = rows[r.doc_id].text or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        own = Counter(brute_buckets(text))
        total = {x: prior[x] + sum(n * weight(x, b) for b, n in own.items()) for x in langs}
        best = max(langs, key=lambda x: total[x])
        assert r.lang_pred == best
        assert abs(r.score - 1 / sum(math.exp((t - total[best]) / 4096) for t in total.values())) < 1e-9


def test_several_models_are_one(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = sorted(map(tuple, langid.predict_languages(docs).collect()))
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    split = sorted(map(tuple, langid.predict_languages(docs).collect()))
    assert [r[:3] for r in split] == [r[:3] for r in whole]
    assert max(abs(a[3] - b[3]) for a, b in zip(split, whole, strict=True)) < 1e-9


def test_scores_do_not_depend_on_chunks(monkeypatch):
    model = langid.LanguageModel(["a", "b"], np.random.default_rng(0).integers(-9, 0, (langid.N_BUCKETS, 2)).astype(np.int32), np.zeros(2, np.int64))
    texts = ["abc déf " * 500, None, "", "x", "abcd " * 9]
    whole = model.predict(texts)
    assert [r[0] for r in whole][1:3] == [None, None]
    for size in (1, 2, 37):
        monkeypatch.setattr(langid, "_CHUNK", size)
        assert model.predict(texts) == whole
        assert [model.predict([t])[0] for t in texts] == whole


@pytest.fixture(scope="module", params=[WORD, BYTE])
def coder(request):
    path = bpe.default_path(request.param)
    with open(path, "rb") as f:
        model = bpe.BpeModel(f.read())
    return model, bpe.Encoder(model), bpe.Decoder(model), Tokenizer.from_file(path)


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["the ", "ing", "<|endoftext|>", "<|startoftext|>", "ΑΣ", "İ", "'s", "  ", "\x1c", "\x85", "aaaaaaa"])), max_size=12).map("".join))
def test_bpe_is_the_library(coder, text):
    _, encoder, decoder, library = coder
    ids = np.frombuffer(encoder.encode(text), "<i4").tolist()
    want = library.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert decoder.decode(ids) == decoder.decode(ids, step=2) == library.decode(want, skip_special_tokens=False)


def test_long_words_stream_in_a_window(coder):
    model, encoder, _, library = coder
    word = "".join(t for t in list(model.vocab)[1000:6000] if t.isascii() and t.isalpha()).lower()[:20_000]
    assert len(word) > 10 * model.window
    assert np.frombuffer(encoder.encode(word), "<i4").tolist() == library.encode(word, add_special_tokens=False).ids


PARTS = ["a", "b", "the", "ing", "'", "'s", "'ll", "'re", "'r", "e", "1", "23", "!", "?", "#", "é", "e\u0301", "\u0301", "ΑΣ", "\u1112\u1161\u11ab", "\u1112\u1161", "日本", "🙂", "İ", "\U00010940", " ", "   ", "\n", "\t ", "\u3000"]


def test_fragments_are_the_library(coder):
    """Steps of a few characters: chunks, words and runs of white space are all cut."""
    model, _, _, library = coder
    rnd = random.Random(3)
    for k in range(1500):
        text = " " * (k % 11) + "".join(rnd.choice(PARTS[: 25 + 5 * (k % 2)]) for _ in range(rnd.randrange(60)))
        want = library.encode(text, add_special_tokens=False).ids
        for step in (5, 16):
            assert np.frombuffer(bpe.Encoder(model, step).encode(text), "<i4").tolist() == want, (step, text)


def test_memory_does_not_grow_with_a_word(coder):
    model = coder[0]

    def peak(text):
        tracemalloc.start()
        for _ in bpe.Encoder(model, 4096).stream(text):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    for unit in ("ab", "é", " ", "'"):
        peak(unit * 1000 + "x")
        small, large = peak(unit * 10_000 + "x"), peak(unit * 60_000 + "x")
        assert large < small + 60_000, (unit, small, large)


def test_bpe_query_is_the_library(spark, sf):
    library = Tokenizer.from_file(bpe.default_path(WORD))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, queries.op4_bpe(spark, sf).collect())) == sorted(want)


def test_bpe_odd_rows(odd_docs, no_docs):
    path = bpe.default_path(WORD)
    out = bpe.decode(bpe.encode(odd_docs, path), path)
    assert set(out.columns) == {*odd_docs.columns, "decoded"}
    rows = {r.doc_id: (r.ids, r.decoded) for r in out.collect()}
    assert rows[0] == rows[1] == rows[2] == ([], "")
    assert out.count() == odd_docs.count()
    assert bpe.encode(no_docs, path).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts(spark, sf, odd_docs, no_docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd_docs):
        want = sorted((r.doc_id, *brute_base(r.text)) for r in docs.collect())
        rows = quality.assess(docs, labels).collect()
        assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and r.llr >= quality.MIN_SCORE)
    assert quality.assess(no_docs, labels).count() == 0


def test_windows_with_equal_hashes_are_told_apart(spark, monkeypatch):
    """With a hash of two values nearly all windows collide."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.abs(real(*c)) % 2)
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcd") for _ in range(n)) for n in (0, 1, 3, 5, 9, 30, 80)] + ["a b c d e f g h a b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = df.select("i", quality.repeated_words(quality.triples(quality.words(F.col("text")))).alias("n")).collect()
    assert {r.i: r.n for r in found} == {i: brute_base(t)[4] for i, t in enumerate(texts)}


def test_quality_score_is_the_ratio(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    each = {r.doc_id: r.b for r in docs.select("doc_id", F.transform(quality.triples(quality.words(F.col("text"))), lambda z: F.array(*quality.gram_buckets(z))).alias("b")).collect()}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    raw, target = Counter(), Counter()
    for i, pairs in each.items():
        for p in pairs:
            raw.update(p)
            target.update(p if i in good else ())
    total_raw, total = sum(raw.values()) + quality.N_BUCKETS, sum(target.values())
    ratio = lambda b: math.log((target[b] * total_raw / (raw[b] + 1) + quality.PRIOR_GRAMS) / (total + quality.PRIOR_GRAMS))
    for r in quality.assess(docs, labels).collect():
        own = [ratio(b) for p in each[r.doc_id] for b in p]
        assert abs(r.llr - (sum(own) / len(own) if own else 0)) < 1e-5


def test_quality_separates_labelled_junk(spark):
    """The threshold and the prior hold on labels that the fit didn't see."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    unseen = "crc32(cast(doc_id as string)) % 5 = 0"
    rows = quality.assess(docs, labels.where(f"not {unseen}")).join(labels.where(unseen), "doc_id").where("not base_failed").collect()
    assert len(rows) > 300
    kept = {q: [r.kept for r in rows if r.quality == q] for q in (0, 1)}
    assert sum(kept[1]) / len(kept[1]) > 0.99
    assert sum(kept[0]) / len(kept[0]) < 0.1


def test_quality_runs_no_python(spark, sf):
    plan = quality.assess(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality_keeps_columns(odd_docs, spark):
    labels = spark.createDataFrame([(8, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.keep_good(odd_docs, labels)
    assert out.columns == odd_docs.columns
    assert quality.keep_good(odd_docs, None).count() <= odd_docs.count()


def brute_license(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(spark, odd_docs, no_docs):
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd_docs):
        rows = license_scan.scan_licenses(docs).collect()
        want = {r.doc_id: brute_license(r.text) for r in docs.collect()}
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert license_scan.scan_licenses(no_docs).count() == 0


# A passage of each license's public text or notice, as found in the wild, and the label it must get.
LICENSES = {
    "mit": "MIT License\n\nCopyright (c) 2020 Some Body\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.\n// You may obtain a copy of the License at\n//\n//     http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND",
    "bsd-3-clause": "* Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n* Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-4-clause": "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the Some Organization.\n4. Neither the name of the organization",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
    "bsl-1": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to",
    "unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "wtfpl": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004",
    "cc0-1": "To the extent possible under law, Some Body has waived all copyright and related or neighboring rights to this work.",
    "gpl-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1": "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3": "modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3": "modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nd": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


@pytest.mark.parametrize("label", sorted(LICENSES))
def test_each_license_is_found_and_a_near_miss_is_not(label):
    scanner = license_scan.Scanner()
    text = f"Some words before. {LICENSES[label]} And some after."
    assert label in scanner.scan(text)[5].split(",")
    # one mandatory word is another: wording must match exactly
    own = license_scan.words(LICENSES[label])
    a, at, end = max(((a, at, end) for a in scanner.automata if a.label == label for at in range(len(own)) if (end := a.match(own, at)) is not None), key=lambda m: (m[0].mandatory, m[2] - m[1]))
    for place in (at, (at + end) // 2, end - 1):
        missed = [*own[:place], "zebra", *own[place + 1 :]]
        if all(a.match(missed, i) is None for i in range(len(missed))):
            break
    else:
        raise AssertionError("no mandatory word was tried")


def test_every_label_has_a_text():
    assert set(LICENSES) == set(license_scan.TEMPLATES)


def brute_match(markup):
    """A template as a regular expression over words, for the automata to be held against."""
    out, at = [], 0
    for m in license_scan._MARK.finditer(markup):
        out += [f"{re.escape(w)} " for w in license_scan.words(markup[at : m.start()])]
        at = m.end()
        out.append("(?:" if m[1] == "optional" else ")?" if m[1] == "/optional" else f"(?:[^ ]+ ){{{m[2]},{m[3]}}}")
    out += [f"{re.escape(w)} " for w in license_scan.words(markup[at:])]
    return re.compile("(?:^|(?<= ))" + "".join(out))


def test_labels_are_those_of_regular_expressions(spark):
    forms = [(label, brute_match(t)) for label, ts in license_scan.TEMPLATES.items() for t in ts]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(docs)).collect()}
    extra = [(-i, x) for i, x in enumerate(LICENSES.values(), 1)]
    found = {i: license_scan.Scanner().scan(t)[5] for i, t in extra} | {i: r.labels for i, r in rows.items()}
    some = 0
    for i, t in [*map(tuple, docs), *extra]:
        line = "".join(f"{w} " for w in license_scan.words(t or ""))
        base = {x for p, x in license_scan.PHRASES.items() if f" {p} " in f" {line}"}
        want = base | {x for x, form in forms if form.search(line)}
        some += bool(want)
        assert set(filter(None, found[i].split(","))) == want, i
        if i in rows:
            assert (rows[i].score == 0) == (not want) and 0 <= rows[i].score < 1
    assert some > 30


def test_template_regions():
    a = license_scan.Automaton.compiled("x", "grant <<optional>>free of charge<</optional>> to <<var 1 3>> hereby")
    match = lambda t: a.match(license_scan.words(t), 0)
    assert match("grant to you hereby") == 4
    assert match("grant free of charge to a b c hereby ok") == 9
    assert match("grant free of to you hereby") is None
    assert match("grant to hereby") is None
    assert match("grant to a b c d hereby") is None
    with pytest.raises(ValueError):
        license_scan.Automaton.compiled("x", "a <<optional>>b")


def test_packing_query(spark, sf):
    library = Tokenizer.from_file(bpe.default_path(BYTE))
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_packing(spark, sf).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = want[r.doc_id]
        assert r.start == found.get(r.doc_id, 0) and r.length & (r.length - 1) == 0 and r.length <= 1024
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        assert r.doc_tokens == len(own) and r.offset == 0
        found[r.doc_id] = r.start + r.length
    assert found == {i: len(x) for i, x in want.items()}
    assert len({r.sequence_id for r in rows}) == len(rows)
    ordered = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in ordered] == sorted(r.length for r in rows)  # a bucket is one range of numbers


@settings(max_examples=300, deadline=None)
@given(text=st.lists(st.one_of(st.text(max_size=6), st.sampled_from(["<|endoftext|>", "  ", "\n\n", "'ll", "\x1f", "é", "a" * 200])), max_size=10).map("".join))
def test_packed_ids_are_the_library(packed, text):
    own, library = packed
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def packed():
    path = bpe.default_path(BYTE)
    with open(path, "rb") as f:
        return packing.LibraryIds(f.read()), Tokenizer.from_file(path)


def test_packed_ids_of_long_white_space_are_the_library(packed):
    own, library = packed
    for text in ("a\n" + "\n" * 1_500_000, "one" + " \t\n" * 500_000 + "two", "x" * 1_500_000, " a" * 60_000 + " " * 99_999 + "b", *[c * 1_000_000 + "b" for c in " \na!"]):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    for c in " \na!":
        text = c * 5_000_000 + "b"
        assert library.decode(np.frombuffer(own.encode(text), "<u4").tolist()) == text


def test_packed_ids_look_up_each_word_once(packed, monkeypatch):
    own, library = packed
    asked = []
    plain = bpe.Kept.all
    monkeypatch.setattr(bpe.Kept, "all", lambda kept, strings: asked.extend(strings) or plain(kept, strings))
    text = " ".join(f"word{chr(97 + i % 23)}{'.,;:'[i % 4]}" for i in range(50_000))
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) < 100  # one by one: 50,000


ODD = ["a", "é", "中", "🙂", "1", "½", " ", "  ", "\n", "\r\n", "\u3000", "\u2003", "\x85", "\x1c", "\0", "'", "'s", "'ll", "'l", "'re", "'v", "'S", ".", "!", "<|endoftext|>", "<|endoftext", "\u0301", "\ufffe", "x" * 70, " the"]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=3)), max_size=12).map("".join), max_size=6), step=st.sampled_from([1, 3, 20, 1 << 20]))
def test_packed_ids_of_many_texts_are_the_library(packed, texts, step):
    own, library = packed
    found = [np.frombuffer(ids, "<u4").tolist() for ids in own.closed([t.encode() for t in texts], step)]
    assert found == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]


def test_packed_ids_at_the_edges_of_kinds(packed):
    own, library = packed
    kinds = packing.kinds()
    edges = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    points = [chr(c) for c in sorted({*range(0x300), *edges.tolist(), *(edges - 1).tolist()}) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} {c}{c}'s{c}\n" for c in points[at : at + 50]) for at in range(0, len(points), 50)]
    for text, ids in zip(texts, own.closed(t.encode() for t in texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids + [0]


def test_packed_ids_of_other_tokenizers_are_the_library():
    with open(bpe.default_path(BYTE), "rb") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    own, library = packing.LibraryIds(json.dumps(spec).encode()), Tokenizer.from_str(json.dumps(spec))
    for text in ("", "one two", " one 'll<|endoftext|>x"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_odd_rows(odd_docs, no_docs):
    path = bpe.default_path(BYTE)
    rows = packing.pack(odd_docs, path).collect()
    assert [(r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == 0] == [(0, 1, b"\0\0\0\0")]
    assert packing.pack(no_docs, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd_docs, path, most=1000)
