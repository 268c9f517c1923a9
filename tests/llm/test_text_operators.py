import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import licenses, media, pseudonyms, quality
from geoloom.llm.wordstream import chunks

KEY = b"k"


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 10, 100, 4097):
        f = pseudonyms.Feistel(KEY, "t", size)
        image = [f(i) for i in range(size)]
        assert sorted(image) == list(range(size))
        assert all(f.inverse(y) == x for x, y in enumerate(image))


@given(st.text("0123456789", min_size=12, max_size=18))
@settings(max_examples=100, deadline=None)
def test_cards_stay_valid(body):
    number = body + str(-pseudonyms.luhn_sum(body + "0") % 10)
    fresh = pseudonyms.card(KEY, number)
    assert len(fresh) == len(number) and pseudonyms.luhn_sum(fresh) % 10 == 0


def test_values_keep_their_format():
    p = pseudonyms
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", p.card(KEY, "4111 1111 1111 1111"))
    assert p.card(KEY, "4111111111111112") is None
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", p.social(KEY, "123-45-6789")) and p.social(KEY, "000-45-6789") is None
    assert p.ip(KEY, "300.1.1.1") is None and p.ip(KEY, "01.1.1.1") is None and p.ip(KEY, p.ip(KEY, "10.0.0.1")) is not None
    a, b, c = p.date(KEY, "2020-02-29"), p.date(KEY, "29.02.2020"), p.date(KEY, "02/29/2020")
    assert a.split("-") == b.split(".")[::-1] and c[:2] == a[5:7] and p.date(KEY, "2021-02-29") is None
    fresh = p.iban(KEY, "DE89 3704 0044 0532 0130 00")
    assert p.iban(KEY, fresh) and fresh.startswith("DE") and p.iban(KEY, "DE88 3704 0044 0532 0130 00") is None
    assert p.email(KEY, "Ann.B7@mail.example.com") == p.email(KEY, "ann.b7@mail.example.com")


def test_pseudonyms_of_a_table(spark):
    text = "call +1 (212) 555-0100 or a.b@x.org at 10.1.2.3, card 4111111111111111, day 2020-02-29, not 4111111111111112"
    docs = spark.createDataFrame([(1, text, "n"), (2, "again 4111111111111111", "n"), (3, None, "n"), (4, "", "n"), (4, "", "n"), (5, "x" * 100_000, "n")], "doc_id long, text string, n_pii string")
    rows = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, KEY, counts=True).collect()}
    assert rows[1].n_pii == 5 and rows[1].pii_kinds == "card,date,email,ip,phone" and rows[1].text.endswith("not 4111111111111112")
    assert rows[2].text.split()[1] in rows[1].text and "4111111111111111" not in rows[1].text
    assert rows[3].text is None and rows[4].text == "" and rows[5].text == "x" * 100_000
    assert pseudonyms.pseudonymise(docs, KEY).columns == docs.columns
    assert pseudonyms.pseudonymise(docs.limit(0), KEY).count() == 0


def test_long_texts_without_blanks_take_linear_time():
    began = time.process_time()
    for text in ("a" * 500_000 + "@", "a@" + "b" * 500_000, "a.b@" * 100_000, "1" * 500_000 + "a@", "1 " * 200_000 + "@", "+1-" * 150_000, "AB12" * 100_000):
        pseudonyms.replaced(text, pseudonyms.spans(text, KEY))
    assert time.process_time() - began < 60
    found = pseudonyms.spans("x" * 200 + "@mail.example.org", KEY)
    assert [k for _, _, k, _ in found] == ["email"]


@pytest.mark.parametrize(
    "text, kinds, clear",
    [
        ("4111 1111 1111 1111 12/26", "card", "4111"), ("4111111111111111 123", "card", "4111111111111111"), ("order 12 4111-1111-1111-1111", "card", "4111"),
        ("10.1.2.173 4111111111111111", "ip,card", "4111111111111111"), ("2020-02-29 4111 1111 1111 1111 29.02.2020", "date,card,date", "4111"),
        ("4111111111111111 5500005555555559", "card,card", "5555555559"), ("3782 822463 10005 1234", "card", "822463"),
        ("4111 1111 1111 1111 555-123-4567", "card,phone", "123-4567"), ("BE68 5390 0754 7034 PAID", "iban", "0754"), ("2020-02-29 555 123 4567", "date,phone", "123 4567"),
        ("300.1.1.1 +1 (212) 555-0100", "phone", "555-0100"), ("4111 1111 1111 1112", "", "none"), ("99-01-2024-03-04", "date", "2024"),
    ],
)
def test_values_beside_numbers_are_found(text, kinds, clear):
    found = pseudonyms.spans(text, KEY)
    assert ",".join(k for _, _, k, _ in found) == kinds
    assert all(text[a:b] != fresh for a, b, _, fresh in found)
    assert clear not in pseudonyms.replaced(text, found)


def test_templates():
    def labels(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower().encode())
        return licenses.scan(words, *licenses._automata())["labels"]

    assert labels("Released under the terms of the MIT open source License.") == {"mit"}
    assert labels("MIT License Copyright (c) 2020 Some Body Permission is hereby granted, free of charge, to any person obtaining a copy of this software") == {"mit"}
    assert labels("GNU General Public License as published by the Free Software Foundation, either version 3 of the License") == {"gpl-3"}
    assert labels("GNU General Public License version 2") == set()
    assert labels("permission is hereby granted free of charge to no person obtaining a copy of this software") == set()
    assert labels("under the other MIT license") == set()


def test_whole_licenses():
    def labels(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower().encode())
        return licenses.scan(words, *licenses._automata())["labels"]

    isc = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
    and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
    PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    whole = licenses.compiled("isc", licenses.TEMPLATES["isc"][1])
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", isc.lower().encode())
    assert labels(isc) == {"isc"} and whole.longest(words, 0) == len(words)
    words[words.index(b"negligence")] = b"carelessness"
    assert whole.longest(words, 0) == -1
    apache = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."
    assert labels(apache) == {"apache-2"}
    lgpl = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"
    assert labels(lgpl) == {"lgpl"}


def _as_regex(template):
    """A template as a regular expression over words that blanks follow."""
    out = []
    for token in re.findall(r"\[|\]|\||\{\d+\}|[^\s\[\]|{}]+", template):
        out.append({"[": "(?:", "]": ")?", "|": "|"}.get(token) or (rf"(?:\S+ ){{0,{token[1:-1]}}}" if token[0] == "{" else re.escape(token) + " "))
    return re.compile("(?<!\\S)" + "".join(out))


def test_automata_are_the_regular_expressions():
    rnd = random.Random(5)
    short = [t for ts in licenses.TEMPLATES.values() for t in ts if len(t) < 260]
    vocabulary = sorted({w for t in short for w in re.findall(r"[a-z0-9]+", t)})
    for template in short:
        automaton, pattern = licenses.compiled("x", template), _as_regex(template)
        plain = re.findall(r"[a-z0-9]+", re.sub(r"\{\d+\}", "some body", template))
        for _ in range(60):
            words = [w for w in plain if rnd.random() < 0.97]
            words = [rnd.choice(vocabulary) if rnd.random() < 0.02 else w for w in words]
            text = "".join(w + " " for w in words)
            matched = automaton.longest([w.encode() for w in words], 0)
            assert (matched >= 0) == (pattern.match(text) is not None), (template, text)


def test_license_scan(spark):
    docs = spark.createDataFrame([(1, "CC BY NC under the MIT License, under the mit license"), (2, None), (3, ""), (4, "Apache License, Version 2.0"), (4, "Apache License, Version 2.0"), (5, "mit " * 20_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert (rows[1].n_words, rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels, rows[1].labels) == (11, 3, 0, 7, "cc-by-nc,mit", "cc-by-nc,mit")
    assert rows[1].score == 1.0 and rows[2].n_words == rows[3].n_words == 0 and rows[2].first_word is None and rows[3].base_labels == "" and rows[3].score == 0
    assert rows[4].base_labels == "apache-2" and rows[5].n_words == 20_000 and rows[5].labels == ""
    assert licenses.license_scan(docs.limit(0)).count() == 0


def _slow_cuts(data):
    out, at, n = [], 0, len(data)
    while n - at > media.MIN:
        end = min(n, at + media.MAX)
        for i in range(at + media.MIN - 1, end):
            h = sum(int(media._GEAR[data[i - j]]) << j for j in range(32)) & 0xFFFFFFFF
            if h >> (32 - media.BITS) == 0:
                end = i + 1
                break
        out.append(end)
        at = end
    return out + [n] * (at < n)


@given(st.binary(max_size=3000))
@settings(max_examples=40, deadline=None)
def test_cuts_are_the_rolling_hashs(data):
    assert media.cuts(data) == _slow_cuts(data)
    chunks = media.chunked(data)
    assert b"".join(b for _, b in chunks) == data
    assert media.opened(media.container(len(data), chunks)) == (len(data), data)


def test_media(spark):
    long = "some passage of text " * 2000
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (5, "head " + long), (6, "alone ü"), (7, "x" * 64)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, digest string")
    out = media.chunk_media(docs).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    texts = dict(rows)
    for r in out:
        data = (texts[r.doc_id] or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert len({tuple(r)[1:] for r in out if r.doc_id in (3, 4)}) == 1
    assert media.chunk_media(docs.limit(0)).count() == 0


def test_media_are_stored_and_come_back(spark):
    long = "some passage of text " * 500
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, "head " + long), (5, "alone ü"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lists, chunks = (t.collect() for t in media.chunk_store(docs))
    store = {bytes(c.digest): zlib.decompress(c.data) for c in chunks}
    assert len(store) == len(chunks) and sum(c.uses for c in chunks) == len(lists)
    texts = {}
    for r in sorted(lists, key=lambda r: (r.row, r.seq)):
        texts.setdefault(r.row, [r.doc_id, r.n_bytes, b""])[2] += store[bytes(r.digest)]
    want = sorted((i or 0, (t or "").encode()) for i, t in rows)
    assert sorted((i or 0, data[:n]) for i, n, data in texts.values()) == want
    out = media.chunk_media(docs).collect()
    assert sorted((r.doc_id or 0, media.opened(r.media)[1][: r.n_bytes]) for r in out) == want


def test_kth_largest(spark):
    keys = [5, -3, 2**62, -(2**63), 2**63 - 1, 5, 0]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in range(1, len(keys) + 1):
        assert quality.kth_largest(df, k) == sorted(keys, reverse=True)[k - 1]
    assert quality.kth_largest(df, 0) is None and quality.kth_largest(df, 8) is None


def test_best_cut():
    assert quality.best_cut([(1.0, 0), (2.0, 0), (5.0, 1), (6.0, 1)]) == 3.5
    assert quality.best_cut([]) == float("-inf") and quality.best_cut([(1.0, 1)]) == float("-inf") and quality.best_cut([(1.0, 0)]) == float("inf")


def test_resampling_separates_held_out_rows(spark):
    good = ["the cat and the dog walk along a river while people talk about weather", "a long day in the town ended with music and a calm walk home"]
    rows = [(i, (good[i % 2] + f" word{i % 9} ") * 3 if i % 4 else f"BUY!! NOW!! $$$ ||| {i % 7} !! " * 9, i) for i in range(800)] + [(5000, None, 0), (5001, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(0, 400)] + [(0, 0)], "doc_id long, quality int")
    sampler = quality.Resampler(docs, labels)
    kept = {r.doc_id: r.kept for r in sampler.kept().collect()}
    right = sum(kept[i] == bool(i % 4) for i in range(400, 800))
    assert right >= 390
    through = sampler.filtered(docs)
    assert through.columns == docs.columns and {r.doc_id for r in through.collect()} == {i for i, k in kept.items() if k}
    assert quality.Resampler(docs.limit(0), labels.limit(0)).kept().count() == 0


def test_resampling_is_the_plain_computation(spark):
    rnd = random.Random(1)
    good = ["the cat and the dog", "a river runs by", "people talk of the weather", "in town they say"]
    texts = [" ".join(rnd.choice(good) for _ in range(rnd.randint(1, 9))) if i % 3 else "BUY NOW!! $$$ " * rnd.randint(1, 9) for i in range(240)] + ["", None]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    labels = [(i, 1 if i % 3 else 0) for i in range(0, 120)]
    made = quality.Resampler(docs, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=512)
    every = [quality.features(next(chunks(pa.array([t or ""]), quality._CLASSES))[2], 512)[0] for t in texts]
    raw, target = np.ones(512), np.zeros(512)
    for i, buckets in enumerate(every):
        np.add.at(raw, buckets, 1)
        if dict(labels).get(i):
            np.add.at(target, buckets, 1)
    raw /= raw.sum()
    target += raw * 512 * quality.SMOOTHING
    table = np.log(target / target.sum()) - np.log(raw)
    assert np.allclose(made.table, table)
    rows = {r.doc_id: r for r in made.kept().collect()}
    assert all(abs(rows[i].log_ratio - table[b].sum()) < 1e-9 for i, b in enumerate(every))
    kept = sorted((r.score for r in rows.values() if r.kept), reverse=True)
    assert kept == sorted((r.score for r in rows.values()), reverse=True)[: made.k] and 0 < made.k < len(texts)
    filtered = made.filtered(docs)
    assert filtered.columns == docs.columns and {r.doc_id for r in filtered.collect()} == {i for i, r in rows.items() if r.kept}


def test_draws_follow_the_weights():
    """Of two documents with equal noise sources, the first one drawn is each with the chance that its weight gives it."""
    rng = np.random.default_rng(3)
    noise = rng.integers(-(2**63), 2**63, (20_000, 2), dtype=np.int64)
    words = pa.array(["x", "y"])
    table = np.zeros(64)
    bucket = [quality.features(next(chunks(pa.array([w]), quality._CLASSES))[2], 64)[0] for w in ("x", "y")]
    table[bucket[0][0]] = 1.0
    ratio, _ = quality._scores(words, noise[0], table, 1.0)
    first = np.mean([np.argmax(quality._scores(words, n, table, 1.0)[1]) == 0 for n in noise[:4000]])
    share = np.exp(ratio[0]) / np.exp(ratio).sum()
    assert abs(first - share) < 0.03
