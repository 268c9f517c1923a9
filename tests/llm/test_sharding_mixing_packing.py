import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geoloom.llm import mixing, packing, sharding

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_longest_first_takes_the_least_loaded():
    assert sharding.longest_first([(5, "a"), (4, "b"), (3, "c"), (3, "d"), (3, "e")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}
    assert sharding.longest_first([], 3) == {}


def test_shards(spark):
    rows = [(i, f"text {i % 50} " * (1 + i % 50), "x") for i in range(400)] + [(900, None, "x"), (901, None, "x"), (902, "", "x"), (1, "text 1 text 1 ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.lpt_shards(docs, 7).collect()
    assert len(out) == len(rows)
    texts, of_group, slots, loads = {}, {}, defaultdict(list), Counter()
    for i, t, _ in rows:
        texts.setdefault(i, t)
    for r in out:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 16 and r.law == "bytes" and r.grown_shard is None
        assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))
        assert of_group.setdefault(t, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(loads) == 7 and max(loads.values()) - min(loads.values()) < 0.1 * max(loads.values())
    assert sharding.lpt_shards(docs.limit(0), 7).count() == 0


@given(st.floats(0.01, 0.99), st.integers(1, 50), st.floats(0.01, 0.99), st.integers(1, 50), st.floats(0, 0.999))
@settings(max_examples=300, deadline=None)
def test_a_duel_keeps_words_and_settles_one(p, s, q, t, u):
    a, b = mixing.duel(p, s, q, t, u)
    assert a * s + b * t == pytest.approx(p * s + q * t)
    assert -1e-9 <= a <= 1 + 1e-9 and -1e-9 <= b <= 1 + 1e-9
    assert a in (0.0, 1.0) or b in (0.0, 1.0)


def _targets(sizes):
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    weight = dict(zip(names, [5, 2, 1] * len(names), strict=False))
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        share = (total - sum(2 * sizes[k] for k in capped)) / sum(weight[k] for k in names if k not in capped)
        fresh = {k for k in names if k not in capped and share * weight[k] > 2 * sizes[k]}
        if not fresh:
            return {k: 2 * sizes[k] if k in capped else share * weight[k] for k in names}
        capped |= fresh


def test_mix(spark):
    rows = [(i, "w " * (1 + i % 37), None if i % 11 == 0 else f"s{i % 5}") for i in range(3000)] + [(5000, None, "s1"), (5001, "", "s1"), (5001, "", "s1"), (7, "w " * 8, "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.pivotal_mix(docs)
    assert out.columns[:3] == docs.columns
    found = out.collect()
    assert len(found) == len(rows)
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want = _targets(sizes)
    for k in sizes:
        assert target[k] == pytest.approx(want[k])
        assert abs(taken[k] - want[k]) <= 38
    again = mixing.pivotal_mix(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in found) == sorted((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.pivotal_mix(docs.limit(0)).count() == 0


def _best(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
    return max(sums)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(1, 60))
@settings(max_examples=200, deadline=None)
def test_fill_is_the_closest_sum(counts, room):
    chosen = packing.fill(counts, room)
    assert all(k <= counts[length] for length, k in chosen.items())
    assert sum(length * k for length, k in chosen.items()) == _best(counts, room)


@given(st.dictionaries(st.integers(1, 63), st.integers(1, 200), max_size=20))
@settings(max_examples=100, deadline=None)
def test_windows_use_every_piece_once(counts):
    windows = packing.minimum_slack(counts, 64)
    used = Counter()
    for times, window in windows:
        assert sum(length * k for length, k in window.items()) <= 64
        for length, k in window.items():
            used[length] += times * k
    assert used == Counter(counts)


def test_pack(spark):
    rows = [(i, f"text {i} with words " * (i % 400)) for i in range(300)] + [(900, None), (901, ""), (5, "text 5 with words " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(docs, PATH, window=256).collect()
    sequences, lengths = defaultdict(list), Counter()
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        lengths[r.doc_id] += r.length
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert lengths[900] == lengths[901] == 1
    assert {r.doc_id for r in out} == {i for i, _ in rows}
    assert sum(lengths.values()) > 0.97 * 256 * len(sequences)
    five = [r for r in out if r.doc_id == 5]
    assert len(five) == 2 and five[0].ids_crc32 == five[1].ids_crc32
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_packed_ids_are_the_documents(spark):
    rows = [(i, f"text {i} with words " * (i % 120)) for i in range(150)] + [(900, None), (901, ""), (5, "text 5 with words " * 5), (None, "no id")]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH, window=64).collect()
    tokenizer, found, want = Tokenizer.from_file(PATH), defaultdict(list), Counter()
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.update((doc_id, len(ids), at, tuple(ids[at : at + 64])) for at in range(0, len(ids), 64))
    assert Counter((r.doc_id, r.doc_tokens, r.start, tuple(r.ids)) for r in out) == want
    for r in out:
        assert len(r.ids) == r.length and zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32
        found[r.sequence_id].append((r.offset, r.length))
    assert sorted(found) == list(range(len(found))) and all(sum(n for _, n in pieces) <= 64 for pieces in found.values())


def test_ids_are_stored_as_bytes(spark, monkeypatch):
    """Cuts are bytes, which Spark copies as a whole, however batches are cut."""
    texts = ["a b c " * i for i in range(20)] + [None, "漢字 don't <|endoftext|>\x1c x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.tokenized(docs, PATH, 16, 0, "doc_id", "text")
    assert rows.schema["cuts"].dataType.simpleString() == "array<binary>"
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 9] * 7)], names=["text"])
    monkeypatch.setattr(packing, "HANDED_ON", 40)
    parts = list(packing._bounded(batch, 0))
    assert len(parts) > 1 and pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    tokenizer = Tokenizer.from_file(PATH)
    for r in rows.collect():
        want = [*tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert array("I", b"".join(r.cuts)).tolist() == want and all(len(c) == 64 for c in r.cuts[:-1])
