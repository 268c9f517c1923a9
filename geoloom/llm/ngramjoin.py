"""Documents whose word shingles overlap: a Jaccard join by adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, collecting, discard, discard_path, maybe_among, stored
from .wordstream import SPACED, Words, chunks, mix, shingles

#: A shingle's frequency class is the number of these, from the first on, that its count over all
#: documents exceeds. Any order of shingles gives right results, a good one keeps frequent shingles out of prefixes.
CLASSES = (1, 3, 8, 32, 128, 512, 2048, 8192, 1 << 17, 1 << 21, 1 << 25, 1 << 29)
#: Bits of the filter of each class: a bit for every shingle over these, and at most the second number whatever the input.
CLASS_SHARE = (1, 4, 8, *[16] * 9)
CLASS_MOST = (1 << 28, 1 << 26, 1 << 25, *[1 << 22] * 9)
#: Shingles are counted in cells of their hash, 2 ** CELL_BITS for each that is expected, in parts of about PART shingles.
CELL_BITS, PART = 8, 1 << 20
#: Shingles that a task counts before it hands them on.
FLUSH = 2_000_000
#: Multiplicity tried for each document: so many shared prefix shingles are asked for, at most.
MOST = 4
#: What it costs to verify a candidate, in postings read.
VERIFY = 16.0
#: Prefix shingles of each document, those of the least hashes, by which it looks for a hub.
PICKS = 8
#: Rounds that link documents to hubs before the remaining candidates are listed: at most so many,
#: and no more once listing meets at most FEW times as many pairs as lists have rows, or a round leaves over GAIN of them.
HUB_ROUNDS, FEW, GAIN = 4, 4, 0.6
#: Hubs of each list in all rounds but the first.
SLOTS = 16
#: Length buckets of candidate lists for each factor of 100 / percent.
FINE = 4
#: Shingles that a posting has with it, the first of its document's open ones: a pair that shares an earlier one is met there.
EARLY = 12
#: Bits of a document's sketch. A set of some hundred shingles is told from one that is less alike than asked for; of much larger ones more pairs are counted.
SKETCH = 512


def _sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document."""
    h = words.hashes()
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        yield np.unique(shingles(h[lo:hi], size))


class Frequencies:
    """Filters of the shingles in each frequency class.

    A shingle that the first filter does not have is in one document's set only: filters err on the
    side of having a shingle. expected: about how many shingles all documents have together; it
    decides on sizes, not on results.
    """

    def __init__(self, expected: int):
        expected = max(1 << 16, expected)
        self.width = max(32, min(60, math.ceil(math.log2(expected)) + CELL_BITS))
        self.part_bits = min(18, max(6, math.ceil(math.log2(expected / PART))))
        self.high = np.uint32 if self.width <= 48 else np.uint64  # of what is above 16 bits
        least = 64 << self.part_bits  # a part's bits are whole words of their own
        self.bits = [max(least, min(most, expected // share) // least * least) for share, most in zip(CLASS_SHARE, CLASS_MOST, strict=True)]
        self.tables: list[np.ndarray] = []

    def cells(self, s: np.ndarray) -> np.ndarray:
        return s >> np.uint64(64 - self.width)

    def place(self, cells: np.ndarray, kind: int) -> np.ndarray:
        return (cells >> np.uint64(self.width - 32)) * np.uint64(self.bits[kind]) >> np.uint64(32)

    def of(self, s: np.ndarray) -> np.ndarray:
        """The frequency class of each shingle: how many filters have it, from the first without a gap."""
        cells = self.cells(s)
        out = np.zeros(len(s), dtype=np.int64)
        alive = np.arange(len(s))
        for kind, table in enumerate(self.tables):
            place = self.place(cells[alive], kind)
            alive = alive[table[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1]
            if not len(alive):
                break
            out[alive] += 1
        return out


def frequencies(docs: DataFrame, size: int) -> Frequencies:
    """Counts the shingles of all documents (text).

    Each task sorts the shingles it meets and hands them on as compressed differences by part of the
    hash space; the parts are counted apart, each has a range of the filters' bits of its own, and
    the driver gets these bits only.
    """
    expected = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // 6
    out = Frequencies(expected)
    starts = np.arange(1 << out.part_bits, dtype=np.uint64) << np.uint64(out.width - out.part_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held) if held else np.zeros(0, dtype=np.uint64)
            held.clear()
            every.sort()
            edges = np.append(np.searchsorted(every, starts), len(every))
            parts = np.flatnonzero(np.diff(edges))
            steps = np.diff(every, prepend=np.uint64(0))
            steps[edges[parts]] = every[edges[parts]] - starts[parts]
            low, high = steps.astype(np.uint16), (steps >> np.uint64(16)).astype(out.high)
            pieces = [(int(p), low[edges[p] : edges[p + 1]].tobytes(), zlib.compress(high[edges[p] : edges[p + 1]].tobytes(), 1)) for p in parts]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pieces], kind) for i, kind in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "low", "high"])

        for batch in batches:
            for _, _, words in chunks(batch.column(0), SPACED):
                for s in _sets(words, size):
                    held.append(out.cells(s))
                    n += len(s)
                if n >= FLUSH:
                    yield flush()
                    n = 0
        yield flush()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        held: list[np.ndarray] = []

        def found() -> pa.RecordBatch:
            values, times = np.unique(np.concatenate(held), return_counts=True)
            kinds, blocks = [], []
            for kind, least in enumerate(CLASSES):
                values, times = values[times > least], times[times > least]
                if not len(values):
                    break
                size = out.bits[kind] >> out.part_bits
                place = np.zeros(size, dtype=np.uint8)
                place[(out.place(values + starts[at], kind) - np.uint64(at * size)).astype(np.int64)] = 1
                kinds.append(kind)
                blocks.append(zlib.compress(np.packbits(place, bitorder="little").tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([at] * len(kinds), pa.int32()), pa.array(blocks, pa.binary())], names=["kind", "part", "bits"])

        for batch in batches:
            for part, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    if at is not None:
                        yield found()
                    at, held = part, []
                held.append(np.cumsum(np.frombuffer(low, dtype=np.uint16) + (np.frombuffer(zlib.decompress(high), dtype=out.high).astype(np.uint64) << np.uint64(16))))
        if at is not None:
            yield found()

    parts = docs.select("text").mapInArrow(count, "part int, low binary, high binary").repartition("part").sortWithinPartitions("part")
    out.tables = [np.zeros(n // 8, dtype=np.uint8) for n in out.bits]
    for row in parts.mapInArrow(add, "kind int, part int, bits binary").toArrow().to_pylist():
        size = out.bits[row["kind"]] >> out.part_bits + 3
        out.tables[row["kind"]][row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
    return out


def required(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set it links to, at least."""
    return -(-n * percent // 100)


def multiplicity(estimate: np.ndarray, n: int, percent: int) -> int:
    """How many shared prefix shingles to ask of a document, given estimated list lengths in prefix order.

    With l, the prefix has n - required + l shingles, whose lists are read, and a candidate stands in
    l of them, so candidates to verify are about the lists' sum over l. The cheapest l holds.
    """
    base = n - required(n, percent)
    best, chosen = np.inf, 1
    for level in range(1, min(MOST, n - base) + 1):
        read = float(estimate[: base + level].sum())
        cost = read + VERIFY * read / level
        if cost < best:
            best, chosen = cost, level
    return chosen


def _digest(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(s: np.ndarray) -> np.ndarray:
    """The parity of how many shingles fall on each of SKETCH bits, as longs."""
    odd = np.bincount((mix(s) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(docs: DataFrame, shared: Broadcast, size: int, percent: int) -> DataFrame:
    """Of every row of docs (doc_id, th, text): n, the number k of its set (null if empty), its multiplicity, and what of its prefix, rarest first, other sets may have: shingles, their places, and which are its picks; and its sketch."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        length = np.array([0.0, 2.0, *CLASSES[1:]])  # of lists, by class
        for batch in batches:
            n, k, level, tokens, places, picks, sketches = [], [], [], [], [], [], []
            for _, _, words in chunks(batch.column(2), SPACED):
                for s in _sets(words, size):
                    n.append(len(s))
                    k.append(_digest(s) if len(s) else None)
                    frequency = table.of(s)
                    order = np.argsort(frequency, kind="stable")
                    level.append(multiplicity(length[frequency[order]], len(s), percent) if len(s) else 0)
                    order = order[: len(s) - required(len(s), percent) + level[-1]]
                    place = np.flatnonzero(frequency[order])
                    token = s[order[place]]
                    pick = np.zeros(len(token), dtype=bool)
                    pick[np.argsort(mix(token))[:PICKS]] = True
                    tokens.append(token.view(np.int64))
                    places.append(place.astype(np.int32))
                    picks.append(pick)
                    sketches.append(_sketch(s))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], t)) for x, t in ((tokens, pa.int64()), (places, pa.int32()), (picks, pa.bool_()))]
            lists.append(pa.array(sketches, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(level, pa.int32()), *lists], names=["doc_id", "th", "n", "k", "level", "token", "pos", "pick", "sketch"])

    return docs.mapInArrow(run, f"doc_id {kind}, th long, n long, k long, level int, token array<long>, pos array<int>, pick array<boolean>, sketch array<long>")


def _shared_shingles(docs: DataFrame, wanted: DataFrame, shared: Broadcast, size: int) -> DataFrame:
    """(k, tokens): of the texts whose hashes are in wanted (th), and maybe of some others, all shingles that more sets may have. Each text once."""
    once = maybe_among(docs.select("th", "text"), F.col("th"), wanted, wanted.count(), "_in").where("_in").groupBy("th").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            k, tokens = [], []
            for _, _, words in chunks(batch.column(0), SPACED):
                for s in _sets(words, size):
                    k.append(_digest(s))
                    tokens.append(s[table.of(s) > 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["k", "tokens"])

    return once.select("text").mapInArrow(run, "k long, tokens array<long>").dropDuplicates(["k"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, na, b, nb) whose sets' Jaccard similarity is at least percent / 100, counted exactly, as (a, b)."""
    left, right = sets.select(F.col("k").alias("a"), F.col("tokens").alias("ta")), sets.select(F.col("k").alias("b"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb")).cast("long")
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _with_component(rows: DataFrame, group: DataFrame | None, key: str = "k", out: str = "component") -> DataFrame:
    if group is None:
        return rows.withColumn(out, F.col(key))
    return rows.join(group.select(F.col("node").alias(key), F.col("component").alias("_of")), key, "left").withColumn(out, F.coalesce("_of", key)).drop("_of")


def _mixed(lists: DataFrame) -> DataFrame:
    """The lists (token, component, ..) whose documents are of two components or more."""
    tokens = lists.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    return lists.join(tokens, "token", "left_semi")


def _can_link(s: str, t: str, percent: int) -> Column:
    """Whether a shared shingle with n - p of n shingles from it on, in each document, may be the first that documents share that link, if ns <= nt.

    They share at least max(percent (ns + nt) / (100 + percent), percent nt / 100) shingles, the first
    of which has as many from it on in either document; so it is in both prefixes, however short.
    """
    both = f"greatest(({percent}L * (n{s} + n{t}) + {99 + percent}L) div {100 + percent}L, ({percent}L * n{t} + 99L) div 100L)"
    return F.expr(f"100L * n{s} >= {percent}L * n{t} and least(n{s} - p{s}, n{t} - p{t}) >= {both}")


def _alike(s: str, t: str, percent: int) -> Column:
    """Whether documents' sketches let them link, as no sketches do: a bit that differs stands for a shingle that only one of them has."""
    differ = sum((F.bit_count(F.col(f"w{s}")[i].bitwiseXOR(F.col(f"w{t}")[i])) for i in range(1, SKETCH // 64)), F.bit_count(F.col(f"w{s}")[0].bitwiseXOR(F.col(f"w{t}")[0])))
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col(f"n{s}") + F.col(f"n{t}")), F.lit(True))


def _side(rows: DataFrame, s: str) -> list[Column]:
    return [F.col("k").alias(f"k{s}"), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), F.col("component").alias(f"c{s}")]


def _stars(picks: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) of a document and hubs in its lists of another component whose sketches let them link; of the hubs of a slot each document keeps that which it shares most lists with.

    Each list and each two neighbouring length classes have a hub: in the first round the document
    with the least share of rarer shingles, as the source of edited copies has, later one in each of
    SLOTS slots that the round draws among those with few of them.
    """
    step = float(np.log(100.0 / percent))
    at = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int")
    wide = picks.withColumn("window", F.explode(F.array(at, at + 1)))
    rarer = F.col("pos") / F.col("n")
    drawn = F.xxhash64("k", F.lit(turn))
    first = F.struct(F.floor(20 * rarer).alias("rarer"), drawn.alias("drawn")) if turn else F.struct(rarer.alias("rarer"))
    slot = F.pmod(F.shiftright(drawn, 8), F.lit(SLOTS)).cast("int") if turn else F.lit(0)
    hubs = wide.groupBy("token", "window", slot.alias("slot")).agg(F.min(F.struct(first.alias("first"), *_side(wide, "h"), F.col("sketch").alias("wh"))).alias("hub"))
    met = wide.select("token", "window", *_side(wide, "d"), F.col("sketch").alias("wd")).join(hubs.select("token", "window", "slot", "hub.*"), ["token", "window"]).where("cd <> ch")
    met = met.where(F.when(F.col("nd") <= F.col("nh"), _can_link("d", "h", percent)).otherwise(_can_link("h", "d", percent)) & _alike("d", "h", percent))
    best = met.groupBy("kd", "nd", "kh", "nh", "slot").agg(F.count("*").alias("lists")).groupBy("kd", "nd", "slot").agg(F.max(F.struct("lists", "kh", "nh")).alias("best"))
    return best.select(*_ordered("kd", "nd", "best.kh", "best.nh")).distinct()


def _ordered(k: str, n: str, other: str, m: str) -> list[Column]:
    below = F.col(k) < F.col(other)
    return [F.least(k, other).alias("a"), F.when(below, F.col(n)).otherwise(F.col(m)).alias("na"), F.greatest(k, other).alias("b"), F.when(below, F.col(m)).otherwise(F.col(n)).alias("nb")]


class _Listing:
    """How the pairs of a shorter and a longer document of different components, in mixed lists, are met.

    A longer document goes to the length buckets of all shorter ones that its place in the list lets
    it link with, a shorter one to its own bucket if its place lets it link with any longer one. In
    each list's bucket the shorter documents of one component, that with most of them, are kept
    apart, as the longer ones of that component need none of them. Shingles have one order, so
    a pair that links meets in the list of the first that it shares; in later ones it is passed over
    where one of the first EARLY shingles of either document proves that it shares an earlier one,
    and everywhere if the documents' sketches prove that they differ in too many shingles.
    """

    def __init__(self, lists: DataFrame, percent: int):
        self.percent, self.lists = percent, lists
        step = float(np.log(100.0 / percent)) / FINE
        bucket = lambda x: F.floor(F.log(x.cast("double")) / step).cast("int")
        reach = F.expr(f"((n - pos) * {100 + percent}L) div {percent}L - n")
        least = F.expr(f"({percent}L * n + 99L) div 100L")
        rows = lists.withColumn("_reach", reach)
        short = rows.where("_reach >= n").withColumn("bucket", bucket(F.col("n"))).drop("_reach")
        self.long = rows.where(F.col("_reach") >= least).withColumn("bucket", F.explode(F.sequence(bucket(least), bucket(F.least("n", "_reach"))))).drop("_reach")
        counts = short.groupBy("token", "bucket", "component").agg(F.count("*").alias("n"))
        counts = counts.groupBy("token", "bucket").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("n"))
        counts = counts.select("token", "bucket", F.col("most.component").alias("main"), F.col("most.n").alias("in_main"), F.col("n").alias("in_all"))
        needed = self.long.join(counts, ["token", "bucket"]).withColumn("of_main", F.col("component") == F.col("main")).where("not of_main or in_all > in_main")
        self.needed = stored(needed.drop("main"), "lists-long")
        self.short = short.join(counts.select("token", "bucket", "main"), ["token", "bucket"]).withColumn("side", F.col("component") == F.col("main")).drop("main")
        self.meetings = self.needed.agg(F.coalesce(F.sum(F.when(F.col("of_main"), F.col("in_all") - F.col("in_main")).otherwise(F.col("in_all"))), F.lit(0))).first()[0]

    def met(self, sketches: DataFrame | None = None) -> DataFrame:
        """A shorter (ks, ns) and a longer document (kt, nt) of different components, whose sketches (k, sketch), if given, let them link, for each list that they may meet in: one, unless they share none of their first EARLY shingles."""
        sides = F.when(F.col("of_main"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
        early = self.lists.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_all"))
        early = early.select("k", F.transform(F.slice("_all", 1, EARLY), lambda x: x["token"]).alias("_first"))
        early = early.withColumn("sketch", F.lit(None).cast("array<long>")) if sketches is None else early.join(sketches, "k")
        place = F.array_position("_first", F.col("token")).cast("int")
        before = F.when(place > 0, F.slice("_first", F.lit(1), place - 1)).otherwise(F.col("_first"))
        short, long = (rows.join(early, "k").withColumn("early", before).drop("_first") for rows in (self.short, self.needed))
        long = long.select("token", "bucket", F.explode(sides).alias("side"), *_side(long, "t"), F.col("early").alias("et"), F.col("sketch").alias("wt"))
        short = short.select("token", "bucket", "side", *_side(short, "s"), F.col("early").alias("es"), F.col("sketch").alias("ws"))
        once = (F.col("ns") < F.col("nt")) | ((F.col("ns") == F.col("nt")) & (F.col("ks") < F.col("kt")))
        met = short.join(long, ["token", "bucket", "side"]).where(once & (F.col("cs") != F.col("ct")) & _can_link("s", "t", self.percent) & ~F.arrays_overlap("es", "et") & _alike("s", "t", self.percent))
        return met.select("ks", "ns", "kt", "nt")

    def pairs(self, prefix: DataFrame) -> DataFrame:
        """Pairs (a, na, b, nb, shared) whose prefixes (k, level, token, sketch) share as many shingles as the lesser level asks for."""
        both = self.met(prefix.select("k", "sketch")).distinct()
        for s in "st":
            both = both.join(prefix.select(F.col("k").alias(f"k{s}"), F.col("level").alias(f"l{s}"), F.col("token").alias(f"x{s}")), f"k{s}")
        shared = both.withColumn("shared", F.size(F.array_intersect("xs", "xt"))).where("shared >= least(ls, lt)")
        return shared.select(*_ordered("ks", "ns", "kt", "nt"), "shared")


def _verified(open_lists: DataFrame, prefix: DataFrame, sets: DataFrame, links: DataFrame | None, percent: int) -> DataFrame | None:
    """Adds to links those among candidates that make components complete: by hubs first, then by listing what is left."""
    group = components(links) if links is not None else None
    verified: DataFrame | None = None

    def verify(pairs: DataFrame) -> bool:
        nonlocal links, group, verified
        pairs = pairs.select("a", "na", "b", "nb")
        pairs = stored(pairs if verified is None else pairs.join(verified, ["a", "b"], "left_anti"), "shingle-pairs")
        verified = pairs if verified is None else verified.unionByName(pairs)
        found = stored(_linked(pairs, sets, percent), "shingle-links")
        if found.isEmpty():
            return False
        links = found if links is None else links.unionByName(found)
        group = components(links)
        return True

    before = None
    for turn in range(HUB_ROUNDS + 1):
        lists = stored(_mixed(_with_component(open_lists, group)), "open-lists")
        rows = lists.count()
        if not rows:
            discard(lists)
            return links
        if turn:
            listing = _Listing(lists, percent)
            if turn == HUB_ROUNDS or listing.meetings <= FEW * rows or (before is not None and listing.meetings > GAIN * before):
                break
            before = listing.meetings
            discard(listing.needed)
        verify(_stars(lists.where("pick").join(prefix.select("k", "sketch"), "k"), turn, percent))
        discard(lists)
    pairs = stored(listing.pairs(prefix), "shingle-candidates")
    discard(lists)
    discard(listing.needed)
    apart = lambda: _with_component(_with_component(pairs, group, "a", "ca"), group, "b", "cb").where("ca <> cb")
    if pairs.count() > rows:  # first the likeliest pair of each two components
        verify(apart().groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.max(F.struct("shared", "a", "na", "b", "nb")).alias("best")).select("best.*"))
    verify(apart())
    return links


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links), component (its number, null without words) and text_hash (xxhash64) of every row.

    Two documents link when their sets of distinct word shingles (A-Z folded; fewer than `size` words
    are one shingle) have a Jaccard similarity of percent / 100 or more. A document without words
    links with nothing. Rows of one set are one class, told by 64 bits of a digest, so copies cost
    one comparison; rows with words that share a doc_id are one node, with the links of all. A null
    doc_id counts as larger than any: a component has a null component_id if all of its ids are
    null. Other columns are not read.

    Shingles are ordered by classes of their frequencies over all documents, then by hash. A document
    asks for as many shared prefix shingles as its estimated candidate cost advises and has a prefix
    that much longer; documents in a link share at least the lesser number of the two, the first at a
    place that leaves enough of either for the rest (_can_link), and their sketches differ in no more bits
    than their sets may in shingles (_alike), which is told where they meet. Shingles of one document only are proven
    so by a filter and enter no list. Since components are asked for, candidates of one component
    need no verification: documents first link to a hub of their lists, and then every candidate
    pair that is still in two components is verified. No list is gathered in one row or in memory;
    nothing is capped. docs is evaluated four times.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    with collecting() as paths:
        common = docs.sparkSession.sparkContext.broadcast(frequencies(docs, size))
        rows = stored(prefixes(docs, common, size, percent), "shingle-rows")
        result = rows.select("doc_id", F.col("n").alias("n_shingles"), "k", "th")
        classes = stored(rows.where("k is not null").groupBy("k").agg(*[F.first(c).alias(c) for c in ("n", "level", "th", "token", "pos", "pick", "sketch")]), "shingle-classes")
        lists = classes.select(F.inline(F.arrays_zip("token", "pos", "pick")), "k", "n", "th").withColumn("pos", F.col("pos").cast("long"))
        lists = lists.where(F.expr(f"n - pos >= ({percent}L * n + 99L) div 100L"))  # the first shared shingle is one of these
        open_lists = stored(_mixed(lists.withColumn("component", F.col("k"))).drop("component"), "shingle-lists")
        sets = stored(_shared_shingles(docs, open_lists.select("th").distinct(), common, size), "shingle-sets")
        common.unpersist()
        repeated = rows.where("doc_id is not null and k is not null").groupBy("doc_id").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("doc_id", "lo")
        links = None
        if not repeated.isEmpty():
            links = stored(rows.where("k is not null").join(repeated, "doc_id").where("k <> lo").select(F.col("k").alias("a"), F.col("lo").alias("b")), "shingle-links")
        links = _verified(open_lists.drop("th"), classes, sets, links, percent)
        placed = result if links is None else _with_component(result, components(links), "k", "component").drop("k").withColumnRenamed("component", "k")
        placed = stored(placed, "shingle-components")
        for path in paths[:-1]:
            discard_path(docs.sparkSession, path)
    least = placed.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(least, "k", "left")
    return placed.select("doc_id", "n_shingles", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("k").alias("component"), F.col("th").alias("text_hash"))


def op4_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("component", "text_hash")
