"""Near-dedup by fast similarity sketching, banding and exact verification.

Sketch. A document is the set of its distinct k-word shingles. Round i throws
every shingle into one of T bins; a bin keeps the least value it gets. Bins
that stay empty are filled by later rounds, each with a hash of its own; from
round T on, round T + j throws everything into bin j. So each coordinate fills
after at most 2 T rounds, usually two, and the share of equal coordinates
estimates the Jaccard similarity with Chernoff bounds, as with T independent
hash functions, in time of about the set's size.

Bands. T coordinates make bands of 4, 2 or 1, by the similarity that is asked
for; documents that share a band are candidates. At similarity 0.8 there are 32
bands of 4, and a pair has none in common with probability (1 - 0.8 ** 4) ** 32 =
5e-8; at others it is 1e-7 at most. Under LEAST_PERCENT it would be more, and such
similarities are refused.

Links. Equal sets become one node first, whatever their number. Each bucket
then compares its nodes with one pivot, by their full shingle sets, and the
links' components are found. Only buckets that still hold several components
go on: with other pivots while those join many, at last with all pairs that
are in different components, without emitting pairs. A bucket that fits one
group is that group. The nodes of larger buckets, texts that share most of a
frequent passage and are yet not similar enough, would be compared in the square
of their number; they are dealt anew by prefix filtering, which loses no link:
with a node's shingles ordered from the rarest among these nodes, two sets of the
similarity share one of the first n - ceil(percent * n / 100) + 1 of each. Only
nodes that share such a rare shingle stand together. That spares variants of one
text nothing, as all their shingles are frequent: both ways are exact, and the one
with fewer pairs to look at is taken, buckets cut into cells or, where these hold
more than FEW pairs a node, rare shingles. In a
group, rows outside its largest component meet all others. In all groups, pairs that
cannot reach the similarity by their sizes, or whose sketches are six standard
deviations from it, are passed over; all others are compared by their full sets,
once, in the first band or rare shingle they share. So a group of near copies
costs about its size, and no link between components is lost.

Shingles are known by 64-bit hashes, and equal sets, before they become one node,
by 128 bits of BLAKE2b over these: two different texts of a billion are taken for
one with a probability of 1e-21.

Words are runs of anything but ASCII white space, A-Z lower-cased. A text of
fewer words than k has one shingle, its words; one without words, or null,
has none and is linked with nothing. An empty table gives an empty result; very
long texts count by their shingles in the size of a group. Rows that share a
doc_id are one document whose texts are all looked at. A row whose doc_id is null follows the component
of its set, or stays if there is none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SLICE, WordHashes, byte_list, gram_hashes, limit_batches, mix64, shared_table, trimmed
from .graph import components

T = 128
#: Similarity in per cent from which links can be asked for, and the probability that all bands miss a pair of that similarity.
LEAST_PERCENT, MISSED = 15, 1e-7
#: Pivot rounds before all remaining pairs are compared. One is made while more than REST pairs a node remain, if the last left at most SHRINKS of them.
PIVOT_ROUNDS, REST, SHRINKS = 3, 8, 0.7
#: Nodes, and shingles of all nodes, that are compared in one group. What is larger is cut into cells, which meet two by two.
CELL, CELL_SHINGLES = 512, 1_000_000
#: Pairs a node that are screened in about the time that its rare shingles take to be found.
FEW = 20_000
CHUNK = 64
#: Standard deviations below the expected number of equal coordinates from which a pair is not compared by its sets.
SPREAD = 5.8


def band_rows(percent: int) -> int:
    """Coordinates of a band: 4, 2 or 1, the most with which all bands miss a pair of the similarity in MISSED of cases."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent must be from {LEAST_PERCENT} to 100: {percent}")
    return next(r for r in (4, 2, 1) if (1 - (percent / 100) ** r) ** (T // r) <= MISSED or r == 1)


def least_equal(percent: int) -> int:
    """Equal coordinates below which a pair is passed over: 76 of 102 expected ones at 80 per cent."""
    p = percent / 100
    return max(0, math.floor(T * p - SPREAD * math.sqrt(T * p * (1 - p))))


def shingle_sets(texts: list[bytes | None], k: int, hashes: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    split = [x.lower().split() if x else [] for x in texts]
    sizes = [len(x) for x in split]
    words = hashes.array([w for x in split for w in x])
    grams = gram_hashes(words, k)
    out, at = [], 0
    for n in sizes:
        if n >= k:
            out.append(np.unique(grams[at : at + n - k + 1]))
        else:
            out.append(gram_hashes(words[at : at + n], n) if n else np.empty(0, np.uint64))
        at += n
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), T) coordinates; sets must not be empty."""
    d = len(sets)
    out = np.full(d * T, np.uint64(2**64 - 1), np.uint64)
    rows, i = np.arange(d), 0
    while len(rows) and i < 2 * T:
        sizes = np.array([len(sets[r]) for r in rows], np.int64)
        flat = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(rows, sizes) * T
        # A round is tagged in the top byte, so values of earlier rounds win and bins filled before stay.
        for _ in range(max(1, min(T, (SLICE * 64) // len(flat)))):
            mixed = mix64(flat + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1))
            bins = (mixed & np.uint64(T - 1)).astype(np.int64) if i < T else i - T
            np.minimum.at(out, owner + bins, (np.uint64(min(i, 254)) << np.uint64(56)) | (mixed >> np.uint64(8)))
            i += 1
            if i >= 2 * T:
                break
        full = (out.reshape(d, T)[rows] != np.uint64(2**64 - 1)).all(axis=1)
        rows = rows[~full]
    return out.reshape(d, T)


def band_keys(coordinates: np.ndarray, rows: int = 4) -> np.ndarray:
    """(documents, T / rows) signed 64-bit keys; the band's number is part of the key."""
    bands = T // rows
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(coordinates), bands)).copy()
    for r in range(rows):
        total = mix64(total + coordinates[:, r::rows])
    return total.view(np.int64)


SKETCHED = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, codes binary"


def _sketcher(k: int, rows: int):
    """Texts -> SKETCHED; codes are what a node is screened by: a byte of each coordinate, and four of each band's key."""
    bands = T // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            texts = byte_list(batch.column(1))
            for at in range(0, len(texts), SLICE):
                sets = shingle_sets(texts[at : at + SLICE], k, hashes)
                some = [i for i, s in enumerate(sets) if len(s)]
                coordinates = sketch([sets[i] for i in some]) if some else np.empty((0, T), np.uint64)
                keys = band_keys(coordinates, rows)
                codes = np.zeros((len(sets), T + 4 * bands), np.uint8)
                codes[some, :T] = coordinates.astype(np.uint8)
                codes[some, T:] = keys.astype(np.uint32).view(np.uint8).reshape(-1, 4 * bands)
                digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                lengths = np.zeros(len(sets), np.int32)
                lengths[some] = bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, SLICE).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests[:, 0]),
                        pa.array(digests[:, 1]),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), keys.ravel()),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "codes"],
                )

    return run


def _verifier(k: int, percent: int):
    """Rows (u, v, text of u, text of v) -> linked pairs; the set of a repeated u is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, held = WordHashes(), None, None
        for batch in batches:
            us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            tu, tv = byte_list(batch.column(2)), byte_list(batch.column(3))
            linked = []
            for at in range(0, len(us), CHUNK):
                sets = shingle_sets(tv[at : at + CHUNK], k, hashes)
                for i, b in enumerate(sets, at):
                    if (us[i], tu[i]) != last:
                        last, held = (us[i], tu[i]), shingle_sets([tu[i]], k, hashes)[0]
                    small, big = (held, b) if len(held) <= len(b) else (b, held)
                    if not len(small):
                        linked.append(False)
                        continue
                    place = np.searchsorted(big, small)
                    both = int((big[np.minimum(place, len(big) - 1)] == small).sum())
                    linked.append(100 * both >= percent * (len(small) + len(big) - both))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    left, right = texts.toDF("u", "tu"), texts.toDF("v", "tv")
    rows = pairs.join(right, "v").join(left, "u").select("u", "v", "tu", "tv").sortWithinPartitions("u")
    return rows.mapInArrow(trimmed(_verifier(k, percent)), "u long, v long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches; a run that goes on in the next batch is kept together."""
    rest: list[pa.Table] = []
    for batch in batches:
        part = pa.Table.from_batches([batch])
        named = [part[k].to_numpy() for k in keys]
        edges = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in named])) + 1
        bounds = [0, *edges.tolist(), part.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            run = part.slice(a, b - a)
            if a == 0 and rest and any(rest[-1][k][0].as_py() != run[k][0].as_py() for k in keys):
                yield pa.concat_tables(rest)
                rest = []
            elif a > 0:
                yield pa.concat_tables(rest)
                rest = []
            if run.num_rows:
                rest.append(run)
    if rest:
        yield pa.concat_tables(rest)


class _Screen:
    """Which nodes of a group are to be compared by their sets in this group.

    A pair is, if its components differ, its sizes allow the similarity, its codes do not rule it out, and this
    is the first band, or the rarest shingle of their prefixes, that both share, so that each pair is compared once.
    """

    def __init__(self, group: pa.Table, percent: int):
        column = lambda name: group[name].to_numpy()
        self.nodes, self.sizes, self.components = column("node"), column("n"), column("component")
        codes = np.frombuffer(b"".join(group["codes"].to_pylist()), np.uint8).reshape(group.num_rows, -1)
        self.codes, self.keys = np.ascontiguousarray(codes[:, :T]), np.ascontiguousarray(codes[:, T:]).view(np.uint32)
        self.cells, self.band, self.key = column("cell"), int(group["b"][0].as_py()), group["band"][0].as_py()
        self.prefixes = group["prefix"].combine_chunks()
        self.within = group["x"][0].as_py() == group["y"][0].as_py()
        self.percent, self.least = percent, least_equal(percent)
        names, place, counts = np.unique(self.components, return_inverse=True, return_counts=True)
        self.main = place == counts.argmax()
        #: Rows to start from: each pair of different components has one outside the largest.
        self.starts = np.flatnonzero(~self.main).tolist()

    def partners(self, i: int) -> np.ndarray:
        """Rows that row ``i`` of ``starts`` is compared with: those of the largest component, and other later ones."""
        low, high = np.minimum(self.sizes, self.sizes[i]), np.maximum(self.sizes, self.sizes[i])
        fit = (self.components != self.components[i]) & (100 * low >= self.percent * high) & (self.nodes != self.nodes[i])
        fit[:i] &= self.main[:i]
        if not self.within:
            fit &= self.cells != self.cells[i]
        at = np.flatnonzero(fit)
        at = at[(self.codes[at] == self.codes[i]).sum(axis=1) >= self.least] if len(at) else at
        if self.band < 0:
            return at[[self.first(i, j) for j in at.tolist()]] if len(at) else at
        if len(at) and self.band:
            at = at[~(self.keys[at, : self.band] == self.keys[i, : self.band]).any(axis=1)]
        return at

    def first(self, i: int, j: int) -> bool:
        """Whether the group's shingle is the first that both prefixes hold; both have the same order."""
        own = self.prefixes[i].values.to_numpy()
        both = own[np.isin(own, self.prefixes[j].values.to_numpy())]
        return both[0] == self.key


GROUP = ["band", "x", "y"]


def _screener(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, GROUP):
            screen, needed = _Screen(group, percent), np.zeros(group.num_rows, bool)
            for i in screen.starts:
                at = screen.partners(i)
                needed[at] = True
                needed[i] |= len(at) > 0
            if needed.any():
                yield from group.filter(pa.array(needed)).to_batches()

    return run


def _comparer(k: int, percent: int):
    """Groups with texts -> links; each set is looked up once against all its partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for group in _groups(batches, GROUP):
            screen = _Screen(group, percent)
            sets = shingle_sets(byte_list(group["text"]), k, hashes)
            known, flat = np.unique(np.concatenate(sets), return_inverse=True)
            sizes = np.array(list(map(len, sets)))
            starts = np.cumsum(sizes) - sizes
            mark, us, vs = np.zeros(len(known), bool), [], []
            for i in screen.starts:
                at = screen.partners(i)
                if not len(at):
                    continue
                own = flat[starts[i] : starts[i] + sizes[i]]
                mark[own] = True
                both = np.array([int(mark[flat[starts[j] : starts[j] + sizes[j]]].sum()) for j in at])
                mark[own] = False
                linked = at[100 * both >= percent * (sizes[i] + sizes[at] - both)]
                us += [screen.nodes[i]] * len(linked)
                vs += screen.nodes[linked].tolist()
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _shingler(k: int):
    """Nodes with texts -> (node, shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                nodes = batch.column(0).slice(at, SLICE).to_numpy()
                sets = shingle_sets(byte_list(batch.column(1).slice(at, SLICE)), k, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, [len(x) for x in sets])), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "h"])

    return run


def _by_prefix(nodes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Groups (band: a shingle, b: -1) of the nodes (node, n, component) that share one of their rarest shingles, where components differ."""
    shingles = shared_table(texts.toDF("node", "text").join(nodes.select("node"), "node").mapInArrow(trimmed(_shingler(k)), "node long, h long"))
    # Only shingles that several nodes have are looked up; the others come first in their node's order and meet nothing.
    counts = shared_table(shingles.groupBy("h").agg(F.count("*").alias("times")).where("times > 1"))
    ordered = shingles.join(counts, "h", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "h"))).alias("all"))
    length = (F.size("all") - F.ceil(F.size("all") * percent / 100) + 1).cast("int")
    rare = F.transform(F.filter(F.slice("all", F.lit(1), length), lambda x: x["times"] > 1), lambda x: x["h"])
    dealt = shared_table(nodes.join(ordered.select("node", rare.alias("prefix")), "node").select("node", "n", "component", "prefix", F.explode("prefix").alias("band")))
    mixed = dealt.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band")
    return dealt.join(shared_table(mixed), "band").withColumn("b", F.lit(-1))


def _pairs(groups: DataFrame) -> float:
    """Pairs of different components that stand together."""
    parts = groups.groupBy("band", "component").agg(F.count("*").cast("double").alias("c"))
    sums = parts.groupBy("band").agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("inner"))
    return sums.agg(F.sum((F.col("size") * F.col("size") - F.col("inner")) / 2)).first()[0] or 0.0


def _in_cells(groups: DataFrame) -> DataFrame:
    """``groups`` with the cells that their band takes."""
    sizes = groups.groupBy("band").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int").alias("cells"))
    return groups.join(shared_table(sizes), "band")


def _cross_links(live: DataFrame, codes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components of a bucket, without emitting pairs.

    Nodes of a bucket stand together in groups of bounded size; only those with a partner that their codes leave
    possible fetch their texts, and only linked pairs are returned.
    """
    columns = "band", "b", "node", "n", "component", "prefix", "cells"
    sized = shared_table(_in_cells(live.withColumn("prefix", F.lit(None).cast("array<long>"))).select(*columns))
    cut = sized.where("cells = 1")
    large = sized.where("cells > 1")
    if large.take(1):
        nodes, pairs = shared_table(large.select("node", "n", "component").distinct()), _pairs(large)
        if pairs > FEW * nodes.count():
            rare = shared_table(_in_cells(_by_prefix(nodes, texts, k, percent)).select(*columns))
            large = rare if _pairs(rare) < pairs else large
        cut = cut.unionByName(large)
    cut = cut.withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    grid = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda o: F.struct(F.least("cell", o).alias("x"), F.greatest("cell", o).alias("y")))
    coded = cut.join(codes, "node").select("band", "b", "node", "n", "component", "cell", "codes", "prefix", F.inline(grid))
    schema = "band long, b int, node long, n long, component long, cell int, codes binary, prefix array<long>, x int, y int"
    dealt = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP, "node")
    needed = shared_table(dealt(coded).mapInArrow(trimmed(_screener(percent)), schema))
    return dealt(needed.join(texts.toDF("node", "text"), "node")).mapInArrow(trimmed(_comparer(k, percent)), "u long, v long")


def near_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs``; linked from ``percent`` per cent of similarity."""
    limit_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = shared_table(plain.mapInArrow(trimmed(_sketcher(k, band_rows(percent))), SKETCHED))
    nodes = shared_table(
        sketched.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node")).where("node is not null")
    )
    banded = (
        sketched.where("n_shingles > 0")
        .join(nodes.select(F.col("node").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"])
        .select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("b", "band"))
    )
    shared = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", F.col("low").alias("pivot"))
    rows = shared_table(banded.join(shared_table(shared), "band"))
    texts = shared_table(plain.join(rows.select(F.col("node").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text"))

    def fits(a: str, b: str):
        return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")

    sizes = rows.select(F.col("node").alias("u"), F.col("n").alias("nu")).distinct()

    def with_pivot(found: DataFrame) -> DataFrame:
        pairs = found.where("pivot <> node").select("pivot", "node", "n").distinct()
        pairs = pairs.join(sizes.withColumnRenamed("u", "pivot"), "pivot").where(fits("n", "nu"))
        return pairs.select(F.col("pivot").alias("u"), F.col("node").alias("v"))

    every = rows.select("node").distinct()
    found = components(shared_table(_verified(with_pivot(rows), texts, k, percent)))
    labels = shared_table(every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    budget, before = REST * nodes.count(), None
    for turn in range(PIVOT_ROUNDS + 1):
        named = rows.drop("pivot").join(labels, "node")
        parts = named.groupBy("band", "component").agg(F.count("*").alias("c"))
        mixed = shared_table(
            parts.groupBy("band")
            .agg(F.count("*").alias("parts"), F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("inner"))
            .where("parts > 1")
            .select("band", "size", ((F.col("size") * F.col("size") - F.col("inner")) / 2).alias("rest"))
        )
        rest = mixed.agg(F.sum("rest")).first()[0]
        if not rest:
            break
        live = shared_table(named.join(mixed.select("band", "size"), "band"))
        last = turn == PIVOT_ROUNDS or rest <= budget or (before is not None and rest > SHRINKS * before)
        before = rest
        if last:
            codes = sketched.join(nodes.select(F.col("node").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"]).select(F.col("doc_id").alias("node"), "codes")
            new = _cross_links(live, codes, texts, k, percent)
        else:
            # The next pivot of a bucket is another at random; nodes of other components meet it.
            pivots = live.groupBy("band").agg(F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn))).alias("p"))
            other = shared_table(pivots.select("band", F.col("p.node").alias("pivot"), F.col("p.component").alias("own")))
            new = _verified(with_pivot(live.join(other, "band").where("component <> own")), texts, k, percent)
        ends = labels.toDF("u", "cu"), labels.toDF("v", "cv")
        joined = shared_table(new.join(ends[0], "u").join(ends[1], "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")).where("u <> v").distinct())
        if joined.take(1):
            merged = shared_table(components(joined).toDF("component", "merged"))
            labels = shared_table(labels.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component")))
        if last:
            break
    named = shared_table(nodes.join(labels, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id")))
    return sketched.join(named, ["d1", "d2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each component, with its columns."""
    keep = near_components(docs, k, percent).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["_keep"]), "left_semi")
