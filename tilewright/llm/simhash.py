"""Near-duplicate components by SimHash fingerprints and pigeonhole blocks (operator 12)."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.components import components
from tilewright.llm.textops import LOWER, as_int64, byte_slices, id_and_text, ready, words
from tilewright.session import cut_lineage, shared_dir

SHINGLE_WORDS = 4
DISTANCE = 4
SEED = 42
UNIT = 8192  # fingerprints of a bucket that one task compares at once
COUNTED = 1 << 16  # shingles whose bits are counted at once

_LOWER = np.frombuffer(LOWER, np.uint8)
# fixed values: the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _lane(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _turn(acc + value * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte spans of one buffer at once: each step runs over all spans that still have bytes for it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,)).copy()  # the eight bytes from each place on
    with np.errstate(over="ignore"):
        first = np.uint64(seed)
        acc = np.full(len(starts), first + _P5, np.uint64)
        at = starts.astype(np.int64)
        end = at + sizes
        long = np.flatnonzero(sizes >= 32)
        if len(long):
            lanes = [np.full(len(long), v, np.uint64) for v in (first + _P1 + _P2, first + _P2, first, first - _P1)]
            place, todo = at[long], np.arange(len(long))
            while len(todo):
                for i in range(4):
                    lanes[i][todo] = _lane(lanes[i][todo], eight[place[todo] + 8 * i])
                place[todo] += 32
                todo = todo[place[todo] + 32 <= end[long[todo]]]
            joined = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for lane in lanes:
                joined = (joined ^ _lane(np.zeros(len(long), np.uint64), lane)) * _P1 + _P4
            acc[long], at[long] = joined, place
        acc += sizes.astype(np.uint64)
        todo = np.flatnonzero(at + 8 <= end)
        while len(todo):
            acc[todo] = _turn(acc[todo] ^ _lane(np.zeros(len(todo), np.uint64), eight[at[todo]]), 27) * _P1 + _P4
            at[todo] += 8
            todo = todo[at[todo] + 8 <= end[todo]]
        todo = np.flatnonzero(at + 4 <= end)
        acc[todo] = _turn(acc[todo] ^ ((eight[at[todo]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        at[todo] += 4
        todo = np.flatnonzero(at < end)
        while len(todo):
            acc[todo] = _turn(acc[todo] ^ ((eight[at[todo]] & np.uint64(0xFF)) * _P5), 11) * _P1
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        acc ^= acc >> np.uint64(33)
        acc *= _P2
        acc ^= acc >> np.uint64(29)
        acc *= _P3
        acc ^= acc >> np.uint64(32)
    return acc


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every n-word shingle of each text, repeats included, and the first shingle of each text.

    Words are joined by one space; a text of fewer words has one shingle, all of them.
    """
    found = words(data, offsets)
    size = found.ends - found.starts
    put = np.cumsum(size + 1) - (size + 1)  # place of each word in the joined text
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(put, size) + at] = _LOWER[data[np.repeat(found.starts, size) + at]]
    each = np.where(found.counts > 0, np.maximum(found.counts - n + 1, 1), 0)
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(each, out=first[1:])
    begin = np.repeat(found.first[:-1] - first[:-1], each) + np.arange(first[-1])
    last = np.minimum(begin + n, np.repeat(found.first[1:], each)) - 1
    return xxh64(joined, put[begin], put[last] + size[last] - put[begin]), first


def fingerprints_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits for each text: those set in over half of its shingles' hashes; zero without shingles."""
    texts = len(first) - 1
    owner = np.repeat(np.arange(texts), np.diff(first))
    counts = np.zeros((texts, 64), np.int64)
    for lo in range(0, len(hashes), COUNTED):
        part, whose = hashes[lo : lo + COUNTED], owner[lo : lo + COUNTED]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        new = np.flatnonzero(np.diff(whose, prepend=-1))
        counts[whose[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
    over = (2 * counts > np.diff(first)[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").reshape(-1).view("<u8")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp bigint) for every row: the SimHash of its whole text."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(1)):
                prints = fingerprints_of(*shingle_hashes(data, offsets)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(prints)], [key, "fp"])

    return id_and_text(docs, key, text).mapInArrow(run, f"`{key}` bigint, fp bigint")


def block_masks(n: int, distance: int = DISTANCE, unit: int = UNIT) -> list[int]:
    """Masks such that two fingerprints within `distance` agree under at least one of them.

    The 64 bits are cut into b blocks; at most `distance` of them differ, so some b - distance
    agree. b is the least number for which n evenly spread fingerprints make buckets of at
    most `unit` on average; any b finds every pair, more blocks only make smaller buckets.
    """
    b = distance + 1
    while b < 16 and n >> (64 * (b - distance) // b) > unit:
        b += 1
    edges = [64 * i // b for i in range(b + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(block[i] for i in chosen) for chosen in itertools.combinations(range(b), b - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _least(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component numbers after the links (a, b): the least place in each component."""
    while True:
        x, y = comp[a], comp[b]
        if (x == y).all():
            return comp
        low = np.minimum(x, y)
        np.minimum.at(comp, x, low)
        np.minimum.at(comp, y, low)
        while True:  # labels to the labels of their labels
            next_ = comp[comp]
            if (next_ == comp).all():
                break
            comp = next_


def links_of_groups(group: np.ndarray, prints: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (places a, b) within equal neighbouring `group` values; a pair that is joined by now is passed over.

    Each step compares every place with the one d behind it, for all groups at once.
    """
    cuts = np.flatnonzero(np.diff(group)) + 1
    bounds = np.concatenate([[0], cuts, [len(group)]])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(group)) - 1
    comp, active, out = np.arange(len(group)), np.arange(len(group)), []
    for d in range(1, int(left.max(initial=0)) + 1):
        active = active[left[active] >= d]
        far = np.bitwise_count(prints[active] ^ prints[active + d])
        near = active[far <= distance]
        near = near[comp[near] != comp[near + d]]
        if len(near):
            out.append((near, near + d))
            comp = _least(comp, near, near + d)
        if d & (d - 1) == 0 and d > 4:  # now and then, groups that have become one component are done
            mixed = np.maximum.reduceat(comp, bounds[:-1]) != np.minimum.reduceat(comp, bounds[:-1])
            active = active[np.repeat(mixed, np.diff(bounds))[active]]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _streamed(batches, keys: int, compare):
    """Calls compare(columns) on the rows of whole groups of sorted batches; a group at a batch's end waits for the next batch."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [as_int64(batch.column(c)) for c in range(batch.num_columns)]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        if not len(columns[0]):
            continue
        new = np.zeros(len(columns[0]), bool)
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield compare([c[:cut] for c in columns], np.cumsum(new[:cut]))
        held = [c[cut:] for c in columns]
    if held is not None:
        yield compare(held, np.zeros(len(held[0]), np.int64))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def links_inside(rows: DataFrame, distance: int) -> DataFrame:
    """Links between fingerprints of a bucket of at most UNIT rows: rows (t, h, fp)."""

    def compare(columns, group):
        a, b = links_of_groups(group, columns[2].view(np.uint64), distance)
        return _edges(columns[2][a], columns[2][b])

    dealt = rows.repartition("t", "h").sortWithinPartitions("t", "h", "fp")
    return dealt.mapInArrow(lambda batches: _streamed(batches, 2, compare), "a bigint, b bigint")


def links_across(rows: DataFrame, distance: int) -> DataFrame:
    """Links of a bucket's outsiders: rows (t, h, i, j, left, fp, comp) of units of a block of outsiders and a block of members."""

    def compare(columns, group):
        left, prints, comp = columns[4] > 0, columns[5], columns[6].copy()
        a, b = [], []
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], len(group)]):
            own, other = np.arange(lo, hi)[left[lo:hi]], np.arange(lo, hi)[~left[lo:hi]]
            for x in own:
                near = other[(np.bitwise_count((prints[other] ^ prints[x]).view(np.uint64)) <= distance) & (comp[other] != comp[x])]
                _, once = np.unique(comp[near], return_index=True)
                for y in near[once]:
                    a.append(prints[x])
                    b.append(prints[y])
                    part = comp[lo:hi]
                    part[part == comp[y]] = comp[x]
        return _edges(np.array(a, np.int64), np.array(b, np.int64))

    dealt = rows.repartition("t", "h", "i", "j").sortWithinPartitions("t", "h", "i", "j")
    return dealt.mapInArrow(lambda batches: _streamed(batches, 4, compare), "a bigint, b bigint")


def links(nodes: DataFrame, distance: int = DISTANCE, unit: int = UNIT) -> DataFrame:
    """Edges (a, b) within `distance` whose components are those of all such pairs; `nodes` are distinct (fp, n).

    A fingerprint joins one bucket for each mask. A bucket of at most `unit` fingerprints is
    compared in one task, and only joining links come out. Of a larger one, its most frequent
    fingerprint is compared with all others first (a column expression); then only those
    outside the component that holds most of the bucket are compared with the rest, in units
    of a block of outsiders and a block of members, so work and copies grow with the
    outsiders. No bucket, pair or fingerprint is capped.
    """
    spark = ready(nodes.sparkSession)
    masks = block_masks(nodes.count(), distance, unit)
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("h")) for t, m in enumerate(masks)]))
    rows = nodes.select("fp", "n", keys.alias("_k")).select("_k.t", "_k.h", "fp", "n")
    large = cut_lineage(rows.groupBy("t", "h").agg(F.count("*").alias("m")).filter(F.col("m") > unit))
    usual = links_inside(rows.join(large, ["t", "h"], "left_anti").select("t", "h", "fp"), distance)
    if large.isEmpty():
        return usual

    crowded = cut_lineage(rows.join(large, ["t", "h"]))
    leaders = crowded.groupBy("t", "h").agg(F.max_by("fp", F.struct("n", "fp")).alias("leader"))
    led = crowded.join(leaders, ["t", "h"]).filter((F.bit_count(F.col("fp").bitwiseXOR(F.col("leader"))) <= distance) & (F.col("fp") != F.col("leader")))
    starts = cut_lineage(led.select(F.col("fp").alias("a"), F.col("leader").alias("b")).union(usual).distinct())
    placed = cut_lineage(crowded.join(components(starts), crowded.fp == F.col("node"), "left").select("t", "h", "m", "fp", F.coalesce("root", "fp").alias("comp")))
    shares = placed.groupBy("t", "h", "comp").agg(F.count("*").alias("c"))
    main = shares.groupBy("t", "h").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), (F.sum("c") - F.max("c")).alias("out")).filter("out > 0")
    members = placed.join(main, ["t", "h"]).withColumn("outside", F.col("comp") != F.col("main"))
    block = lambda size: F.pmod(F.xxhash64("fp"), F.ceil(F.col(size) / unit))
    all_of = lambda size: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(size) / unit).cast("bigint") - 1))
    side = lambda left: (F.lit(left).alias("left"), "fp", "comp")
    own = members.filter("outside").withColumn("j", all_of("m")).select("t", "h", block("out").alias("i"), "j", *side(1))
    other = members.withColumn("i", all_of("out")).select("t", "h", "i", block("m").alias("j"), *side(0))
    return starts.union(links_across(own.unionByName(other), distance))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """Component of every document: key, fp bigint, component_id (its smallest key).

    Texts whose fingerprints differ in at most `distance` bits are linked; components are
    those of all links. Equal fingerprints are one node from the start, so copies are never
    paired.

    One row per input row. Null, empty and white texts have fingerprint zero and are linked
    like any other; repeated rows and keys share the component of their text; null keys are
    kept and never the smallest (a component of null keys has component_id null); an empty
    table gives none; other columns are not read.
    """
    spark = ready(docs.sparkSession)
    folder = shared_dir(spark, "simhash")
    fingerprints(docs, key, text).withColumnRenamed(key, "_id").write.parquet(f"{folder}/prints")
    drawn = spark.read.parquet(f"{folder}/prints")
    nodes = cut_lineage(drawn.groupBy("fp").agg(F.count("*").alias("n"), F.min("_id").alias("least")))
    found = components(links(nodes.select("fp", "n"), distance))
    placed = nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = placed.join(least, "root").select("fp", "component_id")
    return drawn.join(of_print, "fp").select(F.col("_id").alias(key), "fp", "component_id")


def hex_print(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of a fingerprint."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
