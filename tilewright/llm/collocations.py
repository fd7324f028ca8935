"""Collocated phrases by direct-address tiles of frequency-ranked ids (operator 13)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm import blocks
from tilewright.llm.textops import BASE, LOWER, SpanHash, byte_slices, mix, ready, words
from tilewright.operators.ordered import top_per_group
from tilewright.session import cut_lineage, shared_dir

LEAST = 10  # occurrences of a candidate
TOP = 2000  # phrases of a language
SHARE = 50  # per cent of a phrase's occurrences that lie in one longer phrase, from which on it is dropped
SCALE = 1_000_000
RANKED = 1 << 20  # units (words or pairs) with a frequency rank in the tasks; the others go by their hash
SIDE = 256  # ids of a tile's side
DENSE = 4096  # ids below it can lie in a dense tile
FULL = SIDE * SIDE // 16  # occurrences in the buffer that make a tile dense
BUFFER = 1 << 21  # occurrences that wait for counting
FILTER_BITS = (1 << 20, 1 << 27)  # least and most bits of the filter of unranked units
UNKNOWN = "und"
_LANG = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))
_LOWER = np.frombuffer(LOWER, np.uint8)

_BREAK = np.zeros(256, bool)  # bytes that end a piece
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()  # bytes that end a word
_OUTSIDE[[0x20, 0x09]] = True


@dataclass
class Tokens:
    """Words of a slice: 64-bit keys of (language, word), spans, text numbers, and whether the next word continues the piece."""

    data: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    goes_on: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> Tokens:
    """`lang` is a 64-bit key for each text."""
    data = _LOWER[data]
    found = words(data, offsets, _OUTSIDE)
    keys = SpanHash(data)(found.starts, found.ends)
    text = found.text
    keys = mix(keys ^ lang[text])
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_BREAK[data], out=breaks[1:])
    before = breaks[found.starts]
    goes_on = np.zeros(len(keys), bool)
    goes_on[:-1] = (before[1:] == before[:-1]) & (text[1:] == text[:-1])
    return Tokens(data, keys, found.starts, found.ends, text, goes_on)


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit key of two units side by side."""
    return mix(left * BASE + mix(right + _LANG))


def _languages(column) -> tuple[np.ndarray, list[str]]:
    """A 64-bit key for each row, and the names."""
    coded = pc.fill_null(column.cast(pa.string()), UNKNOWN).dictionary_encode()
    names = coded.dictionary.to_pylist()
    data = np.frombuffer("".join(names).encode(), np.uint8)
    ends = np.cumsum([len(n.encode()) for n in names], dtype=np.int64)
    keys = SpanHash(data)(np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) * _LANG if len(names) else np.zeros(0, np.uint64)
    at = coded.indices.to_numpy()
    return keys[at], [names[i] for i in at]


def _slices(batches):
    for batch in batches:
        keys, names = _languages(batch.column(0))
        for a, b, data, offsets in byte_slices(batch.column(1)):
            yield tokens(data, offsets, keys[a:b]), names[a:b]


def _compact(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted COO: distinct sorted keys with their summed counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts[order], new) if len(keys) else counts


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, lang, word, n) of every word of every language; added up per slice and per task before the shuffle."""

    def run(batches):
        for own, names in _slices(batches):
            keys, first, n = np.unique(own.keys, return_index=True, return_counts=True)
            size = own.ends[first] - own.starts[first]
            ends = np.zeros(len(size) + 1, np.int64)
            np.cumsum(size, out=ends[1:])
            data = own.data[np.repeat(own.starts[first] - ends[:-1], size) + np.arange(ends[-1])]
            spelt = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
            lang = pa.array([names[t] for t in own.text[first]], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), lang, spelt, pa.array(n)], ["key", "lang", "word", "n"])

    counted = docs.mapInArrow(run, "key bigint, lang string, word string, n bigint")
    return counted.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """What tasks know of the frequent units: the keys of at most RANKED ranked ones, and a filter over the others."""

    keys: np.ndarray  # sorted
    rank: np.ndarray  # the places of `keys` by falling frequency
    by_rank: np.ndarray  # keys by falling frequency
    bits: np.ndarray | None

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or -1, may be frequent) of each key; False is certain."""
        rank = np.full(len(keys), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            own = self.keys[at] == keys
            rank[own] = self.rank[at[own]]
        known = rank >= 0
        if self.bits is not None:
            rest = np.flatnonzero(~known)
            ok = np.ones(len(rest), bool)
            for seed in _SEEDS:
                place = mix(keys[rest] ^ seed) % np.uint64(len(self.bits) * 8)
                ok &= (self.bits[place >> np.uint64(3)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1 == 1
            known[rest] = ok
        return rank, known


def _filter(keys: DataFrame, n: int) -> np.ndarray:
    """Packed bits of a Bloom filter of about 16 bits a key, up to its largest size."""
    least, most = FILTER_BITS
    size = least
    while size < most and size < 16 * n:
        size *= 2

    def run(batches):
        bits = np.zeros(size, bool)
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for seed in _SEEDS:
                bits[mix(own ^ seed) % np.uint64(size)] = True
        yield from blocks.emit(np.packbits(bits).reshape(-1, 64))

    return blocks.add_up(keys.select("key").mapInArrow(run, blocks.SCHEMA), (size // 512, 64), "uint8", np.bitwise_or).ravel()


def rank_units(units: DataFrame, ranked: int) -> Units:
    """Ranks of the most frequent `units` (key, n); those beyond go into a filter.

    The least count of a ranked unit comes from a histogram with eight steps to an octave, so
    what reaches the driver is at most `ranked` numbers and keys, whatever the vocabulary.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    histogram = sorted((r["s"], r["c"]) for r in units.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect())
    total, least = sum(c for _, c in histogram), None
    held = 0
    for s, c in reversed(histogram):
        if held + c > ranked:
            break
        held, least = held + c, s
    if held:
        top = units.filter(step >= least).select("key", "n").toArrow()
        key, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    else:
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    by_rank = key[np.lexsort((key, -n))]
    order = np.argsort(by_rank)
    rest = units if not held else units.filter(step < least)
    return Units(by_rank[order], order, by_rank, None if held == total else _filter(rest, total - held))


class PairTiles:
    """Counts of pairs of ranked units in a task.

    The square of ranks is cut into tiles. Of the occurrences in the buffer, those in
    well-filled tiles near the origin are counted by address (bincount into an array of the
    tile, kept for the whole task), the others as sorted COO.
    """

    def __init__(self) -> None:
        self.side = DENSE // SIDE
        self.slot = np.full(self.side * self.side, -1, np.int64)  # place of each dense tile
        self.tiles: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.waiting.append((left << 32) | right)
        self.held += len(left)
        if self.held >= BUFFER:
            self.count()

    def count(self) -> None:
        codes = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.int64)
        self.waiting, self.held = [], 0
        left, right = codes >> 32, codes & 0xFFFFFFFF
        near = (left < DENSE) & (right < DENSE)
        tile = np.where(near, (left // SIDE) * self.side + right // SIDE, 0)
        filled = np.bincount(tile[near], minlength=len(self.slot))
        for t in np.flatnonzero((filled >= FULL) & (self.slot < 0)):
            self.slot[t] = len(self.tiles)
            self.tiles.append(np.zeros(SIDE * SIDE, np.int64))
        dense = near & (self.slot[tile] >= 0)
        if dense.any():
            cell = (left[dense] % SIDE) * SIDE + right[dense] % SIDE
            found = np.bincount(self.slot[tile[dense]] * SIDE * SIDE + cell, minlength=len(self.tiles) * SIDE * SIDE).reshape(-1, SIDE * SIDE)
            for kept, new in zip(self.tiles, found):
                kept += new
        sparse = codes[~dense]
        self.keys, self.counts = _compact(np.concatenate([self.keys, sparse]), np.concatenate([self.counts, np.ones(len(sparse), np.int64)]))

    def take(self, at_end: bool):
        """(left rank, right rank, count) arrays of what is counted: the COO part where it is large, all at the end."""
        if at_end:
            self.count()
            for t in np.flatnonzero(self.slot >= 0):
                cells = self.tiles[self.slot[t]]
                cell = np.flatnonzero(cells)
                yield (t // self.side) * SIDE + cell // SIDE, (t % self.side) * SIDE + cell % SIDE, cells[cell]
        if len(self.keys) and (at_end or len(self.keys) > 2 * BUFFER):
            yield self.keys >> 32, self.keys & 0xFFFFFFFF, self.counts
            self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _rows(left: np.ndarray, right: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    other = pa.nulls(len(left), pa.int64()) if right is None else pa.array(right)
    return pa.RecordBatch.from_arrays([pa.array(left), other, pa.array(n)], ["a", "b", "n"])


def count_pairs(docs: DataFrame, units: Units, width: int) -> DataFrame:
    """(key, left, right, n) of the unit pairs of `width` words that occur LEAST times or more.

    A unit is a word (width 2), or a frequent pair of words (width 3, where the two units of a
    phrase overlap in a word); both units must be frequent, as no phrase is more frequent than
    its parts. Pairs of ranked units go through the tiles as one number, others as two keys.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(units)

    def run(batches):
        known_units, tiles = shared.value, PairTiles()
        for own, _ in _slices(batches):
            if width == 2:
                keys, at_all = own.keys, own.goes_on[:-1]
            else:
                keys, at_all = pair_key(own.keys[:-1], own.keys[1:]), own.goes_on[:-2] & own.goes_on[1:-1]
                keys = np.where(own.goes_on[:-1], keys, np.uint64(0))
            rank, known = known_units.look_up(keys)
            at = np.flatnonzero(at_all & known[:-1] & known[1:])
            ranked = (rank[at] >= 0) & (rank[at + 1] >= 0)
            inside, rest = at[ranked], at[~ranked]
            tiles.add(rank[inside], rank[inside + 1])
            for left, right, n in tiles.take(False):
                yield _rows((left << 32) | right, None, n)
            if len(rest):
                both = np.stack([keys[rest], keys[rest + 1]], 1)
                distinct, n = np.unique(both, axis=0, return_counts=True)
                yield _rows(distinct[:, 0].copy().view(np.int64), distinct[:, 1].copy().view(np.int64), n)
        for left, right, n in tiles.take(True):
            yield _rows((left << 32) | right, None, n)

    def spell(batches):
        by_rank = shared.value.by_rank.view(np.int64)
        for batch in batches:
            a, n = batch.column(0).to_numpy(), batch.column(2)
            coded = np.asarray(batch.column(1).is_null().to_numpy(zero_copy_only=False), bool)
            right = pc.fill_null(batch.column(1), 0).to_numpy().copy()
            left = a.copy()
            left[coded] = by_rank[a[coded] >> 32]
            right[coded] = by_rank[a[coded] & 0xFFFFFFFF]
            key = pair_key(left.view(np.uint64), right.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(left), pa.array(right), n], ["key", "left", "right", "n"])

    counted = docs.mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
    return counted.mapInArrow(spell, "key bigint, left bigint, right bigint, n bigint")


def _saved(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.parquet(path)


def score(a: str, left: str, right: str) -> str:
    """SQL: floor(SCALE * a * a / (left * right)); exact while counts stay below 10^16."""
    wide = lambda c: f"cast({c} as decimal(16, 0))"
    return f"cast({wide(a)} * {wide(a)} * cast({SCALE} as decimal(7, 0)) div ({wide(left)} * {wide(right)}) as bigint)"


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, ranked: int = RANKED) -> DataFrame:
    """Best phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of its two parts at the cut with the lowest score
    (the first of equal ones), n the language's words. Phrases with LEAST occurrences are
    candidates; one whose words lie inside a longer candidate with SHARE per cent of its
    occurrences goes; the best `top` of a language by (score, a, phrase) stay.

    Three passes over the texts: words, then pairs of frequent words, then pairs of frequent
    pairs, which are ranked anew. Counts are added up in the tasks before they are shuffled by
    phrase, so no language or word is one task's work; nothing is sampled or capped. Words
    are told apart by 64-bit keys: of 10^8 different ones two share a key with probability
    3e-4.

    Null texts are empty, a null language is `und`; texts without phrases, repeated rows
    (each counts) and texts of any length are fine; an empty table gives none; other columns
    are not read.
    """
    spark = ready(docs.sparkSession)
    folder = shared_dir(spark, "collocations")
    rows = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    vocabulary = _saved(spark, word_counts(rows), f"{folder}/words")
    sizes = vocabulary.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = vocabulary.filter(F.col("n") >= LEAST)
    pairs = _saved(spark, count_pairs(rows, rank_units(frequent.select("key", "n"), ranked), 2), f"{folder}/pairs")
    triples = _saved(spark, count_pairs(rows, rank_units(pairs.select("key", "n"), ranked), 3), f"{folder}/triples")

    # parts of a pair are words, so each side of a join is one row for a key
    word = lambda name: frequent.select(F.col("key").alias(name), F.col("word").alias(f"{name}_w"), F.col("n").alias(f"{name}_n"))
    inside = triples.select(F.col("left").alias("key"), "n").union(triples.select(F.col("right").alias("key"), "n")).groupBy("key").agg(F.max("n").alias("longer"))
    spelt = pairs.join(word("left"), "left").join(frequent.select(F.col("key").alias("right"), "lang", F.col("word").alias("right_w"), F.col("n").alias("right_n")), "right")
    spelt = cut_lineage(spelt.select("key", "lang", "left_w", "right_w", "left_n", "right_n", "n"))
    two = (
        spelt.join(inside, "key", "left")
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("n")))
        .select("lang", F.concat_ws(" ", "left_w", "right_w").alias("phrase"), F.col("n").alias("a"), F.col("left_n").alias("l"), F.col("right_n").alias("r"))
        .withColumn("score", F.expr(score("a", "l", "r")))
    )
    first = spelt.select(F.col("key").alias("left"), F.col("left_w").alias("w1"), F.col("left_n").alias("n1"), F.col("n").alias("n12"))
    second = spelt.select(F.col("key").alias("right"), "lang", F.col("left_w").alias("w2"), F.col("right_w").alias("w3"), F.col("right_n").alias("n3"), F.col("n").alias("n23"))
    cuts = triples.join(first, "left").join(second, "right").withColumn("s1", F.expr(score("n", "n1", "n23"))).withColumn("s2", F.expr(score("n", "n12", "n3")))
    early = F.col("s1") <= F.col("s2")
    three = cuts.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        F.col("n").alias("a"),
        F.when(early, F.col("n1")).otherwise(F.col("n12")).alias("l"),
        F.when(early, F.col("n23")).otherwise(F.col("n3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_per_group(two.unionByName(three), ["lang"], order, top)
    placed = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return placed.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE = f"""
with d as (
  select coalesce(lang, '{UNKNOWN}') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), p as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as ws from d),
g1 as (select lang, w, count(*) as f from (select lang, unnest(ws) as w from p) q group by lang, w),
total as (select lang, sum(f)::bigint as n from g1 group by lang),
g2 as (select lang, ws[i] as x, ws[i + 1] as y, count(*) as f from (select lang, ws, unnest(range(1, len(ws))) as i from p) q group by all having count(*) >= {LEAST}),
g3 as (select lang, ws[i] as x, ws[i + 1] as y, ws[i + 2] as z, count(*) as f from (select lang, ws, unnest(range(1, len(ws) - 1)) as i from p) q group by all having count(*) >= {LEAST}),
longer as (select lang, x, y, max(f) as f from (select lang, x, y, f from g3 union all select lang, y, z, f from g3) q group by lang, x, y),
two as (
  select g.lang, g.x || ' ' || g.y as phrase, g.f as a, l.f as l, r.f as r, ({SCALE}::hugeint * g.f * g.f) // (l.f::hugeint * r.f) as score
  from g2 g join g1 l on l.lang = g.lang and l.w = g.x join g1 r on r.lang = g.lang and r.w = g.y
  left join longer o on o.lang = g.lang and o.x = g.x and o.y = g.y where o.f is null or 100 * o.f < {SHARE} * g.f
), cuts as (
  select g.lang, g.x || ' ' || g.y || ' ' || g.z as phrase, g.f as a, l1.f as l1, r1.f as r1, l2.f as l2, r2.f as r2,
         ({SCALE}::hugeint * g.f * g.f) // (l1.f::hugeint * r1.f) as s1, ({SCALE}::hugeint * g.f * g.f) // (l2.f::hugeint * r2.f) as s2
  from g3 g join g1 l1 on l1.lang = g.lang and l1.w = g.x join g2 r1 on r1.lang = g.lang and r1.x = g.y and r1.y = g.z
  join g2 l2 on l2.lang = g.lang and l2.x = g.x and l2.y = g.y join g1 r2 on r2.lang = g.lang and r2.w = g.z
), every as (
  select lang, phrase, a, l, r, score from two
  union all select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from cuts
), placed as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from every)
select lang, rank, phrase, a, l, r, n, score::bigint as score from placed join total using (lang) where rank <= {TOP}
"""
