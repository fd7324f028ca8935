"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment (operator 1)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.textops import BASE, SpanHash, byte_slices, id_and_text, mix, ngrams, ready, words

WHOLE_WORDS = 3  # items of at most so many words are found as exact copies only
MIN_SCORE = 0.5  # alignment score over the score of an exact whole copy
PASSAGE_WORDS = 13  # a verbatim passage of so many words is reported whatever its share of the item
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20  # benchmark text handled in one pass over the documents
PAIR_CELLS = 1 << 20  # cells of alignments, or words of stretches, handled together

#: words here are runs of letters and digits: ASCII ones, or any character beyond ASCII
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

HITS = "item_id bigint, score double, matched bigint, first_word bigint, last_word bigint"


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text) of lower-cased texts."""
    found = words(data, offsets, OUTSIDE)
    return SpanHash(data)(found.starts, found.ends), found.first


def item_grams(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every seed candidate of the items: their pairs of neighbouring words.

    Items of at most WHOLE_WORDS words have one candidate, all their words.
    """
    grams, at = ngrams(hashes, first, 2)
    long = np.diff(first)[np.searchsorted(first, at, "right") - 1] > WHOLE_WORDS
    grams, at = grams[long], at[long]
    for few in range(1, WHOLE_WORDS + 1):
        short = first[:-1][np.diff(first) == few]
        if len(short):
            more = np.concatenate([ngrams(hashes[s : s + few], np.array([0, few]), few)[0] for s in short])
            grams, at = np.concatenate([grams, more]), np.concatenate([at, short])
    return grams, at


def short_lengths(first: np.ndarray) -> tuple[int, ...]:
    """Lengths of the items that are sought whole."""
    return tuple(int(n) for n in np.unique(np.diff(first)) if 0 < n <= WHOLE_WORDS)


def breakable(length: np.ndarray) -> np.ndarray:
    """Pairs of neighbouring words of an item that a copy of MIN_SCORE can lack at most.

    A pair is kept if both words are matched, next to each other or around one other word of
    the document. Of the 2n points of an exact copy n may be lost. A word replaced or left out
    costs 3 and breaks two pairs (r of them in a row r + 1), one cut off at an end costs 2 and
    breaks one, two words put between a pair cost 2: never less than 1.5 points a pair.
    """
    return length * 2 // 3


@dataclass
class Lookup:
    """Sorted keys behind a bitmap: most absent keys cost one bit test."""

    keys: np.ndarray

    def __post_init__(self) -> None:
        self.keys = np.unique(self.keys)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.keys >> np.uint64(42)] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in `asked`, their key numbers) of the keys that are present."""
        at = np.flatnonzero(self.seen[asked >> np.uint64(42)])
        if not len(self.keys):
            return at[:0], at[:0]
        slot = np.minimum(np.searchsorted(self.keys, asked[at]), len(self.keys) - 1)
        good = self.keys[slot] == asked[at]
        return at[good], slot[good]


def word_pairs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word with the next one and with the one after that, as `ngrams` has them (borders are not heeded)."""
    return tuple(mix(hashes[: max(0, len(hashes) - gap)] * BASE + hashes[gap:] + np.uint64(2)) for gap in (1, 2))


def doc_grams(hashes: np.ndarray, first: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of what may be a seed: pairs of words at distance 1 or 2, and n-grams of the given lengths."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    found = []
    for gap, pairs in enumerate(word_pairs(hashes), 1):
        at = np.flatnonzero(left > gap)
        found.append((pairs[at], at))
    found += [ngrams(hashes, first, n) for n in lengths if n != 2]
    return np.concatenate([g for g, _ in found]), np.concatenate([a for _, a in found])


def choose_seeds(grams: np.ndarray, at: np.ndarray, first: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """Mask of the seeds: of each item its rarest pairs, one more than a copy of MIN_SCORE can lack.

    So each copy of MIN_SCORE has a seed, whatever the frequencies. The rarest pair in each
    passage of PASSAGE_WORDS words is a seed as well, so each verbatim passage has one. These are document
    frequencies over the whole corpus; ties go to the smaller hash. No pair is too frequent to
    be a seed, so a copy in a third of all documents keeps its seeds.
    """
    item = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((grams, frequency, item))
    begin = np.searchsorted(item[order], item[order], "left")
    out = np.zeros(len(grams), bool)
    out[order] = np.arange(len(order)) - begin <= breakable(np.diff(first)[item[order]])
    # pairs in order of place: those of one passage lie side by side
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = np.argsort(at, kind="stable")
    span = PASSAGE_WORDS - 1
    if len(place) >= span:
        windows = np.lib.stride_tricks.sliding_window_view(rank[place], span)
        inside = item[place][span - 1 :] == item[place][: len(place) - span + 1]
        out[order[windows.min(1)[inside]]] = True
    return out


def verbatim(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Words of the longest equal run of each row pair, rows as in `align`."""
    run, best = np.zeros(texts.shape, np.int32), np.zeros(len(texts), np.int32)
    for i in range(items.shape[1]):
        run[:, 1:] = run[:, :-1] + 1
        run[:, 0] = 1
        run *= texts == items[:, i : i + 1]
        best = np.maximum(best, run.max(1, initial=0))
    return best


def align(items: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment score of each row pair, its last column, and its first column.

    Rows are word hashes padded by 0 (items) and 1 (texts), which match nothing. All pairs
    are filled together, one item word at a time: a gap along the text is a running maximum.
    """
    pairs, width = texts.shape
    column = np.arange(width)
    score = np.zeros((pairs, width), np.int32)
    origin = np.broadcast_to(column, (pairs, width)).astype(np.int32)  # where the alignment began
    best, best_end, best_start = np.zeros(pairs, np.int32), np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    for i in range(items.shape[1]):
        step = np.where((texts == items[:, i : i + 1]), MATCH, MISMATCH).astype(np.int32)
        slant = np.zeros_like(score)
        slant[:, 1:] = score[:, :-1]
        slant_from = np.broadcast_to(column, (pairs, width)).astype(np.int32)
        slant_from[:, 1:] = np.where(score[:, :-1] > 0, origin[:, :-1], slant_from[:, 1:])
        open_, open_from = np.maximum(slant + step, 0), slant_from
        up = score + GAP
        better = up > open_
        open_, open_from = np.where(better, up, open_), np.where(better, origin, open_from)
        # open_[k] + GAP * (j - k), best over k <= j; the origin rides in the low bits
        lifted = (open_ - GAP * column).astype(np.int64) * (1 << 32) + (width - open_from)
        along = np.maximum.accumulate(lifted, 1)
        score = np.maximum((along >> 32) + GAP * column, 0).astype(np.int32)
        origin = (width - (along & 0xFFFFFFFF)).astype(np.int32)
        end = np.argmax(score, 1)
        top = score[np.arange(pairs), end]
        up = top > best
        best[up], best_end[up], best_start[up] = top[up], end[up], origin[np.arange(pairs), end][up]
    return best, best_end, best_start


class Matcher:
    """Seeds and words of one benchmark block, and the search of documents against them."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, grams: np.ndarray, at: np.ndarray) -> None:
        self.ids, self.hashes, self.first = ids, hashes, first
        order = np.argsort(grams, kind="stable")
        self.seed, self.at = grams[order], at[order]
        self.item = np.searchsorted(first, self.at, "right") - 1
        self.lookup = Lookup(self.seed)
        self.begin = np.searchsorted(self.seed, self.lookup.keys)
        self.many = np.diff(np.append(self.begin, len(self.seed)))
        self.lengths = short_lengths(first)
        # hashed (item, pair) of all items: a false hit only lets a stretch through to the alignment
        pairs, where = ngrams(hashes, first, 2)
        self.shift = np.uint64(64 - max(16, int(16 * len(pairs)).bit_length()))
        self.known = np.zeros(1 << (64 - int(self.shift)), bool)
        self.known[self._slot(pairs, np.searchsorted(first, where, "right") - 1)] = True

    def _slot(self, pairs: np.ndarray, item: np.ndarray) -> np.ndarray:
        return mix(pairs + item.astype(np.uint64) * BASE) >> self.shift

    def plausible(self, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Mask of the stretches with as many pairs of their item as every copy of MIN_SCORE keeps, or a passage of PASSAGE_WORDS has."""
        length = self.first[rows[:, 1] + 1] - self.first[rows[:, 1]]
        least = np.where(length > WHOLE_WORDS, length - 1 - breakable(length), 0)
        near, far = (np.append(p, np.zeros(len(hashes) - len(p), np.uint64)) for p in word_pairs(hashes))
        size = rows[:, 3] - rows[:, 2]
        ends = np.cumsum(size)
        count = np.zeros(len(rows), np.int64)
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - size[a] + PAIR_CELLS, "right")))
            begin = np.cumsum(size[a:b]) - size[a:b]
            at = np.arange(size[a:b].sum()) + np.repeat(rows[a:b, 2] - begin, size[a:b])
            item = np.repeat(rows[a:b, 1], size[a:b])
            hit = self.known[self._slot(near[at], item)]
            hit |= self.known[self._slot(far[at], item)]
            total = np.r_[0, np.cumsum(hit)]
            count[a:b] = total[begin + size[a:b]] - total[begin]
            a = b
        return count >= np.minimum(least, PASSAGE_WORDS - 1)

    def stretches(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (text, item, from word, to word): stretches of text around seeds that may belong together."""
        grams, where = doc_grams(hashes, first, self.lengths)
        found, slot = self.lookup.find(grams)
        found, slot = np.repeat(where[found], self.many[slot]), np.repeat(self.begin[slot], self.many[slot]) + (np.arange(self.many[slot].sum()) - np.repeat(np.cumsum(self.many[slot]) - self.many[slot], self.many[slot]))
        text, item = np.searchsorted(first, found, "right") - 1, self.item[slot]
        inside = self.at[slot] - self.first[item]
        length = self.first[item + 1] - self.first[item]
        # a copy of MIN_SCORE has at most as many words put in as the item has words
        low = np.maximum(found - inside - length, first[text])
        high = np.minimum(found - inside + 2 * length, first[text + 1])
        order = np.lexsort((low, item, text))
        text, item, low, high = text[order], item[order], low[order], high[order]
        # overlapping stretches of one item join, up to six lengths of the item so that tables stay narrow
        out: list[list[int]] = []
        for t, i, a, b, n in zip(text.tolist(), item.tolist(), low.tolist(), high.tolist(), length[order].tolist()):
            if out and out[-1][0] == t and out[-1][1] == i and (b <= out[-1][3] or (a <= out[-1][3] and b - out[-1][2] <= 6 * n)):
                out[-1][3] = max(b, out[-1][3])
            else:
                out.append([t, i, a, b])
        rows = np.array(out, np.int64).reshape(-1, 4)
        return rows[self.plausible(rows, hashes)]

    def search(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(text, item, score, matched length, first word, last word) of every stretch that reaches MIN_SCORE or holds a verbatim passage of PASSAGE_WORDS."""
        rows = self.stretches(hashes, first)
        sizes = self.first[rows[:, 1] + 1] - self.first[rows[:, 1]], rows[:, 3] - rows[:, 2]
        order = np.lexsort((sizes[1], sizes[0]))
        out, a = [], 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b - a + 1) * max(1, int(sizes[0][order[b]])) * int(sizes[1][order[a : b + 1]].max()) <= PAIR_CELLS and b - a < 2048:
                b += 1
            part, a = rows[order[a:b]], b
            tall, wide = int(np.max(self.first[part[:, 1] + 1] - self.first[part[:, 1]])), int((part[:, 3] - part[:, 2]).max())
            items, texts = np.zeros((len(part), tall), np.uint64), np.ones((len(part), wide), np.uint64)
            for k, (_, i, lo, hi) in enumerate(part.tolist()):
                items[k, : self.first[i + 1] - self.first[i]] = self.hashes[self.first[i] : self.first[i + 1]]
                texts[k, : hi - lo] = hashes[lo:hi]
            best, end, start = align(items, texts)
            whole = MATCH * (self.first[part[:, 1] + 1] - self.first[part[:, 1]])
            good = best >= MIN_SCORE * whole
            long = np.flatnonzero(~good & (best >= MATCH * PASSAGE_WORDS))
            good[long] = verbatim(items[long], texts[long]) >= PASSAGE_WORDS
            out.append((part[good, 0], part[good, 1], best[good] / whole[good], (best[good] // MATCH).astype(np.int64), part[good, 2] + start[good], part[good, 2] + end[good]))
        return out


def benchmark_blocks(items: DataFrame, key: str, text: str):
    """The items in blocks of at most BLOCK_BYTES (or one item), in key order; only one block is on the driver."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(key).cast("bigint"), F.lower(text).alias(text)).filter(F.length(F.trim(text)) > 0).orderBy(key, text).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1]) * 4
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _prepare(ids, texts):
    hashes, first = [], [np.zeros(1, np.int64)]
    for _, _, data, offsets in byte_slices(pa.array(texts, pa.large_string())):
        h, f = normal_words(data, offsets)
        hashes.append(h)
        first.append(f[1:] + first[-1][-1])
    return np.array([-1 if i is None else i for i in ids], np.int64), np.concatenate(hashes), np.concatenate(first)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Copies of test items in documents: key, item_id, score, matched, first_word, last_word.

    One row for each (document, item) whose best local alignment reaches MIN_SCORE of the
    score of a whole exact copy, or that share a verbatim passage of PASSAGE_WORDS words,
    however long the item is (its score is then below MIN_SCORE); first_word and last_word (from 0) are its place. Words are
    compared lower-cased and without punctuation, so layout does not matter.

    First pass: document frequency of the items' word pairs over all documents (only pairs of
    items leave a task). Second pass: pairs of documents, also around one other word, meet the
    seeds, and stretches around them that have enough pairs of the item are aligned in the task
    that holds the document; every copy of MIN_SCORE and every such passage comes to the alignment. Items of at most
    WHOLE_WORDS words are found as exact copies only. Seeds and words of the
    benchmark are broadcast in blocks of at most BLOCK_BYTES of text; a larger benchmark
    takes more passes, never a larger broadcast. A document is worked on by itself, so a
    test item found in a third of all documents is no hot key.

    Null or empty texts on either side match nothing; repeated rows and repeated keys give a
    row each (repeated equal items are found each); empty tables give none; other columns
    are not read. Among equally good places in a document the first one is reported.
    """
    spark = ready(docs.sparkSession)
    narrow = id_and_text(docs, key, text).withColumn(text, F.lower(text))
    found = None
    for ids, texts in benchmark_blocks(items, item_key, item_text):
        numbers, hashes, first = _prepare(ids, texts)
        grams, at = item_grams(hashes, first)
        lengths = short_lengths(first)
        asked = spark.sparkContext.broadcast((np.unique(grams), lengths))

        def count(batches, asked=asked):
            keys, lengths = asked.value
            lookup = Lookup(keys)
            total = np.zeros(len(keys), np.int64)
            for batch in batches:
                for _, _, data, offsets in byte_slices(batch.column(0)):
                    hashes, first = normal_words(data, offsets)
                    grams, where = doc_grams(hashes, first, lengths)
                    at, slot = lookup.find(grams)
                    doc = np.searchsorted(first, where[at], "right") - 1
                    once = np.unique(doc * len(keys) + slot) % max(1, len(keys))
                    total += np.bincount(once, minlength=len(keys))
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

        # bounded by the block: one number for each of its pairs
        counted = narrow.select(text).mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        frequency = np.zeros(len(asked.value[0]), np.int64)
        frequency[counted["slot"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
        chosen = choose_seeds(grams, at, first, frequency[np.searchsorted(asked.value[0], grams)])
        shared = spark.sparkContext.broadcast((numbers, hashes, first, grams[chosen], at[chosen]))

        def search(batches, shared=shared):
            matcher = Matcher(*shared.value)
            for batch in batches:
                for a, b, data, offsets in byte_slices(batch.column(1)):
                    hashes, first = normal_words(data, offsets)
                    got = matcher.search(hashes, first)
                    if not got:
                        continue
                    text, item, score, matched, start, end = (np.concatenate(x) for x in zip(*got))
                    order = np.lexsort((start, -score, item, text))
                    order = order[np.r_[True, (text[order][1:] != text[order][:-1]) | (item[order][1:] != item[order][:-1])][: len(order)]]
                    text, item, score, matched, start, end = (x[order] for x in (text, item, score, matched, start, end))
                    own = batch.column(0).take(pa.array(text + a))
                    number = matcher.ids[item]
                    yield pa.RecordBatch.from_arrays(
                        [own, pa.array(number), pa.array(score), pa.array(matched), pa.array(start - first[text]), pa.array(end - first[text])],
                        [key, "item_id", "score", "matched", "first_word", "last_word"],
                    )

        part = narrow.mapInArrow(search, f"{key} bigint, {HITS}")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"{key} bigint, {HITS}")
