"""Near-duplicate classes by DartMinHash signatures and a banded join (operator 10)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.components import components
from tilewright.llm.key_filter import may_be_among
from tilewright.llm.textops import BASE, LOWER, SpanHash, byte_slices, id_and_text, mix, ngrams, ranked, ready, words
from tilewright.session import cut_lineage, shared_dir

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 5  # a pair at 0.8 shares no band with probability 1.5e-5
K = BANDS * ROWS
BLOCK = 512  # texts of a bucket compared at once
SKETCH_BYTES = 1 << 18  # text whose darts are thrown at once

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])
_C1, _C2, _C3 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)
_LOWER = np.frombuffer(LOWER, np.uint8)


def dart_signatures(elements: np.ndarray, weights: np.ndarray, first: np.ndarray, k: int = K) -> np.ndarray:
    """k coordinates (64-bit dart numbers) for each weighted set; sets without elements give zeros.

    Darts are fixed points of a unit-rate Poisson process over (element, weight, rank). A set
    sees the darts whose weight position lies below the weight that it gives the element. Its
    darts fall by hash on k coordinates, and the earliest by rank is kept on each; two sets
    agree on a coordinate with the probability of their weighted Jaccard similarity. Ranks
    are opened up to about k ln k + 2k darts a set, whatever its size, and twice as far where
    a coordinate stayed empty. The process is drawn in cells of area one: weight [0, 1),
    [1, 2), [2, 4), [4, 8) ... by rank layers as thin as the cell is wide.
    """
    sets = len(first) - 1
    out = np.zeros((sets, k), np.uint64)
    total = np.zeros(len(weights) + 1)
    np.cumsum(weights, out=total[1:])
    total = np.diff(total[first])
    depth = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        size = np.diff(first)[todo]
        owner = np.repeat(np.arange(len(todo)), size)
        item = np.repeat(first[todo] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        # weight cells of each element
        cells = np.where(weights[item] > 0, 1 + np.ceil(np.log2(np.maximum(weights[item], 1))).astype(np.int64), 0)
        owner, item = np.repeat(owner, cells), np.repeat(item, cells)
        level = np.arange(len(item)) - np.repeat(np.cumsum(cells) - cells, cells)
        width = np.where(level > 0, 2.0 ** (level - 1), 1.0)
        low = np.where(level > 0, width, 0.0)
        # rank layers of each cell
        layers = np.ceil(depth[todo][owner] * width).astype(np.int64)
        layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
        seed = mix(elements[item] + level.astype(np.uint64) * _C1)
        cell = mix(np.repeat(seed, layers) + layer.astype(np.uint64) * _C2)
        count = np.searchsorted(_POISSON, (cell >> np.uint64(11)) * 2.0**-53, "right")
        row = np.repeat(np.repeat(np.arange(len(item)), layers), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        dart = mix(np.repeat(cell, count) + (nth.astype(np.uint64) + np.uint64(1)) * _C3)
        place = low[row] + width[row] * ((dart >> np.uint64(32)) * 2.0**-32)
        rank = (np.repeat(layer, count) + (dart & np.uint64(0xFFFFFFFF)) * 2.0**-32) / width[row]
        seen = np.flatnonzero((place < weights[item][row]) & (rank < depth[todo][owner[row]]))
        dart, rank = dart[seen], rank[seen]
        slot = owner[row[seen]] * k + (mix(dart) % np.uint64(k)).astype(np.int64)
        best = np.full(len(todo) * k, np.inf)
        np.minimum.at(best, slot, rank)
        won = np.flatnonzero(rank == best[slot])
        kept = np.zeros(len(todo) * k, np.uint64)
        kept[slot[won]] = dart[won]
        full = np.isfinite(best).reshape(-1, k).all(1)
        out[todo[full]] = kept.reshape(-1, k)[full]
        todo = todo[~full]
        depth[todo] *= 2
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, multiplicities, first of each text) of the distinct n-word shingles of each text.

    Words are runs of non-white bytes, A-Z lower-cased. A text of fewer than n words has one
    shingle, all its words; a text without words has none.
    """
    data = _LOWER[data]
    found = words(data, offsets)
    hashes = SpanHash(data)(found.starts, found.ends)
    grams, at = ngrams(hashes, found.first, n)
    text = found.text[at]
    for few in range(1, n):
        short = np.flatnonzero(found.counts == few)
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for i in range(few):
                own = own * BASE + hashes[found.first[short] + i]
            grams, text = np.concatenate([grams, mix(own + np.uint64(few))]), np.concatenate([text, short])
    count, first = ranked(grams, text)
    grams, text, count = grams[first], text[first], count[first]
    order = np.lexsort((grams, text))
    return grams[order], count[order], np.searchsorted(text[order], np.arange(len(offsets)))


def bands_of(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band; a band's number is part of its hash."""
    out = np.empty((len(signatures), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signatures), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * BASE + signatures[:, b * rows + r])
        out[:, b] = h
    return out


SKETCH = "_id bigint, node bigint, n_shingles bigint, bands array<bigint>, shingles binary"


def sketch(docs: DataFrame, weighted: bool) -> DataFrame:
    """One narrow row for each document; node is a 64-bit key of its shingle set, null without words."""

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(1), SKETCH_BYTES):
                grams, count, first = shingle_sets(data, offsets)
                size = np.diff(first)
                signed = dart_signatures(grams, count.astype(float) if weighted else np.ones(len(grams)), first)
                text = np.repeat(np.arange(b - a), size)
                key = np.zeros(b - a, np.uint64)
                np.add.at(key, text, mix(grams ^ _C1) * (count.astype(np.uint64) if weighted else np.uint64(1)))
                key = mix(key + size.astype(np.uint64)).view(np.int64)
                low = (grams >> np.uint64(32)).astype("<u4")
                banded = bands_of(signed).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * BANDS, pa.int32()), pa.array(banded.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(key, mask=size == 0), pa.array(size), lists,
                        pa.array([np.unique(low[i:j]).tobytes() for i, j in zip(first[:-1], first[1:])], pa.binary()),
                    ],
                    [c.split()[0] for c in SKETCH.split(", ")],
                )

    return docs.mapInArrow(run, SKETCH)


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets (32 bits of each shingle's hash) have the Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            keep, scores = [], []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    continue
                same = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                if same >= similarity * (len(x) + len(y) - same) - 1e-9:
                    keep.append(i)
                    scores.append(same / (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), pa.array(scores, pa.float64())], ["a", "b", "similarity"])

    return joined.mapInArrow(run, "a bigint, b bigint, similarity double")


def _links(node: np.ndarray, comp: np.ndarray, left: np.ndarray, same_block: bool, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int, float]]:
    """Links that join components of one block, or of two blocks; a pair that is joined by now is not compared."""
    size = np.array([len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    bits = np.zeros((len(sets), (int(column.max()) >> 6) + 1), np.uint64)
    np.bitwise_or.at(bits, (np.repeat(np.arange(len(sets)), size), column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
    comp, out = comp.copy(), []
    for i in range(len(sets)) if same_block else np.flatnonzero(left):
        others = np.arange(i + 1, len(sets)) if same_block else np.flatnonzero(~left)
        others = others[(comp[others] != comp[i]) & (np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]))]
        if not len(others):
            continue
        both = np.bitwise_count(bits[others] & bits[i]).sum(1, dtype=np.int64)
        score = both / (size[others] + size[i] - both)
        for j, value in zip(others[score >= similarity - 1e-12], score[score >= similarity - 1e-12]):
            if comp[j] != comp[i]:
                out.append((int(node[i]), int(node[j]), float(value)))
                comp[comp == comp[j]] = comp[i]
    return out


def links_inside(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b, similarity) between different components inside a bucket.

    `members` (h, node, comp) are the texts that the comparison with the leader has not put
    into one component. A bucket is dealt into blocks of about BLOCK texts, and each pair of
    blocks is a unit of work for some task, so a large bucket is spread. Tasks stream their
    units; sets are compared there, and only links that join two components come out.
    """
    sizes = members.groupBy("h").agg(F.count("*").alias("m"))
    dealt = members.join(sizes, "h").join(sets, "node").withColumn("n", F.ceil(F.col("m") / BLOCK).cast("bigint")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    dealt = dealt.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "node", "comp", "shingles")
    parts = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "node")

    def compare(unit: pa.Table) -> pa.RecordBatch:
        i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
        left = np.asarray(unit.column("left").to_numpy(zero_copy_only=False), bool)
        sets = [np.frombuffer(x.as_buffer(), "<u4") for x in unit.column("shingles")]
        found = _links(unit.column("node").to_numpy(), unit.column("comp").to_numpy(), left, i == j, sets, similarity)
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # the unit that may go on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], 1)
            if last is not None and (keys[0] != last).any():
                yield compare(pa.Table.from_batches(held))
                held = []
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                held.append(batch.slice(lo, hi - lo))
                if hi < len(keys):
                    yield compare(pa.Table.from_batches(held))
                    held = []
            last = keys[-1]
        if held:
            yield compare(pa.Table.from_batches(held))

    return parts.mapInArrow(run, "a bigint, b bigint, similarity double")


def sets_of(known: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, one row each; the filter keeps other sets from being shuffled."""
    ids = known.select("node", F.coalesce("_id", F.lit(-(1 << 63))).alias("_id"), "shingles").filter(may_be_among(nodes, "node")("node"))
    one = known.select("node", F.coalesce("_id", F.lit(-(1 << 63))).alias("_id")).groupBy("node").agg(F.min("_id").alias("_id"))
    wanted = one.join(nodes, "node", "left_semi")
    return ids.join(wanted, ["node", "_id"], "left_semi").dropDuplicates(["node"]).select("node", "shingles")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """Class of every document: key, class_id (smallest key of the class), n_shingles, class_size.

    Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at
    least `similarity`; a class is a connected component. `weighted` lets signatures count a
    shingle as often as it occurs. Texts with equal sets are one node from the start, so
    copies are never expanded. Candidates share a band; each bucket first compares its texts
    with its most popular one, then only texts that are still in different components, block
    by block; every link is an exact comparison of sets. No bucket, pair or candidate is capped.

    One row per input row. Null, empty and white texts are classes of their own (class_id is
    their key); repeated rows and repeated keys share the class of their text; null keys are
    kept (a class of null keys has class_id null); an empty table gives none; other columns
    are not read.
    """
    spark = ready(docs.sparkSession)
    folder = shared_dir(spark, "near-duplicates")
    sketch(id_and_text(docs, key, text).withColumnRenamed(key, "_id"), weighted).write.parquet(f"{folder}/sketch")
    drawn = spark.read.parquet(f"{folder}/sketch")
    known = drawn.filter("node is not null")

    rows = known.select(F.explode("bands").alias("h"), "node").distinct()
    shared = rows.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    members = cut_lineage(rows.join(shared, "h"))
    popular = members.groupBy("node").agg(F.sum("m").alias("popular"))
    leaders = members.join(popular, "node").groupBy("h").agg(F.max_by("node", F.struct("popular", "node")).alias("leader"))
    led = cut_lineage(members.join(leaders, "h").select("h", "node", "leader").filter("node != leader"))

    # sets of the texts that share a band with another one, once for each node
    sets_of(known, members.select("node").distinct()).write.parquet(f"{folder}/sets")
    sets = spark.read.parquet(f"{folder}/sets")

    links = cut_lineage(verify(led.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), sets, similarity))
    found = components(links)
    placed = led.join(found, "node", "left").select("h", "node", F.coalesce("root", "node").alias("comp"))
    apart = placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("h")
    more = links_inside(placed.join(apart, "h", "left_semi"), sets, similarity)
    found = components(links.union(more))

    placed = drawn.select("_id", "node", "n_shingles").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.filter("root is not null").groupBy("root").agg(F.min("_id").alias("class_id"), F.count("*").alias("class_size"))
    out = placed.join(classes, "root", "left")
    alone = F.col("root").isNull()
    return out.select(
        F.col("_id").alias(key),
        F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        "n_shingles",
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
    )


ORACLE = f"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i+{SHINGLE_WORDS - 1}], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - {SHINGLE_WORDS - 2}))) as i from d where len(ws) > 0) q),
n as (select doc_id, count(*) as n from s group by doc_id),
e as (select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having count(*) >= {SIMILARITY} * (x.n + y.n - count(*)) - 1e-9),
r as (select doc_id as a, doc_id as b from n union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, min(b) as class_id from r group by a),
z as (select class_id, count(*) as class_size from c group by class_id)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(n.n, 0) as n_shingles, coalesce(z.class_size, 1) as class_size
from d left join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id left join z on z.class_id = c.class_id"""
