"""Elements of the arrays of large JSON documents, read by many tasks.

Spark's text reader cuts a file at `}` into its usual splits. A first pass tells of each
split what it does to the reader's state (inside a string or not, depth, array), for both
states it may begin in; a fold over these small rows gives every split its state, and a
second pass cuts the elements out. Only elements that cross a split's border are shuffled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import shared_dir, ship_package

_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_OPEN, _CLOSE = b"{[", b"}]"
_STEP = np.zeros(256, np.int64)
_STEP[[*_OPEN]], _STEP[[*_CLOSE]] = 1, -1
_MARK = _STEP != 0
_MARK[ord('"')] = True


def marks(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places, characters, depth behind each from 0) of the brackets outside strings, and whether the end is inside one."""
    data = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(_MARK[data])
    kind = data[at]
    quote = kind == ord('"')
    behind = quote & (data[np.maximum(at - 1, 0)] == ord("\\")) & (at > 0)
    for i in np.flatnonzero(behind):  # an odd run of backslashes takes the quote's meaning
        run, place = 0, int(at[i]) - 1
        while place >= 0 and data[place] == ord("\\"):
            run, place = run + 1, place - 1
        quote[i] = run % 2 == 0
    count = np.cumsum(quote) + int(inside)
    plain = (kind != ord('"')) & (count % 2 == 0)
    steps = _STEP[kind[plain]]
    return at[plain], kind[plain], np.cumsum(steps), bool((count[-1] if len(count) else int(inside)) % 2)


def opened(text: bytes, place: int, kind: int) -> str | None:
    """Name of the array that opens at a place (empty without a key), or None for an object."""
    if kind != ord("["):
        return None
    found = _KEY.search(text[max(0, place - 1000) : place])
    return found[1].decode() if found else ""


def _splits(batches):
    """(file, block, text) of consecutive rows of a split; the text ends with the `}` that the reader took."""
    for batch in batches:
        files, blocks, values = (batch.column(k).to_pylist() for k in range(3))
        at = 0
        while at < len(files):
            end = at
            while end < len(files) and files[end] == files[at] and blocks[end] == blocks[at]:
                end += 1
            yield files[at], blocks[at], ("}".join(values[at:end]) + "}").encode()
            at = end


SUMMARY = "file string, block bigint, inside int, flips int, step bigint, opens array<struct<depth: bigint, name: string>>, closes array<bigint>"
STATE = "file string, block bigint, inside boolean, depth bigint, section string, before bigint"
PIECE = "file string, section string, piece_of bigint, block bigint, ended boolean, text string"


def _summaries(rows: DataFrame) -> DataFrame:
    """What a split does for each state it may begin in: end state, step of depth, last opening at each depth, depths behind `}`."""

    class Tally:
        def __init__(self) -> None:
            self.inside = [False, True]
            self.depth = [0, 0]
            self.opens: list[dict[int, str | None]] = [{}, {}]
            self.closes: list[set[int]] = [set(), set()]

        def add(self, text: bytes) -> None:
            for s in (0, 1):
                at, kind, depth, self.inside[s] = marks(text, self.inside[s])
                depth = depth + self.depth[s]
                up = np.flatnonzero((kind == ord("{")) | (kind == ord("[")))
                level, last = np.unique(depth[up][::-1], return_index=True)
                for d, i in zip(level.tolist(), last.tolist()):
                    i = up[len(up) - 1 - i]
                    self.opens[s][d - 1] = opened(text, int(at[i]), int(kind[i]))
                self.closes[s].update(np.unique(depth[kind == ord("}")]).tolist())
                self.depth[s] = int(depth[-1]) if len(depth) else self.depth[s]

        def rows(self, file, block):
            for s in (0, 1):
                yield file, block, s, int(self.inside[s] != bool(s)), self.depth[s], [{"depth": d, "name": n} for d, n in self.opens[s].items()], sorted(self.closes[s])

    types = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.int32()), ("flips", pa.int32()), ("step", pa.int64()), ("opens", pa.list_(pa.struct([("depth", pa.int64()), ("name", pa.string())]))), ("closes", pa.list_(pa.int64()))])

    def run(batches):
        now, tally = None, None
        for file, block, text in _splits(batches):
            if (file, block) != now:
                if tally is not None:
                    yield _table(tally.rows(*now), types)
                now, tally = (file, block), Tally()
            tally.add(text)
        if tally is not None:
            yield _table(tally.rows(*now), types)

    return rows.mapInArrow(run, SUMMARY)


def _table(rows, types: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, types)], schema=types)


def _states(summaries: DataFrame, depth_of_elements: int) -> DataFrame:
    """State at the beginning of each split, and the last split before it in which an element ends (-1: none)."""
    types = pa.schema([("file", pa.string()), ("block", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("section", pa.string()), ("before", pa.int64())])

    def fold(rows):
        now, done, inside, depth, section, before = None, None, 0, 0, None, -1
        for file, block, begins, flips, step, opens, closes in rows:
            if file != now:
                now, done, inside, depth, section, before = file, None, 0, 0, None, -1
            if begins != inside or block == done:
                continue
            yield file, block, bool(inside), depth, section, before
            done = block
            for o in opens:
                if o["depth"] + depth == depth_of_elements - 1:
                    section = o["name"]
            if depth_of_elements - depth in closes:
                before = block
            inside, depth = inside ^ flips, depth + step

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held = []
        for row in fold(rows):
            held.append(row)
            if len(held) >= 4096:
                yield _table(held, types)
                held = []
        yield _table(held, types)

    dealt = summaries.repartition("file").sortWithinPartitions("file", "block", "inside")
    return dealt.mapInArrow(run, STATE)


def cut(text: bytes, inside: bool, depth: int, section: str | None, level: int):
    """Elements that end in a text: (section, first place or -1 if it begins before, end), and the state behind the text."""
    at, kind, depths, inside = marks(text, inside)
    depths = depths + depth
    ends = np.flatnonzero((kind == ord("}")) & (depths == level))
    begins = np.flatnonzero((kind == ord("{")) & (depths == level + 1))
    opens = np.flatnonzero(((kind == ord("{")) | (kind == ord("["))) & (depths == level))
    names = [section, *[opened(text, int(at[i]), int(kind[i])) for i in opens]]
    of_end = np.searchsorted(opens, ends)
    begin = np.searchsorted(begins, ends) - 1
    found, last = [], -1
    for e, o, b in zip(ends.tolist(), of_end.tolist(), begin.tolist()):
        own = b >= 0 and begins[b] > last
        found.append((names[o], int(at[begins[b]]) if own else -1, int(at[e]) + 1))
        last = e
    return found, inside, int(depths[-1]) if len(depths) else depth, names[-1]


def own_text(text: bytes, level: int) -> bytes:
    """An element at the end of a text that begins outside strings: from its own bracket on."""
    at, kind, depths, _ = marks(text, False)
    depths = depths + level - depths[-1]
    return text[int(at[np.flatnonzero((kind == ord("{")) & (depths == level + 1))[-1]]) :]


def json_elements(spark: SparkSession, path: str, level: int) -> DataFrame:
    """(file, section, text) of the objects in arrays at a depth: 1 for a document that is an array, 2 for arrays of its fields.

    `section` is the name of the array's field, empty for a document that is an array.
    Objects that are no array elements are left out; so are elements that are no objects. A
    file may hold several documents. Memory holds one element and one batch of a split. A
    field's name must not hold `}`.
    """
    ship_package(spark)
    rows = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    states = _states(_summaries(rows), level)
    # a state a split goes out to the tasks, so the text stays where and in the order in which it is read
    ordered = rows.join(F.broadcast(states), ["file", "block"]).select("file", "block", "value", "inside", "depth", "section", "before")
    types = pa.schema([("file", pa.string()), ("section", pa.string()), ("piece_of", pa.int64()), ("block", pa.int64()), ("ended", pa.bool_()), ("text", pa.string())])

    def run(batches):
        now, state, left, group, seen = None, [], [], -1, False

        def rest():  # what is behind the split's last element belongs to the element that ends in a later split
            return (*now[:1], None, now[1] if seen else group, now[1], False, b"".join(left).decode())

        for batch in batches:
            out, first = [], {}
            for file, block, *begins in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6))):
                first.setdefault((file, block), begins)
            for file, block, text in _splits([batch.select(["file", "block", "value"])]):
                if (file, block) != now:
                    if now is not None:
                        out.append(rest())
                    now, left, seen = (file, block), [], False
                    *state, group = first[now]
                found, *state = cut(text, *state, level)
                done = 0
                for name, begin, end in found:
                    if not seen:
                        out.append((file, name, group, block, True, b"".join([*left, text[:end]]).decode()))
                    elif name is not None:
                        whole = text[begin:end] if begin >= 0 else own_text(b"".join([*left, text[done:end]]), level)
                        out.append((file, name, None, block, True, whole.decode()))
                    done, left, seen = end, [], True
                left.append(text[done:])
            yield _table(out, types)
        if now is not None:
            yield _table([rest()], types)

    def joined(batches):
        for batch in batches:
            whole = [own_text(text.encode(), level).decode() for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.string())], ["file", "section", "text"])

    table = shared_dir(spark, "elements")
    ordered.mapInArrow(run, PIECE).write.parquet(table)  # compressed, and read once a section
    pieces = spark.read.schema(PIECE).parquet(table)
    broken = pieces.filter("piece_of is not null")
    ends = broken.filter("ended and section is not null").select("file", "piece_of", F.col("section").alias("_s"))
    parts = broken.join(ends, ["file", "piece_of"]).groupBy("file", "_s", "piece_of").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"))
    mended = parts.select("file", F.col("_s").alias("section"), F.array_join("p.text", "").alias("text")).mapInArrow(joined, "file string, section string, text string")
    return pieces.filter("piece_of is null").select("file", "section", "text").unionByName(mended)
