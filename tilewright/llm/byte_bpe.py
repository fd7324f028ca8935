"""Byte-level BPE encoding and decoding with a two-tier look-up (operator 3).

Tier one: a minimal perfect hash over the vocabulary resolves pre-tokens that are a whole
token, for all distinct pre-tokens of a slice in a few numpy passes. Tier two: the rest is
merged by rank with a heap over a doubly linked list of its bytes, n log n for any length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tilewright.llm.textops import SpanHash, byte_slices, code_points, id_and_text, mix, ready

BUCKET_KEYS = 4  # mean keys that share a displacement
MEMO_TOKENS = 200_000  # pre-tokens kept per task; a full memo is emptied, results don't depend on it
LONG_TOKEN = 64  # bytes; the memo keys longer pre-tokens by a cryptographic hash
LENGTHS = 8  # bytes hashed at once when keys are packed


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank of a rank file: base64 of the bytes, a blank, the rank."""
    pairs = (line.split() for line in open(path, "rb") if line.strip())
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"ranks of {path} are not 0..{len(found) - 1}")
    return [found[i] for i in range(len(found))]


def key_hashes(keys: Sequence[bytes]) -> np.ndarray:
    """64-bit hash of each byte string, eight bytes a step for all keys together."""
    if not keys:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(-sizes, kind="stable")
    steps = -(-sizes[order] // LENGTHS)
    first = np.concatenate([[0], np.cumsum(steps)])
    packed = np.frombuffer(b"".join(keys[i].ljust(LENGTHS * int(s), b"\0") for i, s in zip(order.tolist(), steps)), "<u8")
    state = mix(sizes[order].astype(np.uint64) + np.uint64(1))
    for step in range(int(steps[0]) if len(steps) else 0):
        live = np.searchsorted(-steps, -step, "left")  # keys longer than this step come first
        state[:live] = mix(state[:live] * np.uint64(0x9E3779B97F4A7C15) + packed[first[:live] + step])
    out = np.empty(len(keys), np.uint64)
    out[order] = state
    return out


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: slot i of n holds exactly one key.

    Keys are hashed into buckets; the largest bucket first, each looks for the displacement
    that sends all its keys to free slots. A query costs two hashes and one comparison of
    the stored 64-bit key hash with the asked one, then of the bytes.
    """

    def __init__(self, keys: Sequence[bytes]) -> None:
        self.n = len(keys)
        hashes = key_hashes(keys)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("keys are not distinct")
        self.buckets = max(1, self.n // BUCKET_KEYS)
        self.shift = np.zeros(self.buckets, np.uint32)
        self.slot_key = np.full(self.n, -1, np.int64)
        bucket = self._bucket(hashes)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        begin = np.concatenate([[0], np.cumsum(size)])
        free = np.ones(self.n, bool)
        for b in np.argsort(-size, kind="stable"):
            if not size[b]:
                break
            members = order[begin[b] : begin[b + 1]]
            base = 0
            while True:  # try 256 displacements at a time
                tries = np.arange(base, base + 256, dtype=np.uint64)
                slots = self._slot(hashes[members][None, :], tries[:, None])
                good = free[slots].all(1)
                if len(members) > 1:
                    ranked = np.sort(slots, 1)
                    good &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
                if good.any():
                    pick = int(np.argmax(good))
                    self.shift[b] = base + pick
                    free[slots[pick]] = False
                    self.slot_key[slots[pick]] = members
                    break
                base += 256
        self.slot_hash = hashes[self.slot_key] if self.n else hashes

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashes + (shift + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(max(1, self.n))).astype(np.int64)

    def find(self, asked: Sequence[bytes]) -> np.ndarray:
        """Number of the key whose hash is that of each asked string, or -1; callers compare the bytes."""
        hashes = key_hashes(asked)
        if not self.n:
            return np.full(len(hashes), -1, np.int64)
        slots = self._slot(hashes, self.shift[self._bucket(hashes)].astype(np.uint64))
        return np.where(self.slot_hash[slots] == hashes, self.slot_key[slots], -1)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge by lowest rank, leftmost first, until no adjacent pair is a token."""
    n = len(piece)
    before, after, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of its two parts has been merged since
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            k = after[i]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if before[i] >= 0:
            h = before[i]
            if (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def char_classes() -> np.ndarray:
    """Class of each code point: 1 letter, 2 number, 3 white space, 0 other."""
    chars = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.zeros(0x110000, np.uint8)
    for kind, name in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(name, chars):
            a, b = ord(chars[m.start()]), ord(chars[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = 0
    return out


class SplitByClass:
    """The splits of the rank files' pattern, found for all texts of a slice at once.

    The pattern cuts texts into runs of one class. The last blank before a run joins it; the
    other white space before it stands alone; an apostrophe that is a run of its own joins a
    following s, t, re, ve, m, ll or d.
    """

    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self) -> None:
        self.classes = char_classes()

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(byte starts, byte ends, first pre-token of each text and the end)."""
        where = np.append(np.flatnonzero(code_points(data)), len(data))
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind, n = self.classes[points], len(points)
        bounds = np.searchsorted(where[:-1], offsets)
        fresh = np.zeros(n + 1, bool)
        fresh[bounds] = True
        start = fresh.copy()
        start[1:n] |= kind[1:] != kind[:-1]
        joined = np.flatnonzero(start[1:n] & ~fresh[1:n] & (kind[1:] != 3) & (kind[:-1] == 3)) + 1
        start[joined - 1] = True
        start[joined[points[joined - 1] == 0x20]] = False
        quote = np.flatnonzero((points == 0x27) & start[:n])
        quote = quote[quote + 1 < n]
        quote = quote[(kind[quote + 1] == 1) & ~fresh[quote + 1]]
        if len(quote):
            one = points[quote + 1]
            second = np.minimum(quote + 2, n - 1)
            two = np.where((quote + 2 < n) & ~fresh[second], points[second], 0)
            size = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
            for pair in ("re", "ve", "ll"):
                size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
            quote, size = quote[size > 0], size[size > 0]
            start[quote + 1] = False
            rest = quote + 1 + size
            rest = rest[rest < n]
            rest = rest[(kind[rest] == 1) & ~fresh[rest]]
            start[rest] = True
        at = np.flatnonzero(start[:n])
        return where[at], where[np.append(at[1:], n)], np.searchsorted(at, bounds)


class SplitByPattern:
    """The same interface for any other pattern, by the regex library."""

    def __init__(self, pattern: str) -> None:
        self.pattern = regex.compile(pattern)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = [], [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            text = data[a:b].tobytes().decode("utf-8")
            where = np.append(np.flatnonzero(code_points(data[a:b])), b - a) + a
            spans = np.array([m.span() for m in self.pattern.finditer(text) if m.end() > m.start()], np.int64).reshape(-1, 2)
            starts.append(where[spans[:, 0]])
            ends.append(where[spans[:, 1]])
            first.append(first[-1] + len(spans))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *ends]), np.array(first)


class Codec:
    """Encodes texts by ranks and a pre-token pattern, and decodes ids."""

    def __init__(self, tokens: list[bytes], pattern: str, perfect: PerfectHash | None = None) -> None:
        self.tokens = tokens
        self.split = SplitByClass() if pattern == SplitByClass.PATTERN else SplitByPattern(pattern)
        self.ranks = {token: i for i, token in enumerate(tokens)}
        self.perfect = perfect or PerfectHash(tokens)
        self.memo: dict[int, tuple[int, ...]] = {}  # by the pre-token's 64-bit hash

    def learn(self, keys: list[int], pieces: list[bytes]) -> None:
        """Put the ids of new pre-tokens into the memo."""
        for key, piece, k in zip(keys, pieces, self.perfect.find(pieces).tolist()):
            self.memo[key] = (k,) if k >= 0 and self.tokens[k] == piece else tuple(merge_bytes(piece, self.ranks))

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's ids begin."""
        if len(self.memo) > MEMO_TOKENS:
            self.memo.clear()
        starts, ends, first = self.split(data, offsets)
        keys = SpanHash(data)(starts, ends)
        for i in np.flatnonzero(ends - starts > LONG_TOKEN):
            keys[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest())
        own, sample, which = np.unique(keys, return_index=True, return_inverse=True)
        listed = own.tolist()
        known = list(map(self.memo.get, listed))
        new = [i for i, ids in enumerate(known) if ids is None]
        if new:
            self.learn([listed[i] for i in new], [data[starts[j] : ends[j]].tobytes() for j in sample[new]])
            known = list(map(self.memo.__getitem__, listed))
        flat = np.fromiter(chain.from_iterable(known), np.int64)
        size = np.fromiter(map(len, known), np.int64, len(known))
        begin = np.cumsum(size) - size
        length = size[which]
        last = np.cumsum(length)
        ids = flat[np.repeat(begin[which] - (last - length), length) + np.arange(last[-1] if len(last) else 0)]
        return ids, np.concatenate([[0], last])[first]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for _, _, data, offsets in byte_slices(pa.array(texts, pa.string())):
            ids, bounds = self.encode_slice(data, offsets)
            out += [x.tolist() for x in np.split(ids, bounds[1:-1])]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encode_decode(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token ids of each whole text and the text decoded from them, as digests (and the ids on demand).

    One row per input row: key, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256 (decoded bytes), `ids` if `keep_ids`. Null and empty texts have no token
    and the digests of nothing; repeated rows are encoded each; an empty table gives none;
    other columns are not read. No special tokens. One pass, no shuffle. The vocabulary (a
    fixed file, read by the driver) is broadcast with its perfect hash; its size does not
    grow with the data.
    """
    spark = ready(docs.sparkSession)
    tokens = load_ranks(rank_path)
    shared = spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))
    schema = f"{key} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")

    def run(batches):
        codec = None
        for batch in batches:
            codec = codec or Codec(shared.value[0], pattern, shared.value[1])
            names = list(map(str, range(len(codec.tokens))))
            for a, b, data, offsets in byte_slices(batch.column(1)):
                ids, bounds = codec.encode_slice(data, offsets)
                digests, decoded = [], []
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = ids[lo:hi].tolist()
                    digests.append(hashlib.sha256(",".join(map(names.__getitem__, own)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(own)).hexdigest())
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return id_and_text(docs, key, text).mapInArrow(run, schema)
