"""Fuzzy search for short license notices (operator 9)."""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tilewright.llm.textops import LOWER, SpanHash, byte_slices, id_and_text, ready, words

# Phrases of the base rule.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Short notices, as words joined by blanks, with the label of their license. Names of a license that is
# a part of another's name (the first words of the GPL's own notice stand in the LGPL's too) have a label of their own.
NOTICES = [
    ("mit", "licensed under the mit license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under apache 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "gnu gpl"),
    ("gpl", "gnu gplv2"),
    ("gpl", "gnu gplv3"),
    ("gpl-family", "free software you can redistribute it and or modify it"),
    ("lgpl", "gnu lesser general public license"),
    ("lgpl", "gnu library general public license"),
    ("lgpl", "gnu lgpl"),
    ("agpl", "gnu affero general public license"),
    ("agpl", "gnu agpl"),
    ("bsd", "licensed under the bsd license"),
    ("bsd", "released under the bsd license"),
    ("bsd", "licensed under bsd 3 clause"),
    ("bsd", "released under bsd 3 clause"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "3 clause bsd license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("mpl", "mozilla public license"),
    ("mpl", "mozilla public license version 2 0"),
    ("epl", "eclipse public license"),
    ("eupl", "european union public licence"),
    ("cddl", "common development and distribution license"),
    ("ms-pl", "microsoft public license"),
    ("ofl", "sil open font license"),
    ("bsl", "boost software license"),
    ("artistic", "the artistic license 2 0"),
    ("zlib", "licensed under the zlib license"),
    ("postgresql", "the postgresql license"),
    ("python", "python software foundation license"),
    ("isc", "licensed under the isc license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "dedicated to the public domain under cc0 1 0"),
    ("cc0", "creative commons zero"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivatives 4 0 international"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 4 0 international"),
    ("cc-by", "creative commons attribution 3 0 unported"),
    ("cc-by-nc", "creative commons attribution noncommercial 3 0 unported"),
    ("cc-by-nd", "creative commons attribution noderivs 3 0 unported"),
    ("cc-by-sa", "creative commons attribution sharealike 3 0 unported"),
    ("cc-by-nc-nd", "creative commons attribution noncommercial noderivs 3 0 unported"),
    ("cc-by-nc-sa", "creative commons attribution noncommercial sharealike 3 0 unported"),
    ("reserved", "all rights reserved"),
]
# Licenses of SPDX tags, and versions of the Creative Commons licenses.
SPDX = {
    "mit": ["mit"], "apache": ["apache 2 0"], "gpl": ["gpl 2 0", "gpl 3 0"], "lgpl": ["lgpl 2 1", "lgpl 3 0"], "agpl": ["agpl 3 0"],
    "bsd": ["bsd 2 clause", "bsd 3 clause"], "mpl": ["mpl 2 0"], "epl": ["epl 1 0", "epl 2 0"], "eupl": ["eupl 1 2"], "cddl": ["cddl 1 0"],
    "ofl": ["ofl 1 1"], "bsl": ["bsl 1 0"], "isc": ["isc"], "zlib": ["zlib"], "unlicense": ["unlicense"], "cc0": ["cc0 1 0"],
}
CC_KINDS = ["by", "by nc", "by nd", "by sa", "by nc nd", "by nc sa"]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
NOTICES += [(label, f"spdx license identifier {name}") for label, names in SPDX.items() for name in names]
NOTICES += [("cc-" + kind.replace(" ", "-"), f"{start}cc {kind} {version}") for kind in CC_KINDS for version in CC_VERSIONS for start in ("", "licensed under ")]

CHARS_PER_EDIT = 12  # a notice of n characters may differ by n // 12 edits

#: bytes that end a word; letters are lower-cased before
OUTSIDE = np.zeros(256, bool)
OUTSIDE[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.frombuffer(LOWER, np.uint8)

SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
    "matches array<struct<label: string, first_word: bigint, last_word: bigint, errors: int, found: string>>"
)


@dataclass
class Notice:
    label: str
    text: str
    edits: int = field(init=False)

    def __post_init__(self) -> None:
        self.edits = len(self.text) // CHARS_PER_EDIT
        # the notice may end inside a longer word only by its edits
        self.pattern = regex.compile(rf"(?b)(?:\b{regex.escape(self.text, literal_spaces=True)}\b){{e<={self.edits}}}")

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): one more than the edits, so that any match holds one of them unchanged."""
        n = self.edits + 1
        cuts = [round(i * len(self.text) / n) for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


class Searcher:
    """All notices behind one automaton over their pieces."""

    def __init__(self, notices=NOTICES) -> None:
        self.notices = [Notice(*n) for n in notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in notice.pieces():
                places.setdefault(piece.encode().decode("latin-1"), []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def windows(self, line: str) -> dict[int, list[list[int]]]:
        """For each notice, the joined stretches of the line in which a match can lie."""
        found: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(line):
            for i, offset in where:
                notice = self.notices[i]
                low, high = end + 1 - size - offset - notice.edits, end + 1 - size - offset + len(notice.text) + notice.edits
                own = found.setdefault(i, [])
                if own and low <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(low, own[-1][0]), max(high, own[-1][1])
                else:
                    own.append([low, high])
        return found

    def matches(self, i: int, line: str, low: int, high: int) -> list[tuple[int, int, int, int]]:
        """All matches of a notice in a stretch: the best one, then those before and behind it, until none is left."""
        notice, out, todo = self.notices[i], [], [(low, high)]
        while todo:
            a, b = todo.pop()
            if b - a < len(notice.text) - notice.edits:
                continue
            m = notice.pattern.search(line, a, b)
            if m:
                out.append((m.start(), m.end(), i, sum(m.fuzzy_counts)))
                todo += [(a, m.start()), (m.end(), b)]
        return out

    def search(self, line: str, low_of, high_of) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, errors) in the line; `low_of`/`high_of` bound a place by its text."""
        out = []
        for i, stretches in self.windows(line).items():
            for low, high in stretches:
                # a stretch may reach over the border of a text: each text's part is searched by itself
                at = max(0, low)
                while at < min(high, len(line)):
                    a, b = max(low, low_of(at)), min(high, high_of(at))
                    out += self.matches(i, line, max(0, a), min(len(line), b))
                    at = max(b, at) + 1
        # of overlapping matches the one with the smallest share of errors stays, then the longer one
        out.sort(key=lambda m: (m[3] / len(self.notices[m[2]].text), m[0] - m[1], m[0], m[2]))
        kept: list[tuple[int, int, int, int]] = []
        taken = np.zeros(len(line) + 1, bool) if len(out) > 64 else None
        for m in out:
            free = not taken[m[0] : m[1]].any() if taken is not None else all(m[1] <= k[0] or m[0] >= k[1] for k in kept)
            if free:
                kept.append(m)
                if taken is not None:
                    taken[m[0] : m[1]] = True
        return sorted(kept)


def one_line(data: np.ndarray, found) -> tuple[str, np.ndarray]:
    """The words joined by blanks, texts by line feeds (a character for each byte), and where each word begins."""
    size = found.ends - found.starts
    begin = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum() + len(size)), 0x20, np.uint8)
    shift = np.repeat(found.starts - begin, size)
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[place] = data[place + shift]
    last = found.first[1:][np.diff(found.first) > 0] - 1
    out[begin[last] + size[last]] = 0x0A
    return out.tobytes().decode("latin-1"), begin


def base_places(hashes: np.ndarray, first: np.ndarray) -> list[tuple[str, np.ndarray]]:
    """(label, word numbers) of each phrase's places; none crosses a text."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(hashes))
    out = []
    for phrase, label in PHRASES.items():
        raw = phrase.encode()
        data, parts = np.frombuffer(raw, np.uint8), words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), OUTSIDE)
        wanted = SpanHash(data)(parts.starts, parts.ends)
        size = max(0, len(hashes) - len(wanted) + 1)
        good = left[:size] >= len(wanted)
        for k, h in enumerate(wanted):
            good &= hashes[k : k + size] == h
        out.append((label, np.flatnonzero(good)))
    return out


def scan(data: np.ndarray, offsets: np.ndarray, searcher: Searcher) -> list[tuple]:
    """One tuple of SCHEMA (without the key) for each text of a slice."""
    data = _LOWER[data]
    found = words(data, offsets, OUTSIDE)
    first, text = found.first, found.text
    rows: list[dict] = [{"base": [], "base_labels": set(), "labels": set(), "score": 0.0, "matches": []} for _ in range(len(offsets) - 1)]
    for label, at in base_places(SpanHash(data)(found.starts, found.ends), first):
        for w in at.tolist():
            row = rows[text[w]]
            row["base"].append(w - int(first[text[w]]))
            row["base_labels"].add(label)
            row["score"] = 1.0
    if len(text):
        line, begin = one_line(data, found)
        ends = np.append(begin[first[1:][np.diff(first) > 0][:-1]], len(line) + 1) - 1  # places of the line feeds
        low_of = lambda p: int(ends[k - 1]) + 1 if (k := int(np.searchsorted(ends, p))) else 0
        high_of = lambda p: int(ends[min(int(np.searchsorted(ends, p)), len(ends) - 1)])
        for a, b, i, errors in searcher.search(line, low_of, high_of):
            u, v = int(np.searchsorted(begin, a, "right")) - 1, int(np.searchsorted(begin, max(a, b - 1), "right")) - 1
            row, notice, base = rows[text[u]], searcher.notices[i], int(first[text[u]])
            row["labels"].add(notice.label)
            row["score"] = max(row["score"], 1 - errors / len(notice.text))
            row["matches"].append((notice.label, u - base, v - base, errors, line[a:b].encode("latin-1").decode("utf-8", "replace")))
    out = []
    for row, n in zip(rows, found.counts.tolist()):
        base = row["base"]
        out.append((n, len(base), min(base, default=None), max(base, default=None), ",".join(sorted(row["base_labels"])), ",".join(sorted(row["base_labels"] | row["labels"])), row["score"], row["matches"]))
    return out


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", notices=NOTICES) -> DataFrame:
    """Phrases and fuzzy notices of every document, one row per input row.

    A notice of n characters is cut into one more piece than the edits allowed for it; any
    copy within the edits holds a piece unchanged, so an automaton over the pieces finds all
    candidates and the regex library's bounded-error matching decides them. Overlapping
    matches go to the notice with the smallest share of errors. `matches` has the spans (word
    numbers), errors and found text; `score` is 1 for a base phrase, else 1 minus the smallest
    share of errors, 0 without a match. Null and empty texts have no words and empty labels;
    repeated rows are scanned each; an empty table gives none; other columns are not read.
    """
    ready(docs.sparkSession)
    schema = SCHEMA.replace("doc_id", key, 1)
    kind = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("found", pa.string())])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(kind)]

    def run(batches):
        searcher = Searcher(notices)
        for batch in batches:
            for a, b, data, offsets in byte_slices(batch.column(1)):
                rows = scan(data, offsets, searcher)
                columns = [pa.array([r[i] for r in rows] if i < 7 else [[dict(zip(("label", "first_word", "last_word", "errors", "found"), m)) for m in r[i]] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return id_and_text(docs, key, text).mapInArrow(run, schema)
