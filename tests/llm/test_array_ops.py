"""Array helpers and the operators' cores against plain Python, on small texts."""

import collections
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import byte_bpe, dart_minhash, decontaminate, html_text, licenses, maxent_lm, quality_rules, textops

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet=st.sampled_from("ab A.\n\t #|é漢\x0b'!"), max_size=60), max_size=8)


def slices(texts, limit=textops.SLICE_BYTES):
    return list(textops.byte_slices(pa.array(texts, pa.string()), limit))


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words_are_the_pattern(texts):
    got = []
    for _, _, data, offsets in slices(texts, 40):
        found = textops.words(data, offsets)
        spans = [data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)]
        got += [spans[i:j] for i, j in zip(found.first[:-1], found.first[1:])]
    assert got == [PLAIN.findall(t) for t in texts]


def rules_by_hand(text):
    w = PLAIN.findall(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, lines = set(), 0
    for line in text.split("\n"):
        if PLAIN.search(line):
            lines += line in seen
            seen.add(line)
    out = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": lines, "n_repeat_words": len(cover)}
    for n in quality_rules.COVERAGE:
        grams, inside = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            inside |= set(range(i, i + n)) if g in grams else set()
            grams.add(g)
        out[f"dup_chars_{n}"] = sum(len(w[i]) for i in inside)
    return out


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_quality_counts(texts):
    texts = texts + [" ".join(texts)] * 2
    got = [{k: int(v[i]) for k, v in found.items() if k != "dup_line_chars"} for _, _, d, o in slices(texts, 50) for found in [quality_rules.measure(d, o)] for i in range(len(o) - 1)]
    assert got == [rules_by_hand(t) for t in texts]


@pytest.fixture(scope="module")
def codec():
    tokens = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return byte_bpe.Codec(tokens, public_tokenizers.PATTERN), whole


@given(texts=st.lists(st.text(alphabet=st.sampled_from("don'tvmrels S1²٣ \n\t\x0b\x1c\x85 é漢😀~!'"), max_size=40) | st.text(max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_bpe_is_tiktoken(codec, texts):
    own, whole = codec
    got = own.encode_many(texts)
    assert got == [whole.encode_ordinary(t) for t in texts]
    assert [own.decode(ids).decode() for ids in got] == texts


def test_bpe_long_pretokens_and_other_pattern(codec):
    own, whole = codec
    texts = ["a" * 5000, "xyz" * 700 + " ", "!" * 999, ""]
    assert own.encode_many(texts) == [whole.encode_ordinary(t) for t in texts]
    pattern = r"\w+|\W"
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    assert byte_bpe.Codec(own.tokens, pattern, own.perfect).encode_many(["ab c\n?é"]) == [other.encode_ordinary("ab c\n?é")]


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() * (1 + i % 5) for i in range(3000)]
    perfect = byte_bpe.PerfectHash(keys)
    assert sorted(perfect.slot_key.tolist()) == list(range(3000))
    assert (perfect.find(keys) == np.arange(3000)).all()
    assert (perfect.find([b"no", b"", b"x" * 50]) == -1).all()
    assert len(byte_bpe.PerfectHash([]).find([b"a"])) == 1


def test_dart_signatures_estimate_weighted_jaccard():
    draw = np.random.default_rng(3)
    errors = []
    for _ in range(12):
        elements = draw.integers(0, 1 << 62, 60).astype(np.uint64)
        a, b = draw.choice([0, 0.3, 1, 2.5, 7], 60), draw.choice([0, 0.3, 1, 2.5, 7], 60)
        both = np.concatenate([a, b])
        signed = dart_minhash.dart_signatures(np.concatenate([elements, elements]), both, np.array([0, 60, 120]), 400)
        errors.append((signed[0] == signed[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
        assert (signed != 0).all()
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.1


def test_darts_of_empty_sets():
    assert (dart_minhash.dart_signatures(np.zeros(0, np.uint64), np.zeros(0), np.array([0, 0])) == 0).all()


def align_by_hand(item, text):
    best, score = 0, [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(text) + 1):
            s = decontaminate.MATCH if item[i - 1] == text[j - 1] else decontaminate.MISMATCH
            score[i][j] = max(0, score[i - 1][j - 1] + s, score[i - 1][j] + decontaminate.GAP, score[i][j - 1] + decontaminate.GAP)
            best = max(best, score[i][j])
    return best


@given(st.lists(st.tuples(st.lists(st.integers(2, 6), min_size=1, max_size=12), st.lists(st.integers(2, 6), min_size=1, max_size=20)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_alignment_scores(pairs):
    tall, wide = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    items, texts = np.zeros((len(pairs), tall), np.uint64), np.ones((len(pairs), wide), np.uint64)
    for k, (a, b) in enumerate(pairs):
        items[k, : len(a)], texts[k, : len(b)] = a, b
    best, end, start = decontaminate.align(items, texts)
    assert best.tolist() == [align_by_hand(a, b) for a, b in pairs]
    for (a, b), score, e, s in zip(pairs, best, end, start):
        assert score == 0 or align_by_hand(a, b[s : e + 1]) == score


@pytest.mark.parametrize("main", [True, False])
def test_near_copies_of_an_article_stay_whole(main):
    notice = "this notice is on all pages of the host"
    article = [" ".join(f"p{b}w{k}" for k in range(40)) for b in range(3)]
    copies = [[b.replace(f"w{c}", f"w{c}x", 1) if k == c % 3 else b for k, b in enumerate(article)] for c in range(6 if main else 5)]
    others = [[" ".join(f"o{o}b{b}w{k}" for k in range(40)) for b in range(3)] for o in range(8 if main else 20)]
    for rest in (others[:2], others):
        pages = [([*blocks, notice], main, [0.0] * 4) for blocks in copies + rest]
        kept = html_text.keep_blocks(pages)
        assert [k[:3] for k in kept] == copies + rest
        assert {len(k) for k in kept} == {3 if rest is others else 4}  # few distinct pages make no boilerplate


@given(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=14), st.sampled_from([0.2, 0.5]))
@settings(max_examples=60, deadline=None)
def test_repeated_runs(streams, share):
    streams = [np.array(s, np.int64) for s in streams]
    own = list({s.tobytes(): s.tolist() for s in streams}.values())
    n = html_text.RUN_TOKENS
    for stream, got in zip(streams, html_text.repeated_tokens(streams, share)):
        want = np.zeros(len(stream), bool)
        for i in range(len(stream) - n + 1):
            run = stream[i : i + n].tolist()
            if sum(any(x[j : j + n] == run for j in range(len(x) - n + 1)) for x in own) >= max(html_text.MIN_PAGES, share * len(own)):
                want[i : i + n] = True
        assert (want == got).all()


@pytest.mark.parametrize(
    ("page", "blocks", "main"),
    [
        ("", [], False),
        ("<p>a&nbsp;&lt;b&gt;\n c<p>d", ["a <b> c", "d"], False),
        ("<nav>m</nav><article><header><h1>T</h1></header><p>x <b>y<br>z</p><div class='reader-comments'><p>c</p></div><p>e</article><footer>f", ["T", "x y z", "e"], True),
        ("<div class=ad>never closed<article><p>kept</p></article>", ["kept"], True),
        ("<article>A</article><div class=sidebar>s<div>t</div></div><article class=comment>c</article>", ["A"], True),
        ("<p>x<script>if (a<b) { '</p>' }</script>y<style>p{}</style><!-- c --></p>", ["xy"], False),
        ("<body class='has-sidebar'><main>m<form>f</form></main>", ["m"], True),
        ("a < b & c", ["a < b & c"], False),
        ("<article><p>" + "İ" * 60 + "</p><script>x</script><p>after</p></article>", ["İ" * 60, "after"], True),
        ('<p title="a <b>bold</b> c">Hello', ["Hello"], False),
        ('<p title="never closed>one</p><p class="x">two</p>', ["one", "two"], False),
        ("<div class='content has-sidebar'><p>all</p></div>", ["all"], False),
        ("<div class='post-share-enabled'><p>story</p></div>", ["story"], False),
        ("<div class='sidebar-page'><p>" + "text " * 120 + "</p><div class=sidebar>s</div></div><p>t</p>", [("text " * 120).strip(), "t"], False),
        ("<div class=comments><p>" + "text " * 120 + "</p></div><p>t</p>", ["t"], False),
        ("<div class=sidebar><p><a href=x>" + "text " * 120 + "</a></p></div><p>t</p>", ["t"], False),
    ],
)
def test_page_blocks(page, blocks, main):
    assert html_text.page_blocks(page)[:2] == (blocks, main)


def test_loose_pages_lose_what_the_host_repeats():
    pages = [html_text.page_blocks(f"<div>Welcome to our fine site</div><p>own text number {i} about topic {i * 7}</p><div>All about us here today</div>") for i in range(12)]
    assert html_text.keep_blocks(pages) == [[f"own text number {i} about topic {i * 7}"] for i in range(12)]


def test_unique_words_beside_a_footer_stay():
    footer = " ".join(f"footer{k}" for k in range(15))
    pages = [html_text.page_blocks(f"<p>{footer} only{i} a{i} b{i} c{i} d{i}</p><p>more{i} own{i} text{i}</p>") for i in range(12)]
    assert html_text.keep_blocks(pages) == [[f"only{i} a{i} b{i} c{i} d{i}", f"more{i} own{i} text{i}"] for i in range(12)]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("", ""),
        ("Released under the MIT License", "mit"),
        ("this is licensd under the mit licence ok", "mit"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa"),
        ("GNU Lesser Generel Public License", "lgpl"),
        ("redistribution and use in sorce and binary forms, with or wihout modification", "bsd"),
        ("the general public liked it and the license", ""),
        ("SPDX-License-Identifier: Apache-2.0", "apache"),
        ("SPDX-License-Identifier: LGPL-2.1-only", "lgpl"),
        ("This is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl,gpl-family"),
        ("This is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "gpl,gpl-family,lgpl"),  # the base rule finds its phrase in the LGPL too
        ("GNU GPLv3", "gpl"),
        ("released under BSD-3-Clause", "bsd"),
        ("Eclipse Public License 2.0", "epl"),
        ("SIL Open Font License", "ofl"),
        ("Boost Software License", "bsl"),
        ("CC BY 3.0", "cc-by"),
        ("CC BY-NC-ND 2.5", "cc-by-nc-nd"),
        ("Creative Commons Attribution-ShareAlike 3.0 Unported", "cc-by-sa"),
    ],
)
def test_notices(text, labels):
    data = np.frombuffer(text.encode(), np.uint8)
    row = licenses.scan(data, np.array([0, len(data)]), licenses.Searcher())[0]
    assert row[5] == labels and (row[6] > 0) == bool(labels)


def test_every_copy_of_a_notice_is_found():
    draw, searcher = np.random.default_rng(5), licenses.Searcher([("x", "licensed under the open widget license")])
    for _ in range(200):
        said, want = [], []
        for _ in range(int(draw.integers(1, 6))):
            copy = list("licensed under the open widget license")
            places = draw.choice([k for k in range(2, len(copy) - 2) if copy[k] != " "], int(draw.integers(0, 4)), replace=False)
            for k in places:
                copy[k] = "q"
            want.append(len(places))
            said.append("".join(copy))
        line = " ".join(said) + "\n"
        found = searcher.search(line, lambda p: 0, lambda p: len(line) - 1)
        assert [m[3] for m in found] == want


def test_notices_stay_inside_a_text():
    _, _, data, offsets = slices(["all rights", "reserved", "mit", "license"])[0]
    assert [r[5] for r in licenses.scan(data, offsets, licenses.Searcher())] == [""] * 4


def test_model_is_a_distribution():
    texts = [" ".join(f"w{(i * j) % 37}" for j in range(40)) for i in range(30)]
    (_, _, data, offsets) = slices(texts)[0]
    token, first = maxent_lm.tokens(data, offsets)
    keys, count = np.unique(token, return_counts=True)
    draw = np.random.default_rng(0)
    top = np.lexsort((keys, -count))[: maxent_lm.WORDS]
    member = np.full((maxent_lm.GROUPS, maxent_lm.MEMBERS), -1e4, np.float32)
    member.reshape(-1)[: len(top)] = np.log(count[top] + 0.5)
    own = maxent_lm.Counts(int(count.sum()), len(keys), keys, count, keys[top][np.argsort(keys[top])], np.argsort(keys[top]), np.zeros(maxent_lm.SHAPES), draw.normal(size=maxent_lm.CLASSES).astype(np.float32), member)
    weights = maxent_lm.Weights(draw.normal(size=(maxent_lm.CLASS_ROWS, maxent_lm.CLASSES)).astype(np.float32), draw.normal(size=(maxent_lm.MEMBER_ROWS, maxent_lm.MEMBERS)).astype(np.float32))
    symbol = own.symbols(token)
    _, _, p, _, _, q = maxent_lm.predict(weights, own, symbol, maxent_lm.history(symbol, first))
    assert np.allclose(p.sum(1), 1, atol=1e-5) and np.allclose(q.sum(1), 1, atol=1e-5)


def test_history_stays_inside_a_text():
    symbol, first = np.array([5, 6, 7, 8, 9]), np.array([0, 2, 5])
    none = maxent_lm.SYMBOLS - 1
    assert maxent_lm.history(symbol, first).tolist() == [[none, 5, none, 7, 8], [none, none, none, none, 7], [none] * 5]


