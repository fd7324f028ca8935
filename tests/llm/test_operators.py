"""Each operator as a Spark job: nulls, empty tables, repeats, clashing columns, and brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check_oracle
import corpus_pipeline
from tilewright.llm import chat_rotation, components, dart_minhash, html_text, queries, url_filter
from tilewright.llm.byte_bpe import encode_decode, load_ranks
from tilewright.llm.decontaminate import contaminated
from tilewright.llm.html_text import extract_text
from tilewright.llm.key_filter import may_be_among
from tilewright.llm.licenses import scan_licenses
from tilewright.llm.maxent_lm import score_texts
from tilewright.llm.quality_classifier import quality_scores
from tilewright.llm.quality_rules import quality_rules

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CLASHES = ["lang", "source", "n_chars", "node", "h", "bands", "row", "token", "n", "score", "item_id", "label", "host", "part", "_k", "class_id", "kept"]
ODD = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \n\t "), (None, "a b c d e f"), (None, None), (5, "x " * 60_000), (6, "licensed under the mit license é漢")]


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASHES))


def labels_of(spark, rows=((1, 1, 0), (3, 0, 0), (None, 1, 0), (6, None, None), (99, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def items_of(spark, rows=((1, "the quick brown fox jumps over the lazy dog tonight"), (2, None), (3, ""), (None, "one two"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


OPERATORS = {
    "rules": lambda s, d: quality_rules(d),
    "bpe": lambda s, d: encode_decode(d, RANKS, public_tokenizers.PATTERN, keep_ids=True),
    "near": lambda s, d: dart_minhash.near_duplicates(d),
    "leaks": lambda s, d: contaminated(d, items_of(s)),
    "quality": lambda s, d: quality_scores(d, labels_of(s)),
    "lm": lambda s, d: score_texts(d),
    "licenses": lambda s, d: scan_licenses(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = OPERATORS[name](spark, documents(spark, ODD)).collect()
    if name == "leaks":
        assert rows == []
        return
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(k for k, _ in ODD)
    by = {r["doc_id"]: r for r in rows}
    if name == "rules":
        assert by[2]["base_failed"] and not by[2]["kept"] and by[4]["n_words"] == 0 and by[5]["n_words"] == 60_000
    if name == "bpe":
        assert by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[3]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    if name == "near":
        assert by[1]["class_id"] == 1 and by[2]["class_id"] == 2 and by[3]["class_id"] == 3 and by[1]["class_size"] == 3
        assert {r["class_id"] for r in rows if r["doc_id"] is None} == {1, None} or {r["class_id"] for r in rows if r["doc_id"] is None} == {None}
    if name == "lm":
        assert by[2]["n_tokens"] == 1 and by[None]["held_out"] is None and by[5]["n_tokens"] == 60_001
    if name == "licenses":
        assert by[6]["base_labels"] == "mit" and by[2]["labels"] == ""


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).collect() == []


def test_no_test_items(spark):
    assert contaminated(documents(spark, ODD), items_of(spark, [])).collect() == []


def test_leaks_exact_edited_and_clean(spark):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(draw.choices(words, k=30))) for i in range(20)]
    rows = []
    for i, text in items:
        w = text.split()
        edited = [x for k, x in enumerate(w) if k % 11] and [("zz" if k % 9 == 4 else x) for k, x in enumerate(w) if k % 13 != 7]
        rows += [(100 + i, "Intro. " + text.upper() + "! outro"), (200 + i, " ".join(draw.choices(words, k=40) + edited + draw.choices(words, k=40))), (300 + i, " ".join(draw.choices(words, k=200)))]
    rows += [(1000 + k, items[0][1]) for k in range(300)]  # one test item in many documents
    found = {(r["doc_id"], r["item_id"]): r for r in contaminated(documents(spark, rows), items_of(spark, items)).collect()}
    assert set(found) == {(b + i, i) for i in range(20) for b in (100, 200)} | {(1000 + k, 0) for k in range(300)}
    assert found[(100, 0)]["score"] == 1 and (found[(100, 0)]["first_word"], found[(100, 0)]["last_word"]) == (1, 30)
    assert found[(203, 3)]["score"] < 1


@pytest.mark.parametrize("edit", ["5", "6", "3", "between", "far"])
def test_leaks_with_every_few_words_edited(spark, edit):
    """Copies without a run of kept words; exact copies elsewhere make the kept words the frequent ones."""
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(draw.choices(words, k=n))) for i, n in enumerate([4, 5, 12, 25, 30, 60])]
    rows = []
    for i, text in items:
        w = text.split()
        if edit == "between":  # one word put between every two
            copy = [x for k, a in enumerate(w) for x in ((a, f"e{k}") if k + 1 < len(w) else (a,))]
        elif edit == "far":  # all the words that a copy may have more, in the middle
            copy = w[: len(w) // 2] + [f"e{k}" for k in range(len(w))] + w[len(w) // 2 :]
        else:
            copy = [f"e{k}" if k % int(edit) == int(edit) - 1 else x for k, x in enumerate(w)]
        rows += [(100 + i, " ".join(draw.choices(words, k=80) + copy + draw.choices(words, k=80)))] + [(1000 * (i + 1) + k, text) for k in range(20)]
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(documents(spark, rows), items_of(spark, items)).collect()}
    assert set(found) >= {(100 + i, i) for i in range(len(items))}
    assert edit not in "56" or found[(105, 5)] == pytest.approx({"5": 0.7, "6": 0.75}[edit], abs=0.03)


def test_leaks_of_a_passage_of_a_long_item(spark):
    """A verbatim passage is found whatever its share of the item, at every place of the item; a shorter one is not."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    item = draw.choices(words, k=250)
    around = lambda part: " ".join([*draw.choices(words, k=60), *part, *draw.choices(words, k=60)])
    rows = [(k, around(item[k : k + 13])) for k in range(238)] + [(1000, around(item[70:170])), (1001, around(item[40:52])), (1002, around(item[:12]))]
    rows += [(2000 + k, " ".join(item[100:110])) for k in range(50)]  # a part of it is frequent
    found = {r["doc_id"]: r for r in contaminated(documents(spark, rows), items_of(spark, [(1, " ".join(item))])).collect()}
    assert set(found) == {*range(238), 1000}
    assert found[1000]["score"] == pytest.approx(0.4, abs=0.02) and found[1000]["first_word"] == 60 and found[0]["matched"] >= 13


def brute_classes(rows, similarity=0.8):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    return {rows[i][0]: least[find(i)] for i in range(len(rows))}


def test_near_duplicates_are_the_brute_force_classes(spark):
    draw = random.Random(11)
    words = [f"v{i}" for i in range(900)]
    base, rows = draw.choices(words, k=120), []
    for i in range(220):  # a large group: copies of copies, some far from all others
        source = base if i % 3 else (rows[draw.randrange(len(rows))][1].split() if rows else base)
        copy = list(source)
        for _ in range(draw.choice([0, 1, 2, 3, 5, 9])):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(draw.choices(words, k=draw.choice([1, 2, 4, 5, 6, 50, 300])))) for i in range(80)]
    rows += [(2000 + i, rows[220 + i][1].upper()) for i in range(20)] + [(3000, ""), (3001, "")]
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(documents(spark, rows)).collect()}
    want = brute_classes(rows)
    assert got == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_key_filter_has_no_false_negative(spark):
    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("k"))
    check = may_be_among(keys, "k")
    rows = spark.range(5000).select("id", check(F.xxhash64("id")).alias("may")).collect()
    assert all(r["may"] for r in rows if r["id"] % 7 == 0) and sum(r["may"] for r in rows if r["id"] % 7) < 50


def test_bpe_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    tokens = load_ranks(RANKS)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in encode_decode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect():
        ids = whole.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("known", [40, 1 << 19])
def test_lm_base_scores(spark, known):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    word, lower = re.compile(r"[^\x20\x09-\x0D]+"), {i: i + 32 for i in range(65, 91)}
    texts = {r["doc_id"]: word.findall(r["text"].translate(lower)) + [None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    count = collections.Counter(w for i, t in texts.items() if not held[i] for w in t)
    total, divisor = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    better = 0
    for r in score_texts(docs, known=known).collect():
        t = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(w in count for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(count[w] + 0.5) - divisor for w in t), abs=1e-6)
        better += r["score"] > r["base_score"]
    assert better > 0.9 * len(texts)


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_quality_classifier"](spark, sf).collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in truth if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    assert sum(rows[i]["predicted"] == truth[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows.values())


def test_classifier_with_one_class_or_none(spark):
    docs = documents(spark, ODD)
    for labels in ([], [(1, 1, 0)], [(1, 0, 0), (1, 1, 0)]):
        assert quality_scores(docs, labels_of(spark, labels)).filter("score between 0 and 1").count() == len(ODD)


def test_pages(spark):
    rows = [(1, "https://A.b/c", "<article><p>x &amp; y</p></article>", "clash"), (1, "https://A.b/c", "<article><p>x &amp; y</p></article>", "clash"), (2, None, None, None), (None, "no scheme", "", None), (3, "http://h", "<p>" + "w " * 50_000, None)]
    out = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"][:5], r["n_chars"]) for r in out) == [(0, "no scheme", "", 0), (1, "https://A.b/c", "x & y", 5), (1, "https://A.b/c", "x & y", 5), (2, "", "", 0), (3, "http://h", "w w w", 99_999)]
    assert extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


def test_pages_of_one_host_in_small_groups(spark):
    rows = [(i, "http://one.host/x", f"<div>All rights of this page reserved</div><p>a{i} b{i * i} c{i + 7} only d{i}</p>") for i in range(90)]
    out = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), host_pages=20).collect()
    assert {r["page_id"]: r["text"] for r in out} == {i: f"a{i} b{i * i} c{i + 7} only d{i}" for i in range(90)}


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_a_notice_on_an_eighth_of_a_large_host_goes(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html_text, "BROADCAST_RUNS", broadcast)
    notice = " ".join(f"notice{k}" for k in range(17))
    own = lambda i: " ".join(f"e{i}w{k}" for k in range(20))
    rows = [(i, "http://one.host/x", f"<p>a{i} b{i * i} c{i + 7} only d{i} {own(i)}</p>" + (f"<p>{notice}</p>" if i % 8 == 0 else "")) for i in range(2000)]
    rows += [(9999, "http://one.host/x", f"<p>{notice} and five words of its own</p>")] * 700
    out = extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(out) == 2700
    assert {r["page_id"]: r["text"] for r in out if r["page_id"] != 9999} == {i: f"a{i} b{i * i} c{i + 7} only d{i} {own(i)}" for i in range(2000)}
    assert {r["text"] for r in out if r["page_id"] == 9999} == {"and five words of its own"}


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[1]), rest[2]


def test_urls(spark):
    urls = ["http://Ä.Example.NET/en/x", "http://example.net", "http://net/", "https://a.org/fr/", "https://xexample.com/de/1", "https://m.example.com/de/?q", None, "", "no", "x://://y/z", "http://h/p?u=http://other/de/#f", "http://h\n/p\nq"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://net/", "clash")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, tokens string")
    out = url_filter.filter_urls(pages, labels_of(spark)).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path = url_by_hand(urls[r["page_id"]] if r["page_id"] is not None else "http://net/")
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == (max(fits)[1:] if fits else (None, "allow"))
    assert url_filter.filter_urls(pages.limit(0), labels_of(spark, [])).collect() == []


def test_url_rules_are_mined_and_matched(spark):
    pages, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        pages.append((i, f"http://{'buy-pills' if bad else 'good'}.example.com/{'shop' if i % 2 else 'win'}/{i}?ref={i}", ""))
        if i < 300:
            labels.append((i, 0 if bad else 1, 0))
    out = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"), labels_of(spark, labels)).collect()}
    assert out == {i: "block" if i % 4 == 0 else "allow" for i in range(400)}


def test_url_rules_are_mined_from_all_tokens(spark):
    """Only two of many tokens together tell the bad urls; each of the others tells more than either of the two."""
    rows = []
    for i in range(400):
        bad = i < 100
        template = [f"path:t{k}" for k in range(13)] if i < 200 else []
        own = [f"key:o{k}" for k in range(3) if i < 201 + k]
        rows.append((["path:x"] * (bad or i % 2 == 0) + ["path:y"] * (bad or i % 2 == 1) + template + own, bad))
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rules = {tuple(r["tokens"]): (r["confidence"], r["n"]) for r in url_filter.mine_rules(labelled).collect()}
    assert rules == {("path:x", "path:y"): (1.0, 100)}
    marked = spark.createDataFrame([(t + ["path:bad", "word:bad"] if b else t, b) for t, b in rows], labelled.schema)
    assert {tuple(r["tokens"]) for r in url_filter.mine_rules(marked).collect()} == {("path:bad",), ("word:bad",), ("path:x", "path:y")}


def test_chat_by_hand(spark):
    rows = [(1, 0, "ann", "hi", "x"), (1, 1, "bob", "yo", "x"), (1, 1, "bob", "yo", "x"), (1, None, "system", None, "x"), (None, 0, "ann", "lost", "x"), (2, 0, "system", "only", "x"), (3, 0, None, "é", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, speaker string")
    out = {(r["conv_id"], r["speaker"], r["part"]): r for r in chat_rotation.rotate(turns).collect()}
    assert set(out) == {(1, "ann", 0), (1, "bob", 0), (3, "unknown", 0)}
    o, c = chat_rotation.OPEN, chat_rotation.CLOSE
    assert out[(1, "ann", 0)]["text"] == f"{o}assistant\nhi{c}{o}user name=bob\nyo{c}{o}user name=bob\nyo{c}{o}system\n{c}"
    for r in out.values():
        assert all(r["text"][m["start"] : m["end"]].endswith(c) for m in r["masks"]) and len(r["masks"]) == r["n_targets"]
    assert [out[(1, "bob", 0)]["text"][m["start"] : m["end"]] for m in out[(1, "bob", 0)]["masks"]] == [f"yo{c}"] * 2
    assert chat_rotation.rotate(turns.limit(0)).collect() == []


def test_long_dialogue_is_the_sequence_of_its_parts(spark):
    turns = spark.range(1000).select(F.lit(5).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.col("id").cast("string").alias("text"))
    whole = chat_rotation.rotate(turns, part_turns=2000).filter("speaker = 'a'").first()
    parts = chat_rotation.rotate(turns, part_turns=64).filter("speaker = 'a'").orderBy("part").collect()
    assert "".join(r["text"] for r in parts) == whole["text"] and sum(r["n_turns"] for r in parts) == 1000 and len(parts) == 16


def test_registered_names_and_oracles(spark):
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    con = check_oracle.connect(SF)
    for name, sql in queries.ORACLES.items():
        df = names[name](spark, SF)
        cur = con.execute(sql)
        assert check_oracle.compare(df.columns, df.collect(), [d[0] for d in cur.description], cur.fetchall()) is None


def test_pipeline_by_hand(spark, tmp_path):
    """Stages against the operators' own rows; planted rows go or stay as they must."""
    draw = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    clean = {i: " ".join(draw.choices(words, k=120)) for i in range(60)}
    rows = [(i, t, "en", "s", len(t)) for i, t in clean.items()]
    item = " ".join(draw.choices(words, k=25))
    rows += [(100, clean[3], "en", "s", 1), (101, clean[4] + " more", "en", "s", 1), (3, clean[3], "en", "s", 1)]  # copies
    rows += [(102, " ".join(draw.choices(words, k=60)) + " " + item, "en", "s", 1)]  # leak
    rows += [(103, "spam " * 80, "en", "s", 1), (104, None, None, None, None), (105, "too short", "en", "s", 1), (None, " ".join(draw.choices(words, k=70)), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    items_of(spark, [(1, item)]).write.parquet(f"{folder}/benchmark.parquet")
    junk = [(i, 1, 0) for i in range(40)] + [(103, 0, 0)]
    labels_of(spark, junk).write.parquet(f"{folder}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "quality_classifier", "near_duplicates", "decontamination", "byte_bpe"]
    read = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in df.collect())
    all_ids = sorted(r[0] if r[0] is not None else -1 for r in rows)
    ruled = stage["quality_rules"](spark, read, folder)
    assert ruled.columns == read.columns and ids(ruled) == [i for i in all_ids if i not in (103, 104, 105)]
    once = stage["near_duplicates"](spark, ruled, folder)
    assert once.columns == read.columns and ids(once) == [-1, *range(60), 102]
    clear = stage["decontamination"](spark, once, folder)
    assert clear.columns == read.columns and ids(clear) == [-1, *range(60)]
    out = corpus_pipeline.run(spark, folder)
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert {r["doc_id"] for r in out.collect()} <= {None, *range(60)} and out.count() >= 50


def test_pipeline_over_odd_tables(spark, tmp_path):
    """Clashing column names, thousands of equal rows, null rows and an empty table."""
    draw = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    rows = [(i, " ".join(draw.choices(words, k=90))) for i in range(30)]
    rows += [rows[7]] * 3000 + [(None, rows[8][1]), (None, None), (77, None)]
    labels_of(spark, [(i, 1, 0) for i in range(30)]).write.parquet(f"{tmp_path}/labels.parquet")
    items_of(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = dict(corpus_pipeline.STAGES)
    for table in (documents(spark, rows), documents(spark, rows).limit(0)):
        table = table.withColumn("__k", F.lit(1))
        for name in ("quality_rules", "quality_classifier", "near_duplicates", "decontamination"):
            assert stage[name](spark, table, str(tmp_path)).columns == table.columns
    kept = stage["near_duplicates"](spark, documents(spark, rows), str(tmp_path)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None) for r in kept) == sorted([(False, i, False) for i in range(30)] + [(False, 77, True), (True, 0, True)])
    documents(spark, rows).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
