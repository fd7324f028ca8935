"""Conversation repair, SimHash components and collocations: brute force, odd rows, ties, empty tables."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from tilewright.llm import collocations, simhash, turn_repair
from tilewright.llm.turn_repair import damage, parse, repair, repair_report

SF = "/root/testdata/sf0.001"
CLASHES = ["lang", "source", "n_chars", "node", "root", "fp", "t", "h", "m", "n", "comp", "key", "left", "right", "score", "rank", "_c", "_t", "_f", "_x", "lost2", "audit", "part", "position", "kind", "component_id"]


def wide(spark, rows, schema, drop=()):
    extra = [c for c in CLASHES if c not in drop]
    return spark.createDataFrame([(*r, *["clash"] * len(extra)) for r in rows], schema + ", " + ", ".join(f"`{c}` string" for c in extra))


# conversation repair


def brute(turns):
    """Least (cost, audit) over all edits of cost 2 a turn or less: deleting all costs that."""
    limit, best = 2 * len(turns), (2 * len(turns), "D" * len(turns))

    def go(at, cost, audit, roles):
        nonlocal best
        if cost > limit:
            return
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit))
        for role in "ua":
            go(at, cost + 5, audit + "I", roles + role)
        if at < len(turns):
            role, fault = turns[at]
            go(at + 1, cost + 2, audit + "D", roles)
            if fault != "d":
                stay = 5 if fault == "t" else 0
                go(at + 1, cost + stay, audit + "K", roles + role)
                for other in "ua":
                    go(at + 1, cost + 1 + stay, audit + "R", roles + other)

    go(0, 0, "", "")
    return best


def test_cheapest_edits_against_all_edits():
    draw = random.Random(3)
    cases = [list(c) for n in range(3) for c in itertools.product([(r, f) for r in "suaxDP" for f in "kdt"], repeat=n)]
    cases += [[(draw.choice("ssuuuaaax"), draw.choice("kkkkdt")) for _ in range(draw.choice([3, 4, 5]))] for _ in range(250)]
    for turns in cases:
        ends = parse("".join(r + f for r, f in turns))
        assert min(v for node, v in ends.items() if turn_repair.LR.accepts(node)) == brute(turns), turns


def test_automaton_has_few_stacks_and_shares_nodes():
    assert len(turn_repair.STACKS) == 6 and len(parse("uk" * 500)) <= 6
    before = len(turn_repair.LR.nodes)
    parse("ukaksk" * 200)
    assert len(turn_repair.LR.nodes) == before


def expected_report(rows):
    """Plain version of a report over (turn, role, text) rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    seen, said, counts = set(), [], collections.Counter()
    for _, role, text in rows:
        kept = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "b" if not kept else "d" if (role, text) in seen else "k" if kept[-1] in ".!?" else "t"
        seen.add((role, text))
        counts[fault] += 1
        said.append((role[:1] or "-", "d" if fault in "bd" else fault))
    cost, audit = min(v for node, v in parse("".join(r + f for r, f in said)).items() if turn_repair.LR.accepts(node))
    out, at = [], 0
    letters = [c for c in audit if c != "D"]
    system = 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at][1:]
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            system += role[:1] == "s" and not out
        else:
            role = ("user", "assistant")[(len(out) - system) % 2]
        out.append(f"{role}:{text}")
    assert len(letters) == len(out)
    times = [t for t, _, _ in rows if t is not None]
    gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
    initials = [r for r, _ in said]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_reports_of_odd_and_long_conversations(spark):
    draw = random.Random(4)
    rows = []
    for c in [*range(40), None]:
        for _ in range(draw.choice([1, 2, 5, 9])):
            rows.append((c, draw.choice([None, 0, 1, 2, 3, 7, -2]), draw.choice(["user", "assistant", "system", "tool", "", None, "Dan", "Pat"]), draw.choice(["Yes.", "No", "", None, " \t", "Why? ", "é!", "a:b\nc."])))
    rows += [(100, k, draw.choice(["user", "assistant"]), draw.choice([f"Text {k}.", f"Text {k}.", "Same.", "Cut", ""])) for k in range(3000)]
    rows += [(101, 5, "user", "Again and again.")] * 1500 + [(101, 6, "assistant", "Yes.")]
    turns = wide(spark, rows, "conv_id bigint, turn bigint, role string, text string", drop=("turn", "role", "text"))
    expected = collections.defaultdict(list)
    for c, t, role, text in rows:
        expected[c].append((t, " " if role is None else role, " " if text is None else text))
    for size in (7, 64, 1024):
        found = repair_report(turns.repartition(5), size=size).collect()
        assert len(found) == len(expected)
        for row in found:
            assert tuple(row)[1:] == expected_report(expected[row["conv_id"]]), (size, row["conv_id"])


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Bye."), (2, 0, "user", "Hm"), (3, 0, "user", "A."), (3, 1, "assistant", "B."), (3, 1, "assistant", "B.")]
    told, repaired = repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in told.collect()} == {1: (2, "KRR"), 2: (2, "D"), 3: (2, "KKD")}
    assert sorted(tuple(r) for r in repaired.collect()) == [(1, 0, "system", "Be kind.", "K"), (1, 1, "user", "Hello.", "R"), (1, 2, "assistant", "Bye.", "R"), (3, 0, "user", "A.", "K"), (3, 1, "assistant", "B.", "K")]


def test_repair_of_lost_rows_and_empty_tables(spark):
    turns = spark.createDataFrame([(0, None, None, None, True), (1, 0, "user", "A.", False), (1, None, None, None, True), (1, 1, "assistant", "B.", None)], "conv_id bigint, turn bigint, role string, text string, lost boolean")
    found = {r["conv_id"]: tuple(r)[1:] for r in repair_report(turns, lost="lost").collect()}
    assert found[0] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[1][:7] == (0, 0, 0, 0, 0, 0, "KK")
    assert repair_report(damage(turns.limit(0)), lost="lost").collect() == []


def test_damage_keeps_every_conversation(spark):
    turns = spark.createDataFrame([(c, t, "user", "A. b!") for c in range(200) for t in (None, 0)] + [(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    found = damage(turns)
    assert found.select("conv_id").distinct().count() == 201
    assert {tuple(r) for r in found.select("role", "text", "lost").distinct().collect()} >= {(None, None, True), ("user", "", False), ("user", "A b", False), ("user", "A. b!", False)}
    assert repair_report(found, lost="lost").count() == 201


# SimHash


def test_xxh64_of_spans():
    draw = random.Random(1)
    data = bytes(draw.randrange(256) for _ in range(3000))
    starts = np.array([draw.randrange(2700) for _ in range(2000)])
    sizes = np.array([draw.choice([0, 1, 3, 4, 7, 8, 12, 31, 32, 33, 64, 100, 300]) for _ in range(2000)])
    got = simhash.xxh64(np.frombuffer(data, np.uint8), starts, sizes)
    assert [int(g) for g in got] == [xxhash.xxh64_intdigest(data[a : a + b], 42) for a, b in zip(starts, sizes)]


def plain_print(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=4):
    """Component number of each of the distinct prints, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= distance) + i + 1:
            root[find(i)] = find(int(j))
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("n", [1, 1 << 20, 1 << 27, 1 << 36, 1 << 44])
def test_masks_leave_no_pair_apart(n):
    masks = simhash.block_masks(n)
    for flipped in itertools.chain(itertools.combinations(range(0, 64, 5), 4), ((0, 13, 26, 39), (0, 63, 31, 32), (12, 13, 14, 15))):
        assert any(not any(mask >> b & 1 for b in flipped) for mask in masks)
    with_five = [tuple(random.Random(k).sample(range(64), 4)) for k in range(500)]
    assert all(any(not any(mask >> b & 1 for b in f) for mask in masks) for f in with_five)


def test_links_of_crowded_buckets(spark):
    """Clouds of prints around centres: large buckets with members in and out of the main component."""
    draw = random.Random(6)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for centre in [draw.getrandbits(64) for _ in range(3)]:
        for _ in range(700):
            flips = draw.choice([1, 2, 3, 5, 7, 9, 11])
            prints.add(centre ^ sum(1 << b for b in draw.sample(range(64), flips)))
    prints = np.array(sorted(prints), np.uint64)
    nodes = spark.createDataFrame([(int(p), k % 5 + 1) for k, p in enumerate(prints.view(np.int64))], "fp bigint, n bigint")
    expected = plain_components(prints)
    for unit in (16, 100, 8192):
        edges = [(r["a"], r["b"]) for r in simhash.links(nodes, unit=unit).collect()]
        as_bits = lambda x: x & ((1 << 64) - 1)
        assert all(bin(as_bits(a) ^ as_bits(b)).count("1") <= 4 for a, b in edges)
        place = {int(p): i for i, p in enumerate(prints)}
        root = list(range(len(prints)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in edges:
            root[find(place[as_bits(a)])] = find(place[as_bits(b)])
        groups = collections.defaultdict(set)
        for i in range(len(prints)):
            groups[expected[i]].add(find(i))
        assert all(len(g) == 1 for g in groups.values()) and len({find(i) for i in range(len(prints))}) == len(groups)
        assert len(edges) < 40 * len(prints)


def test_near_copies_against_brute_force(spark):
    draw = random.Random(2)
    rows = [(k, " ".join(draw.choices(["One", "two", "three\t", "four", "é漢", "five."], k=draw.choice([0, 1, 2, 3, 4, 5, 8])))) for k in range(300)]
    base = draw.choices([f"w{i}" for i in range(200)], k=150)
    rows += [(1000 + k, " ".join(w if draw.random() > 0.01 else "x" for w in base)) for k in range(200)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (None, None), (2000, None), (2001, ""), (2002, " \n\t "), (2003, "y " * 100_000), (2004, "Y " * 99_999 + "y")]
    docs = wide(spark, rows, "doc_id bigint, text string", drop=("doc_id", "text"))
    found = simhash.near_copies(docs).collect()
    assert len(found) == len(rows) and collections.Counter(r["doc_id"] for r in found) == collections.Counter(k for k, _ in rows)
    own = {k: plain_print(text) for k, text in {t: t for _, t in rows}.items()}
    prints = np.array(sorted(set(own.values())), np.uint64)
    root = dict(zip((int(p) for p in prints), plain_components(prints)))
    least = {}
    for k, text in rows:
        least[root[own[text]]] = min(x for x in (least.get(root[own[text]]), k) if x is not None) if (k is not None or least.get(root[own[text]]) is not None) else None
    expected = collections.Counter((k, own[text], least[root[own[text]]]) for k, text in rows)
    assert collections.Counter((r["doc_id"], r["fp"] & ((1 << 64) - 1), r["component_id"]) for r in found) == expected
    assert simhash.near_copies(docs.limit(0)).collect() == []


def test_fingerprint_text(spark):
    rows = spark.createDataFrame([(0,), (-1,), (255,)], "fp bigint").select(simhash.hex_print("fp").alias("h")).collect()
    assert [r["h"] for r in rows] == ["0" * 16, "f" * 16, "0" * 14 + "ff"]


# collocations


def odd_texts():
    draw = random.Random(7)
    words = ["the", "of", "New", "york", "CITY", "a\x1cb", "é", "漢字", "-", "x\x0by", "big", "apple"]
    rows = []
    for k in range(1500):
        text = "".join(draw.choice(words[: draw.choice([3, 6, 12])]) + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "; "]) for _ in range(draw.choice([0, 1, 5, 40])))
        rows.append((k, draw.choice(["en", "de", None, "und", ""]), text))
    return rows + [(1, "en", None), (2, None, None), (3, "en", ""), (4, "en", " .,;\n"), (None, "fr", "so it goes " * 3000), (5, "en", rows[0][2]), (5, "en", rows[0][2])]


@pytest.mark.parametrize("ranked", [1 << 20, 40, 3, 0])
def test_collocations_against_sql(spark, ranked, monkeypatch):
    monkeypatch.setattr(collocations, "FILTER_BITS", (1 << 17, 1 << 18))
    rows = odd_texts()
    docs = wide(spark, rows, "doc_id bigint, lang string, text string", drop=("lang",))
    found = [tuple(r) for r in collocations.collocations(docs.repartition(3), ranked=ranked).collect()]
    con = duckdb.connect()
    documents = docs.select("doc_id", "lang", "text").toArrow()  # noqa: F841
    con.register("documents", documents)
    expected = con.execute(collocations.ORACLE).fetchall()
    assert len(expected) > 100 and sorted(found) == sorted(expected)


def test_collocations_cut_to_the_best(spark):
    rows = [(k, "en", " ".join(f"w{i}" for i in range(60))) for k in range(12)] + [(k, "en", "w1 w3. w3 w1. w5 w9") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    every = sorted((r["rank"], r["phrase"]) for r in collocations.collocations(docs).collect())
    few = sorted((r["rank"], r["phrase"]) for r in collocations.collocations(docs, top=7).collect())
    assert few == every[:7] and [r for r, _ in every] == list(range(1, len(every) + 1))
    assert "w1 w2" not in {p for _, p in every} and "w1 w3" in {p for _, p in every}  # the pair lies in a triple
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_pair_tiles_count_like_a_counter(monkeypatch):
    monkeypatch.setattr(collocations, "BUFFER", 20_000)
    monkeypatch.setattr(collocations, "FULL", 500)
    draw = np.random.default_rng(1)
    tiles, expected, found = collocations.PairTiles(), collections.Counter(), collections.Counter()

    def take(at_end):
        for left, right, n in tiles.take(at_end):
            for a, b, c in zip(left.tolist(), right.tolist(), n.tolist()):
                found[a, b] += c

    for _ in range(12):
        left, right = (np.minimum(draw.zipf(1.3, 9000) - 1, (1 << 20) - 1).astype(np.int64) for _ in range(2))
        expected.update(zip(left.tolist(), right.tolist()))
        tiles.add(left, right)
        take(False)
    take(True)
    assert found == expected and len(tiles.tiles) > 1


def test_scores_beyond_64_bits(spark):
    a, left, right = 9_999_999_999_999, 10_000_000_000_001, 12_345_678_901_234
    value = spark.range(1).selectExpr(f"{collocations.score(f'{a}L', f'{left}L', f'{right}L')} as v").first()["v"]
    assert value == 1_000_000 * a * a // (left * right)
