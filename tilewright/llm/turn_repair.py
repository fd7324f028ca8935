"""Repair of conversation structure by generalised LR parsing with weighted edits (operator 11)."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.textops import ready
from tilewright.session import cut_lineage

# a conversation is nothing, or pairs of user and assistant turns, behind a system turn or not;
# left recursion keeps the stacks short, whatever the length of a conversation
GRAMMAR = [("D", ""), ("D", "P"), ("P", "ua"), ("P", "sua"), ("P", "Pua")]
START = "D"
FILLS = {"u": "user", "a": "assistant"}  # roles that a rerole or an insert can give
KEEP, REROLE, DELETE, INSERT = (0, "K"), (1, "R"), (2, "D"), (5, "I")  # cost and initial of each edit
TRUNCATED_COST = 5  # of a truncated turn that stays
SEGMENT = 1024  # turns that are parsed at once
NULLS = " "  # stands for a null

SPACE = r"[\x20\x09-\x0D]"

Value = tuple[int, str]  # cost and audit


class Automaton:
    """LR(0) automaton of the grammar and its stacks.

    A stack is a node of (LR state, node below it). Nodes are made once and shared by all
    parses, so the stacks of all of them form one graph, and equal stack tops are the same
    node. Reductions run at once after a shift.
    """

    def __init__(self, grammar: list[tuple[str, str]], start: str) -> None:
        self.rules, self.heads = grammar, {head for head, _ in grammar}
        begin = self.closure({(i, 0) for i, (head, _) in enumerate(grammar) if head == start})
        self.states: list[frozenset] = [begin]
        self.go: list[dict[str, int]] = []
        for state in self.states:  # grows while it is read
            after: dict[str, set] = {}
            for rule, dot in state:
                if dot < len(grammar[rule][1]):
                    after.setdefault(grammar[rule][1][dot], set()).add((rule, dot + 1))
            row = {}
            for symbol, items in sorted(after.items()):
                target = self.closure(items)
                if target not in self.states:
                    self.states.append(target)
                row[symbol] = self.states.index(target)
            self.go.append(row)
        self.start = start
        self.nodes: list[tuple[int, int]] = [(0, -1)]  # LR state, node below
        self.ids = {(0, -1): 0}
        self.shifted: dict[tuple[int, str], tuple[int, ...]] = {}

    def closure(self, items: set) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            body = self.rules[rule][1]
            for i, (head, _) in enumerate(self.rules):
                if dot < len(body) and head == body[dot] and (i, 0) not in items:
                    items.add((i, 0))
                    todo.append((i, 0))
        return frozenset(items)

    def push(self, node: int, symbol: str) -> int | None:
        state = self.go[self.nodes[node][0]].get(symbol)
        if state is None:
            return None
        if (state, node) not in self.ids:
            self.ids[(state, node)] = len(self.nodes)
            self.nodes.append((state, node))
        return self.ids[(state, node)]

    def reduced(self, node: int) -> list[int]:
        """The stack itself and all that reductions make of it."""
        found, todo = [node], [node]
        while todo:
            top = todo.pop()
            for rule, dot in self.states[self.nodes[top][0]]:
                head, body = self.rules[rule]
                if dot < len(body) or head == self.start or not body:
                    continue
                below = top
                for _ in body:
                    below = self.nodes[below][1]
                made = self.push(below, head)
                if made is not None and made not in found:
                    found.append(made)
                    todo.append(made)
        return found

    def shift(self, node: int, terminal: str) -> tuple[int, ...]:
        """Stacks after a terminal; of those with no way on but a reduction only the reduced ones."""
        key = (node, terminal)
        if key not in self.shifted:
            made = None if terminal in self.heads else self.push(node, terminal)
            stacks = [] if made is None else self.reduced(made)
            self.shifted[key] = tuple(s for s in stacks if self.go[self.nodes[s][0]] or self.accepts(s))
        return self.shifted[key]

    def accepts(self, node: int) -> bool:
        """Whether the stack's turns are a whole conversation."""
        state, below = self.nodes[node]
        for rule, dot in self.states[state]:
            head, body = self.rules[rule]
            if head == self.start and dot == len(body):
                bottom = node
                for _ in body:
                    bottom = self.nodes[bottom][1]
                if bottom == 0:
                    return True
        return False

    def reachable(self) -> list[int]:
        """Stacks between two turns, from the empty one on, in a fixed order."""
        found = [0]
        for node in found:  # grows while it is read
            for terminal in sorted({c for _, body in self.rules for c in body} - self.heads):
                found += [s for s in self.shift(node, terminal) if s not in found]
        return found


LR = Automaton(GRAMMAR, START)
STACKS = LR.reachable()  # six; a segment's parse begins and ends in one of them


def _better(found: dict[int, Value], node: int, value: Value) -> bool:
    if node in found and found[node] <= value:
        return False
    found[node] = value
    return True


def _insert(tops: dict[int, Value]) -> dict[int, Value]:
    todo = list(tops)
    while todo:
        node = todo.pop()
        cost, audit = tops[node]
        for terminal in FILLS:
            for made in LR.shift(node, terminal):
                if _better(tops, made, (cost + INSERT[0], audit + INSERT[1])):
                    todo.append(made)
    return tops


@lru_cache(maxsize=1 << 14)
def parse(turns: str, entry: int = 0) -> dict[int, Value]:
    """Cheapest (cost, audit) for each stack that a parse of `turns` can end in, from the stack `entry`.

    Two characters a turn: the initial of its role, and `d` if it has to go, `t` if it is
    truncated, `k` else. All parses go on side by side; where their stack tops become equal,
    the least (cost, audit) stays. That is exact: at equal cost no audit of the same turns is
    a beginning of another one, so what follows does not change their order.
    """
    tops = _insert({entry: (0, "")})
    for at in range(0, len(turns), 2):
        initial, fault = turns[at], turns[at + 1]
        stays = TRUNCATED_COST if fault == "t" else 0
        new: dict[int, Value] = {}
        for node, (cost, audit) in tops.items():
            _better(new, node, (cost + DELETE[0], audit + DELETE[1]))
            if fault == "d":
                continue
            for made in LR.shift(node, initial):
                _better(new, made, (cost + KEEP[0] + stays, audit + KEEP[1]))
            for terminal in FILLS:
                for made in LR.shift(node, terminal):
                    _better(new, made, (cost + REROLE[0] + stays, audit + REROLE[1]))
        tops = _insert(new)
    return tops


class Audit:
    """An audit as a chain of pieces, one for each segment, so that a long one is not copied at each step."""

    __slots__ = ("before", "piece", "depth")

    def __init__(self, before: Audit | None, piece: str) -> None:
        self.before, self.piece, self.depth = before, piece, 0 if before is None else before.depth + 1

    def pieces(self, until: Audit | None = None) -> str:
        out, at = [], self
        while at is not until:
            out.append(at.piece)
            at = at.before
        return "".join(reversed(out))

    def __lt__(self, other: Audit) -> bool:
        x, y = self, other
        while x is not y and x is not None and y is not None:  # chains of one conversation have one piece a segment
            x, y = x.before, y.before
        return self.pieces(x) < other.pieces(y)


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, lost: the test damage, decided by crc32 of `conv:turn` modulo 20.

    0 loses the row (it stays as one of null turn, role and text with `lost`, so that its
    conversation is still known), 1 empties the text, 2 takes its sentence ends out, 3 repeats
    the row, 4 makes it the user's. Nulls of any column read as one space.
    """
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULLS))
    kind = F.crc32(F.concat_ws(":", as_text(conv), as_text(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), kind.alias("_k"))
    lost = F.col("_k") == 0
    return rows.select(
        "conv_id",
        F.when(~lost, F.col("turn")).alias("turn"),
        F.when(lost, None).when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(lost, None).when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        lost.alias("lost"),
        F.explode(F.when(F.col("_k") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    ).drop("_copy")


def _turns(turns: DataFrame, conv: str, turn: str, role: str, text: str, lost: str | None) -> DataFrame:
    """_c, _t, _r, _x of every turn; a lost one has no role. `_d` stands for the text in orders and comparisons."""
    gone: Column = F.lit(False) if lost is None else F.coalesce(F.col(lost), F.lit(False))
    here = lambda c: F.when(~gone, F.coalesce(F.col(c), F.lit(NULLS)))
    rows = turns.select(F.col(conv).cast("bigint").alias("_c"), F.when(~gone, F.col(turn).cast("bigint")).alias("_t"), here(role).alias("_r"), here(text).alias("_x"))
    return rows.withColumn("_d", F.unhex(F.md5("_x")))


def narrow_turns(turns: DataFrame) -> DataFrame:
    """_c, _t, _r, _d, _f, _m, _again: one row for equal turns, its first fault by its text, their number, and whether its role and text come earlier."""
    end = F.regexp_extract("_x", rf"([^\x20\x09-\x0D]){SPACE}*\z", 1)
    fault = F.when(end == "", "b").when(~end.isin(".", "!", "?"), "t").otherwise("k")
    rows = turns.select("_c", "_t", "_r", "_d", fault.alias("_f")).groupBy("_c", "_t", "_r", "_d", "_f").agg(F.count("*").alias("_m"))
    rows = rows.withColumn("_o", F.coalesce("_t", F.lit(-(1 << 63))))
    several = rows.filter("_r is not null").groupBy("_c", "_r", "_d").agg(F.min("_o").alias("first"), F.count("*").alias("places")).filter("places > 1")
    first = several.select(F.col("_c").alias("c2"), F.col("_r").alias("r2"), F.col("_d").alias("d2"), "first")
    same = F.col("_c").eqNullSafe(F.col("c2")) & (F.col("_r") == F.col("r2")) & (F.col("_d") == F.col("d2"))
    return rows.join(first, same, "left").select("_c", "_t", "_r", "_d", "_f", "_m", F.coalesce(F.col("_o") > F.col("first"), F.lit(False)).alias("_again"))


SEGMENTS = "_c bigint, part int, nth int, first bigint, last bigint, distinct_turns bigint, head string, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, entry int, exit int, cost bigint, audit string"
REPORT = "_c bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
REPAIRED = "_c bigint, position bigint, role string, text string, edit string"
LEGAL = ("su", "ua", "au")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _in_batches(rows, schema: str, size: int = 2048):
    """Arrow batches of the rows that a generator gives, as they come."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _python_rows(batches):
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _faults(stretch: list[tuple]) -> tuple:
    """What SEGMENTS tells of a stretch's (turn, initial, fault, copies) rows besides the edits, and the parser's input."""
    own = [row for row in stretch if row[1] is not None]
    said = "".join(i + ("d" if f in "bd" else f) + (i + "d") * (m - 1) for _, i, f, m in own)
    times = [t for t, *_ in own if t is not None]
    initials = said[::2]
    return said, (
        times[0] if times else None,
        times[-1] if times else None,
        len(set(times)),
        initials[:1] or None,
        initials[-1:] or None,
        sum(m for _, _, f, m in own if f == "b"),
        sum(m if f == "d" else m - 1 for _, _, f, m in own if f != "b"),
        sum(f == "t" for _, _, f, _ in own),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
    )


def segments(narrow: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Rows of SEGMENTS: stretches of at most `size` turns, and the cheapest edits from each stack to each.

    The rows of all conversations are put in order by ranges, so a conversation of any size is
    spread over tasks; a stretch that may not be its conversation's first is parsed from every
    stack. (part, nth) is the order of stretches.
    """
    ready(narrow.sparkSession)
    order = ["_c", "_t", "_r", "_d"]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("_c", "_t", "_r", "_f", "_m", "_again")

    def stretches(rows):
        """(conversation, number of the stretch, whether its conversation begins here for certain, rows)."""
        held, length, now, nth, begun, opened = [], 0, None, 0, False, False
        for c, t, r, f, m, again in rows:
            if not begun or c != now:
                if held:
                    yield now, nth, opened, held
                held, length, now, nth, opened, begun = [], 0, c, 0, begun, True
            initial = None if r is None else r[:1] or "-"
            fault = "d" if again and f != "b" else f
            while m > 0:  # equal turns behind the first one are duplicates
                some = min(m, size - length)
                held.append((t, initial, fault, some))
                m, length, fault = m - some, length + some, fault if fault == "b" else "d"
                if length == size:
                    yield now, nth, opened, held
                    held, length, nth = [], 0, nth + 1
        if held:
            yield now, nth, opened, held

    def run(batches):
        part = TaskContext.get().partitionId()

        def rows():
            for c, nth, opened, stretch in stretches(_python_rows(batches)):
                said, facts = _faults(stretch)
                for entry in STACKS[:1] if opened and nth == 0 else STACKS:
                    for node, (cost, audit) in parse(said, entry).items():
                        yield c, part, nth, *facts, STACKS.index(entry), STACKS.index(node), cost, audit

        yield from _in_batches(rows(), SEGMENTS)

    return placed.mapInArrow(run, SEGMENTS)


class _Fold:
    """What is known of a conversation after some of its stretches."""

    def __init__(self) -> None:
        self.tops: dict[int, tuple[int, Audit]] = {0: (0, Audit(None, ""))}
        self.low = self.high = self.tail = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, rows: list[tuple]) -> None:
        first, last, distinct, head, tail, blank, duplicate, truncated, illegal = rows[0][3:12]
        if first is not None:
            self.distinct += distinct - (first == self.high)
            self.low, self.high = first if self.low is None else self.low, last
        if head is not None:
            self.illegal += illegal + (self.tail is not None and self.tail + head not in LEGAL)
            self.tail = tail
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        new: dict[int, tuple[int, Audit]] = {}
        for *_, entry, exit_, cost, audit in rows:
            if entry in self.tops:
                before = self.tops[entry]
                value = (before[0] + cost, Audit(before[1], audit))
                if exit_ not in new or value[0] < new[exit_][0] or (value[0] == new[exit_][0] and value[1] < new[exit_][1]):
                    new[exit_] = value
        self.tops = new

    def report(self) -> tuple:
        ends = [(cost, audit.pieces()) for node, (cost, audit) in self.tops.items() if LR.accepts(STACKS[node])]
        cost, audit = min(ends)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def reports(found: DataFrame) -> DataFrame:
    """One row of REPORT for each conversation, from its stretches in order."""
    dealt = found.repartition("_c").sortWithinPartitions("_c", "part", "nth")

    def rows(stream):
        fold, now, held = None, None, []
        for row in stream:
            if held and row[:3] != held[0][:3]:
                fold.add(held)
                held = []
            if fold is None or row[0] != now:
                if fold is not None:
                    yield now, *fold.report()
                fold, now = _Fold(), row[0]
            held.append(row)
        if fold is not None:
            fold.add(held)
            yield now, *fold.report()

    return dealt.mapInArrow(lambda batches: _in_batches(rows(_python_rows(batches)), REPORT), REPORT)


def rewrite(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Rows of REPAIRED, in order within a conversation, from its turns and its audit (_c, audit).

    The audit is the first row of its conversation's stream, the turns follow in order; a task
    holds one audit (a byte a turn) and a batch of turns. All of a conversation passes through
    one task, since what is made of it (a text, a digest) is one sequence.
    """
    ready(turns.sparkSession)
    empty = F.lit(None)
    first = audits.select("_c", F.lit(0).alias("_kind"), empty.cast("bigint").alias("_t"), F.lit("").alias("_r"), F.col("audit").alias("_x"), empty.cast("binary").alias("_d"))
    own = turns.filter("_r is not null").select("_c", F.lit(1).alias("_kind"), "_t", "_r", "_x", "_d")
    stream = first.unionByName(own).repartition("_c").sortWithinPartitions("_c", "_kind", "_t", "_r", "_d").select("_c", "_kind", "_r", "_x")

    def rows(stream):
        audit, at, node, position, now = "", 0, 0, 0, None

        def put(edit, role):
            nonlocal node, position
            node = LR.shift(node, role[:1])[0]
            position += 1
            return position - 1, role, edit

        def filled():
            return next(name for initial, name in FILLS.items() if LR.shift(node, initial))

        def inserted():
            nonlocal at
            while at < len(audit) and audit[at] == INSERT[1]:
                at += 1
                place, role, edit = put(INSERT[1], filled())
                yield now, place, role, "", edit

        for c, kind, role, text in stream:
            if kind == 0:
                yield from inserted()
                audit, at, node, position, now = text, 0, 0, 0, c
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit != DELETE[1]:
                place, new_role, edit = put(edit, filled() if edit == REROLE[1] else role)
                yield now, place, new_role, text, edit
        yield from inserted()

    return stream.mapInArrow(lambda batches: _in_batches(rows(_python_rows(batches)), REPAIRED, 256), REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """(_c, repaired_sha256) of the `role:text` lines of each conversation, right behind `rewrite` in the same tasks."""

    def rows(stream):
        state, now = None, None
        for c, position, role, text, _ in stream:
            if position == 0:
                if state is not None:
                    yield now, state.hexdigest()
                state, now = hashlib.sha256(), c
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        if state is not None:
            yield now, state.hexdigest()

    schema = "_c bigint, repaired_sha256 string"
    return repaired.mapInArrow(lambda batches: _in_batches(rows(_python_rows(batches)), schema), schema)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", lost: str | None = None, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired turns) of every conversation.

    A report has the conversation's key, gaps (missing turn numbers), blank, duplicate and
    truncated turns (the first fault of each counts), illegal (neighbours whose roles' initials
    are not su, ua or au), cost, and audit: the initials of the cheapest edits, Keep, Rerole,
    Delete and Insert, that make its roles nothing or pairs of user and assistant, behind a
    system turn or not; of equal cost the least in ASCII order. Blank and duplicate turns have
    to go. The repaired turns are rows (key, position, role, text, edit) in order.

    Turns are in order of (turn, role, digest of the text), null turns first; equal rows are
    repeated turns, and -2^63 is not told from a null turn where a repeat is looked for. A null
    role or text is one space. Rows that the column `lost` marks only make their conversation
    known; one without other rows has a report of zeros. Null keys are one conversation. A
    long conversation is parsed in stretches of `size` turns by different tasks; its edits are
    those of the whole. An empty table gives nothing; other columns are not read.
    """
    rows = _turns(turns, conv, turn, role, text, lost)
    told = cut_lineage(reports(segments(narrow_turns(rows), size)))
    repaired = rewrite(rows, told.select("_c", "audit"))
    return told.withColumnRenamed("_c", conv), repaired.withColumnRenamed("_c", conv)


def repair_report(turns: DataFrame, conv: str = "conv_id", lost: str | None = None, size: int = SEGMENT, **columns: str) -> DataFrame:
    """Reports with the SHA-256 of the repaired `role:text` lines; nulls and ties as in `repair`."""
    told, repaired = repair(turns, conv, lost=lost, size=size, **columns)
    hashed = digests(repaired.withColumnRenamed(conv, "_c"))
    joined = told.join(hashed, F.col(conv).eqNullSafe(F.col("_c")), "left")
    return joined.select(*told.columns, F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


ORACLE = r"""
with recursive keyed as (
  select rid, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         list_transform(range(1, length(k) + 1), lambda i: unicode(substr(k, i, 1))) as bytes
  from (select *, row_number() over () as rid, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations) q
), coded as (
  select rid, conv_id, turn, role, text,
         xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes::bigint[]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 20 as kind
  from keyed
), rows as (
  select rid, copy, conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from coded, lateral (select unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy) c
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), rid, copy) as n, row_number() over (partition by conv_id, role, text order by turn nulls first, rid, copy) as nth,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) as e from rows
), judged as (
  select *, case when e = '' then 'b' when nth > 1 then 'd' when e not in ('.', '!', '?') then 't' else 'k' end as f, left(role, 1) as i,
         left(lag(role) over (partition by conv_id order by n), 1) as before from placed
), facts as (
  select conv_id, count(*) as rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 'b') as blank, count(*) filter (f = 'd') as duplicate,
         count(*) filter (f = 't') as truncated, count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id
), steps as (
  -- best (cost, audit) with no turn, after a system turn, after a user, after a pair; inserts are added behind each step
  select conv_id, 0 as n, {'c': 0, 'a': ''} as z, {'c': 1000000000, 'a': ''} as s, {'c': 5, 'a': 'I'} as u, {'c': 10, 'a': 'II'} as p from facts
  union all
  select conv_id, n, z, s, u1, list_min([p0, {'c': u1.c + 5, 'a': u1.a || 'I'}]) from (
    select conv_id, n, z, s, p0, list_min([u0, {'c': z.c + 5, 'a': z.a || 'I'}, {'c': s.c + 5, 'a': s.a || 'I'}, {'c': p0.c + 5, 'a': p0.a || 'I'}]) as u1 from (
      select t.conv_id, j.n, {'c': z.c + 2, 'a': z.a || 'D'} as z,
        list_min([{'c': s.c + 2, 'a': s.a || 'D'}, {'c': z.c + k.stay + if(i = 's', 0, 1000000000), 'a': z.a || 'K'}]) as s,
        list_min([{'c': u.c + 2, 'a': u.a || 'D'}, {'c': z.c + k.stay + k.uc, 'a': z.a || k.ul}, {'c': s.c + k.stay + k.uc, 'a': s.a || k.ul}, {'c': p.c + k.stay + k.uc, 'a': p.a || k.ul}]) as u0,
        list_min([{'c': p.c + 2, 'a': p.a || 'D'}, {'c': u.c + k.stay + k.ac, 'a': u.a || k.al}]) as p0
      from steps t join judged j on j.conv_id is not distinct from t.conv_id and j.n = t.n + 1,
      lateral (select case f when 't' then 5 when 'k' then 0 else 1000000000 end as stay, if(i = 'u', 0, 1) as uc, if(i = 'u', 'K', 'R') as ul, if(i = 'a', 0, 1) as ac, if(i = 'a', 'K', 'R') as al) k) q0) q1
), audits as (
  select f.*, list_min([t.z, t.p]) as best from facts f join steps t on t.conv_id is not distinct from f.conv_id and t.n = f.rows
), letters as (
  select conv_id, pos, substr(best.a, pos, 1) as l, length(replace(left(best.a, pos), 'I', '')) as n, length(replace(left(best.a, pos), 'D', '')) as place
  from (select conv_id, best, unnest(range(1, length(best.a) + 1)) as pos from audits) q
), lines as (
  select l.conv_id, l.pos, l.l, l.place, case when l.l = 'I' then '' else j.text end as text, j.role, max(case when l.place = 1 and l.l = 'K' and j.i = 's' then 1 else 0 end) over (partition by l.conv_id) as system
  from letters l left join judged j on j.conv_id is not distinct from l.conv_id and j.n = l.n and l.l <> 'I' where l.l <> 'D'
), texts as (
  select conv_id, sha256(string_agg(case when l = 'K' then role when (place - system) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by pos)) as sha from lines group by conv_id
), ids as (select distinct conv_id from conversations)
select i.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
from ids i left join audits a on a.conv_id is not distinct from i.conv_id left join texts t on t.conv_id is not distinct from i.conv_id
"""
