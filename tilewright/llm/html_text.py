"""Main text of web pages: page structure, then suffix arrays over each host's pages, counted over the whole host (operator 7)."""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.textops import BASE, mix, ready
from tilewright.session import cut_lineage

BROADCAST_HOSTS = 100_000  # hosts of several groups, up to which their numbers are broadcast
BROADCAST_RUNS = 1 << 20  # runs of all hosts, up to which they are broadcast (24 bytes each) and pages need no second shuffle
HOST_PAGES = 256  # pages of a host whose token streams make one suffix array; counts are added up over the host
MIN_PAGES = 5  # distinct pages that share a boilerplate run at least
RUN_TOKENS, LONG_TOKENS = 4, 8  # shortest repeated run, and one that goes wherever it stands; the borders of blocks count as tokens
LOOSE_SHARE, LONG_SHARE, TRUSTED_SHARE = 0.2, 0.1, 0.5  # share of the host's pages: runs and long runs outside an article, runs inside one
LOOSE_COPY, TRUSTED_COPY = 2 / 3, 0.5  # runs shared by two pages over those of the larger one, from which they are copies
MIN_UNIQUE = 4  # words in a row that stay of a block whose larger part goes
MAX_LINKED = 0.5  # share of a loose block's characters inside links
PAGE_SHARE, PAGE_CHARS = 0.8, 500  # text outside links from which an element with a layout word is the page itself
RULES = ((RUN_TOKENS, LOOSE_SHARE, LOOSE_COPY), (LONG_TOKENS, LONG_SHARE, LOOSE_COPY), (RUN_TOKENS, TRUSTED_SHARE, TRUSTED_COPY))

# What elements and class words say about their content.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "select"}
JUNK_TAGS = {"nav", "footer", "aside", "form", "head", "button", "dialog", "menu", "fieldset"}
MAIN_TAGS = {"article", "main"}
BLOCK_TAGS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACE_TAGS = {"br", "td", "th"}
JUNK_WORDS = set(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer "
    "disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended "
    "related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
HEAD_WORDS = {"header", "masthead"}
# these name the text itself; the other words may also stand on a container of the whole page
NEVER_TEXT = set(
    "comment comments commentlist consent cookie cookies copyright disclaimer disqus gdpr login nav navbar navigation newsletter replies reply respond responses signup".split()
)
NEVER_JUNK = {"html", "body"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu"}

# a quoted value ends where its quote is followed by what may follow a value; any other quote stands for itself
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'=]|=\s*"[^"]*"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|["'=])*)>?|<[!?][^>]*>?""", re.S)
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
STATE = re.compile(r"(?:has|have|with|without|no|show|hide|supports)[-_].*|.*[-_](?:enabled|disabled|open|closed|active|visible|ready|loaded|on|off)", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z]+|[0-9]+")
SPACES = re.compile(r"\s+")


def _judge(tag: str, attributes: str, in_main: bool) -> int:
    """2 for an element that goes, 1 for one that goes unless it holds the page's text, else 0.

    Class words count but for those of a state of the page (`has-sidebar`, `post-share-enabled`).
    """
    if tag in NEVER_JUNK:
        return 0
    if tag in JUNK_TAGS or (tag == "header" and not in_main):
        return 2
    if not attributes.strip():
        return 0
    worst = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return 2
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
        if name in ("class", "id"):
            found = {w for part in value.split() if not STATE.fullmatch(part) for w in WORD.findall(part)}
            if found & NEVER_TEXT:
                return 2
            if found & JUNK_WORDS or (found & HEAD_WORDS and not in_main):
                worst = 1
    return worst


def page_blocks(page: str) -> tuple[list[str], bool, list[float]]:
    """(blocks of text, whether they are from an article, share of each block inside links).

    Elements that by name, class, id or role are menus, headers, footers, sidebars, notices,
    adverts, forms or comments are left out, as are scripts, styles and markup. An element
    named by a layout word alone stays if four fifths of the page's text are in it, outside
    links. If the page has an article (or main) with text, only its blocks come out. Tags need
    not be closed: an end tag ends all elements above its own, and a new article ends an open
    junk element.
    """
    blocks: list[tuple[str, bool, float, tuple[int, ...]]] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # (tag, junk, in main, doubtful elements around it)
    text: list[str] = []
    link_chars, links, doubts = 0, 0, 0
    junk, in_main, within = False, False, ()
    pos = 0

    def flush() -> None:
        nonlocal link_chars
        if text:
            found = "".join(text)
            if "&" in found:
                found = entities.unescape(found)
            found = SPACES.sub(" ", found).strip()
            if found:
                blocks.append((found, in_main, min(1.0, link_chars / len(found)), within))
            text.clear()
        link_chars = 0

    while pos < len(page):
        m = TAG.search(page, pos)
        end = m.start() if m else len(page)
        if end > pos and not junk:
            text.append(page[pos:end])
            if links:
                link_chars += end - pos
        if not m:
            break
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK_TAGS and not junk:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    after = stack[k - 1][1:] if k else (False, False, ())
                    if junk and not after[0]:
                        text.clear()
                    elif after[2] != within:
                        flush()
                    del stack[k:]
                    junk, in_main, within = after
                    break
                if stack[k][0] in MAIN_TAGS and tag not in MAIN_TAGS and tag not in NEVER_JUNK:
                    break  # a stray end tag does not leave the article
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                close = RAW_END[tag].search(page, pos)
                gt = page.find(">", close.end()) if close else -1
                pos = len(page) if gt < 0 else gt + 1
            continue
        if tag in BLOCK_TAGS and not junk:
            flush()
        elif tag in SPACE_TAGS and not junk:
            text.append(" ")
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        if tag == "body":
            stack.clear()
            junk, in_main, within = False, False, ()
        own = _judge(tag, m[3], in_main or tag in MAIN_TAGS)
        if tag in MAIN_TAGS and own < 2 and not any(s[2] for s in stack):
            junk, within = False, ()
        if own and not junk:
            flush()
        if tag == "a":
            links += 1
        if tag in BLOCK_TAGS or own:
            junk = junk or own == 2
            in_main = (in_main or tag in MAIN_TAGS) and not (own == 2 and tag in MAIN_TAGS)
            if own == 1:
                within = (*within, doubts)
                doubts += 1
            stack.append((tag, junk, in_main, within))
    if not junk:
        flush()
    if doubts:
        held, total = np.zeros(doubts), sum(len(b[0]) for b in blocks)
        for found, _, linked, around in blocks:
            held[list(around)] += len(found) * (1 - linked)
        gone = held < max(PAGE_CHARS, PAGE_SHARE * total)
        blocks = [b for b in blocks if not gone[list(b[3])].any()]
    main = [b for b in blocks if b[1]]
    return [b[0] for b in main or blocks], bool(main), [0.0 if main else b[2] for b in main or blocks]


def suffix_array(stream: np.ndarray, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first 2^levels tokens, and ranks after each doubling.

    ranks[k][i] is the rank of the 2^k tokens from i on, so runs of 2^k tokens are equal
    where their ranks are; longer common prefixes follow from the levels together.
    """
    _, rank = np.unique(stream, return_inverse=True)
    ranks = [rank]
    for k in range(levels):
        ahead = np.full(len(rank), -1, np.int64)
        ahead[: max(0, len(rank) - (1 << k))] = rank[1 << k :]
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 1) + ahead + 1, return_inverse=True)
        ranks.append(rank)
        if rank.max(initial=0) == len(rank) - 1:
            break
    return np.argsort(rank, kind="stable"), ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in the order (at most all levels together)."""
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(len(a), np.int64)
    n = len(order)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        out[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return np.r_[0, out]


def copy_classes(run: np.ndarray, page: np.ndarray, pages: int, alike: float) -> np.ndarray:
    """Class of each page: pages that share `alike` of the larger one's runs are copies, and copies of copies too.

    `run` and `page` are the run and the page of each place. Shared runs are counted for all
    pairs of pages at once, a block of runs at a time.
    """
    found = np.unique(run * pages + page)
    run, page = found // pages, found % pages
    size = np.bincount(page, minlength=pages)
    often = np.bincount(run)[run] > 1
    _, column = np.unique(run[often], return_inverse=True)
    page = page[often]
    shared = np.zeros((pages, pages), np.float32)
    for a in range(0, int(column.max(initial=-1)) + 1, 4096):
        lo, hi = np.searchsorted(column, [a, a + 4096])
        block = np.zeros((pages, 4096), np.float32)
        block[page[lo:hi], column[lo:hi] - a] = 1
        shared += block @ block.T
    near = (shared > 0) & (shared >= alike * np.maximum(size[:, None], size[None, :]) - 1e-3)
    label = np.arange(pages)
    while True:
        least = np.minimum(label, np.where(near, label[None, :], pages).min(1))
        if (least == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = least


def count_runs(streams: list[np.ndarray], alike: float | None, size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(starts in order, run of each, distinct pages of each run, distinct pages) of runs of `size` tokens.

    The streams are concatenated, each ended by a token of its own, so no run goes over a
    page's end. Neighbours in the suffix array whose common prefix is long enough share the
    run; pages with equal streams count as one, and so do near copies if `alike` is given.
    Copies are not looked for where no run is on `least` pages.
    """
    sizes = np.array([len(s) + 1 for s in streams])
    stream = joined(streams)
    number: dict[bytes, int] = {}
    page = np.repeat([number.setdefault(s.tobytes(), len(number)) for s in streams], sizes)
    pages = len(number)
    order, ranks = suffix_array(stream, max(1, int(np.ceil(np.log2(size)))))
    prefix = common_prefixes(order, ranks)
    run = np.cumsum(prefix < size) - 1  # suffixes with the same first tokens
    pairs = np.unique(run * pages + page[order])
    if alike is not None and np.bincount(pairs // pages).max() >= least:
        short = np.cumsum(prefix < RUN_TOKENS) - 1
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(stream))
        whole = left[order] > RUN_TOKENS  # not over a page's end
        label = copy_classes(short[whole], page[order][whole], pages, alike)
        page, pages = label[page], int(label.max()) + 1
        pairs = np.unique(run * pages + page[order])
    return order, run, np.bincount(pairs // pages, minlength=run[-1] + 1), pages


def joined(streams: list[np.ndarray]) -> np.ndarray:
    """All streams in a row, each with a mark of its own behind it."""
    return np.concatenate([np.append(s, -1 - i) for i, s in enumerate(streams)])


def run_keys(stream: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of the `size` tokens from each place on; equal runs have equal keys in all groups."""
    key = np.zeros(max(0, len(stream) - size + 1), np.uint64)
    for k in range(size):
        key = mix(key * BASE + stream[k : k + len(key)].astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def usable(stream: np.ndarray, size: int) -> np.ndarray:
    """Whether the run from each place on may be boilerplate: long ones lie inside a block, short ones may reach over its border."""
    if size < LONG_TOKENS:
        return np.ones(len(stream), bool)
    border = np.cumsum(np.r_[0, stream == 0, np.zeros(size, bool)])
    return border[size : size + len(stream)] == border[: len(stream)]


def cover(starts: np.ndarray, size: int, streams: list[np.ndarray]) -> list[np.ndarray]:
    """For each page's tokens, whether a run of `size` tokens from one of the places covers it."""
    sizes = np.array([len(s) + 1 for s in streams])
    edge = np.zeros(int(sizes.sum()) + size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, starts + size, 1)
    covered = np.cumsum(edge)[: sizes.sum()] > 0
    return [c[:-1] for c in np.split(covered, np.cumsum(sizes)[:-1])]


def repeated_tokens(streams: list[np.ndarray], share: float, alike: float | None = None, size: int = RUN_TOKENS) -> list[np.ndarray]:
    """For each page's tokens, True where a run of `size` or more is found on enough distinct pages."""
    if len({s.tobytes() for s in streams}) < MIN_PAGES:
        return [np.zeros(len(s), bool) for s in streams]
    order, run, counts, pages = count_runs(streams, alike, size, MIN_PAGES)
    starts = order[(counts >= max(MIN_PAGES, share * pages))[run]]
    return cover(starts[usable(joined(streams), size)[starts]], size, streams)


def known_tokens(streams: list[np.ndarray], keys: np.ndarray, size: int) -> list[np.ndarray]:
    """For each page's tokens, True where a run with one of the keys covers it."""
    starts = np.flatnonzero(np.isin(run_keys(joined(streams), size), keys))
    return cover(starts[usable(joined(streams), size)[starts]], size, streams)


def token_streams(pages: list[list[str]]) -> tuple[list[np.ndarray], list[list[tuple[int, int]]]]:
    """(tokens of each page, where each of its blocks lies in them): hashes of words, 0 for the borders of blocks."""
    ids: dict[str, int] = {}
    streams, places = [], []
    for blocks in pages:
        tokens, where = [0], []
        for block in blocks:
            own = [ids[w] if w in ids else ids.setdefault(w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1) for w in block.split()]
            where.append((len(tokens), len(tokens) + len(own)))
            tokens += own + [0]
        streams.append(np.array(tokens, np.int64))
        places.append(where)
    return streams, places


def frequent_runs(pages: list[list[str]], loose: bool) -> list[tuple[int, int, int]]:
    """(rule, key, distinct pages) of the runs of a group that may be boilerplate of its host.

    A quarter of a rule's share is enough, so there are at most four times a page's tokens
    over the share, and (rule, 0, distinct pages of the group) stands for the whole. Rules of
    loose text are left out where the group has none.
    """
    streams, _ = token_streams(pages)
    stream = joined(streams)
    out = []
    for rule, (size, share, alike) in enumerate(RULES):
        if rule < 2 and not loose:
            continue
        order, run, counts, distinct = count_runs(streams, alike, size, 2)
        enough = np.flatnonzero(counts >= max(2, share / 4 * distinct))
        first = order[np.searchsorted(run, enough)]
        keys = run_keys(stream, size)
        inside = (first < len(keys)) & usable(stream, size)[first]
        out.append((rule, 0, distinct))
        out += [(rule, k, c) for k, c in zip(keys[first[inside]].tolist(), counts[enough[inside]].tolist())]
    return out


def unique_text(block: str, short: np.ndarray, long: np.ndarray) -> str:
    """What stays of a loose block: long runs go; if over half is covered, short ones and scraps between them go too."""
    gone = short | long
    if not 2 * gone.sum() > len(gone):
        gone = long
    elif len(gone):
        edges = np.flatnonzero(np.diff(np.r_[True, gone, True].astype(np.int8)))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a < MIN_UNIQUE:
                gone[a:b] = True
    return block if not gone.any() else " ".join(w for w, g in zip(block.split(), gone) if not g)


def keep_blocks(pages: list[tuple[list[str], bool, list[float]]], known: list[np.ndarray] | None = None) -> list[list[str]]:
    """Blocks of each page without what is boilerplate among the pages of its host.

    Of a loose block the runs found on enough pages are cut out and the rest stays; it goes
    whole if it is mostly links. A block of an article goes only if runs found on half of the
    pages cover it whole. Near copies count as one page, so what only they share stays. `known`
    has the keys of the host's runs for each of RULES; without it they are those of the given pages.
    """
    if known is not None and not any(len(k) for k in known):
        return [[b for b, share in zip(p[0], p[2]) if p[1] or share <= MAX_LINKED] for p in pages]
    streams, places = token_streams([p[0] for p in pages])

    def covered(rule: int) -> list[np.ndarray]:
        size, share, alike = RULES[rule]
        return repeated_tokens(streams, share, alike, size) if known is None else known_tokens(streams, known[rule], size)

    short, long = (covered(0), covered(1)) if not all(p[1] for p in pages) else (None, None)
    trusted = covered(2)
    out = []
    for i, (blocks, is_main, linked) in enumerate(pages):
        if is_main:
            out.append([b for b, (lo, hi) in zip(blocks, places[i]) if not trusted[i][lo:hi].all()])
        else:
            kept = [unique_text(b, short[i][lo:hi], long[i][lo:hi]) for b, (lo, hi), share in zip(blocks, places[i], linked) if share <= MAX_LINKED]
            out.append([b for b in kept if b])
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def _by_group(finish):
    """A function for mapInArrow that hands the rows of each (host, part), which come one after another, to `finish`."""

    def run(batches):
        held, group = [], None
        for batch in batches:
            for h, p, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, p) != group:
                    if held:
                        yield from finish(group, held)
                    held, group = [], (h, p)
                held.append(row)
        if held:
            yield from finish(group, held)

    return run


def _cut_in_place(frequent: DataFrame):
    """A function for mapInArrow over pages of hosts whose frequent runs, at most BROADCAST_RUNS, go to all tasks."""
    found = frequent.toPandas()
    runs = {h: [own["run"].to_numpy(np.int64)[own["rule"] == r] for r in range(len(RULES))] for h, own in found.groupby("host")}
    shared = frequent.sparkSession.sparkContext.broadcast(runs)
    none = [np.zeros(0, np.int64)] * len(RULES)

    def run(batches):
        for batch in batches:
            of_host: dict[str, list[int]] = {}
            blocks = [page_blocks(h.as_py()) for h in batch.column(2)]
            for i, h in enumerate(batch.column(3).to_pylist()):
                of_host.setdefault(h, []).append(i)
            texts = [""] * len(blocks)
            for h, rows in of_host.items():
                for i, kept in zip(rows, keep_blocks([blocks[i] for i in rows], shared.value.get(h, none))):
                    texts[i] = "\n\n".join(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", host_pages: int = HOST_PAGES) -> DataFrame:
    """Main text of each page: key, url, text, n_chars; one row per input row.

    Blocks of text found by structure are compared with the other pages of the host: suffix
    arrays of their token streams show runs that repeat on distinct pages; covered runs are
    cut out and unique ones stay. A host is dealt by hash into groups of about `host_pages`
    pages, each with its own array. Where a host has several groups, the pages of each run are
    added up over the host by a shuffle, and the runs on enough of them are cut from all its
    pages: where they lie if few enough runs go to all tasks, else in the groups; they are at most a page's tokens over the share of pages, however large the host.
    Kept blocks are joined by two line feeds, in page order, uncut.

    Null and empty pages have an empty text; null urls and urls without a host share the
    empty host; repeated rows are extracted each, in different groups (equal pages and near
    copies count once in a group, and a run counts there from its second page on); an empty table
    gives none; other columns are not read.
    """
    ready(pages.sparkSession)
    host = host_of(F.col("url"))
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    # only hosts of more than one group need a number; a small table of them goes to all tasks, a large one is joined
    groups = rows.groupBy(host.alias("host")).agg(F.ceil(F.count("*") / host_pages).cast("bigint").alias("groups")).filter("groups > 1")
    groups = cut_lineage(groups)
    several = groups.count()
    of_host = F.broadcast(groups) if several <= BROADCAST_HOSTS else groups

    def parse(batches):
        for batch in batches:
            found = [page_blocks(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found]), pa.array([f[2] for f in found], pa.list_(pa.float64())), pa.array(range(len(found)), pa.int64())],
                ["key", "url", "host", "blocks", "main", "linked", "nth"],
            )

    def parsed(some: DataFrame) -> DataFrame:
        """Parsed rows with their group; the place in the batch deals equal rows apart."""
        found = some.mapInArrow(parse, "key bigint, url string, host string, blocks array<string>, main boolean, linked array<double>, nth bigint")
        part = F.pmod(F.xxhash64("key", "url", "blocks", "nth"), F.coalesce("groups", F.lit(1)))
        return found.join(of_host, "host", "left").select("host", part.alias("part"), "key", "url", "blocks", "main", "linked")

    def count(group, held):
        found = frequent_runs([r[0] for r in held], not all(r[1] for r in held))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        columns = [[group[0]] * len(found), *([f[i] for f in found] for i in range(3))]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "rule", "run", "n"])

    def finish(group, held):
        # the host's runs, if it has several groups, are the row before its pages
        known = None
        if held[0][0] == 0:
            known = [np.array([k for r, k in zip(held[0][6], held[0][7]) if r == rule], np.int64) for rule in range(len(RULES))]
            held = held[1:]
        if held:
            texts = ["\n\n".join(b) for b in keep_blocks([(r[3], r[4], r[5]) for r in held], known)]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in held], pa.int64()), pa.array([r[2] for r in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    rows = rows.withColumn("host", host)
    none = [F.lit(None).cast("array<int>").alias("rules"), F.lit(None).cast("array<bigint>").alias("runs")]
    schema = "key bigint, url string, text string, n_chars bigint"
    large = None
    if several:
        of_large = rows.join(of_host.select("host"), "host", "left_semi").select("key", "url", "html", "host")
        counted = parsed(of_large).select("host", "part", "blocks", "main").repartition("host", "part").sortWithinPartitions("host", "part")
        counted = cut_lineage(counted.mapInArrow(_by_group(count), "host string, rule int, run bigint, n bigint").groupBy("host", "rule", "run").agg(F.sum("n").alias("n")))
        least = F.create_map(*(F.lit(x) for i, rule in enumerate(RULES) for x in (i, rule[1])))[F.col("rule")]
        totals = counted.filter("run = 0").select("host", "rule", F.greatest(F.lit(float(MIN_PAGES)), F.col("n") * least).alias("least"))
        frequent = cut_lineage(counted.filter("run <> 0").join(totals, ["host", "rule"]).filter("n >= least").select("host", "rule", "run"))
        if several <= BROADCAST_HOSTS and frequent.count() <= BROADCAST_RUNS:
            large = of_large.mapInArrow(_cut_in_place(frequent), schema)
            rows = rows.join(of_host.select("host"), "host", "left_anti").select("key", "url", "html", "host")
    dealt = parsed(rows).select("host", "part", F.lit(1).alias("kind"), "key", "url", "blocks", "main", "linked", *none)
    if several and large is None:
        runs = frequent.groupBy("host").agg(F.collect_list(F.struct("rule", "run")).alias("found"))
        told = groups.join(runs, "host", "left").select("host", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("part"), F.coalesce("found", F.array().cast("array<struct<rule:int,run:bigint>>")).alias("found"))
        blank = [F.lit(None).cast(t).alias(c) for c, t in (("key", "bigint"), ("url", "string"), ("blocks", "array<string>"), ("main", "boolean"), ("linked", "array<double>"))]
        dealt = dealt.unionByName(told.select("host", "part", F.lit(0).alias("kind"), *blank, F.col("found.rule").alias("rules"), F.col("found.run").alias("runs")))
    dealt = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "kind", "key").mapInArrow(_by_group(finish), schema)
    return (dealt if large is None else dealt.unionByName(large)).withColumnRenamed("key", key)
