"""Quality rules by repetition coverage (operator 8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.textops import SpanHash, as_int64, byte_slices, code_points, covered, id_and_text, ngrams, ranked, ready, sums, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: n-gram length -> largest share of word characters that may lie in n-grams seen earlier in the text
COVERAGE = {2: 0.50, 3: 0.45, 4: 0.40, 5: 0.35, 7: 0.30, 10: 0.25}
MAX_LINE_SHARE = 0.40  # of word characters, in lines equal to an earlier line
MAX_SYMBOL_RATIO = 0.10  # symbols per word
MIN_WORDS = 50

SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, dup_line_chars bigint, " + ", ".join(f"dup_chars_{n} bigint" for n in COVERAGE) + ", reason string"
)


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All counts for the texts of one slice."""
    found, spans = words(data, offsets), SpanHash(data)
    text, n_texts = found.text, len(offsets) - 1
    hashes = spans(found.starts, found.ends)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(code_points(data), out=points[1:])
    chars = points[found.ends] - points[found.starts]
    per_text = lambda values: sums(values, found.first)
    out = {"n_words": found.counts, "word_chars": per_text(chars), "n_symbols": sums(SYMBOLS[data], offsets)}

    # lines: cut at \n and at text borders
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_words = np.searchsorted(found.starts, ends) - np.searchsorted(found.starts, starts)
    starts, ends = starts[line_words > 0], ends[line_words > 0]
    line_text = np.searchsorted(offsets, starts, "right") - 1
    _, first = ranked(spans(starts, ends), line_text)
    again = ~first
    out["n_dup_lines"] = np.bincount(line_text[again], minlength=n_texts)
    line_chars = np.concatenate([[0], np.cumsum(chars)])
    inside = line_chars[np.searchsorted(found.starts, ends)] - line_chars[np.searchsorted(found.starts, starts)]
    out["dup_line_chars"] = np.bincount(line_text[again], weights=inside[again], minlength=n_texts).astype(np.int64)

    for n in sorted({3, *COVERAGE}):
        grams, at = ngrams(hashes, found.first, n)
        count, first = ranked(grams, text[at])
        if n == 3:
            out["n_repeat_words"] = per_text(covered(at[count > 1], 3, len(hashes)))
        if n in COVERAGE:
            out[f"dup_chars_{n}"] = per_text(chars * covered(at[~first], n, len(hashes)))
    return out


def judge(found: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, kept, reason): the first rule that fails names the reason."""
    base = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
    reason = np.where(base, "base", "").astype(object)
    rules = [("symbols", found["n_symbols"] > MAX_SYMBOL_RATIO * found["n_words"]), ("lines", found["dup_line_chars"] > MAX_LINE_SHARE * found["word_chars"])]
    rules += [(f"ngrams_{n}", found[f"dup_chars_{n}"] > most * found["word_chars"]) for n, most in COVERAGE.items()]
    for name, failed in rules:
        reason[(reason == "") & failed] = name
    return base, reason == "", np.where(reason == "", None, reason)


def keeps(spark: SparkSession):
    """A pandas UDF from text to the rules' verdict, to filter documents without a join."""
    ready(spark)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        found = [judge(measure(data, offsets))[1] for _, _, data, offsets in byte_slices(pa.array(texts, pa.large_string()))]
        return pd.Series(np.concatenate([np.zeros(0, bool), *found]))

    return kept


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict for each document, one row per input row.

    A character is covered if its word lies in an n-gram that occurred earlier in the same
    text; it is counted once however many n-grams cover it. Null and empty texts have no
    words and fail the base rule; repeated rows are judged each; an empty table gives none;
    other columns are not read. One pass, no shuffle.
    """
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids = as_int64(batch.column(0))
            for a, b, data, offsets in byte_slices(batch.column(1)):
                found = measure(data, offsets)
                base, kept, reason = judge(found)
                columns = [pa.array(ids[a:b]) if not batch.column(0).null_count else batch.column(0).slice(a, b - a)]
                columns += [pa.array(found[c].astype(np.int64)) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                columns += [pa.array(base), pa.array(kept), pa.array(found["dup_line_chars"])]
                columns += [pa.array(found[f"dup_chars_{n}"].astype(np.int64)) for n in COVERAGE] + [pa.array(reason, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return id_and_text(docs, key, text).mapInArrow(run, SCHEMA.replace("doc_id", key, 1) if key != "doc_id" else SCHEMA)


def _oracle() -> str:
    white = r"[\x20\x09-\x0D]+"
    grams = sorted({3, *COVERAGE})
    parts = [
        f"""g{n} as (select doc_id, i, row_number() over (partition by doc_id, k order by i) as nth, count(*) over (partition by doc_id, k) as often
        from (select doc_id, i, array_to_string(ws[i:i+{n - 1}], ' ') as k from p where i <= n - {n - 1}) q)"""
        for n in grams
    ]
    within = lambda n, flag: f"coalesce(max(case when {flag} then 1 else 0 end) over (partition by p.doc_id order by p.i rows between {n - 1} preceding and current row), 0)"
    covers = ", ".join([f"{within(n, f'g{n}.nth > 1')} as c{n}" for n in COVERAGE] + [f"{within(3, 'g3.often > 1')} as r3"])
    joins = " ".join(f"left join g{n} on g{n}.doc_id = p.doc_id and g{n}.i = p.i" for n in grams)
    sums = ", ".join(f"sum(case when c{n} = 1 then length(word) else 0 end)::bigint as dup_chars_{n}" for n in COVERAGE)
    zero = ", ".join(f"coalesce(dup_chars_{n}, 0)::bigint as dup_chars_{n}" for n in COVERAGE)
    rules = f"when n_symbols > {MAX_SYMBOL_RATIO} * n_words then 'symbols' when dup_line_chars > {MAX_LINE_SHARE} * word_chars then 'lines' "
    rules += " ".join(f"when dup_chars_{n} > {most} * word_chars then 'ngrams_{n}'" for n, most in COVERAGE.items())
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents),
    w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from d),
    p as (select doc_id, ws, len(ws) as n, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from w),
    {", ".join(parts)},
    c as (select p.doc_id, p.word, {covers} from p {joins}),
    s as (select doc_id, sum(r3)::bigint as n_repeat_words, {sums} from c group by doc_id),
    l as (select doc_id, count(*) as n_dup_lines, sum(length(regexp_replace(line, '{white}', '', 'g')))::bigint as dup_line_chars
      from (select doc_id, line, row_number() over (partition by doc_id, line) as nth from (select doc_id, unnest(string_split(text, chr(10))) as line from d) q where regexp_matches(line, '[^\\x20\\x09-\\x0D]')) q where nth > 1 group by doc_id),
    a as (select w.doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '{white}', '', 'g'))::bigint as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
      coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(dup_line_chars, 0)::bigint as dup_line_chars, {zero}
      from w left join s on s.doc_id = w.doc_id left join l on l.doc_id = w.doc_id),
    b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from a),
    r as (select *, case when base_failed then 'base' {rules} end as reason from b)
    select *, reason is null as kept from r"""


ORACLE = _oracle()
