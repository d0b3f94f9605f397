"""Secret scans: three fixed patterns, and stretches of high Shannon entropy in a sliding window.

A pass in the JVM finds texts that hold a candidate at all; only these travel to Python. There each character
class cuts candidate strings out of a text. A window of fixed width slides along each candidate; the sum of
c * log2(c) over its characters' counts c changes by the character that enters and the one that leaves, so all
windows of all candidates of a batch cost one sort, however wide the window. The sums are integers (units of
2^-32), so they carry no rounding from window to window and a window is judged alike wherever it lies. Hot
windows that overlap or touch become one span, unless an allow-list knows the candidate. No row is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

UNIT = 1 << 32
SPANS = "array<struct<kind: string, start: int, end: int>>"


class Pattern(NamedTuple):
    """Matches of pattern, leftmost and not overlapping, whose group has least characters or more. Every such match
    holds a match of hint."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str


class CharClass(NamedTuple):
    """Candidates are runs of least or more characters of a class (the inside of brackets, ASCII); a window is hot
    with entropy bits or more, at least one digit and one letter."""

    kind: str
    characters: str
    least: int
    window: int
    bits: float


# The patterns of the base.
BASE = (
    Pattern("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6, "(?i:password|passwd|secret|token|api_?key)"),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}"),
    Pattern("hex", r"[0-9a-f]+", 0, 24, "[0-9a-f]{24}"),
)
#: Some 99 of 100 windows of random characters are hot. No entropy that a window can have is within 10^-6 of bits.
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 20, 20, 2.85),
    CharClass("entropy_upper", "A-Z0-9", 16, 16, 3.1),
    CharClass("entropy_base64", "A-Za-z0-9+/_-", 20, 20, 3.68),
)
#: Candidates that one of these matches as a whole are known not to be secrets.
ALLOW = (
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",  # UUIDs
    r"([A-Za-z]+|[0-9]{1,4})([/_-]+([A-Za-z]+|[0-9]{1,4}))*",  # words, dates and paths
    r".*(0123456789|ABCDEFGHIJKLMNOP|abcdefghijklmnop).*",  # alphabets written out
)


def entropy_limit(window: int, bits: float) -> int:
    """The largest sum of c * log2(c), in UNITs, that a window of at least so many bits has."""
    return int(np.floor((np.log2(window) - bits) * window * UNIT))


def window_sums(codes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """For each place the sum of c * log2(c), in UNITs, over the counts c of the characters of its candidate in
    the window that ends there. codes: uint8, the candidates one after the other, which begin at starts."""
    n = len(codes)
    table = np.arange(window + 1, dtype=float)
    table[1:] = np.round(table[1:] * np.log2(table[1:]) * UNIT)
    table = table.astype(np.int64)
    own = np.searchsorted(starts, np.arange(n), "right") - 1
    at, first = np.arange(n), starts[own]
    # same character of the same candidate, in order of place: counts are differences of ranks
    group = (own << 8 | codes.astype(np.int64)) * n
    keys = np.sort(group + at)
    opens = np.maximum(first, at - window + 1)
    count = np.searchsorted(keys, group + at) - np.searchsorted(keys, group + opens)
    change = table[count + 1] - table[count]
    leaves = at - window
    out = np.flatnonzero(leaves >= first)
    gone = group[leaves[out]]
    count = np.searchsorted(keys, gone + out) - np.searchsorted(keys, gone + leaves[out])
    change[out] -= table[count] - table[count - 1]
    total = np.cumsum(change)
    return total - (total[first] - change[first])


def hot_spans(candidates: list[bytes], kind: CharClass) -> list[list[tuple[int, int]]]:
    """Each candidate's maximal stretches of hot windows, as (start, end) within it."""
    lengths = np.array([len(c) for c in candidates], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    codes = np.frombuffer(b"".join(candidates), np.uint8)
    sums = window_sums(codes, starts, kind.window)
    own = np.repeat(np.arange(len(candidates)), lengths)
    at = np.arange(len(codes))
    digits = np.concatenate([[0], np.cumsum((codes >= 48) & (codes <= 57))])
    letters = np.concatenate([[0], np.cumsum(((codes | 32) >= 97) & ((codes | 32) <= 122))])
    ends = at[at - starts[own] + 1 >= kind.window]
    begins = ends - kind.window + 1
    hot = (sums[ends] <= entropy_limit(kind.window, kind.bits)) & (digits[ends + 1] > digits[begins]) & (letters[ends + 1] > letters[begins])
    out: list[list[tuple[int, int]]] = [[] for _ in candidates]
    for b, c in zip(begins[hot].tolist(), own[begins[hot]].tolist()):
        b -= int(starts[c])
        if out[c] and b <= out[c][-1][1]:
            out[c][-1] = (out[c][-1][0], b + kind.window)
        else:
            out[c].append((b, b + kind.window))
    return out


def _scanner(base, classes, allow):
    compiled = [(p, re.compile(p.pattern, re.ASCII)) for p in base]
    runs = [(c, re.compile(f"[{c.characters}]{{{c.least},}}")) for c in classes]
    known = re.compile("|".join(f"(?:{a})" for a in allow)) if allow else None

    def spans_of(texts: list[str]) -> list[list[tuple[str, int, int]]]:
        out = [[(p.kind, m.start(), m.end()) for p, found in compiled for m in found.finditer(text) if len(m[p.group]) >= p.least] for text in texts]
        for c, run in runs:
            told = [(k, m.start(), m[0]) for k, text in enumerate(texts) for m in run.finditer(text) if len(m[0]) >= c.window and not (known and known.fullmatch(m[0]))]
            for (k, begin, _), spans in zip(told, hot_spans([m.encode() for _, _, m in told], c) if told else []):
                earlier = out[k].copy()
                for s, e in spans:
                    # what a pattern or an earlier class covers already says nothing new
                    if not any(x <= begin + s and begin + e <= y for _, x, y in earlier):
                        out[k].append((c.kind, begin + s, begin + e))
        order = {kind: k for k, kind in enumerate([p.kind for p in base] + [c.kind for c in classes])}
        return [sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])) for spans in out]

    return spans_of


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Sequence[Pattern] = BASE, classes: Sequence[CharClass] = CLASSES, allow: Sequence[str] = ALLOW, with_text: bool = False) -> DataFrame:
    """(id_col, spans), with_text also text_col: every row of docs with its spans, an array of (kind, start, end) in
    code points, end exclusive, by start, then kind in the order of base and classes, then end.

    Spans of base are never suppressed and may overlap those of other kinds. A span of a class is a maximal
    stretch of hot windows of one candidate; it is left out where the allow-list matches the whole candidate, and
    where one span of base or of an earlier class covers it. Windows of equal entropy are judged alike; a window
    of exactly bits is hot. Null and empty texts, and texts shorter than a window, have what base finds and else
    an empty array. Repeated rows and ids, null ids among them, are judged row by row; an empty table gives an
    empty one. Only the two columns are read, so others cannot clash."""
    text, hint = F.col(text_col), "|".join([p.hint for p in base] + [f"[{c.characters}]{{{max(c.least, c.window)}}}" for c in classes])
    asked = docs.select(F.col(id_col).alias("id"), F.when(text.rlike(hint), text).alias("hit"), *[text.alias("text")] * with_text)
    kept = [0, 2] if with_text else [0]
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = [asked.columns[k] for k in kept] + ["spans"]

    def scan(batches):
        spans_of = _scanner(base, classes, allow)
        for batch in batches:
            hits = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
            found: list[list] = [[] for _ in range(batch.num_rows)]
            # a few texts at a time: one sort for all, and no more than their candidates in memory
            for some in np.array_split(hits, 1 + len(hits) // 64):
                for k, spans in zip(some, spans_of([batch.column(1)[int(k)].as_py() for k in some])):
                    found[k] = [{"kind": a, "start": b, "end": c} for a, b, c in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(found, kinds)], names=names)

    schema = ", ".join(f"{n} {asked.schema[n].dataType.simpleString()}" for n in names[:-1])
    told = asked.mapInArrow(common.tidy(scan), f"{schema}, spans {SPANS}")
    return told.select(F.col("id").alias(id_col), *[F.col("text").alias(text_col)] * with_text, "spans")


def redact(found: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The rows of find_secrets (with_text) with each maximal run of covered characters replaced by mask. A null text stays null.
    Columns of found other than text_col and spans stay as they are."""
    merged = F.expr("""aggregate(array_sort(transform(spans, s -> struct(s.start as start, s.end as end))), cast(array() as array<struct<start: int, end: int>>),
        (m, s) -> case when size(m) > 0 and s.start < element_at(m, -1).end
            then concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).start as start, greatest(element_at(m, -1).end, s.end) as end)))
            else concat(m, array(s)) end)""")
    pieces = F.expr("transform(sequence(0, size(_merged_)), k -> case when k = size(_merged_) then substr(_text_, case when k = 0 then 1 else _merged_[k - 1].end + 1 end) else substr(_text_, case when k = 0 then 1 else _merged_[k - 1].end + 1 end, _merged_[k].start - case when k = 0 then 0 else _merged_[k - 1].end end) end)")
    wide = found.withColumns({"_merged_": merged, "_text_": F.col(text_col)})
    return wide.withColumn(text_col, F.when(F.col("_text_").isNotNull(), F.array_join(pieces, mask))).drop("_merged_", "_text_")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scan(spark, sf_dir: str) -> DataFrame:
    """documents: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = [p.kind for p in BASE]

    def of(*named):
        return F.filter("spans", lambda s: s["kind"].isin(*named))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(joined(of(*kinds)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [(p.kind, p.pattern) for p in BASE] + [(c.kind, f"[{c.characters}]+") for c in CLASSES]
    cuts = " UNION ALL ".join(
        f"SELECT doc_id, row, {k} AS pri, '{kind}' AS kind, unnest(regexp_extract_all(text, {quoted(pattern)})) AS hit, unnest(list_slice(regexp_split_to_array(text, {quoted(pattern)}), 1, -2)) AS gap, generate_subscripts(regexp_extract_all(text, {quoted(pattern)}), 1) AS i FROM t"
        for k, (kind, pattern) in enumerate(parts)
    )
    first = len(BASE)
    limits = ", ".join(f"({first + k}, {c.least}, {c.window}, {c.bits})" for k, c in enumerate(CLASSES))
    held = " OR ".join(f"(pri = {k} AND length(regexp_extract(hit, {quoted(p.pattern)}, {p.group})) >= {p.least})" for k, p in enumerate(BASE))
    known = " OR ".join(f"regexp_full_match(hit, {quoted(a)})" for a in ALLOW)
    return f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
cut AS ({cuts}),
placed AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row, pri ORDER BY i) - length(hit) AS BIGINT) AS b FROM cut),
base AS (SELECT row, pri, kind, b, b + length(hit) AS e FROM placed WHERE {held}),
cand AS (SELECT p.*, l.width, l.bits FROM placed p JOIN (VALUES {limits}) l(pri, least, width, bits) ON p.pri = l.pri WHERE length(hit) >= least AND length(hit) >= width AND NOT ({known})),
wins AS (SELECT row, pri, kind, b AS own, width, b + k AS b, substr(hit, CAST(k AS BIGINT) + 1, width) AS w, bits FROM (SELECT *, unnest(range(0, length(hit) - width + 1)) AS k FROM cand)),
hot AS (SELECT * FROM wins WHERE list_entropy(string_split(w, '')) >= bits AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]')),
marked AS (SELECT *, coalesce(b > lag(b + width) OVER s, TRUE) AS fresh FROM hot WINDOW s AS (PARTITION BY row, pri, own ORDER BY b)),
isles AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY row, pri, own ORDER BY b) AS isle FROM marked),
found AS (SELECT row, pri, any_value(kind) AS kind, min(b) AS b, max(b + width) AS e FROM isles GROUP BY row, pri, own, isle),
-- a span that an earlier kind covers says nothing new; what is left out is itself covered by something that stays
every AS (SELECT * FROM base UNION ALL SELECT f.* FROM found f WHERE NOT EXISTS (SELECT 1 FROM base g WHERE g.row = f.row AND g.b <= f.b AND f.e <= g.e) AND NOT EXISTS (SELECT 1 FROM found g WHERE g.row = f.row AND g.pri < f.pri AND g.b <= f.b AND f.e <= g.e)),
told AS (SELECT row, pri, b, e, kind || ':' || b || ':' || e AS span FROM every),
sums AS (SELECT row, {", ".join(f"count(*) FILTER (WHERE pri = {k}) AS n_{p.kind}" for k, p in enumerate(BASE))}, string_agg(span, ',' ORDER BY b, pri, e) FILTER (WHERE pri < {first}) AS own, string_agg(span, ',' ORDER BY b, pri, e) AS spans FROM told GROUP BY row)
SELECT t.doc_id, {", ".join(f"coalesce(n_{p.kind}, 0) AS n_{p.kind}" for p in BASE)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN sums USING (row)
"""


OP11_SQL = _sql()
