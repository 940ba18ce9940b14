"""License scanning with ordered signature rules, in DataFrame expressions only.

A text becomes its lower-cased words with single spaces. The rules (see
``license_rules``) are hand-written regular expressions over that form in five
tables, each with a priority and a score. They are tried in three steps. Every text
is split into words once, which counts them and meets them with the rules' keywords;
without a keyword nothing else is done. Where a keyword occurs, one expression of
all its rules is tried, and only on a hit the rules one by one; all but the last
step use literal patterns, which are compiled once.

Matches are word intervals with a priority. A match is suppressed if an interval
that contains it has a better priority, or the same one and is longer, or is equal
and its rule comes first. Sorted by start, and by end backwards, whatever contains
a match comes before it, so one pass that carries the farthest end of each priority
decides all of them, and time is linear in their number but for the sort.

Base phrases are counted as they stand and their labels always stay.

Edge cases: null and empty texts have no words and no labels, score 0. Repeated
rows each get their row. Extra columns are ignored by ``report`` and pass through
``scan``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm import license_rules as tables
from terracell.llm.shared import fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
BASE_KEYWORDS = ("mit", "apache", "nc")  # a word of each
#: (priority, score) of the tables: the better priority is the smaller number
RANKS = ((tables.IDENTIFIERS, 1, 1.0), (tables.GRANTS, 2, 0.95), (tables.CLAUSES, 3, 0.9), (tables.NAMES, 4, 0.7), (tables.STATEMENTS, 5, 0.5))
CHUNK = 512  # matches folded at once


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    score: float
    keywords: tuple[str, ...]
    pattern: str


def rules() -> list[Rule]:
    """All rules, best priority first, in the order of their tables."""
    return [Rule(label, priority, score, tuple(key.split("|")), pattern) for table, priority, score in RANKS for label, key, pattern in table]


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bounded(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _intervals(norm: str, pattern: str, made: str) -> str:
    """Word intervals of all matches: their first words get a mark before them, their last ones a mark behind.

    ``pattern`` is an SQL expression; ``made`` makes the element from ``a`` and ``b``.
    """
    words = f"split(regexp_replace({norm}, {pattern}, '\\u0001$0\\u0002'), ' ')"
    first = r"filter(transform(w, (x, i) -> if(startswith(x, '\u0001'), cast(i - 1 AS bigint), null)), i -> i IS NOT NULL)"
    last = r"filter(transform(w, (x, i) -> if(endswith(x, '\u0002'), cast(i AS bigint), null)), i -> i IS NOT NULL)"
    return f"flatten(transform(array({words}), w -> zip_with({first}, {last}, (a, b) -> {made})))"


_SPAN = "struct<label:string,priority:int,score:double,rank:int,start:bigint,stop:bigint>"
_BASE_SPAN = "struct<label:string,start:bigint,stop:bigint>"


def _matches(norm: str, present: str, table: list[Rule]) -> str:
    """All matches: for each keyword that is present, one expression of its rules, then the rules themselves."""
    groups: dict[str, list[tuple[int, Rule]]] = {}
    for i, r in enumerate(table):
        for k in r.keywords:
            groups.setdefault(k, []).append((i, r))
    out = []
    made = "named_struct('label', r.label, 'priority', r.priority, 'score', r.score, 'rank', r.rank, 'start', a, 'stop', b)"
    for key, members in groups.items():
        any_of = _quoted(_bounded("|".join(r.pattern for _, r in members)))
        rows = ", ".join(f"named_struct('label', {_quoted(r.label)}, 'priority', {r.priority}, 'score', {r.score}D, 'rank', {i}, 're', {_quoted(_bounded(r.pattern))})" for i, r in members)
        found = f"flatten(transform(filter(array({rows}), r -> {norm} RLIKE r.re), r -> {_intervals(norm, 'r.re', made)}))"
        out.append(f"CASE WHEN array_contains({present}, {_quoted(key)}) AND {norm} RLIKE {any_of} THEN {found} END")
    # a rule with several keywords may be tried for each of them: of equal matches all but the first are suppressed
    return f"flatten(filter(array({', '.join(out)}), x -> x IS NOT NULL))"


def _kept(matches: str) -> str:
    """The matches that nothing suppresses: in order, no earlier one of the same or a better priority ends at or behind their end.

    The fold's output grows by concatenation, so it is folded in chunks.
    """
    levels = range(1, len(RANKS) + 1)
    farthest = ", ".join(f"'m{p}', greatest(acc.m{p}, if(x.priority = {p}, x.stop, -1L))" for p in levels)
    better = "greatest(" + ", ".join(f"if({p} <= x.priority, acc.m{p}, -1L)" for p in levels) + ")"
    start = ", ".join(f"'m{p}', -1L" for p in levels)
    carried = ", ".join(f"'m{p}', acc.m{p}" for p in levels)
    inner = f"aggregate(c, named_struct({carried}, 'out', cast(array() AS array<{_SPAN}>)), (acc, x) -> named_struct({farthest}, 'out', if({better} >= x.stop, acc.out, concat(acc.out, array(x)))))"
    both = ", ".join(f"'m{p}', one.m{p}" for p in levels)
    outer = f"transform(array({inner}), one -> named_struct({both}, 'out', concat(acc.out, array(one.out))))[0]"
    chunks = f"transform(sequence(0, (size(sorted) - 1) div {CHUNK}), k -> slice(sorted, k * {CHUNK} + 1, {CHUNK}))"
    order = "(p, q) -> CASE WHEN p.start <> q.start THEN if(p.start < q.start, -1, 1) WHEN p.stop <> q.stop THEN if(p.stop > q.stop, -1, 1) WHEN p.priority <> q.priority THEN if(p.priority < q.priority, -1, 1) WHEN p.rank <> q.rank THEN if(p.rank < q.rank, -1, 1) ELSE 0 END"
    fold = f"aggregate({chunks}, named_struct({start}, 'out', cast(array() AS array<array<{_SPAN}>>)), (acc, c) -> {outer}, acc -> flatten(acc.out))"
    return f"flatten(transform(array(array_sort({matches}, {order})), sorted -> {fold}))"


def scan(docs: DataFrame, text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """docs with n_words, base (spans of base phrases) and found (kept rule matches); they replace columns of these names."""
    table = rules() if table is None else table
    docs = docs.drop("n_words", "base", "found")
    columns = docs.columns
    words, norm, present, matches = fresh(docs, "words", "norm", "present", "matches")
    whole = F.coalesce(F.col(text), F.lit(""))
    # lower() also folds beyond ASCII, which neither joins nor parts words; the keywords are ASCII
    docs = docs.withColumn(words, F.split(F.lower(whole), GAP, -1))
    empty = lambda at: F.when(F.element_at(words, at) == "", 1).otherwise(0)
    count = F.size(words) - empty(1) - F.when(F.size(words) > 1, empty(-1)).otherwise(0)
    keys = sorted({k for r in table for k in r.keywords} | set(BASE_KEYWORDS))
    docs = docs.select(*columns, count.cast("bigint").alias("n_words"), F.array_intersect(words, F.array(*map(F.lit, keys))).alias(present))
    form = F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.translate(whole, UPPER, LOWER), GAP, " ")), F.lit(" "))
    docs = docs.withColumn(norm, F.when(F.size(present) > 0, form))
    made = lambda label: f"named_struct('label', {_quoted(label)}, 'start', a, 'stop', b)"
    none = f"cast(array() AS array<{_BASE_SPAN}>)"
    base = ", ".join(f"CASE WHEN contains(`{norm}`, {_quoted(f' {p} ')}) THEN {_intervals(f'`{norm}`', _quoted(_bounded(p)), made(label))} ELSE {none} END" for label, p in BASE)
    docs = docs.withColumn("base", F.when(F.col(norm).isNotNull(), F.expr(f"concat({base})")))
    docs = docs.withColumn(matches, F.when(F.col(norm).isNotNull(), F.expr(_matches(f"`{norm}`", f"`{present}`", table))))
    docs = docs.withColumn("found", F.when(F.size(matches) > 0, F.expr(_kept(f"`{matches}`"))))
    return docs.select(*columns, "n_words", "base", "found")


def report(docs: DataFrame) -> DataFrame:
    """Per document: words, places of base phrases, and the labels."""
    out = scan(docs.select("doc_id", "text")).drop("text")
    base = F.coalesce("base", F.expr(f"cast(array() AS array<{_BASE_SPAN}>)"))
    found = F.coalesce("found", F.expr(f"cast(array() AS array<{_SPAN}>)"))
    out = out.select("doc_id", "n_words", base.alias("base"), found.alias("found"))
    names = F.col("base")["label"]
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.coalesce(F.array_max(F.col("found")["score"]), F.when(F.size("base") > 0, F.lit(0.7)), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.col("base")["start"]).alias("first_word"),
        F.array_max(F.col("base")["start"]).alias("last_word"),
        joined(names).alias("base_labels"),
        joined(F.concat(names, F.col("found")["label"])).alias("labels"),
        score.alias("score"),
    )
