"""Secret scans over a trigram inverted index.

From each rule's pattern a Boolean query over lower-cased trigrams is derived (every match contains the
trigrams of at least one clause). The index holds postings (trigram, document) for the trigrams of all queries;
the postings of a clause are intersected, and only documents that survive are searched with the rule's pattern.
A rule that has no mandatory trigram scans every document. All of it is DataFrame expressions.

Spans are ``kind:start:end`` in code points, end exclusive. Matches are leftmost and do not overlap within a kind;
one that is too short is dropped and the search goes on behind it. Null text is empty. Rows with a null or repeated
key are kept: each row is searched for every rule that any row of its key may match, a null key for all rules.
Columns of the input that share a name with an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basisflow.llm.common import without


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; ``measured`` is the group whose length must reach ``least``."""
    kind: str
    pattern: str
    least: int = 1
    measured: int = 0


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: fixed values: the three base kinds, in this order
BASE = (Rule("assign", ASSIGN, 8, 2), Rule("access", r"AKIA[A-Z0-9]{12,}"), Rule("hex", r"[0-9a-f]{32,}"))
#: public formats of issued credentials
ISSUED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ISSUED
_MOST_STRINGS, _MOST_CLAUSES = 32, 64


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of which one at least has all its trigrams in every (lower-cased) match; [] if none is mandatory."""
    parsed = rp.parse(pattern)
    clauses = _all_of(_needs(list(parsed)))
    least = [c for c in clauses if not any(other < c for other in clauses)]  # a | (a & b) = a
    return [] if frozenset() in least else sorted(least, key=sorted)


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3].lower() for i in range(len(text) - 2))


def _strings(node) -> set[str] | None:
    """All strings a node can match, if they are few."""
    kind, value = node
    if kind is rc.LITERAL:
        return {chr(value)}
    if kind is rc.IN:
        out = set()
        for k, v in value:
            if k is rc.LITERAL:
                out.add(chr(v))
            elif k is rc.RANGE and v[1] - v[0] < _MOST_STRINGS:
                out |= {chr(c) for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= 4 else None
    if kind is rc.SUBPATTERN:
        return _joined([_strings(n) for n in value[3]])
    if kind is rc.BRANCH:
        options = [_joined([_strings(n) for n in b]) for b in value[1]]
        return None if None in options or sum(map(len, options)) > _MOST_STRINGS else set().union(*options)
    if kind is rc.MAX_REPEAT and value[1] != rc.MAXREPEAT and value[1] <= 2:
        once = _joined([_strings(n) for n in value[2]])
        return None if once is None else set().union(*(_joined([once] * n) or set() for n in range(value[0], value[1] + 1)))
    return None


def _joined(parts: list[set[str] | None]) -> set[str] | None:
    if None in parts:
        return None
    out = {""}
    for p in parts:
        out = {a + b for a in out for b in p}
        if len(out) > _MOST_STRINGS:
            return None
    return out


def _needs(nodes: list) -> list[set[frozenset[str]]]:
    """A list of conditions, each a set of clauses of which one must hold."""
    found, run = [], {""}

    def close():
        clauses = {_trigrams(s) for s in run}
        if frozenset() not in clauses:
            found.append(clauses)

    for node in nodes:
        strings = _strings(node)
        longer = _joined([run, strings])
        if longer is not None:
            run = longer
            continue
        close()
        run = {""}
        kind, value = node
        if strings is not None:
            run = strings
        elif kind is rc.SUBPATTERN:
            found += _needs(list(value[3]))
        elif kind is rc.BRANCH:
            options = [_all_of(_needs(list(b))) for b in value[1]]
            clauses = set().union(*options)
            if frozenset() not in clauses:
                found.append(clauses)
        elif kind in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] > 0:
            found += _needs(list(value[2]))
    close()
    return found


def _all_of(conditions: list[set[frozenset[str]]]) -> set[frozenset[str]]:
    """Conjunction as clauses; a conjunct that would make too many is left out (the query only gets wider)."""
    clauses = {frozenset()}
    for c in conditions:
        wider = {a | b for a, b in product(clauses, c)}
        if len(wider) <= _MOST_CLAUSES:
            clauses = wider
    return clauses


def build_index(docs: DataFrame, grams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (gram, key): one row for each of ``grams`` that a document's lower-cased text contains."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    has = F.array(*[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(g)) for g in grams])
    return (docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), low.alias("_low"))
            .select("key", F.explode(F.array_compact(has)).alias("gram")).distinct())


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): documents in the intersection of the postings of some clause of each kind."""
    rows = [(kind, i, gram, len(clause)) for kind, q in queries.items() for i, clause in enumerate(q) for gram in sorted(clause)]
    wanted = index.sparkSession.createDataFrame(rows, "kind string, clause int, gram string, need int")
    # the clause table is as large as the rule set, whatever the documents
    met = (index.join(F.broadcast(wanted), "gram").groupBy("key", "kind", "clause").agg(F.count("*").alias("n"), F.first("need").alias("need"))
           .where("n = need"))
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule: the text between matches comes from split, the matches from extraction, offsets are their lengths added up."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    if rule.measured:
        size = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.measured)), lambda g: F.length(g))
    else:
        size = F.transform(found, lambda m: F.length(m))
    steps = F.arrays_zip(F.transform(between, lambda b: F.length(b)).alias("gap"),
                         F.transform(found, lambda m: F.length(m)).alias("len"), size.alias("size"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc, s):
        begin = acc["at"] + s["gap"]
        end = begin + F.coalesce(s["len"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["size"] >= rule.least, F.concat(acc["spans"], F.array(span)))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(steps, start, add)["spans"]).otherwise(none)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``found``: an array of (start, rank, kind, end), sorted, rank being the rule's place in ``rules``."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    queries = {k: q for k, q in queries.items() if q}
    kept = without(docs, "found")
    # the input row travels in one struct: no column of it can clash with a name used here
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), docs[key].alias("key"))
    body = F.coalesce(F.col("row")[text], F.lit("")).alias("body")
    if queries:
        grams = sorted({g for q in queries.values() for c in q for g in c})
        near = candidates(build_index(rows.select("key", body), grams, "key", "body"), queries)
        rows = rows.join(near.withColumnRenamed("key", "near_key"), F.col("key") == F.col("near_key"), "left")
    rows = rows.select("*", body)
    parts = []
    for i, r in enumerate(rules):
        spans = _spans(F.col("body"), r, i)
        if r.kind in queries:
            may = F.col("key").isNull() | F.array_contains("kinds", r.kind)
            spans = F.when(may, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))
        parts.append(spans)
    return rows.select("row", F.array_sort(F.concat(*parts)).alias("found")).select("row.*", "found")


def summary(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts of the base kinds, the digest of the base spans and all spans as text."""
    found = scan(docs.select(F.col(key), F.col(text)), RULES, key, text)
    base = F.filter("found", lambda s: s["rank"] < len(BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE]
    return found.select(key, *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))


def oracle(name: str = "documents") -> str:
    """The summary as DuckDB SQL: every rule over every text."""
    def spans(rule: Rule, order: int) -> str:
        pattern = rule.pattern.replace("'", "''")
        group = rule.measured
        return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i: {{
            'start': list_sum(list_transform(string_split_regex(t, '{pattern}')[1:i], lambda x: length(x)))
                     + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda x: length(x))), 0),
            'rank': {order}, 'kind': '{rule.kind}', 'len': length(regexp_extract_all(t, '{pattern}')[i]),
            'size': length(regexp_extract_all(t, '{pattern}', {group})[i])}}), lambda s: s.size >= {rule.least})"""
    everything = reduce(lambda a, b: f"list_concat({a}, {b})", [spans(r, i) for i, r in enumerate(RULES)])
    text = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start::BIGINT || ':' || (s.start + s.len)::BIGINT), ',')"
    counts = ", ".join(f"len(list_filter(f, lambda s: s.kind = '{r.kind}')) AS n_{r.kind}" for r in BASE)
    return (f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {name}), s AS (SELECT doc_id, list_sort({everything}) AS f FROM d) "
            f"SELECT doc_id, {counts}, sha256({text.format(f'list_filter(f, lambda s: s.rank < {len(BASE)})')}) AS base_sha256, "
            f"{text.format('f')} AS spans FROM s")
