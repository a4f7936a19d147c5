"""Secret scans through a trigram inverted index, in DataFrame functions only."""

from __future__ import annotations

import itertools
from re import _parser as regex_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import settle, table


class Rule(NamedTuple):
    """A kind of secret. Matches are leftmost and do not overlap; those whose `group` is shorter than `least` drop."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=8,
    ),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    # Runs of 32 and more are the long ones among all runs.
    Rule("hex", "[0-9a-f]{32,}"),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", "gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abp]-[A-Za-z0-9-]{10,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("live", "sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + ADDED

#: Strings that a part of a pattern may stand for, at most, to be followed one by one.
SPELLED = 64
Clauses = frozenset[frozenset[str]]
ANY: Clauses = frozenset([frozenset()])


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _least(clauses: set[frozenset[str]]) -> Clauses:
    """Without clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _least({x | y for x, y in itertools.product(a, b)})


def _spelled(node) -> set[str] | None:
    """All strings of a part of a pattern in lower case, or None if they are too many to follow."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(value).lower()}
    if kind == "IN":
        if all(str(k) == "LITERAL" for k, _ in value):
            return {chr(v).lower() for _, v in value}
        return None
    if kind == "SUBPATTERN":
        return _sequence(value[3])
    if kind == "BRANCH":
        each = [_sequence(v) for v in value[1]]
        return None if None in each else set().union(*each)
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1:
        once = _sequence(value[2])
        return None if once is None else once | ({""} if value[0] == 0 else set())
    return None


def _sequence(nodes) -> set[str] | None:
    found = {""}
    for node in nodes:
        each = _spelled(node)
        if each is None or len(found) * len(each) > SPELLED:
            return None
        found = {a + b for a, b in itertools.product(found, each)}
    return found


def trigram_query(pattern: str) -> Clauses:
    """Clauses of trigrams (any clause, all its trigrams) that every match holds in lower case; ANY if it holds none."""
    query, run = ANY, {""}
    for node in [*regex_parser.parse(pattern), None]:
        each = None if node is None else _spelled(node)
        if each is not None and len(run) * len(each) <= SPELLED:
            run = {a + b for a, b in itertools.product(run, each)}
            continue
        query = _both(query, _least({_trigrams(s) for s in run}))
        run = each or {""}
    return query


# --- index ---------------------------------------------------------------------------------
def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings `(trigram, doc_id)` of those trigrams over the texts in lower case, stored in trigram order."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    return settle(low.select(F.explode(found).alias("trigram"), "doc_id").sortWithinPartitions("trigram"), "trigrams")


def candidates(postings: DataFrame, queries: dict[int, Clauses]) -> DataFrame:
    """`(doc_id, rules)`: bits of the rules whose trigram query the document's postings fulfil."""
    wanted = [
        (t, rule, n, 1 << bit, (1 << len(clause)) - 1)
        for rule, clauses in queries.items()
        for n, clause in enumerate(clauses)
        for bit, t in enumerate(sorted(clause))
    ]
    clauses = postings.sparkSession.createDataFrame(wanted, "trigram string, rule int, clause int, bit long, full long")
    # One row per rule, clause and trigram: bounded by the rules.
    met = postings.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    rules = met.where("bits = full").groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))
    return rules


def _spans(rule: Rule, number: int, text: Column) -> Column:
    """Spans of a rule in a text, as (start, number, end) in characters, end exclusive."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)
    each = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), held.alias("held"))
    empty = F.array().cast("array<struct<start:int,number:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["gap"])
        end = start + F.char_length(F.coalesce(x["hit"], F.lit("")))
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end"))
        counts = x["hit"].isNotNull() & (F.char_length(x["held"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(counts, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    walked = F.aggregate(each, F.struct(F.lit(0).alias("at"), empty.alias("found")), step, lambda s: s["found"])
    return F.when(F.regexp_like(text, pattern), walked).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`(doc_id, spans)` of every row of `docs`; spans are structs (kind, start, end) by start, then rule.

    Places are characters (code points), end exclusive. Rules with mandatory trigrams are tried on the documents
    whose postings fulfil their trigram query, other rules on all. A null text counts as empty and has no spans. Rows
    with one doc_id, null included, are tried if any of them is a candidate, so none loses a span. Other columns are
    ignored; no rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    queries = {n: q for n, q in queries.items() if q != ANY}
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    if queries:
        chosen = settle(candidates(build_index(rows, trigrams), queries), "candidates")
        chosen = chosen.withColumnRenamed("doc_id", "at")
        rows = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("at")), "left").drop("at")
    else:
        rows = rows.withColumn("rules", F.lit(0).cast("long"))
    empty = F.array().cast("array<struct<start:int,number:int,end:int>>")

    def tried(n: int, rule: Rule) -> Column:
        spans = _spans(rule, n, F.col("text"))
        if n not in queries:
            return spans
        return F.when(F.coalesce("rules", F.lit(0)).bitwiseAND(F.lit(1 << n)) != 0, spans).otherwise(empty)

    found = rows.select("doc_id", *(tried(n, r).alias(f"s{n}") for n, r in enumerate(rules)))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    ordered = F.array_sort(F.concat(*(F.col(f"s{n}") for n in range(len(rules)))))
    named = F.transform(ordered, lambda s: F.struct(kinds[s["number"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select("doc_id", named.alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
    )


def _rule_sql(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
SELECT doc_id, {number} AS number, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{pattern}') AS hits,
  regexp_extract_all(t, '{pattern}', {rule.group}) AS held, string_split_regex(t, '{pattern}') AS gaps
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""


OP5_SQL = f"""
WITH found AS ({" UNION ALL ".join(_rule_sql(n, r) for n, r in enumerate(RULES))}
), placed AS (
  SELECT *, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found)
), spans AS (
  SELECT doc_id, number, kind, start, kind || ':' || start::BIGINT || ':' || (start + length(hits[i]))::BIGINT AS span
  FROM placed WHERE length(held[i]) >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, number) FILTER (number < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, number), '') AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""
