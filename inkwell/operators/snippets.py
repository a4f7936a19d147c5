"""X11: the best short window of the body around the matches, for the top hits only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import QUICK_WORD, terms
from inkwell.session import build_once

# Fixed values of the snippet format and of its window choice.
WINDOW = 12
OPEN, CLOSE, ELLIPSIS = "[", "]", "…"
FIRST_OF_CLAUSE, TEXT_START, SENTENCE_START = 1000, 120, 100
SENTENCE_GAP = r"[.:][ \t\n\r]+\z"


INSTANCES = "array<struct<first:int,clause_no:int,last:int>>"


def clause_slot_lists(clause_terms: DataFrame) -> DataFrame:
    """`(query_id, slot_lists)`: per query its clauses, each with the terms of every slot.

    `clause_terms` has `query_id`, `clause_no`, `n_terms`, `slot`, `term`. A clause with a slot that no term stands
    for matches nowhere and is left out.
    """
    slots = clause_terms.groupBy("query_id", "clause_no", "n_terms", "slot").agg(F.collect_set("term").alias("terms"))
    clauses = slots.groupBy("query_id", "clause_no", "n_terms").agg(F.collect_list(F.struct("slot", "terms")).alias("slots"))
    whole = clauses.where(F.size("slots") == F.col("n_terms"))
    return whole.groupBy("query_id").agg(F.collect_list(F.struct("clause_no", "n_terms", "slots")).alias("slot_lists"))


def text_columns(docs: DataFrame) -> DataFrame:
    """Add what snippets need of a body alone: its terms, words, the gaps between them, and sentence starts.

    For hits that have met all that they are joined with, since these columns take many times the room of a body.
    """
    for columns in _text_steps():
        docs = docs.withColumns(columns)
    return docs


TEXT_COLUMNS = ("_tokens", "_words", "_gaps", "_n_words", "_sentences", "_sentence_of")


@build_once
def _text_steps() -> list[dict[str, Column]]:
    starts, n_words = F.col("_sentences"), F.col("_n_words")
    sentence = F.filter(
        F.transform("_gaps", lambda g, i: F.when((i == 0) | g.rlike(SENTENCE_GAP), i)),
        lambda i: i.isNotNull() & (i < n_words),
    )
    next_start = lambda j: F.coalesce(F.get(starts, j + 1), n_words)
    return [
        {
            "_tokens": terms(F.col("plaintext")),
            "_words": F.regexp_extract_all("plaintext", F.lit(QUICK_WORD), F.lit(0)),
            "_gaps": F.split("plaintext", QUICK_WORD, -1),
        },
        {"_n_words": F.size("_words")},
        {"_sentences": sentence},
        # Of every word the last sentence start at or before it.
        {"_sentence_of": F.flatten(F.transform(starts, lambda s, j: F.array_repeat(s, next_start(j) - s)))},
    ]


def clause_instances(hits: DataFrame) -> DataFrame:
    """Add `instances`: where the clauses of its query stand in the body of a hit, in order of place.

    For hits with the text columns and `slot_lists`, which goes. Read from the texts of the hits, which have to be fetched anyway: no
    positions travel with all the other matches, and no word of a body leaves its row. Per slot the terms are met
    with the words of the body by hash; where the slots of a phrase, shifted to its start, coincide, it stands.
    """
    tokens = F.col("_tokens")
    # Every step is a list of its own, since what a lambda mentions is computed again for each element.
    slots = F.flatten(
        F.transform(
            "slot_lists",
            lambda c: F.transform(
                c["slots"],
                lambda s: F.struct(
                    c["clause_no"].alias("clause_no"), c["n_terms"].alias("n_terms"), s["slot"].alias("slot"),
                    F.array_intersect(tokens, s["terms"]).alias("here"),
                ),
            ),
        )
    )
    met = F.filter("_slots", lambda s: F.size(s["here"]) > 0)
    starts = F.transform(
        "_met",
        lambda s: F.struct(
            s["clause_no"].alias("clause_no"), s["n_terms"].alias("n_terms"),
            F.filter(F.transform(tokens, lambda t, i: F.when(F.array_contains(s["here"], t), i - s["slot"])), lambda i: i.isNotNull()).alias("at"),
        ),
    )
    # The slots of a clause follow each other; a clause with a slot that isn't met has fewer of them.
    step = "struct<clause_no:int,n_left:int,at:array<int>>"
    begins = lambda s: F.struct(
        s["clause_no"].alias("clause_no"), (s["n_terms"] - 1).alias("n_left"), s["at"].alias("at")
    ).cast(step)
    goes_on = lambda held, s: F.struct(
        s["clause_no"].alias("clause_no"), (held["n_left"] - 1).alias("n_left"), F.array_intersect(held["at"], s["at"]).alias("at")
    ).cast(step)
    result = "array<struct<first:int,clause_no:int,last:int>>"
    nothing = F.struct(F.lit(None).cast("int").alias("clause_no"), F.lit(0).alias("n_left"), F.array().cast("array<int>").alias("at")).cast(step)

    def folded(held: Column, s: Column) -> Column:
        now = F.when(held["last"]["clause_no"] == s["clause_no"], goes_on(held["last"], s)).otherwise(begins(s))
        return F.struct(now.alias("last"), F.concat(held["done"], F.array(now)).alias("done"))

    single = F.filter("_starts", lambda s: s["n_terms"] == 1)
    several = F.aggregate(
        F.filter("_starts", lambda s: s["n_terms"] > 1),
        F.struct(nothing.alias("last"), F.array().cast(f"array<{step}>").alias("done")), folded,
    )["done"]
    whole = F.transform(
        F.filter(several, lambda d: d["n_left"] == 0),
        lambda d: F.struct(d["clause_no"].alias("clause_no"), d["at"].alias("at")),
    )
    clauses = F.concat(F.transform(single, lambda s: F.struct(s["clause_no"].alias("clause_no"), s["at"].alias("at"))), whole)
    lengths = F.map_from_entries(F.transform("slot_lists", lambda c: F.struct(c["clause_no"], c["n_terms"])))
    found = F.flatten(
        F.transform(
            "_clauses",
            lambda c: F.transform(
                c["at"],
                lambda i: F.struct(i.alias("first"), c["clause_no"].alias("clause_no"), (i + F.element_at("_lengths", c["clause_no"]) - 1).alias("last")),
            ),
        )
    )
    for name, column in (
        ("_slots", slots), ("_met", met), ("_starts", starts), ("_lengths", lengths),
        ("_clauses", clauses), ("instances", F.sort_array(found.cast(result))),
    ):
        hits = hits.withColumn(name, column)
    return hits.drop("_slots", "_met", "_starts", "_lengths", "_clauses", "slot_lists")


def _window_score(w: Column) -> Column:
    """Each clause counts highly once; further places count one each."""
    kinds = F.size(F.array_distinct(F.transform(w, lambda x: x["clause_no"])))
    return kinds * (FIRST_OF_CLAUSE - 1) + F.size(w)


def snippets(hits: DataFrame) -> DataFrame:
    """Add `snippet` to hits with text columns and `instances`, as `clause_instances` gives them."""
    steps = _snippet_steps()
    for columns in steps:
        hits = hits.withColumns(columns)
    return hits.drop(*TEXT_COLUMNS, *(name for columns in steps for name in columns if name != "snippet"))


@build_once
def _snippet_steps() -> list[dict[str, Column]]:
    """The steps are columns of their own, so that no array is built twice."""
    steps = []
    inst, words, gaps = F.col("_inst"), F.col("_words"), F.col("_gaps")
    n_words, per_window = F.col("_n_words"), F.col("_per_window")

    instances = F.coalesce("instances", F.array().cast(INSTANCES))
    clause_count = F.size(F.array_distinct(F.transform(instances, lambda x: x["clause_no"])))
    steps.append(
        {
            "_inst": instances,
            "_per_window": clause_count * WINDOW,
        }
    )

    # Distinct places in order. The first place at or after a word is laid out once as a list over the words, like
    # the sentence starts, so that all steps are linear in the text.
    place = "struct<pos:int,at:int>"
    firsts = F.filter(
        F.transform(
            inst,
            lambda x, i: F.when(
                (i == 0) | (x["first"] != F.get(inst, i - 1)["first"]),
                F.struct(x["first"].alias("pos"), i.alias("at")).cast(place),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    steps.append({"_places": firsts})
    where = F.col("_places")
    last_place = lambda k: F.when(k == 0, -1).otherwise(F.get(where, k - 1)["pos"])
    steps.append(
        {"_at_or_after": F.flatten(F.transform(where, lambda p, k: F.array_repeat(p["at"], p["pos"] - last_place(k))))}
    )

    def inside(start: Column, at: Column) -> Column:
        """The places in the window at `start`; `at` is the first index to look at."""
        return F.filter(F.slice(inst, at + 1, per_window), lambda x: x["first"] < start + WINDOW)

    def candidates(p: Column, k: Column) -> Column:
        here = inside(p["pos"], p["at"])
        span = F.element_at(here, -1)["last"] + 1 - p["pos"]
        half = F.when(span <= WINDOW, F.floor((WINDOW - span) / 2)).otherwise(F.ceil((WINDOW - span) / 2))
        centred = F.greatest(F.least(p["pos"] - half, n_words - WINDOW), F.lit(0))
        at_place = F.struct(_window_score(here).cast("int").alias("score"), centred.cast("int").alias("start"))
        s = F.get("_sentence_of", p["pos"])
        before = F.get("_at_or_after", s)
        bonus = F.when(s == 0, TEXT_START).otherwise(SENTENCE_START)
        at_sentence = F.struct(
            (_window_score(inside(s, before)) + bonus).cast("int").alias("score"), s.cast("int").alias("start")
        )
        # A sentence start already tried cannot be strictly better the second time.
        fresh = (k == 0) | (last_place(k) <= s) | (F.get("_sentence_of", last_place(k)) != s)
        return F.when((n_words > WINDOW) & (s < p["pos"]) & fresh, F.array(at_place, at_sentence)).otherwise(
            F.array(at_place)
        )

    steps.append({"_tried": F.flatten(F.transform(where, candidates))})
    best = F.array_max(
        F.transform(
            "_tried", lambda c, i: F.struct(c["score"].alias("score"), (-i).alias("turn"), c["start"].alias("start"))
        )
    )["start"]
    steps.append({"_from": F.coalesce(best, F.lit(0))})
    steps.append({"_to": F.least(F.col("_from") + (WINDOW - 1), n_words - 1)})
    lo, hi = F.col("_from"), F.col("_to")

    # Overlapping places share one pair of brackets; a run that began before the window has none.
    near = F.filter(inst, lambda x: (x["first"] <= hi) & (x["last"] >= lo))
    run = "struct<a:int,b:int>"
    one_run = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")).cast(run))
    runs = F.aggregate(
        near,
        F.array().cast(f"array<{run}>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["first"] <= F.try_element_at(acc, F.lit(-1))["b"]),
            F.concat(
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
                one_run(
                    F.try_element_at(acc, F.lit(-1))["a"],
                    F.greatest(F.try_element_at(acc, F.lit(-1))["b"], x["last"]),
                ),
            ),
        ).otherwise(F.concat(acc, one_run(x["first"], x["last"]))),
    )
    steps.append({"_runs": F.filter(runs, lambda r: r["a"] >= lo)})
    marked = F.col("_runs")

    def piece(i: Column) -> Column:
        gap = F.when((i == lo) & (lo > 0), "").otherwise(F.get(gaps, i))
        opens = F.exists(marked, lambda r: r["a"] == i)
        closes = F.exists(marked, lambda r: (r["b"] == i) | ((i == hi) & (r["a"] <= i) & (r["b"] > i)))
        return F.concat(
            gap, F.when(opens, OPEN).otherwise(""), F.get(words, i), F.when(closes, CLOSE).otherwise("")
        )

    window = F.array_join(F.transform(F.sequence(lo, hi), piece), "")
    tail = F.when(hi >= n_words - 1, F.get(gaps, n_words)).otherwise(ELLIPSIS)
    snippet = F.when(n_words == 0, F.col("plaintext")).otherwise(
        F.concat(F.when(lo > 0, ELLIPSIS).otherwise(""), window, tail)
    )
    steps.append({"snippet": snippet})
    return steps
