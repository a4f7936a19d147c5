"""Conversation repair: rows of a conversation stream by in order, with the states of a dynamic program carried along."""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import on_workers_pandas, settle, table
from inkwell.session import scratch_path

#: Fixed values of the contract: white space, ends of sentences, what edits cost.
WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
ROLES = {"u": "user", "a": "assistant"}
#: Role initials that may follow each other; a conversation is empty or ends with an answer.
LEGAL = ("su", "ua", "au")
#: Places of the pattern `(s?(ua)+)?` and where a letter leads from them.
START, SYSTEM, USER, ANSWER = range(4)
LEADS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ANSWER, (ANSWER, "u"): USER}
ENDING = (START, ANSWER)

#: Back-pointers that are kept in memory, two bytes a row; those of longer conversations are written out.
KEPT_ROWS = 1 << 20


# --- damage and faults ---------------------------------------------------------------------
def damage(rows: DataFrame) -> DataFrame:
    """Rows of a conversation table, damaged by a fixed rule on (conv_id, turn); nulls count as one space.

    Of 20 cases 0 drops the row, 1 empties its text, 2 takes out `.!?`, 3 repeats it, 4 makes it the user's. Dropped
    rows stay as rows with `gone`, so that no conversation is lost.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    case = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    text, role = spaced("text"), spaced("role")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), case.alias("case")).select(
        "conv_id", "turn", (F.col("case") == 0).alias("gone"),
        F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") <= 1, "").when(F.col("case") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def with_faults(damaged: DataFrame) -> DataFrame:
    """Adds `blank`, `truncated` and `later`: the role and text stand in an earlier turn of the conversation.

    Earlier turns are found by the least turn of each (conversation, role, text), pre-aggregated over digests; only
    those that occur more than once are joined, by digest, and a conversation of any size can be split there.
    """
    digest = F.sha2(F.concat(F.col("role"), F.lit("\0"), "text"), 256)
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    rows = damaged.withColumns({"digest": digest, "blank": last == "", "truncated": (last != "") & ~last.isin(*ENDS)})
    # A missing turn comes before all others; of a struct with a null it is the least.
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    repeats = (
        rows.where(~F.col("gone")).groupBy("conv_id", "digest").agg(F.min(turn).alias("first"), F.max(turn).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("conv_id").alias("conv"), F.col("digest").alias("of"), "first")
    )
    met = rows.join(settle(repeats, "repeated-turns"), F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("digest") == F.col("of")), "left")
    later = F.col("first").isNotNull() & ~turn.eqNullSafe(F.col("first"))
    return met.select("conv_id", "turn", "gone", "role", "text", "copy", "blank", "truncated", later.alias("later"))


# --- the dynamic program -------------------------------------------------------------------
class Move(NamedTuple):
    """How a place of the pattern is reached: from which place, the edits' initials, and the roles put in before the row."""

    origin: int
    edits: str
    inserted: str
    role: str | None


class Program:
    """Cheapest edits of a conversation, row by row.

    For every place of the pattern one way is held: the cheapest, of equal ones the one whose edits' initials come
    first as text. Each way ends with the edit of the last row, so none is the beginning of another and their order
    never changes later. Costs are kept above the least one, so few different states occur; steps are worked out
    once per state and kind of row.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.steps: list[tuple[tuple, int, tuple[Move | None, ...]]] = []

    def _ways(self, place: int) -> Iterator[tuple[int, str, int]]:
        """Places reached by inserting: cost, roles put in, place."""
        cost, inserted = 0, ""
        yield cost, inserted, place
        for _ in range(2):
            letter = "a" if place == USER else "u"
            place, cost, inserted = LEADS[place, letter], cost + INSERT, inserted + letter
            yield cost, inserted, place

    def step(self, state: tuple, kind: tuple) -> int:
        """Number of the step from `state` by a row of `kind`: (initial, has to go, is truncated)."""
        found = self.known.get((state, kind))
        if found is None:
            found = self.known[state, kind] = len(self.steps)
            self.steps.append(self._step(state, kind))
        return found

    def _step(self, state: tuple, kind: tuple) -> tuple:
        initial, must_go, truncated = kind
        best: dict[int, tuple] = {}

        def offer(place: int, cost: int, rank: int, edits: str, move: Move) -> None:
            if place not in best or (cost, rank, edits) < best[place][:3]:
                best[place] = (cost, rank, edits, move)

        for origin, held in enumerate(state):
            if held is None:
                continue
            for more, inserted, place in self._ways(origin):
                cost, before = held[0] + more, "I" * len(inserted)
                offer(place, cost + DELETE, held[1], before + "D", Move(origin, before + "D", inserted, None))
                if must_go:
                    continue
                cost += TRUNCATED * truncated
                if (place, initial) in LEADS:
                    offer(LEADS[place, initial], cost, held[1], before + "K", Move(origin, before + "K", inserted, initial))
                for letter in ROLES:
                    if (place, letter) in LEADS:
                        offer(LEADS[place, letter], cost + REROLE, held[1], before + "R", Move(origin, before + "R", inserted, letter))
        least = min(b[0] for b in best.values())
        ranks = {p: n for n, p in enumerate(sorted(best, key=lambda p: best[p][1:3]))}
        following = tuple((best[p][0] - least, ranks[p]) if p in best else None for p in range(4))
        return following, least, tuple(best[p][3] if p in best else None for p in range(4))

    def finish(self, state: tuple) -> tuple[int, Move]:
        """Cost and move to the end."""
        ways = [
            (held[0] + more, held[1], "I" * len(inserted), Move(origin, "I" * len(inserted), inserted, None))
            for origin, held in enumerate(state) if held is not None
            for more, inserted, place in self._ways(origin) if place in ENDING
        ]
        best = min(ways, key=lambda w: w[:3])
        return best[0], best[3]


BEGIN = ((0, 0), None, None, None)


class BackPointers:
    """Numbers of the steps taken; whole blocks are written to a file of the shared folder and read backwards."""

    def __init__(self, folder: str, kept: int = 0):
        self.kept, self.folder = kept or KEPT_ROWS, folder
        self.rows, self.files = array("I"), []

    def add(self, step: int) -> None:
        self.rows.append(step)
        if len(self.rows) >= self.kept:
            store, path = fs.FileSystem.from_uri(self.folder)
            store.create_dir(path, recursive=True)
            self.files.append(f"{path}/{uuid.uuid4().hex}")
            with store.open_output_stream(self.files[-1]) as file:
                file.write(self.rows.tobytes())
            self.rows = array("I")

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.rows)
        if self.files:
            store, _ = fs.FileSystem.from_uri(self.folder)
            for name in reversed(self.files):
                with store.open_input_stream(name) as file:
                    block = array("I")
                    block.frombytes(file.read())
                store.delete_file(name)
                yield from reversed(block)


class Conversation:
    """One conversation while its rows pass by."""

    def __init__(self, program: Program, folder: str):
        self.program, self.state, self.cost = program, BEGIN, 0
        self.back = BackPointers(folder)
        # Of every place: the hash of the repaired conversation so far, and whether it has a line yet.
        self.texts: list[tuple | None] = [(hashlib.sha256(), False), None, None, None]
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.before: str | None = None
        self.last_row: tuple | None = None
        self.least = self.most = None
        self.turns = 0

    @staticmethod
    def _write(text: tuple, lines: list[str]) -> tuple:
        if not lines:
            return text
        joined = text[0].copy()
        joined.update((("\n" if text[1] else "") + "\n".join(lines)).encode("utf-8", "surrogatepass"))
        return joined, True

    def add(self, turn: str | None, role: str, text: str, blank: bool, truncated: bool, later: bool) -> None:
        if turn is not None and turn != self.most:
            self.least = turn if self.least is None else self.least
            self.most = turn
            self.turns += 1
        # Equal rows of one turn follow each other.
        duplicate = later or self.last_row == (turn, role, text)
        self.last_row = (turn, role, text)
        fault = "blank" if blank else "duplicate" if duplicate else "truncated" if truncated else None
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        kind = (initial if initial in "sua" else "", fault in ("blank", "duplicate"), fault == "truncated")
        number = self.program.step(self.state, kind)
        self.back.add(number)
        self.state, least, moves = self.program.steps[number]
        self.cost += least
        texts = [None] * 4
        for place, move in enumerate(moves):
            if move is not None:
                lines = [f"{ROLES[i]}:" for i in move.inserted]
                if move.role is not None:
                    lines.append(f"{role if move.edits[-1] == 'K' else ROLES[move.role]}:{text}")
                texts[place] = self._write(self.texts[move.origin], lines)
        self.texts = texts

    def result(self) -> dict:
        more, move = self.program.finish(self.state)
        text = self._write(self.texts[move.origin], [f"{ROLES[i]}:" for i in move.inserted])
        edits, place = [move.edits], move.origin
        for number in self.back.backwards():
            step = self.program.steps[number][2][place]
            edits.append(step.edits)
            place = step.origin
        gaps = int(self.most) - int(self.least) + 1 - self.turns if self.turns else 0
        return {"gaps": gaps, **self.counts, "cost": self.cost + more, "audit": "".join(reversed(edits)), "repaired_sha256": text[0].hexdigest()}


RESULT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(faulty: DataFrame) -> DataFrame:
    """Results of all conversations of `with_faults` rows.

    Rows are dealt out by conversation and sorted by turn, missing turns first; of one turn by role, text and copy. One
    row at a time is looked at, so a conversation of any length takes a task's time, not its memory: four hashes, and
    back-pointers that are written to the shared folder in blocks.
    """
    folder = scratch_path(faulty.sparkSession, "back-pointers")
    names = [part.split()[0] for part in RESULT.split(", ")]

    def batches(given: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program, one, conv = Program(), None, None
        done: list[dict] = []
        for batch in given:
            columns = [batch[c].tolist() for c in ("conv_id", "turn", "gone", "role", "text", "blank", "truncated", "later")]
            for conv_id, turn, gone, role, text, blank, truncated, later in zip(*columns):
                if one is None or conv_id != conv:
                    if one is not None:
                        done.append({"conv_id": conv, **one.result()})
                    one, conv = Conversation(program, folder), conv_id
                if not gone:
                    one.add(turn, role, text, blank, truncated, later)
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if one is not None:
            yield pd.DataFrame([{"conv_id": conv, **one.result()}], columns=names)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    rows = faulty.repartition("conv_id").sortWithinPartitions(*order)
    # Numbers that may be missing pass as text; pandas would make them floats.
    named = rows.select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "gone", "role", "text", "blank", "truncated", "later")
    return on_workers_pandas(named, batches, RESULT).withColumn("conv_id", F.col("conv_id").cast("long"))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """`(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)` of every conversation.

    Counts and cheapest edits of the rows as they are; null roles and texts count as one space, missing turns come first
    and don't count for gaps, rows without a conv_id are one conversation. Rows that repeat (turn, role, text) are
    duplicates; ties of a turn are ordered by role and text. Other columns are ignored; no rows give no rows.
    """
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    plain = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lit(False).alias("gone"), spaced("role"), spaced("text"), F.lit(0).alias("copy"))
    return repair(with_faults(plain))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(with_faults(damage(table(spark, sf_dir, "conversations"))))
