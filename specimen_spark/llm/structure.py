"""Repair of damaged conversations by Hirschberg's divide and conquer.

A repaired conversation is an optional system turn and then pairs of user and assistant, or nothing.
Edits keep, relabel or delete each row and insert empty turns; the cheapest edits are sought and, among
equally cheap ones, those whose initials in order (D, I, K, R) are least. What was written last is
one of four states, so a half of a conversation is summed up by four forward costs and four backward costs.
They meet in the middle: the crossing state with the least sum is taken, of several the one whose
edits so far are least, and both halves are solved alike. That needs memory for the vectors only.

Edits so far are compared without writing them out. A row's edits end with its own letter, and letters
fix the states, so two different strings over the same rows differ before either ends; hence a state
needs only its rank. Costs and ranks, less their least, form few different vectors, so a row's effect on a
vector is looked up.

A conversation of any length is cut into segments by range partitioning. A segment's effect is the vector
reached from each state; those of a conversation in order give the crossings at segment borders, and
then each segment is solved apart.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.chat import _groups
from specimen_spark.llm.common import prepared, staged, table

START, SYSTEM, USER, ASSISTANT = range(4)  # what was written last
ROLES = ("", "system", "user", "assistant")
#: The state after a turn with this initial, from each state that allows one.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after an inserted or relabelled turn: the only role allowed next, if a system turn isn't inserted.
ADDED = (USER, USER, ASSISTANT, USER)
FINAL = (START, ASSISTANT)
FAR = 1 << 60
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", ""


@dataclass(frozen=True)
class Costs:
    relabel: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


@dataclass
class Repairer:
    """Vectors of (cost, rank) by state, and walks between states."""

    costs: Costs = Costs()
    _ahead: dict = field(default_factory=dict)
    _back: dict = field(default_factory=dict)

    def moves(self, state: int, code: tuple[str, bool, bool]):
        """(new state, cost, letters) of what may be done with a row: (initial, must go, truncated)."""
        initial, bad, cut = code
        for n in range(3):  # more than two insertions lead to no new state
            cost, before = n * self.costs.insert, "I" * n
            yield state, cost + self.costs.delete, before + "D"
            if not bad:
                extra = self.costs.truncated * cut
                if state in AFTER.get(initial, ()):
                    yield AFTER[initial][state], cost + extra, before + "K"
                yield ADDED[state], cost + self.costs.relabel + extra, before + "R"
            state = ADDED[state]

    def ending(self, state: int) -> tuple[int, int]:
        """(cost, number) of the insertions after the last row."""
        n = (0, 2, 1, 0)[state]
        return n * self.costs.insert, n

    def forward(self, vector: tuple, code: tuple) -> tuple[tuple, int]:
        """The vector after a row, less its least cost, and that cost."""
        key = vector, code
        if key not in self._ahead:
            found = {}
            for state, (cost, rank) in enumerate(vector):
                if cost < FAR:
                    for new, more, letters in self.moves(state, code):
                        found[new] = min(found.get(new, (FAR, 0, "")), (cost + more, rank, letters))
            self._ahead[key] = normal([found.get(s, (FAR, 0, "")) for s in range(4)])
        return self._ahead[key]

    def backward(self, vector: tuple, code: tuple) -> tuple[tuple, int]:
        """The costs before a row to the end, less their least, and that."""
        key = vector, code
        if key not in self._back:
            costs = [min((more + vector[new] for new, more, _ in self.moves(s, code)), default=FAR) for s in range(4)]
            least = min(costs)
            self._back[key] = tuple(min(FAR, c - least) if c < FAR else FAR for c in costs), least
        return self._back[key]

    def effect(self, codes: list) -> list[list[tuple[int, int]]]:
        """From each state, the (cost, rank) of each state after the rows."""
        out = []
        for state in range(4):
            vector, base = only(state), 0
            for code in codes:
                vector, more = self.forward(vector, code)
                base += more
            out.append([(c + base if c < FAR else FAR, r) for c, r in vector])
        return out

    def letters(self, codes: list, before: int, after: int) -> list[str]:
        """Of each row, the letters of the least cheapest walk between two states."""
        if not codes:
            return []
        if len(codes) == 1:
            return [min((c, x) for new, c, x in self.moves(before, codes[0]) if new == after)[1]]
        half = len(codes) // 2
        ahead = only(before)
        for code in codes[:half]:
            ahead, _ = self.forward(ahead, code)
        back = tuple(0 if s == after else FAR for s in range(4))
        for code in reversed(codes[half:]):
            back, _ = self.backward(back, code)
        # The crossing: least cost, then least letters so far.
        meet = min(range(4), key=lambda s: (ahead[s][0] + back[s], ahead[s][1]))
        return self.letters(codes[:half], before, meet) + self.letters(codes[half:], meet, after)


def only(state: int) -> tuple:
    return tuple((0, 0) if s == state else (FAR, 0) for s in range(4))


def normal(found: list[tuple]) -> tuple[tuple, int]:
    """(cost, order...) by state, as (cost less the least, rank) and the least."""
    order = {x: i for i, x in enumerate(sorted({f[1:] for f in found if f[0] < FAR}))}
    least = min(f[0] for f in found)
    return tuple((f[0] - least, order[f[1:]]) if f[0] < FAR else (FAR, 0) for f in found), least


def crossings(effects: list, repairer: Repairer) -> list[tuple[int, int]]:
    """(state before, state after) of each segment, for the least cheapest walk through all."""
    back = tuple(repairer.ending(s)[0] for s in range(4))
    to_end = [back]
    for effect in reversed(effects):
        back = tuple(min(min(effect[s][t][0] + back[t], FAR) for t in range(4)) for s in range(4))
        to_end.append(back)
    out, state = [], START
    for effect, rest in zip(effects, to_end[-2::-1]):
        after = min(range(4), key=lambda s: (effect[state][s][0] + rest[s], effect[state][s][1]))
        out.append((state, after))
        state = after
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: conv_id, turn, role, text, n (how often the row stands there, 0 if it is dropped)."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("hurt"))
    hurt = F.col("hurt")
    return rows.select(
        "conv_id", "turn", F.when(hurt == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(hurt == 1, "").when(hurt == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(hurt == 0, 0).when(hurt == 3, 2).otherwise(1).alias("n"))


_SPACES = "' \\t\\n\\u000B\\f\\r'"
_ROW = "conv_id long, turn long, role string, text string, n long, fault string, place long, edits string, cost long, repaired array<string>"


def repair(turns: DataFrame, costs: Costs = Costs(), count: str | None = None) -> DataFrame:
    """A row per different row: conv_id, turn, role, text, n, fault, place, edits, cost, repaired.

    ``turns`` has conv_id, turn, role and text; a column named by ``count`` says how often a row stands there. Rows
    are taken by turn (null first), then role and text; equal ones stand together and count as ``n``.
    ``fault`` is the first copy's: blank, duplicate (role and text stood earlier), truncated (the last
    character other than white space is not one of `.!?`) or empty; further copies are duplicates, or blank.
    ``place`` orders the rows. ``edits`` are the initials of what is done before, to and behind the row,
    ``repaired`` the turns that it leaves as `role:text`. Null role and text are one space, a null conv_id is a
    conversation. A row with a count of 0 only says that its conversation exists. An empty table gives no
    rows; other columns are not read.
    """
    prepared(turns.sparkSession)
    repairer = Repairer(costs)
    n = (F.col(count) if count else F.lit(1)).cast("long")
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"),
                         F.coalesce("text", F.lit(" ")).alias("text"), n.alias("n"))
    there = F.col("n") > 0
    marked = plain.select("conv_id", *(F.when(there, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in (("turn", None), ("role", ""), ("text", ""))), "n")
    rows = staged(marked.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")), "structure-rows")
    # 128 bits stand for a text here: among 10^12 texts two share them with odds of 10^-15.
    said = F.md5("text")
    first = rows.filter(there).groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), said.alias("s")).agg(
        F.min(F.struct("turn")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (said == F.col("s"))
    last = F.right(F.expr(f"trim(TRAILING {_SPACES} FROM text)"), F.lit(1))
    fault = F.when(last == "", BLANK).when(~F.col("turn").eqNullSafe(F.col("first.turn")), DUPLICATE).when(
        ~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    order = ("conv_id", "turn", "role", "text")
    found = rows.join(first, same, "left").select(*rows.columns, F.when(there, fault).otherwise("").alias("fault"))
    # A segment is the part of a conversation in one range partition.
    spread = staged(found.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("segment"), F.monotonically_increasing_id().alias("place")), "structure-segments")

    def codes(part):
        for role, wrong, copies in zip(*(part.column(c).to_pylist() for c in ("role", "fault", "n"))):
            if copies:
                yield role[:1] if role[:1] in AFTER else "", wrong in (BLANK, DUPLICATE), wrong == TRUNCATED

    def effects(batches):
        for part in _groups(batches, ["conv_id", "segment"]):
            effect = repairer.effect(list(codes(part)))
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([part.column("conv_id")[0].as_py()], pa.int64()),
                "segment": pa.array([part.column("segment")[0].as_py()], pa.int32()),
                "effect": pa.array([[x for line in effect for pair in line for x in pair]], pa.list_(pa.int64()))})

    def borders(batches):
        for part in _groups(batches, ["conv_id"]):
            each = [[[(e[8 * s + 2 * t], e[8 * s + 2 * t + 1]) for t in range(4)] for s in range(4)] for e in part.column("effect").to_pylist()]
            states = crossings(each, repairer)
            yield pa.RecordBatch.from_pydict({
                "c": part.column("conv_id").combine_chunks(), "s": part.column("segment").combine_chunks(),
                "before": pa.array([b for b, _ in states], pa.int32()), "after": pa.array([a for _, a in states], pa.int32()),
                "last": pa.array([i == len(states) - 1 for i in range(len(states))])})

    def solved(batches):
        for part in _groups(batches, ["conv_id", "segment"]):
            state, after, ends = (part.column(c)[0].as_py() for c in ("before", "after", "last"))
            walk = iter(repairer.letters(list(codes(part)), state, after))
            more, added = repairer.ending(after) if ends else (0, 0)
            cells = {"edits": [], "cost": [], "repaired": []}
            for i, (role, text, wrong, copies) in enumerate(zip(*(part.column(c).to_pylist() for c in ("role", "text", "fault", "n")))):
                edits = next(walk) + "D" * (copies - 1) if copies else ""
                price = sum(edits.count(x) * c for x, c in (("I", costs.insert), ("D", costs.delete), ("R", costs.relabel)))
                price += costs.truncated * (wrong == TRUNCATED and edits.strip("ID") != "")
                if i == part.num_rows - 1:
                    edits, price = edits + "I" * added, price + more
                kept = []
                for x in edits:
                    if x != "D":
                        state = AFTER[role[:1]][state] if x == "K" else ADDED[state]
                        kept.append(f"{role if x == 'K' else ROLES[state]}:{'' if x == 'I' else text}")
                for name, value in zip(cells, (edits, price, kept)):
                    cells[name].append(value)
            out = part.select(["conv_id", "turn", "role", "text", "n", "fault", "place"])
            for name, kind in (("edits", pa.string()), ("cost", pa.int64()), ("repaired", pa.list_(pa.string()))):
                out = out.append_column(name, pa.array(cells[name], kind))
            yield from out.combine_chunks().to_batches()

    by = ("conv_id", "segment")
    effect = spread.select(*by, "place", "role", "fault", "n").repartition(*by).sortWithinPartitions(*by, "place").mapInArrow(
        effects, "conv_id long, segment int, effect array<long>")
    border = staged(effect.repartition("conv_id").sortWithinPartitions(*by).mapInArrow(
        borders, "c long, s int, before int, after int, last boolean"), "structure-borders")
    joined = spread.join(border, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s"))).drop("c", "s")
    return joined.repartition(*by).sortWithinPartitions(*by, "place").mapInArrow(solved, _ROW)


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Sums:
    """One conversation's figures, row by row."""

    def __init__(self, conv):
        self.conv, self.counts, self.illegal, self.cost = conv, {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, SOUND: 0}, 0, 0
        self.low = self.high = self.initial = None
        self.turns, self.audit, self.sha, self.begun = 0, [], hashlib.sha256(), False

    def add(self, turn, role, n, fault, edits, cost, repaired):
        self.audit.append(edits)
        self.cost += cost
        for line in repaired:
            self.sha.update(("\n" if self.begun else "").encode() + line.encode())
            self.begun = True
        if not n:
            return
        self.counts[fault] += 1
        self.counts[BLANK if fault == BLANK else DUPLICATE] += n - 1
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.illegal += n - 1
        self.initial = initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = (turn if self.low is None else self.low), turn, self.turns + 1

    def row(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


def digest(repaired: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows stream by in order, as its digest asks; only its edits are held.
    """
    def run(batches):
        sums = None
        for batch in batches:
            done = []
            for conv, *rest in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "turn", "role", "n", "fault", "edits", "cost", "repaired"))):
                if sums is None or sums.conv != conv:
                    if sums is not None:
                        done.append(sums.row())
                    sums = _Sums(conv)
                sums.add(*rest)
            if done:
                yield _digests(done)
        if sums is not None:
            yield _digests([sums.row()])

    rows = repaired.select("conv_id", "place", "turn", "role", "n", "fault", "edits", "cost", "repaired")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(run, _DIGEST)


def _digests(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as the contract says and repaired."""
    return digest(repair(damaged(table(spark, sf_dir, "conversations")), count="n"))
