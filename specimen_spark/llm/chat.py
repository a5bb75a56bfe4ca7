"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with the
assistant. Repair walks an automaton whose state is the role written last. Each input turn is kept, given
another role, or merged into the turn written last; empty turns may be inserted before it and at the
end. Each choice has a cost, and dynamic programming finds the cheapest walk.

A conversation of any length is cut into segments. A segment's effect is a 4 x 4 matrix of least costs
between states, and matrices of neighbouring segments combine by (min, +). So segments are worked on
apart: first their matrices, then each conversation's states at segment borders, then each segment's
choices. No task holds more turns of a conversation than one segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.llm.common import prepared, staged, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # the role written last
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
UNKNOWN = 0  # code of an input role that is none of ROLES; the others are the states' numbers


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 2
    name_unknown: int = 1
    insert: int = 3


def choices(costs: Costs) -> dict:
    """(state, role) -> [(new state, cost, action, inserted roles)], preferred ones first."""
    out = {}
    for state in range(4):
        for role in range(4):
            found = []
            for new in (USER, ASSISTANT, SYSTEM):
                label = 0 if new == role else costs.name_unknown if role == UNKNOWN else costs.relabel
                action = "keep" if new == role else "relabel"
                if new in NEXT[state]:
                    found.append((new, label, action, ()))
                for between in NEXT[state]:
                    if new in NEXT[between]:
                        found.append((new, label + costs.insert, action, (between,)))
            if state != START:
                label = 0 if state == role else costs.name_unknown if role == UNKNOWN else costs.relabel
                found.append((state, costs.merge + label, "merge", ()))
            rank = {"keep": 0, "merge": 1, "relabel": 2}
            out[state, role] = sorted(found, key=lambda c: (c[1], len(c[3]), rank[c[2]], c[0]))
    return out


def endings(costs: Costs) -> list[tuple[int, tuple]]:
    """Cost and inserted roles that end a conversation in each state."""
    return [(0, ()), (2 * costs.insert, (USER, ASSISTANT)), (costs.insert, (ASSISTANT,)), (0, ())]


def steps(costs: Costs) -> dict:
    """role -> 4 x 4 least costs from state to state."""
    out = {}
    for role in range(4):
        m = np.full((4, 4), np.inf)
        for state in range(4):
            for new, cost, _, _ in choices(costs)[state, role]:
                m[state, new] = min(m[state, new], cost)
        out[role] = m
    return out


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def border_states(matrices: list[np.ndarray], ends: list) -> list[tuple[int, int]]:
    """(state before, state after) of each segment on the cheapest walk through all."""
    forward = [np.array([0, np.inf, np.inf, np.inf])]
    for m in matrices:
        forward.append((forward[-1][:, None] + m).min(axis=0))
    after = int(np.argmin(forward[-1] + [c for c, _ in ends]))
    out = []
    for m, before in zip(matrices[::-1], forward[-2::-1]):
        at = int(np.argmin(before + m[:, after]))
        out.append((at, after))
        after = at
    return out[::-1]


def walk(roles, before: int, after: int, table_: dict) -> list:
    """The choice for each turn on the cheapest walk between two states."""
    cost = np.full(4, np.inf)
    cost[before] = 0
    back = []
    for role in roles:
        new, step = np.full(4, np.inf), [None] * 4
        for state in range(4):
            if np.isfinite(cost[state]):
                for choice in table_[state, role]:
                    if cost[state] + choice[1] < new[choice[0]]:
                        new[choice[0]], step[choice[0]] = cost[state] + choice[1], (state, choice)
        cost = new
        back.append(step)
    out, state = [], after
    for step in reversed(back):
        state, choice = step[state]
        out.append(choice)
    return out[::-1]


def role_code(column):
    name = F.lower(F.trim(column))
    return F.when(name == "system", SYSTEM).when(name == "user", USER).when(name == "assistant", ASSISTANT).otherwise(UNKNOWN)


def _groups(batches, columns: list[str]):
    """Tables of consecutive rows with equal ``columns``, over batches of sorted rows."""
    held = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        at = 0
        for i in range(len(keys)):
            if keys[i] != key:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, key, at = [], keys[i], i
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row per different turn: conv_id, turn, role, new_role, action, inserted, cost, text, rendered.

    ``inserted`` names empty turns written before this one, or after the conversation's last one.
    ``rendered`` is this turn's part of the repaired sequence: the parts of a conversation, in order of
    ``turn`` (then role and text), make up the whole. Turn marks inside texts are broken up.

    Rows equal in conv_id, turn, role and text count once; ties in ``turn`` are ordered by role, then
    text; a null turn comes first; null conv_ids form one conversation; null text is empty; roles
    are compared without case, and null or unknown ones must be named. An empty table gives no rows.
    Other columns are not read.
    """
    prepared(turns.sparkSession)
    options, ends, matrix = choices(costs), endings(costs), steps(costs)
    plain = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    ).distinct().withColumn("code", role_code(F.col("role")))
    # A segment is the part of a conversation in one range partition; inside it turns are sorted.
    spread = plain.repartitionByRange("conv_id", "turn", "role", "text").withColumn("segment", F.spark_partition_id())
    rows = staged(spread, "turns")

    def effects(batches):
        for part in _groups(batches, ["conv_id", "segment"]):
            m = None
            for role in part.column("code").to_pylist():
                m = matrix[role] if m is None else combined(m, matrix[role])
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([part.column("conv_id")[0].as_py()], pa.int64()),
                "segment": pa.array([part.column("segment")[0].as_py()], pa.int32()),
                "effect": pa.array([m.astype("<f8").tobytes()], pa.binary())})

    def borders(batches):
        for part in _groups(batches, ["conv_id"]):
            m = [np.frombuffer(e, "<f8").reshape(4, 4) for e in part.column("effect").to_pylist()]
            found = border_states(m, ends)
            yield pa.RecordBatch.from_pydict({
                "b_conv": part.column("conv_id").combine_chunks(), "b_segment": part.column("segment").combine_chunks(),
                "before": pa.array([b for b, _ in found], pa.int32()), "after": pa.array([a for _, a in found], pa.int32()),
                "last": pa.array([i == len(m) - 1 for i in range(len(m))])})

    def repaired(batches):
        for part in _groups(batches, ["conv_id", "segment"]):
            before, after = part.column("before")[0].as_py(), part.column("after")[0].as_py()
            chosen = walk(part.column("code").to_pylist(), before, after, options)
            last = part.column("last")[0].as_py()
            cells = {k: [] for k in ("new_role", "action", "inserted", "cost", "rendered")}
            for i, ((new, cost, action, added), text) in enumerate(zip(chosen, part.column("text").to_pylist())):
                end = ends[after] if last and i == len(chosen) - 1 else (0, ())
                cells["new_role"].append(ROLES[new - 1])
                cells["action"].append(action)
                cells["inserted"].append([ROLES[r - 1] for r in (*added, *end[1])])
                cells["cost"].append(cost + end[0])
                cells["rendered"].append(rendered(text or "", new, action, added, end[1]))
            kept = part.select(["conv_id", "turn", "role", "text"])
            for k, t in (("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.list_(pa.string())),
                         ("cost", pa.int64()), ("rendered", pa.string())):
                kept = kept.append_column(k, pa.array(cells[k], t))
            yield from kept.combine_chunks().to_batches()

    keyed = rows.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "text")
    effect = keyed.mapInArrow(effects, "conv_id long, segment int, effect binary")
    border = staged(
        effect.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(
            borders, "b_conv long, b_segment int, before int, after int, last boolean"),
        "borders",
    )
    joined = rows.join(border, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("segment") == F.col("b_segment")))
    return joined.drop("b_conv", "b_segment").repartition("conv_id", "segment").sortWithinPartitions(
        "conv_id", "segment", "turn", "role", "text").mapInArrow(
        repaired,
        "conv_id long, turn long, role string, text string, new_role string, action string, "
        "inserted array<string>, cost long, rendered string")


OPEN, CLOSE = "<|turn|>", "<|end|>"


def rendered(text: str, role: int, action: str, before: tuple, after: tuple) -> str:
    """A turn's part of the sequence: a turn is OPEN role, its texts on a line each, CLOSE.

    A part that opens a turn closes the one before it; ``conversations`` closes the last one and
    leaves out what the first part would close.
    """
    text = text.replace("<|", "< |")
    empty = "".join(f"{OPEN}{ROLES[r - 1]}\n{CLOSE}\n" for r in before)
    tail = "".join(f"{CLOSE}\n{OPEN}{ROLES[r - 1]}\n" for r in after)
    if action == "merge":
        return f"{text}\n{tail}"
    return f"{CLOSE}\n{empty}{OPEN}{ROLES[role - 1]}\n{text}\n{tail}"


def conversations(repaired: DataFrame) -> DataFrame:
    """(conv_id, sequence): whole conversations; a cell is as long as its conversation."""
    parts = F.array_sort(F.collect_list(F.struct(
        F.coalesce("turn", F.lit(-(1 << 63) + 1)).alias("t"), F.coalesce("role", F.lit("")).alias("r"),
        F.coalesce("text", F.lit("")).alias("x"), "rendered")))
    joined = F.array_join(F.transform(parts, lambda p: p["rendered"]), "")
    return repaired.groupBy("conv_id").agg(joined.alias("s")).select(
        "conv_id", F.concat(F.expr(f"substring(s, {len(CLOSE) + 2})"), F.lit(f"{CLOSE}\n")).alias("sequence"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations: a row per turn with its repair and the digest of its rendered part."""
    out = repair(table(spark, sf_dir, "conversations"))
    return out.select(
        "conv_id", "turn", "role", "new_role", "action", F.array_join("inserted", ",").alias("inserted"), "cost",
        F.sha2("rendered", 256).alias("rendered_sha256"))
