"""Conversation repair against trying all edits, and against a plain dynamic program with whole strings."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from specimen_spark.llm import structure

LEGAL = re.compile("(s?(ua)+)?")
SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, place string, segment string, fault string, n string"


def rows_after_damage(rows):
    """conv -> rows by turn (null first), role and text."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hurt = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if hurt == 1 else re.sub("[.!?]", "", text) if hurt == 2 else text
        role = "user" if hurt == 4 else role
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(hurt, 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, repaired) by keeping the least (cost, audit) of each role string's state."""
    best = {"": (0, "", ())}  # keyed by the last initials: "", s, u, a

    def grown(states):
        for _ in range(2):
            for last, (cost, audit, kept) in list(states.items()):
                role = "assistant" if last == "u" else "user"
                offer(states, role[0], (cost + 2, audit + "I", (*kept, f"{role}:")))
        return states

    def offer(states, last, value):
        if last not in states or value[:2] < states[last][:2]:
            states[last] = value

    for (_, role, text), fault in zip(rows, found):
        new = {}
        for last, (cost, audit, kept) in grown(dict(best)).items():
            offer(new, last, (cost + 3, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if role[:1] in {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[last]:
                offer(new, role[:1], (cost + more, audit + "K", (*kept, f"{role}:{text}")))
            other = "assistant" if last == "u" else "user"
            offer(new, other[0], (cost + 2 + more, audit + "R", (*kept, f"{other}:{text}")))
        best = new
    ends = grown(dict(best))
    return min((ends[k] for k in ("", "a") if k in ends), key=lambda v: v[:2])


def expected(rows):
    out = []
    for conv, mine in rows_after_damage(rows).items():
        found = faults(mine)
        cost, audit, kept = cheapest(mine, found)
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                    hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def all_edits(initials, found, spare):
    """Every (cost, audit) with a legal result and at most ``spare`` insertions."""
    def walk(i, cost, audit, roles, left):
        if i == len(initials) and LEGAL.fullmatch(roles):
            yield cost, audit
        if left:
            for r in "ua":
                yield from walk(i, cost + 2, audit + "I", roles + r, left - 1)
        if i < len(initials):
            yield from walk(i + 1, cost + 3, audit + "D", roles, left)
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                yield from walk(i + 1, cost + more, audit + "K", roles + initials[i], left)
                for r in "ua":
                    yield from walk(i + 1, cost + 2 + more, audit + "R", roles + r, left)

    return min(walk(0, 0, "", "", spare))


def test_letters_are_the_least_of_all_cheapest_edits():
    random.seed(11)
    repairer = structure.Repairer()
    for _ in range(250):
        n = random.randint(0, 4)
        initials = [random.choice("suax") for _ in range(n)]
        found = [random.choice(["", "", "blank", "duplicate", "truncated"]) for _ in range(n)]
        codes = [(x if x in "sua" else "", f in ("blank", "duplicate"), f == "truncated") for x, f in zip(initials, found)]
        effect = repairer.effect(codes)
        (before, after), = structure.crossings([effect], repairer)
        more, added = repairer.ending(after)
        got = effect[before][after][0] + more, "".join(repairer.letters(codes, before, after)) + "I" * added
        assert got == all_edits(initials, found, 3), (initials, found)
        rows, plain = [(None, x, x) for x in initials], cheapest([(None, x, x) for x in initials], found)
        assert len(rows) == n and plain[:2] == got


def test_halves_and_segments_agree_with_one_walk():
    random.seed(12)
    repairer = structure.Repairer()
    for n in (1, 2, 7, 50, 333):
        initials = [random.choice("sua?") for _ in range(n)]
        found = [random.choice(["", "", "", "blank", "truncated"]) for _ in range(n)]
        codes = [(x if x in "sua" else "", f == "blank", f == "truncated") for x, f in zip(initials, found)]
        want = cheapest([(None, x, "") for x in initials], found)[:2]
        for size in (1, 3, 10, n):
            parts = [codes[i : i + size] for i in range(0, n, size)]
            effects = [repairer.effect(p) for p in parts]
            states = structure.crossings(effects, repairer)
            more, added = repairer.ending(states[-1][1])
            audit = "".join(x for p, (b, a) in zip(parts, states) for x in repairer.letters(p, b, a)) + "I" * added
            cost = sum(e[b][a][0] for e, (b, a) in zip(effects, states)) + more
            assert (cost, audit) == want, (n, size)


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_damaged_conversations(spark):
    random.seed(13)
    roles = ["user", "assistant", "system", "tool", None, "", "User", "ü"]
    texts = ["fine.", "really?", "cut", "cut ", "done! \n", "", " \t", None, "fine.", "ok.\x0b", "x" * 20_000 + ".", "é。"]
    rows = [(c, t, random.choice(roles), random.choice(texts)) for c in range(60) for t in random.sample(range(12), random.randint(1, 9))]
    rows += [(None, t, "user", "hello.") for t in range(40)] + [(70, None, "user", "a."), (70, None, "user", "a."), (70, 4, "assistant", "b."), (70, 4, "user", "b.")]
    rows += [(71, 5, "user", "same.")] * 30 + [(72, t, "user", "same.") for t in range(300)] + [(73, 2**40, "user", "a."), (73, -5, "system", "b.")]
    rows += [(90 + i, i, "user", "one.") for i in range(40)]  # some lose their only row
    turns = spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA)
    from tests.llm.cases import same

    for frame in (turns, turns.repartition(7)):
        got = structure.digest(structure.repair(structure.damaged(frame), count="n")).collect()
        same(got, expected(rows))
    gone = [r for r in got if r.audit == ""]
    assert gone and all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() and not any(r[1:7]) for r in gone)
    assert structure.digest(structure.repair(structure.damaged(turns.limit(0)), count="n")).count() == 0


def test_one_conversation_over_many_segments(spark):
    random.seed(14)
    rows = [(1, t, random.choice(["user", "assistant", "system"]), random.choice(["a.", "b", f"own {t}.", f"own {t}", ""])) for t in range(3000)]
    turns = spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA).repartition(16)
    (got,) = structure.digest(structure.repair(structure.damaged(turns), count="n")).collect()
    assert tuple(got) == expected(rows)[0]
    assert structure.repair(turns).filter("n > 0").count() == 3000


def test_given_conversations(spark):
    from tests.llm.cases import same

    rows = rows_of(spark.read.parquet(f"{SF}/conversations.parquet"))
    same(structure.op12_structure(spark, SF).collect(), expected(rows))
