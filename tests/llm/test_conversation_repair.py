import hashlib
import re
import zlib

import pytest

from loomlog.llm.conversation_repair import Search, damaged, repair, repaired_turns

FORM = re.compile("(s?(ua)+)?")
INSERTS = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user"), ("user", "assistant", "user")]


def judged(rows):
    """(role, text, first fault) of turns in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def cheapest(turns):
    """By trying every edit of every turn, with up to three inserted turns after each, and keeping what has the form."""
    ways = [(0, "", ())]
    more = lambda ways: [(c + 5 * len(x), a + "I" * len(x), k + tuple((r, "") for r in x)) for c, a, k in ways for x in INSERTS]
    possible = lambda k: re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] if r else "-" for r, _ in k))
    ways = [w for w in more(ways) if possible(w[2])]
    for role, text, fault in turns:
        step = [(c + 2, a + "D", k) for c, a, k in ways]
        if fault not in ("blank", "duplicate"):
            x = 5 if fault == "truncated" else 0
            step += [(c + x + (0 if e == "K" else 1), a + e, (*k, (r, text))) for c, a, k in ways for e, r in (("K", role), ("R", "user"), ("R", "assistant"))]
        ways = [w for w in more([w for w in step if possible(w[2])]) if possible(w[2])]
        best = {}
        for w in ways:  # one way for each string of roles' last state and audit is enough, as the rest does not depend on more
            best[w[1], "".join(r[:1] for r, _ in w[2])] = w
        ways = sorted(best.values())[:20_000]
    return min(w for w in ways if FORM.fullmatch("".join(r[:1] for r, _ in w[2])))


def plain(name, rows):
    """The row of a conversation; rows: (turn, role, text), already in order."""
    turns = judged([r[1:] for r in rows])
    cost, audit, kept = cheapest(turns)
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    count = lambda f: sum(t[2] == f for t in turns)
    return (name, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()), kept


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def test_repair_is_the_cheapest(spark, rng):
    rows, want, turns = [], [], []
    for name in range(250):
        size = rng.randint(1, 5)
        own = [(rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "system", "system", "tool", "u", "", None, "user", "assistant"]), rng.choice(["Yes.", "no", " ", "", "What? \n", "x!", "Yes.", None])) for _ in range(size)]
        rows += [(name, *r, "extra") for r in own]
        row, kept = plain(name, in_order([(n, " " if r is None else r, " " if t is None else t) for n, r, t in own]))
        want.append(row)
        turns += [(name, k, r, t) for k, (r, t) in enumerate(kept, 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(5)
    assert sorted(map(tuple, repair(table).collect())) == want
    got = repaired_turns(table).collect()
    assert sorted((r.conv_id, r.place, r.role, r.text) for r in got) == sorted(turns)
    assert all((r.edit == "I") == (r.text == "" and r.turn is None) or r.turn is None for r in got)


def whole(turns):
    """A plain forward search with whole strings."""
    step = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    close = lambda ways: [min([w for w in (ways[s], *[(c + 5, a + "I") for p, x in enumerate(ways) if x for c, a in [x] for r in "ua" if step[p].get(r) == s]) if w], default=None) for s in range(4)]
    ways = close(close([(0, ""), None, None, None]))
    for role, _, fault in turns:
        out = [[] for _ in range(4)]
        for p, w in enumerate(ways):
            if w:
                out[p].append((w[0] + 2, w[1] + "D"))
                for letter, r, cost in (("K", role[:1], 0), ("R", "u", 1), ("R", "a", 1)):
                    if fault not in (1, 2) and r in step[p]:
                        out[step[p][r]].append((w[0] + cost + 5 * (fault == 3), w[1] + letter))
        ways = close(close([min(x, default=None) for x in out]))
    return min(w for w in (ways[0], ways[3]) if w)


@pytest.mark.parametrize("roles", [["user", "assistant"], ["tool"], ["user", "assistant", "system", "tool"], ["user"]])
def test_long_conversations(rng, roles):
    turns = [(rng.choice(roles), "x.", rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(3000)]
    search = Search()
    for t in turns:
        search.turn(*t)
    best = search.result()
    assert (best.cost, best.audit()) == whole(turns)


def test_damage_and_odd_tables(spark, rng):
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["Good day.", "So? Yes! No.", None, "and", "x" * 5000 + "."])) for c in [*range(40), None] for t in [*range(rng.randint(0, 4)), None][: rng.randint(1, 4)]]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    left = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        own = left.setdefault(c, [])
        if kind:
            new = (t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            own += [new] * (2 if kind == 3 else 1)
    want = [plain(c, in_order(own))[0] for c, own in left.items()]
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, repair(damaged(table), present="here").collect()), key=key) == sorted(want, key=key)
    none = spark.createDataFrame([], table.schema)
    assert repair(damaged(none), present="here").count() == 0 == repair(none).count() == repaired_turns(none).count()
    gone = damaged(spark.createDataFrame([(7, None, "user", "a.")], table.schema)).selectExpr("conv_id", "turn", "role", "text", "false AS here")
    assert [tuple(r) for r in repair(gone, present="here").collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_conversation_of_many_equal_turns(spark):
    table = spark.range(20_000).selectExpr("1L AS conv_id", "id % 2 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'Yes.' AS text")
    row = repair(table).first()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (19_998, 19_998, 2 * 19_998, "K" + "D" * 9999 + "K" + "D" * 9999)
