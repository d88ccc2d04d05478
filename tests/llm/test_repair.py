"""Conversation repair against a search over all edits."""

import hashlib
import random

import pytest

from voxelloom.llm import repair as R
from voxelloom.llm.setup import ready

ROLES = ["system", "user", "assistant", "tool", "", "unicorn", None]
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(rows):
    """rows: (role, text) in order -> (cost, audit, turns), by all walks that keep the pattern possible (no weights)."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    walks = [("", 0, "", [])]
    names = {"u": "user", "a": "assistant"}

    def inserted(walks):
        out = list(walks)
        for _ in range(2):
            walks = [(move[s, c], cost + 3, audit + "I", [*turns, (names[c], "")]) for s, cost, audit, turns in walks for c in "ua" if (s, c) in move]
            out += walks
        return out

    for (role, text), fault in zip(rows, plain_faults(rows)):
        after = []
        for s, cost, audit, turns in inserted(walks):
            after.append((s, cost + 4, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            fee = 3 * (fault == "truncated")
            if (s, role[:1]) in move:
                after.append((move[s, role[:1]], cost + fee, audit + "K", [*turns, (role, text)]))
            after += [(move[s, c], cost + 3 + fee, audit + "R", [*turns, (names[c], text)]) for c in "ua" if (s, c) in move]
        best = {}
        for w in after:  # walks dearer than the cheapest of their state by more than any ending are never needed
            best[w[0]] = min(best.get(w[0], w[1]), w[1])
        walks = [w for w in after if w[1] == best[w[0]]]
    ends = [w for w in inserted(walks) if w[0] in ("", "a")]
    return min((cost, audit, turns) for _, cost, audit, turns in ends)


def outcome(conv, rows):
    """rows: (turn, role, text) -> the row that `repair` returns."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    cost, audit, turns = plain([r[1:] for r in rows])
    known = {t for t, *_ in rows if t is not None}
    found = plain_faults([r[1:] for r in rows])
    first = [r[:1] for _, r, _ in rows]
    return (conv, max(known) - min(known) + 1 - len(known) if known else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(), turns)


def flat(r):
    return (r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256, [(t.role, t.text) for t in r.repaired])


@pytest.mark.parametrize("segment", [256, 2])
def test_repair_equals_all_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(R, "SEGMENT", segment)  # tasks run in the same machine but in workers of their own: checked below too
    rng = random.Random(11)
    texts = ["One.", "two", "", " \t\x0b", "Three!", "Four?  ", None, "é…"]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(ROLES), rng.choice(texts)) for c in range(120) for _ in range(rng.randint(1, 8))]
    rows += [(500, 0, "user", "Same."), (500, 0, "user", "Same."), (500, 3, "user", "Same.")]
    df = ready(spark).createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: flat(r) for r in R.repair(df).collect()}
    want = {}
    for c, *row in rows:
        want.setdefault(c, []).append(tuple(row))
    assert got == {c: outcome(c, r) for c, r in want.items()}


@pytest.mark.parametrize("segment", [1, 2, 3, 7])
def test_segments_do_not_change_the_result(monkeypatch, segment):
    rng = random.Random(segment)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "x"]), rng.choice(["A.", "B.", "c", "", "D!", "e"])) for _ in range(rng.randint(0, 9))]
        monkeypatch.setattr(R, "SEGMENT", segment)
        held = R.Repair(True)
        for (role, text), fault in zip(rows, plain_faults(rows)):
            held.add(role, text, fault)
        cost, audit, digest, turns = held.finish()
        turns = [(t["role"], t["text"]) for t in turns]
        assert (cost, audit, turns) == plain(rows)
        assert digest == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def test_a_very_long_conversation_and_an_empty_table(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"Said {i}.") for i in range(20_000)] + [(1, 30_000, "user", "Last")]
    df = ready(spark).createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = R.repair(df, texts=False).first()
    assert (r.cost, r.audit, r.gaps, r.repaired) == (4, "K" * 20_000 + "D", 10_000, None)
    assert R.repair(df.limit(0)).count() == 0


def test_gone_rows_name_their_conversation_and_columns_may_clash(spark):
    rows = [(1, 0, "user", "Hi.", True, 5), (2, 0, "user", "Hi.", False, 6)]
    df = ready(spark).createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean, again long")
    got = {r.conv_id: r for r in R.repair(df, gone="gone").collect()}
    assert flat(got[1]) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest(), [])
    assert (got[2].cost, got[2].audit) == (3, "KI")
    assert [tuple(t) for t in R.turns(R.repair(df, gone="gone")).orderBy("turn").collect()] == [(2, 0, "user", "Hi."), (2, 1, "assistant", "")]
