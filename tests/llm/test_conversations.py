"""Conversation repair against a search of all edit sequences."""

import hashlib
import random
import re
import zlib

from tessel.llm import conversations
from tessel.llm.conversations import Walk, damaged, distances, repair, repair_rows

WHITE = "\x20\x09-\x0D"
ROLES = ["user", "assistant", "system", "tool", " ", "", "User"]


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """(facts and audit) of a conversation's rows in order: every sequence of edits within the cost of deleting all is tried."""
    faults, seen = [], set()
    for _, _, role, text in rows:
        last = re.findall(f"[^{WHITE}]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [(2 * len(rows), "D" * len(rows), [])]

    def go(i, cost, audit, roles, kept):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best[0] = min(best[0], (cost, audit, kept))
        if i < len(rows):
            _, _, role, text = rows[i]
            go(i + 1, cost + 2, audit + "D", roles, kept)
            if faults[i] in ("", "truncated"):
                more = 5 if faults[i] else 0
                if role:
                    go(i + 1, cost + more, audit + "K", roles + role[0], [*kept, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, cost + more + 1, audit + "R", roles + new[0], [*kept, (new, text)])
        for new in ("user", "assistant"):
            go(i, cost + 5, audit + "I", roles + new[0], [*kept, (new, "")])

    go(0, 0, "", "", [])
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, kept = best[0]
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def plain(rows, damage=True):
    left = plain_damage(rows) if damage else rows
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest())
    return {c: plain_repair(sorted((r for r in left if r[0] == c), key=order)) for c in {r[0] for r in rows}}


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def conversation(conv, n, seed):
    r = random.Random(seed)
    bag = ["Yes.", "No!", "why", "  ", "", "\x0b", "a. b", "é?", "\x1c", "x.\n", "y \t", None]
    return [(conv, r.choice([i, i, i, None, 2 * i]), r.choice(ROLES[: r.choice([2, 3, 7])]), r.choice(bag[: r.choice([2, 4, 12])])) for i in range(n)]


def unique_turns(rows):
    """Of rows of one turn in a conversation one: their order isn't stated by the contract."""
    return list({(c, t): (c, t, role, text) for c, t, role, text in rows}.values())


def test_repair_equals_the_search_of_all_edits(spark):
    rows = [r for c in range(150) for r in unique_turns(conversation(c, random.Random(c).randrange(1, 6), c))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (500, None, None, None)]
    rows += [(600, 1, "user", "Same."), (600, 1, "user", "Same."), (600, 2, "assistant", "Same."), (600, 2, "assistant", "Same.")]  # repeated rows
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], "conv_id long, turn long, role string, text string, phase int, conv string, again boolean").repartition(5)
    assert found(repair(df)) == plain(rows)


def test_without_damage_and_with_text_ids(spark):
    rows = [(f"c{c}", t, *r) for c in range(40) for t, r in enumerate(x[2:] for x in conversation(c, 5, 1000 + c))]
    rows = [(c, t, role or "", text or "") for c, t, role, text in rows]
    df = spark.createDataFrame([(*r, 0, False) for r in rows], "conv string, turn int, role string, text string, copy int, lost boolean")
    assert found(repair_rows(df)) == plain(rows, damage=False)


def test_a_long_conversation_in_small_batches(spark):
    """Rows of one conversation come in many batches, twice."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Sentence {i}.") for i in range(6000)] + [(2, 0, "user", "x" * 2_000_000 + ".")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = found(repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    left = [r for r in plain_damage(rows) if r[0] == 1]
    assert got[1][0] == 6000 - len({r[1] for r in left if 0 < r[1] < 5999} | {0, 5999}) and len(got[1][6].replace("I", "")) == len(left) and got[1][5] > 0
    assert got[2][6] in ("D", "") and got[2][5] in (0, 2)


def test_queue_and_walk_agree_with_relaxation():
    for seed in range(200):
        r = random.Random(seed)
        flags = bytes(r.choice([0, 1, 2, 3]) | r.choice([0, 0, conversations.GONE, conversations.CUT_SHORT]) for _ in range(r.randrange(8)))
        far = distances(flags)
        best = [10**6] * len(far)
        for q in conversations.ENDS:
            best[4 * len(flags) + q] = 0
        for _ in range(40):  # Bellman-Ford
            for i in range(len(flags) + 1):
                for q in range(4):
                    to = [(4 * i + conversations.NEXT[q], 5)]
                    if i < len(flags):
                        f, more = flags[i], 5 if flags[i] & conversations.CUT_SHORT else 0
                        to.append((4 * i + 4 + q, 2))
                        if not f & conversations.GONE:
                            to.append((4 * i + 4 + conversations.NEXT[q], 1 + more))
                            kept = conversations.KEPT[q].get("sua?"[f & 3])
                            to += [(4 * i + 4 + kept, more)] if kept is not None else []
                    best[4 * i + q] = min([best[4 * i + q], *(best[t] + c for t, c in to)])
        assert list(far) == best
        walk = Walk(flags)
        for _ in flags:
            list(walk.take("user", ""))
        list(walk.end())
        assert walk.state in conversations.ENDS and len(walk.letters.replace(b"I", b"")) == len(flags)


def test_empty_table_and_all_rows_lost(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair(spark.createDataFrame([], schema)).count() == 0
    lost = next(i for i in range(10**4) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], schema)
    assert damaged(df).where("NOT lost").count() == 0
    assert found(repair(df)) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
