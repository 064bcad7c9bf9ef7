"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from mirador.llm import repair as r

SCHEMA = "conv_id long, turn long, role string, text string, copies string, x int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain(rows):
    """The report of a conversation's rows (turn, role, text), after damage."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    firsts = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))

    @cache
    def best(i, said):
        """(cost, letters, messages) of the rest, after messages with these last initials; inserts in a row are few."""
        found = []
        whole, made = said
        state = whole[-2:] if len(whole) > 2 else whole
        if i == len(rows):
            if GRAMMAR.fullmatch(whole):
                found.append((0, "", ()))
        else:
            _, role, text = rows[i]
            late = 5 * (faults[i] == "t")
            moves = [("D", 2, "", None)]
            if faults[i] not in ("b", "d"):
                moves += [("K", late, role[:1] or "?", (role, text))] + [("R", 1 + late, x[0], (x, text)) for x in ("user", "assistant")]
            for letter, cost, initial, message in moves:
                if not initial or fits(whole + initial):
                    c, letters, rest = best(i + 1, (short(whole + initial), 0))
                    found.append((c + cost, letter + letters, ((message,) if message else ()) + rest))
        if made < 3:
            for x in ("user", "assistant"):
                if fits(whole + x[0]):
                    c, letters, rest = best(i, (short(whole + x[0]), made + 1))
                    found.append((c + 5, "I" + letters, ((x, ""),) + rest))
        return min(found, default=(10**9, "", ()))

    def fits(text):
        return GRAMMAR.fullmatch(text) or GRAMMAR.fullmatch(text + "a") or GRAMMAR.fullmatch(text + "ua")

    def short(text):
        """An equivalent beginning: what may follow hangs on the last initial, and on whether there is any."""
        return {"": "", "s": "s"}.get(text) if len(text) < 2 and text in ("", "s") else "u" if text[-1] == "u" else "ua"

    cost, letters, messages = best(0, ("", 0))
    count = faults.count
    return gaps, count("b"), count("d"), count("t"), illegal, cost, letters, hashlib.sha256("\n".join(f"{a}:{b}" for a, b in messages).encode()).hexdigest(), messages


def damaged(rows):
    """The contract's damage, row by row: (conv_id, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def compare(spark, rows, is_damaged):
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], SCHEMA)
    made = r.damage(df) if is_damaged else r.undamaged(df)
    got = {x[0]: tuple(x)[1:] for x in r.repair_report(made).collect()}
    after = damaged(rows) if is_damaged else [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]
    want = {c: plain([x[1:] for x in after if x[0] == c]) for c in {x[0] for x in rows}}
    assert got == {c: w[:-1] for c, w in want.items()}
    said = {}
    for x in sorted(r.repaired(made).collect(), key=lambda x: x.place):
        said.setdefault(x.conv_id, []).append((x.place, x.role, x.text))
    assert said == {c: [(i + 1, *m) for i, m in enumerate(w[-1])] for c, w in want.items() if w[-1]}


def some_rows(seed, conversations, most):
    rng, out = random.Random(seed), []
    for c in range(conversations):
        for _ in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"])
            out.append((c if c else None, rng.choice([None, *range(9)]), role, rng.choice(["Hi.", "No?", "so", "", " \t", None, "a" + str(rng.randint(0, 3)), "é!"])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_edits(spark, seed):
    compare(spark, some_rows(seed, 60, 9), False)
    compare(spark, some_rows(seed, 60, 9), True)


@pytest.mark.parametrize("size", [2, 4])
def test_conversations_in_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(r, "SEGMENT", size)
    monkeypatch.setattr(r, "told", lambda df, n: df)
    compare(spark, some_rows(5, 25, 14), False)


def test_one_conversation_holds_most_rows(spark):
    rows = [(7, i // 3, random.Random(i).choice(["user", "assistant"]), f"t{i % 40}" + "." * (i % 3)) for i in range(300)] + [(8, 1, "user", "Hi."), (8, 1, "user", "Hi.")]
    compare(spark, rows, False)


def test_layers_are_computed_once_for_a_shared_prefix():
    trie = r.Trie()
    for s in sorted(["EIEI", "EIEIE", "EIEI", "EIA", "E"]):
        trie.insert(s)
    assert trie.computed == len({s[: i + 1] for s in ["EIEI", "EIEIE", "EIEI", "EIA", "E"] for i in range(len(s))})


def test_ties_take_the_least_letters():
    trie = r.Trie()
    trie.insert(r.symbol(1, r.FINE))  # one user's message: deleted for 2, not completed for 5
    assert trie.answer(r.START, r.FINAL, True) == (2, "D", r.START)
    trie.insert(r.symbol(1, r.FINE) + r.symbol(1, r.FINE))  # kept and made an assistant's
    assert trie.answer(r.START, r.FINAL, True) == (1, "KR", r.ASSISTANT)


def test_empty_and_dropped(spark):
    assert r.repair_report(r.damage(spark.createDataFrame([], SCHEMA))).collect() == []
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    compare(spark, [(dropped, 0, "user", "Hi.")], True)


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Text {i}.") for i in range(10_000)] + [(2, 0, "user", "x" * 300_000 + ".")]
    got = {x.conv_id: x for x in r.repair_report(r.undamaged(spark.createDataFrame([(*x, "", 0) for x in rows], SCHEMA))).collect()}
    assert got[1].audit == "K" * 10_000 and got[1].cost == 0 and got[2].audit == "D"
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in rows[:-1]).encode()).hexdigest()


def test_query(spark):
    got = r.op13_conversation_repair(spark, "/root/testdata/sf0.01")
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = damaged(rows)
    assert {x[0]: tuple(x)[1:] for x in got.collect()} == {c: plain([x[1:] for x in after if x[0] == c])[:-1] for c in {x[0] for x in rows}}
