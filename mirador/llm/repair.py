"""Repair of the structure of conversations: the cheapest edits that make the roles follow `(s?(ua)+)?`.

Rows hold conversation id, turn, role and text; a null role or text is one space, a null id or turn stays null and is a group, or
a place before all others, of its own. Rows are taken by turn (nulls first), rows of one turn by role and then by the SHA-256 of
their text. A role counts by its first character, an empty role never fits. A row's first fault counts: blank (no character but
white space), duplicate (role and text seen earlier in the conversation) or truncated (the last character that is no white space
is none of `.!?`). Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only edit of blank and duplicate rows), Insert an
empty message of user or assistant 5; a truncated row that stays costs 5 more. Of equally cheap edits the ASCII-least letters win.
An empty table gives no rows, a conversation without rows an empty repair. Columns beyond the four named are not read.

How it is done: places of all rows come from a range partitioning of small rows (digests in place of texts), with a salt, so that
neither a long conversation nor many equal rows make one large task. Rows become symbols (first character of the role, fault), pieces
of a conversation become signatures of up to SEGMENT symbols. Signatures are sorted and inserted into a prefix trie, of which a
task keeps the path that further sorted signatures can still share; a layer of costs is computed once a node and answers
are made at terminal nodes. A conversation of several pieces is solved piece by piece: a table of costs between the four states
for each piece, costs to go from the last piece back, then the edits of each piece from each state. Texts move once, to where the
letters of their conversation are; there one conversation's texts pass in order, a batch at a time (one hash over a whole
conversation's text cannot be made in parts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import discard, materialize, releasing, small_batches, told

#: Symbols of a signature; a piece is this long at most. A power of two.
SEGMENT = 4096
BLANK_CHARACTERS = " \t\n\x0b\x0c\r"

# ---------------------------------------------------------------- the automaton and its costs

START, SYSTEM, USER, ASSISTANT = range(4)
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NEVER = 1 << 60
INSERTED = (USER, USER, ASSISTANT, USER)  # the state after a made message, from each state
#: By role (system, user, assistant, other): the state after it is kept, from each state; None where it does not fit.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None, None, None, None))
LEGAL_PAIRS = {(0, 1), (1, 2), (2, 1)}
FINAL = (0, NEVER, NEVER, 0)  # nothing at all, or an assistant's message last


def symbol(role: int, fault: int) -> str:
    return chr(65 + 4 * role + fault)


def _edits(char: str) -> list[list[tuple[str, int, int]]]:
    """From each state: (letter, cost, next state) of the edits of a symbol, in ASCII order."""
    role, fault = divmod(ord(char) - 65, 4)
    stay, out = 5 * (fault == TRUNCATED), []
    for q in range(4):
        moves = [("D", 2, q)]
        if fault not in (BLANK, DUPLICATE):
            if KEPT[role][q] is not None:
                moves.append(("K", stay, KEPT[role][q]))
            moves.append(("R", 1 + stay, INSERTED[q]))
        out.append(moves)
    return out


EDITS = {symbol(r, f): _edits(symbol(r, f)) for r in range(4) for f in range(4)}


def _with_inserts(costs: list[int]) -> list[int]:
    """Least costs by state once messages may be inserted."""
    start, system, user, assistant = costs
    user = min(user, start + 5, system + 5, assistant + 5)
    assistant = min(assistant, user + 5)
    return [start, system, user, assistant]


def _step(open_costs: list[int], char: str) -> list[int]:
    """Least costs by state right after an edit of one symbol."""
    out = [NEVER] * 4
    for q, moves in enumerate(EDITS[char]):
        if open_costs[q] < NEVER:
            for _, cost, to in moves:
                if open_costs[q] + cost < out[to]:
                    out[to] = open_costs[q] + cost
    return out


class Trie:
    """A prefix trie of sorted signatures. Sorted insertion only ever branches from the last inserted path, so that path alone is kept.

    A node holds, for each entry state, the least cost of every state right after its symbol and with inserted messages, and of
    its prefix the counts of faults and of illegal pairs."""

    def __init__(self, entries: tuple[int, ...] = (START,)):
        self.entries, self.path, self.computed = entries, "", 0
        root = [[0 if q == p else NEVER for q in range(4)] for p in entries]
        self.after, self.open, self.counts = [root], [[_with_inserts(x) for x in root]], [(0, 0, 0, 0)]

    def insert(self, signature: str) -> None:
        """Makes the path that of this signature; layers are computed for the nodes that are new."""
        shared, most = 0, min(len(signature), len(self.path))
        while shared < most and signature[shared] == self.path[shared]:
            shared += 1
        for layers in (self.after, self.open, self.counts):
            del layers[shared + 1 :]
        for i in range(shared, len(signature)):
            after = [_step(x, signature[i]) for x in self.open[-1]]
            self.after.append(after)
            self.open.append([_with_inserts(x) for x in after])
            role, fault = divmod(ord(signature[i]) - 65, 4)
            pair = i > 0 and ((ord(signature[i - 1]) - 65) // 4, role) not in LEGAL_PAIRS
            c = self.counts[-1]
            self.counts.append((c[0] + (fault == BLANK), c[1] + (fault == DUPLICATE), c[2] + (fault == TRUNCATED), c[3] + pair))
            self.computed += 1
        self.path = signature

    def answer(self, entry: int, to_go: tuple[int, ...] | list[int], last: bool) -> tuple[int, str, int]:
        """At the terminal node: (cost, letters, state at the end) of the cheapest edits from an entry state, ASCII-least among
        them; to_go is what each state costs from there on, and messages may be inserted at the end of a last piece alone."""
        k, n = self.entries.index(entry), len(self.path)
        reach = [x[k] for x in self.open]
        if not last:
            reach[n] = self.after[n][k]
        least = min(a + b for a, b in zip(reach[n], to_go, strict=True))
        if least >= NEVER:
            return NEVER, "", entry
        ends = {q for q in range(4) if reach[n][q] + to_go[q] == least}

        def moves(i: int, q: int) -> Iterator[tuple[str, int, int]]:
            """Edges of a cheapest way from a state, in ASCII order of their letters: (letter, symbols passed, state)."""
            made = INSERTED[q]
            made = [("I", i, made)] if (i < n or last) and reach[i][q] + 5 == reach[i][made] else []
            took = [(letter, i + 1, to) for letter, cost, to in EDITS[self.path[i]][q] if reach[i][q] + cost == reach[i + 1][to]] if i < n else []
            yield from sorted(made + took)

        good: list[set[int]] = [set() for _ in range(n)] + [set(ends)]  # states on a cheapest way, by symbols passed
        for i in range(n, -1, -1):
            for _ in range(3):  # three messages in a row are never cheapest
                good[i] |= {q for q in range(4) if reach[i][q] < NEVER and any(to in good[j] for _, j, to in moves(i, q))}
        letters, q, i = [], entry, 0
        while i < n or q not in ends:
            letter, i, q = next(m for m in moves(i, q) if m[2] in good[m[1]])
            letters.append(letter)
        return least, "".join(letters), q


# ---------------------------------------------------------------- rows, places, signatures


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows as the test's rules damage them, by crc32(`conv_id:turn`) % 20: 0 drops a row (it
    has no copy), 1 empties its text, 2 removes `.!?`, 3 makes two adjacent copies, 4 makes it a user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(k == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


def undamaged(rows: DataFrame) -> DataFrame:
    """Rows as they are, in damage()'s columns."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows without texts, each with its place in the order of conversations and turns."""
    end = F.substring(F.rtrim("text", F.lit(BLANK_CHARACTERS)), -1, 1)
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    state = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    salted = rows.where("copies > 0").withColumn("salt", F.monotonically_increasing_id())
    light = salted.select("conv_id", "turn", "role", _digest(), role.alias("who"), state.alias("state"), "salt", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    order = ["conv_id", "turn", "role", "digest", "salt", "copy"]
    return light.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "digest", "who", "state", F.monotonically_increasing_id().alias("place"))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, block, signature): pieces of conversations; blocks rise along a conversation."""
    placed = materialize(_placed(rows), "places")
    # of equal messages the first by place is no duplicate; places are unique, so that joining on them has no hot key
    first = placed.where(F.col("state") != BLANK).groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("is_first"))
    fault = F.when((F.col("state") != BLANK) & F.col("is_first").isNull(), DUPLICATE).otherwise(F.col("state"))
    marked = placed.select("conv_id", "place", "who", "state").join(first, "place", "left").select("conv_id", "place", F.char(65 + 4 * F.col("who") + fault).alias("symbol"))
    pieces = marked.groupBy("conv_id", F.shiftright("place", SEGMENT.bit_length() - 1).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "symbol"))).alias("all"))
    out = materialize(pieces.select("conv_id", "block", F.array_join(F.transform("all", lambda x: x["symbol"]), "").alias("signature")), "signatures")
    discard(placed)
    return out


def _by_signature(pieces: DataFrame) -> DataFrame:
    """Pieces with equal beginnings together; those of one signature may lie in several tasks."""
    return pieces.repartitionByRange("signature", "conv_id", "block").sortWithinPartitions("signature")


ANSWERED = "conv_id {id}, block long, counts array<long>, ends string, cost long, letters array<string>, states array<int>"


def _answered(pieces: DataFrame, kind: str, entries: tuple[int, ...], whole: bool) -> DataFrame:
    """The counts, first and last symbols, cost from the start, letters and last state from each entry state of pieces; whole says
    that a piece is a conversation, else it has `to_go` and `last`."""
    names = ["conv_id", "block", "signature"] + ([] if whole else ["to_go", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, told_key, told_of = Trie(entries), None, None
        for b in batches:
            out = []
            found = [b.column(i).to_pylist() for i in range(2, len(names))]
            for row in zip(*found, strict=True):
                key = row if whole else (row[0], tuple(row[1]), row[2])
                if key != told_key:
                    trie.insert(row[0])
                    got = [trie.answer(p, FINAL if whole else row[1], whole or row[2]) for p in entries]
                    told_key, told_of = key, (list(trie.counts[-1]), row[0][0] + row[0][-1], got[0][0], [g[1] for g in got], [g[2] for g in got])
                out.append(told_of)
            counts, ends, cost, letters, states = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(counts, pa.list_(pa.int64())), pa.array(ends, pa.string()), pa.array(cost, pa.int64()), pa.array(letters, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))],
                names=["conv_id", "block", "counts", "ends", "cost", "letters", "states"],
            )

    return _by_signature(pieces.select(*names)).mapInArrow(releasing(run), ANSWERED.format(id=kind))


def _costs(pieces: DataFrame, kind: str) -> DataFrame:
    """(conv_id, block, costs): of each piece the least costs from every state to every state, and with inserted messages last."""

    def run(batches):
        trie, last, told_of = Trie((0, 1, 2, 3)), None, None
        for b in batches:
            out = []
            for signature in b.column(2).to_pylist():
                if signature != last:
                    trie.insert(signature)
                    last, told_of = signature, [v for layer in (trie.after, trie.open) for row in layer[-1] for v in row]
                out.append(told_of)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "block", "costs"])

    return _by_signature(pieces.select("conv_id", "block", "signature")).mapInArrow(releasing(run), f"conv_id {kind}, block long, costs array<bigint>")


def _to_go(costs: DataFrame, kind: str) -> DataFrame:
    """(conv_id, block, to_go, last): what the states at the end of each piece cost from there on. A conversation's tables, one for
    each SEGMENT rows, pass one task, from the last piece back."""

    def run(batches):
        behind, now = list(FINAL), object()
        for b in batches:
            out = []
            for conv, table in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                last = conv != now
                behind, now = (list(FINAL) if last else behind), conv
                out.append((behind, last))
                at = table[16 if last else 0 :]
                behind = [min(NEVER, min(at[4 * p + q] + behind[q] for q in range(4))) for p in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.bool_())], names=["conv_id", "block", "to_go", "last"])

    ordered = costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    return ordered.mapInArrow(releasing(run), f"conv_id {kind}, block long, to_go array<bigint>, last boolean")


def _solved(rows: DataFrame, kind: str) -> DataFrame:
    """The pieces of all conversations with their edits, in ANSWERED's columns."""
    pieces = signatures(rows)
    split = told(materialize(pieces.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("_c")), "split"), 100_000)
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    alone = _answered(pieces.join(split, same, "left_anti"), kind, (START,), True)
    parts = pieces.join(split, same, "left_semi")
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))
    ahead = _to_go(_costs(parts, kind), kind).withColumnsRenamed({"conv_id": "_c", "block": "_b"})
    return alone.unionByName(_answered(parts.join(ahead, on), kind, (0, 1, 2, 3), False))


# ---------------------------------------------------------------- texts to letters


class _Conversation:
    """One conversation as its pieces and then its rows pass: counts, letters, and the repaired messages."""

    def __init__(self, key):
        self.key, self.gaps, self.counts, self.cost, self.letters, self.state, self.end = key, 0, [0, 0, 0, 0], 0, [], START, ""
        self.audit, self.at, self.walk, self.hash, self.messages = "", 0, START, hashlib.sha256(), 0

    def piece(self, counts, ends, cost, letters, states) -> None:
        if self.end and ((ord(self.end) - 65) // 4, (ord(ends[0]) - 65) // 4) not in LEGAL_PAIRS:
            self.counts[3] += 1
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        self.cost = cost if not self.end else self.cost
        at = self.state if len(letters) > 1 else 0
        self.letters.append(letters[at])
        self.state, self.end = states[at], ends[1]

    def message(self, role: str, text: str) -> tuple[int, str, str]:
        self.hash.update((b"\n" if self.messages else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.messages += 1
        return self.messages, role, text

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.walk = self.at + 1, INSERTED[self.walk]
            yield self.message("user" if self.walk == USER else "assistant", "")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        """The messages that a row becomes, those inserted before it included."""
        if self.letters:
            self.audit, self.letters = "".join(self.letters), []
        yield from self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.walk = KEPT["sua".find(role[:1])][self.walk]
            yield self.message(role, text)
        elif letter == "R":
            self.walk = INSERTED[self.walk]
            yield self.message("user" if self.walk == USER else "assistant", text)

    def report(self) -> tuple:
        return (self.key, self.gaps, *self.counts, self.cost, self.audit, self.hash.hexdigest())


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = "place long, role string, text string"


def _walked(kind: str, arrow_id: pa.DataType, messages: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    report_types = [arrow_id, *[pa.int64()] * 6, pa.string(), pa.string()]
    names = ["conv_id"] + [x.split()[0] for x in (MESSAGES if messages else REPORT).split(", ")]
    types = [arrow_id, pa.int64(), pa.string(), pa.string()] if messages else report_types

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(types), types, strict=True)], names=names)

    def run(batches):
        now = None
        for b in batches:
            out: list[tuple] = []

            def end(c: _Conversation | None, out: list = out) -> None:
                if c is not None:
                    said = [(c.key, *m) for m in c.inserted()]
                    out.extend(said if messages else [c.report()])

            for conv, step, gaps, counts, ends, cost, letters, states, role, text in zip(*[b.column(i).to_pylist() for i in range(10)], strict=True):
                if now is None or conv != now.key:
                    end(now)
                    now = _Conversation(conv)
                if step == 0:
                    now.gaps = gaps
                elif step == 1:
                    now.piece(counts, ends, cost, letters, states)
                else:
                    said = [(now.key, *m) for m in now.row(role, text)]
                    out.extend(said if messages else [])
            yield batch(out)
        out = []
        if now is not None:
            said = [(now.key, *m) for m in now.inserted()]
            yield batch(said if messages else [now.report()])

    return releasing(run)


def _repair(rows: DataFrame, messages: bool) -> DataFrame:
    spark = rows.sparkSession
    small_batches(spark)
    field = rows.schema["conv_id"]
    kind = field.dataType.simpleString()
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    kept = F.when(F.col("copies") > 0, F.col("turn"))
    spread = F.coalesce(F.max(kept) - F.min(kept) + 1 - F.countDistinct(kept), F.lit(0)).alias("gaps")
    empty = [none("array<bigint>", "counts"), none("string", "ends"), none("bigint", "cost"), none("array<string>", "letters"), none("array<int>", "states")]
    said = [none("string", "role"), none("string", "text")]
    key = [none("bigint", "block"), none("bigint", "turn"), none("binary", "digest")]
    first = rows.groupBy("conv_id").agg(spread).select("conv_id", F.lit(0).alias("step"), "gaps", *empty, *said, *key)
    second = _solved(rows, kind).select("conv_id", F.lit(1).alias("step"), none("bigint", "gaps"), "counts", "ends", "cost", "letters", "states", *said, "block", *key[1:])
    third = rows.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select("conv_id", F.lit(2).alias("step"), none("bigint", "gaps"), *empty, "role", "text", key[0], "turn", _digest())
    together = first.unionByName(second).unionByName(third).repartition("conv_id").sortWithinPartitions("conv_id", "step", "block", "turn", "role", "digest")
    return together.drop("block", "turn", "digest").mapInArrow(_walked(kind, pa.int64() if kind == "bigint" else pa.string(), messages), f"conv_id {kind}, {MESSAGES if messages else REPORT}")


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired messages of conversations in undamaged()'s or damage()'s columns, places from 1."""
    return _repair(rows, True)


def repair_report(rows: DataFrame) -> DataFrame:
    """For each conversation what is wrong with it, the cost and letters of its cheapest repair, and the repaired text's digest."""
    return _repair(rows, False)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the contract's rules, and repaired."""
    return repair_report(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
