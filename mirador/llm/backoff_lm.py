"""Language-model scoring by a weighted backoff automaton whose arcs lie in tables.

Counts of words and of longer n-grams are exact, cover every training token and stay distributed; n-grams are kept from
the same count at every size of the training text. Tables hold the automaton: for each kept n-gram, which is an arc out of
its context, its count and that of all its context's arcs; and for each n-gram that is a context, and so a state, the weight
of the arc taken on failure. Texts are scored in chunks of up to CHUNK tokens: a chunk asks the tables, by hash and bucket, for
the arcs that its texts can reach, builds the small automaton of these, and walks each text over it once, left to right, carrying
the state and adding up log-probabilities and failure arcs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirador.llm.common import PLACE, U64, discard, discard_since, doc_chunks, hash_words, hashes, materialize, mix, n_buckets, release, releasing, small_batches, text_buffer, written

END = U64(0x5DEECE66D1234567)
#: Tokens walked in one lane; each lane starts with the order - 1 tokens before it, which fix its state.
LANE = 192
#: Words are hashed in stretches of so many bytes, which with all their arrays stay in a core's cache.
NEAR = 1 << 16
#: Texts are scored in chunks of so many tokens, and what the last batch has beyond.
CHUNK = 1 << 20
#: In shuffled n-grams the most frequent words, so many, are written as two bytes, all others as their hash.
CODED = 1 << 16
#: Kept n-grams are marked in a table of 2 ** MARK_BITS bits by hash, and what it does not mark is neither counted as part of
#: a longer one nor asked for. The table's size is fixed; the fuller it is the less it saves, and it changes no result.
MARK_BITS = 26


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in turn, an end token closing each, and the number of tokens of each text."""
    data, offsets = text_buffer(texts)
    parts, counts = [], []
    for i, j in doc_chunks(offsets, NEAR):
        h, doc = hash_words(data, offsets, i, j, "space")
        n = np.bincount(doc, minlength=j - i)
        tokens = np.full(len(h) + len(n), END)
        tokens[np.arange(len(h)) + doc] = h
        parts.append(tokens)
        counts.append(n + 1)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), (np.concatenate(counts) if counts else np.zeros(0, np.int64))


def _by_bucket(keys: np.ndarray, buckets: int):
    b = keys.view(np.int64) % buckets
    order = np.argsort(b.astype(np.uint16) if buckets <= 1 << 16 else b, kind="stable")  # two bytes are sorted by radix
    cut = np.flatnonzero(np.diff(b[order])) + 1
    return order, cut, b[order][np.concatenate(([0], cut))] if len(b) else b


def _blobs(a: np.ndarray, cut: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.split(a, cut)], pa.binary())


def _count_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, times = np.unique(_tokens(batch["text"])[0], return_counts=True)
            if len(words):
                order, cut, b = _by_bucket(words, buckets)
                yield pa.RecordBatch.from_arrays([pa.array(b), _blobs(words[order], cut), _blobs(times[order].astype(np.int32), cut)], ["bucket", "keys", "times"])

    return releasing(run)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the order of all keys, and where in it each distinct one begins. Equal keys come in any
    order, as a stable sort takes several times as long."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    return keys[first], order, first


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, their total times, and where in keys each stands."""
    keys, order, first = _distinct(keys)
    return keys, np.add.reduceat(times[order].astype(np.int64), first), order[first]


def _sum_words(pdf: pd.DataFrame) -> pd.DataFrame:
    words, total, _ = _summed(*(np.frombuffer(b"".join(pdf[c]), t) for c, t in (("keys", U64), ("times", np.int32))))
    return pd.DataFrame({"k": words.view(np.int64), "c": total})


def _key(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams, given the hashes of their words place by place; a word is its own."""
    return words[0] if len(words) == 1 else mix(sum(w * PLACE[k] for k, w in enumerate(words)) + U64(len(words)))


def _places(counts: np.ndarray, order: int) -> np.ndarray:
    """Where the n-grams begin that lie within one text."""
    doc = np.repeat(np.arange(len(counts)), counts)
    n = max(len(doc) - order + 1, 0)
    return np.flatnonzero(doc[:n] == doc[order - 1 :]) if n else np.zeros(0, np.int64)


def _marks(table: DataFrame) -> np.ndarray:
    """The bits of all k of table. Gathered natively, in 2 ** (MARK_BITS - 15) rows of 4 KB at most."""
    at = F.col("k").bitwiseAND((1 << MARK_BITS) - 1) + 1
    rows = table.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
    out = np.zeros((1 << MARK_BITS) >> 3, np.uint8)
    for r in rows:
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    at = (keys & U64(8 * len(marks) - 1)).view(np.int64)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) != 0


def _count_grams(order: int, buckets: int, coded: np.ndarray, marks):
    """Distinct n-grams of each batch, packed by bucket: flags (bit k: word k is coded), the codes and the hashes of all
    words k in turn, and how often each n-gram comes. coded: sorted hashes of the coded words. marks: a broadcast of the bits
    of the kept n-grams shorter by one; an n-gram is kept only if both of these in it are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_of = Places(coded)
        for batch in batches:
            tokens, counts = _tokens(batch["text"])
            at = _places(counts, order)
            n = max(len(tokens) - order + 2, 0)
            shorter = _marked(_key([tokens[k : k + n] for k in range(order - 1)]), marks.value)
            at = at[shorter[at] & shorter[at + 1]]
            if not len(at):
                continue
            keys, by, first = _distinct(_key([tokens[at + k] for k in range(order)]))
            at, times = at[by[first]], np.diff(first, append=len(by))
            by, cut, b = _by_bucket(keys, buckets)
            at, times, ids = at[by], times[by].astype(np.int32), codes_of.find(tokens)
            out = []
            for x, t in zip(np.split(at, cut), np.split(times, cut), strict=True):
                known = [ids[x + k] >= 0 for k in range(order)]
                flags = sum(m.astype(np.uint8) << np.uint8(k) for k, m in enumerate(known))
                codes = np.concatenate([ids[x + k][m] for k, m in enumerate(known)]).astype(np.uint16)
                rest = np.concatenate([tokens[x + k][~m] for k, m in enumerate(known)])
                out.append([y.tobytes() for y in (flags, codes, rest, t)])
            yield pa.RecordBatch.from_arrays([pa.array(b), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], ["bucket", "flags", "codes", "rest", "times"])

    return releasing(run)


def _sum_grams(order: int, least: int, coded: np.ndarray):
    """The n-grams of a bucket that come `least` times: k, ctx (all but the last word), suf (all but the first), c."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for flags, codes, rest in zip(pdf["flags"], pdf["codes"], pdf["rest"], strict=True):
            flags, codes, rest = np.frombuffer(flags, np.uint8), np.frombuffer(codes, np.uint16), np.frombuffer(rest, U64)
            words = np.empty((order, len(flags)), U64)
            for k in range(order):
                m = (flags >> np.uint8(k) & np.uint8(1)).astype(bool)
                n = int(m.sum())
                words[k, m], words[k, ~m] = coded[codes[:n]], rest[: len(m) - n]
                codes, rest = codes[n:], rest[len(m) - n :]
            parts.append(words)
        words = list(np.concatenate(parts, axis=1))
        keys, total, at = _summed(_key(words), np.frombuffer(b"".join(pdf["times"]), np.int32))
        keep = total >= least
        words = [w[at[keep]] for w in words]
        return pd.DataFrame({"k": keys[keep].view(np.int64), "ctx": _key(words[:-1]).view(np.int64), "suf": _key(words[1:]).view(np.int64), "c": total[keep]})

    return run


def _ids(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each word in the sorted array known, or -1."""
    if not len(known):
        return np.full(len(words), -1, np.int64)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1)


class Places:
    """Finds hashes among some sorted distinct ones, by a table of where each beginning of so many bits starts."""

    def __init__(self, known: np.ndarray):
        bits = max(len(known).bit_length(), 1)
        self.shift, self.n = U64(64 - bits), len(known)
        self.known = np.append(known, U64(0xFFFFFFFFFFFFFFFF))
        upto = np.cumsum(np.bincount((known >> self.shift).view(np.int64), minlength=1 << bits))
        self.first = np.zeros(1 << bits, np.int32)
        self.first[1:] = upto[:-1]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        at = self.first[(keys >> self.shift).view(np.int64)].astype(np.int64)
        late = np.flatnonzero(self.known[at] < keys)
        while len(late):  # the last of known stops each
            at[late] += 1
            late = late[self.known[at[late]] < keys[late]]
        return np.where((self.known[at] == keys) & (at < self.n), at, -1)


@dataclass
class Automaton:
    """words: sorted hashes of the known words. State 0 is the empty context. arcs: state * |words| + word, each once."""

    words: np.ndarray
    arcs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    target: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    fail: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    fail_weight: np.ndarray = field(default_factory=lambda: np.zeros(1))
    order: int = 1

    def walk(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Summed log10 weights of each text; a word that is not known (-1) adds only the failure arcs before it."""
        if not len(ids):
            return np.zeros(len(counts))
        ends = np.cumsum(counts)
        begins = ends - counts
        lanes = -(-counts // LANE)
        doc = np.repeat(np.arange(len(counts)), lanes)
        step = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start, stop = begins[doc] + step * LANE, np.minimum(begins[doc] + (step + 1) * LANE, ends[doc])
        total, state = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
        v, warm = len(self.words), self.order - 1
        hashed = mix(self.arcs.view(U64))  # one to one
        by = np.argsort(hashed)
        arcs, weight, target = Places(hashed[by]), self.weight[by], self.target[by]
        del hashed, by
        first = begins[doc]
        for t in range(-warm, LANE):
            at = start + t
            live = np.flatnonzero((at >= first) & (at < stop))
            w, s, gained = ids[at[live]], state[live], np.zeros(len(live))
            todo = np.arange(len(live))
            while len(todo):
                here, word = s[todo], w[todo]
                hit = np.where(word >= 0, arcs.find(mix((here * v + word).view(U64))), -1)
                found = hit >= 0
                done, hit = todo[found], hit[found]
                gained[done] += weight[hit]
                s[done] = target[hit]
                todo = todo[~found]
                root = s[todo] == 0
                todo = todo[~root]  # at the root an unknown word stays there
                gained[todo] += self.fail_weight[s[todo]]
                s[todo] = self.fail[s[todo]]
            state[live] = s
            if t >= 0:
                total[live] += gained
        return np.bincount(doc, weights=total, minlength=len(counts))


def build(words: np.ndarray, counts: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], n_tokens: int, n_types: int, discount: float = 0.5) -> Automaton:
    """grams: for each order from 2 the word ids (rows) and counts of the kept n-grams.

    P(w) = (c + 1) / (N + V + 1), the same for words that are not known here, whose counts come from elsewhere. A longer
    context u has P(w | u) = (c(uw) - discount) / c(u) for kept uw, and gives what is left to the next shorter context.
    """
    v = max(len(words), 1)
    p1 = (counts + 1) / (n_tokens + n_types + 1)
    states: dict[tuple[int, ...], int] = {(): 0}
    for rows, _ in grams:
        for row in rows:
            states.setdefault(tuple(row[:-1].tolist()), len(states))
    fail, bow = np.zeros(len(states), np.int64), np.zeros(len(states))
    prob: dict[tuple[int, ...], float] = {}

    def longest(words_: tuple[int, ...]) -> int:
        while words_ not in states:
            words_ = words_[1:]
        return states[words_]

    def backed(words_: tuple[int, ...]) -> float:
        """P(last word | the words before it) by the orders built so far."""
        if len(words_) == 1:
            return float(p1[words_[0]])
        if words_ in prob:
            return prob[words_]
        s = states.get(words_[:-1])
        return (10.0 ** bow[s] if s is not None else 1.0) * backed(words_[1:])

    count_of: dict[tuple[int, ...], int] = {}
    out: list[tuple[int, float, int]] = [(w, float(np.log10(p1[w])), longest((w,))) for w in range(len(words))]
    for n, (rows, times) in enumerate(grams, 2):
        here: dict[tuple[int, ...], list[tuple[tuple[int, ...], int]]] = {}
        for row, c in zip(rows.tolist(), times.tolist(), strict=True):
            here.setdefault(tuple(row[:-1]), []).append((tuple(row), c))
        fresh = {}
        for context, kept in here.items():
            c_u = int(counts[context[0]]) if n == 2 else count_of[context]
            c_u = max(c_u, sum(c for _, c in kept))
            mass = sum(c - discount for _, c in kept) / c_u
            lower = sum(backed(g[1:]) for g, _ in kept)
            s = states[context]
            fail[s] = longest(context[1:])
            bow[s] = np.log10(max(1.0 - mass, 1e-12) / max(1.0 - lower, 1e-12))
            for g, c in kept:
                p = (c - discount) / c_u
                fresh[g] = p
                out.append((s * v + g[-1], float(np.log10(p)), longest(g if len(g) <= len(grams) else g[1:])))
        prob |= fresh
        count_of = {tuple(r): c for r, c in zip(rows.tolist(), times.tolist(), strict=True)}
    out.sort()
    return Automaton(words, np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out]), np.array([x[2] for x in out], np.int64), fail, bow, 1 + len(grams))


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a).tobytes())


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _wanted(tokens: np.ndarray, counts: np.ndarray, order: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a chunk that may be kept: their hashes, and where each stands."""
    at = _places(counts, order)
    n = max(len(tokens) - order + 1, 0)
    keys = _key([tokens[k : k + n] for k in range(order)])[at]
    worth = _marked(keys, marks)
    return keys[worth], at[worth]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens, their numbers by text, and the texts' hashes, of texts of `most` tokens and more together."""
    held, size = [], 0
    for batch in batches:
        tokens, n = _tokens(batch["text"])
        if len(n):
            held.append((tokens, n, batch["th"].to_numpy()))
            size += len(tokens)
        if size >= most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _name(th: np.ndarray) -> str:
    """A name for a chunk by its texts' hashes in turn. Chunks of the same texts may share it, as their scores are the same."""
    at = np.arange(1, len(th) + 1, dtype=U64)
    return "-".join(f"{int(mix(mix(th.view(U64) + at) * at + U64(k)).sum(dtype=U64)):016x}" for k in (0, 1))


def _ask(order: int, buckets: int, marks, chunk: int):
    """For each chunk the distinct n-grams of an order that it asks for, by bucket. marks: a broadcast of the bits of those that are
    kept, from order 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, n, th in _chunks(batches, chunk):
            keys = np.unique(tokens if order == 1 else _wanted(tokens, n, order, marks.value)[0])
            if len(keys):
                by, cut, b = _by_bucket(keys, buckets)
                yield pa.RecordBatch.from_arrays([pa.array([_name(th)] * len(b)), pa.array(b), _blobs(keys[by], cut)], ["chunk", "bucket", "keys"])

    return releasing(run)


OWN = "th binary, n binary, words binary, ids binary"
ANSWERED = "chunk string, bucket long, order int, hits binary, c binary, total binary, states binary, bow binary"


def _records(chunk: int):
    """A record of each chunk: its texts' hashes and token counts, its words and its tokens as places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tokens, n, th in _chunks(batches, chunk):
            words = np.unique(tokens)
            ids = Places(words).find(tokens)
            own = [pa.array([x], pa.binary()) for x in (th.tobytes(), _packed(n.astype(np.int64)), words.tobytes(), _packed(ids.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([pa.array([_name(th)]), *own], ["chunk", "th", "n", "words", "ids"])

    return releasing(run)


def _answer(order: int):
    """Per bucket: for what each chunk asked, in its order, which is there, with its counts, and which of that is a state, with the
    weight of its failure arc."""

    def run(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("k")
        k, c, total, bow = (table[x].to_numpy(t) for x, t in (("k", np.int64), ("c", np.int64), ("total", np.int64), ("bow", np.float64)))
        out = []
        for name, bucket, keys in zip(asked["chunk"], asked["bucket"], asked["keys"], strict=True):
            at = _ids(np.frombuffer(keys, np.int64), k)
            hit = at >= 0
            at = at[hit]
            state = ~np.isnan(bow[at])
            out.append((name, bucket, order, _packed(np.packbits(hit)), _packed(c[at]), _packed(total[at]), _packed(np.packbits(state)), _packed(bow[at][state])))
        release()
        return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERED.split(", ")])

    return run


def _told(answers: pd.DataFrame, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the answers to one chunk and order say of its sorted keys: count (0: not kept), total, whether a state, failure weight."""
    count, total, state, bow = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys))
    if not len(keys):
        return count, total, state, bow
    by, cut, b = _by_bucket(keys, buckets)
    of = dict(zip(b.tolist(), np.split(by, cut), strict=True))
    for bucket, hits, c, t, states, w in zip(*(answers[x] for x in ("bucket", "hits", "c", "total", "states", "bow")), strict=True):
        at = of[bucket]
        at = at[np.unpackbits(_unpacked(hits, np.uint8), count=len(at)).astype(bool)]
        count[at], total[at] = _unpacked(c, np.int64), _unpacked(t, np.int64)
        at = at[np.unpackbits(_unpacked(states, np.uint8), count=len(at)).astype(bool)]
        state[at], bow[at] = True, _unpacked(w, np.float64)
    return count, total, state, bow


def assemble(words: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Automaton:
    """The automaton of some n-grams: for each order, from 1, the words of its kept n-grams (rows of places in words), their
    log-probabilities, which of them are states, and the failure weights of these (0 for others)."""
    order, v = len(grams), max(len(words), 1)
    hashed = lambda rows: _key([words[rows[:, k]] for k in range(rows.shape[1])])
    states: list[tuple[Places, np.ndarray]] = []  # by length from 1: places of the contexts' hashes, and the states' numbers
    rows_of, size = [], 1
    for rows, _, state, bow in grams[:-1]:
        keys = hashed(rows[state]) if state.any() else np.zeros(0, U64)
        by = np.argsort(keys)
        states.append((Places(keys[by]), size + np.arange(len(keys))))
        rows_of.append((rows[state][by], bow[state][by]))
        size += len(keys)

    def longest(rows: np.ndarray) -> np.ndarray:
        """The state of the longest end of each row that is one."""
        out = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        for n in range(rows.shape[1], 0, -1):
            if n > len(states) or not len(states[n - 1][1]) or not len(todo):
                continue
            at = states[n - 1][0].find(hashed(rows[todo][:, rows.shape[1] - n :]))
            out[todo[at >= 0]] = states[n - 1][1][at[at >= 0]]
            todo = todo[at < 0]
        return out

    fail, weight = np.zeros(size, np.int64), np.zeros(size)
    for (_, numbers), (rows, bow) in zip(states, rows_of, strict=True):
        if len(numbers):
            fail[numbers], weight[numbers] = longest(rows[:, 1:]), bow
    arcs, values, targets = [], [], []
    for n, (rows, lp, _, _) in enumerate(grams, 1):
        if not len(rows):
            continue
        begin = np.zeros(len(rows), np.int64)
        if n > 1:
            at = states[n - 2][0].find(hashed(rows[:, :-1]))
            rows, lp, begin = rows[at >= 0], lp[at >= 0], states[n - 2][1][at[at >= 0]]
        arcs.append(begin * v + rows[:, -1])
        values.append(lp)
        targets.append(longest(rows if n < order else rows[:, 1:]))
    return Automaton(words, *(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((arcs, np.int64), (values, np.float64), (targets, np.int64))), fail, weight, order)


def _score(order: int, buckets: int, denominator: float, discount: float, marks: list):
    """Per chunk: its automaton from the answers, and one walk of each of its texts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["order"] == 0].iloc[0]
        th, n = np.frombuffer(own["th"], np.int64), _unpacked(own["n"], np.int64)
        words, ids = np.frombuffer(own["words"], U64), _unpacked(own["ids"], np.int32).astype(np.int64)
        grams, times, tokens = [], None, words[ids]
        for m in range(1, order + 1):
            keys, first = words, None
            if m > 1:
                keys, places = _wanted(tokens, n, m, marks[m - 2].value)
                keys, by, first = _distinct(keys)
                first = places[by[first]]
                del places, by
            count, total, state, bow = _told(pdf[pdf["order"] == m], keys, buckets)
            kept = count > 0
            if m == 1:
                times, rows, lp = count, np.flatnonzero(kept)[:, None], np.log10((count[kept] + 1) / denominator)
            else:
                rows = np.stack([ids[first[kept] + k] for k in range(m)], axis=1)
                lp = np.log10((count[kept] - discount) / total[kept])
            grams.append((rows, lp, state[kept], bow[kept]))
        del keys, first, count, total, state, bow, kept, rows, lp, tokens
        doc = np.repeat(np.arange(len(n)), n)
        base = np.log10((times + 1) / denominator)[ids]
        known = times[ids] > 0
        machine = assemble(words, grams)
        del grams
        walked = machine.walk(np.where(known, ids, -1), n) + np.bincount(doc, weights=np.where(known, 0.0, base), minlength=len(n))
        del machine
        release()
        return pd.DataFrame({"th": th, "n": n, "known": np.bincount(doc, weights=known, minlength=len(n)).astype(np.int64), "base": np.bincount(doc, weights=base, minlength=len(n)), "score": walked})

    return run


def _model(train: DataFrame, words: DataFrame, order: int, least: int, denominator: float, buckets: int, discount: float = 0.5) -> tuple[list[DataFrame], list]:
    """For each order the table (k, c, total, bow) of its n-grams: hash, count, the count of the context's arcs, and the failure
    arc's weight where the n-gram is a state; and broadcasts of the bits of kept n-grams, from order 2."""
    top = words.orderBy(F.desc("c"), "k").limit(CODED).toPandas()["k"].to_numpy(np.int64)
    coded = np.sort(top.view(U64))
    spark = train.sparkSession
    known = words.select("k", "c", F.lit(0).cast("long").alias("total"))
    level, tables, bits = words.where(F.col("c") >= least).select("k", "c", F.log10((F.col("c") + 1) / F.lit(denominator)).alias("lp")), [], []
    for n in range(2, order + 1):
        marks = spark.sparkContext.broadcast(_marks(level))
        blobs = train.mapInArrow(_count_grams(n, buckets, coded, marks), "bucket long, flags binary, codes binary, rest binary, times binary")
        kept = materialize(blobs.groupBy("bucket").applyInPandas(_sum_grams(n, least, coded), "k long, ctx long, suf long, c long"), "grams")
        shorter = level.select(F.col("k").alias("suf"), F.col("lp").alias("lower"))
        context = level.select(F.col("k").alias("ctx"), F.col("c").alias("of"))
        found = materialize(kept.join(shorter, "suf").join(context, "ctx").select("k", "ctx", "c", "lower", "of"), "linked")
        taken = found.groupBy("ctx").agg(F.sum(F.col("c") - discount).alias("mass"), F.sum(F.pow(F.lit(10.0), "lower")).alias("low"), F.greatest(F.max("of"), F.sum("c")).alias("total"))
        left = F.greatest(1 - F.col("mass") / F.col("total"), F.lit(1e-12)) / F.greatest(1 - F.col("low"), F.lit(1e-12))
        back = materialize(taken.select("ctx", "total", F.log10(left).alias("bow")), "backoff")
        tables.append(materialize(known.join(back.select(F.col("ctx").alias("k"), "bow"), "k", "left").select("k", "c", "total", "bow"), "arcs"))
        level = materialize(found.join(back, "ctx").select("k", "c", "total", F.log10((F.col("c") - discount) / F.col("total")).alias("lp")), "level")
        known = level.select("k", "c", "total")
        bits.append(spark.sparkContext.broadcast(_marks(level)))
        blobs = None
        discard(kept, found, back)
    return [*tables, known.withColumn("bow", F.lit(None).cast("double"))], bits


def score_documents(docs: DataFrame, train: DataFrame, order: int = 3, least_count: int = 3, discount: float = 0.5) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    train (text) is what is learned from. Tokens are runs without ASCII white space, A-Z lower-cased, and one end token a
    text. base_score adds log10((c + 1) / (N + V + 1)) over the tokens; score is the automaton's log10 probability, with
    n-grams kept from least_count occurrences, whatever N. Null and empty texts have the end token alone.
    docs are read once an order and twice more, and must come in the same order and partitions each time, as a scan of files
    does. Repeated rows are scored each; an empty training table leaves all counts at 0; an empty docs gives an empty result.
    Words, n-grams and texts are compared by 64-bit hashes.
    """
    if not 1 <= order <= len(PLACE):
        raise ValueError(f"order must be from 1 to {len(PLACE)}")
    small_batches(docs.sparkSession)
    begun = written()
    buckets = max(n_buckets(docs), n_buckets(train))
    docs, train = docs.select("doc_id", hashes().alias("th"), "text"), train.select("text")
    blobs = train.mapInArrow(_count_words(buckets), "bucket long, keys binary, times binary")
    words = materialize(blobs.groupBy("bucket").applyInPandas(_sum_words, "k long, c long"), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_tokens, n_types = int(total[0]), int(total[1])
    denominator = float(n_tokens + n_types + 1)
    tables, bits = _model(train, words, order, least_count, denominator, buckets, discount)
    texts, answers = docs.select("th", "text"), None
    for n, table in enumerate(tables, 1):
        asked = texts.mapInArrow(_ask(n, buckets, bits[n - 2] if n > 1 else None, CHUNK), "chunk string, bucket long, keys binary")
        dealt = table.withColumn("bucket", F.pmod("k", F.lit(buckets).cast("long")))
        part = asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInPandas(_answer(n), ANSWERED)
        part = materialize(part, "answers")
        asked = dealt = None  # else their shuffled files stay
        discard(table)
        answers = part if answers is None else answers.unionByName(part)
    blank = lambda names: [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in names.split(", ")]
    rest = ", ".join(ANSWERED.split(", ")[3:])
    own = texts.mapInArrow(_records(CHUNK), f"chunk string, {OWN}").select("chunk", F.lit(0).cast("long").alias("bucket"), F.lit(0).alias("order"), *blank(rest), *[x.split()[0] for x in OWN.split(", ")])
    both = answers.select("*", *blank(OWN)).unionByName(own)
    found = both.groupBy("chunk").applyInPandas(_score(order, buckets, denominator, discount, bits), "th long, n long, known long, base double, score double")
    sums = materialize(found.dropDuplicates(["th"]), "scores")
    own = both = found = None
    discard_since(docs.sparkSession, begun, sums)
    return docs.select("doc_id", "th").join(sums, "th").select("doc_id", F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all documents by a model of those whose crc32(doc_id) mod 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    scored = score_documents(docs, docs.where(~fold))
    return scored.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
