"""N-gram Jaccard join by prefix trees.

Every document is the set of its word shingles, in the order of their 63-bit hashes, which is the same for all documents.
Documents with equal sets form one class. Candidate classes come from an exact prefix filter over ranges of that order,
which is cut into windows of some fifty shingles: two sets above the threshold differ in at most D shingles, so in one of W
windows at least in no more than D / W. Of the first D / W + 1 ranges of that window that are not empty at least one then
holds the very same shingles in both, and marks of the window, 64 bits of parities, differ in no more than D / W bits. A
passage that unlike documents share fills a range at times, but leaves the marks of its window far apart, so groups of
candidates are little more than groups of near copies, however many documents there are. The most frequent shingles are
left out of the ranges wherever enough others remain. Each connected group of candidates is then met with its full sets in
one place and joined exactly over a trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirador.llm.common import PLACE, U64, discard_since, hashes, local_labels, materialize, mix, n_buckets, release, releasing, shingle_sets, small_batches, told, written
from mirador.llm.components import connected_components

#: Cost only: up to so many of the shingles that come in HEAVY_FROM sets and more are left out of ranges where others suffice;
#: they are marked in a table of 2 ** HEAVY_BITS bits by hash. Any choice of them gives the same result.
HEAVY, HEAVY_FROM, HEAVY_BITS = 1 << 21, 16, 25
#: Sets of fewer shingles than SMALL have a range for each; others up to about RANGE in one, by classes of size that grow by half.
SMALL, RANGE = 32, 2
#: Shingles in a window of the hash order, at most and on average: about as many as a mark of 64 bits can tell apart.
WINDOW = 72
#: Sets with one signature are met all with all up to so many, beyond by the middle one first.
MET_ALL = 64
#: What is sent of each signature: a part of its hash (in a bucket that is enough, as a wrong match only has marks compared), the
#: mark, the set's key, and its size times four with the number of its cut (see cuts_of).
_POSTED = {"tokens": np.uint32, "marks": U64, "keys": np.int64, "sizes": np.uint32}
#: Shingles in one block of the trie join (8 MB of them); candidate groups with more are joined block against block.
BLOCK_SHINGLES = 1 << 20
#: Texts that a task remembers, so as not to give their postings again.
SEEN = 200_000
#: Candidate classes are broadcast to the scan of the texts up to this many (about 40 bytes each), beyond joined by shuffle.
BROADCAST_CLASSES = 1_000_000


def least_overlap(x, y, percent: int):
    """The smallest intersection of sets of sizes x and y whose Jaccard similarity reaches percent / 100."""
    return -(-percent * (x + y) // (100 + percent))


class _Node:
    __slots__ = ("seg", "kids", "low", "high", "leaf", "same")

    def __init__(self, seg, leaf, size, kids=None):
        self.seg, self.kids, self.leaf, self.same = seg, kids if kids is not None else {}, leaf, True
        self.low = self.high = size


class TrieJoin:
    """Path-compressed trie over ordered sets. link(set) joins a set with all earlier ones that are similar enough.

    A walk carries the overlap counted so far down shared paths. A subtree is left when even all that remains of either
    side cannot lift the overlap to the least one, when its sizes cannot match, or when all its sets are already in the
    component of the one asked for.
    """

    def __init__(self, percent: int):
        self.percent, self.parent, self.roots = percent, [], {}

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def link(self, items: np.ndarray) -> int:
        me = len(self.parent)
        self.parent.append(me)
        if not len(items):
            return me
        self._join(items, me)
        self._insert(items, me)
        return me

    def _join(self, y: np.ndarray, me: int) -> None:
        n, pc, find = len(y), self.percent, self.find
        stack = [(k, 0, 0) for k in self.roots.values()]
        while stack:
            node, depth, shared = stack.pop()
            if 100 * node.high < pc * n or 100 * n < pc * node.low or node.same and find(node.leaf) == find(me):
                continue
            at = int(np.searchsorted(y, node.seg[0]))
            least = -(-pc * (n + node.low) // (100 + pc))
            if shared + min(n - at, node.high - depth) < least:
                continue
            seg = node.seg
            where = np.searchsorted(y, seg)
            shared += int((y[np.minimum(where, n - 1)] == seg).sum())
            depth += len(seg)
            if not node.kids:
                if shared >= least:
                    self.parent[find(me)] = find(node.leaf)
                continue
            after = int(np.searchsorted(y, seg[-1], "right"))
            if shared + min(n - after, node.high - depth) >= least:
                stack.extend((k, depth, shared) for k in node.kids.values())

    def _insert(self, y: np.ndarray, me: int) -> None:
        n, kids, at = len(y), self.roots, 0
        y = np.append(y, -1)  # an end mark, so that no set is a prefix of another
        while True:
            node = kids.get(int(y[at]))
            if node is None:
                kids[int(y[at])] = _Node(y[at:], me, n)
                return
            seg = node.seg
            m = min(len(seg), len(y) - at)
            differ = np.flatnonzero(seg[:m] != y[at : at + m])
            k = int(differ[0]) if len(differ) else m
            if k == len(seg) and not node.kids:  # the same set again
                self.parent[self.find(me)] = self.find(node.leaf)
                return
            if k < len(seg):
                lower = _Node(seg[k:], node.leaf, 0, node.kids)
                lower.low, lower.high, lower.same = node.low, node.high, node.same
                node.seg, node.kids = seg[:k], {int(seg[k]): lower}
            node.low, node.high = min(node.low, n), max(node.high, n)
            node.same = node.same and self.find(node.leaf) == self.find(me)
            kids, at = node.kids, at + k


def trie_components(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set (in order) the index of its component's root among sets; only pairs that reach percent are joined."""
    trie, of = TrieJoin(percent), np.zeros(len(sets), np.int64)
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        of[i] = trie.link(sets[i].astype(np.int64))
    back = np.empty(len(sets), np.int64)
    back[of] = np.arange(len(sets))
    return np.array([back[trie.find(int(k))] for k in of], np.int64)


def _key(items: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(items.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, low, held, kind = set(), [], 0, pa.int64()
        names = ["doc_id", "th", "n", "k", "token", "times"]

        def heavy() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(low), return_counts=True) if low else (np.zeros(0, U64), np.zeros(0, np.int64))
            keep = times >= 2
            none = lambda t: pa.nulls(int(keep.sum()), t)
            return pa.RecordBatch.from_arrays([none(kind), none(pa.int64()), none(pa.int64()), none(pa.int64()), pa.array(tokens[keep].astype(np.int64)), pa.array(times[keep].astype(np.int64))], names)

        for batch in batches:
            n, keys, kind = [], [], batch["doc_id"].type
            for items in shingle_sets(batch["text"], size):
                n.append(len(items))
                keys.append(_key(items) if len(items) else None)
                if len(items) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    low.append(items)
                    held += len(items)
            none = lambda t: pa.nulls(len(n), t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(n, pa.int64()), pa.array(keys, pa.int64()), none(pa.int64()), none(pa.int64())], names)
            if held > 8_000_000:  # 64 MB
                yield heavy()
                seen, low, held = set(), [], 0
        yield heavy()

    return releasing(run)


def _size_classes() -> np.ndarray:
    """Where classes of size begin: class 0 below the first, class c from the one numbered c - 1 on."""
    out = [SMALL]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 3 // 2)
    return np.array(out, np.int64)


_BEGIN = _size_classes()


def _windows(size_class: int) -> int:
    return max(1, int(_BEGIN[size_class]) // WINDOW) if size_class else 1


def _windowed(items: np.ndarray, mixed: np.ndarray, light: np.ndarray, size_class: int, windows: int, most: int, tag: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Hashes of what the first `most` ranges of each window hold that are not empty; the marks of their windows; and whether
    a window has too few shingles for that. Kind 0 takes light shingles, kind 1, where these fill too few ranges, all, and
    kind 2, where that is too few still, each as a range of its own."""
    per = int(_BEGIN[size_class]) // (RANGE * windows) + 1
    each = np.minimum((items.astype(np.float64) * (per * windows / 2.0**63)).astype(np.int64), per * windows - 1)
    at_window = each // per
    begins = np.flatnonzero(np.concatenate((np.ones(1, bool), at_window[1:] != at_window[:-1])))
    marks = np.zeros(windows, U64)
    marks[at_window[begins]] = np.bitwise_xor.reduceat(U64(1) << (mixed & U64(63)), begins)
    open_, tokens, of = np.ones(windows, bool), [], []
    for kind in range(3):
        here = open_[at_window] & (light if not kind else True)
        sums, at, window = mixed[here], each[here], at_window[here]
        if size_class and kind < 2 and len(at):
            first = np.flatnonzero(np.concatenate((np.ones(1, bool), at[1:] != at[:-1])))
            sums, at, window = np.add.reduceat(sums, first), at[first], window[first]
        else:
            at = np.ones(len(at), np.int64)
        keep = np.arange(len(window)) - np.searchsorted(window, window) < most
        tokens.append(mix(sums[keep] * PLACE[0] + at[keep].astype(U64) * PLACE[1] + U64((4 * tag + kind) * int(PLACE[2]) % (1 << 64))))
        of.append(marks[window[keep]])
        open_ &= np.bincount(window, minlength=windows) < most
        if not open_.any():
            break
    return np.concatenate(tokens), np.concatenate(of), bool(open_.any())


def marked(items: np.ndarray, percent: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set (items, in order; heavy: bits by hash), the mark of each one's window, and the set's size times four
    with a number that tells into how many windows it was cut (see cuts_of). Two sets that reach percent share one at least whose marks are near (see near_marks).

    A partner's size is percent / 100 to 100 / percent of this one's, so it lies in the class of this size or in one next to
    it: a set takes part in its own class, and in the next if a partner can lie there. Sets of a class are cut into the same
    windows of the hash order. Partners that differ in D shingles differ in d = D / windows at most in one window at least.
    Of the first d + 1 ranges there that are not empty in both, one is the same in both; if either set has so many, both give
    it. Only if neither has d + 1 shingles there is none; such sets also give the signatures of one window that is all."""
    n = len(items)
    largest = 100 * n // percent
    differ = (n + largest) * (100 - percent) // (100 + percent)
    mixed, out = mix(items), []
    at = (items & U64((1 << HEAVY_BITS) - 1)).view(np.int64)
    light = (heavy[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 0
    c = int(np.searchsorted(_BEGIN, n, "right"))
    for cut in range(2 if largest >= _BEGIN[c] else 1):
        windows = _windows(c + cut)
        tokens, marks, few = _windowed(items, mixed, light, c + cut, windows, differ // windows + 1, c + cut)
        out.append((tokens, marks, np.full(len(tokens), 4 * n + cut, np.uint32)))
        if few and windows > 1:
            tokens, marks, _ = _windowed(items, mixed, light, c + cut, 1, differ + 1, c + cut + len(_BEGIN))
            out.append((tokens, marks, np.full(len(tokens), 4 * n + 2, np.uint32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def cuts_of(sizes: np.ndarray) -> np.ndarray:
    """The windows that a set's size times four and a number tell: 0 those of its class, 1 of the next, 2 one."""
    size_class, cut = np.searchsorted(_BEGIN, sizes.astype(np.int64) >> 2, "right"), sizes & 3
    of = np.array([_windows(c) for c in range(len(_BEGIN))], np.int64)
    return np.where(cut == 2, 1, of[np.minimum(size_class + (cut == 1), len(of) - 1)])


def signatures(items: np.ndarray, percent: int, heavy: np.ndarray) -> np.ndarray:
    return marked(items, percent, heavy)[0]


def near_marks(n, m, x, y, windows, percent: int):
    """Whether sets of sizes n and m may reach percent by the marks x and y of one window: a mark has the parity of the
    number of shingles at each of 64 places, so as many bits differ as shingles do, at most."""
    return np.bitwise_count(x ^ y) <= (n + m - 2 * least_overlap(n, m, percent)) // windows


def _postings(size: int, percent: int, buckets: int, heavy: np.ndarray):
    """Signatures of all distinct sets, packed by bucket: tokens (signatures), keys and sizes of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found, keys = [], []
            for items in shingle_sets(batch["text"], size):
                if not len(items) or (k := _key(items)) in seen:
                    continue
                seen.add(k)
                found.append(marked(items, percent, heavy))
                keys.append(np.full(len(found[-1][0]), k, np.int64))
            if len(seen) > SEEN:
                seen.clear()
            if not found:
                continue
            tokens, marks, sizes, k = (np.concatenate(x) for x in (*zip(*found, strict=True), keys))
            b = (tokens % U64(buckets)).astype(np.int64)
            columns = [(mix(tokens) >> U64(32)).astype(np.uint32), marks, k, sizes]
            order = np.argsort(b, kind="stable")
            b = b[order]
            cut = np.flatnonzero(np.diff(b)) + 1
            blobs = [pa.array([x.tobytes() for x in np.split(a[order], cut)], pa.binary()) for a in columns]
            yield pa.RecordBatch.from_arrays([pa.array(b[np.concatenate(([0], cut))]), *blobs], ["bucket", *_POSTED])

    return releasing(run)


class _Links:
    """Links between classes; held as the least of them that connect the same ones when they become many."""

    def __init__(self):
        self.src, self.dst, self.held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    def add(self, src: np.ndarray, dst: np.ndarray) -> None:
        self.src.append(src)
        self.dst.append(dst)
        self.held += len(src)
        if self.held > 1 << 21:
            self.least()

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        nodes, roots = local_labels(np.concatenate(self.src), np.concatenate(self.dst))
        keep = nodes != roots
        self.src, self.dst, self.held = [nodes[keep]], [roots[keep]], 0
        return self.src[0], self.dst[0]


def _peeled(k: np.ndarray, n: np.ndarray, marks: np.ndarray, windows: np.ndarray, percent: int, links: _Links) -> None:
    """Links of a large group of sets, by size, with one signature: the middle one is met with all, and so is each that is not
    connected with it by then. Those that are need not be met with each other."""
    connected, me = np.zeros(len(k), bool), len(k) // 2
    for i in (me, *range(len(k))):
        if connected[i]:
            continue
        lo, hi = np.searchsorted(n, -(-percent * n[i] // 100)), np.searchsorted(n, 100 * n[i] // percent, "right")
        near = lo + np.flatnonzero(near_marks(n[lo:hi], n[i], marks[lo:hi], marks[i], windows[i], percent))
        links.add(np.full(len(near), k[i]), k[near])
        if i == me or connected[near].any():
            connected[near] = True


def _candidates(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, x, k, n = (np.frombuffer(b"".join(pdf[c]), kind) for c, kind in _POSTED.items())
        order = np.argsort(t, kind="stable")
        ts = t[order]
        twice = np.zeros(len(ts), bool)
        twice[1:] = ts[1:] == ts[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice]
        order = order[np.lexsort((k[order], n[order], t[order]))]
        t, k, n, x = t[order], k[order], n[order], x[order]
        once = np.ones(len(t), bool)  # tasks give the postings of equal sets once each
        once[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (x[1:] != x[:-1]) | (n[1:] != n[:-1])
        t, k, n, x = t[once], k[once], n[once], x[once]
        w, n = cuts_of(n), n.astype(np.int64) >> 2
        begins = np.flatnonzero(np.concatenate((np.ones(min(len(t), 1), bool), t[1:] != t[:-1])))
        ends = np.append(begins[1:], len(t)).astype(np.int64)
        links, large = _Links(), ends - begins > MET_ALL
        for i, j in zip(begins[large].tolist(), ends[large].tolist(), strict=True):
            _peeled(k[i:j], n[i:j], x[i:j], w[i:j], percent, links)
        end = np.repeat(ends, ends - begins)
        at, lag = np.flatnonzero(~np.repeat(large, ends - begins)), 1
        while len(at := at[at + lag < end[at]]):
            at = at[100 * n[at] >= percent * n[at + lag]]  # sizes rise, so later ones are no partners either
            near = at[near_marks(n[at], n[at + lag], x[at], x[at + lag], w[at], percent)]
            links.add(k[near], k[near + lag])
            lag += 1
        src, dst = links.least()
        del t, k, n, x, w, ts, order, once
        release()
        return pd.DataFrame({"src": src, "dst": dst})

    return run


def _verify(size: int, percent: int):
    """Joins the groups (comp, bi, bj) of rows sorted by these, one group at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def joined() -> pa.RecordBatch:
            k = np.fromiter(held, np.int64, len(held))
            roots = k[trie_components(list(held.values()), percent)] if len(k) > 1 else k
            keep = roots != k
            return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(roots[keep])], ["src", "dst"])

        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("comp", "bi", "bj")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if group is not None and group != tuple(keys[i]):
                    yield joined()
                    if len(held) > 500:
                        release()
                    held = {}
                group = tuple(keys[i])
                part = batch.slice(i, j - i)
                held.update(zip(part["k"].to_pylist(), shingle_sets(part["text"], size), strict=True))
        if held:
            yield joined()

    return releasing(run)


def _near_first(size: int, percent: int):
    """Rows (comp, part, k, text, is_first) sorted by comp and part, of which each part begins with the comp's first class, which is told
    by is_first: for each other row whether its class is linked with the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, first_k = np.zeros(0, np.uint64), 0
        for batch in batches:
            out = []
            for comp, k, is_first, s in zip(batch["comp"].to_pylist(), batch["k"].to_pylist(), batch["is_first"].to_pylist(), shingle_sets(batch["text"], size), strict=True):
                if is_first:
                    first, first_k = s, k
                    continue
                both = len(np.intersect1d(first, s, assume_unique=True))
                out.append((comp, k, first_k, k == first_k or 100 * both >= percent * (len(first) + len(s) - both)))
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["comp", "k", "first_k", "near"])

    return releasing(run)


def _dealt(chosen: DataFrame, large: DataFrame, base: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """How the classes of large comps are compared: chosen with `mine`, the block of a class, and `others`, how many blocks it is compared
    with (from 0 on); and links found on the way (src, dst).

    Each class is compared with the comp's first class (least k). Those linked with it are in one component already and need no
    comparison with each other, so blocks of the rest are numbered first and compared with all, blocks of linked ones with
    those of the rest alone: near copies of one text cost their number, not its square. Texts without a link to the first
    class are compared with every class, which stays exact."""
    first = chosen.join(large, "comp").groupBy("comp", "blocks").agg(F.min("k").alias("first_k"))
    text = lambda df: df.join(base, (hashes() == F.col("one_th")) & base.doc_id.eqNullSafe(F.col("one_id")))
    members = text(chosen.join(large, "comp")).select("comp", F.pmod("k", "blocks").cast("int").alias("part"), "k", "text", F.lit(False).alias("is_first"))
    heads = text(chosen.join(first, "comp").where("k = first_k")).dropDuplicates(["comp"])
    heads = heads.select("comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), "k", "text", F.lit(True).alias("is_first"))
    met = members.unionByName(heads).repartition("comp", "part").sortWithinPartitions("comp", "part", F.desc("is_first"))
    found = materialize(met.mapInArrow(_near_first(size, percent), "comp long, k long, first_k long, near boolean").dropDuplicates(["k"]), "near")
    sized = found.join(chosen.select("k", "n"), "k")
    blocks = lambda near: F.ceil(F.coalesce(F.sum(F.when(F.col("near") == near, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES).cast("int")
    counts = sized.groupBy("comp").agg(blocks(False).alias("rest"), blocks(True).alias("linked"))
    placed = found.join(counts, "comp").select("k", F.when(F.col("near"), F.col("rest") + F.pmod("k", "linked")).otherwise(F.pmod("k", F.greatest("rest", F.lit(1)))).cast("int").alias("mine"), F.when(F.col("near"), F.col("rest")).otherwise(F.col("rest") + F.col("linked")).alias("others"))
    asked = chosen.join(materialize(placed, "placed"), "k", "left").withColumns({"mine": F.coalesce("mine", F.lit(0)), "others": F.coalesce("others", F.lit(1))})
    return asked, found.where("near and k <> first_k").select(F.col("k").alias("src"), F.col("first_k").alias("dst"))


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """What jaccard_components gives, and th, the hash of the text, and root, which is null for texts without a shingle
    and else the same for all rows of a component."""
    small_batches(docs.sparkSession)
    begun = written()
    base = docs.select("doc_id", "text")
    buckets = n_buckets(base, 10 << 20, spread=False)  # a group of copies gives its links once a bucket
    kind = base.schema["doc_id"].dataType.simpleString()
    signed = materialize(base.select("doc_id", hashes().alias("th"), "text").mapInArrow(_signatures(size), f"doc_id {kind}, th long, n long, k long, token long, times long"), "signatures")
    rows = signed.where("n is not null").select("doc_id", "th", F.col("n").alias("n_shingles"), "k")
    counts = materialize(signed.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")), "heavy")
    room, least = HEAVY, 1 << 62
    step = F.floor(F.log2("times") * 16)  # of times up to 2 ** 63 at most 1,008 values
    frequent = counts.where(F.col("times") >= HEAVY_FROM)
    for r in frequent.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("times").alias("least")).orderBy(F.desc("step")).collect():
        room -= r["n"]
        if room < 0:
            break
        least = r["least"]
    tokens = frequent.where(F.col("times") >= least).select("token").toPandas()["token"].to_numpy(np.int64)  # at most HEAVY rows
    heavy = np.zeros(1 << HEAVY_BITS, bool)
    heavy[tokens & ((1 << HEAVY_BITS) - 1)] = True
    packed = base.select("text").mapInArrow(_postings(size, percent, buckets, np.packbits(heavy, bitorder="little")), "bucket long, " + ", ".join(f"{c} binary" for c in _POSTED))
    near = packed.groupBy("bucket").applyInPandas(_candidates(percent), "src long, dst long")
    groups = connected_components(near)

    classes = materialize(rows.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "th")).alias("one")), "classes")
    chosen = materialize(groups.join(classes, groups.node == classes.k).select("k", "n", F.col("root").alias("comp"), F.col("one.doc_id").alias("one_id"), F.col("one.th").alias("one_th")), "chosen")
    large = chosen.groupBy("comp").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks")).where("blocks > 1")
    split, many = not large.isEmpty(), chosen.count()
    asked, known = _dealt(chosen, large, base, size, percent) if split else (chosen.withColumns({"mine": F.lit(0), "others": F.lit(1)}), None)
    asked = F.broadcast(asked) if many <= BROADCAST_CLASSES else asked
    other = F.col("other")
    met = (
        base.join(asked, (hashes() == F.col("one_th")) & base.doc_id.eqNullSafe(F.col("one_id"))).where("others > 0")
        .select("k", "comp", "text", "mine", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
        .select("k", "comp", "text", F.least("mine", other).alias("bi"), F.greatest("mine", other).alias("bj"))
    )
    dealt = met.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    links = dealt.mapInArrow(_verify(size, percent), "src long, dst long")
    links = links.unionByName(known) if split else links
    roots = connected_components(links) if split else materialize(links.toDF("node", "root"), "links")
    where = classes.join(roots, classes.k == roots.node, "left").select("k", "first", F.coalesce("root", "k").alias("root"))
    least = where.groupBy("root").agg(F.min("first").alias("component_id"))
    of = materialize(where.join(least, "root").select("k", "root", "component_id"), "components")
    discard_since(docs.sparkSession, begun, signed, of)
    return rows.join(of, "k", "left").select("doc_id", "th", "root", "n_shingles", F.when(F.col("k").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; further columns are ignored).

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct `size`-word shingles, or the
    whole sequence where there are fewer words. Rows link when 100 * intersection >= percent * union. component_id is the
    smallest doc_id that links reach, the row's own where nothing links. Null and empty texts have n_shingles 0 and link
    with nothing. Repeated rows are returned as often as they come; a row whose doc_id is null keeps null unless
    something with an id is linked to it. An empty table gives an empty result. Sets and shingles are compared by 64-bit
    hashes.
    """
    return _components(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, null last, then of the smallest text hash. Rows that
    repeat doc_id and text are one document, of which the row with the smallest hash of all columns stays; texts without a
    shingle are in no component, and of those without doc_id all stay."""
    found = materialize(_components(docs, size, percent).select("doc_id", "th", "root"), "members")
    at = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("th").alias("t"))
    best = found.where("root is not null").groupBy("root").agg(F.min(at).alias("best"), F.count("*").alias("n")).where("n > 1").select("root", "best")
    pair = lambda df: df.select(F.col("doc_id").alias("_mirador_id"), F.col("th").alias("_mirador_th"))
    same = docs.doc_id.eqNullSafe(F.col("_mirador_id")) & (hashes() == F.col("_mirador_th"))
    gone = materialize(pair(found.join(best, "root").where(at > F.col("best"))).distinct(), "gone")
    again = found.where("doc_id is not null or root is not null").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    again = materialize(pair(again), "again")
    kept = docs.join(told(gone), same, "left_anti")
    if again.isEmpty():
        return kept.select(*docs.columns)
    again = told(again)
    once, more = kept.join(again, same, "left_anti"), kept.join(again, same, "left_semi").withColumn("_mirador_th", hashes())
    nth = F.row_number().over(Window.partitionBy("doc_id", "_mirador_th").orderBy(F.xxhash64(*docs.columns)))
    return once.select(*docs.columns).union(more.withColumn("_mirador_nth", nth).where("_mirador_nth = 1").select(*docs.columns))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five-word shingles, Jaccard similarity 0.8."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
