"""Personal data in texts: four kinds by fixed rules, and more identifiers by patterns that the first ones teach.

Base rules (email, ip, card, phone) run over whole texts in linear time; null is the empty text, positions are code points, ends
exclusive, kinds are independent of each other. Every other word with a digit or an `@` is a candidate (of up to WORD
characters; a number goes on over single signs and spaces between digits, to as many).

Bootstrapping: what the base rules find are seeds. A lexical pattern is the one or two words before an identifier, A-Z lower-cased
and cut after `:`, `=` and `#` (words over WORD characters make none). In the graph of patterns and instances, round by round:
a pattern's confidence for a kind is the share of all its occurrences in the corpus that precede a known instance, identifiers that
are not known counted half, as they may be what is looked for, times s / (s + 1) for s distinct known instances (LEAST_SUPPORT at least); an instance is believed by 1 - the product of (1 - confidence)
over the patterns that accept it; what is believed enough joins the known instances and teaches the next round. All mentions of
instances learned this way become spans of the kind of their patterns; base spans always stay, and candidates that touch one are
none. A text that is repeated counts as often as it stands, in a pattern's hits and in all its occurrences alike.

Edge cases: null and empty texts, and empty tables, have no spans; null ids and repeated rows are rows of their own; other columns
are not read. Counts and confidences cover all documents. Python sees one Arrow batch of texts at a time; the tables of mentions,
patterns and instances are Spark's, and only a bitmap of fixed size and counts reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirador.llm.common import PLACE, U64, discard_since, doc_chunks, hash_words, materialize, mix, releasing, small_batches, text_buffer, told, written

KINDS = ["email", "ip", "card", "phone"]
WORD, LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_BELIEF, ROUNDS = 64, 3, 0.5, 0.6, 4
#: Bits of the bitmap that says which patterns to count; what passes it by chance is dropped by a join.
MARK_BITS = 26

# ---------------------------------------------------------------- base rules

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """At each `@`: the domain after it and the run of characters before it, which nothing but an earlier match cuts."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            begin = at
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                yield begin, domain.end()
                done = domain.end()
        at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Chains of numbers joined by points, four by four."""
    for chain in _CHAIN.finditer(text):
        parts = [(m.start(), m.end()) for m in _DIGITS.finditer(text, chain.start(), chain.end())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            values = [text[a:b].lstrip("0") for a, b in four]
            if all(len(v) < 3 or len(v) == 3 and v <= "255" for v in values):
                yield four[0][0], four[3][1]


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGITS.sub("", m.group())
            if 14 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGITS.sub("", m.group())) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start and kind."""
    return sorted((a, k, b) for k, find in enumerate((_emails, _addresses, _cards, _phones)) for a, b in find(text))


# ---------------------------------------------------------------- candidates and their patterns

_SPACE = r" \t\n\x0b\x0c\r"
_CANDIDATE = re.compile(rf"(?:^|(?<=[{_SPACE}]))[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+")
_NUMBER = re.compile(rf"[+(]?[0-9](?:[\x20().+/-]{{0,2}}[0-9]){{0,{WORD}}}+")
_SIGN = re.compile(r"[0-9@]")
_WORDS = re.compile(rf"[^{_SPACE}]+")
_CUT = re.compile(r"([:=#])")
_OPENING, _CLOSING = "([{<\"'", ".,;:!?)]}>\"'"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def patterns_before(text: str, at: int) -> list[str]:
    """The last word, and the last two, that end before a place; none where the place is inside a word."""
    while at and text[at - 1] in _OPENING:
        at -= 1
    if not at or text[at - 1] not in " \t\n\x0b\x0c\r:=#":
        return []
    begin = max(0, at - 2 * WORD - 4)
    words = _WORDS.findall(_CUT.sub(r"\1 ", text[begin:at]))
    if begin and words and text[begin - 1] not in " \t\n\x0b\x0c\r:=#" and text[begin] not in " \t\n\x0b\x0c\r":
        words = words[1:]
    words = [w.translate(_LOWER) for w in words[-2:]]
    if not words or len(words[-1]) > WORD:
        return []
    return [words[-1]] + ([" ".join(words)] if len(words) == 2 and len(words[0]) <= WORD else [])


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of words with a digit or an `@` that touch no base span."""
    taken, reach, done = 0, 0, 0
    for m in _CANDIDATE.finditer(text):
        begin, end = m.span()
        mark = max(text.rfind(c, begin, end - 1) for c in ":=#")
        begin = max(begin, mark + 1, done)
        while begin < end and text[begin] in _OPENING:
            begin += 1
        if begin < end and (number := _NUMBER.match(text, begin)):
            end = max(end, number.end())
        while begin < end and text[end - 1] in _CLOSING:
            end -= 1
        if not 4 <= end - begin <= WORD or not _SIGN.search(text, begin, end):
            continue
        while taken < len(base) and base[taken][0] < end:
            reach, taken = max(reach, base[taken][2]), taken + 1
        if reach <= begin:
            yield begin, end
            done = end


_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
MENTION_TYPE = "array<struct<kind:int,start:int,end:int,instance:string,patterns:array<string>>>"


def mentions_of(text: str) -> list[dict]:
    """Base spans (kind as listed in KINDS) and candidates (kind null) with their instances and patterns."""
    base = base_spans(text)
    found = [(k, a, b) for a, k, b in base] + [(None, a, b) for a, b in candidates(text, base)]
    return [{"kind": k, "start": a, "end": b, "instance": text[a:b].translate(_LOWER), "patterns": patterns_before(text, a)} for k, a, b in found]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [mentions_of(t) if t else [] for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(_MENTION))], names=["row", "id", "mentions"])


def search(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, mentions): a row for each document, with a number of its own."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(releasing(_searched), f"row long, id {kind}, mentions {MENTION_TYPE}")


# ---------------------------------------------------------------- the graph of patterns and instances


def _keys(words: np.ndarray, doc: np.ndarray, pair: bool) -> np.ndarray:
    """Keys of the words, or pairs of words, of one document that another word follows; words are hashes."""
    if pair:
        same = (doc[2:] == doc[:-2]) if len(doc) > 2 else np.zeros(0, bool)
        return mix(words[:-2] * PLACE[0] + words[1:-1] * PLACE[1] + U64(2))[same] if len(words) > 2 else words[:0]
    return mix(words[:-1] * PLACE[0] + U64(1))[doc[1:] == doc[:-1]] if len(words) > 1 else words[:0]


def _pattern_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of patterns, made of the same hashes as those of texts' words."""
    for b in batches:
        out = np.zeros(b.num_rows, np.uint64)
        data, offsets = text_buffer(b.column(0))
        for i, j in doc_chunks(offsets):
            h, doc = hash_words(data, offsets, i, j, "space")
            n = np.bincount(doc, minlength=j - i)
            begin = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
            two = n == 2
            key = h[begin] * PLACE[0] + U64(1)
            key[two] = h[begin[two]] * PLACE[0] + h[begin[two] + 1] * PLACE[1] + U64(2)
            out[i:j] = mix(key)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], names=["pattern", "key"])


def _occurrences(docs: DataFrame, patterns: DataFrame, text: str) -> DataFrame:
    """(key, total): how often each pattern (pattern, key) stands before any word, in all texts. Tasks pass over contexts whose bit
    in a bitmap of 2**MARK_BITS is not set, and add up the others."""
    spark, word = docs.sparkSession, F.shiftrightunsigned("key", 64 - MARK_BITS + 6)
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 32) & 63 as int))")
    marks = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    for b in patterns.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow().to_batches():  # 2**(MARK_BITS - 6) rows at most
        marks[b.column(0).to_numpy()] = b.column(1).to_numpy().view(np.uint64)
    marked = spark.sparkContext.broadcast(marks)

    def counted(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

    def batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            words = b.column(0)
            for c in ":=#":
                words = pc.replace_substring(words, c, f"{c} ")
            data, offsets = text_buffer(words)
            for i, j in doc_chunks(offsets):
                h, doc = hash_words(data, offsets, i, j, "space")
                keys = np.concatenate((_keys(h, doc, False), _keys(h, doc, True)))
                bits = marked.value[(keys >> U64(64 - MARK_BITS + 6)).astype(np.int64)] >> ((keys >> U64(32)) & U64(63))
                held.append(np.unique(keys[(bits & U64(1)) > 0], return_counts=True))
                if sum(len(k) for k, _ in held) > 1 << 20:
                    held = [counted(held)]
                    if len(held[0][0]) > 1 << 19:
                        yield batch(*held.pop())
        if held:
            yield batch(*counted(held))

    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(releasing(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("total"))


def learn(docs: DataFrame, found: DataFrame, text: str = "text", rounds: int = ROUNDS, least_support: int = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE, least_belief: float = LEAST_BELIEF) -> tuple[DataFrame, DataFrame] | None:
    """(instances, patterns) learned from the mentions of search(docs): instance, kind, belief, round of unseen identifiers, and
    pattern, kind, support, confidence of the last round's patterns. None where nothing is learned."""
    every = found.select(F.explode("mentions").alias("m")).select("m.*")
    edges = every.select("instance", "kind", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    edges = materialize(edges, "edges")
    # a pattern that never has enough distinct instances is never learned; so nothing hangs on its edges
    busy = materialize(edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.count("kind").alias("seeds"), F.sum("n").alias("mentions")).where(F.col("instances") >= least_support), "busy")
    if not busy.where(F.col("seeds") >= least_support).limit(1).count():
        return None
    keyed = materialize(busy.select("pattern").mapInArrow(_pattern_keys, "pattern string, key long"), "keys")
    totals = materialize(keyed.join(_occurrences(docs, keyed, text), "key").select("pattern", "total"), "totals")
    totals = totals.join(busy, "pattern").select("pattern", "mentions", F.greatest(F.col("total") - F.col("mentions"), F.lit(0)).alias("others"))
    graph = materialize(edges.join(totals, "pattern"), "graph")
    seeds = every.where("kind is not null").groupBy("instance").agg(F.min("kind").alias("kind"))
    known = materialize(seeds.withColumns({"belief": F.lit(1.0), "round": F.lit(0)}), "known")
    patterns = None
    for turn in range(1, rounds + 1):
        hits = graph.drop("kind").join(known.select("instance", "kind"), "instance").groupBy("pattern", "kind").agg(F.count("*").alias("support"), F.sum("n").alias("hits"), F.max("mentions").alias("mentions"), F.max("others").alias("others"))
        known_all = F.sum("hits").over(Window.partitionBy("pattern"))  # of four kinds at most
        hits = hits.withColumn("against", F.col("others") + known_all + (F.col("mentions") - known_all) / 2)
        sure = F.col("hits") / F.col("against") * F.col("support") / (F.col("support") + 1)
        patterns = materialize(hits.where(F.col("support") >= least_support).withColumn("confidence", sure).where(F.col("confidence") >= least_confidence).select("pattern", "kind", "support", "confidence"), "patterns")
        held = graph.drop("kind").join(told(patterns), "pattern").join(known.select("instance"), "instance", "left_anti")
        belief = held.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("belief")).where(F.col("belief") >= least_belief)
        # of several kinds the one believed most, then the first listed
        best = belief.groupBy("instance").agg(F.max(F.struct("belief", (-F.col("kind")).alias("k"))).alias("b")).select("instance", (-F.col("b.k")).alias("kind"), F.col("b.belief").alias("belief"), F.lit(turn).alias("round"))
        new = materialize(best, "new")
        if not new.limit(1).count():
            break
        known = materialize(known.unionByName(new), "known")
    learned = known.where("round > 0")
    return (learned, patterns) if learned.limit(1).count() else None


def private_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_column, base, spans) for each document: arrays of (start, kind, end, instance) by start and kind; base holds what the
    fixed rules find, spans that and what was learned. `kind` is a place in KINDS."""
    begun = written()
    found = materialize(search(docs, id_column, text), "mentions")
    learned = learn(docs, found, text)
    span = lambda m, kind: F.struct(m["start"].alias("start"), kind.alias("kind"), m["end"].alias("end"), m["instance"].alias("instance"))
    base = F.array_sort(F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), lambda m: span(m, m["kind"])))
    rows = found.select("row", F.col("id").alias(id_column), base.alias("base"))
    if learned is None:
        out = rows.select(id_column, "base", F.col("base").alias("spans"))
        discard_since(docs.sparkSession, begun, found)
        return out
    loose = found.select("row", F.explode(F.filter("mentions", lambda m: m["kind"].isNull())).alias("m"))
    met = loose.join(told(learned[0].select(F.col("instance").alias("_i"), "kind")), F.col("m.instance") == F.col("_i"))
    more = materialize(met.groupBy("row").agg(F.collect_list(span(F.col("m"), F.col("kind"))).alias("more")), "more")
    discard_since(docs.sparkSession, begun, found, more)
    all_of = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return rows.join(told(more, 100_000), "row", "left").select(id_column, "base", all_of.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    got = private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    of = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(of) - F.size(F.array_remove(of, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
