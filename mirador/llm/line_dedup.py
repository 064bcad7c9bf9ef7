"""Line dedup as an exact set-similarity join, with DataFrame functions alone.

A line's tokens are its distinct five-word shingles; a shorter line is one token, which only equal lines share. A similar
line can lack few of a line's tokens, so of the first tokens in the order of their hashes at least some must be found in
other lines: those few tokens are written for each line and counted, and the lines of which too few are found are left out,
which are most. The whole sets of the others are made then, and their tokens counted and ordered by rarity. Lines that
share no token in their prefixes by rarity cannot be similar; those that do must pass the length and positional filters,
which depend on size and place alone and so are applied to groups of postings before any pair is made, before their sets
are compared. Of each pair of similar lines, the later in the order of doc_id and line goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirador.llm.common import discard, hashes, materialize, told

#: Tables of longs are broadcast up to so many rows (about 40 bytes each), beyond joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: The sets on one side of a comparison are broadcast up to about so many bytes.
BROADCAST_SETS = 16 << 20
#: The numbers of removed lines are broadcast up to about so many bytes, beyond joined by shuffle.
BROADCAST_BYTES = 64 << 20


def _told(df: DataFrame) -> DataFrame:
    return told(df, BROADCAST_ROWS)


def _plain() -> Column:
    """Column text with A-Z lower-cased and all white space but newlines as spaces, its UTF-8 bytes read as Latin-1: so lower
    does not slow down and changes A-Z and first bytes of characters alone. The latter stay distinct, as a character's
    number of bytes still tells apart those that become alike. translate takes several times as long."""
    odd = F.contains("text", F.lit("\t")) | F.contains("text", F.lit("\x0b")) | F.contains("text", F.lit("\f")) | F.contains("text", F.lit("\r"))
    spaced = F.when(odd, F.translate("text", "\t\x0b\f\r", "    ")).otherwise(F.col("text"))
    return F.lower(F.decode(spaced.cast("binary"), "ISO-8859-1"))


def _split(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, line) of all lines, as _plain has them. posexplode_outer, as explode would have its array computed
    once more in a filter before it."""
    return docs.select("doc_id", hashes().alias("th"), F.posexplode_outer(F.split(_plain(), "\n")).alias("line_no", "line"))


def _hashed(parts: DataFrame, *others: str) -> DataFrame:
    """The columns others, and h: the hashes of the words of column line."""
    return parts.select(*others, F.transform(F.array_remove(F.split("line", " "), ""), lambda x: F.xxhash64(x)).alias("h"))


def _tokens(size: int) -> Column:
    """The sorted tokens of h. h must be named more than once in a projection, else the optimiser moves its computation into
    the lambda."""
    gram = ", ".join(["x", *(f"get(h, i + {k})" for k in range(1, size))])  # several times as fast as the hash of a slice
    return F.sort_array(F.array_distinct(F.expr(f"transform(slice(h, 1, size(h) - {size - 1}), (x, i) -> xxhash64({gram}))")))


def _spare(n: str, percent: int) -> str:
    """How many of n tokens a similar set may lack."""
    return f"({n} - ({n} * {percent} + 99) div 100)"


def _least(n: str, m: str, percent: int) -> str:
    """The smallest overlap of sets of sizes n and m that reaches percent."""
    return f"((({n} + {m}) * {percent} + {99 + percent}) div {100 + percent})"


def _lines(docs: DataFrame, size: int, percent: int, least_words: int) -> DataFrame:
    """(doc_id, th, line_no, lid, n, head): lid, null for lines that never match, is a hash of a line's words, n the number of
    its tokens, head the first of them by hash: half as many again as a similar set may lack, and one. A line of fewer than
    `size` words has neither n nor head."""
    hashed = _hashed(_split(docs), "doc_id", "th", "line_no")
    lid = F.when(F.size("h") >= max(least_words, 1), F.xxhash64("h"))
    whole = hashed.select("doc_id", "th", "line_no", lid.alias("lid"), F.when(F.size("h") >= max(size, least_words), _tokens(size)).alias("tokens"))
    spare = _spare("size(tokens)", percent)
    return whole.select("doc_id", "th", "line_no", "lid", F.size("tokens").alias("n"), F.expr(f"slice(tokens, 1, {spare} + {spare} div 2 + 1)").alias("head"))


def _place() -> Column:
    """A hash of the place of a line."""
    return F.xxhash64("doc_id", "th", "line_no")


def _candidates(lines: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """lid of the lines of whose head so many tokens are in heads of other lines that a similar line is possible. copies: (lid,
    one) of the lines that come more than once, of which the one whose place has the hash `one` stands for all.

    Of two similar lines take the one whose head ends first. The other has all of its head but the tokens that it may lack, and
    has them in its own head, so both heads share half of what the first may lack, and one. The first may be the smaller."""
    smaller = f"((n * {percent} + 99) div 100)"
    each = lines.where("head is not null").join(_told(copies), "lid", "left").where(F.col("one").isNull() | (F.col("one") == _place()))
    posts = each.select("lid", "n", F.explode_outer("head").alias("token"))
    shared = materialize(posts.groupBy("token").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).where("a <> b").select("token"), "line-shared")
    found = posts.join(_told(shared), "token").groupBy("lid", "n").agg(F.count("*").alias("hits"))
    out = materialize(found.where(f"hits >= {_spare(smaller, percent)} div 2 + 1").select("lid"), "line-ids")
    discard(shared)
    return out


def _by_rarity(sets: DataFrame, percent: int) -> DataFrame:
    """(token, r, n, pos): the tokens in the prefixes by rarity of sets (r, tokens) that other sets have too; pos is from 0.
    Tokens that one set has come first, and only their number matters."""
    each = sets.select("r", F.size("tokens").alias("n"), F.explode_outer("tokens").alias("token"))
    counts = materialize(each.groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "line-counts")
    back = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("c"), F.desc("token")))  # from the most frequent one, which is the last
    placed = each.join(counts, "token").select("token", "r", "n", (F.col("n") - back).alias("pos")).where(f"pos <= {_spare('n', percent)}")
    out = materialize(placed, "line-placed")
    discard(counts)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, best: bool) -> DataFrame:
    """The lines r of pairs (r, n, pos; other, m, q: a row per shared prefix token) that pass the filters and whose sets
    reach percent; where best, of each line's pairs only the one that comes most often, as not all its tokens are there.

    The overlap is at most the c shared tokens of these rows and what follows the last of them: they are the first c that
    both sets share, as the positional filter lets no later one through that it stops an earlier one."""
    asked = pairs.groupBy("r", "other", "n", "m").agg(F.count("*").alias("c"), F.max("pos").alias("p"), F.max("q").alias("q"))
    if best:
        asked = asked.groupBy("r").agg(F.max_by("other", F.struct("c", "other")).alias("other"))
    else:
        asked = asked.where(F.expr(f"c + least(n - p, m - q) - 1 >= {_least('n', 'm', percent)}"))
    asked = materialize(asked.select("r", "other"), "line-pairs")
    few = asked.count() <= BROADCAST_ROWS
    others = asked.select("other").distinct()
    x = sets.join(F.broadcast(asked) if few else asked, "r").select("r", "other", F.col("tokens").alias("x"))
    y = sets.join(F.broadcast(others) if few else others, sets.r == others.other, "left_semi").select(F.col("r").alias("other"), F.col("tokens").alias("y"))
    small = few and (y.agg(F.sum(16 + 8 * F.size("y"))).first()[0] or 0) <= BROADCAST_SETS
    both = x.join(F.broadcast(y) if small else y, "other")
    near = both.where(F.size(F.array_intersect("x", "y")) >= F.expr(_least("size(x)", "size(y)", percent))).select("r").distinct()
    near = materialize(near, "line-matched")
    discard(asked)
    return near


def _met(open_: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Rows (r, n, pos, other, m, q) for each shared prefix token of a line of open_ and an earlier one that passes the length
    and positional filters. The filters look at (n, pos) and (m, q) alone: such groups of a token's postings are paired
    first, so pairs that do not pass are never made."""
    cells = placed.groupBy("token", "n", "pos").agg(F.min("r").alias("first"))
    mine = open_.groupBy("token", "n", "pos").agg(F.max("r").alias("last"))
    other = cells.select("token", F.col("n").alias("m"), F.col("pos").alias("q"), "first")
    alike = F.expr(f"least(n, m) * 100 >= greatest(n, m) * {percent} and least(n - pos, m - q) >= {_least('n', 'm', percent)}")
    pass_ = mine.join(other, "token").where(alike & (F.col("first") < F.col("last"))).select("token", "n", "pos", "m", "q")
    theirs = placed.select("token", F.col("r").alias("other"), F.col("n").alias("m"), F.col("pos").alias("q"))
    return open_.join(pass_, ["token", "n", "pos"]).join(theirs, ["token", "m", "q"]).where("other < r").select("r", "n", "pos", "other", "m", "q")


def lines_with_earlier_match(docs: DataFrame, ids: DataFrame, first: DataFrame, size: int, percent: int) -> DataFrame:
    """lid of every line of ids similar to another one whose first place is earlier. first: (lid, first).

    Candidate lines are numbered in the order of their first places, where their words are read again. Round one looks,
    token by token, at the earliest line that has it, and at the earliest of the same size, and compares each line with
    the one that comes up most often. Only lines without a match then meet all the earlier ones that pass the filters."""
    # a sort by ranges is distributed, and these numbers rise from range to range
    ranked = first.join(_told(ids), "lid", "left_semi").orderBy("first").select("lid", F.monotonically_increasing_id().alias("r"), F.col("first.d").alias("d"), F.col("first.t").alias("t"), F.col("first.l").alias("l"))
    ranked = materialize(ranked, "line-ranks")
    homes = materialize(ranked.select(F.col("t").alias("home")).distinct(), "line-homes")
    if homes.count() <= BROADCAST_ROWS:  # beyond, whole texts would be shuffled
        docs = docs.join(F.broadcast(homes), hashes() == F.col("home"), "left_semi")
    parts = _split(docs)
    here = parts.doc_id.eqNullSafe(F.col("d")) & (parts.th == F.col("t")) & (parts.line_no == F.col("l"))
    hashed = _hashed(parts.join(_told(ranked), here), "r")
    sets = materialize(hashed.select("r", F.when(F.size("h") >= size, _tokens(size)).alias("tokens")), "line-sets")
    if sets.count() > ranked.count():  # rows that repeat doc_id and text
        repeated, sets = sets, materialize(sets.groupBy("r").agg(F.first("tokens").alias("tokens")), "line-sets")
        discard(repeated)
    placed = _by_rarity(sets, percent)
    me = [F.min("r").alias("other"), F.expr("min_by(shiftleft(cast(n as bigint), 32) + pos, r)").alias("x")]  # longs, to be aggregated by hash
    earliest, alike = (placed.join(placed.groupBy(*by).agg(*me), by).where("other < r") for by in (["token"], ["token", "n"]))
    met = earliest.select("r", "n", "pos", "other", "x").union(alike.select("r", "n", "pos", "other", "x"))
    met = met.select("r", "n", "pos", "other", F.expr("cast(shiftright(x, 32) as int)").alias("m"), F.expr("cast(x & 4294967295 as int)").alias("q"))
    matched = _verified(met.where(f"least(n, m) * 100 >= greatest(n, m) * {percent}"), sets, percent, True)
    open_ = placed.join(_told(matched), "r", "left_anti")
    late = _verified(_met(open_, placed, percent), sets, percent, False)
    near = materialize(ranked.join(_told(matched).union(late), "r", "left_semi").select("lid"), "line-near")
    discard(ranked, homes, sets, placed, matched, late)
    return near


def removed_lines(docs: DataFrame, size: int = 5, percent: int = 80, least_words: int = 1) -> DataFrame:
    """(doc_id, th, gone): for each document with such lines the numbers, from 0, of the lines that match an earlier one."""
    docs = docs.select("doc_id", "text")
    lines = materialize(_lines(docs, size, percent, least_words), "lines")
    light = lines.where("lid is not null").select("lid", "doc_id", "th", "line_no")
    copies = light.groupBy("lid").agg(F.count("*").alias("copies"), F.min(_place()).alias("one")).where("copies > 1")
    copies = materialize(copies.select("lid", "one"), "line-copies")
    ids = _candidates(lines, copies, percent)
    asked = materialize(copies.select("lid").union(ids).distinct(), "line-asked")
    at = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("line_no").alias("l"))
    places = materialize(light.join(_told(asked), "lid"), "line-places")
    first = materialize(places.groupBy("lid").agg(F.min(at).alias("first"), F.count("*").alias("n")), "line-first")
    near = lines_with_earlier_match(docs, ids, first, size, percent).withColumn("near", F.lit(True))
    bound = first.join(near, "lid", "left").where((F.col("n") > 1) | F.col("near")).select("lid", "first", F.coalesce("near", F.lit(False)).alias("near"))
    bound = materialize(bound, "line-bound")
    gone = places.join(bound, "lid").where(F.col("near") | (at > F.col("first"))).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    gone = materialize(gone, "lines-gone")
    discard(lines, copies, ids, asked, places, first, near, bound)
    return gone


def dedup_lines(docs: DataFrame, size: int = 5, percent: int = 80, least_words: int = 1) -> DataFrame:
    """docs with the lines removed that match an earlier line of any document; adds n_lines, n_gone and changes text.

    Lines end at a newline. Words are runs without ASCII white space, A-Z lower-cased. Lines of fewer than `least_words`
    words, and blank ones, never match; a line of fewer than `size` words is one shingle, so it matches equal lines alone.
    Two lines match when their distinct word shingles of `size` reach percent / 100 of Jaccard similarity; of all
    matching lines only those without an earlier match stay. Earlier means a smaller doc_id (null last), then a smaller
    line number; rows that repeat doc_id and text are one document and keep the same lines. Null text stays null; empty
    tables stay empty. Columns of docs are kept, but for n_lines and n_gone, which are replaced. Lines and shingles are
    compared by 64-bit hashes.
    """
    gone = removed_lines(docs, size, percent, least_words).select(F.col("doc_id").alias("_mirador_id"), F.col("th").alias("_mirador_th"), F.col("gone").alias("_mirador_gone"))
    found = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_mirador_gone")), F.lit(0))).first()
    if 40 * found[0] + 4 * found[1] <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    met = docs.join(gone, docs.doc_id.eqNullSafe(F.col("_mirador_id")) & (hashes() == F.col("_mirador_th")), "left")
    cut = met.withColumn("_mirador_lines", F.split("text", "\n"))
    left = F.expr("transform(array_except(sequence(0, size(_mirador_lines) - 1), _mirador_gone), i -> get(_mirador_lines, i))")
    text = F.when(F.col("_mirador_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    others = [F.col(c) if c != "text" else text.alias("text") for c in docs.columns if c not in ("n_lines", "n_gone")]
    return cut.select(*others, F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_mirador_lines")).cast("long").alias("n_lines"), F.coalesce(F.size("_mirador_gone"), F.lit(0)).cast("long").alias("n_gone"))


def without_repeats(docs: DataFrame, size: int = 5, percent: int = 80, least_words: int = 1) -> DataFrame:
    """dedup_lines for a pipeline: the columns of docs, n_chars counted anew. A document that lost lines goes
    as a whole only where no line, or only blank ones, are left."""
    kept = {c: f"_mirador_kept_{c}" for c in ("n_lines", "n_gone") if c in docs.columns}
    out = dedup_lines(docs.withColumnsRenamed(kept), size, percent, least_words)
    out = out.where((F.col("n_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_gone") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.drop("n_lines", "n_gone").withColumnsRenamed({v: k for k, v in kept.items()}).select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes repeated and similar lines from all documents: doc_id, n_lines, n_gone, and the text that is left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_gone", "text")


OP6_SQL = r"""
WITH l AS (SELECT doc_id, i, t[i] AS line, list_filter(string_split_regex(translate(t[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents))),
k AS (SELECT doc_id, i, array_to_string(w, ' ') AS s FROM l WHERE len(w) >= 1),
f AS (SELECT s, min((doc_id, i)) AS first FROM k GROUP BY s),
g AS (SELECT s, first, CASE WHEN len(w) < 5 THEN [s || ' '] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda j: array_to_string(w[j : j + 4], ' '))) END AS g
      FROM (SELECT s, first, string_split(s, ' ') AS w FROM f)),
e AS (SELECT s, first, len(g) AS n, unnest(g) AS t FROM g),
p AS (SELECT a.s, b.first AS other FROM e a JOIN e b ON a.t = b.t AND a.s <> b.s
      GROUP BY a.s, b.s, b.first, a.n, b.n HAVING 180 * count(*) >= 80 * (a.n + b.n)),
o AS (SELECT s, min(other) AS other FROM p GROUP BY s),
r AS (SELECT k.doc_id, k.i FROM k JOIN f USING (s) LEFT JOIN o USING (s) WHERE (k.doc_id, k.i) > least(f.first, coalesce(o.other, f.first)))
SELECT l.doc_id, max(CASE WHEN d.text IS NULL THEN 0 ELSE l.i END) AS n_lines, count(r.i) AS n_gone,
       CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE r.i IS NULL), '') END AS text
FROM l JOIN documents d USING (doc_id) LEFT JOIN r ON r.doc_id = l.doc_id AND r.i = l.i GROUP BY l.doc_id
"""
