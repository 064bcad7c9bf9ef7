"""Personal data: base rules against plain patterns, learned identifiers against a plain bootstrapping, planted cases."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from mirador.llm import private as p

SCHEMA = "doc_id long, text string, kind string, row string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card":
                odd = [int(d) for d in digits[-1::-2]]
                even = [2 * int(d) - 9 * (int(d) > 4) for d in digits[-2::-2]]
                if not 14 <= len(digits) <= 19 or (sum(odd) + sum(even)) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("letters", ["a1.@-", "12. -+()", "a.@b_%", "0123456789 -", "25.0 1", "é1@.x+ "])
def test_base_rules_are_the_plain_patterns(letters):
    rng = random.Random(letters)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert p.base_spans(text) == plain(text), text


def test_cards():
    texts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "x378282246310005y", "30569309025904", "3056930902590", "6304000000000000000", "1" * 25]
    assert [p.base_spans(t) for t in texts] == [plain(t) for t in texts]
    assert [bool(p.base_spans(t)) for t in texts] == [True, False, True, True, False, True, False]


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "1 " * 200_000, "@" * 400_000, "a@" * 200_000, "+1" * 200_000, "a1" * 200_000, "(" * 400_000, "1:" * 200_000, "a@b" * 130_000, "+1" + "(" * 400_000])
def test_linear_time(text):
    began = time.time()
    p.mentions_of(text)
    assert time.time() - began < 8


def report(spark, texts):
    rows = p.private_spans(spark.createDataFrame([(i, t, "a", "b") for i, t in texts], SCHEMA)).collect()
    return {r.doc_id: ([(s.start, s.kind, s.end) for s in r.base], [(s.start, s.kind, s.end) for s in r.spans]) for r in rows}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéf") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed=3):
    """Texts with cues, known and unseen identifiers after them, and numbers elsewhere: {id: (text, [unseen])}"""
    rng, out = random.Random(seed), {}
    for i in range(60):
        text, unseen = words(rng, 20), []
        if i < 30:
            text += f" Phone: +1 (555) 010-{1000 + i} " + words(rng, 5)
        elif i < 40:
            hidden = f"0{i}-7{i}-99{i}"
            text += " phone: " + hidden + ". " + words(rng, 5)
            unseen = [hidden]
        elif i < 50:
            text += " born in 19" + str(i) + " " + words(rng, 5)
        elif i < 55:
            text += " born in +49 30 901820" + str(i) + " " + words(rng, 5)
        else:
            text += " call " + f"0{i - 25}-7{i - 25}-99{i - 25} " + words(rng, 3)
            unseen = [f"0{i - 25}-7{i - 25}-99{i - 25}"]
        out[i] = (text, unseen)
    return out


def test_unseen_identifiers_are_learned_and_others_left_alone(spark):
    texts = corpus()
    got = report(spark, [(i, t) for i, (t, _) in texts.items()])
    for i, (text, unseen) in texts.items():
        base, spans = got[i]
        assert base == plain(text)
        more = [text[a:b] for a, k, b in spans if (a, k, b) not in base]
        assert more == unseen, (i, more)
        assert all(k == p.KINDS.index("phone") for a, k, b in spans if (a, k, b) not in base)


def bootstrapped(texts):
    """Instances learned, by loops over words and dictionaries."""
    contexts, edges, kinds = Counter(), defaultdict(Counter), {}
    for text in texts:
        cut = re.sub("([:=#])", r"\1 ", text).translate(p._LOWER)
        parts = re.findall(r"[^ \t\n\x0b\x0c\r]+", cut)
        for i in range(len(parts) - 1):
            contexts[parts[i]] += 1
            if i:
                contexts[f"{parts[i - 1]} {parts[i]}"] += 1
        base = p.base_spans(text)
        found = [(k, a, b) for a, k, b in base] + [(None, a, b) for a, b in p.candidates(text, base)]
        for k, a, b in found:
            x = text[a:b].translate(p._LOWER)
            if k is not None:
                kinds[x] = min(k, kinds.get(x, 9))
            for c in p.patterns_before(text, a):
                edges[c][x] += 1
    known, seeds = dict(kinds), set(kinds)
    for _ in range(p.ROUNDS):
        belief = defaultdict(lambda: 1.0)
        for c, seen in edges.items():
            for kind in range(4):
                mine = [x for x in seen if known.get(x) == kind]
                if len(mine) < p.LEAST_SUPPORT:
                    continue
                hits, mentions, all_known = sum(seen[x] for x in mine), sum(seen.values()), sum(n for x, n in seen.items() if x in known)
                sure = hits / (max(contexts[c] - mentions, 0) + all_known + (mentions - all_known) / 2) * len(mine) / (len(mine) + 1)
                if sure >= p.LEAST_CONFIDENCE:
                    for x in seen:
                        if x not in known:
                            belief[x, kind] *= 1 - sure
        new = {}
        for (x, kind), left in sorted(belief.items(), key=lambda v: (round(v[1], 9), v[0][1])):
            if 1 - left >= p.LEAST_BELIEF:
                new.setdefault(x, kind)
        if not new:
            break
        known |= new
    return {x: k for x, k in known.items() if x not in seeds}


@pytest.mark.parametrize("seed", [4, 5])
def test_against_plain_bootstrapping(spark, seed):
    rng, texts = random.Random(seed), []
    for i in range(120):
        t = []
        for _ in range(rng.randint(0, 12)):
            cue = rng.choice(["mail:", "id=", "to", "the of", "card no", "tel.", "x"])
            thing = rng.choice([f"a{rng.randint(0, 9)}@b.cd", f"+1 555 010 {rng.randint(1000, 1009)}", f"{rng.randint(10, 40)}-{rng.randint(100, 110)}", "word", f"U{rng.randint(100, 130)}x", "10.0.0." + str(rng.randint(0, 9))])
            t.append(f"{cue} {thing}" if rng.random() < 0.8 else f"{cue}{thing}")
        texts.append(" ".join(t))
    df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], SCHEMA)
    learned = p.learn(df, p.search(df))
    got = {r["instance"]: r["kind"] for r in learned[0].collect()} if learned else {}
    assert got == bootstrapped(texts)


def test_a_pattern_counts_wherever_it_stands(spark):
    rng = random.Random(9)
    rows = [(i, f"{words(rng, 5)} ref: +1 555 010 {1000 + i} {words(rng, 2)}") for i in range(10)] + [(20 + i, f"{words(rng, 4)} ref: plain words") for i in range(40)] + [(70, "see ref: 77-88-99 x")]
    assert all(not [s for s in spans if s not in base] for base, spans in report(spark, rows).values())


def test_as_many_unseen_as_known(spark):
    rng = random.Random(12)
    rows = [(i, f"{words(rng, 6)} contact line: +1 555 010 {1000 + i} {words(rng, 2)}") for i in range(6)] + [(20 + i, f"{words(rng, 6)} contact line: 5{i}.77.1{i}") for i in range(6)]
    got = report(spark, rows)
    assert all([t[a:b] for a, _, b in got[i][1] if (a, 3, b) not in got[i][0]] == ([t.split()[-1]] if i >= 20 else []) for i, t in rows)


def test_edge_cases(spark):
    assert p.private_spans(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a@b.cd"), (None, "a@b.cd"), (1, None), (1, ""), (2, "x" * 200_000 + " a@b.cd")]
    got = sorted((str(r.doc_id), [(s.start, s.end) for s in r.spans]) for r in p.private_spans(spark.createDataFrame([(*x, "", "") for x in rows], SCHEMA)).collect())
    assert got == [("1", []), ("1", []), ("2", [(200_001, 200_007)]), ("None", [(0, 6)]), ("None", [(0, 6)])]


def test_words_before():
    assert p.patterns_before("My Phone: (5", 11) == ["phone:", "my phone:"]
    assert p.patterns_before("tel=5", 4) == ["tel="] and p.patterns_before("tel5", 3) == [] and p.patterns_before("5", 0) == []
    assert p.patterns_before("y" * 70 + " 5", 71) == [] and p.patterns_before("y" * 70 + " b 5", 73) == ["b"]


def test_query(spark):
    got = p.op12_pii(spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    names, want = list(PLAIN), []
    for r in docs:
        said = [f"{names[k]}:{a}:{b}" for a, k, b in plain(r.text or "")]
        want.append((str(r.doc_id), *(sum(x.startswith(f"{k}:") for x in said) for k in names), hashlib.sha256(",".join(said).encode()).hexdigest(), said))
    rows = got.collect()
    assert sorted((str(r.doc_id), *(r[f"n_{k}"] for k in names), r.base_sha256) for r in rows) == sorted(w[:-1] for w in want)
    spans = defaultdict(set)
    for r in rows:
        spans[str(r.doc_id), r.base_sha256] |= set(r.spans.split(","))
    assert all(set(w[-1]) <= spans[w[0], w[-2]] for w in want)
