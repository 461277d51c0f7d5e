"""Operators that SQL cannot express against plain versions of their rules, written apart from their code."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import regex

from featherfold.llm import op1_decontaminate as op1
from featherfold.llm import op3_licenses as op3
from featherfold.llm import op5_quality as op5
from featherfold.llm import op8_lines as op8
from featherfold.llm.op9_jaccard import jaccard_components

DOCS = "doc_id long, text string"
RNG = random.Random(8)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "so", "ti", "vo") for b in ("ra", "bel", "din", "gor", "hum", "jat", "pes", "wix")]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


# --- 1: BM25 and overlap ---------------------------------------------------------------------------------


def weights_of(items):
    """Item id to {word: BM25 weight}, over all items."""
    tokens = {i: re.findall(r"\w+", t.lower()) for i, t in items}
    mean = sum(map(len, tokens.values())) / len(tokens)
    often = collections.Counter(w for ws in tokens.values() for w in set(ws))
    out = {}
    for i, ws in tokens.items():
        norm = 1.2 * (0.25 + 0.75 * len(ws) / mean)
        out[i] = {w: math.log(1 + (len(tokens) - often[w] + 0.5) / (often[w] + 0.5)) * ws.count(w) * 2.2 / (ws.count(w) + norm) for w in set(ws)}
    return tokens, out


def test_block_max_wand_equals_exhaustive_scores():
    items = [(i, prose(RNG.randrange(6, 40))) for i in range(300)]
    tokens, weights = weights_of(items)
    often = collections.Counter(w for ws in tokens.values() for w in set(ws))
    mean = sum(map(len, tokens.values())) / len(tokens)
    index = op1.Index.build([op1.Item(i, ws[:-2], ws[-2:]) for i, ws in tokens.items()], often, len(items), mean, 64)
    hits = 0
    for _ in range(200):
        terms = RNG.sample(range(len(index.ids)), RNG.randrange(1, 40))
        named = {w for w, t in index.ids.items() if t in terms}
        for threshold in (0.2, 0.6):
            want = {i: sum(x for w, x in ws.items() if w in named) / sum(ws.values()) for i, ws in weights.items()}
            alive = set(range(index.blocks.shape[1]))
            got = dict(op1.block_max_wand(index, sorted(terms), alive, threshold))
            clear = {i: s for i, s in want.items() if abs(s - threshold) > 1e-9}
            assert {i for i in got if i in clear} == {i for i, s in clear.items() if s > threshold}
            assert all(s == pytest.approx(want[i]) for i, s in got.items())
            hits += len(got)
    assert hits > 1000


def test_leaks_equal_exhaustive_search(spark):
    items = [(i, prose(RNG.randrange(8, 50))) for i in range(40)]
    tokens, weights = weights_of(items)
    rows = []
    for d in range(60):
        text = prose(RNG.randrange(0, 400)).split()
        for i in RNG.sample(range(40), RNG.randrange(0, 3)):
            own = items[i][1].split()
            for k in RNG.sample(range(len(own)), RNG.randrange(0, len(own) // 3 + 1)):
                own[k] = RNG.choice(WORDS)
            at = RNG.randrange(0, len(text) + 1)
            text[at:at] = own
        rows.append((d, " ".join(text)))

    def pairs(ws):
        return set(zip(ws, ws[1:])) if len(ws) > 1 else {tuple(ws)}

    def share(part, passage):
        held, bare = pairs(passage), set(passage)
        return sum(g in held if len(g) == 2 else bare.issuperset(g) for g in pairs(part)) / len(pairs(part))

    want = set()
    for d, text in rows:
        ws = re.findall(r"\w+", text.lower())
        for start in range(0, max(1, len(ws) - 64 if len(ws) > 64 else 1), 64):
            passage = ws[start : start + 128]
            for i, own in weights.items():
                if sum(x for w, x in own.items() if w in set(passage)) / sum(own.values()) >= 0.6:
                    cut = len(tokens[i]) - max(1, len(tokens[i]) // 3)
                    if min(share(tokens[i][:cut], passage), share(tokens[i][cut:], passage)) >= 0.7:
                        want.add((d, i))
    bench = spark.createDataFrame([(i, t, "x", 1.0) for i, t in items], "item_id long, text string, doc_id string, score double")
    got = {(r["id"], r["item_id"]) for r in op1.find_leaks(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got == want and len(want) > 20


# --- 3: canonical licence texts ----------------------------------------------------------------------------


def canonical(line):
    low = line.lower()
    if regex.match(r"[^\p{L}\p{N}©]*(?:copyright[\s:]*(?:\(c\)|©|[0-9]{4}|<|\[)|\(c\)|©|all rights reserved[^\p{L}\p{N}]*$)", low):
        return ""
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", low).strip().split(" ")
    for one, other in op3.SPELLINGS.items():
        words = [other if w == one else w for w in words]
    return " ".join(words).strip()


def test_licences_equal_a_plain_lookup(spark):
    forms = [" ".join(c for c in map(canonical, t.split("\n")) if c) for _, t in op3.KNOWN]
    known = {}
    for (i, _), form in zip(op3.KNOWN, forms):
        known.setdefault(form, i)

    def damaged(text):
        kind = RNG.randrange(5)
        if kind == 0:
            return text.upper()
        if kind == 1:
            return text.replace(" ", "  ").replace(",", " ;")
        if kind == 2:
            return "(c) 2001 Someone\n© Another\nAll rights reserved.\n" + text
        if kind == 3:
            return text.replace("icense", "icence")
        return text + " and more"

    rows = []
    for d in range(120):
        text = damaged(RNG.choice(op3.KNOWN)[1]) if d % 2 else "\r\n".join([prose(5), damaged(RNG.choice(op3.KNOWN[5:])[1]), "", prose(4)])
        rows.append((d, text))
    want = set()
    for d, text in rows:
        lines = [canonical(x) for x in re.split(r"\r\n|\n|\r", text)]
        whole = " ".join(x for x in lines if x)
        want.add((d, 0, hashlib.sha256(whole.encode()).hexdigest(), known.get(whole) if whole else None))
        want |= {(d, n, hashlib.sha256(x.encode()).hexdigest(), known[x]) for n, x in enumerate(lines, 1) if x and x in known}
    got = {tuple(r) for r in op3.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and sum(w[3] is not None for w in want) > 60


# --- 5: the network as plain loops --------------------------------------------------------------------------


def plain_probability(net, data):
    size, halves = len(data), max(1, -(-len(data) // op5.HALF))
    padded = data.ljust(halves * op5.HALF, b"\0")
    found = {}
    for place in range(0, len(padded), op5.STEP):
        value = net.bias.astype(float).copy()
        for side in (0, 1):
            part = padded[place + side * op5.STEP : place + (side + 1) * op5.STEP]
            if part:
                value += net.embed[list(part)].ravel().astype(float) @ net.filters[side]
        found[place] = np.maximum(value, 0) if place < size else np.zeros_like(value)
    spans = [(0, op5.HALF)] if halves == 1 else [(c * op5.HALF, (c + 2) * op5.HALF) for c in range(halves - 1)]
    units = []
    for low, high in spans:
        chunk = np.max([found[p] for p in range(low, high, op5.STEP)], axis=0)
        units.append(np.maximum(chunk @ net.hidden + net.hidden_bias, 0))
    z = np.concatenate([np.max(units, axis=0), np.mean(units, axis=0)]) @ net.out + net.out_bias[0]
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_plain_convolution():
    net = op5.Net.fresh(3)
    net.bias[:] = np.linspace(-0.3, 0.3, len(net.bias))
    net.out_bias[0] = 0.2
    texts = ["", "a", "é" * 64, "x" * 127, "y" * 128, "z" * 129, prose(30), prose(300), "ünï " * 500, prose(90_000 // 5)]
    for text, got in zip(texts, op5.score(net, texts)):
        assert got == pytest.approx(plain_probability(net, text.encode()), rel=2e-4, abs=2e-5)
    long = prose(60_000)
    assert len(long) > 4 * (1 << 16)
    assert op5.score(net, [long])[0] == pytest.approx(plain_probability(net, long.encode()), rel=2e-4, abs=2e-5)


# --- 8: the line rules ---------------------------------------------------------------------------------------


def plain_line_fails(line, rules):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n, letters = len(words), [c for c in line if c.isalpha()]
    ended = line.rstrip().rstrip("\"'”’»)]}")[-1:] in (".", "!", "?", "…", ":", ";", "。", "！", "？")
    if n < rules.prose_words and not (ended and line.rstrip()):
        return True
    if sum(c in "#*$%&|<>" for c in line) > rules.symbols_per_word * n:
        return True
    kinds = len(set(words))
    if n >= rules.repeat_words and kinds < rules.distinct * n and kinds < rules.varied_words:
        return True
    upper = sum(c.isupper() for c in line)
    if n >= rules.judged_words and 2 * upper > n and upper > rules.capitals * len(letters):
        return True
    if n <= rules.navigation_words and op8.NAVIGATION.match(line):
        return True
    return bool(n <= rules.boilerplate_words and op8.BOILERPLATE.search(line))


@pytest.mark.parametrize("rules", [op8.LineRules(), op8.LineRules(varied_words=3, navigation_words=0, boilerplate_words=0, lost=0.2)])
def test_line_rules_equal_plain_rules(spark, rules):
    def line():
        kind = RNG.randrange(9)
        text = prose(RNG.randrange(1, 40))
        return [text, text + ".", text.upper() + "!", " ".join([RNG.choice(WORDS)] * RNG.randrange(8, 90)) + ".", text + " |#|*<> .", "Home.", "Next", "We use cookies. " + text + ".", " \t"][kind]

    rows = [(d, "\n".join(line() for _ in range(RNG.randrange(0, 12)))) for d in range(150)]
    got = {r["doc_id"]: r for r in op8.clean_lines(spark.createDataFrame(rows, DOCS), rules).collect()}
    verdicts = collections.Counter()
    for d, text in rows:
        held = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        bad = [x for x in held if plain_line_fails(x, rules)]
        lost = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in bad)
        r = got[d]
        assert (r["n_lines"], r["lost_words"]) == (len(held), lost)
        assert r["clean_text"] == "\n".join(x for x in held if not plain_line_fails(x, rules))
        assert r["kept"] == (not r["base_failed"] and lost <= rules.lost * r["n_words"])
        verdicts[r["kept"]] += 1
    assert min(verdicts.values()) > 5


def test_repeated_windows_of_long_texts():
    for n in (9, 100, 5000):
        words = [w.encode() for w in prose(n).split()]
        words += words[: n // 4] + [b"x"] + words[n // 2 : n // 2 + 9] + [b"same"] * 30
        grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = collections.Counter(grams)
        want = len({k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(8)})
        assert op8.repeated_words_long(words) == op8.repeated_words(words) == want
    assert op8.repeated_words_long([str(i).encode() for i in range(5000)]) == 0


# --- 9: sets of word tuples ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (1, 50)])
def test_components_equal_those_of_word_tuples(spark, n, percent):
    seeds = [prose(RNG.randrange(3, 60)).split() for _ in range(12)]
    rows = []
    for d in range(150):
        words = list(RNG.choice(seeds))
        for _ in range(RNG.choice([0, 0, 1, 1, 2, 5])):
            words[RNG.randrange(len(words))] = RNG.choice(WORDS)
        text = RNG.choice([" ", "\n", " \t "]).join(words)
        rows.append((d * 3 + 1, text.upper() if d % 5 == 0 else text))
    rows += [(1000, ""), (1001, None), (1002, "one two"), (1003, "ONE\ttwo"), (1004, "one two three four")]

    def shingles(text):
        words = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()

    sets = {d: shingles(t) for d, t in rows}
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(a), root(b)))
            group[b] = a
    want = sorted((d, len(s), root(d)) for d, s in sets.items())
    got = sorted((r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, DOCS), n, percent).collect())
    assert got == want and len({w[2] for w in want}) < len(want) - 20
