"""What the second advice found: short and unspaced items, passages of one length class, keys beside harmless words, near copies without an id."""

import collections
import hashlib
import math
import random
import re

import pytest

from featherfold.llm.op1_decontaminate import drop_leaks, find_leaks, tokens
from featherfold.llm.op2_secrets import ALLOWED, CLASSES, KINDS, WHOLE, WORDS, find_secrets
from featherfold.llm.op9_jaccard import WordHashes, jaccard_components, keep_one, linked, shingle_set
from test_text_operators import PROSE, docs


def brute_entropy(text):
    """Spans of the entropy classes: windows of runs that are not harmless whole, but for those over a word."""
    spans = []
    for c in CLASSES:
        for m in re.finditer("[%s]{%d,}" % (c.pattern, c.window), text):
            run, merged = m.group(0), []
            if any(re.search(a, run) for a in WHOLE):
                continue
            held = [(k, k + len(w)) for w in WORDS for k in range(len(run)) if run[k : k + len(w)].lower() == w]
            for i in range(len(run) - c.window + 1):
                if any(a < i + c.window and i < b for a, b in held):
                    continue
                counts = collections.Counter(run[i : i + c.window]).values()
                if -sum(k / c.window * math.log2(k / c.window) for k in counts) >= c.bits - 1e-9:
                    if merged and merged[-1][1] >= i:
                        merged[-1][1] = i + c.window
                    else:
                        merged.append([i, i + c.window])
            spans += [(m.start() + a, KINDS.index(c.name), m.start() + b) for a, b in merged]
    return sorted(spans)


def test_secrets_beside_words(spark):
    rng = random.Random(5)
    key = "".join(rng.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 40))
    long_run = "".join(rng.choice(CLASSES[1].chars) for _ in range(30000))
    digits = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = {
        30: f"see /data/samples/{key} now", 31: f"sample_token_{key}", 32: f"{key}/EXAMPLE",
        33: long_run[:15000] + "xxxx" + long_run[15000:], 34: f"é 😀 {digits}0123456789{digits}",
        35: f"{key[:20]}example{key[20:]}", 36: "exampleXample" + key + "changemexample" + key, 37: f"{key}xxxxxx{key}",
        38: "550e8400-e29b-41d4-a716-446655440000", 39: key,
    }
    got = {}
    for r in find_secrets(docs(spark, [(i, t, "a") for i, t in texts.items()])).collect():
        told = [x.split(":") for x in r["spans"].split(",") if x.startswith("entropy")]
        got[r["doc_id"]] = sorted((int(a), KINDS.index(k), int(b)) for k, a, b in told)
    assert got == {i: brute_entropy(t) for i, t in texts.items()}
    lost = {i for i, t in texts.items() if re.search(ALLOWED[0], t)}  # none of these had entropy spans of base64 before
    assert lost == {30, 31, 32, 33, 34, 35, 36, 37}
    for i in (30, 31, 32, 36, 37):  # the key is covered whole
        a = texts[i].index(key)
        assert any(s <= a and a + 40 <= e for s, k, e in got[i] if KINDS[k] == "entropy_base64"), i
    assert sum(e - s for s, _, e in got[33]) > 29000 and not got[35] and not got[38]


def brute_groups(rows, n, percent):
    """Group number of each row: rows with one id or similar sets, rows without an id too."""
    hashes = WordHashes()
    sets = [set(shingle_set(t, n, hashes).tolist()) for _, t in rows]
    group, changed = list(range(len(rows))), True
    while changed:
        changed = False
        for a, (i, _) in enumerate(rows):
            for b, (j, _) in enumerate(rows):
                near = linked(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), percent) or i is not None and i == j
                if near and group[a] > group[b]:
                    group[a], changed = group[b], True
    return group


@pytest.mark.parametrize("block_size", [2, 256])
def test_jaccard_rows_without_an_id(spark, block_size):
    words = PROSE[4].split() + PROSE[5].split()

    def text(*changed):
        return " ".join(f"new{k}" if k in changed else w for k, w in enumerate(words))

    rows = [(None, PROSE[0] + " end"), (None, PROSE[0] + " fin"), (None, PROSE[0] + " fin"), (None, PROSE[1])]  # no id at all
    rows += [(40, text(3)), (None, text(3, 50)), (41, text(50, 51))]  # a chain over a row without an id
    rows += [(9, PROSE[2]), (9, PROSE[3]), (4, PROSE[2]), (5, PROSE[3])]  # an id that stands for neither of its texts
    rows += [(70, PROSE[6]), (None, PROSE[6] + " more")]
    rows += [(None, " ".join(PROSE[7].split()[k % 3 :])) for k in range(9)]
    found = brute_groups(rows, 4, 85)
    least = {g: min((i for k, (i, _) in zip(found, rows) if k == g and i is not None), default=None) for g in found}
    got = jaccard_components(docs(spark, [(i, t, "a") for i, t in rows]), 4, 85, block_size=block_size).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    want = [(i, hashlib.md5(t.encode()).hexdigest(), least[g]) for (i, t), g in zip(rows, found)]
    assert sorted([(r["id"], r["text_key"], r["component_id"]) for r in got], key=key) == sorted(want, key=key)
    kept = keep_one(docs(spark, [(i, t, "a") for i, t in rows]), 4, 85).collect()
    first = {}
    for (i, t), g in zip(rows, found):
        digest = hashlib.md5(t.encode()).hexdigest()
        first[g] = min(first.get(g, (True, 1 << 60, "~", "")), (i is None, i or 0, digest, t))
    assert sorted(r["text"] for r in kept) == sorted(f[3] for f in first.values()) and len(first) == 6


def leaks(table, bench):
    return sorted((r["id"], r["item_id"]) for r in find_leaks(table, bench).collect())


def test_leaks_of_short_and_unspaced_items(spark):
    assert tokens("Über_1 日本語 ไทย カナ한국") == ["über_1", "日", "本", "語", "ไ", "ท", "ย", "カ", "ナ", "한국"]
    han = "今天天气很好我们一起去公园散步看花"
    bench = spark.createDataFrame([(1, han), (2, "Forty, two zebras"), (3, None), (4, "zebras"), (5, "?!")], "item_id long, text string")
    table = docs(spark, [
        (1, "前言" + han + "。结束", "a"), (2, f"{PROSE[1]} forty two ZEBRAS {PROSE[2]}", "a"), (3, f"forty {PROSE[1]} two", "a"),
        (4, "今天我们看花", "a"), (5, None, "a"),
    ])
    assert leaks(table, bench) == [(1, 1), (2, 2), (2, 4)]
    assert leaks(table, bench.where("item_id in (2, 3)")) == [(2, 2)]
    assert sorted(r["doc_id"] for r in drop_leaks(table, bench).collect()) == [3, 4, 5]


def test_leaks_of_one_item_do_not_depend_on_the_length_of_another(spark):
    item = [f"q{k}" for k in range(15)]
    pieces = [item[k : k + 3] for k in range(0, 15, 2)]  # all word pairs, 300 words apart
    scattered = " ".join(" ".join([*p, *(f"f{k}x{j}" for j in range(300))]) for k, p in enumerate(pieces))
    long_item = [f"long{k}" for k in range(5000)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(long_item))], "item_id long, text string")
    table = docs(spark, [(1, scattered, "a"), (2, f"{PROSE[1]} {' '.join(item)} {PROSE[2]}", "a"), (3, " ".join([*PROSE, *long_item, *PROSE]), "a")])
    assert leaks(table, bench) == [(2, 1), (3, 2)]
