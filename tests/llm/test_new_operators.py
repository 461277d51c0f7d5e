"""Neighbours, whitening and conversation repair against brute force, with odd rows."""

import hashlib
import heapq
import math
import random

import numpy as np
import pytest

from featherfold.llm import op13_repair as op13
from featherfold.llm.op11_neighbours import Hashing, Queries, Best, nearest, search_block
from featherfold.llm.op12_whitening import count_above, fit_whitening, leading_eigenpairs, whiten

VECTORS = "vec_id long, embedding array<float>, label int, rank int, id long, vector string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in rows], VECTORS)


NAN, INF = float("nan"), float("inf")
ODD = [(700, None), (800, []), (900, [0.0] * 8), (1000, [1.0] * 7 + [None]), (1100, [1.0] * 7 + [NAN]), (1200, [INF] * 8), (1300, [1.0, 2.0])]


def cloud(n, d, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype("f4")
    x[: n // 3] = x[0]  # a third are copies
    return x


def brute_nearest(ids, x, k=10):
    x, out = x.astype(float), []
    for i, q in zip(ids, x):
        if i % 100 == 0:
            far = np.sqrt(((x - q) ** 2).sum(axis=1))
            best = sorted((f, int(j)) for f, j in zip(far, ids) if j != i)[:k]
            out += [(int(i), r + 1, j, f) for r, (f, j) in enumerate(best)]
    return out


@pytest.mark.parametrize("how", [Hashing(), Hashing(block=64, sample=50, chunk=3)])
def test_nearest_finds_the_true_neighbours(spark, how):
    x = cloud(900, 8)
    table = vectors(spark, [*zip(range(900), x.tolist()), *[(2000 + i, v) for i, v in ODD], (None, [1.0] * 8)]).repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(table, how=how).collect())
    want = sorted(brute_nearest(range(900), x))
    assert len(got) == len(want) == 90
    hits = {(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in got}
    assert len(hits) >= 0.99 * len(want)
    assert got == want or hits < {(q, i) for q, _, i, _ in want}


def test_nearest_of_few_rows_and_repeats(spark):
    few = vectors(spark, [(0, [1.0, 0.0]), (5, [0.0, 2.0]), (100, [1.0, 0.0]), (0, [1.0, 0.0])])
    got = [tuple(r) for r in nearest(few).orderBy("query_id", "rank").collect()]
    assert got[:2] == [(0, 1, 100, 0.0), (0, 2, 5, math.sqrt(5.0))] and [g[2] for g in got[2:]] == [0, 0, 5]
    assert nearest(few.limit(0)).count() == 0 and nearest(few.where("vec_id = 5")).count() == 0


def test_far_vectors_are_not_verified():
    """Windows, not all rows, decide what is compared: a cluster far from the query stays unverified."""
    how, rng = Hashing(), np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((100, 16)), rng.standard_normal((900, 16)) + 60])
    keys = (x @ how.directions(16)).T.astype("<f4")
    order = np.argsort(keys, axis=1)
    q = x[:1] + 0.01
    asked = Queries(np.array([-1]), q, q @ how.directions(16), np.array([8.0]))
    best = Best(asked, 10)
    seen = search_block(np.arange(1000), x, np.take_along_axis(keys, order, axis=1), order.astype("<u2"), asked, best, how)
    assert seen <= 200
    assert [i for _, i in best.rows[0]] == [int(i) for i in np.argsort(((x - q) ** 2).sum(axis=1))[:10]]


@pytest.mark.parametrize(
    "a",
    [np.diag([3.0, 3, 3, 2, 2, 1, 0, 0]), np.eye(40), np.ones((5, 5)), np.cov(cloud(300, 24).T), np.diag(2.0 ** -np.arange(50)),
     np.diag([1.0, 1 + 1e-15, 1 - 1e-15, 0.5])],
)
def test_eigenpairs_by_slicing(a):
    values, rows = leading_eigenpairs(a, 32)
    true = np.linalg.eigvalsh(a)[::-1]
    assert np.allclose(values, true[: len(values)], rtol=1e-12, atol=1e-14 * true[0])
    assert len(values) == min(32, int((true > 1e-12 * true[0]).sum()))
    assert np.allclose(rows @ rows.T, np.eye(len(values)), atol=1e-12)
    assert np.abs(a @ rows.T - rows.T * values).max() <= 1e-13 * true[0]


def test_inertia_counts():
    rng = np.random.default_rng(5)
    for d in (1, 2, 7, 30):
        b = rng.standard_normal((d, d))
        a = b + b.T
        a[np.diag_indices(d)] = 0  # needs 2x2 pivots
        true = np.linalg.eigvalsh(a)
        for shift in rng.uniform(-3, 3, 20):
            assert count_above(a, shift) == int((true > shift).sum())


def test_whitening(spark):
    x = cloud(400, 8) * np.array([9, 7, 5, 3, 2, 1, 1, 0], "f4") + 1000  # the last is constant
    table = vectors(spark, [*zip(range(400), x.tolist()), *[(i, v) for i, v in ODD if i != 900], (7, x[7].tolist()), (None, x[8].tolist())]).repartition(3)
    got = whiten(table).toPandas()
    rows = np.vstack([x, x[7:9]])
    whole = np.floor(64 * rows.astype(float)) + 1000000
    n, off = len(rows), whole - whole.mean(axis=0)
    values, vectors_ = np.linalg.eigh(off.T @ off / n)
    assert len(got) == n * 7 and set(got["n"]) == {n}
    explained = got.groupby("component")["explained"].first().values
    assert np.allclose(explained, values[::-1][:7] / values.sum(), rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    own = got[got["vec_id"] == 3].sort_values("component")["whitened"].values
    want = off[3] @ vectors_[:, ::-1][:, :7] / np.sqrt(values[::-1][:7])
    assert np.allclose(np.abs(own), np.abs(want), atol=1e-8)
    ints = [[int(v) for v in r] for r in whole]
    sums = [sum(c) for c in zip(*ints)]
    assert got[got["vec_id"] == 3]["deviation"].iloc[0] == sum((n * v - s) ** 2 for v, s in zip(ints[3], sums))


def test_whitening_is_exact_and_defined_at_the_edges(spark):
    one = vectors(spark, [(1, [1.0, 2.0])])
    assert whiten(one).count() == 0 and whiten(one.limit(0)).count() == 0 and whiten(one.union(one)).count() == 0
    assert whiten(one.limit(0)).columns == whiten(one).columns
    far = vectors(spark, [(1, [1e16, 0.0]), (2, [0.0, 1.0]), (3, [-1e16, 4.0]), (4, [3e38, 0.0])])
    f = fit_whitening(far)
    assert f.n == 3 and f.values[0] == pytest.approx((64e16) ** 2 * 2 / 3, rel=1e-6)
    assert [r["deviation"] for r in whiten(far).where("component = 1").orderBy("vec_id").collect()] == [None, 16384, None]
    a, b = [[r for r in whiten(far.repartition(p)).orderBy("vec_id", "component").collect()] for p in (1, 3)]
    assert a == b


# --- conversations --------------------------------------------------------------------------------------


def cheapest(letters):
    """Dijkstra over (cost, edits)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if i == len(letters) and q in (0, 3):
            return cost, audit
        if (i, q) in done:
            continue
        done.add((i, q))
        then = 3 if q == 2 else 2
        out = [(5, "I", i, then)]
        if i < len(letters):
            c = letters[i].lower()
            more = 5 if letters[i].isupper() else 0
            out.append((2, "D", i + 1, q))
            if c != "-":
                out.append((1 + more, "R", i + 1, then))
                if c == "s" and q == 0:
                    out.append((more, "K", i + 1, 1))
                if c == ("a" if q == 2 else "u"):
                    out.append((more, "K", i + 1, then))
        for add, letter, j, p in out:
            heapq.heappush(heap, (cost + add, audit + letter, j, p))


def test_auction_gives_the_least_cheapest_edits():
    rng = random.Random(4)
    for _ in range(1500):
        letters = "".join(rng.choice("suaxSUA-uauaua") for _ in range(rng.randrange(0, 14)))
        assert op13.repair(letters) == cheapest(letters), letters


def test_pieces_give_the_same_as_whole():
    rng = random.Random(5)
    for _ in range(300):
        letters = "".join(rng.choice("suaxSUA-uauaua") for _ in range(rng.randrange(3, 16)))
        cuts = [0, *sorted(rng.sample(range(1, len(letters)), 2)), len(letters)]
        pieces = [letters[a:b] for a, b in zip(cuts, cuts[1:])]
        state, audit = 0, ""
        for piece, after in zip(pieces, op13.piece_prices([op13.transfer(p) for p in pieces])):
            edits, state = op13.Lattice(piece, after).trace(state)
            audit += edits
        assert audit == op13.repair(letters)[1], letters


def expected(rows):
    """Brute force for the rows (turn, role, text) of one conversation in order."""
    letters, kinds, seen = "", [], set()
    for _, role, text in rows:
        held = [c for c in text if c not in " \t\n\v\f\r"]
        kind = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else "none"
        seen.add((role, text))
        kinds.append(kind)
        code = role[:1] if role[:1] in ("s", "u", "a") and role[:1] else "x"
        letters += "-" if kind in ("blank", "duplicate") else code.upper() if kind == "truncated" else code
    cost, audit = cheapest(letters)
    out, at, user = [], 0, True
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "I":
            out.append(("user" if user else "assistant") + ":")
        else:
            _, role, text = rows[at]
            at += 1
            if edit == "K" and role[:1] == "s":
                out.append(f"{role}:{text}")
                continue
            out.append((role if edit == "K" else "user" if user else "assistant") + ":" + text)
        user = not user
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *[kinds.count(k) for k in op13.KINDS], illegal, cost, audit, digest)


def test_repair_of_conversations(spark, monkeypatch):
    monkeypatch.setattr(op13, "BLOCK_BITS", 3)  # blocks of eight rows, so that conversations lie in several
    rng = random.Random(6)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "line ", "Ends here. \t", "long " * 3000 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "user", "assistant"]), rng.choice(texts), 1, "k") for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"Turn {t}.", 1, "k") for t in range(90) if t % 11]
    rows += [(101, None, "user", "Late.", 1, "k"), (101, 4, "assistant", "Four.", 1, "k"), (101, 4, "assistant", "Four.", 1, "k"), (101, 9, "user", "Nine.", 1, "k")]
    rows += [(None, None, None, None, 1, "k"), (None, 2, "user", "No home.", 1, "k"), (102, 1, "", "No role.", 1, "k")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int, letter string").repartition(6)
    ids = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {555}], "conv_id long")
    got = {r[0]: tuple(r)[1:] for r in op13.repair_conversations(table, ids).collect()}
    assert set(got) == {r[0] for r in rows} | {555}
    for conv in got:
        own = [(t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x, *_ in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        assert got[conv] == expected(own), conv
    assert op13.repair_conversations(table.limit(0)).count() == 0


def test_damage_follows_the_digest(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(5)] + [(None, 1, None, None), (7, None, "user", "x")]
    got = op13.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(fault, text)
        want += [(c, t, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    key = lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
