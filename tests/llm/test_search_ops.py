"""Operators 11 to 13 against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

# ------------------------------------------------------------ 11: prefix trie


def brute_trie(rows):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v, key=lambda z: z[0])] for c, v in conv.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, children, sums, out = {}, {}, {}, []
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members.setdefault(tuple(rebuilt[c][:d]), []).append(c)
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(sums[k][0] for k in kids) or 1, own_saved + sum(sums[k][1] for k in kids))
        ends = ",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids), *sums[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations(rng, n):
    rows = []
    for c in range(n):
        for turn in range(rng.randint(0, 14)):
            rows.append((c, None if turn == 0 and c % 4 == 0 else turn, rng.choice(["user", "assistant", None]),
                         rng.choice(["a", "bé", "", None, "long text " * 50])))
    rows += [(100, t, "user", f"deep {t}") for t in range(60)]          # one deep conversation
    rows += [(c, t, "user", f"copy {t}") for c in range(200, 300, 5) for t in range(9)]  # many copies
    return rows + [(-7, 1, "user", "negative id"), (None, 1, "user", "no id")]


_CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("local", [1 << 14, 4])
def test_trie(spark, monkeypatch, local):
    from tessera.llm import prefix_trie as P
    monkeypatch.setattr(P, "LOCAL", local)  # with 4, nearly all is split by joins
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "IDS", 3)
    rows = conversations(random.Random(local), 40)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, _CONV).selectExpr("*", "1 AS depth", "2 AS c")  # clashing names
    got = sorted((tuple(r) for r in P.trie(df).collect()), key=lambda r: r[:2])
    assert got == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    from tessera.llm.prefix_trie import trie
    assert trie(spark.createDataFrame([], _CONV)).count() == 0
    # Repeated rows count as turns; null turns come first; a turn number held
    # twice is ordered the same way in every conversation.
    rows = [(5, 1, "u", "x")] * 2 + [(5, None, None, None), (10, 2, "u", "b"), (10, 2, "u", "a"), (15, 2, "u", "a"), (15, 2, "u", "b")]
    got = trie(spark.createDataFrame(rows, _CONV)).collect()
    assert sum(r.n_convs for r in got if r.depth == 0) == 3
    assert max(r.depth for r in got if r.conv_id == 5) == 3
    assert {r.n_convs for r in got if r.conv_id == 10 and r.depth} == {2}


def test_centroid_splits_are_balanced_and_exact():
    from tessera.llm.prefix_trie import split_components
    rng = random.Random(3)
    for n in (1, 2, 50, 400):
        for shape in (lambda i: i - 1, lambda i: rng.randrange(i), lambda i: 0):  # chain, random, star
            parent = [-1] + [shape(i) for i in range(1, n)]
            a, b = [rng.randrange(5) for _ in parent], [rng.randrange(9) for _ in parent]
            weight, ea, eb = [1] * n, list(a), list(b)
            for i in range(n - 1, 0, -1):
                weight[parent[i]] += weight[i]
                ea[parent[i]] += ea[i]
                eb[parent[i]] += eb[i]
            assert split_components([0], parent, weight, a, b) == (ea, eb)


# ----------------------------------------------------------- 12: NN-descent


def brute_links(ids, vecs):
    unit = {}
    for k, v in enumerate(vecs):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(np.float64)
            unit[k] = x / np.linalg.norm(x)
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    degree = Counter()
    for i in unit:
        for j in unit:
            if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                degree[i] += 1
                up[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((ids[k], degree[k], least.get(find(k))) for k in range(len(ids))), key=repr)


def embeddings(rng, n, dim=24):
    out = []
    for k in range(n):
        v = rng.normal(size=dim)
        out.append(v)
        spread = [0.02, 0.1, 0.25, 0.4][k % 4]   # from near copies to pairs about the threshold
        out += [v + spread * rng.normal(size=dim) for _ in range(rng.integers(0, 6))]
    big = rng.normal(size=dim)
    out += [big + 0.05 * rng.normal(size=dim) for _ in range(150)]
    chain = rng.normal(size=(2, dim))
    out += [math.cos(a) * chain[0] + math.sin(a) * chain[1] for a in np.linspace(0, 3, 40)]
    return [[float(np.float32(x)) for x in v] for v in out]


@pytest.mark.parametrize("cell", [2048, 40])
def test_nn_descent(spark, monkeypatch, cell):
    """In one cell the result is exact; with cells of 40 the cluster of 150 and
    the chain are split, and meet again by merged balls and refinement."""
    from tessera.llm import nn_descent as N
    monkeypatch.setattr(N, "CELL", cell)
    vecs = embeddings(np.random.default_rng(cell), 120)
    vecs += [vecs[0], vecs[0], [2 * x for x in vecs[0]]]  # repeated vectors, another length of the vector
    vecs += [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None] * 12, [1.0, 2.0], [2.0, 4.0]]
    ids = list(range(1000, 1000 + len(vecs)))
    df = spark.createDataFrame(list(zip(ids, vecs, [1] * len(ids), [0] * len(ids))), "vec_id long, embedding array<float>, key int, n_links int")
    got = {r.vec_id: r for r in N.near_duplicates(df).collect()}
    exact = brute_links(ids, vecs)
    assert len(got) == len(ids) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    if cell == 2048:
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.values()), key=repr) == exact
    assert all(got[i].n_links <= n and got[i].component_id >= c for i, n, c in exact)  # no link below the threshold
    assert sum(got[i].n_links for i, _, _ in exact) >= 0.98 * sum(n for _, n, _ in exact)
    # A component found is part of one of the true ones.
    true = {i: c for i, _, c in exact}
    assert all(true[r.component_id] == true[i] for i, r in got.items())


def test_nn_descent_of_odd_tables(spark):
    from tessera.llm.nn_descent import near_duplicates
    schema = "vec_id long, embedding array<float>"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.01]), (2, [0.0, 1.0]), (9, None)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(3, 2, 3, True), (3, 2, 3, True), (None, 2, 3, False), (2, 0, 2, True), (9, 0, 9, True)], key=repr)


# ------------------------------------------------------- 13: lexical search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k):
    bags = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, bag, n in bags:
            if n:
                m = 25 + 75 * n * n_docs // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in terms(text) if t in bag)
                if s > 0:
                    found.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def test_lexical_search(spark, monkeypatch):
    from tessera.llm import lexical_search as S
    monkeypatch.setattr(S, "SEED", 50)
    monkeypatch.setattr(S, "BUCKET_ROWS", 16)
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(80)] + ["École", "Straße", "ÀB", "x1"]
    weights = [1 / (i + 1) for i in range(len(voc))]
    docs = [(i, " ".join(rng.choices(voc, weights, k=rng.randint(1, 80)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(None, docs[3][1]), (5, docs[5][1]), (7000, None), (7001, " ., "), (7002, "W1 " * 30000)]
    items = [(f"q{i}", " ".join(rng.choices(voc, k=rng.randint(1, 12)))) for i in range(25)] + [("none", None), ("new", "unseen"), ("big", " ".join(voc * 3))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS score")
    b = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 AS doc_id", "2 AS q")
    got = sorted((tuple(r) for r in S.rank(d, b).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == brute_search(docs, items, 10)
    monkeypatch.setattr(S, "BLOCK_TERMS", 40)  # several blocks of items
    assert sorted((tuple(r) for r in S.rank(d, b).select("item_id", "rank", "doc_id", "score").collect()), key=repr) == got


def test_lexical_search_of_nothing(spark):
    from tessera.llm.lexical_search import rank
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a")], "item_id string, text string")
    assert rank(docs.limit(0), items).count() == 0
    assert rank(docs, items.limit(0)).count() == 0
    assert rank(docs.where("doc_id = 1"), items).count() == 1


def test_lexical_search_prunes():
    """Buckets of short vectors are dropped, and inside a bucket most pairs."""
    from tessera.llm import lexical_search as S
    rng = np.random.default_rng(1)
    n, voc = 2000, 300
    many = rng.integers(1, 40, n)
    term = np.concatenate([np.sort(rng.choice(voc, m, replace=False)) for m in many])
    impact = rng.integers(1, 1_000_000, len(term))
    weight = rng.integers(1, 9000, voc)
    cut = np.concatenate([[0], np.cumsum(many)])
    size = np.array([np.sqrt((impact[a:b].astype(float) ** 2 * weight[term[a:b]]).sum()) for a, b in zip(cut, cut[1:])])
    q, t = np.repeat(np.arange(5), 10), np.concatenate([rng.choice(voc, 10, replace=False) for _ in range(5)])
    items = S.Items(q, t, np.ones(50, np.int64), weight, {})
    top, scored = S.Top(items, 10), 0
    order = np.argsort(-size)
    for lo in range(0, n, 250):
        rows = order[lo:lo + 250]
        at = np.concatenate([np.arange(cut[r], cut[r + 1]) for r in rows])
        scored += S.search_bucket(items, top, rows.tolist(), size[rows], many[rows], term[at], impact[at])
    assert scored < 0.2 * 5 * n
    for i in range(5):
        mine = set(t[q == i].tolist())
        exact = sorted((-int(sum(impact[x] * weight[term[x]] for x in range(cut[r], cut[r + 1]) if term[x] in mine)), r) for r in range(n))[:10]
        assert [(s, d) for s, _, d in top.rows[i]] == exact
