"""Joins, near-duplicates, decontamination and components against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Row

from semaspark.llm import common, decontam, embed_dedup, ngram_join, queries


def roots(n, pairs):
    up = {i: i for i in n}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def test_components(spark):
    rng = random.Random(1)
    for n, m in ((30, 20), (60, 80)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i + 100, i + 101) for i in range(12)] + [(500, x) for x in range(501, 530)]
        got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
        want = roots({x for p in pairs for x in p}, pairs)
        assert all(got.get(i, i) == c for i, c in want.items())
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_jaccard(docs, n=5, threshold=0.8):
    sets = {}
    for i, t in docs:
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    top = roots(ids, pairs)
    return {i: (sum(i in p for p in pairs), top[i]) for i in ids}


def test_jaccard_join_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    docs, i = [], 0
    for size in (2, 3, 40):
        base = text(150)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(150)] = rng.choice(vocabulary)
            docs.append((i, " ".join(own)))
            i += 1
    docs += [(i + k, "same text again and again here") for k in range(30)]
    docs += [(200, None), (201, ""), (202, "..."), (203, "two words"), (204, "Two  words!"), (205, " ".join(text(30_000)))] + [(300 + k, " ".join(text(60))) for k in range(30)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_links int")
    got = {r.doc_id: (r.n_links, r.class_id) for r in ngram_join.join(df).collect()}
    assert got == brute_jaccard(docs)


def test_jaccard_join_edge_rows(spark):
    df = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "a b c d e f g h")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_links, r.class_id, r.kept) for r in ngram_join.join(df).collect())
    assert got == [(0, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True)]
    assert ngram_join.join(df.limit(0)).count() == 0


def test_jaccard_join_tells_texts_of_one_id_apart(spark):
    base = [f"w{i}" for i in range(104)]
    edited = [*base[:-10], *[f"x{i}" for i in range(10)]]
    rows = [(1, " ".join(base), "a", 1), (1, "quite another text that is like none of them", "b", 2), (2, " ".join(edited), "c", 3), (2, " ".join(edited), "d", 4), (2, " ".join(base), "e", 5), (3, None, "f", 6), (3, "...", "g", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, kept int")
    got = sorted((r.doc_id, r.n_links, r.class_id, r.kept) for r in ngram_join.join(df).collect())
    assert got == [(1, 0, 1, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (2, 3, 1, False), (3, 0, 3, True), (3, 0, 3, True)]
    assert sorted(r.k for r in ngram_join.representatives(df).collect()) == ["a", "b", "f", "g"]
    again = ngram_join.representatives(df.where("k in ('c', 'd')")).collect()
    assert len(again) == 1 and again[0].k in "cd" and len(again[0]) == 4
    assert ngram_join.representatives(df.limit(0)).columns == df.columns


def test_runs_reach_the_recall():
    assert ngram_join.runs(0.8, 0.995) == 8 and ngram_join.runs(0.8, 0.9) < 8 < ngram_join.runs(0.7, 0.995)
    rng = np.random.default_rng(5)
    found = 0
    for i in range(600):
        shared, own = rng.integers(0, 2**63, 400, dtype=np.uint64), rng.integers(0, 2**63, (2, 50), dtype=np.uint64)
        x = ngram_join.sketches([np.concatenate([shared, own[0]]), np.concatenate([shared, own[1]])])
        roots_ = ngram_join.mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        nodes, owner = ngram_join.follow(np.tile(roots_, 2), np.repeat([0, 1], 8), x, ngram_join.LEVELS)
        found += bool(set(nodes[owner == 0].tolist()) & set(nodes[owner == 1].tolist()))
    print("recall of pairs at 0.8 before large nodes are split:", found / 600)
    assert found >= 0.99 * 600


def test_tiles_meet_each_pair_once(spark):
    df = spark.createDataFrame([(1, i, 23) for i in range(23)], "k long, id long, n long")
    at = {}
    for r in common.tiles(df, "k", "id", "n", 5).collect():
        at.setdefault((r.row, r.col), []).append((r.id, r.chunk))
    met = {}
    for (row, col), members in at.items():
        for a, ca in members:
            for b, cb in members:
                if a < b and {ca, cb} == {row, col}:
                    met[a, b] = met.get((a, b), 0) + 1
    assert met == {(a, b): 1 for a in range(23) for b in range(a + 1, 23)}


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 48))
    near = base[:6].repeat(60, 0) + rng.normal(size=(360, 48)) * 0.12
    x = np.concatenate([base, near, base[:2].repeat(20, 0), base[10:11] * 3]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 48, 1), (n + 2, [float("nan")] + [1.0] * 47, 1), (n + 3, [None] + [1.0] * 47, 1), (n + 4, [1.0, 2.0], 1), (n + 5, [], 1), (None, rows[150][1], 1)]
    got = {r.vec_id: r for r in embed_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept int")).collect()}
    assert got[150].n_links == got[None].n_links == 1 and got[None].component_id == 150 and not got[None].kept and got[150].kept
    got[150] = Row(vec_id=150, n_links=0, component_id=150, kept=True)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    alike = u @ u.T >= 0.95
    np.fill_diagonal(alike, False)
    top = roots(range(n), zip(*map(list, np.nonzero(alike)), strict=True))
    links = sum(got[i].n_links for i in range(n))
    assert links <= alike.sum() and links >= 0.99 * alike.sum()
    assert all(got[i].n_links <= alike[i].sum() for i in range(n))
    assert sum(got[i].component_id == top[i] for i in range(n)) >= 0.99 * n
    assert all(got[n + k].n_links == 0 and got[n + k].component_id == n + k for k in range(6))
    assert embed_dedup.dedup(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>, kept int").limit(0)).count() == 0


def test_hadamard_is_orthogonal():
    h = embed_dedup.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


def test_decontamination(spark):
    rng = random.Random(4)
    words = lambda k: [f"v{rng.randrange(5000)}" for _ in range(k)]
    items = [(i, " ".join(words(40))) for i in range(8)] + [(8, None), (9, "short item")]
    edited = items[1][1].split()
    edited[20] = "other"
    docs = [
        (1, " ".join([*words(50), items[0][1].upper(), *words(50)])), (2, " ".join([*words(9), *edited])), (3, " ".join([*words(60), *items[2][1].split()[:20], *words(60)])),
        (4, " ".join(words(200))), (5, None), (6, ""), (7, items[3][1]), (7, items[3][1]), (8, " ".join([items[4][1], *words(3), items[5][1]])), (None, items[6][1]), (9, "a short item here"),
    ]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.screen(df, bench).collect()
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in out}
    assert len(out) == len(docs)
    assert {k: v for k, v in got.items() if k is not None} == {1: (True, [0]), 2: (True, [1]), 3: (False, []), 4: (False, []), 5: (False, []), 6: (False, []), 7: (True, [3]), 8: (True, [4, 5]), 9: (False, [])}
    assert got[None] == (True, [6])
    odd = df.withColumnRenamed("similarity", "doc").selectExpr("*", "1 AS h1", "2 AS own", "3 AS found_items", "4 AS h")
    assert decontam.screen(odd, bench).columns == [*odd.columns, "contaminated", "item_ids", "similarity"]
    assert sorted(map(str, decontam.clean(odd, bench).collect())) == sorted(str(r) for r in odd.collect() if not got[r.doc_id][0])
    spread = decontam.screen(df, bench, broadcast_rows=0).collect()
    assert sorted(map(str, spread)) == sorted(map(str, out))
    assert not any(r.contaminated for r in decontam.screen(df, bench.limit(0)).collect())
    assert decontam.screen(df.limit(0), bench).count() == 0


def test_radius_is_guaranteed():
    """Any pair within the radius agrees on a block but for two bits."""
    rng = random.Random(9)
    for _ in range(2000):
        flipped = set(rng.sample(range(64), decontam.RADIUS))
        assert any(sum(s <= b < s + w for b in flipped) <= decontam.FLIPS for s, w in decontam.BLOCKS)


def test_decontamination_of_repeated_ids(spark):
    """Texts that share an id, of documents and of items, are told apart."""
    words = lambda c: " ".join(f"{c}{i}" for i in range(30))
    docs = spark.createDataFrame([(1, words("a")), (1, words("b")), (1, words("c"))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, words("a")), (5, words("b")), (5, words("b")), (6, None)], "item_id long, text string")
    got = {r.text: (r.contaminated, r.item_ids) for r in decontam.screen(docs, bench).collect()}
    assert got == {words("a"): (True, [5]), words("b"): (True, [5]), words("c"): (False, [])}


def test_decontamination_query_against_brute_force(spark, sf):
    got = {r.doc_id: r.item_ids for r in queries.op5_decontamination_simhash(spark, sf).collect()}
    sh = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(max(1, len(w) - 4)) if w}
    items = {r.item_id: sh(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = sh(r.text)
        full = sorted(i for i, s in items.items() if s <= own)
        assert set(map(str, full)) <= set(filter(None, got[r.doc_id].split(",")))
        assert all(len(items[int(i)] & own) >= 0.7 * len(items[int(i)]) for i in filter(None, got[r.doc_id].split(",")))


def test_decontamination_finds_edited_items(spark):
    """Copies with words put in, left out and replaced, most at 0.80 to 0.85,
    against exact weights over all windows."""
    import math

    rng = random.Random(11)
    items, docs = [], []
    for i in range(600):
        own = [f"u{i}x{k}" for k in range(rng.randint(50, 60))]
        items.append((i, " ".join(own)))
        for at in (rng.randrange(5, 20), rng.randrange(25, 45))[: rng.randint(1, 2)]:
            own[at : at + rng.randint(0, 1)] = ["edited"] * rng.randint(0, 2)
        docs.append((i, " ".join(["before"] * rng.randint(0, 30) + own + ["after"] * rng.randint(0, 30))))
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    df = {}
    for _, t in items:
        for g in set(grams(t.split())):
            df[g] = df.get(g, 0) + 1
    weigh = lambda gs: sum(1 + math.log(len(items) / df[g]) for g in gs)
    want = {}
    for (i, t), (_, d) in zip(items, docs, strict=True):
        own, held = grams(t.split()), grams(d.split())
        best = max(weigh(set(own) & set(held[k : k + len(own)])) for k in range(max(1, len(held) - len(own) + 1))) / weigh(set(own))
        if best >= 0.8 - 1e-9:
            want[i] = best
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in decontam.screen(table, spark.createDataFrame(items, "item_id long, text string")).collect() if r.contaminated}
    low = {i for i, s in want.items() if s < 0.85}
    print("recall:", len(found.keys() & want.keys()) / len(want), "at 0.80 to 0.85:", len(found.keys() & low) / len(low), "of", len(low))
    assert not found.keys() - want.keys() and all(found[i].item_ids == [i] for i in found)
    assert len(found) >= 0.99 * len(want) and len(low) > 100 and len(found.keys() & low) >= 0.99 * len(low)


def test_embeddings_tell_vectors_of_one_id_apart(spark):
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (3, b)], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.dedup(df).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (3, 2, 1, False)]
