"""Filter audit, centroid clusters and SimHash components against plain Python."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crestline.llm import audit, centroids, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- filter audit


def plain_masks(rows):
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    out = []
    for i, t, p in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        m = (len(w) < 200) | (100 * len(set(w)) < 50 * len(w)) << 1 | (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) << 2
        m |= bool(re.search(r"[#$%&*|]", t)) << 3 | (i is not None and low[t] < i) << 4
        out.append((i, p or "", m))
    return out


def plain_audit(masks, good, bad):
    rows = {}
    for part in {p for _, p, _ in masks}:
        own = [(m, i in good, i in bad) for i, p, m in masks if p == part]
        removed_by = dict.fromkeys(range(5), 0)
        for order in itertools.permutations(range(5)):
            name, left = "".join("ABCDE"[k] for k in order), own
            for step, k in enumerate(order, 1):
                fails = [x for x in left if x[0] >> k & 1]
                gone = sum(x[0] >> k & 1 for x in own) - len(fails)
                left = [x for x in left if not x[0] >> k & 1]
                removed_by[k] += len(fails)
                rows[part, name, step] = [len(left), len(fails), gone, sum(x[0] == 1 << k for x in own), sum(x[1] for x in fails), sum(x[2] for x in fails), k]
        for key in [r for r in rows if r[0] == part]:
            rows[key][-1] = removed_by[rows[key][-1]]
    return rows


def test_audit_equals_plain(spark, monkeypatch):
    """Small tries, ranges and groups, so that copies meet over tasks, flushes, ranges and salts."""
    for name, value in (("TRIE_BYTES", 20_000), ("RANGE_BYTES", 2_000), ("PREFIX", 24)):
        monkeypatch.setattr(audit, name, value)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    rng = random.Random(5)
    head = "one line that many texts begin with, longer than the sampled prefix " * 3
    rows = [tuple(r) for r in docs]
    rows += [(10_000 + k, head + str(k % 40), rng.choice(["en", None, ""])) for k in range(200)]
    rows += [(20_000 + k, "the same text of a large group", "de") for k in range(300)]
    rows += [(None, None, None), (None, "the same text of a large group", "de"), (3, None, "x"), (3, "", "x"), (5, "é" * 3, "x"), (5, "é" * 3, "y"), (5, "é" * 3, "y")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "s", 1, 2) for r in rows], "doc_id long, text string, lang string, part string, mask int, n int").repartition(7)
    got = audit.document_masks(df)
    assert sorted(((r.doc_id or -1, r.part, r["mask"]) for r in got.collect() for _ in range(r.n))) == sorted((i or -1, p, m) for i, p, m in plain_masks(rows))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in rows if i is not None and rng.random() < 0.7] + [(None, 1, 1), (3, 1, 0), (3, 0, 1)]
    found = audit.audit_orders(got, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(plain_masks(rows), {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None})
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): [r[f] for f in fields] for r in found} == want
    assert len(found) == len(want)


def test_audit_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit_orders(audit.document_masks(empty), none).count() == 0
    one = audit.audit_orders(audit.document_masks(spark.createDataFrame([(1, "w" * 2_000_000, None, None, 1)], DOCS)), none)
    assert {(r.part, r.step) for r in one.collect()} == {("", s) for s in range(1, 6)}


def test_trie_splits_edges():
    trie = audit.RadixTrie()
    words = [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abc", b"\xc3\xa9", b"\xc3\xaa"]
    for i, w in enumerate(words):
        trie.insert(w, 100 - i, "p")
    assert {n.text[: n.b]: n.low for n in trie.terminals()} == {w: 100 - max(i for i, x in enumerate(words) if x == w) for w in words}


# ---------------------------------------------------------------- centroid clusters


def plain_clusters(vectors, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in start[:k]]

    def best(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(cs))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(best(v)[1], []).append(v)
        for n, vs in groups.items():
            cs[n] = [sum(col) // len(vs) for col in zip(*vs)]
    return sorted((i if i is not None else -1, best(v)[1], best(v)[0]) for i, v in kept), cs


@pytest.mark.parametrize("k,rounds", [(3, 2), (40, 3)])
def test_clusters_equal_plain(spark, k, rounds):
    rows = [(r.vec_id, [float(x) for x in r.embedding] if r.embedding is not None else None) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()][:60]
    rows += [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [1.0] * 63 + [float("nan")]), (904, [float("-inf")] * 64), (905, []), (906, [-0.001] * 64), (906, [-0.001] * 64), (None, [0.5] * 64)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, k int, v int")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want, cs = plain_clusters(single, k, rounds)
    found, got_cs = centroids.cluster_vectors(df, k=k, rounds=rounds)
    full = centroids.with_inertia(found, got_cs).collect()
    assert got_cs == cs
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.cluster, r.distance) for r in full) == want
    for r in full:
        assert r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    found, cs = centroids.cluster_vectors(spark.createDataFrame([(1, [0.0] * 64), (2, [0.0] * 64)], schema))
    assert len(cs) == 2 and {r.cluster for r in found.collect()} == {0}  # ties go to the smaller number
    found, cs = centroids.cluster_vectors(spark.createDataFrame([(1, None)], schema))
    assert cs == [] and centroids.with_inertia(found, cs).count() == 0


def test_clusters_are_expressions(spark):
    found, _ = centroids.cluster_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), k=4, rounds=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" in plan and "aggregate" in plan and "Python" not in plan and "Exchange" not in plan


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs_of, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs_of:
        p, q = root(a), root(b)
        up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_simhash_equals_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-3, None), (7_000, ""), (7_001, " \n"), (7_002, "ONE two"), (7_003, "one two"), (7_003, "one two"), (None, "one two"), (7_004, "É" * 50_000)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, fp int, component_id int")
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    ids = [i for i, _ in fps if i is not None]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations([f for f in fps if f[0] is not None], 2) if (x ^ y).bit_count() <= 2]
    comp = plain_components(links, ids)
    got = simhash.simhash_components(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -9, r.fp % 2**64, r.component_id) for r in got if r.doc_id is not None) == sorted((i, f, comp[i]) for i, f in fps if i is not None)
    assert [(r.fp % 2**64, r.component_id) for r in got if r.doc_id is None] == [(f, None) for i, f in fps if i is None]
    assert simhash.simhash_components(df.limit(0)).count() == 0


def random_fingerprints(n, seed):
    """Half of them unrelated, half in dense balls whose members chain together."""
    rng = np.random.default_rng(seed)
    far = rng.integers(0, 2**64, n // 2, np.uint64)
    near = np.repeat(far[: max(1, n // 200)], 100)[: n // 2]
    for _ in range(3):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)) * rng.integers(0, 2, len(near)).astype(np.uint64)
    return np.unique(np.concatenate([far, near]))


def brute(fps, t):
    d = np.bitwise_count(fps[:, None] ^ fps[None, :])
    x, y = np.nonzero(np.triu(d <= t, 1))
    return plain_components(zip(x.tolist(), y.tolist()), range(len(fps)))


@pytest.mark.parametrize("t", [0, 1, 2, 4])
def test_shard_links_equal_brute_force(monkeypatch, t):
    monkeypatch.setattr(simhash, "BLOCK", 32)
    monkeypatch.setattr(simhash, "SPAN", 64)
    fps = random_fingerprints(3000, t)
    at = {int(f): i for i, f in enumerate(fps)}
    a, b = simhash.shard_links(fps, fps[:0], t)
    assert (np.bitwise_count(a ^ b) <= t).all() and len(a) < len(fps)
    assert plain_components([(at[int(x)], at[int(y)]) for x, y in zip(a, b)], range(len(fps))) == brute(fps, t)
    # With guests: only pairs that have an own member.
    own, guests = fps[::2], fps[1::2]
    a, b = simhash.shard_links(own, guests, t)
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= t
    mine = np.arange(len(fps)) % 2 == 0
    x, y = np.nonzero(np.triu(d & (mine[:, None] | mine[None, :]), 1))
    want = plain_components(zip(x.tolist(), y.tolist()), range(len(fps)))
    assert plain_components([(at[int(p)], at[int(q)]) for p, q in zip(a, b)], range(len(fps))) == want


def test_tree_routes_every_pair(monkeypatch):
    fps = random_fingerprints(4000, 9)
    tree = simhash.VantageTree(fps[::4], 20, 2)
    row, leaf, home = tree.route(fps)
    assert tree.leaves > 10 and np.array_equal(np.sort(row[home]), np.arange(len(fps)))
    inside = {(r, x) for r, x in zip(row.tolist(), leaf.tolist())}
    of = dict(zip(row[home].tolist(), leaf[home].tolist()))
    x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1))
    assert len(x) > 1000
    assert all((a, of[b]) in inside or (b, of[a]) in inside for a, b in zip(x.tolist(), y.tolist()))


def test_shards_and_cells_equal_brute_force(spark, monkeypatch):
    for name, value in (("SAMPLE", 500), ("SHARD", 200), ("CELL", 60), ("BLOCK", 16)):
        monkeypatch.setattr(simhash, name, value)
    from crestline.session import materialize

    fps = random_fingerprints(3000, 4)
    df = materialize(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), "test-fps")
    links = [(r.a, r.b) for r in simhash.hamming_links(df, 2).collect()]
    at = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    assert plain_components([(at[a], at[b]) for a, b in links], range(len(fps))) == brute(fps, 2)
