"""SimHash near-duplicates, whitening and hard negatives against brute force, and on odd input."""

import itertools
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from solargrid.llm import hard_negatives, queries, simhash_dedup, vectors, whitening

# 11


def brute_print(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """The smallest place that links lead to, for each place of a list of fingerprints."""
    f, up = np.array(prints, dtype=np.uint64), list(range(len(prints)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def test_prints_and_components_are_those_of_brute_force(spark, sf_dir, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    prints = [brute_print(t) for _, t in rows]
    want = {d: (f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, brute_components(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op11_simhash_dedup(spark, sf_dir).collect()} == want


def test_links_of_planted_families_and_chains(spark):
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, 40, dtype=np.int64)
    prints = set(base.tolist()) | {0}
    for centre in base[:4]:  # dense balls, which fill the same buckets
        for _ in range(200):
            prints.add(int(centre) ^ sum(1 << int(b) for b in set(r.integers(0, 63, r.integers(1, 4)))))
    at = int(base[5])
    for k in range(0, 60, 4):  # a chain whose ends are far apart: four bits a step
        at ^= 0b1111 << k
        prints.add(at)
    for five in itertools.islice(itertools.combinations(range(63), 5), 0, 60_000, 997):  # one bit too far
        prints.add(int(base[7]) ^ sum(1 << b for b in five))
    known = sorted(prints)
    df = spark.createDataFrame([(p, 1 + i % 3, i) for i, p in enumerate(known)], "fp long, n long, least long")
    got = {x.fp: x.root for x in simhash_dedup.linked(df).collect()}
    want = brute_components([p & (1 << 64) - 1 for p in known])
    groups = {}
    for p, c in zip(known, want, strict=True):
        groups.setdefault(c, set()).add(got[p])
    assert all(len(g) == 1 for g in groups.values()) and len(set(got.values())) == len(groups)


def test_no_join_of_prints_is_broadcast(spark, docs, monkeypatch):
    plans, write, join = [], simhash_dedup.stored, simhash_dedup.components
    plan = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())
    monkeypatch.setattr(simhash_dedup, "stored", lambda df, name: plan(df) or write(df, name))
    monkeypatch.setattr(simhash_dedup, "components", lambda edges: plan(edges) or join(edges))
    plan(simhash_dedup.dedup(docs))
    joins = [p for p in plans if "Join" in p]
    assert len(joins) == 6 and all("SortMergeJoin" in p and "Broadcast" not in p for p in joins)


def test_allotments_cover_every_pair_within_reach():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 63, 300, dtype=np.int64)
    fp[:100] &= 0xFFFF  # a hot part: its other bits are equal
    bits = simhash_dedup.unpacked(fp).astype(np.int64)
    for m in (2, 3, 4, 5):
        parts = simhash_dedup.correlated_parts(bits.T @ bits, len(fp), m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        near = [[simhash_dedup.at_distances(np.bincount(simhash_dedup.values(fp, p), minlength=1 << len(p)).astype(float), 4) for p in simhash_dedup.pieces(part)] for part in parts]
        units = simhash_dedup.allotted(fp, parts, near, len(fp))
        assert (units.sum(axis=1) == 5).all() and (units >= 0).all()
        for k in range(0, 300, 7):
            other = fp[k] ^ np.bitwise_or.reduce(np.int64(1) << r.choice(63, 4, replace=False))
            apart = [int(np.bitwise_count(simhash_dedup.values(fp[k : k + 1], p) ^ simhash_dedup.values(np.array([other]), p))[0]) for p in parts]
            assert any(d <= u - 1 for d, u in zip(apart, units[k], strict=True))


def test_counts_at_a_distance():
    counts = np.random.default_rng(2).integers(0, 5, 1 << 6).astype(float)
    got = simhash_dedup.at_distances(counts, 4)
    for v in range(64):
        assert [got[e][v] for e in range(5)] == [sum(counts[u] for u in range(64) if (u ^ v).bit_count() == e) for e in range(5)]
    assert simhash_dedup.number_of_parts(10**4) >= simhash_dedup.number_of_parts(10**7) >= simhash_dedup.number_of_parts(10**10)


def test_prints_of_odd_texts(spark, odd, monkeypatch):
    rows = simhash_dedup.dedup(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        assert r.fingerprint == f"{brute_print(texts[r.doc_id]):016x}"
    least = {r.fingerprint: r.component_id for r in rows}
    assert least["0" * 16] == 1 and {r.component_id for r in rows if r.doc_id in (4, None)} == {4}
    assert simhash_dedup.dedup(odd.limit(0)).count() == 0
    assert simhash_dedup.dedup(odd.where("doc_id IS NULL")).first().component_id is None
    monkeypatch.setattr(simhash_dedup, "STRETCH", 7)
    long = texts[5]
    data = long.encode()
    assert simhash_dedup.block_prints(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0] == brute_print(long)


# 12


def brute_whiten(x, most=4):
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(axis=0)
    e, q = np.linalg.eigh(np.cov(u.T.astype(float), bias=True))
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    return n, ((n * x - sums) ** 2).sum(axis=1), ((x - sums / n) @ q) / np.sqrt(e), e / np.trace(np.cov(u.T.astype(float), bias=True))


def test_whitening_is_that_of_an_eigensolver(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, far, white, share = brute_whiten(np.floor(256 * np.stack(p.embedding).astype(float)).astype(np.int64))
    got = queries.op12_embedding_whitening(spark, sf_dir).toPandas().sort_values(["vec_id", "component"])
    assert got.vec_id.tolist() == np.repeat(p.vec_id, 4).tolist() and got.component.tolist() == [1, 2, 3, 4] * len(p)
    mine = got.whitened.to_numpy().reshape(-1, 4)
    assert np.abs(mine * np.sign((mine * white).sum(axis=0)) - white).max() < 1e-9
    assert (got.deviation.to_numpy().reshape(-1, 4) == far[:, None]).all() and (got.n == n).all()
    assert got.explained.to_numpy()[:4] == pytest.approx(share, rel=1e-12) and got.identity_error.max() < 1e-12


@pytest.mark.parametrize("kind", ["random", "gaps", "equal", "zero", "close", "tiny", "negative"])
def test_spectral_divide_and_conquer(kind):
    r = np.random.default_rng(3)
    q = np.linalg.qr(r.standard_normal((32, 32)))[0]
    e = {"random": r.random(32) * 9, "gaps": 10.0 ** np.arange(32)[::-1] / 1e20, "equal": np.r_[[5.0] * 3, [1.0] * 29], "zero": np.r_[[3.0, 2.0], np.zeros(30)], "close": np.r_[100 - 1e-9 * np.arange(4), np.arange(28)], "tiny": r.random(32) * 1e-30, "negative": r.standard_normal(32)}[kind]
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    for most in (1, 4, 32):
        got, basis = whitening.leading(v, most)
        size = np.linalg.norm(v)
        assert np.abs(got - np.linalg.eigvalsh(v)[::-1][:most]).max() <= 1e-14 * size * 32
        assert np.linalg.norm(v @ basis - basis * got) <= 1e-13 * size * 32 and np.abs(basis.T @ basis - np.eye(most)).max() < 1e-13


def test_whitening_of_odd_rows(spark):
    v = [[1.0, 2.0, 0.5], [0.25, -1.0, 3.0], [2.0, 2.0, 2.0], [-1.0, 0.0, 1.0], [0.0, 0.0, 5.0]]
    rows = [("a", v[0]), ("a", v[0]), (None, v[1]), ("c", v[2]), ("d", v[3]), ("e", v[4]), ("f", None), ("g", [1.0, None, 2.0]), ("h", [1.0, float("nan"), 2.0]), ("i", [float("inf"), 1.0, 1.0]), ("j", []), ("k", [1.0, 2.0])]
    df = spark.createDataFrame([(a, b, "n", 7.0) for a, b in rows], "vec_id string, embedding array<double>, n string, whitened double")
    got = whitening.whiten(df).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["None", "a", "a", "c", "d", "e"] * 3)  # of three dimensions, three components
    n, far, white, _ = brute_whiten(np.floor(256 * np.array(v)).astype(np.int64), 3)
    assert {r.n for r in got} == {5} and {(str(r.vec_id), r.deviation) for r in got} == {(i, int(f)) for i, f in zip(["a", "None", "c", "d", "e"], far, strict=True)}
    for k in (1, 2, 3):
        mine = {str(r.vec_id): r.whitened for r in got if r.component == k}
        assert [abs(mine[i]) for i in ("a", "None", "c", "d", "e")] == pytest.approx(np.abs(white[:, k - 1]).tolist())
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 'a'")).count() == 0 and whitening.whiten(df.where("vec_id = 'f'")).count() == 0
    assert whitening.whiten(df.limit(0)).columns == whitening.whiten(df).columns
    # On a line there is one component; huge entries saturate and their deviations are null.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [1e16, 1.0]), (3, [-3.0, 2e9])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.deviation) for r in whitening.whiten(huge).collect()} == {(1, None), (2, None), (3, None)}


def test_packed_vectors_come_back():
    x = np.array([[1, -2, 3], [1 << 15, 0, 0], [-(1 << 15), 5, 5], [1 << 31, 1, 1], [-(1 << 63), 0, 7]])
    assert (vectors.unpacked(vectors.packed(x), 3) == x).all()
    assert [len(v.as_py()) for v in vectors.packed(x)] == [6, 12, 6, 24, 24]
    assert vectors.unpacked(vectors.packed(x[:0]), 3).shape == (0, 3)


# 13


def brute_negatives(rows, every=50):
    use = [(i, (la + 1) % 10 if i % 7 == 0 else la, np.floor(256 * np.array(v, dtype=float)).astype(np.int64)) for i, la, v in rows if i is not None and la is not None and v is not None and None not in v and np.isfinite(v).all() and len(v) == len(rows[0][2])]
    out = []
    for i, la, x in use:
        if i % every == 0:
            scored = sorted((-int(x @ y), j, lb) for j, lb, y in use)
            for s, p, _ in [t for t in scored if t[2] == la and t[1] != i][:5]:
                hard = [t for t in scored if t[2] != la and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
                out += [(i, p, k, t[1], -s, -t[0]) for k, t in enumerate(hard, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(df, **more):
    return sorted(map(tuple, hard_negatives.mine(df, **more).select(*COLUMNS).collect()))


def test_negatives_are_those_of_brute_force_and_of_sql(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = mined(df)
    assert got == brute_negatives([(r.vec_id, r.label, r.embedding) for r in df.collect()]) and len(got) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(con.execute(hard_negatives.ORACLE).fetchall()) == got


def test_negatives_with_hot_vectors_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 40)
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 300)  # fewer than the points: the tree is made on a part
    r = np.random.default_rng(5)
    centres = r.standard_normal((6, 8))
    rows = []
    for i in range(900):
        v = [0.5, 0.25, 1.0, 0, 0, 0, 0, 0.125] if i % 3 == 0 else np.round(centres[i % 6] + r.standard_normal(8) * (0.02 if i % 5 else 1.0), 2).tolist()
        rows.append((i, i % 6 if i % 11 else (i * 7) % 10, [float(c) for c in v]))
    rows += [(1000, None, rows[1][2]), (1050, 3, None), (1100, 3, [1.0] * 7 + [None]), (1150, 3, [float("nan")] * 8), (1200, 3, [1.0, 2.0]), (None, 3, rows[1][2]), (1250, 4, [0.0] * 8), (-50, 2, rows[4][2])]
    df = spark.createDataFrame([(*x, "a", 1.0) for x in rows], "vec_id long, label int, embedding array<double>, score string, x double")
    want = brute_negatives(rows)
    assert mined(df) == mined(df.unionByName(df)) == [w for w in want]
    assert {w[0] for w in want} >= {0, 50, 100} and len(want) > 100
    assert mined(df.limit(0)) == [] and mined(df.where("label IS NULL")) == [] and mined(df.where("vec_id = 50")) == []
    assert hard_negatives.mine(df.limit(0)).dtypes == hard_negatives.mine(df).dtypes


def test_pruning_leaves_out_leaves_but_no_answer():
    r = np.random.default_rng(6)
    x = np.floor(256 * (r.standard_normal((8, 8))[r.integers(0, 8, 4000)] + 0.05 * r.standard_normal((4000, 8))))
    tree = hard_negatives.Tree(x[:1500], 4000)
    tree.far, tree.norms, leaf = {}, {}, tree.leaves(x)
    for node, children in enumerate(tree.children):
        for child in children:
            tree.far[child], tree.norms[child] = (np.full(len(children), np.inf), np.full(len(children), -np.inf)), (np.inf, -np.inf)
    for node, rows, d in tree.walk(x):
        for j, child in enumerate(tree.children[node]):
            own = d.argmin(axis=1) == j
            if own.any():
                size = np.linalg.norm(x[rows[own]], axis=1)
                tree.far[child], tree.norms[child] = (d[own].min(axis=0), d[own].max(axis=0)), (size.min(), size.max())
    q, score = x[::50], x[::50] @ x.T
    low = np.sort(score, axis=1)[:, -10:-9]
    high = np.where(np.arange(len(q)) % 2, np.inf, np.sort(score, axis=1)[:, -3])[:, None]
    seen = np.zeros((len(q), len(tree.splits)), dtype=bool)
    for k, rows in tree.search(q, low, high):
        seen[rows, k] = True
    hit = (score >= low) & (score <= high)
    assert seen[np.nonzero(hit)[0], leaf[np.nonzero(hit)[1]]].all()
    assert len(set(leaf)) > 4 and seen[:, sorted(set(leaf))].mean() < 0.5
