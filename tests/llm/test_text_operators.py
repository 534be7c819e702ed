"""Text operators against SQL, brute force and held-out accuracy, and on odd input."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from solargrid.llm import components, decontaminate, language_id, license_scan, lm_score, ngram_jaccard, piece_codec, quality_classifier, quality_rules, queries, suffix_array, suffix_dedup, warc


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(name, spark, sf_dir, same_as_sql):
    same_as_sql(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name])


def test_all_ten_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


# 1


def shingle_sets(rows):
    out = {}
    for d, t in rows:
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t or "") if x]
        out[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def brute_groups(rows):
    sets = shingle_sets(rows)
    up, links = {d: d for d in sets}, collections.Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (root(d), links[d]) for d in ids}


@pytest.mark.parametrize(("large", "block"), [(4096, 512), (3, 2)])
def test_jaccard_join_is_complete(spark, docs, monkeypatch, large, block):
    monkeypatch.setattr(ngram_jaccard, "LARGE", large)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    base = docs.select("doc_id", "text")
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    near = []
    for k in range(25):
        w = list(words)
        for _ in range(rnd.randrange(1, 8)):
            w[rnd.randrange(300)] = f"z{k}"
        near.append((10_000 + k, " ".join(w)))
    all_docs = base.unionByName(spark.createDataFrame(near, base.schema))
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard.join(all_docs).collect()}
    assert got == brute_groups([(r.doc_id, r.text) for r in all_docs.collect()])


def test_packed_hashes_come_back_whole():
    t = np.unique(np.random.default_rng(2).integers(0, 1 << 40, 1000, dtype=np.uint64))
    assert (ngram_jaccard.unpack(ngram_jaccard.pack(t)) == t).all()


def test_similarity_is_exact_at_the_threshold(spark):
    """Sets of 100 shingles that share 89 (0.8018) link; those that share 88 (0.786) do not."""
    words = [f"w{k}" for k in range(104)]
    rows = [(0, " ".join(words))]
    for k, n in ((1, 11), (2, 12)):
        rows.append((k, " ".join(words[: 104 - n] + [f"z{k}{i}" for i in range(n)])))
    got = {r.doc_id: r.n_links for r in ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: n for d, (_, n) in brute_groups(rows).items()} and got[1] == 1 and got[2] == 0


def test_jaccard_join_on_odd_input(odd):
    got = ngram_jaccard.join(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert by[1][0].n_links == by[2][0].n_links == by[3][0].n_links == 0 and by[2][0].class_id == 2
    assert [r.n_links for r in by[4]] == [2, 2] and by[None][0].class_id == 4
    assert by[6][0].class_id == 5 and by[6][0].n_links == 1
    assert ngram_jaccard.join(odd.limit(0)).count() == 0
    kept = ngram_jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 5, 7, 8}


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {r.component for r in components.components(e).collect()} == {0, 100}
    assert components.components(e.limit(0)).count() == 0


# 2


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    for t in range(120):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0).astype(np.int32)
        if t % 4 == 0:
            s = np.append(np.tile(s[:-1][:3], 15), 0).astype(np.int32)
        order = sorted(range(len(s)), key=lambda i: s[i:].tolist())  # noqa: B023
        sa = suffix_array.suffix_array(s, int(s.max()) + 1)
        assert sa.tolist() == order
        shared = suffix_array.permuted_common_prefixes(s, sa, 64)
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert shared[b] == n


def in_order(s, sa):
    """Whether a permutation of the places sorts the suffixes: by first symbols, then by the ranks of what follows."""
    rank = np.empty(len(s) + 1, np.int64)
    rank[sa], rank[len(s)] = np.arange(len(s)), -1
    a, b = sa[:-1], sa[1:]
    return (np.bincount(sa, minlength=len(s)) == 1).all() and ((s[a] < s[b]) | ((s[a] == s[b]) & (rank[a + 1] < rank[b + 1]))).all()


def test_shards_are_sorted_by_induction_alone(monkeypatch):
    """2 MB of documents, as large as a shard: every level of the recursion is induced, by either way of filling buckets."""
    import pyarrow.parquet as pq

    text = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    data = np.frombuffer(b"\0".join((t or "").encode() for t in text)[:2_000_000], np.uint8)
    s = np.append(data.astype(np.int32) + 1, 0).astype(np.int32)
    levels = []
    for name in ("induce_each", "induce_waves"):
        own = getattr(suffix_array, name)
        monkeypatch.setattr(suffix_array, name, lambda *a, own=own, name=name: levels.append((name, len(a[0]))) or own(*a))
    sa = suffix_array.suffix_array(s, int(s.max()) + 1)
    assert in_order(s, sa)
    assert levels[0] == ("induce_waves", len(s)) and {n for n, _ in levels} == {"induce_waves", "induce_each"}
    assert not hasattr(suffix_array, "by_doubling") and len({n for _, n in levels}) > 2  # a level under a level
    shared = suffix_array.permuted_common_prefixes(s, sa, 400)
    raw = s.tobytes()
    for k in range(1, len(sa), 5003):
        i, j, most = int(sa[k]), int(sa[k - 1]), int(shared[sa[k]])
        assert raw[4 * i : 4 * (i + most)] == raw[4 * j : 4 * (j + most)] and (most == 400 or s[i + most] != s[j + most])


def test_both_ways_to_fill_buckets_agree():
    rng = np.random.default_rng(1)
    for n, sigma in ((3000, 4), (20_000, 30), (5000, 2)):
        s = np.append(rng.integers(1, sigma, n), 0).astype(np.int32)
        smaller = suffix_array.smaller_types(s)
        order = suffix_array.leftmost(smaller).astype(np.int32)
        one = suffix_array.induce_each(s, smaller, order, sigma)
        many = suffix_array.induce_waves(s, smaller, order, sigma)
        assert many is None or (one == many).all()
    run = np.append(np.ones(200_000, np.int32), 0).astype(np.int32)  # a bucket that fills one by one
    smaller = suffix_array.smaller_types(run)
    assert suffix_array.induce_waves(run, smaller, suffix_array.leftmost(smaller).astype(np.int32), 2) is None
    assert in_order(run, suffix_array.suffix_array(run, 2))


def brute_removed(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), len(b) - len(kept), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("settings", [{}, {"hot": 2, "family": 1, "limit": 3000}])
def test_suffix_dedup_removes_exactly_the_repeats(docs, settings):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r[c] for c in COLS) for r in suffix_dedup.dedup(docs, **settings).collect()), key=str)
    assert got == brute_removed(rows, 400)


def test_suffix_dedup_of_hot_periodic_text(spark):
    """Lines repeated more or less often before a shared tail, on the path for anchors with many regions."""
    rows = []
    for seed, n_tail in ((0, 100), (3, 30), (7, 30), (11, 30)):
        dice = random.Random(seed)
        letters = lambda n: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))  # noqa: B023, E731
        line, tail = letters(60), letters(n_tail)
        rows += [letters(50) + (line * 99)[:n] + tail + (line * 99)[:2400] + letters(50) for n in (600, 660, 720, 780)]
    rows = list(enumerate(rows))
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), hot=2, family=1, limit=3000)
    assert sorted((tuple(r[c] for c in COLS) for r in got.collect()), key=str) == brute_removed(rows, 400)


def test_suffix_dedup_on_odd_input(odd):
    got = sorted((tuple(r[c] for c in COLS) for r in suffix_dedup.dedup(odd).collect()), key=str)
    assert got == brute_removed([(r.doc_id, r.text) for r in odd.collect()], 400)
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() and cut.where("doc_id = 7").first().text == ""


# 3


def test_pieces_round_trip_and_chunks_do_not_change_the_best_score(spark):
    c = piece_codec.codec(piece_codec.V.DEFAULT_MODEL)
    rnd = random.Random(3)
    texts = ["", " ", "a▁b", "  two  spaces \n x", "漢字テキスト" * 20, "hello " * 60, "x" * 200, None] + ["".join(rnd.choice("abc  thé ▁\n🎉") for _ in range(rnd.randint(1, 300))) for _ in range(30)]

    def best(t):
        m = piece_codec.marked(t)
        return c.best(m, 0, len(m))[0][-1]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (7, 50, 20_000):
        out = collections.defaultdict(list)
        for r in piece_codec.decode(piece_codec.encode(df, chunk=chunk)).collect():
            out[r.doc_id].append(r)
        for i, t in enumerate(texts):
            parts = sorted(out[i], key=lambda r: r.no)
            if t is None:
                assert parts[0].ids is None and parts[0].text is None
                continue
            assert "".join(r.text for r in parts) == t
            score = sum(c.byte_score if c.text_of[k] is None else c.score[c.text_of[k]] for r in parts for k in r.ids)
            assert score == pytest.approx(best(t))


def test_best_score_by_brute_force():
    c = piece_codec.codec(piece_codec.V.DEFAULT_MODEL)

    def every(s):
        if not s:
            return 0.0
        first = [(c.score[s[:n]], n) for n in range(1, len(s) + 1) if s[:n] in c.score] + ([(c.byte_score * len(s[0].encode()), 1)] if s[0] not in c.score else [])
        return max(v + every(s[n:]) for v, n in first)

    for word in (" hello", " thé", "  a", " 漢x", "nation"):
        assert c.best(word, 0, len(word))[0][-1] == pytest.approx(every(word))


def test_pieces_on_odd_input(odd):
    out = piece_codec.decode(piece_codec.encode(odd, chunk=3000))
    texts = collections.defaultdict(list)
    for r in out.where("text IS NOT NULL AND doc_id IN (5, 6, 7, 8)").collect():
        texts[r.doc_id].append((r.no, r.text))
    want = {r.doc_id: r.text for r in odd.where("doc_id IN (5, 6, 7, 8)").collect()}
    assert {k: "".join(t for _, t in sorted(v)) for k, v in texts.items()} == want
    assert piece_codec.encode(odd.limit(0)).count() == 0


# 4


def test_quality_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    s = quality_classifier.score(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    r = s.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").selectExpr("avg(int(predicted = quality))", "min(score)", "max(score)").first()
    assert r[0] > 0.93 and r[1] >= 0 and r[2] <= 1


def plain_statistics(t):
    """The statistics of a text, one by one."""
    w = re.findall("[^ \t-\r]+", t)
    lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
    seen = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    chars = sum(map(len, w))
    per = lambda a, b, k=1000: a * k / b if b else 0.0
    return {
        "words": len(w), "lines": len(lines), "word_length": per(chars, len(w), 1), "symbols": per(sum(c in "#*$%&|<>" for c in t), len(w)), "upper": per(sum("A" <= c <= "Z" for c in t), chars),
        "dup_lines": per(len(lines) - len(set(lines)), len(lines)), "repeats": per(len(again), len(w)), "line_words": per(len(w), len(lines), 1), "shouts": per(t.count("!"), len(w)), "bars": per(t.count("|"), len(w)),
        "digits": per(sum("0" <= c <= "9" for c in t), chars), "stops": per(t.count("."), len(w)),
    }


def test_quality_scores_against_brute_force(spark, docs, sf_dir):
    """The whole query: statistics by hand, rules one by one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.train(quality_classifier.statistics(docs), labels)
    names = list(quality_classifier.STATISTICS)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    got = quality_classifier.score(docs, labels).collect()
    assert len(got) == len(text) and len(model.rules) > 1
    for r in got:
        x = plain_statistics(text[r.doc_id])
        total = model.bias + sum(rule.weight for rule in model.rules if all((x[names[k]] > cut) == above for k, above, cut in rule.terms))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total))) and r.predicted == int(r.score >= 0.3)


def test_lasso_weights_are_optimal_and_splits_are_the_best():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0.4).astype(float)
    rules = quality_classifier.tree_rules(x, y)
    r = np.stack([quality_classifier.matches(x, t) for t in rules], axis=1).astype(float)
    b, w = quality_classifier.lasso(r, y)
    slope = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    on = np.abs(w) > 1e-6
    assert on.any() and np.abs(slope[on] + quality_classifier.PENALTY * np.sign(w[on])).max() < 1e-3 and np.abs(slope[~on]).max() < quality_classifier.PENALTY + 1e-3
    g, h = 1 / (1 + np.exp(0)) - y, np.full(300, 0.25)
    found, step = [], np.zeros(300)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 9)[:-1])) for k in range(3)]
    quality_classifier.grow(x, g, h, np.arange(300), cuts, 1, (), found, step)

    def gain(k, c):
        low = x[:, k] <= c
        if min(low.sum(), (~low).sum()) < quality_classifier.LEAST:
            return -1
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (low, ~low)) - g.sum() ** 2 / (h.sum() + 1)

    assert found[0][0][::2] == max(((k, float(c)) for k in range(3) for c in cuts[k]), key=lambda kc: gain(*kc))


def test_quality_classifier_on_odd_input(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.score(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    got = quality_classifier.score(odd, one)
    assert got.count() == odd.count() and got.where("score < 0.9").count() == 0
    assert quality_classifier.score(odd.limit(0), one).count() == 0


# 5


def test_loser_tree_merges():
    rnd = random.Random(1)
    for _ in range(50):
        runs = [sorted([(rnd.choice("abc"), "t", rnd.choice([None, 1, 2]), f"f{k}", i, 0) for i in range(rnd.randint(0, 6))], key=warc.sort_key) for k in range(rnd.randint(0, 9))]
        assert list(warc.loser_tree(runs)) == sorted(sum(runs, []), key=warc.sort_key)


@pytest.mark.parametrize("run_rows", [100_000, 2])
def test_warc_on_odd_pages(spark, monkeypatch, run_rows):
    monkeypatch.setattr(warc, "RUN_ROWS", run_rows)
    big = "<p>" + "é" * 800
    rows = [(1, None, None, "x"), (2, "http://www.A.example.com:80/Q?b=1#f", big, "x"), (3, "bad\r\nurl", big, "x"), (None, "http://a.example.com/", big, "x"), (3, "http://b.example.com/", big, "x"), (5, "", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.round_trip(pages).orderBy("position").collect()
    assert len(got) == 6 and [(r.url_key, r.captured) for r in got] == sorted((r.url_key, r.captured) for r in got)
    kinds = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    assert kinds == sorted([(1, "response", None, 0), (2, "revisit", 3, 1603), (3, "response", None, 1603), (3, "response", None, 1603), (None, "revisit", 3, 1603), (5, "response", None, 0)], key=str)
    assert warc.url_key("http://www.A.example.com:80/Q?b=1#f") == "com,example,a)/q?b=1"
    assert warc.round_trip(pages.limit(0)).count() == 0


# 6


def test_forward_sums_all_segmentations():
    lat = language_id.lattice(language_id.V.DEFAULT_MODEL)
    ids = language_id.V.load().ids
    p = np.random.default_rng(1).random((lat.size, 2))
    p /= p.sum(0)

    def every(w):
        if not w:
            return np.ones(2)
        return sum(p[k] * every(w[n:]) for n in range(1, len(w) + 1) if (k := ids.get(w[:n], lat.size - 1 if n == 1 else None)) is not None)

    for w in ("▁hello", "▁çaéou", "▁漢ab"):
        assert lat.log_probability([w], p)[0] == pytest.approx(np.log(every(w)))
    n = lat.expected(["▁hello"], np.array([2.0]))
    lengths = np.array([len(x) for x in language_id.V.load().pieces] + [1])
    assert (n * lengths).sum() == pytest.approx(2.0 * 6)  # the expected pieces tile the word


def test_language_id_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language_id.identify(d).where("held_out").join(d.select("doc_id", "lang"), "doc_id").selectExpr("avg(int(lang = lang_pred))").first()
    assert r[0] > 0.97


def test_language_id_on_odd_input(odd):
    got = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and 0 <= got[5].score <= 1
    assert language_id.identify(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_id_of_texts_without_letters_and_of_long_words(spark):
    train = [(k, ("the cat sat on the mat " if k % 2 else "le chat est sur la table ") * 5, "en" if k % 2 else "fr") for k in range(40)]
    rows = [(100, "½ ² Ⅷ ١٢٣ _ 42", None), (101, "the" * 350_000, None), (102, "hindi हिन्दी", None)]
    d = spark.createDataFrame(train + rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(d).collect()}
    assert got[100].lang_pred == "und" and got[100].score == 0 and got[101].lang_pred == "en"
    assert language_id.words_of("Été हिन्दी x1y a\u0301b") == ["été", "हिन्दी", "x", "y", "a\u0301b"]


def test_language_id_against_brute_force(spark):
    """Expected counts, smoothing and all segmentations by recursion, on short words."""
    rows = [(0, "ab ba abab", "x"), (3, "cd dc", "y"), (6, "ab cd", "x"), (9, "dcdc cd", "y"), (4, "abba dc", None), (7, "cddc 12", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    d = d.withColumn("h", language_id.held_out())
    learned = {r.doc_id for r in d.where("NOT h AND lang IS NOT NULL").collect()}
    lat, ids = language_id.lattice(language_id.V.DEFAULT_MODEL), language_id.V.load().ids

    def cuts(w):
        if not w:
            yield ()
        for n in range(1, len(w) + 1):
            k = ids.get(w[:n], lat.size - 1 if n == 1 else None)
            if k is not None:
                yield from ((k, *rest) for rest in cuts(w[n:]))

    table = {x: lat.prior * language_id.PRIOR_COUNT for x in sorted({r[2] for r in rows if r[0] in learned})}
    for doc_id, text, lang in rows:
        for w in language_id.words_of(text) if doc_id in learned else ():
            every = list(cuts("▁" + w))
            weight = np.array([np.prod([lat.prior[k] for k in c]) for c in every])
            for c, share in zip(every, weight / weight.sum(), strict=True):
                np.add.at(table[lang], list(c), share)
    table = {x: t / t.sum() for x, t in table.items()}
    for r in language_id.identify(d.drop("h")).collect():
        text = next(t for k, t, _ in rows if k == r.doc_id)
        total = {x: sum(np.log(sum(np.prod([t[k] for k in c]) for c in cuts("▁" + w))) for w in language_id.words_of(text)) for x, t in table.items()}
        best = max(total, key=lambda x: (total[x], x))
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(np.exp(v - total[best]) for v in total.values()))


# 7


def test_rows_that_share_an_id_are_judged_by_themselves(spark):
    """Different texts under one doc_id, or under none, and equal rows."""
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    passage = words("same", 120)
    texts = [words("a", 90), words("b", 90), passage + " " + words("c", 80), passage + " " + words("d", 80), "short", words("e", 90) + " " + words("item", 30)]
    rows = [(1, t) for t in texts] + [(None, t + " null") for t in texts] + [(2, texts[0]), (2, texts[0])]
    d = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    good = quality_rules.keep_good(d).collect()
    assert sorted(r.text for r in good) == sorted(t for _, t in rows if "short" not in t)
    cut = suffix_dedup.without_repeats(d).collect()
    want = dict(zip(rows, brute_removed([(k, t) for k, (_, t) in enumerate(rows)], 400), strict=False))
    assert len(cut) == len(rows) and len(want) == len(rows) - 1
    gone = {k: n for k, _, n, *_ in brute_removed([(k, t) for k, (_, t) in enumerate(rows)], 400)}
    left = sorted(len(t) - gone[k] for k, (_, t) in enumerate(rows))
    assert sorted(len(r.text) for r in cut) == left and all(r.n_chars == len(r.text) for r in cut)
    one = ngram_jaccard.one_of_each(d).collect()
    groups = {g for g, _ in brute_groups([(k, t) for k, (_, t) in enumerate(rows)]).values()}
    assert len(one) == len(groups) and sum(r.text == texts[0] for r in one) <= 1
    b = spark.createDataFrame([(1, words("item", 30))], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.without_leaks(d, b).collect()) == sorted(t for _, t in rows if "item" not in t)


def test_quality_rules_on_odd_input(odd):
    got = quality_rules.judged(odd)
    assert got.count() == odd.count() and got.where("doc_id IN (1, 2, 3)").where("kept OR NOT base_failed OR n_words > 0").count() == 0
    assert quality_rules.judged(odd.limit(0)).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


# 8


def test_hashed_tokens_are_those_of_the_pattern():
    rnd = random.Random(5)
    texts = ["", " ", "it's 5 o'clock!", "_a_b 漢字 ½² é́ 🎉🎉x", "a\u2028b\x1fc"] + ["".join(rnd.choice("ab '_.!é漢🎉\n\u00a0") for _ in range(rnd.randrange(60))) for _ in range(60)]
    h, text = lm_score.hashed(texts)
    want = [(k, w) for k, t in enumerate(texts) for w in lm_score.tokens(t)]
    assert text.tolist() == [k for k, _ in want]
    name = dict(zip([w for _, w in want], h.tolist(), strict=True))
    assert [name[w] for _, w in want] == h.tolist() and len(set(name.values())) == len(name)


def lm_by_hand(rows, good):
    """n_tokens, loss_target and score of every text, by counters over all words."""
    uni, bi, heads = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], [0, 0]
    for d, w in rows:
        for k in (0, 1) if d in good else (1,):
            uni[k].update(w)
            bi[k].update(zip([None, *w], w, strict=False))
            heads[k] += 1
    size, n, out = len(uni[1]) + 1, [sum(c.values()) for c in uni], {}
    for d, w in rows:
        loss = [0.0, 0.0]
        for h, x in zip([None, *w], w, strict=False):
            for k in (0, 1):
                own = 1 if k or d in good else 0
                p = (uni[k][x] - own + 1) / (n[k] - own + size)
                c = (heads[k] if h is None else uni[k][h]) - own
                loss[k] -= np.log((bi[k][h, x] - own + lm_score.WEIGHT * p) / (c + lm_score.WEIGHT))
        out[d] = (len(w), loss[0] / len(w), (loss[1] - loss[0]) / len(w))
    return out


def test_lm_scores_know_every_word(spark):
    """More words than 16 bits can name, rare ones told apart by the target."""
    rows = [(k, " ".join(f"w{(k // 2 * 300 + i) % 75_000}" for i in range(300))) for k in range(500)]
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.range(0, 500, 4).withColumnRenamed("id", "doc_id")).collect()}
    want = lm_by_hand([(d, lm_score.tokens(t)) for d, t in rows], set(range(0, 500, 4)))
    assert {d: (r.n_tokens, r.loss_target, r.score) for d, r in got.items()} == {d: pytest.approx(x) for d, x in want.items()}


def test_lm_scores_against_brute_force(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    got = {r.doc_id: (r.n_tokens, r.loss_target, r.score) for r in lm_score.score(docs, labels).collect()}
    want = lm_by_hand([(r.doc_id, lm_score.tokens(r.text)) for r in docs.collect()], {r.doc_id for r in labels.collect()})
    assert got == {d: pytest.approx(x) for d, x in want.items()}


@pytest.mark.parametrize("hot_rows", [0, 3, 40, 100_000])
def test_lm_scores_with_a_bigram_of_a_third_of_all_tokens(spark, monkeypatch, hot_rows):
    """Scores are the same wherever the line between broadcast and shuffle lies."""
    monkeypatch.setattr(lm_score, "HOT_ROWS", hot_rows)
    dice = random.Random(8)
    rows = [(k, "a b " * 80 + " ".join(f"w{dice.randrange(4) * dice.randrange(40)}" for _ in range(80))) for k in range(60)]
    good = spark.range(0, 60, 3).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r for r in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), good).collect()}
    want = lm_by_hand([(d, lm_score.tokens(t)) for d, t in rows], set(range(0, 60, 3)))
    assert {d: (r.n_tokens, r.loss_target, r.score) for d, r in got.items()} == {d: pytest.approx(x) for d, x in want.items()}


def shuffled_rows(spark):
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_lm_scores_of_many_blocks_and_parts_send_no_row_for_a_word(spark, monkeypatch, tmp_path):
    """What is shuffled is rows of blocks, parts and documents, not of words and pairs, and scores are the same."""
    monkeypatch.setattr(lm_score, "HOT_ROWS", 5000)
    monkeypatch.setattr(lm_score, "BLOCK_SIZE", 40_000, raising=False)
    dice = random.Random(9)
    rows = [(k if k % 9 else None, " ".join(f"w{int(3000 * dice.random() ** 3)}" for _ in range(dice.randrange(1, 300)))) for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    good = spark.range(0, 400, 5).withColumnRenamed("id", "doc_id")
    before = shuffled_rows(spark)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.loss_target, r.score) for r in lm_score.score(spark.read.parquet(str(tmp_path / "d")), good).collect()), key=str)
    assert shuffled_rows(spark) - before < 2000
    ids = {x for x in range(0, 400, 5) if x % 9}
    want = lm_by_hand([((k, d), lm_score.tokens(t)) for k, (d, t) in enumerate(rows)], {(k, k) for k in ids})
    want = sorted(((d is None, d, *x) for (_, d), x in want.items()), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [y for x in got for y in x[3:]] == pytest.approx([y for x in want for y in x[3:]])


def test_lm_scores_of_string_ids(spark):
    d = spark.createDataFrame([("a", "one two three"), ("b", "two three four"), ("a", None)], "doc_id string, text string")
    got = lm_score.score(d, d.where("doc_id = 'b'")).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [("a", 0), ("a", 3), ("b", 3)]


def test_lm_scores_on_odd_input(spark, odd):
    got = {r.doc_id: r for r in lm_score.score(odd, spark.createDataFrame([(5,), (5,), (None,)], "doc_id long")).collect()}
    assert set(got) == {None, 1, 2, 3, 4, 5, 6, 7, 8} and got[1].n_tokens == 0 and got[1].score == 0
    assert lm_score.score(odd.limit(0), odd.select("doc_id")).count() == 0


# 9


def test_masks_find_nearly_all_ways_to_substitute_four_of_twenty_words():
    import itertools

    masks = [[j for j, x in enumerate(m) if x == "1"] for m in decontaminate.MASKS]
    seen = [any(all(i + j not in gone for j in m) for m in masks for i in range(12)) for gone in map(set, itertools.combinations(range(20), 4))]
    assert len(seen) == 4845 and sum(seen) == 4830


def test_leaks_bear_substitutions_and_leave_others(spark):
    item = " ".join(f"term{k}" for k in range(40))
    w = item.split()
    swapped = " ".join(x if k % 9 else "other" for k, x in enumerate(w))
    loose = " ".join(x if k % 2 else "other" for k, x in enumerate(w))
    d = spark.createDataFrame([(1, "before " + item.upper() + " after"), (2, "x y " + swapped), (3, loose), (4, "nothing of the kind " * 20), (5, " ".join(w[10:32])), (6, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, "too long to be here"), (9, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()) == [(1, 7), (2, 7), (5, 7)]
    assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == {3, 4, 6}


def test_short_items_must_stand_whole(spark, monkeypatch):
    import duckdb

    texts = {1: "So, what is the capital city of France? Paris.", 2: "what is the capital of france", 3: "Eureka!", 4: None, 5: "a-b c, D e f g H", 6: "eureka " * 3}
    items = {1: "Eureka", 5: "b c d e f", 8: "a b c d e f g h", 7: "what is the capital city of france", 9: "a b c d x f g h", 10: "", 11: None}
    d, b = spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = [(1, 7, 7, 7), (3, 1, 1, 1), (5, 5, 5, 5), (5, 8, 8, 8), (6, 1, 1, 1)]
    assert sorted((r.doc_id, r.item_id, r.matched, r.compared) for r in decontaminate.leaks(d, b).collect()) == want
    con = duckdb.connect()
    con.register("documents", d.toPandas())
    con.register("benchmark", b.toPandas())
    assert sorted((x["doc_id"], x["item_id"], x["matched"], x["compared"]) for x in con.execute(decontaminate.ORACLE).df().to_dict("records")) == want
    assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == {2, 4}
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 2)
    assert sorted((r.doc_id, r.item_id, r.matched, r.compared) for r in decontaminate.leaks(d, b).collect()) == want


def test_leaks_on_odd_input(spark, odd):
    b = odd.where("doc_id = 4").limit(1).select(F.col("doc_id").alias("item_id"), "text")
    assert sorted((str(r.doc_id), r.item_id) for r in decontaminate.leaks(odd, b).collect()) == [("4", 4), ("None", 4)]
    assert decontaminate.leaks(odd, b.limit(0)).count() == 0 and decontaminate.leaks(odd.limit(0), b).count() == 0


def test_leaks_in_several_passes_are_the_same(spark, sf_dir, docs, monkeypatch):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.leaks(docs, b).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 6000)  # in three passes
    assert sorted(map(tuple, decontaminate.leaks(docs, b).collect())) == want


# 10


def test_license_labels(spark):
    texts = {1: "Use it.\nReleased under the MIT License.\nEnd", 2: "gnu GENERAL-public license", 3: "This Source Code Form is subject to the terms of Mozilla Public License v. 2.0", 4: "cc  by", 5: None, 6: "the mit of the license"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(d).collect()}
    assert [got[k].labels for k in range(1, 7)] == ["mit", "gpl", "mpl-2.0", "cc-by", "", ""]
    assert (got[1].n_base, got[1].first_word, got[2].n_base, got[5].first_word) == (1, 5, 1, None) and got[3].score >= 0.8 and got[3].base_labels == ""


def test_wrapped_licenses_are_found(spark):
    """Notices over several lines, in comments, and with words between; not their words far apart."""
    by_label = dict(license_scan.TEMPLATES)
    wrapped = lambda label, n, lead: "\n".join(lead + " ".join(by_label[label].split()[i : i + n]) for i in range(0, len(by_label[label].split()), n))
    want = {1: "mit", 2: "bsd", 3: "isc", 4: "mpl-2.0", 5: "unlicense", 6: "bsd"}
    texts = {k: wrapped(label, 5, (" * ", "# ")[k % 2]) for k, label in want.items()} | {6: wrapped("bsd", 9, "REM "), 7: "\n\n".join(f"{w} " + "other " * 40 for w in by_label["bsd"].split()), 8: "mit " * 3000 + "\nend"}
    texts[2] = "first line\n" * 500 + texts[2] + "\nlast line" * 500
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {k: r.labels for k, r in got.items()} == want | {7: "", 8: ""}
    assert all(got[k].score == 1 for k in (1, 2, 3, 4, 5)) and got[6].score >= 0.8 and got[7].score == got[8].score == 0


def test_license_scan_on_odd_input(odd):
    got = license_scan.scan(odd)
    assert got.count() == odd.count() and got.where("doc_id <= 3").where("n_words > 0 OR labels <> ''").count() == 0
    assert license_scan.scan(odd.limit(0)).count() == 0
