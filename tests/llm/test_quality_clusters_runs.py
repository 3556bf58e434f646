"""Quality scores, centroid clusters and periodic runs against plain versions of their definitions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knownby.llm import periodic_runs, quality_ftrl, vantage_kmeans
from tests.llm.conftest import prose

# --- quality -------------------------------------------------------------------------------------------------


def plain_counts(text):
    """Counts of the n-grams of one text, as word tuples."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\x09-\x0d]+", text.encode())
    counts = {}
    for order in quality_ftrl.ORDERS:
        for i in range(len(words) - order + 1):
            key = tuple(words[i:i + order])
            counts[key] = counts.get(key, 0) + 1
    return counts


def bucket_of(gram):
    joined = b" ".join(gram)
    hashes, _ = quality_ftrl.word_hashes(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]))
    return int(quality_ftrl.grams(hashes, len(gram))[0])


TEXTS = ["a good text, a good text.", "", "BUY!! NOW!! now", "été | été | x1", "   ", "one"]


def test_examples_hold_every_gram_of_every_text():
    first, buckets, values = quality_ftrl.examples(pa.array(TEXTS, pa.large_string()))
    for i, text in enumerate(TEXTS):
        counts = plain_counts(text)
        weight = {bucket_of(g): 1 + math.log(c) for g, c in counts.items()}
        length = math.sqrt(sum(v * v for v in weight.values()))
        got = dict(zip(buckets[first[i]:first[i + 1]].tolist(), values[first[i]:first[i + 1]].tolist()))
        assert got == pytest.approx({b: v / length for b, v in weight.items()})


def test_a_long_text_is_counted_in_pieces_as_a_whole():
    text = pa.array([prose(3, 4000) + "!! " + "x" * 3000 + " " + prose(4, 500)], pa.large_string())
    whole = quality_ftrl.examples(text, limit=1 << 20)
    for limit in (5000, 20_000):
        assert all(np.allclose(a, b) for a, b in zip(whole, quality_ftrl.examples(text, limit=limit)))


def test_one_step_of_the_learner_is_that_of_the_formulas():
    settings = quality_ftrl.Settings(alpha=0.7, beta=1.3, l1=0.05, l2=0.2)
    state, z, n = quality_ftrl.State.empty(), {}, {}
    pick = np.random.default_rng(2)
    for _ in range(60):
        buckets = pick.choice(9, size=4, replace=False)
        values, label = pick.normal(size=4), int(pick.integers(2))
        quality_ftrl.learn(state, buckets, values, label, settings)
        example = {**dict(zip(buckets.tolist(), values.tolist())), quality_ftrl.BUCKETS: 1.0}
        w = {}
        for b in example:
            zi, ni = z.get(b, 0.0), n.get(b, 0.0)
            w[b] = 0.0 if abs(zi) <= settings.l1 else -(zi - math.copysign(settings.l1, zi)) / ((settings.beta + math.sqrt(ni)) / settings.alpha + settings.l2)
        p = 1 / (1 + math.exp(-sum(w[b] * x for b, x in example.items())))
        for b, x in example.items():
            g = (p - label) * x
            sigma = (math.sqrt(n.get(b, 0.0) + g * g) - math.sqrt(n.get(b, 0.0))) / settings.alpha
            z[b], n[b] = z.get(b, 0.0) + g - sigma * w[b], n.get(b, 0.0) + g * g
    for b in z:
        assert state.z[b] == pytest.approx(z[b]) and state.n[b] == pytest.approx(n[b])


def test_quality_of_held_out_texts(llm):
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(i, 60, 40).split()
        docs.append((i, "!! ".join(w.upper() for w in words) if bad else " ".join(words), "en"))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(None, "null id", "en"), (1000, None, "en"), (1001, "", "en"), (5, docs[5][1], "en")]
    labels += [(5, 1, 1), (7, 0, 0), (None, 0, 0), (9, None, 0), (1000, 1, 0), (4000, 1, 0)]
    df = llm.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("SCORE", F.lit("old"))
    told = llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_ftrl.fit(df, told, f"coalesce({quality_ftrl.HELD_OUT}, true)")
    again = quality_ftrl.fit(df.repartition(7), told.repartition(3), f"coalesce({quality_ftrl.HELD_OUT}, true)")
    assert np.array_equal(model, again)
    got = quality_ftrl.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "score"]
    rows = got.collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all((r.score >= 0.3) == (r.doc_id % 4 != 0) for r in held)
    constant = {r.score for r in rows if not r.text}
    assert len(constant) == 1 and 0 < constant.pop() < 1
    # A score is the logistic of the sum over the text's n-grams.
    row = next(r for r in rows if r.doc_id == 1)
    weight = {bucket_of(g): 1 + math.log(c) for g, c in plain_counts(row.text).items()}
    total = sum(v * float(np.float32(model[b])) for b, v in weight.items()) / math.sqrt(sum(v * v for v in weight.values())) + float(np.float32(model[-1]))
    assert row.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_quality_without_labels_or_rows(llm):
    df = llm.createDataFrame([(1, "a text")], "doc_id long, text string")
    model = quality_ftrl.fit(df, llm.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality_ftrl.predict(df, model).collect()] == [0.5]
    assert quality_ftrl.predict(df.limit(0), model).count() == 0


def test_labels_of_held_out_rows_are_not_learned(llm):
    docs = llm.createDataFrame([(i, prose(i, 30), "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = llm.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(F.expr(quality_ftrl.HELD_OUT), 1 - F.col("quality")).otherwise(F.col("quality")))
    held_out = f"coalesce({quality_ftrl.HELD_OUT}, true)"
    assert np.array_equal(quality_ftrl.fit(docs, labels, held_out), quality_ftrl.fit(docs, turned, held_out))


# --- clusters ------------------------------------------------------------------------------------------------


def plain_nearest(vectors, centroids):
    out = []
    for v in vectors:
        d = [sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids]
        out.append((d.index(min(d)), min(d)))
    return out


@pytest.mark.parametrize("k,spread,leaf", [(1, 50, 2), (2, 3, 1), (8, 2, 2), (40, 1000, 2), (40, 2, 3), (200, 400, 4)])
def test_tree_finds_the_nearest_with_ties_to_the_smaller_number(k, spread, leaf):
    pick = np.random.default_rng(k + spread)
    centroids = pick.integers(-spread, spread + 1, size=(k, 5))
    centroids[k // 2] = centroids[0]  # a repeated centroid never wins
    vectors = np.concatenate([pick.integers(-spread, spread + 1, size=(300, 5)), centroids])
    got = vantage_kmeans.VantageTree(centroids, leaf).nearest(vectors)
    assert list(zip(*(x.tolist() for x in got))) == plain_nearest(vectors, centroids)


def test_tree_prunes_clustered_centroids():
    pick = np.random.default_rng(8)
    centers = pick.integers(-100_000, 100_000, size=(16, 8))
    centroids = np.repeat(centers, 16, axis=0) + pick.integers(-100, 100, size=(256, 8))
    vectors = centroids[pick.integers(256, size=2000)] + pick.integers(-20, 20, size=(2000, 8))
    tree = vantage_kmeans.VantageTree(centroids)
    assert list(zip(*(x.tolist() for x in tree.nearest(vectors)))) == plain_nearest(vectors, centroids)
    assert tree.seen < 0.25 * 2000 * 256


def test_integers_of_any_size_stay_exact():
    x = np.array([[0.1, -0.1, 1e30, -1e30, 5e-324, -5e-324]])
    got = vantage_kmeans.integers(x, 1024)[0].tolist()
    assert got[:2] == [102, -103] and got[4:] == [0, -1] and got[2] == int(1e30) * 1024
    for value in (0, -1, 1 << 40, -(1 << 40), (1 << 200) + 7, -(1 << 200) + 7):
        parts = vantage_kmeans.limbs(value)
        assert sum(p << (vantage_kmeans.LIMB * i) for i, p in enumerate(parts)) == value and all(abs(p) < 1 << 42 for p in parts)


def plain_clusters(rows, k, rounds):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    firsts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centroids = [v for _, v in firsts]
    for _ in range(rounds):
        groups = {}
        for (i, v), (c, _) in zip(rows, plain_nearest([v for _, v in rows], centroids)):
            groups.setdefault(c, []).append(v)
        centroids = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else centroids[c] for c in range(len(centroids))]
    near = plain_nearest([v for _, v in rows], centroids)
    return sorted(((i, c, d) for (i, _), (c, d) in zip(rows, near)), key=str), centroids


def test_clusters_against_plain_rounds(llm):
    pick = np.random.default_rng(4)
    rows = [(i, (pick.normal(size=64) + 3 * (i % 4)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(3, rows[3][1]), (500, rows[0][1]), (None, rows[9][1]), (501, [0.0] * 64)]
    odd = [(600, None), (601, []), (602, [1.0] * 63), (603, [None] + [1.0] * 63), (604, [float("nan")] * 64), (605, [float("inf")] * 64)]
    df = llm.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("vector", F.lit(1)).repartition(5)
    assigned, centroids = vantage_kmeans.cluster(df, 6, vantage_kmeans.FIRST, 4)
    want, final = plain_clusters(rows, 6, 4)
    assert sorted((tuple(r) for r in assigned.collect()), key=str) == want and centroids == final
    totals = vantage_kmeans.with_totals(assigned, centroids).collect()
    for r in totals:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.inertia == sum(d for *_, d in want)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, final[r.cluster])).encode()).hexdigest()


def test_clusters_of_wide_few_and_no_vectors(llm):
    wide = [(1, [1e20] + [0.0] * 63), (2, [1e20] + [1.0] * 63), (3, [0.0] * 64), (4, [1e30] * 64)]
    df = llm.createDataFrame(wide, "vec_id long, embedding array<double>")
    assigned, centroids = vantage_kmeans.cluster(df, 2, vantage_kmeans.FIRST, 3)
    want, final = plain_clusters(wide, 2, 3)
    long = [(i, c, d if d < 1 << 63 else None) for i, c, d in want]
    assert sorted((tuple(r) for r in assigned.collect()), key=str) == sorted(long, key=str) and centroids == final
    assert {r.inertia for r in vantage_kmeans.with_totals(assigned, centroids).collect()} == {None}
    few = df.where("vec_id < 3")
    assert sorted(r.distance for r in vantage_kmeans.cluster(few, 8, vantage_kmeans.FIRST, 3)[0].collect()) == [0, 0]
    none, centroids = vantage_kmeans.cluster(df.limit(0), 8, vantage_kmeans.FIRST, 3)
    assert vantage_kmeans.with_totals(none, centroids).count() == 0
    unnamed = df.withColumn("vec_id", F.lit(None).cast("long"))
    assert vantage_kmeans.cluster(unnamed, 8, vantage_kmeans.FIRST, 3)[0].count() == 0


# --- runs ----------------------------------------------------------------------------------------------------


def plain_runs(words, exponent=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] == words[i + q]:
                j = i
                while j < n - q and words[j] == words[j + q]:
                    j += 1
                if j - i + q >= max(least, exponent * q):
                    found.setdefault((i, j - i + q), q)
                i = j
            else:
                i += 1
    return sorted((a, length, q) for (a, length), q in found.items())


def sequences(count, seed):
    pick = np.random.default_rng(seed)
    for _ in range(count):
        n, kind = int(pick.integers(0, 120)), pick.integers(4)
        if kind == 0:
            yield pick.integers(0, 2, n)
        elif kind == 1:
            yield np.tile(pick.integers(0, 3, max(1, n // 5)), 6)[:n]
        elif kind == 2:
            yield np.concatenate([np.tile(pick.integers(0, 2, int(pick.integers(1, 5))), int(pick.integers(1, 9))) for _ in range(4)])
        else:
            yield np.tile(np.concatenate([np.tile(pick.integers(0, 2, 2), 5), pick.integers(0, 4, 3)]), int(pick.integers(1, 8)))


@pytest.mark.parametrize("exponent,least", [(4, 6), (2, 2), (3, 1)])
def test_runs_of_words_appended_in_any_steps(exponent, least):
    pick = np.random.default_rng(exponent)
    for words in sequences(400, exponent):
        catcher, step = periodic_runs.RunCatcher(exponent, least), int(pick.integers(1, 40))
        for a in range(0, len(words), step):
            catcher.append(words[a:a + step])
        assert [tuple(r) for r in catcher.finish().tolist()] == plain_runs(words.tolist(), exponent, least)


def test_runs_survive_equal_hashes(monkeypatch):
    """Words decide: with a prefix sum that tells nothing, runs are the same."""
    words = next(w for w in sequences(50, 9) if len(plain_runs(w.tolist())) > 0)
    monkeypatch.setattr(periodic_runs, "mix", lambda x: x * np.uint64(0))
    catcher = periodic_runs.RunCatcher()
    catcher.append(words)
    assert [tuple(r) for r in catcher.finish().tolist()] == plain_runs(words.tolist())


def test_long_texts_are_quick():
    for words, want in ((np.zeros(300_000, np.int64), [(0, 300_000, 1)]), (np.tile(np.arange(20_000), 9), [(0, 180_000, 20_000)])):
        catcher = periodic_runs.RunCatcher()
        catcher.append(words)
        assert [tuple(r) for r in catcher.finish().tolist()] == want


def documents():
    texts = [None, "", " \t\n", "la " * 9, "a b a b a b a b c", prose(1, 300), "x y " * 7 + "z", "a a a a a a b b b b b b", "z " * 5, "Zz zz " * 4]
    return [(i, t, "en") for i, t in enumerate(texts)] + [(None, "q " * 8, "fr"), (3, texts[3], "en")] + [(i, " ".join(map(str, w)), "en") for i, w in enumerate(sequences(150, 3), 100)]


def plain_row(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = plain_runs(words)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_of_documents(llm):
    rows = documents()
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("RUNS", F.lit(1))
    got = periodic_runs.with_runs(df)
    assert got.columns == ["doc_id", "text", "lang", "n_words", "runs", "collapsed"]
    found = sorted(((r.text, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str)
    assert found == sorted(((t, *plain_row(t)) for _, t, _ in rows), key=str)
    assert periodic_runs.with_runs(df.limit(0)).count() == 0


def test_run_query_against_its_contract(llm, tmp_path):
    rows = documents()
    llm.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in periodic_runs.op13_periodic_runs(llm, str(tmp_path)).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        _, runs, kept = plain_row(" ".join(words))
        top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        want.append((doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == sorted(want, key=str)
