"""Text operators against brute force, and their defined results for odd rows."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import exact, html_text, language, minhash, mixing, multi_index, packing, phrases, quality, token_counts
from barloom.llm import queries as Q
from barloom.llm.components import connected_components
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, key string, digest string, id int, n int, taken int"


def frame(spark, rows, extra=(7, "k", "d", 1, 2, 3)):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *extra) for i, t, lang, src in rows], DOCS)


def odd_rows():
    """Null, empty, blank and repeated texts, null and repeated ids, a very long text."""
    rng = random.Random(4)
    voc = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(60)]
    text = lambda n: " ".join(rng.choices(voc, k=n))
    base = [text(rng.randint(30, 90)) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    for i, t in enumerate(base[:8]):  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        rows.append((20 + i, " ".join(w), "de", None))
    rows += [(40, base[0], None, "s0"), (41, base[0].replace(" ", "\n\t"), "en", "s1"), (42, base[1] + "   ", "en", "s1")]
    rows += [(50, None, None, None), (51, "", "en", "s2"), (52, " \n\t ", "en", "s2"), (53, "one", "en", "s2"), (54, "One two", "en", "s2"), (55, "one two", "en", "s2")]
    rows += [(60, base[3], "en", "s0"), (60, base[3], "en", "s0"), (None, base[4], "en", "s0"), (None, "x y z", "en", "s0"), (70, "z " * 3000 + text(400), "en", "s1"), (71, "ünï cödé 日本 " * 30, "fr", "s1")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def by_row(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# --- exact duplicates -------------------------------------------------------
def exact_brute(rows):
    groups = {}
    for i, t, *_ in rows:
        t = t or ""
        bare = "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(bare, []).append((-len(t), i is None, i or 0))
    out = []
    for bare, members in groups.items():
        best = min(members)
        sha = hashlib.sha256(bare.encode()).hexdigest()
        out += [(None if m[1] else m[2], None if best[1] else best[2], len(members), sha) for m in members]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [exact.sha256, lambda b: hashlib.sha256(b).hexdigest()[:1]], ids=["sha256", "colliding"])
def test_exact_matches_brute_force(odd, digest):
    got = exact.assign(odd, salts=2, digest=digest).cache()
    want = exact_brute(odd_rows())
    if digest is exact.sha256:
        assert by_row(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert by_row(got, "doc_id", "keep_id", "group_size") == sorted((w[:3] for w in want), key=str)
    assert got.where("kept").count() == len({w[3] for w in want})


def test_exact_keeps_one_whole_row_of_each_group(odd, none):
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({w[3] for w in exact_brute(odd_rows())})
    assert exact.assign(none).count() == 0 and exact.deduplicate(none).count() == 0


# --- near duplicates --------------------------------------------------------
def near_brute(rows, percent=85):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = comp[a], comp[b]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    low = {}
    for c, (i, *_) in zip(comp, rows, strict=True):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    return sorted(((r[0], len(s), low.get(c)) for r, s, c in zip(rows, sets, comp, strict=True)), key=str), len(set(comp))


def test_minhash_matches_brute_force(odd, none):
    got = minhash.near_duplicates(odd).cache()
    want, n = near_brute(odd_rows())
    assert by_row(got, "doc_id", "n_shingles", "component_id") == want
    assert got.where("kept").count() == n
    kept = minhash.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == n
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_finds_links_that_the_first_of_a_bucket_does_not_show(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(90):  # a chain: neighbours are similar, ends are not
        w = list(words)
        for k in range(i // 3):
            w[k * 5 % 160] = f"x{k}"
        if i % 3:
            w[rng.randrange(160)] = f"y{i}"
        rows.append((1000 - i, " ".join(w), "en", "s"))
    got = minhash.near_duplicates(frame(spark, rows), params=minhash.MinHash(block=16))
    assert by_row(got, "doc_id", "n_shingles", "component_id") == near_brute(rows)[0]


def test_components_match_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(0, k) for k in range(400, 450)] + [(k, k + 1) for k in range(500, 560)] + [(7, 7)]
    par = {x: x for e in edges for x in e}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        par[b] = a
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long"))
    assert dict(map(tuple, got.collect())) == {x: find(x) for x in par}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- repeated passages ------------------------------------------------------
def phrase_brute(rows, size=20):
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            g = tuple(w[k:k + size])
            if g in seen:
                gone[k:k + size] = [True] * size
            seen.add(g)
        kept = b" ".join(x for x, d in zip(w, gone, strict=True) if not d)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [20000, 5], ids=["one shard", "many blocks"])
def test_phrases_match_brute_force(spark, odd, none, size):
    rows = [r for r in odd_rows() if r[0] is not None]
    rng = random.Random(6)
    shared = " ".join(rng.choices("abcdefghijklmnop", k=50))
    rows += [(100 + i, f"start{i} {shared} end{i} {shared if i % 2 else ''}", "en", "s") for i in range(9)]
    rows += [(120, "again " * 70, "en", "s"), (121, "p q r s " * 40, "en", "s")]
    rows = list(dict.fromkeys(rows))  # which of two rows with one id counts as the first is left open
    got = phrases.remove_repeats(frame(spark, rows).repartition(3), phrases=size, lot=size)
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == phrase_brute(rows)


def test_plain_copies_are_located_by_the_automata():
    """Words decide, not digests: a copy is found, another text with its digest is not."""
    one, other = b"a b c d", b"a b c e"
    rows = [(0, 0, 70, b"k", 1, False, False, one), (0, 0, 30, b"k", 1, False, False, one), (0, 0, 50, b"k", 1, False, False, other),
            (0, 0, 90, b"l", 2, True, False, other), (0, 1, 30, b"k", 1, False, True, one), (0, 1, 80, b"k", 1, False, False, one)]
    names = ["shard", "lot", "at", "key", "anchor", "inner", "model", "words"]
    batch = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}).combine_chunks().to_batches()[0]
    out = pa.Table.from_batches(list(phrases._repeats()(iter([batch.slice(0, 3), batch.slice(3)]))))
    got = {r["at"]: (r["cover"], r["words"]) for r in out.to_pylist()}
    assert got == {30: (None, one), 70: ([0, 4], None), 50: (None, other), 90: (None, other), 80: ([0, 4], None)}


def test_phrases_of_one_word_over_and_over(spark):
    """One anchor all along: passages are cut, what repeats is found across the cuts."""
    rows = [(1, "x " * 9000 + "y " * 30, "en", "s"), (2, "z " * 7 + "x " * 4300, "en", "s"), (3, "y " * 25, "en", "s")]
    got = phrases.remove_repeats(frame(spark, rows).repartition(2))
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == phrase_brute(rows)


def test_word_hashes_tell_words_apart():
    rng, hashes = random.Random(3), phrases.WordHashes()
    words = [bytes(rng.choices(b"ab\x00\xc3\xa9", k=rng.randint(1, 6))) for _ in range(3000)]
    h, starts, ends = hashes(b" ".join(words))
    text = b" ".join(words)
    assert [text[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)] == words
    by = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by) and len(hashes(b"")[0]) == 0
    assert hashes(b"x " * 100_000 + b"x")[0].tolist() == [hashes(b"x")[0][0]] * 100_001


def test_phrases_with_repeated_rows(spark):
    """Rows of one id follow each other in any order: the multiset of what is kept is the same."""
    rows = [r for r in odd_rows() if r[0] is not None]
    rows += [(200, "m n o p " * 10, "en", "s")] * 3 + [(201, "m n o p " * 12, "en", "s")]
    got = phrases.remove_repeats(frame(spark, rows).repartition(3))
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == phrase_brute(rows)


def test_phrases_odd_rows(odd, none):
    got = phrases.remove_repeats(odd)
    assert got.count() == odd.count()
    assert got.where("doc_id in (50, 51, 52)").select("n_words", "n_removed").distinct().collect() == [(0, 0)]
    assert phrases.remove_repeats(none).count() == 0


# --- vectors ----------------------------------------------------------------
def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(400):
        v = (centres[i % 40] + rng.normal(size=16) * rng.choice([0.02, 0.25])).tolist()
        rows.append((i, [float(np.float32(x)) for x in v], None if i % 50 == 3 else int(i % 3)))
    rows += [(400, rows[0][1], 0), (401, rows[0][1], 0), (402, None, 1), (403, [0.0] * 16, 1), (404, [math.nan] + [1.0] * 15, 1), (405, [None] + [1.0] * 15, 1), (406, [math.inf] + [1.0] * 15, 1), (407, [], 1), (408, [1.0, 2.0], 1), (409, [1.0, 2.0], 1), (None, rows[1][1], 1)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "vec_id long, embedding array<float>, label int, row int, cell int")
    got = multi_index.near_vectors(df, block=32, cell_rows=4).cache()
    ok = [r[2] is not None and bool(r[1]) and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1]) for r in rows]
    links, comp = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    p, q = comp[a], comp[b]
                    comp = [min(p, q) if c in (p, q) else c for c in comp]
    want = sorted(((r[0], n) for r, n in zip(rows, links, strict=True)), key=str)
    found = by_row(got, "vec_id", "n_links")
    assert sum(n for _, n in found) >= 0.99 * sum(links) and all(g[1] <= w[1] for g, w in zip(found, want, strict=True))
    if found == want:
        ids = {r.vec_id: r.component_id for r in got.collect() if r.vec_id is not None}
        assert all(ids[r[0]] == rows[c][0] for r, c in zip(rows, comp, strict=True) if r[0] is not None)
    assert got.where("kept").count() >= len(set(comp))
    assert multi_index.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim, flat", [(64, 8), (128, 8)])
def test_vectors_outside_a_hot_group_are_found(spark, dim, flat):
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    scale = np.where(rng.permutation(dim) < flat, 1, 0.02)
    hot = unit(rng.normal(size=(1, dim)) * scale) + rng.normal(size=(2000, dim)) * 1e-4
    a, p = (unit(rng.normal(size=(2000, dim)) * scale) for _ in range(2))
    p = unit(p - (p * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.93, 0.95, (2000, 1))
    x = np.concatenate([hot, a, c * a + np.sqrt(1 - c * c) * p])
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    n = np.array([r.n_links for r in multi_index.near_vectors(df, cell_rows=16).orderBy("vec_id").collect()])
    want = (unit(x) @ unit(x).T >= 0.93).sum(1) - 1
    outside = (np.arange(len(x)) >= 2000) & (want < 1000)
    assert (n <= want).all() and n[outside].sum() >= 0.998 * want[outside].sum()


def crowded(rng, hot, sparse, dim=64):
    """Unit vectors without direction, half of them with a partner near the threshold, and a tight group."""
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a, p = (unit(rng.normal(size=(sparse, dim))) for _ in range(2))
    p = unit(p - (p * a).sum(1, keepdims=True) * a)
    c = rng.uniform(0.93, 0.95, (sparse // 2, 1))
    near = c * a[::2] + np.sqrt(1 - c * c) * p[::2]
    x = np.concatenate([unit(rng.normal(size=(1, dim))) + rng.normal(size=(hot, dim)) * 1e-3, a, near]).astype(np.float32).astype(float)
    return x, (unit(x) @ unit(x).T >= 0.93).sum(1) - 1


def test_vectors_are_sent_once_or_twice(spark, monkeypatch):
    """F1 of round 4: a vector went to every cell it visited, ever more of them with the input."""
    x, want = crowded(np.random.default_rng(3), 100, 4000)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    written = {}
    write = multi_index.publish

    def count(table, name, **kw):
        out = write(table, name, **kw)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(multi_index, "publish", count)
    n = np.array([r.n_links for r in multi_index.near_vectors(df, cell_rows=8).orderBy("vec_id").collect()])
    assert (n <= want).all() and n.sum() >= 0.998 * want.sum()
    assert max(written.values()) <= len(x)


def test_regions_parts_and_waves_lose_no_link(spark):
    x, want = crowded(np.random.default_rng(4), 2000, 2000)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = multi_index.near_vectors(df, held=300_000, cell_rows=8).orderBy("vec_id").collect()  # the group alone is 512,000 bytes
    n = np.array([r.n_links for r in got])
    assert (n <= want).all() and n[2000:].sum() >= 0.998 * want[2000:].sum() and (n[:2000] == want[:2000]).all()
    assert {r.component_id for r in got[:2000]} == {0}


def test_units_hold_every_pair_of_a_region_once():
    rng = np.random.default_rng(2)
    x = multi_index._unit(rng.normal(size=(300, 8)))
    grid = multi_index.Grid(multi_index.codebook(x[:, :4], 3, 1), multi_index.codebook(x[:, 4:], 3, 2), 8)
    raw = pa.array([v.tobytes() for v in x], pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(["a"] * 300), pa.array([8] * 300, pa.int32()), raw, pa.array([1] * 300)], names=["row", "label", "dim", "vec", "times"])
    parts = {("a", 8, c): 1 + c % 3 for c in range(9)}
    out = [r for w in range(3) for b in multi_index._place(grid, 2.0, frozenset({("a", 8)}), parts, w, 3)([batch]) for r in b.to_pylist()]
    units = {}
    for r in out:
        units.setdefault((r["region"], r["part"], r["other"]), []).append(r)
    pairs = [tuple(sorted((p["row"], q["row"]))) for (_, i, j), u in units.items() for n, p in enumerate(u) for q in u[:n] if (p["home"] or q["home"]) and (i == j or p["late"] != q["late"])]
    assert len(pairs) == len(set(pairs)) == 300 * 299 // 2  # all, as no bound is over 2


def test_traversal_of_many_is_that_of_each():
    rng = np.random.default_rng(6)
    a, b = rng.random((50, 9)), rng.random((50, 7))
    n, i, j = multi_index.traverse(a, b, 0.5)
    assert sorted(zip(n.tolist(), i.tolist(), j.tolist(), strict=True)) == [tuple(t) for t in np.argwhere(a[:, :, None] + b[:, None] <= 0.5).tolist()]
    u, v = np.divmod(np.arange(400), 20)
    assert (multi_index.asks(u, v) ^ multi_index.asks(v, u) == (u != v)).all()


def test_reach_counts_each_query_once():
    found = np.zeros((300, 501))
    found[:100, 0], found[100:, 200] = 10_000, 1
    assert multi_index.reach(found, 0.999) >= 201 and multi_index.reach(found[:0], 0.999) == 0
    assert sorted(multi_index.spread_out(["hot"] * 98 + ["a", "b"], 3, 1))[1:] == [98, 99]


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(1)
    a, b = rng.random(9), rng.random(7)
    cells = multi_index.visit(a, b, 0.9)
    sums = [a[i] + b[j] for i, j in cells]
    assert sums == sorted(sums) and len(cells) == (a[:, None] + b <= 0.9).sum()


# --- quality and language ---------------------------------------------------
def test_quality_separates_held_out_documents(spark, odd, none):
    folder = SMALL.replace("0.001", "0.01")
    got = Q.queries()["op1_quality"](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    right = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert right[1] > 50 and right[0] > 0.9
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels, per_class=50, calibration=50)
    scores = odd.select("doc_id", quality.score(model).alias("score")).collect()
    assert len(scores) == odd.count() and all(0 <= r.score <= 1 for r in scores)
    assert none.select(quality.score(model)).count() == 0


def test_calibration_of_separable_labels_is_finite_and_right():
    rng = np.random.default_rng(3)
    for gap in (0.0, 0.5, 5.0):
        d, r = rng.normal(size=400), rng.normal(-1, 0.01, 400)
        y = (d + rng.normal(size=400) * (gap == 0) > 0).astype(float)
        x = quality._terms(d * 1e-3 + gap * 1e-3 * y, r)
        w = quality.logistic(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        assert np.isfinite(w).all() and ((p > 0.5) == y).mean() > (0.7 if gap == 0 else 0.98)


def test_quality_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert odd.select(quality.score(quality.fit(odd, labels)).alias("s")).distinct().collect() == [(0.5,)]
    one = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    assert odd.select(quality.score(quality.fit(odd, one)).alias("s")).first().s > 0.99


def test_language_of_held_out_documents(spark, odd, none):
    folder = SMALL.replace("0.001", "0.01")
    got = Q.queries()["op6_language"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    assert got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = language.fit(odd)
    p = {r.doc_id: r.p for r in odd.select("doc_id", language.predict(model).alias("p")).collect()}
    assert all(tuple(p[i]) == ("und", 0.0) for i in (50, 51, 52))
    assert p[71].lang == "fr" and all(0 <= x.score <= 1 for x in p.values())
    empty = odd.select(language.predict(language.fit(none)).alias("p")).select("p.lang").distinct().collect()
    assert empty == [("und",)]


def test_trigrams_depend_on_order():
    enc = language._Encoder(512, 7)
    cos = lambda x, y: float(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
    assert cos(enc.vector("abc abc"), enc.vector("abc")) > 0.9 > 0.5 > cos(enc.vector("abc"), enc.vector("cba"))


# --- pages ------------------------------------------------------------------
PAGES = [
    ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a>menu</a></nav>"
     "<article><h1>Head &amp; line</h1><p>First\n  <b>bold</b> text.<p>Short.</p><aside>no</aside></article><footer>foot</footer></body></html>",
     "Head & line\n\nFirst bold text.\n\nShort."),
    ("<body><div class='cookie-notice'>We use cookies, a lot of them, really a lot.</div><div id='content'><p>Main words here, quite many of them.</p>"
     "<p>More words of the text.</p><form><label>Name</label></form></div><div class='comments'><p>A reader says much, very much indeed.</p></div></body>",
     "Main words here, quite many of them.\n\nMore words of the text."),
    ("<article><p>A<br>B</p><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><!-- gone --></article>", "A B\n\none\n\ntwo\n\nx\n\ny"),
    ("plain words &lt;only&gt;", "plain words <only>"), ("<nav>menu</nav>", ""), ("", ""), (None, ""), ("<p", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_page_text(page, text):
    assert html_text.main_text(page) == text


LONG, LESS = "word " * 109 + "words", "text " * 89 + "texts"
WHOLE_PAGES = [  # lines of the page, all of which are the article's, and markup around them
    ("<div><section><p>{0}</p></section><section><p>{1}</p></section></div>", [LONG, LESS]),
    ("<body><h1>{0}</h1><div class=body><p>{1}</p><p>{2}</p></div></body>", ["Head", LONG, LESS]),
    ("<body><h1><a href=/>{0}</a></h1><div class=body><p>{1}</p></div></body>", ["Head", LONG]),
    ("<body><ul><li><a href=/a>menu</a><li><a href=/b>more</a></ul><div><h1>{0}</h1><p>{1}</p><p>{2}</p></div></body>", ["Head", "Few words.", LONG]),
    *((f"<div><p>{{0}}</p>{quote}<p>{{2}}</p></div>", ["Before.", LONG, "Behind it."]) for quote in (
        "<blockquote><p>{1}</p></blockquote>", "<ul><li>{1}</li></ul>", "<table><tr><td>{1}</td></tr></table>", "<pre>{1}</pre>")),
    ("<article><p>{0}</p></article><article><p>{1}</p></article><article>{2}</article>", [LONG, LESS, "Short."]),
    ("<main><h1>{0}</h1><article><p>{1}</p></article></main>", ["Head", LONG]),
    ("<div><section><p>{0}</p></section><section><p>{1}</p></section></div><div class=comments><p>no</p></div>", [LONG, "End."]),
]


@pytest.mark.parametrize("page, parts", WHOLE_PAGES)
def test_page_text_is_whole(page, parts):
    assert html_text.main_text(page.format(*parts)) == "\n\n".join(parts)


SIX = " ".join(f"Sentence {i} says something of the matter at hand." for i in range(6))
FOR_RATIOS = [  # markup that hints at other content, and what the smoothed ratio makes of it
    (f'<article><h1>Head</h1><p>{LONG}</p><p class="search">{SIX}</p><p>{LESS}</p></article>', ["Head", LONG, SIX, LESS]),
    (f'<article><h1>Head</h1><p>{LONG}</p><div class="share-of-market">{SIX}</div></article>', ["Head", LONG, SIX]),
    (f'<article><h1>Head</h1><p>{LONG}</p><section id="related-work">{SIX}</section></article>', ["Head", LONG, SIX]),
    (f'<body><div class="col-left"><p>Two for one today only</p></div><div><h1>Head</h1><p>{LONG}</p><p>{LESS}</p></div><div class="col-right"><p>Weather: mild</p></div></body>', ["Head", LONG, LESS]),
    (f'<body><div><p>{LONG}</p></div><div class="comments"><p>{SIX}</p></div></body>', [LONG]),
    (f'<article><p>{LONG}</p><div class="ad-box">Buy now and save</div><p>{LESS}</p></article>', [LONG, LESS]),
]


@pytest.mark.parametrize("page, parts", FOR_RATIOS)
def test_page_text_by_ratio(page, parts):
    assert html_text.main_text(page) == "\n\n".join(parts)


def test_smoothing_and_threshold_decide(monkeypatch):
    page = f'<article><p>{LONG}</p><p class="share">Passed on by word of mouth, it spread.</p><p>{LESS}</p></article>'
    assert "word of mouth" in html_text.main_text(page) and "word of mouth" not in html_text.main_text(page, sigma=0)
    column = FOR_RATIOS[3][0]
    assert "Weather" not in html_text.main_text(column)
    monkeypatch.setattr(html_text, "CUT", 0.0)
    assert "Weather" in html_text.main_text(column)


@pytest.mark.parametrize("page", [
    "<div>x" * 100_000, "<span>y" * 100_000 + "</b>" * 100_000, "<b>" + "<span>y" * 100_000 + "</b>" * 100_000, "<div><span>" * 50_000 + "<p>a" * 50_000, "<a href=x>" * 100_000 + "z"],
    ids=["nested", "stray ends", "unclosed", "unclosed inline", "links"])
def test_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    assert html_text.main_text(page)
    assert time.perf_counter() - start < 20


def test_pages_of_a_table(spark):
    df = spark.createDataFrame([(i, p, "t") for i, (p, _) in enumerate(PAGES)], "page_id long, html string, text string")
    assert [r.x for r in df.orderBy("page_id").select(html_text.extract().alias("x")).collect()] == [t for _, t in PAGES]
    got = Q.queries()["op4_html"](spark, SMALL).collect()
    assert all(r.text and len(r.text) == r.n_chars and "var t=" not in r.text for r in got)


# --- tokens -----------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(Q.vocabulary())


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_by_section(odd, none, tokenizer, rule):
    got = {}
    for r in token_counts.count(odd, Q.vocabulary(), rule=rule, end=r"\n|cha").collect():
        got.setdefault((r.doc_id, r.section), []).append((r.start, r.end, r.n_tokens))
    want = {}
    for i, t, *_ in odd_rows():
        t = t or ""
        bounds = token_counts.sections(t, __import__("re").compile(r"\n|cha")).tolist()
        n = [0] * (len(bounds) - 1)
        for s, e in tokenizer.encode(t, add_special_tokens=False).offsets:
            share = [min(e, bounds[k + 1]) - max(s, bounds[k]) for k in range(len(n))]
            where = {"overlap": int(np.argmax(share)), "start": max(k for k in range(len(n)) if bounds[k] <= s), "end": max(k for k in range(len(n)) if bounds[k] <= max(e - 1, s))}
            n[where[rule]] += 1
        for k in range(len(n)):
            want.setdefault((i, k), []).append((bounds[k], bounds[k + 1], n[k]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_counts.count(none, Q.vocabulary()).count() == 0


def test_ids_are_those_of_the_tokenizer(tokenizer):
    from barloom.llm.tokens import TextEncoder

    rng, enc = random.Random(1), TextEncoder(Q.vocabulary())
    bits = ["a", "Ab", " ", "  ", "\n", "\t", "'s", "é", "12", " ", "!", "\r\n", "日本", " ", "<|endoftext|>", "'ll", "_", "😀"]
    for _ in range(400):
        t = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        done = tokenizer.encode(t, add_special_tokens=False)
        assert enc.ids(t).tolist() == done.ids
        assert [tuple(x) for x in enc.spans(t).tolist()] == done.offsets


def test_long_white_space_is_encoded(spark, tokenizer):
    from barloom.llm.tokens import TextEncoder, long_space

    enc = TextEncoder(Q.vocabulary())
    texts = [f"a{c * 1_100_000}b" for c in " \n\u00a0"] + [" " * 1_100_000, "a b " * 200_000]
    assert [long_space(t) for t in texts] == [True] * 4 + [False]
    for t in texts:
        done = tokenizer.encode(t, add_special_tokens=False)
        assert enc.ids(t).tolist() == done.ids
        assert np.array_equal(enc.spans(t), done.offsets)
    docs = frame(spark, [(1, texts[0], "en", "s"), (2, "a b", "en", "s")])
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in (texts[0], "a b")]
    per = dict(token_counts.count(docs, Q.vocabulary()).groupBy("doc_id").agg(F.sum("n_tokens")).collect())
    assert [per[1], per[2]] == want
    assert packing.pack_documents(docs, Q.vocabulary()).agg(F.sum("length")).first()[0] == sum(want) + 2


def test_tokenizer_takes_over_when_the_fast_encoder_fails(tokenizer, monkeypatch):
    from barloom.llm import tokens

    monkeypatch.setattr(tokens, "LONG_SPACE", 10_000_000)
    t = f"a{' ' * 1_100_000}b"
    assert tokens.TextEncoder(Q.vocabulary()).ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_strings_of_added_tokens_are_the_tokens(spark, tokenizer):
    """The contract's tokenizer at its defaults: <|endoftext|> in a text is one id, in packing and in counts."""
    texts = ["<|endoftext|>", "hello <|endoftext|> world", "<|endoftext|><|endoftext|>\nx", "<|endoftext", "plain"]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [50256]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(docs, Q.vocabulary()).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want.items()}
    per = dict(token_counts.count(docs, Q.vocabulary()).groupBy("doc_id").agg(F.sum("n_tokens")).collect())
    assert per == {i: len(x) - 1 for i, x in want.items()}


def test_packing(odd, none, tokenizer):
    got = packing.pack_documents(odd, Q.vocabulary(), capacity=64, shard_items=12).collect()
    want = []
    for i, t, *_ in odd_rows():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[-1][0] + s[-1][1] <= 64
    assert packing.pack_documents(none, Q.vocabulary()).count() == 0


def test_genetic_packing_beats_or_meets_best_fit():
    rng = random.Random(8)
    for trial in range(5):
        sizes = [rng.choice([340, 341, 342, 170, 171, 511, 513, 100, 57]) for _ in range(300)]
        plain = packing.pack_best_fit(sizes, sorted(range(300), key=lambda i: -sizes[i]), 1024)
        best = packing.evolve(sizes, 1024, [], random.Random(trial), 6, 60)
        assert sorted(i for _, g in best for i in g) == list(range(300))
        assert all(f == 1024 - sum(sizes[i] for i in g) >= 0 for f, g in best)
        assert -(-sum(sizes) // 1024) <= len(best) <= len(plain)


# --- mixing -----------------------------------------------------------------
def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 400, "d": 5, "e": 0, "f": 300, "g": 77}
    df = spark.createDataFrame(list(sizes.items()), "key string, source_size long")
    got = {r.key: r.target for r in mixing.targets(df).collect()}
    left, open_, want = 1.5 * sum(sizes.values()), dict(zip(sorted(sizes), [5, 2, 1, 5, 2, 1, 5], strict=True)), {}
    while True:
        full = [k for k in open_ if left * open_[k] / sum(open_.values()) > 2 * sizes[k]]
        if not full:
            break
        level, total = left, sum(open_.values())
        k = min(full, key=lambda x: 2 * sizes[x] / open_[x])
        want[k] = 2.0 * sizes[k]
        left, _ = level - want[k], total
        del open_[k]
    want |= {k: left * w / sum(open_.values()) for k, w in open_.items()}
    assert got == pytest.approx(want)


def test_mix(odd, none):
    got = mixing.mix(odd, range_rows=1).cache()
    assert got.count() == odd.count() and got.where("taken < 0 or taken > 2 * size").count() == 0
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).collect()
    assert all(abs(r.t - r.target) <= 0.5 for r in per if r.source_size) and all(r.s % max(1, r.source_size) == 0 for r in per)
    assert by_row(got, "doc_id", "taken") == by_row(mixing.mix(odd.repartition(5), range_rows=4), "doc_id", "taken")
    taken = mixing.take(odd)
    assert taken.columns == odd.columns
    assert taken.select(F.sum(mixing.word_count("text"))).first()[0] == got.agg(F.sum("taken")).first()[0]
    assert taken.where("n_chars <> length(text)").count() == 0
    assert mixing.mix(none).count() == 0 and mixing.take(none).count() == 0


def test_mix_moves_texts_once(spark):
    """A task's slices of a text join are written for one shuffle, not for a look at what the join would give as well."""

    def written():
        jvm = spark.sparkContext._gateway
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()))

    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(160):x}" for _ in range(200)), f"s{i % 3}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).localCheckpoint()
    before, limit = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixing.take(docs).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert 0 < written() - before < 1.3 * sum(len(t) for _, t, _ in rows)


# --- pipeline ---------------------------------------------------------------
def test_pipeline_stages(spark, odd, tmp_path):
    docs = odd.select(*corpus_pipeline.DOCUMENT)
    folder = str(tmp_path)
    spark.createDataFrame([(i, 1 if i < 20 else 0, 0) for i in range(28)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    good = corpus_pipeline.keep_good(spark, odd, folder)
    assert good.columns == list(corpus_pipeline.DOCUMENT) and good.count() <= odd.count()
    docs = corpus_pipeline.drop_copies(spark, docs, folder).cache()
    assert docs.count() == len({w[3] for w in exact_brute(odd_rows())})
    near = corpus_pipeline.drop_near_copies(spark, docs, folder).cache()
    assert near.count() == near_brute([tuple(r)[:2] for r in docs.collect()], percent=corpus_pipeline.NEAR.percent)[1] and corpus_pipeline.NEAR.percent == 80
    mixed = corpus_pipeline.mix_sources(spark, near, folder).cache()
    assert mixed.columns == list(corpus_pipeline.DOCUMENT)
    packed = corpus_pipeline.pack(spark, mixed, folder)
    ids = lambda t: len(__import__("barloom.llm.tokens", fromlist=["encoder"]).encoder(Q.vocabulary()).ids(t or "")) + 1
    assert packed.agg(F.sum("length")).first()[0] == sum(ids(r.text) for r in mixed.collect())
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_runs_as_a_query(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    assert names["pipeline"](spark, SMALL).count() > 50
