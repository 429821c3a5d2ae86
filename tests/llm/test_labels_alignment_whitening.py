"""Line labelling, tokenizer alignment and whitening against brute force, and their defined results for odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import alignment, line_labels, whitening
from barloom.llm import queries as Q
from barloom.llm.common import fold
from tests.conftest import SMALL
from tests.llm.test_operators import by_row, frame, odd_rows

A, B = Q.vocabulary(), Q.vocabulary(Q.PIECES)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# --- lines ------------------------------------------------------------------
def base_brute(text):
    """The counts of a text, written from their definitions."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


TEXTS = ["", None, " \n\t ", "a", "again " * 40, "p q r s t u v w x " * 3 + "z", "x\nx\n x\n\nx \ny|#<b>\r\ny|#<b>\r\n", "日本 ünï\x85cödé\xa0w " * 9,
         " ".join(map(str, range(30))), "one two\n" * 5, "a b c d e f g h\n" * 2 + "a b c d e f g h i", "end\n", "\n\nstart"]


@pytest.mark.parametrize("text", TEXTS)
def test_line_counts_match_brute_force(text):
    assert line_labels.Lines()(text)[0] == base_brute(text)


def test_line_counts_of_random_texts():
    rng, measure = random.Random(3), line_labels.Lines()
    for _ in range(300):
        t = "".join(rng.choices(["a ", "b ", "ab\n", "\t", "é ", "#", "a b a b a b a b ", "\n", "\xa0"], k=rng.randint(0, 60)))
        counts, x, w, _ = measure(t)
        assert counts == base_brute(t) and w.sum() == counts[0] and len(x) == len(w) and np.isfinite(x).all()


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        field = line_labels.LineField((0.0,), tuple(rng.normal(size=4).tolist()), tuple(rng.normal(size=2).tolist()))
        scores = rng.normal(size=n) * 2
        value = lambda y: field.first[y[0]] + sum(s for s, c in zip(scores, y, strict=True) if c) + sum(field.pairs[2 * a + b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert value([int(c) for c in line_labels.viterbi(scores.tolist(), field)]) == pytest.approx(value(best))
    assert line_labels.viterbi([], field) == []


def test_likelihood_sums_over_all_labellings():
    rng = np.random.default_rng(5)
    sizes = np.array([4, 3, 1])
    starts, x, y = np.array([0, 4, 7]), rng.normal(size=(8, 2)), rng.random(8) > 0.5
    weight, theta = np.array([1.0, 2.0, 0.5]), rng.normal(size=8)

    def value(rows, labels):
        s = theta[6 + labels[0]] + sum(theta[:2] @ x[r] for r, c in zip(rows, labels, strict=True) if c)
        return s + sum(theta[2 + 2 * a + b] for a, b in itertools.pairwise(labels))

    want = 0.5 * 0.3 * theta @ theta
    for s, n, w in zip(starts, sizes, weight, strict=True):
        rows = range(s, s + n)
        want += w * (np.log(sum(np.exp(value(rows, p)) for p in itertools.product((0, 1), repeat=n))) - value(rows, y[s:s + n].astype(int).tolist()))
    f = lambda v: line_labels.likelihood(v, x, y, starts, sizes, weight, 0.3)
    loss, grad = f(theta)
    assert loss == pytest.approx(want)
    for k in range(8):
        e = np.eye(8)[k] * 1e-6
        assert grad[k] == pytest.approx((f(theta + e)[0] - f(theta - e)[0]) / 2e-6, abs=1e-4)


def test_neighbours_decide_lines_that_say_nothing(spark):
    """A bland line between boilerplate is boilerplate, between content it is content."""
    good, bad = "The house is by the river today.", "BUY!! NOW!! ### $$$ 99%% ***"
    docs = [(i, "\n".join([good] * 6 if i % 2 else [bad] * 6), "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    field = line_labels.fit(frame(spark, docs), labels)
    bland = "Home Sale news"
    test = frame(spark, [(1, f"{good}\n{bland}\n{good}", "en", "s"), (2, f"{bad}\n{bland}\n{bad}", "en", "s"), (3, f"{good}\n{good}\n{bad}\n{bad}", "en", "s")])
    got = {r.doc_id: [x.content for x in r.lines] for r in line_labels.label_lines(test, field).collect()}
    assert got == {1: [True] * 3, 2: [False] * 3, 3: [True, True, False, False]}


def test_lines_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, 1) for i in range(12)] + [(70, 0), (71, 0), (None, 1), (3, None), (51, 0)], "doc_id long, quality int")
    field = line_labels.fit(odd, labels)
    got = line_labels.judge(line_labels.label_lines(odd, field)).cache()
    want = sorted(((i, *base_brute(t)) for i, t, *_ in odd_rows()), key=str)
    assert by_row(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.content_words == sum(x.n_words for x in r.lines if x.content) and sum(x.n_words for x in r.lines) == r.n_words
        assert r.kept == (not r.base_failed and 2 * r.content_words >= r.n_words)
    assert line_labels.label_lines(none, field).count() == 0
    assert line_labels.fit(none, labels) == line_labels.fit(odd, labels.limit(0))
    unlabelled = line_labels.label_lines(odd, line_labels.fit(odd, labels.limit(0)))
    assert unlabelled.where("content_words <> n_words").count() == 0


def test_lines_of_held_out_documents(spark):
    folder = SMALL.replace("0.001", "0.01")
    got = Q.queries()["op11_lines"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where(fold("doc_id", 5) == 0)
    good, bad = (got.where(f"quality = {q}").agg(F.avg(c.cast("int"))).first()[0] for q, c in ((1, F.col("kept") | (F.col("n_words") < 20)), (0, ~F.col("kept"))))
    assert good > 0.95 and bad > 0.95


# --- alignment --------------------------------------------------------------
@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(A, B)


def whole(both, text):
    """Tokens, groups and links of a text encoded as a whole, by decoded bytes and all pairs of tokens."""
    raw = (" " + (text or "")).encode()
    a = both.a.encode(" " + (text or ""), add_special_tokens=False).ids
    b = both.b.encode(text or "")
    if not text or b"".join(both.a_bytes[i] for i in a) != raw or b"".join(both.b_bytes[i] for i in b) != raw:
        return [], [], "", Counter()
    ae, be = (list(itertools.accumulate(len(v[i]) for i in x)) for x, v in ((a, both.a_bytes), (b, both.b_bytes)))
    groups, cut = [], 0
    for e in sorted(set(ae) & set(be)):
        groups.append("|".join(",".join(str(i) for i, x in zip(ids, ends, strict=True) if cut < x <= e) for ids, ends in ((a, ae), (b, be))))
        cut = e
    links = Counter((a[p], b[q]) for p in range(len(a)) for q in range(len(b)) if (ae[p - 1] if p else 0) < be[q] and (be[q - 1] if q else 0) < ae[p])
    return a, b, ";".join(groups), links


BITS = ["a", "Ab", " ", "  ", "\n", "\n\n", "\t", "'s", "é", "12", "!", "\r\n", "\r", "日本", "\xa0", "<|endoftext|>", "<s>", "</s>", "'ll", "_", "😀", "\x1c", "\x85",
        "x", "th", "\x00", "ü", "　", "\x0b", "\x0c", ");", "*/", "▁", "é", "‍"]


def test_words_are_encoded_as_in_whole_texts(both):
    rng, known = random.Random(5), alignment.Words(both, limit=300)
    for k in range(1500):
        t = "".join(rng.choices(BITS if k % 3 == 0 else BITS[:-4], k=rng.randint(0, 20)))
        x = known.numbers([t])[0]
        a, b, groups, links = whole(both, t)
        n = known.n[x].sum(0)
        if not a:
            assert not t or n[4]
            continue
        assert n.tolist() == [len(a), len(b), groups.count(";") + 1, sum(links.values()), 0]
        assert ";".join(known.groups[i] for i in x.tolist()) == groups
        assert Counter((c >> 32, c & 0xFFFFFFFF) for c in known.links(x).tolist()) == links
    assert len(known.index) < 400


def test_coarse_cuts_are_refined_inside_characters(both):
    text = " 日本 é😀\U0001f9ff x"
    a_ids, a_ends, b_ids, b_ends = both.cuts(text)
    assert a_ends.tolist() == list(itertools.accumulate(len(both.a_bytes[i]) for i in a_ids)) and b_ends[-1] == len(text.encode())
    assert len(set(b_ends.tolist())) == len(b_ids) and len(set(a_ends.tolist())) == len(a_ids)
    assert alignment.refine(np.array([3, 3, 3, 5]), np.array([1, 1, 1, 2])).tolist() == [1, 2, 3, 5]


def alignment_brute(both, rows):
    made = [(r[0], *whole(both, r[1])) for r in rows]
    docs = Counter(p for *_, links in made for p in links)
    best = {}
    for (a, _), n in docs.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(((i, len(a), len(b), groups.count(";") + bool(groups), sum(links.values()), sum(t for p, t in links.items() if docs[p] == best[p[0]]),
                    sum(t * docs[p] for p, t in links.items()), hashlib.sha256(groups.encode()).hexdigest() if groups else "") for i, a, b, groups, links in made), key=str)


@pytest.mark.parametrize("held", [1 << 20, 40, 0])
def test_alignment_matches_brute_force(spark, odd, none, both, held):
    rows = [r if r[0] != 70 else (70, "z " * 200 + "a <|endoftext|> b", *r[2:]) for r in odd_rows()] + [(80, "bad ▁ text", "en", "s"), (81, "😀é日本" * 20, "en", "s")]
    got = alignment.align_documents(frame(spark, rows).repartition(3), A, B, held=held)
    assert by_row(got, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == alignment_brute(both, rows)
    assert alignment.align_documents(none, A, B, held=held).count() == 0


def test_alignment_gives_groups_and_their_ends(odd, both):
    rows = {(r.doc_id, r.n_a): r for r in alignment.align(odd, A, B, ends=True).collect()}
    for i, t, *_ in odd_rows():
        a, _, groups, links = whole(both, t)
        r = rows[i, len(a)]
        assert r.groups == groups and len(r.group_ends) == r.n_groups and (not a or r.group_ends[-1] == len(t.encode()) + 1)
        codes, times = alignment.unpack_links(r.links, __import__("zstandard").ZstdDecompressor().decompress)
        assert Counter({(c >> 32, c & 0xFFFFFFFF): n for c, n in zip(codes.tolist(), times.tolist(), strict=True)}) == links


def test_very_long_texts_are_aligned(both):
    known = alignment.Words(both)
    for t in ("z" * 30_000, " " * 30_000 + "a", "ab cd " * 20_000, "é" * 20_000):
        x = known.numbers([t])[0]
        a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
        assert known.n[x].sum(0)[:2].tolist() == [len(a), len(b)] and not known.n[x][:, 4].any()


# --- whitening --------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3.0) for i, v in rows], "vec_id long, embedding array<double>, n int, component int, whitened double")


def whiten_brute(rows, k=32):
    kept = [(i, v) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(0)
    z = (n * x - s).astype(float) / n
    cov = z.T @ z / n
    values, u = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return [i for i, _ in kept], ((n * x - s) ** 2).sum(1), z @ u[:, order] / np.sqrt(values[order]), values[order] / cov.trace()


@pytest.mark.parametrize("d", [3, 12, 40])
def test_whitening_matches_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    x = rng.normal(size=(300, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 50
    rows = list(enumerate(x.tolist())) + [(900, None), (901, [None, *x[0].tolist()[1:]]), (902, [math.nan, *x[0].tolist()[1:]]), (903, [math.inf, *x[0].tolist()[1:]]), (904, []), (905, [1.0] * (d + 1))]
    rows += [(0, x[0].tolist()), (None, x[1].tolist())]
    got = whitening.whiten_long(vectors(spark, rows).repartition(4)).toPandas()
    ids, deviation, white, share = whiten_brute([r for r in rows if r[0] != 905])
    k = min(32, d)
    assert len(got) == len(ids) * k and set(got.n) == {len(ids)} and got.identity_error.max() < 1e-9
    assert sorted(got.drop_duplicates(["vec_id", "deviation"])["deviation"]) == sorted({(i, v): v for i, v in zip(ids, deviation, strict=True)}.values())
    first = got[got.vec_id == 5].sort_values("component")
    sign = np.sign(first.whitened.to_numpy() * white[5])
    assert np.allclose(first.explained, share, rtol=1e-9)
    for i in (1, 17, 250):
        one = got[got.vec_id == i].sort_values("component").whitened.to_numpy()
        assert np.allclose(one * sign, white[i], atol=1e-7)


def test_whitening_of_degenerate_tables(spark):
    df = lambda rows: vectors(spark, rows)
    assert whitening.whiten_long(df([])).count() == 0 and whitening.fit(df([(1, None)])) is None
    assert whitening.whiten_long(df([(1, [1.0, 2.0])])).count() == 0  # one vector has no variance
    assert whitening.whiten_long(df([(1, [1.0, 2.0])] * 5)).count() == 0
    flat = whitening.whiten_long(df([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)])).toPandas()  # rank one
    assert set(flat.component) == {1} and flat.identity_error.max() < 1e-9 and flat.explained.iloc[0] == pytest.approx(1)
    huge = whitening.whiten_long(df([(i, [1e300 * (-1) ** i, float(i)]) for i in range(8)])).toPandas()
    assert len(huge) == 8 and huge.identity_error.max() < 1e-4 and huge.deviation.isna().all()


def test_jacobi_of_a_pivoted_factor_keeps_small_eigenvalues():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    values = 10.0 ** -np.linspace(0, 10, 30)
    a = (q * values) @ q.T
    f = whitening.pivoted_cholesky((a + a.T) / 2)
    assert np.abs(f @ f.T - a).max() < 1e-15
    g = whitening.jacobi(f)
    found = (g * g).sum(0)
    assert np.allclose(found, values[:len(found)], rtol=1e-5) and len(found) == 30
    unit = g / np.sqrt(found)
    assert np.abs(unit.T @ unit - np.eye(30)).max() < 1e-12


def test_new_queries_run(spark):
    for name, n in (("op11_lines", "documents"), ("op12_alignment", "documents")):
        assert Q.queries()[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{n}.parquet").count()
    assert Q.queries()["op13_whitening"](spark, SMALL).count() == 32 * spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
