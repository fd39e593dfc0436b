"""Suffix-array dedup, vector codes and periodic runs against brute force, and their edge cases."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tallyvane.llm import queries, runs, suffix_array, suffix_dedup, vector_codes

from .test_corpus import docs, exchanges_reused

# --- suffix arrays and dedup ---


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(400):
        small, t = rng.choice([4, 6, 12]), []
        for _ in range(rng.randint(0, 8)):
            e = [2] * rng.randint(0, 9) if rng.random() < 0.4 else [rng.randrange(2, small) for _ in range(rng.randint(0, 9))]
            if rng.random() < 0.6:
                e.insert(rng.randint(0, len(e)), small + rng.randrange(3))
            t += [*e, 1]
        t.append(0)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        sa = suffix_array.suffix_array(np.array(t, np.int32), small)
        assert sa.tolist() == want
        lcp, above = suffix_array.common_prefixes(np.array(t, np.int32), sa, 1)
        for i, j in zip(want[1:], want):
            v = 0
            while t[i + v] == t[j + v] and t[i + v] > 1:
                v += 1
            assert lcp[i] == v and above[i] == j
        s = [rng.randrange(1, rng.choice([2, 3, 9])) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_array.induced_order(s, max(s) + 1) == sorted(range(len(s)), key=lambda i: s[i:])


def removed(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = []
        for i, x in enumerate(gone):
            if x and not (i and gone[i - 1]):
                spans.append([i, i])
            if x:
                spans[-1][1] = i + 1
        yield [tuple(s) for s in spans], bytes(b for b, x in zip(t, gone) if not x)


@pytest.mark.parametrize("window,many_cells", [(400, suffix_dedup.HOT), (400, 2), (40, 2), (5, suffix_dedup.HOT)])
def test_repeated_strings_go(spark, window, many_cells):
    rng = random.Random(window + many_cells)
    alphabet = "ab cdeé" if window > 5 else "abcdefghijklmnopq rstuvw"
    some = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages, texts = [some(rng.randint(max(3, window - 20), window * 3)) for _ in range(12)], []
    for _ in range(150):
        t = some(rng.randint(0, 50))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a, b = (rng.randint(0, len(p) // 3) if rng.random() < 0.5 else 0 for _ in range(2))
            p = p[a : len(p) - b]
            if rng.random() < 0.3 and p:
                k = rng.randrange(len(p))
                p = p[:k] + "Z" + p[k + 1 :]
            t += p + some(rng.randint(0, 30))
        texts.append(t)
    texts += [texts[3], texts[3], None, "", "x" * 3000, "x" * 2990, "word " * 700, "ab" * 500 + "c" + "ab" * 600]
    ids = [None if k % 7 == 0 else 5 if k % 7 == 1 else k for k in range(len(texts))]  # ids may repeat or lack
    df = docs(spark, list(zip(ids, texts))).repartition(5)
    got = suffix_dedup.remove_repeats(df.withColumn("copy", df.text), window, ["doc_id", "copy", "_k"], with_spans=True, many_cells=many_cells).collect()
    want = sorted(zip([t or "" for t in texts], removed([(t or "").encode() for t in texts], window)))
    assert len(got) == len(texts)
    for row, (text, (spans, kept)) in zip(sorted(got, key=lambda r: r.copy or ""), want):
        assert (row.copy or "") == text and [tuple(s) for s in row.spans] == spans and bytes(row.kept) == kept
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(text.encode()), len(text.encode()) - len(kept), len(spans)) and row.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_repeated_strings_send_texts_once(spark):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = some(450)
    rows = [(k, some(50) + passage * (k % 2) + some(30)) for k in range(20)]
    reused, got = exchanges_reused(suffix_dedup.remove_repeats(docs(spark, rows)))
    kept = [hashlib.sha256(x).hexdigest() for _, x in removed([t.encode() for _, t in rows], 400)]
    assert reused == 1 and [r.kept_sha256 for r in sorted(got)] == kept and min(r.n_removed for r in got if r.doc_id % 2) >= 450


def test_repeated_strings_of_empty_table(spark):
    assert suffix_dedup.remove_repeats(docs(spark, [])).collect() == []


# --- vector codes ---


def plain_codes(vectors, parts, entries, rounds, scale):
    rows = [[int(np.floor(scale * float(x))) for x in v] for v in vectors]
    size = len(rows[0]) // parts
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for v in rows]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for v in cut:
                of.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(of[k]) for c in zip(*of[k])) if k in of else e for k, e in enumerate(books[p])]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    return [([k for _, k in f], sum(d for d, _ in f)) for f in found], books


@pytest.mark.parametrize("entries,rounds,spread", [(64, 2, 1.0), (8, 3, 0.02), (5, 1, 0.0)])
def test_vector_codes(spark, entries, rounds, spread):
    rng = np.random.default_rng(entries)
    vectors = (rng.normal(0, spread, (300, 32)) + rng.integers(-1, 2, (300, 1))).astype(np.float32)
    vectors[7] = vectors[3]
    rows = [(k * 3, v.tolist(), k % 4 or None, "clash") for k, v in enumerate(vectors)]
    bad = [(1, None, 1, ""), (4, [1.0, None], 1, ""), (7, [float("nan")] * 32, 1, ""), (10, [float("inf")] * 32, 2, "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int, codes string").repartition(4)
    coded, books = vector_codes.compress(df, ["vec_id", "label"], 8, entries, rounds)
    want, plain = plain_codes(vectors, 8, entries, rounds, 256)
    got = {r.vec_id: r for r in coded.collect()}
    assert len(got) == 300 and [[tuple(e) for e in b] for b in books.books.tolist()] == plain
    assert all(np.frombuffer(got[3 * k].codes, "<u2").tolist() == code and got[3 * k].error == error for k, (code, error) in enumerate(want))


def test_vector_codes_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = vector_codes.compress(make([]))
    assert coded.collect() == [] and books is None
    # fewer rows than entries, no id, repeated ids, short and empty vectors
    rows = [(1, [0.5] * 5, 1), (1, [0.5] * 5, 1), (None, [-2.0] * 20, None), (2, [], None)]
    coded, books = vector_codes.compress(make(rows))
    assert sorted(r.error for r in coded.collect()) == [0, 0, 0, 0] and books.books.shape == (16, 4, 2)
    with pytest.raises(ValueError):
        vector_codes.compress(make([(1, [1e9], 1)]))


def test_vector_codes_query(spark, tmp_path):
    rows = [(k, [0.1 * (k % 5)] * 16, k % 3 or None) for k in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_vector_codes(spark, str(tmp_path)).collect()
    assert len(got) == 40 and all(len(r.code) == 32 and r.error == 0 and r.label_error == 0 for r in got)
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.op12_vector_codes(spark, f"{tmp_path}/none").collect() == []


# --- periodic runs ---


def plain_runs(w, least, times):
    out = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def periodic(rng, n=90):
    w, kinds = [], rng.choice([1, 2, 3, 5])
    while len(w) < n:
        p = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
        w += p * rng.randint(1, 6) + p[: rng.randint(0, len(p))]
    return w[: rng.randint(0, n)]


def test_runs_of_sequences():
    rng = random.Random(1)
    for _ in range(1500):
        w, (least, times) = periodic(rng), rng.choice([(24, 3), (3, 3), (10, 4)])
        assert runs.runs_of(np.array(w, np.int64), least, times) == plain_runs(w, least, times)


class Counted(list):
    looks = 0

    def __getitem__(self, i):
        Counted.looks += 1
        return list.__getitem__(self, i)


def test_lyndon_arrays_take_linear_time():
    fib, b = [0], [0, 1]
    while len(b) < 6000:
        fib, b = b, b + fib
    shapes = [b[:6000], [1] * 6000, [0, 1, 0, 0, 1, 1, 0] * 800, [i.bit_count() & 1 for i in range(6000)], list(range(6000)), ([0] * 99 + [1]) * 60, (b[:80] * 20 + [3]) * 4, sum(([0] * k + [1] for k in range(100)), [])]
    for w in [*shapes, *([max(x) - c for c in x] for x in shapes)]:
        Counted.looks = 0
        after, _ = runs.lyndon_array(Counted([*w, -1]), len(w))
        assert Counted.looks <= 9 * len(w)
    w = [*b[:200], -1]
    after, extent = runs.lyndon_array(w, 200)
    for i in range(200):
        j = next(j for j in range(i + 1, 201) if w[j:] < w[i:])
        assert after[i] == j and extent[i] == next(k for k in range(201) if w[i + k] != w[j + k])


def test_ranks_of_words():
    rng = random.Random(5)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 90))) for _ in range(200)] + [b"a" * 200 + bytes([c]) for c in b"abcab"] + [b"a\0", b"a", b"a\0\0"]
    words *= 2
    raw, starts, ends, _ = runs.words_of([b" ".join(words)])
    ranks = runs.word_ranks(raw, starts, ends).tolist()
    assert len(set(ranks)) == len(set(words)) == len(set(zip(ranks, words)))


def test_periodic_runs(spark):
    rng = random.Random(4)
    rows = [(k, " \n".join("abcdef"[c] for c in periodic(rng))) for k in range(80)] + [(900, None), (901, ""), (902, "  \t"), (903, "go " * 20000), (904, "x" * 50000), (None, "a b " * 30), (5, "a b " * 30), (5, "a b " * 30)]
    df = docs(spark, rows).repartition(3)
    got = runs.find_runs(df.withColumn("copy", df.text).withColumn("runs", df.doc_id), ["doc_id", "copy"]).collect()
    assert len(got) == len(rows)
    for r in got:
        w = (r.copy or "").split()
        want = plain_runs(w, 24, 3) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert [tuple(x) for x in r.runs] == want and r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert runs.find_runs(docs(spark, [])).collect() == []


def test_strongest_run(spark):
    rng = random.Random(6)
    lists = [[(rng.randrange(90), rng.randrange(24, 99), rng.randrange(1, 9)) for _ in range(rng.randint(0, 6))] for _ in range(60)]
    lists = [sorted(x, key=lambda r: (r[0], r[2])) for x in lists]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], f"k int, runs {runs.RUNS}")
    for r in df.select("k", runs.strongest(df.runs).alias("best")).collect():
        want = min(lists[r.k], key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (tuple(r.best) if r.best else None) == want


def test_periodic_runs_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 300))), "en", "s", 0) for k in range(60)] + [(None, "a " * 30, "en", "s", 0), (70, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: (r[1] or "").split() for r in rows}
    planted = 0
    for r in got:
        w = texts[r.doc_id]
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            planted += 1
        want = plain_runs(w, 24, 3)
        best = min(want, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        gone = {i for s, n, q in want for i in range(s + q, s + n)}
        assert (r.n_runs, r.start, r.length, r.period) == (len(want), *best) and r.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()
    assert planted
