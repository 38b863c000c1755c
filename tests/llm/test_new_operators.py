"""Whitening, runs and byte-level BPE against brute force, and odd input."""

import base64
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm.bpe import Vocabulary, bpe_digest, decode_bpe, decode_texts, encode_bpe, encode_texts
from tessera.llm.queries import op11_whitening, op12_periodic_runs, op13_byte_bpe
from tessera.llm.runs import find_runs, lyndon_lengths, periodic_runs, runs_digest, runs_of_texts, with_periodic_ends
from tessera.llm.whitening import codes, fit_whitening, polar_factor, principal_components, whiten, whitening_digest

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def sha(x):
    return hashlib.sha256(x).hexdigest()


# --- byte-level BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary.read(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(2)
    return [
        "", " ", "a", "it's  we'LL \n\n x", "<|endoftext|>", "a" * 5000, "ab" * 3000, "=" * 9000, "你好，世界" * 400, " " * 3000 + "x", "é́‍🙂🇩🇪" * 50,
        "".join(r.choice("etaoinshrdlu") for _ in range(3000)), "".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(4000)),
        *("".join(r.choice("aab") for _ in range(r.randrange(2049, 2600))) for _ in range(5)), *("".join(r.choice("aab z") for _ in range(r.randrange(1, 700))) for _ in range(60)),
    ]


def test_bpe_equals_the_library_on_odd_texts(vocab, other):
    texts = odd_texts()
    got = encode_texts(texts, vocab)
    assert got == [struct.pack(f"<{len(x)}I", *x) for x in map(other.encode_ordinary, texts)]
    assert decode_texts(got, vocab) == [t.encode() for t in texts]


def test_bpe_equals_the_library_on_every_character(vocab, other):
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}b" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    assert encode_texts(texts, vocab) == [struct.pack(f"<{len(x)}I", *x) for x in map(other.encode_ordinary, texts)]


def test_bpe_equals_the_library_on_joined_tokens(vocab, other):
    r = random.Random(5)
    tokens = list(vocab.whole)
    texts = [b"".join(r.choice(tokens) for _ in range(r.randrange(1, 30))).decode("utf-8", "ignore") for _ in range(3000)]
    assert encode_texts(texts, vocab) == [struct.pack(f"<{len(x)}I", *x) for x in map(other.encode_ordinary, texts)]


def test_bpe_of_long_texts_is_taken_in_pieces(vocab, other, monkeypatch):
    from tessera.llm import bpe

    monkeypatch.setattr(bpe, "BLOCK", 100)
    monkeypatch.setattr(bpe, "PIECES", 7)
    texts = ["one two 'tis  three\n" * 40, "", "short", "word " * 300]
    assert encode_texts(texts, vocab) == [struct.pack(f"<{len(x)}I", *x) for x in map(other.encode_ordinary, texts)]


def test_small_vocabulary_against_plain_merging():
    r = random.Random(4)
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 300:  # any strings of a and b, so that merges may lead to lower ranks
        t = bytes(r.choice(b"ab") for _ in range(r.randrange(2, 6)))
        ranks.setdefault(t, len(ranks))
    vocab = Vocabulary.of(ranks, r"[ab]+|.")

    def plain(word):
        if word in ranks:
            return [ranks[word]]
        parts = [bytes([b]) for b in word]
        while True:
            found = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if found is None:
                return [ranks[p] for p in parts]
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]

    texts = ["".join(r.choice("ab") for _ in range(n)) for n in [*range(1, 60), 300, 2500, 2600]]
    for text, got in zip(texts, encode_texts(texts, vocab), strict=True):
        assert list(np.frombuffer(got, "<u4")) == plain(text.encode())


def test_bpe_rows(spark, other, vocab):
    rows = [(1, "some text", "x"), (1, "some text", "y"), (None, "other", None), (3, None, "z"), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode_bpe(encode_bpe(docs, vocab), vocab)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted((r["doc_id"] or 0, bytes(r["ids"]), bytes(r["decoded"])) for r in out.collect())
    assert got == sorted((i or 0, np.array(other.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert bpe_digest(out.filter("false")).count() == 0
    with pytest.raises(ValueError, match="single byte"):
        Vocabulary.of({b"a": 0}, ".")
    with pytest.raises(ValueError, match="no token"):
        decode_texts([struct.pack("<I", 60000)], vocab)


def test_op13_equals_the_library(spark, tmp_path, other):
    docs = [(i, t) for i, t in enumerate([*odd_texts(), None])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op13_byte_bpe(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in docs:
        ids = other.encode_ordinary(t or "")
        want[i] = (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha((t or "").encode()))
    assert got == want


# --- runs ---------------------------------------------------------------------------------


def brute_runs(w, least):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i >= p and j + p - i >= least:
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def test_lyndon_lengths_against_the_definition():
    r = random.Random(3)
    for _ in range(300):
        word = [r.randrange(r.choice([1, 2, 3, 6])) for _ in range(r.randrange(0, 13))]
        for falling in (False, True):
            v = [-x for x in word] if falling else word
            want = [max(e - i for e in range(i + 1, len(v) + 1) if all(v[i:e] < v[i + k : e] for k in range(1, e - i))) for i in range(len(v))]
            assert lyndon_lengths(word, falling) == want


def test_runs_against_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        k, least = r.choice([1, 2, 2, 3, 4]), r.choice([2, 3, 6, 12])
        parts = [[r.randrange(k) for _ in range(r.randrange(0, 40))] for _ in range(3)]
        assert [tuple(x) for x in find_runs(parts, least).tolist()] == [(i, *x) for i, p in enumerate(parts) for x in brute_runs(p, least)]


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("word", [[0] * 400, [0, 1] * 200, list(range(300)), list(range(300, 0, -1)), thue_morse(512), fibonacci(377), [*range(20)] * 12, [0] * 50 + [1] + [0] * 50])
def test_runs_of_extreme_words(word):
    assert [tuple(x[1:]) for x in find_runs([word], 2).tolist()] == brute_runs(word, 2)


def check_texts(texts, found, least):
    for text, (runs, collapsed) in zip(texts, found, strict=True):
        w = text.split()
        assert runs == brute_runs(w, least)
        drop = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert collapsed == b" ".join(x for i, x in enumerate(w) if i not in drop)


def test_runs_of_texts_against_brute_force(monkeypatch):
    r = random.Random(6)
    for _ in range(300):
        k, least = r.choice([1, 2, 3, 6]), r.choice([2, 5, 12])
        # words that differ in case alone are different words
        texts = [" ".join(r.choice(["w", "W", "w", "w"]) + str(r.randrange(k)) for _ in range(r.randrange(0, 60))).encode() for _ in range(4)]
        check_texts(texts, runs_of_texts(texts, least), least)
    from tessera.llm import runs, tokens

    monkeypatch.setattr(runs, "BLOCK", 50)
    monkeypatch.setattr(tokens, "BLOCK", 50)
    for _ in range(100):  # long texts, hashed in pieces
        texts = [" ".join(f"w{r.randrange(3)}" for _ in range(r.randrange(0, 150))).encode()]
        check_texts(texts, runs_of_texts(texts, 12), 12)


def test_op12_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    docs = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(0, 90)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b " * 20), (1004, "x " * 12), (1005, "x " * 11), (1006, "a b c d e f g " * 2), (10**12, "z")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    planted = 0
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute_runs(w, 12)
        drop = {k for s, m, p in runs for k in range(s + p, s + m)}
        x = got[i]
        best = min(runs, key=lambda t: (-t[1], t[0], t[2]), default=None)
        assert x["n_runs"] == len(runs)
        assert (x["start"], x["length"], x["period"], x["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert x["runs_sha256"] == sha("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode())
        assert x["collapsed_sha256"] == sha(" ".join(v for k, v in enumerate(w) if k not in drop).encode())
    assert planted > 20


def test_runs_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b " * 9, 1), (7, None, 2), (7, "a b " * 9, 3), (7, "a b " * 9, 3)], "doc_id long, text string, runs int")
    out = periodic_runs(docs)
    assert out.columns == ["doc_id", "runs", "collapsed"]
    assert sorted((r["doc_id"] or 0, len(r["runs"]), r["collapsed"]) for r in out.collect()) == [(0, 1, "a b"), (7, 0, ""), (7, 1, "a b"), (7, 1, "a b")]
    assert runs_digest(periodic_runs(docs.filter("false"))).count() == 0
    assert with_periodic_ends(docs.filter("doc_id is null")).first()["text"] == "a b " * 9
    with pytest.raises(ValueError, match="two words"):
        periodic_runs(docs, least=1)


# --- whitening ----------------------------------------------------------------------------


def spectra(r):
    for n in (1, 2, 3, 17, 40, 64):
        q = np.linalg.qr(r.standard_normal((n, n)))[0]
        for e in (r.random(n), 10.0 ** r.uniform(-12, 2, n), np.r_[np.ones(n // 2), np.full(n - n // 2, 3.0)], np.zeros(n), np.r_[r.random(n - n // 3), np.zeros(n // 3)]):
            yield q @ np.diag(e) @ q.T


def test_components_equal_a_dense_solver():
    for a in spectra(np.random.default_rng(0)):
        a = (a + a.T) / 2
        values, v = principal_components(a)
        size = max(np.linalg.norm(a), 1e-300)
        assert np.all(np.diff(values) <= 1e-15 * size)
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * size
        assert np.linalg.norm(a @ v - v * values) <= 1e-13 * size
        assert np.linalg.norm(v.T @ v - np.eye(len(a))) <= 1e-12


def test_polar_factor_of_ill_conditioned_matrices():
    r = np.random.default_rng(1)
    for n, smallest in ((5, 1e-3), (30, 1e-9), (60, 1e-14)):
        q = np.linalg.qr(r.standard_normal((n, n)))[0]
        signs = r.choice([-1.0, 1.0], n)
        a = (q * (signs * np.geomspace(smallest, 1, n))) @ q.T
        u = polar_factor((a + a.T) / 2)
        assert np.linalg.norm(u @ u - np.eye(n)) < 1e-12
        assert np.linalg.norm(u - (q * signs) @ q.T) < 1e-13 / smallest


def test_op11_against_numpy(spark, tmp_path):
    r = np.random.default_rng(2)
    base = (r.standard_normal((300, 20)) @ r.standard_normal((20, 20)) + 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(200)]
    odd = [(5000, None), (5001, [None] * 20), (5002, [float("nan")] + [0.0] * 19), (5003, [float("inf")] + [0.0] * 19), (5004, [1e30] + [0.0] * 19), (5005, []), (5006, [1.0] * 19)]
    spark.createDataFrame(rows + odd + [(None, base[1].tolist())], "vec_id long, embedding array<float>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = op11_whitening(spark, str(tmp_path)).collect()
    x = np.floor(64 * base.astype(np.float64)).astype(np.int64) + 1000000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    z = fit - s / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    by_id = {}
    for g in got:
        by_id.setdefault(g["vec_id"], []).append(g)
    assert set(by_id) == {*range(300), *range(1000, 1200), None}
    assert {len(v) for v in by_id.values()} == {16}
    y = (x - s / n) @ vectors[:, :16] / np.sqrt(values[:16])
    mine = np.array([[g["whitened"] for g in sorted(by_id[i], key=lambda g: g["component"])] for i in range(300)])
    assert np.abs(mine * np.sign((mine * y).sum(0)) - y).max() < 1e-9
    for i in range(300):
        assert {(g["n"], g["deviation"]) for g in by_id[i]} == {(n, int(((n * x[i] - s) ** 2).sum()))}
    share = {g["component"]: g["explained"] for g in got}
    assert np.abs(np.array([share[k] for k in range(1, 17)]) / (values[:16] / values.sum()) - 1).max() < 1e-9
    errors = {g["identity_error"] for g in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_of_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>, x int, whitened int"
    none = spark.createDataFrame([(1, None, 0, 0)], schema)
    fit = fit_whitening(none)
    assert fit is None and whitening_digest(whiten(none, fit), fit).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, 0), (2, [1.0, 2.0], 0, 0)], schema)
    fit = fit_whitening(one)
    rows = whitening_digest(whiten(one, fit), fit).collect()
    assert len(rows) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(1, 0, None, None, None)}
    flat = spark.createDataFrame([(i, [float(i), 5.0, 0.0], 0, 0) for i in range(10)], schema)  # one dimension varies
    fit = fit_whitening(flat)
    rows = whitening_digest(whiten(flat, fit), fit).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in rows) and fit.identity_error < 1e-12


def test_deviations_stay_exact_beyond_a_long(spark):
    far = spark.createDataFrame([(i, [float(3 ** (i % 30)), float(-(7 ** (i % 15)))]) for i in range(60)], "vec_id long, embedding array<double>")
    fit = fit_whitening(far)
    x = {r["vec_id"]: r["x"] for r in far.select("vec_id", codes(far["embedding"]).alias("x")).collect()}
    got = {r["vec_id"]: r["deviation"] for r in whiten(far, fit).collect()}
    assert {i: int(d) for i, d in got.items()} == {i: sum((fit.n * a - s) ** 2 for a, s in zip(v, fit.sums, strict=True)) for i, v in x.items()}
