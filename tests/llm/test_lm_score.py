import math
import re
import zlib
from collections import Counter

import numpy as np

from seriescope.llm import lm_score

from .cases import PROSE, TEXTS, frame

END, START = object(), object()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [END]


def brute(texts):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in texts]
    seqs = [words(t) for _, t in texts]
    train = [s for s, h in zip(seqs, held) if not h]
    uni = Counter(w for s in train for w in s)
    bi = Counter(b for s in train for b in zip([START, *s[:-1]], s))
    ctx = uni + Counter({START: len(train)})
    n, v = sum(uni.values()), len(uni)
    bucket = lambda c: math.floor(math.log2(c)) + 1 if c > 0 else 0
    seen = {}
    for s in train:
        for b in zip([START, *s[:-1]], s):
            c = ctx[b[0]] - 1
            seen.setdefault(bucket(c), []).append(((bi[b] - 1) / c if c else 0.0, (uni[b[1]] - 1) / max(1, n - 1), 1 / (v + 1)))
    weights, last = {}, (0.0, 0.9, 0.1)
    for k in range(48):
        if k in seen:
            e, w = np.array(seen[k]), np.ones(3) / 3
            for _ in range(lm_score.STEPS):
                r = e * w
                w = (r / r.sum(1, keepdims=True)).mean(0)
            last = tuple(np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum())
        weights[k] = last
    rows = []
    for (i, _), h, s in zip(texts, held, seqs):
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in s)
        score = 0.0
        for b in zip([START, *s[:-1]], s):
            w, c = weights[bucket(ctx[b[0]])], ctx[b[0]]
            score += math.log10(w[0] * (bi[b] / c if c else 0) + w[1] * uni[b[1]] / n + w[2] / (v + 1))
        rows.append((i, h, len(s), sum(uni[w] > 0 for w in s), n, base, score))
    return rows


def test_scores_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "LEAST_BYTES", 3_000)
    texts = TEXTS + [(200 + i, PROSE.replace("dog", f"dog{i % 5}") + " more words " * (i % 4)) for i in range(60)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), *tuple(r)[1:]) for r in lm_score.scored(frame(spark, texts, extra=("block", "kind"))).collect())
    want = sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in brute(texts))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert np.allclose([g[6] for g in got], [w[6] for w in want], rtol=1e-4)


def test_words_that_polynomial_hashes_confuse(spark):
    """Two words of the Thue-Morse kind: any polynomial in their bytes modulo 2 ** 64 is the same for both."""
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = bits.translate(str.maketrans("ab", "ba"))
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:3]
    rows = lm_score.scored(frame(spark, [(train[0], f"{bits} {bits}"), (train[1], other), (train[2], "x")])).collect()
    want = {r[0]: r for r in brute([(train[0], f"{bits} {bits}"), (train[1], other), (train[2], "x")])}
    assert all(abs(r.base_score - want[r.doc_id][5]) < 1e-9 for r in rows)


def test_units_grow_with_the_root_of_the_corpus():
    assert lm_score.unit_bytes(1) == lm_score.LEAST_BYTES and lm_score.unit_bytes(10**18) == lm_score.MOST_BYTES
    assert lm_score.LEAST_BYTES < lm_score.unit_bytes(10**11) < lm_score.MOST_BYTES


def test_repeated_rows_and_rows_without_an_id(spark):
    texts = [(None, f"a b c {i % 5}") for i in range(1000)] + [(7, f"d e {i % 3}") for i in range(1000)] + [(8, "same text")] * 1000
    got = sorted((str(r.doc_id), *tuple(r)[1:5], round(r.base_score, 8), round(r.score, 3)) for r in lm_score.scored(frame(spark, texts)).collect())
    want = sorted((str(r[0]), *r[1:5], round(r[5], 8), round(r[6], 3)) for r in brute(texts))
    assert got == want


def test_a_sum_to_one():
    rng = np.random.default_rng(0)
    w = rng.dirichlet(np.ones(3), lm_score.BUCKETS)
    model = lm_score.Model(100, 9, w)
    word = rng.multinomial(100, np.ones(9) / 9).astype(float)
    both = rng.multinomial(20, np.ones(9) / 9).astype(float)
    p = 10 ** model.log10(np.append(both, 0), np.full(10, 20.0), np.append(word, 0))
    assert abs(p.sum() - 1) < 1e-9


def test_no_training_rows_and_no_rows(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    out = lm_score.scored(frame(spark, [(only, "a b c")])).collect()
    assert [tuple(r)[:6] for r in out] == [(only, True, 4, 0, 0, 0.0)]
    assert lm_score.scored(frame(spark, [])).count() == 0


def test_held_out_text_is_better_than_base(spark):
    rows = lm_score.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]
