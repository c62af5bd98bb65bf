import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from seriescope.llm import suffix_dedup

from .cases import TEXTS, frame


def brute(texts):
    last = 2**63 - 1
    first = {}
    rows = [((last if i is None else i), i, (t or "").encode()) for i, t in texts]
    for key, _, t in rows:
        for p in range(len(t) - 99):
            w = t[p : p + 100]
            first[w] = min(first.get(w, (last, last)), (key, p))
    out = Counter()
    for key, i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if first[t[p : p + 100]] < (key, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[(i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def copies(seed=0, n=60):
    """Texts that share passages of about the critical length, with edits, over a small alphabet of words."""
    rng = random.Random(seed)
    words = ["alpha", "be", "gamma", "delta's", "ë", "of", "the", "zeta\n"]
    prose = lambda k: " ".join(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.7 else "") for _ in range(k))
    shared = [prose(rng.randrange(10, 60)) for _ in range(6)]
    out = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.6 else prose(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))]
        t = " ".join(parts)
        if rng.random() < 0.4 and len(t) > 50:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        out.append((1000 + i, t))
    rng.shuffle(out)
    return out + [(2000, "ab" * 300), (2001, "a" * 150), (2002, "a" * 99), (2003, "a" * 100), (1001, "other " + shared[0]), (2004, "x\0y" * 60)] + [(3000, shared[1] * 3 + x) for x in ("p", "q", "")] + [(999, "z" + shared[1] * 3)] + [(3001, shared[2] + "new " + x) for x in ("p" * 120, "q" * 120)]


@pytest.mark.parametrize("hot,slice_bytes,share", [(8192, 2 << 20, 0.002), (8192, 700, 0.002), (1, 2 << 20, 0.002), (1, 700, 0.0001), (8192, 2 << 20, 0.0001)])
def test_against_brute_force(spark, monkeypatch, hot, slice_bytes, share):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "PART_CONTEXTS", 3)
    monkeypatch.setattr(suffix_dedup, "PART_CLASSES", 500)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4_000)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 2_000)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", share)
    texts = copies() + [r for r in TEXTS if r[0] not in (10, 11, 12)] + [(12, "x" * 700)]
    got = Counter(map(tuple, suffix_dedup.deduplicated(frame(spark, texts, extra=("loc", "n"))).collect()))
    assert got == brute(texts)


def test_rows_without_an_id_share_nothing(spark):
    """Null and repeated ids with texts of their own, beside copies; and hot lines that texts go on from differently."""
    rng = random.Random(8)
    line = "this is the very common line that countless texts of the table begin with, and go on from as they like, each "
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, line + " ".join(word() for _ in range(rng.randrange(2, 20)))) for i in range(600)]
    texts += [(None, texts[0][1]), (7, texts[1][1]), (5000, texts[2][1]), (None, texts[4][1])]
    assert Counter(map(tuple, suffix_dedup.deduplicated(frame(spark, texts)).collect())) == brute(texts)
    assert len(suffix_dedup.hot_anchors(frame(spark, texts).selectExpr("doc_id", "text", "xxhash64(text) as h"))) >= 1


def test_local_parts_against_brute_force():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 50, 3000):
        data = rng.integers(97, 99, size).astype(np.uint8)
        text = data.tobytes()
        order = suffix_dedup.suffix_array(data)
        assert sorted(order) == list(range(size))
        suffixes = [text[i:] for i in order]
        assert suffixes == sorted(suffixes)
        starts = np.arange(0, size, 10)
        got = suffix_dedup.common_prefixes(data, order, starts, np.minimum(starts + 10, size), 20)
        for k in range(1, size):
            a, b = text[order[k - 1] :], text[order[k] :]
            h = 0
            while h < min(20, len(a), len(b)) and a[h] == b[h]:
                h += 1
            assert got[k] == h


def test_long_and_empty(spark):
    rows = suffix_dedup.deduplicated(frame(spark, [r for r in TEXTS if r[0] in (10, 11)]), with_text=True).collect()
    by = {r.doc_id: r for r in rows}
    assert by[10].n_removed == 0 and by[11].n_spans == 1 and by[11].kept == b" tail"
    assert suffix_dedup.deduplicated(frame(spark, [])).count() == 0
