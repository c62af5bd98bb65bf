import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seriescope.llm import simhash

from .cases import PROSE, TEXTS, frame


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_clusters_against_brute_force(spark):
    texts = [r for r in TEXTS if r[0] not in (10, 11)] + [(50 + i, PROSE + f" Variant {i % 7} of the end.") for i in range(40)]
    got = {(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.cluster(frame(spark, texts, extra=("fp", "n"))).collect()}
    fps = [brute_fingerprint(t or "") for _, t in texts]
    roots = brute_components(fps, 2)
    want = set()
    for (i, _), fp, r in zip(texts, fps, roots):
        ids = [texts[k][0] for k in range(len(texts)) if roots[k] == r and texts[k][0] is not None]
        want.add((i, fp, min(ids)))
    assert got == want


@pytest.mark.parametrize("leaf_rows,sampled", [(8, 10**6), (30, 10**6), (30, 200), (10**6, 10**6)])
@pytest.mark.parametrize("radius", [2, 3])
def test_search_loses_no_link(spark, monkeypatch, leaf_rows, sampled, radius):
    monkeypatch.setattr(simhash, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(simhash, "SAMPLED", sampled)
    rng = np.random.default_rng(leaf_rows)
    seeds = rng.integers(0, 2**63, 60, np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(20 if s == seeds[0] else 6):
            fps.add(int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    found = {r.node & (2**64 - 1): r.root & (2**64 - 1) for r in simhash.components(simhash.links(table, len(fps), radius)).collect()}
    roots = brute_components(fps, radius)
    classes = lambda pairs: Counter(frozenset(v) for v in pairs.values())
    a, b = {}, {}
    for f, r in zip(fps, roots):
        a.setdefault(r, set()).add(f)
        b.setdefault(found.get(f, f), set()).add(f)
    assert classes(a) == classes(b)


def test_each_pair_meets_once_in_the_tree():
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 2**63, 3000, np.uint64))
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64))
    every = np.unique(np.concatenate([fps, near]))
    tree = simhash.grow(every[::5], len(every), 50)
    assert len(tree.child) > 100 and len({int(v) for v in tree.vantage[tree.child >= 0]}) > 20  # nodes have vantage points of their own
    row, leaf, stored = tree.route(every, 2)
    assert sorted(row[stored]) == list(range(len(every)))
    home = np.empty(len(every), np.int64)
    home[row[stored]] = leaf[stored]
    at = {(r, x) for r, x in zip(row[~stored].tolist(), leaf[~stored].tolist())}
    place = {int(f): i for i, f in enumerate(every)}
    for x, y in zip(fps, near):
        i, j = place[int(x)], place[int(y)]
        if i != j:
            assert (home[i] == home[j]) + ((i, home[j]) in at and home[i] != home[j]) + ((j, home[i]) in at and home[i] != home[j]) == 1
    sizes = np.bincount(home)
    assert sizes.max() < 400


def test_components_of_a_path(spark):
    path = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in simhash.components(path).select("root").distinct().collect()} == {(0,)}
    assert simhash.components(path.limit(0)).count() == 0


def test_deduplicate(spark):
    docs = frame(spark, extra=("fp", "leaf"))
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 8, 9, 10} <= set(ids) and not {2, 3, 5, 6, None} & set(ids)
    assert simhash.deduplicate(docs.limit(0)).count() == 0


def test_near_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, near = [], set()
    shared = " ".join(rng.choice(vocabulary, 60))
    for i in range(150):
        words = list(rng.choice(vocabulary, 200))
        texts.append((10 * i, " ".join(words) + (" " + shared if i % 3 == 0 else "")))
        for k in (1, 2):
            edited = list(words)
            for at in rng.choice(200, k, replace=False):
                edited[at] = f"edit{i}x{k}x{at}"
            texts.append((10 * i + k, " ".join(edited) + (" " + shared if i % 3 == 0 else "")))
            near.add(10 * i + k)
    out = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, texts)).collect()}
    assert all(out[i] == i for i, _ in texts if i % 10 == 0)
    assert sum(out[i] == i - i % 10 for i in near) >= 0.98 * len(near)
    assert all(out[i] in (i, i - i % 10) for i in near)


def test_verification_is_exact(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TOGETHER", 1)
    docs = frame(spark, [(1, "a b c d e f g h i j k l m n"), (2, "a b c d e f g h i j k l m n o"), (3, "a b c d e f g x i j k l m n")])
    pairs = spark.createDataFrame([(2, 1), (3, 1)], "a long, b long")
    assert [tuple(r) for r in simhash._verified(docs, pairs, "doc_id", "text", 5).collect()] == [(2, 1)]


def test_texts_without_or_under_one_id_are_documents_of_their_own(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"v{w}" for w in rng.integers(0, 5000, 80)) for _ in range(12)]
    rows = [(None, t) for t in texts[:6]] + [(7, t) for t in texts[6:9]] + [(8, texts[9]), (None, texts[9]), (None, texts[0]), (9, texts[1] + " more"), (10, texts[10])]
    out = [(r.doc_id, r.text) for r in simhash.deduplicate(frame(spark, rows)).collect()]
    want = [(None, t) for t in (texts[0], *texts[2:6])] + [(7, t) for t in texts[6:9]] + [(8, texts[9]), (9, texts[1] + " more"), (10, texts[10])]
    assert Counter(out) == Counter(want)


def brute_classes(texts, words=5):
    """Classes of the places of texts by links of the stage: fingerprints within the radius, or similar shingle sets."""
    hashes = [simhash.shingle_hashes(t or "", words) for t in texts]
    fps, sets = [simhash.majority(h) for h in hashes], [set(h.tolist()) for h in hashes]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 2 or both and both >= simhash.SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def family(rng, size=60, pairs=20, shared=164, own=36):
    """Texts on one template, far from each other but for some pairs that are just similar enough."""
    template = " ".join(f"t{w}" for w in rng.integers(0, 10**6, shared))
    tails = [[f"u{w}" for w in rng.integers(0, 10**6, own)] for _ in range(size)]
    for k in range(pairs):
        tails[size - 1 - k] = tails[k][: own // 2] + tails[size - 1 - k][own // 2 :]
    return [template + " " + " ".join(t) for t in tails]


def test_pairs_inside_a_template_family_are_all_found(spark):
    texts = family(np.random.default_rng(8))
    out = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, list(enumerate(texts)))).collect()}
    want = brute_classes(texts)
    assert 20 <= len(texts) - len(set(want)) < 30
    assert [out[i] for i in range(len(texts))] == want


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with up to 40 words changed, some of them passages that others share: links of 0.8 alone count."""
    monkeypatch.setattr(simhash, "COUNTED", 100)
    monkeypatch.setattr(simhash, "HEAVY", 3)
    rng = np.random.default_rng(12)
    base = [f"b{w}" for w in rng.integers(0, 10**6, 150)]
    passage = [f"p{w}" for w in range(30)]
    texts = [" ".join(base)]
    for k in range(300):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 8)) if k % 2 else int(rng.integers(8, 40)), replace=False):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    for k in range(200):
        texts.append(" ".join([*passage[: int(rng.integers(10, 30))], *[f"o{w}" for w in rng.integers(0, 10**6, int(rng.integers(5, 60)))]]))
    rng.shuffle(texts)
    out = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, list(enumerate(texts)))).collect()}
    want = brute_classes(texts)
    assert [out[i] for i in range(len(texts))] == want
    assert 50 < max(Counter(want).values()) < 300


def test_short_pairs_at_the_least_similarity_are_all_found(spark):
    texts = []
    for k in range(120):  # 5 distinct shingles, or 4 of them: a similarity of 0.8 exactly
        words = [f"s{k}x{i}" for i in range(9)]
        texts += [" ".join(words), " ".join(words[:-1])]
    out = {r.doc_id: r.component_id for r in simhash.similar(frame(spark, list(enumerate(texts)))).collect()}
    assert all(out[i] == i - i % 2 for i in range(len(texts)))
