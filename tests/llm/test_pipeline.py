import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from seriescope.llm import mixing, queries, simhash

from .cases import PROSE, TEXTS, frame
from .test_rules_and_dedup import brute_stats
from .test_simhash import brute_classes, family

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, columns = [docs], docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF).cache()
        assert sorted(out.columns) == sorted(columns)
        seen.append(out)
    ids = [Counter(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert set(ids[1]) < set(ids[0]) and set(ids[2]) < set(ids[1]) and set(ids[3]) <= set(ids[2]) and set(ids[4]) == set(ids[3])
    assert max(ids[4].values()) <= mixing.MAX_PASSES + 1
    texts = [r.text for r in seen[2].collect()]
    assert len(set(texts)) == len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[4], SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == ids[4]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_every_operator_has_a_query(spark):
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    for f in queries.QUERIES.values():
        assert f(spark, SF).count() > 0


def tables(spark, folder, texts):
    """A folder of tables with columns that clash with names used inside."""
    frame(spark, texts, extra=("nr", "_row", "h", "root", "key", "n", "row", "tokens")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_against_a_plain_version(spark, tmp_path):
    """Every stage on its predecessor's rows: nulls, copies, near copies on one template, repeated ids with texts of their own."""
    rng = np.random.default_rng(3)
    plain = [" ".join(f"z{w}" for w in rng.integers(0, 10**6, 40)) for _ in range(30)]
    rows = [r for r in TEXTS if r[0] != 11] + [(100 + i, t) for i, t in enumerate(family(rng, 24, 6))]
    rows += [(None, t) for t in plain[:10]] + [(7, t) for t in plain[10:20]] + [(300 + i, t) for i, t in enumerate(plain[5:30])]
    rows += [(None, plain[0]), (None, plain[0] + "  "), (7, plain[12]), (400, PROSE + " And more."), (400, PROSE.replace("fox", "dog"))]
    folder = tables(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, now = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    low = lambda i: (i is None, i or 0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        got = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality_rules":
            stats = [brute_stats(t or "") for _, t in now]
            assert Counter(got) == Counter(r for r, s in zip(now, stats) if s[0] >= 10 and 100 * s[4] <= 20 * s[0])
        elif name == "exact_dedup":
            groups = {}
            for i, t in now:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append((low(i), len(t), t, i))
            assert Counter(got) == Counter((min(g, key=lambda x: x[:3])[3], min(g, key=lambda x: x[:3])[2]) for g in groups.values())
        elif name == "simhash_near_dedup":
            groups = {}
            for row, root in zip(now, brute_classes([t for _, t in now])):
                groups.setdefault(root, []).append(row)
            assert len(got) == len(groups) < len(now) and len(set(got)) == len(got)
            assert all(len(here := [r for r in got if r in g]) == 1 and low(here[0][0]) == min(low(i) for i, _ in g) for g in groups.values())
        else:
            times, once = Counter(got), Counter(now)
            assert set(times) == set(once) and all(n <= times[r] <= (mixing.MAX_PASSES + 1) * n for r, n in once.items())
        now = got
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, _ in now)
    filled = Counter()
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and simhash.SIMILARITY == 0.8


@pytest.mark.parametrize("texts", [[], [(None, None), (1, ""), (None, " ")]])
def test_run_on_nothing(spark, tmp_path, texts):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, texts)).count() == 0
