import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from seriescope.llm import exact_dedup, quality_rules
from seriescope.llm.textstats import with_stats

from .cases import TEXTS, frame

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def brute_stats(text):
    words = SPLIT.findall(text)
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_stats_against_brute_force(spark):
    got = Counter(map(tuple, with_stats(frame(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    assert got == Counter((i, *brute_stats(t or "")) for i, t in TEXTS)


def test_rules_are_learned_and_applied(spark):
    texts = [(i, f"plain words number{i} stand here in a row of text that is fine and long enough") for i in range(300)]
    texts += [(1000 + i, f"bad### words$$$ number{i}%%% stand&&& here*** in### a$$$ row%%% of&&& text*** that### is$$$") for i in range(100)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in texts], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    assert rules and all(0 < len(r.conditions) <= 3 for r in rules)
    kept = {r.doc_id for r in quality_rules.apply_rules(docs, rules).collect()}
    assert kept == set(range(300))


def test_rules_edge_cases(spark):
    docs = frame(spark, extra=("rule", "kept", "t", "w"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, none)
    assert rules == []
    out = quality_rules.apply_rules(docs, rules)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} >= {1, 2, 3, 7} and not {4, 5, 6, 8, 15} & {r.doc_id for r in out.collect()}
    assert quality_rules.judged(docs.limit(0), rules).count() == 0


def test_exact_classes_against_brute_force(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t in TEXTS:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids, default=None)
        want[(i, keep, len(groups[norm(t)]), i == keep, hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    got = Counter(map(tuple, exact_dedup.classes(frame(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    assert got == want


def test_exact_deduplicate_keeps_columns_and_one_row_each(spark):
    docs = frame(spark, extra=("md5", "norm", "key"))
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17]
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0


def test_hot_group(spark):
    docs = frame(spark, [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)])
    got = exact_dedup.classes(docs)
    assert got.where("group_size = 1000 and keep_id = 0").count() == 1000 and got.where("kept").count() == 2001
    assert got.agg(F.count("*")).first()[0] == 3000


def test_rows_of_the_base_rule_teach_nothing(spark):
    """Short texts with many marks are decided by the base rule; symbols alone part the rest, and are what is learned."""
    rows = []
    for i in range(240):
        words = [f"word{(i * 7 + k) % 97}x{k}" for k in range(30)]
        if i % 4 == 0:
            rows.append((i, "what?! " * 5 + str(i), 0))
        elif i % 4 == 1:
            rows.append((i, " ".join(w + "%%" for w in words), 0))
        else:
            rows.append((i, " ".join(w + ("," if k % (2 + i % 9) == 0 else "") for k, w in enumerate(words)), 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = quality_rules.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    kept = {r.doc_id for r in quality_rules.judged(df, rules).where("kept").collect()}
    assert kept == {i for i, _, q in rows if q}
    assert len(rules) == 1


def test_an_id_that_is_repeated_is_learned_from_once(spark):
    docs = frame(spark, [(7, f"text number {i}") for i in range(500)] + [(None, f"none {i}") for i in range(500)] + [(8, "eight"), (8, "eight"), (9, "nine")])
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (8, 1, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.labelled_sample(docs.select("doc_id", "text"), labels).collect()
    assert sorted((r.doc_id, r._label) for r in got) == [(7, 1), (8, 1)]


def test_verdicts_against_plain_rules(spark):
    """The ordered expressions decide as the rules do when they are read one after the other, on the labelled rows of a table."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality_rules.fit(docs, labels)
    assert rules
    stats = {r.doc_id: r.asDict() for r in with_stats(docs.unionAll(docs.limit(0))).collect()}
    want = {}
    for i, r in stats.items():
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        number = 0 if failed else next((k for k, rule in enumerate(rules, 1) if rule.holds(r)), None)
        want[i] = (failed, number is None, number)
    got = {r.doc_id: (r.base_failed, r.kept, r.rule) for r in quality_rules.judged(docs, rules).collect()}
    assert got == want and {n for _, _, n in want.values()} >= {None, 0, 1}
    assert {r.doc_id for r in quality_rules.apply_rules(docs, rules).select("doc_id").collect()} == {i for i, (_, kept, _) in want.items() if kept}
