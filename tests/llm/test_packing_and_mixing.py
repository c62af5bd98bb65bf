import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seriescope.llm import mixing, packing

from .cases import TEXTS, frame


def test_bins_are_bounded_and_sound():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, places, rooms = packing.best_fit(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(rooms)
        for b in range(len(rooms)):
            mine = sorted(zip(places[bins == b], lengths[bins == b]))
            assert [p for p, _ in mine] == [sum(n for _, n in mine[:k]) for k in range(len(mine))] and sum(n for _, n in mine) == 100 - rooms[b]
    assert packing.lower_bound(np.array([51] * 9 + [2]), 100) == 9
    assert packing.lower_bound(np.array([34] * 10), 100) == 5 and packing.lower_bound(np.array([], int), 100) == 0


@pytest.mark.parametrize("group_pieces", [7, 100_000])
def test_packing_is_gapless_and_whole(spark, group_pieces):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pieces(frame(spark), with_ids=True)
    out = [r.asDict() for r in packing.pack(rows.drop("ids"), group_pieces=group_pieces).collect()]
    ids = defaultdict(Counter)
    want = Counter()
    for i, t in TEXTS:
        e = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for n, s in enumerate(range(0, len(e), 2048)):
            want[(i, n, s, len(e[s : s + 2048]), zlib.crc32(e[s : s + 2048].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    for r in out:
        ids[r["sequence_id"]][r["offset"]] = r["length"]
    assert sum(map(len, ids.values())) == len(out)
    for places in ids.values():
        assert sorted(places) == [0, *np.cumsum([places[k] for k in sorted(places)])[:-1]] and sum(places.values()) <= 2048
    if group_pieces > 1000:
        assert len(ids) == packing.lower_bound(np.array([r["length"] for r in out]))


def encoded(encode, texts):
    data = [t.encode() for t in texts]
    sizes = np.array([len(x) for x in data], np.int64)
    ids, n = encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes) - sizes)
    ends = np.cumsum(n)
    return [ids[a:b].tolist() for a, b in zip(ends - n, ends)]


def test_encoder_against_whole_texts(monkeypatch):
    import random

    from tokenizers import Tokenizer

    rng, whole = random.Random(4), Tokenizer.from_file(packing.default_tokenizer())
    texts = ["Rewh.### And&&& a$$$ OF!! it's 'street ''s don't I'LL x<|endoftext|>y <|ENDOFTEXT|> 12ab34", "É e\u0301 \u00a0x\u2003y \x1cz\x7f \u0130K \u03a3\u03a3 漢字 ½ ① ﬁ", "", "a\x00b\tc\x0bd", "", *[t or "" for _, t in TEXTS], ""]
    odd = "aB é É ö ß × ÷ İ ŉ ǅ ɑ ' 's 'S 'll <| |> <|endoftext|> . , = \u0338 \u0301 « » … 1 ½ ² ٣ Σ ς ﬁ 漢 \u00a0 \u2003 \x1c \x85 \n \t".split(" ") + [" ", "'", "\u212b", "\U0001f600", "K"]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for most, together in ((1_000_000, 1024), (3, 2)):
        monkeypatch.setattr(packing, "REMEMBERED", most)
        monkeypatch.setattr(packing, "TOGETHER", together)
        encode = packing.Encoder(packing.default_tokenizer())
        assert encode.by_unit
        for _ in range(2):
            assert encoded(encode, texts) == want
        for k in range(0, len(texts), 700):
            assert encoded(encode, texts[k : k + 700]) == want[k : k + 700]
        encode.by_unit = False
        assert encoded(encode, texts) == want


def test_rows_without_an_id_spread(spark):
    docs = frame(spark, [(None, f"w{i % 9}") for i in range(1000)] + [(7, f"v{i}") for i in range(1000)])
    out = packing.pack(packing.pieces(docs), group_pieces=250).collect()
    assert Counter(r.doc_id for r in out) == {None: 1000, 7: 1000}
    sizes = Counter(r.sequence_id for r in out)
    assert len(sizes) == 8 and max(sizes.values()) < 320  # eight groups of about 250 pieces, one sequence each


def test_pack_nothing(spark):
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_plan_meets_entropy_or_limit():
    tokens = {"a": 1000, "b": 100, "c": 10, None: 1}
    free = mixing.plan(tokens, 0.5, 1e9)
    shares = [v / 1111 for v in tokens.values()]
    aim = mixing.entropy(shares) + 0.5 * (2 - mixing.entropy(shares))
    assert abs(mixing.entropy(list(free.weights.values())) - aim) < 1e-9
    tight = mixing.plan(tokens, 0.5, 3.0)
    assert abs(max(tight.passes.values()) - 3) < 1e-9 and min(tight.passes.values()) == 1
    assert mixing.plan({}).passes == {} and mixing.plan({"a": 0}).passes == {"a": 1.0} and mixing.plan({"a": 5}).passes == {"a": 1.0}


def test_schedule_against_brute_force(spark):
    texts = [(i, "w " * (1 + i % 7)) for i in range(900)] + TEXTS
    docs = frame(spark, texts, extra=("name", "block", "h"))
    the_plan = mixing.Plan(0.5, {}, {"src0": 1.0, "src1": 2.5, "src2": 3.25, None: 1.0})
    out = mixing.schedule(docs, the_plan).collect()
    total, got = Counter(), Counter()
    for i, t in texts:
        total[None if i == 5 else f"src{(i or 0) % 3}"] += len((t or "").split())
    for r in out:
        got[r.source] += r.tokens
    longest = 30_001
    for s, p in the_plan.passes.items():
        assert total[s] * int(p) <= got[s] <= total[s] * p and (got[s] > total[s] * p - longest)
    assert Counter((r.doc_id, r.source) for r in out if r.epoch == 0) == Counter((i, None if i == 5 else f"src{(i or 0) % 3}") for i, _ in texts)
    again = mixing.mixed(docs, the_plan)
    assert again.columns == docs.columns
    assert mixing.schedule(frame(spark, []), mixing.plan(mixing.source_tokens(frame(spark, [])))).count() == 0


def test_mixed_repeats_rows(spark):
    docs = frame(spark, [(i, "a b c d") for i in range(90)])
    the_plan = mixing.Plan(0.5, {}, {"src0": 1.0, "src1": 1.5, "src2": 2.0})
    n = Counter(r.source for r in mixing.mixed(docs, the_plan).collect())
    assert n == {"src0": 30, "src1": 45, "src2": 58, None: 1}


def test_each_pass_has_an_order_of_its_own_and_prefixes_keep_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 10)
    docs = frame(spark, [(i, "a b c d") for i in range(600)])
    the_plan = mixing.Plan(0.5, {}, {"src0": 1.0, "src1": 2.5, "src2": 3.5})
    rows = [r for r in mixing.schedule(docs, the_plan).collect() if r.source]
    blocks = {}
    for r in sorted(rows, key=lambda r: r.mix_key):
        blocks.setdefault((r.source, r.epoch), []).append(r.block)
    orders = {k: list(dict.fromkeys(v)) for k, v in blocks.items()}
    for k, v in blocks.items():
        assert v == [b for b in orders[k] for _ in range(v.count(b))]  # a block at a time
    assert orders["src2", 0] != orders["src2", 1] != orders["src2", 2] and sorted(orders["src2", 0]) == sorted(orders["src2", 1])
    assert orders["src1", 2] != sorted(orders["src1", 0])[: len(orders["src1", 2])]  # the last pass isn't always the lowest blocks
    inside = [[r.doc_id for r in sorted(rows, key=lambda r: r.mix_key) if (r.source, r.block, r.epoch) == ("src2", orders["src2", 0][0], e)] for e in (0, 1)]
    assert inside[0] != inside[1] and sorted(inside[0]) == sorted(inside[1])
    share = Counter(r.source for r in rows)
    early = Counter(r.source for r in rows if r.mix_key < 0.3)
    assert all(abs(early[s] - 0.3 * n) <= 2 for s, n in share.items())


def test_rows_without_an_id_meet_their_quotas(spark):
    rows = spark.createDataFrame([(None if i % 2 else 7, "a b", "s" if i % 3 else "t") for i in range(3000)], "doc_id long, text string, source string")
    the_plan = mixing.Plan(0.5, {}, {"s": 1.0, "t": 2.5})
    assert Counter(r.source for r in mixing.mixed(rows, the_plan).collect()) == {"s": 2000, "t": 2500}
    blocks = Counter((r.source, r.block) for r in mixing.schedule(rows, the_plan).where("epoch = 0").collect())
    assert max(blocks.values()) <= 1.2 * mixing.BLOCK_DOCS


def test_more_sources_than_the_driver_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 9}") for i in range(180)] + [(900, None, "none")], "doc_id long, text string, source string")
    few = mixing.plan_of(docs)
    want = Counter((r.doc_id, r.epoch) for r in mixing.schedule(docs, few).collect())
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    many = mixing.plan_of(docs)
    assert many.passes is None and abs(many.exponent - few.exponent) < 1e-9
    assert Counter((r.doc_id, r.epoch) for r in mixing.schedule(docs, many).collect()) == want
    with pytest.raises(ValueError):
        mixing.source_tokens(docs)
