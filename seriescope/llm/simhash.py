"""SimHash near-deduplication over vantage-point trees.

A text's fingerprint has a bit set where over half of the XXH64 hashes of its word shingles have it set. Fingerprints link
when they differ in at most ``radius`` bits; documents whose fingerprints are joined by links are one component.

Search. A vantage-point tree is grown from a bounded sample of the fingerprints (``SAMPLED``): each node takes one of its own
fingerprints as its vantage point, the one that parts the node most evenly, and has a child for each Hamming distance to it.
The distance is taken on a block of bits of its own for each level of a path (whole fingerprints are all about 32 bits away
from any vantage point, which prunes nothing). Blocks are disjoint, so triangle bounds add up along a path: where two
fingerprints differ by g1, g2, ... in their distances to the vantage points they meet, they differ in at least g1 + g2 + ...
bits, and a branch is pruned as soon as that sum exceeds the radius. Every fingerprint, in the sample or not, is stored in
one leaf, its shard, and is a query in every other leaf whose bounds its radius overlaps (at the first node where the paths
part only to the farther side: a pair is then met exactly once). A task compares the queries of a leaf with its stored
fingerprints exactly, under a tree of its own where they are many, and passes on a spanning forest of the links, so a leaf
never returns more rows than it has. Components of all forests are found by rounds of star contraction on tables.

Equal fingerprints are merged before the search, so a group of copies of any size is one query.

Near copies. Two texts that share 80 % of their shingles differ in about ten of 64 bits, a radius at which no bound prunes.
``similar`` therefore also links texts whose whole shingle sets have a Jaccard similarity of ``SIMILARITY`` or more, by an
exact prefix filter: in any one order of all shingles, two sets that similar share one of their first n - ceil(SIMILARITY * n)
+ 1 shingles. The order decides how many texts meet, never which links are found: it puts common shingles last, first those
met often in a sample of the texts, then, as often as ``REFINED`` says, those that are still in many prefixes. Texts that
share a shingle of their prefixes meet twice. First each is compared with one of them, that which has the fewest rare
shingles (the text that copies were made from, where it is there): this joins a group of copies of any size with one row for
each. Then all that are still in different components are compared with each other, unless their sizes, the place of the
shingle, or the number of odd bits in which they differ (``PARITY``, never more than the shingles in which they differ)
exclude the similarity.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other; with fewer words
than a shingle takes, all words are the one shingle; null ids are in components like others, but never name one unless no
member has an id; repeated rows are members; different texts under one id, or without one, are documents of their own (the
near-copy stage knows a text by its 64-bit hash, not by its id); an empty table gives an empty result; ``deduplicate``
passes further columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialized, text_of, with_hot_rows_broadcast

#: Fingerprints that the tree is grown from, at most; those of a leaf that call for another level; picks for a vantage point.
SAMPLED, LEAF_ROWS, PICKS = 100_000, 2_000, 12
#: Rows (stored and queries) of a task of the search, on average.
SHARD_ROWS = 250_000
#: Queries compared with the stored fingerprints of a leaf at once.
BLOCK = 1_024
#: Least similarity of near copies.
SIMILARITY = 0.8
#: Texts that common shingles are counted in; the most of these; how often one must be met; times that the order is refined;
#: prefixes that a shingle must be in to be put back. Bits of a set's parity. Pairs of one text that a task compares.
COUNTED, COMMON, OFTEN, REFINED, HEAVY, PARITY, TOGETHER = 20_000, 200_000, 3, 2, 8, 1_024, 256
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; none for a text without words."""
    import xxhash

    found = text.encode("utf-8", "replace").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([digest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(found) - words + 1
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 without any."""
    if not len(hashes):
        return 0
    n_set = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        n_set += np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * n_set > len(hashes)).tobytes(), "big")


def fingerprint(text: str, words: int = 3) -> int:
    return majority(shingle_hashes(text, words))


def text_hash(text_col: str) -> Column:
    return F.xxhash64(text_of(text_col))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, order: Order | None = None) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number; with an ``order`` also h, the hash of the text, n, its distinct
    shingles, and prefix, the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingle_hashes(t.as_py(), words) for t in batch.column(1)]
            out = [batch.column(0), pa.array(np.array([majority(h) for h in every], np.uint64).view(np.int64))]
            if order is not None:
                out += [batch.column(2), *_prefixes(every, order)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "fp", "h", "n", "prefix"][: len(out)])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), *([text_hash(text_col).alias("h")] if order is not None else []))
    return texts.mapInArrow(run, "doc_id long, fp long" + (", h long, n int, prefix array<long>" if order is not None else ""))


@dataclass
class Tree:
    """Nodes: vantage point, mask of the block that distances are taken on, and the first child (that of distance 0; -1: a leaf)."""

    vantage: np.ndarray
    mask: np.ndarray
    child: np.ndarray

    def route(self, fps: np.ndarray, radius: int, both_sides: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place among ``fps``, leaf, and whether it is stored there (else it is a query): all leaves within the radius, but for those
        that come before its own (unless ``both_sides``)."""
        row, node, left = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.full(len(fps), radius)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(row):
            leaf = self.child[node] < 0
            done.append((row[leaf], node[leaf], left[leaf] == radius))
            row, node, left = row[~leaf], node[~leaf], left[~leaf]
            distance = np.bitwise_count((fps[row] ^ self.vantage[node]) & self.mask[node]).astype(np.int64)
            width = np.bitwise_count(self.mask[node]).astype(np.int64)
            steps = []
            for step in range(-radius, radius + 1):
                ok = (abs(step) <= left) & (distance + step >= 0) & (distance + step <= width) & ((step >= 0) | both_sides | (left < radius))
                steps.append((row[ok], self.child[node[ok]] + distance[ok] + step, left[ok] - abs(step)))
            row, node, left = (np.concatenate(x) for x in zip(*steps))
        return tuple(np.concatenate(x) for x in zip(*done))


def _width(share: float, bits: int) -> int:
    """Bits of a node's block: the widest of which the rest has enough to part ``share`` leaves' worth."""
    return next((w for w, parts in ((16, 7.0), (8, 5.0)) if bits >= w and parts ** (bits // w) >= 4 * share), min(bits, 4))


def grow(sample: np.ndarray, total: int, leaf_rows: int | None = None) -> Tree:
    """A tree for ``total`` fingerprints, of which ``sample`` (distinct, unsigned) are known."""
    leaf_rows = leaf_rows or LEAF_ROWS
    vantage, mask, child = [np.uint64(0)], [np.uint64(0)], [-1]
    open_ = [(0, np.sort(sample), 0)]
    while open_:
        node, mine, at = open_.pop()
        share = len(mine) * total / max(1, len(sample)) / leaf_rows
        if share <= 1 or len(mine) < 16 or at >= 64:
            continue
        width = _width(share, 64 - at)
        block = np.uint64(((1 << width) - 1) << at)
        picks = mine[np.linspace(0, len(mine) - 1, PICKS).astype(np.int64)]
        known = mine[:: max(1, len(mine) // 4096)]
        uneven = [(np.bincount(np.bitwise_count((known ^ p) & block)) ** 2).sum() for p in picks]
        point = picks[int(np.argmin(uneven))]
        vantage[node], mask[node], child[node] = point, block, len(child)
        distance = np.bitwise_count((mine ^ point) & block)
        for d in range(width + 1):
            open_.append((len(child), mine[distance == d], at + width))
            vantage.append(np.uint64(0))
            mask.append(np.uint64(0))
            child.append(-1)
    return Tree(np.array(vantage, np.uint64), np.array(mask, np.uint64), np.array(child, np.int64))


def grown(groups: DataFrame, n: int) -> Tree:
    """The tree of all fingerprints (fp) from a sample by their hash, of a size that the driver holds."""
    cut = int((min(1.0, SAMPLED / max(1, n)) - 0.5) * 2**64)
    some = groups.where(F.xxhash64("fp") <= F.lit(min(cut, 2**63 - 1))).select("fp").limit(2 * SAMPLED).toArrow()
    return grow(some.column("fp").to_numpy().view(np.uint64), n)


def routed(groups: DataFrame, tree: Tree, radius: int) -> DataFrame:
    """leaf, fp, stored: each fingerprint in its leaf, and as a query in the later leaves that it overlaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            row, leaf, stored = tree.route(fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fps[row]), pa.array(stored)], names=["leaf", "fp", "stored"])

    return groups.select("fp").mapInArrow(run, "leaf long, fp long, stored boolean")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _near(stored: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked fingerprints of one leaf, each pair once: stored ones with each other, and queries with stored ones."""
    if len(stored) > 4 * LEAF_ROWS:
        # A leaf that the sample couldn't part: under a tree of its own, grown from all of it.
        tree = grow(stored, len(stored))
        if len(tree.child) > 1:
            row, leaf, own = tree.route(stored, radius)
            q_row, q_leaf, _ = tree.route(queries, radius, both_sides=True)
            fps, leaves = np.concatenate([stored[row], queries[q_row]]), np.concatenate([leaf, q_leaf])
            kind = np.concatenate([own, np.zeros(len(q_row), bool)])
            order = np.lexsort((~kind, leaves))
            fps, kind, edges = fps[order], kind[order], np.flatnonzero(np.diff(leaves[order], prepend=-1, append=-1))
            for s, e in zip(edges, edges[1:]):
                m = s + int(np.count_nonzero(kind[s:e]))
                if m > s:
                    yield from _compared(fps[s:m], fps[m:e], radius)
            return
    yield from _compared(stored, queries, radius)


def _compared(stored: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    every = np.concatenate([stored, queries])
    for k in range(0, len(every), BLOCK):
        q, at = np.nonzero(np.bitwise_count(every[k : k + BLOCK, None] ^ stored[None, :]) <= radius)
        q = q + k
        once = (q >= len(stored)) | (q > at)  # pairs of stored ones from one side only
        yield every[q[once]], stored[at[once]]


def _forest(table: pa.Table, radius: int) -> pa.Table:
    """Spanning links (fp, root) of the fingerprints of some leaves."""
    leaf, fp, stored = (table.column(c).to_numpy() for c in ("leaf", "fp", "stored"))
    order = np.lexsort((~stored, leaf))
    leaf, fp, stored = leaf[order], fp[order].view(np.uint64), stored[order]
    edges = np.flatnonzero(np.diff(leaf, prepend=-1, append=-1))
    froms, tos = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for s, e in zip(edges, edges[1:]):
        m = s + int(np.count_nonzero(stored[s:e]))
        if m > s:
            for x, y in _near(fp[s:m], fp[m:e], radius):
                froms.append(x)
                tos.append(y)
    values, place = np.unique(np.concatenate([*froms, *tos]), return_inverse=True)
    root = _roots(len(values), *np.split(place, 2))
    joined = np.flatnonzero(root != np.arange(len(values)))
    signed = values.view(np.int64)
    return pa.table({"a": signed[joined], "b": signed[root[joined]]})


def links(groups: DataFrame, n: int, radius: int = 2) -> DataFrame:
    """Spanning links (a, b) that join exactly the fingerprints that links within the radius join."""
    tree = grown(groups, n)
    rows = materialized(routed(groups, tree, radius), "routed", 10_000)
    shards = max(8, -(-rows.count() // SHARD_ROWS))
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("leaf"), F.lit(shards)))
    out = materialized(sharded.groupBy("shard").applyInArrow(lambda t: _forest(t, radius), "a long, b long"), "forests", 10_000)
    discard(rows)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node of an edge (a, b). Alternates large and small stars."""
    now = materialized(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    state = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now, old = materialized(small.distinct(), "star"), now
        discard(old)
        told = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(told) == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(told)


def _clustered(rows: DataFrame, radius: int) -> DataFrame:
    """The rows (doc_id, fp and further columns) with root (a fingerprint that names the component), component_id, component_size."""
    groups = materialized(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("_w")), "fp-groups")
    forest = links(groups, groups.count(), radius)
    roots = components(forest)
    named = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "low", "_w", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("_w").alias("component_size"))
    known = materialized(named.join(lowest, "root").select("fp", "_w", "root", "component_id", "component_size"), "fp-components")
    discard(groups, forest)
    return with_hot_rows_broadcast(rows, known, "fp", "_w", rows.count()).drop("_w")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id (least id of the component), component_size."""
    return _clustered(materialized(fingerprints(docs, id_col, text_col, words), "fingerprints"), radius).select("doc_id", "fp", "component_id", "component_size")


@dataclass
class Order:
    """Shingles that come last (sorted), by their counts; all others come before them, by their hashes."""

    common: np.ndarray
    counts: np.ndarray

    def and_then(self, more: np.ndarray, counts: np.ndarray) -> Order:
        """This order with ``more`` put back behind the others that are not common."""
        every, where = np.unique(np.concatenate([self.common, more]), return_inverse=True)
        most = np.zeros(len(every), np.int64)
        np.maximum.at(most, where, np.concatenate([self.counts, counts]))
        return Order(every, most)


def prefix(hashes: np.ndarray, order: Order) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the order of all, of which similar sets share one, and the size of the set."""
    x = np.unique(hashes)
    n = len(x)
    take = n - int(np.ceil(SIMILARITY * n - 1e-9)) + 1 if n else 0
    if n and len(order.common):
        at = np.minimum(np.searchsorted(order.common, x), len(order.common) - 1)
        x = x[np.argsort(np.where(order.common[at] == x, order.counts[at], 0), kind="stable")]
    return x[:take], n


def _prefixes(every: list[np.ndarray], order: Order) -> list[pa.Array]:
    made = [prefix(h, order) for h in every]
    ends = np.cumsum([0] + [len(x) for x, _ in made])
    flat = np.concatenate([np.empty(0, np.uint64), *[x for x, _ in made]]).view(np.int64)
    return [pa.array([n for _, n in made], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]


def _top(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles (t, n) met most often, of a number that the driver holds."""
    top = counted.orderBy(F.desc("n"), "t").limit(COMMON).toArrow()
    return top.column("t").to_numpy().view(np.uint64), top.column("n").to_numpy().astype(np.int64)


def sampled_order(texts: DataFrame, n: int, words: int) -> Order:
    """The order by counts in a sample of the texts (h, text) of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *made]).view(np.int64))], names=["t"])

    some = texts.where(F.pmod(F.xxhash64("h"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1, COUNTED / max(1, n))))).select("text")
    met = materialized(some.mapInArrow(run, "t long").groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN), "shingles-met")
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    order = Order(*none).and_then(*_top(met))
    discard(met)
    return order


def _refined(sets: DataFrame, texts: DataFrame, order: Order, words: int) -> DataFrame:
    """The sets (h, n, prefix, root) under an order that puts shingles of many prefixes back. Only sets that have one are made anew."""
    for _ in range(REFINED):
        met = materialized(sets.select(F.explode("prefix").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= HEAVY), "prefixes-met")
        heavy, counts = _top(met)
        discard(met)
        if not len(heavy):
            break
        order = order.and_then(heavy, counts)
        back = np.sort(heavy).view(np.int64)

        def told(batches: Iterator[pa.RecordBatch], back: np.ndarray = np.sort(back)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("prefix")
                hit = np.append(0, np.cumsum(np.isin(lists.values.to_numpy(), back)))
                ends = lists.offsets.to_numpy()
                yield batch.append_column("again", pa.array(hit[ends[1:]] > hit[ends[:-1]]))

        def made(batches: Iterator[pa.RecordBatch], order: Order = order) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_prefixes([shingle_hashes(t.as_py(), words) for t in batch.column(1)], order), batch.column(2)], names=["h", "n", "prefix", "root"])

        flagged = materialized(sets.mapInArrow(told, "h long, n int, prefix array<long>, root long, again boolean"), "sets-told", 2_000)
        again = texts.join(flagged.where("again").select("h", "root"), "h").select("h", "text", "root").mapInArrow(made, "h long, n int, prefix array<long>, root long")
        now = materialized(flagged.where("not again").drop("again").unionAll(again.dropDuplicates(["h"])), "sets")
        discard(sets, flagged)
        sets = now
    return sets


def _with_renamed(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with their column root renamed along edges (a, b) of roots."""
    roots = components(edges).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    sizes = rows.join(roots, "root", "left_semi").groupBy("root").agg(F.count("*").alias("_n"))
    known = materialized(roots.join(sizes, "root"), "roots")
    out = with_hot_rows_broadcast(rows, known, "root", "_n", rows.count())
    return materialized(out.withColumn("root", F.coalesce("_to", "root")).drop("_to", "_n"), "renamed", 2_000)


def _salted_join(pairs: DataFrame, side: str, known: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``known`` (id) of one side, suffixed; a text of many pairs is sent several times, to as many tasks."""
    sizes = materialized(pairs.groupBy(F.col(side).alias("_id")).agg(F.count("*").alias("_n")), "pair-counts")
    parts = F.ceil(F.col("_n") / TOGETHER).cast("int")
    dealt = with_hot_rows_broadcast(pairs, sizes.withColumnRenamed("_id", side), side, "_n", pairs.count())
    other = "b" if side == "a" else "a"
    dealt = dealt.withColumn("_part", F.pmod(F.xxhash64(other), parts)).drop("_n")
    sent = known.join(sizes, F.col("id") == F.col("_id")).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    sent = sent.select(F.col("id").alias(side), "_part", *[F.col(c).alias(f"{c}_{side}") for c in known.columns if c != "id"])
    return dealt.join(sent, [side, "_part"]).drop("_part")


def _verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole shingle sets are similar enough. Texts of one id must be equal."""
    ids = pairs.select(F.col("a").alias("_id")).unionAll(pairs.select("b")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).join(ids, F.col("id") == F.col("_id"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            odd = [np.packbits(np.bincount((x % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).tobytes() for x in made]
            out = [batch.column(0), pa.array([x.tobytes() for x in made], pa.binary()), pa.array(odd, pa.binary()), pa.array([len(x) for x in made], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "of", "odd", "size"])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, PARITY // 8) for c in ("odd_a", "odd_b"))
            sizes = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            ok = np.bitwise_count(x ^ y).sum(axis=1) <= (1 - SIMILARITY) / (1 + SIMILARITY) * sizes + 1e-6
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= SIMILARITY * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    known = materialized(texts.mapInArrow(sets, "id long, of binary, odd binary, size int").dropDuplicates(["id"]), "shingle-sets")
    of = lambda rows, *cols: _salted_join(_salted_join(rows, "a", known.select("id", *cols)), "b", known.select("id", *cols))
    left = materialized(of(pairs, "odd", "size").select("a", "b", "odd_a", "odd_b", "size_a", "size_b").mapInArrow(likely, "a long, b long"), "likely", 2_000)
    found = materialized(of(left, "of").select("a", "b", "of_a", "of_b").mapInArrow(compare, "a long, b long").distinct(), "alike", 64)
    discard(known, left)
    return found


def _joined(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int) -> DataFrame:
    """doc_id, h (hash of the text), root: one row per row of ``docs``; rows of one component have one root."""
    texts = docs.select(text_hash(text_col).alias("h"), text_of(text_col).alias("text"))
    order = sampled_order(texts, docs.count(), words)
    rows = materialized(fingerprints(docs, id_col, text_col, words, order), "fingerprints")
    both = materialized(_clustered(rows, radius).select("doc_id", "h", "root", "n", "prefix"), "clustered")
    near = materialized(both.select("doc_id", "h", "root"), "near")
    sets = _refined(materialized(both.select("h", "n", "prefix", "root").dropDuplicates(["h"]), "sets"), texts, order, words)
    discard(rows, both)

    each = sets.select("h", "n", "root", F.posexplode("prefix").alias("i", "t"))
    firsts = each.groupBy("t").agg(F.min(F.struct("i", "h", "n", "root")).alias("first"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"))
    firsts = materialized(firsts.where("lo <> hi").select("t", "first", "c"), "prefix-firsts")
    met = materialized(with_hot_rows_broadcast(each, firsts, "t", "c", sets.agg(F.sum(F.size("prefix"))).first()[0] or 0).where("c is not null").drop("c"), "prefixes")
    discard(sets, firsts)

    # The sizes allow the similarity, and the first shingle that a similar pair has in common has enough of both sets behind it.
    size = lambda m, n: F.least(m, n) >= SIMILARITY * F.greatest(m, n) - 1e-6
    place = lambda m, i, n, j: F.least(m - i, n - j) >= SIMILARITY / (1 + SIMILARITY) * (m + n) - 1e-6
    one, c = F.col("first"), F.col
    toward = met.where((c("root") != one["root"]) & size(c("n"), one["n"]) & place(c("n"), c("i"), one["n"], one["i"]))
    toward = materialized(toward.select(c("h").alias("a"), one["h"].alias("b"), c("root").alias("ra"), one["root"].alias("rb")).distinct(), "toward-first")
    found = _verified(texts, toward.select("a", "b"), "h", "text", words)
    edges = materialized(toward.join(found, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    near, older = _with_renamed(near, edges), near
    left = _with_renamed(met.drop("first"), edges)
    discard(older, met, toward, found, edges)

    apart = left.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("t", "c")
    left, older = materialized(with_hot_rows_broadcast(left, materialized(apart, "apart"), "t", "c", left.count()).where("c is not null").drop("c"), "left"), left
    discard(older)
    side = lambda to: left.select("t", *[F.col(x).alias(f"{x}_{to}") for x in ("h", "root", "n", "i")])
    pairs = side("a").join(side("b"), "t").where((c("root_a") < c("root_b")) & size(c("n_a"), c("n_b")) & place(c("n_a"), c("i_a"), c("n_b"), c("i_b")))
    pairs = materialized(pairs.select(c("h_a").alias("a"), c("h_b").alias("b"), c("root_a").alias("ra"), c("root_b").alias("rb")).distinct(), "pairs")
    found = _verified(texts, pairs.select("a", "b"), "h", "text", words)
    edges = materialized(pairs.join(found, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    out = _with_renamed(near, edges)
    discard(near, left, pairs, found, edges)
    return out


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 2) -> DataFrame:
    """doc_id, component_id: components of links within the radius and of verified near copies."""
    rows = _joined(docs, id_col, text_col, words, radius)
    named = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    return with_hot_rows_broadcast(rows, materialized(named, "names"), "root", "n", rows.count()).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, one for each component of ``similar``, with all their columns: that with the least id (no
    id only where none has one), of several texts under that id the one whose hash is least."""
    names = docs.columns
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("k")
    kept = _joined(docs, id_col, text_col, words, radius).groupBy("root").agg(first).select(F.col("k.doc_id").alias("_keep"), F.col("k.h").alias("_of"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), text_hash(text_col).alias("_text"))
    left = rows.join(kept, F.col("_id").cast("long").eqNullSafe(F.col("_keep")) & (F.col("_text") == F.col("_of")), "left_semi")
    once = F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.length(f"_row.`{text_col}`"), f"_row.`{text_col}`"))
    return left.withColumn("_n", once).where("_n = 1").select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
