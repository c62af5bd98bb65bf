"""Substring deduplication: bytes covered by a LENGTH-byte string that starts earlier somewhere are removed.

Cutting the work into shards. Each window of LENGTH bytes has an anchor: the k-gram in it with the least hash, the first of
equal ones. Equal windows have equal anchors, so occurrences need to meet only within an anchor. Neighbouring windows share
anchors; they form one context, the bytes that such a run of windows covers. Contexts of one anchor that are equal as a whole
(by a 64-bit hash of the anchor and another of the context) are met first: all but the earliest are repeats. Where an anchor
has several distinct contexts, one copy of each goes to a shard.

Shards hold whole anchors, but for hot ones, whose contexts are dealt to many shards. A shard sorts its contexts by place and
cuts them into slices of bounded size. Each slice has a suffix array, by Larsson-Sadakane refinement in numpy (groups that are
sorted drop out), and common prefixes by Kasai's walk, in lockstep over contexts. Suffixes with LENGTH bytes in common are
one class. A slice is merged with earlier ones by binary search of its classes among theirs, sorted as they are. Shards are
merged in the same way: of hot anchors each shard hands on its classes in order, with the earliest place of each; they are
parted by ranges of their bytes' hash, and the runs of one part are searched in each other.

Hot anchors (a line that countless texts go on from differently) are those met often in a bounded sample of the texts
(``SAMPLED``), which never meet in one task at all, and those that turn out to have more than ``HOT_CONTEXTS`` contexts.

Defined cases: a null text is empty; texts under LENGTH bytes are never touched; a null id counts as later than any id; rows
with one id count as one document for the order (of equal strings with equal starts none is earlier, so both stay), and each
gives a row (a row is known by its id and a 64-bit hash of its text, so rows without an id don't share anything); an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialized, text_of, with_hot_rows_broadcast

LENGTH, GRAM = 100, 24
#: Bytes of a shard, of one of hot contexts (which hands on a window for each of its bytes), and of a slice.
SHARD_BYTES, HOT_BYTES, SLICE_BYTES = 6 << 20, 1 << 20, 2 << 20
#: Contexts of one anchor from which on they are dealt to several shards; contexts, or classes, that such a part has on average.
HOT_CONTEXTS, PART_CONTEXTS, PART_CLASSES = 8_192, 4_096, 200_000
#: Texts in which hot anchors are looked for; how often such an anchor is met there; the parts that its contexts are dealt to.
SAMPLED, HOT_SHARE, HOT_PARTS = 20_000, 0.002, 1_024
NULL_ID = np.int64(2**63 - 1)


def _load64(data: bytes) -> np.ndarray:
    """The eight bytes from each position on, as a big-endian number."""
    return np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,)).astype(np.uint64)


def _hashes(data: bytes) -> np.ndarray:
    w = _load64(data) * np.uint64(0x9E3779B97F4A7C15)
    n = max(0, len(data) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ w[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def contexts(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, first window, windows and anchor position of each context of the documents data[starts:ends]."""
    none = (np.empty(0, np.int64),) * 4
    if len(data) < LENGTH:
        return none
    least = (_hashes(data) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    wide, have = LENGTH - GRAM + 1, 1
    while 2 * have <= wide:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < wide:
        least = np.minimum(least[: len(least) - (wide - have)], least[wide - have :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(anchor) + 1, np.int64)
    long = np.flatnonzero(ends - starts >= LENGTH)
    edge[starts[long]] += 1
    edge[ends[long] - LENGTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(edge)[:-1])
    if not len(at):
        return none
    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor[at]) != 0) | (np.diff(at) != 1)]))
    first = at[new]
    return np.searchsorted(starts, first, side="right") - 1, first, np.diff(np.append(new, len(at))), anchor[first]


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    # Empty texts take a byte, so that starts differ; no window lies in it.
    ends = np.cumsum(np.maximum(sizes, 1))
    return b"".join(t or b"\0" for t in texts), ends - np.maximum(sizes, 1), ends


def _bytes_of(column) -> list[bytes]:
    return [t.as_py().encode("utf-8", "replace") for t in column]


ANCHORS = "anchor long, ctx long, doc_id long, h long, start int, n int, sure boolean, hot boolean"


def _sure(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Contexts that equal one of an earlier place among those given."""
    by = np.lexsort((start, doc, ctx, key))
    new = np.concatenate([[True], (np.diff(key[by]) != 0) | (np.diff(ctx[by]) != 0)])[: len(by)]
    lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
    out = np.zeros(len(by), bool)
    out[by] = (doc[by] > doc[lead]) | ((doc[by] == doc[lead]) & (start[by] > start[lead]))
    return out


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each context: the document, its start, its windows, and the hashes of its anchor and of itself."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    data, starts, ends = _joined(texts)
    doc, first, n, anchor = contexts(data, starts, ends)
    key = np.fromiter((digest(data[a : a + GRAM]) for a in anchor.tolist()), np.uint64, len(anchor)).view(np.int64)
    ctx = np.fromiter((digest(data[a:b]) for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist())), np.uint64, len(anchor)).view(np.int64)
    return doc, first - starts[doc], n, key, ctx


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Hashes of anchors met in a large share of a sample of the texts (h, text), of bounded size, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, _, _, key, _ = _anchors(_bytes_of(batch.column(0)))
            each = np.unique(np.stack([doc.view(np.int64), key]), axis=1)[1] if len(doc) else key
            yield pa.RecordBatch.from_arrays([pa.array(each)], names=["anchor"])

    some = docs.where(F.pmod(F.xxhash64("h", "doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1, SAMPLED / max(1, docs.count()))))).select("text")
    met = materialized(some.mapInArrow(run, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")), "anchors-met")
    most = max(10, HOT_SHARE * SAMPLED)  # an anchor stands once in a text here, so few are met that often
    found = met.where(F.col("n") >= most).select("anchor").orderBy("anchor").toArrow().column(0).to_numpy()
    discard(met)
    return found


def anchored(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """anchor, ctx (hash of the context), doc_id, h (hash of the text), start and n (windows) of every context.
    Repeats within a batch are settled at once (sure) and get keys of their own, so that a very common passage sends one row
    for each batch to its anchor, and the rest spread evenly. Contexts of hot anchors are dealt to keys of their own, too, such
    that equal ones meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, n, key, ctx = _anchors(_bytes_of(batch.column(2)))
            ids, text = batch.column(0).take(pa.array(doc)), batch.column(1).to_numpy(zero_copy_only=False)[doc]
            order = ids.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
            sure = _sure(key, ctx, order, start)
            mixed = lambda x: (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            own = mixed(mixed(order ^ text) ^ start)
            often = np.isin(key, hot) & ~sure
            key = np.where(sure, own, np.where(often, key + mixed(1 + (ctx.view(np.uint64) % np.uint64(HOT_PARTS)).view(np.int64)), key))
            out = [key, np.where(sure, own, ctx), ids, text, start.astype(np.int32), n.astype(np.int32), sure, often]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=["anchor", "ctx", "doc_id", "h", "start", "n", "sure", "hot"])

    return docs.select("doc_id", "h", "text").mapInArrow(run, ANCHORS)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of ``data`` (bytes) in order, by Larsson and Sadakane's refinement. The order is complete: Kasai's walk fails on ties."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    head = _load64(data.tobytes() + b"\0" * 7)
    order = np.argsort(head)
    new = np.concatenate([[True], head[order][1:] != head[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = lead
    # A suffix that ends within the first eight bytes sorts like one padded with zeros; ranks beyond the end (-1) part them later.
    h = 8
    while h < n:
        size = np.diff(np.append(np.flatnonzero(new), n))
        open_ = np.flatnonzero(np.repeat(size, size) > 1)  # places in unsorted groups
        if not len(open_):
            break
        suffix = order[open_]
        key = rank[suffix] * (n + 2) + rank[np.minimum(suffix + h, n)] + 1
        by = np.argsort(key)
        order[open_] = suffix[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[open_] = new[open_] | fresh
        lead = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[open_]] = lead[open_]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix in ``order`` shares with the one before it. Kasai's walk over all segments
    data[starts:ends] at once: from one position to the next, a common prefix shrinks by one at most."""
    n = len(data)
    padded = np.concatenate([data.astype(np.int16), np.full(most + 1, -1, np.int16)])
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    at, have = starts.copy(), np.zeros(len(starts), np.int64)
    lanes = np.flatnonzero(at < ends)
    while len(lanes):
        i = at[lanes]
        j = before[i]
        h = np.where(j >= 0, have[lanes], 0)
        going = np.flatnonzero((j >= 0) & (h < most))
        while len(going):
            same = padded[np.minimum(i[going] + h[going], n)] == padded[np.minimum(j[going] + h[going], n)]
            same &= np.maximum(i[going], j[going]) + h[going] < n
            going = going[same]
            h[going] += 1
            going = going[h[going] < most]
        out[place[i]] = h
        have[lanes] = np.maximum(h - 1, 0)
        at[lanes] += 1
        lanes = lanes[at[lanes] < ends[lanes]]
    return out


class _Slice:
    """Classes of equal windows of some contexts: in order, with the place (document, start) of the earliest of each."""

    def __init__(self, chunk: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray):
        sizes = np.array([len(c) for c in chunk], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        data = np.frombuffer(b"".join(chunk), np.uint8)
        order = suffix_array(data)
        shared = common_prefixes(data, order, begins, ends)
        cls = np.cumsum(shared < LENGTH)
        owner = np.repeat(np.arange(len(chunk)), sizes)[order]
        offset = order - begins[owner]
        window = offset < n[owner]
        self.owner, self.offset = owner[window], offset[window]
        kinds, self.cls = np.unique(cls[window], return_inverse=True)
        self.doc, self.start = doc[self.owner], start[self.owner] + self.offset
        by = np.lexsort((self.start, self.doc, self.cls))
        lead = by[np.concatenate([[True], np.diff(self.cls[by]) != 0])] if len(by) else by
        self.low_doc, self.low_start = self.doc[lead], self.start[lead]
        where = order[window][lead]
        self.sorted = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[where].copy().view(f"S{LENGTH}").reshape(-1) if len(where) else np.empty(0, f"S{LENGTH}")
        self.repeated = self._after(self.low_doc[self.cls], self.low_start[self.cls])

    def _after(self, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
        return (self.doc > doc) | ((self.doc == doc) & (self.start > start))

    def merge(self, earlier: _Slice) -> None:
        if not len(earlier.sorted) or not len(self.sorted):
            return
        at = np.minimum(np.searchsorted(earlier.sorted, self.sorted), len(earlier.sorted) - 1)
        met = (earlier.sorted[at] == self.sorted)[self.cls]
        at = at[self.cls]
        self.repeated |= met & self._after(earlier.low_doc[at], earlier.low_start[at])


def repeated_windows(chunk: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, slice_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray, list[_Slice]]:
    """Context and offset of each window that equals one of an earlier place, and the slices; contexts must be sorted by document
    and start."""
    slice_bytes = slice_bytes or SLICE_BYTES
    sizes = np.cumsum([len(c) for c in chunk])
    slices: list[_Slice] = []
    owners, offsets, a = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while a < len(chunk):
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + slice_bytes, side="right")))
        now = _Slice(chunk[a:b], doc[a:b], start[a:b], n[a:b])
        for old in slices:
            now.merge(old)
        slices.append(now)
        owners.append(now.owner[now.repeated] + a)
        offsets.append(now.offset[now.repeated])
        a = b
    return np.concatenate(owners), np.concatenate(offsets), slices


RANGES = "doc_id long, h long, start int, n int"
SHARDS = RANGES + ", window binary, shard long"


def _runs(table: pa.Table, owner: np.ndarray, offset: np.ndarray) -> list[pa.Array]:
    """Ranges of windows (doc_id, h, start, n) from single windows of contexts."""
    by = np.lexsort((offset, owner))
    owner, offset = owner[by], offset[by]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(offset) != 1)])) if len(owner) else np.empty(0, np.int64)
    at = pa.array(owner[new])
    start = table.column("start").to_numpy()[owner[new]] + offset[new]
    return [table.column("doc_id").combine_chunks().take(at), table.column("h").combine_chunks().take(at), pa.array(start.astype(np.int32)), pa.array(np.diff(np.append(new, len(owner))).astype(np.int32))]


def _shard(table: pa.Table) -> pa.Table:
    """Ranges of repeated windows of a shard; and of hot anchors the earliest window of each class, with its bytes."""
    shard = table.column("shard")[0].as_py()
    doc = table.column("doc_id").combine_chunks().fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
    by = np.lexsort((table.column("h").to_numpy(), table.column("start").to_numpy(), doc))
    # Rows of one id and one text have the same contexts: one of them stands for all.
    same = [np.diff(x[by], prepend=~x[by[:1]]) == 0 for x in (doc, table.column("start").to_numpy().astype(np.int64), table.column("h").to_numpy())]
    by = by[~(same[0] & same[1] & same[2])]
    table, doc = table.take(pa.array(by)), doc[by]
    start, n = (table.column(c).to_numpy().astype(np.int64) for c in ("start", "n"))
    chunk, hot = table.column("bytes").to_pylist(), table.column("hot").to_numpy()
    owner, offset, _ = repeated_windows(chunk, doc, start, n)
    out = _runs(table, owner, offset)
    # What is left of hot contexts is the only window of its class here that isn't settled.
    first = np.cumsum(n) - n
    open_ = np.repeat(hot, n)
    open_[first[owner] + offset] = False
    left = np.flatnonzero(open_)
    owner = np.searchsorted(first, left, side="right") - 1
    offset = left - first[owner]
    at = pa.array(owner)
    more = [table.column("doc_id").combine_chunks().take(at), table.column("h").combine_chunks().take(at), pa.array((start[owner] + offset).astype(np.int32)), pa.array(np.ones(len(left), np.int32))]
    begins = np.cumsum([0] + [len(c) for c in chunk])
    data = np.frombuffer(b"".join(chunk), np.uint8)
    body = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[begins[owner] + offset].tobytes() if len(left) else b""
    windows = pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(np.arange(0, LENGTH * (len(left) + 1), LENGTH, dtype=np.int32)), pa.py_buffer(body)])
    cols = [pa.concat_arrays([a, b]) for a, b in zip(out, more)]
    size = len(cols[0])
    return pa.table([*cols, pa.concat_arrays([pa.nulls(size - len(left), pa.binary()), windows]), pa.array(np.full(size, shard, np.int64))], names=["doc_id", "h", "start", "n", "window", "shard"])


def _least(keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sorted run: the distinct keys in order, with the earliest place of each."""
    by = np.lexsort((start, doc, np.unique(keys, return_inverse=True)[1]))
    new = np.append(True, keys[by][1:] != keys[by][:-1])[: len(by)]
    return keys[by][new], doc[by][new], start[by][new]


def _merged(one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sorted runs as one, by binary search of the second one's keys in the first."""
    at = np.searchsorted(one[0], two[0])
    near = np.minimum(at, len(one[0]) - 1)
    met = one[0][near] == two[0]
    doc, start = one[1].copy(), one[2].copy()
    a, b = near[met], np.flatnonzero(met)
    earlier = (two[1][b] < doc[a]) | ((two[1][b] == doc[a]) & (two[2][b] < start[a]))
    doc[a[earlier]], start[a[earlier]] = two[1][b[earlier]], two[2][b[earlier]]
    return tuple(np.insert(x, at[~met], y[~met]) for x, y in zip((one[0], doc, start), two))


def _merge_shards(table: pa.Table) -> pa.Table:
    """The windows (of each class of a shard the earliest) that equal one of an earlier place in another shard. The shards' sorted
    runs are merged, two and two, and each window is looked up in what comes out."""
    doc = table.column("doc_id").combine_chunks().fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
    start, shard = table.column("start").to_numpy(), table.column("shard").to_numpy()
    keys = _ordered(np.frombuffer(b"".join(table.column("window").to_pylist()), np.uint8).reshape(-1, LENGTH))
    by = np.argsort(shard, kind="stable")
    runs = [_least(keys[r], doc[r], start[r]) for r in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1)]
    while len(runs) > 1:
        runs = [_merged(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    at = np.searchsorted(runs[0][0], keys)
    gone = (doc > runs[0][1][at]) | ((doc == runs[0][1][at]) & (start > runs[0][2][at]))
    return table.select(["doc_id", "h", "start", "n"]).filter(pa.array(gone))


def _ordered(raw: np.ndarray) -> np.ndarray:
    """Windows as values that are compared byte by byte, zeros at their ends included."""
    return np.frombuffer(np.concatenate([raw, np.ones((len(raw), 1), np.uint8)], axis=1).tobytes(), f"S{LENGTH + 1}")


def _cut(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """The bytes of contexts: anchor, hot, doc_id, h, start, n, bytes."""
    want = F.collect_list(F.struct("anchor", "hot", "start", "n"))  # as many as the text has contexts
    lists = needs.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(want.alias("want"))
    both = docs.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("doc_id", "h", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            once = list(dict(zip(zip(ids, texts), range(len(ids)))).values())  # rows of one id and one text meet here, most of them
            batch = batch.take(pa.array(once, pa.int64()))
            lists = batch.column("want")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start, n = (flat.field(c).to_numpy() for c in ("start", "n"))
            texts = _bytes_of(batch.column("text"))
            data = pa.array([texts[o][s : s + k + LENGTH - 1] for o, s, k in zip(owner.tolist(), start.tolist(), n.tolist())], pa.binary())
            at = pa.array(owner)
            yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("hot"), batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(start), pa.array(n), data], names=["anchor", "hot", "doc_id", "h", "start", "n", "bytes"])

    return both.mapInArrow(run, "anchor long, hot boolean, doc_id long, h long, start int, n int, bytes binary")


def repeats(docs: DataFrame) -> DataFrame:
    """Ranges of repeated windows of texts (doc_id, h, text): doc_id, h, start, n. A range covers n + LENGTH - 1 bytes from its start."""
    rows = anchored(docs, hot_anchors(docs))
    # One shuffle and one sort serve all three windows.
    place = Window.partitionBy("anchor").orderBy("ctx", F.col("doc_id").asc_nulls_last(), "start", "h")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    equal = Window.partitionBy("anchor", "ctx").orderBy(F.col("doc_id").asc_nulls_last(), "start", "h")
    was = F.lag(F.struct("doc_id", "start", "h")).over(equal)
    told = rows.select(
        "*",
        F.first(F.struct("doc_id", "start")).over(equal).eqNullSafe(F.struct("doc_id", "start")).alias("first"),
        was.eqNullSafe(F.struct("doc_id", "start", "h")).alias("again"),
        (F.min("ctx").over(whole) != F.max("ctx").over(whole)).alias("mixed"),
    ).where("not again and (sure or not first or mixed or hot)")
    settled = materialized(told.select("anchor", "doc_id", "h", "start", "n", "hot", (F.col("first") & ~F.col("sure")).alias("first")), "repeats")
    needs = settled.where("first")
    counts = materialized(needs.groupBy("anchor").agg(F.count("*").alias("contexts")).where(F.col("contexts") > HOT_CONTEXTS), "hot-anchors")
    needs = with_hot_rows_broadcast(needs.drop("first"), counts, "anchor", "contexts", needs.count())
    parts = F.ceil(F.coalesce("contexts", F.lit(1)) / PART_CONTEXTS)
    # A context of a hot anchor goes to one of the anchor's parts.
    dealt = F.when(F.col("contexts").isNull(), F.col("anchor")).otherwise(F.xxhash64("anchor", F.pmod(F.xxhash64("doc_id", "h", "start"), parts)))
    needs = needs.select(dealt.alias("anchor"), (F.col("hot") | F.col("contexts").isNotNull()).alias("hot"), "doc_id", "h", "start", "n")
    cut = materialized(_cut(docs, needs), "contexts", 128)
    size = F.octet_length("bytes")
    cold, often = cut.agg(F.sum(F.when(~F.col("hot"), size)), F.sum(F.when(F.col("hot"), size))).first()
    shards, more = (max(1, -(-(x or 0) // y)) for x, y in ((cold, SHARD_BYTES), (often, HOT_BYTES)))
    shard = F.when(F.col("hot"), shards + F.pmod(F.xxhash64("anchor"), F.lit(more))).otherwise(F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    dealt = cut.select("doc_id", "h", "start", "n", "bytes", "hot", shard.alias("shard"))
    found = materialized(dealt.groupBy("shard").applyInArrow(_shard, SHARDS), "shards", 2_000)
    discard(counts, cut)
    classes = found.where("window is not null")
    parts = max(1, -(-classes.count() // PART_CLASSES))
    merged = classes.groupBy(F.pmod(F.xxhash64("window"), F.lit(parts)).alias("part")).applyInArrow(lambda t: _merge_shards(t), RANGES)
    ranges = settled.where("not first").select("doc_id", "h", "start", "n").unionAll(found.where("window is null").select("doc_id", "h", "start", "n")).unionAll(merged)
    out = materialized(ranges, "ranges", 2_000)
    discard(settled, found)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text`` also kept, the bytes that stay."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    ranges = repeats(slim)
    cuts = F.collect_list(F.struct("start", "n"))  # at most one range for each byte of the text
    lists = ranges.distinct().groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(cuts.alias("cut"))
    both = slim.join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("doc_id", "text", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, cut in zip(batch.column(0), _bytes_of(batch.column(1)), batch.column(2)):
                edge = np.zeros(len(text) + 1, np.int64)
                if cut.is_valid and len(cut.values):
                    start, n = (cut.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n + LENGTH - 1, -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
                spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
                rows.append((doc.as_py(), len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            keep = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols[:keep], kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:keep])

    out = materialized(both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")), "cleaned")
    discard(ranges)
    return out
