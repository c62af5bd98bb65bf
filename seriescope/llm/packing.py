"""Best-fit packing with certified bin counts.

Texts become token pieces of at most ``capacity`` ids. Pieces are dealt into groups; each group is packed by best-fit
decreasing, and dual feasible functions give a lower bound on its bins. Where the count meets the bound, the group is proven
optimal: its full bins stay, and only its emptiest bin goes on. A group with a gap gives the pieces of all bins with room to
the next round, where pieces of such groups are exchanged (dealt into new groups) and packed anew. After the last round
every bin stays.

Defined cases: a null text is empty and is the one id that ends a document; null and repeated ids are kept, each row being
packed for itself (pieces are known by a number of their own, so rows without an id spread like others); an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gathered, materialized, text_of

CAPACITY = 2048
#: Pieces of a group (a task packs one group at a time), and rounds of exchange after the first packing.
GROUP_PIECES, ROUNDS = 60_000, 3
#: Units whose ids a worker remembers at most; bytes of texts that are encoded at once; units handed to the tokenizer as one text.
REMEMBERED, BATCH_BYTES, TOGETHER = 250_000, 1 << 20, 1_024

PIECES = "nr long, doc_id long, piece int, start long, length long, ids_crc32 long"

#: How the tokenizer must cut texts for ids to be put together from units: parts never reach over white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)


def _classes() -> np.ndarray:
    """The class of each byte that is a character by itself; all others, and controls, are OTHER."""
    out = np.full(256, OTHER, np.uint8)
    out[33:127] = MARK
    for first, last, kind in (("a", "z", LETTER), ("A", "Z", LETTER), ("0", "9", DIGIT), ("\t", "\r", SPACE), (" ", " ", SPACE)):
        out[ord(first) : ord(last) + 1] = kind
    return out


CLASS = _classes()
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32


def units(b: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cut the texts b[begins[0]:begins[1]], ... into units that are tokenized apart from each other.

    A unit is a run of letters, a digit or a run of marks between white space. A chunk between white space that has anything
    else in it (a character beyond Latin letters, an apostrophe before a letter, the opening of a special token) is one unit.
    Returns start and length of each unit, their bytes one after the other (A-Z lowered), and whether each is such a chunk.
    """
    kind = CLASS[b]
    after = np.append(b[1:], np.uint8(32))
    # U+00C0 to U+027F are letters, but for the two signs among them and the I with dot, which lowers to two characters.
    latin = (b >= 0xC3) & (b <= 0xC9) & (after >= 0x80) & (after <= 0xBF)
    latin &= ~(((b == 0xC3) & ((after == 0x97) | (after == 0xB7))) | ((b == 0xC4) & (after == 0xB0)))
    lead = np.flatnonzero(latin)
    kind[lead] = LETTER
    kind[lead + 1] = LETTER
    inside = kind != SPACE
    first = np.append(True, ~inside[:-1])[: len(b)]
    first[begins[begins < len(b)]] = True
    first &= inside
    odd = (kind == OTHER) | ((b == 39) & (np.append(kind[1:], SPACE) == LETTER)) | ((b == 60) & (after == 124))
    chunk = np.flatnonzero(first)
    whole = np.zeros(len(chunk), bool)
    whole[np.searchsorted(chunk, np.flatnonzero(odd & inside), side="right") - 1] = True
    cut = np.append(True, kind[1:] != kind[:-1])[: len(b)] | (kind == DIGIT) | first
    at = np.flatnonzero(cut & inside)
    of = np.cumsum(first[at]) - 1
    keep = first[at] | ~whole[of]
    at, of = at[keep], of[keep]
    last = np.flatnonzero(inside & ~np.append(inside[1:] & ~first[1:], False)[: len(b)]) + 1
    size = np.minimum(np.append(at[1:], len(b)), last[of]) - at
    low = LOWERED[b]
    for c in np.unique(of[whole[of]][[b"<|" in b[x : x + n].tobytes() for x, n in zip(at[whole[of]].tolist(), size[whole[of]].tolist())]]) if whole.any() else ():
        low[chunk[c] : last[c]] = b[chunk[c] : last[c]]  # special tokens are told by their case
    return at, size, low[inside], whole[of]


def _kept_by_worker(name: str, make):
    """A value that a worker process makes once and keeps for its later tasks."""
    store = sys.modules.setdefault("_seriescope_worker", types.ModuleType("_seriescope_worker")).__dict__
    return store[name] if name in store else store.setdefault(name, make())


class Encoder:
    """Ids of whole texts.

    Where the tokenizer splits at white space and into the parts of ``SPLIT``, the ids of a text are those of its units, and
    each distinct unit is encoded once, for as long as there is room to remember it. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_unit = self._splits(told)
        # The last id of each unit tells that it ends there.
        suffix = told["model"].get("end_of_word_suffix")
        self.ends = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        if suffix:
            self.ends[[i for word, i in self.tokenizer.get_vocab().items() if word.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    @staticmethod
    def _splits(told: dict) -> bool:
        first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        changes = [n["type"] for n in (told.get("normalizer") or {}).get("normalizers") or []]
        tight = all(not t["lstrip"] and not t["rstrip"] and not re.search(r"\s", t["content"]) and t["content"].startswith("<|") for t in told.get("added_tokens") or [])
        return first.get("pattern") == {"Regex": SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True and changes == ["NFC", "Replace", "Lowercase"] and tight

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes

    def _ids_together(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of one class, many of them as one text: each gives ids of which only the last one ends a unit."""
        ids, ones = self._ids([b" ".join(parts[k : k + TOGETHER]) for k in range(0, len(parts), TOGETHER)])
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(parts) or (np.searchsorted(last, np.cumsum(ones)) + 1 != np.minimum(np.arange(1, len(ones) + 1) * TOGETHER, len(parts))).any():
            return self._ids(parts)
        return ids, np.diff(last, prepend=0)

    def _learn(self, texts: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + len(texts) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[n : n + len(texts)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(texts)] = sizes
        self.used += len(ids)
        self.known.update(zip(texts, range(n, n + len(texts))))

    def __call__(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[begins[0]:begins[1]], ... one after the other, and how many each text has."""
        if not self.by_unit:
            return self._ids([data[a:b].tobytes() for a, b in zip(begins.tolist(), np.append(begins[1:], len(data)).tolist())])
        at, size, body, whole = units(data, begins)
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        texts, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) > REMEMBERED:
            self._forget()
        odd = np.zeros(len(texts), bool)
        odd[index[whole]] = True  # equal units are of one kind
        new = [[], []]
        for t, o in zip(texts, odd.tolist()):
            if t not in self.known:
                new[o].append(t)
        self._learn(new[0], *self._ids_together(new[0]))
        self._learn(new[1], *self._ids(new[1]))
        row = np.fromiter(map(self.known.__getitem__, texts), np.int64, len(texts))[index]
        sizes = self.sizes[row]
        total = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(self.starts[row] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(at, np.append(begins, len(data)))])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: nr (its own number), doc_id, piece, start, length, ids_crc32; ``ids`` too if asked for.
    ``tokenizer``: a file that every worker has."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _kept_by_worker(f"encoder {path}", lambda: Encoder(path))
        nr = TaskContext.get().partitionId() << 40
        for docs, data, begins in gathered(batches, BATCH_BYTES):
            found, sizes = encode(data, begins)
            # Each text ends with id 0.
            ids = np.zeros(len(found) + len(sizes), "<u4")
            ids[np.arange(len(found)) + np.repeat(np.arange(len(sizes)), sizes)] = found
            sizes = sizes + 1
            count = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            at = np.cumsum(length)
            raw = memoryview(ids.view(np.uint8))
            crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((at - length).tolist(), at.tolist())), np.int64, len(at))
            out = [np.arange(nr, nr + len(doc)), docs.take(pa.array(doc)), piece.astype(np.int32), start, length, crc]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(0, at), pa.int32()), pa.array(ids.view(np.int32))))
            nr += len(doc)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=["nr", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of the volume bound and two families of dual feasible functions."""
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    for k in np.unique(np.concatenate([np.flatnonzero(counts[: capacity // 2 + 1]), [0]])):
        # Sizes over capacity - k count as whole bins, sizes under k as nothing.
        best = max(best, int(counts[capacity - k + 1 :].sum()) + -(-int((counts * size)[k : capacity - k + 1].sum()) // capacity))
    for k in range(1, 41):
        # Rounding by k + 1 parts: x stays where (k + 1) x is whole, else floor((k + 1) x) / k.
        parts = (k + 1) * size
        value = np.where(parts % capacity == 0, size * k, (parts // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place of each length, by best-fit decreasing, and the room left in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []
    having = 0  # bit r: some open bin has room r
    for i in order.tolist():
        size = int(lengths[i])
        fits = having >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                having &= ~(1 << room)
        else:
            room, b = capacity, len(rooms)
            rooms.append(capacity)
        bins[i], places[i] = b, capacity - room
        rooms[b] = left = room - size
        if left:
            by_room[left].append(b)
            having |= 1 << left
    return bins, places, np.array(rooms, np.int64)


def _pack_group(table: pa.Table, last: bool, capacity: int) -> pa.Table:
    """Adds bin, offset, stays, n_bins and bound to the rows of one group."""
    table = table.sort_by([("length", "descending"), ("nr", "ascending")])
    lengths = table.column("length").to_numpy().astype(np.int64)
    bins, places, rooms = best_fit(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if last:
        stays = np.ones(len(rooms), bool)
    elif len(rooms) == bound:
        stays = np.ones(len(rooms), bool)
        stays[np.argmax(rooms)] = rooms.max() == 0
    else:
        stays = rooms == 0
    same = lambda x: pa.array(np.full(len(lengths), x, np.int64))
    for name, x in (("bin", pa.array(bins)), ("offset", pa.array(places)), ("stays", pa.array(stays[bins])), ("n_bins", same(len(rooms))), ("bound", same(bound))):
        table = table.append_column(name, x)
    return table


def _packer(last: bool, capacity: int):
    return lambda table: _pack_group(table, last, capacity)


def pack(rows: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (as of ``pieces``) with sequence_id and offset; every bin's places are gapless from 0."""
    names = [f.strip().split(" ")[0] for f in PIECES.split(",")]
    cut = materialized(rows.select(*names), "pieces")
    out, left, n = None, cut, cut.count()
    schema = f"grp long, {PIECES}, bin long, offset long, stays boolean, n_bins long, bound long"
    for turn in range(rounds + 1):
        groups = max(1, -(-n // group_pieces))
        last = turn == rounds or (groups == 1 and turn > 0)
        # Pieces are dealt by their own number: rows without an id, or with one id, spread like any others.
        dealt = left.withColumn("grp", F.pmod(F.xxhash64(F.lit(turn), "nr"), F.lit(groups)))
        packed = materialized(dealt.select("grp", *names).groupBy("grp").applyInArrow(_packer(last, capacity), schema), f"packed-{turn}")
        done = packed.where("stays").select(*names[1:], (F.lit(turn * (1 << 56)) + F.col("grp") * (1 << 28) + F.col("bin")).alias("sequence_id"), "offset")
        out = done if out is None else out.unionAll(done)
        left = packed.where("not stays").select(*names)
        if last or not (n := left.count()):
            break
    discard(cut)
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, id_col, text_col, tokenizer, capacity), capacity)
