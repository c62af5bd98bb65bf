"""Language-model scoring by deleted interpolation.

Model: the probability of a token after its predecessor is a mixture of the bigram's and the unigram's maximum-likelihood
estimates and a uniform floor. The weights depend on how often the context was seen (a bucket for each power of two) and
are learned by expectation-maximisation on deleted counts: every training token is predicted from the counts that are left
when it is taken out itself.

Execution. Words are hashed to 64 bits by XXH3. Texts are packed into compressed blocks, as they come. A block sends each of its
distinct unigrams and bigrams once, with its training count, as sorted binary runs to partitions of the hash range (postings);
a partition adds the counts up and answers every run with the corpus counts, in the same order. With its answers a block
writes two counts for each token, and nothing but these is read to learn the weights and to score. So neither the vocabulary nor
the n-grams of the corpus are ever held in one place: tasks hold one block, or one part of the hash range, and what moves
grows in proportion to the corpus. Blocks and parts grow with the square root of the corpus (``unit_bytes``), so that runs
between them stay long. Learning the weights adds up a histogram over blocks, of a size that doesn't depend on the
corpus: sixths of an octave, with exact sums inside, which moves scores by less than 0.01 %.

Defined cases: a null or empty text is the end token alone; a null id is in the fold of the empty text; repeated rows are
counted and scored each; without training rows every count is 0 and only the floor is left; an empty table gives an empty
result; further columns are not read. Texts are whole; a block with a very long text is as large as that text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_fold, gathered, materialized, text_of

FOLDS, HELD_OUT = 7, 2
#: Bytes of text of a block, and behind a part of the hash range: bounds, and hashes of an average run between the two.
LEAST_BYTES, MOST_BYTES, RUN = 2 << 20, 32 << 20, 64
#: Steps of expectation-maximisation; cells per octave of its histogram, above counts up to EXACT; buckets of context frequency.
STEPS, CELLS, EXACT, BUCKETS = 60, 6, 64, 48

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def unit_bytes(size: int) -> int:
    """Bytes of text of a block, and of a part, of a corpus of ``size`` bytes (of about six for each token)."""
    return int(min(MOST_BYTES, max(LEAST_BYTES, math.sqrt(6 * RUN * size))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Tokens:
    """The tokens of a block: hashes, and where each document starts."""

    word: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @property
    def bigram(self) -> np.ndarray:
        before = np.append(START, self.word[:-1])[: len(self.word)]
        before[self.starts] = START
        return _mix(before * np.uint64(0xA24BAED4963EE407) + _mix(self.word ^ np.uint64(0x9FB21C651E98DF25)))


def tokens_of(data: np.ndarray, begins: np.ndarray) -> Tokens:
    """The tokens of the texts data[begins[0]:begins[1]], ...; equal words are found by their bytes, and hashed once each."""
    import xxhash

    low = LOWER[data]
    inside = (low != 32) & ((low < 9) | (low > 13))
    first = np.append(True, ~inside[:-1])[: len(low)]
    first[begins[begins < len(low)]] = True
    first &= inside
    at = np.flatnonzero(first)
    offsets = np.append(np.cumsum(inside)[at] - 1, np.count_nonzero(inside)).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[coded.indices.to_numpy()]
    lengths = np.diff(np.searchsorted(at, np.append(begins, len(low)))) + 1
    word = np.full(len(at) + len(begins), END, np.uint64)
    word[np.arange(len(at)) + np.repeat(np.arange(len(begins)), lengths - 1)] = hashed
    return Tokens(word, np.cumsum(lengths) - lengths, lengths)


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as their largest needs; their number tells how many."""
    most = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)).tobytes()


def _large(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1").astype(np.int64)


BLOCKS = "block long, docs array<struct<doc_id:bigint,held_out:boolean>>, begins array<bigint>, size long, body binary"


def packed(docs: DataFrame, size: int) -> DataFrame:
    """Rows (id: doc_id and held_out, text) as blocks of about ``size`` bytes, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        block = TaskContext.get().partitionId() << 32
        for ids, data, begins in gathered(batches, size):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.array(begins))]
            out = [pa.array([block], pa.int64()), *lists, pa.array([len(data)], pa.int64()), pa.array([zstandard.ZstdCompressor(1).compress(data.tobytes())], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["block", "docs", "begins", "size", "body"])
            block += 1

    return docs.select("id", "text").mapInArrow(run, BLOCKS)


def _opened(table: pa.Table | pa.RecordBatch, row: int = 0) -> tuple[pa.Array, np.ndarray, Tokens]:
    """The documents of a block (doc_id, held_out), whether each token is for training, and the tokens."""
    import zstandard

    docs = table.column("docs")[row].values
    begins = table.column("begins")[row].values.to_numpy()
    size = table.column("size")[row].as_py()
    data = zstandard.ZstdDecompressor().decompress(table.column("body")[row].as_py(), max_output_size=max(1, size)) if size else b""
    tokens = tokens_of(np.frombuffer(data, np.uint8), begins)
    return docs, np.repeat(~docs.field("held_out").to_numpy(zero_copy_only=False), tokens.lengths), tokens


POSTS = "part int, block long, tails1 binary, counts1 binary, tails2 binary, counts2 binary"


def _post(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The runs of each block: for each part of the hash range, distinct unigrams and bigrams with their training counts."""
    edges = np.arange((1 << bits) + 1, dtype=np.uint64)
    known = bits // 8  # so many bytes of a hash are known from its part
    for batch in batches:
        for row in range(batch.num_rows):
            _, train, tokens = _opened(batch, row)
            runs = []
            for keys in (tokens.word, tokens.bigram):
                keys, place = np.unique(keys, return_inverse=True)
                counts = np.bincount(place, train, len(keys)).astype(np.int64)
                cuts = np.searchsorted(keys >> np.uint64(64 - bits), edges).tolist()
                runs.append((keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, known:], counts, cuts))
            parts = [p for p in range(1 << bits) if any(c[p] < c[p + 1] for _, _, c in runs)]
            out = [pa.array(parts, pa.int32()), pa.array([batch.column("block")[row].as_py()] * len(parts), pa.int64())]
            for tails, counts, cuts in runs:
                out.append(pa.array([tails[cuts[p] : cuts[p + 1]].tobytes() for p in parts], pa.binary()))
                out.append(pa.array([_small(counts[cuts[p] : cuts[p + 1]]) for p in parts], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["part", "block", "tails1", "counts1", "tails2", "counts2"])


ANSWERS = "block long, part int, n1 int, found1 binary, n2 int, found2 binary"


def _answer(table: pa.Table, bits: int) -> pa.Table:
    """Corpus counts for each run of a part, in the run's order."""
    wide = 8 - bits // 8
    out = [table.column("block"), table.column("part")]
    for kind in ("1", "2"):
        tails, counts = (table.column(c + kind).to_pylist() for c in ("tails", "counts"))
        sizes = np.array([len(t) // wide for t in tails], np.int64)
        flat = np.frombuffer(b"".join(tails), np.uint8).reshape(-1, wide)
        keys = np.zeros((len(flat), 8), np.uint8)
        keys[:, 8 - wide :] = flat
        values, place = np.unique(keys.view(">u8").reshape(-1).astype(np.uint64), return_inverse=True)
        given = np.concatenate([_large(c, n) for c, n in zip(counts, sizes.tolist())])
        # Sums of whole numbers below 2 ** 53 are exact as doubles.
        found = np.bincount(place, given, len(values)).astype(np.uint64)[place]
        ends = np.cumsum(sizes)
        out += [pa.array(sizes.astype(np.int32)), pa.array([_small(found[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist())], pa.binary())]
    return pa.table(out, names=["block", "part", "n1", "found1", "n2", "found2"])


COUNTED = "docs array<struct<doc_id:bigint,held_out:boolean>>, lengths array<bigint>, n long, counts binary"


def _count(table: pa.Table, answers: pa.Table) -> pa.Table:
    """Training counts of each token of a block: its own (as often as the start for the start), and the bigram's."""
    import zstandard

    docs, _, tokens = _opened(table)
    answers = answers.sort_by("part")

    def all_of(kind: str) -> np.ndarray:
        return np.concatenate([_large(x, n) for x, n in zip(answers.column("found" + kind).to_pylist(), answers.column("n" + kind).to_pylist())])

    unigrams, place = np.unique(tokens.word, return_inverse=True)
    word = all_of("1")[place]
    both = all_of("2")[np.unique(tokens.bigram, return_inverse=True)[1]]
    most = int(word.max(initial=0))
    body = np.concatenate([word, both]).astype(np.uint32 if most < 1 << 32 else np.uint64).tobytes()
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, pa.array(tokens.lengths))]
    return pa.table([*lists, pa.array([len(word)], pa.int64()), pa.array([zstandard.ZstdCompressor(1).compress(body)], pa.binary())], names=["docs", "lengths", "n", "counts"])


@dataclass
class Counted:
    """A block's documents and, for each token, the training counts of its bigram, context and word."""

    docs: pa.Array
    lengths: np.ndarray
    both: np.ndarray
    context: np.ndarray
    word: np.ndarray


def _counted(batch: pa.RecordBatch) -> Iterator[Counted]:
    import zstandard

    for row in range(batch.num_rows):
        n, lengths = batch.column("n")[row].as_py(), batch.column("lengths")[row].values.to_numpy()
        word, both = _large(zstandard.ZstdDecompressor().decompress(batch.column("counts")[row].as_py()), 2 * n).reshape(2, n)
        context = np.append(0, word[:-1])
        # Every training document ends once and starts once, so the start is seen as often as the end.
        starts = np.cumsum(lengths) - lengths
        context[starts] = word[starts + lengths - 1]
        yield Counted(batch.column("docs")[row].values, lengths, both, context, word)


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64).clip(0, BUCKETS - 1)


def _share_cell(x: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 and up by powers of 2 ** (1 / CELLS)."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1e-300)) * CELLS) + 1 + 64 * CELLS, 0).astype(np.int64)


def _count_cell(x: np.ndarray) -> np.ndarray:
    """Counts below EXACT are their own cell, larger ones go by powers of 2 ** (1 / CELLS)."""
    return np.where(x < EXACT, x, EXACT + np.floor(np.log2(np.maximum(x, EXACT) / EXACT) * CELLS)).astype(np.int64)


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of (bucket, bigram estimate, unigram count), each of what is left without the token itself; and a row of totals (bucket -1)."""
    for batch in batches:
        for block in _counted(batch):
            train = np.repeat(~block.docs.field("held_out").to_numpy(zero_copy_only=False), block.lengths)
            both, left, word = block.both[train], block.context[train] - 1, block.word[train]
            ml2 = np.where(left > 0, (both - 1) / np.maximum(left, 1), 0.0)
            values, place = np.unique((bucket_of(left) << 40) | (_share_cell(ml2) << 20) | _count_cell(word - 1), return_inverse=True)
            n, s2, s1 = np.bincount(place, minlength=len(values)), np.bincount(place, ml2, len(values)), np.bincount(place, word - 1, len(values))
            vocabulary = (1 / word).sum()  # a word seen c times adds 1 / c each time
            out = [np.append(values, -1), np.append(n, len(word)), np.append(s2, 0.0), np.append(s1, vocabulary)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["cell", "n", "s2", "s1"])


@dataclass
class Model:
    tokens: int
    vocabulary: int
    weights: np.ndarray  # by bucket: bigram, unigram, floor

    def log10(self, both: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        w = self.weights[bucket_of(context)]
        ml2 = np.where(context > 0, both / np.maximum(context, 1), 0.0)
        return np.log10(w[:, 0] * ml2 + w[:, 1] * word / max(1, self.tokens) + w[:, 2] / (self.vocabulary + 1))


def learn(cells: np.ndarray) -> Model:
    """Weights from the histogram's rows (cell, n, s2, s1)."""
    totals, rows = cells[cells[:, 0] < 0], cells[cells[:, 0] >= 0]
    tokens, vocabulary = int(totals[:, 1].sum()), round(math.fsum(totals[:, 3]))
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    bucket, n = rows[:, 0].astype(np.int64) >> 40, rows[:, 1]
    estimates = np.stack([rows[:, 2] / n, rows[:, 3] / n / max(1, tokens - 1), np.full(len(n), 1 / (vocabulary + 1))], axis=1)
    for b in np.unique(bucket):
        e, m = estimates[bucket == b], n[bucket == b]
        w = np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(STEPS):
            share = e * w
            w = (m[:, None] * share / share.sum(1, keepdims=True)).sum(0) / m.sum()
        weights[b:] = np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()  # rarer data in higher buckets: those take the weights of the last one learned
    return Model(tokens, vocabulary, weights)


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _counted(batch):
            add = lambda x: np.add.reduceat(x, np.cumsum(block.lengths) - block.lengths)  # noqa: E731, B023
            base = np.log10((block.word + 1) / (model.tokens + model.vocabulary + 1))
            own = model.log10(block.both, block.context, block.word)
            out = [block.docs.field("doc_id"), block.docs.field("held_out"), pa.array(block.lengths), pa.array(add((block.word > 0).astype(np.int64))), pa.array(np.full(len(block.docs), model.tokens, np.int64)), pa.array(add(base)), pa.array(add(own))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    doc_id = F.col(id_col).cast("long")
    slim = docs.select(F.struct(doc_id.alias("doc_id"), (doc_fold(doc_id, FOLDS) == HELD_OUT).alias("held_out")).alias("id"), text_of(text_col).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 1
    unit = unit_bytes(size)
    bits = max(8, math.ceil(math.log2(max(1, size / unit))))
    blocks = materialized(packed(slim, unit), "lm-blocks", 64)
    posts = blocks.select("block", "docs", "begins", "size", "body").mapInArrow(lambda x: _post(x, bits), POSTS)
    answers = materialized(posts.groupBy("part").applyInArrow(lambda t: _answer(t, bits), ANSWERS), "lm-answers", 2)
    counted = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_count, COUNTED)
    counted = materialized(counted, "lm-counts", 2)
    discard(blocks, answers)
    cells = materialized(counted.mapInArrow(_histogram, "cell long, n long, s2 double, s1 double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum("s1").alias("s1")), "lm-cells", 2)
    found = cells.orderBy("cell").toArrow()
    model = learn(np.stack([found.column(k).to_numpy().astype(float) for k in range(4)], axis=1))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = materialized(counted.mapInArrow(lambda x: _scores(x, model), schema), "lm-scores", 2)
    discard(counted, cells)
    return out
