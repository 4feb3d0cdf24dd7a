"""Language-model scores by deleted interpolation of n-grams.

The model mixes the maximum-likelihood estimates of orders two, one and zero:

    P(w | h) = a c(h, w) / c(h) + b c(w) / N + g / (V + 1)

with weights (a, b, g) for each bucket of c(h), the frequency of the context. The
weights are learned by expectation-maximisation on held-out counts: a fold of
the training documents is deleted from the counts, and the likelihood of its
tokens under the rest is raised. The final counts are those of all training
documents.

Counts never gather in one place. The documents are written once as numbered
chunks. Each chunk sends its distinct words and word pairs (as sorted hashes, in
ranges), so a word that fills a third of all text is one entry a chunk. Each range
is summed by itself, slice by slice, and the totals go back to the chunks that
asked, in the same order, where the texts meet them by the chunk's number. What
is shuffled grows with the distinct pairs of the input; only the histogram for the
weights, of fixed size, reaches the driver.

Ranges are of ``RANGE_MB`` of input up to ``MOST_RANGES`` of them, as more would
leave a chunk with single entries for each. Larger inputs have larger ranges (half
a gigabyte of text at 100 TB); their rows stay compressed and ``SLICE_ENTRIES``
entries are summed at a time.

Defined cases: a null or empty text is the end token alone; a null id counts as
the text ``''`` for the folds; repeated rows are scored and counted each; very
long texts make a chunk of their own; without training documents every score is
that of an unknown token; an empty table gives an empty result; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.scratch import Scratch
from timberline.llm.textkit import U, column_bytes, mix, slices, split_words

CHUNK_BYTES, CHUNK_MOST = 4 << 20, 64 << 20
END, BEGIN = U(0xA5A5F00DCAFE1234), U(0x1357BEEF2468ACE1)
CONTEXT_BUCKETS = 24  # by powers of two of c(h); bucket 0: never seen
BINS = 96  # of each probability, by its logarithm
DELETED_FOLDS = 10  # one in so many training documents is the deleted fold
RANGE_MB = 2
MOST_RANGES = 1 << 18
SLICE_ENTRIES = 1 << 22


def fold_of(doc_id: Column) -> Column:
    """1: kept out of training; 2: trains, and is deleted for the weights; 0: trains."""
    code = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.when(code % 5 == 1, 1).when(F.floor(code / 5) % DELETED_FOLDS == 0, 2).otherwise(0).cast("int")


# ------------------------------------------------------------------ chunks
class Chunk:
    """Tokens of some documents: words, then one end each."""

    def __init__(self, ids: list[pa.Array], folds: list[np.ndarray], hashes: list[np.ndarray], counts: list[np.ndarray]):
        self.ids = pa.concat_arrays(ids)
        self.fold = np.concatenate(folds)
        words, size = np.concatenate(hashes), np.concatenate(counts)
        self.size = size + 1
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        token = np.full(self.first[-1], END)
        inside = np.ones(len(token), bool)
        inside[self.first[1:] - 1] = False
        token[inside] = words
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first[:-1]] = BEGIN
        pair = mix(before * U(0xD1342543DE82EF95) + token)
        self.row = np.repeat(np.arange(len(self.size)), self.size)
        self.words, self.word_at = np.unique(token, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair, return_inverse=True)

    @property
    def context_at(self) -> np.ndarray:
        """Place of each token's context in ``words``; -1 at the beginning."""
        out = np.empty_like(self.word_at)
        out[1:] = self.word_at[:-1]
        out[self.first[:-1]] = -1
        return out

    def checksum(self) -> int:
        return int(np.bitwise_xor.reduce(self.words, initial=U(0)) ^ np.bitwise_xor.reduce(self.pairs, initial=U(len(self.row)))) & (2**63 - 1)


def chunk_bytes(size: int) -> int:
    """Larger inputs have more ranges, so their chunks are larger too (as the square
    root), which keeps what a chunk sends to a range from falling to single words."""
    return int(min(CHUNK_MOST, CHUNK_BYTES * max(1.0, (size / 30e9) ** 0.5)))


def _pack(limit: int):
    """Chunks of doc_id, fold, text rows as one compressed row each, numbered by
    partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=1)
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([squeeze.compress(sink.getvalue())], pa.binary())], names=["chunk", "rows"])

        for batch in slices(batches):
            held.append(batch)
            size += len(column_bytes(batch.column(2))[0])
            if size >= limit:
                yield row()
                number, held, size = number + 1, [], 0
        if held:
            yield row()

    return run


def unpacked(rows: bytes) -> Chunk:
    import zstandard

    return chunk_of(list(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows))))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.column(0)[r].as_py(), unpacked(batch.column(1)[r].as_py())


def chunk_of(held: list[pa.RecordBatch]) -> Chunk:
    parts = [split_words(b.column(2), lower=True) for b in held]
    return Chunk([b.column(0) for b in held], [np.asarray(b.column(1)) for b in held], [p.hashes() for p in parts], [p.counts for p in parts])


def planes(x: np.ndarray) -> bytes:
    """Compressed byte planes: sorted hashes share their upper bytes, and most
    counts are ones."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unplanes(raw: bytes, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return flat.reshape(size, -1).T.copy().view(kind).reshape(-1)


# ------------------------------------------------------------------ counts
_ASK = pa.schema([("range", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("sum", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
_GOT = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("range", pa.int32()), ("slice", pa.int32()), ("sum", pa.int64()), ("counts", pa.binary()), ("vocabulary", pa.int64()), ("tokens", pa.int64()), ("deleted", pa.int64())])


def _ask(ranges_log2: int):
    """Each chunk's distinct words (kind 0) and pairs (kind 1), range by range,
    with how often training documents, and those of the deleted fold, have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in numbered(batches):
            fold = chunk.fold[chunk.row]
            rows, check = [], chunk.checksum()
            for kind, hashes, at in ((0, chunk.words, chunk.word_at), (1, chunk.pairs, chunk.pair_at)):
                train = np.bincount(at[fold != 1], minlength=len(hashes)).astype(np.uint32)
                gone = np.bincount(at[fold == 2], minlength=len(hashes)).astype(np.uint32)
                edges = np.searchsorted(hashes, [U(k << (64 - ranges_log2)) for k in range(1 << ranges_log2)]).tolist() + [len(hashes)]
                for k in range(1 << ranges_log2):
                    i, j = edges[k], edges[k + 1]
                    if j > i:
                        rows.append((k, kind, number, check, planes(hashes[i:j]), planes(np.stack([train[i:j], gone[i:j]], 1).reshape(-1))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASK)], schema=_ASK)

    return run


def _sum_range(ranges_log2: int):
    """Totals of one range, handed back to each asking chunk in its own order. The
    range is summed in slices of about ``SLICE_ENTRIES`` entries."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        for kind in (0, 1):
            part = table.filter(pa.compute.equal(table["kind"], kind))
            if not part.num_rows:
                continue
            edges = _slice_edges(part["hashes"], part["range"][0].as_py(), ranges_log2)
            for nth, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
                hashes, counts = [], []
                for packed, counted in zip(part["hashes"], part["counts"]):
                    h, c = unplanes(packed.as_py(), np.uint64), unplanes(counted.as_py(), np.uint32).reshape(-1, 2)
                    if len(edges) > 2:
                        mine = slice(int(np.searchsorted(h, U(low))), int(np.searchsorted(h, U(high - 1), "right")))
                        h, c = h[mine].copy(), c[mine].copy()
                    hashes.append(h)
                    counts.append(c)
                sizes = [len(h) for h in hashes]
                distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
                del hashes
                counts = np.concatenate(counts)
                total = np.stack([np.bincount(at, counts[:, k], len(distinct)) for k in (0, 1)], 1).astype(np.uint64)  # doubles count exactly up to 2 ** 53
                del counts
                for r, (end, size) in enumerate(zip(np.cumsum(sizes), sizes)):
                    known = (int((total[:, 0] > 0).sum()), *(int(x) for x in total.sum(0))) if kind == 0 and r == 0 else (0, 0, 0)
                    out.append((part["chunk"][r].as_py(), kind, part["range"][r].as_py(), nth, part["sum"][r].as_py(), planes(total[at[end - size : end]].reshape(-1)), *known))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _GOT)], schema=_GOT)

    return run


def _slice_edges(packed: pa.ChunkedArray, nth: int, ranges_log2: int) -> list[int]:
    """Hashes that cut the range ``nth`` evenly into slices."""
    import zstandard

    entries = sum(zstandard.frame_content_size(p.as_py()) for p in packed) // 8
    n, wide = max(1, -(-entries // SLICE_ENTRIES)), 1 << (64 - ranges_log2)
    return [nth * wide + wide * k // n for k in range(n + 1)]


def _totals(table: pa.Table, kind: int, size: int, check: int) -> np.ndarray:
    """size x 2 counts (training, deleted fold) in the order of the chunk's hashes."""
    part = table.filter(pa.compute.equal(table["kind"], kind)).sort_by([("range", "ascending"), ("slice", "ascending")])
    got = np.concatenate([unplanes(c, np.uint64).reshape(-1, 2) for c in part["counts"].to_pylist()]) if part.num_rows else np.zeros((0, 2), np.uint64)
    if len(got) != size or (size and part["sum"][0].as_py() != check):
        raise RuntimeError("a chunk's totals aren't those that it asked for")
    return got.astype(np.int64)


# ----------------------------------------------------------------- weights
def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 1, CONTEXT_BUCKETS - 1), 0)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for probability 0, else by the logarithm, down to 1e-12."""
    return np.where(p > 0, np.clip(BINS + np.log10(np.maximum(p, 1e-12)) * (BINS - 1) / 12, 1, BINS - 1).astype(np.int64), 0)


def _middle(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, np.minimum(10 ** ((b + 0.5 - BINS) * 12 / (BINS - 1)), 1.0), 0.0)


def learn_weights(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 200) -> np.ndarray:
    """EM for each context bucket; ``cells``: bucket, bin of order two, bin of
    order one, tokens. Without tokens a bucket takes the weights below it."""
    weights = np.tile([0.3, 0.6, 0.1], (CONTEXT_BUCKETS, 1))
    weights[0] = [0.0, 0.8, 0.2]
    data = np.array(cells, np.float64).reshape(-1, 4)
    for k in range(CONTEXT_BUCKETS):
        mine = data[data[:, 0] == k]
        if not len(mine):
            if k > 1:
                weights[k] = weights[k - 1]
            continue
        p = np.stack([_middle(mine[:, 1].astype(int)), _middle(mine[:, 2].astype(int)), np.full(len(mine), uniform)], 1)
        w = weights[k]
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            new = (share * mine[:, 3:4]).sum(0) / mine[:, 3].sum()
            new = np.maximum(new, [0.0 if k == 0 else 1e-9, 1e-9, 1e-9])
            new /= new.sum()
            if np.abs(new - w).max() < 1e-10:
                break
            w = new
        weights[k] = w
    return weights


def _histogram(tokens: int, deleted: int):
    n = max(1, tokens - deleted)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        cells = []
        for r in range(left.num_rows):
            word, pair, context = (np.frombuffer(left[c][r].as_py(), np.int32) for c in ("word", "pair", "context"))
            check = left["sum"][r].as_py()
            w = _totals(right, 0, left["n_words"][r].as_py(), check)
            p = _totals(right, 1, left["n_pairs"][r].as_py(), check)
            w, p = w[:, 0] - w[:, 1], p[:, 0] - p[:, 1]
            begin = left["begin"][r].as_py()
            c = np.where(context >= 0, w[context], begin)
            two = np.where(c > 0, p[pair] / np.maximum(c, 1), 0.0)
            code = (context_bucket(c) * BINS + _bin(two)) * BINS + _bin(w[word] / n)
            values, count = np.unique(code, return_counts=True)
            cells.append(pa.table({"code": pa.array(values, pa.int64()), "n": pa.array(count, pa.int64())}))
        return pa.concat_tables(cells) if cells else pa.table({"code": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    return run


def _fold_tokens(begin: int):
    """The deleted fold's tokens as places in their chunk's words and pairs."""
    schema = pa.schema([("chunk", pa.int64()), ("sum", pa.int64()), ("n_words", pa.int64()), ("n_pairs", pa.int64()), ("begin", pa.int64()), ("word", pa.binary()), ("pair", pa.binary()), ("context", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, chunk in numbered(batches):
            mine = chunk.fold[chunk.row] == 2
            if mine.any():
                lists = [x[mine].astype(np.int32).tobytes() for x in (chunk.word_at, chunk.pair_at, chunk.context_at)]
                values = [number, chunk.checksum(), len(chunk.words), len(chunk.pairs), begin, *lists]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return run


# ------------------------------------------------------------------ scores
def token_scores(word: np.ndarray, pair: np.ndarray, context: np.ndarray, tokens: int, vocabulary: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token under the base and under the mixture, from its counts."""
    base = np.log10((word + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
    w = weights[context_bucket(context)]
    two = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    return base, np.log10(w[:, 0] * two + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (vocabulary + 1))


def _scorer(tokens: int, vocabulary: int, begin: int, weights: np.ndarray, out_schema: pa.Schema):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        done = []
        for r in range(left.num_rows):
            chunk = unpacked(left["rows"][r].as_py())
            check = chunk.checksum()
            w = _totals(right, 0, len(chunk.words), check)[:, 0]
            p = _totals(right, 1, len(chunk.pairs), check)[:, 0]
            word, at = w[chunk.word_at], chunk.context_at
            context = np.where(at >= 0, w[at], begin)
            base, score = token_scores(word, p[chunk.pair_at], context, tokens, vocabulary, weights)
            sums = lambda x: np.add.reduceat(x, chunk.first[:-1])  # noqa: B023, E731
            columns = [chunk.ids, pa.array(chunk.fold == 1), pa.array(chunk.size.astype(np.int64)), pa.array(sums((word > 0).astype(np.int64))), pa.array(np.full(len(chunk.size), tokens, np.int64)), pa.array(sums(base)), pa.array(sums(score))]
            done.append(pa.Table.from_arrays(columns, schema=out_schema))
        return pa.concat_tables(done) if done else out_schema.empty_table()

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    kept = docs.select(docs["doc_id"], fold_of(docs["doc_id"]).alias("fold"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    size = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges_log2 = max(1, (max(least, min(MOST_RANGES, size // (RANGE_MB << 20))) - 1).bit_length())
    chunks = scratch.save(kept.mapInArrow(_pack(chunk_bytes(size)), "chunk long, rows binary"), "chunks")
    asked = chunks.mapInArrow(_ask(ranges_log2), "range int, kind int, chunk long, sum long, hashes binary, counts binary")
    got = scratch.save(asked.groupBy("range").applyInArrow(_sum_range(ranges_log2), "chunk long, kind int, range int, slice int, sum long, counts binary, vocabulary long, tokens long, deleted long"), "counts")
    by_fold = {r["fold"]: r["n"] for r in kept.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    size = got.agg(F.sum("vocabulary").alias("v"), F.sum("tokens").alias("n"), F.sum("deleted").alias("d")).first()
    vocabulary, tokens, deleted = (size[c] or 0 for c in "vnd")
    answers = got.select("chunk", "kind", "range", "slice", "sum", "counts")
    begin, begin_deleted = by_fold.get(0, 0) + by_fold.get(2, 0), by_fold.get(2, 0)

    fold = chunks.mapInArrow(_fold_tokens(begin - begin_deleted), "chunk long, sum long, n_words long, n_pairs long, begin long, word binary, pair binary, context binary")
    cells = fold.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_histogram(tokens, deleted), "code long, n long")
    cells = cells.groupBy("code").agg(F.sum("n").alias("n")).collect()  # BINS * BINS * CONTEXT_BUCKETS rows at most
    weights = learn_weights(sorted((c["code"] // BINS**2, c["code"] // BINS % BINS, c["code"] % BINS, c["n"]) for c in cells), 1 / (vocabulary + 1))

    fields = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    kind = kept.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scorer(tokens, vocabulary, begin, weights, arrow), f"doc_id {kind.simpleString()}, {fields}")
