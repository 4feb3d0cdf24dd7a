"""Near-duplicate documents by order MinHash and banded alignment.

A document is the sequence of its words (runs between ASCII white space). Its
k-mers are runs of five words, each labelled with how often it came before. For
each of ``SKETCHES`` seeds the ``ORDER`` labelled k-mers with the smallest hashes
are kept *in text order* and hashed together: two documents agree in a sketch
when they share those k-mers in the same order, so order counts as it does for
edit distance. Documents that agree in any sketch are candidates.

A candidate pair is verified by aligning its two word sequences within a band:
with M aligned words, the edit similarity is M / max(m, n), the share of the
longer text that stays in place. At a similarity of 0.8 an alignment leaves the
diagonal by no more than a fifth of the longer text, so the band loses nothing.

One changed word breaks five k-mers, so texts with a share e of their words
changed at random have a Jaccard similarity of J = s / (2 - s), s = (1 - e) ** 5,
and agree in a sketch with about J ** 2: with 40 sketches they meet with 0.9995 at
e = 0.1, 0.97 at 0.15 and 0.79 at the threshold itself; over even shares up to
the threshold 0.96 of the pairs meet, and chains through other copies add to it.

Copies of one text are one class from the start, found by digest, and take part
once. In a large bucket each text meets the leader only, which joins most of
them. Where texts of several classes remain, they are compared in blocks of
bounded size by length; a pair of blocks gives links between classes only, so
never more than it has texts. No link between two texts that share a bucket is
lost, and no bucket is cut off. Classes are the connected components of verified
pairs.

Word sequences travel as 32-bit word hashes.

Defined cases: a null text is an empty one; texts without words are a class only
with their equals; a text with one to four words has its
whole word sequence as its only k-mer; a row with a null id is judged as any
other, and the class_id is null only where all ids of the class are; repeated rows are copies; very long texts are
aligned within the band; an empty table gives an empty result. A class is known by
its label, the smallest digest of its texts: unlike texts that carry one id, or
none, are of different labels though their class_id is the same.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.components import connected_components
from timberline.llm.scratch import Scratch
from timberline.llm.textkit import U, Words, mix, signed, slices, split_words

WORDS = 5
SKETCHES = 40
ORDER = 2
THRESHOLD = 0.8
SMALL = 8  # buckets of so many texts or fewer are compared at once
BLOCK_WORDS = 100_000
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (SKETCHES, 2), dtype=np.uint64) * U(2) + U(1)


def kmers(words: Words, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all rows, and where each row's begin."""
    hashed, counts = words.hashes(), words.counts
    number = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    first = np.concatenate([[0], np.cumsum(number)])
    row = np.repeat(np.arange(len(number)), number)
    start = words.first[:-1][row] + (np.arange(first[-1]) - first[:-1][row])
    return words.sequence_hash(hashed, start, np.minimum(k, counts[row])), first


def occurrence_labels(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each k-mer came before in its row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((grams, row))
    g, r = grams[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    out = np.empty(len(g), np.int64)
    out[order] = np.arange(len(g)) - begin
    return out


def sketches(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows x SKETCHES signatures; rows without k-mers have zeros."""
    n = len(first) - 1
    out = np.zeros((n, SKETCHES), U)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    labelled = mix(grams + occurrence_labels(grams, first).astype(U) * U(0x9FB21C651E98DF25))
    begin = first[:-1][full]
    # The place in the low bits: the least value tells where it is.
    bits = U(len(labelled).bit_length())
    low = (U(1) << bits) - U(1)
    place = np.arange(len(labelled), dtype=U)
    for s, (by, add) in enumerate(_SEEDS):
        value = (labelled * by + add) & ~low | place
        spots = []
        for _ in range(ORDER):
            least = np.minimum.reduceat(value, begin)
            spot = (least & low).astype(np.int64)
            if spots:  # a text of one k-mer has no second
                spot = np.where(least == ~U(0), spots[-1], spot)
            spots.append(spot)
            value[spot] = ~U(0)
        joined = np.full(len(full), by, U)
        for spot in np.sort(np.stack(spots), axis=0):  # back to text order
            joined = mix(joined * U(0x2545F4914F6CDD1D) + labelled[spot])
        out[full, s] = joined
    return out


# ------------------------------------------------------------- alignment
def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of a longest common subsequence of ``a`` and ``b`` whose matches lie
    at most ``band`` off the diagonal; ``band`` is no less than their difference in
    length.

    Rows are computed by bits: a zero at column j says that the best alignment
    grows there. Columns more than ``band`` behind the row don't change any more and
    are counted and shifted out, so a row takes as many bits as the band is wide.
    """
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    head = int(other[0]) if len(other) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    other = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(other[0]) if len(other) else n
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not a or not b:
        return head + tail
    found, row, left, right = 0, 0, 0, 0
    bits = 0  # of the columns left to right
    step = max(64, band)
    ones = (1 << (2 * band + 1)) - 1
    while row < len(a):
        rows = a[row : row + step]
        gone = min(max(left, row - band), right) - left
        found += gone - (bits & ((1 << gone) - 1)).bit_count()
        bits, left = bits >> gone, left + gone
        stop = min(len(b), row + len(rows) + band)
        bits |= ((1 << (stop - right)) - 1) << (right - left)
        right = stop
        matches: dict[int, int] = defaultdict(int)
        for j, w in enumerate(b[left:right]):
            matches[w] |= 1 << j
        whole = (1 << (right - left)) - 1
        for i, w in enumerate(rows, row):
            match = matches.get(w)
            if match:
                shift = i - band - left
                hit = bits & match & (ones << shift if shift >= 0 else ones >> -shift)
                bits = ((bits + hit) | (bits - hit)) & whole
        row += len(rows)
    return head + tail + found + (right - left) - bits.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned words over the words of the longer; 0 where it can't reach the threshold."""
    most = max(len(a), len(b))
    if not most or min(len(a), len(b)) < threshold * most - 1e-9:
        return 0.0
    x, cx = np.unique(a, return_counts=True)
    y, cy = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if np.minimum(cx[i], cy[j]).sum() < threshold * most - 1e-9:
        return 0.0
    return aligned(a, b, int(most * (1 - threshold) + 1e-9)) / most


# ------------------------------------------------------------------ Spark
def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, node (the digest of the text), n (words), s (array of signatures):
    narrow rows from one scan, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column(2))
            grams, first = kmers(words)
            made = signed(sketches(grams, first))
            lists = pa.ListArray.from_arrays(np.arange(0, made.size + 1, SKETCHES, dtype=np.int32), made.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words.counts, pa.int64()), lists], names=["doc_id", "node", "n", "s"])

    return _texts(docs).mapInArrow(run, "doc_id long, node binary, n long, s array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))


def word_table(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its word hashes, packed as 32-bit numbers. ``nodes``: node and rep,
    an id that has the text, so that of many copies one is moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column(1))
            low = (words.hashes() >> U(32)).astype(np.uint32)
            packed = [low[i:j].tobytes() for i, j in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "words"])

    rows, wanted = _texts(docs), nodes.withColumnRenamed("node", "w")
    picked = rows.join(wanted, (rows["node"] == wanted["w"]) & rows["doc_id"].eqNullSafe(wanted["rep"]))
    return picked.select("node", "text").mapInArrow(run, "node binary, words binary").dropDuplicates(["node"])


def verify(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs a, b whose similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("wa"), batch.column("wb")
            scores = np.array([similarity(_unpacked(left[r].as_buffer()), _unpacked(right[r].as_buffer())) for r in range(batch.num_rows)])
            keep = np.flatnonzero(scores >= THRESHOLD - 1e-12)
            kept = batch.select(["a", "b"]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores[keep], pa.float64())], names=["a", "b", "similarity"])

    one = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    two = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary, similarity double")


def _unpacked(words) -> np.ndarray:
    return np.frombuffer(words, np.uint32)


def verified_edges(docs: DataFrame, texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """node, label of the classes that pairs of texts make which met in a small bucket or
    with a leader, and a, b of the pairs that link such classes further, if there may be
    any. ``texts``: node, rep, n, s with one row per distinct text."""
    rows = texts.where("n > 0").select("node", F.explode(F.array_distinct("s")).alias("bucket"))
    shared = scratch.save(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    met = rows.join(shared, "bucket")
    members = scratch.save(met.join(texts.select("node", "n"), "node"), "members")
    weight = scratch.save(members.groupBy("node").agg(F.sum("size").alias("weight")), "weight")
    words = scratch.save(word_table(docs, weight.select("node").join(texts.select("node", "rep"), "node")), "words")

    # Few texts: each meets each. Many: each meets the leader, the text that shares
    # the most sketches with others, such as the one that the others were made from.
    few, many = members.where(F.col("size") <= SMALL), scratch.save(members.where(F.col("size") > SMALL), "many")
    one = few.select("bucket", F.col("node").alias("a"), F.col("n").alias("an"))
    two = few.select("bucket", F.col("node").alias("b"), F.col("n").alias("bn"))
    fits = f"least(an, bn) >= {THRESHOLD} * greatest(an, bn) - 1e-9"
    each = one.join(two, "bucket").where(f"a < b and {fits}").select("a", "b")
    lead = many.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("x"))
    lead = scratch.save(lead.select("bucket", F.col("x.node").alias("b"), F.col("x.n").alias("bn")), "leaders")
    led = many.select("bucket", F.col("node").alias("a"), F.col("n").alias("an")).join(lead, "bucket").where(f"a <> b and {fits}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = scratch.save(verify(each.unionByName(led).distinct(), words), "edges-led")
    labels = connected_components(edges, scratch, "led")

    # Buckets whose texts aren't of one class yet: the rest are compared in blocks.
    # Texts that can be linked differ in length by less than a class of lengths.
    known = scratch.save(many.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    still = known.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    sized = F.floor(F.log(F.col("n") + 0.0) / F.log(F.lit(1 / THRESHOLD)) + 1e-6).cast("int")
    still = scratch.save(still, "open")
    if not still.limit(1).count():
        return labels, None
    rest = scratch.save(known.join(still, "bucket").withColumn("length", sized), "rest")
    mass = scratch.save(rest.groupBy("bucket", "length").agg(F.ceil(F.sum("n") / BLOCK_WORDS).cast("int").alias("parts")), "mass")
    block = F.pmod(F.xxhash64("node"), "parts").cast("int").alias("block")
    placed = rest.join(mass, ["bucket", "length"]).select("bucket", "length", block, "node", "label").withColumnRenamed("node", "w")
    packed = placed.join(words, F.col("w") == F.col("node")).groupBy("bucket", "length", "block").agg(F.collect_list(F.struct("node", "label", "words")).alias("rows"))
    packed = scratch.save(packed, "blocks")
    left = packed.select("bucket", "length", F.col("block").alias("i"), F.col("rows").alias("x"))
    right = packed.select("bucket", F.col("length").alias("own"), F.explode(F.array(F.col("length"), F.col("length") - 1)).alias("length"), F.col("block").alias("j"), F.col("rows").alias("y"))
    pairs = left.join(right, ["bucket", "length"]).where("own > length or i <= j").select("x", "y")
    found = pairs.mapInArrow(_compare_blocks, "a binary, b binary, similarity double")
    return labels, scratch.save(found.distinct(), "edges-rest")


@dataclass
class _Block:
    """Texts of a bucket: their words, labelled with occurrences, as postings."""

    nodes: list[bytes]
    labels: list[bytes]
    words: list[np.ndarray]
    marked: list[np.ndarray]

    @staticmethod
    def of(rows: list[dict]) -> _Block:
        words = [_unpacked(r["words"]) for r in rows]
        first = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        flat = np.concatenate(words).astype(U)
        marked = mix(flat + occurrence_labels(flat, first).astype(U) * U(0x9FB21C651E98DF25))
        return _Block([r["node"] for r in rows], [r["label"] for r in rows], words, [marked[i:j] for i, j in zip(first[:-1], first[1:])])

    def postings(self) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(self.marked)
        owner = np.repeat(np.arange(len(self.marked)), [len(x) for x in self.marked])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]


class _Classes:
    """Labels that links have joined."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def top(self, label: bytes) -> bytes:
        while (up := self.up.get(label, label)) != label:
            self.up[label] = self.up.get(up, up)
            label = up
        return label


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between texts of different classes in two blocks of one bucket. The
    common words of a text with all texts of a block are counted at once, so what is
    held is a row of counts; a link that joins no two classes isn't looked for, so a
    pair of blocks gives fewer links than it has classes."""
    for batch in batches:
        found = []
        for r in range(batch.num_rows):
            x, y = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
            everyone = Counter(row["label"] for row in x + y)
            if len(everyone) > 1:
                usual = everyone.most_common(1)[0][0]
                classes, bx, by = _Classes(), _Block.of(x), _Block.of(y)
                found += _links(bx, by, usual, classes)
                if x != y:
                    found += _links(by, bx, usual, classes)
        a, b, s = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])


def _links(some: _Block, all_of: _Block, usual: bytes, classes: _Classes) -> Iterator[tuple[bytes, bytes, float]]:
    """Links of the texts of ``some`` that aren't of the usual class."""
    flat, owner = all_of.postings()
    size = np.array([len(w) for w in all_of.words])
    for i, label in enumerate(some.labels):
        if label == usual:
            continue
        low, high = np.searchsorted(flat, some.marked[i], "left"), np.searchsorted(flat, some.marked[i], "right")
        count = high - low
        hits = owner[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        common = np.bincount(hits, minlength=len(size))
        near = common / np.maximum(size, len(some.marked[i]))
        for j in sorted(np.flatnonzero(near >= THRESHOLD - 1e-9).tolist(), key=lambda j: -near[j]):
            mine, other = classes.top(label), classes.top(all_of.labels[j])
            if mine != other:
                s = similarity(some.words[i], all_of.words[j])
                if s >= THRESHOLD - 1e-12:
                    classes.up[mine] = other
                    yield min(some.nodes[i], all_of.nodes[j]), max(some.nodes[i], all_of.nodes[j]), s


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest id of its
    class, for display: classes may share it), n_words, node, the digest of its
    text, and label, which no two classes share."""
    scratch = Scratch(docs.sparkSession, "near")
    table = scratch.save(sketch_table(docs), "sketches")
    texts = table.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("s").alias("s"))
    texts = scratch.save(texts, "texts")
    labels, further = verified_edges(docs, texts, scratch)
    classes = texts.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if further is not None:  # links between classes make a graph of classes
        known = scratch.save(classes.select("node", "label"), "known")
        ends = further.select("a", "b").join(known.toDF("a", "la"), "a").join(known.toDF("b", "lb"), "b")
        ends = scratch.save(ends.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "ends")
        top = connected_components(ends, scratch, "last")
        classes = classes.join(top.toDF("label", "top"), "label", "left").select("node", "rep", F.coalesce("top", "label").alias("label"))
    classes = scratch.save(classes, "named")
    # Written, so that AQE may split the partition of a class that holds most texts.
    least = scratch.save(classes.groupBy("label").agg(F.min("rep").alias("class_id")), "least")
    classes = scratch.save(classes.join(least, "label").select("node", "class_id", "label"), "classes")
    return table.join(classes, "node").select("doc_id", "class_id", F.col("n").alias("n_words"), "node", "label")


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each class: the one with the
    smallest id stays (of repeated rows with that id, one). Only narrow rows are
    compared; texts are moved once, to meet the ids that go."""
    names = docs.columns
    inner = docs.toDF(*(n if n in ("doc_id", "text") else f"c{k}" for k, n in enumerate(names)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = inner.withColumn("_node", F.unhex(F.md5(text)))
    scratch = Scratch(docs.sparkSession, "keep")
    classes = scratch.save(near_duplicates(docs), "classes")
    # One row per (id, text), then the best of its class: a third of all rows may
    # be of one class, so both are aggregations and not sorts of a group.
    own = classes.groupBy("doc_id", "node", "label").agg(F.count(F.lit(1)).alias("rows"))
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node")
    best = own.groupBy("label").agg(F.min(first).alias("x"))
    stay = scratch.save(best.select(F.col("x.doc_id").alias("sid"), F.col("x.node").alias("snode")), "stay")
    kept = keyed.join(stay, keyed["doc_id"].cast("long").eqNullSafe(stay["sid"]) & (keyed["_node"] == stay["snode"]), "left_semi")
    repeated = own.where("rows > 1").select(F.col("doc_id").alias("sid"), F.col("node").alias("snode"))
    if repeated.limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "_node"])
    return kept.select(*(F.col(n if n in ("doc_id", "text") else f"c{k}").alias(n) for k, n in enumerate(names)))
