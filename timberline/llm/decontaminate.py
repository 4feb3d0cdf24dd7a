"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edits.

Words are lower-cased runs of letters and digits. Every benchmark item is sought
in windows of its own size. The CGK embedding reads a window by a random walk:
at step j it writes the word at the walk's place, and moves on by a random bit
that depends on j and the word. Texts at a small edit distance give embeddings at
a small Hamming distance, since walks that part soon meet again. Bit-sampling
LSH takes a few steps of the walk as the key; a window is a candidate of an item
if any of several repetitions, each with its own walk, has equal keys. How many
repetitions the target recall needs is measured for each class of item sizes, over
all its items, with random edits at the threshold in foreign text. Where
``MAX_REPEATS`` are too few for a class, no key is asked and all windows of its
items are verified. Candidates are verified by the exact edit distance of the item
to any part of the window's surroundings.

Windows are placed where they can matter: a window within the threshold holds a
run of at least ``(n - e) / (e + 1)`` unchanged words, so one of the item's short
word runs occurs in it at the same distance from its start, up to the edits
before it. Every such place starts a window, which loses none within the
threshold.

Items are read in blocks whose size is checked before they are sent to the
executors; a larger benchmark is scanned block by block. Documents are a narrow
map, without a shuffle.

Defined cases: null and empty texts hold nothing; null or empty items (without
words) are never found; an item with a null id is sought as any other and reported
with a null item_id; items of under five words match exactly only; equal
items are all reported; repeated rows are judged one by one; an empty table on
either side gives an empty result; further columns stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.textkit import U, Words, mix, slices, split_words

THRESHOLD = 0.8
RECALL = 0.99
SAMPLES = 2  # steps of the walk in a key
MAX_REPEATS = 64
CLASS_STEP = 1.25  # sizes of a class differ by less than this factor
TRIALS = 1000  # edited copies of a class at least
TRIAL_WINDOWS = 8  # of a copy, those with the most runs; fewer never overstate the recall
BLOCK_BYTES = 16 << 20
SEED_WORDS = 3
PART_WINDOWS = 1 << 18

WORD_BREAKS = np.array([not (c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A) for c in range(256)])
_PAD = U(0x5851F42D4C957F2D)


def edits_allowed(n: int) -> int:
    return int(n * (1 - THRESHOLD) + 1e-9)


def seed_length(n: int) -> int:
    """Words in a row that survive in any window within the threshold."""
    e = edits_allowed(n)
    return max(1, min(SEED_WORDS, -(-(n - e) // (e + 1))))


def embed(words: np.ndarray, start: np.ndarray, stop: np.ndarray, repeat: int, steps: np.ndarray) -> np.ndarray:
    """Keys of windows ``words[start:stop]``: the walk of ``repeat``, sampled at
    ``steps`` (windows x SAMPLES, ascending). Windows of one call share nothing
    but the walk's randomness."""
    at = start.copy()
    key = np.zeros(len(start), U)
    last = int(steps[:, -1].max()) if len(steps) else -1
    base = int(mix(np.array([repeat + 1], U))[0])
    for j in range(last + 1):
        inside = at < stop
        word = np.where(inside, words[np.minimum(at, len(words) - 1)], _PAD)
        for s in range(steps.shape[1]):
            hit = steps[:, s] == j
            if hit.any():
                key[hit] = mix(key[hit] * U(0x2545F4914F6CDD1D) + word[hit] + U(s))
        salt = U((base + j * 0x9E3779B97F4A7C15) % (1 << 64))
        at += (mix(word ^ salt) & U(1)).astype(at.dtype) * inside
    return key


@dataclass
class Items:
    """A block of benchmark items, ready for matching."""

    ids: pa.Array  # of 64-bit integers; may hold nulls
    words: np.ndarray
    first: np.ndarray  # item i is words[first[i]:first[i + 1]]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # by length: hash, item, offset
    repeats: np.ndarray | None = None  # of each item; 0: all its windows are verified
    steps: np.ndarray | None = None  # most repeats x items x SAMPLES
    keys: np.ndarray | None = None  # most repeats x items

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)


def prepare(ids: list[int | None], item_texts: list[str | None], recall: float = RECALL) -> Items:
    words = split_words(pa.array(item_texts, pa.string()), lower=True, breaks=WORD_BREAKS)
    full = np.flatnonzero(words.counts)
    hashed, first = words.hashes(), words.first
    items = Items(pa.array(ids, pa.int64()).take(pa.array(full)), hashed, np.concatenate([first[full], first[-1:]]) if len(full) else np.zeros(1, int))
    if not len(full):
        return items
    size, begin = words.counts[full], first[full]
    items.first = np.concatenate([[0], np.cumsum(size)])
    assert (items.first[:-1] == begin - begin[0]).all()
    for q in range(1, SEED_WORDS + 1):
        mine = np.flatnonzero([seed_length(int(n)) == q for n in size])
        number = size[mine] - q + 1
        owner = np.repeat(mine, number)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        if len(owner):
            h = words.sequence_hash(hashed, begin[owner] + offset, q)
            order = np.argsort(h, kind="stable")
            items.seeds[q] = h[order], owner[order], offset[order]
    steps = _steps(size, MAX_REPEATS)
    items.repeats = np.zeros(len(size), np.int64)
    keys = np.zeros((MAX_REPEATS, len(size)), U)
    kind = np.where(size < 5, 0, np.log(size) // math.log(CLASS_STEP) + 1)
    for c in np.unique(kind):
        mine = np.flatnonzero(kind == c)
        items.repeats[mine] = _repeats_needed(items, mine, steps, keys, recall)
    most = int(items.repeats.max())
    items.steps, items.keys = steps[:most].copy(), keys[:most].copy()
    return items


def _steps(size: np.ndarray, repeats: int) -> np.ndarray:
    """Sampled steps: uniform over the part of the walk that stays in the text."""
    rng = np.random.Generator(np.random.PCG64(11))
    return np.sort((rng.random((repeats, len(size), SAMPLES)) * (2 * size)[None, :, None]).astype(np.int32), axis=2)


def _edited_copies(items: Items, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Copies of the items ``which`` with as many random edits as are allowed, between
    foreign words: their text, and the windows that their unchanged runs start, as
    copy, first word and end."""
    rng = np.random.Generator(np.random.PCG64(5))
    parts, at = [], [0]
    for n in items.size[which].tolist():
        e = edits_allowed(n)
        spots = rng.choice(n, e, replace=False)
        kind = rng.integers(0, 3, e)
        origin = np.arange(n)
        origin[spots[kind == 0]] = -n
        out = np.delete(origin, spots[kind == 1])
        out = np.insert(out, np.minimum(spots[kind == 2], len(out)), -n)
        around = np.full(2 * e, -n)
        parts += [around, out, around]
        at.append(at[-1] + len(out) + 4 * e)
    origin, at = np.concatenate(parts), np.array(at)
    row = np.repeat(np.arange(len(which)), np.diff(at))
    foreign = rng.integers(0, 1 << 63, len(origin), dtype=np.uint64)
    text = np.where(origin >= 0, items.words[items.first[which][row] + np.maximum(origin, 0)], foreign)
    seed = np.array([seed_length(n) for n in items.size[which].tolist()])[row]
    run = origin >= 0
    for j in range(1, SEED_WORDS):
        later = np.minimum(np.arange(len(origin)) + j, len(origin) - 1)
        run &= (seed <= j) | ((origin[later] == origin + j) & (row[later] == row))
    place = np.flatnonzero(run)
    start, first, number = np.unique(place - origin[place], return_index=True, return_counts=True)
    copy = row[place[first]]
    order = np.lexsort((-number, copy))
    begin = np.searchsorted(copy[order], copy[order], "left")
    kept = np.sort(order[np.arange(len(order)) - begin < TRIAL_WINDOWS])
    copy, start = copy[kept], start[kept]
    return text, copy, start, np.minimum(start + items.size[which][copy], at[1:][copy])


def _repeats_needed(items: Items, mine: np.ndarray, steps: np.ndarray, keys: np.ndarray, recall: float) -> int:
    """The repetitions after which edited copies of the items ``mine``, each taken once
    at least, have an equal key with the target recall, two standard errors included;
    0 where ``MAX_REPEATS`` are too few. Fills in the keys of these items."""
    nth = np.resize(np.arange(len(mine)), max(TRIALS, len(mine)))
    text, copy, start, stop = _edited_copies(items, mine[nth])
    missed = np.ones(len(nth), bool)
    for r in range(MAX_REPEATS):
        keys[r, mine] = embed(items.words, items.first[:-1][mine].copy(), items.first[1:][mine], r, steps[r][mine])
        item = mine[nth[copy]]
        equal = embed(text, start.copy(), stop, r, steps[r][item]) == keys[r, item]
        missed[copy[equal]] = False
        share = missed.mean()
        if share + 2 * math.sqrt(share * (1 - share) / len(nth)) <= 1 - recall:
            return r + 1
        # Misses fall ever more slowly, so a class behind an even pace never gets there.
        if r >= 7 and share > (1 - recall) ** ((r + 1) / MAX_REPEATS):
            return 0
        live = missed[copy]
        copy, start, stop = copy[live], start[live], stop[live]
    return 0


def distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a part of ``text``, with that part's
    place; more than ``most`` if there is none."""
    m = len(text)
    cost = np.zeros(m + 1, np.int64)
    origin = np.arange(m + 1)
    ramp = np.arange(m + 1)
    for i, w in enumerate(item):
        match = np.concatenate([[i + 1], np.minimum(cost[:-1] + (text != w), cost[1:] + 1)])
        diagonal = cost[:-1] + (text != w) <= cost[1:] + 1
        start = np.concatenate([[0], np.where(diagonal, origin[:-1], origin[1:])])
        # insertions: a running minimum along the row
        level = match - ramp
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, ramp, 0))
        cost, origin = low + ramp, start[source]
        if cost.min() > most:
            return most + 1, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def _windows(words: Words, hashed: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row, item and first word of the windows that a seed places, in parts of about
    ``PART_WINDOWS``: a run of words that very many items share is taken item by
    item, so a part is never larger than that and the items of a block."""
    n, row_of = len(hashed), words.row_of()
    for q, (seed, item, offset) in items.seeds.items():
        if n < q:
            continue
        gram = words.sequence_hash(hashed, np.arange(n - q + 1), q)
        gate = np.zeros(1 << 18, bool)
        gate[seed >> U(46)] = True
        near = np.flatnonzero(gate[gram >> U(46)])
        low, high = np.searchsorted(seed, gram[near], "left"), np.searchsorted(seed, gram[near], "right")
        keep = (high > low) & (row_of[near] == row_of[np.minimum(near + q - 1, n - 1)])
        near, low, number = near[keep], low[keep], (high - low)[keep]
        part = np.cumsum(number) // PART_WINDOWS
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(near)]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            each = number[x:y]
            place = np.repeat(near[x:y], each)
            k = np.repeat(low[x:y], each) + np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each)
            row, owner, start = row_of[place], item[k], place - offset[k]
            order = np.lexsort((start, owner, row))
            row, owner, start = row[order], owner[order], start[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1])
            yield row[new], owner[new], start[new]


def find(words: Words, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, words, edits): the best place of each item in each row."""
    hashed = words.hashes()
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not len(hashed) or not len(items.ids):
        return []
    for row, item, start in _windows(words, hashed, items):
        left, right = words.first[:-1][row], words.first[1:][row]
        begin, stop = np.maximum(start, left), np.minimum(start + items.size[item], right)
        chosen = [np.flatnonzero(items.repeats[item] == 0)]
        waiting = np.arange(len(row))
        for r in range(len(items.keys)):
            waiting = waiting[items.repeats[item[waiting]] > r]
            key = embed(hashed, begin[waiting].copy(), stop[waiting], r, items.steps[r][item[waiting]])
            hit = key == items.keys[r][item[waiting]]
            chosen.append(waiting[hit])
            waiting = waiting[~hit]
        for c in np.sort(np.concatenate(chosen)).tolist():
            i, r = int(item[c]), int(row[c])
            size = int(items.size[i])
            most = edits_allowed(size)
            known = best.get((r, i))
            if known and known[0] == 0:
                continue
            a, b = max(int(left[c]), int(start[c]) - most), min(int(right[c]), int(start[c]) + size + most)
            d, x, y = distance(items.words[items.first[i] : items.first[i + 1]], hashed[a:b], most)
            if d <= most and (known is None or (d, a + x) < known[:2]):
                best[r, i] = d, a + x, y - x
    return [(r, i, at - int(words.first[r]), size, d) for (r, i), (d, at, size) in sorted(best.items())]


# ------------------------------------------------------------------ Spark
def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items in blocks of about ``block_bytes``: that much is held by the
    driver and each task at a time, however large the benchmark is."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    number = max(1, math.ceil(total / block_bytes))
    for k in range(number):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == k)
        rows = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield prepare([r["item_id"] for r in rows], [r["text"] for r in rows])


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, first_word,
    n_words, edits, similarity."""
    out = None
    kept = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    for items in item_blocks(benchmark):
        found = kept.mapInArrow(_finder(items), f"doc_id {kind}, item_id long, first_word long, n_words long, edits long, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = find(split_words(batch.column(1), lower=True, breaks=WORD_BREAKS), items)
            row, item, at, size, edits = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), items.ids.take(pa.array(item)), pa.array(at), pa.array(size), pa.array(edits), pa.array(1 - edits / np.maximum(items.size[item], 1) if len(item) else np.zeros(0))],
                names=["doc_id", "item_id", "first_word", "n_words", "edits", "similarity"],
            )

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns."""
    names = docs.columns
    where = names.index("text")
    out = docs
    for items in item_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = find(split_words(batch.column(where).cast(pa.string()), lower=True, breaks=WORD_BREAKS), items)
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in found]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
