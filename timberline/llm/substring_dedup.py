"""Repeated passages by relative Lempel-Ziv factors over indexed reference blocks.

A passage is repeated when a window of ``WINDOW`` consecutive words starts at two
places or more. The reference is the whole corpus, cut into blocks by content:
every window names an anchor, the k-gram with the smallest hash within it, and
windows in a row that name the same anchor are a block. Equal windows name equal
anchors at the same distance, so a repeated window lies in blocks whose anchor
occurs again, and only such blocks are indexed.

A document is parsed into factors: runs of its words that stand in a reference block,
copied from another place of the corpus. The index tells for each block another
place that holds the same content, that of the least row if it isn't its own; within the
midst of copied text all blocks are of this kind. At a factor's ends a block shares its anchor, but not
all its content, with other blocks; there every window of one representative of each
content is looked up on its own, so a factor ends at the exact word. The parse
goes from left to right and is greedy: a factor goes on for as long as the next
block's place continues its source, and else another begins. As the index
holds windows, no factor is shorter than one; all become duplicate spans, and the
words in them go.

Blocks are equal by two 64-bit hashes (of the anchor, and of all words with their
number and the anchor's place), windows by those of the anchor and of their words.
About one row per fourteen words is shuffled for the index, and texts are moved
only to meet the rows found for them. The count of a block that very many
documents share is summed before it is shuffled.

Defined cases: words are the runs between ASCII white space; a null or empty text
has none; texts shorter than a window keep all words; windows of a text that
repeats within itself, overlapping ones too, count as repeated; repeated rows are
two places each, and their factors are copied from one another; a null id is kept
and joins by its text; an empty table gives an empty result; further columns stay
as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.scratch import Scratch
from timberline.llm.textkit import U, Words, mix, signed, slices, split_words

WINDOW = 35
GRAM = 8
_REACH = WINDOW - GRAM + 1  # k-grams in a window
_PLACE_BITS = 26


def _anchors(gram: np.ndarray, piece: int = 1 << _PLACE_BITS) -> np.ndarray:
    """For each window of k-grams the place of the smallest, the leftmost of equals.
    The place in the low bits makes it so; longer slices go piece by piece."""
    low = U((1 << _PLACE_BITS) - 1)
    out = np.empty(max(0, len(gram) - _REACH + 1), np.int64)
    for at in range(0, len(out), piece - _REACH):
        part = gram[at : at + piece]
        key = (part & ~low) | np.arange(len(part), dtype=U)
        span = 1
        while 2 * span <= _REACH:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < _REACH:
            key = np.minimum(key[: len(key) - (_REACH - span)], key[_REACH - span :])
        out[at : at + len(key)] = (key & low).astype(np.int64) + at
    return out


def blocks(words: Words) -> dict[str, np.ndarray]:
    """The blocks of all rows of a slice: row, start (first window, by word of the
    row), windows (how many), anchor and content (hashes)."""
    hashed = words.hashes()
    n = len(hashed)
    counts = words.counts
    per_row = np.maximum(counts - WINDOW + 1, 0)
    if not per_row.sum():
        none = np.zeros(0, np.int64)
        return {"row": none, "start": none, "windows": none, "anchor": none, "content": none}
    gram = words.sequence_hash(hashed, np.arange(n - GRAM + 1), GRAM)
    row = np.repeat(np.arange(len(counts)), per_row)
    begin = np.concatenate([[0], np.cumsum(per_row)])[:-1]
    window = words.first[:-1][row] + np.arange(len(row)) - begin[row]
    anchor = _anchors(gram)[window]
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(window)]]))
    start, place, owner = window[first], anchor[first], row[first]
    content = mix(words.sequence_hash(hashed, start, size + WINDOW - 1) ^ mix((place - start).astype(U) * U(64) + size.astype(U)))
    return {"row": owner, "start": start - words.first[:-1][owner], "windows": size, "anchor": signed(gram[place]), "content": signed(content)}


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _rid, the same for repeated rows, and _text without nulls."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.xxhash64(docs["doc_id"], text).alias("_rid"), text.alias("_text"))


def block_table(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            b = blocks(split_words(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(b["row"])), pa.array(b["anchor"]), pa.array(b["content"]), pa.array(b["start"].astype(np.int32)), pa.array(b["windows"].astype(np.int32))],
                names=["rid", "anchor", "content", "start", "windows"],
            )

    return _keyed(docs).mapInArrow(run, "rid long, anchor long, content long, start int, windows int")


def _boundary_windows(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """anchor, content, once, rid, at, h: every window of the representative blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = split_words(batch.column(0))
            hashed = words.hashes()
            lists = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            x = lists.flatten()
            get = lambda name: np.asarray(x.field(name))  # noqa: B023, E731
            size = get("windows").astype(np.int64)
            block = np.repeat(np.arange(len(size)), size)
            nth = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size)
            place = get("start").astype(np.int64)[block] + nth
            h = signed(words.sequence_hash(hashed, words.first[:-1][owner][block] + place, WINDOW))
            rid, once = np.asarray(batch.column(1))[owner][block], x.field("once").take(pa.array(block))
            yield pa.RecordBatch.from_arrays([pa.array(get("anchor")[block]), pa.array(get("content")[block]), once, pa.array(rid), pa.array(place.astype(np.int32)), pa.array(h)], names=["anchor", "content", "once", "rid", "at", "h"])

    one_each = heads.groupBy("rid").agg(F.collect_list(F.struct("anchor", "content", "once", "start", "windows")).alias("blocks"))
    texts = _keyed(docs)
    met = texts.join(one_each, F.col("_rid") == F.col("rid"))
    return met.select("_text", "_rid", "blocks").mapInArrow(run, "anchor long, content long, once boolean, rid long, at int, h long")


def _held() -> list:
    """The places of a group: those in the least and in the largest row, and the least
    and largest start, which tell two places where all are of one row."""
    return [F.min("rid").alias("rid_a"), F.min_by("start", "rid").alias("at_a"), F.max("rid").alias("rid_b"), F.max_by("start", "rid").alias("at_b"), F.min("start").alias("low"), F.max("start").alias("high")]


def _source() -> list:
    """Another place than rid, start of the group that holds it."""
    far, near = F.col("rid_a") != F.col("rid"), F.col("rid_b") != F.col("rid")
    other = F.when(F.col("low") != F.col("start"), F.col("low")).otherwise(F.col("high"))
    return [F.when(far, F.col("rid_a")).otherwise(F.col("rid_b")).alias("source"), F.when(far, F.col("at_a")).when(near, F.col("at_b")).otherwise(other).alias("there")]


def indexed_places(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """rid and its list of start, windows, source, there: runs of windows that are
    repeated, each with a place that holds the same words. Bounded by the length of
    the document."""
    occurrences = scratch.save(block_table(docs), "blocks")
    seen = occurrences.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("x"), F.max("content").alias("y"), *_held()).where("n > 1")
    # Written first, so that AQE may split the partition of an anchor that is everywhere.
    shared = scratch.save(seen.withColumnRenamed("anchor", "k").withColumn("mixed", F.col("x") != F.col("y")).drop("n", "x", "y"), "shared")
    met = occurrences.join(shared, F.col("anchor") == F.col("k"))
    found = scratch.save(met.select("rid", "start", "windows", "mixed", *(F.when(~F.col("mixed"), c).alias(n) for c, n in zip(_source(), ("source", "there"))), *(F.when(F.col("mixed"), F.col(n)).alias(n) for n in ("anchor", "content"))), "found")
    scratch.drop("blocks")
    scratch.drop("shared")
    mixed = found.where("mixed").drop("source", "there")
    kinds = mixed.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min("windows").alias("windows"), *_held())
    kinds = scratch.save(kinds, "kinds")
    windows = scratch.save(_boundary_windows(docs, kinds.select("anchor", "content", (F.col("n") == 1).alias("once"), F.col("rid_a").alias("rid"), F.col("at_a").alias("start"), "windows")), "windows")
    again = windows.groupBy("anchor", "h").agg(F.min("content").alias("x"), F.max("content").alias("y"), *(f(n, "content").alias(f"{n}_{k}") for k, f in (("x", F.min_by), ("y", F.max_by)) for n in ("rid", "at")))
    again = again.where("x <> y").withColumnRenamed("anchor", "ka").withColumnRenamed("h", "kh")
    # A content that occurs once has what its windows share with other contents.
    single = windows.where("once").join(again, (F.col("anchor") == F.col("ka")) & (F.col("h") == F.col("kh")))
    own = F.col("x") == F.col("content")
    parts = scratch.save(single.select("rid", F.col("at").alias("start"), F.lit(1).alias("windows"), F.when(own, F.col("rid_y")).otherwise(F.col("rid_x")).alias("source"), F.when(own, F.col("at_y")).otherwise(F.col("at_x")).alias("there")), "parts")
    scratch.drop("windows")
    twice = scratch.save(kinds.where("n > 1").drop("n", "windows").withColumnRenamed("anchor", "ka").withColumnRenamed("content", "kc"), "twice")
    copied = mixed.join(twice, (F.col("anchor") == F.col("ka")) & (F.col("content") == F.col("kc"))).select("rid", "start", "windows", *_source())
    copied = scratch.save(copied, "copied")
    plain = found.where("not mixed").select("rid", "start", "windows", "source", "there")
    row = F.struct(*(F.col(n).cast(t).alias(n) for n, t in (("start", "int"), ("windows", "int"), ("source", "long"), ("there", "int"))))
    return plain.unionByName(copied).unionByName(parts).groupBy("rid").agg(F.collect_set(row).alias("places"))


def factors(start: np.ndarray, windows: np.ndarray, source: np.ndarray, there: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first word, words, source, first word there) of the greedy parse of one
    document: a factor goes on while the next block continues its source."""
    order = np.lexsort((there, source, start))
    s, n, src, shift = start[order], windows[order], source[order], (there - start)[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1] + n[:-1]) | (src[1:] != src[:-1]) | (shift[1:] != shift[:-1])
    first = np.flatnonzero(new)
    size = np.add.reduceat(n, first) if len(first) else n
    return list(zip(s[first].tolist(), (size + WINDOW - 1).tolist(), src[first].tolist(), (s + shift)[first].tolist()))


def covered(n_words: int, found: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Which words lie in a factor."""
    change = np.zeros(n_words + 1, np.int64)
    at = np.array([(f[0], f[0] + f[1]) for f in found], np.int64).reshape(-1, 2)
    np.add.at(change, at[:, 0], 1)
    np.add.at(change, at[:, 1], -1)
    return np.cumsum(change)[:n_words] > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (``_``-prefixed names are reserved), then _n_words,
    _n_removed and _kept: the kept words joined by one space."""
    scratch = Scratch(docs.sparkSession, "substring")
    found = indexed_places(docs, scratch)
    names = docs.columns
    schema = docs.schema.__class__([*docs.schema.fields]).add("_n_words", "long").add("_n_removed", "long").add("_kept", "string")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select("*", F.xxhash64(docs["doc_id"], text).alias("_rid"), text.alias("_text"))
    met = rows.join(found, F.col("_rid") == F.col("rid"), "left").select(*names, "_text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            words = split_words(batch.column(len(names)))
            lists = batch.column(len(names) + 1)
            raw, counts = words.data.tobytes(), words.counts
            removed, kept = np.zeros(batch.num_rows, np.int64), []
            for r in range(batch.num_rows):
                text = raw[words.bytes_at[r] : words.bytes_at[r + 1]]
                parts = text.split()
                if lists[r].is_valid:
                    x = lists[r].values
                    go = covered(int(counts[r]), factors(*(np.asarray(x.field(c)).astype(np.int64) for c in ("start", "windows", "source", "there"))))
                    removed[r] = go.sum()
                    parts = [parts[i] for i in np.flatnonzero(~go).tolist()]
                kept.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64()), pa.array(removed), pa.array(kept, pa.string())], names=[*names, "_n_words", "_n_removed", "_kept"])

    return met.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""
    done = remove_repeats(docs.select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from the texts; untouched texts stay as
    they are, and n_chars, where there is such a column, follows the text."""
    names = docs.columns
    inner = docs.toDF(*(n if n in ("doc_id", "text") else f"c{k}" for k, n in enumerate(names)))
    done = remove_repeats(inner)
    changed = F.col("_n_removed") > 0
    out = []
    for k, n in enumerate(names):
        if n == "text":
            col = F.when(changed, F.col("_kept")).otherwise(F.col("text"))
        elif n == "n_chars":
            col = F.when(changed, F.length("_kept").cast(docs.schema[n].dataType)).otherwise(F.col(f"c{k}"))
        else:
            col = F.col("doc_id" if n == "doc_id" else f"c{k}")
        out.append(col.alias(n))
    return done.select(*out)


def brute_force(texts: list[str | None]) -> list[tuple[int, int, str]]:
    """The same by counting every window; for tests."""
    split = [(t or "").encode().split() for t in texts]
    count: dict[tuple, int] = {}
    for w in split:
        for i in range(len(w) - WINDOW + 1):
            key = tuple(w[i : i + WINDOW])
            count[key] = count.get(key, 0) + 1
    out = []
    for w in split:
        go = np.zeros(len(w), bool)
        for i in range(len(w) - WINDOW + 1):
            if count[tuple(w[i : i + WINDOW])] > 1:
                go[i : i + WINDOW] = True
        out.append((len(w), int(go.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, go) if not g)).hexdigest()))
    return out


#: Of the digests of all documents.
ORACLE_SQL = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
numbered AS (SELECT row_number() OVER () AS row_id, * FROM worded),
starts AS (SELECT row_id, unnest(range(1, len(words) - 33)) AS k0 FROM numbered WHERE len(words) >= 35),
windows AS (SELECT row_id, k0, array_to_string(words[k0:k0 + 34], ' ') AS said FROM starts JOIN numbered USING (row_id)),
repeated AS (SELECT row_id, k0 FROM (SELECT row_id, k0, count(*) OVER (PARTITION BY md5(said)) AS n FROM windows) WHERE n > 1),
gone AS (SELECT row_id, list(DISTINCT k) AS gone FROM (SELECT row_id, unnest(range(k0, k0 + 35)) AS k FROM repeated) GROUP BY row_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(words, lambda w, k: NOT list_contains(coalesce(gone, []), k)), ' ')) AS kept_sha256
FROM numbered LEFT JOIN gone USING (row_id)
"""
