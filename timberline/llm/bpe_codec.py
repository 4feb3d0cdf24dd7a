"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over sixteen bytes cuts every text into chunks whose ends depend
on the content alone, so documents that share a passage share its chunks. A chunk is
encoded when it is first met, and from then on taken from the store whole. At a
join of two chunks the last word of the left one and the first word of the right
one may be parts of one word; the join is encoded anew over a stretch that grows on
both sides until it begins and ends at ASCII white space. There both encodings
agree exactly: the tokenizer's normaliser never composes across white space, its
splitter drops white space, and no added token holds any. The proof is checked
against the tokenizer itself in the tests, and ``agrees`` guards the vocabulary
at run time.

Words of new chunks and of joins are told apart by 64-bit hashes within a slice,
and each distinct one is looked up by its bytes; those that aren't stored are
encoded by the tokenizer in one batch. Ids and decoded texts are then gathered for
all units of a slice at once. Both stores belong to a worker process and are bounded;
a full one lets go of what was not used while it filled, which costs time and never
changes a result. A narrow map: no shuffle.

Defined cases: a null or empty text has no ids and decodes to ``''``; repeated
rows are encoded row by row; very long texts are slices of their own; an empty
table gives an empty table; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from timberline.llm.textkit import _BASE, _TABLE, LOWER, U, Words, _inverse, _powers, column_bytes, slices, split_bytes

VOCABULARY = "word_bpe_49k.json"
CHUNK_BITS = 8  # a chunk has 2 ** CHUNK_BITS bytes on average
WINDOW = 16
MAX_WORDS, MAX_CHUNKS = 80_000, 8_000
BATCH_WORDS = 4096


def chunk_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ends of the chunks in ``data``, whose rows end at ``at[1:]``."""
    n, ends = len(data), at[1:]
    if n > WINDOW:
        total = np.zeros(n + 1, U)
        np.cumsum(_TABLE[data] * _powers(_BASE, n)[:n], out=total[1:])
        rolling = (total[WINDOW:] - total[:-WINDOW]) * _powers(_inverse(_BASE), n)[: n - WINDOW + 1]
        cut = np.flatnonzero(rolling >> U(64 - CHUNK_BITS) == 0) + WINDOW
        ends = np.concatenate([ends, cut])
    return np.unique(ends)


_ENDING = np.zeros(256, bool)
_ENDING[[*b".,;:!?)|"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True


def with_marks(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start and end of the words, and which run between blanks each is of; a mark
    after an ASCII letter or digit is a word too, as the splitter ends a run there."""
    start, end = words.start, words.end
    of = np.arange(len(start))
    if not len(start):
        return start, end, of
    marked = _ENDING[words.data[end - 1]] & _LETTER[words.data[np.maximum(end - 2, 0)]] & (end - start > 1)
    mark = end[marked] - 1
    order = np.argsort(np.concatenate([start, mark]), kind="stable")
    return np.concatenate([start, mark])[order], np.concatenate([end - marked, end[marked]])[order], np.concatenate([of, of[marked]])[order]


def gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The pieces of ``pool`` that begin at ``at``, one after another."""
    done = np.cumsum(size)
    return pool[np.repeat(at - (done - size), size) + np.arange(done[-1] if len(done) else 0)]


class Store:
    """Bytes to ids and decoded text, in two generations of at most ``most`` entries
    and one slice's. Entries are numbers into columns of the newer one; what is asked
    for again moves there from the older, which goes when the newer is full."""

    def __init__(self, most: int):
        self.most = most
        self._begin()
        self.older = self.number, self.ids, self.text, self.entry

    def _begin(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.entry = np.zeros((4, 0), np.int64)  # begin and size of ids, begin and size of text

    def __len__(self) -> int:
        return self.entry.shape[1]

    def missing(self, keys: list[bytes]) -> list[bytes]:
        """The keys that neither generation has, once each."""
        number, (old, ids, text, entry) = self.number, self.older
        asked = dict.fromkeys(k for k in keys if k not in number)
        back = [k for k in asked if k in old]
        if back:
            a, n, b, m = entry[:, [old[k] for k in back]]
            self.add(back, gather(ids, a, n), n, gather(text, b, m), m)
        return [k for k in asked if k not in old]

    def add(self, keys: list[bytes], ids: np.ndarray, id_sizes: np.ndarray, text: np.ndarray, text_sizes: np.ndarray) -> None:
        self.number.update(zip(keys, range(len(self), len(self) + len(keys))))
        new = np.stack([len(self.ids) + np.cumsum(id_sizes) - id_sizes, id_sizes, len(self.text) + np.cumsum(text_sizes) - text_sizes, text_sizes])
        self.entry = np.concatenate([self.entry, new], axis=1)
        self.ids, self.text = np.concatenate([self.ids, ids]), np.concatenate([self.text, text])

    def turn(self) -> None:
        """A full generation becomes the older one."""
        if len(self) > self.most:
            self.older = self.number, self.ids, self.text, self.entry
            self._begin()

    def rest(self) -> None:
        """Between tasks only the newer generation is kept, as a worker has other work."""
        self.older = {}, self.ids[:0], self.text[:0], self.entry[:, :0]


class Codec:
    """A tokenizer with bounded stores of encoded words and chunks."""

    encoded_chunks = 0  # how many were encoded; the others came from the store

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        self.words, self.chunks = Store(MAX_WORDS), Store(MAX_CHUNKS)
        self.agrees()

    def agrees(self) -> None:
        """The premises of the joins hold for this vocabulary."""
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probe = "A á\ńb  c<|x|>d,  eΣ f9. it's! x)"
        parts = [i for p in probe.split() for i in ids(p)]
        loose = [i for p in probe.encode().lower().decode().replace(",", " ,").replace(".", " .").replace("!", " !").replace(")", " )").split() for i in ids(p)]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        strips = any(t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values())
        if ids(probe) != parts or parts != loose or strips or not all(t.startswith("<|") and not set(t) & set(" \t\n\r\x0b\x0c") for t in added):
            raise ValueError("this vocabulary doesn't split at white space and after words, or isn't lower case")
        if self.tokenizer.decoder is not None:
            raise ValueError("this vocabulary decodes by more than joining its pieces")

    def _words(self, raw: bytes, words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of the words in their store; those that aren't there are encoded in
        one batch."""
        _, first, at = np.unique(words.hashes(start, end), return_index=True, return_inverse=True)
        said = [raw[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())]
        store = self.words
        missing = store.missing(said)
        for k in range(0, len(missing), BATCH_WORDS):
            some = missing[k : k + BATCH_WORDS]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            texts = ["".join([self.pieces[i] + " " for i in e]).encode() for e in encoded]
            store.add(some, np.array([i for e in encoded for i in e], np.uint32), np.array([len(e) for e in encoded], np.int64), np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64))
        return np.array([store.number[w] for w in said], np.int64)[at]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Of each row of a slice the ids (little-endian, 32 bits) and the text that
        they decode to."""
        if b"<|" not in data.tobytes():  # added tokens are matched before letters are lowered
            data = LOWER[data]
        raw, rows, words = data.tobytes(), len(at) - 1, split_bytes(data, at)
        start, end, of = with_marks(words)
        if not len(start):
            return [b""] * rows, [b""] * rows
        row, ends = words.row_of()[of], chunk_ends(data, at)
        begins = np.concatenate([[0], ends[:-1]])
        # A chunk owns the words that have a blank on either side within it. What is at
        # its ends is of a join, so the chunk's bytes alone tell what it holds.
        chunk = np.searchsorted(ends, words.start, "right")
        core = ((words.start > begins[chunk]) & (words.end < ends[chunk]))[of]
        chunk = chunk[of]
        # Chunks with words of their own: known ones are taken, the first of each new
        # one is encoded and stored.
        held, first, count = np.unique(chunk[core], return_index=True, return_counts=True)
        places = np.flatnonzero(core)
        keys = [raw[i:j] for i, j in zip(begins[held].tolist(), ends[held].tolist())]
        new = dict.fromkeys(self.chunks.missing(keys))
        for k in range(len(keys) - 1, -1, -1):
            if keys[k] in new:
                new[keys[k]] = k
        fresh = np.array(list(new.values()), np.int64)
        self.encoded_chunks += len(fresh)
        mine = gather(places, first[fresh], count[fresh])  # the words of new chunks
        needed = ~core
        needed[mine] = True
        number = np.full(len(start), -1, np.int64)
        number[needed] = self._words(raw, words, start[needed], end[needed])
        if len(fresh):
            a, n, b, m = self.words.entry[:, number[mine]]
            cut = np.cumsum(count[fresh]) - count[fresh]
            self.chunks.add(list(new), gather(self.words.ids, a, n), np.add.reduceat(n, cut), gather(self.words.text, b, m), np.add.reduceat(m, cut))
        taken = np.array([self.chunks.number[key] for key in keys], np.int64)
        # Units: a word of a join, or at the first word of a chunk the whole of it.
        shift = len(self.words)
        entry = np.concatenate([self.words.entry, self.chunks.entry + np.array([[len(self.words.ids)], [0], [len(self.words.text)], [0]])], axis=1)
        unit = np.where(core, -1, number)
        unit[places[first]] = taken + shift
        used = np.flatnonzero(unit >= 0)
        a, n, b, m = entry[:, unit[used]]
        ids = gather(np.concatenate([self.words.ids, self.chunks.ids]), a, n)
        text = gather(np.concatenate([self.words.text, self.chunks.text]), b, m)
        self.words.turn()
        self.chunks.turn()
        id_at = np.concatenate([[0], np.cumsum(np.bincount(row[used], n, rows).astype(np.int64))]) * 4
        text_at = np.concatenate([[0], np.cumsum(np.bincount(row[used], m, rows).astype(np.int64))])
        ids, text = ids.tobytes(), text.tobytes()
        return [ids[i:j] for i, j in zip(id_at[:-1].tolist(), id_at[1:].tolist())], [text[i : max(i, j - 1)] for i, j in zip(text_at[:-1].tolist(), text_at[1:].tolist())]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Per row: the key, n_tokens, ids_sha256, decoded_sha256 and, if ``with_ids``,
    the ids and the decoded text themselves. Executors resolve ``vocabulary`` to
    their own copy of the file; a path is taken as it is."""
    kept = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(vocabulary if "/" in vocabulary else vocabulary_path(vocabulary))
        for batch in slices(batches):
            rows, decoded = made.encode(*column_bytes(batch.column(1)))
            columns = [
                batch.column(0),
                pa.array([len(i) // 4 for i in rows], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in rows], pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for t in decoded], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array([np.frombuffer(i, "<i4") for i in rows], pa.list_(pa.int32())), pa.array([t.decode() for t in decoded], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        made.words.rest()
        made.chunks.rest()

    more = ", ids array<int>, decoded string" if with_ids else ""
    return kept.mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
