"""WARC archives: a writer, and a normaliser of monolithic gzip files.

Many archives come as one gzip stream over the whole file, which can't be
entered in the middle. ``normalise_archive`` inflates such a stream once, writes
every record as a gzip member of its own and a sidecar index with the offset and
length of each member; a record is then read by its place.

``write_archives`` makes the monolithic files: one per task, in the shared folder,
under a temporary name that is moved into place, so a task that is run again
replaces its own file. Equal payloads of at least ``MIN_REVISIT`` bytes are stored
once, under the largest page id; the others are revisits. Which payloads repeat
is found from digests alone, so no page is moved for it, and a payload that a
third of all pages share is counted before it is shuffled.

Files are opened through ``pyarrow.fs`` by the URI of the shared folder, which is
the one that Spark resolves: a folder without a scheme lies in the default file
system of the cluster.

Defined cases: a null html is an empty payload; a null page id is written as an
empty id and read back as null, and refers to no page; repeated rows are records
of their own (rows that repeat the page id of a response are responses too);
payloads pass writer, normaliser and reader in blocks, so none of them holds a
copy of a very long one (the row itself is held once); an empty table gives
no archive and an empty result; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.scratch import Scratch, qualified
from timberline.llm.textkit import slices

MIN_REVISIT = 1000
LEVEL = 1
BLOCK = 1 << 18
_GZIP = 16 + zlib.MAX_WBITS
_DATE = b"2024-01-01T00:00:00Z"
INDEX_FIELDS = "archive string, position long, offset long, length long, record_id string, record_type string"
RECORD_FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


# ---------------------------------------------------------------- records
def record_blocks(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> Iterator[bytes]:
    """One WARC record; ``refers_to`` makes it a revisit without a payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest())
    ident = "" if page_id is None else str(page_id)
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        b"WARC-Record-ID: <urn:page:" + ident.encode() + b">",
        b"WARC-Date: " + _DATE,
        b"WARC-Target-URI: " + (url or "").encode().translate(None, b"\r\n"),
        b"WARC-Payload-Digest: sha1:" + digest,
        b"X-Payload-Length: %d" % len(payload),
    ]
    if refers_to is not None:
        head.append(b"WARC-Refers-To: <urn:page:%d>" % refers_to)
        head.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        payload = b""
    head.append(b"Content-Length: %d" % len(payload))
    yield b"\r\n".join(head) + b"\r\n\r\n"
    view = memoryview(payload)
    for k in range(0, len(payload), BLOCK):
        yield view[k : k + BLOCK]
    yield b"\r\n\r\n"


def parse_head(head: bytes) -> dict[bytes, bytes]:
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v for k, v in (line.split(b": ", 1) for line in lines[1:] if b": " in line)}


def page_of(urn: bytes | None) -> int | None:
    digits = (urn or b"")[len(b"<urn:page:") : -1]
    return int(digits) if digits else None


def read_record(blocks: Iterator[bytes]) -> dict:
    """Fields of one inflated record; the digest is checked against the payload."""
    hashed = hashlib.sha1()
    fields: dict[bytes, bytes] = {}
    for kind, block in record_events(blocks):
        if kind == "head":
            fields = parse_head(block)
        elif kind == "payload":
            hashed.update(block)
    digest = base64.b32decode(fields[b"warc-payload-digest"].removeprefix(b"sha1:"))
    kind = fields[b"warc-type"].decode()
    if kind == "response" and hashed.digest() != digest:
        raise ValueError(f"payload digest differs in {fields[b'warc-record-id']!r}")
    return {
        "page_id": page_of(fields[b"warc-record-id"]),
        "payload_bytes": int(fields[b"x-payload-length"]),
        "payload_digest": digest.hex(),
        "record_type": kind,
        "refers_to": page_of(fields.get(b"warc-refers-to")),
    }


# ------------------------------------------------------------- gzip streams
def inflated(source, block: int = BLOCK, most: int | None = None) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, or of its next ``most``
    bytes, in blocks of at most ``block``."""
    engine = zlib.decompressobj(_GZIP)
    while chunk := source.read(block if most is None else min(block, most)):
        most = None if most is None else most - len(chunk)
        while chunk:
            yield engine.decompress(chunk, block)
            chunk = engine.unconsumed_tail
            if engine.eof:
                chunk = engine.unused_data
                engine = zlib.decompressobj(_GZIP)
    yield engine.flush()


def record_events(blocks: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """The records of an inflated stream as they pass: ("head", its lines),
    ("payload", a block of it) any number of times, and ("end", b"")."""
    have = bytearray()
    left = -1  # bytes of the payload that are to come; -1 outside a record
    for block in blocks:
        have += block
        while True:
            if left < 0:
                end = have.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = bytes(have[:end])
                del have[: end + 4]
                left = int(parse_head(head)[b"content-length"])
                yield "head", head
            if left and have:
                part = bytes(have[:left])
                del have[: len(part)]
                left -= len(part)
                yield "payload", part
            if left or len(have) < 4:
                break
            if have[:4] != b"\r\n\r\n":
                raise ValueError("a record is longer than its head says")
            del have[:4]
            left = -1
            yield "end", b""
    if have or left >= 0:
        raise ValueError("the archive ends within a record")


def normalise_archive(source, target) -> Iterator[dict]:
    """Rewrite the records of ``source`` as members of ``target``; yields the index."""
    offset = position = length = 0
    fields: dict[bytes, bytes] = {}
    engine = None
    for kind, block in record_events(inflated(source)):
        if kind == "head":
            fields, length = parse_head(block), 0
            engine = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP)
            block += b"\r\n\r\n"
        packed = engine.compress(block) if kind != "end" else engine.compress(b"\r\n\r\n") + engine.flush()
        target.write(packed)
        length += len(packed)
        if kind == "end":
            yield {"position": position, "offset": offset, "length": length, "record_id": fields[b"warc-record-id"].decode(), "record_type": fields[b"warc-type"].decode()}
            offset, position = offset + length, position + 1


def read_members(source, entries: list[tuple[int, int]]) -> Iterator[Iterator[bytes]]:
    """The blocks of each record at the given offsets and lengths; a record is to be
    read before the next."""
    for offset, length in entries:
        source.seek(offset)
        yield inflated(source, most=length)


# ------------------------------------------------------------------ Spark
def _open_fs(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    return system, path


def with_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html and refers_to. Only digests that repeat are kept on the
    small side; that table is written, so the join sees its true size and AQE may
    broadcast it or split a hot digest."""
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    digest = F.when(F.octet_length("html") >= MIN_REVISIT, F.unhex(F.sha1("html")))
    shared = rows.select(digest.alias("digest"), "page_id").where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("response")).where("n > 1 and response is not null").drop("n")
    shared = scratch.save(shared, "shared")
    joined = rows.withColumn("digest", digest).join(shared, "digest", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, html, refers_to rows as monolithic archives; returns a
    row per archive. Evaluating it does the writing."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, path = _open_fs(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        mine = f"{path}/.{name}.{uuid.uuid4().hex}"
        engine, n, out = zlib.compressobj(LEVEL, zlib.DEFLATED, _GZIP), 0, None
        for batch in slices(batches, "html"):
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(mine)
            for row in batch.to_pylist():
                for block in record_blocks(row["page_id"], row["url"], row["html"].encode(), row["refers_to"]):
                    out.write(engine.compress(block))
                n += 1
        if out is not None:
            out.write(engine.flush())
            out.close()
            system.move(mine, f"{path}/{name}")
            yield pa.RecordBatch.from_pylist([{"archive": name, "records": n}], schema=pa.schema([("archive", pa.string()), ("records", pa.int64())]))

    return pages.mapInArrow(write, "archive string, records long")


_INDEX = pa.schema([("archive", pa.string()), ("position", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])


def normalise(archives: DataFrame, folder: str, remove: bool = False) -> DataFrame:
    """Normalise every named archive of ``folder`` into ``folder/members``; the
    result is the index. A sidecar ``.cdx`` file lies beside each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open_fs(folder)
        system.create_dir(f"{path}/members", recursive=True)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                own = f"{path}/members/.{name}.{uuid.uuid4().hex}"
                from pyarrow import fs

                if system.get_file_info(f"{path}/{name}").type == fs.FileType.NotFound:
                    yield _read_sidecar(system, f"{path}/members/{name}", name)  # an earlier attempt ended just before this one
                    continue
                with system.open_input_stream(f"{path}/{name}", compression=None) as source, system.open_output_stream(own, compression=None) as target:
                    entries = [{"archive": name, **e} for e in normalise_archive(source, target)]
                index = pa.RecordBatch.from_pylist(entries, schema=_INDEX)
                lines = "".join(f"{e['offset']} {e['length']} {e['record_type']} {e['record_id']}\n" for e in entries)
                with system.open_output_stream(own + ".cdx") as side:
                    side.write(lines.encode())
                system.move(own + ".cdx", f"{path}/members/{name}.cdx")
                system.move(own, f"{path}/members/{name}")
                if remove:
                    system.delete_file(f"{path}/{name}")
                yield index

    return archives.select("archive").mapInArrow(run, INDEX_FIELDS)


def _read_sidecar(system, path: str, name: str) -> pa.RecordBatch:
    with system.open_input_stream(path + ".cdx") as side:
        lines = side.read().decode().splitlines()
    rows = [dict(zip(("offset", "length", "record_type", "record_id"), line.split(" ", 3))) for line in lines]
    return pa.RecordBatch.from_pylist([{"archive": name, "position": k, "offset": int(r["offset"]), "length": int(r["length"]), "record_id": r["record_id"], "record_type": r["record_type"]} for k, r in enumerate(rows)], schema=_INDEX)


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_by_index(index: DataFrame, folder: str) -> DataFrame:
    """Fields of every record that ``index`` names, each read at its own offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open_fs(folder)
        name = source = None
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                if entry["archive"] != name:
                    if source is not None:
                        source.close()
                    name = entry["archive"]
                    source = system.open_input_file(f"{path}/members/{name}")
                rows += map(read_record, read_members(source, [(entry["offset"], entry["length"])]))
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORDS)
        if source is not None:
            source.close()

    return index.select("archive", "offset", "length").mapInArrow(run, RECORD_FIELDS)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, normalise them, and read every record back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = qualified(spark, f"{scratch.path}/archives")
    archives = scratch.save(write_archives(with_revisits(pages, scratch), folder), "written")
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), archives.count()))
    index = scratch.save(normalise(archives.repartition(tasks, "archive"), folder, remove=True), "index")
    return read_by_index(index, folder)


ORACLE_SQL = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
told AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS kept FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM told
"""
