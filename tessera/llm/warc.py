"""WARC archives: writing, and normalising a monolithic gzip file to one member per record with an offset index.

An archive is a table of chunks (archive, seq, data): the bytes of one file in order, each of CHUNK bytes but the last, so that
any store that Spark reaches holds it and no task needs a whole file. export_archives writes plain files from it where a
folder is mounted. The normaliser gives the new file's chunks and, as its sidecar, where each record's member lies; a record is read back through
the sidecar alone: its archive, offset and length.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections import deque
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for, stored

CHUNK = 1 << 18
#: Payload bytes of an archive, about.
ARCHIVE_BYTES = 4 << 20
#: Of zlib: fast; an archive's size is of less weight than the time to write it twice.
LEVEL = 1
#: Bytes that a task gets, about, and parts that the pages of one payload are dealt to before they are joined.
TASK_BYTES, SALTS = 16 << 20, 32
GZIP = 16 + zlib.MAX_WBITS
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "archive int, seq long, data binary"
RECORDS = "page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: A header that says that the target is percent-encoded, because its characters don't fit a header line.
ENCODED = "X-Target-URI-Encoding"
INDEX = "archive int, ordinal long, offset long, length long, record_id string, record_type string, target string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str, payload: bytes, digest: str, n_bytes: int, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload; its digest and length are those of the full payload."""
    plain = all("!" <= c <= "~" for c in url)
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", url if plain else quote(url, safe=":/?#[]@!$&'()*+,;=", errors="surrogatepass")), *([] if plain else [(ENCODED, "percent")]),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(n_bytes)),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    body = payload if refers_to is None else b""
    head += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (names in lower case) and the body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


class RecordStream:
    """Cuts a stream of inflated bytes into records; holds one record at most."""

    def __init__(self) -> None:
        self.held, self.need = bytearray(), -1

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while True:
            if self.need < 0:
                if (stop := self.held.find(b"\r\n\r\n")) < 0:
                    return
                fields, _ = parse_record(bytes(self.held[: stop + 4]))
                self.need = stop + 4 + int(fields["content-length"]) + 4
            if len(self.held) < self.need:
                return
            yield bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = -1


def _chunks(archive: int, pieces: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    held, seq = bytearray(), 0
    for piece in pieces:
        held += piece
        while len(held) >= CHUNK:
            yield archive, seq, bytes(held[:CHUNK])
            del held[:CHUNK]
            seq += 1
    if held or not seq:
        yield archive, seq, bytes(held)


def _frames(rows: Iterator[tuple], columns: str) -> Iterator[pd.DataFrame]:
    """Frames of some rows each, so that a batch stays of bounded size."""
    names, held, size = [c.split()[0] for c in columns.split(", ")], [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size > 4 * CHUNK:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    yield pd.DataFrame(held, columns=names)


def _by_archive(rows: Iterator[tuple]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Runs of rows of one archive; rows come sorted by archive."""
    row = next(rows, None)
    while row is not None:
        archive = row[0]

        def run() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == archive:  # noqa: B023
                yield row
                row = next(rows, None)

        own = run()
        yield archive, own
        for _ in own:  # what the user left
            pass


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for pdf in batches:
        yield from pdf.itertuples(index=False, name=None)


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of each archive. What a page's payload revisits comes before the page, as a row of its own."""

    def deflated(rows: Iterator[tuple]) -> Iterator[bytes]:
        packer = zlib.compressobj(LEVEL, wbits=GZIP)
        told, refers_to = None, None
        for _, name, digest, n_bytes, is_page, url, payload, first in rows:
            if not is_page:
                told, refers_to = (name, digest, n_bytes), first
                continue
            known = refers_to if told == (name, digest, n_bytes) else None
            yield packer.compress(record(name, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), n_bytes, known))
        yield packer.flush()

    return _frames((x for archive, rows in _by_archive(_rows(batches)) for x in _chunks(archive, deflated(rows))), CHUNKS)


def inflated(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, streamed; a cut or damaged file raises."""
    unpacker = zlib.decompressobj(wbits=GZIP)
    begun = False
    for piece in pieces:
        while piece:
            if unpacker.eof:
                unpacker, begun = zlib.decompressobj(wbits=GZIP), False
            begun = True
            while True:
                out = unpacker.decompress(piece, CHUNK)
                if out:
                    yield out
                piece = unpacker.unconsumed_tail
                if not piece:
                    break
            piece = unpacker.unused_data
    if begun and not unpacker.eof:
        raise EOFError("the gzip stream is cut")


def members(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(record, its own gzip member) of each record of a monolithic gzip file, inflated once."""
    stream = RecordStream()
    for data in inflated(pieces):
        for one in stream.feed(data):
            packer = zlib.compressobj(LEVEL, wbits=GZIP)
            yield one, packer.compress(one) + packer.flush()
    if stream.held:
        raise EOFError("the last record is cut")


def _normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The new file's chunks, and among them the sidecar's rows: one pass makes both."""

    def rows() -> Iterator[tuple]:
        for archive, chunks in _by_archive(_rows(batches)):
            offset, held, seq = 0, bytearray(), 0
            for ordinal, (one, member) in enumerate(members(x[2] for x in chunks)):
                fields, _ = parse_record(one[: one.find(b"\r\n\r\n") + 4])
                yield archive, None, None, ordinal, offset, len(member), fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri", "")
                offset += len(member)
                held += member
                while len(held) >= CHUNK:
                    yield archive, seq, bytes(held[:CHUNK]), *[None] * 6
                    del held[:CHUNK]
                    seq += 1
            if held or not seq:
                yield archive, seq, bytes(held), *[None] * 6

    return (pdf.astype({c: "Int64" for c in ("seq", "ordinal", "offset", "length")}) for pdf in _frames(rows(), NORMAL))


NORMAL = CHUNKS + INDEX.removeprefix("archive int")


def _cut(rows: Iterator[tuple]) -> Iterator[bytes]:
    """The members of an archive: rows are its chunks (at, None, data) and the sidecar's entries (offset, length, None), in order."""
    base, held, waiting = 0, b"", deque()
    for at, length, data in rows:
        if data is None:
            waiting.append((int(at), int(length)))
        else:
            keep = waiting[0][0] if waiting else int(at)  # what lies before is of no more use
            held, base = held[keep - base :] + data, keep
        while waiting and waiting[0][0] + waiting[0][1] <= base + len(held):
            offset, size = waiting.popleft()
            yield held[offset - base : offset - base + size]
    if waiting:
        raise EOFError("the sidecar names bytes that its file doesn't have")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for member in (m for _, own in _by_archive(_rows(batches)) for m in _cut(x[1:] for x in own)):
            fields, body = parse_record(b"".join(inflated(iter((member,)))))
            kind, said, name = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-record-id"]
            if kind == "response" and (len(body) != int(fields["x-payload-length"]) or payload_digest(body) != said):
                raise ValueError(f"payload of {name} differs from its digest")
            url, refers = fields.get("warc-target-uri", ""), fields.get("warc-refers-to")
            if fields.get(ENCODED.lower()) == "percent":
                url = unquote(url, errors="surrogatepass")
            yield name[len("<urn:page:") : -1], url, kind, said, int(fields["x-payload-length"]), refers and refers[len("<urn:page:") : -1], body

    return _frames(rows(), RECORDS)


def write_archives(pages: DataFrame, payload: Column | None = None, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Chunks of monolithic gzip WARC files, a record per page.

    Among records with equal payloads of at least min_revisit_bytes, that with the largest page_id is the response and the
    others revisit it; smaller payloads are all responses. A null html is an empty payload, a null url an empty one. Rows
    that repeat a page_id with an equal payload each get a record, all of one type. A null page_id is smaller than any and is read back as null; rows of equal
    payloads that all have none are responses. An empty table gives no archive. Other columns are ignored, whatever their names. What refers to what is
    worked out on ids and digests alone; the payloads are shuffled once, to their archives.
    """
    body = payload if payload is not None else F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long"), "name": F.coalesce(F.col("page_id").cast("string"), F.lit("null"))})
    total = rows.agg(F.coalesce(F.sum(F.col("n_bytes") + 400), F.lit(0))).first()[0]
    n = blocks_for(total, TASK_BYTES)
    rows = rows.withColumn("archive", F.pmod(F.xxhash64("name"), F.lit(blocks_for(total, archive_bytes))).cast("int"))
    ids = rows.filter(F.col("n_bytes") >= min_revisit_bytes).select("page_id", "digest", "n_bytes", "name", "archive", F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int").alias("part"))
    sizes = ids.groupBy("digest", "n_bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    shared = sizes.filter(F.col("copies") > 1).drop("copies").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = ids.join(shared, ["digest", "n_bytes", "part"]).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = revisits.select("archive", "name", "digest", "n_bytes", F.col("first").cast("string").alias("refers_to")).distinct()
    pages_of = rows.select("archive", "name", "digest", "n_bytes", F.lit(True).alias("is_page"), "url", "payload", F.lit(None).cast("string").alias("refers_to"))
    told = revisits.select("archive", "name", "digest", "n_bytes", F.lit(False), F.lit(""), F.lit(None).cast("binary"), "refers_to")
    dealt = pages_of.union(told).repartition(n, "archive").sortWithinPartitions("archive", "name", "digest", "n_bytes", "is_page", "url")
    return dealt.mapInPandas(_write, CHUNKS)


def _in_order(chunks: DataFrame) -> DataFrame:
    return chunks.select("archive", "seq", "data").repartition("archive").sortWithinPartitions("archive", "seq")


def normalise_archives(chunks: DataFrame, in_order: bool = False) -> tuple[DataFrame, DataFrame]:
    """The normalised files as chunks, and their sidecar: archive, ordinal, offset, length, record_id, record_type, target of each record.

    Every archive is inflated once, as a stream of its chunks in order, and each record is deflated as a member of its own; both results are written to the
    shared folder by that pass. in_order: chunks come from write_archives, which leaves an archive's chunks in one partition, in order, and
    need no shuffle. A cut or damaged archive raises.
    """
    dealt = chunks if in_order else _in_order(chunks)
    both = stored(dealt.mapInPandas(_normalise, NORMAL), "normalised", compression="uncompressed")
    index = both.filter(F.col("seq").isNull()).select([c.split()[0] for c in INDEX.split(", ")])
    return both.filter(F.col("seq").isNotNull()).select("archive", "seq", "data"), index


def read_records(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload of each record that the sidecar names.

    A member is cut out of its archive by offset and length. Bytes that aren't one member, or a payload that differs from its digest, raise.
    """
    n = blocks_for(index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0], TASK_BYTES)
    bytes_of = chunks.select("archive", (F.col("seq") * CHUNK).alias("at"), F.lit(None).cast("long").alias("length"), "data")
    told = index.select("archive", "offset", "length", F.lit(None).cast("binary"))
    dealt = bytes_of.union(told).repartition(n, "archive").sortWithinPartitions("archive", "at", F.col("length").asc_nulls_first())
    read = dealt.mapInPandas(_read, RECORDS)
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return read.withColumns({c: number(c) for c in ("page_id", "refers_to")})


def export_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes each archive as folder/archive-N.warc.gz, in a folder mounted on every executor; returns archive, path, n_bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for archive, own in _by_archive(_rows(batches)):
                path = f"{folder}/archive-{archive:06d}.warc.gz"
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    n = sum(f.write(x[2]) for x in own)
                os.replace(f.name, path)  # a task that is run again leaves the same file
                yield archive, path, n

        return _frames(rows(), "archive int, path string, n_bytes long")

    return _in_order(chunks).mapInPandas(run, "archive int, path string, n_bytes long")


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes pages as monolithic gzip archives, normalises them, and reads every record back from the normalised files through the sidecar."""
    return read_records(*normalise_archives(write_archives(pages, min_revisit_bytes=min_revisit_bytes), in_order=True))
