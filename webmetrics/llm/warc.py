"""Web pages as WARC archives with a two-level capture index, and the way back.

Tasks write archives whose records are gzip members of their own, so that each can be read by its range. Captures are
sorted by their URL with the host reversed and written as compressed blocks of lines; a sparse directory has one entry
a block. A lookup searches the directory, reads one block, searches in it, and then reads the record's range of the
archive. Lookups come in sorted order, so a task needs a stretch of the directory only and neighbours share blocks;
ranges are read in the order in which they lie in the archives, near ones together. Nothing of the index is broadcast.

Of equal payloads one record holds the payload, the others refer to it. Copies are found by SHA-256.

Files lie below a folder that all machines see, given as a path or URI that pyarrow opens. A task that runs twice
writes a file of another name; only files of the run that counts are in the index.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_folder, stored

#: Payloads shorter than this are written each time.
LEAST_REVISIT = 100
#: An archive is closed at this size.
ARCHIVE_BYTES = 1 << 30
#: Captures of a block of the index.
BLOCK_LINES = 2048
#: Ranges this near each other are read at once, up to so many bytes.
READ_GAP, READ_BYTES = 1 << 16, 1 << 23
#: Stretches of an archive that are dealt to readers.
STRETCH = 1 << 26
#: Rows of one group of copies are joined in so many parts.
SALTS = 16

CAPTURES = "line_key string, file string, offset long, length long"
_DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """`https://www.Example.org:80/a?b#c` -> `org,example,www:80)/a?b`: pages of a host and its parts lie together.

    Scheme, user and fragment go. A text that is no such URL is its own key, null counts as empty. White space and
    control characters become %20, so that a key is one word.
    """
    url = F.coalesce(url, F.lit(""))
    place = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]*)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, place, 1)), r"\.")), ",")
    key = F.when(url.rlike(place), F.concat(host, F.regexp_extract(url, place, 2), F.lit(")"), F.regexp_extract(url, place, 3))).otherwise(url)
    return F.regexp_replace(key, r"[\x00-\x20\x7F]", "%20")


def line_key(url: Column, page_id: Column) -> Column:
    """What a line of the index begins with."""
    return F.concat_ws(" ", url_key(url), F.coalesce(page_id.cast("string"), F.lit("-")))


def payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload another page of smaller id holds; distinct rows.

    Pages without an id refer to the smallest id of their copies, or hold their payload where none has an id. Rows
    that repeat the smallest id all hold it.
    """
    meta = pages.select("page_id", F.sha2(payload(), 256).alias("digest"), F.octet_length(payload()).alias("size"))
    meta = meta.where(F.col("size") >= LEAST_REVISIT)
    groups = (
        meta.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")
    )
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = meta.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["digest", "salt"]).where(
        F.col("page_id").isNull() | (F.col("page_id") != F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _Appender:
    """Files in a folder, one after the other; `put` returns where the bytes lie."""

    def __init__(self, folder: str, ending: str, limit: int = ARCHIVE_BYTES):
        self.fs, self.folder = _opened(folder)
        self.ending, self.limit, self.stream = ending, limit, None

    def put(self, data: bytes) -> tuple[str, int, int]:
        if self.stream is not None and self.at >= self.limit:
            self.close()
        if self.stream is None:
            self.fs.create_dir(self.folder, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}{self.ending}", 0
            self.stream = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.stream.write(data)
        place = (self.name, self.at, len(data))
        self.at += len(data)
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id}:{digest}'.encode()).hexdigest()[:32])}>"


def _one_line(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC record as a gzip member. A revisit has the HTTP head only."""
    body = html.encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + body
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and payload of a record."""
    data = gzip.decompress(member)
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
    block = data[end + 4 : end + 4 + int(fields["content-length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of all pages below `folder`; returns their captures (`CAPTURES`), kept in the shared folder.

    `date` is the time of capture that all records bear.
    """
    copies = revisits(pages).select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), "refers_to")
    rows = pages.select("page_id", "url", payload().alias("html"), F.sha2(payload(), 256).alias("digest"))
    rows = rows.join(copies, rows["page_id"].eqNullSafe(copies["copy_id"]) & (rows["digest"] == copies["copy_digest"]), "left")
    rows = rows.select("page_id", "url", "html", "digest", "refers_to", line_key(F.col("url"), F.col("page_id")).alias("line_key"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Appender(folder, ".warc.gz")
        for batch in batches:
            columns = [batch.column(name) for name in ("page_id", "url", "html", "digest", "refers_to")]
            places = [out.put(record(*(c[k].as_py() for c in columns), date)) for k in range(batch.num_rows)]
            files, offsets, lengths = zip(*places) if places else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("line_key"), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                ["line_key", "file", "offset", "length"])
        out.close()

    return stored(rows.mapInArrow(write, CAPTURES), "captures")


@dataclass(frozen=True)
class CaptureIndex:
    """Folders of the archives, of the index blocks, and of the directory (Parquet, a row a block)."""

    archives: str
    blocks: str
    directory: str


def write_index(captures: DataFrame, archives: str, folder: str) -> CaptureIndex:
    """Blocks of sorted lines, `key id {"file", "offset", "length"}`, and the directory of their first and last keys."""
    index = CaptureIndex(archives, f"{folder}/blocks", f"{folder}/directory")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Appender(index.blocks, ".cdx.gz")
        lines: list[tuple[str, str]] = []

        def block() -> pa.RecordBatch:
            name, offset, length = out.put(gzip.compress("".join(f"{k} {v}\n" for k, v in lines).encode(), 6, mtime=0))
            row = dict(first_key=lines[0][0], last_key=lines[-1][0], file=name, offset=offset, length=length, lines=len(lines))
            lines.clear()
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            for k in range(batch.num_rows):
                key, file, offset, length = (batch.column(c)[k].as_py() for c in ("line_key", "file", "offset", "length"))
                lines.append((key, json.dumps({"file": file, "offset": offset, "length": length})))
                if len(lines) == BLOCK_LINES:
                    yield block()
        if lines:
            yield block()
        out.close()

    ordered = captures.repartitionByRange("line_key").sortWithinPartitions("line_key")
    ordered.mapInArrow(write, _DIRECTORY).write.parquet(index.directory)
    return index


class _Searcher:
    """Lookups in ascending order; keeps the stretch of the directory and the block that it used last."""

    def __init__(self, index: CaptureIndex):
        self.blocks, self.path = _opened(index.blocks)
        files, path = _opened(index.directory)
        self.directory = ds.dataset(path, filesystem=files, format="parquet")
        self.at, self.lines = None, []

    def stretch(self, low: str, high: str) -> None:
        """Load the entries of the blocks that can hold keys from low to high; `high` stands for all that begin so."""
        first, last = ds.field("first_key"), ds.field("last_key")
        rows = self.directory.to_table(filter=(last >= low) & (first <= high + "\U0010ffff")).sort_by([("first_key", "ascending"), ("last_key", "ascending")])
        self.entries = rows.to_pylist()
        self.last = [e["last_key"] + " " for e in self.entries]

    def find(self, wanted: str) -> Iterator[dict]:
        """Captures whose line begins with `wanted`: a key, or key and id, with a blank behind."""
        for k in range(bisect.bisect_left(self.last, wanted), len(self.entries)):
            entry = self.entries[k]
            if (entry["first_key"] + " ")[: len(wanted)] > wanted:
                return
            place = (entry["file"], entry["offset"])
            if self.at != place:
                with self.blocks.open_input_file(f"{self.path}/{entry['file']}") as file:
                    data = file.read_at(entry["length"], entry["offset"])
                self.at, self.lines = place, gzip.decompress(data).decode().split("\n")[:-1]
            for n in range(bisect.bisect_left(self.lines, wanted), len(self.lines)):
                if not self.lines[n].startswith(wanted):
                    break
                yield json.loads(self.lines[n].split(" ", 2)[2])


def locate(lookups: DataFrame, index: CaptureIndex, key: str = "line_key") -> DataFrame:
    """The captures (`CAPTURES`) of each distinct `key` of `lookups`: all those of a URL's key, or one of `line_key`s.

    Keys without a capture give no row.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = None
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if not keys:
                continue
            searcher = searcher or _Searcher(index)
            searcher.stretch(keys[0], keys[-1])
            found = [{"line_key": k, **capture} for k in keys for capture in searcher.find(f"{k} ")]
            yield pa.RecordBatch.from_pylist(found, pa.schema(
                [("line_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    keys = lookups.select(F.col(key).alias("line_key")).distinct()
    return keys.repartitionByRange("line_key").sortWithinPartitions("line_key").mapInArrow(search, CAPTURES)


def read_captures(captures: DataFrame, archives: str, payloads: bool = False) -> DataFrame:
    """The records at given places; with `payloads` their payload, too (null in a revisit).

    Columns page_id, url, record_type, refers_to, payload_bytes (null in a revisit) and payload_digest: of the
    payload as it was read, or what a revisit says of the payload it refers to.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payloads else [])])

    def row(member: bytes) -> dict:
        fields, body = parse(member)
        numbers = [fields.get(name) for name in ("x-page-id", "x-refers-to-page-id")]
        out = {"url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
               "page_id": numbers[0] and int(numbers[0]), "refers_to": numbers[1] and int(numbers[1])}
        if fields["warc-type"] == "revisit":
            return {**out, "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:")}
        return {**out, "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest(), "payload": body}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _opened(archives)
        opened, name = None, None
        for batch in batches:
            places = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            at = 0
            while at < len(places):
                file, start, length = places[at]
                until, end = at + 1, start + length
                while until < len(places) and places[until][0] == file and places[until][1] <= end + READ_GAP and places[until][1] + places[until][2] - start <= READ_BYTES:
                    end = max(end, places[until][1] + places[until][2])
                    until += 1
                if name != file:
                    if opened is not None:
                        opened.close()
                    opened, name = files.open_input_file(f"{path}/{file}"), file
                data = opened.read_at(end - start, start)
                members = (data[o - start : o - start + n] for _, o, n in places[at:until])
                yield pa.RecordBatch.from_pylist([row(m) for m in members], schema)
                at = until
        if opened is not None:
            opened.close()

    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = captures.repartition("file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, _RECORDS + (", payload binary" if payloads else ""))


def resolved(records: DataFrame) -> DataFrame:
    """Records with the size of the payload that a revisit refers to, from the record that holds it.

    One row of each group of copies is looked up, and then joined to the group's revisits in `SALTS` parts.
    """
    revisit = F.col("record_type") == "revisit"
    asked = records.where(revisit).select(F.col("refers_to").alias("held_id"), F.col("payload_digest").alias("held_digest")).distinct()
    holders = records.where(~revisit).select("page_id", "payload_digest", F.col("payload_bytes").alias("held_bytes")).distinct()
    held = asked.join(holders, (asked["held_id"] == holders["page_id"]) & (asked["held_digest"] == holders["payload_digest"]))
    held = held.select("held_id", "held_digest", "held_bytes", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("held_salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    match = (F.col("refers_to") == F.col("held_id")) & (F.col("payload_digest") == F.col("held_digest")) & (salt == F.col("held_salt"))
    return records.join(held, match, "left").withColumn("payload_bytes", F.coalesce("payload_bytes", "held_bytes")).drop(*held.columns)


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """All pages written as archives with an index, looked up by URL key and id, and read back.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload; a null
    URL is kept as none. Rows that repeat url and id are separate captures with a row each. Other columns of `pages`
    play no part. An empty table gives no row.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, f"{folder}/archives")
    index = write_index(captures, f"{folder}/archives", f"{folder}/index")
    lookups = pages.select(line_key(F.col("url"), F.col("page_id")).alias("line_key"))
    records = cut(read_captures(locate(lookups, index), index.archives).drop("url"))
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
