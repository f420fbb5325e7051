"""Web archives (WARC/1.1) as a Spark data source, with revisit records for repeated payloads.

``spark.read.format("warc")`` plans one partition per group of files of about
``split_bytes``.  A task parses a record's headers first.  Predicates on the
record type and on the other header columns are decided there: those of the
option ``where``, and with the option ``push`` those that Spark pushes down
(the session's ``spark.sql.python.filterPushdown.enabled`` must be on).  Spark
4.1 keeps what it has pushed for a ``load()`` for later plans over that same
load, so with ``push`` each filtered branch needs a load of its own; ``where``
has no such limit, and is what this module uses.  A record that fails the predicates, or of
which no body column is asked for, is passed over: plain files are read on from behind it, and of compressed ones (a gzip
member per record) the member is not inflated, as its length stands in the
member's own header (subfield ``sl``).  Files of other writers that lack it are
inflated and dropped.

``df.write.format("warc")`` writes a file per task and further ones beyond
``file_bytes``, first below ``_temporary``; only the files of tasks whose results
count are moved to their place, so that a lost executor leaves nothing.

Files are opened with pyarrow's file systems, so that paths may be on a shared
disk or in an object store.  A truncated or foreign file raises an error that
names file and byte.  Chunked or compressed HTTP bodies are returned as they
stand.
"""

from __future__ import annotations

import datetime
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from .store import bounded_batches, keep, place

#: Columns of headers, by the header's name in lower case.
HEADERS = {
    "warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "content_type": "content-type",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_length": "content-length",
}
SCHEMA = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in HEADERS) + ", headers map<string,string>, http_status int, payload_bytes long, payload binary, file string, position long"
_ARROW = {"content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "http_status": pa.int32(), "payload_bytes": pa.int64(), "payload": pa.binary(), "position": pa.int64()}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 128 << 20
FILE_BYTES = 128 << 20
_CHUNK = 1 << 16
_BATCH_ROWS, _BATCH_BYTES = 1_000, 8 << 20


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Plain:
    """Bytes of a file in order; what is skipped is not read."""

    def __init__(self, file: pa.NativeFile, name: str):
        self.file, self.name, self.size, self.at, self.held = file, name, file.size(), 0, bytearray()

    def position(self) -> int:
        return self.at - len(self.held)

    def fill(self) -> bool:
        got = self.file.read_at(min(_CHUNK, self.size - self.at), self.at) if self.at < self.size else b""
        self.at += len(got)
        self.held += got
        return bool(got)

    def need(self, n: int) -> None:
        while len(self.held) < n:
            if not self.fill():
                raise ValueError(f"{self.name} ends inside a record (byte {self.at})")

    def take(self, n: int) -> bytes:
        self.need(n)
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip(self, n: int) -> None:
        """Pass over the next ``n`` bytes, which end a record."""
        self.at += max(0, n - len(self.held))
        if self.at > self.size:
            raise ValueError(f"{self.name} ends inside a record (byte {self.size})")
        del self.held[:n]

    def upto(self, mark: bytes, most: int | None = None) -> bytes | None:
        """The bytes up to and with ``mark``; None if the next ``most`` bytes do not hold it."""
        seen = 0
        while (found := self.held.find(mark, max(0, seen - len(mark) + 1))) < 0 or (most is not None and found + len(mark) > most):
            if found >= 0 or (most is not None and len(self.held) >= most):
                return None
            seen = len(self.held)
            self.need(seen + 1)
        return self.take(found + len(mark))

    def begins(self) -> bool:
        """Whether another record follows; blank lines before it are dropped."""
        while True:
            while self.held[:1] in (b"\r", b"\n"):
                del self.held[:1]
            if self.held:
                return True
            if not self.fill():
                return False


class _Gzip(_Plain):
    """The same for gzip members; a member that states its length is left as a whole."""

    inflater = None
    start = 0
    end: int | None = None

    def position(self) -> int:
        return self.start

    def fill(self) -> bool:
        if self.inflater is None:
            if self.at >= self.size:
                return False
            self.start, self.end = self.at, None
            head = self.file.read_at(24, self.at)
            if head[3:4] == b"\x04" and head[12:16] == b"sl\x08\x00":
                self.end = self.at + int.from_bytes(head[16:20], "little") or None
            self.inflater = zlib.decompressobj(31)
        before = len(self.held)
        while len(self.held) == before:
            raw = self.file.read_at(min(_CHUNK, self.size - self.at), self.at)
            if not raw:
                raise ValueError(f"{self.name} ends inside a gzip member (byte {self.at})")
            self.held += self.inflater.decompress(raw)
            self.at += len(raw)
            if self.inflater.eof:
                self.at -= len(self.inflater.unused_data)
                self.inflater = None
                return True
        return True

    def skip(self, n: int) -> None:
        if n > len(self.held) and self.end:
            self.at, self.inflater = self.end, None
            self.held.clear()
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held.clear()
            self.need(1)
        del self.held[:n]


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    """Header lines as (name, value); a line that begins with a blank continues the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, value = text.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def _header_values(fields: dict[str, str]) -> dict[str, object]:
    out: dict[str, object] = {}
    for column, name in HEADERS.items():
        value = fields.get(name)
        if value is not None and column in ("record_id", "refers_to", "target_uri"):
            value = value[1:-1] if value[:1] == "<" and value[-1:] == ">" else value
        out[column] = value
    digest = out["payload_digest"]
    out["payload_digest"] = digest.split(":", 1)[-1] if digest else None
    out["content_length"] = int(fields["content-length"])
    return out


def _decide(kind: str, value: object, wanted: object) -> bool:
    """A pushed predicate on a header; null satisfies none but the test for null."""
    if kind == "IsNull":
        return value is None
    if kind == "EqualNullSafe":
        return value == wanted
    if value is None:
        return False
    return {"IsNotNull": lambda: True, "EqualTo": lambda: value == wanted, "In": lambda: value in wanted, "StringStartsWith": lambda: value.startswith(wanted), "GreaterThan": lambda: value > wanted, "GreaterThanOrEqual": lambda: value >= wanted, "LessThan": lambda: value < wanted, "LessThanOrEqual": lambda: value <= wanted}[kind]()


_NUMERIC_ONLY = ("GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual")  # strings compare by bytes in Spark
_PUSHED = (*_NUMERIC_ONLY, "IsNull", "IsNotNull", "EqualTo", "EqualNullSafe", "In", "StringStartsWith")


class Files(ds.InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.predicates: list[tuple[str, str, object]] = []
        for name, value in json.loads(options.get("where", "{}")).items():
            if name not in HEADERS:
                raise ValueError(f"{name} is no header column")
            self.predicates.append((name, "IsNull" if value is None else "In" if isinstance(value, list) else "EqualTo", value))

    def partitions(self):
        files, root = _file_system(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if files.get_file_info(root).type == fs.FileType.Directory else [files.get_file_info(root)]
        found = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path) and "/_temporary/" not in f.path)
        groups: list[list[str]] = []
        room = 0
        for path, size in found:
            if not groups or size > room:
                groups.append([])
                room = self.split_bytes
            groups[-1].append(path)
            room -= size
        return [Files(g) for g in groups]

    def read(self, partition):
        files, _ = _file_system(self.path)
        columns = self.columns
        rows: dict[str, list] = {c: [] for c in columns}
        held, some = 0, False

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[c], _ARROW.get(c, pa.string())) for c in columns], columns)

        for path in partition.paths if partition else ():
            with files.open_input_file(path) as file:
                for values in self.records((_Gzip if path.endswith(".gz") else _Plain)(file, path)):
                    for c in columns:
                        rows[c].append(values.get(c))
                    held += len(values.get("payload") or b"") + 500
                    if len(rows[columns[0]]) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield batch()
                        rows, held, some = {c: [] for c in columns}, 0, True
        if not some or rows[columns[0]]:
            yield batch()

    def records(self, source: _Plain) -> Iterator[dict[str, object]]:
        """Values of each record of a file that the pushed predicates let through."""
        body = {"http_status", "payload_bytes", "payload"} & set(self.columns)
        while source.begins():
            position = source.position()
            lines = (source.upto(b"\r\n\r\n") or b"").split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {position} of {source.name}")
            fields = _fields(lines[1:])
            values = _header_values({k.lower(): v for k, v in fields})
            length = values["content_length"]
            if not all(_decide(kind, values[name], wanted) for name, kind, wanted in self.predicates):
                source.skip(length)
                continue
            values |= {"headers": fields, "file": source.name, "position": position}
            if body:
                length -= self.http(source, values, length)
                if "payload" in body:
                    values["payload"] = source.take(length)
                    length = 0
            if length:
                source.skip(length)
            yield values

    @staticmethod
    def http(source: _Plain, values: dict[str, object], length: int) -> int:
        """Take the HTTP headers of a record's block; the number of their bytes."""
        head = source.upto(b"\r\n\r\n", length) if str(values["content_type"] or "").startswith("application/http") else None
        values["payload_bytes"] = length - len(head or b"")
        if head is None:
            return 0
        first, *lines = head.split(b"\r\n")
        status = re.match(rb"HTTP/\S+\s+(\d{3})", first)
        values["http_status"] = int(status[1]) if status else None
        if values["warc_type"] == "revisit":  # the body that was left out
            stated = {k.lower(): v for k, v in _fields(lines)}.get("content-length", "")
            values["payload_bytes"] = int(stated) if stated.isdigit() else None
        return len(head)


class PushedReader(WarcReader):
    """A reader that takes predicates from Spark; Spark asks for its setting wherever a reader can."""

    def pushFilters(self, filters):
        for f in filters:
            kind, name = type(f).__name__, ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name in HEADERS and kind in _PUSHED and (kind not in _NUMERIC_ONLY or name == "content_length"):
                self.predicates.append((name, kind, getattr(f, "value", None)))
            else:
                yield f


class Written(ds.WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


def _safe(value: str) -> str:
    """A header value on one line: control characters and blanks at its ends in per cent form."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict[str, object], date: str) -> bytes:
    """One record; ``payload`` null with ``refers_to`` set makes a revisit."""
    revisit, payload = row["warc_type"] == "revisit", row["payload"] or b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: <{_safe(row['record_id'])}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_safe(row['target_uri'])}")
    head.append(f"WARC-Payload-Digest: sha1:{row['payload_digest']}")
    if revisit:
        head += [f"WARC-Refers-To: <{_safe(row['refers_to'])}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that states its own length (0: not known) in its header."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = deflate.compress(data) + deflate.flush()
    size = 24 + len(packed) + 8
    lengths = (size if size < 1 << 32 else 0).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + (12).to_bytes(2, "little") + b"sl" + (8).to_bytes(2, "little") + lengths + packed + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.job = uuid.uuid4().hex
        self.date = options.get("date") or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator):
        files, root = _file_system(self.path)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                columns = {c: batch.column(c) for c in ("warc_type", "record_id", "target_uri", "payload", "payload_bytes", "payload_digest", "refers_to")}
                for i in range(batch.num_rows):
                    data = record({c: x[i].as_py() for c, x in columns.items()}, self.date)
                    data = member(data) if self.gzip else data
                    if out is None or size + len(data) > self.file_bytes:
                        if out is not None:
                            out.close()
                        if not names:
                            files.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
                        names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                        out, size = files.open_output_stream(f"{root}/_temporary/{self.job}/{names[-1]}", compression=None), 0
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        files, root = _file_system(self.path)
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File:
                    files.delete_file(f.path)
        for name in (n for m in messages if m for n in m.names):
            files.move(f"{root}/_temporary/{self.job}/{name}", f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages):
        self._clear(*_file_system(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        own = f"{root}/_temporary/{self.job}"
        if files.get_file_info(own).type == fs.FileType.Directory:
            files.delete_dir(own)


class WarcSource(ds.DataSource):
    """``warc``: options path, where (JSON), push, split_bytes (reading), compression (gzip or none), file_bytes, date (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        unknown = set(schema.names) - {f.split(" ")[0] for f in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        return (PushedReader if self.options.get("push") == "true" else WarcReader)(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, *columns: str, where: dict[str, object] | None = None, push: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records below ``path``; with ``columns`` only these, so that bodies that nobody asks for are passed over.

    ``where`` names header columns and the value, list of values or None that each must have.  ``push`` turns on
    Spark's own push-down, for the session too; see the module's text before using it."""
    spark.dataSource.register(WarcSource)
    if push:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    parts = {f.split(" ")[0]: f for f in SCHEMA.split(", ")}
    schema = ", ".join(parts[c] for c in columns) if columns else SCHEMA
    return spark.read.format("warc").schema(schema).option("where", json.dumps(where or {})).option("push", str(push).lower()).option("split_bytes", split_bytes).load(path)


def write_warc(records: DataFrame, path: str, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Append ``records`` (as ``records`` gives them) to the archive at ``path``."""
    records.sparkSession.dataSource.register(WarcSource)
    bounded_batches(records).write.format("warc").option("compression", compression).option("file_bytes", file_bytes).mode("append").save(path)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hex digits are four of them."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, prefix: str = "urn:page:") -> DataFrame:
    """A record for each page: of equal payloads of at least ``min_bytes`` bytes that with the largest id is the response, others revisit it.

    A null payload is empty; a null id is the smallest and its record id ends with the prefix.  Of repeated rows
    that share the largest id each is a response."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    # payloads that stand more than once; stored, so that Spark sees whether it can be broadcast before any page is shuffled
    again = keep(rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("digest")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    rows = rows.join(again, (rows["payload_digest"] == again["digest"]) & (rows["payload_bytes"] >= min_bytes), "left")
    revisit = F.col("digest").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    named = lambda x: F.concat(F.lit(prefix), F.coalesce(x.cast("string"), F.lit("")))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"), named(F.col("page_id")).alias("record_id"), "target_uri", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest",
        F.when(revisit, named(F.col("keeper"))).alias("refers_to"),
    )


def archived(spark: SparkSession, path: str, prefix: str = "urn:page:") -> DataFrame:
    """Per record below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are computed from the payload that is read; a revisit has its own in its headers,
    so that no body is read for it."""
    number = lambda c: F.when(F.length(c) > len(prefix), F.substring(c, len(prefix) + 1, 20).cast("long"))
    whole = read_warc(spark, path, "warc_type", "record_id", "payload", where={"warc_type": "response"})
    whole = whole.select(number(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = read_warc(spark, path, "warc_type", "record_id", "payload_digest", "refers_to", "payload_bytes", where={"warc_type": "revisit"})
    again = again.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))
    return whole.unionByName(again)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archive back."""
    spark = pages.sparkSession
    path = place(spark, "warc")
    write_warc(records(pages, id_col, url_col, payload_col, min_bytes), path)
    return archived(spark, path).withColumnRenamed("page_id", id_col)
