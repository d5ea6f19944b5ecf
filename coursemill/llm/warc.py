"""WARC archives as a Spark data source, for writing and reading.

Writing: each task rolls gzip files (one member per record) with a sidecar that lists the byte range
of every record. The commit step, which only sees files of successful tasks, writes the list of
files that make up the archive; files of failed or repeated attempts are never read.

Reading: the plan cuts the archive into byte ranges of about ``range_bytes`` along the sidecars.
A task inflates a record's headers first. Filters on header columns that Spark pushes down are
applied to them; a record that fails is left at once and the task seeks to the next one, so its
payload is never inflated. Archives without sidecars are read file by file.

Paths go through pyarrow's file systems, so ``file:``, ``hdfs:`` and object stores work alike.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from coursemill.session import shared_dir

MANIFEST = "_files.json"
FILE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
HEAD_BYTES = 4096
CAPTURED = "2024-01-01T00:00:00Z"

# The columns of a record and the header that holds each.
RECORD = (
    "record_type string, record_id string, page_id long, url string, refers_to long, "
    "digest string, full_length long, payload binary"
)
HEADER_COLUMNS = ("record_type", "record_id", "page_id", "url", "refers_to", "digest")


def _open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def encode_record(page_id: int | None, url: str | None, html: str | None, record_type: str, refers_to: int | None, digest: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head only, whose length is that of the full payload."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if record_type == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {CAPTURED}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if record_type == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_id(refers_to)}")
        head.append(f"X-Refers-To-Page: {refers_to}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, sep, value in (x.partition(":") for x in lines) if sep}


def _columns(fields: dict[str, str]) -> dict:
    digest = fields.get("warc-payload-digest", "")
    scheme, _, code = digest.partition(":")
    as_hex = base64.b32decode(code).hex() if scheme.lower() == "sha1" and len(code) == 32 else (code or None)
    number = lambda key: int(fields[key]) if key in fields else None
    return {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "page_id": number("x-page-id"),
        "url": fields.get("warc-target-uri"),
        "refers_to": number("x-refers-to-page"),
        "digest": as_hex,
    }


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int]]  # name, bytes, records


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        files, sink, name, at, index = [], None, "", 0, []

        def close() -> None:
            if sink is not None:
                sink.close()
                with fs.open_output_stream(f"{root}/{name}.idx") as side:
                    side.write("".join(f"{offset} {size}\n" for offset, size in index).encode())
                files.append((name, at, len(index)))

        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "html", "record_type", "refers_to", "digest")]
            for i in range(batch.num_rows):
                if sink is None or at >= self.file_bytes:
                    close()
                    name, at, index = f"part-{uuid.uuid4().hex}.warc.gz", 0, []
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                pack = zlib.compressobj(5, wbits=31)
                member = pack.compress(encode_record(*[c[i].as_py() for c in columns])) + pack.flush()
                sink.write(member)
                index.append((at, len(member)))
                at += len(member)
        close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open_fs(self.path)
        fs.create_dir(root, recursive=True)
        listed = sorted(f for m in messages if m is not None for f in m.files)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int | None


def _gzip_record(source, offset: int, wanted) -> tuple[dict | None, bytes | None, int]:
    """(columns or None, block or None, offset behind): the block is inflated for wanted records only."""
    source.seek(offset)
    inflate, plain, taken = zlib.decompressobj(31), b"", 0
    while b"\r\n\r\n" not in plain and not inflate.eof:
        chunk = source.read(HEAD_BYTES)
        if not chunk:
            return None, None, -1
        taken += len(chunk)
        plain += inflate.decompress(chunk, HEAD_BYTES)
        while inflate.unconsumed_tail and b"\r\n\r\n" not in plain:
            plain += inflate.decompress(inflate.unconsumed_tail, HEAD_BYTES)
    fields = _fields(plain[: plain.index(b"\r\n\r\n")])
    columns = _columns(fields)
    keep = wanted(columns)
    parts = [plain] if keep else None
    if not keep:
        return None, None, offset  # the caller knows the next offset, or asks for it
    rest = inflate.unconsumed_tail
    while not inflate.eof:
        rest = rest or source.read(1 << 16)
        if not rest:
            break
        parts.append(inflate.decompress(rest))
        rest = inflate.unconsumed_tail
    whole = b"".join(parts)
    body = whole.index(b"\r\n\r\n") + 4
    return columns, whole[body : body + int(fields.get("content-length", 0))], offset


def _member_end(source, offset: int) -> int:
    """Where the gzip member at ``offset`` ends; only needed for archives without a sidecar."""
    source.seek(offset)
    inflate, read = zlib.decompressobj(31), 0
    while not inflate.eof:
        chunk = source.read(1 << 16)
        if not chunk:
            break
        read += len(chunk)
        inflate.decompress(chunk)
    return offset + read - len(inflate.unused_data)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.equal: list[tuple[str, frozenset]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Takes equality, IN and IS NOT NULL on header columns; Spark evaluates all others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADER_COLUMNS:
                yield f
            elif isinstance(f, EqualTo):
                self.equal.append((column, frozenset([f.value])))
            elif isinstance(f, In):
                self.equal.append((column, frozenset(f.value)))
            elif isinstance(f, IsNotNull):
                self.present.append(column)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as arrow_fs

        fs, root = _open_fs(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == arrow_fs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as listed:
                files = [(name, size) for name, size, _ in json.loads(listed.read())]
        else:
            found = fs.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
            files = sorted((f.base_name, f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")))
        plan: list[InputPartition] = []
        for name, size in files:
            cuts = range(0, max(size, 1), self.range_bytes) if self._index(fs, f"{root}/{name}") is not None else [0]
            ends = [*list(cuts)[1:], None]
            plan += [ByteRange(name, start, end) for start, end in zip(cuts, ends)]
        return plan or [ByteRange("", 0, 0)]

    @staticmethod
    def _index(fs, path: str):
        from pyarrow import fs as arrow_fs

        info = fs.get_file_info(f"{path}.idx")
        return path + ".idx" if info.type == arrow_fs.FileType.File else None

    def _wanted(self, columns: dict) -> bool:
        return all(columns[c] in values for c, values in self.equal) and all(columns[c] is not None for c in self.present)

    def _records(self, part: ByteRange) -> Iterator[tuple[dict, bytes]]:
        fs, root = _open_fs(self.path)
        path = f"{root}/{part.file}"
        with fs.open_input_file(path) as source:
            if side := self._index(fs, path):
                with fs.open_input_stream(side) as lines:
                    offsets = [int(x.split()[0]) for x in lines.read().decode().splitlines()]
                for offset in offsets:
                    if part.start <= offset and (part.end is None or offset < part.end):
                        columns, block, _ = _gzip_record(source, offset, self._wanted)
                        if columns is not None:
                            yield columns, block
            elif part.file.endswith(".gz"):
                offset, size = 0, source.size()
                while offset < size:
                    columns, block, behind = _gzip_record(source, offset, self._wanted)
                    if columns is not None:
                        yield columns, block
                    if behind < 0:
                        break
                    offset = _member_end(source, offset)
            else:
                yield from self._plain(source)

    def _plain(self, source) -> Iterator[tuple[dict, bytes]]:
        """Uncompressed records: skips unwanted blocks by their stated length."""
        offset, size = 0, source.size()
        while offset < size:
            head = b""
            source.seek(offset)
            while b"\r\n\r\n" not in head:
                chunk = source.read(HEAD_BYTES)
                if not chunk:
                    return
                head += chunk
            at = head.index(b"\r\n\r\n") + 4
            fields = _fields(head[: at - 4])
            length = int(fields.get("content-length", 0))
            columns = _columns(fields)
            if self._wanted(columns):
                source.seek(offset + at)
                yield columns, source.read(length)
            offset += at + length + 4

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        names = [*HEADER_COLUMNS, "full_length", "payload"]
        kinds = dict(zip(names, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())))
        # in the order of the schema
        order = [x.split()[0] for x in RECORD.split(", ")]
        rows: list[dict] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[c] for r in rows], kinds[c]) for c in order], order)

        if not partition or not partition.file:
            return
        for columns, block in self._records(partition):
            head, _, body = block.partition(b"\r\n\r\n")
            fields = _fields(head)
            revisit = columns["record_type"] == "revisit"
            length = int(fields.get("content-length", len(body))) if revisit else len(body)
            rows.append(columns | {"full_length": length, "payload": None if revisit or not self.with_payload else body})
            held += len(body) + 200
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    """Options: path, file_bytes (writing), range_bytes and payload (reading)."""

    @classmethod
    def name(cls) -> str:
        return "coursemill_warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known to ``spark`` and lets Spark push filters into Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def deduplicated(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest, record_type and refers_to of each row.

    Rows of equal payload of at least ``least_bytes`` bytes: that with the largest page_id is the
    response and the others revisit it. The digest of payloads that occur once never meets a join
    partner, and only (digest, largest id) is aggregated, before the shuffle as well as after.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    copies = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 AND _first IS NOT NULL")
        .drop("_n")
    )
    is_copy = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(copies, "digest", "left").select(
        "page_id",
        "url",
        "html",
        F.when(is_copy, "revisit").otherwise("response").alias("record_type"),
        F.when(is_copy, F.col("_first")).alias("refers_to"),
        "digest",
    )


def write_archive(pages: DataFrame, path: str, least_bytes: int = 1000, file_bytes: int = FILE_BYTES) -> None:
    """Writes ``pages`` (page_id, url, html) as a WARC archive with revisit records under ``path``.

    A null html is an empty payload, a null url or page_id writes no such header and reads back as
    null. Rows with a null page_id never serve as the response of others. Repeated rows that hold
    the winning page_id are responses each. An empty table writes an archive without records.
    """
    register(pages.sparkSession)
    deduplicated(pages, least_bytes).write.format("coursemill_warc").mode("append").options(
        path=path, file_bytes=str(file_bytes)
    ).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("coursemill_warc").options(path=path, payload=str(payload)).load()


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/coursemill/warc-{uuid.uuid4().hex}"
