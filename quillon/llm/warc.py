"""WARC files as a PySpark Python data source, to read and to write.

Writing: each task writes files of at most about ROLL bytes under temporary names, which begin with a dot and the
job's id; the commit gives them their names, and readers pass over the others. A task that fails removes its files.
One that is lost with its executor may leave files behind; they are never read, and the job's end removes them. Each
record is a gzip member of its own whose extra field holds the member's length.

Reading: whole files are planned into partitions of about the split size, and read in pieces: what a task holds is
bounded by a piece and the record at hand. A record's headers are inflated and
parsed first; predicates on the record's type and headers are pushed down and tested on them; the payload is
inflated only if the schema asks for it and the record is wanted. Other members are skipped by their length,
or inflated to their end where a file of other origin lacks it. Inflated payloads are held against their digest.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").schema("record_id string, payload binary").load(path).where("record_type = 'response'")

Defined cases: a null payload counts as empty; null ids, addresses and references are left out of the headers
and read back as null; line ends in header values become blanks; repeated rows are records each. Of pages with
equal payloads those without an id come last: one of them is the response only where no page has an id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from quillon.llm.common import materialize, scratch_path, tune

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, payload_digest string, refers_to string, payload_bytes long, headers map<string,string>, payload binary"
#: Header fields behind the columns that predicates can be pushed to.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
ROLL = 64 << 20
SPLIT = 64 << 20
BATCH = 4 << 20
HEAD = 4096
PIECE = 1 << 18
MAGIC = b"\x1f\x8b\x08"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------------- records


def member(block: bytes, level: int) -> bytes:
    """One gzip member with its own length in the extra field SL."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(block) + z.flush()
    size = 12 + 4 + 8 + len(body) + 8
    return MAGIC + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHQ", 12, b"SL", 8, size) + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(fields: dict[str, str | None], http_length: int, payload: bytes | None) -> bytes:
    """A response record, or without a payload a revisit record with the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {http_length}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", *(f"{k}: {' '.join(v.split())}" for k, v in fields.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class Source:
    """A file read in pieces: a buffer that forgets what was used when it needs more."""

    def __init__(self, file):
        self.file, self.buffer, self.at, self.base = file, b"", 0, 0

    def more(self) -> bool:
        piece = self.file.read(PIECE)
        self.buffer, self.base, self.at = self.buffer[self.at :] + piece, self.base + self.at, 0
        return bool(piece)

    def place(self) -> int:
        return self.base + self.at

    def ended(self) -> bool:
        return self.at >= len(self.buffer) and not self.more()

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n:
            if not self.more():
                raise ValueError("the file ends within a gzip member")
        self.at += n
        return self.buffer[self.at - n : self.at]

    def rest(self) -> bytes:
        """All that the buffer still has, or the next piece; `give_back` what was too much."""
        if self.ended():
            raise ValueError("the file ends within a gzip member")
        return self.take(len(self.buffer) - self.at)

    def give_back(self, n: int) -> None:
        self.at -= n

    def skip_to(self, place: int) -> None:
        while place - self.base > len(self.buffer):
            self.at = len(self.buffer)
            if not self.more():
                raise ValueError("the file ends within a gzip member")
        self.at = place - self.base


class Member:
    """The gzip member at a source's place, inflated as far as it is asked for."""

    def __init__(self, source: Source):
        self.source, self.start, self.size = source, source.place(), 0
        head = source.take(10)
        if head[:3] != MAGIC:
            raise ValueError(f"no gzip member at byte {self.start}")
        flags = head[3]
        if flags & 4:
            extra = source.take(struct.unpack("<H", source.take(2))[0])
            if len(extra) == 12 and extra[:2] == b"SL":
                (self.size,) = struct.unpack_from("<Q", extra, 4)
        for flag in (8, 16):
            while flags & flag and source.take(1) != b"\0":
                pass
        if flags & 2:
            source.take(2)
        self.z, self.text, self.held = zlib.decompressobj(-15), b"", b""

    def _step(self, most: int) -> bytes:
        out = self.z.decompress(self.held or self.source.rest(), most)
        self.held = self.z.unconsumed_tail
        if self.z.eof:
            self.source.give_back(len(self.z.unused_data))
        return out

    def inflate(self, most: int) -> bool:
        """Inflates up to `most` further bytes; False at the end, when there is nothing to inflate."""
        if self.z.eof:
            return False
        self.text += self._step(most)
        return True

    def close(self) -> None:
        """Leaves the source behind this member."""
        if self.size:
            self.source.skip_to(self.start + self.size)
            return
        while not self.z.eof:
            self._step(1 << 20)
        self.source.take(8)


def read_records(file, tests: list[tuple[str, frozenset]], payloads: bool) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, payload length, payload) of each record of an open file whose headers pass all tests (field, allowed values)."""
    source = Source(file)
    while not source.ended():
        one = Member(source)
        while (cut := one.text.find(b"\r\n\r\n")) < 0 and one.inflate(HEAD):
            pass
        fields = parse_fields(one.text[:cut])
        if all(fields.get(f) in allowed for f, allowed in tests):
            block, length = cut + 4, int(fields.get("Content-Length", 0))
            while (body := one.text.find(b"\r\n\r\n", block)) < 0 and one.inflate(HEAD):
                pass
            http = parse_fields(one.text[block:body]) if body >= 0 else {}
            size = int(http["Content-Length"]) if "Content-Length" in http else None
            payload = None
            if payloads and body >= 0 and fields.get("WARC-Type") == "response":
                stop = block + length
                while len(one.text) < stop and one.inflate(stop - len(one.text)):
                    pass
                payload = one.text[body + 4 : stop]
                said = fields.get("WARC-Payload-Digest", "")
                if said.startswith("sha1:") and digest_of(payload) != said[5:]:
                    raise ValueError(f"payload of {fields.get('WARC-Record-ID')} does not match its digest")
            yield fields, size, payload
        one.close()


# ---------------------------------------------------------------------- data source


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], split: int):
        self.path, self.columns, self.split = path, columns, split
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            values = f.value if isinstance(f, In) else [f.value] if name else []
            if name in FIELDS and all(isinstance(v, str) for v in values):
                prefix = "sha1:" if name == "payload_digest" else ""
                self.tests.append((FIELDS[name], frozenset(prefix + v for v in values)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = file_system(self.path)
        infos = sorted(system.get_file_info(pafs.FileSelector(root)), key=lambda i: i.path)
        groups, size = [], self.split
        for i in infos:
            # a leading dot: files of attempts that were not committed; a leading line: what other writers hide
            if i.is_file and i.base_name.endswith(".warc.gz") and i.base_name[0] not in "._" and i.size:
                if size + i.size > self.split:
                    groups, size = [*groups, Files([])], 0
                groups[-1].paths.append(i.path)
                size += i.size
        return groups

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        system, _ = file_system(self.path)
        kinds = {"payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows: list[list] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as file:
                for fields, size, payload in read_records(file, self.tests, "payload" in self.columns):
                    values = {c: fields.get(f) for c, f in FIELDS.items()} | {"headers": list(fields.items()), "payload_bytes": size, "payload": payload}
                    if values["payload_digest"]:
                        values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
                    rows.append([values[c] for c in self.columns])
                    held += 200 + len(payload or b"")
                    if held > BATCH:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_id, record_type, target_uri, payload_digest, refers_to, payload_bytes, payload); revisits carry no payload."""

    def __init__(self, path: str, level: int, roll: int):
        self.path, self.level, self.roll, self.job = path, level, roll, uuid.uuid4().hex[:12]
        system, root = file_system(path)
        system.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        names: list[str] = []
        out, size = None, 0
        try:
            for batch in iterator:
                cols = [batch[c].to_pylist() for c in ("record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_bytes", "payload")]
                for rid, kind, uri, digest, refers, n, payload in zip(*cols, strict=True):
                    fields = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Target-URI": uri, "WARC-Date": DATE, "WARC-Payload-Digest": digest and f"sha1:{digest}", "WARC-Refers-To": refers, "Content-Type": "application/http; msgtype=response"}
                    if kind == "revisit":
                        fields["WARC-Profile"], payload = REVISIT_PROFILE, None
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, size = system.open_output_stream(f"{root}/.{self.job}-{name}", compression=None), 0
                        names.append(name)
                    size += out.write(one := member(record(fields, n, payload), self.level)) or len(one)
                    if size >= self.roll:
                        out.close()
                        out = None
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
            for name in names:
                system.delete_file(f"{root}/.{self.job}-{name}")
            raise
        return Written(names)

    def _clear(self) -> None:
        """Removes what this job's lost or repeated attempts have left."""
        system, root = file_system(self.path)
        for i in system.get_file_info(pafs.FileSelector(root)):
            if i.is_file and i.base_name.startswith(f".{self.job}-"):
                system.delete_file(i.path)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{root}/.{self.job}-{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class WarcDataSource(DataSource):
    """Options: path; split (bytes of a read partition); level (of compression), roll (bytes of a written file)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames(), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", 1)), int(self.options.get("roll", ROLL)))


# ---------------------------------------------------------------------- pages


def base32(digest_hex):
    """Upper-case base 32 of a hexadecimal SHA-1, in column functions: eight digits for each five bytes."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for k in range(4):
        number = F.conv(F.substring(digest_hex, 10 * k + 1, 10), 16, 10).cast("long")
        parts += [F.substring(F.lit(alphabet), F.shiftright(number, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*parts)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One record per page: of equal payloads of at least min_bytes the one of the smallest page_id is the response.

    Equal payloads are found by their digests. Each page looks up the first page of its digest, an
    equi-join whose hot digests Spark can split. Which page is first is decided by the pages' own columns, so it does not
    depend on where rows are read. Equal rows of a first page stand for each other: they are counted, and one of them is the response.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("_hex", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    key = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    counted = rows.groupBy("_hex", key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    firsts = counted.groupBy("_hex").agg(F.min(F.struct("_key", "_n")).alias("_first"))
    firsts = materialize(firsts.select("_hex", F.col("_first._key").alias("_key"), F.col("_first._n").alias("_n")), "first-pages")
    known = rows.withColumn("_own", key).join(firsts, "_hex").withColumn("_is", F.col("_own").eqNullSafe(F.col("_key")))
    single = known.where(~F.col("_is") | (F.col("_n") == 1)).withColumn("_copy", F.when(F.col("_is"), 1).otherwise(2))
    names = ["_hex", "_key", "page_id", "url", "payload_bytes", "payload", "_copy"]
    again = known.where(F.col("_is") & (F.col("_n") > 1)).groupBy("_hex", "_key", "page_id", "url", "payload_bytes").agg(F.any_value("payload").alias("payload"), F.count(F.lit(1)).cast("int").alias("_n"))
    again = again.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_n")))
    repeated = not firsts.where("_n > 1").isEmpty()
    known = single.select(*names).unionByName(again.select(*names)) if repeated else single
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("_copy") > 1)
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    out = known.select(
        urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        base32(F.col("_hex")).alias("payload_digest"), F.when(revisit, urn(F.col("_key.page_id"))).alias("refers_to"), "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """The pages' records read back: payloads of responses are inflated and checked, revisits are read by their headers alone."""
    columns = "record_id string, record_type string, payload_digest string, refers_to string, payload_bytes long"
    source = spark.read.format("warc")
    responses = source.schema(f"{columns}, payload binary").load(path).where("record_type = 'response'")
    responses = responses.withColumn("payload_bytes", F.octet_length("payload").cast("long")).drop("payload")
    revisits = source.schema(columns).load(path).where("record_type = 'revisit'")
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(F.col(c).isNotNull(), page(F.col(c)).try_cast("long"))
    return responses.unionByName(revisits).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    tune(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    path = scratch_path(spark, "warc")
    write_pages(pages, path, min_bytes)
    return page_records(spark, path)
