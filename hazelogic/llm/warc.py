"""WARC writing with deduplicated payloads, and a reader that salvages damage.

The writer puts each page in a gzip member of its own, in files of about
`ROTATE` bytes under names that no other attempt uses; a table of the files
that committed tasks wrote is what gets read, so a lost executor leaves no
half-written or doubled archive behind. The reader checks each record; where a
check fails it searches for the next member (or version line, in archives
without compression) that holds a valid record, goes on there, and logs the
bytes between as a quarantined gap. It reads an archive by slices and holds one
record at a time.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazelogic.llm.common import filesystem, materialise, new_path

#: Bytes after which a writer starts another file.
ROTATE = 32 << 20
#: Bytes that the reader takes from a file, and that it feeds to zlib, at a time.
WINDOW, SLICE = 1 << 20, 1 << 15
VERSION = b"WARC/1.1\r\n"
_MEMBER = b"\x1f\x8b\x08"
_NEXT_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- writing


def record(page_id: int | str | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers_to: int | str | None) -> bytes:
    """One WARC record; a revisit has no body and names its response. Ids are percent-encoded."""
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>",
        "WARC-Target-URI": None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Page-ID": None if page_id is None else quote(str(page_id), safe=" "),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To-Page-ID": None if refers_to is None else quote(str(refers_to), safe=" "),
    }
    body = b"" if revisit else payload
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return VERSION + lines.encode() + f"Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    """`data` as one gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_revisits(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds digest and what the page refers to; page_id, url and html are kept.

    Of pages with equal payloads of at least `least` bytes, the one with the
    smallest id is the response and the others revisit it. Rows that repeat
    that id are responses too; a null id never is referred to. Ids keep their
    type (text ids are compared by code point). The join on the
    digest moves each page once; Spark splits the partition of a payload that
    very many pages share.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html"), 256))
    shared = pages.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("refers_to")).where("n > 1 and refers_to is not null")
    joined = pages.join(shared.drop("n"), "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(None)).otherwise(F.col("refers_to")))


def write_archives(pages: DataFrame, folder: str, rotate: int = ROTATE, compress: bool = True) -> DataFrame:
    """Writes rows of `with_revisits` under `folder`; returns path and records of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, count = None, "", 0, 0
        for b in batches:
            for row in b.to_pylist():
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                payload = row["html"].encode("utf-8", "surrogatepass")
                data = record(row["page_id"], row["url"], payload, row["digest"], row["refers_to"] is not None, row["refers_to"])
                data = member(data) if compress else data
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= rotate:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([count], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([count], pa.int64())})

    return materialise(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "path string, records long"), "warc-files")


# ---------------------------------------------------------------- reading


class Damaged(ValueError):
    pass


class Source:
    """Bytes of a file (anything with `size` and `read_at(n, at)`), read through a window."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    @classmethod
    def of(cls, data: bytes) -> Source:
        source = cls(None, len(data))
        source.held = data
        return source

    def get(self, at: int, n: int) -> bytes:
        """At most n bytes from `at`; fewer only at the end of the file."""
        n, lo = min(n, self.size - at), at - self.at
        if n <= 0:
            return b""
        if lo < 0 or lo + n > len(self.held):
            self.held, self.at = self.file.read_at(min(max(n, WINDOW), self.size - at), at), at
            lo = 0
        return self.held[lo : lo + n]

    def find(self, what: bytes, at: int) -> int:
        """Where `what` next stands from `at`, or -1."""
        while at < self.size:
            self.get(at, len(what))  # moves the window only where it does not hold these bytes
            k = self.held.find(what, at - self.at)
            if k >= 0:
                return self.at + k
            if self.at + len(self.held) >= self.size:
                return -1
            at = self.at + len(self.held) - len(what) + 1
        return -1


def _headers(block: bytes) -> dict[str, str]:
    head = {}
    for line in block.split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        head[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        raise Damaged("no content length")
    return head


def parse(source: Source, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record that begins at `at`; raises Damaged."""
    m = _NEXT_VERSION.match(source.get(at, len(VERSION)))
    if not m:
        raise Damaged("no version line")
    end = source.find(b"\r\n\r\n", at + m.end() - 2)
    if end < 0:
        raise Damaged("headers not ended")
    head = _headers(source.get(at + m.end(), end - at - m.end()))
    body, stop = end + 4, end + 4 + int(head["content-length"])
    if source.get(stop, 4) != b"\r\n\r\n":
        raise Damaged("the record does not end where it says")
    content = bytes(source.get(body, stop - body))
    kind, _, digest = head.get("warc-payload-digest", "").partition(":")
    if head.get("warc-type") == "response" and kind == "sha256" and sha256(content).hexdigest() != digest:
        raise Damaged("the payload does not match its digest")
    return head, content, stop + 4


def _read_member(source: Source, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record of the gzip member at `at`; zlib gets slices, so what follows is never copied."""
    z, plain, begin = zlib.decompressobj(31), [], at
    while not z.eof:
        part = source.get(at, SLICE)
        if not part:
            raise Damaged("the member is cut off")
        try:
            plain.append(z.decompress(part))
        except zlib.error as e:
            raise Damaged(f"the member is corrupt: {e}") from None
        if at == begin and not VERSION.startswith((b"".join(plain))[:5]):
            raise Damaged("the member holds no record")
        at += len(part)
    plain = b"".join(plain)
    head, body, end = parse(Source.of(plain))
    if end != len(plain):
        raise Damaged("more than one record in a member")
    return head, body, at - len(z.unused_data)


def salvage(data: bytes | Source) -> Iterator[tuple]:
    """("record", begin, end, headers, body) and ("gap", begin, end, reason), in order.

    Together they cover all bytes. An empty archive gives nothing. A valid
    record inside the body of a damaged one counts as the next valid record.
    """
    source = Source.of(data) if isinstance(data, bytes) else data
    plain = source.get(0, 5) == b"WARC/" or source.find(_MEMBER, 0) < 0
    read, mark = (parse, b"WARC/1.") if plain else (_read_member, _MEMBER)
    at, size = 0, source.size
    while at < size:
        try:
            got = read(source, at)
        except Damaged as e:
            reason, begin = str(e), at
            while at < size:  # the next place that holds a valid record
                at = source.find(mark, at + 1)
                at = size if at < 0 else at
                try:
                    got = read(source, at) if at < size else None
                    break
                except Damaged:
                    pass
            yield "gap", begin, at, reason
            if at >= size:
                return
        head, body, end = got
        yield "record", at, end, head, body
        at = end


_READ = "path string, kind string, `begin` long, `end` long, reason string, record_type string, page_id string, url string, payload_digest string, payload_bytes long, refers_to string, payload string"
_TEXT = frozenset("path kind reason record_type page_id url payload_digest refers_to payload".split())


def read_archives(files: DataFrame, payloads: bool = True, strict: bool = False) -> DataFrame:
    """One row per record and per quarantined gap of the archives in `files.path`.

    Gaps have kind `gap`, their byte range and the failed check; records have
    kind `record`. A record's digest and length are those of the full payload:
    taken from the body where there is one, from the headers of a revisit.
    With `payloads` false the bodies are checked but not returned. With
    `strict` a gap, or another number of records than `files.records` has,
    raises: what was just written must read back whole.
    """
    number = lambda x: int(x) if x and x.isdigit() else None
    page = lambda x: None if x is None else unquote(x)
    names = [c.split()[0].strip("`") for c in _READ.split(", ")]
    schema = pa.schema([(n, pa.string() if n in _TEXT else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, due in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f:
                    rows, held, records = [], 0, 0
                    for kind, begin, end, *rest in salvage(Source(_At(f), f.size())):
                        row = {"path": path, "kind": kind, "begin": begin, "end": end}
                        if kind == "gap":
                            if strict:
                                raise ValueError(f"{path}: bytes {begin} to {end} are damaged: {rest[0]}")
                            row |= {"reason": rest[0]}
                        else:
                            head, body = rest
                            records += 1
                            whole = head.get("warc-type") == "response"
                            row |= {"record_type": head.get("warc-type"), "url": head.get("warc-target-uri"), "page_id": page(head.get("warc-page-id")), "refers_to": page(head.get("warc-refers-to-page-id"))}
                            row |= {"payload_digest": sha256(body).hexdigest() if whole else head.get("warc-payload-digest", "").partition(":")[2], "payload_bytes": len(body) if whole else number(head.get("warc-payload-length"))}
                            row |= {"payload": body.decode("utf-8", "replace") if payloads else None}
                            held += len(body) if payloads else 0
                        rows.append(row)
                        if len(rows) >= 5_000 or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                    if strict and records != due:
                        raise ValueError(f"{path}: {records} records where {due} were written")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    due = F.col("records") if "records" in files.columns else F.lit(None)
    return files.select("path", due.cast("long").alias("records")).repartition(max(1, files.count())).mapInArrow(run, _READ)


class _At:
    """read_at of an Arrow file, as bytes."""

    def __init__(self, file):
        self.file = file

    def read_at(self, n: int, at: int) -> bytes:
        return self.file.read_at(n, at)


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder that some other program wrote, by name only."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path")


def round_trip(pages: DataFrame, folder: str | None = None, rotate: int = ROTATE, compress: bool = True, id_col: str = "page_id") -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back.

    One row per page: page_id (of its own type), payload_bytes, payload_digest,
    record_type, refers_to. A null html is an empty payload, a null url is left
    out of the record, null and repeated page ids are written as they come,
    other columns are not read. Every file must give back the records written
    to it without a gap, else the read raises. An empty table gives no archive
    and no rows.
    """
    kind = pages.schema[id_col].dataType
    files = write_archives(with_revisits(pages, id_col=id_col), folder or new_path(pages.sparkSession, "warc"), rotate, compress)
    read = read_archives(files, payloads=False, strict=True)
    return read.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
