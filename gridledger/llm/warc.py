"""Web archives (WARC 1.1) written and read as tables of chunked records."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content, stored

#: Payloads of at least REVISIT bytes are written once; payloads are cut into segments of SEGMENT code points.
REVISIT, SEGMENT = 1000, 65_536
#: Bytes of a chunk row when reading, and bytes of data in one batch of rows.
CHUNK, BATCH = 65_536, 4 << 20
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _lines(*pairs: tuple[str, Column | str]) -> Column:
    """Header lines; a null value leaves its line out."""
    line = lambda k, v: F.concat(F.lit(f"\r\n{k}: "), F.lit(v) if isinstance(v, str) else v.cast("string"))
    return F.concat(*[F.coalesce(line(k, v), F.lit("")) for k, v in pairs])


def _record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("-"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archive(
    pages: DataFrame, path: str, *, segment: int = SEGMENT, revisit: int = REVISIT, date: str = DATE,
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> None:
    """Write a record per page to gzip files under ``path``, which Spark's text writer can reach anywhere.

    Of pages with equal payloads of at least ``revisit`` bytes the one with the
    largest id is the response, the others are revisits that name it.  A payload
    longer than ``segment`` code points becomes a segmented record: a first segment
    and continuations, each a row of its own (record, number), next to each other in
    one file, so that no reader needs more than a chunk of it.
    """
    html = content(payload_col)
    rows = pages.select(
        F.col(id_col).alias("page"), F.coalesce(F.regexp_replace(url_col, r"[\x00-\x20\x7f]", "%20"), F.lit("")).alias("url"),
        html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n"), F.xxhash64(html).alias("check"),
    )
    # Equal payloads agree in length and two hashes.  Groups are written: the join's sides then both come straight
    # from a shuffle, and the adaptive skew join can split the pages of a payload that most others have.
    same = ["digest", "n", "check"]
    groups = stored(
        rows.filter(F.col("n") >= revisit).groupBy(*same).agg(F.max("page").alias("keeper"), F.count("*").alias("of"))
        .filter("of > 1 AND keeper IS NOT NULL").drop("of"),
        "payload-groups",
    )
    again = F.col("keeper").isNotNull() & ~F.col("page").eqNullSafe(F.col("keeper"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("n"))), F.lit(_END)
    )
    # The HTTP header is never cut: the payload's parts are, and the first follows the header.
    parts = F.regexp_extract_all("html", F.lit(f"(?s).{{1,{segment}}}"), F.lit(0))
    stored_ = F.when(F.col("again") | (F.col("html") == ""), F.array(F.lit(""))).otherwise(parts)
    cut = rows.join(groups, same, "left").withColumn("again", again).withColumn("http", http).withColumn("parts", stored_).select(
        "page", "url", "digest", "keeper", "again", "http", (F.octet_length("http") + F.col("n")).alias("total"),
        F.size("parts").alias("of"), F.posexplode("parts").alias("no", "part"),
    ).withColumn("part", F.when(F.col("no") == 0, F.concat("http", "part")).otherwise(F.col("part")))
    first, many, last = F.col("no") == 0, F.col("of") > 1, F.col("no") + 1 == F.col("of")
    own = _record_id(F.col("page"))
    only = lambda test, value: F.when(test, value)
    record = F.concat(
        F.lit("WARC/1.1"),
        _lines(
            ("WARC-Type", F.when(~first, "continuation").when(F.col("again"), "revisit").otherwise("response")),
            ("WARC-Record-ID", F.when(first, own).otherwise(_record_id(F.concat_ws("/", F.col("page").cast("string"), F.col("no").cast("string"))))),
            ("WARC-Date", date), ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", only(first, F.concat(F.lit("sha1:"), F.col("digest")))),
            ("WARC-Profile", only(first & F.col("again"), F.lit(_PROFILE))),
            ("WARC-Refers-To", only(first & F.col("again"), _record_id(F.col("keeper")))),
            ("X-Refers-To-Page", only(first & F.col("again"), F.col("keeper"))),
            ("X-Page", only(first, F.col("page"))),
            ("WARC-Segment-Number", only(many, F.col("no") + 1)), ("WARC-Segment-Origin-ID", only(~first, own)),
            ("WARC-Segment-Total-Length", only(many & last, F.col("total"))),
            ("Content-Type", only(first, F.lit("application/http; msgtype=response"))), ("Content-Length", F.octet_length("part")),
        ),
        F.lit(_END), F.col("part"),
    )
    # A record ends in two line ends: the writer's separator.
    cut.select(record.alias("value")).write.option("lineSep", _END).option("compression", "gzip").option(
        "maxRecordsPerFile", 0
    ).text(path)


class _Stream:
    """Bytes of a gzip file, decompressed as they are asked for."""

    def __init__(self, data):
        self.rest, self.zip, self.have = memoryview(data), zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        while self.rest or self.zip.unconsumed_tail:
            if self.zip.eof:  # the next member
                self.zip = zlib.decompressobj(31)
            given = self.zip.unconsumed_tail or self.rest[:CHUNK]
            if not self.zip.unconsumed_tail:
                self.rest = self.rest[CHUNK:]
            new = self.zip.decompress(given, CHUNK)
            if self.zip.eof and self.zip.unused_data:
                left = len(self.zip.unused_data) + len(self.rest)
                self.rest = memoryview(self.zip.unused_data + bytes(self.rest))[-left:]
            self.have += new
            if new:
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What comes before the next ``mark``; None at the end of the file."""
        at = 0
        while (found := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark))
            if not self._more():
                if self.have.strip():
                    raise ValueError("archive ends within a record")
                return None
        out = bytes(self.have[:found])
        del self.have[: found + len(mark)]
        return out

    def pieces(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.have and not self._more():
                raise ValueError("archive ends within a record")
            out = bytes(self.have[: min(size, CHUNK)])
            del self.have[: len(out)]
            size -= len(out)
            yield out


def _records(data) -> Iterator[tuple]:
    """Chunk rows of a file; the state between two is a hash and a few numbers."""
    stream, open_ = _Stream(data), None
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not the start of a record")
        at = dict(line.split(": ", 1) for line in lines[1:])
        kind, size = at["WARC-Type"], int(at["Content-Length"])
        if kind == "continuation":
            if open_ is None or at["WARC-Segment-Origin-ID"] != open_["id"]:
                raise ValueError("a segment without its record")
        else:
            http = stream.until(b"\r\n\r\n")
            size -= len(http) + 4
            full = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
            open_ = {"id": at["WARC-Record-ID"], "kind": kind, "page": at.get("X-Page"), "to": at.get("X-Refers-To-Page"),
                     "said": at["WARC-Payload-Digest"].removeprefix("sha1:"), "full": full, "sha": hashlib.sha1(), "n": 0, "no": 0}
        ends = "WARC-Segment-Number" not in at or "WARC-Segment-Total-Length" in at
        left = size
        for piece in stream.pieces(size) if size else [b""]:
            left -= len(piece)
            open_["sha"].update(piece)
            open_["n"] += len(piece)
            yield _row(open_, piece, ends and not left)
            open_["no"] += 1
        stream.until(b"\r\n\r\n")


def _row(record: dict, piece: bytes, last: bool) -> tuple:
    so_far, n = record["sha"].hexdigest(), record["n"]
    if record["kind"] == "revisit":
        so_far, n = record["said"], record["full"]
    elif last and (so_far, n) != (record["said"], record["full"]):
        raise ValueError(f"payload of {record['id']} is damaged")
    page, to = (int(x) if x is not None else None for x in (record["page"], record["to"]))
    return record["id"], record["no"], page, record["kind"], to, n, so_far, last, piece


_FIELDS = [
    ("record_id", pa.string()), ("chunk_no", pa.int32()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("data", pa.binary()),
]
_CHUNKS = "record_id string, chunk_no int, page_id long, record_type string, refers_to long, bytes_so_far long, digest_so_far string, last boolean, data binary"


def read_chunks(spark: SparkSession, path: str, *, with_data: bool = True) -> DataFrame:
    """Rows (record_id, chunk_no) of an archive's payloads, with bytes and SHA-1 up to and with each chunk.

    A file is decompressed as it is read and a record is never held: a task holds the
    compressed file, a chunk, and a batch of rows.  The last chunk of a response must
    match its headers' length and digest, else the job fails.  A revisit has one
    row without data; its length and digest are those of the payload it stands for.
    ``with_data=False`` leaves the data null.
    """
    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for row in _records(batch.column(0)[i].as_buffer()):
                    held += len(row[-1]) + 200
                    rows.append(row if with_data else (*row[:-1], None))
                    if held > BATCH:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, _CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def round_trip(pages: DataFrame, path: str, **how) -> DataFrame:
    """Write ``pages``, read the archive back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A null payload is empty; a null url is an empty one.  A page without id is a
    record without it: it revisits the response of its payload, or is a response itself if no page
    of that payload has an id.  Rows that repeat the response's id and payload
    are responses, too.  An empty table gives no rows.  Other columns are not read.
    """
    write_archive(pages, path, **how)
    chunks = read_chunks(pages.sparkSession, path, with_data=False)
    return chunks.filter("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to"
    )
