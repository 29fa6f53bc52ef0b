"""WARC archives: writing, normalising and reading them back by offset.

`write` makes one gzip stream per file, as crawlers do that compress the whole file. `normalise` inflates each such
stream once, rewrites every record as a gzip member of its own, and writes a sidecar index beside the new file: a line
of JSON per record with the offset and length of its member. `read` takes records from there by their offsets. Files
with a member per record, and files that are not compressed, are normalised as well, in sub-folders too: a file keeps
its path below the folder, and two files that would get one name (`a.warc`, `a.warc.gz`) are refused. Streams are read,
inflated and written a megabyte at a time, whatever the size of the file or record; reading back holds one record, in
tasks of about eight megabytes of members.

A worker writes to a temporary name and then moves the file, so a task that runs again leaves an equal file.

Payload copies: of pages with equal payloads of at least 100 bytes, that with the smallest id is a `response`, the
others are `revisit` records that name it; a row with a null id comes last, and of rows with equal ids the first in
the input counts as the smallest. Null payloads are empty. Line ends in an address become spaces. No pages give no
archives and no records. Other columns play no part.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, batch_rows, local_fs, ship

END = b"\r\n\r\n"
LEAST_COPY = 100
PIECE = 1 << 20
#: Bytes of members that one task reads, about.
TASK_BYTES = 8 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = "file string, offset long, length long, record_id string, type string"


def records(pages: DataFrame, scratch: Scratch, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value): a WARC record per page as text, without the blank lines at its end."""
    body = F.coalesce(F.col(payload), F.lit(""))
    staged = scratch.stage(
        pages.select(
            F.col(key).alias("id"), F.col(url).alias("url"), body.alias("body"), F.monotonically_increasing_id().alias("row"),
            F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("bytes"),
        ),
        "pages",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    copied = scratch.stage(
        staged.where(F.col("bytes") >= LEAST_COPY).groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1").select("digest", "first"), "copied"
    )
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("first").isNotNull() & (F.col("first.row") != F.col("row"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, "body"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]+", " "),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), name(F.col("first.id")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"),
    )
    return staged.join(copied, "digest", "left").select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, folder: str, scratch: Scratch, **names: str) -> None:
    """Write the pages as archives of one gzip stream each."""
    records(pages, scratch, **names).write.option("compression", "gzip").option("lineSep", END.decode()).text(folder)


class _Inflated:
    """The bytes of a stream, inflated if it is gzip: one member, many, or none."""

    def __init__(self, stream):
        self.stream, self.held, self.at, self.zip, self.plain = stream, bytearray(), 0, None, None

    def _more(self) -> bool:
        """Add up to about a megabyte to what is held; what has been taken is dropped in large parts only."""
        if self.at > PIECE or self.at == len(self.held):
            del self.held[:self.at]
            self.at = 0
        own = self.zip
        raw = b"" if own is None else own.unused_data if own.eof else own.unconsumed_tail
        raw = raw or self.stream.read(PIECE)
        if self.plain is None:
            self.plain = raw[:2] != b"\x1f\x8b"
        if self.plain:
            self.held += raw
            return bool(raw)
        if own is None or own.eof:
            if not raw:
                return False
            own = self.zip = zlib.decompressobj(31)
        data = own.decompress(raw, PIECE)
        if not raw and not data and not own.eof:
            raise ValueError("the gzip stream ends early")
        self.held += data
        return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with a mark; None at the end of the stream."""
        seen = 0  # bytes from the place on that do not hold the mark
        while (found := self.held.find(mark, self.at + max(0, seen - len(mark)))) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                if self.held[self.at:].strip():
                    raise ValueError("the last record is cut off")
                return None
        return self._take(found + len(mark) - self.at)

    def _take(self, n: int) -> bytes:
        out = bytes(self.held[self.at:self.at + n])
        self.at += len(out)
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes, a piece at a time."""
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("a record is cut off")
            out = self._take(min(n, PIECE))
            n -= len(out)
            if out:
                yield out


def fields(head: bytes) -> dict[str, str]:
    """The header fields of a record, names in lower case."""
    lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def rewrite(source, target, level: int = 6) -> Iterator[dict]:
    """Copy the records of one stream, each as its own gzip member; yields the index row of each."""
    data, offset = _Inflated(source), 0
    while (head := data.until(END)) is not None:
        head = head.lstrip(b"\r\n")
        own = fields(head)
        member = zlib.compressobj(level, zlib.DEFLATED, 31)
        length = target_write(target, member.compress(head))
        for piece in data.pieces(int(own["content-length"])):
            length += target_write(target, member.compress(piece))
        if b"".join(data.pieces(4)) != END:
            raise ValueError("a record does not end where its length says")
        length += target_write(target, member.compress(END) + member.flush())
        yield {"offset": offset, "length": length, "record_id": own.get("warc-record-id"), "type": own.get("warc-type")}
        offset += length


def target_write(target, data: bytes) -> int:
    if data:
        target.write(data)
    return len(data)


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite all archives below `source` into `target`, with their indexes; the index as a table."""
    ship(spark)
    make = spark._jvm.org.apache.hadoop.fs.Path
    root = make(source)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    below = F.expr(f"substring(path, {len(root) + 2})")
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").option("recursiveFileLookup", True).load(source)
        .select("path", F.concat(F.regexp_replace(below, r"(\.warc)?(\.gz)?$", ""), F.lit(".warc.gz")).alias("name"))
    )
    twice = files.groupBy("name").agg(F.min("path").alias("one"), F.max("path").alias("other"), F.count("*").alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"two archives would be {twice['name']}: {twice['one']} and {twice['other']}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = local_fs(path)
                to, folder = local_fs(target)
                to.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
                kept = f"{folder}/_{uuid.uuid4().hex}"
                n = 0
                with store.open_input_stream(at, compression=None, buffer_size=PIECE) as stream, to.open_output_stream(kept, compression=None) as out, to.open_output_stream(f"{kept}.idx") as index:
                    for row in rewrite(stream, out):
                        index.write((json.dumps({"file": name} | row) + "\n").encode())
                        n += 1
                to.move(kept, f"{folder}/{name}")
                to.move(f"{kept}.idx", f"{folder}/{name}.idx.json")
                done.append((name, n))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["file", "n"])

    # one row per file comes back
    with batch_rows(spark, 1):
        n_files = files.count()
        done = files.repartition(max(1, n_files)).mapInArrow(work, "file string, n long").collect()
    if not done:
        return spark.createDataFrame([], _INDEX)
    return spark.read.schema(_INDEX).option("recursiveFileLookup", True).option("pathGlobFilter", "*.idx.json").json(target)


def read(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(record_id, type, refers_to, digest, http_length, payload binary) of the indexed records, read by offset."""
    ship(spark)
    total = index.agg(F.sum("length")).first()[0] or 0
    near = index.select("file", "offset", "length").repartitionByRange(1 + total // TASK_BYTES, "file", "offset").sortWithinPartitions("file", "offset")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = local_fs(folder)
        name, source, rows, held = None, None, [], 0
        for batch in batches:
            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{at}/{file}")
                source.seek(offset)
                data = zlib.decompress(source.read(length), 31)
                cut = data.index(END) + 4
                own = fields(data[:cut])
                block = data[cut:cut + int(own["content-length"])]
                http, _, payload = block.partition(END)
                stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                revisit = own.get("warc-type") == "revisit"
                rows.append((own.get("warc-record-id"), own.get("warc-type"), own.get("warc-refers-to"), own.get("warc-payload-digest"), stated, None if revisit else payload))
                held += len(payload)
                if held > 4 * PIECE or len(rows) >= 1000:
                    yield _as_batch(rows)
                    rows, held = [], 0
        if source is not None:
            source.close()
        if rows:
            yield _as_batch(rows)

    with batch_rows(spark, 10_000):
        return near.mapInArrow(work, "record_id string, type string, refers_to string, digest string, http_length long, payload binary")


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["record_id", "type", "refers_to", "digest", "http_length", "payload"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
