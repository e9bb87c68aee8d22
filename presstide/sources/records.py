"""Capture records out of archive files.

Spark plans and spreads the work: one row per file or per byte range. Inside
a task a small reader opens the file where it lies (local, HDFS or an object
store), unpacks record after record and hands them on in small batches, so
memory stays at a few records however large the file is.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

RECORD_SCHEMA = (
    "source string, position bigint, rec_type string, statusline string, content_type string, "
    "url string, accessed_at string, html string, error string"
)
BATCH_RECORDS = 64
CHUNK = 1 << 20


def _open(path: str):
    """A seekable input stream for any URI the platform knows."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    uri = path.replace("file:///", "/", 1).replace("file:/", "/", 1) if path.startswith("file:") else path
    filesystem, inner = fs.FileSystem.from_uri(uri)
    return filesystem.open_input_file(inner)


def _create(path: str):
    """A fresh output stream, its folder made where the store has folders."""
    from pyarrow import fs

    if "://" in path:
        filesystem, inner = fs.FileSystem.from_uri(path)
    else:
        filesystem, inner = fs.LocalFileSystem(), path.replace("file:", "", 1)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return filesystem.open_output_stream(inner, compression=None)


def _members(stream) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, unpacked bytes, error) of each gzip member, streamed.

    After a damaged member the next header is searched for from the byte after
    its own start, so a member cut short does not hide the ones that its data
    ran into.
    """
    origin = stream.tell()
    buffer, base, unpack, start, out = b"", 0, None, 0, []

    def again():
        stream.seek(origin + start + 1)
        return b"", start + 1, None

    while True:
        if not buffer:
            buffer = stream.read(CHUNK)
            if not buffer and unpack is None:
                break
            if not buffer:
                yield start, None, "bad gzip member: truncated"
                buffer, base, unpack = again()
                continue
        if unpack is None:
            at = buffer.find(b"\x1f\x8b\x08")
            if at < 0:
                # The next header may begin in the last two bytes.
                keep = buffer[-2:]
                base, buffer = base + len(buffer) - len(keep), keep
                more = stream.read(CHUNK)
                if not more:
                    break
                buffer += more
                continue
            base, buffer = base + at, buffer[at:]
            unpack, start, out = zlib.decompressobj(wbits=31), base, []
        try:
            out.append(unpack.decompress(buffer))
        except zlib.error as e:
            yield start, None, f"bad gzip member: {e}"
            buffer, base, unpack = again()
            continue
        if unpack.eof:
            base += len(buffer) - len(unpack.unused_data)
            buffer = unpack.unused_data
            yield start, b"".join(out), None
            unpack = None
        else:
            base, buffer = base + len(buffer), b""


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, sep, value = line.decode("utf-8", "replace").partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def _split_head(data: bytes) -> tuple[list[bytes], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    return head.split(b"\r\n"), body


def parse_record(data: bytes) -> dict[str, str | None]:
    """One unpacked record, either archive dialect, to its columns."""
    if data.startswith(b"WARC/"):
        lines, rest = _split_head(data)
        meta = _headers(lines[1:])
        length = meta.get("content-length", "")
        payload = rest[: int(length)] if length.isdigit() else rest
        rec_type = meta.get("warc-type")
        url, when = meta.get("warc-target-uri"), meta.get("warc-date")
    else:
        line, _, rest = data.lstrip(b"\r\n").partition(b"\n")
        f = line.decode("utf-8", "replace").split(" ")
        if len(f) < 5 or len(f[2]) != 14 or not f[2].isdigit():
            raise ValueError("not a record")
        url, when = f[0], f[2]
        when = f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:]}Z"
        payload = rest[: int(f[4])] if f[4].isdigit() else rest
        rec_type = "warcinfo" if url.startswith("filedesc:") else "response"
    record = dict.fromkeys(("statusline", "content_type", "html"))
    if rec_type in ("response", "request"):
        lines, body = _split_head(payload)
        record["statusline"] = lines[0].decode("utf-8", "replace").partition(" ")[2]
        record["content_type"] = _headers(lines[1:]).get("content-type")
    else:
        body = payload
    record["html"] = body.decode("utf-8", "replace")
    return {**record, "rec_type": rec_type, "url": url, "accessed_at": when}


def _rows(source: str, stream, origin: int = 0) -> Iterator[dict]:
    for offset, data, error in _members(stream):
        row = dict.fromkeys(
            ("rec_type", "statusline", "content_type", "url", "accessed_at", "html", "error")
        )
        row.update(source=source, position=origin + offset, error=error)
        if error is None:
            try:
                row.update(parse_record(data))
            except ValueError as e:
                row["error"] = f"bad record: {e}"
        yield row


def _frames(rows: Iterator[dict]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    batch: list[dict] = []
    for row in rows:
        batch.append(row)
        if len(batch) >= BATCH_RECORDS:
            yield pd.DataFrame(batch, columns=names)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=names)


def decode_members(df: DataFrame, source_col: str, member_col: str) -> DataFrame:
    """Records out of a column of packed bytes, one or more members each.

    A damaged member gives a row with ``error`` set, not a failed task.
    """

    def run(frames):
        for pdf in frames:
            members = zip(pdf["source"], pdf["member"])
            yield from _frames(row for source, data in members for row in _rows(source, io.BytesIO(data)))

    picked = df.select(F.col(source_col).cast("string").alias("source"), F.col(member_col).alias("member"))
    return picked.mapInPandas(run, RECORD_SCHEMA)


def read_archives(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All records of whole archive files.

    The file list is a scan without contents; each file is then streamed by
    one task, and the tasks take files in any order.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return stream_archives(files.repartition(partitions, "path") if partitions else files)


def stream_archives(files: DataFrame) -> DataFrame:
    def run(frames):
        for pdf in frames:
            for source in pdf["path"]:
                with _open(source) as stream:
                    yield from _frames(_rows(source, stream))

    return files.select("path").mapInPandas(run, RECORD_SCHEMA)


def _ranges(pdf, file_col, root):
    """Bytes of each planned range, a file kept open while rows stay in it."""
    stream, current = None, None
    try:
        for name, start, length in zip(pdf[file_col], pdf["offset"], pdf["length"]):
            if name != current:
                if stream is not None:
                    stream.close()
                stream, current = _open(f"{root}/{name}" if root else name), name
            stream.seek(int(start))
            yield name, int(start), stream.read(int(length))
    finally:
        if stream is not None:
            stream.close()


def fetch_records(plan: DataFrame, root: str = "") -> DataFrame:
    """Records at the byte ranges of a fetch plan (filename, offset, length)."""

    def run(frames):
        for pdf in frames:
            def rows():
                for name, start, data in _ranges(pdf, "filename", root):
                    yield from _rows(name, io.BytesIO(data), start)

            yield from _frames(rows())

    return plan.select("filename", "offset", "length").mapInPandas(run, RECORD_SCHEMA)


def write_members(df: DataFrame, key_col: str, member_col: str, root: str) -> DataFrame:
    """Append packed members to archive files, one per task: (key, filename, offset, length).

    File names carry the attempt, and only the returned rows name valid files,
    so a task that is lost and run again leaves nothing that is read. Store
    the result before using it twice: evaluating it writes the files.
    """

    def run(frames):
        import uuid

        name, offset = f"part-{uuid.uuid4().hex}.warc.gz", 0
        out = None
        try:
            for pdf in frames:
                rows = []
                for key, data in zip(pdf["key"], pdf["member"]):
                    out = out or _create(f"{root}/{name}")
                    out.write(data)
                    rows.append((key, name, offset, len(data)))
                    offset += len(data)
                yield pd.DataFrame(rows, columns=["key", "filename", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    picked = df.select(F.col(key_col).cast("string").alias("key"), F.col(member_col).alias("member"))
    return picked.mapInPandas(run, "key string, filename string, offset bigint, length bigint")


def read_blocks(blocks: DataFrame, prefix: str, root: str = "") -> DataFrame:
    """Index lines starting with ``prefix`` out of packed index blocks: value, error.

    A damaged block gives a row with ``error`` and no value.
    """
    rest = [f for f in blocks.schema.fields if f.name == "crawl"]
    schema = "".join(f"{f.name} string, " for f in rest) + "value string, error string"

    def run(frames):
        for pdf in frames:
            crawls = list(pdf["crawl"]) if rest else [None] * len(pdf)
            for crawl, (_, _, data) in zip(crawls, _ranges(pdf, "file", root)):
                for _, unpacked, error in _members(io.BytesIO(data)):
                    lines = [None] if error else unpacked.decode("utf-8", "replace").split("\n")
                    out = pd.DataFrame({"value": lines, "error": [error] * len(lines)})
                    if rest:
                        out.insert(0, "crawl", crawl)
                    yield out

    picked = blocks.select(*[f.name for f in rest], "file", "offset", "length")
    return picked.mapInPandas(run, schema).filter(F.col("value").startswith(prefix) | F.col("error").isNotNull())


def is_page() -> Column:
    """Successful responses whose type is text or HTML, or not given."""
    kind = F.coalesce("content_type", F.lit(""))
    return (
        (F.col("rec_type") == "response")
        & F.col("statusline").startswith("2")
        & (kind.contains("html") | kind.contains("text") | (kind == ""))
    )
