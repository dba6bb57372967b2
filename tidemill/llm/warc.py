"""WARC archives with a two-level capture index.

Pages become gzip-compressed WARC records, one gzip member each. Of records with equal payloads one is the
response, the others are revisits of it. Captures are sorted by the URL with its host reversed
(``http://a.example.com/x`` sorts as ``com,example,a)/x``) and written in compressed blocks of index lines;
behind the blocks of each index file stands a sparse directory of their first keys. A look-up takes the
index file by its range of keys, finds the block by binary search in the directory, reads that block, and
then reads the record's own range of bytes from the archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import new_folder, written
from tidemill.llm.token_tables import local_uri, open_fs

FILE_BYTES = 256 * 1024 * 1024
BLOCK_LINES = 1000
#: Repeated payloads that are broadcast, and index files whose ranges are (one for each task that writes the index).
MOST_HOT = 10_000
MOST_FILES = 1_000_000
_FOOTER = struct.Struct("<8sQI")
_MAGIC = b"TMCDXIX1"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
RECORD_DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query. Empty for null."""
    if url is None:
        return ""
    m = re.match(r"(?s)(?:[^:/?#]*://)?([^/?#]*)([^#]*)", url)
    host = m[1].rpartition("@")[2].lower()
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (":" + port if port else "") + ")" + (m[2] or "/")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member. A revisit has the HTTP header but no payload."""
    digest = payload_digest(payload)
    block = _HTTP if refers_to is not None else _HTTP + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {RECORD_DATE}",
        *([] if url is None else ["WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)]),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([] if page_id is None else [f"X-Page-Id: {page_id}"]),
    ]
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=5, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    data = zlib.decompress(raw, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """id, url, html and refers_to (null for responses)."""
    plain = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    marked = plain.withColumn("digest", F.sha1("html"))
    # summed per task before the shuffle: a payload that fills a third of the table is one row of each task
    firsts = marked.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = written(firsts.where("n > 1"), "warc-repeated")
    # payloads that hold at least one in 10,000 of the repeated rows: at most 10,000 of them, so they may be broadcast;
    # in the join by digest each of their pages goes with a key of its own that meets nothing, so tasks share them
    least = max(1000, -(-(firsts.agg(F.sum("n")).first()[0] or 0) // MOST_HOT))
    hot = firsts.where(F.col("n") >= least).select(F.col("digest").alias("hot_digest"), F.col("first").alias("hot_first"))
    rest = firsts.where(F.col("n") < least).select(F.col("digest").alias("key"), "first")
    spread = marked.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    own = F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))
    spread = spread.withColumn("key", F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(own))
    joined = spread.join(rest, "key", "left").withColumn("first", F.coalesce("first", "hot_first"))
    other = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    return joined.select("id", "url", "html", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    file_bytes: int = FILE_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """Writes archives and their index; returns the manifest, one row an index file.

    Payloads are whole html texts in UTF-8, null as empty. Of the records with equal payloads of at least
    least_bytes bytes, those with the smallest id are responses and all others (null ids too) revisits;
    if none has an id all are responses. Null URLs sort first. Other columns are not read. Files have names
    of their own for each attempt of a task; only those that the manifest leads to count.
    """
    spark = pages.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
    target = local_uri(folder)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = open_fs(target)
        stream, offset, name = None, 0, ""
        for batch in batches:
            rows = []
            known, refers = batch["id"].notna().to_numpy(), batch["refers_to"].notna().to_numpy()
            ids, firsts = batch["id"].fillna(0).astype("int64").tolist(), batch["refers_to"].fillna(0).astype("int64").tolist()
            for r, (url, html) in enumerate(zip(batch["url"], batch["html"])):
                if stream is None or offset >= file_bytes:
                    if stream is not None:
                        stream.close()
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    stream, offset = system.open_output_stream(f"{path}/{name}", compression=None), 0
                url = url if isinstance(url, str) else None
                page = ids[r] if known[r] else None
                raw = make_record(page, url, html.encode("utf-8", "surrogatepass"), firsts[r] if refers[r] else None)
                stream.write(raw)
                rows.append((surt(url), f"{target}/{name}", offset, len(raw)))
                offset += len(raw)
            yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])
        if stream is not None:
            stream.close()

    marked = with_revisits(pages, id_col, url_col, html_col, least_bytes)
    captures = written(marked.mapInPandas(write, "key string, file string, offset long, length int"), "warc-captures")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        system, path = open_fs(target)
        stream, offset, directory, lines, name, last = None, 0, [], [], "", ""

        def flush() -> int:
            raw = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), 6)
            directory.append([lines[0][0], offset, len(raw)])
            stream.write(raw)
            return offset + len(raw)

        for batch in batches:
            for row in zip(batch["key"], batch["file"], batch["offset"].tolist(), batch["length"].tolist()):
                if stream is None:
                    name = f"{uuid.uuid4().hex}.cdx"
                    stream = system.open_output_stream(f"{path}/{name}", compression=None)
                lines.append(row)
                last = row[0]
                if len(lines) >= BLOCK_LINES:
                    offset = flush()
                    lines = []
        if stream is not None:
            if lines:
                offset = flush()
            raw = zlib.compress(json.dumps(directory).encode(), 6)
            stream.write(raw + directory_footer(offset, len(raw)))
            stream.close()
            row = (TaskContext.get().partitionId(), f"{target}/{name}", directory[0][0], last)
            yield pd.DataFrame([row], columns=["part", "path", "first_key", "last_key"])

    # file and offset among the sort keys: captures of one URL may fill many ranges
    ranged = captures.repartitionByRange(partitions, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ranged.mapInPandas(index, "part int, path string, first_key string, last_key string"), "warc-manifest")


def directory_footer(offset: int, size: int) -> bytes:
    return _FOOTER.pack(_MAGIC, offset, size)


class IndexFile:
    """The blocks of one index file, found by binary search in its directory."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.stream = system.open_input_file(path)
        size = self.stream.size()
        magic, at, n = _FOOTER.unpack(self.stream.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{uri} is no capture index")
        self.directory = json.loads(zlib.decompress(self.stream.read_at(n, at)))
        self.first_keys = [d[0] for d in self.directory]
        self.held: tuple[int, list[list], list[str]] = (-1, [], [])

    def block(self, number: int) -> list[list]:
        _, offset, size = self.directory[number]
        return [json.loads(x) for x in zlib.decompress(self.stream.read_at(size, offset)).decode().split("\n")]

    def look_up(self, key: str) -> list[list]:
        number = max(bisect_left(self.first_keys, key) - 1, 0)
        found: list[list] = []
        while number < len(self.directory) and self.first_keys[number] <= key:
            # keys that are asked in order find their block in memory
            if self.held[0] != number:
                lines = self.block(number)
                self.held = number, lines, [line[0] for line in lines]
            _, lines, keys = self.held
            found += lines[bisect_left(keys, key) : bisect_right(keys, key)]
            number += 1
        return found


def captures_of(manifest: DataFrame) -> DataFrame:
    """All index lines: key, file, offset and length."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                index = IndexFile(path)
                for number in range(len(index.directory)):
                    yield pd.DataFrame(index.block(number), columns=["key", "file", "offset", "length"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(n, "path").mapInPandas(lines, "key string, file string, offset long, length int")


_ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def fetch(captures: DataFrame) -> DataFrame:
    """The records of index lines, by range reads: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and payload (null for revisits)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            for a in range(0, len(batch), 500):
                rows = []
                for file, offset, length in zip(*(batch[c][a : a + 500] for c in ("file", "offset", "length"))):
                    if opened[0] != file:
                        system, path = open_fs(file)
                        opened = file, system.open_input_file(path)
                    h, payload = parse_record(opened[1].read_at(int(length), int(offset)))
                    as_id = lambda x: None if x is None else int(x)
                    if h["WARC-Type"] == "response" and payload_digest(payload) != h["WARC-Payload-Digest"][5:]:
                        raise ValueError(f"damaged record in {file} at {offset}")
                    rows.append(
                        (as_id(h.get("X-Page-Id")), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"][5:],
                         h["WARC-Type"], as_id(h.get("X-Refers-To-Page-Id")), payload if h["WARC-Type"] == "response" else None)
                    )
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # neighbours in a file stay together, and a large file is cut into several tasks
    return captures.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInPandas(read, _ROW)


def look_up(manifest: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of some URLs, with key, file, offset and length.

    Equal URLs, and URLs with one key, are asked once; a null URL asks for the empty key. A key that fills
    several index files is asked in each of them.
    """
    spark = manifest.sparkSession
    # one row an index file, of which write_archives makes one a task
    files = sorted((r["first_key"], r["last_key"], r["path"]) for r in manifest.select("first_key", "last_key", "path").limit(MOST_FILES + 1).collect())
    if len(files) > MOST_FILES:
        raise ValueError(f"the manifest names more than {MOST_FILES} index files")
    shared = spark.sparkContext.broadcast(files)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, ends = [f[0] for f in shared.value], [f[1] for f in shared.value]
        for batch in batches:
            keys = {surt(u if isinstance(u, str) else None) for u in batch["url"]}
            # files are ranges in order: those of a key lie side by side
            at = [(k, shared.value[i][2]) for k in keys for i in range(bisect_left(ends, k), bisect_right(starts, k))]
            yield pd.DataFrame(at, columns=["key", "path"])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, index = "", None
        for batch in batches:
            found = []
            for asked, key in zip(batch["path"], batch["key"]):
                if asked != path:
                    path, index = asked, IndexFile(asked)
                found += index.look_up(key)
                if len(found) > 10_000:
                    yield pd.DataFrame(found, columns=["key", "file", "offset", "length"])
                    found = []
            yield pd.DataFrame(found, columns=["key", "file", "offset", "length"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = urls.select(F.col(url_col).alias("url")).distinct().mapInPandas(assign, "key string, path string").distinct()
    ordered = asked.repartitionByRange(n, "path", "key").sortWithinPartitions("path", "key")
    return ordered.mapInPandas(look, "key string, file string, offset long, length int")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes archives to the shared folder, looks every URL of the pages up in their index, reads the records
    that it finds and gives a row for each page."""
    manifest = write_archives(pages, new_folder(spark, "warc"))
    return fetch(look_up(manifest, pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
