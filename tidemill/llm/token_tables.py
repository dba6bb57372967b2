"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their keys in blocks. Within a block a key is written as the
number of bytes it shares with the key before it and the rest; a block is packed by zstandard. Behind the
blocks stand a sparse index (first key, place and size of every block), a Bloom filter of all keys, and a
footer of fixed size, so that a reader finds one document by two short reads and a binary search.

    block   := zstd( entry* )      entry := shared u8, rest u8, n_tokens u32, rest bytes, ids
    index   := zstd( (key 9 bytes, offset u64, size u32, entries u32, tokens_before u64)* )
    footer  := magic 8 bytes, index offset u64, index size u32, bloom offset u64, bloom size u32,
               entries u64, tokens u64, bytes per id u8

All integers are little-endian; ids take two bytes if the vocabulary has fewer than 65,536, else four. A key
is a byte for "has an id" and the id's 8 bytes, biased and big-endian, so that keys sort as ids do.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import new_folder, written

MAGIC = b"TMSSTAB1"
BLOCK_BYTES = 128 * 1024
SHARD_BYTES = 128 * 1024 * 1024
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
PIECE_CACHE = 700_000
#: Words of letters that the library encodes in one text.
WORDS_AT_ONCE = 1000

_ENTRY, _INDEX, _FOOTER = struct.Struct("<BBI"), struct.Struct("<9sQIIQ"), struct.Struct("<8sQIQIQQB")


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def local_uri(folder: str) -> str:
    """Hadoop's ``file:/folder`` with the slashes that other libraries ask for."""
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", int(doc_id) + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes one shard; entries come in ascending order of their keys."""

    def __init__(self, stream, id_bytes: int):
        self.stream, self.id_bytes = stream, id_bytes
        self.packer = zstandard.ZstdCompressor(level=3)
        self.offset = self.tokens = self.block_tokens = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._start()

    def _start(self) -> None:
        self.block, self.first, self.last, self.entries = bytearray(), b"", b"", 0
        self.block_tokens = self.tokens

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: as many bytes per id as the shard has."""
        shared = 0
        if self.last:
            shared = next((i for i in range(9) if self.last[i] != key[i]), 9)
        else:
            self.first = key
        n = len(ids) // self.id_bytes
        self.block += _ENTRY.pack(shared, 9 - shared, n) + key[shared:] + ids
        self.last, self.entries, self.tokens = key, self.entries + 1, self.tokens + n
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            packed = self.packer.compress(bytes(self.block))
            self.stream.write(packed)
            self.index.append(_INDEX.pack(self.first, self.offset, len(packed), self.entries, self.block_tokens))
            self.offset += len(packed)
        self._start()

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BLOOM_BITS_PER_KEY)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = self.packer.compress(b"".join(self.index))
        tail = struct.pack("<Q", bits) + bytes(bloom)
        self.stream.write(index)
        self.stream.write(tail)
        at = self.offset
        self.stream.write(_FOOTER.pack(MAGIC, at, len(index), at + len(index), len(tail), len(self.keys), self.tokens, self.id_bytes))
        self.stream.close()


class ShardReader:
    """Reads a shard by ranges: footer and index at once, blocks as they are asked for."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.stream = system.open_input_file(path)
        size = self.stream.size()
        found = _FOOTER.unpack(self.stream.read_at(_FOOTER.size, size - _FOOTER.size))
        if found[0] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        _, at, n, self.bloom_at, self.bloom_size, self.entries, self.tokens, self.id_bytes = found
        self.unpacker = zstandard.ZstdDecompressor()
        self.index = list(_INDEX.iter_unpack(self.unpacker.decompress(self.stream.read_at(n, at))))
        self.bloom: tuple[int, bytes] | None = None

    def block(self, number: int) -> Iterator[tuple[bytes, int, bytes]]:
        """key, tokens of the shard before it, and ids of each entry."""
        _, offset, size, entries, before = self.index[number]
        raw = self.unpacker.decompress(self.stream.read_at(size, offset))
        at, key = 0, b""
        for _ in range(entries):
            shared, rest, n = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            ids = raw[at : at + n * self.id_bytes]
            at += n * self.id_bytes
            yield key, before, ids
            before += n

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        for number in range(len(self.index)):
            yield from self.block(number)

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            raw = self.stream.read_at(self.bloom_size, self.bloom_at)
            self.bloom = struct.unpack_from("<Q", raw)[0], raw[8:]
        bits, bloom = self.bloom
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, bits))

    def look_up(self, key: bytes) -> list[np.ndarray]:
        """The ids of all entries with the key, by Bloom filter, binary search and as few blocks as hold it."""
        if not self.index or not self.may_hold(key):
            return []
        found, firsts = [], [x[0] for x in self.index]
        number = max(bisect_right(firsts, key) - 1, 0)
        while number > 0 and firsts[number] == key:  # a repeated key may begin in the block before
            number -= 1
        while number < len(firsts) and firsts[number] <= key:
            found += [as_ids(ids, self.id_bytes) for k, _, ids in self.block(number) if k == key]
            number += 1
        return found


def as_ids(raw: bytes, id_bytes: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if id_bytes == 2 else "<u4").astype("<u4")


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _word_ends(path: str) -> np.ndarray | None:
    """Which ids mark the end of a word; None where the vocabulary has no such mark."""
    mark = getattr(_tokenizer(path).model, "end_of_word_suffix", None)
    if not mark:
        return None
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
    return ends


# the tokenizer's own split for lower-case Latin-1, which its normaliser leaves as it is
_LETTERS, _NUMBERS, _BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+")


def parts_of(piece: str) -> list[str]:
    """What the tokenizer encodes separately in a piece of text; the whole piece if it is not Latin-1."""
    try:
        piece.encode("latin-1")
    except UnicodeEncodeError:
        return [piece]
    return [piece] if "<|" in piece else _LATIN_PARTS.findall(piece.lower())


# letters of which the tokenizer makes one word
_LATIN_WORD = re.compile(f"[{_LETTERS}]+")
_PARTS_OR_BLANK = re.compile(f"{_LATIN_PARTS.pattern}| ")


def all_parts(pieces: list[str]) -> dict[str, list[str]]:
    """parts_of each of different pieces without blanks; those of ASCII are split together."""
    plain = [p for p in pieces if p.isascii() and "<|" not in p]
    found, out, a = _PARTS_OR_BLANK.findall(" ".join([*plain, ""]).lower()), {}, 0
    for piece, b in zip(plain, [i for i, x in enumerate(found) if x == " "], strict=True):
        out[piece], a = found[a:b], b + 1
    return out | {p: parts_of(p) for p in pieces if p not in out}


class PieceEncoder:
    """Encodes whole texts by pieces between blanks.

    The word tokenizer normalises and splits without looking across a blank, drops white space and merges
    within words only, so a text's ids are those of its pieces in turn, and a piece's those of its words and
    marks. The library encodes each of them that this worker hasn't met lately; caches are emptied when they
    have grown to their bound.

    Words of Latin letters are encoded many in a text where the vocabulary marks the ends of words: such a
    word has one token at most with the mark, its last, so that as many marks as words tell all words apart.
    """

    def __init__(self, path: str, id_bytes: int):
        self.path, self.kind, self.known, self.parts = path, "<u2" if id_bytes == 2 else "<u4", {}, {}
        self.ends = _word_ends(path)

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array([t or "" for t in texts], pa.string()), " ")
        coded, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy().tolist()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        for cache in (self.known, self.parts):
            if len(cache) > PIECE_CACHE:
                cache.clear()
        known, parts = self.known, self.parts
        held = list(map(known.get, pieces))
        fresh = all_parts([p for p, ids in zip(pieces, held) if ids is None])
        words = set(chain.from_iterable(fresh.values())).difference(parts)
        self._encode_plain([w for w in words if _LATIN_WORD.fullmatch(w)] if self.ends is not None else [])
        self._encode([w for w in words if w not in parts])
        for piece, found in fresh.items():
            known[piece] = parts[found[0]] if len(found) == 1 else b"".join(map(parts.__getitem__, found))
        raws = [known[p] if ids is None else ids for p, ids in zip(pieces, held)]
        which = coded.indices.to_numpy().tolist()
        return [b"".join(map(raws.__getitem__, which[a:b])) for a, b in zip(bounds, bounds[1:])]

    def _encode(self, words: list[str]) -> None:
        for a in range(0, len(words), 20_000):
            some = words[a : a + 20_000]
            for word, e in zip(some, _tokenizer(self.path).encode_batch_fast(some, add_special_tokens=False)):
                self.parts[word] = np.array(e.ids, dtype=self.kind).tobytes()

    def _encode_plain(self, words: list[str]) -> None:
        lots = [words[a : a + WORDS_AT_ONCE] for a in range(0, len(words), WORDS_AT_ONCE)]
        for lot, e in zip(lots, _tokenizer(self.path).encode_batch_fast([" ".join(lot) for lot in lots], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(lot) or cuts[-1] != len(ids):
                self._encode(lot)
                continue
            raw, cuts = ids.tobytes(), [0, *(cuts * ids.itemsize).tolist()]
            self.parts.update(zip(lot, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))


@lru_cache(maxsize=2)
def _piece_encoder(path: str, id_bytes: int) -> PieceEncoder:
    return PieceEncoder(path, id_bytes)


def write_tables(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 1,
    id_bytes: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = SHARD_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """Encodes every whole text, appends end_id, and writes shards; returns the manifest, one row a shard.

    Documents are dealt out by ranges of ids (nulls first; equal ids in the order of their texts), so that
    the order of shards is the order of ids. Null and empty texts have the end id alone. Other columns are
    not read. Files have names of their own for each attempt of a task; only those of the manifest count.
    """
    spark = docs.sparkSession
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(folder)
    )
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = F.col("id").asc_nulls_first()
    sorted_docs = plain.repartitionByRange(partitions, order).sortWithinPartitions(order, "text")
    target, kind = local_uri(folder), "<u2" if id_bytes == 2 else "<u4"
    end = np.array([end_id], dtype=kind).tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, out, first = TaskContext.get().partitionId(), 0, None, None
        system, path = open_fs(target)
        encode = _piece_encoder(tokenizer_path, id_bytes)

        def closed() -> pd.DataFrame:
            out.close()
            row = {"part": part, "number": number, "path": name, "first_id": id_of(first), "entries": len(out.keys), "tokens": out.tokens}
            return pd.DataFrame([row]).astype({"first_id": "Int64"})

        for batch in batches:
            nulls = batch["id"].isna().to_numpy()
            ids, texts = batch["id"].fillna(0).astype("int64").tolist(), batch["text"].tolist()
            for a in range(0, len(texts), 500):
                for i, raw in zip(range(a, a + 500), encode(texts[a : a + 500])):
                    key = key_of(None if nulls[i] else ids[i])
                    if out is None:
                        name, first = f"{target}/{part:06d}-{number:04d}-{uuid.uuid4().hex}.sst", key
                        out = ShardWriter(system.open_output_stream(f"{path}/{name.rpartition('/')[2]}"), id_bytes)
                    out.add(key, raw + end)
                    if out.offset >= shard_bytes:
                        yield closed()
                        out, number = None, number + 1
        if out is not None:
            yield closed()

    manifest = sorted_docs.mapInPandas(
        write, "part int, number int, path string, first_id long, entries long, tokens long"
    )
    return written(manifest, "sst-manifest")


def read_tables(manifest: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document of the shards: doc_id, start (ids of all documents before it), n_tokens and ids."""
    # the manifest has one short row for each shard of some hundred MB
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("base"))
    placed = placed.repartition(partitions or int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                shard = ShardReader(path)
                for number in range(len(shard.index)):
                    rows = [(id_of(k), base + b, as_ids(x, shard.id_bytes).tobytes()) for k, b, x in shard.block(number)]
                    out = pd.DataFrame(rows, columns=["doc_id", "start", "ids"])
                    out["doc_id"] = out["doc_id"].astype("Int64")
                    out["n_tokens"] = [len(x) // 4 for x in out["ids"]]
                    yield out[["doc_id", "start", "n_tokens", "ids"]]

    return placed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def find(manifest: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of the wanted ids that are there, by range of shard, Bloom filter and binary search."""
    spans = Window.orderBy("part", "number")
    following = F.lead(F.struct("first_id")).over(spans)
    shards = manifest.select("path", F.col("first_id").alias("lo"), following.alias("next")).select("path", "lo", "next.first_id", "next")
    # nulls come first: a shard that begins with one may go on with the smallest ids, unless the next begins with one too
    shards = shards.where("lo is not null or next is null or first_id is not null").withColumnRenamed("first_id", "hi").drop("next")
    asked = wanted.select(F.col(id_col).cast("bigint").alias("id")).where("id is not null").distinct()
    hit = asked.join(F.broadcast(shards), (F.col("lo").isNull() | (F.col("id") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("id") <= F.col("hi"))))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, group in batch.groupby("path"):
                shard = ShardReader(path)
                rows += [(i, x.tobytes()) for i in group["id"] for x in shard.look_up(key_of(i))]
            yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    return hit.select("id", "path").repartition("path").mapInPandas(look, "doc_id long, ids binary")


def crc32_of(ids: Column) -> Column:
    return F.crc32(ids)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards to the shared folder, reads them back and gives doc_id, start, n_tokens, ids_crc32."""
    manifest = write_tables(docs, tokenizer_path, new_folder(spark, "sst"), id_col=id_col, text_col=text_col)
    return read_tables(manifest).select("doc_id", "start", "n_tokens", crc32_of(F.col("ids")).alias("ids_crc32"))


def checksum(ids: bytes) -> int:
    """What ids_crc32 holds, for a reader without Spark."""
    return zlib.crc32(ids)
