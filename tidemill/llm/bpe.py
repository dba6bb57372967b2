"""Byte-level BPE encoding and decoding around one global shuffle of distinct words.

Texts are cut into words before every blank that follows something other than white space. No pre-token
reaches across such a cut, so each word can be encoded by itself. Three passes:

1. Words are counted over all texts. The most frequent ones, which would be the hot keys of a shuffle, are
   encoded and broadcast: HOT_WORDS words of HOT_LENGTH characters at most, whatever the corpus.
2. Every text is cut once. Its broadcast words are numbers already; its other words leave as (slice,
   position, word), a slice being some MB of neighbouring texts. They are dealt out and sorted by word, each
   distinct word is encoded once, and its ids go back to the slices.
3. Slices meet the ids of their words and put them together by position.

Decoding explodes ids with their positions, joins the table of token bytes (as large as the vocabulary) and
puts the bytes of each text together by position.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import released, written

#: At most so many words, of at most HOT_LENGTH characters each, are broadcast.
HOT_WORDS = 400_000
HOT_LENGTH = 40
#: Only words that one task has met so often can be hot. Any word above a share s of all words has this share in some task.
HOT_IN_TASK = 3
#: A task hands on its counts when it holds so many distinct words.
TASK_WORDS = 400_000
#: Texts are worked on in slices of so many bytes, and at least one text.
SLICE_BYTES = 8 << 20
#: Words of a slice whose ids are put together at once.
SLICE_WORDS = 300_000
#: Texts are decoded in lots of so many ids, and at least one text.
LOT_IDS = 1 << 20

# everything that any of the libraries takes for white space, followed by a blank
_UNSAFE = "[\t-\r\x1c-\x20\x85\xa0  -     　] "
_SAFE_BLANK = re.compile(r"(?<=\S) ")


def words_of(text: str | None) -> list[str]:
    """The words of a text; joined they give the text again. Null and empty texts have none."""
    if not text:
        return []
    cuts = [0, *[m.start() for m in _SAFE_BLANK.finditer(text)], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words that occur in the texts, the number of each word in turn, and how many words each text has.

    A word may have two numbers. Nulls count as empty, and an empty text may have an empty word.
    """
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
    pieces = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    flat, sizes = pieces.flatten(), pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    later, begin = flat.dictionary_encode(), np.cumsum(sizes) - sizes
    first = flat.take(pa.array(begin)).dictionary_encode()
    plain = np.array(later.indices, dtype=np.int32)
    plain[begin] = np.array(first.indices) + len(later.dictionary)

    others = [words_of(t) for t in texts.filter(pa.array(odd)).to_pylist()]
    rest = pa.array([w for words in others for w in words], pa.string()).dictionary_encode()
    vocabulary = pa.concat_arrays([pc.binary_join_element_wise("", later.dictionary, " "), first.dictionary, rest.dictionary])
    counts = np.zeros(len(texts), np.int64)
    counts[~odd], counts[odd] = sizes, [len(words) for words in others]
    numbers, of_odd = np.empty(counts.sum(), np.int32), np.repeat(odd, counts)
    numbers[~of_odd] = plain
    numbers[of_odd] = np.array(rest.indices, dtype=np.int32) + (len(later.dictionary) + len(first.dictionary))
    return vocabulary, numbers, counts


def _slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers by significance of their bytes, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _joined(words: pa.Array) -> bytes:
    """Words with their lengths before them."""
    sizes = pc.binary_length(words).to_numpy().astype("<u4")
    return struct.pack("<I", len(words)) + sizes.tobytes() + "".join(words.to_pylist()).encode()


def _parted(raw: bytes) -> pa.Array:
    (n,) = struct.unpack_from("<I", raw)
    ends = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", n, 4)))).astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[4 + 4 * n :]))


def _laid_out(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all members of runs, run by run."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: a token in base64 and its id on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def word_counts(docs: DataFrame, least: int = HOT_IN_TASK) -> DataFrame:
    """word and n, its occurrences in those tasks that have met it ``least`` times; covers all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            table = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            return table.rename_columns(["word", "n"])

        for batch in _slices(batches, SLICE_BYTES // 8):
            vocabulary, numbers, _ = cut(batch.column("text"))
            n = np.bincount(numbers, minlength=len(vocabulary))
            held.append(pa.table({"word": vocabulary.filter(pa.array(n > 0)), "n": n[n > 0]}))
            size += len(held[-1])
            if size > 2 * TASK_WORDS:
                held = [summed()]
                size = len(held[0])
                if size > TASK_WORDS:
                    yield from held.pop().filter(pc.field("n") >= least).to_batches()
                    size = 0
            pa.default_memory_pool().release_unused()
        if held:
            yield from summed().filter(pc.field("n") >= least).to_batches()
        held.clear()
        pa.default_memory_pool().release_unused()

    found = docs.select("text").mapInArrow(released(counted), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int = HOT_WORDS) -> DataFrame:
    """The words at or above the lowest power of two of occurrences that at most ``most`` words reach."""
    short = counts.where(F.length("word") <= HOT_LENGTH)
    sizes = short.groupBy(F.floor(F.log2(F.col("n") + 0.5)).alias("b")).agg(F.count("*").alias("k")).collect()
    total, floor = 0, None
    for r in sorted(sizes, key=lambda r: -r["b"]):
        total += r["k"]
        if total > most:
            break
        floor = r["b"]
    return short.where(F.col("n") >= (1 << floor)) if floor is not None else short.limit(0)


def _encoded_words(words: DataFrame, path: str, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A bounded table of words on the driver: words, numbers of ids, and all ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern).encode_ordinary
        for batch in batches:
            ids = [encode(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    found = words.orderBy(F.desc("n"), "word").select("word").mapInArrow(released(encoded), "word string, ids array<int>").toArrow().combine_chunks()
    if not len(found):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int32)
    ids = found.column("ids").combine_chunks()
    return found.column("word").combine_chunks(), pc.list_value_length(ids).to_numpy().astype(np.int64), ids.flatten().to_numpy()


def _filled_slices(
    docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, hot_words: int
) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """The slices with the ids of their words, and what makes of their batches such of id, ids and ids_bytes of each text."""
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = written(word_counts(plain), "bpe-counts")
    hot = docs.sparkSession.sparkContext.broadcast(_encoded_words(frequent_words(counts, hot_words), path, pattern))
    kind = plain.schema["id"].dataType.simpleString()

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = hot.value[0], TaskContext.get().partitionId()
        for number, batch in enumerate(_slices(batches)):
            texts, ids = batch.column("text"), batch.column("id")
            vocabulary, at, counts = cut(texts)
            rank = pc.fill_null(pc.index_in(vocabulary, value_set=known), -1).to_numpy(zero_copy_only=False)
            is_open = (rank < 0) & (np.bincount(at, minlength=len(vocabulary)) > 0)
            place = rank[at]
            opens = (np.cumsum(is_open) - 1)[at[place < 0]]
            words = vocabulary.filter(pa.array(is_open))
            # places count within these very words: should a lost task come out otherwise, its slices have other names
            name = xxhash.xxh64_intdigest("\n".join([str(part), str(number), *words.to_pylist()]).encode()) - (1 << 63)
            packed = {"counts": [_packed(counts)], "ranks": [_packed(place + 1)], "opens": [_packed(np.diff(opens, prepend=0))]}
            both = {"id": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "words": [zstandard.compress(_joined(words))]}
            yield pa.RecordBatch.from_pydict({"slice": pa.array([name], pa.int64()), **packed, **both})
            del batch, texts, vocabulary, at, rank, place, opens, words
            pa.default_memory_pool().release_unused()

    cut_schema = f"slice long, counts binary, ranks binary, opens binary, id array<{kind}>, words binary"
    # both readers take all columns, so Spark shuffles the slices once and reuses the exchange
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = plain.mapInArrow(released(sliced), cut_schema).repartition(partitions, "slice")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("slice"), batch.column("words")):
                words = _parted(zstandard.decompress(raw.as_py()))
                for a in range(0, len(words), 10_000):
                    some = words[a : a + 10_000]
                    at = pa.array(np.arange(a, a + len(some), dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), name.as_py())), at, some], names=["slice", "at", "word"])

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each distinct word is encoded once: its rows follow each other."""
        encode, last, made = _encoder(path, pattern).encode_ordinary, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            found = [made if w == last else encode(w) for w in words]
            last, made = words[-1], found[-1]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat, starts = np.array([i for x in found for i in x], dtype=np.int64), np.cumsum(sizes) - sizes
            home, at = batch.column("slice").to_numpy(), batch.column("at").to_numpy()
            order = np.lexsort((at, home))
            which, bounds = coded.indices.to_numpy()[order], np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
            rows = []
            for a, b in zip(bounds, bounds[1:]):
                w = which[a:b]
                places = np.diff(at[order[a:b]], prepend=0)
                rows.append((int(home[order[a]]), _packed(places), _packed(sizes[w]), _packed(flat[_laid_out(starts[w], sizes[w])])))
            yield pa.RecordBatch.from_pydict(dict(zip(("slice", "at", "n", "ids"), map(list, zip(*rows)))))
        pa.default_memory_pool().release_unused()

    places = slices.mapInArrow(released(exploded), "slice long, at int, word string")
    filled = places.repartition("word").sortWithinPartitions("word").mapInArrow(released(by_word), "slice long, at binary, n binary, ids binary")
    filled = filled.groupBy("slice").agg(F.collect_list(F.struct("at", "n", "ids")).alias("filled"))
    met = slices.join(filled, "slice", "left")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot_sizes, hot_ids = hot.value
        hot_starts = np.cumsum(hot_sizes) - hot_sizes
        for batch in batches:
            for row in range(batch.num_rows):
                counts, ranks, opens = (_unpacked(batch.column(c)[row].as_py()) for c in ("counts", "ranks", "opens"))
                opens = np.cumsum(opens.astype(np.uint32).view(np.int32).astype(np.int64))
                late = batch.column("filled")[row].as_py() or []
                at = [np.cumsum(_unpacked(x["at"])) for x in late]
                order = np.argsort(np.concatenate(at)) if at else np.zeros(0, np.int64)
                sizes = np.concatenate([_unpacked(x["n"]) for x in late]) if late else np.zeros(0, np.int64)
                if len(order) != int(np.max(opens, initial=-1)) + 1:
                    raise RuntimeError("a slice met other words than its own; run the job again")
                starts = np.cumsum(sizes) - sizes
                flat = np.concatenate([*[_unpacked(x["ids"]) for x in late], hot_ids])
                word = ranks - 1 + len(order)
                word[ranks == 0] = opens
                all_sizes = np.concatenate((sizes[order], hot_sizes))
                all_starts = np.concatenate((starts[order], hot_starts + (len(flat) - len(hot_ids))))
                bounds, own, a = np.concatenate(([0], np.cumsum(counts))), batch.column("id")[row].values, 0
                while a < len(counts):  # some texts at a time
                    b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + SLICE_WORDS, "right")) - 1)
                    some = word[bounds[a] : bounds[b]]
                    ids = flat[_laid_out(all_starts[some], all_sizes[some])].astype(np.int32)
                    cuts = np.concatenate(([0], np.cumsum(all_sizes[some])))[bounds[a : b + 1] - bounds[a]].astype(np.int32)
                    raw = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((cuts * 4).tobytes()), pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_pydict({"id": own.slice(a, b - a), "ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids)), "ids_bytes": raw})
                    a = b

    return met, whole


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS
) -> DataFrame:
    """One row per row of docs: id, ids (array of int) and ids_bytes (the same, little-endian in 32 bits each).

    The ids are those of the tokenizer library for the whole text without special tokens. Null and empty
    texts have no ids. Repeated rows stay, null ids too. Other columns are not read.
    """
    met, whole = _filled_slices(docs, path, pattern, id_col, text_col, hot_words)
    encoded = met.mapInArrow(released(whole), f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>, ids_bytes binary")
    return encoded.withColumnRenamed("id", id_col)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of head and ids: lots of some million ids, with the distinct ones of each."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(sizes), 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LOT_IDS, "right")))
            some = batch.slice(a, b - a)
            ids = some.column("ids").flatten().to_numpy()
            heads = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), some.column("head"))
            parts = {"head": heads, "sizes": [sizes[a:b].astype("<u4").tobytes()], "ids": [ids.astype("<u4").tobytes()]}
            yield pa.RecordBatch.from_pydict({**parts, "distinct": pa.array([np.flatnonzero(np.bincount(ids)).astype(np.int32)], pa.list_(pa.int32()))})
            a = b


def _lot_type(head: str) -> str:
    return f"head array<struct<{head}>>, sizes binary, ids binary, distinct array<int>"


def _gathered(batches: Iterator[pa.RecordBatch], most: int = LOT_IDS) -> Iterator[pa.RecordBatch]:
    """The rows of batches with lists of ids, as many batches in one as have at most so many ids, and at least one."""
    held, size = [], 0
    for batch in batches:
        n = len(batch.column("ids").values)
        if held and size + n > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def decode(encoded: DataFrame, path: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The kept columns and decoded (binary) of each row of encoded.

    Rows are taken together by some million ids; the distinct ids of each lot are exploded and joined with
    the table of token bytes, and the texts are put together by position. Rows without ids have no bytes. An
    id that the table lacks ends the job. The join broadcasts the table and leaves rows in their order; the
    positions that come back are checked.
    """
    rows = encoded.select(F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)]).alias("head"), F.col(ids_col).alias("ids"))
    head_type = ", ".join(f"k{n}: {encoded.schema[c].dataType.simpleString()}" for n, c in enumerate(keep))
    return _decoded(rows.mapInArrow(released(_lots), _lot_type(head_type)), path, keep, head_type)


def _decoded(packed: DataFrame, path: str, keep: list[str], head_type: str) -> DataFrame:
    """The kept columns and decoded of the rows that lots hold."""
    ranks = read_ranks(path)
    table = packed.sparkSession.createDataFrame(pa.table({"__token": pa.array(ranks.values(), pa.int32()), "__bytes": pa.array(ranks.keys(), pa.binary())}))
    # a lot's texts go along with its first id only
    tokens = packed.select(F.struct("head", "sizes", "ids").alias("lot"), F.posexplode_outer("distinct").alias("__at", "__token"))
    lot = F.when(F.coalesce("__at", F.lit(0)) == 0, F.col("lot")).alias("lot")
    found = tokens.select(lot, "__at", "__token").join(F.broadcast(table), "__token", "left").select("lot", "__at", "__token", "__bytes")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, ids, parts = None, [], []

        def closed() -> Iterator[pa.RecordBatch]:
            distinct = np.concatenate(ids)
            known = pa.concat_arrays(parts)
            if known.null_count and len(distinct):
                raise ValueError("an id is not in the table of token bytes")
            place = np.zeros(int(distinct.max(initial=0)) + 1, np.int64)
            place[distinct] = np.arange(len(distinct))
            _, offsets, raw = known.buffers()
            offsets = np.frombuffer(offsets, np.int32)[known.offset : known.offset + len(known) + 1].astype(np.int64)
            raw, width = np.frombuffer(raw or b"", np.uint8), np.diff(offsets)
            sizes = np.frombuffer(lot.field("sizes")[0].as_py(), "<u4").astype(np.int64)
            at = place[np.frombuffer(lot.field("ids")[0].as_py(), "<u4")]
            ends, heads, a = np.cumsum(sizes), lot.field("head")[0].values, 0
            while a < len(sizes):
                begin = ends[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(ends, begin + LOT_IDS // 8, "right")))
                some = at[begin : ends[b - 1]]
                grown = np.concatenate(([0], np.cumsum(width[some])))
                data = raw[_laid_out(offsets[some], width[some])]
                cuts = grown[np.concatenate(([0], ends[a:b] - begin))].astype(np.int32)
                back = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([heads.slice(a, b - a), back], names=["head", "decoded"])
                a = b

        for batch in batches:
            at = pc.fill_null(batch.column("__at"), 0).to_numpy(zero_copy_only=False)
            bounds = [0, *np.flatnonzero(at == 0).tolist(), batch.num_rows]
            for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if n:  # a lot begins
                    if lot is not None:
                        yield from closed()
                    lot, ids, parts = batch.column("lot").slice(a, 1), [], []
                if a < b:
                    if (at[a:b] != sum(map(len, ids)) + np.arange(b - a)).any():
                        raise ValueError("ids out of order")
                    ids.append(pc.fill_null(batch.column("__token").slice(a, b - a), 0).to_numpy(zero_copy_only=False)[: b - a if batch.column("__at")[a].is_valid else 0])
                    parts.append(batch.column("__bytes").slice(a, b - a))
        if lot is not None:
            yield from closed()

    back = found.mapInArrow(released(joined), f"head struct<{head_type}>, decoded binary")
    return back.select(*[F.col(f"head.k{n}").alias(c) for n, c in enumerate(keep)], "decoded")


def digests(spark: SparkSession, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes, and gives id, n_tokens, ids_sha256 and decoded_sha256."""
    met, whole = _filled_slices(docs, path, pattern, id_col, text_col, HOT_WORDS)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole(batches):
            ids = batch.column("ids")
            sha = [hashlib.sha256(raw.as_buffer()).hexdigest() for raw in batch.column("ids_bytes")]
            head = pa.StructArray.from_arrays([batch.column("id"), pc.list_value_length(ids).cast(pa.int64()), pa.array(sha, pa.string())], names=["k0", "k1", "k2"])
            yield pa.RecordBatch.from_arrays([head, ids], names=["head", "ids"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _lots(_gathered(told(batches)))

    # encoding and packing share a worker: each step of its own would keep one more for every core
    head_type = f"k0: {docs.schema[id_col].dataType.simpleString()}, k1: bigint, k2: string"
    back = _decoded(met.mapInArrow(released(packed), _lot_type(head_type)), path, [id_col, "n_tokens", "ids_sha256"], head_type)
    return back.select(id_col, "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
