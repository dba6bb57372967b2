import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemill.llm import bpe, token_tables
from tidemill.llm.common import new_folder

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ENC = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def wanted(text):
    return np.array(ENC.encode_ordinary(text or ""), dtype="<u4").tobytes()


@given(st.text(alphabet=st.sampled_from(list("ab1'.,!sT \n\t\r\u00a0\u3000é\u0301\x1c\U0001f600")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_words_can_be_encoded_by_themselves(text):
    words = bpe.words_of(text)
    assert "".join(words) == text
    assert [i for w in words for i in ENC.encode_ordinary(w)] == ENC.encode_ordinary(text)


@given(st.text(alphabet=st.sampled_from(list("abSTé'ÀßµªǄİﬁ12½².,!<|> \t\n\x1c\x85\xa0\u0301")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_can_be_encoded_by_their_parts(text):
    encode = token_tables._piece_encoder(WORDS, 4)
    whole = np.array(token_tables._tokenizer(WORDS).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert encode([text]) == [whole]


def test_bpe_round_trip(spark, odd_docs, no_docs, documents):
    some = spark.createDataFrame(documents[["doc_id", "text"]].head(60))
    for docs in (odd_docs, some):
        for hot in (0, 50, bpe.HOT_WORDS):
            got = bpe.encode(docs, RANKS, P.PATTERN, hot_words=hot)
            rows = bpe.decode(got, RANKS, ["doc_id", "ids_bytes", "ids"]).collect()
            assert all(np.array(r["ids"], dtype="<u4").tobytes() == bytes(r["ids_bytes"]) for r in rows)
            have = sorted((str(r["doc_id"]), bytes(r["ids_bytes"]), bytes(r["decoded"])) for r in rows)
            want = sorted((str(r["doc_id"]), wanted(r["text"]), (r["text"] or "").encode()) for r in docs.collect())
            assert have == want
    assert bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0


def test_slices_are_shuffled_once(spark, documents):
    got = bpe.encode(spark.createDataFrame(documents[["doc_id", "text"]]), RANKS, P.PATTERN)
    got.collect()
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_hot_words_are_bounded(spark):
    words = spark.createDataFrame([(f"w{i}", i + 1) for i in range(100)], "word string, n long")
    assert bpe.frequent_words(words, 10).count() == 0 and bpe.frequent_words(words, 40).count() == 37
    assert bpe.frequent_words(words, 100).count() == 100


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab.é \n\u3000")), max_size=12) | st.none(), max_size=9))
@settings(max_examples=200, deadline=None)
def test_cutting_many_texts_is_cutting_each(texts):
    words, numbers, counts = bpe.cut(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    words = words.to_pylist()
    for text, a, b in zip(texts, ends - counts, ends):
        assert "".join(words[n] for n in numbers[a:b]) == (text or "")
        assert [i for n in numbers[a:b] for i in ENC.encode_ordinary(words[n])] == ENC.encode_ordinary(text or "")


def test_token_tables_round_trip(spark, odd_docs, no_docs, documents):
    tok = Tokenizer.from_file(WORDS)
    for docs in (odd_docs, spark.createDataFrame(documents[["doc_id", "text"]])):
        manifest = token_tables.write_tables(docs, WORDS, new_folder(spark, "sst"), shard_bytes=20_000)
        got = token_tables.read_tables(manifest).orderBy("start").collect()
        rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        at = 0
        assert len(got) == len(rows)
        for r, (i, text) in zip(got, rows):
            ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], dtype="<u4")
            assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (i, at, len(ids), ids.tobytes())
            at += len(ids)
        ask = spark.createDataFrame([(i,) for i in (2, 7, 8, 10**15, -5, None)], "doc_id long")
        found = sorted((r["doc_id"], bytes(r["ids"])) for r in token_tables.find(manifest, ask).collect())
        want = sorted((i, np.array(tok.encode(t, add_special_tokens=False).ids + [1], dtype="<u4").tobytes()) for i, t in rows if i in (2, 7, 8))
        assert found == want
    none = token_tables.write_tables(no_docs, WORDS, new_folder(spark, "sst"))
    assert token_tables.read_tables(none).count() == 0


def test_ids_beside_null_ids_are_found(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 3 + [(i, "d e f") for i in range(-2, 6)], "doc_id long, text string")
    ask = spark.createDataFrame([(i,) for i in range(-3, 7)], "doc_id long")
    for partitions in (1, 3):
        manifest = token_tables.write_tables(docs, WORDS, new_folder(spark, "sst"), partitions=partitions)
        assert sorted(r["doc_id"] for r in token_tables.find(manifest, ask).collect()) == list(range(-2, 6))


def test_shard_file(tmp_path):
    path = tmp_path / "x.sst"
    writer = token_tables.ShardWriter(open(path, "wb"), 2)
    entries = [(i, np.arange(i % 50, dtype="<u2").tobytes()) for i in range(-3000, 9000, 3)]
    for i, ids in entries:
        writer.add(token_tables.key_of(i), ids)
    writer.close()
    shard = token_tables.ShardReader(str(path))
    assert len(shard.index) > 1 and [(token_tables.id_of(k), x) for k, _, x in shard.scan()] == entries
    assert all([shard.look_up(token_tables.key_of(i))[0].astype("<u2").tobytes() == x for i, x in entries[::97]])
    assert shard.look_up(token_tables.key_of(1)) == []
    misses = sum(shard.may_hold(token_tables.key_of(i)) for i in range(-2999, 9000, 3))
    assert misses < 0.03 * len(entries)


def test_query_digests(spark, sf_dir, documents):
    from tidemill.llm import queries

    tok = {r["doc_id"]: r for r in queries.op3_bpe(spark, sf_dir).collect()}
    for i, text in documents[["doc_id", "text"]].head(50).itertuples(index=False):
        assert tok[i]["ids_sha256"] == hashlib.sha256(wanted(text)).hexdigest() and tok[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    sst = queries.op5_token_tables(spark, sf_dir).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in sst] == sorted(documents.doc_id)
    assert sst[0]["ids_crc32"] == zlib.crc32(np.array(Tokenizer.from_file(WORDS).encode(documents.set_index("doc_id").text[sst[0]["doc_id"]], add_special_tokens=False).ids + [1], dtype="<u4").tobytes())


def test_plain_words_are_encoded_together(monkeypatch):
    words = [f"{a}{b}{c}\xe9{d}" for a in ("th", "qu", "st") for b in ("an", "er", "zzx") for c in ("ing", "ß", "ly") for d in ("tion", "y", "")]
    odd = ["", "don't", "it's,", "x<|y", "a\nB c\td", "İstanbul—ok 12½", "ét\xe9", "Å", "ﬁne", "9th.\n\nNext", "  two  blanks ", "日本語 text", "\xa0 \x85x", "ªº"]
    texts = [*odd, *words, " ".join(words + odd)]
    calls, made = [], []
    library = token_tables._tokenizer(WORDS)

    class Counted:
        def encode_batch_fast(self, some, **kwargs):
            calls.append(len(some))
            return library.encode_batch_fast(some, **kwargs)

    encode = token_tables.PieceEncoder(WORDS, 4)
    monkeypatch.setattr(token_tables, "_tokenizer", lambda path: Counted())
    for _ in range(2):
        made = encode(texts)
        assert made == [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert encode([None]) == [b""] and sum(calls) < len(words)
