"""Byte-level BPE against the tiktoken library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from canopyframe.llm import byte_bpe, queries

RANKS, PATTERN = queries.BYTE_RANKS, public_tokenizers.PATTERN
PIECES = ["a", "aa", " ", "   ", "\n", "-", "--", "é", "\U0001f600", "あ", "'s", "'", "1", "22", "the", " of", "_", "\t", "ing", "́", "\u0085", "\x1c", " "]


@pytest.fixture(scope="module")
def other():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_query_equals_tiktoken(spark, folder, texts, other):
    rows = queries.op13(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = other.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_random_strings_and_code_points(other):
    mine = byte_bpe.model(RANKS, PATTERN)
    draw = random.Random(7)
    cases = ["".join(draw.choices(PIECES, k=draw.randint(1, 40))) for _ in range(5000)]
    cases += [c * n for c in "a-= \n_.é\t" for n in range(1, 70)]
    cases += [f"a{chr(c)} {chr(c)}1" for c in range(0, 0x11000, 3) if not 0xD800 <= c < 0xE000]
    for case in cases:
        assert mine.encode(case, add_special_tokens=False).ids == other.encode_ordinary(case), case


def test_odd_rows_keep_other_columns(spark, odd_docs, other):
    df = odd_docs.withColumn("IDS", F.lit("old")).withColumn("bytes", F.lit("old"))
    encoded = byte_bpe.encode(df, RANKS, PATTERN, spans=("first", "last"))
    rows = byte_bpe.decode(encoded, RANKS, text="again").collect()
    assert len(rows) == odd_docs.count()
    assert sorted(c.lower() for c in encoded.columns).count("ids") == 1
    for r in rows:
        text = r.text or ""
        assert list(r.ids) == other.encode_ordinary(text)
        assert bytes(r["bytes"]) == text.encode() and r.again == text
        assert r["key"] == "key" and r["count"] == "count"
        assert len(r["first"]) == len(r["last"]) == len(r.ids)
        # Spans cover the text in order; those of a split character repeat.
        at = 0
        for a, b in zip(r["first"], r["last"]):
            assert a <= at and b >= a
            at = max(at, b)
        assert at == len(text)


def test_empty_table(spark, no_docs):
    encoded = byte_bpe.encode(no_docs, RANKS, PATTERN)
    assert byte_bpe.decode(encoded, RANKS).count() == 0


def test_split_characters(spark, other):
    text = "x\U0001f9e8y あ\U0001f468‍\U0001f469 end"
    ids = other.encode_ordinary(text)
    df = spark.createDataFrame([(1, ids), (2, ids[:2]), (3, []), (4, None)], "k int, ids array<int>")
    whole = {r.k: r for r in byte_bpe.decode(df, RANKS, text="t").collect()}
    assert whole[1].t == text and whole[3].t == "" and whole[4].t is None and whole[4]["bytes"] is None
    assert bytes(whole[2]["bytes"]) == b"".join(other.decode_single_token_bytes(i) for i in ids[:2])
    assert "�" in whole[2].t
    for size in (1, 2, 3, 100):
        got = {r.k: r.texts for r in byte_bpe.decode_windows(df, RANKS, size).collect()}
        assert "".join(got[1]) == text and len(got[1]) == -(-len(ids) // size)
        assert not any("�" in t for t in got[1])
        assert got[4] is None and got[3] == []
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [60000])], "k int, ids array<int>"), RANKS).collect()


def test_pieces_encode_separately(other):
    draw = random.Random(9)
    texts = ["some words, 12 more - and   wide  gaps\n\n'tis é \U0001f600 " * 300 + "z" * 5000, "", "é \u3000 x\u00a0 y\u2003 z 中文 字", "y" * 5000]
    texts += ["".join(draw.choices(PIECES, k=60)) for _ in range(2000)]
    raw = [t.encode() for t in texts]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    start, row = byte_bpe.segments(data, bounds)
    assert len(start) > 10_000
    encoder = byte_bpe.SegmentIds(RANKS, PATTERN, limit=500)
    for _ in range(2):
        tokens, count = encoder(data, start)
        ends = np.cumsum(np.bincount(row, weights=count, minlength=len(texts)).astype(int))
        for t, part in zip(texts, np.split(tokens[:, 0], ends[:-1])):
            assert part.tolist() == other.encode_ordinary(t), t


def test_packed_ids(spark, odd_docs, other):
    packed = byte_bpe.encode(odd_docs, RANKS, PATTERN, packed=True, keep=["doc_id", "text"])
    assert packed.columns == ["doc_id", "text", "ids"]
    for r in byte_bpe.decode(packed, RANKS).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == other.encode_ordinary(r.text or "")
        assert bytes(r["bytes"]) == (r.text or "").encode()
