import hashlib

import public_tokenizers
import pytest
import tiktoken

from deducta.llm import bpe

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TABLE = bpe.parse_ranks(RANKS)
TEXTS = ["", None, "hello world", "hello world", "   \n\t x  ", "naïve café 123's don't", "<|endoftext|> is text", "日本語 ñandú 🙂🙂", "a" * 5000, "word " * 3000, "x\r\n\r\ny  ", "  z"]


def merge(piece: bytes) -> list[int]:
    """The plain definition: merge the adjacent pair of the least rank until there is none."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        ranked = [(TABLE.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(ranked)
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [TABLE[p] for p in parts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")


def test_encoding_and_decoding(docs):
    one = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=TABLE, special_tokens={})
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = one.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_against_plain_merging(spark):
    import regex

    texts = [t for t in TEXTS if t and len(t) < 100]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids == [x for w in regex.findall(public_tokenizers.PATTERN, texts[r.doc_id]) for x in merge(w.encode())]


def test_small_blocks_keys_and_rows(spark):
    df = spark.createDataFrame([(None, "a b c", 1), (7, "a b c", 1), (7, "a b c", 1), (8, None, 2)], "doc_id long, text string, block int")
    out = bpe.encode(df, RANKS, public_tokenizers.PATTERN, block_chars=4)
    assert out.columns == ["doc_id", "block", "ids"] and sorted((r.doc_id or 0, r.block, len(r.ids)) for r in out.collect()) == [(0, 1, 3), (7, 1, 3), (7, 1, 3), (8, 2, 0)]
    back = bpe.decode(out, RANKS)
    assert {bytes(r.decoded) for r in back.collect()} == {b"a b c", b""}


def test_empty_table_and_bad_ids(spark):
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    bad = spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad, RANKS).collect()
    assert bytes(bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), RANKS).first().decoded) == b""
