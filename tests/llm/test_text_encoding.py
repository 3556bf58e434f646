"""Byte-level BPE and packing against the public libraries."""

import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

from knownby.llm import bpe, packing
from knownby.llm.pretokens import split

LETTERS = "ab '\n\t.s tremvl123é ñ　\x1c\x85中𝒳!'d"


def odd_texts(n, size, seed=1):
    pick = random.Random(seed)
    return ["".join(pick.choice(LETTERS) for _ in range(pick.randint(0, size))) for _ in range(n)]


def test_pretokens_are_the_matches_of_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    pick = random.Random(3)
    for _ in range(500):
        texts = [t for t in odd_texts(pick.randint(0, 4), 14, pick.random())]
        tokens, first = split(texts)
        want = [pattern.findall(t) for t in texts]
        assert tokens.to_pylist() == [m.encode() for w in want for m in w]
        assert first.tolist() == list(np.cumsum([0, *map(len, want)]))


def test_rank_bitmap_finds_the_smallest():
    bitmap, members = bpe.RankBitmap(9000), set()
    pick = random.Random(5)
    for _ in range(2000):
        rank = pick.randrange(9000)
        if rank in members:
            members.discard(rank)
            bitmap.remove(rank)
        else:
            members.add(rank)
            bitmap.add(rank)
        assert bitmap.first() == min(members, default=-1)


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_merging_matches_the_library(encoding):
    texts = odd_texts(200, 80) + ["a" * 5000, "ab" * 3000, "的" * 999 + "abcabc" * 400, "", "<|endoftext|>"]
    ids, at = bpe.encode_texts(texts, public_tokenizers.path(bpe.VOCABULARY))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [encoding.encode_ordinary(t) for t in texts]


def test_a_lower_rank_made_by_a_merge_goes_first():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"bc": 299, b"abc": 260, b"cd": 301, b"abcd": 280}
    for piece in (b"abcd", b"ababcd", b"abcabcdcd"):
        own = bpe.merge_all([piece, b"", piece], ranks)
        want = tiktoken.Encoding("x", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(piece.decode())
        assert own == [want, [], want]


def test_encode_then_decode_is_exact(llm, encoding):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, "it's  a\n\ntest 12é " * 50, None), (None, "a" * 20000, "z")]
    df = llm.createDataFrame(rows, "doc_id long, text string, ids string")
    path = public_tokenizers.path(bpe.VOCABULARY)
    got = bpe.decode(bpe.encode(df, path), path).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.decoded.decode() == (row.text or "")
        assert np.frombuffer(row.ids, "<u4").tolist() == encoding.encode_ordinary(row.text or "")
    digests = bpe.round_trip(df.drop("ids"), path).collect()
    assert sorted(r.n_tokens for r in digests) == sorted(len(encoding.encode_ordinary(t or "")) for _, t, _ in rows)
    assert bpe.round_trip(df.drop("ids").limit(0), path).count() == 0


def test_pieces_are_binary_and_hold_every_id_once(llm, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = {1: None, 2: "", 3: "word " * 1500, 4: "l'été it's\n\n 12" * 40, 5: "a", 6: "a <|endoftext|> b<|endoftext|>" + " word" * 3000, 7: "<|endoftext|>", 8: "<|endoftext >"}
    df = llm.createDataFrame([*texts.items(), (1, None)], "doc_id long, text string").withColumnRenamed("text", "Text")
    pieces = packing.pack(df, public_tokenizers.path(packing.VOCABULARY), text="Text")
    got = pieces.collect()
    assert len({r.sequence_id for r in got}) == len(got)
    for doc_id, text in texts.items():
        own = sorted((r for r in got if r.doc_id == doc_id), key=lambda r: (r.start, r.sequence_id))
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        if doc_id == 1:
            assert [(r.start, r.length, r.ids) for r in own] == [(0, 1, bytes(4))] * 2
            continue
        assert [i for r in own for i in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert all(r.length <= 1024 and r.length & r.length - 1 == 0 and r.doc_tokens == len(want) and r.offset == 0 for r in own)
        assert sum(r.length < 1024 for r in own) == bin(len(want) % 1024).count("1")
    row = packing.digests(pieces).where("doc_id = 5").first()
    assert row.ids_crc32 == zlib.crc32(np.array(tokenizer.encode("a").ids + [0], "<u4").tobytes())
    packing.write_buckets(pieces, f"{tmp_path}/buckets")
    back = llm.read.parquet(f"{tmp_path}/buckets")
    assert back.where("length != pow(2, bucket)").count() == 0 and back.count() == len(got)
    assert packing.pack(df.limit(0), public_tokenizers.path(packing.VOCABULARY), text="Text").count() == 0
