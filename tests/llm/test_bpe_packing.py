import hashlib
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from evidentia.llm import bpe, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
VOCAB = P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a", "a  b", "a \n b", "x  y  ", "\t\ta b\n", "don't  we've 12 345 !!", "日本語 テスト  です  x", "a b ", "a\n", "\n a", "zz\x1c b \x85 q", "é👩‍👩‍👧  x", "same", "same", "a<|endoftext|>b <|endoftext|> c  <|endoftext|>", "w " * 5000, "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(ODD)], "doc_id long, text string, n_tokens string, length int")


def test_encode_matches_tiktoken_and_round_trips(docs):
    exact = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = sorted((len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in ODD for i in [exact.encode_ordinary(t or "")])
    got = bpe.encode_decode(docs, RANKS, P.PATTERN, digests=True).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want and all(r.round_trip for r in got)
    assert sum(r.doc_id is None for r in got) == 1


def test_offsets_and_split_characters():
    codec = bpe.rank_codec(RANKS, P.PATTERN)
    text = "aé👩 b"
    spans = codec.offsets(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < b for a, b in spans)


def test_ids_are_those_of_the_rank_library():
    """Texts of few characters, whose tokens overlap in many ways, words of all languages, and whole documents."""
    codec = bpe.rank_codec(RANKS, P.PATTERN)
    exact = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list(chars), int(rng.integers(1, 60)))) for chars in ("a", "ab", "aA ", "=-", "0 1", "abc", "\n\t ", "éaü", "日本語で", "👩‍é ", "anistero", "(){};_\n") for _ in range(400)]
    import pyarrow.parquet as pq

    texts += [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == exact.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(empty, RANKS, P.PATTERN, digests=True).count() == 0
    assert packing.pack(empty, VOCAB).count() == 0


def test_pack_is_whole(docs):
    t = Tokenizer.from_file(VOCAB)
    want = sorted([*t.encode(x or "", add_special_tokens=False).ids, 1] for x in ODD)
    rows = packing.pack(docs, VOCAB, keep_ids=True).collect()
    seqs, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    assert sorted([i for _, p, _ in sorted(v) for i in p] for v in by_doc.values()) == want
    for v in seqs.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048


def test_fullest_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.choice(np.arange(1, 30), size=4, replace=False)}
        room = int(rng.integers(0, 60))
        best = max(s for n in product(*(range(c + 1) for c in counts.values())) if (s := sum(k * x for k, x in zip(counts, n, strict=True))) <= room)
        got = packing.fullest(counts, room)
        assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(2)
    counts = {int(k): int(rng.integers(1, 500)) for k in rng.choice(np.arange(1, 2048), size=900, replace=False)}
    plan = packing.minimum_slack_plan(counts, 2048)
    used = defaultdict(int)
    for times, window in plan:
        assert sum(k * n for k, n in window.items()) <= 2048
        for k, n in window.items():
            used[k] += n * times
    assert used == counts
    total, sequences = sum(k * n for k, n in counts.items()), sum(t for t, _ in plan)
    assert sequences <= total / 2048 * 1.03 + 2
