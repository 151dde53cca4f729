import hashlib
import random

import numpy as np
import pytest

from tessella.llm import bpe_codec as bpe
from tessella.llm import queries

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
regex = pytest.importorskip("regex")

ALPHABET = [*"abstreldmv'' \n\t  1٣é日—!　\x1c\x85🎉´ñ", "'re", "'ll", " '", "''", "'s", "the", " of"]


def encoding(name):
    codec = bpe.Codec(open(P.path(name), "rb").read())
    return codec, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.vocabulary.rank, special_tokens={})


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def ids(codec, texts):
    found, cut = codec.ids(*joined(texts))
    return [np.frombuffer(b"".join(found[a:b]), "<u4").tolist() for a, b in zip(cut, cut[1:], strict=False)]


def some_texts(n, longest, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_pieces_are_the_matches_of_the_pattern():
    pattern = regex.compile(P.PATTERN)
    for seed in range(60):
        texts = some_texts(100, 12, seed)
        want, at = [], 0
        for t in texts:
            for m in pattern.findall(t):
                want.append(at)
                at += len(m.encode())
        assert bpe.piece_starts(*joined(texts)).tolist() == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
@pytest.mark.parametrize("many", [0, 24, 10**9])
def test_ids_are_those_of_the_library(monkeypatch, name, many):
    """With merges as arrays only, one by one only, and both."""
    monkeypatch.setattr(bpe, "MANY_PLACES", many)
    codec, own = encoding(name)
    texts = [*some_texts(1500, 60), "a" * 5000, "ab" * 3000 + " " * 99, "=-" * 700, "", "\n" * 50, "bananananana" * 40]
    assert ids(codec, texts) == [own.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("many", [0, 10**9])
def test_lower_ranks_that_come_up_late(monkeypatch, many):
    """Random ranks, in which a merge often makes a pair of a lower rank than its own."""
    monkeypatch.setattr(bpe, "MANY_PLACES", many)
    import base64

    rng = random.Random(3)
    for _ in range(30):
        tokens = [bytes([b]) for b in range(256)]
        rest = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)}
        tokens += rng.sample(sorted(rest), len(rest))
        raw = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))
        codec = bpe.Codec(raw)
        own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.vocabulary.rank, special_tokens={})
        texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(60)]
        assert ids(codec, texts) == [own.encode_ordinary(t) for t in texts]


def test_what_is_kept_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    codec, own = encoding("byte_bpe_50k.tiktoken")
    for seed in range(5):
        texts = some_texts(50, 30, seed)
        assert ids(codec, texts) == [own.encode_ordinary(t) for t in texts]


def expected(rows, own):
    out = []
    for i, t in rows:
        found = own.encode_ordinary(t or "")
        out.append((i, len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(bpe, "PART_BYTES", 64)
    _, own = encoding("byte_bpe_50k.tiktoken")
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice"), (4, "a long text, with 'quotes' and  two spaces.\n\n" * 300), (5, "x" * 3000), (6, " " * 500)]
    rows += [(10 + i, t) for i, t in enumerate(some_texts(40, 400))]
    frame = spark.createDataFrame([(i, t, 7, "clash") for i, t in rows], "doc_id long, text string, n_tokens int, id string")
    got = bpe.encode(frame, P.path("byte_bpe_50k.tiktoken"), with_ids=True).collect()
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=repr) == expected(rows, own)
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in got)
    assert bpe.encode(frame.limit(0), P.path("byte_bpe_50k.tiktoken")).collect() == []


def test_query(spark, sf_dir):
    _, own = encoding("byte_bpe_50k.tiktoken")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op11_bpe_codec(spark, sf_dir).collect()), key=repr) == expected(rows, own)
