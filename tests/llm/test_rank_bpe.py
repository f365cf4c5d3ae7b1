import base64
import hashlib
import random

import regex
import tiktoken

from shoebox.llm import rank_bpe
from shoebox.llm.queries import QUERIES, ranks

PIECES = ["the ", "thonble", " it's", "\n\n", "   ", "é", "日本 ", "123", "<|endoftext|>", "...", " a b c ", "'ll", "😀", "\t", "x" * 50, "　", "\xa0", "\x1c", "\x85 ", " word word and more words here. ", " " * 40, " \n"]


def library():
    path, pattern = ranks()
    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def digests(ids, text):
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_parts_equal_the_library(monkeypatch):
    own, codec, rng = library(), rank_bpe.load_ranks(*ranks()), random.Random(4)
    monkeypatch.setattr(rank_bpe, "_RUN", rank_bpe.re.compile(rank_bpe._RUN.pattern.replace(str(rank_bpe.LONG_SPACE), "20")))
    for _ in range(600):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(80)))
        for size in (1, 7, 100):
            assert "".join(p for p, _ in rank_bpe.parts(text, size)) == text
            ids = codec.encode(text, size).tolist()
            assert ids == own.encode_ordinary(text)
            assert codec.decode(ids) == text.encode()


def test_each_match_is_encoded_separately():
    own, codec, rng = library(), rank_bpe.load_ranks(*ranks()), random.Random(5)
    for _ in range(100):
        text = "".join(rng.choice(PIECES) for _ in range(40))
        want = [i for m in regex.finditer(ranks()[1], text) for i in own._encode_single_piece(m.group())]
        assert codec.encode(text, 16).tolist() == want


def test_runs_that_the_library_cannot_take():
    own, codec, n = library(), rank_bpe.load_ranks(*ranks()), 3_000_000
    spaces = codec.encode(" " * n + "word").tolist()
    assert codec.decode(spaces) == (" " * n + "word").encode()
    assert spaces == own._encode_single_piece(" " * (n - 1)) + own.encode_ordinary(" word")
    assert codec.decode(codec.encode("a" + "\n" * n).tolist()) == ("a" + "\n" * n).encode()
    assert codec.encode("a" * 200_000).tolist() == own.encode_ordinary("a" * 200_000)


def test_whole_table(spark, sf):
    own = library()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_rank_bpe"](spark, sf).collect()}
    assert got == {r.doc_id: digests(own.encode_ordinary(r.text or ""), r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_edge_rows(spark, monkeypatch):
    own, texts = library(), [None, "", "<|endoftext|>", "a" * 30000, "é" * 9000, " \n" * 40000, "same text", "same text", "word " * 100_000]
    df = spark.createDataFrame([(i % 7 or None, t, [1], "k") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rank_bpe.encoding_digests(df, *ranks()).collect())
    assert got == sorted((i % 7, *digests(own.encode_ordinary(t or ""), t or "")) for i, t in enumerate(texts))
    assert rank_bpe.encoding_digests(df.limit(0), *ranks()).count() == 0
    again = rank_bpe.decode_ids(rank_bpe.encode_texts(df, *ranks()), *ranks()).collect()
    assert sorted(bytes(r.decoded).decode() for r in again) == sorted(t or "" for t in texts)
