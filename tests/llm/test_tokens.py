import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from shoebox.llm import bpe, token_scan
from shoebox.llm.queries import END_ID, QUERIES, vocabulary

PIECES = ["the ", "thonble", " it's", "\n\n", "   ", "é", "日本 ", "123", "<|endoftext|>", "<|endof", "text|>", "...", " a b c ", "'ll", "😀", "\t", "x" * 50, " word word word and more words here. "]


def slow(tok, text):
    ids = tok.encode(text, add_special_tokens=False).ids
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), h(",".join(map(str, ids))), h(tok.decode(ids, skip_special_tokens=False))


def test_stitched_chunks_equal_the_library():
    tok, codec, rng = Tokenizer.from_file(vocabulary()), bpe.load_codec(vocabulary()), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(120))).encode()
        for bits in (2, 5):
            bounds = bpe.cuts(text, bits)
            known = {k: codec.encode(text[bounds[k] : bounds[k + 1]]) for k in range(len(bounds) - 1) if rng.random() < 0.5}
            ids = bpe.stitch(text, bounds, known, codec.encode)
            assert ids.tolist() == tok.encode(text.decode(), add_special_tokens=False).ids
            assert codec.decode(ids) == text.decode()


def test_bpe_whole_table(spark, sf):
    tok = Tokenizer.from_file(vocabulary())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op6_bpe_encoding"](spark, sf).collect()}
    assert got == {r.doc_id: slow(tok, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_bpe_edge_rows(spark):
    tok, shared = Tokenizer.from_file(vocabulary()), "a passage that comes back again, word by word; " * 200
    texts = [None, "", "<|endoftext|>", shared, "other start " + shared, shared, "a" * 30000, "é" * 9000, " \n" * 4000]
    df = spark.createDataFrame([(i % 7, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(df, vocabulary(), 6).collect())
    assert got == sorted((i % 7, *slow(tok, t or "")) for i, t in enumerate(texts))
    assert bpe.encode_documents(df.limit(0), vocabulary()).count() == 0


def test_token_counts_whole_table(spark, sf):
    tok = Tokenizer.from_file(vocabulary())
    tok.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    small = token_scan.token_counts(spark.read.parquet(f"{sf}/documents.parquet"), vocabulary(), END_ID, 100)
    assert {r.doc_id: r.n_tokens for r in small.collect()} == got


def test_scan_of_any_blocks(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for file in range(4):
        ids = rng.choice([1, 2, 9], 700, p=[0.5, 0.45, 0.05] if file else [0.5, 0.5, 0.0]).astype("<u2")
        at = block = 0
        while at < len(ids):
            n = int(rng.integers(0, 60))
            rows.append((file, block, bytearray(ids[at : at + n].tobytes()) if n else None))
            at, block = at + n, block + 1
        ends = [-1, *np.flatnonzero(ids == 9).tolist()]
        want += [(file, i, b - a - 1) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
        if ends[-1] < len(ids) - 1:
            want.append((file, len(ends) - 1, len(ids) - 1 - ends[-1]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "file long, block long, data binary")
    for size in (3, 1024):
        got = sorted((r.file, r.ordinal, r.n_tokens) for r in token_scan.document_lengths(df, 9, "<u2", size).collect())
        assert got == sorted(want)
    assert token_scan.document_lengths(df.limit(0), 9).count() == 0
    empty = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a", 5)], "doc_id long, text string, n_tokens int")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_scan.token_counts(empty, vocabulary(), END_ID).collect()) == [(0, 1), (1, 0), (1, 0)]


def test_flat_files_on_disk(spark, tmp_path):
    rng, want = np.random.default_rng(8), []
    (tmp_path / "tokens" / "deep").mkdir(parents=True)
    for name, n, share in (("a b.bin", 1000, 0.05), ("deep/c.bin", 700, 0.3), ("none.bin", 300, 0.0), ("empty.bin", 0, 0.0), ("ends.bin", 5, 1.0)):
        ids = np.where(rng.random(n) < share, 9, rng.integers(10, 70000, n)).astype("<u4")
        ids.tofile(tmp_path / "tokens" / name)
        ends = [-1, *np.flatnonzero(ids == 9).tolist()]
        want += [(name, i, b - a - 1) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
        if ends[-1] < n - 1:
            want.append((name, len(ends) - 1, n - 1 - ends[-1]))
    path = str(tmp_path / "tokens")
    for block in (7, 1 << 18):
        blocks = token_scan.read_token_files(spark, path, "<u4", block)
        got = [(r.file.split("/tokens/")[1], r.ordinal, r.n_tokens) for r in token_scan.document_lengths(blocks, 9, "<u4").collect()]
        assert sorted(got) == sorted(want)
    with pytest.raises(ValueError):
        token_scan.read_token_files(spark, path, "<u4", largest=100)
    (tmp_path / "tokens" / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole number of tokens"):
        token_scan.read_token_files(spark, path, "<u4").count()
