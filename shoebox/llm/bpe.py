"""Byte-level BPE over whole texts with content-defined chunk reuse.

A rolling hash over 32 bytes cuts texts into chunks at places that depend on the content only, so documents that share a
passage share its chunks. Chunks that occur more than once in the corpus are encoded once, by the document that owns
them, and handed to the others; the rest are encoded where they are. Chunks are encoded without their surroundings, so the
joins are then repaired: from a safe place before a join (a letter followed by a space, where the pre-tokenizer
always splits) to a safe place behind it the text is encoded again, and the tokens cut away must agree exactly with what the
chunk's own ends give; where they do not, the repair grows to the next safe place.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, functions as F

from shoebox.llm.common import map_batches, pack_texts, unpack_texts

WINDOW = 32
CHUNK_BITS = 11  # chunks of about 2 KiB

_SAFE = re.compile(rb"[A-Za-z](?= )")

#: Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in that such vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one vocabulary file (the JSON form of the ``tokenizers`` library)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        to_byte = _byte_of_char()
        vocab = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens=special)
        self.special = {k.encode(): i for k, i in special.items()}
        size = max([*vocab.values(), *special.values()]) + 1
        pieces = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            pieces[i] = token
        self.dtype = np.dtype("<u2" if size <= 65536 else "<u4")
        self._text = self._flat(pieces)
        self._digits = self._flat([b"%d," % i for i in range(size)])

    @staticmethod
    def _flat(pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes, sizes

    @staticmethod
    def _gather(flat, ids: np.ndarray) -> bytes:
        data, starts, sizes = flat
        n = sizes[ids]
        at = np.repeat(starts[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return data[at].tobytes()

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of one text; special tokens written out in it are recognised."""
        if any(s in text for s in self.special):
            ids = self._bpe.encode(text.decode(), allowed_special="all")
        else:
            ids = self._bpe.encode_ordinary(text.decode())
        return np.array(ids, self.dtype)

    def encode_plain(self, text: bytes) -> np.ndarray:
        """Ids of one text in which special tokens are ordinary text."""
        return np.array(self._bpe.encode_ordinary(text.decode()), self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        out = [self._gather(self._text, ids[at : at + (1 << 18)]) for at in range(0, len(ids), 1 << 18)]
        return b"".join(out).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return b"".join(self._gather(self._digits, ids[at : at + (1 << 18)]) for at in range(0, len(ids), 1 << 18))[:-1]


@lru_cache(maxsize=2)
def load_codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, 256, np.uint64) | np.uint64(1)


def cuts(text: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Chunk bounds, first 0 and last len(text), all between characters: behind each 32-byte window whose hash ends in zeros."""
    n = len(text)
    if n <= WINDOW:
        return [0, n]
    data = np.frombuffer(text, np.uint8)
    mixed = _byte_values()[data]
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        # a window's polynomial by doubling: h of 2w bytes is h(first w) * base^w + h(last w)
        h, power, width = mixed, base, 1
        while width < WINDOW:
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
        h = h ^ (h >> np.uint64(29))
        hit = np.flatnonzero((h & np.uint64((1 << bits) - 1)) == 0) + WINDOW
    out = [0]
    for c in hit.tolist():
        while c < n and text[c] & 0xC0 == 0x80:
            c += 1
        if out[-1] < c < n:
            out.append(c)
    return [*out, n]


def stitch(text: bytes, bounds: list[int], known: dict[int, np.ndarray], encode) -> np.ndarray:
    """Ids of the whole text from its chunks' ids; ``known`` has those of some chunks by number."""
    if len(bounds) == 2:
        return known[0] if 0 in known else encode(text)
    out, pending, last = [], 0, len(bounds) - 2
    for k in range(last + 1):
        a, b = bounds[k], bounds[k + 1]
        first = _SAFE.search(text, a, b)
        q = a if k == 0 else first.end() if first else None
        p = b if k == last else None
        if p is None and first:
            space = b
            while True:  # the last letter with a space behind it, both in the chunk
                space = text.rfind(b" ", a + 1, space)
                if space < 0 or 65 <= text[space - 1] & 0xDF <= 90 and text[space - 1] < 128:
                    break
            p = space if space > 0 else None
        if q is None or p is None or p < q:
            continue  # no safe place: the chunk becomes part of the repair
        ids = known[k] if k in known else encode(text[a:b])
        head = encode(text[a:q]) if q > a else ids[:0]
        tail = encode(text[p:b]) if p < b else ids[:0]
        inner = len(ids) - len(head) - len(tail)
        if inner < 0 or not np.array_equal(ids[: len(head)], head) or not np.array_equal(ids[len(ids) - len(tail) :], tail):
            continue
        if pending < q:
            out.append(encode(text[pending:q]))
        out.append(ids[len(head) : len(head) + inner])
        pending = p
    if pending < len(text):
        out.append(encode(text[pending:]))
    return np.concatenate(out) if out else encode(b"")


def _chunk_rows(bits: int):
    def make():
        def step(batch):
            keys, numbers, hashes = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), unpack_texts(batch.column(1)), strict=True):
                bounds = cuts(text, bits)
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    keys.append(key)
                    numbers.append(k)
                    hashes.append(xxhash.xxh3_128_digest(text[a:b]))
            yield {"key": keys, "no": pa.array(numbers, pa.int32()), "chunk": pa.array(hashes, pa.binary())}

        return step

    return make


def encode_documents(docs: DataFrame, vocabulary: str, bits: int = CHUNK_BITS) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded text).

    Equal texts are encoded once; null text is empty (no tokens). Repeated rows and null ids stay; an empty table gives no
    rows; other columns are ignored. ``vocabulary`` is the path of the tokenizer's JSON file on the executors.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    # the filter is there so that all uses of the texts have one plan, and with it one shuffle
    texts = map_batches(rows.select("key", "text"), "key binary, packed binary", pack_texts).filter("key is not null").dropDuplicates(["key"])
    chunks = map_batches(texts, "key binary, no int, chunk binary", _chunk_rows(bits))
    shared = chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.min(F.struct("key", "no")).alias("own")).filter("n > 1")
    owners = shared.select("own.*").groupBy("key").agg(F.collect_list("no").alias("mine"))

    def make_owned():
        codec = load_codec(vocabulary)

        def step(batch):
            hashes, ids = [], []
            for text, mine in zip(unpack_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                bounds = cuts(text, bits)
                for k in mine:
                    part = text[bounds[k] : bounds[k + 1]]
                    hashes.append(xxhash.xxh3_128_digest(part))
                    ids.append(codec.encode(part).tobytes())
            yield {"chunk": pa.array(hashes, pa.binary()), "ids": pa.array(ids, pa.binary())}

        return step

    encoded = map_batches(texts.join(owners, "key").select("packed", "mine"), "chunk binary, ids binary", make_owned)
    reused = chunks.join(encoded, "chunk").groupBy("key").agg(F.collect_list(F.struct("no", "ids")).alias("known"))

    def make_digests():
        codec = load_codec(vocabulary)

        def step(batch):
            out = []
            for text, known in zip(unpack_texts(batch.column(1)), batch.column(2), strict=True):
                have = {x["no"]: np.frombuffer(x["ids"], codec.dtype) for x in known.as_py() or ()}
                ids = stitch(text, cuts(text, bits), have, codec.encode)
                decoded = codec.decode(ids).encode()
                out.append((len(ids), hashlib.sha256(codec.listed(ids)).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield {"key": batch.column(0)} | {k: [r[j] for r in out] for j, k in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

        return step

    schema = "key binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
    digests = map_batches(texts.join(reused, "key", "left").select("key", "packed", "known"), schema, make_digests)
    return rows.select("doc_id", "key").join(digests, "key").drop("key")
