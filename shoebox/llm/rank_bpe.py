"""Byte-level BPE by a file of ranks, encoded with the ``tiktoken`` library and decoded to raw bytes.

Long texts are split before they reach the library, only at places where no match of the pattern can lie across: between a
character that is no white space and white space behind it, since white space is at the start of a match or fills
it. Runs of white space of thousands of characters, which overflow the library's matcher, are cut as its pattern does: all but
the last character, if other text follows, is one match. Every part then has the ids that it has in the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from shoebox.llm.common import map_batches

#: Characters of text given to the library at once, and from how many on white space is cut by hand.
PART, LONG_SPACE = 1 << 16, 1 << 12
#: Ids returned in one Arrow batch, about.
BATCH_IDS = 1 << 21

#: What the pattern's \s matches.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{{LONG_SPACE},}}")
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


def parts(text: str, size: int = PART) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one match of white space); the parts make up the text and split no match."""
    at = 0
    for run in [*_RUN.finditer(text), None]:
        stop = run.start() if run else len(text)
        while at < stop:
            cut = _SAFE.search(text, min(at + size, stop), stop) if stop - at > size else None
            end = cut.start() if cut else stop
            yield text[at:end], False
            at = end
        if run:
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start() : at], True


class RankCodec:
    """Encoder and decoder of one file of ranks (a base-64 token and its rank a line)."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, size: int = PART) -> np.ndarray:
        found = []
        for part, space in parts(text, size):
            found.append(self._bpe._encode_single_piece(part) if space else self._bpe.encode_ordinary(part))
        return np.concatenate([np.array(x, np.int32) for x in found]) if found else np.zeros(0, np.int32)

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes; they need not be whole characters."""
        return self._bpe.decode_bytes(ids)


@lru_cache(maxsize=2)
def load_ranks(path: str, pattern: str) -> RankCodec:
    return RankCodec(path, pattern)


def encode_texts(docs: DataFrame, ranks: str, pattern: str, size: int = PART) -> DataFrame:
    """(doc_id, ids) of every row: the ids of the whole text, each match of the pattern encoded separately, no special tokens.

    Null text is empty and has no ids; repeated rows and null ids stay; an empty table gives no rows; other columns are ignored.
    ``ranks`` is the file's path on the executors. A text that is no valid UTF-8 is read with replacement characters."""

    def make():
        codec = load_ranks(ranks, pattern)

        def step(batch):
            keys, held, total = [], [], 0

            def out():
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
                return {"doc_id": keys, "ids": pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *held]))}

            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids = codec.encode((text.as_py() or b"").decode("utf-8", "replace"), size)
                keys.append(doc_id)
                held.append(ids)
                total += len(ids)
                if total >= BATCH_IDS:
                    yield out()
                    keys, held, total = [], [], 0
            yield out()

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, ids array<int>", make)


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the raw bytes of each row's ids; null ids are none."""

    def make():
        codec = load_ranks(ranks, pattern)

        def step(batch):
            decoded = [codec.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield {"doc_id": batch.column(0), "ids": batch.column(1), "decoded": pa.array(decoded, pa.binary())}

        return step

    return map_batches(encoded.select("doc_id", "ids"), "doc_id long, ids array<int>, decoded binary", make)


def encoding_digests(docs: DataFrame, ranks: str, pattern: str, size: int = PART) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 (of the decoded bytes)."""
    both = decode_ids(encode_texts(docs, ranks, pattern, size), ranks, pattern)
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
