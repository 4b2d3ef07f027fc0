"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until pieces are short; pieces are encoded; neighbours are joined up the tree. Joining re-encodes a
window around the seam that grows until it ends, on both sides, where a non-space character is followed by white space.
No match of the splitting pattern holds such a place inside it: white space occurs in a match only as its first
character or throughout. The pattern never looks behind, and a look-ahead in a match before the place sees only what
stands before the place, for that match ends in a non-space character there. So encode(a + b) = encode(a) + encode(b) at such a
place whatever surrounds it, tokens outside the window are final, and only the window's tokens are exchanged. A text
without any such place is one window, so the result is always that of the encoder on the whole text.

Nulls and empty texts have no tokens. Decoding maps leaves of ids to bytes and concatenates them up the tree. Repeated
rows come back once each, empty tables give empty results, and other columns than those asked for are not read; ids,
n_tokens and round_trip replace columns of these names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .textkernels import slices, text_bytes

#: Characters of a leaf and ids of a decoding leaf; texts up to a leaf need no join.
LEAF = 512
#: First reach of a seam's window on either side; it doubles until the window ends in safe places.
REACH = 64


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoder of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _safe(text: str, at: int) -> bool:
    """ASCII white space after a character that no reading of white space includes (isspace covers more than the pattern's)."""
    return text[at] in " \t\n\r\x0b\x0c" and not text[at - 1].isspace()


def _before(text: str, low: int, seam: int, reach: int) -> int | None:
    """The last safe place in (low, seam) within reach of the seam; low itself if the reach gets there; else None."""
    stop = max(low, seam - reach)
    return next((i for i in range(seam - 1, stop, -1) if _safe(text, i)), low if stop == low else None)


def _after(text: str, seam: int, high: int, reach: int) -> int | None:
    """The first safe place in (seam, high) within reach of the seam; high itself if the reach gets there; else None."""
    stop = min(high, seam + reach)
    return next((i for i in range(seam + 1, stop) if _safe(text, i)), high if stop == high else None)


def _grown(find, *at: int, text: str) -> int:
    reach = REACH
    while (place := find(text, *at, reach)) is None:
        reach *= 2
    return place


def encode_tree(text: str, encode, leaf: int = LEAF) -> list[int]:
    """The ids of the whole text; encode is the encoder for a piece."""

    def node(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return encode(text[low:high])
        seam = (low + high) // 2
        left, right = node(low, seam), node(seam, high)
        start, end = _grown(_before, low, seam, text=text), _grown(_after, seam, high, text=text)
        lost, gone = len(encode(text[start:seam])), len(encode(text[seam:end]))
        left[len(left) - lost :] = encode(text[start:end])
        left.extend(right[gone:])
        return left

    return node(0, len(text))


def decode_tree(ids: list[int], decode, leaf: int = LEAF) -> bytes:
    """The bytes of all ids; decode is the decoder for a run of ids."""

    def node(low: int, high: int) -> list[bytes]:
        if high - low <= leaf:
            return [decode(ids[low:high])]
        seam = (low + high) // 2
        return [*node(low, seam), *node(seam, high)]

    return b"".join(node(0, len(ids)))


def coded(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns to keep of every row, with ids (array<int>), n_tokens, and round_trip: whether the ids decode to the text.

    Encoding and decoding run in one pass over slices of a few megabytes of text, so a worker holds the ids of a slice
    only. Null text gives empty ids.
    """
    keep = [c for c in keep if c not in ("ids", "n_tokens", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            for a, b in slices(offsets, 1 << 21):
                part = batch.slice(a, b - a)
                ids, same = [], []
                for text in part.column("text"):
                    text = text.as_py() or ""
                    own = encode_tree(text, coder.encode_ordinary)
                    same.append(decode_tree(own, coder.decode_bytes) == text.encode())
                    ids.append(np.array(own, np.int32))
                edges = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                column = pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), column, pa.array(list(map(len, ids)), pa.int64()), pa.array(same)], [*keep, "ids", "n_tokens", "round_trip"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, ids array<int>, n_tokens long, round_trip boolean")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256, for every row of doc_id, text.

    Encoding and decoding run in one pass so that no ids travel between them; rows are independent and long texts are
    bounded by the row itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path, pattern)
        names = [str(i) for i in range(coder.max_token_value + 1)]
        name = names.__getitem__
        for batch in batches:
            counts, ids_hash, bytes_hash = [], [], []
            for text in batch.column("text"):
                ids = encode_tree(text.as_py() or "", coder.encode_ordinary)
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                bytes_hash.append(hashlib.sha256(decode_tree(ids, coder.decode_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    """Every whole document encoded by the byte-level ranks and decoded again."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
