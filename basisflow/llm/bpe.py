"""Byte-level BPE encoding and decoding with a local rank file.

Each match of the split pattern is merged separately by the tiktoken library; special tokens have no
meaning. Long texts are cut before white space that follows a visible character. No match of the
pattern spans such a place (white space can only begin a match there, and a run of visible characters
is matched greedily up to it), so the ids are those of the whole text and memory stays flat.

Null text: no ids, empty bytes. A text without a safe boundary is encoded in one piece.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basisflow.llm.common import without

CUT_CHARS = 1 << 16
_BOUNDARY = re.compile(r"(?<=\S)[ \n]")
_encodings: dict[tuple[str, str], object] = {}


def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file, once per Python worker."""
    import tiktoken

    key = rank_file, pattern
    if key not in _encodings:
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def safe_pieces(text: str, size: int = CUT_CHARS) -> Iterator[str]:
    """The text in pieces of ``size`` characters or a little more, cut at safe boundaries only."""
    at = 0
    while len(text) - at > size:
        found = _BOUNDARY.search(text, at + size)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def encode_text(enc, text: str | None, size: int = CUT_CHARS) -> Iterator[list[int]]:
    for piece in safe_pieces(text or "", size):
        yield enc.encode_ordinary(piece)


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``token_ids`` array<int>; a column of that name is replaced."""
    kept = without(docs, "token_ids")
    schema = f"{_ddl(kept)}token_ids array<int>"

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [[i for piece in encode_text(enc, t) for i in piece] for t in batch.column(text).to_pylist()]
            yield batch.append_column("token_ids", pa.array(ids, pa.list_(pa.int32())))

    return kept.mapInArrow(run, schema)


def decode(tokens: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids") -> DataFrame:
    """``tokens`` with ``decoded`` binary, the raw bytes of the ids (null ids: null)."""
    kept = without(tokens, "decoded")
    schema = f"{_ddl(kept)}decoded binary"

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [None if i is None else enc.decode_bytes(i) for i in batch.column(ids).to_pylist()]
            yield batch.append_column("decoded", pa.array(raw, pa.binary()))

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, number of ids, SHA-256 of the ids (little-endian unsigned 32 bit) and of the bytes decoded from them.

    One row per input row, repeated keys included. Ids are hashed piece by piece and not kept.
    """
    kept = docs.select(docs[key].alias(key), docs[text].alias("text"))
    schema = f"{_ddl(kept.drop('text'))}n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoding(rank_file, pattern)
        for batch in batches:
            out = []
            for t in batch.column("text"):
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in encode_text(enc, t.as_py()):
                    n += len(ids)
                    of_ids.update(np.array(ids, "<u4").tobytes())
                    of_bytes.update(enc.decode_bytes(ids))
                out.append((n, of_ids.hexdigest(), of_bytes.hexdigest()))
            n, of_ids, of_bytes = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return kept.mapInArrow(run, schema)


def _ddl(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)
