"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: After a non-space and before one space and a non-space every match of the pattern ends.
_SAFE = regex.compile(r"(?<=\S)(?= \S)")
_CODERS: dict = {}


def coder(path: str, pattern: str):
    """The tiktoken encoding of a rank file, once for each worker process."""
    if (path, pattern) not in _CODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _CODERS[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path, pattern]


def pieces(text: str, size: int) -> Iterator[str]:
    """Cuts a long text near every `size` characters, where the pattern can't match across."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc, text: str, size: int) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in pieces(text, size):
        out += enc.encode_ordinary(piece)
    return out


def encode_bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = 1 << 16) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text, without special tokens.

    Null and empty texts give an empty list; long texts are encoded piece by piece, cut where no match of the
    pattern crosses (before a single space between two non-spaces); a text without such a place is encoded in one piece,
    with memory for all of it. Strings of special tokens are ordinary text. Null ids and repeated rows stay as they are;
    other columns are not read.
    """

    def run(batches):
        enc = coder(path, pattern)
        for batch in batches:
            ids = [encode_text(enc, t or "", piece_chars) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_bpe(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary): the raw bytes of lists of ids; ids may end inside a UTF-8 character."""

    def run(batches):
        enc = coder(path, pattern)
        for batch in batches:
            data = [enc.decode_bytes(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    kind = coded.schema["doc_id"].dataType.simpleString()
    return coded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, data binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = 1 << 16) -> DataFrame:
    """encode_bpe and decode_bpe of every text in one pass, as digests: neither ids nor bytes leave the worker.

    Null and empty texts have no tokens; null ids and repeated rows stay as they are; other columns are not read.
    """

    def run(batches):
        enc = coder(path, pattern)
        names = [str(i) for i in range(enc.max_token_value + 1)]
        for batch in batches:
            counts, ids_sha, raw_sha = [], [], []
            for text in batch.column(1):
                ids = encode_text(enc, text.as_py() or "", piece_chars)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                raw_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(raw_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
