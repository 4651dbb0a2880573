"""Problem 8: token ids of a byte-level BPE vocabulary for every text.

A sentencepiece BPE model is serialised straight from the rank file: every token
becomes a piece of byte-mapped characters, scored by its negative rank, with
identity normalisation. Texts are split into pre-tokens by the vocabulary's
pattern; each different pre-token of a batch is encoded once by sentencepiece.

Defined cases: a null and an empty text have an empty list of ids; strings of
special tokens are ordinary text; texts of any length are encoded whole."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

#: Where the public vocabulary files lie; the name of the rank file in it.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Different pre-tokens that a worker keeps, and their characters at most.
KEPT, KEPT_CHARS = 200_000, 64
#: Characters of text that are encoded in one step.
SLICE = 500_000


def byte_letters() -> list[str]:
    """A printable character for each byte: itself, or one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value) -> bytes:
    """One protobuf field: int, float32 or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + np.float32(value).tobytes()
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece ids are ranks, <unk> comes after the last."""
    letters = byte_letters()
    size = max(ranks.values()) + 1
    tokens: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(letters[b] for b in token).encode() if token is not None else f"<unused{rank}>".encode()
        body = _field(1, piece) + _field(2, float(-rank))
        out += _field(1, body + _field(3, 5) if token is None else body)
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    out += _field(2, _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1))
    out += _field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0))
    return bytes(out)


class Encoder:
    """Encodes texts with the model made from a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(PATTERN).findall
        letters = byte_letters()
        self.map = {b: letters[b] for b in range(256)}
        self.tokens = {r: t for t, r in ranks.items()}
        self.known: dict[str, np.ndarray] = {}

    def _learn(self, fresh: list[str]) -> dict[str, np.ndarray]:
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.map) for p in fresh]
        return {p: np.array(ids, np.int32) for p, ids in zip(fresh, self.model.encode(mapped, num_threads=1))}

    def encode(self, texts: Iterable[str | None]) -> list[list[np.ndarray]]:
        """For each text the ids of its pre-tokens, one array for each."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > KEPT:
            self.known = {}
        fresh = list(set(chain.from_iterable(split)).difference(self.known))
        extra: dict[str, np.ndarray] = {}
        if fresh:
            learnt = self._learn(fresh)
            extra = {p: v for p, v in learnt.items() if len(p) > KEPT_CHARS}
            self.known.update((p, v) for p, v in learnt.items() if len(p) <= KEPT_CHARS)
        table = {**self.known, **extra} if extra else self.known
        get = table.__getitem__
        return [list(map(get, parts)) for parts in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.tokens[int(i)] for i in ids).decode("utf-8", "surrogatepass")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a rank file, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Batches cut so that each holds about SLICE characters."""
    for batch in batches:
        texts = batch.column(text).to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t) if t else 0
            if size >= SLICE or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """`key, ids array<int>` for every row."""
    path = f"{tokenizers}/{ranks}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            found = encoder(path).encode(texts)
            sizes = [sum(map(len, parts)) for parts in found]
            flat = list(chain.from_iterable(found))
            values = np.concatenate(flat) if flat else np.array([], np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(key), ids], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} long, ids array<int>")


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """`key, n_tokens` for every row; 0 for a null or empty text."""
    path = f"{tokenizers}/{ranks}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            sizes = [sum(map(len, parts)) for parts in encoder(path).encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sizes, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} long, n_tokens long")
