"""Byte-level BPE encoding and decoding over Arrow batches.

A rank file is turned into a model of the ``tokenizers`` library: bytes are
written as printable characters, and every pair of tokens whose bytes joined are
a token is a merge, in rank order. A text is cut into the matches of the pattern;
each distinct match is encoded once per worker and looked up afterwards.
"""

from __future__ import annotations

import base64
import codecs
import functools
import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points of text that are encoded together, and matches that a worker remembers.
BATCH_CHARS = 1 << 18
REMEMBERED = 150_000


@functools.cache
def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it is one, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    table = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def as_characters(token: bytes) -> str:
    table = byte_characters()
    return "".join([table[b] for b in token])


@functools.cache
def _character_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


def as_bytes(token: str) -> bytes:
    table = _character_bytes()
    return bytes([table[c] for c in token])


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: base64 and number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A model of the tokenizers library with the given ranks, as JSON text."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        for cut in range(1, len(token)):
            if token[:cut] in ranks and token[cut:] in ranks:
                merges.append((as_characters(token[:cut]), as_characters(token[cut:])))
    vocab = {as_characters(token): rank for token, rank in ranks.items()}
    # A match that is a token itself is never merged.
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tokenizer.to_str()


class Codec:
    """Encodes texts in one worker."""

    def __init__(self, model: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.matches = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.matches(text) for text in texts]
        new = list(set().union(*cut) - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(set().union(*cut))
        for start in range(0, len(new), 4096):
            self._learn(new[start : start + 4096])
        known = self.known.__getitem__
        return [b"".join(map(known, pieces)) for pieces in cut]


    def _learn(self, pieces: list[str]) -> None:
        """Encode matches, each as a word of its own."""
        found = self.tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        ends = np.searchsorted(found.word_ids, range(len(pieces)), side="right").tolist()
        start = 0
        for piece, end in zip(pieces, ends, strict=True):
            self.known[piece] = ids[4 * start : 4 * end]
            start = end


class Decoder:
    """Decodes ids in one worker: the characters of a token are read back through the byte table."""

    def __init__(self, model: str):
        vocab = json.loads(model)["model"]["vocab"]
        self.token_bytes = {i: as_bytes(token) for token, i in vocab.items()}
        self.token_lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for i, token in self.token_bytes.items():
            self.token_lengths[i] = len(token)

    def offsets(self, text: str, ids: bytes) -> np.ndarray:
        """For each token the first code point its bytes touch and the one after the last."""
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(self.token_lengths[np.frombuffer(ids, "<u4")])
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        return np.stack([character[starts], character[ends - 1] + 1], axis=1)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens; a ValueError for ids that no token has."""
        try:
            return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError as unknown:
            raise ValueError(f"no token has the id {unknown}") from None

    def decode_steps(self, ids: Iterable[int]) -> Iterator[str]:
        """The text each token completes: a character split over tokens comes with the last of them.

        Bytes that are no UTF-8 become U+FFFD; what is left over at the end comes as one more step.
        """
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            yield decoder.decode(self.decode(np.array([i], "<u4").tobytes()))
        if rest := decoder.decode(b"", final=True):
            yield rest


@functools.lru_cache(maxsize=1)
def codec(model: str, pattern: str) -> Codec:
    """One codec for all tasks of a worker."""
    return Codec(model, pattern)


@functools.lru_cache(maxsize=1)
def decoder(model: str) -> Decoder:
    return Decoder(model)


def share(spark: SparkSession, ranks_path: str, pattern: str) -> Broadcast:
    """Model and pattern for the tasks: of a size that the rank file fixes."""
    return spark.sparkContext.broadcast((tokenizer_json(read_ranks(ranks_path)), pattern))


def _runs(lengths: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``BATCH_CHARS`` of text in all."""
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > BATCH_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)


def encode(
    df: DataFrame, shared: Broadcast, text: str = "text", packed: bool = False, offsets: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """Replace ``text`` by ``n_tokens`` and ``token_ids``, without special tokens.

    ``token_ids`` is an array of ints or, if ``packed``, their little-endian bytes,
    4 for each. With ``offsets`` a column ``token_offsets`` holds start and end of
    every token in code points, one after the other; tokens that share a character
    share its place. With ``decoded`` a column of that name holds the bytes that the
    ids decode to. A null text counts as empty and gives no tokens; texts of any
    length are encoded whole. Input columns named like the new ones are replaced,
    all others are kept. No shuffle; a row stays one row.
    """
    added = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("token_ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType())),
        *([T.StructField("token_offsets", T.ArrayType(T.IntegerType()))] if offsets else []),
        *([T.StructField("decoded", T.BinaryType())] if decoded else []),
    ]
    kept = [f for f in df.schema.fields if f.name not in {text, *(a.name for a in added)}]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in column]
            for start, end in _runs(lengths):
                texts = [t or "" for t in column.slice(start, end - start).to_pylist()]
                ids = own.encode(texts)
                out = [pa.array([len(i) // 4 for i in ids], pa.int64())]
                if packed:
                    out.append(pa.array(ids, pa.binary()))
                else:
                    out.append(_lists([np.frombuffer(i, "<i4") for i in ids]))
                if offsets:
                    out.append(_lists([decoder(shared.value[0]).offsets(t, i).ravel() for t, i in zip(texts, ids, strict=True)]))
                if decoded:
                    out.append(pa.array(map(decoder(shared.value[0]).decode, ids), pa.binary()))
                others = [batch.column(k).slice(start, end - start) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*others, *out], [*names, *(a.name for a in added)])

    return df.select(*names, text).mapInArrow(run, T.StructType([*kept, *added]))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def decode(ids: Column, shared: Broadcast) -> Column:
    """The bytes of packed ids; cast to string for the text where they are whole UTF-8."""

    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        own = decoder(shared.value[0])
        return pa.array([None if i is None else own.decode(i) for i in column.to_pylist()], pa.binary())

    return run(ids)


def pack(ids: Column) -> Column:
    """An array of ids as their little-endian bytes."""

    @F.arrow_udf(T.BinaryType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if i is None else np.array(i, "<u4").tobytes() for i in column.to_pylist()], pa.binary())

    return run(ids)
