"""Byte-level BPE encoding and decoding through a sentencepiece model made from ranks.

The vocabulary file lists byte strings with ranks. Each becomes a piece whose bytes are
mapped to printable characters and whose score is the negative rank; normalisation is the
identity. Merging the adjacent pair of best score, leftmost first, is then merging by
lowest rank. Every pre-token (a match of the split pattern) is encoded on its own; one
that is itself in the vocabulary is that id. Decoding maps ids back to byte strings.

The model is serialised on the driver (one vocabulary file, tens of thousands of entries,
a few MB) and broadcast. A task keeps the ids of short pre-tokens in a table that is
emptied when it is full and given up with the task, so a reused worker holds nothing.

Defined results: a null or empty text has no ids and decodes to nothing. Text is encoded
as UTF-8. Repeated rows are encoded each; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

KNOWN = 250_000  # entries of a task's table before it is emptied, about 60 MB
SHORT = 64  # longest pre-token that is kept there, in characters

# A split pattern of Unicode classes and its equal in the standard library's classes for
# texts of the characters below, on which letters, digits and blanks mean the same in both.
UNICODE_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_SPLIT = re.compile(r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
LATIN = bytes([0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0xC0, 0x100)])


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(0x100 + rest.index(b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in rank order of a rank file ("base64 rank" per line)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(piece)) for piece, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [piece for _, piece in ranked]


def model_bytes(pieces: list[bytes]) -> bytes:
    """Serialised sentencepiece BPE model; piece id = rank + 1, id 0 is the unknown piece."""
    letters = byte_characters()
    model = model_pb2.ModelProto()
    unknown = model.pieces.add()
    unknown.piece, unknown.score, unknown.type = "<unk>", 0.0, model_pb2.ModelProto.SentencePiece.UNKNOWN
    for rank, piece in enumerate(pieces):
        entry = model.pieces.add()
        entry.piece, entry.score = "".join(letters[b] for b in piece), -float(rank)
        entry.type = model_pb2.ModelProto.SentencePiece.NORMAL
    model.trainer_spec.model_type = model_pb2.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(pieces) + 1
    model.trainer_spec.unk_id, model.trainer_spec.bos_id = 0, -1
    model.trainer_spec.eos_id, model.trainer_spec.pad_id = -1, -1
    rules = model.normalizer_spec
    rules.name, rules.add_dummy_prefix = "identity", False
    rules.remove_extra_whitespaces, rules.escape_whitespaces = False, False
    return model.SerializeToString()


@dataclass
class Codec:
    """Encoder and decoder of one task."""

    model: bytes
    pieces: list[bytes]
    pattern: str

    def __post_init__(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        self.letters = {b: c for b, c in enumerate(byte_characters())}
        self.rank = {piece: i for i, piece in enumerate(self.pieces)}
        self.own = list(range(-1, len(self.pieces)))  # id of a model's piece: one object for each, however many entries hold it
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def tokens(self, text: str) -> list[str]:
        """Pre-tokens of a text, in order."""
        if self.pattern == UNICODE_SPLIT:
            try:
                if not text.encode("latin-1").translate(None, LATIN):
                    return LATIN_SPLIT.findall(text)
            except UnicodeEncodeError:
                pass
        return self.split(text)

    def _keep(self, token: str, ids: tuple[int, ...]) -> None:
        self.known[token] = ids, ",".join(map(str, ids))

    def _learn(self, tokens: list[str]) -> None:
        """Ids of pre-tokens that the table lacks."""
        hard = []
        for token in tokens:
            whole = self.rank.get(token.encode("utf-8", "surrogatepass"))
            if whole is not None:
                self._keep(token, (whole,))
            else:
                hard.append(token)
        if hard:
            mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters) for t in hard]
            for token, ids in zip(hard, self.encoder.encode(mapped, num_threads=1), strict=True):
                self._keep(token, tuple(map(self.own.__getitem__, ids)))

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids, and the same in decimals joined by commas."""
        tokens, known = self.tokens(text), self.known
        missing = {t for t in tokens if t not in known}
        if missing:
            if len(known) + len(missing) > KNOWN:
                known.clear()
                missing = set(tokens)
            self._learn(list(missing))
        ids: list[int] = []
        written = []
        for token in tokens:
            own, decimals = known[token]
            ids += own
            written.append(decimals)
        for token in missing:
            if len(token) > SHORT:
                del known[token]
        return ids, ",".join(written)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str], text: str = "text", ids: bool = True) -> DataFrame:
    """`keep` columns with n_tokens, the ids (unless ids=False), the SHA-256 of the decimal
    ids joined by commas and the SHA-256 of the bytes decoded from the ids."""
    pieces = read_ranks(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((model_bytes(pieces), pieces))
    given = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    out = given.select(*keep).schema
    if ids:
        out = out.add("ids", T.ArrayType(T.IntegerType(), False))
    out = out.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                all_ids, counts, names, plain = [], [], [], []
                for text_ in part.column(len(keep)):
                    found, written = codec.encode(text_.as_py())
                    counts.append(len(found))
                    names.append(hashlib.sha256(written.encode()).hexdigest())
                    plain.append(hashlib.sha256(codec.decode(found)).hexdigest())
                    if ids:
                        all_ids.append(found)
                columns = [*part.columns[: len(keep)], *([pa.array(all_ids, pa.list_(pa.int32()))] if ids else []), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(plain, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return given.mapInArrow(encoded, out)


def decode(tokens: DataFrame, vocabulary: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """Texts of id lists; ids that cut a character give U+FFFD there, null ids an empty text."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    given = tokens.select(*keep, ids)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            texts = [b"".join(map(pieces.__getitem__, x.as_py() or [])).decode("utf-8", "replace") for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    return given.mapInArrow(decoded, given.select(*keep).schema.add("text", "string"))
