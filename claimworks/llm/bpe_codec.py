"""Byte-level BPE through a sentencepiece model that is written directly from a rank file.

A rank file lists byte strings by merge rank. Each byte becomes one printable character, each byte string a piece whose
score is its negative rank, so the highest-scored merge of sentencepiece is the lowest-ranked merge of the rank file; both
take the leftmost of equal ones. The normaliser is the identity. A text is first cut by the pattern of the vocabulary and
each piece of the cut is encoded alone. Decoding maps each id back to its bytes.

Defined results: null and empty texts have no ids and decode to nothing; repeated rows are encoded alike, a row each;
other columns of the input are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from claimworks.llm import _tables

#: Distinct chunks that a worker remembers before it starts afresh.
CACHE = 500_000
#: Characters beyond which a word is not remembered, so that the cache is bounded in bytes.
LONG = 64
VOCABULARY = "byte_bpe_50k.tiktoken"


def byte_letters() -> list[str]:
    """A visible character for every byte: printable Latin-1 stands for itself, the rest move above U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(pieces: list[str]) -> bytes:
    """A sentencepiece ModelProto of these pieces in rank order, with an unknown piece after the last."""
    import struct

    def piece(text: str, score: float, kind: int) -> bytes:
        return _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    body = b"".join(piece(p, -float(i), 1) for i, p in enumerate(pieces)) + piece("<unk>", 0.0, 2)
    trainer = _number(3, 2) + _number(4, len(pieces) + 1) + _number(40, len(pieces)) + b"".join(_number(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _field(2, trainer) + _field(3, normaliser)


#: Number of ids, the ids in decimal joined by spaces, the bytes that the ids decode to.
Chunk = tuple[int, str, bytes]
_LOOSE = re.compile(r" \s| \Z").search


class Codec:
    """Encoder and decoder of one vocabulary file in rank format."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens: list[bytes] = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in self.tokens] != list(range(len(ranks))):
            raise ValueError(f"{path}: ranks must run from 0 without gaps")
        self.letters = byte_letters()
        self._map = {b: letter for b, letter in enumerate(self.letters)}
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise([self._spell(t) for t in self.tokens]))
        self._find = regex.compile(pattern).findall
        self._known: dict[str, Chunk] = {}

    def _spell(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self._map)

    def chunks(self, text: str) -> list["Chunk"]:
        """The text's ids and bytes by chunk. A pre-token always begins at a space that stands before anything but white
        space, so a text may be cut there and each cut remembered; where a space stands before white space, the text stays whole.
        """
        if not text:
            return []
        if _LOOSE(text):
            return self._made([text])
        known = self._known
        if len(known) > CACHE:
            known.clear()
        words = text.split(" ")
        words[0] = "\n" + words[0]  # no word elsewhere has white space after its space
        new = [w for w in set(words) if w not in known]
        if new:
            known.update(zip(new, self._made([w[1:] if w is words[0] else " " + w for w in new])))
        out = [known[w] for w in words]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def _made(self, texts: list[str]) -> list["Chunk"]:
        """The chunk of each text; the model sees the pre-tokens of all in one call."""
        cuts = list(map(self._find, texts))
        found = iter(self._model.encode([t.encode().decode("latin-1").translate(self._map) for cut in cuts for t in cut], num_threads=1))
        out = []
        for cut in cuts:
            ids = next(found) if len(cut) == 1 else [i for _ in cut for i in next(found)]
            out.append((len(ids), " ".join(map(str, ids)), self.decode(ids)))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in self.chunks(text) for i in c[1].split()]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def codec(vocabulary: str = VOCABULARY) -> Codec:
    """The codec of a file of public_tokenizers, or of a path; one for each worker process."""
    import public_tokenizers

    return Codec(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), _pattern())


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: the token ids of every text."""

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, content: the bytes that the ids stand for."""

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.decode(i or ()) for i in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode() followed by decode(), in one pass and without moving ids."""

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for text in b.column(1).to_pylist():
                chunks = c.chunks(text or "")
                n.append(sum([k[0] for k in chunks]))
                of_ids.append(hashlib.sha256(" ".join([k[1] for k in chunks if k[0]]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(b"".join([k[2] for k in chunks])).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_tables.read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_byte_bpe": op8_byte_bpe}
