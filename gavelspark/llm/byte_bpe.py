"""Byte-level BPE encoding and decoding over Arrow batches.

A text is cut by the public pattern; each distinct match goes, byte for character, through the tokenizers library once (its ids are then kept as little-endian bytes), so that a batch is one join of byte strings a document. Decoding is a gather in a table of token bytes, which the library's byte-to-character alphabet is reversed into.

Defined results: a null text is the empty text: no ids, empty bytes. Every text is encoded whole; strings that look like special tokens are ordinary text. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import pick, table

#: Distinct matches kept in a worker before the memory of them starts anew, and the longest that is kept.
KEPT, LONGEST = 400_000, 64


def byte_alphabet() -> dict[str, int]:
    """Character to byte: printable Latin-1 stands for itself, the other bytes are numbered from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(other)}


class _Kept(dict):
    """From a match to its ids; a match that is not kept goes through the library."""

    def __init__(self, tokenize) -> None:
        self.tokenize, self.characters = tokenize, {b: c for c, b in byte_alphabet().items()}

    def __missing__(self, match: str) -> bytes:
        ids = array("I", [t.id for t in self.tokenize(match.encode().decode("latin-1").translate(self.characters))])
        if sys.byteorder == "big":
            ids.byteswap()
        out = ids.tobytes()
        if len(match) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[match] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary file; made once in a worker."""

    def __init__(self, path: str, pattern: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.cut = regex.compile(pattern).findall
        self.kept = _Kept(library.model.tokenize)
        back = byte_alphabet()
        vocab = library.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            tokens[i] = bytes(back[c] for c in s) if all(c in back for c in s) else s.encode()
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.table = np.frombuffer(b"".join(tokens), np.uint8)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.kept.__getitem__, self.cut(text)))

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        return self.table[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1])].tobytes()

    def offsets(self, ids: np.ndarray, decoded: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last character that each token touches; tokens that share a split character all have it."""
        at = np.cumsum(np.frombuffer(decoded, np.uint8) & 0xC0 != 0x80)
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return at[ends - n] - 1, at[ends - 1]

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each id completes: bytes of a split character wait for the rest of it."""
        held = b""
        for i in ids:
            held += self.table[self.starts[i] : self.starts[i] + self.lengths[i]].tobytes()
            whole = len(held)
            for back in range(1, min(4, len(held)) + 1):
                if (b := held[-back]) & 0xC0 == 0xC0:
                    whole -= back if back < 2 + (b >= 0xE0) + (b >= 0xF0) else 0
                    break
                if b < 0x80:
                    break
            yield held[:whole].decode("utf-8", "replace")
            held = held[whole:]
        if held:
            yield held.decode("utf-8", "replace")


_made: dict[tuple[str, str], Codec] = {}


def codec(path: str | None = None, pattern: str | None = None) -> Codec:
    """The worker's codec; by default the public 50k vocabulary and pattern."""
    import public_tokenizers as P

    key = (path or P.path("byte_bpe_50k.json"), pattern or P.PATTERN)
    if key not in _made:
        _made[key] = Codec(*key)
    return _made[key]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids; with offsets also starts and ends (in characters) of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ids = [np.frombuffer(c.ids(t.as_py() or ""), "<u4") for t in b.column("text")]
                out = [b.column("doc_id"), _lists(ids)]
                if with_offsets:
                    both = [c.offsets(i, c.decode(i)) if len(i) else (i, i) for i in ids]
                    out += [_lists([x for x, _ in both]), _lists([x for _, x in both])]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "starts", "ends"][: len(out)])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * with_offsets)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate(rows).astype(np.int32) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(values))


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (bytes) of a frame with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = b.column("ids")
            flat, cuts = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            out = [c.decode(flat[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and the ids decoded again, in one pass of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column("text"):
                ids = c.ids(t.as_py() or "")
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_checked(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, and whole: do the ids decode to the text's bytes?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [t.as_py() or "" for t in b.column("text")]
                ids = [np.frombuffer(c.ids(t), "<u4") for t in texts]
                same = [c.decode(i) == t.encode() for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), _lists(ids), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "whole"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, whole boolean")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
