"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a worker remembers with their ids before it forgets all of them.
CACHE_WORDS = 300_000
#: Texts of these characters are split here; others are split by the library itself.
PLAIN = regex.compile("[\x00-ɏ]*")


def byte_chars() -> dict[str, int]:
    """The byte behind each of the 256 characters that byte-level vocabularies are written in."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def token_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back, table = byte_chars(), [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return table


def char_offsets(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets of tokens from their sizes in bytes.

    A token starts at the character that holds its first byte and ends behind the one that
    holds its last; the tokens of one split character share that character.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes].astype(np.int32), (char[ends - 1] + 1).astype(np.int32)


class Encoder:
    """Ids of whole texts; equal words are encoded once and remembered for a while."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.split = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        back = {b: c for c, b in byte_chars().items()}
        self.chars = str.maketrans({b: back[b] for b in range(256)})

    def __call__(self, texts: list[str]) -> list[list[int]]:
        words = [self.split.findall(t) if PLAIN.fullmatch(t) else None for t in texts]
        merge, known = self.lib.model.tokenize, self.known
        for w in {w for ws in words if ws for w in ws}.difference(known):
            # the vocabulary is written in characters that stand for bytes
            known[w] = tuple(t.id for t in merge(w.encode().decode("latin-1").translate(self.chars)))
        other = iter(self.lib.encode_batch_fast([t for t, ws in zip(texts, words, strict=True) if ws is None], add_special_tokens=False))
        found = [next(other).ids if ws is None else list(chain.from_iterable(map(known.__getitem__, ws))) for ws in words]
        if len(known) > CACHE_WORDS:
            known.clear()
        return found


def slices(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(documents: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True, decoded: bool = False) -> DataFrame:
    """Encode every whole text; one row a row of the input.

    Returns ``doc_id, ids array<int>`` and with ``offsets`` also ``starts, ends array<int>``, the
    characters (code points, end exclusive) that each token covers; with ``decoded`` also ``decoded
    binary``, the bytes that the ids decode to, for a round trip in one pass. A null text counts as empty
    and an empty text has no tokens; strings of special tokens are ordinary text; texts of any
    length are encoded whole; repeated rows are kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, table = Encoder(path, pattern), token_bytes(path)
        sizes = np.array([len(b) for b in table], dtype=np.int64)
        for batch in batches:
            all_texts = batch.column(1).to_pylist()
            for a, b in slices(all_texts):
                ids = enc(all_texts[a:b])
                off = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32)
                out = {"doc_id": batch.column(0).slice(a, b - a), "ids": pa.ListArray.from_arrays(off, pa.array(flat))}
                if offsets:
                    spans = [char_offsets(t.encode(), sizes[np.array(x, np.int64)]) for t, x in zip(all_texts[a:b], ids, strict=True)]
                    for name, side in (("starts", 0), ("ends", 1)):
                        out[name] = pa.ListArray.from_arrays(off, pa.array(np.concatenate([s[side] for s in spans])))
                if decoded:
                    out["decoded"] = pa.array([b"".join(map(table.__getitem__, x)) for x in ids], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decoded)


def decode(encoded: DataFrame, path: str, keep: list[str] | None = None, text: bool = True) -> DataFrame:
    """Decode ``ids`` back: ``doc_id, decoded binary``, with ``text`` also ``text string``, and the columns in ``keep``.

    The bytes of all tokens are joined before they are read as UTF-8, so characters split over
    tokens come out whole; bytes that are no UTF-8 become U+FFFD in ``text`` and stay in
    ``decoded``. Null ids, null elements and ids outside the vocabulary decode to nothing.
    """
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dict(enumerate(token_bytes(path)))
        for batch in batches:
            found = [b"".join(table.get(i, b"") for i in x.values.to_pylist()) if x.is_valid else b"" for x in batch.column(1)]
            out = {"doc_id": batch.column(0), "decoded": pa.array(found, pa.binary())}
            if text:
                out["text"] = pa.array([b.decode("utf-8", "replace") for b in found], pa.string())
            yield pa.RecordBatch.from_pydict(out | {k: batch.column(2 + i) for i, k in enumerate(keep)})

    kinds = dict(encoded.dtypes)
    return encoded.select("doc_id", "ids", *keep).mapInArrow(run, ", ".join(["doc_id long", "decoded binary", *["text string"] * text, *(f"`{k}` {kinds[k]}" for k in keep)]))


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes that they decode to."""
    import public_tokenizers as tokenizers_dir

    from .common import table

    path = tokenizers_dir.path("byte_bpe_50k.json")
    ids = encode(table(spark, sf_dir, "documents"), path, tokenizers_dir.PATTERN, offsets=False, decoded=True)
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
