"""Byte-pair encoding and decoding of whole texts.

A piece is encoded by a priority queue of merge ranks over a doubly linked list
of symbols: the pair of least rank (then leftmost) is merged, its neighbours'
new pairs join the queue, and entries whose symbols have changed since are
skipped when they come up. Decoding concatenates vocabulary strings.

A codec is built from a tokenizer file of one of two public families (JSON of
type BPE): byte-level with word ends, lower-cased and without white space, or
byte-level with leading spaces. Its output equals that of the tokenizers library
with add_special_tokens=False; special strings within a text become their ids.
"""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

#: Entries of a generation of a codec's caches.
CACHE = 250_000
#: White space of Unicode, as the library's expressions see it (str.split would also cut at \x1c-\x1f).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The symbols after all merges that apply, least rank first."""
    n = len(symbols)
    if n < 2:
        return symbols
    before, after, text = [*range(-1, n - 1)], [*range(1, n), -1], list(symbols)
    queue = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if j < 0 or text[i] != left or text[j] != right:
            continue  # stale: one of the two has been merged since
        text[i], text[j] = left + right, ""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((text[i], text[k]))) is not None:
                heapq.heappush(queue, (r, i, text[i], text[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((text[h], text[i]))) is not None:
            heapq.heappush(queue, (r, h, text[h], text[i]))
    out, i = [], 0
    while i >= 0:
        out.append(text[i])
        i = after[i]
    return out


class _Cache(dict):
    """A dict that computes what it lacks. When it is full its entries become the old generation, from which those
    used again return; so memory is bounded by two generations and frequent keys stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encodes and decodes by one tokenizer file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model["byte_fallback"] or model["unk_token"] or model["continuing_subword_prefix"]:
            raise ValueError(f"{path} is not a byte-level BPE")
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens of a kind that isn't handled")
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if kinds not in ([], ["NFC", "Replace", "Lowercase"]):
            raise ValueError(f"{path} has a normalizer that isn't handled")
        self.lowers = bool(kinds)
        if self.lowers:
            self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+")
        else:
            self.pieces = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
        self.white = regex.compile(f"[{WHITE}]+")
        self.odd_white = regex.compile(f"[{WHITE}][ \n]|[ \n][{WHITE}]|[{WHITE[:1]}{WHITE[2:5]}{WHITE[6:]}\0]|^[ \n]|[ \n]$")
        self.strings = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.spaced = spec["decoder"] is None
        if not self.spaced and spec["decoder"]["type"] != "ByteLevel":
            raise ValueError(f"{path} has a decoder that isn't handled")
        bytes_of = {c: b for b, c in self.letters.items()}
        self.raw = {i: t.encode() if t in self.special else bytes(bytes_of[c] for c in t) for i, t in self.strings.items()} if not self.spaced else {}
        self.by_piece = _Cache(self._encode_piece)
        self.by_chunk = _Cache(lambda chunk: array("I", self.encode_slowly(chunk)).tobytes())

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        symbols = [self.letters[b] for b in piece.encode("utf-8", "replace")]
        if self.suffix:
            symbols[-1] += self.suffix
        return tuple(self.vocab[s] for s in merge(symbols, self.ranks))

    def _encode_plain(self, text: str) -> list[int]:
        """Ids of a text that holds no special string."""
        if self.lowers:
            # letter by letter, as the library does: no final sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [i for p in self.pieces.findall(text) for i in self.by_piece[p]]

    def encode_slowly(self, text: str) -> list[int]:
        """Ids of any text: special strings first, then pieces."""
        if self.special_at is None or not self.special_at.search(text):
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += self._encode_plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._encode_plain(text[at:])

    def chunks(self, text: str) -> list[str]:
        """Stretches whose ids, one after another, are those of the whole text.

        With word ends no piece holds white space, so a text falls apart at all of it. With leading spaces, a text
        whose white space is single spaces and line feeds between other characters falls apart before each; any
        other text is one stretch.
        """
        if self.lowers:
            return [c for c in self.white.split(text) if c] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        if not text:
            return []
        if self.odd_white.search(text):
            return [text]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit little-endian integers."""
        return np.frombuffer(b"".join(map(self.by_chunk.__getitem__, self.chunks(text))), "<u4")

    def count(self, text: str) -> int:
        return sum(map(len, map(self.by_chunk.__getitem__, self.chunks(text)))) // 4

    def decode(self, ids) -> str:
        """The vocabulary strings one after another: as bytes of UTF-8, or, where the file names no decoder, with one
        space between. Unknown ids are left out."""
        if self.spaced:
            return " ".join([self.strings[i] for i in ids.tolist() if i in self.strings] if isinstance(ids, np.ndarray) else [self.strings[i] for i in ids if i in self.strings])
        return b"".join([self.raw[i] for i in map(int, ids) if i in self.raw]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Adds ids (array<bigint>) and decoded (string) to a table with a `text` column.

    Null text counts as empty: no ids, decoded is empty. Whole texts are encoded, however long. Columns of the
    input stay, but for ids and decoded, which are replaced. Equal rows get equal results; an empty table gives
    an empty one. No row depends on another, so nothing is shuffled.
    """
    kept = docs.drop("ids", "decoded")
    names = [*kept.columns, "ids", "decoded"]
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.LongType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = [c.encode(t or "") for t in part.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate([*ids, np.array([], "<u4")]).astype(np.int64))
                decoded = pa.array([c.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), values), decoded], names)

    return kept.mapInArrow(run, schema)
