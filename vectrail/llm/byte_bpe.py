"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The vocabulary is a file of ranks whose path is a parameter. A text's matches of the split pattern are
encoded each by itself, so equal matches have equal ids: a bounded table of matches already encoded is
kept for each Python worker, and only new ones go to the library, many in one call.

Defined results: a null text counts as empty and has no tokens; every text is encoded whole; equal rows
give equal results; strings that look like special tokens are ordinary text; columns other than the
text and those kept by name are neither read nor changed.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from vectrail.llm import common

#: Matches kept in a worker's table, and the longest kept; beyond the count the table starts anew.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 40
#: A space between white space, or between white space and the end.
WIDE_SPACE = re.compile(r"\s (?:\s|\Z)").search


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    held = set(plain)
    shifted = iter(range(256, 512))
    return [chr(b) if b in held else chr(next(shifted)) for b in range(256)]


def words_of(text: str) -> list[str]:
    """The text cut before each of its spaces."""
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that lower ranks leave of a token: its merge rule."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.alphabet = byte_alphabet()
        self.to_chars = {b: c for b, c in enumerate(self.alphabet)} | {0xFF: "\n"}
        spell = lambda raw: "".join(map(self.alphabet.__getitem__, raw))
        merges = [tuple(map(spell, merge_of(t, ranks))) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        self.library = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.width = np.array(list(map(len, self.bytes_of)))
        self.start = np.cumsum(self.width) - self.width
        self.library.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.matches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of matches as little-endian bytes. The library gets many at once, parted by a character
        that stands for no byte (0xFF, which UTF-8 never holds, marks it until bytes become characters)."""
        raws, out = list(map(str.encode, pieces)), {}
        runs = range(0, len(pieces), 64)
        spelled = [b"\xff".join(raws[i : i + 64]).decode("latin-1").translate(self.to_chars) for i in runs]
        for i, got in zip(runs, self.library.encode_batch_fast(spelled, add_special_tokens=False)):
            ids = np.array(got.ids, dtype="<u4")
            covered, lengths = np.cumsum(self.width[ids]), np.cumsum(list(map(len, raws[i : i + 64])))
            raw, ends = ids.tobytes(), (np.searchsorted(covered, lengths, side="right") * 4).tolist()
            out.update(zip(pieces[i : i + 64], [raw[x:y] for x, y in zip([0, *ends], ends)]))
        return out

    def parts(self, word: str) -> list[str]:
        """The matches in a word; a word of letters, with a mark behind or not, needs no search."""
        if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()):
            return [word]
        if word[-1:] in (".", ",") and word[1:-1].isalpha() and (word[0] == " " or word[0].isalpha()):
            return [word[:-1], word[-1]]
        return self.find(word)

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        A space ends the match before it and begins the next one unless white space stands on both of
        its sides, so texts without such a space are taken word by word; the others match by match.
        """
        for held in (self.matches, self.words):
            if len(held) > CACHE_ENTRIES:
                held.clear()
        plain = [not WIDE_SPACE(x) for x in batch]
        split = [words_of(x) if p else self.find(x) for x, p in zip(batch, plain)]
        parts = {w: self.parts(w) for w in set().union(*(s for s, p in zip(split, plain) if p)).difference(self.words)}
        wanted = set().union(*parts.values(), *(s for s, p in zip(split, plain) if not p))
        new = list(wanted.difference(self.matches))
        for i in range(0, len(new), 50_000):
            self.matches.update(self.learn(new[i : i + 50_000]))
        match, word = self.matches.__getitem__, self.words.__getitem__
        self.words.update((w, match(m[0]) if len(m) == 1 else b"".join(map(match, m))) for w, m in parts.items())
        out = [b"".join(map(word if p else match, s)) for s, p in zip(split, plain)]
        for held, added in ((self.matches, new), (self.words, parts)):
            for k in added:
                if len(k) > CACHE_CHARS:
                    del held[k]
        return out

    def pieces(self, ids: bytes) -> list[bytes]:
        return list(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids: bytes) -> bytes:
        """The bytes behind ids. One id may hold a part of a character: only their join is text."""
        at = np.frombuffer(ids, dtype="<u4")
        width = self.width[at]
        ends = np.cumsum(width)
        where = np.repeat(self.start[at] - (ends - width), width)
        where += np.arange(len(where))
        return self.flat[where].tobytes()

    def offsets(self, ids: bytes) -> list[tuple[int, int]]:
        """Of each id, the half-open range of characters that its bytes touch; a split character counts for all its ids."""
        spans, done, chars = [], 0, 0
        whole = self.decode(ids)
        first = np.cumsum([0] + [(b & 0xC0) != 0x80 for b in whole])
        for piece in self.pieces(ids):
            end = done + len(piece)
            lead = int(first[done]) - (1 if done < len(whole) and (whole[done] & 0xC0) == 0x80 else 0)
            spans.append((lead, int(first[end])))
            done, chars = end, chars + 1
        return spans


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_offsets: bool = False) -> DataFrame:
    """ids array<long> for each text, and with_offsets their character ranges as starts and ends."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", ids array<bigint>"
    if with_offsets:
        schema += ", starts array<int>, ends array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x for part in common.texts(b.column(text)) for x in codec(path).encode(part)]
            cols = [b.column(c) for c in keep] + [pa.array([np.frombuffer(x, dtype="<u4").astype(np.int64) for x in ids], pa.list_(pa.int64()))]
            if with_offsets:
                spans = [codec(path).offsets(x) for x in ids]
                cols += [pa.array([[s[k] for s in x] for x in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "ids", *(["starts", "ends"] if with_offsets else [])])

    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """raw binary for each list of ids (null: empty)."""
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", raw binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [codec(path).decode(np.asarray(x.as_py() or [], dtype="<u4").tobytes()) for x in b.column(ids)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(raw, pa.binary())], names=[*keep, "raw"])

    return df.select(*keep, ids).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text, and return digests instead of the ids and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids, back, counts = [], [], []
            for part in common.texts(b.column("text"), 2_000_000):
                for x in codec(path).encode(part):
                    counts.append(len(x) // 4)
                    ids.append(sha(x))
                    back.append(sha(codec(path).decode(x)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), vocabulary_path())
