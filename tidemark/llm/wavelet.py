"""Token ids in wavelet-matrix shards: one compressed file image per shard, with access, counting and occurrence lookup.

Documents are dealt to ranges of ids, encoded in order and cut into shards. A shard keeps its ids as bit-planes, most
significant first, each plane after a stable partition by the plane before; a directory of set bits per 512 positions,
which is part of the file, answers rank by one look and select by binary search; planes are packed in pieces, of which a
look-up unpacks one of each plane. Shards are rows of a table that Spark writes and reads, so any store that Spark reaches
will do, and a lost executor's shards are written again.
"""

from __future__ import annotations

import struct
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

MAGIC = b"TWM2"
BLOCK = 512
#: Bytes of a plane that are packed together: a look-up unpacks one such piece of each plane.
PIECE = 4096
END = 1


class WaveletMatrix:
    """A sequence of ids below 2^bits: bit-planes, and for each the number of set bits before every block of 512 positions.

    Planes are whole (`planes`) or lie in packed pieces that are unpacked when they are asked for.
    """

    def __init__(self, n: int, bits: int, directory: np.ndarray, planes: list[np.ndarray] | None = None, packed: list[list[bytes]] | None = None):
        self.n, self.bits, self.directory, self._planes, self._packed = n, bits, directory, planes, packed
        self._pieces: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, directory = [], np.zeros((bits, -(-len(ids) // BLOCK) + 1), np.uint32)
        for level, b in enumerate(range(bits - 1, -1, -1)):
            one = ((ids >> np.asarray(b, ids.dtype)) & np.asarray(1, ids.dtype)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            if len(ids):
                directory[level, 1:] = np.cumsum(np.add.reduceat(np.bitwise_count(planes[-1]).astype(np.uint32), np.arange(0, len(planes[-1]), BLOCK // 8)))
            ids = np.concatenate([ids[~one], ids[one]])
        return cls(len(ids), bits, directory, planes)

    @property
    def planes(self) -> list[np.ndarray]:
        """All planes unpacked."""
        if self._planes is None:
            self._planes = [np.frombuffer(b"".join(self._unpacked(p) for p in pieces), np.uint8) for pieces in self._packed]
        return self._planes

    @staticmethod
    def _unpacked(piece: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(piece, max_output_size=PIECE)

    def _bytes(self, level: int, lo: int, hi: int) -> np.ndarray:
        """Bytes lo to hi - 1 of a plane, within one piece."""
        if self._planes is not None:
            return self._planes[level][lo:hi]
        at = level, lo // PIECE
        if at not in self._pieces:
            self._pieces[at] = np.frombuffer(self._unpacked(self._packed[level][at[1]]), np.uint8)
        return self._pieces[at][lo - at[1] * PIECE : hi - at[1] * PIECE]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up."""
        out = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = self._zeros(level)
            before = np.empty_like(out)
            before[~one] = out[:zeros]
            before[one] = out[zeros:] | out.dtype.type(1 << (self.bits - 1 - level))
            out = before
        return out

    def _zeros(self, level: int) -> int:
        return self.n - int(self.directory[level, -1])

    def _rank1(self, level: int, i: int) -> int:
        block = i // BLOCK
        if i % BLOCK == 0:
            return int(self.directory[level, block])
        part = np.unpackbits(self._bytes(level, block * (BLOCK // 8), -(-i // 8)), bitorder="little")
        return int(self.directory[level, block]) + int(part[: i - block * BLOCK].sum())

    def _ranks(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each of many positions."""
        plane = self.planes[level]
        before = np.zeros(len(plane) + 1, np.int64)
        np.cumsum(np.bitwise_count(plane), out=before[1:])
        byte = at >> 3
        last = np.append(plane, np.uint8(0))[byte]
        return before[byte] + np.bitwise_count(last & ((1 << (at & 7)) - 1).astype(np.uint8))

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit: a binary search over the directory, then one block."""
        ones = self.directory[level].astype(np.int64)
        upto = ones if bit else np.minimum(np.arange(len(ones), dtype=np.int64) * BLOCK, self.n) - ones
        block = int(np.searchsorted(upto, k, "right")) - 1
        part = np.unpackbits(self._bytes(level, block * (BLOCK // 8), (block + 1) * (BLOCK // 8)), bitorder="little")[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(upto[block])])

    def access(self, i: int) -> int:
        out = 0
        for level in range(self.bits):
            bit = int(self._bytes(level, i // 8, i // 8 + 1)[0]) >> (i % 8) & 1
            ones = self._rank1(level, i)
            i = self._zeros(level) + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def count(self, token: int, lo: int, hi: int) -> int:
        """How often the token stands in positions lo to hi - 1."""
        a, b = self._interval(token, lo, hi)
        return b - a

    def counts(self, token: int, bounds: np.ndarray) -> np.ndarray:
        """How often the token stands between each of ascending positions and the next."""
        at = np.asarray(bounds, np.int64)
        for level in range(self.bits):
            ones = self._ranks(level, at)
            at = self._zeros(level) + ones if token >> (self.bits - 1 - level) & 1 else at - ones
        return np.diff(at)

    def _interval(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            zeros = self._zeros(level)
            lo, hi = (zeros + a, zeros + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def occurrence(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence (from 0), -1 if there are fewer."""
        lo, hi = self._interval(token, 0, self.n)
        if k >= hi - lo:
            return -1
        i = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self._zeros(level) if bit else i)
        return i

    def to_bytes(self, doc_ids: list[int], lengths: list[int]) -> bytes:
        """Head, ids and lengths of documents, the directory, sizes of the packed pieces, and the pieces, plane by plane."""
        packer = zstandard.ZstdCompressor(level=1)
        pieces = [packer.compress(p[at : at + PIECE].tobytes()) for p in self.planes for at in range(0, len(p), PIECE)]
        head = struct.pack("<4sQIB", MAGIC, self.n, len(doc_ids), self.bits)
        meta = np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes() + self.directory.astype("<u4").tobytes() + np.asarray([len(p) for p in pieces], "<u4").tobytes()
        return head + meta + b"".join(pieces)

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray]:
        magic, n, docs, bits = struct.unpack_from("<4sQIB", blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize("<4sQIB")

        def array_of(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, count, at)
            at += out.nbytes
            return out

        ids, lengths = array_of("<i8", docs), array_of("<u4", docs)
        blocks, many = -(-n // BLOCK) + 1, -(-(-(-n // 8)) // PIECE)
        directory = array_of("<u4", bits * blocks).reshape(bits, blocks)
        ends = at + 4 * bits * many + np.cumsum(np.r_[0, array_of("<u4", bits * many)].astype(np.int64))
        pieces = [blob[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return cls(n, bits, directory, packed=[pieces[k * many : (k + 1) * many] for k in range(bits)]), ids, lengths


#: Marks that never join a letter before them in one piece.
TAIL = b".,;:!?%&$*"


class WordEncoder:
    """Ids of whole texts, word by word: white space always ends a token here, so each distinct word is encoded once.

    A word of letters and a tail of marks are two pieces to the tokenizer; letters are cached without their tails.
    """

    def __init__(self, path: str | None, size: int = 1_000_000):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        self.model, self.size = self.full.model, size
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.known: dict[bytes, bytes] = {}
        self.letters: dict[bytes, bytes] = {}
        self.bits = max(1, int(self.full.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.dtype, self.code = (np.uint16, "H") if self.bits <= 16 else (np.uint32, "I")

    @classmethod
    def here(cls, path: str | None) -> WordEncoder:
        """One encoder for each worker process, so that the next task finds the words of the last."""
        home = sys.modules.setdefault("_tidemark_encoders", types.ModuleType("_tidemark_encoders")).__dict__
        if path not in home:
            home[path] = cls(path)
        return home[path]

    def _letters(self, word: bytes) -> bytes | None:
        """Ids of a word that is one run of letters after normalising, None for others."""
        found = self.letters.get(word)
        if found is None:
            if word.isalpha():
                text = word.decode()
            else:
                text = word.decode("utf-8", "replace")
                if not text.isalpha():
                    return None
                text = self.full.normalizer.normalize_str(text)
                if not text.isalpha():
                    return None
                text = self.bytes_of(text)[0][0]
            found = self.letters[word] = array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()
        return found

    def _whole(self, word: bytes) -> bytes:
        return np.asarray(self.full.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, self.dtype).tobytes()

    def _ids(self, word: bytes) -> bytes:
        stem = word.rstrip(TAIL)
        head = self._letters(stem) if stem else None
        if head is None:
            return self._whole(word)
        return head if stem == word else head + self._ids_of_tail(word[len(stem) :])

    def _ids_of_tail(self, tail: bytes) -> bytes:
        found = self.letters.get(tail)
        if found is None:
            found = self.letters[tail] = self._whole(tail)
        return found

    def encode(self, text: str | None) -> bytes:
        data = text.encode("utf-8", "replace") if text else b""
        # ASCII letters are lower-cased by the tokenizer anyway; its special strings are told apart by case
        words = (data if b"<|" in data else data.lower()).split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > self.size:  # caches: emptied when full, never a limit on what is encoded
                known.clear()
                self.letters.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self._ids(w)
            return b"".join([known[w] for w in words])


def write_shards(docs: DataFrame, *, text: str = "text", id: str = "doc_id", path: str | None = None, tokens: int = 1 << 18, ranges: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """(part, seq, n_tokens, n_docs, shard): the corpus as shards in ascending id order (null ids first), written and reread.

    Each document's ids end with 1. Null texts have that id alone. Rows that share an id are ordered by text hash. A
    document is never split: one longer than `tokens` is a shard of its own. An empty table gives no shards.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(text).alias("text"))
    dealt = rows.withColumn("th", F.xxhash64("text")).repartitionByRange(ranges, "k", "th").sortWithinPartitions("k", "th").select("k", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, part, seq = WordEncoder.here(path), TaskContext.get().partitionId(), 0
        end = np.asarray([END], encoder.dtype).tobytes()
        held: list[bytes] = []
        ids: list[int] = []
        total = 0

        def flush() -> pd.DataFrame:
            width = encoder.dtype().itemsize
            blob = WaveletMatrix.build(np.frombuffer(b"".join(held), encoder.dtype), encoder.bits).to_bytes(ids, [len(h) // width for h in held])
            return pd.DataFrame({"part": [part], "seq": [seq], "n_tokens": [total], "n_docs": [len(ids)], "shard": [blob]})

        for x in batches:
            for k, t in zip(x["k"], x["text"], strict=True):
                piece = encoder.encode(t) + end
                held.append(piece)
                ids.append(k)
                total += len(piece) // encoder.dtype().itemsize
                if total >= tokens:
                    yield flush()
                    held, ids, total, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    return written(dealt.mapInPandas(encode, "part int, seq int, n_tokens long, n_docs long, shard binary"), paths)


def read_documents(shards: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_ends) for each document of the shards: its ids decoded, and how many of them are the end id, counted by rank."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each range of ids
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    starts = written(sizes.withColumn("inside", inside).join(before, "part").select("part", "seq", (F.col("base") + F.col("inside")).alias("base")), paths)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for base, blob in zip(x["base"], x["shard"], strict=True):
                matrix, ids, lengths = WaveletMatrix.from_bytes(blob)
                data = matrix.decode().astype("<u4")
                stop = np.cumsum(lengths.astype(np.int64))
                crc = [zlib.crc32(data[b - n : b].tobytes()) for b, n in zip(stop, lengths, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "start": base + stop - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": crc, "n_ends": matrix.counts(END, np.r_[0, stop])}).astype({"ids_crc32": np.int64})

    out = shards.join(starts, ["part", "seq"]).select("base", "shard").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, n_ends long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(1 << 63))))


def op7(docs: DataFrame) -> DataFrame:
    """The query's table: documents read back from the shards of `write_shards`, whose docstring states the edge cases."""
    return read_documents(write_shards(docs))
