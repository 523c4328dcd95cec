"""Packing documents into training sequences along a space-filling curve.

Token ids are hashed into a few random directions; the mean over a document is its vector, and the Hilbert key of the
vector orders documents so that neighbours are alike. Documents are range-partitioned and sorted by that key, and each
partition fills its sequences in order, cutting documents where a sequence is full. Long documents travel in several rows. What is left over at a
partition's end is cut into sequences whose lengths are powers of two, so nothing is padded.

Defined cases: a null or empty text is the end token alone; texts with equal keys are ordered by id; a key that very
many copies share is split between partitions by id; ids repeated are packed as often as listed; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import collections
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import col
from millrace.functions.storage import stored

from .batches import arrow_types, release, rows_to_batches, small_batches

SEQUENCE = 1024
END = 0
DIMS, BITS = 3, 16
#: Tokens that a partition packs, about.
PARTITION_TOKENS = 1 << 21
#: Tokens of a document that travel in one row, so that rows and partitions are of like size.
ROW_TOKENS = 8192

#: Fixed value: how byte-level tokenizers of this family cut a text into words.
#: Same pieces as 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+, without runs that are given back.
WORDS = r"'(?:[stmd]|re|ve|ll)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as ``encode(text, add_special_tokens=False)`` of a tokenizer file gives them.

    A byte-level BPE vocabulary whose ids are the order of its merges is handed to a faster merger of the same ids,
    which a probe confirms; any other file is used as it is, and so are texts that hold the string of an added token.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.path = path
        self.tokenizer = self._read()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.merger = self._merger()
        if self.merger is not None:
            self.tokenizer = None  # read again for the first text that needs it

    def _read(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _merger(self):
        import tiktoken

        byte = _bytes_of()
        added = {t.encode() for t in self.added}
        # one translation of the vocabulary's text; characters outside the byte alphabet become one beyond Latin-1
        to_byte = collections.defaultdict(lambda: 0x100, {ord(c): b for c, b in byte.items()})
        ordinary = ((t.translate(to_byte), i) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items())
        ranks = {b: i for t, i in ordinary if "\u0100" not in t and (b := t.encode("latin-1")) not in added}
        if self.tokenizer.normalizer is not None or any(bytes([b]) not in ranks for b in range(256)):
            return None
        merger = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        probe = "It's a test; déjà vu, 日本語  12345 ~~~\n\n\t<tag attr='x'>We'LL see\u2003 \x1c🙂 supercalifragilistic" + "ab" * 60
        same = merger.encode_ordinary(probe) == self.tokenizer.encode(probe, add_special_tokens=False).ids
        return merger if same else None

    def ids(self, text: str) -> np.ndarray:
        if self.merger is None or any(t in text for t in self.added):
            self.tokenizer = self.tokenizer or self._read()
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)
        return np.array(self.merger.encode_ordinary(text), self.kind)


def directions(ids: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    """Hashed coordinates of token ids: fixed pseudo-random normal numbers."""
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((ids, dims)).astype(np.float32)


def hilbert_key(point: np.ndarray, bits: int = BITS) -> int:
    """Place of an integer point on the Hilbert curve (Skilling's transposed form)."""
    x = [int(v) for v in point]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v >> b & 1)
    return key


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END,
            row_tokens: int = ROW_TOKENS) -> DataFrame:
    """Rows of at most ``row_tokens`` tokens: id, start, doc_tokens (with the end token), key (Hilbert), copies and tokens.

    A row that repeats the one before it (a document that a mix takes twice) is encoded and listed once, with its ``copies``.
    """
    where = path or default_tokenizer()
    source = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("text"))
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string("start long, doc_tokens long, key long, copies long, tokens binary").fields])
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(where)
        release()
        table = directions(encoder.vocabulary + 1).T.copy()  # a row for each direction: sums of plain arrays

        def rows() -> Iterator[tuple]:
            each = ((i.as_py(), text.as_py() or b"") for batch in batches for i, text in zip(*batch.columns))
            for (i, text), same in itertools.groupby(each):
                copies = sum(1 for _ in same)
                ids = np.append(encoder.ids(text.decode()), encoder.kind.type(end))
                mean = np.array([sum(axis[ids[k:k + 65536]].sum(dtype=np.float64) for k in range(0, len(ids), 65536)) for axis in table]) / np.sqrt(len(ids))
                cell = np.clip((np.tanh(mean / 4) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                key = hilbert_key(cell)
                for start in range(0, len(ids), row_tokens):
                    yield i, (start, len(ids), key, copies, ids[start:start + row_tokens].tobytes())

        yield from rows_to_batches(rows(), types)

    return source.mapInArrow(run, schema)


def fill(rows: Iterator[tuple], sequence: int = SEQUENCE) -> Iterator[tuple]:
    """(id, (start, length, ids_crc32, doc_tokens, sequence, offset)) of rows (id, start, doc_tokens, ids) in their order.

    Rows that go on where the last one of their document ended make one piece. The last, partial sequence is held back
    and cut into powers of two.
    """
    number, used, held = 0, 0, []
    for i, at, n, ids in rows:
        done = 0
        while done < len(ids):
            length = min(len(ids) - done, sequence - used)
            held.append([i, at + done, n, ids[done:done + length]])
            done, used = done + length, used + length
            if used == sequence:
                yield from _placed(held, number)
                number, used, held = number + 1, 0, []
    for size in [1 << b for b in range(sequence.bit_length() - 1, -1, -1) if used >> b & 1]:
        part, room = [], size
        while room:
            i, at, n, ids = held[0]
            part.append([i, at, n, ids[:room]])
            if len(ids) > room:
                held[0] = [i, at + room, n, ids[room:]]
            else:
                held.pop(0)
            room -= len(part[-1][3])
        yield from _placed(part, number)
        number += 1


def _placed(pieces: list[list], number: int) -> Iterator[tuple]:
    offset, k = 0, 0
    while k < len(pieces):
        i, at, n, ids = pieces[k]
        k += 1
        while k < len(pieces) and pieces[k][0] == i and pieces[k][1] == at + len(ids):
            ids = np.concatenate([ids, pieces[k][3]])
            k += 1
        yield i, (at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, number, offset)
        offset += len(ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``sequence`` must be a power of two. Documents are encoded once into a stored table, which the range partitioning
    then samples and moves. Sequence ids hold the partition in the upper bits.
    """
    if sequence & (sequence - 1):
        raise ValueError("sequences must be a power of two long")
    with small_batches(docs.sparkSession):
        tokens = stored(encoded(docs, id_col, text_col, path), "tokens")
    total = tokens.filter("start = 0").agg(F.sum(F.col("doc_tokens") * F.col("copies"))).first()[0] or 0
    order = ["key", "id", "start"]
    ordered = (tokens.repartitionByRange(max(1, -(-total // PARTITION_TOKENS)), *order).sortWithinPartitions(*order)
               .select("id", "start", "doc_tokens", "copies", "tokens"))
    schema = T.StructType([ordered.schema["id"], *T._parse_datatype_string(
        "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields])
    types = arrow_types(schema)
    kind = Encoder(path or default_tokenizer()).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        rows = ((i.as_py(), at.as_py(), n.as_py(), np.frombuffer(t.as_py(), kind)) for b in batches for i, at, n, copies, t in zip(*b.columns)
                for _ in range(copies.as_py()))
        placed = ((i, (*v[:4], first + v[4], v[5])) for i, v in fill(rows, sequence))
        yield from rows_to_batches(placed, types, 8192)

    return ordered.mapInArrow(run, schema)
