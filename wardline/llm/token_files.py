"""Token-id files: independent zstandard frames, a trailing seek table, per-frame checksums.

A file holds one zstandard frame for each document (its ids as little-endian unsigned 32-bit integers),
then a skippable frame with the documents' keys, then the seek table of the public seekable format:
compressed size, plain size and low 32 bits of the plain bytes' XXH64 for each frame. Any zstandard
decoder reads the whole file; a reader with the seek table decompresses only the frames it is asked for.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.bpe import LONGEST, Merges
from wardline.llm.common import cut, new_folder, partitions, text_of, trim
from wardline.llm.token_count import cut_long, library, load, words_of

#: Magic numbers of the format (fixed values).
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: The tokenizer's split of lowered text (fixed value), and the code point below which its normal form is lower case alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
CUT = regex.compile(PATTERN + "| ")
PLAIN = chr(0x130)
LEVEL = 3
#: Compressed bytes of a file, about.
FILE_BYTES = 256_000_000


@dataclass
class Encoder:
    """Ids of texts exactly as `tokenizer.encode(text, add_special_tokens=False)`, word by word.

    Only for the word-end tokenizer, whose pre-tokeniser drops white space: a space or line feed then
    separates words that don't touch each other's ids. Words of plain Latin letters are lowered and cut
    here by the tokenizer's own pattern and merged with its tables; others are left to the library."""

    path: str
    special: tuple[str, ...]
    merges: Merges

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def of(path: str) -> Encoder:
        return Encoder(path, tuple(t.content for t in load(path).get_added_tokens_decoder().values()), Merges.of(path))

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """ids of the texts one after another, and how many each has."""
        ids = [np.array(e.ids, np.uint32) for e in library(self.path).encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), [len(i) for i in ids]

    def _tokens(self, tokens: pa.Array) -> pa.Array:
        """ids (large_binary) of distinct lowered pre-tokens."""
        short = pc.less_equal(pc.binary_length(tokens), LONGEST)
        ids, counts = self.merges.apply(pa.concat_arrays([tokens.filter(short)]))
        long, n_long = self._by_library(tokens.filter(pc.invert(short)).to_pylist())
        place = np.argsort(np.concatenate([np.flatnonzero(short), np.flatnonzero(pc.invert(short))]), kind="stable")
        return grouped(np.concatenate([ids, long]), np.concatenate([counts, np.array(n_long, np.int64)])).take(pa.array(place))

    def words(self, words: list[str]) -> pa.Array:
        """ids (large_binary) of words."""
        easy, mixed, hard = [], [], []
        for k, w in enumerate(words):
            if not w.isascii() and max(w) >= PLAIN or "<" in w and any(s in w for s in self.special):
                hard.append(k)
            else:
                (easy if w.isalpha() else mixed).append(k)
        tokens, sizes = [words[k].lower() for k in easy], np.ones(len(easy), np.int64)
        if mixed:
            cut = CUT.findall(" ".join([words[k] for k in mixed]).lower())
            ends = np.array([*(i for i, t in enumerate(cut) if t == " "), len(cut)])
            sizes = np.concatenate([sizes, np.diff(ends, prepend=-1) - 1])
            tokens += [t for t in cut if t != " "]
        coded = pa.array(tokens, pa.large_string()).dictionary_encode()
        ids = self._tokens(coded.dictionary).take(coded.indices)
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        counts = np.diff(bounds[np.concatenate([[0], np.cumsum(sizes)])]) // 4
        rest, n_rest = self._by_library([words[k] for k in hard])
        flat = np.frombuffer(ids.buffers()[2] or b"", np.uint32)[: bounds[-1] // 4] if len(ids) else np.zeros(0, np.uint32)
        place = np.argsort(np.array([*easy, *mixed, *hard], np.int64), kind="stable")
        return grouped(np.concatenate([flat, rest]), np.concatenate([counts, np.array(n_rest, np.int64)])).take(pa.array(place))

    def encode(self, texts: pa.Array) -> Iterator[memoryview]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        words, index, starts = words_of(pc.replace_substring(texts, "\n", " "))
        ids = self.words(words).take(pa.array(index))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        plain = memoryview(ids.buffers()[2] or b"")
        for a, b in itertools.pairwise([*ends[starts].tolist(), int(ends[-1])]):
            yield plain[a:b]


def grouped(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The ids cut into groups of these sizes, each as bytes."""
    ends = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids.astype("<u4")))])


class FrameWriter:
    """Writes frames as they come; the tables at the end."""

    def __init__(self, out) -> None:
        self.out, self.entries, self.keys, self.known = out, array("I"), array("q"), bytearray()

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, key: int | None, frame: bytes, plain: int, check: int) -> None:
        self.out.write(frame)
        self.entries.extend((len(frame), plain, check))
        self.keys.append(key or 0)
        self.known.append(key is not None)

    def close(self) -> None:
        keys = bytes(self.known) + np.frombuffer(self.keys, np.int64).astype("<i8").tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(keys)) + keys)
        table = np.frombuffer(self.entries, np.uint32).astype("<u4").tobytes()
        self.out.write(struct.pack("<II", SEEK_TABLE, len(table) + 9) + table)
        self.out.write(struct.pack("<IBI", len(self), CHECKSUMS, SEEKABLE))


class FrameReader:
    """Reads the tables from the end of a file, then only the frames that are asked for."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.seek(0, 2) or source.tell()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        at = size - 9 - 12 * n
        source.seek(at - 8 - 9 * n)
        keys = source.read(9 * n)
        source.seek(at)
        self.entries = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        known = np.frombuffer(keys[:n], np.uint8)
        self.keys = [int(k) if ok else None for k, ok in zip(np.frombuffer(keys[n:], "<i8"), known, strict=True)]
        self.undo = zstandard.ZstdDecompressor()

    def read(self, k: int) -> bytes:
        """The plain bytes of frame k; ValueError if they don't match their checksum."""
        self.source.seek(int(self.offsets[k]))
        plain = self.undo.decompress(self.source.read(int(self.entries[k, 0])), max_output_size=int(self.entries[k, 1]))
        if len(plain) != self.entries[k, 1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return plain


def encoded(docs: DataFrame, path: str, end_id: int | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tie, frame, plain, check: one compressed frame of ids for each row; a null text has no ids but the end id."""
    tail = b"" if end_id is None else struct.pack("<I", end_id)
    shared = docs.sparkSession.sparkContext.broadcast(Encoder.of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = shared.value, zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            row, before = 0, b""
            for part, more in cut_long(batch.column(1), between="[ \n]"):
                frames, plains, checks = [], array("q"), []
                for ids in encoder.encode(part):
                    if more:
                        before += ids
                        continue
                    plain = before + ids + tail
                    before = b""
                    frames.append(squeeze.compress(plain))
                    plains.append(len(plain))
                    checks.append(xxhash.xxh64_intdigest(plain))
                if more:
                    continue
                digests = np.array(checks, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(part)),
                        pa.array((digests >> np.uint64(1)).view(np.int64)),
                        pa.array(frames, pa.binary()),
                        pa.array(np.frombuffer(plains, np.int64)),
                        pa.array((digests & np.uint64(0xFFFFFFFF)).view(np.int64)),
                    ],
                    ["key", "tie", "frame", "plain", "check"],
                )
                row += len(part)
        trim()

    return docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text")).mapInArrow(run, "key long, tie long, frame binary, plain long, check long")


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None, files: int | None = None, key: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Write all documents, ascending by key over the files in order; returns (file, documents, ids) of each.

    Rows are encoded where they lie and only compressed frames move. The number of files follows the
    bytes (about FILE_BYTES each), but isn't under the number of shuffle partitions. The range
    partitioning samples the key together with a digest, so a key with very many rows is spread too.
    Equal keys are ordered by the digest of their ids; null keys come first; repeated rows are written
    each time; an empty table gives no file. Very long texts are encoded in parts, but one document's
    ids are one frame, which its worker holds. A task writes under a name of its own and renames at the
    end, so a repeated task replaces its file with the same bytes. `folder` is any URI that pyarrow can
    write and all executors share.
    """
    spark = docs.sparkSession
    rows = cut(encoded(docs, path, end_id, key, text), "frames")
    n = files or max(partitions(spark), -(-(rows.agg(F.sum(F.octet_length("frame"))).first()[0] or 0) // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pafs.FileSystem.from_uri(folder)
        final, writer, ids = f"{root}/ids-{task.partitionId():06d}.zst", None, 0
        temp = f"{root}/.{os.path.basename(final)}-{task.taskAttemptId()}"
        for batch in batches:
            if batch.num_rows and writer is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(temp)
                writer = FrameWriter(out)
            keys, frames, plains, checks = (batch.column(k) for k in ("key", "frame", "plain", "check"))
            for k, (key_, plain, check) in enumerate(zip(keys.to_pylist(), plains.to_pylist(), checks.to_pylist(), strict=True)):
                writer.add(key_, frames[k].as_buffer(), plain, check)
                ids += plain // 4
        if writer:
            writer.close()
            out.close()
            store.move(temp, final)
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]).cast(pa.int64()), pa.array([os.path.basename(final)]), pa.array([len(writer)], pa.int64()), pa.array([ids], pa.int64())], ["part", "file", "n", "ids"])

    dealt = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie")
    made = dealt.mapInArrow(run, "part long, file string, n long, ids long").collect()
    return [(f"{folder}/{r.file}", r.n, r.ids) for r in sorted(made, key=lambda r: r.part)]


def read_token_files(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, in parallel over the files."""
    starts, at = [], 0
    for file, _, ids in files:
        starts.append((file, at))
        at += ids
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = pafs.FileSystem.from_uri(file)
                with store.open_input_file(path) as source:
                    reader, rows = FrameReader(source), []
                    for k, key in enumerate(reader.keys):
                        ids = reader.read(k)
                        rows.append((key, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                        if len(rows) == 20_000 or k + 1 == len(reader.keys):
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []

    listing = spark.createDataFrame(starts, "file string, start long")
    return listing.repartitionByRange(len(starts), "start").mapInArrow(run, schema)


def op3_token_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the documents' ids to files in the shared folder and read the digest of each back from them."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, new_folder(spark, "token-files"), path, end_id))
