"""Alignment of two tokenizers over a group dictionary.

The byte offsets where tokens of both tokenizers end cut a text into groups, and a group's A ids and B ids
decide which of its tokens overlap. So groups are interned: first by block of documents, then over the corpus.
Links are expanded once for each distinct group and weighed by how often documents hold it; an id pair's count
(its distinct documents) is made block by block, from the distinct groups of each document, and summed by Spark.
What a group's links are worth is joined back by the group's key to the blocks that hold it.

Both tokenizers are run on words, each distinct word of a block once. Words are the stretches between single
spaces; both tokenizers are proved on the driver to end a token before such a space, or else texts stay whole.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wardline.llm.bpe import letters
from wardline.llm.common import cut, trim
from wardline.llm.token_count import sliced, words_of

#: Texts of about this many bytes make a block; a longer text is a block of its own.
BLOCK_BYTES = 6_000_000
#: Words that the libraries encode at a time.
WORDS = 8192
SPACE = "▁"

_CUT = regex.compile(r"(?<=\S) (?=\S)")
_ENTRIES = [("groups", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]


@functools.lru_cache(maxsize=1)
def _libraries(a_path: str, b_path: str) -> tuple[Tokenizer, sentencepiece.SentencePieceProcessor]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    a.no_padding()
    a.no_truncation()
    return a, sentencepiece.SentencePieceProcessor(model_file=b_path)


@dataclass
class Pair:
    """The bytes of both vocabularies' tokens, by id; a and b are the paths."""

    a: str
    b: str
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    by_word: bool

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def of(a: str, b: str) -> Pair:
        byte = letters()
        tokenizer, pieces = _libraries(a, b)
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocab.values()) + 1)
        for word, k in vocab.items():
            a_bytes[k] = bytes(byte[c] for c in word) if all(c in byte for c in word) else word.encode()
        names = [pieces.id_to_piece(k) for k in range(pieces.get_piece_size())]
        b_bytes = [bytes([int(n[3:5], 16)]) if pieces.is_byte(k) else n.replace(SPACE, " ").encode() for k, n in enumerate(names)]
        # a space behind a visible character begins a token: A's split says so, B has no piece that goes on past one,
        # and its normalizer changes nothing
        with open(a, encoding="utf-8") as file:
            split = json.load(file)
        plain = split["normalizer"] is None and split["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        apart = not any(SPACE in n.lstrip(SPACE) for n in names) and b"\x0a\x08identity" in pieces.serialized_model_proto()
        kept = all(b"".join(b_bytes[k] for k in pieces.encode(t)) == b" " + t.encode() for t in (" a", "a ", "a  b", "a\tb\n", "ａﬁ"))
        return Pair(a, b, a_bytes, b_bytes, plain and apart and kept)

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_bytes))


def ends_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths[ids])


def links(a_ids: np.ndarray, b_ids: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, A id, B id) of each overlap: two token sequences over the same bytes overlap once between any two ends."""
    at = np.union1d(a_ends, b_ends)
    return at, a_ids[np.searchsorted(a_ends, at)], b_ids[np.searchsorted(b_ends, at)]


def expand(keys: pa.Array, a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the group, A id, B id) of all links of groups written as "a1,a2|b1"."""
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    sides = pc.split_pattern(keys, "|").flatten()
    ids = []
    for k in (0, 1):
        listed = pc.split_pattern(sides.take(pa.array(np.arange(k, len(sides), 2))), ",")
        ids.append((np.asarray(listed.flatten().cast(pa.int64())), np.diff(np.asarray(listed.offsets))))
    (a, n_a), (b, _) = ids
    a_ends, b_ends = ends_of(a, a_lengths), ends_of(b, b_lengths)
    at, of_a, of_b = links(a, b, a_ends, b_ends)
    return np.searchsorted(a_ends[np.cumsum(n_a) - 1], at), of_a, of_b


def _joined(strings: pa.Array, counts: np.ndarray, between: str) -> pa.Array:
    """Runs of strings joined."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, strings.cast(pa.large_string())), pa.scalar(between, pa.large_string()))


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of runs, one after another."""
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - np.repeat(before - starts, counts)


def _encoded(pair: Pair, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A ids, their number by word, B ids, their number by word. The libraries' own results are kept for some words at a time."""
    a, b = _libraries(pair.a, pair.b)
    found: tuple[list[np.ndarray], ...] = ([], [], [], [])
    for k in range(0, len(words), WORDS):
        some = words[k : k + WORDS]
        for at, lists in ((0, [e.ids for e in a.encode_batch_fast([" " + w for w in some], add_special_tokens=False)]), (2, b.encode(some, num_threads=1))):
            found[at].append(np.fromiter(itertools.chain.from_iterable(lists), np.int64))
            found[at + 1].append(np.fromiter(map(len, lists), np.int64, len(lists)))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in found)


def _whole(pair: Pair, words: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether both token sequences of a word give back a space and the word."""
    want = [b" " + w.encode() for w in words]
    whole = b"".join(want)
    out = np.ones(len(words), bool)
    for ids, counts, own in ((a, n_a, pair.a_bytes), (b, n_b, pair.b_bytes)):
        parts = [own[k] for k in ids.tolist()]
        sizes = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        ends = np.cumsum(counts)
        same = np.diff(sizes[np.concatenate([[0], ends])]) == np.array([len(w) for w in want])
        if not same.all() or b"".join(parts) != whole:
            same = [b"".join(parts[e - n : e]) == w for e, n, w in zip(ends.tolist(), counts.tolist(), want, strict=True)]
        out &= same
    return out


@dataclass
class Block:
    """What a block of texts holds: per text numbers and groups, the block's groups, and documents by id pair."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    digest: list[str]
    entries: tuple[np.ndarray, np.ndarray, np.ndarray]
    keys: pa.Array
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray]


def block_of(pair: Pair, lengths: tuple[np.ndarray, np.ndarray], texts: pa.Array) -> Block:
    """Tokens, groups and pairs of texts (no nulls)."""
    rows = len(texts)
    if pair.by_word:
        words, index, starts = words_of(texts)
        counts = np.diff(np.append(starts, len(index)))
        odd_word = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
        odd = np.logical_or.reduceat(odd_word[index], starts) if rows else np.zeros(0, bool)
        odd &= np.asarray(pc.binary_length(texts)) > 0
        easy = np.flatnonzero(~odd & (np.asarray(pc.binary_length(texts)) > 0))
        flat, of = [index[_ragged(starts[easy], counts[easy])]], [np.repeat(easy, counts[easy])]
        known = {w: k for k, w in enumerate(words)} if odd.any() else {}
        for row in np.flatnonzero(odd).tolist():  # spaces beside other white space don't cut
            parts = _CUT.split(texts[row].as_py())
            flat.append(np.array([known.setdefault(p, len(known)) for p in parts], np.int64))
            of.append(np.full(len(parts), row))
        words = list(known) if known else words
    else:
        some = np.flatnonzero(np.asarray(pc.binary_length(texts)) > 0)
        words, flat, of = texts.take(pa.array(some)).to_pylist(), [np.arange(len(some))], [some]
    index, of = np.concatenate(flat).astype(np.int64), np.concatenate(of).astype(np.int64)
    used = np.unique(index)
    words, index = [words[k] for k in used.tolist()], np.searchsorted(used, index)

    a, n_a, b, n_b = _encoded(pair, words)
    whole = _whole(pair, words, a, n_a, b, n_b)
    if not whole.all():  # a text with such a word has no tokens
        bad = np.zeros(rows, bool)
        bad[of[~whole[index]]] = True
        stay = ~bad[of]
        of, index = of[stay], index[stay]
        left = np.zeros(len(words), bool)
        left[index] = True
        a, b = a[np.repeat(left, n_a)], b[np.repeat(left, n_b)]
        index, n_a, n_b = (np.cumsum(left) - 1)[index], n_a[left], n_b[left]
    a_ends, b_ends = ends_of(a, lengths[0]), ends_of(b, lengths[1])
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    sides = []
    for ids, ends in ((a, a_ends), (b, b_ends)):
        per_group = np.bincount(np.searchsorted(cuts, ends), minlength=len(cuts))
        sides.append(_joined(pa.array(ids).cast(pa.string()), per_group, ","))
    coded = pc.binary_join_element_wise(*sides, pa.scalar("|", pa.large_string())).dictionary_encode()
    keys, group = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    last = np.searchsorted(cuts, a_ends[np.cumsum(n_a) - 1]) if len(n_a) else np.zeros(0, np.int64)
    word_groups = np.diff(np.concatenate([[-1], last]))
    strings = _joined(keys.take(pa.array(group)), word_groups, ";")

    by_row = np.argsort(of, kind="stable")
    of, index = of[by_row], index[by_row]
    per_row = np.bincount(of, minlength=rows)
    listed = _joined(strings.take(pa.array(index)), per_row, ";").to_pylist()
    digest = [hashlib.sha256(t.encode()).hexdigest() if n else "" for t, n in zip(listed, per_row.tolist(), strict=True)]
    summed = lambda by_word: np.bincount(of, by_word[index], rows).astype(np.int64)

    of_group, of_a, of_b = expand(keys, *lengths)
    per_group = np.bincount(of_group, minlength=len(keys))
    flat_group = group[_ragged((np.cumsum(word_groups) - word_groups)[index], word_groups[index])]
    flat_row = np.repeat(of, word_groups[index])
    held, times = np.unique(flat_row * max(1, len(keys)) + flat_group, return_counts=True)
    row, ix = np.divmod(held, max(1, len(keys)))
    n_links = np.bincount(row, per_group[ix] * times, rows).astype(np.int64)
    coded_pair, which = np.unique(of_a << 32 | of_b, return_inverse=True)
    first = np.cumsum(per_group) - per_group
    linked = which[_ragged(first[ix], per_group[ix])]
    in_row = np.unique(np.repeat(row, per_group[ix]) * max(1, len(coded_pair)) + linked)
    docs = np.bincount(in_row % max(1, len(coded_pair)), minlength=len(coded_pair))
    return Block(summed(n_a), summed(n_b), summed(word_groups), n_links, digest, (np.bincount(row, minlength=rows), ix, times), keys, (coded_pair >> 32, coded_pair & 0xFFFFFFFF, docs))


def _blocks(docs: DataFrame, pair: Pair) -> DataFrame:
    """Rows of three kinds, by the columns that are filled: texts with their groups, the groups of a block, id pairs of a block."""
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("key", docs.schema[0].dataType),
            *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
            T.StructField("digest", T.StringType()),
            *(T.StructField(n, T.ArrayType(T.IntegerType())) for n, _ in _ENTRIES),
            T.StructField("ix", T.IntegerType()),
            T.StructField("name", T.StringType()),
            *(T.StructField(n, T.IntegerType()) for n in ("a", "b")),
            T.StructField("docs", T.LongType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = shared.value, TaskContext.get().partitionId() << 32
        lengths, arrow = pair.lengths(), None

        def filled(n: int, **columns: Any) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name]).cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

        for batch in batches:
            if arrow is None:
                plain = {T.LongType: pa.int64(), T.StringType: pa.string(), T.IntegerType: pa.int32()}
                arrow = pa.schema([(f.name, batch.schema[0].type if f.name == "key" else dict(_ENTRIES).get(f.name) or plain[type(f.dataType)]) for f in schema])
            keys, at = batch.column(0), 0
            for texts in sliced(pc.fill_null(batch.column(1), "").cast(pa.string()), BLOCK_BYTES):
                found, n = block_of(pair, lengths, texts), len(texts)
                per_row, ix, times = found.entries
                offsets = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
                listed = {k: pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for k, v in (("groups", ix), ("times", times))}
                own = {k: getattr(found, k) for k in ("n_a", "n_b", "n_groups", "n_links", "digest")}
                yield filled(n, block=np.full(n, number), key=keys.slice(at, n), **own, **listed)
                yield filled(len(found.keys), block=np.full(len(found.keys), number), ix=np.arange(len(found.keys)), name=found.keys)
                a, b, held = found.pairs
                yield filled(len(a), a=a, b=b, docs=held)
                at, number = at + n, number + 1
                del found, listed, own, a, b, held
                trim()

    return docs.mapInArrow(run, schema)


def _links(groups: DataFrame, pair: Pair) -> DataFrame:
    """name, a, b, n of every id pair of every group (column `name`), n: how often the group links it."""
    shared = groups.sparkSession.sparkContext.broadcast(pair.lengths())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            of, a, b = expand(names, *shared.value)
            order = np.lexsort((b, a, of))
            of, a, b = of[order], a[order], b[order]
            new = np.ones(len(of), bool)
            new[1:] = (np.diff(of) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(of)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(of[first])), *(pa.array(x[first].astype(np.int32)) for x in (a, b)), pa.array(times)], ["name", "a", "b", "n"])

    return groups.mapInArrow(run, "name string, a int, b int, n long")


def alignment(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` with their alignment, and the id pairs with their counts.

    First: key, n_a, n_b, n_groups, n_links, n_best, count_sum, digest. A text is encoded with a space before it
    by A (a byte-level BPE file) and as it is by B (a sentencepiece model that puts a space first). n_best are the
    links of a row whose pair is the one its A id is linked with in most rows of the table, ties included;
    count_sum adds up the counts of the pairs of all its links. digest is the SHA-256 of the groups as
    "a1,a2|b1;a3|b2,b3". Second: a, b, docs, best: in how many rows the pair is linked, and the most of its A id.

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no tokens: zeros
    and an empty digest. Every row counts as a document, so repeated rows and null keys each count. Empty
    tables give empty ones; other columns are not read. Texts are read whole; a task holds a block of
    BLOCK_BYTES of text, or one longer text, and what it makes of it. Both files must be readable on executors.
    """
    pair = Pair.of(a_path, b_path)
    blocks = cut(_blocks(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), pair), "alignment-blocks")
    counts = cut(blocks.where("docs is not null").groupBy("a", "b").agg(F.sum("docs").alias("docs")), "pair-counts")
    counts = cut(counts.join(counts.groupBy("a").agg(F.max("docs").alias("best")), "a"), "best-pairs")

    held = blocks.where("name is not null").select("block", "ix", "name")
    links = _links(held.select("name").distinct(), pair)
    worth = links.join(counts, ["a", "b"]).groupBy("name").agg(F.sum(F.col("n") * F.col("docs")).alias("sum"), F.sum(F.when(F.col("docs") == F.col("best"), F.col("n")).otherwise(0)).alias("best"))
    values = held.join(worth, "name").select(F.col("block").alias("of_block"), "ix", "sum", "best")
    texts = blocks.where("digest is not null").select("block", "key", "n_a", "n_b", "n_groups", "n_links", "digest", "groups", "times")

    def run(own: pa.Table, group: pa.Table) -> pa.Table:
        ix, worth = np.asarray(group["ix"]), {}
        for name in ("sum", "best"):
            of = np.zeros(int(ix.max()) + 1 if len(ix) else 1, np.int64)
            of[ix] = np.asarray(group[name])
            held, times = own["groups"].combine_chunks(), own["times"].combine_chunks()
            total = np.concatenate([[0], np.cumsum(of[np.asarray(held.flatten())] * np.asarray(times.flatten()))])
            worth[name] = np.diff(total[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(held)))])])
        return own.select(["key", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(worth["best"])).append_column("count_sum", pa.array(worth["sum"])).append_column("digest", own["digest"])

    schema = T.StructType([T.StructField("key", texts.schema["key"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), T.StructField("digest", T.StringType())])
    out = texts.groupBy("block").cogroup(values.groupBy("of_block")).applyInArrow(run, schema)
    return out.withColumnRenamed("key", key), counts


def op13_tokenizer_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    return alignment(docs, a_path, b_path)[0].withColumnRenamed("digest", "groups_sha256")
