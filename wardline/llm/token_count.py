"""Token counts by the whole-token shortcut.

Before any text is read, on the driver, every string of the vocabulary is tested: it is a *whole token* if
the pre-tokeniser leaves it in one piece and the merges end in one id. Texts are cut into pre-tokens; a
pre-token that is a whole token counts one, and only the rest goes through the merges. Workers get the
proved strings and the merge tables as a broadcast, whose size the vocabulary bounds, and keep nothing
from one slice of texts to the next.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wardline.llm.bpe import LONGEST, Merges, letters
from wardline.llm.common import trim

#: Texts of about this many bytes are handled at a time; longer texts are cut at spaces.
SLICE_BYTES = 8_000_000
#: Below this code point `regex` and the tokenizer agree on letters, digits and white space (tested);
#: words with others are left to the tokenizer.
AGREED = chr(0x530)
#: The split of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = regex.compile(r"(?<=\S) (?=\S)")


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@functools.lru_cache(maxsize=1)
def library(path: str) -> Tokenizer:
    """The tokenizer itself, loaded in a worker only if some word needs it."""
    return load(path)


def whole_tokens(tokenizer: Tokenizer, pattern: str = PATTERN) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one id, each proved by encoding it."""
    byte, split, found = letters(), regex.compile(pattern), []
    for word in tokenizer.get_vocab(with_added_tokens=False):
        try:
            text = bytes(byte[c] for c in word).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if split.findall(text) == [text] and max(text) < AGREED:
            found.append(text)
    encoded = tokenizer.encode_batch_fast(found, add_special_tokens=False)
    return frozenset(text for text, e in zip(found, encoded, strict=True) if len(e.ids) == 1)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words between single spaces, each text's words as indices of them, and where each text begins."""
    split = pc.split_pattern(texts, " ")
    coded = split.flatten().dictionary_encode()
    offsets = np.asarray(split.offsets)
    return coded.dictionary.to_pylist(), np.asarray(coded.indices), offsets[:-1] - offsets[0]


@dataclass
class TokenCounter:
    """Counts tokens of texts exactly as `tokenizer.encode(text, add_special_tokens=False)` would."""

    path: str
    pattern: str
    whole: frozenset[str]
    special: tuple[str, ...]
    merges: Merges

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def of(path: str, pattern: str = PATTERN) -> TokenCounter:
        tokenizer = load(path)
        special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
        return TokenCounter(path, pattern, whole_tokens(tokenizer, pattern), special, Merges.of(path))

    @property
    def tokenizer(self) -> Tokenizer:
        return library(self.path)

    def _by_library(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def hard(self, piece: str) -> bool:
        """Whether a piece is left to the tokenizer as it stands."""
        return not piece.isascii() and max(piece) >= AGREED or "<" in piece and any(s in piece for s in self.special)

    def tokens(self, tokens: list[str]) -> np.ndarray:
        """Counts of pre-tokens."""
        coded = pa.array(tokens, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        counts, rest = np.ones(len(distinct), np.int64), [k for k, t in enumerate(distinct) if t not in self.whole]
        if rest:
            texts = coded.dictionary.take(pa.array(rest))
            short = np.asarray(pc.binary_length(texts)) <= LONGEST
            rest = np.array(rest)
            counts[rest[short]] = self.merges.apply(pa.concat_arrays([texts.filter(pa.array(short))]))[1]
            counts[rest[~short]] = self._by_library([distinct[k] for k in rest[~short]])
        return counts[np.asarray(coded.indices)] if tokens else np.zeros(0, np.int64)

    def pieces(self, pieces: list[str]) -> list[int]:
        """Counts of pieces that the tokenizer would treat alike on their own."""
        hard, split, tokens, of = [], regex.compile(self.pattern), [], []
        for i, piece in enumerate(pieces):
            if self.hard(piece):
                hard.append(i)
            else:
                found = split.findall(piece)
                tokens += found
                of += [i] * len(found)
        counts = np.bincount(np.array(of, np.int64), self.tokens(tokens), len(pieces)).astype(np.int64)
        counts[hard] = self._by_library([pieces[i] for i in hard])
        return counts.tolist()

    def words(self, words: list[str]) -> np.ndarray:
        """Counts of distinct words, none of which begins or ends with white space, each with a space before it."""
        counts, easy, mixed, hard = np.zeros(len(words), np.int64), [], [], []
        for k, w in enumerate(words):
            (hard if self.hard(w) else easy if w.isalpha() else mixed).append(k)
        counts[easy] = self.tokens([" " + words[k] for k in easy])
        counts[hard] = self._by_library([" " + words[k] for k in hard])
        if mixed:
            # a space between visible characters always begins a pre-token, so those that begin with one begin a word
            tokens = regex.findall(self.pattern, "".join(" " + words[k] for k in mixed))
            starts = [i for i, t in enumerate(tokens) if t[0] == " "]
            counts[mixed] = np.add.reduceat(self.tokens(tokens), starts)
        return counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """Counts of whole texts. A space between two visible characters always begins a pre-token, so
        texts are cut there; in texts where spaces meet other white space only such spaces cut."""
        words, index, starts = words_of(texts)
        odd = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
        good = np.flatnonzero(~odd)
        of = np.zeros(len(words), np.int64)
        of[good] = self.words([words[k] for k in good.tolist()])
        of = of[index]
        of[starts] = 0
        out = np.add.reduceat(of, starts) if len(starts) else np.zeros(0, np.int64)
        out += np.array(self.pieces([words[k] for k in index[starts].tolist()]), np.int64)
        for row in np.flatnonzero(np.logical_or.reduceat(odd[index], starts)) if odd.any() else ():
            out[row] = sum(self.pieces([" " * (k > 0) + p for k, p in enumerate(_CUT.split(texts[int(row)].as_py()))]))
        return out


def sliced(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """The array in runs of about so many bytes."""
    ends, at = np.cumsum(np.asarray(pc.binary_length(texts), np.int64)), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, stop - at)
        at = stop


def cut_long(texts: pa.Array, size: int = SLICE_BYTES, between: str = r"(?<=\S) (?=\S)") -> Iterator[tuple[pa.Array, bool]]:
    """As `sliced`, but texts of more than twice the size come in parts, cut where `between` matches (what it
    matches stays in front of the later part); the flag says that an array holds one part that a later one continues."""
    cut = regex.compile(between)
    for part in sliced(texts, size):
        if len(part) > 1 or not len(part) or pc.binary_length(part)[0].as_py() <= 2 * size:
            yield part, False
            continue
        text, at = part[0].as_py(), 0
        while (m := cut.search(text, at + size)) is not None:
            yield pa.array([text[at : m.start()]]), True
            at = m.start()
        yield pa.array([text[at:]]), False


def token_counts(docs: DataFrame, path: str, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """`docs` with its token counts in one more column (long), which replaces a column of that name.

    Null and empty texts count 0. Each row is counted on its own, so repeated rows, ties and row order
    don't matter; an empty table gives an empty table; other columns pass through unread by Python
    except as Arrow buffers. Texts of over twice SLICE_BYTES are counted in parts, cut where the count
    can't change; memory is bounded by that and by the longest run without such a place. `path` must be
    readable on the executors for words that only the tokenizer itself can cut.
    """
    wide = docs.drop(column) if column in docs.columns and column != text else docs
    kept = [f for f in wide.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(column, T.LongType(), False)])
    at, shared = wide.columns.index(text), docs.sparkSession.sparkContext.broadcast(TokenCounter.of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            counts, before = [], 0
            for part, more in cut_long(pc.fill_null(batch.column(at), "")):
                found = counter.count(part)
                found[:1] += before
                before = int(found[0]) if more else 0
                if not more:
                    counts.append(found)
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([*counts, np.zeros(0, np.int64)]))], [*(f.name for f in kept), column])
        trim()

    return wide.mapInArrow(run, schema)


def op1_token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    lean = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = token_counts(lean, path)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
