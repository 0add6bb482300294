"""Removal of repeated passages by sliding sentence spans.

A text is cut into sentences at stops and line feeds. Every run of SPAN consecutive sentences (more where they
are short) is hashed, spans of all documents meet by hash, and a sentence goes if any repeated span that isn't
the first of its kind covers it. Only a sentence of more than SENTENCE_WORDS words is divided, where its words say
so: of every WINDOW of them the one with the least hash ends a part, and its parts count as sentences. So a
passage has the same sentences inside whatever stands before it, and any 51 shared words hold a span.

All of this works on the bytes of a whole slice of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from wardline.llm.common import Shielded, text_of, trim
from wardline.llm.repeats import ranged
from wardline.llm.shingles import mixed
from wardline.llm.token_count import sliced

#: Sentences of a span, and bytes that it has at least: where they are short it goes on over more of them.
SPAN, LEAST_BYTES = 3, 40
#: A sentence of more words is divided. Of 51 shared words the first and the last sentence can have foreign words, or be
#: divided in one place and whole in another: 12 words each at most. The 27 between them are more than two sentences of 12.
SENTENCE_WORDS = 12
#: Words of which one ends a part. Two copies of a long sentence can be divided differently only in the first and last
#: WINDOW - 1 words that they share; 51 words without a stop have common ends among their first and last 12, and so three
#: parts of 12 words at most between them.
WINDOW = 12
#: Bytes of texts that are cut at a time; words of more bytes are hashed alone.
SLICE, LONG_WORD = 2_000_000, 512

#: Classes of bytes: parts of words, white space, line feeds, stops.
_IN_WORD, _BLANK, _FEED, _STOP = range(4)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[[33, 46, 63]] = _BLANK, _FEED, _STOP
_RANDOM = np.random.default_rng(11)
_VALUE = np.where(np.isin(_CLASS, (_BLANK, _FEED)), 0, _RANDOM.integers(1, 2**63, 256, np.int64)).astype(np.uint64)
#: Odd multipliers of the rolling sums over bytes and over words.
_BYTE, _WORD, _OTHER = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 2**64))


class Rolling:
    """Hashes of runs of values, from one prefix sum; powers are kept as far as they were needed."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse, self.up, self.down = base, _inverse(base), np.ones(0, np.uint64), np.ones(0, np.uint64)

    def of(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(values * self.up[: n - 1], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.down[starts])


_BYTES, _WORDS, _WORDS_TOO = Rolling(_BYTE), Rolling(_WORD), Rolling(_OTHER)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and where each begins (one more at the end)."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


class Pieces:
    """A slice of texts cut into words and pieces. A word holds the blanks and stops that follow it; words
    together are the text. Words and pieces are numbered through all texts of the slice."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, self.at = bytes_of(texts)
        data, n = self.data, len(self.data)
        kind = _CLASS[data]
        inside = kind == _IN_WORD
        first = np.zeros(n + 1, bool)
        first[self.at] = True
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        starts = np.flatnonzero(inside & (~before | first[:n]))
        after = np.concatenate([inside[1:], [False]]) if n else inside
        stops = np.flatnonzero(inside & (~after | first[1:])) + 1  # where each word proper ends
        of = np.searchsorted(self.at, starts, "right") - 1
        gap_end = np.minimum(np.append(starts[1:], n), self.at[of + 1]) if len(starts) else starts
        # what stands before a text's first word, and what follows blanks after stops, are words of their own
        lead = self.at[:-1][(np.diff(self.at) > 0) & ~np.append(inside, False)[self.at[:-1]]]
        tail = self._tails(kind, stops, gap_end)
        self.start = np.sort(np.concatenate([starts, lead, tail]))
        self.end = np.append(self.start[1:], n)
        self.of = np.searchsorted(self.at, self.start, "right") - 1
        marks = np.concatenate([[0], np.cumsum(kind >= _FEED, dtype=np.int32)])
        self.last = (marks[self.end] > marks[self.start]) | ~np.append(inside, False)[self.start]
        # a word's text without outer blanks ends with its last byte that isn't blank
        visible = np.flatnonzero((kind == _IN_WORD) | (kind == _STOP))
        k = np.searchsorted(visible, self.end) - 1
        self.bare_end = np.maximum(self.start, np.where(k >= 0, np.append(visible, 0)[k] + 1, 0))
        self.hash = _BYTES.of(_VALUE[data], self.start, self.end)
        for w in np.flatnonzero(self.bare_end - self.start > LONG_WORD):
            self.hash[w] = xxhash.xxh64_intdigest(data[self.start[w] : self.bare_end[w]].tobytes())
        self._cut()

    @staticmethod
    def _tails(kind: np.ndarray, stops: np.ndarray, gap_end: np.ndarray) -> np.ndarray:
        """Where stops stand again after a gap's first stops or line feeds and blanks."""
        long = np.flatnonzero(gap_end - stops > 2)
        if not len(long):
            return long
        nexts = []
        at, end = stops[long], gap_end[long]
        for wanted in (kind >= _FEED, kind == _BLANK, kind == _STOP):
            places = np.append(np.flatnonzero(wanted), len(kind))
            at = places[np.searchsorted(places, np.minimum(at, len(kind)))]
            nexts.append(at)
        return nexts[-1][nexts[-1] < end]

    def _cut(self) -> None:
        """Ends of pieces: the last words of sentences and texts, and in sentences of more than SENTENCE_WORDS words the
        least of every WINDOW (the last of equals)."""
        ends, n = self.last.copy(), len(self.last)
        if n >= WINDOW:
            fresh = np.ones(n, bool)
            fresh[1:] = self.last[:-1] | (self.of[1:] != self.of[:-1])
            sentence = np.cumsum(fresh) - 1
            long = np.bincount(sentence)[sentence] > SENTENCE_WORDS
            inside = np.flatnonzero(long[: n - WINDOW + 1] & (sentence[: n - WINDOW + 1] == sentence[WINDOW - 1 :]))
            least = (self.hash >> np.uint64(32)).astype(np.int64)
            windows = np.lib.stride_tricks.sliding_window_view(least, WINDOW)[inside, ::-1]
            ends[inside + WINDOW - 1 - windows.argmin(axis=1)] = True
        if len(ends):
            ends[-1] = True
            ends[:-1] |= self.of[1:] != self.of[:-1]
        self.to = np.flatnonzero(ends) + 1  # words: each piece's end
        self.piece_start = np.concatenate([[0], self.to[:-1]]).astype(np.int64)[: len(self.to)]
        self.piece_of = self.of[self.piece_start] if len(self.to) else self.to
        self.piece_at = np.searchsorted(self.piece_of, np.arange(len(self.at)))  # each text's first piece

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last piece of the spans: from each piece on and back from each piece, the shortest run of
        SPAN pieces at least that has LEAST_BYTES (with one for a blank between pieces). All of a repeated
        passage that holds a run lies in such runs of its own."""
        n = len(self.to)
        i = np.arange(n)
        low, high = self.piece_at[self.piece_of], self.piece_at[self.piece_of + 1]
        size = self.bare_end[self.to - 1] - self.start[self.piece_start]
        sums = np.concatenate([[0], np.cumsum(size + 1)])
        on = np.maximum(i + SPAN - 1, np.searchsorted(sums, sums[:-1] + LEAST_BYTES + 1) - 1)
        back = np.minimum(i - SPAN + 1, np.searchsorted(sums, sums[1:] - LEAST_BYTES - 1, "right") - 1)
        ok = on < high
        more = (back >= low) & (on[np.maximum(back, 0)] != i)
        return np.concatenate([i[ok], back[more]]), np.concatenate([on[ok], i[more]])

    def digests(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the words from piece a to piece b."""
        starts, ends = self.piece_start[a], self.to[b]
        return _WORDS.of(mixed(self.hash), starts, ends), _WORDS_TOO.of(mixed(self.hash ^ _WORD), starts, ends)


def spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, mark, s, e (first and last piece), h, g (hashes of the span's words without outer white space), again.

    `again` marks spans that an earlier key, text or place of the same batch has too: they aren't first whatever
    other batches hold. They get an h of their own, so that of each passage only one row a batch has its hash.
    The same place comes once a batch, however often its row is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = 0, [tuple(np.zeros(0, t) for t in "qiiQQ")]
            for part in sliced(batch.column(2), SLICE):
                cut = Pieces(part)
                a, b = cut.runs()
                row = cut.piece_of[a]
                low = cut.piece_at[row]
                found.append((row + at, (a - low).astype(np.int32), (b - low).astype(np.int32), *cut.digests(a, b)))
                at += len(part)
            row, s, e, h, g = (np.concatenate(x) for x in zip(*found, strict=True))
            again, keep = _again(batch.column(0), batch.column(1), row, s, h, g)
            h = np.where(again, mixed(h + row.astype(np.uint64) * _WORD + s.astype(np.uint64) * _BYTE + np.uint64(1)), h)
            row, s, e, h, g, again = (x[keep] for x in (row, s, e, h, g, again))
            ids, marks = (batch.column(k).take(pa.array(row)) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, marks, pa.array(s), pa.array(e), pa.array(h.view(np.int64)), pa.array((g >> np.uint64(33)).astype(np.int32)), pa.array(again)], ["id", "mark", "s", "e", "h", "g", "again"])
        trim()

    rows = docs.select(F.col(key).alias("id"), F.xxhash64(F.lit(1), text).alias("mark"), text_of(text).alias("text"))
    kinds = StructType.fromDDL("mark long, s int, e int, h long, g int, again boolean")
    return rows.mapInArrow(run, StructType([StructField("id", rows.schema["id"].dataType), *kinds]))


def _again(ids: pa.Array, marks: pa.Array, row: np.ndarray, s: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which spans another one of equal hashes precedes by id (nulls first), mark and place; which are the first at their place."""
    again, keep = np.zeros(len(h), bool), np.ones(len(h), bool)
    order = np.argsort(h)
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]]) if len(h) else again
    twice = order[same | np.append(same[1:], False)]
    if not len(twice):
        return again, keep
    table = pa.table({"h": h[twice], "g": g[twice], "i": ids.take(pa.array(row[twice])), "m": marks.take(pa.array(row[twice])), "s": s[twice]})
    sort = np.asarray(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names], null_placement="at_start"))
    twice, table = twice[sort], table.take(pa.array(sort)).combine_chunks()
    equal = lambda c: np.concatenate([[False], np.asarray(table[c].combine_chunks())[1:] == np.asarray(table[c].combine_chunks())[:-1]])
    known = pc.fill_null(table["i"], 0) if pa.types.is_integer(table["i"].type) else pc.fill_null(table["i"].cast(pa.string()), "")
    codes = np.asarray(pc.fill_null(pc.dictionary_encode(known.combine_chunks()).indices, -1)) * 2 + np.asarray(pc.is_null(table["i"].combine_chunks()))
    hashes = equal("h") & equal("g")
    place = np.concatenate([[False], codes[1:] == codes[:-1]]) & equal("m") & equal("s") & hashes
    keep[twice[place]] = False
    # an occurrence is the group's first, or at the first's place, as long as no other place has come in its group
    group = np.cumsum(~hashes)
    others = np.cumsum(hashes & ~place)
    base = np.maximum.accumulate(np.where(~hashes, others, 0))
    again[twice[(others > base) & (group > 0)]] = True
    return again, keep


def left_over(texts: pa.Array, ranges: pa.Array) -> pa.Array:
    """struct<text, n, gone>: the texts without these ranges of sentences, and how many sentences there were and went."""
    out, at = [], 0
    for part in sliced(texts, SLICE):
        cut, mine = Pieces(part), ranges.slice(at, len(part))
        at += len(part)
        flat = mine.flatten()
        row = np.repeat(np.arange(len(part)), np.asarray(pc.fill_null(pc.list_value_length(mine), 0)))
        change = np.zeros(len(cut.to) + 1, np.int64)
        np.add.at(change, cut.piece_at[row] + np.asarray(pc.struct_field(flat, "s")), 1)
        np.add.at(change, cut.piece_at[row] + np.asarray(pc.struct_field(flat, "e")) + 1, -1)
        gone = np.cumsum(change)[:-1] > 0
        count, lost = (np.bincount(of, minlength=len(part)) for of in (cut.piece_of, cut.piece_of[gone]))
        keep = np.repeat(~np.repeat(gone, cut.to - cut.piece_start), cut.end - cut.start)
        ends = np.concatenate([[0], np.cumsum(keep)])[cut.at].astype(np.int64)
        text = pa.Array.from_buffers(pa.large_string(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(cut.data[keep]))]).cast(pa.string())
        out.append(pa.StructArray.from_arrays([text, pa.array(count, pa.int64()), pa.array(lost, pa.int64())], ["text", "n", "gone"]))
    kind = pa.struct([("text", pa.string()), ("n", pa.int64()), ("gone", pa.int64())])
    return pa.concat_arrays(out) if out else pa.array([], kind)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n_sentences, n_removed and the text without repeated passages (columns of these names are replaced).

    The first occurrence of a span by key, then place, stays. Both numbers count the parts of long sentences as
    sentences; what goes are whole ones. Null stays null; texts of fewer sentences than a span stay as they are; rows that repeat key and
    text are one document, rows with the same key and other texts are ordered by a hash of them; null
    keys come first. Empty tables stay empty. A text is held whole by the worker that cuts it, at some
    twenty times its bytes. Columns of any name pass through.
    """
    own = Shielded(docs)
    docs, key_, text_ = own.docs, own[key], own[text]
    order = Window.partitionBy("h", "g").orderBy("id", "mark", "s")
    first = F.first(F.struct("id", "mark", "s")).over(order)
    # a repeated row gives the same place again, and that is as first as the first
    gone = spans(docs, key_, text_).withColumn("first", first).where(F.col("again") | ~F.struct("id", "mark", "s").eqNullSafe(F.col("first"))).select("id", "mark", "s", "e")
    left = F.arrow_udf(left_over, "struct<text string, n long, gone long>")
    out = ranged(docs, gone, key_, text_).withColumn("__left", left(text_of(text_), F.col("__ranges")))
    kept = F.when(F.col("__ranges").isNull(), F.col(text_)).otherwise(F.col("__left.text"))
    return out.select(*own.columns(text, "n_sentences", "n_removed"), kept.alias(text), F.col("__left.n").alias("n_sentences"), F.col("__left.gone").alias("n_removed"))


def op10_substring_dedup(docs: DataFrame) -> DataFrame:
    return substring_dedup(docs.select("doc_id", "text"))
