"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a matrix of log probabilities, languages by hashed n-grams, fitted on a bounded sample and
broadcast; its size depends on the number of languages alone. Texts are scored in numpy by gathering
the rows of their n-grams and summing them by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import trim
from wardline.llm.token_count import sliced

#: Hashed features, longest n-gram, and the labelled documents the model is fitted on for each language, about.
FEATURES, LONGEST, SAMPLE = 1 << 15, 3, 4_000
#: Languages a model knows at most: a column of dirty labels can have any number of values.
LANGUAGES = 1_000
#: A document's evidence counts as that of so many n-grams at most, so that scores don't all end at 1.
EVIDENCE = 40.0
UNKNOWN = "und"
#: Bytes of texts that are read at a time; of a text of more characters so many positions at a time.
SLICE = 1_000_000

_LETTER = regex.compile(r"\p{L}")
_P = [np.uint32(p) for p in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def _unit(text: str) -> str:
    return " " + text.lower() + " " * LONGEST


def _hashed(codes: np.ndarray) -> np.ndarray:
    """Hashed n-grams of 1 to LONGEST characters from each position on (positions x lengths)."""
    out = np.empty((len(codes), LONGEST), np.int32)
    for n in range(1, LONGEST + 1):
        h = np.full(len(codes), n * 0x01000193, np.uint32)
        for k in range(n):
            h[: len(codes) - k] = (h[: len(codes) - k] ^ codes[k:]) * _P[k]
        out[:, n - 1] = (h ^ (h >> np.uint32(15))) * _P[0] >> np.uint32(17)
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts one after another, and where each text's begin (one more at the end).

    n-grams don't cross texts: every text ends with blanks, and those at which an n-gram could begin that
    reaches the next text all count as feature 0."""
    units = [_unit(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(u) for u in units])])
    found = _hashed(_codes("".join(units)))
    for k in range(1, LONGEST):
        found[starts[1:] - k] = 0
    return found.reshape(-1), starts * LONGEST


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def long_features(text: str) -> Iterator[np.ndarray]:
    """The same n-grams of one text, some of its positions at a time."""
    unit = _unit(text)
    for at in range(0, len(unit), SLICE):
        found = _hashed(_codes(unit[at : at + SLICE + LONGEST - 1]))[: len(unit) - at][:SLICE]
        found[max(0, len(unit) - at - LONGEST + 1) :] = 0
        yield found.reshape(-1)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # languages x features

    def evidence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the sums of log probabilities by language, the number of n-grams, and whether it has letters."""
        known = np.array([bool(_LETTER.search(t)) for t in texts])
        if len(texts) == 1 and len(texts[0]) > SLICE:
            found = [(np.array([row[part].sum(dtype=np.float64) for row in self.logp]), len(part)) for part in long_features(texts[0])]
            return sum(x for x, _ in found)[None], np.array([sum(n for _, n in found)]), known
        found, starts = features(texts)
        return np.stack([np.add.reduceat(row[found], starts[:-1]) for row in self.logp], axis=1), np.diff(starts), known

    def decided(self, sums: np.ndarray, n: np.ndarray, known: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score; `und` and 0 without letters."""
        n = n[:, None]
        logits = sums / n * np.minimum(n, EVIDENCE)
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(n)), best], 0.0)

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; `und` and 0 for texts without letters, and for all if no language is known."""
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        return self.decided(*self.evidence(texts))


def held_out(key: str) -> Column:
    """Rows that the model never learns from: crc32 of the key as text leaves 1 on division by 3 (null: as empty)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """A model from about `sample` documents of each language, chosen by a hash of the key among those not held out, for
    the LANGUAGES languages of most documents; all are taken for equally likely."""
    rows = docs.where(~held_out(key)).where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, FEATURES), np.float32))
    shares = F.create_map(*(F.lit(x) for name in langs for x in (name, min(1.0, sample / sizes[name]))))
    share = F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("language"), "key", F.when(F.col("key").isNull(), F.col("text"))), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            names, at = batch.column(1).to_pylist(), 0
            for part in sliced(batch.column(0), SLICE):
                texts = part.to_pylist()
                if len(texts) == 1 and len(texts[0]) > SLICE:
                    counted = [(langs.index(names[at]), f) for f in long_features(texts[0])]
                else:
                    found, starts = features(texts)
                    of = np.array([langs.index(n) for n in names[at : at + len(texts)]]).repeat(np.diff(starts))
                    counted = [(k, found[of == k]) for k in np.unique(of)]
                for k, some in counted:
                    total[k] = total.get(k, 0) + np.bincount(some, minlength=FEATURES)
                at += len(texts)
        for k, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[some].astype(np.int64))], ["l", "f", "n"])

    rows_ = chosen.select("text", "lang").mapInArrow(count, "l int, f int, n long").groupBy("l", "f").agg(F.sum("n").alias("n")).toArrow()
    counts = np.ones((len(langs), FEATURES))
    counts[rows_["l"].to_numpy(), rows_["f"].to_numpy()] += rows_["n"].to_numpy()
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs` and lang_pred, score (columns of these names are replaced).

    Null, empty and letterless texts are `und` with score 0; ties go to the first language by name.
    Each row is scored alone: repeated rows agree, an empty table stays empty. The evidence of
    texts of more than SLICE characters is added up over parts of them, with the same result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[c for c in docs.columns if c not in ("lang_pred", "score")])
    schema, at = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]), base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for part in sliced(pc.fill_null(batch.column(at), ""), SLICE):
                a, b = shared.value.score(part.to_pylist())
                langs += a
                scores.append(b)
            both = [pa.array(langs, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *both], [*batch.schema.names, "lang_pred", "score"])
            trim()

    return base.mapInArrow(run, schema)


def op8_language_id(docs: DataFrame) -> DataFrame:
    out = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
