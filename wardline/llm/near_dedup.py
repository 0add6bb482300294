"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, components.

1. Each text becomes its set of distinct word shingles; a MinHash sample of it gives band keys, and the
   sample folded into a parity bitmap (an odd sketch) gives a close estimate of high similarities.
2. Equal sets form a class; from here on only classes are compared.
3. In every band bucket all classes are compared with one leader, the class that shares most buckets
   with others. Sketches drop what is clearly different, the full sets decide, links are contracted.
4. What then still shares a bucket without sharing a component goes through an exact prefix filter over
   the rarest shingles, and its pairs through sketches and full sets, so that no bucket is capped and
   yet no group of copies is expanded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import Shielded, cut, forget, text_of, trim
from wardline.llm.graph import components
from wardline.llm.shingles import mixed, shingle_sets
from wardline.llm.token_count import sliced

#: 32 bands of 6: a pair of similarity 0.85 is missed with a chance of 3e-7.
BANDS, ROWS = 32, 6
#: Bits of an odd sketch; a pair is dropped unread only if its estimate is this far under the threshold
#: (over five standard errors of the sample).
SKETCH_BITS, SLACK = 1024, 0.18
#: Width of the classes of set sizes in the prefix filter.
SIZE_STEP = 1.04

_RANDOM = np.random.default_rng(20)
_A = (_RANDOM.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1))[:, None]
_B = _RANDOM.integers(0, 2**32, BANDS * ROWS, np.uint32)[:, None]
_SALT = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Nodes are below 10**18; a rank times this plus the node orders both in one decimal.
_SHIFTED = 10**18


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each permutation over a non-empty set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(best, (_A * low[None, k : k + 1024] + _B).min(axis=1), out=best)
    return best


def signature(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch of a MinHash sample, both as int64."""
    marks = mixed(_SALT ^ sample.astype(np.uint64))
    bands = mixed(np.bitwise_xor.reduce(marks.reshape(BANDS, ROWS) * np.uint64(0x9E3779B97F4A7C15), axis=1) + np.arange(BANDS, dtype=np.uint64))
    flips = np.bincount((marks >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return bands.view(np.int64), np.packbits(flips.astype(np.uint8)).view(np.int64)


def estimate(differing: Column) -> Column:
    """The similarity that so many differing sketch bits suggest."""
    n, k = SKETCH_BITS, BANDS * ROWS
    gone = F.least(F.lit(0.999), 2 * differing / F.lit(n))
    return 1 + F.log(1 - gone) * (n / (4 * k))


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent order-free sums over the set: with the size, its identity."""
    with np.errstate(over="ignore"):
        return int(mixed(shingles + np.uint64(0x51ED270B)).sum(dtype=np.uint64).view(np.int64)), int(mixed(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64))


def _int64(rows: list) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def signed(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n, hi, lo, bands, sketch of every row; bands and sketch are empty for an empty set."""
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in sliced(batch.column(2)):
                sizes, his, los, bands, sketches = [], [], [], [], []
                for s in shingle_sets(part, width):
                    b, o = signature(minhash(s)) if len(s) else (none, none)
                    hi, lo = _digest(s)
                    for out, value in ((sizes, len(s)), (his, hi), (los, lo), (bands, b), (sketches, o)):
                        out.append(value)
                head = [batch.column(k).slice(at, len(part)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(x, pa.int64()) for x in (sizes, his, los)), _int64(bands), _int64(sketches)], ["row", "doc_id", "n", "hi", "lo", "bands", "sketch"])
                at += len(part)
            trim()

    lean = docs.select(F.xxhash64(key, text).alias("row"), F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return lean.mapInArrow(run, "row long, doc_id long, n long, hi long, lo long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """node, n, shingles of the wanted (row, node, hi, lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in sliced(batch.column(3)):
                nodes, rows = [], []
                for k, s in enumerate(shingle_sets(part, width), at):
                    if _digest(s) == (batch.column(1)[k].as_py(), batch.column(2)[k].as_py()):
                        nodes.append(batch.column(0)[k].as_py())
                        rows.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(r) for r in rows], pa.int64()), _int64(rows)], ["node", "n", "shingles"])
                at += len(part)
            trim()

    texts = docs.select(F.xxhash64(key, text).alias("row"), text_of(text).alias("text"))
    # rows that repeat key and text give their node's set once; the join has sorted them next to each other
    once = texts.join(wanted, "row").dropDuplicates(["row"]).select("node", "hi", "lo", "text")
    return once.mapInArrow(run, "node long, n long, shingles array<long>")


def _linked(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets pass: sketches first, then the full sets."""
    of = lambda t, name, *cols: t.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in cols))
    near = pairs.join(of(sketches, "a", "n", "sketch"), "a").join(of(sketches, "b", "n", "sketch"), "b")
    near = near.where(100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n"))
    differing = F.aggregate(F.zip_with("a_sketch", "b_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = cut(near.where(estimate(differing) >= percent / 100 - SLACK).select("a", "b").distinct(), "near")
    full = near.join(of(sets, "a", "shingles"), "a").join(of(sets, "b", "shingles"), "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    linked = cut(full.where(100 * common >= percent * (F.size("a_shingles") + F.size("b_shingles") - common)).select("a", "b").distinct(), "links")
    forget(near)
    return linked


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """The common shingles that sets of these sizes need at least."""
    return F.floor((percent * (n + m) + (99 + percent)) / F.lit(100 + percent)).cast("long")


def _rest(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the nodes (node, label) of different labels that can pass at all.

    A prefix filter: with shingles in one order, rare ones first, the first shingle that two sets of sizes n and m
    share stands so early in both that the overlap which their sizes ask for still fits behind it. Sizes fall
    into classes a few percent wide, and a set offers for each class of partners just the shingles that can
    be first with them: texts of one template that are less alike than asked for then meet in no shingle,
    since what is their own comes before what all of them have. Places bound the overlap once more, pair by
    pair. Shingles of one label aren't joined."""
    each = sets.join(rest, "node").select("node", "label", "n", F.explode("shingles").alias("s"))
    counts = each.groupBy("s").agg(F.count("*").alias("c"))
    n, place = F.col("n"), F.col("i")
    size = (n - F.ceil(percent * n / 100) + 1).cast("int")
    ranked = each.join(counts, "s").groupBy("node", "label", "n").agg(F.array_sort(F.collect_set(F.struct("c", "s"))).alias("order"))
    prefix = ranked.select("node", "label", "n", F.posexplode(F.slice("order", F.lit(1), size)).alias("i", "x"))
    kind = lambda n: F.floor(F.log(n.cast("double")) / math.log(SIZE_STEP)).cast("int")
    least = F.greatest(F.ceil(percent * n / 100), F.floor(F.pow(F.lit(SIZE_STEP), F.col("with"))).cast("long") - 1, F.lit(1))
    own, with_ = kind(n), F.col("with")
    prefix = prefix.select("node", "label", "n", "i", "x.s", F.explode(F.sequence(kind(F.greatest(F.lit(1), F.floor(percent * n / 100) - 1)), kind(F.ceil(100 * n / percent) + 1))).alias("with"))
    prefix = prefix.where(place <= n - _overlap(n, least, percent)).select("node", "label", "n", (n - place).alias("room"), "s", own.alias("own"), F.least(own, with_).alias("low"), F.greatest(own, with_).alias("high"))
    prefix = cut(prefix, "prefix")
    key = ["s", "low", "high"]
    shared = prefix.groupBy(*key).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select(*key)
    some = cut(prefix.join(shared, key, "left_semi"), "prefix")
    of = lambda side, *names: some.where(F.col("own") == F.col(side)).select(*key, *(F.col(c).alias(n) for c, n in zip(("node", "label", "n", "room"), names, strict=True)))
    pairs = of("low", "a", "x", "m", "k").join(of("high", "b", "y", "n", "l"), key).where("(low < high or a < b) and x <> y")
    pairs = pairs.where((100 + percent) * F.least("k", "l") >= percent * (F.col("m") + F.col("n")))
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    forget(prefix, some)
    return pairs


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row (a hash of key and text), group for every row of `docs`.

    Rows are linked if 100 * intersection >= percent * union of their shingle sets. component_id is the
    smallest key that links reach; kept says that it is the row's own. Null and empty texts have no
    shingles, no links and are kept. Repeated rows share one fate (all kept or none); a null key never
    becomes a component's id unless it has no other. Other columns are not read. An empty table gives
    an empty table. Links are found by MinHash (see BANDS) and confirmed on the full sets. A text of any length
    is one row, whose shingles (8 bytes a word) are in memory together.
    """
    shift = F.lit(_SHIFTED).cast("decimal(19,0)")
    all_ = cut(signed(docs, width, key, text), "signed")
    classes = all_.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    same = ["hi", "lo", "n", "row"]
    first = all_.join(classes.select(*same, "node"), same).dropDuplicates(same)
    banded = first.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("c")).where("x <> y").select("band", "c")
    members = cut(banded.join(shared, "band"), "members")
    nodes = cut(members.select("node").distinct(), "nodes")
    sets = cut(_sets(docs, classes.join(nodes, "node").select("row", "node", "hi", "lo"), width, key, text), "sets")
    sketches = cut(first.select("node", "n", "sketch").join(nodes, "node"), "sketches")

    # the class that meets most others in its buckets leads them: in a group of edited copies, the original
    central = members.groupBy("node").agg(F.sum("c").alias("central"))
    rank = F.col("central").cast("decimal(38,0)") * shift + (_SHIFTED - 1 - F.col("node"))
    leaders = members.join(central, "node").withColumn("rank", rank.cast("decimal(38,0)")).groupBy("band").agg((_SHIFTED - 1 - (F.max("rank") % shift).cast("long")).alias("a"))
    stars = members.join(leaders, "band").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = _linked(stars, sketches, sets, percent)
    labels = components(links)

    named = cut(members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")), "named")
    mixed_ = named.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    rest = cut(named.join(mixed_, "band", "left_semi").select("node", "label").distinct(), "rest")
    pairs = _rest(rest, sets, percent)
    late = _linked(pairs, sketches, sets, percent)
    if not late.isEmpty():
        labels = components(links.union(late))

    least = classes.join(labels, "node", "left").select("hi", "lo", "n", "least", F.coalesce("label", "node").alias("label"))
    groups = least.groupBy("label").agg(F.min("least").alias("component_id"))
    found = cut(least.join(groups, "label").select("hi", "lo", "n", "component_id", F.col("label").alias("group")), "found")
    forget(members, nodes, sets, sketches, links, named, rest, pairs, late, classes)
    out = all_.select("doc_id", "hi", "lo", "n", "row").join(found, ["hi", "lo", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row", "group")


def one_of_each(docs: DataFrame, percent: int = 85, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, of which no other row of their group is kept.

    Of each group one row stays, also where its rows repeat each other or share a key: one with the least key
    (null if there is no other), then the least hash of key and text, then the first
    by its other columns. Rows without shingles all stay.
    """
    own = Shielded(docs)
    docs, key, text = own.docs, own[key], own[text]
    found = near_duplicates(docs, percent, width, key, text)
    chosen = found.where("kept and n_shingles > 0").groupBy("group").agg(F.min("row").alias("__row"))
    chosen = cut(found.where("n_shingles = 0").select(F.col("row").alias("__row"), F.lit(True).alias("__all")).distinct().unionByName(chosen.select("__row", F.lit(False).alias("__all"))), "chosen")
    # a row's hash alone could be another row's, which a key beside it rules out as far as keys differ
    keyed = found.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).distinct().join(chosen, "__row")
    same = (F.xxhash64(key, text) == F.col("__row")) & F.col(key).cast("long").eqNullSafe(F.col("__id"))
    copy = F.row_number().over(Window.partitionBy("__row", "__id").orderBy(F.to_json(F.struct(*(c for c in docs.columns if c != text)))))
    return docs.join(keyed, same).withColumn("__copy", copy).where("__all or __copy = 1").select(*own.columns())


def op9_near_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id", "kept")


#: All pairs that share a shingle, and all that links reach; for small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i : i + 4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.r = x JOIN n v ON v.r = y WHERE 100 * c >= 85 * (u.n + v.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
f AS (SELECT r, r AS q FROM n UNION SELECT f.r, e.y FROM f JOIN e ON e.x = f.q),
m AS (SELECT f.r, min(d.doc_id) AS least FROM f JOIN d ON d.r = f.q GROUP BY f.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN d.doc_id ELSE m.least END AS component_id,
       d.doc_id IS NOT DISTINCT FROM CASE WHEN n.n IS NULL THEN d.doc_id ELSE m.least END AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
