"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is a long run of characters that keys are made of, or a shorter one that a key's name stands
before; what a pattern finds in it is cut out, and what is left on either side is a candidate of its own. The network
reads it and the characters around it, in overlapping views if it is long; the largest score counts. It is
trained here, in numpy, on labelled findings: a bounded sample of the corpus' candidates, of which those that a
pattern finds are the secrets, and made-up ones of other shapes. A held-out part calibrates its scores, and the
threshold of each shape is the highest that keeps the demanded recall on the held-out secrets of either source.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import text_of
from wardline.llm.token_count import sliced

#: The patterns of the base findings (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
#: Runs that can hold a key; every access key and hex run lies in one.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Shorter runs after the name of a key.
NAMED = re.compile(r"""(?:key|auth|pwd|pass|passwd|password|secret|token|credentials?|bearer)["']?(?:\x20*[:=]\x20*|\x20)["']?([A-Za-z0-9+/_.=-]{6,15})(?![A-Za-z0-9+/_.=-])""", re.IGNORECASE | re.ASCII)

#: Characters of a candidate and on either side of it that the network reads.
INNER, OUTER = 40, 24
LENGTH = INNER + 2 * OUTER
#: Labelled findings of each class from the corpus, documents they are looked for in (about), made-up ones of each class.
SAMPLE, SAMPLE_DOCUMENTS, MADE_UP = 1_500, 20_000, 3_000
#: Demanded recall on the held-out findings, and the threshold where there are none.
RECALL, LEAST = 0.98, 0.5
EMBED, WIDTH, FILTERS, EPOCHS, BATCH, RATE = 8, 5, 16, 6, 64, 0.01


def base_findings(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the pattern findings in order, and (start, end) of all candidates."""
    found, candidates = [], []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for run in RUN.finditer(text):
        a, word = run.start(), run.group()
        if "AKIA" in word:
            found += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(word)]
        if len(word) >= 24:
            found += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(word)]
        candidates.append((a, run.end()))
    candidates += [m.span(1) for m in NAMED.finditer(text)]
    return sorted(found), sorted(candidates)


def split(candidates: list[tuple[int, int]], found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """What findings cover of candidates, and what they leave on either side; both as far as they are as long as a candidate must be."""
    covered: list[list[int]] = []  # the findings' union, in order
    for s, _, e in found:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], e)
        else:
            covered.append([s, e])
    inside, outside = [], []
    for start, end in candidates:
        least, at = 16 if end - start >= 16 else 6, start
        for s, e in itertools.takewhile(lambda x: x[0] < end, itertools.islice(covered, bisect.bisect_right(covered, start, key=lambda x: x[1]), None)):
            if s - at >= least:
                outside.append((at, s))
            if min(e, end) - max(s, start) >= 6:
                inside.append((max(s, start), min(e, end)))
            at = max(at, e)
        if end - at >= least:
            outside.append((at, end))
    return inside, outside


def shape(word: str) -> int:
    """0 digits, 1 hex, 2 capitals and digits, 3 other; 4 what is shorter than a run."""
    return 4 if len(word) < 16 else 0 if word.isdigit() else 1 if re.fullmatch("[0-9a-f]+", word) else 2 if re.fullmatch("[A-Z0-9]+", word) else 3


def view(text: str, start: int, end: int) -> str:
    """What the network reads: the candidate (its first characters) at a fixed place between its surroundings."""
    left, word, right = text[max(0, start - OUTER) : start], text[start : min(end, start + INNER)], text[end : end + OUTER]
    return left.rjust(OUTER, "\0") + word.ljust(INNER, "\0") + right.ljust(OUTER, "\0")


def parts_of(start: int, end: int) -> list[tuple[int, int]]:
    """The stretches of a candidate that are read: itself, or as many of INNER characters, each half over the next, as reach its end."""
    if end - start <= INNER:
        return [(start, end)]
    return [(a, a + INNER) for a in [*range(start, end - INNER, INNER // 2), end - INNER]]


def codes(views: list[str]) -> np.ndarray:
    """0 for none, 1 to 95 for printable ASCII, 96 for the rest."""
    raw = np.frombuffer("".join(views).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(views), LENGTH).astype(np.int64)
    return np.where(raw == 0, 0, np.where((raw >= 32) & (raw < 127), raw - 31, 96))


@dataclass
class Network:
    """Embedding, one convolution with ReLU, the largest value over the candidate and over all, a logistic output."""

    weights: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, ...] = (LEAST,) * 5

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        put = lambda *s: rng.normal(0, (2 / s[0]) ** 0.5, s)
        weights = {"e": rng.normal(0, 0.5, (97, EMBED)), "w": put(EMBED * WIDTH, FILTERS), "b": np.zeros(FILTERS), "v": put(2 * FILTERS, 1), "c": np.zeros(1)}
        return Network({k: w.astype(np.float32) for k, w in weights.items()})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, n = self.weights, len(x)
        places = LENGTH - WIDTH + 1
        patches = p["e"][x]
        patches = np.lib.stride_tricks.sliding_window_view(patches, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n * places, WIDTH * EMBED)
        act = np.maximum(patches @ p["w"] + p["b"], 0).reshape(n, places, FILTERS)
        whole, inner = act.argmax(axis=1), act[:, OUTER - 2 : OUTER + INNER - 2].argmax(axis=1) + OUTER - 2
        at, f = np.arange(n)[:, None], np.arange(FILTERS)[None]
        pooled = np.concatenate([act[at, inner, f], act[at, whole, f]], axis=1)
        return (pooled @ p["v"] + p["c"])[:, 0], (patches.reshape(n, places, -1), inner, whole, pooled)

    def step(self, x: np.ndarray, y: np.ndarray, moments: dict, t: int) -> None:
        p, n = self.weights, len(x)
        z, (patches, inner, whole, pooled) = self.forward(x)
        dz = ((1 / (1 + np.exp(-z)) - y) / n)[:, None].astype(np.float32)
        dp = (dz @ p["v"].T) * (pooled > 0)
        grad = {k: np.zeros_like(v) for k, v in p.items()} | {"v": pooled.T @ dz, "c": dz.sum(axis=0)}
        at, inside = np.arange(n)[:, None], np.arange(WIDTH)
        for place, d in ((inner, dp[:, :FILTERS]), (whole, dp[:, FILTERS:])):
            # only the places that were pooled carry a gradient: one for each filter
            grad["w"] += np.einsum("nfk,nf->kf", patches[at, place], d)
            grad["b"] += d.sum(axis=0)
            back = (d[:, :, None] * p["w"].T[None]).reshape(-1, EMBED)
            letters = x[at[:, :, None], place[:, :, None] + inside].ravel()
            grad["e"] += np.stack([np.bincount(letters, back[:, k], len(p["e"])) for k in range(EMBED)], axis=1)
        for k, g in grad.items():
            m, v = moments.setdefault(k, [np.zeros_like(g), np.zeros_like(g)])
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[k] -= np.float32(RATE) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))

    def logits(self, views: list[str]) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self.forward(codes(views[k : k + 256]))[0] for k in range(0, len(views), 256))])

    def score(self, views: list[str]) -> np.ndarray:
        """Calibrated probabilities."""
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(views) + b, -60, 60)))


def made_up(n: int, rng: random.Random) -> list[tuple[str, int, int]]:
    """(view, label, shape) of n invented secrets and n invented harmless candidates."""
    word = lambda a, b, s="abcdefghijklmnopqrstuvwxyz": "".join(rng.choices(s, k=rng.randint(a, b)))
    some = lambda: " ".join(word(1, 9) for _ in range(4))
    mixed, capitals, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
    out = []
    for k in range(n):
        path = lambda: "/".join([word(3, 9) + ".example.com", *(word(2, 9) for _ in range(rng.randint(5, 9)))])
        secret = [word(24, 48, mixed) + "7", word(4, 6) + "_" + word(24, 40, mixed) + "1", "AKIA" + word(16, 16, capitals), word(32, 64, "0123456789abcdef"), word(20, 40, mixed + "+/") + "9==", word(24, 40, mixed[:52]), word(10, 15, mixed), path() + "/" + word(32, 40, mixed)][k % 8]
        lead = rng.choice(["", "key=", "auth: ", '"', "password=", 'token = "', " "])
        harmless = [word(16, 19, digits), f"mail{rng.randint(0, 99)}.{word(4, 9)}.com", f"{word(4, 9)}/{word(4, 9)}/{word(3, 6)}-{rng.randint(1, 2000)}", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}.{word(6, 12)}", f"{word(12, 20)}{rng.randint(0, 99)}", f"{word(5, 9)}-{word(5, 9)}-{rng.randint(1, 99)}", path(), word(16, 24), rng.choice("-=_.") * rng.randint(16, 60), word(6, 12)][k % 10]
        harmless = harmless if k % 10 > 5 else harmless.ljust(16, "0")
        for y, w, before in ((1, secret, lead), (0, harmless, rng.choice(["", " ", "@", "(", "the ", "key=", "auth: "]))):
            left = f"{some()} {before}"
            text = f"{left}{w} {some()}"
            out.append((view(text, *parts_of(len(left), len(left) + len(w))[-1]), y, shape(w)))
    return out


def train(*sources: list[tuple[str, int, int]], seed: int = 4) -> Network:
    """A network from sources of (view, label, shape): four fifths fit it, one fifth calibrates it and sets thresholds,
    which keep the recall on the held-out secrets of each source."""
    rng = np.random.default_rng(seed)
    rows = sorted({r for source in sources for r in source}, key=lambda r: hashlib.sha256(r[0].encode("utf-8", "surrogatepass")).digest())
    x, y, shapes = codes([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
    held = np.arange(len(rows)) % 5 == 0
    net, moments, t = Network.fresh(rng), {}, 0
    fit = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            t += 1
            net.step(x[part], y[part], moments, t)
    z, target = net.forward(x[held])[0].astype(float), y[held]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic calibration, with a weak pull towards the identity
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w = p * (1 - p)
        g = np.array([((p - target) * z).sum() + (a - 1), (p - target).sum() + b])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    net.scale = (float(a), float(b))
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
    cuts: list[list[float]] = [[] for _ in range(5)]
    for views in ({r[0] for r in source} for source in sources):
        secret = (target == 1) & np.array([rows[k][0] in views for k in np.flatnonzero(held)], bool)
        for s in range(5):
            mine = p[secret & (shapes[held] == s)]
            mine = mine if len(mine) >= 20 else p[secret]
            if len(mine):
                cuts[s].append(float(np.sort(mine)[int((1 - RECALL) * len(mine))]))
    net.thresholds = tuple(min(c, default=LEAST) for c in cuts)
    return net


def labelled_findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Up to SAMPLE candidates of each label from about SAMPLE_DOCUMENTS documents, by a hash of their keys that reruns repeat.

    What a pattern finds in a candidate is a secret, what it leaves of one is harmless."""
    n = docs.count()
    rows = docs.select(F.xxhash64(F.lit("secrets"), key).alias("h"), text_of(text).alias("text"))
    rows = rows.where(F.pmod("h", F.lit(1_000_000)) < min(1.0, SAMPLE_DOCUMENTS / max(n, 1)) * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, candidates = base_findings(t)
                for label, spans in zip((1, 0), split(candidates, found), strict=True):
                    for start, end in spans:
                        out += [(h ^ a, view(t, a, b), label, shape(t[start:end])) for a, b in parts_of(start, end)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["h", "view", "label", "shape"])

    all_ = rows.mapInArrow(run, "h long, view string, label int, shape int")
    first = Window.partitionBy("label").orderBy("h", "view")  # a task keeps no more than the bound of each label
    return [(r.view, r.label, r.shape) for r in all_.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= SAMPLE).collect()]


def scan(docs: DataFrame, network: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, score) of every row, by start, then kind.

    Starts and ends are code points, ends exclusive; pattern findings have score 1 and always stay, the
    network adds candidates, or what those leave of them on either side. Null and empty texts have no spans. Rows are read
    one by one: repeated rows agree, an empty table stays empty, other columns are not read. Texts of any length
    are read whole, and of long candidates every part; their views are scored 256 at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            at = 0
            for part in sliced(batch.column(1)):
                spans, views, of = [], [], []
                for k, t in enumerate(part.to_pylist()):
                    found, candidates = base_findings(t)
                    spans.append([(a, i, b, 1.0) for a, i, b in found])
                    for a, b in split(candidates, found)[1]:
                        read = parts_of(a, b)
                        of.append((k, a, b, shape(t[a:b]), len(views), len(views) + len(read)))
                        views += [view(t, *x) for x in read]
                scores = net.score(views)
                for k, a, b, s, x, y in of:
                    if (p := float(scores[x:y].max())) >= net.thresholds[s]:
                        spans[k].append((a, 3, b, p))
                rows = [[{"kind": KINDS[i], "start": a, "end": b, "score": p} for a, i, b, p in sorted(x)] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(rows, kind)], ["doc_id", "spans"])
                at += len(part)

    return docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind string, start int, end int, score double>>")


def op4_secret_scan(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    rows = scan(docs, train(labelled_findings(docs), made_up(MADE_UP, random.Random(4))))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    base = F.sha2(joined(F.filter("spans", lambda x: x.kind != "model")), 256).alias("base_sha256")
    return rows.select("doc_id", *map(count, KINDS[:3]), base, joined("spans").alias("spans"), count("model"))
