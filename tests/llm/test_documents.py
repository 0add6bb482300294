"""The document operators against brute-force versions on small tables of awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from wardline.llm import decontaminate, fingerprint, graph, language_id, line_dedup, mixing, near_dedup, secret_scan, substring_dedup
from wardline.llm.graph import components

RND = random.Random(11)
VOCAB = ["".join(RND.choices("abcdefghiklmnoprst", k=RND.randint(2, 8))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n):
    return " ".join(rnd.choice(VOCAB).capitalize() if k % 9 == 0 else rnd.choice(VOCAB) + ("." if k % 9 == 8 else "") for k in range(n))


def corpus(n=60, seed=3):
    """Prose with exact and near copies, nulls, empties, white space, one long text, repeated rows, odd characters."""
    rnd = random.Random(seed)
    texts = [prose(rnd, rnd.randint(1, 160)) for _ in range(n)]
    for k in range(0, n, 4):
        words = texts[k].split(" ")
        if len(words) > 60:
            words[rnd.randrange(len(words))] = "changed"
        texts[k + 1] = " ".join(words)
    texts[5], texts[9] = texts[8].upper(), texts[8]
    texts += [None, "", " \t\n", "One", "one", "ONE two  three\tfour", "É é ß 中文 ö ö ö ö", prose(rnd, 4000), "a\nb\n\nc", "\n\n"]
    rows = [(k, t, ["en", "de", None][k % 3], ["s1", "s2", None, "s0"][k % 4], k) for k, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[0], "en", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            root[find(a)] = find(b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got) == {x for l in links if l[0] != l[1] for x in l}
    for a in got:
        assert (got[a] in got) and find(got[a]) == find(a)
    assert len(set(got.values())) == len({find(a) for a in got})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_chain_of_ascending_ids_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "cut", lambda df, name, f=graph.cut: rounds.append(name) or f(df, name))
    chain = spark.range(2000).selectExpr("id AS a", "id + 1 AS b")
    assert components(chain).select("label").distinct().count() == 1
    assert rounds.count("step") <= 15


def brute_near(rows, percent=85):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted([(str(r[0]), len(s), str(least.get(find(i)))) for i, (r, s) in enumerate(zip(rows, sets))])


def test_near_duplicates(spark, docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_near(corpus())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_drifting_group(spark):
    rnd = random.Random(5)
    base = prose(rnd, 120).split(" ")
    rows, words = [], list(base)
    for k in range(60):  # a chain of edits: neighbours are alike, ends aren't
        words[rnd.randrange(120)] = f"w{k}"
        rows.append((k, " ".join(words)))
    for k in range(60, 140):  # a star: one text and copies with few to many edits
        copy = list(base)
        for _ in range(rnd.randint(1, 12)):
            copy[rnd.randrange(120)] = f"x{rnd.random()}"
        rows.append((k, " ".join(copy)))
    rows.append((140, " ".join(base)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_near(rows)


def test_drifting_chains_with_every_row_twice(spark):
    """Links that no bucket leader has, between texts that all occur in two equal rows."""
    rnd = random.Random(12)
    rows = []
    for c in range(8):
        words = prose(rnd, 60).split(" ")
        for k in range(50):
            words[rnd.randrange(60)] = f"c{c}w{k}"
            rows.append((100 * c + k, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(6))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == sorted(brute_near(rows) * 2)


def test_sketch_estimates_high_similarities():
    rnd = np.random.default_rng(2)
    for j in (0.7, 0.85, 0.95):
        found = []
        for _ in range(40):
            n = 400
            same = int(round(2 * n * j / (1 + j)))
            x = rnd.integers(0, 2**63, 2 * n - same, np.uint64)
            a, b = x[:n], x[n - same :]
            sa, sb = (near_dedup.signature(near_dedup.minhash(s))[1] for s in (a, b))
            z = sum(int(v).bit_count() for v in (sa ^ sb).view(np.uint64))
            found.append(1 + np.log(1 - 2 * z / near_dedup.SKETCH_BITS) * near_dedup.SKETCH_BITS / (4 * near_dedup.BANDS * near_dedup.ROWS))
        assert abs(np.mean(found) - j) < 0.02
        assert j < 0.8 or min(found) > j - near_dedup.SLACK


def brute_contamination(rows, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    out = []
    for key, text, *_ in rows:
        w, hit, of = find(text), set(), set()
        for item, itext in items:
            x = find(itext)
            n = min(13, len(x))
            for k in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[k : k + n]:
                        hit |= set(range(p, p + n))
                        of.add(item)
        names = sorted(str(i) for i in of if i is not None)
        out.append((str(key), len(w), len(hit), len(of), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("limit", [10**9, 0])
def test_contamination(spark, docs, none, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    rows = corpus()
    long = rows[67][1].split(" ")
    items = [(1, rows[8][1]), (2, " ".join(long[100:140])), (2, " ".join(long[100:140])), (3, "one TWO, three"), (4, ""), (5, None), (6, "ö"), (7, " ".join(long[300:313])), (8, prose(random.Random(77), 40)), (9, "unseen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.op5_decontamination(docs, bench)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute_contamination(rows, items)
    assert decontaminate.op5_decontamination(none, bench).count() == 0
    clean = decontaminate.op5_decontamination(docs, bench.limit(0)).collect()
    assert len(clean) == len(rows)
    assert not any(r.contaminated for r in clean)
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(r[0] for r in brute_contamination(rows, items) if not r[5])


def test_mix(spark, docs, none):
    got = mixing.mix(docs).toPandas()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(got["size"]) == sorted(size(r[1]) for r in corpus())
    total = got["size"].sum()
    by = got.groupby("source", dropna=False)
    assert abs(by["target"].first().sum() - total) < 1e-6
    for name, part in by:
        assert part["source_size"].nunique() == 1
        assert part["source_size"].iloc[0] == part["size"].sum()
        assert (part["taken"] <= 3 * part["size"]).all()
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max() / 2 + 1
    again = mixing.mix(docs.repartition(2)).toPandas()
    key = ["id", "mark", "size", "taken"]
    assert again[key].sort_values(key).reset_index(drop=True).equals(got[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix(none).count() == 0
    sample = mixing.mixed_documents(docs)
    assert sample.columns == docs.columns
    assert sample.where("text is null").count() == 0


@pytest.mark.parametrize("bin_rows", [2, 4000])
def test_mix_takes_prefixes_by_key_whatever_the_bins(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    rnd = random.Random(2)
    rows = [(k, "w " * rnd.randint(0, 30), rnd.choice(["a", "a", "a", "b", "c"]), rnd.choice([0.5, 2.0])) for k in range(300)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    got = {r.id: r for r in mixing.mix(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "id long, quality double")).collect()}
    for s in "abc":
        mine = [(k, len(t.split()), q) for k, t, x, q in rows if x == s]
        u = lambda k: (int(hashlib.md5(f"mix|{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        mine.sort(key=lambda r: -np.log(u(r[0])) / r[2])
        first = got[mine[0][0]]
        rest, upto = first.target - first.epochs * first.source_size, 0
        for k, n, _ in mine:
            want = n > 0 and upto < rest and abs(rest - upto - n) < abs(rest - upto)
            assert got[k].extra == want
            upto += n


def test_targets_are_levelled(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 0), ("d", 500), (None, 3)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight, cap = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {s: 3 * n for s, n in sizes}
    want, free, left = dict.fromkeys(weight, 0.0), set(weight), 1513.0
    while True:  # as the contract says it: share, stop at the cap, share the excess again
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > cap[s]}
        if not over:
            want.update({s: unit * weight[s] for s in free})
            break
        for s in over:
            want[s], left = cap[s], left - cap[s]
        free -= over
    assert got == pytest.approx(want)


def brute_lines(rows, lone=True):
    """The texts left by the definition: chunks by rolled hashes are compared by their bytes. Without `lone` an end of a
    chunk isn't taken where the chunk, or what is left of the text, would be one line."""
    import xxhash

    def hashed(b):
        h = xxhash.xxh64_intdigest(b, 42)
        return h

    def chunks(text):
        parts = re.findall(r"[^\n]*\n|[^\n]+", text)
        h, out, start = [hashed(p.rstrip("\n").encode()) for p in parts], [], 0
        rolled = []
        for i in range(len(parts)):
            old = h[i - 1] if i else 0
            r = h[i] ^ ((old << 21 | old >> 43) & (2**64 - 1))
            rolled.append((r - 2**64 if r >= 2**63 else r) % line_dedup.MEAN == 0)
        for i in range(len(parts)):
            allowed = lone or (0 < i < len(parts) - 2 and (i == 1 or not rolled[i - 1]))
            if rolled[i] and allowed or i == len(parts) - 1:
                out.append((start, i, "".join(parts[start : i + 1]).rstrip("\n")))
                start = i + 1
        return parts, out

    seen, out = set(), []
    for key, text in sorted(rows):
        parts, cut = chunks(text)
        gone = set()
        for s, e, c in cut:
            if e > s:
                if c in seen:
                    gone |= set(range(s, e + 1))
                seen.add(c)
        out.append((key, "".join(p for k, p in enumerate(parts) if k not in gone), len(parts), len(gone)))
    return out


def test_line_dedup(spark, docs, none):
    rnd = random.Random(9)
    shared = [f"{prose(rnd, 6)}\n{prose(rnd, 5)}\n{prose(rnd, 7)}\n{prose(rnd, 5)}\n{prose(rnd, 4)}" for _ in range(4)]
    rows = []
    for k in range(80):
        own = [prose(rnd, rnd.randint(0, 5)) for _ in range(rnd.randint(0, 8))]
        own.insert(rnd.randint(0, len(own)), rnd.choice(shared))
        rows.append((k, "\n".join(own) + rnd.choice(["", "\n"])))
    frame = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_lines int").repartition(4)
    got = line_dedup.line_dedup(frame)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == brute_lines(rows)
    assert sum(r[3] for r in brute_lines(rows)) > 50
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.op7_line_dedup(frame.select("doc_id", "text")).collect()) == brute_lines(rows, lone=False)
    assert brute_lines(rows, lone=False) != brute_lines(rows)
    odd = {(r.doc_id, r.text) for r in line_dedup.op7_line_dedup(docs).collect()}
    assert odd == {(r[0], r[1]) for r in corpus()}
    assert line_dedup.op7_line_dedup(none).count() == 0


def brute_sentences(text):
    """A text's sentences by the definition, as lists of its words with what follows them; long ones divided by the words' hashes."""
    words = re.findall(r"[^.!?\s]+(?:[^\S\n]*[.!?\n]+\s*|[^\S\n]+)?|[.!?\s]+(?=[^.!?\s]|$)", text, re.A)
    assert "".join(words) == text
    out, now = [], []
    for w in words:
        now.append(w)
        if re.search(r"[.!?\n]|^\s", w, re.A):
            out.append(now)
            now = []
    return out + [now] if now else out


def brute_passages(rows):
    """Texts, sentences and removed sentences by the definition. How a long sentence is divided is taken from the words' hashes."""
    cut = {}
    for _, text in rows:
        pieces = substring_dedup.Pieces(pa.array([text]))
        hashes = dict(zip(pieces.start.tolist(), (pieces.hash >> np.uint64(32)).tolist(), strict=True))
        parts, at = [], 0
        for sentence in brute_sentences(text):
            where = list(itertools.accumulate([at, *(len(w.encode()) for w in sentence)]))
            at, ends = where[-1], {len(sentence)}
            if len(sentence) > substring_dedup.SENTENCE_WORDS:
                for k in range(len(sentence) - substring_dedup.WINDOW + 1):
                    least = min(range(k, k + substring_dedup.WINDOW), key=lambda i: (hashes[where[i]], -i))
                    ends.add(least + 1)
            ends = sorted(ends)
            parts += [sentence[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        cut[text] = parts
    seen, out = set(), []
    for key, text in sorted(rows):
        parts, gone = cut[text], set()
        bare = [[re.sub(r"\s+$", "", w, flags=re.A) for w in p] for p in parts]
        size = [len(re.sub(r"\s+$", "", "".join(p), flags=re.A).encode()) for p in parts]
        runs = set()
        for s in range(len(parts)):
            for step in (1, -1):  # the shortest run on from each sentence, and back from each
                e = s + 2 * step
                long = lambda a, b: sum(size[a : b + 1]) + b - a >= 40
                while 0 <= e < len(parts) and not long(min(s, e), max(s, e)):
                    e += step
                if 0 <= e < len(parts):
                    runs.add((min(s, e), max(s, e)))
        for s, e in sorted(runs):
            span = tuple(w for p in bare[s : e + 1] for w in p)
            if span in seen:
                gone |= set(range(s, e + 1))
            seen.add(span)
        out.append((key, "".join("".join(p) for k, p in enumerate(parts) if k not in gone), len(parts), len(gone)))
    return out


def test_sentences_go_whole(spark):
    """Short sentences that repeat, long ones, odd gaps, passages that begin and end inside sentences: the whole result."""
    rnd = random.Random(41)
    plain = lambda n: " ".join(rnd.choices(VOCAB, k=n))
    shared = [f"{plain(5)}. {plain(6)}! {plain(6)}?", f"He ran. She hid. {plain(9)}.", f"{plain(40)}.", f"{plain(13)}. {plain(14)}.\n{plain(20)}. . {plain(4)}", f"a b. c d.\n\n{plain(3)}... {plain(7)}\n \n{plain(8)}", prose(rnd, 70)]
    rows = [(k, " ".join([plain(rnd.randint(0, 20)) + rnd.choice(["", ".", ".\n", " ."]), rnd.choice(shared), rnd.choice(["", "\n", ". "]) + plain(rnd.randint(1, 20))])) for k in range(80)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(tuple(r) for r in got.collect()) == brute_passages(rows)
    probe = "One two three mango four five. Six seven plum nine. Ten eleven twelve pear melon fig."
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame([(1, f"Own words. {probe}"), (2, f"Changed here, {probe[:1].lower()}{probe[1:]} More words."), (3, f"{probe} More.")], "doc_id long, text string")).collect()}
    assert [got[k].n_removed for k in (1, 2, 3)] == [0, 0, 3]
    assert got[3].text == "More."


def test_substring_dedup(spark, docs, none):
    rnd = random.Random(8)
    passage = prose(rnd, 55) + "."
    plain = " ".join(rnd.choice(VOCAB) for _ in range(60)) + "."
    rows = [(k, " ".join([prose(rnd, rnd.randint(0, 40)) + ".", *([rnd.choice([passage, plain])] if k % 3 else []), prose(rnd, rnd.randint(1, 40))])) for k in range(60)]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got.columns == ["doc_id", "text", "n_sentences", "n_removed"]
    assert sorted(tuple(r) for r in got.collect()) == brute_passages(rows)
    kept = [r.text for r in got.collect()]
    assert sum(passage[:-1] in t for t in kept) == 1
    assert sum(plain in t for t in kept) == 1
    texts = {r.doc_id: r.text for r in substring_dedup.op10_substring_dedup(docs.where("doc_id is not null")).collect()}
    assert texts[60] is None
    assert texts[61] == ""
    assert texts[67] == corpus()[67][1]
    assert texts[9] == "" or len(texts[9]) < len(corpus()[9][1])
    assert substring_dedup.op10_substring_dedup(none).count() == 0


def test_common_lines_are_no_passages(spark):
    """Lines and sentences that many documents share stay; passages of over 50 words between them go."""
    rnd = random.Random(31)
    own = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=6)) for _ in range(n)) + "."
    common, passage = [own(n) for n in (8, 9, 13)], own(51)
    rows = [(k, "\n".join([own(12), rnd.choice(common), own(9), *([passage] if k in (3, 17) else []), own(7), common[0], own(4)])) for k in range(30)]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [k for k in got if got[k].n_removed] == [17]
    assert all(got[k].text == t for k, t in rows if k != 17)
    assert len(got[17].text.split()) <= len(rows[17][1].split()) - 22


def test_spans_of_a_batch_and_repeated_rows(spark, monkeypatch):
    """A row that is repeated is one document, in one batch and over several; others with its text lose it."""
    rnd = random.Random(32)
    text = " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(90))
    for parts in (1, 6):
        rows = [(k, text) for k in (4, 4, 4, 7, 7, 9, None, None)]
        got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert sorted((str(r.doc_id), r.text == text) for r in got) == [*[(k, False) for k in "44477"], ("9", False), ("None", True), ("None", True)]
    for size in (40, 10**6):
        monkeypatch.setattr(substring_dedup, "SLICE", size)
        rows = corpus()
        got = substring_dedup.substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
        result = sorted((str(r.doc_id), str(r.text), r.n_sentences, r.n_removed) for r in got)
        assert size == 40 or result == before
        before = result


def test_language_id(spark, docs, none):
    rnd = random.Random(6)
    words = {"aa": ["thi", "ou", "wha", "sh"], "bb": ["lich", "keit", "äu", "ß"], "cc": ["ción", "mente", "ñ", "osa"]}
    rows = [(k, " ".join("".join(rnd.choices(words[l], k=3)) for _ in range(20)), l) for k in range(300) for l in [rnd.choice("aa bb cc".split())]]
    frame = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 3!", "bb"), (None, "thi ou", None)], "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in language_id.op8_language_id(frame).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, *_ in rows)
    held = [(got[k].lang_pred, l) for k, _, l in rows if got[k].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert (got[900].lang_pred, got[900].score, got[901].lang_pred) == ("und", 0.0, "und")
    assert all(0 <= r.score <= 1 for r in got.values())
    model = language_id.fit(frame)
    alone = [model.score([t])[0][0] for _, t, _ in rows[:40]], [model.score([t])[1][0] for _, t, _ in rows[:40]]
    both = model.score([t for _, t, _ in rows[:40]])
    assert both[0] == alone[0]
    assert np.allclose(both[1], alone[1], atol=1e-4)
    assert language_id.op8_language_id(docs).count() == docs.count()
    assert language_id.op8_language_id(none).count() == 0
    wide = language_id.predict(frame.withColumn("score", frame.doc_id), model)
    assert wide.columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def brute_edited(rows):
    """(key, characters, digest of the edited text) of (key, text), in order of keys, hashes of texts, and texts."""
    import xxhash

    def rank(text):
        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - 2**64 if h >= 2**63 else h

    rows = sorted((key is not None, key or 0, rank(text or ""), text or "") for key, text in rows)
    want = []
    for k, (known, key, _, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][3]
        n = len(text) // 4
        want.append((key if known else None, len(text), hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()))
    return sorted(want, key=str)


def test_a_key_of_many_rows_is_many_bins(spark):
    """Null keys and one key with a third of the rows each: the edited texts are right, and no bin holds a key's rows alone."""
    rnd = random.Random(12)
    rows = [(rnd.choice([None, 50, k]), prose(rnd, rnd.randint(0, 12))) for k in range(300)] + [(50, "same text"), (50, "same text"), (None, "same text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bins in (1, 2, 4, 16):
        dealt = fingerprint.with_successor(docs, "doc_id", "text", bins)
        counts = {r.bin: r.n for r in dealt.where("not guest").groupBy("bin").count().withColumnRenamed("count", "n").collect()}
        assert sum(counts.values()) == len(rows)
        assert bins < 16 or max(counts.values()) < 60
        assert dealt.where("guest").count() <= len(counts) + 2
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.op2_fingerprints(docs).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got, key=str) == brute_edited(rows)


def test_fingerprints(spark, docs, none):
    got = fingerprint.op2_fingerprints(docs).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == brute_edited([r[:2] for r in corpus()])
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1
        assert 0 <= r.near_next <= 1
    assert by[8] == by[9]
    long = [r for r in got if r.n_chars > 400]
    assert np.median([r.near_edited for r in long]) > 0.6
    assert np.mean([r.near_next for r in long if r.doc_id and r.doc_id % 4 > 1]) < 0.2
    assert fingerprint.op2_fingerprints(none).count() == 0
    alone = fingerprint.op2_fingerprints(docs.where("doc_id = 7")).first()
    assert alone.near_next == 1.0


def test_fingerprint_parts():
    rnd = random.Random(3)
    for n in (0, 1, 5, 30, 300, 5000):
        data = bytes(rnd.choices(range(256), k=n))
        roll = fingerprint.rolled(np.frombuffer(data, np.uint8))
        for i in range(n)[:: max(1, n // 40)]:  # the hash at a byte depends on the last seven alone
            assert roll[i] == fingerprint.rolled(np.frombuffer(data[max(0, i - 6) : i + 1], np.uint8))[-1]
        block, one, two = fingerprint.fingerprint(data, roll).split(":")
        assert len(two) <= len(one) <= 64
        bigger = int(block) * 2
        assert len(two) == sum(v % bigger == bigger - 1 for v in roll[:-1].tolist()) + (n > 0)
    for _ in range(200):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fingerprint._distance(a, b) == len(a) + len(b) - 2 * table[-1][-1]
    assert fingerprint.likeness("3:abcdefghijkl:abc", "6:abc:x") > 0.9
    assert fingerprint.likeness("3:abcdefgh:abc", "12:abcdefgh:abc") == 0.0


def brute_base(text):
    found = []
    for kind, (pattern, least, group) in enumerate(((r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1), ("AKIA[A-Z0-9]+", 20, 0), ("[0-9a-f]+", 24, 0))):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_secret_scan(spark, docs, none):
    rnd = random.Random(7)
    hexes = lambda n: "".join(rnd.choices("0123456789abcdef", k=n))
    secrets = [f"password={hexes(18)}", f'token = "{hexes(40)}"', "AKIA" + "".join(rnd.choices("ABCDEFGH0123456789", k=16)), hexes(30), "API_KEY: 'abc.def-123='", "passwd=abc", "Secret :: x", "AKIASHORT", "ſecret=abcdefg", "toKen=abcdefgh", f"x{hexes(23)}g"]
    plain = ["4242424242424242 99", "a.b@mail3.example.com", "1234567890123456"]
    rows = [(k, f"{prose(rnd, 12)} {rnd.choice(secrets + plain) if k % 3 else ''} É {prose(rnd, 12)}") for k in range(400)] + [(500, None), (501, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in secret_scan.op4_secret_scan(frame).collect()}
    added = 0
    for key, text in rows:
        want = brute_base(text)
        assert got[key].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [got[key].n_assign, got[key].n_access, got[key].n_hex] == [sum(x.startswith(k) for x in want.split(",")) for k in ("assign", "access", "hex")]
        spans = [x for x in got[key].spans.split(",") if x]
        assert [x for x in spans if not x.startswith("model")] == [x for x in want.split(",") if x]
        added += len(spans) - len([x for x in want.split(",") if x])
        if any(p in (text or "") for p in plain):
            assert not any(x.startswith("model") for x in spans)
    assert secret_scan.op4_secret_scan(none).count() == 0
    assert secret_scan.op4_secret_scan(docs).count() == docs.count()


def test_the_network_finds_secrets_of_other_shapes():
    net = secret_scan.train(secret_scan.made_up(800, random.Random(1)))
    fresh = secret_scan.made_up(200, random.Random(2))
    p = net.score([r[0] for r in fresh])
    said = np.array([x >= net.thresholds[s] for x, (_, _, s) in zip(p, fresh)])
    truth = np.array([r[1] == 1 for r in fresh])
    assert said[truth].mean() > 0.93
    assert said[~truth].mean() < 0.05
