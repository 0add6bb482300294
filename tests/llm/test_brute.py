"""Whole results of the operators that SQL can't express against plain versions of their definitions, and of the pipeline."""

import hashlib
import json
import math
import random
import re
import struct
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from wardline.llm import decontaminate, fingerprint, language_id, line_dedup, mixing, near_dedup, secret_scan, substring_dedup, token_count, token_files

SMALL = "abcdefghijklmnopqrstuvwxyz"
SYLLABLES = {"aa": ["thi", "ou", "wha", "sh"], "bb": ["lich", "keit", "äu", "ß"], "cc": ["ción", "mente", "ñ", "osa"]}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 4))) for _ in range(n))


# ---------------------------------------------------------------- language ID


def ngrams(text):
    """Features of every position's 1-, 2- and 3-gram; where the last ones would leave the text they count as feature 0."""
    unit = [ord(c) for c in " " + text.lower() + "   "]
    primes = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    out = []
    for i in range(len(unit)):
        for n in (1, 2, 3):
            h = n * 0x01000193
            for k in range(n):
                if i + k < len(unit):
                    h = (h ^ unit[i + k]) * primes[k] & 0xFFFFFFFF
            out.append(0 if i >= len(unit) - 2 else ((h ^ h >> 15) * primes[0] & 0xFFFFFFFF) >> 17)
    return out


def brute_languages(rows):
    """(language, score) of each (id, text, lang) by multinomial naive Bayes with add-one smoothing."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1
    counts = {}
    for i, text, lang in rows:
        if lang is not None and text is not None and not held(i):
            mine = counts.setdefault(lang, {})
            for f in ngrams(text):
                mine[f] = mine.get(f, 0) + 1
    out = []
    for _, text, _ in rows:
        if not counts or not re.search(r"[^\W\d_]", text or ""):
            out.append(("und", 0.0))
            continue
        found = ngrams(text)
        logits = {}
        for lang, mine in counts.items():
            total = sum(mine.values()) + language_id.FEATURES
            mean = sum(math.log((mine.get(f, 0) + 1) / total) for f in found) / len(found)
            logits[lang] = mean * min(len(found), language_id.EVIDENCE)
        top = max(logits.values())
        share = {lang: math.exp(x - top) for lang, x in logits.items()}
        best = min(lang for lang in share if share[lang] == max(share.values()))
        out.append((best, share[best] / sum(share.values())))
    return out


def test_language_id_is_naive_bayes(spark, monkeypatch):
    rnd = random.Random(41)
    rows = [(k, prose(rnd, lang, rnd.randint(1, 30)), lang if k % 5 else None) for k in range(90) for lang in [rnd.choice("aa bb cc".split())]]
    rows += [(200, None, "aa"), (201, "", "aa"), (202, "12 !?", "bb"), (203, "x", "cc"), (None, "thi ou wha", "aa"), (204, "中文 字", None), (205, "ÄU SS " * 300, "bb")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.op8_language_id(frame).collect()}
    for (i, _, _), (lang, score) in zip(rows, brute_languages(rows), strict=True):
        assert got[i][0] == lang
        assert got[i][1] == pytest.approx(score, abs=2e-3)
    monkeypatch.setattr(language_id, "SLICE", 100)  # long texts are then read in parts
    parts = language_id.predict(frame, language_id.fit(frame)).collect()
    assert all(r.lang_pred == got[r.doc_id][0] and r.score == pytest.approx(got[r.doc_id][1], abs=1e-4) for r in parts)
    wide = frame.withColumn("lang_pred", frame.doc_id).withColumn("__x", frame.lang)
    assert language_id.predict(wide, language_id.fit(frame)).columns == ["doc_id", "text", "lang", "__x", "lang_pred", "score"]
    assert {r.lang_pred for r in language_id.predict(frame, language_id.fit(frame.where("lang is null"))).collect()} == {"und"}


# ---------------------------------------------------------------- fingerprints


def brute_fingerprint(text):
    data = text.encode()
    values = []
    for i in range(len(data)):
        last = [data[j] if j >= 0 else 0 for j in range(i - 6, i + 1)]
        shifted = 0
        for x in last:
            shifted = (shifted << 5 ^ x) & 0xFFFFFFFF
        values.append((sum(last) + sum((k + 1) * x for k, x in enumerate(last)) + shifted) & 0xFFFFFFFF)
    block = 3
    while sum(v % block == block - 1 for v in values) >= 64:
        block *= 2

    def signature(size):
        out, start = "", 0
        for i, v in enumerate(values):
            if v % size == size - 1 or i == len(values) - 1:
                out += fingerprint.ALPHABET[xxhash.xxh32_intdigest(data[start : i + 1]) & 63]
                start = i + 1
        return out

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def brute_likeness(x, y):
    if x == y:
        return 1.0
    best = 0.0
    (bx, *sx), (by, *sy) = ((int(b), *s) for b, *s in (x.split(":"), y.split(":")))
    for i, a in enumerate(sx):
        for j, b in enumerate(sy):
            run = min(7, max(2, min(len(a), len(b)) // 4))
            if bx << i != by << j or not a or not b or not any(a[k : k + run] in b for k in range(len(a) - run + 1)):
                continue
            row = [0] * (len(b) + 1)  # lengths of common subsequences
            for c in a:
                new = [0]
                for k, d in enumerate(b):
                    new.append(row[k] + 1 if c == d else max(row[k + 1], new[k]))
                row = new
            best = max(best, 2 * row[-1] / (len(a) + len(b)))
    return best


def test_fingerprints_whole_results(spark):
    rnd = random.Random(42)
    texts = [None, "", "é", "abc", prose(rnd, "bb", 3000), *(prose(rnd, rnd.choice("aa bb cc".split()), rnd.randint(1, 400)) for _ in range(40))]
    texts += [texts[9], texts[9] + " more", texts[9][: len(texts[9]) * 3 // 4]]
    rows = list(enumerate(texts))
    order = [t or "" for t in texts]
    got = {r.doc_id: r for r in fingerprint.op2_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    prints = [brute_fingerprint(t) for t in order]
    for k, t in enumerate(order):
        n = len(t) // 4
        edited = t[: len(t) - n] + order[(k + 1) % len(order)][:n]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[k], brute_fingerprint(edited))
        assert r.near_edited == pytest.approx(brute_likeness(prints[k], r.edited_fingerprint))
        assert r.near_next == pytest.approx(brute_likeness(prints[k], prints[(k + 1) % len(order)]))


def test_places_by_halving(spark):
    rnd = random.Random(43)
    for n in (0, 1, 2, 7, 64, 100):
        borders = sorted(rnd.sample(range(1000), n))
        df = spark.range(0, 1001, 13)
        got = {r.id: r.b for r in df.select("id", fingerprint._below(borders, df.id).alias("b")).collect()}
        assert got == {v: sum(b < v for b in borders) for v in got}


# ---------------------------------------------------------------- secrets


def test_model_spans_by_definition(spark):
    """Every run and named word that no pattern finding touches, scored by its best view, against its shape's threshold."""
    rnd = random.Random(44)
    mixed = SMALL + SMALL.upper() + "0123456789"
    made = [lambda: "".join(rnd.choices(mixed, k=rnd.randint(14, 90))), lambda: "key=" + "".join(rnd.choices(mixed, k=12)), lambda: "password=" + "".join(rnd.choices(mixed, k=20)), lambda: "/".join("".join(rnd.choices(SMALL, k=6)) for _ in range(rnd.randint(3, 30))), lambda: "".join(rnd.choices("0123456789abcdef", k=40)), lambda: "-" * 40, lambda: "É" * 20]
    rows = [(k, " ".join(x for _ in range(rnd.randint(0, 5)) for x in (prose(rnd, "aa", 3), rnd.choice(made)()))) for k in range(150)] + [(900, None), (901, ""), (902, "".join(rnd.choices(mixed, k=5000)))]
    net = secret_scan.train(secret_scan.made_up(800, random.Random(4)))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), net).collect()}
    found = 0
    for key, text in rows:
        text = text or ""
        base = [(m.start(), m.end()) for m in secret_scan.ASSIGN.finditer(text) if len(m[2]) >= 6] + [m.span() for p in (secret_scan.ACCESS, secret_scan.HEX) for m in p.finditer(text)]
        candidates = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_.=-]{16,}", text)] + [m.span(1) for m in secret_scan.NAMED.finditer(text)]
        want = []
        for a, b in candidates:
            if any(s < b and a < e for s, e in base):
                continue
            views = [(a, b)] if b - a <= 40 else [(x, x + 40) for x in [*range(a, b - 40, 20), b - 40]]
            texts = [text[max(0, x - 24) : x].rjust(24, "\0") + text[x:y].ljust(40, "\0") + text[y : y + 24].ljust(24, "\0") for x, y in views]
            word = text[a:b]
            shape = 4 if len(word) < 16 else 0 if word.isdigit() else 1 if set(word) <= set("0123456789abcdef") else 2 if word == word.upper() and word.isalnum() else 3
            if max(net.score(texts)) >= net.thresholds[shape]:
                want.append(("model", a, b))
        assert [s for s in got[key] if s[0] == "model"] == sorted(want, key=lambda s: s[1:])
        found += len(want)
    assert found > 50


# ---------------------------------------------------------------- near duplicates


def test_the_prefix_filter_loses_no_pair_and_meets_no_template(spark):
    rnd = random.Random(49)
    sets = []
    for _ in range(40):  # families of sets of many sizes about the threshold
        base = [rnd.getrandbits(62) for _ in range(rnd.choice([1, 2, 5, 19, 20, 40, 130]))]
        for _ in range(6):
            kept = [x for x in base if rnd.random() > 0.06]
            sets.append(sorted({*kept, *(rnd.getrandbits(62) for _ in range(rnd.randint(0, len(base) // 9)))} or set(base)))
    frame = spark.createDataFrame([(k, len(x), x) for k, x in enumerate(sets)], "node long, n long, shingles array<long>")
    rest = frame.selectExpr("node", "node AS label")
    got = {tuple(r) for r in near_dedup._rest(rest, frame, 85).collect()}
    alike = {(i, j) for j in range(len(sets)) for i in range(j) for same in [len({*sets[i]} & {*sets[j]})] if 100 * same >= 85 * (len(sets[i]) + len(sets[j]) - same)}
    assert len(alike) > 100
    assert alike <= got
    template = [rnd.getrandbits(62) for _ in range(91)]
    pages = [(k, 100, sorted([*template, *(rnd.getrandbits(62) for _ in range(9))])) for k in range(60)]  # similarity 0.835
    frame = spark.createDataFrame(pages, "node long, n long, shingles array<long>")
    assert near_dedup._rest(frame.selectExpr("node", "node AS label"), frame, 85).count() == 0


# ---------------------------------------------------------------- the pipeline


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_groups(rows):
    """One of each group of near duplicates: the least id; rows without words all stay."""
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best.setdefault(find(i), []).append((math.inf if r[0] is None else r[0], i))
    return [r for i, r in enumerate(rows) if not sets[i] or min(best[find(i)])[1] == i]


def brute_clean(rows, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    out = []
    for row in rows:
        w, hit = find(row[1]), set()
        for _, item in items:
            x = find(item)
            n = min(13, len(x))
            for k in range(len(x) - n + 1) if n else ():
                hit |= {q for p in range(len(w) - n + 1) if w[p : p + n] == x[k : k + n] for q in range(p, p + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(row)
    return out


def brute_mix(rows, labels):
    """Rows as often as they are taken: whole epochs, then the shortest prefix by key that is nearest to the rest."""
    best = {}
    for i, quality, _ in labels:
        if i is not None and quality is not None:
            best[i] = max(best.get(i, 0), quality)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(sources)}
    total = {s: sum(size(r) for r in rows if r[3] == s) for s in sources}
    target, free, left = {}, set(sources), float(sum(total.values()))
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > 3 * total[s]}
        for s in over or free:
            target[s] = 3.0 * total[s] if over else unit * weight[s]
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    key = lambda r: -math.log((int(hashlib.md5(f"mix|{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / ({True: 2.0, False: 0.5}[best[r[0]] > 0] if r[0] in best else 1.0)
    out = []
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s and size(r)), key=key)
        epochs = math.floor(target[s] / total[s] + 1e-12) if total[s] else 0
        rest, upto = target[s] - epochs * total[s], 0
        for r in mine:
            extra = upto < rest and abs(rest - upto - size(r)) < abs(rest - upto)
            upto += size(r)
            out += [r] * (epochs + extra)
    return out


def pipeline_rows():
    rnd = random.Random(45)
    rows, langs = [], "aa bb cc".split()
    for k in range(120):
        lang = langs[k % 3]
        rows.append([k, prose(rnd, lang, rnd.randint(3, 90)), lang if k % 4 else None, ["web", "code", None, "books"][k * 7 % 4], 0])
    for k in range(0, 60, 5):  # exact and near copies, in chains too
        words = rows[k][1].split(" ")
        rows.append([200 + k, rows[k][1], rows[k][2], "web", 0])
        if len(words) > 50:
            words[7] = "changed"
            rows.append([300 + k, " ".join(words), rows[k][2], None, 0])
    items = [(1, prose(rnd, "aa", 30)), (2, prose(rnd, "bb", 13)), (3, None), (4, "")]
    rows += [[400, f"{prose(rnd, 'aa', 20)} {items[0][1]} {prose(rnd, 'aa', 20)}", "aa", "web", 0], [401, items[1][1] + " x " + prose(rnd, "bb", 3), "bb", "code", 0], [402, prose(rnd, "bb", 400) + " " + items[1][1], "bb", "code", 0]]
    rows += [[500, None, "aa", "web", 0], [501, "", None, None, 0], [502, "123 456", "bb", "web", 0], [503, " \n\t", "cc", "x", 0], [504, prose(rnd, "cc", 3000), "cc", "books", 0], [10, rows[10][1], rows[10][2], rows[10][3], 0], [10, rows[10][1], rows[10][2], rows[10][3], 0]]
    labels = [(k, k % 2, 0) for k in range(0, 100, 3)] + [(None, 1, 0), (9, 1, 0), (12, None, 1)]
    return [tuple(r) for r in rows], items, labels


def test_the_pipeline_against_brute_force(spark, tmp_path):
    rows, items, labels = pipeline_rows()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    said = brute_languages([(r[0], r[1], r[2]) for r in rows])
    assert min(abs(score - corpus_pipeline.LEAST_SCORE) for lang, score in said if lang != "und") > 3e-3  # none on the edge
    kept = [r for r, (lang, score) in zip(rows, said, strict=True) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE]
    single = brute_groups(kept)
    clean = brute_clean(single, items)
    mixed = brute_mix(clean, labels)
    assert len(rows) > len(kept) > len(single) > len(clean)
    assert len(set(mixed)) < len(mixed)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in mixed:
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1]
        want.append((r[0], len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    assert sorted(r[1:] for r in got) == sorted(want)
    assert [r[1] for r in got] == sorted(r[1] for r in got)
    assert [r[0] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()


def test_stages_keep_the_columns_and_bear_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, "thi ou wha", "aa", None, 1), (2, "thi ou sh sh", "aa", "s", None), (None, None, None, None, None)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).columns == none.columns, name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
        assert set(stage(spark, some, str(tmp_path)).collect()) <= set(some.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0


def test_one_of_each_group(spark):
    rnd = random.Random(46)
    text = prose(rnd, "aa", 60)
    near = text.replace(" ", " ", 1) + " end"
    rows = [(5, text, "a"), (5, text, "b"), (5, near, "c"), (3, near, "d"), (None, text, "e"), (9, None, "f"), (9, None, "f"), (8, "", "g"), (None, prose(rnd, "bb", 30), "h"), (None, prose(rnd, "cc", 30), "i"), (7, "short", "j"), (6, "short", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __copy string").repartition(3).withColumnRenamed("__copy", "tag")
    got = near_dedup.one_of_each(frame)
    assert got.columns == frame.columns
    assert sorted(r.tag for r in got.collect()) == ["d", "f", "f", "g", "h", "i", "k"]
    ties = [(5, text, "a"), (5, text, "b"), (5, near, "c")]
    assert near_dedup.one_of_each(spark.createDataFrame(ties, "doc_id long, text string, tag string")).count() == 1


def test_repeated_rows_come_as_often_as_planned(spark):
    rnd = random.Random(47)
    text = prose(rnd, "aa", 10)
    rows = [(1, text, "s", k) for k in range(7)] + [(k, prose(rnd, "bb", 10), "s", k) for k in range(2, 20)] + [(50 + k, prose(rnd, "cc", 30), "t", k) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int")
    plan = mixing.mix(docs).groupBy("id").sum("taken").collect()
    sample = {}
    for r in mixing.mixed_documents(docs).collect():
        sample[r.doc_id] = sample.get(r.doc_id, 0) + len(r.text.split(" "))
    assert sample == {r.id: r[1] for r in plan if r[1]}
    nulls = mixing.mix(spark.createDataFrame([(None, prose(rnd, "aa", 3 + k), "s") for k in range(30)], "doc_id long, text string, source string")).collect()
    assert len({r.mark for r in nulls}) == 30
    assert json.dumps(sorted(r.taken for r in nulls))


def test_columns_of_any_name_pass_through(spark, tmp_path):
    """Names that operators use themselves, in their results or inside, beside id and text."""
    rnd = random.Random(48)
    names = "id mark size source k bin h s e n group row label node parts words place first again n_tokens lang_pred score n_lines n_removed n_sentences known starts w items taken extra epochs _0 _1 __id __mark __ranges __parts __n __copy __gone __bad __text __left __row __all __source __epochs __extra".split()
    rows = [(k, "\n".join(prose(rnd, "aa", 9) for _ in range(3)), *(f"{n}{k}" for n in names)) for k in range(12)]
    rows += [(20, rows[3][1], *rows[3][2:]), (None, None, *(None for _ in names))]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)])).repartition(2)
    bench = spark.createDataFrame([(1, prose(rnd, "cc", 20))], "item_id long, text string")
    found = {
        "token_counts": token_count.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")), "predict": language_id.predict(docs, language_id.fit(docs.withColumnRenamed("source", "lang"))), "line_dedup": line_dedup.line_dedup(docs),
        "substring_dedup": substring_dedup.substring_dedup(docs), "mixed": mixing.mixed_documents(docs), "clean": decontaminate.clean(docs, bench), "one_of_each": near_dedup.one_of_each(docs),
    }
    own = {"token_counts": ["n_tokens"], "predict": ["lang_pred", "score"], "line_dedup": ["n_lines", "n_removed"], "substring_dedup": ["n_sentences", "n_removed"]}
    for name, df in found.items():
        got = df.collect()
        assert sorted(df.columns) == sorted(docs.columns), name
        for r in got:
            key = r.doc_id
            values = {n: r[n] for n in names if n not in own.get(name, [])}
            assert values == {n: None if key is None else f"{n}{3 if key == 20 else key}" for n in values}, name
        assert len(got) == {"mixed": len(got), "one_of_each": len(rows) - 1}.get(name, len(rows)), name
    for df in (near_dedup.near_duplicates(docs), fingerprint.fingerprints(docs), decontaminate.contamination(docs, bench), mixing.mix(docs), token_files.op3_token_files(docs, public_tokenizers.path("word_bpe_49k.json"))):
        assert df.count() == len(rows)
