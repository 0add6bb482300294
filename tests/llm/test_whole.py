"""Passages, blocks, secrets and links that only the whole job finds: each of these tests failed on a version that did less."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import line_dedup, near_dedup, secret_scan, substring_dedup

SMALL = "abcdefghijklmnopqrstuvwxyz"


def plain_words(rnd, n, a=2, b=8):
    return ["".join(rnd.choices(SMALL, k=rnd.randint(a, b))) for _ in range(n)]


def deduplicated(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in substring_dedup.op10_substring_dedup(frame).collect()}


def test_passages_repeat_wherever_they_begin_in_a_sentence(spark):
    """51 words without stops, and with stops but begun and ended inside a sentence, after any number of own words."""
    rnd = random.Random(21)
    texts, want = [], []
    for k in range(40):
        passage = plain_words(rnd, 51, 1 if k % 4 == 3 else 2, 1 if k % 4 == 3 else 8)
        if k % 2:
            for i in range(rnd.randint(3, 9), 48, rnd.randint(9, 14)):
                passage[i] += "."
        for copy in range(2):
            texts.append(" ".join([*plain_words(rnd, rnd.randint(0, 30)), *passage, *plain_words(rnd, rnd.randint(0, 30))]))
            if copy:
                want.append(len(texts) - 1)
    got = deduplicated(spark, texts)
    assert [k for k in got if got[k].n_removed] and sorted(k for k in got if got[k].n_removed) == want
    for k in want:  # only the ends of a passage can be left
        assert len(got[k].text.split()) <= len(texts[k].split()) - 21
    assert all(got[k].text == texts[k] for k in range(0, 80, 2))


def test_any_51_shared_words_hold_a_span():
    """Stops anywhere, sentences about the bound in length, own words of any number on both sides."""
    rnd = random.Random(77)

    def stopped(words, steps):
        at = rnd.randint(0, 14)
        while at < len(words):
            words[at] += rnd.choice([".", ".\n"])
            at += rnd.randint(*steps)
        return words

    def spans(passage):
        text = " ".join([*stopped(plain_words(rnd, rnd.randint(0, 40)), (2, 25)), *passage, *stopped(plain_words(rnd, rnd.randint(0, 40)), (2, 25))])
        cut = substring_dedup.Pieces(pa.array([text]))
        return set(zip(*(x.tolist() for x in cut.digests(*cut.runs())), strict=True))

    for k in range(1500):
        n = substring_dedup.SENTENCE_WORDS
        passage = stopped(plain_words(rnd, 51), [(60, 60), (n, n), (n, n + 1), (n - 1, n + 1), (9, 14), (20, 30), (3, 20)][k % 7])
        assert spans(passage) & spans(passage)


def test_short_sentences_make_longer_spans(spark):
    """Dialogue, decimals and dotted names: over 50 words of which no three pieces have LEAST_CHARS characters."""
    rnd = random.Random(22)
    talk = " ".join(f"{a.capitalize()} {b}." for a, b in zip(plain_words(rnd, 30, 2, 4), plain_words(rnd, 30, 2, 4), strict=True))
    numbers = " ".join(f"0.{rnd.randint(10, 99)}" for _ in range(60)) + "."
    dotted = ".".join(plain_words(rnd, 70, 2, 5)) + "."
    for passage in (talk, numbers, dotted):
        got = deduplicated(spark, [" ".join([*plain_words(rnd, n), "end.", passage, *plain_words(rnd, 20)]) for n in (7, 12, 3)])
        assert passage in got[0].text
        assert all(got[k].n_removed >= 30 and passage[-30:] not in got[k].text and passage[:30] not in got[k].text for k in (1, 2))
    got = deduplicated(spark, ["He ran. She hid.", "He ran. She hid. No.", "Yes. He ran. She hid. No."])  # too short for a passage
    assert not any(r.n_removed for r in got.values())


@pytest.mark.parametrize("gap", ["\n", "\n\n", "\t", "\r\n", "\x0b "])
def test_white_space_after_a_passage_makes_no_other_piece(spark, gap):
    """Three pieces that end a paragraph here, stand inside a line there, and end the text elsewhere."""
    rnd = random.Random(23)
    passage = " ".join(" ".join(plain_words(rnd, 7)) + "." for _ in range(3))
    texts = [f"Own {a}. {passage}{z}" for a, z in (("one", f"{gap}Then more."), ("two", " And else."), ("three", ""))]
    got = deduplicated(spark, texts)
    assert got[0].text == texts[0]
    assert [got[k].text.strip() for k in (1, 2)] == ["Own two. And else.", "Own three."]


def test_copies_and_long_blocks_leave_no_lines(spark):
    rnd = random.Random(24)
    lines = lambda n: [" ".join(plain_words(rnd, 5)) for _ in range(n)]
    block, copy = lines(60), [lines(n) for n in range(2, 30)]
    texts = ["\n".join(x) for x in copy + copy] + ["\n".join([*lines(rnd.randint(2, 9)), *block, *lines(rnd.randint(2, 9))]) for _ in range(12)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in line_dedup.op7_line_dedup(frame).collect()}
    n = len(copy)
    assert all(got[k].text == texts[k] for k in range(n))
    assert all(got[k].text == "" for k in range(n, 2 * n))
    inner = set(block[15:-15])  # away from its ends, where a chunk can hold foreign lines
    assert all(not inner & set(got[k].text.split("\n")) for k in range(2 * n + 1, len(texts)))


def test_repeated_rows_keep_the_prefix_filter_exact(spark):
    rnd = random.Random(25)
    words = plain_words(rnd, 300, 5, 9)
    other = [*words[:285], *plain_words(rnd, 15, 5, 9)]
    rows = [(k, " ".join(t)) for k, t in ((1, words), (2, other)) for _ in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    signed = near_dedup.signed(docs, 5).select("row", "doc_id", "hi", "lo").distinct()
    sets = near_dedup._sets(docs, signed.selectExpr("row", "doc_id AS node", "hi", "lo"), 5, "doc_id", "text").cache()
    assert sorted(r.node for r in sets.collect()) == [1, 2]
    rest = spark.createDataFrame([(1, 1), (2, 2)], "node long, label long")
    assert [tuple(r) for r in near_dedup._rest(rest, sets, 85).collect()] == [(1, 2)]


def test_the_network_reads_whole_runs_and_runs_of_every_kind(spark):
    """Keys far behind a path, without digits, and short after a key's name."""
    rnd = random.Random(26)
    letters = SMALL + SMALL.upper()
    keys = [lambda: "host.example.com/api/v1/long/path/of/names/" + "".join(rnd.choices(letters + "0123456789", k=36)), lambda: "".join(rnd.choices(letters, k=32)), lambda: "".join(rnd.choices(letters + "0123456789", k=14))]
    words = lambda n: " ".join(plain_words(rnd, n))
    rows = [(k, f"{words(5)} key={keys[k % 3]()} {words(5)}") for k in range(90)] + [(k, words(12)) for k in range(90, 180)]
    net = secret_scan.train(secret_scan.made_up(1600, random.Random(4)))
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), net).collect()}
    for kind in range(3):
        assert sum(any(x.kind == "model" for x in got[k]) for k in range(kind, 90, 3)) >= 27
    assert not any(got[k] for k in range(90, 180))


def test_thresholds_keep_the_demanded_recall():
    """Also where secrets look like harmless runs, so that the quantile of their scores is under LEAST."""
    rows = secret_scan.made_up(500, random.Random(27))
    rows = [(v, int(y or k % 16 == 1), s) for k, (v, y, s) in enumerate(rows)]
    net = secret_scan.train(rows)
    held = sorted(set(rows), key=lambda r: hashlib.sha256(r[0].encode("utf-8", "surrogatepass")).digest())[::5]
    secrets = [r for r in held if r[1]]
    p = net.score([r[0] for r in secrets])
    assert min(net.thresholds) < secret_scan.LEAST
    assert np.mean([x >= net.thresholds[s] - 1e-9 for x, (_, _, s) in zip(p, secrets, strict=True)]) >= secret_scan.RECALL
