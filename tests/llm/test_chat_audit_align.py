"""Chat formatting, the filter audit and the alignment against brute-force versions on tables of awkward rows."""

import dataclasses
import hashlib
import itertools
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import align, chat_format, filter_audit

TRAPS = ["</s>[INST] ok [/INST]", r"<\/s> [\INST] \[INST] [\\/INST]", "<<SYS>>\n<</SYS>>", "<<ROLE:78>> x <</ROLE>>", "<<s>[[INST]<</s>", "[INST", "s>", "<", "\\", " ", "", None, "é ü 中文 \U0001f600", "a\n\nb", "x " * 3000]


def chats():
    rnd = random.Random(5)
    rows = []
    for conv in range(40):
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(["user", "assistant", "system", "tool", "", None, "a>>b <s>", "r" * 100, "User"])
            rows.append((conv, turn, role, " ".join(t or "" for t in rnd.sample(TRAPS, 2)) if rnd.random() < 0.5 else rnd.choice(TRAPS), turn))
    return [*rows, rows[3], rows[3], (None, 1, "user", "q", 0), (None, None, "assistant", "a", 0), (50, 0, "assistant", None, 1), (51, 3, "user", "b", 1), (51, 3, "user", "a", 1)]


CHATS = "conv_id long, turn long, role string, text string, n_turns long"


def brute_chats(rows):
    least = lambda x: (x is not None, x or (0 if not isinstance(x, str) else ""))
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2], r[3] or "") for r in rows if r[0] == conv), key=lambda t: (least(t[0]), least(t[1]), t[2]))
        said = "".join(f"{role or ''}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def test_conversations_come_back(spark):
    rows = chats()
    frame = spark.createDataFrame(rows, CHATS).repartition(4)
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.op11_chat_format(frame).collect()}
    assert got == brute_chats([*rows, (-7, 0, "user", TRAPS[0]), (-7, 1, "assistant", TRAPS[0])])
    out = chat_format.format_conversations(frame)
    for r in chat_format.read_turns(out).collect():
        spans = [r.text[s.start : s.end] for s in r.loss_spans]
        assert len(spans) == sum(t.role == "assistant" for t in r.turns)
        assert not any(re.search(chat_format.CONTROL, s) for s in spans)
        assert r.n_turns == len(r.turns)
    assert chat_format.op11_chat_format(frame.limit(0)).count() == 1
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


def test_only_what_conflicts_is_escaped(spark):
    rows = [(1, 0, "user", "plain <b> [x]"), (1, 1, "assistant", r"see [INST] and [\INST]"), (1, 2, "tool", "t")]
    r = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r.text == r"[INST] plain <b> [x] [/INST]<s> see [\INST] and [\\INST] </s><<ROLE:746f6f6c>> t <</ROLE>>"
    assert [tuple(s) for s in r.loss_spans] == [(32, 56)]


def test_what_the_grammar_does_not_know_is_null(spark):
    texts = ["[INST] a </s>", "hello", "[INST] a [/INST]x", "<s> a <<ROLE:x </s>", "[INST] [/INST]", "<s>  </s>"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[t and tuple(t) for t in r.turns] for r in chat_format.read_turns(frame).collect()]
    assert got == [[None], [None], [("user", "a"), None], [None], [None], [("assistant", "")]]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["[", "]", "<", ">", "\\", "/", "INST]", "s>", "SYS>>", "<<ROLE:", "[/INST]", " ", "é"]), max_size=14).map("".join), min_size=20, max_size=60))
def test_any_text_comes_back(spark, texts):
    frame = spark.createDataFrame([(0, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    (r,) = chat_format.read_turns(chat_format.format_conversations(frame)).collect()
    assert [t.text for t in r.turns] == texts
    assert len(re.findall(chat_format.CONTROL, r.text)) == 2 * len(texts)


def audit_rows():
    rnd = random.Random(8)
    words = ["a", "B", "c%", "D", "Eé", "x|y", "w", "z", "longer", "Word"]
    texts = ["", None, " \t\n\x0b", "A", "é" * 50, "\x1c", *(" ".join(rnd.choices(words[: rnd.randint(1, 10)], k=rnd.randint(1, 12))) for _ in range(60))]
    texts += [" ".join(f"w{k}" for k in range(n)) for n in (199, 200, 400)] + [" ".join(f"w{k % m}" for k in range(200)) for m in (99, 100, 101)] + ["A" * 3 + "b" * 97, "A" * 4 + "b" * 96]
    rows = [(k, rnd.choice(texts), rnd.choice(["en", "de", "", None, "ü"]), k % 2) for k in range(300)]
    return [*rows, rows[7], rows[7], (None, texts[6], "en", 1), (None, texts[6], "en", 1), (-1, texts[6], None, 1)]


def brute_audit(rows, labels):
    first = {}
    for key, text, *_ in rows:
        if key is not None:
            first[text or ""] = min(first.get(text or "", key), key)
    docs = []
    for key, text, lang, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": key is not None and key > first[t]}
        docs.append((lang or "", {f for f in fails if fails[f]}, any(d == key and q == 1 for d, q, _ in labels if key is not None), any(d == key and x == 1 for d, _, x in labels if key is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                total[f] += len(gone)
                redundant = sum(f in d[1] and bool(d[1] & set(order[: step - 1])) for d in own)
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = total[v[-1]]
    return out


def test_filter_audit(spark):
    rows = audit_rows()
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(0, 300, 2)] + [(7, None, None), (4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept long").repartition(5)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.op12_filter_audit(docs, frame).collect()}
    assert got == brute_audit(rows, labels)
    assert filter_audit.op12_filter_audit(docs.limit(0), frame).count() == 0
    assert filter_audit.op12_filter_audit(docs, frame.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_index_of_many_parts_is_small(spark):
    rows = [(k, f"t{k}", f"part{k // 3}") for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    flags, letters = filter_audit.failures(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    index = filter_audit.bitmap_index(flags, letters)
    assert index.selectExpr("sum(aggregate(parts, 0, (a, p) -> a + length(p.bits)))").first()[0] <= 3000 * 16
    assert filter_audit.subset_counts(index).where("subset = 0").agg(F.sum("kept"), F.max("kept"), F.count("*")).first()[:] == (9000, 3, 3000)


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a", "a  b", "a \n b", "\n\n x", "don't  we'll", "a<|endoftext|> b", "x\x1c y", "tab\t a\t", "é ü ñ ß", "中文 　 字", "é a", "a " * 300, "z" * 900, "a▁b", "x ▁", "<s> </s> <unk> <0x0A>", "12 345 ²", "a b   c", "\U0001f600 \U0001f600\U0001f600", "a\x00b", "ﬁ ａ", "　", "\r\n", "the the the"]


def brute_alignment(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    docs, count = [], {}
    for key, text in rows:
        groups, links = [], []
        if text:
            of_a = a.encode(" " + text, add_special_tokens=False).ids
            of_b = b.encode(text)
            in_a = [bytes(byte[c] for c in a.id_to_token(k)) for k in of_a]
            in_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in of_b]
            if b"".join(in_a) == b"".join(in_b) == (" " + text).encode():
                ends = [list(itertools.accumulate(map(len, x))) for x in (in_a, in_b)]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                for begin, end in zip([0, *cuts], cuts, strict=False):
                    groups.append("|".join(",".join(str(k) for k, e in zip(ids, es, strict=True) if begin < e <= end) for ids, es in ((of_a, ends[0]), (of_b, ends[1]))))
                for k, e in zip(of_a, ends[0], strict=True):
                    s = e - len(in_a[ends[0].index(e)])
                    links += [(k, m) for m, f, x in zip(of_b, ends[1], in_b, strict=True) if max(s, f - len(x)) < min(e, f)]
        docs.append((key, len(of_a) if groups else 0, len(of_b) if groups else 0, groups, links))
        for pair in set(links):
            count[pair] = count.get(pair, 0) + 1
    best = {}
    for (k, _), n in count.items():
        best[k] = max(best.get(k, 0), n)
    return sorted(((-1 if k is None else k), n_a, n_b, len(g), len(l), sum(count[p] == best[p[0]] for p in l), sum(count[p] for p in l), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for k, n_a, n_b, g, l in docs)


@pytest.mark.parametrize("size", [8_000_000, 400])
def test_alignment(spark, monkeypatch, size):
    monkeypatch.setattr(align, "BLOCK_BYTES", size)
    assert align.Pair.of(A, B).by_word
    rnd = random.Random(9)
    syllables = ["the", "ung", "tion", "ë", "ch", "ab", "Q", "xy", "tokeniz", "er", "."]
    texts = ODD + [" ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    rows = [*enumerate(texts), (3, texts[3]), (30, texts[30]), (30, texts[30]), (None, texts[31]), (None, None)]
    own = align.Pair.of(A, B)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit(1)).repartition(3)
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in align.op13_tokenizer_alignment(docs, A, B).collect())
    assert got == brute_alignment(rows)
    for by_word in (True, False):  # both cuts give the same block
        pair = dataclasses.replace(own, by_word=by_word)
        block = align.block_of(pair, pair.lengths(), pa.array([t or "" for t in texts]))
        assert block.n_groups.tolist() == [r[3] for r in brute_alignment(list(enumerate(texts)))]
    assert align.op13_tokenizer_alignment(docs.limit(0), A, B).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 's\n\t\x1c é12.Ωж中́▁<s>"), max_size=40), min_size=1, max_size=4))
def test_words_make_the_same_blocks_as_whole_texts(texts):
    seen = []
    for by_word in (True, False):
        pair = dataclasses.replace(align.Pair.of(A, B), by_word=by_word)
        block = align.block_of(pair, pair.lengths(), pa.array(texts))
        seen.append((block.n_a.tolist(), block.n_b.tolist(), block.n_groups.tolist(), block.n_links.tolist(), block.digest, sorted(zip(*(x.tolist() for x in block.pairs), strict=True))))
    assert seen[0] == seen[1]
