"""Tokenising, formatting, packing, quality rules and personal data against plain versions."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reelquery.llm import batchids, bpe, chat, packing, pii, quality, words
from reelquery.llm.template import FILTERS, Const, Output, TemplateError, compile_template, fold, parse, with_spans

DOCS = "doc_id long, text string, n_words long, ids binary, h long"  # further columns clash with internal names


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, 7, b"x", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(seed, n=300):
    rng = random.Random(seed)
    pool = [chr(c) for c in [*range(32, 127), *range(0xC0, 0x17F), *range(0x300, 0x320), *range(0x391, 0x3C9)]]
    pool += [*"\t\n\r\x0b\x0c\x01\x1c\x85\xa0 　İß😀가①²", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", " "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*texts, "", "a", "word " * 3000, "x" * 5000, None]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_bpe_equals_the_library(spark, library):
    texts = awkward(1)
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(docs(spark, texts)).collect()}
    encoded = {r["doc_id"]: bytes(r["ids"]) for r in bpe.encode_documents(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        text = library.decode(ids, skip_special_tokens=False)
        assert encoded[i] == raw
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(docs(spark, ["The cat", None]))).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == [(0, "the</w> cat</w>"), (1, "")]
    assert bpe.round_trip_digests(docs(spark, [])).count() == 0
    assert bpe.round_trip_digests(docs(spark, ["a", "a"], [None, None])).count() == 2


@pytest.mark.parametrize("seed", [2, 3])
def test_packing(spark, library, seed):
    rng = random.Random(seed)
    texts = awkward(seed, 60) + ["word " * rng.randint(0, 6000) for _ in range(40)]
    rows = packing.pack_documents(docs(spark, texts).repartition(3)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["length"] > 0
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0  # no padding
        assert len({(p["tier"], p["step_group"]) for p in s}) == 1
    assert packing.pack_documents(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="powers of two"):
        packing.pack_documents(docs(spark, []), tiers=(100,))


def test_template_language():
    folded = fold(parse("x{% if 1 == 1 %}a{{ 'b' ~ 2 }}{% else %}{{ y }}{% endif %}c", FILTERS), FILTERS)
    assert folded.nodes == (Output(Const("xab2c")),)
    source = (
        "{% for m in ms -%}  {{ loop.index }}{{ m.a|upper }}{% if not loop.last %}, {% endif %}"
        "{% generation %}{{ m['b'] if m.b else 'none' }}{% endgeneration %}{% endfor %}{# gone #}"
    )
    text, spans = with_spans(compile_template(source)(ms=iter([{"a": "x", "b": ""}, {"a": "y", "b": "qq"}])))
    assert text == "1X, none2Yqq" and spans == [(4, 8), (10, 12)]
    set_ = "{% set n = 2 + 3 * 2 %}{{ n % 5 }}{% if 'a' in 'cat' and not n < 8 %}!{% elif n == 8 %}8{% else %}?{% endif %}"
    assert with_spans(compile_template(set_)())[0] == "3!"
    for bad in ("{{ ''.__class__ }}", "{{ x.__dict__ }}", "{% for x in y %}", "{{ 1 | nosuch }}", "{{ 1 + }}", "{% import os %}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    with pytest.raises(TemplateError):
        with_spans(compile_template("{{ x.upper }}")(x=object()))


def test_chat(spark, monkeypatch):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "[/SYS]\\", "", None, "é😀\n[NAME]", "<s></s>"]
    rng = random.Random(4)
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "a\n[INST]", None]), rng.choice(odd), "extra")
        for c in range(40) for t in range(rng.randint(1, 9))
    ]
    rows += [(50, 1, "user", "b", "x"), (50, 1, "user", "a", "x"), (50, None, "assistant", "z", "x"), (None, 0, "user", "n", "x")]
    rows += [(51, 0, "user", "same", "x")] * 2 + [(52, t, "assistant", "long " * 50, "x") for t in range(100)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    for size in (chat.PART_CHARS, 1000):  # the second cuts a conversation into parts
        monkeypatch.setattr(chat, "PART_CHARS", size)
        formatted = chat.format_conversations(table)
        got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
        by = defaultdict(list)
        for c, t, role, text, _ in rows:
            by[c].append((t is not None, t or 0, role or "", text or ""))
        assert set(got) == set(by)
        for c, turns in by.items():
            turns.sort()
            said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
            loss = "".join(t for *_, r, t in turns if r == "assistant")
            assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
            assert got[c]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
            assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        parts = formatted.where("conv_id = 52").count()
        assert parts == 1 if size > 1000 else parts > 1
    assert chat.read_back(chat.format_conversations(table.where("false"))).count() == 0


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_quality(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "and", "haus", "été", "😀x", "a|b", "##"]
    texts = [" ".join(rng.choice(vocabulary[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    texts += ["one line\none line\n\n one line", " \t\n", "", None, "the cat sat on the mat by the old red door " * 30, "a　b"]
    texts += [" ".join(f"w{i}" for i in range(3000))]
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        expected = plain_quality(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected
        failed = expected[0] < 20 or 100 * expected[4] > 30 * expected[0]
        assert r["base_failed"] == failed and not (r["kept"] and failed)
    kept = quality.keep_good(docs(spark, texts))
    assert kept.columns == ["doc_id", "text", "n_words", "ids", "h"]
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}
    assert quality.quality(docs(spark, [])).count() == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m.group())]
    return [(RULES[k][0], a, b) for a, k, b in sorted(found)]


def test_personal_data(spark):
    rng = random.Random(7)
    pool = ["4111 1111 1111 1111", "a@b.c", "_d@e.f", "1.2.3.4", ".5", "256.1", "+1 (743) 555-3824", "+", "12", "-", "é😀", " ", "word", "@", "token = \"abcdef0123456789abcdef\""]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += ["x" * 3000 + "@a.b", "1" * 9000, "1.2.3.4.5.6.7.8", "001.02.3.4", "", None, "Mr. John Smith 123-45-6789", "plain prose only"]
    got = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(got[i]["spans"].split(","))
    assert got[len(texts) - 1]["spans"] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, texts)).collect()}
    assert clean[len(texts) - 1] == "plain prose only" and clean[len(texts) - 3] is None
    for i, t in enumerate(texts):
        spans = [t[a:b] for _, a, b in base_spans(t)]
        for span in spans:  # one that stands in no longer run of its characters
            assert len(span) < 7 or t.count(span) != spans.count(span) or span not in clean[i]
    assert pii.find_personal_data(docs(spark, [])).count() == 0


def test_spans_beyond_the_base_rules(spark):
    rng = random.Random(12)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    digits = lambda n: rng.choice("2345678") + number(n - 1)
    personal = [
        lambda: ("name", f"Dr. {rng.choice(['Maria', 'Peter', 'Laura'])} {rng.choice(['Okafor', 'Lindqvist', 'Moreau'])}"),
        lambda: ("ssn", f"{rng.randint(100, 650)}-{rng.randint(10, 99)}-{digits(4)}"),
        lambda: ("local_phone", f"({digits(3)}) {digits(3)}-{digits(4)}"),
        lambda: ("secret", f"token: ghp_{number(8)}abcDEF{number(8)}"),
    ]
    texts, truth = [], []
    for i in range(400):
        kind, value = personal[i % 4]()
        lead = {"name": "I met ", "ssn": "social ", "local_phone": "call ", "secret": "the "}[kind]
        texts.append(f"{lead}{value} today, é and mail a{i}@example.com")
        truth.append(f"{kind}:{len(lead)}:{len(lead) + len(value)}")
    plain = [f"a plain line of prose about year {1000 + i} and chapter {i}" for i in range(100)]
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find_personal_data(docs(spark, texts + plain)).collect()}
    found = sum(t in got[i] for i, t in enumerate(truth))
    assert found >= 0.9 * len(truth)
    assert all(got[len(texts) + i] == [""] for i in range(100))
    # Many matches in one text: the same places as a plain scan.
    long_ = " ".join(f"x{i}@y{i}.com, {i}.1.2.3;" for i in range(700))
    r = pii.find_personal_data(docs(spark, [long_])).first()
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(long_)).encode()).hexdigest()
    odd = spark.createDataFrame([(1, "a@b.cd", 2, 3), (1, "a@b.cd", 2, 3), (None, None, 1, 1)], "doc_id long, text string, found long, `a.b` long")
    clean = pii.redact(odd)
    assert clean.columns == odd.columns
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in clean.collect()) and clean.where("text = '<EMAIL>'").count() == 2


def test_em_recovers_planted_reliabilities():
    rng = random.Random(8)
    counts = defaultdict(int)
    truth = defaultdict(lambda: [0, 0])
    for _ in range(4000):
        y = rng.random() < 0.4
        votes = 0
        for right in (0.95, 0.9, 0.8, 0.7, 0.5, 0.5):
            vote = 0 if rng.random() < 0.2 else (1 if (rng.random() < right) == y else 2)
            votes = votes * 3 + vote
        counts[votes] += 1
        truth[votes][y] += 1
    belief = pii.estimate([(v, False, n) for v, n in counts.items()])
    right = sum(truth[v][belief[v, False] >= 0.5] for v in counts)
    assert right / 4000 > 0.93


def test_batch_ids_with_a_small_table_equal_the_library(library, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [t or "" for t in awkward(6, 2000)] + ["a b c", "a d e f g h i j k l m n o a", "", "x y", "A a Á á"]
    for entries, part in ((8, 1 << 22), (400_000, 64)):
        monkeypatch.setattr(batchids, "PART_BYTES", part)
        column = pa.array(["before".encode(), *(t.encode() for t in texts)], pa.binary())[1:]
        encoder = batchids.BatchIds(path, entries)
        got = [x.tolist() for x in encoder.texts(column)]
        assert len(encoder._table) <= entries
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_chunks_of_equal_hash_keep_their_own_ids(library, monkeypatch):
    monkeypatch.setattr(words.Words, "hashes", lambda self, fold: np.zeros(len(self.starts), np.uint64))
    encoder = batchids.BatchIds(public_tokenizers.path("word_bpe_49k.json"))
    (got,) = encoder.texts(pa.array([b"the cat sat the end"], pa.binary()))
    assert got.tolist() == library.encode("the cat sat the end", add_special_tokens=False).ids


def test_word_hashes():
    rng = random.Random(8)
    texts = ["".join(rng.choice("aAbB \t\n\x0bé") for _ in range(rng.randint(0, 9))).encode() for _ in range(500)]
    column = pa.array([*texts, b""], pa.binary())
    seen: dict[int, bytes] = {}
    for fold in (False, True):
        found = []
        for first, end, raw, offsets in words.parts(column, 100):
            w = words.words_of(raw, offsets)
            h, at = w.hashes(fold), w.bounds()
            found += [h[at[i] : at[i + 1]].tolist() for i in range(end - first)]
        assert len(found) == len(texts) + 1
        for t, hashes in zip(texts, found, strict=False):
            plain = (t.lower() if fold else t).split()
            assert len(plain) == len(hashes)
            for word, h in zip(plain, hashes, strict=True):
                assert seen.setdefault(h, word) == word
    assert len(set(seen.values())) == len(seen)


def test_tiers_and_step_groups():
    rng = random.Random(9)
    packer = packing.Packer(3, step_tokens=8192)
    lengths = [rng.choice([3, 40, 200, 300, 700, 1500, 5000]) for _ in range(900)]
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4"))
    packer.flush(last=True)
    rows = packer.drain().to_pylist()
    assert sum(r["length"] for r in rows) == sum(lengths)
    sizes, tiers, groups = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        sizes[r["sequence_id"]] += r["length"]
        tiers[r["sequence_id"]] = r["tier"]
        groups[r["tier"], r["step_group"]] += r["length"]
    assert set(tiers.values()) <= set(packing.TIERS) and len({g for _, g in groups}) == len(groups)
    short = [s for s, n in sizes.items() if n != tiers[s]]  # the end of the task
    assert all(sizes[s] & (sizes[s] - 1) == 0 and tiers[s] == 256 for s in short) and len(short) <= 8
    for tier in packing.TIERS:
        tokens = [n for (t, _), n in groups.items() if t == tier]
        if len(tokens) > 1:
            assert max(tokens) <= 8192 and min(tokens) >= 4096 - tier
    # a long sequence's gap is filled from shorter tiers
    longest = [r for r in rows if r["tier"] == 2048 and r["length"] < 2048]
    assert longest and min(r["length"] for r in longest) <= 256

def test_a_long_clean_document_stays(spark):
    text = " ".join("the" if i % 5 == 0 else f"word{i}" for i in range(1_000_010))
    assert quality.keep_good(docs(spark, [text, "short"])).count() == 1
