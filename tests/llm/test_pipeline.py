"""The corpus pipeline, stage by stage, against plain versions."""

import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from test_corpus_ops import plain_components, plain_lines
from test_text_ops import base_spans
from tokenizers import Tokenizer

from reelquery.llm import queries

SCHEMA = "doc_id long, text string, lang string, found long, h1 long, node long"  # further columns clash with internal names


def corpus():
    rng = random.Random(21)
    stops = "the of and to in is that it for with".split()
    pool = [f"word{i}" for i in range(900)]
    line = lambda n: " ".join(rng.choice(stops) if rng.random() < 0.3 else rng.choice(pool) for _ in range(n))
    texts = ["\n".join(line(rng.randint(8, 30)) for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts += texts[:5]  # exact copies: all their lines go
    for _ in range(6):  # near copies: two words more, so line dedup leaves them
        words = line(120).split()
        texts += [" ".join(words), " ".join([*words[:60], "new1", "new2", *words[60:]])]
    shared = line(40)
    texts += [line(30) + "\n" + shared + "\n" + line(30) for _ in range(8)]
    texts += [f"{line(40)} mail me at user{i}@example.org or 10.0.{i}.1 {line(10)}" for i in range(8)]
    texts += ["short", "", None, "### $$$ &&& " * 20, "same words again " * 40, line(9000)]
    rows = [(i, t, "en", 1, 2, 3) for i, t in enumerate(texts)]
    return [*rows, (None, line(50), None, None, None, None), rows[0]]


def key(rows):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["lang"] or "") for r in rows))


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, seen = corpus_pipeline.table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, folder)
        if name != "pack":
            assert out.schema.names == docs.schema.names
        path = f"{folder}/{name}.parquet"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = (before, docs.collect())

    before, after = seen["quality_rules"]
    con = duckdb.connect()
    texts = sorted({r["text"] for r in before if r["text"]})
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    kept = {texts[r[0]] for r in con.execute(f"select doc_id from ({queries.ORACLES['op8_quality']}) where kept").fetchall()}
    assert key(after) == key([r for r in before if r["text"] in kept]) and 60 < len(after) < len(before)

    before, after = seen["line_dedup"]
    named = {(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None}
    gone = plain_lines(sorted(named))
    expected = []
    for r in before:
        lines = r["text"].split("\n")
        left = [x for i, x in enumerate(lines) if (r["doc_id"], i) not in gone]
        if any(re.search(r"[^\x20\x09-\x0d]", x) for x in left):
            expected.append({"doc_id": r["doc_id"], "text": "\n".join(left), "lang": r["lang"]})
    assert key(after) == key(expected) and len(after) < len(before)

    before, after = seen["near_duplicates"]
    found = plain_components([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None], 5, 80, 100)
    stays = {i for i, (_, c) in found.items() if c == i}
    assert key(after) == key([r for r in before if r["doc_id"] in stays or r["doc_id"] is None]) and len(after) < len(before)

    before, after = seen["redact"]
    clean = {r["doc_id"]: r["text"] for r in after}
    assert sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in before)
    for r in before:
        spans = base_spans(r["text"])
        assert spans or clean[r["doc_id"]] == r["text"]
        assert all(r["text"][a:b] not in clean[r["doc_id"]] for _, a, b in spans)
    assert sum("<EMAIL>" in t and "<IP>" in t for t in clean.values()) == 8

    before, after = seen["pack"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in after:
        pieces.setdefault(r["doc_id"], []).append(r)
    for r in before:
        ids = np.array([*library.encode(clean[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        if sum(x["doc_id"] == r["doc_id"] for x in before) > 1:  # repeated rows are packed each
            assert sum(p["length"] for p in pieces[r["doc_id"]]) == 2 * len(ids)
            continue
        at = 0
        for p in sorted(pieces[r["doc_id"]], key=lambda x: x["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_run_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
