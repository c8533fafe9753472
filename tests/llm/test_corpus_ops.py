"""Search, joins, dedup and scoring against plain versions."""

import pathlib
import random
import re
import time

import numpy as np
import pytest
import xxhash

from reelquery.llm import chunkdedup, components, linededup, lmscore, ngramjoin, topk

DOCS = "doc_id long, text string, node long, pos long"  # further columns clash with internal names


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], DOCS).repartition(3)


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def prose(rng, n):
    return [f"w{rng.randrange(500)}" for _ in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def plain_components(rows, k, num, den):
    sets, up = {}, Sets()
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        up.find(i)
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                up.join(a, b)
    return {i: (len(sets[i]), up.find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "block"), [(4, 85, 2048), (4, 85, 16), (5, 80, 2048), (1, 60, 8)])
def test_jaccard_components(spark, k, num, block, monkeypatch):
    monkeypatch.setattr(ngramjoin, "OPEN_ROWS", 4)
    rng = random.Random(k * num + block)
    texts = []
    for size in (60, 3, 12, 40):
        original = prose(rng, size * 3)
        texts += [original] * 3 + [edited(rng, original, rng.randint(0, 4)) for _ in range(size)]
    passage = prose(rng, 60)
    texts += [prose(rng, rng.randint(1, 80)) + passage for _ in range(40)] + [prose(rng, rng.randint(0, 9)) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One"), (9004, "one\n"), (9005, "one two"), (9006, "ONE TWO")]
    rng.shuffle(rows)
    got = ngramjoin.jaccard_components(docs(spark, rows), k, num, 100, block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_components(rows, k, num, 100)


@pytest.mark.parametrize("signed_rows", [1024, 8])
def test_jaccard_shared_passage(spark, signed_rows, monkeypatch):
    """Rows that share a passage and do not link send no texts, and tables that nobody reads any more are gone."""
    monkeypatch.setattr(ngramjoin, "SIGNED_ROWS", signed_rows, raising=False)
    sent, with_text = [], ngramjoin.with_text
    monkeypatch.setattr(ngramjoin, "with_text", lambda docs, rows: sent.append(rows.count()) or with_text(docs, rows))
    rng = random.Random(5)
    passage = prose(rng, 120)
    texts = [prose(rng, 40) + passage + prose(rng, 40) for _ in range(120)]
    texts += [edited(rng, t, 2) for t in texts[:10] for _ in range(2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"), "reelquery")
    before = set(shared.glob("*"))
    got = ngramjoin.jaccard_components(docs(spark, rows), 5, 80).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert found == plain_components(rows, 5, 80, 100) and len({c for _, c in found.values()}) == 120
    assert sum(sent) <= 60
    left = {x.name.rsplit("-")[0] for x in set(shared.glob("*")) - before}
    assert not left & {"incidence", "common", "shared", "sharing"}


def test_jaccard_edge_rows(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e")]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngramjoin.jaccard_components(docs(spark, rows), 4, 85).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1)]
    kept = ngramjoin.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "node", "pos"] and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1]
    assert ngramjoin.jaccard_components(docs(spark, rows).where("false")).count() == 0


def test_connected(spark):
    chain = list(range(60))
    random.Random(1).shuffle(chain)
    edges = list(zip(chain, chain[1:], strict=False)) + [(100, 101), (101, 100), (102, 102)]
    got = components.connected(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100}


def within_one(a, b):
    p = q = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    while q < min(len(a), len(b)) and a[-1 - q] == b[-1 - q]:
        q += 1
    return abs(len(a) - len(b)) <= 1 and p + q >= max(len(a), len(b)) - 1


def plain_lines(rows):
    lines = []
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            w = [y for y in re.split(r"[\x20\x09-\x0d]+", x) if y]
            if w and d is not None:
                lines.append((d, i, x, w))
    first = {}
    for d, i, x, w in sorted(lines, key=lambda r: r[:2]):
        first.setdefault(x, (d, i, w))
    out = {}
    for d, i, x, w in lines:
        near = [
            (a, b) for y, (a, b, v) in first.items()
            if y != x and (a, b) < first[x][:2] and len(w) >= 8 and len(v) >= 8 and within_one(w, v)
        ]
        if near:
            out[d, i] = (*min(near), 1)
        elif first[x][:2] != (d, i):
            out[d, i] = (*first[x][:2], 0)
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_repeated_lines(spark, wide):
    rng = random.Random(3)
    lines = [[f"w{rng.randrange(9)}" for _ in range(rng.choice([1, 3, 7, 8, 9, 10, 70]))] for _ in range(40)]
    rows = []
    for d in range(80):
        text = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(lines))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], ["w1"]])
            text.append(rng.choice([" ", "  "]).join(w))
        rows.append((d * (10**15 if wide else 1), "\n".join(text)))
    rows += [(5000, None), (5001, "\n \n"), (5002, ""), (None, rows[0][1])]
    got = linededup.repeated_lines(docs(spark, rows)).collect()
    expected = plain_lines(rows)
    assert {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"], r["edits"]) for r in got} == expected
    left = linededup.drop_repeated_lines(docs(spark, rows))
    assert left.columns == ["doc_id", "text", "node", "pos"]
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    for d, t in rows:
        if d is None or not (t or "").strip():
            assert texts[d] == t
            continue
        kept = [x for i, x in enumerate(t.split("\n")) if (d, i) not in expected]
        assert texts.get(d) == ("\n".join(kept) if any(x.strip() for x in kept) else None)
    assert linededup.repeated_lines(docs(spark, rows).where("false")).count() == 0


def test_chunk_boundaries_depend_on_content_alone():
    rng = random.Random(4)
    body = "".join(rng.choice("abcdé fgh\n") for _ in range(4000)).encode()
    window, bits = chunkdedup.WINDOW, chunkdedup.CUT_BITS
    expected = []
    for i in range(len(body)):
        h = 0
        for b in body[max(0, i - window + 1) : i + 1]:
            h = (h * 2 + int(chunkdedup._GEARS[b])) & 0xFFFF
        if h >> (16 - bits) == 0 and (i + 1 == len(body) or body[i + 1] & 0xC0 != 0x80):
            expected.append(i + 1)
    expected += [] if expected and expected[-1] == len(body) else [len(body)]
    assert chunkdedup.boundaries(body).tolist() == expected
    moved = {c - 7 for c in chunkdedup.boundaries(b"shifted" + body).tolist()}
    assert set(expected[1:]) <= moved | {c for c in expected if c < window}
    assert chunkdedup.boundaries(b"").tolist() == []


def test_repeated_spans(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passages = [fresh(55) for _ in range(20)]
    rows = [(i, fresh(200)) for i in range(60)]
    planted = {}
    for i in range(100, 160):
        p = rng.randrange(20)
        planted.setdefault(p, []).append(i)
        rows.append((i, f"{fresh(rng.randint(5, 60))} {passages[p]} {fresh(rng.randint(5, 60))}"))
    rows += [(900, rows[0][1]), (901, None), (902, ""), (None, rows[1][1]), (903, f"{passages[0]} {fresh(9)} {passages[0]}")]
    text = dict(rows)
    got = chunkdedup.repeated_spans(docs(spark, rows)).collect()
    found = {r["doc_id"] for r in got}
    later = {i for at in planted.values() for i in at[1:]}
    assert later <= found and 900 in found and 903 in found
    assert not found & (set(range(60)) | {at[0] for at in planted.values()} | {901, 902})
    for r in got:
        span = text[r["doc_id"]][r["start"] : r["end"]]
        assert r["kept_doc_id"] <= r["doc_id"] and span[-40:] and r["words"] >= chunkdedup.MIN_WORDS
        kept, (i, j) = text[r["kept_doc_id"]], (r["start"], r["end"])
        assert span in kept and kept != text[r["doc_id"]] or r["doc_id"] in (900, 903)
        # Maximal: one character more on either side is not in the kept text.
        if r["doc_id"] != 903:
            own = text[r["doc_id"]]
            assert (i == 0 or own[i - 1 : j] not in kept) and (j == len(own) or own[i : j + 1] not in kept)
        assert abs(r["words"] - len(span.split())) <= 1
    for p, at in planted.items():
        for i in at[1:]:
            first = text[i].index(passages[p])
            assert any(r["doc_id"] == i and r["start"] <= first and first + len(passages[p]) <= r["end"] for r in got)
    whole = [r for r in got if r["doc_id"] == 900]
    assert (whole[0]["start"], whole[0]["end"]) == (0, len(text[0]))
    assert chunkdedup.repeated_spans(docs(spark, rows).where("false")).count() == 0


def plain_growth(left, own, start, end, kept, place):
    n = 0
    if left:
        while n < min(start, place) and own[start - 1 - n] == kept[place - 1 - n]:
            n += 1
    else:
        while n < min(len(own) - end, len(kept) - place) and own[end + n] == kept[place + n]:
            n += 1
    return n


def test_ends_grow_to_the_true_ends_of_a_repeat():
    rng = random.Random(15)
    alphabet = "ab cdé\n€fgh"
    for _ in range(300):
        make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
        core, a, b, c, d = make(60), make(40), make(40), make(40), make(40)
        common_left, common_right = make(rng.randrange(12)), make(rng.randrange(12))
        own, kept = a + common_left + core + common_right + b, c + common_left + core + common_right + d
        i, k = len(a) + len(common_left), len(c) + len(common_left)
        j, m = i + len(core), k + len(core)
        cut = lambda t, *at: [t[x:y].encode() for x, y in zip(at, at[1:], strict=False)]
        grown = chunkdedup._grown(True, *cut(own, 0, i, j), *cut(kept, 0, k, m))
        assert grown[0] == plain_growth(True, own, i, j, kept, k)
        grown = chunkdedup._grown(False, *cut(own, i, j, len(own)), *cut(kept, k, m, len(kept)))
        assert grown[0] == plain_growth(False, own, i, j, kept, m)
    # A place that does not hold the run's text moves nothing.
    assert chunkdedup._grown(True, b"same ", b"x" * 60, b"same ", b"y" * 60) == (0, 0)


def plain_top(vectors, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(object)) for i, v in vectors if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(ok):
        if q % 20 == 0:
            scores = []
            for other, (c, b) in enumerate(ok):
                if other != at:
                    n = min(len(a), len(b))
                    scores.append((-sum(int(x) * int(y) for x, y in zip(a[:n], b[:n], strict=True)), c))
            out += [(q, r, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [16384, 7])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 3)
    rng = random.Random(9)
    vectors = [(i, [rng.choice([0.0, 0.5, -0.5, rng.random()]) for _ in range(6)]) for i in range(130)]
    vectors += [(200 + i, [0.5] * 6) for i in range(40)] + [(20, vectors[20][1]), (40, [0.25] * 6), (40, [0.25] * 6)]
    vectors += [(300, None), (320, [None] * 6), (340, [float("nan")] * 6), (360, [float("inf")] * 6), (380, []), (400, [1.0, 2.0]), (None, [0.1] * 6)]
    rng.shuffle(vectors)
    table = spark.createDataFrame([(i, v, 1, 1) for i, v in vectors], "vec_id long, embedding array<double>, id long, v long")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table).collect())
    assert got == plain_top(vectors)
    few = table.where("vec_id in (20, 21, 22)").dropDuplicates(["vec_id"])
    assert topk.top_k(few).count() == 2
    assert topk.top_k(table.where("false")).count() == 0


def test_top_k_of_one_id_and_equal_weights(spark):
    """Rows of one id that differ by less than a weight are queries of their own."""
    vectors = [(20, [0.25, 0.5]), (20, [0.251, 0.501])] + [(i, [i / 64, 0.5]) for i in range(1, 13)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table, k=5).collect())
    assert got == plain_top(vectors, 5)


@pytest.mark.parametrize("top", [600.0, 1e6, 1e15])
def test_top_k_of_wide_and_narrow_weights(spark, top):
    """Weights on both sides of 16 bits, and beyond 2^52, in one table."""
    rng = random.Random(13)
    vectors = [(i, [rng.choice([0.0, -0.01, 0.5, rng.random()]) for _ in range(5)]) for i in range(60)]
    vectors += [(60, [512.0, 0.5, 0.0, 0.0, 0.0]), (61, [-512.0] * 5), (62, [511.999] * 5), (63, [0.0, top]), (80, [-512.01]), (81, [])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(table).collect())
    assert got == plain_top(vectors)


def test_top_k_scores_in_the_narrowest_type():
    rng = np.random.default_rng(11)
    for top, kind in [(90, np.int16), (91, np.int32), (23170, np.int32), (23171, np.int64), (2**29, np.int64), (2**30, object)]:
        q, c = (rng.integers(-top, top + 1, (n, 4)) * (rng.random((n, 4)) < 0.6) for n in (9, 40))
        q[0], c[0], c[1] = top, top, -top
        assert topk._score_type(q, c) is kind
        for i, at, scores in topk.best_of_block(q, c, 7):
            plain = [sum(int(x) * int(y) for x, y in zip(q[i], row, strict=True)) for row in c]
            assert sorted(at) == sorted(sorted(range(len(c)), key=lambda j: (-plain[j], j))[:7])  # noqa: B023
            assert [int(x) for x in scores] == [plain[j] for j in at]


def test_top_k_adds_postings_of_most_rows_in_order():
    """A few zero weights in every component do not make a block scatter: its CPU time stays about the same."""
    rng = np.random.default_rng(12)
    full = rng.integers(1, 20, (4096, 64))
    holes = full * (rng.random(full.shape) > 0.05)

    def cpu(c):
        times = []
        for _ in range(3):
            start = time.process_time()
            list(topk.best_of_block(c[:128], c, 21))
            times.append(time.process_time() - start)
        return min(times)

    assert cpu(holes) < 2.5 * cpu(full)


def test_pseudo_likelihood(spark):
    rng = random.Random(10)
    verbs, nouns = [f"v{i}" for i in range(8)], [f"n{i}" for i in range(8)]
    lawful = lambda: " ".join(w for _ in range(40) for i in [rng.randrange(8)] for w in ("the", nouns[i], verbs[i], "a"))
    rows = [(i, lawful()) for i in range(300)]
    test = [(1000 + i, lawful()) for i in range(20)]
    broken = []
    for i, t in test:
        words = t.split()
        rng.shuffle(words)
        broken.append((i + 1000, " ".join(words)))
    model = lmscore.train(docs(spark, rows), rounds=6, step_size=256)
    held_out = docs(spark, [*test, *broken, (5000, None), (5001, ""), (None, "the n1"), (5002, "The N1"), (5002, "The N1")])
    rows = lmscore.score(held_out, model).collect()
    got = {r["doc_id"]: r for r in rows}
    mean = lambda part: np.mean([got[i]["per_word"] for i, _ in part])
    assert mean(test) > mean(broken) + 0.3
    assert got[5000]["n_words"] == 0 and got[5001]["log_likelihood"] == 0 and got[5001]["per_word"] is None
    assert got[None]["n_words"] == 2 and abs(got[5002]["log_likelihood"] - got[None]["log_likelihood"]) < 1e-4
    assert len(rows) == 45
    long_ = " ".join(["the n1 v1 a"] * 150_000)  # longer than a part
    found = lmscore.score(docs(spark, [(1, long_)]), model).first()
    assert found["n_words"] == 600_000 and -3 < found["per_word"] < 0
    empty = lmscore.pseudo_likelihood(held_out.where("false"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "log_likelihood", "per_word"]


def plain_probability(p, b, near, centre):
    """The network written out for one word."""
    h = np.tanh(p["hidden"].astype(float) + sum(p["embed"][k][x].astype(float) for k, x in enumerate(near)))
    h = np.append(h, 1.0)
    out = 1.0
    for w, i in ((p["branch"], centre // (b * b)), (p["twig"][centre // (b * b)], centre // b % b), (p["leaf"][centre // b], centre % b)):
        z = np.exp(h @ w.astype(float))
        out *= z[i] / z.sum()
    return out


def test_network_against_plain_version():
    b, rng = 3, np.random.default_rng(5)
    flat = rng.normal(0, 0.5, sum(int(np.prod(x)) for x in lmscore.shapes(b).values())).astype(np.float32)
    ids, bounds = rng.integers(0, 27, 40), np.array([0, 1, 1, 15, 40])
    near = lmscore.windows(ids, bounds, 27)
    for i in range(40):  # neighbours: of the same text, or 27
        a, e = next((a, e) for a, e in zip(bounds, bounds[1:], strict=False) if a <= i < e)
        assert near[:, i].tolist() == [ids[j] if a <= j < e else 27 for j in (i - 2, i - 1, i + 1, i + 2)]
    p = lmscore.split(flat, b)
    plain = np.log([plain_probability(p, b, near[:, i], ids[i]) for i in range(40)])
    assert np.allclose(lmscore.log_probabilities(flat, b, near, ids), plain, atol=1e-5)
    total = sum(np.exp(lmscore.log_probabilities(flat, b, near[:, :1], np.array([c]))[0]) for c in range(27))
    assert abs(total - 1) < 1e-5
    # The step is along the gradient of the mean log-probability, taken by differences.
    after = flat.copy()
    lmscore.step(after, b, near, ids, 1.0)

    def mean(x):
        q = lmscore.split(x, b)
        return np.mean(np.log([plain_probability(q, b, near[:, i], ids[i]) for i in range(40)]))

    place = lmscore.split(np.arange(len(flat)), b)
    rates = [(set(x.ravel().tolist()), lmscore.FASTER.get(name, 1.0)) for name, x in place.items()]
    for at in rng.choice(len(flat), 60, replace=False):
        up, down = flat.astype(float), flat.astype(float)
        up[at] += 1e-4
        down[at] -= 1e-4
        rate = next(r for n, r in rates if at in n)
        assert abs((mean(up) - mean(down)) / 2e-4 - (after[at] - flat[at]) / rate) < 2e-4


def test_rare_words_do_not_score_as_frequent_ones(spark, monkeypatch):
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice(["the", "a", "of", f"w{int(3000 * rng.random() ** 2)}"]) for _ in range(60))
    rows = [(i, line()) for i in range(400)] + [(1000, "a the of the a"), (1001, "a the of zebra a"), (1002, "a the of w1 a")]
    whole = lmscore.train(docs(spark, rows))
    full = {r["doc_id"]: r["log_likelihood"] for r in lmscore.score(docs(spark, rows), whole).collect()}
    assert full[1000] > full[1001] + 2
    # Every distinct word counts, and the words of a place have probabilities that sum to one.
    plain = {}
    for _, t in rows:
        for w in t.split():
            plain[w] = plain.get(w, 0) + 1
    h = np.concatenate([lmscore.hashes_of(w) for w in plain])
    n = np.array(list(plain.values()))
    counts = {r["h"]: r["n"] for r in lmscore.count_words(docs(spark, rows)).collect()}
    assert counts == dict(zip(h.view(np.int64).tolist(), n.tolist(), strict=True))
    known = whole.vocabulary
    ids, total = known.ids(h), np.zeros(known.branches**3)
    np.add.at(total, ids, n)
    assert total.tolist() == known.totals.tolist()
    assert len(set(ids[ids < known.first_unknown].tolist())) == int((ids < known.first_unknown).sum())
    assert {n[i] for i in np.flatnonzero(ids >= known.first_unknown)} >= {1}
    shares, unsure = known.shares(h, ids)
    assert all(n[i] < known.below for i in unsure)
    assert np.allclose(np.bincount(ids, np.exp(shares), len(total))[total > 0], 1)
    # The same scores where most counts are joined instead of known.
    monkeypatch.setattr(lmscore, "KNOWN_WORDS", 1400)
    few = lmscore.train(docs(spark, rows))
    assert 0 < len(few.vocabulary.known) < len(known.known) and few.counts.count() > 0
    assert np.array_equal(few.flat, whole.flat)
    joined = {r["doc_id"]: r["log_likelihood"] for r in lmscore.score(docs(spark, rows), few).collect()}
    assert all(abs(joined[i] - full[i]) < 1e-6 for i in full)


def test_model_and_training_grow_with_the_corpus(spark, monkeypatch):
    assert lmscore.branches_for(10**8) ** 3 >= 10**4 > lmscore.BRANCHES**3 == lmscore.branches_for(1000) ** 3
    assert lmscore.turns_for(10**4) > 2 * lmscore.turns_for(10**3) > lmscore.turns_for(1) == 1
    monkeypatch.setattr(lmscore, "SHARE_WORDS", 64)
    ran = []
    moves = lmscore._moves
    monkeypatch.setattr(lmscore, "_moves", lambda part, *rest: ran.append(part.count()) or moves(part, *rest))
    rows = [(i, f"a b c w{i % 7}") for i in range(400)]
    model = lmscore.train(docs(spark, rows), rounds=1)
    assert len(ran) == lmscore.turns_for(25) > 1 and sum(ran) >= 20
    # The same parameters to the last bit, however the rows are split.
    again = lmscore.train(docs(spark, rows[::-1]).repartition(7), rounds=1)
    assert np.array_equal(model.flat, again.flat)
