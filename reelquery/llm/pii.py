"""Personal data by weak supervision, in DataFrame operations alone.

Patterns propose spans.  Labelers vote on every span: strict forms, lists of
known values (gazetteers), words around the span, boundaries, triviality.
Expectation-maximisation over the counts of vote patterns estimates how far
each labeler can be trusted and how likely each pattern is personal data; the
spans of the base rules are anchors, known to be so.  With those likelihoods
as soft labels, a logistic classifier over a span's own features is trained
and decides on the spans beyond the base rules.

Both trainings see all spans of all documents, as counts per pattern: their
tables have a fixed number of cells, whatever the corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BASE = ("email", "ip", "card", "phone")
EXTRA = ("account", "local_phone", "ssn", "secret", "name")
KINDS = BASE + EXTRA

# Quantifiers are possessive where what follows cannot match otherwise, so long runs take linear time without recursion.
# An email may start where the last one ended (\G) or where a run of its characters starts: anywhere else it would fail alike.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\x20{0,3}[:=]\x20{0,3}\"?[A-Za-z0-9_/+-]{16,}+",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sra)\.?\x20\p{Lu}\p{L}++(?:\x20\p{Lu}\p{L}++)?",
}
#: A text without a match of this has no match of the pattern: a cheaper question.
_HINTS = {
    "email": "@", "ip": ".", "phone": "+",
}
_DIGIT = r"[0-9]"

# Gazetteers and context words.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us", "ch", "at", "it", "nl")
POSITIVE = r"(?i)(mail|contact|call|tel|phone|fon|mobil|fax|card|carte|tarjeta|karte|visa|account|konto|iban|server|host|ip|token|password|secret|key|ssn|social)\W*$"
NEGATIVE = r"(?i)(version|isbn|issn|doi|fig\.?|figure|table|page|chapter|section|no\.|nr\.|\$|€|v)\s*$"
_SPAN = "array<struct<start:int,end:int,s:string,before:string,after:string>>"
#: Code points before a span that are looked at, and matches that are placed together.
_BEFORE, _TOGETHER = 30, 256
#: Frequent given names, in lower case.
GIVEN_NAMES = (
    "james john robert michael william david richard thomas charles daniel mary patricia jennifer linda elizabeth barbara "
    "susan jessica sarah karen anna emma laura peter paul martin hans klaus wolfgang stefan andreas christian sabine ursula "
    "monika petra claudia julia jean pierre michel philippe alain nicolas marie nathalie isabelle catherine sophie camille "
    "antonio jose juan manuel francisco carlos javier miguel maria carmen ana isabel dolores pilar lucia elena"
).split()
#: How well-known kinds of credentials begin.
CREDENTIALS = r"[:=]\x20*\"?(sk[-_]|pk[-_]|gh[pousr]_|glpat-|xox[abp]-|AKIA|AIza|eyJ)"


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: positions in code points, what stands before, and the character after.

    A match starts where the pieces between matches and the matches before
    it end; both come from the same scan rule.  What stands before reaches
    back to the match before the last one at most.  Matches are placed in
    groups of _TOGETHER, so a text with many of them takes linear time, but for
    one small value per group.
    """
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")
    )

    def place(p: Column) -> Column:
        m, g, n = p["m"], p["g"], F.size(p["m"])

        def step(a: Column, i: Column) -> Column:
            gap, s = F.get(g, i), F.get(m, i)
            start = a["at"] + F.length(gap)
            end = start + F.length(s)
            before = F.right(F.concat(F.when(i > 0, F.get(m, i - 1)).otherwise(""), gap), F.lit(_BEFORE))
            after = F.left(F.concat(F.get(g, i + 1), F.coalesce(F.get(m, i + 1), F.lit(""))), F.lit(1))
            span = F.struct(
                start.alias("start"), end.alias("end"), s.alias("s"), before.alias("before"), after.alias("after")
            )
            return F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out"))

        groups = F.sequence(F.lit(0), F.floor((n - 1) / _TOGETHER).cast("int"))
        long_ = lambda k: F.aggregate(
            F.sequence(k * _TOGETHER, F.least(n, (k + 1) * _TOGETHER) - 1),
            F.lit(0),
            lambda a, i: a + F.length(F.get(g, i)) + F.length(F.get(m, i)),
        )
        starts = F.aggregate(groups, F.array(F.lit(0)), lambda a, k: F.array_append(a, F.get(a, k) + long_(k)))

        def placed(at: Column) -> Column:
            def group(k: Column) -> Column:
                zero = F.struct(F.get(at, k).alias("at"), F.array().cast(_SPAN).alias("out"))
                return F.aggregate(F.sequence(k * _TOGETHER, F.least(n, (k + 1) * _TOGETHER) - 1), zero, step, lambda a: a["out"])

            return F.flatten(F.transform(groups, group))

        # One group needs no starts.
        few = F.aggregate(
            F.sequence(F.lit(0), n - 1), F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")), step, lambda a: a["out"]
        )
        return F.when(n > _TOGETHER, let(starts, placed)).when(n > 0, few)

    return F.coalesce(let(parts, place), F.array().cast(_SPAN))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        x = (F.ascii(F.substring(d, -1 - i, F.lit(1))) - 48) * (1 + i % 2)
        return total + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """The base rule of a kind, beyond its pattern."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return let(_digits(s), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    return F.lit(True)


def _form(kind: str, s: Column) -> Column:
    yes = {
        "account": s.rlike(r"^([0-9]{14,17}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4})$"),
        "local_phone": s.rlike(r"[2-9][0-9]{2}[\x20.-][0-9]{4}$"),
        "ssn": ~s.rlike(r"^(000|666|9)"),
        "secret": s.rlike("[0-9]") & s.rlike("[A-Za-z]") & (F.length(s) >= 24),
        "name": s.rlike(r"\x20\S+\x20"),
    }.get(kind, F.lit(True))
    return F.when(yes, 1).otherwise(0 if kind == "name" else 2)


def _listed(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(F.substring_index(s, ".", -1)).isin(*TOP_DOMAINS), 1).otherwise(0)
    if kind in ("card", "account"):
        return F.when(s.rlike("^[2-6]"), 1).otherwise(0)
    if kind == "phone":
        return F.when(s.rlike(r"^\+(1|33|34|41|43|44|49)(?![0-9])"), 1).otherwise(0)
    if kind == "ip":
        return F.when(s.rlike(r"^(0|22[4-9]|2[3-5][0-9])\."), 0).otherwise(1)
    if kind == "local_phone":
        return F.when(s.rlike(r"^\(?[2-9]"), 1).otherwise(2)
    if kind == "secret":
        return F.when(s.rlike(CREDENTIALS), 1).otherwise(0)
    if kind == "name":
        return F.when(F.exists(F.split(F.lower(s), " "), lambda w: w.isin(*GIVEN_NAMES)), 1).otherwise(0)
    return F.lit(0)


#: Votes: 0 abstains, 1 for personal data, 2 against.
LABELERS = ("form", "listed", "context", "against", "boundary", "trivial")
#: Sizes of the features of a span, their product bounds the classifier's table.
FEATURES = {"kind": len(KINDS), "length": 4, "digits": 3, "before": 3, "gaps": 2}


def _judged(kind: str, found: Column) -> Column:
    """Candidates with votes and features, each packed into one integer."""

    def one(x: Column) -> Column:
        s, start, end, before, after = (x[c] for c in ("s", "start", "end", "before", "after"))
        last = F.right(before, F.lit(1))
        boundary = F.when(last.rlike(r"[\p{L}\p{N}]") | after.rlike(r"[\p{L}\p{N}]"), 2).otherwise(0)
        digits = _digits(s)
        trivial = F.when(digits.rlike(r"^(\d)\1{7,}$") | digits.rlike("^(0?123456789|987654321)"), 2).otherwise(0)
        votes = [
            _form(kind, s), _listed(kind, s), F.when(before.rlike(POSITIVE), 1).otherwise(0),
            F.when(before.rlike(NEGATIVE), 2).otherwise(0), boundary, trivial,
        ]
        n = F.length(s)
        share = F.length(digits) / n
        features = {
            "kind": F.lit(KINDS.index(kind)),
            "length": F.when(n < 12, 0).when(n < 18, 1).when(n < 30, 2).otherwise(3),
            "digits": F.when(share < 0.4, 0).when(share < 0.95, 1).otherwise(2),
            "before": F.when(last.isin("", " ", "\n", "\t"), 0).when(last.rlike(r"[\p{L}\p{N}]"), 1).otherwise(2),
            "gaps": F.when(s.rlike(r"[\x20().-]"), 1).otherwise(0),
        }
        packed = F.lit(0)
        for vote in votes:
            packed = packed * 3 + vote
        code = F.lit(0)
        for name, size in FEATURES.items():
            code = code * size + features[name]
        return F.struct(
            start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"),
            packed.cast("int").alias("votes"), code.cast("int").alias("features"),
        )

    return F.transform(found, one)


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, votes, features>>, by start and kind: base spans and proposals."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(_SPAN)

    def found(kind: str) -> Column:
        hint = F.contains(text, F.lit(_HINTS[kind])) if kind in _HINTS else text.rlike(_DIGIT)
        if kind == "secret":
            hint = text.rlike(r"(?i)token|secret|passw|api[_-]?key")
        if kind == "name":
            hint = F.lit(True)
        return F.when(hint, spans(text, PATTERNS[kind])).otherwise(none)

    base = F.struct(*[found(k).alias(k) for k in BASE])
    more = F.struct(*[found(k).alias(k) for k in EXTRA if k != "account"])

    def judged(p: Column) -> Column:
        b, e = p["b"], p["e"]
        good = lambda k: F.filter(b[k], lambda x: valid(k, x["s"]))
        kept = F.concat(*[_judged(k, good(k)) for k in BASE])
        account = F.filter(b["card"], lambda x: F.length(_digits(x["s"])).between(13, 19) & ~valid("card", x["s"]))
        proposed = F.concat(
            _judged("account", account), *[_judged(k, e[k]) for k in EXTRA if k != "account"]
        )

        def merged(q: Column) -> Column:
            apart = lambda x, ys: ~F.exists(ys, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
            free = F.filter(q["p"], lambda x: apart(x, q["k"]))
            # Among proposals that overlap, the earliest listed kind stays.
            first = lambda fs: F.filter(
                fs,
                lambda x: ~F.exists(
                    fs, lambda y: (y["kind"] < x["kind"]) & (y["start"] < x["end"]) & (x["start"] < y["end"])
                ),
            )
            return F.array_sort(F.concat(q["k"], let(free, first)))

        return let(F.struct(kept.alias("k"), proposed.alias("p")), merged)

    return let(F.struct(base.alias("b"), more.alias("e")), judged)


# Training --------------------------------------------------------------------


def unpack(code: int, sizes: list[int]) -> list[int]:
    out = []
    for size in reversed(sizes):
        out.append(code % size)
        code //= size
    return out[::-1]


def estimate(patterns: list[tuple[int, bool, int]], rounds: int = 40) -> dict[tuple[int, bool], float]:
    """(votes, base) -> likelihood of personal data, by expectation-maximisation.

    `patterns`: (votes, base, count).  Labelers vote independently given the
    truth; base spans are anchors.  Smoothing leans towards labelers that are
    right, which keeps the two classes from changing places.
    """
    votes = {v: unpack(v, [3] * len(LABELERS)) for v, _, _ in patterns}
    belief = {}
    for v, base, _ in patterns:
        yes, no = votes[v].count(1), votes[v].count(2)
        belief[v, base] = 1.0 if base else (yes + 1) / (yes + no + 2)
    for _ in range(rounds):
        mass = [1.0, 1.0]
        table = [[[1.0, 1.0, 3.0], [1.0, 3.0, 1.0]] for _ in LABELERS]  # [labeler][truth][vote]
        for v, base, n in patterns:
            for truth, p in ((1, belief[v, base]), (0, 1 - belief[v, base])):
                mass[truth] += n * p
                for j, vote in enumerate(votes[v]):
                    table[j][truth][vote] += n * p
        logs = [[[math.log(x / sum(row)) for x in row] for row in t] for t in table]
        for v, base, _ in patterns:
            if not base:
                score = [math.log(mass[t]) + sum(logs[j][t][x] for j, x in enumerate(votes[v])) for t in (0, 1)]
                belief[v, base] = 1 / (1 + math.exp(max(-700.0, min(700.0, score[0] - score[1]))))
    return belief


def train(rows: list[tuple[int, float, int]], rounds: int = 300, rate: float = 0.5) -> list[float]:
    """(features, sum of likelihoods, count) -> probability per feature code, by logistic regression."""
    import numpy as np

    sizes = list(FEATURES.values())
    cells = math.prod(sizes)

    def encode(codes: list[int]) -> np.ndarray:
        x = np.zeros((len(codes), sum(sizes) + 1))
        for i, code in enumerate(codes):
            at = 0
            for value, size in zip(unpack(code, sizes), sizes, strict=True):
                x[i, at + value] = 1
                at += size
            x[i, -1] = 1
        return x

    w = np.zeros(sum(sizes) + 1)
    if rows:
        x = encode([r[0] for r in rows])
        n = np.array([r[2] for r in rows], float)
        y = np.array([r[1] for r in rows], float) / n
        n /= n.sum()
        # Every feature code counts somewhat, or rare kinds would follow the frequent ones.
        n = 0.5 * n + 0.5 / len(n)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-x @ w))
            w += rate * (x.T @ (n * (y - p)) - 1e-4 * w) * 4
    return (1 / (1 + np.exp(-encode(list(range(cells))) @ w))).tolist()


def is_base(kind: Column) -> Column:
    return kind < len(BASE)


def fit(found: DataFrame) -> list[float]:
    """Train on a table with a column `found` of candidates: probability per feature code."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")
    cells = each.groupBy("votes", is_base(F.col("kind")).alias("base"), "features").agg(F.count("*").alias("n")).collect()
    patterns: dict[tuple[int, bool], int] = {}
    for r in cells:  # at most 3 ** labelers x 2 x feature codes
        patterns[r["votes"], r["base"]] = patterns.get((r["votes"], r["base"]), 0) + r["n"]
    belief = estimate([(v, b, n) for (v, b), n in sorted(patterns.items())])
    rows: dict[int, tuple[float, int]] = {}
    for r in sorted(cells, key=lambda r: (r["features"], r["votes"], r["base"])):
        p, n = rows.get(r["features"], (0.0, 0))
        rows[r["features"]] = (p + r["n"] * belief[r["votes"], r["base"]], n + r["n"])
    return train([(f, p, n) for f, (p, n) in sorted(rows.items())])


def kept_spans(found: Column, model: list[float]) -> Column:
    """Base spans, and proposals that the classifier takes."""
    yes = F.array(*[F.lit(p >= 0.5) for p in model])
    return F.filter(found, lambda x: is_base(x["kind"]) | F.get(yes, x["features"]))


def _joined(spans_: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans_,
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per input row.

    Positions are code points, end exclusive, over the whole text; null text
    is empty and has no spans.  Null doc_id stays null, repeated rows repeat,
    extra columns are not read, an empty table gives no rows.
    """
    found = materialise(docs.select("doc_id", candidates(F.col("text")).alias("found")), "found")
    model = fit(found)
    base = F.filter("found", lambda x: is_base(x["kind"]))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == KINDS.index(k))).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(kept_spans(F.col("found"), model)).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each span of personal data in `text` replaced by its kind, as in <EMAIL>; other columns unchanged.

    Null text stays null; a text without spans is unchanged, as are very long
    ones beyond their spans.  Repeated rows repeat, a null doc_id does not
    matter, columns of any name are kept, an empty table gives no rows.
    Candidates are computed once and written beside the rows.
    """
    if not docs.columns:
        return docs
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = materialise(docs.select(F.struct(*columns).alias("row"), candidates(F.col("text")).alias("found")), "found")
    model = fit(whole)
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("row")["text"]

    def rewrite(found: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            gap = F.substring(text, a["at"] + 1, x["start"] - a["at"])
            return (
                F.when(
                    x["start"] >= a["at"],
                    F.struct(x["end"].alias("at"), F.concat(a["out"], gap, F.get(names, x["kind"])).alias("out")),
                )
                .when(x["end"] > a["at"], F.struct(x["end"].alias("at"), a["out"].alias("out")))
                .otherwise(a)
            )

        rest = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        return F.when(F.size(found) > 0, F.aggregate(found, zero, step, rest)).otherwise(text)

    redacted = let(kept_spans(F.col("found"), model), rewrite)
    return whole.select(*[(redacted if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
