"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over one text; the table names
measures and bounds, and compiles to one boolean.  No user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for with was as on are at by this from or an be "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch er "
    "le la les de des et en un une du que est pour qui dans il au ce pas sur "
    "el los las del y que por con para una su al lo como se no es mi te"
).split()


@dataclass(frozen=True)
class Rule:
    """measure / per lies in [low, high]; a document without the denominator passes."""

    name: str
    measure: str
    per: str | None
    low: float | None
    high: float | None


#: Verdict thresholds beyond the base: wide enough to leave ordinary prose alone.
RULES = (
    Rule("length", "n_words", None, None, 1_000_000),
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 24.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.4),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.01, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)
#: The rules by which documents are dropped: length alone condemns none, since the ratios judge long texts alike.
KEEP_RULES = tuple(r for r in RULES if r.name != "length")
MIN_WORDS = 20
#: Percent of words in repeated windows from which the base fails.
MAX_REPEAT_PERCENT = 30


def _let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words that lie in a window found twice or more, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        keyed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda e, i: F.get(s, i + 1)["h"].eqNullSafe(e["h"]) | F.get(s, i - 1)["h"].eqNullSafe(e["h"]),
            )
            return F.array_sort(F.transform(twice, lambda e: e["i"]))

        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            _let(keyed, positions),
            start,
            lambda a, x: F.struct(
                (a["total"] + F.least(F.lit(WINDOW), x - a["last"])).alias("total"), x.alias("last")
            ),
            lambda a: a["total"],
        )

    last = F.size(words) - WINDOW
    hashes = F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])),
    )
    found = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)))
    return F.coalesce(F.when(last >= 1, found), F.lit(0).cast("long"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def measures(text: Column) -> Column:
    """One struct of all MEASURES; null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAP, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    symbols = (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
            _repeated(w).alias("n_repeat_words"),
        )

    def of_lines(x: Column) -> Column:
        n = F.size(x).cast("long")
        return F.struct(n.alias("n_lines"), (n - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    parts = F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))

    def flat(m: Column) -> Column:
        where = {"n_symbols": m["n_symbols"], "n_lines": m["l"]["n_lines"], "n_dup_lines": m["l"]["n_dup_lines"]}
        return F.struct(*[(where[n] if n in where else m["w"][n]).alias(n) for n in MEASURES])

    return _let(parts, flat)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def compile_rules(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The table's verdict over a struct of measures: one conjunction of bounds."""
    verdict = F.lit(True)
    for r in rules:
        value = m[r.measure].cast("double")
        if r.per:
            value = value / F.when(m[r.per] > 0, m[r.per])
        if r.low is not None:
            verdict &= F.coalesce(value >= r.low, F.lit(True))
        if r.high is not None:
            verdict &= F.coalesce(value <= r.high, F.lit(True))
    return verdict


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, all measures, base_failed, kept: one row per input row.

    Null or empty text has no words, fails the base and is not kept; null
    doc_id stays null; repeated rows repeat; extra columns are not read.
    """
    judged = _let(
        measures(F.col("text")),
        lambda m: F.struct(
            *[m[n].alias(n) for n in MEASURES],
            base_failed(m).alias("base_failed"),
            (~base_failed(m) & compile_rules(m, rules)).alias("kept"),
        ),
    )
    return docs.select("doc_id", judged.alias("m")).select("doc_id", "m.*")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = KEEP_RULES) -> DataFrame:
    """The rows of `docs` that `quality` keeps under `rules`, all their columns unchanged."""
    return docs.where(_let(measures(F.col("text")), lambda m: ~base_failed(m) & compile_rules(m, rules)))
