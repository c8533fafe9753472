"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

A line repeats an earlier one when their words are within the edit bound: one
inserted, deleted or replaced word for lines of at least EDIT_WORDS words,
none for shorter ones.  Lines are ordered by (doc_id, line number), and a line
goes when any earlier line is within the bound.

1. Equal lines become one row: hash, earliest position, half-line keys.
2. Two lines within the bound agree on their first or their last half.  Only
   lines that share a half key with another line go on.
3. Those emit their whole deletion neighbourhood as hashed keys.  A key is
   (length, place, words before, words after): a line of n words emits a key
   per deleted word, and for lines one word longer a key per place where that
   word may stand.  All lines with a key are within the bound of each other,
   so a key needs to hold its earliest line only, never pairs.
4. Each line meets the earliest of its keys' lines; the edit distance of the
   two is verified on their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, bit_table, discard, hot_keys, join_spread, materialise, with_bit
from .pii import let

EDIT_WORDS = 8
#: Bits of the filter that spares lines without a partner from being shuffled: a fixed size, 1 MB.
FILTER_BITS = 1 << 23
_GAP = r"[\x20\x09-\x0D]+"
_BLOCK = 64


def words_of(line: Column) -> Column:
    return F.filter(F.split(line, _GAP, -1), lambda w: w != "")


def _half_keys(w: Column) -> Column:
    """Hashes of the first and last halves, for partners of as many words and of one word less or more."""

    def keys(m: Column, tag: int) -> list[Column]:
        half = F.floor(m / 2).cast("int")
        rest = (m - half).cast("int")
        return [
            F.xxhash64(F.lit(0), m, F.slice(w, 1, half)),
            F.xxhash64(F.lit(1), m, F.slice(w, F.size(w) - rest + 1, rest)),
        ]

    return F.when(F.size(w) >= EDIT_WORDS, F.array(*keys(F.size(w), 0), *keys(F.size(w) - 1, 1)))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, line_no, line) of lines with words; rid tells rows of one doc_id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .select("doc_id", F.xxhash64("text").alias("rid"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    )


class Order:
    """Positions as one sortable column: packed into a long where ids and lengths allow."""

    def __init__(self, docs: DataFrame) -> None:
        b = docs.agg(
            F.min(F.col("doc_id").cast("long")).alias("lo"), F.max(F.col("doc_id").cast("long")).alias("hi"),
            F.max(F.length("text")).alias("n"),
        ).first()
        self.low, self.bits = b["lo"] or 0, (b["n"] or 0).bit_length() + 1
        self.packed = ((b["hi"] or 0) - self.low).bit_length() + self.bits < 63

    def pack(self) -> Column:
        if self.packed:
            return F.shiftleft(F.col("doc_id") - self.low, self.bits) + F.col("line_no")
        return F.struct(F.col("doc_id"), F.col("line_no").cast("long").alias("line_no"))

    def doc(self, pos: str) -> Column:
        return F.shiftright(F.col(pos), self.bits) + self.low if self.packed else F.col(pos)["doc_id"]

    def line(self, pos: str) -> Column:
        return F.col(pos).bitwiseAND((1 << self.bits) - 1) if self.packed else F.col(pos)["line_no"]


def _running(words: Column) -> Column:
    """Hash of the first i words, for i from 0 to all: whole blocks' hashes, then the words of the last one."""
    n = F.size(words)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(n / _BLOCK).cast("int")),
        lambda b: F.xxhash64(F.slice(words, b * _BLOCK + 1, F.lit(_BLOCK))),
    )
    return let(
        F.struct(blocks.alias("b"), words.alias("w")),
        lambda x: F.transform(
            F.sequence(F.lit(0), F.size(x["w"])),
            lambda i: F.xxhash64(
                F.slice(x["b"], F.lit(1), F.floor(i / _BLOCK).cast("int")),
                F.slice(x["w"], i - i % _BLOCK + 1, i % _BLOCK),
            ),
        ),
    )


def neighbourhood(words: Column) -> Column:
    """Keys of all lines within one word of this one."""

    def keys(x: Column) -> Column:
        n = F.size(x["f"]) - 1
        fore, aft = x["f"], x["b"]
        gone = F.transform(
            F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(n, i, F.get(fore, i), F.get(aft, n - 1 - i))
        )
        room = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(n + 1, i, F.get(fore, i), F.get(aft, n - i)))
        return F.concat(gone, room)

    return let(F.struct(_running(words).alias("f"), _running(F.reverse(words)).alias("b")), keys)


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one edit apart: their common ends leave one word at most."""

    def agree(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(first == 0, F.least(F.size(x), F.size(y))).otherwise(first.cast("int") - 1)

    longest, shortest = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    return (longest - shortest <= 1) & (agree(a, b) + agree(F.reverse(a), F.reverse(b)) >= longest - 1)


def _near(docs: DataFrame, distinct: DataFrame, order: Order) -> DataFrame:
    """(pos, kept): earliest positions of lines that are one edit from an earlier line, and that line."""
    halves = distinct.select("pos", F.explode("halves").alias("key"))
    shared = halves.groupBy("key").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).where("lo <> hi")
    partners = materialise(halves.join(shared.select("key"), "key", "left_semi").select("pos").distinct(), "partners")
    marks = bit_table(partners.select(F.xxhash64("pos").alias("x")), "x", FILTER_BITS)
    lines = _lines(docs).select(order.pack().alias("pos"), "line")
    lines = with_bit(lines, F.xxhash64("pos"), marks, FILTER_BITS).select("pos", words_of(F.col("line")).alias("words"))
    lines = materialise(lines.join(partners, "pos", "left_semi").dropDuplicates(["pos"]), "lines")
    keyed = lines.select("pos", F.explode(neighbourhood(F.col("words"))).alias("key"))
    first = keyed.groupBy("key").agg(F.min("pos").alias("kept"), F.max("pos").alias("last")).where("kept <> last")
    met = keyed.join(first, "key").where("kept < pos").groupBy("pos").agg(F.min("kept").alias("kept"))
    other = lines.select(F.col("pos").alias("kept"), F.col("words").alias("kept_words"))
    proven = met.join(lines, "pos").join(other, "kept").where(within_one(F.col("words"), F.col("kept_words")))
    near = materialise(proven.select("pos", "kept"), "near")
    discard(partners, lines)
    return near


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, rid, line_no, kept_doc_id, kept_line_no, edits: every line that repeats an earlier one.

    Lines are split at \\n and numbered from 0; words are runs of other than
    \\x20 and \\x09-\\x0D.  Lines without words take no part, nor do rows with
    a null doc_id; null text is empty.  `kept_*` is the earliest equal line
    (edits 0), or the earliest line one word away (edits 1) where that one is
    earlier than all equal lines.  Rows that repeat a doc_id share positions:
    equal lines in equal places of them stay.  `rid` is a hash of the row's
    text.  Extra columns are not read; an empty table gives no rows.
    """
    order = Order(docs)
    seen = materialise(
        _lines(docs).select(
            order.pack().alias("at"), "rid",
            F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2"),
            let(words_of(F.col("line")), _half_keys).alias("halves"),
        ),
        "seen",
    )
    halves = [F.min(F.get("halves", F.lit(i))).alias(f"k{i}") for i in range(4)]
    distinct = seen.groupBy("h1", "h2").agg(F.min("at").alias("pos"), F.count("*").alias("c"), *halves)
    distinct = distinct.withColumn("halves", F.when(F.col("k0").isNotNull(), F.array("k0", "k1", "k2", "k3")))
    distinct = materialise(distinct.select("h1", "h2", "pos", "c", "halves"), "distinct")
    hot = materialise(hot_keys(distinct, "h1", "h2"), "hot")
    near = _near(docs, distinct, order)
    verdict = distinct.join(near, "pos", "left").select("h1", "h2", "pos", "kept")
    gone = join_spread(seen.select("at", "rid", "h1", "h2"), verdict, ["h1", "h2"], hot)
    gone = gone.where("kept is not null or at > pos")
    gone = gone.withColumn("edits", F.when(F.col("kept").isNotNull(), 1).otherwise(0)).withColumn(
        "kept", F.coalesce("kept", "pos")
    )
    gone = gone.select(
        order.doc("at").alias("doc_id"), "rid", order.line("at").cast("long").alias("line_no"),
        order.doc("kept").alias("kept_doc_id"), order.line("kept").cast("long").alias("kept_line_no"), "edits",
    )
    gone = materialise(gone, "gone")
    discard(seen, distinct, near)
    return gone


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """`docs` without their repeated lines; other columns unchanged.

    A document of which no line with words is left goes, since all of it
    stands earlier; one that had no words stays as it is.
    """
    gone = repeated_lines(docs).groupBy("doc_id", "rid").agg(F.collect_set("line_no").alias(P + "gone"))
    gone = gone.select(F.col("doc_id").alias(P + "doc"), F.col("rid").alias(P + "rid"), P + "gone")
    joined = docs.join(
        gone,
        (docs["doc_id"].cast("long") == F.col(P + "doc"))
        & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(P + "rid")),
        "left",
    )

    def left(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1).cast("array<bigint>"), F.col(P + "gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i.cast("int"))), "\n")

    touched = F.col(P + "gone").isNotNull()
    rest = F.when(touched, let(F.split(docs["text"], "\n", -1), left)).otherwise(docs["text"])
    joined = joined.withColumn(P + "text", rest)
    joined = joined.where(~touched | F.col(P + "text").rlike(r"[^\x20\x09-\x0D]"))
    return joined.select(*[F.col(P + "text").alias(c) if c == "text" else docs[c] for c in docs.columns])
