"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import shared_folder
from ..plans.shipping import ship

#: Internal columns carry this prefix so that extra input columns cannot clash.
P = "__rq_"
#: A key is hot if it has this many rows and one row in HOT_KEYS, so there are HOT_KEYS hot ones at most.
HOT_ROWS, HOT_KEYS = 1024, 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write to the shared folder, in folders by the columns `by`, and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/reelquery/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    # Shuffle files live until the driver's garbage is collected: those of this step are of no more use.
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.reelquery_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialise` returned; nothing that is still to be computed may read them."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.reelquery_folder)
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def hot_keys(counts: DataFrame, *keys: str) -> DataFrame:
    """Keys of a table with a column c of counts that have very many rows: HOT_KEYS at most."""
    total = counts.agg(F.sum("c")).first()[0] or 0
    return counts.where(F.col("c") >= max(HOT_ROWS, total // HOT_KEYS)).select(*keys)


def join_spread(rows: DataFrame, ones: DataFrame, keys: str | list[str], hot: DataFrame) -> DataFrame:
    """rows joined with `ones` (unique in keys): hot keys by broadcast, so their rows stay where they are; the rest by key."""
    marked = rows.join(F.broadcast(hot.withColumn(P + "hot", F.lit(True))), keys, "left")
    few = ones.join(F.broadcast(hot), keys, "left_semi")
    rest = marked.where(F.col(P + "hot").isNull()).drop(P + "hot").join(ones, keys)
    return rest.unionByName(marked.where(F.col(P + "hot")).drop(P + "hot").join(F.broadcast(few), keys))


def bit_table(keys: DataFrame, key: str, n_bits: int) -> DataFrame:
    """(bucket, bits): n_bits bits, set at pmod(key, n_bits) of each row; at most n_bits / 32768 rows of 4 KB."""
    x = keys.select((F.pmod(F.col(key), F.lit(n_bits)) + 1).alias("x"))
    return x.groupBy(F.expr("bitmap_bucket_number(x)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits")
    )


def bit_filter(keys: DataFrame, key: str, n_bits: int) -> np.ndarray:
    """The bits of `bit_table` as bytes: their number is fixed, whatever the number of rows."""
    bits = np.zeros(n_bits // 8, np.uint8)
    for r in bit_table(keys, key, n_bits).collect():
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["bucket"] - 1) * len(piece) : r["bucket"] * len(piece)] = piece
    return bits


def bit_set(rows: DataFrame, key: Column, marks: DataFrame, n_bits: int, name: str) -> DataFrame:
    """Adds a column: whether the key's bit is set in a `bit_table`, which is broadcast: n_bits bounds its size."""
    kept = rows.columns
    rows = rows.withColumn(P + "x", F.pmod(key, F.lit(n_bits)) + 1)
    rows = rows.withColumns({P + "b": F.expr(f"bitmap_bucket_number({P}x)"), P + "p": F.expr(f"bitmap_bit_position({P}x)")})
    marks = marks.select(F.col("bucket").alias(P + "bucket"), F.col("bits").alias(P + "bits"))
    met = rows.join(F.broadcast(marks), F.col(P + "b") == F.col(P + "bucket"), "left")
    byte = F.conv(F.hex(F.substring(P + "bits", F.floor(F.col(P + "p") / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.pmod(F.floor(byte.cast("int") / F.pow(F.lit(2), F.col(P + "p") % 8)), F.lit(2))
    return met.select(*kept, F.coalesce(bit == 1, F.lit(False)).alias(name))


def with_bit(rows: DataFrame, key: Column, marks: DataFrame, n_bits: int) -> DataFrame:
    """Rows whose key's bit is set (see `bit_set`)."""
    return bit_set(rows, key, marks, n_bits, P + "set").where(P + "set").drop(P + "set")


def docs_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, text binary): null text becomes empty; only two columns are read."""
    ship(docs.sparkSession)
    return docs.select(
        F.col(key).cast("long").alias(key),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias(text),
    )
