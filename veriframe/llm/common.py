"""Helpers the training-data operators share: tables, shared scratch space, text columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_CHECKPOINTS = "file:/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one under /tmp if they are one process and none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or LOCAL_CHECKPOINTS


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/veriframe/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, so a lost
    executor costs its own tasks only and no later job computes ``df`` again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that ``spread_join`` may treat as hot: no key of the others has more than so small a share of the rows.
HOT_KEYS = 1024


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, a stored table with one row for each key; ``weight`` says how many
    rows have the key. Rows of the fewer than HOT_KEYS keys with the most rows stay where they are and get their facts
    by broadcast; the others are shuffled by key, so that no task is dealt a hot key."""
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_KEYS > F.lit(total)
    few, rest = F.broadcast(facts.where(hot).drop(weight)), facts.where(~hot).drop(weight)
    others = rows.join(F.broadcast(facts.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(others.join(rest, keys, how))


def id_crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def packed(text: str) -> Column:
    """The UTF-8 bytes of a text column, compressed: what a text weighs when it must be shuffled."""

    @F.pandas_udf(T.BinaryType())
    def pack(texts):
        import pandas as pd
        import zstandard

        packer = zstandard.ZstdCompressor(1)
        return pd.Series([None if t is None else packer.compress(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    return pack(F.col(text))


def unpacker():
    """bytes of a ``packed`` value; none for a null."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return lambda value: b"" if value is None else unpack(value)
