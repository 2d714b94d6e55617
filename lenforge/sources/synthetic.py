"""Synthetic instruction corpora: seeded, the same in any engine, with mixtures of lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values: (instruction, output) words of each kind, and the kinds of ten consecutive choices of each corpus.
KINDS = {"S": (10, 30), "M": (60, 180), "L": (250, 500), "X": (700, 1100)}
MIXES = {"small": "SSSSSSSMMM", "tiny": "SSMMMMMLLL", "big": "SSSSMMMLLX"}
SIZES = {"small": 60_000, "tiny": 20_000, "big": 200_000}
# Openings of instructions, and the words of texts.
OPENINGS = ("Explain this.", "Summarise the text.", "Write a story.", "List the steps.", "Compare the items.", "Answer the question.", "Describe the scene.")
WORDS = "river stone garden window paper cloud market silver engine letter forest bridge winter candle harbour orange"


def _text(first: Column, words: Column) -> Column:
    """``words`` words that follow from one number per text."""
    table = WORDS.split()
    step = F.pmod(first, F.lit(13)) * 2 + 1
    at = lambda i: (F.pmod(first + i * step + F.floor(i * i / F.lit(7)), F.lit(len(table))) + 1).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.element_at(F.array(*map(F.lit, table)), at(i))), " ")


def corpus(spark: SparkSession, mix: str, n: int | None = None, seed: int = 1234) -> DataFrame:
    """(id, instruction, input, output) of ``n`` records (by default as many as the mix has)."""
    h = F.md5(F.concat(F.lit(f"{seed}-{mix}-"), F.col("id").cast("string")))
    part = lambda at: F.conv(F.substring(h, at, 6), 16, 10).cast("long")
    kind = F.substring(F.lit(MIXES[mix]), (part(1) % 10 + 1).cast("int"), F.lit(1))
    size = lambda k: F.element_at(F.create_map(*(F.lit(x) for c, v in KINDS.items() for x in (c, v[k]))), kind)
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (part(7) % len(OPENINGS) + 1).cast("int"))
    return spark.range(SIZES[mix] if n is None else n).select("id", F.concat(opening, F.lit(" "), _text(part(13), size(0))).alias("instruction"), F.lit("").alias("input"), _text(part(19), size(1)).alias("output"))


def emit(spark: SparkSession, path: str, mix: str, n: int | None = None, seed: int = 1234) -> None:
    """The corpus as JSON lines."""
    corpus(spark, mix, n, seed).drop("id").write.mode("overwrite").json(path)
