"""Operator 8, exact dedup by two-pass Bloom filtering, in DataFrame
functions only.

Pass one hashes every normalised text to two bits of a blocked filter and
counts, per bit and with partial aggregation, how many rows hit it; the
filter keeps the bits hit at least twice.  A text that occurs twice finds
both its bits there (no false negatives).  Pass two probes the filter: rows
that miss are unique and pass straight through; only the others shuffle and
are grouped exactly by SHA-256.

The filter has 16 bits a row, ``MAX_BITS`` at most (about 50 MB broadcast);
beyond that it fills up and lets more rows into the exact pass, with the
same result.

Equal means identical after each run of ASCII white space became one space.
The row with the smallest id stays.  Defined cases: a null text counts as
empty; null ids come last; among rows that share the smallest id, the one
with the smallest hash of all columns stays, and among fully identical rows
exactly one; an empty table gives an empty result; input columns with the
names of the four result columns are replaced, all others are returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetrina.llm.common import materialize, whole_text

RESULT = ("keep_id", "group_size", "kept", "text_sha256")
MIN_BITS, MAX_BITS, BLOCK_BITS = 16, 28, 12


def normalised(text_col: str) -> Column:
    return F.regexp_replace(whole_text(text_col), r"[\x20\x09-\x0D]+", " ")


def _places(h: Column, bits: int) -> tuple[Column, Column, Column]:
    """Block of the filter and two different bits in it."""
    block = F.shiftrightunsigned(h, 64 - (bits - BLOCK_BITS))
    one = h.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    step = F.shiftrightunsigned(h, BLOCK_BITS).bitwiseAND(F.lit(0xFFFFF)) % ((1 << BLOCK_BITS) - 1) + 1
    return block, one, (one + step) % (1 << BLOCK_BITS)


def filter_bits(rows: int) -> int:
    """Width of a filter for so many rows, as a power of two."""
    return min(MAX_BITS, max(MIN_BITS, math.ceil(math.log2(16 * max(rows, 1)))))


def bloom_filter(hashes: DataFrame, h: str, bits: int, times: int = 1) -> DataFrame:
    """(x8_block, x8_words map<word, 64 bits>) of the bits hit ``times``
    times or more."""
    block, one, two = _places(F.col(h), bits)
    hits = hashes.select(block.alias("x8_block"), F.explode(F.array(one, two)).alias("bit"))
    often = hits.groupBy("x8_block", "bit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)
    words = (often.groupBy("x8_block", F.shiftright("bit", 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")))
    return words.groupBy("x8_block").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("x8_words"))


def _hit(bit: str) -> Column:
    word = F.element_at("x8_words", F.shiftright(bit, 6).cast("int"))
    return F.coalesce(F.getbit(word, F.col(bit).bitwiseAND(F.lit(63)).cast("int")) == 1, F.lit(False))


def filter_hits(rows: DataFrame, h: str, filter_: DataFrame, bits: int) -> tuple[DataFrame, Column]:
    """The rows beside their part of the filter, and whether all bits hit."""
    block, one, two = _places(F.col(h), bits)
    placed = rows.withColumns({"x8_block": block, "x8_one": one, "x8_two": two}).join(F.broadcast(filter_), "x8_block", "left")
    return placed, _hit("x8_one") & _hit("x8_two")


def might_contain(rows: DataFrame, h: str, filter_: DataFrame, bits: int) -> DataFrame:
    """The rows whose bits are all in the filter."""
    block, one, two = _places(F.col(h), bits)
    placed = rows.withColumns({"x8_block": block, "x8_one": one, "x8_two": two}).join(F.broadcast(filter_), "x8_block")
    return placed.where(_hit("x8_one") & _hit("x8_two")).drop("x8_block", "x8_one", "x8_two", "x8_words")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Input rows with keep_id, group_size, kept and text_sha256."""
    own = [c for c in df.columns if c not in RESULT]
    rows = df.select(*[F.col(f"`{c}`") for c in own])
    bits = filter_bits(rows.count())
    keyed = rows.withColumn("x8_text", normalised(text_col)).withColumn("x8_hash", F.xxhash64("x8_text"))
    filter_ = bloom_filter(keyed.select("x8_hash"), "x8_hash", bits, times=2)

    block, one, two = _places(F.col("x8_hash"), bits)
    probed = (keyed.withColumns({"x8_block": block, "x8_one": one, "x8_two": two})
              .join(F.broadcast(filter_), "x8_block", "left")
              .withColumn("x8_maybe", _hit("x8_one") & _hit("x8_two"))
              .withColumn("text_sha256", F.sha2("x8_text", 256)))
    id_ = F.col(f"`{id_col}`")
    out = [*[F.col(f"`{c}`") for c in own]]

    straight = probed.where(~F.col("x8_maybe")).select(
        *out, id_.alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")

    # rows that may repeat: written once, as they are read three times
    maybe = materialize(probed.where("x8_maybe").select(*out, "text_sha256", F.xxhash64(*out).alias("x8_tie")), "maybe-repeated")
    keeper = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.col("x8_tie").alias("tie"))
    groups = (maybe.groupBy("text_sha256", keeper.alias("x8_row")).agg(F.count(F.lit(1)).alias("same"))
              .groupBy("text_sha256").agg(F.min(F.struct("x8_row", "same")).alias("x8_keep"), F.sum("same").alias("group_size")))
    marked = (maybe.join(groups, "text_sha256")
              .withColumn("kept", keeper.eqNullSafe(F.col("x8_keep.x8_row"))).withColumn("keep_id", F.col("x8_keep.x8_row.id")))
    columns = [*out, F.col("keep_id"), F.col("group_size"), F.col("kept"), F.col("text_sha256")]
    tied = F.col("kept") & (F.col("x8_keep.same") > 1)
    one_of = Window.partitionBy("text_sha256").orderBy("x8_tie")
    ties = marked.where(tied).withColumn("kept", F.row_number().over(one_of) == 1)
    return straight.unionByName(marked.where(~tied).select(*columns)).unionByName(ties.select(*columns))
