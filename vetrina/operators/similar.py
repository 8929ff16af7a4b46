"""Similar products without a blocking key (E04): MinHash banding over name
words, then the exact similarity of E03.

A score of ``threshold`` needs the same class and, with brand and class
counting 0.3 each, a name similarity of ``least`` = (threshold - 0.6) / 0.4.
Without a common brand word (or an equal brand) a score ends at 0.7.
Records that agree in class, name words and brand are one group, so copies
never meet as pairs.  A group's signature holds min-wise hashes of its words;
some of them make a band, and groups that share a band of one kind (and the
class) are candidates:

* **one brand**: two hashes a band, among groups whose brands have the same
  words;
* **narrow**: four hashes a band, among groups that share a brand word.  Two
  brands of different words, one of them of at most two, have a similarity of
  2/3 at most, so names must agree by ``least`` + 0.25;
* **wide**: two hashes a band, among groups that share a brand word and have
  three or more of them.

* **Recall.** A pair of name similarity s misses all bands with probability
  (1 - s^2)^bands: 1e-4 at 0.5 with 32 bands, and (1 - s^4)^24 = 1.1e-4 at
  0.75.  Splitting a hot band loses at most (1 - s)^12 = 2.4e-4 of its pairs
  a level.
* **Hot bands.** A band that more than ``SMALL`` groups share is split by
  further hashes: each member goes to one smaller band for each of twelve
  fresh hashes, again for those still hot, ``LEVELS`` times.  What is hot
  then is compared in blocks, spread over tasks, so nothing is dropped.
* **Verification.** Candidates are joined band by band, on ids and hashes of
  words alone, and compared there: by a bound from 64 bits of each name, then
  by the hashes.  Only alike pairs go on, once each, to the exact score.

Defined cases: records without class or without words link to nothing; null
brands count as missing; repeated records are one group; an empty table gives
empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetrina.operators.resolve import DEDUP_THRESHOLD, jaccard_sets, similarity, words
from vetrina.session import materialize

BANDS, ROWS, SUB, SMALL, BLOCK, LEVELS = 32, 2, 12, 4096, 2048, 3
NARROW_BANDS, NARROW_ROWS, NARROW_WORDS = 24, 4, 2
_CARRIED = ["group_id", "name_hashes", "bits"]


def _min_hashes(words_col: Column, first: int, count: int, *salt: Column) -> Column:
    """``count`` min-wise hashes of a word array, seeds from ``first`` on;
    rows of different ``salt`` are hashed independently."""
    def least_hash(k: int) -> Column:
        return F.array_min(F.transform(words_col, lambda w: F.xxhash64(F.lit(k), *salt, w)))

    return F.array(*[least_hash(k) for k in range(first, first + count)])


def product_groups(records: DataFrame) -> DataFrame:
    """(group_id, etim_class, product_name, brand, name_words, brand_words,
    n_records) of records that agree in class, name words and brand."""
    nw = F.array_sort(words(F.col("product_name")))
    rows = records.select("etim_class", "product_name", "brand", nw.alias("name_words"), F.lower("brand").alias("low"))
    key = F.sha2(F.to_json(F.struct("etim_class", "name_words", "low")), 256)
    return (rows.withColumn("group_id", key).groupBy("group_id").agg(
        F.first("etim_class").alias("etim_class"), F.min("product_name").alias("product_name"), F.min("brand").alias("brand"),
        F.first("name_words").alias("name_words"), F.count(F.lit(1)).alias("n_records")).withColumn("brand_words", words(F.col("brand"))))


def _sized(members: DataFrame) -> DataFrame:
    """Members of bands that two groups or more share, with the band's size:
    one partial count a band and task, then a join by band."""
    sizes = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(sizes, "band")


def _compare(members: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """Pairs of groups that meet under one key and have alike names."""
    side = lambda p: members.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in [*_CARRIED, *[c for c in ("block",) if c in members.columns]]])
    j = side("a").join(side("b"), keys).where(F.col("a_group_id") < F.col("b_group_id"))
    if "block" in members.columns:  # a pair of blocks compares across, and each block with itself once
        j = j.where((F.col("a_block") != F.col("b_block")) | (F.col("one") == F.col("two")))
    n_a, n_b = F.size("a_name_hashes"), F.size("b_name_hashes")
    # common words have common bits, but for words of one name that share a bit
    most = F.bit_count(F.col("a_bits").bitwiseAND(F.col("b_bits"))) + F.least(n_a - F.bit_count("a_bits"), n_b - F.bit_count("b_bits"))
    j = j.where(most >= least * (n_a + n_b - most))
    common = F.size(F.array_intersect("a_name_hashes", "b_name_hashes"))
    return j.where(common >= least * (n_a + n_b - common)).select("a_group_id", "b_group_id")


def similar_groups(groups: DataFrame, threshold: float = DEDUP_THRESHOLD, bands: int = BANDS) -> DataFrame:
    """(a_group_id, b_group_id, score) of groups whose similarity reaches
    ``threshold``, the smaller id first."""
    least = (threshold - 0.6) / 0.4 - 1e-9
    if least < 0.45:
        raise ValueError("banding is laid out for thresholds of 0.8 or more")
    usable = groups.where((F.size("name_words") > 0) & F.col("etim_class").isNotNull() & (F.col("etim_class") != "") & F.col("brand").isNotNull() & (F.col("brand") != ""))
    sig = _min_hashes(F.col("name_words"), 0, max(bands * ROWS, NARROW_BANDS * NARROW_ROWS))
    hashes = F.transform("name_words", lambda w: F.xxhash64(w))
    bits = F.aggregate("name_hashes", F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))))
    rows = materialize(usable.withColumns({"sig": sig, "name_hashes": hashes, "brand_key": F.to_json(F.array_sort("brand_words"))}).withColumn("bits", bits), "signatures")

    def cut(of: DataFrame, kind: str, scope: str, count: int, width: int) -> DataFrame:
        band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.xxhash64(F.lit(kind), "etim_class", scope, b, F.slice("sig", b * width + 1, width))))
        return of.select(*_CARRIED, band.alias("band"))

    worded = rows.withColumn("brand_word", F.explode("brand_words"))
    many = worded.where(F.size("brand_words") > NARROW_WORDS)
    cuts = cut(rows, "one brand", "brand_key", bands, ROWS).union(cut(worded, "narrow", "brand_word", NARROW_BANDS, NARROW_ROWS)).union(cut(many, "wide", "brand_word", bands, ROWS))
    members = materialize(_sized(cuts), "bands")
    links = []
    for level in range(LEVELS + 1):
        links.append(_compare(members.where(F.col("n") <= SMALL).drop("n"), least, ["band"]))
        hot = members.where(F.col("n") > SMALL)
        if hot.isEmpty():
            break
        if level == LEVELS:
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            own = F.pmod(F.xxhash64("group_id"), blocks).cast("int")
            dealt = hot.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            dealt = dealt.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("other", "n")
            links.append(_compare(dealt, least, ["band", "one", "two"]))
            break
        fresh = _min_hashes(F.col("name_hashes"), 10_000 + level * SUB, SUB, F.col("band"))  # a pair lost in one band is not lost in the others
        finer = hot.select(*_CARRIED, F.col("band").alias("up"), F.posexplode(fresh).alias("nr", "value"))
        members = materialize(_sized(finer.withColumn("band", F.xxhash64("up", "nr", "value")).drop("up", "nr", "value")), f"bands-{level + 1}")
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in ("group_id", "etim_class", "product_name", "brand", "name_words", "brand_words")])
    j = out.distinct().join(side("a"), "a_group_id").join(side("b"), "b_group_id")
    j = j.where(jaccard_sets(F.col("a_name_words"), F.col("b_name_words")) >= least)
    s = similarity(*[F.col(f"{p}_{c}") for p in "ab" for c in ("product_name", "brand", "etim_class")],
                   F.col("a_name_words"), F.col("a_brand_words"), F.col("b_name_words"), F.col("b_brand_words"))
    return j.withColumn("score", s).where(F.col("score") >= threshold).select("a_group_id", "b_group_id", "score")


def miss_probability(similarity_: float, bands: int = BANDS) -> float:
    """That a pair of this name similarity shares no band."""
    return math.pow(1 - similarity_**ROWS, bands)
