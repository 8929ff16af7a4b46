"""Registered query: similar products without a blocking key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetrina.operators.similar import product_groups, similar_groups
from vetrina.plans.q_resolve import _sim, _words
from vetrina.plans.registry import register, round_doubles
from vetrina.plans.sqlfrag import r6
from vetrina.session import materialize
from vetrina.sources.tables import table

_PRODUCT = ("p_partkey", "concat(p_name, ' ', lower(p_type), ' size ', cast(p_size % 12 as {vc}), ' ', p_name) as product_name",
            "concat('Maker ', cast(p_partkey % 4 as {vc})) as brand", "concat('EC00000', cast(p_partkey % 3 as {vc})) as etim_class")


def described_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[e.format(vc="string") for e in _PRODUCT])


@register("e04_similar_products", f"""
WITH p AS (SELECT {', '.join(e.format(vc='varchar') for e in _PRODUCT)} FROM part),
w AS (SELECT *, list_sort({_words('product_name')}) AS nw FROM p),
g AS (SELECT etim_class, nw, lower(brand) AS low, min(product_name) AS product_name, min(brand) AS brand, count(*) AS n FROM w GROUP BY ALL)
SELECT least(a.product_name || '|' || a.brand, b.product_name || '|' || b.brand) AS one, greatest(a.product_name || '|' || a.brand, b.product_name || '|' || b.brand) AS two, a.etim_class,
       a.n * b.n AS n_pairs, {r6(_sim('a.product_name', 'a.brand', 'a.etim_class', 'b.product_name', 'b.brand', 'b.etim_class'))} AS score
FROM g a JOIN g b ON a.etim_class = b.etim_class AND (a.product_name || '|' || a.brand) < (b.product_name || '|' || b.brand)
WHERE len(list_intersect(a.nw, b.nw)) * 2 >= len(list_distinct(list_concat(a.nw, b.nw))) AND {_sim('a.product_name', 'a.brand', 'a.etim_class', 'b.product_name', 'b.brand', 'b.etim_class')} >= 0.8""")
def q_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of product groups of similar names, found by MinHash bands
    and verified by the exact score; groups stand for their records."""
    groups = materialize(product_groups(described_products(spark, sf_dir)), "product-groups")
    links = similar_groups(groups)
    side = lambda p: groups.select(F.col("group_id").alias(f"{p}_group_id"), F.concat_ws("|", "product_name", "brand").alias(f"{p}_name"), F.col("n_records").alias(f"{p}_n"), F.col("etim_class").alias(f"{p}_class"))
    named = links.join(side("a"), "a_group_id").join(side("b"), "b_group_id")
    return round_doubles(named.select(F.least("a_name", "b_name").alias("one"), F.greatest("a_name", "b_name").alias("two"), F.col("a_class").alias("etim_class"),
                                      (F.col("a_n") * F.col("b_n")).alias("n_pairs"), "score"))
