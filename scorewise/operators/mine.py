"""Association-rule mining: frequent itemsets (Spark FP-growth) and rules with
any antecedent / consequent sizes and the full metric set.

Spark's own ``associationRules`` only emits single-item consequents and no
leverage / conviction, so rules are enumerated here: each frequent itemset of
size k is exploded into its 2^k - 2 proper non-empty antecedents (k is bounded
by the basket width), and the supports of antecedent and consequent come from
equi-joins against the itemset table (downward closure guarantees both exist).
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewise.session import cut_lineage


def frequent_itemsets(baskets: DataFrame, min_support: float, items_col: str = "items") -> DataFrame:
    """(items sorted array, freq, support) for every itemset with support >= ``min_support``.

    The baskets are read several times and the itemsets joined with themselves:
    both are materialised once.
    """
    baskets = cut_lineage(baskets.select(items_col))
    n = baskets.count()
    model = FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=1.0).fit(baskets)
    return cut_lineage(model.freqItemsets.select(
        F.array_sort("items").alias("items"),
        F.col("freq"),
        (F.col("freq") / F.lit(float(n))).alias("support"),
    ))


def association_rules(itemsets: DataFrame, min_confidence: float) -> DataFrame:
    """Rules A -> C with confidence >= ``min_confidence``; metrics as in mlxtend."""
    big = itemsets.filter(F.size("items") >= 2).withColumn("_k", F.size("items"))
    masks = big.withColumn("_mask", F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.col("_k")).cast("int") - 2)))
    def bit(i):
        return F.floor(F.col("_mask") / F.pow(F.lit(2), i)) % 2 == 1
    cand = masks.select(
        F.col("items").alias("_all"),
        F.col("support").alias("support"),
        F.filter("items", lambda x, i: bit(i)).alias("antecedents"),
        F.filter("items", lambda x, i: ~bit(i)).alias("consequents"),
    )
    sup = itemsets.select(F.col("items").alias("_items"), F.col("support").alias("_s"))
    a = sup.select(F.col("_items").alias("antecedents"), F.col("_s").alias("antecedent_support"))
    c = sup.select(F.col("_items").alias("consequents"), F.col("_s").alias("consequent_support"))
    rules = cand.join(a, "antecedents").join(c, "consequents")
    conf = F.col("support") / F.col("antecedent_support")
    rules = rules.withColumn("confidence", conf).filter(F.col("confidence") >= F.lit(min_confidence))
    return rules.select(
        "antecedents",
        "consequents",
        "antecedent_support",
        "consequent_support",
        "support",
        "confidence",
        (F.col("confidence") / F.col("consequent_support")).alias("lift"),
        (F.col("support") - F.col("antecedent_support") * F.col("consequent_support")).alias("leverage"),
        F.when(F.col("confidence") >= 1.0, F.lit(float("inf")))
        .otherwise((1.0 - F.col("consequent_support")) / (1.0 - F.col("confidence")))
        .alias("conviction"),
    )


def sort_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.col("confidence").desc(), F.col("lift").desc())
