"""Extraction rules: observations to groups, groups to rules or discrepancies, review, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_text
from ..sources.cache import Cache
from .ordering import ranked

EXAMPLES, DOCUMENTS = 3, 5


def consensus(observations: DataFrame, *by: str) -> DataFrame:
    """(by, doc, pos, text) -> a row for each group: rule if all its texts are one (as normal text, without case).

    ``evidence`` counts texts; a rule takes the first formulation and the first examples, a discrepancy the first two
    variants and the first distinct documents.  The offline judge stands in for a model's opinion.
    """
    rows = observations.select(*by, F.struct("pos", "doc", "text").alias("o"), "doc", F.lower(normal_text(F.col("text"))).alias("normal"))
    variants = rows.groupBy(*by, "normal").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    groups = variants.groupBy(*by).agg(F.sum("n").alias("evidence"), F.count("normal").alias("variants"), F.min(F.struct("o", "normal")).alias("first"))
    same = list(by)
    others = variants.join(groups.select(*same, F.col("first.normal").alias("_first")), same).where(F.col("normal") != F.col("_first")).groupBy(*same).agg(F.min("o").alias("other"))
    # of each group, every task passes on the first few rows only
    top = lambda df, order, n: df.withColumn("_place", F.row_number().over(Window.partitionBy(*same).orderBy(order))).where(F.col("_place") <= n)
    listed = lambda df, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", F.col(c).cast("string").alias("v")))), lambda x: x["v"]), df)
    examples = top(rows.withColumn("text", F.col("o.text")), "o", EXAMPLES).groupBy(*same).agg(listed(" / ", "text").alias("examples"))
    documents = top(rows.groupBy(*same, "doc").agg(F.min("o").alias("o")), "o", DOCUMENTS).groupBy(*same).agg(listed(",", "doc").alias("documents"))
    g = groups.join(others, same, "left").join(examples, same).join(documents, same)
    return g.select(
        *by, F.col("first.o.pos").alias("pos"), "evidence", F.when(F.col("variants") == 1, "rule").otherwise("discrepancy").alias("kind"), F.col("first.o.text").alias("text"), F.col("other.text").alias("other_text"),
        "examples", "documents",
    )


def numbered(groups: DataFrame, scope: str) -> DataFrame:
    """Running ids in the order of ``pos``, rules and discrepancies counted apart, from 0 in each scope."""
    number = (F.col("_rank") - 1).cast("string")
    placed = ranked(groups, [scope, "kind"], [F.col("pos")], "_rank")
    return placed.withColumn("id", F.concat(F.col(scope).cast("string"), F.when(F.col("kind") == "rule", "_").otherwise("_disc_"), number)).drop("_rank")


def reviewed(discrepancies: DataFrame) -> DataFrame:
    """(id, text, other_text, evidence, ratio, action, custom) -> the resolved rule of each decision; skips give none.

    Actions a, b, custom, majority (a from half on); a custom decision without text is a skip.
    """
    action = F.when(F.col("action") == "majority", F.when(F.col("ratio") >= 0.5, "a").otherwise("b")).otherwise(F.col("action"))
    d = discrepancies.withColumn("taken", action)
    text = F.when(F.col("taken") == "a", F.col("text")).when(F.col("taken") == "b", F.col("other_text")).when(F.col("taken") == "custom", F.nullif(F.trim("custom"), F.lit("")))
    share = F.when(F.col("taken") == "a", F.col("ratio")).otherwise(1 - F.col("ratio"))
    n = F.when(F.col("taken") == "custom", 1).otherwise(F.greatest(F.lit(1), F.floor(share * F.col("evidence")))).cast("long")
    return d.withColumn("rule_text", text).where("rule_text is not null").select(F.concat(F.lit("rule_resolved_"), F.col("id").cast("string")).alias("id"), "rule_text", n.alias("evidence"))


def merged_rules(rules: DataFrame, resolved: DataFrame) -> DataFrame:
    """Rules, and resolved ones whose id is not there; of resolved ones with one id the first by ``pos``."""
    first = resolved.groupBy("id").agg(F.min_by(F.struct(*resolved.columns), "pos").alias("r")).select("r.*")
    return rules.unionByName(first.join(rules.select("id"), "id", "left_anti"))


def undecided(discrepancies: DataFrame, decisions: DataFrame) -> DataFrame:
    """What a resumed review still has to decide."""
    return discrepancies.join(decisions.select("id"), "id", "left_anti")


class Review:
    """A review that can be taken up again: each decision is committed to a cache at once, whole or not at all.

    A session that cannot be read starts anew, as the cache's readers go back to the last whole commit.
    """

    ACTIONS = ("a", "b", "custom", "majority", "skip")

    def __init__(self, cache: Cache):
        self.cache = cache

    def decide(self, id: str, action: str, custom: str | None = None) -> None:  # noqa: A002
        """A later decision on the same id replaces the earlier one."""
        if action not in self.ACTIONS:
            raise ValueError(f"no such action: {action}")
        new = self.cache.spark.createDataFrame([(id, action, custom)], "id string, action string, custom string")
        old = self.cache.rows()
        self.cache.put(new if old is None else old.where(F.col("id") != id).unionByName(new))

    def decisions(self) -> DataFrame:
        """(id, action, custom) so far."""
        rows = self.cache.rows()
        return self.cache.spark.createDataFrame([], "id string, action string, custom string") if rows is None else rows

    def open(self, discrepancies: DataFrame) -> DataFrame:
        return undecided(discrepancies, self.decisions())
