"""Mixing sources to target weights in a tree of domains, languages and sources.

The budget flows down the tree: a node's budget is dealt to its children in proportion to their weights, and no child
takes more than its capacity (the words below it times ``max_epochs``). What a child cannot take goes to its siblings,
in proportion again, and a node passes on to its own siblings only what all its children together cannot
take. All of it is integer arithmetic, so a budget does not depend on the order of sums; remainders of divisions (less
than a word a child) stay unspent.

A leaf repeats all its documents for the whole epochs in its budget. The rest comes from one more epoch: its documents
in an order seeded by the epoch, as a prefix that ends with the document in which the rest runs out. Documents stay whole.

Plan: leaves are aggregated with partial sums, and the tree has as many rows as there are sources. The prefix of a leaf
is found without sorting the leaf: words are summed by the first ``BUCKET_BITS`` of the seeded hash, and only the
bucket in which the rest runs out is put in order. The outcome is one cut (a hash) a leaf; documents compare their own
hash with it, so no text is shuffled while the leaves are few enough to be broadcast, which Spark checks by size.

Null names count as the empty name, null texts as empty; a leaf without words takes part with budget 0. Repeated rows
share a hash, and the whole run of them is taken or left. A null doc_id is hashed as such. Empty tables give an empty
result. Columns that the tree uses are computed under names of their own, so those of the table cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicebox.llm.common import n_words, text_of
from sluicebox.scratch import written

LEVELS = ("domain", "lang", "source")
WEIGHTS: dict[str, dict[str, int]] = {"lang": {"en": 6, "de": 2, "fr": 2, "es": 2}}
#: Budget as a percentage of all words; epochs of a leaf at most; seed of the orders.
BUDGET_PERCENT = 75
MAX_EPOCHS = 2
SEED = 17
BUCKET_BITS = 12
_HASH_BITS = 60


def domain_of(source: Column) -> Column:
    """A domain for tables that have none: sources in four groups by a hash."""
    first = F.conv(F.substring(F.md5(F.coalesce(source.cast("string"), F.lit("")).cast("binary")), 1, 1), 16, 10).cast("int")
    return F.concat(F.lit("domain"), F.floor(first / 4).cast("string"))


def _names(domain: Column | None) -> list[Column]:
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    of = domain_of(F.col("source")) if domain is None else F.coalesce(domain.cast("string"), F.lit(""))
    return [of.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source")]


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(weight))).otherwise(out)
    return out.cast("decimal(19,0)")


def _dealt(children: DataFrame, level: str, above: list[str]) -> DataFrame:
    """``children`` (names, capacity, weight, parent_budget) with their ``budget``."""
    wide = "decimal(19,0)"
    # A share of no weight takes nothing; by capacity for a unit of weight the children fill up one after the other.
    ratio = (F.col("capacity") / F.col("weight")).cast("double")
    order = Window.partitionBy(*above).orderBy(ratio, level)
    down = children.withColumn("used", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    down = down.withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(wide))
    left = (F.col("parent_budget") - F.col("used")).cast(wide)
    down = down.withColumn("full", F.col("capacity").cast(wide) * F.col("open") <= left * F.col("weight"))
    siblings = Window.partitionBy(*above)
    first_used = F.min(F.when(~F.col("full"), F.col("used"))).over(siblings)
    first_open = F.max(F.when(~F.col("full"), F.col("open"))).over(siblings)
    down = down.withColumn("first_used", first_used).withColumn("first_open", first_open)
    share = F.expr("CAST(parent_budget - first_used AS DECIMAL(19,0)) * weight DIV first_open")
    return down.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(share).cast("bigint"))


def leaf_budgets(
    rows: DataFrame, weights: dict[str, dict[str, int]], budget: int | None, max_epochs: int, percent: int = BUDGET_PERCENT
) -> DataFrame:
    """(domain, lang, source, words, budget) of every leaf of ``rows`` (names and n_tokens)."""
    leaves = written(
        rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("words")).withColumn("capacity", F.col("words") * max_epochs), "leaves"
    )
    total = leaves.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("total"))
    amount = F.floor(F.col("total") * percent / 100) if budget is None else F.lit(budget)
    parents = total.select(amount.cast("bigint").alias("budget"))
    above: list[str] = []
    for level in LEVELS:
        names = [*above, level]
        children = leaves.groupBy(*names).agg(F.sum("capacity").alias("capacity"), F.sum("words").alias("words"))
        children = children.withColumn("weight", _weight(level, weights))
        given = parents.withColumnRenamed("budget", "parent_budget")
        joined = children.join(given, above) if above else children.crossJoin(F.broadcast(given))  # one row
        parents = _dealt(joined, level, above or [F.lit(0)]).select(*names, "words", "budget")
        above = names
        if level != LEVELS[-1]:
            parents = parents.drop("words")
    return written(parents, "budgets")


def _order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits that order the documents of a leaf in an epoch."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def cuts(rows: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """(names, words, budget, whole epochs, cut): documents whose hash is at most ``cut`` are taken once more."""
    spread = F.when(F.col("words") > 0, F.expr("budget DIV words")).otherwise(F.lit(0)).cast("bigint")
    leaves = budgets.withColumn("whole", spread).withColumn("rest", F.col("budget") - F.col("whole") * F.col("words"))
    keyed = rows.join(leaves.where("rest > 0").select(*LEVELS, "whole", "rest"), list(LEVELS))
    keyed = keyed.withColumn("hash", _order_hash(seed, F.col("whole"), F.col("doc_id")))
    keyed = keyed.withColumn("bucket", F.shiftright("hash", _HASH_BITS - BUCKET_BITS))
    filled = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = filled.where("before < rest AND rest <= before + n").select(*LEVELS, "bucket", "before")
    inside = Window.partitionBy(*LEVELS).orderBy("hash").rangeBetween(Window.unboundedPreceding, -1)
    running = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    tail = keyed.join(last, [*LEVELS, "bucket"]).withColumn("start", F.col("before") + running)
    found = tail.where("start < rest").groupBy(*LEVELS).agg(F.max("hash").alias("cut"))
    return written(leaves.join(found, list(LEVELS), "left").select(*LEVELS, "words", "budget", "whole", "cut"), "cuts")


def _copies(seed: int) -> Column:
    taken = _order_hash(seed, F.col("whole"), F.col("doc_id")) <= F.col("cut")
    return F.col("whole") + F.when(F.coalesce(taken, F.lit(False)), F.lit(1)).otherwise(F.lit(0))


def mix(
    docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, budget: int | None = None, max_epochs: int = MAX_EPOCHS,
    seed: int = SEED, domain: Column | None = None,
) -> DataFrame:
    """One row per document: doc_id, domain, lang, source, n_tokens, leaf_budget, copies."""
    rows = written(docs.select("doc_id", *_names(domain), n_words("text").alias("n_tokens")), "words")
    leaves = cuts(rows, leaf_budgets(rows, weights, budget, max_epochs), seed)
    joined = rows.join(leaves.drop("words"), list(LEVELS))
    return joined.select("doc_id", *LEVELS, "n_tokens", F.col("budget").alias("leaf_budget"), _copies(seed).cast("bigint").alias("copies"))


def mixed_documents(
    docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, budget: int | None = None, max_epochs: int = MAX_EPOCHS,
    seed: int = SEED, domain: Column | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as it is taken, with all columns."""
    rows = written(docs.select("doc_id", *_names(domain), n_words("text").alias("n_tokens")), "words")
    leaves = cuts(rows, leaf_budgets(rows, weights, budget, max_epochs), seed).drop("words")
    packed = docs.select(F.struct("*").alias("doc"), F.col("doc_id"), *_names(domain))
    counted = packed.join(leaves, list(LEVELS)).withColumn("copies", _copies(seed)).where("copies > 0")
    return counted.select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")
