"""Sources mixed to target weights by temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, spare, stored

#: Tokens of a block; a window never spans more than one block.
BLOCK_TOKENS = 1 << 20


def count_tokens(text: Column) -> Column:
    """Words: runs without ASCII white space. Null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measures(shares: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """For each exponent the weights' entropy, and how often the most repeated source is passed."""
    rows = shares.crossJoin(F.broadcast(shares.sparkSession.createDataFrame([(i, a) for i, a in enumerate(exponents)], "i int, a double")))
    rows = rows.withColumns({"p": F.pow("share", "a"), "log": F.log("share")})
    rates = rows.groupBy("i", "a").agg(
        F.sum("p").alias("z"), F.sum(F.col("p") * F.col("log")).alias("plog"), F.max(F.col("p") / F.col("share")).alias("most"), F.min(F.col("p") / F.col("share")).alias("least")
    )
    out = [(0.0, 0.0)] * len(exponents)
    for r in rates.collect():  # one row for each exponent
        repeats = r.most / r.least if budget is None else budget * r.most / r.z
        out[r.i] = (math.log(r.z) - r.a * r.plog / r.z, repeats)
    return out


def find_exponent(
    shares: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None, steps: int = 6, fan: int = 32
) -> float:
    """The flattest mixture, that is the smallest exponent from 0 to 1, with at most the target entropy and at most
    max_repeats passes over any source. Both fall as the exponent grows, so the range is cut again and again, `fan` ways
    at a time, each in one job over the sources. 1 if no exponent meets the limits."""
    low, high = 0.0, 1.0
    for step in range(steps):
        grid = [low + (high - low) * k / fan for k in range(fan + 1)]
        fits = [
            (target_entropy is None or h <= target_entropy + 1e-12) and (max_repeats is None or r <= max_repeats * (1 + 1e-12))
            for h, r in _measures(shares, grid, budget)
        ]
        if fits[0]:
            return grid[0] if step == 0 else low
        first = next((k for k, yes in enumerate(fits) if yes), None)
        if first is None:
            return 1.0
        low, high = grid[first - 1], grid[first]
    return high


def mixture(
    sizes: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = 1.5,
    budget: int | None = None,
) -> DataFrame:
    """(source, tokens, weight, source_budget) from rows (source, tokens): weight is share ** exponent, normalised.

    The exponent meets the target entropy (in nats) and the repetition limit. `budget` is the tokens to be emitted;
    without one it is the least that passes over every source once. source_budget is the weight's part of it, in whole
    tokens. A source without tokens has weight 0."""
    sizes = stored(sizes, "sizes")
    full = sizes.where("tokens > 0")
    total = full.agg(F.sum("tokens")).first()[0] or 0
    shares = full.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    a = find_exponent(shares, target_entropy, max_repeats, None if budget is None else budget / max(1, total)) if total else 1.0
    z, most = shares.agg(F.sum(F.pow("share", F.lit(a))), F.max(F.col("share") / F.pow("share", F.lit(a)))).first()
    if budget is None:
        budget = math.ceil(total * (most or 0) * (z or 0) - 1e-6)
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    least = F.lit(0)
    return sizes.withColumn("weight", weight).withColumn("source_budget", F.greatest(F.round(F.col("weight") * budget), least).cast("long"))


def mix_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    n_tokens: Column | None = None,
    seed: int = 0,
    block_tokens: int = BLOCK_TOKENS,
    **limits,
) -> DataFrame:
    """Which documents are emitted, how often and in what order: doc_id, h, source, n_tokens, copies, epoch, block,
    start, weight, at.

    A source's budget is passed in epochs. Each whole epoch has all its documents, the last one as many as still fit:
    those that start before the budget ends. An epoch is a permutation of its own: a keyed hash deals its documents into
    blocks of about block_tokens tokens and orders them within their block. `start` counts the source's tokens before
    the document in this epoch; it is a sum over whole blocks and a window over one block, so that no source is one
    task. `at` (0 to 1) is the part of the source's budget before the document: ordering by it interleaves all sources
    at their weights throughout.

    Rows equal in doc_id, text and source are one entry with `copies` rows, emitted together; h is the text's hash. A null
    source is a source of its own. A document without tokens is in its source's first epoch. An empty table gives an
    empty result.
    """
    tokens = count_tokens(F.col(f"`{text}`")) if n_tokens is None else n_tokens
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("h"), F.col(f"`{source}`").alias("source"), tokens.alias("n_tokens"))
    rows = stored(rows.groupBy("doc_id", "h", "source", "n_tokens").agg(F.count("*").alias("copies")), "token-counts")
    weights = mixture(rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")), **limits)
    weights = weights.withColumns({"epochs": F.when(F.col("tokens") > 0, F.floor(F.col("source_budget") / F.col("tokens"))).otherwise(0).cast("int"), "blocks": F.ceil((F.col("tokens") + 1) / block_tokens)})
    weights = weights.withColumn("rest", F.col("source_budget") - F.col("epochs") * F.col("tokens")).withColumnRenamed("source", "w_source")
    rows = rows.join(weights, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
    last = F.when((F.col("rest") > 0) | (F.col("epochs") == 0), F.col("epochs")).otherwise(F.col("epochs") - 1)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), last.cast("int")))).withColumn("draw", F.xxhash64(F.lit(seed), "epoch", "doc_id", "h"))
    rows = stored(rows.withColumn("block", F.pmod("draw", F.col("blocks"))), "draws")

    block = ["source", "epoch", "block"]
    sums = rows.groupBy(*block).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("sum"))
    earlier = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"b_{c}") for c in block], F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*block).orderBy("draw", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")).over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("epoch") == F.col("b_epoch")) & (F.col("block") == F.col("b_block"))
    rows = rows.join(sums, same).withColumn("start", F.col("before") + F.col("inside"))
    rows = rows.where((F.col("epoch") < F.col("epochs")) | (F.col("start") < F.col("rest")) | ((F.col("epoch") == 0) & (F.col("n_tokens") == 0)))
    at = (F.col("start") + F.col("epoch") * F.col("tokens")) / F.greatest(F.col("source_budget"), F.lit(1))
    return rows.select("doc_id", "h", "source", "n_tokens", "copies", "epoch", "block", "start", "weight", at.alias("at"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs, each row as often as the plan emits it, and epoch and at (where docs has such columns, the names with
    underscores before them). Partitions, and the rows in each, are in the order of the mixture, so that files written
    from them are. Texts are shuffled twice, to meet the plan and to their places. Odd rows as in mix_plan."""
    epoch, at, h, p_id, p_h, p_source = spare(docs, "epoch", "at", "h", "p_id", "p_h", "p_source")
    plan = mix_plan(docs, doc_id, text, source, **options)
    plan = plan.select(F.col("doc_id").alias(p_id), F.col("h").alias(p_h), F.col("source").alias(p_source), F.col("epoch").alias(epoch), F.col("at").alias(at))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(p_id)) & (F.col(h) == F.col(p_h)) & F.col(f"`{source}`").eqNullSafe(F.col(p_source))
    rows = docs.withColumn(h, F.xxhash64(f"`{text}`")).join(plan, same).select(*[f"`{c}`" for c in docs.columns], epoch, at)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(at) * n).cast("int")))
    return rows.repartitionById(n, part).sortWithinPartitions(at, f"`{doc_id}`", epoch)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: one row for each emitted document: every document at least once, no source over 1.5 times."""
    plan = mix_plan(read(spark, sf_dir, "documents"), max_repeats=1.5)
    rows = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select("doc_id", "source", "n_tokens", "epoch", "block", "start", F.round("weight", 9).alias("weight"))
