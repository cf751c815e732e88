"""Mixing sources to target weights by temperature, in blocks, with DataFrame functions only.

Token shares p are raised to an exponent a and normalised: w = p**a / sum(p**a). The exponent 1 keeps the shares, 0 makes
all sources equal. It is searched in [0, 1] by bisection, either for a target entropy or for a repetition limit. The weights are
then realised: each source is cut into blocks by a hash of the document, an epoch is a permutation of its blocks, and the
source's share of the budget is filled with whole epochs and the first blocks of one more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from procurisk.llm import shared

#: Tokens of a block; a source has at most FINE_BLOCKS (a power of two) of them, so the largest sources have larger ones.
BLOCK_TOKENS = 20_000
FINE_BLOCKS = 4096
#: Epochs of the most repeated source over those of the least repeated one, at most.
REPETITION_LIMIT = 2.0
#: Each round of the bisection tries so many parts of the interval at once; the exponent is found to 32**-6.
SECTIONS, ROUNDS = 32, 6
#: Weights are rounded to so many parts, so that they do not hinge on the order of additions.
PARTS = 1_000_000


def n_tokens(text: Column | str) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_name() -> Column:
    """A null source is the source named ''."""
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def fine_block() -> Column:
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") % FINE_BLOCKS


def exponent(totals: DataFrame, repetition_limit: float | None = None, entropy: float | None = None) -> float:
    """The exponent for one row per source with its ``tokens``; sources without tokens have no say.

    With ``entropy`` (nats): the largest exponent whose weights have at least that entropy, 0 if none has. With ``repetition_limit``:
    the least one that keeps epochs within it. Epochs are as w/p = p**(a - 1), so their extremes are those of p. The sums for all
    exponents of a round are one aggregation over the sources; the driver sees a few numbers however many sources there are.
    """
    shares = totals.where("tokens > 0").select(F.log("tokens").alias("x"))
    ends = shares.agg(F.max("x").alias("most"), F.min("x").alias("least")).first()
    if ends is None or ends["most"] is None:
        return 1.0
    low, high = 0.0, 1.0

    def within(tried: list[float]) -> list[bool]:
        if entropy is None:
            return [(ends["most"] - ends["least"]) * (1 - a) > math.log(repetition_limit or 1.0) for a in tried]
        # relative to the largest source, so that nothing overflows
        y = F.col("x") - ends["most"]
        sums = [F.sum(F.exp(y * a)).alias(f"z{i}") for i, a in enumerate(tried)]
        sums += [F.sum(F.exp(y * a) * y * a).alias(f"s{i}") for i, a in enumerate(tried)]
        row = shares.agg(*sums).first()
        return [math.log(row[f"z{i}"]) - row[f"s{i}"] / row[f"z{i}"] >= entropy for i in range(len(tried))]

    for _ in range(ROUNDS):
        tried = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        passed = sum(within(tried))
        low, high = [low, *tried][passed], [*tried, high][passed]
    if entropy is None:
        return 0.0 if not within([0.0])[0] else high
    return 1.0 if within([1.0])[0] else low


def weights(totals: DataFrame, alpha: float, budget: int | None) -> DataFrame:
    """Per source: tokens, parts (its weight in millionths), quota (tokens of the budget), epochs (whole ones), rest.

    Without a budget the smallest is taken that gives every source a whole epoch, so nothing is left out. A source without tokens has
    no weight and passes once.
    """
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(0.0)
    whole = totals.agg(F.sum(power)).first()[0] or 1.0
    parts = F.greatest(F.round(PARTS * power / F.lit(whole)), F.lit(1.0)).cast("long")
    shares = totals.select("source", "tokens", F.when(F.col("tokens") > 0, parts).otherwise(0).alias("parts"))
    size = float(budget or 0)
    if budget is None:
        need = F.max(F.col("tokens").cast("double") * PARTS / F.col("parts"))
        size = shares.where("tokens > 0").agg(need).first()[0] or 0.0
    quota = F.floor(F.lit(size) * F.col("parts") / PARTS + 0.5).cast("long")
    if budget is None:
        quota = F.greatest(F.col("tokens"), quota)
    epochs = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(1)
    cuts = F.ceil(F.log2(F.greatest(F.lit(1.0), F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("double"))))
    return (
        shares.withColumn("quota", quota)
        .withColumn("epochs", epochs.cast("long"))
        .withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
        .withColumn("blocks", F.least(F.lit(FINE_BLOCKS), F.pow(F.lit(2.0), cuts)).cast("long"))
        .select("source", "tokens", "parts", "quota", "epochs", "rest", "blocks")
    )


def plan(docs: DataFrame, repetition_limit: float | None, entropy: float | None, budget: int | None) -> DataFrame:
    """The block permutations: source, block, blocks, epoch, progress (millionths of the source's quota before the block).

    The texts are read once, for tokens per source and fine block (at most ``FINE_BLOCKS`` rows a source, stored); all later steps
    see that table only. A window sorts the blocks of one epoch of one source.
    """
    counted = docs.select(source_name().alias("source"), fine_block().alias("fine"), n_tokens("text").alias("n"))
    fine = shared.stored(counted.groupBy("source", "fine").agg(F.sum("n").alias("n")), "mixing")
    totals = shared.stored(fine.groupBy("source").agg(F.sum("n").alias("tokens")), "mixing-sources")
    per_source = weights(totals, exponent(totals, repetition_limit, entropy), budget)
    blocks = (
        fine.join(per_source, "source")
        .groupBy("source", (F.col("fine") % F.col("blocks")).alias("block"), "blocks", "tokens", "quota", "epochs", "rest")
        .agg(F.sum("n").alias("n"))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))))
    )
    name = F.concat_ws("|", "source", F.col("epoch").cast("string"), F.col("block").cast("string"))
    order = Window.partitionBy("source", "epoch").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.sum("n").over(order)
    before = (F.col("epoch") * F.col("tokens") + F.col("passed") - F.col("n")).cast("double")
    return (
        blocks.withColumn("turn", F.md5(name.cast("binary")))
        .withColumn("passed", passed)
        .where("epoch < epochs OR passed <= rest AND tokens > 0")
        .withColumn("progress", F.when(F.col("quota") > 0, F.floor(before * PARTS / F.col("quota"))).otherwise(0).cast("long"))
        .select("source", "block", "blocks", "epoch", "progress")
    )


def mix(
    docs: DataFrame,
    repetition_limit: float | None = REPETITION_LIMIT,
    entropy: float | None = None,
    budget: int | None = None,
) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with mix_epoch, mix_block and mix_progress added.

    Sorting by mix_progress gives the mixture's order. Needs doc_id, source and text; other columns pass through, but for
    earlier ones of the three names, which are replaced. Null text has no
    tokens, a null source counts as '', null ids share a block; repeated rows are repeated, an empty table stays empty. Rows meet
    the plan on (source, block): a block is at most about 1/4096 of its source or ``BLOCK_TOKENS``, so no key is hot.
    """
    docs = docs.drop("mix_epoch", "mix_block", "mix_progress")
    name, fine = (shared.free_name(docs, x) for x in ("mix_source", "mix_fine"))
    # a block in its fine blocks, so that rows find it by (source, fine block) without knowing how their source is cut
    chosen = plan(docs, repetition_limit, entropy, budget).select(
        F.col("source").alias(name),
        F.explode(F.sequence("block", F.lit(FINE_BLOCKS - 1).cast("long"), "blocks")).alias(fine),
        F.col("epoch").alias("mix_epoch"),
        F.col("block").alias("mix_block"),
        F.col("progress").alias("mix_progress"),
    )
    placed = docs.withColumns({name: source_name(), fine: fine_block()})
    return placed.join(chosen, [name, fine]).select(*docs.columns, "mix_epoch", "mix_block", "mix_progress")
