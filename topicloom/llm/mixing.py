"""Mix sources to target weights: a splitting tree deals exact block quotas to output shards.

The order of work:

1. Every source gets a target of words: ``share`` of all words, split by weight, with at most ``most`` times the source's
   size; what a source cannot give is shared again by weight among the others.
2. A source is read as many whole times as its target allows. The rest comes from its documents in a permuted order (by
   hash); the document on the border gives only its first words, so that a source gives its rounded target exactly.
   The border is found by radix: two levels of 4096 hash ranges per source and one last sort inside one range, so no
   task ever orders a whole source.
3. Every draw of a document falls into one of its source's blocks by hash. The blocks of all sources go down a binary tree
   of shard ranges: at each node the left half draws its capacity from the node's blocks without replacement, so that
   its counts by source are multivariate hypergeometric. Every block lands in one shard and every shard is full.
4. ``slot`` is a draw's place in its shard's own shuffle.

Only tables of one row per source, or of one row per block, are ordered as a whole; their sizes are ``sources`` and about
``shards * blocks_per_shard`` rows, whatever the corpus holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.llm.common import count_words, pick, salted_join, unpacked, with_row, words_of
from topicloom.session import materialize


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """(source, rank, source_size, target, want): words each source shall give. Sources by code point, null last."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by_need = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
        .withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(W.partitionBy()))
        .withColumn("used", F.sum("cap").over(by_need) - F.col("cap"))
        .withColumn("left", F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("used")) / F.col("left"))
    )
    # The first source whose own cap holds the level reached without the sources before it.
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))
    return (
        sources.withColumn("_level", F.min(holds).over(W.partitionBy())["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("_level") * F.col("weight")))
        .select("source", "rank", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("want"))
    )


def _border(found: DataFrame, sums: DataFrame, name: str) -> DataFrame:
    """Per source, the hash range in which the wanted words run out: adds ``name`` and takes the words before it off ``rest``."""
    before = F.sum("words").over(W.partitionBy("rank").orderBy(name)) - F.col("words")
    at = sums.withColumn("before", before).join(F.broadcast(found.select("rank", "rest")), "rank")
    at = at.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
    return found.join(at.select("rank", name, "before"), "rank", "left").withColumn("rest", F.col("rest") - F.col("before")).drop("before")


def plan_copies(docs: DataFrame, weights: Sequence[float], share: float, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Draws per document, and the sources. ``docs``: (row_id, doc_id, source, size), stored.

    Returns (row_id, doc_id, source, size, rank, source_size, target, copies, part): whole ``copies`` and then the first
    ``part`` words.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    sources = materialize(source_targets(docs, weights, share, most), "sources")
    full = F.when(F.col("source_size") > 0, F.expr("want div source_size")).otherwise(F.lit(0).cast("long"))
    sources = sources.withColumn("copies", full).withColumn("rest", F.col("want") - F.col("copies") * F.col("source_size"))
    keyed = salted_join(docs, sources, "source", F.col("row_id")).withColumn("key", key)
    keyed = keyed.withColumn("p1", F.substring("key", 1, 3)).withColumn("p2", F.substring("key", 4, 3))

    border = sources.select("rank", "rest")
    border = materialize(_border(border, keyed.groupBy("rank", "p1").agg(F.sum("size").alias("words")), "p1"), "border")
    near = keyed.join(F.broadcast(border.select("rank", "p1")), ["rank", "p1"], "left_semi")
    border = materialize(_border(border, near.groupBy("rank", "p2").agg(F.sum("size").alias("words")), "p2"), "border")
    near = keyed.join(F.broadcast(border.select("rank", "p1", "p2")), ["rank", "p1", "p2"], "left_semi")
    near = near.select("rank", F.struct("key", "size", "row_id").alias("at"), F.col("size").alias("words"))
    border = materialize(_border(border, near, "at").select("rank", F.col("at").alias("last"), F.col("rest").alias("last_part")), "border")

    at = F.struct("key", "size", "row_id")
    part = F.when(at < F.col("last"), F.col("size")).when(at == F.col("last"), F.col("last_part")).otherwise(F.lit(0).cast("long"))
    part = F.when(F.col("last").isNull(), F.lit(0).cast("long")).otherwise(part)
    drawn = salted_join(keyed.drop("p1", "p2", "rest", "want"), border, "rank", F.col("row_id")).withColumn("part", part)
    return drawn.drop("key", "last", "last_part"), sources


def deal_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, block, shard): every block of every source in one shard. ``quotas``: (rank, blocks), one row per source.

    A node of the tree is a range of shards with the blocks it holds. Its left half draws its capacity from them in a permuted
    order, without replacement, so the counts by source are multivariate hypergeometric; the right half keeps the others.
    """
    nodes = quotas.where("blocks > 0").select("rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    nodes = nodes.withColumn("all", F.count(F.lit(1)).over(W.partitionBy()))
    nodes = nodes.withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(shards).cast("long"))

    def edge(c: str) -> Column:
        return F.expr(f"all * {c} div {shards}")

    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        order = W.partitionBy("low", "high").orderBy(F.xxhash64(F.lit(seed), F.lit(level), "rank", "block"), "rank", "block")
        nodes = nodes.withColumn("mid", F.expr("(low + high) div 2")).withColumn("place", F.row_number().over(order))
        goes_left = F.col("place") <= edge("mid") - edge("low")
        inner = F.col("high") - F.col("low") > 1
        nodes = nodes.select(
            "rank", "block", "all", F.when(inner & ~goes_left, F.col("mid")).otherwise(F.col("low")).alias("low"),
            F.when(inner & goes_left, F.col("mid")).otherwise(F.col("high")).alias("high"))
    return nodes.select("rank", "block", F.col("low").cast("int").alias("shard"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, shards: int = 64, blocks_per_shard: int = 64,
    seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep_text: bool = False,
) -> DataFrame:
    """One row per draw, and one with ``shard`` null for a document that is not drawn.

    Columns: row_id, doc_id, source, size, source_size, target, copy, words, shard, slot; with ``keep_text`` also the
    document's row as the struct ``doc``. Rows of a shard in the order of ``slot`` are its mixture.

    Nulls: a null text has size 0 and is never drawn; null sources form a source of their own, after the others; a null id is an
    id. Repeated rows are documents of their own; ties in the permuted order go by size. An empty table gives no rows. Other
    columns are ignored, or kept in ``doc``. The same input gives the same draws.
    """
    columns = {"doc_id": id_col, "source": source_col, "text": text_col}
    base = with_row(docs, **columns) if keep_text else pick(docs, **columns)
    base = base.withColumn("size", count_words(F.col("text"))).drop("text")
    # Stored, so that a row's number stays its own whenever it is read again.
    stored = materialize(base.withColumn("row_id", F.monotonically_increasing_id()), "sizes")
    drawn, sources = plan_copies(stored.drop("doc"), weights, share, most, seed)

    blocks = F.ceil(F.col("want") * shards * blocks_per_shard / F.greatest(F.lit(1), F.sum("want").over(W.partitionBy()))).cast("long")
    quotas = sources.select("rank", blocks.alias("blocks"))
    deal = materialize(deal_blocks(quotas, shards, seed), "deal")

    words = F.concat(F.array_repeat(F.col("size"), F.col("copies").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>")))
    words = F.when(F.col("size") > 0, words).otherwise(F.array().cast("array<long>"))
    draws = salted_join(drawn, quotas.withColumnRenamed("blocks", "n_blocks"), "rank", F.col("row_id"))
    draws = draws.select("row_id", "doc_id", "source", "size", "source_size", "target", "rank", "n_blocks", F.posexplode_outer(words).alias("copy", "words"))
    slot = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy")
    draws = draws.withColumn("slot", slot).withColumn("block", F.when(F.col("copy").isNotNull(), F.pmod(F.xxhash64("slot"), "n_blocks")))
    mixed = draws.join(deal, ["rank", "block"], "left").drop("rank", "block", "n_blocks")
    return mixed.join(stored.select("row_id", "doc"), "row_id") if keep_text else mixed


def shuffled(mixed: DataFrame, shards: int = 64) -> DataFrame:
    """The draws dealt to ``shards`` tasks by shard, each shard shuffled on its own."""
    return mixed.where("shard is not null").repartition(shards, "shard").sortWithinPartitions("shard", "slot", "row_id", "copy")


def taken_words(mixed: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document: words the mixture takes of it, repeats counted."""
    same = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    return mixed.groupBy("row_id").agg(*same, F.coalesce(F.sum(F.when(F.col("shard").isNotNull(), F.col("words"))), F.lit(0)).alias("taken")).drop("row_id")


def mixture(
    docs: DataFrame, shards: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = None, **options,
) -> DataFrame:
    """The rows of ``docs`` as the mixture takes them, shard by shard and shuffled within each.

    A row drawn twice stands there twice. The one document per source that is taken in part has its first words, joined by
    blanks; ``chars_col`` is kept at the text's length.
    """
    mixed = mix(docs, shards=shards, id_col=id_col, text_col=text_col, source_col=source_col, keep_text=True, **options)
    text = F.col(f"doc._{docs.columns.index(text_col)}")
    cut = F.when(F.col("words") < F.col("size"), F.concat_ws(" ", F.slice(words_of(text), F.lit(1), F.col("words").cast("int")))).otherwise(text)
    changed = {text_col: cut}
    if chars_col:
        changed[chars_col] = F.length(cut).cast(docs.schema[chars_col].dataType)
    return unpacked(shuffled(mixed, shards), docs.columns, **changed)
