"""Collocations of each language by best-first branch-and-bound growth of phrases.

A phrase of two or three words with ``a`` occurrences scores ``a * a / (l * r)`` at a cut into a first part seen ``l`` times and a rest seen
``r`` times; its lowest cut counts. A phrase grows from its prefix, and prefix counts bound what can grow: since ``a <= r`` and a phrase
is seen at most as often as its prefix, neither a pair ``x y`` nor anything grown from it scores above ``f(x y) / f(x)``. The pairs are
the frontier, taken in the order of that bound. Expanding a pair counts all phrases one word longer that contain it: those to the
right are what grows from it, and together with those to the left they decide whether the pair itself is inside a longer phrase seen half as
often. After each round the ``top``-th best score among settled phrases is a floor that can only rise; the search of a language ends when
all its pairs with a bound at or above the floor, ties included, are expanded.

Texts are cut into words in blocks per task: exact words numbered inside the block, their runs counted by array operations, and
partial counts of exact strings keyed by (lang, words) shuffled and summed. One pass counts words and pairs, each round is one more pass
over the texts. What a round looks for is broadcast as a bit map of a bounded size; a phrase that meets it by chance is counted in
full like the others, so chance costs work and changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import pick
from topicloom.session import materialize, spread

#: Fixed by the contract: pieces end at these bytes; words are what is left between blanks and tabs.
PIECE_END = b".,;:!?\n\x0b\x0c\r"
#: Lowers A-Z, makes every end of a piece a full stop and a tab a blank.
PLAIN = bytes(ord(".") if c in PIECE_END else 0x20 if c == 0x09 else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Scores are whole numbers of millionths.
SCALE = 1_000_000
#: Counts up to 10^14 keep every product below 38 digits.
EXACT = "decimal(14,0)"
#: Pairs of a language expanded in the first round, as a multiple of ``top``; each later round takes GROWTH times as many.
FIRST, GROWTH = 4, 8
#: Bytes of text of a block: bounds a worker's memory (about 15 bytes for each).
BLOCK_BYTES = 8 << 20
#: Bits of the map of pairs: 16 for each pair, from 2^20 to 2^26 (8 MB). Past 2^22 pairs more phrases meet it by chance.
BITS_EACH, FEWEST_BITS, MOST_BITS = 16, 20, 26
#: Odd factors below 2^29: sums of two products with 32-bit checksums stay below 2^63 here and in Spark.
LEFT, RIGHT = 0x1E3779B1, 0x15EBCA77


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    """(lang, distinct words, words in order as numbers, number that ends a piece) for runs of texts of one language."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            raw = text.as_py()
            if raw:
                held.setdefault(lang, []).append(raw.translate(PLAIN))
                size += len(raw)
            if size >= BLOCK_BYTES:
                yield from numbered(held)
                held, size = {}, 0
    yield from numbered(held)


def numbered(held: dict[str, list[bytes]]) -> Iterator[tuple[str, list[bytes], np.ndarray, int]]:
    for lang, texts in held.items():
        words = (b"." + b".".join(texts) + b".").replace(b".", b" . ").split()
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        yield lang, list(number), np.fromiter(map(number.__getitem__, words), np.int64, len(words)), number[b"."]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def batch_of(lang: str, columns: list[pa.Array | None], counts: np.ndarray) -> pa.RecordBatch:
    n = len(counts)
    arrays = [pa.nulls(n, pa.string()) if c is None else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), *arrays, pa.array(counts, pa.int64())], ["lang", *"xyz"[: len(columns)], "c"])


def words_and_pairs(texts: DataFrame) -> DataFrame:
    """(lang, x, y, a): how often each word occurs (y null), and each pair of words in a row inside a piece."""

    def run(batches):
        for lang, names, order, end in blocks(batches):
            strings = pa.array(names, pa.binary()).cast(pa.string())
            seen, n = counted(order[order != end])
            yield batch_of(lang, [strings.take(pa.array(seen)), None], n)
            left, right = order[:-1], order[1:]
            inside = (left != end) & (right != end)
            seen, n = counted(left[inside] << 32 | right[inside])
            yield batch_of(lang, [strings.take(pa.array(seen >> 32)), strings.take(pa.array(seen & 0xFFFFFFFF))], n)

    return texts.mapInArrow(run, "lang string, x string, y string, c long").groupBy("lang", "x", "y").agg(F.sum("c").alias("a"))


def map_of(pairs: DataFrame) -> np.ndarray:
    """Bit map of pairs (x, y), lowest bit first; at most one row for each 32 bits comes to the driver."""
    bits = min(max((pairs.count() * BITS_EACH).bit_length(), FEWEST_BITS), MOST_BITS)
    crc = lambda c: F.crc32(F.col(c).cast("binary"))
    place = pairs.select(F.pmod(crc("x") * LEFT + crc("y") * RIGHT, F.lit(1 << bits)).alias("p"))
    words = place.groupBy(F.shiftright("p", 5).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 as int)))").alias("v"))
    out = np.zeros(1 << (bits - 5), np.uint32)
    table = words.toArrow()
    out[table.column("i").to_numpy()] = table.column("v").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def grown(texts: DataFrame, batch: DataFrame, least: int) -> DataFrame:
    """(lang, x, y, z, a): phrases of three words seen ``least`` times or more; all that contain a pair of ``batch`` (lang, x, y) are among them."""
    wanted = texts.sparkSession.sparkContext.broadcast(map_of(batch))

    def run(batches):
        bitmap = np.unpackbits(wanted.value, bitorder="little").view(bool)
        mask = len(bitmap) - 1
        for lang, names, order, end in blocks(batches):
            crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names))[order]
            hit = bitmap[(crc[:-1] * LEFT + crc[1:] * RIGHT) & mask]
            solid = order != end
            at = np.flatnonzero((hit[:-1] | hit[1:]) & solid[:-2] & solid[1:-1] & solid[2:])
            pairs, rank = np.unique(order[at] << 32 | order[at + 1], return_inverse=True)
            seen, n = counted(rank.astype(np.int64) << 32 | order[at + 2])
            strings, first = pa.array(names, pa.binary()).cast(pa.string()), pairs[seen >> 32]
            yield batch_of(lang, [strings.take(pa.array(x)) for x in (first >> 32, first & 0xFFFFFFFF, seen & 0xFFFFFFFF)], n)

    found = texts.mapInArrow(run, "lang string, x string, y string, z string, c long")
    return found.groupBy("lang", "x", "y", "z").agg(F.sum("c").alias("a")).where(F.col("a") >= least)


def millionths(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exactly."""
    return F.expr(f"(cast({a} as {EXACT}) * cast({a} as {EXACT}) * cast({SCALE} as decimal(7,0))) div (cast({left} as {EXACT}) * cast({right} as {EXACT}))")


def mine(
    docs: DataFrame, top: int = 2000, least: int = 10, inside_percent: int = 50, lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best phrases of two or three words per language, best first.

    ``a`` counts all occurrences of the phrase inside pieces, ``l`` and ``r`` those of the two parts of its lowest-scoring cut (the first such),
    ``n`` all words of the language; ``score`` is floor(1000000 a a / (l r)). Phrases seen less than ``least`` times are no candidates, nor are
    those inside a longer candidate seen at least ``inside_percent`` % as often. Ties are broken by ``a``, then by phrase in byte order,
    so results do not depend on the layout. A null text counts as empty, a null language as ``und``; repeated rows count each. An
    empty table, or one without a phrase seen often enough, gives no rows. Other columns are ignored.
    """
    base = pick(docs, lang=lang_col, text=text_col).where(F.col("text").isNotNull())
    texts = spread(base).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    seen = materialize(words_and_pairs(texts).where(F.col("y").isNull() | (F.col("a") >= least)), "seen")
    total = seen.where(F.col("y").isNull()).groupBy("lang").agg(F.sum("a").alias("n"))
    often = materialize(seen.where(F.col("y").isNull() & (F.col("a") >= least)).select("lang", F.col("x").alias("w"), F.col("a").alias("f")), "often")
    f_of = lambda w, name: often.select(F.col("lang"), F.col("w").alias(w), F.col("f").alias(name))
    scored = seen.where(F.col("y").isNotNull()).join(f_of("x", "l"), ["lang", "x"]).join(f_of("y", "r"), ["lang", "y"])
    # a <= l, so the bound needs no wide product; it is at least the pair's own score
    bound = F.expr(f"(cast(a as {EXACT}) * cast({SCALE} as decimal(7,0))) div cast(l as {EXACT})")
    pairs = materialize(scored.select("lang", "x", "y", "a", "l", "r", millionths("a", "l", "r").alias("score"), bound.alias("bound")), "pairs")

    expanded, triples, reach, size = None, None, None, FIRST * top
    while True:
        # the floor of a language: its top-th best settled score, or nothing yet
        left = pairs if reach is None else (
            pairs.join(reach, "lang").where((F.col("bound") < F.col("done_to")) & (F.col("bound") >= F.col("floor"))).drop("done_to", "floor"))
        # the best of the frontier with all ties, so a batch ends between two bounds
        batch = materialize(left.join(value_of(left, "bound", size, "last"), "lang").where(F.col("bound") >= F.col("last")).drop("last"), "batch")
        if batch.isEmpty():
            break
        more = with_cuts(grown(texts, batch.select("x", "y"), least), pairs, often)
        triples = materialize(more if triples is None else triples.unionByName(more).dropDuplicates(["lang", "x", "y", "z"]), "triples")
        expanded = batch if expanded is None else materialize(expanded.unionByName(batch), "expanded")
        done = expanded.groupBy("lang").agg(F.min("bound").alias("done_to"))
        floors = value_of(survivors(expanded, triples, inside_percent), "score", top, "floor")
        reach = materialize(done.join(floors, "lang", "left").select("lang", "done_to", F.coalesce("floor", F.lit(-1)).alias("floor")), "reach")
        size *= GROWTH
    if triples is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = survivors(expanded, triples, inside_percent).withColumn("rank", best.cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def value_of(rows: DataFrame, value: str, k: int, name: str) -> DataFrame:
    """(lang, ``name``): the k-th highest ``value`` of each language, -1 where there are fewer.

    Taken from counts per value; values are millionths, at most 1, so a language has at most SCALE + 1 of them, however many its rows.
    """
    counts = rows.groupBy("lang", value).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc(value)))
    return counts.withColumn("above", above).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("above") >= k, F.col(value))), F.lit(-1)).alias(name))


def with_cuts(triples: DataFrame, pairs: DataFrame, often: DataFrame) -> DataFrame:
    """(lang, x, y, z, a, l, r, score): phrases of three words with their lowest cut."""
    f_of = lambda w, name: often.select(F.col("lang"), F.col("w").alias(w), F.col("f").alias(name))
    pair_of = lambda u, v, name: pairs.select("lang", F.col("x").alias(u), F.col("y").alias(v), F.col("a").alias(name))
    counted = triples.join(f_of("x", "l1"), ["lang", "x"]).join(f_of("z", "r2"), ["lang", "z"]).join(
        pair_of("y", "z", "r1"), ["lang", "y", "z"]).join(pair_of("x", "y", "l2"), ["lang", "x", "y"])
    both = counted.withColumn("s1", millionths("a", "l1", "r1")).withColumn("s2", millionths("a", "l2", "r2"))
    later = F.col("s2") < F.col("s1")
    return both.select(
        "lang", "x", "y", "z", "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.least("s1", "s2").alias("score"))


def survivors(expanded: DataFrame, triples: DataFrame, inside_percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, score): expanded pairs not inside a longer phrase seen often enough, and all phrases of three words."""
    around = triples.select("lang", "x", "y", F.col("a").alias("longer")).unionByName(
        triples.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), F.col("a").alias("longer")))
    most = around.groupBy("lang", "x", "y").agg(F.max("longer").alias("longer"))
    alone = expanded.join(most, ["lang", "x", "y"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    return alone.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", "l", "r", "score").unionByName(
        triples.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", "l", "r", "score"))
