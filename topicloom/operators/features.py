"""Document features: TF-IDF, embeddings, scaling, SIF vectors, and the library-backed reducers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, CountVectorizer, Word2Vec
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from topicloom.functions import vectors as vx
from topicloom.operators.hotjoin import above, join_apart
from topicloom.operators.tokens import JOINT
from topicloom.session import materialize

BLOCK_TEXTS, BLOCK_LINES = 1 << 13, 1 << 21  # texts, or words of texts, that meet their vectors in one block
TEXTS_AT_ONCE, LINES_AT_ONCE = 1 << 11, 1 << 16


def tf_idf(counts: DataFrame, uid: str, documents: int) -> DataFrame:
    """L2-normalized ``n * (ln((1+N)/(1+df)) + 1)`` of (uid, term, n), in long form."""
    counts = materialize(counts, "counts")
    df_ = materialize(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    # Written once: its rows give both the lengths and the weights. A term of every document fills no task.
    weighted = materialize(join_apart(counts, df_, ["term"], above(df_, "df")).select(
        uid, "term", (F.col("n") * (F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1)).alias("w")), "weighted")
    length = weighted.groupBy(uid).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return weighted.join(length, uid).select(uid, "term", (F.col("w") / F.col("length")).alias("weight"))


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """Bag-of-words vector of ``dim`` buckets, unit length, null without tokens.

    The bucket is taken from the MD5 of the token, so any engine gives the same vector. This is the
    encoder that needs no model; ``encode`` hosts a real one.
    """
    buckets = F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("int"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def counted(rows: pd.Series) -> pd.Series:
        sizes = np.array([0 if r is None else len(r) for r in rows], dtype=np.int64)
        out = pd.Series([None] * len(rows), dtype=object)
        if sizes.sum():
            place = np.repeat(np.arange(len(rows)), sizes) * dim + np.concatenate([r for r, n in zip(rows, sizes) if n])
            counts = np.bincount(place, minlength=len(rows) * dim).reshape(len(rows), dim).astype(float)
            full = np.flatnonzero(sizes)
            unit = counts[full] / np.sqrt((counts[full] ** 2).sum(axis=1, keepdims=True))
            for i, v in zip(full, unit):
                out[i] = v
        return out

    return counted(buckets)


def encode(df: DataFrame, text: str, make_model: Callable[[], Callable], out: str = "embedding", batch_size: int = 32) -> DataFrame:
    """Batch inference: ``make_model`` is called once per worker and returns ``texts -> matrix``."""
    fn = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, fn(F.col(text)))


def _escaped(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("\x1e"), F.lit("\x1eA")), F.lit(JOINT), F.lit("\x1eB"))


def _meet_in_blocks(rows: DataFrame, uid: list[str], terms: Column, lines: Callable, words: DataFrame, dim: int, how: str, rows_at_once: int) -> DataFrame:
    """(uid, embedding) of ``rows`` (_block, uid, ...), by mean or max over the vectors of their words.

    A vector goes once to every block of rows that holds its word, and the rows go there once; what is shuffled of vectors grows with the words of a
    block, not with the words of every document. ``lines`` takes a table of some rows and gives the row, word, weight and count of every line in it.
    """
    fold = F.max if how == "max" else F.sum
    # A word with several vectors counts with each of them. Vectors may hold nulls, which are skipped.
    known = words.where(F.col("word").isNotNull()).groupBy(_escaped(F.col("word")).alias("_word")).agg(
        F.array(*[fold(F.col("vector")[i].cast("double")) for i in range(dim)]).alias("_v"), F.count(F.lit(1)).cast("double").alias("_c"))
    asked = rows.select("_block", F.explode(terms).alias("_word")).distinct()
    # Both sides read the same table; new column identities keep them apart in the co-group.
    vectors = asked.join(known, "_word").select(*[F.col(c).alias(c) for c in ("_block", "_word", "_v", "_c")])
    ids = rows.select(*uid).schema
    schema = T.StructType([*ids.fields, T.StructField("_sum", T.ArrayType(T.DoubleType())), T.StructField("_n", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    merge = np.maximum if how == "max" else np.add
    none = -np.inf if how == "max" else 0.0

    def pooled(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [arrow.empty_table()]
        held = right["_word"].combine_chunks()
        flat = right["_v"].combine_chunks().flatten()
        matrix = pc.fill_null(flat, none).to_numpy(zero_copy_only=False).reshape(-1, dim)
        given = pc.is_valid(flat).to_numpy(zero_copy_only=False).reshape(-1, dim)
        whole, times = bool(given.all()), right["_c"].to_numpy()
        for at in range(0, left.num_rows if right.num_rows else 0, rows_at_once):
            some = left.slice(at, rows_at_once).combine_chunks()
            row, term, weight, n = lines(some)
            place = pc.fill_null(pc.index_in(term, held), -1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(place >= 0)
            if not len(hit):
                continue
            # Rows of the same id are one; ids are compared as Arrow compares them, nulls included.
            code = np.zeros(some.num_rows, np.int64)
            for c in uid:
                part = some[c].combine_chunks().dictionary_encode(null_encoding="encode")
                code = np.unique(code * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
            group = code[row[hit]]
            order = hit[np.argsort(group, kind="stable")]
            group = code[row[order]]
            start = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
            place = place[order]
            sums, seen = np.empty((len(start), dim)), np.ones((len(start), dim), bool)
            ends, first = np.r_[start[1:], len(order)], 0
            while first < len(start):  # some groups at a time
                last = max(first + 1, int(np.searchsorted(ends, start[first] + LINES_AT_ONCE)))
                lot, cut = slice(start[first], ends[last - 1]), start[first:last] - start[first]
                values = matrix[place[lot]] if how == "max" else matrix[place[lot]] * weight[order[lot], None]
                sums[first:last] = merge.reduceat(values, cut, axis=0)
                if not whole:
                    seen[first:last] = np.logical_or.reduceat(given[place[lot]], cut, axis=0)
                first = last
            found = pa.ListArray.from_arrays(
                pa.array(np.arange(len(start) + 1) * dim, pa.int32()), pa.array(sums.ravel(), pa.float64(), mask=None if whole else ~seen.ravel()))
            counted = pa.array(np.add.reduceat(n[order] * times[place], start))
            of = pa.array(row[order[start]])
            out.append(pa.Table.from_arrays([*[some[c].combine_chunks().take(of) for c in uid], found, counted], names=arrow.names).cast(arrow))
        return pa.concat_tables(out)

    parts = rows.groupBy("_block").cogroup(vectors.groupBy("_block")).applyInArrow(pooled, schema)
    folded = [fold(F.col("_sum")[i]) for i in range(dim)]
    total = F.sum("_n")
    return parts.groupBy(*uid).agg(F.array(*(folded if how == "max" else [x / total for x in folded])).alias("embedding"))


def _blocks(rows: int, spark: SparkSession, size: int) -> int:
    """How many blocks rows are dealt to: of at most ``size`` rows on average, smaller if cores else had none."""
    return max(1, -(-rows // size), min(spark.sparkContext.defaultParallelism, -(-rows * 8 // size)))


def pool_tokens(df: DataFrame, uid: str, tokens: Column, words: DataFrame, dim: int, how: str = "mean") -> DataFrame:
    """Pool the vectors of a document's tokens by ``mean`` or ``max``. Tokens without a vector are skipped."""
    if how not in ("mean", "max"):
        raise ValueError("how must be mean or max")

    def joined(t: Column) -> Column:
        odd = F.array_join(t, "").rlike("[\x1e\x1f]")
        return F.when(F.size(t) > 0, F.array_join(F.when(odd, F.transform(t, _escaped)).otherwise(t), JOINT))

    blocks = _blocks(df.select(uid).count(), df.sparkSession, BLOCK_TEXTS)
    rows = df.select(F.col(uid), vx.let(F.array_compact(tokens), joined).alias("_text")).where(F.col("_text").isNotNull())
    rows = materialize(rows.withColumn("_block", F.pmod(F.xxhash64(uid, "_text"), F.lit(blocks)).cast("int")).repartition("_block"), "dealt")

    def lines(some: pa.Table) -> tuple:
        split = pc.split_pattern(some["_text"].combine_chunks(), JOINT)
        row = np.repeat(np.arange(some.num_rows), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        one = np.ones(len(row))
        return row, split.flatten(), one, one

    return _meet_in_blocks(rows, [uid], F.split("_text", JOINT), lines, words, dim, how, TEXTS_AT_ONCE)


def standardize(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Zero mean and unit population deviation per dimension; a constant dimension becomes 0."""
    stats = df.agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dim)],
                   *[F.stddev_pop(F.col(vector)[i].cast("double")).alias(f"s{i}") for i in range(dim)]).first()
    mean = F.array(*[F.lit(stats[f"m{i}"]) for i in range(dim)])
    std = F.array(*[F.lit(stats[f"s{i}"] or 1.0) for i in range(dim)])
    centered = F.zip_with(F.col(vector), mean, lambda v, m: v.cast("double") - m)
    return df.withColumn(vector, F.zip_with(centered, std, lambda v, s: v / s))


def fit_pca(df: DataFrame, vector: str, k: int):
    """PCA model and the mean of each dimension, which Spark's own transform does not subtract."""
    rows = df.select(array_to_vector(F.col(vector)).alias("v"))
    mean = rows.agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"]
    return PCA(k=k, inputCol="v", outputCol="reduced").fit(rows), [float(x) for x in mean]


def reduce_pca(df: DataFrame, vector: str, fitted, out: str = "reduced") -> DataFrame:
    """Apply a fitted reducer. The sign of each axis makes its largest loading positive."""
    model, mean = fitted
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(loadings.shape[1])]
    centered = F.zip_with(F.col(vector), F.array(*[F.lit(x) for x in mean]), lambda v, m: v.cast("double") - m)
    reduced = model.setInputCol("_pca_in").setOutputCol("_pca_out").transform(df.withColumn("_pca_in", array_to_vector(centered)))
    signed = F.zip_with(vector_to_array("_pca_out"), F.array(*[F.lit(s) for s in signs]), lambda v, s: v * s)
    return reduced.withColumn(out, signed).drop("_pca_in", "_pca_out")


def save_reducer(fitted, path: str) -> None:
    """Store a fitted reducer for later jobs."""
    model, mean = fitted
    model.write().overwrite().save(f"{path}/model")
    from pyspark.sql import SparkSession

    SparkSession.active().createDataFrame([(mean,)], "mean array<double>").write.mode("overwrite").parquet(f"{path}/mean")


def load_reducer(path: str):
    from pyspark.ml.feature import PCAModel
    from pyspark.sql import SparkSession

    return PCAModel.load(f"{path}/model"), SparkSession.active().read.parquet(f"{path}/mean").first()["mean"]


def word_vectors(df: DataFrame, tokens: str, dim: int = 32, min_count: int = 5, epochs: int = 15, parts: int | None = None, seed: int = 1) -> DataFrame:
    """Train word vectors on a token column: (word, vector). Trained in ``parts`` tasks, by default one per core of the session."""
    parts = parts or df.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(vectorSize=dim, minCount=min_count, maxIter=epochs, numPartitions=parts, seed=seed,
                     inputCol=tokens, outputCol="_v").fit(df.select(tokens))
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def topic_model(df: DataFrame, tokens: str, k: int = 250, passes: int = 10, terms: int = 10, min_df: int = 2, seed: int = 1) -> DataFrame:
    """LDA over bags of words: (topic, rank, term, weight)."""
    terms_seen = df.select(F.explode(tokens).alias("term")).agg(F.count_distinct("term")).first()[0]
    bags = CountVectorizer(inputCol=tokens, outputCol="bag", minDF=min_df, vocabSize=max(1, terms_seen)).fit(df)
    model = LDA(k=k, maxIter=passes, featuresCol="bag", seed=seed).fit(bags.transform(df.select(tokens)))
    described = model.describeTopics(terms).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t")
    ).select("topic", (F.col("pos") + 1).alias("rank"), F.col("t.termIndices").alias("index"), F.col("t.termWeights").alias("weight"))
    # The fitted model holds its vocabulary on the driver; only the words that describe a topic go back.
    used = sorted({r["index"] for r in described.select("index").distinct().collect()})
    words = df.sparkSession.createDataFrame([(i, bags.vocabulary[i]) for i in used], "index int, term string")
    return described.join(words, "index").select("topic", "rank", "term", "weight")


def sif_vectors(counts: DataFrame, uid: list[str], words: DataFrame, dim: int, a: float = 0.001, frequency: DataFrame | None = None) -> DataFrame:
    """Smooth-inverse-frequency vectors of (uid, term, n): sum of ``a/(a+count) * vector`` over tokens / tokens.

    ``frequency`` (keys, term, total) gives the counts to use when they reach beyond one text, as
    for a pair of texts; otherwise the counts of the text itself are used.
    """
    counts = materialize(counts, "counts")
    blocks = _blocks(counts.count(), counts.sparkSession, BLOCK_LINES)
    frequency_free = frequency is None
    if not frequency_free:
        keys = [c for c in frequency.columns if c != "total"]
        counts = counts.join(frequency, keys)
    rows = counts.where(F.col("term").isNotNull()).select(
        F.pmod(F.xxhash64(*uid), F.lit(blocks)).cast("int").alias("_block"), *uid, _escaped(F.col("term")).alias("_text"),
        F.col("n").alias("_count"), *([] if frequency_free else [F.col("total").alias("_total")]))

    def lines(some: pa.Table) -> tuple:
        n = some["_count"].to_numpy().astype(float)
        total = n if frequency_free else some["_total"].to_numpy().astype(float)
        return np.arange(some.num_rows), some["_text"].combine_chunks(), n * (a / (a + total)), n

    return _meet_in_blocks(rows, uid, F.array("_text"), lines, words, dim, "mean", 1 << 30).withColumnRenamed("embedding", "sif")


def training_pairs(df: DataFrame, uid: str, a: Column, b: Column, test_share: int = 20, seed: int = 1) -> DataFrame:
    """Pairs of two cleaned titles, both longer than 3, label 1.0, split by a hash of the id.

    A hash split is stable: the same pair falls on the same side in every run and on every cluster.
    """
    bucket = F.conv(F.substring(F.md5(F.concat(F.col(uid).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") % 100
    return (
        df.select(uid, a.alias("headline"), b.alias("seo_title"))
        .where((F.length("headline") > 3) & (F.length("seo_title") > 3))
        .select(uid, "headline", "seo_title", F.lit(1.0).alias("label"),
                F.when(bucket < test_share, "test").otherwise("train").alias("part"))
    )
