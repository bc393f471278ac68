"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least SHORTEST key characters inside a word, or any value that a secret's name is assigned to, of any
length and with any characters. The forest sees its length and
alphabet, the transitions between its characters, how much of it the corpus's own frequent words cover, whether it stands in a path
or address, and the words around it. It is always trained: on the labelled set shipped with the package (``secretset``), and on a
bounded sample of the corpus's own labelled findings, which together weigh at most as much. Everything runs as Spark
functions and Spark's own forest; texts are split once, and only candidates leave their rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm import secretset
from topicloom.llm.common import WORD, pick, unpacked, with_row, words_of
from topicloom.session import materialize

SHORTEST = 16
CANDIDATE = rf"[A-Za-z0-9+/_\-]{{{SHORTEST},}}={{0,2}}"
#: Words that tell of a secret, and of something that only looks like one.
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|auth|credential|bearer|private|access)"
PLAIN_WORDS = r"(?i)(sha|md5|digest|commit|hash|uuid|checksum|example|sample|dummy|test|order|card|isbn|phone)"
#: A secret's name with an assignment (group 1), and its value (3): between quotes (4 to 6), or up to the next white space (7).
NAMED = SECRET_WORDS + r"""[\w.\-]*["'`]?\]?\s*(?:=>|:=|==?|:)\s*"""
QUOTED = r"""Q(?=[^Q\n]*[^Q\s])([^Q\\\n]*+(?:\\[^\n][^Q\\\n]*+){0,64}+)Q"""
ASSIGNED = rf"""({NAMED})(?!(?:{NAMED.replace("(token", "(?:token")}))({"|".join(QUOTED.replace("Q", q) for q in "\"'`")}|["'`]?([^\s"'`]\S*))"""
#: What closes a sentence, list or bracket after a value without quotes is none of it.
CLOSING = r"""["'`]*[,;.)\]}>]*$"""
MARK = "[SECRET]"

FEATURES = [
    "length", "digit_share", "hex_share", "upper_share", "vowel_share", "class_changes", "case_changes", "repeats", "longest_letters", "distinct_share",
    "covered", "in_path", "in_address", "quoted", "assigned", "secret_word", "plain_word", "words_before",
]


def assigned_values(text: Column) -> Column:
    """(word, candidate) of each value that a secret's name is assigned to; ``word`` is the one it begins in."""
    # A byte before every value tells its word; a text's own such bytes are another then.
    marked = words_of(F.regexp_replace(F.translate(text, "\x01", "\x02"), F.lit(ASSIGNED), F.lit("$1\x01$3")))
    word = F.flatten(F.transform(marked, lambda w, i: F.array_repeat(i, F.regexp_count(w, F.lit("\x01")))))
    *quoted, bare = [F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(group)) for group in (4, 5, 6, 7)]
    value = F.transform(bare, lambda x: F.regexp_replace(x, CLOSING, ""))
    for group in quoted:  # all but one are empty
        value = F.zip_with(value, group, lambda x, y: F.concat(x, y))
    found = F.zip_with(word, value, lambda i, x: F.struct(i.alias("word"), x.alias("candidate")))
    return F.when(F.regexp_like(text, F.lit(ASSIGNED)), F.filter(found, lambda x: x["candidate"] != "")).otherwise(F.array().cast("array<struct<word:int,candidate:string>>"))


def may_hold(text: Column) -> Column:
    """Whether a text has a candidate."""
    return F.regexp_like(text, F.lit(CANDIDATE)) | F.regexp_like(text, F.lit(ASSIGNED))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, word, candidate, holder, before1..before3, after1): a row per candidate; ``word`` counts from 0, ``holder`` is the word it begins in."""
    w = F.col("words")
    placed = F.transform(w, lambda x, i: F.struct(i.alias("word"), x.alias("holder")))
    held = F.filter(placed, lambda x: F.regexp_like(x["holder"], F.lit(CANDIDATE)))
    runs = F.flatten(F.transform(held, lambda x: F.transform(
        F.regexp_extract_all(x["holder"], F.lit(CANDIDATE), F.lit(0)), lambda c: F.struct(x["word"].alias("word"), c.alias("candidate")))))
    base = pick(docs, doc_id=id_col, text=text_col).where(may_hold(F.col("text")))
    rows = base.select("doc_id", words_of(F.col("text")).alias("words"), assigned_values(F.col("text")).alias("values")).withColumn("runs", runs)
    around = {"holder": 0, "before1": -1, "before2": -2, "before3": -3, "after1": 1}
    near = lambda i, d: F.coalesce(F.when(i + d >= 0, F.get(w, i + d)), F.lit(""))
    # Neighbours are taken before the rows are made, so that none carries its whole text. A value that is a run is one candidate.
    found = F.transform(F.concat("runs", F.array_except("values", "runs")), lambda x: F.struct(
        x["word"].alias("word"), x["candidate"].alias("candidate"), *[near(x["word"], d).alias(name) for name, d in around.items()]))
    return rows.select("doc_id", F.explode(found).alias("at")).select("doc_id", "at.*")


def lead_of(holder: Column, candidate: Column) -> Column:
    """What stands before the candidate, or its first word, in its word; where it stands there last."""
    first = F.reverse(F.regexp_substr(candidate, F.lit(WORD)))
    at = F.position(first, F.reverse(holder))
    return F.when(at > 0, F.left(holder, F.length(holder) - at - F.length(first) + 1)).otherwise(F.lit(""))


def is_named(holder: Column, candidate: Column) -> Column:
    """Whether the candidate is assigned to a secret's name."""
    before = F.concat_ws(" ", "before2", "before1", lead_of(holder, candidate))
    return F.regexp_like(before, F.lit(SECRET_WORDS + r"""[\w.\-]*\W*[=:]\W*$"""))


def dictionary(docs: DataFrame, share: float = 1 / 4096, text_col: str = "text") -> DataFrame:
    """(term): letter runs of three or more, lower-cased, in at least ``share`` of all texts (and two); counted over all of them."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))
    texts = pick(docs, text=text_col).where("text is not null")
    least = max(2, int(share * texts.count()))
    return texts.select(F.explode(terms).alias("term")).groupBy("term").count().where(F.col("count") >= least).select("term")


def features(found: DataFrame, terms: DataFrame, *kept: str) -> DataFrame:
    """Adds FEATURES; rows with equal candidates share their coverage."""
    c, holder = F.col("candidate"), F.col("holder")
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}{3,}"), F.lit(0))
    each = found.select("candidate").distinct().withColumn("term", F.explode(runs))
    covered = each.join(terms, "term", "left_semi").groupBy("candidate").agg(F.sum(F.length("term")).alias("covered_letters"))
    before = F.concat_ws(" ", "before3", "before2", "before1", lead_of(holder, c))
    letters = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Za-z]+"), F.lit(0)), lambda x: F.length(x))
    stats = {
        "length": n, "digit_share": share("[0-9]"), "hex_share": share("[0-9A-Fa-f]"), "upper_share": share("[A-Z]"), "vowel_share": share("[AEIOUaeiou]"),
        "class_changes": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"), "case_changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "repeats": share(r"(.)(?=\1)"), "longest_letters": F.coalesce(F.array_max(letters), F.lit(0)) / n,
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n, "covered": F.coalesce("covered_letters", F.lit(0)) / n,
        "in_path": F.regexp_like(holder, F.lit(r"[/\\]")), "in_address": F.regexp_like(holder, F.lit(r"://|@|www\.")),
        "quoted": F.regexp_like(holder, F.lit("[\"'`]")), "assigned": F.regexp_like(before, F.lit(r"[=:]\W*$")),
        "secret_word": F.regexp_like(before, F.lit(SECRET_WORDS)), "plain_word": F.regexp_like(before, F.lit(PLAIN_WORDS)),
        "words_before": F.size(F.filter(F.array("before1", "before2", "before3"), lambda x: F.regexp_like(x, F.lit(r"^\p{L}+[.,]?$")))),
    }
    joined = found.join(covered, "candidate", "left")
    return joined.select(*[c for c in found.columns if c not in kept], *kept, *[stats[f].cast("double").alias(f) for f in FEATURES])


def label_findings() -> Column:
    """1 for findings that are surely secrets, 0 for those that are surely none, null for others.

    Sure are hexadecimal values of 32 or more that a secret's name is assigned to, and for the other side numbers, and parts of
    addresses, to which none is assigned. These labels stand in where no one has labelled findings by hand.
    """
    c = F.col("candidate")
    named = is_named(F.col("holder"), c)
    sure = F.regexp_like(c, F.lit("^[0-9A-Fa-f]{32,}$")) & F.regexp_like(c, F.lit("[A-Fa-f]")) & named
    plain = (F.regexp_like(c, F.lit("^[0-9]+$")) | F.regexp_like("holder", F.lit(r"://"))) & ~named
    return F.when(sure, 1.0).when(plain, 0.0)


def as_vector(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def shipped_findings(terms: DataFrame) -> DataFrame:
    """(label, FEATURES) of the shipped set's findings; its own words count as known besides ``terms``."""
    spark = terms.sparkSession
    labels = secretset.texts()
    found = findings(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(labels)], "doc_id long, text string"))
    found = found.join(spark.createDataFrame([(i, label) for i, (_, label) in enumerate(labels)], "doc_id long, label double"), "doc_id")
    words = spark.createDataFrame([(w,) for w in secretset.WORDS], "term string")
    return features(found, terms.union(words).distinct(), "label").select("label", *FEATURES)


def train(labelled: DataFrame, shipped: DataFrame, sample_rows: int = 20_000, trees: int = 30, seed: int = 3) -> RandomForestClassificationModel:
    """Forest on rows with FEATURES and ``label`` (0 or 1): all of ``shipped``, and at most ``sample_rows`` distinct ones of ``labelled``.

    Rows weigh as often as they occur; those of ``labelled`` together at most as much as ``shipped``.
    """
    counted = lambda df: df.where("label in (0, 1)").groupBy("label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("times"))
    own = counted(labelled).orderBy(F.xxhash64(*FEATURES), "label").limit(sample_rows).withColumn("own", F.lit(True))
    known = materialize(own.unionByName(counted(shipped).withColumn("own", F.lit(False))).coalesce(1), "findings")
    total = {r["own"]: r["times"] for r in known.groupBy("own").agg(F.sum("times").alias("times")).collect()}
    known = known.withColumn("weight", F.when(F.col("own"), F.col("times") * min(1.0, total[False] / total.get(True, 1.0))).otherwise(F.col("times")))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=6, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=seed, weightCol="weight")
    return forest.fit(as_vector(known).select("features", "label", "weight"))


def scan(
    docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, word, candidate, score, is_secret) per candidate.

    ``labelled``: findings with their context (as ``findings`` gives them) and a ``label``; by default the surely labelled ones of
    ``docs``. The shipped set is learned from besides. Nulls: a null text has no candidate, a null id is kept. Repeated rows are scanned each. An empty table gives no
    rows. Other columns are ignored.
    """
    found = materialize(findings(docs, id_col, text_col), "candidates")
    terms = materialize(dictionary(docs, text_col=text_col), "terms")
    ready = materialize(features(found, terms), "features")
    own = ready.withColumn("label", label_findings()) if labelled is None else features(labelled.select(*found.columns, "label"), terms, "label")
    model = train(own, shipped_findings(terms))
    scored = model.transform(as_vector(ready)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "word", "candidate", "score", (F.col("score") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with every secret replaced by MARK wherever it stands in its text; ``chars_col`` is kept at the text's length.

    A text loses the secrets found in it, not those of other texts with its id: rows are told apart by id and text, so rows without id, or with
    one id, are no group. Repeated rows are redacted each. A null text stays null (with a null length). An empty table gives no rows. Other columns
    are kept as they are.
    """
    rows = with_row(docs, doc_id=id_col, text=text_col)
    rows = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")))
    secrets = scan(rows.select("key", "text"), threshold=threshold, id_col="key", text_col="text").where("is_secret")
    # One row per text: its secrets, longest first, so that none is cut by a shorter one inside it.
    per_doc = secrets.groupBy(F.col("doc_id").alias("of")).agg(F.sort_array(F.collect_set(F.struct(F.length("candidate").alias("n"), "candidate")), asc=False).alias("found"))
    # Only texts with a candidate meet the findings; the others stay where they are.
    holds = F.coalesce(may_hold(F.col("text")), F.lit(False))
    met = rows.where(holds).join(per_doc, F.col("key") == F.col("of"), "left")

    def without(text: Column, secret: Column) -> Column:
        # A short one is no part of longer words.
        literal = F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), F.replace(secret, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
        return F.when(F.length(secret) >= SHORTEST, F.replace(text, secret, F.lit(MARK))).otherwise(F.regexp_replace(text, literal, F.lit(MARK)))

    clean = F.aggregate(F.coalesce("found", F.array().cast("array<struct<n:int,candidate:string>>")), F.col("text"), lambda t, x: without(t, x["candidate"]))
    rows = met.withColumn("text", clean).select("doc", "text").unionByName(rows.where(~holds).select("doc", "text"))
    changed = {text_col: F.col("text")}
    if chars_col:
        changed[chars_col] = F.length("text").cast(docs.schema[chars_col].dataType)
    return unpacked(rows, docs.columns, **changed)
