"""One query per training-data operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import annscan, backoff, bpe, hostrules, jaccard, langid, mixing, phrases, rulefit, runs, secrets, urlmarkov, warc
from topicloom.llm.common import pick, words_of

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Register a query under its name."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


MIX_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM sizes GROUP BY source),
needs AS (SELECT *, CAST([3.0, 1.0, 2.0][CAST(rank % 3 AS INTEGER) + 1] AS DOUBLE) AS weight, 2 * source_size AS cap, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS goal
  FROM ranked),
levels AS (
  SELECT *, (goal - (sum(cap) OVER up - cap)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM needs WINDOW up AS (ORDER BY cap / weight, rank)),
held AS (SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
goals AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), held.level * weight) AS target FROM levels, held),
wants AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS want FROM goals),
rests AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS copies FROM wants),
drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.copies, r.want - r.copies * r.source_size AS rest,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('7:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(copies * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM drawn
"""


@query("op2_mixing", MIX_SQL)
def op2_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that a mixture of 150% of all words takes of each document, sources weighing 3, 1, 2."""
    return mixing.taken_words(mixing.mix(table(spark, sf, "documents")))


@query("op7_rule_ensemble")
def op7_rule_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score per document from weighted rules over its statistics."""
    docs = table(spark, sf, "documents")
    return rulefit.score(docs, rulefit.fit(docs, table(spark, sf, "labels")))


HOST_RULES_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM parts WHERE len(words) >= 5)),
twice AS (SELECT rid, w FROM windows GROUP BY rid, w HAVING count(*) >= 2),
covered AS (
  SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS pos FROM windows JOIN twice USING (rid, w)) GROUP BY rid),
counted AS (
  SELECT p.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM parts p LEFT JOIN covered c ON p.rid = c.rid),
judged AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats FROM counted),
hosts AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS k
  FROM (SELECT source, 'short' AS rule, short AS failed FROM judged UNION ALL SELECT source, 'repeats', repeats FROM judged) GROUP BY source, rule),
moments AS (
  SELECT rule, sum(n) AS total, sum(k) / sum(n) AS mean, avg(k / n) AS center, avg((k / n) * (k / n)) AS squares, avg(1 / n) AS inverse
  FROM hosts GROUP BY rule),
priors AS (SELECT *, squares - center * center - mean * (1 - mean) * inverse AS spread FROM moments),
strengths AS (
  SELECT rule, mean, CASE WHEN spread > 0 THEN greatest(0, least(mean * (1 - mean) / spread - 1, total)) ELSE total END AS strength FROM priors),
rates AS (SELECT source, max((k + mean * strength) / (n + strength)) AS worst FROM hosts JOIN strengths USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
       NOT (short OR repeats) AND worst <= 0.5 AS kept
FROM judged j JOIN rates r ON j.source IS NOT DISTINCT FROM r.source
"""


@query("op8_host_rules", HOST_RULES_SQL)
def op8_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Base rules per document, and the verdict with its host's shrunk failure rates."""
    judged = hostrules.judge(table(spark, sf, "documents"))
    return judged.select("doc_id", *hostrules.BASE, "base_failed", "kept")


WARC_SQL = """
WITH pages_in AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html FROM pages),
digests AS (SELECT rid, page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM pages_in),
firsts AS (
  SELECT payload_digest, arg_min(rid, page_id) AS first_rid, min(page_id) AS first_page FROM digests WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN rid <> coalesce(first_rid, rid) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN rid <> coalesce(first_rid, rid) THEN first_page END AS refers_to
FROM digests d LEFT JOIN firsts f ON d.payload_digest = f.payload_digest
"""


@query("op9_warc", WARC_SQL)
def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as archives, read back and put together."""
    return warc.round_trip(table(spark, sf, "pages"))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts and digests of every document's ids, and of the bytes they decode to."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.tokenize(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


JACCARD_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
grams AS (
  SELECT DISTINCT rid, g FROM (
    SELECT rid, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM docs WHERE len(words) >= 5)
    UNION ALL SELECT rid, array_to_string(words, ' ') FROM docs WHERE len(words) BETWEEN 1 AND 4)),
sizes AS (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reached AS (SELECT rid AS a, rid AS b FROM docs UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
smallest AS (SELECT a AS rid, min(d.doc_id) AS component_id FROM reached JOIN docs d ON d.rid = b GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM docs JOIN smallest USING (rid) LEFT JOIN sizes USING (rid)
"""


@query("op3_ngram_jaccard", JACCARD_SQL)
def op3_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of 0.8 of their 5-word shingles."""
    return jaccard.join(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


#: crc32 of a number's decimal text, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

BACKOFF_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {CRC32_SQL} % 5 = 1 AS held_out,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS words
  FROM documents),
tokens AS (
  SELECT rid, held_out, words[i] AS w, CASE WHEN i = 1 THEN ' start' ELSE words[i - 1] END AS h
  FROM (SELECT rid, held_out, words, unnest(range(1, len(words) + 1)) AS i FROM docs)),
ones AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
twos AS (SELECT h, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY h, w),
histories AS (SELECT h, sum(c) AS c FROM twos GROUP BY h),
total AS (SELECT sum(c) AS n, count(*) AS v FROM ones),
weights AS (
  SELECT rid, ones.c IS NOT NULL AS known, (coalesce(ones.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)) AS p,
         coalesce(twos.c, 0) AS arc, coalesce(histories.c, 0) AS state
  FROM tokens t LEFT JOIN ones ON t.w = ones.w LEFT JOIN twos ON t.h = twos.h AND t.w = twos.w LEFT JOIN histories ON t.h = histories.h, total)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE known) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       fsum(log10(p)) AS base_score, fsum(log10((arc + 64 * p) / (state + 64))) AS score
FROM docs JOIN weights USING (rid), total GROUP BY rid, doc_id, held_out
"""


@query("op6_backoff_automaton", BACKOFF_SQL)
def op6_backoff_automaton(spark: SparkSession, sf: str) -> DataFrame:
    """Unigram and automaton log-probabilities of every document."""
    return backoff.score(table(spark, sf, "documents"))


@query("op10_dimension_scan")
def op10_dimension_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return annscan.search(table(spark, sf, "embeddings"))


#: Fixed by the contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op1_url_markov")
def op1_url_markov(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page's url, by rule or by two character models."""
    return urlmarkov.judge(table(spark, sf, "pages"), URL_RULES).drop("score")


@query("op4_secret_forest")
def op4_secret_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates for secrets in all documents, with the forest's verdict."""
    return secrets.scan(table(spark, sf, "documents"))


PHRASES_SQL = r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k))),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, g, a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT o.lang, o.k, o.g, o.a, c, array_to_string(w[:c], ' ') AS gl, array_to_string(w[c + 1:], ' ') AS gr
  FROM (SELECT *, unnest(range(1, k)) AS c FROM often) o),
scored AS (
  SELECT u.lang, u.k, u.g, u.a, c, x.a AS l, y.a AS r, (1000000::HUGEINT * u.a * u.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts u JOIN f x ON x.lang = u.lang AND x.k = c AND x.g = gl JOIN f y ON y.lang = u.lang AND y.k = u.k - c AND y.g = gr),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, g ORDER BY score, c) = 1),
inside AS (
  SELECT lang, g, max(longer) AS longer
  FROM (SELECT lang, array_to_string(w[:2], ' ') AS g, a AS longer FROM often WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM often WHERE k = 3)
  GROUP BY lang, g),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.g) AS rank
  FROM lowest s LEFT JOIN inside i ON s.k = 2 AND s.lang = i.lang AND s.g = i.g WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrases", PHRASES_SQL)
def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The 2000 best phrases of two or three words of every language."""
    return phrases.mine(table(spark, sf, "documents"))


RUNS_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {CRC32_SQL} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0 FROM documents),
starts AS (SELECT *, len(w0) AS n, h // 10 AS g, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) ELSE 0 END AS a FROM docs),
periods AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM starts),
texts AS (
  SELECT rid, doc_id, n,
         CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w0 END AS w
  FROM periods),
words AS (SELECT rid, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM texts),
equal AS (
  SELECT x.rid, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.rid, y.i - x.i ORDER BY x.i) AS island
  FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT rid, q, min(i) AS start, count(*) + q AS length FROM equal GROUP BY rid, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT rid, start, length, min(q) AS period FROM stretches GROUP BY rid, start, length),
digests AS (
  SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
         first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS best
  FROM runs GROUP BY rid),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (rid, i) GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period,
       CAST(1000 * best.l // best.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN digests USING (rid) LEFT JOIN kept USING (rid)
"""


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by a checksum of its id, goes on with a stretch of its own words over and over."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    base = pick(docs, doc_id="doc_id", text="text").withColumn("h", crc)
    cut = base.withColumn("words", F.when(F.col("h") % 10 == 0, words_of(F.col("text")))).withColumn("n", F.size("words").cast("long"))
    placed = cut.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


@query("op11_runs", RUNS_SQL)
def op11_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Periodic runs of words in every document, some of which get one planted."""
    return runs.digests(runs.detect(planted(table(spark, sf, "documents"))))


@query("op12_language")
def op12_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from those whose checksum of the id modulo 4 is not 2."""
    import public_tokenizers

    docs = table(spark, sf, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    pieces = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    model = langid.fit(docs.where(fold != 2), pieces)
    return langid.predict(docs, model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
