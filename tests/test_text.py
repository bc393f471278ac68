"""Cleaning rules one by one, titles, tokens."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicloom.functions import stopwords as sw
from topicloom.functions import text as tx
from topicloom.operators import tokens as tk


def run(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("t"))).collect()]


CLEAN = [
    ("Anna (23) lacht", "Anna lacht"),
    ("Der 2:3-Sieg war knapp", "Der Sieg war knapp"),
    ("Endstand (2:2) heute", "Endstand heute"),
    ("a•b™c©d…e\"f$g%h&i*j+k;l=m[n]o^p_q`r{s|t}u~v'w\\x", "abcdefghijklmnopqrstuvwx"),
    ("Mehr auf Bild.DE jetzt", "Mehr auf jetzt"),
    ("Quelle derStandard.at hier", "Quelle derStandard hier"),
    ("nur BILDplus und bild plus Leser", "nur und Leser"),
    ("Text mehr gleich bei bild.", "Text"),
    ("am 12.09.2020 war", "am war"),
    ("Halt! Stopp", "Halt. Stopp"),
    ("erste\nzweite", "erstezweite"),
    ("a" + " " * 7 + "b", "a b"),
    ("warte... ja", "warte. ja"),
    ("Wort -teil", "Wortteil"),
    ("siehe https://x.de/a?b hier", "siehe hier"),
    ("12.50€ kostet", "kostet"),
    ("zehn € und fünf £", "zehn EURO und fünf POUNDS"),
    ("„Zitat“ und\xa0fest\xadweich", "Zitat undfestweich"),
    ("schmal Raum", "schmal Raum"),
    ("Satz . Noch", "Satz. Noch"),
    ("Öl/Gas/Kohle", "Öl Gas/Kohle"),
    ("Pfeil ➡️ da", "Pfeil da"),
    ("Ende ,", "Ende"),
    ("Schluss,", "Schluss"),
    ("zwei.. Punkte", "zwei. Punkte"),
    ("", ""),
    (None, None),
]


def test_clean_rules(spark):
    got = run(spark, tx.clean_article, [a for a, _ in CLEAN])
    assert list(zip([a for a, _ in CLEAN], got)) == CLEAN


def test_newline_and_lower_options(spark):
    assert run(spark, lambda c: tx.clean_article(c, lower=True, newline=" "), ["Eins\nZWEI"]) == ["eins zwei"]


def test_legacy_profile(spark):
    text = "derStandard.at am 12.09.2020 ➡️ da,"
    assert run(spark, lambda c: tx.clean_article(c, profile="legacy"), [text]) == [text]
    with pytest.raises(ValueError):
        tx.cleaning_rules("other")


def test_space_runs_match_sequential_replacement(spark):
    values = ["x" + " " * n + "y" for n in range(1, 40)]

    def twin(s):
        for n in range(3, 20):
            s = s.replace(" " * n, " ")
        return s

    rules = [r for r in tx.cleaning_rules() if r[0] == "literal" and r[1].strip(" ") == "" and len(r[1]) >= 3]
    assert run(spark, lambda c: tx.apply_rules(c, rules), values) == [twin(v) for v in values]


TITLES = [
    ("Ein Titel", ("Ein Titel", "Ein Titel", "")),
    ("Titel - Sport", ("Titel", "", "Titel")),
    ("Titel - Fußball - Bild.de", ("Titel Fußball", "Titel", "Titel Fußball")),
    ("A\xa0B - C", ("A B", "", "A B")),
    ("*** BILDplus Inhalt *** Titel - X", ("Titel", "", "Titel")),
]


def test_titles(spark):
    values = [t for t, _ in TITLES]
    for i, kw in enumerate([{}, {"remove_section": True}, {"keep_unmarked": False}]):
        assert run(spark, lambda c, kw=kw: tx.strip_title_marker(c, **kw), values) == [w[i] for _, w in TITLES]


def test_hard_cleaning(spark):
    assert run(spark, tx.clean_hard, ["Im Jahr 1234 kamen 5x Leute!", "„Ja“ – nein"]) == ["im jahr kamen leute", "ja nein"]


def test_sentences(spark):
    assert run(spark, tx.sentences_by_dot, ["A. B.. C . "]) == [["A", "B", "C", ""]]
    assert run(spark, tx.sentences, ["Eins. Zwei! Drei? vier"]) == [["Eins.", "Zwei!", "Drei?", "vier"]]


def test_first_words(spark):
    assert run(spark, lambda c: tx.first_words(c, 2), ["a b c", "a"]) == ["a b", "a"]


def test_ngrams(spark):
    assert run(spark, lambda c: tx.ngrams(F.split(c, " "), 2), ["a b c", "a"]) == [["a b", "b c"], []]
    assert run(spark, lambda c: tx.words(c), ["Öl, ab a_1 x"]) == [["öl", "ab", "a_1"]]


def test_alphabetic_tokens(spark):
    stop = ["der", "BILD"]
    got = run(spark, lambda c: tk.alphabetic_tokens(c, stop), ["der Der BILD Haus 12 x2 http://a.b é Größe, ok!"])
    assert got == [["Der", "Haus", "Größe", "ok"]]


def test_stem(spark):
    assert run(spark, tk.stem, ["Häuser", "Haus", "Kindern", "Straße"]) == ["haus", "haus", "kind", "strass"]


def test_stopword_file(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("; comment\naber\nalle\naber\n", encoding="utf-8")
    got = {r[0] for r in sw.load_stopwords(spark, str(path)).collect()}
    assert got == {"aber", "alle", *sw.EXTRA_STOPWORDS}


def test_space_class_is_unicode():
    assert re.match(r"[\t-\r]", "\v")


def test_long_ngrams_shuffle_a_token_once(spark, capsys):
    texts = ["a b c d e f g", "a b c", "a b", "", None, "x x x x x x x", "a b c d e f g"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    sizes, tokens = [2, 3, 4, 6], F.when(F.col("text") != "", F.split("text", " ")).when(F.col("text") == "", F.array().cast("array<string>"))
    want = Counter((n, " ".join(w[i : i + n])) for t in texts if t for w in [t.split(" ")] for n in sizes for i in range(len(w) - n + 1))
    found = tk.top_ngrams(df, tokens, sizes, None)
    assert {(r["size"], r["ngram"]): r["n"] for r in found.collect()} == want and found.count() == len(want)
    best = tk.top_ngrams(df, tokens, [6, 3], 2).collect()
    assert {(r["size"], r["rank"], r["ngram"], r["n"]) for r in best} == {
        (3, 1, "x x x", 5), (3, 2, "a b c", 3), (6, 1, "a b c d e f", 2), (6, 2, "b c d e f g", 2)}
    tk.top_ngrams(df, tokens, [3, 4, 5, 6], None).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(lead" in plan


def test_run_travels_with_few_bytes_of_its_hash(spark):
    df = spark.createDataFrame([(" ".join(f"w{(i * j) % 97}" for j in range(60)),) for i in range(200)], "text string")
    plan = tk.top_ngrams(df, F.split("text", " "), [3, 6], None)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [lead" in plan and "pmod(xxhash64(" in plan
    spread = df.select(F.pmod(F.xxhash64("text"), F.lit(tk.LEADS)).alias("lead"))
    assert spread.where((F.col("lead") < 0) | (F.col("lead") >= 1 << 24)).isEmpty() and spread.distinct().count() > 90


def test_top_ngrams_of_frequent_words_are_those_of_all(spark, monkeypatch):
    pick = random.Random(2)
    line = "the quick brown fox jumps over the lazy dog".split()
    texts = [[f"w{int(pick.paretovariate(0.7))}" for _ in range(pick.randint(0, 40))] + line * (i % 3 == 0) for i in range(300)] + [None, [], ["the"]]
    df = spark.createDataFrame([(t,) for t in texts], "t array<string>").repartition(3)
    every = Counter((n, " ".join(t[i : i + n])) for t in texts if t for n in (1, 2, 3, 4) for i in range(len(t) - n + 1))
    want = {(n, r + 1, g, c) for n in (1, 2, 3, 4) for r, (g, c) in enumerate(
        sorted(((g, c) for (m, g), c in every.items() if m == n), key=lambda x: (-x[1], x[0]))[:9])}
    counted = []
    monkeypatch.setattr(tk, "_all_ngrams", lambda df, t, sizes, real=tk._all_ngrams: counted.append(sizes) or real(df, t, sizes))
    for most, left in [((1 << 15, 1 << 18), []), ((150, 400), []), ((40, 60), None), ((2,), [[1, 2, 3, 4]])]:
        monkeypatch.setattr(tk, "CANDIDATES", most)
        counted.clear()
        found = tk.top_ngrams(df, F.col("t"), [4, 1, 2, 3], 9)
        assert {(r["size"], r["rank"], r["ngram"], r["n"]) for r in found.collect()} == want
        assert left is None or counted == left
