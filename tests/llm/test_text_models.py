"""Periodic runs, languages and phrases against brute force."""

import collections
import itertools
import random

import numpy as np
import public_tokenizers
import pytest

from topicloom.llm import bpe, langid, phrases, queries, runs

SF = "/root/testdata/sf0.01"


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_texts(rng, n):
    texts = []
    for _ in range(n):
        size, kinds = rng.choice([0, 1, 3, 5, 6, 7, 13, 26, 60, 200]), rng.choice([1, 2, 3, 60])
        words = [f"w{rng.randrange(kinds)}" for _ in range(size)]
        for _ in range(rng.randrange(3)):
            if size > 10:
                start = rng.randrange(size)
                period = rng.randrange(1, max(2, (size - start) // 4 + 1))
                for i in range(start, rng.randrange(start, size + 1)):
                    words[i] = words[start + (i - start) % period]
        texts.append(words)
    return texts


@pytest.mark.parametrize("seed", range(40))
def test_runs(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(runs, "HITS", rng.choice([1, 20, 10**6]))
    texts = some_texts(rng, 14)
    got = runs.find_runs([[w.encode() for w in t] for t in texts])
    for words, found in zip(texts, got, strict=True):
        mine = list(zip(*[x.tolist() for x in found], strict=True))
        assert mine == brute_runs(words)
        dropped = {i for s, n, q in mine for i in range(s + q, s + n)}
        assert runs.collapsed([w.encode() for w in words], found).decode() == " ".join(w for i, w in enumerate(words) if i not in dropped)


def test_extensions_of_any_two_places():
    rng = np.random.default_rng(1)
    for kinds in (1, 2, 5):
        code = np.append(rng.integers(0, kinds, 90), kinds)
        extend = runs.Extensions(code)
        i, j = map(np.array, zip(*itertools.combinations(range(len(code)), 2), strict=True))
        for a, b, n in zip(i.tolist(), j.tolist(), extend(i, j).tolist(), strict=True):
            k = 0
            while b + k < len(code) and code[a + k] == code[b + k]:
                k += 1
            assert n == k


def test_runs_of_a_table(spark, monkeypatch):
    texts = some_texts(random.Random(99), 60)
    docs = spark.createDataFrame([(i, " \t".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in runs.detect(docs.repartition(3)).collect():
        assert [tuple(x) for x in r["runs"]] == brute_runs(texts[r["doc_id"]])


PIECES = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b" ab", b"bc", b"ca", b" c", b"cab"]


def ways(word):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES:
            for rest in ways(word[n:]):
                yield (PIECES.index(word[:n]), *rest)


def test_sums_over_all_segmentations():
    rng = np.random.default_rng(3)
    trie, logs = langid.Pieces(PIECES), np.log(rng.dirichlet(np.ones(len(PIECES)), 3)).T
    words = ["a", "abc", "cabcab", "é", "bcabca"]
    got = langid.likelihoods(trie, words, logs)
    times, model = np.array([3, 1, 2, 1, 5]), np.array([0, 1, 2, 0, 1])
    want = np.zeros((3, len(PIECES)))
    for k, word in enumerate(words):
        all_ways = list(ways(b" " + word.encode()))
        p = np.array([[np.exp(logs[list(way), m].sum()) for m in range(3)] for way in all_ways])
        assert np.allclose(got[k], np.log(p.sum(0)))
        for way, share in zip(all_ways, p[:, model[k]] / p[:, model[k]].sum(), strict=True):
            for piece in way:
                want[model[k], piece] += times[k] * share
    assert np.allclose(langid.expected(trie, words, times, model, logs) / langid.UNIT, want, atol=1e-4)


def test_languages_by_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in queries.op12_language(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert rows.keys() == truth.keys() and 0.2 < len(held) / len(rows) < 0.3
    assert np.mean([rows[i]["lang_pred"] == truth[i] for i in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_scores_do_not_depend_on_layout_or_other_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    pieces = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    one, two = [{r["doc_id"]: r["lang_pred"] for r in langid.predict(d, langid.fit(d, pieces)).collect()} for d in (docs, docs.repartition(5))]
    assert one == two
    only = spark.createDataFrame([(1, "12 34 !?"), (2, None), (3, "Ünd dann")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(only, langid.fit(docs, pieces)).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] in set(one.values())


def brute_phrases(rows, top, least):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        plain = "".join(c.lower() if "A" <= c <= "Z" else "\0" if c in ".,;:!?\n\x0b\x0c\r" else c for c in text or "")
        for piece in plain.split("\0"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        best = []
        for g, a in often.items():
            if any(2 * b >= a and g in (h[:2], h[1:]) for h, b in often.items() if len(h) > len(g)):
                continue
            score, cut = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), counts[g[:cut]], counts[g[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("first", [1, 4])
def test_phrases(spark, monkeypatch, first):
    rng = random.Random(first)
    monkeypatch.setattr(phrases, "FIRST", first)
    monkeypatch.setattr(phrases, "GROWTH", 2)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 3000)
    words = [f"W{i}" for i in range(30)] + ["é", "a\x1fb", "x'y"]
    weights = [1 / (i + 1) for i in range(len(words))]
    idioms = [rng.sample(words, rng.choice([2, 3, 4])) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(40)):
            parts += rng.choice(idioms) if rng.random() < 0.3 else rng.choices(words, weights)
            parts += [rng.choice([".", ", ", "\n", " ! "])] if rng.random() < 0.1 else []
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", "\t", "  "]).join(parts) if i else None))
    docs = spark.createDataFrame(rows, "lang string, text string")
    for top in (5, 40, 10**6):
        got = [tuple(r) for r in phrases.mine(docs, top=top, least=3).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
        assert sorted(got) == brute_phrases(rows, top, 3)
