"""Language of a text by unigram models over the pieces of a fixed public vocabulary, summed over all segmentations.

A language is a distribution over pieces (byte strings of a vocabulary that holds every single byte). The probability of a word is the sum,
over all ways to cut it into pieces, of the product of their probabilities: a forward pass over its bytes adds up what reaches each of
them. A text is its words, runs of letters in lower case with a blank before each, so the sum over all segmentations of the
text is the product of those of its words. With a prior per language the likelihoods become a posterior.

Models are learned from labelled texts by expectation and maximisation: a pass forward and one backward give how often each piece
is expected in a word under the current model, starting from equal pieces. Words are counted per language first (one
shuffle of partial counts), and a round passes over distinct words only. The vocabulary is a fixed file of at most ``bpe.MAX_TOKENS``
pieces, and a corpus has at most MAX_LANGS languages, so models are bounded and broadcast. Scoring shuffles nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import pick
from topicloom.session import materialize, spread

#: Languages of a corpus; more are an error, as models of all of them are broadcast.
MAX_LANGS = 1000
#: Characters of text of a block, words cut at once, words counted before they are passed on, and likelihoods kept: bound a worker's memory.
BLOCK_CHARS, CUT_WORDS, HELD_WORDS, KEPT = 4 << 20, 20_000, 200_000, 2_400_000
#: Up to so many languages blocks have these sizes; with more they get smaller.
USUAL_LANGS = 8
#: Expected counts are kept as whole numbers of this part, so that sums don't depend on their order.
UNIT = 1 << 20
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


class Pieces:
    """The vocabulary as a trie: children by (node, byte), and the piece that ends at a node."""

    def __init__(self, pieces: list[bytes]):
        if not {bytes([b]) for b in range(256)} <= set(pieces):
            raise ValueError("the vocabulary must hold every single byte")
        child: dict[int, int] = {}
        ends = {}
        for i, piece in enumerate(pieces):
            node = 0
            for b in piece:
                node = child.setdefault(node << 8 | b, len(child) + 1)
            ends.setdefault(node, i)
        self.keys = np.array(sorted(child), np.int64)
        self.child = np.array([child[k] for k in self.keys.tolist()], np.int32)
        self.piece = np.full(len(child) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())

    def arcs(self, words: list[bytes]) -> "Arcs":
        """All places where a piece fits into a word."""
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)  # words have no zero byte; it ends a walk
        size = np.array([len(w) for w in words])
        first = np.cumsum(size + 1) - size - 1
        inside = np.ones(len(data), bool)
        inside[first + size] = False
        at = begin = np.flatnonzero(inside)
        node = np.zeros(len(at), np.int64)
        found = []
        while len(at):
            key = node << 8 | data[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[place] == key
            node, begin, at = self.child[place[ok]].astype(np.int64), begin[ok], at[ok] + 1
            piece = self.piece[node]
            is_piece = piece >= 0
            found.append((begin[is_piece], at[is_piece], piece[is_piece]))
            on = inside[at]
            node, begin, at = node[on], begin[on], at[on]
        src, dst, piece = map(np.concatenate, zip(*found, strict=True))
        word = np.repeat(np.arange(len(words)), size + 1)
        return Arcs(src, dst, piece, word[src], first, first + size, len(data))


class Arcs(NamedTuple):
    """Pieces (``piece``) from place ``src`` to ``dst`` of ``word``; words begin and end at places ``first`` and ``last`` of ``n``."""

    src: np.ndarray
    dst: np.ndarray
    piece: np.ndarray
    word: np.ndarray
    first: np.ndarray
    last: np.ndarray
    n: int

    def forward(self, weight: np.ndarray, backward: bool = False) -> np.ndarray:
        """Log of the sum over all ways from a word's begin to each place (from its end, if ``backward``); ``weight``: (arcs, models)."""
        source, target, root = (self.dst, self.src, self.last) if backward else (self.src, self.dst, self.first)
        steps = np.abs(target - root[self.word])
        order = np.lexsort((target, steps))
        source, target, steps, weight = source[order], target[order], steps[order], weight[order]
        reached = np.full((self.n, weight.shape[1]), -np.inf)
        reached[root] = 0.0
        cuts = np.flatnonzero(np.diff(steps)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(steps)], strict=True):
            to = target[low:high]
            group = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            term = reached[source[low:high]] + weight[low:high]
            top = np.maximum.reduceat(term, group)
            term -= np.repeat(top, np.diff(np.append(group, len(to))), axis=0)
            reached[to[group]] = top + np.log(np.add.reduceat(np.exp(term), group))
        return reached


def bytes_of(words: list[str]) -> list[bytes]:
    return [b" " + w.encode() for w in words]


def likelihoods(trie: Pieces, words: list[str], logs: np.ndarray) -> np.ndarray:
    """Log-probability of each word, over all its segmentations, in each model; ``logs``: (pieces, models)."""
    out = np.zeros((len(words), logs.shape[1]))
    step = max(1, CUT_WORDS * USUAL_LANGS // max(USUAL_LANGS, logs.shape[1]))
    for start in range(0, len(words), step):
        arcs = trie.arcs(bytes_of(words[start : start + step]))
        out[start : start + step] = arcs.forward(logs[arcs.piece])[arcs.last]
    return out


def expected(trie: Pieces, words: list[str], times: np.ndarray, model: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """How often each piece is expected in ``words``, seen ``times`` times under model number ``model``, in UNITs: (models, pieces)."""
    out = np.zeros(logs.T.shape, np.int64)
    for start in range(0, len(words), CUT_WORDS):
        part = slice(start, start + CUT_WORDS)
        arcs = trie.arcs(bytes_of(words[part]))
        weight = logs[arcs.piece, model[part][arcs.word]][:, None]
        there, back = arcs.forward(weight), arcs.forward(weight, backward=True)
        share = np.exp((there[arcs.src] + weight + back[arcs.dst])[:, 0] - there[arcs.last[arcs.word], 0])
        np.add.at(out, (model[part][arcs.word], arcs.piece), np.rint(share * UNIT).astype(np.int64) * times[part][arcs.word])
    return out


class Model(NamedTuple):
    """Languages in order, log-probabilities (pieces, languages) and log-priors, over ``pieces``."""

    langs: list[str]
    logs: np.ndarray
    prior: np.ndarray
    pieces: list[bytes]


def smoothed(counts: np.ndarray, added: float) -> np.ndarray:
    """Log-probabilities (pieces, languages) from counts (languages, pieces)."""
    return np.log((counts + added) / (counts.sum(axis=1, keepdims=True) + added * counts.shape[1])).T.copy()


def counted_words(labelled: DataFrame) -> DataFrame:
    """(lang, word, n) of the rows (lang, text); a row with a null word counts the language's texts that have a letter."""

    def run(batches):
        held: dict[str, Counter] = {}

        def passed_on():
            for lang, words in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                words = LETTERS.findall((text.as_py() or "").lower())
                if words:
                    seen = held.setdefault(lang, Counter())
                    seen.update(words)
                    seen[None] += 1
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from passed_on()
        yield from passed_on()

    return labelled.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, pieces: list[bytes], rounds: int = 2, added: float = 0.1, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Models of all languages of ``labelled``; ``added`` is put to every piece's expected count.

    Rows with a null language, or with no letter in the text, teach nothing; repeated rows count each. Without any row to learn from the model has no
    language. Other columns are ignored.
    """
    base = pick(labelled, lang=lang_col, text=text_col).withColumn("lang", F.col("lang").cast("string")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(counted_words(spread(base)), "langwords")
    texts = {r["lang"]: r["n"] for r in counts.where(F.col("word").isNull()).limit(MAX_LANGS + 1).collect()}
    if len(texts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(texts)
    if not langs:
        return Model([], np.zeros((len(pieces), 0)), np.zeros(0), pieces)
    prior = np.log(np.array([texts[x] for x in langs], np.float64) / sum(texts.values()))
    logs = smoothed(np.zeros((len(langs), len(pieces))), 1.0)
    number = {x: i for i, x in enumerate(langs)}
    context = labelled.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast((pieces, logs))

        def run(batches, shared=shared):
            trie, total = trie_of(shared.value[0]), None
            for batch in batches:
                model = np.fromiter(map(number.__getitem__, batch.column("lang").to_pylist()), np.int64, len(batch))
                found = expected(trie, batch.column("word").to_pylist(), batch.column("n").to_numpy(), model, shared.value[1])
                total = found if total is None else total + found
            if total is not None:
                model, piece = np.nonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(model), pa.array(piece), pa.array(total[model, piece])], ["model", "piece", "n"])

        # at most languages x pieces rows
        sums = spread(counts.where(F.col("word").isNotNull())).mapInArrow(run, "model long, piece long, n long").groupBy("model", "piece").agg(F.sum("n").alias("n")).toArrow()
        seen = np.zeros((len(langs), len(pieces)))
        seen[sums.column("model").to_numpy(), sums.column("piece").to_numpy()] = sums.column("n").to_numpy() / UNIT
        logs = smoothed(seen, added)
    return Model(langs, logs, prior, pieces)


TRIES: dict[int, Pieces] = {}


def trie_of(pieces: list[bytes]) -> Pieces:
    """One trie per worker process and vocabulary."""
    key = hash(tuple(pieces))
    if key not in TRIES:
        TRIES[key] = Pieces(pieces)
    return TRIES[key]


def blocks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[tuple[pa.Array, list[list[str]]]]:
    """Ids and words of texts in blocks of about ``chars`` characters; a longer text is a block of its own."""
    for batch in batches:
        words, start, size = [], 0, 0
        for i, text in enumerate(batch.column("text")):
            raw = text.as_py() or ""
            words.append(LETTERS.findall(raw.lower()))
            size += len(raw)
            if size >= chars:
                yield batch.column("doc_id").slice(start, i + 1 - start), words
                words, start, size = [], i + 1, 0
        if words:
            yield batch.column("doc_id").slice(start), words


class Scorer:
    """Posteriors of texts; likelihoods of words are kept from block to block, up to KEPT of them."""

    def __init__(self, model: Model):
        self.model, self.trie = model, trie_of(model.pieces)
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.known = np.zeros((0, len(self.model.langs)))

    def posteriors(self, texts: list[list[str]]) -> np.ndarray:
        """Probability of each language for each text (a list of one word or more)."""
        if self.known.size > KEPT:
            self.forget()
        size = np.array([len(words) for words in texts])
        code = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int64, int(size.sum()))
        new = list(islice(self.number, len(self.known), None))
        self.known = np.concatenate((self.known, likelihoods(self.trie, new, self.model.logs)))
        total = self.model.prior + np.add.reduceat(self.known[code], np.cumsum(size) - size)
        total = np.exp(total - total.max(axis=1, keepdims=True))
        return total / total.sum(axis=1, keepdims=True)


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per document: its likeliest language (the first in code-point order of equal ones) and its posterior probability.

    A null text, and one without a letter, is ``und`` with a score of 0, as is every text under a model without languages. Ids may be null; repeated
    rows are judged each; an empty table gives no rows. Other columns, a language among them, are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = shared.value
        scorer = Scorer(own)
        for ids, texts in blocks(batches, BLOCK_CHARS * USUAL_LANGS // max(USUAL_LANGS, len(own.langs))):
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            judged = [i for i, words in enumerate(texts) if words] if own.langs else []
            if judged:
                p = scorer.posteriors([texts[i] for i in judged])
                best = p.argmax(axis=1)
                score[judged] = p[np.arange(len(judged)), best]
                for i, k in zip(judged, best.tolist(), strict=True):
                    lang[i] = own.langs[k]
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return spread(base).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
