"""Language-model scores by a weighted backoff automaton over smoothed n-grams.

Every n-gram of the training texts is a state with an arc for each token seen after it. With c(h) the count of a history and
c(h, w) of its arcs, an arc weighs (c(h, w) + m p(w | shorter h)) / (c(h) + m); for a token without an arc, the failure arc
leads to the history without its first token and weighs m / (c(h) + m). So the weights at every state add up to 1. At the
lowest state p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).

The corpus is scored chunk by chunk, and the automaton never is in one place. A chunk (about ``chunk_bytes`` of text, dealt by
hash) counts its distinct n-grams, tells them to the parts that own them by hash, and gets back, in the same order, how often the
training texts hold each; then it walks its texts from left to right. Counts cover all documents, no n-gram is cut off, and a
chunk or part lost with its executor is made again from its input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import fold_of, pick
from topicloom.llm.textbytes import hashed_blocks, mix

#: Fixed by the contract: added to every count of a token; one unseen token stands for all.
ADDED = 0.5
#: Hashes of the end of a text and of the place before its first word.
END, START = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0676A9A99)


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each text closed by END, and the number of tokens of each."""
    words, counts = [], []
    for _, _, w, c in hashed_blocks(texts):
        words.append(w)
        counts.append(c)
    words = np.concatenate(words) if words else np.zeros(0, np.uint64)
    counts = np.concatenate(counts) + 1 if counts else np.zeros(0, np.int64)
    out = np.full(len(words) + len(counts), END, np.uint64)
    closed = np.zeros(len(out), bool)
    closed[np.cumsum(counts) - 1] = True
    out[~closed] = words
    return out, counts


def grams_of(tokens: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """Per n up to ``order``: hashes of the n-gram that ends at each token.

    Before a text stands START, once; an n-gram that would begin before it does not exist and has the hash 0.
    """
    first = np.cumsum(counts) - counts
    place = np.arange(len(tokens)) - np.repeat(first, counts)
    out = [tokens]
    for n in range(2, order + 1):
        history = np.empty_like(tokens)
        history[1:] = out[-1][:-1]
        if n == 2:
            history[first] = START
        gram = mix(history * np.uint64(0x9E3779B97F4A7C15) + mix(tokens + np.uint64(n)))
        gram[place < n - 2] = 0
        out.append(gram)
    return out


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: the first, and the differences to the next in as few bytes each as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    narrow = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return keys[:1].astype("<u8").tobytes() + bytes([width]) + narrow.tobytes()


def unpacked_keys(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    width = raw[8]
    steps = np.zeros(((len(raw) - 9) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate((np.frombuffer(raw, "<u8", 1), steps.reshape(-1).view("<u8"))), dtype=np.uint64)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each; those of 255 and more follow in eight bytes, in order."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


class Chunk:
    """The distinct n-grams of one chunk, in the order of their hashes, and where each is used."""

    def __init__(self, texts: pa.Array, train: np.ndarray, order: int, parts: int):
        self.tokens, self.counts = tokens_of(texts)
        self.grams = grams_of(self.tokens, self.counts, order)
        learns = np.repeat(train, self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        # START counts as a history once for every training text.
        keys = np.concatenate([*self.grams, np.array([START])])
        times = np.concatenate([*[learns] * order, np.array([train.sum()])]).astype(np.int64)
        by_key = np.argsort(keys)
        keys, times = keys[by_key], times[by_key]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        begin = np.flatnonzero(new)
        self.keys, self.times = keys[begin], np.add.reduceat(times, begin)
        # Part i owns the i-th of ``parts`` equal ranges of hashes.
        self.at = np.append(np.searchsorted(self.keys, np.array([(i << 64) // parts for i in range(parts)], np.uint64)), len(self.keys))
        slot = np.empty(len(keys), np.int64)
        slot[by_key] = np.cumsum(new) - 1
        n = len(self.tokens)
        self.slots = [slot[i * n : (i + 1) * n] for i in range(order)]
        self.start_slot = slot[-1]

    def walk(self, seen: np.ndarray, total: int, kinds: int, smoothing: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, base score and score per text, given the training count of each distinct n-gram."""
        count = seen[self.slots[0]].astype(np.float64)
        base = np.log10((count + ADDED) / (total + ADDED * (kinds + 1)))
        score = base.copy()
        for i in range(1, len(self.grams)):
            m = smoothing[i - 1]
            arc = seen[self.slots[i]].astype(np.float64)
            # The state a token leaves by: the n-gram that ended at the token before it, START at the beginning.
            state = np.empty(len(arc))
            state[1:] = seen[self.slots[i - 1]][:-1]
            state[self.first] = seen[self.start_slot] if i == 1 else 0
            known = self.grams[i] != 0
            fail = score + np.log10(m / (state + m))
            with np.errstate(divide="ignore"):
                taken = np.log10((arc + m * 10.0**score) / (state + m))
            score = np.where(known, np.where(arc > 0, taken, fail), score)
        per_text = lambda x: np.add.reduceat(x.astype(np.longdouble), self.first).astype(np.float64)
        return np.add.reduceat((count > 0).astype(np.int64), self.first), per_text(base), per_text(score)


def score(
    docs: DataFrame, order: int = 2, smoothing: tuple[float, ...] = (64.0,), chunk_bytes: int = 6 << 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document.

    Texts whose crc32 of the id modulo 5 is not 1 are learned from; the others are held out. Scores are log10 probabilities
    of the whole text with its end. A null or empty text has the end as its only token; a null id counts as an empty one.
    Repeated rows are learned from and scored each. An empty table gives no rows. Other columns are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = base.schema["doc_id"].dataType.simpleString()
    marked = base.withColumn("train", fold_of(F.col("doc_id")) != 1)
    total, kinds = vocabulary(marked.select("text", "train"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts = chunks
    dealt = marked.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("long"))

    def asked(table: pa.Table) -> pa.Table:
        c = Chunk(table.column("text"), table.column("train").to_numpy(zero_copy_only=False), order, parts)
        chunk = table.column("chunk")[0].as_py()
        spans = [slice(a, b) for a, b in zip(c.at[:-1], c.at[1:], strict=True)]
        return pa.table({
            "part": pa.array(range(parts), pa.int64()), "chunk": pa.array([chunk] * parts, pa.int64()),
            "keys": pa.array([packed_keys(c.keys[s]) for s in spans], pa.binary()), "times": pa.array([packed_counts(c.times[s]) for s in spans], pa.binary())})

    def answered(table: pa.Table) -> pa.Table:
        keys = [unpacked_keys(k) for k in table.column("keys").to_pylist()]
        times = [unpacked_counts(t, len(k)) for t, k in zip(table.column("times").to_pylist(), keys, strict=True)]
        _, slot = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(slot, weights=np.concatenate(times)).astype(np.int64)  # exact up to 2^53
        out = np.split(sums[slot], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "seen": pa.array([packed_counts(x) for x in out], pa.binary())})

    def scored(texts: pa.Table, answers: pa.Table) -> pa.Table:
        train = texts.column("train").to_numpy(zero_copy_only=False)
        c = Chunk(texts.column("text"), train, order, parts)
        answers = answers.sort_by("part")
        seen = [unpacked_counts(s, n) for s, n in zip(answers.column("seen").to_pylist(), np.diff(c.at).tolist(), strict=True)]
        n_known, base_score, own_score = c.walk(np.concatenate(seen), total, kinds, list(smoothing))
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.array(~train), "n_tokens": pa.array(c.counts), "n_known": pa.array(n_known),
            "train_tokens": pa.array(np.full(len(train), total)), "base_score": pa.array(base_score), "score": pa.array(own_score)})

    questions = dealt.groupBy("chunk").applyInArrow(asked, "part long, chunk long, keys binary, times binary")
    answers = questions.groupBy("part").applyInArrow(answered, "chunk long, part long, seen binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def vocabulary(texts: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts."""

    def run(batches):
        seen, total = np.zeros(0, np.uint64), 0
        for batch in batches:
            texts = batch.column("text").filter(batch.column("train"))
            if len(texts):
                total += len(texts)
                seen = np.union1d(seen, [END])
            for _, _, words, _ in hashed_blocks(texts):
                total += len(words)
                seen = np.union1d(seen, words)
                if len(seen) > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(np.zeros(len(seen), np.int64))], ["token", "n"])
                    seen = seen[:0]
        yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(np.zeros(len(seen), np.int64))], ["token", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([total], pa.int64())], ["token", "n"])

    found = texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    row = found.agg(F.sum("n").alias("total"), F.count("token").alias("kinds")).first()
    return row["total"] or 0, row["kinds"]
