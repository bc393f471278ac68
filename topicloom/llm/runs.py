"""Periodic runs of words in texts, by longest common extensions over a difference cover.

A run is a stretch of words with a smallest period q that no neighbour extends, at least ``max(6, 4 q)`` words long. Of a stretch
with period q and 4 q words, 3 q places in a row equal the place q further on. So for every q it is enough to look at every
(3 q)-th place of a text (a harmonic grid: n log n places over all q): where the word q further on is equal, extensions to the
right and to the left tell the whole stretch.

Extensions are answered from a difference cover: places whose number modulo V is in COVER. Any two places reach two places of the
cover by the same number of steps, less than V; over these the words are compared one by one. Only suffixes that begin in the
cover are sorted, by their first V words and then by doubling (a suffix of the cover 2 V, 4 V .. words on is in the cover again). The
common prefix of any two of them is the least one between neighbours in sorted order between them: one look into a sparse table. An
extension to the left over k words is one to the right from k words further left.

Texts of a task are handled in blocks, all by array operations. Every text numbers its words for itself, so suffixes of
different texts differ from the first word on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import pick

#: Perfect difference cover: every residue modulo V is a difference of two members.
V, COVER = 13, (0, 1, 3, 9)
#: Fixed by the contract: words of the shortest run, and periods in it.
SHORTEST, EXPONENT = 6, 4
#: Words of a block: bounds a worker's memory (about 200 bytes each); a longer text is a block of its own.
BLOCK_WORDS = 400_000
#: Places of the grid followed up at once.
HITS = 500_000

_IN_COVER = np.isin(np.arange(V), COVER)
#: steps from residues a, b until both are in the cover
STEPS = np.array([[next(k for k in range(V) if _IN_COVER[(a + k) % V] and _IN_COVER[(b + k) % V]) for b in range(V)] for a in range(V)])


class Extensions:
    """Longest common extensions to the right of places of ``code``; numbers of words from 0, and every text ends with one of its own."""

    def __init__(self, code: np.ndarray):
        self.n = n = len(code)
        top = int(code.max(initial=0)) + 1
        self.code = np.concatenate((code, np.full(V, top)))  # past the end
        places = np.flatnonzero(_IN_COVER[np.arange(n) % V])
        m = len(places)
        self.sample = np.zeros(n + V, np.int64)
        self.sample[places] = np.arange(m)
        self.places = places
        # ranks by the first V words, a few words to a number
        bits = top.bit_length()
        each = max(1, 62 // bits)
        keys = []
        for start in range(0, V, each):
            key = np.zeros(m, np.int64)
            for k in range(start, min(start + each, V)):
                key = key << bits | self.code[places + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(m, np.int64)
        group = np.maximum.accumulate(np.where(new, np.arange(m), 0)) if m else np.zeros(0, np.int64)
        rank[order] = group  # a suffix's rank is the place of its group's first member
        levels, step = [(V, rank.copy())], V
        tied = np.flatnonzero(self._tied(group))
        while len(tied):
            at = order[tied]  # tied suffixes, group after group
            far = places[at] + step
            inside = far < n
            after = np.full(len(at), -1, np.int64)
            after[inside] = rank[self.sample[far[inside]]]
            again = np.lexsort((after, rank[at]))
            order[tied] = at = at[again]
            after, before = after[again], rank[at]
            new = np.concatenate(([True], (after[1:] != after[:-1]) | (before[1:] != before[:-1])))
            head = np.maximum.accumulate(np.where(new, tied, 0))
            rank[at] = head
            step *= 2
            levels.append((step, rank.copy()))
            split = np.concatenate((head[1:] == head[:-1], [False]))
            split[1:] |= split[:-1].copy()
            tied = tied[split]
        self.rank = rank
        self._table(order, levels)

    @staticmethod
    def _tied(group: np.ndarray) -> np.ndarray:
        same = np.zeros(len(group) + 1, bool)
        same[1:-1] = group[1:] == group[:-1]
        return same[1:] | same[:-1]

    def _table(self, order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> None:
        """Common prefixes of neighbours in sorted order, and the sparse table of their minima."""
        m = len(order)
        a, b = self.places[order[:-1]].copy(), self.places[order[1:]].copy()
        lcp = np.zeros(max(m - 1, 0), np.int64)
        for length, rank in reversed(levels):
            inside = np.flatnonzero((a < self.n) & (b < self.n))
            equal = inside[rank[self.sample[a[inside]]] == rank[self.sample[b[inside]]]]
            lcp[equal] += length
            a[equal] += length
            b[equal] += length
        rest = np.flatnonzero((a < self.n) & (b < self.n))
        for k in range(V):
            rest = rest[self.code[a[rest] + k] == self.code[b[rest] + k]]
            lcp[rest] += 1
            rest = rest[(a[rest] + k + 1 < self.n) & (b[rest] + k + 1 < self.n)]
        self.least = [lcp.astype(np.int32)]
        width = 1
        while 2 * width <= len(lcp):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal words from places ``i`` and ``j`` on, i < j."""
        steps = STEPS[i % V, j % V]
        out = steps.copy()
        open_ = np.ones(len(i), bool)
        for k in range(int(steps.max(initial=0))):
            here = np.flatnonzero(open_ & (steps > k) & (j + k < self.n))
            bad = here[self.code[i[here] + k] != self.code[j[here] + k]]
            out[bad] = k
            open_[bad] = False
        past = open_ & (j + steps >= self.n)
        out[past] = self.n - j[past]
        go = np.flatnonzero(open_ & ~past)
        a, b = self.rank[self.sample[i[go] + steps[go]]], self.rank[self.sample[j[go] + steps[go]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for at in np.unique(level):
            of = np.flatnonzero(level == at)
            row = self.least[at]
            out[go[of]] += np.minimum(row[low[of]], row[high[of] - (1 << at)])
        return out


def runs_of(code: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in texts laid end to end, the shortest text first, by start, then period.

    ``begin`` and ``size`` are the texts' places in ``code``; the last number of each text is its own end.
    """
    n = len(code)
    extend = Extensions(code)
    found, grid, held = [], [], 0
    longest = int(size.max(initial=0))
    for q in range(1, longest // EXPONENT + 1 if longest >= SHORTEST else 0):
        first = int(begin[np.searchsorted(size, max(SHORTEST, EXPONENT * q))])  # shorter texts hold no run of this period
        step = (EXPONENT - 1) * q
        at = np.flatnonzero(code[first : n - q : step] == code[first + q : n : step]) * step + first
        if len(at):
            grid.append((at, np.full(len(at), q)))
            held += len(at)
        if held >= HITS:
            found.append(stretches(extend, *map(np.concatenate, zip(*grid, strict=True))))
            grid, held = [], 0
    if grid:
        found.append(stretches(extend, *map(np.concatenate, zip(*grid, strict=True))))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, q = distinct(*map(np.concatenate, zip(*found, strict=True)))
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def distinct(start: np.ndarray, length: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every stretch once, with its smallest period: it is also found at other places of the grid, and with multiples of its period."""
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[first], length[first], q[first]


def stretches(extend: Extensions, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the long enough stretches in which the places ``i`` equal those ``q`` further on."""
    right = extend(i, i + q)
    # the place must have been reached from the left as far as the shortest run asks beyond what is to the right
    need = np.maximum(np.maximum(SHORTEST - q, (EXPONENT - 1) * q) - right, 0)
    kept = i >= need
    i, q, right, need = i[kept], q[kept], right[kept], need[kept]
    kept = extend(i - need, i - need + q) >= need
    i, q, right = i[kept], q[kept], right[kept]
    # the farthest place on the left from which the extension reaches i: doubling, then halving
    low, reach = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
    growing = np.arange(len(i))
    while len(growing):
        k = np.minimum(reach[growing], i[growing])
        ok = extend(i[growing] - k, i[growing] - k + q[growing]) >= k
        low[growing[ok]] = k[ok]
        growing = growing[ok & (k < i[growing])]
        reach[growing] *= 2
    high = np.minimum(reach, i)  # low is reached; beyond high nothing is
    halving = np.flatnonzero(low < high)
    while len(halving):
        k = (low[halving] + high[halving] + 1) // 2
        ok = extend(i[halving] - k, i[halving] - k + q[halving]) >= k
        low[halving[ok]] = k[ok]
        high[halving[~ok]] = k[~ok] - 1
        halving = halving[low[halving] < high[halving]]
    return distinct(i - low, low + right + q, q)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of texts in blocks of about BLOCK_WORDS."""
    ids, words, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column("doc_id"), batch.column("text").cast(pa.large_binary()), strict=True):
            raw = text.as_py()
            ids.append(key)
            words.append(raw.split() if raw else [])  # bytes are split at blanks and 0x09-0x0D only
            size += len(words[-1]) + 1
            if size >= BLOCK_WORDS:
                yield ids, words
                ids, words, size = [], [], 0
    if ids:
        yield ids, words


def find_runs(words: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of all runs of each text, by start, then period."""
    size = np.array([len(w) + 1 for w in words])
    by_size = np.argsort(size, kind="stable")
    code = np.empty(int(size.sum()), np.int64)
    ends = np.cumsum(size[by_size])
    begin, used = ends - size[by_size], 0
    for at, end, t in zip(begin.tolist(), ends.tolist(), by_size.tolist(), strict=True):
        number = {w: k for k, w in enumerate(dict.fromkeys(words[t]), used)}
        code[at : end - 1] = list(map(number.__getitem__, words[t]))
        used += len(number) + 1
        code[end - 1] = used - 1
    start, length, period = runs_of(code, begin, size[by_size])
    cut = np.searchsorted(start, np.append(begin, len(code)))
    out = [None] * len(words)
    for k, t in enumerate(by_size.tolist()):
        part = slice(cut[k], cut[k + 1])
        out[t] = (start[part] - begin[k], length[part], period[part])
    return out


def collapsed(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    start, length, period = runs
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) per document: its runs (start, length, period) by start, then period, and its words without repetitions.

    Words are counted from 0; ``collapsed`` is their text joined by single blanks, where of every run only the first period is left. A null
    or empty text, or one without a run, has an empty array. Ids may be null; repeated rows are handled each; an empty table gives
    no rows. Other columns are ignored. Nothing is shuffled; a lost executor costs its own tasks only.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    kind = base.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for ids, words in blocks(batches):
            found = find_runs(words)
            offsets = np.concatenate(([0], np.cumsum([len(r[0]) for r in found]))).astype(np.int32)
            flat = [np.concatenate([r[k] for r in found]) for k in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in flat], fields=list(struct)))
            texts = pa.array([collapsed(w, r) for w, r in zip(words, found, strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in ids], ids[0].type), runs, texts], ["doc_id", "runs", "collapsed"])

    return base.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): counts, the longest run and digests of ``detect``."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), -r["start"], -r["period"])))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = found.select("*", longest.alias("best")).select(
        "*", (-F.col("best.col2")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.col3")).alias("period"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
