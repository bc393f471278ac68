"""Byte-level BPE by merge replay over a corpus of distinct words.

Each task takes its texts in blocks. The distinct pieces of a block (runs between single blanks) are split by the
vocabulary's pattern; the distinct words not seen before form the corpus of the replay: all their bytes in one linked list, and
an inverted index from the rank of a token pair to its positions. Ranks are replayed from the lowest; a merge touches
only its two neighbours, whose new pairs enter the index. Encodings of pieces are kept and put together per text.

Words do not depend on each other, so every block gives what one replay over all words would give; nothing is shuffled, and a
lost executor costs only its own tasks. The vocabulary is a fixed file of at most MAX_TOKENS entries and is broadcast.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from topicloom.llm.common import pick

#: Proven bound of what is broadcast; token ids of a pair are packed into one number with so many bits each.
BITS = 17
MAX_TOKENS = 1 << BITS

#: Bytes of text per block, and bytes of encodings kept by a task before it starts anew: both bound a worker's memory only.
BLOCK_BYTES = 3 << 20
KEPT_BYTES = 80 << 20
#: Bytes that an encoding takes besides its characters: a string, bytes, and an entry of two dictionaries.
EACH_BYTES = 320


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank, out of a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))) or len(ranks) > MAX_TOKENS:
        raise ValueError(f"ranks must be 0..n-1 with n <= {MAX_TOKENS}")
    return [ranks[i] for i in range(len(ranks))]


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.split = tokens, regex.compile(pattern).findall
        rank = {t: i for i, t in enumerate(tokens)}
        self.byte = [rank[bytes([b])] for b in range(256)]
        #: rank of the merged token by pair; any split of a token into two tokens can be merged into it
        self.merged = {
            rank[t[:i]] << BITS | rank[t[i:]]: r for r, t in enumerate(tokens) for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        self.keys = np.array(sorted(self.merged), np.int64)
        self.values = np.array([self.merged[k] for k in self.keys.tolist()], np.int32)
        self.decimal = [str(i) for i in range(len(tokens))]
        self.forget()

    def forget(self) -> None:
        #: decimal ids joined by blanks, and the bytes decoded from them, of words and of pieces
        self.words: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.spaced: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.first: tuple[dict[str, str], dict[str, bytes]] = ({}, {})
        self.kept = 0

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it can't be merged."""
        key = left.astype(np.int64) << BITS | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def replay(self, words: list[str]) -> list[list[int]]:
        """Token ids of each word, by replaying all merges over all words in rank order."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw])
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(data)
        token = np.array(self.byte, np.int32)[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[starts + lengths - 1] = -1
        before[starts] = -1
        pair = np.full(n, -1, np.int32)  # rank of the pair that begins here
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> np.ndarray:
            """Rank the pairs that begin at ``places`` and put them into the index; returns the ranks."""
            ranks = self.ranks_of(token[places], token[after[places]])
            pair[places] = ranks
            found = ranks >= 0
            places, known = places[found], ranks[found]
            if len(known) == 0:
                return ranks
            order = np.argsort(known, kind="stable")
            places, known = places[order], known[order]
            cuts = np.flatnonzero(known[1:] != known[:-1]) + 1
            for r, part in zip(known[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)
            return ranks

        enter(np.flatnonzero(after >= 0).astype(np.int32))
        merged_away = np.zeros(n, bool)
        odd: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            places = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            places = places[pair[places] == r]  # a neighbour may have changed since
            if len(places) == 0:
                continue
            right = after[places]
            if token[places[0]] == token[right[0]]:  # equal tokens in a row: every second one, from the left
                places = every_second(places, right)
                right = after[places]
            to_come = self.merged.get(r << BITS | int(token[places[0]]), r)
            far = after[right]
            token[places], after[places], pair[right], pair[places] = r, far, -1, -1
            merged_away[right] = True
            inner = far >= 0
            before[far[inner]] = places[inner]
            left = before[places]
            changed = np.unique(np.concatenate((places[inner], left[left >= 0])))
            ranks = enter(changed)
            low = (ranks >= 0) & (ranks < r)
            if to_come < r:
                odd.append(places)
            elif low.any():
                odd.append(changed[low])
        out = []
        alive = ~merged_away
        ids = token[alive].tolist()
        ends = np.cumsum(np.add.reduceat(alive.astype(np.int64), starts)).tolist()
        low = 0
        for end in ends:
            out.append(ids[low:end])
            low = end
        for w in np.unique(np.searchsorted(starts, np.concatenate(odd), side="right") - 1).tolist() if odd else []:
            out[w] = self.one_by_one(raw[w])
        return out

    def one_by_one(self, word: bytes) -> list[int]:
        """Token ids of one word, always merging its leftmost pair of the lowest rank.

        For the few words in which a merge gave a pair of a lower rank than its own: there the order counts, place by place.
        """
        ids = [self.byte[b] for b in word]
        while True:
            ranks = [self.merged.get(a << BITS | b, MAX_TOKENS) for a, b in zip(ids, ids[1:], strict=False)]
            best = min(ranks, default=MAX_TOKENS)
            if best == MAX_TOKENS:
                return ids
            at = ranks.index(best)
            ids[at : at + 2] = [best]

    def learn(self, pieces: set[str], lead: str, known: tuple[dict[str, str], dict[str, bytes]]) -> None:
        """Add the encodings of ``lead`` + piece to ``known``."""
        split = {}
        for piece in pieces.difference(known[0]):
            # Letters alone are one word of the pattern.
            split[piece] = [lead + piece] if piece.isalpha() else self.split(lead + piece)
        texts, raws = self.words
        new = list(set(chain.from_iterable(split.values())).difference(texts))
        decimal, decode = self.decimal.__getitem__, self.decode
        for word, ids in zip(new, self.replay(new), strict=True):
            texts[word] = " ".join(map(decimal, ids))
            raws[word] = decode(ids)
            self.kept += EACH_BYTES + len(word) + len(texts[word]) + len(raws[word])
        for piece, parts in split.items():
            known[0][piece] = texts[parts[0]] if len(parts) == 1 else " ".join([texts[w] for w in parts])
            known[1][piece] = raws[parts[0]] if len(parts) == 1 else b"".join([raws[w] for w in parts])
            self.kept += EACH_BYTES if len(parts) == 1 else EACH_BYTES + len(piece) + len(known[0][piece]) + len(known[1][piece])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Per text, its decimal ids joined by blanks, and the bytes decoded from them."""
        if self.kept > KEPT_BYTES:
            self.forget()
        cut = [text_pieces(t) for t in texts]
        self.learn({p[0] for p in cut if p}, "", self.first)
        self.learn(set(chain.from_iterable([p[1:] for p in cut])), " ", self.spaced)
        ids, raw = self.spaced[0].__getitem__, self.spaced[1].__getitem__
        for p in cut:
            if p:
                lead, rest = p[0], p[1:]
                yield " ".join([self.first[0][lead], *map(ids, rest)]), b"".join([self.first[1][lead], *map(raw, rest)])
            else:
                yield "", b""


def every_second(places: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of places that follow one another (the next is the right neighbour), the first, third and so on of each run."""
    follows = np.concatenate(([False], right[:-1] == places[1:]))
    at = np.arange(len(places))
    begin = np.maximum.accumulate(np.where(follows, 0, at))
    return places[(at - begin) % 2 == 0]


#: A blank beside white space, in every way.
LOOSE = ["  ", *[pair for c in map(chr, range(0x3001)) if c.isspace() and c != " " for pair in (f" {c}", f"{c} ")]]


def text_pieces(text: str) -> list[str]:
    """The text cut at blanks that have no white space on either side; no word of the pattern reaches over such a cut."""
    if not text:
        return []
    pieces = text.split(" ")
    if not (text[0].isspace() or text[-1].isspace() or any(pair in text for pair in LOOSE)):
        return pieces
    out = [[pieces[0]]]
    for left, right in zip(pieces, pieces[1:], strict=False):
        if left and right and not left[-1].isspace() and not right[0].isspace():
            out.append([right])
        else:
            out[-1].append(right)
    return [" ".join(group) for group in out]


CODECS: dict[tuple, Codec] = {}


def codec(tokens: list[bytes], pattern: str) -> Codec:
    """One codec per worker process and vocabulary."""
    key = (hashlib.sha256(b"\n".join(tokens)).digest(), pattern)
    if key not in CODECS:
        CODECS[key] = Codec(tokens, pattern)
    return CODECS[key]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts in blocks of about BLOCK_BYTES, cut before texts become strings; a longer text is a block of its own."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(size), 0
        while start < len(ends):
            used = ends[start] - size[start]
            stop = max(start + 1, int(np.searchsorted(ends, used + BLOCK_BYTES, side="right")))
            part = batch.slice(start, stop - start)
            yield part.column("doc_id"), [t or "" for t in part.column("text").to_pylist()]
            start = stop


def length_of(decimal: str) -> int:
    return decimal.count(" ") + 1 if decimal else 0


def digested(ids: pa.Array, encoded: Iterator[tuple[str, bytes]]) -> pa.RecordBatch:
    """Counts and digests of encoded texts."""
    rows = [(length_of(decimal), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()) for decimal, decoded in encoded]
    counts, left, right = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def spelled(ids: pa.Array, encoded: Iterator[tuple[str, bytes]]) -> pa.RecordBatch:
    """Counts, token ids and decoded bytes of encoded texts; the ids of all texts are one array."""
    decimals, decoded = zip(*encoded, strict=True)
    counts = np.array([length_of(d) for d in decimals], np.int64)
    values = np.fromstring(" ".join(filter(None, decimals)), np.int32, sep=" ")
    tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values))
    return pa.RecordBatch.from_arrays([ids, pa.array(counts), tokens, pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])


def tokenize(docs: DataFrame, tokens: list[bytes], pattern: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded binary) per document; with ``digests``, SHA-256 of both in their place.

    ``decode`` gives ids back as bytes.
    ``ids_sha256`` is taken over the decimal ids joined by one blank. Nulls: a null text counts as empty and has no token; ids may be
    null. Repeated rows are encoded each. An empty table gives no rows. Other columns are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col)
    vocabulary = docs.sparkSession.sparkContext.broadcast(tokens)
    kind = base.schema["doc_id"].dataType.simpleString()

    def run(batches):
        gc.disable()  # millions of small objects without cycles; the worker's memory is bounded by blocks
        try:
            own = codec(vocabulary.value, pattern)
            for ids, texts in blocks(batches):
                yield digested(ids, own.encode(texts)) if digests else spelled(ids, own.encode(texts))
        finally:
            gc.enable()

    ends = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    return base.mapInArrow(run, f"doc_id {kind}, n_tokens long, {ends}")
