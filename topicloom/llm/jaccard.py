"""N-gram Jaccard join, size-aware: small sets meet in enumerated subsets, large sets in scanned inverted lists.

A document's set holds the hashes (64 bits) of its distinct word n-grams. Documents with equal sets are one class, told by a
64-bit hash of the set, before anything is compared. Two classes link when the Jaccard similarity of their sets is at least
``percent``/100; for sizes a <= b that means a common part of at least ``overlap(a, b)``.

* **Small sets** (up to a boundary chosen by cost): every set gives all its subsets of ``overlap(a, b)`` elements, for each size
  it may link with. Sets in the same list of such a subset are all linked, so a star of links per list is complete.
* **Large sets** give the first elements of their set in one order for all, rare elements first. Linked sets share one of
  those, so they meet in its inverted list.
* **Lists.** Round 1 compares every member of a list with one member. Members already linked, directly or not, count as one
  from then on. Round 2 looks inside the lists that still hold several such groups and compares each member with its
  nearest one of another group; round 3 compares all members of different groups. Inside a list, pairs are tested where
  they lie, by size and by a parity map that bounds the difference from below; only pairs that may link leave it. Maps have at
  least half as many bits as the sets have elements, so unrelated sets of any size differ in more bits than linked ones can.
  Long lists are cut into blocks. So groups of near copies give links in proportion to their size, not to its square.
* **Exact check.** Every pair that leaves a list is decided on its two whole texts.

Order and boundary change the work, never the result. Frequent elements are counted over all documents, and the table of them
that is broadcast has at most MAX_FREQUENT rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.llm.common import pick, unpacked, with_row
from topicloom.llm.textbytes import hashed_blocks, mix
from topicloom.operators.graph import components
from topicloom.session import few, materialize

#: An element is frequent from FREQUENT counted copies on; if more than MAX_FREQUENT would be, from so many on that no more are.
FREQUENT, MAX_FREQUENT = 16, 1 << 20
#: Copies of an element in one task's buffer below which it is not counted, and elements per buffer.
LEAST_LOCAL, BUFFER = 3, 4 << 20
#: Bits of the parity map that sets of up to twice as many elements have in lists, and members of a block of a list.
FOLD_BITS, BLOCK = 512, 2048
#: Pairs that a task holds before it gives them on.
MOST_PAIRS = 1 << 18
#: So many ids of texts to fetch are broadcast (16 bytes each); more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Rows of small steps that share a task and a file, where rows hold maps and where they hold texts.
MAPS_AT_ONCE, TEXTS_AT_ONCE = 20_000, 2_000
#: Sizes up to which subsets are thought of at all: sets of 16 already have thousands.
LARGEST_SMALL = 16
#: What scanning one list entry costs, in enumerated subsets.
LIST_COST = 8


def overlap(a: int, b: int, percent: int) -> int:
    """Least common part of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Elements that a set of n shows: linked sets share one of them."""
    return n + (-percent * n // 100) + 1


def subset_plan(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(a, b, subset size) for every pair of sizes in which a set of n may link."""
    sizes = [m for m in range(1, 2 * n + 2) if 100 * min(m, n) >= percent * max(m, n)]
    return [(min(m, n), max(m, n), overlap(m, n, percent)) for m in sizes]


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """Largest size of a small set, by the cost of subsets below it and of list entries above; ``sizes``: sets per size."""

    def cost(bound: int) -> int:
        small = sum(c * sum(math.comb(n, o) for _, _, o in subset_plan(n, percent)) for n, c in sizes.items() if n <= bound)
        large = sum(c * prefix_length(n, percent) for n, c in sizes.items() if 100 * n > percent * bound and n <= 2 * LARGEST_SMALL)
        return small + LIST_COST * large

    return min(range(LARGEST_SMALL + 1), key=cost)


def text_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text, the sorted hashes of its distinct n-grams; fewer words than n are one n-gram, no word gives none."""
    for _, _, words, counts in hashed_blocks(texts):
        grams = words * np.uint64(3)
        last = len(words) - n + 1
        if last > 0:
            grams = mix(grams[:last])
            for j in range(1, n):
                grams = mix(grams + words[j : last + j])
        at = 0
        for count in counts.tolist():
            if count >= n:
                part = np.sort(grams[at : at + count - n + 1])
                yield part[np.concatenate(([True], part[1:] != part[:-1]))]
            elif count:
                h = np.zeros(1, np.uint64)
                for w in words[at : at + count]:
                    h = mix(h * np.uint64(5) + w)
                yield mix(h + np.uint64(count))
            else:
                yield words[:0]
            at += count


def set_id(elements: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit number."""
    return int(mix(mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(elements))).view(np.int64)[0])


def parity_map(elements: np.ndarray) -> np.ndarray:
    """One bit per bucket of elements, the parity of its number: maps of two sets differ in no more bits than the sets in elements.

    As bytes. A map has at least as many bits as the set has elements, a power of 2; folding it gives the map of fewer buckets.
    """
    bits = max(FOLD_BITS, 1 << (len(elements) - 1).bit_length()) if len(elements) else FOLD_BITS
    return np.packbits(np.bincount((elements >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1)


def folded(parity: np.ndarray, size: int) -> np.ndarray:
    """The map of ``size`` bytes."""
    return np.bitwise_xor.reduce(parity.reshape(-1, size), axis=0)


def as_words(maps: pa.Array) -> np.ndarray:
    """Maps of one size as rows of 64-bit words."""
    raw = maps.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64).reshape(len(raw), -1)


def map_widths(n: Column, percent: int) -> Column:
    """Bytes of the maps in which a set of ``n`` elements is compared inside lists.

    Sets of up to 2 * FOLD_BITS elements use FOLD_BITS bits, those of 2^c + 1 to 2^(c + 1) use 2^c. A set that may link with one of the next
    class is compared there, too; its whole map has enough bits for that if linked sizes are at most doubles, else all use FOLD_BITS.
    """
    if percent < 50:
        return F.array(F.lit(FOLD_BITS // 8))

    def width(size: Column) -> Column:
        return F.when(size <= 2 * FOLD_BITS, F.lit(FOLD_BITS // 8)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(size - 1)) - 4).cast("int"))

    return F.array_distinct(F.array(width(n), width(F.floor(100 * n / F.lit(percent)))))


def at_width(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their maps folded to their widths."""
    for batch in batches:
        maps = [folded(np.frombuffer(m, np.uint8), w).tobytes() for m, w in zip(batch.column("map").to_pylist(), batch.column("width").to_pylist(), strict=True)]
        yield batch.set_column(batch.schema.get_field_index("map"), "map", pa.array(maps, pa.binary()))


def of_one_width(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one width, which stand together."""
    for batch in batches:
        widths = batch.column("width").to_numpy()
        cuts = [0, *(np.flatnonzero(widths[1:] != widths[:-1]) + 1).tolist(), len(widths)]
        for low, high in itertools.pairwise(cuts):
            if high > low:
                yield batch.slice(low, high - low)


SKETCH = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("n", pa.int64()), ("map", pa.binary()), ("fold", pa.binary()), ("element", pa.int64()), ("copies", pa.int64())])


def sketches(base: DataFrame, n: int) -> DataFrame:
    """A row per document (doc_id, cid, n, map, fold), and rows (element, copies) for elements that are frequent within a buffer."""

    def frequent(buffer: list[np.ndarray]) -> pa.RecordBatch:
        elements, copies = np.unique(np.concatenate(buffer), return_counts=True)
        often = copies >= LEAST_LOCAL
        left = {"element": pa.array(elements[often].view(np.int64)), "copies": pa.array(copies[often].astype(np.int64))}
        return pa.RecordBatch.from_arrays([left.get(f.name, pa.nulls(int(often.sum()), f.type)) for f in SKETCH], schema=SKETCH)

    def run(batches):
        buffer, held = [], 0
        for batch in batches:
            ids, sizes, maps, folds = [], [], [], []
            for s in text_sets(batch.column("text"), n):
                ids.append(set_id(s))
                sizes.append(len(s))
                parity = parity_map(s)
                maps.append(parity.tobytes())
                folds.append(folded(parity, FOLD_BITS // 8).tobytes())
                buffer.append(s)
                held += len(s)
                if held >= BUFFER:
                    yield frequent(buffer)
                    buffer, held = [], 0
            left = {"doc_id": batch.column("doc_id"), "cid": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "map": pa.array(maps, pa.binary()), "fold": pa.array(folds, pa.binary())}
            yield pa.RecordBatch.from_arrays([left[f.name] if f.name in left else pa.nulls(len(ids), f.type) for f in SKETCH], schema=SKETCH)
        if buffer:
            yield frequent(buffer)

    return base.mapInArrow(run, "doc_id long, cid long, n long, map binary, fold binary, element long, copies long")


def at_most(often: DataFrame, rows: int) -> DataFrame:
    """Of (element, copies), the most frequent, from the lowest power of 2^(1/8) on that leaves no more than ``rows``."""
    step = F.floor(F.log2("copies") * 8).cast("int")
    held = sorted(often.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"])
    kept, least = 0, None
    for r in held:
        if kept + r["count"] > rows:
            break
        kept, least = kept + r["count"], r["step"]
    return often.where(step >= least) if least is not None else often.where("false")


def entries(base: DataFrame, n: int, percent: int, small: int, often: DataFrame) -> DataFrame:
    """(list, cid) for every list a set is in. ``often``: (element, copies), bounded, most frequent last in the common order."""
    found = at_most(often, MAX_FREQUENT).orderBy("copies", "element").collect()
    shared = base.sparkSession.sparkContext.broadcast(np.array([r["element"] for r in found], np.int64).view(np.uint64))
    plans = {size: subset_plan(size, percent) for size in range(1, small + 1)}

    def run(batches):
        ranked = shared.value
        place = np.argsort(ranked)
        ordered = ranked[place]
        seen: set[int] = set()
        for batch in batches:
            lists, ids, total = [], [], 0
            for s in text_sets(batch.column("text"), n):
                size = len(s)
                if size == 0 or (cid := set_id(s)) in seen:
                    continue
                seen.add(cid)
                mine = []
                if size <= small:
                    scrambled = mix(s)
                    for a, b, o in plans[size]:
                        tag = np.uint64(a * 1000 + b)
                        sums = np.array([scrambled[list(c)].sum(dtype=np.uint64) for c in itertools.combinations(range(size), o)], np.uint64)
                        mine.append(mix(sums ^ mix(np.array([tag]))))
                if 100 * size > percent * small:
                    rank = np.zeros(size, np.int64)
                    if len(ordered):
                        at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
                        rank = np.where(ordered[at] == s, place[at] + 1, 0)
                    # s is sorted, so a stable sort by rank orders equal ranks by element
                    mine.append(s[np.argsort(rank, kind="stable")[: int(prefix_length(size, percent))]])
                mine = np.concatenate(mine)
                lists.append(mine.view(np.int64))
                ids.append(np.full(len(mine), cid, np.int64))
                total += len(mine)
                if total > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.concatenate(ids))], ["list", "cid"])
                    lists, ids, total = [], [], 0
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.concatenate(ids))], ["list", "cid"])

    return base.select("text").mapInArrow(run, "list long, cid long")


def may_link(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and whole parity maps leave possible."""
    sized = pairs.join(classes.select(F.col("cid").alias("a"), "n"), "a").join(classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b")), "b")
    sized = sized.where(100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
    both = sized.join(classes.select(F.col("cid").alias("a"), "map"), "a").join(classes.select(F.col("cid").alias("b"), F.col("map").alias("map_b")), "b")

    def run(batches):
        for batch in batches:
            total = batch.column("n").to_numpy() + batch.column("n_b").to_numpy()
            most = total - 2 * (-(-percent * total // (100 + percent)))
            keep = []
            for x, y, limit in zip(batch.column("map").to_pylist(), batch.column("map_b").to_pylist(), most.tolist(), strict=True):
                size = min(len(x), len(y))
                x, y = folded(np.frombuffer(x, np.uint8), size), folded(np.frombuffer(y, np.uint8), size)
                keep.append(int(np.bitwise_count(x ^ y).sum()) <= limit)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n", "n_b", "map", "map_b").mapInArrow(run, "a long, b long")


def open_pairs(segment, block, cross, group, size, maps, percent: int, nearest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs that may link, within segments of rows that stand together, all pairs at a distance d at a time.

    ``cross`` marks segments of which only rows of different blocks are compared. With ``nearest``, of each row the pair whose
    maps differ least: only the best so far is held, be there ever so many pairs. Else they come in pieces of about MOST_PAIRS.
    """
    left, right, held = [], [], 0
    rows = len(segment)
    #: of each row, among partners behind and before it, the fewest bits apart and the first such partner
    least, partner = np.full((2, rows), np.iinfo(np.int64).max), np.full((2, rows), -1)
    places = np.arange(rows)
    d = 0
    while True:
        d += 1
        places = places[: np.searchsorted(places, rows - d)]
        places = places[segment[places] == segment[places + d]]
        if len(places) == 0:
            break
        i, j = places, places + d
        open_ = group[i] != group[j]
        open_ &= ~cross[i] | (block[i] != block[j])
        i, j = i[open_], j[open_]
        fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
        i, j = i[fits], j[fits]
        if len(i) == 0:
            continue
        apart = np.bitwise_count(maps[i] ^ maps[j]).sum(axis=1, dtype=np.int64)
        total = size[i] + size[j]
        near = apart <= total - 2 * (-(-percent * total // (100 + percent)))
        i, j, apart = i[near], j[near], apart[near]
        if nearest:
            for side, row, other in ((0, i, j), (1, j, i)):
                closer = apart < least[side, row]
                least[side, row[closer]], partner[side, row[closer]] = apart[closer], other[closer]
        else:
            left.append(i)
            right.append(j)
            held += len(i)
            if held >= MOST_PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if nearest:
        best = np.where(least[1] < least[0], partner[1], partner[0])
        row = np.flatnonzero(best >= 0)
        pair = np.unique(np.minimum(row, best[row]) * rows + np.maximum(row, best[row]))
        yield pair // max(rows, 1), pair % max(rows, 1)
    elif held:
        yield np.concatenate(left), np.concatenate(right)


def scan_lists(rows: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b), a < b, of members of different groups that may link, out of lists cut into blocks.

    ``rows``: (list, cid, group, members), ``classes``: (cid, n, fold, map). With ``nearest``, each member of a list gives its nearest such partner only.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    cut = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("list", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cid", "group")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The nearest partners are few however coarse the maps are.
    widths = F.array(F.lit(FOLD_BITS // 8)) if nearest else map_widths(F.col("n"), percent)
    cut = cut.join(classes.select("cid", "n", "fold", *([] if nearest else ["map"])), "cid").withColumn("width", F.explode(widths))
    if nearest:
        cut = cut.withColumnRenamed("fold", "map")
    else:
        wide = cut.where(F.col("width") > FOLD_BITS // 8).drop("fold")
        cut = cut.where(F.col("width") == FOLD_BITS // 8).drop("map").withColumnRenamed("fold", "map").unionByName(wide.mapInArrow(at_width, wide.schema))
    cut = cut.repartition(parts, "width", "list", "low", "high").sortWithinPartitions("width", "list", "low", "high")
    names = ("width", "list", "low", "high", "block", "cid", "group", "n")
    key = names[:4]

    def pairs(columns: dict[str, np.ndarray], maps: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.zeros(len(maps), bool)
        for c in key:
            new[1:] |= columns[c][1:] != columns[c][:-1]
        for i, j in open_pairs(np.cumsum(new), columns["block"], columns["low"] != columns["high"], columns["group"], columns["n"], maps, percent, nearest):
            found = np.sort(np.stack((columns["cid"][i], columns["cid"][j]), axis=1), axis=1)
            found = np.unique(found, axis=0) if len(found) else found
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches):
        held, held_maps = {c: np.zeros(0, np.int64) for c in names}, np.zeros((0, 0), np.uint64)
        for batch in of_one_width(batches):
            maps = as_words(batch.column("map"))
            if held_maps.shape[1] != maps.shape[1]:
                if len(held_maps):
                    yield from pairs(held, held_maps)
                held, held_maps = {c: np.zeros(0, np.int64) for c in names}, maps[:0]
            held = {c: np.concatenate((held[c], batch.column(c).to_numpy())) for c in names}
            held_maps = np.concatenate((held_maps, maps))
            # The last list may go on in the next batch.
            last = np.ones(len(held_maps), bool)
            for c in key:
                last &= held[c] == held[c][-1]
            whole = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            if whole:
                yield from pairs({c: x[:whole] for c, x in held.items()}, held_maps[:whole])
                held, held_maps = {c: x[whole:] for c, x in held.items()}, held_maps[whole:]
        if len(held_maps):
            yield from pairs(held, held_maps)

    cut = cut.select(*names, "map")
    return cut.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, base: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Of stored pairs, those that do link, decided on whole texts, which are fetched by the id of one document of each class."""
    tested = pairs.count()
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    ids = classes.select("cid", F.col("doc_id").alias("rep")).join(ids, "cid", "left_semi")
    ids = materialize(few(ids, classes.count() + 2 * tested), "wanted")
    fetched = ids.count()
    wanted = F.broadcast(ids) if fetched <= MOST_SENT else ids
    texts = base.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "text")
    # Equal ids may stand at several texts, but only those of the class are left.
    texts = materialize(few(of_class(texts, n).dropDuplicates(["cid"]), fetched, TEXTS_AT_ONCE), "texts")
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                keep = []
                for x, y in zip(text_sets(part.column("text_a"), n), text_sets(part.column("text_b"), n), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return few(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), tested, TEXTS_AT_ONCE)


def join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, cid, cluster) per document; ``component_id`` is the smallest doc_id reachable over links.

    ``cid`` is the hash of the document's set, ``cluster`` the smallest cid reachable.
    Words are runs of characters other than ASCII white space, A-Z lowered. Fewer words than ``n`` are one n-gram. Texts that are
    null or without words have the empty set and link with nothing: their component is their own id. Ids are long numbers; a null
    id is never smallest, and a group of null ids only has a null component. Repeated rows are linked documents. An empty table
    gives no rows. Other columns are ignored.
    """
    base = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = materialize(sketches(base, n), "sketches")
    own = rows.where("cid is not null")
    classes = own.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("map").alias("map"), F.first("fold").alias("fold"))
    classes = materialize(few(classes, rows.count(), MAPS_AT_ONCE), "classes")
    by_size = {r["n"]: r["count"] for r in classes.where(F.col("n") <= 2 * LARGEST_SMALL).groupBy("n").count().collect()}
    small = choose_boundary(by_size, percent)
    often = rows.where("element is not null").groupBy("element").agg(F.sum("copies").alias("copies")).where(F.col("copies") >= FREQUENT)

    inside = W.partitionBy("list")
    met = entries(base, n, percent, small, often).withColumn("first", F.min("cid").over(inside)).withColumn("last", F.max("cid").over(inside))
    met = materialize(met.where("first <> last").drop("last").distinct(), "lists")

    # Round 1: every member of a list against one of them.
    pairs = met.where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b")).distinct()
    most = met.count() + classes.count()
    tested = materialize(few(may_link(pairs, classes, percent), most, MAPS_AT_ONCE), "pairs")
    links = materialize(verified(tested, base, classes, n, percent), "links")

    # Rounds 2 and 3: only lists that still hold several groups, and pairs not tested yet.
    nodes = materialize(few(met.select("cid").distinct(), most), "nodes")
    grouped = lambda: materialize(few(components(links, nodes, "cid", links.count()), most), "groups")
    group = grouped()
    for nearest in (True, False):
        open_lists = met.select("list", "cid").join(group, "cid").withColumnRenamed("component", "group")
        open_lists = open_lists.withColumn("first", F.min("group").over(inside)).withColumn("last", F.max("group").over(inside))
        open_lists = open_lists.withColumn("members", F.count(F.lit(1)).over(inside)).where("first <> last")
        pairs = scan_lists(open_lists.select("list", "cid", "group", "members"), classes, percent, nearest)
        pairs = materialize(may_link(pairs.join(tested, ["a", "b"], "left_anti"), classes, percent), "pairs")
        tested = tested.unionByName(pairs)
        more = materialize(verified(pairs, base, classes, n, percent), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            group = grouped()

    smallest = classes.join(group, "cid").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = group.join(smallest, "component").select("cid", "component_id", F.col("component").alias("cluster"))
    known = classes.select("cid", F.col("doc_id").alias("rep")).join(linked, "cid", "left")
    known = known.select("cid", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("cluster", "cid").alias("cluster"))
    out = own.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(known, "cid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "cid", "cluster")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group: the one with the smallest id (a null id comes last).

    Documents without words are in no group and all stay. Of repeated rows one stays.
    """
    joined = join(docs, n, percent, id_col, text_col).where("n_shingles > 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cid")
    rows_of = joined.groupBy("cluster", "doc_id", "cid").agg(F.count(F.lit(1)).alias("times"))
    stays = rows_of.groupBy("cluster").agg(F.min_by(F.struct("doc_id", "cid", "times"), order).alias("row"))
    stays = stays.select(F.col("row.doc_id").alias("kept_id"), F.col("row.cid").alias("kept_cid"), F.col("row.times").alias("times"))
    stays = materialize(few(stays, docs.count()), "stays")
    sent = F.broadcast(stays) if stays.count() <= MOST_SENT else stays
    rows = with_set_id(with_row(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")), n)
    found = rows.join(sent, F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("cid").eqNullSafe(F.col("kept_cid")), "left").where("kept_cid is not null or cid is null")
    # Only rows that stand there several times have to meet.
    repeated = F.coalesce(F.col("times") > 1, F.lit(False))
    if not stays.where(repeated).isEmpty():
        found = found.where(~repeated).unionByName(found.where(repeated).dropDuplicates(["doc_id", "cid"]))
    return unpacked(found, docs.columns)


def with_set_id(rows: DataFrame, n: int) -> DataFrame:
    """Adds the hash of the text's set, null for the empty one, and drops the text."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        for batch in batches:
            ids = [set_id(s) if len(s) else None for s in text_sets(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(ids, pa.int64())], [*kept, "cid"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInArrow(run, f"{kinds}, cid long")


def of_class(rows: DataFrame, n: int) -> DataFrame:
    """The rows (cid, text) whose text has the set ``cid``; an id may stand at several texts."""

    def run(batches):
        for batch in batches:
            same = [set_id(s) == c for s, c in zip(text_sets(batch.column("text"), n), batch.column("cid").to_pylist(), strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    return rows.mapInArrow(run, "cid long, text string")
