"""WARC archives: write captures as linked records, read archives back, put each capture together again.

A page becomes three records of one archive file: its response (or a revisit, if an earlier record holds the same payload), the
request and a metadata record; the last two name the first in WARC-Concurrent-To. Spark's text writer makes the files,
a gzip member per record, of at most about ``file_bytes`` before compression. Spark's binary reader brings archives back, ours and
others: members are inflated one after the other, records cut out by their Content-Length, so payloads may hold any bytes. What is
damaged gives a row that says so. Captures are put together by joins on record identifiers.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import pick, salted_join
from topicloom.session import materialize, step_scope, work_path

#: Fixed by the WARC 1.1 standard.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Fixed by the gzip format: a member with nothing in it. The text writer puts it between two records.
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00" + bytes(8)

#: Smaller payloads are always stored.
LEAST_SHARED = 100

#: Request, response or revisit, and metadata.
RECORDS_OF_PAGE = 3

#: Pages of more than so many mean payloads are dealt out among the archives.
LARGE = 8

#: Bits of the map of shared payloads that comes to the pages; it is broadcast in words of 64, so a task holds at most 262,144 of them.
MAP_BITS = 1 << 24


def record_id(row: Column, kind: str) -> Column:
    """A URN from the row number and the kind of record; the same on every attempt of a task."""
    h = F.md5(F.concat_ws(":", F.lit(kind), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[F.concat(F.substring(h, at, n), F.lit(end)) for at, n, end in ((1, 8, "-"), (9, 4, "-"), (13, 4, "-"), (17, 4, "-"), (21, 12, ">"))])


def record(kind: str | Column, block: Column, headers: dict[str, Column]) -> Column:
    """One record without its closing blank lines; headers that are null are left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def stored_pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, payload_bytes, digest, row_id), written so that a row keeps its number."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return materialize(pick(pages, page_id=id_col, url=url_col, html=html_col).select(
        "page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
        F.unhex(F.sha2(html.cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row_id")), "pages")


def shared_payloads(stored: DataFrame) -> DataFrame:
    """(digest, first_row): payloads that several rows hold, and that of them with the smallest page_id. Only digests are shuffled."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_id")
    narrow = stored.where(F.col("payload_bytes") >= LEAST_SHARED).select("row_id", "page_id", "digest")
    return narrow.groupBy("digest").agg(F.min(order)["row_id"].alias("first_row"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def with_maybe_shared(stored: DataFrame, shared: DataFrame) -> DataFrame:
    """Adds ``maybe_shared``: false says that no other row holds the payload, true may be chance. Nothing is shuffled."""
    place = F.xxhash64("digest").bitwiseAND(MAP_BITS - 1)
    word, bit = F.shiftright(place, 6), place.bitwiseAND(63).cast("int")
    words = shared.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    met = stored.withColumn("_at", word).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    held = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False)) & (F.col("payload_bytes") >= LEAST_SHARED)
    return met.withColumn("maybe_shared", held).drop("_at", "_word", "_bits")


def revisits(maybe: DataFrame, shared: DataFrame) -> DataFrame:
    """(row_id, first_row) of the rows whose payload an earlier row holds."""
    narrow = maybe.select("row_id", "digest")
    return salted_join(narrow, shared, "digest", F.col("row_id"), how="inner").where("row_id <> first_row").select("row_id", "first_row")


def write(
    pages: DataFrame, path: str, file_bytes: int = 32 << 20, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Write every page as request, response or revisit, and metadata.

    Of pages with equal payloads of at least 100 bytes, that with the smallest page_id is the response, the others are
    revisits; among repeated page_ids the first row is. Null page_ids come after all others. A null html is an empty payload,
    a null url leaves the target header out. An empty table writes no record. Other columns are ignored.
    """
    with step_scope(pages.sparkSession):  # the stored pages go when the archives stand
        write_stored(stored_pages(pages, id_col, url_col, html_col), path, file_bytes, date)


def write_stored(stored: DataFrame, path: str, file_bytes: int, date: str) -> None:
    """Archives of ``stored_pages``."""
    size = stored.agg(F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("pages")).first()
    shared = materialize(shared_payloads(stored), "shared")
    # Pages whose payload is surely their own are written where they lie. The others move once, dealt to files by row, and the narrow
    # table of revisits comes to them; so do pages so large that neighbours like them would make an archive too large.
    moves = F.col("maybe_shared") | (F.col("payload_bytes") * size["pages"] > LARGE * size["bytes"])
    tagged = with_maybe_shared(stored, shared).withColumn("moves", moves)
    moved_bytes = tagged.where("moves").agg(F.sum("payload_bytes")).first()[0] or 0
    # With fewer parts than a shuffle has by default, Spark would deal both sides anew.
    files = max(-(-moved_bytes // file_bytes), int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    moved = tagged.where("moves").repartition(files, "row_id").join(revisits(tagged.where("maybe_shared"), shared), "row_id", "left")
    dealt = tagged.where("not moves").withColumn("first_row", F.lit(None).cast("long")).unionByName(moved)
    revisit = F.col("first_row").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")
    own = record_id(F.col("row_id"), "capture")
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rest = F.regexp_extract(target, r"://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract(target, r"://([^/?#]*)", 1)
    status = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    asked = F.concat(F.lit("GET "), F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    fields = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit("")),
        F.lit("payload-bytes: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"))
    shared = {"WARC-Date": F.lit(date), "WARC-Target-URI": target}
    records = F.array(
        record("request", F.coalesce(asked, F.lit("GET / HTTP/1.1\r\n\r\n")), {
            "WARC-Record-ID": record_id(F.col("row_id"), "request"), **shared, "WARC-Concurrent-To": own, "Content-Type": F.lit("application/http; msgtype=request")}),
        record(kind, F.when(revisit, status).otherwise(F.concat(status, F.col("html"))), {
            "WARC-Record-ID": own, **shared, "WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))),
            "WARC-Profile": F.when(revisit, F.lit(SAME_PAYLOAD)),
            "WARC-Refers-To": F.when(revisit, record_id(F.col("first_row"), "capture")), "Content-Type": F.lit("application/http; msgtype=response")}),
        record("metadata", fields, {
            "WARC-Record-ID": record_id(F.col("row_id"), "metadata"), **shared, "WARC-Concurrent-To": own, "Content-Type": F.lit("application/warc-fields")}),
    )
    packed = dealt.select(F.explode(records).alias("value")).mapInArrow(members, "member binary")
    # The writer passes bytes on as they are; in this encoding, the separator too.
    as_bytes = {"compression": "none", "encoding": "ISO-8859-1", "lineSep": EMPTY_MEMBER.decode("latin-1")}
    as_bytes["maxRecordsPerFile"] = RECORDS_OF_PAGE * max(1, size["pages"] * file_bytes // (size["bytes"] or 1))
    packed.select(F.col("member").cast("string").alias("value")).write.options(**as_bytes).text(path)


def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record, closed by its blank lines, as a gzip member."""
    for batch in batches:
        packed = (gzip.compress(value.as_py().encode() + b"\r\n\r\n", 6, mtime=0) for value in batch.column("value"))
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["member"])


RECORDS = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()),
    ("date", pa.string()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()),
    ("payload_sha256", pa.string()), ("block", pa.binary()), ("damage", pa.string()),
])
RECORDS_DDL = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, payload_digest string, "
    "fields map<string, string>, payload_bytes long, payload_sha256 string, block binary, damage string")
#: Rows and bytes of blocks in one batch of records.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def named_lines(head: bytes) -> dict[str, list[str]]:
    """Values of ``Name: value`` lines, names in lower case. A line that begins with a blank goes on with the one before."""
    named: dict[str, list[str]] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).splitlines():
        name, colon, value = line.partition(b":")
        if colon:
            named.setdefault(name.strip().lower().decode(errors="replace"), []).append(value.strip().decode(errors="replace"))
    return named


def inflated(raw: bytes, most: int = 1 << 20) -> Iterator[bytes | None]:
    """Bytes of an archive in pieces of at most ``most``, of all its gzip members if it is gzipped; None where bytes are lost.

    Of a damaged or cut-off member come the pieces before the damage; reading goes on with the next member.
    """
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[i : i + most] for i in range(0, len(raw), most))
        return
    at = 0
    while at < len(raw):
        member, fed, step, todo = zlib.decompressobj(31), at, 1 << 13, b""
        try:
            while not member.eof:
                if not todo:
                    todo = raw[fed : fed + step]
                    fed, step = fed + len(todo), min(2 * step, most)
                had = bool(todo)
                piece = member.decompress(todo, most)
                todo = member.unconsumed_tail
                if piece:
                    yield piece
                elif not had:
                    break
        except zlib.error:
            pass
        if member.eof:
            at = re.compile(rb"\0*").match(raw, fed - len(member.unused_data)).end()
        else:
            yield None
            following = raw.find(b"\x1f\x8b\x08", at + 1)
            at = len(raw) if following < 0 else following


def cut_records(pieces: Iterable[bytes], blocks: bool) -> Iterator[dict]:
    """Records of one run of bytes, as rows of RECORDS; ``blocks`` says whether their blocks are kept."""
    pieces, held = iter(pieces), bytearray()

    def find(mark: bytes, at: int) -> int:
        """Where the mark stands next, or -1; reads on until it is met."""
        while (found := held.find(mark, at)) < 0:
            at = max(at, len(held) - len(mark) + 1)
            piece = next(pieces, None)
            if piece is None:
                return -1
            held.extend(piece)
        return found

    def filled(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    def skip_damaged(at: int, damage: str, head: dict) -> dict:
        """A row for the bytes up to the next record after ``at``."""
        end = find(b"\r\nWARC/", at)
        end = len(held) if end < 0 else end
        row = as_row(head, bytes(held[:end]), blocks, damage)
        del held[:end]
        return row

    while filled(1):
        if blank := re.match(rb"[\r\n\t \0]+", held):
            blank = blank.end()
            del held[:blank]
            continue
        filled(5)
        if not held.startswith(b"WARC/"):
            yield skip_damaged(0, "no header", {})
            continue
        end = find(b"\r\n\r\n", 0)
        head = named_lines(bytes(held[:end])) if end >= 0 else {}
        length = head.get("content-length", [""])[0]
        if end < 0:
            yield skip_damaged(1, "header cut off", {})
        elif not re.fullmatch("[0-9]{1,18}", length) or "warc-type" not in head:
            yield skip_damaged(end, "no length" if "warc-type" in head else "no type", head)
        elif filled(end + 4 + int(length)):
            yield as_row(head, bytes(held[end + 4 : end + 4 + int(length)]), blocks)
            del held[: end + 4 + int(length)]
        else:
            yield as_row(head, bytes(held[end + 4 :]), blocks, "block cut off")
            held.clear()


def as_row(head: dict[str, list[str]], block: bytes, blocks: bool, damage: str | None = None) -> dict:
    """A row of RECORDS. Payloads and fields are read from whole records only."""
    value = lambda name: head.get(name, [None])[0]
    row = {
        "record_id": value("warc-record-id"), "type": value("warc-type"), "concurrent_to": head.get("warc-concurrent-to"), "refers_to": value("warc-refers-to"),
        "target_uri": value("warc-target-uri"), "date": value("warc-date"), "payload_digest": value("warc-payload-digest"),
        "fields": None, "payload_bytes": None, "payload_sha256": None, "block": block if blocks else None, "damage": damage}
    if damage is None and row["type"] == "response":
        # A response of another protocol has no header of its own.
        payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
        row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest()}
    elif damage is None and row["type"] == "metadata":
        row["fields"] = [(name, "\n".join(values)) for name, values in named_lines(block).items()]
    return row


def records_of(raw: bytes, blocks: bool) -> Iterator[dict]:
    """Records of one archive. None goes on behind a place where bytes are lost, which has a row of its own."""
    for lost, pieces in itertools.groupby(inflated(raw), lambda piece: piece is None):
        yield from (as_row({}, b"", blocks, "bytes lost") for _ in pieces) if lost else cut_records(pieces, blocks)


def read_records(spark: SparkSession, path: str, blocks: bool = False) -> DataFrame:
    """One row per record of the archives below ``path`` (RECORDS_DDL), gzipped by record or as a whole, or plain.

    A task holds one file as it is stored (below 2 GB, the limit of Spark's binary reader), one record and one batch of rows; never a whole
    file inflated. ``concurrent_to`` has every identifier named there; of other headers given twice the first counts. Values of one name in
    a metadata record are joined by line breaks.

    ``damage`` is null for whole records. Else it says what is wrong, and columns hold what could be read: ``block cut off`` and
    ``header cut off`` (by the end of the archive or of a damaged member), ``no header`` (bytes between records that begin none),
    ``no length``, ``no type``, and ``bytes lost`` for each gzip member that is damaged or cut off. Reading goes on at the next line that begins a record, or in the next member. Blank lines and zero bytes between
    records and empty archives give no row.
    """

    def cut(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in records_of(content.as_py(), blocks):
                    rows.append(row)
                    size += len(row["block"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, RECORDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORDS)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(cut, RECORDS_DDL)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, capture, request, metadata, further), structs of RECORDS columns.

    A capture is a whole response or revisit. Its request and metadata are the whole records that name it in WARC-Concurrent-To, or that it names
    there; null where there is none. Of several, those of the smallest identifier stand in ``request`` and ``metadata``, the others, in that
    order, in the array ``further``. Records that name no known capture, and damaged ones, are left out. A capture that is there twice gives two
    rows. An empty table gives none.
    """
    row = F.struct(*records.columns)
    whole = records.where("damage is null")
    main = whole.where("type in ('response', 'revisit')").select("record_id", "concurrent_to", row.alias("capture"))
    side = whole.where("type in ('request', 'metadata')").select(F.col("record_id").alias("side_id"), "concurrent_to", row.alias("side"))
    names = side.select(F.explode(F.array_distinct("concurrent_to")).alias("record_id"), "side")
    named = main.select("record_id", F.explode(F.array_distinct("concurrent_to")).alias("side_id")).distinct().join(side, "side_id")
    named = named.where(~F.coalesce(F.array_contains("concurrent_to", F.col("record_id")), F.lit(False))).select("record_id", "side")
    # What names no capture goes before anything is collected.
    told = names.unionByName(named).join(main.select("record_id"), "record_id", "left_semi")
    by_id = lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0)
    sides = told.groupBy("record_id").agg(F.array_sort(F.collect_list("side"), by_id).alias("sides"))
    of = lambda kind: F.filter("sides", lambda x: x["type"] == kind)
    return main.join(sides, "record_id", "left").select(
        "record_id", "capture", F.get(of("request"), F.lit(0)).alias("request"), F.get(of("metadata"), F.lit(0)).alias("metadata"),
        F.coalesce(F.concat(F.slice(of("request"), 2, 1 << 30), F.slice(of("metadata"), 2, 1 << 30)), F.slice(F.array("capture"), 2, 1)).alias("further"))


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per page, out of archives written and read back."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write(pages, path, **columns)
    # The digest of a response is that of its payload; the one it was written with is needed for revisits only.
    told = F.when(F.col("type") == "revisit", F.col("payload_digest"))
    nested = captures(materialize(read_records(spark, path).drop("target_uri", "date", "block").withColumn("payload_digest", told), "records"))
    flat = nested.select(
        "record_id", F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.coalesce("capture.payload_bytes", F.col("metadata.fields")["payload-bytes"].cast("long")).alias("payload_bytes"),
        F.coalesce("capture.payload_sha256", F.substring_index("capture.payload_digest", ":", -1)).alias("payload_digest"),
        F.col("capture.type").alias("record_type"), F.col("capture.refers_to").alias("to"))
    flat = materialize(flat, "captures")
    referred = flat.select("to").where("to is not null").distinct()
    origins = referred.join(flat.select(F.col("record_id").alias("to"), F.col("page_id").alias("refers_to")), "to")
    met = salted_join(flat, origins, "to", F.col("record_id"))
    return met.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
