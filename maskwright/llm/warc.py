"""WARC archives written and read back by Spark, with record boundaries proven by following them.

A record begins with a magic string, and its header says how long it is. But payloads may hold the magic too, even whole
records, so seeing it proves nothing. Archives are read in splits by Spark's text source, cut at every magic; each
task emits its cuts as candidates, with the place where the record that would begin there ends, its successor.
Records are what is reached from the beginning of the file from successor to successor.

Within a split the successors form a forest, which the task numbers so that "lies on the way from" is a comparison of
numbers, and each candidate learns where its way leaves the split. So only the places where ways enter a split, about one
for each split, take part in pointer jumping over the whole file: in round k everything 2**k splits ahead is reached.
Where a split begins is the sum of what the splits before it hold, as the cuts and the magic between them are the file.

Equal payloads are stored once: later records revisit the first. The sink is Spark's text sink, as a record is text with
an end of its own; so archives go to whatever store the path names, file by file committed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.operators.skew import broadcast_if_small, hot_split_join
from maskwright.session import written

MAGIC = "WARC/1."
END = "\r\n\r\n"
LEAST_BYTES = 100
BROADCAST_GROUPS = 200_000
KEY = "urn:page:"
DATE = "1970-01-01T00:00:00Z"

_CUT, _GAP = MAGIC.encode(), END.encode()
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)
_HEADER = (
    "kind string, id string, refers string, uri string, declared string, payload_bytes long, payload_digest string"
)


def _firsts(pages: DataFrame, key: str, html: str, least: int) -> DataFrame:
    """For payloads of at least `least` bytes that more than one row has: digest and smallest key."""
    keyed = pages.select(F.col(f"`{key}`").alias("k"), F.sha2(F.col(f"`{html}`"), 256).alias("digest"), F.octet_length(F.col(f"`{html}`")).alias("n"))
    groups = keyed.filter(F.col("n") >= least).groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    return groups.filter("n > 1").select("digest", "first")


def _line(name: str, value: Column) -> Column:
    """A header line; nothing for NULL. Line ends inside the value are written as blanks."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def write_archive(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_BYTES
) -> None:
    """One record for each row, in files below `path`, which must not be there yet; other columns are ignored.

    The payload is the html in UTF-8; NULL counts as empty. Of the rows with one payload of at least `least` bytes, that
    with the smallest key is a response and the others revisit it; rows without a key revisit as well, unless no row of
    the group has one, and rows that repeat the smallest key are responses. Shorter payloads are always responses. A record
    without a key has an id that ends with the colon; one without a URL has no target. An empty table gives an empty
    archive.
    """
    groups = written(_firsts(pages, key, html, least), "warc-firsts")
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").alias("k"), F.col(f"`{url}`").alias("url"), body.alias("body"), F.sha2(body, 256).alias("digest"))
    groups, small = broadcast_if_small(groups, BROADCAST_GROUPS)
    if small:
        rows = rows.join(groups, "digest", "left")
    else:
        rows = hot_split_join(rows, groups, ["digest"], ["k"])
    again = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("body").cast("string"),
        F.lit(END),
    )
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    header = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        F.when(again, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.lit(f"WARC-Record-ID: <{KEY}"),
        F.coalesce(F.col("k").cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        _line("WARC-Target-URI", F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n")),
        F.when(
            again,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                F.lit(f"WARC-Refers-To: <{KEY}"),
                F.col("first").cast("string"),
                F.lit(">\r\n"),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    # the sink puts the end of a record behind each row
    rows.select(F.concat(header, block)).write.option("lineSep", END).text(path)


def _fields(lines: bytes) -> dict[bytes, bytes]:
    return {name.lower(): value.rstrip(b"\r") for name, value in _FIELD.findall(lines)}


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def _name(value: bytes | None) -> str | None:
    return None if value is None else _text(value.strip(b"<>"))


def _record(cut: bytes) -> tuple[int, dict] | None:
    """Where the record that begins at this cut would end, counted from behind the magic, and its header; None if
    there is no header."""
    stop = cut.find(_GAP)
    if stop < 0 or cut[:3] not in (b"0\r\n", b"1\r\n"):
        return None
    fields = _fields(cut[3 : stop + 2])
    length = fields.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 18:
        return None
    return stop + 4 + int(length) + 4, fields


def _payload(cut: bytes, end: int, fields: dict) -> tuple[bytes, int, str | None]:
    """Payload of a whole record, its number of bytes and digest; a revisit says them instead of having it."""
    block = cut[cut.find(_GAP) + 4 : end - 4]
    size = None
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        head, _, block = block.partition(_GAP)
        size = _fields(head).get(b"content-length")
    if fields.get(b"warc-type") != b"revisit":
        return block, len(block), hashlib.sha256(block).hexdigest()
    said = _text(fields.get(b"warc-payload-digest"))
    return block, int(size) if size and size.isdigit() else len(block), said and said.partition(":")[2]


def _described(cut: bytes, end: int, fields: dict) -> tuple:
    whole = end <= len(cut)
    _, size, digest = _payload(cut, end, fields) if whole else (None, None, None)
    get = fields.get
    return (
        _text(get(b"warc-type")), _name(get(b"warc-record-id")), _name(get(b"warc-refers-to")),
        _text(get(b"warc-target-uri")), _text(get(b"warc-payload-digest")), size, digest,
    )


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, in the order of the file within each split."""
    text = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("cut"),
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """Path, split, place of the cut's magic counted from where the split's first cut begins, and the cut."""
    at, here = 0, None
    for batch in batches:
        for path, block, cut in zip(*[c for c in batch.columns], strict=True):
            where = path.as_py(), block.as_py()
            if where != here:
                at, here = 0, where
            cut = cut.as_py()
            yield *where, at - len(_CUT), cut
            at += len(cut) + len(_CUT)


def _forest(at: np.ndarray, following: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Of candidates in the order of the file: where the way from each leaves the split, its number and how many
    candidates lead through it. The way from e passes x if first[x] <= first[e] < first[x] + through[x]."""
    n = len(at)
    spot = np.minimum(np.searchsorted(at, following), max(n - 1, 0))
    parent = [int(p) if a == f else -1 for p, a, f in zip(spot, at[spot], following, strict=True)] if n else []
    leave, through, first = following.tolist(), [1] * n, [0] * n
    for i in range(n):
        if parent[i] >= 0:
            through[parent[i]] += through[i]
    free, top = [0] * n, 0
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            leave[i] = leave[parent[i]]
            first[i] = free[parent[i]]
            free[parent[i]] += through[i]
        else:
            first[i] = top
            top += through[i]
        free[i] = first[i] + 1
    return leave, first, through


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row for each cut, without its bytes: the split and place, and for candidates successor, way out and header."""
    schema = f"path string, block long, at long, n long, following long, leave long, first long, through long, {_HEADER}"
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.string() if "string" in f else pa.int64() for f in schema.split(", ")]

    def finish(rows: list[list]) -> Iterator[pa.RecordBatch]:
        mine = [r for r in rows if r[4] is not None]
        found = _forest(np.array([r[2] for r in mine], np.int64), np.array([r[4] for r in mine], np.int64))
        for row, *numbers in zip(mine, *found, strict=True):
            row[5:8] = numbers
        for i in range(0, len(rows), 10_000):
            columns = zip(*rows[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, rows = None, []
        for file, block, at, cut in _in_order(batches):
            if (file, block) != here:
                yield from finish(rows)
                here, rows = (file, block), []
            found = _record(cut) if at >= 0 or block else None
            if found:
                end, fields = found
                rows.append([file, block, at, len(cut), at + len(_CUT) + end, None, None, None, *_described(cut, end, fields)])
            else:
                rows.append([file, block, at, len(cut), *[None] * (len(names) - 4)])
        yield from finish(rows)

    return _cuts(spark, path).mapInArrow(run, schema)


def _reached(ways: DataFrame) -> DataFrame:
    """The places from which a split's records are read, by pointer jumping: round k reaches 2**k splits further."""
    nodes = written(ways, "warc-ways")
    found = nodes.filter("offset = 0").select("path", "offset")
    ends = nodes.select("path", F.col("offset").alias("leave"))
    jump = written(nodes.select("path", "offset", "leave").join(ends, ["path", "leave"]), "warc-jumps")
    while not jump.isEmpty():
        ahead = found.join(jump, ["path", "offset"]).select("path", F.col("leave").alias("offset"))
        found = written(found.unionByName(ahead), "warc-reached")
        double = jump.select("path", F.col("offset").alias("leave"), F.col("leave").alias("further"))
        jump = jump.join(double, ["path", "leave"]).select("path", "offset", F.col("further").alias("leave"))
        jump = written(jump, "warc-jumps")
    return nodes.join(found, ["path", "offset"], "left_semi")


def read_archive(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives below `path`: path, offset, length, kind, id, refers, uri, declared digest, `payload_bytes`
    and `payload_digest` (SHA-256, computed from the payload; a revisit has neither payload and says both), `whole`,
    and with `payload` the payload itself (of a revisit: empty).

    Records of WARC 1.0 and 1.1, whatever their payloads hold. Text before the first magic means that nothing of a file
    is reached; behind a damaged record nothing is. A record that ends beyond its file is there with `whole` false and without
    figures of its payload. An empty file has no records. Files may be compressed as Spark's text source knows it; those
    that aren't are read in splits. Runs jobs when called; a split's cuts are held in one task without their bytes.
    """
    cuts = written(_candidates(spark, path), "warc-candidates")
    step = len(_CUT)
    sizes = cuts.groupBy("path", "block").agg(F.sum(F.col("n") + step).alias("n"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the first cut of a file has no magic before it
    total = F.sum("n").over(Window.partitionBy("path")) - step
    blocks = sizes.select(
        "path", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), total.alias("size")
    )
    placed = cuts.join(written(blocks, "warc-splits"), ["path", "block"]).select(
        "*", (F.col("base") + F.col("at")).alias("offset")
    )
    able = placed.filter("following is not null").withColumn("leave", F.col("base") + F.col("leave"))
    entries = able.select("path", F.col("leave").alias("offset")).distinct()
    entries = entries.unionByName(blocks.select("path", F.lit(0).cast("long").alias("offset")).distinct())
    ways = able.join(entries.distinct(), ["path", "offset"], "left_semi")
    reached = _reached(ways.select("path", "block", "offset", "leave", "first"))
    on = reached.select("path", "block", F.col("first").alias("entry"))
    kept = able.join(on, ["path", "block"]).filter("first <= entry and entry < first + through")
    kept = kept.select("path", "block", "at", "offset", (F.col("base") + F.col("following")).alias("next"), "size", *_names())
    kept = kept.withColumn("length", F.col("next") - F.col("offset")).withColumn("whole", F.col("next") <= F.col("size"))
    kept = written(kept, "warc-kept")
    parted = F.col("whole") & F.col("payload_bytes").isNull()
    if payload or not kept.filter(parted).isEmpty():
        bodies = _bodies(spark, path, placed, kept.filter("whole") if payload else kept.filter(parted))
        bodies = bodies.withColumnsRenamed({"payload_bytes": "b", "payload_digest": "d"})
        kept = kept.join(bodies, ["path", "offset"], "left")
        kept = kept.withColumn("payload_bytes", F.coalesce("payload_bytes", "b")).withColumn("payload_digest", F.coalesce("payload_digest", "d"))
    return kept.select("path", "offset", "length", *_names(), "whole", *["payload"] * payload)


def _names() -> list[str]:
    return [f.split()[0] for f in _HEADER.split(", ")]


def _bodies(spark: SparkSession, path: str, placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Payloads of records, put together from their cuts: path, offset, payload, payload_bytes, payload_digest.

    A record's cuts lie in its own split and perhaps in later ones: each cut belongs to the last wanted record that
    begins before it, if that record reaches so far.
    """
    begins = wanted.select("path", "block", "at", F.col("offset").alias("own"), F.col("next").alias("until"))
    marked = placed.select("path", "block", "at", "offset").join(begins, ["path", "block", "at"], "left")
    mine = F.when(F.col("own").isNotNull(), F.struct("own", "until"))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = placed.select("path", "block").distinct().join(
        begins.groupBy("path", "block").agg(F.max(F.struct("own", "until")).alias("held")), ["path", "block"], "left"
    )
    last = last.select("path", "block", F.max("held").over(before).alias("held"))
    owned = marked.withColumn("mine", F.max(mine).over(inside)).join(last, ["path", "block"])
    owned = owned.select("path", "block", "at", "offset", F.coalesce("mine", "held").alias("owner"))
    owned = owned.filter("owner is not null and offset < owner.until").select("path", "block", "at", F.col("owner.own").alias("offset"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in _in_order(batches):
            rows.append(row)
            size += len(row[3])
            if size > 8 << 20 or len(rows) >= 1000:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["path", "block", "at", "cut"]
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, offset, parts = (c[i].as_py() for c in batch.columns)
                cut = _CUT.join(p["cut"] for p in parts)
                body = _payload(cut, *_record(cut))
                types = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip((file, offset, *body), types, strict=True)],
                    names=["path", "offset", "payload", "payload_bytes", "payload_digest"],
                )

    pieces = _cuts(spark, path).mapInArrow(place, "path string, block long, at long, cut binary")
    pieces = pieces.join(owned, ["path", "block", "at"]).groupBy("path", "offset").agg(
        F.array_sort(F.collect_list(F.struct("block", "at", "cut"))).alias("parts")
    )
    schema = "path string, offset long, payload binary, payload_bytes long, payload_digest string"
    return pieces.mapInArrow(build, schema)


def record_key(column: str) -> Column:
    """The key that `write_archive` put into a record's id; NULL for an id without one."""
    return F.expr(f"try_cast(substring(`{column}`, {len(KEY) + 1}) as long)")
