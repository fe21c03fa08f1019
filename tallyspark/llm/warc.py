"""WARC archives: written with revisits for equal payloads, read back by boundary-chain verification.

Writing is native: a row becomes one record (an HTTP response in a WARC record, ended by CRLF CRLF); Spark's text writer puts them one after
another. Rows with equal payloads (length and SHA-1) share one response, that of the largest id; the others are ``revisit`` records, which keep their HTTP
headers, so that length and digest of the whole payload are in every record. A payload that a third of all rows have costs one sum by digest; only
digests that occur twice or more are joined back (``common.attached``).

Reading: the text reader cuts files into ranges and rows at ``CRLF WARC/1.``, which no header can hold, but a payload can. So each row is only a
candidate:

1. Tasks emit for every candidate where it lies in its range and, from its own length field, where its successor must lie; a candidate whose header
   makes no sense has none. Within the range the links are followed at once, so a candidate has the offset at which its chain leaves the range.
2. Ranges' byte counts, summed up along each file, make offsets of them.
3. Pointer jumping from each file's start over the chains' ends: after k rounds the links are 2^k ranges long, so the rounds grow with the
   logarithm of a file's ranges. The candidates in reach are where each range is really entered.
4. A range's candidates that the chain from its entry leaves out are magic inside payloads; they are few, and each gets the record it lies in.
5. The ranges are read again. Rows that are records are parsed where they lie; only records that were cut by their payload are put together again,
   a group a record.

What follows a broken link (a truncated file, a wrong length) is out of reach and isn't read, as no byte says where the next record begins.
Records must fit in a row; compressed files aren't cut and aren't read here.

Rows without an id are written with their url alone and are responses, unless a row with an id has their payload. Rows that repeat the largest id of a
payload are responses all. Null payloads are empty ones; null urls are left out; white space in a url is percent-encoded. Empty tables make empty archives. Other
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attached, discard, materialize, shared_dir, small_batches, small_or_plain

# fixed values of the format
MAGIC, VERSION, END = "WARC/1.", "1", "\r\n\r\n"
CUT = "\r\n" + MAGIC
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DATE = "1970-01-01T00:00:00Z"
NAMED_FILES = 1000
BEFORE, NOWHERE = -1, -2


def base32_sha1(payload: Column) -> Column:
    """The bare upper-case base32 SHA-1 of bytes: five hexadecimal digits are four of base 32."""
    digits = F.sha1(payload)
    fours = [F.lpad(F.conv(F.substring(digits, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def planned(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """id, url, payload, bytes, digest, first: the id of the payload's response, null where the row is a response itself."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload").cast("binary"))})
    same = rows.groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max("id").alias("first")).filter("n > 1 and first is not null").select("digest", "first")
    same = materialize(same, "warc-same")
    of = attached(rows.select("digest", "id", "url", "payload", "bytes"), same, "digest", "left")
    return of.withColumn("first", F.when(F.col("id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")))


def _record(date: str) -> Column:
    """One whole record but for its last CRLF CRLF."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:row:"), c.cast("string"), F.lit(">"))
    url = F.regexp_replace("url", r"[\x00-\x20]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    parts = [
        F.lit(f"{MAGIC}{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.when(F.col("id").isNotNull(), line("WARC-Record-ID", name(F.col("id")))),
        line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    ]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> None:
    """Archives under ``path``, one a partition."""
    planned(pages, id_col, url_col, payload_col).select(_record(date).alias("value")).write.option("lineSep", END).text(path)


# ---------------------------------------------------------------- reading


def header_of(data: bytes) -> tuple[dict, int, int] | None:
    """Fields, length of the header and of the block, of bytes that begin with a record; None if that is no record's header."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or data[7:10] not in (b"0\r\n", b"1\r\n"):
        return None
    fields = {}
    for row in data[10:end].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon or not name.strip():
            return None
        fields[name.strip().lower()] = value.strip()
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or b"warc-type" not in fields:
        return None
    return fields, end + 4, int(size)


def _ranges(path: str, spark: SparkSession) -> DataFrame:
    rows = spark.read.option("lineSep", CUT).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.col("value").cast("binary").alias("value"))


class _Places:
    """Where a task's rows lie, counted from where the first one of their range does."""

    def __init__(self):
        self.key, self.at = None, 0

    def next(self, key, size: int) -> int:
        if key != self.key:
            self.key, self.at = key, 0
        place = self.at
        self.at += size + len(CUT)
        return place


def _whole(first: bool, value: bytes) -> bytes:
    """The bytes of a candidate; a file's first row has its magic still."""
    return value if first else MAGIC.encode() + value


def _links(batches):
    """file, range, place (of the row in its range), link: the place its record ends at, null if it is none; leaves: the place at which the chain leaves
    the range, null if it breaks off; end: the range's length."""
    import pandas as pd

    places, key, held = _Places(), None, []

    def done():
        own = {p: i for i, (p, _) in enumerate(held)}
        leaves: list[int | None] = [None] * len(held)
        for i in range(len(held) - 1, -1, -1):
            link = held[i][1]
            if link is not None:
                leaves[i] = leaves[own[link]] if link in own else link if link >= places.at else None
        frame = pd.DataFrame({"file": key[0], "range": key[1], "place": [p for p, _ in held], "link": [x for _, x in held], "leaves": leaves, "end": places.at})
        return frame.astype({"link": "Int64", "leaves": "Int64"})

    for frame in batches:
        for file, start, value in zip(frame["file"], frame["range"], frame["value"], strict=True):
            if (file, start) != key:
                if held:
                    yield done()
                key, held = (file, start), []
            first = start == 0 and not held
            place = places.next(key, len(value))
            found = header_of(_whole(first, value))
            # places are those of rows: a row after the first has its magic before it
            shift = 0 if first else -len(MAGIC)
            held.append((place, place + shift + found[1] + found[2] + len(END) + len(MAGIC) if found else None))
    if held:
        yield done()


def chained(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file, range, base: its offset), and (file, range, entry: the place at which the chain from the file's start enters it)."""
    along = Window.partitionBy("file").orderBy("range")
    sizes = links.groupBy("file", "range").agg(F.max("end").alias("end"))
    bases = materialize(sizes.withColumn("base", F.sum("end").over(along) - F.col("end")).withColumn("nth", F.row_number().over(along)), "warc-bases")
    few = small_or_plain(bases.select("file", "range", "base"))
    at = links.join(few, ["file", "range"]).select("file", "range", "place", (F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("leaves")).alias("to"))
    starts = at.filter("at = 0").select("file", F.lit(0).cast("long").alias("at"))
    entered = at.filter("to is not null").select("file", F.col("to").alias("at")).union(starts).distinct()
    nodes = materialize(at.join(entered, ["file", "at"]), "warc-nodes")  # about one a range
    reached, jumps, made = materialize(nodes.filter("at = 0").select("file", "at"), "warc-reached"), nodes.filter("to is not null").select("file", "at", "to"), []
    made.append(reached)
    longest = bases.agg(F.max("nth")).first()[0] or 1
    for _ in range((longest - 1).bit_length()):
        ends = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = materialize(reached.union(ends).distinct(), "warc-reached")
        further = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jumps = materialize(jumps.join(further, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "warc-jumps")
        made += [reached, jumps]
    entries = materialize(nodes.join(reached, ["file", "at"]).select("file", "range", F.col("place").alias("entry")), "warc-entries")
    discard(nodes, *made)
    return bases.drop("nth"), entries


def _outside(frame):
    """The rows of one range that are no records: file, range, place, and the place of the record they lie in (BEFORE: before the range's entry, so of an
    earlier range; NOWHERE: behind a link that leads nowhere)."""
    import pandas as pd

    frame = frame.sort_values("place")
    entry, record, out = frame["entry"].iloc[0], BEFORE, []
    due = None if entry != entry else int(entry)
    for place, link in zip(frame["place"], frame["link"], strict=True):
        if place == due:
            record, due = int(place), None if link != link else int(link)
        else:
            inside = record if record == BEFORE or (due is not None and place < due) else NOWHERE
            out.append((frame["file"].iloc[0], int(frame["range"].iloc[0]), int(place), inside))
    return pd.DataFrame(out, columns=["file", "range", "place", "record"])


def rejected(links: DataFrame, bases: DataFrame, entries: DataFrame) -> DataFrame:
    """file, range, place of candidates out of the chain's reach; owner: the offset of the record that the row is a part of, null if there is none."""
    within = Window.partitionBy("file", "range").orderBy("place")
    follow = links.withColumn("gap", F.lead("place").over(within).isNotNull() & ~F.col("link").eqNullSafe(F.lead("place").over(within)))
    ranges = follow.groupBy("file", "range").agg(F.min("place").alias("lowest"), F.max("gap").alias("gap")).join(entries, ["file", "range"], "left")
    # a range that is entered at its first row and has no gap has no such rows
    odd = materialize(ranges.filter("gap or entry is null or entry <> lowest").select("file", "range", "entry"), "warc-odd")
    out = links.select("file", "range", "place", "link").join(small_or_plain(odd), ["file", "range"])
    out = materialize(out.groupBy("file", "range").applyInPandas(_outside, "file string, range long, place long, record long"), "warc-outside")
    # what a range begins with may belong to the last record of an earlier one
    last = links.join(entries.withColumnRenamed("entry", "place"), ["file", "range", "place"]).select("file", "range", F.col("leaves").alias("link"))
    tails = links.select("file", "range", "place", "link").join(last, ["file", "range", "link"]).join(out, ["file", "range", "place"], "left_anti")
    tail = F.struct((F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("link")).alias("to"))
    known = bases.join(tails, ["file", "range"], "left").select("file", "range", "base", F.when(F.col("place").isNotNull(), tail).alias("tail"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("earlier", F.max("tail").over(before))
    at = F.col("base") + F.col("place")
    owner = F.when(F.col("record") >= 0, F.col("base") + F.col("record")).when((F.col("record") == BEFORE) & (at < F.col("earlier.to")), F.col("earlier.at"))
    named = materialize(out.join(known, ["file", "range"]).select("file", "range", "place", owner.alias("owner")), "warc-rejected")
    discard(odd, out)
    return named


def _placed(batches):
    """The rows with their places."""
    places = _Places()
    for frame in batches:
        at = [places.next((f, r), len(v)) for f, r, v in zip(frame["file"], frame["range"], frame["value"], strict=True)]
        yield frame.assign(place=at)[["file", "range", "place", "value"]]


FIELDS = "id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, digest_ok boolean"


def parsed(data: bytes) -> tuple | None:
    """The fields of one record, from bytes that begin with it; None if it is cut short, or is neither response nor revisit."""
    import base64
    import hashlib
    import re

    found = header_of(data)
    if found is None:
        return None
    fields, head, size = found
    kind = fields[b"warc-type"].decode("ascii", "replace")
    block = data[head : head + size]
    if len(block) < size or kind not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.fullmatch(rb"<urn:row:(-?[0-9]+)>", fields.get(name, b""))) else None
    said = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    url = fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None
    row = (number(b"warc-record-id"), url, kind, number(b"warc-refers-to"))
    if kind == "revisit":  # its payload is elsewhere; its HTTP header says how long it is
        length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
        return *row, None, int(length[1]) if length else None, said, None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return *row, payload, len(payload), digest, digest == said


def _parse(column: str, first: str | None):
    def run(batches):
        import pandas as pd

        for frame in batches:
            starts = frame[first] if first else [True] * len(frame)
            rows = [r for v, s in zip(frame[column], starts, strict=True) if (r := parsed(_whole(s, v))) is not None]
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in FIELDS.split(", ")])
            yield out.astype({"id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row a response or revisit record in reach: FIELDS; payload and digest_ok are null for revisits."""
    small_batches(spark)
    links = materialize(_ranges(path, spark).mapInPandas(_links, "file string, range long, place long, link long, leaves long, end long"), "warc-links")
    bases, entries = chained(links)
    out = rejected(links, bases, entries)
    discard(links, entries)
    rows = _ranges(path, spark).mapInPandas(_placed, "file string, range long, place long, value binary")
    of = rows.join(small_or_plain(out.select("file", "range", "place").withColumn("out", F.lit(True))), ["file", "range", "place"], "left")
    own = of.filter("out is null").withColumn("first", (F.col("range") == 0) & (F.col("place") == 0))
    records = own.select("value", "first").mapInPandas(_parse("value", "first"), FIELDS)  # one that its payload cuts gives no row here
    parts = out.filter("owner is not null")
    return records.union(_rejoined(spark, path, parts, bases)) if parts.limit(1).count() else records


def _rejoined(spark: SparkSession, path: str, parts: DataFrame, bases: DataFrame) -> DataFrame:
    """The records that rows in ``parts`` belong to, put together; of the files they lie in, if those are few, no others are read."""
    rows = _ranges(path, spark)
    files = [r.file for r in parts.select("file").distinct().limit(NAMED_FILES + 1).collect()]
    if len(files) <= NAMED_FILES:
        rows = rows.filter(F.col("file").isin(files))
    placed = rows.mapInPandas(_placed, "file string, range long, place long, value binary").join(small_or_plain(bases.select("file", "range", "base")), ["file", "range"])
    placed = placed.select("file", (F.col("base") + F.col("place")).alias("at"), "value")
    offsets = parts.join(small_or_plain(bases.select("file", "range", "base")), ["file", "range"]).select("file", (F.col("base") + F.col("place")).alias("at"), "owner")
    of = materialize(offsets.union(parts.select("file", F.col("owner").alias("at"), "owner").distinct()), "warc-parts")
    pieces = placed.join(small_or_plain(of), ["file", "at"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("pieces"))
    joined = F.aggregate(F.slice("pieces", 2, F.greatest(F.size("pieces"), F.lit(1))), F.get("pieces", F.lit(0))["value"], lambda acc, p: F.concat(acc, F.lit(CUT).cast("binary"), p["value"]))
    whole = pieces.select(F.when(F.col("owner") == 0, F.lit(b"")).otherwise(F.lit(MAGIC).cast("binary")).alias("magic"), joined.alias("value"))
    return whole.select(F.concat("magic", "value").alias("value")).mapInPandas(_parse("value", None), FIELDS)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write archives (to a new folder of the shared one, if none is given) and read them back."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return read(spark, path)
