"""Web archives of Zstandard frames, one frame a record, and their reader.

Writing. Every task writes its own archives: a leading skippable frame with the dictionary, then one frame per record. Spark's own
text writer puts the bytes into the shared store, so any file system that Spark writes to will do; its line end is set to
an empty skippable frame, which readers of Zstandard pass over. The dictionary is trained on some ``SAMPLE`` pages (twice
as many at most) drawn by key hash, 16 KB of each; tables too small to train one get archives without.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest id is a response; the others are
revisits, which hold the response's http header and refer to its record. Only digests are compared; a digest of many copies
is reduced before it is shuffled and joined as a narrow table.

Reading. The dictionary is taken from the leading skippable frame (raw, or itself a frame); other skippable frames are
passed over. The end of a frame is found from its block headers, so a frame is decoded once and alone. Checked: the frame's
content size and checksum, the version line, header syntax and mandatory fields, ``Content-Length`` against the block, the two
line ends behind it, block and payload digests, the http ``Content-Length`` of responses, and that revisits name a record. A
fault raises ValueError, or becomes a row's ``fault`` with ``strict=False``; what cannot be framed ends its archive.

Defined results: null payloads are empty; texts of any length are one record; archives hold some ``ARCHIVE`` bytes of payload and are read whole.
Null ids are written as an empty id and never are the smallest, unless all are null; rows that share the smallest id are all
responses. Control characters, spaces and non-ASCII characters in an address are percent-encoded; a null address has no
header. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import scratch_path

ARCHIVE = 32 << 20
SAMPLE = 512
HEAD = 16 << 10
DICTIONARY = 64 << 10
LEAST = 100
GAP = "P*M\x18\0\0\0\0"  # an empty skippable frame, as text
FRAME, DICT, SKIP, TRAINED = b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18", 0x184D2A50, b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")
DATE = "2020-01-01T00:00:00Z"
RECORD = ("archive string, start long, record_type string, record_id string, target_uri string, date string, refers_to string, payload binary, "
          "payload_bytes long, payload_digest string, fault string")


# --- one record -------------------------------------------------------------------------
def record_id(key: str | None) -> str:
    return f"<urn:record:{quote(key or '', safe='')}>"


def key_of(identifier: str | None) -> str | None:
    """The key in a record's id; null for none."""
    if identifier is None or not identifier.startswith("<urn:record:") or not identifier.endswith(">"):
        return None
    return unquote(identifier[12:-1]) or None


def record(key: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: str | None, date: str = DATE) -> bytes:
    """Bytes of a response or revisit record; ``digest`` is the payload's SHA-256 in hex."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(key)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="".join(map(chr, range(0x21, 0x7F))))))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Fields of one record; raises ValueError on any fault."""
    line, _, rest = data.partition(b"\r\n")
    if line not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"no version line: {line[:20]!r}")
    head, end, body = rest.partition(b"\r\n\r\n")
    if not end:
        raise ValueError("header without end")
    fields = {}
    for h in head.split(b"\r\n"):
        name, colon, value = h.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line: {h[:40]!r}")
        fields.setdefault(name.decode("latin-1").lower(), value.strip().decode("utf-8"))
    for name in MANDATORY:
        if name.lower() not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdecimal():
        raise ValueError("Content-Length is no number")
    n = int(fields["content-length"])
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length is {n}, the block and its end have {len(body)} bytes")
    block, kind = body[:n], fields["warc-type"]
    if not _matches(fields.get("warc-block-digest"), block):
        raise ValueError("block digest differs")
    got = {"record_type": kind, "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"), "date": fields["warc-date"],
           "refers_to": fields.get("warc-refers-to"), "payload": None, "payload_bytes": None, "payload_digest": None}
    if kind in ("response", "revisit"):
        top, end, payload = block.partition(b"\r\n\r\n")
        if not end or not top.startswith(b"HTTP/"):
            raise ValueError("no http header")
        size = next((int(v) for k, _, v in (x.partition(b":") for x in top.split(b"\r\n")[1:]) if k.lower() == b"content-length" and v.strip().isdigit()), None)
        if kind == "response":
            if size is not None and size != len(payload):
                raise ValueError(f"http Content-Length is {size}, the payload has {len(payload)} bytes")
            if not _matches(fields.get("warc-payload-digest"), payload):
                raise ValueError("payload digest differs")
            got |= {"payload": payload, "payload_bytes": len(payload)}
        else:
            if payload or not fields.get("warc-refers-to") or fields.get("warc-profile") != PROFILE:
                raise ValueError("revisit with a payload, or without reference or profile")
            got["payload_bytes"] = size
        got["payload_digest"] = _hex(fields.get("warc-payload-digest"))
    return got


def _hex(digest: str | None) -> str | None:
    """Bare lower-case hex of a labelled digest, written in hex or base 32."""
    if digest is None:
        return None
    label, _, value = digest.partition(":")
    size = {"sha1": 20, "sha256": 32}.get(label.lower())
    return value.lower() if size is None or len(value) == 2 * size else base64.b32decode(value.upper()).hex()


def _matches(digest: str | None, data: bytes) -> bool:
    label = (digest or "").partition(":")[0].lower()
    return label not in ("sha1", "sha256") or hashlib.new(label, data).hexdigest() == _hex(digest)


# --- frames -----------------------------------------------------------------------------
def skippable(data: bytes) -> bytes:
    return DICT + len(data).to_bytes(4, "little") + data


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes | None, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, from its header and the headers of its blocks."""
    try:
        params = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
        at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    except zstandard.ZstdError as e:
        raise ValueError(f"frame header: {e}") from None
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * params.has_checksum
    if at > len(data):
        raise ValueError("frame is cut off")
    return at


def frames(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(place, decoded bytes, fault) of every frame of an archive. A fault in the framing is the last item."""
    view, at, decoder = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        start = at
        try:
            magic = int.from_bytes(view[at : at + 4], "little")
            if len(view) - at >= 8 and magic & ~15 == SKIP:
                size = int.from_bytes(view[at + 4 : at + 8], "little")
                if at + 8 + size > len(view):
                    raise ValueError("skippable frame is cut off")
                if at == 0 and bytes(view[:4]) == DICT:
                    held = bytes(view[8 : 8 + size])
                    if held[:4] == FRAME:
                        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                    if held[:4] != TRAINED:
                        raise ValueError("no dictionary in the leading frame")
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_FULLDICT))
                at += 8 + size
                continue
            at = frame_end(view, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield start, None, str(e)
            return
        frame = bytes(view[start:at])
        try:
            size = zstandard.frame_content_size(frame)
            out = decoder.decompress(frame) if size >= 0 else decoder.decompressobj().decompress(frame)
            if size >= 0 and len(out) != size:
                raise ValueError(f"frame of {size} bytes has {len(out)}")
            yield start, out, None
        except (ValueError, zstandard.ZstdError) as e:
            yield start, None, str(e)


# --- archives ---------------------------------------------------------------------------
def dictionary(pages: DataFrame, rows: int, key: str = "page_id", payload: str = "html") -> bytes | None:
    """A dictionary of records of some ``SAMPLE`` of the ``rows`` pages, drawn by key hash; None where they are too few to train one."""
    some = pages.select(F.col(key).cast("string").alias("k"), F.encode(F.substring(F.coalesce(payload, F.lit("")), 1, HEAD), "utf-8").alias("p"))
    drawn = F.pmod(F.xxhash64("k"), F.lit(1 << 40)) <= (SAMPLE << 40) // max(1, rows)
    some = some.where(drawn).limit(2 * SAMPLE).collect()  # more than drawn only where very many rows share a key
    records = [record(r["k"], "http://example.com/", bytes(r["p"]), "0" * 64, "response", None) for r in some]
    try:
        return zstandard.train_dictionary(DICTIONARY, records).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def planned(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """(k, url, payload, digest, kind, refers): what is to be written for each row."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    sized = rows.where(F.octet_length("payload") >= least)
    groups = sized.groupBy("digest").agg(F.min("id").alias("smallest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # the pages have the hot digests: adaptive execution broadcasts the groups by real size, or splits skewed parts of the pages
    rows = rows.join(groups, "digest", "left")
    again = F.col("smallest").isNotNull() & ~F.col("id").eqNullSafe(F.col("smallest"))
    return rows.select(F.col("id").cast("string").alias("k"), "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("kind"),
                       F.when(again, F.col("smallest").cast("string")).alias("refers"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = DATE, level: int = 3) -> None:
    """Write a folder of archives: each task its own ones, of as many records as have some ``ARCHIVE`` bytes on average."""
    rows, total = pages.agg(F.count(F.lit(1)), F.sum(F.octet_length(payload))).first()
    held = dictionary(pages, rows, key, payload)
    records = 1 + ARCHIVE // max(1, (total or 0) // max(1, rows))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, n = _compressor(held, level), 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if held and n % records == 0:
                    out.append(skippable(held))
                out.append(packer.compress(record(r.k, r.url, bytes(r.payload), r.digest, r.kind, r.refers, date)))
                n += 1
            yield pd.DataFrame({"frame": out})

    made = planned(pages, key, url, payload, least).mapInPandas(write, "frame binary").select(F.col("frame").cast("string").alias("value"))
    made.write.option("lineSep", GAP).option("maxRecordsPerFile", records + bool(held)).text(path)


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row per record of all archives of a folder."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for start, data, fault in frames(content):
                    row = dict.fromkeys(("record_type", "record_id", "target_uri", "date", "refers_to", "payload", "payload_bytes", "payload_digest"))
                    if fault is None:
                        try:
                            row |= parsed(data)
                        except ValueError as e:
                            fault = str(e)
                    if fault and strict:
                        raise ValueError(f"{name} at byte {start}: {fault}")
                    rows.append({"archive": name, "start": start, **row, "fault": fault})
                    held += len(data or b"")
                    if held > 16 << 20:
                        yield pd.DataFrame(rows)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInPandas(read, RECORD)


def archived(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Write archives of all rows into the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, key, url, payload, least)
    return read_archives(pages.sparkSession, path)
