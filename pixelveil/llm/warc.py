"""WARC archives with a Zstandard dictionary.

An archive is a sequence of frames: a skippable frame that holds the dictionary, built from the archive's own
records, then every record as a frame of its own, so that one record can be read alone. Of pages with equal
payloads, one is a ``response`` record and the others are ``revisit`` records that name it.

Archives are rows ``(archive, content, records)`` of a table that Spark's writer commits, so a lost executor loses
none; ``read_files`` reads the same bytes from ``.warc.zst`` files, and ``save_files`` writes such files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_from, small_or_not, stored, with_import_path

#: Payloads from this many bytes on are recorded once.
LEAST_SHARED = 100
#: Record bytes in an archive, the bytes of its dictionary, and the record bytes that the dictionary is built from.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 4_000_000, 1 << 15, 1_500_000
#: Bytes of a record that may enter the dictionary; records themselves are whole.
SAMPLE_BYTES = 20_000
LEVEL = 3
#: Skippable frame that holds a dictionary, and a frame's own number.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
DATE = "1970-01-01T00:00:00Z"
#: Shared digests that may be broadcast (about 100 bytes each), and keys over which a common one is dealt in a join.
MOST_BROADCAST, SALTS = 200_000, 32
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id, digest: str, copy: int) -> str:
    """One for each row: ``copy`` numbers the rows of one id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def _line(s: str | None) -> str:
    return "" if s is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in s)


def record(page_id, copy: int, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record without payload if ``refers_to`` is an id."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest, copy)}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build(records: list[bytes]) -> bytes:
    """An archive of the given records. Its dictionary is built from about ``TRAINING_BYTES`` of them, evenly spaced; all are written whole."""
    samples, total = [], 0
    for r in records[:: max(1, sum(map(len, records)) // TRAINING_BYTES)]:
        samples.append(r[:SAMPLE_BYTES])
        total += len(samples[-1])
    try:
        content = zstd.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 10)), samples, k=64, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstd.ZstdError:  # too little or too uniform
        content = b""
    if not content:
        content = b"".join(samples)[-DICTIONARY_BYTES:]
    data = zstd.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    coder = zstd.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(content)), content, *map(coder.compress, records)])


def frames(content: bytes):
    """(start, end) of every frame after the leading dictionary, from the frames' own headers."""
    at = 8 + struct.unpack_from("<I", content, 4)[0] if content[:4] == struct.pack("<I", SKIPPABLE) else 0
    while at < len(content):
        start, checksum = at, content[at + 4] >> 2 & 1
        if struct.unpack_from("<I", content, at)[0] != FRAME:
            raise ValueError("not a Zstandard frame")
        at += zstd.frame_header_size(content[at : at + 18])
        last = 0
        while not last:
            head = int.from_bytes(content[at : at + 3], "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            at += 3 + (1 if kind == 1 else size)
        at += 4 * checksum
        yield start, at


def read(content: bytes):
    """(headers, block) of every record of an archive."""
    size = struct.unpack_from("<I", content, 4)[0]
    if struct.unpack_from("<I", content, 0)[0] != SKIPPABLE:
        raise ValueError("no leading dictionary frame")
    decoder = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content[8 : 8 + size]))
    for start, end in frames(content):
        raw = decoder.decompress(content[start:end])
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        h = dict(x.split(": ", 1) for x in lines[1:])
        n = int(h["Content-Length"])
        if rest[n:] != b"\r\n\r\n":
            raise ValueError("the record's length is wrong")
        yield h, rest[:n]


def plan(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_SHARED, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``page_id, url, html, digest, copy, refers_to``: which row records a payload and which refer to it.

    Payloads below ``least`` bytes are always recorded. Of others that are equal, the row with the smallest page id
    records (null ids only if there is no other, and then they refer to nothing); of repeated rows with that id,
    the first by url does, and the others refer to it. Other columns play no part; an empty table gives no rows.

    Who shares is found by digests alone. If at most ``most_broadcast`` payloads are shared, pages aren't shuffled; else they
    meet the shared digests in a join, in which a very common payload is dealt over ``SALTS`` keys. Only repeated rows of
    one id and payload are numbered by a window.
    """
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("long", F.octet_length("html") >= least)
    keys = stored(rows.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max("long").alias("long")), "digests")
    shared = keys.where("long and page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    if shared.count() <= most_broadcast:
        met = rows.join(F.broadcast(shared), "digest", "left")
    else:
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["digest", "salt"], "left")
    met = met.select("page_id", "url", "html", "digest", "first")
    twice = keys.where("n > 1").select(F.col("digest").alias("same"), F.col("page_id").alias("id"))
    n = twice.count()
    if n:
        again = (F.col("digest") == F.col("same")) & F.col("page_id").eqNullSafe(F.col("id"))
        twice = small_or_not(twice, n, most_broadcast)
        number = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy(F.col("url").asc_nulls_first())) - 1
        met = met.join(twice, again, "left_anti").withColumn("copy", F.lit(0)).union(met.join(twice, again, "left_semi").withColumn("copy", number))
    else:
        met = met.withColumn("copy", F.lit(0))
    other = F.col("first").isNotNull() & F.col("page_id").isNotNull() & ((F.col("page_id") != F.col("first")) | (F.col("copy") > 0))
    return met.select("page_id", "url", "html", "digest", "copy", F.when(other, F.col("first")).alias("refers_to"))


def write(planned: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``archive, content, records``: archives of about ``archive_bytes`` record bytes from the rows of ``plan``.

    A task holds one archive at a time, or one longer record. An archive's name is the hash of its content. An empty
    table gives no archives.
    """
    with_import_path(planned.sparkSession)
    schema = T.StructType.fromDDL("archive string, content binary, records bigint")

    def done(records):
        content = build(records)
        return rows_from(schema, [[hashlib.sha256(content).hexdigest()[:24] + ".warc.zst"], [content], [len(records)]])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for page, url, html, digest, copy, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page, copy, url, html.encode("utf-8", "surrogatepass"), digest, refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield done(held)
                    held, size = [], 0
        if held:
            yield done(held)

    return planned.select("page_id", "url", "html", "digest", "copy", "refers_to").mapInArrow(run, schema)


def read_back(archives: DataFrame, content: str = "content") -> DataFrame:
    """``page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to`` of every record.

    The digest of a response is computed from its payload and must equal its header's; a revisit has a null payload, and
    digest and length from its headers. A null url comes back as an empty one, control characters in a url as %XX. An
    empty table gives no rows.
    """
    with_import_path(archives.sparkSession)
    schema = T.StructType.fromDDL("page_id bigint, url string, payload binary, payload_digest string, payload_bytes bigint, record_type string, refers_to bigint")

    def one(h: dict, block: bytes):
        http, _, payload = block.partition(b"\r\n\r\n")
        n = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
        revisit, stated = h["WARC-Type"] == "revisit", h["WARC-Payload-Digest"].removeprefix("sha256:")
        if not revisit and (hashlib.sha256(payload).hexdigest() != stated or len(payload) != n):
            raise ValueError(f"record {h['WARC-Record-ID']} has another payload than its headers say")
        page, refers = h["X-Page-ID"], h.get("X-Refers-To-Page-ID")
        return int(page) if page else None, h["WARC-Target-URI"], None if revisit else payload, stated, n, h["WARC-Type"], int(refers) if refers else None

    def run(batches):
        for b in batches:
            for c in b.column(0):
                rows = [one(*r) for r in read(c.as_py())]
                if rows:
                    yield rows_from(schema, [list(x) for x in zip(*rows, strict=True)])

    return archives.select(content).mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives in ``.warc.zst`` files of any file system that Spark reads."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def save_files(archives: DataFrame, folder: str) -> list[str]:
    """Write each archive to a file of its own, through Hadoop's file system, one at a time at the driver.

    For moving a few archives out; the table that ``write`` makes is the distributed form.
    """
    spark = archives.sparkSession
    jvm, out = spark._jvm, []
    for r in archives.select("archive", "content").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{r.archive}")
        f = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        f.write(bytearray(r.content))
        f.close()
        out.append(path.toString())
    return out
