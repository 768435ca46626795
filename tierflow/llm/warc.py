"""A WARC writer with a shared Zstandard dictionary, and its reader.

Records are compressed one by one, so each can be read alone. The dictionary
is trained on a bounded sample of records and stands at the head of each
archive in a skippable frame, as the .warc.zst format asks. Of records with
equal payloads the one with the largest id is the response; the others are
written as revisits, without the payload, and refer to it.

Spark's text writer makes the files: a row is a frame, and the separator that
the writer puts after each row is an empty skippable frame, which readers pass
over. So archives go through Spark's commit protocol to any file system that
Spark writes to, and a lost executor leaves no half archive behind.

Cases: a null html is an empty payload, a null url is written without a target
header; a null id is smaller than all others; rows that share the largest id
of their payload are all responses; rows are records, so repeated rows come
back repeatedly; payloads under ``revisit_from`` bytes are always responses;
an empty table makes no archive and gives an empty result.
"""
from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierflow.llm.common import MIN_LONG, key_of, materialize, ship, table
from tierflow.session import checkpoint_path

# Fixed values of the Zstandard and .warc.zst formats.
DICTIONARY_FRAME = 0x184D2A5D
GAP = "\x50\x2a\x4d\x18\x00\x00\x00\x00"  # an empty skippable frame; pure ASCII

SAMPLE_RECORDS, DICTIONARY_BYTES, SAMPLE_BYTES = 500, 64 << 10, 16 << 10


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None, length: int, digest: bytes, response: int | None,
           is_response: bool) -> bytes:
    """One WARC record; ``length`` and ``digest`` (SHA-1) are those of the full
    payload. A revisit has no payload and names the page that it refers to."""
    body = (html or "").encode() if is_response else b""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>", *([f"WARC-Target-URI: {url}"] if url is not None else []),
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {length}",
        *([] if is_response else [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{response}>"]),
        "Content-Type: text/html", f"Content-Length: {len(body)}"]
    # a line end inside a URL would end the header
    return "\r\n".join(x.replace("\r", "%0D").replace("\n", "%0A") for x in head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def train_dictionary(roles: DataFrame, n: int) -> bytes:
    """A dictionary from at most SAMPLE_RECORDS of the n records as they are
    written (``with_roles``: revisits have no payload), payloads cut to
    SAMPLE_BYTES characters for training only; empty if there are too few to
    train on. A hash of id and URL picks about twice as many, whatever the
    table's size."""
    share = min(1.0, 2 * SAMPLE_RECORDS / max(n, 1))
    place = F.shiftrightunsigned(F.xxhash64("page_id", "url"), 32)
    rows = roles.filter(place < int(share * 2 ** 32)).withColumn(
        "html", F.substring("html", 1, SAMPLE_BYTES)).limit(SAMPLE_RECORDS).collect()
    samples = [record(r.page_id, r.url, r.html, r.n, bytes(r.d), r.response, r.response is None) for r in rows]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # samples without anything in common
        return b""


def with_roles(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, n and d (bytes and SHA-1 of the payload), ``response``: the id
    of the page that holds the payload (null if the record is one itself), and
    html, which is null for revisits."""
    p = pages.select("page_id", "url", "html", key_of("page_id").alias("k"),
                     F.octet_length(F.coalesce("html", F.lit(""))).alias("n"),
                     F.unhex(F.sha1(F.coalesce("html", F.lit("")))).alias("d"))
    # written before it is joined, so that Spark can split a hot payload
    first = materialize(p.groupBy("n", "d").agg(F.max("k").alias("top")), "warc-responses")
    is_response = (F.col("k") == F.col("top")) | (F.col("n") < revisit_from)
    return p.join(first, ["n", "d"]).select(
        "page_id", "url", "n", "d", F.when(~is_response, F.col("top")).alias("response"),
        F.when(is_response, F.col("html")).alias("html"))


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Write pages (page_id, url, html) to archives under path, one for each
    partition of the join that finds the roles: the payloads are shuffled once,
    and the sizes are those that Spark aims at for partitions."""
    roles = with_roles(pages, revisit_from)
    dictionary = train_dictionary(roles, pages.count())
    ship(pages.sparkSession)

    def frames(batches):
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
        begun = False
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                if not begun:
                    out.append(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                    begun = True
                for page_id, url, n, d, response, html in zip(*(c.slice(lo, 256).to_pylist() for c in batch.columns)):
                    out.append(packer.compress(record(page_id, url, html, n, d, response, response is None)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])

    packed = roles.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    packed.write.option("lineSep", GAP).option("compression", "none").mode("overwrite").text(path)


def split_frames(data: bytes):
    """(dictionary, compressed frames) of one archive."""
    view, at, dictionary = memoryview(data).cast("B"), 0, b""
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if magic == DICTIONARY_FRAME and not dictionary:
                dictionary = bytes(view[at + 8:at + 8 + size])
            at += 8 + size
            continue
        end = at + frame_length(view[at:])
        yield dictionary, view[at:end]
        at = end


def frame_length(view: memoryview) -> int:
    """Bytes of the Zstandard frame at the head of view, from its block headers."""
    flags = view[4]
    single, check, dict_flag, size_flag = flags >> 5 & 1, flags >> 2 & 1, flags & 3, flags >> 6
    at = 5 + (not single) + (0, 1, 2, 4)[dict_flag] + ((1 if single else 0), 2, 4, 8)[size_flag]
    while True:
        block = view[at] | view[at + 1] << 8 | view[at + 2] << 16
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return at + 4 * check


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str) -> int | None:
    at = urn[len("<urn:page:"):-1]
    return None if at == "None" else int(at)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to and, if asked for, the payload (null for revisits).
    Responses' lengths and digests are recomputed from the payload read."""
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
              + ", payload binary" * with_payload)

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                unpack, out = {}, []
                for dictionary, frame in split_frames(content.as_buffer()):
                    if dictionary not in unpack:
                        unpack[dictionary] = zstandard.ZstdDecompressor(
                            dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                    fields, body = parse(unpack[dictionary].decompress(frame))
                    kind = fields["WARC-Type"]
                    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if kind == "response" and (digest_of(body), len(body)) != (digest, length):
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
                    refers = fields.get("WARC-Refers-To")
                    out.append((_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, kind,
                                _page(refers) if refers else None, *([body if kind == "response" else None] if with_payload else [])))
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    path = checkpoint_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(pages, path, revisit_from=0)
    out = read_archives(spark, path)
    refers = F.when(F.col("refers_to") != MIN_LONG, F.col("refers_to"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", refers.alias("refers_to"), "url")
