"""Dictionary-compressed WARC archives: written and read back by Spark tasks."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import representatives
from .shared import cut, shared_folder, small, stash

#: Fixed values of the formats: the magic number of the dictionary's skippable frame and of a Zstandard frame.
DICT_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
#: Records that the dictionary is trained on, characters of each, and bytes of the dictionary.
SAMPLES, SAMPLE_CHARS, DICT_BYTES = 1000, 4096, 64 * 1024
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC/1.1 response, or a revisit of the page refers_to, with its headers and closing line breaks."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary trained on the samples; where they are too few or too alike to train on, their bytes themselves are its content."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, total // 8), samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICT_BYTES:]


def job_dictionary(pages: DataFrame, date: str, most: int = SAMPLES, size: int = SAMPLE_CHARS) -> bytes:
    """The dictionary of all archives of a job, trained on the first `size` characters of at most `most` records, which a hash of their page_id and url chooses."""
    rows = pages.select("page_id", "url", F.left("html", F.lit(size)).alias("html")).orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(most).collect()
    return dictionary([record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), None, date) for r in rows])


def write_archives(pages: DataFrame, folder: str, level: int = 3, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes a .warc.zst file for each partition of pages(page_id, url, html, refers_to); (path, records, bytes) of each.

    A file starts with a skippable frame that holds the job's dictionary, trained on records of all
    partitions, so every file can be read alone; every record is a frame of its own. A task attempt
    writes to a name of its own and only the attempts that Spark accepts are listed, so a retried or
    lost task leaves no half file in use.
    """
    words = job_dictionary(pages, date)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        count, out = 0, None
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words))
        for b in batches:
            for page_id, url, html, refers in zip(b["page_id"], b["url"], b["html"], b["refers_to"], strict=True):
                if out is None:
                    out = store.open_output_stream(name, compression=None)
                    out.write(struct.pack("<II", DICT_FRAME, len(words)) + words)
                out.write(packer.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers, date)))
                count += 1
        if count:
            out.close()
            yield pd.DataFrame({"path": [name], "records": [count], "bytes": [store.get_file_info(name).size]})

    as_text = [F.col(c).cast("string").alias(c) for c in ("page_id", "refers_to")]  # as records hold them; pandas has no integers beside nulls
    return cut(pages.select(as_text[0], "url", "html", as_text[1]).mapInPandas(write, "path string, records long, bytes long"))


def frames(stream) -> Iterator[bytes]:
    """The records of an archive, one after another; the dictionary is read from the leading skippable frame."""
    unpacker, data = zstandard.ZstdDecompressor(), b""
    while True:
        if len(data) < 8:
            data += stream.read(1 << 20)
            if not data:
                return
        magic, size = struct.unpack_from("<II", data)
        if magic == DICT_FRAME:
            while len(data) < 8 + size:
                more = stream.read(1 << 20)
                if not more:
                    raise ValueError("the archive ends inside its dictionary")
                data += more
            words, data = data[8 : 8 + size], data[8 + size :]
            if struct.unpack_from("<I", words)[0] == ZSTD_FRAME:
                words = zstandard.ZstdDecompressor().decompress(words)
            unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
            continue
        one = unpacker.decompressobj()
        parts = [one.decompress(data)]
        while not one.eof:
            data = stream.read(1 << 16)
            if not data:
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(data))
        data = one.unused_data
        yield b"".join(parts)


def parsed(raw: bytes) -> tuple:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of a record (ids as text, None where there is none), whose payload must fit its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    refers = fields.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
    return page or None, fields.get("WARC-Target-URI"), length, digest, fields["WARC-Type"], refers or None


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """The records of the archives listed in files(path): page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b["path"]:
                with store.open_input_stream(path, compression=None) as stream:
                    out = []
                    for raw in frames(stream):
                        out.append(parsed(raw))
                        if len(out) == 10_000:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                    yield pd.DataFrame(out, columns=columns)

    rows = files.select("path").mapInPandas(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return rows.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archived(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Writes pages(page_id, url, html) as archives, reads them back and returns a row per record (see read_archives).

    Of records with equal payloads (null html is empty) of at least `least` bytes the one with the
    smallest page_id is a response and the others revisit it; smaller ones are all responses. Rows
    that repeat the smallest page_id are responses too; a null page_id comes behind all others, from
    -2^63 to 2^63 - 1, and never is a revisit's target. Long pages are one record each; an empty table writes nothing and gives no rows.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/archives-{uuid.uuid4().hex}"
    html = F.coalesce("html", F.lit(""))
    key = {"digest": F.unhex(F.sha1(html)), "check": F.xxhash64(html), "n_bytes": F.octet_length(html)}
    rows = pages.select("page_id", F.pmod(F.xxhash64("page_id"), F.lit(64)).cast("int").alias("run"), *(c.alias(n) for n, c in key.items()))
    rows = stash(rows.where(F.col("n_bytes") >= least).withColumn("at", F.struct(F.col("page_id").isNull().alias("unknown"), F.col("page_id").cast("long").alias("id"))), "payloads")
    best = representatives(rows, list(key), "at").where("n > 1")
    revisits = rows.join(best, ["run", *key]).where("at > best").select("page_id", *key, F.col("best.id").alias("refers_to")).distinct()
    revisits = small(stash(revisits, "revisits"))
    keyed = pages.select("page_id", "url", "html", *(c.alias(n) for n, c in key.items()))
    same = [keyed[n].eqNullSafe(revisits[n]) for n in ("page_id", *key)]
    found = keyed.join(revisits, same, "left").select(keyed["page_id"], "url", "html", "refers_to")
    return read_archives(write_archives(found, folder), folder)
