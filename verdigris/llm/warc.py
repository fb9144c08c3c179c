"""WARC archives in Zstandard frames: one frame for each record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._common import bound_batches, stage

#: Magic number of the skippable frame that holds a dictionary (fixed by the format).
DICTIONARY_FRAME = 0x184D2A5D
#: The dictionary is trained on so many payloads of at most so many bytes each.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 100_000, 64 * 1024
#: An archive is closed once it holds so many bytes: a bound of a task's memory, besides its largest record.
ARCHIVE_BYTES = 4 << 20
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: the HTTP response with its payload, or for a revisit its head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else "".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None,
        "WARC-Refers-To": f"<urn:page:{refers_to}>" if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one whole record; raises ValueError where headers or lengths are wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or version != VERSION:
        raise ValueError("no WARC version line or no end of the header")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name.lower() in fields:
            raise ValueError(f"bad header line {line[:40]!r}")
        fields[name.lower()] = value.strip().decode()
    if missing := {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"} - fields.keys():
        raise ValueError(f"missing header {sorted(missing)[0].decode()}")
    length = fields[b"content-length"]
    if not length.isdecimal() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length isn't as stated")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = [line.partition(b":")[2].strip() for line in http.split(b"\r\n")[1:] if line.lower().startswith(b"content-length:")]
    if not gap or len(stated) != 1 or not stated[0].isdigit():
        raise ValueError("no HTTP head with one length")
    digest = fields.get(b"warc-payload-digest", "")
    if fields[b"warc-type"] == "response":
        if int(stated[0]) != len(payload):
            raise ValueError("the payload's length isn't as stated")
        if digest != f"sha1:{payload_digest(payload)}":
            raise ValueError("the payload's digest isn't as stated")
    elif payload:
        raise ValueError("a revisit with a payload")
    return {
        "page_id": _page(fields[b"warc-record-id"]),
        "payload_bytes": int(stated[0]),
        "payload_digest": digest.removeprefix("sha1:"),
        "record_type": fields[b"warc-type"],
        "refers_to": _page(fields.get(b"warc-refers-to", "")),
        "payload": payload if fields[b"warc-type"] == "response" else None,
    }


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdecimal() else None


def train_dictionary(pages: DataFrame, id_col: str, html_col: str, sample: int = SAMPLE) -> bytes:
    """A Zstandard dictionary of about ``sample`` payloads, drawn by a hash of the id; empty if they are too few.

    The share that brings so many is filtered where the pages lie; only what is drawn goes to the driver.
    """
    import zstandard

    html, share = F.col(html_col), sample / max(pages.count(), sample)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("dictionary")), F.lit(1 << 40)) / float(1 << 40)
    drawn = pages.where((draw < share) & html.isNotNull() & (F.octet_length(html) <= SAMPLE_BYTES)).select(html.alias("h")).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.h.encode("utf-8", "surrogatepass") for r in drawn]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One WARC record for each page, in archives of bounded size: ``archive`` (name), ``content`` (the whole file).

    Equal payloads are found by their SHA-1: sums of one small row a page, which combine on the map side. The page
    with the largest id carries the payload, the others revisit it; pages that share that id, or of which all ids are null (nothing could
    refer to them), all carry it. Pages meet what was decided for them by id.
    """
    import zstandard

    bound_batches(pages.sparkSession)
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages, id_col, html_col))
    html = F.coalesce(F.col(html_col), F.lit(""))
    digests = stage(pages.select(F.col(id_col).alias("page_id"), F.sha1(html.cast("binary")).alias("digest")), "payloads")
    groups = digests.groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = stage(digests.join(groups, "digest").where("top is not null and (page_id < top or page_id is null)").select("page_id", "digest", "top").distinct(), "revisits")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    key = rows["page_id"].eqNullSafe(revisits["page_id"]) & (rows["digest"] == revisits["digest"])
    rows = rows.join(revisits, key, "left").select(rows["page_id"], "url", "html", "top", revisits["digest"].isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=held, write_content_size=True)
        start = struct.pack("<II", DICTIONARY_FRAME, len(dictionary.value)) + dictionary.value
        frames, size = [start], 0

        def archive() -> pa.RecordBatch:
            content = b"".join(frames)
            name = hashlib.sha1(content).hexdigest() + ".warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for page_id, url, text, top, revisit in zip(*[batch.column(i) for i in range(5)], strict=True):
                payload = text.as_py().encode("utf-8", "surrogatepass")
                frames.append(packer.compress(record_bytes(page_id.as_py(), url.as_py(), payload, top.as_py(), revisit.as_py())))
                size += len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    frames, size = [start], 0
        if len(frames) > 1:
            yield archive()

    return rows.mapInArrow(run, "archive string, content binary")


def _dictionary(data: bytes) -> bytes:
    """The dictionary itself: the frame may hold it as a Zstandard frame."""
    import zstandard

    if not data.startswith(zstandard.FRAME_HEADER):
        return data
    try:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    except zstandard.ZstdError as error:
        raise ValueError(f"the dictionary can't be read: {error}") from None


def frames_of(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive; its dictionary comes from the skippable frame at its head, if there is one."""
    import zstandard

    at, held = 0, None
    if len(content) >= 8:
        magic, size = struct.unpack_from("<II", content)
        if magic == DICTIONARY_FRAME:
            if len(content) < 8 + size:
                raise ValueError("the dictionary frame is cut off")
            held = zstandard.ZstdCompressionDict(_dictionary(content[8 : 8 + size])) if size else None
            at = 8 + size
    opener, view = zstandard.ZstdDecompressor(dict_data=held), memoryview(content)
    while at < len(content):
        frame, parts, step = opener.decompressobj(), [], 16_384
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the last frame is cut off")
            piece = view[at : at + step]
            try:
                parts.append(frame.decompress(piece))
            except zstandard.ZstdError as error:
                raise ValueError(f"not a frame: {error}") from None
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of whole archive files (``content``: binary, as in ``write_archives`` or the ``binaryFile`` source).

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, problem`` and with ``payloads`` the payload. A record
    with a wrong header, length or digest, and an archive that can't be read on, give a row with ``problem`` alone.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"
    if payloads:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], schema + ", payload binary"

    def rows(content: bytes) -> Iterator[dict]:
        try:
            for data in frames_of(content):
                try:
                    yield parse_record(data)
                except ValueError as error:
                    yield {"problem": str(error)}
        except ValueError as error:
            yield {"problem": str(error)}

    order = [*names[:5], "problem", *names[5:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found, size = [], 0
                for row in rows(content.as_py() or b""):
                    found.append(row)
                    size += len(row.get("payload") or b"") if payloads else 0
                    if size > ARCHIVE_BYTES or len(found) >= 10_000:
                        yield _batch(found, order, types)
                        found, size = [], 0
                yield _batch(found, order, types)

    return archives.select("content").mapInArrow(run, schema)


def _batch(rows: list[dict], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to archives in the shared folder and read these back.

    Defined results: a null html has an empty payload; a null url leaves its header out; a null id stays null and
    loses to any other id, and equal payloads whose ids are all null are responses; rows repeated with the same id and payload get records of the same kind; other
    columns are neither read nor returned; an empty table gives no archive and an empty result.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, problem`` (null: the record is valid).
    """
    return read_archives(stage(write_archives(pages, id_col, url_col, html_col), "archives"))
