"""WARC archives: a deterministic sharded writer, and a reader.

Pages are range-sorted by id, then payload and address: each shard is a range, written as gzip members,
one a record, and a new file begins when the next record would take the file over a stated compressed
size. How many shards there are comes from the pages' size, and where they begin from a sample that is
taken by hash, so both depend on the pages alone, not on how they are dealt. Headers and digests are
made anew from the pages, with a date that is a parameter, so equal input gives equal bytes. A
file is written under a temporary name and renamed when it is whole; the manifest, one JSON line a
file, is committed by Spark and names only files of tasks that succeeded. A task that is run again
replaces its files by equal ones.

Folders may be in any store that Spark and pyarrow both reach by the same URI; executors write there
directly. No record is held longer than it takes to write it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, sized, written

_MANIFEST = "file string, bytes bigint, records bigint, first_id bigint, last_id bigint, sha256 string"
_RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint"
_READ, _STEP = 1 << 20, 1 << 14


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}/{payload_digest}')}>"


def _plain(text: str) -> str:
    """A header value in one line: what is no printable ASCII is percent-encoded."""
    return "".join(c if " " <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record, not compressed. A revisit has the HTTP header alone."""
    mark = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, mark + '/r' * revisit)}", f"WARC-Date: {date}"]
    head.append(f"WARC-Target-URI: {_plain(url) if url else f'urn:page:{page_id}'}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, mark)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{mark}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html and refers: the largest id with the same payload, where several rows have it.

    Payloads under ``least_bytes`` are not compared. Only ids and digests are shuffled to find them.
    """
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1("html"))
    same = base.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many")
    same = sized(written(pages.sparkSession, same, "warc-same"))
    return base.join(same, "digest", "left").select("page_id", "url", "html", "refers", "digest")


#: Shards at most, and sampled rows a shard, about: both bound what comes to the driver.
_MOST_SHARDS, _SAMPLED = 1 << 15, 32
_NULL = -(1 << 63)


def _sharded(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Adds ``tie``, which orders rows of one id, and ``shard``, the range of (id, tie) that a row is in."""
    rows = rows.withColumns({"tie": F.xxhash64("digest", "url"), "id": F.coalesce("page_id", F.lit(_NULL))})
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()
    shards = max(1, min(_MOST_SHARDS, -(-size // shard_bytes)))
    one_in = max(1, n // (shards * _SAMPLED))
    some = sorted((r.id, r.tie) for r in rows.filter(F.pmod(F.xxhash64("id", "tie"), F.lit(one_in)) == 0).select("id", "tie").distinct().collect()) if shards > 1 else []
    bounds = sorted({some[len(some) * i // shards] for i in range(1, shards)}) if some else []
    ids, ties = (np.array([b[i] for b in bounds], np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def shard(id_: pd.Series, tie: pd.Series) -> pd.Series:
        a, b = id_.to_numpy(), tie.to_numpy()
        lo, hi = np.searchsorted(ids, a, "left"), np.searchsorted(ids, a, "right")
        for i in np.flatnonzero(lo < hi):
            lo[i] += np.searchsorted(ties[lo[i] : hi[i]], b[i], "right")
        return pd.Series(lo.astype(np.int32))

    return rows.withColumn("shard", shard("id", "tie")).repartition(shards, "shard").sortWithinPartitions("shard", "id", "tie").drop("id", "tie", "digest")


def write_archives(pages: DataFrame, folder: str, most_bytes: int = 64 << 20, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0, shard_bytes: int = 16 << 20) -> None:
    """Writes all pages below ``folder`` and the manifest in ``folder``/manifest.

    A shard has about ``shard_bytes`` bytes of payload, or more where 32768 shards do not suffice.

    Of rows with equal payloads of at least ``least_bytes`` bytes, those of the largest id are
    responses and the others revisits of it. Null payloads are empty; null urls get a URN; null ids
    come first and have no id header; repeated rows are records of their own, side by side; an empty
    table gives an empty manifest.
    """
    rows = _sharded(with_revisits(pages, least_bytes), shard_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        attempt, made, part = TaskContext.get().taskAttemptId(), 0, -1
        out, done, files = None, {}, []

        def close() -> None:
            nonlocal out, made
            out.close()
            final = f"{root}/{done['file']}"
            if store.get_file_info(final).type.name != "NotFound":
                store.delete_file(final)
            store.move(f"{root}/_temporary/{attempt}-{done['file']}", final)
            files.append((done["file"], done["bytes"], done["records"], done["first"], done["last"], done["sha"].hexdigest()))
            out, made = None, made + 1

        store.create_dir(f"{root}/_temporary", recursive=True)
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, refers, shard = (batch.column(c)[i].as_py() for c in ("page_id", "url", "html", "refers", "shard"))
                data = _member(record(page, url, html.encode(), refers, refers is not None and refers != page, date))
                if out is not None and (shard != part or done["bytes"] + len(data) > most_bytes):
                    close()
                if shard != part:
                    part, made = shard, 0
                if out is None:
                    done = {"file": f"part-{part:05d}-{made:05d}.warc.gz", "bytes": 0, "records": 0, "first": page, "sha": hashlib.sha256()}
                    out = store.open_output_stream(f"{root}/_temporary/{attempt}-{done['file']}", compression=None)
                    info = b"software: quernworks\r\nformat: WARC File Format 1.1\r\n"
                    name = uuid.uuid5(uuid.NAMESPACE_URL, done["file"])
                    first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nWARC-Filename: {done['file']}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"
                    first = _member(first)
                    out.write(first)
                    done["sha"].update(first)
                    done["bytes"] += len(first)
                out.write(data)
                done["sha"].update(data)
                done |= {"bytes": done["bytes"] + len(data), "records": done["records"] + 1, "last": page}
        if out is not None:
            close()
        columns = list(zip(*files, strict=True)) or [()] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "bytes", "records", "first_id", "last_id", "sha256"])

    rows.mapInArrow(write, _MANIFEST).write.json(f"{folder}/manifest")


def members(blocks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """The offset and content of each gzip member of a stream."""
    inflate, at, start, parts = zlib.decompressobj(31), 0, 0, []
    for block in blocks:
        for lo in range(0, len(block), _STEP):  # what follows a member is copied, so only a little is given at once
            piece = block[lo : lo + _STEP]
            while piece:
                parts.append(inflate.decompress(piece))
                at += len(piece) - len(inflate.unused_data)
                piece = inflate.unused_data
                if not inflate.eof:
                    break
                yield start, b"".join(parts)
                inflate, start, parts = zlib.decompressobj(31), at, []
    if parts and any(parts):
        raise ValueError("a record is cut off")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (with lower-case names) and block of a record, its length and digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    size = int(fields["content-length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n" or "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"a damaged record: {fields.get('warc-record-id')}")
    return fields, block


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of the files in the manifest; each file's digest and each block's is checked."""
    files = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").select("file", "sha256")
    files = files.repartition(max(1, files.count()), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name, sha in zip(batch.column("file").to_pylist(), batch.column("sha256").to_pylist(), strict=True):
                rows, seen = [], hashlib.sha256()
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:

                    def blocks(stream=stream, seen=seen) -> Iterator[bytes]:
                        while block := stream.read(_READ):
                            seen.update(block)
                            yield block

                    for offset, data in members(blocks()):
                        fields, block = parse(data)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        mark = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and (len(payload) != length or digest(payload) != mark):
                            raise ValueError(f"a damaged payload: {fields['warc-record-id']}")
                        page, refers = (int(x) if (x := fields.get(f)) is not None else None for f in ("x-page-id", "x-refers-to-page"))
                        rows.append((page, fields["warc-target-uri"], length, mark, fields["warc-type"], refers, name, offset))
                if seen.hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest says")
                columns = list(zip(*rows, strict=True)) or [()] * 8
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return files.mapInArrow(read, _RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to the shared scratch folder and reads them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, folder, **options)
    return read_archives(pages.sparkSession, folder)


SQL = """
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest from pages),
w as (select page_id, html, digest, max(page_id) over (partition by digest) as last from p),
bits as (select page_id, string_agg(lpad(bin(('0x' || substr(digest, i, 10))::bigint), 40, '0'), '' order by i) as b
  from w, (select unnest([1, 11, 21, 31]) as i) group by page_id, digest),
coded as (select page_id, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(b, 5 * j + 1, 5))::int, 1), '' order by j)
  from (select unnest(range(32)) as j)) as payload_digest from bits)
select w.page_id, strlen(html) as payload_bytes, payload_digest, case when w.page_id = last then 'response' else 'revisit' end as record_type,
  case when w.page_id = last then null else last end as refers_to
from w join coded using (page_id)
"""
