"""WARC archives from a table of pages, written shard by shard and read back.

Records are range-sorted by key into shards whose bounds depend on the keys alone. A shard's task
writes gzip members, one a record, and begins a new file once a file's compressed size reaches the
roll size; headers and digests are made anew from the payload. A file is written under a temporary
name and renamed when it is whole. The manifest names the files that count; it is written last, as a
folder of its own, again under a temporary name. A shard that is written again gives the same bytes under
the same names, and how many shards there are follows from the payloads' bytes, not from their layout.

Of records with equal payloads one is the response, the others are revisits that refer to it; a
revisit keeps the HTTP headers of the page and no payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import file_system, range_shard, single, text_of
from tidemark.session import cut_lineage

#: Compressed bytes at which a file is closed, and the level of compression.
ROLL_BYTES, LEVEL = 32 << 20, 4
#: Payload bytes of a shard, on average.
SHARD_BYTES = 32 << 20
#: The date of every record: output depends on the input alone.
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs

MANIFEST = "path string, shard int, file int, records long, n_bytes long, first_key long, last_key long, sha256 string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{key}:{digest}')}>"


def _header_value(value: str) -> str:
    """One line: header values hold no line ends."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def record(key: int | None, url: str, payload: bytes, response_key: int | None, repeated: bool) -> bytes:
    """The bytes of one record. ``repeated``: a revisit of the record of ``response_key``."""
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if repeated else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if repeated else 'response'}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_header_value(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}",
    ]
    if repeated:
        refers = [] if response_key is None else [f"WARC-Refers-To-Page: {response_key}"]
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(response_key, digest)}", *refers]
    if key is not None:
        lines.append(f"WARC-Page: {key}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roller:
    """Files of one shard, each whole before it gets its name."""

    def __init__(self, folder: str, roll_bytes: int, level: int):
        self.store, self.root = file_system(folder)
        self.folder, self.roll_bytes, self.level = folder, roll_bytes, level
        self.out, self.shard, self.file, self.done = None, None, 0, []

    def add(self, shard: int, key: int | None, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.file = shard, 0
        if self.out is None:
            self.name = f"shard-{shard:06d}-{self.file:04d}.warc.gz"
            self.draft = f"{self.root}/{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.count, self.size, self.sum = self.store.open_output_stream(self.draft), 0, 0, hashlib.sha256()
            self.first = key
        packer = zlib.compressobj(self.level, zlib.DEFLATED, 31)  # a gzip member without name or time
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        self.sum.update(member)
        self.count, self.size, self.last = self.count + 1, self.size + len(member), key
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        self.store.move(self.draft, f"{self.root}/{self.name}")
        self.done.append((f"{self.folder}/{self.name}", self.shard, self.file, self.count, self.size, self.first, self.last, self.sum.hexdigest()))
        self.file += 1


def _written(batches: Iterator[pa.RecordBatch], folder: str, roll_bytes: int, level: int) -> Iterator[pa.RecordBatch]:
    files = _Roller(folder, roll_bytes, level)
    shared = before = None
    for batch in batches:
        columns = [single(batch, c) for c in ("shard", "key", "sha", "told", "response", "url", "payload")]
        for i in range(len(batch)):
            shard, key, sha, told, response, url, payload = (c[i].as_py() for c in columns)
            if told == 0:  # what is known of the records with this key and payload
                shared = (key, sha, response)
                continue
            same = shared is not None and shared[:2] == (key, sha)
            repeated = same and (key != shared[2] or before == (key, sha))
            before = (key, sha)
            files.add(shard, key, record(key, url, payload.encode(), shared[2] if same else None, repeated))
    files.close()
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    yield pa.record_batch([pa.array([r[c] for r in files.done], kinds[c]) for c in range(len(names))], names=names)


def write_archives(pages: DataFrame, folder: str, payload: str = "html", key: str = "page_id", url: str = "url", least_bytes: int = 0, roll_bytes: int = ROLL_BYTES, level: int = LEVEL, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes one record per row into ``folder``; returns the manifest (a row per file).

    Null payloads and URLs are empty. Of equal payloads of at least ``least_bytes`` bytes the row with
    the largest key is the response (of repeated rows of that key the first); shorter ones are all
    responses. Null keys come first and are smaller than others. An empty table writes nothing.

    Payloads are shuffled once, by the range of their key. What their records need to know of equal
    payloads elsewhere is found on digests and travels to the shard as rows without payload.
    """
    store, root = file_system(folder)
    store.create_dir(root, recursive=True)
    body = text_of(payload).cast("binary")
    sha = F.unhex(F.sha2(body, 256))
    keyed = cut_lineage(pages.select(F.col(key).cast("long").alias("key"), sha.alias("sha"), F.octet_length(body).alias("size")))
    repeats = keyed.filter(F.col("size") >= least_bytes).groupBy("sha").agg(F.max("key").alias("response"), F.count(F.lit(1)).alias("n"))
    told = keyed.select("key", "sha").distinct().join(repeats.filter("n > 1"), "sha")
    told = told.select("key", "sha", F.lit(0).alias("told"), "response", F.lit("").alias("url"), F.lit("").alias("payload"))
    records = pages.select(
        F.col(key).cast("long").alias("key"), sha.alias("sha"), F.lit(1).alias("told"), F.lit(None).cast("long").alias("response"),
        text_of(url).alias("url"), text_of(payload).alias("payload"),
    )
    shards = -(-(keyed.agg(F.sum("size")).first()[0] or 0) // shard_bytes) or 1
    # Before the union: the planner would otherwise carry the shard's constraints through it.
    shard = range_shard(keyed, "key", shards)
    rows = records.withColumn("shard", shard).unionByName(told.withColumn("shard", shard))
    laid = rows.repartitionById(shards, F.col("shard")) if shards > 1 else rows.coalesce(1)
    laid = laid.sortWithinPartitions("shard", "key", "sha", "told", "url")
    draft = f"{folder}/manifest-{uuid.uuid4().hex}.tmp"
    laid.mapInArrow(lambda it: _written(it, folder, roll_bytes, level), MANIFEST).write.parquet(draft)
    store.move(f"{root}/{draft.rpartition('/')[2]}", f"{root}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


# --- reading -----------------------------------------------------------------------------------
def members(store, path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, each decompressed; one at a time is held."""
    with store.open_input_stream(path, compression=None) as f:
        rest = f.read(chunk)
        while rest:
            unpacker, parts = zlib.decompressobj(31), []
            while not unpacker.eof:
                if not rest:
                    raise EOFError(f"{path} ends inside a record")
                parts.append(unpacker.decompress(rest))
                rest = unpacker.unused_data if unpacker.eof else f.read(chunk)
            yield b"".join(parts)
            rest = rest or f.read(chunk)


def headers_of(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        found[name.strip().lower().decode()] = value.strip().decode()
    return found


def parsed(member: bytes) -> dict:
    """A record as a row; digests and lengths are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    warc = headers_of(head)
    block = rest[: int(warc["content-length"])]
    if f"sha1:{digest_of(block)}" != warc["warc-block-digest"]:
        raise ValueError(f"block digest of {warc['warc-record-id']} is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    if warc["warc-type"] == "response" and digest_of(payload) != digest:
        raise ValueError(f"payload digest of {warc['warc-record-id']} is wrong")
    page, refers = warc.get("warc-page"), warc.get("warc-refers-to-page")
    return {
        "page_id": page and int(page), "url": warc["warc-target-uri"], "record_type": warc["warc-type"], "refers_to": refers and int(refers),
        "payload_bytes": int(headers_of(http)["content-length"]), "payload_digest": digest, "payload": payload if warc["warc-type"] == "response" else None,
    }


RECORD = {"page_id": "long", "url": "string", "record_type": "string", "refers_to": "long", "payload_bytes": "long", "payload_digest": "string", "payload": "binary"}
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _read(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, inner = file_system(path)
            rows, held = [], 0
            for member in members(store, inner):
                rows.append(parsed(member))
                held += len(member)
                if held >= 8 << 20 or len(rows) >= 5_000:
                    yield _rows(rows, names)
                    rows, held = [], 0
            yield _rows(rows, names)


def _rows(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[n] for r in rows], ARROW[RECORD[n]]) for n in names], names=names)


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A row per record of the files in the manifest: page_id, url, record_type, refers_to,
    payload_bytes and payload_digest (of the full payload) and, if asked, the payload of responses."""
    names = [n for n in RECORD if payload or n != "payload"]
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, manifest.rdd.getNumPartitions())
    files = manifest.select("path").repartition(tasks, "path")
    return files.mapInArrow(lambda it: _read(it, names), ", ".join(f"{n} {RECORD[n]}" for n in names))
