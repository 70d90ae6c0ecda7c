"""A deterministic, sharded writer of WARC 1.1 archives as a Python data source, and its reader.

`archived` tells which records are responses and which revisit another one, deals all of them to ranges of their key (id,
then a hash of address and payload) and writes each range in order. The bounds of the ranges hang on the rows alone: bytes are
summed by prefix of the key, and a prefix that holds more than a shard is split further, so that neither Spark's sampling nor
the number of machines shows in a file. A shard's task compresses each record by itself (a gzip member a record) and rolls to
the next file where the one it writes would pass `file_bytes` compressed. Dates are a parameter, ids and digests are derived
from the rows: the same rows give the same files.

Tasks write under temporary names, which carry no record that anybody reads; the driver renames the files of the attempts that
succeeded and publishes the manifest last, itself by a rename. A reader takes what the manifest lists: a run that was cut
short shows nothing, and a task that ran twice counts once. Folders are reached by `pyarrow.fs` (file, hdfs, s3, gs).

Null payloads are empty ones; payloads of `least` bytes or more that are equal are stored once, with the smallest id, and the
others are revisits. Rows that repeat that smallest id with the same payload are responses too. Null ids sort last; rows of a null id
revisit another id's record, but are never revisited. Rows that are equal in id, address and payload are written next to each other, one record each.
A record larger than a file's size has a file of its own. Only the id, address and payload columns are read."""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from lavra.llm.batches import pieces
from lavra.runtime import materialise

RECORDS = "page_id long, url string, record_type string, refers_to long, refers_to_url string, payload_digest string, payload binary"
READ = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, file string"
MANIFEST = "manifest.json"
EPOCH = "1970-01-01T00:00:00Z"
LEAST = 100  # bytes from which an equal payload is revisited
SHARDS = 2048  # a shard is this part of all payloads, within the next two
SHARD_LEAST, SHARD_MOST = 16 << 20, 1 << 30  # bytes of payloads a task
FILES = 8  # a file holds this part of a shard's bytes, compressed, at most
HEADERS = 500  # bytes by which a record weighs more than its payload
SALT = 32
FEW = 200_000  # repeated digests that are broadcast (about 100 bytes each)
FIRST_DIGITS, NEXT_DIGITS = 3, 3  # hexadecimal digits by which a key's prefix grows: a round gives up to 4,096 rows, and as many a prefix that is split


# --- records as bytes ---


def record_id(page_id: int | None, digest: str) -> str:
    """The name of a record, from what it holds."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16], version=5)}>"


def _member(kind: str, fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    squeezed = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member without time or name
    return squeezed.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + squeezed.flush()


def _line(text: str | None) -> str:
    """A header's value: no line may end within it."""
    return json.dumps(text or "", ensure_ascii=False)[1:-1]


def pack(row: dict, date: str = EPOCH, level: int = 6) -> bytes:
    """One record, compressed. A revisit has the headers of its payload and not the payload."""
    payload, digest = row["payload"] or b"", row["payload_digest"]
    fields = [("WARC-Record-ID", record_id(row["page_id"], digest)), ("WARC-Date", date), ("WARC-Target-URI", _line(row["url"]))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if row["page_id"] is not None:
        fields.append(("X-Page-Id", str(row["page_id"])))
    if row["url"] is None:
        fields.append(("X-No-Address", "1"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if row["record_type"] == "response":
        block = http + payload
    else:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(row["refers_to"], digest))]
        fields += [("WARC-Refers-To-Target-URI", _line(row["refers_to_url"])), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-Id", str(row["refers_to"]))]
        block = http
    fields.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    return _member(row["record_type"], fields, block, level)


def info(name: str, date: str = EPOCH, level: int = 6) -> bytes:
    """The record that a file begins with."""
    block = b"software: lavra\r\nformat: WARC File Format 1.1\r\n"
    return _member("warcinfo", [("WARC-Record-ID", record_id(None, name)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block, level)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a file, read as a stream: the records of a chunk are in memory, not the file."""
    out, held, begun = zlib.decompressobj(31), bytearray(), False
    for left in chunks:
        while left:
            held += out.decompress(left)
            left, begun = out.unused_data, not out.eof
            if out.eof:
                yield _record(bytes(held))
                out, held = zlib.decompressobj(31), bytearray()
    if begun:
        raise ValueError("the file ends within a record")


def _record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1" or not sep:
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, block


def unpack(headers: dict[str, str], block: bytes, file: str) -> tuple | None:
    """A row of `READ`; None for a file's own record. Digests are computed anew and held against the headers."""
    if headers["WARC-Type"] == "warcinfo":
        return None
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {headers['WARC-Record-ID']} in {file}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length, digest = int(http.rpartition(b": ")[2]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda k: int(headers[k]) if k in headers else None
    url = None if "X-No-Address" in headers else json.loads(f'"{headers["WARC-Target-URI"]}"')
    if headers["WARC-Type"] == "revisit":
        return number("X-Page-Id"), url, "revisit", number("X-Refers-To-Page-Id"), digest, length, None, file
    if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload digest of {headers['WARC-Record-ID']} in {file}")
    return number("X-Page-Id"), url, "response", None, digest, length, payload, file


# --- the data source ---


@dataclass
class Written(WriterCommitMessage):
    """Files of a task that succeeded: (temporary name, final name, bytes, records, digest of the file)."""

    files: list[tuple[str, str, int, int, str]]


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


class WarcWriter(DataSourceArrowWriter):
    """Rows (shard, then `RECORDS`) come sorted; a partition holds whole shards."""

    def __init__(self, options):
        self.path, self.date, self.level = options["path"], options.get("date", EPOCH), int(options.get("level", 6))
        self.most = int(options["file_bytes"])
        self.run = options["run"]

    def write(self, iterator) -> Written:
        system, root = _folder(self.path)
        temporary = f"{root}/_temporary/{self.run}"
        system.create_dir(temporary, recursive=True)
        files, sink, shard, part = [], None, None, 0

        def close():
            nonlocal sink
            if sink:
                sink.close()
                files.append((at, name, size, count, digest.hexdigest()))
                sink = None

        for batch in iterator:
            for piece in pieces(iter([batch]), "payload"):
                for row in piece.to_pylist():
                    data = pack(row, self.date, self.level)
                    if row["shard"] != shard:
                        close()
                        shard, part = row["shard"], 0
                    elif sink and size + len(data) > self.most:
                        close()
                        part += 1
                    if sink is None:
                        name = f"part-{shard:06d}-{part:05d}.warc.gz"
                        at, head = f"{temporary}/{name}.{uuid.uuid4().hex}", info(name, self.date, self.level)
                        sink, digest, size, count = system.open_output_stream(at), hashlib.sha256(head), len(head), 0
                        sink.write(head)
                    sink.write(data)
                    digest.update(data)
                    size, count = size + len(data), count + 1
        close()
        return Written(files)

    def commit(self, messages) -> None:
        """Files get their names first and the manifest last: until then a reader sees none of them."""
        system, root = _folder(self.path)
        listed = []
        for at, name, size, count, digest in sorted((f for m in messages if m for f in m.files), key=lambda f: f[1]):
            system.move(at, f"{root}/{name}")
            listed.append({"file": name, "bytes": size, "records": count, "sha256": digest})
        system.create_dir(root, recursive=True)
        draft = f"{root}/_{MANIFEST}.{self.run}"
        with system.open_output_stream(draft) as out:
            out.write((json.dumps({"files": listed}, indent=1) + "\n").encode())
        system.move(draft, f"{root}/{MANIFEST}")
        self._clear(system, root)

    def abort(self, messages) -> None:
        self._clear(*_folder(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        """What lost attempts have left."""
        if system.get_file_info(f"{root}/_temporary/{self.run}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/_temporary/{self.run}")


class WarcReader(DataSourceReader):
    """A partition a file of the manifest."""

    def __init__(self, options):
        self.path, self.whole = options["path"], options.get("payload", "true") == "true"

    def partitions(self):
        return [InputPartition(f["file"]) for f in manifest(self.path)] or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        system, root = _folder(self.path)
        with system.open_input_stream(f"{root}/{partition.value}", compression=None) as source:
            rows, held = [], 0
            for headers, block in records(iter(lambda: source.read(1 << 20), b"")):
                if row := unpack(headers, block, partition.value):
                    rows.append(row if self.whole else (*row[:6], None, row[7]))
                    held += len(block)
                if held >= 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, kinds = zip(*(x.split() for x in READ.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], list(names))


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def manifest(path: str) -> list[dict]:
    """The files that are published in a folder; an archive without a manifest is none."""
    system, root = _folder(path)
    with system.open_input_stream(f"{root}/{MANIFEST}") as source:
        return json.loads(source.read())["files"]


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of an archive, rows of `READ`; without `payload` that column is null, though what it held was read and checked."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


# --- rows to shards ---


def described(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(`RECORDS` of all rows with `key`, the order in which they are written; `key` and `bytes` of all rows, written once). Payloads
    move once, to their shard: which record a payload is first in is found by digests alone, which are joined by salted digests
    where those that repeat are too many to broadcast."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("key", key())
    facts = materialise(rows.select("page_id", "url", "payload_digest", "key", F.length("payload").cast("long").alias("bytes")), "warc-facts")
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = facts.where(F.col("bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", named).alias("first_url"), F.count("*").alias("n"))
    again = materialise(first.where("n > 1 and first_id is not null").drop("n"), "warc-repeated")
    if again.count() <= FEW:
        met = rows.join(F.broadcast(again), "payload_digest", "left")
    else:
        salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["payload_digest", "salt"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    met = met.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    met = met.withColumn("refers_to", F.when(revisit, F.col("first_id"))).withColumn("refers_to_url", F.when(revisit, F.col("first_url")))
    return met.select(*(x.split()[0] for x in RECORDS.split(", ")), "key"), facts.select("key", (F.col("bytes") + HEADERS).alias("bytes"))


def key() -> Column:
    """32 hexadecimal digits that sort as the id (null last), then by a hash of address and digest."""
    own = F.coalesce(F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("G" * 16))
    return F.concat(own, F.lpad(F.hex(F.xxhash64("url", "payload_digest")), 16, "0"))


def bounds(weights: DataFrame, size: int) -> list[tuple[str, int]]:
    """(prefix, shard) of prefixes that cover all keys of `weights` (key, bytes) and of which none begins another one: shards are runs
    of prefixes in order that hold up to `size` bytes, or a single prefix. A prefix beyond `size` is split until it is a whole key."""
    low, high = weights.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return []
    same = next((i for i in range(len(low)) if low[i] != high[i]), len(low))
    done, heavy, before, length = [], None, 0, min(len(low), same + FIRST_DIGITS)
    while heavy is None or heavy:
        own = weights if heavy is None else weights.where(F.substring("key", 1, before).isin(heavy))
        sums = own.groupBy(F.substring("key", 1, length).alias("prefix")).agg(F.sum("bytes").alias("bytes")).collect()
        heavy = [r["prefix"] for r in sums if r["bytes"] > size and length < len(low)]
        split = set(heavy)
        done += [(r["prefix"], r["bytes"]) for r in sums if r["prefix"] not in split]
        before, length = length, min(len(low), length + NEXT_DIGITS)
    out, shard, held = [], 0, 0
    for prefix, n in sorted(done):
        if held and held + n > size:
            shard, held = shard + 1, 0
        out.append((prefix, shard))
        held += n
    return out


def sharded(rows: DataFrame, found: list[tuple[str, int]]) -> DataFrame:
    """`rows` of `described` with `shard`, a partition a shard, sorted by key."""
    shard = F.lit(None).cast("int")
    for length in sorted({len(p) for p, _ in found}):
        own = rows.sparkSession.createDataFrame([x for x in found if len(x[0]) == length], f"_p{length} string, _s{length} int")
        rows = rows.join(F.broadcast(own), F.substring("key", 1, length) == F.col(f"_p{length}"), "left")
        shard = F.coalesce(shard, F.col(f"_s{length}"))
    dealt = rows.withColumn("shard", shard).repartitionById(found[-1][1] + 1 if found else 1, F.col("shard"))
    return dealt.sortWithinPartitions("shard", "key", "url", "payload_digest").select("shard", *(x.split()[0] for x in RECORDS.split(", ")))


def write(rows: DataFrame, weights: DataFrame, path: str, size: int | None = None, file_bytes: int | None = None, date: str = EPOCH, level: int = 6) -> None:
    """Writes the rows of `described` as an archive in an empty or new folder; `size` of a shard and `file_bytes` by the constants above."""
    spark = rows.sparkSession
    if size is None:
        size = max(SHARD_LEAST, min(SHARD_MOST, (weights.agg(F.sum("bytes")).first()[0] or 0) // SHARDS))
    spark.dataSource.register(Warc)
    options = {"file_bytes": file_bytes or size // FILES, "date": date, "level": level, "run": uuid.uuid4().hex}
    sharded(rows, bounds(weights, size)).write.format("warc").mode("append").options(**options).save(path)


def archived(pages: DataFrame, path: str, payload: bool = True, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """Writes all rows of `pages` to an archive at `path` and gives the records that were read back."""
    write(*described(pages, id_col, url_col, payload_col, least), path)
    return read(pages.sparkSession, path, payload)
