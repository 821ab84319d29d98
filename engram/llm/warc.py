"""WARC archives and an external merge of their capture index.

1. Pages are written as WARC records, one gzip member each: a response holds the payload, a revisit refers to the response
   of the smallest page_id with the same payload. Archives have a random part in their names; only those in the
   committed manifest count, so a task that runs again does no harm.
2. Each archive is read back, record by record; its captures are sorted by URL key, timestamp and page and written as a
   run: compressed pieces of lines with a sparse index of first keys.
3. Runs are merged with a loser tree, FAN_IN at a time, until at most FAN_IN are left; the last merge is dealt out by key
   ranges, and each task seeks in the runs through their sparse indexes and merges its range. A task holds one piece of
   each run. The result is ordered over the ranges and within them: the capture histories of all URLs."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import BIG_ID, cut, drop, filesystem, fresh_path, owned

FAN_IN, PIECE, SAMPLES = 64, 2000, 64
ARCHIVE_BYTES = 1 << 26


def url_key(url: str | None) -> str:
    """The host's labels reversed and the path, in lower case, as capture indexes order them; '-' without a URL."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url if "://" in url else "http://" + url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:
        return "!" + " ".join(url.lower().split())
    key = ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return "".join(c for c in key.lower() if c >= " ") or "-"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, stamp: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the length and digest of the payload it stands for."""
    date = datetime.fromtimestamp(stamp, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    target = "" if url is None else f"WARC-Target-URI: {''.join(c for c in url if c >= ' ')}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    kind = "response" if refers_to is None else "revisit"
    lines = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\n{target}"
    lines += f"WARC-Payload-Digest: sha1:{digest_of(payload)}\r\nContent-Type: application/http; msgtype=response\r\nPage-ID: {'' if page_id is None else page_id}\r\nPayload-Length: {len(payload)}\r\n"
    if refers_to is not None:
        lines += f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nRefers-To-Page-ID: {refers_to}\r\n"
    raw = f"{lines}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"
    z = zlib.compressobj(6, wbits=31)
    return z.compress(raw) + z.flush()


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; holds one record at a time."""
    at, buffer = 0, b""
    while True:
        z, out, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not buffer and not (buffer := stream.read(1 << 18)):
                if used:
                    raise ValueError("an archive ends within a record")
                return
            out.append(z.decompress(buffer))
            used += len(buffer) - len(z.unused_data)
            buffer = z.unused_data
        yield at, used, b"".join(out)
        at += used


def parse(raw: bytes) -> dict:
    """Type, URL, date, page, payload length and digest of a record; a response's payload is checked against its digest."""
    head, _, block = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
    h |= {k[:-1]: "" for k in head.decode("utf-8", "surrogatepass").split("\r\n") if k.endswith(":")}
    block = block[: int(h["Content-Length"])]
    number = lambda x: int(x) if x and x.strip() else None
    out = {"type": h["WARC-Type"], "url": h.get("WARC-Target-URI"), "stamp": int(datetime.strptime(h["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp()), "page_id": number(h.get("Page-ID")), "digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "bytes": int(h["Payload-Length"]), "refers_to": number(h.get("Refers-To-Page-ID"))}
    if out["type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if digest_of(payload) != out["digest"] or len(payload) != out["bytes"]:
            raise ValueError(f"payload of page {out['page_id']} is damaged")
    return out


class RunWriter:
    """Lines (JSON lists that start with the key) in compressed pieces; the sparse index of first keys is the last piece."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.out, self.at, self.lines, self.index = fs.open_output_stream(at), 0, [], []

    def add(self, line: list) -> None:
        self.lines.append(line)
        if len(self.lines) == PIECE:
            self._flush()

    def _flush(self) -> None:
        if self.lines:
            raw = zlib.compress("\n".join(map(json.dumps, self.lines)).encode(), 1)
            self.index.append([key_of(self.lines[0]), self.at, len(raw)])
            self.out.write(raw)
            self.at += len(raw)
            self.lines = []

    def close(self) -> None:
        self._flush()
        raw = zlib.compress(json.dumps(self.index).encode(), 1)
        self.out.write(raw + len(raw).to_bytes(8, "little"))
        self.out.close()


def key_of(line: list) -> list:
    """URL key, timestamp, page (null last), archive and offset: a total order."""
    return [line[0], line[1], BIG_ID if line[2] is None else line[2], line[7], line[8]]


class Run:
    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.index = json.loads(zlib.decompress(self.file.read_at(n, size - 8 - n)))

    def since(self, low: list | None, high: list | None) -> Iterator[tuple[list, list]]:
        """(key, line) of the keys in [low, high)."""
        first = 0 if low is None else max(0, bisect_right([x[0] for x in self.index], low) - 1)
        for key, at, n in self.index[first:]:
            if high is not None and key >= high:
                return
            for text in zlib.decompress(self.file.read_at(n, at)).decode().split("\n"):
                line = json.loads(text)
                k = key_of(line)
                if high is not None and k >= high:
                    return
                if low is None or k >= low:
                    yield k, line


def loser_tree(runs: list[Iterator[tuple[list, list]]]) -> Iterator[list]:
    """k-way merge: inner nodes keep the loser of their match, so each line costs one path of log2 k comparisons."""
    k = len(runs)
    heads = [next(r, None) for r in runs]
    beats = lambda i, j: heads[j] is None or (heads[i] is not None and (heads[i][0], i) <= (heads[j][0], j))
    losers = [-1] * k

    def play(node: int) -> int:
        if node >= k:
            return node - k
        i, j = play(2 * node), play(2 * node + 1)
        winner, losers[node] = (i, j) if beats(i, j) else (j, i)
        return winner

    top = play(1) if k > 1 else 0
    while k and heads[top] is not None:
        yield heads[top][1]
        heads[top] = next(runs[top], None)
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


CAPTURE = "url_key string, stamp long, page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, archive string, offset long, length long"
KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
NAMES = ["url_key", "stamp", "page_id", "record_type", "payload_digest", "payload_bytes", "refers_to", "archive", "offset", "length"]
EPOCH = 1_704_067_200


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes pages(page_id, url, html[, stamp]) as archives in the folder; returns their paths. Without stamps, captures are a second apart in page order."""
    stamp = F.col("stamp").cast("long") if "stamp" in pages.columns else F.lit(EPOCH) + F.coalesce(F.pmod(F.col("page_id"), F.lit(1 << 31)), F.lit(0))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", stamp.alias("stamp"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    many = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    many, many_path = cut(many, "digests")
    told = rows.join(many, "digest", "left").select("page_id", "url", "stamp", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def write(batches):
        fs, at = filesystem(folder)
        fs.create_dir(at)
        out, size, name = None, 0, ""
        for b in batches:
            for i, url, stamp, payload, ref in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("stamp").to_pylist(), b.column("payload"), b.column("refers_to").to_pylist()):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                raw = record(i, url, stamp, payload.as_py(), ref)
                out.write(raw)
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    done, _ = cut(told.mapInArrow(write, "path string"), "archives")
    drop(pages.sparkSession, many_path)
    return done


def index_runs(archives: DataFrame, folder: str) -> DataFrame:
    """A sorted run per archive: path, lines, and the keys of SAMPLES evenly spaced captures as JSON."""

    def build(batches):
        fs, at = filesystem(folder)
        fs.create_dir(at)
        for b in batches:
            for path in b.column("path").to_pylist():
                sfs, sat = filesystem(path)
                lines = []
                with sfs.open_input_stream(sat, compression=None) as stream:
                    for offset, length, raw in members(stream):
                        r = parse(raw)
                        lines.append([url_key(r["url"]), r["stamp"], r["page_id"], r["type"], r["digest"], r["bytes"], r["refers_to"], path, offset, length])
                lines.sort(key=key_of)
                name = f"{uuid.uuid4().hex}.run"
                w = RunWriter(f"{folder}/{name}")
                for line in lines:
                    w.add(line)
                w.close()
                keys = [json.dumps(key_of(x)) for x in lines[:: max(1, len(lines) // SAMPLES)]]
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(lines)], pa.int64()), pa.array([keys], pa.list_(pa.string()))], names=["path", "n", "keys"])

    n = archives.count()
    spread = archives.repartition(max(1, n), "path")
    return cut(spread.mapInArrow(build, "path string, n long, keys array<string>"), "runs")[0]


def merge_runs(runs: DataFrame, folder: str, ranges: int) -> DataFrame:
    """All captures in the order of URL key, timestamp and page: range no holds the no-th share."""
    spark = runs.sparkSession

    def merge_group(batches):
        for b in batches:
            for paths in b.column("paths").to_pylist():
                name = f"{folder}/{uuid.uuid4().hex}.run"
                w = RunWriter(name)
                for line in loser_tree([Run(p).since(None, None) for p in paths]):
                    w.add(line)
                w.close()
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    keys = runs.select(F.explode("keys").alias("k")).orderBy(F.xxhash64("k")).limit(100_000)  # for even ranges only
    paths = runs.select("path")
    while (n := paths.count()) > FAN_IN:
        groups = paths.groupBy(F.pmod(F.xxhash64("path"), F.lit(-(-n // FAN_IN))).alias("g")).agg(F.collect_list("path").alias("paths"))
        paths, _ = cut(groups.mapInArrow(merge_group, "path string"), "runs")
    last = [r.path for r in paths.collect()]  # FAN_IN at most
    splits = sorted(json.loads(r.k) for r in keys.collect())
    cuts = [splits[len(splits) * i // ranges] for i in range(1, ranges)] if splits else []
    bounds = [json.dumps(x) for x in sorted({json.dumps(c): c for c in cuts}.values())]
    todo = spark.createDataFrame(list(zip(range(len(bounds) + 1), [None, *bounds], [*bounds, None])), "no long, low string, high string").repartitionByRange(len(bounds) + 1, "no")

    def merge_range(batches):
        for b in batches:
            for low, high in zip(b.column("low").to_pylist(), b.column("high").to_pylist()):
                ends = [None if x is None else json.loads(x) for x in (low, high)]
                held = []
                for line in loser_tree([Run(p).since(*ends) for p in last]):
                    held.append(line)
                    if len(held) == PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), KINDS)], names=NAMES)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), KINDS)], names=NAMES)

    return todo.mapInArrow(merge_range, CAPTURE)


def archive_and_index(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the archives, reads them back and returns the captures in order.

    Null html is an empty payload, a null url has the key '-'. Of equal payloads of at least least_bytes bytes the record
    with the smallest page_id is the response; rows that repeat that page_id are responses too, and rows without an id
    are revisits if any row of the group has one. Other columns are ignored; an empty table gives no rows."""
    spark = pages.sparkSession
    named, folder = folder, folder or fresh_path(spark, "warc")
    runs = index_runs(write_archives(pages, folder, least_bytes), f"{folder}/runs")
    if not named:
        owned(spark, folder)
    return merge_runs(runs, f"{folder}/runs", max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
