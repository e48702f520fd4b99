"""WARC archives of pages and the merge of their capture indexes.

`write_archives` writes each partition as one gzip-member WARC file (a capture run, sorted by URL key and time) in
the shared folder; payloads met before are written as revisits. `read_archives` reads the files back record by
record. `merge_captures` is an external index merge: capture rows are dealt out by ranges of (URL key, time, id), and
each range's sorted run slices pass through a k-way loser tree, which gives one global order over the partitions.

Pages have no time of their own: a capture is dated EPOCH plus page_id seconds.

Defined results: null html is an empty payload; payloads of fewer than MIN_REVISIT bytes are always responses; of
equal longer payloads each row with the smallest page_id is a response (repeated rows too), the others, also those
without page_id, are revisits of it; where no page_id is known all are responses; null url has the key "" and no
target header; extra columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, table, written

MIN_REVISIT = 100
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
END = b"\r\n\r\n"
CAPTURE = (
    "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "archive string, position long, target string"
)


def url_key(url: Column) -> Column:
    """Host labels from the last to the first without www, then path and query in lower case: com,example)/a?b."""
    low = F.lower(url)
    host = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), r"^www[0-9]*\.", "")
    rest = F.regexp_extract(low, r"^[^:/?#]*://[^/?#]*([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.coalesce(F.when(host == "", low).otherwise(key), F.lit(""))


def decide(pages: DataFrame) -> DataFrame:
    """page_id, url, key, payload, digest, bytes, type and referred page of each row."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.octet_length("payload") >= MIN_REVISIT)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    out = rows.join(first, "digest", "left")
    return out.select("page_id", "url", url_key(F.col("url")).alias("url_key"), "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))


def captured(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=abs(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, key: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone and says how long its payload was."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {target} {digest}')}>",
        f"WARC-Date: {captured(page_id)}",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        *([f"WARC-Page: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + END + block + END


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an uncompressed WARC byte string."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError("no WARC record")
        head = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
        start = end + len(END)
        stop = start + int(head["content-length"])
        if data[stop : stop + 4] != END:
            raise ValueError("a record of another length")
        yield head, data[start:stop]
        at = stop + 4


def write_archives(pages: DataFrame) -> DataFrame:
    """A table of archive files; each task writes one file under a name of its attempt, so a task may run again."""
    folder = new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        context, out, n, path = TaskContext.get(), None, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root, recursive=True)
                    path = f"{root}/run-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                member = record(row["page_id"], row["url"], row["url_key"], row["payload"], row["digest"], row["refers_to"])
                out.write(gzip.compress(member, compresslevel=3, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path.rsplit("/", 1)[1]], "records": pa.array([n], pa.int64())})

    runs = decide(pages).sortWithinPartitions("url_key", "page_id")
    return written(runs.mapInArrow(run, "archive string, records long").withColumn("folder", F.lit(folder)), "warc-runs")


def read_archives(archives: DataFrame) -> DataFrame:
    """A capture row for each record of each archive file, its payload digest and length taken from what was stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, root = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_stream(f"{root}/{row['archive']}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as data:
                    yield from _captures(row["archive"], data)

    # One row a file, so that each file is a task of its own.
    files = archives.select("folder", "archive").repartition(4 * archives.sparkSession.sparkContext.defaultParallelism, "archive")
    found = files.mapInArrow(run, CAPTURE.replace("url_key string, captured", "captured"))
    return found.withColumn("url_key", url_key(F.col("target")))


def _captures(archive: str, data: gzip.GzipFile) -> Iterator[pa.RecordBatch]:
    rows, position = [], 0
    names = ["captured", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "position", "target"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for head, block in stream_records(data):
        http, _, payload = block.partition(END)
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
        said = head["warc-payload-digest"].removeprefix("sha256:")
        if head["warc-type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != said):
            raise ValueError(f"{archive}: record {position} was not stored as it was written")
        number = lambda k: int(head[k]) if k in head else None
        rows.append([head["warc-date"], number("warc-page"), length, said, head["warc-type"], number("warc-refers-to-page"), archive, position, head.get("warc-target-uri")])
        position += 1
        if len(rows) == 2000:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def stream_records(data: gzip.GzipFile) -> Iterator[tuple[dict[str, str], bytes]]:
    """As parse_records, from a file that is read on."""
    while line := data.readline():
        record = [line]
        length = 0
        while (line := data.readline()) != b"\r\n":
            if not line:
                raise ValueError("the archive ends early")
            record.append(line)
            if line.lower().startswith(b"content-length:"):
                length = int(line.split(b":")[1])
        yield next(parse_records(b"".join(record) + b"\r\n" + data.read(length + 4)))


class LoserTree:
    """Merges k sorted runs: inner nodes hold the losers of their matches, the winner leaves at the top."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i, build=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) < (y, b)

    def _play(self, winner: int, build: bool = False) -> None:
        node = (winner + self.k) >> 1
        while node:
            held = self.losers[node]
            if held < 0:
                if build:
                    self.losers[node] = winner
                    return
            elif self._less(held, winner):
                self.losers[node], winner = winner, held
            node >>= 1
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self._play(w)


def merge_captures(captures: DataFrame) -> DataFrame:
    """Captures in the order of (url_key, captured, page_id) over the partitions, with their place: merge_part and merge_place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None:
            return
        part = TaskContext.get().partitionId()
        columns = [whole.column(c).to_pylist() for c in ("archive", "url_key", "captured", "page_id", "position")]
        slices: dict[str, list] = {}
        for i, (archive, key, date, page, position) in enumerate(zip(*columns, strict=True)):
            slices.setdefault(archive, []).append((key, date, -1 if page is None else page, position, i))
        order = pa.array([x[-1] for x in LoserTree([iter(x) for x in slices.values()])], pa.int64())
        out = whole.take(order).append_column("merge_part", pa.array([part] * len(order), pa.int64()))
        out = out.append_column("merge_place", pa.array(range(len(order)), pa.int64()))
        yield from out.select([x.split()[0] for x in MERGED.split(", ")]).to_batches(max_chunksize=10_000)

    keys = ["url_key", "captured", "page_id", "position", "archive"]
    dealt = captures.select([x.split()[0] for x in CAPTURE.split(", ")]).repartitionByRange(*keys)
    return dealt.sortWithinPartitions("archive", *keys[:4]).mapInArrow(run, MERGED)


MERGED = CAPTURE + ", merge_part long, merge_place long"


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_captures(read_archives(write_archives(table(spark, sf_dir, "pages"))))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= {MIN_REVISIT} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d"""
