"""WARC archives with a globally ordered capture index made by an external merge.

`write_archives` sorts captures by URL key and time within each task and writes them as one gzip
member a record, so each archive's own index is a sorted run. Payloads that occurred before (by
SHA-1, at `min_bytes` or more) become revisit records without the payload, which refer to the
response; the response is the one with the least page_id.

`merge_runs` deals the runs' index rows out by ranges of (URL key, time, offset), so that one hot URL
is split by time, reads each run's share of a range in the order of its index, and merges the shares with a loser tree: k sorted
lists, log2(k) comparisons a row. Ranges follow one another, so the result is in global order; `part` and `place` tell it.

`read_archives` reads the records back by their index rows, archive by archive, and takes everything from the record: the payload's size
from the HTTP header, its digest from the WARC header (checked against the payload of responses).

Defined results: null html is the empty payload. A null url has the URL key `-`. Records of equal payload and equal least
page_id (repeated rows) are all responses. Rows without a page_id come last of their payload: they
are responses only if no row of it has an id. Records of a page_id that several rows have (null included) carry their run
and place in their ids, so that no two records have one id; a revisit of such a response names it by its page_id alone. Empty table: no archives and no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from datetime import UTC, datetime, timedelta
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import scratch_path, table, written
from larkspur.llm.shared_files import make, opened, publish

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
_ID = re.compile(rb"<urn:capture:page:([^:>]*)(?::[^>]*)?>")


def url_key(url: str | None) -> str:
    """Sort-friendly URL key: host reversed, lower case, no www, default port, fragment or session marks."""
    try:
        p = urlsplit((url or "").strip())
        host, port = (p.hostname or "").lower(), p.port
    except ValueError:
        return f"-{url.lower()}"
    if not host:
        return f"-{(url or '').lower()}" if url else "-"
    host = re.sub(r"^www\d*\.", "", host)
    at = "" if port in (None, 80, 443) else f":{port}"
    query = urlencode(sorted(parse_qsl(p.query, keep_blank_values=True)))
    path = quote(p.path.lower().rstrip("/") or "/", safe="/%:@!$&'()*+,;=~-._")
    return f"{','.join(reversed(host.split('.')))}{at}){path}" + (f"?{query.lower()}" if query else "")


def stamp(page_id: int | None) -> str:
    """When a page was captured: the table doesn't say, so captures are a second apart in order of their ids."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y%m%d%H%M%S")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id, url, when: str, sha1: str, size: int, payload: bytes, refers_to=None, mark: str = "") -> bytes:
    """A record as one gzip member. `mark` tells records of one page_id apart."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload if kind == "response" else b"")
    date = f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:]}Z"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:capture:page:{page_id}{mark}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\r\n]+', '', url)}")
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:capture:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """What a record says: page_id, kind, refers_to, payload size, digest."""
    raw = zlib.decompress(member, 31)
    head, block = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    http, payload = block[: int(fields[b"Content-Length"])].split(b"\r\n\r\n", 1)
    size = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
    kind, sha1 = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest(payload) != sha1):
        raise ValueError(f"payload of {fields[b'WARC-Record-ID']!r} doesn't have its digest")
    number = lambda x: None if x is None or x == b"None" else int(x)
    return {"page_id": number(_ID.match(fields[b"WARC-Record-ID"])[1]), "kind": kind, "refers_to": number(m[1]) if (m := _ID.match(fields.get(b"WARC-Refers-To", b""))) else None, "size": size, "sha1": sha1, "payload": payload}


def _hashed(pages: DataFrame, with_html: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            raw = [(h.as_py() or "").encode() for h in batch.column(2)]
            urls = batch.column(1).to_pylist()
            cols = {"page_id": batch.column(0), "bytes": pa.array(list(map(len, raw)), pa.int64()), "sha1": pa.array(list(map(digest, raw)), pa.string())}
            if with_html:
                cols |= {"url": batch.column(1), "html": batch.column(2), "url_key": pa.array(list(map(url_key, urls)), pa.string()), "stamp": pa.array([stamp(p) for p in batch.column(0).to_pylist()], pa.string())}
            yield pa.record_batch(list(cols.values()), names=list(cols))

    more = ", url string, html string, url_key string, stamp string" if with_html else ""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, f"page_id long, bytes long, sha1 string{more}")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes archives into `folder`; returns their indexes, each archive's rows a sorted run: (run, seq, url_key, stamp, file, offset, length)."""
    make(folder)
    seen = written(_hashed(pages, with_html=False), "payloads")
    first = seen.filter(F.col("bytes") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1")
    # ids that revisit, with their responses: html is joined to these by page_id, which no group of copies skews
    again = seen.join(first.select("sha1", "response_id"), "sha1").filter("page_id is null or page_id <> response_id").filter("response_id is not null")
    again = again.select(F.col("page_id").alias("id"), F.col("sha1").alias("id_sha1"), "response_id", F.lit(False).alias("repeated"))
    # ids of more than one row, which need more than their id to name a record; rows without an id always do, and aren't joined
    pairs = seen.filter("page_id is not null").groupBy(F.col("page_id").alias("id"), F.col("sha1").alias("id_sha1")).agg(F.count("*").alias("n"))
    twice = pairs.groupBy("id").agg(F.sum("n").alias("n")).filter("n > 1").select("id")
    several = pairs.join(twice, "id").select("id", "id_sha1", F.lit(None).cast("long").alias("response_id"), F.lit(True).alias("repeated"))
    notes = written(again.unionByName(several).groupBy("id", "id_sha1").agg(F.max("response_id").alias("response_id"), F.max("repeated").alias("repeated")), "revisits")
    every = _hashed(pages, with_html=True)
    roles = every.join(notes, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("id_sha1")), "left")
    sorted_runs = roles.sortWithinPartitions("url_key", "stamp", "page_id").select("page_id", "url", "html", "url_key", "stamp", "bytes", "sha1", "response_id", "repeated")

    def run(batches):
        me = TaskContext.get().partitionId()
        name, offset, seq = f"capture-{me:08d}.warc.gz", 0, 0
        batch = next(batches, None)
        if batch is None:
            return
        with publish(folder, name) as out:
            while batch is not None:
                rows = []
                for page_id, url, html, _, when, size, sha1, refers, repeated in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                    mark = f":{me}-{seq + len(rows)}" if repeated or page_id is None else ""
                    member = record("response" if refers is None else "revisit", page_id, url, when, sha1, size, (html or "").encode() if refers is None else b"", refers, mark)
                    out.write(member)
                    rows.append((offset, len(member)))
                    offset += len(member)
                n = batch.num_rows
                at, length = (pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1))
                yield pa.record_batch([pa.array([me] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), batch.column(3), batch.column(4), pa.array([name] * n, pa.string()), at, length], names=["run", "seq", "url_key", "stamp", "file", "offset", "length"])
                seq, batch = seq + n, next(batches, None)

    return written(sorted_runs.mapInArrow(run, "run int, seq long, url_key string, stamp string, file string, offset long, length long"), "runs")


class LoserTree:
    """Merges k sorted lists. Inner nodes keep the loser of their match, so the next row takes one match a level."""

    def __init__(self, lists: list[list]):
        self.lists, self.at = lists, [0] * len(lists)
        k = 1
        while k < len(lists):
            k *= 2
        self.k, self.losers = k, [-1] * k
        self.winner = self._play(1)

    def _head(self, i):
        return self.lists[i][self.at[i]] if 0 <= i < len(self.lists) and self.at[i] < len(self.lists[i]) else None

    def _beats(self, i, j):
        a, b = self._head(i), self._head(j)
        return b is None or a is not None and (a, i) <= (b, j)

    def _play(self, node):
        if node >= self.k:
            return node - self.k
        i, j = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (i, j) if self._beats(i, j) else (j, i)
        self.losers[node] = lost
        return won

    def __iter__(self):
        while (row := self._head(self.winner)) is not None:
            yield row
            i = self.winner
            self.at[i] += 1
            node = (i + self.k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merge_runs(runs: DataFrame, range_rows: int = 100_000) -> DataFrame:
    """All index rows in global order by (url_key, stamp, file, offset): adds part (range) and place (in the range)."""
    parts = max(1, -(-runs.count() // range_rows))
    # within a range each run's rows follow its own index, which is in order, so they come as the sorted lists that the tree merges
    dealt = runs.repartitionByRange(parts, "url_key", "stamp", "file", "offset").sortWithinPartitions("run", "seq")

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for r, *row in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5, 6)), strict=True):
                held.setdefault(r, []).append(tuple(row))
        if not held:
            return
        me = TaskContext.get().partitionId()
        merged = list(LoserTree([held[r] for r in sorted(held)]))
        for lo in range(0, len(merged), 10_000):
            cols = list(zip(*merged[lo : lo + 10_000], strict=True))
            n = len(cols[0])
            yield pa.record_batch([pa.array([me] * n, pa.int32()), pa.array(range(lo, lo + n), pa.int64()), *[pa.array(c, pa.string()) for c in cols[:3]], *[pa.array(c, pa.int64()) for c in cols[3:]]], names=["part", "place", "url_key", "stamp", "file", "offset", "length"])

    return written(dealt.mapInArrow(run, "part int, place long, url_key string, stamp string, file string, offset long, length long"), "capture-index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows point to, read in order of their archives."""

    def run(batches):
        store, root = opened(folder)
        name = handle = None
        for batch in batches:
            got = []
            for f, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if f != name:
                    if handle is not None:
                        handle.close()
                    name, handle = f, store.open_input_file(f"{root}/{f}")
                got.append(parse(handle.read_at(length, offset)))
            own = [("page_id", pa.int64()), ("size", pa.int64()), ("sha1", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64())]
            cols = [pa.array([g[k] for g in got], t) for k, t in own]
            yield pa.record_batch([*cols, *(batch.column(c) for c in ("url_key", "stamp", "part", "place"))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp", "part", "place"])
        if handle is not None:
            handle.close()

    by_archive = index.repartition("file", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("file", "offset")
    return by_archive.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, stamp string, part int, place long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    runs = write_archives(table(spark, sf_dir, "pages"), folder, min_bytes=0)
    return read_archives(merge_runs(runs), folder)
