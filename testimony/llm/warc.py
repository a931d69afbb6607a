"""WARC archives: writing, reading back, and an external merge of the archives' indexes.

Archives are written by Spark's text sink (a record per row, the two line ends that close a record
as line separator), so any file system that Spark knows will do. Every archive is sorted where it is read, which gives
a run of index entries in URL order, each with its rank there; the runs are cut at common splitters and each range's pieces are
merged by a loser tree, which alone makes the order across runs, so that the ranges in order are the history of all captures.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from testimony.llm.common import LOWER, UPPER, broadcast_if_small, settle, shared_dir

CRLF = "\r\n"
_SCHEME, _HOST = re.compile(r"[^/?#]*?://"), re.compile(r"[^/?#]*")
_LOWER = str.maketrans(UPPER, LOWER)
#: Bytes of payload in one archive file at most, if a record is no larger. A file is read by one task, whole.
ARCHIVE_BYTES = 32 << 20
#: Records in one archive file at most.
RECORDS_PER_ARCHIVE = 400
#: Index entries that one merging task gets on average, and that it hands on at once.
ENTRIES_PER_RANGE, ENTRIES_AT_ONCE = 20_000, 5_000

ENTRY = (
    "archive string, rank int, offset long, page_id long, url string, url_key string, captured_at timestamp, "
    "record_type string, payload_bytes long, payload_digest string, refers_to long"
)


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", UPPER + "234567")


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then ')' and the rest: captures of a site sort together."""
    rest = _SCHEME.sub("", url or "")
    host = _HOST.match(rest)[0]
    return ",".join(reversed(host.translate(_LOWER).split("."))) + ")" + rest[len(host) :]


def with_revisits(pages: DataFrame, least_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses).

    Only ids and digests are shuffled. Payloads stay where they are read when the revisits, counted,
    are few enough to broadcast; else they move once, in a join by id.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), sha1_base32(payload.cast("binary")).alias("payload_digest"),
    )
    keys = settle(rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest", "payload_bytes"))
    first = keys.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = keys.join(first, ["payload_digest", "payload_bytes"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = settle(again.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to").distinct())
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    return rows.join(broadcast_if_small(again), same, "left").drop("_id", "_digest")


def write_archives(
    pages: DataFrame, path: str, *, least_bytes: int = 0, records_per_archive: int = RECORDS_PER_ARCHIVE, archive_bytes: int = ARCHIVE_BYTES,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html", started: str = "2024-01-01 00:00:00",
) -> None:
    """Write a WARC/1.1 record per page into gzipped archives under ``path``.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest id is a
    response and the others are revisits without a block. A page's capture time is ``started`` plus
    its id in seconds. Null payload is empty; a null URL leaves out its header; line ends in URLs are
    percent-encoded; rows that share the largest id are all responses; a null id has no id header.
    Records are written apart by the power of eight of their payload's bytes, so that files of few large ones and of many small ones stay
    within ``archive_bytes``; a larger record has a file of its own.
    """
    rows = with_revisits(pages, least_bytes, id_col, url_col, html_col)
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    ident = F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))
    plain_url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    at = F.to_timestamp(F.lit(started)) + F.make_dt_interval(secs=F.coalesce(F.pmod(F.col("page_id"), F.lit(10**9)), F.lit(0)).cast("decimal(18,6)"))
    revisit = F.col("refers_to").isNotNull()
    parts = [
        F.lit("WARC/1.1" + CRLF),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(header("WARC-Record-ID", ident), F.lit("")),
        F.coalesce(header("WARC-Target-URI", plain_url), F.lit("")),
        header("WARC-Date", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF).otherwise(""),
        F.coalesce(header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8" + CRLF),
        header("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    ]
    # Sizes over what 400 records may have are rare: a pass each over the pages that hold any.
    limits = [archive_bytes // records_per_archive]
    while limits[-1] < archive_bytes:
        limits.append(limits[-1] * 8 + 8)
    of = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    least = [F.lit(True), *(of > x for x in limits)]
    held = rows.agg(*[F.coalesce(F.max(x), F.lit(False)) for x in least]).first() if len(limits) > 1 else [True]
    for k, any_ in enumerate(held):
        if k == 0 or any_:
            part = rows.where(least[k] & (of <= limits[k] if k < len(limits) else F.lit(True)))
            out = part.select(F.concat(*parts).alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip")
            most = max(1, archive_bytes // max(1, limits[k])) if k < len(limits) else 1
            out.option("maxRecordsPerFile", min(records_per_archive, most)).mode("append").text(path)


def records_of(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers by lower-case name, block) of the records of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        yield at, headers, data[start : start + size]
        at = start + size + 4


def _number(urn: str | None) -> int | None:
    return int(urn.removeprefix("<urn:page:").rstrip(">")) if urn else None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"], strict=True):
            rows = []
            for at, h, block in records_of(gzip.decompress(content)):
                digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                if h["warc-type"] == "response":
                    digest, size = base64.b32encode(hashlib.sha1(block).digest()).decode(), len(block)
                    if digest != h["warc-payload-digest"].removeprefix("sha1:"):
                        raise ValueError(f"{path}, record at {at}: the payload does not match its digest")
                url = h.get("warc-target-uri")
                when = datetime.strptime(h["warc-date"], "%Y-%m-%dT%H:%M:%SZ")
                rows.append((at, _number(h.get("warc-record-id")), url, url_key(url), when, h["warc-type"], size, digest, _number(h.get("warc-refers-to"))))
            rows.sort(key=lambda r: (r[3], r[4], -1 if r[1] is None else r[1]))
            archive = path.rsplit("/", 1)[-1]
            yield pd.DataFrame([(archive, i, *r) for i, r in enumerate(rows)], columns=_NAMES).astype({"page_id": "Int64", "refers_to": "Int64"})


_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries (ENTRY) of all archives under ``path``; payloads are read and their digests checked.

    Each archive's entries come sorted by (url_key, captured_at, page_id), with their rank.
    Lengths come from Content-Length, so payloads may hold anything, record headers included.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(_read, ENTRY)


class LoserTree:
    """k-way merge: inner nodes keep the run that lost there, so that each output costs one path to the root."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        n = len(runs)
        self.losers = [-1] * max(n, 1)
        for leaf in range(n):
            self._play(leaf, leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int, winner: int) -> None:
        at = (leaf + len(self.runs)) // 2
        while at > 0:
            other = self.losers[at]
            if other < 0:  # while building: wait for the other side
                self.losers[at] = winner
                return
            if self._before(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[w := self.losers[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            at, winner = (w + len(self.runs)) // 2, w
            while at > 0:
                if self._before(self.losers[at], winner):
                    self.losers[at], winner = winner, self.losers[at]
                at //= 2
            self.losers[0] = winner


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merge one range's pieces of runs; they arrive run by run, each in its own order."""
    rows = pd.concat(list(batches) or [pd.DataFrame({c: [] for c in _NAMES})], ignore_index=True)
    keys = list(zip(rows["url_key"], rows["captured_at"], rows["page_id"].fillna(-1).astype("int64"), range(len(rows)), strict=True))
    archive = rows["archive"].to_numpy()
    cuts = [0, *(np.flatnonzero(archive[1:] != archive[:-1]) + 1).tolist(), len(rows)] if len(rows) else [0]
    order: list[int] = []
    for *_, i in LoserTree([keys[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]):
        order.append(i)
        if len(order) == ENTRIES_AT_ONCE:
            yield rows.iloc[order].astype({"page_id": "Int64", "refers_to": "Int64"})
            order = []
    if order:
        yield rows.iloc[order].astype({"page_id": "Int64", "refers_to": "Int64"})


def merge_indexes(runs: DataFrame) -> DataFrame:
    """Entries in order of (url_key, captured_at, page_id), over partitions and within them.

    ``runs`` are the archives' entries, each archive's sorted and numbered by rank. Splitters sampled from the runs cut
    the whole order into ranges, by time and id as well, so that captures of one URL may fill many. A range's pieces
    are put one after the other by archive and rank, as they were, and merged.
    """
    runs = settle(runs)
    ranges = max(2, runs.count() // ENTRIES_PER_RANGE + 1)
    pieces = runs.repartitionByRange(ranges, "url_key", "captured_at", F.coalesce("page_id", F.lit(-1))).sortWithinPartitions("archive", "rank")
    return pieces.mapInPandas(_merge, pieces.schema)


def archive_pages(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as archives under ``path`` (a new shared folder by default), read them, merge the indexes.

    One row a record, as read back: the columns of ENTRY, in global order. An empty table gives an
    empty result. See ``write_archives`` for nulls, ties and repeated rows. Very long payloads have archives of their own.
    Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return merge_indexes(read_archives(spark, path))
