"""WARC archives with a two-level capture index.

Captures are laid in the order of reversed-host URL keys: the upper level of the index cuts the keys into ranges,
one for each archive, found on the keys alone; a task then sorts the captures of its range, writes them as one
archive in the shared folder, a gzip member per record, and returns its index: lines of (key, page_id, offset,
length), deflated in blocks. The stashed table of blocks has the sparse directory (first and last key, archive, byte
range) beside the blocks. A lookup binary-searches the ranges, then the directory of a range, inflates the blocks
found and reads their byte ranges; every read of the query goes that way.

An archive's name carries the task attempt; only the returned rows name archives, so what a lost attempt wrote
is never read.

Defined results: NULL html is an empty payload; a NULL or unparsable url sorts first under an empty key; of
equal payloads, the record with the largest page_id is the response (a NULL id never is, if another is there).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import new_path, read, stash

BLOCK_LINES = 256
#: Ranges of the upper level at most, whatever the input: beyond, archives grow.
MAX_RANGES = 65_536
#: Pages of a range: what a task searches or merges at once follows it, not the number of shuffle partitions.
RANGE_ROWS = 131_072
#: Wanted keys sent to a block at once.
KEYS = 1024
NULL_ID = 1 << 127
INDEX = "part int, first_key string, last_key string, archive string, start long, stop long, lines long, block binary"


def url_key(url: Column) -> Column:
    """com,example,www)/path?query: host reversed, lower case, no scheme or port."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/:?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([/?].*)?", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))


def base32(hexadecimal: Column) -> Column:
    """Base32 of 40 hexadecimal digits: eight letters for every five bytes."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(hexadecimal, 10 * g + 1, 10), 16, 10).cast("long") for g in range(4)]
    return F.concat(*[F.substring(letters, F.shiftright(x, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for x in groups for k in range(8)])


def record_id(page_id: int | None) -> str:
    h = f"{NULL_ID if page_id is None else page_id & ((1 << 64) - 1):032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(rid: str) -> int | None:
    n = int(rid[len("<urn:uuid:") : -1].replace("-", ""), 16)
    return None if n == NULL_ID else n - (1 << 64) if n >> 63 else n


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None = None) -> bytes:
    """A response with its payload, or, if payload is None, a revisit of the record that it refers to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}"]
    head += [f"WARC-Target-URI: {''.join(c if c > ' ' else '%20' for c in url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def lines_key(url: Column) -> Column:
    """The key as the lines of the index hold it."""
    return F.replace(F.replace(url_key(url), F.lit("\t"), F.lit("%09")), F.lit("\n"), F.lit("%0A"))


def ranges(keyed: DataFrame, most: int = MAX_RANGES) -> list[tuple[str, int]]:
    """First (key, page_id) of each range, in order: bounded, found by range-partitioning the keys alone. A range holds some
    `RANGE_ROWS` pages, fewer where there are fewer pages than that for each shuffle partition."""
    n = min(most, max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keyed.count() // RANGE_ROWS)))
    dealt = keyed.select("key", F.coalesce("page_id", F.lit(-(1 << 63))).alias("i")).repartitionByRange(n, "key", "i")
    return sorted(map(tuple, dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("key", "i")).alias("s")).select("s.*").collect()))


def records(pages: DataFrame, bounds: list[tuple[str, int]]) -> DataFrame:
    """(key, page_id, url, html) -> part (the range), key, page_id, url, digest, size and the response record, deflated:
    what travels from here on is a fraction of the html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, digests, sizes, members = [], [], [], []
            for key, i, url, html in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3)):
                payload = html.as_py().encode()
                parts.append(max(0, bisect_right(bounds, (key, -(1 << 63) if i is None else i)) - 1))
                digests.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
                sizes.append(len(payload))
                members.append(member(record(i, url, digests[-1], len(payload), payload)))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *b.columns[:3], pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())], ["part", "key", "page_id", "url", "digest", "size", "member"])

    return pages.select("key", "page_id", "url", "html").mapInArrow(run, "part int, key string, page_id long, url string, digest string, size long, member binary")


def marks(keyed: DataFrame, bounds: list[tuple[str, int]]) -> DataFrame:
    """part, key, page_id, digest, response: the records that are revisits, found on digests alone."""
    repeated = keyed.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL")
    again = keyed.join(repeated, "digest").where(~F.col("page_id").eqNullSafe(F.col("response"))).select("key", "page_id", "digest", "response").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [max(0, bisect_right(bounds, (key, -(1 << 63) if i is None else i)) - 1) for key, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *b.columns], ["part", "key", "page_id", "digest", "response"])

    return again.mapInArrow(run, "part int, key string, page_id long, digest string, response long")


def headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of a record, headers of its HTTP response, body. Raises ValueError if it is cut off."""
    head, _, rest = data.partition(b"\r\n\r\n")
    h = headers(head)
    n = int(h["content-length"])
    if not head.startswith(b"WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    http, _, body = rest[:n].partition(b"\r\n\r\n")
    return h, headers(http), body


def shared_file(folder: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def write_archives(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> the index of the archives written: a row for each block of lines. The records are
    shuffled once; a record's mark, sorted before it, says that it is a revisit."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    fs, root = shared_file(folder)
    fs.create_dir(root, recursive=True)
    html = F.coalesce("html", F.lit(""))
    keyed = stash(pages.select(lines_key(F.col("url")).alias("key"), "page_id", base32(F.sha1(html.cast("binary"))).alias("digest")), "warc-keys")
    bounds = ranges(keyed)
    made = records(pages.select(lines_key(F.col("url")).alias("key"), "page_id", "url", html.alias("html")), bounds).withColumn("response", F.lit(None).cast("long"))
    both = made.unionByName(marks(keyed, bounds), allowMissingColumns=True)
    dealt = both.repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("part", "key", "page_id", F.col("member").isNotNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        fs, root = shared_file(folder)
        lines: list[tuple] = []
        out, now, at, name, mark, marked = None, -1, 0, "", None, {}
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.int32(), *[pa.string()] * 3, *[pa.int64()] * 3, pa.binary()]

        def block() -> pa.RecordBatch:
            text = "\n".join(f"{k}\t{'' if i is None else i}\t{o}\t{n}" for k, i, o, n in lines)
            row = [now, lines[0][0], lines[-1][0], name, lines[0][2], at, len(lines), zlib.compress(text.encode())]
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        try:
            for b in batches:
                for part, key, i, url, digest, size, data, response in zip(*(c.to_pylist() for c in b.columns)):
                    if part != now:
                        if lines:
                            yield block()
                        if out:
                            out.close()
                        now, at, name = part, 0, f"part-{part:05d}-{attempt}.warc.gz"
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    if mark != (key, i):
                        mark, marked = (key, i), {}
                    if data is None:
                        marked[digest] = response
                        continue
                    if digest in marked:
                        data = member(record(i, url, digest, size, None, marked[digest]))
                    out.write(data)
                    lines.append((key, i, at, len(data)))
                    at += len(data)
                    if len(lines) >= BLOCK_LINES:
                        yield block()
            if lines:
                yield block()
        finally:
            if out:
                out.close()

    columns = ("part", "key", "page_id", "url", "digest", "size", "member", "response")
    return stash(dealt.select(*columns).mapInArrow(write, INDEX).withColumn("folder", F.lit(folder)), "capture-index")


def lines_of(block: bytes) -> list[tuple[str, int | None, int, int]]:
    rows = (x.split("\t") for x in zlib.decompress(block).decode().split("\n"))
    return [(k, int(i) if i else None, int(o), int(n)) for k, i, o, n in rows]


CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary"


def capture(data: bytes) -> dict:
    """What a stored member says; a response's digest is recomputed from its stored payload."""
    h, http, body = parse(zlib.decompress(data, 31))
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    if h["warc-type"] == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError(f"payload of {h['warc-record-id']} is damaged")
    return dict(
        page_id=page_of(h["warc-record-id"]), url=h["warc-target-uri"], payload_bytes=size, payload_digest=digest, record_type=h["warc-type"],
        refers_to=page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None, body=body,
    )


ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("body", pa.binary())])


def read_archives(index: DataFrame, bodies: bool = False) -> DataFrame:
    """All captures, block by block: one range read for each block of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for b in batches:
            for folder, archive, start, stop, block in zip(*(c.to_pylist() for c in b.columns)):
                if held[0] != (folder, archive):
                    if held[1]:
                        held[1].close()
                    fs, root = shared_file(folder)
                    held = (folder, archive), fs.open_input_file(f"{root}/{archive}")
                data = held[1].read_at(stop - start, start)
                rows = [capture(data[o - start : o - start + n]) for _, _, o, n in lines_of(block)]
                if not bodies:
                    rows = [r | {"body": None} for r in rows]
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
        if held[1]:
            held[1].close()

    return index.select("folder", "archive", "start", "stop", "block").mapInArrow(run, CAPTURE)


def look_up(index: DataFrame, urls: DataFrame, bodies: bool = True, max_ranges: int = MAX_RANGES) -> DataFrame:
    """Captures of the given urls, each once however often its url is asked for.

    The upper level has at most max_ranges entries, for ranges of one archive or of several that follow each other; it
    goes to every task. A range's directory is searched where its rows are. Then each block found is inflated and the
    records of its wanted keys are read, in one range read if they are all wanted."""
    last = index.agg(F.max("part")).first()[0]
    width = -(-((last or 0) + 1) // max_ranges)
    piece = F.floor(F.col("part") / width).cast("int")
    upper = sorted(map(tuple, index.groupBy(piece.alias("g")).agg(F.min("first_key"), F.max("last_key")).collect()))  # at most max_ranges rows
    firsts, lasts, pieces = [u[1] for u in upper], [u[2] for u in upper], [u[0] for u in upper]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, to = [], []
            for key in b.column(0).to_pylist():
                # ranges are in order of first and last keys; captures of one key can lie in several
                for at in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    keys.append(key)
                    to.append(pieces[at])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(to, pa.int32())], ["key", "g"])

    def search(_: tuple, wanted: pa.Table, directory: pa.Table) -> pa.Table:
        rows = directory.sort_by([("part", "ascending"), ("start", "ascending")])
        first, end = rows.column("first_key").to_pylist(), rows.column("last_key").to_pylist()
        found: dict[int, list[str]] = {}
        for key in wanted.column("key").to_pylist():
            for at in range(bisect_left(end, key), bisect_right(first, key)):
                found.setdefault(at, []).append(key)
        asked = [(at, keys[k : k + KEYS]) for at, keys in sorted(found.items()) for k in range(0, len(keys), KEYS)]
        located = rows.select(["folder", "archive", "start", "stop", "block"]).take(pa.array([at for at, _ in asked], pa.int64()))
        return located.append_column("keys", pa.array([keys for _, keys in asked], pa.list_(pa.string())))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for b in batches:
            for folder, archive, start, stop, block, keys in zip(*(c.to_pylist() for c in b.columns)):
                if held[0] != (folder, archive):
                    if held[1]:
                        held[1].close()
                    fs, root = shared_file(folder)
                    held = (folder, archive), fs.open_input_file(f"{root}/{archive}")
                wanted = set(keys)
                lines = lines_of(block)
                asked = [(o, n) for k, _, o, n in lines if k in wanted]
                if len(asked) == len(lines):
                    data = held[1].read_at(stop - start, start)
                    raws = (data[o - start : o - start + n] for o, n in asked)
                else:
                    raws = (held[1].read_at(n, o) for o, n in asked)
                rows = [capture(raw) for raw in raws]
                yield pa.RecordBatch.from_pylist(rows if bodies else [r | {"body": None} for r in rows], schema=ARROW)
        if held[1]:
            held[1].close()

    wanted = urls.select(lines_key(F.col("url")).alias("key")).distinct().mapInArrow(route, "key string, g int")
    directory = index.select(piece.alias("g"), "part", "first_key", "last_key", "folder", "archive", "start", "stop", "block")
    located = wanted.groupBy("g").cogroup(directory.groupBy("g")).applyInArrow(search, "folder string, archive string, start long, stop long, block binary, keys array<string>")
    return located.mapInArrow(fetch, CAPTURE)


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url is looked up in the index of the archives written."""
    pages = read(spark, sf_dir, "pages")
    return look_up(write_archives(pages), pages, bodies=False).drop("url", "body")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS response FROM h),
d AS (SELECT page_id, payload_bytes, response, x FROM m)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
         (((('0x' || substr(x || '00', 1 + (i * 5) // 4, 2))::INT >> (3 - (i * 5) % 4)) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM d
"""
