"""Main text of web pages by differences between pages of nearest URL (operator 12).

Each page is read into text lines. Pages of a host are put in the order of their paths, and each is held against the one
whose path shares most leading segments with its own; near copies are passed over, as what they share is the article.
The longest common subsequence of both pages' lines is what the site repeats: those lines go. Where a page's markup
itself says what a line is, that decides: furniture goes though no other page has it, an article's lines stay though
another page quotes them.

Only 64-bit hashes of lines are compared and shuffled for it, in stretches of the order that overlap by REACH pages, so
no task takes a host. The pages themselves are shuffled once, when what goes is known.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markerlake.llm.common import Scratch, arrow_map, partitions, texts
from markerlake.llm.markup import ARTICLE, DROP, lines

REACH = 4  # pages before and after in a host's order that are looked at
STRETCH = 512  # pages of the order that are compared in one place
LONG_WORDS = 8  # words of a line that tells copies from pages of one frame
COPY_SHARE = 0.5  # of the words of such lines, from which two pages are near copies; see no_copies
TABLE_BYTES = 32 << 20  # of an alignment's table; larger ones are halved


def host_and_path(url: str) -> tuple[str, str]:
    """The host in lower case without user and port, and the path; a URL without a host is all path."""
    head, sign, rest = url.partition("://")
    if not sign or any(x in head for x in "/?#"):
        rest, host = url, ""
    else:
        for i, x in enumerate(rest):
            if x in "/?#":
                host, rest = rest[:i], rest[i:]
                break
        else:
            host, rest = rest, ""
        host = host.rpartition("@")[2].partition(":")[0].lower()
    return host, rest.partition("#")[0].partition("?")[0]


def segments(path: str) -> list[str]:
    return [x for x in path.split("/") if x]


def lengths(a: list[int], b: list[int]) -> list[int]:
    """Of a's first i lines and all of b, the length of the longest common subsequence, for each i from 0."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & every
    out, n = [0], 0
    for bit in reversed(bin(row | 1 << len(a))[3:]) if a else ():
        n += bit == "0"
        out.append(n)
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of one longest common subsequence of a and b, in bounded memory."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    both = set(a) & set(b)
    mine = [i for i in range(lo, len(a) - hi) if a[i] in both]
    theirs = [x for x in b[lo : len(b) - hi] if x in both]
    inner = [mine[i] for i in aligned([a[i] for i in mine], theirs)]
    return [*range(lo), *inner, *range(len(a) - hi, len(a))]


def aligned(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(b) == 1:
        return [a.index(b[0])] if b[0] in a else []
    if len(a) * len(b) // 8 > TABLE_BYTES:
        half = len(b) // 2
        before, after = lengths(a, b[:half]), lengths(a[::-1], b[half:][::-1])
        cut = max(range(len(a) + 1), key=lambda i: before[i] + after[len(a) - i])
        return aligned(a[:cut], b[:half]) + [cut + i for i in aligned(a[cut:], b[half:])]
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    rows = [every]  # a zero bit: the subsequence grows at that line of a
    for x in b:
        hit = rows[-1] & where.get(x, 0)
        rows.append(((rows[-1] + hit) | (rows[-1] - hit)) & every)
    out, i, j = [], len(a) - 1, len(b)
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1  # this line adds nothing
        elif not rows[j - 1] >> i & 1:
            j -= 1  # nor does that one
        else:
            out.append(i)
            i, j = i - 1, j - 1
    return out[::-1]


def no_copies(words: np.ndarray, held: list[np.ndarray], order: list[int]) -> Iterator[int]:
    """Of a page's neighbours, in the given order, those that aren't near copies of it. held: which of its lines each has.

    Long lines tell. A near copy has all of them, or at least COPY_SHARE of the words in those that most other neighbours
    lack: what most have is the site's frame.
    """
    long = words >= LONG_WORDS
    every = np.sum(held, axis=0) if held else None
    for k in order:
        telling = long & (2 * (every - held[k]) <= len(held) - 1)
        whole = int(words[telling].sum())
        if not (long.any() and held[k][long].all() or whole and words[telling & held[k]].sum() >= COPY_SHARE * whole):
            yield k


def outlined(pages: DataFrame) -> DataFrame:
    """mark (128 bits of the row), host, way (the path in the order of its segments), page_id, hashes and words of lines."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, page in zip(batch.column("page_id").to_pylist(), texts(batch, "url"), texts(batch, "html")):
                found = lines(page)
                host, path = host_and_path(url)
                hashes = np.array([xxhash.xxh64_intdigest(t) for t, _ in found], np.uint64).tobytes()
                words = np.array([min(t.count(" ") + 1, 65535) for t, _ in found], np.uint16).tobytes()
                out.append((mark(page_id, url, page), host, "\x01".join(segments(path)), page_id, hashes, words))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.binary(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["mark", "host", "way", "page_id", "hashes", "words"])

    return arrow_map(rows_of(pages), work, "mark binary, host string, way string, page_id long, hashes binary, words binary")


def mark(page_id: int | None, url: str, page: str) -> bytes:
    return xxhash.xxh128_digest(f"{page_id} {len(url)} {url}{page}".encode("utf-8", "surrogatepass"))


def rows_of(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html")


def nearest(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """mark, nearest_id (the page held against this one, null without any), shared (places of the lines both have)."""
    spark = pages.sparkSession
    n = partitions(spark)
    order = ["host", "way", "page_id", "mark"]
    once = outlined(pages).dropDuplicates(["mark"])
    dealt = once.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = scratch.keep(dealt.withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy("part").agg(F.count("*").alias("size"))
    start = counts.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    numbered = placed.join(F.broadcast(start), "part").withColumn("at", F.col("start") + F.col("at"))
    here, inside = F.floor(F.col("at") / STRETCH), F.col("at") % STRETCH
    beside = F.when(inside < REACH, here - 1).when(inside >= STRETCH - REACH, here + 1)
    spread = numbered.withColumn("stretch", F.explode(F.array_compact(F.array(here, beside)))).withColumn("own", F.col("stretch") == here)
    sorted_rows = spread.select("stretch", "own", "at", "mark", "host", "way", "page_id", "hashes", "words").repartition(n, "stretch").sortWithinPartitions("stretch", "at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring: deque[dict] = deque()
        middle = 0  # of the page in the ring that is next

        def answer(i: int) -> tuple[bytes, int | None, bytes] | None:
            row = ring[i]
            if not row["own"]:
                return None
            mine = np.frombuffer(row["hashes"], np.uint64)
            words = np.frombuffer(row["words"], np.uint16)
            way = row["way"].split("\x01")
            others = [(j, r) for j, r in enumerate(ring) if j != i and abs(j - i) <= REACH and (r["stretch"], r["host"]) == (row["stretch"], row["host"])]

            def far(x: tuple[int, dict]) -> tuple[int, int, int]:
                same = 0
                for p, q in zip(way, x[1]["way"].split("\x01")):
                    if p != q:
                        break
                    same += 1
                return -same, abs(x[0] - i), x[0]

            held = [np.isin(mine, np.frombuffer(r["hashes"], np.uint64)) for _, r in others]
            for k in no_copies(words, held, sorted(range(len(others)), key=lambda k: far(others[k]))):
                other = others[k][1]
                places = common(mine.tolist(), np.frombuffer(other["hashes"], np.uint64).tolist()) if held[k].any() else []
                return row["mark"], other["page_id"], np.array(places, np.int32).tobytes()
            return row["mark"], None, b""

        def out_of(found: list) -> pa.RecordBatch:
            columns = list(zip(*(x for x in found if x))) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.binary()))], ["mark", "nearest_id", "shared"])

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                ring.append(row)
                if len(ring) > middle + REACH:
                    found.append(answer(middle))
                    if middle == REACH:
                        ring.popleft()
                    else:
                        middle += 1
            yield out_of(found)
        yield out_of([answer(i) for i in range(middle, len(ring))])

    return arrow_map(sorted_rows, work, "mark binary, nearest_id long, shared binary")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, mark, body (compressed lines that markup doesn't drop), stands (for each, whether it is an article's)
    and places (among all lines)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            marks, bodies, stands, places = [], [], [], []
            for page_id, url, page in zip(batch.column("page_id").to_pylist(), texts(batch, "url"), texts(batch, "html")):
                found = [(i, t, k) for i, (t, k) in enumerate(lines(page)) if k != DROP]
                marks.append(mark(page_id, url, page))
                bodies.append(squeeze("\n".join(t for _, t, _ in found).encode()))
                stands.append(bytes(k == ARTICLE for _, _, k in found))
                places.append(np.array([i for i, _, _ in found], np.int32).tobytes())
            columns = [batch.column("page_id"), batch.column("url"), *(pa.array(x, pa.binary()) for x in (marks, bodies, stands, places))]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "mark", "body", "stands", "places"])

    return arrow_map(rows_of(pages), work, "page_id long, url string, mark binary, body binary, stands binary, places binary")


def text_of(rows: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, nearest_id, n_shared: lines that stand, and lines that the nearest page doesn't have."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out, sizes, n_shared = [], [], []
            columns = (batch.column(x).to_pylist() for x in ("body", "stands", "places", "shared"))
            for body, stands, places, shared in zip(*columns):
                gone = set(np.frombuffer(shared or b"", np.int32).tolist())
                kept = expand(body).decode().split("\n") if stands else []
                text = "\n".join(t for t, stand, i in zip(kept, stands, np.frombuffer(places, np.int32).tolist()) if stand or i not in gone)
                out.append(text)
                sizes.append(len(text))
                n_shared.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(sizes, pa.int64()), batch.column("nearest_id"), pa.array(n_shared, pa.int64())],
                ["page_id", "url", "text", "n_chars", "nearest_id", "n_shared"],
            )

    return arrow_map(rows, work, "page_id long, url string, text string, n_chars long, nearest_id long, n_shared long")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, nearest_id, n_shared: the main text of every row of `pages` (page_id, url, html).

    Null html and pages without text give an empty text. A null URL has no host, and pages without one are compared among
    each other. Repeated rows are one page in the order, and each gets its row. nearest_id is null where a host has no
    other page than near copies within REACH places. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    found = scratch.result(nearest(pages, scratch))
    # what goes is known for every page, so it isn't broadcast: it grows with the pages
    return text_of(parsed(pages).join(found.hint("merge"), "mark", "left"))
