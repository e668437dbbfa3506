"""Runs of words that several rows share, wherever they stand: over lines or inside one.

1.  Every run of ``RUN`` words is banded by the MinHash value of its grams of ``GRAM``
    words: the least of them, its anchor.  Equal runs have equal anchors; neighbours mostly
    share one, so anchors are few.
2.  Places whose anchors rows of several keys have are looked up in their texts again, which
    gives every run of exactly ``RUN`` words around them.
3.  Runs that rows of several keys have are kept with their first place, by key and
    place, and adjacent ones of one row and one first row become one passage.

Rows on the way are packed by bucket, so the JVM doesn't see single words.  What is very
frequent is known from one in ``SAMPLE`` keys (a bounded number; it decides how rows are
dealt, not what is found): such anchors needn't meet, since several keys are known to have
them, and such runs get their first place by an aggregate.  Both are dealt by key.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textnp

#: Words of the shortest shared run, and of the grams that find it.
RUN, GRAM = 51, 26
REACH = RUN - GRAM + 1
#: One key in so many tells what is frequent; how many of these keys must have it; how many hashes are kept.
SAMPLE, LEAST, HOT = 256, 8, 1 << 18


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``size`` neighbours."""
    width = 1
    out = x
    while 2 * width <= size:
        out = best(out[:-width], out[width:])
        width *= 2
    return best(out[: len(x) - size + 1], out[size - width : len(x) - width + 1])


def anchors(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each gram that is the least of ``REACH`` neighbours in one row; ties are all taken."""
    found, at, of = textnp.windows(words, rows, GRAM)
    if len(found) < REACH:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    least = _sliding(found, REACH, np.minimum)
    least[of[: len(least)] != of[REACH - 1 :]] = 0
    none = np.zeros(REACH - 1, np.uint64)
    chosen = np.flatnonzero((_sliding(np.concatenate([none, least, none]), REACH, np.maximum) == found) & (found > 0))
    return found[chosen], at[chosen]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash, row and line in its row, and the first word of each row and the end."""
    buf, offsets = common.utf8(column)
    low = textnp.LOWER[buf]
    begin, end, rows = textnp.spans(low, offsets)
    feeds = np.flatnonzero(low == 10)
    line = np.searchsorted(feeds, begin) - np.searchsorted(feeds, offsets)[rows]
    return textnp.hashes(low, begin, end), rows, line, np.searchsorted(rows, np.arange(len(offsets)))


def _spread(keys: pa.Array, buckets: int) -> np.ndarray:
    """A bucket for each key, whatever its type."""
    coded = keys.dictionary_encode(null_encoding="encode")
    own = np.array([zlib.crc32(repr(k).encode()) % buckets for k in coded.dictionary.to_pylist()], dtype=np.int64)
    return own[coded.indices.to_numpy(zero_copy_only=False)]


def _rank(keys: pa.Array) -> np.ndarray:
    """Each key's place in the order of keys, null first."""
    return pc.rank(keys, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)


def _deal(bucket: np.ndarray, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """One row per bucket with its values as lists."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = pa.array(np.append(at, len(bucket)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, c.take(pa.array(order))) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), *lists], names=["bucket", *columns])


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, pa.Array]]]:
    """Each bucket and its values, from batches sorted by bucket."""
    held: list[pa.RecordBatch] = []
    now = None

    def whole() -> tuple[int, dict[str, pa.Array]]:
        return int(now), {c: pa.concat_arrays([x.column(c).flatten() for x in held]) for c in held[0].schema.names if c != "bucket"}

    for batch in batches:
        bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, z in zip(edges, edges[1:], strict=False):
            if a == z:
                continue
            if held and bucket[a] != now:
                yield whole()
                held = []
            now = bucket[a]
            held.append(batch.slice(a, z - a))
    if held:
        yield whole()
    common.trim()


def _gathered(parts: Iterator[dict[str, pa.Array]], limit: int = 1 << 16) -> Iterator[dict[str, pa.Array]]:
    """The same rows, those of several parts at once up to about ``limit``: few buckets of many rows are dealt."""
    held: list[dict[str, pa.Array]] = []
    size = 0
    for part in parts:
        held.append(part)
        size += len(part["k"])
        if size >= limit:
            yield {c: pa.concat_arrays([x[c] for x in held]) for c in part}
            held, size = [], 0
    if held:
        yield {c: pa.concat_arrays([x[c] for x in held]) for c in held[0]}


def _several(hashes: np.ndarray, rank: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, each place once, whose hash several keys have, and the first row of the same hash."""
    order = np.lexsort((place, rank, hashes))
    h, r, p = hashes[order], rank[order], place[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
    order, h, r = order[new], h[new], r[new]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    sizes = np.diff(np.append(at, len(h)))
    keep = np.repeat(r[at] != r[at + sizes - 1], sizes)
    return order[keep], order[np.repeat(at, sizes)[keep]]


def _known(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def frequent(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the anchors, and of the runs, that many keys are known to have."""
    kind = df.schema["key"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "text"):
            words, rows, _, _ = _words(common.strings(batch.column("text")))
            rank = _rank(batch.column("key"))
            anchor, at = anchors(words, rows)
            run, _, of = textnp.windows(words, rows, RUN)
            for is_run, h, row in ((False, anchor, rows[at]), (True, run, of)):
                if not len(h):
                    continue
                order = np.lexsort((rank[row], h))
                h, row = h[order], row[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (rank[row[1:]] != rank[row[:-1]])])
                h, row = h[new], row[new]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                last = np.append(first[1:], len(h)) - 1
                keys = batch.column("key")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), is_run)), pa.array(h[first].view(np.int64)), pa.array((last - first + 1).astype(np.int64)), keys.take(pa.array(row[first])), keys.take(pa.array(row[last]))],
                    names=["run", "h", "n", "low", "high"],
                )

    some = df.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select("key", "text")
    counts = some.mapInArrow(count, f"run boolean, h bigint, n bigint, low {kind}, high {kind}")
    many = counts.groupBy("run", "h").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where((F.col("n") >= LEAST) & (F.col("low") < F.col("high")))
    rows = many.orderBy(F.desc("n"), "h").limit(HOT).select("run", "h").toPandas()  # a bounded number; any choice gives the same result
    hashes, is_run = rows["h"].to_numpy(dtype=np.int64).view(np.uint64), rows["run"].to_numpy(dtype=bool)
    return np.sort(hashes[~is_run]), np.sort(hashes[is_run])


def shared_runs(df: DataFrame) -> DataFrame:
    """One row per passage of ``RUN`` words or more that rows of several keys share; ``df`` has key and text.

    key, line and last_line, first_word and n_words, the same of the passage's first
    place (first_key, first_line), and whether it is another place than that (removed).
    """
    kind = df.schema["key"].dataType.simpleString()
    spark = df.sparkSession
    parts = common.partitions(spark)
    hot = spark.sparkContext.broadcast(frequent(df))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "text"):
            words, rows, _, first = _words(common.strings(batch.column("text")))
            found, at = anchors(words, rows)
            if len(found):
                keys = batch.column("key").take(pa.array(rows[at]))
                place = pa.array((at - first[rows[at]]).astype(np.int32))
                bucket = np.where(_known(hot.value[0], found), parts + _spread(keys, parts), (textnp.mix(found) % np.uint64(parts)).astype(np.int64))
                yield _deal(bucket, {"h": pa.array(found.view(np.int64)), "k": keys, "place": place})

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for bucket, b in _buckets(batches):
            at = np.arange(len(b["k"])) if bucket >= parts else _several(b["h"].to_numpy(), _rank(b["k"]), b["place"].to_numpy())[0]
            if len(at):
                yield {c: b[c].take(pa.array(at)) for c in ("k", "place")}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(met(batches)):
            yield _deal(_spread(b["k"], parts), b)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _buckets(batches):
            rank, place = _rank(b["k"]), b["place"].to_numpy()
            order = np.lexsort((place, rank))
            at = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)), pa.int32()), pa.array(place[order]))
            yield pa.RecordBatch.from_arrays([b["k"].take(pa.array(order[at])), lists], names=["key2", "at"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "text"):
            words, rows, line, first = _words(common.strings(batch.column("text")))
            lists = batch.column("at")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            place = lists.flatten().to_numpy()[:, None] - np.arange(REACH)
            row = np.broadcast_to(row[:, None], place.shape)
            start = first[row] + place
            near = np.zeros(len(words) + 1, dtype=bool)
            near[start[(place >= 0) & (start + RUN <= first[row + 1])]] = True
            found, at, of = textnp.windows(words, rows, RUN)
            keep = near[at]
            found, at, of = found[keep], at[keep], of[keep]
            if len(found):
                columns = {"place": at - first[of], "line": line[at], "last": line[at + RUN - 1]}
                packed = {c: pa.array(x.astype(np.int32)) for c, x in columns.items()}
                keys = batch.column("key").take(pa.array(of))
                bucket = np.where(_known(hot.value[1], found), parts + _spread(keys, parts), (textnp.mix(found) % np.uint64(parts)).astype(np.int64))
                yield _deal(bucket, {"h": pa.array(found.view(np.int64)), "k": keys, **packed})

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = {c: batch.column(c).flatten() for c in ("h", "k", "place", "line")}
            h = b["h"].to_numpy()
            order = np.lexsort((b["place"].to_numpy(), _rank(b["k"]), h))
            at = pa.array(order[np.concatenate([[True], h[order][1:] != h[order][:-1]])[: len(h)]])
            yield pa.RecordBatch.from_arrays([b[c].take(at) for c in b], names=list(b))

    def gathered(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
        return rows.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)

    keys = f"bucket bigint, k array<{kind}>, place array<int>"
    picked = df.select("key", "text").mapInArrow(pick, f"bucket bigint, h array<bigint>, k array<{kind}>, place array<int>")
    at = common.cut(gathered(gathered(picked, meet, keys), spots, f"key2 {kind}, at array<int>"))
    texts = df.select("key", "text").join(at, F.col("key").eqNullSafe(F.col("key2"))).select("key", "text", "at")
    found = common.cut(texts.mapInArrow(grams, f"bucket bigint, h array<bigint>, k array<{kind}>, place array<int>, line array<int>, last array<int>"))
    lowest = found.where(F.col("bucket") >= parts).mapInArrow(least, f"h bigint, k {kind}, place int, line int")
    lowest = lowest.groupBy("h").agg(F.min(F.struct("k", "place", "line")).alias("first")).select("h", "first.*").orderBy("h")
    firsts = spark.sparkContext.broadcast(lowest.toArrow().combine_chunks() if len(hot.value[1]) else None)  # at most HOT rows

    def agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for bucket, b in _buckets(batches):
            if bucket >= parts:
                there = pa.array(np.searchsorted(firsts.value["h"].to_numpy(), b["h"].to_numpy()))
                table = {c: firsts.value[c].combine_chunks() for c in ("k", "place", "line")}
                yield {c: b[c] for c in ("k", "place", "line", "last")} | {f"first_{c}": x.take(there).cast(b[c].type) for c, x in table.items()}
                continue
            at, first = _several(b["h"].to_numpy(), _rank(b["k"]), b["place"].to_numpy())
            if len(at):
                own, there = pa.array(at), pa.array(first)
                yield {c: b[c].take(own) for c in ("k", "place", "line", "last")} | {f"first_{c}": b[c].take(there) for c in ("k", "place", "line")}

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(agreed(batches)):
            yield _deal(_spread(b["k"], parts), b)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, b in _buckets(batches):
            n = len(b["k"])
            both = _rank(pa.concat_arrays([b["k"], b["first_k"]]))
            rank, other = both[:n], both[n:]
            place, shift = b["place"].to_numpy(), b["first_place"].to_numpy() - b["place"].to_numpy()
            order = np.lexsort((shift, other, place, rank))
            rank, other, place, shift = rank[order], other[order], place[order], shift[order]
            again = np.concatenate([[False], (rank[1:] == rank[:-1]) & (place[1:] == place[:-1]) & (other[1:] == other[:-1]) & (shift[1:] == shift[:-1])])  # of repeated rows
            order, rank, other, place, shift = order[~again], rank[~again], other[~again], place[~again], shift[~again]
            new = np.concatenate([[True], (rank[1:] != rank[:-1]) | (place[1:] != place[:-1] + 1) | (other[1:] != other[:-1]) | (shift[1:] != shift[:-1])])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(order)) - 1
            a, z = pa.array(order[begin]), pa.array(order[end])
            yield pa.RecordBatch.from_arrays(
                [
                    b["k"].take(a), b["line"].take(a), b["last"].take(z), b["place"].take(a), pa.array((end - begin + RUN).astype(np.int32)),
                    b["first_k"].take(a), b["first_line"].take(a), pa.array((rank[begin] != other[begin]) | (shift[begin] != 0)),
                ],
                names=["key", "line", "last_line", "first_word", "n_words", "first_key", "first_line", "removed"],
            )

    same = gathered(found, agree, f"{keys}, line array<int>, last array<int>, first_k array<{kind}>, first_place array<int>, first_line array<int>")
    schema = f"key {kind}, line int, last_line int, first_word int, n_words int, first_key {kind}, first_line int, removed boolean"
    return common.cut(gathered(same, passages, schema))
