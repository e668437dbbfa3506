"""Links between sets of shingles, and the classes that they form, over a whole corpus.

Shared by the n-gram Jaccard join and the substring deduplication, which differ in
what a unit of text is and in the keys under which two linked units must meet.

1.  One reading of the texts gives every unit's set size and 128-bit set id.  Units of
    equal sets are one from here on.  One in ``RATE`` of all pairs of a key and a set,
    chosen by hash, counts keys over the whole corpus, so that frequent ones are known
    (a bounded number; they decide what is cheap, never what is found).
2.  A second reading sends each set's keys, packed, to buckets of the key space.  What a
    frequent key gathers is split further by set, so that no task gets it whole.
3.  Sets that share a key meet at their list's home, the list's least set.  Lists with one
    home are merged there, so that a set is at few places, however many keys it shares.
4.  At each home signature trees over the sets' bitmaps, kept from the first reading, name
    the pairs that can be linked: a dual traversal prunes pairs of nodes by the overlap
    that sizes and OR-combined bitmaps allow.  Sets without such a pair leave the home.
5.  A third reading brings the sets that are left to their homes, where the same traversal
    leads to the links, each verified exactly.  Pairs of nodes whose sets are one component
    already are pruned, too, so a dense group of thousands costs about as many
    verifications as it has sets.
6.  A home of more than ``TOGETHER`` sets, or ``WEIGHT`` shingles, is dealt to parts, which
    share some sets (``WITNESSES`` on average) and are joined as if they were homes.  The
    sets outside the largest component then go through trees with all other parts, in
    blocks; sets of the largest component needn't meet one another again.

Two linked sets share a key, so they meet at a home or are of one component there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .textnp import mix
from .tokenizers_io import release

#: Keys known to all tasks as frequent: 6 MB with their ranks and parts.
HOT = 1 << 18
#: One in so many pairs of a key and a set is counted.
RATE = 64
#: Sets, and shingles, that meet in one task.
TOGETHER, WEIGHT = 2048, 1 << 22
#: Text bytes whose sets are held at once.
STRETCH = 4 << 20
WITNESSES = 16
LEAF = 16

#: A unit: its place in its row, its words, and its sorted distinct shingle hashes.
Unit = tuple[int, int, np.ndarray]


@dataclass(frozen=True)
class Hot:
    """Frequent keys in ascending order, each one's rank by frequency, and into how many parts it is split."""

    keys: np.ndarray
    rank: np.ndarray
    parts: np.ndarray

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key would be, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


@dataclass(frozen=True)
class Scheme:
    """What the two users differ in.

    units: the units of each text of a string column without nulls.
    shared: the keys of a set that are counted to find frequent ones.
    keys: the keys under which a set is listed, given the frequent keys.
    numerator, denominator: the least Jaccard similarity of a link.
    """

    units: Callable[[pa.Array], list[list[Unit]]]
    shared: Callable[[list[np.ndarray]], list[np.ndarray]]
    keys: Callable[[list[np.ndarray], Hot], list[np.ndarray]]
    numerator: int = 3
    denominator: int = 4


_SALTS = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """Two independent signed 64-bit hashes of each set, 0 for an empty one."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    out = np.zeros((2, len(sets)), dtype=np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[k] for k in full.tolist()])
        sizes = sizes[full]
        at = np.cumsum(sizes) - sizes
        for j, salt in enumerate(_SALTS):
            out[j, full] = mix(np.add.reduceat(mix(flat ^ salt), at) + sizes.astype(np.uint64)).view(np.int64)
    return out


@dataclass
class _Stretch:
    """The units of about ``STRETCH`` bytes of text: key and row of each, place, words, set and both ids."""

    key: pa.Array
    row: pa.Array
    place: np.ndarray
    words: np.ndarray
    sets: list[np.ndarray]
    ids: np.ndarray

    def distinct(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Each non-empty set once, and the first halves of their ids."""
        first = {pair: k for k, pair in enumerate(zip(*self.ids.tolist(), strict=True)) if len(self.sets[k])}
        at = list(first.values())
        return [self.sets[k] for k in at], self.ids[0, at]


def _stretches(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[_Stretch]:
    release()
    held: list[_Stretch] = []
    size = 0

    def whole() -> _Stretch:
        return _Stretch(
            pa.concat_arrays([s.key for s in held]), pa.concat_arrays([s.row for s in held]), np.concatenate([s.place for s in held]), np.concatenate([s.words for s in held]),
            [x for s in held for x in s.sets], np.concatenate([s.ids for s in held], axis=1),
        )

    for batch in common.steps(batches, "text"):
        column = common.strings(batch.column("text"))
        units = scheme.units(column)
        of = pa.array(np.repeat(np.arange(len(units)), [len(u) for u in units]))
        flat = [u for some in units for u in some]
        sets = [u[2] for u in flat]
        place, words = (np.array([u[k] for u in flat], dtype=kind) for k, kind in ((0, np.int64), (1, np.int32)))
        held.append(_Stretch(batch.column("key").take(of), batch.column("row").take(of), place, words, sets, set_ids(sets)))
        size += column.nbytes
        if size >= STRETCH:
            yield whole()
            held, size = [], 0
    if held:
        yield whole()


def normal(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, row (a hash of the text, which tells rows of one key apart) and text: no other column meets those of this module."""
    return df.select(common.col(key).alias("key"), F.xxhash64(common.col(text)).alias("row"), common.col(text).alias("text"))


def measure(df: DataFrame, scheme: Scheme) -> DataFrame:
    """Every unit with its set's size and id, one of each set and stretch with its bitmap; and, in rows that are ``counted``, pairs of a key and a set (check, sid); written."""
    kind = df.schema["key"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _stretches(batches, scheme):
            sets, own = s.distinct()
            shared = scheme.shared(sets)
            keys = np.concatenate(shared) if shared else np.empty(0, np.uint64)
            sids = np.repeat(own, [len(k) for k in shared])
            chosen = np.flatnonzero(mix(keys ^ mix(sids.view(np.uint64))) < np.uint64((2**64 - 1) // RATE))
            n, more = len(s.sets), len(chosen)
            maps = {pair: k for k, pair in reversed([*enumerate(zip(*s.ids.tolist(), strict=True))])}
            first = set(maps.values())
            bits = [bitmap(x).tobytes() if len(x) and k in first else None for k, x in enumerate(s.sets)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([s.key.cast(arrow), pa.nulls(more, arrow)]), pa.concat_arrays([s.row, pa.nulls(more, pa.int64())]),
                    pa.array(np.concatenate([s.place, np.zeros(more, np.int64)])), pa.array(np.concatenate([s.words, np.zeros(more, np.int32)])),
                    pa.array(np.array([len(x) for x in s.sets] + [0] * more, dtype=np.int64)), pa.array(np.concatenate([s.ids[0], sids[chosen]])),
                    pa.array(np.concatenate([s.ids[1], keys[chosen].view(np.int64)])), pa.array(np.arange(n + more) >= n),
                    pa.array(bits + [None] * more, pa.binary()),
                ],
                names=["key", "row", "place", "n_words", "n", "sid", "check", "counted", "bitmap"],
            )

    schema = f"key {kind.simpleString()}, row bigint, place bigint, n_words int, n bigint, sid bigint, check bigint, counted boolean, bitmap binary"
    return common.cut(df.select("key", "row", "text").mapInArrow(run, schema))


def hot_keys(measured: DataFrame) -> Hot:
    """The most frequent keys of those that were chosen with two sets or more."""
    pairs = measured.where("counted").select("check", "sid").distinct()
    counts = pairs.groupBy("check").agg((RATE * F.count("*")).alias("n")).where(F.col("n") >= 2 * RATE)
    rows = counts.orderBy(F.desc("n"), "check").limit(HOT).toPandas()  # a bounded number; any choice gives the same result
    keys = rows["check"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Hot(keys[order], len(keys) - order, 1 + rows["n"].to_numpy(dtype=np.int64)[order] // TOGETHER)


_ROW = np.dtype([("key", "<u8"), ("sid", "<i8"), ("n", "<u4")])


def lists(df: DataFrame, scheme: Scheme, hot: Hot) -> DataFrame:
    """(home, sid) of the sets that share a key with another; written.

    In rows that are ``split``, home is the key, and their list is in several parts.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(hot)
    parts = common.partitions(spark)
    buckets = 4 * parts
    num, den = scheme.numerator, scheme.denominator

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        first = np.cumsum(hot.parts) - hot.parts
        for s in _stretches(batches, scheme):
            sets, sids = s.distinct()
            if not sets:
                continue
            own = scheme.keys(sets, hot)
            counts = np.array([len(k) for k in own])
            rows = np.empty(int(counts.sum()), dtype=_ROW)
            rows["key"] = np.concatenate(own)
            rows["sid"] = np.repeat(sids, counts)
            rows["n"] = np.repeat(np.array([len(s) for s in sets]), counts)
            group = (mix(rows["key"]) % np.uint64(buckets)).astype(np.int64)
            at, there = hot.find(rows["key"])
            if there.any():
                many = there & (hot.parts[at] > 1)
                part = (mix(rows["sid"].view(np.uint64)) % hot.parts[at].astype(np.uint64)).astype(np.int64)
                group = np.where(many, -1 - (first[at] + part), group)
            order = np.argsort(group, kind="stable")
            rows, group = rows[order], group[order]
            at = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            ends = np.append(at[1:], len(group))
            for k in range(0, len(at), 1024):
                some = pa.array([rows[a:b].tobytes() for a, b in zip(at[k : k + 1024].tolist(), ends[k : k + 1024].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(group[at[k : k + 1024]]), some], names=["bucket", "rows"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, chunks in grouped(batches, "bucket", ["rows"]):
            rows = np.concatenate([np.frombuffer(c, dtype=_ROW) for c in chunks["rows"]])
            home, sid = (rows["key"].view(np.int64), rows["sid"]) if bucket < 0 else meetings(rows, num, den)
            if not len(home):
                continue
            order = np.lexsort((sid, home))
            home, sid = home[order], sid[order]
            new = np.concatenate([[True], (home[1:] != home[:-1]) | (sid[1:] != sid[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(home[new]), pa.array(sid[new]), pa.array(np.full(int(new.sum()), bucket < 0))], names=["home", "sid", "split"])

    sent = df.select("key", "row", "text").mapInArrow(send, "bucket bigint, rows binary")
    return common.cut(sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "home bigint, sid bigint, split boolean"))


def meetings(rows: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(home, sid) of every list of two sets or more; a set that has no other of a similar size in a list isn't in it."""
    key, sid, n = (np.ascontiguousarray(rows[c]) for c in ("key", "sid", "n"))
    order = np.lexsort((n, key))
    key, sid, n = key[order], sid[order], n[order].astype(np.int64)
    similar = (key[1:] == key[:-1]) & (den * n[:-1] >= num * n[1:])
    keep = np.zeros(len(key), dtype=bool)
    keep[1:] = similar
    keep[:-1] |= similar
    key, sid = key[keep], sid[keep]
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    if not len(key):
        return key.view(np.int64), sid
    first = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(key)) - 1
    several = sid[at] != sid[last]
    home = sid[at][np.cumsum(first) - 1]
    inside = several[np.cumsum(first) - 1]
    return home[inside], sid[inside]


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in short slices, so that only a few are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def grouped(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[Any, dict[str, list]]]:
    """Each key with its values, from batches sorted by key."""
    now: Any = None
    held: dict[str, list] = {c: [] for c in columns}
    for batch in _parts(batches):
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        values = {c: batch.column(c).to_pylist() for c in columns}
        at = 0
        for end in [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]:
            if at == end:
                continue
            if held[columns[0]] and keys[at] != now:
                yield now, held
                held = {c: [] for c in columns}
            now = keys[at]
            for c in columns:
                held[c] += values[c][at:end]
            at = end
    if held[columns[0]]:
        yield now, held


def homes(found: DataFrame, holders: DataFrame) -> DataFrame:
    """Every set of every home: home, uid, parts, part, and whether it is a witness in all parts; written."""
    # At most HOT keys are split.
    firsts = found.where("split").groupBy(F.col("home").alias("list")).agg(F.min("sid").alias("least"))
    rows = found.where("NOT split").select("home", "sid")
    rows = rows.union(found.where("split").join(F.broadcast(firsts), F.col("home") == F.col("list")).select(F.col("least").alias("home"), "sid"))
    members = common.cut(rows.distinct().join(holders.select("sid", "uid", "n"), "sid").select("home", "uid", "n"))
    deal = F.greatest(F.ceil(F.count("*") / TOGETHER), F.ceil(F.sum("n") / WEIGHT))
    # Written, so that Spark can split a large home's members in the join.
    sizes = common.cut(members.groupBy("home").agg(F.count("*").alias("size"), deal.cast("int").alias("parts")).where("size > 1").drop("size"))
    dealt = members.join(sizes, "home")
    rare = F.pmod(F.xxhash64("uid"), F.col("parts").cast("bigint") * (TOGETHER // WITNESSES)) == 0
    part = F.pmod(F.xxhash64("uid", "home"), F.col("parts").cast("bigint")).cast("int")
    return common.cut(dealt.select("home", "uid", "parts", part.alias("part"), ((F.col("parts") > 1) & rare).alias("witness")))


def likely(dealt: DataFrame, holders: DataFrame, scheme: Scheme) -> DataFrame:
    """What is left of ``dealt`` when sets that can't be linked to any of their home have gone; homes in parts stay whole; written."""
    num, den = scheme.numerator, scheme.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        size = 0
        for home, rows in grouped(common.steps(batches, "bitmap"), "home", ["uid", "n", "bitmap"]):
            uid, n = (np.array(rows[c], dtype=np.int64) for c in ("uid", "n"))
            keep = paired(n, [np.frombuffer(b, "<u8") for b in rows["bitmap"]], num, den)
            if keep.any():
                left.append(np.stack([np.full(int(keep.sum()), home), uid[keep]]))
                size += int(keep.sum())
            if size > 1 << 16:
                both = np.concatenate(left, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["home", "uid"])
                left, size = [], 0
        if left:
            both = np.concatenate(left, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["home", "uid"])

    small = dealt.where("parts = 1").select("home", "uid").join(holders.select("uid", "n", "bitmap"), "uid")
    parts = common.partitions(dealt.sparkSession)
    left = small.select("home", "uid", "n", "bitmap").repartition(parts, "home").sortWithinPartitions("home").mapInArrow(run, "home bigint, uid bigint")
    left = left.select("home", "uid", F.lit(1).alias("parts"), F.lit(0).alias("part"), F.lit(False).alias("witness"))
    return common.cut(left.union(dealt.where("parts > 1")))


def bring(df: DataFrame, scheme: Scheme, dealt: DataFrame, holders: DataFrame) -> DataFrame:
    """home, part, uid, whether it is the set's own part, and the packed shingles, of every set of every home; written."""
    # A row's sets and their homes are bounded by its keys.
    want = F.collect_list(F.struct("place", "uid", "home", "part", F.when(F.col("witness"), F.col("parts")).otherwise(0).alias("parts"))).alias("want")
    wanted = dealt.join(holders, "uid").groupBy(F.col("first.key").alias("key2"), F.col("first.row").alias("row2")).agg(want)
    texts = df.join(wanted, F.col("key").eqNullSafe(F.col("key2")) & (F.col("row") == F.col("row2"))).select("text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in common.steps(batches, "text"):
            rows: list[tuple] = []
            size = 0
            for units, want in zip(scheme.units(common.strings(batch.column("text"))), batch.column("want").to_pylist(), strict=True):
                sets = {place: s for place, _, s in units}
                for w in want:
                    packed = sets[w["place"]].tobytes()
                    for part in range(w["parts"]) if w["parts"] else (w["part"],):
                        rows.append((w["home"], part, w["uid"], part == w["part"], packed))
                        size += len(packed)
                        if size > STRETCH:
                            yield _sets_batch(rows)
                            rows, size = [], 0
            if rows:
                yield _sets_batch(rows)

    return common.cut(texts.mapInArrow(run, "home bigint, part int, uid bigint, own boolean, shingles binary"))


def _sets_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["home", "part", "uid", "own", "shingles"])


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The set's hashes as bits of 64-bit words; the width is the least power of two of four times the size, at least 64."""
    width = 1 << max(6, int(4 * len(shingles) - 1).bit_length())
    bits = np.zeros(width, dtype=np.uint8)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words, folded to ``width`` bits by OR."""
    while bits.shape[1] * 64 > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class _Tree:
    """Sets by size under nodes with OR-combined bitmaps, size ranges and least bit counts."""

    def __init__(self, at: np.ndarray, n: np.ndarray, bits: np.ndarray) -> None:
        order = np.argsort(n, kind="stable")
        self.at, self.n, self.bits = at[order], n[order], bits[order]
        self.pops = np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        self.nodes: list[tuple] = []
        self.root = self._node(0, len(at))

    def _node(self, low: int, high: int) -> int:
        children: list[int] = []
        if high - low > LEAF:
            middle = (low + high) // 2
            children = [self._node(low, middle), self._node(middle, high)]
            union = self.nodes[children[0]][3] | self.nodes[children[1]][3]
        else:
            union = np.bitwise_or.reduce(self.bits[low:high], axis=0)
        self.nodes.append((low, high, children, union, int(self.n[low]), int(self.n[high - 1]), int(self.pops[low:high].min())))
        return len(self.nodes) - 1


def dual(
    n: np.ndarray, bits: list[np.ndarray], num: int, den: int, over: Callable[[np.ndarray, np.ndarray], bool], meet: Callable[[np.ndarray, np.ndarray], None], side: np.ndarray | None = None
) -> None:
    """Dual traversal of signature trees: ``meet`` gets every pair of sets that may be linked, the likeliest of some first.

    ``over`` says of the sets of two nodes that nothing is to be found there any more.
    With ``side``, only pairs of one set from each side are looked at.  Sets are in trees by
    bitmap width; a pair of trees is compared at the narrower width.  A bound holds for whole
    nodes: bits outside the other node's union are elements that no set there has.
    """
    width = np.array([64 * len(b) for b in bits])
    groups: dict[tuple[int, int], np.ndarray] = {}
    for w in np.unique(width).tolist():
        for s in (0,) if side is None else (0, 1):
            at = np.flatnonzero((width == w) & (True if side is None else side == s))
            if len(at):
                groups[w, s] = at
    built: dict[tuple[int, int, int], _Tree] = {}

    def tree(key: tuple[int, int], w: int) -> _Tree:
        if (*key, w) not in built:
            at = groups[key]
            built[*key, w] = _Tree(at, n[at], fold(np.stack([bits[k] for k in at.tolist()]), w))
        return built[*key, w]

    keys = sorted(groups)
    for i, key in enumerate(keys):
        for other in keys[i::-1]:
            a, b = n[groups[key]], n[groups[other]]
            if (side is None or key[1] != other[1]) and den * a.max() >= num * b.min() and den * b.max() >= num * a.min():
                w = min(key[0], other[0])
                _cross(tree(key, w), tree(other, w), num, den, over, meet)


def _cross(x: _Tree, y: _Tree, num: int, den: int, over: Callable[[np.ndarray, np.ndarray], bool], meet: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """A node meets itself before it meets others, so that what is dense is over early."""
    stack = [(x.root, y.root)]
    while stack:
        i, j = stack.pop()
        a, b, below, union, least, most, pops = x.nodes[i]
        c, d, below_y, union_y, least_y, most_y, pops_y = y.nodes[j]
        if den * most < num * least_y or den * most_y < num * least or over(x.at[a:b], y.at[c:d]):
            continue
        both = int(np.bitwise_count(union & union_y).sum())
        overlap = min(most - max(0, pops - both), most_y - max(0, pops_y - both))
        if overlap * (num + den) < num * (least + least_y):
            continue
        if below and (not below_y or b - a >= d - c):
            if x is y and i == j:
                stack += [(below[1], below[0]), (below[1], below[1]), (below[0], below[0])]
            else:
                stack += [(k, j) for k in below]
        elif below_y:
            stack += [(i, k) for k in below_y]
        else:
            p, q = x.bits[a:b, None, :], y.bits[None, c:d, :]
            n, m = x.n[a:b, None], y.n[None, c:d]
            most_common = np.minimum(n - np.bitwise_count(p & ~q).sum(axis=2).astype(np.int64), m - np.bitwise_count(q & ~p).sum(axis=2).astype(np.int64))
            ok = most_common * (num + den) >= num * (n + m)
            if x is y and i == j:
                ok &= np.tri(b - a, d - c, -1, dtype=bool)
            r, s = np.nonzero(ok)
            if len(r):
                best = np.argsort((n + m)[r, s] / most_common[r, s], kind="stable")
                meet(x.at[a + r[best]], y.at[c + s[best]])


def paired(n: np.ndarray, bits: list[np.ndarray], num: int = 3, den: int = 4) -> np.ndarray:
    """Of each set whether the bounds allow it a link to any other."""
    out = np.zeros(len(n), dtype=bool)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        out[i] = out[j] = True

    dual(n, bits, num, den, lambda i, j: bool(out[i].all() and out[j].all()), meet)
    return out


def join(sets: list[np.ndarray], label: np.ndarray | None = None, side: np.ndarray | None = None, num: int = 3, den: int = 4) -> list[tuple[int, int]]:
    """Links between the sets, as many as make the components that all their links make; ``label``: what is one component already."""
    n = np.array([len(s) for s in sets], dtype=np.int64)
    component = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    links: list[tuple[int, int]] = []

    def over(i: np.ndarray, j: np.ndarray) -> bool:
        one = component[i[0]]
        return bool((component[i] == one).all() and (component[j] == one).all())

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            u, v = component[a], component[b]
            if u != v and linked(sets[a], sets[b], num, den):
                links.append((a, b))
                component[component == u] = v

    dual(n, [bitmap(s) for s in sets], num, den, over, meet, side)
    return links


def linked(a: np.ndarray, b: np.ndarray, num: int = 3, den: int = 4) -> bool:
    """Whether the exact Jaccard similarity reaches num / den."""
    n, m = len(a), len(b)
    if den * min(n, m) < num * max(n, m):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common_ = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * common_ >= num * (n + m - common_)


def solve(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) within each task: rows of task, uid, label, side (-1: none) and shingles; written."""
    num, den = scheme.numerator, scheme.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = common.steps(batches, "shingles")
        for _, task in grouped(slices, "task", ["uid", "label", "side", "shingles"]):
            uid, first = np.unique(np.array(task["uid"], dtype=np.int64), return_index=True)  # of repeated rows one is enough
            if len(uid) < 2:
                continue
            label, side = (np.array(task[c], dtype=np.int64)[first] for c in ("label", "side"))
            sets = [np.frombuffer(task["shingles"][k], "<u8") for k in first.tolist()]
            found = join(sets, label, None if side[0] < 0 else side, num, den)
            if found:
                at = uid[np.array(found)]
                yield pa.RecordBatch.from_arrays([pa.array(at.min(axis=1)), pa.array(at.max(axis=1))], names=["a", "b"])

    parts = common.partitions(rows.sparkSession)
    dealt = rows.select("task", "uid", "label", "side", "shingles").repartition(parts, "task").sortWithinPartitions("task")
    return common.cut(dealt.mapInArrow(run, "a bigint, b bigint"))


def stragglers(dealt: DataFrame, labels: DataFrame | None, brought: DataFrame, scheme: Scheme) -> DataFrame | None:
    """The links between parts of homes in parts, beyond those that the parts have found; written."""
    large = dealt.where("parts > 1").select("home", "uid", "parts", "part")
    known = common.cut(labelled(large, labels))
    counts = known.groupBy("home", "label").agg(F.count("*").alias("n"))
    tops = counts.groupBy("home").agg(F.max(F.struct("n", "label")).alias("top"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    open_ = common.cut(tops.select("home", F.col("top.label").alias("around"), F.ceil(F.col("rest") / TOGETHER).cast("int").alias("blocks")))
    if open_.isEmpty():
        return None
    known = known.join(open_, "home")
    block = F.pmod(F.xxhash64("uid", F.lit(7)), F.col("blocks").cast("bigint")).cast("int")
    outside = known.where("label <> around").select("home", "uid", "label", "part", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    outside = outside.where("other <> part").select(F.xxhash64("home", "block", "other").alias("task"), "uid", "label", F.lit(0).alias("side"))
    every = known.select("home", "uid", "label", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    every = every.select(F.xxhash64("home", "block", "part").alias("task"), "uid", "label", F.lit(1).alias("side"))
    sets = brought.where("own").select("uid", "shingles").dropDuplicates(["uid"])
    return solve(outside.union(every).join(sets, "uid"), scheme)


def labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` with each set's label, its own id if it has no link yet."""
    if labels is None:
        return rows.withColumn("label", F.col("uid"))
    return rows.join(labels, "uid", "left").withColumn("label", F.coalesce("label", "uid"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as (set, smallest set of its local component)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root.setdefault(a, a)
            root.setdefault(b, b)
            if a != b:
                root[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(root)]
    for at in range(0, len(rows), 1 << 16):
        a, b = zip(*rows[at : at + (1 << 16)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(uid, label) for every end of a link, the label being the smallest id of its component.

    Labels spread along links and jump to their label's label, until their sum stays;
    every round is a few joins on the ids.  Links are first reduced, partition by
    partition, to the forests they form.
    """
    pairs = links.mapInArrow(_forest, "a bigint, b bigint").where("a <> b")
    edges = common.cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.cut(edges.groupBy(F.col("a").alias("uid")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    total = None
    while True:
        row = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("t"), F.count("*").alias("n")).first()
        if not row["n"] or row["t"] == total:
            return labels
        total = row["t"]
        near = edges.join(labels.withColumnRenamed("uid", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near, F.col("uid") == F.col("a")).select("uid", F.least("label", "near").alias("label"))
        spread = common.cut(spread)
        top = spread.select(F.col("uid").alias("label"), F.col("label").alias("top"))
        labels = common.cut(spread.join(top, "label").select("uid", F.least("label", "top").alias("label")))


@dataclass
class Classes:
    """units: key, row, place, n_words, n, sid, check of every unit; sets: sid, check, uid, label and lowest key of every set."""

    units: DataFrame
    sets: DataFrame


def classes(df: DataFrame, scheme: Scheme) -> Classes:
    """Units and components of a whole table in the form of ``normal``, as the module says."""
    with common.scratch() as tables:
        measured = measure(df, scheme)
        units = measured.where("NOT counted").drop("counted", "bitmap")
        first, lowest = F.min(F.struct("key", "row", "place")).alias("first"), F.min("key").alias("lowest")
        sets = measured.where("NOT counted AND n > 0").groupBy("sid", "check")
        holders = sets.agg(first, lowest, F.first("n").alias("n"), F.first("bitmap", ignorenulls=True).alias("bitmap"))
        holders = common.cut(holders.withColumn("uid", F.monotonically_increasing_id()))
        dealt = homes(lists(df, scheme, hot_keys(measured)), holders)
        dealt = likely(dealt, holders, scheme)
        where = holders.select("uid", "first", F.col("first.place").alias("place"))
        brought = bring(df, scheme, dealt, where)
        links = solve(brought.select(F.xxhash64("home", "part").alias("task"), "uid", F.col("uid").alias("label"), F.lit(-1).alias("side"), "shingles"), scheme)
        labels = None if links.isEmpty() else components(links)
        more = stragglers(dealt, labels, brought, scheme)
        if more is not None and not more.isEmpty():
            links = links.union(more)
            labels = components(links)
        sets = common.cut(labelled(holders.select("sid", "check", "uid", "lowest"), labels))
        tables.keep(measured, sets)
    return Classes(units, sets)
