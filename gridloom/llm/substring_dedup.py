"""Operator 5: repeated passages, paragraph by paragraph and by shared runs of words.

A paragraph is a line of at least ``MIN_WORDS`` words, or shorter lines that have as many
together.  Its five-word shingles get MinHash values in bands, as many as ``tune`` finds
necessary for the wanted recall at the least similarity.  Paragraphs that collide in a band
are verified by exact Jaccard similarity, and the links' components are the classes.  Of
each class the first paragraph, by document and place, stays.  Equal shingle sets are one
class without any banding, so exact copies are never missed.

Passages of over 50 words that documents share may begin and end anywhere.  Every run of
51 words is a paragraph in ``runs``, banded by one MinHash value of its grams, which is
enough as such runs are equal or not; runs that collide are verified, and adjacent ones
become one passage.  Both kinds of rows are in the result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, near, runs, textnp

SIZE, SIMILARITY, RECALL = 5, 0.75, 0.999
#: Words of the shortest paragraph.
MIN_WORDS = 40
LINES = 24
MOST_BANDS = 24
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tune(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """Rows and bands: the most selective rows for which at most ``most`` bands find a pair of this similarity with this chance."""
    best = (1, max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity))))
    for rows in range(2, 32):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands <= most:
            best = (rows, bands)
    return best


ROWS, BANDS = tune()
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 2**64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)


def _joined(counts: np.ndarray, ends: set[int]) -> np.ndarray:
    """Each line's paragraph: a line of ``MIN_WORDS`` words, or shorter lines of one text until they have as many."""
    out = np.empty(len(counts), dtype=np.int64)
    now, words = 0, 0
    for k, n in enumerate(counts.tolist()):
        if words and (n >= MIN_WORDS or words >= MIN_WORDS or k in ends):
            now, words = now + 1, 0
        elif k in ends:
            now += 1
        out[k] = now
        words += n
    return out


def paragraphs(column: pa.Array) -> list[list[near.Unit]]:
    """The paragraphs of ``MIN_WORDS`` words or more of each text: ``place``, words, shingles.

    ``place`` has the first line, from 0, in its upper bits and the number of lines in the lower ``LINES``.
    """
    buf, offsets = common.utf8(column)
    n = len(offsets) - 1
    if not len(buf):
        return [[] for _ in range(n)]
    low = textnp.LOWER[buf]
    starts = np.union1d(offsets[:-1], np.flatnonzero(low == 10) + 1)
    starts = starts[starts < len(buf)]
    begin, end, line = textnp.spans(low, np.append(starts, len(buf)))
    words = textnp.hashes(low, begin, end)
    text = np.searchsorted(offsets, starts, side="right") - 1
    first = np.searchsorted(starts, offsets[:-1])
    group = _joined(np.bincount(line, minlength=len(starts)), set(first.tolist()))
    groups = int(group[-1]) + 1
    found, _, of = textnp.windows(words, group[line], SIZE)
    counts = np.bincount(group[line], minlength=groups)
    bounds = np.searchsorted(of, np.arange(groups + 1))
    lines = np.searchsorted(group, np.arange(groups + 1))
    out: list[list[near.Unit]] = [[] for _ in range(n)]
    for k in np.flatnonzero(counts >= MIN_WORDS).tolist():
        row, at, most = int(text[lines[k]]), int(lines[k]), min(int(lines[k + 1] - lines[k]), (1 << LINES) - 1)
        out[row].append(((at - int(first[row])) << LINES | most, int(counts[k]), np.unique(found[bounds[k] : bounds[k + 1]])))
    return out


def bands(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The band keys of each non-empty set."""
    if not sets:
        return []
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    at = np.cumsum(sizes) - sizes
    keys = np.empty((len(sets), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        value = np.full(len(sets), band + 1, dtype=np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            value = textnp.mix(value ^ np.minimum.reduceat(flat * _FACTORS[k], at))
        keys[:, band] = value
    return list(keys)


SCHEME = near.Scheme(paragraphs, bands, lambda sets, _: bands(sets))


def find_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per repeated paragraph or passage: ``key``, paragraph, n_lines, n_words, class_<key>, class_paragraph, removed, first_word.

    ``paragraph`` is its first line among the text's lines, from 0.  The class is named by its
    first paragraph, which alone isn't removed; a null key comes first.  Rows of one key are one
    document's, and their equal places one paragraph's, which is removed with the
    others unless it is the first.  Null, empty and short texts have no paragraphs;
    an empty table gives an empty one; other columns are left out, whatever their names.

    A row with a ``first_word``, counted in the text from 0, is a passage of ``n_words``
    words that documents share, of over 50 words and any lines.  Passages all of whose lines are
    there in paragraphs, and in removed ones if they are removed, are left out.
    """
    rows = near.normal(df, key, text)
    found = near.classes(rows, SCHEME)
    units = common.cut(found.units.where("n > 0").join(found.sets.select("sid", "check", "label"), ["sid", "check"]).select("key", "place", "n_words", "label"))
    several = units.groupBy("label").agg(F.count("*").alias("size"), F.min(F.struct("key", "place")).alias("first")).where("size > 1")
    same = F.col("key").eqNullSafe(F.col("first.key")) & (F.col("place") == F.col("first.place"))
    line, lines = F.shiftright("place", LINES).cast("int"), F.col("place").bitwiseAND(F.lit((1 << LINES) - 1)).cast("int")
    there = common.cut(units.join(several, "label").select(
        "key", line.alias("line"), lines.alias("n_lines"), "n_words", F.col("first.key").alias("first_key"), F.shiftright("first.place", LINES).cast("int").alias("first_line"), (~same).alias("removed"),
        F.lit(None).cast("int").alias("first_word"),
    ))
    each = there.select("key", F.explode(F.sequence("line", F.col("line") + F.col("n_lines") - 1)).alias("at"), "removed")
    # Bounded by a text's lines.
    listed = each.groupBy(F.col("key").alias("key2")).agg(F.collect_set("at").alias("all"), F.collect_set(F.when(F.col("removed"), F.col("at"))).alias("gone"))
    shared = runs.shared_runs(rows).join(listed, F.col("key").eqNullSafe(F.col("key2")), "left")
    covered = F.size(F.array_except(F.sequence("line", "last_line"), F.when(F.col("removed"), F.col("gone")).otherwise(F.col("all")))) == 0
    shared = shared.where(~F.coalesce(covered, F.lit(False))).withColumn("n_lines", F.col("last_line") - F.col("line") + 1)
    out = there.unionByName(shared.select(*there.columns))
    return out.select(
        F.col("key").alias(key), F.col("line").alias("paragraph"), "n_lines", "n_words", F.col("first_key").alias(f"class_{key}"), F.col("first_line").alias("class_paragraph"), "removed", "first_word"
    )


def without(text: str, lines: set[int], passages: list[tuple[int, int]]) -> str:
    """``text`` without these lines and runs of words (first, number); white space around the words stays."""
    out, at, number = [], 0, 0
    gone = sorted((a, a + n) for a, n in passages)
    for i, line in enumerate(text.split("\n")):
        left, kept = [], 0
        for m in _WORD.finditer(line):
            while at < len(gone) and gone[at][1] <= number:
                at += 1
            if at < len(gone) and gone[at][0] <= number:
                left.append(line[kept : m.start()])
                kept = m.end()
            number += 1
        if i not in lines:
            new = "".join(left) + line[kept:]
            if not kept or new.strip(" \t\v\f\r"):
                out.append(new)
    return "\n".join(out)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the repeated paragraphs and passages; line feeds go with the lines they end.

    Rows whose key is null, and rows without repeats, are left as they are; further columns may have any names.
    """
    k, gone, cuts = common.fresh(df.columns, "gone_key", "gone_lines", "gone_runs")
    found = find_repeats(df, key, text).where(F.col("removed") & common.col(key).isNotNull())
    lines = F.collect_set(F.when(F.col("first_word").isNull(), F.struct("paragraph", "n_lines"))).alias(gone)  # both are bounded by a text's length
    passages = F.collect_set(F.when(F.col("first_word").isNotNull(), F.struct("first_word", "n_words"))).alias(cuts)
    names = df.columns
    wide = df.join(found.groupBy(common.col(key).alias(k)).agg(lines, passages), common.col(key) == F.col(k), "left").drop(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            new = []
            for t, whole, some in zip(*(batch.column(c).to_pylist() for c in (text, gone, cuts)), strict=True):
                own = {at for x in whole or () for at in range(x["paragraph"], x["paragraph"] + x["n_lines"])}
                new.append(without(t, own, [(x["first_word"], x["n_words"]) for x in some or ()]) if t and (own or some) else t)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return wide.mapInArrow(run, df.schema)
