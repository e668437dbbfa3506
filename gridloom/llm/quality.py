"""Operator 4: document quality by weak supervision.

Each rule votes good or bad, or abstains.  A two-class latent model says how often a
rule votes bad on a good and on a bad document; expectation-maximisation estimates
both, and the share of good documents, from all votes without labels.  A document
is kept if its posterior probability of being good reaches a half.  So one rule's
failure weighs as much as the corpus shows that it should, in place of a filter that
wants all rules passed.

The vote patterns, at most 3 to the number of rules, are counted over all documents;
only these counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StructField, StructType

from . import common, textnp

GOOD, ABSTAIN, BAD = 0, 1, 2
#: name: votes good below the first bound and bad above the second, abstains between.
RULES = {
    "symbols_per_word": (0.05, 0.20),
    "symbol_endings": (0.05, 0.20),
    "symbol_runs": (0.05, 0.20),
    "caps_words": (0.10, 0.50),
    "exclamations_per_word": (0.10, 0.50),
    "repeated_windows": (0.05, 0.20),
    "repeated_neighbours": (0.02, 0.20),
    "few_distinct_words": (0.60, 0.80),
    "duplicate_lines": (0.05, 0.30),
    "bars_per_word": (0.05, 0.20),
    "words_without_letters": (0.15, 0.35),
}
#: The most that a rule is taken to catch, so that no rule's vote for good outweighs several for bad.
MOST_CAUGHT = 0.9
WINDOW = 8
_LINE_SPACE = " \t\n\v\f\r"
# Fixed value of the contract.
SYMBOLS = b"#*$%&|<>"


def duplicate_lines(text: str) -> tuple[int, int]:
    """Lines that hold a word and equal an earlier line; lines that hold a word."""
    seen: set[str] = set()
    lines = 0
    for line in text.split("\n"):
        if line.strip(_LINE_SPACE):
            lines += 1
            seen.add(line)
    return lines - len(seen), lines


def _per_word(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ends] - total[starts]


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts for each text of a string column without nulls."""
    buf, offsets = common.utf8(column)
    n = len(column)
    starts, ends, rows = textnp.spans(buf, offsets)
    by_row = lambda x: np.bincount(rows, weights=x, minlength=n).astype(np.int64)
    points = (buf & 0xC0) != 0x80
    word_points = _per_word(points, starts, ends)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    accented = np.zeros(len(buf), dtype=bool)
    accented[1:] = buf[:-1] == 0xC3
    upper = _per_word((buf >= 65) & (buf <= 90) | accented & (buf >= 0x80) & (buf <= 0x9E), starts, ends)
    small = _per_word((buf >= 97) & (buf <= 122) | accented & (buf >= 0x9F), starts, ends)
    pairs = np.zeros(len(buf), dtype=bool)
    pairs[1:] = symbol[buf[1:]] & (buf[1:] == buf[:-1]) & ~textnp.SPACE[buf[:-1]]
    letters = _per_word((buf >= 65) & (buf <= 90) | (buf >= 97) & (buf <= 122) | (buf >= 0xC3), starts, ends)
    words = textnp.hashes(buf, starts, ends)
    found, first, of = textnp.windows(words, rows, WINDOW)
    repeated = np.zeros(len(words) + 1, dtype=np.int64)
    if len(found):
        key = textnp.mix(found ^ textnp.mix(of.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(repeated, first[twice], 1)
        np.add.at(repeated, first[twice] + WINDOW, -1)
    neighbours = np.zeros(len(words), dtype=bool)
    if len(words) > 1:
        neighbours[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    bounds = np.searchsorted(rows, np.arange(n + 1))
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], dtype=np.int64)
    lines = np.array([duplicate_lines(t) for t in column.to_pylist()], dtype=np.int64).reshape(-1, 2)
    return {
        "n_words": np.bincount(rows, minlength=n).astype(np.int64),
        "word_chars": by_row(word_points),
        "n_symbols": by_row(_per_word(symbol[buf], starts, ends)),
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": by_row(np.cumsum(repeated)[:-1] > 0),
        "lines": lines[:, 1],
        "caps": by_row((upper >= 1) & (small == 0) & (word_points >= 2)),
        "exclamations": by_row(_per_word(buf == 33, starts, ends)),
        "neighbours": by_row(neighbours),
        "distinct": distinct,
        "bars": by_row(_per_word(buf == 124, starts, ends)),
        "letterless": by_row(letters == 0),
        "endings": by_row(symbol[buf[ends - 1]] & (letters > 0)),
        "runs": by_row(_per_word(pairs, starts, ends) > 0),
    }


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    # Fixed values of the contract.
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """One row of votes per document, in the order of ``RULES``; a document without words abstains on shares."""
    n = np.maximum(f["n_words"], 1)
    value = {
        "symbols_per_word": f["n_symbols"] / n, "caps_words": f["caps"] / n, "exclamations_per_word": f["exclamations"] / n,
        "repeated_windows": f["n_repeat_words"] / n, "repeated_neighbours": f["neighbours"] / n,
        "few_distinct_words": 1 - f["distinct"] / n,
        "duplicate_lines": f["n_dup_lines"] / np.maximum(f["lines"], 1), "bars_per_word": f["bars"] / n, "words_without_letters": f["letterless"] / n,
        "symbol_endings": f["endings"] / n, "symbol_runs": f["runs"] / n,
    }
    out = np.full((len(n), len(RULES)), ABSTAIN, dtype=np.int64)
    for j, (name, (low, high)) in enumerate(RULES.items()):
        out[:, j][value[name] < low] = GOOD
        out[:, j][value[name] > high] = BAD
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> dict[str, Any]:
    """EM over vote patterns and how many documents have each.

    Starts from rules that are seldom wrong on good documents and catch some bad ones,
    which also says which of the two classes is the bad one.  Pseudo-counts keep every
    rate away from 0 and 1; a rule's vote for bad never speaks for good.
    """
    bad, voted = patterns == BAD, patterns != ABSTAIN
    rules = patterns.shape[1]
    false, caught, good = np.full(rules, 0.01), np.full(rules, 0.3), 0.9
    total = max(float(counts.sum()), 1.0)
    for _ in range(rounds):
        p = posterior(patterns, false, caught, good)
        w, v = counts * p, counts * (1 - p)
        was = np.concatenate([false, caught, [good]])
        good = float(np.clip((w.sum() + 9) / (total + 10), 0.5, 0.999))
        false = (w @ bad + 0.1) / (w @ voted + 10)
        caught = np.clip((v @ bad + 3) / (v @ voted + 10), false, MOST_CAUGHT)
        if np.abs(np.concatenate([false, caught, [good]]) - was).max() < 1e-9:
            break
    return {"good": good, "false": false, "caught": caught}


def posterior(patterns: np.ndarray, false: np.ndarray, caught: np.ndarray, good: float) -> np.ndarray:
    """The probability of being good, for each row of votes."""
    bad, fine = patterns == BAD, patterns == GOOD
    odds = np.log(good / (1 - good)) + bad @ np.log(false / caught) + fine @ np.log((1 - false) / (1 - caught))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, text: str, added: list[str], counts: bool) -> DataFrame:
    """All columns of ``df`` and, under the names ``added``, the base counts (if wanted), whether the base filter fails, and the vote pattern as one number, base 3."""
    names = df.columns
    kinds = ["bigint"] * len(MEASURED) * counts + ["boolean", "int"]
    schema = StructType([*df.schema.fields, *[StructField(n, _parse(k)) for n, k in zip(added, kinds, strict=True)]])
    places = 3 ** np.arange(len(RULES))
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            f = features(common.strings(batch.column(at)))
            new = [pa.array(f[c], pa.int64()) for c in MEASURED] if counts else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array(base_failed(f)), pa.array(votes(f) @ places, pa.int32())], names=[*names, *added])

    return df.mapInArrow(run, schema)


def _parse(kind: str) -> DataType:
    return {"bigint": LongType(), "boolean": BooleanType(), "int": IntegerType()}[kind]


def model(measured: DataFrame) -> tuple[dict[str, Any], DataFrame]:
    """The estimated model, and the posterior of each pattern that occurs (3 to the number of rules at most).

    Documents that fail the base filter are decided already and are not counted.
    """
    spark = measured.sparkSession
    rows = sorted((r["pattern"], r["n"]) for r in measured.where("NOT base_failed").groupBy("pattern").agg(F.count("*").alias("n")).collect())
    codes = np.array([p for p, _ in rows], dtype=np.int64)
    patterns = codes[:, None] // 3 ** np.arange(len(RULES)) % 3
    fitted = estimate(patterns, np.array([n for _, n in rows], dtype=np.float64))
    p = posterior(patterns, fitted["false"], fitted["caught"], fitted["good"])
    return fitted, spark.createDataFrame([(int(c), float(x)) for c, x in zip(codes, p, strict=True)], "pattern int, posterior double")


def judge_quality(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, the base counts, ``base_failed``, ``posterior`` (null if base_failed) and ``kept`` for every row.

    Null texts count as empty, which fails the base filter.  Null keys, repeated rows and
    ties are no matter: rows are judged one by one, by what all rows' votes say; a posterior of
    exactly a half keeps.  Texts are measured whole, however long.  An empty table gives an
    empty one; columns but ``key`` and ``text`` are left out.  ``df`` is read once; its counts are
    written to the checkpoint folder.
    """
    rows = df.select(common.col(key).alias("key"), common.col(text).alias("text"))
    measured = common.cut(measure(rows, "text", [*MEASURED, "base_failed", "pattern"], True).drop("text"))
    _, posteriors = model(measured)
    judged = measured.join(F.broadcast(posteriors), "pattern", "left")  # bounded by the number of patterns
    judged = judged.withColumn("posterior", F.when(~F.col("base_failed"), F.col("posterior")))
    return judged.select(F.col("key").alias(key), *MEASURED, "base_failed", "posterior", (~F.col("base_failed") & (F.coalesce("posterior", F.lit(0.0)) >= 0.5)).alias("kept"))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``judge_quality`` keeps, with all columns, whatever their names.

    Null and empty texts fail the base filter and go; an empty table gives an empty one;
    repeated rows share their fate.  The texts are read twice, never shuffled or written.
    """
    votes_only = measure(df.select(common.col(text).alias("text")), "text", ["base_failed", "pattern"], False).drop("text")
    _, posteriors = model(votes_only)
    failed, pattern, good = common.fresh(df.columns, "base_failed", "pattern", "good_pattern")
    kept = posteriors.where("posterior >= 0.5").select(F.col("pattern").alias(good))  # bounded by the number of patterns
    measured = measure(df, text, [failed, pattern], False).where(~F.col(failed))
    return measured.join(F.broadcast(kept), F.col(pattern) == F.col(good), "left_semi").drop(failed, pattern)
