"""Operator 2: token counts by a linear longest-match automaton.

Greedy word-piece splitting takes the longest vocabulary entry that starts the
word, then the longest continuation entry, and so on.  The vocabulary's trie gets
a failure link per node: where matching goes on after the pieces that are then
certain have been popped (Song et al., "Fast WordPiece tokenization").  For counts
the popped pieces themselves are not needed, so each node holds only how many
there are, and a word costs one step a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

WORDS_KEPT = 400_000
#: Entries a broadcast vocabulary may hold.
MAX_ENTRIES = 2_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Matcher:
    """initial: entries that start a word; inner: entries that continue one."""

    def __init__(self, initial: set[str], inner: set[str]) -> None:
        self.children: list[dict[str, int]] = [{}, {}]  # node 0 starts a word, node 1 continues one
        ends = [False, False]
        for root, entries in ((0, initial), (1, inner)):
            for entry in sorted(entries):
                node = root
                for c in entry:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        ends.append(False)
                    node = self.children[node][c]
                ends[node] = ends[node] or bool(entry)
        self.fail = [-1] * len(self.children)
        self.pops = [0] * len(self.children)
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.children[u].items():
                    below.append(v)
                    if ends[v]:
                        self.fail[v], self.pops[v] = 1, 1
                        continue
                    z, n = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.children[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.children[z][c], n
            level = below

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it can't be split."""
        node, n = 0, 0
        children, fail, pops = self.children, self.fail, self.pops
        for c in word:
            while (to := children[node].get(c, -1)) < 0:
                if fail[node] < 0:
                    return -1
                n += pops[node]
                node = fail[node]
            node = to
        while node > 1:
            if fail[node] < 0:
                return -1
            n += pops[node]
            node = fail[node]
        return n


def count_pieces(df: DataFrame, initial: set[str], inner: set[str], text: str = "text") -> DataFrame:
    """``df`` without ``text``, with the long columns n_words, n_pieces and n_unknown.

    Words are runs of anything but ASCII spaces; a word that can't be split counts as
    one unknown piece.  Null texts count as empty.  Existing columns of the new
    names are replaced.  Rows are independent, so repeated ones get equal counts, and nothing is
    shuffled; texts of any length are counted whole; an empty table gives an empty one.
    """
    if len(initial) + len(inner) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries")
    shared = df.sparkSession.sparkContext.broadcast((frozenset(initial), frozenset(inner)))
    new = ("n_words", "n_pieces", "n_unknown")
    kept = [c for c in df.columns if c not in (*new, text)]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} bigint" for c in new])
    source = df.select(*[f"`{c}`" for c in [*kept, text]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*map(set, shared.value))
        known: dict[str, int] = {}
        for batch in common.steps(batches, text):
            rows = []
            for t in common.strings(batch.column(text)).to_pylist():
                words = _WORD.findall(t)
                for w in set(words).difference(known):
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                        known.update((x, matcher.count(x)) for x in set(words))
                        break
                    known[w] = matcher.count(w)
                counts = np.array([known[w] for w in words], dtype=np.int64)
                unknown = int((counts < 0).sum())
                rows.append((len(words), int(counts.sum()) + 2 * unknown, unknown))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {c: pa.array(x, pa.int64()) for c, x in zip(new, columns, strict=True)})

    return source.mapInArrow(run, schema)


def sentence_pieces(path: str) -> tuple[set[str], set[str]]:
    """The initial and inner entries of a sentencepiece vocabulary: those with its word mark, and the others."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p[1:] for p in pieces if p.startswith("\u2581")} - {""}, {p for p in pieces if not p.startswith("\u2581")}
