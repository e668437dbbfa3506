"""Operator 3: byte-level BPE encoding and decoding by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens.
It starts as one state with a loop for each byte.  The gadget of merge (u, v)
copies the state ``s`` that u-arcs lead to, drops the v-arc from the copy, leads
all u-arcs to the copy, and adds an arc ``uv`` to ``s.v`` beside every u-arc.  What
the finished automaton accepts are exactly the token sequences that applying the
merges in order gives (Berglund, Martens and van der Merwe, "Constructing a BPE
tokenization DFA").  All arcs of one token lead to one state, so a state is named by
the token just read.

Written out, the table of a 50k vocabulary would have 2.5e9 arcs.  A copy is
therefore kept as what distinguishes it from the state it was copied from: the arc
it lost and when (``lost``), with the copied state found by the token's right
part.  ``arc`` answers from these tables.

Encoding a pre-split word fills, position by position, the one token that ends
there in the accepted path; a trie proposes tokens and ``arc`` decides.  Each
position's answer is unique, so this is linear in the word's length for a given
vocabulary.  Decoding emits the bytes that label the arcs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common
from .tokenizers_io import Shared, spec

#: Words and arcs that a worker remembers; older ones are forgotten all at once.
WORDS_KEPT = 400_000
ARCS_KEPT = 600_000
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable Latin-1, else the next from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The compiled merges of a vocabulary of byte strings."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.label = {i: t for t, i in tokens.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}
        self.lost: dict[int, int] = {}
        self._arcs: dict[int, bool] = {}
        for when, (a, b) in enumerate(merges):
            u, v, uv = tokens[a], tokens[b], tokens[a + b]
            if uv in self.made:
                raise ValueError(f"two merges make {a + b!r}")
            if any(len(x) > 1 and tokens[x] not in self.made for x in (a, b)) or not self.arc(u, v):
                continue  # no u-arc is ever followed by a v-arc: the gadget would change nothing
            self._arcs.clear()
            self.lost[u << 32 | v] = when
            self.left[uv], self.right[uv], self.made[uv] = u, v, when
        self.states = 1 + len({k >> 32 for k in self.lost})
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for text, i in tokens.items():
            if len(text) > 1 and i not in self.made:
                continue
            node = 0
            for byte in text:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][byte]
            self.ends[node] = i

    def arc(self, u: int, t: int) -> bool:
        """Whether the state after token u has an arc for token t.

        t's arc was added beside that of its left part, unless that had been
        lost by then, and so on down its left parts.  u's state lost what its own
        gadgets dropped, and what its right part's state had lost when u was made.
        """
        key = u << 32 | t
        known = self._arcs.get(key)
        if known is not None:
            return known
        lost, made = self.lost, self.made
        answer, x, added = True, t, NEVER
        while answer:
            w, copied = u, NEVER
            while True:
                when = lost.get(w << 32 | x)
                if when is not None and when < copied and when <= added:
                    answer = False
                    break
                if w not in made:
                    break
                copied, w = made[w], self.right[w]
            if x not in made:
                break
            added, x = made[x], self.left[x]
        if len(self._arcs) >= ARCS_KEPT:
            self._arcs.clear()
        self._arcs[key] = answer
        return answer

    def encode(self, word: bytes) -> list[int]:
        """The tokens of one pre-split word; every byte must be a token."""
        n = len(word)
        token, before = [-1] * (n + 1), [0] * (n + 1)
        children, ends, arcs = self.children, self.ends, self._arcs
        for start in range(n):
            u, node = token[start], 0
            for at in range(start, n):
                node = children[node].get(word[at], 0)
                if not node:
                    break
                t = ends[node]
                if t >= 0 and token[at + 1] < 0:
                    if start:
                        ok = arcs.get(u << 32 | t)
                        if ok is None:
                            ok = self.arc(u, t)
                        if not ok:
                            continue
                    token[at + 1], before[at + 1] = t, start
        out = []
        while n:
            out.append(token[n])
            n = before[n]
        out.reverse()
        return out


class Codec:
    """Whole texts to ids and back, as a tokenizer file of the byte-level kind says."""

    def __init__(self, data: bytes) -> None:
        file = spec(data)
        model, letters = file["model"], byte_letters()
        # Fixed values of the file format: only what this codec reproduces is accepted.
        pre = file["pre_tokenizer"] or {}
        if model["type"] != "BPE" or file["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE tokenizer file")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("a BPE option is set that this codec lacks")
        raw = {text: bytes(letters[c] for c in text) for text in model["vocab"]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.automaton = Automaton({raw[t]: i for t, i in model["vocab"].items()}, [(raw[a], raw[b]) for a, b in pairs])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("an added token takes its surroundings into account")
        self.label = dict(self.automaton.label)
        for text, i in self.special.items():
            self.label[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        ordered = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, ordered))})") if ordered else None
        # Fixed value: the usual pre-split of byte-level vocabularies, with the Unicode property for white space.
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
        )
        self._known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text; an added token's string becomes its id."""
        if self.cut is None:
            packed = self._plain(text)
        else:
            packed = b"".join(
                self.special[part].to_bytes(4, "little") if i % 2 else self._plain(part)
                for i, part in enumerate(self.cut.split(text))
            )
        return np.frombuffer(packed, dtype="<u4")

    def _plain(self, text: str) -> bytes:
        known, words = self._known, self.words.findall(text)
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = np.array(self.automaton.encode(w.encode()), dtype="<u4").tobytes()
                if len(w) <= 48:
                    if len(known) >= WORDS_KEPT:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text that labels the arcs; bytes that are not UTF-8 become U+FFFD, unknown ids nothing."""
        label = self.label
        return b"".join([label.get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


#: What ``encode_decode`` can add, with Spark's and Arrow's types.
ADDED = {
    "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "n_tokens": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()),
}


def encode_decode(df: DataFrame, tokenizer_path: str, text: str = "text", add: tuple[str, ...] = ("ids", "decoded"), keep_text: bool = True) -> DataFrame:
    """``df`` with columns of ``ADDED`` for every row's whole text; columns of these names are replaced.

    Digests are of the ids as little-endian 32-bit integers and of the decoded text in
    UTF-8, in lowercase hex.  Null texts count as empty: no ids, empty decoded text.
    Repeated rows stay repeated; an empty table gives an empty one; texts of any length are
    encoded whole.  Rows are independent, so nothing is shuffled.
    """
    shared = Shared(df.sparkSession, tokenizer_path)
    kept = [c for c in df.columns if c not in add and (keep_text or c != text)]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {ADDED[c][0]}" for c in add])
    source = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec: Codec = shared.build("codec", Codec)
        for batch in common.steps(batches, text):
            ids = [codec.encode(t) for t in common.strings(batch.column(text)).to_pylist()]
            made: dict[str, Any] = {"ids": ids, "n_tokens": [len(x) for x in ids]}
            if "ids_sha256" in add:
                made["ids_sha256"] = [hashlib.sha256(x.tobytes()).hexdigest() for x in ids]
            if "decoded" in add or "decoded_sha256" in add:
                made["decoded"] = [codec.decode(x) for x in ids]
                made["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in made["decoded"]]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {c: pa.array(made[c], ADDED[c][1]) for c in add})

    return source.mapInArrow(run, schema)
