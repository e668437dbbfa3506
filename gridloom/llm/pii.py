r"""Operator 6: personal data by base patterns and a semi-Markov conditional random field.

The base patterns are exact, but a greedy match that fails its check takes what it
covers with it.  The field adds what they miss: it scores whole candidate segments
(shape, digit groups, checksum, surroundings) and each entity's kind by that of the entity
before it, and dynamic programming over segments of at most ``MAX_ATOMS`` atoms picks
boundaries and types together.  It looks at every
stretch of text that holds enough digits, an ``@``, a long mixed word or a secret's name
with ``=`` or a quoted value; elsewhere no
segment can be an entity, so the best labelling is empty there.

The weights are trained here, by maximum likelihood with forward-backward sums, on
``TRAINING`` made-up sentences from a fixed seed, which bounds both time and size.  A
segment of several words has at most ``MAX_ATOMS`` atoms and ``MAX_CHARS`` characters; long
stretches are labelled in pieces that overlap by more than that.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
TRAINING = 400
MAX_ATOMS, MAX_CHARS = 24, 120
#: No number of any kind has more digits.
MOST_DIGITS = 20
Span = tuple[str, int, int]

# Fixed values of the contract.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The pattern of an ip is [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+); _ips finds its matches in runs of these characters.
_DOTTED = re.compile(r"[0-9.]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_EMAIL_CHARS = frozenset(string.ascii_letters + string.digits + "._%+-@")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, which stay within a run of its characters; only runs with an @ are searched."""
    at, done = text.find("@"), 0
    while at >= 0:
        low, high = at, at
        while low > done and text[low - 1] in _EMAIL_CHARS:
            low -= 1
        while high < len(text) and text[high] in _EMAIL_CHARS:
            high += 1
        run, place = text[low:high], 0
        while (sign := run.find("@", place)) >= 0:
            m = _EMAIL.match(run, place) if sign > place else None
            if m is None:
                # Nothing that starts before this sign matches: what is left of it is one run without a sign.
                place = sign + 1
                continue
            yield low + m.start(), low + m.end()
            place = m.end()
        done = high
        at = text.find("@", high)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the ip pattern, in time linear in the text: four groups of digits with one dot between."""
    for run in _DOTTED.finditer(text):
        parts = run[0].split(".")
        if len(parts) < 4:
            continue
        at, have = run.start(), 0
        first = at
        for part in parts:
            if not part:
                have = 0
            else:
                first, have = (first, have + 1) if have else (at, 1)
                if have == 4:
                    yield first, at + len(part)
                    have = 0
            at += len(part) + 1


def base_spans(text: str) -> list[Span]:
    """The base patterns' matches by kind and start; matches that fail their check are dropped."""
    out: list[Span] = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    out += [("ip", a, b) for a, b in _ips(text) if octets(text[a:b].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# A segment begins and ends beside white space or a sign, so no entity ends inside a run of these characters.
_ATOM = re.compile(r"(?:[^\W\d_]|[0-9_-])+|\s+|.", re.DOTALL)
_BEFORE, _AFTER = frozenset("\"'(<[{=:,;|*#$%&"), frozenset("\"')>]}.,;:!?|*#$%&")
_MARK = re.compile(r"[0-9@]")
_LONG = re.compile(r"[A-Za-z0-9_-]{10,}")
_OTHER = re.compile(r"[^0-9 .()+-]")
_NAMED = re.compile(r"(?<![A-Za-z])(?:password|passwd|secret|token|api_?key|key|api)[\"']?\s{0,3}(?:=\s{0,3}[\"']?|:\s{0,3}[\"'])([A-Za-z0-9_-]{8,})", re.IGNORECASE)


def _collapse(text: str, counted: bool) -> str:
    out: list[str] = []
    for m in re.finditer(r"[0-9]+|[A-Z]+|[^\W\d_]+|.", text, re.DOTALL):
        c = m[0][0]
        if c.isdigit():
            out.append(f"9{min(len(m[0]), 20)}" if counted else "9")
        else:
            out.append("A" if "A" <= c <= "Z" else "a" if c.isalpha() else c)
    return "".join(out)[:40]


class Window:
    """A stretch of text, its atoms and its candidate segments, each with its features."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.ends = [m.end() for m in _ATOM.finditer(text)]
        self.starts = [0, *self.ends[:-1]]
        n = len(self.ends)
        atom = [text[a:b] for a, b in zip(self.starts, self.ends, strict=True)]
        begin = [not a.isspace() and (i == 0 or atom[i - 1].isspace() or atom[i - 1] in _BEFORE) for i, a in enumerate(atom)]
        end = [not a.isspace() and (i == n - 1 or atom[i + 1].isspace() or atom[i + 1] in _AFTER) for i, a in enumerate(atom)]
        self.n = n
        named = {m.end() for m in _NAMED.finditer(text)}
        # Running counts over atoms: digits, dots, signs of an address, long words with digits, and what no number has.
        count = lambda of: [0, *accumulate(map(of, atom))]
        digits, dots, signs = count(lambda a: sum(c in string.digits for c in a)), count(lambda a: a == "."), count(lambda a: a == "@")
        long = count(lambda a: len(a) >= 10 and _LONG.search(a) is not None and _MARK.search(a) is not None)
        other, spaces = count(lambda a: _OTHER.search(a) is not None), count(str.isspace)
        self.segments: list[tuple[int, int]] = []
        self.features: list[list[str]] = []
        #: (first atom, its segments, their ends)
        self.by_start: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i in range(n):
            if not begin[i]:
                continue
            first = len(self.segments)
            for j in range(i, min(n, i + MAX_ATOMS)):
                if "\n" in atom[j] or j > i and self.ends[j] - self.starts[i] > MAX_CHARS:  # one atom can have any length
                    break
                if j > i and spaces[j + 1] > spaces[i] and other[j + 1] > other[i]:  # of several words only numbers are one entity
                    break
                have = digits[j + 1] - digits[i]
                if other[j + 1] == other[i] and have > MOST_DIGITS:  # longer ones are no number of any kind either
                    break
                if not end[j]:
                    continue
                if have >= 7 or dots[j + 1] - dots[i] >= 3 and have >= 4 or signs[j + 1] > signs[i] or long[j + 1] > long[i] or self.ends[j] in named:
                    self.segments.append((i, j + 1))
                    self.features.append(self._features(text[self.starts[i] : self.ends[j]], self.starts[i], self.ends[j]))
            if len(self.segments) > first:
                own = np.arange(first, len(self.segments))
                self.by_start.append((i, own, np.array([e for _, e in self.segments[first:]])))

    def _features(self, span: str, start: int, end: int) -> list[str]:
        digits = "".join(c for c in span if c in string.digits)
        letters = sum(c.isalpha() for c in span)
        parts = span.split(".")
        number = not re.search(r"[^0-9 -]", span)
        checks = number and 13 <= len(digits) <= 19 and luhn(digits)
        quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts) and octets(parts)
        words = self.text[:start].split()
        before = _collapse(words[-1].lower(), False).strip("\"':") if words else ""
        left = self.text[start - 1] if start else " "
        right = self.text[end] if end < len(self.text) else " "
        shape, hexes = _collapse(span, False), not re.search(r"[^0-9a-f]", span)
        name = re.match(r"[A-Za-z]*", words[-1])[0].lower() if words else ""  # type: ignore[index]
        own = re.match(r"[A-Za-z_]*[=:]", span)
        runs = max(map(len, re.findall(r"[A-Za-z0-9_]+", span)), default=0)
        return [
            "bias", f"shape {shape}", f"counts {_collapse(span, True)}", f"digits {min(len(digits), 20)}", f"signs {span.count('@')} {min(span.count('.'), 5)}",
            f"checks {checks} {number} {len(digits) >= 13}", f"quad {quad} {len(parts) == 4}", f"plus {span[0] == '+'} {8 <= len(digits) <= 15}", f"length {min(len(span) // 4, 12)}",
            f"mixed {bool(letters)} {bool(digits)} {hexes}", f"spaces {min(span.count(' '), 5)}", f"left {'w' if left.isalnum() else left}", f"right {'w' if right.isalnum() else right}",
            f"before {name if name in _SECRET_NAMES else bool(name)}", f"own {own[0].lower() if own else ''}", f"first {span[:4] if span[:4].isalpha() and span[:4].isupper() else ''}",
            f"runs {min(runs // 4, 8)} {bool(letters) and bool(digits)}", f"last {span[-1] if not span[-1].isalnum() else 'w'}",
        ]


_SECRET_NAMES = ("password", "passwd", "secret", "token", "key", "apikey", "api")


class Field:
    """Feature weights by kind, weights of a kind after another (last row: after none), and the sums and maxima over all segmentations of a window."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, after: np.ndarray) -> None:
        self.names, self.weights, self.after = names, weights, after

    def scores(self, window: Window) -> np.ndarray:
        out = np.zeros((len(window.segments), len(KINDS)))
        for k, features in enumerate(window.features):
            out[k] = self.weights[[i for f in features if (i := self.names.get(f, -1)) >= 0]].sum(axis=0)
        return out

    def best(self, window: Window) -> list[Span]:
        """The best segmentation's entities, in the window's characters."""
        if not window.segments:
            return []
        scores, none = self.scores(window), len(KINDS)
        # An entity changes what the next one is worth by ``swing`` at most.
        swing = float((self.after.max(axis=0) - self.after.min(axis=0)).max())
        by_end: dict[int, list[int]] = {}
        for k in np.flatnonzero((scores + self.after.max(axis=0)).max(axis=1) + swing > 0).tolist():
            by_end.setdefault(window.segments[k][1], []).append(k)
        if not by_end:
            return []
        value = np.full((window.n + 1, none + 1), -np.inf)
        value[0, none] = 0.0
        choice: list[dict[int, tuple[int, int]]] = [{} for _ in range(window.n + 1)]
        for j in range(1, window.n + 1):
            value[j] = value[j - 1]
            for k in by_end.get(j, ()):
                ways = value[window.segments[k][0]][:, None] + self.after
                before = ways.argmax(axis=0)
                total = ways[before, np.arange(none)] + scores[k]
                for kind in np.flatnonzero(total > value[j, :none]).tolist():
                    value[j, kind], choice[j][kind] = total[kind], (k, int(before[kind]))
        out, j, state = [], window.n, int(value[window.n].argmax())
        while j:
            if state not in choice[j]:
                j -= 1
                continue
            k, before_ = choice[j][state]
            i, end = window.segments[k]
            out.append((KINDS[state], window.starts[i], window.ends[end - 1]))
            j, state = i, before_
        return out[::-1]

    def marginals(self, window: Window, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each candidate segment with each kind, and the expected number of each kind after each."""
        n, none = window.n, len(KINDS)
        weight, after = np.exp(scores), np.exp(self.after)
        forward, backward = np.zeros((n + 1, none + 1)), np.zeros((n + 1, none + 1))
        forward[0, none] = backward[n] = 1.0
        starts = {i: (own, ends) for i, own, ends in window.by_start}
        enter = np.zeros((n + 1, none))
        for i in range(n):
            forward[i + 1] += forward[i]
            if i in starts:
                own, ends = starts[i]
                enter[i] = forward[i] @ after
                forward[ends, :none] += enter[i] * weight[own]
        leave = np.zeros_like(scores)
        pairs = np.zeros_like(after)
        for i in range(n - 1, -1, -1):
            backward[i] = backward[i + 1]
            if i in starts:
                own, ends = starts[i]
                leave[own] = weight[own] * backward[ends, :none]
                all_ = leave[own].sum(axis=0)
                backward[i] += after @ all_
                pairs += forward[i][:, None] * after * all_
        total = forward[n].sum()
        of = np.array([i for i, _ in window.segments], dtype=np.int64)
        return enter[of] * leave / total, pairs / total


#: What often follows in made-up sentences: contacts, routes, payments, accounts.
_COMPANION = {"email": "phone", "phone": "email", "ip": "ip", "card": "email", "secret": "ip"}


def made_up(seed: int, n: int) -> list[tuple[str, list[Span]]]:
    """Sentences of invented words with entities and look-alikes, and where the entities are."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "ou", "ie", "st", "re", "on", "la", "ci", "é", "ü", "sch", "ment"]) for _ in range(r.randint(1, 4)))
    digits = lambda k: "".join(r.choice(string.digits) for _ in range(k))
    of = lambda letters, k: "".join(r.choice(letters) for _ in range(k))

    def card(k: int = 16) -> str:
        body = r.choice("3456") + digits(k - 2)
        number = next(body + c for c in string.digits if luhn(body + c))
        sep = r.choice(["", "", "", " ", "-"])
        return sep.join(number[i : i + 4] for i in range(0, k, 4)) if sep else number

    def entity(kind: str) -> str:
        if kind == "email":
            name = of(string.ascii_lowercase, r.randint(2, 9)) + r.choice(["", "." + digits(2), "_" + of(string.ascii_lowercase, 3)])
            host = of(string.ascii_lowercase, r.randint(3, 7)) + r.choice(["", digits(1)])
            return f"{name}@{host}.{r.choice(['example.com', 'com', 'org', 'example.net', 'de'])}"
        if kind == "ip":
            return ".".join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            return card()
        if kind == "phone":
            return r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(6)}", f"+1-{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}"])
        return r.choice([f"password={of('0123456789abcdef', r.randint(10, 24))}", f"AKIA{of(string.ascii_uppercase + string.digits, 16)}", of("0123456789abcdef", r.choice([20, 32, 40, 64])), f"ghp_{of(string.ascii_letters + string.digits, 36)}"])

    def lookalike() -> str:
        return r.choice([
            "CC BY-NC 4.0.", "Version 2.0.", "version 3.", digits(r.randint(1, 6)), f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(1)}.{digits(1)}.{digits(2)}",
            f"{digits(3)},{digits(3)}", digits(r.randint(7, 12)), f"@{word()}", word().upper() + digits(3), f"{digits(2)}%", f"${digits(3)}.{digits(2)}", f"{digits(1)} {digits(2)} {digits(3)}", f"{word()}{digits(2)}",
            str(int(card(16).replace(" ", "").replace("-", "")) + 1), ".".join([digits(3), "999", digits(3), digits(3)]), f"page={digits(3)}", digits(r.randint(17, 24)) + "7",
        ])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(2, 4)):
            text += " ".join(word() for _ in range(r.randint(0, 3))) + " "
            kind = ""
            for _ in range(r.choice([1, 1, 1, 2])):
                if r.random() < 0.62:
                    kind = _COMPANION[kind] if kind and r.random() < 0.5 else r.choice(KINDS)
                    value = entity(kind)
                    lead = ""
                    if kind == "secret" and "=" not in value and r.random() < 0.5:
                        lead = r.choice(['token = "', 'api_key = "', 'secret: "', 'key="'])
                    text += lead
                    spans.append((kind, len(text), len(text) + len(value)))
                    text += value + ('"' if lead else "") + r.choice(["", "", "", ".", ",", "###", "$$$"])
                else:
                    text += lookalike()
                text += " "
        out.append((text.rstrip(), spans))
    return out


@lru_cache(maxsize=1)
def trained(seed: int = 11, rounds: int = 14) -> Field:
    """The field, fitted by AdaGrad steps on the exact gradient of the log-likelihood."""
    examples = [(Window(text), spans) for text, spans in made_up(seed, TRAINING)]
    names: dict[str, int] = {}
    for window, _ in examples:
        for features in window.features:
            for f in features:
                names.setdefault(f, len(names))
    none = len(KINDS)
    field = Field(names, np.zeros((len(names), none)), np.zeros((none + 1, none)))
    ready = []
    for window, spans in examples:
        gold = {(s, e): KINDS.index(kind) for kind, s, e in spans}
        target, follows = np.zeros((len(window.segments), none)), np.zeros((none + 1, none))
        before = none
        for _, s, e in sorted(spans, key=lambda x: x[1]):
            follows[before, gold[s, e]] += 1
            before = gold[s, e]
        for k, (i, j) in enumerate(window.segments):
            kind = gold.pop((window.starts[i], window.ends[j - 1]), None)
            if kind is not None:
                target[k, kind] = 1.0
        if gold:
            raise ValueError(f"no candidate for {gold} of {window.text!r}")
        if not window.segments:
            continue
        ids = np.array([[names[f] for f in x] for x in window.features])
        order_ = np.argsort(ids, axis=None, kind="stable")
        own, at = np.unique(ids.ravel()[order_], return_index=True)
        ready.append((window, ids, own, at, order_ // ids.shape[1], target, follows))
    seen, seen_after = np.full(field.weights.shape, 1e-2), np.full(field.after.shape, 1e-2)
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(ready)
        for window, ids, own, at, row, target, follows in ready:
            found, pairs = field.marginals(window, field.weights[ids].sum(axis=1))
            gradient = np.add.reduceat((target - found)[row], at, axis=0)
            gradient -= 1e-3 * field.weights[own]
            seen[own] += gradient**2
            field.weights[own] += 0.4 * gradient / np.sqrt(seen[own])
            step = follows - pairs - 1e-3 * field.after
            seen_after += step**2
            field.after += 0.1 * step / np.sqrt(seen_after)
    return field


def stretches(text: str, context: int = 40, join: int = 30) -> Iterator[tuple[int, int]]:
    """Where entities can be: marks at most ``join`` characters apart, with their words and some before.

    Needs seven digits, an @, a long word with digits or one after a secret's name; fewer marks can't make an entity.
    """
    marks = [m.start() for m in _MARK.finditer(text)]
    named = {m.start(1) for m in _NAMED.finditer(text)}
    if named:
        marks = sorted({*marks, *named})
    i = 0
    while i < len(marks):
        j = i
        while j + 1 < len(marks) and marks[j + 1] - marks[j] <= join:
            j += 1
        low, high = marks[i], marks[j] + 1
        while low > 0 and marks[i] - low < MAX_CHARS and not text[low - 1].isspace():
            low -= 1
        while high < len(text) and high - marks[j] < MAX_CHARS and not text[high].isspace():
            high += 1
        if j - i >= 6 or named and any(m in named for m in marks[i : j + 1]) or "@" in text[low:high] or any(_MARK.search(w) for w in _LONG.findall(text[low:high])):
            start = max(0, low - context)
            while start > 0 and low - start < 2 * context and not text[start - 1].isspace():
                start -= 1
            yield start, min(len(text), high + 1)
        i = j + 1


#: Characters of a stretch that are labelled at once.
PIECE = 4000


def _labelled(text: str, low: int, high: int, field: Field) -> Iterator[Span]:
    """The field's spans in a stretch.

    A longer stretch is labelled in pieces: of each but the last only spans that end well before its
    end are taken, and the next one begins before the first that isn't, with some text before it.
    """
    done = low
    while True:
        end = min(high, max(done, low) + PIECE)
        start = max(low, done - MAX_CHARS)
        found = [(k, s + start, e + start) for k, s, e in field.best(Window(text[start:end])) if s + start >= done]
        sure = end - 2 * MAX_CHARS
        taken = found if end == high else [x for x in found if x[2] <= sure]
        yield from taken
        if end == high:
            return
        later = [s for _, s, e in found if e > sure]
        next_ = min([sure, *later])
        if next_ <= done:  # one span over the whole piece
            yield from [x for x in found if x not in taken]
            next_ = end
        done = max([next_, *(e for _, _, e in taken)])


def all_spans(text: str, field: Field, base: list[Span] | None = None) -> list[Span]:
    """Base spans, and the field's spans that touch none of them, by kind and start."""
    found = base_spans(text) if base is None else base
    taken = sorted((s, e) for _, s, e in found)
    added: list[Span] = []
    for low, high in stretches(text):
        if added and added[-1][2] > low:
            low = added[-1][2]
        added += _labelled(text, low, high, field)
    free = [(k, s, e) for k, s, e in added if all(e <= a or b <= s for a, b in taken)]
    return sorted([*found, *free], key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the first one's kind in brackets."""
    out, at, until = [], 0, 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s < until:
            if e > until:
                until = at = e
            continue
        out += (text[at:s], f"[{kind.upper()}]")
        at = until = e
    out.append(text[at:])
    return "".join(out)


COLUMNS = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with base counts, the base spans' digest and all spans.

    Spans are in code points, end exclusive.  Null texts count as empty.  Columns of the
    new names are replaced.  Rows are independent, so repeated ones get equal results, and
    nothing is shuffled; texts are searched whole, in time linear in their length; an empty table
    gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(trained())
    kept = [c for c in df.columns if c not in (*COLUMNS, text)]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {'bigint' if c[1] == '_' else 'string'}" for c in COLUMNS])
    source = df.select(*[common.col(c) for c in [*kept, text]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            rows = []
            for t in common.strings(batch.column(text)).to_pylist():
                base = base_spans(t)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE]
                rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(all_spans(t, shared.value, base))))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = zip(COLUMNS, zip(*rows, strict=True), kinds, strict=True)
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in kept} | {c: pa.array(x, k) for c, x, k in columns})

    return source.mapInArrow(run, schema)


def mask_pii(df: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``df`` with all spans of ``text`` replaced by their kind in brackets; ``length`` names a column of its code points.

    Null texts stay null.  All other columns are passed on as they are, whatever their names;
    rows are independent, texts are masked whole, and an empty table gives an empty one.
    """
    shared = df.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, text):
            new = [t if t is None else mask(t, all_spans(t, shared.value)) for t in batch.column(text).to_pylist()]
            columns = {c: batch.column(c) for c in batch.schema.names} | {text: pa.array(new, pa.string())}
            if length is not None:
                was = batch.column(length).to_pylist()
                columns[length] = pa.array([n if t is None else len(t) for n, t in zip(was, new, strict=True)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, df.schema)
