"""Words, shingles, BPE, piece counts, token files and chat formatting."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from gridloom.llm import bpe, chat, common, piece_counts, textnp, token_files
from gridloom.llm.tokenizers_io import public_path
from hypothesis import given, settings
from hypothesis import strategies as st

ODD = "abcDEfgh  \t\n\r\x1c\x85 éÉßÀÞµİΣσς日本語🎉'sdt're0123٣½.,!%%|<|endoftext|><|StartOfText|>́\xa0﻿ªº×÷"


def brute_sets(text, size=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or {tuple(words)}


def sets_of(texts):
    return textnp.shingle_sets(*common.utf8(common.strings(pa.array(texts, pa.string()))))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t日", max_size=60), min_size=1, max_size=6))
def test_shingle_sets_are_those_of_the_words(texts):
    sets = sets_of(texts)
    brute = [brute_sets(t) for t in texts]
    assert [len(s) for s in sets] == [len(b) for b in brute]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(brute[i] & brute[j])


def test_steps_cut_rows_and_pass_long_ones():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["a" * 10, None, "b" * 100, "", "c"])})
    parts = list(common.steps(iter([batch, batch.slice(0, 0)]), "text", 20))
    assert sum(p.num_rows for p in parts) == 5 and len(parts) >= 2


@pytest.fixture(scope="module")
def codec():
    with open(public_path("byte_bpe_50k.json"), "rb") as file:
        return bpe.Codec(file.read())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path("byte_bpe_50k.json"))


def test_automaton_gives_the_merges_result_on_toy_vocabularies():
    r = random.Random(5)
    for _ in range(60):
        tokens, merges = {b"a": 0, b"b": 1, b"c": 2}, []
        for _ in range(12):
            a, b = r.choice(list(tokens)), r.choice(list(tokens))
            if a + b not in tokens:
                tokens[a + b] = len(tokens)
                merges.append((a, b))
        machine = bpe.Automaton(tokens, merges)
        for _ in range(60):
            word = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
            parts = [bytes([c]) for c in word]
            for pair in merges:  # every merge in turn, from the left
                i = 0
                while i + 1 < len(parts):
                    if (parts[i], parts[i + 1]) == pair:
                        parts[i : i + 2] = [parts[i] + parts[i + 1]]
                    i += 1
            assert machine.encode(word) == [tokens[p] for p in parts]
            assert b"".join(machine.label[t] for t in machine.encode(word)) == word


def test_codec_equals_the_library(codec, library):
    r = random.Random(6)
    for i in range(1500):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 40))) + ("<|endoftext|>" if i % 7 == 0 else "")
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text).tolist() == ids
        assert codec.decode(np.array(ids, dtype=np.uint32)) == library.decode(ids, skip_special_tokens=False)
    part = codec.encode("日本")[:1]
    assert codec.decode(part) == library.decode(part.tolist(), skip_special_tokens=False)


def test_encode_decode_rows(spark, documents, library):
    df, rows = documents
    clash = df.withColumnRenamed("lang", "n_tokens")
    out = bpe.encode_decode(clash, public_path("byte_bpe_50k.json"), add=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(out) == len(rows)
    for row in out:
        text = row["text"] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and row["decoded"] == text
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), public_path("byte_bpe_50k.json")).count() == 0


def greedy(word, initial, inner):
    at, n = 0, 0
    while at < len(word):
        entries = initial if at == 0 else inner
        end = next((e for e in range(len(word), at, -1) if word[at:e] in entries), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abc", min_size=1, max_size=14), max_size=12))
def test_matcher_counts_greedy_pieces(initial, inner, words):
    matcher = piece_counts.Matcher(initial, inner)
    assert [matcher.count(w) for w in words] == [greedy(w, initial, inner) for w in words]


def test_count_pieces_rows(spark, documents):
    df, rows = documents
    initial, inner = piece_counts.sentence_pieces(public_path("piece_bpe_32k.model"))
    out = piece_counts.count_pieces(df.withColumnRenamed("lang", "n_words"), initial, inner).collect()
    want = []
    for row in rows:
        counts = [greedy(w, initial, inner) for w in re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")]
        want.append((row[0], len(counts), sum(max(c, 1) for c in counts), sum(c < 0 for c in counts)))
    assert sorted(map(str, ((r["doc_id"], r["n_words"], r["n_pieces"], r["n_unknown"]) for r in out))) == sorted(map(str, want))
    assert piece_counts.count_pieces(df.limit(0), initial, inner).count() == 0


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 24, 31, 32])
def test_packed_ids_come_back(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 5, 40_000):
        ids = r.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
        file = token_files.TokenFile(token_files.encode_file([7, -3], [ids[: n // 3], ids[n // 3 :]], width))
        assert (file.read(0, n) == ids).all() and (file.document(1) == ids[n // 3 :]).all() and file.doc_ids.tolist() == [7, -3]
        if n > 30_000:
            assert (file.read(16_000, 33_001) == ids[16_000:33_001]).all()
    with pytest.raises(IndexError):
        file.read(0, n + 1)


def test_file_encoder_equals_the_library():
    with open(public_path("word_bpe_49k.json"), "rb") as file:
        encoder = token_files.Encoder(file.read())
    r = random.Random(8)
    for i in range(1500):
        text = "".join(r.choice(ODD) for _ in range(r.randint(0, 40)))
        text = text.upper() if i % 9 == 0 else text
        assert encoder([text], 1)[0].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_token_files_rows(spark, documents, tmp_path):
    df, rows = documents
    path = public_path("word_bpe_49k.json")
    files = token_files.write_token_files(df, path, str(tmp_path / "files"))
    out = token_files.read_documents(files).collect()
    from tokenizers import Tokenizer

    tokenizer, at, want = Tokenizer.from_file(path), 0, []
    for key, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert token_files.read_documents(token_files.write_token_files(df.limit(0), path, str(tmp_path / "none"))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\:\n#ué", max_size=6), st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "\n", "</tur", "n>", "é日", ": ", "### a: "]), max_size=6).map("".join)), max_size=5))
def test_chat_format_is_reversible(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]


def test_mask_is_the_intersection():
    tokens = np.array([[0, 3], [3, 4], [4, 9], [9, 12]])
    hit, ranges = chat.mask(np.array([[1, 2], [4, 4], [5, 10]]), tokens)
    assert hit.tolist() == [True, False, True, True] and ranges.tolist() == [[1, 2], [5, 10]]


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b é###"), (1, 0, "user", "a\\"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, 3, "assistant", "n"), (None, None, "user", "m"), (3, 0, "user", ""), (1, 1, "assistant", "b é###")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS formatted")
    df = chat.self_check_rows(df)
    out = {r["conv_id"]: r for r in chat.format_chat(df, public_path("byte_bpe_50k.json"), digests=True).collect()}
    assert set(out) == {1, 2, 3, None, -7}
    loss = "b é###" * 2
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[1]["loss_sha256"]) == (4, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    turns = "user\na\\\nassistant\nb é###\nassistant\nb é###\nassistant\n\n"
    assert out[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert out[None]["turns_sha256"] == hashlib.sha256(b"user\nm\nassistant\nn\n").hexdigest()
    assert out[-7]["loss_sha256"] == hashlib.sha256(b"\\### Assistant: </turn> ok").hexdigest()
    full = chat.format_chat(df.where("conv_id = -7"), public_path("byte_bpe_50k.json")).first()
    kept = "".join(chat.unescape(full["formatted"][a:b]) for a, b in zip(full["loss_starts"], full["loss_ends"], strict=True))
    assert kept == "\\### Assistant: </turn> ok" and len(full["ids"]) == len(full["loss_mask"])
    assert chat.format_chat(df.limit(0), public_path("byte_bpe_50k.json")).count() == 0
