"""Clashing names, empty tables and texts of a megabyte, operator by operator and for the pipeline."""

from __future__ import annotations

import json

import numpy as np
import pytest
from gridloom.llm import bpe, decontaminate, jaccard_join, pii, piece_counts, quality, substring_dedup, token_files, url_rules
from gridloom.llm.tokenizers_io import public_path

#: Names that operators use inside or give to their results.
NAMES = ("kept", "n_words", "pattern", "base_failed", "posterior", "label", "sid", "uid", "row", "key", "place", "home", "gone_key", "gone_row", "ids", "n_tokens", "spans", "score", "host", "rule", "bucket", "__key")


def words(seed, n, of=10**6):
    r = np.random.default_rng(seed)
    return " ".join(f"m{k}" for k in r.integers(1, of, n))


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with every clashing name, a megabyte of words twice over, a megabyte without a space, nulls and repeats."""
    big = words(1, 130_000)
    assert len(big) > 1_000_000
    texts = [(1, words(2, 60)), (2, words(2, 60)), (3, big), (4, big + " and some more"), (5, "y" * 1_000_000), (6, None), (7, ""), (7, ""), (None, words(3, 80)), (9, words(2, 60)), (9, words(2, 60))]
    rows = [(k, t, len(t or ""), *["x"] * len(NAMES)) for k, t in texts]
    schema = "doc_id bigint, text string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame(rows, schema).repartition(3).persist()


def test_stages_keep_any_columns(spark, docs):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {1, 2, 3, 4, None, 9}
    one = jaccard_join.one_of_each(docs)
    got = [(r["doc_id"], r["label"]) for r in one.select("doc_id", "label").collect()]
    assert one.columns == docs.columns and sorted(got, key=str) == sorted([(1, "x"), (3, "x"), (5, "x"), (6, "x"), (7, "x"), (7, "x"), (None, "x")], key=str)
    items = spark.createDataFrame([(1, words(2, 60)), (2, None)], "item_id bigint, text string")
    left = decontaminate.drop_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == 7
    masked = pii.mask_pii(docs, length="n_chars")
    assert masked.columns == docs.columns and masked.count() == 11
    for stage in (quality.keep_good, pii.mask_pii, lambda d: decontaminate.drop_leaks(d, items)):
        assert stage(docs.limit(0)).count() == 0


def test_repeats_in_megabytes(docs):
    left = substring_dedup.remove_repeats(docs)
    assert left.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in left.select("doc_id", "text").collect()}
    assert len(texts[3]) > 1_000_000 and len(texts[4]) < 100 and texts[2] == "" and texts[9] == "" and texts[6] is None and len(texts[5]) == 1_000_000


def test_keys_of_any_name(spark):
    df = spark.createDataFrame([(1, words(2, 60), "a"), (2, words(2, 60), "b")], "item_id bigint, text string, score string")
    items = spark.createDataFrame([(7, words(2, 60))], "item_id bigint, text string")
    out = decontaminate.find_leaks(df, items, key="item_id")
    assert out.columns == ["row_item_id", "item_id", "score", "question_overlap", "answer_overlap"] and {(r[0], r[1]) for r in out.collect()} == {(1, 7), (2, 7)}
    joined = jaccard_join.join_documents(df.withColumnRenamed("item_id", "row"), key="row").collect()
    assert {tuple(r) for r in joined} == {(1, 56, 1), (2, 56, 1)}
    found = substring_dedup.find_repeats(df.withColumnRenamed("item_id", "place"), key="place").collect()
    assert {(r["place"], r["class_place"], r["removed"]) for r in found} == {(1, 1, False), (2, 1, True)}


def test_text_operators_on_a_megabyte(spark, docs):
    initial, inner = piece_counts.sentence_pieces(public_path("piece_bpe_32k.model"))
    counts = {r["doc_id"]: r["n_words"] for r in piece_counts.count_pieces(docs, initial, inner).collect()}
    assert counts[3] == 130_000 and counts[5] == 1 and counts[6] == 0
    path = public_path("byte_bpe_50k.json")
    coded = {r["doc_id"]: (r["n_tokens"], r["decoded"]) for r in bpe.encode_decode(docs.where("doc_id IN (3, 5)"), path, add=("n_tokens", "decoded")).collect()}
    assert coded[3][1].startswith("m") and len(coded[5][1]) == 1_000_000
    assert pii.find_pii(docs).where("doc_id = 3").first()["spans"] is not None
    urls = docs.selectExpr("doc_id AS page_id", "concat('http://a.com/en/', text) AS url", "host", "rule")
    judged = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(urls, url_rules.RULES).collect()}
    assert judged[3] == "block" and judged[6] == "allow"


def test_trie_of_many_partial_segments():
    rules = [("block", "example.com", f"/p{k}") for k in range(20_000)] + [("allow", "example.com", "/p77x")]
    trie = url_rules.Trie(rules)
    assert trie.longest("example.com", "/p19999/a")[1:] == ("example.com/p19999", "block") and trie.longest("a.example.com", "/p77xyz")[1:] == ("example.com/p77x", "allow")
    assert trie.longest("example.com", "/q") is None and trie.longest("example.com", "/p123456")[1] == "example.com/p12345"


def test_token_shortcuts_are_declared():
    with open(public_path("word_bpe_49k.json")) as file:
        word = json.load(file)
    with open(public_path("byte_bpe_50k.json")) as file:
        assert token_files.declared(json.load(file)) == (False, False)
    assert token_files.declared(word) == (True, True)
    for path, value in ((("normalizer", "normalizers"), [{"type": "Strip"}]), (("model", "byte_fallback"), True), (("pre_tokenizer", "pretokenizers"), [{"type": "Whitespace"}])):
        other = json.loads(json.dumps(word))
        other[path[0]][path[1]] = value
        assert token_files.declared(other) == (False, False)


def test_pipeline_of_clashing_names_and_of_nothing(spark, tmp_path, docs):
    import corpus_pipeline

    benchmark = spark.createDataFrame([(1, f"{words(50, 20)}. {words(51, 8)}.")], "item_id bigint, text string")
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        place = tmp_path / name
        rows.where("doc_id IS NULL OR doc_id <> 5").write.parquet(str(place / "documents.parquet"))
        benchmark.write.parquet(str(place / "benchmark.parquet"))
        out = corpus_pipeline.run(spark, str(place))
        assert set(NAMES) - {"ids", "n_tokens"} <= set(out.columns)
        assert sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=str) == ([1, 3, None] if name == "some" else [])
