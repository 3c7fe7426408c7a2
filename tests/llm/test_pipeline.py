"""The pipeline against its stages by brute force, on the smallest tables."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from weft.llm import decontaminate, secrets  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_the_pipeline_keeps_what_it_should(spark):
    from test_operators import SECRETS, brute_components, brute_spans, slow_fingerprint

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    kept = {r["doc_id"]: r for r in docs if re.search("[^\\W\\d_]", r["text"] or "")}
    root = brute_components({i: slow_fingerprint(r["text"]) for i, r in kept.items()})
    kept = {i: r for i, r in kept.items() if root[i] == i}

    def held(text):
        line = b" " + b" ".join(decontaminate.words_of(text)) + b" "
        return any(b" " + b" ".join(w) + b" " in line for w in items)

    def secret(text):
        return any(k != "hex" or (re.search("[0-9]", text[a:b]) and re.search("[a-f]", text[a:b])) for k, a, b in brute_spans(text, SECRETS))

    kept = {i: r for i, r in kept.items() if not held(r["text"]) and not secret(r["text"])}
    found = corpus_pipeline.run(spark, DATA).collect()
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for i, r in kept.items()}
    assert {r["doc_id"] for r in found} <= set(kept)
    taken = sum(words[r["doc_id"]] * r["copies"] for r in found)
    assert 0.97 * 1.5 * sum(words.values()) <= taken <= 1.5 * sum(words.values())
    assert all(r["text"] == kept[r["doc_id"]]["text"] for r in found)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns, name


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


def test_nulls_repeats_ties_and_extra_columns(spark):
    text = spark.read.parquet(f"{DATA}/documents.parquet").filter("lang = 'en' AND length(text) > 300").orderBy("doc_id").limit(40).collect()
    texts = [r["text"] for r in text]
    rows = [(None if i % 5 == 0 else i // 2, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, i, -1) for i, t in enumerate(texts)]
    rows += [rows[1], rows[1], (None, None, None, None, 0, 0), (3, "", "en", "s1", 0, 0), (None, texts[7] + " " + "word by word " * 100_000, "en", "s1", 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int, copies int")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), stage(spark, before, DATA).schema)
        assert sorted(docs.columns) == sorted(before.columns), name
        assert docs.count() > 0, name
    found = docs.collect()
    assert all(r["text"] and r["copies"] in (1, 2) for r in found)
    assert len({(r["doc_id"], r["text"]) for r in found}) == len(found)


def test_only_the_last_table_stays(spark):
    import os

    from weft.llm import common

    folder = common.shared_dir(spark).removeprefix("file://") + "/weft"
    held = lambda: {p for p in (os.listdir(folder) if os.path.isdir(folder) else []) if p.startswith("pipeline-")}
    before = held()
    corpus_pipeline.run(spark, DATA)
    assert [p.rpartition("-")[0] for p in held() - before] == ["pipeline-mixing"]
