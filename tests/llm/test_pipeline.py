"""Each stage of the corpus pipeline against a plain version of it, on documents with nulls, copies, toxic words, secrets and shared lines."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulseloom.llm import queries, secrets, toxicity
from tests.llm.test_text_operators import brute_components, brute_lines, sentence

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def build():
    rows = []
    for i in range(240):
        text = sentence(60, 1000 + i % 200)
        if i % 8 == 0:
            text += " you are a zorgblat" + ("ig" if i % 16 else "en") + "."
        if i % 3 == 0:
            text += "\nAll rights reserved by the people of this site"
        if i % 10 == 1:
            text += f"\npassword = hunter{i:04d}"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    return rows + [(500, None, None, None, None), (501, "", "en", None, 0), (502, "short", "de", "s9", 5)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(build(), SCHEMA).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def taken(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, folder, tmp_path):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(i)))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / str(i))))
        docs = kept[name][1]
        assert name == "packing" or docs.columns == COLUMNS and docs.dtypes == [tuple(x.split()) if x.split()[1] != "long" else (x.split()[0], "bigint") for x in SCHEMA.split(", ")]
    before, after = kept["toxicity"]
    model = toxicity.learn(before.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    matcher, weights = toxicity.Matcher(model[0]), np.array(model[1])
    clean = [r for r in map(tuple, before.collect()) if np.dot(matcher.features(r[1] or ""), weights) < 0]
    assert taken(after) == sorted(clean, key=repr) and {r[0] for r in clean} == {r[0] for r in build() if r[0] >= 500 or r[0] % 8}
    before, after = kept["line_dedup"]
    want = [(d, t) for d, t, _, _ in brute_lines([tuple(r) for r in before.select("doc_id", "text").collect()])]
    assert taken(after.select("doc_id", "text")) == want and after.where("n_chars <> length(text)").isEmpty()
    assert not any("All rights" in t for _, t in want)
    before, after = kept["ngram_join"]
    groups = brute_components([tuple(r) for r in before.select("doc_id", "text").collect()])
    assert {r.doc_id for r in after.collect()} == {d for d, n, c in groups if n == 0 or d == c} and after.count() < before.count()
    assert taken(after) == taken(before.join(after.select("doc_id"), "doc_id").select(*COLUMNS))
    before, after = kept["secrets"]
    assert not any(re.search(r"password = hunter", r.text or "") for r in after.collect()) and after.count() == before.count()
    plain = {r.doc_id: r.text for r in before.collect()}
    assert all(r.text == plain[r.doc_id] for r in after.collect() if not secrets.find_secrets(plain[r.doc_id] or ""))
    before, after = kept["packing"]
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(queries.tokenizer_spec())
    got = {}
    for r in after.collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for r in before.collect():
        assert sum((x for _, x in sorted(got[r.doc_id])), []) == library.encode(r.text or "", add_special_tokens=False).ids + [1]


def test_whole_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.agg(F.sum("length")).first()[0] > 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "secrets", "packing"]


def test_repeated_ids_and_empty_tables(spark, folder):
    docs = spark.createDataFrame([(1, sentence(20, 1), "en", "a", 1), (1, sentence(20, 1), "en", "a", 1), (2, sentence(20, 1), "en", "a", 1), (None, sentence(20, 1), None, None, None), (1, "another text of its own right here", "en", "a", 1)], SCHEMA)
    got = taken(corpus_pipeline.drop_near_copies(spark, docs, folder).select("doc_id", "text"))
    assert [r[0] for r in got] == [1, 1, None]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == []
