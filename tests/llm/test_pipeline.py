"""The pipeline, stage by stage, against plain Python."""

import random

import corpus_pipeline as pipeline
from jsonmend.llm import bpe
from jsonmend.llm.common import materialize

LANGS = {"aa": ["the", "ing", "er", "and", "tion"], "bb": ["der", "ung", "sch", "ein", "keit"]}


def test_stages(spark):
    rng = random.Random(1)
    words = lambda lang, n: ["".join(rng.choice(LANGS[lang]) for _ in range(3)) for _ in range(n)]
    rows = [(k, " ".join(words(lang, 60)), lang, f"s{k % 3}", 1) for k, lang in enumerate(rng.choices(["aa", "bb"], k=150))]
    near = rows[3][1].split(" ")
    near[30] = "changed"
    planted = [(900, rows[0][1] + "\n", "aa", "s0", 1), (901, "12 34 !!", None, "s0", 1), (902, None, "aa", "s1", 1), (903, " ".join(near), "aa", "s1", 1)]
    docs = spark.createDataFrame(rows + planted, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        seen.append((name, {r.doc_id for r in docs.select("doc_id").collect()}))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == list(pipeline.COLUMNS)
    kept = dict(seen)
    everything = {r[0] for r in rows}
    assert kept["language"] == everything | {900, 903}
    assert kept["exact_dedup"] == (everything - {0}) | {900, 903}  # the longer original stays
    assert kept["near_dedup"] == (everything - {0}) | {900}
    assert len(kept["mixing"]) > 100 and kept["tokens"] == kept["mixing"]
    codec, texts = bpe.codec(open(bpe.default_tokenizer(), encoding="utf-8").read()), {r[0]: r[1] for r in rows + planted}
    assert all(r.token_ids == codec.encode(texts[r.doc_id]) for r in docs.collect())
    assert pipeline.ORACLE_SQL is None


def test_stages_take_empty_tables_and_odd_rows(spark):
    """Each stage alone: no row, nulls everywhere, empty and repeated rows, one long text, and a clashing column."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long"
    odd = [(None, None, None, None, None, None), (1, "", "aa", None, 0, 1), (2, "same words here again and again", "aa", "s", 1, 1), (2, "same words here again and again", "aa", "s", 1, 1), (3, "long " * 60_000, "bb", "s", 1, 1)]
    for name, stage in pipeline.STAGES:
        assert materialize(stage(spark, spark.createDataFrame([], schema), ""), name).count() == 0, name
        ids = [r.doc_id for r in stage(spark, spark.createDataFrame(odd, schema), "").select("doc_id").collect()]
        wanted = {"language": {2, 3}, "exact_dedup": {1, 2, 3}, "near_dedup": {None, 1, 2, 3}, "tokens": {None, 1, 2, 3}}
        if name != "mixing":
            assert set(ids) == wanted[name], name
        assert set(ids) <= {None, 1, 2, 3} and (name != "tokens" or len(ids) == 5)
