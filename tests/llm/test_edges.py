"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest

from jsonmend.llm import bpe, chat, exact, language, mixing, neardup, neighbours, quality, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} tail{k % 13}" for k in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1),
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1),
    (2, "alpha beta gamma delta epsilon zeta", "en", "a", 1),
    (3, None, None, None, None),
    (None, "alpha  beta gamma delta epsilon zeta", "fr", "b", 1),
    (4, "", "fr", "b", 0),
    (5, " \t\n", "fr", "b", 3),
    (6, "one", "en", "b", 3),
    (7, LONG, "en", None, len(LONG)),
    (8, LONG + " x", "en", None, 0),
    (9, "Ünï çødé 🙂 \u2028 text", "de", "c", 5),
]
CLASH = {n: "1" for n in ("id", "name", "n", "key", "h", "len", "pos", "block", "shard", "slot", "spans", "copies", "size", "src", "rank", "keys", "comp", "score", "lang_pred", "quality_score", "record", "token_ids", "__text")}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", *[f"{v} AS `{k}`" for k, v in CLASH.items()])


def model():
    counts = np.ones((2, language.FEATURES))
    slots, _ = language.gram_slots(["alpha beta gamma delta"])
    counts[0] += np.bincount(slots.reshape(-1), minlength=language.FEATURES) * 50
    return language.Model.from_counts(["en", "fr"], counts)


OPERATORS = {
    "sharding": lambda d: sharding.assign_shards(d, 4),
    "secrets": lambda d: secrets.scan_secrets(d),
    "language": lambda d: language.predict_language(d, model()),
    "near": lambda d: neardup.near_groups(d, 85, 3),
    "mixing": lambda d: mixing.document_copies(d),
    "quality": lambda d: quality.score_quality(d, quality.neutral()),
    "bpe": lambda d: bpe.encode_documents(d, bpe.default_tokenizer()),
    "exact": lambda d: exact.exact_groups(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_out_for_each_row_in(docs, name):
    assert OPERATORS[name](docs).count() == len(ROWS)
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_shard_slots_are_gapless(docs):
    rows = sharding.assign_shards(docs, 2).collect()
    for s in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert {r["size"] for r in rows if r.doc_id in (3, 4)} == {1}


def test_near_groups(docs):
    rows = {(r.doc_id, r.n_shingles): r for r in neardup.near_groups(docs, 85, 3).collect()}
    assert rows[2, 4].component_id == 1 and not rows[2, 4].kept
    assert rows[None, 4].component_id is None and rows[None, 4].kept
    assert rows[3, 0].component_id == 3 and rows[5, 0].kept and rows[6, 1].n_shingles == 1
    assert rows[8, rows[7, max(n for i, n in rows if i == 7)].n_shingles + 1].component_id == 7


def test_exact_groups(docs):
    rows = exact.exact_groups(docs).collect()
    assert sum(r.kept for r in rows if r.group_size == 4) == 1
    assert {r.keep_id for r in rows if r.doc_id in (1, 2)} == {None}  # the longest original has no id
    assert {r.keep_id for r in rows if r.doc_id in (3, 4, 5)} == {5}
    assert exact.drop_exact_copies(docs).count() == 6
    assert set(exact.drop_exact_copies(docs).columns) == set(docs.columns)


def test_mixing_caps_and_reruns(docs):
    rows = sorted(mixing.document_copies(docs).select("doc_id", "src", "n", "copies", "size", "taken").collect(), key=str)
    assert rows == sorted(mixing.document_copies(docs.repartition(3)).select("doc_id", "src", "n", "copies", "size", "taken").collect(), key=str)
    assert all(0 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in rows)
    assert mixing.mix_documents(docs).count() == sum(r.copies for r in rows)


def test_unknown_language(docs):
    rows = {r.doc_id: r for r in language.predict_language(docs, model()).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == "und" and rows[2].lang_pred == "en"
    assert rows[2]["__text"] == 1 if "__text" in rows[2] else True


def test_chat_edges(spark):
    rows = [(1, 1, "user", "a"), (1, 0, "system", None), (1, None, None, "n"), (None, 0, "user", "\\###</turn>"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS id", "2 AS record", "3 AS turns")
    packed = chat.pack_conversations(table)
    out = {r.conv_id: r for r in chat.read_back(chat.format_records(packed, "conv_id", "record"), "conv_id").collect()}
    assert (out[1].n_turns, out[None].n_turns, out[2].n_turns) == (3, 1, 2) and out[2].loss_chars == 0
    assert chat.pack_conversations(table.limit(0)).count() == 0


def test_neighbour_edges(spark):
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 AS uid", "2 AS vec", "3 AS keys")
    out = neighbours.nearest(table, table.filter("vec_id IN (20, 4, 3)")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in out] == [(3, 1, 1, 0.0), (3, 2, 2, 0.0), (3, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 0.0)]
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0
