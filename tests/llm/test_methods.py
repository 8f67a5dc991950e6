"""The operators' methods against brute force, round trips and held-out accuracy."""

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jsonmend.llm import bpe, chat, components, exact, language, mixing, neardup, neighbours, quality, secrets, sharding


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b, key = j, (key * sharding.LCG + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 200])
def test_jump_hash(spark, shards):
    rows = spark.range(300).select(F.col("id"), (F.col("id") * 7_919_777_777 - 10**12).alias("key"))
    for r in rows.select("key", sharding.jump_hash(F.col("key"), shards).alias("s")).collect():
        assert r.s == jump(r.key, shards)


def test_growth_moves_rows_into_the_new_shard_only(spark):
    rows = spark.range(5000).select(sharding.jump_hash(F.col("id"), 16).alias("a"), sharding.jump_hash(F.col("id"), 17).alias("b")).collect()
    assert all(r.a == r.b or r.b == 16 for r in rows)
    assert 200 < sum(r.b == 16 for r in rows) < 400


# ---- secrets


def brute_spans(text):
    found = []
    for n, rule in enumerate(secrets.RULES):
        pattern = "[0-9a-f]+" if rule.kind == "hex" else rule.pattern
        least = 32 if rule.kind == "hex" else rule.least
        found += [(m.start(), n, m.end()) for m in re.finditer(pattern, text, rule.flags | re.A) if m.end(rule.group) - m.start(rule.group) >= least]
    return sorted(found)


PIECES = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abc12345", "x", "AKIA", "A1B2C3D4E5F6G7H8", "deadbeef" * 4, "0123456789abcdef", "é🙂", "\n", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "K", "ſecret"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=1, max_size=6))
def test_secrets_match_brute_force(texts):
    assert secrets.find_spans(texts) == [brute_spans(t) for t in texts]


@pytest.mark.parametrize("pattern", ["abc", "ab(c|d)e+f", "x{3}yz", "(foo|ba[rz])qux?", "a?bcd", "[a-z]{9}", "(ab)*cde", "^hello$"])
def test_trigram_queries_never_lose_a_match(pattern):
    query, rng = secrets.trigram_query(pattern), random.Random(1)
    texts = ["".join(rng.choice("abcdefoxyzqurhl") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += ["abc", "abceef", "abdef", "xxxyz", "fooqu", "bazqux", "bcd", "cde", "ababcde", "hello"]
    index = secrets.SegmentIndex([t.encode() for t in texts], sorted(secrets.grams(query)))
    kept = set(index.candidates(query).tolist())
    assert all(k in kept for k, t in enumerate(texts) if re.search(pattern, t))


# ---- language and quality


def _prose(rng, parts, n):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


LANGS = {"aa": ["the", "ing", "er", "and", "tion"], "bb": ["der", "ung", "sch", "ein", "keit"], "cc": ["que", "eau", "oi", "ment", "les"], "dd": ["los", "ci", "ar", "do", "ez"]}


def test_language_accuracy(spark):
    rng = random.Random(2)
    rows = [(k, _prose(rng, LANGS[lang], rng.randrange(5, 60)), lang) for k, lang in enumerate(rng.choices(list(LANGS), k=400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, F.col("doc_id") % 2 == 0)
    out = {r.doc_id: r for r in language.predict_language(docs.filter("doc_id % 2 = 1"), model).collect()}
    assert np.mean([out[k].lang_pred == lang for k, _, lang in rows if k % 2]) > 0.97
    mixed = model.predict([_prose(rng, LANGS["aa"], 40) + " " + _prose(rng, LANGS["bb"], 40)])[0]
    assert mixed[1] < min(r.lang_score for r in out.values() if len(r.text) > 200)


@pytest.mark.parametrize("count", [1, 2, 5, 9, 30])
def test_codewords_are_apart(count):
    code = language.code_matrix(count)
    assert all((a != b).sum() >= max(1, code.shape[1] // 5) for a, b in itertools.combinations(code, 2))


def test_score_does_not_depend_on_the_batch():
    rng = random.Random(3)
    texts = [_prose(rng, LANGS["aa"], 20) for _ in range(20)]
    model = language.Model.from_counts(["aa", "bb"], np.random.default_rng(0).integers(0, 50, size=(2, language.FEATURES)))
    assert model.predict(texts) == [model.predict([t])[0] for t in texts]


def test_forward_backward_is_exact():
    rng = np.random.default_rng(4)
    e, move = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    score = {}
    for path in itertools.product((0, 1), repeat=5):
        score[path] = sum(e[0, t] for t in range(5) if path[t]) + sum(move[a, b] for a, b in itertools.pairwise(path))
    z = np.logaddexp.reduce(list(score.values()))
    expect = [sum(np.exp(s - z) for p, s in score.items() if p[t]) for t in range(5)]
    padded = np.concatenate([e, np.full((1, 3), 9.0)], axis=1)
    marginal, _, log_z = quality.forward_backward(padded, np.array([[True] * 5 + [False] * 3]), move)
    assert np.allclose(marginal[0, :5], expect) and np.isclose(log_z[0], z)


def test_quality_separates():
    rng = random.Random(5)
    good = ["\n".join(_prose(rng, LANGS["aa"], rng.randrange(5, 30)) for _ in range(rng.randrange(1, 8))) for _ in range(120)]
    bad = [_prose(rng, LANGS["aa"], 9) + "\n" + "\n".join(" | ".join(_prose(rng, LANGS["aa"], 1) for _ in range(12)) for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    model = quality.fit(good[:80] + bad[:40], np.array([1] * 80 + [0] * 40))
    assert (model.scores(good[80:]) >= quality.GOOD).mean() > 0.95 and (model.scores(bad[40:]) < quality.GOOD).mean() > 0.95
    assert 0 <= model.scores([""])[0] <= 1


def test_quality_learns_from_documents_of_many_lines(spark):
    rng = random.Random(12)
    good = [_prose(rng, LANGS["aa"], 20) for _ in range(12)]
    bad = ["\n".join(["7 | 8 | 9", "x | y"] * 1100) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 12)) for k in range(24)], "doc_id long, quality int")
    model = quality.train(docs, labels, F.lit(True))
    assert min(model.scores(good)) > 0.5 > max(model.scores(bad[:1]))


def test_blocks_of_lines_give_the_features_of_all(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 7)
    rng = random.Random(13)
    texts = ["\n".join(_prose(rng, LANGS["bb"], rng.randrange(1, 9)) for _ in range(rng.randrange(1, 30))) for _ in range(20)] + ["", "\n\n"]
    own, size, counts = quality.line_features(texts)
    full = quality.with_neighbours(own, counts)
    lines = quality._Lines(texts)
    scaled = (full - lines.mean) / lines.spread
    draw = np.random.default_rng(14)
    weights, error = draw.normal(size=full.shape[1]), draw.normal(size=len(full))
    assert np.allclose(lines.mean[1:], full.mean(axis=0)[1:]) and np.allclose(lines.spread, np.where(full.std(axis=0) < 1e-6, 1, full.std(axis=0)))
    assert np.allclose(lines.emission(weights), scaled @ weights) and np.allclose(lines.gradient(error), scaled.T @ error)
    assert (lines.size == size).all() and (lines.counts == counts).all()


# ---- near duplicates


def _sets(texts, width):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    return out


def _components(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(sets))]


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for size in (60, 40, 3, 2, 1, 1):
        base = [word() for _ in range(120)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 8)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    shared = [word() for _ in range(30)]
    texts += [" ".join(shared + [word() for _ in range(15)]) for _ in range(40)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("few", "stars"), [(1024, 8), (4, 8), (0, 0)])
def test_near_groups_match_brute_force(spark, monkeypatch, few, stars):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "STARS", stars)
    texts = _corpus(few)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in neardup.near_groups(docs, 85, 3).collect()}
    assert [out[k] for k in range(len(texts))] == _components(_sets(texts, 3), 85)


def _strangers(seed):
    """Families whose members mostly stay just below five words at 80 %, all with one common passage and one shingle."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, texts = [word() for _ in range(40)], []
    for size, most in ((90, 14), (50, 9), (30, 5)):
        base = [word() for _ in range(100)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, most)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(["one", "shingle", "that", "all", "share", *passage, *w]))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("few", "stars", "seed"), [(1024, 8, 1), (0, 8, 2), (0, 0, 3)])
def test_near_strangers_of_crowded_buckets_match_brute_force(spark, monkeypatch, few, stars, seed):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "STARS", stars)
    texts = _strangers(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in neardup.near_groups(docs, 80, 5).collect()}
    assert [out[k] for k in range(len(texts))] == _components(_sets(texts, 5), 80)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, size=3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    sig = neardup.super_minhash([a, b, a[:1], np.zeros(0, np.uint64)], 256)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.1
    assert len(set((sig[2] >> np.uint64(32)).tolist())) == 256  # one element fills each slot at its own level
    assert (sig[3] == np.uint64(2**64 - 1)).all()
    assert (neardup.super_minhash([a], 256)[0] == sig[0]).all()


def test_components(spark):
    rng = random.Random(7)
    edges = [(k, k + 1) for k in range(100, 160)] + [(0, k) for k in range(1, 50)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    out = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({out[k] for k in range(100, 161)}) == 1 and len({out[k] for k in range(50)}) == 1 and out[0] != out[100]
    assert all(out[a] == out[b] for a, b in edges if a != b)


# ---- exact duplicates


def test_exact_groups_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 14))) for _ in range(200)]
    texts += ["x y" * 50, "xy" * 50, "xy" * 49 + "x y ", "é" * 30, "é " * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t) for t in texts]
    for block in (3, 16, 4096):
        for r in exact.exact_groups(docs, block=block).collect():
            group = [k for k, p in enumerate(plain) if p == plain[r.doc_id]]
            keep = min(group, key=lambda k: (-len(texts[k]), k))
            assert (r.keep_id, r.group_size, r.kept) == (keep, len(group), keep == r.doc_id)


def test_exact_names_are_ranks_whatever_the_partitions(spark):
    texts = [c * n for c in "abcab" for n in (1, 3, 4, 9, 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    named = [{r.doc_id: (r.blocks, r.name) for r in exact.block_identities(docs.repartition(n), block=3).collect()} for n in (1, 7)]
    assert named[0] == named[1]
    by_blocks = {}
    for blocks, name in named[0].values():
        by_blocks.setdefault(blocks, set()).add(name)
    assert by_blocks[10] == {0, 1, 2}  # the last level has only these


def test_exact_names_survive_hash_clashes(spark, monkeypatch):
    rows = spark.createDataFrame([(k, b) for k, b in enumerate([b"a", b"b", b"a", b"c"])], "k long, block binary")
    monkeypatch.setattr(exact.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    named = {r.k: r.name for r in exact._block_names(rows).collect()}
    assert named[0] == named[2] and len({named[0], named[1], named[3]}) == 3


# ---- neighbours


def test_neighbours_recall(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 24))
    x = centres[rng.integers(0, 8, 1500)] + 0.8 * rng.normal(size=(1500, 24))
    x[100:140] = x[100]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(table, table.filter("vec_id % 20 = 0")).collect()
    score = x @ x.T
    recall = []
    for q in range(0, 1500, 20):
        mine = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and q not in [r.vec_id for r in mine]
        assert all(np.isclose(r.score, score[q, r.vec_id], rtol=1e-12) for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        best = sorted((k for k in range(1500) if k != q), key=lambda k: (-score[q, k], k))[:20]
        recall.append(len({r.vec_id for r in mine} & set(best)) / 20)
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize("rows", [5_000, 1_000_000, 100_000_000])
def test_calibration_reaches_the_recall_at_any_row_count(rows):
    x = np.random.default_rng(6).normal(size=(2048, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hasher = neighbours.calibrated(x, 20, 1.0, rows)
    buckets, asked = hasher.buckets(x), range(7, 2048, 32)
    recall = []
    for q, probes in zip(asked, hasher.probes(x[asked]), strict=True):
        score = x @ x[q]
        score[q] = -np.inf
        seen = np.array([np.isin(buckets[:, t], probes[t]) for t in range(neighbours.TABLES)]).any(axis=0)
        recall.append(seen[np.argsort(-score)[:20]].mean())
    assert np.mean(recall) >= 0.9 and len(hasher.template) <= neighbours.MOST_PROBES


def test_neighbours_are_exact_where_no_probing_suffices(spark):
    # Norms so uneven that the added coordinate sets vectors far off the queries' cells at every K.
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 16)) * np.exp(1.5 * rng.normal(size=600))[:, None]
    bound = float(np.linalg.norm(x, axis=1).max())
    assert len(neighbours.calibrated(x, 20, bound, 600).template) == 0
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(table, table.filter("vec_id % 20 = 0")).collect()
    for q in range(0, 600, 20):
        mine = [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
        assert mine == sorted((k for k in range(600) if k != q), key=lambda k: (-(x[k] * x[q]).sum(), k))[:20]


@pytest.mark.parametrize(("group", "hot", "visits"), [(32_768, 16_384, 1_000_000), (64, 16, 40)])
def test_neighbours_of_equal_score_are_those_of_smallest_id(spark, monkeypatch, group, hot, visits):
    """200 distinct vectors with one inner product to every query, in one group and over many salted and split ones."""
    for name, value in (("GROUP", group), ("HOT", hot), ("VISITS", visits)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    x = np.zeros((240, 12))
    x[:200, 0], x[:200, 1:] = 1.0, rng.permutation(np.eye(11).repeat(20, axis=0))[:200] * np.repeat([0.25, 0.5], 100)[:, None]
    x[:200, 2] += np.arange(200) / 1024  # distinct
    x[200:, 0] = np.arange(1, 41) / 8  # queries along the first axis
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(table, table.filter("vec_id >= 200"), near=60).collect()
    for q in range(200, 240):
        mine = [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)]
        assert mine == sorted((k for k in range(240) if k != q), key=lambda k: (-(x[k] * x[q]).sum(), k))[:60]


def test_neighbours_recall_of_isotropic_vectors(spark):
    x = np.random.default_rng(8).normal(size=(3000, 32))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = neighbours.nearest(table, table.filter("vec_id % 50 = 0")).collect()
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hits = [len({r.vec_id for r in out if r.query_id == q} & set(np.argsort(-score[q])[:20].tolist())) / 20 for q in range(0, 3000, 50)]
    assert np.mean(hits) >= 0.9


def test_probe_template_orders_by_cost():
    template = neighbours.probe_template(4, 50)
    assert not template[0].any() and len({tuple(sorted(r)) for r in template.tolist()}) == len(template)
    assert all(9 - r not in row for row in template.tolist() for r in row if r)


# ---- mixing, chat, tokens


def test_chat_survives_deep_and_extra_fields_and_meets_several_layouts(spark):
    deep = '{"a":' * 100_000 + "1" + "}" * 100_000
    extra = '{"messages":[{"role":"user","content":"q","name":"n"},{"role":"assistant","content":"a","tool":{"x":[1]}}],"meta":{"k":1}}'
    rows = [(1, deep), (2, extra), (3, '{"messages":[{"role":"user","content":' + "[" * 5000 + "]" * 5000 + "}]}"), (4, '{"nothing":"known"}')]
    out = {r.id: (r.layout, r.formatted) for r in chat.format_records(spark.createDataFrame(rows, "id long, record string"), "id", "record").collect()}
    assert out[1] == out[4] == (None, "") and out[2][0] == "messages"
    assert chat.read_turns(out[2][1]) == [("user", "q"), ("assistant", "a")]
    turns = {
        1: [("user", "a"), ("assistant", "b")],
        2: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "")],
        3: [("human", "a"), ("gpt", "b")],
        4: [("system", "s"), ("user", "a"), ("assistant", "b")],
        5: [("system", "s"), ("user", "")],
    }
    table = spark.createDataFrame([(c, n, r, t) for c, own in turns.items() for n, (r, t) in enumerate(own)], "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.format_records(chat.pack_conversations(table), "conv_id", "record").collect()}
    assert {c: chat.read_turns(r.formatted) for c, r in found.items()} == turns
    assert [found[c].layout for c in sorted(found)] == ["prompt", "conversations", "messages", "messages", "conversations"]


def test_language_sample_and_decoding(spark):
    """The fit does not depend on partitions; decoding is the brute-force minimum of the weighted losses."""
    rng = random.Random(12)
    words = {"x": "alpha beta gamma delta", "y": "uno dos tres cuatro", "z": "eins zwei drei vier", "w": "ichi ni san shi"}
    rows = [(k, " ".join(rng.choices(words[lang].split(), k=12)), lang) for k, lang in enumerate("xyzw" * 50)]
    docs = spark.createDataFrame([*rows, (None, "alpha", "x"), (7, None, "x"), (8, "", "y")], "doc_id long, text string, lang string")
    one, two = (language.train(docs.repartition(n), F.lit(True)) for n in (1, 6))
    assert one.languages == two.languages == sorted(words) and np.array_equal(one.weights, two.weights)
    assert language.train(docs.limit(0), F.lit(True)).languages == []
    texts = [r[1] for r in rows[:40]] + ["alpha uno eins ichi"]
    slots, lengths = language.gram_slots(texts)
    at = 0
    for text, length, (lang, score, _) in zip(texts, lengths, one.predict(texts), strict=True):
        own = slots[at : at + length]
        at += length
        bits = np.mean([one.weights[a].astype(float) + one.weights[b] for a, b in own], axis=0) / 2
        loss = [sum(w * np.log1p(np.exp(-3 * c * (b - m) / s)) for w, c, b, m, s in zip(one.importance, word, bits, one.centre, one.scale, strict=True)) for word in one.code]
        assert lang == one.languages[int(np.argmin(loss))]
        assert np.isclose(score, 1 / sum(np.exp(-4 * (x - min(loss))) for x in loss))


def test_mixing_multipliers_are_the_optimum_of_the_dual(spark):
    """Against bisection on each source's words in plain Python."""
    rng = random.Random(21)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 90)), rng.choice("abbcccc")) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = docs.select("doc_id", mixing.source_key(F.col("source")).alias("src"), mixing.word_count(F.col("text")).alias("size")).withColumn("rows", F.lit(1))
    dual = mixing.balance(sizes, mixing.source_targets(sizes)).collect()
    assert len(dual) == 3
    for d in dual:
        own = np.array([len(t.split()) for _, t, s in rows if d.src.endswith(s)])
        words = lambda lam: (own * np.minimum(mixing.MOST, np.exp(np.minimum(lam * own / d.scale, 5)))).sum()  # noqa: E731, B023
        low, high = -50.0, 50.0
        for _ in range(200):
            low, high = ((low + high) / 2, high) if words((low + high) / 2) < d.target else (low, (low + high) / 2)
        assert np.isclose(words(d.lam), d.target, rtol=1e-6) and np.isclose(d.lam, low, atol=1e-4)


def test_mixing_targets(spark):
    rng = random.Random(10)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), s) for k, s in enumerate(rng.choices(["a", "b", None, "tiny"], [40, 30, 20, 2], k=900))]
    out = mixing.document_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    total = out["size"].sum()
    by = out.groupby("src").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert np.isclose(by.target.sum(), total) and (by.target <= 3 * by["size"] + 1e-6).all()
    assert (abs(by.taken - by.target) <= np.maximum(0.02 * by.target, 30)).all()
    weight = dict(zip(sorted(by.index), (1, 2, 3, 1), strict=True))
    free = by[by.target < 3 * by["size"] - 1e-6]
    assert np.allclose(free.target / [weight[s] for s in free.index], free.target.iloc[0] / weight[free.index[0]])


TEXT = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "</", "turn>", "a", "\n", ": ", "é", "🙂", "\\###", "<"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), TEXT), TEXT), max_size=6))
def test_chat_round_trip(turns):
    text, mask = chat.format_turns(turns)
    assert chat.read_turns(text) == turns
    assert chat.masked_text(text, mask) == "".join(t for r, t in turns if r == "assistant")


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"output": "o", "instruction": "i", "id": 3}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": None}]}, "messages", [("user", "u"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "conversations", [("user", "h"), ("assistant", "g")]),
        ({"messages": []}, "messages", []),
        ({"other": 1}, None, []),
    ],
)
def test_layouts(record, layout, turns):
    assert chat.canonical_turns(record, chat.mapping_table()) == (layout, turns)


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(open(bpe.default_tokenizer(), encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_tokenizer())


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(["aaaa", "th", "'s", "'S", "!!", "\x1c", "\xa0", "ΑΣ", "İ", "e\u0301", "<|endoftext|>", "</w>", "9", "²", "🙂", "\U00016d40", "\U00016d71", "\u0558", "\ua7cb", "\U00016ea1", " "]), max_size=12).map("".join)))
def test_tokens_match_the_library(codec, library, text):
    ids = codec.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def _merge_up(word, merges):
    parts = list(word)
    for u, v in merges:
        k = 0
        while k < len(parts) - 1:
            if (parts[k], parts[k + 1]) == (u, v):
                parts[k : k + 2] = [u + v]
            k += 1
    return parts


def _random_merges(seed):
    rng, tokens, merges = random.Random(seed), ["a", "b", "c"], []
    for _ in range(rng.randrange(1, 12)):
        u, v = rng.choice(tokens), rng.choice(tokens)
        if len(u + v) <= 6 and u + v not in tokens:
            tokens.append(u + v)
            merges.append((u, v))
    rng.shuffle(merges) if seed % 2 else None  # also lists that use a token before it is made
    return tokens, merges


@pytest.mark.parametrize("seed", range(60))
def test_states_and_arcs_accept_exactly_the_bpe_sequences(seed):
    """Every walk over the built table of up to three arcs, and the reading of every short word."""
    tokens, merges = _random_merges(seed)
    auto = bpe.TokenizationAutomaton({t: k for k, t in enumerate(tokens)}, merges)
    reached = {p for n in range(1, 7) for w in itertools.product("abc", repeat=n) for p in _merge_up("".join(w), merges)}
    for n in (2, 3):
        walks = np.array(list(itertools.product([k for k, t in enumerate(tokens) if t in reached], repeat=n)))
        fits = np.logical_and.reduce([auto.allowed(walks[:, k], walks[:, k + 1]) for k in range(n - 1)])
        for walk, fit in zip(walks[:4000], fits[:4000], strict=True):
            labels = [tokens[k] for k in walk]
            assert fit == (_merge_up("".join(labels), merges) == labels)
    for n in range(1, 7):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert auto.emit(auto.encode_word(word)) == _merge_up(word, merges)


def test_words_are_read_alike_one_by_one_and_together(codec, library, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("aethinorsé") for _ in range(rng.randrange(1, 90))) for _ in range(40)) for _ in range(5)] + ["a" * 3000, ""]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for long_word, cells in ((64, 500_000), (0, 500_000), (64, 7), (10**9, 500_000)):
        monkeypatch.setattr(bpe, "LONG_WORD", long_word)
        monkeypatch.setattr(bpe, "CELLS", cells)
        codec._forget()
        assert [ids.tolist() for ids in codec.encode_batch(texts)] == want


def test_unsupported_tokenizer_files_are_refused():
    spec = open(bpe.default_tokenizer(), encoding="utf-8").read()
    for old, new in (('"unk_token": null', '"unk_token": "x"'), ('"type": "NFC"', '"type": "NFD"'), ('"lstrip": false', '"lstrip": true'), ('"use_regex": false', '"use_regex": true')):
        changed = spec.replace(old, new, 1) if old in spec else spec.replace(old.replace(": ", ":"), new.replace(": ", ":"), 1)
        assert changed != spec
        with pytest.raises(ValueError):
            bpe.Codec(changed)
