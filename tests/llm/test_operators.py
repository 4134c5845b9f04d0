"""The training-data operators against brute force, held-out accuracy and odd tables."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from compare import duck, rows_of, spark_rows
from pyspark.sql import functions as F

import corpus_pipeline
from specloom.llm import iblt, lattice, language, mixing, ngram, pieces, pii, queries, repeats, simhash, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score double, block string"
LONG = " ".join(f"word{i % 997} Zeile\n{i}" for i in range(20_000))
ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same words here in a row", "en", "a", 24), (3, "same words here in a row", "en", "a", 24), (None, "no id at all é 😀", "fr", None, 17), (5, LONG, "de", "b", len(LONG)), (6, "  \n\t ", "en", "b", 5), (7, "mail a.b@c.de now", "es", "b", 17)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "f", 0.5, "x") for r in ODD], SCHEMA)


def both(spark, odd, f):
    """Runs f on the odd table and on an empty one; rows of the former."""
    assert f(odd.limit(0)).collect() == []
    return f(odd).collect()


def test_odd_tables(spark, odd):
    n = len(ODD)
    labels = spark.createDataFrame([(2, 1, 1), (3, 1, 0), (None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    train = F.coalesce(F.col("doc_id") != 5, F.lit(True))
    lm = both(spark, odd, lambda d: ngram.score(d, train, chunk_bytes=1 << 16))
    assert len(lm) == n and {r["n_tokens"] for r in lm if r["doc_id"] in (1, 2, 6)} == {1} and all(math.isfinite(r["score"]) for r in lm)
    ids = both(spark, odd, pieces.encode_documents)
    assert len(ids) == n and [r["ids"] for r in ids if r["doc_id"] == 1] == [[2]] and next(r["decoded"] for r in ids if r["doc_id"] == 5) == LONG
    found = both(spark, odd, simhash.near_duplicates)
    assert len(found) == n and {r["component_id"] for r in found if r["doc_id"] in (1, 2, 6)} == {1}
    assert len(both(spark, odd, lambda d: simhash.keep_one(d).select(d.columns))) == n - 3
    cut = both(spark, odd, lambda d: repeats.repeats(d, length=64, keep_first=False))
    assert len(cut) == n and next(r["n_bytes"] for r in cut if r["doc_id"] == 1) == 0
    mixed, _ = mixing.mix(odd)
    assert mixed.count() == n and mixed.where("copies > 2 or (size = 0 and copies > 2)").count() == 0
    assert mixing.mix(odd.limit(0))[0].collect() == []
    prints = both(spark, odd, lambda d: iblt.fingerprints(d, block_rows=2))
    assert len(prints) == n
    spans = both(spark, odd, pii.spans)
    assert len(spans) == n and [z["m"] for r in spans for z in r["base"]] == ["a.b@c.de"]
    assert [r["text"] for r in pii.mask(odd).where("doc_id = 7").collect()] == ["mail [EMAIL] now"] and pii.mask(odd).columns == odd.columns
    model = toxicity.train(odd, labels)
    assert len(both(spark, odd, lambda d: toxicity.scores(d, model))) == n
    assert toxicity.keep_clean(odd, model, 2.0).columns == odd.columns
    said = both(spark, odd, lambda d: language.identify(d, language.train(odd)))
    assert len(said) == n and {r["lang_pred"] for r in said if r["doc_id"] in (1, 2, 6)} == {"und"}
    assert {r["lang_pred"] for r in language.identify(odd, language.train(odd.limit(0))).collect()} == {"und"}


def test_lm_base_and_gain(spark, docs):
    rows = queries.QUERIES["op1_deleted_interpolation"](spark, SF).toPandas().set_index("doc_id")
    texts = {r["doc_id"]: [*r["text"].encode().lower().split(), "end"] for r in docs.select("doc_id", "text").collect()}
    c = collections.Counter(w for i, x in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in texts.items():
        assert rows.base_score[i] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
        assert (rows.n_tokens[i], rows.n_known[i], rows.train_tokens[i]) == (len(x), sum(c[w] > 0 for w in x), n)
    held = rows[rows.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_em_recovers_weights():
    rng = np.random.default_rng(0)
    grid = np.where(rng.random(4000) < 0.7, 40, -999)
    w = ngram.learn([(3, 0, int(g), 1) for g in grid], 2)[3]
    assert w.sum() == pytest.approx(1) and w[2] > 0.6


def test_sketches(spark, docs):
    rows = queries.QUERIES["op2_iblt"](spark, SF).toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    texts = dict(docs.select("doc_id", "text").collect())
    para = re.compile(r"[^\n]{1,64}[^\n.!?]{0,192}[.!?]*")  # a line, or a long one's part that ends with a sentence
    for i in range(len(rows)):
        x, y = texts[rows.doc_id[i]], texts[rows.doc_id[(i + 1) % len(rows)]]
        k = len(x) // 2
        edited = x[: len(x) - k] + y[:k]
        assert rows.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest()
        a = set(para.findall(x))
        for got, other in ((rows.near_edited[i], edited), (rows.near_next[i], y)):
            b = set(para.findall(other))
            assert got == pytest.approx(2 * len(a & b) / (len(a) + len(b)) if a or b else 1)
    assert 1 <= rows.tier.max() <= 4  # every pair has peeled


def test_sketches_of_odd_ids(spark):
    """Ids far apart, one outlier, one id of many rows, nulls: the next row is the one that a sort gives."""
    ids = [-(2**63), -(2**63), 2**62, 2**63 - 1, *range(40), *[7] * 25, *[None] * 9]
    rows = [(d, f"line {i}\nof document {d}\n" + "x" * (i % 5)) for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    h = {r["text"]: r["h"] for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).collect()}
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))
    for size, most in ((4, 50), (4, 3), (1, 500), (4096, 50)):
        got = {r["text"]: r["next_text"] for r in iblt.with_next(df, size, most).collect()}
        assert got == {a[1]: b[1] for a, b in zip(want, want[1:] + want[:1], strict=True)}
    assert iblt.fingerprints(df, 4).where("to_next.tier > 5").count() == 0


def test_peeling_alone_tells_the_difference(spark):
    """The sets reach the result only through cells: sketches of other sets give those sets' difference."""
    df = spark.range(1).selectExpr("transform(sequence(1, 40), x -> xxhash64(x)) a", "transform(sequence(25, 66), x -> xxhash64(x)) b")
    row = df.select(iblt.difference(iblt._cells("a"), iblt._cells("b"), "a", "b").alias("d"), "a", "b").first()
    assert {*row["d"]["plus"]} == {*row["a"]} - {*row["b"]} and {*row["d"]["minus"]} == {*row["b"]} - {*row["a"]} and 1 <= row["d"]["tier"] <= 5
    small = spark.range(1).selectExpr("transform(sequence(1, 4), x -> xxhash64(x)) a", "transform(sequence(3, 5), x -> xxhash64(x)) b")
    row = small.select(iblt.difference(iblt._cells("a"), iblt._cells("b"), "array_repeat(0L, 4)", "array_repeat(0L, 4)").alias("d"), "a", "b").first()
    assert row["d"]["tier"] == 0 and {*row["d"]["plus"]} == {*row["a"]} - {*row["b"]} and {*row["d"]["minus"]} == {*row["b"]} - {*row["a"]}


def test_language_and_toxicity_held_out(spark, docs):
    said = queries.QUERIES["op3_language"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (said.lang == said.lang_pred).mean() > 0.97
    rows = queries.QUERIES["op8_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").toPandas()
    bad, good = rows.score[rows.toxic == 1].to_numpy(), rows.score[rows.toxic == 0].to_numpy()
    assert ((bad[:, None] > good).mean() + 0.5 * (bad[:, None] == good).mean()) > 0.85


def test_lexicon_holds_stems(spark):
    assert toxicity.entries("abcdef") == ["abcdef", "abcde*"] and toxicity.entries("abc") == ["abc"]
    assert toxicity.weights_of({"abcdefgh", "abcdx", "abcde"}, {"abcde*": 1.0, "abcdefgh": 2.0}) == {"abcdefgh": 2.0}
    rows = [(i, f"some plain words here {'grumpf' + chr(97 + i % 26) + 'x' * (i // 26 % 9) if i % 3 == 0 else 'fine'}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "0 quality", "int(doc_id % 3 = 0) toxic"))
    assert "grump*" in model.learned
    unseen = spark.createDataFrame([(1, "some plain words here grumpfzzz"), (2, "some plain words here fine")], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in toxicity.scores(unseen, model).collect()}
    assert found[1] >= 0.3 > found[2]


def test_flow_and_targets():
    assert mixing.targets([100, 100], (5, 1)) == [200, 100]
    taken = mixing.min_cost_flow({frozenset({0}): 10, frozenset({1}): 10, frozenset({0, 1}): 10}, [20.0, 10.0])
    assert taken == {frozenset({0}): pytest.approx(10), frozenset({1}): pytest.approx(10), frozenset({0, 1}): pytest.approx(10)}


def test_mixing_meets_targets(spark, docs):
    rows = queries.QUERIES["op4_mixing"](spark, SF).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all() and rows.doc_id.is_unique
    by = rows.merge(docs.select("doc_id", "source").toPandas()).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by.taken - by.target).abs() <= by.most).all()
    again = queries.QUERIES["op4_mixing"](spark, SF).toPandas()
    assert rows.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_pieces_equal_the_library():
    import random

    import sentencepiece

    table = pieces.ChunkTable(open(pieces.default_model(), "rb").read(), most=50)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(1)
    parts = [" ", "  ", "a", "the", "▁", "▁▁", "\n", "é", "😀", "</s>", "　", "\x00", "word"]
    for _ in range(3000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        ids = lib.encode(x, add_eos=True)
        assert table.encode(x) == (" ".join(map(str, ids)), lib.decode(ids))


@pytest.mark.parametrize("hot", [512, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_repeats_by_brute_force(spark, hot, keep_first):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdefgh "), 900))
    texts = [base[:500], "x" + base[100:700] + "y", base[650:], "aé" * 300, "zz" + base[:300], base[:500]]
    n = 64
    seen = collections.Counter(x.encode()[i : i + n] for x in texts for i in range(len(x.encode()) - n + 1))
    want, first = [], set()
    for x in texts:
        raw, gone = x.encode(), set()
        for i in range(len(raw) - n + 1):
            s = raw[i : i + n]
            if (s in first) if keep_first else seen[s] > 1:
                gone.update(range(i, i + n))
            first.add(s)
        want.append(bytes(c for i, c in enumerate(raw) if i not in gone))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: bytes(r["kept"]) for r in repeats.repeats(df, length=n, keep_first=keep_first, hot=hot).collect()}
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("distance,hot", [(2, 64), (2, 1), (1, 1), (0, 64), (6, 64), (6, 1)])
def test_simhash_groups(spark, docs, distance, hot):
    rows = simhash.near_duplicates(docs, 3, distance, hot).toPandas()
    fp = rows.fp.to_numpy().view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= distance
    label = rows.doc_id.to_numpy().copy()
    while True:
        new = np.where(near, label[None], label.max() + 1).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert (label == rows.component_id.to_numpy()).all()


@pytest.mark.parametrize("hot", [64, 2])
def test_near_copies(spark, docs, hot):
    """Edited copies: none of two kept texts are linked, what goes is alike to a chain of others that ends in a kept one."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(int(r["doc_id"]), r["text"]) for r in docs.select("doc_id", "text").collect()]
    for k in range(12):
        base = list(rng.choice(words, 60 + 10 * k))
        rows.append((10_000 + 100 * k, " ".join(base)))
        for m in range(1, 9):  # one word, then two, three ... differ
            edited = list(base)
            for at in rng.choice(len(base), 1 + m // 3, replace=False):
                edited[at] = rng.choice(words)
            rows.append((10_000 + 100 * k + m, " ".join(edited)))
        rows.append((10_000 + 100 * k + 50, " ".join(rng.permutation(base))))  # the same words, another order: not alike
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    sets = [{*simhash.shingles_of(t, 5).tolist()} for _, t in rows]
    prints = simhash.fingerprints_of([" ".join(dict.fromkeys((t or "").encode().lower().decode().split())) for _, t in rows], 1)
    alike = [[j for j in range(len(rows)) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    for i, near in enumerate(alike):
        for j in near:
            assert i == j or not {rows[i][0], rows[j][0]} <= kept or np.bitwise_count(prints[i] ^ prints[j]) > 6
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = {*alike[todo.pop()]} - seen
            seen |= new
            todo += new
        assert kept & {rows[j][0] for j in seen}
    assert {10_000 + 100 * k + 50 for k in range(12)} <= kept


@pytest.mark.parametrize("hot", [64, 2])
def test_near_copies_beyond_six_bits(spark, hot):
    """Copies that gain or lose a passage: no two kept texts have a similarity of 0.8 or more, however far their prints are."""
    rng = np.random.default_rng(7)
    words, rows = [f"w{i}" for i in range(3000)], []
    for k in range(40):
        base = list(rng.choice(words, 40 + 25 * k))
        for edited in (base, base + list(rng.choice(words, len(base) // 6)), base[: len(base) - len(base) // 6], base[len(base) // 2 :]):
            rows.append((len(rows), " ".join(["licence", "line", "of", "all", "these", "texts", *edited])))
    sets = [{*simhash.shingles_of(t, 5).tolist()} for _, t in rows]
    prints = simhash.fingerprints_of([" ".join(dict.fromkeys(t.split())) for _, t in rows], 1)
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(np.bitwise_count(prints[i] ^ prints[j]) > 6 for i, j in pairs) > 20
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()}
    assert not any({i, j} <= kept for i, j in pairs)
    assert {i for i in range(len(rows)) if all(i != j for _, j in pairs)} <= kept


def test_lattice(spark):
    assert spark_rows(lattice.op9_lattice(spark, SF)) == duck(lattice.ORACLE_SQL, SF)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 64))
    x = np.concatenate([x, x[:30] + 0.02 * rng.normal(size=(30, 64)), x[:1].repeat(9, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] + [1.0] * 63), (904, [1.0, 2.0]), (905, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    for block in (2048, 2):
        got = {r["vec_id"]: r for r in lattice.near_duplicates(df, block=block).collect()}
        assert [got[i]["n_links"] for i in range(len(x))] == want.tolist()
        assert [got[i]["n_links"] for i in (900, 901, 902, 903, 904, 905)] == [0, 0, 0, 0, 1, 1] and got[905]["component_id"] == 904
    assert lattice.near_duplicates(df.limit(0)).collect() == []


def test_pii_finds_unseen_identifiers(spark):
    rows = [(i, f"text of person {i} contact: user{i}@mail.example.com and the end") for i in range(8)]
    rows += [(20, "text of person contact: handle77x, who writes"), (21, "the 4111 words and the 22 others"), (22, "card 4111 1111 1111 1111 or +1 (555) 010-1234 at 10.0.0.1 not 999.1.1.1")]
    found = {r["doc_id"]: r for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [z["m"] for z in found[20]["added"]] == ["handle77x"] and not found[21]["added"] and not found[21]["base"]
    assert [(pii.KINDS[z["k"]], z["m"]) for z in found[22]["base"]] == [("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-1234"), ("ip", "10.0.0.1")]


def test_pii_finds_whole_runs(spark):
    rows = [(i, f"text of person {i} phone: +1 (555) 010-12{i}4 and mail: user{i}@mail.example.com to all") for i in range(60)]
    unseen = {20: "555 010 1234", 21: "(555) 010-1234", 22: "555-010 (12) 34", 23: "user@localhost", 24: "4111 1111 1111 1112", 25: "1234"}
    rows += [(i, f"here phone: {x}, or so") for i, x in unseen.items()] + [(30, "here mail: <me@localhost> too"), (31, "here phone: (1234) too"), (32, "here phone: 77 10.0.0.1 too"), (33, "in 12 5 6 others")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: [z["m"] for z in r["added"]] for r in pii.spans(df).collect()}
    assert {i: found[i] for i in unseen} == {i: [x] for i, x in unseen.items()}
    assert (found[30], found[31], found[32], found[33]) == (["me@localhost"], ["1234"], ["77"], [])
    masked = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert masked[20] == masked[21] == "here phone: [PHONE], or so" and masked[30] == "here mail: <[EMAIL]> too"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    done = corpus_pipeline.run(spark, SF).toPandas()
    assert set(done.columns) == {"doc_id", "n_tokens", "ids", "decoded"} and set(done.doc_id) <= {r[0] for r in docs.select("doc_id").collect()}
    assert done.groupby("doc_id").size().max() <= 2 and (done.n_tokens == done.ids.map(len)).all()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_lattice_pairs_that_meet_in_no_cell(spark, tmp_path):
    rng = np.random.default_rng(7)
    a = lattice._unit(rng.normal(size=(40_000, 64)))
    side = rng.normal(size=a.shape)
    side = lattice._unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.9502 * a + np.sqrt(1 - 0.9502**2) * side
    ca, cb = (lattice.Tables(7, 3, 6.0, 3).codes(lattice._unit(x.astype(np.float32).astype(float))) for x in (a, b))
    lost = np.flatnonzero(~((ca[:, :, :1] == cb) | (cb[:, :, :1] == ca)).any(axis=(1, 2)))
    assert len(lost)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a[lost], b[lost], b[lost][:1], a[:50]]))]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    found = con.execute(lattice.NEAR_PAIRS_SQL)
    assert spark_rows(lattice.lattice_near_pairs(spark, str(tmp_path))) == rows_of([d[0] for d in found.description], found.fetchall())
