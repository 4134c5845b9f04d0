"""Whole registered queries against brute force in plain Python."""

import collections
import hashlib
import itertools
import re
import time
from pathlib import Path

import numpy as np
import pytest
import xxhash
from compare import duck, spark_rows
from pyspark.sql import functions as F

from specloom.llm import lattice, mixing, pieces, pii, queries, repeats, simhash, toxicity

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BLANKS = b" \t\n\x0b\x0c\r"


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words_of(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    return [w for w in re.split(b"[" + re.escape(BLANKS) + b"]+", low) if w]


def test_op5(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_sentencepiece"](spark, SF).collect()}
    for i, text in texts_of(spark, SF).items():
        ids = lib.encode(text, add_eos=True)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_op6(spark):
    texts, n = {i: t.encode() for i, t in texts_of(spark, SF).items()}, 400
    seen = collections.Counter(hash(t[i : i + n]) for t in texts.values() for i in range(len(t) - n + 1))
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_longest_previous_factor"](spark, SF).collect()}
    removed = 0
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - n + 1):
            if seen[hash(t[k : k + n])] > 1:
                gone[k : k + n] = True
        gone = gone[: len(t)]
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), int(gone.sum()), runs, sha(kept))
        removed += int(gone.sum())
    assert removed > 0


def test_op6_shared_passages(spark, tmp_path):
    """Strings of 51 words that another document also has, most of them shorter than the 400 bytes that are removed."""
    rng = np.random.default_rng(6)
    some = lambda n: [f"{a}{b}" for a, b in zip(rng.choice(list("abcdefgh"), n), rng.integers(0, 99, n), strict=True)]
    passage, twice, edge = some(56), some(55), some(50)
    rows = [(i, " ".join([*some(20 + i), *passage, *some(30)])) for i in range(60)]
    rows += [(60, "\n".join(passage[2:])), (61, " ".join([*twice, "x", *twice])), (62, " ".join([*some(9), *edge])), (63, " ".join([*edge, *some(9)]))]
    rows += [(64, " ".join(some(70)))] * 2 + [(None, " ".join(rows[3][1].split())), (65, None), (66, ""), (67, "\x0b é ")]
    words = [re.split(f"[{BLANKS.decode()}]+", (t or "").strip(BLANKS.decode())) for _, t in rows]
    seen = collections.defaultdict(set)
    for r, w in enumerate(words):
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(r)
    want = [sum(len(seen[tuple(w[k : k + 51])]) > 1 for k in range(len(w) - 50)) for w in words]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_longest_previous_factor"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shared"]) for r in got) == sorted((d or -1, n) for (d, _), n in zip(rows, want, strict=True))
    assert min(want[:60]) >= 6 and want[60:66] == [4, 0, 0, 0, 20, 20]
    assert sum(r["n_shared"] > 0 and r["n_removed"] == 0 for r in got) > 50
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeats(empty, words=51).collect() == []


def test_op6_shared_on_the_tables(spark):
    texts = texts_of(spark, SF)
    words = {i: [w for w in re.split(b"[" + re.escape(BLANKS) + b"]+", t.encode()) if w] for i, t in texts.items()}
    seen = collections.defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 50):
            seen[hash(tuple(w[k : k + 51]))].add(i)
    got = {r["doc_id"]: r["n_shared"] for r in queries.QUERIES["op6_longest_previous_factor"](spark, SF).collect()}
    assert got == {i: sum(len(seen[hash(tuple(w[k : k + 51]))]) > 1 for k in range(len(w) - 50)) for i, w in words.items()}
    assert any(got.values())


def test_op7(spark):
    texts = texts_of(spark, SF)
    prints = {}
    for i, t in texts.items():
        w = words_of(t)
        parts = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    label = {i: i for i in texts}
    while True:
        new = {i: min(label[j] for j in texts if (prints[i] ^ prints[j]).bit_count() <= 2) for i in texts}
        if new == label:
            break
        label = new
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_simhash"](spark, SF).collect()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", label[i]) for i in texts}


def base_of(text):
    def luhn(d):
        return sum(v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    forms = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9](?:[\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, fits) in enumerate(forms) for m in re.finditer(p, text) if fits(m.group()))


def test_op10_base_and_more(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op10_bootstrap"](spark, LARGER).collect()}
    added = 0
    for i, text in texts_of(spark, LARGER).items():
        base, r = base_of(text), got[i]
        listed = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r["base_sha256"] == sha(",".join(listed))
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in base) for k in range(4)]
        spans = [x for x in r["spans"].split(",") if x]
        assert {*listed} <= {*spans} and len(spans) == r["n_spans"] == len(base) + r["n_added"]
        added += r["n_added"]
    assert added > 0


def test_op10_finds_hidden_seeds(spark):
    """A fifth of the seeds teaches nothing; what the rest taught finds them again, and nothing that only looks like them."""
    rows = [(i, f"word{i} about it, mail: user{i}.x@mail{i % 7}.example.com then phone +1 (555) 010-{1000 + i} and no {i}{i} of 9{i}00 goods") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    row = pii.recovered(df).first()
    assert row["n_hidden"] > 50 and row["n_found"] >= 0.9 * row["n_hidden"]
    found = [z["m"] for r in pii.spans(df, hide=5).collect() for z in r["added"]]
    assert all("@" in m or m.startswith("+1") for m in found)


def test_op10_swallowed_neighbours(spark):
    rows = [(i, f"number {'4111111111111111' if i % 2 else '5500000000000004'} in text {i}") for i in range(20)]
    rows += [(i, f"call +1 (555) 010-{1000 + i} now") for i in range(30, 40)] + [(50, "cards 4111111111111111 5500000000000004 both"), (51, "call +1 (555) 010-1234 10.0.0.1 now"), (52, "no 4111111111111112 5500000000000005 card"), (53, 'token = "0123456789abcdef0123456789abcdef01234567"')]
    rows += [(60 + i, f"card {n} ok") for i, n in enumerate(("4012888888881881", "378282246310005", "6011111111111117"))]
    found = {r["doc_id"]: [(pii.ALL_KINDS[z["k"]], z["m"]) for z in r["added"]] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[50] == [("card", "4111111111111111"), ("card", "5500000000000004")] and found[51] == [("phone", "+1 (555) 010-1234")]
    assert found[52] == [] and found[53] == [("secret", "0123456789abcdef0123456789abcdef01234567")]


@pytest.mark.parametrize("name", sorted({*queries.ORACLE_SQL} - {"op9_lattice"}))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck(queries.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("dims", [4, 8, 64, 768])
def test_lattice_recall(dims):
    """Pairs of cosine 0.951 that meet in a cell: at least 0.99 of them."""
    rng = np.random.default_rng(dims)
    a = lattice._unit(rng.normal(size=(2000, dims)))
    side = rng.normal(size=(2000, dims))
    side = lattice._unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * side
    tables = lattice.Tables(7, 3, 6.0, 3)
    x, y = tables.codes(a), tables.codes(b)
    met = ((x[:, :, :1] == y).any(axis=2) | (y[:, :, :1] == x).any(axis=2)).any(axis=1)
    assert met.mean() >= 0.99


def test_mixing_overlap(spark):
    """The query's words from each pattern are as many as a flow of the least cost takes, whatever the patterns share."""
    rows = queries.QUERIES["mixing_overlap"](spark, SF).toPandas()
    assert (rows.taken <= 2 * rows["size"]).all() and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    size, taken = (rows.groupby("sources")[c].sum() for c in ("size", "taken"))
    names = sorted({s for p in size.index for s in p.split(", ")})
    of = {p: [names.index(s) for s in p.split(", ")] for p in size.index}
    quota = mixing.targets([sum(size[p] for p in size.index if i in of[p]) for i in range(len(names))], share=0.75)
    want = mixing.min_cost_flow({frozenset(of[p]): float(size[p]) for p in size.index}, quota, 2)
    assert sum(taken) == pytest.approx(sum(want.values()), rel=0.05)
    most = rows.groupby("sources")["size"].max()
    assert all(abs(taken[p] - want[frozenset(of[p])]) <= most[p] for p in size.index)


def test_flow_is_least_cost():
    """All whole flows of a small net: none gives more words, or as many at less cost."""
    capacity, quota = {frozenset({0}): 2, frozenset({0, 1}): 3, frozenset({1}): 1}, [6, 4]
    taken = mixing.min_cost_flow({p: float(n) for p, n in capacity.items()}, [float(q) for q in quota], 2)
    cost = lambda x, n: max(0, x - n)
    best = max((sum(xs), -sum(cost(x, n) for x, n in zip(xs, capacity.values(), strict=True))) for xs in itertools.product(*[range(2 * n + 1) for n in capacity.values()]) if xs[0] <= quota[0] and xs[2] <= quota[1] and sum(xs) <= sum(quota))
    assert (sum(taken.values()), -sum(cost(taken.get(p, 0), n) for p, n in capacity.items())) == pytest.approx(best)


def test_clashing_columns_stay(spark):
    names = ["_row", "_copies", "_copy", "_mask", "_mask_key", "_specloom_row", "h", "block", "node", "label", "fp"]
    rows = [(i, f"some words of text {i} for user{i % 3}@mail.example.com", "en", "ab"[i % 2], 40, *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    for f in (simhash.keep_one, mixing.mixed, pii.mask, lambda d: toxicity.keep_clean(d, toxicity.train(d, labels), 2.0)):
        out = f(df)
        assert out.columns == df.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)


def test_near_copies_against_all_pairs(spark):
    """keep_one against the components of all pairs of whole shingle sets, on the documents and planted edits of them."""
    texts = texts_of(spark, SF)
    rng = np.random.default_rng(3)
    rows = list(texts.items())
    for k, (i, t) in enumerate(texts.items()):
        w = t.split(" ")
        if len(w) < 40:
            continue
        for m in range(1, 4):
            edited = list(w)
            for at in rng.choice(len(w), max(1, m * k % 7 * len(w) // 200), replace=False):
                edited[at] = f"x{rng.integers(1000)}"
            rows.append((100_000 + 10 * i + m, " ".join(edited[: len(edited) - (len(w) // 12) * (m == 3)])))
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    inverted = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {()}:
            inverted[x].append(i)
    for i, j in {(a, b) for group in inverted.values() if len(group) < 400 for a, b in itertools.combinations(group, 2)}:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            a, b = top(i), top(j)
            label[max(a, b, key=lambda x: rows[x][0])] = min(a, b, key=lambda x: rows[x][0])
    want = {rows[i][0] for i in range(len(rows)) if top(i) == i}
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want and len(want) < 0.8 * len(rows)


def test_toxicity_takes_one_text_of_a_label(spark):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, f"{'awful' if i % 2 else 'kind'} text {i}") for i in range(40) for _ in range(3)] + [(None, "x"), (7, None)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    again = toxicity.train(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5), labels)
    assert model.learned == again.learned and model.trees == again.trees


def test_long_words_and_ties(spark):
    """A word of a megabyte, equal rows and equal ids: every operator on texts answers a row for each."""
    long = "w" * 1_000_000
    rows = [(1, long, "en"), (1, long, "en"), (1, "other text of the same id", "de"), (2, "", None), (3, long + " end", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from specloom.llm import language

    assert language.identify(df, language.train(df)).count() == 5
    assert pieces.encode_documents(df, digests_only=True).count() == 5
    assert toxicity.scores(df, toxicity.train(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))).count() == 5
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == {1, 2, 3}


def test_lm_by_levels(spark):
    """Chunks and ranges that meet in several levels give the scores that one level gives."""
    from specloom.llm import ngram
    from specloom.llm.common import crc_mod

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (ngram.score(docs, crc_mod(docs["doc_id"], 5) != 1, chunk_bytes=c, bucket_bytes=b, fan=f).toPandas().sort_values("doc_id").reset_index(drop=True) for c, b, f in ((8 << 20, 16 << 20, 512), (16 << 10, 24 << 10, 3)))
    assert ngram.Levels(30, 20, 3).depth == 4
    assert (one[["doc_id", "n_tokens", "n_known", "train_tokens"]] == many[["doc_id", "n_tokens", "n_known", "train_tokens"]]).all().all()
    assert np.allclose(one.base_score, many.base_score) and np.allclose(one.score, many.score)


def test_lm_score_by_brute_force(spark):
    """The score of a whole text, with the counts taken in plain Python and the weights that the model learned from them."""
    from specloom.llm import ngram

    texts = ["a b a b c", "b a b", "c c a b", "a", "", "d a b c", "a b c a", "zz a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram.score(df, F.col("doc_id") < 6).toPandas().set_index("doc_id")
    learned = []
    keep = ngram.learn
    ngram.learn = lambda cells, order, **k: learned.append(keep(cells, order, **k)) or learned[-1]
    try:
        ngram.score(df, F.col("doc_id") < 6).collect()
    finally:
        ngram.learn = keep
    tokens = [[*t.split(), "</s>"] for t in texts]
    one = collections.Counter(w for t in tokens[:6] for w in t)
    two = collections.Counter(x for t in tokens[:6] for x in zip(["<s>", *t[:-1]], t, strict=True))
    n, v = sum(one.values()), len(one)
    for i, t in enumerate(tokens):
        score = 0.0
        for before, w in zip(["<s>", *t[:-1]], t, strict=True):
            context = 6 if before == "<s>" else one[before]
            weights = learned[0][min(int(np.frexp(float(context))[1]), ngram.CONTEXT_BUCKETS - 1)]
            p = weights[0] * (one[w] + 0.5) / (n + 0.5 * (v + 1)) + weights[1] * one[w] / n + weights[2] * (two[before, w] / context if context else 0)
            score += np.log10(p)
        assert got.score[i] == pytest.approx(score)


@pytest.mark.parametrize("fan", [512, 3])
def test_lm_shuffle_files_go(spark, fan):
    """When op1's tables are written, nothing that was shuffled for them is left on disk but the numbers of a few totals, on one level or several."""
    from specloom.llm import ngram
    from specloom.llm.common import crc_mod

    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f.name: f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data")}

    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), shuffled()
    ngram.score(docs, crc_mod(docs["doc_id"], 5) != 1, chunk_bytes=16 << 10, bucket_bytes=24 << 10, fan=fan)
    until = time.time() + 10  # files go a moment after the plan
    while (left := sum(n for f, n in shuffled().items() if f not in before)) > 5000 and time.time() < until:
        time.sleep(0.5)
    assert left <= 5000


def test_pipeline_by_stage(spark):
    """Each stage's rows from its own input, worked out in plain Python."""
    import sentencepiece

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF).cache())
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    assert all(t.columns == docs.columns for t in tables[:5])
    # toxicity: what the scores reject, and nothing else
    bad = {r["doc_id"] for r in toxicity.scores(docs, toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("score >= 0.3").collect()}
    assert sorted(r["doc_id"] for r in rows[1]) == sorted(r["doc_id"] for r in rows[0] if r["doc_id"] not in bad)
    # near copies: the least of each component of all pairs
    sets = {r["doc_id"]: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := words_of(r["text"] or "")) else {()} for r in rows[1]}
    label = {i: i for i in sets}
    changed = True
    pairs = [(i, j) for i, j in itertools.combinations(sorted(sets), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    while changed:
        changed = False
        for i, j in pairs:
            least = min(label[i], label[j])
            changed |= label[i] != least or label[j] != least
            label[i] = label[j] = least
    assert sorted(r["doc_id"] for r in rows[2]) == sorted({*label.values()})
    # personal data: base spans and what the method added, replaced from the left
    added = {r["doc_id"]: [(z["s"], z["k"], z["e"]) for z in r["added"]] for r in pii.spans(tables[2]).collect()}
    masked = {r["doc_id"]: r for r in rows[3]}
    for r in rows[2]:
        text, out, at = r["text"], "", 0
        for s, k, e in sorted({*base_of(text), *added[r["doc_id"]]}):
            if s >= at:
                out, at = out + text[at:s] + f"[{pii.ALL_KINDS[k].upper()}]", e
        assert masked[r["doc_id"]]["text"] == out + text[at:] and masked[r["doc_id"]]["n_chars"] == len(out + text[at:])
    # mixing: each source near its target, no document more than twice
    size = {r["doc_id"]: len(words_of(r["text"])) for r in rows[3]}
    source = {r["doc_id"]: r["source"] for r in rows[3]}
    names = sorted({*source.values()})
    target = mixing.targets([sum(size[i] for i in size if source[i] == s) for s in names])
    times = collections.Counter(r["doc_id"] for r in rows[4])
    assert max(times.values()) <= 2
    for s, t in zip(names, target, strict=True):
        assert abs(sum(size[i] * times[i] for i in size if source[i] == s) - t) <= max(size[i] for i in size if source[i] == s)
    # pieces
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = collections.Counter((i, tuple(lib.encode(masked[i]["text"], add_eos=True))) for i in times.elements())
    assert want == collections.Counter((r["doc_id"], tuple(r["ids"])) for r in rows[5])
