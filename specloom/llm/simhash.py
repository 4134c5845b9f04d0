"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has bit i set if over half of its word shingles' XXH64 (seed 42) have it set. Fingerprints
link at ``distance`` or fewer differing bits. Their 64 bits form a ring of 16 segments of 4 bits. If two differ in
t bits at most, some start on the ring has, for every chain of l segments from it, at most l*t/16 differing bits:
so for t = 2 the first seven segments (28 bits) are equal, chains of 8 to 15 segments differ in one bit at most,
and all 16 in two. Equal 28-bit chains are found with an equi-join on (start, chain); the longer chains prune inside
the join before the full Hamming check.

A chain that over ``hot`` distinct fingerprints share is not joined in pairs. For distances up to two its fingerprints are linked through the 65
values at one bit or none from each (two fingerprints share such a value exactly if they differ in two bits or
fewer; at most 65 fingerprints can share one), so no link is lost and nothing grows with the square of a group. For larger
distances one task compares such a group in blocks and sends the edges of a spanning forest only.

``keep_one`` removes near copies by the Jaccard similarity of their sets of word shingles. Texts of equal words are one
class. The prints of the classes' distinct single words, linked as above, are a cheap first filter: each class is compared exactly with the
least of its component (the star), so that crowds of copies are one component early. What that leaves apart meets by an exact prefix filter on the shingle sets: with all sets in one
order, two of similarity t share one of their first n - ceil(t * n) + 1 shingles, and their first shared ones stand where enough can follow.
Common shingles come last in that order, which bounds the work, not the result. Classes that meet on a shingle are first all
compared with the one of them that has least of its own, a row each; then with others, until few pairs of unlike groups are left.
Classes and shingles are 64-bit hashes (chance of a false meeting about 1e-19 a pair).

Null or empty text, or one without words: fingerprint zero, linked like any other. Fewer words than a shingle: the whole
sequence is the one shingle. Rows repeat as they come; a null doc_id is never a component's least unless alone.
Other columns pass only in ``keep_one``. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import bounded, components, discard, free, mix64, over_batches, save, small_batches, sweep, text_of
from specloom.llm.ngram import tokens
from specloom.llm.rolling import powers

SEGMENTS, BITS = 16, 4
_STEP = np.uint64(0x9FB21C651E98DF25)


def fingerprints_of(texts: list[str | None], n_words: int) -> np.ndarray:
    """uint64 fingerprints of texts."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    sizes: list[int] = []
    rows: list[int] = []

    def flush() -> None:
        if rows:
            bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.int32)
            over = np.packbits(sums * 2 > np.array(sizes)[:, None], axis=1)
            out[rows] = over.view(">u8")[:, 0]
            hashes.clear(), sizes.clear(), rows.clear()

    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) < n_words:
            hashes.append(digest(joined, 42))
            sizes.append(1)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[: len(words) - n_words] + 1)).tolist()
            hashes.extend([digest(joined[s:e], 42) for s, e in zip(starts, ends[n_words - 1 :].tolist(), strict=True)])
            sizes.append(len(starts))
        rows.append(i)
        if len(hashes) >= 200_000:
            flush()
    flush()
    return out


def fingerprints(docs: DataFrame, n_words: int) -> DataFrame:
    """(doc_id, fp): fp the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "fp": pa.array(fingerprints_of(batch.column("text").to_pylist(), n_words).view(np.int64))}

    return small_batches(docs).selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(over_batches(make, schema), "doc_id bigint, fp bigint")


def _allowed(n: int, distance: int) -> int:
    """Differing bits that a chain of n segments may have."""
    return n * distance // SEGMENTS


def _chains(distance: int, flips: int) -> int:
    """Segments of the longest chain that may have ``flips`` differing bits at most."""
    return max(n for n in range(1, SEGMENTS + 1) if _allowed(n, distance) <= flips)


def _near(x: np.ndarray, distance: int, block: int):
    """Blocks (i, j, near): whether x[i:] and x[j:] differ in ``distance`` bits or fewer."""
    x = x.view(np.uint64)
    for i in range(0, len(x), block):
        for j in range(0, len(x), block):
            yield i, j, np.bitwise_count(x[i : i + block, None] ^ x[None, j : j + block]) <= distance


def forest(table: pa.Table, distance: int, block: int = 1024) -> pa.Table:
    """Edges that connect what is within ``distance`` among the nodes of one crowded chain, fewer than there are nodes."""
    nodes, at = np.unique(table.column("node").to_numpy(), return_index=True)
    x = table.column("x").to_numpy()[at]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        for i, j, near in _near(x, distance, block):
            best = np.where(near, label[None, j : j + block], len(nodes)).min(axis=1)
            np.minimum(new[i : i + block], best, out=new[i : i + block])
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.table({"a": nodes[label[far]], "b": nodes[far]})


def _turned(c: str, k: int) -> str:
    return f"(shiftrightunsigned({c}, {k}) | shiftleft({c}, {64 - k}))" if k else c


def meet(nodes: DataFrame, distance: int, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Where ``nodes`` (node long, fp long) meet: the near pairs (a, b) of chains with ``hot`` nodes or fewer, and the rows
    (node, s, chain, x) of crowded ones, if any; x is the fingerprint turned by s segments.

    Up to two bits, fingerprints meet on chains that must be equal. Beyond that, these chains get short, so they meet on
    longer ones that may differ in one bit: each node is stored under its own chains and looks under all that are a
    permitted bit away.
    """
    if not 0 <= distance <= 8:
        raise ValueError("distance must be 0 to 8")
    flips = 0 if distance <= 2 else 1
    equal, chain = _chains(distance, 0) * BITS, _chains(distance, flips) * BITS
    mask = (1 << chain) - 1 if chain < 64 else -1
    rings = nodes.select("node", F.expr("explode(array(" + ",".join(f"struct({i} as s, {_turned('fp', i * BITS)} as x)" for i in range(SEGMENTS)) + "))").alias("r"))
    rings = save(rings.selectExpr("node", "r.s", "r.x", f"r.x & {mask}L as chain"), "rings")
    sizes = save(rings.groupBy("s", "chain").count().where("count > 1" if not flips else "count > 0"), "sizes")
    looking = rings
    if flips:
        looking = rings.select("node", "s", "x", F.explode(F.expr(f"concat(array(chain), transform(sequence({equal}, {chain - 1}), i -> chain ^ shiftleft(1L, i)))")).alias("chain"))
    few, crowds = sizes.where(F.col("count") <= hot), sizes.where(F.col("count") > hot).select("s", "chain")
    stored = rings.join(few, ["s", "chain"]).select("s", "chain", F.col("x").alias("xb"), F.col("node").alias("b"))
    asking = (looking.join(few, ["s", "chain"]) if not flips else looking).select("s", "chain", F.col("x").alias("xa"), F.col("node").alias("a"))
    on = (F.col("l.s") == F.col("r.s")) & (F.col("l.chain") == F.col("r.chain")) & (F.col("a") < F.col("b"))
    for n in range(chain // BITS + 1, SEGMENTS + 1):  # each longer chain within its share, the whole ring last
        if n == SEGMENTS or _allowed(n, distance) < _allowed(n + 1, distance):
            part = (1 << n * BITS) - 1 if n < SEGMENTS else -1
            on = on & F.expr(f"bit_count((xa ^ xb) & {part}L) <= {_allowed(n, distance)}")
    near = asking.alias("l").join(stored.alias("r"), on).select("a", "b")
    if crowds.isEmpty():
        return near, None
    return near, looking.join(crowds, ["s", "chain"]).select("node", "s", "chain", "x")


def links(nodes: DataFrame, distance: int = 2, hot: int = 64) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``nodes`` (node = fp) that connect exactly what links of ``distance`` or fewer bits connect."""
    near, crowd = meet(nodes, distance, hot)
    if crowd is None:
        return near
    if distance > 2:
        return near.unionByName(crowd.groupBy("s", "chain").applyInArrow(lambda table: forest(table, distance), "a bigint, b bigint"))
    crowd = crowd.select(F.col("node").alias("fp")).distinct()
    if distance == 2:
        values = crowd.selectExpr("fp", "explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) as v")
        met = values.groupBy("v").agg(F.array_sort(F.collect_set("fp")).alias("g")).where("size(g) > 1")  # 65 at most
        near = near.unionByName(met.selectExpr("g[0] as a", "explode(slice(g, 2, 64)) as b"))
    elif distance == 1:
        values = crowd.selectExpr("fp", "explode(transform(sequence(0, 63), i -> struct(i, fp & ~shiftleft(1L, i)))) as v")
        met = values.groupBy("v").agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
        near = near.unionByName(met.where("a <> b").select("a", "b"))
    return near


def near_duplicates(docs: DataFrame, n_words: int = 5, distance: int = 2, hot: int = 64) -> DataFrame:
    """(doc_id, fp long, component_id): the least doc_id that links reach."""
    marked = save(fingerprints(docs, n_words), "fingerprints")
    distinct = save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = components(links(distinct.select(F.col("fp").alias("node"), "fp"), distance, hot))
    of = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = of.groupBy("label").agg(F.min("least").alias("component_id"))
    return marked.join(of.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def shingle_sets(texts: list[str | None], n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes (signed longs) of the texts' word shingles, one text after the other, and how many each has;
    then the same of their words' hashes as a SimHash print (uint64), and a hash of their word sequences."""
    h, counts = tokens([t or "" for t in texts])
    at, words = np.cumsum(counts) - counts, counts - 1
    doc, place = np.repeat(np.arange(len(counts)), counts), np.arange(len(h)) - np.repeat(at, counts)
    real = place < words[doc]
    folded = np.where(real, h * powers(int(counts.max(initial=0)))[0][place], np.uint64(0))
    nodes = mix64(np.add.reduceat(folded, at)) if len(at) else np.zeros(0, np.uint64)
    window = np.zeros(len(h), np.uint64)
    short = []
    for j in range(n_words):
        upto = max(len(h) - j, 0)
        window[:upto] = mix64(window[:upto] * _STEP + h[j:])
        if j + 1 < n_words:  # a text of fewer words than a shingle is one shingle
            whole = at[words == j + 1]
            short.append((whole, window[whole]))
    for whole, value in short:
        window[whole] = value
    starts = place < np.maximum(words - n_words + 1, np.minimum(words, 1))[doc]
    sets, sizes = _distinct(window[starts].view(np.int64), doc[starts], len(counts))
    prints = np.zeros(len(counts), np.uint64)
    own, many = _distinct(h[real], doc[real], len(counts))
    for first in range(0, len(counts), 32):  # bits take 64 bytes a word
        some = np.flatnonzero(many[first : first + 32]) + first
        if len(some):
            lo = int(many[:first].sum())
            bits = np.unpackbits(own[lo : lo + int(many[some].sum())].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.add.reduceat(bits, np.cumsum([0, *many[some][:-1]]), axis=0, dtype=np.int32)
            prints[some] = np.packbits(sums * 2 > many[some][:, None], axis=1).view(">u8")[:, 0]
    return sets, sizes, prints, nodes


def _distinct(x: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each of n texts, and how many each has; ``doc`` ascends."""
    order = np.lexsort((x, doc))
    x = x[order]
    new = np.append(True, (x[1:] != x[:-1]) | (doc[1:] != doc[:-1]))[: len(x)]
    return x[new], np.bincount(doc[new], minlength=n)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))


def shingles_of(text: str | None, n_words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, as signed longs."""
    return shingle_sets([text], n_words)[0]


def classes(docs: DataFrame, n_words: int, part: int = 8) -> DataFrame:
    """(row, id, node, fp, some) of ``docs`` (row, id, text): node the hash of the text's words, fp of its distinct words, some
    the shingles of one class in ``part``, by hash."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("some", pa.list_(pa.int64()))])

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            sets, sizes, prints, nodes = shingle_sets(batch.column("text").to_pylist(), n_words)
            picked = nodes % np.uint64(part) == 0
            some = _lists(sets[np.repeat(picked, sizes)], np.where(picked, sizes, 0))
            return {"row": batch.column("row"), "id": batch.column("id"), "node": nodes.view(np.int64), "fp": prints.view(np.int64), "some": some}

        return step

    return small_batches(docs).select("row", "id", "text").mapInArrow(over_batches(make, schema), "row bigint, id bigint, node bigint, fp bigint, some array<bigint>")


def matched(edges: DataFrame, values: DataFrame, holds: str, most: int = 500) -> DataFrame:
    """The ``edges`` (a, b) for whose ``values`` (node, v) the SQL condition ``holds``, on x of a and y of b, is true.

    Nodes that are b of more than ``most`` edges are dealt to several tasks.
    """
    deals = edges.groupBy("b").agg(F.expr(f"cast(count(*) div {int(most)} + 1 as int)").alias("deals"))
    right = values.join(deals, values["node"] == deals["b"]).select("b", "deals", F.col("v").alias("y"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    left = edges.join(deals, "b").withColumn("deal", F.pmod(F.xxhash64("a"), F.col("deals")).cast("int")).select("a", "b", "deal")
    left = left.join(values.select(F.col("node").alias("a"), F.col("v").alias("x")), "a")
    return left.join(right, ["b", "deal"]).where(holds).select("a", "b")


def alike(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``edges`` (a, b) whose sets (node, v) have a Jaccard similarity of ``similarity`` or more."""
    return matched(edges, sets, f"size(array_intersect(x, y)) >= {similarity / (1 + similarity)!r}D * (size(x) + size(y)) - 1e-9D")


def sets_of(texts: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """(node, v) of the classes ``wanted`` (row, node), which are few: v the sorted shingles; ``texts`` is (row, text)."""
    schema = pa.schema([("node", pa.int64()), ("v", pa.list_(pa.int64()))])

    def make():
        return lambda batch: {"node": batch.column("node"), "v": _lists(*shingle_sets(batch.column("text").to_pylist(), n_words)[:2])}

    _, rows = bounded(wanted, "wanted", 500_000)
    few = small_batches(texts).join(rows, "row").select("node", "text").dropDuplicates(["node"])
    return save(few.mapInArrow(over_batches(make, schema), "node bigint, v array<bigint>"), "shingles")


def prefix_sizes(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Of sets of one order, how many first members any set of ``similarity`` or more must share one of."""
    return np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-6).astype(np.int64) + 1, 0)


def prefixes(texts: DataFrame, marked: DataFrame, n_words: int, similarity: float, most: int = 400_000) -> DataFrame:
    """(node, n, prefix) of every text: n the size of its set, prefix its first shingles, in the order of how often they are seen in a part of
    the classes (the ``most`` commonest only), then of their hashes."""
    part = marked.where("size(some) > 0").dropDuplicates(["node"])
    often = part.select(F.explode("some").alias("x")).groupBy("x").count().where("count > 1").orderBy(F.desc("count"), "x").limit(most).toPandas().sort_values("x")
    shared = texts.sparkSession.sparkContext.broadcast((often["x"].to_numpy(np.int64), often["count"].to_numpy(np.int32)))  # ``most`` rows of 12 bytes at most
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64()))])

    def make():
        common, counts = shared.value

        def step(batch: pa.RecordBatch) -> dict:
            sets, sizes, _, nodes = shingle_sets(batch.column("text").to_pylist(), n_words)
            seen = np.zeros(len(sets), np.int32)
            if len(common):
                at = np.minimum(np.searchsorted(common, sets), len(common) - 1)
                seen = np.where(common[at] == sets, counts[at], 0)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((sets, seen, doc))
            keep = prefix_sizes(sizes, similarity)
            first = np.arange(len(sets)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(keep, sizes)
            return {"node": nodes.view(np.int64), "n": pa.array(sizes, pa.int32()), "prefix": _lists(sets[order][first], keep)}

        return step

    found = small_batches(texts).select("text").mapInArrow(over_batches(make, schema), "node bigint, n int, prefix array<bigint>")
    return save(found.where("n > 0"), "prefixes")


def labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """``rows`` with the label of their node, by what ``edges`` connect."""
    of = components(edges).select("node", F.col("label").alias("least"))
    return rows.drop("label").join(of, "node", "left").withColumn("label", F.coalesce("least", "node")).drop("least")


def apart(rows: DataFrame, similarity: float) -> DataFrame:
    """The ``rows`` (x, node, label, n, i) whose shingle x is also in a row of another label, as far as enough can follow it to be alike to the smallest set that has it."""
    by = rows.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least")).where("lo <> hi").select("x", "least")
    return save(rows.join(by, "x").where(f"n - i >= {similarity / (1 + similarity)!r}D * (n + least) - 1e-6D").drop("least"), "apart")


def crossings(rows: DataFrame) -> tuple[int, int]:
    """Number of ``rows``, and of pairs of rows with one shingle and unlike labels."""
    by = rows.groupBy("x", "label").agg(F.count("*").alias("k")).groupBy("x").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("s"))
    n, pairs = by.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("s")) / 2), F.lit(0.0))).first()
    return n, int(pairs)


def meetings(firsts: DataFrame) -> DataFrame:
    """(x, node, n, i) of the shingles that are among the first of two classes or more; i is a shingle's place in its class's order.

    The shingles are counted first (pre-aggregated, so a common one is a row a task), then their rows are fetched.
    """
    several = save(firsts.select("node", F.explode("prefix").alias("x")).groupBy("x").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("x"), "several")
    sweep(firsts.sparkSession)
    rows = firsts.select("node", "n", F.posexplode("prefix").alias("i", "x")).selectExpr("x", "node", "shiftleft(cast(n as bigint), 32) + i as ni")
    rows = rows.join(several, "x", "left_semi").dropDuplicates(["x", "node"])
    rows = save(rows.selectExpr("x", "node", "cast(shiftright(ni, 32) as int) n", "cast(ni & 4294967295L as int) i"), "meetings")
    discard(several)
    return rows


def rest_of(linked: DataFrame, distinct: DataFrame, texts: DataFrame, marked: DataFrame, n_words: int, similarity: float, turns: int = 3, few: int = 4) -> DataFrame:
    """Edges (a, b) that, with ``linked``, connect all classes of ``similarity`` or more. The classes that meet on a shingle are
    compared with one of them at a time until at most ``few`` pairs a row are left (``turns`` times at most), then pair by pair."""
    firsts = prefixes(texts, marked, n_words, similarity)
    met = meetings(firsts)
    discard(firsts)
    rows = apart(labelled(met, linked), similarity)
    discard(met)
    fits = f"least(l.n - l.i, r.n - r.i) >= {similarity / (1 + similarity)!r}D * (l.n + r.n) - 1e-6D"  # what can follow the first shared shingle, itself included
    found = linked

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = save(pairs.distinct(), "pairs")
        nodes = distinct.select("row", "node").join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node")
        sets = sets_of(texts, nodes, n_words)
        sweep(texts.sparkSession)
        sure = save(alike(pairs, sets, similarity), "alike")
        discard(pairs, sets)
        return sure

    for turn in range(turns):
        n, pairs = crossings(rows)
        if turn and pairs <= few * n:
            break
        # first the class that has least of its own before the shingle, the one that the others were made from; then any
        best = (F.col("i") / F.col("n")) if turn == 0 else F.lit(0.0)
        hubs = rows.groupBy("x").agg(F.min(F.struct(best.alias("o"), F.xxhash64(F.lit(turn), "node").alias("h"), "node", "label", "n", "i")).alias("m")).select("x", "m.*")
        stars = rows.alias("l").join(hubs.alias("r"), "x").where("l.label <> r.label").where(fits)
        found = save(found.unionByName(compared(stars.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))), "found")
        before, rows = rows, apart(labelled(rows, found), similarity)
        discard(before)
    left, right = rows.alias("l"), rows.alias("r")
    on = (F.col("l.x") == F.col("r.x")) & (F.col("l.node") < F.col("r.node")) & (F.col("l.label") != F.col("r.label")) & F.expr(fits)
    found = save(found.unionByName(compared(left.join(right, on).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")))), "found")
    discard(rows)
    return found


def groups(marked: DataFrame, texts: DataFrame, n_words: int, distance: int, hot: int, similarity: float) -> DataFrame:
    """(node, label) of the classes that links between alike texts join; ``texts`` is (row, text)."""
    distinct = save(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.min("row").alias("row")), "distinct")
    prints = distinct.groupBy("fp").agg(F.min("node").alias("node"))  # classes of one print meet at its least one
    same = distinct.join(prints.withColumnRenamed("node", "b"), "fp").select(F.col("node").alias("a"), "b").where("a <> b")
    near = links(prints.select(F.col("fp").alias("node"), "fp"), distance, hot)
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("node").alias(f"{c}n"))
    near = near.join(of("a"), "a").join(of("b"), "b").select(F.col("an").alias("a"), F.col("bn").alias("b"))
    reached = save(components(near.unionByName(same)), "reached")
    sets = sets_of(texts, distinct.join(reached, "node").select("row", "node"), n_words)
    star = save(alike(reached.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")), sets, similarity), "star")
    discard(sets, reached)
    return components(rest_of(star, distinct, texts, marked, n_words, similarity))


def keep_one(docs: DataFrame, n_words: int = 5, distance: int = 2, hot: int = 64, similarity: float = 0.8) -> DataFrame:
    """``docs`` with all columns, of each group the document of least doc_id (then of least text hash).

    Groups are joined by all pairs of texts whose sets of shingles have a Jaccard similarity of ``similarity`` or more; ``distance`` and
    ``hot`` only set what the prints' links find first. Null texts count as empty ones.
    """
    key = free(docs, "_row")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("bigint"), "text"))
    texts = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("bigint").alias("id"), text_of(keyed).alias("text"))
    marked = save(classes(texts, n_words), "classes")
    found = save(groups(marked, texts.select("row", "text"), n_words, distance, hot, similarity), "groups")
    sweep(docs.sparkSession)
    best = marked.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m"))
    best = best.join(found, "node", "left").groupBy(F.coalesce("label", "node").alias("g")).agg(F.min("m").alias("m"))
    return keyed.join(best.select(F.col("m.row").alias(key)), key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
