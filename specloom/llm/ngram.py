"""Deleted-interpolation n-gram model.

A text's tokens are its words (A-Z lower-cased) and one end. Maximum-likelihood estimates of orders 1 to n and a
smoothed unigram estimate are mixed; the mixture's weights depend on how often the context of order n was seen (one
bucket for each power of two) and are learned by expectation-maximisation on counts of held-out training texts (one
in ``hold``), which are left out of the estimates while the weights are learned and counted in afterwards.

All n-grams of all training texts are counted. Documents are dealt into chunks by hash; a chunk sends its distinct
n-gram hashes (64 bits) with their counts, pre-aggregated, to buckets by hash range, and each bucket sends back the sums that a
chunk asked for. Where there would be more than ``fan`` buckets or chunks, they meet in levels: a chunk sends to ``fan`` ranges at most, groups
of chunks merge what they send to a range and split it further, and the sums come back the same way. So the messages grow as the
input times the levels, a frequent word is one number a chunk, no task holds more than a chunk, a group's range or a bucket (all of a set size), and
nothing but counts summed over all rows reaches the driver. The held-out statistic is a histogram of bucketed contexts and
likelihood ratios on a logarithmic grid of 1/8 octave, of bounded size.

Null text: as the empty text, which has the end alone. Without training texts the estimate of every token is 1 (log 0).
Rows repeat as they come and count as often; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import crc_mod, hash64, mix64, read_once, save, text_of
from specloom.llm.rolling import Prefix

END, BEGIN = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)
CONTEXT_BUCKETS, GRID = 40, 8
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def tokens(texts: list[str], piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts one after the other, and the number of tokens of each."""
    out, counts = [], np.ones(len(texts), np.int64)
    block: list[bytes] = []
    size = first = 0

    def flush(upto: int) -> None:
        nonlocal first, size
        if not block:
            return
        data = np.frombuffer(b"\n" + b"\n".join(block) + b"\n", np.uint8)
        edges = np.flatnonzero(np.diff(_BLANK[data].astype(np.int8))) + 1
        starts, ends = edges[::2], edges[1::2]
        doc_ends = np.cumsum([len(x) + 1 for x in block])
        words = np.diff(np.searchsorted(starts, doc_ends, side="right"), prepend=0)
        h = np.full(len(starts) + len(block), END, np.uint64)
        if len(starts):
            h[np.arange(len(starts)) + np.repeat(np.arange(len(block)), words)] = Prefix(data).of(starts, ends)
        counts[first:upto] = words + 1
        out.append(h)
        block.clear()
        first, size = upto, 0

    for i, text in enumerate(texts):
        raw = text.encode().lower()
        if size and size + len(raw) > piece:
            flush(i)
        block.append(raw)
        size += len(raw)
    flush(len(texts))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts


def grams(h: np.ndarray, counts: np.ndarray, order: int) -> list[np.ndarray]:
    """Keys of the n-grams of orders 1 to ``order`` that end at each token; the low bit is 0 for words only."""
    at = np.cumsum(counts) - counts
    keys = [mix64(h) & ~np.uint64(1)]
    for k in range(2, order + 1):
        before = np.empty_like(h)
        before[1:] = keys[-1][:-1]
        before[at] = begin(k)
        keys.append(mix64(before * np.uint64(0x9FB21C651E98DF25) + h) | np.uint64(1))
    return keys


def begin(k: int) -> np.uint64:
    """The key of the context of k-1 begins."""
    with np.errstate(over="ignore"):
        return BEGIN * np.uint64(2 * k + 1)


def _pack(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True)


def _unpack(parts: list[tuple[bytes, int]], kind: str) -> np.ndarray:
    found = [np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) for x, n in parts if n]
    return np.concatenate(found) if found else np.zeros(0, kind)


def _texts(table: pa.Table) -> list[str]:
    return table.column("text").to_pylist()


class Model:
    """What the driver knows: totals and mixture weights."""

    def __init__(self, order: int, n: int, v: int, docs: int, weights: np.ndarray):
        self.order, self.n, self.v, self.docs, self.weights = order, n, v, docs, weights

    def parts(self, count_of: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Base probability, ML estimates by order, bucket of the longest context, for each token."""
        base = (count_of[0] + 0.5) / (self.n + 0.5 * (self.v + 1))
        ml = np.zeros((self.order, len(base)))
        ml[0] = count_of[0] / max(self.n, 1)
        context = np.full(len(base), float(self.n))
        for k in range(1, self.order):
            context = np.empty(len(base))
            context[1:] = count_of[k - 1][:-1]
            context[at] = self.docs
            ml[k] = np.divide(count_of[k], context, out=np.zeros(len(base)), where=context > 0)
        bucket = np.minimum(np.frexp(context)[1], CONTEXT_BUCKETS - 1)
        return base, ml, bucket


def learn(cells: list[tuple], order: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, component) by expectation-maximisation; cells: bucket, grid of each order's ratio to the base, count."""
    weights = np.full((CONTEXT_BUCKETS, order + 1), 0.0)
    weights[:, 0] = 1.0
    if not cells:
        return weights
    a = np.array(cells, dtype=float)
    ratio = np.concatenate([np.ones((len(a), 1)), np.where(a[:, 1:-1] <= -999, 0.0, np.exp2(np.clip(a[:, 1:-1], -999, 999) / GRID))], axis=1)
    bucket, n = a[:, 0].astype(int), a[:, -1]

    def em(r: np.ndarray, c: np.ndarray, prior: np.ndarray) -> np.ndarray:
        w = prior.copy()
        for _ in range(rounds):
            share = r * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * c[:, None]).sum(axis=0) + prior  # a prior of one token keeps every weight above zero
            w /= w.sum()
        return w

    pooled = em(ratio, n, np.full(order + 1, 1.0 / (order + 1)))
    for b in range(CONTEXT_BUCKETS):
        mine = bucket == b
        weights[b] = em(ratio[mine], n[mine], pooled) if mine.any() else pooled
    return weights


ASKED, ANSWERED = "p bigint, g bigint, child bigint, keys binary, counts binary", "p bigint, child bigint, f int, n_keys bigint, total binary, fit binary"


class Levels:
    """How chunks and hash ranges meet: ``ranges`` ranges a level, ``group`` chunks or groups a group. A chunk's number and those of
    its groups leave its role when divided by three."""

    def __init__(self, n_chunks: int, n_buckets: int, fan: int):
        self.depth = 1
        while max(n_chunks, n_buckets) > fan**self.depth:
            self.depth += 1
        root = lambda n: next(x for x in range(max(1, int(n ** (1 / self.depth)) - 1), n + 2) if x**self.depth >= n)
        self.ranges, self.group = root(n_buckets), max(2, root(n_chunks))

    def cells(self, level: int, p: int, child: int, keys: np.ndarray, n: np.ndarray) -> pa.Table:
        """What ``child`` sends from range p of ``level`` to the ranges of the next: sorted distinct keys, and their counts if it teaches."""
        limits = np.array([((p * self.ranges + f) << 64) // self.ranges ** (level + 1) for f in range(1, self.ranges)], dtype=np.uint64)
        cut = [0, *np.searchsorted(keys, limits).tolist(), len(keys)]
        some = [f for f in range(self.ranges) if cut[f + 1] > cut[f]]
        to = child // 3 // self.group * 3 + child % 3
        return pa.table({
            "p": pa.array([p * self.ranges + f for f in some], pa.int64()), "g": pa.array([to] * len(some), pa.int64()), "child": pa.array([child] * len(some), pa.int64()),
            "keys": pa.array([keys[cut[f] : cut[f + 1]].tobytes() for f in some], pa.binary()),
            "counts": pa.array([_pack(n[cut[f] : cut[f + 1]].astype(np.int64)) if child % 3 < 2 else b"" for f in some], pa.binary()),
        })

    def answers(self, p: list[int], children: list[int], total: list[np.ndarray], fit: list[np.ndarray | None]) -> dict:
        """Replies from ranges p to the children that asked there, in their keys' order."""
        return {"p": [x // self.ranges for x in p], "child": children, "f": [x % self.ranges for x in p], "n_keys": [len(x) for x in total], "total": [_pack(x) for x in total], "fit": [b"" if x is None else _pack(x) for x in fit]}


def _gathered(table: pa.Table) -> tuple[list[int], list[np.ndarray], list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Of cells: the children, their keys and counts, all keys sorted and distinct, and each child's places among them."""
    children = table.column("child").to_pylist()
    asked = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = [_unpack([(n, len(a))], "i8") if c % 3 < 2 else np.zeros(len(a), np.int64) for c, a, n in zip(children, asked, table.column("counts").to_pylist(), strict=True)]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    return children, asked, counts, keys, np.split(at, np.cumsum([len(x) for x in asked])[:-1])


def _replied(table: pa.Table, which: str) -> np.ndarray:
    """Replies from all ranges, in the order of the keys."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("f", which, "n_keys")), strict=True), key=lambda x: x[0])
    return _unpack([(x, n) for _, x, n in rows], "i8")


def score(docs: DataFrame, train: Column, order: int = 2, hold: int = 10, chunk_bytes: int = 8 << 20, bucket_bytes: int = 16 << 20, fan: int = 512) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score); ``train`` says which documents teach.

    ``chunk_bytes`` and ``bucket_bytes`` are the text sizes that set the numbers of chunks and buckets.
    """
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = known.agg(F.sum(F.octet_length("text")), F.count(F.when(F.col("train"), 1))).first()
    n_chunks, n_buckets = max(8, ceil((size[0] or 0) / chunk_bytes)), max(8, ceil((size[0] or 0) / bucket_bytes))
    levels = Levels(n_chunks, n_buckets, fan)
    dev = F.pmod(hash64(5, F.coalesce("doc_id", F.lit(0))), F.lit(hold)) == 0
    role = F.when(~F.col("train"), 2).when(dev, 1).otherwise(0)  # 0 counts, 1 held out for the weights, 2 is not learned from
    parts = F.greatest(F.lit(1), F.when(F.col("role") == 1, n_chunks // hold).otherwise(n_chunks))
    dealt = known.withColumn("role", role).select("doc_id", "text", (F.pmod(hash64(6, "doc_id", "text"), parts) * 3 + F.col("role")).cast("bigint").alias("chunk"))

    def ask(table: pa.Table) -> pa.Table:
        h, counts = tokens(_texts(table))
        keys, n = np.unique(np.concatenate(grams(h, counts, order)), return_counts=True)
        return levels.cells(0, 0, table.column("chunk")[0].as_py(), keys, n)

    def merge(level: int):
        def run(table: pa.Table) -> pa.Table:
            _, _, counts, keys, at = _gathered(table)
            sums = np.zeros(len(keys), np.int64)
            for a, n in zip(at, counts, strict=True):
                sums[a] += n  # a child asks for a key once
            return levels.cells(level, table.column("p")[0].as_py(), table.column("g")[0].as_py(), keys, sums)

        return run

    def answer(table: pa.Table) -> pa.Table:
        children, _, counts, keys, ats = _gathered(table)
        sums = np.zeros((2, len(keys)), np.int64)
        for child, a, n in zip(children, ats, counts, strict=True):
            if child % 3 < 2:
                sums[child % 3, a] += n
        total = sums.sum(axis=0)
        word = (keys & np.uint64(1)) == 0
        p = table.column("p").to_pylist()
        rows = levels.answers(p, children, [total[a] for a in ats], [sums[0][a] if c % 3 == 1 else None for c, a in zip(children, ats, strict=True)])
        rows = {k: [*v, x] for (k, v), x in zip(rows.items(), (-1, -1, -1, 0, b"", b""), strict=True)}  # and a row for the bucket itself
        own = {"n": int(total[word].sum()), "v": int((total[word] > 0).sum()), "n_fit": int(sums[0][word].sum()), "v_fit": int((sums[0][word] > 0).sum())}
        rows |= {k: [*[0] * len(children), x] for k, x in own.items()}
        return pa.table({k: pa.array(v, {"total": pa.binary(), "fit": pa.binary(), "f": pa.int32()}.get(k, pa.int64())) for k, v in rows.items()})

    def pass_on(left: pa.Table, right: pa.Table) -> pa.Table:
        children, _, _, _, ats = _gathered(left)
        total = _replied(right, "total")
        fit = _replied(right, "fit") if children[0] % 3 == 1 else None
        rows = levels.answers(left.column("p").to_pylist(), children, [total[a] for a in ats], [None if fit is None else fit[a] for a in ats])
        return pa.table({k: pa.array(v, {"total": pa.binary(), "fit": pa.binary(), "f": pa.int32()}.get(k, pa.int64())) for k, v in rows.items()})

    asks = [dealt.groupBy("chunk").applyInArrow(ask, ASKED)]
    for level in range(1, levels.depth):
        with read_once(docs.sparkSession):
            asks[-1] = save(asks[-1], "asked")  # read again on the way back
        asks.append(asks[-1].groupBy("p", "g").applyInArrow(merge(level), ASKED))
    with read_once(docs.sparkSession):
        replies = save(asks[-1].groupBy("p").applyInArrow(answer, ANSWERED + ", n bigint, v bigint, n_fit bigint, v_fit bigint"), "counts")
    sums = replies.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_fit", "v_fit"))).first()
    fit_docs = known.where(F.col("train") & ~dev).count()
    replies = replies.where("child >= 0").select("p", "child", "f", "n_keys", "total", "fit")
    for asked in asks[-2::-1]:
        with read_once(docs.sparkSession):
            replies = save(asked.groupBy("p", "g").cogroup(replies.withColumnRenamed("child", "g").groupBy("p", "g")).applyInArrow(pass_on, ANSWERED), "counts")
    replies = replies.withColumnRenamed("child", "chunk")

    def counted(left: pa.Table, right: pa.Table, which: str) -> tuple[list[np.ndarray], np.ndarray]:
        h, counts = tokens(_texts(left))
        keys = grams(h, counts, order)
        at = np.unique(np.concatenate(keys), return_inverse=True)[1]
        found = _replied(right, which)[at]
        return [x.astype(float) for x in np.split(found, order)] if len(found) else [np.zeros(0)] * order, counts

    draft = Model(order, sums["n_fit"], sums["v_fit"], fit_docs, np.zeros((0, 0)))
    names = [f"g{k}" for k in range(order)]

    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("b", *names, "n")})
        count_of, counts = counted(left, right, "fit")
        base, ml, bucket = draft.parts(count_of, np.cumsum(counts) - counts)
        ratio = np.divide(ml, base, out=np.zeros_like(ml), where=base > 0)
        grid = np.where(ratio > 0, np.rint(GRID * np.log2(np.where(ratio > 0, ratio, 1))), -999).astype(np.int64)
        cells, n = np.unique(np.vstack([bucket[None].astype(np.int64), grid]), axis=1, return_counts=True)
        return pa.table({"b": cells[0], **{k: cells[i + 1] for i, k in enumerate(names)}, "n": n.astype(np.int64)})

    held = dealt.where("chunk % 3 = 1").groupBy("chunk").cogroup(replies.where("chunk % 3 = 1").groupBy("chunk"))
    with read_once(docs.sparkSession):
        cells = held.applyInArrow(histogram, "b bigint, " + ", ".join(f"{k} bigint" for k in names) + ", n bigint").groupBy("b", *names).agg(F.sum("n").alias("n")).collect()
    model = Model(order, sums["n"], sums["v"], size[1], learn(sorted(tuple(r) for r in cells), order))

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        count_of, counts = counted(left, right, "total")
        at = np.cumsum(counts) - counts
        base, ml, bucket = model.parts(count_of, at)
        w = model.weights[bucket]
        p = w[:, 0] * base + sum(w[:, k + 1] * ml[k] for k in range(order))
        by = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)
        return pa.table({"doc_id": left.column("doc_id"), "n_tokens": counts, "n_known": by((count_of[0] > 0).astype(np.int64)).astype(np.int64), "base_score": by(np.log10(base)), "score": by(np.log10(p))})

    out = dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(final, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(int(sums["n"])).cast("bigint"))


def op1_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, crc_mod(docs["doc_id"], 5) != 1)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
