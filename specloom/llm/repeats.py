"""Repeated byte strings by longest-previous-factor arrays.

A byte is repeated if a string of ``length`` bytes that covers it also starts anywhere else. Every such string holds
the hash minimum of its 32-byte substrings at the same offset, so equal strings share that anchor: the text around an
anchor (all strings of which it is the minimum) goes to the anchor's group. Anchors that occur once are dropped by
their counts; equal contexts of an anchor are one representative with a number. In a group's bucket the suffixes at string starts
are put in suffix order to depth ``length`` by prefix doubling (blocks of length/4 bytes in the order of their 64-bit hashes,
doubled twice; suffixes whose rank is their own are discarded), ties by position. There the previous and next smaller
positions of a suffix that ties at full depth stand beside it, so its longest previous factor reaches ``length``
exactly if the suffix before it ties.

The contexts of an anchor with more than ``hot`` different contexts are cut into pieces of 16 strings at fixed offsets from the
anchor, grouped by the hash of what all strings of a piece share; equal pieces of a task are combined before the shuffle.

Passages of words are often shorter than ``length`` bytes and lose nothing. With ``words``, each document's strings of so many words
that another document also has are counted beside (``n_shared``; 0 exactly if the longest factor it shares with another is shorter). Equal strings share an
anchor there too; of anchors met once nothing is read again, of the others each different context once.

Null and empty texts, and texts shorter than ``length``, lose nothing. Texts of any length are whole, also beyond
one block (blocks overlap). Repeated rows are other documents. Other columns are ignored. An empty table gives an
empty result. Matches are by 64-bit hashes of the strings' blocks (chance of a false one about 1e-19 a pair).
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import discard, mix64, over_batches, read_once, save, small_batches, sweep, text_of
from specloom.llm.rolling import Prefix

GRAM, PIECE, WORDS = 32, 16, 16
_BLOCK = 4 << 20  # bytes of a text whose anchors are found at a time
_LOW = np.uint64((1 << 24) - 1)
_WORD = ~np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def anchors(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: anchor hash, offset of the anchor from the run's first start, first start, number of starts."""
    n = len(data) - length + 1
    parts = []
    for at in range(0, n, _BLOCK):
        part = data[at : at + _BLOCK + length - 1]
        h = Prefix(part).all(gram)
        best = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width, span = length - gram + 1, 1
        while span < width:  # minima over windows of doubling width
            step = min(span, width - span)
            best = np.minimum(best[:-step], best[step:])
            span += step
        pos = (best & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(pos, prepend=-1))
        size = np.diff(np.append(first, len(pos)))
        parts.append((h[pos[first]], pos[first] - first, first + at, size))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)


def repeated_starts(data: np.ndarray, base: np.ndarray, span: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts one after the other in ``data`` (beginning at ``base``, of ``span`` string starts each): the starts,
    whether the longest previous factor there reaches ``length``, and whether the longest next one does."""
    quarter = length // 4

    def spread(extra: int) -> np.ndarray:
        n = span + extra
        return np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def ranks(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense ranks by position (-1: discarded or none), the order within equal ranks being that of positions."""
        out = np.full(len(data), -1, np.int64)
        order = np.argsort(keys, kind="stable")
        new = np.append(True, np.diff(keys[order]) != 0) if len(keys) else np.zeros(0, bool)
        rank = np.cumsum(new) - 1
        alone = np.bincount(rank, minlength=1)[rank] == 1 if len(keys) else np.zeros(0, bool)
        out[at[order]] = np.where(alone, -1, rank)
        return out, order

    at = spread(length - quarter)
    level, _ = ranks(Prefix(data).of(at, at + quarter), at)
    for depth in (quarter, 2 * quarter):
        at = spread(length - 2 * depth)
        at = at[(level[at] >= 0) & (level[at + depth] >= 0)]
        level, order = ranks(level[at] * len(data) + level[at + depth], at)
    starts = spread(0)
    previous, following = np.zeros(len(data), bool), np.zeros(len(data), bool)
    suffixes = at[order]
    tied = (np.diff(level[suffixes]) == 0) & (level[suffixes[1:]] >= 0)
    previous[suffixes[1:][tied]] = True
    following[suffixes[:-1][tied]] = True
    return starts, previous[starts], following[starts]


def _runs(flags: np.ndarray, start_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of set flags within rows (``start_of``: each row's first flag): flag index of each run's first and after its last."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[start_of] = edge[-1] = True
    begins = np.flatnonzero(flags & (edge[:-1] | ~np.append(False, flags[:-1])))
    ends = np.flatnonzero(flags & (edge[1:] | ~np.append(flags[1:], False))) + 1
    return begins, ends


def word_hashes(text: str) -> np.ndarray:
    """Of a text's words, in order."""
    data = np.frombuffer(text.encode(), np.uint8)
    edge = np.diff(_WORD[data].astype(np.int8), prepend=0, append=0)
    return Prefix(data).of(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def shared(texts: DataFrame, words: int, deals: int = 8) -> DataFrame:
    """(uid, n_shared) of ``texts`` (uid, text): in how many places a string of ``words`` words starts that another row also has; rows without one are absent."""
    gram = min(WORDS, words)
    found = pa.schema([("uid", pa.int64()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("times", pa.int64()), ("s0", pa.int64()), ("span", pa.int64())])
    sent = pa.schema([("w", pa.int64()), ("ctx", pa.int64()), ("uid", pa.int64()), ("n", pa.int64())])

    def find():
        def step(batch: pa.RecordBatch) -> dict:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in found.names]
            for uid, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "text")), strict=True):
                data = word_hashes(text)
                if len(data) < words:
                    continue
                h, off, s0, span = anchors(data, words, gram)
                ctx = mix64(Prefix(data).of(s0, s0 + span + words - 1) + off.astype(np.uint64) * np.uint64(1 << 20) + span.astype(np.uint64))
                ctx, at, times = np.unique(ctx, return_index=True, return_counts=True)  # a row counts once
                for col, x in zip(out, (np.full(len(at), uid), h[at].view(np.int64), ctx.view(np.int64), times, s0[at], span[at]), strict=True):
                    col.append(x)
            return {k: np.concatenate(x) for k, x in zip(found.names, out, strict=True)}

        return step

    def cut():
        def step(batch: pa.RecordBatch) -> dict:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in sent.names]
            for uid, text, want in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "want")), strict=True):
                h = Prefix(word_hashes(text)).all(words).view(np.int64)
                for w in want:
                    for col, x in zip(out, (h[w["s0"] : w["s0"] + w["span"]], *(np.full(w["span"], v) for v in (w["ctx"], uid, w["n"]))), strict=True):
                        col.append(x)
            return {k: np.concatenate(x) for k, x in zip(sent.names, out, strict=True)}

        return step

    def met_again(rows: DataFrame) -> DataFrame:
        """The rows whose anchor others have too; an anchor's rows are dealt to several tasks by ctx."""
        again = rows.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > 1)
        again = again.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
        return rows.withColumn("deal", F.pmod(F.col("ctx"), F.lit(deals)).cast("int")).join(again, ["anchor", "deal"]).drop("deal")

    with read_once(texts.sparkSession):
        occ = save(texts.select("uid", "text").mapInArrow(over_batches(find, found), "uid bigint, anchor bigint, ctx bigint, times bigint, s0 bigint, span bigint"), "words")
        rows = met_again(occ).groupBy("uid", "ctx").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("anchor", "times", "s0", "span")))  # equal rows have one uid
        rows = save(rows, "rows")
        discard(occ)
        contexts = save(rows.groupBy("ctx").agg(F.sum("n").alias("n"), F.min(F.struct("uid", "s0")).alias("at"), F.first("anchor").alias("anchor"), F.first("span").alias("span")).select("ctx", "n", "at.*", "anchor", "span"), "contexts")
        wanted = met_again(contexts).groupBy("uid").agg(F.collect_list(F.struct("ctx", "n", "s0", "span")).alias("want"))  # at most the document's own anchors
        parts = texts.select("uid", "text").join(wanted, "uid")  # of equal rows all contexts have n > 1
        strings = save(parts.mapInArrow(over_batches(cut, sent), "w bigint, ctx bigint, uid bigint, n bigint"), "strings")
        several = strings.groupBy("w").agg(F.min("uid").alias("a"), F.max("uid").alias("b"), F.max("n").alias("n")).where("a <> b or n > 1").select("w")
        single = strings.where("n = 1").join(several, "w").groupBy("ctx").agg(F.count("*").alias("m"))
        marks = contexts.where("n > 1").select("ctx", F.col("span").alias("m")).unionByName(single)
        out = save(rows.join(marks, "ctx").groupBy("uid").agg(F.sum(F.col("times") * F.col("m")).alias("n_shared")), "shared")
        discard(rows, contexts, strings)
    return out


def repeats(docs: DataFrame, length: int = 400, keep_first: bool = True, bucket_bytes: int = 3 << 20, hot: int = 512, deals: int = 8, words: int = 0) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): ``spans`` the removed runs [from, to) of bytes, ``kept`` the other bytes.

    With ``keep_first`` the copy of least doc_id (then least position) of each repeated string stays. With ``words`` a last column
    n_shared follows: in how many places a string of so many words starts that another document also has, whatever blanks are between the words.
    """
    if length < 2 * GRAM or length % 4:
        raise ValueError(f"length must be a multiple of 4 and at least {2 * GRAM}")
    texts = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    passages = shared(texts, words, deals) if words else None
    found = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("off", pa.int32()), ("s0", pa.int64()), ("span", pa.int32())])

    def find():
        def step(batch: pa.RecordBatch) -> dict:
            out: list[list[np.ndarray]] = [[] for _ in found.names]
            for uid, doc, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text")), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(data) < length:
                    continue
                h, off, s0, span = anchors(data, length)
                ctx = mix64(Prefix(data).of(s0, s0 + span + length - 1) + off.astype(np.uint64) * np.uint64(1 << 20) + span.astype(np.uint64))
                for col, x in zip(out, (h.view(np.int64), ctx.view(np.int64), np.full(len(h), uid), np.full(len(h), doc if doc is not None else np.iinfo(np.int64).max), off, s0, span), strict=True):
                    col.append(x)
            return {k: pa.array(np.concatenate(x) if x else [], found.field(k).type) for k, x in zip(found.names, out, strict=True)}

        return step

    occ = texts.select("uid", "doc_id", "text").mapInArrow(over_batches(find, found), "anchor bigint, ctx bigint, uid bigint, doc_id bigint, off int, s0 bigint, span int")
    occ = save(occ, "anchors")
    contexts = occ.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "uid", "s0")).alias("at"), F.first("off").alias("off"), F.first("span").alias("span"))
    # how often an anchor occurs, and in how many contexts; an anchor's contexts are dealt to several tasks by ctx
    sizes = contexts.groupBy("anchor").agg(F.sum("n").alias("all"), F.count("*").alias("k")).where(F.col("all") > 1)
    dealt = F.pmod(F.col("ctx"), F.lit(deals)).cast("int")
    sizes = sizes.select("anchor", (F.col("k") > hot).alias("hot"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"))
    contexts = contexts.withColumn("deal", dealt).join(sizes, ["anchor", "deal"])
    contexts = save(contexts.select("anchor", "ctx", "n", "at.*", "off", "span", "hot"), "contexts")
    sweep(docs.sparkSession)
    total = contexts.agg(F.sum(F.when(F.col("hot"), (F.col("span") / PIECE + 2) * (length + PIECE)).otherwise(F.col("span") + length))).first()[0] or 0
    buckets = max(8, ceil(total / bucket_bytes))
    wanted = contexts.groupBy("uid").agg(F.collect_list(F.struct("anchor", "ctx", "n", "doc_id", "off", "s0", "span", "hot")).alias("want"))  # at most the document's own anchors
    sent = pa.schema([("bucket", pa.int32()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("s0", pa.int64()), ("rel", pa.int32()), ("span", pa.int32()), ("piece", pa.int64()), ("data", pa.binary())])
    names = ("anchor", "ctx", "n", "doc_id", "off", "s0", "span", "hot")

    def cut():
        def step(batch: pa.RecordBatch) -> dict:
            rows: dict[str, list] = {k: [] for k in sent.names}
            seen: dict[int, list] = {}

            def put(key: int, data: bytes | None, **row) -> None:
                for k, v in row.items():
                    rows[k].append(v)
                rows["bucket"].append(key % buckets)
                rows["data"].append(data)

            for uid, text, want in zip(*(batch.column(c).to_pylist() for c in ("uid", "text", "want")), strict=True):
                raw = text.encode()
                prefix = None
                for w in want:
                    anchor, ctx, n, doc, off, s0, span, is_hot = (w[k] for k in names)
                    if not is_hot:
                        put(anchor, raw[s0 : s0 + span + length - 1], anchor=anchor, ctx=ctx, n=n, doc_id=doc, uid=uid, s0=s0, rel=0, span=span, piece=0)
                        continue
                    prefix = prefix or Prefix(np.frombuffer(raw, np.uint8))
                    at = s0
                    while at < s0 + span:  # the offset from the anchor falls by one with each start
                        to = min(s0 + span, at + (off - (at - s0)) % PIECE + 1)
                        lo = at + (off - (at - s0)) % PIECE + 1 - PIECE  # where a whole piece would begin and end
                        core = int(prefix.of(np.array([lo + PIECE - 1]), np.array([lo + length]))[0])
                        whole = int(prefix.of(np.array([at]), np.array([to + length - 1]))[0])
                        ref = (core, whole, at - lo, to - at)
                        key = (core ^ (anchor & (2**64 - 1))) & (2**63 - 1)
                        first = seen.get(hash(ref))
                        row = {"anchor": anchor, "ctx": ctx, "n": n, "doc_id": doc, "uid": uid, "s0": at, "rel": at - s0, "span": to - at, "piece": (whole ^ ((at - lo) << 8) ^ (to - at)) & (2**63 - 1) | 1}
                        put(key, None if first else raw[at : to + length - 1], **row)
                        seen[hash(ref)] = True
                        at = to
            return rows

        return step

    def suffixes(table: pa.Table) -> pa.Table:
        doc, uid, s0 = (table.column(c).to_numpy() for c in ("doc_id", "uid", "s0"))
        order = np.lexsort((s0, uid, doc))
        raw = table.column("data").to_pylist()
        piece, n, span, rel = (table.column(c).to_numpy() for c in ("piece", "n", "span", "rel"))
        # equal pieces: the first row stands for all
        stands, many, of = {}, {}, {}
        for i in order.tolist():
            key = (int(piece[i]), int(span[i])) if piece[i] else (-1, i)
            if key not in stands:
                stands[key], many[key] = i, 0
            many[key] += int(n[i])
            of[i] = key
            if raw[stands[key]] is None and raw[i] is not None:
                raw[stands[key]] = raw[i]
        keys = list(stands)
        rows = np.array([stands[k] for k in keys], dtype=np.int64)
        data = [raw[i] for i in rows.tolist()]
        base = np.cumsum([0, *map(len, data)])[:-1]
        spans = span[rows].astype(np.int64)
        _, previous, following = repeated_starts(np.frombuffer(b"".join(data), np.uint8), base, spans, length)
        twice = np.repeat(np.array([many[k] > 1 for k in keys]), spans)
        start_of = np.cumsum(spans) - spans
        every, first = {}, {}
        for out, flags in ((every, previous | following | twice), (first, ~previous)):
            begins, ends = _runs(flags, start_of)
            row = np.searchsorted(start_of, begins, side="right") - 1
            for r, x, y in zip(row.tolist(), (begins - start_of[row]).tolist(), (ends - start_of[row]).tolist(), strict=True):
                out.setdefault(r, []).append((x, y))
        number = {k: r for r, k in enumerate(keys)}
        anchor, ctx = table.column("anchor").to_numpy(), table.column("ctx").to_numpy()
        got: dict[str, list] = {k: [] for k in ("anchor", "ctx", "runs", "firsts")}
        for i in order.tolist():
            r = number[of[i]]
            if r in every:
                got["anchor"].append(anchor[i])
                got["ctx"].append(ctx[i])
                got["runs"].append([int(rel[i]) + v for run in every[r] for v in run])
                got["firsts"].append([int(rel[i]) + v for run in first.get(r, []) for v in run] if rows[r] == i else [])
        flat = pa.list_(pa.int32())
        return pa.table({"anchor": pa.array(got["anchor"], pa.int64()), "ctx": pa.array(got["ctx"], pa.int64()), "runs": pa.array(got["runs"], flat), "firsts": pa.array(got["firsts"], flat)})

    parts = texts.select("uid", "text").join(wanted, "uid")
    parts = parts.mapInArrow(over_batches(cut, sent), "bucket int, anchor bigint, ctx bigint, n bigint, doc_id bigint, uid bigint, s0 bigint, rel int, span int, piece bigint, data binary")
    marks = parts.groupBy("bucket").applyInArrow(suffixes, "anchor bigint, ctx bigint, runs array<int>, firsts array<int>")
    marks = save(marks.groupBy("anchor", "ctx").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("firsts")).alias("firsts")), "marks")  # pieces of one context
    sweep(docs.sparkSession)
    hits = occ.join(marks, ["anchor", "ctx"])
    if keep_first:
        rep = contexts.select("anchor", "ctx", F.col("uid").alias("ru"), F.col("s0").alias("rs"))
        hits = hits.join(rep, ["anchor", "ctx"]).withColumn("skip", F.when((F.col("uid") == F.col("ru")) & (F.col("s0") == F.col("rs")), F.col("firsts")).otherwise(F.array().cast("array<int>")))
    else:
        hits = hits.withColumn("skip", F.array().cast("array<int>"))
    by_doc = hits.groupBy("uid").agg(F.collect_set(F.struct("s0", "runs", "skip")).alias("marks"))  # at most the document's own anchors
    final = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept", pa.binary()), *[("n_shared", pa.int64())] * bool(words)])

    def remove():
        def step(batch: pa.RecordBatch) -> dict:
            rows: dict[str, list] = {k: [] for k in final.names}
            if words:
                rows["n_shared"] = batch.column("n_shared").to_pylist()
            for doc, text, marked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
                raw = text.encode()
                rows["doc_id"].append(doc)
                rows["n_bytes"].append(len(raw))
                if not marked:
                    rows["n_removed"].append(0), rows["spans"].append([]), rows["kept"].append(raw)
                    continue
                at = np.zeros(len(raw) + 2, np.int64)
                for m in marked:
                    runs = np.array(m["runs"], np.int64) + m["s0"]
                    np.add.at(at, runs[::2], 1)
                    np.add.at(at, runs[1::2], -1)
                begins = np.cumsum(at[:-1]) > 0
                for m in marked:
                    for x, y in zip(m["skip"][::2], m["skip"][1::2], strict=True):
                        begins[m["s0"] + x : m["s0"] + y] = False
                first = np.flatnonzero(begins & ~np.append(False, begins[:-1]))
                last = np.flatnonzero(begins & ~np.append(begins[1:], False))
                spans: list[list[int]] = []
                for x, y in zip(first.tolist(), (last + length).tolist(), strict=True):
                    if spans and x <= spans[-1][1]:
                        spans[-1][1] = y
                    else:
                        spans.append([x, y])
                kept, to = [], 0
                for x, y in spans:
                    kept.append(raw[to:x])
                    to = y
                rows["kept"].append(b"".join([*kept, raw[to:]]))
                rows["n_removed"].append(sum(y - x for x, y in spans))
                rows["spans"].append([{"from": x, "to": y} for x, y in spans])
            return rows

        return step

    whole = texts.join(by_doc, "uid", "left").select("uid", "doc_id", "text", "marks")
    if words:
        whole = whole.join(passages, "uid", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return whole.drop("uid").mapInArrow(over_batches(remove, final), "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<from: bigint, to: bigint>>, kept binary" + ", n_shared bigint" * bool(words))


def op6_longest_previous_factor(spark, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=400, keep_first=False, words=51)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")
