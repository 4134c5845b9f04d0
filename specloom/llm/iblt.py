"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs are lines, long ones cut at the first sentence end after 64 code points (after 256 at the latest), so that
an edit changes only the paragraphs near it. They are hashed to a set of 64-bit digests. Each digest falls into one cell
of each of three tables; a cell holds a count, the xor of its digests and the xor of their check hashes. Subtracting two
sketches cell by cell leaves the digests that differ, which peeling recovers: a cell with count one and a fitting check
is a digest, which is then taken out of its other cells. If cells remain, larger sketches are made: the
digests are split into groups of about four by a further hash, with 12 cells a group; a group that fails again gets 48
cells, then 192, 1,536, and 1,536 by other bits. A group that never peels (chance about 1e-14) is an error: digests are never compared as sets.
``tier`` says how far a pair had to go: 0 first sketches, 1 to 5 the groups' sizes. The fingerprint is the first sketch, 24 cells in hexadecimal, so
it has one size for texts of any length.

Null and empty texts have no paragraphs: all cells zero, and they are alike to each other (1.0). The number of times
that a paragraph occurs does not matter. Rows with equal doc_id follow one another in the order of their texts' hashes; null
ids come after all others. Ids may have any value. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.llm.common import text_of

PARAGRAPH = r"[^\n]{1,64}[^\n.!?]{0,192}[.!?]*"
#: Cells' bits a table and the first digest bit used, of the sketches that a group of digests is retried with.
TIERS = ((2, 0), (4, 0), (6, 0), (9, 0), (9, 27))


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _hit(x: str, bits: str, skip: str) -> str:
    """SQL: whether digest x falls into cell i of three tables of 2**bits cells each."""
    w = f"shiftleft(1, {bits})"
    return f"(shiftrightunsigned({x}, cast({skip} + (i div {w}) * {bits} as int)) & ({w} - 1)) = i % {w}"


def _cells(digests: str, bits: str = "3", skip: str = "0") -> str:
    """Cells of three tables of 2**bits each."""
    return f"transform(sequence(0, 3 * shiftleft(1, {bits}) - 1), i -> aggregate(filter({digests}, x -> {_hit('x', bits, skip)}), named_struct('c', 0, 'k', 0L, 'h', 0L), (s, x) -> named_struct('c', s.c + 1, 'k', s.k ^ x, 'h', s.h ^ xxhash64(x))))"


def _less(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('c', p.c - q.c, 'k', p.k ^ q.k, 'h', p.h ^ q.h))"


NONE = "cast(array() as array<bigint>)"


def _peel(cells: str, most: str, bits: str = "3", skip: str = "0", tier: str = "0") -> str:
    """ok, tier, and the digests of the first sketch only (plus) and of the second only (minus); ``most`` digests can differ at most."""
    taken = f"transform(s.cells, (z, i) -> if({_hit('p.k', bits, skip)}, named_struct('c', z.c - p.c, 'k', z.k ^ p.k, 'h', z.h ^ p.h), z))"
    step = f"if(p is null, named_struct('go', false, 'cells', s.cells, 'plus', s.plus, 'minus', s.minus), named_struct('go', true, 'cells', {taken}, 'plus', if(p.c > 0, concat(s.plus, array(p.k)), s.plus), 'minus', if(p.c < 0, concat(s.minus, array(p.k)), s.minus)))"
    pure = "get(filter(s.cells, z -> abs(z.c) = 1 and z.h = xxhash64(z.k)), 0)"
    end = f"named_struct('ok', forall(s.cells, z -> z.c = 0 and z.k = 0 and z.h = 0), 'tier', {tier}, 'plus', s.plus, 'minus', s.minus)"
    return f"aggregate(sequence(1, greatest(1, least(3 * shiftleft(1, {bits}), {most}))), named_struct('go', true, 'cells', {cells}, 'plus', {NONE}, 'minus', {NONE}), (s, n) -> if(s.go, {_let(pure, 'p', step)}, s), s -> {end})"


def _group(a: str, b: str) -> str:
    """Differences of two small sets by sketches of growing size."""
    tiers = "array(" + ", ".join(f"named_struct('bits', {bits}, 'skip', {skip}, 'tier', {i})" for i, (bits, skip) in enumerate(TIERS, 1)) + ")"
    retry = _peel(_less(_cells(a, "t.bits", "t.skip"), _cells(b, "t.bits", "t.skip")), f"size({a}) + size({b})", "t.bits", "t.skip", "t.tier")
    failed = f"named_struct('ok', cast(raise_error('sketches do not peel') as boolean), 'tier', 9, 'plus', {NONE}, 'minus', {NONE})"
    return f"aggregate({tiers}, named_struct('ok', false, 'tier', 0, 'plus', {NONE}, 'minus', {NONE}), (r, t) -> if(r.ok, r, {retry}), r -> if(r.ok, r, {failed}))"


def difference(cells_a: str, cells_b: str, a: str, b: str) -> Column:
    """struct(ok, tier, plus, minus) from two sketches; ``a`` and ``b`` are the digest sets to make larger sketches of."""
    part = lambda s, salt, n, i: f"filter({s}, x -> pmod(xxhash64(x, {salt}), {n}) = {i})"
    inner = _let(part("ab.b", 1, "g.n1", "g1"), "sb", _let(part("ab.a", 1, "g.n1", "g1"), "sa", f"transform(sequence(0, g.n2 - 1), g2 -> {_let(part('sb', 2, 'g.n2', 'g2'), 'gb', _let(part('sa', 2, 'g.n2', 'g2'), 'ga', _group('ga', 'gb')))})"))
    sizes = "named_struct('n1', cast(ceil(sqrt(n)) as int), 'n2', cast(ceil(n / ceil(sqrt(n))) as int))"
    groups = _let("greatest(1, cast(ceil((size(ab.a) + size(ab.b)) / 4) as int))", "n", _let(sizes, "g", f"flatten(transform(sequence(0, g.n1 - 1), g1 -> {inner}))"))
    joined = "named_struct('ok', true, 'tier', array_max(transform(all, z -> z.tier)), 'plus', flatten(transform(all, z -> z.plus)), 'minus', flatten(transform(all, z -> z.minus)))"
    retry = _let(f"named_struct('a', {a}, 'b', {b})", "ab", _let(groups, "all", joined))
    return F.expr(_let(_peel(_less(cells_a, cells_b), f"size({a}) + size({b})"), "r", f"if(r.ok, r, {retry})"))


def digests(text: str) -> Column:
    return F.expr(f"array_distinct(transform(regexp_extract_all({text}, '{PARAGRAPH}', 0), x -> xxhash64(x)))".replace("\\n", "\\\\n"))


def sketch(column: str) -> Column:
    return F.expr(_cells(column))


def fingerprint(column: str) -> Column:
    """A sketch as text: count (4 digits), digests (16) and checks (16) of each cell."""
    return F.expr(f"lower(array_join(transform({column}, z -> concat(right(lpad(hex(z.c), 16, '0'), 4), lpad(hex(z.k), 16, '0'), lpad(hex(z.h), 16, '0'))), ''))")


def likeness(diff: str, a: str, b: str) -> Column:
    """Twice the shared paragraphs over all of both."""
    n = f"(size({a}) + size({b}))"
    return F.expr(f"if({n} = 0, 1D, cast({n} - size({diff}.plus) - size({diff}.minus) as double) / {n})")


def block_of(docs: DataFrame, block_rows: int, most: int) -> tuple[str, int]:
    """SQL: the number of the block in which a row (doc_id, h) stands by descending id, then h; nulls last. Blocks have about ``block_rows``
    rows, or more if there would be over ``most`` of them; they are cut at sampled quantiles, an id of many rows by h."""
    n, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    n_blocks = max(1, min(most, -(-ids // block_rows)))
    at = [i / n_blocks for i in range(1, n_blocks)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * n_blocks)).alias("c")).first()["c"] if at and ids else []
    cuts = sorted(cuts or [], reverse=True)
    listed = "array(" + ", ".join(_long(c) for c in cuts) + ")" if cuts else "cast(array() as array<bigint>)"
    # the number of cuts above an id, by halving
    step = f"(s, i) -> {_let('cast((s.lo + s.hi) div 2 as int)', 'm', 'if(s.lo >= s.hi, s, if(get(s.cuts, m) > doc_id, named_struct(\'lo\', m + 1, \'hi\', s.hi, \'cuts\', s.cuts), named_struct(\'lo\', s.lo, \'hi\', m, \'cuts\', s.cuts)))')}"
    above = f"aggregate(sequence(1, {len(cuts).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(cuts)}, 'cuts', {listed}), {step}, s -> s.lo)"
    many = {c: k for c in cuts if (k := cuts.count(c)) > 1} if len({*cuts}) < len(cuts) else {}
    share = lambda k: f"cast(floor(h / {float(1 << 63)}D * {k}) as int)"
    within = "case doc_id " + " ".join(f"when {_long(c)} then {share(k)}" for c, k in many.items()) + " else 0 end" if many else "0"
    nulls = max(1, min(most, -(-(n - ids) // block_rows)))
    return f"if(doc_id is null, {len(cuts) + 1} + {share(nulls)}, {above} + {within})", len(cuts) + 1 + nulls


def _long(x: int) -> str:
    return f"cast({x} as bigint)" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def with_next(docs: DataFrame, block_rows: int = 4096, most_blocks: int = 20_000) -> DataFrame:
    """(doc_id, text, ds, sk, next_text, next_ds, next_sk): each document with the next by descending id, after the last the first.

    The order is cut into blocks; each block also gets the first row of the next one as a guest. The driver holds two numbers a block.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.withColumn("o", F.bitwise_not("doc_id")).withColumn("h", F.shiftrightunsigned(F.xxhash64("text"), 1))
    block, _ = block_of(rows, block_rows, most_blocks)
    rows = rows.withColumn("block", F.expr(block))
    first = F.min(F.struct(F.col("o").isNull().alias("none"), "o", "h")).alias("m")
    firsts = [(r["block"], r["m"]["o"], r["m"]["h"]) for r in rows.groupBy("block").agg(first).orderBy("block").collect()]  # a row a block
    guests = [(firsts[i - 1][0], *f) for i, f in enumerate(firsts)]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(guests, "of int, b int, mo long, mh long"))  # ``most_blocks`` rows at most, twice
    found = rows.join(wanted, (F.col("block") == F.col("b")) & F.col("o").eqNullSafe(F.col("mo")) & (F.col("h") == F.col("mh")))
    found = found.groupBy("of").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.first("o").alias("o"), F.first("h").alias("h"))
    every = rows.select("block", "doc_id", "text", "o", "h", F.lit(0).alias("guest")).unionByName(found.select(F.col("of").alias("block"), "doc_id", "text", "o", "h", F.lit(1).alias("guest")))
    every = every.withColumn("ds", digests("text")).withColumn("sk", sketch("ds"))
    by = W.partitionBy("block").orderBy("guest", F.asc_nulls_last("o"), "h", "text")
    cols = [F.lead(c).over(by).alias(f"next_{c}") for c in ("text", "ds", "sk")]
    return every.select("guest", "doc_id", "text", "ds", "sk", *cols).where("guest = 0").drop("guest")


def fingerprints(docs: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Sketches of the texts and of their edited texts, with the paragraph digests in which they and the next ones differ."""
    rows = with_next(docs, block_rows).withColumn("n_chars", F.length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))"))
    rows = rows.withColumn("eds", digests("edited")).withColumn("esk", sketch("eds"))
    return rows.withColumn("to_edited", difference("sk", "esk", "ds", "eds")).withColumn("to_next", difference("sk", "next_sk", "ds", "next_ds"))


def op2_iblt(spark, sf_dir: str) -> DataFrame:
    rows = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint("sk").alias("fingerprint"), fingerprint("esk").alias("edited_fingerprint"), likeness("to_edited", "ds", "eds").alias("near_edited"), likeness("to_next", "ds", "next_ds").alias("near_next"), F.greatest("to_edited.tier", "to_next.tier").alias("tier"))
