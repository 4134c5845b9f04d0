"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are spans found by form: e-mail addresses, IP addresses, card numbers (Luhn), phone numbers, and secrets (hexadecimal
runs of 32 digits or more, with letters and digits). A seed induces patterns: the characters that touch it from the left (``mail:``), or else the
word before, and the two words before; the word after; and its shape, which is its text with letters and digits made alike, with the kind whose form and
check it meets as a whole. Candidates are words with a digit or an @, and runs of up to eight digit groups (spaces, brackets and
dashes between) and their parts, less the punctuation around them, that no seed overlaps; a candidate's instance is its text. A run's first and longest part
stands in its context patterns, every part that meets a kind's form and check in shapes: so an identifier that the leftmost match
swallowed together with its neighbour is found, and a number that fails its check is not. On the graph of patterns
and instances, scores go back and forth: a pattern's is the sum of its instances' scores over all that has it in the
corpus (for words: every occurrence of the word or the two), an instance's the mean of its patterns' scores, a seed's 1. After ``rounds``
rounds, patterns with a score of ``confident`` or more, and at least ``support`` distinct seeds, add their candidates as
spans of the pattern's most frequent kind; of two where one holds the other, the longer stays.

Null and empty texts have no spans. Runs of any length are scanned once (possessive patterns). Rows repeat as they come; null ids
are ids like any other. Other columns pass only in ``mask``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from specloom.llm.common import free, save, text_of

#: The kinds of the base, then what else the method marks.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
SECRET = r"(?i)(?<![0-9a-z])(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,}+(?![0-9a-z])"
# Each starts at the last match's end or where no character that could begin it precedes, which is where leftmost matches start.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAYBE = {"email": "contains(text, '@')", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": r"text rlike '[0-9][0-9\\x20-]{12}'", "phone": r"text rlike '\\+[0-9]'"}
# A word with a digit or an @; after one that ends a group of digits, the groups that follow it.
WORD_OF = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CANDIDATE = WORD_OF + r"(?:(?<=[0-9)-])\x20\(?[0-9][0-9().-]*+(?![^\x20\x09-\x0D,;:!?\"'>\]}])){0,7}+"


# What stands before a candidate inside its word: up to an opening sign, or signs.
INNER = r"^([^\x20]*(?:[=:\"'<\[{]|\((?![0-9]))|[^A-Za-z0-9+(@]*)"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(pattern: str, maybe: str = "true") -> str:
    """SQL: array<struct<s,e,m,l,r>> of the leftmost matches in ``text``, in code points, end exclusive; l and r are what stands before and after, 64 code points at most."""
    p = _literal(pattern)
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    total = lambda x: f"aggregate({x}, 0, (x, y) -> x + y)"
    pairs = f"zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (g, m) -> named_struct('g', g, 'm', m))"
    # lengths are summed by blocks of 128, so that many matches in one text stay cheap
    start = f"{total('slice(sums, 1, i div 128)')} + {total('slice(lens, (i div 128) * 128 + 1, i % 128)')} + length(z.g)"
    left = "right(if(length(z.g) < 64 and i > 0, concat(get(ps, i - 1).m, z.g), z.g), 64)"
    right = "left(if(length(get(ps, i + 1).g) < 64, concat(get(ps, i + 1).g, coalesce(get(ps, i + 1).m, '')), get(ps, i + 1).g), 64)"
    one = let(start, "at", f"named_struct('s', at, 'e', at + length(z.m), 'm', z.m, 'l', {left}, 'r', {right})")
    each = f"transform(slice(ps, 1, size(ps) - 1), (z, i) -> {one})"
    sums = f"transform(sequence(0, (size(lens) - 1) div 128), b -> {total('slice(lens, cast(b * 128 + 1 as int), 128)')})".replace("sequence(0, (size(lens) - 1) div 128)", "sequence(0, cast((size(lens) - 1) div 128 as int))")
    found = let(pairs, "ps", let("transform(ps, z -> length(z.g) + coalesce(length(z.m), 0))", "lens", let(sums, "sums", each)))
    found = found.replace("i div 128", "cast(i div 128 as int)")
    return f"if({maybe}, {found}, cast(array() as array<struct<s: int, e: int, m: string, l: string, r: string>>))"


def _luhn(digits: str) -> str:
    value = f"cast(substring({digits}, i, 1) as int)"
    doubled = f"(length({digits}) - i) % 2 = 1"
    return f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + if({doubled}, if({value} > 4, 2 * {value} - 9, 2 * {value}), {value})) % 10 = 0"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _checks(m: str) -> dict[str, str]:
    """SQL: whether a match of a kind's form passes its check; the digits' number is checked before they are summed."""
    return {
        "email": "true",
        "ip": f"forall(split({m}, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(right(concat('000', ltrim('0', x)), 3) as int) <= 255)",
        "card": f"if(length({_digits(m)}) between 14 and 19, {_luhn(_digits(m))}, false)",
        "phone": f"length({_digits(m)}) between 10 and 15",
    }


def base_spans() -> Column:
    """array<struct<s, k, e, m, l, r>> of all kinds of the base, by start, then kind as listed."""
    every = [f"transform(filter({matches(FORMS[k], MAYBE[k])}, z -> {_checks('z.m')[k]}), z -> named_struct('s', z.s, 'k', {i}, 'e', z.e, 'm', z.m, 'l', z.l, 'r', z.r))" for i, k in enumerate(KINDS)]
    return F.expr(f"array_sort(concat({', '.join(every)}))")


def secret_spans() -> Column:
    found = matches(SECRET, "text rlike '[0-9A-Fa-f]{32}'")
    return F.expr(f"transform({found}, z -> named_struct('s', z.s, 'k', {len(KINDS)}, 'e', z.e, 'm', z.m, 'l', z.l, 'r', z.r))")


def _fits(m: str) -> str:
    """SQL: the kind whose form and check a text meets as a whole, or null."""
    whole = {k: f"{m} rlike {_literal('^(?:' + FORMS[k] + ')$')}" for k in KINDS}
    return "case " + " ".join(f"when if({whole[k]}, {_checks(m)[k]}, false) then {i}" for i, k in enumerate(KINDS)) + " end"


_BLANK, _WORD = "[\\\\x20\\\\x09-\\\\x0D]", "[^\\\\x20\\\\x09-\\\\x0D]"


def _patterns(before: str, after: str, m: str, kind: str) -> str:
    """SQL: the lexical patterns of a span: left (what touches it but for opening brackets and quotes, or else the last word), the two words before, the word after."""
    bare = f"lower(regexp_replace({before}, '[(<\\\\[{{\"\\']+$', ''))"
    touch = f"regexp_extract({bare}, '({_WORD}*)$', 1)"
    word = f"regexp_extract({bare}, '({_WORD}+){_BLANK}+$', 1)"
    two = f"regexp_replace(regexp_extract({bare}, '({_WORD}+{_BLANK}+{_WORD}+){_BLANK}+$', 1), '{_BLANK}+', ' ')"
    following = f"lower(regexp_extract({after}, '^[])>}},.;:!?\"\\']*{_BLANK}+({_WORD}+){_BLANK}', 1))"
    left = f"if({touch} <> '', concat('l:', {touch}), if({word} <> '', concat('w:', {word}), null))"
    return f"filter(array({left}, if({touch} = '' and {two} <> '', concat('w:', {two}), null), if({following} <> '', concat('r:', {following}), null)), x -> x is not null)"


def _shape(m: str, kind: str) -> str:
    """SQL: a text with letters and digits made alike, and its kind."""
    return f"concat('s:', {kind}, ':', regexp_replace(regexp_replace({m}, '[0-9]', '9'), '[A-Za-z]+', 'a'))"


def _spans_of_runs(marked: DataFrame) -> DataFrame:
    """(doc_id, h, w, s, e, m, l, r, first) of all parts of candidate runs, bare of the punctuation around them; first: the part begins with the run."""
    parts = "flatten(transform(sequence(0, size(g) - 1), i -> transform(sequence(i, size(g) - 1), j -> named_struct('i', i, 't', array_join(slice(g, i + 1, j - i + 1), ' '), 'b', array_join(slice(g, 1, i), ' ')))))"
    runs = marked.select("doc_id", "h", F.explode("c").alias("c")).select("doc_id", "h", "c.s", "c.l", "c.r", "c.m", F.split("c.m", " ").alias("g"))
    rows = runs.select("doc_id", "h", F.col("s").alias("w"), "l", "r", F.col("m").alias("run"), F.expr(f"inline({parts})")).withColumn("b", F.expr("if(i > 0, concat(b, ' '), '')"))
    inner = f"regexp_extract(t, {_literal(INNER)}, 1)"
    core = "regexp_extract(substring(t, 1 + length(pre)), '^(.*[A-Za-z0-9])', 1)"
    rows = rows.withColumn("pre", F.expr(inner)).withColumn("m", F.expr(core)).withColumn("open", F.expr("startswith(m, '(') and not contains(m, ')')"))
    rows = rows.withColumns({"pre": F.expr("if(open, concat(pre, '('), pre)"), "m": F.expr("if(open, substring(m, 2), m)")}).where("m rlike '[0-9@]'")
    rows = rows.withColumn("at", F.expr("length(b) + length(pre)"))
    return rows.select("doc_id", "h", "w", F.expr("w + at").cast("int").alias("s"), F.expr("w + at + length(m)").cast("int").alias("e"), "m", F.expr("right(concat(l, b, pre), 64)").alias("l"), F.expr("left(concat(substring(run, 1 + at + length(m)), r), 64)").alias("r"), F.expr("i = 0").alias("first"))


NONE = "cast(array() as array<struct<s: int, k: int, e: int, m: string>>)"


def spans(docs: DataFrame, rounds: int = 3, confident: float = 0.8, support: int = 3, hide: int = 0) -> DataFrame:
    """(doc_id, h, base, added): spans as array<struct<s, k, e, m, ...>>, k an index of ALL_KINDS, ``added`` by the method; h is the text's hash.

    With ``hide`` = n, seeds whose text's hash is divisible by n teach nothing and must be found again (``recovered``); they stay in ``base``.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    # the texts are read once for this, and once to count words; what follows holds a row for each seed or candidate, with no text
    marked = save(rows.select("doc_id", F.xxhash64("text").alias("h"), base_spans().alias("base"), secret_spans().alias("secrets"), F.expr(matches(CANDIDATE, "text rlike '[0-9@]'")).alias("c")), "spans")
    some = marked.where("size(base) + size(secrets) + size(c) > 0").dropDuplicates(["doc_id", "h"])
    seeds = some.select("doc_id", "h", F.explode(F.concat("base", "secrets")).alias("z")).select("doc_id", "h", F.lit(None).cast("int").alias("w"), "z.s", "z.e", "z.m", "z.l", "z.r", F.lit(True).alias("first"), "z.k")
    if hide:
        seeds = seeds.where(F.pmod(F.xxhash64("m"), F.lit(hide)) != 0)
    every = seeds.unionByName(_spans_of_runs(some).withColumn("k", F.lit(None).cast("int")))
    # a candidate goes if a seed that begins before its end ends after its start; one document's rows at a time
    rank = F.when(F.col("k").isNull(), F.col("e")).otherwise(F.col("s"))
    upto = W.partitionBy("doc_id", "h").orderBy(rank, F.col("k").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = every.withColumn("reach", F.coalesce(F.max(F.when(F.col("k").isNotNull(), F.col("e"))).over(upto), F.lit(0))).where("k is not null or reach <= s")
    longest = F.rank().over(W.partitionBy("doc_id", "h", "w", "k", "first").orderBy(F.desc("e")))
    every = every.withColumn("whole", F.col("k").isNotNull() | (F.col("first") & (longest == 1))).withColumn("fits", F.coalesce("k", F.expr(_fits("m")))).where("whole or fits is not null")
    context = F.expr(f"if(whole, {_patterns('l', 'r', 'm', 'k')}, cast(array() as array<string>))")
    shape = F.expr(f"if(fits is not null and fits < {len(KINDS)}, array({_shape('m', 'fits')}), cast(array() as array<string>))")
    graph = save(every.select("doc_id", "h", "s", "e", "m", "k", F.explode(F.concat(context, shape)).alias("pattern")), "graph")
    edges = save(graph.groupBy("pattern", "m").agg(F.count("*").alias("n"), F.max(F.col("k").isNotNull().cast("int")).alias("seed")), "edges")
    seen = edges.groupBy("pattern").agg(F.sum("n").alias("followed"), F.sum("seed").alias("seeds")).where(F.col("seeds") >= support)
    seen = save(seen.withColumn("words", F.expr("if(pattern rlike '^[wr]:', substring(pattern, 3), null)")), "seen")
    wanted = seen.where("words is not null").select("words").distinct()
    split = F.split(F.lower("text"), r"[\x20\x09-\x0D]+")
    pairs = rows.select(F.inline(F.arrays_zip(F.concat(F.array(F.lit("")), split).alias("p"), split.alias("w")))).where("w is not null")
    words = pairs.select(F.explode(F.array("w", F.concat("p", F.lit(" "), "w"))).alias("words")).join(wanted, "words", "left_semi").groupBy("words").agg(F.count("*").alias("all"))
    patterns = save(seen.join(words, "words", "left").select("pattern", F.greatest("followed", F.coalesce("all", F.lit(0))).alias("followed")), "patterns")
    scored = edges.join(patterns, "pattern").select("pattern", "m", "n", "seed", "followed")
    value = scored.select("m", F.col("seed").cast("double").alias("v")).groupBy("m").agg(F.max("v").alias("v"))
    score = patterns.select("pattern", F.lit(0.0).alias("score"))
    for _ in range(rounds):
        score = save(scored.join(value, "m").groupBy("pattern").agg((F.sum(F.col("n") * F.col("v")) / F.first("followed")).alias("score")), "scores")
        value = scored.join(score, "pattern").groupBy("m").agg(F.when(F.max("seed") == 1, F.lit(1.0)).otherwise(F.avg("score")).alias("v"))
    kinds = graph.where("k is not null").groupBy("pattern", "k").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.max(F.struct("n", (-F.col("k")).alias("j"))).alias("top"))
    sure = score.where(F.col("score") >= confident).join(kinds, "pattern").select("pattern", (-F.col("top.j")).cast("int").alias("kind"), "score")
    more = graph.where("k is null").join(sure, "pattern").groupBy("doc_id", "h", "s", "e", "m").agg(F.max(F.struct("score", (-F.col("kind")).alias("j"))).alias("b")).select("doc_id", "h", "s", "e", "m", (-F.col("b.j")).alias("k"))
    within = W.partitionBy("doc_id", "h").orderBy("s", F.desc("e")).rowsBetween(W.unboundedPreceding, -1)
    more = more.withColumn("reach", F.coalesce(F.max("e").over(within), F.lit(0))).where("e > reach").drop("reach").unionByName(seeds.where(F.col("k") >= len(KINDS)).select("doc_id", "h", "s", "e", "m", "k"))
    more = more.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("s", "k", "e", "m"))).alias("added"))  # of one document
    more = save(more, "added").select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), "added")
    base = F.transform("base", lambda z: F.struct(z["s"].alias("s"), z["k"].alias("k"), z["e"].alias("e"), z["m"].alias("m")))
    return marked.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")), "left").select("doc_id", "h", base.alias("base"), F.coalesce("added", F.expr(NONE)).alias("added"))


def recovered(docs: DataFrame, hide: int = 5, **options) -> DataFrame:
    """One row: how many base spans were hidden from the method, and how many of them it found, of the right kind and extent."""
    found = spans(docs, hide=hide, **options)
    hidden = F.filter("base", lambda z: F.pmod(F.xxhash64(z["m"]), F.lit(hide)) == 0)
    again = F.filter(hidden, lambda z: F.exists("added", lambda x: (x["s"] == z["s"]) & (x["e"] == z["e"]) & (x["k"] == z["k"])))
    return found.agg(F.sum(F.size(hidden)).alias("n_hidden"), F.sum(F.size(again)).alias("n_found"))


def mask(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are replaced once, by the first. n_chars, if there, is counted anew."""
    key, marks = free(docs, "_mask_key"), free(docs, "_mask")
    found = spans(docs, **options).select(F.xxhash64("doc_id", "h").alias(key), F.expr("array_sort(concat(base, added))").alias(marks))
    some = found.where(F.size(marks) > 0).dropDuplicates([key])
    names = ", ".join(f"'{k.upper()}'" for k in ALL_KINDS)
    step = f"(a, z) -> if(z.s < a.at, a, named_struct('at', z.e, 'out', concat(a.out, substring(text, a.at + 1, z.s - a.at), '[', element_at(array({names}), z.k + 1), ']')))"
    masked = f"aggregate({marks}, named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring(text, a.at + 1)))"
    out = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("bigint"), F.xxhash64(text_of(docs)))).join(some, key, "left").withColumn("text", F.expr(f"if({marks} is null, text, {masked})"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def listed(column: str) -> str:
    names = ", ".join(f"'{k}'" for k in ALL_KINDS)
    return f"array_join(transform({column}, z -> concat(element_at(array({names}), z.k + 1), ':', z.s, ':', z.e)), ',')"


def op10_bootstrap(spark, sf_dir: str) -> DataFrame:
    found = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.expr(f"cast(size(filter(base, z -> z.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    more = [F.expr("cast(size(added) as bigint)").alias("n_added"), F.expr("cast(size(base) + size(added) as bigint)").alias("n_spans")]
    return found.select("doc_id", *counts, F.expr(f"sha2({listed('base')}, 256)").alias("base_sha256"), F.expr(listed("array_sort(concat(base, added))")).alias("spans"), *more)
