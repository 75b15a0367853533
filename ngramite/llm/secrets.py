"""Secret scan: fixed patterns, and a battery of randomness tests for what they miss; DataFrame functions only.

Base spans come from three patterns. Besides, every token of TOKEN that mixes letters and digits is tested against the
hypothesis that it is uniformly random text of its encoding (hex, base32, base36, base62 or base64, inferred from its
characters): chi-squared tests of single characters and of character classes, a runs test about the alphabet's middle, a
test of serial correlation and, against words and paths, tests of neighbours of the same class and of letters that are
common in writing. The smallest p-value counts, times the number of tests. Within each class of lengths the
Benjamini-Hochberg rule finds the tokens for which randomness is rejected: these are ordinary text. However many there
are, its limit stays below the rate, so few random tokens can be rejected. What isn't rejected is a "random" span unless
it overlaps with a base span.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, running_starts, save

#: Fixed patterns of the base kinds, in the order in which spans at the same start are listed.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Only runs that can pass are worth marking: shorter runs fail, and a maximal run is never part of another match.
HEX_LONG = r"(?<![0-9a-f])[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Upper ends of the length classes and their false-discovery rates.
LENGTHS = ((24, 0.01), (32, 0.01), (48, 0.01), (96, 0.01), (None, 0.01))
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_"
#: Letters a to z in a thousand of written English, and the classes of ALPHABET's characters in each alphabet.
WRITTEN = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
SHARES = {16: (10, 6, 0, 0), 32: (6, 26, 0, 0), 36: (10, 26, 0, 0), 62: (10, 26, 26, 0), 66: (10, 26, 26, 4)}
#: p-values are counted in this many steps of log10 down to 1e-16; a token counts by the upper end of its step.
STEPS = 320
MARK, STAND_IN = "\u0001", "\u0002"


def with_matches(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Adds an array column for each pattern: (start, end, word) of its matches in column text, in code points.

    text must not hold MARK. Time grows with a text's length and the number of its matches.
    """
    kept = rows.columns
    for name, pattern in patterns.items():
        pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
        rows = rows.select(*kept, pieces.alias("__p"))
        rows = rows.select(*kept, "__p", F.transform("__p", lambda p: F.length(p).cast("long")).alias("__l"))
        rows = rows.select(*kept, "__p", "__l", F.when(F.size("__l") > 1, running_starts("__l")).otherwise(F.array(F.lit(0).cast("long"))).alias("__s"))
        inside = F.filter(F.arrays_zip("__s", "__l", "__p"), lambda _, i: i % 2 == 1)  # pieces and matches take turns
        found = F.transform(inside, lambda m: F.struct(m["__s"].cast("int").alias("start"), (m["__s"] + m["__l"]).cast("int").alias("end"), m["__p"].alias("word")))
        kept = [*kept, name]
        rows = rows.select(*kept[:-1], found.alias(name))
    return rows


def spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def upper_tail(z: Column) -> Column:
    """1 - the normal distribution at z, by the usual rational approximation (error below 1e-7)."""
    a = F.abs(z)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-a * a / 2.0) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, tail).otherwise(F.lit(1.0) - tail)


def tests(rows: DataFrame) -> DataFrame:
    """Adds n, letters (the alphabet's size) and p to rows with a column word."""
    one_case = ~F.col("word").rlike("[a-z]") | ~F.col("word").rlike("[A-Z]")
    rows = rows.withColumn("__u", F.when(one_case, F.lower("word")).otherwise(F.col("word")))
    letters = F.when(F.col("__u").rlike("^[0-9a-f]+$"), 16).when(F.col("__u").rlike("^[a-z2-7]+$") & ~F.col("word").rlike("[a-z]"), 32).when(F.col("__u").rlike("^[0-9a-z]+$"), 36).when(F.col("__u").rlike("^[0-9A-Za-z]+$"), 62).otherwise(66)
    rows = rows.withColumn("letters", letters)
    code = F.transform(F.split("__u", ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    rows = rows.withColumn("__c", code)
    rows = rows.withColumn("x", F.when(F.col("letters") == 32, F.transform("__c", lambda c: F.when(c >= 10, c - 10).otherwise(c + 24))).otherwise(F.col("__c")))
    n, k = F.col("n").cast("double"), F.col("letters").cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    rows = rows.withColumn("n", F.size("x"))
    square = total(F.transform(F.array_distinct("x"), lambda c: F.pow(F.size(F.filter("x", lambda v: v == c)).cast("double"), F.lit(2.0))))
    rows = rows.withColumn("chi", (k / n * square - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
    groups = ("[^0-9]", "[^a-z]", "[^A-Z]", "[0-9A-Za-z]")

    def part(i: int) -> Column:
        want = n * sum((F.when(F.col("letters") == size, F.lit(s[i] / size)).otherwise(0.0) for size, s in SHARES.items()), F.lit(0.0))
        return F.when(want > 0, F.pow(F.length(F.regexp_replace("__u", groups[i], "")) - want, F.lit(2.0)) / want).otherwise(0.0)

    cells = F.when(k == 66, 3.0).when(k == 62, 2.0).otherwise(1.0)
    third = 2.0 / (9.0 * cells)  # the cube root of chi-squared / cells is nearly normal
    rows = rows.withColumn("classes", (F.cbrt(sum((part(i) for i in range(4)), F.lit(0.0)) / cells) - (1.0 - third)) / F.sqrt(third))
    pairs = lambda f: total(F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x") - 1), f))
    high = lambda v: v * 2 >= F.col("letters")
    above = F.size(F.filter("x", high)).cast("double")
    rows = rows.withColumn("above", above).withColumn("runs", pairs(lambda a, b: (high(a) != high(b)).cast("double")) + 1.0)
    product = 2.0 * F.col("above") * (n - F.col("above"))
    variance = product * (product - n) / (n * n * (n - 1))
    rows = rows.withColumn("run_z", F.when(variance > 0, (F.col("runs") - product / n - 1.0) / F.sqrt(variance)).otherwise(F.lit(9.0)))
    rows = rows.withColumn("mean", total(F.transform("x", lambda v: v.cast("double"))) / n)
    spread = total(F.transform("x", lambda v: F.pow(v - F.col("mean"), F.lit(2.0))))
    serial = pairs(lambda a, b: (a - F.col("mean")) * (b - F.col("mean")))
    rows = rows.withColumn("serial", F.when(spread > 0, (serial / spread + 1.0 / n) * F.sqrt(n)).otherwise(F.lit(9.0)))
    own = lambda of: F.element_at(F.create_map(*(F.lit(v) for size, s in SHARES.items() for v in (size, float(of(size, s))))), F.col("letters"))
    kind = lambda c: F.when(c < 10, 0).when(c < 36, 1).when(c < 62, 2).otherwise(3)
    alike = total(F.zip_with(F.slice("__c", 1, F.size("__c") - 1), F.slice("__c", 2, F.size("__c") - 1), lambda a, b: (kind(a) == kind(b)).cast("double")))
    two, three = (lambda size, s, k=k: sum((c / size) ** k for c in s) for k in (2, 3))
    spread_of = (n - 1) * own(lambda size, s: two(size, s) * (1 - two(size, s))) + 2.0 * (n - 2) * own(lambda size, s: three(size, s) - two(size, s) ** 2)
    rows = rows.withColumn("alike", (alike - (n - 1) * own(two)) / F.sqrt(spread_of))
    common = [math.log(26 * f / sum(WRITTEN)) for f in WRITTEN]
    weights = [0.0] * 10 + common + common + [0.0] * 4
    held = lambda s: [w for a, size in zip((0, 10, 36, 62), s, strict=True) for w in weights[a : a + size]]
    middle = lambda size, s: sum(held(s)) / size
    deviation = lambda size, s: math.sqrt(sum(w * w for w in held(s)) / size - middle(size, s) ** 2)
    written = total(F.transform("__c", lambda c: F.get(F.array(*map(F.lit, weights)), c)))
    rows = rows.withColumn("written", (written - n * own(middle)) / (F.sqrt(n) * own(deviation)))
    least = F.least(*(upper_tail(F.col(c)) for c in ("chi", "classes", "alike", "written")), 2.0 * upper_tail(F.abs("run_z")), 2.0 * upper_tail(F.abs("serial")))
    return rows.withColumn("p", F.least(F.lit(1.0), 6.0 * least)).drop("__u", "__c", "x", "chi", "classes", "above", "runs", "run_z", "mean", "serial", "alike", "written")


def length_class(n: Column) -> Column:
    out = F.lit(len(LENGTHS) - 1)
    for i, (end, _) in reversed(list(enumerate(LENGTHS[:-1]))):
        out = F.when(n < end, i).otherwise(out)
    return out


def rejected(tokens: DataFrame) -> DataFrame:
    """size_class, step: the last step of p-values that the Benjamini-Hochberg rule rejects in each length class.

    tokens(size_class, step, rows): one row a class and step, so a bounded table.
    """
    ordered = Window.partitionBy("size_class").orderBy("step")
    rate = F.element_at(F.array(*(F.lit(q) for _, q in LENGTHS)), F.col("size_class") + 1)
    upto = tokens.withColumn("k", F.sum("rows").over(ordered)).withColumn("m", F.sum("rows").over(Window.partitionBy("size_class")))
    upper = F.pow(F.lit(10.0), (F.col("step") + 1 - STEPS) * (16.0 / STEPS))
    return upto.where(upper <= F.col("k") / F.col("m") * rate).groupBy("size_class").agg(F.max("step").alias("last"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, extra for each row of docs: arrays of (start, kind, end), code points, end exclusive, in order.

    kind is an index into KINDS. Null texts have no spans. Repeated rows and null ids stay; a token in many rows counts
    as often among the p-values. Other columns are not read. An empty table gives an empty result.
    """
    text = F.translate(F.coalesce(docs[text_col], F.lit("")), MARK, STAND_IN)  # in no pattern, of the same length
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("__t"))
    rows = with_matches(rows, "__t", {"__assign": ASSIGN, "__access": ACCESS, "__hex": HEX_LONG, "__token": TOKEN})
    assign = F.filter("__assign", lambda s: F.length(F.regexp_extract(s["word"], ASSIGN, 2)) >= 8)
    access = F.filter("__access", lambda s: s["end"] - s["start"] >= 16)
    base = F.sort_array(F.concat(spans(assign, 0), spans(access, 1), spans(F.col("__hex"), 2)))
    tokens = F.filter("__token", lambda s: s["word"].rlike("[0-9]") & s["word"].rlike("[A-Za-z]"))
    rows = save(rows.select("doc_id", base.alias("base"), tokens.alias("tokens")).withColumn("row", F.monotonically_increasing_id()), "secrets")

    found = rows.where(F.size("tokens") > 0).select("row", F.explode("tokens").alias("s")).select("row", "s.start", "s.end", "s.word")
    step = F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor((F.log10(F.greatest("p", F.lit(1e-16))) + 16.0) * (STEPS / 16.0)))).cast("int")
    found = tests(found).withColumn("size_class", length_class(F.col("n"))).withColumn("step", step)
    found = save(found.select("row", "start", "end", "size_class", "step"), "tokens")
    last = rejected(found.groupBy("size_class", "step").agg(F.count("*").alias("rows")))
    kept = found.join(F.broadcast(last), "size_class", "left").where(F.col("step") > F.coalesce("last", F.lit(-1)))  # last: a row a length class
    extra = save(uncovered(kept.select("row", "start", "end"), rows), "extra")
    discard(found)
    extra = extra.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end"))).alias("extra"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.join(extra, "row", "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def uncovered(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """The tokens(row, start, end) that overlap with none of the base spans of their row: one pass over both in order."""
    base = rows.where((F.size("base") > 0) & (F.size("tokens") > 0)).select("row", F.explode("base").alias("b"))
    base = base.select("row", F.col("b.start").alias("at"), F.lit(1).alias("is_base"), "b.start", "b.end")
    both = tokens.select("row", F.col("end").alias("at"), F.lit(0).alias("is_base"), "start", "end").union(base)
    before = Window.partitionBy("row").orderBy("at", "is_base").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("is_base") == 1, F.col("end"))).over(before)  # of the base spans that start before a token's end
    return both.withColumn("reach", reach).where((F.col("is_base") == 0) & (F.coalesce("reach", F.lit(0)) <= F.col("start"))).select("row", "start", "end")


def counted(spans: Column, kind: int) -> Column:
    """How many spans are of this kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
