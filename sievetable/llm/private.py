"""Personal data by bootstrapped contextual extraction.

Seeds are what the fixed patterns find (addresses, card and phone numbers) and long
hexadecimal secrets. The two tokens before a mention are its lexical pattern. Patterns
and mentioned values form a graph: a pattern is scored by the beliefs in the values it
introduces against all its occurrences in the corpus, a value by the patterns that
introduce it. After some rounds, identifiers that no seed rule knows are taken where a
confident pattern introduces them.

Only DataFrame functions run. No match crosses a line, and regular expressions are
possessive or anchored at the start of a run, so that a very long text costs time in
proportion. Null texts are empty. Repeated rows get the same result. Positions are code
points from 0, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetable.llm.shared import written

KINDS = ["email", "ip", "card", "phone"]
#: The wanted expressions, written so that they never go back over a run; fixed values.
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDED = {"email": "@", "ip": ".", "card": "", "phone": "+"}
SECRET = r"(?<![0-9A-Za-z])(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,64}+(?![0-9A-Za-z])"
TOKEN = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+"

MIN_DIGITS, MIN_LENGTH = 4, 6
#: A text without this has no token of so many digits.
LIKELY = rf"[0-9](?:[^\s0-9]*+[0-9]){{{MIN_DIGITS - 1}}}"
CONTEXT = 64
MIN_SUPPORT, MIN_CONFIDENCE, ROUNDS = 3, 0.5, 3
BROADCAST_PATTERNS = 100_000

SPAN = "array<struct<kind: string, start: int, end: int>>"


def placed(text: Column, expression: str) -> Column:
    """(start, match) of every match, from the pieces between the matches."""
    matches = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    pieces = F.split(text, expression, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, match: string>>").alias("out"))

    def add(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["piece"])
        one = F.array(F.struct(begin.alias("start"), pair["match"].alias("match")))
        return F.struct((begin + F.length(pair["match"])).alias("at"), F.concat(state["out"], one).alias("out"))

    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    inside = F.filter(pairs, lambda p: p["match"].isNotNull())
    return F.aggregate(inside, start, add)["out"]


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    reversed_digits = F.split(F.reverse(digits), "")

    def weight(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).when(n > 4, 2 * n - 9).otherwise(2 * n)

    each = F.transform(F.filter(reversed_digits, lambda d: d != ""), weight)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """What a match must fulfil besides its expression."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        def small(part: Column) -> Column:
            plain = F.ltrim(part, F.lit("0"))
            return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def spans_of(text: Column, kind: str, expression: str) -> Column:
    found = F.filter(placed(text, expression), lambda x: holds(kind, x["match"]))
    spans = F.transform(
        found,
        lambda x: F.struct(
            F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end")
        ),
    )
    none = F.array().cast(SPAN)
    return F.when(F.regexp_like(text, F.lit(expression)), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    """The base spans of all kinds, by kind as listed, then by start."""
    none = F.array().cast(SPAN)
    parts = [
        F.when(F.contains(text, F.lit(NEEDED[k])), spans_of(text, k, EXPRESSIONS[k])).otherwise(none) for k in KINDS
    ]
    return F.concat(*parts)


def other_tokens(text: Column, taken: Column) -> Column:
    """Identifier-like tokens without the punctuation around them, outside the taken spans."""

    def core(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x["match"], "^[^A-Za-z0-9]*", 0))
        value = F.regexp_extract(x["match"], "[A-Za-z0-9](?:.*[A-Za-z0-9])?", 0)
        begin = x["start"] + lead
        return F.struct(
            F.lit(None).cast("string").alias("kind"), begin.alias("start"), (begin + F.length(value)).alias("end")
        )

    def likely(x: Column) -> Column:
        digits = F.length(F.regexp_replace(x["match"], "[^0-9]", ""))
        return (digits >= MIN_DIGITS) & (F.length(x["match"]) >= MIN_LENGTH)

    cores = F.transform(F.filter(placed(text, TOKEN), likely), core)
    free = F.filter(
        cores, lambda c: ~F.exists(taken, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    )
    return F.when(F.regexp_like(text, F.lit(LIKELY)), free).otherwise(F.array().cast(SPAN))


def introduced(text: Column, spans: Column) -> Column:
    """The spans with a digest of their value and the pattern that introduces them."""

    def mention(s: Column) -> Column:
        begin = F.greatest(s["start"] - CONTEXT + 1, F.lit(1))
        left = F.substring(text, begin, s["start"] - begin + 1)
        whole = F.regexp_replace(left, r"\S+$", "")
        tokens = F.array_remove(F.split(F.lower(whole), r"\s+"), "")
        sure = F.when((begin > 1) & (F.size(tokens) > 0), F.slice(tokens, 2, CONTEXT)).otherwise(tokens)
        pattern = F.when(F.size(sure) > 1, F.array_join(F.slice(sure, -2, 2), " "))
        value = F.sha2(F.lower(F.substring(text, s["start"] + 1, s["end"] - s["start"])), 256)
        return F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            value.alias("value"), pattern.alias("pattern"),
        )

    return F.transform(spans, mention)


def occurrences(docs: DataFrame, patterns: DataFrame, text_col: str) -> DataFrame:
    """(pattern, n): how often each pattern stands in the corpus before any token."""
    words = docs.select(F.array_remove(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), "").alias("w"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1))
    )
    rows = words.where(F.size("w") > 2).select(F.explode(pairs).alias("pattern"))
    # Counted before the join, which so meets each different pair once. Digests keep the counts
    # small on disk; that any of 10^10 pairs shares a digest with one of 10^5 patterns has probability below 1e-4.
    counted = rows.groupBy(F.xxhash64("pattern").alias("h")).agg(F.count("*").alias("n"))
    keyed = patterns.withColumn("h", F.xxhash64("pattern"))
    few = patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS
    return counted.join(F.broadcast(keyed) if few else keyed, "h").drop("h")


def scored(graph: DataFrame, counts: DataFrame, belief: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the confident patterns under the beliefs in values."""
    weighed = graph.select("pattern", "value", "m").join(belief, "value")
    sums = weighed.groupBy("pattern", "kind").agg(
        F.sum(F.col("m") * F.col("c")).alias("weight"), F.count_distinct("value").alias("support")
    )
    confidence = F.least(F.lit(1.0), F.col("weight") / F.col("n"))
    return (
        sums.join(counts, "pattern")
        .withColumn("confidence", confidence)
        .where((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE))
        .select("pattern", "kind", "confidence")
    )


def bootstrap(docs: DataFrame, mentions: DataFrame, text_col: str) -> DataFrame:
    """(pattern, kind): the patterns that are confident in the last round."""
    edges = mentions.where("pattern IS NOT NULL").groupBy("pattern", "value", "kind").agg(F.count("*").alias("m"))
    supported = (
        edges.where("kind IS NOT NULL")
        .groupBy("pattern", "kind")
        .agg(F.count_distinct("value").alias("support"))
        .where(F.col("support") >= MIN_SUPPORT)
        .select("pattern")
        .distinct()
    )
    supported = written(supported, "patterns")
    counts = written(occurrences(docs, supported, text_col), "counts")
    graph = written(edges.join(supported, "pattern"), "graph")
    seeds = graph.where("kind IS NOT NULL").select("value", "kind", F.lit(1.0).alias("c")).distinct()
    unknown = graph.where("kind IS NULL").select("pattern", "value").distinct()
    belief = seeds
    for _ in range(ROUNDS - 1):
        patterns = scored(graph, counts, belief)
        doubt = F.exp(F.sum(F.log1p(-F.least(F.lit(0.999), F.col("confidence")))))
        learnt = unknown.join(patterns, "pattern").groupBy("value", "kind").agg((1 - doubt).alias("c"))
        belief = written(seeds.unionAll(learnt.where(F.col("c") >= MIN_CONFIDENCE)), "belief")
    best = scored(graph, counts, belief).groupBy("pattern").agg(F.max(F.struct("confidence", "kind")).alias("best"))
    return best.select("pattern", "best.kind")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text_hash, base (spans of the fixed kinds), spans (all)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    based = first.withColumn("base", base_spans(F.col("text")))
    clear = based.withColumn(
        "secrets",
        F.filter(
            spans_of(F.col("text"), "secret", SECRET),
            lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
        ),
    )
    seeded = clear.withColumn("seeds", F.concat("base", "secrets"))
    others = seeded.withColumn("others", other_tokens(F.col("text"), F.col("seeds")))
    rows = others.select(
        "id", "text_hash", "base", "seeds", introduced(F.col("text"), F.concat("seeds", "others")).alias("mentions")
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "private")
    mentions = rows.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    patterns = written(bootstrap(docs, mentions, text_col), "confident")
    new = (
        mentions.where("kind IS NULL")
        .drop("kind")
        .join(patterns, "pattern")
        .groupBy("row")
        .agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    )
    spans = F.concat("seeds", F.array_sort(F.coalesce("new", F.array().cast(SPAN))))
    return rows.join(new, "row", "left").select(F.col("id").alias(id_col), "text_hash", "base", spans.alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by ``<KIND>``."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        fresh = s["a"] >= state["at"]
        before = F.substring(text, state["at"] + 1, s["a"] - state["at"])
        out = F.when(fresh, F.concat(state["out"], before, F.lit("<"), F.upper(s["k"]), F.lit(">")))
        return F.struct(F.greatest(state["at"], s["b"]).alias("at"), out.otherwise(state["out"]).alias("out"))

    return F.aggregate(
        ordered, zero, add, lambda end: F.concat(end["out"], F.substring(text, end["at"] + 1, F.length(text)))
    )


def mask_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in the texts that hold some."""
    names = docs.columns
    found = find_private(docs, id_col, text_col).where(F.size("spans") > 0)
    keys = found.select(
        F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), F.col("spans").alias("__spans")
    ).dropDuplicates(["__id", "__hash"])
    same = docs[id_col].eqNullSafe(F.col("__id")) & (
        F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == F.col("__hash")
    )
    joined = docs.join(keys, same, "left")
    text = F.when(F.col("__spans").isNotNull(), masked(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).select(*names)
