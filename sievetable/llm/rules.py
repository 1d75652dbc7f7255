"""Quality rules from the frequency of lines across documents.

Lines are normalised and hashed. For each host (by default the source of a document)
the distinct texts that hold a line are counted; a line in more than ``MAX_SHARE`` of
them, and in ``MIN_TEXTS`` at least, is furniture of the host and is removed, and so is
one in more than ``MAX_TEXTS`` of them, however many texts the host has. A
document with too few words left, or that loses more than half of its words, is
depleted and rejected, as are those that fail the base rules. Exact copies of a text
count once for a host, so that a copied document doesn't make its own lines common.

Only DataFrame functions run. A null text has no words and no lines. A null host is
the host ''. Every row gets its own result, repeated rows the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetable.llm.shared import written

#: The white space that ends a word; fixed values.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_SHARE = 0.0625
MIN_TEXTS, MAX_TEXTS = 20, 1_000


def words_of(text: Column) -> Column:
    """Runs of characters that are no ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def normal_line(line: Column) -> Column:
    """Lower case, digits as 0, single spaces, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE, " ")
    return F.btrim(plain, F.lit(" "))


def real_lines(text: Column) -> Column:
    """The lines that hold a word, in order."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def repeated_words(grams: Column) -> Column:
    """How many words stand in windows that occur twice; ``grams`` are sorted (h, i)."""
    at = F.filter(
        grams,
        lambda g, k: F.coalesce(F.get(grams, k - 1)["h"] == g["h"], F.lit(False))
        | F.coalesce(F.get(grams, k + 1)["h"] == g["h"], F.lit(False)),
    )
    return F.array_sort(F.transform(at, lambda g: g["i"]))


def measured(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One narrow row per document: base figures and (hash, words) of its lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
        text.alias("text"),
        words_of(text).alias("words"),
        real_lines(text).alias("lines"),
    )
    hashed = base.select(
        "id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(
            "lines",
            lambda line: F.struct(
                F.xxhash64(normal_line(line)).alias("h"), F.size(words_of(line)).alias("n")
            ),
        ).alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.transform(
        F.sequence(F.lit(0), F.size("hashes") - 3),
        lambda i: F.struct(
            F.xxhash64(F.get("hashes", i), F.get("hashes", i + 1), F.get("hashes", i + 2)).alias("h"),
            i.alias("i"),
        ),
    )
    none = F.lit([]).cast("array<struct<h: bigint, i: int>>")
    sorted_windows = hashed.withColumn(
        "grams", F.sort_array(F.when(F.size("hashes") >= 3, windows).otherwise(none))
    ).drop("hashes")
    places = sorted_windows.withColumn("places", repeated_words(F.col("grams"))).drop("grams")
    covered = F.transform(
        "places", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - x, F.lit(3))).cast("long")
    )
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return places.withColumn("n_repeat_words", total).drop("places")


def common_lines(rows: DataFrame, max_share: float, min_texts: int, max_texts: int) -> DataFrame:
    """(host, h) of the lines above the limits, each distinct text counted once."""
    texts = rows.select("host", "text_hash", F.array_distinct(F.transform("lines", lambda x: x["h"])).alias("h"))
    texts = texts.dropDuplicates(["host", "text_hash"])
    hosts = texts.groupBy("host").agg(F.count("*").alias("n_texts"))
    counts = texts.select("host", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= min_texts).join(hosts, "host")
    limit = F.least(max_share * F.col("n_texts"), F.lit(max_texts))
    return often.where(F.col("n") > limit).select("host", "h")


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_share: float = MAX_SHARE,
    min_texts: int = MIN_TEXTS,
    max_texts: int = MAX_TEXTS,
) -> DataFrame:
    """One row per document: id, host, text_hash, figures, removed line hashes, kept."""
    rows = written(
        measured(docs, id_col, text_col, host_col).withColumn("row", F.monotonically_increasing_id()), "rules"
    )
    common = common_lines(rows, max_share, min_texts, max_texts)
    lines = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    removed = (
        lines.join(common, ["host", "h"])
        .groupBy("row")
        .agg(F.sum("n").cast("long").alias("n_removed_words"), F.collect_set("h").alias("removed"))
    )
    n, gone = F.col("n_words"), F.coalesce("n_removed_words", F.lit(0).cast("long"))
    base_failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n)
    depleted = (n - gone < MIN_WORDS) | (2 * gone > n)
    return rows.drop("lines").join(removed, "row", "left").select(
        F.col("id").alias(id_col),
        "host",
        "text_hash",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        gone.alias("n_removed_words"),
        F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"),
        base_failed.alias("base_failed"),
        (~base_failed & ~depleted).alias("kept"),
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without rejected rows, the others without the lines above the limits."""
    names = docs.columns
    verdicts = judge(docs, id_col, text_col, host_col).where("kept")
    keys = verdicts.select(
        F.col(id_col).alias("__id"), F.col("host").alias("__host"), F.col("text_hash").alias("__hash"), "removed"
    ).withColumnRenamed("removed", "__removed").dropDuplicates(["__id", "__host", "__hash"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(
        keys,
        docs[id_col].eqNullSafe(F.col("__id"))
        & (F.coalesce(docs[host_col].cast("string"), F.lit("")) == F.col("__host"))
        & (F.xxhash64(text) == F.col("__hash")),
    )
    left = F.array_join(
        F.filter(
            F.split(text, "\n"), lambda line: ~F.array_contains("__removed", F.xxhash64(normal_line(line)))
        ),
        "\n",
    )
    shortened = F.when(F.size("__removed") > 0, left).otherwise(F.col(text_col))
    return joined.withColumn(text_col, shortened).select(*names)
