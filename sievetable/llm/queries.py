"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievetable.llm import (
    bpe,
    chat,
    decontaminate,
    licenses,
    metric,
    minhash,
    pages,
    periods,
    phrases,
    private,
    rules,
    suffixes,
    toxicity,
)
from sievetable.llm.shared import table


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one that spells control strings, read back from the packed streams."""
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], given.schema)
    turns = chat.gathered(given.unionAll(more))
    found = chat.read_back(chat.pack_conversations(turns))
    return turns.select("conv_id", "path").join(found, "path").drop("path")


def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of near-duplicate documents."""
    found = minhash.near_duplicates(table(spark, folder, "documents"), size=3, similarity_pct=85)
    return found.drop("text_hash")


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and template spans of all documents."""
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    joined = {c: F.array_join(F.array_sort(F.array_distinct(c)), ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined)


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in all documents."""
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP4_SQL = """
WITH lowered AS (
    SELECT doc_id, text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), docs AS (
    SELECT doc_id, text, list_filter(string_split_regex(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
    FROM lowered
), items AS (
    SELECT item_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS v
    FROM (SELECT *, least(len(w), 13) AS m FROM items WHERE len(w) > 0) t, unnest(range(1, len(w) - m + 2)) u(i)
), sizes AS (SELECT DISTINCT m FROM windows
), places AS (
    SELECT doc_id, text, m, i, array_to_string(w[i:i + m - 1], ' ') AS v
    FROM docs, sizes, unnest(range(1, len(w) - m + 2)) u(i)
), hits AS (SELECT doc_id, text, item_id, p.m, i FROM places p JOIN windows USING (m, v)
), covered AS (
    SELECT doc_id, text, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, m)) u(j) GROUP BY ALL
), listed AS (
    SELECT doc_id, text, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
    FROM (SELECT DISTINCT doc_id, text, item_id::VARCHAR AS s FROM hits) t GROUP BY ALL
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(joined, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id, text) LEFT JOIN listed USING (doc_id, text)
"""


def op5_private(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents."""
    found = private.find_private(table(spark, folder, "documents"))

    def joined(spans: str) -> Column:
        parts = F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        )
        return F.array_join(parts, ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[counted(kind) for kind in private.KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def op6_line_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures and line frequency verdicts of all documents."""
    judged = rules.judge(table(spark, folder, "documents"))
    return judged.drop("host", "text_hash", "removed")


OP6_SQL = """
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)),
            lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents
), grams AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 2], ' ')) AS n
    FROM docs, unnest(range(1, len(w) - 1)) u(i)
), repeated AS (
    SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM grams, unnest([0, 1, 2]) u(j) WHERE n > 1 GROUP BY r
), normal AS (
    SELECT r, host, t, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'),
            '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line,
        len(list_filter(string_split_regex(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
    FROM docs, unnest(lines) u(line)
), hosts AS (SELECT host, count(DISTINCT t) AS n_texts FROM docs GROUP BY host
), common AS (
    SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM normal GROUP BY ALL) c JOIN hosts USING (host)
    WHERE n >= 20 AND n > least(0.0625 * n_texts, 1000)
), removed AS (SELECT r, sum(n) AS n_removed FROM normal JOIN common USING (host, line) GROUP BY r
), figures AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed_words
    FROM docs LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
        AND n_words - n_removed_words >= 50 AND 2 * n_removed_words <= n_words AS kept
FROM figures
"""


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    found = pages.extract_text(table(spark, folder, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents from their nearest labelled examples."""
    scored = toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of all documents and what they decode to, as digests."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode_texts(table(spark, folder, "documents"), path)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of all documents without repeated strings of 400 bytes.

    A cut may part the bytes of a character; ``text`` has U+FFFD there, ``kept_sha256`` is of the bytes.
    """
    done = suffixes.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op11_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents by an exact Jaccard join."""
    return metric.jaccard_components(table(spark, folder, "documents")).drop("text_hash")


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of every tenth document by its id's hash, with a part of them repeated to the end.

    A document without an id stays as it is.
    """
    n = len(words)
    if doc_id is None or doc_id != doc_id or not n:
        return words
    h = zlib.crc32(str(int(doc_id)).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + i % p] for i in range(n - a))]


def op12_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of repeated words in all documents."""
    found = periods.find_runs(table(spark, folder, "documents"), prepare=looped)
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("longest.n"), -F.col("longest.p")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of each language, from all documents."""
    return phrases.collocations(table(spark, folder, "documents"))


OP13_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w
    FROM documents, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\\x0A-\\x0D]')) u(piece)
), counted AS (
    SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*)::HUGEINT AS f
    FROM pieces, unnest([1, 2, 3]) v(m), unnest(range(1, len(w) - m + 2)) u(i) GROUP BY ALL
), candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1 AND f >= 10
), keyed AS (SELECT lang || ' ' || phrase AS key, f FROM counted
), cuts AS (
    SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:m], ' ') AS two
    FROM candidates, unnest(range(1, m)) u(k)
), scored AS (
    SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f * y.f) AS score
    FROM cuts c JOIN keyed x ON x.key = c.lang || ' ' || c.one JOIN keyed y ON y.key = c.lang || ' ' || c.two
), weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_phrases AS (
    SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longest
    FROM candidates, unnest([1, 2]) u(i) WHERE m = 3 GROUP BY ALL
), totals AS (SELECT lang, sum(f) AS n FROM counted WHERE m = 1 GROUP BY lang
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
    FROM weakest s LEFT JOIN inner_phrases i USING (lang, phrase) WHERE i.longest IS NULL OR 100 * i.longest < 50 * s.a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline; binary ids are left out, their digest stays."""
    return corpus_pipeline.run(spark, folder).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_minhash": op2_minhash,
    "op3_license_scan": op3_license_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_private": op5_private,
    "op6_line_rules": op6_line_rules,
    "op7_main_text": op7_main_text,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_metric_join": op11_metric_join,
    "op12_periods": op12_periods,
    "op13_phrases": op13_phrases,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op6_line_rules": OP6_SQL, "op13_phrases": OP13_SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
