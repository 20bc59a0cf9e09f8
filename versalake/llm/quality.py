"""Quality rules (operator 9), DataFrame functions only.

A text's features are its tokens (runs of letters, of digits, of other signs) and its pairs of adjacent tokens, the
last token pairing with the end; each is hashed into `BUCKETS` buckets. Two multinomials are counted: over the trusted
documents (labelled quality 1 and not toxic) and over the whole raw corpus, smoothed by `SMOOTH` a bucket. A
document's score is the mean over its features of the log-likelihood ratio, trusted to raw, in whole micro-nats: sums
of whole numbers don't depend on their order, so the verdict (score >= threshold) is the same in every run.

Counting explodes features under a partial aggregation (a row per bucket and task goes through the shuffle); scoring
joins the same features with the model, which has BUCKETS rows at most whatever the corpus and is therefore broadcast,
and sums per text. Trusted ids are broadcast only up to `MOST_IDS`; beyond that the join is shuffled.

Base rules: fewer than `MIN_WORDS` words, or over `REPEATED` percent of the words in repeated 5-word windows, fail.
Null text has no words and fails. A text without a feature (no sign but blanks) fails likewise. Without trusted
documents every ratio is that of an even target; an empty table gives an empty one. Equal texts get equal verdicts;
rows that repeat stay. Columns are (doc_id, base columns, score, kept); others of the input are ignored unless kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versalake.llm.common import BLANKS, written

BUCKETS, SMOOTH, MOST_IDS = 1 << 16, 1.0, 1_000_000
MIN_WORDS, REPEATED, WINDOW = 10, 20, 5
#: Lowest mean log-likelihood ratio that is kept, in nats a feature.
THRESHOLD = -0.5
#: What `WORD` leaves between words.
BLANK_RUN = r"[\x20\x09-\x0D]+"
TOKEN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once: a lambda's body would evaluate it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def adjacent(docs: DataFrame, *keep: Column, text: str = "text") -> DataFrame:
    """(kept columns, one, two), a row per token: the buckets of the token and of its pair with the next one. Tokens
    are laid out before they are hashed, so hashing is compiled code over rows."""
    cut = docs.select(*keep, F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0).alias("_tokens"))
    kept = [c for c in cut.columns if c != "_tokens"]
    next_ = F.slice("_tokens", 2, F.greatest(F.size("_tokens"), F.lit(1)))
    rows = cut.select(*kept, F.explode(F.arrays_zip(F.col("_tokens").alias("a"), next_.alias("b"))).alias("_pair"))
    bucket = lambda h: h.bitwiseAND(BUCKETS - 1).cast("int")
    return rows.select(*kept, bucket(F.xxhash64("_pair.a")).alias("one"), bucket(F.xxhash64("_pair.a", F.coalesce("_pair.b", F.lit(" ")))).alias("two"))


def features(docs: DataFrame, *keep: Column, text: str = "text") -> DataFrame:
    """(kept columns, bucket), a row per feature."""
    rows = adjacent(docs, *keep, text=text)
    return rows.select(*(c for c in rows.columns if c not in ("one", "two")), F.explode(F.array("one", "two")).alias("bucket"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    ids = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_trusted")).distinct()
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def model(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, ratio): the log-likelihood ratio of each bucket that occurs, in micro-nats."""
    flagged = docs.select("doc_id", text).join(trusted_ids(labels), F.col("doc_id") == F.col("_trusted"), "left")
    counts = features(flagged, F.col("_trusted").isNotNull().cast("long").alias("_good"), text=text)
    counts = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("_good").alias("good"))
    counts = written(counts, "quality-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).first()
    raw, good = (total.raw or 0) + SMOOTH * BUCKETS, (total.good or 0) + SMOOTH * BUCKETS
    ratio = F.log((F.col("good") + SMOOTH) / good) - F.log((F.col("raw") + SMOOTH) / raw)
    return counts.select("bucket", F.round(ratio * 1e6).cast("long").alias("ratio"))


def repeated(words: Column) -> Column:
    """Words in 5-word windows that occur twice or more in the text. Windows are compared by 64-bit hashes."""

    def covered(starts: Column) -> Column:
        # Starts in order: each covers WINDOW words, less what the next one covers.
        gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def neighbours(pairs: Column) -> Column:
        same = F.filter(pairs, lambda p, i: F.coalesce((F.get(pairs, i - 1)["h"] == p["h"]), F.lit(False)) | F.coalesce((F.get(pairs, i + 1)["h"] == p["h"]), F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda p: p["i"])), covered)

    def windows(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(pairs), neighbours))

    def of(codes: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(0), F.size(codes) - WINDOW), lambda i: F.xxhash64(*(F.get(codes, i + j) for j in range(WINDOW)))), windows)

    return F.when(F.size(words) > WINDOW, let(F.transform(words, lambda w: F.xxhash64(w)), of)).otherwise(F.lit(0)).cast("long")


def base(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    said = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(*keep, said.alias("_text"), F.array_remove(F.split(said, BLANK_RUN), "").alias("_words"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    got = cut.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated(F.col("_words")).alias("n_repeat_words"),
    )
    return got.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")))


def scores(docs: DataFrame, ratios: DataFrame, text: str = "text") -> DataFrame:
    """(h1, h2, score): the mean ratio in nats of every distinct text with a feature."""
    keys = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]
    rows, names = adjacent(docs, *keys, text=text), ("one", "two")
    for n in names:
        rows = rows.join(F.broadcast(ratios.select(F.col("bucket").alias(n), F.col("ratio").alias(f"r_{n}"))), n, "left")
    total = sum((F.coalesce(f"r_{n}", F.lit(0)) for n in names), F.lit(0))
    sums = rows.groupBy("h1", "h2").agg(F.sum(total).alias("_sum"), (2 * F.count(F.lit(1))).alias("_n"))
    return sums.select("h1", "h2", (F.col("_sum") / F.col("_n") / F.lit(1e6)).alias("score"))


def judge(docs: DataFrame, ratios: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """doc_id, base columns, base_failed, score, kept for every document."""
    # Null texts have no score; they are spread by doc_id, for one hash of all of them would meet in one task.
    known = lambda h: F.when(F.col(text).isNotNull(), h).otherwise(F.xxhash64(F.lit("null"), "doc_id"))
    rows = docs.select("doc_id", text, known(F.xxhash64(text)).alias("h1"), known(F.xxhash64(F.lit("text"), text)).alias("h2"))
    rows = base(rows, "doc_id", "h1", "h2", text=text)
    got = rows.join(scores(docs, ratios, text), ["h1", "h2"], "left").drop("h1", "h2")
    return got.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
