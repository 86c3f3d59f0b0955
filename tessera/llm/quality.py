"""Quality rules, in DataFrame functions only: counts of a text by itself, and lines that too many documents of a host share.

Lines are normalised (trimmed, lower case, digits as one sign, white space as one blank) and hashed. For each host the distinct documents of a hash are
counted; lines above the limit are boilerplate and are removed; a document that keeps too little is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, let, stored, words

#: Documents of a host that may share a line.
MAX_DOCUMENTS = 100
#: A document is rejected if it keeps fewer words than this, or less than this share of its words.
LEAST_WORDS, LEAST_SHARE = 20, 0.2
SYMBOLS = r"[#*$%&|<>]"
#: A character of a word, and white space inside a line that isn't one blank.
WORD, LOOSE = r"[^\x20\x09-\x0D]", r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
#: Parts that a line's documents are dealt to before it is joined, so that a line of any frequency is spread.
SALTS = 32


def repeated_window_words(own: Column, n: int = 8) -> Column:
    """Words that lie in windows of n words (a power of two) found twice or more in the text, the first included.

    A window's hash joins the hashes of its halves, so that all windows cost a few steps a word. The hashes are compared within the row.
    Most texts repeat none, which the number of distinct hashes tells; for the others, a window is a repeat if its hash has
    the same as its neighbour in sorted order.
    """

    def windows(hashes: Column, size: int = 1) -> Column:
        """Hashes of the windows of n words, given those of size words; what runs over the end is cut."""
        if size == n:
            return F.slice(hashes, F.lit(1), F.size(hashes) - (n - 1))
        joined = F.zip_with(hashes, F.slice(hashes, F.lit(size + 1), F.size(hashes)), lambda a, b: F.xxhash64(a, b))
        return let(joined, lambda h: windows(h, 2 * size))

    def repeats(ordered: Column) -> Column:
        """Starts of the windows whose hash stands beside an equal one."""
        hash_at = lambda k: F.get(ordered, k)["g"]
        twice = F.filter(ordered, lambda x, k: F.coalesce(hash_at(k - 1) == x["g"], F.lit(False)) | F.coalesce(hash_at(k + 1) == x["g"], F.lit(False)))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(starts: Column) -> Column:
        state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, state, lambda s, i: F.struct((i + n).alias("end"), (s["n"] + i + n - F.greatest(s["end"], i)).alias("n")), lambda s: s["n"])

    def counted(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(ordered, lambda x: covered(repeats(x))))

    many = let(F.transform(own, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), counted))
    return F.when(F.size(own) < n, F.lit(0)).otherwise(many).cast("long")


def normalised(text: Column) -> Column:
    """text in lower case, with digits as one sign and the white space inside a line as one blank; a blank may be left at a line's ends."""
    return F.regexp_replace(F.lower(F.regexp_replace(text, LOOSE, " ")), "[0-9]+", "0")


def line_hashes(text: Column) -> Column:
    """hash and n (words) of each line of a text, normalised and trimmed; a line without a word has neither."""
    trimmed = lambda x: F.trim(x)
    one = lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("hash"), F.size(F.split(x, " ")).alias("n")))
    return F.transform(F.split(normalised(text), "\n", -1), lambda x: let(trimmed(x), one))


def text_rules(documents: DataFrame) -> DataFrame:
    """documents with the counts of each text by itself and base_failed. A null text has no words."""
    inner = documents.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    inner = inner.withColumns({"words": words(F.col("text")), "lines": F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))})
    counts = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.array_join("words", "")).cast("long"),
        "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": repeated_window_words(F.col("words")),
    }
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counted = inner.select("row", *[c.alias(n) for n, c in counts.items()]).withColumn("base_failed", failed)
    return counted.select(*[F.col("row")[c].alias(c) for c in documents.columns if c not in counts and c != "base_failed"], *counts, "base_failed")


def _host(host: Column) -> Column:
    return F.coalesce(host.cast("string"), F.lit(""))


def frequent_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """host, hash, n_documents of the lines that more documents of a host hold than max_documents.

    rows: host and lines (of line_hashes), a row for each document. A document names each of its lines once, so that documents are counted
    where they stand and counts alone are shuffled.
    """
    hashes = F.array_distinct(F.transform(F.filter("lines", lambda x: x.isNotNull()), lambda x: x["hash"]))
    single = rows.select("host", F.explode(hashes).alias("hash"))
    return single.groupBy("host", "hash").agg(F.count("*").alias("n_documents")).filter(F.col("n_documents") > max_documents)


def _frequent_of_rows(rows: DataFrame, max_documents: int) -> DataFrame:
    """at, hash, n: the frequent lines of each row, as often as they stand in it. rows: at (a number of the row), host, lines."""
    frequent = frequent_lines(rows, max_documents).select("host", "hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    single = rows.select("at", "host", F.explode("lines").alias("line")).filter(F.col("line").isNotNull())
    dealt = single.select("at", "host", "line.hash", "line.n", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int").alias("part"))
    return dealt.join(frequent, ["host", "hash", "part"], "left_semi").select("at", "hash", "n")


def quality_report(documents: DataFrame, host: Column, max_documents: int = MAX_DOCUMENTS, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, the counts of text_rules, base_failed, n_frequent_words (words of removed lines) and kept, one row per row of documents.

    Each row is a document of its own, whatever its doc_id: repeated rows and rows with a null doc_id count one by one. Null hosts
    are one host. A null text has no words and fails. The texts are read once; what is stored and shuffled are numbers and hashes.
    """
    read = documents.select("doc_id", "text", _host(host).alias("host"), line_hashes(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = stored(text_rules(read).drop("text").withColumn("at", F.monotonically_increasing_id()), "quality")
    removed = _frequent_of_rows(rows, max_documents).groupBy("at").agg(F.sum("n").alias("n_frequent_words"))
    joined = rows.drop("lines").join(removed, "at", "left").withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_frequent_words")
    depleted = (F.col("n_frequent_words") > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return joined.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("at", "host")


def remove_frequent_lines(documents: DataFrame, host: Column, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """documents with their frequent lines removed from text, the rest in order. Null texts stay null; other columns and all rows stay.

    Each row is a document of its own, as in quality_report.
    """
    read = documents.select(F.struct("*").alias("row"), _host(host).alias("host"), line_hashes(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = stored(read.withColumn("at", F.monotonically_increasing_id()), "lines")
    gone = _frequent_of_rows(rows.drop("row"), max_documents).groupBy("at").agg(F.collect_set("hash").alias("gone"))  # lines of one text
    joined = rows.join(gone, "at", "left")
    single = F.split(F.col("row.text"), "\n", -1)
    left = F.filter(single, lambda x, i: ~F.coalesce(F.array_contains("gone", F.get("lines", i)["hash"]), F.lit(False)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in documents.columns])
