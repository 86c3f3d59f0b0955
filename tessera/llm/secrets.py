"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns in each text, with their places. The hash of each candidate's secret is aggregated over the
whole corpus by distinct repositories and owners: what many owners hold is a widely copied example, what few
hold looks live. Base candidates (assign, access, hex) are always reported; other long mixed tokens ("generic") are
reported only where their ownership says that they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

KINDS = ["assign", "access", "hex", "generic"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]{24,}", "generic": r"[A-Za-z0-9+/_-]{20,}={0,2}"}
#: Shortest group 2 of assign and shortest access key.
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: A candidate held by more owners than this is a copied example.
MAX_OWNERS = 2
#: Parts that the candidates of one secret are dealt to before they are joined, so that a secret of any frequency is spread.
SALTS = 16


def matches(text: Column, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches: array of (start, stop, value of a group), in code points.

    A text's pieces between the matches and the matches themselves give the places as running sums of lengths.
    """
    pieces, whole, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    steps = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("whole"), values.alias("value"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["piece"])
        stop = start + F.length(x["whole"])
        return F.struct(stop.alias("at"), F.concat(state["found"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value")))).alias("found"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda state: state["found"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def candidates(text: Column) -> Column:
    """All candidates of a text: array of (kind, start, stop, hash of the secret), kinds by their place in KINDS."""

    def of(kind: str, group: int, keep) -> Column:
        kept = F.filter(matches(text, PATTERNS[kind], group), keep)
        return F.transform(kept, lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), F.xxhash64(m["value"]).alias("hash")))

    def mixed(m: Column) -> Column:
        return m["value"].rlike("[0-9]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[a-z]")

    return F.concat(
        of("assign", 2, lambda m: F.length(m["value"]) >= LEAST_ASSIGN), of("access", 0, lambda m: F.length(m["value"]) >= LEAST_ACCESS),
        of("hex", 0, lambda m: F.lit(True)), of("generic", 0, mixed),
    )


def ownership(found: DataFrame) -> DataFrame:
    """n_documents, n_repositories and n_owners of each hash. A hash's rows are first reduced to one for each owner and repository."""
    pairs = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_documents"), F.sum("repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(documents: DataFrame, owner: Column, repository: Column, max_owners: int = MAX_OWNERS) -> DataFrame:
    """doc_id, spans (kind, start, stop, hash, live), one row per row of documents.

    Every text is scanned whole; a null text is empty and has none; a null owner or repository counts as one of its own. A row that
    repeats counts once for each hash, owner and repository. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", owner.alias("owner"), repository.alias("repository"), F.xxhash64(text).alias("text_hash"), candidates(text).alias("found"))
    rows = stored(rows, "secret-candidates")
    some = rows.filter(F.size("found") > 0).dropDuplicates(["doc_id", "text_hash", "owner", "repository"])
    single = some.withColumn("candidate", F.explode("found")).select("doc_id", "text_hash", "owner", "repository", "candidate.*")
    counts = ownership(single).select("hash", "n_owners", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    base = F.lit(KINDS.index("generic"))
    dealt = single.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int"))
    judged = dealt.join(counts, ["hash", "part"]).withColumn("live", F.col("n_owners") <= max_owners).filter((F.col("kind") < base) | F.col("live"))
    by_doc = judged.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "stop", "hash", "live")).alias("spans"))

    def clear(spans: Column) -> Column:  # a generic token that overlaps a base span is that span
        return F.filter(spans, lambda g: (g["kind"] < base) | ~F.exists(spans, lambda s: (s["kind"] < base) & (s["start"] < g["stop"]) & (g["start"] < s["stop"])))

    none = F.array().cast("array<struct<kind:int,start:int,stop:int,hash:bigint,live:boolean>>")
    by_doc = by_doc.withColumn("spans", clear(F.col("spans")))
    keyed = rows.select("doc_id", "text_hash")
    joined = keyed.join(by_doc, keyed["doc_id"].eqNullSafe(by_doc["doc_id"]) & (keyed["text_hash"] == by_doc["text_hash"]), "left")
    return joined.select(keyed["doc_id"], keyed["text_hash"], F.coalesce(by_doc["spans"], none).alias("spans"))


def secret_report(found: DataFrame) -> DataFrame:
    """The counts, digest and text of find_secrets' spans."""
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("generic"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with the union of its spans replaced by mask."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= state["at"], F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.concat(state["out"], piece).alias("out"))

    return F.aggregate(ordered, start, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))


def redact_secrets(documents: DataFrame, owner: Column, repository: Column, max_owners: int = MAX_OWNERS) -> DataFrame:
    """documents with every secret that looks live replaced by a mask; copied examples stay. Columns, rows and null texts stay as they are."""
    found = find_secrets(documents, owner, repository, max_owners)
    live = F.filter("spans", lambda s: s["live"])
    masks = found.withColumn("spans", live).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_hash"])
    rows = documents.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    joined = rows.join(masks, rows["doc_id"].eqNullSafe(masks["doc_id"]) & (rows["text_hash"] == masks["text_hash"]), "left")
    own = F.col("row.text")
    text = F.when(F.col("spans").isNotNull(), redact(F.coalesce(own, F.lit("")), F.col("spans"))).otherwise(own)
    return joined.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in documents.columns])
