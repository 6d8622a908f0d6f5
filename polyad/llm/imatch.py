"""I-Match document fingerprints (operator 1), with DataFrame functions only.

Terms are the distinct words of a text, A-Z in lower case. Those whose inverse document frequency, ln(N/df),
lies in a band are kept: neither common words nor rare ones tell a document's topic. Kept terms are hashed
under several randomised lexicons. Each lexicon is nested: level j holds a random 2**-j of all terms, and a
document uses the sparsest level that holds any of its terms, so that few terms decide a hash whatever the
text's length and a few edits leave most hashes alone. A hash is that of the sorted terms in the level.
A fingerprint is the hashes of all lexicons side by side; the likeness of two is the share of equal hashes.
A text without a term in the band is hashed by the same scheme over all its terms; one without words has the
fingerprint zero.

Document frequencies and N count each distinct set of terms once, so that copies of a text don't push its
terms out of the band. The band's rare edge is a share of N, so the band holds at most (mean distinct terms) /
share terms however large the corpus. Where its counted size is within `most_sent`, it is broadcast; beyond, terms
are joined with it by shuffle. The terms of a document are then gathered again; they have never left the
partition of their text if the band was broadcast.

The next document in id order is found without a global sort: ids are cut at quantiles into buckets, an id that
many rows have also by hashes of their texts; each bucket is sorted for itself, and the first rows of the
following bucket are lent to its end. There are four buckets for each shuffle partition, so they do not grow with
the table.

Defined results: null texts count as empty and null ids as the least; rows of equal id are in the order of
hashes of their texts; the table's last row is followed by its first; a single row is followed by itself; repeated
rows follow one another; other columns are ignored; an empty table gives none; texts may be of any length.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyad.llm.common import lower_col, materialize, shuffle_partitions, table

LEXICONS = 16
_LEAST = -(2**63)


def terms(text: Column) -> Column:
    """Hashes of the distinct words."""
    spaced = F.translate(lower_col(text), "\t\n\x0b\x0c\r", "     ")
    return F.transform(F.array_distinct(F.filter(F.split(spaced, " "), lambda w: w != "")), lambda w: F.xxhash64(w))


def band(texts: DataFrame, common: float = 0.01, rare: float = 0.0005) -> DataFrame:
    """`(h)`: hashes of the terms of the column `text` whose frequency among the distinct sets of terms lies in the band."""
    found = texts.select(terms(F.col("text")).alias("ts")).withColumn("key", F.xxhash64(F.array_sort("ts")))
    sets = materialize(found.groupBy("key").agg(F.first("ts").alias("ts")), "term-sets")
    n = sets.count()
    low, high = max(2.0, n * rare), max(10.0, n * common)
    return sets.select(F.explode("ts").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where(F.col("df").between(low, high)).select("h")


def _hash(kept: Column, i: int) -> Column:
    """The hash of lexicon i, 8 hexadecimal digits."""
    keys = F.transform(kept, lambda t: F.shiftrightunsigned(F.xxhash64(t, F.lit(i)), 1))

    def of(ks: Column) -> Column:
        least = F.array_min(ks)
        level = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(least)))  # the power of two above the least of keys of 63 bits
        return _let(level, lambda top: F.xxhash64(F.array_sort(F.filter(ks, lambda k: (k < top) | (top <= 0)))))

    return F.lpad(F.lower(F.hex(_let(keys, of).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def _let(value: Column, use) -> Column:
    """`use(value)`, where the value is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(kept: Column, every: Column, lexicons: int = LEXICONS) -> Column:
    """`kept`: hashes of the terms in the band; `every`: of all terms, which count where none is in the band."""
    used = F.when(F.size(kept) > 0, kept).otherwise(every)
    return _let(used, lambda ts: F.when(F.size(ts) == 0, F.lit("0" * 8 * lexicons)).otherwise(F.concat(*[_hash(ts, i) for i in range(lexicons)])))


def likeness(a: Column, b: Column, lexicons: int = LEXICONS) -> Column:
    same = [(F.substring(a, 8 * i + 1, 8) == F.substring(b, 8 * i + 1, 8)).cast("double") for i in range(lexicons)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / lexicons


def bounds(cuts: list[int]) -> list[tuple[int, int]]:
    """Places (key, hash) where buckets begin, from quantiles of keys; a key that is several quantiles is cut by hashes as well."""
    out = []
    for key, n in sorted(Counter(cuts).items()):
        if key > _LEAST:
            out.append((key, _LEAST))
        if n > 1:
            out += [(key, _LEAST + 2**64 * i // n) for i in range(1, n)] + ([(key + 1, _LEAST)] if key < 2**63 - 1 else [])
    return sorted(set(out))


def _bucket(found: list[tuple[int, int]]) -> Column:
    """How many of the bounds are at or below (key, h): first among every n-th, then among those that follow it."""
    if not found:
        return F.lit(0)
    step = int(len(found) ** 0.5) + 1
    kind = "array<struct<k: bigint, h: bigint>>"
    rows = lambda some: "[" + ",".join('{"k":%d,"h":%d}' % x for x in some) + "]"
    here = F.struct(F.col("key").alias("k"), F.col("h").alias("h"))
    below = lambda array: F.size(F.filter(array, lambda b: b <= here))
    coarse = F.from_json(F.lit(rows(found[::step])), kind)
    fine = F.from_json(F.lit("[" + ",".join([rows([])] + [rows(found[i + 1 : i + step]) for i in range(0, len(found), step)]) + "]"), f"array<{kind}>")
    return _let(below(coarse), lambda c: F.when(c == 0, F.lit(0)).otherwise(1 + (c - 1) * step + below(F.element_at(fine, c + 1)))).cast("int")


def _in_order(rows: DataFrame, buckets: int) -> tuple[DataFrame, Window]:
    """`rows(key, text)` with `bucket` and `guest`; in each bucket the window order ends with a guest that follows it."""
    cuts = rows.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("q")).first().q or []
    placed = rows.withColumn("h", F.xxhash64("text")).withColumn("bucket", _bucket(bounds(cuts)))
    firsts = sorted(placed.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("at")).select("bucket", "at.*").collect())  # at most a row for each bucket
    guests = [(r.bucket, r.key, r.h, firsts[i - 1].bucket) for i, r in enumerate(firsts)]
    window = Window.partitionBy("bucket").orderBy("guest", "key", "h", "text")
    if not guests:
        return placed.withColumn("guest", F.lit(0)), window
    lent = rows.sparkSession.createDataFrame(guests, "bucket int, key bigint, h bigint, host int")
    guest = placed.join(F.broadcast(lent), ["bucket", "key", "h"]).select("key", "h", "text", F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    both = placed.select("key", "h", "text", "bucket", F.lit(0).alias("guest")).unionAll(guest)
    return both, window


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lexicons: int = LEXICONS, most_sent: int = 1 << 19) -> DataFrame:
    """`(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)` for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LEAST)).alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kept = materialize(band(rows.select("text")), "band")
    ordered, window = _in_order(rows, max(4 * shuffle_partitions(spark), 8))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    following = ordered.select("*", F.coalesce(F.lead("text").over(window), F.lit("")).alias("following"), F.row_number().over(window).alias("at"))
    edited = following.select("key", "bucket", "guest", "at", "text", n.cast("bigint").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("following"), F.lit(1), cut)).alias("edited"))
    termed = edited.select("key", "bucket", "guest", "at", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("new"))
    document = F.struct("key", "guest", "n_chars", "edited_sha256", F.col("own").alias("own_terms"), F.col("new").alias("new_terms"))
    # each term once, with the texts it is in (1 own, 2 edited, 3 both); the document itself rides on a last element
    nothing = F.lit(None).cast(termed.select(document.alias("d")).schema["d"].dataType)

    def cell_of(where: int):
        return lambda h: F.struct(h.alias("h"), F.lit(where).alias("where"), nothing.alias("doc"))

    cells = [F.transform(found, cell_of(where)) for found, where in ((F.array_except("own", "new"), 1), (F.array_except("new", "own"), 2), (F.array_intersect("own", "new"), 3))]
    last = F.array(F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0).alias("where"), document.alias("doc")))
    cell = termed.select("bucket", "at", F.explode(F.concat(*cells, last)).alias("c")).select("bucket", "at", "c.*")
    few = kept.count() <= most_sent
    known = kept.select("h", F.lit(True).alias("kept"))
    if few:
        joined = cell.join(F.broadcast(known), "h", "left").where("kept or doc is not null")
    else:  # terms out of the band leave before the shuffle's other side is read; documents don't take part in it
        joined = cell.where("h is not null").join(known, "h").unionByName(cell.where("h is null").withColumn("kept", F.lit(None).cast("boolean")))
    gathered = joined.groupBy("bucket", "at").agg(
        F.max("doc").alias("doc"),
        F.collect_list(F.when(F.col("where").bitwiseAND(F.lit(1)) > 0, F.col("h"))).alias("own"),
        F.collect_list(F.when(F.col("where").bitwiseAND(F.lit(2)) > 0, F.col("h"))).alias("new"),
    )
    marked = gathered.select("bucket", "at", "doc.*", fingerprint(F.col("own"), F.col("doc.own_terms"), lexicons).alias("fingerprint"), fingerprint(F.col("new"), F.col("doc.new_terms"), lexicons).alias("edited_fingerprint"))
    paired = marked.withColumn("next_fingerprint", F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("at"))).where("guest = 0")
    return paired.select(
        F.nullif("key", F.lit(_LEAST)).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), lexicons).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", "fingerprint"), lexicons).alias("near_next"),
    )


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
