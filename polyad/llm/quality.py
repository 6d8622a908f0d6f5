"""Quality rules by distribution divergence (operator 3).

A document's histogram of character classes and its histogram of common words are compared with those of its
language by the Jensen-Shannon distance (base 2, square root: 0 to 1). The references are sums over all
documents of the language that pass the base rule. The common words of four languages are fixed lists of function
words; those of any other language are the words that make up at least 1/400 of its words. A distance is held
against a document only above a limit that is wider for short texts, whose histograms are noisy by chance
(base + slack / sqrt(words)), and not at all under `min_words` words. Languages whose reference has fewer than
`min_reference` words are compared with the sums over all documents, and only by character classes.

References of languages that have at least 1/4096 of all words (so there are no more than 4096 of them) go to
every worker. Those of the others, of which none is hot, are joined to their documents; where there are none,
as is usual, both passes are map-only, with a few sums for each language between them.

Defined results: a null text has no words and fails the base rule; a null language is a language of its own;
repeated rows get the same verdict and all count in the references; without `lang_col` all rows are of one
language; other columns are ignored by `judge` and kept by `keep`; an empty table gives none; texts may be of any
length.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm.common import materialize, table

FUNCTION_WORDS = {
    "en": "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son aux d'une cette ou être comme mais fait nous sa on ses leur était deux",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde",
}
_SLOTS = {lang: {w.encode(): i for i, w in enumerate(dict.fromkeys(words.split()))} for lang, words in FUNCTION_WORDS.items()}
#: ASCII: lower, upper, digit, white space, symbol, other. Beyond, by the first byte of a character's UTF-8, as
#: blocks share it: Latin, other two-byte scripts by pairs of blocks, punctuation, ideographs and kana, Hangul, the rest of three bytes, four bytes.
_LEADS = [(0xC0, 0xC9), (0xCA, 0xCD), (0xCE, 0xCF), (0xD0, 0xD3), (0xD4, 0xD7), (0xD8, 0xDF), (0xE0, 0xE1), (0xE2, 0xE2), (0xE3, 0xE9), (0xEA, 0xED), (0xEE, 0xEF), (0xF0, 0xFF)]
CLASSES = 6 + len(_LEADS)
WHITE, SYMBOL = 3, 4


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 0x80:
        return next((6 + i for i, (low, high) in enumerate(_LEADS) if low <= byte <= high), -1)
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c in " \t\n\v\f\r":
        return WHITE
    return SYMBOL if c in "#*$%&|<>" else 5


_CLASS = np.zeros((256, CLASSES), np.int64)
for _byte in range(256):
    if _class_of(_byte) >= 0:
        _CLASS[_byte, _class_of(_byte)] = 1


def classes(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS


def common_words(words: list[bytes], slots: dict[bytes, int]) -> np.ndarray:
    """Counts of the common words and, last, of all other words; `words` in lower case."""
    out = np.zeros(len(slots) + 1, np.int64)
    if slots:
        for word, n in Counter(words).items():
            at = slots.get(word)
            if at is not None:
                out[at] = n
    out[-1] = len(words) - out[:-1].sum()
    return out


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if one is empty."""
    a, b = p.sum(), q.sum()
    if not a or not b:
        return 0.0
    p, q = p / a, q / b
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        half = lambda x: np.where(x > 0, x * np.log2(x / m), 0.0).sum()
        return float(np.sqrt(max(0.0, (half(p) + half(q)) / 2)))


def base(data: bytes, words: list[bytes], counts: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in data.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, past = Counter(windows), 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + 3 - max(i, past)
                past = i + 3
    return len(words), int(counts.sum() - counts[WHITE]), int(counts[SYMBOL]), len(lines) - len(set(lines)), repeated


def fails(row: tuple) -> bool:
    """The base rule."""
    return row[0] < 50 or 100 * row[4] > 50 * row[0]


def _passing(value) -> tuple[np.ndarray, list[bytes]] | None:
    """Class counts and lower-case words of a text that counts in the references."""
    data = (value.as_py() or "").encode()
    counts, words = classes(data), data.split()
    return None if fails(base(data, words, counts)) else (counts, data.lower().split())


def references(docs: DataFrame, most: int = 4096, common: int = 400) -> DataFrame:
    """`(lang, n, classes, words, counts)` from `docs(text, lang)`: words of passing texts, sums by class, common words and
    their counts (last: all other words)."""

    def sums(batches):
        held: dict = {}

        def taken():
            rows = [(lang, n, list(map(int, c)), list(map(int, w)) if w is not None else None) for lang, (n, c, w) in held.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], ["lang", "n", "classes", "counts"])

        for batch in batches:
            for value, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = _passing(value)
                if found is None:
                    continue
                slots = _SLOTS.get(lang)
                n, c, w = held.get(lang, (0, 0, 0))
                held[lang] = n + len(found[1]), c + found[0], None if slots is None else w + common_words(found[1], slots)
                if len(held) >= most:
                    yield taken()
        yield taken()

    def counted(batches):
        held: Counter = Counter()

        def taken():
            columns = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["lang", "word", "c"])

        for batch in batches:
            for value, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = _passing(value)
                if found is not None:
                    held.update((lang, w) for w in found[1])
                if len(held) >= 250_000:
                    yield taken()
        yield taken()

    parts = docs.mapInArrow(sums, "lang string, n bigint, classes array<bigint>, counts array<bigint>")
    cells = parts.select("lang", "n", F.posexplode(F.concat("classes", F.coalesce("counts", F.array().cast("array<bigint>")))).alias("at", "v"))
    # a sum for each language and slot, with partial sums before the exchange
    summed = cells.groupBy("lang", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    lists = summed.groupBy("lang").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("v"))
    lists = materialize(lists.select("lang", "n", F.slice("v", 1, CLASSES).alias("classes"), F.expr(f"slice(v, {CLASSES + 1}, greatest(size(v) - {CLASSES}, 0))").alias("counts")), "sums")
    other = ~F.coalesce(F.col("lang").isin(*FUNCTION_WORDS), F.lit(False))
    fixed = F.create_map(*[x for lang, slots in _SLOTS.items() for x in (F.lit(lang), F.array(*[F.lit(w.decode()) for w in slots]))])
    known = lists.where(~other).select("lang", "n", "classes", F.try_element_at(fixed, "lang").alias("words"), "counts")
    if lists.where(other).isEmpty():
        return known
    words = docs.where(other).mapInArrow(counted, "lang string, word string, c bigint").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    met = words.join(lists.where(other).select(F.col("lang").alias("_lang"), "n"), F.col("lang").eqNullSafe(F.col("_lang"))).where(F.col("c") * common >= F.col("n"))
    often = met.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("word", "c"))).alias("w"))
    joined = lists.where(other).join(often, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    rest = F.col("n") - F.aggregate(F.coalesce(F.col("w.c"), F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    none = F.array().cast("array<string>")
    found = joined.select("lang", "n", "classes", F.coalesce(F.col("w.word"), none).alias("words"), F.concat(F.coalesce(F.col("w.c"), F.array().cast("array<bigint>")), F.array(rest)).alias("counts"))
    return materialize(known.unionAll(found), "references")


_REFERENCE = "struct<classes: array<bigint>, words: array<string>, counts: array<bigint>>"


def _ready(found: dict) -> tuple:
    return np.array(found["classes"], np.int64), {w.encode(): i for i, w in enumerate(found["words"])}, np.array(found["counts"], np.int64)


class Rules:
    """Judges one text; limits are base + slack / sqrt(words). `known`: language to reference; `whole`: classes of all documents."""

    def __init__(self, known: dict, whole: np.ndarray, min_words: int = 50, class_limit: tuple[float, float] = (0.20, 0.9), word_limit: tuple[float, float] = (0.15, 1.7)):
        self.known, self.whole, self.min_words, self.class_limit, self.word_limit = known, whole, min_words, class_limit, word_limit

    def __call__(self, text: str | None, lang: str | None, joined: dict | None = None) -> tuple:
        data = (text or "").encode()
        counts, words = classes(data), data.split()
        row = base(data, words, counts)
        n, failed = row[0], fails(row)
        by_class, slots, by_word = _ready(joined) if joined is not None else self.known.get(lang, (self.whole, {}, None))
        far_class = distance(counts, by_class)
        far_word = distance(common_words(data.lower().split(), slots), by_word) if by_word is not None else 0.0
        over = n >= self.min_words and any(d > limit + slack / np.sqrt(n) for d, (limit, slack) in ((far_class, self.class_limit), (far_word, self.word_limit)))
        return (*row, failed, bool(not failed and not over), far_class, far_word)


def _prepared(docs: DataFrame, text: Column, lang: Column, min_reference: int, most: int, limits: dict) -> tuple[Rules, DataFrame, str]:
    """The rules, and `docs` with a column (whose name is returned) of the references that are joined; null: sent."""
    found = references(docs.select(text.cast("string").alias("text"), lang.cast("string").alias("lang")))
    sums = found.select("n", F.posexplode("classes").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    whole = np.zeros(CLASSES, np.int64)
    for r in sums:
        whole[r.at] = r.v
    total = max([r.n for r in sums], default=0)
    fit = found.where(F.col("n") >= min_reference)
    known = {r.lang: _ready(r.asDict()) for r in fit.where(F.col("n") * most >= total).collect()}
    extra = "_reference"
    while extra in docs.columns:
        extra += "_"
    rare = fit.where(F.col("n") * most < total).select(F.col("lang").alias(extra + "lang"), F.struct("classes", "words", "counts").cast(_REFERENCE).alias(extra))
    if rare.isEmpty():
        return Rules(known, whole, **limits), docs.withColumn(extra, F.lit(None).cast(_REFERENCE)), extra
    sent = F.coalesce(lang.cast("string").isin(*[k for k in known if k is not None]), F.lit(None in known))
    joined = docs.where(~sent).join(rare, lang.cast("string").eqNullSafe(F.col(extra + "lang")), "left").drop(extra + "lang")
    return Rules(known, whole, **limits), docs.where(sent).withColumn(extra, F.lit(None).cast(_REFERENCE)).unionAll(joined), extra


_SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _lang(docs: DataFrame, lang_col: str) -> Column:
    return F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_reference: int = 2000, most: int = 4096, **limits) -> DataFrame:
    """One row per document with its counts, distances and verdict."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), _lang(docs, lang_col).cast("string").alias("lang"))
    rules, marked, extra = _prepared(rows, F.col("text"), F.col("lang"), min_reference, most, limits)
    types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [(doc, *rules(text.as_py(), lang, found)) for doc, text, lang, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return marked.select("doc_id", "text", "lang", extra).mapInArrow(run, _SCHEMA)


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_reference: int = 2000, most: int = 4096, **limits) -> DataFrame:
    """The rows of `docs`, with all their columns, whose texts pass."""
    rules, marked, extra = _prepared(docs, F.col(text_col), _lang(docs, lang_col), min_reference, most, limits)
    at_text, at_lang, at_found = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None, len(docs.columns)

    def run(batches):
        for batch in batches:
            langs = batch.column(at_lang).to_pylist() if at_lang is not None else [None] * batch.num_rows
            verdicts = [rules(text.as_py(), lang, found)[6] for text, lang, found in zip(batch.column(at_text), langs, batch.column(at_found).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:at_found], schema=pa.schema(list(batch.schema)[:at_found])).filter(pa.array(verdicts, pa.bool_()))

    return marked.select(*docs.columns, extra).mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
