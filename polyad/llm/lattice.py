"""Language-model scores from a lattice of subwords (operator 9).

The pieces of an existing vocabulary weight all segmentations of a text: its probability is the sum, over the
ways to write it as pieces, of the product of the pieces' probabilities. Pieces never cross words, so this is
a product over words of a forward recursion over each word's lattice, in log space. Characters without a
piece are spelt in byte pieces. A document ends with an end symbol, one of the outcomes beside the pieces.

The vocabulary is given. Its scores order the pieces and start the weights; the weights themselves are those
of the training documents: expected piece counts over all segmentations of every training word, times the
word's count, with `floor` added to each. They depend on the weights before, so `warm` rounds of
expectation-maximisation over the frequent words (see below) precede the round over all words.

Each distinct word is scored once. Beside the model's score stands that of add-one word counts. The table of
words grows with the corpus, so it is not sent around whole: words that make up at least 1/2**18 of all words,
and as many times more as they have stretches of 64 characters, go to every worker (no more than 2**18 words and
16 M characters, whatever their lengths); the others, which are rare and so have no hot key, are joined.

Defined results: a null text counts as empty: one token, the end; repeated rows are scored each for itself
and all train; a null id trains; words may be of any length; other columns are ignored; without training documents all weights are those of the vocabulary's order,
and N is 0, V is 0.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm.common import ascii_lower, materialize, shuffle_partitions, table
from polyad.llm.tokenizer import default_path

FREQUENT = 1 << 18
_MARK = "▁"
#: Endings of up to so many characters are kept, so many at once.
_TAIL, _MOST_TAILS = 7, 400_000


@functools.cache
def vocabulary(path: str) -> tuple[list[str], list[float]]:
    """Pieces and their starting weights: 1 / rank by the file's scores. Byte pieces are `<0xNN>`."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [(model.id_to_piece(i), model.get_score(i), model.is_byte(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    plain = sorted((x for x in found if not x[2] and _MARK not in x[0][1:] and x[0] == ascii_lower(x[0])), key=lambda x: (-x[1], x[0]))
    names = [x[0] for x in plain] + [f"<0x{b:02X}>" for b in range(256)]
    return names, [1 / (r + 1) for r in range(len(names))]


class Lattice:
    """Scores words; `logs` are natural logarithms of the pieces' probabilities."""

    def __init__(self, names: list[str], logs: list[float]):
        self.edges: dict[str, tuple[int, float, float] | None] = {}  # number, logarithm, probability
        self.bytes: list[tuple[int, float]] = [(0, 0.0)] * 256
        self.tails: dict[str, float] = {}
        for i, (name, log) in enumerate(zip(names, logs, strict=True)):
            if name.startswith("<0x"):
                self.bytes[int(name[3:5], 16)] = (i, log)
                continue
            for end in range(1, len(name)):
                self.edges.setdefault(name[:end], None)
            self.edges[name] = (i, log, math.exp(log))

    def forward(self, text: str) -> tuple[list[float], list[list]]:
        """Log probabilities of all prefixes, and for each end the edges (start, pieces, log) that reach it."""
        n, edges = len(text), self.edges.get
        into: list[list] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        log, exp = math.log, math.exp
        for i in range(n):
            if i:
                terms = [alpha[s] + w for s, _, w in into[i]]
                if len(terms) == 1:
                    alpha[i] = terms[0]
                else:
                    top = max(terms)
                    alpha[i] = top + log(sum([exp(t - top) for t in terms]))
            found = edges(text[i], 0)
            if found:
                into[i + 1].append((i, found[0], found[1]))
            else:  # a character without a piece of its own is spelt in bytes
                spelt = [self.bytes[b] for b in text[i].encode()]
                into[i + 1].append((i, [p for p, _ in spelt], sum(w for _, w in spelt)))
            if found != 0:
                for j in range(i + 2, n + 1):
                    found = edges(text[i:j], 0)
                    if found:
                        into[j].append((i, found[0], found[1]))
                    elif found == 0:
                        break
        terms = [alpha[s] + w for s, _, w in into[n]]
        top = max(terms)
        alpha[n] = top + log(sum([exp(t - top) for t in terms]))
        return alpha, into

    def word(self, word: str) -> float:
        """Natural logarithm of a word's marginal probability: the recursion of `forward` from the other end, so that
        endings which words share are summed once and kept."""
        text, edges, tails, log, log1p, exp = _MARK + word, self.edges.get, self.tails, math.log, math.log1p, math.exp
        n = len(text)
        beta = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            if n - i <= _TAIL:
                known = tails.get(text[i:])
                if known is not None:
                    beta[i] = known
                    continue
            found = edges(text[i], 0)
            terms = [beta[i + 1] + (found[1] if found else sum([self.bytes[b][1] for b in text[i].encode()]))]
            if found != 0:
                for j in range(i + 2, n + 1):
                    found = edges(text[i:j], 0)
                    if found:
                        terms.append(beta[j] + found[1])
                    elif found == 0:
                        break
            if len(terms) == 1:
                beta[i] = terms[0]
            elif len(terms) == 2:
                x, y = terms
                beta[i] = x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))
            else:
                top = max(terms)
                beta[i] = top + log(sum([exp(t - top) for t in terms]))
            if n - i <= _TAIL:
                if len(tails) >= _MOST_TAILS:
                    tails.clear()
                tails[text[i:]] = beta[i]
        return beta[0]

    def expect(self, word: str, count: float, into_counts: list[float]) -> None:
        """Add the expected piece counts of a word that occurs `count` times."""
        text, edges = _MARK + word, self.edges.get
        n = len(text)
        alpha = [1.0] + [0.0] * n
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            a, found = alpha[i], edges(text[i], 0)
            if not found:  # spelt in bytes
                self._expect_in_logs(text, count, into_counts)
                return
            into[i + 1].append((i, found[0], found[2]))
            alpha[i + 1] += a * found[2]
            for j in range(i + 2, n + 1):
                found = edges(text[i:j], 0)
                if found:
                    into[j].append((i, found[0], found[2]))
                    alpha[j] += a * found[2]
                elif found == 0:
                    break
        if alpha[n] < 1e-250:  # too long for plain probabilities
            self._expect_in_logs(text, count, into_counts)
            return
        beta = [0.0] * n + [count / alpha[n]]
        for j in range(n, 0, -1):
            mass = beta[j]
            for s, piece, p in into[j]:
                share = p * mass
                beta[s] += share
                into_counts[piece] += alpha[s] * share

    def _expect_in_logs(self, text: str, count: float, into_counts: list[float]) -> None:
        alpha, into = self.forward(text)
        n = len(alpha) - 1
        beta = [0.0] * n + [count]  # scaled: posterior mass of each place
        exp = math.exp
        for j in range(n, 0, -1):
            mass = beta[j]
            if mass:
                for s, piece, w in into[j]:
                    share = mass * exp(alpha[s] + w - alpha[j])
                    beta[s] += share
                    if isinstance(piece, list):
                        for p in piece:
                            into_counts[p] += share
                    else:
                        into_counts[piece] += share


def held_out_col(id_col: str):
    """Rows that do not train: crc32 of the id's text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(rows: DataFrame, most: int = 250_000) -> DataFrame:
    """`(word, c, t)` for all words of `rows(text, held_out)`; c counts in the rows that train and may be 0, t in all."""

    def run(batches):
        counts: Counter = Counter()
        held_counts: Counter = Counter()

        def taken():
            c, t = list(counts.values()), list(held_counts.values())
            rows = pa.RecordBatch.from_arrays([pa.array([*counts, *held_counts], pa.binary()).cast(pa.string()), pa.array(c + [0] * len(t), pa.int64()), pa.array(c + t, pa.int64())], ["word", "c", "t"])
            counts.clear()
            held_counts.clear()
            return rows

        for batch in batches:
            for text, held in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                (held_counts if held else counts).update(words)
                if len(counts) + len(held_counts) >= most:
                    yield taken()
        yield taken()

    return rows.select("text", "held_out").mapInArrow(run, "word string, c bigint, t bigint").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def word_scores(words: DataFrame, path: str, logs: list[float]) -> DataFrame:
    """`words(word, c, t)` with `p`, the natural logarithm of each word's marginal probability: once for each distinct word."""
    names = vocabulary(path)[0]

    def run(batches):
        lattice = Lattice(names, logs)
        for batch in batches:
            found = [lattice.word(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], ["word", "c", "t", "p"])

    return words.select("word", "c", "t").mapInArrow(run, "word string, c bigint, t bigint, p double")


def train(counts: DataFrame, frequent: DataFrame, documents: int, path: str, warm: int = 3, floor: float = 0.1) -> tuple[list[str], list[float], float]:
    """Pieces, logs of their probabilities and that of the end symbol."""
    names, weights = vocabulary(path)

    def normal(values: list[float], end: float) -> tuple[list[float], float]:
        total = math.log(sum(values) + end)
        return [math.log(v) - total for v in values], math.log(end) - total

    logs, end = normal(weights, 1.0)
    for words in [*[frequent] * warm, counts] if documents else []:

        def run(batches, logs=logs):
            lattice, expected = Lattice(names, logs), [0.0] * len(names)
            for batch in batches:
                for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    lattice.expect(word, float(c), expected)
            at = [i for i, v in enumerate(expected) if v]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([expected[i] for i in at], pa.float64())], ["at", "v"])

        values = [floor] * len(names)
        for row in words.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            values[row.at] += row.v
        logs, end = normal(values, float(documents))
    return names, logs, end


def score(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", warm: int = 3) -> DataFrame:
    """`(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)` for every row."""
    path = path or default_path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out_col(id_col).alias("held_out"))
    parts = shuffle_partitions(docs.sparkSession)
    words = materialize(word_counts(rows), "words")
    documents = rows.where("not held_out").count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    n, v = sums.n + documents, sums.v + (documents > 0)
    share = math.log10(n + v + 1)
    common = (F.col("t") * FREQUENT >= sums.t * F.ceil(F.length("word") / 64)) & (F.col("t") > 1)
    often = materialize(words.where(common).where("c > 0").repartition(parts), "frequent")
    _, logs, end = train(words.where("c > 0").repartition(parts), often, documents, path, warm)  # dealt evenly: a word takes far longer to score than to read
    known = materialize(word_scores(words.repartition(parts), path, logs), "scores")
    frequent = {r.word: (r.c, r.p) for r in known.where(common).collect()}
    session = docs.sparkSession.sparkContext
    sent = session.broadcast(frequent)

    def run(batches):
        known_of = {w.encode(): (math.log10(c + 1) - share, p, c > 0) for w, (c, p) in sent.value.items()}
        row_id = TaskContext.get().partitionId() << 33
        columns: list[list] = [[] for _ in range(4)]

        def taken():
            kind = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
            types = [pa.binary(), pa.int64(), pa.int64(), kind]
            words, *rest = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            out = pa.RecordBatch.from_arrays([words.cast(pa.string()), *rest], ["word", "row", "n", "doc"])
            for c in columns:
                c.clear()
            return out

        for batch in batches:
            for doc, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").encode().lower().split()
                tokens, counts = len(words), Counter(words)
                rare = [w for w in counts if w not in known_of]
                columns[0] += rare
                columns[1] += [row_id] * len(rare)
                columns[2] += [counts.pop(w) for w in rare]
                columns[3] += [None] * len(rare)
                known, base, total = 0, math.log10(documents + 1) - share, end
                for word, times in counts.items():
                    per_base, per_word, trained = known_of[word]
                    known += times * trained
                    base += times * per_base
                    total += times * per_word
                # a key of its own that no word can have: the document's sums travel with its rare words
                columns[0].append(b"\n%d" % row_id)
                columns[1].append(row_id)
                columns[2].append(0)
                columns[3].append({"doc_id": doc, "held_out": held, "tokens": tokens + 1, "known": known + (documents > 0), "base": base, "score": total / math.log(10)})
                row_id += 1
                if len(columns[0]) > 50_000:
                    yield taken()
        yield taken()

    pieces = rows.select("doc_id", "text", "held_out").mapInArrow(run, "word string, row bigint, n bigint, doc struct<doc_id: bigint, held_out: boolean, tokens: bigint, known: bigint, base: double, score: double>")
    joined = pieces.join(known.where(~common).drop("t").hint("shuffle_merge"), "word", "left")
    per_row = joined.groupBy("row").agg(
        F.max("doc.doc_id").alias("doc_id"),
        F.max("doc.held_out").alias("held_out"),
        F.sum("doc.tokens").alias("n_tokens"),
        (F.sum("doc.known") + F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum("doc.base") + F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 1) - share))).alias("base_score"),
        (F.sum("doc.score") + F.sum(F.col("n") * F.coalesce("p", F.lit(0.0))) / math.log(10)).alias("score"),
    )
    return per_row.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
