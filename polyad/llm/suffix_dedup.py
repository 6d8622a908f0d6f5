"""Exact removal of repeated 200-byte strings by a distributed merge sort of suffixes (operator 4).

A byte goes if it lies in a string of `length` bytes that also starts anywhere else. Sorting every suffix of
the corpus would move each byte some hundred times, so only suffixes at anchors are sorted:

1. Anchors. A window of `length` bytes is given to the place in it whose k-byte hash is least (leftmost of
   equals). The choice depends on the window's bytes alone, so equal windows have equal anchors at equal
   offsets. Successive windows with one anchor make a run; a run is known by the hash of its anchor's k
   bytes and the hash of all its bytes. A run whose anchor's hash occurs once holds no repeated window. One
   whose hashes both occur again is repeated whole. Both are settled by counting. What is left are runs that
   share an anchor with different runs: the edges of repeated passages.
2. Sorted runs. For these, each task sorts the suffixes that start at their anchors, and their left
   contexts reversed, and writes both front-coded: the length of the prefix shared with the entry before,
   and the rest. Equal entries are folded into one. Runs go to the partition of their anchor's hash.
3. Merge. Each partition merges its front-coded runs with a loser tree that keeps, in every node, how long a
   prefix the loser shares with the winner that beat it. Of two entries the one that shares more with the
   last output is smaller without a look at its bytes, and equals are compared from there on; no known
   prefix is compared again. The merge gives common-prefix lengths of neighbours in the output.
4. Windows. A window that starts l bytes before its anchor is repeated if another entry shares at least l
   bytes to the left and length - l to the right. Both are classes of the sorted orders (cut where the
   common prefix is shorter), so for each l the windows are matched by their pair of classes.

An anchor that very many different runs share (a common line with different surroundings) does not go to
one task: its runs are taken apart into single windows, which are sorted and merged in the same way, are
spread by their own hash, and of which equals are folded before the exchange.

Texts are cut into stretches of 1 MB that overlap by a window, so memory is bounded for long texts.

Runs count as equal by two hashes, 128 bits together: that of their anchor (step 1 groups by it) and that of all
their bytes with the anchor's place. Only the merge compares bytes.

Defined results: a null text counts as empty; texts shorter than the window lose nothing; repeated rows
count as repeated texts, also if id and text are equal; a null id is an id like any other; other columns are
ignored by `dedup` and kept by `clean`; an empty table gives none.
"""

from __future__ import annotations

import struct
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm.common import join_hot, materialize, shuffle_partitions, table

GRAM = 32
_STRETCH = 1 << 20
_PLACE_BITS = 21
_KEY = "doc_id bigint, h bigint"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all GRAM-byte strings, by doubling."""
    h, power, k = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1
    while k < GRAM:
        h = h[:-k] * np.uint64(power) + h[k:]
        power, k = power * power % 2**64, 2 * k
    return h


def runs_of(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows, anchor and anchor hash of every run in a text."""
    empty = np.zeros(0, np.int64)
    parts = [(empty, empty, empty, empty)]
    for at in range(0, max(len(data) - length + 1, 0), _STRETCH):
        piece = np.frombuffer(data, np.uint8)[at : at + _STRETCH + length - 1]
        h = _gram_hashes(piece)
        place = np.arange(len(h), dtype=np.uint64)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        least = (_mix(h) & ~low) | place  # hash first, then place: the leftmost of equals
        width, reach = length - GRAM + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        anchor = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        end = np.append(first[1:], len(anchor))
        parts.append((first + at, end + at, anchor[first] + at, h[anchor[first]].view(np.int64)))
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


# --- front-coded sorted runs and their merge ---------------------------------------------------------------


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which `at` bytes are known."""
    n = min(len(a), len(b))
    step = 32
    while at < n:
        to = min(at + step, n)
        x, y = a[at:to], b[at:to]
        if x == y:
            at = to
            step *= 2
            continue
        differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        return at + (to - at) - (differ.bit_length() + 7) // 8
    return n


def front_code(strings: list[bytes]) -> bytes:
    """Sorted strings as shared length, rest length and rest."""
    out, last = [], b""
    for s in strings:
        shared = common(last, s)
        out.append(struct.pack("<II", shared, len(s) - shared))
        out.append(s[shared:])
        last = s
    return b"".join(out)


def front_decode(blob: bytes) -> tuple[list[int], list[bytes]]:
    """Shared lengths and strings."""
    shared, strings, at, last = [], [], 0, b""
    while at < len(blob):
        keep, rest = struct.unpack_from("<II", blob, at)
        at += 8
        last = last[:keep] + blob[at : at + rest]
        at += rest
        shared.append(keep)
        strings.append(last)
    return shared, strings


class LoserTree:
    """Merges sorted runs, each given as (shared lengths, strings); yields (run, index, length shared with the last)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.k = 1
        while self.k < max(len(runs), 1):
            self.k *= 2

    def __iter__(self):
        runs, k = self.runs, self.k
        at = [0] * k
        now: list[bytes | None] = [runs[i][1][0] if i < len(runs) and runs[i][1] else None for i in range(k)]
        share = [0] * k  # with the last output; inside the tree: with the winner that beat it

        def play(a: int, b: int) -> tuple[int, int]:
            """(winner, loser); the loser's share becomes that with the winner."""
            x, y = now[a], now[b]
            if y is None:
                return a, b
            if x is None:
                return b, a
            p, q = share[a], share[b]
            if p > q:
                return a, b
            if q > p:
                return b, a
            n = common(x, y, p)
            if n == len(x) and (n < len(y) or a < b) or n < len(x) and n < len(y) and x[n] < y[n]:
                share[b] = n
                return a, b
            share[a] = n
            return b, a

        losers = [0] * k
        level = list(range(k))
        node = k
        while len(level) > 1:
            node //= 2
            winners = []
            for i in range(0, len(level), 2):
                w, lost = play(level[i], level[i + 1])
                winners.append(w)
                losers[node + i // 2] = lost
            level = winners
        winner = level[0]
        while now[winner] is not None:
            yield winner, at[winner], share[winner]
            at[winner] += 1
            shared, strings = runs[winner]
            if at[winner] < len(strings):
                now[winner], share[winner] = strings[at[winner]], shared[at[winner]]
            else:
                now[winner] = None
            node = (winner + k) // 2
            while node:
                winner, losers[node] = play(winner, losers[node])
                node //= 2


# --- steps ---------------------------------------------------------------------------------------------------


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc, h, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = value.as_py()
                if len(data) < length:
                    continue
                first, end, anchor, k = runs_of(data, length)
                c = [xxh3_64_intdigest(data[s : e + length - 1], a - s) for s, e, a in zip(first.tolist(), end.tolist(), anchor.tolist(), strict=True)]
                for column, values in zip(columns, ([doc] * len(c), [h] * len(c), k, np.array(c, np.uint64).view(np.int64), first, end), strict=True):
                    column.extend(values if isinstance(values, list) else values.tolist())
                if len(columns[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "h", "k", "c", "s", "e"])
                    columns = [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "h", "k", "c", "s", "e"])

    return docs.mapInArrow(run, f"{_KEY}, k bigint, c bigint, s bigint, e bigint")


def _sorted_runs(docs: DataFrame, length: int, parts: int, most: int = 20_000) -> DataFrame:
    """Front-coded runs `(part, blob)` of what `docs(doc_id, h, data, need)` needs; need: s, e, k, crowded, again."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        held: dict[tuple, list] = {}

        def flush():
            by_part: dict[int, list] = {}
            for (right, left, place), (part, again, owners) in held.items():
                by_part.setdefault(part, []).append((right, left, place, again or len(owners) > 1, owners))
            for part, entries in by_part.items():
                entries.sort(key=lambda x: x[0])
                by_left = sorted(range(len(entries)), key=lambda i: entries[i][1])
                rights, lefts = front_code([x[0] for x in entries]), front_code([entries[i][1] for i in by_left])
                order = np.array(by_left, "<u4").tobytes()
                fixed = b"".join(struct.pack("<HHBI", *x[2], x[3], len(x[4])) for x in entries)
                owners = b"".join(struct.pack("<qqq", *o) for x in entries for o in x[4])
                yield part, struct.pack("<5I", len(entries), len(rights), len(lefts), len(fixed), len(owners)) + rights + lefts + order + fixed + owners
            held.clear()

        def batch_of(rows):
            rows = list(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

        def add(right: bytes, left: bytes, least: int, past: int, part: int, again: bool, owner: tuple):
            entry = held.setdefault((right, left, (least, past)), [part, False, []])
            entry[1] |= again
            entry[2].append(owner)

        for batch in batches:
            for doc, h, value, need in zip(*(batch.column(i).to_pylist() if i != 2 else batch.column(i) for i in range(4)), strict=True):
                data = value.as_py()
                first, end, anchor, _ = runs_of(data, length)
                where = {int(s): int(a) for s, a in zip(first, anchor, strict=True)}
                for n in need:
                    s, e = n["s"], n["e"]
                    if n["crowded"]:
                        for p in range(s, e):
                            window = data[p : p + length]
                            add(window, b"", 0, 1, xxh3_64_intdigest(window, 7) % parts, n["again"], (doc, h, p))
                            if len(held) >= most:
                                yield batch_of(flush())
                    else:
                        a = where[s]
                        add(data[a : e + length - 1], data[s:a][::-1], a - e + 1, a - s + 1, n["k"] % parts, n["again"], (doc, h, a))
                        if len(held) >= most:
                            yield batch_of(flush())
        yield batch_of(flush())

    return docs.mapInArrow(run, "part int, blob binary")


def merge_runs(blobs: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """(doc, h, first window, end) of the repeated windows among the entries of one partition's runs."""
    rights, lefts, orders, fixed, owners, base = [], [], [], [], [], [0]
    for blob in blobs:
        n, a, b, c, d = struct.unpack_from("<5I", blob)
        at = 20
        rights.append(front_decode(blob[at : at + a]))
        lefts.append(front_decode(blob[at + a : at + a + b]))
        at += a + b
        orders.append(np.frombuffer(blob, "<u4", n, at))
        at += 4 * n
        fixed.append(np.frombuffer(blob[at : at + c], np.dtype("<u2,<u2,u1,<u4")))
        owners.append(np.frombuffer(blob[at + c : at + c + d], "<i8").reshape(-1, 3))
        base.append(base[-1] + n)
    n = base[-1]
    if not n:
        return []
    right_at, right_share = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, (run, index, share) in enumerate(LoserTree(rights)):
        right_at[i], right_share[i] = base[run] + index, share
    left_at, left_share = np.empty(n, np.int64), np.empty(n, np.int64)
    for i, (run, index, share) in enumerate(LoserTree(lefts)):
        left_at[i], left_share[i] = base[run] + orders[run][index], share
    table = np.concatenate(fixed)
    least, past, again, held = (table[f].astype(np.int64) for f in ("f0", "f1", "f2", "f3"))
    owner = np.concatenate(owners)
    hit: list[tuple[np.ndarray, int]] = [(np.flatnonzero(again), -1)]
    single = again == 0
    for l in range(int(least.min()), int(past.max())):  # noqa: E741
        live = (least <= l) & (l < past)
        if not (live & single).any():
            continue
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[right_at] = np.cumsum(right_share < length - l)
        left[left_at] = np.cumsum(left_share < l) if l else 0
        at = np.flatnonzero(live)
        _, which, count = np.unique(right[at] * (n + 1) + left[at], return_inverse=True, return_counts=True)
        at = at[(count[which] > 1) & single[at]]
        if len(at):
            hit.append((at, l))
    start = np.concatenate(([0], np.cumsum(held)))
    out = []
    for i in hit[0][0].tolist():
        for doc, h, a in owner[start[i] : start[i + 1]].tolist():
            out.append((doc, h, a - int(past[i]) + 1, a - int(least[i]) + 1))
    spans: dict[int, list[int]] = {}
    for at, l in hit[1:]:  # noqa: E741
        for i in at.tolist():
            spans.setdefault(i, []).append(l)
    for i, offsets in spans.items():
        doc, h, a = owner[start[i]].tolist()
        low = high = offsets[0]
        for l in [*offsets[1:], None]:  # noqa: E741
            if l is not None and l == high + 1:
                high = l
                continue
            out.append((doc, h, a - high, a - low + 1))
            low = high = l
    return out


def _merged(runs: DataFrame, length: int, parts: int) -> DataFrame:
    """One partition of the exchange may hold several parts; each is merged for itself."""

    def run(batches):
        parts_here: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts_here.setdefault(part, []).append(blob)
        while parts_here:
            _, blobs = parts_here.popitem()
            rows = merge_runs(blobs, length)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "h", "s", "e"])

    return runs.repartition(parts, "part").mapInArrow(run, f"{_KEY}, s bigint, e bigint")


def covered(starts: list[tuple[int, int]], length: int, size: int) -> list[tuple[int, int]]:
    """Maximal byte spans under windows that start in the given ranges."""
    out: list[list[int]] = []
    for s, e in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e + length - 1)
        else:
            out.append([s, e + length - 1])
    return [(s, min(e, size)) for s, e in out]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """h tells rows of one id apart by their texts."""
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(data).alias("h"), data.alias("data"))


def repeated(texts: DataFrame, length: int = 200, crowd: int = 20_000) -> DataFrame:
    """`(doc_id, h, found)`: for `texts(doc_id, h, data)` the ranges of starts of repeated windows."""
    spark = texts.sparkSession
    anchors = materialize(_anchors(texts, length), "anchors")
    by_anchor = anchors.groupBy("k").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1")
    # written first, so that the hot anchors are known and both sides of the join are plain exchanges
    by_anchor = materialize(by_anchor.select("k", "n", (F.col("c0") == F.col("c1")).alias("same")), "hashes")
    total = by_anchor.agg(F.sum("n")).first()[0] or 0
    shared = materialize(join_hot(anchors, by_anchor, ["k"], total), "shared")
    mixed = shared.where("not same")
    runs = materialize(mixed.groupBy("k", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "s", "e")).alias("one")), "runs")
    crowds = materialize(runs.groupBy("k").agg(F.count("*").alias("n")).select("k", "n", (F.col("n") > crowd).alias("crowded")), "anchors-of-runs")
    again = runs.where("n > 1").select("k", "c", "n")
    total = again.agg(F.sum("n")).first()[0] or 0
    repeats = join_hot(mixed, again, ["k", "c"], total, "left_semi")
    whole = shared.where("same").select("doc_id", "h", "s", "e").unionAll(repeats.select("doc_id", "h", "s", "e"))
    several = crowds.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    need = join_hot(runs, crowds, ["k"], several).select("one.*", "k", "crowded", (F.col("n") > 1).alias("again"))
    need = need.groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "e", "k", "crowded", "again")).alias("need"))
    parts = 2 * shuffle_partitions(spark)
    edges = _merged(_sorted_runs(texts.join(need, ["doc_id", "h"]).select("doc_id", "h", "data", "need"), length, parts), length, parts)
    return whole.unionAll(edges).groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "e")).alias("found"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200) -> DataFrame:
    """`(doc_id, n_bytes, n_removed, n_spans, kept_sha256)` for every row."""
    if length < 2 * GRAM:
        raise ValueError(f"windows have {2 * GRAM} bytes at least")
    texts = _texts(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, value, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = value.as_py()
                spans = covered([(x["s"], x["e"]) for x in found or []], length, len(data))
                rows.append((doc, len(data), sum(e - s for s, e in spans), len(spans), sha256(_without(data, spans)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = texts.join(repeated(texts, length), ["doc_id", "h"], "left").select("doc_id", "data", "found")
    out = joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))


def _without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for s, e in spans:
        out.append(data[at:s])
        at = e
    return b"".join([*out, data[at:]])


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", length: int = 200) -> DataFrame:
    """`docs` with the repeated bytes taken out of their texts; characters that this cuts apart go as well."""
    texts = _texts(docs, id_col, text_col)
    names, kinds = docs.columns, dict(docs.dtypes)

    @F.pandas_udf("string")
    def cut(data, found):
        import pandas as pd

        return pd.Series([_without(d, covered([(x["s"], x["e"]) for x in f], length, len(d))).decode("utf-8", "ignore") if f is not None else d.decode() for d, f in zip(data, found, strict=True)], dtype=object)

    taken = {c.lower() for c in names}
    by_id, by_hash, spans = (next(c + "_" * k for k in range(len(names) + 1) if c + "_" * k not in taken) for c in ("_id", "_h", "_found"))
    keyed = docs.select("*", F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias(by_id), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias(by_hash))
    found = repeated(texts, length).select(F.col("doc_id").alias(by_id), F.col("h").alias(by_hash), F.col("found").alias(spans))
    joined = keyed.join(found, [by_id, by_hash], "left")
    joined = joined.withColumn(text_col, F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(cut(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), F.col(spans))))
    if size_col in names:
        joined = joined.withColumn(size_col, F.length(text_col).cast(kinds[size_col]))
    return joined.select(*names)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
