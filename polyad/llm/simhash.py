"""SimHash near-duplicates by a generalised pigeonhole principle (operator 10).

Fingerprints are 64 bits, each the majority of that bit over the hashes of a document's word shingles. Two
fingerprints link if they differ in at most `max_bits` bits; documents are grouped by reachability.

Search among distinct fingerprints:

1. Bits that correlate over the corpus are put into the same partition (2, 3 and 4 partitions are tried).
2. If partition i is given threshold t_i, with the thresholds summing to max_bits - m + 1, then two
   fingerprints within max_bits agree within t_i bits on some partition i. A threshold of -1 leaves a
   partition out. Dynamic programming gives out the thresholds with the fewest estimated candidates and
   probes; the estimates come from counts over all fingerprints.
3. Fingerprints probe every value within t_i of theirs; the pairs that meet are verified on all 64 bits.
4. A bucket of over `bucket` fingerprints would give too many pairs. All that are in one or probe one go
   another exact way: each is listed under all fingerprints within half of max_bits (rounded up) of it, and
   those under one entry that verify link to it. For max_bits up to 2 an entry has at most 65 members, all
   within 2 bits of each other, so this needs no pairs and stays linear for any number of near copies.

`keep_one`, the pipeline's stage, takes shingles of five words and also links texts whose shingle sets have a
Jaccard similarity of 0.8 or more. Such texts differ in 4 to 15 of 64 bits, which no search by pigeonholes
covers in linear work, so their candidates come from bands of least shingle hashes, and every pair that shares a
band is either verified or joined by others that are. Each text of another shingle set takes part, also those
that share a fingerprint. Shingles are compared by 32 bits of their hashes: for sets of n shingles a chance
agreement changes a similarity by 1/n with a probability of about n*n/2**32.

Defined results: null and wordless texts have fingerprint zero; fewer words than a shingle count as one
shingle; repeated rows share a fingerprint and so a component; a null id sorts after all others; other columns
are ignored by `group` and kept by `keep_one`; an empty table gives none; texts may be of any length.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyad.llm.common import join_hot, materialize, table
from polyad.llm.components import components

BITS = 64
#: Bands of least values for the search by similarity: at 0.8 a pair shares none with probability 0.0004.
BANDS, ROWS = 20, 5
_LAST = 2**63 - 1


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """Of every shingle, repeats included; one of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if len(found) < words:
        shingles = [b" ".join(found)] if found else []
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.array([xxh64_intdigest(s, seed) for s in shingles], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes, as an unsigned integer."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """As an unsigned integer."""
    return majority(shingle_hashes(text, words, seed))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """`(doc_id, h, fp)`; fp is the fingerprint as a signed 64-bit integer, h a hash of the text."""

    def run(batches):
        for batch in batches:
            found = [_signed(fingerprint(text.as_py(), words, seed)) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "h", "fp"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, h bigint, fp bigint")


def _together(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both set; the diagonal counts single bits."""

    def run(batches):
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = np.unpackbits(np.asarray(batch.column(0)).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += np.rint(bits.T @ bits).astype(np.int64)
        at = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "n"])

    out = np.zeros(BITS * BITS)
    for row in nodes.select("fp").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row.at] = row.n
    return out.reshape(BITS, BITS)


def partitions(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in m partitions of even size, each grown from the bit with the strongest ties by those most tied to it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, out = list(range(BITS)), []
    for i in range(m):
        size = BITS // m + (i < BITS % m)
        group = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def _mask(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds that sum to `total` at the least cost; costs[i][t] is that of threshold t for partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        grown: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in options.items():
                if used + t not in grown or cost + more < grown[used + t][0]:
                    grown[used + t] = (cost + more, [*chosen, t])
        best = grown
    return best[total]


def plan(nodes: DataFrame, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition in use."""
    n = nodes.count()
    together = _together(nodes)
    share = np.diag(together) / max(n, 1)
    same = share**2 + (1 - share) ** 2
    layouts = {m: partitions(together, n, m) for m in range(2, max(2, max_bits) + 3)}
    keys = [(m, i) for m, groups in layouts.items() for i in range(len(groups))]
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(layouts[m][i]))).alias("v")) for k, (m, i) in enumerate(keys)])).alias("c")
    counts = nodes.select(cells).groupBy("c.k", "c.v").agg(F.count("*").cast("double").alias("n"))
    pairs = {keys[r.k]: r.pairs for r in counts.groupBy("k").agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs")).collect()}
    best = None
    for m, groups in layouts.items():
        costs = []
        for i, bits in enumerate(groups):
            odds = float(((1 - same[bits]) / np.maximum(same[bits], 1e-9)).sum())
            options, candidates, probes = {-1: 0.0}, pairs.get((m, i), 0.0), 0
            for t in range(max_bits + 1):
                probes += comb(len(bits), t)
                if probes > 600:
                    break
                options[t] = float(n) * probes + candidates * sum(odds**j / np.prod(range(1, j + 1)) for j in range(t + 1))
            costs.append(options)
        try:
            cost, chosen = allocate(costs, max_bits - m + 1)
        except KeyError:
            continue
        if best is None or cost < best[0]:
            best = cost, [(bits, t) for bits, t in zip(groups, chosen, strict=True) if t >= 0]
    return best[1]


def _flips(bits: list[int], most: int, least: int = 0) -> list[int]:
    return [_mask(list(c)) for r in range(least, most + 1) for c in combinations(bits, r)]


def links(nodes: DataFrame, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """Edges `(a, b)` among the distinct fingerprints `nodes(fp)` that join all within `max_bits` bits of each other."""
    chosen = plan(nodes, max_bits)
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v")) for i, (bits, _) in enumerate(chosen)])).alias("c")
    index = nodes.select("fp", own).select("c.i", "c.v", "fp")
    crowded = index.groupBy("i", "v").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("i", "v")
    crowded = materialize(crowded, "crowded")
    none = crowded.isEmpty()
    probes = [F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).bitwiseXOR(F.lit(x)).alias("v")) for i, (bits, t) in enumerate(chosen) for x in _flips(bits, t)]
    probe = nodes.select("fp", F.explode(F.array(*probes)).alias("c")).select("c.i", "c.v", "fp") if len(probes) > len(chosen) else index
    rest, asked = (index, probe) if none else (index.join(crowded, ["i", "v"], "left_anti"), probe.join(crowded, ["i", "v"], "left_anti"))
    met = rest.alias("x").join(asked.alias("y"), ["i", "v"]).where("x.fp < y.fp" if probe is index else "x.fp != y.fp")
    found = met.where(F.bit_count(F.expr("x.fp ^ y.fp")) <= max_bits).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if none:
        return found
    hot = probe.join(crowded, ["i", "v"], "left_semi").select("fp").distinct()
    radius = (max_bits + 1) // 2
    flips = F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in _flips(list(range(BITS)), radius)])
    under = hot.select("fp", F.explode(flips).alias("v")).groupBy("v").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    if max_bits % 2 == 0:  # all under one entry are within 2 * radius = max_bits of each other
        star = under.select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
    else:
        star = under.select("members", F.explode("members").alias("a")).select("a", F.explode(F.expr(f"filter(members, x -> bit_count(x ^ a) <= {max_bits})")).alias("b"))
    return found.unionAll(star.where("a != b"))


def _named(nodes: DataFrame, edges: DataFrame, node: str = "fp") -> DataFrame:
    """`(node, one)` for each of the distinct `nodes(node, least)`: the least (doc_id, h) of its component."""
    found = components(edges)
    named = nodes.select(node, "least").join(found.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    named = materialize(named, "named")
    return named.join(named.groupBy("component").agg(F.min("least").alias("one")), "component").select(node, "one")


# --- links by the similarity of shingle sets ------------------------------------------------------------------

_SALTS = np.random.default_rng(20).integers(0, 2**63, (2, BANDS * ROWS), "<u8") * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band: a hash of the least values of the shingles under the band's permutations."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, "<u8")
    for at in range(0, len(hashes), 2048):
        np.minimum(least, ((hashes[at : at + 2048, None] ^ _SALTS[0]) * _SALTS[1]).min(axis=0), out=least)
    return [_signed(xxh64_intdigest(row.tobytes())) for row in least.reshape(BANDS, ROWS)]


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, seed: int = 42) -> DataFrame:
    """`fingerprints` with the bands' keys and the distinct shingles, each as 32 bits of its hash."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fps, keys, grams = [], [], []
                for text in part.column(2):
                    hashes = shingle_hashes(text.as_py(), words, seed)
                    fps.append(_signed(majority(hashes)))
                    hashes = np.unique(hashes)
                    keys.append(bands(hashes))
                    grams.append(np.unique(hashes.astype("<u4")).view("<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int32()))], ["doc_id", "h", "fp", "bands", "grams"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, h bigint, fp bigint, bands array<bigint>, grams array<int>")


def _verified(tried: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs `(a, b)` whose shingle sets have at least this similarity."""
    grams = nodes.select("node", "grams")
    both = tried.join(grams.withColumnsRenamed({"node": "a", "grams": "x"}), "a").join(grams.withColumnsRenamed({"node": "b", "grams": "y"}), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("total"))
    return shared.where(F.col("n") >= similarity * (F.col("total") - F.col("n"))).select("a", "b")


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """How many elements each of the sets `xs` shares with each of `ys`: a product of 0-1 matrices, `width` elements at a time."""
    flat = [np.concatenate(sets) for sets in (xs, ys)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(xs), len(ys)))
    places = []
    for sets, all_of in zip((xs, ys), flat, strict=True):
        row, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(shared, all_of)
        at[at == len(shared)] = 0
        known = shared[at] == all_of if len(shared) else np.zeros(len(at), bool)
        places.append((row[known], at[known]))
    for lo in range(0, len(shared), width):
        n = min(width, len(shared) - lo)
        dense = []
        for sets, (row, at) in zip((xs, ys), places, strict=True):
            matrix = np.zeros((len(sets), n), np.float32)  # sums stay below 2**24, so they are exact
            here = (at >= lo) & (at < lo + n)
            matrix[row[here], at[here] - lo] = 1
            dense.append(matrix)
        out += dense[0] @ dense[1].T
    return out


def joined(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least row reachable from each row and column of a bipartite graph; the number of rows if there is none."""
    none = len(hit)
    rows = np.arange(none)
    while True:
        columns = np.where(hit, rows[:, None], none).min(axis=0)
        least = np.minimum(rows, np.where(hit, columns[None, :], none).min(axis=1))
        if (least == rows).all():
            return rows, columns
        rows = least


def _rest(crowded: DataFrame, nodes: DataFrame, edges: DataFrame, similarity: float, block: int, most_grams: int = 1 << 22) -> DataFrame:
    """Edges that join what `edges` leave apart among the members `(band, key, node, m)` of crowded keys.

    In each key, members outside the component with the most members are compared with all members, in pairs of
    blocks of about `block` members, or `most_grams` shingles, each; a pair of blocks is one product of matrices and gives a spanning forest.
    """
    named = crowded.join(components(edges), "node", "left").select("band", "key", "node", "m", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "members")
    parts = named.groupBy("band", "key", "component").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    sizes = parts.groupBy("band", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.max(F.struct("n", "component", "m")).alias("most")).where("most.n < n")
    blocks = lambda n, m: F.ceil(F.greatest(n / block, m / most_grams)).cast("int")
    sizes = sizes.select("band", "key", "n", F.col("most.component").alias("most"), blocks(F.col("n") - F.col("most.n"), F.col("m") - F.col("most.m")).alias("nr"), blocks(F.col("most.n"), F.col("most.m")).alias("ng"))
    members = join_hot(named, materialize(sizes, "open"), ["band", "key"], named.count()).withColumn("rest", F.col("component") != F.col("most"))
    own = F.when(F.col("rest"), F.expr("pmod(xxhash64(node), nr)")).otherwise(F.expr("nr + pmod(xxhash64(node), ng)")).cast("int")
    meets = F.when(F.col("rest"), F.expr("sequence(0, nr + ng - 1)")).otherwise(F.expr("sequence(0, nr - 1)"))
    tasks = members.withColumn("own", own).select("band", "key", "node", "own", F.explode(meets).alias("other"))
    tasks = tasks.select("band", "key", "node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(nodes.select("node", "grams"), "node")

    def run(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        nodes, at = found["node"].to_numpy(), found["own"].to_numpy()
        sets = [np.asarray(g.values) for g in found["grams"]]
        left = np.flatnonzero(at == found["i"][0].as_py())
        right = np.flatnonzero(at == found["j"][0].as_py())
        a, b = [], []
        if len(left) and len(right):
            n = overlaps([sets[k] for k in left], [sets[k] for k in right])
            m = np.array([len(s) for s in sets], float)
            rows, columns = joined(n >= similarity * (m[left][:, None] + m[right] - n))
            for side, names in ((left, rows), (right, columns)):
                linked = names < len(left)
                a.append(nodes[side[linked]])
                b.append(nodes[left[names[linked]]])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})

    return materialize(tasks.groupBy("band", "key", "i", "j").applyInArrow(run, "a bigint, b bigint"), "rest")


def similar(nodes: DataFrame, similarity: float = 0.8, bucket: int = 64, *, known: DataFrame | None = None, block: int = 512) -> DataFrame:
    """Edges `(a, b)` that, beside those of `known`, join all of `nodes(node, bands, grams)` that share a band and whose
    shingle sets have at least this Jaccard similarity.

    All pairs of a band's key with up to `bucket` members are verified. In a larger one each member is first tried
    against the one whose bands' keys have the most members in all, which in a group of near copies is nearest to
    what they are copies of. All pairs that the links do not join by then are verified in blocks.
    """
    keys = nodes.select("node", F.size("grams").alias("m"), F.posexplode("bands").alias("band", "key"))
    full = materialize(keys.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    placed = materialize(keys.join(full, ["band", "key"]), "placed")
    few = placed.where(F.col("n") <= bucket).select("band", "key", "node", "m")
    sized = lambda x, y: F.least(x, y) >= similarity * F.greatest(x, y)
    tried = few.alias("x").join(few.alias("y"), ["band", "key"]).where("x.node < y.node").where(sized(F.col("x.m"), F.col("y.m"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    crowded = placed.where(F.col("n") > bucket)
    if crowded.isEmpty():
        return _verified(materialize(tried.distinct(), "tried"), nodes, similarity)
    scores = crowded.groupBy("node").agg(F.sum("n").alias("score"))
    crowded = materialize(crowded.join(scores, "node"), "crowded")
    ones = materialize(crowded.groupBy("band", "key").agg(F.max(F.struct("score", "node", "m")).alias("one"), F.count("*").alias("n")), "ones")
    stars = join_hot(crowded.drop("n"), ones, ["band", "key"], crowded.count()).where((F.col("node") != F.col("one.node")) & sized(F.col("m"), F.col("one.m"))).select(F.least("node", "one.node").alias("a"), F.greatest("node", "one.node").alias("b"))
    tried = materialize(tried.unionAll(stars).distinct(), "tried")
    found = materialize(_verified(tried, nodes, similarity), "similar")
    return found.unionAll(_rest(crowded.select("band", "key", "node", "m"), nodes, found if known is None else found.unionAll(known), similarity, block))


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """`(doc_id, fingerprint, component_id)` for every row."""
    marked = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min(F.struct("doc_id", "h")).alias("least")), "nodes")
    named = materialize(_named(nodes, links(nodes.select("fp"), max_bits)), "components")
    return marked.join(named, "fp").select(
        F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.nullif("one.doc_id", F.lit(_LAST)).alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, max_bits: int = 2, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, with all their columns, that are the first of their group by id and then text hash; of repeated rows one.

    Groups are made by links between fingerprints within `max_bits` bits and by links between shingle sets of
    at least `similarity`. A node is a shingle set with its fingerprint, and has a number, so no two can clash.
    """
    marked = sketches(docs, id_col, text_col, words)
    nodes = marked.groupBy("fp", F.xxhash64("grams").alias("gh")).agg(F.min(F.struct("doc_id", "h", "bands", "grams")).alias("s"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "fp", F.struct("s.doc_id", "s.h").alias("least"), "s.bands", "s.grams")
    nodes = materialize(nodes, "nodes")
    ones = materialize(nodes.groupBy("fp").agg(F.min("node").alias("one")), "fingerprints")
    bits = links(ones.select("fp"), max_bits)
    first, second = (ones.select(F.col("fp").alias(c), F.col("one").alias(f"{c}_node")) for c in "ab")
    near = bits.join(first, "a").join(second, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    near = materialize(near.unionAll(nodes.select("fp", "node").join(ones, "fp").where("node != one").select(F.col("node").alias("a"), F.col("one").alias("b"))), "near")
    edges = near.unionAll(similar(nodes, similarity, known=near))
    by_id, by_hash = _free(docs, "_id"), _free(docs, "_h")
    kept = materialize(_named(nodes, edges, "node").select("one").distinct(), "first").select(F.col("one.doc_id").alias(by_id), F.col("one.h").alias(by_hash))
    keyed = docs.select("*", F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias(by_id), F.xxhash64(F.col(text_col).cast("string")).alias(by_hash))
    return keyed.join(kept.hint("shuffle_merge"), [by_id, by_hash], "left_semi").dropDuplicates([by_id, by_hash]).select(*docs.columns)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(table(spark, sf_dir, "documents"))
