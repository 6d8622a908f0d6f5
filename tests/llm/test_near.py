"""SimHash groups, components, repeats and fingerprints against brute force."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyad.llm import imatch, simhash, suffix_dedup
from polyad.llm.components import components


def _groups(values, linked):
    """Least value reachable from each."""
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {v: find(v) for v in values}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    want = {k: v for k, v in _groups({x for e in edges for x in e}, edges).items() if k != v}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("bucket", [64, 2])
@pytest.mark.parametrize("max_bits", [1, 2])
def test_links_lose_nothing(spark, bucket, max_bits):
    rng = random.Random(bucket)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(fps)[:12]:
        for _ in range(8):
            x = fp
            for b in rng.sample(range(64), rng.randint(1, 3)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted({simhash._signed(x) for x in fps})
    close = [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= max_bits]
    found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp bigint"), max_bits, bucket).collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= max_bits for a, b in found)
    assert _groups(fps, found) == _groups(fps, close)


def test_allocation_sums_and_is_least():
    costs = [{-1: 0.0, 0: 5.0, 1: 50.0}, {-1: 0.0, 0: 7.0, 1: 20.0}, {-1: 0.0, 0: 1.0, 1: 2.0}]
    assert simhash.allocate(costs, 0) == (7.0, [0, -1, 1])


def test_simhash_groups(spark):
    base = "one two three four five six seven eight nine ten " * 3
    rows = [(3, base, "x"), (1, base, "y"), (7, None, None), (5, "", "z"), (9, "a", "q"), (9, "a", "q"), (None, "b c", "n"), (11, base.upper(), "u")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = simhash.group(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by == {3: 1, 1: 1, 11: 1, 7: 5, 5: 5, 9: 9, None: None}
    assert {r.fingerprint for r in got if r.doc_id == 7} == {"0" * 16}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 5, 9]
    assert simhash.group(docs.limit(0)).count() == 0


def _sharing(texts, words=5):
    """Groups of texts: those that are 0.8 similar and share a band, and those within two bits; least index of each."""
    sets = [set(zip(*(t[i:] for i in range(words)))) or {tuple(t)} for t in texts]
    hashes = [simhash.shingle_hashes(" ".join(t), words) for t in texts]
    keys = [set(enumerate(simhash.bands(np.unique(h)))) for h in hashes]
    fps = [simhash.majority(h) for h in hashes]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    close = [(i, j) for i in range(len(texts)) for j in range(i) if keys[i] & keys[j] and alike(i, j) or bin(fps[i] ^ fps[j]).count("1") <= 2]
    missed = [(i, j) for i in range(len(texts)) for j in range(i) if alike(i, j) and not keys[i] & keys[j]]
    return _groups(range(len(texts)), close), len(missed)


@pytest.mark.parametrize("bucket", [64, 1])
def test_similar_texts(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash.similar, "__defaults__", (0.8, bucket))
    rng = random.Random(6)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [text(300) for _ in range(30)]
    for base in texts[:10]:
        for edits in (1, 3, 5, 12):
            copy = list(base)
            for i in rng.sample(range(len(copy)), edits):
                copy[i] = "changed"
            texts.append(copy)
    texts += [["one", "two"], ["three"], text(4)]
    want, missed = _sharing(texts)
    assert missed <= 1
    names = {"_id": 1, "_h": 2, "fp": 3, "n": 4, "node": 5, "One": 6}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumns({k: F.lit(v) for k, v in names.items()})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_one_fingerprint_many_texts(spark):
    """Texts that share a fingerprint with another are tried for themselves."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    chain = [base]
    for _ in range(40):  # each a little further from the first
        step = list(chain[-1])
        for i in rng.sample(range(400), 4):
            step[i] = f"x{rng.randrange(10**6)}"
        chain.append(step)
    rng.shuffle(chain)
    want, _ = _sharing(chain)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(chain)] + [(None, " ".join(chain[0])), (None, None), (None, "")], "doc_id bigint, text string")
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in simhash.keep_one(docs).collect()) == sorted([*set(want.values()), -1])


@pytest.mark.parametrize("bucket, block", [(64, 512), (64, 50), (1, 7)])
def test_crowded_keys_lose_nothing(spark, bucket, block, monkeypatch):
    monkeypatch.setattr(simhash.similar, "__defaults__", (0.8, bucket))
    monkeypatch.setitem(simhash.similar.__kwdefaults__, "block", block)
    rng = random.Random(11)
    texts = []
    for n, edits, original in ((300, 6, True), (120, 4, False)):  # without the original, links run along chains
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        texts += [base] if original else []
        for _ in range(150):
            copy = list(base)
            for i in rng.sample(range(n), rng.randint(1, edits)):
                copy[i] = f"x{rng.randrange(10**6)}"
            texts.append(copy)
    rng.shuffle(texts)
    # a link at the edge of 0.8 may share no band; all that share one have to be found
    want, _ = _sharing(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want.values())


def test_fingerprint_bits():
    from xxhash import xxh64_intdigest

    words = "a B c d e f".lower().split()
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert simhash.fingerprint("a B c\td  e\nf") == want


def _removed(texts, length):
    seen = Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        gone, until = [False] * len(x), 0
        for i in range(len(x)):
            if i <= len(x) - length and seen[x[i : i + length]] > 1:
                until = i + length
            gone[i] = i < until
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_repeats(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated, "__defaults__", (200, crowd))
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    passages = [word(rng.randint(150, 700)) for _ in range(8)]
    texts = [None, "", "z" * 450, "ab" * 300, word(199)]
    for _ in range(90):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            parts.append(p[rng.randint(0, 60) : rng.randint(len(p) - 60, len(p))] if rng.random() < 0.6 else word(rng.randint(0, 200)))
        texts.append("".join(parts))
    texts.append(texts[40])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("h", F.lit("x"))
    want = _removed([(t or "").encode() for t in texts], 200)
    found = [tuple(r) for r in suffix_dedup.dedup(docs).collect()]
    got = {r[0]: r[1:] for r in found}
    assert got == dict(enumerate(want)) and len(found) == len(want)
    # null ids and repeated rows
    rows = [(i % 30 if i % 5 else None, t) for i, t in enumerate(texts)] + [(0, texts[40]), (0, texts[40]), (None, texts[41]), (None, None)]
    want_of = Counter((i, *w) for (i, _), w in zip(rows, _removed([(t or "").encode() for _, t in rows], 200)))
    assert Counter(map(tuple, suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())) == want_of
    clash = docs.withColumns({"_id": F.lit(1), "_H": F.lit(2), "_found": F.lit(3), "found": F.lit(4), "data": F.lit(5)})
    assert suffix_dedup.clean(clash).columns == clash.columns
    clean = suffix_dedup.clean(clash).select("doc_id", "text").collect()
    assert len(clean) == len(texts)
    assert all(len((r.text or "").encode()) <= want[r.doc_id][0] - want[r.doc_id][1] for r in clean)
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_stretches_join(monkeypatch):
    rng = random.Random(5)
    data = bytes(rng.choice(b"abc") for _ in range(3000))
    whole = suffix_dedup.runs_of(data, 200)
    monkeypatch.setattr(suffix_dedup, "_STRETCH", 700)
    cut = suffix_dedup.runs_of(data, 200)
    of = lambda runs: {p: a for s, e, a in zip(*runs[:3]) for p in range(s, e)}
    assert of(whole) == of(cut)
    assert set(of(whole)) == set(range(len(data) - 199))


def test_loser_tree_and_front_coding():
    rng = random.Random(2)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    coded = [suffix_dedup.front_decode(suffix_dedup.front_code(r)) for r in runs]
    assert [c[1] for c in coded] == runs
    out, last = [], b""
    for run, at, share in suffix_dedup.LoserTree(coded):
        s = runs[run][at]
        assert share == suffix_dedup.common(last, s)
        out.append(s)
        last = s
    assert out == sorted(s for r in runs for s in r)


def _xx(data, seed=42):
    from xxhash import xxh64_intdigest

    return simhash._signed(xxh64_intdigest(data, seed % 2**64))


def _marked(texts):
    """Fingerprints from the definition: `texts` are (kept in the band, all) of terms."""
    long = lambda x: (x % 2**64).to_bytes(8, "little")
    out = []
    for kept, every in texts:
        terms = kept or every
        parts = []
        for i in range(imatch.LEXICONS):
            # a term's place in lexicon i: it is in level j if the place is below 2**(63 - j)
            place = {t: (_xx(i.to_bytes(4, "little"), _xx(long(t))) % 2**64) >> 1 for t in terms}
            if not terms:
                parts.append("0" * 8)
                continue
            top = 1 << max(1, min(place.values()).bit_length())  # the sparsest level that holds any term
            seed = 42
            for k in sorted(p for p in place.values() if p < top):
                seed = _xx(long(k), seed)
            parts.append(f"{seed % 2**32:08x}")
        out.append("".join(parts))
    return out


def test_imatch(spark):
    rng = random.Random(4)
    words = [f"W{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=rng.randint(1, 80))) for _ in range(150)] + ["", None, "É 😀 x", "lone only", "word " * 100_000]
    texts[20] = texts[3]
    ids = [*rng.sample(range(10_000), len(texts) - 1), None]
    rows = list(zip(ids, texts, strict=True)) + [(ids[7], texts[7]), (ids[7], texts[9]), (ids[7], texts[9])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("bucket", "key", "h", "at", "guest")})
    got = sorted(map(tuple, imatch.fingerprints(docs).collect()), key=str)
    assert got == sorted(map(tuple, imatch.fingerprints(docs, most_sent=0).collect()), key=str)
    order = sorted(((-(2**63) if i is None else i, _xx((t or "").encode()), t or "") for i, t in rows), key=lambda x: x[:2])
    edited = []
    for i, (_, _, own) in enumerate(order):
        n = len(own) // 4
        edited.append(own[: len(own) - n] + order[(i + 1) % len(order)][2][:n])
    split = lambda t: {x for x in t.encode().lower().decode().replace("\t", " ").split(" ") if x}
    sets = {frozenset(split(t)) for _, t in [(0, x[2]) for x in order]}
    df = Counter(w for s in sets for w in s)
    low, high = max(2.0, len(sets) * 0.0005), max(10.0, len(sets) * 0.01)
    banded = {w for w, n in df.items() if low <= n <= high}
    assert 0 < len(banded) < len(df)
    marks = lambda ts: _marked([([_xx(w.encode()) for w in split(t) & banded], [_xx(w.encode()) for w in split(t)]) for t in ts])
    own, new = marks([x[2] for x in order]), marks(edited)
    likeness = lambda a, b: sum(a[8 * k : 8 * k + 8] == b[8 * k : 8 * k + 8] for k in range(16)) / 16
    want = [(None if key == -(2**63) else key, len(t), sha256(edited[i].encode()).hexdigest(), own[i], new[i], likeness(own[i], new[i]), likeness(own[i], own[(i + 1) % len(order)])) for i, (key, _, t) in enumerate(order)]
    assert got == sorted(want, key=str)
    assert np.mean([r[5] for r in got]) > 0.3 > np.mean([r[6] for r in got])
    assert imatch.fingerprints(docs.limit(0)).count() == 0
    one = imatch.fingerprints(docs.limit(1)).first()
    assert one.near_next == 1.0


def test_buckets_of_hot_ids(spark):
    rng = random.Random(5)
    keys = [*[7] * 400, *[9] * 100, *rng.sample(range(1000), 300), *[imatch._LEAST] * 200]
    rows = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "key bigint, text string")
    placed = imatch._in_order(rows, 20)[0].where("guest = 0").collect()
    order = sorted((r.key, r.h, r.bucket) for r in placed)
    assert [x[2] for x in order] == sorted(x[2] for x in order) and len(order) == len(keys)
    sizes = Counter(x[2] for x in order)
    assert max(sizes.values()) < 130
    lent = Counter(r.bucket for r in imatch._in_order(rows, 20)[0].where("guest = 1").collect())
    assert set(lent) == set(sizes) and set(lent.values()) == {1}


def test_imatch_of_many_copies(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.sample(words, 80)) for _ in range(100)]
    copied = " ".join(rng.sample(words, 80))
    lone = " ".join(f"only{i}" for i in range(80))  # no term in the band however it is counted
    docs = spark.createDataFrame(list(enumerate([*texts, *[copied] * 60, *[lone] * 30])), "doc_id bigint, text string")
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    for ids in (range(100, 160), range(160, 190)):
        assert len({got[i].fingerprint for i in ids}) == 1
        assert np.mean([got[i].near_edited for i in ids]) > 0.3
    kept = {r.h for r in imatch.band(docs.select("text")).collect()}
    assert kept == {r.h for r in imatch.band(docs.where("doc_id <= 100 or doc_id = 160").select("text")).collect()}
