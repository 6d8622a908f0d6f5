"""Tokens, packing, quality rules, language model, urls and tool calls against brute force."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyad.llm import bpe, lattice, packing, quality, tool_calls, urls
from polyad.llm.tokenizer import default_path, encoder, unpack

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALPHABET = ["a", "b", "the", "'s", "'t", " ", "  ", "\n", "\t", "\x1c", "1", "²", "é", "中", "😀", "<|endoftext|>", "_", "!", "ñ", "ing", "\u3000", "\x00", "٣", ",", "."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def _texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(n)]


def test_bpe_is_the_librarys(library):
    own, fast = encoder(default_path()), packing._fast_encoder(default_path())
    for text in _texts(1500):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(own.encode(text)) == want
        assert fast(text).tolist() == want
        assert own.decode(want) == library.decode(want, skip_special_tokens=False) == text
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(5)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([10**6, -1]) == ""


def test_bpe_cache_bound(library):
    own = encoder(default_path())
    most, own.MOST_CACHED = own.MOST_CACHED, 5
    try:
        for text in _texts(200, 7):
            assert list(own.encode(text + " some words, more words.")) == library.encode(text + " some words, more words.", add_special_tokens=False).ids
    finally:
        own.MOST_CACHED = most


def test_bpe_query(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([None, "", *_texts(30), "long " * 5000])] + [(3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(docs).collect())
    want = Counter()
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limits", [{}, {"max_segments": 1}, {"max_segments": 1, "max_loss": 100, "context": 0}, {"max_segments": 3, "max_loss": 1500}, {"max_tokens": 64, "max_loss": 1, "context": 1, "pool": 8}, {"max_tokens": 64, "max_loss": 64, "pool": 1}])
def test_packing(spark, library, limits):
    rng = random.Random(3)
    texts = [None, "", "x", *(" ".join(rng.choices(["word", "längere", "thing,", "o"], k=rng.choice([rng.randint(1, 12), rng.randint(1, 900)]))) for _ in range(160)), "a b " * 4000]
    rows = [*enumerate(texts), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit("clash")).withColumn("length", F.lit(0)).repartition(3)
    rows = packing.pack(docs, **limits).collect()
    most, segments, loss, context = (limits.get(k, v) for k, v in (("max_tokens", 2048), ("max_segments", 8), ("max_loss", 2032), ("context", 16)))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        times = 3 if doc == 3 else 1
        covered = Counter()
        for r in by_doc[doc]:
            assert r.doc_tokens == len(ids) and r.length > 0 and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
            assert r.loss_tokens == sum(i >= context for i in range(r.start, r.start + r.length))
            covered.update(range(r.start, r.start + r.length))
        assert covered == {i: times for i in range(len(ids))}
    padding = total = 0
    bound = Counter()
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        borne = sum(r.loss_tokens for r in pieces)
        assert at <= most and len(pieces) <= segments and borne <= loss
        bound.update({"tokens": at == most, "segments": len(pieces) == segments, "loss": borne == loss})
        total += at
        padding += 0 if at & (at - 1) == 0 else most - at
    assert padding == 0
    if not limits:
        assert all(bound[k] for k in ("tokens", "segments", "loss"))  # every limit binds somewhere
        assert sum(len(p) == 1 and p[0].length < 64 for p in by_seq.values()) < 20
    assert packing.pack(docs.limit(0), **limits).count() == 0


def _base(text):
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    times, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def _kind(c):
    if ord(c) < 128:
        return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "_" if c in " \t\n\v\f\r" else "#" if c in "#*$%&|<>" else "."
    lead = c.encode()[0]
    return next(x for x in quality._LEADS if x[0] <= lead <= x[1])


def _divergence(p, q):
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 0.0
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p[k] / a, q[k] / b
        total += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v)
    return math.sqrt(max(0.0, total / 2))


def _judged(rows):
    """Verdicts and distances of `rows` (text, lang), from the definitions."""
    low = lambda t: WORD.findall(t.encode().lower().decode())
    passing = [(t or "", lang) for t, lang in rows if not (_base(t or "")[0] < 50 or 100 * _base(t or "")[4] > 50 * _base(t or "")[0])]
    langs, known, whole = {lang for _, lang in passing}, {}, Counter(_kind(c) for t, _ in passing for c in t)
    for lang in langs:
        texts = [t for t, x in passing if x == lang]
        words = Counter(w for t in texts for w in low(t))
        n = sum(words.values())
        if n >= 2000:
            common = set(quality.FUNCTION_WORDS[lang].split()) if lang in quality.FUNCTION_WORDS else {w for w, c in words.items() if 400 * c >= n}
            known[lang] = Counter(_kind(c) for t in texts for c in t), common, Counter(w if w in common else "" for t in texts for w in low(t))
    out = []
    for t, lang in rows:
        t = t or ""
        base = _base(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        classes, common, words = known.get(lang, (whole, None, None))
        far = _divergence(Counter(_kind(c) for c in t), classes)
        apart = _divergence(Counter(w if w in common else "" for w in low(t)), words) if words else 0.0
        kept = not failed and far <= 0.20 + 0.9 / math.sqrt(base[0]) and apart <= 0.15 + 1.7 / math.sqrt(base[0])
        out.append((*base, failed, kept, far, apart))
    return out


def test_quality(spark):
    rng = random.Random(5)
    common = quality.FUNCTION_WORDS["en"].split()[:20]
    good = lambda letters="abcdefgh", common=common: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(60, 300))).capitalize() + "."
    texts = [good() for _ in range(60)]
    junk = ["#$ %& " * 100 + " ".join(f"{i}|" for i in range(80)), " ".join(f"{i * 7919}" for i in range(300)), "😀 中 " * 20 + " ".join(f"é{i}" for i in range(90))]
    odd = [None, "", "a\na\n\nb\na", "x y z x y z x y", "é ñ\x1c中\n" * 3, "long " * 300_000]
    rows = [(i, t, "en") for i, t in enumerate([*texts, *junk, *odd])] + [(900, texts[0], None), (901, texts[0], "xx"), (0, texts[0], "en"), (None, texts[1], "en")]
    rows += [(1000 + i, good("абвгд", ["и", "в", "не", "на"]), "bg") for i in range(30)] + [(1100, good(), "bg"), (1101, good("абвгд", ["z"]), "bg")] + [(1200 + i, good("ðþs", ["og"]), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("kept", F.lit("clash")).withColumn("_reference", F.lit("clash"))
    want = _judged([r[1:] for r in rows])
    for most in (4096, 2):  # with 2, the smaller languages are joined
        got = sorted((tuple(r) for r in quality.judge(docs, most=most).collect()), key=str)
        for mine, theirs in zip(got, sorted(((r[0], *w) for r, w in zip(rows, want)), key=str), strict=True):
            assert mine[:8] == theirs[:8]
            assert mine[8:] == pytest.approx(theirs[8:], abs=1e-12)
        kept = quality.keep(docs, most=most)
        assert kept.columns == docs.columns
        assert Counter(map(tuple, kept.select("doc_id", "text", "lang").collect())) == Counter(r for r, w in zip(rows, want) if w[6])
    by = {r[0]: w[6] for r, w in zip(rows, want)}
    assert all(by[i] for i in range(60)) and not any(by[60 + i] for i in range(3)) and by[1000] and not by[1100]
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep(docs.limit(0)).count() == 0
    assert quality.keep(docs.where("lang = 'en'").drop("lang")).count() > 50


def test_distance():
    assert quality.distance(np.array([1, 0]), np.array([0, 5])) == pytest.approx(1)
    assert quality.distance(np.array([2, 2]), np.array([5, 5])) == pytest.approx(0)
    assert quality.distance(np.array([0, 0]), np.array([5, 5])) == 0


def _all_ways(word, p):
    if not word:
        return 1.0
    return sum(p[word[:i]] * _all_ways(word[i:], p) for i in range(1, len(word) + 1) if word[:i] in p)


def test_lattice_sums_all_segmentations():
    p = {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.15, "▁a": 0.05, "ba": 0.1, "bab": 0.02}
    names = [*p, *(f"<0x{i:02X}>" for i in range(256))]
    model = lattice.Lattice(names, [math.log(x) for x in p.values()] + [math.log(0.001)] * 256)
    for word in ("a", "ab", "abab", "babab", "aabbab"):
        assert model.word(word) == pytest.approx(math.log(_all_ways("▁" + word, p)))
    assert model.word("aé") == pytest.approx(math.log(_all_ways("▁a", p) * 0.001**2))
    counts = [0.0] * len(names)
    model.expect("ab", 3.0, counts)
    whole = _all_ways("▁ab", p)
    ways = {("▁", "a", "b"): 0.1 * 0.2 * 0.1, ("▁", "ab"): 0.1 * 0.15, ("▁a", "b"): 0.05 * 0.1}
    assert sum(ways.values()) == pytest.approx(whole)
    for i, name in enumerate(p):
        assert counts[i] == pytest.approx(3 * sum(v for k, v in ways.items() if name in k) / whole)


def _spellings(word, p):
    """Edges (start, end, pieces) of a word's lattice, from the definition."""
    text, names = "▁" + word, set(p)
    return text, [(i, j, [text[i:j]]) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in names] + [(i, i + 1, [f"<0x{b:02X}>" for b in c.encode()]) for i, c in enumerate(text) if c not in names]


def _forward_backward(word, p):
    """Probability of a word and expected counts of its pieces, without logarithms."""
    text, edges = _spellings(word, p)
    weight = {(i, j, tuple(x)): math.prod(p[k] for k in x) for i, j, x in edges}
    alpha, beta = [1.0] + [0.0] * len(text), [0.0] * len(text) + [1.0]
    for j in range(1, len(text) + 1):
        alpha[j] = sum(alpha[i] * weight[i, k, tuple(x)] for i, k, x in edges if k == j)
    for i in range(len(text) - 1, -1, -1):
        beta[i] = sum(beta[k] * weight[h, k, tuple(x)] for h, k, x in edges if h == i)
    counts = Counter()
    for i, j, x in edges:
        for k in x:
            counts[k] += alpha[i] * weight[i, j, tuple(x)] * beta[j] / alpha[-1]
    return alpha[-1], counts


def test_scores(spark):
    rng = random.Random(6)
    texts = [None, "", "A b\tC", "日本 é Öl Été Öl", "x" * 150, "x" * 150, "heldword " * 3, *(" ".join(rng.choices(["the", "of", "walk", "walking", "walked", "talks", "x9"], k=rng.randint(1, 40))) for _ in range(60))]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    ids = [i for i in range(500) if not held(i)]
    ids = ids[:6] + [i for i in range(500) if held(i)][:1] + list(range(600, 660))  # "heldword" is hot where nothing trains
    rows = list(zip(ids, texts, strict=True)) + [(ids[5], texts[5]), (ids[20], texts[20]), (None, texts[30])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit(1), "c": F.lit(1), "row": F.lit(1)})
    low = lambda t: WORD.findall((t or "").encode().lower().decode())
    counts, every, documents = Counter(), Counter(), 0
    for i, t in rows:
        every.update(low(t))
        if not held(i):
            counts.update(low(t))
            documents += 1
    n, v = sum(counts.values()) + documents, len(counts) + 1
    # the weights, by expectation-maximisation from the definition: three rounds over frequent words, one over all
    names, start = lattice.vocabulary(default_path("piece_bpe_32k.model"))
    p = {k: w / (sum(start) + 1) for k, w in zip(names, start, strict=True)}
    end = 1 / (sum(start) + 1)
    total = sum(every.values())
    frequent = {w: c for w, c in counts.items() if every[w] > 1 and every[w] * lattice.FREQUENT >= total * math.ceil(len(w) / 64)}
    for words in (frequent, frequent, frequent, counts):
        expected = Counter()
        for w, c in words.items():
            for k, x in _forward_backward(w, p)[1].items():
                expected[k] += c * x
        whole = sum(expected.values()) + 0.1 * len(names) + documents
        p, end = {k: (expected[k] + 0.1) / whole for k in names}, documents / whole
    got = lattice.score(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        words = low(t)
        cs = [counts[w] for w in words] + [documents]
        model = sum(math.log10(_forward_backward(w, p)[0]) for w in words) + math.log10(end)
        by.setdefault(i, []).append((held(i), len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 1) / (n + v + 1)) for c in cs), model))
    for r in got:
        assert any(tuple(r)[1:5] == x[:4] and tuple(r)[5:] == pytest.approx(x[4:], abs=1e-6) for x in by[r.doc_id])
    assert "▁É" in names and "▁the" in names and "▁The" not in names
    assert lattice.score(docs.limit(0)).count() == 0
    cold = lattice.score(docs.where("doc_id = " + str(ids[6]))).collect()  # nothing trains
    assert (cold[0].train_tokens, cold[0].n_known, cold[0].n_tokens) == (0, 0, 4) and math.isfinite(cold[0].score)


def _rule(url, rules=urls.RULES):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = sorted((-len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
    return host, path, fits[0][1:] if fits else None


def test_urls(spark):
    rng = random.Random(8)
    hosts = ["example.com", "a.Example.com", "net", "b.net", "xexample.net", "example.net", "org", "é.org", "", "user@h.com:80", "b.com"]
    made = ["".join([rng.choice(["http", "https", "x"]), rng.choice(["://", "://", "://", ":/"]), rng.choice(hosts), rng.choice(["", "/", "/en/7", "/en/1", "/de/8", "/de/", "/es/a://b", "/EN/", "/en/abcd"]), rng.choice(["", "?q=1&r=2", "#/en/", "?/en/"])]) for _ in range(200)]
    made += ["http://b.com/en/abcd", "http://b.net/" + "a/" * 50_000, made[0], made[0]]
    table = [(i, u, "h", "x") for i, u in enumerate([None, "", *made])]
    pages = spark.createDataFrame(table, "page_id bigint, url string, host string, rule string")
    labelled = spark.createDataFrame([(f"http://s{i % 7}.example.{'com' if i % 2 else 'bad'}/en/{i}{'-x' * (i % 3)}", i % 2) for i in range(400)], "url string, bad int")
    model = urls.fit(labelled)
    tied = [("block", "com", "/en/abc"), ("allow", "b.com", "/en/a"), ("block", "b.com", "/en/a")]  # of one length
    for rules in (urls.RULES, urls.RULES + tied, urls.RULES + tied + [("block", f"h{i}.invalid", "/") for i in range(120)]):
        for inline in (0, 10**6):
            got = {r.page_id: r for r in urls.judge(pages, model, rules=rules, most_inline=inline).collect()}
            assert len(got) == len(table)
            for i, u in enumerate([None, "", *made]):
                host, path, fit = _rule(u, rules)
                assert (got[i].host, got[i].path, got[i].rule) == (host, path, fit and fit[0])
                assert got[i].verdict == (fit[1] if fit else "block" if got[i].bad > 0.5 else "allow")
    assert {r.verdict for r in urls.judge(pages, labelled.limit(0), rules=[]).collect()} == {"allow"}
    assert {r.verdict for r in urls.judge(pages, labelled.where("bad = 1"), rules=[]).collect()} == {"block"}
    assert urls.judge(pages.limit(0), labelled).count() == 0


@pytest.mark.parametrize("n", [12, 400])
def test_url_trees(spark, n):
    from pyspark.ml.feature import VectorAssembler

    rng = random.Random(n)
    labelled = [(f"http://s{i % 7}.example.{'com' if i % 2 else 'bad'}/en/{i}{'-x' * rng.randrange(4)}?a={i}", i % 2) for i in range(n)]
    model = urls.fit(spark.createDataFrame(labelled, "url string, bad int"))
    test = [(i, f"http://t.example.{'com' if i % 2 else 'bad'}/fr/{i}{'&b=1' * (i % 3)}", i % 2) for i in range(60)]
    ready = model.featured(urls.lexical(spark.createDataFrame(test, "page_id bigint, url string, label int")))
    scored = model.trees.transform(VectorAssembler(inputCols=urls.FEATURES, outputCol="features").transform(ready)).withColumn("own", model.bad())
    for r in scored.collect():  # the SQL is the fitted model
        assert r.own == pytest.approx(r.probability[1], abs=1e-12)
    # what is learnt holds for urls that were not labelled
    judged = {r.page_id: r.bad > 0.5 for r in urls.judge(spark.createDataFrame(test, "page_id bigint, url string, label int"), spark.createDataFrame(labelled, "url string, bad int"), rules=[]).collect()}
    assert sum(judged[i] == bool(label) for i, _, label in test) >= (54 if n == 400 else 25)
    # features against their definitions
    for r in ready.collect():
        u = r.url
        counts = Counter(u)
        assert r.n == len(u) and r.digits == pytest.approx(sum(c.isdigit() for c in u) / len(u)) and r.depth == r.path.count("/") and r.dots == r.host.count(".") and r.hyphens == u.count("-")
        assert r.entropy == pytest.approx(-sum(c / len(u) * math.log2(c / len(u)) for c in counts.values()))
        assert r.parameters == (u.split("?", 1)[1].count("&") + 1 if "?" in u else 0)


_CALL = '{"id":"%s","name":"%s","arguments":%s}'


def test_tool_calls(spark):
    call = _CALL
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", 'say "hi"\n'), (1, 2, "assistant", "hi"), (1, 4, "assistant", "?"), (1, 5, "user", None),
        (2, 1, "tool", '{"tool_call_id":"c1","content":"early"}'), (2, 3, "assistant", call % ("c1", "ask", '{"turn":1,"text":"a"}')),
        (2, 4, "assistant", call % ("c2", "ask", '{"text":{"$result":"c1"},"turn":"x"}')), (2, 5, "assistant", call % ("c1", "none", "{}")), (2, 6, "tool", '{"tool_call_id":"zz","content":"lost"}'),
        (3, 1, "assistant", call % ("s", "ask", '{"text":"v","turn":"5"}')), (3, 2, "assistant", call % ("n", "ask", '{"text":{"text":"deep"},"turn":5}')), (3, 3, "assistant", call % ("e", "ask", '{"text":"","turn":5}')),
        (3, 4, "assistant", call % ("f", "ask", '{"text":"v","turn":1.5}')), (3, 5, "assistant", call % ("m", "ask", '{"text":"v","turn":5,"more":1}')), (3, 6, "assistant", call % ("q", "ask", '"{\\"text\\":\\"v\\",\\"turn\\":5}"')),
        (3, 7, "assistant", call % ("d", "ask", '{"text":"a","text":"b","turn":1}')), (3, 8, "tool", '{"tool_call_id":"s","content":{"z":[{"b":1,"a":2.50}],"y":null}}'), (3, 9, "assistant", '{"id":7,"name":"ask"}'),
        (None, 1, "user", "x"), (None, 2, "assistant", "y"), (4, None, "user", "x"), (4, None, None, None), (5, 1, "user", "long " * 300_000),
    ]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("status", F.lit(0)).withColumn("row", F.lit(0))
    out = tool_calls.link(table).collect()
    assert len(out) == len(rows)
    got = {(r.conv_id, r.turn): r for r in out}
    want = {(1, 0): ("plain", None), (1, 1): ("linked", True), (1, 2): ("linked", None), (1, 4): ("orphan", None), (1, 5): ("open", False), (2, 1): ("linked", None), (2, 3): ("linked", True), (2, 4): ("open", False), (2, 5): ("repeated", False), (2, 6): ("orphan", None)}
    want |= {(3, 1): ("linked", False), (3, 2): ("open", False), (3, 3): ("open", False), (3, 4): ("open", False), (3, 5): ("open", False), (3, 6): ("open", True), (3, 7): ("orphan", None), (3, 8): ("linked", None), (3, 9): ("orphan", None)}
    want |= {(None, 1): ("open", True), (None, 2): ("orphan", None), (5, 1): ("open", True)}
    assert {k: (r.status, r.valid) for k, r in got.items() if k != (4, None)} == want
    assert sorted((r.status, r.valid) for r in out if r.conv_id == 4) == [("open", False), ("plain", None)]
    assert (got[2, 1].order_turn, got[2, 1].order_level) == (3, 1) and (got[2, 4].order_turn, got[2, 4].order_level) == (4, 2)  # the result moves behind its call
    assert got[1, 1].message == '{"arguments":{"text":"say \\"hi\\"\\n","turn":1},"id":"turn-1","name":"ask","role":"user"}'
    assert got[2, 1].message == '{"content":"early","role":"tool","tool_call_id":"c1"}'
    assert got[2, 3].message == '{"arguments":{"text":"a","turn":1},"id":"c1","name":"ask","role":"assistant"}'
    assert got[3, 8].message == '{"content":{"y":null,"z":[{"a":2.5,"b":1}]},"role":"tool","tool_call_id":"s"}'
    assert got[3, 7].message.startswith('{"content":"{\\"id')
    assert tool_calls.link(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def _places(rows):
    """By row: the sort key, or None for what depends on itself; `rows`: (turn, kind, id, refers)."""
    first = {}
    for i, (turn, kind, name, _) in enumerate(rows):
        if kind == "call" and (name not in first or turn < rows[first[name]][0]):
            first[name] = i
    needs = {}
    for i, (_, kind, name, refers) in enumerate(rows):
        if kind == "call":
            needs[i] = [j for j, r in enumerate(rows) if r[1] == "result" and r[2] in refers]
        else:
            needs[i] = [first[name]] if name in first else []
    found = {}
    for _ in rows:
        for i in needs:
            if i not in found and all(j in found for j in needs[i]):
                found[i] = max([rows[i][0], *(found[j][0] for j in needs[i])]), 1 + max([-1, *(found[j][1] for j in needs[i])])
    return first, needs, {i: found.get(i) for i in needs}


@pytest.mark.parametrize("most_edges", [200_000, 0])
def test_tool_call_order(spark, most_edges):
    rng = random.Random(31)
    conversations = {}
    for conv in range(25):
        n = rng.randint(1, 14)
        rows = []
        for turn in rng.sample(range(100), n + rng.randint(0, 12)):
            name = f"c{rng.randrange(n)}"
            if rng.random() < 0.55:
                rows.append((turn, "call", name, {f"c{rng.randrange(n)}" for _ in range(rng.choice([0, 0, 1, 2]))}))
            else:
                rows.append((turn, "result", name, set()))
        conversations[conv] = rows
    # a chain of 60 calls behind one late result, told backwards; and two calls that wait for each other
    conversations[100] = [x for k in range(60) for x in ((100 - k, "call", f"k{k}", {f"k{k - 1}"} if k else {"late"}), (200 - k, "result", f"k{k}", set()))] + [(999, "result", "late", set())]
    conversations[101] = [(1, "call", "a", {"b"}), (2, "call", "b", {"a"}), (3, "result", "a", set()), (4, "result", "b", set()), (5, "call", "c", {"a"}), (6, "call", "a", {"q"})]
    if most_edges == 0:
        conversations[100] = conversations[100][:12] + conversations[100][-1:]
    table = []
    for conv, rows in conversations.items():
        for turn, kind, name, refers in rows:
            body = _CALL % (name, "t", '{ "x" : [%s] }' % ",".join('{ "$result" : "%s" }' % r for r in sorted(refers))) if kind == "call" else '{"tool_call_id":"%s","content":1}' % name
            table.append((conv, turn, "x", body))
    got = {(r.conv_id, r.turn): r for r in tool_calls.link(spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string"), most_edges=most_edges).collect()}
    assert len(got) == len(table)
    cyclic = 0
    for conv, rows in conversations.items():
        first, needs, places = _places(rows)
        key = lambda i: (got[conv, rows[i][0]].order_turn, got[conv, rows[i][0]].order_level)
        for i, place in places.items():
            r = got[conv, rows[i][0]]
            assert (r.status == "cyclic") == (place is None)
            cyclic += place is None
            assert key(i) == ((rows[i][0], 0) if place is None else place)
            assert place is None or all(key(j) < key(i) for j in needs[i])
            if place is not None:
                assert r.status == ("repeated" if rows[i][1] == "call" and first[rows[i][2]] != i else "linked" if any(x[2] == rows[i][2] and x[1] != rows[i][1] for x in rows) else "open" if rows[i][1] == "call" else "orphan")
    assert cyclic > 4


def _licence_text(name):
    from polyad.llm.licence_texts import TEXTS

    return next(t for n, _, t in TEXTS if n == name)


@pytest.mark.parametrize("width", [40, 60, 72, 76, 79, 100])
def test_licences_have_one_digest_however_wrapped(width):
    import textwrap

    from polyad.llm import licences
    from polyad.llm.licence_texts import TEXTS

    known = dict(licences.known_digests())
    for name, titles, text in TEXTS:
        wrapped = "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))
        assert known[licences.digest(wrapped)] == name
        for title in titles:
            assert known[licences.digest(f"{title}\n\nCopyright (c) 2008-2020 A. B and contributors.\nCopyright 2021 C\nAll rights reserved.\n© D\n\n{wrapped.upper()}")] == name
        assert licences.digest(wrapped + " x") not in known


def test_long_licences_are_rebuilt():
    from polyad.llm import licences

    found = licences.digests_of("/usr/share/common-licenses")
    assert set(found) <= set(licences.LONG)
    if found:
        assert set(found) == set(licences.LONG)


def test_licences(spark):
    import duckdb

    from polyad.llm import licences

    isc = _licence_text("ISC")
    texts = [
        isc, isc.upper().replace(",", " ,\n"), "ISC Licence\n\nCopyright (c) 2020, A & B\n© 2021 C\n\n" + isc, "x " + isc, None, "", "!?\n", "© me",
        "Released under the MIT Licence", "released — under “the” MIT license!", "Copyright lines\ncopyright 1\nÉté & naïve – tests\r\n(c) x", "a\nlabelled programme & https", "ſ İ K",
        "Some prose.\n  Released under the MIT License.\nmore\n* licensed under CC BY-NC 4.0\nLicensed under cc by nc 4 0", "He released under the MIT License. So it goes.", "long words " * 200_000 + "\nLicensed under the Apache Licence, version 2.0",
    ]
    docs = spark.createDataFrame([*enumerate(texts), (0, isc)], "doc_id bigint, text string").withColumn("licence", F.lit("clash")).withColumn("form", F.lit("clash"))
    got = sorted(map(tuple, licences.scan(docs).collect()), key=str)
    known = dict(licences.known_digests())
    lines = {licences.digest(line): name for name, line in licences.NOTICES}

    def noticed(text):
        found = {lines.get(licences.digest(x)) for x in (text or "").split("\n")} - {None}
        return ", ".join(sorted(found)) or None

    want = sorted(((i, len(licences.canonical_text(t)), licences.digest(t), known.get(licences.digest(t)), noticed(t)) for i, t in [*enumerate(texts), (0, isc)]), key=str)
    assert got == want
    by = {r[0]: r[3:] for r in got}
    assert [by[i][0] for i in range(4)] == ["ISC", "ISC", "ISC", None]
    assert by[8] == by[9] == ("MIT", "MIT") and by[13] == (None, "CC-BY-NC-4.0, MIT") and by[14] == (None, None) and by[15] == (None, "Apache-2.0")
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    assert sorted(duckdb.sql(licences.oracle()).fetchall(), key=str) == want
    listed = spark.createDataFrame([(licences.digest("a"), "z"), (licences.digest("a"), "b")], "digest string, licence string")
    one = spark.createDataFrame([(1, "A!")], "doc_id bigint, text string")
    assert licences.scan(one, listed).first().licence == licences.scan(one, listed, most_sent=0, notices=[]).first().licence == "b"
    assert licences.scan(docs.limit(0)).count() == 0
