"""The pipeline on a small corpus against the stages' definitions."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from polyad.llm import quality, simhash


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    common = quality.FUNCTION_WORDS["en"].split()[:20]
    good = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    texts = [good(rng.randint(60, 200)) for _ in range(40)]
    passage = good(70)
    texts[5] += passage
    texts[6] = passage + texts[6]
    texts += [texts[0], None, "short", "#$%& " * 200]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    seen = docs
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, str(tmp_path))
        out.write.parquet(path := str(tmp_path / name))
        seen = spark.read.parquet(path)
        rows[name] = {r.doc_id: r for r in seen.collect()}
        if name != "packing":
            assert seen.columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeats", "packing"]
    assert set(rows["quality_rules"]) == set(range(41))
    fps = {}
    for i in range(41):
        fps.setdefault(simhash.fingerprint(texts[i], 5), i)
    assert set(rows["near_duplicates"]) <= set(fps.values()) and 40 not in rows["near_duplicates"]
    assert set(rows["repeats"]) == set(rows["near_duplicates"])
    for i in (5, 6):
        assert passage[10:-10] not in rows["repeats"][i].text and rows["repeats"][i].n_chars == len(rows["repeats"][i].text)
    assert rows["repeats"][1].text == texts[1]
    assert set(rows["packing"]) == set(rows["repeats"])


def _run(spark, docs, folder):
    """Every stage written and read again, as the next one's input."""
    out, seen = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen, folder).write.parquet(path := f"{folder}/{name}")
        seen = spark.read.parquet(path)
        out[name] = seen
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    from collections import Counter

    from test_near import _sharing
    from test_texts import _judged
    from tokenizers import Tokenizer

    from polyad.llm.tokenizer import default_path

    rng = random.Random(17)
    common = quality.FUNCTION_WORDS["en"].split()[:20]
    words = lambda n: [rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefghé", k=rng.randint(2, 9))) for _ in range(n)]
    texts = [words(rng.randint(60, 260)) for _ in range(30)]
    for base in texts[:6]:  # near copies, of which some share a fingerprint
        for edits in (1, 2, 4):
            copy = list(base)
            for i in rng.sample(range(len(copy)), edits):
                copy[i] = "changed"
            texts.append(copy)
    passage = " ".join(words(70))
    texts = [" ".join(t) for t in texts]
    for i in (7, 9, 11):
        texts[i] = f"{texts[i]} {passage} {' '.join(words(20))}"
    texts += [texts[0], texts[8], None, "", "short", "#$%& " * 200, "same words again " * 90, " ".join(words(20_000))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, texts[3], "en", "s", 1), (12, texts[12], "en", "s", 2), (12, texts[12], "en", "s", 2)]
    names = {c: F.lit("clash") for c in ("_id", "_h", "_found", "_reference", "node", "fp", "start", "length", "kept", "word", "Found")}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns(names)
    out = _run(spark, docs, str(tmp_path))
    assert all(out[n].columns == docs.columns for n in ("quality_rules", "near_duplicates", "repeats"))
    # quality rules
    kept = [r for r, w in zip(rows, _judged([(r[1], r[2]) for r in rows])) if w[6]]
    assert Counter((r.doc_id, r.text) for r in out["quality_rules"].collect()) == Counter(r[:2] for r in kept)
    # near-duplicates: the first of each group; a null id is the last
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    groups, _ = _sharing([r[1].encode().lower().decode().split() for r in kept])
    kept = [kept[i] for i in sorted(set(groups.values()))]
    assert sorted((r.doc_id, r.text) for r in out["near_duplicates"].collect()) == sorted((r[0], r[1]) for r in kept)
    # repeats
    seen = Counter(x[i : i + 200] for x in (r[1].encode() for r in kept) for i in range(len(x) - 199))
    left = {}
    for r in kept:
        data, until, stays = r[1].encode(), 0, bytearray()
        for i in range(len(data)):
            if i <= len(data) - 200 and seen[data[i : i + 200]] > 1:
                until = i + 200
            if i >= until:
                stays.append(data[i])
        left[r[0]] = bytes(stays).decode("utf-8", "ignore")
    assert any(len(left[r[0]]) < len(r[1]) for r in kept)
    assert {r.doc_id: (r.text, r.n_chars) for r in out["repeats"].collect()} == {k: (t, len(t)) for k, t in left.items()}
    # packing: every id of every document in one place
    library = Tokenizer.from_file(default_path())
    covered = {}
    for r in out["packing"].collect():
        covered.setdefault(r.doc_id, Counter()).update(range(r.start, r.start + r.length))
    assert covered == {k: Counter(range(len(library.encode(t, add_special_tokens=False).ids) + 1)) for k, t in left.items()}
    assert sorted(covered) == sorted({r.doc_id for r in out["packing"].collect()})


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert all(df.count() == 0 for df in _run(spark, docs, str(tmp_path)).values())


def test_entry():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
    assert F is not None
