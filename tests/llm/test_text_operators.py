"""Operators on documents against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import components, decontaminate, langid, lines, mixing, ngrams, queries, simhash, toxicity

from .conftest import AWKWARD, prose


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text)) if w]


# simhash -----------------------------------------------------------------------------------------------------------


def plain_print(text, k=3):
    w = blank_words(text)
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB c\néあ", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint_of(simhash.shingle_hashes(text, 3)) & (1 << 64) - 1 == plain_print(text)


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5100)]
    want = groups({x for p in links if p[0] != p[1] for x in p}, links)
    got = components.components(spark.createDataFrame(links + [(None, 1), (9, None)], "u long, v long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 60)
    near = [int(b) ^ sum(1 << int(i) for i in rng.integers(0, 63, rng.integers(0, 6))) for b in base for _ in range(5)]
    values = sorted({*map(int, base), *near, 0, -1, 1, (1 << 63) - 1})
    df = spark.createDataFrame([(v, v) for v in values], "id long, fp long")
    for radius in (0, 3, 9):
        apart = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
        want = groups(values, [p for p in combinations(values, 2) if apart(*p) <= radius])
        got = {r.node: r.root for r in components.components(simhash.candidate_links(df, radius, tile=16)).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_classes(spark, awkward, empty):
    rows = simhash.fingerprint_classes(awkward).collect()
    assert len(rows) == len(AWKWARD) + 3 and simhash.fingerprint_classes(empty).count() == 0
    assert all(r.component_id == 0 for r in rows if r.fingerprint == 0)
    assert {r.component_id for r in rows if r.doc_id in (4, 50)} == {4}


def test_keep_one(spark, rng, awkward, empty):
    rows, texts = [], []
    for i in range(12):
        text = prose(rng, 150).split()
        for j, edits in enumerate((0, 0, 1, 2, 12, 40)):
            copy = list(text)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = f"new{rng.random()}"
            texts.append(" ".join(copy))
            rows.append((i * 10 + j, texts[-1], "x"))
    sets = [set(zip(*(blank_words(t)[k:] for k in range(5)), strict=False)) for t in texts]
    ids = [r[0] for r in rows]
    alike = [(ids[a], ids[b]) for a, b in combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    want = sorted(set(groups(ids, alike).values()))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert got == want
    assert sorted(r.doc_id for r in simhash.keep_one(docs, group=3).collect()) == want
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and simhash.keep_one(empty).count() == 0
    found = [r.doc_id for r in kept.collect()]
    assert found.count(4) == 1 and 50 not in found and 0 in found and 1 not in found and 2 not in found


# decontamination ---------------------------------------------------------------------------------------------------


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def plain_report(docs, items):
    windows = defaultdict(set)
    for ident, text in items:
        w = item_words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows[tuple(w[i : i + n])].add(ident)
    out = []
    for ident, text in docs:
        w, hit, names = item_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    names |= {str(x) for x in windows[k] if x is not None}
        out.append((ident, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontaminate(spark, rng, awkward, empty):
    passages = [prose(rng, n) for n in (1, 5, 12, 13, 14, 30, 60)] + ["a a a a a a a a a a a a a a a a a a", None, "", "?!"]
    items = [(i if i != 4 else None, t) for i, t in enumerate(passages)] + [(6, passages[6]), (99, passages[6] + " more")]
    docs = [(i, prose(rng, 40) + ", " + (p or "").upper() + "; " + prose(rng, 30)) for i, p in enumerate(passages)]
    docs += [(20, passages[5][: len(passages[5]) // 2]), (21, "a " * 40), (22, "a " * 12), (23, passages[6] + " " + passages[6]), (24, None), (25, ""), (26, prose(rng, 2000) + " " + passages[3])]
    made = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = decontaminate.report(made(docs, "doc_id"), made(items, "item_id"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_report(docs, items)
    long_items = [x for x in items if len(item_words(x[1])) >= 13]
    got = decontaminate.report(made(docs, "doc_id"), made(long_items, "item_id"))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_report(docs, long_items)
    none = decontaminate.report(awkward, made([], "item_id"))
    assert none.count() == len(AWKWARD) + 3 and not none.where("contaminated").count()
    own = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted(map(tuple, decontaminate.report(awkward, made(items, "item_id")).collect()), key=repr) == plain_report(own, items)
    kept = decontaminate.clean(awkward, made([(1, "two words")], "item_id"))
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD) - 1 and decontaminate.clean(empty, made(items, "item_id")).count() == 0


def test_decontamination_is_native(spark):
    docs = spark.createDataFrame([(1, "x " * 30)], "doc_id long, text string")
    plan = decontaminate.report(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# lines -------------------------------------------------------------------------------------------------------------


def plain_lines(rows, least):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for ident, t in rows:
        stay = [x for x in (t or "").split("\n") if seen[key(x)] < least]
        out.append((ident, len((t or "").split("\n")), len((t or "").split("\n")) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_lines(spark, rng, awkward, empty):
    common = ["All rights reserved.", " all RIGHTS reserved.\t", " All rights reserved.", "Licence", "", "  "]
    rows = [(i, "\n".join(rng.choice([*common, prose(rng, 6)]) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "Licence"), (103, "Licence\nLicence\n"), (104, "\r\n\r"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (2, 10):
        got = lines.drop_lines(docs, least).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
        assert sorted(map(tuple, got), key=repr) == plain_lines(rows, least)
    got = lines.drop_lines(awkward, 2).collect()
    assert len(got) == len(AWKWARD) + 3 and got[0].row.asDict().keys() == dict.fromkeys(awkward.columns).keys()
    assert lines.drop_lines(empty, 2).count() == 0


def test_line_runs(spark):
    """Every key is in one run, that of the batch that had it first, whatever was merged since; its count has the rest."""
    runs, want = lines.LineRuns(spark, buckets=3, fanout=2), Counter()
    for b in range(7):
        batch = {f"k{(b * 5 + i) % 17}".encode(): i + 1 for i in range(6)}
        fresh = batch.keys() - want.keys()
        runs.add(spark.createDataFrame([(bytearray(k), n) for k, n in batch.items()], "key binary, docs long"))
        want.update(batch)
        held = Counter(bytes(r.key) for run in runs.runs() for r in run.collect())
        assert held == Counter(want.keys()) and all(len(level) < 2 for level in runs.levels)
        if b and not len(runs.levels[0]) == 0:
            assert {bytes(r.key) for r in runs.runs()[0].collect()} == fresh
        assert {bytes(r.key): r.docs for r in runs.counts().collect()} == dict(want)
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_lines_without_tables_left(spark, monkeypatch):
    monkeypatch.setattr(lines.LineRuns, "counts", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lines.drop_lines(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_lines_of_repeated_rows(spark, tmp_path):
    """A row is a document, in the query and in its SQL, also where ids and whole rows repeat."""
    import duckdb

    rows = [(1, "twice\nten"), (1, "twice\nten"), (None, "ten"), (None, " TEN \nx"), *[(5, "ten")] * 6, (6, None), (7, "nine"), *[(8, "nine")] * 8]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(repr, map(tuple, queries.op9_lines(spark, str(tmp_path)).collect())))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(map(repr, duckdb.sql(queries.OP9_SQL).fetchall()))
    assert sum("'nine'" in x for x in got) == 0 and len(got) == len(rows)


# mixing ------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda x: (x is None, x))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[n] for n in full)
        rest = sum(weight[n] for n in names if n not in full)
        target = {n: 2.0 * sizes[n] if n in full else left * weight[n] / rest for n in names}
        over = {n for n in names if n not in full and target[n] > 2 * sizes[n]}
        if not over:
            return target
        full |= over


@given(st.dictionaries(st.one_of(st.none(), st.text("abc", max_size=2)), st.integers(0, 50), min_size=1, max_size=6))
@settings(max_examples=15, deadline=None)
def test_targets(spark, sizes):
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    want = plain_targets(sizes)
    assert len(got) == len(sizes) and all(abs(r.target - want[r.source]) < 1e-6 for r in got)


def test_mix(spark, rng, awkward, empty):
    rows = [(i, prose(rng, int(rng.lognormvariate(4, 1))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    again = {r[0]: r[5] for r in mixing.mix(docs.repartition(3)).select("row.doc_id", "row.source", "size", "source_size", "target", "copies").collect()}
    assert {r.doc_id: r.copies for r in got} == again and max(again.values()) <= 2
    taken, largest = Counter(), Counter()
    for r in got:
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
    for r in got:
        assert abs(taken[r.source] - r.target) <= max(largest[r.source], 0.02 * r.target)
    assert mixing.mix(empty).count() == 0
    odd = mixing.mix(awkward).collect()
    assert len(odd) == len(AWKWARD) + 3 and {r.size for r in odd if not blank_words(r.row.text)} == {0}
    assert mixing.mix(awkward.where("text is null")).collect()[0].copies == 0


def test_mix_is_systematic(spark, rng, monkeypatch):
    """One random offset for each source; a document for each whole number that the running sum crosses; parts by count."""
    monkeypatch.setattr(mixing, "RANKED", 16)
    rows = [(i, prose(rng, int(rng.lognormvariate(3, 0.5))), rng.choice(["a", "b", None])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    offsets = set()
    for seed in (7, 8):
        got = mixing.mix(docs, seed=seed, keep=["doc_id", "source"]).collect()
        where = docs.select("source", mixing.offset_of(F.col("source"), seed).alias("o")).distinct().collect()
        for r in where:
            own = [x for x in got if x.row.source == r.source]
            rate = own[0].target / own[0].source_size
            assert 0 <= r.o < 1 and abs(sum(x.copies for x in own) - len(own) * rate) < 1
            offsets.add(r.o)
            # every stretch of the order by size has its share
            order = sorted(own, key=lambda x: x.size)
            half = sum(x.copies for x in order if x.size < order[len(order) // 2].size)
            n = sum(x.size < order[len(order) // 2].size for x in order)
            assert abs(half - n * rate) <= 0.15 * n + 8
    assert len(offsets) == 6
    drawn = spark.createDataFrame([("x",)], "source string").select(*[mixing.offset_of(F.col("source"), i).alias(f"o{i}") for i in range(200)]).first()
    assert 0 <= min(drawn) < 0.1 and 0.9 < max(drawn) < 1 and 0.4 < sum(drawn) / 200 < 0.6


# classifiers -------------------------------------------------------------------------------------------------------


def test_language(spark, rng, awkward, empty):
    rows = [(i, prose(rng, rng.randint(3, 40), lang), lang) for i, lang in enumerate(["en", "fr", "de"] * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id % 4 <> 2"))
    got = langid.predict(docs, model).where("row.doc_id % 4 = 2").collect()
    assert sum(r.row.lang == r.lang_pred for r in got) / len(got) > 0.97 and all(0 < r.score <= 1 for r in got)
    odd = {r.row.key: r for r in langid.predict(awkward, model).collect()}
    assert [odd[f"k{i}"].lang_pred == "und" for i in (0, 1, 2, 5)] == [True] * 4 and odd["k3"].lang_pred != "und"
    assert langid.predict(empty, model).count() == 0
    none = langid.train(empty)
    assert none.predict("text") == ("und", 0.0)


def plain_grams(text, orders):
    text = f" {(text or '').lower()} "
    return Counter(text[i : i + n] for n in orders for i in range(len(text) - n + 1))


def gram_hash(gram):
    """Of one n-gram, character by character."""
    run, most = 0, (1 << 64) - 1
    for n, c in enumerate(gram, 1):
        run = (run + ord(c) + n) * 0x9E3779B97F4A7C15 & most
        run ^= run >> 31
    return run * 0x9E3779B97F4A7C15 & most


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 18])
def test_ngrams(monkeypatch, chunk, rng):
    monkeypatch.setattr(ngrams, "CHUNK", chunk)
    texts = [None, "", "a", "Ab", "é漢🙂\ud800", prose(rng, 9), "", "xyxyxyxy"]
    got = Counter()
    for owner, h in ngrams.hashed(texts, (1, 3, 4)):
        assert (np.diff(owner) >= 0).all()
        got.update(zip(owner.tolist(), h.tolist(), strict=True))
    want = Counter()
    for i, t in enumerate(texts):
        for gram, n in plain_grams(t, (1, 3, 4)).items():
            want[i, gram_hash(gram)] += n
    assert got == want


def test_language_counts(spark, rng):
    """Counts, priors, matrix and posteriors against sums over n-grams."""
    rows = [(prose(rng, rng.randint(1, 12), lang), lang) for lang in ("en", "fr", "de", "fr") for _ in range(6)]
    rows += [(rows[0][0], "en")] * 3 + [("nothing", None), (None, "en"), ("", "de")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    used = [r for r in rows if None not in r]
    languages = sorted({lang for _, lang in used})
    counts = {x: Counter() for x in languages}
    for text, lang in set(used):
        for gram, n in plain_grams(text, (1, 2, 3)).items():
            counts[lang][gram_hash(gram) >> 48] += n
    assert model.languages == languages
    prior = Counter(lang for _, lang in used)
    whole = {x: sum(counts[x].values()) + 0.5 * langid.SLOTS for x in languages}
    p = lambda lang, slot: np.log((counts[lang][slot] + 0.5) / whole[lang])
    for i, lang in enumerate(languages):
        assert abs(model.prior[i] - np.log(prior[lang] / len(used))) < 1e-9
        for slot in (0, 1, *counts[lang]):
            assert abs(model.matrix[slot, i] - p(lang, slot)) < 1e-5
    texts = [prose(rng, 8, "fr"), "x", "q" * 40]
    for text, (_, r) in zip(texts, model.predict_all(texts).iterrows(), strict=True):
        total = {x: np.log(prior[x] / len(used)) + sum(n * p(x, gram_hash(g) >> 48) for g, n in plain_grams(text, (1, 2, 3)).items()) for x in languages}
        best = max(languages, key=lambda x: total[x])
        assert r.lang_pred == best and abs(r.score - 1 / sum(np.exp(t - total[best]) for t in total.values())) < 1e-3


def test_language_blocks(monkeypatch, rng):
    """Many languages and small blocks give the sums of one gather."""
    texts, made = [prose(rng, 30) for _ in range(5)] + ["", None], np.random.default_rng(1)
    model = langid.Model([f"l{i:03}" for i in range(300)], made.standard_normal((langid.SLOTS, 300)).astype(np.float32), made.standard_normal(300))
    monkeypatch.setattr(langid, "CELLS", 900)
    direct = np.array([model.prior + sum(model.matrix[s].sum(axis=0, dtype=np.float64) for _, s in langid.slots_of([t])) for t in texts])
    assert np.allclose(model.totals(texts), direct)


def test_language_sample(spark, rng):
    """Copies of one text don't make the sample larger; the bound of languages holds."""
    rows = [("the same text again", "en")] * 500 + [(prose(rng, 9), "en") for _ in range(300)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), per_language=80)
    mass = (np.exp(model.matrix[:, 0].astype(float)) / np.exp(model.matrix[:, 0].min().astype(float)) - 1).sum() / 2
    assert 5 * 3 * 20 < mass < 80 * 3 * 150
    with pytest.raises(ValueError):
        langid.train(spark.range(langid.LANGUAGES + 1).selectExpr("'t' AS text", "cast(id AS string) AS lang"))


def test_toxicity_counts(spark, rng, monkeypatch):
    """n-grams, their counts, evidence and log ratios against sums over texts; scores by the model's own weights."""
    monkeypatch.setattr(toxicity, "TEXTS", 7)
    texts = [(prose(rng, 20) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(60)] + [("", 0), ("x" * 900, 1)]
    sample = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "id long, text string, label int")
    n = np.array([sum(y == 0 for _, y in texts), sum(y for _, y in texts)], float)
    got = {h: (a, b) for h, a, b in zip(*(x.tolist() for x in toxicity.counted(sample, n)), strict=True)}
    seen = defaultdict(lambda: [0, 0])
    for t, y in texts:
        for gram in plain_grams(t, (3, 4, 5, 6)):
            seen[gram_hash(gram)][1 - y] += 1
    want = {}
    for h, (ones, zeros) in seen.items():
        cells = [(ones, ones + zeros, n[1]), (n[1] - ones, n.sum() - ones - zeros, n[1]), (zeros, ones + zeros, n[0]), (n[0] - zeros, n.sum() - ones - zeros, n[0])]
        g = sum(2 * x * np.log(x * n.sum() / (r * c)) for x, r, c in cells if x)
        if ones + zeros >= toxicity.LEAST_TEXTS and g >= toxicity.LEAST_EVIDENCE:
            want[h] = (ones, zeros)
    assert got == want and len(want) > 5
    ratio = toxicity.log_ratio(np.array([3.0]), np.array([1.0]), n)
    assert abs(ratio[0] - np.log(3.5 / (n[1] + 1) / (1.5 / (n[0] + 1)))) < 1e-12
    model = toxicity.fit(sample, n)
    weights = dict(zip(model.hashes.tolist(), model.weights.tolist(), strict=True))
    for t, _ in [*texts, (None, 0)]:
        z = model.bias + sum(weights.get(gram_hash(g), 0) for g in plain_grams(t, (3, 4, 5, 6)))
        assert abs(model.score(t) - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_pieces(monkeypatch, rng, spark):
    """A long text has each feature once, wherever it is cut."""
    grams = sorted({gram_hash(g) for g in plain_grams("vile words here", (3, 4, 5, 6))})
    model = toxicity.Model(np.array(grams, np.uint64), np.linspace(-1, 1, len(grams)), 0.1)
    texts = [prose(rng, 400) + " vile words " * 30, "vile", None]
    whole = model.scores(texts)
    monkeypatch.setattr(ngrams, "CHUNK", 11)
    assert (model.scores(texts) == whole).all()


def test_toxicity(spark, rng, awkward, empty):
    rows, labels = [], []
    for i in range(900):
        bad, text = i % 6 == 0, prose(rng, rng.randint(20, 120)).split()
        for _ in range(rng.randint(1, 4) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grumblecake", "nastyword", "vilething"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, 0), (None, 1), (77777, 1), (3, 7)], "doc_id long, toxic int")
    learn = "crc32(cast(doc_id as string)) % 5 <> 0"
    model = toxicity.train(docs.where(learn), marks.where(learn))
    got = {r.row.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert model.score(None) == model.score("") < 0.5
    assert toxicity.score(awkward, model).count() == len(AWKWARD) + 3 and toxicity.score(empty, model).count() == 0
    assert toxicity.train(docs, marks.limit(0)).score("x") == 0.5
    assert toxicity.train(docs, marks.where("toxic = 0")).score("x") < 0.5


def test_near_duplicates_with_far_fingerprints(spark, rng, monkeypatch):
    """Tails and repeated passages just above the threshold, whatever the distance of the fingerprints."""
    for name, value in (("FLUSH", 3000), ("PART_BYTES", 9000)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    sets = lambda t: set(zip(*(blank_words(t)[k:] for k in range(5)), strict=False)) or {tuple(blank_words(t))}
    alike = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(9999)}" for _ in range(rng.randint(40, 400))]
        cut = max(1, int(0.8 * (len(words) - 4)) + 4 + rng.choice([-2, 0, 1, 2]))
        other = words[:cut] if i % 3 == 0 else words + [f"t{rng.randrange(9999)}" for _ in range(len(words) // 4 - 2)] if i % 3 == 1 else words + words[:25] * 8
        texts += [" ".join(words), " ".join(other)]
    texts += [texts[0], "a b", "a b c", "a  B", "a b c d e f", "a b c d e g"]
    far = sum((simhash.fingerprint_of(simhash.shingle_hashes(a, 3)) ^ simhash.fingerprint_of(simhash.shingle_hashes(b, 3))).__and__((1 << 64) - 1).bit_count() > 13 for a, b in zip(texts[:120:2], texts[1:120:2], strict=True) if alike(a, b) >= 0.8)
    assert far > 5
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if alike(texts[a], texts[b]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for how in ({}, {"group": 3}):
        assert sorted(r.doc_id for r in simhash.keep_one(docs, **how).collect()) == sorted(set(groups(list(range(len(texts))), links).values()))
