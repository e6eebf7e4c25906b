"""Every query with SQL against it, and the pipeline's contract."""

import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from tests.conftest import compare

from tessera.llm import queries as llm

from .test_text_operators import blank_words, groups, plain_print


@pytest.mark.parametrize("name", list(llm.ORACLE_SQL))
def test_against_sql(name, spark, sf_dir, duck):
    compare(llm.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(llm.ORACLE_SQL[name]).df())


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def documents(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()


def test_op5_query(spark, sf_dir, duck):
    """Fingerprints by whole sums over bits, and components over all pairs."""
    docs = documents(duck)
    prints = {i: plain_print(t) for i, t, _ in docs}
    links = [(a, b) for a, b in combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = groups(list(prints), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in llm.op5_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()} and len(got) == len(docs)


def test_op2_query(spark, sf_dir, duck):
    rows = llm.op2_toxicity(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {i for i, _, _ in documents(duck)}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    toxic = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    held = [(r.predicted, toxic[r.doc_id]) for r in rows if r.doc_id in toxic and not r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_op6_query(spark, sf_dir, duck):
    langs = {i: lang for i, _, lang in documents(duck)}
    texts = {i: t for i, t, _ in documents(duck)}
    rows = llm.op6_language(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == langs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id] or ""))) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and langs[r.doc_id]]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.95


def test_op8_query(spark, sf_dir, duck):
    docs = documents(duck)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, _ in docs if not held(i) for w in [*blank_words(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in llm.op8_score(spark, sf_dir).collect()}
    for i, t, _ in docs:
        own, r = [*blank_words(t), "\n"], rows[i]
        base = sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(w in counts for w in own), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    unseen = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_op10_query(spark, sf_dir, duck):
    vectors = {i: np.array(v, float) for i, v in duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    found = {}
    for r in llm.op10_neighbours(spark, sf_dir).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == {i for i in vectors if i % 100 == 0}
    hits = 0
    for q, near in found.items():
        exact = sorted((float(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())), i) for i in vectors if i != q and len(vectors[i]) == len(vectors[q]))[:10]
        assert [r for r, _, _ in sorted(near)] == list(range(1, len(exact) + 1)) and sorted(near) == sorted(near, key=lambda x: (x[2], x[1]))
        assert all(abs(s - float(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()))) < 1e-12 for _, i, s in near)
        hits += len({i for _, i in exact} & {i for _, i, _ in near}) / len(exact)
    assert hits / len(found) >= 0.9
