"""Operators on pages, conversations, vectors and language models against brute force."""

import gzip
import hashlib
import json
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, forest, lm, queries, warc
from tessera.llm.common import kept, shared_folder
from tessera.llm.elias_fano import EliasFano, load, save

from .conftest import AWKWARD, prose

# WARC --------------------------------------------------------------------------------------------------------------

URLS = ["http://a.example.com/x?y=1#z", "https://A.example.com:8080/", None, "", "no host", "http://b.example.org/ü ö", "http://[bad", "http://a.example.com/x?y=1#z\r\nX: 1"]


def test_surt():
    assert warc.surt("http://www.Example.com/a/b?c=d") == "com,example,www)/a/b?c=d"
    assert warc.surt("http://e.com:81/") == "com,e:81)/" and warc.surt(None) == "" and warc.surt("x y") == ")x%20y"


@given(st.binary(max_size=50), st.sampled_from(URLS), st.integers(-5, 5))
@settings(max_examples=60, deadline=None)
def test_record(payload, url, ident):
    digest = hashlib.sha1(payload).hexdigest()
    got = warc.parse(warc.record("response", str(ident), url, payload, digest, len(payload), None))
    assert (got.kind, got.ident, got.digest, got.size, got.payload) == ("response", str(ident), digest, len(payload), payload)
    got = warc.parse(warc.record("revisit", str(ident), url, payload, digest, len(payload), "77"))
    assert (got.kind, got.refers, got.digest, got.size, got.payload) == ("revisit", "77", digest, len(payload), None)
    with pytest.raises(ValueError):
        warc.parse(warc.record("response", "1", url, payload + b"x", digest, len(payload) + 1, None))


def plain_pages(rows, least):
    groups = defaultdict(list)
    for ident, _, html in rows:
        if len((html or "").encode()) >= least and ident is not None:
            groups[html].append(ident)
    out = []
    for ident, _, html in rows:
        data = (html or "").encode()
        first = max(groups[html]) if len(data) >= least and groups.get(html) else ident
        twice = sum(1 for r in rows if r[2] == html) > 1
        again = twice and ident != first
        out.append((ident, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def test_archive(spark, rng):
    texts = [None, "", "short", "é" * 600, "x" * 999, "x" * 1000, "<html>" + prose(rng, 3000), prose(rng, 200)]
    rows = [(i, rng.choice(URLS), rng.choice(texts)) for i in range(120)]
    rows += [rows[5], (None, None, texts[6]), (None, "http://a.example.com/", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(5)
    got = [tuple(r) for r in warc.archive_and_read(pages).collect()]
    assert sorted(got, key=repr) == plain_pages(rows, 1000)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_index(spark, rng):
    folder = shared_folder(spark, "test")
    rows = [(i, f"http://{'abc'[i % 3]}.example.com/{i // 4}", f"text {i}") for i in range(300)] + [(7, "http://a.example.com/one", f"many {i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "id long, url string, html string")
    captures = warc.write(pages.repartition(4), folder, "id", "url", "html")
    index = warc.build_index(captures, folder, block_lines=7)
    assert len(index.shards) > 1
    for ident, url, text in rows[:300:11]:
        (place,) = index.find(warc.line_key(url, str(ident)))
        assert warc.parse(gzip.decompress(index.read(*place))).payload.decode() == text
    assert len(list(index.find(warc.line_key("http://a.example.com/one", "7")))) == 40
    assert not list(index.find("zz")) and not list(index.find("")) and not list(index.find("com,example,b)/5 x"))
    wanted = spark.createDataFrame([(warc.line_key(u, str(i)),) for i, u, _ in rows[:20]] + [("none",)], "key string")
    assert {r.payload.decode() for r in warc.look_up(wanted, index, True).collect()} == {t for _, _, t in rows[:20]}


# chat --------------------------------------------------------------------------------------------------------------


def plain_chat(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append(((turn is not None, turn), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(r, t) for _, r, t in sorted(turns, key=lambda x: ((x[0][0], x[0][1] or 0), x[1].encode(), x[2].encode()))]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned))
    return out


def test_chat(spark, rng):
    nasty = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<\\\\|", "<", "|", "\\", "\n", "a<|b", "<<|", "🙂é", "", None, *AWKWARD]
    rows = [(i // 5, i % 5, rng.choice(["user", "assistant", "system", None, "odd\nrole\\n", "<|im_end|>"]), rng.choice(nasty)) for i in range(300)]
    rows += [(1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (None, 0, "user", "q"), (2, None, "user", "w")]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("segment", F.lit(1))
    segments = chat.formatted(chat.turn_rows(table))
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(segments).collect()}
    assert got == plain_chat(rows)
    assert not any("<|" in r.segment[len(chat.START) : -len(chat.END) - 1] for r in segments.collect())
    assert chat.read_back(chat.formatted(chat.turn_rows(table.limit(0)))).count() == 0


@given(st.text(alphabet="<|\\ab\n", max_size=20))
@settings(max_examples=200, deadline=None)
def test_parse(text):
    import re

    guarded = re.sub(r"<(\\*)\|", r"<\1\\|", text)
    assert "<|" not in guarded and chat.unguard(guarded) == text


def test_layouts(spark):
    records = {
        "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        "instruction": {"instruction": "q", "output": "a"},
        "instruction and input": {"output": "a", "input": "", "instruction": "q"},
        "nested data": {"data": {"prompt": "q", "response": "a"}},
        "prompt and completion": {"Prompt": "q", "completion": "a"},
    }
    rows = [(i, json.dumps(r)) for i, r in enumerate(records.values())] + [(90, '{"what": 1}'), (91, "no json"), (92, None), (93, "[1]")]
    got = chat.canonical(spark.createDataFrame(rows, "id long, record string"), "id", "record").collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for i, name in enumerate(records):
        assert {r.layout for r in by[i]} == {name} and [(r.role, r.text) for r in by[i]] == [("user", "q"), ("assistant", "" if name == "messages" else "a")]
    assert all(by[i][0].layout is None and by[i][0].text == dict(rows)[i] for i in (90, 91, 92, 93))
    extra = [
        ({"id": 7, "messages": [{"role": "user", "content": "q", "name": "n"}], "meta": {"k": [1]}}, "messages", [("user", "q")]),
        ({"instruction": "q", "output": "a", "source": None}, "instruction", [("user", "q"), ("assistant", "a")]),
        ({"instruction": "q", "input": "i", "output": "a", "k": 1}, "instruction and input", [("user", "q"), ("user", "i"), ("assistant", "a")]),
        ({"messages": []}, "messages", [(None, None)]),
        ({"id": 1, "conversations": []}, "conversations", [(None, None)]),
        ({"messages": {}}, None, [(None, '{"messages": {}}')]),
        ({}, None, [(None, "{}")]),
    ]
    got = chat.canonical(spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(extra)], "id long, record string"), "id", "record").collect()
    for i, (_, name, turns) in enumerate(extra):
        assert [(r.role, r.text) for r in got if r.conv_id == i] == turns and {r.layout for r in got if r.conv_id == i} == {name}
    typed = spark.createDataFrame([], "prompt string, response string").schema
    assert chat.mapping_of(typed).name == "prompt and response"
    assert chat.mapping_of(spark.createDataFrame([], "messages array<struct<content:string,role:string>>").schema).name == "messages"
    with pytest.raises(KeyError):
        chat.mapping_of(spark.createDataFrame([], "x int").schema)


# vectors -----------------------------------------------------------------------------------------------------------


def plain_neighbours(rows, k=10):
    """(query, rank, id, score) of each row whose id is divisible by 100, over every row but its own."""
    good = [(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, v) in enumerate(good):
        if i % 100 == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for n, (j, w) in enumerate(good) if n != at and len(w) == len(v))
            out += [(i, rank, j, round(d, 9)) for rank, (d, j) in enumerate(near[:k], 1)]
    return Counter(out)


def test_forest_small(spark):
    """Odd vectors, repeated rows and ids, ties and lengths, with so many candidates that nothing is missed."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(500, None), (600, [0.0] * 6), (700, [1.0, None] * 3), (800, [float("nan")] * 6), (900, [float("inf")] + [1.0] * 5), (1100, [1.0, 2.0]), (1101, [1.0, 2.5]), (None, [1.0] * 6)]
    rows += [rows[3], *[rows[100]] * 12, (200, rows[5][1]), (200, rows[6][1]), (100, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0))
    found = forest.search(df, F.col("vec_id") % 100 == 0, rate=100.0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = Counter((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found.collect())
    assert got == plain_neighbours([(r.vec_id, r.embedding) for r in df.collect()])
    assert forest.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_forest_recall(spark):
    vectors = np.random.default_rng(2).standard_normal((6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = defaultdict(set)
    for r in forest.search(df, F.col("vec_id") % 100 == 0, block=3000).collect():
        found[r.query_id].add(r.vec_id)
    v, hits = vectors.astype(float), 0
    for q in range(0, 6000, 100):
        far = ((v - v[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(found[q] & set(np.argsort(far)[:10].tolist()))
    assert hits / 600 >= 0.9


def test_forest_rows_are_short(spark, monkeypatch):
    """What a task reads of an index or of queries is a short row for each, however large blocks and chunks are."""
    tables = []
    monkeypatch.setattr(forest, "kept", lambda df, *rest: tables.append(kept(df, *rest)) or tables[-1])
    vectors = np.random.default_rng(3).standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert forest.search(df, F.col("vec_id") % 100 == 0, block=1000, chunk=10).count() == 300
    longest = [max(len(bytes(x)) if isinstance(x, bytes | bytearray) else 8 * len(x) if isinstance(x, list) else 8 for r in t.collect() for x in r) for t in tables]
    assert len(longest) >= 4 and max(longest) <= 128


@pytest.mark.parametrize("n", [300, 2000, 5000])
def test_forest_saves_work(n):
    """Recall of 0.9 with a share of the vectors that falls as they grow; no size is looked through whole."""
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64))
    v /= np.sqrt((v**2).sum(axis=1, keepdims=True))
    cut = forest.planes(64)
    numbers = forest.strings(v, v.mean(axis=0), cut)
    order = np.argsort(numbers, axis=0, kind="stable")
    want = min(n, math.ceil(forest.RATE * n**forest.POWER))
    hits = looked = 0
    for q, found in enumerate(forest.candidates(np.ascontiguousarray(np.take_along_axis(numbers, order, axis=0).T), np.ascontiguousarray(order.T.astype(np.int32)), numbers[:60], want, forest.BITS)):
        far = ((v - v[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(found.tolist()) & set(np.argsort(far)[:10].tolist()))
        looked += len(found)
    assert hits / 600 >= 0.9 and looked == 60 * want < 60 * n * (1 if n < 1000 else 0.5)


def test_prefixes_agree():
    """Strings of a tree: equal vectors share all bits, the longest prefixes come first among the candidates."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((500, 16))
    v[100:140] = v[7]
    numbers = forest.strings(v, v.mean(axis=0), forest.planes(16, 8, 12), 8, 12)
    order = np.argsort(numbers, axis=0, kind="stable")
    flat, whose = np.take_along_axis(numbers, order, axis=0).T, order.T.astype(np.int32)
    length = np.where(numbers == numbers[7], 12, 12 - np.floor(np.log2(np.maximum(numbers ^ numbers[7], 1))).astype(int) - 1).max(axis=1)
    for want in (41, 60, 200, 500):
        (found,) = forest.candidates(flat, whose, numbers[7:8], want, 12)
        assert len(found) == want and {7, *range(100, 140)} <= set(found.tolist())
        assert length[found].min() >= np.sort(length)[::-1][want - 1]


# language model ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 5), (5, 5), (1000, 10), (1000, 10**6), (30_000, 10**13), (3000, 3000), (50, 10**12)])
def test_elias_fano(tmp_path, n, top):
    rng = np.random.default_rng(n)
    values = np.sort(rng.integers(0, top, n))
    save(f"file://{tmp_path}/x", EliasFano.encode(values, "a"))
    made = EliasFano(load(f"file://{tmp_path}/x"), "a")
    assert (made.get(np.arange(n)) == values).all()
    asked = np.concatenate([rng.integers(0, top + 10, 500), values[:200], values[:200] + 1])
    want = np.searchsorted(values, asked)
    assert (made.successor(asked) == want).all()
    there = np.isin(asked, values)
    assert (made.find(np.append(asked, -1)) == np.append(np.where(there, want, -1), -1)).all()
    if n > 1:
        a, b = made.pair(np.arange(n - 1))
        assert (a == values[:-1]).all() and (b == values[1:]).all()


class Plain:
    """The same model with dictionaries."""

    def __init__(self, texts):
        docs = [self.words(t) for t in texts]
        self.c1 = Counter(w for d in docs for w in d)
        self.c2, self.c3 = Counter(), Counter()
        for d in docs:
            self.c2.update(zip([None, *d], d, strict=False))
            self.c3.update(zip([None, *d], d, d[1:], strict=False))
        d = lambda c: (lambda a, b: a / (a + 2 * b) if a else 0.5)(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()))
        self.d1, self.d2, self.d3 = d(self.c1), d(self.c2), d(self.c3)
        self.n, self.v, self.texts = sum(self.c1.values()), len(self.c1), len(docs)
        self.next = Counter(k[0] for k in self.c2)

    @staticmethod
    def words(text):
        return (text or "").encode().lower().split() + [b"\n"]

    def p(self, u, v, w, start):
        p = max(self.c1[w] - self.d1, 0) / self.n + self.d1 * self.v / self.n / (self.v + 1)
        times = self.texts if v is None else self.c1[v]
        if times:
            p = max(self.c2[v, w] - self.d2, 0) / times + self.d2 * self.next[v] / times * p
        if not start and self.c2[u, v]:
            held = sum((n - self.d3) / self.c2[u, v] for k, n in self.c3.items() if k[:2] == (u, v))
            n = self.c3[u, v, w]
            p = ((n - self.d3) / self.c2[u, v] if n else 0) + (1 - held) * p
        return p

    def score(self, text):
        words = [None, *self.words(text)]
        return sum(math.log10(self.p(words[i - 2], words[i - 1], words[i], i == 1)) for i in range(1, len(words)))


def test_language_model(spark, rng, awkward, monkeypatch):
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(120)] + ["Same Words here", "same words HERE"] * 5 + [None, "", "\t\n"]
    for name, value in (("SHARD", 500), ("PART_BYTES", 4000)):
        monkeypatch.setattr(lm, name, value)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trie, plain = lm.train(docs), Plain(texts)
    assert len(trie.shards) > 4 and len(trie.parts) > 3 and (trie.tokens, trie.words, trie.texts) == (plain.n, plain.v, plain.texts)
    unseen = [prose(rng, 50, "fr"), "the unknownword of the", "same words", "x", prose(rng, 400)]
    both = docs.unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(unseen)], "doc_id long, text string"))
    own = dict(enumerate(texts)) | {500 + i: t for i, t in enumerate(unseen)}
    for r in lm.score(both, trie).collect():
        words = plain.words(own[r.row.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(plain.c1[w] > 0 for w in words), plain.n)
        assert abs(r.base_score - sum(math.log10((plain.c1[w] + 1) / (plain.n + plain.v + 1)) for w in words)) < 1e-9 * len(words)
        assert abs(r.score - plain.score(own[r.row.doc_id])) < 1e-3 * len(words)
    assert lm.score(awkward, trie).count() == len(AWKWARD) + 3
    assert sum(plain.p(None, None, w, True) for w in plain.c1) == pytest.approx(1, abs=0.02)


def test_language_model_of_nothing(spark, awkward, empty):
    trie = lm.train(empty)
    rows = lm.score(awkward, trie).collect()
    assert len(rows) == len(AWKWARD) + 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in rows)
    assert lm.score(empty, lm.train(awkward)).count() == 0


def test_language_model_query_keeps_all_trigrams(spark, rng, tmp_path):
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(80)] + ["Same Words here", "same words HERE", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op8_score(spark, str(tmp_path)).collect()
    plain = Plain([texts[r.doc_id] for r in rows if not r.held_out])
    assert len(rows) == len(texts) and {r.held_out for r in rows} == {True, False}
    assert sum(n == 1 for n in plain.c3.values()) > 100
    for r in rows:
        assert abs(r.score - plain.score(texts[r.doc_id])) < 1e-3 * r.n_tokens
