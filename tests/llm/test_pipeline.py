"""Each stage of the corpus pipeline against brute force, on its predecessor's rows."""

import re
import sys
from collections import Counter
from itertools import combinations
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, toxicity
from tessera.llm.common import held_out

from .test_text_operators import blank_words, groups, plain_lines, plain_report, plain_targets

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontaminate", "mix"]

    def step(name, before):
        STAGES[name](spark, before, sf_dir).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    clean = step("toxicity", docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
    model = toxicity.train(docs, labels)
    assert rows_of(clean) == sorted(((i, t) for i, t in rows_of(docs) if model.score(t) < 0.5), key=repr)

    cut = step("line_dedup", clean)
    assert rows_of(cut) == sorted(((i, t) for i, _, _, t in plain_lines(rows_of(clean), 10)), key=repr)
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    single = step("simhash", cut)
    texts = dict(rows_of(cut))
    sets = {i: set(zip(*(blank_words(t)[k:] for k in range(5)), strict=False)) or {tuple(blank_words(t))} for i, t in texts.items()}
    links = [(a, b) for a, b in combinations(sorted(texts), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert sorted(i for i, _ in rows_of(single)) == sorted(set(groups(list(texts), links).values()))

    fresh = step("decontaminate", single)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {r[0] for r in plain_report(rows_of(single), items) if r[5]}
    assert [i for i, _ in rows_of(fresh)] == [i for i, _ in rows_of(single) if i not in bad]
    assert all(x.columns == docs.columns for x in (clean, cut, single, fresh))

    mixed = step("mix", fresh)
    sizes, source = Counter(), {r.doc_id: r.source for r in fresh.collect()}
    for i, t in rows_of(fresh):
        sizes[source[i]] += len(blank_words(t))
    taken, most = Counter(), Counter(r.doc_id for r in mixed.collect())
    for i, t in rows_of(mixed):
        taken[source[i]] += len(blank_words(t))
    largest = max(len(blank_words(t)) for _, t in rows_of(fresh))
    assert all(abs(taken[n] - t) <= largest for n, t in plain_targets(sizes).items()) and max(most.values()) <= 2
    assert corpus_pipeline.run(spark, sf_dir).count() == mixed.count() and corpus_pipeline.ORACLE_SQL is None


def test_awkward_rows(spark, awkward, empty, tmp_path):
    spark.createDataFrame([(0, 1), (1, 0), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "two words"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, some in ((awkward, True), (empty, False)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, str(tmp_path))
            assert set(awkward.columns) <= set(got.columns) and (got.columns == awkward.columns or name == "mix")
            assert (got.count() > 0) == some
    named = STAGES["mix"](spark, awkward.withColumns({"Copy": F.lit(5), "copy_2": F.lit(6)}), str(tmp_path))
    named.write.parquet(f"{tmp_path}/named")
    assert named.columns[-3:] == ["Copy", "copy_2", "copy_3"] and {r["Copy"] for r in named.collect()} == {5}


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_driver_gives_memory_back(spark, monkeypatch):
    """Memory that the driver's JVM has freed outside of its heap goes back when a table has been written."""
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    held = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024
    common.give_back_driver(spark)
    packers = [jvm.java.util.zip.Deflater() for _ in range(2000)]  # each a few blocks from malloc
    for x in packers[:-1]:  # the last one keeps malloc from giving the rest back by itself
        x.end()
    full = held()
    common.give_back_driver(spark)
    assert full - held() > 50
    calls = []
    monkeypatch.setattr(common, "give_back_driver", calls.append)
    assert common.kept(spark.range(10), "few").count() == 10 and len(calls) == 1
