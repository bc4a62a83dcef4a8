"""What the pipeline's stages leave in workers and write on the way."""

import random

import pytest

from tidelog.llm import common, components, exact_dedup, mixing, packing, simhash, toxicity

from .cases import ROWS, frame, words


def test_a_worker_remembers_few_words():
    features, encoder = toxicity.Features(), packing.Encoder(packing.default_vocabulary())
    first = features["word0"], encoder["word0"]
    for memory, most in ((features, 1 << 17), (encoder, 1 << 18)):
        for i in range(300_000):
            memory[f"word{i}"]
            assert len(memory) <= most
    assert (features["word0"], encoder["word0"]) == first


def test_near_groups_writes_each_table_once(spark, monkeypatch):
    names = []

    def written(df, what):
        names.append(what)
        return common.written(df, what)

    for module in (simhash, components):
        monkeypatch.setattr(module, "written", written)
    assert simhash.near_groups(frame(spark)).count() == len(ROWS)
    rounds, odd = divmod(names.count("labels") - 1, 2)
    assert rounds and not odd and [n for n in names if n != "labels"] == ["fingerprints", "distinct", "edges", "named"]


def test_components_read_their_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 7), (None, 4), (9, 8)], "a long, b long").mapInArrow(seen, "a long, b long")
    assert {r["node"]: r["component"] for r in components.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert read.value == 5


@pytest.fixture
def files(spark, monkeypatch):
    """(table, files) of what is written, under 64 shuffle partitions that are not merged."""
    out = []

    def written(df, what):
        found = common.written(df, what)
        out.append((what, len(found.inputFiles())))
        return found

    for module in (components, exact_dedup, mixing, simhash, toxicity):
        monkeypatch.setattr(module, "written", written)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield out
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_tables_are_in_few_files(spark, files):
    """Of 1,200 documents 600 are near copies of one another, so all tables have rows for each of the 64 partitions."""
    rnd = random.Random(3)
    base = words(rnd, 300, 9)
    rows = [(i, " ".join([*base, f"x{i}"] if i % 2 else words(rnd, 30))) for i in range(1200)]
    docs = frame(spark, rows)
    found = {r["doc_id"]: r for r in simhash.near_groups(docs).collect()}
    assert {i: found[i]["fingerprint"] for i, _ in rows} == {i: f"{simhash.fingerprint(t):016x}" for i, t in rows}
    fps = {i: simhash.fingerprint(t) for i, t in rows if i % 2}
    near = {i for i, f in fps.items() if (f ^ fps[1]).bit_count() <= 4}
    assert len(near) > 300 and {found[i]["component_id"] for i in near} == {1}
    index = exact_dedup.DigestIndex(spark, common.new_path(spark, "digest-index"))
    kept = exact_dedup.exact_dedup(docs, index)
    assert kept.filter("kept").count() == len({t for _, t in rows}) and index.rows.count() == kept.select("text_sha256").distinct().count()
    index.close()
    mixing.classifier(docs, docs.selectExpr("doc_id", "CAST(doc_id % 3 AS string) AS domain"))
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS int) AS toxic")
    assert toxicity.fit(docs, labels) is not None
    assert [n for n, _ in files if n in ("digests", "groups")] == ["digests", "groups"]
    of = lambda *names: [n for what, n in files if what in names]
    assert max(of("distinct", "edges", "labels", "named", "groups", "features")) <= 8
    assert len(of("labels")) >= 3 and max(of("labelled")[1:2]) <= 32


def test_whole_texts_are_not_shuffled_for_few_copies(spark):
    """Rows go by an id table that is small enough to be sent to all tasks; the same rows stay, null ids too."""
    rnd = random.Random(4)
    rows = [*((i, " ".join(words(rnd, 30))) for i in range(100, 400)), *ROWS]
    docs = frame(spark, rows)
    index = exact_dedup.DigestIndex(spark, common.new_path(spark, "digest-index"))
    for kept, want in ((exact_dedup.drop_copies(frame(spark, [r for r in rows if r[0] not in (4, None)]), index), {*range(100, 400), 1, 3, 6, 7, 8, 5}), (simhash.drop_near_copies(docs), {*range(100, 400), 1, 2, 6, 7, None})):
        assert {r["doc_id"] for r in kept.collect()} == want
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "LeftAnti" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    index.close()
