import random

import pytest

import corpus_pipeline as P
from tidelog.llm import packing, simhash
from tidelog.llm.common import pick
from tidelog.llm.registry import QUERIES

from .cases import ROWS, frame, words

SF = "/root/testdata/sf0.001"


def test_stages_on_a_small_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts, texts = [docs.count()], None
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, SF), name)
        assert docs.columns == names
        counts.append(docs.count())
        if name == "exact_dedup":
            texts = [r["text"] for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts))
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] <= counts[4] and counts[3] > 100
    pieces = P.STAGES[-1][1](spark, docs, SF)
    e = packing.encoder(packing.default_vocabulary())
    assert pieces.agg({"length": "sum"}).first()[0] == sum(len(e.ids(r["text"])) + 1 for r in docs.select("text").collect())


def test_run_is_the_stages(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert P.run(spark, SF).count() > 100


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def tables(spark, path, rows, labels):
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("labels", [[], [(i, 1, 0) for i in (1, 4, 7)], [(7, 1, 0), (None, 1, 1), (7, 0, None)]])
def test_odd_rows_through_all_stages(spark, tmp_path, labels):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns, against the stages in plain Python."""
    rows = [*ROWS, (9, "a b c d e f g h"), (10, "<|endoftext|> x"), (11, "k l m n o p"), (12, "k l m n o p")]
    d = tables(spark, str(tmp_path), rows, labels)
    best = {}
    for i, t in rows:  # the largest id of equal texts
        best[t or ""] = max([j for j in (best.get(t or ""), i) if j is not None], default=None)
    left = {i: t for t, i in best.items() if i is not None}
    component = {i: i for i in left}
    for _ in left:  # the smallest id of near ones
        for i in left:
            for j in left:
                if (simhash.fingerprint(left[i]) ^ simhash.fingerprint(left[j])).bit_count() <= 4:
                    component[i] = component[j] = min(component[i], component[j])
    want = {i for i in left if component[i] == i} | {i for i in best.values() if i is None}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, d), name)
        assert docs.columns == names
        if name == "near_dedup":
            assert sorted(map(str, (r[0] for r in docs.select("doc_id").collect()))) == sorted(map(str, want))
    pieces = P.run(spark, d).collect()
    e = packing.encoder(packing.default_vocabulary())
    kept = [r["text"] for r in pick(docs, "text").collect()]
    assert {r["doc_id"] for r in pieces} == want and sum(r["length"] for r in pieces) == sum(len(e.whole(t or "")) + 1 for t in kept)


def test_an_empty_table(spark, tmp_path):
    assert P.run(spark, tables(spark, str(tmp_path), [], [])).count() == 0


def test_toxic_documents_go_and_clean_odd_ones_stay(spark, tmp_path):
    """Labels that do fit a model, among nulls, empty and long texts, ties and repeated rows."""
    rnd = random.Random(8)
    bad = [(1000 + i, " ".join([*words(rnd, 30, 300), "vile", "scum"])) for i in range(60)]
    good = [(2000 + i, " ".join(words(rnd, 30, 300))) for i in range(200)]
    rows = [*ROWS, *bad, *good, (300, "some vile scum once more"), (301, "once more at the lake"), (None, "vile scum without an id")]
    d = tables(spark, str(tmp_path), rows, [(i, 1, 1) for i, _ in bad] + [(i, 1, 0) for i, _ in good])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = [(r["doc_id"], r["text"]) for r in P.toxicity(spark, docs, d).select("doc_id", "text").collect()]
    assert sorted(kept, key=str) == sorted([*ROWS, *good, (301, "once more at the lake")], key=str)
    packed = {r["doc_id"] for r in P.run(spark, d).collect()}
    assert 301 in packed and not packed & {300, *(i for i, _ in bad)}
