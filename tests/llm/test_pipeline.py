"""The pipeline's stages against plain versions of them."""

import numpy as np

import corpus_pipeline as cp
from fernweave.llm import minhash, packing, quality
from fernweave.llm.common import stash

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    from tests.llm.test_operators import check_packing, lines_by_force

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    after = []
    df = docs
    for _, stage in cp.STAGES:
        df = stash(stage(spark, df, DATA))
        after.append(df)
    kept, lined, single, packed = after
    assert all(x.columns == docs.columns for x in after[:3])
    net = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r.doc_id for r in docs.collect() if net.scores([r.text.encode()])[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in kept.collect()} == want
    assert {r.doc_id: r.text for r in lined.collect()} == lines_by_force([(r.doc_id, r.text) for r in kept.collect()])
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    h = {r.doc_id: minhash.shingles(r.text.encode()) for r in lined.collect()}
    root = {i: i for i in h}
    ids = sorted(h)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (not len(h[a]) and not len(h[b])) or len(np.intersect1d(h[a], h[b])) and minhash.similar(h[a], h[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id for r in single.collect()} == {i for i in ids if find(i) == i}
    n, low = check_packing(packed.collect(), [(r.doc_id, r.text) for r in single.collect()])
    assert n <= low * 1.03 + 2
    assert cp.run(spark, DATA).count() == packed.count()
    assert packing.CAP == 2048


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, one doc_id with two texts, columns with names of ours, and no rows at all."""
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \n \n"), (4, text), (5, text), (5, text), (6, text + " more"), (None, "no id here at all but words"), (7, " ".join(f"v{i}" for i in range(30_000))), (7, "another text of this id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "node", "score", "keys", "__doc", "t")})
    for df in (docs, docs.limit(0)):
        some = stash(df)
        for _, stage in cp.STAGES[1:3]:
            after = stash(stage(spark, some, DATA))
            assert after.columns == docs.columns
            some = after
        got = sorted((r.doc_id or 0, len(r.text or "")) for r in some.collect())
        if df is docs:
            # lines that stand earlier go, so the later rows become empty texts, and those are one group
            assert [i for i, _ in got] == [0, 1, 4, 7, 7]
            assert packing.CAP == 2048 and cp.packing_stage(spark, some, DATA).select("doc_id").distinct().count() == 4
        else:
            assert got == [] and cp.packing_stage(spark, some, DATA).count() == 0
    every = cp.quality_stage(spark, docs, DATA)
    assert every.columns == docs.columns and every.count() <= docs.count() and cp.quality_stage(spark, docs.limit(0), DATA).count() == 0


def test_near_stage_does_not_depend_on_the_size_of_a_bucket(spark, monkeypatch):
    """Texts that share one band only, in one block and in many: one text of each group of alignment stays."""
    from pyspark.sql import functions as F

    from tests.llm.test_operators import groups_of, near_family, one_bucket

    one_bucket(monkeypatch, lambda node: F.lit(7).cast("long"))
    texts, near = near_family(120, 5, 9)
    docs = stash(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for block in (512, 20, 4):
        monkeypatch.setattr(minhash, "BLOCK", (block, 1 << 20))
        stay = cp.near_stage(spark, docs, DATA)
        assert sorted(r.doc_id for r in stay.collect()) == sorted(set(groups_of(120, near)))
