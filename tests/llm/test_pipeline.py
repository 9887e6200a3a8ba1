import hashlib

import corpus_pipeline
from skein.llm import common, mixing, near_dedup, toxicity


def test_stages_against_plain_versions(spark, sf):
    docs = common.table(spark, sf, "documents")
    labels = common.table(spark, sf, "labels")
    whole = {r["doc_id"]: r for r in docs.collect()}
    lexicon = toxicity.fit(docs, labels)
    # toxicity, row by row
    left = {i: r for i, r in whole.items() if lexicon.score(r["text"] or "") < toxicity.THRESHOLD}
    # exact copies: the largest id stays
    best = {}
    for i, r in left.items():
        best[r["text"] or ""] = max(i, best.get(r["text"] or "", i))
    left = {i: r for i, r in left.items() if best[r["text"] or ""] == i}
    # near copies: all pairs
    sets = {i: set(near_dedup.shingles(r["text"]).tolist()) for i, r in left.items()}
    par = {i: i for i in left}

    def top(x):
        while par[x] != x:
            x = par[x]
        return x

    ids = sorted(left)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                par[max(top(a), top(b))] = min(top(a), top(b))
    left = {i: r for i, r in left.items() if top(i) == i}
    # mixing
    kept = spark.createDataFrame(list(left.values()), docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture(kept).collect()}
    out = corpus_pipeline.run(spark, sf)
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
        assert r["decoded_sha256"] == hashlib.sha256((whole[r["doc_id"]]["text"] or "").encode()).hexdigest()
    assert got == {i: n for i, n in copies.items() if n}


def test_all_but_the_last_keep_the_columns(spark, sf):
    docs = common.table(spark, sf, "documents").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_empty_documents(spark, sf, nothing):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf), name)
        assert docs.count() == 0


def test_the_whole_pipeline_over_awkward_documents(spark, awkward, tmp_path):
    """Clashing columns, nulls, ties and long texts through all stages, as run() writes and reads them."""
    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (4, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*(c for c in awkward.columns if c != "text"), "_n_tokens", "_token_ids", "_decoded_sha256"]
    texts = {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in awkward.collect()}
    rows = out.collect()
    assert rows and all(r["_decoded_sha256"] in texts and r["n_tokens"] == "clash" for r in rows)
