import hashlib

import corpus_pipeline
from plumbline.llm import bpe, latent, pii, quality
from plumbline.llm._io import table


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [r.asDict() for r in docs.collect()]
    ranking = quality.learnt(docs, table(spark, sf, "labels"))
    want = [r for r in rows if ranking.scores(quality.features((r["text"] or "").encode())[None])[0] >= 0.5]
    state = docs
    state = corpus_pipeline.STAGES[0][1](spark, state, sf)
    assert state.columns == docs.columns and sorted(r["doc_id"] for r in state.collect()) == sorted(r["doc_id"] for r in want)

    from plumbline.llm.order_minhash import similar
    from plumbline.llm.substring import words

    texts = {r["doc_id"]: words((r["text"] or "").encode()) for r in want}
    best = {i: i for i in texts}
    pairs = [(i, j) for i in texts for j in texts if i < j and (texts[i] == texts[j] or min(len(texts[i]), len(texts[j])) >= 5 and similar(texts[i], texts[j], 0.8))]
    for _ in range(20):
        for i, j in pairs:
            best[i] = best[j] = min(best[i], best[j])
    want = [r for r in want if best[r["doc_id"]] == r["doc_id"]]
    state = corpus_pipeline.STAGES[1][1](spark, state, sf)
    assert state.columns == docs.columns and sorted(r["doc_id"] for r in state.collect()) == sorted(r["doc_id"] for r in want)

    items = [latent.split_words(r["text"].encode()) for r in table(spark, sf, "benchmark").collect()]

    def holds(text):
        own = b" " + b" ".join(latent.split_words(text.encode())) + b" "
        return any(b" " + b" ".join(i) + b" " in own for i in items)

    want = [r for r in want if not holds(r["text"])]
    state = corpus_pipeline.STAGES[2][1](spark, state, sf)
    assert state.columns == docs.columns and sorted(r["doc_id"] for r in state.collect()) == sorted(r["doc_id"] for r in want)

    state = corpus_pipeline.STAGES[3][1](spark, state, sf)
    for r in want:
        r["text"] = pii.redacted(r["text"], pii.all_spans(r["text"])[1])
        r["n_chars"] = len(r["text"])
    assert sorted([r.asDict() for r in state.collect()], key=str) == sorted(want, key=str)

    own = bpe.vocabulary(bpe.default_path())
    out = {r["doc_id"]: r for r in corpus_pipeline.STAGES[4][1](spark, state, sf).collect()}
    for r in want:
        assert out[r["doc_id"]]["ids"] == own.encode(r["text"]) and out[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(r["doc_id"] for r in whole.select("doc_id").collect()) == sorted(out)


def test_stages_take_odd_rows(spark, sf, tmp_path, prose):
    """Nulls everywhere, empty and very long texts, repeated rows, clashing names, empty tables: each stage gives its defined rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _kept string, _bad int, id string, key map<string,int>, score double"
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    long = prose(1, 60_000)
    rows = [(1, None), (2, ""), (3, long), (4, long + " more"), (None, "no id"), (None, None), (5, "twice twice twice twice twice"), (5, "twice twice twice twice twice"), (6, "mail a@b.cd")]
    docs = spark.createDataFrame([(i, t, None, "s", None, "k", 1, "x", {"a": 1}, None) for i, t in rows], schema)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, empty, str(tmp_path))
        assert none.collect() == [] and none.columns == out.columns
        got = sorted([(r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()])
        ids = [i for _, i in got]
        if name == "near_dedup":
            assert got == [(False, 1), (False, 3), (False, 5), (False, 6), (True, 0), (True, 0)]
        elif name != "quality":
            assert ids == [1, 2, 3, 4, 5, 5, 6, 0, 0]
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "pii":
            assert {r["text"] for r in out.filter("doc_id = 6 OR doc_id = 1").collect()} == {"mail [EMAIL]", None}
