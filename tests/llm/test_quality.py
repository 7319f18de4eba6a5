import zlib

import numpy as np

from plumbline.llm import quality


def test_held_out_accuracy(spark, sf):
    from plumbline.llm._io import table

    docs, labels = table(spark, sf.replace("sf0.001", "sf0.01"), "documents"), table(spark, sf.replace("sf0.001", "sf0.01"), "labels")
    scored = quality.score(docs, quality.learnt(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(scored) > 50 and (scored.predicted == scored.quality).mean() >= 0.95
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.5) == (scored.predicted == 1)).all()


def test_odd_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "x" * 300_000), (None, "text"), (4, "same"), (4, "same")]
    labels = spark.createDataFrame([(1, 1, 5), (1, 0, 5), (None, 1, 5), (3, None, 5)], "doc_id long, quality int, text int")
    docs = make_docs(rows)
    out = quality.score(docs, quality.learnt(docs, labels)).collect()
    assert len(out) == len(rows) and all(r["score"] == 0.5 and r["predicted"] == 1 for r in out)
    assert quality.score(make_docs([]), quality.learnt(docs, labels)).collect() == []
    assert quality.keep_good(docs, quality.learnt(docs, labels)).count() == len(rows)


def test_ranking_separates():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, len(quality.SIGNS) + 18)).astype(np.float32)
    good = np.arange(400) % 4 > 0
    x[good, 3] += 6
    s = quality.fit(x, good, 0.25).scores(x)
    assert ((s >= 0.5) == good).mean() > 0.97


def test_fit_and_score_against_the_definition(spark, make_docs, prose):
    """The weights stand where the penalised loss over all preference pairs does not fall any more; scores follow from them."""
    r = np.random.default_rng(5)
    x = r.normal(size=(60, len(quality.SIGNS) + 18)).astype(np.float32)
    good = np.arange(60) % 3 > 0
    x[good, :3] += 0.7
    fitted = quality.fit(x, good, 1 / 3, l2=0.05, steps=3000)
    z = np.clip((x.astype(np.float64) - x.mean(0)) / (x.astype(np.float64).std(0) + 1e-6), -8, 8)
    picks = np.random.default_rng(7)
    pairs = list(zip(picks.choice(np.flatnonzero(good), quality.PAIRS), picks.choice(np.flatnonzero(~good), quality.PAIRS), strict=True))
    loss = lambda w: sum(np.log1p(np.exp(-float((z[i] - z[j]) @ w))) for i, j in pairs[::40]) / len(pairs[::40]) + 0.025 * float(w @ w)
    whole = lambda w: np.log1p(np.exp(-np.array([z[i] - z[j] for i, j in pairs]) @ w)).mean() + 0.025 * float(w @ w)
    best = whole(fitted.weights)
    assert best < loss(np.zeros(len(fitted.weights)))
    assert all(whole(fitted.weights + step) >= best - 1e-9 for step in r.normal(size=(30, len(fitted.weights))) * 0.02)
    texts = [prose(i, 5 + 7 * i) for i in range(20)] + [None, ""]
    out = {row["doc_id"]: row["score"] for row in quality.score(make_docs(list(enumerate(texts))), fitted).collect()}
    for i, t in enumerate(texts):
        f = quality.features((t or "").encode())
        s = sum(max(-8.0, min(8.0, (float(f[k]) - fitted.mean[k]) / fitted.scale[k])) * fitted.weights[k] for k in range(len(f)))
        assert abs(out[i] - 1 / (1 + np.exp(-max(-60.0, min(60.0, s - fitted.threshold))))) < 1e-9


def test_repeated_ids_are_learnt_once(spark, make_docs, prose):
    rows = [(i, prose(i, 50) if i % 2 else "|#|# " * 40) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    once = quality.learnt(make_docs(rows), labels)
    again = quality.learnt(make_docs(rows + [(3, "zzz later"), (3, "zzz later")] + rows[4:8]), labels)
    assert (once.weights == again.weights).all() and once.threshold == again.threshold


def test_learns_from_every_labelled_row(spark, make_docs, prose):
    """2,300 rows of one label and 300 of the other, not held out: moments, weights and threshold are those of all of them and all their pairs."""
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 3 != 1][:2600]
    rows = [(i, prose(i, 4 + i % 23) + (" #|" * (i % 5) if i % 11 else "") + (" ." if k % 26 < 3 else "")) for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, int(k % 26 >= 3)) for k, i in enumerate(ids)], "doc_id long, quality int")
    learnt = quality.learnt(make_docs(rows), labels)
    x = np.stack([quality.features(t.encode()) for _, t in rows]).astype(np.float64)
    good = np.array([k % 26 >= 3 for k in range(len(ids))])
    assert np.allclose(learnt.mean, x.mean(0), rtol=1e-12, atol=1e-12) and np.allclose(learnt.scale, x.std(0) + 1e-6, rtol=1e-9)
    z = learnt.standard(x)
    lost = 1 / (1 + np.exp(z[good] @ learnt.weights[:, None] - z[~good] @ learnt.weights))
    grad = (z[~good].T @ lost.sum(0) - z[good].T @ lost.sum(1)) / lost.size + 1e-3 * learnt.weights
    assert np.abs(learnt.weights).max() > 0.1 and np.abs(grad).max() < 1e-6
    s = np.sort(z @ learnt.weights)
    assert abs(learnt.threshold - (s[(~good).sum() - 1] + s[(~good).sum()]) / 2) < 1e-9
    shuffled = quality.learnt(make_docs(rows[::-1]).repartition(5), labels.repartition(3))
    assert (shuffled.weights == learnt.weights).all() and shuffled.threshold == learnt.threshold


def test_cells_hold_every_row(spark):
    """Beyond 2 * MEET rows of the rarer label: no pair meets twice, every row meets at least half of MEET, and rows are told once."""
    x = np.arange(quality.WIDTH, dtype=np.float32)
    rows = spark.createDataFrame([(i, int(i >= 900), (x + i).tobytes()) for i in range(900 + 2100)], "id long, y int, x binary")
    cells, groups = quality._cells(rows, 0, 900, 2100)
    assert groups == 3
    met, once = {}, []
    for r in cells.collect():
        ids = [int(np.frombuffer(b, np.float32)[0]) for b in r["x"]]
        bad, good = ([i for i, y in zip(ids, r["y"], strict=True) if y == want] for want in (0, 1))
        once += good + (bad if r["cell"] < groups else [])
        for i in bad:
            assert met.setdefault(i, set()).isdisjoint(good)
            met[i] |= set(good)
        for j in good:
            met[j] = set(bad)
    assert sorted(once) == list(range(3000)) and min(map(len, met.values())) >= quality.MEET // 2
