import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from plumbline.llm import latent

BENCH = "item_id long, text string, id string, ids string"


def test_planted_items(spark, make_docs, prose):
    items = [(i, prose(1000 + i, 12 + 5 * i, 900)) for i in range(14)]
    rows = [(i, prose(i, 300, 900)) for i in range(80)]
    want = set()
    for i, (item, text) in enumerate(items):
        rows.append((500 + i, f"{prose(i + 300, 37 + i * 11, 900)} {text.upper().replace(' ', ', ')} {prose(i + 400, 60, 900)}"))
        want.add((500 + i, item))
    words = items[8][1].split()
    for k in random.Random(5).sample(range(len(words) - 8), 5):
        words[k] = "paraphrased"
    rows.append((700, f"{prose(900, 80, 900)} {' '.join(words)} {prose(901, 20, 900)}"))
    want.add((700, 8))
    rows += [(800, items[3][1]), (801, None), (802, ""), (None, items[2][1]), (803, items[9][1]), (803, items[9][1]), (805, prose(3, 30, 900) + " two, strange\nWORDS " + prose(4, 200, 900)), (806, "two strange"), (807, "two strange other words"), (808, "oddity"), (804, prose(7, 20_000, 900) + " " + items[1][1])]
    want |= {(800, 3), (None, 2), (803, 9), (804, 1), (805, 92), (808, 93), (505, 94)}
    bench = spark.createDataFrame([(*i, "x", "y") for i in items] + [(90, None, "", ""), (91, "", "", ""), (92, "two strange words", "", ""), (93, "Oddity!", "", ""), (94, items[5][1], "", ""), (95, "...", "", "")], BENCH)
    docs = make_docs(rows)
    got = [(r["doc_id"], r["item_id"]) for r in latent.contaminated(docs, bench).collect()]
    assert set(got) == want and got.count((803, 9)) == 2
    clean = latent.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    bad = {i for i, _ in want}
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(i for i, _ in rows if i not in bad)


def test_lcs():
    r = random.Random(1)
    for _ in range(500):
        a, b = [r.randrange(4) for _ in range(r.randrange(12))], [r.randrange(4) for _ in range(r.randrange(12))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert latent.lcs(a, b) == t[-1][-1]


def test_empty_tables(spark, make_docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h", "", "")], BENCH)
    assert latent.contaminated(make_docs([]), bench).collect() == []
    assert latent.contaminated(make_docs([(1, "a b c d e f g h")]), bench.limit(0)).collect() == []


def test_long_item_counts_as_a_whole(spark, make_docs, prose):
    """Of 100 words the first 50 stand whole, and 31 of the last 50: 0.81 of the item; or the other way round."""
    words = prose(1, 100, 5000).split()
    lost = random.Random(2).sample(range(50), 19)
    last = [f"x{i}" if i - 50 in lost else w for i, w in enumerate(words)]
    first = [f"x{i}" if i in lost else w for i, w in enumerate(words)]
    rows = [(i, prose(i + 10, 300, 5000)) for i in range(40)]
    rows += [(100 + i, f"{prose(60 + i, 90, 5000)} {' '.join(t)} {prose(70 + i, 90, 5000)}") for i, t in enumerate((last, first))]
    bench = spark.createDataFrame([(1, " ".join(words), "", "")], BENCH)
    got = {r["doc_id"]: r["lcs_share"] for r in latent.contaminated(make_docs(rows), bench).collect()}
    assert set(got) == {100, 101} and all(0.81 <= v < 0.9 for v in got.values())


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def by_all_windows(text, item):
    """Whether an item of at most 24 words is in a text, by the word-by-word rule at every window."""
    words, item = (latent.split_words(t.encode()) for t in (text, item))
    for at in range(0, max(1, len(words)), 8):
        region = words[max(0, at - 8) : at + 40]
        n = lcs_length(item, region)
        if n >= 0.8 * len(item) or n >= 0.65 * len(item) and lcs_length(item[-8:], region) == len(item[-8:]):
            return True
    return False


def test_against_brute_force(spark, make_docs, prose):
    """Items with 0 to 40 % of their words exchanged, the end among them or not: what the rule accepts is found, and nothing else."""
    r = random.Random(9)
    items = [(i, prose(2000 + i, 14 + i % 11, 600)) for i in range(24)]
    rows = []
    for n in range(240):
        words = items[n % 24][1].split()
        room = range(len(words)) if n % 2 else range(len(words) - 8)
        for at in r.sample(room, min(len(room), len(words) * (n % 5) // 10)):
            words[at] = f"w{r.randrange(600)}"
        rows.append((n, f"{prose(n, r.randrange(150), 600)} {' '.join(words)} {prose(n + 500, r.randrange(150), 600)}"))
    bench = spark.createDataFrame([(*i, "x", "y") for i in items], BENCH)
    got = {(x["doc_id"], x["item_id"]) for x in latent.contaminated(make_docs(rows), bench).collect()}
    want = {(n, i) for n, t in rows for i, item in items if by_all_windows(t, item)}
    assert len(want) > 150 and got <= want and len(got) >= 0.98 * len(want), (len(got), len(want))


def test_many_passes_and_blocks(spark, make_docs, prose, monkeypatch):
    """Bounds so small that the items take several passes and several blocks each."""
    items = [(i, prose(3000 + i, 20 + i, 900)) for i in range(30)]
    rows = [(i, f"{prose(i, 50, 900)} {t} {prose(i + 90, 50, 900)}") for i, t in items]
    bench = spark.createDataFrame([(*i, "x", "y") for i in items], BENCH)
    for name, value in (("WORDS", 300), ("TERMS", 250), ("PIECES", 2), ("KEPT_BLOCKS", 0)):
        monkeypatch.setattr(latent, name, value)
    assert {(x["doc_id"], x["item_id"]) for x in latent.contaminated(make_docs(rows), bench).collect()} == {(i, i) for i, _ in items}


def test_pieces_compared_together():
    """All rows at once give what the word-by-word rule gives one by one, with repeated words and pieces of 64 words."""
    r = np.random.default_rng(3)
    for _ in range(40):
        pieces = [r.integers(0, 20, n) for n in (*r.integers(5, 65, 6), 64)]
        items = latent.Items([b""] * 7, np.concatenate(pieces).astype(np.int32), np.cumsum([0, *map(len, pieces)]))
        table = latent.Block(items, [(j, 0, len(p)) for j, p in enumerate(pieces)], np.ones((31, 4), np.float32), 96, 32).table()
        ids, own = r.integers(-1, 30, (30, 160)), r.integers(0, 7, 30)
        got = table.lcs(table.column[ids], own, np.array([len(p) for p in pieces])[own])
        assert got.tolist() == [lcs_length(pieces[j].tolist(), row) for j, row in zip(own, ids.tolist(), strict=True)]
        assert table.shared(table.column[ids[:, :96]], own).tolist() == [sum(x in pieces[j] for x in row[:96]) for j, row in zip(own, ids)]
        assert table.lcs(table.column[ids[:0]], own[:0], own[:0]).tolist() == []


def test_sums_in_stretches(monkeypatch):
    monkeypatch.setattr(latent, "GATHERED", 7)
    r = np.random.default_rng(4)
    table, values = r.integers(0, 9, (50, 3)).astype(np.float32), np.sort(r.integers(0, 40, 200))
    at, begin = r.integers(0, 50, 200), latent._runs(values)
    assert values[begin].tolist() == np.unique(values).tolist()
    assert latent._sums(table, at, begin).tolist() == [table[at[values == v]].sum(0).tolist() for v in np.unique(values)]
    assert latent._sums(table, at[:0], latent._runs(values[:0])).shape == (0, 3)


def test_few_comparisons_one_by_one(prose, monkeypatch):
    """Candidates that do not hold the piece never reach the comparison of single items."""
    calls, plain = [], latent.lcs
    monkeypatch.setattr(latent, "lcs", lambda a, b: calls.append(1) or plain(a, b))
    vocabulary = {f"w{i}".encode(): i for i in range(60)}
    ids = [[vocabulary[w] for w in latent.split_words(prose(n, 300, 60).encode())] for n in range(60)]
    wanted = ids[7][100:120]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])
    place = np.random.default_rng(5).standard_normal((60, latent.RANK)).astype(np.float32)
    texts = SimpleNamespace(
        schema={"id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))},
        sparkSession=SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v))),
        mapInArrow=lambda run, _: [r for out in run(iter([batch])) for r in out.to_pylist()],
    )
    found = latent._search(texts, latent.Items([b"k"], np.array(wanted, np.int32), np.array([0, 20])), place, latent.COSINE, 0.8, 0.65)
    assert [(r["id"], r["lcs_share"], r["answer"]) for r in found] == [(7, 1.0, True)]
    assert len(calls) < 10
