import random
import re
import time

from pyspark.sql import functions as F

from plumbline.llm import order_minhash
from plumbline.llm.substring import words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(3)
    for _ in range(3000):
        a = [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        b = list(a) if r.random() < 0.6 else [r.randint(0, 3) for _ in range(r.randint(0, 14))]
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.randint(0, 3))
        most, d = r.randint(0, 14), distance(a, b)
        assert order_minhash.banded_distance(a, b, most) == (d if d <= most else None)


def brute(rows, threshold):
    texts = [(i, words((t or "").encode())) for i, t in rows]
    best = {i: i for i, _ in texts}
    while True:
        changed = False
        for i, a in texts:
            for j, b in texts:
                same = a == b or len(a) >= 5 and len(b) >= 5 and 1 - distance(a, b) / max(len(a), len(b)) >= threshold
                if best[j] < best[i] and same:
                    best[i], changed = best[j], True
        if not changed:
            return best


def test_classes(make_docs, prose):
    rows, common = [], prose(50, 30, 5000)
    for g in range(12):
        base = prose(g, 120, 5000).split()
        for c in range(4):
            w = list(base)
            for _ in range(c * 2):
                w[random.Random(g * 10 + c).randrange(len(w))] = f"x{g}{c}"
            rows.append((g * 100 + c * 7 + 1, " ".join(w)))
    rows += [(5000 + i, f"{prose(500 + i, 40, 5000)} {common} {prose(600 + i, 40, 5000)}") for i in range(20)]
    rows += [(9001, None), (9002, ""), (9003, "one two"), (9004, "one  two"), (9005, "one three")]
    out = order_minhash.classes(make_docs(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute(rows, 0.8)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)


def test_odd_rows(make_docs, prose):
    long = prose(1, 20_000, 5000)
    rows = [(None, long), (None, long), (3, long), (2, long.replace("w1 ", "w2 ", 3)), (7, "a b c d e f"), (7, "a b c d e f")]
    out = order_minhash.classes(make_docs(rows)).collect()
    assert len(out) == len(rows)
    assert {r["class_id"] for r in out if r["doc_id"] in (2, 3)} == {2}
    kept = order_minhash.keep_one(make_docs(rows)).collect()
    assert sorted([r["doc_id"] for r in kept], key=str) == [2, 7, None, None]
    assert order_minhash.classes(make_docs([])).collect() == []


def test_repeated_ids_and_clashing_names(spark, prose):
    """An id with two texts joins their classes; of rows with one id one stays, whatever the order of rows; names used inside may be columns."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a, "p", 1, 2), (7, a, "q", 1, 2), (7, b, "q", 1, 2), (8, b, "r", 1, 2), (9, b, "s", 1, 2), (4, c, "t", 1, 2), (4, c, "u", 3, 2), (4, c, "u", 3, 2), (4, prose(5, 60), "v", 1, 2), (None, c, "w", 1, 2)]
    schema = "doc_id long, text string, _kept string, _first long, same int"
    first = None
    for seed in range(2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, schema).repartition(3)
        out = order_minhash.classes(docs).collect()
        assert {(r["doc_id"], r["class_id"], r["n_class"]) for r in out if r["doc_id"]} == {(i, 1, 5) for i in (1, 7, 8, 9)} | {(4, 4, 4)} and len(out) == 10
        kept = order_minhash.keep_one(docs)
        assert kept.columns == docs.columns
        got = sorted([tuple(r) for r in kept.collect()], key=str)
        assert [r[0] for r in got] == [1, 4, None] and got == (first or got)
        first = got


def edited(r, text, n):
    """The text after n edits of single words at different places: changed, or, at every fourth, lost or put in."""
    out = list(text)
    for c, at in enumerate(sorted(r.sample(range(len(out)), n), reverse=True)):
        kind = r.randrange(8)
        if kind == 0:
            del out[at]
        elif kind == 1:
            out.insert(at, b"in%d" % c)
        else:
            out[at] = b"new%d" % c
    return out


def test_recall_of_keys():
    """Pairs at every step from 0.80 on share a key."""
    r = random.Random(8)
    for n in (5, 7, 9, 10, 12, 14, 20, 40, 65, 100, 300):
        for percent in (80, 82, 85, 88, 90):
            pairs = []
            while len(pairs) < 60:
                a = [b"w%d" % r.randrange(5000) for _ in range(n)]
                b = edited(r, a, max(1, n * (100 - percent) // 100))
                if order_minhash.similar(a, b, 0.8) and len(b) >= 5:
                    pairs.append((a, b))
            keys = order_minhash.sketch_keys([t for p in pairs for t in p])
            met = sum(not set(x).isdisjoint(y) for x, y in zip(keys[::2], keys[1::2], strict=True))
            assert met >= (60 if n <= 40 else 59), (n, percent, met)


def test_many_copies_and_crowded_buckets(make_docs):
    """A thousand edited copies of one lost original, and pairs whose buckets' smallest ids are of other classes or lengths."""
    r = random.Random(4)
    fresh = lambda n: [b"w%d" % r.randrange(9000) for _ in range(n)]
    original = fresh(200)
    copies = [edited(r, original, 14) for _ in range(1000)]
    assert all(order_minhash.similar(copies[0], c, 0.8) for c in copies)
    rows = [(5000 + i, t) for i, t in enumerate(copies)]
    common = fresh(12)
    pairs = [(100 + i, common + fresh(8)) for i in range(12)]  # all they share with their like stands in each of them
    rows += [(1, common), (2, common + fresh(60)), *pairs] + [(i + 1000, [b"new%d" % j if j in (13, 15, 17, 19) else w for j, w in enumerate(t)]) for i, t in pairs]
    out = {r["doc_id"]: r["class_id"] for r in order_minhash.classes(make_docs([(i, b" ".join(t).decode()) for i, t in rows])).collect()}
    assert {out[i] for i in range(5000, 6000)} == {5000}
    assert all(out[i + 1000] == out[i] for i, _ in pairs)


def rows_made(spark, since, names):
    """Output rows by node (its description's first 60 characters) of the executions after `since`, for nodes of these names; the last execution."""
    time.sleep(2)  # for the listeners
    store, out, last = spark._jsparkSession.sharedState().statusStore(), {}, since
    every = store.executionsList()
    for e in (every.apply(i).executionId() for i in range(every.size())):
        last = max(last, e)
        if e > since:
            values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
            for node in (nodes.apply(i) for i in range(nodes.size())):
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if any(n in node.name() for n in names) and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        what = re.sub(r"#\d+L?|^BroadcastHash|^SortMerge", "", node.desc())[:60]
                        out[what] = out.get(what, 0) + int(values.apply(m.accumulatorId()).replace(",", ""))
    return out, last


def test_failed_pairs_are_joined_once(spark, make_docs, prose):
    """Strangers with a common line share many keys, but a failed pair is one row of a join, however many; the rows grow with the texts."""
    common = prose(1, 24, 9000)
    made, (_, last) = [], rows_made(spark, -1, [])
    for n in (100, 300):
        docs = make_docs([(i, f"{prose(100 + i, 12, 9000)} {common} {prose(9000 + i, 12, 9000)}") for i in range(n)])
        assert {r["n_class"] for r in order_minhash.classes(docs).collect()} == {1}
        out, last = rows_made(spark, last, ["Join", "MapInArrow"])
        judged = next(v for k, v in out.items() if k.startswith("MapInArrow run(id, th, hub"))
        joined = sum(v for k, v in out.items() if k.startswith("Join [id, th, hub, hub_th], [id, th, hub, hub_th], Inner"))
        assert 0 < joined <= judged
        made.append(joined)
    assert made[1] <= 4 * made[0]


def test_failed_under(spark):
    """Of the keys of failed pairs alone the smallest under each seed, equal to the definition."""
    pairs = spark.createDataFrame([(1, 0, 9, 0, [5, 6, 7]), (1, 0, 8, 0, [7, 11]), (1, 0, 7, 0, [1, 2, 3]), (2, 0, 9, 0, [4])], "id long, th int, hub long, hub_th int, keys array<long>")
    failed = pairs.filter("hub > 7").withColumn("similarity", F.lit(0.0))
    got = {r["id"]: r["picked"] for r in order_minhash._failed_under(pairs, failed).collect()}
    flat = spark.createDataFrame([(1, k) for k in (5, 6, 7, 11)] + [(2, 4)], "id long, key long")
    want = flat.groupBy("id").agg(F.array(*(F.min_by("key", F.xxhash64("key", F.lit(s))) for s in range(order_minhash.SECOND))).alias("picked"))
    assert got == {r["id"]: r["picked"] for r in want.collect()}
