import hashlib

from plumbline.llm import substring


def brute(rows, window):
    texts = [(i, substring.words(t.encode() if t is not None else None)) for i, t in rows]
    first = {}
    for i, w in texts:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(make_docs, prose):
    passage, long = prose(1, 70), prose(2, 6000)
    edited = long.split()
    edited[3000] = "changed"
    rows = [
        (5, f"{prose(3, 20)} {passage} {prose(4, 30)}"), (2, f"{passage}\t\n{prose(5, 9)}"), (9, long), (7, " ".join(edited)), (8, long), (11, None), (12, ""),
        (13, "a " * 200), (14, "a " * 120), (None, passage), (2, passage), (5, passage), (20, "  ".join(passage.split()[10:65])), (21, passage), (21, passage), (30, prose(6, 49)), (31, prose(6, 49)), (32, "a\x1cb\xa0c " * 30), (33, "a\x1cb\xa0c " * 40),
    ]
    out = substring.remove_repeats(make_docs(rows))
    assert out.columns[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted([tuple(r)[:4] for r in out.collect()], key=str) == brute(rows, 50)


def test_many_near_copies_and_a_common_passage(make_docs, prose):
    import random

    base, common = prose(10, 150).split(), prose(11, 60)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[random.Random(i).randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"{prose(200 + i, 40)} {common} {prose(300 + i, 40)}") for i in range(40)]
    out = substring.remove_repeats(make_docs(rows))
    assert sorted([tuple(r)[:4] for r in out.collect()], key=str) == brute(rows, 50)


def test_empty_table(make_docs):
    assert substring.remove_repeats(make_docs([])).collect() == []
