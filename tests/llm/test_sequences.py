import random
from collections import Counter
from datetime import datetime
from itertools import combinations

from loomfit.llm import heavy, runs, terms, together
from loomfit.llm import together as tg
from loomfit.llm.shared import counting_copies

SEQS = "seq_id bigint, sequence array<bigint>, secs array<int>, loaded_at timestamp, n string, dup string"


def at(k):
    return datetime(2025, 1, 1, 0, 0, k)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SEQS)


def test_counting_copies(spark, rows):
    df = table(spark, [(1, [1], None, at(1)), (1, [1, 2], None, at(2)), (1, [1, 2], None, at(2)), (2, None, None, None), (2, [9], None, at(0)), (None, [7], None, at(1)), (None, [7], None, at(1))])
    got = counting_copies(df.drop("dup"), "sequence").select("seq_id", "sequence")
    assert rows(got) == sorted([(1, [1, 2]), (2, [9]), (None, [7]), (None, [7])], key=str)
    assert counting_copies(df.limit(0), "sequence", "secs").count() == 0


def test_top_items(spark, rows, monkeypatch):
    rng = random.Random(1)
    items = [int(rng.paretovariate(0.7)) % 500 for _ in range(4000)] + [None] * 300 + [0] * 50
    df = spark.createDataFrame([(i,) for i in items], "item bigint").repartition(6)
    n = Counter(i for i in items if i is not None)
    for k, share in ((5, 0.0), (200, 0.005), (1, 0.9)):
        got = rows(heavy.top_items(heavy.node_counts(df), k, share))
        low = max(sorted(n.values())[-k] if k <= len(n) else 0, share * len(items))
        assert got == sorted(((i, c, len(items)) for i, c in n.items() if c >= low), key=str)
    assert heavy.top_items(heavy.node_counts(df.limit(0)), 3).count() == 0
    monkeypatch.setattr(heavy, "NODE_ITEMS", 40)
    small = heavy.node_counts(df.coalesce(1))
    assert {r["item"]: r["n"] for r in heavy.top_items(small, 500).collect()} == dict(n)


def test_ratings_count_once(spark, rows):
    df = spark.createDataFrame([(1, 5, at(1)), (1, 5, at(2)), (2, None, at(1)), (None, 5, at(1))], "rating_id bigint, item bigint, loaded_at timestamp")
    assert rows(heavy.distinct_ratings(df)) == [(1, 5), (2, None)]


def brute_runs(seq, secs, root):
    e = [(p, root.get(x, x), secs[p] if secs and p < len(secs) else None) for p, x in enumerate(seq or []) if x]
    out, first = [], 0
    for k in range(1, len(e) + 1):
        same = k < len(e) and e[k][1] == e[k - 1][1] and not (e[k][2] is not None and e[k - 1][2] is not None and e[k][2] - e[k - 1][2] > 600)
        if not same:
            if k - first > 1:
                a, b = e[first][2], e[k - 1][2]
                out.append((e[first][0], e[k - 1][0], k - first, None if a is None or b is None else b - a))
            first = k
    return out


def test_runs(spark, rows, monkeypatch):
    rng = random.Random(3)
    alias = [(7, 1, at(0)), (8, 7, at(0)), (8, 7, at(0)), (9, None, at(0)), (5, 5, at(0)), (None, 3, at(0)), (4, 2, at(1)), (4, 3, at(0))]
    root = {7: 1, 8: 1, 4: 2}
    data = [(k, [rng.choice([1, 1, 2, 4, 7, 8, 9, 0, None]) for _ in range(rng.randrange(40))], [rng.choice([None, 0, 300, 900]) for _ in range(rng.randrange(41))], at(1)) for k in range(40)]
    data += [(100, [6] * 150, None, at(1)), (101, None, [1], at(1)), (102, [], [], at(1)), (None, [3, 3], [1, 2], at(1)), (None, [3, 3], [1, 2], at(1))]
    want = sorted(((k, *r) for k, s, t, _ in data for r in brute_runs(s, t, root)), key=str)
    df, names = table(spark, data).drop("dup"), spark.createDataFrame(alias, "alias bigint, item bigint, since timestamp")
    copies = counting_copies(df, "sequence", "secs")
    assert rows(runs.collapse(runs.repeated_links(copies, names)).drop("dup")) == want
    monkeypatch.setattr(runs, "BROADCAST_ROWS", 0)
    assert rows(runs.repeated_links(copies, names).select("seq_id", "pos")) == sorted(((k, p) for k, s, t, _ in data for a, b, *_ in brute_runs(s, t, root) for p in range(a + 1, b + 1) if s[p]), key=str)
    assert runs.collapse(runs.repeated_links(copies.limit(0), names.limit(0))).count() == 0


def test_terms(spark, rows, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_PAIRS", 5)
    data = [[1, 1, 2], [2, None, 0], None, [], [0], [-3, 1], [1] * 30]
    got, filled = terms.term_frequencies(spark.createDataFrame([(s,) for s in data], "sequence array<bigint>"))
    assert rows(got) == [(-3, 1, 1), (1, 33, 3), (2, 2, 2)] and filled == 5
    got, filled = terms.term_frequencies(spark.createDataFrame([], "sequence array<bigint>"))
    assert got.count() == 0 and filled == 0


def test_together(spark, monkeypatch):
    rng = random.Random(5)
    data = [[rng.choice([1, 2, 3]) for _ in range(6)] + [10 + 2 * (k % 5), 11 + 2 * (k % 5)] * (k % 3 > 0) for k in range(120)]
    data += [[], None, [None, 0], [4], list(range(200, 260))] + [list(range(200, 230))] * 6
    df = spark.createDataFrame([(s,) for s in data], "sequence array<bigint>")
    sets = [{x for x in s if x} for s in data if s]
    n, one, two = len(sets), Counter(x for s in sets for x in s), Counter(p for s in sets for p in combinations(sorted(s), 2))
    want = {p for p, c in two.items() if c >= 6 and c / (one[p[0]] + one[p[1]] - c) >= 0.2 and c * n >= 5 * one[p[0]] * one[p[1]]}
    for chunk, hot in ((256, 4000), (7, 40)):
        monkeypatch.setattr(tg, "CHUNK", chunk)
        monkeypatch.setattr(tg, "HOT", hot)
        got = together.appear_together(df).collect()
        assert {(r["id_a"], r["id_b"]) for r in got} == want and all(r["n_ab"] == two[r["id_a"], r["id_b"]] for r in got)
    assert together.appear_together(df.limit(0)).count() == 0
