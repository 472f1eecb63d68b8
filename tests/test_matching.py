"""Passages in texts, independent pairs and related records against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cuelens.operators import containment, crossing, relating


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_contained(spark):
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice(["ab", "b", "abc", "c a", " ", "  ", "\n", "é日", ".", "the "]) for _ in range(n))
    texts = [(i, say(rng.randrange(0, 25))) for i in range(80)] + [(90, None), (91, ""), (92, "the one"), (92, "the one"), (None, "the one"), (93, " \n ")]
    passages = [(i, say(rng.randrange(0, 6))) for i in range(120)] + [(200, None), (201, ""), (202, "the "), (202, "the "), (203, " "), (204, "he on"), (205, "zz"), (206, "the zz one"), (207, "one"), (208, "e"), (209, "\n ")]
    passages += [(300 + i, t[k : k + 9]) for i, t in texts[:60] if t for k in (0, 3, 11)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in texts], "doc_id long, text string, passage string, n int").repartition(3)
    table = spark.createDataFrame([(*r, "x", 1) for r in passages], "passage_id long, passage string, word string, n int")
    got = sorted((r.passage_id, -1 if r.doc_id is None else r.doc_id) for r in containment.contained(docs, table).collect())
    want = sorted((i, -1 if d is None else d) for i, p in passages if p for d, t in texts if t is not None and p in t)
    assert got == want and len(want) > 500
    assert containment.contained(docs.limit(0), table).count() == 0 and containment.contained(docs, table.limit(0)).count() == 0


def test_contained_needs_no_nested_loop(spark):
    """100,000 passages that share a word with all texts: candidates alone are read, and no join is a loop over all pairs."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("of the start w"), "id", F.lit(" of the end")).alias("text"))
    items = spark.range(100_000).select(F.col("id").alias("passage_id"), F.concat(F.lit("the start w"), "id", F.lit(" of")).alias("passage"))
    found = containment.contained(docs, items)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [(i, i) for i in range(4000)]


def brute_pairs(rows):
    best = {}
    for run in {r[0] for r in rows}:
        mine = sorted((i, set(s)) for r, i, s in rows if r == run and s)
        pairs = ((a, b) for k, (a, x) in enumerate(mine) for b, y in mine[k + 1 :] if not x & y)
        if first := min(pairs, default=None):
            best[run] = first
    return best


def test_independent_pairs(spark, monkeypatch):
    """Many small runs, hubs, wide sets, sets that all meet without a common issuer: the first pair of each."""
    rng = random.Random(6)
    rows, at = [], 0
    for run in range(150):
        kind, names = run % 5, "abcdefgh"[: rng.randrange(2, 9)]
        for _ in range(rng.randrange(1, 14)):
            some = rng.sample(names, rng.randrange(0, len(names) + 1))
            some = ["hub", *some] if kind == 1 else rng.choice([["p", "q"], ["q", "r"], ["p", "r"]]) + some if kind == 2 else [*some, f"own{at}"] if kind == 3 else some
            rows.append((f"r{run}", at, some))
            at += rng.choice([1, 1, 2])
    rows += [("twice", 1, ["a", "a"]), ("twice", 1, ["a"]), ("twice", 3, ["b", "a"])]
    table = spark.createDataFrame(rows, "run string, i int, iss array<string>").repartition(3)
    for most in (12, 2):
        monkeypatch.setattr(crossing, "MOST_SHARED", most)
        got = crossing.independent_pair(table, "run", "iss", "i")
        assert {r.run: (r.first, r.second) for r in got.collect()} == brute_pairs(rows)


def test_independent_pair_of_many_sets(spark):
    """10,000 distinct sets of one run that all meet but for the last two: sets are counted, not paired."""
    sets = spark.range(9998).select(F.lit("r").alias("run"), "id", F.array(F.lit("hub"), F.concat(F.lit("x"), (F.col("id") % 120).cast("string")), F.concat(F.lit("y"), (F.col("id") / 120).cast("int").cast("string"))).alias("iss"))
    more = spark.createDataFrame([("r", 20000, ["hub", "x0"]), ("r", 20001, ["x119"])], "run string, id long, iss array<string>")
    found = crossing.independent_pair(sets.unionByName(more), "run", "iss", "id")
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert list(map(tuple, found.collect())) == [("r", 0, 20001)]


def brute_related(rows, limit):
    out = set()
    for i, _, mine, _ in rows:
        topics = [k for k in mine if not k.startswith(("desk:", "kind:"))]
        pair = [next((k for k in mine if k.startswith(p)), None) for p in ("desk:", "kind:")]
        scored = []
        for o, created, theirs, nexus in rows:
            if o != i:
                common = [k for k in topics if k in theirs]
                soft = None not in pair and pair == [next((k for k in theirs if k.startswith(p)), None) for p in ("desk:", "kind:")]
                bonus = {"direct": 3, "possible": 1}.get(nexus, 0)
                if common or soft:
                    scored.append(((2 * len(common) + bonus) * (len(common) / len(theirs) if common else 1) + soft, created, o, tuple(common[:6] or pair)))
        scored.sort(reverse=True)
        out |= {(i, o, round(s, 9), shown, k + 1) for k, (s, _, o, shown) in enumerate(scored[:limit])}
    return out


@pytest.mark.parametrize("few, most, listed, seed", [(100, 8, 64, 1), (3, 8, 2, 2), (0, 8, 5, 3), (2, 2, 9, 4), (5, 0, 64, 5)])
def test_related(spark, monkeypatch, few, most, listed, seed):
    """Rare keys, hot ones by lists, sets of many hot keys, and pairs of one desk and kind: as all pairs would give."""
    for name, value in (("FEW_HOLDERS", few), ("MOST_HOT", most), ("LISTED", listed)):
        monkeypatch.setattr(relating, name, value)
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        keys = [f"hot:{c}" for c in "abcd" if rng.random() < 0.4] + [f"subj:{rng.randrange(25)}" for _ in range(rng.randrange(3))] + [f"nugget:{c}" for c in "xyz" if rng.random() < 0.3]
        keys = [*([f"desk:{rng.randrange(3)}"] if rng.random() < 0.9 else []), *keys, *([f"kind:{rng.randrange(2)}"] if rng.random() < 0.9 else [])]
        rows.append((i, rng.randrange(40), list(dict.fromkeys(keys)), rng.choice(["direct", "possible", "none", None])))
    table = spark.createDataFrame(rows, "id long, created long, keys array<string>, nexus string")
    found = relating.related(table)
    got = {(r.id, r.other, round(r.score, 9), tuple(r.shared_keys), r.k) for r in found.collect()}
    assert got == brute_related([r for r in rows if r[2]], 6)
    assert relating.related(table.limit(0)).count() == 0


def test_related_never_pairs_on_a_hot_key(spark, monkeypatch):
    """2,000 sets share one key: what meets grows with the sets and not with their pairs."""
    monkeypatch.setattr(relating, "FEW_HOLDERS", 10)
    rows = spark.range(2000).select("id", F.col("id").alias("created"), F.array(F.lit("hot:all"), F.concat(F.lit("subj:"), F.col("id").cast("string")), F.concat(F.lit("desk:"), F.col("id").cast("string"))).alias("keys"), F.lit("none").alias("nexus"))
    found = relating.related(rows)
    assert found.count() == 12000
    got = {r.other for r in found.where("id < 1000").collect()}
    assert got == set(range(1994, 2000))
