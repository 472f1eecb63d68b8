"""Hard negatives, importance resampling and packing against brute force, with the awkward cases all operators must take."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuelens.llm import balltree, importance, mixes, negatives, packing

EXTRA = "score double, rank int, nth int, tree long, part int, own string"


def brute_negatives(rows, positives, negatives_, low, high, is_anchor, scale=256):
    """Every row against every anchor with whole numbers, an id once by its best score."""
    good = [(i, y, [math.floor(scale * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    own = {}
    for i, y, v in good:
        if is_anchor(i) and (i not in own or (y, v) < own[i]):
            own[i] = (y, v)
    out = Counter()
    for a, (label, q) in own.items():
        same, other = defaultdict(list), defaultdict(list)
        for i, y, v in good:
            if i != a and len(v) == len(q):
                (same if y == label else other)[i].append(sum(x * z for x, z in zip(q, v, strict=True)))
        best = sorted((-max(s), i) for i, s in same.items())[:positives]
        for minus, p in best:
            fit = {i: [x for x in s if low * -minus <= 100 * x <= high * -minus] for i, s in other.items()}
            found = sorted((-max(s), i) for i, s in fit.items() if s)[:negatives_]
            out.update((a, p, k + 1, i, -minus, -s) for k, (s, i) in enumerate(found))
    return out


def vectors(n=600, dims=6):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.4) for c in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    rows += [(1000 + k, rows[0][1], rows[0][2] if k % 2 else 3 - rows[0][2]) for k in range(300)]  # copies: ties by id
    rows += [(n + 5, None, 1), (n + 6, [1.0] * dims, None), (None, [1.0] * dims, 1), (n + 7, [1.0, None, *[0.0] * (dims - 2)], 1), (n + 8, [math.nan] * dims, 1), (n + 9, [math.inf] * dims, 2)]
    rows += [(2000, [], 1), (2010, [], 2), (2020, [0.5], 1), (2030, [0.5], 1), (2031, [0.49], 2), rows[3], rows[10], (20, rows[21][1], 1), (-50, rows[4][1], -7)]
    return rows


def test_hard_negatives(spark, monkeypatch):
    """Small trees and batches, three tasks: equal to all pairs."""
    monkeypatch.setattr(negatives, "TREE_BYTES", 1500)
    monkeypatch.setattr(negatives, "MOST_TREE_BYTES", 1500)
    rows = vectors()
    table = spark.createDataFrame([(*r, 0.0, 1, 1, 1, 1, "x") for r in rows], f"vec_id long, embedding array<double>, label int, {EXTRA}").repartition(3, "vec_id")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = negatives.hard_negatives(table, F.col("vec_id") % 10 == 0, 5, 5, (80, 100))
    want = brute_negatives(rows, 5, 5, 80, 100, lambda i: i % 10 == 0)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want and len(want) > 500
    one = negatives.hard_negatives(table, F.col("vec_id") == 0, 3, 2, (33, 77))
    assert Counter(tuple(r[c] for c in columns) for r in one.collect()) == brute_negatives(rows, 3, 2, 33, 77, lambda i: i == 0)
    nothing = negatives.hard_negatives(table.limit(0), F.col("vec_id") == 0)
    assert nothing.count() == 0 and nothing.columns == columns
    assert negatives.hard_negatives(table, F.lit(False)).count() == 0


def test_ball_tree_prunes_and_stays_exact():
    """Clustered rows: nodes beneath the worst or outside a window are left out, and all results are right; huge components run in integers."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 20
    x = np.floor(256 * (centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 0.2))
    tree = balltree.Tree(np.arange(8000), np.zeros(8000, np.int64), x)
    none = np.full((1, 1), balltree.NONE)
    for scale in (1, 1 << 9):
        t = tree if scale == 1 else balltree.Tree(np.arange(8000), np.zeros(8000, np.int64), x * scale)
        for i in range(0, 8000, 1600):
            found = balltree.Search(np.array([i]), np.zeros(1, np.int64), x[i : i + 1] * scale, none, -none, 5, True)
            found.run(t)
            scores = (x * scale).astype(np.int64) @ (x[i] * scale).astype(np.int64)
            best = sorted((-s, j) for j, s in enumerate(scores.tolist()) if j != i)[:5]
            assert sorted(zip((-found.score).tolist(), found.id.tolist(), strict=True)) == best
            assert found.visited < 0.6 * len(tree.start)
            beyond = balltree.Search(np.array([i]), np.zeros(1, np.int64), x[i : i + 1] * scale, none + scores.max() - balltree.NONE + 2 * abs(scores).max(), -none, 5, True)
            beyond.run(t)
            under = balltree.Search(np.array([i]), np.zeros(1, np.int64), x[i : i + 1] * scale, none, none - balltree.NONE - 4 * abs(scores).max(), 5, True)
            under.run(t)
            assert not len(beyond.id) and not len(under.id) and beyond.visited + under.visited < 0.3 * len(tree.start)
    for start, stop, centre, radius in zip(tree.start, tree.stop, tree.centre, tree.radius, strict=True):
        assert np.sqrt(((tree.vectors[start:stop] - centre) ** 2).sum(1)).max() <= radius + 1e-6


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_features(t, n, buckets):
    w = words(t)
    return len(w), [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_running_states(n):
    """Extended states give the CRC of each joined run, over the ends of stretches and in texts shorter than a run."""
    rng = random.Random(n)
    for size in (0, 1, 2, 3, 4, 7, 40):
        w = [bytes(rng.choices(b"abc\xc3\xa9", k=rng.randrange(1, 5))) for _ in range(size)]
        want = Counter(crc32(b" ".join(w[i : i + k])) for k in range(1, n + 1) for i in range(size - k + 1))
        for stretch in (1, 2, 3, 100):
            assert Counter(c for states in importance.ring(w, n, stretch) for c in states) == want
    for t in ("It's A-B 12é É日本_x y", None, "", " \t"):
        count, found = importance.features(t, n, 97)
        assert (count, sorted(found.tolist())) == (brute_features(t, n, 97)[0], sorted(brute_features(t, n, 97)[1]))


def documents():
    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma's", "δέλτα", "x-1", "<|endoftext|>", "it'll"]) for _ in range(n))
    rows = [(i, say(rng.randrange(0, 80))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, say(40)), (7, rows[7][1]), (8, say(30)), (300, "z" * 9000), (301, say(4000)), (302, " \n\t"), *[(400, "same words " * 12)] * 60]
    return rows


def test_resampling(spark):
    rows = documents()
    target = [(1, "alpha beta gamma"), (2, None), (3, "alpha X-1 alpha beta")]
    docs = spark.createDataFrame([(*r, 0.0, 1, 1, 1, 1, "x") for r in rows], f"doc_id long, text string, {EXTRA}").repartition(4)
    goal = spark.createDataFrame(target, "item_id long, text string")
    buckets, n = 50, 3
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(brute_features(text, n, buckets)[1])
    for _, text in target:
        t.update(brute_features(text, n, buckets)[1])
    ahead, behind = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * ahead / ((s[b] + 1.0) * behind))) for b in range(buckets)]
    want, able = [], []
    for i, text in rows:
        count, found = brute_features(text, n, buckets)
        weight = math.floor(sum(gain[b] for b in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"9:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        (able if count >= 20 else want).append((i, count, len(found), weight, score))
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = 40 * len(able) // 100
    want = Counter([(*r, None) for r in want] + [(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)])
    got = importance.resample(docs, goal, 40, 20, "9", n, buckets)
    key = lambda r: (r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"])
    assert Counter(map(key, got.collect())) == want
    assert importance.importance_digest(docs.limit(0), goal).count() == 0
    alone = importance.importance_digest(docs, goal.limit(0))
    assert alone.columns == ["doc_id", "n_features", "weight", "score", "rank"] and alone.count() == len(rows)


def test_mixes():
    """All pairs and triples once; counts near the optimum; the plan deals every rank of every length once."""
    assert sorted(map(tuple, mixes.combinations(12).tolist())) == [(a, b, 12 - a - b) for a in range(5) for b in range(max(a, 1), 13) if b <= 12 - a - b]
    every, rng = mixes.combinations(64), np.random.default_rng(1)
    exact = np.bincount(every[rng.integers(0, len(every), 3000)].ravel(), minlength=64)
    exact[0] = 0
    kept, x = mixes.repeat_counts(every, exact)
    left = np.bincount(kept.ravel(), np.repeat(x, 3) * (kept.ravel() > 0), 64) - exact
    assert (x >= 0).all() and np.abs(left).sum() < 0.02 * exact.sum()  # such a histogram can be matched exactly
    for histogram in (exact, np.bincount([33] * 100, minlength=64), np.bincount([1] * 700 + [63], minlength=64), np.zeros(64, int), np.bincount(rng.integers(1, 64, 90), minlength=64)):
        how = mixes.plan(histogram, 64)
        rest, rank = np.repeat(np.arange(64), histogram), np.concatenate([np.arange(k) for k in histogram] or [[]])
        if not len(rest):
            assert not how.length and not how.line_windows
            continue
        row, start, length, sequence, offset = packing._pieces(how, rest, rank)
        assert np.array_equal(np.bincount(row, length, len(rest)), rest)
        sums = np.bincount(sequence, length)
        assert len(sums) == how.mixed + how.line_windows and all(x == 64 or x.bit_count() == 1 for x in sums.astype(int).tolist())
        order = np.lexsort((offset, sequence))
        assert np.array_equal(offset[order], np.concatenate([np.cumsum(length[order][sequence[order] == k]) - length[order][sequence[order] == k] for k in range(len(sums))]))
    assert mixes.plan(exact, 64).line < 0.05 * (exact * np.arange(64)).sum()


@pytest.mark.parametrize("counts", [1 << 20, 0])
def test_packing(spark, monkeypatch, counts):
    """Each id lies in one piece, pieces join without gaps, nothing is padded; by broadcast and by Spark's own join."""
    import public_tokenizers as p
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MOST_COUNTS", counts)
    rows = [(k, i, t) for k, (i, t) in enumerate(documents())]
    docs = spark.createDataFrame([(i, t, 0.0, 1, 1, 1, 1, "x", k) for k, i, t in rows], f"doc_id long, text string, {EXTRA}, length long").repartition(3, "length")
    library = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    want = Counter((i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for _, i, t in rows)
    pieces = packing.pack(docs, window=256)
    found = pieces.collect()
    sequences = defaultdict(list)
    by_doc = defaultdict(lambda: defaultdict(list))
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id][r.doc_tokens].append((r.start, tuple(r.token_ids)))
        assert r.length == len(r.token_ids) > 0 and r.ids_crc32 == crc32(np.array(r.token_ids, "<u4").tobytes())
    for x in sequences.values():
        x.sort()
        ends = [a + b for a, b in x]
        assert [a for a, _ in x] == [0, *ends[:-1]] and ends[-1] <= 256 and ends[-1].bit_count() == 1
    tokens = sum(len(ids) * n for (_, ids), n in want.items())
    assert sorted(sequences) == list(range(len(sequences))) and tokens // 256 <= len(sequences) <= tokens // 256 + 8
    for doc, by_size in by_doc.items():
        for size, parts in by_size.items():  # rows that repeat have the same pieces' ids, cut in other places perhaps
            mine = Counter({ids: n for (i, ids), n in want.items() if i == doc and len(ids) == size})
            assert sum(len(x) for _, x in parts) == size * sum(mine.values())
            if sum(mine.values()) == 1:
                assert tuple(x for _, ids in sorted(parts) for x in ids) == next(iter(mine))
    whole = packing.sequences(pieces, 256).collect()
    assert len(whole) == len(sequences) and sum(len(r.token_ids) for r in whole) == tokens
    digest = packing.pack(docs, window=256, with_ids=False)
    assert digest.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and digest.count() == len(found)
    assert packing.packing_digest(docs.limit(0)).count() == 0


def test_words_of_bytes():
    """Splitting in the bytes and looking up by hash gives what the library gives, on any mix of characters."""
    import public_tokenizers as p
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    own = packing.Encoder(p.path("byte_bpe_50k.json"))
    own.table.most = 500  # forgets between batches
    rng = random.Random(3)
    parts = [*"ab zst'mdrevl 's 't're've'll  \n\t\r.!?12²½éÉßЖ日本  \x85\x1c\x1f​-😀", "<|endoftext|>", "  ", "I'll", "'s", "'re x", "''s"]
    for _ in range(8):
        texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(400)] + ["", None, "a" * 3000, " " * 999, "it's", "'sorry he'll"]
        off, ids = own.encode(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_lower_case_words_of_bytes():
    """The same for the tokenizer of the token files: Latin-1 texts by words, others and special marks by chunks."""
    import public_tokenizers as p
    import pyarrow as pa
    from tokenizers import Tokenizer

    from cuelens.llm import tokenfile

    library = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    own = tokenfile.Encoder(p.path("word_bpe_49k.json"))
    own.words.most = own.chunks.most = 300
    rng = random.Random(5)
    latin = [*"ab ZST'MDrevl 's 't're've'll  \n\t\r.!?12²½éÉßÀÞ×÷ÿµª \x85\x1c\x1f", "I'LL", "'re x", "''s"]
    other = [*"ab ZsT'm  \n.!12²½éÉßЖ日本Σς  ​-😀", "<|endoftext|>", "<|startoftext|>", "<|"]
    for parts in (latin, other, latin + other):
        texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(700)] + ["", None]
        off, ids = own.encode(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, off[:-1], off[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_jaccard_of_many_equal_rows(spark):
    """A row that repeats 10,000 times, with near copies: one text is verified, all rows are linked."""
    from cuelens.llm import neardup

    base = [f"w{i}" for i in range(100)]
    rows = [(5, " ".join(base))] * 10_000 + [(None, " ".join(base))] * 50 + [(6, " ".join([*base[:99], "x"])), (7, " ".join([*base[:50], "y", *base[51:]])), (8, "else")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in neardup.jaccard_digest(docs).collect())
    assert got == Counter({(5, 5, 10_051): 10_000, (None, 5, 10_051): 50, (6, 5, 10_051): 1, (7, 5, 10_051): 1, (8, 8, 0): 1})
    assert sorted(r.doc_id or 0 for r in neardup.keep_first(docs).collect()) in ([0, 8], [5, 8])


def test_pipeline_is_its_stages(spark, tmp_path):
    """run() gives what the stages give one after the other, and leaves no table of a stage that was read."""
    import corpus_pipeline

    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(["the", "river", "stone", "opens", "slowly", "under", "old", "bridge", "lamp", "paper"]) + rng.choice(["", "", "s"]) for _ in range(n))
    shared = say(60)
    rows = [(i, say(80) + (" " + shared if i % 5 == 0 else ""), "en", "s", 1) for i in range(40)] + [(100, None, None, None, None), (101, "123", "en", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[3][1]), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    key = lambda r: (r.doc_id, r.text, r.n_chars, tuple(r.token_ids))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(key, got)) == Counter(map(key, docs.collect())) and 3 not in {r.doc_id for r in got} and len(got) > 30


def test_jaccard_ties_only_bands_that_nodes_share(spark, monkeypatch):
    from cuelens.llm import neardup

    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(30)]
    near = texts[3].replace("w3x39", "other")
    docs = spark.createDataFrame([*enumerate([*texts, near])], "doc_id long, text string")
    tied, real = [], neardup.split

    def spy(rows, key, table):
        may, rest = real(rows, key, table)
        if "band" in rows.columns:
            tied.append((rows.count(), may.count()))
        return may, rest

    monkeypatch.setattr(neardup, "split", spy)
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.jaccard_digest(docs).collect()}
    assert got == {i: (i, 0) for i in range(30)} | {3: (3, 1), 30: (3, 1)}
    (every, shared), = tied
    assert every == 31 * neardup.BANDS and 2 <= shared <= 2 * neardup.BANDS + 2
