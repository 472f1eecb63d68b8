"""Each operator against brute force on a small fixture, with the awkward cases all operators must take."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words long, node string, spans string, label int"


def corpus():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(60), say(120)
    rows = [say(rng.randrange(5, 150)) for _ in range(30)]
    rows += [say(30) + "\n" + passage + " " + say(20), passage, say(10) + "  \t" + passage, passage + "\n" + passage]
    near = base.split()
    rows += [base, base, " ".join([*near[:60], "changed", *near[61:]]), " ".join([*near[:119], "x"]), base.replace(" ", "\n")]
    rows += ["", None, " \n\t", "one two", "one two", "### *** $$$", "A.B! c? d e", say(4000), "é" * 3000, "日本語 テキスト 1 2 3", "<|endoftext|> it's IT'S"]
    ids = list(range(len(rows)))
    out = [(i, t, "en" if i % 2 else "fr", f"src{i % 3}", 1, 0.5, 3, "n", "s", 1) for i, t in zip(ids, rows, strict=True)]
    out += [out[36], (None, "null id " + passage, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def result(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def test_decontamination(spark, docs, rows, empty):
    from cuelens.llm import decontaminate as d

    texts = {r[0]: r[1] for r in rows}
    bench = [(1, texts[31]), (2, "one TWO"), (3, ""), (4, None), (5, texts[0] or ""), (5, texts[0]), (10, texts[31]), (None, "null id")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = defaultdict(set)
    for i, t in bench:
        w = words(t)
        for k in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            grams[tuple(w[k : k + min(13, len(w))])].add(i)
    want = Counter()
    for r in rows:
        w, hit, items = words(r[1]), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    hit.update(range(k, k + size))
                    items |= grams[g] - {None}
        names = ",".join(sorted(map(str, items)))
        want[(r[0], len(w), len(hit), len(items), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    got = d.decontamination_digest(docs, table)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert result(got, *columns) == want
    assert d.decontamination_digest(empty, table).count() == 0
    assert all(n[2] == 0 for n in result(d.decontamination_digest(docs, table.limit(0)), *columns))
    kept = d.remove(docs, table)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    for r in d.hits(docs, table).collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_hit


def test_decontamination_has_no_python(docs, spark):
    from cuelens.llm.decontaminate import decontamination_digest

    plan = decontamination_digest(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


def test_bpe(spark, docs, rows, empty):
    import public_tokenizers as p
    import tiktoken

    from cuelens.llm import bpe

    ranks = bpe.read_ranks(p.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert result(bpe.bpe_digest(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert bpe.bpe_digest(empty).count() == 0
    full = bpe.encode(docs)
    assert full.columns == [*docs.columns, "token_ids", "decoded"]
    assert full.where("decoded <> cast(coalesce(text, '') as binary)").count() == 0


def test_bpe_folds_agree(rows):
    import public_tokenizers as p

    from cuelens.llm import bpe

    merges = bpe.encoder(p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN).merges
    rng = random.Random(2)
    words = [bytes(rng.choice(b"abnt\xc3\xa9 e1") for _ in range(rng.randrange(1, 33))) for _ in range(500)]
    assert merges.fold(words) == [(merges.ranks[w],) if w in merges.ranks else merges.long(w) for w in words]


def removed(rows, width):
    words = [re.findall(SPACE, r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    return [(w, {j for i in range(len(w) - width + 1) if count[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}) for w in words]


def test_substring_dedup(docs, rows, empty):
    from cuelens.llm import substring

    want, texts = Counter(), Counter()
    for r, (w, gone) in zip(rows, removed(rows, 35), strict=True):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
        texts[(r[0], kept if gone else r[1])] += 1
    assert result(substring.substring_digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    out = substring.dedup_substrings(docs)
    assert out.columns == docs.columns and result(out, "doc_id", "text") == texts
    assert substring.substring_digest(empty).count() == 0 and substring.dedup_substrings(empty).count() == 0


def test_lm(spark, docs, rows, empty):
    from cuelens.llm import lm

    words = [re.findall(SPACE, lower(r[1])) for r in rows]
    held = [r[0] is None or zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    count = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    ends = held.count(False)
    n, v = sum(count.values()) + ends, len(count) + 1
    log = lambda c: math.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    got = lm.lm_digest(docs).collect()
    key = lambda r: (r[0] is None, r[0], *map(str, r[1:4]))
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(((r[0], h, len(w) + 1, sum(count[x] > 0 for x in w) + 1, n, sum(map(log, (count[x] for x in w))) + log(ends)) for r, h, w in zip(rows, held, words, strict=True)), key=key)
    for a, b in zip(have, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.lm_digest(empty).count() == 0


def test_lattice_sums_all_segmentations():
    from cuelens.llm.lattice import Lattice, Pieces

    pieces = Pieces({b" a": 3.0, b"ab": 2.0, b"b": 1.0, b" ab": 1.0})
    log_p = np.log(pieces.weight / pieces.weight.sum())

    def paths(x):
        return sum(math.exp(log_p[pieces.ids[x[:k]]]) * paths(x[k:]) for k in range(1, len(x) + 1) if x[:k] in pieces.ids) if x else 1.0

    words = [b"a", b"ab", b"abab", b"b", b"zq", b"ab" * 40]
    got = Lattice(pieces, log_p).log_words(words)
    for w, x in list(zip(words, got, strict=True))[:5]:
        assert x == pytest.approx(math.log(paths(b" " + w)))
    counts = np.ones(len(words))
    use = Lattice(pieces, log_p).expected(words, counts)
    assert (use * [len(n) for n in pieces.names]).sum() == pytest.approx(sum(len(w) + 1 for w in words))


def test_toxicity(spark, docs, empty):
    from cuelens.llm import toxicity

    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts, marks = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(6)] += " " + rng.choice(["vileword", "nastyone"])
        texts.append((i, ". ".join(sentences) + "."))
        marks.append((i, int(bad)))
    many = spark.createDataFrame([*texts, (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_digest(many, labels).collect()
    right = [r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.held_out]
    assert len(right) > 80 and sum(right) / len(right) > 0.97
    assert len(got) == 601 and all(0 <= r.score <= 1 for r in got)
    model = toxicity.fit(many, labels.withColumnRenamed("toxic", "label").where("doc_id is not null and label is not null"))
    text = "all is well here. you vileword you! fine."
    found = toxicity.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"]).first()
    assert [text[s.start : s.end] for s in found.offending] == ["you vileword you"]
    nothing = toxicity.toxicity_digest(docs, labels.limit(0)).collect()
    assert {r.predicted for r in nothing} == {0} and toxicity.toxicity_digest(empty, labels).count() == 0


def test_language_id(spark, docs, rows, empty):
    from cuelens.llm import langid

    rng = random.Random(6)
    alphabets = {"aa": "abcde ", "bb": "cdefgé ", "cc": "xyzabc "}
    many = [(i, "".join(rng.choice(alphabets[x]) for _ in range(60)), x) for i in range(300) for x in [list(alphabets)[i % 3]]]
    odd = [(900, None, "aa"), (901, "12 .. 3", "bb"), (902, "", None), (None, "abc abd", None)]
    df = spark.createDataFrame(many + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_digest(df).collect()}
    assert all(got[i].lang_pred == x for i, _, x in many)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.language_digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_digest(empty).count() == 0


def test_language_stage_drops_other_languages(spark):
    from cuelens.llm import stages

    rng = random.Random(8)
    en, de = "the of and that with this from have people nation market".split(), "der die und nicht eine mit auf wird volk markt".split()
    many = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(40)), "en" if i % 2 else "de") for i in range(60)]
    new = [(100, " ".join(rng.choice(en) for _ in range(40)), None), (101, "a", None), (102, "the", None)]
    odd = [(200, "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι", None), (201, "人人生而自由，在尊严和权利上一律平等。", None), (202, "xqzj vkqp jxwz qqzk vjxq", None), (203, "12 ..", None), (204, None, "en")]
    df = spark.createDataFrame(many + new + odd, "doc_id long, text string, lang string")
    out = stages.drop_unknown_language(spark, df, "")
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {*range(60), 100, 101, 102}
    bare = stages.drop_unknown_language(spark, df.withColumn("lang", F.lit(None).cast("string")), "")
    assert {r.doc_id for r in bare.collect()} == {*range(60), 100, 101, 102, 200, 201, 202}


def test_warc(spark, empty):
    from cuelens.llm import warc

    big, huge = "x<é>" * 400, "payload \r\n\r\nWARC/1.1\r\n" * 9000
    pages = [(1, "http://a/", big), (2, "http://b/\r\nX: y", big), (3, None, None), (4, "u", ""), (5, "u", huge), (6, "v", huge), (7, "w", "small"), (8, "w", "small"), (None, "n", big), (9, "z", "0\r\n\r\n"), (9, "z", "0\r\n\r\n")]
    df = spark.createDataFrame([(*p, 1, "s") for p in pages], "page_id long, url string, html string, bytes int, digest string")
    first = {big: 2, huge: 6}
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        other = first.get(h) if first.get(h) != i else None
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if other else "response", other)] += 1
    got = warc.warc_digest(df)
    assert result(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.warc_digest(df.limit(0)).count() == 0
    assert warc.unchunked(b"5;x=1\r\nhello\r\n0\r\nT: 1\r\n\r\n") == b"hello"
    for broken in (b"5\r\nhel", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_jaccard_join(docs, rows, empty):
    from cuelens.llm import neardup

    sets = []
    for r in rows:
        w = re.findall(SPACE, r[1] or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    n = len(rows)
    link = [[i != j and bool(sets[i] & sets[j]) and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in range(n) if link[i][j])]) for i in range(n)]
    of = lambda k: [rows[i][0] for i in range(n) if root[i] == k and rows[i][0] is not None]
    want = Counter((r[0], min(of(root[i]), default=None), sum(link[i])) for i, r in enumerate(rows))
    assert result(neardup.jaccard_digest(docs), "doc_id", "class_id", "n_links") == want
    assert neardup.jaccard_digest(empty).count() == 0
    kept = neardup.keep_first(docs)
    wordless = sum(not s for s in sets)
    assert kept.columns == docs.columns and kept.count() == len({root[i] for i in range(n) if sets[i]}) + wordless


def test_jaccard_blocks_lose_no_link(spark, monkeypatch):
    from cuelens.llm import neardup

    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(60)] = f"z{i}"
        texts.append((i, " ".join(w[: rng.randrange(50, 61)])))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    plain = result(neardup.jaccard_digest(df), "doc_id", "class_id", "n_links")
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(neardup, "BLOCK_NODES", 7)
    assert result(neardup.jaccard_digest(df), "doc_id", "class_id", "n_links") == plain
    assert max(k[2] for k in plain) > 5


def test_jaccard_empty_blocks_count_no_link_twice(spark, monkeypatch):
    from cuelens.llm import neardup

    texts = []
    for c in range(12):
        w = [f"c{c}w{i}" for i in range(60)]
        texts += [w, [*w[:-1], "x"], w[:50], [*w[:49], "y"]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    want = Counter((i, i // 4 * 4, sum(i != j and 9 * len(a & b) >= 4 * (len(a) + len(b)) for j, b in enumerate(sets))) for i, a in enumerate(sets))
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 60)  # two nodes and two blocks at each of two levels
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert result(neardup.jaccard_digest(df), "doc_id", "class_id", "n_links") == want


def test_quality(spark, docs, rows, empty):
    from cuelens.llm import quality

    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = re.findall(SPACE, t)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(SPACE, line):
                dup += line in seen
                seen.add(line)
        want[(r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))] += 1
    marks = spark.createDataFrame([(i, i % 2, 1) for i in range(30)] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, score int")
    got = quality.quality_digest(docs, marks)
    assert result(got, "doc_id", *quality.COUNTS, "base_failed") == want
    assert got.where("kept and base_failed").count() == 0
    assert quality.quality_digest(docs, marks.limit(0)).where("kept = base_failed").count() == 0
    assert quality.quality_digest(empty, marks).count() == 0


def test_trees_are_monotonic_and_learn():
    from cuelens.llm.quality import fit_trees

    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.1 * rng.standard_normal(2000) < 0.5).astype(float)
    trees = fit_trees(x, y, [-1, 0, 0])
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    grid = np.tile(rng.random((50, 1, 3)), (1, 40, 1))
    grid[:, :, 0] = np.linspace(0, 1, 40)
    scores = trees.margin(grid.reshape(-1, 3)).reshape(50, 40)
    assert (np.diff(scores, axis=1) <= 1e-12).all()


def test_token_files(spark, docs, rows, empty, tmp_path):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    from cuelens.llm import tokenfile

    library = Tokenizer.from_file(p.path("word_bpe_49k.json"))
    start, want = 0, Counter()
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[(r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    assert result(tokenfile.token_digest(docs), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert tokenfile.token_digest(empty).count() == 0
    path = str(tmp_path / "t")
    tokenfile.write_tokens(docs, path)
    some = tokenfile.read_tokens(spark, path).where("doc_id = 7")
    assert some.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in some._jdf.queryExecution().toString()
    import glob

    import pyarrow.parquet as pq

    meta = [pq.ParquetFile(f).metadata for f in glob.glob(path + "/*.parquet")]
    column = next(m for m in meta if m.num_rows).row_group(0).column(4)
    assert column.has_column_index and column.has_offset_index and any("DICTIONARY" in e for e in column.encodings)


def test_components(spark):
    from cuelens.llm.components import components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(rng.randrange(100, 130), rng.randrange(100, 130)) for _ in range(25)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {(x, r) for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert set(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline(spark, docs, rows, empty, tmp_path):
    import corpus_pipeline
    from cuelens.llm.decontaminate import decontamination_digest

    spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = out.collect()
    ids = {r.doc_id for r in got}
    assert 3 not in ids and 0 in ids and len(got) < len(rows)
    assert not {40, 44} & ids  # no letter
    assert all(bytes(r.decoded).decode() == r.text for r in got)
    assert decontamination_digest(out, spark.read.parquet(str(tmp_path / "benchmark.parquet"))).where("contaminated").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_every_query_is_registered():
    from cuelens.llm.queries import ORACLE_SQL, QUERIES

    assert [next(q for q in QUERIES if q.startswith(f"op{n}_")) for n in range(1, 11)] and set(ORACLE_SQL) <= set(QUERIES)
    json.dumps(ORACLE_SQL)


def brute_links(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in texts]
    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].add(i)
    return [{j for g in s for j in holders[g] if j != i and 9 * len(s & sets[j]) >= 4 * (len(s) + len(sets[j]))} for i, s in enumerate(sets)]


def test_jaccard_chain_is_judged_by_buckets(spark, monkeypatch):
    """A chain whose ends have nothing in common: its pairs meet in buckets, each once, and none is lost."""
    from cuelens.llm import neardup

    words = [f"w{i}" for i in range(4000)]
    texts = [words[3 * i : 3 * i + 60] for i in range(600)]
    links = brute_links(texts)
    assert all(i + 1 in links[i] for i in range(599))
    want = Counter((i, 0, len(links[i])) for i in range(len(texts)))
    monkeypatch.setattr(neardup, "BLOCK_NODES", 20)
    seen = []
    real = neardup._tasks
    monkeypatch.setattr(neardup, "_tasks", lambda *a: (found := real(*a), seen.append(found[0].where("task like 'b-%'").count()))[0])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert result(neardup.jaccard_digest(df), "doc_id", "class_id", "n_links") == want
    assert seen[0] > 0


def test_minhash_recall(spark):
    """Random near copies around the threshold: at least 99 in 100 of the links brute force finds."""
    from cuelens.llm import neardup

    rng = random.Random(12)
    texts = []
    for c in range(150):
        base = [f"c{c}x{rng.randrange(10**6)}" for _ in range(rng.randrange(40, 160))]
        for _ in range(4):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**9)}"
            texts.append(w)
    want = sum(map(len, brute_links(texts)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = neardup.jaccard_digest(df).agg(F.sum("n_links")).first()[0]
    assert want > 500 and 0.99 * want <= got <= want


def test_substring_records_follow_windows(spark, monkeypatch):
    """At a forced small bucket, twice the input sends about twice the records, and the result is the same."""
    from cuelens.llm import substring

    rng = random.Random(3)
    say = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    passage = say(60)
    texts = [(i, say(200) + (" " + passage if i % 7 == 0 else "")) for i in range(240)]
    sent = []
    monkeypatch.setattr(substring, "grown", lambda *a: 2000)
    for n in (120, 240):
        monkeypatch.setattr(substring, "parts_for", lambda *a, n=n, **k: 50 * n)
        df = spark.createDataFrame(texts[:n], "doc_id long, text string").repartition(4)
        keyed = substring._keyed(df)
        sent.append(keyed.mapInArrow(substring._send(35, 50 * n, 4000), substring._SENT).count())
        want = Counter((r[0], len(gone)) for r, (w, gone) in zip(texts[:n], removed(texts[:n], 35), strict=True))
        assert result(substring.substring_digest(df), "doc_id", "n_removed") == want
    assert sent[1] < 2.2 * sent[0]


def test_steady_stores_what_a_shuffle_gives(spark, docs, tmp_path):
    from cuelens.llm.session import steady

    df = spark.range(10)
    assert steady(df) is df
    df.write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t")).where("id > 2").select((F.col("id") + 1).alias("x"))
    assert steady(read) is read
    assert steady(df.repartition(3)) is not df and steady(df.groupBy("id").count()).count() == 10


def test_bit_split_loses_nothing(spark):
    from cuelens.llm.bits import bit_table, split

    df = spark.range(5000).select("id", F.col("id").alias("_row"), F.xxhash64("id").alias("_words"))
    some = df.where("id % 10 = 3")
    may, rest = split(df, F.xxhash64("id"), bit_table(F.xxhash64("id"), some))
    got = {r.id for r in may.collect()}
    assert {i for i in range(5000) if i % 10 == 3} <= got and len(got) < 600
    assert may.columns == df.columns and got | {r.id for r in rest.collect()} == set(range(5000)) and rest.count() == 5000 - len(got)


@pytest.mark.parametrize(("least_bits", "most_bits", "bytes_"), [(64, 64, 64 << 20), (1 << 12, 1 << 26, 0)])
def test_decontamination_at_small_bounds(spark, docs, rows, monkeypatch, least_bits, most_bits, bytes_):
    from cuelens.llm import decontaminate as d

    table = spark.createDataFrame([(1, rows[31][1]), (2, rows[0][1]), (3, "one two"), (4, rows[43][1])], "item_id long, text string")
    want = result(d.decontamination_digest(docs, table), "doc_id", "n_words", "n_hit", "items_sha256")
    for name, value in (("LEAST_BITS", least_bits), ("MOST_BITS", most_bits), ("BROADCAST_BYTES", bytes_)):
        monkeypatch.setattr(d, name, value)
    assert result(d.decontamination_digest(docs, table), "doc_id", "n_words", "n_hit", "items_sha256") == want


def test_lm_score_is_the_sum_over_all_segmentations(spark):
    """The whole score by hand on a small corpus: interpolation, discount, and each word's segmentations one by one."""
    import public_tokenizers

    from cuelens.llm import lattice, lm

    texts = ["ab ab cat", "cat ab dog dog dog", "abc dog", "Cat", "newword ab", "", None]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10][: len(texts) - 2] + [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = lattice.load_pieces(path)
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in ids]
    words = [re.findall(SPACE, lower(t)) for t in texts]
    count = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)

    def cuts(x):
        return [[x[:k], *rest] for k in range(1, len(x) + 1) if x[:k] in pieces.ids for rest in cuts(x[k:])] if x else [[]]

    p = pieces.weight / pieces.weight.sum()
    for _ in range(lm.EM_ROUNDS):
        use = np.zeros(len(p))
        for w in count:
            every = [[pieces.ids[x] for x in c] for c in cuts(b" " + w.encode())]
            weight = [math.prod(p[i] for i in c) for c in every]
            for c, x in zip(every, weight, strict=True):
                for i in c:
                    use[i] += x / sum(weight)
        p = (use + lm.SMOOTHING) / (use.sum() + lm.SMOOTHING * len(p))
    ends = held.count(False)
    n = sum(count.values()) + ends
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    free = discount * len(count) / n

    def score(w):
        spelled = sum(math.prod(p[pieces.ids[x]] for x in c) for c in cuts(b" " + w.encode()))
        return math.log10(max(0.0, count[w] - discount) / n + free * spelled)

    got = {r.doc_id: r.score for r in lm.lm_digest(df).collect()}
    for i, ws in zip(ids, words, strict=True):
        assert got[i] == pytest.approx(sum(map(score, ws)) + math.log10(ends / n), rel=1e-9)


def test_noisy_or_and_its_gradient():
    """A document's score is 1 minus the product over its sentences; training descends the likelihood's own gradient."""
    import pyarrow as pa

    from cuelens.llm import toxicity as t

    rng = np.random.default_rng(3)
    s = t.Sentences(pa.array(["aa bb. cc dd! ee", "", None, "ff aa", "... !"]))
    weights = np.zeros(t.BUCKETS)
    weights[np.unique(s.feature)] = rng.normal(size=len(np.unique(s.feature)))
    model = t.Model(weights, -0.3)
    p = model.sentences(s)
    for i in range(s.n):
        z = sum(float(np.float32(weights[f])) for f, k in zip(s.feature, s.sentence, strict=True) if k == i) - 0.3
        assert p[i] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)
    want = [1 - math.prod(1 - p[i] for i in range(s.n) if s.owner[i] == d) for d in range(s.n_docs)]
    assert model.documents(s, p) == pytest.approx(want) and want[1] == want[2] == want[4] == 0

    owner, label = np.array([0, 0, 1, 2, 2, 2]), np.array([1, 0, 1])
    z0 = rng.normal(size=6)

    def loss(z):
        q = 1 / (1 + np.exp(-z))
        none = np.array([np.prod(1 - q[owner == d]) for d in range(3)])
        return -np.sum(np.where(label > 0, np.log(1 - none), np.log(none)))

    q = 1 / (1 + np.exp(-z0))
    none = np.array([np.prod(1 - q[owner == d]) for d in range(3)])
    pull = np.where(label > 0, none / (1 - none), -1.0)
    by_formula = -pull[owner] * q
    by_steps = [(loss(z0 + 1e-6 * e) - loss(z0 - 1e-6 * e)) / 2e-6 for e in np.eye(6)]
    assert by_formula == pytest.approx(by_steps, rel=1e-4)


def test_language_posterior_by_hand(spark, monkeypatch):
    """From counts to the posterior in plain Python, and the same however few numbers are looked up at once."""
    import pyarrow as pa

    from cuelens.llm import langid

    train = [("abc ab", "x"), ("bcd bc d", "y"), ("abd", "y"), ("zz é", "z")]
    ask = ["abc", "bc d", "é zz", "q", "", None, "ab " * 40]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    counts = {lang: Counter() for lang in "xyz"}

    def buckets(text):
        return [int(b) for found, _ in langid.grams(langid.Texts(pa.array([text], pa.string())))[0] for b in found]

    for text, lang in train:
        counts[lang].update(buckets(text))
    prior = Counter(lang for _, lang in train)

    def posterior(text):
        logs = []
        for lang in "xyz":
            total = sum(counts[lang].values()) + langid.SMOOTHING * langid.BUCKETS
            logs.append(math.log(prior[lang] / 4) + sum(math.log((counts[lang][b] + langid.SMOOTHING) / total) for b in buckets(text)))
        top = max(logs)
        return "xyz"[logs.index(top)], 1 / sum(math.exp(v - top) for v in logs)

    for room in (1 << 22, 5):
        monkeypatch.setattr(langid, "GATHERED", room)
        langs, scores, _ = model.predict(pa.array(ask, pa.string()))
        for text, lang, score in zip(ask, langs, scores, strict=True):
            if text:
                assert (lang, score) == (posterior(text)[0], pytest.approx(posterior(text)[1], rel=1e-4))
            else:
                assert (lang, score) == ("und", 0)


def test_language_id_of_many_languages(spark):
    from cuelens.llm import langid

    rng = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(800)]
    rows = [(i, "".join(rng.choice(letters[4 * (i % 200) : 4 * (i % 200) + 4]) for _ in range(40)), f"l{i % 200:03d}") for i in range(2400)]
    got = langid.language_digest(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == f"l{r.doc_id % 200:03d}" for r in got)


def test_warc_edges_and_file_sizes(spark, tmp_path, monkeypatch):
    """Characters of several bytes across segment edges, and files that stay small when pages are large."""
    import glob
    import os

    from cuelens.llm import warc

    pages = [(i, "u", "é日😀" * n) for i, n in enumerate((1, 900, 3641, 3642, 7283, 40_000, 90_000))] + [(50 + i, "v", f"{i} " * 30) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "ROW_BYTES", 100_000)
    monkeypatch.setattr(warc, "FILE_ROWS", 2)
    warc.write_warc(df, str(tmp_path / "w"))
    import gzip

    files = [gzip.open(f).read() for f in glob.glob(str(tmp_path / "w") + "/part-*")]
    assert len(files) > 4 and max(map(len, files)) < 400_000 and os.path.isdir(tmp_path / "w")
    got = {(r.page_id, r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {(i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in pages}


def test_repeated_ids_teach_once(spark):
    from cuelens.llm import quality, toxicity

    texts = [(i, f"fine words {i} here. more of them.") for i in range(40)] + [(1, "vileword one")] * 500
    df = spark.createDataFrame(texts, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i < 5)) for i in range(40)], "doc_id long, label int")
    assert toxicity.fit(df, marks) is not None and quality.fit(df, marks) is not None
    both = toxicity.score_toxicity(df.withColumn("score", F.lit(1)), toxicity.fit(df, marks), ["doc_id", "score"])
    assert both.columns == ["doc_id", "score", "offending"] and both.count() == 540
    judged = quality.judge(df.withColumn("kept", F.lit(1)), None, ["doc_id", "kept"])
    assert judged.columns.count("kept") == 1


def test_token_files_of_one_hot_id(spark, tmp_path, monkeypatch):
    from cuelens.llm import tokenfile

    rows = [(7, f"text {i % 50}") for i in range(900)] + [(i, "other") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(tokenfile, "parts_for", lambda *a, **k: 8)
    path = str(tmp_path / "t")
    tokenfile.write_tokens(df, path)
    sizes = [r["count"] for r in tokenfile.read_tokens(spark, path).groupBy("part").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 400
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.token_digest(df).collect())
    assert [d for _, d, _ in got] == sorted(d for d, _ in rows)
    assert all(a + n == b for (a, _, n), (b, _, _) in zip(got[:-1], got[1:], strict=True))


def test_stage_keeps_clashing_columns(spark):
    from cuelens.llm import stages

    df = spark.createDataFrame([(i, "the of and that with", "en", 1, "x") for i in range(20)], "doc_id long, text string, lang string, _lang_pred int, c0 string")
    out = stages.drop_unknown_language(spark, df, "")
    assert out.columns == df.columns and out.count() == 20
    out = stages.keep_one_near_duplicate(spark, df.withColumnsRenamed({"c0": "_row", "_lang_pred": "row"}), "")
    assert out.columns == ["doc_id", "text", "lang", "row", "_row"] and out.count() == 1
