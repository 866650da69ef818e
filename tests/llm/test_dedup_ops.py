"""Operators 3, 4 and 7 and the pipeline against brute force."""
import collections
import random
import re

import numpy as np
import pytest

WORD = re.compile("[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def near_texts(rng, n, length=40):
    """Texts that are copies of a few with some words changed."""
    voc = [f"w{i}" for i in range(300)]
    base = [[rng.choice(voc) for _ in range(length)] for _ in range(4)]
    passage = [f"p{i}" for i in range(30)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(voc)
        if rng.random() < 0.3:
            w = [rng.choice(voc) for _ in range(60)] + passage + [rng.choice(voc) for _ in range(60)]
        out.append(" ".join(w))
    return out


def components(sets):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("large", [64, 3])
def test_ngram_join(spark, monkeypatch, large):
    from tessera.llm import ngram_join as J
    monkeypatch.setattr(J, "LARGE", large)  # with 3, nearly all goes by blocks
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(large)
    rows = list(enumerate(near_texts(rng, 150))) + [(900, None), (901, " \n"), (902, "one two"), (903, "ONE two"), (904, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    want = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_compares_no_connected_blocks(spark, monkeypatch):
    """A large group of near copies is connected by its first document: no square
    of its blocks is dealt out, and texts beside it are still compared."""
    from tessera.llm import ngram_join as J
    monkeypatch.setattr(J, "LARGE", 8)
    monkeypatch.setattr(J, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    far = base[:26] + [f"z{i}" for i in range(34)]
    rows = [(i, " ".join(base + [f"own{i}"])) for i in range(80)] + [(100 + i, " ".join(far + [f"far{i}"])) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, plain = [], J._large_links

    def spy(open_, *rest):
        dealt.append(open_.select("id").distinct().count())
        return plain(open_, *rest)
    monkeypatch.setattr(J, "_large_links", spy)
    want = components({i: shingles(t) for i, t in rows})
    assert {r.doc_id: r.component_id for r in J.near_duplicates(df).collect()} == want
    assert set(want.values()) == {0, 100} and sum(dealt) <= 3


def test_ngram_join_reads_nothing_for_chance_pairs(spark, monkeypatch):
    """Texts that share a passage with each other text, far from enough to link, are
    no candidates: only the near copy is looked at."""
    from tessera.llm import ngram_join as J
    passage = {(i, j): " ".join(f"p{i}x{j}x{k}" for k in range(30)) for i in range(12) for j in range(i)}
    rows = [(i, " ".join(passage[max(i, j), min(i, j)] for j in range(12) if j != i)) for i in range(12)]
    rows.append((100, rows[3][1].replace("p3x1x7", "other")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    looked_at, plain = [], J._verified

    def spy(source, pairs, *rest):
        looked_at.extend((r.a, r.b) for r in pairs.collect())
        return plain(source, pairs, *rest)
    monkeypatch.setattr(J, "_verified", spy)
    got = {r.doc_id: r.component_id for r in J.near_duplicates(df).collect()}
    assert got == components({i: shingles(t) for i, t in rows}) and got[100] == 3
    assert looked_at == [(3, 100)]


def test_ngram_join_deals_no_chance_buckets(spark, monkeypatch):
    """Texts made of the same frequent lines share large tokens, but too few to
    link: they are not dealt into blocks."""
    from tessera.llm import ngram_join as J
    monkeypatch.setattr(J, "LARGE", 8)
    monkeypatch.setattr(J, "BLOCK", 4)
    rng = random.Random(5)
    lines = [" ".join(f"l{i}x{k}" for k in range(30)) for i in range(40)]
    rows = [(i, "\n".join(rng.sample(lines, 12))) for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    large, dealt, live, plain = [], [], J._live, J._large_links

    def all_large(named, *rest):
        large.append(named.select("id").distinct().count())
        return live(named, *rest)

    def spy(open_, *rest):
        dealt.append(open_.count())
        return plain(open_, *rest)
    monkeypatch.setattr(J, "_live", all_large)
    monkeypatch.setattr(J, "_large_links", spy)
    assert {r.doc_id: r.component_id for r in J.near_duplicates(df).collect()} == components({i: shingles(t) for i, t in rows})
    assert sum(large) > 40 and sum(dealt) == 0


@pytest.mark.parametrize("large", [64, 6, 1])
def test_ngram_join_sizes(spark, monkeypatch, large):
    """Links between texts of sizes as unlike as a link allows, through buckets of any size."""
    from tessera.llm import ngram_join as J
    monkeypatch.setattr(J, "LARGE", large)
    monkeypatch.setattr(J, "BLOCK", 4)
    rng = random.Random(large)
    base = [[f"b{b}x{k}" for k in range(n)] for b, n in enumerate((9, 24, 60, 110))]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        lo, cut = rng.randint(0, 2), rng.randint(0, len(w) // 4)
        w = w[lo:len(w) - cut] + [f"own{i}x{k}" for k in range(rng.choice((0, 0, 1, len(w) // 9)))]
        if rng.random() < 0.2:
            w[rng.randrange(len(w))] = "other"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.near_duplicates(df).collect()}
    assert got == components({i: shingles(t) for i, t in rows})


def test_stored_leaves_no_shuffle_files(spark):
    """The shuffle files of a table go once it is written."""
    import time

    from tessera.llm.common import stored
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles().iterator()
        out = set()
        while found.hasNext():
            out.add(found.next().getName())
        return {x for x in out if x.startswith("shuffle_") and x.endswith(".data")}
    before = files()
    out = stored(spark.range(2000).repartition(3, "id").groupBy("id").count())
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 2000 and out.groupBy("count").count().collect()[0][1] == 2000


def test_ngram_join_edges(docs, nothing):
    from tessera.llm.ngram_join import near_duplicates
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    got = {r.doc_id: r.component_id for r in rows}
    assert got[1] == got[2] == got[8] == 1 and got[3] == 3 and got[4] == 4 and got[5] == 5
    assert near_duplicates(nothing).count() == 0


def test_line_dedup_hashes_each_word_once(spark, monkeypatch):
    """Shingles come from the hashes of the words, not from slices of the words."""
    from tessera.llm import line_dedup as L
    plans, plain = [], L.stored
    monkeypatch.setattr(L, "stored", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df))[1])
    rows = [(1, "One two\tthree  four five six\nx"), (2, "one two three four FIVE\x0bsix"), (3, "one two three four five seven eight"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.id, r.line) for r in L.duplicate_lines(df).collect()] == [(2, 0)]
    made = [p for p in plans if "xxhash64" in p and "transform" in p]
    assert made and not any("xxhash64(slice(" in p for p in made)


def brute_lines(rows):
    """(id, line) that match an earlier line."""
    lines = [(i, k, shingles(x)) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n")) if len(WORD.findall(x)) >= 5]
    return {(i, k) for n, (i, k, s) in enumerate(lines) if any(linked(s, o) for _, _, o in lines[:n])}


@pytest.mark.parametrize("frequent", [32, 2])
def test_line_dedup(spark, frequent):
    from tessera.llm.line_dedup import dedup_lines, duplicate_lines
    rng = random.Random(frequent)
    pool = near_texts(rng, 60, 25) + ["short line", "a b c d e", "A b  c d e", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_lines([r for r in rows if r[1]])
    got = {(r.id, r.line) for r in duplicate_lines(df, frequent=frequent).collect()}
    assert got == want
    out = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(df, frequent=frequent).collect()}
    for i, t in rows:
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want)
        assert out[i] == (left, sum(1 for j, _ in want if j == i))


def test_line_dedup_makes_no_set_twice_for_the_order(spark, monkeypatch):
    """Lines whose tokens were counted are not read and cut again to be ordered by them."""
    from tessera.llm import line_dedup as L
    made, own = [], L._sets

    def sets(docs, at, size):
        out = own(docs, at, size)
        made.append({r["at"] for r in out.select("at").collect()})
        return out

    monkeypatch.setattr(L, "_sets", sets)
    pool = near_texts(random.Random(2), 60, 25)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pool)], "doc_id long, text string")
    got = {(r.id, r.line) for r in L.duplicate_lines(df, frequent=2).collect()}
    assert got == brute_lines(enumerate(pool))
    assert made[0] and not made[0] & made[1]


def test_line_dedup_edges(docs, nothing):
    from tessera.llm.line_dedup import dedup_lines
    out = dedup_lines(docs.withColumnRenamed("n_tokens", "line")).collect()
    assert len(out) == docs.count()
    text = {r.doc_id: r.text for r in out}
    assert text[2] == "" and text[8] == "" and text[3] is None and text[4] == "" and text[5] == " \n\t "
    assert dedup_lines(nothing).count() == 0


def test_line_dedup_tells_rows_apart(spark):
    """Rows without an id, or of one id, lose their own lines only."""
    from tessera.llm.line_dedup import dedup_lines
    new = [f"n{k} is a line that no other text holds {k}" for k in range(9)]
    seen = " ".join(f"s{i}" for i in range(30))
    near = seen.replace("s29", "other")
    rows = [(None, "\n".join(new[:3])), (None, "\n".join([new[3], new[4], seen])), (None, "\n".join([new[5], new[4], seen])),
            (5, "\n".join([new[6], near])), (6, "\n".join([new[7], seen])), (6, "\n".join([new[7] + " more words here now", new[8]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = dedup_lines(df).collect()
    texts = [r.text for r in got]
    assert len(texts) == 6 and "\n".join(new[:3]) in texts and rows[5][1] in texts
    lines = collections.Counter(x for t in texts for x in t.split("\n"))
    assert all(lines[x] == 1 for x in new[:7] + [seen]) and lines[near] == 0
    assert sum(r.n_removed for r in got) == 4


def test_outlier_counts(spark, docs, nothing):
    from tessera.llm.outliers import verdicts
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice("a b c## dé ef|").strip() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 9)))
             for _ in range(80)] + ["x y z " * 400, "l1 l2\nl1 l2\n \n \nl1 l2", " ".join(f"a{i % 90} b{i % 90} c" for i in range(400))]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in verdicts(df).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        tri = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        times = collections.Counter(tri)
        covered = {k + j for k, x in enumerate(tri) if times[x] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    rows = verdicts(docs).collect()
    assert len(rows) == docs.count() and not any(r.kept for r in rows if r.doc_id in (3, 4, 5))
    assert verdicts(nothing).count() == 0


def test_outliers_see_repetition(spark):
    """In a clean source, texts with 40 % repeated lines or 40 % of the words
    in repeated windows are rejected, and next to no others."""
    from tessera.llm.outliers import verdicts
    rng = random.Random(12)

    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    rows = [(i, "\n".join(" ".join(words(20)) for _ in range(10))) for i in range(200)]
    rows.append((900, "\n".join([" ".join(words(30)) for _ in range(6)] + ["one two"] * 5)))  # lines too short for much of the words
    again = " ".join(words(20))
    rows.append((901, "\n".join([" ".join(words(20)) + f" {again} " + " ".join(words(10)) for _ in range(2)])))  # windows, no line
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source")
    got = {r.doc_id: r for r in verdicts(df).collect()}
    assert got[900].n_dup_lines == 4 and 100 * got[900].n_repeat_words < 10 * got[900].n_words
    assert got[901].n_dup_lines == 0 and got[901].n_repeat_words == 40 and got[901].n_words == 100
    assert not any(got[i].kept or got[i].base_failed for i in (900, 901))
    assert sum(got[i].kept for i in range(200)) >= 196


def test_outliers_by_group(spark):
    """Per language and source: concentration steps as in a plain version, and
    rows far off their own group rejected."""
    from tessera.llm import outliers as O
    rng = np.random.default_rng(10)
    rows, point = [], {}
    for g, (shift, n) in enumerate([(0.0, 400), (1.0, 150)]):
        x = rng.normal(shift, [0.1, 0.2, 0.3, 0.2], (n, 4))
        x[: n // 10] += 5
        point[str(g)] = x
        rows += [(str(g), *map(float, v)) for v in x]
    est = {r.g: r for r in O.estimates(spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, x4 double")).collect()}
    for g, x in point.items():
        clean = x[len(x) // 10:]
        m = np.array([est[g][f"m{k + 1}"] for k in range(4)])
        assert np.all(np.abs(m - clean.mean(axis=0)) < 0.1)
        low = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                low[i, j] = est[g][f"l{i + 1}{j + 1}"]
        # The fixed point: re-estimating from the nearest part changes little.
        d = (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0)
        near = x[np.argsort(d)[: int(np.ceil(O.COVERED * len(x)))]]
        assert np.allclose(near.mean(axis=0), m, atol=0.05)
        assert np.allclose(np.cov(near.T, bias=True) + np.diag(O.FLOOR), low @ low.T, atol=0.03)
        assert d[: len(x) // 10].min() > d[len(x) // 10:].max()


def test_stages_remove_rows_without_id(spark):
    """Letterless and benchmark-holding rows without an id go, clean ones stay."""
    import corpus_pipeline as C
    sf = "/root/testdata/sf0.001"
    src = spark.read.parquet(f"{sf}/documents.parquet")
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").where("text IS NOT NULL").collect()), key=len)
    clean = src.where("length(text) > 300").first().text
    rows = [(None, t, "en", "x", len(t)) for t in ("12 34 !!", clean, clean + " " + item)] + [(990001, "12 34 !!", "en", "x", 8), (990001, clean, "en", "x", 9)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = src.select(*more.columns).unionByName(more)
    left = C.language_id(spark, docs, sf).where("doc_id IS NULL OR doc_id = 990001").collect()
    assert "12 34 !!" not in {r.text for r in left} and (990001, clean) in {(r.doc_id, r.text) for r in left}
    left = {(r.doc_id, r.text) for r in C.remove_benchmark(spark, more, sf).collect()}
    assert (None, rows[2][1]) not in left and {(None, "12 34 !!"), (990001, "12 34 !!")} <= left


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = src.withColumn("extra", src.doc_id).unionByName(src.limit(3).withColumn("extra", src.doc_id)).unionByName(
        spark.createDataFrame([(990001, None, None, None, None, 1), (990002, "", "en", "x", 0, 1)],
                              "doc_id long, text string, lang string, source string, n_chars long, extra long"))
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == before.columns
        assert 0 < docs.count() <= before.count()
        if k == 0:
            assert docs.where("doc_id > 990000").count() == 0
    assert docs.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    empty = src.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_oracles(spark):
    """Queries with SQL against DuckDB on the whole small tables."""
    import duckdb

    from tessera.llm import oracle, queries
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in oracle.ORACLE.items():
        got = queries.QUERIES[name](spark, sf)
        cols = sorted(got.columns)
        want = con.sql(sql)
        assert sorted(want.columns) == cols
        assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want.select(", ".join(cols)).fetchall(), key=str)
