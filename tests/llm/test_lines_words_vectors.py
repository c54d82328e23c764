"""Line dedup, spelling variants and whitening against plain versions, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from brute import LOW
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspan.llm import line_dedup, spelling, whitening

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lines string, doc long, gone string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, repeated rows and ids, rows without an id, clashing columns, a line that most documents hold."""
    r = random.Random(3)
    common = ["A Line Held By Most of All", "the   second line ", "\tthird LINE of it\r", "short", "Ärger über ÄÄÄ", "ärger über äää", "x" * 9, "日本語日本語日本語日", "日本語日本語日本語"]
    texts = [None, "", "\n\n", "   \n", "no copy of this line", "twice in one text\ntwice in one text"]
    texts += ["\n".join([common[0], *r.sample(common, r.randint(1, 6)), f"line number {i % 17} here"]) for i in range(60)]
    texts.append("\n".join(f"long text line {i % 700}" for i in range(20000)))
    rows = [(i, t, "x", i, "g") for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (9, "another text\nthe   second line", "x", 1, "g"), (None, common[0] + "\nno copy of this line", "x", 1, "g"), (None, None, "x", 1, "g")]
    return spark.createDataFrame(rows, SCHEMA)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOW)


def plain_lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n") if i is not None else ():
            held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out.append((i, t, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_keys,probes", [(1 << 12, 1 << 16), (3, 4)])
def test_lines(odd, monkeypatch, shard_keys, probes):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(line_dedup, "PROBES", probes)
    out = line_dedup.drop_repeated_lines(odd)
    assert out.columns == [*odd.columns, "lines_"]
    got = [(r.doc_id, r.text, *r.lines_) for r in out.collect()]
    assert sorted(got, key=repr) == plain_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert all((r.lines, r.gone) == ("x", "g") for r in out.collect())


def test_lines_of_empty_tables_and_three_documents(spark, odd):
    assert line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0
    df = spark.createDataFrame([(i, f"in all three of them\n{'in the first two' if i < 2 else 'x'}") for i in range(3)], "doc_id long, text string")
    assert [r.lines.kept for r in line_dedup.drop_repeated_lines(df, least_docs=3).orderBy("doc_id").collect()] == ["in all three of them\nin the first two", "in the first two", "x"]


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        keys = r.integers(0, 2**64, (n, 2), dtype=np.uint64)
        hashed = line_dedup.PerfectHash.of(keys)
        assert sorted(hashed.numbers(keys).tolist()) == list(range(n))
        others = hashed.numbers(r.integers(0, 2**64, (1000, 2), dtype=np.uint64))
        assert others.min() >= -1 and others.max() < max(n, 1)


def test_lines_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    cur = con.execute(entry.oracle_sql()["op11_line_dedup"])
    df = entry.queries()["op11_line_dedup"](spark, FOLDER)
    assert sorted(map(tuple, df.select(*[x[0] for x in cur.description]).collect())) == sorted(cur.fetchall())


def near(a, b):
    """One edit apart, letter by letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows, least_chars=5, least_n=3, every=97):
    n = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if every and i is not None and h % every == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least_n}


def plain_variants(n):
    form, out = {}, {}
    for w in n:
        mates = [v for v in n if near(w, v)]
        best = min(mates, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(mates), form[w], n.get(form[w]))
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def got_variants(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


@pytest.fixture(scope="module")
def spelled(spark):
    r = random.Random(8)
    syllables = ["ab", "ba", "é", "ÿ", "À", "à", "×", "zz", "Q"]
    base = ["".join(r.choice(syllables) for _ in range(r.randint(1, 5))) for _ in range(150)]
    texts = [None, "", "1 2 3", "a" * 3000 + " " + "a" * 2999, "a" * 3000, "a" * 3000 + "!" + "a" * 3000] + [" ".join(r.choice(base) for _ in range(200)) + ",x-" + "a" * 2999 for _ in range(30)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[9], rows[9], (None, "abbaab " * 50, "x")], "doc_id long, text string, word string")


@pytest.mark.parametrize("block,bin_", [(1 << 15, 1 << 16), (3, 50)])
def test_words(spelled, monkeypatch, block, bin_):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "BIN", bin_)
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in spelled.collect()]))
    assert got_variants(spelling.variants(spelled)) == want and any(v[2] for v in want.values())


def test_short_words_and_few_pairs_at_once(spelled, monkeypatch):
    monkeypatch.setattr(spelling, "PAIRS", 7)
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in spelled.collect()], 1, 1, 0))
    assert got_variants(spelling.variants(spelled, least_chars=1, least_n=1, every=0)) == want
    assert spelling.variants(spelled.limit(0)).count() == 0


def test_words_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    got = got_variants(entry.queries()["op12_spelling_variants"](spark, FOLDER))
    assert {w: v[0] for w, v in got.items()} == n
    some = random.Random(1).sample(sorted(n), 150)
    for w in some:
        mates = [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)]
        best = min(mates, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        assert got[w] == (n[w], len(mates), form, n.get(form), got[form][4] if form else w)


def plain_whitening(rows, components=16):
    """n, S and deviations in integers; the covariance in fractions."""
    x = {i: [int(np.floor(64 * c)) + 1_000_000 for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    apart = [[n * c - s for c, s in zip(f, sums)] for f in fit]
    d = len(sums)
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in apart), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    own = {i: [n * c - s for c, s in zip(v, sums)] for i, v in x.items()}
    return n, {i: sum(c * c for c in v) for i, v in own.items()}, {i: np.array(v) / n @ u / np.sqrt(e) for i, v in own.items()}, e / np.trace(cov)


def test_whitening(spark):
    r = np.random.default_rng(2)
    x = (r.normal(size=(90, 20)) * r.uniform(0.5, 2, 20)).tolist()
    good = [(i, v, 0.5) for i, v in enumerate([*x, x[0], x[0], x[1]])]
    bad = [(500, None, 0.1), (501, [float("nan")] + x[0][1:], 0.1), (502, [None] + x[0][1:], 0.1), (503, [float("inf")] + x[0][1:], 0.1), (504, [], 0.1), (505, [1e300] * 20, 0.1)]
    df = spark.createDataFrame([*good, *bad, (7, x[7], 0.1)], "vec_id long, embedding array<double>, whitened double")
    out = whitening.whiten(df).collect()
    n, deviation, white, explained = plain_whitening([(i, v) for i, v, _ in good])
    assert len(out) == len(good) + 1 and n == 90
    for row in out:
        assert (row.n, int(row.deviation)) == (n, deviation[row.vec_id]) and row.identity_error < 1e-9
        assert np.allclose(np.abs(row.whitened), np.abs(white[row.vec_id]), rtol=0, atol=1e-9) and np.allclose(row.explained, explained, rtol=1e-9)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id >= 500")).count() == 0


def test_whitening_of_few_and_unequal_vectors(spark):
    far = [[2.0**40, 0.0], [2.0**40 + 1, 3.0], [2.0**41, 1.0]]
    rows = [(1, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5]), (None, far[0]), (4, far[1]), (4, far[2]), (6, [0.25])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((len(r.whitened), r.n) for r in out) == [(0, 1), (0, 1), (0, 1), (1, 3), (1, 3), (1, 3)] or sorted((len(r.whitened), r.n) for r in out)[3:] == [(2, 3)] * 3
    x = [[int(64 * c) + 1_000_000 for c in v] for v in far]
    sums = [sum(c) for c in zip(*x)]
    assert sorted(int(r.deviation) for r in out if r.n == 3) == sorted(sum((3 * c - s) ** 2 for c, s in zip(v, sums)) for v in x)


@pytest.mark.parametrize("scale", [1, 10**6, 2**40])
def test_scatter_is_exact(spark, scale, monkeypatch):
    monkeypatch.setattr(whitening, "STRIP", 2)
    monkeypatch.setattr(whitening, "ROWS", 7)
    r = random.Random(scale)
    x = [[r.randint(-scale, scale) for _ in range(4)] for _ in range(40)]
    found = whitening.exact_scatters(spark.createDataFrame([(4, v) for v in x], "dim int, x array<long>").repartition(5))[4]
    ones = [[1, *v] for v in x]
    assert found == [[sum(v[i] * v[j] for v in ones) for j in range(5)] for i in range(5)]


def test_whitening_of_embeddings(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    n, deviation, white, explained = plain_whitening([(r.vec_id, r.embedding) for r in table.collect()])
    rows = entry.queries()["op13_embedding_whitening"](spark, FOLDER).collect()
    assert len(rows) == 16 * table.count()
    for r in rows:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id]) and r.identity_error <= 1e-4
        assert abs(abs(r.whitened) - abs(white[r.vec_id][r.component - 1])) < 1e-9 and abs(r.explained / explained[r.component - 1] - 1) < 1e-9


def test_digest_of_the_kept_lines(spark):
    rows = {r.doc_id: r for r in entry.queries()["op11_line_dedup"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    for i, _, n, dropped, kept in plain_lines([tuple(r) for r in docs]):
        assert (rows[i].n_lines, rows[i].n_dropped, rows[i].kept_sha256) == (n, dropped, hashlib.sha256(kept.encode()).hexdigest())
