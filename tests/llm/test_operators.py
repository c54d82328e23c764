import math
import random
import re
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from brute import groups, jaccard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tallyspan.llm import bpe, common, jaccard as joins, langid, licenses, media, mixing, neardup, queries, sharding, token_counts, toxicity

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"


def words(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties, copies, near copies, repeated rows, clashing extra columns."""
    r = random.Random(5)
    base = [words(r, n) for n in (3, 4, 7, 30, 120, 400)]
    texts = [None, "", " \t\n", "A.", "<|endoftext|> x<|endoftext|>", "日本語 😀😀 text", "x" * 5000, words(r, 30000), "MIT License mit LICENSE, the Apache License; GNU General Public License version 3"]
    for b in base:
        texts += [b, b, b.upper(), b + " tail", b + "  "]
        w = b.split()
        for k in (1, 2, 3):
            v = list(w)
            v[r.randrange(len(v))] = "new" * k
            texts.append(" ".join(v))
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 2}", 1, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 60)])
def test_jaccard(odd, size, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in joins.jaccard_groups(odd, size, percent).collect()}
    assert got == jaccard(texts_of(odd).items(), size, percent)


def test_jaccard_repeated_and_null_ids(spark, odd, empty):
    twice = odd.union(odd).union(spark.createDataFrame([(None, "a b c d", None, None, None, None, None)], SCHEMA))
    out = joins.jaccard_groups(twice, 4, 85).collect()
    want = jaccard(texts_of(odd).items(), 4, 85)
    assert len(out) == 2 * len(want) + 1
    assert all((r.n_shingles, r.component_id) == want.get(r.doc_id, (1, None)) for r in out)
    assert joins.jaccard_groups(empty).count() == 0
    clash = joins.one_of_each(odd.withColumn("gone_id", F.lit(1)).withColumn("GONE_ID_", F.lit(2)), 4, 85)
    assert "gone_id" in clash.columns and {r.doc_id for r in clash.collect()} == {c for _, c in want.values()}
    kept = joins.one_of_each(odd, 4, 85)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


def test_jaccard_with_salts_and_small_blocks(odd, monkeypatch):
    for name, value in (("TASK_ROWS", 0), ("HOT_ROWS", 1), ("HOT_PART", 4)):
        monkeypatch.setattr(common, name, value)
    monkeypatch.setattr(joins, "BLOCK", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in joins.jaccard_groups(odd, 4, 85).collect()}
    assert got == jaccard(texts_of(odd).items(), 4, 85)


def test_bpe_and_counts(odd, empty):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.RANKS), special_tokens={})
    out = bpe.decode(bpe.encode(odd, queries.RANKS), queries.RANKS).withColumn("list", bpe.ids_of(F.col("ids")))
    for r in out.collect():
        assert r.list == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    both = bpe.round_trip(odd, queries.RANKS, out_col="LABEL").collect()
    assert {(r.doc_id, bytes(r.ids), bytes(r.LABEL)) for r in both} == {(r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()}
    tok = Tokenizer.from_file(queries.TOKENIZER)
    for r in token_counts.count_tokens(odd, queries.TOKENIZER).collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 1024)
    assert bpe.encode(empty, queries.RANKS).count() == token_counts.count_tokens(empty, queries.TOKENIZER).count() == 0


def test_media(spark, odd, empty):
    rows = media.media_columns(odd).collect()
    for r in rows:
        raw = (r.text or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert bytes(r.payload) == want and r.track.codec == "raw" and r.track.samples == len(want) // 192
        keys = [bytes(r.media)[k.first : k.end] for k in r.track.key_frames]
        assert keys == [want[i : i + 192] for i in range(0, len(want), 192 * media.KEY_EVERY)]
    bad = spark.createDataFrame([(None,), (bytearray(b""),), (bytearray(b"\0\0\0\x04moov"),), (bytearray(b"junk" * 9),)], "m binary")
    assert [r.t and r.t.codec for r in bad.select(media.index_column(F.col("m")).alias("t")).collect()] == [None, "none", "none", "none"]
    assert media.media_columns(empty).count() == 0


def test_media_damaged_files(spark):
    r = random.Random(7)
    whole = media.pack(b"a frame of bytes" * 3000)
    files = [whole[: r.randrange(len(whole))] for _ in range(60)]
    table = whole.index(b"moov")
    for _ in range(400):
        bad = bytearray(whole)
        for _ in range(r.randint(1, 3)):
            at = r.randrange(table, len(bad) - 4)
            bad[at : at + 4] = r.choice([b"\xff\xff\xff\xff", b"\0\0\0\0", r.randbytes(4)])
        files.append(bytes(bad))
    nested = b""
    for _ in range(3000):
        nested = media.box(b"moov", nested)
    huge = whole.replace((250).to_bytes(4, "big"), b"\xff\xff\xff\xff")
    rows = spark.createDataFrame([(bytearray(f),) for f in [*files, nested, huge, b"", whole]], "m binary")
    out = rows.select(media.index_column(F.col("m")).alias("t"), media.read_column(F.col("m")).alias("p")).collect()
    assert out[-1].t.codec == "raw" and bytes(out[-1].p) == b"a frame of bytes" * 3000
    assert any(x.t.codec == "damaged" for x in out) and all(not x.p for x in out if x.t.codec in ("none", "damaged"))


def test_media_walks_wide_and_open_boxes():
    inner = media.box(b"free", b"abc")
    wide = b"\0\0\0\1moov" + (16 + len(inner)).to_bytes(8, "big") + inner
    assert [p[-1] for p, _, _ in media.walk(wide + b"\0\0\0\0mdatrest")] == [b"moov", b"free", b"mdat"]


def test_licenses(odd, empty):
    out = {r.doc_id: r for r in licenses.digest(licenses.scan(odd)).collect()}
    r = out[8]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (13, 4, 0, 8, "apache,gpl,mit", "apache,gpl,gpl-3.0,mit", 1.0)
    assert all((out[i].n_words, out[i].n_base, out[i].first_word, out[i].labels, out[i].score) == (0, 0, None, "", 0.0) for i in (0, 1, 2))
    assert licenses.digest(licenses.scan(empty)).count() == 0


def plain_notices(text):
    """Words and places of the base phrases, by the contract's definition."""
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses_equal_a_plain_scan(spark, odd):
    for docs in (odd, spark.read.parquet(f"{FOLDER}/documents.parquet")):
        texts = texts_of(docs)
        for r in licenses.digest(licenses.scan(docs)).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_notices(texts[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_shards_are_those_of_the_highest_bid(spark, odd):
    """Bids are computed again from Spark's hash of (key, shard, seed) alone, shard by shard."""
    keys = [r.doc_id for r in odd.select("doc_id").collect()]
    bids = spark.createDataFrame([(str(k), s) for k in keys for s in range(41)], "k string, s int").select("k", "s", F.xxhash64("k", "s", F.lit(0)).alias("h")).collect()
    score = {(r.k, r.s): -1 / math.log((((r.h % 2**64) >> 11) + 0.5) / 2**53) for r in bids}
    for r in sharding.shard_rows(odd).collect():
        best = lambda n, k=str(r.doc_id): max(range(n), key=lambda s: (score[k, s], -s))
        assert (r.shard, r.grown_shard) == (best(40), best(41))


def test_sharding(odd, empty):
    rows = sharding.shard_rows(odd.union(odd)).collect()
    texts = texts_of(odd)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 40)
    assert sharding.shard_rows(empty).count() == 0


def test_rendezvous_follows_weights(spark):
    n = spark.range(20000).groupBy(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).count().collect()
    assert abs({r.s: r["count"] for r in n}[1] / 20000 - 0.75) < 0.02


def test_mixing(odd, empty):
    out = mixing.mix(odd, keep=0.5).collect()
    assert len(out) == len(texts_of(odd)) and all(0 < r.prob <= 1 for r in out) and any(r.source == "(null)" for r in out)
    total = sum(r.tokens for r in out)
    assert abs(sum(r.tokens * r.prob for r in out) / total - 0.5) < 1e-6
    assert {r.doc_id for r in mixing.sampled(odd, keep=0.5).collect()} == {r.doc_id for r in out if r.selected}
    assert mixing.mix(empty).count() == 0 and mixing.sampled(empty).columns == empty.columns


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(20, 8))
    x = [(b + r.normal(size=8) * s).tolist() for b in base for s in (0, 0, 0.1, 0.2, 0.3)]
    rows = [(i, v, i % 2) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, x[0], None), (904, x[0][:4], 0), (905, [None] * 8, 1), (906, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("clash"))
    links = []
    for i, v, a in rows[: len(x)]:
        for j, w, b in rows[:i]:
            if a == b and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.93:
                links.append((j, i))
    want = groups([q[0] for q in rows], links)
    out = neardup.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out} == {q[0]: (sum(q[0] in p for p in links), want[q[0]], want[q[0]] == q[0]) for q in rows}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_extreme_and_repeated(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [5e-324, 1e-323], 1), (4, [-1e308, 1e308], 1), (7, [1.0, 0.0], 2), (7, [0.0, 1.0], 2), (8, [1.0, 0.1], 2), (9, [0.1, 1.0], 2), (9, [0.1, 1.0], 2)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in out)
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4), (7, 1, 7), (7, 2, 7), (8, 1, 7), (9, 2, 7), (9, 2, 7)]


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = queries.held_out()
    out = langid.predict(docs.where(held), langid.train(docs.where(~held))).where("length(text) > 20")
    right, n = out.select(F.avg((F.col("lang") == F.col("language.lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.97
    got = {r.doc_id: r.language for r in langid.predict(odd, langid.train(odd)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and got[7].lang_pred == "en"
    none = langid.train(empty)
    assert langid.predict(empty, none).count() == 0 and {r.language.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_toxicity(spark, odd, empty):
    folder = "/root/testdata/sf0.1"
    docs, labels, held = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), queries.held_out()
    model = toxicity.train(docs.where(~held), labels)
    out = toxicity.score(docs.where(held), model).join(labels, "doc_id").select("score", "toxic").collect()
    caught = np.mean([r.score >= 0.5 for r in out if r.toxic == 1])
    wrong = np.mean([r.score >= 0.5 for r in out if r.toxic == 0])
    assert caught > 0.75 and wrong < 0.02
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model, out_col="score").select("score").collect())
    small, few = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    told = toxicity.score(small, toxicity.train(small.where(~held), few), out_col="s").join(few, "doc_id").groupBy("toxic").agg(F.avg("s").alias("s"), F.count_distinct("s").alias("n")).collect()
    assert {r.toxic: r.s > 0.5 for r in told} == {0: False, 1: True} and max(r.n for r in told) > 1
    none = toxicity.train(odd, labels.limit(0))
    assert max(r.score for r in toxicity.score(odd, none).select("score").collect()) < 0.5 and toxicity.score(empty, none).count() == 0


def test_digests(spark):
    rows = {r.doc_id: r for r in entry.queries()["op7_byte_bpe"](spark, FOLDER).collect()}
    docs = texts_of(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert all(rows[i].decoded_sha256 == sha256(t.encode()).hexdigest() for i, t in docs.items())
    for r in entry.queries()["op8_media_columns"](spark, FOLDER).collect():
        raw = docs[r.doc_id].encode()
        raw += b" " * (-len(raw) % 192 if raw else 192)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))


def test_signatures_within_a_group_move_no_further(spark, tmp_path):
    """All holders of signatures were shuffled to find those that are in different groups; a signature has such holders if one of its rows has."""
    from tallyspan.llm import jaccard

    stars = [(10, 2, 1), (10, 3, 1), (11, 2, 1), (12, 4, 1), (12, 2, 1), (13, 4, 3), (14, 5, 4), (15, 6, 5), (15, 5, 4)]
    labels = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    table = spark.createDataFrame(stars, "sig long, id long, lead long")
    signers = spark.createDataFrame(list(labels.items()), "id long, label long")
    got = jaccard.crossing(jaccard.cut(table, str(tmp_path)), table.select("id", "lead").distinct(), signers, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(12, 2, 1), (12, 4, 1), (13, 4, 3), (15, 5, 4), (15, 6, 5)]


def test_similar_sets_agree_in_as_many_signed_ranges_as_each_needs():
    """The pipeline's shuffle of signatures: a set used to sign three times for every range of its band, more than its own size calls for."""
    from tallyspan.llm import shingles

    rng = np.random.default_rng(5)
    for percent in (50, 80, 85, 100):
        scheme = shingles.PartEnum(percent)
        for n in [*range(1, 40), *rng.integers(40, 1500, 60).tolist()]:
            # hashes below 2^63 leave half of the ranges empty
            top = 2**63 if n % 2 else 2**64
            one = np.unique(rng.integers(0, top, n, dtype=np.uint64))
            sets = [one]
            for lost in range(0, n - -(-percent * n // 100) + 1, max(1, n // 50)):
                # as many elements are lost and added as similar sets may differ in
                kept = rng.permutation(one)[: n - lost]
                more = max(0, 100 * len(kept) // percent - n)
                sets.append(np.unique(np.concatenate([kept, rng.integers(0, top, more, dtype=np.uint64)])))
            sign, owner = scheme.signatures(sets)
            needs = scheme.needs(sets)
            of = [set(sign[owner == i].tolist()) for i in range(len(sets))]
            for i in range(1, len(sets)):
                met = of[0] & of[i]
                for parity in (0, 1):
                    ranges = {s & (shingles.RANGES - 1) for s in met if (s >> (shingles.PLACE - 1)) & 1 == parity}
                    assert not ranges or len(ranges) >= max(1, min(needs[0, parity], needs[i, parity]))
                assert met
            if n > 100 and n % 2 == 0 and percent >= 80:
                assert len(of[0]) <= 2 * (1.1 * n * (100 / percent - 1) + 4)
