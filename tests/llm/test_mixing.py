import duckdb
import pytest

import __spark_entry__ as entry
from tallyspan.llm import mixing

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.mark.parametrize("targets", [None, {"lang": {"es": 0.4}, "topic": {"short": 0.2, "table": 0.3}}])
def test_expected_margins_reach_their_targets(docs, targets):
    rows = mixing.achieved(docs, targets=targets).collect()
    assert {r.margin for r in rows} == set(mixing.MARGINS)
    assert all(abs(r.expected - r.target) < 1e-5 for r in rows)
    for m, named in (targets or {}).items():
        assert all(abs({r.value: r.expected for r in rows if r.margin == m}[v] - share) < 1e-4 for v, share in named.items())
    assert all(abs(r.sampled - r.target) < 0.03 for r in rows)


def test_copies_are_rows(docs):
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in mixing.sampled(docs).groupBy("doc_id").count().collect()}
    assert got == want and max(got.values()) > 1


def test_many_cells_give_the_same(docs, monkeypatch):
    targets = {"lang": {"es": 0.4}}
    few = {tuple(r) for r in mixing.cell_probabilities(docs, rounds=2, targets=targets).collect()}
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    many = {tuple(r) for r in mixing.cell_probabilities(docs, rounds=2, targets=targets).collect()}
    key = lambda rows: {r[:3]: r[3:] for r in rows}
    assert key(few).keys() == key(many).keys()
    assert all(abs(a - b) < 2e-9 * max(1, a) for k in key(few) for a, b in zip(key(few)[k], key(many)[k]))


@pytest.mark.parametrize("name", ["op6_mixing", "op6_mixing_copies"])
def test_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{FOLDER}/documents.parquet')")
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    df = entry.queries()[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())


def test_columns_of_the_same_names_come_through(docs):
    named = docs.withColumnsRenamed({"n_chars": "mix_draw"}).withColumn("mix_source", docs.doc_id).withColumn("mix_rate", docs.doc_id).withColumn("mix_row", docs.doc_id)
    out = mixing.sampled(named)
    assert out.columns == named.columns
    plain = sorted(r.doc_id for r in mixing.sampled(docs).collect())
    assert sorted(r.doc_id for r in out.where("mix_row = doc_id and mix_source = doc_id").collect()) == plain
