"""Offsets in three units against plain Python, text by text."""

import random

import pytest

from tallyspan.operators import translate


def plain(text, at, unit):
    """The byte offset, or None."""
    if text is None or at is None or at < 0:
        return None
    if unit == "bytes":
        return at if at <= len(text.encode()) else None
    if unit == "points":
        return len(text[:at].encode()) if at <= len(text) else None
    for i in range(len(text) + 1):
        if len(text[:i].encode("utf-16-le")) == 2 * at:
            return len(text[:i].encode())
    return None


@pytest.mark.parametrize("unit", translate.UNITS)
@pytest.mark.parametrize("bin_bytes", [40, 4 << 20])
def test_offsets(spark, monkeypatch, unit, bin_bytes):
    monkeypatch.setattr(translate, "BIN_BYTES", bin_bytes)
    r = random.Random(4)
    texts = {i: "".join(r.choice("aé한😀 ") for _ in range(r.randrange(12))) for i in range(40)} | {40: None, 41: "", 42: "x" * 5000 + "😀" * 3000}
    spans = [(i, r.randrange(-2, 30), r.randrange(-2, 30)) for i in [*texts, 77] for _ in range(12)] + [(42, 5000, 8000), (42, 17000, 17000), (3, None, 2), (None, 0, 1), (1, 0, 1), (1, 0, 1)]
    found = spark.createDataFrame([(n, *s) for n, s in enumerate(spans)], "n long, k long, start long, end_ int")
    out = translate.to_bytes(found, spark.createDataFrame(list(texts.items()), "k long, text string"), "k", unit)
    assert out.columns == ["n", "k", "start", "end_", "f_start", "f_end", "fits"]
    got = {x.n: (x.k, x.start, x.end_, x.f_start, x.f_end, x.fits) for x in out.collect()}
    for n, (k, a, b) in enumerate(spans):
        text = texts.get(k)
        whole = text is not None and a is not None and b is not None
        s, e = (plain(text, a, unit), plain(text, b, unit)) if whole else (None, None)
        raw = (text or "").encode()
        inside = lambda at: at == len(raw) or raw[at] & 0xC0 != 0x80
        assert got[n] == (k, a, b, s, e, s is not None and e is not None and s < e and inside(s) and inside(e))


def test_no_texts_and_no_findings(spark):
    found = spark.createDataFrame([(1, 0, 1)], "k long, start long, end_ long")
    texts = spark.createDataFrame([(1, "a")], "k long, text string")
    assert [tuple(r) for r in translate.to_bytes(found, texts.limit(0), "k", "points").collect()] == [(1, 0, 1, None, None, False)]
    assert translate.to_bytes(found.limit(0), texts, "k", "points").count() == 0
    with pytest.raises(ValueError):
        translate.to_bytes(found, texts, "k", "lines")


def test_no_text_travels_with_the_findings(spark):
    found = spark.createDataFrame([(1, 0, 1)], "k long, start long, end_ long")
    texts = spark.createDataFrame([(1, "a")], "k long, text string")
    plan = translate.to_bytes(found, texts, "k", "points")._jdf.queryExecution().optimizedPlan()
    sides = [plan.collectLeaves().apply(i).output().toString() for i in range(plan.collectLeaves().size())]
    assert ["text" in s for s in sides] == [True, False]
