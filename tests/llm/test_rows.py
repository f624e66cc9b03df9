"""Row behaviour of the operators: nulls, repeats, empty tables, clashing columns; queries on the smallest tables."""

import pytest

from quillguard.llm import common, queries
from quillguard.llm import p1_language as P1
from quillguard.llm import p2_pii as P2
from quillguard.llm import p3_encoding as P3
from quillguard.llm import p5_glyphs as P5


@pytest.fixture(scope="module")
def ref(spark, data):
    return common.Ref(common.text_models(spark, spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")))


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "D", 10, "Nom : Karl Mozdrin\nL'Ã©quipe a gÃ©rÃ© le dÃ©pÃ´t prÃ¨s du vieux canal.", None, "clash"),
        (1, "D", 10, "Nom : Karl Mozdrin\nL'Ã©quipe a gÃ©rÃ© le dÃ©pÃ´t prÃ¨s du vieux canal.", None, "clash"),
        (2, "D", 10, "The team sold the оld van with three new people.", "a@b.example", "clash"),
        (3, None, None, None, None, "clash"),
        (4, None, 11, "", " ", "clash"),
        (None, "D", 11, "We sold the old van.\n" * 3000, "", None),
        (5, None, None, "The team sold the old van near the north depot.", None, "clash"),
    ]
    return spark.createDataFrame(rows, "page_id long, dossier_id string, doc_id long, raw_text string, header_text string, seg_no string")


def test_repair(pages, ref):
    got = P3.repair(pages, ref).collect()
    assert [r["page_id"] for r in got] == [1, 1] and "L'équipe a géré le dépôt près" in got[0]["restored"]
    assert P3.repair(pages.limit(0), ref).count() == 0


def test_unify(pages, ref):
    got = {(r["page_id"], r["garbled"]): r["canonical"] for r in P5.unify(pages, "page_id", "raw_text", ref).collect()}
    assert set(got) == {(1, True), (2, False)} and "old van" in got[2, False]


def test_redaction_keeps_all_else(pages, ref):
    for r in P2.redact(pages, "page_id", ["raw_text", "header_text"], ref).collect():
        if r["page_id"] == 1:
            assert r["redacted"][0].startswith("Nom : [NAME ") and r["redacted"][0].endswith("vieux canal.") and r["redacted"][1] is None
        if r["page_id"] == 2:
            assert r["redacted"][1].startswith("[EMAIL ")
    listed = sorted((r["page_id"] or 0, *r[1:]) for r in P2.found_pieces(pages, "page_id", ["raw_text", "header_text"], ref).collect())
    assert listed == sorted((r["page_id"] or 0, *p) for r in P2.redact(pages, "page_id", ["raw_text", "header_text"], ref).collect() for p in r["pieces"])
    found = {(r[0], r[1], r[2], r[5]) for r in listed}
    assert found == {(1, "raw_text", "NAME", "Karl Mozdrin"), (2, "header_text", "EMAIL", "a@b.example")}


def test_fusion(spark, pages, ref):
    seg = common.materialize(P1.segments(pages, ref).dropDuplicates(["page_id", "seg_no"]))
    declared = spark.createDataFrame([(10, ["fr"]), (10, ["fr"]), (11, None)], "doc_id long, languages array<string>")
    got = {(r["page_id"], r["lang"]) for r in P1.fuse(seg, declared).collect()}
    assert got == {(1, "fr"), (2, "en"), (None, "en"), (5, "en")}
    assert all(0 < r["confidence"] <= 1 for r in P1.fuse(seg, declared).collect())
    empty = common.materialize(P1.segments(pages.limit(0), ref))
    assert P1.fuse(empty, declared.limit(0)).count() == 0


def test_no_stretch_confirms_itself(spark):
    """A stretch alone in its file, dossier and declared set has the corpus's prior; a second one speaks for it."""
    import math

    flat = [0.0, -9.0, -9.0, -9.0, -9.0]
    en = [-9.0, -9.0, 0.0, -9.0, -5.0]
    schema = "page_id long, doc_id long, dossier_id string, seg_no int, start int, end int, n_sentences int, suffix string, ll array<double>"
    rows = [(1, 10, "A", 0, 0, 9, 1, "a.example", en), (2, 20, "B", 0, 0, 9, 1, "", flat), (3, 30, "B", 0, 0, 9, 1, "", flat)]
    declared = spark.createDataFrame([(10, ["en"])], "doc_id long, languages array<string>")
    got = {r["page_id"]: r for r in P1.fuse(spark.createDataFrame(rows, schema), declared).collect()}
    base = [3 / 8, 1 / 8, 2 / 8, 1 / 8, 1 / 8]  # ar, de, en, es, fr: one more than counted, of all
    post = [math.exp(x) * p for x, p in zip(en, base)]
    assert got[1]["lang"] == "en" and abs(got[1]["confidence"] - post[2] / sum(post)) < 1e-5
    more = rows + [(4, 10, "A", 0, 0, 9, 1, "b.example", en)]
    again = {r["page_id"]: r for r in P1.fuse(spark.createDataFrame(more, schema), declared).collect()}
    assert again[1]["confidence"] > got[1]["confidence"]


def test_confidence_is_calibrated(spark, ref, data):
    """Stretches cut to a few words: where the posterior says so much, at least about so many are right."""
    from quillguard.llm import language

    model, _ = ref.models()
    rows = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("lang", "text").dropna().collect()
    said = []
    for r in rows:
        if r["lang"] not in language.LANGS:
            continue
        truth = model.document(r["text"])  # labels may be wrong: the whole text decides
        for s in language.sentences(r["text"])[:4]:
            x = model.score(" ".join(s[2].split()[:4]))
            if x is not None and truth:
                p = [2.718281828**v for v in x]
                said.append((max(p) / sum(p), language.LANGS[x.index(max(x))] == truth))
    sure = [ok for c, ok in said if c > 0.9]
    assert len(sure) > 500 and sum(sure) / len(sure) > 0.93


def test_salted_join(spark, monkeypatch):
    left = spark.createDataFrame([(i, "hot" if i % 3 else None if i % 2 else f"k{i}") for i in range(300)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k6", 2), ("other", 3)], "k string, v int")
    want = sorted(((r["id"], r["v"]) for r in left.join(right, "k", "left").collect()))
    assert sorted(((r["id"], r["v"]) for r in common.salted_join(left, right, "k", "id").collect())) == want
    monkeypatch.setattr(common, "SMALL", 1)
    assert sorted(((r["id"], r["v"]) for r in common.small_join(left, right, "k").collect())) == want


COLUMNS = {
    "p1_found": "doc_id bigint, lang string", "p2_found": "page_id bigint, field_name string, pii_kind string, found_text string", "p3_found": "page_id bigint",
    "p4_found": "name_id_a bigint, name_id_b bigint", "p5_found": "tab_name string, rec_id bigint", "p7_found": "doc_id bigint, item_id bigint",
    "p8_found": "doc_id bigint, reading_level int",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries(spark, data, name):
    df = queries.queries()[name](spark, data)
    if name in COLUMNS:
        assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]
    n = df.count()
    assert n == df.distinct().count() if name in COLUMNS else n >= 0
