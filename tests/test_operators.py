"""Operators on small inline fixtures (invented people only)."""

import random

from pyspark.sql import functions as F

from quillguard.functions import geometry as G
from quillguard.functions import patterns as P
from quillguard.functions import text as T
from quillguard.functions import lexicon
from quillguard.operators import hits, identity, layout, ner, ocr, regions, report
from quillguard.sources import files


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


PHONES = [
    (1, "call 06 12 34 56 78 now", ["06 12 34 56 78"]),
    (2, "+33 (0)6.12.34.56.78", ["+33 (0)6.12.34.56.78"]),
    (3, "+1 (476) 555-0118", ["+1 (476) 555-0118"]),
    (4, "612345678 and 712345678", ["612345678", "712345678"]),
    (5, "1234567890123456", []),
    (6, None, []),
    (7, "", []),
]


def test_phone_spans(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in PHONES], "id long, text string, start string")
    got = hits.phone_hits(df, ["id"], "text").collect()
    for i, t, want in PHONES:
        mine = sorted((r["start"], r["end"], r["found"]) for r in got if r["id"] == i)
        assert [f for *_, f in mine] == want
        assert all(t[a:b] == f for a, b, f in mine)


def test_email_ends_are_word_boundaries(spark):
    texts = ["-john@x.com", "a@b.com1", "éa@b.com", "é.john@x.com", "a@b.comé", "x,a@b.co,c@d.co;", "a\u00a0@\u00a0b.com", "a@b.c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {}
    for r in hits.email_hits(df, ["id"], "text").collect():
        got.setdefault(r["id"], []).append(r["found"])
        assert texts[r["id"]][r["start"] : r["end"]] == r["found"]
    assert got == {0: ["john@x.com"], 3: [".john@x.com"], 5: ["a@b.co", "c@d.co"], 6: ["a\u00a0@\u00a0b.com"]}


def test_hot_dossiers_are_spread_and_lose_nothing(spark):
    rows = [(i, "hot" if i % 2 else f"d{i % 40}" if i % 4 else None, f"term {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, dossier_id string, text string")
    terms = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("hot", "b"), ("d2", "c"), (None, "z")], "dossier_id string, term string")
    got = {r["page_id"]: r["terms"] for r in hits.with_terms(df, terms, "dossier_id", "page_id", "left").collect()}
    want = {"hot": ["a", "b"], "d2": ["c"]}
    assert got == {i: want.get(d) for i, d, _ in rows}
    assert hits.with_terms(df, terms, "dossier_id", "page_id").count() == sum(d in want for _, d, _ in rows)
    assert hits.with_terms(df.limit(0), terms, "dossier_id", "page_id", "left").count() == 0


def test_folder_to_masked_pages(spark, tmp_path):
    """A tree of files through the plain-text plug-in to hits; without a decoder the result is empty and says so."""
    from quillguard.sources import decoders

    for name, content in (("D1/cv.txt", "Nom : Karl Mozdrin\nkarl@x.example\fpage two 0612345678"), ("D1/b ü.txt", "\f"), ("loose.txt", "a@b.example")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content, encoding="utf-8")
    found = files.discover(spark, str(tmp_path), content=True).withColumn("doc_id", F.xxhash64("rel_path"))
    pages, status = decoders.plain_text().apply("pdf_pages", found.select("dossier_id", "doc_id", "content"), files.PAGES)
    assert status == "ok" and values(pages, "dossier_id", "page_no", "text") == [("D1", 1, "Nom : Karl Mozdrin\nkarl@x.example"), ("D1", 1, None), ("D1", 2, "page two 0612345678"), ("D1", 2, None)]
    assert values(hits.email_hits(pages, ["doc_id"], "text"), "found") == [("karl@x.example",)]
    empty, status = files.Plugins().apply("pdf_pages", found, files.PAGES)
    assert status == "degraded" and empty.count() == 0


def test_once(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "d")], "id long, text string")
    assert sorted(((r["id"] or 0, r["text"]) for r in files.once(df, "id").collect())) == [(0, "c"), (0, "d"), (1, "a"), (2, "b")]


def test_regions(spark):
    """An occurrence over a line end has a box on each line; a box in another is counted but not covered."""
    text = "Karl Mozdrin\nmail karl@x.example Karl\nMozdrin +33 6 12 34 56 78"
    pages = spark.createDataFrame([(1, "D", text, "clash"), (2, "E", "Mozdrin", "clash"), (3, None, None, "clash"), (4, "D", " ", "clash")], "page_id long, dossier_id string, raw_text string, id string")
    terms = spark.createDataFrame([("D", "karl mozdrin"), ("D", "mozdrin"), ("D", "ka")], "dossier_id string, term string")
    found = regions.occurrences(pages, terms, ["page_id"], "raw_text").collect()
    assert sorted(text[r["start"] : r["end"]] for r in found) == ["+33 6 12 34 56 78", "Karl Mozdrin", "Mozdrin", "Mozdrin", "karl@x.example"]
    got = regions.page_regions(pages, terms, ["page_id"], "raw_text").collect()
    assert {r["page_id"] for r in got} == {1}
    kept = sorted((r["entity"], r["rect"]["y0"]) for r in got if r["kept"])
    assert kept == [("EMAIL_ADDRESS", 10.0), ("PERSON", -2.0), ("PERSON", 22.0), ("PHONE_NUMBER", 22.0)]
    assert len(got) == 5 and regions.page_regions(pages.limit(0), terms, ["page_id"], "raw_text").count() == 0


def test_containment_against_brute_force(spark):
    rng = random.Random(4)
    box = lambda x, y: (float(x), float(y), float(x + rng.randint(1, 9)), float(y + rng.randint(1, 9)))
    rows = [(p, i, "PERSON", box(rng.randint(0, 9), rng.randint(0, 9))) for p in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id int, id int, entity string, rect struct<x0:double,y0:double,x1:double,y1:double>")
    holds = lambda a, b: a[3][0] <= b[3][0] and a[3][1] <= b[3][1] and a[3][2] >= b[3][2] and a[3][3] >= b[3][3]
    want = {(r[0], r[1]) for r in rows if not any(o[0] == r[0] and o[1] != r[1] and holds(o, r) and (o[3] != r[3] or o[1] < r[1]) for o in rows)}
    assert {(r["page_id"], r["id"]) for r in regions.flagged(df, ["page_id"]).where("kept").collect()} == want


def test_choices_and_lists(tmp_path):
    assert files.choose_root("x", lambda _: True) == "x" and files.choose_root(None, lambda p: p == "data") == "data" and files.choose_root(None, lambda _: False) == "test"
    assert files.choose_output(None) == "result" and files.choose_output("o") == "o"
    (tmp_path / "w.txt").write_text("# professions\nplanner\n\n architecte \n", encoding="utf-8")
    assert lexicon.word_list(str(tmp_path / "w.txt")) == ["planner", "architecte"]


def test_full_word_lists_are_parameters(spark):
    df = spark.createDataFrame([("Nom : Nadia Sculpteur\nTel: 1",)], "t string")
    assert df.select(identity.label_candidate("t")).first()[0].startswith("Nadia Sculpteur")
    assert df.select(identity.label_candidate("t", ["sculpteur"])).first()[0] is None


def test_capitals_are_letters(spark):
    df = spark.createDataFrame([("Cette attestation est remise à Karl Élodie 1234\n",), ("Nous certifions; certifie que Karl mozdrin a suivi",)], "t string")
    got = [set(r[0]) for r in df.select(identity.attestation_candidates("t")).collect()]
    assert "1234" not in got[0] and got[1] == {"Karl mozdrin", "Karl"}


def test_statistical_language(spark):
    df = spark.createDataFrame([("the van and the shop of the town",), ("le bureau et la ville dans une rue",), ("12 34",), (None,), ("der Wagen und die Stadt",)], "t string")
    assert [r[0] for r in df.select(T.statistical_language("t")).collect()] == ["en", "fr", None, None, "de"]
    assert [r[0] for r in df.select(T.detect_language("t", T.statistical_language("t"))).collect()] == ["en", "fr", "en", "en", "en"]


def test_email_forms(spark):
    df = spark.createDataFrame([(1, "a.b@mail.example c [at] post.example.org d @ x.test"), (2, None), (3, "none")], "id long, text string")
    got = values(hits.email_hits(df, ["id"], "text"), "found")
    assert got == [("a.b@mail.example",), ("c [at] post.example.org",), ("d @ x.test",)]


def test_masking_is_idempotent_and_keeps_width(spark):
    df = spark.createDataFrame([("x a@b.example y c@d.example",), (None,), ("",)], "t string")
    once = hits.masked("t", P.EMAIL, "[EMAIL_ADDRESS]")
    r = df.select("t", once.alias("a"), hits.masked(once, P.EMAIL, "[EMAIL_ADDRESS]").alias("b"), hits.masked_fixed_width("t", P.EMAIL).alias("w")).collect()
    assert all(x["a"] == x["b"] for x in r)
    assert all(x["t"] is None or len(x["t"]) == len(x["w"]) for x in r)


def test_overlap_resolution(spark):
    h = spark.createDataFrame([(1, 0, 10, "a", 0.8), (1, 0, 10, "b", 0.8), (1, 5, 12, "c", 0.9), (1, 20, 25, "d", 0.5), (None, 0, 3, "e", 0.1)], "id long, start int, end int, rule string, score double")
    assert values(hits.resolve_overlaps(h, ["id"]), "rule") == [("c",), ("d",), ("e",)]


def test_search_terms(spark):
    df = spark.createDataFrame([("M. Rachid Zoltanek",), ("Jean-Luc Marvik",), ("أحمد القوشري",), (None,), ("",), ("ab",)], "n string")
    got = [r[0] for r in df.select(identity.search_terms("n")).collect()]
    assert set(got[0]) == {"rachid zoltanek", "zoltanek rachid", "zoltanek"}
    assert "marvik" in got[1]
    assert "احمد القوشري" in got[2] and "القوشري" in got[2] and "احمد" not in got[2]
    assert got[4] == [] and got[5] == []


def test_label_and_attestation(spark):
    df = spark.createDataFrame([("CV\nNom et prénom : Nadia Belkrum\nTel: 1",), ("Prénom: Nadia",), ("filename: x",), (None,), ("",), ("This is awarded to Karl Mozdrin for work.\n",)], "t string")
    r = df.select(identity.label_candidate("t").alias("l"), identity.attestation_candidates("t").alias("a")).collect()
    assert r[0]["l"].startswith("Nadia Belkrum")
    assert r[1]["l"] is None and r[2]["l"] is None and r[3]["l"] is None and r[4]["l"] is None
    assert "Karl Mozdrin" in r[5]["a"]


def test_term_hits_stay_in_their_dossier(spark):
    pages = spark.createDataFrame([(1, "A", "Zoltanek and ZOLTANEK"), (2, "B", "zoltanek"), (3, "A", None), (4, None, "zoltanek")], "page_id long, dossier_id string, raw_text string")
    terms = spark.createDataFrame([("A", "zoltanek", "label", False)], "dossier_id string, term string, origin string, has_arabic boolean")
    assert values(identity.term_hits(pages, terms, ["page_id"], "raw_text"), "page_id", "n_hits") == [(1, 2)]


def test_cv_pick_ties_and_loose_files(spark):
    f = spark.createDataFrame([("A", "A/b_cv.pdf"), ("A", "A/a_resume.DOC"), ("A", "A/0.pdf"), ("B", "B/x.pdf"), ("B", "B/x.pdf"), ("C", "C/y.txt"), (None, "cv.pdf")], "dossier_id string, rel_path string")
    assert values(identity.cv_pick(f), "dossier_id", "rel_path") == [("A", "A/a_resume.DOC"), ("B", "B/x.pdf")]


def test_containment_matches_brute_force(spark):
    rng = random.Random(3)
    boxes = []
    for i in range(150):
        x, y = rng.randint(0, 12), rng.randint(0, 12)
        boxes.append((i % 4, i, float(x), float(y), float(x + rng.randint(1, 6)), float(y + rng.randint(1, 6))))
    df = spark.createDataFrame(boxes, "page int, id long, x0 double, y0 double, x1 double, y1 double").select("page", "id", F.struct("x0", "y0", "x1", "y1").alias("rect"))
    inside = lambda a, b: b[2] <= a[2] and b[3] <= a[3] and b[4] >= a[4] and b[5] >= a[5]
    want = {a[1] for a in boxes if not any(a[0] == b[0] and a[1] != b[1] and inside(a, b) and (a[2:] != b[2:] or b[1] < a[1]) for b in boxes)}
    assert {r["id"] for r in layout.maximal(df, ["page"]).collect()} == want
    # unions are transitive, whatever the order
    got = sorted((r["page"], r["x0"], r["y0"], r["x1"], r["y1"], r["n"]) for r in layout.union_boxes(df, ["page"]).collect())
    left = {b[1]: b for b in boxes}
    comps = []
    while left:
        todo, comp = [left.popitem()[1]], []
        while todo:
            a = todo.pop()
            comp.append(a)
            near = [k for k, b in left.items() if b[0] == a[0] and a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5]]
            todo += [left.pop(k) for k in near]
        comps.append((comp[0][0], min(c[2] for c in comp), min(c[3] for c in comp), max(c[4] for c in comp), max(c[5] for c in comp), len(comp)))
    assert got == sorted(comps)


def test_empty_boxes(spark):
    df = spark.createDataFrame([], "page int, id long, rect struct<x0:double,y0:double,x1:double,y1:double>")
    assert layout.maximal(df, ["page"]).count() == 0
    assert layout.union_boxes(df, ["page"]).count() == 0


def test_fold_matches_sequential(spark):
    rng = random.Random(5)
    rows, want = [], []
    for doc in range(25):
        at, cur = 0, None
        for seq in range(rng.randint(0, 12)):
            group = rng.choice(["PER", "ORG"])
            sub = rng.random() < 0.25
            gap = rng.choice([0, 1, 1, 3])
            start = at + (0 if sub else gap)
            word = ("##" if sub else "") + rng.choice(["ab", "cde", "f"])
            end = start + len(word.replace("##", ""))
            score = round(rng.random(), 3)
            rows.append((doc, seq, group, word, start, end, score))
            if cur and cur[1] == group and (sub or start <= cur[4] + 1):
                cur[2] += (" " if not sub and start > cur[4] else "") + word.replace("##", "")
                cur[4], cur[5] = end, min(cur[5], score)
            else:
                cur = [doc, group, word, start, end, score]
                want.append(cur)
            at = end
    df = spark.createDataFrame(rows, "doc_id int, seq int, entity_group string, word string, start int, end int, score double")
    got = values(ner.fold_tokens(df), "doc_id", "entity_group", "word", "start", "end", "score")
    assert got == sorted(map(tuple, want), key=str)


def test_scanned_classes_differ(spark):
    df = spark.createDataFrame([("Zoltanek",), ("formation",), ("rachid",), ("06 12 34 56 78 Zoltanek",), ("0612345678",), ("a@b.c",), ("",), (None,)], "t string")
    terms = F.array(F.lit("zoltanek"), F.lit("formation"), F.lit("rachid"))
    r = [tuple(x) for x in df.select(*[ocr.classify(v, "t", terms) for v in ("card", "page", "image")]).collect()]
    assert r[0] == ("PERSON",) * 3 and r[1] == (None,) * 3 and r[2] == (None, "PERSON", None)
    assert r[4] == ("PHONE_NUMBER",) * 3 and r[5] == ("EMAIL_ADDRESS",) * 3 and r[6] == r[7] == (None,) * 3


def test_routing(spark):
    p = spark.createDataFrame([(1, 1, "x" * 49, 0), (2, 1, "x" * 50, 0), (3, 1, None, 1), (3, 2, "y" * 40, 0), (4, 1, " ", None)], "doc_id long, page_no int, raw_text string, n_images int")
    assert values(ocr.scanned(p), "doc_id", "is_scanned", "n_needs_ocr") == [(1, True, 0), (2, False, 0), (3, True, 1), (4, True, 1)]
    assert values(ocr.first_written_page(p), "doc_id", "first_page") == [(1, 1), (2, 1), (3, 1), (4, 1)]


def test_language_gate(spark):
    df = spark.createDataFrame([("",), (None,), ("مرحبا hello",), ("hello مر",), ("le plan de la ville et les quais",), ("plain words here",)], "t string")
    assert [r[0] for r in df.select(T.detect_language("t")).collect()] == ["en", "en", "ar", "ar", "fr", "en"]


def test_geometry(spark):
    q = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((3, 1), (9, 2), (8, 7), (2, 6))])
    r = spark.range(1).select(G.quad_to_rect(q).alias("r"), G.pad(G.rect(1.0, 1.0, 2.0, 2.0)).alias("p")).collect()[0]
    assert tuple(r["r"]) == (2.0, 1.0, 9.0, 7.0) and tuple(r["p"]) == (-1.0, -1.0, 4.0, 4.0)


def test_report_totals_with_nulls(spark):
    df = spark.createDataFrame([("A", "success", 3, {"PERSON": 2}), ("A", "error", None, None), (None, "success", 1, {})], "dossier_id string, status string, total_redactions long, entities_found map<string,long>")
    r = report.totals(df, 1.005).collect()[0]
    assert (r["n_files"], r["n_success"], r["n_errors"], r["total_redactions"], r["person"], r["email_address"]) == (3, 2, 1, 4, 2, 0)
    assert report.totals(df.limit(0)).collect()[0]["total_redactions"] == 0


def test_dispatch(spark):
    df = spark.createDataFrame([("a/b.PDF",), ("a/c.JPeG",), ("a/d.docx",), ("a/noext",), (None,)], "rel_path string")
    assert [r["action"] for r in report.dispatch(df).collect()] == ["redact_pdf", "redact_image", "copy", "copy", "copy"]


def test_discover(spark, tmp_path):
    for p in ("loose.pdf", "D1/cv x.pdf", "D1/sub/a.PNG", "D2/b.pdf"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = values(files.discover(spark, str(tmp_path)), "dossier_id", "rel_path", "ext")
    assert got == [("D1", "D1/cv x.pdf", "pdf"), ("D1", "D1/sub/a.PNG", "png"), ("D2", "D2/b.pdf", "pdf")]


def test_missing_plugin_degrades(spark):
    p = files.Plugins()
    df, status = p.apply("ocr", spark.range(2).toDF("doc_id"), files.OCR_ITEMS)
    assert status == "degraded" and df.count() == 0
    p.register("ocr", lambda it: it, "doc_id long")
    assert p.apply("ocr", spark.range(2).toDF("doc_id"), files.OCR_ITEMS)[1] == "ok"


def test_results_do_not_depend_on_partitions(spark, data):
    from quillguard.plans import catalogue

    p = spark.read.parquet(f"{data}/dossier_pages.parquet").dropDuplicates(["page_id"])
    a = values(hits.phone_hits(p.repartition(1), ["page_id"], "raw_text"), "page_id", "start", "found")
    b = values(hits.phone_hits(p.repartition(7), ["page_id"], "raw_text"), "page_id", "start", "found")
    assert a == b and catalogue.flagship(spark, data).count() > 0


def test_arabic_hits(spark):
    from quillguard.operators import arabic

    df = spark.createDataFrame([(1, "حضر السيد أحمد الزولتني اليوم"), (2, "الاسم: سلمى البركوني"), (3, "يوسف"), (4, None), (5, "plain"), (6, "ﺳﻠﻤﻰ البركوني")], "page_id long, raw_text string")
    got = {(r["page_id"], r["rule"]): r["found"] for r in arabic.person_hits(df, ["page_id"], "raw_text").collect()}
    assert got[1, "arabic_title"].startswith("السيد أحمد الزولتني") and got[2, "arabic_label"] == "سلمى البركوني" and got[3, "arabic_gazetteer"] == "يوسف"
    assert {r["page_id"] for r in arabic.second_pass(df, ["page_id"], "raw_text").collect()} == {6}
    back = spark.createDataFrame([(1, "الاسم: دمحأ ينتلوز")], "page_id long, raw_text string")
    assert [r["found"] for r in arabic.reversed_words(back, ["page_id"], "raw_text", ["أحمد"]).collect()] == ["دمحأ ينتلوز"]
    cover = arabic.person_hits(df, ["page_id"], "raw_text")
    assert arabic.uncovered(cover, cover, ["page_id"]).count() == 0


def test_resolution_in_row_equals_the_join(spark, data):
    p = spark.read.parquet(f"{data}/dossier_pages.parquet").dropDuplicates(["page_id"]).withColumn("lang", T.detect_language("raw_text"))
    all_ = hits.rule_hits(p, ["page_id"], "raw_text", "lang")
    a = values(hits.resolve_overlaps(all_, ["page_id"]), "page_id", "start", "end", "rule")
    assert a == values(hits.rule_hits(p, ["page_id"], "raw_text", "lang", resolve=True), "page_id", "start", "end", "rule") and a
