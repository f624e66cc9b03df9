"""Names, packing, leakage, reading levels against brute force."""

import random
from collections import Counter as Tally

import numpy as np
import pytest

from quillguard.llm import leakage as W
from quillguard.llm import names as N
from quillguard.llm import reading as R
from quillguard.llm.packing import best_fit
from quillguard.llm.tokens import DEFAULT_VOCABULARY, Counter, words


def brute_damerau(a, b):
    """Unrestricted distance by search over edit scripts is too slow: check against the metric axioms and OSA bound."""
    d = {}
    for i in range(-1, len(a) + 1):
        d[i, -1] = i + 1
    for j in range(-1, len(b) + 1):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            c = a[i] != b[j]
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + c)
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_metric():
    rng = random.Random(2)
    ws = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(40)]
    full = {(a, b): N.damerau(a, b, 99) for a in ws for b in ws}
    for a in ws:
        for b in ws:
            assert full[a, b] == full[b, a] and (full[a, b] == 0) == (a == b)
            assert full[a, b] <= brute_damerau(a, b)
            if full[a, b] <= 2:
                assert N.damerau(a, b, 2) == full[a, b]
                assert N.deletions(a, 2) & N.deletions(b, 2)  # no pair within the radius is lost by the keys
            for c in ws[:8]:
                assert full[a, b] <= full[a, c] + full[c, b]


@pytest.mark.parametrize(
    "a,b",
    [
        ("Anselme Bovouzyend", "BOVOUZYEND, Anselme"), ("Mr. Tarek Sahoutdruch", "tariq sahoutdruch"), ("Philippe B. Vopezbrould", "Phil Vopez-brould"),
        ("عبد الرحمن القوشجيبدي", "القوشجيبدي عبدالرحمن"), ("أمينة الديطشي", "امينه ديطشي"), ("Grp Braclizdeg-Chichoucgrip Énergie", "GROUPE CHICHOUCGRIP BRACLIZDEG SARL"),
        ("Beatriz Рamikуend", "Beatriz Pamikyend"),
    ],
)
def test_spellings_meet(a, b):
    assert N.parse(a) == N.parse(b)


def test_nameless():
    assert N.parse(None) == N.parse("") == N.parse(" . ") == N.parse("123") == []


def test_resolution_and_pairs(spark):
    from quillguard.llm import p4_names as P4

    rng = random.Random(4)
    truth, rows = {}, []
    for e, (given, family) in enumerate([("Amina", "Zoltanekov"), ("Karima", "Brudwimpal"), ("Vincent", "Zoltarekin"), ("Tariq", "Mofrandil")]):
        for _ in range(12):
            f = family
            if rng.random() < 0.5:
                k = rng.randrange(1, len(f))
                f = f[:k] + rng.choice("xyz") + f[k + rng.choice([0, 1]) :]
            n = rng.choice([f"{given} {f}", f"{f.upper()} {given}", f"{given[0]}. {f}", f"Dr {given} {f}"])
            rows.append((len(rows), n, "clash"))
            truth[len(rows) - 1] = e
    rows += [(900, None, "x"), (901, "", "x"), (0, rows[0][1], "clash")]
    df = spark.createDataFrame(rows, "name_id long, name string, kind string")
    got = {tuple(r) for r in P4.pairs(P4.resolve(df, "name_id", "name"), "name_id").collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert got == want
    assert P4.resolve(df.limit(0), "name_id", "name").count() == 0


def entities(spark, names):
    from quillguard.llm import p4_names as P4

    df = spark.createDataFrame(list(enumerate(names)), "name_id long, name string")
    return {r["name_id"]: r["entity"] for r in P4.resolve(df, "name_id", "name").collect()}


def groups(got):
    by = {}
    for k, e in got.items():
        by.setdefault(e, set()).add(k)
    return {frozenset(x) for x in by.values()}


def slips(rng, word, n):
    out = word
    for _ in range(n):
        k = rng.randrange(len(out) - 1)
        out = rng.choice([out[:k] + rng.choice("bdfgkz") + out[k + 1 :], out[:k] + out[k + 1 :], out[:k] + out[k + 1] + out[k] + out[k + 2 :], out[:k] + "q" + out[k:]])
    return out


@pytest.mark.parametrize("kind,parts", [("P", 1), ("P", 7), ("O", 1), ("O", 5), ("U", 1), ("U", 5)])
def test_radius_join_is_exact(kind, parts):
    """All pairs within the radius, as a comparison of every pair finds them, whatever the records and parts of the cell."""
    from quillguard.llm import p4_names as P4

    rng = random.Random(f"{kind}{parts}")
    base = ["zoltanekov", "brudwimpal", "mofrandil", "tarek", "ovi"]
    words = base + [slips(rng, rng.choice(base[:4]), rng.randint(1, 3)) for _ in range(70)]
    cores = sorted({w if kind == "P" else " ".join(sorted((w, slips(rng, rng.choice(base[:3]), rng.randint(0, 2))))) for w in words})
    k = "O" if kind == "O" else "P"
    rows = [(i, c, P4.CORE, 0, rng.choice([1, 4, 100])) for i, c in enumerate(cores)]
    rows.sort(key=lambda r: (-r[4], r[1], r[0]))
    want = {(i, j, d) for j in range(len(rows)) for i in range(j) if (d := N.within(k, rows[i][1], rows[j][1])) is not None}
    got = {x for part in range(parts) for x in P4.near(k, rows, parts, part)}
    assert got == want and len(want) > 10


def test_records_do_not_decide(spark):
    """Slips with 1, 4 and 100 records are one name; the same records copied a hundred times give the same entities."""
    spelt = [("Karima Brudwimpal", 100, 0), ("Karima Bruxwimqal", 4, 0), ("Karima Brudwimpla", 1, 0), ("Groupe Braclizdeg Chichoucgrip", 100, 1), ("Groupe Braxlizdeg Chichxucgrid", 4, 1), ("Tariq Mofrandil", 4, 2), ("K. Brudwimpal", 1, 0), ("Tariq Zelbonkurt", 4, 3)]
    rows = [(n, e) for n, k, e in spelt for _ in range(k)]
    got = entities(spark, [n for n, _ in rows])
    assert groups(got) == groups({i: e for i, (_, e) in enumerate(rows)})
    many = entities(spark, [n for n, _ in rows for _ in range(100)])
    assert groups({k // 100: e for k, e in many.items()}) == groups(got)


def test_names_of_no_list(spark):
    """Reordered, mistyped and shortened names that no list holds."""
    names = [
        ("Stephen Hawking", 0), ("Hawking Stephen", 0), ("HAWKING, Stephen", 0), ("Stephen Hawkign", 0), ("S. Hawking", 0), ("Hawking, Steph", 0), ("Wei Zhang", 1), ("Zhang, Wei", 1),
        ("Astrid Lindqvist", 2), ("lindqvist astrid", 2), ("Giovanni Moretti", 3), ("Moretti G.", 3), ("Katsumi Tanabe", 4), ("Tanabe Katsumi", 4), ("Oluwaseun Adebayo", 5), ("ADEBAYO Oluwaseun", 5),
        ("Zofia Wisniewska", 6), ("Wiśniewska, Zofia", 6), ("Astrid Moretti", 7),
    ]
    assert groups(entities(spark, [n for n, _ in names])) == groups({i: e for i, (_, e) in enumerate(names)})


def test_split_cells_give_the_same(spark, monkeypatch):
    from quillguard.llm import p4_names as P4

    rng = random.Random(5)
    names = [f"{g} {slips(rng, f, rng.randint(0, 2))}" for g in ("Karima", "K.", "Stephen") for f in ("Brudwimpal", "Zoltanekov") for _ in range(8)]
    whole = groups(entities(spark, names))
    monkeypatch.setattr(P4, "KEYS", 100)
    assert groups(entities(spark, names)) == whole


def test_given_names_are_learned(spark, data, monkeypatch):
    """Held-out recall with half of the given names and their short forms taken off the list."""
    from quillguard.llm import p4_names as P4

    rows = {r["name_id"]: r["candidate_name"] for r in spark.read.parquet(f"{data.replace('0.001', '0.1')}/candidate_names.parquet").dropna(subset=["candidate_name"]).collect()}
    df = spark.createDataFrame(list(rows.items()), "name_id long, name string")
    run = lambda: groups({r["name_id"]: r["entity"] for r in P4.resolve(df, "name_id", "name").collect()})
    pairs = lambda gs: {(a, b) for g in gs for a in g for b in g if a < b}
    whole = run()
    unknown = set(sorted(N._VARIANTS)[::2])
    held = {k for k, n in rows.items() if (p := N.parse(n)) and p[0][1] in unknown}
    monkeypatch.setattr(N, "known", lambda p=N.Pivots({k: v for k, v in N.PIVOTS.items() if v not in unknown}): p)
    local = {k: N.parse(n) for k, n in rows.items() if k in held}
    monkeypatch.setattr(P4, "points", lambda d, k, n: spark.createDataFrame([(i, *p[0][:2], [x[1] for x in p[1:]], p[0][2]) for i, t in rows.items() if (p := N.parse(t))], "name_id long, kind string, cell string, alts array<string>, core string"))
    want, got = ({p for p in pairs(g) if p[0] in held} for g in (whole, run()))
    assert len(local) > 1000 and len(want & got) / len(want) > 0.9 and len(want & got) / len(got) > 0.99


def learned_in_python(names):
    """Given names and their forms from all names, each a list of words."""
    beside = {}
    for ws in {tuple(sorted(n)) for n in names}:
        for w in ws:
            beside.setdefault(w, set()).update(x for x in ws if x != w)
    families, both, group = Tally(), Tally(), {}
    for ws in beside.values():
        if 2 <= len(ws) <= N.RARE:
            families.update(ws)
            both.update((a, b) for a in ws for b in ws if a < b)
    for (a, b), n in both.items():
        if n >= N.LEARN_FAMILIES and 4 * n >= min(families[a], families[b]):
            one = group.get(a, {a}) | group.get(b, {b})
            group |= {w: one for w in one}
    forms = {w: min(g, key=lambda x: (-families[x], x)) for w, g in group.items()}
    return {w: w for w, n in families.items() if n >= N.LEARN_GIVEN} | forms


def made_up_names():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("bdfgkmprtvz") + rng.choice("aeiou") for _ in range(n))
    given = [[word(4), word(2) + "x"] for _ in range(12)]
    given[1].append(given[0][1])  # one short form of two names
    return [(f"{rng.choice(given[k])} {f}", (k, f)) for f in (word(5) for _ in range(150)) for k in rng.sample(range(12), 2) for _ in range(3)]


def test_given_names_are_learned_from_all_names(spark, monkeypatch):
    """All rare words count, whatever a bound on them was."""
    from quillguard.llm import p4_names as P4

    monkeypatch.setattr(P4, "FIT_NAMES", 5, raising=False)
    names = [n for n, _ in made_up_names()]
    pts = P4.materialize(P4.points(spark.createDataFrame(list(enumerate(names)), "name_id long, name string"), "name_id", "name"))
    free = {r["name_id"]: r["core"].split(" ") for r in pts.where("cell = 'U'").collect()}
    forms = learned_in_python(free.values())
    assert len(forms) > 20 and len(set(forms.values())) < len(forms)
    pivots = N.Pivots(forms)
    want = {k: sorted({c for _, c, _ in N.recast("P", "U", " ".join(ws), pivots)}) for k, ws in free.items()}
    got = {r["name_id"]: sorted({r["cell"], *r["alts"]}) for r in P4.learned(pts).collect() if r["name_id"] in free}
    assert got == want


def test_many_given_names_give_the_same(spark, monkeypatch):
    """Learned forms met by a join move the names to the cells to which an index in every worker moves them."""
    from quillguard.llm import p4_names as P4

    rng = random.Random(12)
    names = [n for n, _ in made_up_names()]
    names += [slips(rng, n.split(" ")[0], 1) + " " + n.split(" ")[1] for n in names[:200]] + ["Groupe Braclizdeg Chichoucgrip", "Karima Brudwimpal", "K. Brudwimpal"]
    pts = P4.materialize(P4.points(spark.createDataFrame(list(enumerate(names)), "name_id long, name string"), "name_id", "name"))
    run = lambda: sorted(tuple(map(str, r)) for r in P4.learned(pts).collect())
    whole, found = run(), groups(entities(spark, names))
    assert len(whole) == len(names) and whole != sorted(tuple(map(str, r)) for r in pts.collect())
    monkeypatch.setattr(P4, "SHIPPED", 0)
    monkeypatch.setattr(P4, "SMALL", 0)
    assert run() == whole and groups(entities(spark, names)) == found


def test_blocks_list_each_pair_once(spark, monkeypatch):
    from quillguard.llm import p4_names as P4

    monkeypatch.setattr(P4, "BLOCK", 7)
    m = spark.range(60).selectExpr("id name_id", "case when id < 50 then 'a' else concat('b', id) end entity")
    got = [tuple(r) for r in P4.pairs(m, "name_id").collect()]
    assert len(got) == len(set(got)) == 50 * 49 // 2


def test_best_fit_loses_nothing():
    rng = random.Random(6)
    items = [(rng.randint(0, 100), [i]) for i in range(2000)]
    bins = best_fit(items, 100)
    assert sorted(x for _, c in bins for x in c) == list(range(2000))
    size = {i: s for s, (i,) in items}
    assert all(sum(size[x] for x in c) == fill <= 100 for fill, c in bins)
    assert sum(s for s, _ in items) / (100 * len(bins)) > 0.97


def test_packing(spark):
    from quillguard.llm import p6_packing as P6

    rng = random.Random(8)
    rows = [(i, " ".join(["word"] * rng.randint(0, 90)), 1) for i in range(400)] + [(400, None, 1), (401, "word " * 500, 1), (3, None, 1)]
    rows = rows[:-1] + [rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fill int").repartition(5)
    limits = spark.createDataFrame([("s", 64), ("m", 256), ("bad", None), (None, 5)], "limit_name string, capacity_tokens int")
    out = P6.pack(docs, limits).toPandas()
    c = Counter(open(DEFAULT_VOCABULARY, 'rb').read())
    for limit, cap in (("s", 64), ("m", 256)):
        o = out[out.limit_name == limit]
        assert o.groupby("doc_id").n_tokens.sum().to_dict() == {i: c(t) for i, t, _ in rows}
        assert (o.groupby("container_id").n_tokens.sum() <= cap).all()
        whole = o.groupby("doc_id").piece_no.count()
        assert all((n > 1) == (c(dict((i, t) for i, t, _ in rows)[i]) > cap) for i, n in whole.items())
        assert o.n_tokens.sum() / (cap * o.container_id.nunique()) > 0.9
    assert P6.pack(docs.limit(0), limits).count() == 0


def test_later_rounds_are_bounded():
    """Items of 51 to 97 % of the capacity never share a container; still all but OPEN and one leave in the first round."""
    from quillguard.llm import p6_packing as P6

    rng = random.Random(3)
    for sizes in ([rng.randint(51, 97) for _ in range(5000)], [rng.randint(1, 50) for _ in range(5000)], [0] * 5000, [100] * 50, [1]):
        rows = P6._pack("x", 100, [(n, [(i, 0, n)]) for i, n in enumerate(sizes)])
        assert sorted(c[0] for r in rows for c in r[3]) == list(range(len(sizes)))
        assert sum(not r[2] for r in rows) <= P6.OPEN + 1
        assert all(sum(c[2] for c in r[3]) == r[1] <= 100 for r in rows)
        assert all(r[2] for r in P6._pack("x", 100, [(n, [(i, 0, n)]) for i, n in enumerate(sizes)], True))


def test_counts_are_those_of_the_tokenizer():
    c = Counter(open(DEFAULT_VOCABULARY, 'rb').read())
    for t in ("", "a b", "l'été, déjà vu.\nNow  two", " lead", "tail ", "مرحبا بكم", "a\tb", "x \n y", "don't we'll", "1 234,5"):
        assert c(t) == len(c.encode(t)), t


ITEM = "a night porter counts forty torn badges below the tram shed then every applicant numbers seventeen stamped portraits behind the harbour kiosk and rejects sixty envelopes"


def altered(rng, ws, every):
    out = []
    for i, w in enumerate(ws):
        r = rng.random() if i % every == every // 2 else 1
        out += [] if r < 0.3 else ["zzz"] if r < 0.6 else [w, "zzz"] if r < 0.9 else [w]
    return out


def test_leaks_are_found():
    rng = random.Random(9)
    index = W.Index([(1, ITEM), (2, "quite another passage of the test set that no document holds in any form at all today")])
    ws = words(ITEM)
    for _ in range(300):
        n = rng.randint(16, len(ws))
        a = rng.randint(0, len(ws) - n)
        part = altered(rng, ws[a : a + n], 9)
        filler = [rng.choice(["plan", "office", "the", "van"]) for _ in range(40)]
        text = " ".join(filler[:20] + part + filler[20:]).upper().replace(" ", rng.choice([" ", "\n", ", "]))
        assert [h[0] for h in index.search(text)] == [1]


@pytest.mark.parametrize("places", [[k] for k in range(1, 15)] + [[2, 13], [3, 12], [2, 3], [12, 13], [2, 8]])
def test_leaks_altered_near_an_end(places):
    """Sixteen words of an item, of which any one or two between the ends are altered."""
    index = W.Index([(1, ITEM)])
    ws = words(ITEM)
    for a in range(len(ws) - 15):
        part = ["zzz" if k in places else w for k, w in enumerate(ws[a : a + 16])]
        got = index.search("the office sold " + " ".join(part) + " by phone")
        assert got == [(1, 16 - len(places), 16, 3, 18)]


def test_every_stretch_of_an_item_is_listed():
    """An item that leaked twice, in two pieces in either order, and in two pieces on neighbouring diagonals."""
    index = W.Index([(1, ITEM + " " + ITEM.translate(str.maketrans("aeio", "oiea")))])
    ws = index.items[1]
    n = len(ws) // 2
    text = lambda ids: " ".join(next((w for w, k in index.vocabulary.items() if k == x), "zzz") for x in ids)
    for parts in ([ws[:18], ws[:18]], [ws[:18], ws[n : n + 18]], [ws[n : n + 18], ws[:18]]):
        got = index.search(text([0] * 5 + parts[0] + [0] * 50 + parts[1] + [0] * 5))
        assert sorted(h[3:] for h in got) == [(5, 22), (73, 90)]
    got = index.search(text(ws[:18] + [0] * 9 + ws[n : n + 18]))
    assert sorted(h[3:] for h in got) == [(0, 17), (27, 44)]


def test_short_stretches_are_no_leaks():
    index = W.Index([(1, ITEM)])
    ws = words(ITEM)
    for a in range(len(ws) - 9):
        assert index.search("the office sold it. " + " ".join(ws[a : a + 9]) + " by hand and by phone.") == []
    assert index.search(None) == index.search("") == []
    assert W.Index([]).search(ITEM) == []


def test_winnowing_meets_every_long_run():
    rng = random.Random(3)
    a = [rng.randint(1, 9) for _ in range(60)]
    for start in range(0, 50):
        b = [99] * 7 + a[start : start + W.K + W.WINDOW - 1] + [98] * 7
        mine = {g for _, g in W.winnow(b)}
        theirs = {tuple(a[i : i + W.K]) for i in range(len(a) - W.K + 1)}
        assert mine & theirs


def test_leak_rows(spark):
    from quillguard.llm import p7_leakage as P7

    docs = spark.createDataFrame([(1, ITEM, "q"), (1, ITEM, "q"), (2, None, "q"), (3, "", "q"), (4, "x " * 50_000, "q")], "doc_id long, text string, item_id string").select("doc_id", "text", "item_id")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, None)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in P7.leaks(docs.drop("item_id"), items).collect()} == {(1, 7)}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=300)
    y = np.clip(np.round(2.5 + x + rng.normal(scale=0.5, size=300)), 1, 4)
    knots = R.isotonic(x, y)
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(knots, knots[1:]))


def test_levels_held_out(spark, data):
    """Held-out accuracy on the rated documents of the smallest tables that agree."""
    from quillguard.llm import p8_reading as P8

    read = lambda n: spark.read.parquet(f"{data.replace('0.001', '0.01')}/{n}.parquet")
    docs, labels, items = read("documents"), read("reading_labels"), read("eval_items")
    grades = {r["doc_id"]: r["grade"] for r in P8.grades(labels).collect()}
    held = sorted(grades)[::3]
    train = labels.where(~labels.doc_id.isin(held))
    got = {r["doc_id"]: r["reading_level"] for r in P8.levels(docs, train, items).collect()}
    pairs = [(got[i], grades[i]) for i in held if i in got]
    assert len(pairs) > 30
    assert sum(abs(a - b) <= 0.5 for a, b in pairs) / len(pairs) > 0.85
    assert P8.levels(docs, labels.limit(0), items).count() == 0


def test_leaks_are_left_out(spark, monkeypatch):
    """Levels do not depend on how the test items are searched; words leaked from two items count once."""
    from quillguard.llm import p7_leakage as P7
    from quillguard.llm import p8_reading as P8

    other = "one tall clerk weighs eleven muddy parcels under that iron bridge before any trader signs thirty faded ledgers near this quiet mill and burns nineteen letters"
    docs = spark.createDataFrame([(1, "We sold it. " * 15 + ITEM + ". " + other + "."), (2, "We sold it. " * 15)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, other), (3, other)], "item_id long, text string")
    for most in (20_000, 1):
        monkeypatch.setattr(P7, "MAX_ITEMS", most)
        rows, tests = P8.with_spans(docs, items, "doc_id", "text")
        index = W.Index(tests.value) if tests else None
        rows = {r["doc_id"]: r for r in rows.collect()}
        n = len(words(ITEM))
        assert len(rows) == 2 and P8.skipped(index, rows[2]["text"], rows[2]["spans"]) == []
        assert P8.skipped(index, rows[1]["text"], rows[1]["spans"]) == [(45, 45 + n + len(words(other)))]


def test_large_test_sets_give_the_same(spark, data, monkeypatch):
    """Fingerprints joined in Spark find what the index in every worker finds, and the levels stay."""
    from quillguard.llm import p7_leakage as P7
    from quillguard.llm import p8_reading as P8

    read = lambda n: spark.read.parquet(f"{data.replace('0.001', '0.01')}/{n}.parquet")
    found = lambda: {tuple(r) for r in P7.leaks(read("documents"), read("eval_items")).collect()}
    run = lambda: {tuple(r) for r in P8.levels(read("documents"), read("reading_labels"), read("eval_items")).select("doc_id", "score", "reading_level").collect()}
    leaks, levels = found(), run()
    monkeypatch.setattr(P7, "MAX_ITEMS", 100)
    assert found() == leaks and len(leaks) > 20
    assert run() == levels


def test_features_of_odd_texts():
    assert R.features("") is None and R.features("...") is None
    assert R.features("one. " * 100_000) is not None


@pytest.mark.parametrize("quote", ["... notwithstanding heretofore, applicable provisions ...", "… notwithstanding the provisions", "heretofore applicable...", "... one. two ..."])
def test_quotes_and_leaks_are_left_out_together(quote):
    plain, leak = "We sold the van. It was old, but it ran well.", "A night porter counts forty torn badges. He rejects sixty."
    want = R.features(plain + "\n" + plain)
    a, n, q = len(words(plain)), len(words(leak)), len(words(quote))
    for parts, at in (([plain, quote, leak, plain], a + q), ([plain, leak, quote, plain], a), ([quote, plain, leak, plain, quote], q + a)):
        text = "\n".join(parts)
        assert R.features(text, [(at, at + n)]) == want
        assert R.features(text.replace(leak, ""), []) == want


def test_common_subsequence():
    rng = random.Random(12)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        masks = {w: sum(1 << i for i, x in enumerate(b) if x == w) for w in set(b)}
        assert W.common_in_order(a, masks, len(b)) == d[-1][-1]
