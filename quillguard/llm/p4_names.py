"""Variant spellings of names typed by people (problem 4): metric-space partitioning.

A name is a point: its given-name token lies near one of a fixed set of pivots (given names, or kinds of
organisation), its core is the family name (or the organisation's own words).  The nearest pivot is the
name's cell; by the triangle inequality a boundary name is replicated to every other pivot that a spelling
of the same name could be nearest to, and names that give only an initial, or one word, have cells of their
own into which full names are replicated.  Names without a pivot share a cell in which all their words count,
whatever their order.  Inside each cell an exact radius join with a true edit metric links spellings; a cell
of many spellings is split by the letters-taken-out keys that two spellings within the radius must share, so
no task holds more than a bounded part of it and no pair within the radius is lost.

Of all spellings of full names within the radius, each stands for the nearest that has more records (of like
numbers, the first by letters), and one that has none is a name of its own; so a chain of slips does not join
two names, and the same records copied a hundred times give the same entities.  A name that gives less, or
that lies between two pivots, joins the nearest full name, of equals the one with more records.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import names as N
from .common import SMALL, map_rows, materialize, salted_join, table

KEYS = 400_000  # keys of a cell that are compared in one task; a cell of more is split by them
SHIPPED = 50_000  # learned forms of given names up to which they are an index in every worker
BLOCK = 500  # records of an entity that meet in one task when pairs are listed
CORE, BARE, SEEN = "core", "bare", "seen"  # full names, names that look for one, and full names shown to those


def points(df: DataFrame, key: str, name: str) -> DataFrame:
    """Spelling of each record: key, kind, cell, alts (other pivots), core.

    Null and letterless names give none.
    """

    def make():
        def f(c):
            out = {n: [] for n in (key, "kind", "cell", "alts", "core")}
            for k, text in zip(c[key], c[name]):
                if p := N.parse(text):
                    for n, x in zip(out, (k, p[0][0], p[0][1], [x[1] for x in p[1:]], p[0][2])):
                        out[n].append(x)
            return out

        return f

    kind = dict(df.dtypes)[key]
    rows = map_rows(df.select(key, name).where(F.col(name).isNotNull()), make, f"{key} {kind}, kind string, cell string, alts array<string>, core string")
    return rows


def given_names(pts: DataFrame) -> DataFrame:
    """Given names learned from all names without a pivot, with the short and variant forms of each: word, pivot.

    A word that stands beside many rare words (family names, as a rule) is a given name; two that stand in turn
    beside the same rare words are one, named by the more frequent form.
    """
    free = pts.where("cell = 'U'").select("core").distinct()
    words = materialize(free.select("core", F.explode(F.split("core", " ")).alias("word")).select("word", F.explode(F.array_except(F.split("core", " "), F.array("word"))).alias("other")).distinct())
    rare = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n").between(2, N.RARE)).select("word")
    beside = materialize(words.join(rare, "word", "left_semi").groupBy("word").agg(F.collect_set("other").alias("others")))  # at most RARE each
    families = materialize(beside.select(F.explode("others").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    pair = beside.select(F.explode("others").alias("a"), "others").select("a", F.explode("others").alias("b")).where("a < b")
    often = pair.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= N.LEARN_FAMILIES)
    size = lambda c: families.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    edges = materialize(often.join(size("a"), "a").join(size("b"), "b").where(4 * F.col("n") >= F.least("n_a", "n_b")).select("a", "b"))
    alone = families.where(F.col("n") >= N.LEARN_GIVEN).select("word")
    if edges.isEmpty():
        return alone.withColumn("pivot", F.col("word"))
    groups = materialize(components(edges).withColumnRenamed("node", "word"))
    named = groups.join(families, "word").groupBy("root").agg(F.min(F.struct(-F.col("n"), "word"))["word"].alias("pivot"))
    return alone.join(groups, "word", "left_anti").withColumn("pivot", F.col("word")).unionByName(groups.join(named, "root").select("word", "pivot"))


def learned(pts: DataFrame) -> DataFrame:
    """Points with given names learned from the names without a pivot; the others stay.

    Up to SHIPPED learned forms are an index in every worker; more are met by a join, with the same result.
    """
    forms = materialize(given_names(pts))
    few = {r["word"]: r["pivot"] for r in forms.limit(SHIPPED + 1).collect()}
    if not few:
        return pts
    if len(few) > SHIPPED:
        return joined_points(pts, forms)
    shared = pts.sparkSession.sparkContext.broadcast(few)

    def make():
        pivots = N.Pivots(shared.value)

        def f(c):
            out = {n: [] for n in c}
            for row in zip(*c.values()):
                r = dict(zip(c, row))
                if " " in r["core"] and r["kind"] != "O":
                    p = N.recast(r["kind"], r["cell"], r["core"], pivots)
                    r |= {"cell": p[0][1], "alts": [x[1] for x in p[1:]], "core": p[0][2]}
                for n, x in r.items():
                    out[n].append(x)
            return out

        return f

    return map_rows(pts, make, ", ".join(f"{n} {t}" for n, t in pts.dtypes))


def joined_points(pts: DataFrame, forms: DataFrame) -> DataFrame:
    """``learned`` where the forms (word, pivot) do not fit in a worker: words and forms meet by letters taken out."""

    def keys(of: str, radius):
        def make():
            def f(c):
                out = {n: [] for n in (*c, "key")}
                for row in zip(*c.values()):
                    word = row[0]
                    for k in N.deletions(word, radius(word)):
                        for n, x in zip(out, (*row, k)):
                            out[n].append(x)
                return out

            return f

        return lambda df: map_rows(df, make, of)

    def measured():
        def f(c):
            rows = [(w, d, p) for w, x, p in zip(c["word"], c["form"], c["pivot"]) if (d := N.form_distance(w, x)) is not None]
            return dict(zip(("word", "d", "pivot"), map(list, zip(*rows)) if rows else ([], [], [])))

        return f

    def recast():
        def f(c):
            out = {n: [] for n in ("core", "new_cell", "new_alts", "new_core")}
            for core, hits in zip(c["core"], c["hits"]):
                near = {h["word"]: N.nearest([(x["d"], x["pivot"]) for x in h["near"]]) for h in hits}
                p = N.recast("", "", core, SimpleNamespace(near=lambda w: near.get(w, ())))
                for n, x in zip(out, (core, p[0][1], [x[1] for x in p[1:]], p[0][2])):
                    out[n].append(x)
            return out

        return f

    cores = pts.where("kind <> 'O' and instr(core, ' ') > 0").select("core").distinct()
    held = materialize(cores.select("core", F.explode(F.array_distinct(F.split("core", " "))).alias("word")))
    mine = keys("word string, key string", N.pivot_radius)(held.select("word").distinct())
    theirs = keys("form string, pivot string, key string", lambda _: 2)(forms.select(F.col("word").alias("form"), "pivot"))
    met = map_rows(mine.join(theirs, "key").select("word", "form", "pivot").distinct(), measured, "word string, d int, pivot string")
    near = materialize(met.groupBy("word").agg(F.collect_set(F.struct("d", "pivot")).alias("near")))
    hits = salted_join(held, near, "word", "core").where("near is not null").groupBy("core").agg(F.collect_list(F.struct("word", "near")).alias("hits"))
    new = materialize(map_rows(hits, recast, "core string, new_cell string, new_alts array<string>, new_core string"))
    moved = (F.col("kind") != "O") & F.col("new_cell").isNotNull()
    found = salted_join(pts, new, "core", pts.columns[0])
    return found.select(*[F.when(moved, F.col(f"new_{n}")).otherwise(F.col(n)).alias(n) if n in ("cell", "alts", "core") else n for n in pts.columns])


def visits(kind: str, cell: str, alts: list[str], core: str) -> list[tuple[str, str, str, int]]:
    """Cells in which a spelling is compared: (cell, core there, role, order of preference)."""
    if kind == "O":
        return [(f"O:{cell}", core, CORE, 0)]
    if " " in core and cell != "U":
        return [(f"{kind}{cell}", core.replace(" ", ""), BARE, 0), (f"{kind}=U", " ".join(sorted(core.split(" "))), BARE, 1)]
    if cell.startswith("I:") or cell in ("F", "G"):
        return [(f"{kind}{cell}", core, BARE, 0)]
    if alts:
        return [(f"{kind}={c}", core, BARE, i) for i, c in enumerate((cell, *alts))]
    out = [(f"{kind}={cell}", core, CORE, 0)]
    if cell != "U":
        return [*out, (f"{kind}I:{cell[0]}", core, SEEN, 0), (f"{kind}F", core, SEEN, 0)]
    words = core.split(" ")
    for i, w in enumerate(words[: N.MOST_WORDS]):  # any of the words may be the given name
        rest = "".join(words[:i] + words[i + 1 :])
        out += [(f"{kind}I:{w[0]}", rest, SEEN, 1), (f"{kind}F", rest, SEEN, 1)]
    return out


_ROWS = "bucket string, part int, parts int, node bigint, kind string, core string, role string, prefer int, support bigint"


def placed(nodes: DataFrame) -> DataFrame:
    """Spellings in all cells that they visit; cells of more than KEYS keys are split by hashed key.

    Full names are shown in the cells of initials and single words only where a name of that cell looks for one.
    """

    def make():
        def f(c):
            out = {n: [] for n in ("bucket", "n_keys", "node", "kind", "core", "role", "prefer", "support")}
            for node, kind, cell, alts, core, support in zip(*(c[x] for x in ("node", "kind", "cell", "alts", "core", "support"))):
                for bucket, core_, role, prefer in visits(kind, cell, alts, core):
                    for n, x in zip(out, (bucket, N.key_count(kind, core_), node, kind, core_, role, prefer, support)):
                        out[n].append(x)
            return out

        return f

    whole = materialize(map_rows(nodes.select("node", "kind", "cell", "alts", "core", "support"), make, _ROWS.replace("part int, parts int", "n_keys bigint")))
    cells = whole.groupBy("bucket").agg(F.sum("n_keys").alias("n"), F.max(F.col("role") != SEEN).alias("any"))
    parts = materialize(cells.where("any").select("bucket", (F.floor(F.col("n") / KEYS) + 1).cast("int").alias("parts")))

    def split():
        def f(c):
            out = {n: [] for n in ("bucket", "part", "parts", "node", "kind", "core", "role", "prefer", "support")}
            for bucket, n, node, kind, core, role, prefer, support in zip(*(c[x] for x in ("bucket", "parts", "node", "kind", "core", "role", "prefer", "support"))):
                for part in (0,) if n == 1 else {N.stable(k) % n for k in N.keys(kind, core)}:
                    for name, x in zip(out, (bucket, part, n, node, kind, core, role, prefer, support)):
                        out[name].append(x)
            return out

        return f

    if parts.limit(SMALL + 1).count() <= SMALL:
        whole = whole.join(F.broadcast(parts), "bucket")
    else:
        whole = salted_join(whole, parts, "bucket", "node", whole).where("parts is not null")
    return map_rows(whole, split, _ROWS)


def near(kind: str, rows: list[tuple], parts: int = 1, part: int = 0) -> Iterator[tuple[int, int, int]]:
    """Exact radius join of a cell (or of a part of one): places i < j of rows (node, core, role, ...) and distance.

    Pairs with a full name that is only shown are left out unless the other one looks for a full name.
    """
    groups: dict[str, list[int]] = {}
    shown: dict[str, list[int]] = {}
    for i, row in enumerate(rows):
        for k in N.keys(kind, row[1]):
            if parts == 1 or N.stable(k) % parts == part:
                (shown if row[2] == SEEN else groups).setdefault(k, []).append(i)
    met: dict[int, set[int]] = {}
    for k, group in groups.items():
        others = shown.get(k, ())
        if len(group) < 2 and not others:
            continue
        for x, i in enumerate(group):
            mine = met.setdefault(i, set())
            for j in (*group[:x], *others):
                if j not in mine:
                    mine.add(j)
                    if (j < i or rows[j][2] == SEEN) and (d := N.within(kind, rows[i][1], rows[j][1])) is not None:
                        yield (min(i, j), max(i, j), d)


def chosen_links(kind: str, rows: list[tuple], parts: int, part: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Links of a cell, whose rows (node, core, role, prefer, support) are sorted by falling support: node, other,
    distance, rank, full (2: a full name and the nearest with more records, 1: a name that looks for a full one
    and the nearest, 0: two names that look for one)."""
    best: dict[int, tuple] = {}
    for i, j, d in near(kind, rows, parts, part):
        if rows[i][2] == rows[j][2] == BARE:
            if rows[i][0] != rows[j][0]:
                yield rows[i][0], rows[j][0], d, 0, 0
            continue
        if rows[j][2] != BARE and rows[i][2] == BARE:
            i, j = j, i
        if rows[i][0] == rows[j][0]:
            continue
        # now j stands for i: i is higher, or j looks for a full name
        rank = (1000 * (rows[i][3] + rows[j][3]) + d, -rows[i][4], rows[i][1], rows[i][0])
        if j not in best or rank < best[j]:
            best[j] = rank
    for j, (d, support, _, other) in best.items():
        yield rows[j][0], other, d, support, 1 if rows[j][2] == BARE else 2


def links(nodes: DataFrame) -> DataFrame:
    """Links of all cells: node, other, distance, rank, full; see ``chosen_links``."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    fields = ("node", "other", "distance", "rank", "full")

    def run(t: pa.Table) -> pa.Table:
        c = {n: t.column(n).to_pylist() for n in ("node", "core", "role", "prefer", "support")}
        kind, parts, part = (t.column(n)[0].as_py() for n in ("kind", "parts", "part"))
        rows = sorted(zip(*c.values()), key=lambda r: (-r[4], r[1], r[0]))
        columns = list(zip(*chosen_links(kind, rows, parts, part))) or [()] * 5
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=fields)

    spark = nodes.sparkSession  # a number of partitions of its own: the rows are few and small, but each costs time
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return placed(nodes).repartition(n, "bucket", "part").groupBy("bucket", "part").applyInArrow(run, "node bigint, other bigint, distance int, rank bigint, full int")


def components(edges: DataFrame) -> DataFrame:
    """Connected nodes and the least node of their component: node, root.  Nodes without an edge give no row."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    now = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")))
    while True:
        near = both.join(now.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = now.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("ahead"))  # the root's own root
        new = materialize(step.join(ahead, "root", "left").select("node", "old", F.least("root", F.coalesce("ahead", "root")).alias("root")))
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        now = new.select("node", "root")


def is_bare() -> Column:
    """Whether a spelling looks for a full name: an initial, one word, or a name between two pivots."""
    return (F.col("kind") != "O") & (F.col("cell").rlike("^(I:|F$|G$)") | (F.size("alts") > 0))


def resolve(df: DataFrame, key: str, name: str) -> DataFrame:
    """Entity of each record: key, entity (number).  A record with several names (rows) denotes one entity.

    Records without a name give no row; equal names in whatever case, order, script form or with whatever
    title fall together.
    """
    return _resolved(df, key, name)[0]


def _resolved(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    pts = learned(materialize(points(df, key, name)))
    pts = materialize(pts.withColumn("node", F.xxhash64("kind", "cell", "alts", "core")).withColumn("bare", is_bare()))
    spelt = ["node", "kind", "cell", "alts", "core"]
    nodes = pts.groupBy(*spelt).agg(F.count("*").alias("support"))
    found = materialize(links(nodes))

    # names of one record: full ones are one entity, others join it unless another full name is near
    own = pts.select(key, "kind", "node", "bare")
    least = F.min("node").alias("least")
    several = own.groupBy(key, "kind").agg(F.min(F.when(~F.col("bare"), F.col("node"))).alias("full"), least, F.max("node").alias("most")).where("least <> most").drop("most")
    beside = own.join(several, [key, "kind"]).select("node", "bare", "full", "least").distinct()
    by_record = materialize(
        beside.where(F.col("node") != F.coalesce("full", "least")).select(
            "node", F.coalesce("full", "least").alias("other"), F.lit(1_000_000).alias("distance"), F.lit(0).cast("bigint").alias("rank"),
            F.when(~F.col("bare"), 2).when(F.col("full").isNotNull(), 1).otherwise(0).alias("full"),
        )
    )
    every = found.unionByName(by_record)
    stands = found.where("full = 2").groupBy("node").agg(F.min_by("other", F.struct("distance", "rank", "other")).alias("other"))
    stands = stands.unionByName(by_record.where("full = 2").select("node", "other"))
    chosen = materialize(every.where("full = 1").groupBy("node").agg(F.min_by("other", F.struct("distance", "rank", "other")).alias("other")))
    free = every.where("full = 0").select(F.col("node").alias("a"), F.col("other").alias("b"), "distance")
    free = free.unionByName(free.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    has = chosen.select(F.col("node").alias("b"), F.col("other").alias("via"))
    free = materialize(free.join(chosen.select(F.col("node").alias("a")), "a", "left_anti").join(has, "b", "left"))
    roots = components(stands.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(free.where("via is null").select("a", "b")))

    root_of = lambda d, c: d.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    # names that are near a name which found a full one, but near none themselves, follow the nearest
    follow = root_of(root_of(free.where("via is not null"), "a"), "via").groupBy("a").agg(F.min_by("via", F.struct("distance", "via")).alias("to"))
    own_root = roots.join(follow.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("entity"))
    alone = follow.join(roots.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("to").alias("entity"))
    entity = own_root.unionByName(alone).unionByName(root_of(chosen, "other").select("node", F.col("other").alias("entity")))
    # one spelling may be that of a third of all records
    out = salted_join(pts.select(key, "node", "bare"), materialize(entity), "node", key, pts).groupBy(key).agg(F.min(F.struct("bare", F.coalesce("entity", "node").alias("entity")))["entity"].alias("entity"))
    return out, nodes.join(entity, "node", "left").withColumn("entity", F.coalesce("entity", "node"))


def pairs(members: DataFrame, key: str) -> DataFrame:
    """All pairs of records of each entity, smaller key first; large entities meet block by block."""
    sized = members.withColumn("b", F.pmod(F.xxhash64(key), F.lit(1 << 20)))
    size = members.groupBy("entity").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    m = sized.join(size, "entity").withColumn("mine", F.pmod("b", "blocks").cast("int"))
    a = m.select("entity", F.col("mine").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col(key).alias("x"))
    b = m.select("entity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("mine").alias("j"), F.col(key).alias("y"))
    # i and j run over ordered pairs of blocks, so each unordered pair of records is met with either first
    return a.join(b, ["entity", "i", "j"]).where(F.col("x") < F.col("y")).select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"))


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of both tables: name_id, name; repeated rows fall together when they are resolved."""
    one = table(spark, sf_dir, "candidate_names").select("name_id", F.col("candidate_name").alias("name"))
    many = table(spark, sf_dir, "dossier_identities").select("name_id", F.explode("cand_names").alias("name"))
    return one.unionByName(many).where(F.col("name").isNotNull())


def p4_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity of each name record: its most frequent spelling, and the number of its records."""
    m, nodes = _resolved(sightings(spark, sf_dir), "name_id", "name")
    m = materialize(m)
    named = nodes.groupBy("entity").agg(F.max_by(F.concat_ws("|", "kind", "cell", "core"), F.struct(~is_bare(), "support", "node")).alias("name"))
    size = m.groupBy("entity").agg(F.count("*").alias("entity_size"))
    return m.join(named.join(size, "entity"), "entity").select("name_id", F.col("name").alias("entity"), "entity_size")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that denote the same person or organisation."""
    return pairs(materialize(resolve(sightings(spark, sf_dir), "name_id", "name")), "name_id")
