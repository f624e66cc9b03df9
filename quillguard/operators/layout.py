"""Boxes on pages: layout candidates, containment, unions, bands, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import lexicon as lx
from ..functions import text as T

TOP = 0.40  # share of the page in which names, header images and header blocks are looked for
TOP_OCR = 0.38


def words_of(pages: DataFrame, key: list[str], text: str, char_width: float = 6.0, line_height: float = 12.0) -> DataFrame:
    """Words with the boxes that a fixed-width rendering of the text gives them."""
    lines = pages.where(F.col(text).isNotNull()).select(*key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = lines.select(*key, "line_no", "line", F.posexplode(F.split("line", " ")).alias("word_no", "word"))
    before = F.aggregate(F.slice(F.split("line", " "), 1, F.col("word_no")), F.lit(0), lambda a, x: a + F.length(x) + 1)
    w = w.withColumn("start", before).where("word <> ''")
    x0 = F.col("start") * char_width
    y0 = F.col("line_no") * line_height
    return w.select(*key, "line_no", "word_no", "word", "start", G.rect(x0, y0, x0 + F.length("word") * char_width, y0 + line_height).alias("rect"))


def maximal(boxes: DataFrame, page: list[str], id_: str = "id", rect: str = "rect") -> DataFrame:
    """Boxes that no other box of the page contains; of equal boxes the one with the lowest id."""
    a, b = boxes.alias("a"), boxes.select(*page, id_, rect).alias("b")
    ra, rb = F.col(f"a.{rect}"), F.col(f"b.{rect}")
    same = F.lit(True)
    for k in page:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    on = same & (F.col(f"a.{id_}") != F.col(f"b.{id_}")) & G.contains(rb, ra) & ((ra != rb) | (F.col(f"b.{id_}") < F.col(f"a.{id_}")))
    return a.join(b, on, "left_anti")


def outside(boxes: DataFrame, others: DataFrame, page: list[str], rect: str = "rect") -> DataFrame:
    """Boxes that touch none of the others on their page (faces against images found before)."""
    a, b = boxes.alias("a"), others.select(*page, rect).alias("b")
    on = G.intersects(F.col(f"a.{rect}"), F.col(f"b.{rect}"))
    for k in page:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, on, "left_anti")


def union_boxes(boxes: DataFrame, page: list[str], rect: str = "rect") -> DataFrame:
    """Overlapping boxes joined transitively: page, x0, y0, x1, y1, n.

    Works by sweeping: boxes of a page sorted by x0 split where no earlier box reaches, then by y likewise,
    again and again until nothing splits further; what is left overlaps only through its bounding boxes and
    is settled by label spreading within the part.
    """
    import pandas as pd

    kinds = dict(boxes.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in page) + ", x0 double, y0 double, x1 double, y1 double, n bigint"
    flat = boxes.select(*page, *[F.col(f"{rect}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    order = Window.partitionBy(*page).orderBy("x0", "y0", "x1", "y1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    strips = flat.withColumn("cut", F.when(reach.isNull() | (F.col("x0") >= reach), 1).otherwise(0)).withColumn("strip", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None))
        parent = list(range(len(rows)))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        active: list[int] = []
        for i, (x0, y0, x1, y1) in enumerate(rows):
            active = [j for j in active if rows[j][2] > x0]
            for j in active:
                if rows[j][1] < y1 and y0 < rows[j][3]:
                    parent[find(i)] = find(j)
            active.append(i)
        groups: dict[int, list] = {}
        for i, r in enumerate(rows):
            groups.setdefault(find(i), []).append(r)
        head = [pdf[k].iloc[0] for k in page]
        out = [(*head, min(r[0] for r in g), min(r[1] for r in g), max(r[2] for r in g), max(r[3] for r in g), len(g)) for g in groups.values()]
        return pd.DataFrame(out, columns=[*page, "x0", "y0", "x1", "y1", "n"])

    return strips.groupBy(*page, "strip").applyInPandas(settle, schema)


def band_left(targets: DataFrame, prefixes: DataFrame, page: list[str], reach: float = 45.0, by: float = 2.0) -> DataFrame:
    """Boxes widened to the left over a prefix that ends within ``reach`` on the same line, then padded."""
    t, p = targets.alias("t"), prefixes.alias("p")
    on = (F.col("p.rect.x0") >= F.col("t.rect.x0") - reach) & (F.col("p.rect.x1") <= F.col("t.rect.x0")) & (F.col("p.rect.y0") < F.col("t.rect.y1") + 2) & (F.col("t.rect.y0") - 2 < F.col("p.rect.y1"))
    for k in page:
        on = on & (F.col(f"t.{k}") == F.col(f"p.{k}"))
    best = t.join(p, on, "left").groupBy(*[F.col(f"t.{k}").alias(k) for k in page], F.col("t.id").alias("id"), F.col("t.rect").alias("rect")).agg(F.min("p.rect.x0").alias("left"))
    return best.select(*page, "id", G.pad(G.rect(F.coalesce("left", "rect.x0"), F.col("rect.y0"), F.col("rect.x1"), F.col("rect.y1")), by).alias("rect"))


def clipped_text(words: DataFrame, clip: DataFrame, page: list[str]) -> DataFrame:
    """Words whose box meets the clip, joined in reading order."""
    w, c = words.alias("w"), clip.alias("c")
    on = G.intersects(F.col("w.rect"), F.col("c.rect"))
    for k in page:
        on = on & (F.col(f"w.{k}") == F.col(f"c.{k}"))
    rows = w.join(c, on).groupBy(*[F.col(f"c.{k}").alias(k) for k in page], F.col("c.id").alias("id"))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("w.line_no", "w.word_no", "w.word"))), lambda x: x["word"]), " ").alias("text"))


def block_candidates(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Lines of large type in the top of a page: doc, font, y0, text.

    ``spans``: doc, block_no, line_no, span_no, text, font, y0 (of the block), height (of the page).  A block
    with type of at least 13 gives one candidate of its lines within 3.5 of its largest; else each line is one.
    """
    top = spans.where((F.col("y0") < F.col("height") * TOP) & (F.trim("text") != ""))
    line = top.groupBy(doc, "block_no", "y0", "line_no").agg(
        F.max("font").alias("font"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("span_no", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text")
    )
    most = F.max("font").over(Window.partitionBy(doc, "block_no"))
    line = line.withColumn("most", most)
    joined = line.where((F.col("most") >= 13.0) & (F.col("font") >= F.col("most") - 3.5)).groupBy(doc, "block_no", "y0").agg(
        F.max("most").alias("font"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("text")
    )
    single = line.where("most < 13.0")
    return joined.select(doc, "font", "y0", "text").unionByName(single.select(doc, "font", "y0", "text"))


def layout_name(spans: DataFrame, doc: str = "doc_id", stopwords: list[str] = lx.STOPWORDS) -> DataFrame:
    """The best valid candidate of each document: largest type, then highest on the page, then by text."""
    c = block_candidates(spans, doc).withColumn("name", T.strip_edges(T.strip_place(T.strip_honorific(T.collapse("text")))))
    w = T.tokens("name", "[\\s\\-]+")
    n, size = F.length("name"), F.size(w)
    ok = ~F.col("name").rlike("[0-9]") & ~F.col("name").rlike("@|http|www|\\.com|\\.ma|\\.fr") & ~T.overlaps(w, lx.MONTHS) & ~T.overlaps(w, stopwords)
    ok = ok & ~F.exists(F.array(*map(F.lit, lx.HEADINGS)), lambda h: F.contains(F.upper("name"), h))
    ok = ok & ((size.between(2, 4) & n.between(4, 40)) | ((size == 1) & n.between(4, 25) & (F.col("font") >= 18.0)))
    order = Window.partitionBy(doc).orderBy(F.desc("font"), "y0", "name")
    return c.where(ok).withColumn("rn", F.row_number().over(order)).where("rn = 1").select(doc, "name", "font", "y0")


def header_blocks(blocks: DataFrame, key: list[str], share: float = TOP_OCR) -> DataFrame:
    """Text of the blocks at the head of each page in reading order (top, then left), as name recognition reads it.

    ``blocks``: key, x0, y0, text, height (of the page).  Blank blocks do not count.
    """
    top = blocks.where((F.col("y0") < F.col("height") * share) & (F.trim("text") != ""))
    return top.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))), lambda b: b["text"]), "\n").alias("text"))
