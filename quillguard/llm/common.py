"""What the operators of this folder share: tables, materialization, fitted models, worker state."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import or_
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encodings, language
from .pii import fold

UNIT = 1500  # texts to which counts are brought, so that the models of a larger corpus of one kind are the same
COMMON = 3  # texts in UNIT that make a capitalized word an ordinary one
ORDINARY, TEXTS = "=ordinary", "=texts"  # kinds of counts beside those of the languages
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿŒœ]{2,}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies there.  One that is scanned in few tasks against the cores (a small file) is spread
    over them; the number of tasks is asked of the plain scan, which runs nothing."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def materialize(df: DataFrame) -> DataFrame:
    """The rows written once to the shared checkpoint folder, so that later uses neither recompute them
    nor lose them with an executor.  A folder of our own is set only in a local session that names none; on a
    cluster a local folder would be another one on every machine."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quillguard-"))
    return df.checkpoint(eager=True)


def hashed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows (at most twice as many), those whose hashed key falls under a threshold set from the
    number of rows; each task keeps only its share, whatever the number of tasks."""
    total = df.count()
    under = min(1.0, n / max(total, 1))
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < int(under * (1 << 31)) + (under == 1.0)).limit(2 * n)


def corpus_counts(documents: DataFrame) -> DataFrame:
    """What the text models are made of, counted over all texts to their ends: kind, term, n.

    A language: pieces between white space of the texts that bear its label (labels may be wrong).  ORDINARY: folded
    words with the texts that hold a spelling of them, COMMON for one in small letters and one for another.  TEXTS: texts.
    """
    arrow = pa.schema([("kind", pa.string()), ("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, terms, n = counted(batch.column(0), batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((kinds, terms, n), arrow)], schema=arrow)

    rows = documents.select("lang", "text").where(F.col("text").isNotNull()).mapInArrow(run, "kind string, term string, n bigint")
    return materialize(rows.groupBy("kind", "term").agg(F.sum("n").alias("n")))


fit_sample = corpus_counts  # older name


def counted(langs: pa.Array, texts: pa.Array) -> tuple[list[str], list[str], list[int]]:
    """Counts of some texts, see ``corpus_counts``, as columns."""
    split = pc.utf8_split_whitespace(texts)
    pieces = pc.list_flatten(split).dictionary_encode()
    text_of = pc.list_parent_indices(split).to_numpy().astype(np.int64)
    code = pieces.indices.to_numpy()
    every = pieces.dictionary.to_pylist()
    kinds, terms, n = [TEXTS], [""], [len(texts)]

    label = np.array([language.LANGS.index(x) if x in language.LANGS else -1 for x in langs.to_pylist()], np.int64)[text_of]
    for k, lang in enumerate(language.LANGS):
        found = np.bincount(code[label == k], minlength=len(every))
        at = [i for i in np.flatnonzero(found).tolist() if every[i]]
        kinds += [lang] * len(at)
        terms += [every[i] for i in at]
        n += found[at].tolist()

    # words of each distinct piece, and from them the distinct words of each text
    numbers: dict[str, int] = {}
    words = [[numbers.setdefault(w, len(numbers)) for w in _WORD.findall(x)] for x in every]
    many = np.array([len(x) for x in words], np.int64)
    if not many.sum():
        return kinds, terms, n
    flat, first = np.concatenate([np.array(x, np.int64) for x in words]), np.cumsum(many) - many
    times = many[code]
    place = np.repeat(first[code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    holds = np.bincount(np.unique(np.repeat(text_of, times) * len(numbers) + flat[place]) % len(numbers), minlength=len(numbers))
    folded: dict[str, int] = {}
    for w, k in zip(numbers, holds.tolist()):
        f = fold(w)
        folded[f] = folded.get(f, 0) + (COMMON if w[0].islower() else 1) * k
    return kinds + [ORDINARY] * len(folded), terms + list(folded), n + list(folded.values())


SHARE = 0.01  # of the rows, from which a key is spread over several tasks; so there are a hundred of them at most
SALTS = 64
SMALL = 10_000  # rows up to which a table of counts is sent to all tasks


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, sized: DataFrame | None = None) -> DataFrame:
    """Left join with a table of one row for each key.  Rows of a key that holds more than SHARE of them, and rows
    without a key, are spread over SALTS tasks by the hashed column ``spread``; the key's row goes to each.

    Which keys those are is asked of ``sized``, a written table with that column, so that nothing is computed twice.
    """
    asked = (left if sized is None else sized).select(key)
    total = asked.count()
    hot = [r[0] for r in asked.groupBy(key).count().where((F.col("count") > SHARE * total) & F.col(key).isNotNull()).select(key).limit(int(1 / SHARE)).collect()]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    a = left.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), salt).otherwise(F.lit(0)))
    b = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return a.join(b, [key, "_salt"], "left").drop("_salt")


def small_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with a table of counts that is sent to all tasks if it has no more than SMALL rows, and salted else."""
    right = materialize(right)
    if right.limit(SMALL + 1).count() <= SMALL:
        return left.join(F.broadcast(right), key, "left")
    return salted_join(left, right, key, key)


class TextModels:
    """Language model, per-language zstandard dictionaries and ordinary words from the counts of a corpus.

    What is left out of a model is too rare to be in it, not unseen: words of less than one occurrence in UNIT texts
    (their trigrams count), pieces too rare for a text of TRAINING pieces, words below the rate of ordinary ones.
    """

    def __init__(self, counts: DataFrame):
        totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        scale = max(1.0, totals.get(TEXTS, 0) / UNIT)
        self.language = language_model(counts, scale)
        pieces: dict[str, dict[str, int]] = {}
        least = [(F.col("kind") == k) & (2 * encodings.TRAINING * F.col("n") >= n) for k, n in totals.items() if k in language.LANGS]
        for r in counts.where(reduce(or_, least, F.lit(False))).collect():
            pieces.setdefault(r["kind"], {})[r["term"]] = r["n"]
        self.dictionaries = encodings.train_dictionaries({k: encodings.text_of_counts(pieces[k], totals[k]) for k in sorted(pieces)})
        self.vocabulary = frozenset(r["term"] for r in counts.where((F.col("kind") == ORDINARY) & (F.col("n") >= COMMON * scale)).collect())


def language_model(counts: DataFrame, scale: float) -> language.Model:
    """The model of words and trigrams of all texts with a label."""

    def words_of():
        def f(c):
            rows = [(k, w, n) for k, x, n in zip(c["kind"], c["term"], c["n"]) for w in language.latin_words(x)]
            return dict(zip(("kind", "word", "n"), map(list, zip(*rows)) if rows else ([], [], [])))

        return f

    def grams_of():
        most = int(language.FREQUENT * scale)

        def f(c):
            out: dict[tuple[str, str], int] = {}
            for k, w, n in zip(c["kind"], c["word"], c["n"]):
                for g in language.trigrams(w):
                    out[k, g] = out.get((k, g), 0) + min(n, most)
            return {"kind": [k for k, _ in out], "gram": [g for _, g in out], "n": list(out.values())}

        return f

    latin = counts.where(F.col("kind").isin(*language.LATIN))
    words = materialize(map_rows(latin, words_of, "kind string, word string, n bigint").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    grams = map_rows(words, grams_of, "kind string, gram string, n bigint").groupBy("kind", "gram").agg(F.sum("n").alias("n"))
    totals = {r["kind"]: r["n"] for r in words.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    tables: list[dict[str, dict[str, int]]] = [{k: {} for k in language.LATIN} for _ in range(2)]
    # a word that one language has at the rate is known with its counts in all
    known = words.where(F.col("n") >= scale).select("word").distinct()
    for by, rows in zip(tables, (words.join(known, "word", "left_semi").select("kind", "word", "n"), grams)):
        for k, x, n in rows.collect():
            by[k][x] = n
    return language.fitted(tables[0], totals, tables[1], scale)


# One fit for each application and table: the models of the queries over one corpus are the same.
_FITTED: dict[tuple[str, str], Broadcast] = {}


def text_models(spark: SparkSession, documents: DataFrame) -> Broadcast:
    """Fitted on the driver on counts over the whole corpus, of which it gets what is frequent enough for a model.

    Fitted once for each application and set of unchanged input files, and then kept.
    """
    key = (spark.sparkContext.applicationId, fingerprint(documents))
    if not key[1] or key not in _FITTED:
        m = TextModels(corpus_counts(documents))
        b = spark.sparkContext.broadcast((m.language.words, m.language.grams, m.dictionaries, m.vocabulary))
        if not key[1]:
            return b
        if len(_FITTED) > 8:
            _FITTED.clear()
        _FITTED[key] = b
    return _FITTED[key]


def fingerprint(df: DataFrame) -> str:
    """Files of a plain table scan with their times of change; empty for anything else.

    Of more than 64 files the names alone count: they are Spark's own, which never come twice.
    """
    lines = [x.lstrip(" :+-") for x in df._jdf.queryExecution().analyzed().toString().strip().split("\n")]
    if not all(x.startswith(("Relation", "Repartition", "Project")) for x in lines):
        return ""
    files = sorted(df.inputFiles())
    if len(files) > 64:
        return "|".join(files)
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(x) for x in files]
    return "|".join(f"{x} {p.getFileSystem(conf).getFileStatus(p).getModificationTime()}" for x, p in zip(files, paths))


@lru_cache(4)
def _worker(ref) -> tuple[language.Model, encodings.Repairer]:
    words, grams, dictionaries, _ = ref.value
    return language.Model(words, grams), encodings.Repairer(dictionaries)


class Named:
    """A broadcast with a name of its own, under which a worker remembers what it makes of it."""

    def __init__(self, b: Broadcast):
        self.b = b
        self.key = uuid4().hex

    @property
    def value(self):
        return self.b.value

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Named) and self.key == other.key


class Ref(Named):
    """The fitted text models in a broadcast."""

    def vocabulary(self) -> frozenset[str]:
        return self.value[3]

    def models(self) -> tuple[language.Model, encodings.Repairer]:
        return _worker(self)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str) -> DataFrame:
    """Columns of each Arrow batch through a function on plain lists; ``make`` runs once for each task."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            out = f({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
