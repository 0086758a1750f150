"""NELA loaders.

* CSV: header names trimmed + lower-cased, source key = lower/trim/all
  whitespace removed, broadcast join to the credibility dimension (108 keys),
  text = ``title. content`` (nulls -> ''), length > 20.  Every CSV of the
  directory is read (sorted), not only the first; multiLine CSV is not
  splittable, so convert once to Parquet for repeated use.
* JSON: recursive ``*.json``; a file holds an object or an array (others are
  skipped); ``source`` defaults to the parent directory name; text = content,
  or title where the content key is absent (a null content drops the article);
  labels from a labels file whose
  label column is detected by name, else the last numeric column; duplicate
  keys: last row wins.
* table: any DataFrame / table called ``newsdata`` (source, title, content).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import NELA_3WAY, name_for_id
from ..functions.text import WS, assemble_title_content, normalise_source_key
from ..operators.metrics import materialize_small
from ..operators.sampling import hash_sample
from . import fs
from .ids import with_stable_id
from .json_rows import articles, json_field

# Source -> credibility (0 reliable, 1 mixed, 2 unreliable), in
# the original order; "usatoday" appears twice and the later entry wins.
SOURCE_CREDIBILITY_PAIRS = [
    ("apnews", 0), ("ap", 0), ("reuters", 0), ("bbc", 0), ("bbcnews", 0),
    ("nytimes", 0), ("newyorktimes", 0), ("washingtonpost", 0), ("theguardian", 0),
    ("guardian", 0), ("npr", 0), ("pbs", 0), ("pbsnews", 0), ("usatoday", 0),
    ("abcnews", 0), ("cbsnews", 0), ("nbcnews", 0), ("time", 0), ("theatlantic", 0),
    ("economist", 0), ("wsj", 0), ("wallstreetjournal", 0), ("forbes", 0),
    ("politico", 0), ("thehill", 0), ("businessinsider", 0), ("axios", 0),
    ("vox", 0), ("slate", 0), ("huffpost", 0), ("huffingtonpost", 0),
    ("msnbc", 0), ("cnn", 0), ("cbcnews", 0), ("cbc", 0), ("aljazeera", 0),
    ("derspiegel", 0), ("lemonde", 0), ("independent", 0), ("theindependent", 0),
    ("telegraph", 0), ("thetelegraph", 0), ("latimes", 0), ("losangelestimes", 0),
    ("chicagotribune", 0), ("bostonglobe", 0), ("sfgate", 0),
    ("scientificamerican", 0), ("nature", 0), ("newscientist", 0),
    ("albusinessdaily", 0), ("metro", 0),
    ("foxnews", 1), ("fox", 1), ("nypost", 1), ("newyorkpost", 1),
    ("dailymail", 1), ("dailymailonline", 1), ("usatoday", 1),
    ("theblaze", 1), ("nationalreview", 1), ("weeklystandard", 1),
    ("reason", 1), ("motherjones", 1), ("thenation", 1), ("jacobin", 1),
    ("salon", 1), ("rawstory", 1), ("thedailybeast", 1), ("dailybeast", 1),
    ("mediaite", 1), ("theintercept", 1), ("intercept", 1),
    ("americanthinker", 1), ("spectator", 1), ("spectatorusa", 1),
    ("washingtontimes", 1), ("oann", 1), ("onenewsnow", 1),
    ("dailycaller", 1), ("thedailycaller", 1), ("townhall", 1),
    ("redstate", 1), ("hotair", 1), ("pjmedia", 1),
    ("infowars", 2), ("naturalnews", 2), ("breitbart", 2),
    ("thegatewaypundit", 2), ("gatewaypundit", 2),
    ("zerohedge", 2), ("activistpost", 2), ("beforeitsnews", 2),
    ("prisonplanet", 2), ("wnd", 2), ("worldnetdaily", 2),
    ("newsmax", 2), ("epochtimes", 2), ("theepochtimes", 2),
    ("truepundit", 2), ("conservativetreehouse", 2),
    ("thepatriotpost", 2), ("patriotpost", 2),
    ("veteranstoday", 2), ("globalresearch", 2),
    ("21stcenturywire", 2), ("dcclothesline", 2),
    ("yournewswire", 2), ("newspunch", 2),
]


def credibility_dimension(spark: SparkSession, pairs=None) -> DataFrame:
    """(source_key, label_id) with unique keys (later entries win)."""
    d = dict(pairs or SOURCE_CREDIBILITY_PAIRS)
    return spark.createDataFrame(sorted(d.items()), "source_key string, label_id int")


def _finish(df: DataFrame, min_len: int, max_samples: int | None, seed: int) -> DataFrame:
    """Drop short texts; an exact sample by id, so it does not depend on the
    file layout."""
    df = df.where(F.length("text") > min_len)
    return hash_sample(df, max_samples, "doc_id", seed) if max_samples else df


def load_nela_csv(spark: SparkSession, paths: list[str] | str, max_samples: int | None = None,
                  seed: int = 42, dim: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns (corpus, unknown_sources) -- the anti-join is a DataFrame, not
    a printed count."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
           .option("escape", '"').csv(paths))
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    cols = set(raw.columns)
    if "source" not in cols:
        raise ValueError("no column named source among " + ", ".join(raw.columns))
    raw = with_stable_id(raw.drop("doc_id"))
    if "title" in cols and "content" in cols:
        text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("content", F.lit("")))
    elif "content" in cols:
        text = F.coalesce("content", F.lit(""))
    elif "title" in cols:
        text = F.coalesce("title", F.lit(""))
    else:
        raise ValueError("neither title nor content among the columns " + ", ".join(raw.columns))
    dim = dim if dim is not None else credibility_dimension(spark)
    keyed = raw.withColumn("source_key", normalise_source_key("source")).withColumn("text", text)
    known = keyed.join(dim, "source_key")
    unknown = keyed.join(dim, "source_key", "left_anti").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"))
    corpus = known.select("text", name_for_id("label_id", NELA_3WAY).alias("label"), "label_id", "source", "doc_id")
    return _finish(corpus, 20, max_samples, seed), unknown


def detect_label_column(schema: T.StructType, json_style: bool = True) -> str:
    """First column whose lower name contains label/aggregated(/credibility
    for the JSON path); else the last numeric column (S11)."""
    keys = ("label", "aggregated", "credibility") if json_style else ("label", "aggregated")
    for f in schema.fields:
        if any(k in f.name.lower() for k in keys):
            return f.name
    numeric = [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]
    if numeric:
        return numeric[-1]
    raise ValueError("no label column: none is named like one, and none is numeric")


def load_labels_file(spark: SparkSession, path: str, json_style: bool = True) -> DataFrame:
    """(source_key = lower(first column), label_id); duplicate keys: last row wins."""
    lf = spark.read.option("header", True).option("inferSchema", True).csv(path)
    label_col = detect_label_column(lf.schema, json_style)
    key_col = lf.columns[0]
    ordered = lf.withColumn("_row", F.monotonically_increasing_id())  # file order within one file
    return ordered.groupBy(F.lower(F.col(key_col)).alias("source_key")).agg(
        F.max_by(F.col(label_col), "_row").cast("int").alias("label_id"))


def load_nela_json(spark: SparkSession, data_dir: str, max_samples: int | None = None,
                   seed: int = 42, max_content: int | None = None) -> DataFrame:
    """Whole texts; ``max_content`` limits their characters."""
    articles_dir = f"{data_dir.rstrip('/')}/articles"
    labels = load_labels_file(spark, f"{data_dir.rstrip('/')}/labels.csv", json_style=True)
    files = (spark.read.option("wholetext", True).option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.json").text(articles_dir))
    rows = files.select(F.col("_metadata.file_path").alias("_path"), F.explode(articles(F.col("value"))).alias("_v"))
    (has_source, source), (has_content, content), (_, title) = (
        json_field(F.col("_v"), key) for key in ("source", "content", "title"))
    # an absent source is the folder's name, an absent content the title; null ones drop the article
    parent = F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)
    df = with_stable_id(rows.select(F.when(has_source, source).otherwise(parent).alias("source"),
                                    F.when(has_content, content).otherwise(title).alias("text")))
    df = df.withColumn("source_key", F.lower("source"))
    # labels file: one row per source, written once; broadcast or not by its size
    j = df.join(materialize_small(labels), "source_key")
    stripped = F.regexp_replace("text", rf"^[{WS}]+|[{WS}]+$", "")
    out = (j.where(F.length(stripped) > 20)
            .select((F.substring("text", 1, max_content) if max_content else F.col("text")).alias("text"), "source", "label_id",
                    "doc_id",
                    F.coalesce(F.element_at(F.create_map(*[x for k, v in NELA_3WAY.items() for x in (F.lit(k), F.lit(v))]),
                                            F.col("label_id")), F.lit("unknown")).alias("label")))
    return _finish(out, 0, max_samples, seed)


def load_nela_table(spark: SparkSession, labels: DataFrame, table: str = "newsdata",
                    max_samples: int | None = None, seed: int = 42, max_content: int | None = None) -> DataFrame:
    """Any registered table/view named ``newsdata`` (S10); labels: (source_key,
    label_id).  Whole texts (``max_content`` limits their characters); the
    sample is drawn from all rows that pass the join and the filters."""
    t = with_stable_id(spark.table(table).select("source", "title", "content"))
    j = t.withColumn("source_key", F.lower("source")).join(materialize_small(labels), "source_key")
    out = j.select(assemble_title_content("title", "content", max_content).alias("text"),
                   name_for_id("label_id", NELA_3WAY).alias("label"), "label_id", "source", "doc_id").dropna()
    return _finish(out, 20, max_samples, seed)


def load_nela(spark: SparkSession, data_dir: str, max_samples: int | None = None, seed: int = 42) -> DataFrame:
    """Auto-detect (S12): CSVs in the directory (not labels.csv) -> parent
    ``nela*.csv`` -> ``newsdata`` table -> ``articles/`` JSON."""
    d = data_dir.rstrip("/")
    csvs = [p for p in fs.glob(spark, f"{d}/*.csv") if not p.lower().endswith("/labels.csv")]
    if not csvs:
        parent = d.rsplit("/", 1)[0] if "/" in d else "."
        csvs = fs.glob(spark, f"{parent}/nela*.csv")
    if csvs:
        return load_nela_csv(spark, csvs, max_samples, seed)[0]
    if spark.catalog.tableExists("newsdata"):
        return load_nela_table(spark, load_labels_file(spark, f"{d}/labels.csv", json_style=False),
                               max_samples=max_samples, seed=seed)
    if fs.exists(spark, f"{d}/articles"):
        return load_nela_json(spark, d, max_samples, seed)
    raise FileNotFoundError(f"No NELA data found in {d} or its parent directory")
