"""Readers: tables by extension, typed node and edge folders, blacklists, taxonomies, XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import strip


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def load_table(spark: SparkSession, source: DataFrame | str, schema: str | None = None, rows: int | None = None) -> DataFrame:
    """A DataFrame as it is, or a file by its extension (json, jsonl, csv, parquet); index columns go.

    ``rows`` is a debugging cap.
    """
    if isinstance(source, DataFrame):
        df = source
    else:
        kind = source.rstrip("/").rsplit(".", 1)[-1]
        reader = spark.read.schema(schema) if schema else spark.read
        if kind in ("json", "jsonl"):
            df = reader.json(source)
        elif kind == "csv":
            df = reader.csv(source, header=True, inferSchema=not schema, escape='"', multiLine=True)
        elif kind == "parquet":
            df = reader.parquet(source)
        else:
            raise ValueError(f"no reader for {source}")
    df = df.drop("Unnamed: 0", "_c0")
    return df.limit(rows) if rows else df


def load_documents(spark: SparkSession, source: DataFrame | str, text_column: str = "report", id_column: str = "id") -> DataFrame:
    """(id, report) from a DataFrame, a csv or json file, or a text itself."""
    if isinstance(source, str) and not source.rstrip("/").endswith((".csv", ".json", ".jsonl", ".parquet")):
        return spark.createDataFrame([("0", source)], "id string, report string")
    df = load_table(spark, source)
    return df.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("report"))


def load_nodes(spark: SparkSession, folder: str, types: list[str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Nodes from a folder partitioned by ``nodeType``: pruned to types, null ids gone, ids stripped."""
    df = spark.read.json(folder)
    if types:
        df = df.where(F.col("nodeType").isin(types))
    return df.where(F.col("nodeID").isNotNull()).withColumn("nodeID", strip(F.col("nodeID"))).drop(*drop)


def load_edges(spark: SparkSession, folder: str, types: list[str] | None = None) -> DataFrame:
    df = spark.read.json(folder)
    if types:
        df = df.where(F.col("edgeType").isin(types))
    ends = [strip(F.col(c)).alias(c) for c in ("from", "to")]
    return df.where(F.col("from").isNotNull() & F.col("to").isNotNull()).select(*ends, *[c for c in df.columns if c not in ("from", "to")])


def load_graph(spark: SparkSession, folder: str, node_types: list[str] | None = None, edge_types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a saved graph; an absent part is an empty frame."""
    from loomgraph import schema

    made = []
    for part, load, types, empty in (("nodes", load_nodes, node_types, schema.NODES), ("edges", load_edges, edge_types, schema.EDGES)):
        path = f"{folder}/{part}"
        made.append(load(spark, path, types) if exists(spark, path) else spark.createDataFrame([], empty))
    return made[0], made[1]


def resume(spark: SparkSession, saved: str, fresh: DataFrame, type_column: str = "nodeType") -> DataFrame:
    """Rows saved before, topped up with fresh rows of types that were not saved."""
    if not exists(spark, saved):
        return fresh
    old = spark.read.json(saved)
    return old.unionByName(fresh.join(old.select(type_column).distinct(), type_column, "left_anti"), allowMissingColumns=True)


def symmetric(pairs: DataFrame) -> DataFrame:
    """Pairs in both directions, each once."""
    return pairs.select("from", "to").union(pairs.select("to", "from")).distinct()


def load_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Symmetric (from, to, blacklist); an absent file is an empty table."""
    pairs = spark.read.csv(path, header=True, schema="`from` string, `to` string") if exists(spark, path) else spark.createDataFrame([], "`from` string, `to` string")
    return symmetric(pairs).withColumn("blacklist", F.lit(True))


def last_state(history: DataFrame) -> DataFrame:
    """The latest row of a merge history."""
    latest = history.agg(F.max_by(F.struct("*"), F.struct("iteration", "chunk")).alias("s"))
    return latest.where("s is not null").select("s.*")


def taxonomy_from_html(pages: DataFrame, tag: str = "a", html: str = "html") -> DataFrame:
    """(code, label) from elements whose text is ``code (label)`` or ``code label``; others are left out."""
    found = F.explode(F.regexp_extract_all(F.col(html), F.lit(f"<{tag}(?: [^>]*)?>([^<]*)</{tag}>"), 1)).alias("x")
    parts = pages.select(found).select(F.regexp_extract("x", r"^([^ (]+)", 1).alias("code"), F.regexp_extract("x", r"^[^ (]+ *\(?([^)]*)", 1).alias("label"))
    return parts.where("code <> ''").distinct()


def load_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(code, label): a large code table is a file, given as a parameter."""
    return load_table(spark, path, "code string, label string")


def keyword_table(spark: SparkSession, groups: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(group, lang, term) from nested keyword lists."""
    rows = [(g, lang, term) for g, by in groups.items() for lang, terms in by.items() for term in terms]
    return spark.createDataFrame(rows, "`group` string, lang string, term string")


TEI = "teiHeader struct<fileDesc struct<titleStmt struct<title string>>>, text string"


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, abstract, authors, sections) of TEI papers, whole files in parallel."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r' xmlns="[^"]*"', "").alias("x"))
    return parse_tei(raw)


def read_tei_corpus(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_tei`` gives, from files of many TEI elements each; ``path`` is an element's ``n`` attribute.

    Files are cut after ``</TEI>`` as they are read, so a task holds one paper and large files are split.
    """
    cut = spark.read.option("lineSep", "</TEI>").text(path)
    one = F.regexp_extract("value", r"(?s)(<TEI[ >].*)", 1)
    raw = cut.select(F.concat(F.regexp_replace(one, r' xmlns="[^"]*"', ""), F.lit("</TEI>")).alias("x")).where("x <> '</TEI>'")
    return parse_tei(raw.withColumn("path", F.xpath_string("x", F.lit("/TEI/@n"))))


def parse_tei(raw: DataFrame) -> DataFrame:
    """TEI text in column ``x`` to title, abstract, authors and sections, by XPath in the JVM."""
    x = F.col("x")
    names, mails, orgs = (F.xpath(x, F.lit(p)) for p in ("//sourceDesc//author/persName/surname/text()", "//sourceDesc//author/email/text()", "//sourceDesc//author/affiliation/orgName/text()"))
    heads, bodies = F.xpath(x, F.lit("//body/div/head/text()")), F.xpath(x, F.lit("//body/div/p/text()"))
    return raw.select(
        "path", F.xpath_string(x, F.lit("//titleStmt/title")).alias("title"), F.trim(F.xpath_string(x, F.lit("//abstract"))).alias("abstract"),
        F.arrays_zip(names.alias("surname"), mails.alias("email"), orgs.alias("org")).alias("authors"), F.arrays_zip(heads.alias("head"), bodies.alias("text")).alias("sections"),
    )


def author_rows(papers: DataFrame) -> DataFrame:
    """One row an author with order and first/last flags."""
    rows = papers.select(F.col("path").alias("paper"), F.posexplode("authors").alias("author_order", "a"), F.size("authors").alias("n"))
    return rows.select("paper", "author_order", (F.col("author_order") == 0).alias("first_author"), (F.col("author_order") == F.col("n") - 1).alias("last_author"), "a.surname", "a.email", "a.org")
