"""File sources: delimited text of unknown delimiter and header, statistics tables, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import search_norm

c = F.col

#: Delimiters that are looked for; of equally frequent ones the first is taken.
DELIMITERS = "|;,\t"


def header_name(x: str) -> str:
    return x.strip().lstrip("﻿").lower().replace(" ", "_").replace("-", "_")


def sniff(sample: str) -> str:
    """The delimiter that most lines of a sample have alike often, else the most frequent."""
    lines = [x for x in sample.splitlines() if x]
    steady = {d: lines[0].count(d) for d in DELIMITERS if lines and lines[0].count(d) and all(x.count(d) == lines[0].count(d) for x in lines)}
    counts = steady or {d: sample.count(d) for d in DELIMITERS}
    return max(counts, key=counts.get)


def read_delimited(spark: SparkSession, path: str, sample_lines: int = 20) -> DataFrame:
    """Text files (plain or gz) with a header as strings, columns named by header_name(). The delimiter follows from the first lines, read by Spark, so that any store will do; files are split and read in parallel."""
    head = spark.read.text(path).limit(sample_lines).collect()
    rows = spark.read.option("sep", sniff("\n".join(r[0] for r in head))).option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"').csv(path)
    return rows.toDF(*(header_name(x) for x in rows.columns))


def first_value(rows: DataFrame, *aliases: str) -> Column:
    """The first value that is not empty among the aliases that the table has; null if it has none."""
    there = [x for x in map(header_name, aliases) if x in rows.columns]
    return F.coalesce(*(F.nullif(c(x), F.lit("")) for x in there)) if there else F.lit(None).cast("string")


def statistics(wide: DataFrame, segments: dict[str, tuple[str, str]]) -> DataFrame:
    """code, label, segment, sales_count, median_price_m2: a row for each segment that has sales and a median. wide: code, label, and for each segment the names of its two columns, as text."""
    long = F.array(*(F.struct(F.lit(k).alias("segment"), c(n).try_cast("bigint").alias("sales_count"), c(m).try_cast("double").alias("median_price_m2")) for k, (n, m) in segments.items()))
    named = wide.where("trim(coalesce(code, '')) <> '' AND trim(coalesce(label, '')) <> ''")
    return named.select("code", "label", F.inline(long)).where("sales_count > 0 AND median_price_m2 > 0")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes, sha256 of files; a file is read whole by one task, as its digest needs."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("file"), c("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_official(spark: SparkSession, path: str, headers: list[str], sep: str, required: dict[str, str], encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Rows of a file whose columns are known, and those that are rejected with why: malformed (another number of fields), or the first column of `required` (name to pattern) that does not fit. Empty rows go. Headers in another order are taken; other ones are an error, as is a web page in place of the file."""
    head = spark.read.option("encoding", encoding).text(path).first()
    names = [x.strip().strip('"').lstrip("﻿") for x in (head[0] if head else "").split(sep)]
    if sorted(names) != sorted(headers):
        raise ValueError(f"unknown header: {names[:5]}")
    schema = ", ".join(f"`{n}` string" for n in names) + ", _bad string"
    rows = spark.read.schema(schema).option("sep", sep).option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    rows = rows.select(*(F.nullif(F.trim(c(f"`{n}`")), F.lit("")).alias(n) for n in names), "_bad")
    why = F.coalesce(F.when(c("_bad").isNotNull(), F.lit("malformed")), *(F.when(~F.coalesce(c(f"`{n}`").rlike(pattern), F.lit(False)), F.lit(n)) for n, pattern in required.items()))
    marked = rows.where(F.coalesce("_bad", *(c(f"`{n}`") for n in names)).isNotNull()).withColumn("reason", why)
    return marked.where("reason IS NULL").drop("_bad", "reason"), marked.where("reason IS NOT NULL").select("reason", *(c(f"`{n}`") for n in names))


def read_lawyers(spark: SparkSession, path: str, headers: list[str], keyed: list[str], most: int = 5000) -> DataFrame:
    """Rows of a semicolon file whose fields may hold line feeds and whose header is one of the first five rows; among rows of the same identity (digest of the folded `keyed` columns) the last one stays. An error if the header is missing, or if there are no rows or more than `most`: the export is then a broken one.

    Fields with line feeds cannot be split by line: one task reads a file, which `most` bounds.
    """
    raw = spark.read.option("sep", ";").option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").schema(", ".join(f"_c{i} string" for i in range(len(headers)))).csv(path)
    numbered = raw.withColumn("_at", F.monotonically_increasing_id())
    tidy = lambda x: F.trim(F.regexp_replace(x, "﻿", ""))
    is_header = F.forall(F.array(*(F.array_contains(F.array(*(tidy(c(f"_c{i}")) for i in range(len(headers)))), h) for h in headers)), lambda x: F.coalesce(x, F.lit(False)))
    found = numbered.where(is_header).orderBy("_at").first()
    if found is None:
        raise ValueError("no row with the known headers")
    order = [found[i].replace("﻿", "").strip() for i in range(len(headers))]
    rows = numbered.where(c("_at") > found["_at"]).select("_at", *(F.nullif(F.trim(f"_c{i}"), F.lit("")).alias(h) for i, h in enumerate(order)))
    identity = F.sha2(F.concat_ws("|", *(F.coalesce(search_norm(c(k)), F.lit("")) for k in keyed)), 256)
    last = rows.where(F.coalesce(*order).isNotNull()).withColumn("source_key", identity).groupBy("source_key").agg(F.max_by(F.struct(*order), "_at").alias("r")).select("source_key", "r.*")
    n = last.limit(most + 1).count()
    if not 0 < n <= most:
        raise ValueError(f"{n} rows: not a sound export")
    return last


def read_communes(spark: SparkSession, path: str, communes: list[str], years: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows of the files under commune=.../year=... that are asked for, only those folders read, and for each commune whether all years are there, and which are not."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("basePath", path).schema("mutation_id string, sale_date string, price string, surface string, commune string, year int").csv(path)
    rows = rows.where(c("commune").isin(communes) & c("year").isin(years))
    asked = spark.createDataFrame([(x, y) for x in communes for y in years], "commune string, year int")
    missing = asked.join(rows.select("commune", "year").distinct(), ["commune", "year"], "left_anti").groupBy("commune").agg(F.sort_array(F.collect_list("year")).alias("missing_years"))
    known = asked.select("commune").distinct().join(missing, "commune", "left")
    return rows, known.select("commune", c("missing_years").isNull().alias("complete"), F.coalesce("missing_years", F.array().cast("array<int>")).alias("missing_years"))


def read_json_list(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """Rows of an exported JSON array. An error that names the file if it is none, and one with the number of rows that lack a required field."""
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path)
    wanting = F.exists(F.array(*(c(x).isNull() for x in required)), lambda x: x)
    held = rows.agg(F.count_if(c("_bad").isNotNull()).alias("bad"), F.count_if(c("_bad").isNull() & wanting).alias("wanting")).first()
    if held["bad"]:
        raise ValueError(f"not a JSON array: {path}")
    if held["wanting"]:
        raise ValueError(f"{held['wanting']} rows of {path} lack one of {required}")
    return rows.drop("_bad")


def features(collections: DataFrame, text: str, keep: list[str], properties: str, key: str, most: int = 100) -> DataFrame:
    """A row for each of the first `most` features of GeoJSON texts: the columns `keep`, the properties, and the geometry as text; of features of one row with the same key the first stays, those without one go. A text that is no collection has none. `most` is the limit of one answer of the service, not of the table; capped says that an answer had more."""
    parsed = F.from_json(c(text), f"struct<features:array<struct<properties:struct<{properties}>,geometry:string>>>")
    each = collections.select(*keep, (F.size(parsed["features"]) > most).alias("capped"), F.posexplode(F.slice(parsed["features"], 1, most)).alias("_at", "_f")).select(*keep, "_at", "capped", c("_f.properties.*"), c("_f.geometry").alias("geometry")).where(c(key).isNotNull())
    others = [x for x in each.columns if x not in (*keep, key, "_at")]
    first = each.groupBy(*keep, key).agg(F.min_by(F.struct(*others), "_at").alias("_r"))
    return first.select(*keep, key, "_r.*")


def page_of(table: DataFrame, columns: list[str], where: dict[str, object], order: list[Column], offset: int, limit: int) -> DataFrame:
    """Columns of the rows whose fields equal what is given (null: is null), ordered, a range of them."""
    for name, value in where.items():
        table = table.where(c(name).isNull() if value is None else c(name) == value)
    return table.orderBy(*order).select(*columns).offset(offset).limit(limit)


def write_json_csv(rows: DataFrame, path: str) -> None:
    """The rows under path/json (a line each, null fields kept) and path/csv (with headers and quotes doubled), written by all tasks."""
    rows.write.option("ignoreNullFields", False).json(f"{path}/json")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/csv")
