"""Quality rules whose thresholds adapt to each language and source, by mergeable quantile sketches.

Each text is measured: words and their length, symbols, lines that repeat an earlier one, and words in five-word windows that are there twice. From these come the rules' values, whole numbers per mille. A sketch counts values by bucket: a bucket holds the values that agree in their leading BITS binary digits, so it is exact for small values and within 1 / 2 ** (BITS - 1) of a value for large ones. Two sketches merge by adding counts: tasks merge theirs before the shuffle, sources merge into their language and languages into the whole table, and the result does not depend on the order or on retries.

A rule's bounds in a group are its quartiles, widened by FENCE times their distance, and by the rule's slack at least, so that a group of equal texts does not throw out what is barely different. A group of fewer than LEAST documents takes the bounds of its language, and a language of fewer those of the whole table. Documents meet their group's bounds in an equi-join, which Spark splits where a source is hot, or broadcasts where its own size limit allows.

Defined results: a null text has no words, and so fails the base rule (fewer than LEAST_WORDS words); as a value, 0 stands where there is nothing to divide by. Null languages and sources are groups of their own. Documents that fail the base rule have no part in the sketches. Rows with a null id and repeated rows are measured and judged each; an empty table gives an empty one. Columns of other names, even of these by another case, stay out of op11; keep() hands on the documents' own columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import DOCUMENT_COLUMNS, materialize, pick, table

SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, REPEATED = 5, 10, 20
#: Each rule: its value of a document (per mille), its slack, and whether low values fail, too.
RULES = {
    "word_length": ("word_chars * 1000 div greatest(n_words, 1)", 1_000, True),
    "symbols": ("n_symbols * 1000 div greatest(n_words, 1)", 50, False),
    "dup_lines": ("n_dup_lines * 1000 div greatest(n_lines, 1)", 250, False),
    "repeats": ("n_repeat_words * 1000 div greatest(n_words, 1)", 100, False),
}
FENCE, LEAST, BITS = 3, 100, 6
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words which is there twice or more; all windows are compared whole: codes of pairs, then of longer runs, are exact."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids, kinds = pd.factorize(np.array(words, object))
    code = ids.astype(np.int64)
    for k in range(1, WINDOW):
        code, _ = pd.factorize(code[: len(ids) - k] * len(kinds) + ids[k:])
    twice = np.bincount(code)[code] > 1
    mark = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    mark[: n + 1] += np.append(twice, False)
    np.subtract.at(mark, at + WINDOW, 1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def measured(text: bytes) -> tuple[int, ...]:
    """MEASURES of a text in UTF-8. What bytes.split() takes for blanks is what ends a word here: space and 9 to 13."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) - int((np.frombuffer(joined, np.uint8) & 0xC0 == 0x80).sum()) if words else 0
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, sum(joined.count(s.encode()) for s in SYMBOLS), len(lines), len(lines) - len(set(lines)), repeat_words(words)


def measure(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) and MEASURES."""
    own = pick(docs, **DOCUMENT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measured(x.as_py() or b"") for x in b.column("text").cast(pa.binary())]
            columns = zip(*found, strict=True) if found else [[]] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in columns)], [*b.schema.names, *MEASURES])

    kinds = ", ".join(f"{c} {k}" for c, k in DOCUMENT_COLUMNS.items())
    return own.mapInArrow(run, f"{kinds}, {', '.join(f'{m} long' for m in MEASURES)}")


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEATED} * n_words")


def bucket(value: Column) -> Column:
    """The least value of the bucket that holds a value of 0 or more."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - BITS).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(measures: DataFrame) -> DataFrame:
    """level (2: lang and source, 1: lang, 0: all), lang, source, rule, bucket, n: the counts of documents that pass the base rule."""
    values = F.array(*(F.struct(F.lit(rule).alias("rule"), F.expr(value).alias("value")) for rule, (value, _, _) in RULES.items()))
    each = measures.where(~base_failed()).select("lang", "source", F.inline(values))
    own = each.groupBy("lang", "source", "rule", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))
    merged = F.explode(F.array(F.struct(F.lit(2).alias("level"), "lang", "source"), F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source")), F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))))
    return own.select(merged.alias("g"), "rule", "bucket", "n").groupBy("g.level", "g.lang", "g.source", "rule", "bucket").agg(F.sum("n").alias("n"))


def bounds(sketch: DataFrame) -> DataFrame:
    """level, lang, source, n (documents) and a map of each rule to its least and greatest value that passes. A sketch's buckets are few, whatever the table."""
    group = ["level", "lang", "source", "rule"]
    w = Window.partitionBy(*group)
    upto = sketch.withColumns({"upto": F.sum("n").over(w.orderBy("bucket")), "all": F.sum("n").over(w)})
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("all") * q, F.col("bucket")))
    q = upto.groupBy(*group).agg(F.max("all").alias("n"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    slack = F.create_map(*(F.lit(x) for rule, (_, s, _) in RULES.items() for x in (rule, s)))[F.col("rule")]
    low = F.create_map(*(F.lit(x) for rule, (_, _, s) in RULES.items() for x in (rule, s)))[F.col("rule")]
    wide = F.greatest((F.col("q3") - F.col("q1")) * FENCE, slack)
    each = q.select(*group, "n", F.when(low, F.col("q1") - wide).alias("least"), (F.col("q3") + wide).alias("greatest"))
    return each.groupBy("level", "lang", "source").agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rule", F.struct("least", "greatest")))).alias("limits"))


def _passes(limits: str) -> Column:
    """Whether all rules' values lie within the limits; true without limits."""
    out = F.lit(True)
    for rule, (value, _, _) in RULES.items():
        of = F.col(limits)[rule]
        out = out & F.coalesce(F.expr(value) >= of["least"], F.lit(True)) & F.coalesce(F.expr(value) <= of["greatest"], F.lit(True))
    return out


def judge(measures: DataFrame, limits: DataFrame, least: int = LEAST) -> DataFrame:
    """measures with base_failed and kept. limits: of bounds(), of this table or of another one."""
    at = lambda level, *keys: limits.where((F.col("level") == level) & (F.col("n") >= least)).select(*(F.col(k).alias(f"{k}{level}") for k in keys), F.col("limits").alias(f"limits{level}"))
    out = measures.join(at(2, "lang", "source"), F.col("lang").eqNullSafe(F.col("lang2")) & F.col("source").eqNullSafe(F.col("source2")), "left")
    out = out.join(at(1, "lang"), F.col("lang").eqNullSafe(F.col("lang1")), "left")
    out = out.withColumn("limits", F.coalesce("limits2", "limits1", limits.where("level = 0").select("limits").scalar()))
    return out.select(*measures.columns, base_failed().alias("base_failed"), (~base_failed() & _passes("limits")).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns. Texts are measured twice, rather than written."""
    limits = materialize(bounds(sketches(measure(docs))), "limits")
    return judge(measure(docs), limits).where("kept").select(*DOCUMENT_COLUMNS)


def _sql() -> str:
    words = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
    symbols = "length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))"
    value = lambda rule: RULES[rule][0].replace(" div ", " // ")
    rules = " UNION ALL ".join(f"SELECT no, lang, source, '{r}' AS rule, {value(r)} AS value, {slack} AS slack, {low} AS low FROM m WHERE NOT base_failed" for r, (_, slack, low) in RULES.items())
    drop = f"greatest(0, length(bin(value)) - {BITS})"
    levels = " UNION ALL ".join(f"SELECT {level} AS level, {lang} AS lang, {source} AS source, rule, slack, low, (value >> {drop}) << {drop} AS bucket FROM v" for level, lang, source in ((2, "lang", "source"), (1, "lang", "NULL"), (0, "NULL", "NULL")))
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS no, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT no, {words} AS w FROM d),
l AS (SELECT no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT no, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY no),
g AS (SELECT no, i, w[i : i + {WINDOW - 1}] AS g FROM (SELECT no, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT no, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT no, i FROM g QUALIFY count(*) OVER (PARTITION BY no, g) > 1) CROSS JOIN range({WINDOW}) t(k) GROUP BY no),
m0 AS (SELECT no, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, {symbols} AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d JOIN w USING (no) LEFT JOIN l USING (no) LEFT JOIN r USING (no)),
m AS MATERIALIZED (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED} * n_words AS base_failed FROM m0), v AS ({rules}),
c AS (SELECT level, lang, source, rule, slack, low, bucket, count(*) AS n FROM ({levels}) GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total FROM c),
q AS (SELECT level, lang, source, rule, slack, low, max(total) AS n, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3 FROM u GROUP BY ALL),
b AS (SELECT *, CASE WHEN low THEN q1 - greatest({FENCE} * (q3 - q1), slack) END AS least, q3 + greatest({FENCE} * (q3 - q1), slack) AS greatest FROM q WHERE level = 0 OR n >= {LEAST}),
j AS (SELECT v.no, v.value, b.least, b.greatest FROM v JOIN b ON b.rule = v.rule AND (b.level = 0 OR b.lang IS NOT DISTINCT FROM v.lang) AND (b.level < 2 OR b.source IS NOT DISTINCT FROM v.source) QUALIFY row_number() OVER (PARTITION BY v.no, v.rule ORDER BY b.level DESC) = 1),
k AS (SELECT no, bool_and(coalesce(value >= least, true) AND value <= greatest) AS ok FROM j GROUP BY no)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept FROM m LEFT JOIN k USING (no)"""


SQL = _sql()


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = materialize(measure(table(spark, sf_dir, "documents")).drop("text"), "measures")
    limits = materialize(bounds(sketches(measures)), "limits")
    return judge(measures, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
