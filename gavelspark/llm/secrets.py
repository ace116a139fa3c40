"""Secret scans in DataFrame functions only.

Base rules find assignments, access keys and hexadecimal strings by pattern. Beside them, runs of key-like characters are scanned for randomness: for each run's character class (hex, alnum, base64) a window slides over it, the Shannon entropy of the window follows from the counts of the one character that leaves and the one that enters, and a run is a secret when some window reaches the class's threshold. An allow-list suppresses runs that are known not to be secrets as a whole; of runs of joined words the words are left out, and what is between them is scanned. What base spans cover of a run is cut out of it first; each piece that is left is a run of its own.

Spans are (start, end, kind) in code points, end exclusive, by start, then kind in the order of KINDS.

Work grows in proportion to a text, however many spans it has: places are running sums over blocks, and no pattern repeats a group without bound (that would overflow the stack).

Defined results: a null text is the empty text: no spans, and the digest of the empty string. Repeated rows are scanned each. Runs shorter than the window have no entropy. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import DOCUMENT_COLUMNS, pick, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run shorter than asked for holds no longer match, so a count in the pattern drops the same matches as a test behind it.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
WINDOW = 20
#: A run of key-like characters, with the FILL beside it where a base span was.
FILL = "\x00"
CANDIDATE = rf"(?:\x00|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{{{WINDOW},}}\x00?"
SEPARATORS = "/=_-"
#: Least entropy in bits of a window, by class.
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 3.0), "alnum": (r"^[0-9A-Za-z]+$", 3.7), "base64": (r"^", 3.9)}
#: Runs that no secret looks like: words and dashed or joined words without digits, dates and numbers, UUIDs, and digests of the length that their name says.
ALLOWED = r"(?i)^([a-z_/=+-]+|[0-9_/=+-]+|[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}|sha1[-=_]([0-9a-f]{40}|[a-z0-9+/]{27}=)|sha256[-=_]([0-9a-f]{64}|[a-z0-9+/]{43}=)|sha384[-=_]([0-9a-f]{96}|[a-z0-9+/]{64})|sha512[-=_]([0-9a-f]{128}|[a-z0-9+/]{86}==))$"
#: Runs of joined words, as paths, names of digests and place-holders are: a window over some of the words is as mixed as a key, so they are scanned without the words.
JOINED = r"(?i)^sha(1|256|384|512)[-=_]|example|placeholder|xxxxxx|012345678|abcdefghij"
#: Folders of a path, which each match FOLDER. They are split, as a group repeated for each of them would overflow the stack.
FOLDERS, FOLDER = r"(?i)^/?(.*)/[a-z0-9_-]{0,24}$", r"(?i)^[a-z][a-z_-]*[0-9]{0,4}$"


def _prefixes(letters: str, least: int) -> str:
    """Matches the first letters, `least` or more."""
    return letters[:least] + "".join(f"(?:{c}" for c in letters[least:]) + ")?" * (len(letters) - least)


#: A piece between separators that is a word, with four digits at most, or a number; with digits it is shorter than a window.
_WORD = rf"(?:(?=[A-Za-z]+(?![A-Za-z0-9+])|[0-9]+(?![A-Za-z0-9+])|[A-Za-z0-9]{{1,{WINDOW - 1}}}(?![A-Za-z0-9+]))(?:(?:[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]{{2,}}){{0,9}})[0-9]{{0,4}}|[0-9]+)(?![A-Za-z0-9+]))"
#: What is left out of lines of joined words: line feeds; the first piece behind a leading "example-"; words that others lead up to, of four characters anywhere, or at the end; place-holders and alphabets.
WORDS = rf"\n+|(?m:^)(?i:example|placeholder)[-_][A-Za-z0-9+]+|\G[/=_-]*{_WORD}|(?<![A-Za-z0-9+])(?=[A-Za-z0-9]{{4}}){_WORD}|[/=_-]{_WORD}[/=_-]*(?m:$)|(?i:x{{6,}}|0?{_prefixes('123456789', 8)}|{_prefixes('abcdefghijklmnopqrstuvwxyz', 10)})"


#: How many elements a step below may copy; running sums and substrings go over blocks of so many.
BLOCK = 256
SPANS = "array<struct<start:int,end:int>>"
MATCHES = "array<struct<start:int,end:int,match:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(xs: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / BLOCK), F.lit(0)).cast("int")), lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))


def running(xs: Column, join) -> Column:
    """Of an array of ints: for each element what `join` (addition or the maximum) makes of 0 and all before it.

    A fold that appends copies what it has so far, so folds run over blocks of BLOCK elements, from the folds of the blocks before them: work grows all but in proportion to the array.
    """
    kind = "struct<at:int,out:array<int>>"

    def each(part: Column, start: Column) -> Column:
        add = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")).cast(kind), lambda acc, x: add(acc, x).cast(kind), lambda acc: acc["out"])

    fold = lambda part: F.aggregate(part, F.lit(0), join)
    return _let(xs, lambda v: F.when(F.size(v) <= BLOCK, each(v, F.lit(0))).otherwise(_let(_blocks(v), lambda bs: F.flatten(F.zip_with(bs, each(F.transform(bs, fold), F.lit(0)), each)))))


def cut_out(text: Column, spans: Column) -> Column:
    """The parts of a text within spans (by start, apart from each other), as matches. A substring is found by counting from the text's beginning, so many are cut from parts of it."""
    part = lambda t, at, s: F.substring(t, s["start"] - at + 1, s["end"] - s["start"])
    hull = lambda ss: F.struct(F.get(ss, F.lit(0))["start"].alias("start"), F.element_at(ss, -1)["end"].alias("end"))
    cut = lambda t, at, ss: F.transform(ss, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), part(t, at, s).alias("match")))
    block = lambda ss: _let(F.struct(part(text, F.lit(0), hull(ss)).alias("text"), hull(ss)["start"].alias("at")), lambda b: cut(b["text"], b["at"], ss))
    return F.when(F.size(spans) <= BLOCK, cut(text, F.lit(0), spans)).otherwise(F.flatten(F.transform(_blocks(spans), block)))


def gaps(spans: Column, start: Column, end: Column) -> Column:
    """What spans (by start; they may overlap) leave of start to end; parts may be empty."""
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    before = _let(running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), lambda ends: F.zip_with(spans, ends, lambda s, e: span(F.greatest(e, start), s["start"])))
    last = F.greatest(start, F.array_max(F.transform(spans, lambda s: s["end"])))
    return F.filter(F.concat(before, F.array(span(last, end))), lambda g: g["end"] >= g["start"]).cast(SPANS)


def found(text: Column, pattern: str, at_least: tuple[int, int] = (0, 0)) -> Column:
    """array<struct<start, end, match>> of a pattern's matches; at_least: a group and its least length.

    What lies between the matches (split) and the matches (extract) have the lengths that add up to the places.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.coalesce(F.char_length(m), F.lit(0)).alias("size"), m.alias("m")))

    def placed(xs: Column) -> Column:
        at = running(F.transform(xs, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        return F.zip_with(xs, at, lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["size"]).alias("end"), x["m"].alias("match")))

    fits = lambda x: x["match"].isNotNull() & (F.char_length(F.regexp_extract(x["match"], pattern, at_least[0])) >= at_least[1])
    return F.when(text.rlike(pattern), F.filter(_let(steps, placed), fits)).otherwise(F.array().cast(MATCHES)).cast(MATCHES)


def window_entropy(run: Column, width: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of a window of that many characters; 0 if there is none.

    The state is the window and the sum of c * log2(c) over its characters' counts c; a step changes two of these counts.
    """
    kind = "struct<window:string,sum:double,least:double>"
    weigh = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(0.0)
    count = lambda w, ch: F.char_length(w) - F.char_length(F.replace(w, ch, F.lit("")))

    def step(acc: Column, ch: Column) -> Column:
        full = F.char_length(acc["window"]) == width
        out = F.substring(acc["window"], 1, 1)
        left = F.when(full, F.substring(acc["window"], 2, width)).otherwise(acc["window"])
        n_out, n_in = count(acc["window"], out), count(left, ch)
        total = acc["sum"] - F.when(full, weigh(n_out) - weigh(n_out - 1)).otherwise(0.0) + weigh(n_in + 1) - weigh(n_in)
        now = F.concat(left, ch)
        return F.struct(now.alias("window"), total.alias("sum"), F.when(F.char_length(now) == width, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least")).cast(kind)

    worst = width * math.log2(width)
    start = F.struct(F.lit("").alias("window"), F.lit(0.0).alias("sum"), F.lit(worst).alias("least")).cast(kind)
    return F.aggregate(F.split(run, ""), start, step, lambda acc: F.log2(F.lit(float(width))) - acc["least"] / width)


def _long(xs: Column) -> Column:
    return F.filter(xs, lambda x: x["end"] - x["start"] >= WINDOW)


def _core(piece: Column, lead: Column, tail: Column) -> Column:
    """A piece without the separators (and fill) at its beginning, where lead holds, and at its end, where tail does."""
    drop = F.lit(FILL + SEPARATORS)
    front = F.when(lead, F.ltrim(piece["match"], drop)).otherwise(piece["match"])
    start = piece["start"] + F.char_length(piece["match"]) - F.char_length(front)
    return _let(F.when(tail, F.rtrim(front, drop)).otherwise(front), lambda m: F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("match")))


def spaced(parts: Column, fill: str) -> Column:
    """Matches (by start, apart from each other) as one text in which they keep their places, with fill between them."""
    before = lambda i: F.coalesce(F.get(parts, i - 1)["end"], F.lit(0))
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.repeat(F.lit(fill), x["start"] - before(i)), x["match"])), "")


def with_left(df: DataFrame, text: str, spans: str, name: str, least: int = 0) -> DataFrame:
    """df with a column more: the parts, of `least` characters or more, that spans leave of a text."""
    df = df.withColumn("_gaps", F.filter(gaps(F.col(spans), F.lit(0), F.char_length(text)), lambda g: g["end"] - g["start"] >= least))
    return df.withColumn(name, cut_out(F.col(text), F.col("_gaps"))).drop("_gaps")


def with_runs(df: DataFrame) -> DataFrame:
    """_text and _base: also _runs, the runs of key-like characters in what base spans leave of a text. A run that a base span cuts is a run each side of it, without the separators next to the cut."""
    df = with_left(df.withColumn("_cuts", F.when(F.size("_base") > 0, F.col("_base"))), "_text", "_cuts", "_left")
    df = df.withColumn("_masked", F.coalesce(spaced(F.col("_left"), FILL), "_text"))
    df = df.withColumn("_found", found(F.col("_masked"), CANDIDATE))
    cored = F.transform("_found", lambda x: _core(x, x["match"].startswith(FILL), x["match"].endswith(FILL)))
    return df.withColumn("_runs", _long(cored)).drop("_cuts", "_left", "_masked", "_found")


def with_pieces(df: DataFrame) -> DataFrame:
    """_runs: also _pieces, what of them is scanned: nothing of a run that is allowed, what is between the words (without separators at its ends) of one of joined words, else all."""

    def joined(text: Column) -> Column:
        folders = F.regexp_extract(text, FOLDERS, 1)
        return text.rlike(JOINED) | ((folders != "") & F.forall(F.split(folders, "/"), lambda x: x.rlike(FOLDER)))

    kind = lambda x: F.when(x["match"].rlike(ALLOWED), "allowed").when(joined(x["match"]), "joined").otherwise("plain")
    df = df.withColumn("_kinds", F.transform("_runs", lambda x: F.struct(kind(x).alias("kind"), x.alias("run"))))
    of = lambda k: F.transform(F.filter("_kinds", lambda x: x["kind"] == k), lambda x: x["run"])
    df = df.withColumn("_plain", of("plain")).withColumn("_lines", spaced(of("joined"), "\n"))
    df = with_left(df.withColumn("_words", found(F.col("_lines"), WORDS)), "_lines", "_words", "_between", WINDOW)
    between = _long(F.transform("_between", lambda x: _core(x, F.lit(True), F.lit(True))))
    return df.withColumn("_pieces", F.when(F.col("_lines") == "", F.col("_plain")).otherwise(F.concat("_plain", between))).drop("_kinds", "_plain", "_lines", "_words", "_between")


def find_secrets(docs: DataFrame) -> DataFrame:
    """The columns of documents and secret_spans: array<struct<start, kind (place in KINDS), end>>, sorted. Missing columns are null, further ones are left out."""
    docs = pick(docs, **DOCUMENT_COLUMNS)
    spans = lambda name, k: F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    df = docs.select("*", F.coalesce("text", F.lit("")).alias("_text"))
    df = df.select("*", found(F.col("_text"), ASSIGN, (2, 8)).alias("_assign"), found(F.col("_text"), ACCESS).alias("_access"), found(F.col("_text"), HEX).alias("_hex"))
    df = with_pieces(with_runs(df.withColumn("_base", F.array_sort(F.concat(spans("_assign", 0), spans("_access", 1), spans("_hex", 2))))))

    def random(x: Column) -> Column:
        ladder = F
        for pattern, least in CLASSES.values():
            ladder = ladder.when(x["match"].rlike(pattern), F.lit(least))
        return window_entropy(x["match"]) >= ladder

    df = df.withColumn("_random", F.filter("_pieces", random))
    return df.select(*docs.columns, F.array_sort(F.concat("_base", spans("_random", 3))).alias("secret_spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The columns of documents, each stretch of secrets in text replaced by [SECRET], and n_chars as it then is; rows without a secret stay as they are."""
    done = find_secrets(docs).withColumn("_cuts", F.when(F.size("secret_spans") > 0, F.col("secret_spans")))
    done = with_left(done, "text", "_cuts", "_left").withColumn("_clean", F.array_join(F.transform("_left", lambda x: x["match"]), "[SECRET]"))
    changed = {"text": F.coalesce("_clean", "text"), "n_chars": F.coalesce(F.char_length("_clean").cast("bigint"), "n_chars")}
    return done.withColumns(changed).select(*DOCUMENT_COLUMNS)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("secret_spans")
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("bigint")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.filter(s, lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        span_text(s).alias("spans"),
    )
