"""Quality rules, centroid clusters and phrases against brute-force versions and SQL, on small tables with the cases that hurt."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelspark.llm import clusters, phrases, quality_rules

from .test_operators import DOCS, TEXTS, beside, documents, edge_rows, same_as_sql

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# -- op11: quality rules


def measured_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    at = {i + k for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(at)


@pytest.mark.parametrize("seed", range(4))
def test_measures(seed):
    r = random.Random(seed)
    texts = [x or "" for x in TEXTS] + ["a b c d e a b c d e f", "x\ny\n\n x\nx\n x\x0bx\x1cx", "a a a a a a", "é" * 9 + "\r\n#é|"]
    texts += ["".join(r.choice("ab \n\t#é\x0c\x85\xa0") for _ in range(r.randrange(300))) for _ in range(100)]
    for t in texts:
        assert quality_rules.measured(t.encode()) == measured_by_hand(t), t[:50]


def rule_rows():
    r = random.Random(5)
    rows = []
    for i in range(900):
        lang, source = r.choice(["en", "de", None]), r.choice(["a", "a", "b", None])
        rows.append((i, " ".join(r.choice(["word", "other", "x|y", "$$", "thing", "more\n"]) + str(r.randrange(60)) for _ in range(r.randrange(60))), lang, source, 1))
    return rows + [(7, "same words", "en", "a", 1)] * 3 + [(None, None, None, None, None), (5, "solitary " * 40, "xx", "rare", 1), (6, " ".join(f"{'long' * 30}{i}" for i in range(40)), "xx", "rare", 1)]


def test_rules_are_those_of_sql(spark):
    assert same_as_sql(spark, {"documents": (rule_rows(), DOCS)}, quality_rules.op11, quality_rules.SQL)
    assert same_as_sql(spark, {"documents": ([(i, t, "en", "s", 1) for i, t in edge_rows()], DOCS)}, quality_rules.op11, quality_rules.SQL)
    assert same_as_sql(spark, {"documents": ([], DOCS)}, quality_rules.op11, quality_rules.SQL)


def test_sketches_merge_in_any_order(spark):
    """Those of two halves, added up, are those of the whole; buckets are exact for small values and near for large ones."""
    m = quality_rules.measure(spark.createDataFrame(rule_rows(), DOCS))
    halves = quality_rules.sketches(m.where("doc_id % 2 = 0")).union(quality_rules.sketches(m.where("doc_id % 2 = 1 or doc_id is null")))
    key = ["level", "lang", "source", "rule", "bucket"]
    assert Counter(map(tuple, halves.groupBy(*key).agg(F.sum("n")).collect())) == Counter(map(tuple, quality_rules.sketches(m).select(*key, "n").collect()))
    got = spark.range(5000).select("id", quality_rules.bucket(F.col("id")).alias("b")).collect()
    assert all(r["b"] <= r["id"] < r["b"] + max(1, r["b"] // 31) and (r["b"] == r["id"] or r["id"] >= 64) for r in got)


def test_rules_adapt_and_keep_own_columns(spark):
    """One source is full of symbols by nature; in the other, a text with a tenth of them stands out."""
    noisy = [(i, " ".join(f"w{i}x{k} |" for k in range(30)), "en", "tables", 1) for i in range(150)]
    plain = [(1000 + i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "prose", 1) for i in range(150)]
    odd = (5000, " ".join(f"q{k}" + "|" * (k % 10 == 0) for k in range(60)), "en", "prose", 1)
    docs = beside(spark.createDataFrame([*noisy, *plain, odd], DOCS), "TEXT", "limits", "n_words", "rule")
    got = quality_rules.keep(docs)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in noisy + plain}
    assert quality_rules.keep(documents(spark, [])).collect() == []


# -- op12: clusters


def clustered_by_hand(rows, k, rounds, scale, size):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            centres[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), centres


def vector_rows(n=90, size=64, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.standard_normal(size).astype(np.float32)]) for i in range(n)]
    same = rows[0][1]
    bad = [(900, None), (901, []), (902, same[:-1]), (903, [float("nan"), *same[1:]]), (904, [float("-inf"), *same[1:]]), (905, [None, *same[1:]])]
    return [*rows, (0, same), (500, same), (501, same), (None, same), (None, [0.0] * size), *bad]


@pytest.mark.parametrize("k", [1, 7, 200])
def test_clusters(spark, k):
    rows = vector_rows(size=5)
    df = beside(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "CLUSTER", "v", "distance")
    got, centres = clusters.cluster(df, k=k, rounds=3, size=5)
    want, by_hand = clustered_by_hand(rows, k, 3, 256, 5)
    assert Counter(map(tuple, got.collect())) == want
    assert centres.tolist() == by_hand


def test_clusters_are_those_of_sql(spark):
    for rows in (vector_rows(), vector_rows(7), []):
        assert same_as_sql(spark, {"embeddings": (rows, "vec_id long, embedding array<float>")}, clusters.op12, clusters.SQL)


@pytest.mark.parametrize("spread, largest", [(0, 9), (3, 300), (50, 40), (1, clusters.LARGEST)])
def test_tree_finds_the_nearest(spread, largest):
    """Ties, equal centroids, clusters far apart and components at the limit."""
    r = np.random.default_rng(spread)
    c = np.concatenate([r.integers(-largest, largest + 1, (20, 4)), np.repeat(r.integers(-largest, largest + 1, (1, 4)), 5, 0)])
    x = np.concatenate([c, r.integers(-largest, largest + 1, (300, 4)), (c[:3] + c[3:6]) // 2])
    who, far, _ = clusters.Tree(c).nearest(x)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, p, strict=True)), j) for j, p in enumerate(c)) for v in x]
    assert [(int(d), int(j)) for d, j in zip(far, who, strict=True)] == want


def test_tree_leaves_out_far_centroids():
    r = np.random.default_rng(1)
    c = r.integers(-1000, 1000, (40, 2))
    x = r.integers(-1000, 1000, (2000, 2))
    assert clusters.Tree(c).nearest(x)[2] < 0.5 * 40 * len(x)


def test_components_beyond_the_limit_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        clusters.whole_vectors(df, size=1).collect()


# -- op13: phrases


def pieces_by_hand(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counts_by_hand(rows):
    f = Counter()
    for r in rows:
        for w in pieces_by_hand(r[1]):
            f[r[2] or "und", 0, ""] += len(w)
            f.update((r[2] or "und", k, " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    return f


def phrase_rows(n=60, seed=2):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["New York", "in the", "of", "Straße", "a", "b.", "c,", "d\n", "É", "x\ty"]) for _ in range(r.randrange(40))), r.choice(["en", "de", None, "und"]), "s", 1) for i in range(n)]
    return [*rows, *rows[:3], *((100 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS)), (None, "a a a a a a a", None, None, None)]


@pytest.mark.parametrize("least, sample", [(3, 2), (2, 10**9)])
def test_frequent_phrases(spark, monkeypatch, least, sample):
    """All are found, whatever the sample (none at all: two passes), and however many words are counted at a time."""
    monkeypatch.setattr(phrases, "FLUSH", 100)
    rows = phrase_rows()
    df = beside(spark.createDataFrame(rows, DOCS), "LANG", "phrase", "n")
    want = {k: n for k, n in counts_by_hand(rows).items() if n >= least or k[1] == 0}
    got = phrases.mine(df, least, sample).collect()
    assert len(got) == len({tuple(r)[:3] for r in got})
    assert {(r["lang"], r["length"], r["phrase"]): r["n"] for r in got} == want


def test_passes_go_on_until_closed(spark):
    """Without a proposal, a pass finds the words, the next the pairs, and so on."""
    docs = spark.createDataFrame([("en", "p q r s t. p q r s t. u v w")], "lang string, text string")
    found, passes = phrases.frequent_phrases(docs, 2, None, "f")
    assert passes == 5 and found.where("length = 5").select("phrase").collect() == [("p q r s t",)]
    found, passes = phrases.frequent_phrases(docs, 2, phrases.filter_of(found), "f")
    assert passes == 1 and found.where("length = 5").count() == 1
    found, passes = phrases.frequent_phrases(docs, 2, None, "f", eager=True)
    assert passes == 2 and sorted(r["n"] for r in found.where("length > 3").collect()) == [2, 2, 2]


def test_phrases_are_those_of_sql(spark):
    rows = phrase_rows(400, 9)
    assert same_as_sql(spark, {"documents": (rows, DOCS)}, phrases.op13, phrases.SQL)
    assert phrases.mine(documents(spark, [])).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 10**10
    found = spark.createDataFrame([("x", 0, "", 10**14), ("x", 1, "a", 3 * big), ("x", 1, "b", 7 * big), ("x", 1, "c", big), ("x", 2, "a b", 2 * big), ("x", 2, "b c", big - 1), ("x", 3, "a b c", big - 2)], "lang string, length int, phrase string, n long")
    got = {r["phrase"]: r for r in phrases.best(phrases.scored(found)).collect()}
    assert got["a b"]["score"] == 1000 * 2 * big * 10**14 // (21 * big * big)
    cuts = [(1000 * (big - 2) * 10**14 // (left * right), k, left, right) for k, left, right in ((1, 3 * big, big - 1), (2, 2 * big, big))]
    score, _, left, right = min(cuts)
    assert (got["a b c"]["score"], got["a b c"]["l"], got["a b c"]["r"]) == (score, left, right)
    assert Fraction(score) <= Fraction(1000 * (big - 2) * 10**14, left * right) < score + 1


def test_covered_phrases_and_the_first_of_a_language(spark):
    rows = [("x", 0, "", 1000), ("x", 1, "a", 50), ("x", 1, "b", 20), ("x", 1, "c", 20), ("x", 2, "a b", 20), ("x", 2, "b c", 20), ("x", 3, "a b c", 20)]
    got = phrases.scored(spark.createDataFrame(rows, "lang string, length int, phrase string, n long")).collect()
    assert [r["phrase"] for r in got] == ["a b c"]
    many = spark.createDataFrame([("x", f"p{i:03} q", 1, 1, 1, 9, i // 2) for i in range(300)], "lang string, phrase string, a long, l long, r long, n long, score long")
    want = sorted(((i // 2, f"p{i:03} q") for i in range(300)), key=lambda x: (-x[0], x[1]))[:10]
    assert [(r["score"], r["phrase"], r["rank"]) for r in phrases.best(many, 10).orderBy("rank").collect()] == [(s, p, i + 1) for i, (s, p) in enumerate(want)]
