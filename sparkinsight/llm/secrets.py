"""Secret scan: fixed base patterns, and character Markov models for other random strings.

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples: values that the base patterns catch
are random, the other words of the sampled texts are ordinary.  A long run of key
characters outside the base spans becomes a span when its log-likelihood ratio favours
the random model.  DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns, the group whose length counts, and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": (ASSIGN, 2, 8), "access": (r"AKIA[A-Z0-9]+", 0, 16), "hex": (r"[0-9a-f]{32,}", 0, 32)}
KINDS = [*BASE, "markov"]
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _spans(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Matches with start and end in code points: gap and match lengths, summed up."""
    p = F.lit(pattern)
    matches = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group)) if group else matches
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), matches.alias("hit"), values.alias("value"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    none = F.lit(None).cast("int")
    empty = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("kind"), none.alias("end"),
                                      F.lit("").alias("value"))).cast(SPAN), lambda s: s["end"].isNotNull())
    out = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda a: a["out"])
    out = F.filter(out, lambda s: s["end"].isNotNull() & (F.length(s["value"]) >= least))
    return F.when(text.rlike(pattern), out).otherwise(empty)


def with_base_spans(docs: DataFrame) -> DataFrame:
    t = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    cols = [_spans(F.col("_t"), p, g, n, k).alias(f"_{name}") for k, (name, (p, g, n)) in enumerate(BASE.items())]
    return t.select("*", *cols)


def _bigrams(words: DataFrame) -> DataFrame:
    """(a, b, n): counts of adjacent ASCII characters over a column ``w`` of strings."""
    w = words.where(F.length("w") >= 2)
    pairs = F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring(F.col("w"), i, F.lit(2)))
    return (w.select(F.explode(pairs).alias("ab"))
            .select(F.ascii("ab").alias("a"), F.ascii(F.substring("ab", 2, 1)).alias("b"))
            .groupBy("a", "b").agg(F.count("*").alias("n")))


def train(docs: DataFrame, sample_docs: int = 2000, smooth_random: float = 50.0, smooth_word: float = 0.5) -> Column:
    """Table of log P(b|a; random) - log P(b|a; ordinary), a 128 * 128 array literal.

    Each model is fitted on a bounded sample: the ``sample_docs`` documents of least id
    hash (with base matches for the random model).  Smoothing draws the random model to
    the uniform one.  At most one row per pair of key characters reaches the driver.
    """
    chars = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    order = F.xxhash64("doc_id", "_t")
    d = with_base_spans(docs)
    hits = d.select("doc_id", "_t", F.concat("_assign", "_access", "_hex").alias("s")).where(F.size("s") > 0)
    rand = hits.orderBy(order).limit(sample_docs).select(F.explode("s.value").alias("w"))
    words = (d.select("doc_id", "_t").orderBy(order).limit(sample_docs)
             .select(F.explode(F.regexp_extract_all("_t", F.lit(r"[A-Za-z_]{2,}"), F.lit(0))).alias("w")))
    key = F.col("a").isin(chars) & F.col("b").isin(chars)
    rows = (_bigrams(rand).where(key).withColumn("m", F.lit(0))
            .unionByName(_bigrams(words).where(key).withColumn("m", F.lit(1))).collect())
    count = [{}, {}]
    total = [{}, {}]
    for r in rows:
        count[r["m"]][r["a"], r["b"]] = r["n"]
        total[r["m"]][r["a"]] = total[r["m"]].get(r["a"], 0) + r["n"]
    smooth, k = (smooth_random, smooth_word), len(chars)
    table = [0.0] * (128 * 128)
    import math
    for a in chars:
        for b in chars:
            lr, lw = (math.log((count[m].get((a, b), 0) + smooth[m]) / (total[m].get(a, 0) + smooth[m] * k)) for m in (0, 1))
            table[a * 128 + b] = round(lr - lw, 6)
    return F.from_json(F.lit(json.dumps(table)), "array<double>")


def log_ratio(word: Column, table: Column) -> Column:
    """Log-likelihood ratio of a string of key characters, summed over adjacent pairs."""
    start = F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("sum"))

    def step(acc, c):
        b = F.ascii(c)
        gain = F.when(acc["a"] < 0, 0.0).otherwise(F.get(table, acc["a"] * 128 + b))
        return F.struct(b.alias("a"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(F.split(word, ""), start, step, lambda a: a["sum"])


def scan(docs: DataFrame, sample_docs: int = 2000, least: int = 20, threshold: float = 12.0) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans.

    ``spans`` joins kind:start:end (code points, end exclusive) of all spans by start,
    then kind; ``base_sha256`` hashes the same text of the base spans alone.  Runs of
    ``least`` or more key characters that touch no base span and whose log-likelihood
    ratio reaches ``threshold`` are added as kind markov.  Null text counts as empty.
    """
    table = train(docs, sample_docs)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    d = with_base_spans(docs.select("doc_id", "text")).withColumn("_base", F.concat("_assign", "_access", "_hex"))
    runs = _spans(F.col("_t"), r"[A-Za-z0-9+/_=-]{%d,}" % least, 0, least, len(BASE))
    free = F.filter(runs, lambda s: ~F.exists(F.col("_base"), lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    d = d.withColumn("_markov", F.filter(free, lambda s: log_ratio(s["value"], table) >= threshold))
    line = lambda spans: F.array_join(F.transform(
        F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    return d.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
                    F.sha2(line(F.col("_base")), 256).alias("base_sha256"),
                    line(F.concat("_base", "_markov")).alias("spans"))
