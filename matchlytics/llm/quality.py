"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Signals of a text (share of symbols, capitals, repeated lines, ...) reject it from a cutoff upwards. Cutoffs are
chosen per stratum on a labelled holdout: of the texts labelled good, k of n would be rejected at a cutoff. The
exact binomial p-value P(Bin(n, limit) <= k) tests "the false rejection rate is above `limit`". Cutoffs of a signal
are tested from the mildest to the strictest and the first failure ends the row (fixed sequence, so the row needs no
correction); rows of all strata and signals share `delta` by Bonferroni. With probability 1 - delta no stratum loses
more than `alpha` of its good texts to all signals together. A stratum with too few labelled texts keeps everything.

Texts are measured in one narrow stage. Only numbers are shuffled, to meet the labels. Null text measures as
empty, a null stratum is a stratum of its own, a document labelled more than once counts as good if all its
labels are 1, repeated rows each count, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE, kept_table, let, whole_row

#: Candidate cutoffs of each signal, from the mildest on.
CUTOFFS = {
    "symbol_ratio": (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05),
    "capital_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "bang_ratio": (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeat_ratio": (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "mean_word": (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more.

    Windows are 64-bit hashes. Texts whose windows all differ, nearly all, end there; the others sort their windows
    with their places, so equal ones are neighbours, and add up the words their places cover.
    """
    def covered(at):
        return F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    def places(s):
        twin = lambda x, j: F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(twin(x, j), x["p"])), lambda p: p.isNotNull()))

    def count(wins):
        pairs = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(wins)) == F.size(wins), 0).otherwise(let(let(pairs, places), covered))

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 3, 0).otherwise(let(windows(words), count))


def measures(text: Column) -> Column:
    """Struct of the base measures and the counts behind the signals."""
    t = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(F.regexp_replace(t, chars, ""))

    def of_lines(lines):
        return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))

    def of_words(w):
        return F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _repeat_words(w).alias("repeat"))

    words = let(F.array_remove(F.split(t, f"{SPACE}+"), ""), of_words)
    lines = let(F.filter(F.split(t, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    rest = F.struct((F.length(t) - without(r"[#*$%&|<>]")).alias("symbols"), (F.length(t) - without(r"\p{Lu}")).alias("capitals"), (F.length(t) - without("!")).alias("bangs"))
    return let(F.struct(words.alias("w"), lines.alias("l"), rest.alias("r")), lambda m: F.struct(
        m["w"]["n"].cast("long").alias("n_words"), m["w"]["chars"].cast("long").alias("word_chars"),
        m["r"]["symbols"].cast("long").alias("n_symbols"), m["l"]["dup"].cast("long").alias("n_dup_lines"),
        m["w"]["repeat"].cast("long").alias("n_repeat_words"), m["l"]["n"].cast("long").alias("n_lines"),
        m["r"]["capitals"].cast("long").alias("n_capitals"), m["r"]["bangs"].cast("long").alias("n_bangs")))


def signals(m: Column) -> dict[str, Column]:
    """The signals from a struct of measures; null where a text has no words."""
    share = lambda a, b: F.when(m[b] > 0, m[a] / m[b])
    return {"symbol_ratio": share("n_symbols", "n_words"), "capital_ratio": share("n_capitals", "word_chars"),
            "bang_ratio": share("n_bangs", "n_words"), "dup_line_ratio": share("n_dup_lines", "n_lines"),
            "repeat_ratio": share("n_repeat_words", "n_words"), "mean_word": share("word_chars", "n_words")}


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _log_add(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed in logarithms; 1 where k >= rate * n, where it is no evidence anyway."""
    odds = F.log(F.lit(rate)) - F.log(F.lit(1.0 - rate))
    start = n * F.log(F.lit(1.0 - rate))

    def step(s, i):
        term = s["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), _log_add(s["sum"], term).alias("sum"))

    first = F.struct(start.alias("term"), start.alias("sum"))
    some = F.aggregate(F.sequence(F.lit(1).cast("long"), k), first, step, lambda s: F.exp(s["sum"]))
    return F.when(n.isNull() | (k >= rate * n), 1.0).when(k == 0, F.exp(start)).otherwise(some)


def cutoffs(measured: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", alpha: float = 0.06, delta: float = 0.05) -> DataFrame:
    """Chosen cutoff of each signal (null: the signal is off) per stratum, from the documents labelled good.

    `measured` holds `key`, `stratum` and the struct `m`.
    """
    limit = alpha / len(CUTOFFS)
    good = labels.filter(F.col("quality").isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("_q")).filter("_q = 1")
    rows = measured.join(good, measured[key] == good["_key"]).filter(~base_failed(F.col("m")))
    rejected = [F.count(F.when(s >= c, 1)).alias(f"{name}_{no}") for name, s in signals(F.col("m")).items() for no, c in enumerate(CUTOFFS[name])]
    counts = rows.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *rejected)
    counts = counts.withColumn("strata", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))  # one row per stratum
    long = counts.select("stratum", "n", "strata", F.explode(F.array(*[
        F.struct(F.lit(name).alias("signal"), F.lit(no).alias("no"), F.lit(c).alias("cutoff"), F.col(f"{name}_{no}").alias("k"))
        for name in CUTOFFS for no, c in enumerate(CUTOFFS[name])])).alias("c")).select("stratum", "n", "strata", "c.*")
    passed = binomial_tail(F.col("k"), F.col("n"), limit) <= delta / (F.col("strata") * len(CUTOFFS))
    so_far = Window.partitionBy("stratum", "signal").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("ok", F.min(passed.cast("int")).over(so_far) == 1)
    chosen = [F.min(F.when((F.col("signal") == name) & F.col("ok"), F.col("cutoff"))).alias(f"cut_{name}") for name in CUTOFFS]
    return long.groupBy("stratum").agg(F.max("n").alias("holdout"), *chosen)


#: Up to so many strata the table of cutoffs is broadcast (at most about 5 MB); with more it is joined by a shuffle.
BROADCAST_STRATA = 50_000


def with_verdict(rows: DataFrame, cuts: DataFrame, *, stratum: str = "lang") -> DataFrame:
    """Adds base_failed and kept to rows that hold `stratum` and the struct `m`."""
    cuts = cuts.withColumnRenamed("stratum", "_stratum")
    if cuts.count() <= BROADCAST_STRATA:
        cuts = F.broadcast(cuts)
    out = rows.join(cuts, rows[stratum].eqNullSafe(cuts["_stratum"]), "left")
    fails = reduce(lambda a, b: a | b, [F.coalesce(s >= F.col(f"cut_{name}"), F.lit(False)) for name, s in signals(F.col("m")).items()])
    out = out.withColumn("base_failed", base_failed(F.col("m")))
    return out.withColumn("kept", ~F.col("base_failed") & ~fails).select(*rows.columns, "base_failed", "kept")


def quality_verdicts(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", text: str = "text", alpha: float = 0.06, delta: float = 0.05) -> DataFrame:
    """Per document: `key`, the base measures, base_failed and kept. Texts are measured once and only the numbers kept."""
    measured = kept_table(docs.select(F.col(key), F.col(stratum).alias("_lang"), measures(F.col(text)).alias("m")), "quality")
    cuts = kept_table(cutoffs(measured, labels, key=key, stratum="_lang", alpha=alpha, delta=delta), "cutoffs")
    return with_verdict(measured, cuts, stratum="_lang").select(key, *[F.col(f"m.{n}").alias(n) for n in BASE], "base_failed", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", stratum: str = "lang", text: str = "text", alpha: float = 0.06, delta: float = 0.05) -> DataFrame:
    """The documents that pass, all columns. Documents are written once beside their measures: the cutoffs read only the
    measures, and filters never meet the measuring expressions, which would run again for every mention. Rows with null
    or repeated keys stay apart."""
    rows = docs.select(whole_row(docs).alias("_doc"), F.col(key).alias("_id"), F.col(stratum).alias("_lang"), measures(F.col(text)).alias("m"))
    measured = kept_table(rows, "measured")
    cuts = kept_table(cutoffs(measured.select(F.col("_id").alias(key), "_lang", "m"), labels, key=key, stratum="_lang", alpha=alpha, delta=delta), "cutoffs")
    return with_verdict(measured, cuts, stratum="_lang").filter("kept").select("_doc.*")
