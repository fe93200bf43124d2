"""Keyword hits in transcripts and labels from spotting models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYWORDS, LABEL_MAP
from ..functions.ordered import keys_of, unnest
from ..functions.text import strip


def keyword_signals(segments: DataFrame, keywords: dict | None = None, *, whole_word: bool = False) -> DataFrame:
    """One signal per segment and kind: the first keyword, in list order, that the text contains.

    The word lists are parameters, so this stays a projection: no join and no exchange.
    """
    keywords = keywords or KEYWORDS
    low = F.col("_low")

    def found(word):
        if whole_word:
            return low.rlike(r"(?U)\b\Q" + word + r"\E\b")
        return F.contains(low, F.lit(word))

    hits = []
    for kind, words in keywords.items():
        if not words:
            continue
        first = F.coalesce(*[F.when(found(w), F.lit(w)) for w in words])
        hits.append(F.when(first.isNotNull(), F.struct(
            F.lit(kind).alias("kind_hint"), first.alias("phrase"),
            F.lit(0.7 if kind == "goal" else 0.5).alias("strength"))))
    # lower-cased once in a step of its own, not once per word
    rows = segments.withColumn("_low", F.lower(F.coalesce("text", F.lit(""))))
    rows = unnest(rows, segments.columns, F.array_compact(F.array(*hits)), "_h")
    rest = [c for c in segments.columns if c not in ("start_s", "text")]
    return rows.select(*rest, F.col("start_s").alias("t"), F.lit("commentary").alias("source"), "_h.strength",
                       "_h.kind_hint", "_h.phrase", F.substring(strip(F.col("text")), 1, 120).alias("text"))


def spot_signals(spots: DataFrame, label_map: dict | None = None, *, min_conf: float = 0.5) -> DataFrame:
    """Signals from spotted labels; labels outside the map are dropped, `label_map` overrides the default one."""
    known = {**LABEL_MAP, **(label_map or {})}
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    kind = F.try_element_at(lookup, F.lower("label"))
    rest = [c for c in spots.columns if c not in ("label", "conf")]
    return (spots.filter(F.col("conf") >= min_conf).withColumn("kind_hint", kind)
            .filter(F.col("kind_hint").isNotNull())
            .select(*rest, F.lit("action_spotting").alias("source"),
                    F.least(F.lit(1.0), F.col("conf")).alias("strength"), "kind_hint", "label"))


_SPOT = "t double, label string, conf double, error string"


def _message(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}"[:500]


def register_spotter(spark, name: str, spotter):
    """Registers `spotter(text) -> iterable of (t, label, conf)` as a Python table function `name`.

    User code fails on its own: where it raises, or gives something that is no spot, what it gave before stays and one row with
    the `error` follows. `split_spots` parts the two.
    """
    from pyspark.sql.functions import udtf

    class Spotter:
        def eval(self, body: str):
            try:
                for t, label, conf in spotter(body):
                    yield float(t), str(label), float(conf), None
            except Exception as exc:  # the text costs its own spots, not the job
                yield None, None, None, _message(exc)

    spark.udtf.register(name, udtf(Spotter, returnType=_SPOT, useArrow=True))


def register_match_spotter(spark, name: str, make):
    """Registers a spotter that sees whole matches as a table function `name(TABLE(rows), settings)`.

    `settings` is a JSON object; `by` and `order` in it name the columns that part and order the rows (match_id and seq by default).
    The function declares that partitioning itself, so Spark brings each match to one task, in order. There `make(settings)`
    gives an object for each match with `see(row)`, called for every row, and `end()`, both iterables of (t, label, conf); it only has
    to keep what it needs of the rows before. Where it raises, the match gets one row with the `error` and is not
    looked at any further; spots before that stay, other matches go on.
    """
    import json

    from pyspark.sql.functions import AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
    from pyspark.sql.types import DoubleType, StringType, StructType

    def read(settings):
        return {"by": "match_id", "order": "seq", **json.loads(settings or "{}")}

    class Spotter:
        def __init__(self):
            self.spotter, self.key, self.failed = None, None, False

        @staticmethod
        def analyze(rows, settings):
            if not rows.isTable or settings.value is None:
                raise ValueError(f"{name} takes a table and its settings as a constant JSON text")
            chosen = read(settings.value)
            missing = {chosen["by"], chosen["order"]} - set(rows.dataType.fieldNames())
            if missing:
                raise ValueError(f"{name}: no column {', '.join(sorted(missing))}")
            schema = StructType([rows.dataType[chosen["by"]]]).add("t", DoubleType()).add("label", StringType()).add("conf", DoubleType()).add("error", StringType())
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(chosen["by"])], orderBy=[OrderingColumn(chosen["order"])])

        def _spots(self, call):
            if self.failed:
                return
            try:
                for t, label, conf in call() or ():
                    yield self.key, float(t), str(label), float(conf), None
            except Exception as exc:  # the match costs its own spots, not the job
                self.failed = True
                yield self.key, None, None, None, _message(exc)

        def _start(self, settings):
            self.spotter = make(settings)
            return ()

        def eval(self, row, settings):
            if self.spotter is None and not self.failed:
                chosen = read(settings)
                self.key = row[chosen["by"]]
                yield from self._spots(lambda: self._start(chosen))
            yield from self._spots(lambda: self.spotter.see(row))

        def terminate(self):
            if self.spotter is not None:
                yield from self._spots(lambda: self.spotter.end())

    spark.udtf.register(name, udtf(Spotter))


def split_spots(found: DataFrame, detector: str, *, by="match_id"):
    """What a spotter found, and a row (keys, detector, n_failed, error) for every match on which it raised; `error` is the first
    message in alphabetical order."""
    keys = keys_of(by)
    errors = (found.filter(F.col("error").isNotNull()).groupBy(*keys)
              .agg(F.count(F.lit(1)).alias("n_failed"), F.min("error").alias("error")))
    return found.filter(F.col("error").isNull()).drop("error"), errors.select(*keys, F.lit(detector).alias("detector"), "n_failed", "error")


def isolate_failures(rows: DataFrame, value, *, raw: str, detector: str, by="match_id"):
    """Splits rows into those where `value` (a try_ expression) holds and a per-key table of failures.

    A failing row yields no signal and never fails the job.
    """
    tried = rows.withColumn("value", value)
    bad = F.col("value").isNull()
    errors = (tried.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_failed"),
                                    F.min(F.when(bad, F.coalesce(F.col(raw), F.lit("")))).alias("first_error"))
              .withColumn("detector", F.lit(detector))
              .withColumn("status", F.when(F.col("n_failed") == F.col("n_rows"), "failed")
                          .when(F.col("n_failed") > 0, "partial").otherwise("ok")))
    return tried.filter(~bad), errors
