"""Token counts kept up to date by signed deltas.

A change is an insert, a delete or a revised count of a document. It becomes a signed number of documents and tokens,
summed by source, language and tokenizer version before anything is stored. A batch is committed once: its sums are a
Parquet folder of their own, which counts from when a note with the batch's name says so, and a name can be written once only.
So a batch that broke off does not count and can be repeated, also by two at once. Totals are the sum over the batches, or over the
last snapshot of totals and the batches since.

Deltas combine on the map side, so a hot source sends one row per task. Null sources and languages are groups of
their own; null or empty text counts 0 tokens; an empty batch commits with no rows. A batch may say the same change
twice (a retry of its producer): changes with equal (change_id) count once where `distinct` is asked for.
"""

from __future__ import annotations

import base64
import json
import uuid
from functools import lru_cache
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.state import Conflict, put_if_absent

GROUP = ("source", "lang", "tokenizer")
#: The pattern of the byte-level vocabulary (fixed value): splits texts before pairs are merged.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters given to the tokenizer at a time; longer texts are cut before white space that follows a word.
STRETCH = 1 << 16


@lru_cache(maxsize=2)
def _tokenizer(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str):
    """Pieces of a text that tokenize like the whole: no word of the pattern goes across a space between two letters."""
    at = 0
    while len(text) - at > STRETCH:
        cut = at + STRETCH
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1 : cut + 2].isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _counter(ranks):
    def count(texts: pd.Series) -> pd.Series:
        tokens = _tokenizer(ranks.value)
        return pd.Series([0 if not t else sum(len(tokens.encode_ordinary(s)) for s in stretches(t)) for t in texts])
    return count


def with_tokens(docs: DataFrame, ranks_path: str, *, text: str = "text", out: str = "tokens") -> DataFrame:
    """Adds the number of tokens of the whole text."""
    with open(ranks_path, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary, under 1 MB whatever the corpus
    return docs.withColumn(out, F.pandas_udf(_counter(ranks), "long")(F.col(text)))


def deltas(changes: DataFrame, *, distinct: bool = False) -> DataFrame:
    """Signed sums per group of changes (op, source, lang, tokenizer, tokens, old_tokens).

    op is insert (+tokens), delete (-tokens) or revise (tokens - old_tokens, no document more or less).
    """
    if distinct:
        changes = changes.dropDuplicates(["change_id"])
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens, old = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("tokens", "old_tokens"))
    change = F.when(F.col("op") == "revise", tokens - old).otherwise(sign * tokens)
    return changes.groupBy(*GROUP).agg(F.sum(sign).cast("long").alias("docs"), F.sum(change).cast("long").alias("tokens"), F.count(F.lit(1)).alias("changes"))


SUMS = "source string, lang string, tokenizer string, docs long, tokens long, changes long"


def _notes(spark: SparkSession, pattern: str) -> list[tuple[str, dict]]:
    """Names and contents of the small files that state what counts."""
    try:
        files = spark.read.option("wholetext", "true").text(pattern).select(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1).alias("name"), "value")
        return sorted((unquote(unquote(r["name"])), json.loads(r["value"])) for r in files.collect())  # one row per batch
    except AnalysisException as exc:  # nothing has been written yet
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _digest(sums: DataFrame) -> str:
    """A digest of the rows of a table, in any order."""
    cols = [F.col(c) for c in sums.columns]
    parts = [F.sum(F.xxhash64(F.lit(i), *cols, *[c.isNull() for c in cols]).cast("decimal(38,0)")) for i in (1, 2)]
    return ":".join(str(v or 0) for v in sums.agg(F.count(F.lit(1)), *parts).first())


def commit(store: str, batch: str, changes: DataFrame, *, distinct: bool = False) -> bool:
    """Adds a batch to the store; says whether it was added, or was there already with the same sums.

    The sums go to a folder of their own, which counts once the batch's note names it. A note is written in one step and never again:
    of two tries at once one is added, the other one finds it and compares the digest of its sums. A batch name that is
    used again for other changes is an error.
    """
    spark = changes.sparkSession
    folder, note = f"data-{uuid.uuid4().hex}", f"{store}/notes/batch-{quote(batch, safe='')}"
    deltas(changes, distinct=distinct).write.parquet(f"{store}/{folder}")
    digest = _digest(spark.read.schema(SUMS).parquet(f"{store}/{folder}"))
    try:
        put_if_absent(spark, note, json.dumps({"folder": folder, "digest": digest}))
        return True
    except Conflict:
        known = dict(_notes(spark, f"{store}/notes/batch-*"))[f"batch-{batch}"]
        if known["digest"] != digest:
            raise ValueError(f"batch {batch!r} has been committed with other changes") from None
        return False


def _sums(spark: SparkSession, store: str) -> tuple[DataFrame, list[str], list[str]]:
    """Rows whose sums are the totals, the batches in them, and those beyond the last snapshot."""
    batches = {name.removeprefix("batch-"): note["folder"] for name, note in _notes(spark, f"{store}/notes/batch-*")}
    base = max((note for _, note in _notes(spark, f"{store}/notes/totals-*")), key=lambda n: len(n["batches"]), default={"folder": None, "batches": []})
    later = sorted(set(batches) - set(base["batches"]))
    folders = [f for f in (base["folder"], *(batches[b] for b in later)) if f]
    rows = spark.read.schema(SUMS).parquet(*[f"{store}/{f}" for f in folders]) if folders else spark.createDataFrame([], SUMS)
    return rows, sorted(batches), later


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(*[F.sum(c).cast("long").alias(c) for c in ("docs", "tokens", "changes")])


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Totals over all batches: those of the last snapshot and the batches since. Groups whose documents have all gone stay, with zeros."""
    return _totals(_sums(spark, store)[0])


def snapshot(spark: SparkSession, store: str) -> bool:
    """Keeps the totals up to now, so that later ones only read them and what is committed after. Says whether anything was new."""
    rows, batches, later = _sums(spark, store)
    if not later:
        return False
    folder = f"data-{uuid.uuid4().hex}"
    _totals(rows).write.parquet(f"{store}/{folder}")
    put_if_absent(spark, f"{store}/notes/totals-{uuid.uuid4().hex}", json.dumps({"folder": folder, "batches": batches}))
    return True
