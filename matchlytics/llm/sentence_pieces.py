"""Encoding into and decoding from word pieces: unigram Viterbi over a double-array trie, with byte fallback.

The text gets a marker for each space and one in front. A piece has markers only at its start, so the best
segmentation of a text is that of its words one after the other. A task keeps the words it has seen (up to a bound)
and segments the new ones of a batch together: numpy walks all words in step, byte position by byte position, through
the trie and keeps the best score and the last piece of every prefix. A character that is no piece by itself costs
`UNKNOWN` below the worst piece and comes out as its bytes. Where only few words go on (unbroken text), these are finished one
by one, by the same rules.

The pieces come from a model file (path is a parameter). A unigram model brings its log scores. Other models only have an
order of pieces, most frequent first; their scores are the logarithms of a Zipf-Mandelbrot law over that order.

The scan is narrow: no shuffle, and texts of any length go through in bounded batches of words. Null and empty texts give no
pieces. A text that holds the marker itself decodes with spaces in its place, as in the original scheme.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

MARK = "▁"
UNKNOWN = 10.0
#: Words that a task remembers; above it starts anew.
REMEMBERED = 150_000
#: Characters of texts that are cut into words at a time, and bytes of new words segmented at a time.
PIECE_OF_TEXT, STEP_BYTES = 1 << 20, 1 << 22
#: Words that are segmented in step at least.
FEW_WORDS = 16


class Trie:
    """Double-array trie over byte strings: child of `node` by byte b is base[node] + b if check[there] == node."""

    def __init__(self, words: list[bytes]):
        order = sorted(range(len(words)), key=words.__getitem__)
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], free, wide, todo = 0, 257, 1, [(0, 0, len(order), 0)]
        while todo:
            node, lo, hi, depth = todo.pop()
            while lo < hi and len(words[order[lo]]) == depth:
                value[node], lo = order[lo], lo + 1
            groups = []
            while lo < hi:
                b, end = words[order[lo]][depth], lo
                while end < hi and words[order[end]][depth] == b:
                    end += 1
                groups.append((b, lo, end))
                lo = end
            if not groups:
                continue
            while free < len(check) and check[free] >= 0:
                free += 1
            # a lone child fits into the first free cell; nodes with more look on from where the last one fitted
            at = max(1, free - groups[0][0]) if len(groups) == 1 else max(wide, free - groups[0][0])
            while True:
                if at + 256 >= len(check):
                    base, check, value = base + [0] * len(base), check + [-1] * len(check), value + [-1] * len(value)
                if all(check[at + b] < 0 for b, _, _ in groups):
                    break
                at += 1
            wide = wide if len(groups) == 1 else at
            base[node] = at
            for b, first, end in groups:
                check[at + b] = node
                todo.append((at + b, first, end, depth + 1))
        self.base, self.check, self.value = (np.array(x, dtype=np.int32) for x in (base, check, value))


class Pieces:
    """A vocabulary ready for encoding: trie, scores, and the bytes of each id."""

    def __init__(self, pieces: list[tuple[str, float, bool]]):
        """(piece, log score, whether it stands for a byte) by id; a piece with score None is never used."""
        usable = [i for i, (p, s, byte) in enumerate(pieces) if s is not None and not byte and p]
        self.trie = Trie([pieces[i][0].encode() for i in usable])
        self.ids = np.array(usable, dtype=np.int32)
        self.scores = np.array([pieces[i][1] for i in usable], dtype=np.float64)
        self.bytes = np.full(256, -1, dtype=np.int32)
        self.raw: list[bytes] = []
        for i, (p, s, byte) in enumerate(pieces):
            if byte:
                self.bytes[int(p[3:5], 16)] = i
            self.raw.append(bytes([int(p[3:5], 16)]) if byte else p.replace(MARK, " ").encode() if s is not None else b"")
        self.longest = max((len(pieces[i][0].encode()) for i in usable), default=1)
        self.worst = float(self.scores.min() if len(usable) else 0.0) - UNKNOWN
        # characters that are in no piece end a word as well
        lone = "" if any("\n" in pieces[i][0] for i in usable) else "\n"
        self.cutter = re.compile(f"{lone}|{MARK}+[^{MARK}{lone}]*|[^{MARK}{lone}]+" if lone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.border = re.compile(f"[^{MARK}]{MARK}")
        self.lists = [x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.scores, self.ids)]
        self.known: dict[str, bytes] = {}

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of the best pieces of each word, four bytes each, all words in step."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        data = np.frombuffer(b"".join(raw[i] for i in order) + bytes(self.longest + 4), dtype=np.uint8)
        size = np.array([len(raw[i]) for i in order], dtype=np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        cell = start + np.arange(len(size))  # place of each word's first score
        best = np.full(int(size.sum()) + len(size) + 1, -np.inf)
        back, piece = np.zeros(len(best), dtype=np.int32), np.full(len(best), -1, dtype=np.int32)
        best[cell] = 0.0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        shrink = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        # few words reach far: these are finished one by one, a step of all words would cost more than it does
        alone = int(np.searchsorted(-shrink, -FEW_WORDS, side="right"))
        for pos in range(alone):
            live = np.flatnonzero(best[cell[: shrink[pos]] + pos] > -np.inf)
            here, byte_at, left = cell[live] + pos, start[live] + pos, size[live] - pos
            score = best[here]
            lead = data[byte_at]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(len(live), dtype=bool)
            walk, node = np.arange(len(live)), np.zeros(len(live), dtype=np.int32)
            for step in range(1, self.longest + 1):
                to = base[node] + data[byte_at[walk] + step - 1]
                ok = (base[node] > 0) & (check[np.minimum(to, len(check) - 1)] == node) & (left[walk] >= step)
                walk, node = walk[ok], to[ok]
                if not len(walk):
                    break
                found = value[node]
                hit = found >= 0
                who, which = walk[hit], found[hit]
                single[who[char[who] == step]] = True
                total, there = score[who] + self.scores[which], here[who] + step
                better = total > best[there]
                there = there[better]
                best[there], back[there], piece[there] = total[better], step, self.ids[which[better]]
            rest = np.flatnonzero(~single)
            if len(rest):
                total, there = score[rest] + self.worst, here[rest] + char[rest]
                better = total > best[there]
                there = there[better]
                best[there], back[there], piece[there] = total[better], char[rest[better]], -1
        for k in range(int(shrink[alone]) if alone < len(shrink) else 0):
            lane = slice(int(cell[k]), int(cell[k] + size[k]) + 1)
            best[lane], back[lane], piece[lane] = self._finish(raw[order[k]], alone, best[lane].tolist(), back[lane].tolist(), piece[lane].tolist())
        out = [b""] * len(words)
        back_, piece_ = back.tolist(), piece.tolist()
        for k, i in enumerate(order):
            at, ids = int(size[k]), []
            c = int(cell[k])
            while at:
                step, p = back_[c + at], piece_[c + at]
                if p >= 0:
                    ids.append(p)
                else:
                    ids.extend(int(self.bytes[b]) for b in reversed(raw[i][at - step : at]))
                at -= step
            out[i] = array("i", reversed(ids)).tobytes()
        return out

    def _finish(self, raw: bytes, at: int, best: list, back: list, piece: list):
        """The best prefixes of one word from position `at` on."""
        base, check, value, scores, ids = self.lists
        n, never = len(raw), -math.inf
        for pos in range(at, n):
            score = best[pos]
            if score == never:
                continue
            lead = raw[pos]
            char = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            single, node = False, 0
            for to in range(pos, min(n, pos + self.longest)):
                below = base[node]
                cell = below + raw[to]
                if below <= 0 or cell >= len(check) or check[cell] != node:
                    break
                node, found, step = cell, value[cell], to - pos + 1
                if found >= 0:
                    single = single or step == char
                    if score + scores[found] > best[to + 1]:
                        best[to + 1], back[to + 1], piece[to + 1] = score + scores[found], step, ids[found]
            if not single and score + self.worst > best[pos + char]:
                best[pos + char], back[pos + char], piece[pos + char] = score + self.worst, char, -1
        return best, back, piece

    def words(self, text: str):
        """The words of a text with markers, from stretches that end where no piece can go on: before the first marker after another
        character, since pieces have markers at their start only."""
        marked = MARK + text.replace(" ", MARK)
        at = 0
        while at < len(marked):
            end = at + PIECE_OF_TEXT
            if end < len(marked):
                border = self.border.search(marked, end - 1)
                end = border.end() - 1 if border else len(marked)
            yield self.cutter.findall(marked[at:end])
            at = end

    def _learn(self, words) -> None:
        new = list(words)
        while new:
            take, size = 0, 0
            while take < len(new) and size < STEP_BYTES:
                size, take = size + 4 * len(new[take]), take + 1
            self.known.update(zip(new[:take], self.segment(new[:take]), strict=True))
            new = new[take:]

    def encode_all(self, texts) -> list[np.ndarray]:
        """Ids of each text."""
        out, waiting, size = [], [], 0

        def flush():
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self._learn(set().union(*(p for t in waiting for p in t)).difference(self.known))
            for t in waiting:
                out.append(np.frombuffer(b"".join([self.known[w] for p in t for w in p]), dtype=np.int32))
            waiting.clear()

        for text in texts:
            waiting.append(list(self.words(text)) if text else [])
            size += len(text or "")
            if size > PIECE_OF_TEXT:
                flush()
                size = 0
        flush()
        return out

    def decode(self, ids) -> str:
        data = b"".join([self.raw[i] for i in ids])
        return data.decode("utf-8", "replace").removeprefix(" ")


def zipf_scores(n: int, *, shift: float = 10.0) -> list[float]:
    """Log probabilities of ranks 0..n-1 under a Zipf-Mandelbrot law."""
    total = math.log(sum(1.0 / (r + shift) for r in range(n)))
    return [-math.log(r + shift) - total for r in range(n)]


def model_pieces(data: bytes) -> list[tuple[str, float | None, bool]]:
    """(piece, log score or None, is a byte) of a model file's content."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(data)
    kinds = pb.ModelProto.SentencePiece
    normal = [i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
    scores = {i: model.pieces[i].score for i in normal}
    if model.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
        scores = dict(zip(normal, zipf_scores(len(normal)), strict=True))
    return [(p.piece, scores.get(i), p.type == kinds.BYTE) for i, p in enumerate(model.pieces)]


@lru_cache(maxsize=2)
def _pieces(data: bytes) -> Pieces:
    return Pieces(model_pieces(data))


def _encoder(model, text: str, out: str, drop: bool, rows: int = 512, flag=None):
    """Function for mapInArrow: adds the ids as the last column, a few rows at a time, so that ids never pile up."""
    def encode(batches):
        import pyarrow as pa

        pieces = _pieces(model.value)
        for batch in batches:
            names = [n for n in batch.schema.names if not (drop and n == text) and n not in (out, flag)]
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = part.column(text).to_pylist()
                ids = pieces.encode_all(texts)
                made = {out: pa.array(ids, type=pa.list_(pa.int32()))}
                if flag:
                    made[flag] = pa.array([pieces.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)], type=pa.bool_())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made.values()], names=[*names, *made])
    return encode


def _decoder(model):
    def decode(ids: pd.Series) -> pd.Series:
        pieces = _pieces(model.value)
        return pd.Series([None if i is None else pieces.decode(i) for i in ids])
    return decode


def _digester(model):
    def digest(texts: pd.Series) -> pd.DataFrame:
        pieces, rows = _pieces(model.value), []
        low, high = int(pieces.bytes.min()), int(pieces.bytes.max())
        at = 0
        while at < len(texts):
            part = texts.iloc[at : at + 512]
            for text, ids in zip(part, pieces.encode_all(part), strict=True):
                fallback = int(((ids >= low) & (ids <= high)).sum()) if low >= 0 else 0
                rows.append((len(ids), fallback, hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), pieces.decode(ids) == (text or "")))
            at += 512
        return pd.DataFrame(rows, columns=["n_pieces", "n_bytes", "ids_sha256", "round_trip"])
    return digest


def _shared(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:  # a vocabulary: some hundred kB whatever the corpus
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, *, text: str = "text", out: str = "ids", drop_text: bool = False, round_trip: str | None = None) -> DataFrame:
    """Adds the ids of the text's pieces; with `drop_text` the text itself isn't carried along.

    `round_trip` names a column for whether decoding the ids gives the text back. Columns of these names are replaced.
    """
    keep = [n for n in docs.columns if not (drop_text and n == text) and n not in (out, round_trip)]
    quoted = lambda n: F.col("`" + n.replace("`", "``") + "`")
    # under plain names, because mapInArrow cannot take names with dots
    rows = docs.select(quoted(text).alias("text"), *[quoted(n).alias(f"c{i}") for i, n in enumerate(keep) if n != text])
    new = [("out", ArrayType(IntegerType())), ("flag", BooleanType())][: 2 if round_trip else 1]
    drop = text not in keep
    made = StructType([f for f in rows.schema if not (drop and f.name == "text")] + [StructField(n, kind) for n, kind in new])
    done = rows.mapInArrow(_encoder(_shared(docs, model_path), "text", "out", drop, flag="flag" if round_trip else None), made)
    return done.select(*[F.col("text" if n == text else f"c{i}").alias(n) for i, n in enumerate(keep)], F.col("out").alias(out),
                       *([F.col("flag").alias(round_trip)] if round_trip else []))


def decode(docs: DataFrame, model_path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for."""
    return docs.withColumn(out, F.pandas_udf(_decoder(_shared(docs, model_path)), "string")(F.col(ids)))


def piece_digests(docs: DataFrame, model_path: str, *, keep=("doc_id",), text: str = "text") -> DataFrame:
    """`keep`, number of pieces and of byte pieces, digest of the ids, and whether decoding gives the text back."""
    made = "n_pieces long, n_bytes long, ids_sha256 string, round_trip boolean"
    rows = docs.select(*keep, F.pandas_udf(_digester(_shared(docs, model_path)), made)(F.col(text)).alias("_d"))
    return rows.select(*keep, "_d.*")
