"""Personal data: keyed surrogates of the same type, gender, script and format for all detected entities.

1. Detect: texts that pass a test in Spark go to Python, which finds e-mail addresses, phone, card and account
   numbers, IP addresses, secrets and names, as (type, value) with the value in a canonical form (digits, lower case).
   A name found by a title or a listed given name is also found where the text says it alone, before or after.
2. Assign: all distinct entities of the corpus get a candidate surrogate from an HMAC of type, value and attempt. A
   candidate that is an entity of the corpus itself, or that another entity has (the smaller value keeps it), is
   tried again with the next attempt. So different entities stay different, one entity is replaced the same way in
   all texts and spellings, and no surrogate points at anyone in the corpus. Later attempts lengthen the value, or
   take addresses from wider ranges, so that a full format cannot stop the assignment.
3. Replace: each distinct text gets the surrogates of its own entities by joins, and the values are written
   back in the form of the mention (separators, brackets, upper case).

Joins are on (type, value) and on the digest of the text; copies of a text are detected apart but aggregated before
the shuffle. Null text stays null, a text without entities stays as it is, repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_table, whole_row

#: Given names by gender and script (fixed values).
GIVEN = {
    ("f", "latin"): "Anna Maria Julia Laura Sarah Emma Sophie Claudia Isabel Carmen Helen Alice Martha Nicole Teresa Monika Charlotte Camille",
    ("m", "latin"): "John Peter Thomas Michael David Robert Carlos Miguel Pierre Antoine Hans Klaus Stefan Andreas William George Henry Francisco",
    ("f", "cyrillic"): "Анна Мария Ольга Елена Наталья Татьяна Ирина Светлана Екатерина Юлия",
    ("m", "cyrillic"): "Иван Пётр Сергей Алексей Дмитрий Николай Владимир Андрей Михаил Павел",
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Δήμητρα Ιωάννα Βασιλική",
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Νίκος Παναγιώτης Βασίλης Χρήστος Αντώνης",
}
#: Titles and the gender they tell (fixed values).
TITLES = {"Mr": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Dr": "n", "Prof": "n", "господин": "m", "госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: Syllables and endings of made-up names by script (fixed values).
SYLLABLES = {"latin": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se ta te ti to va ve".split(),
             "cyrillic": "ба бе би бо да де ди до ва ве га го ка ке ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те ти то".split(),
             "greek": "βα βε βι βο δα δε δι δο κα κε κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε τα τε τι το".split()}
ENDINGS = {"latin": {"f": "na", "m": "r", "n": "n"}, "cyrillic": {"f": "на", "m": "р", "n": "н"}, "greek": {"f": "να", "m": "ρος", "n": "ν"}}

_GENDER = {n.casefold(): (g, s) for (g, s), names in GIVEN.items() for n in names.split()}
_NAMES = "|".join(n for names in GIVEN.values() for w in names.split() for n in (w, w.upper()))
_TITLE = "|".join(TITLES)
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:-[^\W\d_]+)?"

#: What stands before a secret.
_SECRET = r"(?:token|secret|api[_-]?key|access[_-]?key|passw(?:or)?d|pwd)[\"']?\s*[:=]"

PATTERNS = (
    ("email", re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("secret", re.compile(rf"(?i){_SECRET}\s*[\"']?(?P<x>[^\s\"'<>,;]{{6,}})")),
    ("secret", re.compile(r"(?<![\w])(?P<x>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]+|[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32}|[0-9A-F]{64}|[0-9A-F]{40}|[0-9A-F]{32})(?![\w])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)")),
    ("card", re.compile(r"(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])\d{3,4}[\s.-]\d{3,4}(?!\w)|\+\d{8,15}(?!\w)")),
)
NAME = re.compile(rf"(?<!\w)(?:(?P<title>{_TITLE})\.?\s+(?:(?P<g1>{_NAMES})\s+)?(?P<f1>{_CAP})|(?P<g2>{_NAMES})\s+(?P<f2>{_CAP}))(?!\w)")

#: Part of each pattern, by type, that no match is without: what the gate looks for.
CORES = {
    "email": r"@",
    "digits": r"(?=\d)(?:\d{3}[\s.-]\d{3}|\d{3}-\d{2}-\d{4}|\d(?:[ -]?\d){12}|(?:\d{1,3}\.){3}\d)|\+\d{8}",  # phone, ssn, card, ip
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3}",
    "secret": rf"(?=[aApPsStT\x{{17F}}])(?iu:{_SECRET})|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9_-]{{20}}|eyJ|[0-9a-fA-F]{{32}}",
    "name": rf"(?=[\p{{Lu}}г])(?<![\p{{L}}\p{{N}}_])(?:(?:{_TITLE})\.?|{_NAMES})\s+[^a-zß-öø-ÿ]",
}


def _java(regex: str) -> str:
    r"""`regex` for Java, with Python's \s, and Python's \d (Java's may lack the digits that Unicode added last)."""
    space = "".join(f"\\x{{{n:x}}}" for n in range(0x3001) if chr(n).isspace())
    digit = r"\p{Nd}\x{16AC0}-\x{16AC9}\x{11F50}-\x{11F59}\x{1E4F0}-\x{1E4F9}"
    return regex.replace(r"\s", f"[{space}]").replace(r"\d", f"[{digit}]")


#: Java regex that every text with an entity meets.
GATE = "|".join(map(_java, CORES.values()))


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def _plain(text: str) -> str:
    """Digits of all scripts as 0 to 9."""
    return text if text.isascii() else re.sub(r"\d", lambda m: str(int(m[0])), text)


def _like_digit(new: str, old: str) -> str:
    """`new`, if it is a digit, in the script of the digit `old`."""
    return chr(ord(old) - int(old) + int(new)) if new.isdecimal() and old.isdecimal() else new


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value), sorted and free of overlaps; earlier patterns win."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))

    def add(a, b, kind, value):
        if b > a and not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            found.append((a, b, kind, value))

    for kind, regex in PATTERNS:
        for m in regex.finditer(text):
            a, b = m.span("x") if "x" in regex.groupindex else m.span()
            value = text[a:b]
            if kind == "email":
                value = value.lower()
            elif kind in ("card", "ssn", "phone"):
                value = _plain(re.sub(r"\D", "", value))
            elif kind in ("iban", "ip"):
                value = _plain(value.replace(" ", ""))
            add(a, b, kind, value)
    for m in NAME.finditer(text):
        given = m["g1"] or m["g2"]
        gender = _GENDER[given.casefold()][0] if given else TITLES[m["title"]]
        for group in ("g1", "g2"):
            if m[group]:
                add(*m.span(group), f"given:{gender}:{_script(m[group])}", m[group].casefold())
        for group in ("f1", "f2"):
            if m[group]:
                add(*m.span(group), f"family:n:{_script(m[group])}", m[group].casefold())
    # a person named once in a text is meant by the bare name as well
    for value, kind in {v: k for _, _, k, v in found if ":" in k}.items():
        for m in re.finditer(rf"(?i)(?<!\w){re.escape(value)}(?!\w)", text):
            if m[0][0].isupper():
                add(*m.span(), kind, value)
    return sorted(found)


class _Stream:
    """Numbers from an HMAC of a label."""

    def __init__(self, key: bytes, label: str):
        self.key, self.label, self.no, self.pool = key, label.encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hmac.new(self.key, self.label + self.no.to_bytes(4, "big"), hashlib.sha256).digest()
            self.no += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n

    def like(self, text: str) -> str:
        """Digits for digits (of the same script) and letters for letters, hex for hex."""
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and len(text) >= 16 and not text.isdecimal():
            digits = "0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"
            return "".join(digits[self.below(16)] for _ in text)
        kinds = (("0", "9", "0123456789"), ("a", "z", "abcdefghijklmnopqrstuvwxyz"), ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        out = []
        for c in text:
            letters = next((x for a, b, x in kinds if a <= c <= b), "abcdefghijklmnopqrstuvwxyz" if c.isalpha() else None)
            out.append(letters[self.below(len(letters))] if letters else _like_digit(str(self.below(10)), c) if c.isdecimal() else c)
        return "".join(out)


def luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Candidate in canonical form. From attempt 3 on, values grow and private addresses come from all of 10/8; from attempt 8 on, addresses come from 240/4."""
    s, more = _Stream(key, f"{kind}\0{value}\0{attempt}"), max(0, attempt - 2)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        return s.like(local) + s.like("x" * more) + "@" + s.like(".".join(domain.split(".")[:-1])) + ".example"
    if kind == "secret":
        return s.like(value) + s.like("0" * more)
    if kind == "ip":
        first = re.match(r"(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.", value)
        kept = "" if not first else first[0] if not more else "10."
        if attempt >= 8:
            return ".".join(str(n) for n in (240 + s.below(15), *(1 + s.below(254) for _ in range(3))))
        rest = [str(1 + s.below(254)) for _ in range(4 - kept.count("."))]
        if not kept:
            while rest[0] in ("10", "127", "172", "192"):
                rest[0] = str(1 + s.below(223))
        return kept + ".".join(rest)
    if kind == "card":
        body = value[0] + s.like(value[1:] + "0" * more)
        if luhn(value) == 0:
            body = next(b for b in (body[:-1] + str(d) for d in range(10)) if luhn(b) == 0)
        return body
    if kind == "iban":
        body = value[:2] + "00" + s.like(value[4:] + "0" * more)
        return value[:2] + (f"{98 - _iban_rest(body):02d}" if _iban_rest(value) == 1 else s.like(value[2:4])) + body[4:]
    if kind in ("phone", "ssn"):
        head = 1 if len(value) > 10 else 0
        return value[:head] + str(2 + s.below(8)) + s.like(value[head + 1 :] + "0" * more)
    part, gender, script = kind.split(":")
    pool = GIVEN.get((gender, script), "").split()
    if part == "given" and pool and attempt == 0:
        return pool[s.below(len(pool))].casefold()
    parts = SYLLABLES[script]
    made = "".join(parts[s.below(len(parts))] for _ in range(3 + more))
    return (made + ENDINGS[script][gender if part == "given" else "n"]).casefold()


def rendered(kind: str, new: str, mention: str) -> str:
    """The surrogate in the form of the mention."""
    digit = next((c for c in mention if c.isdecimal()), "0")
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(new)
        return "".join(_like_digit(next(chars, ""), c) if c.isalnum() else c for c in mention) + "".join(_like_digit(c, digit) for c in chars)
    if kind == "ip":
        return "".join(_like_digit(c, digit) for c in new)
    if kind == "email":
        return new.upper() if mention.isupper() else new
    if ":" in kind:
        return new.upper() if mention.isupper() else "-".join(p.capitalize() for p in new.split("-"))
    return new


ENTITIES = "array<struct<kind: string, value: string>>"


def _detect(texts: pd.Series) -> pd.Series:
    return pd.Series([[] if t is None else [{"kind": k, "value": v} for k, v in dict.fromkeys((k, v) for _, _, k, v in mentions(t))] for t in texts])


def _candidates(key: bytes, attempt: int):
    def make(kinds: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, v, attempt) for k, v in zip(kinds, values, strict=True)])
    return make


def _replace(texts: pd.Series, surrogates: pd.Series) -> pd.Series:
    out = []
    for text, rows in zip(texts, surrogates, strict=True):
        new = {} if rows is None else {(r["kind"], r["value"]): r["new"] for r in rows}
        parts, at = [], 0
        for a, b, kind, value in mentions(text) if new else ():
            parts += [text[at:a], rendered(kind, new[kind, value], text[a:b])]
            at = b
        out.append("".join([*parts, text[at:]]) if new else text)
    return pd.Series(out)


def assign(entities: DataFrame, key: bytes, *, attempts: int = 64) -> DataFrame:
    """(kind, value, new) for distinct entities: no `new` twice in a kind and none that is a value of the kind."""
    waiting, done, values = entities, None, entities.select("kind", F.col("value").alias("new"))
    for attempt in range(attempts):
        tried = kept_table(waiting.withColumn("new", F.pandas_udf(_candidates(key, attempt), "string")("kind", "value")), "candidates")
        first = tried.groupBy("kind", "new").agg(F.min("value").alias("value"))
        first = first.join(values, ["kind", "new"], "left_anti")
        if done is not None:
            first = first.join(done, ["kind", "new"], "left_anti")
        good = kept_table(first.select("kind", "value", "new"), "surrogates")
        done = good if done is None else done.unionByName(good)
        waiting = tried.select("kind", "value").join(good, ["kind", "value"], "left_anti")
        if waiting.isEmpty():
            return done
    raise RuntimeError(f"entities without a free surrogate after {attempts} attempts")


def gate(text: Column) -> Column:
    return F.coalesce(text.rlike(GATE), F.lit(False))


def with_surrogates(docs: DataFrame, *, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """`docs` with surrogates in `text` (and n_chars, where there is such a column, counted anew).

    `count` names a column for the number of distinct entities of the text.
    """
    # the costly test runs once: its outcome is kept beside the documents
    value = F.col("`" + text.replace("`", "``") + "`")
    rows = kept_table(docs.select(whole_row(docs).alias("_doc"), gate(value).alias("_hit")), "gated")
    hits, rest = (rows.filter(w).withColumn("_text", F.col("_doc")[text]).drop("_hit") for w in ("_hit", "not _hit"))
    found = hits.select(F.md5("_text").alias("_sum"), F.pandas_udf(_detect, ENTITIES)("_text").alias("_found"))
    found = kept_table(found.filter(F.size("_found") > 0).groupBy("_sum").agg(F.first("_found").alias("_found")), "entities")
    pairs = found.select("_sum", F.explode("_found").alias("_e")).select("_sum", "_e.kind", "_e.value")
    new = assign(kept_table(pairs.select("kind", "value").distinct(), "distinct-entities"), key)
    known = pairs.join(new, ["kind", "value"]).groupBy(F.col("_sum").alias("_key")).agg(F.collect_list(F.struct("kind", "value", "new")).alias("_new"))
    some = hits.withColumn("_sum", F.md5("_text"))
    some = some.join(known, F.col("_sum") == F.col("_key"), "left")
    some = some.select("_doc", F.pandas_udf(_replace, "string")("_text", "_new").alias("_text"), F.coalesce(F.size("_new"), F.lit(0)).alias("_n"))
    out = some.unionByName(rest.select("_doc", "_text", F.lit(0).alias("_n")))
    changed = {text: F.col("_text")} | ({"n_chars": F.when(F.col("_n") > 0, F.length("_text").cast("long")).otherwise(F.col("_doc.n_chars"))} if "n_chars" in docs.columns else {})
    extra = [F.greatest(F.col("_n"), F.lit(0)).cast("long").alias(count)] if count else []
    return out.select(*[changed.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns], *extra)
