"""License scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

A text passes three gates. Spark tests the lower-cased text for a few substrings, one of which every rule needs;
only texts that have one go to Python. There a rule's regex runs only if one of the rule's own keywords is in the text.
Keywords are single words, as white space between words may be a line break.
The detections of all rules are then resolved: one that lies inside a detection of a stronger rule (lower
priority number), or inside a longer one of its own priority, is dropped.

No row depends on another, so the scan is one narrow stage without a shuffle, whatever the skew.
Null text counts as empty and gives zero words, no detections, score 0. Repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One character that separates words in the lower-cased text, and one that doesn't.
GAP = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
TOKEN = r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]"

#: Base phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Rule(NamedTuple):
    label: str
    priority: int  # smaller is stronger
    weight: float  # confidence of one detection
    keywords: tuple[str, ...]  # one of them must be in the text, or the regex isn't tried
    regex: str
    gate: tuple[str, ...] = ()  # the same for whether the text goes to Python; as the keywords, if empty


class Family(NamedTuple):
    label: str
    keywords: tuple[str, ...]  # each alternative of the name has one
    name: str  # regex of the name as it stands in prose
    tag: str  # regex of the short identifier in a tag
    url: str = ""  # regex of an address of the licence text
    gate: tuple[str, ...] = ("licen",)  # each alternative of the name has one


_V = r"(?:,?\s*(?:version|v\.?|ver\.?))?\s*"
#: Hand-written signatures. Each family gives one rule per form in FORMS.
FAMILIES = (
    Family("mit", ("mit", "expat", "x11"), r"(?:the\s+)?(?:mit|expat|x11)(?:/(?:x11|expat))?\s+licen[sc]e", r"mit", r"opensource\.org/licenses?/mit"),
    Family("mit-0", ("mit",), r"mit\s+no\s+attribution(?:\s+licen[sc]e)?", r"mit-0", r"opensource\.org/licenses?/mit-0", gate=("attribution",)),
    Family("apache-1.0", ("apache",), rf"apache\s+(?:software\s+)?licen[sc]e{_V}1\.0", r"apache-1\.0", r"apache\.org/licenses/license-1\.0"),
    Family("apache-1.1", ("apache",), rf"apache\s+(?:software\s+)?licen[sc]e{_V}1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    Family("apache-2", ("apache",), rf"apache\s+(?:software\s+)?licen[sc]e{_V}2(?:\.0)?", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    Family("gpl-1", ("general",), rf"gnu\s+general\s+public\s+licen[sc]e{_V}1(?:\.0)?", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/old-licenses/gpl-1\.0"),
    Family("gpl-2", ("general",), rf"gnu\s+general\s+public\s+licen[sc]e{_V}2(?:\.0)?", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"),
    Family("gpl-3", ("general",), rf"gnu\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    Family("lgpl-2", ("general",), rf"(?:gnu\s+)?library\s+general\s+public\s+licen[sc]e{_V}2(?:\.0)?", r"lgpl-2\.0(?:-only|-or-later|\+)?"),
    Family("lgpl-2.1", ("general",), rf"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e{_V}2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    Family("lgpl-3", ("general",), rf"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e{_V}3(?:\.0)?", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3\.0"),
    Family("agpl-3", ("affero",), rf"(?:gnu\s+)?affero\s+general\s+public\s+licen[sc]e(?:{_V}3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl-3\.0"),
    Family("gfdl", ("documentation",), rf"(?:gnu\s+)?free\s+documentation\s+licen[sc]e(?:{_V}1\.[123])?", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    Family("bsd-2", ("bsd", "simplified"), r"(?:2|two)[\s-]clause\s+bsd(?:\s+licen[sc]e)?|(?:simplified|freebsd)\s+(?:bsd\s+)?licen[sc]e", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause", gate=("bsd", "licen")),
    Family("bsd-3", ("bsd",), r"(?:3|three)[\s-]clause\s+bsd(?:\s+licen[sc]e)?|(?:new|revised|modified)\s+bsd\s+licen[sc]e", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause", gate=("bsd",)),
    Family("bsd-4", ("bsd",), r"(?:4|four)[\s-]clause\s+bsd(?:\s+licen[sc]e)?|original\s+bsd\s+licen[sc]e", r"bsd-4-clause", gate=("bsd",)),
    Family("0bsd", ("bsd",), r"(?:zero[\s-]clause|0[\s-]clause)\s+bsd(?:\s+licen[sc]e)?|bsd\s+zero\s+clause\s+licen[sc]e", r"0bsd", r"opensource\.org/licenses?/0bsd", gate=("bsd",)),
    Family("isc", ("isc",), r"isc\s+licen[sc]e", r"isc", r"opensource\.org/licenses?/isc"),
    Family("mpl-1.1", ("mozilla",), rf"mozilla\s+public\s+licen[sc]e{_V}1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    Family("mpl-2", ("mozilla",), rf"mozilla\s+public\s+licen[sc]e{_V}2(?:\.0)?", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    Family("epl-1", ("eclipse",), rf"eclipse\s+public\s+licen[sc]e{_V}1(?:\.0)?", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    Family("epl-2", ("eclipse",), rf"eclipse\s+public\s+licen[sc]e{_V}2(?:\.0)?", r"epl-2\.0", r"eclipse\.org/legal/epl-2\.0"),
    Family("edl", ("eclipse",), rf"eclipse\s+distribution\s+licen[sc]e(?:{_V}1\.0)?", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    Family("cddl", ("development",), rf"common\s+development\s+and\s+distribution\s+licen[sc]e(?:{_V}1\.[01])?", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    Family("cpl", ("common",), rf"common\s+public\s+licen[sc]e(?:{_V}1\.0)?", r"cpl-1\.0", r"opensource\.org/licenses?/cpl1"),
    Family("eupl", ("european",), rf"european\s+union\s+public\s+licen[sc]e(?:{_V}1\.[012])?", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/\S*eupl"),
    Family("osl", ("software",), rf"open\s+software\s+licen[sc]e(?:{_V}[123]\.[01])?", r"osl-[123]\.[01]", r"opensource\.org/licenses?/osl"),
    Family("afl", ("academic",), rf"academic\s+free\s+licen[sc]e(?:{_V}[123]\.[012])?", r"afl-[123]\.[012]", r"opensource\.org/licenses?/afl"),
    Family("artistic-1", ("artistic",), rf"artistic\s+licen[sc]e{_V}1\.0", r"artistic-1\.0(?:-perl|-cl8)?", r"opensource\.org/licenses?/artistic-1"),
    Family("artistic-2", ("artistic",), rf"artistic\s+licen[sc]e{_V}2(?:\.0)?", r"artistic-2\.0", r"opensource\.org/licenses?/artistic-2"),
    Family("bsl-1", ("boost",), rf"boost\s+software\s+licen[sc]e(?:{_V}1\.0)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    Family("zlib", ("zlib",), r"zlib(?:/libpng)?\s+licen[sc]e", r"zlib", r"zlib\.net/zlib_license"),
    Family("libpng", ("libpng",), r"libpng\s+licen[sc]e(?:\s+version\s+2)?", r"libpng(?:-2\.0)?"),
    Family("unlicense", ("unlicense",), r"the\s+unlicense", r"unlicense", r"unlicense\.org"),
    Family("wtfpl", ("want",), r"do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+licen[sc]e", r"wtfpl", r"wtfpl\.net"),
    Family("cc0", ("cc0",), r"cc0(?:\s+1\.0)?(?:\s+universal)?(?:\s+public\s+domain\s+dedication)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero", gate=("cc0",)),
    Family("cc-by", ("commons",), rf"creative\s+commons\s+attribution(?:{_V}[1234]\.[05])?(?:\s+international)?\s+(?:public\s+)?licen[sc]e", r"cc-by-[1234]\.[05]", r"creativecommons\.org/licenses/by/"),
    Family("cc-by-sa", ("commons",), rf"creative\s+commons\s+attribution[\s-]+share\s*-?alike(?:{_V}[1234]\.[05])?", r"cc-by-sa-[1234]\.[05]", r"creativecommons\.org/licenses/by-sa/", gate=("commons",)),
    Family("cc-by-nd", ("commons",), rf"creative\s+commons\s+attribution[\s-]+no\s*-?deriv\w*(?:{_V}[1234]\.[05])?", r"cc-by-nd-[1234]\.[05]", r"creativecommons\.org/licenses/by-nd/", gate=("commons",)),
    Family("cc-by-nc", ("commons",), rf"creative\s+commons\s+attribution[\s-]+non\s*-?commercial(?:{_V}[1234]\.[05])?", r"cc-by-nc-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc/", gate=("commons",)),
    Family("cc-by-nc-sa", ("commons",), rf"creative\s+commons\s+attribution[\s-]+non\s*-?commercial[\s-]+share\s*-?alike(?:{_V}[1234]\.[05])?", r"cc-by-nc-sa-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc-sa/", gate=("commons",)),
    Family("cc-by-nc-nd", ("commons",), rf"creative\s+commons\s+attribution[\s-]+non\s*-?commercial[\s-]+no\s*-?deriv\w*(?:{_V}[1234]\.[05])?", r"cc-by-nc-nd-[1234]\.[05]", r"creativecommons\.org/licenses/by-nc-nd/", gate=("commons",)),
    Family("odbl", ("database",), rf"open\s+(?:data\s*commons\s+)?open\s+database\s+licen[sc]e(?:{_V}1\.0)?|open\s+database\s+licen[sc]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    Family("odc-by", ("commons",), r"open\s+data\s+commons\s+attribution\s+licen[sc]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    Family("pddl", ("dedication",), r"public\s+domain\s+dedication\s+and\s+licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    Family("ofl", ("font",), rf"(?:sil\s+)?open\s+font\s+licen[sc]e(?:{_V}1\.[01])?", r"ofl-1\.[01](?:-rfn|-no-rfn)?", r"scripts\.sil\.org/ofl"),
    Family("psf", ("python",), r"python\s+software\s+foundation\s+licen[sc]e(?:\s+version\s+2)?", r"(?:psf|python)-2\.0", r"docs\.python\.org/\S*license"),
    Family("php", ("php",), rf"php\s+licen[sc]e(?:{_V}3\.0[01]?)?", r"php-3\.0[01]?", r"php\.net/license"),
    Family("ruby", ("ruby",), r"ruby\s+licen[sc]e", r"ruby"),
    Family("postgresql", ("postgresql",), r"postgresql\s+licen[sc]e", r"postgresql", r"postgresql\.org/about/licence"),
    Family("openssl", ("openssl",), r"openssl\s+licen[sc]e", r"openssl", r"openssl\.org/source/license"),
    Family("curl", ("curl",), r"curl\s+licen[sc]e", r"curl", r"curl\.(?:se|haxx\.se)/docs/copyright"),
    Family("vim", ("vim",), r"vim\s+licen[sc]e", r"vim"),
    Family("ms-pl", ("microsoft",), r"microsoft\s+public\s+licen[sc]e", r"ms-pl", r"opensource\.org/licenses?/ms-pl"),
    Family("ms-rl", ("microsoft",), r"microsoft\s+reciprocal\s+licen[sc]e", r"ms-rl", r"opensource\.org/licenses?/ms-rl"),
    Family("upl", ("universal",), rf"universal\s+permissive\s+licen[sc]e(?:{_V}1\.0)?", r"upl-1\.0", r"opensource\.org/licenses?/upl"),
    Family("ncsa", ("ncsa",), r"(?:university\s+of\s+illinois/)?ncsa\s+(?:open\s+source\s+)?licen[sc]e", r"ncsa", r"opensource\.org/licenses?/ncsa"),
    Family("ecl-2", ("educational",), rf"educational\s+community\s+licen[sc]e(?:{_V}2\.0)?", r"ecl-2\.0", r"opensource\.org/licenses?/ecl-2"),
    Family("sspl", ("server",), rf"server\s+side\s+public\s+licen[sc]e(?:{_V}1)?", r"sspl-1\.0", r"mongodb\.com/licensing/server-side"),
    Family("busl", ("business",), rf"business\s+source\s+licen[sc]e(?:{_V}1\.1)?", r"busl-1\.1", r"mariadb\.com/bsl"),
    Family("elastic-2", ("elastic",), rf"elastic\s+licen[sc]e(?:{_V}2(?:\.0)?)?", r"elastic-2\.0", r"elastic\.co/licensing/elastic-license"),
    Family("openrail", ("rail",), r"(?:creativeml\s+|bigscience\s+)?(?:open)?rail(?:\+\+)?(?:-m)?\s+licen[sc]e", r"(?:creativeml-)?openrail(?:-m|\+\+)?"),
)

#: Forms in which a family's name, tag or address stands: (priority, weight, keywords or (), regex with {x}).
FORMS = {
    "grant": (1, 0.95, (), r"(?:licen[sc]ed|released|distributed|published|provided|(?:made\s+)?available|redistributed|covered|governed)\s+(?:under|by)\s+(?:the\s+(?:terms|conditions)(?:\s+and\s+conditions)?\s+of\s+)?(?:the\s+)?(?:{x})"),
    "permission": (1, 0.9, (), r"(?:subject\s+to|according\s+to|use\s+of\s+this\s+\w+\s+is\s+governed\s+by|in\s+compliance\s+with)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:{x})"),
    "later": (1, 0.9, ("later",), r"(?:{x})\s*,?\s*(?:or|and)\s+(?:\(at\s+your\s+option\)\s+)?any\s+later\s+version"),
    "name": (3, 0.6, (), r"(?<![a-z0-9])(?:{x})(?![a-z0-9])"),
}
TAG_FORMS = {
    "spdx": (0, 0.99, ("spdx",), r"spdx-license-identifier:\s*[(\s]*(?:{x})(?![\w.-])"),
    "field": (2, 0.8, ("licen",), r"(?:^|[\s{{,\"'])licen[sc]e[\"']?\s*[:=]\s*[\"']?(?:{x})(?![\w.-])"),
}
URL_FORM = (0, 0.9, ("://",), r"https?://(?:www\.)?(?:{x})[\w./#-]*")
#: Signatures that belong to no family.
SINGLE = (
    Rule("public-domain", 4, 0.5, ("domain",), r"(?:dedicated|released|placed|committed)\s+(?:in)?to\s+the\s+public\s+domain"),
    Rule("public-domain", 5, 0.3, ("domain",), r"(?:is|are)\s+in\s+the\s+public\s+domain"),
    Rule("proprietary", 4, 0.6, ("reserved",), r"(?:copyright|\(c\)|©)[^\n]{0,120}?all\s+rights\s+reserved"),
    Rule("proprietary", 5, 0.3, ("reserved",), r"all\s+rights\s+reserved"),
    Rule("proprietary", 4, 0.5, ("confidential",), r"proprietary\s+and\s+confidential|confidential\s+and\s+proprietary"),
    Rule("copyright", 6, 0.2, ("copyright",), r"copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d(?:\s*[-–,]\s*(?:19|20)\d\d)*"),
    Rule("mit", 2, 0.9, ("permission",), r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person\s+obtaining\s+a\s+copy"),
    Rule("isc", 2, 0.85, ("permission",), r"permission\s+to\s+use,\s+copy,\s+modify,\s+and/or\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee"),
    Rule("bsd-3", 2, 0.7, ("redistribution",), r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms,\s+with\s+or\s+without\s+modification,\s+are\s+permitted"),
    Rule("zlib", 2, 0.8, ("as-is",), r"this\s+software\s+is\s+provided\s+'?as-is'?,\s+without\s+any\s+express\s+or\s+implied\s+warranty"),
    Rule("unlicense", 2, 0.85, ("unencumbered",), r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    Rule("gpl", 4, 0.5, ("general", "gpl"), r"(?:gnu\s+)?general\s+public\s+licen[sc]e|(?<![a-z])gpl(?![a-z])", gate=("licen", "gpl")),
    Rule("lgpl", 4, 0.5, ("lesser",), r"(?:gnu\s+)?lesser\s+general\s+public\s+licen[sc]e", gate=("licen",)),
    Rule("bsd", 4, 0.5, ("bsd",), r"(?<![a-z])bsd\s+licen[sc]e", gate=("licen",)),
    Rule("apache", 4, 0.5, ("apache",), r"(?<![a-z])apache\s+(?:software\s+)?licen[sc]e", gate=("licen",)),
    Rule("cc", 5, 0.4, ("commons",), r"creative\s+commons\s+licen[sc]e", gate=("licen",)),
)


def rules() -> list[Rule]:
    """All rules in order: each family in each form, then the single ones."""
    out = []
    for f in FAMILIES:
        for priority, weight, keywords, regex in FORMS.values():
            out.append(Rule(f.label, priority, weight, keywords or f.keywords, regex.format(x=f.name), f.gate))
        for priority, weight, keywords, regex in TAG_FORMS.values():
            out.append(Rule(f.label, priority, weight, keywords, regex.format(x=f.tag)))
        if f.url:
            priority, weight, keywords, regex = URL_FORM
            out.append(Rule(f.label, priority, weight, keywords, regex.format(x=f.url)))
    return out + list(SINGLE)


#: Every rule needs one of these substrings, so a text without any of them never leaves the JVM. The last base
#: phrase has no long word and is tested by a regex of its own.
GATES = tuple(sorted({word for r in rules() for word in r.gate or r.keywords}))


@lru_cache(maxsize=1)
def _compiled():
    found = [(r, re.compile(r.regex)) for r in rules()]
    base = [(re.compile(rf"(?<!{TOKEN})" + f"{GAP}+".join(p.split()) + rf"(?!{TOKEN})"), label) for p, label in BASE.items()]
    return found, base, sorted({k for r, _ in found for k in (*r.keywords, *r.gate)})


def lowered(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def detections(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, priority, rule number) of all matches of all rules in a lower-cased text."""
    found, _, keywords = _compiled()
    here = {k for k in keywords if k in text}
    return [(m.start(), m.end(), r.priority, no) for no, (r, regex) in enumerate(found)
            if not here.isdisjoint(r.keywords) and not here.isdisjoint(r.gate or r.keywords) for m in regex.finditer(text)]


def resolved(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans without those inside a stronger span, or inside a longer (or equal, earlier ruled) one as strong.

    Whatever a dropped span would suppress lies inside its suppressor too, so one look at all stronger spans is
    enough. They are kept by start with the largest end so far: a span is inside one of them if the largest end
    among those that start no later reaches its own end.
    """
    out: list[tuple[int, int, int, int]] = []
    strong: list[tuple[int, int]] = []
    for level in sorted({s[2] for s in spans}):
        starts, ends = [s for s, _ in strong], list(accumulate((e for _, e in strong), max))
        same = sorted((s for s in spans if s[2] == level), key=lambda s: (s[0], -s[1], s[3]))
        reach = -1
        for s in same:
            k = bisect_right(starts, s[0])
            if s[1] > reach and not (k and ends[k - 1] >= s[1]):
                out.append(s)
            reach = max(reach, s[1])
        strong = sorted(strong + [(s[0], s[1]) for s in same])
    return sorted(out)


def scan_text(text: str) -> tuple:
    """n_base, first_word, last_word, base_labels, labels, score and the kept detections of one text."""
    text = lowered(text)
    found, base, _ = _compiled()
    hits = [(m.start(), label) for regex, label in base for m in regex.finditer(text)]
    first = last = None
    if hits:
        words = [m.start() for m in re.finditer(f"{TOKEN}+", text)]
        first, last = bisect_left(words, min(hits)[0]), bisect_left(words, max(hits)[0])
    kept = resolved(detections(text))
    best: dict[str, float] = {label: 0.9 for _, label in hits}
    miss = 1.0
    for s in kept:
        r = found[s[3]][0]
        best[r.label] = max(best.get(r.label, 0.0), r.weight)
    for weight in best.values():
        miss *= 1.0 - weight
    spans = [{"label": found[s[3]][0].label, "start": s[0], "end": s[1], "weight": found[s[3]][0].weight} for s in kept]
    return len(hits), first, last, ",".join(sorted({label for _, label in hits})), ",".join(sorted(best)), round(1.0 - miss, 6), spans


SCAN = "n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, end: int, weight: double>>"
_NAMES = ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def _scan(texts: pd.Series) -> pd.DataFrame:
    empty = (0, None, None, "", "", 0.0, [])
    out = pd.DataFrame([empty if t is None else scan_text(t) for t in texts], columns=_NAMES)
    return out.astype({"first_word": "Int64", "last_word": "Int64"})


def gate(text: Column) -> Column:
    """Whether a rule or a base phrase can match at all."""
    low = F.lower(text)
    some = low.rlike(f"cc{GAP}+by{GAP}+nc")
    for g in GATES:
        some = low.contains(g) | some
    return some


def scan_licenses(docs: DataFrame, *, keep=("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep`, the number of words, the base phrase places, and the labels and spans of the rules.

    `spans` are character ranges in the text; `score` is 1 minus the product of the labels' misses.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_count(t, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")
    rows = docs.select(*keep, words.alias("n_words"), F.pandas_udf(_scan, SCAN)(F.when(gate(t), t)).alias("_scan"))
    return rows.select(*keep, "n_words", *[F.col(f"_scan.{n}").alias(n) for n in _NAMES])
