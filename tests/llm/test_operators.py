"""The corpus operators against brute force on small tables with nulls, empty and repeated rows, and odd columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from matchlytics.llm import jaccard_join, licenses, mixing, pii, quality, sentence_pieces, suffix_dedup, token_rollups, topk, warc
from matchlytics.llm.common import new_folder
from matchlytics.llm.queries import MODEL, RANKS

DOCS = "doc_id long, text string, lang string, source string, n_chars long, labels string, k1 string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 9))) for _ in range(n))


TEXTS = [words(120, 1), words(120, 1), words(120, 1) + " tail", words(60, 2) + "\n" + words(80, 3), words(80, 3) + "\n" + words(30, 4),
         "", None, "one two", "one two", "  \n\t ", "Released under the MIT License.\nApache License, Version 2.0 x cc-by-nc", "a b c " * 80,
         "Mail Jane.Doe@mail5.example.com or +1 (743) 555-3824; Mr. John Miller met Anna Miller, card 4111 1111 1111 1111.",
         "write to jane.doe@mail5.example.com, 10.1.2.3, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"", words(3000, 9) + words(120, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i == 2 else f"s{i % 3}", None, "x", "y") for i, t in enumerate(TEXTS)]
    rows += [(None, TEXTS[0], "en", "s1", 1, None, None), (3, TEXTS[3], None, "s0", None, "x", "y")]  # null id, repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_licenses(docs, none):
    assert len(licenses.rules()) > 300
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    token = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    for i, t in enumerate(TEXTS):
        found = re.findall(token, (t or "").encode().lower().decode())
        hits = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(found)) if found[p : p + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(found), len(hits))
        assert r.first_word == min((p for p, _ in hits), default=None) and r.last_word == max((p for p, _ in hits), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert licenses.scan_licenses(none).collect() == []


def test_license_spans_resolve():
    kept = licenses.scan_text("licensed under the GNU Lesser General Public License, version 2.1 or GPL")
    assert "lgpl-2.1" in kept[4].split(",") and "gpl-2" not in kept[4].split(",")
    assert licenses.resolved([(0, 10, 1, 0), (2, 5, 2, 1), (2, 12, 2, 2), (0, 10, 1, 3)]) == [(0, 10, 1, 0), (2, 12, 2, 2)]


def branches(parsed):
    """Strings of a parsed regex: each alternative and each option at least once, white space as line breaks."""
    if not len(parsed):
        return [""]
    from re import _constants as c
    op, at = parsed[0]
    if op is c.SUBPATTERN:
        here = branches(at[-1])
    elif op is c.BRANCH:
        here = [x for b in at[1] for x in branches(b)]
    elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
        here = [x * at[0] for x in branches(at[2])] if at[0] else ["", *branches(at[2])]
    elif op is c.IN:
        kind, x = at[0]
        here = [{c.CATEGORY_SPACE: "\n", c.CATEGORY_DIGIT: "1"}.get(x, "x")] if kind is c.CATEGORY else [chr(x[0] if kind is c.RANGE else x)] if kind is not c.NEGATE else ["x"]
    else:
        here = [chr(at)] if op is c.LITERAL else [""] if op in (c.AT, c.ASSERT, c.ASSERT_NOT) else ["x"]
    rest = branches(parsed[1:])
    return list(dict.fromkeys([x + rest[0] for x in here] + [here[0] + y for y in rest]))


def test_license_alternatives_alone(spark):
    """Each alternative of each rule, with nothing else in the text and line breaks between the words."""
    from re import _parser
    texts = []
    for no, r in enumerate(licenses.rules()):
        assert not any(" " in k for k in (*r.keywords, *r.gate))
        for t in branches(_parser.parse(r.regex)):
            if re.search(r.regex, t):
                texts.append(t)
                assert no in {d[3] for d in licenses.detections(t)}, (r, t)
        assert no in {d[3] for d in licenses.detections(texts[-1])}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r.text for r in rows.filter(~licenses.gate(rows.text)).collect()] == []
    for text, label in (("Licensed under the GPL", "gpl"), ("the Expat License", "mit"), ("Simplified License", "bsd-2"), ("MIT No Attribution", "mit-0"),
                        ("GNU General\nPublic License", "gpl"), ("placed into the public\ndomain", "public-domain"), ("the open\nsoftware license", "osl")):
        assert label in licenses.scan_text(text)[4].split(",")


def measured(t):
    found = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    triples = collections.Counter(zip(found, found[1:], found[2:]))
    covered = {j for i in range(len(found) - 2) if triples[found[i], found[i + 1], found[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_verdicts(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = measured(TEXTS[r.doc_id or 0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)  # too few labels
    assert quality.kept_documents(docs, labels).columns == docs.columns
    assert quality.kept_documents(none, labels).collect() == []


def test_risk_control(spark):
    from math import comb

    from pyspark.sql import functions as F
    for k, n in ((0, 300), (2, 900), (5, 1000), (30, 1000)):
        got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), 0.01)).first()[0]
        want = 1.0 if k >= 0.01 * n else sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-9)
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(i, clean if i % 10 else clean + " ###" * 120, "en") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(d, labels).collect()}
    assert all(kept[i] == bool(i % 10) for i in kept)


def test_surrogates(docs, none):
    new = {r.doc_id: r for r in pii.with_surrogates(docs, key=b"k", count="n").collect() if r.doc_id is not None}
    assert all(new[i].text == t for i, t in enumerate(TEXTS) if i not in (12, 13))
    a, b = new[12].text, new[13].text
    assert "jane" not in (a + b).lower() and "555-3824" not in a and "24be6443" not in b and "10.1.2.3" not in b
    mail = re.search(r"\S+@\S+", a)[0]
    assert mail in b and mail.endswith(".example")  # one entity in two spellings
    family = re.search(r"Mr\. (\w+) (\w+) met (\w+) (\w+),", a)
    assert family[2] == family[4] and "Miller" not in a and family[1] in pii.GIVEN["m", "latin"] and family[3] in pii.GIVEN["f", "latin"]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and pii.luhn(re.sub(r"\D", "", re.search(r"card ([\d ]+)", a)[1])) == 0
    assert pii.with_surrogates(none, key=b"k").collect() == []


def test_gate_passes_what_the_patterns_find(spark):
    """The smallest example of each pattern, separator and digit passes the gate alone, and none comes back as it was."""
    spaces = [chr(n) for n in range(0x3001) if re.fullmatch(r"\s", chr(n))]
    digits = [chr(n) for n in range(0x110000) if re.fullmatch(r"\d", chr(n)) and int(chr(n)) == 3]
    assert len(spaces) > 20 and len(digits) > 60
    texts = [f"{k}{q}{s}{c}hunter2xyz" for k in ("token", "SECRET", "apikey", "api_key", "api-key", "accesskey", "access_key", "password", "passwd", "Password", "pa\u017fsword", "api\u212aey", "pwd") for q in ("", '"', "'") for s in ("", " ", "\n") for c in ":="]
    texts += [f"pwd{s}:abcdef" for s in spaces] + ["pwd:\u0663\u0661\u0662\u0663\u0661\u0662"]
    texts += [f"030{s}123{s}567" for s in [*spaces, ".", "-"]] + [f"+1{s}(30){s}123{s}5678" for s in spaces] + ["(30)123 567", "12 345 678", "+12345678"]
    texts += [f"{d * 3}\u00a0{d * 3}\u00a0{d * 3}" for d in digits] + [f"+{d * 8}" for d in digits]
    texts += [f"{d * 3}-{d * 2}-{d * 4}" for d in digits] + [d * 13 for d in digits] + [".".join("\u0661\u0662\u0663\u0664")]
    texts += ["a@b.cc", "4" * 13, "4-4 4-4 4-4 4-4 4-4 4-4 4", "1.2.3.4", "111-22-3333", "DE89370400440532", "DE89 3704 0044 0532", "DE\u0668\u0669370400440532"]
    texts += ["AKIA" + "A0" * 8, "ghp_" + "a" * 36, "sk-" + "a" * 20, "eyJ" + "a" * 10 + "." + "b" * 10 + ".c", "0a" * 16, "0A" * 16, "0a" * 20, "0A" * 20, "0a" * 32, "0A" * 32]
    texts += [f"{x}{s}Zz" for x in [*pii.TITLES, "Dr.", *" ".join(pii.GIVEN.values()).split()] for s in (" ", "\n", "\u00a0", "\x1c")] + ["\u200dJohn Zz", "\u0301Mr Zz", "Anna  Éz"]
    assert [t for t in texts if not pii.mentions(t)] == []
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in rows.filter(~pii.gate(rows.text)).collect()] == []
    assert [t for t, r in zip(texts, pii.with_surrogates(rows, key=b"k").orderBy("doc_id").collect()) if r.text == t] == []
    assert [v for *_, v in pii.mentions("\u0660\u0663\u0660 1234 5678, 030 1234 5678")] == ["03012345678"] * 2  # one entity in two scripts
    assert pii.rendered("phone", "99887766", "\u0660\u0663 \u0661\u0662\u0663 \u0661\u0662\u0663") == "\u0669\u0669 \u0668\u0668\u0667 \u0667\u0666\u0666"


def test_surrogates_stay_distinct(spark):
    values = [("ip", f"10.0.0.{i}") for i in range(1, 200)] + [("email", f"{i}@a.example") for i in range(100)]
    rows = pii.assign(spark.createDataFrame(values, "kind string, value string"), b"k").collect()
    assert len(rows) == len(values) == len({(r.kind, r.new) for r in rows})
    assert not {(r.kind, r.new) for r in rows} & set(values)


def test_full_formats_do_not_stop_the_assignment(spark):
    full = spark.range(254 * 254).selectExpr("'ip' as kind", "concat('192.168.', 1 + id div 254, '.', 1 + id % 254) as value")
    new = pii.assign(full, b"k")
    assert new.count() == new.select("new").distinct().count() == 254 * 254
    assert new.join(full.select(full.value.alias("new")), "new").count() == 0 and new.filter("new not like '10.%'").count() == 0
    for kind, value in (("card", "4111111111111111"), ("card", "41111111111111113"), ("phone", "03012345678"), ("phone", "12345678"), ("ssn", "111223333"), ("iban", "DE89370400440532013000")):
        made = [pii.surrogate(b"k", kind, value, i) for i in range(6)]
        assert [len(x) - len(value) for x in made] == [0, 0, 0, 1, 2, 3]
        assert kind == "iban" or "".join(made).isdecimal()
        assert kind != "card" or pii.luhn(value) or not any(map(pii.luhn, made))
        assert kind != "iban" or {pii._iban_rest(x) for x in made} == {1}
    assert all(pii.surrogate(b"k", "ip", x, 8).startswith("24") or pii.surrogate(b"k", "ip", x, 8).startswith("25") for x in ("10.1.2.3", "8.8.8.8"))


def test_warc(spark):
    rows = [(1, "http://a/ö\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (5, "u", "z" * 100_000), (5, "u", "z" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    want = []
    for page, _, html in rows:
        first = min(p for p, _, h in rows if p is not None and (h or "") == (html or ""))
        same = page == first
        want.append((page, len((html or "").encode()), warc.digest_of((html or "").encode()), "response" if same else "revisit", None if same else first))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).collect() == []
    assert list(warc.runs([0, 10, 100, 110], [10, 10, 10, 10], gap=5, most=1000)) == [(0, 2), (2, 4)]


def test_mixing(docs, none):
    mix = mixing.Mix(docs, block=4)
    rows = mix.taken().collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.Mix(docs, block=4).taken().collect()), key=str)
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    share = mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    assert sum(share) == pytest.approx(sum(sizes.values())) and all(t <= 3 * sizes[s] + 1e-6 for t, s in zip(share, order))
    took = collections.Counter()
    for r in rows:
        assert r.taken <= 3 * r.size
        took[r.target] += r.taken
    assert all(abs(took[t] - t) <= 16 for t in share)
    text = mix.texts().collect()
    assert sum(len(r.text.split()) for r in text) == sum(r.taken for r in rows)
    assert mixing.Mix(none).taken().collect() == [] and mixing.Mix(none).texts().collect() == []


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345, dtype=np.uint64))
        assert sorted(out) == list(range(n))


def test_rollups(spark, docs):
    store = new_folder(spark, "store")
    rows = [("1", "insert", "a", None, "t", 5, None), ("2", "insert", "a", None, "t", 7, None), ("2", "insert", "a", None, "t", 7, None)]
    kind = "change_id string, op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    assert token_rollups.commit(store, "1", spark.createDataFrame(rows, kind), distinct=True)
    assert not token_rollups.commit(store, "1", spark.createDataFrame(rows, kind), distinct=True)
    token_rollups.commit(store, "2", spark.createDataFrame([("3", "delete", "a", None, "t", 5, None), ("4", "revise", "a", None, "t", 9, 7)], kind))
    token_rollups.commit(store, "3", spark.createDataFrame([], kind))
    assert [tuple(r) for r in token_rollups.totals(spark, store).collect()] == [("a", None, "t", 1, 9, 4)]
    tokens = token_rollups._tokenizer(open(RANKS, "rb").read())
    for r in token_rollups.with_tokens(docs, RANKS).collect():
        assert r.tokens == len(tokens.encode_ordinary(r.text or ""))


def test_topk(spark):
    rng = np.random.default_rng(3)
    vectors = [rng.normal(0, 0.2, 16).astype(np.float32).tolist() for _ in range(300)] + [[0.5] * 16] * 5
    rows = list(enumerate(vectors)) + [(20, vectors[7]), (None, vectors[3]), (900, None), (901, [float("nan")] * 16), (902, [])]
    got = topk.search(topk.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), block=64)).collect()
    good = [(i, np.floor(64 * np.asarray(v, dtype=np.float64)).astype(int)) for i, v in rows if v is not None and np.isfinite(v).all()]
    dense = np.array([np.pad(v, (0, 16 - len(v))) for _, v in good])
    want = []
    for q, (i, _) in enumerate(good):
        if i is not None and i % 20 == 0:
            scored = sorted((-int(s), float("inf") if c is None else c) for k, (c, s) in enumerate(zip((x for x, _ in good), dense @ dense[q])) if k != q)
            want += [(i, r + 1, None if c == float("inf") else c, -s) for r, (s, c) in enumerate(scored[:20])]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_pieces(docs):
    pieces = sentence_pieces.Pieces(sentence_pieces.model_pieces(open(MODEL, "rb").read()))
    samples = [t or "" for t in TEXTS] + ["  two  spaces ", "梦 😀 ἡ", "x" * 300]
    for t, ids in zip(samples, pieces.encode_all(samples)):
        assert pieces.decode(ids) == t
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    table = sentence_pieces.model_pieces(open(MODEL, "rb").read())
    for p, (_, score, _) in zip(model.pieces, table):
        p.score = p.score if score is None else score
    library = SentencePieceProcessor()
    library.LoadFromSerializedProto(model.SerializeToString())
    total = lambda ids: sum(table[i][1] or 0.0 for i in ids)  # noqa: E731  ties may be cut differently
    for t in samples:
        assert total(pieces.encode_all([t])[0]) == pytest.approx(total(library.encode(t)), abs=1e-2)
    rows = sentence_pieces.decode(sentence_pieces.encode(docs, MODEL), MODEL).collect()
    assert all(r.decoded == (r.text or "") for r in rows)


def test_pieces_stage_decodes(spark, docs, monkeypatch):
    """The last stage says whether the ids give the text back, also where they don't."""
    import corpus_pipeline
    rows = corpus_pipeline.pieces(spark, docs, "").collect()
    assert rows and "text" not in rows[0] and all(r.round_trip for r in rows)
    pieces = sentence_pieces.Pieces(sentence_pieces.model_pieces(open(MODEL, "rb").read()))
    monkeypatch.setattr(sentence_pieces, "_pieces", lambda data: pieces)
    monkeypatch.setattr(pieces, "decode", lambda ids: "lost")
    import pyarrow as pa
    from types import SimpleNamespace
    batch = pa.RecordBatch.from_pydict({"text": ["lost", "kept", None]})
    made = list(sentence_pieces._encoder(SimpleNamespace(value=b""), "text", "ids", False, flag="round_trip")([batch]))
    assert [x for b in made for x in b.column("round_trip").to_pylist()] == [True, False, False]


def test_suffix_dedup(docs, none, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SPLIT", 2)
    rows = docs.collect()
    count = collections.Counter(x[p : p + 200] for x in ((r.text or "").encode() for r in rows) for p in range(len(x) - 199))
    got = collections.Counter(tuple(r) for r in suffix_dedup.without_repeats(docs).drop("spans").collect())
    want = collections.Counter()
    for r in rows:
        x = (r.text or "").encode()
        hit = bytearray(len(x))
        for p in range(len(x) - 199):
            if count[x[p : p + 200]] > 1:
                hit[p : p + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(x)) if hit[i] and (not i or not hit[i - 1]))
        want[r.doc_id, len(x), sum(hit), runs, hashlib.sha256(bytes(c for c, h in zip(x, hit) if not h)).hexdigest()] += 1
    assert got == want
    assert suffix_dedup.without_repeats(none).collect() == []


def test_suffix_array_and_prefixes():
    data = np.frombuffer(b"abracadabra" * 40 + bytes(5), dtype=np.uint8)
    raw = data.tobytes()
    assert suffix_dedup.suffix_array(data)[:50].tolist() != [] and sorted(suffix_dedup.suffix_array(data)) == list(range(len(raw)))
    body = data[:440]
    assert suffix_dedup.suffix_array(body).tolist() == sorted(range(440), key=lambda i: raw[i:440])


def test_jaccard(docs, none, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 2)
    rows = docs.collect()
    sets = []
    for r in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").encode().lower().decode())
        sets.append({tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else {tuple(found)} if found else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r.doc_id for r, h in zip(rows, group) if h == g and r.doc_id is not None), default=None) for g in group}
    want = collections.Counter((r.doc_id, len(s), least[g]) for r, s, g in zip(rows, sets, group))
    assert collections.Counter(map(tuple, jaccard_join.JaccardJoin(docs).documents().select("doc_id", "n_shingles", "component_id").collect())) == want
    one = jaccard_join.one_of_each(docs)
    assert one.columns == docs.columns and one.filter("text is not null").count() == len({g for g, s in zip(group, sets) if s}) + sum(1 for r, s in zip(rows, sets) if not s and r.text is not None)
    assert jaccard_join.one_of_each(none).collect() == []


def test_documents_are_shuffled_once_for_one_of_each(spark):
    rows = [(7, "a b c d e f", "x"), (7, "a b c d e f", "x"), (None, "a b c d e f", "x"), (8, "a b c d e f", "y"), (None, "one two", "z"), (None, "one two", "z"), (9, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # tables this small are not shuffled else
    try:
        one = jaccard_join.one_of_each(docs)
        to_scan = one._jdf.queryExecution().executedPlan().toString().split("Scan ExistingRDD")[0]
        assert to_scan.count("Exchange") == 1
        assert sorted(map(str, map(tuple, one.collect()))) == sorted(map(str, [rows[0], rows[4], rows[6]]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_jaccard_shingles_of_the_same_sets_are_one_tile(spark):
    """Three copies of 400 words with one word changed have a few hundred prefix shingles together, but few distinct tiles."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(["x", *words[1:]]), " ".join([*words[:-1], "y"]), "nothing like the others at all"]
    join = jaccard_join.JaccardJoin(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2))
    tiles = join.live().collect()
    assert len(tiles) <= 4 and sum(t.times for t in tiles) > 80 and all(t.own is None for t in tiles)
    assert sorted((r.doc_id, r.component_id) for r in join.documents().collect()) == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_members_of_shingles_over_batches():
    """A shingle may go on in the next batch; more sets than allowed come in pieces."""
    import pyarrow as pa

    sizes = [1, 2, 7, 1, 3, 4, 1]
    sig = [g for g, n in enumerate(sizes) for _ in range(n)]
    for step in (1, 2, 5, 19):
        batches = [pa.RecordBatch.from_pydict({"rid": [*range(a, min(a + step, 19))], "sig": sig[a : a + step]}) for a in range(0, 19, step)]
        got = [tuple(r.values()) for b in jaccard_join._members(3)(iter(batches)) for r in b.to_pylist()]
        assert sorted(got, key=lambda r: r[2]) == [(1, None, [1, 2]), (2, 2, [3, 4, 5]), (2, 2, [6, 7, 8]), (2, 2, [9]), (4, None, [11, 12, 13]), (5, 5, [14, 15, 16]), (5, 5, [17])]


def test_kept_documents_of_odd_rows(spark):
    """Null and repeated keys, repeated rows, null texts and columns named like those of the operator."""
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "x"), (1, good, "en", "x"), (None, good, None, "y"), (2, None, "en", "z"), (3, "", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, m string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.m) for r in kept.collect()) == [(0, "y"), (1, "x"), (1, "x")]
    assert quality.kept_documents(docs.limit(0), labels).count() == 0
