"""Quality rules, licenses and personal data next to brute force on small tables."""
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sheenwake.llm import divergence, licenses, pii

TEXTS = [
    (1, "The cat sat on the mat and the cat sat on the mat again today", "en"),
    (2, None, None), (3, "", "en"), (4, "  \n\t ", "xx"), (5, "one", "en"), (5, "one", "en"),
    (6, "a b c d e f g a b c d e x y z q r s t u", "en"), (7, "a a a a a a a a a a a a", "en"),
    (8, "line one\nline two\nline one\n\nline one \nÉtat des lieux # * | <x>", "fr"),
    (9, "Under the MIT License under the mit license. Apache License, Version 2.0; CC-BY-NC cc by nc", "en"),
    (10, "Mail me: a.b@c.example.com, x@y or p@q.r.s.; ip 10.0.0.1 or 300.1.1.1 and 1.2.3.4.5.6.7.8 ", "en"),
    (11, "card 4111 1111 1111 1111 and 4111111111111112 call +1 (555) 010-9999 or +49 30 1234 5678x + 12", "en"),
    (12, "a@b.c..x@d.e a@b.c@d.e a@b.c_x@d.e " + "a.b" * 50 + "@c.de", "en"),
    (13, "word " * 3000 + "9" * 500, "en"), (None, "no id but some words in here to be read now ok", "en"),
    (14, "ssn 078-05-1120 tel 555-123-4567 me (at) home (dot) org", "en"),
    (15, "Ünder the mıt K license K İ end under the mit license", "de"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "extra") for t in TEXTS], "doc_id long, text string, lang string, label string")


def plain_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def plain_js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt(sum((a * math.log2(a / c) if a else 0) + (b * math.log2(b / c) if b else 0)
                         for a, b, c in zip(p, q, m)) / 2)


def test_rules(docs):
    ref = divergence.references(docs)
    got = divergence.apply_rules(docs, ref).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = plain_rules(r["text"] or "")
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r["label"] == "extra" and not (r["kept"] and r["base_failed"])
    refs = {r["lang"]: r for r in ref.collect()}
    assert "*" in refs and all(abs(sum(r["chars"]) - 1) < 1e-9 and abs(sum(r["words"]) - 1) < 1e-9 for r in refs.values())
    r = next(r for r in got if r["doc_id"] == 13)
    words = r["text"].split()
    by = {w: c for w, c in refs["en"]["codes"].items()}
    p = [sum(by.get(w) == c for w in words) / len(words) for c in divergence.LETTERS]
    assert math.isclose(r["word_distance"], plain_js([*p, 1 - sum(p)], refs["en"]["words"]), abs_tol=1e-6)


def test_rules_of_nothing(spark, docs):
    none = docs.limit(0)
    assert divergence.apply_rules(none, divergence.references(none)).count() == 0
    empty_reference = divergence.references(none)
    assert divergence.apply_rules(docs, empty_reference).where("kept").count() >= 1


def test_divergence_catches_noise(spark):
    good = "the man and the dog went to the house of the king and then to the sea with a boat of wood "
    rows = [(i, good + f"word{i} " * 3 + good[:: 1 + i % 2] + " ".join(f"w{i}x{j}" for j in range(20)), "en") for i in range(60)]
    rows += [(99, " ".join(f"#{j}$%{j}&*" for j in range(100)), "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in divergence.apply_rules(d, divergence.references(d)).collect()}
    assert not got[99]["kept"] and not got[99]["base_failed"] and got[2]["char_distance"] < 0.2


def test_small_language_has_its_own_reference(spark):
    # 36 clean Russian texts among 5,000 English ones, one of noise, one in a language of its own, one without a language
    words = "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой".split()
    english = "the of and to in is you that it he was for on are as with his they at be this have from or one".split()
    random.seed(2)
    rows = [(10_000 + k, " ".join(random.choices(english, k=60)), "en") for k in range(5000)]
    rows += [(2000 + k, " ".join(random.choices(words, k=80)), "ru") for k in range(36)]
    rows += [(3000, " ".join(f"#{j}$%{j}&*" for j in range(40)), "ru"), (3001, " ".join(f"слово{j}" for j in range(60)), "uk"),
             (3002, " ".join(f"слово{j}" for j in range(60)), None), (3003, rows[1][1], ""), (3004, " ", "zz")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ref = divergence.references(d)
    got = {r["doc_id"]: r for r in divergence.apply_rules(d, ref).collect()}
    assert len(got) == len(rows) and {r["lang"] for r in ref.collect()} == {"en", "ru", "uk", "zz", "*"}
    assert all(got[2000 + k]["char_distance"] < 0.2 and got[2000 + k]["kept"] for k in range(36))
    assert not got[3000]["kept"] and not got[3002]["kept"] and got[3003]["kept"] and got[3003]["word_distance"] is not None
    assert got[3001]["char_distance"] is None and got[3001]["word_distance"] is None and got[3001]["kept"]


def plain_licenses(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    at, labels = [], set()
    for p, label in licenses.PHRASES.items():
        q = p.split()
        hits = [i for i in range(len(w)) if w[i:i + len(q)] == q]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def plain_matches(t, containment):
    w = lambda x: set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x)))
    blocks = t.split("\n") + [p for p in re.split("\n[ \t\r]*\n", t) if "\n" in p]
    best = {}
    for label, text in licenses.TEMPLATES:
        own = set(text.split())
        for b in blocks:
            c = len(w(b) & own) / len(own)
            if c >= containment - 1e-9:
                best[label] = max(best.get(label, 0), c)
    return best


def test_licenses(spark, docs):
    long = "\n".join(f"filler text number {i} of the software" for i in range(300))
    more = spark.createDataFrame(
        [(20 + k, f"Intro.\n{text.title()}, see below.\nend", "en", "x") for k, (_, text) in enumerate(licenses.TEMPLATES)]
        + [(50, long + "\n" + licenses.TEMPLATES[2][1].replace(" with ", "\nwith ") + "\n\nmore", "en", "x"),
           (51, "Permission to use copy modify software for any purpose granted", "en", "x")], docs.schema)
    both = docs.union(more)
    texts = {}
    for r in both.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    got = licenses.scan(both).collect()
    assert len(got) == both.count()
    for r in got:
        t = texts[r["doc_id"]][0]
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain_licenses(t)
        best = plain_matches(t, licenses.CONTAINMENT)
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == base | set(best)
        assert math.isclose(r["score"], 1.0 if base else max(best.values(), default=0.0))
    assert licenses.scan(docs.limit(0)).count() == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for n, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn)
                    or kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(out))


def test_personal_data(docs):
    model = pii.fit(docs)
    found = pii.spans(docs, model)
    got = pii.mask(found.withColumn("own", pii.digest()).withColumn("base", pii.digest(base_only=True))).collect()
    assert len(got) == len(TEXTS)
    texts = {k: t or "" for k, t, _ in TEXTS}
    for r in got:
        t = texts[r["doc_id"]]
        assert r["base"] == plain_spans(t)
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["own"].split(",")))
        if not r["own"]:
            assert (r["text"] or "") == t
    masked = {r["doc_id"]: r["text"] for r in got}
    assert "10.0.0.1" not in masked[10] and "[EMAIL]" in masked[10] and "300.1.1.1" in masked[10]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_personal_data_many_and_none(spark, docs):
    many = spark.createDataFrame([(1, " ".join(f"u{i}@h{i}.example.org 10.0.{i % 256}.7" for i in range(700)))], "doc_id long, text string")
    r = pii.spans(many, pii.fit(many)).select(pii.digest(base_only=True).alias("b")).first()
    assert r["b"] == plain_spans(many.first()["text"])
    assert pii.spans(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_reliabilities():
    rows = [dict(kind=0, size=0, form=f, check=c, gaze=0, gazetteer=0, context=0, border=b, n=n)
            for f, c, b, n in ((1, 1, 1, 500), (-1, -1, 1, 300), (1, -1, 1, 5), (-1, 1, -1, 5))]
    rel, shares, post = pii.aggregate_votes(rows)
    assert post[0] > 0.9 and post[1] < 0.1 and 0.5 < shares[0] < 0.75
    assert rel["check"][1][2] > 0.9
    weights = pii.fit_classifier(rows, post)
    assert weights[("form", 1)] > weights[("form", -1)]


def test_references_class_characters_in_words_and_not_once_more_in_texts(spark, monkeypatch):
    docs = spark.createDataFrame([("Ab, 12 #x\té\n\nab", "en"), ("ab  ab", "en"), (None, "fr"), (" ", None), ("Zz %", "")],
                                 "text string, lang string")
    each = divergence.measure(docs).select(F.when(F.col("lang") != "", F.col("lang")).otherwise("*").alias("lang"), "_chars", "n_words").collect()
    monkeypatch.setattr(divergence, "measure", None)
    got = {r["lang"]: r for r in divergence.references(docs).collect()}
    assert set(got) == {"en", "fr", "*"}
    for lang, r in got.items():
        mine = [x for x in each if lang in ("*", x["lang"])]
        sums = [sum(c) for c in zip(*(x["_chars"] for x in mine))]
        assert r["n_words"] == sum(x["n_words"] for x in mine) and r["n_chars"] == sum(sums)
        assert r["chars"] == [pytest.approx(s / max(sum(sums), 1)) for s in sums]
