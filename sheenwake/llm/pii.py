"""Personal data by weak supervision, in DataFrame functions alone (operator 4).

Candidates are spans that a pattern finds. Five labelers vote on each (-1 no, 0 abstain, 1 yes): strict
form, checksum or structure, a gazetteer, cue words in front, and the characters at the borders. Votes
are counted by pattern of votes over the whole corpus (a bounded table: kinds x 3^5 x 3). On that table
expectation-maximisation (Dawid-Skene) estimates each labeler's reliability and every kind's share of
true spans, and a logistic span classifier is fitted to the posteriors it gives. A span stays if the
classifier gives it one half or more and its checksum or structure does not fail; spans of the four base
kinds that pass their own test always stay.

Patterns use possessive loops and look-behind so that a text is read in linear time whatever it holds.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans at one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "email_obfuscated", "ssn", "phone_local", "iban")
BASE = KINDS[:4]
LABELERS = ("form", "check", "gazetteer", "context", "border")

#: Same matches as the plain forms in the tests, without retries inside a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "email_obfuscated": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++"
                        r"(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone_local": r"(?<!\+[0-9]{1,3}[ -]{0,1})(?<![0-9A-Za-z(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: What a text must contain for a pattern to be tried at all.
GUARDS = {"email": "contains({t}, '@')", "email_obfuscated": "(contains({t}, '(at)') or contains({t}, '[at]'))",
          "phone": "contains({t}, '+')"}
GAZETTEER = {
    "domains": ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "us", "it", "nl"),
    "countries": ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46",
                  "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82",
                  "84", "86", "90", "91", "92", "94", "98"),
    "ibans": ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE"),
}
CUES = (r"(?:e-?mail|mail|contact|kontakt|correo|courriel|write to|call|phone|tel|fax|mobile|telefon|t[ée]l[ée]fono?|"
        r"card|visa|mastercard|karte|carte|tarjeta|payment|pay|iban|account|konto|compte|cuenta|ssn|social security|"
        r"ip|address|adresse|direcci[oó]n|login|host|client|user)\W*(?:\w+\W+){0,2}$")
CONTRA = r"(?:version|release|isbn|issn|doi|section|chapter|figure|table|page|order|serial|part|model|invoice|rev)\W*(?:no|nr)?\W*$"


def _found(kind: str, t: str) -> Column:
    """Matches of a kind as structs: start, end (code points, exclusive), value, text before, next character.

    Starts are running sums over the pieces between the matches, by blocks of 128 matches.
    """
    pattern = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
    guard = GUARDS.get(kind, "{t} rlike '[0-9]'").format(t=t)
    sizes = "transform(m, (x, i) -> length(x) + length(g[i]))"
    blocks = ("transform(sequence(0, int((size(z) - 1) / 128)), "
              "b -> aggregate(slice(z, b * 128 + 1, 128), 0, (a, x) -> a + x))")
    bases = "aggregate(b, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    start = ("o[int(i / 128)] + aggregate(slice(z, int(i / 128) * 128 + 1, i % 128), 0, (a, y) -> a + y) + length(g[i])")
    made = (f"transform(m, (x, i) -> named_struct('start', {start}, 'end', {start} + length(x), 'value', x, "
            "'before', lower(right(g[i], 40)), 'after', left(g[i + 1], 1)))")

    def let(name, value, body):
        return f"transform(array({value}), {name} -> {body})[0]"

    body = let("g", f"split({t}, '{pattern}', -1)",
               let("z", sizes, let("b", blocks, let("o", bases, made))))
    body = let("m", f"regexp_extract_all({t}, '{pattern}', 0)", f"if(size(m) = 0, null, {body})")
    empty = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    return F.expr(f"coalesce(if({guard}, {body}, null), cast(array() as {empty}))")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes(kind: str, x: Column) -> tuple[Column, list[Column]]:
    """Whether the span passes the base test, and the five votes."""
    value = x["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    never, always = F.lit(False), F.lit(True)
    suffix = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
    small = F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                     & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind in ("email", "email_obfuscated"):
        form = _vote(value.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@|\("), value.contains(".."))
        check = _vote(suffix.rlike("^[a-z]{2,}$"), ~suffix.rlike("^[a-z]{2,}$"))
        gaz = _vote(suffix.isin(*GAZETTEER["domains"]), never)
        ok = always
    elif kind == "ip":
        ok = small
        form = _vote(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), ~small)
        check = _vote(small, ~small)
        gaz = _vote(never, value.rlike(r"^(0|127|22[4-9]|2[3-5][0-9])\."))
    elif kind == "card":
        ok = n.between(14, 19) & F.call_function("luhn_check", digits)
        form = _vote(value.rlike(r"^([0-9]{14,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{2,7})$"), ~n.between(14, 19))
        check = _vote(ok, ~F.call_function("luhn_check", digits))
        gaz = _vote(n.between(14, 19) & digits.rlike("^[3-6]"), ~digits.rlike("^[3-6]"))
    elif kind in ("phone", "phone_local"):
        ok = n.between(10, 15)
        form = _vote(ok & ~value.rlike(r"[ .-]{3}|\(\)"), value.rlike(r"[ .-]{3}|\(\)"))
        check = _vote(ok, ~ok)
        code = [F.substring(digits, 1, k).isin(*GAZETTEER["countries"]) for k in (1, 2)]
        gaz = _vote(code[0] | code[1], never) if kind == "phone" else _vote(never, never)
    elif kind == "ssn":
        bad = value.rlike("^(000|666|9)|-00-|-0000$")
        ok, form, check, gaz = ~bad, _vote(always, never), _vote(~bad, bad), _vote(never, bad)
    else:
        long = F.length(F.regexp_replace(value, " ", "")).between(15, 34)
        known = F.substring(value, 1, 2).isin(*GAZETTEER["ibans"])
        ok, form, check, gaz = long, _vote(long, ~long), _vote(value.rlike("[0-9]{6}"), never), _vote(known, ~known)
    context = _vote(x["before"].rlike(CUES), x["before"].rlike(CONTRA))
    glued = x["before"].rlike(r"[\p{L}\p{N}]$") | x["after"].rlike(r"[\p{L}\p{N}]")
    return (ok if kind in BASE else F.lit(False)), [form, check, gaz, context, _vote(~glued, glued)]


def candidates(text: Column, name: str) -> Column:
    """All candidates of a text (column ``name``) with votes: kind number, start, end, base, votes, size class."""
    def shaped(k: int, kind: str):
        def one(x):
            base, votes = _votes(kind, x)
            size = F.when(F.length(x["value"]) < 10, 0).when(F.length(x["value"]) < 18, 1).otherwise(2)
            return F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"),
                            F.coalesce(base, F.lit(False)).alias("base"),
                            *[F.coalesce(v, F.lit(0)).alias(n) for n, v in zip(LABELERS, votes)],
                            size.alias("size"))
        return one

    parts = [F.transform(_found(kind, f"`{name}`"), shaped(k, kind)) for k, kind in enumerate(KINDS)]
    return F.concat(*parts)


@dataclass(frozen=True)
class SpanModel:
    """What the corpus taught: reliabilities[labeler][truth][vote + 1], shares by kind, classifier weights."""

    reliabilities: dict
    shares: dict
    weights: dict

    def probability(self, x: Column) -> Column:
        """Probability that a candidate (struct) is personal data."""
        def look(name, values, shift):
            table = F.array(*[F.lit(float(self.weights.get((name, v), 0.0))) for v in values])
            return F.element_at(table, x[name] + shift)

        total = F.lit(float(self.weights.get(("bias", 0), 0.0)))
        for name in LABELERS:
            total = total + look(name, (-1, 0, 1), 2)
        total = total + look("kind", range(len(KINDS)), 1) + look("size", range(3), 1)
        return 1 / (1 + F.exp(-total))


def aggregate_votes(rows: list[dict], rounds: int = 60) -> tuple[dict, dict, list[float]]:
    """Reliabilities, shares and posteriors by Dawid-Skene from counted vote patterns.

    Starts from the majority of votes; counts are smoothed, so a labeler that always abstains is neutral.
    """
    total = [sum(r[n] for n in LABELERS) for r in rows]
    post = [1 / (1 + math.exp(-t)) for t in total]
    for _ in range(rounds):
        shares = {}
        for k in {r["kind"] for r in rows}:
            own = [(r["n"], p) for r, p in zip(rows, post) if r["kind"] == k]
            shares[k] = (sum(n * p for n, p in own) + 1) / (sum(n for n, _ in own) + 2)
        rel = {}
        for name in LABELERS:
            seen = {y: [1.0, 1.0, 1.0] for y in (0, 1)}
            for r, p in zip(rows, post):
                seen[1][r[name] + 1] += r["n"] * p
                seen[0][r[name] + 1] += r["n"] * (1 - p)
            # a labeler is taken to be better than a coin
            seen[1][2] += 2.0
            seen[0][0] += 2.0
            rel[name] = {y: [c / sum(v) for c in v] for y, v in seen.items()}
        post = []
        for r in rows:
            odds = math.log(shares[r["kind"]] / (1 - shares[r["kind"]]))
            odds += sum(math.log(rel[n][1][r[n] + 1] / rel[n][0][r[n] + 1]) for n in LABELERS)
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return rel, shares, post


def fit_classifier(rows: list[dict], post: list[float], steps: int = 300, rate: float = 0.5) -> dict:
    """Logistic weights of one-hot kind, size and votes, fitted to the posteriors."""
    keys = [[("bias", 0), ("kind", r["kind"]), ("size", r["size"])] + [(n, r[n]) for n in LABELERS] for r in rows]
    weights = {k: 0.0 for row in keys for k in row}
    speed = dict.fromkeys(weights, 1e-8)
    count = sum(r["n"] for r in rows) or 1
    for _ in range(steps):
        grad = {k: 1e-4 * w for k, w in weights.items()}
        for row, r, p in zip(keys, rows, post):
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[k] for k in row))))) - p
            for k in row:
                grad[k] += e * r["n"] / count
        for k, g in grad.items():
            speed[k] += g * g
            weights[k] -= rate * g / math.sqrt(speed[k])
    return weights


def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Vote patterns of all candidates of all texts, then the model; no candidates: an empty model (0.5)."""
    t = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_pii_text"))
    seen = t.select(F.explode(candidates(F.col("_pii_text"), "_pii_text")).alias("c")).select("c.*")
    rows = [r.asDict() for r in seen.groupBy("kind", "size", *LABELERS).agg(F.count("*").alias("n")).collect()]
    rows.sort(key=lambda r: tuple(r[k] for k in ("kind", "size", *LABELERS)))
    if not rows:
        return SpanModel({}, {}, {})
    rel, shares, post = aggregate_votes(rows)
    return SpanModel(rel, shares, fit_classifier(rows, post))


def spans(docs: DataFrame, model: SpanModel, text_col: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with ``out``: array of (start, kind, end, base, probability), by start and then kind.

    kind is its place in ``KINDS``. A null or empty text has no span; spans of different kinds may
    overlap; all rows and columns stay, and a column named ``out`` is replaced.
    """
    def kept(x):
        return x["base"] | ((x["check"] >= 0) & (model.probability(x) >= 0.5))

    t = docs.withColumn("_pii_text", F.coalesce(F.col(text_col), F.lit("")))
    found = F.filter(candidates(F.col("_pii_text"), "_pii_text"), kept)
    shaped = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"),
                                                   x["base"].alias("base"), model.probability(x).alias("probability")))
    return t.withColumn(out, F.array_sort(shaped)).drop("_pii_text")


def kind_name(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), number + 1)


def digest(spans_col: str = "pii_spans", base_only: bool = False) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    own = F.filter(spans_col, lambda x: x["base"]) if base_only else F.col(spans_col)
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", kind_name(x["kind"]), x["start"], x["end"])), ",")


def mask(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """Texts with every span replaced by its kind in brackets; of overlapping spans, the first start leads."""
    joined = f"""aggregate(`{spans_col}`, named_struct('at', 0, 'text', ''), (a, x) -> if(x.start < a.at,
        named_struct('at', greatest(a.at, x.end), 'text', a.text),
        named_struct('at', x.end, 'text', concat(a.text, substring(`{text_col}`, a.at + 1, x.start - a.at),
            '[', upper(element_at(array({', '.join(f"'{k}'" for k in KINDS)}), x.kind + 1)), ']'))),
        a -> concat(a.text, substring(`{text_col}`, a.at + 1)))"""
    return docs.withColumn(text_col, F.when(F.size(spans_col) > 0, F.expr(joined)).otherwise(F.col(text_col)))
