"""Personal data by weak supervision, in DataFrame functions only.

Four base kinds are found by fixed patterns and stay whatever the model says. Further spans
(secrets: keys, tokens, passwords) come from a wide candidate pattern. Four labelers vote on
each candidate (1, 0 or -1): known formats (regex), the word before it in lists of telling
and of ordinary words (gazetteer), the marks around it (context), its make-up of letters and
digits (shape). Expectation-maximisation over the counts of vote patterns estimates the
labelers' reliabilities; the posteriors then train a logistic classifier of spans, which
decides. Only counts of vote patterns reach the driver, a number fixed by the labelers.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The base patterns. Where the wording of a pattern would make a regex engine
# scan a long run again from each of its characters, a look-behind or a possessive loop says
# the same in one pass.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "secret")
#: Candidates: runs of 12 or more key characters that are not part of an address.
CANDIDATE = r"(?<![A-Za-z0-9_@.+%/-])[A-Za-z0-9_-]{12,}+(?![A-Za-z0-9_@.+%/-])"
FORMATS = r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,64}|[0-9A-F]{16,64}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,})$"
TELLING = ("password", "passwd", "pwd", "passphrase", "secret", "token", "key", "apikey", "api_key", "access_key", "auth", "bearer", "credential", "credentials", "kennwort", "passwort", "contraseña", "clave", "mot_de_passe", "jeton")
ORDINARY = ("id", "no", "nr", "number", "page", "version", "model", "part", "isbn", "figure", "section", "chapter", "commit", "build")
LABELERS = 4
#: Code points before and after a candidate that the context labelers see.
WINDOW = 32
#: Matches of a text whose places are found in one go.
BLOCK = 256


def _find(text: Column, pattern: str, likely: Column) -> Column:
    """start, end and value of all matches, leftmost and without overlap: what lies between them and they themselves, laid end to end.

    Matches are taken in blocks of ``BLOCK``: an array that grows match by match is copied for
    each of them, so it is grown inside a block only, and where blocks begin is summed apart.
    """
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def width(x: Column) -> Column:
        return F.length(x["gap"]) + F.length(F.coalesce(x["hit"], F.lit("")))

    def place(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + F.length(x["gap"]), acc["at"] + width(x)
        more = F.when(x["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))))
        return F.struct(end.alias("at"), more.alias("found"))

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), place, lambda acc: acc["found"])

    def in_blocks(pieces: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(pieces), F.lit(BLOCK))
        blocks = F.transform(firsts, lambda first: F.slice(pieces, first, F.lit(BLOCK)))
        return _once(blocks, lambda held: F.flatten(F.zip_with(held, begins(held), placed)))

    def begins(blocks: Column) -> Column:
        """Where each block starts: the sums of the widths before it."""
        widths = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + width(x)))
        return F.slice(F.aggregate(widths, F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + w))), F.lit(1), F.size(blocks))

    return F.when(likely, _once(zipped, lambda pieces: F.when(F.size(pieces) <= BLOCK, placed(pieces, F.lit(0))).otherwise(in_blocks(pieces)))).otherwise(none)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Sum of the digits from the right, every second one doubled (less 9 from ten on), divides by ten."""
    digits = F.split(F.reverse(_digits(value)), "")
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _low_parts(value: Column) -> Column:
    return F.forall(F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def _as(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    some_digits = text.rlike("[0-9]")
    count = lambda v: F.length(_digits(v))
    return {
        "email": _find(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(_find(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: _low_parts(s["value"])),
        "card": F.filter(_find(text, CARD, some_digits & text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda s: count(s["value"]).between(14, 19) & _luhn(s["value"])),
        "phone": F.filter(_find(text, PHONE, F.contains(text, F.lit("+"))), lambda s: count(s["value"]).between(10, 15)),
    }


def _candidates(text: Column) -> Column:
    """Candidate spans with the labelers' votes and further features, all as small integers."""
    found = _find(text, CANDIDATE, text.rlike(r"[A-Za-z0-9_-]{12}") & text.rlike("[0-9]"))
    found = F.filter(found, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))

    def describe(s: Column) -> Column:
        value, size = s["value"], s["end"] - s["start"]
        before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - WINDOW), F.least(F.lit(WINDOW), s["start"])))
        after = F.substring(text, s["end"] + 1, F.lit(1))
        word = F.regexp_extract(before, r"([\p{L}_]+)[^\p{L}_]*$", 1)
        digits = F.length(_digits(value))
        shape = F.when((digits * 4 >= size) & (size - digits >= 2), 1).when(digits <= 2, -1).otherwise(0)
        context = F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).when(before.rlike(r"[\"'(]$") & after.rlike("[\"')]"), 0).when(before.rlike(r"[#/_]\s*$"), -1).otherwise(0)
        votes = [
            F.when(value.rlike(FORMATS), 1).when(value.rlike("^[A-Za-z]+[0-9]{1,4}$"), -1).otherwise(0),
            F.when(word.isin(*TELLING), 1).when(word.isin(*ORDINARY), -1).otherwise(0),
            context,
            shape,
        ]
        length = F.when(size < 16, 0).when(size < 24, 1).when(size < 48, 2).otherwise(3)
        cased = F.when(value.rlike("[a-z]") & value.rlike("[A-Z]"), 1).otherwise(0)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), F.array(*votes, length, cased).alias("f"))

    return F.transform(found, describe)


def em(counts: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], float, list[dict[int, dict[int, float]]]]:
    """Posterior of each vote pattern, share of true spans and P(vote | class) of each labeler, from the patterns' counts.

    It begins from the sign of the summed votes; counts are smoothed by one.
    """
    post = {v: min(0.95, max(0.05, 0.5 + 0.25 * sum(v))) for v in counts}
    prior, rates = 0.5, []
    for _ in range(rounds):
        total = sum(counts.values())
        true = sum(n * post[v] for v, n in counts.items())
        prior = (true + 1) / (total + 2)
        rates = []
        for k in range(LABELERS):
            rate = {}
            for c in (0, 1):
                mass = {x: 1.0 for x in (-1, 0, 1)}
                for v, n in counts.items():
                    mass[v[k]] += n * (post[v] if c else 1 - post[v])
                whole = sum(mass.values())
                rate[c] = {x: m / whole for x, m in mass.items()}
            rates.append(rate)
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[k][1][v[k]] / rates[k][0][v[k]]) for k in range(LABELERS))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return post, prior, rates


def _inputs(f: tuple[int, ...]) -> list[float]:
    """Inputs of the classifier: each vote's two signs, the length class and mixed case."""
    votes = [float(f[k] == s) for k in range(LABELERS) for s in (1, -1)]
    return [1.0, *votes, *(float(f[LABELERS] == c) for c in (1, 2, 3)), float(f[LABELERS + 1])]


def train_classifier(counts: dict[tuple[int, ...], float], rounds: int = 300) -> list[float]:
    """Logistic regression of the EM posteriors on the inputs, weighted by count, by gradient steps."""
    votes: dict[tuple[int, ...], float] = {}
    for f, n in counts.items():
        votes[f[:LABELERS]] = votes.get(f[:LABELERS], 0.0) + n
    post, _, _ = em(votes)
    rows = [(_inputs(f), n, post[f[:LABELERS]]) for f, n in counts.items()]
    total, w = sum(n for _, n, _ in rows), [0.0] * (2 * LABELERS + 5)
    for _ in range(rounds):
        grad = [1e-3 * x for x in w]
        for x, n, p in rows:
            s = sum(a * b for a, b in zip(w, x, strict=True))
            d = (1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) - p) * n / total
            for i, v in enumerate(x):
                if v:
                    grad[i] += d * v
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def _score(weights: list[float], f: Column) -> Column:
    out = F.lit(weights[0])
    terms = [(f[k] == s, weights[1 + 2 * k + (s == -1)]) for k in range(LABELERS) for s in (1, -1)]
    terms += [(f[LABELERS] == c, weights[2 * LABELERS + c]) for c in (1, 2, 3)]
    terms += [(f[LABELERS + 1] == 1, weights[2 * LABELERS + 4])]
    for test, weight in terms:
        out = out + F.when(test, F.lit(weight)).otherwise(0.0)
    return out


def _joined(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"])), ",")


def find_private(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, numbers of base spans by kind, base_sha256, spans, n_secret.

    Null texts count as empty: no spans. Long texts are searched whole; equal rows give equal
    results; an empty table, or one without candidates, gives base spans only. Other columns
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(F.col("t"))
    rows = common.pick(docs, "doc_id", "text").select("doc_id", text.alias("t"))
    rows = rows.select("doc_id", *[_as(k, base[k]).alias(k) for k in base], _candidates(F.col("t")).alias("candidates"))
    rows = common.settle(rows, "spans")
    seen = rows.select(F.explode("candidates.f").alias("f")).groupBy("f").agg(F.count("*").alias("n")).collect()
    counts = {tuple(r["f"]): float(r["n"]) for r in seen}
    chosen = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if counts:
        weights = train_classifier(counts)
        chosen = F.filter("candidates", lambda c: _score(weights, c["f"]) > 0)
        chosen = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("secret")).alias("kind"), c["end"].alias("end")))
    found = F.concat(*base)
    counted = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counted, F.sha2(_joined(found).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(found, chosen)).alias("spans"), F.size(chosen).cast("long").alias("n_secret"))


def op4_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every row of ``documents``; see ``find_private`` for nulls, very long texts and empty tables."""
    return find_private(common.read(spark, sf_dir, "documents"))
