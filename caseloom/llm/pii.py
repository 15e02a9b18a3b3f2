"""Personal data by weak supervision.

Base matches of four kinds are found and checked by rule; they always stay. Next to them
stand candidates: card-like numbers whose check digit fails, phone numbers in local form,
defanged addresses, e-mail addresses written out, and secrets (keys and tokens: long runs of
letters and digits). Three labelers vote on every span:

* regex: the strict shape or the check digit of the kind; of a candidate, the strict shape
  once its writing is undone; of a secret, the length of a hexadecimal key or the form of an issuer,
* gazetteer: known issuer prefixes, private network heads, mail domains, area codes, forms of keys,
* context: words before the span that speak for the kind or against it, back to the last match
  of the same pattern.

Expectation maximisation over the counts of vote patterns estimates how reliable each
labeler is, per kind, and how likely each pattern is personal data. A logistic span
classifier is trained on those likelihoods with the span's own features, and a candidate is
added if the classifier is sure of it and no base span overlaps it.

Everything runs as DataFrame functions; models read at most one row per vote pattern.
Positions are code points, the end exclusive. A NULL text is empty. Repeated rows are treated
alike. Of candidates of one kind that overlap, each is judged for itself; one that overlaps a base
span is left out. A table without spans gives empty lists and an empty table an empty result. Long
texts are read whole, in time that grows with their length and, times its logarithm, with their
matches. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from caseloom.llm.common import bind, whole
from caseloom.sources.sinks import write_stage

#: Kinds with base matches, and all kinds.
KINDS = ("email", "ip", "card", "phone")
EVERY = (*KINDS, "secret")
LABELERS = ("regex", "gazetteer", "context")
SURE = 0.9
ROUNDS = 25
CONTEXT = 40
#: Characters of a key or token; longer runs are encoded data.
LONGEST_SECRET = 512

# Patterns of the base kinds. A match may only start where a run of its characters starts,
# or where the last match ended; elsewhere a search would repeat work on long runs.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP_VALID = rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$"

# Patterns of candidates.
_EMAIL_SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,63}){1,4}"
_IP_DEFANGED = r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])"
_PHONE_LOCAL = r"(?<![0-9A-Za-z+(-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])"

_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}"

# Strict shapes of candidates, the first two after bracketed signs are written as signs.
# Top-level domains: two letters (countries), or of the common generic ones.
_TOP = r"(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|mobi|museum|travel|jobs|coop|aero|asia|app|dev|cloud|online|site|shop|store|blog|tech|email|xyz|web|live|news|agency|company|xn--[a-z0-9-]+)"
_EMAIL_STRICT = rf"(?i)^[a-z0-9_](?:[a-z0-9._%+-]*[a-z0-9_])?@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+{_TOP}$"
_CARD_STRICT = r"^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}$"

# Forms of keys by their issuers, and how long hexadecimal keys are.
ISSUED_KEY = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^sk[-_][A-Za-z0-9_-]{20,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{30,}$|^glpat-|^eyJ[A-Za-z0-9_-]{10,}"
HEX_KEY = r"(?i)^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{64}|[0-9a-f]{128})$"
# Words before a secret, for and against.
FOR_SECRET = r"(?i)\b(token|secret|api[-_ ]?key|key|password|passwd|pwd|bearer|authorization|credentials?|access[-_ ]?key|private[-_ ]?key|passwort|kennwort|schlüssel|jeton|clé|mot de passe|clave|contraseña)s?\W{0,12}$"
AGAINST_SECRET = r"(?i)\b(commit|sha|sha1|sha256|md5|checksum|digest|hash|etag|revision|build|version|uuid|guid|id|isbn|doi|src|href|url)\W{0,12}$"

# Words before a span, in English, German, French and Spanish.
FOR = r"(?i)\b(card|visa|mastercard|amex|credit|karte|kreditkarte|carte|tarjeta|phone|tel|telephone|mobile|call|fax|telefon|handy|anruf|téléphone|appelez|teléfono|móvil|llame|e-?mail|mail|contact|write to|kontakt|courriel|correo|ip|address|server|login|adresse|dirección)\W{0,12}$"
AGAINST = r"(?i)\b(token|key|hash|sha|md5|id|uuid|version|v|order|invoice|isbn|issn|serial|commit|build|page|chapter|section|rfc|figure|table)\W{0,12}$"
# Issuer prefixes of cards, heads of private networks, free mail domains.
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
PRIVATE = r"^(10|127|192.{1,5}168|172)\D"
MAIL = r"(?i)(gmail|yahoo|hotmail|outlook|icloud|proton|gmx|web|mail)"
AREA = r"^\(?[2-9][0-9]{2}"


BLOCK = 64


def _scan(values: Column, merge) -> Column:
    """The running results over a short array; each step copies what it has so far."""
    none = F.array().cast("array<int>")

    def step(acc: Column, v: Column) -> Column:
        at = F.coalesce(merge(acc["at"], v), v)
        return F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))

    return F.aggregate(values, F.struct(F.lit(None).cast("int").alias("at"), none.alias("all")), step, lambda a: a["all"])


def running(values: Column, merge) -> Column:
    """The running results of a merge (a sum, a maximum) over an array of numbers, in blocks, so
    that a text with very many matches takes little more than their number of steps."""

    def of_blocks(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.element_at(b, -1))
        return bind(
            _scan(ends, merge),
            lambda before: F.flatten(
                F.transform(
                    blocks,
                    lambda b, j: F.when(j == 0, b).otherwise(F.transform(b, lambda x: merge(F.get(before, F.greatest(j - 1, F.lit(0))), x))),
                )
            ),
        )

    def of_all(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(BLOCK))
        blocks = bind(F.transform(starts, lambda i: _scan(F.slice(v, i, F.lit(BLOCK)), merge)), of_blocks)
        return F.when(F.size(v) == 0, v).when(F.size(v) <= BLOCK, _scan(v, merge)).otherwise(blocks)

    return bind(values, of_all)


def _plus(a: Column, b: Column) -> Column:
    return a + b


def located(text: Column, pattern: str) -> Column:
    """All matches as ``array<struct<s, e, t, c>>``: running sums over the pieces between them give
    the places, and the end of the piece before is the context ``c``."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(CONTEXT)).alias("c")))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("t"), g["n"].alias("g"), g["c"].alias("c")))
    pairs = F.filter(pairs.cast("array<struct<t:string,g:int,c:string>>"), lambda p: p["t"].isNotNull())

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: x["g"] + F.length(x["t"])), _plus)

        def one(x: Column, e: Column) -> Column:
            return F.struct((e - F.length(x["t"])).alias("s"), e.alias("e"), x["t"].alias("t"), x["c"].alias("c"))

        return F.zip_with(p, ends, one)

    return bind(pairs, placed)


def apart_from(base: Column, candidates: Column) -> Column:
    """The candidates that no span of ``base`` overlaps. Base spans are put in order of their
    starts; a candidate looks up how many start before its end, and the furthest end of these."""

    def apart(starts: Column, furthest: Column, x: Column) -> Column:
        # Binary search: how many starts lie below the end of x.
        begin = F.struct(F.lit(0).alias("low"), F.size(starts).alias("high"))

        def halve(a: Column, _: Column) -> Column:
            mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
            below = F.get(starts, mid) < x["e"]
            done = a["low"] >= a["high"]
            low = F.when(done, a["low"]).when(below, mid + 1).otherwise(a["low"])
            high = F.when(done, a["high"]).when(below, a["high"]).otherwise(mid)
            return F.struct(low.alias("low"), high.alias("high"))

        count = F.aggregate(F.sequence(F.lit(1), F.lit(32)), begin, halve, lambda a: a["low"])
        return bind(count, lambda n: (n == 0) | (F.get(furthest, F.greatest(n - 1, F.lit(0))) <= x["s"]))

    def with_order(order: Column) -> Column:
        starts, ends = F.transform(order, lambda b: b["s"]), F.transform(order, lambda b: b["e"])
        return bind(
            F.struct(starts.alias("s"), running(ends, F.greatest).alias("f")),
            lambda o: F.filter(candidates, lambda x: apart(o["s"], o["f"], x)),
        )

    order = F.sort_array(F.transform(base, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))))
    return F.when(F.size(candidates) == 0, candidates).when(F.size(base) == 0, candidates).otherwise(bind(order, with_order))


def _guarded(text: Column, pattern: str, guard: Column) -> Column:
    none = F.array().cast("array<struct<s:int,e:int,t:string,c:string>>")
    return F.when(guard, located(text, pattern)).otherwise(none)


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check."""

    def value(d: Column, i: Column) -> Column:
        n = F.ascii(d) - 48
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, twice).otherwise(n)

    parts = F.transform(F.split(F.reverse(number), ""), value)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _spans(text: Column) -> Column:
    """``array<struct<kind, base, s, e, t, c>>`` of base spans and candidates."""
    has = lambda s: F.contains(text, F.lit(s))
    bracket = has("(at)") | has("[at]")
    bare_digits = text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")

    def tag(spans: Column, kind: int, base) -> Column:
        def one(x: Column) -> Column:
            valid = base(x["t"]) if callable(base) else F.lit(base)
            return F.struct(F.lit(kind).alias("kind"), valid.alias("base"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), x["c"].alias("c"))

        return F.transform(spans, one)

    email = tag(_guarded(text, _EMAIL, has("@")), 0, True)
    ip = F.filter(tag(_guarded(text, _IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]")), 1, lambda t: t.rlike(_IP_VALID)), lambda x: x["base"])
    card = F.filter(_guarded(text, _CARD, bare_digits), lambda x: F.length(digits(x["t"])).between(13, 19))
    card = tag(card, 2, lambda t: luhn(digits(t)))
    phone = F.filter(_guarded(text, _PHONE, has("+")), lambda x: F.length(digits(x["t"])).between(9, 15))
    phone = tag(phone, 3, True)
    spelt = tag(_guarded(text, _EMAIL_SPELT, bracket), 0, False)
    defanged = tag(_guarded(text, _IP_DEFANGED, has("[.]") | has("(.)") | has("[dot]")), 1, False)
    local = tag(_guarded(text, _PHONE_LOCAL, text.rlike(r"[0-9]{3}[-. ][0-9]{4}")), 3, False)
    secret = F.filter(_guarded(text, _SECRET, text.rlike(r"[A-Za-z0-9+/_-]{20}")), lambda x: F.length(x["t"]) <= LONGEST_SECRET)
    return F.concat(email, ip, card, phone, spelt, defanged, local, tag(secret, 4, False))


def plainly(t: Column) -> Column:
    """A written-out or defanged address with its signs; other spaces stay."""
    signs = F.regexp_replace(t, r"\x20?[\[(]at[\])]\x20?", "@")
    return F.regexp_replace(signs, r"\x20?[\[(](?:dot|\.)[\])]\x20?", ".")


def _votes(x: Column) -> Column:
    """A span with the votes of the labelers: 1 for, -1 against, 0 none."""
    kind, t = x["kind"], x["t"]
    pick = lambda *cases: F.when(kind == 0, cases[0]).when(kind == 1, cases[1]).when(kind == 2, cases[2]).when(kind == 3, cases[3]).otherwise(cases[4])
    number = digits(t)
    strict = pick(
        F.when(x["base"], t.rlike(r"\.[A-Za-z]{2,}$")).otherwise(plainly(t).rlike(_EMAIL_STRICT)),
        x["base"] | plainly(t).rlike(_IP_VALID),
        x["base"] | t.rlike(_CARD_STRICT),
        x["base"] | t.rlike(r"^(\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}([-. ])[0-9]{3}\2[0-9]{4})$"),
        t.rlike(HEX_KEY) | t.rlike(ISSUED_KEY),
    )
    words = t.rlike(r"[A-Za-z]{9,}|^[0-9-]+$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    known = pick(t.rlike(MAIL), ~t.rlike(PRIVATE), number.rlike(ISSUERS), F.when(x["base"], F.length(number) >= 10).otherwise(t.rlike(AREA)), t.rlike(ISSUED_KEY))
    unlike = pick(F.lit(False), t.rlike(PRIVATE), ~number.rlike(ISSUERS), F.when(x["base"], F.lit(False)).otherwise(~t.rlike(AREA)), words)

    def context(b: Column) -> Column:
        plain = F.when(b.rlike(AGAINST), -1).when(b.rlike(FOR), 1).otherwise(0)
        secret = F.when(b.rlike(AGAINST_SECRET), -1).when(b.rlike(FOR_SECRET), 1).otherwise(0)
        return F.when(kind == 4, secret).otherwise(plain)

    return F.struct(
        kind.alias("kind"),
        x["base"].alias("base"),
        x["s"].alias("s"),
        x["e"].alias("e"),
        F.when(strict, 1).otherwise(-1).alias("regex"),
        F.when(known, 1).when(unlike, -1).otherwise(0).alias("gazetteer"),
        context(x["c"]).alias("context"),
        F.least(F.length(number), F.lit(20)).alias("n_digits"),
    )


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``, each with its kind, place, votes and whether it is a base one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(text).alias("text"))
    may = F.col("text").rlike(r"[@0-9]") | F.contains("text", F.lit("(at)")) | F.contains("text", F.lit("[at]"))
    voted = bind(_spans(F.col("text")), lambda found: F.transform(found, _votes))
    return rows.select("doc_id", F.when(may, voted).alias("spans"))  # NULL: none


def vote_patterns(found: DataFrame) -> DataFrame:
    """How often each combination of kind, votes and digits occurs. The number of rows is
    bounded by the number of combinations."""
    flat = found.select(F.explode("spans").alias("x")).select("x.kind", "x.base", *[f"x.{n}" for n in LABELERS], "x.n_digits")
    return flat.groupBy("kind", "base", *LABELERS, "n_digits").agg(F.count(F.lit(1)).alias("n"))


@dataclass
class Reliability:
    """Per kind: share of personal data among candidates, and per labeler the chance of its votes -1, 0, 1 for
    personal data and for the rest."""

    prior: dict[int, float]
    votes: dict[tuple[int, str, int], tuple[float, float]]

    def chance(self, row) -> float:
        """That spans with this pattern of votes are personal data."""
        odds = math.log(self.prior[row["kind"]] / (1 - self.prior[row["kind"]]))
        for name in LABELERS:
            yes, no = self.votes[row["kind"], name, row[name]]
            odds += math.log(yes / no)
        return 1 / (1 + math.exp(-odds))

    def label(self, row) -> float:
        """The same for candidates; base spans are personal data whatever their votes."""
        return 1.0 if row["base"] else self.chance(row)


def estimate(patterns: list[Row], rounds: int = ROUNDS) -> Reliability:
    """Expectation maximisation for labelers that vote independently given the truth. It
    reads the counts of vote patterns and starts from the majority; base spans are known."""
    votes = {(k, n, v): {-1: (0.15, 0.7), 0: (0.3, 0.3), 1: (0.7, 0.15)}[v] for k in range(len(EVERY)) for n in LABELERS for v in (-1, 0, 1)}
    model = Reliability({k: 0.5 for k in range(len(EVERY))}, votes)
    for _ in range(rounds):
        yes, no, open_yes, open_no = Counter(), Counter(), Counter(), Counter()
        for row in patterns:
            p, k = model.label(row), row["kind"]
            for key in [k, *[(k, name, row[name]) for name in LABELERS]]:
                yes[key] += row["n"] * p
                no[key] += row["n"] * (1 - p)
            if not row["base"]:
                open_yes[k] += row["n"] * p
                open_no[k] += row["n"] * (1 - p)
        prior = {k: (open_yes[k] + 1) / (open_yes[k] + open_no[k] + 2) for k in model.prior}
        votes = {key: ((yes[key] + 1) / (yes[key[0]] + 3), (no[key] + 1) / (no[key[0]] + 3)) for key in model.votes}
        # A vote for is at least twice as likely for personal data, and a vote against ten times for
        # the rest, as labelers speak against for a stated reason; else nothing tells the classes
        # apart where a labeler gives all spans the same vote.
        for k, name, v in model.votes:
            if v == 1 and (spare := votes[k, name, 1][1] - votes[k, name, 1][0] / 2) > 0:
                rest = votes[k, name, -1][1] + votes[k, name, 0][1]
                for w in (-1, 0, 1):
                    y, x = votes[k, name, w]
                    votes[k, name, w] = (y, x - spare if w == 1 else x * (1 + spare / rest))
            if v == -1 and (spare := votes[k, name, -1][0] - votes[k, name, -1][1] / 10) > 0:
                rest = votes[k, name, 1][0] + votes[k, name, 0][0]
                for w in (-1, 0, 1):
                    y, x = votes[k, name, w]
                    votes[k, name, w] = (y - spare if w == -1 else y * (1 + spare / rest), x)
        moved = max(abs(prior[k] - model.prior[k]) for k in prior)
        model = Reliability(prior, votes)
        if moved < 1e-5:
            break
    return model


def _features() -> dict[str, Column]:
    out = {}
    for k in range(len(EVERY)):
        for name in LABELERS:
            out[f"{k}_{name}"] = F.when(F.col("kind") == k, F.col(name)).otherwise(0).cast("double")
        out[f"{k}_kind"] = (F.col("kind") == k).cast("double")
    out["card_16"] = ((F.col("kind") == 2) & (F.col("n_digits") == 16)).cast("double")
    out["phone_10"] = ((F.col("kind") == 3) & F.col("n_digits").isin(10, 11)).cast("double")
    return out


def train(spark: SparkSession, patterns: list[Row], reliability: Reliability) -> dict[str, float] | None:
    """Factors of the span classifier (and ``""``, its intercept), fitted to the likelihoods."""
    if not patterns:
        return None
    rows = []
    for row in patterns:
        p, own = reliability.label(row), {name: row[name] for name in ("kind", *LABELERS, "n_digits")}
        rows += [own | {"label": 1.0, "w": row["n"] * p}, own | {"label": 0.0, "w": row["n"] * (1 - p)}]
    columns = ", ".join(f"{name}: int" for name in ("kind", *LABELERS, "n_digits"))
    named = _features()
    # As one literal, the few rows need no Python on the executors.
    listed_rows = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{columns}, label: double, w: double>>")
    table = spark.range(1).select(F.inline(listed_rows)).select(*[c.alias(n) for n, c in named.items()], "label", "w")
    table = VectorAssembler(inputCols=list(named), outputCol="features").transform(table)
    model = LogisticRegression(weightCol="w", maxIter=60, regParam=1e-3).fit(table)
    return dict(zip(named, map(float, model.coefficients), strict=True)) | {"": float(model.intercept)}


def _sure(x: Column, factors: dict[str, float], sure: float) -> Column:
    """Whether the classifier gives a span at least the chance ``sure``."""
    total = F.lit(factors[""])
    for k in range(len(EVERY)):
        own = F.lit(factors[f"{k}_kind"])
        for name in LABELERS:
            own = own + factors[f"{k}_{name}"] * x[name]
        total = total + F.when(x["kind"] == k, own).otherwise(0.0)
    total = total + F.when((x["kind"] == 2) & (x["n_digits"] == 16), factors["card_16"]).otherwise(0.0)
    total = total + F.when((x["kind"] == 3) & x["n_digits"].isin(10, 11), factors["phone_10"]).otherwise(0.0)
    return 1 / (1 + F.exp(-total)) >= sure


def detect(docs: DataFrame, sure: float = SURE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id`` and ``found``, an array of ``kind, s, e, base`` in order of kind and
    place."""
    voted = write_stage(spans(docs, doc_id, text), "spans")
    patterns = vote_patterns(voted).collect()  # bounded by the number of combinations
    factors = train(docs.sparkSession, patterns, estimate(patterns))
    none = F.array().cast(voted.schema["spans"].dataType)
    every = F.coalesce(F.col("spans"), none)
    base = F.filter(every, lambda x: x["base"])
    added = none
    if factors is not None:
        added = apart_from(base, F.filter(every, lambda x: ~x["base"] & _sure(x, factors, sure)))
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"))
    return voted.select("doc_id", F.sort_array(F.transform(F.concat(base, added), slim)).alias("found"))


def listed(spans_: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in EVERY])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _is(kind: int):
    return lambda x: x["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, counts and checksum of the base spans, all spans as text, and the numbers of
    secrets and of all spans."""
    base = F.filter("found", lambda x: x["base"])
    counts = [F.size(F.filter(base, _is(k))).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    more = [F.size(F.filter("found", _is(4))).cast("bigint").alias("n_secret"), F.size("found").cast("bigint").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), *more)
