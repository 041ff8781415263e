"""Personal data by weak supervision.

Candidate spans come from the base patterns and from further forms. Four labelers vote on each
(yes, no, abstain): a strict form or checksum, a gazetteer of codes and ranges, the words before it, and
what touches it (a key's equals sign is no edge). Expectation-maximisation over the counts of vote patterns (a bounded table: kinds times
3 ** 4 patterns) estimates how far each labeler can be trusted and how likely each pattern is personal
data. Those likelihoods train the final span classifier, a naive Bayes model over the votes, the length and
the neighbouring characters, by one grouped sum. Base spans always stay; the others stay where the
classifier says so. The model has a few hundred weights and travels as a literal, so scanning is row by
row without a shuffle.

Everything is DataFrame or SQL; the driver sees the bounded table of patterns and weights only. Null or
empty text has no spans; repeated rows give repeated rows; a null ``doc_id`` stays null. Only ``doc_id``
and ``text`` are read; an empty table trains a model that accepts no further span.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm.spans import PIECE, around, bound, by_kind, matches, pieces, quoted, written

BASE = ["email", "ip", "card", "phone"]
MORE = ["local", "ssn", "iban"]
KINDS = BASE + MORE
# A run of local or digit characters fails at all of its places or at none, so it is tried once, at its start or where the
# last match ended; possessive repeats match the same text without a stack frame per repeat.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL = r"(?<![0-9+.-])\(?[2-9][0-9]{2}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
BYTE = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Country calling codes and countries with IBANs.
CALLING = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9])"
IBAN_COUNTRIES = r"^(AD|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK)"
#: Words before a span, in the four languages, that speak for or against it.
FOR = r"(?i)(mail|contact|kontakt|contacto|reach|tel|phone|call|fax|mobil|cell|anruf|appel|llam|card|karte|carte|tarjeta|visa|credit|kredit|iban|account|konto|compte|cuenta|ssn|social security|\bip\b|host|server|serveur|servidor|address|adresse|direcci)[^\n]{0,24}$"
AGAINST = r"(?i)(version|release|isbn|issn|order|invoice|serial|model|build|figure|page|chapter|section|rfc|doi)[\x20:#.]{0,4}$"

_DIGITS = "regexp_replace(s.found, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, char_length({_DIGITS})), 0, (a, i) -> a +
    CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS int)
         ELSE CAST(substr('0246813579', CAST(substr(reverse({_DIGITS}), i, 1) AS int) + 1, 1) AS int) END) % 10 = 0"""
_MOD97 = r"""aggregate(transform(split(concat(substr(s.found, 5), substr(s.found, 1, 4)), '(?!^)(?!$)'),
    c -> if(c rlike '[0-9]', CAST(c AS int), ascii(c) - 55)), 0, (a, d) -> (a * if(d > 9, 100, 10) + d) % 97) = 1"""


def base_spans(text: str) -> str:
    return f"""concat(
      {matches(text, EMAIL, 'email', f"contains({text}, '@')")},
      {matches(text, IP, 'ip', f"{text} rlike {quoted('[0-9][.][0-9]+[.][0-9]+[.][0-9]')}", f"s.found rlike {quoted(f'^{BYTE}([.]{BYTE}){{3}}$')}")},
      {matches(text, CARD, 'card', f"{text} rlike {quoted(r'[0-9]([ -]?[0-9]){12}')}", f"char_length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}")},
      {matches(text, PHONE, 'phone', f"{text} rlike {quoted('[+][0-9]')}", f"char_length({_DIGITS}) BETWEEN 9 AND 15")})"""


def more_spans(text: str) -> str:
    return f"""concat(
      {matches(text, LOCAL, 'local', f"{text} rlike {quoted('[0-9]{3}-[0-9]{4}')}")},
      {matches(text, SSN, 'ssn', f"{text} rlike {quoted('[0-9]-[0-9]{2}-[0-9]')}")},
      {matches(text, IBAN, 'iban', f"{text} rlike {quoted('[A-Z]{2}[0-9]{2}[A-Z0-9]{11}')}")})"""


#: Votes of the four labelers on a span ``s`` with the text ``s.left`` before and the character ``s.right`` after it.
VOTES = (
    rf"""CASE s.kind
      WHEN 'email' THEN if(s.found rlike '\\.[A-Za-z]{{2,}}$' AND NOT contains(s.found, '..'), 1, -1)
      WHEN 'ip' THEN if(s.found rlike '(^|[.])0[0-9]', -1, 1)
      WHEN 'card' THEN if(char_length({_DIGITS}) IN (15, 16), 1, 0)
      WHEN 'phone' THEN if(char_length({_DIGITS}) BETWEEN 10 AND 13, 1, 0)
      WHEN 'ssn' THEN if(s.found rlike '^(000|666|9)|-00-|-0000$', -1, 0)
      WHEN 'iban' THEN if({_MOD97}, 1, -1)
      ELSE 0 END""",
    rf"""CASE s.kind
      WHEN 'email' THEN if(s.found rlike {quoted(r'(?i)\.(com|org|net|edu|gov|io|info|de|fr|es|uk|eu|at|ch|it|nl)$')}, 1, 0)
      WHEN 'ip' THEN if(s.found rlike {quoted(r'^(0|10|127|192\.168|169\.254|255)\.')}, -1, 1)
      WHEN 'card' THEN if({_DIGITS} rlike '^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)', 1, -1)
      WHEN 'phone' THEN if(s.found rlike {quoted(CALLING)}, 1, -1)
      WHEN 'iban' THEN if(s.found rlike {quoted(IBAN_COUNTRIES)}, 1, -1)
      ELSE 0 END""",
    rf"CASE WHEN s.left rlike {quoted(FOR)} THEN 1 WHEN s.left rlike {quoted(AGAINST)} THEN -1 ELSE 0 END",
    r"if(s.left rlike '[A-Za-z0-9_/#]$' OR s.right rlike '^[A-Za-z0-9_/=]', -1, 1)",
)
#: Features of the final classifier.
FEATURES = f"""array(concat('kind=', s.kind),
    concat('form=', s.kind, {VOTES[0]}), concat('list=', s.kind, {VOTES[1]}), concat('words=', {VOTES[2]}), concat('edge=', {VOTES[3]}),
    concat('length=', s.kind, least(9, char_length(s.found) DIV 4)),
    concat('right=', CASE WHEN s.right = '' THEN 'end' WHEN s.right rlike '[0-9]' THEN '0' WHEN s.right rlike '[A-Za-z]' THEN 'a' WHEN s.right = ' ' THEN ' ' ELSE '.' END))"""


APART = "NOT exists({}, b -> b.start < w.end AND w.start < b.end)"


def _candidates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (never null), spans ``base`` and ``more`` (not over a base span)."""
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"base": F.expr(base_spans("text")), "more": F.expr(more_spans("text"))})
    return found.withColumn("more", F.expr(f"if(size(more) = 0 OR size(base) = 0, more, filter(more, w -> {APART.format('base')}))"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 40) -> tuple[dict[str, float], list[float]]:
    """Share of personal data per kind and accuracy per labeler, from (kind, votes, count) by EM.

    Accuracies have a prior of 8 right in 10, shares one of 1 in 2, so unseen kinds and labelers stay defined.
    """
    share = {k: 0.5 for k in KINDS}
    right = [0.8] * len(VOTES)
    for _ in range(rounds):
        yes, seen = {k: 1.0 for k in KINDS}, {k: 2.0 for k in KINDS}
        good, voted = [8.0] * len(VOTES), [10.0] * len(VOTES)
        for kind, votes, n in patterns:
            p = posterior(kind, votes, share, right)
            yes[kind] += n * p
            seen[kind] += n
            for j, v in enumerate(votes):
                if v:
                    good[j] += n * (p if v > 0 else 1 - p)
                    voted[j] += n
        share = {k: yes[k] / seen[k] for k in KINDS}
        right = [min(0.99, max(0.5, g / v)) for g, v in zip(good, voted)]
    return share, right


def posterior(kind: str, votes: tuple[int, ...], share: dict[str, float], right: list[float]) -> float:
    odds = math.log(share[kind] / (1 - share[kind]))
    for v, r in zip(votes, right):
        odds += v * math.log(r / (1 - r))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def train(docs: DataFrame) -> dict[str, float]:
    """Weights of the final classifier, by feature; ``''`` is the constant. All spans of all rows count."""
    votes = [f"{v} AS v{j}" for j, v in enumerate(VOTES)]
    spans = _candidates(docs).selectExpr(f"explode({around('concat(base, more)', 'text')}) AS s").selectExpr("s.kind AS kind", *votes, f"{FEATURES} AS f")
    names = [f"v{j}" for j in range(len(VOTES))]
    # Features follow from kind, votes, length and edge: a bounded table holds all that EM and the classifier need.
    table = [(r["kind"], tuple(r[n] for n in names), r["f"], r["n"]) for r in spans.groupBy("kind", *names, "f").agg(F.count("*").alias("n")).collect()]
    share, right = estimate([(k, v, n) for k, v, _, n in table])
    yes: dict[str, float] = {}
    no: dict[str, float] = {}
    total_yes = total_no = 1.0
    for kind, v, features, n in table:
        p = posterior(kind, v, share, right)
        total_yes, total_no = total_yes + n * p, total_no + n * (1 - p)
        for f in features:
            yes[f], no[f] = yes.get(f, 0.0) + n * p, no.get(f, 0.0) + n * (1 - p)
    weights = {f: math.log((yes[f] + 0.5) / (total_yes + 1)) - math.log((no[f] + 0.5) / (total_no + 1)) for f in yes}
    return {"": math.log(total_yes / total_no), **weights}


def _accepted(more: str, text: str, weights: dict[str, float]) -> str:
    """Those of the further spans that the classifier takes for personal data."""
    model = "map(" + ", ".join(f"{quoted(f)}, {x!r}D" for f, x in sorted(weights.items())) + ")"
    score = f"aggregate({FEATURES}, {weights.get('', 0.0)!r}D, (a, f) -> a + coalesce(element_at({model}, f), 0D))"
    kept = f"filter({around(more, text)}, s -> {score} > 0)"
    return f"if(size({more}) = 0, {more}, transform({kept}, s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end, 'found', s.found)))"


def spans_of(text: str, weights: dict[str, float]) -> str:
    """SQL for all spans of a text column that may be null; row by row, for use beside other columns."""
    whole = f"coalesce({text}, '')"
    return f"concat({base_spans(whole)}, {_accepted(more_spans(whole), whole, weights)})"


def pii_spans(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``text``, spans ``base`` and ``added`` (kind, start, end, found)."""
    w = train(docs) if weights is None else weights
    return _candidates(docs).withColumn("added", F.expr(_accepted("more", "text", w))).select("doc_id", "text", "base", "added")


def pii_digest(docs: DataFrame) -> DataFrame:
    return pii_spans(docs).selectExpr(
        "doc_id",
        *[f"CAST(size(filter(base, s -> s.kind = '{k}')) AS bigint) AS n_{k}" for k in BASE],
        f"sha2({written(by_kind('base', KINDS))}, 256) AS base_sha256",
        f"{written(by_kind('concat(base, added)', KINDS))} AS spans",
    )


def redacted(text: str, spans: str) -> str:
    """SQL for ``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    ordered = f"array_sort(transform({spans}, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    between = f"substr(array_join(slice(p, CAST(acc.at DIV {PIECE} + 1 AS int), CAST(s.start DIV {PIECE} - acc.at DIV {PIECE} + 1 AS int)), ''), CAST(acc.at % {PIECE} + 1 AS int), CAST(s.start - acc.at AS int))"
    rest = f"substr(array_join(slice(p, CAST(acc.at DIV {PIECE} + 1 AS int), size(p)), ''), CAST(acc.at % {PIECE} + 1 AS int))"
    return f"""if(size({spans}) = 0, {text}, {bound(pieces(text), 'p')} -> aggregate({ordered}, named_struct('at', 0L, 'out', ''),
      (acc, s) -> if(s.start < acc.at,
        named_struct('at', greatest(acc.at, s.end), 'out', acc.out),
        named_struct('at', s.end, 'out', concat(acc.out, {between}, '[', upper(s.kind), ']'))),
      acc -> concat(acc.out, {rest})))[0])"""
