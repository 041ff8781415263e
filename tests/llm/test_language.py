"""Language identification against a plain version in loops, and in parts."""

import collections
import math
import random
import re

import numpy as np

from shelfscan.llm import language


def rows_of(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def tongues(seed, n, names, odd=()):
    r = random.Random(seed)
    letters = {name: r.sample("abcdefghijklmnopqrstuvwxyz", 7) for name in names}
    rows = []
    for i in range(n):
        lang = names[i % len(names)]
        words = r.choice([1, 2, 12, 30])
        text = " ".join("".join(r.choice(letters[lang]) for _ in range(5)) for _ in range(words))
        rows.append((i, text, r.choice([lang, lang, lang.upper() + "-XX", r.choice(names), None]), f"host{r.randrange(9)}", r.choice(["a", "b", None])))
    return rows + [(n + i, *row) for i, row in enumerate(odd)]


def plain_language(rows):
    """The fusion in loops: sums of logs over dictionaries, no buckets table, every language weighed."""
    def grams(text):
        return [int(x) for x in language._trigrams(np.frombuffer((text or "").encode(), np.uint8)) if x < language.BUCKETS]

    def said(d):
        m = None if d is None else re.fullmatch(r"([A-Za-z][A-Za-z0-9]{1,7})(?:[-_].*)?", d.strip(" "))
        return None if d is None else m[1].lower() if m else ""

    counted = {}
    for _, text, d, _, _ in rows:
        if said(d) and said(d) != "und" and text is not None:
            counted.setdefault(said(d), collections.Counter()).update(grams(text))
    names = [*sorted(counted), "und"]
    floor = -math.log(language.BUCKETS) - language.UNKNOWN

    def text_scores(text):
        if not re.search("[A-Za-z0-9]|[^\x00-\x7f]", text or ""):
            return None
        out = []
        for name in names[:-1]:
            c, total = counted[name], sum(counted[name].values()) + 0.05 * language.BUCKETS
            out.append(sum(max(floor, math.log((c[g] + 0.05) / total)) for g in grams(text)))
        out.append(len(grams(text)) * -math.log(language.BUCKETS))
        return [max(-700.0, language.TEMPER * (x - max(out))) for x in out]

    scores = [text_scores(r[1]) for r in rows]
    shares = [None if s is None else [math.exp(x) / sum(map(math.exp, s)) for x in s] for s in scores]

    def table(of):
        out = {}
        for r, w in zip(rows, shares):
            if w is not None:
                got = out.setdefault(of(r), [0.0] * len(names))
                for j, x in enumerate(w):
                    got[j] += x
        return out

    whole = table(lambda r: 0).get(0, [0.0] * len(names))
    base = [(x + 1) / (sum(whole) + len(names)) for x in whole]
    smooth = lambda c, p: [(x + language.SMOOTHING * q) / (sum(c) + language.SMOOTHING) for x, q in zip(c, p)]
    suffixes = {k: smooth(c, base) for k, c in table(lambda r: r[4]).items()}
    hosts = {k: smooth(c, suffixes[k[1]]) for k, c in table(lambda r: (r[3], r[4])).items()}
    goes = table(lambda r: said(r[2]))
    out = {}
    for r, s in zip(rows, scores):
        if s is None:
            out[r[0]] = ("und", 1.0)
            continue
        logs = [s[j] + math.log(hosts[r[3], r[4]][j]) + math.log((goes[said(r[2])][j] + language.UNSEEN) / (whole[j] + language.UNSEEN * (len(names) + 1))) for j in range(len(names))]
        out[r[0]] = (names[logs.index(max(logs))], 1 / sum(math.exp(x - max(logs)) for x in logs))
    return out


ODD = [("", "aa", "host0", "a"), (None, "bb", None, None), ("?! .", "a b", "host1", "a"), ("zzz", "und", "host1", "a"), ("zzz", "3x", "host2", "b"), ("漢字漢字", "", "host2", None)]
SAYS = "key long, text string, declared string, host string, suffix string"


def close_to_plain(got, rows):
    right = plain_language(rows)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in right.items()}
    assert all(abs(got[k][1] - right[k][1]) < 1e-4 for k in right)


def test_language_equals_plain_version(spark, monkeypatch):
    """Every posterior, in one part and in several."""
    names = [f"{a}{b}" for a in "abcd" for b in "xy"]
    rows = tongues(4, 240, names, ODD)
    table = spark.createDataFrame(rows, SAYS).repartition(3)
    close_to_plain(rows_of(language.identify(table), "key", "language", "probability"), rows)
    monkeypatch.setattr(language, "PART", 600)
    close_to_plain(rows_of(language.identify(table), "key", "language", "probability"), rows)


def test_language_parts_keep_repeated_rows(spark, monkeypatch):
    rows = tongues(5, 40, ["aa", "bb", "cc"], ODD)
    monkeypatch.setattr(language, "PART", 100)
    out = language.identify(spark.createDataFrame(rows + rows + rows[:1] + [(None, *r[1:]) for r in rows[:2]], SAYS))
    counts = collections.Counter(r.key for r in out.collect())
    assert counts[0] == 3 and all(counts[r[0]] == 2 for r in rows[1:]) and counts[None] == 2


def test_language_with_few_carried(spark, monkeypatch):
    """Rows carry three of thirty languages, the declared one and the host's commonest; the answer stays."""
    monkeypatch.setattr(language, "BEST", 3)
    names = [f"{a}{b}" for a in "abcdef" for b in "vwxyz"]
    rows = [r for r in tongues(6, 900, names) if len(r[1]) > 60]
    got = rows_of(language.identify(spark.createDataFrame(rows, SAYS).repartition(2)), "key", "language")
    right = plain_language(rows)
    assert sum(got[k][0] == right[k][0] for k in right) / len(right) > 0.99


def test_pages_decode_references_and_survive_unclosed_scripts(spark):
    pages = [(1, "http://h.fr/", "<p>caf&eacute; d&eacute;j&agrave;<!-- the of and --></p>"), (2, "http://h.fr/", "<p>x</p>" + "<script>" * 20000)]
    got = rows_of(language.of_pages(spark.createDataFrame(pages, "page_id long, url string, html string")), "key", "text")
    assert got == {1: ("café déjà",), 2: ("x",)}
