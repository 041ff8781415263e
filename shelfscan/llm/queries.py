"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfscan.llm import bpe, credentials, decontaminate, divergence, language, licenses, minhash, mixing, neighbours, phrases, pii, substring_dedup, token_counts
from shelfscan.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_digest(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), 50)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_of_tables(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"), least_docs=10, top=10)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), support=100, first=2000)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_substring_dedup, op4_license_scan, op5_mixing, op6_pii, op7_near_duplicates, op8_nearest, op9_decontamination, op10_language, op11_bpe, op12_divergence, op13_collocations)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _budgets(name: str, parent: str, children: str) -> str:
    """Common table expressions ending in ``name`` with its ``budget``; ``children`` has ``weight``, ``capacity`` and ``total``."""
    return f"""
{name}_sums AS (SELECT *, coalesce(sum(capacity) OVER below, 0) AS taken, sum(weight) OVER (PARTITION BY {parent}) - coalesce(sum(weight) OVER below, 0) AS open FROM ({children})
  WINDOW below AS (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_full AS (SELECT *, capacity * open <= (total - taken) * weight AS whole FROM {name}_sums),
{name}_rest AS (SELECT *, total - coalesce(sum(capacity) FILTER (WHERE whole) OVER node, 0) AS rest, sum(weight) FILTER (WHERE NOT whole) OVER node AS sharing FROM {name}_full WINDOW node AS (PARTITION BY {parent})),
{name}_parts AS (SELECT *, CASE WHEN whole THEN capacity ELSE weight * rest // sharing END AS part, CASE WHEN whole THEN -1 ELSE weight * rest % sharing END AS remainder FROM {name}_rest),
{name}_budget AS (SELECT *, part + CASE WHEN NOT whole AND row_number() OVER (PARTITION BY {parent}, whole ORDER BY remainder DESC, weight DESC, md5({name}), {name})
  <= rest - sum(part) FILTER (WHERE NOT whole) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END AS budget FROM {name}_parts),"""


_WEIGHTS = ", ".join(f"('{level}', '{name}', {weight}::HUGEINT)" for level, name, weight in mixing.WEIGHTS)
_NODES = "SELECT {0}, any_value({1}_weight) AS weight, 4 * sum(supply)::HUGEINT AS capacity FROM leaves GROUP BY ALL"

ORACLES = {
    "op5_mixing": rf"""
WITH rows AS (SELECT doc_id, {mixing.DOMAIN} AS domain, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens, md5(coalesce(text, '')) AS body FROM documents),
w(level, name, weight) AS (VALUES {_WEIGHTS}),
leaves AS (SELECT r.*, coalesce(d.weight, {mixing.OTHER}) AS domain_weight, coalesce(l.weight, {mixing.OTHER}) AS lang_weight, coalesce(s.weight, {mixing.OTHER}) AS source_weight
  FROM (SELECT domain, lang, source, sum(tokens)::HUGEINT AS supply FROM rows WHERE tokens > 0 GROUP BY ALL) r
  LEFT JOIN w d ON d.level = 'domain' AND d.name = domain LEFT JOIN w l ON l.level = 'lang' AND l.name = lang LEFT JOIN w s ON s.level = 'source' AND s.name = source),
{_budgets("domain", "root", f"SELECT 1 AS root, *, (SELECT sum(supply)::HUGEINT * 3 // 5 FROM leaves) AS total FROM ({_NODES.format('domain', 'domain')})")}
{_budgets("lang", "domain", f"SELECT n.*, b.budget AS total FROM ({_NODES.format('domain, lang', 'lang')}) n JOIN domain_budget b USING (domain)")}
{_budgets("source", "domain, lang", f"SELECT n.*, b.budget AS total FROM ({_NODES.format('domain, lang, source', 'source')}) n JOIN lang_budget b USING (domain, lang)")}
keyed AS (SELECT r.*, (b.budget // l.supply)::BIGINT AS full_epochs, (b.budget % l.supply)::BIGINT AS prefix
  FROM rows r JOIN leaves l USING (domain, lang, source) JOIN source_budget b USING (domain, lang, source) WHERE tokens > 0),
placed AS (SELECT *, md5('7:' || (full_epochs + 1) || ':' || coalesce(doc_id::VARCHAR, body)) AS place FROM keyed),
run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, tokens, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM placed)
SELECT doc_id, domain, lang, source, tokens, full_epochs, greatest(0, least(tokens, prefix - ahead))::BIGINT AS last_tokens FROM run WHERE full_epochs > 0 OR prefix > ahead""",
    "op3_substring_dedup": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, s, w[s:s + 49] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM words WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS lo FROM grams GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM grams JOIN firsts USING (g) WHERE lo < doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op9_decontamination": f"""
WITH items AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[s:s + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM items WHERE len(w) > 0)),
words AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS k FROM wins),
grams AS (SELECT doc_id, s, k, w[s:s + k - 1] AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM words, sizes WHERE len(w) >= k)),
hits AS (SELECT DISTINCT doc_id, s, k, item_id FROM grams JOIN wins USING (win)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN cover USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op12_divergence": r"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT row, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grps AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT lang, source, term, coalesce(c, 0) AS c FROM grps JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM dense JOIN sizes USING (lang)),
whole AS (SELECT lang, term, sum(c) AS c FROM dense GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 2)) // (sum(c) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q FROM whole JOIN sizes USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10""",
    "op13_collocations": r"""
WITH pieces AS (SELECT row_number() OVER () AS id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, w[s:s + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, range(1, 6) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, p, count(*) AS f FROM grams GROUP BY lang, p HAVING count(*) >= 100),
cand AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1),
inner_ AS (SELECT lang, p[s:s + m - 1] AS p, max(a) AS around FROM (SELECT lang, p, a, m, unnest(range(1, len(p) - m + 2)) AS s FROM cand, range(2, 5) t(m) WHERE len(p) > m) GROUP BY ALL),
left_ AS (SELECT lang, p, a FROM cand LEFT JOIN inner_ USING (lang, p) WHERE around IS NULL OR around < a),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM left_),
scored AS (SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN sizes USING (lang)
  JOIN f x ON x.lang = c.lang AND x.p = c.p[:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase,
a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM worst QUALIFY rank <= 2000""",
}
