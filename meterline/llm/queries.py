"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.llm import collocations, exact_dedup, filter_audit, html_text, language_id, mixing, packing, preference, quality_rules, simhash, substring_dedup, toxicity, url_filter
from meterline.llm.common import saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


WORDS_SQL = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


@query(
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
h AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS x FROM win),
rep AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS n FROM h) WHERE n > 1),
cov AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM rep GROUP BY r),
m AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        length(regexp_replace(t, '\P{{L}}+', '', 'g'))::BIGINT AS n_letters,
        length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_upper
      FROM d LEFT JOIN cov USING (r)),
n AS (SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines FROM m),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words THEN 4 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
        + CASE WHEN 2 * n_upper > n_letters THEN 32 ELSE 0 END + CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM n)
SELECT doc_id, n_words, n_repeat_words, word_chars, n_symbols, n_dup_lines, n_lines, n_letters, n_upper, failed_bits,
       failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""
)
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = saved(quality_rules.ledger(table(spark, sf_dir, "documents")), "quality_ledger")
    return quality_rules.apply_policy(rows, quality_rules.POLICIES[-1])


def _ablations_sql() -> str:
    one = lambda p, r: f"""SELECT '{p.version}' AS policy, '{r}' AS rule, count(*) FILTER (WHERE failed_bits & {1 << quality_rules.RULES.index(r)} <> 0)::BIGINT AS n_failed,
  count(*) FILTER (WHERE failed_bits & {p.mask} = {1 << quality_rules.RULES.index(r)})::BIGINT AS n_recovered FROM led"""  # noqa: E731
    parts = " UNION ALL ".join(one(p, r) for p in quality_rules.POLICIES for r in p.rules)
    return f"WITH led AS ({SQL['op1_quality_rules']}) {parts}"


@query(_ablations_sql())
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version costs, from one stored ledger."""
    rows = saved(quality_rules.ledger(table(spark, sf_dir, "documents")).select("failed_bits"), "quality_ledger")
    found = [quality_rules.ablations(rows, p) for p in quality_rules.POLICIES]
    return reduce(DataFrame.unionByName, found)


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


@query(
    rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM s),
w AS (SELECT *, [5, 2, 1][(source_no - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM o),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
a AS (SELECT source, source_no, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM v),
z AS (SELECT *, sum(round(target)::HUGEINT) OVER (ORDER BY source_no) AS upto, sum(round(target)::HUGEINT) OVER () AS total FROM a WHERE round(target) > 0),
e AS (SELECT source_no, (upto - round(target)::HUGEINT) * 2147483648 // total AS lo, upto * 2147483648 // total AS hi FROM z),
t AS (SELECT (i % 2147483648 * 1327217885) % 2147483648 AS point FROM (SELECT unnest(range(greatest(1, (coalesce(sum(size), 0)::BIGINT + 8) // 16))) AS i FROM d)),
n AS (SELECT source_no, greatest(1, count(point)) * 16 AS words FROM e LEFT JOIN t ON point >= lo AND point < hi GROUP BY source_no),
b AS (SELECT a.*, coalesce(words, 0) AS words FROM a LEFT JOIN n USING (source_no)),
c AS (SELECT d.*, b.source_size, b.target, b.words, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, (SELECT sum(greatest(0, least(size, words - start - k * source_size))) FROM unnest([0, 1, 2]) AS e(k))::BIGINT AS taken FROM c
"""
)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def word_bpe() -> str:
    """Path of the public tokenizer of the packing query; the file is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_bpe())


@query(
    """
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
"""
)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


#: Rules of the URL query, as its contract gives them.
URL_RULES = tuple(url_filter.Rule(v, *r.split("/", 1)) for v, r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")))
URL_RULES = tuple(url_filter.Rule(r.verdict, r.host, "/" + r.path) for r in URL_RULES)


def _url_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r.text))
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    hit = lambda w: f"regexp_matches(u, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')::INT"
    return f"""
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT *, {" + ".join(map(hit, url_filter.STRICT))} AS n_strict, {" + ".join(map(hit, url_filter.SOFT))} AS n_soft,
    CASE {" ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in rules)} END AS rule,
    CASE {" ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in rules)} END AS ruled FROM p)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict,
    n_strict::BIGINT AS n_strict, n_soft::BIGINT AS n_soft FROM h"""


@query(_url_sql())
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return seen.select("page_id", "host", "path", "rule", "verdict", F.size("strict_hits").cast("long").alias("n_strict"), F.size("soft_hits").cast("long").alias("n_soft"))


@query(
    """
WITH o AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS u FROM conversations),
t AS (SELECT conv_id, u, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id, u ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS pos FROM o),
l AS (SELECT conv_id, max(pos) AS last, arg_max(text, pos) AS answer FROM t WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT t.*, CASE WHEN pos = l.last AND o.answer IS NOT NULL THEN o.answer ELSE text END AS other
      FROM t LEFT JOIN l ON t.conv_id = l.conv_id LEFT JOIN l AS o ON xor(o.conv_id, 1) = t.conv_id),
n AS (SELECT conv_id, u, coalesce(min(pos) FILTER (WHERE text <> other) - 1, count(*)) AS n FROM b GROUP BY conv_id, u),
x AS (SELECT b.*, n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS a, '<|' || role || '|>' || chr(10) || other || '<|end|>' || chr(10) AS r
      FROM b JOIN n ON b.conv_id IS NOT DISTINCT FROM n.conv_id AND b.u IS NOT DISTINCT FROM n.u),
y AS (SELECT *, coalesce(sum(CASE WHEN pos > n THEN length(a) END) OVER w, 0) AS ca, coalesce(sum(CASE WHEN pos > n THEN length(r) END) OVER w, 0) AS cr
      FROM x WINDOW w AS (PARTITION BY conv_id, u ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, n::INTEGER AS n_prompt_turns, coalesce(string_agg(a, '' ORDER BY pos) FILTER (WHERE pos <= n), '') AS prompt,
  coalesce(string_agg(a, '' ORDER BY pos) FILTER (WHERE pos > n), '') AS chosen_completion,
  coalesce(string_agg((ca + length(role) + 5)::BIGINT || ':' || (length(text) + 7), ',' ORDER BY pos) FILTER (WHERE pos > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(r, '' ORDER BY pos) FILTER (WHERE pos > n), '') AS rejected_completion,
  coalesce(string_agg((cr + length(role) + 5)::BIGINT || ':' || (length(other) + 7), ',' ORDER BY pos) FILTER (WHERE pos > n AND role = 'assistant'), '') AS rejected_spans
FROM y GROUP BY conv_id, u, n
"""
)
def op9_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.swapped_pairs(table(spark, sf_dir, "conversations")))


@query()
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


@query(
    rf"""
WITH m AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {WORDS_SQL} AS w,
    doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again FROM documents),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS s, CASE WHEN again THEN 1 ELSE 0 END AS e,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM m LEFT JOIN g USING (doc_id)),
k AS (SELECT part, map {{'A': a, 'B': b, 'C': c, 'D': s, 'E': e}} AS f, good, toxic, count(*) AS n FROM d GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [p.x, q.x, r.x, u.x, v.x] AS o FROM l p, l q, l r, l u, l v WHERE len(list_distinct([p.x, q.x, r.x, u.x, v.x])) = 5),
z AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM o),
j AS (SELECT k.*, o, step, f[o[step]] AS here, list_sum(list_transform(o[1:step-1], lambda y: f[y])) AS prior, list_sum(map_values(f)) AS total FROM k, z),
r AS (SELECT part, o, step, sum(CASE WHEN coalesce(prior, 0) = 0 AND here = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN coalesce(prior, 0) = 0 AND here = 1 THEN n ELSE 0 END) AS removed, sum(CASE WHEN prior > 0 AND here = 1 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN here = 1 AND total = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN coalesce(prior, 0) = 0 AND here = 1 THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN coalesce(prior, 0) = 0 AND here = 1 THEN n * toxic ELSE 0 END) AS toxic_lost FROM j GROUP BY part, o, step)
SELECT part, array_to_string(o, '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
    unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley FROM r
"""
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, w[i:i+k-1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k))),
c AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY lang, k, g),
f AS (SELECT * FROM c WHERE a >= 100),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
x AS (SELECT f.lang, f.g, f.k, f.a, n, unnest(range(1, f.k)) AS cut FROM f JOIN n USING (lang) WHERE k > 1),
s AS (SELECT x.*, lf.a AS l, rf.a AS r, (1000::HUGEINT * x.a * n // (lf.a::HUGEINT * rf.a))::BIGINT AS score
  FROM x JOIN f AS lf ON lf.lang = x.lang AND lf.g = x.g[:cut] JOIN f AS rf ON rf.lang = x.lang AND rf.g = x.g[cut+1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
h AS (SELECT DISTINCT lang, part, a FROM (SELECT lang, a, g[1:k-1] AS part FROM f WHERE k > 2 UNION ALL SELECT lang, a, g[2:k] FROM f WHERE k > 2)),
v AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.lang = b.lang AND h.part = b.g AND h.a >= b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM v) WHERE rank <= 2000
"""
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))
