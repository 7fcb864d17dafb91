"""One registered query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm import audit, centroids, decontaminate, html, jaccard, language, licenses, packing, planes, rules, secrets, simhash, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A-Z only; lower() would change other letters too.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(coalesce({_LOWER.format('text')}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, w[i:i + least(10, len(w)) - 1] AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM p),
h AS (
  SELECT o.doc_id, o.i, o.size, p.item_id
  FROM (SELECT doc_id, size, i, w[i:i + size - 1] AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)) o
  JOIN p ON p.g = o.g
), hit AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY 1),
it AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("matches")


def _op4_sql() -> str:
    def value(s: str) -> str:
        top, under, scale = rules.SIGNALS[s]
        return f"CASE WHEN {under} > 0 THEN ({top} * {scale}) // {under} ELSE 0 END"

    # Binomial tail as a plain sum; a cutoff counts if it and all milder ones are certified.
    tail = (
        "list_sum([exp(lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * ln(rate) + (good - k) * ln(1 - rate)) FOR k IN range(0, bad + 1)])"
    )
    long_rules = " UNION ALL ".join(f"SELECT doc_id, st, '{s}' AS rule, {value(s)} AS v FROM c" for s in rules.SIGNALS)
    cuts = ", ".join(f"('{s}', {k}, {x})" for s in rules.SIGNALS for k, x in enumerate(rules.CUTOFFS[s]))
    return rf"""
WITH t AS (SELECT doc_id, lang AS st, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, st, text, regexp_extract_all(text, '[^ 	-
]+') AS w FROM t),
win AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (
    SELECT win.doc_id, unnest(range(i, i + 8)) AS k FROM win JOIN (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1) r ON r.doc_id = win.doc_id AND r.g = win.g
  ) GROUP BY 1
), ln AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^ 	-
]') GROUP BY 1
), c0 AS (
  SELECT w.doc_id, st, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(ln.n, 0) AS n_lines, coalesce(ln.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!?;:"''()\[\]{{}}=+/\~^_`@]', '', 'g')) AS n_marks
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN ln USING (doc_id)
), c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c0),
v AS ({long_rules}),
cut(rule, k, x) AS (VALUES {cuts}),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) >= 1),
held AS (SELECT c.doc_id, c.st FROM c SEMI JOIN good ON good.doc_id = c.doc_id WHERE NOT base_failed),
size AS (SELECT st, count(*) AS good FROM held GROUP BY 1),
bad AS (
  SELECT size.st, size.good, cut.rule, cut.k, cut.x, (SELECT count(*) FROM v SEMI JOIN held ON held.doc_id = v.doc_id WHERE v.rule = cut.rule AND v.v > cut.x AND v.st IS NOT DISTINCT FROM size.st) AS bad,
    {rules.TOLERANCE} / {len(rules.SIGNALS)} AS rate, {rules.DELTA} / ((SELECT count(*) FROM size) * {len(rules.SIGNALS)}) AS level
  FROM size, cut
), test AS (SELECT *, {tail} <= level AS ok FROM bad),
best AS (SELECT st, rule, min(x) AS x FROM (SELECT *, min(CAST(ok AS INT)) OVER (PARTITION BY st, rule ORDER BY k) AS all_ok FROM test) WHERE all_ok = 1 GROUP BY 1, 2),
fail AS (SELECT DISTINCT v.doc_id FROM v JOIN best ON best.rule = v.rule AND best.st IS NOT DISTINCT FROM v.st WHERE v.v > best.x)
SELECT c.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND fail.doc_id IS NULL AS kept
FROM c LEFT JOIN fail USING (doc_id)
"""


@query("op4_quality_rules", _op4_sql())
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_from_labels(table(spark, sf_dir, "documents"))


@query("op6_secret_scan")
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_with_weak_labels(table(spark, sf_dir, "documents"))
    hit = F.filter("findings", lambda x: x["secret"])
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_candidates"), F.size(hit).cast("long").alias("n_secrets"),
        F.array_join(F.transform(hit, lambda x: x["value"]), ",").alias("secrets"), F.sha2(F.coalesce("clean", F.lit("")), 256).alias("clean_sha256"),
    )


@query("op7_token_planes")
def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(table(spark, sf_dir, "documents"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (
  SELECT doc_id, string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '[\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]')
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
"""
OP10_SQL = "WITH RECURSIVE " + OP10_SQL.strip()[5:] + """
r AS (SELECT DISTINCT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(seen) AS c FROM r GROUP BY 1) m USING (doc_id)
"""


@query("op10_jaccard_join", OP10_SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS low FROM t),
f AS (
  SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(low < doc_id, false) AS e
  FROM w
), l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels GROUP BY 1),
m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n,
    count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE bad) AS bad
  FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2
), x(k) AS (VALUES (0), (1), (2), (3), (4)),
p AS (
  SELECT [p.k, q.k, r.k, s.k, u.k] AS o FROM x p JOIN x q ON q.k <> p.k JOIN x r ON r.k NOT IN (p.k, q.k)
    JOIN x s ON s.k NOT IN (p.k, q.k, r.k) JOIN x u ON u.k NOT IN (p.k, q.k, r.k, s.k)
), s AS (
  SELECT array_to_string(list_transform(o, lambda k: 'ABCDE'[k + 1]), '') AS filter_order, step, o[step] AS k,
    CAST(coalesce(list_sum(list_transform(o[1:step - 1], lambda k: 1 << k)), 0) AS INT) AS earlier, 1 << o[step] AS bit
  FROM p, (SELECT unnest(range(1, 6)) AS step)
), g AS (
  SELECT m.part, s.filter_order, CAST(s.step AS INT) AS step, s.k,
    coalesce(sum(n) FILTER (WHERE mask & (earlier | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE mask & earlier <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(bad) FILTER (WHERE mask & earlier = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM m, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM g
"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_orders(audit.document_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def _op12_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    best = """SELECT rid, min_by(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT v.rid, c.k, sum((v.q - c.q) * (v.q - c.q)) AS d FROM v JOIN c{0} c ON c.i = v.i GROUP BY 1, 2) GROUP BY 1"""
    steps = ""
    for n in range(rounds):
        steps += f"""a{n} AS MATERIALIZED ({best.format(n)}),
c{n + 1} AS MATERIALIZED (
  SELECT c.k, c.i, coalesce(m.q, c.q) AS q FROM c{n} c LEFT JOIN (
    SELECT a.k, v.i, CAST((sum(v.q) - ((sum(v.q) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS q FROM v JOIN a{n} a ON a.rid = v.rid GROUP BY 1, 2
  ) m ON m.k = c.k AND m.i = c.i
),
"""
    return f"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT rid, i, CAST(floor(256 * e[i]) AS BIGINT) AS q FROM (SELECT rid, e, unnest(range(1, {size + 1})) AS i FROM r)),
c0 AS MATERIALIZED (
  SELECT s.k, v.i, v.q FROM v JOIN (
    SELECT rid, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM r QUALIFY k < {k}
  ) s ON s.rid = v.rid
),
{steps}f AS MATERIALIZED ({best.format(rounds)}),
g AS (SELECT k, CAST(sum(d) AS BIGINT) AS s FROM f GROUP BY 1),
h AS (SELECT k, sha256(string_agg(CAST(q AS VARCHAR), ',' ORDER BY i)) AS hex FROM c{rounds} GROUP BY 1)
SELECT r.vec_id, CAST(f.k AS INT) AS cluster, CAST(f.d AS BIGINT) AS distance, g.s AS cluster_inertia,
  (SELECT CAST(sum(s) AS BIGINT) FROM g) AS inertia, h.hex AS centroid_sha256
FROM f JOIN r ON r.rid = f.rid JOIN g ON g.k = f.k JOIN h ON h.k = f.k
"""


@query("op12_centroid_clusters", _op12_sql())
def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.with_inertia(*centroids.cluster_vectors(table(spark, sf_dir, "embeddings")))


@query("op13_simhash_dedup")
def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
