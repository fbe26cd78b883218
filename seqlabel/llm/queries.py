"""The registered queries opN_<name> and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bond, bpe, langid, lm, merkle, packing, quality, sharding, simhash, suffixdedup, toxicity, urlfilter, winnowing
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def statistic(name: str) -> str:
    """DuckDB form of a rule's integer statistic."""
    return quality.RULES[name][0].replace(" DIV ", " // ")


def quality_sql() -> str:
    """The statistics by regular expressions and windows, the certified cutoffs
    by the binomial distribution, restated for DuckDB."""
    rules = " UNION ALL ".join(
        f"SELECT doc_id, lang, quality, '{r}' AS rule, {statistic(r)} AS v FROM held" for r in quality.RULES)
    grid = " UNION ALL ".join(f"SELECT '{r}' AS rule, unnest({cuts}) AS cut, unnest(range({len(cuts)})) AS pos" for r, (_, cuts) in quality.RULES.items())
    alpha = quality.ALPHA / len(quality.RULES)
    values = " OR ".join(f"(c.rule = '{r}' AND {statistic(r)} >= c.cut)" for r in quality.RULES)
    return rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^ 	-
]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM texts),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM places),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
stats AS (SELECT s.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[ 	-
]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
    FROM split s LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
marked AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id HAVING min(quality) IS NOT NULL),
held AS (SELECT j.*, quality FROM judged j JOIN marked USING (doc_id) WHERE NOT base_failed),
vals AS ({rules}),
grid AS ({grid}),
strata AS (SELECT count(*) AS n_strata FROM (SELECT DISTINCT lang FROM held)),
tested AS (SELECT lang, g.rule, pos, cut, count(*) FILTER (quality = 1) AS n,
    count(*) FILTER (quality = 1 AND v >= cut) AS x, count(*) FILTER (quality = 0 AND v >= cut) AS caught
    FROM vals v JOIN grid g ON v.rule = g.rule GROUP BY lang, g.rule, pos, cut),
tails AS (SELECT t.*, (n > 0 AND x < n * {alpha!r} AND
    (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})))
     FROM (SELECT unnest(range(0, CASE WHEN n > 0 AND x < n * {alpha!r} THEN x + 1 ELSE 0 END)) AS i)) <= {quality.DELTA!r} / (n_strata * {len(quality.RULES)})) AS ok
    FROM tested t, strata),
sequence AS (SELECT *, bool_and(coalesce(ok, false)) OVER (PARTITION BY lang, rule ORDER BY pos) AS certified FROM tails),
best AS (SELECT lang, rule, arg_max(cut, (caught - x) * 1000 - pos) AS cut FROM sequence WHERE certified AND caught > x GROUP BY lang, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT EXISTS (SELECT 1 FROM best c WHERE c.lang IS NOT DISTINCT FROM j.lang AND ({values})) AS kept
FROM judged j"""


def url_sql() -> str:
    """Rules by suffix and prefix tests, terms by regular expressions with
    boundaries, restated for DuckDB."""
    rules = ", ".join(f"('{v}', '{r}')" for v, r in urlfilter.RULES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    other = r"[^0-9a-z\x{80}-\x{10FFFF}]"
    count = "len(list_filter({}, lambda t: regexp_matches(low, '(^|{})' || t || '({}|$)')))".format
    return rf"""
WITH texts AS (SELECT page_id, coalesce(url, '') AS u, translate(coalesce(url, ''), '{upper}', '{lower}') AS low FROM pages),
cut AS (SELECT *, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM texts),
split AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
counted AS (SELECT *, {count(urlfilter.STRICT, other, other)}::BIGINT AS n_strict, {count(urlfilter.SOFT, other, other)}::BIGINT AS n_soft FROM split),
rules AS (SELECT v, r, split_part(r, '/', 1) AS h, substr(r, strpos(r, '/')) AS p FROM (VALUES {rules}) t(v, r)),
fits AS (SELECT DISTINCT host, path, arg_max(r, length(r) * 1000 + length(h)) AS rule, arg_max(v, length(r) * 1000 + length(h)) AS v
    FROM (SELECT DISTINCT host, path FROM split) s JOIN rules ON ends_with('.' || host, '.' || h) AND host <> '' AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, rule, n_strict, n_soft,
    coalesce(v, CASE WHEN n_strict > 0 OR n_soft >= {urlfilter.SEVERAL} THEN 'block' ELSE 'allow' END) AS verdict
FROM counted LEFT JOIN fits USING (host, path)"""


def merkle_sql(levels: int = 6) -> str:
    """The same trees level by level (16 ** levels rows a source at most), crc32
    by its table, restated for DuckDB."""
    fields = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in merkle.FIELDS)
    side = "coalesce(string_agg(digest, '') OVER (PARTITION BY {}, pos // 16 ORDER BY pos ROWS BETWEEN {}), '')".format
    left, right = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"

    def tree(name: str, first: str, key: str) -> tuple[list[str], str, str]:
        """Levels, and the joins and paths of a node's siblings."""
        steps, joins = [f"{name}0 AS ({first})"], []
        for k in range(levels):
            steps.append(f"""{name}{k}s AS (SELECT {key}, pos, m, digest, CASE WHEN m > 1 THEN {side(key, left)} ELSE '' END AS l,
    CASE WHEN m > 1 THEN {side(key, right)} ELSE '' END AS r FROM {name}{k})""")
            steps.append(f"""{name}{k + 1} AS (SELECT {key}, pos // 16 AS pos, count(*) OVER (PARTITION BY {key}) AS m, digest FROM (
    SELECT {key}, pos // 16 * 16 AS pos, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
    FROM {name}{k} GROUP BY {key}, pos // 16))""")
            joins.append(f"JOIN {name}{k}s ON {name}{k}s.{key} = x.{key} AND {name}{k}s.pos = x.{name}pos // {16 ** k}")
        return steps, " ".join(joins), " || ".join(f"{name}{k}s.l || {name}{k}s.r" for k in range(levels))

    inner, inner_join, inner_path = tree("a", "SELECT k, pos, count(*) OVER (PARTITION BY k) AS m, leaf AS digest FROM leaves", "k")
    upper, upper_join, upper_path = tree("b", f"SELECT 0 AS g, k AS pos, count(*) OVER () AS m, digest FROM a{levels}", "g")
    folds = [f"CASE WHEN {n}{k}s.m > 1 THEN sha256({n}{k}s.l || {{}} || {n}{k}s.r) ELSE {{}} END" for n in "ab" for k in range(levels)]
    steps, node = [], "now"
    for i, f in enumerate(folds):
        # one column per fold, so that the expression isn't written out twice a level
        steps.append(f"{f.format(node, node)} AS f{i}")
        node = f"f{i}"
    return f"""
WITH crcs AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
hashed AS (SELECT doc_id, source, {fields} AS whole, sha256({fields}) AS leaf,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 5 = 0 AS hit,
    sha256({fields.replace("text::VARCHAR", f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')")}) AS tampered
    FROM documents, crcs),
leaves AS (SELECT doc_id, leaf, CASE WHEN hit THEN tampered ELSE leaf END AS now, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
{", ".join(inner)}, {", ".join(upper)},
x AS (SELECT *, pos AS apos, k AS bpos, 0 AS g FROM leaves)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM (
    SELECT doc_id, leaf, a{levels}.digest AS subroot, b{levels}.digest AS root, sha256({inner_path} || {upper_path}) AS proof_sha256, {", ".join(steps)}, {node} AS folded_root
    FROM x {inner_join} {upper_join} JOIN a{levels} ON a{levels}.k = x.k JOIN b{levels} ON true)"""


NEGATIVES_SQL = """
WITH part AS (SELECT vec_id, min({'label': CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END,
    'v': list_transform(embedding, lambda x: floor(256 * x::DOUBLE))}) AS r FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
sound AS (SELECT vec_id, r.label AS label, r.v AS v FROM part),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3"""


@query
def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compared(table(spark, sf_dir, "documents"))


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every other rack has larger machines
    weights = {s: 1.25 for s in range(sharding.SHARDS + 1) if s // sharding.SHARDS_PER_RACK % 2}
    return sharding.sharded(table(spark, sf_dir, "documents"), weights=weights)


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixdedup.deduplicated(docs).drop("text")


@query
def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return bond.mined(table(spark, sf_dir, "embeddings"), label, F.col("id") % 50 == 0)


@query
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.audited(docs, *merkle.tampered(docs))


ORACLE_SQL["op4_quality"] = quality_sql()
ORACLE_SQL["op13_url_filter"] = url_sql()
ORACLE_SQL["op11_merkle"] = merkle_sql()
ORACLE_SQL["op12_hard_negatives"] = NEGATIVES_SQL
