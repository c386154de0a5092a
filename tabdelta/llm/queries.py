"""One query for each operator, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as _decontaminate
from . import filter_audit as _filter_audit
from . import fingerprints as _fingerprints
from . import importance as _importance
from . import jaccard_join as _jaccard_join
from . import language_id as _language_id
from . import license_scan as _license_scan
from . import line_dedup as _line_dedup
from . import lm_scoring as _lm_scoring
from . import packing as _packing
from . import pseudonyms as _pseudonyms
from . import quality_rules as _quality_rules
from . import spelling as _spelling


#: Id that ends a packed document.
END_ID = 1
#: Key of the query's pseudonyms; a real run passes a secret.
PSEUDONYM_KEY = "tabdelta-example-key"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids labelled as of good quality and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), clean_labels(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _importance.resample(table(spark, sf_dir, "documents"), clean_labels(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license_scan.scan(table(spark, sf_dir, "documents"), _license_scan.template_table(spark))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_dedup.remove_spread_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = _language_id.held_out()
    profiles = _language_id.learn_profiles(docs.where(~held).select("text", "lang"))
    found = _language_id.identify(docs, profiles)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_language_id": op9_language_id,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_fingerprints": op11_fingerprints,
    "op12_filter_audit": op12_filter_audit,
    "op13_spelling_variants": op13_spelling_variants,
}

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NOTICES = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(_license_scan.NOTICES))
_PLAIN = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op8_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_FOLD.format('text'))} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format(_FOLD.format('text'))} AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
s AS (SELECT DISTINCT item_id, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*)::DOUBLE / any_value(n_item) AS containment
FROM ds JOIN s USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
""",
    "op2_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format(_FOLD.format('text'))}, []) AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS k FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+3], ' ') AS s FROM k),
n AS (SELECT d.doc_id, count(s.s) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT g.b, r.low FROM r JOIN g ON g.a = r.doc_id),
l AS (SELECT a, count(*) AS n_links FROM g GROUP BY a)
SELECT n.doc_id, any_value(n.n)::BIGINT AS n_shingles, min(low) AS component_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links
FROM n JOIN r ON r.doc_id = n.doc_id LEFT JOIN l ON l.a = n.doc_id GROUP BY n.doc_id
""",
    "op5_license_scan": f"""
WITH t(template, license, text) AS (VALUES {_NOTICES}),
tw AS (SELECT template, license, {_PLAIN} AS w FROM t),
dw AS (SELECT doc_id, {_PLAIN} AS w FROM documents WHERE text IS NOT NULL),
ts AS (SELECT DISTINCT template, license, array_to_string(w[k:k+2], ' ') AS s FROM (SELECT template, license, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS k FROM tw)),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS k FROM dw)),
n AS (SELECT template, count(*) AS n_template FROM ts GROUP BY template)
SELECT doc_id, template::INTEGER AS template, license, count(*) AS n_shared, any_value(n_template) AS n_template, count(*)::DOUBLE / any_value(n_template) AS containment
FROM ds JOIN ts USING (s) JOIN n USING (template) GROUP BY doc_id, template, license HAVING count(*) >= 0.95 * any_value(n_template)
""",
    "op6_line_dedup": r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, unnest(range(1, len(ls) + 1)) AS pos, trim(unnest(ls), E' \t\x0b\f\r') AS line FROM d),
g AS (SELECT line, min({'doc_id': doc_id, 'pos': pos}) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, chr(1))) >= 10),
x AS (SELECT doc_id, list(pos) AS gone FROM l JOIN g USING (line) WHERE doc_id <> first.doc_id OR pos <> first.pos GROUP BY doc_id),
c AS (SELECT doc_id, count(*) FILTER (line <> '') AS n_lines FROM l GROUP BY doc_id)
SELECT d.doc_id,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda y, i: NOT list_contains(gone, i)), chr(10)) END AS text,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > first, false)::INT AS fails
  FROM d JOIN m USING (t) LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY part, fails),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step, bits FROM o),
q AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM s),
r AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN fails & before > 0 AND fails & own > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN fails & before = 0 AND fails & own > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c CROSS JOIN q GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
""",
}
