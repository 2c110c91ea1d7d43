"""The registered queries of the corpus operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, html_region, lbl, minhash, ppm, quality, sampled_pieces, templates, textcnn, url_rules
from lodestone.llm.common import crc_mod, table

#: The rule list of op6.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and adaptive verdict of every document."""
    return quality.quality_filter(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_region.extract_main_text(pages, html_region.learn_weights(pages))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that every document overlaps with."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines."""
    out = templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", "text")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, url_rules.RULE_SCHEMA)
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, by a model that never saw the held-out fifth."""
    out = lbl.score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, by a classifier that never saw the held-out fifth's labels."""
    docs = table(spark, sf_dir, "documents")
    fitted = textcnn.fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    out = textcnn.score_toxicity(docs, fitted)
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, by trees that never saw the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    trees = ppm.fit_trees(docs, crc_mod("doc_id", 4) != 2, "doc_id", "text", "lang")
    # the held-out flag follows from the id alone, so it needs no join
    found = ppm.predict_language(docs, trees)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_a_byte")


#: Model file of op10 where the setting `lodestone.piece.model` names none; any BPE model with
#: byte pieces will do.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def piece_model(spark: SparkSession) -> str:
    return spark.conf.get("lodestone.piece.model", PIECE_MODEL)


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document, with the check that they decode to it."""
    vocab = sampled_pieces.load_vocabulary(spark, piece_model(spark))
    return sampled_pieces.encode_documents(table(spark, sf_dir, "documents"), vocab)


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_url_filter": op6_url_filter,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_sampled_pieces": op10_sampled_pieces,
}

ORACLES: dict[str, str] = {}

ORACLES["op6_url_filter"] = """
WITH rules(rule, r_host, r_path, r_verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
rest AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS rid,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hit AS (SELECT rid, max_by(rule, length(rule)) AS rule, max_by(r_verdict, length(rule)) AS r_verdict
    FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY rid)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parts LEFT JOIN hit USING (rid)
"""

#: The overlap by its definition, without seeds: ten equal words within twelve on one alignment.
ORACLES["op4_decontamination"] = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
dp AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw),
ip AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS q, len(w) AS n FROM iw),
dense AS (SELECT doc_id, item_id, p - q AS d, n FROM dp JOIN ip USING (word) GROUP BY ALL HAVING count(*) >= least(n, 10)),
eq AS (SELECT doc_id, item_id, p - q AS d, q, n FROM dp JOIN ip USING (word) SEMI JOIN dense ON dense.doc_id = dp.doc_id AND dense.item_id = ip.item_id AND dense.d = p - q),
span AS (SELECT *, lead(q, 9) OVER (PARTITION BY doc_id, item_id, d ORDER BY q) - q AS reach, count(*) OVER (PARTITION BY doc_id, item_id, d) AS m FROM eq),
ok AS (SELECT doc_id, item_id, max(m) AS m FROM span WHERE (n >= 12 AND reach < 12) OR (n < 12 AND m = n) GROUP BY ALL),
agg AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS item_ids, max(m) AS n_matched FROM ok GROUP BY doc_id)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(n_matched, 0)::BIGINT AS n_matched
FROM documents LEFT JOIN agg USING (doc_id)
"""

ORACLES["op5_line_dedup"] = r"""
WITH texts AS (SELECT DISTINCT text, md5(text) AS key FROM documents WHERE text IS NOT NULL),
lines AS (SELECT key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM texts),
toks AS (SELECT key, pos, list_transform(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
    lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS tokens FROM lines),
l AS (SELECT key, pos, tokens, len(tokens) AS n, (len(tokens), tokens[1:3]) AS leaf, CASE WHEN len(tokens) >= 50 THEN 2 WHEN len(tokens) >= 8 THEN 3 ELSE 20 END AS need FROM toks WHERE len(tokens) > 0),
leaves AS (SELECT leaf FROM l GROUP BY leaf, need HAVING count(DISTINCT key) >= need),
bodies AS (SELECT leaf, tokens, n, need, count(DISTINCT key) AS n_docs FROM l SEMI JOIN leaves USING (leaf) GROUP BY ALL),
each AS (SELECT leaf, tokens, n, need, n_docs, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS p FROM bodies),
fixed AS (SELECT leaf, p, token, sum(n_docs) AS s FROM each WHERE token <> '<*>' GROUP BY leaf, p, token, need HAVING sum(n_docs) >= need),
ranked AS (SELECT tokens, n, p, token, row_number() OVER (PARTITION BY tokens ORDER BY s DESC, p) AS r, count(*) OVER (PARTITION BY tokens) AS m FROM each JOIN fixed USING (leaf, p, token)),
of_line AS (SELECT tokens, n, list({'p': p, 'token': token} ORDER BY p) AS template FROM ranked WHERE m >= ceil(n * 80 / 100) AND r <= ceil(n * 80 / 100) GROUP BY tokens, n),
held AS (SELECT l.key, l.pos, l.tokens, l.leaf, l.need, template FROM l JOIN of_line ON l.tokens = of_line.tokens),
templates AS (SELECT leaf, template, min(key) AS first FROM held GROUP BY leaf, template, need HAVING count(DISTINCT key) >= need),
places AS (SELECT key, pos, first, row_number() OVER (PARTITION BY key, tokens ORDER BY pos) AS nth FROM held JOIN templates USING (leaf, template)),
gone AS (SELECT key, list(pos) AS pos FROM places WHERE key <> first OR nth > 1 GROUP BY key)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(len(pos), 0)::BIGINT AS n_dropped,
  CASE WHEN pos IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(pos, i)), chr(10)) END AS text
FROM documents LEFT JOIN gone ON md5(documents.text) = gone.key
"""
