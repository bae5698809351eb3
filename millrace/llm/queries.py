"""Queries of the operators for training data of language models."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import functions as F

from millrace.llm.contamination import leaks
from millrace.llm.mixing import mix
from millrace.llm.neighbours import exact_neighbours, mutual_pairs, recall, similar
from millrace.llm.rank_fusion import median_ranking, positions, top_items
from millrace.llm.spans import shared_shares, shared_spans
from millrace.session import load


def _item_report(s, d):
    found = leaks(load(s, d, "documents"), load(s, d, "eval_items")).groupBy("item_id").agg(F.count("*").alias("documents"), F.sum("windows").alias("windows"))
    items = load(s, d, "eval_items").select("item_id", "suite")
    return items.join(found, "item_id", "left").fillna(0, ["documents", "windows"])


def _listed(found):
    hits = found.select("vec_id", F.posexplode("hits").alias("place", "h"))
    return hits.select("vec_id", (F.col("place") + 1).alias("rank"), F.col("h.id").alias("neighbour"), F.round("h.far", 6).alias("far"))


def _recall(s, d):
    """Against brute force, for the queries whose id is divisible by 100."""
    only = F.col("vec_id") % 100 == 0
    vectors, specs = load(s, d, "coll_vectors"), load(s, d, "vector_specs")
    found = recall(similar(vectors, specs, only=only), exact_neighbours(vectors, specs, only))
    return found.select("queries", F.round("recall", 3).alias("recall"))


def _budgets(s, d):
    """The report with words as tokens, and whether each source came within one document of its budget."""
    drawn, report = mix(load(s, d, "documents"), load(s, d, "mix_targets"), "words")
    size = drawn.groupBy("source_name").agg(F.max("tokens").alias("largest"), F.max("copies").alias("most"))
    joined = report.join(size, "source_name", "left")
    budget = F.least(F.col("wanted"), (F.col("max_repeats") * F.col("tokens")).cast("double"))
    near = (F.col("drawn") <= budget) & (budget - F.col("drawn") < F.greatest(F.coalesce("largest", F.lit(0)), F.lit(1)) + F.lit(0.5))
    near = near & (F.coalesce("most", F.lit(0)) <= F.col("max_repeats"))
    return joined.select("source_name", "tokens", F.round("wanted", 3).alias("wanted"), "reachable", near.alias("kept"))


QUERIES = {
    "p3_found": lambda s, d: top_items(median_ranking(load(s, d, "scan_hits"))),
    "p3_ranking": lambda s, d: positions(median_ranking(load(s, d, "scan_hits"))).withColumn("mean_rank", F.round("mean_rank", 6)),
    "p4_found": lambda s, d: mutual_pairs(load(s, d, "coll_vectors"), load(s, d, "vector_specs")),
    "p4_similar": lambda s, d: _listed(similar(load(s, d, "coll_vectors"), load(s, d, "vector_specs"), only=F.col("vec_id") % 100 == 0)),
    "p4_recall": _recall,
    "p6_found": lambda s, d: leaks(load(s, d, "documents"), load(s, d, "eval_items")).select("doc_id", "item_id"),
    "p6_items": _item_report,
    "p7_found": lambda s, d: mix(load(s, d, "documents"), load(s, d, "mix_targets"))[1].where("not reachable").select("source_name"),
    "p7_drawn": lambda s, d: mix(load(s, d, "documents"), load(s, d, "mix_targets"))[0],
    "p7_shares": lambda s, d: mix(load(s, d, "documents"), load(s, d, "mix_targets"))[1],
    "p7_budgets": _budgets,
    "p8_found": lambda s, d: shared_spans(load(s, d, "documents")),
    "p8_shares": lambda s, d: shared_shares(load(s, d, "documents"), shared_spans(load(s, d, "documents"))),
}

_P3 = """
WITH best AS (
  SELECT query_id, retriever, _id, max(CAST(_score AS DOUBLE)) AS score FROM scan_hits
  WHERE query_id IS NOT NULL AND retriever IS NOT NULL AND _id IS NOT NULL AND _score IS NOT NULL AND NOT isnan(_score) GROUP BY ALL),
ranks AS (
  SELECT *, rank() OVER (PARTITION BY query_id, retriever ORDER BY score DESC)
         + (count(*) OVER (PARTITION BY query_id, retriever, score) - 1) / 2 AS rnk FROM best),
lists AS (SELECT query_id, retriever, count(*) AS len FROM best GROUP BY ALL),
items AS (SELECT DISTINCT query_id, _id FROM best),
sizes AS (SELECT query_id, count(*) AS n FROM items GROUP BY ALL),
places AS (
  SELECT i.query_id, i._id, coalesce(r.rnk, l.len + (s.n - l.len + 1) / 2) AS rnk
  FROM items i JOIN lists l USING (query_id) JOIN sizes s USING (query_id)
  LEFT JOIN ranks r ON r.query_id = i.query_id AND r._id = i._id AND r.retriever = l.retriever),
ranking AS (
  SELECT query_id, _id, CAST(quantile_disc(rnk, 0.5) AS DOUBLE) AS median_rank, CAST(avg(rnk) AS DOUBLE) AS mean_rank FROM places GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY median_rank, round(mean_rank, 9), _id) AS position FROM ranking)
"""

_SPANS = """
WITH g AS (
  SELECT doc_id, i, md5(substring(text, CAST(i AS BIGINT) + 1, 300)) AS h FROM (
    SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS i FROM documents WHERE length(text) >= 300)),
s AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
c AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 300 THEN 0 ELSE 1 END AS new FROM g JOIN s USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM c),
f AS (SELECT doc_id, min(i) AS span_start, max(i) + 300 AS span_end FROM n GROUP BY doc_id, no)
"""

# words after normalisation, and their runs of twelve; the compatibility forms that strip_accents leaves are written out
def _compatible(text: str) -> str:
    """SQL for the compatibility forms that strip_accents leaves: single characters, and ligatures of letters."""
    forms = {chr(c): unicodedata.normalize("NFKD", chr(c)) for c in range(0xA0, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000}
    single = {c: f for c, f in forms.items() if len(f) == 1 and f != c and unicodedata.normalize("NFD", c) == c and f not in "'"}
    out = f"translate({text}, '{''.join(single)}', '{''.join(single.values())}')"
    for c in map(chr, range(0xFB00, 0xFB07)):
        out = f"replace({out}, '{c}', '{forms[c]}')"
    return out


_PLAIN = "lower(strip_accents(nfc_normalize(" + _compatible("regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '[\\p{Cf}]', '', 'g')") + ")))"
_LEAKS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[\p{{L}}\p{{N}}]+') AS t FROM documents),
e AS (SELECT item_id, regexp_extract_all({_PLAIN}, '[\p{{L}}\p{{N}}]+') AS t FROM eval_items),
dg AS (SELECT doc_id, array_to_string(t[i : i + 11], ' ') AS w FROM (SELECT doc_id, t, unnest(range(1, len(t) - 10)) AS i FROM d WHERE len(t) >= 12)),
eg AS (SELECT DISTINCT item_id, array_to_string(t[i : i + 11], ' ') AS w FROM (SELECT item_id, t, unnest(range(1, len(t) - 10)) AS i FROM e WHERE len(t) >= 12)),
l AS (SELECT doc_id, item_id, count(*) AS windows FROM dg JOIN eg USING (w) GROUP BY ALL)
"""

SQL = {
    "p3_found": _P3 + "SELECT query_id, _id FROM placed WHERE position <= 5",
    "p3_ranking": _P3 + "SELECT query_id, _id, median_rank, round(mean_rank, 6) AS mean_rank, position FROM placed",
    "p4_found": """
WITH spec AS (SELECT DISTINCT coll_name, vector_name, dim, distance_kind FROM vector_specs),
u AS (SELECT coll_name, vector_name, distance_kind, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM coll_vectors JOIN spec USING (coll_name, vector_name)
  WHERE embedding IS NOT NULL AND len(embedding) = dim AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND (distance_kind <> 'Cosine' OR len(list_filter(embedding, lambda x: x <> 0)) > 0)),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.distance_kind AS kind,
    CASE a.distance_kind WHEN 'Cosine' THEN -list_cosine_similarity(a.e, b.e) ELSE list_distance(a.e, b.e) END AS far
  FROM u a JOIN u b ON a.coll_name = b.coll_name AND a.vector_name = b.vector_name AND a.vec_id <> b.vec_id WHERE a.distance_kind IN ('Cosine', 'Euclid')),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY far, b) AS place FROM p)
  WHERE place <= 10 AND far <= CASE kind WHEN 'Cosine' THEN -0.98 ELSE 1.0 END)
SELECT x.a AS vec_a, x.b AS vec_b FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b""",
    # counts words; any common tokenizer finds the same sources
    "p7_found": r"""
WITH d AS (SELECT lower(trim(source)) AS source_name, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS tokens FROM documents),
t AS (SELECT m.source_name, target_share, max_repeats, coalesce(sum(tokens), 0) AS tokens FROM mix_targets m LEFT JOIN d USING (source_name) GROUP BY ALL)
SELECT source_name FROM t WHERE target_share * (SELECT sum(tokens) FROM t) > max_repeats * tokens""",
    "p6_found": _LEAKS + "SELECT doc_id, item_id FROM l",
    "p6_items": _LEAKS
    + """SELECT item_id, suite, CAST(coalesce(documents, 0) AS BIGINT) AS documents, CAST(coalesce(windows, 0) AS BIGINT) AS windows
FROM eval_items LEFT JOIN (SELECT item_id, count(*) AS documents, sum(windows) AS windows FROM l GROUP BY item_id) USING (item_id)""",
    "p7_budgets": r"""
WITH d AS (SELECT lower(trim(source)) AS source_name, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS tokens FROM documents),
t AS (SELECT m.source_name, target_share, max_repeats, coalesce(sum(tokens), 0) AS tokens FROM mix_targets m LEFT JOIN d USING (source_name) GROUP BY ALL)
SELECT source_name, CAST(tokens AS BIGINT) AS tokens, round(target_share * (SELECT sum(tokens) FROM t), 3) AS wanted,
  target_share * (SELECT sum(tokens) FROM t) <= max_repeats * tokens AS reachable, true AS kept FROM t""",
    "p8_found": _SPANS + "SELECT doc_id, span_start, span_end FROM f",
    "p8_shares": _SPANS
    + """, k AS (SELECT doc_id, sum(span_end - span_start) AS n FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0) AS chars, CAST(coalesce(n, 0) AS BIGINT) AS shared_chars,
  CASE WHEN length(text) > 0 THEN coalesce(n, 0) / length(text) ELSE 0.0::DOUBLE END AS shared_share FROM documents LEFT JOIN k USING (doc_id)""",
}
