"""Registered queries of the operators, over the whole driver tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Place of the public tokenizer; TABWISE_TOKENIZER overrides the installed one."""
    if "TABWISE_TOKENIZER" in os.environ:
        return os.environ["TABWISE_TOKENIZER"]
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def aligned_tokenizer_paths() -> tuple[str, str]:
    """Places of the two public tokenizers of op11; TABWISE_TOKENIZER_A and TABWISE_TOKENIZER_B override the installed ones."""
    import public_tokenizers

    return (os.environ.get("TABWISE_TOKENIZER_A") or str(public_tokenizers.path("byte_bpe_50k.json")),
            os.environ.get("TABWISE_TOKENIZER_B") or str(public_tokenizers.path("piece_bpe_32k.model")))


# The rules of op3, as host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op1_ngram_jaccard_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS g FROM s),
rare AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT e.doc_id, e.g FROM e JOIN rare USING (g)),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * o >= 80 * (na.n_shingles + nb.n_shingles - o)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, d.b FROM r JOIN d ON r.u = d.a)
SELECT n.doc_id, n.n_shingles, min(r.u)::BIGINT AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY 1, 2""")
def op1(spark, sf_dir):
    from tabwise.llm.ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    from tabwise.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op3_url_filter", r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM u),
k AS (SELECT *, CASE WHEN contains(url, '://') THEN host || CASE WHEN tail = '' OR starts_with(tail, '?') THEN '/' || tail ELSE tail END END AS node FROM h),
t AS (SELECT node AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM k
      WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|refresh')),
f AS (SELECT a, CASE WHEN regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?[^"''>]*canonical') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^\s"''>]*)', 1)
                     WHEN regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?\s*refresh') THEN regexp_extract(tag, '(?is)url\s*=\s*["'']?([^\s"''>]*)', 1) END AS target FROM t),
g AS (SELECT a, CASE WHEN contains(target, '://') THEN substr(target, strpos(target, '://') + 3)
                     WHEN starts_with(target, '/') THEN regexp_extract(a, '^([^/]*)', 1) || target END AS rest FROM f WHERE target IS NOT NULL),
e AS (SELECT DISTINCT a, lower(regexp_extract(rest, '^([^/?#]*)', 1)) || CASE WHEN regexp_extract(rest, '^[^/?#]*([^#]*)', 1) = '' OR starts_with(regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '?')
        THEN '/' ELSE '' END || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b FROM g WHERE rest IS NOT NULL),
d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
n AS (SELECT node, regexp_extract(node, '^([^/]*)', 1) AS host, regexp_extract(node, '^[^/]*([^?]*)', 1) AS path FROM (SELECT a AS node FROM d)),
rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
nv AS (SELECT DISTINCT node, (SELECT arg_max(v, len(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS v FROM n),
r AS (SELECT node AS x, node AS y FROM nv UNION SELECT r.x, d.b FROM r JOIN d ON r.y = d.a),
c AS (SELECT r.x AS node, min(nv.v) AS class FROM r JOIN nv ON nv.node = r.y GROUP BY 1),
o AS (SELECT page_id, host, path, node,
        (SELECT arg_max({'rule': rh || rp, 'v': v}, len(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS own FROM k)
SELECT page_id, host, path, own.rule AS rule, coalesce(own.v, class, 'allow') AS verdict,
       CASE WHEN own IS NOT NULL THEN 'rule' WHEN class IS NOT NULL THEN 'class' ELSE 'default' END AS via
FROM o LEFT JOIN c USING (node)""")
def op3(spark, sf_dir):
    from tabwise.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query("op5_exact_dedup", r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""")
def op5(spark, sf_dir):
    from tabwise.llm.exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("locator")


def _license_sql() -> str:
    from tabwise.llm.license_scan import EQUIVALENT, KNOWN_LICENSES

    def canonical(x: str) -> str:
        x = (f"' ' || regexp_replace(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10)), "
             r"'(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$', ' ', 'g'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', '  ', 'g') || ' '")
        for spelling, standard in EQUIVALENT:
            x = f"replace({x}, ' {spelling.replace(' ', '  ')} ', ' {standard} ')"
        return f"sha256(trim(replace({x}, '  ', ' '), ' '))"

    known = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in KNOWN_LICENSES)
    return f"""
WITH k AS (SELECT DISTINCT license, {canonical('t')} AS d FROM (VALUES {known}) AS v(license, t)),
l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\\r\\n]+')) AS line FROM documents),
f AS (SELECT doc_id, list_sort(list_distinct(list(license))) AS notices FROM l JOIN k ON k.d = {canonical('line')}
      WHERE regexp_matches(line, '(?i)licen[cs]e|released under|spdx|permission|redistribution') GROUP BY 1)
SELECT w.doc_id, w.d AS canonical_sha256, k.license, coalesce(array_to_string(f.notices, ','), '') AS notices
FROM (SELECT doc_id, {canonical('text')} AS d FROM documents) w LEFT JOIN k USING (d) LEFT JOIN f ON f.doc_id = w.doc_id"""


@query("op6_license_scan", _license_sql())
def op6(spark, sf_dir):
    from tabwise.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


@query("op9_benchmark_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 13 THEN [array_to_string(ws, ' ')]
          ELSE list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' ')) END) AS win, least(len(ws), 13) AS size FROM b),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS i, ws FROM d, sizes WHERE len(ws) >= size),
m AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON bw.size = dw.size AND bw.win = array_to_string(dw.ws[dw.i:dw.i + dw.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op9(spark, sf_dir):
    from tabwise.llm.decontaminate import find_contamination

    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hit_spans")


@query("op7_language_id")
def op7(spark, sf_dir):
    from tabwise.llm.language_id import evaluate

    return evaluate(table(spark, sf_dir, "documents"))


@query("op8_kneser_ney_scoring")
def op8(spark, sf_dir):
    from tabwise.llm.kneser_ney import evaluate
    from tabwise.llm.language_id import remainder

    return evaluate(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 7) == 2)


@query("op4_html_extraction")
def op4(spark, sf_dir):
    from tabwise.llm.html_crf import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query("op10_toxicity")
def op10(spark, sf_dir):
    from tabwise.llm.toxicity import evaluate

    return evaluate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_conversation_trie", r"""
WITH o AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS m,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list(m ORDER BY k) AS own,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295) % 6 AS h
  FROM o GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS turns
      FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, d, turns[1:d] AS node, d = len(turns) AS last
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
      FROM p GROUP BY node, d),
k AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(n.node[d].t) END AS saved
      FROM n LEFT JOIN k ON k.node = n.node),
u AS (SELECT node[1:e] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT node, n_children, saved, unnest(range(0, d + 1)) AS e FROM v) GROUP BY 1)
SELECT v.conv_id, v.d::BIGINT AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.n_children, u.n_leaves,
       u.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM v JOIN u ON u.node = v.node LEFT JOIN n q ON v.d > 0 AND q.node = v.node[1:v.d - 1]""")
def op12(spark, sf_dir):
    from tabwise.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations")).drop("p1", "p2")


@query("op13_minhash_near_dedup", "SELECT *, doc_id = component_id AS kept FROM ("
       + ORACLE_SQL["op1_ngram_jaccard_join"].replace("100 * o >= 80 *", "100 * o >= 85 *") + ")")
def op13(spark, sf_dir):
    from tabwise.llm.minhash_hamming import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_cross_tokenizer_alignment")
def op11(spark, sf_dir):
    from tabwise.llm.token_alignment import count_links

    return count_links(table(spark, sf_dir, "documents"), aligned_tokenizer_paths())
