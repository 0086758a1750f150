"""DuckDB oracle SQL for the registered queries (same column names)."""

from __future__ import annotations

from ..functions import labels as L
from ..functions.text import WS
from ..sources.synthetic import CATEGORIES, PREFIXES, SUFFIXES, TEMPLATES
from .common import CRED_SOURCES
from .flows import RAW_WS_RUN
from .queries import KEYWORD_RE, POLITICAL_SUBREDDITS
from .sqlfrag import (CORPUS, PREPARED, char_length, clean, drop_stop_words, hkey, lemma_ctes, lit, metrics_ctes,
                      nb_ctes, nb_predict_ctes, prepared_ctes, r6, split_cte, strip_ws, terms_cte, tfidf_ctes,
                      word_count)

S: dict[str, str] = {}


def values(rows, cols, alias="t"):
    def v(x):
        return "NULL" if x is None else (lit(x) if isinstance(x, str) else str(x))
    body = ", ".join("(" + ", ".join(v(x) for x in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"


def name_case(col, mapping):
    whens = " ".join(f"WHEN {k} THEN {lit(v)}" for k, v in mapping.items())
    return f"coalesce(CASE {col} {whens} END, CAST({col} AS VARCHAR))"


S["label_distribution"] = f"""WITH {CORPUS}
SELECT label_id, label, count(*) AS n, {r6('avg(' + word_count('clean_text') + ')')} AS avg_word_count
FROM cleaned GROUP BY label_id, label"""

S["clean_text"] = f"""SELECT doc_id, clean_text, {char_length('clean_text')} AS clean_chars
FROM (SELECT doc_id, {clean('text')} AS clean_text FROM documents)"""

S["clean_html_pages"] = f"SELECT page_id, {clean('html')} AS clean_text, {clean('url')} AS clean_url FROM pages"

S["clean_conversations"] = f"SELECT conv_id, turn, role, {clean('text')} AS clean_text FROM conversations"

_subs = ", ".join(lit(s) for s in POLITICAL_SUBREDDITS)
S["topic_filter"] = f"""SELECT doc_id, source FROM documents
WHERE coalesce(lower(source) IN ({_subs}), false) OR coalesce(regexp_matches(lower(text), {lit(KEYWORD_RE)}), false)"""

S["text_assembly_liar"] = """SELECT conv_id, turn,
  CASE WHEN coalesce(trim(role), '') <> '' THEN text || ' [' || role || ']' ELSE text END AS text
FROM conversations"""

S["text_assembly_nela"] = """SELECT doc_id,
  CASE WHEN text IS NULL THEN coalesce(source, '') ELSE coalesce(source, '') || '. ' || text END AS text
FROM documents"""

S["min_length_filter"] = f"""SELECT doc_id, CAST(length({strip_ws('text')}) AS INTEGER) AS stripped_len
FROM documents WHERE length({strip_ws('text')}) > 20"""

S["word_counts"] = f"SELECT doc_id, {char_length('text')} AS text_length, {word_count('text')} AS word_count FROM documents"


S["stopword_filter"] = f"""SELECT doc_id, {drop_stop_words('c')} AS text_nostop
FROM (SELECT doc_id, {clean('text')} AS c FROM documents)"""

S["preprocess_text"] = f"""WITH {prepared_ctes('documents', 'doc_id').lstrip()}
SELECT doc_id, clean_text FROM cleaned"""

S["lemma_map"] = f"""WITH c AS (SELECT doc_id, {clean('text')} AS clean_text FROM documents),
toks AS (SELECT token, count(*) AS df FROM (
  SELECT DISTINCT doc_id, token FROM (
    SELECT doc_id, unnest(list_filter(string_split(clean_text, ' '), lambda w: w <> '')) AS token FROM c))
  GROUP BY token),{lemma_ctes('toks')}
SELECT token, lemma FROM lemmas"""


S["json_props_flatten"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"

S["array_argmax"] = "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings"

S["safe_names"] = """SELECT o_orderpriority, replace(lower(o_orderpriority), ' ', '_') AS safe_name, count(*) AS n
FROM orders GROUP BY o_orderpriority"""

_cred = values(sorted(CRED_SOURCES.items()), ["source_key", "label_id"], "c")
_key = f"regexp_replace(lower(trim(source)), {lit('[' + WS + ']+')}, '', 'g')"
S["source_credibility_join"] = f"""SELECT d.doc_id, d.source, CAST(c.label_id AS INTEGER) AS label_id,
  {name_case('c.label_id', L.NELA_3WAY)} AS label
FROM documents d JOIN {_cred} ON {_key} = c.source_key"""

S["unknown_source_anti"] = f"""SELECT source, count(*) AS n FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM {_cred} WHERE c.source_key = {_key.replace('source', 'd.source')})
GROUP BY source"""

S["dimension_last_wins"] = "SELECT user_id, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id"

_liar_arr = "[" + ", ".join(lit(x) for x in L.LIAR_LABELS) + "]"
_raw = f"{_liar_arr}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)]"


def _liar_remap(scheme):
    m = L.LIAR_SCHEMES[scheme]
    ids = " ".join(f"WHEN {lit(k)} THEN {v[0]}" for k, v in m.items())
    names = " ".join(f"WHEN {lit(k)} THEN {lit(v[1])}" for k, v in m.items())
    return f"""SELECT o_orderkey, CAST(coalesce(CASE trim(raw) {ids} END, -1) AS INTEGER) AS label_id,
  coalesce(CASE trim(raw) {names} END, 'unknown') AS label
FROM (SELECT o_orderkey, {_raw} AS raw FROM orders)"""


for _s in ("6way", "3way", "2way"):
    S[f"label_remap_{_s}"] = _liar_remap(_s)

S["harmonize_binary"] = f"""SELECT o_orderkey, label_id, {name_case('label_id', L.BINARY_NAMES)} AS label FROM (
  SELECT o_orderkey, CAST(CASE WHEN label_id <= 2 THEN 0 ELSE 1 END AS INTEGER) AS label_id
  FROM ({_liar_remap('6way')}))"""

S["union_corpora"] = f"""SELECT 'documents' AS corpus, doc_id, source, CAST(NULL AS BIGINT) AS turn, {char_length('text')} AS n_chars FROM documents
UNION ALL SELECT 'conversations', conv_id, NULL, turn, {char_length('text')} FROM conversations"""

_quad = {0: "low", 1: "low_toxic", 2: "high", 3: "high_toxic"}
S["label_dictionary"] = f"""SELECT label_id, arg_min(label, doc_id) AS label FROM (
  SELECT d.doc_id, CAST(l.quality * 2 + l.toxic AS INTEGER) AS label_id,
         {name_case('CAST(l.quality * 2 + l.toxic AS INTEGER)', _quad)} AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL AND d.text IS NOT NULL)
GROUP BY label_id"""

S["hash_sample"] = f"SELECT doc_id FROM documents ORDER BY {hkey(42, 'doc_id')}, doc_id LIMIT 100"

_t1, _t2 = int(0.2 * 2 ** 32), int(0.3 * 2 ** 32)
S["hash_split"] = f"""SELECT doc_id, CASE WHEN h < {_t1} THEN 'test' WHEN h < {_t2} THEN 'val' ELSE 'train' END AS split
FROM (SELECT doc_id, {hkey(42, 'doc_id')} AS h FROM documents)"""

_SPLIT = f"WITH {PREPARED},{split_cte('cleaned', 'split')}"
S["stratified_split"] = f"{_SPLIT}\nSELECT doc_id, label_id, split FROM split"

S["stratified_split_orders"] = f"""WITH o AS (SELECT o_orderkey, o_orderpriority FROM orders),
{split_cte('o', 'sp', 20, 10, 'o_orderpriority', 'o_orderkey')}
SELECT o_orderkey, o_orderpriority, split FROM sp"""

S["stratified_split_lineitem"] = f"""WITH li AS (SELECT l_orderkey * 8 + l_linenumber AS l_key, l_returnflag FROM lineitem),
{split_cte('li', 'sp', 20, 10, 'l_returnflag', 'l_key')}
SELECT l_key, l_returnflag, split FROM sp"""

S["kfold_assign"] = f"""SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY {hkey(42, 'o_orderkey')}, o_orderkey) - 1) * 3 // count(*) OVER (PARTITION BY o_orderpriority) AS INTEGER) AS fold
FROM orders"""

S["shuffle_key"] = f"SELECT doc_id, {hkey(42, 'doc_id')} AS shuffle_key FROM documents"

S["class_weights"] = f"""{_SPLIT},
cnt AS (SELECT label_id, count(*) AS n_c FROM split WHERE split = 'train' GROUP BY label_id)
SELECT label_id, n_c, {r6('sum(n_c) OVER () / (count(*) OVER () * n_c)')} AS weight FROM cnt"""

S["imbalance_ratio"] = f"""{_SPLIT},
grid AS (SELECT * FROM (SELECT DISTINCT split FROM split), (SELECT DISTINCT label_id FROM split)),
cnt AS (SELECT g.split, g.label_id, count(s.doc_id) AS n FROM grid g
        LEFT JOIN split s ON s.split = g.split AND s.label_id = g.label_id GROUP BY ALL)
SELECT split, max(n) AS max_n, min(n) AS min_n,
  {r6("CASE WHEN min(n) > 0 THEN CAST(max(n) AS DOUBLE) / min(n) ELSE 'inf'::DOUBLE END")} AS imbalance_ratio
FROM cnt GROUP BY split"""


def _synth():
    tpl = values([(ci, ti, t) for ci, c in enumerate(CATEGORIES) for ti, t in enumerate(TEMPLATES[c])],
                 ["cat", "tpl", "template"])
    suf = "[" + ", ".join(lit(s) for s in SUFFIXES) + "]"
    pre = "[" + ", ".join(lit(s) for s in PREFIXES) + "]"
    cats = "[" + ", ".join(lit(c) for c in CATEGORIES) + "]"
    return f"""WITH base AS (
  SELECT doc_id, row_number() OVER (ORDER BY {hkey(42, 'doc_id')}, doc_id) - 1 AS rk, count(*) OVER () AS n FROM documents),
g AS (SELECT doc_id, CAST(rk % 6 AS INTEGER) AS cat, CAST({hkey(42, 'doc_id', 'tpl')} % 10 AS INTEGER) AS tpl,
             {hkey(42, 'doc_id', 'var')} % 3 AS var, {hkey(42, 'doc_id', 'aff')} % 4 AS aff
      FROM base WHERE rk < (n // 6) * 6),
t AS (SELECT * FROM {tpl})
SELECT g.doc_id,
  CASE WHEN var = 0 THEN t.template WHEN var = 1 THEN t.template || ' ' || {suf}[aff + 1]
       ELSE {pre}[aff + 1] || t.template END AS text,
  {cats}[g.cat + 1] AS label, g.cat AS label_id
FROM g JOIN t ON g.cat = t.cat AND g.tpl = t.tpl"""


S["synthetic_corpus"] = _synth()

# ---------------------------------------------------------------- prediction tables
_LI = """li AS (SELECT l_orderkey, l_linenumber, l_returnflag AS true_label,
  CASE l_linestatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' END AS pred_label FROM lineitem)"""
_CM = f"""WITH {_LI},
cnt AS (SELECT true_label, pred_label, count(*) AS n FROM li GROUP BY ALL),
cls AS (SELECT DISTINCT c FROM (SELECT true_label AS c FROM cnt UNION ALL SELECT pred_label FROM cnt) WHERE c IS NOT NULL),
cm AS (SELECT a.c AS true_label, b.c AS pred_label, coalesce(cnt.n, 0) AS n
       FROM cls a CROSS JOIN cls b LEFT JOIN cnt ON cnt.true_label = a.c AND cnt.pred_label = b.c)"""
S["confusion_matrix"] = f"{_CM}\nSELECT true_label, pred_label, CAST(n AS BIGINT) AS n FROM cm"
S["confusion_normalized"] = f"""{_CM}
SELECT true_label, pred_label, CAST(n AS BIGINT) AS n,
  {r6('CASE WHEN sum(n) OVER (PARTITION BY true_label) > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY true_label) ELSE 0.0 END')} AS rate
FROM cm"""

S["class_report"] = f"""WITH {_LI},{metrics_ctes('li')},
agg AS (SELECT CAST(sum(tp) AS DOUBLE) / sum(support) AS acc, sum(support) AS n,
  avg(precision) AS pm, avg(recall) AS rm, avg(f1) AS fm,
  sum(precision * support) / sum(support) AS pw, sum(recall * support) / sum(support) AS rw,
  sum(f1 * support) / sum(support) AS fw FROM m_m)
SELECT cls AS row, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM m_m
UNION ALL SELECT 'accuracy', NULL, NULL, {r6('acc')}, CAST(n AS BIGINT) FROM agg
UNION ALL SELECT 'macro avg', {r6('pm')}, {r6('rm')}, {r6('fm')}, CAST(n AS BIGINT) FROM agg
UNION ALL SELECT 'weighted avg', {r6('pw')}, {r6('rw')}, {r6('fw')}, CAST(n AS BIGINT) FROM agg"""

_MM = """mm AS (
  SELECT 'status_map' AS model, l_returnflag AS true_label,
         CASE l_linestatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' END AS pred_label FROM lineitem
  UNION ALL SELECT 'discount_rule', l_returnflag, CASE WHEN l_discount >= 0.05 THEN 'R' ELSE 'N' END FROM lineitem
  UNION ALL SELECT 'tax_rule', l_returnflag, CASE WHEN l_tax >= 0.04 THEN 'A' ELSE 'R' END FROM lineitem)"""
_METRICS = ["accuracy", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted", "f1_macro", "f1_weighted"]
S["model_metrics"] = f"""WITH {_MM},{metrics_ctes('mm', 'model')}
SELECT model, {', '.join(r6(m) + ' AS ' + m for m in _METRICS)} FROM m_sum"""
S["model_comparison"] = f"""WITH {_MM},{metrics_ctes('mm', 'model')}
SELECT model, metric, {r6('value')} AS value FROM m_sum UNPIVOT (value FOR metric IN ({', '.join(_METRICS)}))"""

S["confusion_pairs_topk"] = f"""WITH {_LI}
SELECT true_label, pred_label, count(*) AS n FROM li WHERE true_label <> pred_label
GROUP BY ALL ORDER BY n DESC, true_label, pred_label LIMIT 10"""

S["error_crosstab"] = f"""WITH {_LI},
e AS (SELECT * FROM li WHERE true_label <> pred_label),
cls AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) AS t(true_label))
SELECT c.true_label,
  CAST(count(*) FILTER (WHERE e.pred_label = 'A') AS BIGINT) AS "A",
  CAST(count(*) FILTER (WHERE e.pred_label = 'N') AS BIGINT) AS "N",
  CAST(count(*) FILTER (WHERE e.pred_label = 'R') AS BIGINT) AS "R"
FROM cls c LEFT JOIN e ON e.true_label = c.true_label GROUP BY c.true_label"""

_DP = f"""dp AS (
  SELECT d.doc_id, d.text, CAST(l.quality AS INTEGER) AS true_id, CAST(l.toxic AS INTEGER) AS pred_id,
         {name_case('CAST(l.quality AS INTEGER)', L.BINARY_NAMES)} AS true_label,
         {name_case('CAST(l.toxic AS INTEGER)', L.BINARY_NAMES)} AS pred_label,
         l.quality = l.toxic AS correct,
         {char_length('d.text')} AS text_length, {word_count('d.text')} AS word_count
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

S["error_summary"] = f"""WITH {_DP}
SELECT count(*) AS total, count(*) FILTER (WHERE NOT correct) AS errors, count(*) FILTER (WHERE correct) AS correct,
  {r6('100.0 * count(*) FILTER (WHERE NOT correct) / count(*)')} AS error_pct,
  {r6('100.0 * count(*) FILTER (WHERE correct) / count(*)')} AS correct_pct
FROM dp"""

S["error_rate_by_class"] = f"""WITH {_DP}
SELECT true_label, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS errors,
  {r6('CAST(count(*) FILTER (WHERE NOT correct) AS DOUBLE) / count(*)')} AS error_rate
FROM dp GROUP BY true_label"""

S["error_samples_topk"] = f"""WITH {_DP}
SELECT doc_id, true_label, pred_label, text, word_count FROM (
  SELECT *, row_number() OVER (PARTITION BY true_label, pred_label ORDER BY doc_id) AS rn FROM dp WHERE NOT correct)
WHERE rn <= 5"""

S["mean_words_by_correctness"] = f"""WITH {_DP}
SELECT correct, {r6('avg(word_count)')} AS avg_word_count, count(*) AS n FROM dp GROUP BY correct"""

S["length_profile"] = f"""WITH {_DP}
SELECT true_label, count(*) AS n, {r6('avg(text_length)')} AS mean_length,
  {r6('CAST(quantile_cont(text_length, 0.5) AS DOUBLE)')} AS median_length, {r6('stddev_pop(text_length)')} AS std_length
FROM dp GROUP BY true_label"""

S["length_histogram"] = f"""WITH {_DP},
rng AS (SELECT correct, CAST(min(word_count) AS DOUBLE) AS lo, CAST(max(word_count) AS DOUBLE) AS hi, count(*) AS n FROM dp GROUP BY correct),
rng2 AS (SELECT correct, n, CASE WHEN hi = lo THEN lo - 0.5 ELSE lo END AS lo2, CASE WHEN hi = lo THEN hi + 0.5 ELSE hi END AS hi2 FROM rng),
rng3 AS (SELECT *, (hi2 - lo2) / 30 AS w FROM rng2),
b AS (SELECT r.correct, CAST(least(29, floor((CAST(d.word_count AS DOUBLE) - r.lo2) / r.w)) AS INTEGER) AS bin, r.lo2, r.w, r.n
      FROM dp d JOIN rng3 r ON d.correct = r.correct)
SELECT g.correct, CAST(g.bin AS INTEGER) AS bin, {r6('g.lo2 + g.bin * g.w')} AS bin_start,
  {r6('g.lo2 + (g.bin + 1) * g.w')} AS bin_end, count(b.bin) AS count, {r6('count(b.bin) / (g.n * g.w)')} AS density
FROM (SELECT *, unnest(range(30)) AS bin FROM rng3) g LEFT JOIN b ON b.correct = g.correct AND b.bin = g.bin
GROUP BY g.correct, g.bin, g.lo2, g.w, g.n"""

S["performance_disparities"] = f"""WITH {_DP},{metrics_ctes('dp')}
SELECT cls, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1,
  CAST(support AS BIGINT) AS support, f1 < 0.5 AS underserved FROM m_m"""

_RP = f"""rp AS (
  SELECT m.model, {name_case('true_id', L.BINARY_NAMES)} AS true_label, {name_case('m.pred_id', L.BINARY_NAMES)} AS pred_label,
         true_id = m.pred_id AS correct, text_length, word_count
  FROM (SELECT CAST(l.quality AS INTEGER) AS true_id, CAST(l.toxic AS INTEGER) AS toxic,
               {char_length('d.text')} AS text_length, {word_count('d.text')} AS word_count
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL) r,
  LATERAL (SELECT unnest(['toxic_rule', 'length_rule', 'always_true']) AS model,
                  unnest([r.toxic, CAST(r.text_length > 2000 AS INTEGER), 1]) AS pred_id) m)"""
_REPORT = f"""{_RP},
report AS (
  SELECT model, CASE grouping(true_label, pred_label, correct) WHEN 0 THEN 'pair' WHEN 3 THEN 'class' WHEN 6 THEN 'correctness'
         ELSE 'all' END AS section, true_label, pred_label, correct, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS errors,
         avg(word_count) AS words, avg(text_length) AS mean_length,
         CAST(quantile_cont(text_length, 0.5) AS DOUBLE) AS median_length, stddev_pop(text_length) AS std_length
  FROM rp GROUP BY GROUPING SETS ((model, true_label, pred_label, correct), (model, true_label), (model, correct), (model)))"""
S["prediction_report"] = f"""WITH {_REPORT}
SELECT model, section, true_label, pred_label, correct, n, errors, {r6('words')} AS words, {r6('mean_length')} AS mean_length,
  {r6('median_length')} AS median_length, {r6('std_length')} AS std_length FROM report"""
S["error_analysis_all"] = f"""WITH {_RP}
SELECT model, true_label, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS errors,
  {r6('CAST(count(*) FILTER (WHERE NOT correct) AS DOUBLE) / count(*)')} AS error_rate FROM rp GROUP BY model, true_label
UNION ALL SELECT model, '(all)', count(*), count(*) FILTER (WHERE NOT correct),
  {r6('CAST(count(*) FILTER (WHERE NOT correct) AS DOUBLE) / count(*)')} FROM rp GROUP BY model"""
S["bias_analysis_all"] = f"""WITH {_RP},{metrics_ctes('rp', 'model')},
len AS (SELECT model, true_label, avg(text_length) AS mean_length, CAST(quantile_cont(text_length, 0.5) AS DOUBLE) AS median_length,
               stddev_pop(text_length) AS std_length FROM rp GROUP BY model, true_label)
SELECT m.model, m.cls, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, CAST(support AS BIGINT) AS support,
  f1 < 0.5 AS underserved, {r6('mean_length')} AS mean_length, {r6('median_length')} AS median_length, {r6('std_length')} AS std_length
FROM m_m m LEFT JOIN len l ON l.model = m.model AND l.true_label = m.cls"""

S["class_report_by_model"] = f"""WITH {_MM},{metrics_ctes('mm', 'model')},
agg AS (SELECT model, CAST(sum(tp) AS DOUBLE) / sum(support) AS acc, sum(support) AS n,
  avg(precision) AS pm, avg(recall) AS rm, avg(f1) AS fm,
  sum(precision * support) / sum(support) AS pw, sum(recall * support) / sum(support) AS rw,
  sum(f1 * support) / sum(support) AS fw FROM m_m GROUP BY model)
SELECT model, cls AS row, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1, CAST(support AS BIGINT) AS support FROM m_m
UNION ALL SELECT model, 'accuracy', NULL, NULL, {r6('acc')}, CAST(n AS BIGINT) FROM agg
UNION ALL SELECT model, 'macro avg', {r6('pm')}, {r6('rm')}, {r6('fm')}, CAST(n AS BIGINT) FROM agg
UNION ALL SELECT model, 'weighted avg', {r6('pw')}, {r6('rw')}, {r6('fw')}, CAST(n AS BIGINT) FROM agg"""
S["confusion_by_model"] = f"""WITH {_MM},
cnt AS (SELECT model, true_label, pred_label, count(*) AS n FROM mm GROUP BY ALL),
cls AS (SELECT DISTINCT model, c FROM (SELECT model, true_label AS c FROM cnt UNION ALL SELECT model, pred_label FROM cnt) WHERE c IS NOT NULL),
cm AS (SELECT a.model, a.c AS true_label, b.c AS pred_label, coalesce(cnt.n, 0) AS n FROM cls a JOIN cls b ON a.model = b.model
       LEFT JOIN cnt ON cnt.model = a.model AND cnt.true_label = a.c AND cnt.pred_label = b.c)
SELECT model, true_label, pred_label, CAST(n AS BIGINT) AS n,
  {r6('CASE WHEN sum(n) OVER w > 0 THEN CAST(n AS DOUBLE) / sum(n) OVER w ELSE 0.0 END')} AS rate
FROM cm WINDOW w AS (PARTITION BY model, true_label)"""
S["domain_comparison"] = f"""WITH dd AS (
  SELECT CASE WHEN l_linestatus = 'F' THEN 'in' ELSE 'cross' END AS domain, l_returnflag AS true_label,
         CASE WHEN l_discount >= 0.05 THEN 'R' ELSE 'N' END AS pred_label FROM lineitem),{metrics_ctes('dd', 'domain')}
SELECT 'discount_rule' AS model, domain, metric, {r6('value')} AS value FROM m_sum UNPIVOT (value FOR metric IN ({', '.join(_METRICS)}))"""
S["log_loss_weighted"] = """WITH x AS (
  SELECT label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL),
y AS (SELECT label, list_transform(e, lambda v: exp(v - list_max(e))) AS ex FROM x),
z AS (SELECT label, least(greatest(ex[label + 1] / list_sum(ex), 1e-15), 1 - 1e-15) AS p,
             count(*) OVER () / (1.0::DOUBLE * count(*) OVER (PARTITION BY label)) AS w FROM y)
SELECT round(sum(-ln(p) * w) / sum(w), 6) AS log_loss FROM z"""
S["labels_last_wins_join"] = """SELECT o.o_orderkey, e.label FROM orders o JOIN (
  SELECT user_id, arg_max(event_type, event_id) AS label FROM events GROUP BY user_id) e ON o.o_custkey = e.user_id"""
S["topic_filter_lists"] = f"""SELECT doc_id, source FROM documents WHERE coalesce(lower(source) IN ('src3', 'src7'), false)
  OR coalesce(regexp_matches(lower(text), 'thing|leaux|schein'), false)"""
S["json_variant"] = """WITH shaped AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ',{"k":null},{"x":1}]'
         WHEN 2 THEN '{"x":2}' ELSE '{"k":null}' END AS j FROM events),
lists AS (SELECT event_id, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) ELSE [CAST(j AS JSON)] END AS a FROM shaped),
rows AS (SELECT event_id, unnest(range(len(a))) AS pos, unnest(a) AS v FROM lists)
SELECT event_id, CAST(pos AS INTEGER) AS pos, list_contains(json_keys(v), 'k') AS present, json_extract_string(v, '$.k') AS k FROM rows"""

S["log_loss"] = """WITH x AS (SELECT label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
y AS (SELECT label, list_transform(e, lambda v: exp(v - list_max(e))) AS ex FROM x),
z AS (SELECT label, ex[label + 1] / list_sum(ex) AS p FROM y)
SELECT round(avg(-ln(least(greatest(p, 1e-15), 1 - 1e-15))), 6) AS log_loss FROM z"""

# ---------------------------------------------------------------- terms / tf-idf / NB
_C = f"c AS (SELECT doc_id, {clean('text')} AS clean_text FROM documents)"
S["token_counts"] = f"""WITH {_C},{terms_cte('c', 'tf', n_max=1)}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM tf GROUP BY term"""
S["bigrams"] = f"""WITH {_C},{terms_cte('c', 'tf', n_max=2)}
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total_tf FROM tf WHERE contains(term, ' ') GROUP BY term"""

_TF = f"{_SPLIT},{tfidf_ctes('split')}"
S["vocabulary"] = f"{_TF}\nSELECT term, df, total_tf, {r6('idf')} AS idf FROM vocab"
S["tfidf_weights"] = f"{_TF}\nSELECT doc_id, term, tf, {r6('weight')} AS weight FROM tfw"

_NB = f"{_TF},{nb_ctes('split')}"
S["nb_predict"] = f"""{_NB},
testdocs AS (SELECT doc_id, label_id FROM split WHERE split = 'test'),
testlong AS (SELECT * FROM tfw WHERE split = 'test'),{nb_predict_ctes('testdocs', 'testlong')}
SELECT t.doc_id, t.label_id AS true_id, p.pred_id FROM testdocs t JOIN nbpred p ON t.doc_id = p.doc_id"""

S["nb_probabilities"] = f"""{_NB},
testdocs AS (SELECT doc_id, label_id FROM split WHERE split = 'test'),
testlong AS (SELECT * FROM tfw WHERE split = 'test'),{nb_predict_ctes('testdocs', 'testlong')},
odds AS (SELECT doc_id, label_id, exp(score - max(score) OVER (PARTITION BY doc_id)) AS o FROM nbpred_scores)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY label_id) - 1 AS INTEGER) AS class_id,
  {r6('o / sum(o) OVER (PARTITION BY doc_id)')} AS p FROM odds"""

S["top_features"] = f"""{_NB}
SELECT label_id, CAST(rank AS INTEGER) AS rank, term, {r6('theta')} AS theta FROM (
  SELECT label_id, term, theta, row_number() OVER (PARTITION BY label_id ORDER BY round(theta, 9) DESC, term) AS rank
  FROM theta) WHERE rank <= 10"""

S["fixed_length_encode"] = f"""WITH {_C},
toks AS (SELECT doc_id, list_filter(string_split(clean_text, ' '), lambda w: w <> '') AS t FROM c),
win AS (SELECT doc_id, t, unnest(range(greatest(CAST(ceil(len(t) / 128.0) AS BIGINT), 1))) AS chunk FROM toks),
cut AS (SELECT doc_id, chunk, len(t) AS n, t[chunk * 128 + 1 : chunk * 128 + 128] AS w FROM win)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk,
  list_resize(list_transform(w, lambda x: CAST({hkey(42, 'x')} % 2147483645 + 2 AS INTEGER)), 128, 0) AS input_ids,
  list_resize(list_transform(w, lambda x: 1), 128, 0) AS attention_mask,
  CAST(n AS INTEGER) AS n_tokens
FROM cut"""


def _gap(reverse: bool = False, source: str = "en", target: str = "other"):
    src_split = split_cte("src", "split", 20, 0)
    a, b = ("<>", "=") if reverse else ("=", "<>")
    return f"""WITH {PREPARED},
src AS (SELECT * FROM cleaned WHERE lang {a} 'en'),
tgt AS (SELECT * FROM cleaned WHERE lang {b} 'en'),{src_split},{tfidf_ctes('split')},{nb_ctes('split')},
scored AS (SELECT doc_id, label_id, 'in' AS domain, clean_text FROM split WHERE split = 'test'
           UNION ALL SELECT doc_id, label_id, 'cross', clean_text FROM tgt),
{terms_cte('scored', 'stf').lstrip()},
sraw AS (SELECT a.doc_id, a.term, (1 + ln(a.tf)) * v.idf AS w FROM stf a JOIN vocab v ON a.term = v.term),
slong AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM sraw),
{nb_predict_ctes('scored', 'slong').lstrip()},
pt AS (SELECT s.domain, s.label_id AS true_label, p.pred_id AS pred_label FROM scored s JOIN nbpred p ON s.doc_id = p.doc_id),
{metrics_ctes('pt', 'domain').lstrip()}
SELECT 'multinomial_nb' AS model, '{source}' AS source, '{target}' AS target,
  {r6("max(accuracy) FILTER (WHERE domain = 'in')")} AS in_dist_accuracy,
  {r6("max(f1_macro) FILTER (WHERE domain = 'in')")} AS in_dist_f1_macro,
  {r6("max(accuracy) FILTER (WHERE domain = 'cross')")} AS cross_accuracy,
  {r6("max(f1_macro) FILTER (WHERE domain = 'cross')")} AS cross_f1_macro,
  {r6("max(f1_macro) FILTER (WHERE domain = 'in') - max(f1_macro) FILTER (WHERE domain = 'cross')")} AS generalization_gap_f1
FROM m_sum"""


S["generalization_gap"] = _gap()
S["generalization_gap_bidirectional"] = f"({_gap()})\nUNION ALL\n({_gap(True, 'other', 'en')})"


def _h(expr):
    return f"('0x' || substr(md5({expr}), 1, 8))::BIGINT"


# draws of the synthetic rows, from cnt (label, n_c) and tgt (t)
_SYN = f"""
syn AS (SELECT c.label, c.n_c, unnest(range(tgt.t - c.n_c)) AS syn_idx FROM cnt c, tgt WHERE tgt.t > c.n_c),
syn2 AS (SELECT label, syn_idx, n_c,
  {_h("'42:base:' || CAST(label AS VARCHAR) || ':' || CAST(syn_idx AS VARCHAR)")} % n_c AS base_rank,
  {_h("'42:nn:' || CAST(label AS VARCHAR) || ':' || CAST(syn_idx AS VARCHAR)")} % greatest(1, least(5, n_c - 1)) AS slot,
  CAST({_h("'42:lam:' || CAST(label AS VARCHAR) || ':' || CAST(syn_idx AS VARCHAR)")} AS DOUBLE) / 4294967296.0 AS lam
  FROM syn)""".lstrip()

S["smote_embeddings"] = f"""WITH e AS (
  SELECT vec_id AS rid, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec FROM embeddings),
cnt AS (SELECT label, count(*) AS n_c FROM e GROUP BY label),
tgt AS (SELECT max(n_c) AS t FROM cnt),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hkey(42, 'rid')}, rid) - 1 AS rk FROM e),
{_SYN},
bases AS (SELECT DISTINCT s.label, r.rid AS qid, r.vec, s.base_rank FROM syn2 s JOIN r ON r.label = s.label AND r.rk = s.base_rank),
knn AS (SELECT b.label, b.qid, o.rid AS nid, o.vec AS nvec,
  row_number() OVER (PARTITION BY b.label, b.qid ORDER BY list_distance(b.vec, o.vec), o.rid) - 1 AS slot
  FROM bases b JOIN e o ON o.label = b.label AND o.rid <> b.qid)
SELECT s.label, s.syn_idx, b.qid AS base_id, k.nid AS nn_id, round(s.lam, 6) AS lam,
  list_transform(list_zip(b.vec, k.nvec), lambda p: round(p[1] + s.lam * (p[2] - p[1]), 6)) AS vec
FROM syn2 s JOIN bases b ON b.label = s.label AND b.base_rank = s.base_rank
JOIN knn k ON k.label = s.label AND k.qid = b.qid AND k.slot = s.slot
UNION ALL SELECT s.label, s.syn_idx, b.qid, b.qid, round(s.lam, 6), list_transform(b.vec, lambda v: round(v, 6))
FROM syn2 s JOIN bases b ON b.label = s.label AND b.base_rank = s.base_rank WHERE s.n_c = 1"""

S["smote_tfidf"] = f"""{_TF},
ids AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS i FROM vocab),
e AS (SELECT doc_id AS rid, label_id AS label FROM split WHERE split = 'train'),
x AS (SELECT t.doc_id AS rid, t.label_id AS label, ids.i, t.weight AS w FROM tfw t JOIN ids ON t.term = ids.term WHERE t.split = 'train'),
sq AS (SELECT rid, sum(w * w) AS s FROM x GROUP BY rid),
cnt AS (SELECT label, count(*) AS n_c FROM e GROUP BY label),
tgt AS (SELECT max(n_c) AS t FROM cnt),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hkey(42, 'rid')}, rid) - 1 AS rk FROM e),
{_SYN},
drawn AS (SELECT s.*, r.rid AS base_id FROM syn2 s JOIN r ON r.label = s.label AND r.rk = s.base_rank),
dots AS (SELECT a.rid AS qid, b.rid AS nid, sum(a.w * b.w) AS dot FROM x a JOIN x b ON a.i = b.i AND a.label = b.label
         WHERE a.rid <> b.rid AND a.rid IN (SELECT base_id FROM drawn) GROUP BY ALL),
near AS (SELECT b.base_id AS qid, o.rid AS nid,
  round(sqrt(greatest(coalesce(p.s, 0) + coalesce(q.s, 0) - 2 * coalesce(d.dot, 0), 0)), 6) AS dist
  FROM (SELECT DISTINCT base_id, label FROM drawn) b JOIN e o ON o.label = b.label AND o.rid <> b.base_id
  LEFT JOIN dots d ON d.qid = b.base_id AND d.nid = o.rid LEFT JOIN sq p ON p.rid = b.base_id LEFT JOIN sq q ON q.rid = o.rid),
ranked AS (SELECT qid, nid, row_number() OVER (PARTITION BY qid ORDER BY dist, nid) - 1 AS slot FROM near),
found AS (SELECT s.label, s.syn_idx, s.base_id, coalesce(k.nid, s.base_id) AS nn_id, s.lam
          FROM drawn s LEFT JOIN ranked k ON k.qid = s.base_id AND k.slot = s.slot),
mixed AS (SELECT f.label, f.syn_idx, x.i, (1 - f.lam) * x.w AS v FROM found f JOIN x ON x.rid = f.base_id
         UNION ALL SELECT f.label, f.syn_idx, x.i, f.lam * x.w FROM found f JOIN x ON x.rid = f.nn_id),
summed AS (SELECT label, syn_idx, i, sum(v) AS v FROM mixed GROUP BY ALL),
lists AS (SELECT label, syn_idx, list(CAST(i AS INTEGER) ORDER BY i) AS indices, list(round(v, 6) ORDER BY i) AS values
          FROM summed GROUP BY label, syn_idx)
SELECT f.label, f.syn_idx, f.base_id, f.nn_id, round(f.lam, 6) AS lam, coalesce(l.indices, []) AS indices, coalesce(l.values, []) AS values
FROM found f LEFT JOIN lists l ON l.label = f.label AND l.syn_idx = f.syn_idx"""

S["smote_class_counts"] = f"""{_SPLIT},
cnt AS (SELECT label_id, count(*) AS n FROM split WHERE split = 'train' GROUP BY label_id),
counts AS (SELECT 'train' AS split, label_id, n FROM cnt UNION ALL SELECT 'train_resampled', label_id, max(n) OVER () FROM cnt)
SELECT split, label_id, n, {r6('CAST(max(n) OVER (PARTITION BY split) AS DOUBLE) / min(n) OVER (PARTITION BY split)')} AS imbalance_ratio
FROM counts"""


# The optimum itself is not SQL: the oracle states what a fit must satisfy.
S["lr_certificate"] = """SELECT 'logistic_regression' AS model, true AS stationary, true AS not_worse_than_null, true AS ended_before_limit"""


def all_sql() -> dict[str, str]:
    return dict(S)


# C9 data flow: raw lower-cased text, exact 70/15/15 split, every 128-token
# window of every row; tokens are split on single spaces after the whitespace
# runs are collapsed (empty pieces are tokens, as in Spark).
S["transformer_arm_encode"] = f"""WITH {CORPUS},{split_cte('corpus', 'sp', 15, 15)},
raw AS (SELECT doc_id, label_id, split, regexp_replace(lower(text), {lit(RAW_WS_RUN)}, ' ', 'g') AS rt FROM sp),
toks AS (SELECT doc_id, label_id, split,
                CASE WHEN rt = '' THEN []::VARCHAR[] ELSE string_split(rt, ' ') END AS t FROM raw),
win AS (SELECT doc_id, label_id, split, t, unnest(range(greatest(CAST(ceil(len(t) / 128.0) AS BIGINT), 1))) AS chunk FROM toks),
cut AS (SELECT doc_id, label_id, split, chunk, len(t) AS n, t[chunk * 128 + 1 : chunk * 128 + 128] AS w FROM win)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk,
  list_resize(list_transform(w, lambda x: CAST({hkey(42, 'x')} % 2147483645 + 2 AS INTEGER)), 128, 0) AS input_ids,
  list_resize(list_transform(w, lambda x: 1), 128, 0) AS attention_mask,
  CAST(n AS INTEGER) AS n_tokens, label_id, split
FROM cut"""
