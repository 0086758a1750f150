"""SQL fragments (DuckDB dialect) mirroring the Catalyst expressions, built
from the same constants so Spark and the oracle cannot drift apart."""

from __future__ import annotations

from ..functions.text import (DEFAULT_STOPWORDS, HASHTAG_RE, HTML_RE, MENTION_RE, SEPARATOR_RUN_RE, URL_RE, WS,
                              WS_RUN_RE)
from ..operators.lemma import IRREGULAR, NOUN_RULES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(x: str) -> str:
    t = f"lower(coalesce({x}, ''))"
    t = f"regexp_replace({t}, {lit(URL_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(HTML_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(MENTION_RE)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(HASHTAG_RE)}, '\\1', 'g')"
    t = f"regexp_replace({t}, {lit(SEPARATOR_RUN_RE)}, ' ', 'g')"
    return f"trim({t})"


def word_count(x: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array(coalesce({x}, ''), {lit(WS_RUN_RE)}), "
            f"lambda w: w <> '')) AS INTEGER)")


def char_length(x: str) -> str:
    return f"CAST(length(coalesce({x}, '')) AS INTEGER)"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {lit('^[' + WS + ']+|[' + WS + ']+$')}, '', 'g')"


def hkey(seed, key: str, *tags: str) -> str:
    prefix = ":".join([str(seed), *tags]) + ":"
    return f"('0x' || substr(md5({lit(prefix)} || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


def r6(x: str) -> str:
    return f"round({x}, 6)"


CORPUS_ROWS = """
corpus AS (
  SELECT d.doc_id, d.text, d.source, d.lang, CAST(l.quality AS INTEGER) AS label_id,
         CASE CAST(l.quality AS INTEGER) WHEN 0 THEN 'fake' WHEN 1 THEN 'true'
              ELSE CAST(l.quality AS VARCHAR) END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  WHERE l.quality IS NOT NULL AND d.text IS NOT NULL)"""

CORPUS = f"""{CORPUS_ROWS},
cleaned AS (
  SELECT * FROM (SELECT *, {clean('text')} AS clean_text FROM corpus) WHERE length(clean_text) > 0)"""


def stop_words() -> str:
    return "[" + ", ".join(lit(w) for w in DEFAULT_STOPWORDS()) + "]"


def drop_stop_words(x: str) -> str:
    return (f"array_to_string(list_filter(string_split({x}, ' '), "
            f"lambda w: w <> '' AND NOT list_contains({stop_words()}, w)), ' ')")


def lemma_ctes(toks: str) -> str:
    """lemmas (token, lemma) of a table of tokens with document frequencies."""
    rules = " UNION ALL ".join(
        f"SELECT token, {i} AS ord, substr(token, 1, length(token) - {len(suf)}) || {lit(rep)} AS cand "
        f"FROM {toks} WHERE suffix(token, {lit(suf)}) AND length(token) > {len(suf)}"
        for i, (suf, rep) in enumerate(NOUN_RULES, start=1))
    exceptions = ", ".join(f"({lit(a)}, {lit(b)})" for a, b in sorted(IRREGULAR.items()))
    return f"""
lex AS (SELECT token AS cand FROM {toks} WHERE df >= 2),
cands AS (SELECT token, 0 AS ord, token AS cand FROM {toks} UNION ALL {rules}),
best AS (SELECT token, cand FROM (
  SELECT c.token, c.cand, row_number() OVER (PARTITION BY c.token ORDER BY length(c.cand), c.ord) AS rn
  FROM cands c JOIN lex l ON c.cand = l.cand) WHERE rn = 1),
lemmas AS (
  SELECT t.token, coalesce(e.exc, b.cand, t.token) AS lemma
  FROM {toks} t LEFT JOIN best b ON t.token = b.token
  LEFT JOIN (VALUES {exceptions}) AS e(token, exc) ON t.token = e.token)"""


def prepared_ctes(src: str, keep: str) -> str:
    """cleaned (keep..., clean_text): rows of ``src`` (with doc_id, text) after
    cleaning, stop words and lemmas, empty ones dropped."""
    columns = ", ".join(f"n.{c.strip()}" for c in keep.split(","))
    return f"""
nostop AS (SELECT * EXCLUDE (text), {drop_stop_words(clean('text'))} AS t FROM {src}),
occ AS (SELECT doc_id, unnest(string_split(t, ' ')) AS token, unnest(range(len(string_split(t, ' ')))) AS pos
        FROM nostop WHERE t <> ''),
toks AS (SELECT token, count(DISTINCT doc_id) AS df FROM occ GROUP BY token),{lemma_ctes('toks')},
lemmatised AS (SELECT o.doc_id, string_agg(l.lemma, ' ' ORDER BY o.pos) AS clean_text
               FROM occ o JOIN lemmas l ON o.token = l.token GROUP BY o.doc_id),
cleaned AS (SELECT {columns}, l.clean_text FROM nostop n JOIN lemmatised l ON n.doc_id = l.doc_id)"""


PREPARED = f"{CORPUS_ROWS},{prepared_ctes('corpus', 'doc_id, source, lang, label_id, label')}"


def split_cte(src: str, name: str, test_pct: int = 20, val_pct: int = 10, label: str = "label_id",
              key: str = "doc_id", seed: int = 42) -> str:
    return f"""
{name}_rk AS (
  SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {hkey(seed, key)}, {key}) - 1 AS _rk,
         count(*) OVER (PARTITION BY {label}) AS _nc FROM {src}),
{name} AS (
  SELECT * EXCLUDE (_rk, _nc),
         CASE WHEN _rk < (_nc * {test_pct} + 99) // 100 THEN 'test'
              WHEN _rk < (_nc * {test_pct + val_pct} + 99) // 100 THEN 'val'
              ELSE 'train' END AS split
  FROM {name}_rk)"""


def terms_cte(src: str, name: str, n_max: int = 2, id_col: str = "doc_id", extra: str = "") -> str:
    """(id, [extra], term, tf) with unigrams of >=2 letters and bigrams."""
    grams = "t"
    if n_max >= 2:
        grams = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
    ex = f", {extra}" if extra else ""
    return f"""
{name}_tok AS (
  SELECT {id_col}{ex}, list_filter(string_split(clean_text, ' '), lambda w: length(w) >= 2) AS t FROM {src}),
{name} AS (
  SELECT {id_col}{ex}, term, CAST(count(*) AS INTEGER) AS tf
  FROM (SELECT {id_col}{ex}, unnest({grams}) AS term FROM {name}_tok)
  GROUP BY ALL)"""


def tfidf_ctes(split_name: str = "split", max_features: int = 10000) -> str:
    """vocab (term, df, total_tf, idf) fitted on train rows of ``split_name``;
    tfw (doc_id, label_id, split, term, tf, weight) for all rows."""
    return f"""
{terms_cte(split_name, 'tfall', extra='label_id, split')},
ntrain AS (SELECT count(*) AS n FROM {split_name} WHERE split = 'train'),
vstats AS (SELECT term, count(*) AS df, sum(tf) AS total_tf FROM tfall WHERE split = 'train' GROUP BY term),
vocab AS (
  SELECT term, df, CAST(total_tf AS BIGINT) AS total_tf,
         ln(CAST(1 + n AS DOUBLE) / CAST(1 + df AS DOUBLE)) + 1 AS idf
  FROM vstats, ntrain
  WHERE df >= 2 AND CAST(df AS DOUBLE) <= CAST(0.95 AS DOUBLE) * n
  ORDER BY total_tf DESC, term LIMIT {max_features}),
tfraw AS (
  SELECT a.doc_id, a.label_id, a.split, a.term, a.tf, (1 + ln(a.tf)) * v.idf AS w
  FROM tfall a JOIN vocab v ON a.term = v.term),
tfw AS (
  SELECT doc_id, label_id, split, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
  FROM tfraw)"""


def nb_ctes(split_name: str = "split", alpha: float = 1.0) -> str:
    """theta (label_id, term, theta), prior (label_id, log_prior) from train rows."""
    return f"""
cnt AS (SELECT label_id, count(*) AS n_c FROM {split_name} WHERE split = 'train' GROUP BY label_id),
tot AS (SELECT sum(n_c) AS n, count(*) AS k FROM cnt),
cw AS (SELECT label_id, n_c, n / (k * n_c) AS sw FROM cnt, tot),
prior AS (SELECT label_id, ln((sw * n_c) / sum(sw * n_c) OVER ()) AS log_prior FROM cw),
fc AS (SELECT t.label_id, t.term, sum(cw.sw * t.weight) AS fc
       FROM tfw t JOIN cw ON t.label_id = cw.label_id WHERE t.split = 'train' GROUP BY ALL),
grid AS (SELECT v.term, cw.label_id FROM vocab v, cw),
full_fc AS (SELECT g.label_id, g.term, coalesce(f.fc, 0.0) AS fc
            FROM grid g LEFT JOIN fc f ON g.label_id = f.label_id AND g.term = f.term),
theta AS (SELECT label_id, term,
                 ln(fc + {alpha}) - ln(sum(fc) OVER (PARTITION BY label_id) + {alpha} * count(*) OVER (PARTITION BY label_id)) AS theta
          FROM full_fc)"""


def nb_predict_ctes(docs: str, long: str, name: str = "nbpred") -> str:
    """argmax over classes of prior + sum(weight * theta); ties -> smallest id."""
    return f"""
{name}_contrib AS (
  SELECT l.doc_id, th.label_id, sum(l.weight * th.theta) AS s
  FROM {long} l JOIN theta th ON l.term = th.term GROUP BY ALL),
{name}_scores AS (
  SELECT d.doc_id, p.label_id, p.log_prior + coalesce(c.s, 0.0) AS score
  FROM {docs} d CROSS JOIN prior p
  LEFT JOIN {name}_contrib c ON c.doc_id = d.doc_id AND c.label_id = p.label_id),
{name} AS (
  SELECT doc_id, CAST(label_id AS INTEGER) AS pred_id FROM (
    SELECT doc_id, label_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label_id) AS rn
    FROM {name}_scores) WHERE rn = 1)"""


def metrics_ctes(pred: str, group: str | None = None, prefix: str = "m") -> str:
    """Per-class and summary metrics from a (group?, true_label, pred_label) table."""
    g = f"{group}, " if group else ""
    gj = (lambda a, b: f"{a}.{group} = {b}.{group} AND ") if group else (lambda a, b: "")
    return f"""
{prefix}_cnt AS (SELECT {g}true_label, pred_label, count(*) AS n FROM {pred} GROUP BY ALL),
{prefix}_cls AS (SELECT DISTINCT {g}cls FROM (SELECT {g}true_label AS cls FROM {prefix}_cnt
                 UNION ALL SELECT {g}pred_label FROM {prefix}_cnt) WHERE cls IS NOT NULL),
{prefix}_pc AS (
  SELECT {('c.' + group + ', ') if group else ''}c.cls,
         coalesce((SELECT sum(n) FROM {prefix}_cnt x WHERE {gj('x', 'c')}x.true_label = c.cls AND x.pred_label = c.cls), 0) AS tp,
         coalesce((SELECT sum(n) FROM {prefix}_cnt x WHERE {gj('x', 'c')}x.true_label = c.cls), 0) AS support,
         coalesce((SELECT sum(n) FROM {prefix}_cnt x WHERE {gj('x', 'c')}x.pred_label = c.cls), 0) AS predicted
  FROM {prefix}_cls c),
{prefix}_m AS (
  SELECT {g}cls, tp, support,
         CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall,
         CASE WHEN support + predicted > 0 THEN 2.0::DOUBLE * tp / (support + predicted) ELSE 0.0 END AS f1
  FROM {prefix}_pc),
{prefix}_sum AS (
  SELECT {g}CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy,
         avg(precision) AS precision_macro, sum(precision * support) / sum(support) AS precision_weighted,
         avg(recall) AS recall_macro, sum(recall * support) / sum(support) AS recall_weighted,
         avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted
  FROM {prefix}_m {('GROUP BY ' + group) if group else ''})"""
