"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from tonewise.functions.format import LANGUAGE_NAMES
from tonewise.functions.tables import CYRILLIC_MARKS, FUNCTION_WORDS, LATIN, LATIN_MARKS, LEET, LOOKALIKE_FROM, LOOKALIKE_TO, SCRIPTS
from tonewise.plans.cases import CONFLICTS, TEXTS
from tonewise.plans.models import SHARPNESS
from tonewise.plans.queries import CACHE_NOW
from tonewise.sources.timeline import CACHE_ENTRIES, CACHE_SECONDS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normalized(source: str) -> str:
    """CTEs that end in ``norm`` (all columns of ``source`` and ``normalized``); the fixtures are stable under NFKC."""
    leet = "CASE x " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in LEET.items()) + " ELSE x END"
    return rf"""
n1 AS (SELECT *, lower(regexp_replace(coalesce(text, ''), '[\x{{AD}}\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}-\x{{206F}}\x{{FEFF}}]', '', 'g')) AS t FROM {source}),
n2 AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(t, '(?:https?://|www\.)\S+', ' ', 'g'),
  '@[\p{{L}}\p{{N}}_]+', ' ', 'g'), '#([\p{{L}}\p{{N}}_]+)', '\1', 'g') AS t) FROM n1),
n3 AS (SELECT * EXCLUDE (c) REPLACE (array_to_string(list_filter(c, lambda x, i: i <= 2 OR NOT (x = c[i-1] AND x = c[i-2])), '') AS t)
  FROM (SELECT *, string_split(t, '') AS c FROM n2)),
n4 AS (SELECT * EXCLUDE (p) REPLACE (CASE WHEN regexp_matches(t, '[a-z] [a-z] [a-z]') THEN array_to_string(list_filter(string_split(p, ''),
    lambda x, i: i > 5 AND i <= length(p) - 5 AND NOT (x = ' ' AND regexp_full_match(substring(p, i - 2, 5), '[^a-z][a-z] [a-z][^a-z]')
      AND (regexp_full_match(substring(p, i - 4, 5), '[^a-z][a-z] [a-z][^a-z]') OR regexp_full_match(substring(p, i, 5), '[^a-z][a-z] [a-z][^a-z]')))), '')
    ELSE t END AS t) FROM (SELECT *, '#####' || t || '#####' AS p FROM n3)),
n5 AS (SELECT * REPLACE (array_to_string(list_transform(list_filter(string_split_regex(t, '[\s\x1c-\x1f\x{{85}}\x{{A0}}]+'), lambda w: w <> ''),
    lambda w: CASE WHEN regexp_matches(w, '[a-z]') AND regexp_matches(w, '[\x{{370}}-\x{{4FF}}]') THEN translate(w, '{LOOKALIKE_FROM}', '{LOOKALIKE_TO}') ELSE w END), ' ') AS t) FROM n4),
norm AS (SELECT * EXCLUDE (t, c), CASE WHEN regexp_matches(t, '[a-z][0134578@$!|*][a-z]') THEN array_to_string(list_transform(c,
    lambda x, i: CASE WHEN i > 1 AND c[i-1] BETWEEN 'a' AND 'z' AND c[i+1] BETWEEN 'a' AND 'z' THEN {leet} ELSE x END), '') ELSE t END AS normalized
  FROM (SELECT *, string_split(t, '') AS c FROM n5))"""


def _class(ranges) -> str:
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)


def detected(source: str, guess: str = "NULL") -> str:
    """CTEs that end in ``det`` (all columns of ``source`` and ``language``)."""
    buckets: dict[str, list] = {"latin": list(LATIN)}
    for code, lo, hi in SCRIPTS:
        buckets.setdefault(code, []).append((lo, hi))
    every = [r for v in buckets.values() for r in v]
    classes = {k: f"[{_class(v)}]" for k, v in buckets.items()} | {"other": f"[^{_class(every)}]"}
    scripts = ", ".join(f"{{'n': length(l) - length(regexp_replace(l, '{c}', '', 'g')), 'at': -length(regexp_extract(l, '^{('[' + c[2:] if c[1] == '^' else '[^' + c[1:])}*')), 'k': '{k}'}}" for k, c in classes.items())
    cyrillic = " ".join(f"WHEN regexp_matches(lower(text), '[{m}]') THEN '{k}'" for k, m in CYRILLIC_MARKS)
    marks = " ".join(f"WHEN regexp_matches(text, '[{m}]') THEN '{k}'" for k, m in LATIN_MARKS)
    votes = ", ".join(
        f"{{'n': len(list_intersect(w, [{', '.join(map(_quoted, v.split()))}])), 'rank': {-i}, 'k': '{k}'}}" for i, (k, v) in enumerate(FUNCTION_WORDS.items())
    )
    return rf"""
d1 AS (SELECT *, regexp_replace(coalesce(text, ''), '[^\p{{L}}]', '', 'g') AS l,
  list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{Nl}}\p{{No}}]+')) AS w FROM {source}),
d2 AS (SELECT *, CASE WHEN l = '' THEN NULL WHEN regexp_matches(l, '[{_class([r for k, v in buckets.items() if k != 'latin' for r in v])}]')
  THEN list_max([{scripts}]).k END AS script FROM d1),
det AS (SELECT * EXCLUDE (l, w, script), CASE WHEN coalesce(text, '') = '' THEN 'und'
  WHEN script = 'zh' AND regexp_matches(l, '[\x{{3040}}-\x{{30FF}}]') THEN 'ja' WHEN script = 'ru' THEN CASE {cyrillic} ELSE 'ru' END
  WHEN script IS NOT NULL AND script NOT IN ('latin', 'other') THEN script WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 3 THEN 'und'
  {marks} WHEN {guess} IS NOT NULL THEN left({guess}, 2) WHEN len(w) = 0 THEN 'und' ELSE list_max([{votes}]).k END AS language FROM d2)"""


LABELLED = "lab AS (SELECT d.doc_id AS row_id, d.text, l.toxic AS is_toxic, d.lang FROM documents d JOIN labels l USING (doc_id))"
SCORED = LABELLED + ", sc AS (SELECT *, ((row_id * 7919) % 1000)::DOUBLE / 2000.0::DOUBLE + 0.4::DOUBLE * is_toxic AS prob FROM lab)"
CORPUS = f"""{LABELLED}, {normalized("lab")},
sure AS (SELECT normalized FROM norm WHERE length(normalized) >= 2 GROUP BY 1 HAVING min(is_toxic) = max(is_toxic)),
corpus AS (SELECT * FROM norm WHERE normalized IN (SELECT normalized FROM sure) QUALIFY row_number() OVER (PARTITION BY normalized ORDER BY row_id) = 1)"""
POSTS = f"""p0 AS (SELECT d.source AS author, d.doc_id AS pos, d.text,
  ((d.doc_id * 7919) % 1000)::DOUBLE / 2000.0::DOUBLE + 0.4::DOUBLE * coalesce(l.toxic, 0) AS prob FROM documents d LEFT JOIN labels l USING (doc_id)),
{detected("p0")},
posts AS (SELECT author, pos, text, language, round(prob * 100, 2) AS score,
  CASE language WHEN 'fr' THEN 40.0 WHEN 'de' THEN 62.5 ELSE 45.0 END::DOUBLE AS threshold FROM det),
vp AS (SELECT *, score >= threshold AS is_toxic FROM posts)"""
F1 = "CASE WHEN 2*tp+fp+fn > 0 THEN (2*tp)::DOUBLE / (2*tp+fp+fn) ELSE 0 END"
SWEEP = f"""{SCORED},
cuts AS (SELECT unnest(range(5, 96)) AS cut),
sw AS (SELECT lang, cut, sum(CASE WHEN hit THEN is_toxic ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN hit THEN 1 - is_toxic ELSE 0 END)::BIGINT AS fp,
  sum(CASE WHEN hit THEN 0 ELSE is_toxic END)::BIGINT AS fn FROM (SELECT *, round(prob * 100, 9) >= cut AS hit FROM sc, cuts) GROUP BY GROUPING SETS ((lang, cut), (cut))),
f AS (SELECT *, {F1} AS f1 FROM sw),
best AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, cut) = 1),
tuned AS (SELECT NULL::VARCHAR AS lang, cut::DOUBLE AS cut, f1 FROM best WHERE lang IS NULL UNION ALL
  SELECT b.lang, b.cut::DOUBLE, b.f1 FROM best b JOIN f ON f.lang = b.lang AND f.cut = (SELECT cut FROM best WHERE lang IS NULL)
  JOIN (SELECT lang FROM sc GROUP BY lang HAVING count(*) >= 50 AND count(DISTINCT is_toxic) = 2) g ON g.lang = b.lang WHERE b.f1 > f.f1 + 0.002)"""
CONFUSION = """count(*)::BIGINT AS n, coalesce(sum(is_toxic * p), 0)::BIGINT AS tp, coalesce(sum((1 - is_toxic) * p), 0)::BIGINT AS fp,
  coalesce(sum(is_toxic * (1 - p)), 0)::BIGINT AS fn, coalesce(sum((1 - is_toxic) * (1 - p)), 0)::BIGINT AS tn"""
FN1 = "CASE WHEN 2*tn+fp+fn > 0 THEN (2*tn)::DOUBLE / (2*tn+fp+fn) ELSE 0 END"
TERMS = rf"""{LABELLED}, {normalized("lab")},
ws AS (SELECT row_id AS doc_id, list_filter(regexp_extract_all(normalized, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2) AS w FROM norm),
tm AS (SELECT doc_id, unnest(w) AS term FROM ws UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) FROM ws),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tm GROUP BY 1, 2),
vo AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT count(*) FROM lab))"""
CHARS = f"""{LABELLED}, {normalized("lab")},
cw AS (SELECT row_id AS doc_id, unnest(list_filter(string_split(normalized, ' '), lambda x: x <> '')) AS w FROM norm),
cg AS (SELECT doc_id, w, unnest(range(2, least(5, length(w) + 2) + 1)) AS n FROM cw),
ct AS (SELECT DISTINCT doc_id, substring(' ' || w || ' ', i::BIGINT, n::BIGINT) AS term FROM (SELECT *, unnest(range(1, length(w) + 4 - n)) AS i FROM cg))"""
COMPACT = """CASE WHEN x >= 1e9 THEN (CASE WHEN x / 1e9 < 100 THEN regexp_replace(printf('%.1f', round(x / 1e9, 1)), '\\.0$', '') ELSE printf('%.0f', round(x / 1e9)) END) || 'B'
 WHEN x >= 1e6 THEN (CASE WHEN x / 1e6 < 100 THEN regexp_replace(printf('%.1f', round(x / 1e6, 1)), '\\.0$', '') ELSE printf('%.0f', round(x / 1e6)) END) || 'M'
 WHEN x >= 1e3 THEN (CASE WHEN x / 1e3 < 100 THEN regexp_replace(printf('%.1f', round(x / 1e3, 1)), '\\.0$', '') ELSE printf('%.0f', round(x / 1e3)) END) || 'K'
 ELSE printf('%.0f', x) END"""
AGO = "date_diff('microsecond', ts::TIMESTAMP, TIMESTAMP '2025-06-15 12:00:00')"


CASES = "src AS (SELECT * FROM (VALUES " + ", ".join(f"({-1 - i}::BIGINT, {'NULL' if t is None else _quoted(t)})" for i, t in enumerate(TEXTS)) + ") t(case_id, text) UNION ALL SELECT doc_id, text FROM documents)"
CLASHING = "lab AS (SELECT d.doc_id AS row_id, d.text, l.toxic AS is_toxic FROM documents d JOIN labels l USING (doc_id) UNION ALL VALUES " + ", ".join(f"({-1 - i}::BIGINT, {_quoted(t.replace(chr(9), '~'))}, {y}::INT)" for i, (t, y) in enumerate(CONFLICTS)).replace("~", "' || chr(9) || '") + ")"
JUDGED = rf"""src AS (SELECT d.doc_id, d.text, d.lang, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), {normalized("src")},
tm AS MATERIALIZED (SELECT DISTINCT doc_id, toxic, unnest(list_filter(regexp_extract_all(normalized, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) >= 2)) AS term FROM norm),
cl AS (SELECT count(*) FILTER (toxic = 1) AS t, count(*) FILTER (toxic = 0) AS c FROM src),
wt AS (SELECT term, ln((sum(toxic) + 1) / (any_value(t) + 2.0::DOUBLE)) - ln((count(*) - sum(toxic) + 1) / (any_value(c) + 2.0::DOUBLE)) AS w
  FROM tm, cl WHERE toxic IS NOT NULL GROUP BY term HAVING count(*) >= 2),
mn AS (SELECT doc_id, avg(w) AS m FROM tm JOIN wt USING (term) GROUP BY doc_id),
pr AS (SELECT src.*, round(100 / (1 + exp(-{SHARPNESS}::DOUBLE * coalesce(m, 0))), 2) AS score FROM src LEFT JOIN mn USING (doc_id)),
{detected("pr")},
vd AS (SELECT *, CASE language WHEN 'fr' THEN 40.0 WHEN 'de' THEN 62.5 ELSE 45.0 END::DOUBLE AS threshold FROM det)"""
GUESSED = r"""sp AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' AS t, text, lang FROM documents WHERE text IS NOT NULL),
gr AS (SELECT doc_id, substring(t, i::BIGINT, 3) AS gram, count(*) AS n FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM sp) GROUP BY ALL),
kn AS (SELECT sp.doc_id, sp.lang FROM sp JOIN labels USING (doc_id) WHERE lang IS NOT NULL),
pf AS (SELECT lang, gram, sum(n) AS n FROM gr JOIN kn USING (doc_id) GROUP BY lang, gram QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) <= 1000),
vo AS (SELECT DISTINCT gram FROM pf),
ls AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM kn)::DOUBLE) AS prior FROM kn GROUP BY lang),
lt AS (SELECT lang, sum(n) AS total FROM pf GROUP BY lang),
lp AS (SELECT lang, gram, ln((coalesce(n, 0) + 1)::DOUBLE / (total + (SELECT count(*) FROM vo))) AS lp FROM vo CROSS JOIN lt LEFT JOIN pf USING (lang, gram)),
sm AS (SELECT doc_id, lang, sum(n * lp) AS s, sum(n) AS k FROM gr JOIN lp USING (gram) GROUP BY doc_id, lang),
ss AS (SELECT d.doc_id, ls.lang, (prior + coalesce(s, 0)) / greatest(coalesce(k, 0), 1) AS score, coalesce(k, 0) AS k
  FROM documents d CROSS JOIN ls LEFT JOIN sm ON sm.doc_id = d.doc_id AND sm.lang = ls.lang),
gs AS (SELECT d.doc_id, d.text, g.guess FROM documents d LEFT JOIN (SELECT doc_id, lang AS guess FROM ss WHERE k > 0
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1) g USING (doc_id))"""
#: The same with whole profiles.
GUESSED_WHOLE = GUESSED.replace(" QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, gram) <= 1000", "")
LATEST = """latest AS (SELECT user_id::VARCHAR AS "user", ts::TIMESTAMP AS ts, event_id, floor(value)::INT AS n_posts FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"""
ANSWERS = """WITH c AS (SELECT conv_id * 100 + turn AS request, turn % 5 AS k, text FROM conversations)
SELECT request, (CASE WHEN k IN (2, 3) OR (k < 2 AND NOT regexp_matches(coalesce(text, ''), '\\S')) THEN 400 ELSE 200 END)::INT AS status,
  (CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END)::INT AS n, CASE WHEN k IN (0, 1, 4) THEN 25.0::DOUBLE END AS score,
  CASE WHEN k < 2 THEN text WHEN k = 4 THEN 'None' END AS text, CASE k WHEN 2 THEN '"texts" must be a list of strings' WHEN 3 THEN 'no text provided' END AS error FROM c"""


def oracle_sql() -> dict[str, str]:
    names = "CASE language " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_NAMES.items()) + " WHEN 'und' THEN 'Unknown' ELSE upper(language) END"
    docs = "src AS (SELECT doc_id, text, lang FROM documents)"
    return {
        "language_toxicity": f"WITH src AS (SELECT d.doc_id, d.text, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), {detected('src')}, {normalized('det')} SELECT language, count(*)::BIGINT AS docs, round(avg(length(normalized)), 6) AS mean_length, round(avg(toxic), 6) AS toxic_share FROM norm GROUP BY language",
        "normalize_documents": f"WITH {docs}, {normalized('src')} SELECT doc_id, normalized FROM norm",
        "detect_language_documents": f"WITH {docs}, {detected('src')} SELECT doc_id, language FROM det",
        "language_confusion": f"WITH {docs}, {detected('src')} SELECT lang, language, count(*)::BIGINT AS n FROM det GROUP BY 1, 2",
        "corpus_prepare": f"WITH {CORPUS} SELECT row_id, normalized, is_toxic, lang FROM corpus",
        "label_conflicts": f"WITH {CLASHING}, {normalized('lab')} SELECT row_id, normalized AS key, is_toxic FROM norm QUALIFY min(is_toxic) OVER (PARTITION BY normalized) <> max(is_toxic) OVER (PARTITION BY normalized)",
        "normalize_cases": f"WITH {CASES}, {normalized('src')} SELECT case_id, normalized FROM norm",
        "language_cases": f"WITH {CASES}, {detected('src')} SELECT case_id, language FROM det",
        "analyze_answers": ANSWERS,
        "dedup_keep_first": "SELECT doc_id AS row_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
        "quota_per_lang_label": f"WITH {LABELLED} SELECT row_id, lang, is_toxic FROM lab QUALIFY row_number() OVER (PARTITION BY lang, is_toxic ORDER BY row_id) <= 20",
        "corpus_stats": f"WITH {LABELLED} SELECT count(*)::BIGINT AS rows, count(DISTINCT lang)::BIGINT AS languages, round(avg(is_toxic), 6) AS toxic_share FROM lab",
        "stratum_counts": f"WITH {LABELLED}, c AS (SELECT lang || '_' || is_toxic AS s, count(*) AS n FROM lab GROUP BY 1) SELECT CASE WHEN n >= 5 THEN s ELSE 'rare' END AS stratum, sum(n)::BIGINT AS n FROM c GROUP BY 1",
        "stratified_split_counts": f"WITH {LABELLED}, c AS (SELECT lang || '_' || is_toxic AS s, count(*) AS n FROM lab GROUP BY 1), st AS (SELECT CASE WHEN n >= 3 THEN s ELSE 'rare' END AS stratum, sum(n)::BIGINT AS n FROM c GROUP BY 1), pl AS (SELECT stratum, (i::DOUBLE - 0.5::DOUBLE) / n::DOUBLE AS place FROM (SELECT stratum, n, unnest(range(1, n + 1)) AS i FROM st)) SELECT stratum, CASE WHEN place < 0.08::DOUBLE THEN 'test' WHEN place < 0.16::DOUBLE THEN 'val' ELSE 'train' END AS part, count(*)::BIGINT AS n FROM pl GROUP BY 1, 2",
        "language_list": "SELECT string_agg(lang, ',' ORDER BY lang) AS languages FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'und')",
        "canonical_languages": "SELECT CASE WHEN lang IS NULL THEN 'und' ELSE lower(left(lang, 2)) END AS lang, count(*)::BIGINT AS n FROM documents GROUP BY 1",
        "word_ngram_df": f"WITH {TERMS} SELECT term, df FROM vo",
        "char_ngram_df": f"WITH {CHARS} SELECT term, count(*)::BIGINT AS df FROM ct GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.9 * (SELECT count(*) FROM lab)",
        "tfidf_topk": f"WITH {TERMS}, raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0::DOUBLE + (SELECT count(*) FROM lab)) / (1 + df)) + 1) AS w FROM tf JOIN vo USING (term)), wt AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw) SELECT doc_id, term, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term)::INT AS nth FROM wt QUALIFY nth <= 10",
        "threshold_sweep": f"WITH {SWEEP} SELECT lang, cut::INT AS cut, tp, fp, fn, round(f1, 6) AS f1 FROM f WHERE lang IS NOT NULL",
        "tuned_thresholds": f"WITH {SWEEP} SELECT lang, cut, round(f1, 6) AS f1 FROM tuned",
        "eval_report": f"WITH {SWEEP}, j AS (SELECT sc.*, (round(prob * 100, 9) >= coalesce(t.cut, (SELECT cut FROM tuned WHERE lang IS NULL)))::INT AS p FROM sc LEFT JOIN tuned t ON t.lang = sc.lang), c AS (SELECT lang, grouping(lang) AS g, {CONFUSION} FROM j GROUP BY GROUPING SETS ((), (lang))) SELECT lang, n, tp, fp, fn, tn, round((tp + tn)::DOUBLE / n, 6) AS accuracy, round({F1}, 6) AS toxic_f1, round(({F1} + {FN1}) / 2, 6) AS macro_f1 FROM c WHERE g = 1 OR n >= 20",
        "roc_auc": f"WITH {SCORED}, r AS (SELECT is_toxic, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS k FROM sc), s AS (SELECT sum(k) FILTER (is_toxic = 1) AS k, count(*) FILTER (is_toxic = 1) AS p, count(*) FILTER (is_toxic = 0) AS n FROM r) SELECT round((k - p * (p + 1) / 2.0::DOUBLE) / (p * n), 6) AS roc_auc FROM s",
        "class_report": f"WITH {SCORED}, c AS (SELECT {CONFUSION} FROM (SELECT *, (prob >= 0.35::DOUBLE)::INT AS p FROM sc)), e AS (SELECT 'clean' AS label, tn::DOUBLE / (tn + fn) AS precision, tn::DOUBLE / (tn + fp) AS recall, {FN1} AS f1, tn + fp AS support FROM c UNION ALL SELECT 'toxic', tp::DOUBLE / (tp + fp), tp::DOUBLE / (tp + fn), {F1}, tp + fn FROM c), a AS (SELECT * FROM e UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM e UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM e) SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM a",
        "soft_vote_probs": f"WITH {SCORED} SELECT row_id, round((2 * prob + 2 * prob * prob + (1 - prob)) / 5, 6) AS prob FROM sc",
        "verdict_documents": f"WITH {POSTS} SELECT pos, score, language, threshold, is_toxic FROM vp",
        "profile_summary": f"WITH {POSTS} SELECT author, count(*)::BIGINT AS total, count(*) FILTER (is_toxic)::BIGINT AS toxic, count(*) FILTER (NOT is_toxic)::BIGINT AS safe, round(count(*) FILTER (is_toxic) * 100.0::DOUBLE / count(*), 1) AS toxic_ratio, round(avg(score), 1) AS average_score FROM vp GROUP BY author",
        "profile_languages": f"WITH {POSTS}, c AS (SELECT author, language, count(*) AS n, min(pos) AS f FROM vp GROUP BY 1, 2) SELECT author, string_agg(language || ':' || n, ',' ORDER BY n DESC, f) AS languages FROM c GROUP BY author",
        "language_shares": f"WITH {POSTS}, c AS (SELECT author, language, count(*)::BIGINT AS n, min(pos) AS f FROM vp WHERE language <> 'und' GROUP BY 1, 2), s AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY author) AS share FROM c QUALIFY row_number() OVER (PARTITION BY author ORDER BY n DESC, f) <= 6) SELECT author, language, n, round(share, 6) AS share, round(greatest(share, 3.0::DOUBLE), 6) AS width FROM s",
        "timeline_tabs": f"WITH {POSTS} SELECT author, count(*)::BIGINT AS total, count(*) FILTER (is_toxic)::BIGINT AS flagged, count(*) FILTER (NOT is_toxic)::BIGINT AS safe FROM vp GROUP BY author",
        "snapshot_cache_latest": "SELECT user_id::VARCHAR AS \"user\", event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "snapshot_cache_answers": f"WITH {LATEST} SELECT \"user\", event_id, date_diff('microsecond', ts, TIMESTAMP '{CACHE_NOW}') // 1000000 <= {CACHE_SECONDS} AS fresh FROM latest WHERE n_posts >= 20",
        "snapshot_cache_kept": f"WITH {LATEST} SELECT \"user\", event_id FROM latest ORDER BY ts DESC, \"user\" LIMIT {CACHE_ENTRIES}",
        "profile_json": f"WITH {POSTS}, sh AS (SELECT * FROM vp QUALIFY row_number() OVER (PARTITION BY author ORDER BY pos) <= 100), lc AS (SELECT author, language, count(*)::BIGINT AS n, min(pos) AS f FROM sh GROUP BY 1, 2), lm AS (SELECT author, list({{'language': language, 'n': n}} ORDER BY n DESC, f) AS languages FROM lc GROUP BY author), su AS (SELECT author, count(*)::BIGINT AS total, count(*) FILTER (is_toxic)::BIGINT AS toxic, list({{'pos': pos, 'full_text': text, 'toxicity': {{'score': score, 'is_toxic': is_toxic, 'language': language, 'threshold': threshold}}}} ORDER BY pos) AS posts, avg(score) AS a FROM sh GROUP BY author) SELECT author, to_json({{'author': author, 'summary': {{'total': total, 'toxic': toxic, 'safe': total - toxic, 'toxic_ratio': round(toxic * 100.0::DOUBLE / total, 1), 'average_score': round(a, 1), 'languages': languages}}, 'posts': posts}})::VARCHAR AS body FROM su JOIN lm USING (author)",
        "conversation_lines": "WITH l AS (SELECT conv_id, turn, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''), 1, 50) AS l FROM conversations) SELECT conv_id, turn, len(l)::INT AS n_lines, array_to_string(l, chr(10)) AS lines FROM l",
        "compact_counts": f"SELECT doc_id, {COMPACT} AS label FROM (SELECT doc_id, (n_chars * n_chars * 37)::DOUBLE AS x FROM documents)",
        "relative_times": f"WITH s AS (SELECT event_id, ts, ({AGO} // 1000000) AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN greatest(s, 1) || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' WHEN s < 604800 THEN (s // 86400) || 'd' WHEN year(ts) = 2025 THEN strftime(ts, '%b %-d') ELSE strftime(ts, '%b %-d, %Y') END AS label FROM s",
        "handles": "SELECT conv_id, turn, substring(regexp_replace(text, '[^A-Za-z0-9_]', '', 'g'), 1, 15) AS handle FROM conversations",
        "permalinks": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://twitter.com' || regexp_replace(url, '^https?:/+', '/') WHEN 1 THEN url ELSE 'https://twitter.com/someone/status/' || page_id END AS link FROM pages",
        "language_names": f"WITH {docs}, {detected('src')} SELECT doc_id, {names} AS name FROM det",
        "scored_documents": f"WITH {JUDGED} SELECT doc_id, score, score >= threshold AS is_toxic, language, threshold FROM vd",
        "holdout_report": f"WITH {JUDGED}, j AS (SELECT lang, toxic AS is_toxic, (score >= threshold)::INT AS p FROM vd WHERE toxic IS NOT NULL AND text IS NOT NULL), c AS (SELECT lang, grouping(lang) AS g, {CONFUSION} FROM j GROUP BY GROUPING SETS ((), (lang))) SELECT lang, n, tp, fp, fn, tn, round((tp + tn)::DOUBLE / n, 6) AS accuracy, round({F1}, 6) AS toxic_f1, round(({F1} + {FN1}) / 2, 6) AS macro_f1 FROM c WHERE g = 1 OR n >= 20",
        "language_scores": f"WITH {GUESSED_WHOLE} SELECT doc_id, lang, round(score, 6) AS score FROM ss",
        "detected_languages": f"WITH {GUESSED}, {detected('gs', 'guess')} SELECT doc_id, language FROM det",
        "coerced_labels": f"WITH {LABELLED} SELECT row_id, is_toxic FROM lab WHERE row_id % 6 IN (0, 1, 4)",
        "adapted_sources": f"WITH {LABELLED}, s AS (SELECT 0 AS source_rank, lower(left(coalesce(lang, 'und'), 2)) AS lang, is_toxic, text FROM lab UNION ALL SELECT 1, 'zh', is_toxic, text FROM lab WHERE row_id % 5 <> 0 UNION ALL SELECT 2, 'ko', is_toxic, text FROM lab) SELECT source_rank, lang, is_toxic, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM s GROUP BY 1, 2, 3",
        "requested_counts": "SELECT event_id, CASE WHEN event_id % 7 < 2 THEN 20 ELSE least(greatest(event_id * 37 % 400 - 100, 1), 100) END::BIGINT AS n FROM events",
        "formatted_events": "SELECT event_id, strftime(ts::TIMESTAMP, '%b %-d, %Y, %-I:%M %p') AS time, CASE WHEN event_id % 9 = 0 THEN '—' ELSE printf('%.1f', round((floor(value * 10) * 10 + 3) / 100000.0::DOUBLE * 100, 1)) || '%' END AS share, round(least(greatest(value - 10, 0), 100), 6) AS width FROM events WHERE value IS NOT NULL",
        "avatars": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE url || '_400x400/x_normal.png' END AS url FROM pages",
        "rich_texts": r"WITH t AS (SELECT conv_id, turn, regexp_extract_all('@user_' || conv_id || ' https://example.org/' || repeat('p', turn * 7) || ' ' || text || chr(10) || '#tag' || turn || ' #no-tag http:// @', '[^\s\x0B]+|[\s\x0B]+') AS p FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, array_to_string(list_transform(p, lambda x: CASE WHEN regexp_matches(x, '^https?://\S') THEN 'link=' || left(regexp_replace(x, '^https?://', ''), 32) || CASE WHEN length(x) > 39 THEN '…' ELSE '' END WHEN regexp_matches(x, '^@[A-Za-z0-9_]+$') THEN 'mention=' || x WHEN regexp_matches(x, '^#[A-Za-z0-9_]+$') THEN 'hashtag=' || x ELSE 'text=' || x END), '|') AS pieces FROM t",
        "payload_scores": f"WITH {CASES}, {normalized('src')} SELECT case_id, least(length(coalesce(nullif(normalized, ''), text, '')), 1000)::DOUBLE / 1000 AS prob FROM norm",
        "timeline_documents": "SELECT 'page' || doc_id // 5 AS username, row_number() OVER (PARTITION BY doc_id // 5 ORDER BY doc_id) - 1 AS pos, coalesce(text, '') AS full_text, doc_id::VARCHAR AS id_str, coalesce(n_chars, 0) AS favorite_count, 'https://twitter.com' || CASE WHEN doc_id % 3 = 0 THEN '/p/' || doc_id ELSE '/page' || doc_id // 5 || '/status/' || doc_id END AS tweet_url, 'page' || doc_id // 5 AS name FROM documents WHERE doc_id % 7 <> 3",
        "timeline_extract": "SELECT * FROM (VALUES ('ann', 'ok', 'Ann', 2::BIGINT, 'Fish & chips|https://twitter.com/ann/status/11|2018-10-10T20:19:24;second|https://twitter.com/ann/status/12|2018-10-10T20:19:24'), ('bob', 'empty', 'bob', 0::BIGINT, ''), ('eve', 'not_found', 'eve', 0::BIGINT, '')) t(username, status, name, n_posts, posts) UNION ALL SELECT 'page' || page_id, 'no_data', 'page' || page_id, 0, '' FROM pages",
    }
