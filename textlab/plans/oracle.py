"""DuckDB oracle SQL for the registered queries.

Each entry is an independent SQL statement over the driver's parquet views.
The fixed lexicons and patterns are shared with the Spark side (they are
data), the logic is written out again in SQL.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..functions import text as TX
from . import lexicons as LX


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def words(col: str, alternation: str) -> str:
    return f"coalesce(regexp_matches(lower({col}), {q(P.words(alternation))}), false)"


def clean(col: str) -> str:
    inner = f"regexp_replace({col}, {q(TX.URL_RE_PORTABLE)}, '', 'g')"
    inner = f"regexp_replace({inner}, {q(TX.MENTION_RE)}, '', 'g')"
    return f"trim(regexp_replace({inner}, {q(TX.WS_RUN_RE_PORTABLE)}, ' ', 'g'))"


def beta_tail(a: str, b: str, x: str) -> str:
    """Incomplete beta function by the same continued fraction, odd and even terms as one step."""
    odd = f"(-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1)))"
    even = f"((m + 1) * ({b} - m - 1) * {x} / (({a} + 2 * m + 1) * ({a} + 2 * m + 2)))"
    c1, d1 = f"(1 + {odd} / s.c)", f"(1 / (1 + {odd} * s.d))"
    c2, d2 = f"(1 + {even} / {c1})", f"(1 / (1 + {even} * {d1}))"
    start = "{'m': -1, 'c': 1e300::DOUBLE, 'd': 1.0::DOUBLE, 'h': 1.0::DOUBLE}"
    steps = "list_transform(range(0, 200), lambda k: {'m': k, 'c': 1.0::DOUBLE, 'd': 1.0::DOUBLE, 'h': 1.0::DOUBLE})"
    body = f"{{'m': t.m, 'c': {c2}, 'd': {d2}, 'h': s.h * {c1} * {d1} * {c2} * {d2}}}".replace("m)", "t.m)").replace("* m", "* t.m")
    body = body.replace("(m + 1)", "(t.m + 1)").replace(" - m - 1", " - t.m - 1")
    front = f"lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x})"
    return f"(exp({front}) * list_reduce({steps}, lambda s, t: {body}, {start}).h / {a})"


def first_label(col: str, dictionary, default) -> str:
    parts = " ".join(f"WHEN {words(col, pat)} THEN {q(label)}" for label, pat in dictionary)
    d = "NULL" if default is None else q(default)
    return f"CASE {parts} ELSE {d} END"


def in_list(col: str, values) -> str:
    return f"{col} IN ({', '.join(q(v) for v in values)})"


def escalation(intent: str, msg: str, critical=LX.CRITICAL_WORDS, repeat=LX.REPEAT_WORDS) -> str:
    return (f"CASE WHEN {in_list(intent, P.ALWAYS_ESCALATE)} THEN 'escalate' "
            f"WHEN {words(msg, critical)} THEN 'escalate' "
            f"WHEN {words(msg, repeat)} AND {in_list(intent, P.REPEAT_INTENTS)} THEN 'escalate' "
            f"ELSE 'auto_handle' END")


def reason(intent: str, msg: str, variant: str, rules=LX.REASON_RULES) -> str:
    parts = [f"WHEN {words(msg, alt)} THEN {q(tag)}" for tag, alt in rules]
    parts += [f"WHEN {intent} = {q(name)} THEN {q(tag)}" for name, tag in P.REASON_BY_INTENT]
    if variant == "hybrid":
        parts.append(f"WHEN {in_list(intent, P.HYBRID_LOW_RISK_INTENTS)} THEN 'low_risk'")
        tail = "'deterministic_action'"
    else:
        tail = "'low_risk'"
    return f"CASE {' '.join(parts)} ELSE {tail} END"


def policy_reason(intent: str, msg: str, esc: str, rules=LX.REASON_RULES, amount: str | None = None) -> str:
    rank = {tag: n for n, tag in enumerate(P.POLICY_PRIORITY)}
    cands = [f"CASE WHEN {words(msg, alt)} THEN {rank[tag]} END" for tag, alt in rules]
    cands += [f"CASE WHEN {intent} = {q(name)} THEN {rank[tag]} END" for name, tag in P.REASON_BY_INTENT]
    if amount:
        cands += [f"CASE WHEN {intent} = {q(name)} AND {amount} > {limit} THEN {rank['high_value']} END"
                  for name, limit in P.AMOUNT_THRESHOLDS.items()]
    cands.append(f"CASE WHEN {esc} = 'auto_handle' AND NOT {in_list(intent, P.HYBRID_LOW_RISK_INTENTS)} "
                 f"THEN {rank['deterministic_action']} END")
    cands.append(str(rank["low_risk"]))
    best = f"least({', '.join(cands)})"
    whens = " ".join(f"WHEN {best} = {n} THEN {q(tag)}" for tag, n in rank.items())
    return f"CASE {whens} END"


def lookup(key: str, mapping: dict, default: str) -> str:
    parts = " ".join(f"WHEN {key} = {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {parts} ELSE {q(default)} END"


def consistent_reason(esc: str, rsn: str, intent: str) -> str:
    return (f"CASE WHEN {esc} = 'auto_handle' AND {in_list(rsn, P.ESC_REASONS)} "
            f"THEN {lookup(intent, P.AUTO_FALLBACK, P.AUTO_FALLBACK_DEFAULT)} "
            f"WHEN {esc} = 'escalate' AND {in_list(rsn, P.AUTO_REASONS)} "
            f"THEN {lookup(intent, P.ESC_FALLBACK, P.ESC_FALLBACK_DEFAULT)} ELSE {rsn} END")


def fix_kind(esc: str, rsn: str) -> str:
    return (f"CASE WHEN {esc} = 'auto_handle' AND {in_list(rsn, P.ESC_REASONS)} THEN 'auto' "
            f"WHEN {esc} = 'escalate' AND {in_list(rsn, P.AUTO_REASONS)} THEN 'escalate' END")


# ---------------------------------------------------------------------------

PAIRS = """
SELECT m.conv_id AS conv_id, m.turn AS turn, m.text AS customer_msg, r.text AS brand_reply
FROM conversations m JOIN conversations r
  ON r.conv_id = m.conv_id AND r.turn = m.turn + 1
WHERE m.role = 'user' AND r.role = 'assistant'
"""

SCORED = f"""
SELECT conv_id, turn, msg, reply, {first_label('msg', LX.INTENT_LEXICON, LX.INTENT_DEFAULT)} AS intent
FROM (SELECT conv_id, turn, {clean('customer_msg')} AS msg, {clean('brand_reply')} AS reply
      FROM ({PAIRS}))
"""


def _sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["reply_pairs"] = PAIRS
    s["clean_text"] = f"""
SELECT doc_id, md5(c) AS clean_md5, CAST(length(c) AS BIGINT) AS clean_chars,
       (c IS NULL OR trim(c) = '') AS is_blank
FROM (SELECT doc_id, {clean('text')} AS c FROM documents)"""
    s["clean_pages"] = f"""
SELECT page_id, md5(c) AS clean_md5, CAST(length(c) AS BIGINT) AS clean_chars,
       CAST(length(html) - length(c) AS BIGINT) AS removed_chars
FROM (SELECT page_id, html, {clean('html')} AS c FROM pages)"""
    s["policy_decision"] = f"""
SELECT conv_id, turn, intent, {escalation('intent', 'msg')} AS escalation,
       {reason('intent', 'msg', 'hybrid')} AS reason_hybrid,
       {reason('intent', 'msg', 'simple')} AS reason_simple
FROM ({SCORED})"""
    s["reason_priority"] = f"""
SELECT conv_id, turn, intent, escalation,
       {reason('intent', 'msg', 'hybrid')} AS reason_code_order,
       {policy_reason('intent', 'msg', 'escalation')} AS reason_policy_order
FROM (SELECT *, {escalation('intent', 'msg')} AS escalation FROM ({SCORED}))"""
    s["reason_consistency"] = f"""
SELECT conv_id, turn, predicted_intent, predicted_escalation,
       {consistent_reason('predicted_escalation', 'r0', 'predicted_intent')} AS predicted_reason,
       {fix_kind('predicted_escalation', 'r0')} AS fix_kind
FROM (SELECT conv_id, turn, intent AS predicted_intent,
             {escalation('intent', 'msg')} AS predicted_escalation,
             {reason('intent', 'msg', 'hybrid')} AS r0
      FROM ({SCORED}))"""

    junk = words("d.text", "worthless|stupid|idiot")
    matched = f"""
SELECT l.doc_id,
       CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS truth,
       CASE WHEN l.toxic = 1 THEN 'abusive' ELSE 'clean' END AS truth_reason,
       CASE WHEN {junk} OR d.n_chars < 300 THEN 'low' ELSE 'high' END AS pred,
       CASE WHEN d.n_chars < 200 THEN '' WHEN {junk} THEN 'abusive' ELSE 'clean' END AS pred_reason,
       least(d.n_chars / 5000.0, 1.0) AS confidence
FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
    per_class = f"""
WITH m AS ({matched}),
lab(label, label_order) AS (VALUES ('low', 0), ('high', 1)),
pc AS (
  SELECT lab.label,
         CAST(count(*) FILTER (WHERE m.truth = lab.label AND m.pred = lab.label) AS DOUBLE) AS tp,
         CAST(count(*) FILTER (WHERE m.truth = lab.label) AS DOUBLE) AS sup,
         CAST(count(*) FILTER (WHERE m.pred = lab.label) AS DOUBLE) AS prd
  FROM lab LEFT JOIN m ON m.truth = lab.label OR m.pred = lab.label
  GROUP BY lab.label)
"""
    s["per_class_metrics"] = per_class + """
SELECT label,
       round(CASE WHEN prd > 0 THEN tp / prd ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0.0 END, 6) AS f1,
       CAST(sup AS BIGINT) AS support, CAST(prd AS BIGINT) AS predicted
FROM pc"""
    s["eval_metrics"] = per_class + f"""
, f AS (SELECT label, tp, sup, prd,
              CASE WHEN prd > 0 THEN tp / prd ELSE 0.0 END AS p,
              CASE WHEN sup > 0 THEN tp / sup ELSE 0.0 END AS r,
              CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0.0 END AS f1 FROM pc)
SELECT CAST((SELECT count(*) FROM m) AS BIGINT) AS n_evaluated,
       CAST((SELECT count(*) FROM labels l WHERE NOT EXISTS
              (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)) AS BIGINT) AS n_missing,
       round((SELECT sum(tp) FROM f) / (SELECT sum(sup) FROM f), 6) AS accuracy,
       round((SELECT sum(p) FROM f) / 2.0, 6) AS macro_precision,
       round((SELECT sum(r) FROM f) / 2.0, 6) AS macro_recall,
       round((SELECT sum(f1) FROM f) / 2.0, 6) AS macro_f1,
       round((SELECT sum(f1 * sup) FROM f) / (SELECT sum(sup) FROM f), 6) AS weighted_f1,
       round((SELECT avg(CASE WHEN truth_reason = pred_reason THEN 1.0 ELSE 0.0 END)
              FROM m WHERE coalesce(pred_reason, '') <> ''), 6) AS reason_agreement,
       CAST((SELECT count(*) FROM m WHERE coalesce(pred_reason, '') <> '') AS BIGINT) AS n_reason_scored,
       CAST((SELECT count(*) FROM m WHERE confidence < {P.LOW_CONFIDENCE}) AS BIGINT) AS n_low_confidence
"""
    s["confusion_matrix"] = f"""
WITH m AS ({matched}),
lab(label, label_order) AS (VALUES ('low', 0), ('high', 1))
SELECT lab.label AS truth,
       CAST(count(m.doc_id) FILTER (WHERE m.pred = 'low') AS BIGINT) AS low,
       CAST(count(m.doc_id) FILTER (WHERE m.pred = 'high') AS BIGINT) AS high
FROM lab LEFT JOIN m ON m.truth = lab.label
GROUP BY lab.label"""
    return s


SQL = _sql()


# ---------------------------------------------------------------------------
# corpus, sampling, tables

def _case_sql(col: str, mapping: dict, default) -> str:
    parts = " ".join(f"WHEN {col} = {q(k)} THEN {v if isinstance(v, int) else q(v)}"
                     for k, v in mapping.items())
    d = default if isinstance(default, int) else ("NULL" if default is None else q(default))
    return f"CASE {parts} ELSE {d} END"


def md5_order(key: str, seed) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR))"


def eda_tokens(c: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({c}), {q(TX.TOKEN_RE)}), "
            f"lambda x: regexp_full_match(x, '[a-z]{{3,}}'))")


def non_english(c: str) -> str:
    return (f"(coalesce(regexp_matches({c}, {q(P.NON_ASCII)}), false) AND "
            f"coalesce(regexp_matches({c}, {q(P.LATIN_OR_CJK_LETTER)}), false))")


CLEAN_DOCS = f"SELECT doc_id, {clean('text')} AS c FROM documents"
DEDUP_POOL = """SELECT doc_id, text, lang FROM
  (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents)
WHERE k = 1"""


def tagged_sample_sql(pool: str, tags: list[tuple[str, str, int, int]]) -> str:
    """tags: (tag, predicate sql over c, n, seed) in priority order."""
    arms = " UNION ALL ".join(
        f"SELECT doc_id, c, {i} AS prio, {q(tag)} AS tag, {md5_order('doc_id', seed)} AS h "
        f"FROM p WHERE coalesce({pred}, false)"
        for i, (tag, pred, _n, seed) in enumerate(tags))
    quota = _case_sql("tag", {t: n for t, _p, n, _s in tags}, 0)
    return f"""
WITH p AS ({pool}),
t AS ({arms}),
r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY h, doc_id) AS rn FROM t),
s AS (SELECT * FROM r WHERE rn <= {quota}),
d AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY prio, h, doc_id) AS k FROM s)
SELECT doc_id, tag FROM d WHERE k = 1"""


def _edge_tags_sql() -> list:
    n = "length(c)"
    preds = {
        "multi_intent": f"({words('c', P.EDGE_MULTI_JOINERS)} AND {words('c', P.EDGE_MULTI_TOPICS)} AND {n} > 80)",
        "anger_sarcasm": f"({words('c', P.EDGE_ANGER_WORDS)} OR "
                         f"coalesce(regexp_matches(c, {q(P.EDGE_ANGER_PUNCT)}), false))",
        "short_fragment": f"({n} BETWEEN 2 AND 10)",
        "very_long": f"({n} > 240)",
        "image_reference": words("c", P.EDGE_IMAGE_WORDS),
        "non_english": non_english("c"),
    }
    return [(tag, preds[tag], cnt, seed) for tag, cnt, seed in P.EDGE_TAGS]


def _sql_corpus() -> dict[str, str]:
    s: dict[str, str] = {}
    stats = ", ".join(
        f"round({fn}, 6) AS {name}_len" for name, fn in [
            ("mean", "avg(len)"), ("std", "stddev_samp(len)"), ("min", "min(len)"),
            ("q25", "quantile_cont(len, 0.25)"), ("q50", "quantile_cont(len, 0.5)"),
            ("q75", "quantile_cont(len, 0.75)"), ("max", "max(len)")])
    s["text_profile"] = f"""
WITH d AS (SELECT lang, c, CAST(length(c) AS DOUBLE) AS len
           FROM (SELECT lang, {clean('text')} AS c FROM documents))
SELECT lang, count(*) AS n_docs,
       count(*) FILTER (WHERE c IS NULL OR trim(c) = '') AS n_blank,
       count(*) FILTER (WHERE {non_english('c')}) AS n_non_english,
       {stats}
FROM d GROUP BY lang"""
    s["length_histogram"] = f"""
WITH l AS (SELECT CAST(length(c) AS BIGINT) AS v FROM ({CLEAN_DOCS})),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM l),
b AS (SELECT CAST(least(floor((v - lo) * 30 / greatest(hi - lo, 1)), 29) AS BIGINT) AS bin
      FROM l CROSS JOIN e WHERE v IS NOT NULL),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT r.range AS bin,
       round(CAST(e.lo AS DOUBLE) + r.range * (e.hi - e.lo) / CAST(30 AS DOUBLE), 6) AS lo,
       round(CAST(e.lo AS DOUBLE) + (r.range + 1) * (e.hi - e.lo) / CAST(30 AS DOUBLE), 6) AS hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM range(30) r CROSS JOIN e LEFT JOIN c ON c.bin = r.range"""
    s["value_counts"] = "SELECT event_type, count(*) AS count FROM events GROUP BY event_type"
    s["counts_having"] = """
SELECT user_id, count(*) AS count FROM events WHERE user_id IS NOT NULL
GROUP BY user_id HAVING count(*) >= 70"""
    s["top_unigrams"] = f"""
WITH t AS (SELECT unnest({eda_tokens('c')}) AS term FROM ({CLEAN_DOCS}))
SELECT term, count(*) AS count FROM t GROUP BY term ORDER BY count DESC, term LIMIT 50"""
    s["top_bigrams"] = f"""
WITH t AS (SELECT {eda_tokens('c')} AS toks FROM ({CLEAN_DOCS})),
p AS (SELECT toks[i] AS w1, toks[i + 1] AS w2
      FROM (SELECT toks, unnest(range(1, len(toks))) AS i FROM t))
SELECT w1, w2, count(*) AS count FROM p GROUP BY w1, w2 ORDER BY count DESC, w1, w2 LIMIT 30"""
    s["length_stratified_sample"] = f"""
WITH b AS (SELECT doc_id, CAST(length(c) AS BIGINT) AS length,
                  CASE WHEN length(c) < 80 THEN 'short' WHEN length(c) < 160 THEN 'medium'
                       ELSE 'long' END AS band
           FROM ({CLEAN_DOCS}) WHERE c IS NOT NULL AND trim(c) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {md5_order('doc_id', 42)}, doc_id) AS rn FROM b),
p AS (SELECT * FROM r WHERE rn <= CASE band WHEN 'short' THEN 300 WHEN 'medium' THEN 125
                                             WHEN 'long' THEN 75 ELSE 0 END)
SELECT row_number() OVER (ORDER BY {md5_order('doc_id', '42s')}, doc_id) AS id, doc_id, length, band FROM p"""
    s["quota_sample"] = f"""
WITH pool AS ({DEDUP_POOL}),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {md5_order('doc_id', 42)}, doc_id) AS rn
      FROM pool)
SELECT doc_id, lang FROM r WHERE rn <= {_case_sql('lang', LX.LANG_QUOTAS, 0)}"""
    targets = ", ".join(f"({q(k)}, {v})" for k, v in LX.LANG_TARGETS.items())
    s["quota_gap"] = f"""
WITH pool AS ({DEDUP_POOL}),
t(lang, target) AS (VALUES {targets}),
a AS (SELECT lang, count(*) AS available FROM pool GROUP BY lang)
SELECT t.lang, CAST(t.target AS BIGINT) AS target, CAST(coalesce(a.available, 0) AS BIGINT) AS available,
       CAST(least(coalesce(a.available, 0), t.target) AS BIGINT) AS taken,
       CAST(t.target - least(coalesce(a.available, 0), t.target) AS BIGINT) AS shortfall
FROM t LEFT JOIN a ON a.lang = t.lang"""
    s["proportional_sample"] = f"""
WITH c AS (SELECT lang, count(*) AS nc FROM documents GROUP BY lang),
tot AS (SELECT sum(nc) AS n FROM c),
qt AS (SELECT lang, greatest(2, CAST(round_even(nc * 30 / tot.n, 0) AS BIGINT)) AS qn FROM c CROSS JOIN tot),
r AS (SELECT d.doc_id, d.lang, qt.qn, {md5_order('d.doc_id', 99)} AS h,
             row_number() OVER (PARTITION BY d.lang ORDER BY {md5_order('d.doc_id', 99)}, d.doc_id) AS rn
      FROM documents d JOIN qt ON qt.lang = d.lang)
SELECT doc_id, lang FROM r ORDER BY CASE WHEN rn <= qn THEN 1 ELSE 0 END DESC, h, doc_id LIMIT 30"""
    s["edge_cases"] = tagged_sample_sql(CLEAN_DOCS, _edge_tags_sql())
    weak = [(label, f"({words('c', pat)} AND length(c) >= {P.MIN_MINED_LENGTH})", P.RARE_INTENT_CAP, 42)
            for label, pat in LX.WEAK_LABELS]
    s["weak_labels"] = tagged_sample_sql(CLEAN_DOCS, weak).replace(
        "SELECT doc_id, tag FROM d WHERE k = 1", "SELECT doc_id, tag AS keyword_label FROM d WHERE k = 1")
    topup = [(label, f"({words('c', pat)} AND length(c) >= {P.MIN_MINED_LENGTH})", P.TOPUP_TARGETS[label], 42)
             for label, pat in LX.TOPUP_LABELS]
    s["topup_mining"] = tagged_sample_sql(
        f"SELECT * FROM ({CLEAN_DOCS}) d WHERE NOT EXISTS (SELECT 1 FROM ({CLEAN_DOCS}) u "
        f"JOIN labels l ON l.doc_id = u.doc_id WHERE u.c = d.c)", topup).replace(
        "SELECT doc_id, tag FROM d WHERE k = 1", "SELECT doc_id, tag AS intent_llm_guess FROM d WHERE k = 1")
    s["review_order"] = """
SELECT d.doc_id, row_number() OVER (ORDER BY coalesce(l.toxic, 0), d.lang ASC NULLS LAST, d.doc_id) AS position
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
    s["dedupe_keep_first"] = f"SELECT doc_id, lang FROM ({DEDUP_POOL})"
    s["merge_topup"] = """
WITH m AS (SELECT 'main' AS origin, 0 AS prio, doc_id AS src_id, CAST(0 AS BIGINT) AS src_turn, text, lang
           FROM documents
           UNION ALL
           SELECT 'topup', 1, conv_id, turn, text, '' FROM conversations WHERE role = 'user'),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY prio, src_id, src_turn) AS r FROM m)
SELECT row_number() OVER (ORDER BY prio, src_id, src_turn) AS id, origin, src_id, src_turn, lang
FROM k WHERE r = 1"""
    s["exclude_used"] = """
SELECT d.doc_id FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents u JOIN labels l ON l.doc_id = u.doc_id WHERE u.text = d.text)"""
    s["resume_remaining"] = """
SELECT doc_id, CAST(quality AS VARCHAR) AS prediction, 'kept' AS status FROM labels
WHERE quality IS NOT NULL AND trim(CAST(quality AS VARCHAR)) <> ''
UNION ALL
SELECT d.doc_id, CASE WHEN d.n_chars >= 300 THEN '1' ELSE '0' END, 'new' FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality IS NOT NULL)"""
    fixes = """
WITH c AS (SELECT 1 AS seq, doc_id, 0 AS quality FROM labels WHERE toxic = 1
           UNION ALL
           SELECT 2, l.doc_id, 1 FROM labels l JOIN documents d ON d.doc_id = l.doc_id
           WHERE l.toxic = 1 AND d.n_chars < 1000
           UNION ALL
           SELECT 3, d.doc_id, 0 FROM documents d
           WHERE d.n_chars > 15000 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
lst AS (SELECT doc_id, arg_max(quality, seq) AS quality FROM c GROUP BY doc_id)"""
    s["unknown_corrections"] = fixes + """
SELECT doc_id FROM lst WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)"""
    s["apply_corrections"] = fixes + """
SELECT l.doc_id, CAST(CASE WHEN lst.doc_id IS NOT NULL THEN lst.quality ELSE l.quality END AS INTEGER) AS quality,
       l.toxic, lst.doc_id IS NOT NULL AS corrected
FROM labels l LEFT JOIN lst ON lst.doc_id = l.doc_id"""
    return s


SQL.update(_sql_corpus())


# ---------------------------------------------------------------------------
# labelling: audit, agreement, baselines, responses, rubric

GOLDEN = f"""
SELECT d.doc_id AS id, c AS customer_msg_clean,
       {first_label('c', LX.INTENT_LEXICON, LX.INTENT_DEFAULT)} AS intent,
       CASE WHEN l.toxic = 1 THEN 'escalate' ELSE 'auto_handle' END AS escalation_ground_truth,
       CASE WHEN l.quality = 0 THEN 'kb_unavailable' WHEN l.toxic = 1 THEN 'low_risk'
            ELSE 'deterministic_action' END AS escalation_reason,
       CASE WHEN d.n_chars < 500 THEN 'easy' WHEN d.n_chars < 3000 THEN 'medium' ELSE 'hard' END AS difficulty,
       {_case_sql('d.lang', LX.LANG_HINTS, 'other')} AS intent_llm_guess,
       CAST(NULL AS VARCHAR) AS intent_llm_guess_v2
FROM (SELECT doc_id, lang, n_chars, {clean('text')} AS c FROM documents) d
JOIN labels l ON l.doc_id = d.doc_id"""

HINT = ("CASE WHEN trim(intent_llm_guess_v2) <> '' THEN intent_llm_guess_v2 "
        "WHEN trim(intent_llm_guess) <> '' THEN intent_llm_guess ELSE '' END")


def template_sql(template: str, **fields) -> str:
    return " || ".join(q(v) if kind == "text" else f"CAST({fields[v]} AS VARCHAR)"
                       for kind, v in P.template_parts(template))


def _audit_arms() -> list[tuple[str, str, str]]:
    i, e, r, d = "intent", "escalation_ground_truth", "escalation_reason", "difficulty"
    m, n = "coalesce(customer_msg_clean, '')", "length(coalesce(customer_msg_clean, ''))"
    preds = [
        f"{e} = 'auto_handle' AND {in_list(r, P.ESC_REASONS)}",
        f"{e} = 'escalate' AND {in_list(r, P.AUTO_REASONS)}",
        f"{i} = 'complaint' AND {words(m, P.AUDIT_TOPIC_WORDS)}",
        f"{i} = 'info_request' AND {words(m, P.AUDIT_PROBLEM_WORDS)}",
        f"{i} = 'product_issue' AND {words(m, P.AUDIT_MONEY_WORDS)}",
        f"{i} = 'order_status' AND {words(m, P.AUDIT_DISPUTE_WORDS)}",
        f"{n} < {P.AUDIT_SHORT_LEN} AND {i} NOT IN ('other', 'complaint')",
        f"{i} = 'account_access' AND {e} IS DISTINCT FROM 'escalate'",
        f"{i} = 'complaint' AND {e} IS DISTINCT FROM 'escalate'",
        f"{i} = 'billing_payment' AND {e} IS DISTINCT FROM 'escalate'",
        f"{d} = 'easy' AND {i} <> '' AND ({HINT}) <> '' AND ({HINT}) <> {i}",
        f"{i} = 'complaint' AND coalesce(regexp_matches({m}, {q(P.NON_ASCII)}), false)",
        f"{r} = 'kb_unavailable' AND NOT {words(m, P.AUDIT_KB_WORDS)} AND {n} < {P.AUDIT_KB_SHORT_LEN}",
    ]
    fields = {"reason": r, "intent": i, "length": n, "hint": f"({HINT})"}
    return [(name, pred, template_sql(msg, **fields)) for (name, msg), pred in zip(P.AUDIT_MESSAGES, preds)]


AUDIT = "WITH g AS (" + GOLDEN + ")\n" + "\nUNION ALL\n".join(
    f"SELECT id, intent, escalation_ground_truth AS escalation, escalation_reason AS reason, difficulty, "
    f"substr(coalesce(customer_msg_clean, ''), 1, {P.AUDIT_MESSAGE_CHARS}) AS message, "
    f"{q(rule)} AS rule, {why} AS why FROM g WHERE coalesce({pred}, false)"
    for rule, pred, why in _audit_arms())


def _raw_responses_sql() -> str:
    intent = _case_sql("event_type", LX.EVENT_INTENTS, "other")
    plain = f"""('{{"intent": "' || {intent} || '", ' || substr(props, 2))"""
    return f"""
SELECT event_id, CAST(((event_id % 5) + 5) % 5 AS INTEGER) AS variant,
       CASE ((event_id % 5) + 5) % 5
         WHEN 0 THEN {plain}
         WHEN 1 THEN '```json' || chr(10) || {plain} || chr(10) || '```'
         WHEN 2 THEN '"' || replace({plain}, '"', '\\"') || '"'
         WHEN 3 THEN 'Sure, here it is: ' || {plain} || ' Hope this helps.'
         ELSE substr({plain}, 1, 12) END AS raw_response
FROM events"""


def _fence(t: str) -> str:
    from ..operators.responses import FENCE_RE
    return (f"CASE WHEN starts_with(trim({t}), '```') THEN trim(regexp_replace(trim({t}), {q(FENCE_RE)}, '', 'g')) "
            f"ELSE trim({t}) END")


def _jtype(t: str) -> str:
    return f"(CASE WHEN json_valid({t}) THEN json_type({t}) END)"


def _sql_labelling() -> dict[str, str]:
    s: dict[str, str] = {}
    s["label_audit"] = AUDIT
    s["audit_summary"] = f"""
WITH a AS ({AUDIT})
SELECT rule, count(*) AS n_flags, count(DISTINCT id) AS n_ids FROM a GROUP BY rule
UNION ALL
SELECT '(all)', count(*), count(DISTINCT id) FROM a"""
    s["difficulty_downgrade"] = f"""
SELECT id, difficulty,
       CASE WHEN coalesce(difficulty = 'easy' AND intent <> '' AND ({HINT}) <> '' AND ({HINT}) <> intent, false)
            THEN 'medium' ELSE difficulty END AS difficulty_after
FROM ({GOLDEN})"""
    s["kappa"] = """
WITH j AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS agree FROM j),
ma AS (SELECT a AS label, count(*) AS na FROM j GROUP BY a),
mb AS (SELECT b AS label, count(*) AS nb FROM j GROUP BY b),
ch AS (SELECT coalesce(sum(na * nb), 0) AS chance FROM ma JOIN mb ON ma.label = mb.label)
SELECT CAST(n AS BIGINT) AS n,
       round(agree / CAST(n AS DOUBLE), 6) AS p_observed,
       round(chance / (CAST(n AS DOUBLE) * n), 6) AS p_expected,
       round(CASE WHEN CAST(n AS DOUBLE) * n - chance <> 0
                  THEN (CAST(agree AS DOUBLE) * n - chance) / (CAST(n AS DOUBLE) * n - chance) END, 6) AS kappa
FROM t CROSS JOIN ch"""
    passes = """SELECT l.doc_id, CAST(l.quality AS BIGINT) AS a, CAST(d.n_chars >= 1000 AS BIGINT) AS b
FROM labels l JOIN documents d ON d.doc_id = l.doc_id"""
    s["two_pass_kappa"] = s["kappa"].replace(
        "SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL",
        f"SELECT * FROM ({passes}) WHERE a IS NOT NULL AND b IS NOT NULL")
    s["pass_disagreements"] = f"SELECT * FROM ({passes}) WHERE a <> b"
    s["label_progress"] = """
SELECT count(*) AS n_total, count(*) FILTER (WHERE trim(lang) <> '') AS n_labelled,
       count(*) FILTER (WHERE lang IS NULL OR trim(lang) = '') AS n_unlabelled
FROM documents"""
    s["random_sample"] = f"SELECT doc_id, lang FROM documents ORDER BY {md5_order('doc_id', 42)}, doc_id LIMIT 200"
    s["stratified_folds"] = f"""
SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY {md5_order('doc_id', 42)}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels WHERE quality IS NOT NULL"""
    bands = " ".join(f"WHEN rho >= {lo} THEN {q(name)}" for lo, name in P.RHO_BANDS)
    p_value = f"CASE WHEN x < (a + 1) / (a + b + 2) THEN {beta_tail('a', 'b', 'x')} ELSE 1 - {beta_tail('b', 'a', '(1 - x)')} END"
    s["rank_agreement"] = f"""
WITH x AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem
           WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL),
va AS (SELECT a, count(*) AS n FROM x GROUP BY a),
vb AS (SELECT b, count(*) AS n FROM x GROUP BY b),
ra AS (SELECT a, coalesce(sum(n) OVER (ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + CAST(n + 1 AS DOUBLE) / 2 AS ra FROM va),
rb AS (SELECT b, coalesce(sum(n) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + CAST(n + 1 AS DOUBLE) / 2 AS rb FROM vb),
j AS (SELECT x.a, x.b, ra.ra, rb.rb FROM x JOIN ra ON ra.a = x.a JOIN rb ON rb.b = x.b),
t AS (SELECT count(*) AS n, avg(a) AS jm, avg(b) AS hm, corr(ra, rb) AS rho, avg(abs(a - b)) AS mae,
             avg(CASE WHEN a = b THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS exact,
             avg(CASE WHEN abs(a - b) <= 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS within1
      FROM j)
SELECT CAST(n AS BIGINT) AS n, round(jm, 9) AS judge_mean, round(hm, 9) AS human_mean, round(rho, 9) AS rho,
       round(CASE WHEN abs(rho) < 1 THEN rho * sqrt((n - 2) / (1 - rho * rho)) END, 9) AS t_stat,
       round(CASE WHEN abs(rho) >= 1 THEN 0.0 ELSE {p_value} END, 9) AS p_value,
       round(mae, 9) AS mae, round(exact, 9) AS exact, round(within1, 9) AS within1,
       CASE WHEN rho IS NULL THEN NULL {bands} ELSE {q(P.RHO_BAND_ELSE)} END AS band,
       CASE WHEN jm > hm + {P.BIAS_MARGIN} THEN 'generous' WHEN jm < hm - {P.BIAS_MARGIN} THEN 'harsh'
            ELSE 'close' END AS bias
FROM (SELECT *, (n - 2)::DOUBLE / 2 AS a, 0.5::DOUBLE AS b,
             (n - 2) / ((n - 2) + rho * rho * (n - 2) / (1 - rho * rho)) AS x FROM t)"""
    s["compare_systems"] = """
WITH j AS (SELECT CASE WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS truth,
                  CASE WHEN d.n_chars >= 300 THEN 'high' ELSE 'low' END AS len300,
                  CASE WHEN d.n_chars >= 1000 THEN 'high' ELSE 'low' END AS len1000
           FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
lng AS (SELECT 'len300' AS system, truth, len300 AS pred FROM j
        UNION ALL SELECT 'len1000', truth, len1000 FROM j),
lab(label) AS (VALUES ('low'), ('high')),
pc AS (SELECT sy.system, lab.label,
              CAST(count(*) FILTER (WHERE lng.truth = lab.label AND lng.pred = lab.label) AS DOUBLE) AS tp,
              CAST(count(*) FILTER (WHERE lng.truth = lab.label) AS DOUBLE) AS sup,
              CAST(count(*) FILTER (WHERE lng.pred = lab.label) AS DOUBLE) AS prd
       FROM (SELECT DISTINCT system FROM lng) sy CROSS JOIN lab
       LEFT JOIN lng ON lng.system = sy.system AND (lng.truth = lab.label OR lng.pred = lab.label)
       GROUP BY sy.system, lab.label)
SELECT system, CAST(sum(sup) AS BIGINT) AS n, round(sum(tp) / sum(sup), 6) AS accuracy,
       round(sum(CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END) / CAST(2 AS DOUBLE), 6) AS macro_f1,
       CAST((SELECT count(*) FROM j WHERE len300 IS DISTINCT FROM len1000) AS BIGINT) AS n_changed
FROM pc GROUP BY system"""
    reasons = ", ".join(f"({q(x)})" for x in P.REASONS)
    s["compare_baselines"] = f"""
WITH m AS (SELECT *, {escalation('intent', 'msg')} AS esc FROM ({SCORED})),
t AS (SELECT intent, msg, esc, {policy_reason('intent', 'msg', 'esc')} AS truth,
             {reason('intent', 'msg', 'simple')} AS simple, {reason('intent', 'msg', 'hybrid')} AS coded FROM m),
lng AS (SELECT 'trivial' AS system, truth, {q(P.TRIVIAL_REASON)} AS pred FROM t
        UNION ALL SELECT 'simple', truth, simple FROM t
        UNION ALL SELECT 'hybrid', truth, {consistent_reason('esc', 'coded', 'intent')} FROM t),
lab(label) AS (VALUES {reasons}),
pc AS (SELECT sy.system, lab.label,
              CAST(count(*) FILTER (WHERE lng.truth = lab.label AND lng.pred = lab.label) AS DOUBLE) AS tp,
              CAST(count(*) FILTER (WHERE lng.truth = lab.label) AS DOUBLE) AS sup,
              CAST(count(*) FILTER (WHERE lng.pred = lab.label) AS DOUBLE) AS prd
       FROM (SELECT DISTINCT system FROM lng) sy CROSS JOIN lab
       LEFT JOIN lng ON lng.system = sy.system AND (lng.truth = lab.label OR lng.pred = lab.label)
       GROUP BY sy.system, lab.label),
f AS (SELECT *, CASE WHEN sup + prd > 0 THEN 2 * tp / (sup + prd) ELSE 0 END AS f1 FROM pc)
SELECT system, CAST(sum(sup) AS BIGINT) AS n, round(sum(tp) / sum(sup), 6) AS reason_agreement,
       round(sum(f1) / CAST({len(P.REASONS)} AS DOUBLE), 6) AS macro_f1,
       round(sum(f1 * sup) / sum(sup), 6) AS weighted_f1
FROM f GROUP BY system"""
    s["majority_baseline"] = f"""
WITH m AS (SELECT event_type FROM events GROUP BY event_type
           ORDER BY count(*) DESC, event_type ASC NULLS LAST LIMIT 1)
SELECT e.event_id, (SELECT event_type FROM m) AS predicted_type,
       {q(P.TRIVIAL_ESCALATION)} AS predicted_escalation, {q(P.TRIVIAL_REASON)} AS predicted_reason,
       {q(P.TRIVIAL_REPLY)} AS predicted_reply
FROM events e"""
    unwrap = "({f})".format(f=_fence("json_extract_string(t, '$')"))
    obj_of = (lambda t: f"CASE WHEN {_jtype(t)} = 'OBJECT' THEN {t} "
                        f"WHEN {_jtype(t)} = 'VARCHAR' AND {_jtype(unwrap.replace('t,', t + ','))} = 'OBJECT' "
                        f"THEN {unwrap.replace('t,', t + ',')} END")
    d = P.RESPONSE_DEFAULTS
    s["response_parse"] = f"""
WITH r AS ({_raw_responses_sql()}),
t AS (SELECT event_id, variant, {_fence('raw_response')} AS txt FROM r),
sp AS (SELECT *, nullif(regexp_extract(txt, '(?s)\\{{.*\\}}', 0), '') AS span FROM t),
o AS (SELECT event_id, variant, coalesce({obj_of('txt')}, {obj_of('span')}) AS obj FROM sp)
SELECT event_id, variant, obj IS NOT NULL AS parsed,
       CASE WHEN json_extract_string(obj, '$.intent') IN ({', '.join(q(x) for x in P.INTENTS)})
            THEN json_extract_string(obj, '$.intent') ELSE {q(d['intent'])} END AS intent,
       CASE WHEN json_extract_string(obj, '$.escalation') IN ({', '.join(q(x) for x in P.ESCALATIONS)})
            THEN json_extract_string(obj, '$.escalation') ELSE {q(d['escalation'])} END AS escalation,
       CASE WHEN json_extract_string(obj, '$.reason') IN ({', '.join(q(x) for x in P.REASONS)})
            THEN json_extract_string(obj, '$.reason') ELSE {q(d['reason'])} END AS reason,
       TRY_CAST(json_extract(obj, '$.k') AS BIGINT) AS k
FROM o"""
    s["rubric_scores"] = f"""
WITH sc AS ({RUBRIC})
SELECT conv_id, turn, intent, relevance, groundedness, tone, actionability, safety,
       round(CAST(relevance + groundedness + tone + actionability + safety AS DOUBLE) / CAST(5 AS DOUBLE), 1) AS overall
FROM sc"""
    s["rubric_by_class"] = f"""
WITH sc AS ({RUBRIC})
SELECT intent,
       CAST(sum(relevance + groundedness + tone + actionability + safety) AS DOUBLE)
         / (count(*) * CAST(5 AS DOUBLE)) AS mean_overall,
       count(*) AS count
FROM sc GROUP BY intent"""
    return s


def _contains_any(col: str, needles) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(x)})" for x in needles) + ")"


def _count_contained(col: str, needles) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({col}, {q(x)}) THEN 1 ELSE 0 END)" for x in needles) + ")"


def _rubric_sql() -> str:
    from ..operators.rubric import GROUND_WORD_RE
    r, f, lo = "coalesce(reply, '')", "coalesce(reference, '')", "lower(coalesce(reply, ''))"
    short = f"length({r}) < {P.RUBRIC_MIN_LEN}"
    hits = "CASE " + " ".join(f"WHEN intent = {q(k)} THEN {_count_contained(lo, v)}"
                              for k, v in P.RUBRIC_TOPICS.items()) + " ELSE 0 END"
    relevance = (f"CASE WHEN {short} THEN 1 WHEN ({hits}) >= 2 THEN 5 WHEN ({hits}) = 1 THEN 4 "
                 f"WHEN {_contains_any(lo, P.RUBRIC_GENERIC)} THEN 3 ELSE 2 END")
    rw = f"list_distinct(regexp_extract_all({lo}, {q(GROUND_WORD_RE)}))"
    fw = f"list_distinct(regexp_extract_all(lower({f}), {q(GROUND_WORD_RE)}))"
    share = f"(CAST(len(list_intersect({rw}, {fw})) AS DOUBLE) / CAST(len({rw}) AS DOUBLE))"
    steps = " ".join(f"WHEN {share} >= {lo_} THEN {sc}" for lo_, sc in P.GROUNDED_STEPS)
    grounded = f"CASE WHEN {r} = '' OR {f} = '' THEN 3 WHEN len({rw}) = 0 THEN 2 {steps} ELSE 2 END"
    shout = f"(upper({r}) = {r} AND lower({r}) <> {r} AND length({r}) > {P.TONE_SHOUT_LEN})"
    score = (f"(CAST(3 AS DOUBLE) + CASE WHEN {_contains_any(lo, P.TONE_EMPATHY)} THEN 1 ELSE 0 END "
             f"+ CASE WHEN {_contains_any(lo, P.TONE_POLITE)} THEN CAST(0.5 AS DOUBLE) ELSE 0 END "
             f"- CASE WHEN {_contains_any(lo, P.TONE_ABUSE)} THEN 3 ELSE 0 END "
             f"- CASE WHEN {shout} THEN 1 ELSE 0 END)")
    tone = f"CASE WHEN {short} THEN 1 ELSE CAST(greatest(1, least(5, round_even({score}, 0))) AS INTEGER) END"
    act = (f"CASE WHEN {short} THEN 1 "
           f"WHEN escalation = 'escalate' AND {_contains_any(lo, P.ACT_ESC_CONTACT)} THEN 5 "
           f"WHEN escalation = 'escalate' AND {_contains_any(lo, P.ACT_ESC_FOLLOW)} THEN 4 "
           f"WHEN escalation = 'escalate' THEN 2 "
           f"WHEN {_contains_any(lo, P.ACT_AUTO_STEPS)} THEN 5 "
           f"WHEN {_contains_any(lo, P.ACT_AUTO_HELP)} THEN 4 ELSE 3 END")
    code = f"(?:^|{P.NOT_WORD}){P.SAFETY_CODE}(?:$|{P.NOT_WORD})"
    promise = P.words(P.SAFETY_PROMISE_WORDS)
    pct = f"(?:^|{P.NOT_WORD}){P.SAFETY_PROMISE_PERCENT}"
    safety = (f"CASE WHEN {r} = '' THEN 1 WHEN regexp_matches({r}, {q(code)}) THEN 2 "
              f"WHEN regexp_matches({r}, {q(P.SAFETY_MONEY)}) AND NOT contains({lo}, 'refund') THEN 3 "
              f"WHEN regexp_matches({lo}, {q(promise)}) OR regexp_matches({lo}, {q(pct)}) THEN 3 ELSE 5 END")
    return f"""
WITH s AS (SELECT *, {escalation('intent', 'msg')} AS escalation FROM ({SCORED})),
j AS (SELECT s.*, n.reply AS reference FROM s LEFT JOIN s n ON n.conv_id = s.conv_id AND n.turn = s.turn + 2)
SELECT conv_id, turn, intent,
       CAST({relevance} AS INTEGER) AS relevance, CAST({grounded} AS INTEGER) AS groundedness,
       CAST({tone} AS INTEGER) AS tone, CAST({act} AS INTEGER) AS actionability,
       CAST({safety} AS INTEGER) AS safety
FROM j"""


RUBRIC = _rubric_sql()
SQL.update(_sql_labelling())


# ---------------------------------------------------------------------------
# TF-IDF, retrieval, stream


def vector_tokens_sql(docs: str, key: str, text: str) -> str:
    """(key, term): words and pairs of neighbouring words; the words of a text
    are extracted once and paired with themselves one place on."""
    return f"""SELECT {key}, unnest(list_concat(u, list_transform(
    list_zip(u[1:greatest(len(u) - 1, 0)], u[2:]), lambda p: p[1] || ' ' || p[2]))) AS term
  FROM (SELECT {key}, regexp_extract_all(lower({text}), {q(TX.VECTOR_TOKEN_RE)}) AS u FROM {docs})"""


def tfidf_sql(docs: str, key: str, text: str, min_df: int, max_features: int, out: str) -> str:
    """CTEs <out>_tf, <out>_v (vocabulary) and <out> (key, term, w normalised)."""
    return f"""
{out}_docs AS ({docs}),
{out}_tok AS ({vector_tokens_sql(f"{out}_docs", key, text)}),
{out}_tf AS (SELECT {key}, term, count(*) AS tf FROM {out}_tok GROUP BY {key}, term),
{out}_st AS (SELECT term, count(*) AS df, sum(tf) AS ttf FROM {out}_tf GROUP BY term HAVING count(*) >= {min_df}),
{out}_v AS (SELECT term, df, ln((1 + (SELECT count(*) FROM {out}_docs)) / (df + CAST(1 AS DOUBLE))) + 1 AS idf
            FROM {out}_st ORDER BY ttf DESC, term LIMIT {max_features}),
{out}_w0 AS (SELECT t.{key}, t.term, t.tf * v.idf AS w FROM {out}_tf t JOIN {out}_v v ON v.term = t.term),
{out} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {out}_w0)"""


def query_vectors_sql(docs: str, key: str, text: str, vocab: str, out: str) -> str:
    return f"""
{out}_docs AS ({docs}),
{out}_tok AS ({vector_tokens_sql(f"{out}_docs", key, text)}),
{out}_tf AS (SELECT {key}, term, count(*) AS tf FROM {out}_tok GROUP BY {key}, term),
{out}_w0 AS (SELECT t.{key}, t.term, t.tf * v.idf AS w FROM {out}_tf t JOIN {vocab} v ON v.term = t.term),
{out} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {out}_w0)"""


POOL = f"""
SELECT pair_key, conv_id, turn, cm, br FROM (
  SELECT lpad(CAST(conv_id AS VARCHAR), 19, '0') || ':' || lpad(CAST(turn AS VARCHAR), 19, '0') || ':' || md5(brand_reply) AS pair_key,
         conv_id, turn,
         {clean('customer_msg')} AS cm, {clean('brand_reply')} AS br
  FROM ({PAIRS}))
WHERE br IS NOT NULL AND trim(br) <> ''"""

BENCH = f"SELECT item_id, {clean('text')} AS qt FROM benchmark"


POOL_NONBLANK_MSG = f"SELECT * FROM ({POOL}) WHERE cm IS NOT NULL AND trim(cm) <> ''"


def retrieval_sql(min_df: int, max_features: int, k: int, pool: str = POOL) -> str:
    return f"""
WITH {tfidf_sql(pool, 'pair_key', 'cm', min_df, max_features, 'pv')},
{query_vectors_sql(BENCH, 'item_id', 'qt', 'pv_v', 'qv')},
sc AS (SELECT qv.item_id, pv.pair_key, sum(qv.w * pv.w) AS score
       FROM qv JOIN pv ON pv.term = qv.term GROUP BY qv.item_id, pv.pair_key),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, pair_key) AS rank
       FROM sc WHERE score > 0),
top AS (SELECT * FROM rk WHERE rank <= {k})"""


def _sql_scoring() -> dict[str, str]:
    s: dict[str, str] = {}
    s["tfidf_weights"] = f"""
WITH {tfidf_sql(CLEAN_DOCS, 'doc_id', 'c', 2, 5000, 'dw')}
SELECT doc_id, term, round(w, 6) AS weight FROM dw"""
    s["retrieve_top1"] = retrieval_sql(1, 5000, 1) + f"""
SELECT b.item_id, p.conv_id, p.turn, round(top.score, 6) AS score, p.br AS reply
FROM benchmark b LEFT JOIN top ON top.item_id = b.item_id
LEFT JOIN ({POOL}) p ON p.pair_key = top.pair_key"""
    line = template_sql(P.PROMPT_LINE, customer=f"substr(p.cm, 1, {P.PROMPT_CUSTOMER_CHARS})",
                        reply=f"substr(p.br, 1, {P.PROMPT_REPLY_CHARS})")
    s["retrieve_top3_prompt"] = retrieval_sql(2, 8000, 3, POOL_NONBLANK_MSG) + f""",
lines AS (SELECT top.item_id, top.rank, {line} AS line FROM top JOIN ({POOL}) p ON p.pair_key = top.pair_key),
agg AS (SELECT item_id, count(*) AS n, string_agg(line, chr(10) ORDER BY rank) AS prompt FROM lines GROUP BY item_id)
SELECT b.item_id, CAST(coalesce(agg.n, 0) AS BIGINT) AS n_examples,
       coalesce(agg.prompt, {q(P.PROMPT_EMPTY)}) AS prompt
FROM benchmark b LEFT JOIN agg ON agg.item_id = b.item_id"""
    s["stream_scoring"] = f"""
WITH m AS (SELECT conv_id, turn, {clean('text')} AS msg FROM conversations WHERE role = 'user'),
i AS (SELECT conv_id, turn, msg, {first_label('msg', LX.INTENT_LEXICON, LX.INTENT_DEFAULT)} AS intent FROM m),
e AS (SELECT conv_id, turn, intent, {escalation('intent', 'msg')} AS escalation,
             {reason('intent', 'msg', 'hybrid')} AS r0 FROM i)
SELECT conv_id, turn, intent, escalation, {consistent_reason('escalation', 'r0', 'intent')} AS reason FROM e"""
    return s


SQL.update(_sql_scoring())


def _sql_extra() -> dict[str, str]:
    s: dict[str, str] = {}
    s["answered_messages"] = """
SELECT m.conv_id, m.turn FROM conversations m
WHERE m.role = 'user' AND EXISTS (SELECT 1 FROM conversations r
  WHERE r.role = 'assistant' AND r.conv_id = m.conv_id AND r.turn = m.turn + 1)"""
    s["audit_top_rows"] = f"""
SELECT id, intent, escalation, reason, difficulty, rule FROM ({AUDIT}) ORDER BY id, rule LIMIT 20"""
    s["label_drift"] = """
WITH two AS (SELECT CASE WHEN quality = 1 THEN 'keep' WHEN quality = 0 THEN 'drop' END AS pass1,
                    CASE WHEN toxic = 0 THEN 'keep' WHEN toxic = 1 THEN 'drop' END AS pass2 FROM labels)
SELECT pass1 AS "from", pass2 AS "to", count(*) AS count FROM two
WHERE pass1 IS DISTINCT FROM pass2 GROUP BY pass1, pass2"""
    return s


SQL.update(_sql_extra())


def _sql_all_pairs() -> dict[str, str]:
    pool_q = f"SELECT pair_key AS q_key, cm AS qt FROM ({POOL})"
    return {"retrieve_all_pairs": f"""
WITH {tfidf_sql(POOL, 'pair_key', 'cm', 1, 5000, 'pv')},
{query_vectors_sql(pool_q, 'q_key', 'qt', 'pv_v', 'qv')},
sc AS (SELECT qv.q_key, pv.pair_key, sum(qv.w * pv.w) AS score
       FROM qv JOIN pv ON pv.term = qv.term WHERE qv.q_key <> pv.pair_key
       GROUP BY qv.q_key, pv.pair_key),
rk AS (SELECT *, row_number() OVER (PARTITION BY q_key ORDER BY round(score, 9) DESC, pair_key) AS rank
       FROM sc WHERE score > 0)
SELECT q.conv_id AS q_conv_id, q.turn AS q_turn, m.conv_id AS m_conv_id, m.turn AS m_turn,
       round(rk.score, 6) AS score
FROM rk JOIN ({POOL}) q ON q.pair_key = rk.q_key JOIN ({POOL}) m ON m.pair_key = rk.pair_key
WHERE rk.rank = 1"""}


SQL.update(_sql_all_pairs())


def _sql_workbook() -> dict[str, str]:
    return {"review_workbook": f"""
WITH pool AS ({DEDUP_POOL}),
r AS (SELECT doc_id, text, lang, row_number() OVER (PARTITION BY lang ORDER BY {md5_order('doc_id', 42)}, doc_id) AS rn
      FROM pool),
p AS (SELECT * FROM r WHERE rn <= {_case_sql('lang', LX.LANG_QUOTAS, 0)})
SELECT row_number() OVER (ORDER BY {md5_order('doc_id', '42w')}, doc_id) AS id,
       {clean('text')} AS customer_msg_clean, '' AS brand_reply_clean,
       {_case_sql('lang', LX.LANG_HINTS, 'other')} AS intent_llm_guess,
       '' AS intent, '' AS escalation_ground_truth, '' AS escalation_reason, '' AS golden_reply,
       '' AS difficulty, false AS is_edge_case, '' AS notes
FROM p"""}


SQL.update(_sql_workbook())


def _sql_sources() -> dict[str, str]:
    blank = "CASE WHEN trim({0}, ' ') = '' THEN NULL ELSE {0} END"
    key = "conv_id::VARCHAR || lpad(turn::VARCHAR, 6, '0')"
    return {
        "csv_documents": f"""
SELECT doc_id, md5({blank.format('text')}) AS text_md5, length({blank.format('text')})::BIGINT AS length,
       coalesce({blank.format('lang')}, '') AS lang, {blank.format('source')} AS source, n_chars FROM documents""",
        "raw_message_pairs": f"""
SELECT {key.replace('conv_id', 'm.conv_id').replace('turn', 'm.turn')} AS message_id,
       md5({blank.format('m.text')}) AS customer_md5, md5({blank.format('r.text')}) AS reply_md5
FROM conversations m JOIN conversations r ON r.conv_id = m.conv_id AND r.turn = m.turn + 1
WHERE m.role = 'user' AND r.role <> 'user'""",
        "messy_scores": "SELECT doc_id, quality + 0.5::DOUBLE AS score, toxic::INTEGER AS toxic FROM labels WHERE toxic <> 1",
    }


SQL.update(_sql_sources())
SQL["stream_reply_pairs"] = SQL["reply_pairs"]
SQL["price_quantiles"] = "SELECT l_returnflag, l_linestatus, " + ", ".join(
    f"round(quantile_cont(l_extendedprice::DOUBLE, {p}), 6) AS {name}"
    for p, name in ((0.01, "q01"), (0.25, "q25"), (0.5, "q50"), (0.9, "q90"), (0.999, "q999"))
) + " FROM lineitem GROUP BY ALL"
SQL["top_ngrams"] = f"""
WITH t AS MATERIALIZED (SELECT {eda_tokens('c')} AS w FROM ({CLEAN_DOCS})),
g AS ({" UNION ALL ".join(f"SELECT array_to_string(w[i:i + {k - 1}], ' ') AS gram FROM (SELECT w, unnest(range(1, len(w) - {k - 2})) AS i FROM t)"
                          for k in (1, 2, 3))})
SELECT gram, count(*) AS count FROM g GROUP BY gram ORDER BY count DESC, gram LIMIT 60"""
SQL["correct_files"] = SQL["apply_corrections"].replace("lst.doc_id IS NOT NULL AS corrected", "l.quality AS quality_before")
SQL["policy_from_rules"] = f"""
SELECT conv_id, turn, intent, escalation, {reason('intent', 'msg', 'hybrid')} AS reason_hybrid,
       {reason('intent', 'msg', 'simple')} AS reason_simple,
       {policy_reason('intent', 'msg', 'escalation', amount='(conv_id * 37 % 9000)')} AS reason_policy
FROM (SELECT *, {escalation('intent', 'msg')} AS escalation FROM ({SCORED}))"""
