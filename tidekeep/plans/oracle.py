"""ANSI SQL counterparts of the catalog, for an engine that holds the same parquet tables.

The statements are written from the operator definitions, not generated from the Spark plans;
only constant lists (words, labels, templates) are shared with the package. Constants carry an
exponent so that they are doubles.
"""

from __future__ import annotations

import re

from ..functions import entities as ent
from ..functions import risk as rk
from ..learning import newton as nw
from ..learning import vocabulary as voc
from ..lexicon import EUROPEAN as LEX
from ..operators import decide as dc
from ..operators import guardrails as gr
from ..operators import outreach as og
from ..operators import timeline as tl
from ..schemas import (BANDS, BOOLEAN, ISSUES, LANGUAGES, SEGMENTS, SIGNALS,
                       VERDICTS)
from ..sources import adapters as ad
from .scenarios import SCENARIOS


# ------------------------------------------------------------ fragments
def s(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def lst(values) -> str:
    return ", ".join(s(v) for v in values)


def case(key: str, table: dict, default: str = "NULL", text: bool = True) -> str:
    arms = " ".join(f"WHEN {s(k)} THEN {s(v) if text else v}" for k, v in table.items())
    return f"(CASE {key} {arms} ELSE {default} END)"


def any_of(low: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({low}, {s(p.lower())})" for p in phrases) + ")"


def exact(x: str, digits: int) -> str:
    """Nearest decimal of the binary value, as integer units."""
    scale = f"1e{digits}"
    high = f"({x} * 1.34217729e8 - ({x} * 1.34217729e8 - {x}))"
    hs, ls = f"({high} * {scale})", f"(({x} - {high}) * {scale})"
    whole = f"CAST(floor({hs} + {ls}) AS BIGINT)"
    rest = f"((({hs} - {whole}) - 0.5e0) + {ls})"
    return (f"({whole} + CASE WHEN {rest} > 0 OR ({rest} = 0 AND {whole} % 2 <> 0)"
            f" THEN 1 ELSE 0 END)")


def exact_round(x: str, digits: int) -> str:
    return f"({exact(x, digits)} / 1e{digits})"


def rint(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def pct(x: str) -> str:
    return f"(CAST({rint(f'{x} * 1e2')} AS VARCHAR) || '%')"


def fixed2(x: str) -> str:
    units = exact(x, 2)
    return (f"(CAST({units} // 100 AS VARCHAR) || '.' ||"
            f" lpad(CAST({units} % 100 AS VARCHAR), 2, '0'))")


def nth(values, k: str, shift: int = 0) -> str:
    return f"list_extract([{lst(values)}], CAST(({k} + {shift}) % {len(values)} AS INTEGER) + 1)"


def numbers(low: str, pattern: str) -> str:
    num = s(ent.NUMBER)
    digits = f"translate(regexp_extract(m, {num}), {s(ent.LOCAL_DIGITS)}, {s(ent.ASCII_DIGITS)})"
    return (f"list_transform(regexp_extract_all({low}, {s(pattern)}),"
            f" lambda m: try_cast(replace({digits}, ',', '') AS DOUBLE))")


def compact(values: str) -> str:
    return f"list_filter({values}, lambda v: v IS NOT NULL)"


def money_text(values: str) -> str:
    return (f"coalesce(array_to_string(list_transform({values}, lambda v:"
            f" CAST(CAST(v AS DECIMAL(38,2)) AS VARCHAR)), '|'), '')")


def found(low: str, phrases) -> str:
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN contains({low}, {s(p.lower())}) THEN {s(p)} END" for p in phrases) + ")"


def gazetteer(low: str, entries) -> str:
    keys: dict[str, list[str]] = {}
    for key, value in entries:
        keys.setdefault(value, []).append(key)
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN {any_of(low, keys[v])} THEN {s(v)} END" for v in sorted(keys)) + ")"


# ------------------------------------------------------------ shared tables
DAY = "CAST(o_orderdate AS DATE)"
PRICE = "CAST(o_totalprice AS DECIMAL(18,2))"
ORD = f"""ord AS (SELECT o_custkey, min({DAY}) AS first_day, max({DAY}) AS last_day,
  count(DISTINCT o_orderpriority) AS kinds, CAST(sum({PRICE}) AS DOUBLE) AS spend,
  count(*) AS n_orders,
  CAST(coalesce(sum(CASE WHEN {DAY} >= DATE '2000-08-01' THEN {PRICE} END), 0) AS DOUBLE)
    AS spend_recent,
  CAST(coalesce(sum(CASE WHEN {DAY} >= DATE '1999-08-01' AND {DAY} < DATE '2000-08-01'
    THEN {PRICE} END), 0) AS DOUBLE) AS spend_prior
  FROM orders GROUP BY o_custkey)"""
AMT = "CAST(value AS DECIMAL(18,2))"
HALF, WEEK = "CAST(ts AS DATE) >= DATE '2024-01-16'", "CAST(ts AS DATE) >= DATE '2024-01-24'"
EV = f"""ev AS (SELECT user_id,
  sum(CASE WHEN event_type = 'purchase' AND {WEEK} THEN 1 ELSE 0 END) AS week_purchases,
  sum(CASE WHEN event_type = 'purchase' AND {HALF} THEN 1 ELSE 0 END) AS half_purchases,
  sum(CASE WHEN event_type = 'error' AND {HALF} THEN 1 ELSE 0 END) AS half_errors,
  sum(CASE WHEN event_type = 'view' AND {HALF} THEN 1 ELSE 0 END) AS views_late,
  sum(CASE WHEN event_type = 'view' AND NOT ({HALF}) THEN 1 ELSE 0 END) AS views_early,
  CAST(coalesce(sum(CASE WHEN {WEEK} THEN {AMT} END), 0) AS DOUBLE) AS value_week,
  CAST(coalesce(sum(CASE WHEN NOT ({WEEK}) THEN {AMT} END), 0) AS DOUBLE) AS value_before
  FROM events GROUP BY user_id)"""
UNTIL = "DATE '2001-08-01'"
CUST = "'C' || lpad(CAST({} AS VARCHAR), 12, '0')"
MSG = "'M' || lpad(CAST({} AS VARCHAR), 12, '0')"
PROFILE = f"""profile AS (SELECT {CUST.format('c_custkey')} AS customer_id,
  r_name AS nationality_region,
  CAST(date_diff('month', coalesce(first_day, {UNTIL}), {UNTIL}) AS INTEGER) AS tenure_months,
  CASE WHEN c_acctbal < 5000 THEN 'Mass' WHEN c_acctbal < 9000 THEN 'Premium' ELSE 'Private' END
    AS segment,
  CAST(coalesce(kinds, 0) AS INTEGER) AS products_held,
  coalesce(spend / n_orders, 0e0) AS avg_balance_aed,
  CASE WHEN coalesce(spend_prior, 0) = 0 THEN 0e0
    ELSE (coalesce(spend_recent, 0e0) - spend_prior) / greatest(spend_prior, 1e-2) END
    AS balance_trend_3m,
  CASE WHEN user_id IS NULL THEN true ELSE week_purchases > 0 END AS salary_credit_active,
  CAST(coalesce(half_purchases, 0) AS INTEGER) AS remittance_count_3m,
  coalesce(value_week > 1.5e0 * (value_before / 23e0 * 7e0), false) AS intl_transfer_spike,
  CAST(coalesce(half_errors, 0) AS INTEGER) AS complaints_6m,
  CASE WHEN coalesce(views_early, 0) = 0 THEN 0e0
    ELSE CAST(views_late - views_early AS DOUBLE) / CAST(views_early AS DOUBLE) END
    AS branch_visits_trend,
  CAST(floor(coalesce(spend, 0e0) * 5e-3) AS INTEGER) AS clv_estimate_aed,
  coalesce(last_day < DATE '2000-08-01', true) AS churned
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN ord ON o_custkey = c_custkey LEFT JOIN ev ON user_id = c_custkey)"""

Z = "4e-1 + " + " + ".join(
    f"({w:.1e}) * CAST(CAST({f} AS INTEGER) AS DOUBLE)" if f != "balance_trend_3m"
    else f"({w:.1e}) * {f}" for f, w in ad.FIXED_WEIGHTS.items())


def band_of(x: str) -> str:
    arms = " ".join(f"WHEN {x} >= {f}e0 THEN {s(b)}" for b, f in rk.BAND_FLOORS)
    return f"(CASE {arms} ELSE 'Low' END)"


BOOK = (f"scored AS (SELECT *, 1e0 / (1e0 + exp(-({Z}))) AS behaviour_risk FROM profile), "
        f"book AS (SELECT *, {band_of('behaviour_risk')} AS band FROM scored)")

CLOSE = case("source", {k: v[0] for k, v in ad.CLOSINGS.items()})
MESSAGE = f"""message AS (SELECT {MSG.format('doc_id')} AS message_id,
  {CUST.format("(doc_id * 7) % CAST(floor((SELECT count(*) FROM customer) * 4e0 / 3e0) AS BIGINT)")}
    AS customer_id,
  concat_ws(' ', text, {CLOSE}) AS text, lang AS language,
  {case('source', {k: v[1] for k, v in ad.CLOSINGS.items()}, "'General_Query'")} AS issue_type,
  {case('source', {k: v[2] for k, v in ad.CLOSINGS.items()}, "'Low'")} AS churn_signal,
  lower(concat_ws(' ', text, {CLOSE})) AS low FROM documents)"""

ISSUE = "(CASE " + " ".join(f"WHEN {any_of('low', ws)} THEN {s(k)}" for k, ws in LEX.issues) + (
    f" ELSE {s(LEX.fallback_issue)} END)")
KEYWORDS = f"""labelled AS (SELECT message_id, customer_id, text, low, language,
  issue_type AS true_issue, churn_signal AS true_signal,
  {any_of('low', LEX.leaving)} AS leaving_confirmed, {ISSUE} AS issue_type,
  CASE WHEN {any_of('low', LEX.leaving)} THEN 'High' WHEN {any_of('low', LEX.wavering)}
    THEN 'Medium' ELSE 'Low' END AS churn_signal FROM message),
keyword AS (SELECT *, CASE WHEN issue_type = 'General_Query' THEN 4e-1 ELSE 7e-1 END
  AS issue_confidence, CASE WHEN churn_signal = 'Low' THEN 6e-1 ELSE 7.5e-1 END
  AS churn_signal_confidence FROM labelled)"""

NAMES = [n for n, _ in LEX.languages]


def language_ctes(source: str, key: str, text: str, prefix: str) -> str:
    """Tables {prefix}_tok, {prefix}_share and {prefix}_lang(key, language, confidence)."""
    tok = "regexp_extract_all(lower(" + text + "), '[a-z'']+')"
    shares = ", ".join(
        f"CAST(len(list_filter(tok, lambda t: list_contains([{lst(ws)}], t))) AS DOUBLE)"
        f" / greatest(len(tok), 1) AS share_{n}" for n, ws in LEX.languages)
    best = "greatest(" + ", ".join(f"share_{n}" for n in NAMES) + ")"
    picks = " ".join(f"WHEN share_{n} > 1.2e-1 AND share_{n} = {best} THEN {s(n)}"
                     for n in NAMES)
    return f"""{prefix}_tok AS (SELECT {key}, {text} AS body, {tok} AS tok FROM {source}),
{prefix}_share AS (SELECT {key}, body, len(tok) AS n_words, {shares} FROM {prefix}_tok),
{prefix}_lang AS (SELECT {key},
  CASE WHEN regexp_matches(body, '[؀-ۿ]') THEN 'ar' WHEN n_words = 0 THEN 'en' {picks}
    ELSE 'en' END AS language,
  CASE WHEN regexp_matches(body, '[؀-ۿ]') THEN 9.9e-1 WHEN n_words = 0 THEN 5e-1
    WHEN {best} > 1.2e-1 THEN least(9.9e-1, 6e-1 + {best}) ELSE 9e-1 END AS confidence
  FROM {prefix}_share)"""


LIVE = language_ctes("message", "message_id", "text", "msg") + """,
live AS (SELECT k.* EXCLUDE (language), l.language, l.confidence AS language_confidence
  FROM keyword k JOIN msg_lang l USING (message_id))"""

TREND = f"'balance moved ' || {pct('balance_trend_3m')} || ' in three months'"
REASONS = f"""concat_ws('|', CASE WHEN balance_trend_3m < -1.5e-1 THEN {TREND} END,
  CASE WHEN NOT salary_credit_active THEN 'salary no longer arrives' END,
  CASE WHEN intl_transfer_spike THEN 'unusual foreign transfers' END,
  CASE WHEN complaints_6m >= 3 THEN complaints_6m || ' complaints in half a year' END,
  CASE WHEN branch_visits_trend < -4e-1 THEN 'branch visits dropping fast' END,
  CASE WHEN tenure_months <= 12 THEN 'customer for only ' || tenure_months || ' months' END,
  CASE WHEN remittance_count_3m >= 8 THEN remittance_count_3m
    || ' remittances in three months' END)"""
HEADLINE = (f"CASE WHEN leaving_confirmed THEN {s(rk.STATES_LEAVING)} WHEN churn_signal = 'High'"
            f" THEN {s(rk.HIGH_INTENT)} END")


def risk_ctes(source: str, prefix: str = "") -> str:
    p = prefix
    return f"""{p}mixed AS (SELECT q.*, coalesce(b.behaviour_risk, 5e-1) AS behaviour,
  CASE q.churn_signal WHEN 'High' THEN 9e-1 WHEN 'Medium' THEN 5.5e-1 ELSE 1.5e-1 END
    AS text_score, b.customer_id IS NOT NULL AS profile_found,
  coalesce(b.segment, 'Unknown') AS segment,
  CAST(coalesce(b.clv_estimate_aed, 0) AS DOUBLE) AS clv_estimate_aed,
  CASE WHEN b.customer_id IS NULL THEN {s(rk.NO_PROFILE)} ELSE b.reasons END AS known_reasons
  FROM {source} q LEFT JOIN (SELECT *, {REASONS} AS reasons FROM book) b
    ON q.customer_id = b.customer_id),
{p}summed AS (SELECT *, 5.5e-1 * behaviour + 4.5e-1 * text_score AS mixed FROM {p}mixed),
{p}floored AS (SELECT *, CASE WHEN leaving_confirmed THEN greatest(mixed, 8.5e-1) ELSE mixed END
  AS fused FROM {p}summed),
{p}capped AS (SELECT *, least(fused, 1e0) AS fused1 FROM {p}floored),
{p}risk AS (SELECT *, {exact_round('behaviour', 3)} AS behaviour_score,
  {exact_round('fused1', 3)} AS fused_risk, {band_of('fused')} AS risk_band,
  issue_confidence < 5e-1 OR churn_signal_confidence < 5e-1 AS needs_human_triage,
  array_to_string(list_slice(string_split(concat_ws('|', {HEADLINE},
    nullif(known_reasons, '')), '|'), 1, 5), '|') AS reasons
  FROM {p}capped)"""


HIGH = "risk_band IN ('Critical', 'High')"
CAP = "2e-2 * clv_estimate_aed"
RULE = f"""(CASE WHEN needs_human_triage THEN '0' WHEN leaving_confirmed THEN '1'
  WHEN {HIGH} AND issue_type = 'Fees_Charges' AND 2e2 <= {CAP} THEN '2a'
  WHEN {HIGH} AND issue_type = 'Fees_Charges' THEN '2a'''
  WHEN {HIGH} AND issue_type = 'Remittance_Transfer' AND 1e2 <= {CAP} THEN '2b'
  WHEN {HIGH} AND issue_type = 'Remittance_Transfer' THEN '2b'''
  WHEN {HIGH} AND issue_type = 'Loan_Mortgage' THEN '2c'
  WHEN {HIGH} AND segment IN ('Premium', 'Private') THEN '2d'
  WHEN {HIGH} THEN '2e'
  WHEN issue_type IN ('App_Technical', 'Card_Services') THEN '3'
  WHEN risk_band = 'Medium' THEN '4' ELSE '5' END)"""
CAPT = f"CAST({rint(CAP)} AS VARCHAR)"
LINES = {
    "0": "'Rule 0: confidence < 0.5'", "1": "'Rule 1: leaving = true'",
    "2a": f"'Rule 2a: fees; 200 <= cap ' || {CAPT}",
    "2a'": f"'Rule 2a'': fees; 200 > cap ' || {CAPT}",
    "2b": f"'Rule 2b: remittance; 100 <= cap ' || {CAPT}",
    "2b'": f"'Rule 2b'': remittance; 100 > cap ' || {CAPT}",
    "2c": "'Rule 2c: loan; no offer'", "2d": "'Rule 2d: segment ' || segment",
    "2e": "'Rule 2e: issue ' || issue_type", "3": "'Rule 3: issue ' || issue_type",
    "4": "'Rule 4: band Medium'", "5": "'Rule 5: nothing above applies'",
}


def plan_ctes(prefix: str = "") -> str:
    p = prefix
    return f"""{p}ruled AS (SELECT *, {RULE} AS rule_id FROM {p}risk),
{p}acted AS (SELECT *, {case('rule_id', dc.RULE_ACTION)} AS action,
  CASE rule_id WHEN '2a' THEN 2e2 WHEN '2b' THEN 1e2 ELSE 0e0 END AS offer_value_aed
  FROM {p}ruled),
{p}plan AS (SELECT *, {case('action', dc.ACTION_LABELS)} AS action_label,
  CASE WHEN offer_value_aed > 0 THEN offer_value_aed <= {CAP} ELSE true END
    AS offer_within_budget,
  concat_ws('|', CASE WHEN rule_id LIKE '2%' THEN 'Rule 2: band ' || risk_band || ' ('
    || {fixed2('fused_risk')} || ')' END,
    {case('rule_id', LINES, text=False)}) AS rationale FROM {p}acted)"""


def template_ctes(source: str, prefix: str) -> str:
    rows = ", ".join(f"({s(a)}, {s(lang)}, {s(text)})" for a, ts in og.TEMPLATES.items()
                     for lang, text in ts.items())
    return f"""{prefix}_tpl(action, lang, template) AS (VALUES {rows}),
{prefix}_text AS (SELECT p.*, coalesce(x.lang, 'en') AS template_language,
  replace(replace(coalesce(x.template, e.template), '{{offer}}',
    CAST({rint('offer_value_aed')} AS VARCHAR)), '{{answer}}', {s(og.QUERY_ANSWER)})
    AS template_text
  FROM {source} p LEFT JOIN {prefix}_tpl x ON x.action = p.action AND x.lang =
    CASE WHEN p.action = 'human_triage' THEN 'en' ELSE p.language END
  LEFT JOIN {prefix}_tpl e ON e.action = p.action AND e.lang = 'en')"""


DRAFT_CLOSE = case("source", ad.DRAFT_CLOSINGS)
CANDIDATE = f"""candidate_text AS (SELECT {MSG.format('doc_id')} AS message_id,
  CASE WHEN source <> 'src7' THEN concat_ws(' ', text, {DRAFT_CLOSE}) END AS candidate
  FROM documents)"""
AMOUNTS = numbers("low_draft", ent.PREFIXED_AMOUNT)
INVENTED = (f"list_sort(list_distinct(list_filter({compact(AMOUNTS)},"
            f" lambda v: NOT (offer_value_aed > 0 AND v = offer_value_aed))))")
URGENT = found("low_draft", LEX.urgency)
SLOTS = f"list_slice(regexp_extract_all(candidate, {s(gr.PLACEHOLDER)}), 1, 3)"
PRESSURE = f"(action = 'dignified_goodbye' AND {any_of('low_draft', LEX.pressure)})"
WORDS = f"len(regexp_extract_all(candidate, {s('[^' + ent.BLANK_CHARS + ']+')}))"
FLAGGED = f"""nullif(concat_ws('|',
  array_to_string(list_transform(list_filter(string_split({URGENT}, '|'), lambda u: u <> ''),
    lambda u: 'urgent wording: ' || u), '|'),
  CASE WHEN len({SLOTS}) > 0 THEN 'open placeholders: ' || array_to_string({SLOTS}, ', ') END,
  CASE WHEN len({INVENTED}) > 0 THEN 'unapproved amounts: ' || array_to_string(list_transform(
    {INVENTED}, lambda a: CAST(a AS VARCHAR)), ', ') END,
  CASE WHEN {PRESSURE} THEN 'pressure to stay in a goodbye' END,
  CASE WHEN {WORDS} < 20 THEN 'too short' END,
  CASE WHEN seen <> language THEN 'wrong language: ' || seen || ' instead of ' || language END),
  '')"""


def serve_ctes(source: str, out: str) -> str:
    """Table ``out``: ``source`` with candidates checked and the served draft."""
    return f"""{CANDIDATE}, {template_ctes(source, out)},
{out}_pairs AS (SELECT p.*, d.candidate, lower(d.candidate) AS low_draft FROM {out}_text p
  LEFT JOIN candidate_text d USING (message_id)),
{language_ctes(f'(SELECT message_id, candidate FROM candidate_text WHERE candidate IS NOT NULL)',
               'message_id', 'candidate', f'{out}_cand')},
{out}_seen AS (SELECT p.*, l.language AS seen FROM {out}_pairs p
  LEFT JOIN {out}_cand_lang l USING (message_id)),
{out}_broken AS (SELECT *, len(list_filter({AMOUNTS}, lambda v: v IS NULL)) > 0 AS broken,
  candidate IS NOT NULL AND action <> 'human_triage' AS eligible FROM {out}_seen),
{out}_flags AS (SELECT *, CASE WHEN NOT eligible OR broken THEN '' ELSE
  ltrim(coalesce({FLAGGED}, ''), '|') END AS guardrail_flags FROM {out}_broken),
{out}_pick AS (SELECT *, eligible AND NOT broken AND guardrail_flags = '' AS own FROM {out}_flags),
{out} AS (SELECT *, CASE WHEN own THEN candidate ELSE template_text END AS draft_message,
  CASE WHEN own THEN language ELSE template_language END AS draft_language,
  CASE WHEN own THEN 'llm' ELSE 'template' END AS draft_source FROM {out}_pick)"""


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
VERDICT = """(CASE WHEN event_type = 'purchase' AND value > 30 THEN 'Approved with edits'
  WHEN event_type = 'purchase' THEN 'Approved' WHEN event_type = 'view' THEN 'Overridden'
  WHEN event_type = 'error' THEN 'Rejected' WHEN event_type = 'signup' AND value > 30
  THEN 'Dignified Goodbye' WHEN event_type = 'signup' THEN 'Escalated' END)"""


def dec(value: str) -> str:
    return f"CASE WHEN event_type <> 'click' THEN {value} END"


def evt(value: str) -> str:
    return f"CASE WHEN event_type = 'click' THEN {value} END"


ACTION_K = nth(ad.AUDIT_ACTIONS, "k")
AUDIT = f"""logged AS (SELECT *, {K} AS k FROM events),
audit AS (SELECT event_id AS seq, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  {evt("'event'")} AS type,
  {evt("CASE WHEN k % 2 = 0 THEN 'Outreach re-drafted' ELSE 'Draft edited' END")} AS step,
  {evt("CASE WHEN k % 2 = 0 THEN 'ai_system' ELSE 'human_reviewer' END")} AS actor,
  {evt("'event of value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)")} AS summary,
  {evt("'ok'")} AS status, {evt("k / 1e2")} AS confidence,
  {MSG.format('(event_id % (SELECT count(*) FROM documents)) * 2')} AS message_id,
  {CUST.format('user_id')} AS customer_id,
  {dec(nth(LANGUAGES, 'k'))} AS language, {dec(nth(ISSUES, 'k'))} AS issue_type,
  {dec(nth(SIGNALS, 'k'))} AS churn_signal, {dec('k >= 90')} AS leaving_confirmed,
  {dec('k / 1e2')} AS fused_risk,
  {dec("CASE WHEN k >= 75 THEN 'Critical' WHEN k >= 55 THEN 'High' WHEN k >= 35 THEN 'Medium' ELSE 'Low' END")}
    AS risk_band, {dec(ACTION_K)} AS action,
  {dec(f"CASE WHEN {ACTION_K} = 'fee_waiver' THEN 2e2 ELSE 0e0 END")} AS offer_value_aed,
  {dec("'template'")} AS draft_source, {VERDICT} AS human_verdict,
  CASE WHEN {VERDICT} IS NOT NULL AND k % 5 = 0 THEN 'second look' END AS reviewer_note,
  CASE WHEN {VERDICT} = 'Overridden' THEN {nth(ad.AUDIT_ACTIONS, 'k', 1)} END
    AS override_action FROM logged),
reviewed AS (SELECT * FROM audit WHERE human_verdict IS NOT NULL AND human_verdict <> ''),
status AS (SELECT message_id, human_verdict AS status FROM (SELECT *, row_number() OVER (
  PARTITION BY message_id ORDER BY timestamp DESC, seq DESC) AS rn FROM reviewed) z
  WHERE rn = 1),
stats AS (SELECT r.*, coalesce(p.segment, 'Unknown') AS segment FROM reviewed r
  LEFT JOIN profile p ON p.customer_id = r.customer_id)"""

BLANKS = s(ent.BLANKS)
INBOX = f"""inbox AS (SELECT
  CASE WHEN turn % 4 = 2 THEN ' ' || chr(9) || ' '
    ELSE chr(9) || 'T' || conv_id || '-' || turn || ' ' || chr(13) END AS message_id,
  CASE WHEN turn = 0 THEN 'C' || lpad(CAST(conv_id AS VARCHAR), 12, '0')
    WHEN turn = 4 THEN chr(9) END AS customer_id,
  CASE WHEN turn = 6 AND conv_id % 2 = 0 THEN chr(10) || chr(9) || chr(160)
    ELSE ' ' || chr(10) || chr(8195) || text || chr(9) || ' ' || chr(10) END AS text,
  CASE conv_id % 3 WHEN 0 THEN 'ar' WHEN 1 THEN 'auto' END AS lang_override
  FROM conversations WHERE role = 'user'),
tidy AS (SELECT coalesce(nullif(trim(message_id, {BLANKS}), ''), 'LIVE') AS message_id,
  coalesce(nullif(trim(customer_id, {BLANKS}), ''), 'UNKNOWN') AS customer_id,
  trim(text, {BLANKS}) AS text,
  lang_override, row_number() OVER () AS rid FROM inbox WHERE length(trim(text, {BLANKS})) > 0)"""

P = f"WITH {ORD}, {EV}, {PROFILE}"
B = f"{P}, {BOOK}"
M = f"WITH {MESSAGE}"
KW = f"{M}, {KEYWORDS}"
PM = f"{B}, {MESSAGE}"
A = f"{P}, {AUDIT}"
R = f"{PM}, {KEYWORDS}, {risk_ctes('(SELECT *, 1e0 AS language_confidence FROM keyword)')}"
PL = f"{R}, {plan_ctes()}"
QUEUE = """queue AS (SELECT message_id, customer_id, language AS lang, issue_type AS issue,
  churn_signal AS signal, fused_risk, risk_band AS band, segment, clv_estimate_aed AS clv_aed,
  action_label AS recommended, action, offer_value_aed AS offer FROM plan)"""
QU = f"{PL}, {QUEUE}"
OWN_CUSTOMER = CUST.format("(doc_id * 7) % CAST(floor((SELECT count(*) FROM customer) * 4e0 / 3e0)"
                           " AS BIGINT)")
HOT_MESSAGE = MESSAGE.replace(OWN_CUSTOMER, f"""CASE WHEN doc_id % 2 = 0 THEN {CUST.format('1')}
    WHEN doc_id % 10 = 1 THEN 'UNKNOWN' WHEN doc_id % 10 = 3 THEN NULL ELSE {OWN_CUSTOMER} END""")
QS = f"""{QU}, {AUDIT}, queue_status AS (SELECT q.*, coalesce(t.status, 'Pending Review') AS status
  FROM queue q LEFT JOIN status t USING (message_id))"""
LV = f"{M}, {KEYWORDS}, {LIVE}"
LP = f"{PM}, {KEYWORDS}, {LIVE}, {risk_ctes('live', 'l_')}, {plan_ctes('l_')}"
CS = f"{LP}, {serve_ctes('l_plan', 'served')}"
DR = f"""{PL}, {CANDIDATE}, drafts AS (SELECT p.*, d.candidate, lower(d.candidate) AS low_draft
  FROM plan p LEFT JOIN candidate_text d USING (message_id))"""


def part_ctes(source: str, stratum: str, key: str, ratio: str, out: str) -> str:
    return f"""{out}_n AS (SELECT {stratum} AS st, count(*) AS n FROM {source} GROUP BY 1),
{out}_t AS (SELECT st, n, sum(n) OVER () AS total, ceil(sum(n) OVER () * {ratio}) AS take
  FROM {out}_n),
{out}_b AS (SELECT st, take, CAST(n * take AS BIGINT) // CAST(total AS BIGINT) AS base,
  CAST(n * take AS BIGINT) % CAST(total AS BIGINT) AS rest FROM {out}_t),
{out}_q AS (SELECT st, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, st)
  <= take - sum(base) OVER () THEN 1 ELSE 0 END AS need FROM {out}_b),
{out} AS (SELECT x.*, row_number() OVER (PARTITION BY {stratum} ORDER BY md5({key}), {key})
  <= need AS held_out FROM {source} x JOIN {out}_q ON st = {stratum})"""


SPLIT = part_ctes("message", "issue_type || '_' || churn_signal", "message_id", "2e-1", "split")
SETS = f"""{KW}, {SPLIT}, preds AS (
  SELECT 'keywords' AS model, message_id, issue_type AS pred_issue, churn_signal AS pred_signal
    FROM keyword
  UNION ALL SELECT 'constant', message_id, 'General_Query', 'Low' FROM message),
sets AS (SELECT model, CASE WHEN held_out THEN 'held_out' ELSE 'rest' END AS dataset,
  message_id, pred_issue, pred_signal, language, issue_type, churn_signal
  FROM preds JOIN split USING (message_id)),
bakeoff AS (SELECT model, dataset, coalesce(language, '(all)') AS language, count(*) AS n,
  avg(CASE WHEN issue_type = pred_issue THEN 1e0 ELSE 0e0 END) AS issue_acc,
  avg(CASE WHEN churn_signal = pred_signal THEN 1e0 ELSE 0e0 END) AS signal_acc
  FROM sets GROUP BY GROUPING SETS ((model, dataset), (model, dataset, language)))"""
OUT = f"""{B}, outcome AS (SELECT customer_id, nationality_region, behaviour_risk,
  CAST(churned AS INTEGER) AS actual, CASE WHEN behaviour_risk >= 5e-1 THEN 1 ELSE 0 END
  AS predicted FROM book)"""
CHECKS = f"""{CS}, final AS (SELECT * FROM served WHERE action <> 'human_triage'),
{language_ctes('final', 'message_id', 'draft_message', 'fin')},
checks AS (SELECT f.message_id, f.action, f.language, draft_source AS served_by,
  draft_language AS served_language, NOT contains(guardrail_flags, 'wrong language')
    AS wrote_customer_language, l.language = f.language AS served_language_verified,
  guardrail_flags FROM final f JOIN fin_lang l USING (message_id))"""


def domain(values: list[str]) -> str:
    return ", ".join(f"({i}, {s(v)})" for i, v in enumerate(values))


RISKY = "behaviour_risk >= 5.5e-1"
CLV_RISK = f"coalesce(sum(CASE WHEN {RISKY} THEN clv_estimate_aed END), 0)"
NRISK = f"sum(CASE WHEN {RISKY} THEN 1 ELSE 0 END)"


def rate(test: str) -> str:
    return f"round(avg(CASE WHEN {test} THEN 1e0 ELSE 0e0 END), 6)"


def dist(table: str, column: str) -> str:
    return f"SELECT {column}, count(*) AS n FROM {table} GROUP BY {column}"


ENT = {"amounts": f"nullif({money_text(compact(numbers('low', ent.AMOUNT)))}, '')",
       "dates": f"nullif({found('low', LEX.dates)}, '')",
       "destinations": f"nullif({gazetteer('low', LEX.countries)}, '')",
       "products": f"nullif({gazetteer('low', LEX.products)}, '')"}
ENTS = ", ".join(f"{e} AS {n}" for n, e in ENT.items())
VIEW = (f"SELECT message_id, customer_id, lang, issue, signal,"
        f" CAST({rint('fused_risk * 1e2')} AS INTEGER) AS fused_risk, band, segment,"
        f" {rint('clv_aed')} AS clv_aed, recommended, status FROM queue_status")
AUDIT_VIEW = """SELECT seq, coalesce(timestamp, '') AS timestamp,
  coalesce(type, 'decision') AS type,
  coalesce(nullif(actor, ''), human_verdict, '') AS actor_or_verdict,
  coalesce(customer_id, '') AS customer,
  coalesce(nullif(summary, ''), coalesce(issue_type, '') || ' ' || coalesce(churn_signal, '')
    || ' -> ' || coalesce(risk_band, '') || ' -> ' || coalesce(action, '')) AS summary,
  coalesce(nullif(status, ''), human_verdict, '') AS status FROM audit"""
STRIP = f"regexp_replace(lower(text), {s('[' + re.escape(voc.PUNCTUATION) + ']')}, '', 'g')"
VOC = f"""{M}, toks AS (SELECT message_id, regexp_extract_all({STRIP},
  {s('[^' + ent.BLANK_CHARS + ']+')}) AS tok FROM message),
vocab AS (SELECT token, count(*) AS n FROM (SELECT unnest(tok) AS token FROM toks) u
  GROUP BY token ORDER BY n DESC, token DESC LIMIT 1998)"""

HEAD_LABELS = [("issue_type", ISSUES), ("churn_signal", SIGNALS)]
CLASS_ROWS = ", ".join(f"({s(h)}, {s(v)}, {k}, {len(vs)})"
                       for h, vs in HEAD_LABELS for k, v in enumerate(vs))


def bag(source: str, out: str) -> str:
    """{out}(message_id, token), a row per token of the texts of a table."""
    return f"""{out} AS (SELECT message_id, unnest(regexp_extract_all({STRIP},
  {s('[^' + ent.BLANK_CHARS + ']+')})) AS token FROM {source})"""


def counted_ctes(source: str, out: str) -> str:
    """{out}(message_id, issue_type, ..._confidence, churn_signal, ...): the count model fitted to
    table train, applied to the texts of a table."""
    heads = []
    for h, _ in HEAD_LABELS:
        heads.append(f"""{out}_{h} AS (SELECT message_id,
  first(label ORDER BY z DESC, place) AS best, 1e0 / sum(exp(z - top)) AS share
  FROM (SELECT *, max(z) OVER (PARTITION BY message_id) AS top
    FROM {out}_z WHERE head = {s(h)}) t GROUP BY message_id)""")
    return f"""{bag(source, out + '_bag')},
{out}_n AS (SELECT message_id, token, count(*) AS n FROM {out}_bag GROUP BY 1, 2),
{out}_sum AS (SELECT message_id, head, label, sum(n * weight) AS z FROM {out}_n
  JOIN odds USING (token) GROUP BY 1, 2, 3),
{out}_z AS (SELECT m.message_id, p.head, p.label, p.place, p.weight + coalesce(z, 0e0) AS z
  FROM {source} m CROSS JOIN priors p LEFT JOIN {out}_sum USING (message_id, head, label)),
{', '.join(heads)},
{out} AS (SELECT i.message_id, i.best AS issue_type, i.share AS issue_type_confidence,
  c.best AS churn_signal, c.share AS churn_signal_confidence
  FROM {out}_issue_type i JOIN {out}_churn_signal c USING (message_id))"""


def count_model(base: str) -> str:
    """Tables train, priors and odds of the count model on top of message and split."""
    return f"""{base}, rest AS (SELECT * EXCLUDE (held_out) FROM split WHERE NOT held_out),
{part_ctes('rest', "issue_type || '_' || churn_signal", 'message_id', '1.5e-1', 'tail')},
train AS (SELECT * FROM tail WHERE NOT held_out),
classes(head, label, place, of) AS (VALUES {CLASS_ROWS}),
truth AS (SELECT message_id, 'issue_type' AS head, issue_type AS label FROM train
  UNION ALL SELECT message_id, 'churn_signal', churn_signal FROM train),
known AS (SELECT t.* FROM truth t JOIN classes USING (head, label)),
priors AS (SELECT head, label, place, ln((count(message_id) + 1)
    / CAST(sum(count(message_id)) OVER (PARTITION BY head) + of AS DOUBLE)) AS weight
  FROM classes LEFT JOIN known USING (head, label) GROUP BY head, label, place, of),
{bag('train', 'train_bag')},
words AS (SELECT token FROM train_bag GROUP BY token ORDER BY count(*) DESC, token DESC LIMIT 1998),
cells AS (SELECT head, label, token, count(*) AS n FROM train_bag JOIN words USING (token)
  JOIN known USING (message_id) GROUP BY 1, 2, 3),
sizes AS (SELECT head, label, sum(n) AS total FROM cells GROUP BY 1, 2),
odds AS (SELECT c.head, c.label, w.token, ln((coalesce(n, 0) + 1)
    / CAST(coalesce(total, 0) + (SELECT count(*) FROM words) AS DOUBLE)) AS weight
  FROM classes c CROSS JOIN words w LEFT JOIN cells USING (head, label, token)
  LEFT JOIN sizes USING (head, label))"""


UNSEEN = ("unseen AS (SELECT 'U' || conv_id || '-' || turn AS message_id, concat_ws(' ', text,"
          " line) AS text, language, issue_type, churn_signal, lower(concat_ws(' ', text, line))"
          " AS low FROM conversations JOIN (VALUES " + ", ".join(
              f"({k}, {s(a)}, {s(b)}, {s(d)}, {s(e)})"
              for k, (a, b, d, e) in enumerate(ad.UNSEEN_CLOSINGS))
          + f") closing(k, line, language, issue_type, churn_signal)"
            f" ON (conv_id * 5 + turn) % {len(ad.UNSEEN_CLOSINGS)} = k WHERE role = 'user')")


def eval_sql(sets: list[tuple[str, str]]) -> str:
    """Predictions of keywords and of the count model on tables with text and labels."""
    parts, rows = [], []
    for name, source in sets:
        parts.append(counted_ctes(source, f"c_{name}"))
        parts.append(f"""k_{name} AS (SELECT message_id, {ISSUE} AS issue_type,
  CASE WHEN {any_of('low', LEX.leaving)} THEN 'High' WHEN {any_of('low', LEX.wavering)}
    THEN 'Medium' ELSE 'Low' END AS churn_signal FROM {source})""")
        for model, table in (("counts", f"c_{name}"), ("keywords", f"k_{name}")):
            rows.append(f"SELECT {s(model)} AS model, {s(name)} AS dataset, t.language,"
                        f" t.issue_type = p.issue_type AS issue_hit,"
                        f" t.churn_signal = p.churn_signal AS signal_hit"
                        f" FROM {source} t JOIN {table} p USING (message_id)")
    return ", ".join(parts) + ", hits AS (" + " UNION ALL ".join(rows) + """), report AS (
  SELECT model, dataset, coalesce(language, '(all)') AS language, count(*) AS n,
  avg(CASE WHEN issue_hit THEN 1e0 ELSE 0e0 END) AS issue_acc,
  avg(CASE WHEN signal_hit THEN 1e0 ELSE 0e0 END) AS signal_acc
  FROM hits GROUP BY GROUPING SETS ((model, dataset), (model, dataset, language)))"""


def reply(text: str, labels) -> str:
    arms = " ".join(f"WHEN contains(lower({text}), {s(v.lower())}) THEN {s(v)}" for v in labels)
    return f"(CASE {arms} ELSE {s(labels[-1])} END)"


def tier(x: str) -> str:
    return (f"CASE WHEN {x} >= 7.5e-1 THEN 'strong' WHEN {x} >= 5e-1 THEN 'fair'"
            f" ELSE 'weak' END AS {x}_tier")


def match_sql(sc) -> str:
    tests = [f"{k} = {s(v)}" for k, v in sc.message.items()]
    if sc.contains:
        tests.append(f"contains(low, {s(sc.contains)})")
    return " AND ".join(tests)


MSG_PICKS = " UNION ALL ".join(
    f"SELECT {s(x.name)} AS scenario, coalesce(min(CASE WHEN {match_sql(x)} THEN message_id END),"
    f" min(message_id)) AS message_id FROM message" for x in SCENARIOS)
CUST_PICKS = " UNION ALL ".join(
    f"SELECT {s(x.name)} AS scenario, coalesce(min(CASE WHEN {x.customer} THEN customer_id END),"
    f" min(customer_id)) AS customer_id FROM profile" for x in SCENARIOS)


def report_sql(ctes: str, source: str, actual: str, predicted: str, values: list[str]) -> str:
    """Class report of two columns of a table over labels given as SQL values."""
    rows = ", ".join(f"({v})" for v in values)
    return f"""{ctes}, lab(label) AS (VALUES {rows}),
per AS (SELECT label, sum(CASE WHEN {actual} = label AND {predicted} = label THEN 1 ELSE 0 END)
    AS tp, sum(CASE WHEN {predicted} = label THEN 1 ELSE 0 END) AS called,
  sum(CASE WHEN {actual} = label THEN 1 ELSE 0 END) AS support
  FROM lab CROSS JOIN {source} GROUP BY label),
rates AS (SELECT CAST(label AS VARCHAR) AS label,
  CASE WHEN called = 0 THEN 0e0 ELSE tp / CAST(called AS DOUBLE) END
    AS precision, CASE WHEN support = 0 THEN 0e0 ELSE tp / CAST(support AS DOUBLE) END AS recall,
  CASE WHEN called + support = 0 THEN 0e0 ELSE 2 * tp / CAST(called + support AS DOUBLE) END
    AS f1, support, tp FROM per)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM rates
UNION ALL SELECT 'accuracy', round(sum(tp) / CAST(sum(support) AS DOUBLE), 6),
  round(sum(tp) / CAST(sum(support) AS DOUBLE), 6),
  round(sum(tp) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM rates
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  CAST(sum(support) AS BIGINT) FROM rates
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM rates"""


def standard(column: str, cast: str) -> str:
    x = f"CAST({cast} AS DOUBLE)"
    return (f"round(({x} - avg({x}) OVER ()) / CASE WHEN stddev_pop({x}) OVER () = 0 THEN 1e0"
            f" ELSE stddev_pop({x}) OVER () END, 6) AS {column}")


def crosstab_sql(row: str) -> str:
    cells = ", ".join(f"CAST(sum(CASE WHEN churn_signal = {s(v)} THEN 1 ELSE 0 END) AS BIGINT)"
                      f" AS \"{v}\"" for v in SIGNALS)
    return f"{M} SELECT {row}, {cells} FROM message GROUP BY {row}"


STEP_SQL = [
    ("length(text) || ' chars, customer ' || customer_id", "NULL"),
    ("language", "language_confidence"),
    ("issue_type || ' (model: heuristic)'", "issue_confidence"),
    ("churn_signal", "churn_signal_confidence"),
    ("coalesce(nullif(concat_ws('; ', "
     + f"'amounts_aed: ' || nullif(array_to_string(list_transform("
       f"{compact(numbers('low', ent.AMOUNT))}, lambda v: CAST(v AS VARCHAR)), ', '), ''), "
     + ", ".join(f"'{n}: ' || replace({ENT[n]}, '|', ', ')"
                 for n in ("dates", "destinations", "products")) + "), ''), 'none')", "NULL"),
    (f"'P(churn) = ' || {pct('behaviour_score')} || CASE WHEN profile_found THEN ''"
     " ELSE ' (no profile, neutral prior)' END", "NULL"),
    (f"{pct('fused_risk')} || ' -> ' || risk_band", "NULL"),
    ("action_label", "NULL"),
    ("CASE WHEN draft_source = 'llm' THEN 'generated' ELSE 'template' END || ' in '"
     " || draft_language || CASE WHEN guardrail_flags <> '' THEN ', flags: '"
     " || len(string_split(guardrail_flags, '|')) ELSE '' END", "NULL"),
]
STEPS = " UNION ALL ".join(
    f"SELECT message_id, {i + 1} AS step_no, {s(tl.STEPS[i])} AS step, 'ai_system' AS actor,"
    f" {summary} AS summary, round(CAST({conf} AS DOUBLE), 6) AS conf FROM served"
    for i, (summary, conf) in enumerate(STEP_SQL))
NOTE = "coalesce(reviewer_note, '')"
LOG_STEPS = f"""SELECT message_id, timestamp, seq, 0 AS part, 'Human reviewed' AS step,
  'human_reviewer' AS actor, human_verdict || CASE WHEN {NOTE} <> '' THEN ' - "' || {NOTE} || '"'
  ELSE '' END AS summary FROM reviewed
UNION ALL SELECT message_id, timestamp, seq, 1, 'Final decision logged', 'ai_system',
  'appended to the audit log' FROM reviewed
UNION ALL SELECT message_id, timestamp, seq, 0, step, actor, summary FROM audit
  WHERE coalesce(human_verdict, '') = ''"""

LAST = f"""{PL}, {template_ctes('plan', 'q')}, {AUDIT},
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id
  ORDER BY timestamp DESC, seq DESC) AS rn FROM reviewed) z WHERE rn = 1)"""
FIRST = f"""first_verdict AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id
  ORDER BY timestamp, seq) AS rn FROM reviewed WHERE human_verdict IN ({lst(VERDICTS)})) z
  WHERE rn = 1)"""
ROW_CASE = "CASE WHEN v.human_verdict = 'Dignified Goodbye' THEN 'dignified_goodbye' ELSE c.action END"
PROMPT_HEAD = ("replace(" + s(og.PROMPT_RULES) + ", '{language}', coalesce(" + case(
    "language", og.LANGUAGE_NAMES) + f", nullif(language, ''), {s(og.LANGUAGE_UNKNOWN)}))")
def auc_sql(ctes: str, source: str, score: str) -> str:
    return f"""{ctes}, ranked AS (SELECT actual, rank() OVER (ORDER BY round({score}, 6))
  + (count(*) OVER (PARTITION BY round({score}, 6)) - 1) / 2e0 AS r FROM {source})
SELECT CAST(sum(actual) AS BIGINT) AS positives, CAST(sum(1 - actual) AS BIGINT) AS negatives,
  round((sum(CASE WHEN actual = 1 THEN r ELSE 0 END) - sum(actual) * (sum(actual) + 1) / 2e0)
  / (CAST(sum(actual) AS DOUBLE) * sum(1 - actual)), 6) AS auc FROM ranked"""


def confusion_sql(ctes: str, source: str) -> str:
    return f"""{ctes} SELECT a.v AS actual, p.v AS predicted, count(customer_id) AS n
  FROM (VALUES (0), (1)) a(v) CROSS JOIN (VALUES (0), (1)) p(v)
  LEFT JOIN {source} o ON o.actual = a.v AND o.predicted = p.v GROUP BY a.v, p.v"""


def fitted_sql() -> str:
    """Newton's method in SQL: table fitted(b), the weights of the churn model on the 75 % part, and
    held_out(customer_id, nationality_region, actual, behaviour, x) of the other part.

    A step adds up gradient and Hessian and solves the system by Gauss-Jordan elimination, one
    derived table per column. The starting point is zero; the loss is strictly convex.
    """
    inputs, d = nw.INPUTS, len(nw.FEATURES) + 1
    as_double = {c: f"CAST(CAST({c} AS INTEGER) AS DOUBLE)" if c in BOOLEAN
                 else f"CAST({c} AS DOUBLE)" for c in inputs}
    stats = ", ".join(f"avg({e}) AS m_{c}, stddev_pop({e}) AS s_{c}"
                      for c, e in as_double.items())
    x = ", ".join([*[f"({e} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1e0 ELSE s_{c} END"
                     for c, e in as_double.items()],
                   *[f"CASE WHEN segment = {s(v)} THEN 1e0 ELSE 0e0 END" for v in SEGMENTS],
                   "1e0"])
    rows = ", ".join("[" + ", ".join(
        [f"sum(p * (1 - p) * x[{i}] * x[{j}])" + ("+ 1e0" if i == j < d else "")
         for j in range(1, d + 1)]
        + [f"sum((p - y) * x[{i}])" + (f" + any_value(b[{i}])" if i < d else "")]) + "]"
        for i in range(1, d + 1))
    system = (f"SELECT i, any_value(b) AS b, [{rows}] AS m FROM (SELECT i, b, x, y,"
              f" 1e0 / (1e0 + exp(-list_inner_product(x, b))) AS p FROM newton, train"
              f" WHERE i < 14) GROUP BY i")
    for k in range(1, d + 1):
        system = (f"SELECT i, b, list_transform(m, lambda r, q: CASE WHEN q = {k} THEN"
                  f" list_transform(r, lambda e: e / r[{k}]) ELSE list_transform(range(1, {d + 2}),"
                  f" lambda t: r[t] - r[{k}] * m[{k}][t] / m[{k}][{k}]) END) AS m FROM ({system})")
    return f"""{P.replace('WITH ', 'WITH RECURSIVE ', 1)},
{part_ctes('profile', 'CAST(churned AS VARCHAR)', 'customer_id', '2.5e-1', 'parts')},
stats AS (SELECT {stats} FROM parts WHERE NOT held_out),
points AS (SELECT customer_id, nationality_region, held_out, churned,
  CAST(churned AS DOUBLE) AS y, [{x}] AS x FROM parts, stats),
train AS MATERIALIZED (SELECT x, y FROM points WHERE NOT held_out),
newton(i, b) AS (SELECT 0, list_transform(range({d}), lambda k: 0e0)
  UNION ALL SELECT i + 1, list_transform(b, lambda w, q: w - m[q][{d + 1}]) FROM ({system})),
fitted AS MATERIALIZED (SELECT b FROM newton WHERE i = 14),
scored AS (SELECT customer_id, nationality_region, churned, CAST(churned AS INTEGER) AS actual,
  1e0 / (1e0 + exp(-list_inner_product(x, b))) AS behaviour FROM points, fitted WHERE held_out),
held AS (SELECT *, CASE WHEN behaviour >= 5e-1 THEN 1 ELSE 0 END AS predicted FROM scored)"""


HELD = fitted_sql()
WEIGHTS = "[" + ", ".join(s(n) for n in [*nw.FEATURES, "(intercept)"]) + "]"
GRADIENT = "[" + ", ".join(
    f"(sum((p - y) * x[{k}])" + (f" + any_value(b[{k}])" if k <= len(nw.FEATURES) else "")
    + ") / count(*)" for k in range(1, len(nw.FEATURES) + 2)) + "]"

PROFILE_COLUMNS = """customer_id, nationality_region, tenure_months, segment, products_held,
  avg_balance_aed, balance_trend_3m, CAST(salary_credit_active AS INTEGER) AS salary_credit_active,
  remittance_count_3m, CAST(intl_transfer_spike AS INTEGER) AS intl_transfer_spike,
  complaints_6m, branch_visits_trend, clv_estimate_aed"""

# ------------------------------------------------------------ statements
ORACLE: dict[str, str] = {
    "src_1_profile_scan": f"{P} SELECT {PROFILE_COLUMNS}, churned FROM profile",
    "src_2_message_scan": f"{M} SELECT * EXCLUDE (low) FROM message",
    "src_3_audit_log": f"{A} SELECT seq, timestamp, type, step, message_id, human_verdict, fused_risk,"
                       " leaving_confirmed FROM audit",
    "snk_2_event_rows": f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp,
  'event' AS type, 'Page clicked' AS step, 'customer' AS actor,
  'event ' || event_id AS summary, 'ok' AS status, {exact_round('(value / 7e0)', 3)} AS confidence,
  {CUST.format('user_id')} AS customer_id, CAST(event_id AS VARCHAR) AS number,
  CASE WHEN event_id % 2 = 1 THEN 'yes' END AS odd FROM events WHERE event_type = 'click'""",
    "src_4_report_leaves": """SELECT 'counts' AS report, 'data.sources.' || source || '.n' AS path,
  CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY source
  UNION ALL SELECT 'counts', 'data.sources.' || source || '.chars', CAST(sum(n_chars) AS VARCHAR)
  FROM documents GROUP BY source
  UNION ALL SELECT 'counts', 'data.n', CAST(count(*) AS VARCHAR) FROM documents
  UNION ALL VALUES ('counts', 'note', '{not json'), ('counts', 'quoted', '{"x":1}')""",
    "prj_14_report_metric": """SELECT 'counts' AS report, 'data.sources.src0.n' AS path,
  CAST(count(*) AS DOUBLE) AS value FROM documents WHERE source = 'src0'""",
    "prj_1_boolean_casts": f"{P} SELECT customer_id, CAST(salary_credit_active AS INTEGER) AS"
                           " salary_credit_active, CAST(intl_transfer_spike AS INTEGER) AS"
                           " intl_transfer_spike, CAST(churned AS INTEGER) AS churned FROM profile",
    "prj_2_feature_projection": f"{P} SELECT * EXCLUDE (nationality_region) FROM"
                                f" (SELECT {PROFILE_COLUMNS} FROM profile) z",
    "prj_3_queue_view": f"{QS} {VIEW}",
    "prj_4_label_encoding": f"{M} SELECT message_id, list_position([{lst(ISSUES)}], issue_type)"
                            f" - 1 AS issue_no, list_position([{lst(SIGNALS)}], churn_signal) - 1"
                            " AS signal_no FROM message",
    "prj_5_stratum_key": f"{M} SELECT message_id, issue_type || '_' || churn_signal AS stratum"
                         " FROM message",
    "prj_6_audit_view": f"{A} {AUDIT_VIEW}",
    "prj_7_decision_rows": f"""{CS}, {AUDIT}, {FIRST} SELECT '2024-02-01T00:00:00' AS timestamp,
  c.message_id, c.customer_id, c.language, c.issue_type, c.churn_signal, c.leaving_confirmed,
  c.fused_risk, c.risk_band, {ROW_CASE} AS action, c.offer_value_aed, c.draft_source,
  c.guardrail_flags, v.human_verdict, coalesce(v.reviewer_note, '') AS reviewer_note,
  CASE WHEN v.human_verdict = 'Rejected' THEN '' ELSE c.draft_message END AS final_message
  FROM served c JOIN first_verdict v USING (message_id)""",
    "prj_8_language_override": f"""WITH {INBOX}, {language_ctes('tidy', 'rid', 'text', 'i')}
  SELECT message_id, text, CASE WHEN coalesce(lang_override, 'auto') NOT IN ('', 'auto')
    THEN lang_override ELSE language END AS language,
  round(CASE WHEN coalesce(lang_override, 'auto') NOT IN ('', 'auto') THEN 1e0 ELSE confidence
    END, 6) AS language_confidence FROM tidy JOIN i_lang USING (rid)""",
    "prj_9_input_hygiene": f"WITH {INBOX} SELECT message_id, customer_id, text FROM tidy",
    "prj_10_previews": f"{M} SELECT message_id, " + ", ".join(
        f"substring(text, 1, {n}) AS preview_{n}" for n in (140, 90, 70, 200)) + " FROM message",
    "prj_11_display_strings": f"{B} SELECT customer_id, 'AED ' || format('{{:,}}',"
                              " clv_estimate_aed) AS clv_text, " + pct("b3")
                              + f" AS risk_text FROM (SELECT *, {exact_round('behaviour_risk', 3)}"
                                " AS b3 FROM book) z",
    "prj_12_label_cleanup": f"{M} SELECT message_id, replace(issue_type, '_', ' ') AS issue_label,"
                            " churn_signal AS feature, message_id AS picked_id FROM message",
    "prj_13_compact_audit": f"{A} SELECT seq, timestamp, customer_id, language, issue_type,"
                            " risk_band, action, offer_value_aed, draft_source, human_verdict"
                            " FROM audit ORDER BY timestamp DESC, seq DESC",
    "fil_1_point_lookup": f"{A} SELECT customer_id, segment, tenure_months, clv_estimate_aed"
                          " FROM profile WHERE customer_id = (SELECT customer_id FROM audit"
                          " ORDER BY seq DESC LIMIT 1)",
    "fil_2_queue_filter": f"{QS} {VIEW} WHERE band = 'Critical' AND status = 'Pending Review'",
    "fil_3_at_risk": f"{B} SELECT customer_id, segment, band, round(behaviour_risk, 6) AS"
                     f" behaviour_risk FROM book WHERE {RISKY}",
    "fil_4_message_search": f"""{M} SELECT 'found' AS scenario, coalesce(min(CASE WHEN
  issue_type = 'Fees_Charges' AND churn_signal = 'Medium' AND contains(low, 'frustrated')
  THEN message_id END), min(message_id)) AS message_id FROM message
  UNION ALL SELECT 'fallback', coalesce(min(CASE WHEN issue_type = 'Fees_Charges' AND
  contains(low, 'no such words anywhere') THEN message_id END), min(message_id)) FROM message""",
    "fil_5_customer_search": f"{P} {CUST_PICKS}",
    "fil_6_reviewed_rows": f"{A} SELECT seq, message_id, customer_id, human_verdict FROM reviewed",
    "fil_7_high_bands": f"{QU} SELECT message_id, customer_id, band, fused_risk FROM queue"
                        " WHERE band IN ('High', 'Critical')",
    "fil_8_non_english_share": f"{M} SELECT {rate(chr(108) + 'anguage <> ' + s('en'))}"
                               " AS non_english_share FROM message",
    "txt_1_arabic_script": f"{M} SELECT message_id, regexp_matches(text, '[؀-ۿ]') AS arabic"
                           " FROM message",
    "txt_2_words": f"{M} SELECT message_id, len(w) AS n_words, md5(array_to_string(w, ' '))"
                   " AS words_digest FROM (SELECT message_id, regexp_extract_all(low,"
                   " '[a-z'']+') AS w FROM message) z",
    "txt_3_lexicon_shares": f"{M}, {language_ctes('message', 'message_id', 'text', 'm')}"
                            " SELECT message_id, " + ", ".join(
                                f"round(share_{n}, 6) AS share_{n}" for n in NAMES)
                            + " FROM m_share",
    "txt_4_detect_language": f"{M}, {language_ctes('message', 'message_id', 'text', 'm')}"
                             " SELECT message_id, language, round(confidence, 6) AS"
                             " language_confidence FROM m_lang",
    "txt_5_leaving_confirmed": f"{KW} SELECT message_id, leaving_confirmed FROM keyword",
    "ent_1_amounts": f"{M} SELECT message_id, coalesce({ENT['amounts']}, '') AS amounts"
                     " FROM message",
    "ent_2_dates": f"{M} SELECT message_id, coalesce({ENT['dates']}, '') AS dates FROM message",
    "ent_3_destinations": f"{M} SELECT message_id, coalesce({ENT['destinations']}, '') AS"
                          " destinations FROM message",
    "ent_4_products": f"{M} SELECT message_id, coalesce({ENT['products']}, '') AS products"
                      " FROM message",
    "ent_5_extract_entities": f"{M} SELECT message_id, {ENTS} FROM message",
    "clf_1_keyword_issue": f"{KW} SELECT message_id, issue_type, issue_confidence FROM keyword",
    "clf_2_keyword_signal": f"{KW} SELECT message_id, churn_signal, churn_signal_confidence"
                            " FROM keyword",
    "clf_4_token_ids": f"""{VOC}, ids AS (SELECT token, row_number() OVER (ORDER BY n DESC,
  token DESC) + 1 AS id FROM vocab),
pos AS (SELECT message_id, i, list_extract(tok, i) AS token FROM toks, range(1, 33) r(i)),
filled AS (SELECT message_id, i, CASE WHEN pos.token IS NULL THEN 0 ELSE coalesce(id, 1) END AS id
  FROM pos LEFT JOIN ids ON pos.token = ids.token)
SELECT message_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS token_ids FROM filled
GROUP BY message_id""",
    "clf_5_vocabulary": f"{VOC} SELECT token, n FROM vocab",
    "clf_7_reply_labels": f"{M} SELECT message_id, {reply('text', SIGNALS)} AS signal,"
                          f" {reply(chr(116) + 'ext || chr(32) || issue_type', ISSUES)} AS issue"
                          " FROM message",
    "clf_8_listen": f"{LV} SELECT message_id, customer_id, text, language,"
                    " round(language_confidence, 6) AS language_confidence, issue_type,"
                    " issue_confidence, churn_signal, churn_signal_confidence,"
                    f" leaving_confirmed, {ENTS}, 'heuristic' AS classifier FROM live",
    "rsk_1_behaviour_score": f"{B} SELECT customer_id, round(behaviour_risk, 6) AS behaviour_risk"
                             " FROM book",
    "rsk_2_neutral_prior": f"{R} SELECT message_id, behaviour_score, profile_found FROM risk",
    "rsk_3_behaviour_reasons": f"{P} SELECT customer_id, {REASONS} AS reasons FROM profile",
    "rsk_4_text_score": f"{R} SELECT message_id, text_score FROM risk",
    "rsk_5_fusion": f"{R} SELECT message_id, round(mixed, 6) AS mixed_risk FROM risk",
    "rsk_6_leaving_floor": f"{R} SELECT message_id, round(fused, 6) AS floored_risk FROM risk",
    "rsk_7_headline_reasons": f"{R} SELECT message_id, reasons FROM risk",
    "rsk_8_triage_flag": f"{R} SELECT message_id, needs_human_triage FROM risk",
    "rsk_9_banding": f"{R} SELECT message_id, risk_band FROM risk",
    "rsk_10_rounding": f"{R} SELECT message_id, behaviour_score, fused_risk FROM risk",
    "rsk_11_profile_defaults": f"{R} SELECT message_id, segment, clv_estimate_aed, profile_found"
                               " FROM risk",
    "rsk_12_assess_risk": f"{R} SELECT message_id, customer_id, behaviour_score, text_score,"
                          " fused_risk, risk_band, needs_human_triage, segment,"
                          " clv_estimate_aed, profile_found, reasons FROM risk",
    "rsk_13_reviewer_checklist": f"""{R} SELECT message_id, coalesce(nullif(concat_ws('|',
  CASE WHEN needs_human_triage THEN 'read_original' END,
  CASE WHEN leaving_confirmed THEN 'verify_relocation' END,
  CASE WHEN behaviour_score < 3.5e-1 AND text_score >= 9e-1 THEN 'calm_behaviour_alarming_text' END,
  CASE WHEN behaviour_score >= 7.5e-1 AND text_score <= 2e-1 THEN 'quiet_high_risk' END,
  CASE WHEN clv_estimate_aed >= 100000 THEN 'high_value' END), ''), 'nothing_unusual') AS checks
  FROM risk""",
    "rsk_14_clv_at_risk": f"{R} SELECT message_id, round(fused_risk * clv_estimate_aed, 4) AS"
                          " clv_at_risk FROM risk",
    "rsk_15_confidence_tier": f"{LV} SELECT message_id, {tier('language_confidence')},"
                              f" {tier('issue_confidence')}, {tier('churn_signal_confidence')}"
                              " FROM live",
    "act_1_decision_table": f"{PL} SELECT message_id, rule_id, action, offer_value_aed FROM plan",
    "act_2_offer_economics": f"{PL} SELECT message_id, action, offer_value_aed, round({CAP}, 4)"
                             " AS cap_aed FROM plan WHERE rule_id IN"
                             " ('2a', '2a''', '2b', '2b''')",
    "act_3_rationale": f"{PL} SELECT message_id, rationale FROM plan",
    "act_4_within_budget": f"{PL} SELECT message_id, offer_value_aed, offer_within_budget"
                           " FROM plan",
    "act_5_action_labels": f"{PL} SELECT message_id, action, action_label FROM plan",
    "act_6_decide_and_act": f"{PL}, {template_ctes('plan', 'q')} SELECT message_id, customer_id,"
                            " action, action_label, rule_id, offer_value_aed,"
                            " offer_within_budget, template_text AS draft_message,"
                            " template_language AS draft_language, 'template' AS draft_source,"
                            " rationale, '' AS guardrail_flags FROM q_text",
    "drf_1_template_lookup": f"{LP}, {template_ctes('l_plan', 'q')} SELECT message_id, action,"
                             " language, template_language FROM q_text",
    "drf_2_template_fill": f"{LP}, {template_ctes('l_plan', 'q')} SELECT message_id,"
                           " template_text FROM q_text",
    "drf_3_serve_decision": f"{CS} SELECT message_id, draft_message, draft_language,"
                            " draft_source, guardrail_flags FROM served",
    "drf_4_prompt_text": f"""{PL} SELECT message_id, CASE WHEN action <> 'human_triage' THEN
  concat_ws(chr(10), {PROMPT_HEAD}, '', 'Message: ' || text || chr(10) || 'Issue: ' || issue_type
    || '; risk band: ' || risk_band,
  CASE WHEN offer_value_aed > 0 THEN 'Offer to mention: AED ' || {rint('offer_value_aed')} || ' ('
    || action_label || ')' ELSE 'Action: ' || action_label || ', without an offer' END,
  'Tone: Warm', 'Why: ' || replace(rationale, '|', '; ')) END AS prompt_used FROM plan""",
    "grd_1_urgency": f"{DR} SELECT message_id, CASE WHEN candidate IS NOT NULL THEN {URGENT}"
                     " ELSE '' END AS urgency FROM drafts",
    "grd_2_placeholders": f"{DR} SELECT message_id, CASE WHEN candidate IS NOT NULL THEN"
                          f" coalesce(array_to_string({SLOTS}, '|'), '') END AS placeholders"
                          " FROM drafts",
    "grd_3_invented_amounts": f"{DR} SELECT message_id, {money_text(INVENTED)} AS invented"
                              " FROM drafts WHERE candidate IS NOT NULL",
    "grd_4_retention_pressure": f"{DR} SELECT message_id, {PRESSURE} AS pressure FROM drafts",
    "grd_5_too_short": f"{DR} SELECT message_id, {WORDS} AS n_words, {WORDS} < 20 AS short"
                       " FROM drafts",
    "grd_6_language_mismatch": f"""{M}, {CANDIDATE}, {language_ctes(
        '(SELECT * FROM candidate_text WHERE candidate IS NOT NULL)', 'message_id', 'candidate',
        'c')} SELECT message_id, m.language AS wanted, l.language AS detected,
  l.language <> m.language AS mismatch FROM c_lang l JOIN message m USING (message_id)""",
    "joi_1_message_profile": f"{P}, {MESSAGE} SELECT message_id, m.customer_id, segment,"
                             " clv_estimate_aed FROM message m LEFT JOIN profile p"
                             " ON m.customer_id = p.customer_id",
    "joi_2_queue_status": f"{QS} SELECT message_id, fused_risk, band, status FROM queue_status",
    "joi_3_audit_segment": f"{A} SELECT seq, customer_id, human_verdict, segment FROM stats",
    "joi_4_action_label_template": f"{LP}, {template_ctes('l_plan', 'q')} SELECT message_id,"
                                   " action, action_label AS label, template_language"
                                   " FROM q_text",
    "joi_5_selected_records": f"{QU} SELECT q.message_id, q.customer_id, q.band, q.fused_risk,"
                              " m.text FROM queue q JOIN message m USING (message_id)"
                              " WHERE band = 'Critical'",
    "joi_6_prediction_truth": f"{KW} SELECT 'keywords' AS model, 'all' AS dataset, message_id,"
                              " issue_type AS pred_issue, churn_signal AS pred_signal, language,"
                              " true_issue AS issue_type, true_signal AS churn_signal"
                              " FROM keyword",
    "joi_7_report_grid": f"""{SETS} SELECT a.model, b.dataset, count(message_id) AS n
  FROM (SELECT DISTINCT model FROM sets) a CROSS JOIN (SELECT DISTINCT dataset FROM sets) b
  LEFT JOIN sets USING (model, dataset) GROUP BY a.model, b.dataset""",
    "joi_8_scenarios": f"{P}, {MESSAGE}, mp AS ({MSG_PICKS}), cp AS ({CUST_PICKS})"
                       " SELECT scenario, message_id, text, language, cp.customer_id FROM mp"
                       " JOIN cp USING (scenario) JOIN message m USING (message_id)",
    "agg_1_mean_risk_by_segment": f"{B} SELECT d.segment, position,"
                                  " round(avg(behaviour_risk), 6) AS mean_risk FROM"
                                  f" (VALUES {domain(SEGMENTS)}) d(position, segment) LEFT JOIN"
                                  " book b ON b.segment = d.segment GROUP BY ALL",
    "agg_2_issue_distribution": f"{M} {dist('message', 'issue_type')}",
    "agg_3_signal_distribution": f"{M} SELECT d.churn_signal, position,"
                                 " nullif(count(message_id), 0) AS n FROM"
                                 f" (VALUES {domain(['Low', 'Medium', 'High'])}) d(position,"
                                 " churn_signal) LEFT JOIN message m ON m.churn_signal ="
                                 " d.churn_signal GROUP BY ALL",
    "agg_4_driver_counts": f"{B}, hot AS (SELECT * FROM book WHERE {RISKY}), hits AS ("
                           + " UNION ALL ".join(
        f"SELECT {s(label)} AS driver, count(*) AS n FROM hot WHERE {test}"
        for label, test in [
            ("Falling balance", "balance_trend_3m < -1.5e-1"),
            ("Salary not credited", "NOT salary_credit_active"),
            ("Foreign transfers spiking", "intl_transfer_spike"),
            ("Repeated complaints", "complaints_6m >= 3"),
            ("Fewer branch visits", "branch_visits_trend < -4e-1"),
            ("Recent customer", "tenure_months <= 12"),
            ("Frequent remittances", "remittance_count_3m >= 8")])
                           + ") SELECT * FROM hits WHERE n > 0",
    "agg_5_mean_clv_by_band": f"{B} SELECT d.band, position, round(avg(clv_estimate_aed), 6) AS"
                              f" mean_clv FROM (VALUES {domain(BANDS)}) d(position, band)"
                              " LEFT JOIN book b ON b.band = d.band GROUP BY ALL",
    "agg_6_language_distribution": f"{M} {dist('message', 'language')}",
    "agg_7_action_distribution": f"{QU} {dist('queue', 'recommended')}",
    "agg_8_review_outcomes": f"{A} {dist('reviewed', 'human_verdict')}",
    "agg_9_review_rates": f"""{A} SELECT segment, count(*) AS reviews,
  {rate("human_verdict LIKE 'Approved%'")} AS approval_rate,
  {rate("human_verdict = 'Overridden'")} AS override_rate,
  {rate("human_verdict = 'Rejected'")} AS rejection_rate FROM stats GROUP BY segment""",
    "agg_10_disproportion": f"""{A}, per AS (SELECT segment, count(*) AS n,
  avg(CASE WHEN human_verdict = 'Rejected' THEN 1e0 ELSE 0e0 END) AS rejection_rate,
  (SELECT avg(CASE WHEN human_verdict = 'Rejected' THEN 1e0 ELSE 0e0 END) FROM stats)
    AS overall_rate FROM stats GROUP BY segment)
  SELECT segment, n, round(rejection_rate, 6) AS rejection_rate, round(overall_rate, 6) AS
  overall_rate, n >= 5 AND rejection_rate > greatest(1.5e-1, overall_rate * 1.5e0) AS flagged
  FROM per""",
    "agg_11_segment_distribution": f"{B} SELECT segment, count(*) AS customers,"
                                   " round(avg(behaviour_risk), 6) AS mean_risk,"
                                   f" CAST({NRISK} AS BIGINT) AS at_risk FROM book"
                                   " GROUP BY segment",
    "agg_12_region_audit": f"{B} SELECT nationality_region, count(*) AS customers,"
                           " round(avg(behaviour_risk), 6) AS mean_predicted_risk,"
                           f" {rate('churned')} AS actual_churn_rate FROM book"
                           " GROUP BY nationality_region",
    "agg_13_exposure_by_segment": f"{B} SELECT segment, count(*) AS at_risk,"
                                  " CAST(sum(clv_estimate_aed) AS BIGINT) AS clv_at_risk"
                                  f" FROM book WHERE {RISKY} GROUP BY segment",
    "agg_14_overview": f"""{PM} SELECT * FROM (SELECT count(*) AS customers,
  CAST(sum(clv_estimate_aed) AS BIGINT) AS total_clv, CAST({NRISK} AS BIGINT) AS at_risk,
  CAST({CLV_RISK} AS BIGINT) AS clv_at_risk,
  round(CAST({CLV_RISK} AS DOUBLE) / sum(clv_estimate_aed), 6) AS share_at_risk FROM book) a
  CROSS JOIN (SELECT count(*) AS messages, {rate("language <> 'en'")} AS non_english_share,
  CAST(sum(CASE WHEN churn_signal = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high_intent
  FROM message) b""",
    "agg_15_queue_summary": f"{QS} SELECT count(*) AS queue_size, " + ", ".join(
        f"CAST(sum(CASE WHEN {t} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, t in [
            ("pending", "status = 'Pending Review'"), ("critical", "band = 'Critical'"),
            ("confirmed_leavers", "action = 'dignified_goodbye'")]) + " FROM queue_status",
    "agg_16_segment_view": f"{B} SELECT segment, count(*) AS customers,"
                           " round_even(avg(behaviour_risk) * 1e3, 0) / 1e3 AS mean_risk,"
                           f" CAST({NRISK} AS BIGINT) AS at_risk, CAST({CLV_RISK} AS DOUBLE) AS"
                           " clv_at_risk_aed FROM book GROUP BY segment",
    "agg_17_accuracy": f"{SETS} SELECT model, dataset, language, n, round(issue_acc, 6) AS"
                       " issue_acc, round(signal_acc, 6) AS signal_acc FROM bakeoff",
    "agg_18_class_report": report_sql(KW, "keyword", "true_issue", "issue_type",
                                      [s(v) for v in ISSUES]),
    "agg_18_report_fitted": report_sql(HELD, "held", "actual", "predicted", ["0", "1"]),
    "agg_19_confusion": confusion_sql(OUT, "outcome"),
    "agg_19_confusion_fitted": confusion_sql(HELD, "held"),
    "agg_20_roc_auc": auc_sql(OUT, "outcome", "behaviour_risk"),
    "agg_20_roc_auc_fitted": auc_sql(HELD, "held", "behaviour"),
    "agg_21_region_audit_fitted": f"""{HELD} SELECT nationality_region, count(*) AS n,
  round(avg(behaviour), 6) AS mean_predicted_risk, round(avg(actual), 6) AS actual_churn_rate
  FROM held GROUP BY nationality_region""",
    "agg_21_region_audit_held_out": f"""{OUT}, {part_ctes('outcome', 'CAST(actual AS VARCHAR)', 'customer_id',
        '2.5e-1', 'parts')} SELECT nationality_region, count(*) AS n,
  round(avg(behaviour_risk), 6) AS mean_predicted_risk, round(avg(actual), 6) AS
  actual_churn_rate FROM parts WHERE held_out GROUP BY nationality_region""",
    "agg_22_issue_signal_crosstab": crosstab_sql("issue_type"),
    "agg_22_language_signal_crosstab": crosstab_sql("language"),
    "agg_23_region_churn_shares": f"""{P} SELECT nationality_region, """ + ", ".join(
        f"round_even(sum(CASE WHEN {t} THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 1e2, 0)"
        f" / 1e2 AS \"{n}\"" for n, t in [("false", "NOT churned"), ("true", "churned")])
                                  + " FROM profile GROUP BY nationality_region",
    "agg_24_driver_means": f"{P} SELECT churned, round(avg(balance_trend_3m), 6) AS"
                           f" balance_trend_3m, {rate('salary_credit_active')} AS"
                           f" salary_credit_active, {rate('intl_transfer_spike')} AS"
                           " intl_transfer_spike FROM profile GROUP BY churned",
    "agg_25_outreach_summary": f"""{CHECKS} SELECT language, count(*) AS n,
  CAST(sum(CASE WHEN wrote_customer_language THEN 1 ELSE 0 END) AS BIGINT) AS
  own_language_drafts, bool_and(served_language_verified) AS always_served_own_language
  FROM checks GROUP BY language""",
    "agg_26_bakeoff_table": f"{SETS} SELECT model, " + ", ".join(
        f"round(max(CASE WHEN dataset = {s(d)} THEN {m} END), 6) AS {d}_{m}"
        for d in ("held_out", "rest") for m in ("issue_acc", "signal_acc"))
                            + " FROM bakeoff WHERE language = '(all)' GROUP BY model",
    "agg_27_calm_leavers": f"""{PM} SELECT count(*) AS high_messages,
  CAST(sum(CASE WHEN behaviour_risk < 3.5e-1 THEN 1 ELSE 0 END) AS BIGINT) AS calm,
  {rate('behaviour_risk < 3.5e-1')} AS calm_share FROM message m LEFT JOIN book b
  ON m.customer_id = b.customer_id WHERE churn_signal = 'High'""",
    "agg_28_value_concentration": f"""{B}, hot AS (SELECT *, segment IN ('Premium', 'Private') AS
  top FROM book WHERE {RISKY}) SELECT CAST(coalesce(sum(CASE WHEN top THEN 1 ELSE 0 END), 0) AS
  BIGINT) AS top_customers, CAST(coalesce(sum(CASE WHEN top THEN clv_estimate_aed END), 0) AS
  BIGINT) AS top_clv_at_risk, round(coalesce(sum(CASE WHEN top THEN clv_estimate_aed END)
  / CAST(sum(clv_estimate_aed) AS DOUBLE), 0), 6) AS top_share FROM hot""",
    "agg_29_segment_plays": f"{B} SELECT segment, count(*) AS customers,"
                            " round(avg(clv_estimate_aed), 6) AS mean_clv,"
                            f" CAST({NRISK} AS BIGINT) AS at_risk, CAST({CLV_RISK} AS BIGINT) AS"
                            " clv_at_risk FROM book GROUP BY segment",
    "agg_30_churn_base_rate": f"{P} SELECT CAST(sum(CASE WHEN churned THEN 1 ELSE 0 END) AS"
                              f" BIGINT) AS churned, count(*) AS customers, {rate('churned')} AS"
                              " base_rate FROM profile",
    "srt_1_ranked_queue": f"{QU} SELECT row_number() OVER (ORDER BY fused_risk DESC,"
                          " md5(message_id), message_id) AS rank, message_id, fused_risk, band"
                          " FROM queue",
    "srt_2_region_order": f"{P} SELECT nationality_region, count(*) AS n FROM profile GROUP BY"
                          " nationality_region ORDER BY nationality_region",
    "srt_3_newest_first": f"{A} {AUDIT_VIEW} ORDER BY timestamp DESC, seq DESC",
    "srt_4_drivers_ascending": f"{P} SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {s(f)} AS feature, round(corr(CAST({f} AS DOUBLE), CAST(churned AS DOUBLE)), 6)"
        " AS weight FROM profile" for f in ad.FIXED_WEIGHTS) + ") d ORDER BY weight, feature",
    "srt_5_counts_descending": f"{A} {dist('audit', 'action')}",
    "win_1_first_match": f"{M} {MSG_PICKS}",
    "win_2_latest_verdict": f"{A} SELECT message_id, status FROM status",
    "lim_1_first_items": f"{DR} SELECT message_id, len(string_split(reasons, '|'))"
                         f" - CASE WHEN reasons = '' THEN 1 ELSE 0 END AS n_reasons,"
                         f" len({SLOTS}) AS n_placeholders FROM drafts",
    "set_1_text_leakage": f"{M}, {SPLIT}, whole AS (SELECT p.held_out, d.text FROM split p JOIN"
                          f" documents d ON {MSG.format('d.doc_id')} = p.message_id) SELECT DISTINCT"
                          " sha256(text) AS digest FROM whole WHERE held_out AND text IN (SELECT"
                          " text FROM whole WHERE NOT held_out)",
    "set_3_stacked_predictions": f"{SETS} SELECT model, dataset, message_id, pred_issue,"
                                 " pred_signal FROM sets",
    "dq_1_language_mix": f"{LV} {dist('live', 'language')}",
    "dq_2_cell_balance": f"{M} SELECT issue_type, churn_signal, count(*) AS n FROM message"
                         " GROUP BY issue_type, churn_signal HAVING count(*) <> 12",
    "dq_4_orphans": f"{P}, {MESSAGE} SELECT message_id, customer_id FROM message WHERE"
                    " customer_id NOT IN (SELECT customer_id FROM profile)",
    "spl_1_message_split": f"{M}, {SPLIT} SELECT message_id, held_out FROM split",
    "spl_2_label_split": f"{P}, {part_ctes('profile', 'CAST(churned AS VARCHAR)', 'customer_id', '2.5e-1', 'x')}"
                         " SELECT customer_id, held_out FROM x",
    "spl_3_validation_tail": f"""{M}, {SPLIT}, rest AS (SELECT * EXCLUDE (held_out) FROM split
  WHERE NOT held_out), {part_ctes('rest', "issue_type || '_' || churn_signal", 'message_id',
                                  '1.5e-1', 'tail')}
  SELECT message_id, 'test' AS part FROM split WHERE held_out
  UNION ALL SELECT message_id, CASE WHEN held_out THEN 'validation' ELSE 'train' END FROM tail""",
    "ml_1_standardised": f"{P} SELECT customer_id, " + ", ".join([
        *[standard(n, n) for n in ("tenure_months", "products_held", "avg_balance_aed",
                                   "balance_trend_3m", "remittance_count_3m", "complaints_6m",
                                   "branch_visits_trend", "clv_estimate_aed")],
        *[standard(n, f"CAST({n} AS INTEGER)") for n in ("salary_credit_active",
                                                         "intl_transfer_spike")]])
                         + " FROM profile",
    "ml_2_one_hot_segment": f"{P} SELECT customer_id, segment, " + " || ' ' || ".join(
        f"CASE WHEN segment = {s(v)} THEN '1.0' ELSE '0.0' END" for v in SEGMENTS)
                            + " AS one_hot FROM profile",
    "ml_3_logistic_scores": f"{HELD} SELECT customer_id, churned, round(behaviour, 6) AS behaviour"
                            " FROM held",
    "ml_3_optimality": f"""{HELD}, errors AS (SELECT x, y, b,
    1e0 / (1e0 + exp(-list_inner_product(x, b))) AS p FROM train, fitted),
  pulls AS (SELECT {GRADIENT} AS g FROM errors)
  SELECT unnest({WEIGHTS}) AS feature, unnest(list_transform(g, lambda v: round(v, 9) + 0e0))
    AS gradient FROM pulls""",
    "ml_4_boosted_trees_report": f"""{P}, {part_ctes('profile', 'CAST(churned AS VARCHAR)',
        'customer_id', '2.5e-1', 'parts')} SELECT CAST(churned AS INTEGER) AS actual,
  count(*) AS n, true AS in_range, true AS leavers_above FROM parts WHERE held_out GROUP BY churned""",
    "ml_6_coefficients": f"""{HELD} SELECT unnest({WEIGHTS}) AS feature,
  unnest(list_transform(b, lambda w: round(w, 4) + 0e0)) AS coefficient FROM fitted""",
    "spl_3_folds": f"""{count_model(f'{M}, {SPLIT}')} SELECT message_id, 'test' AS part,
  CAST(NULL AS INTEGER) AS fold FROM split WHERE held_out
  UNION ALL SELECT message_id, CASE WHEN held_out THEN 'validation' ELSE 'train' END,
  CASE WHEN NOT held_out THEN CAST(CAST('0x' || substr(md5(message_id), 1, 8) AS BIGINT) % 3
    AS INTEGER) END FROM tail""",
    "ml_7_count_scores": f"""{count_model(f'{M}, {SPLIT}')}, {counted_ctes('message', 'found')}
  SELECT message_id, issue_type, round(issue_type_confidence, 6) AS issue_type_confidence,
  churn_signal, round(churn_signal_confidence, 6) AS churn_signal_confidence FROM found""",
    "ml_7_weights_agree": f"{M} SELECT count(*) AS n, CAST(0 AS BIGINT) AS other_labels,"
                          " true AS same_confidence FROM message",
    "ml_8_count_queue": f"""{count_model(f'{PM}, {SPLIT}')}, {counted_ctes('message', 'found')},
voted AS (SELECT m.message_id, customer_id, text, low, language,
  {any_of('low', LEX.leaving)} AS leaving_confirmed, f.issue_type, f.churn_signal,
  f.issue_type_confidence AS issue_confidence, f.churn_signal_confidence, 1e0 AS
  language_confidence FROM message m JOIN found f USING (message_id)),
{risk_ctes('voted')}, {plan_ctes()}, {QUEUE} SELECT * FROM queue""",
    "ml_9_bakeoff_exact": f"""{count_model(f'{M}, {SPLIT}')}, {UNSEEN},
held_out AS (SELECT * FROM split WHERE held_out), {eval_sql([('held_out', 'held_out'),
                                                              ('unseen', 'unseen')])}
  SELECT model, dataset, language, n, round(issue_acc, 6) AS issue_acc,
  round(signal_acc, 6) AS signal_acc FROM report""",
    "ml_9_served": f"""{count_model(f'{M}, {SPLIT}')},
validation AS (SELECT * FROM tail WHERE held_out), {eval_sql([('validation', 'validation')])}
  SELECT model, n, round(issue_acc, 6) AS issue_acc, round(signal_acc, 6) AS signal_acc,
  row_number() OVER (ORDER BY round(issue_acc + signal_acc, 9) DESC, model DESC) = 1 AS served
  FROM report WHERE language = '(all)'""",
    "snk_4_saved_model": f"{HELD} SELECT customer_id, churned, round(behaviour, 6) AS behaviour"
                         " FROM held",
    "src_5_absent_model": f"{P} SELECT customer_id, 5e-1 AS behaviour_risk,"
                          f" {band_of('5e-1')} AS band FROM profile",
    "clf_3_classifier_choice": f"""{count_model(f'{KW}, {SPLIT}')},
{counted_ctes('message', 'found')} SELECT message_id, issue_type, churn_signal,
  'counts' AS classifier FROM found UNION ALL
  SELECT message_id, issue_type, churn_signal, 'heuristic' FROM keyword""",
    "udf_1_sql_views": f"{QU} SELECT * FROM queue",
    "udf_1_sql_functions": f"""{PL} SELECT message_id, issue_type AS issue,
  churn_signal AS signal, segment, risk_band AS band, rule_id AS by_function,
  rule_id AS by_view FROM plan""",
    "ml_5_hard_label": f"{OUT} SELECT customer_id, actual, predicted FROM outcome",
    "ml_10_scored_book": f"{B} SELECT customer_id, segment, round(behaviour_risk, 6) AS"
                         " behaviour_risk, band FROM book",
    "cmp_1_review_queue": f"{QU} SELECT * FROM queue",
    "cmp_2_run_case": f"{CS} SELECT message_id, customer_id, language, issue_type, churn_signal,"
                      " leaving_confirmed, fused_risk, risk_band, rule_id, action,"
                      " offer_value_aed, draft_message, draft_language, draft_source,"
                      " 'Pending Review' AS status, reasons, rationale, guardrail_flags"
                      " FROM served",
    "cmp_3_outreach_grid": f"{CHECKS} SELECT action, language, count(*) AS n, " + ", ".join(
        f"CAST(sum(CASE WHEN {t} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, t in [
            ("own_language", "wrote_customer_language"), ("verified", "served_language_verified"),
            ("from_template", "served_by = 'template'"), ("flagged", "guardrail_flags <> ''")])
                           + " FROM checks GROUP BY action, language",
    "rev_1_review_transition": f"""{LAST}, moved AS (SELECT c.message_id,
  CASE WHEN v.human_verdict = 'Overridden' AND coalesce(v.override_action, '') <> ''
    THEN v.override_action WHEN v.human_verdict = 'Dignified Goodbye' THEN 'dignified_goodbye'
    ELSE c.action END AS action, c.offer_value_aed, c.template_text AS draft_message,
  v.human_verdict, coalesce(v.reviewer_note, '') AS reviewer_note,
  CASE WHEN v.human_verdict = 'Rejected' THEN '' ELSE c.template_text END AS final_message,
  v.human_verdict AS status FROM q_text c JOIN last v USING (message_id))
  SELECT *, {case('action', dc.ACTION_LABELS)} AS action_label FROM moved""",
    "rev_2_first_decision": f"{A}, {FIRST} SELECT message_id, human_verdict, seq"
                            " FROM first_verdict",
    "tml_1_case_timeline": f"{CS} {STEPS}",
    "tml_2_extended_timeline": f"""{CS}, {AUDIT}, base AS ({STEPS}), later AS ({LOG_STEPS})
  SELECT message_id, NULL AS timestamp, 0 AS seq, step_no AS part, step, actor, summary, conf
    FROM base
  UNION ALL SELECT message_id, timestamp, seq, part, step, actor, summary, NULL FROM later
    WHERE message_id IN (SELECT message_id FROM served)""",
    "str_1_scored_stream": f"{QU} SELECT * FROM queue",
    "str_1_hot_customers": QU.replace(MESSAGE, HOT_MESSAGE) + " SELECT * FROM queue",
    "str_3_status_over_log": f"{A} SELECT message_id, status FROM status",
    "str_3_log_rows": f"{A} SELECT seq, timestamp, type, step, message_id, human_verdict,"
                      " fused_risk, leaving_confirmed FROM audit",
    "str_2_repeat_suppression": f"SELECT {MSG.format('n')} AS message_id, CAST(1 AS BIGINT) AS kept"
                                " FROM (SELECT DISTINCT CASE WHEN event_id % 4 = 3 THEN event_id // 4"
                                " * 4 ELSE event_id END AS n FROM events) d",
    "str_4_risk_trend_stream": f"""SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day,
  count(DISTINCT user_id) AS customers, CAST(ts AS DATE) + INTERVAL 2 DAY <= (SELECT max(ts)
  FROM events) AS is_final FROM events WHERE {K} / 1e2 >= 5.5e-1 GROUP BY CAST(ts AS DATE)""",
    "str_4_risk_trend": f"""SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day,
  count(DISTINCT user_id) AS customers FROM events WHERE {K} / 1e2 >= 5.5e-1
  GROUP BY CAST(ts AS DATE)""",
}
ORACLE["snk_3_metric_rows"] = ORACLE["agg_17_accuracy"]
