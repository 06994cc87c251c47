"""The queries as SQL over the given tables, computed straight from their columns (no documents are built)."""

from __future__ import annotations

from donorlake.fixed_values import NO_RECEIPT_CAMPAIGNS

# --- shared parts ----------------------------------------------------------------------------------------------------------

_BASE = """
base AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, CAST(floor(o_totalprice) AS BIGINT) AS minor,
    CAST(o_orderdate AS TIMESTAMP) AS received_at, o_orderkey AS delivery_id,
    CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey * 7 % 86400 AS BIGINT)) AS made_at,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'Stripe' ELSE 'Paypal' END AS feed,
    CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'execute' ELSE 'capture' END AS path,
    (['GBP', 'USD', 'AUD', 'EUR'])[CAST(o_custkey % 4 + 1 AS INTEGER)] AS cur,
    o_orderkey % 79 <> 0 AS signature_ok,
    '00000000-0000-4000-8000-' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS cid,
    '00000000-0000-4000-8000-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS kid
  FROM orders
)"""

_HOOKS = f"""{_BASE},
hooks AS (
  SELECT *,
    CASE WHEN k % 83 = 0 THEN 'not json'
      WHEN feed = 'Paypal' AND k % 73 = 0 THEN 'custom'
      WHEN feed = 'Paypal' AND k % 97 = 0 THEN 'parent_payment'
      WHEN feed = 'Paypal' AND k % 89 = 0 THEN 'event_type'
      WHEN feed = 'Stripe' AND k % 97 = 0 THEN 'currency'
      WHEN feed = 'Stripe' AND k % 89 = 0 THEN 'charge_status'
      WHEN feed = 'Stripe' AND k % 71 = 0 THEN 'email' END AS problem,
    CASE WHEN feed = 'Paypal' THEN 'PAY-' ELSE 'ch_' END || k AS paymentid,
    CASE s WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'Paid' ELSE 'Refunded' END AS status,
    CASE WHEN feed = 'Stripe' AND k % 11 = 0 THEN 'Testing' ELSE 'Default' END AS mode,
    CASE WHEN feed = 'Stripe' THEN 'user' || c || '@example.com' END AS email
  FROM base
),
triaged AS (
  SELECT *, CASE WHEN problem IS NOT NULL THEN 'parse-error'
      WHEN feed = 'Paypal' AND NOT signature_ok THEN 'invalid-request' ELSE 'parsed' END AS outcome
  FROM hooks
)"""

_LEDGER_ROWS = f"""{_HOOKS},
balances AS (
  SELECT l_orderkey AS bk, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS balance_minor
  FROM lineitem GROUP BY 1
),
processed AS (
  SELECT t.*,
    CASE WHEN feed = 'Stripe' THEN cid WHEN k % 7 <> 0 THEN cid
      WHEN k % 49 <> 0 AND k % 31 <> 0 THEN cid END AS contributionid,
    CASE WHEN feed = 'Stripe' AND k % 13 <> 0 AND k % 17 <> 0 THEN balance_minor END AS converted_minor,
    CASE WHEN feed = 'Stripe' AND k % 13 = 0 THEN 'Unable to find the stripe event'
      WHEN feed = 'Paypal' AND k % 7 = 0 AND (k % 49 = 0 OR k % 31 = 0)
        THEN 'Unable to find the paypal payment' END AS processing_error
  FROM triaged t LEFT JOIN balances ON bk = k
  WHERE outcome = 'parsed'
),
ledger_rows AS (SELECT * FROM processed WHERE processing_error IS NULL AND mode = 'Default')"""

_LEDGER = f"""{_LEDGER_ROWS},
ledger AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY contributionid ORDER BY received_at DESC, delivery_id DESC) AS rn
    FROM ledger_rows
  ) WHERE rn = 1
)"""

_NO_RECEIPT = ", ".join(f"'{code}'" for code in NO_RECEIPT_CAMPAIGNS)

_REQUESTS = f"""
req0 AS (
  SELECT event_id AS id, user_id AS u, event_type AS kind, CAST(ts AS TIMESTAMP) AS ts,
    CAST(floor(value * 100) AS BIGINT) AS value_minor,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS kk
  FROM events
),
req AS (
  SELECT *,
    CASE WHEN kk % 10 = 0 THEN NULL
      WHEN kk < 8 THEN ([{_NO_RECEIPT}])[CAST(kk % 4 + 1 AS INTEGER)]
      ELSE 'cmp_' || kk END AS cmp,
    CASE WHEN kk % 3 = 0 THEN NULL ELSE 'cmp_' || (kk - kk % 2) END AS intcmp,
    CAST(u * 67 % 10000 AS INTEGER) AS test_id,
    CASE WHEN id % 6 = 0 THEN 'android' WHEN id % 5 = 0 THEN 'ios' END AS platform,
    CASE WHEN id % 4 = 0 THEN 'AcquisitionsEpic' WHEN id % 7 = 0 THEN 'AcquisitionsThrasher' END AS component_type,
    CASE WHEN id % 3 = 0 THEN 'PartnerWeb' WHEN id % 11 = 0 THEN 'PartnerApps' END AS source,
    CASE WHEN id % 2 = 0 THEN id % 4 = 0 END AS is_support,
    CASE WHEN id % 3 = 0 THEN 'rpv' || id END AS referrer_pageview_id,
    CASE WHEN id % 3 = 0 THEN 'https://news.example.com/a?x=' || kk END AS referrer_url,
    CASE WHEN id % 4 = 0 THEN 'epic_1' END AS component_id,
    CASE WHEN id % 4 <> 0 THEN 'bw' || u END AS browser_id,
    CASE WHEN id % 8 <> 0 THEN 'banner:blue,stripe-checkout:stripe'
      WHEN id % 9 = 0 THEN 'banner:blue' ELSE '' END AS ab_tests,
    CASE WHEN u * 67 % 10000 > 0 THEN 'stripe-checkout:stripe' ELSE '' END AS abtests
  FROM req0
)"""

_CONTRIBUTIONS = f"""{_BASE},{_REQUESTS},
joined AS (
  SELECT b.*, r.id, r.u, r.cmp, r.intcmp, r.component_type, r.source, r.is_support, r.referrer_pageview_id,
    r.referrer_url, r.component_id, r.browser_id, r.ab_tests, r.abtests,
    'pv' || r.id AS pageview_id, r.platform AS said_platform,
    CASE WHEN feed = 'Stripe' THEN 'stripe' ELSE 'paypal-' || path END AS payment_source,
    CASE WHEN feed = 'Stripe' THEN 'ch_' ELSE 'PAY-' END || k AS paymentid
  FROM base b JOIN req r ON b.k % (SELECT count(*) FROM events) = r.id
  WHERE CASE WHEN feed = 'Stripe' THEN s <> 'F' AND r.id % 101 <> 0
    WHEN path = 'execute' THEN k % 23 <> 0 AND r.id % 107 <> 0
    ELSE k % 23 <> 0 AND r.id % 103 <> 0 END
),
contributions AS (
  SELECT *,
    CASE WHEN payment_source = 'stripe' THEN said_platform
      WHEN payment_source = 'paypal-execute' THEN coalesce(said_platform, 'web')
      ELSE coalesce(said_platform, 'ios') END AS platform,
    'user' || c || '@example.com' AS email, 'c' || (c % 25) AS country
  FROM joined
  WHERE feed = 'Stripe' OR (k % 31 <> 0 AND k % 37 <> 0 AND k % 41 <> 0)
)"""

_METADATA = f"""{_CONTRIBUTIONS},
metadata AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY cid ORDER BY received_at DESC, delivery_id DESC) AS mrn
    FROM contributions WHERE k % 43 <> 0
  ) WHERE mrn = 1
)"""

# The ledger and the attribution in one query: their shared base is written once.
_LEDGER_METADATA = _LEDGER + "," + _METADATA[len(_BASE) + 1 :]

_TESTS = """
visits AS (
  SELECT id, u, test_id, kk, kind,
    kk % 5 IN (0, 1, 2) AS landing,
    CASE kk WHEN 1 THEN 'Half & half=variant-b' WHEN 2 THEN 'THREE-WAYS=A=ignored' WHEN 3 THEN 'three-ways='
      WHEN 4 THEN 'nothing=control' END AS ab
  FROM req
),
native AS (
  SELECT *, 'Stripe checkout' AS "testName", 'stripe-checkout' AS "testSlug", 'stripe' AS "variantName", 'stripe' AS "variantSlug"
  FROM visits WHERE test_id > 0 AND test_id <= 10000
  UNION ALL
  SELECT *, 'Landing page', 'landing-page', 'with-copy', 'with-copy'
  FROM visits WHERE test_id > 0 AND test_id <= 10000 AND landing
  UNION ALL
  SELECT *, 'Half & half', 'half-half', CASE WHEN test_id % 2 = 0 THEN 'control' ELSE 'Variant B' END,
    CASE WHEN test_id % 2 = 0 THEN 'control' ELSE 'variant-b' END
  FROM visits WHERE test_id > 2500 AND test_id <= 7500
  UNION ALL
  SELECT *, 'Three ways', 'three-ways', (['a', 'b', 'c'])[test_id % 3 + 1], (['a', 'b', 'c'])[test_id % 3 + 1]
  FROM visits WHERE test_id > 0 AND test_id <= 3330 AND kk >= 20
),
allocs AS (
  SELECT id, u, kind, kk, "testSlug", "variantName", "variantSlug" FROM native WHERE kk NOT IN (1, 2)
  UNION ALL
  SELECT id, u, kind, kk, 'half-half', 'Variant B', 'variant-b' FROM visits WHERE kk = 1
  UNION ALL
  SELECT id, u, kind, kk, 'three-ways', 'a', 'a' FROM visits WHERE kk = 2
)"""

_BEACONS = f"""{_REQUESTS},
beacons AS (
  SELECT id AS event_id, ts, u || '-' || strftime(ts, '%Y%m%d') AS pageview_id, u AS browser_id, kind, kk,
    CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS step,
    (['web', 'ios', 'android'])[CAST(u % 3 + 1 AS INTEGER)] AS platform,
    u % 10 = 3 OR u % 10 = 7 AS opted_out,
    CAST(value_minor AS DECIMAL(18,2)) / 100 AS price, value_minor,
    (['GBP', 'USD', 'AUD', 'EUR'])[CAST(u % 4 + 1 AS INTEGER)] AS currency
  FROM req0
)"""
_BEACONS = _BEACONS.replace(_REQUESTS, _REQUESTS[: _REQUESTS.index(",\nreq AS")])

_CHECKOUT = f"""{_BEACONS},
checkout AS (
  SELECT * FROM beacons
  WHERE step IS NOT NULL AND NOT opted_out AND event_id % 89 <> 0 AND event_id % 97 <> 0 AND event_id % 101 <> 0
)"""

_PURCHASES = f"""{_BEACONS},
purchases AS (
  SELECT * FROM beacons
  WHERE kind = 'purchase' AND value_minor IS NOT NULL AND event_id % 89 <> 0 AND event_id % 97 <> 0 AND event_id % 101 <> 0
)"""

_HITS = f"""{_BEACONS},
sent AS (
  SELECT *, 'pageview' AS hit FROM beacons WHERE kind = 'view'
  UNION ALL SELECT *, 'checkout' FROM beacons WHERE step IS NOT NULL
  UNION ALL SELECT *, 'purchase' FROM beacons WHERE kind = 'purchase'
  UNION ALL SELECT *, 'event' FROM beacons WHERE step IS NULL
),
spoilt AS (
  SELECT *, event_id % 97 = 0 AS odd, CASE
    WHEN event_id % 89 = 0 THEN 'not json'
    WHEN event_id % 101 = 0 THEN 'hit_type'
    WHEN event_id % 97 = 0 AND hit = 'checkout' THEN 'step'
    WHEN hit = 'purchase' AND (event_id % 97 = 0 OR value_minor IS NULL) THEN 'price'
    WHEN event_id % 97 = 0 AND hit = 'event' THEN 'action'
  END AS problem FROM sent
),
hits AS (
  SELECT *, CASE WHEN problem IS NULL THEN hit END AS hit_kind,
    CASE WHEN event_id % 89 = 0 THEN 'not json ' || event_id ELSE
    '{{"hitType":"' || CASE WHEN event_id % 101 = 0 THEN 'timing' WHEN hit = 'pageview' THEN 'pageview' ELSE 'event' END
    || '","pageviewId":"' || pageview_id || '","clientId":"' || browser_id || '"'
    || CASE hit
      WHEN 'checkout' THEN ',"eventCategory":"Checkout","eventAction":"' || kind || '","productAction":"checkout","step":'
        || CASE WHEN odd THEN 9 ELSE step END
      WHEN 'purchase' THEN ',"eventCategory":"Payment","eventAction":"Contribute","eventLabel":"purchase","productAction":"purchase"'
        || CASE WHEN odd THEN '' ELSE coalesce(',"revenue":' || CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR), '') END
        || ',"currency":"' || lower(currency) || '"'
      WHEN 'event' THEN ',"eventCategory":"Form"' || CASE WHEN odd THEN '' ELSE ',"eventAction":"' || kind || '"' END
        || coalesce(',"eventValue":' || kk, '')
      ELSE '' END || '}}' END AS raw
  FROM spoilt
)"""

_FORM = "CASE WHEN browser_id % 2 = 0 THEN '/pay' ELSE '/register' END AS form_action"
_FIELDS = "['name', 'email', 'amount', 'postcode']"
_FORMS = f"""{_BEACONS},
fields AS (SELECT unnest({_FIELDS}) AS field, unnest([0, 1, 2, 3]) AS bit),
submits AS (SELECT *, {_FORM} FROM beacons WHERE kind IN ('click', 'purchase')),
submit_errors AS (
  SELECT event_id, form_action, field FROM submits, fields WHERE (kk // CAST(2 ** bit AS BIGINT)) % 2 = 1
),
submit_counts AS (
  SELECT s.event_id, any_value(s.form_action) AS form_action, count(e.field) AS n
  FROM submits s LEFT JOIN submit_errors e ON s.event_id = e.event_id GROUP BY 1
),
submit_events AS (
  SELECT CASE WHEN n > 0 THEN 'submit:failure' ELSE 'submit:success' END AS action, form_action AS label,
    CASE WHEN n > 0 THEN n END AS value FROM submit_counts
  UNION ALL SELECT 'submit:error', field || ' | ' || form_action, NULL FROM submit_errors
),
opens AS (SELECT *, {_FORM} FROM beacons WHERE kind IN ('view', 'error')),
last_open AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pageview_id ORDER BY ts DESC, event_id DESC) AS rn FROM opens)
  WHERE rn = 1 AND pageview_id NOT IN (SELECT pageview_id FROM submits)
),
left_errors AS (
  SELECT event_id, form_action, field FROM last_open, fields WHERE (kk // CAST(2 ** bit AS BIGINT)) % 2 = 1
),
left_empties AS (
  SELECT event_id, form_action, field FROM last_open, fields WHERE (kk // CAST(2 ** (bit + 2) AS BIGINT)) % 2 = 1
),
abandon_events AS (
  SELECT 'abandoned' AS action, form_action AS label, (SELECT count(*) FROM left_errors e WHERE e.event_id = o.event_id) AS value
  FROM last_open o
  UNION ALL SELECT 'abandoned:error', field || ' | ' || form_action, NULL FROM left_errors
  UNION ALL SELECT 'abandoned:empty', field || ' | ' || form_action, NULL FROM left_empties
)"""

_AMOUNTS = """
asked AS (
  SELECT o_orderkey AS request_id, o_custkey AS c, o_orderpriority AS priority,
    CAST(floor(o_totalprice) AS BIGINT) * 7 AS thousandths,
    CASE WHEN o_custkey % 29 <> 0 THEN (['GBP', 'USD', 'AUD', 'EUR'])[CAST(o_custkey % 4 + 1 AS INTEGER)] END AS cur
  FROM orders
),
capped AS (SELECT *, CAST(CASE WHEN cur = 'AUD' THEN 16000 ELSE 2000 END AS BIGINT) AS top FROM asked)"""



def _money(column: str) -> str:
    return f"CAST(CAST({column} AS DECIMAL(18,0)) / 100 AS DOUBLE)"


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


ORACLE: dict[str, str] = {}

_HOOK_COLUMNS = f"""delivery_id, {{id}} AS contributionid, paymentid, {_time('made_at')} AS created, cur AS currency,
  {_money('minor')} AS amount, status, email, mode"""

ORACLE["hooks_normalise_paypal"] = f"""WITH {_HOOKS}
SELECT {_HOOK_COLUMNS.format(id="CASE WHEN k % 7 <> 0 THEN cid END")}
FROM triaged WHERE feed = 'Paypal' AND outcome = 'parsed'"""

ORACLE["hooks_normalise_stripe"] = f"""WITH {_HOOKS}
SELECT {_HOOK_COLUMNS.format(id="cid")} FROM triaged WHERE feed = 'Stripe' AND outcome = 'parsed'"""

ORACLE["hooks_outcomes"] = f"""WITH {_HOOKS}
SELECT feed AS provider, outcome, coalesce(problem, 'none') AS reason, count(*) AS n FROM triaged GROUP BY 1, 2, 3"""

ORACLE["hooks_dead_letters"] = f"""WITH {_HOOKS}
SELECT lower(feed) AS feed, coalesce(problem, 'not signed') AS reason, outcome AS stage, count(*) AS n
FROM triaged WHERE outcome <> 'parsed' GROUP BY 1, 2, 3"""

ORACLE["payment_ledger"] = f"""WITH {_LEDGER}
SELECT contributionid, paymentid, feed AS provider, {_time('made_at')} AS created, cur AS currency,
  {_money('minor')} AS amount, {_money('converted_minor')} AS convertedamount, status, email FROM ledger"""

ORACLE["ledger_paid_totals"] = f"""WITH {_LEDGER}
SELECT feed AS provider, cur AS currency, count(*) AS n, {_money('sum(minor)')} AS total
FROM ledger WHERE status = 'Paid' GROUP BY 1, 2"""

ORACLE["ledger_totals"] = f"""WITH {_LEDGER}
SELECT feed AS provider, cur AS currency, status, strftime(made_at, '%Y-%m-%d') AS day, count(*) AS n,
  {_money('sum(minor)')} AS total FROM ledger GROUP BY 1, 2, 3, 4"""

ORACLE["ledger_rollup"] = f"""WITH {_LEDGER}
SELECT feed AS provider, cur AS currency, status,
  CAST(grouping(feed) + grouping(cur) + grouping(status) AS INTEGER) AS level,
  count(*) AS n, {_money('sum(minor)')} AS total FROM ledger GROUP BY ROLLUP (feed, cur, status)"""

ORACLE["ledger_regressions"] = f"""WITH {_LEDGER_ROWS}
SELECT delivery_id, contributionid, status, previous_status,
  coalesce(previous_status = 'Refunded' AND status = 'Paid', false) AS is_regression,
  coalesce(made_at < previous_made, false) AS is_late
FROM (
  SELECT *, lag(status) OVER w AS previous_status, lag(made_at) OVER w AS previous_made FROM ledger_rows
  WINDOW w AS (PARTITION BY contributionid ORDER BY received_at, delivery_id)
)"""

ORACLE["converted_amount"] = f"""WITH {_LEDGER_ROWS}
SELECT delivery_id, contributionid, paymentid, {_money('minor')} AS amount,
  {_money('converted_minor')} AS convertedamount, status, mode
FROM processed WHERE feed = 'Stripe' AND processing_error IS NULL"""

ORACLE["hooks_without_event"] = f"""WITH {_LEDGER_ROWS}
SELECT delivery_id, 'evt_' || k AS event_id, processing_error FROM processed
WHERE feed = 'Stripe' AND processing_error IS NOT NULL"""

ORACLE["paypal_id_backfill"] = f"""WITH {_LEDGER_ROWS}
SELECT delivery_id, paymentid, k % 7 <> 0 AS had_id, contributionid, processing_error
FROM processed WHERE feed = 'Paypal'"""

ORACLE["metadata_table"] = f"""WITH {_METADATA}
SELECT cid AS contributionid, {_time('made_at')} AS created, email, country, pageview_id, browser_id, abtests, cmp,
  intcmp, referrer_url AS referer_url, referrer_pageview_id AS referer_pageview_id, platform FROM metadata"""

ORACLE["attribution_backfill"] = f"""WITH {_BASE}
SELECT 'evt_' || k AS event_id, cid AS contributionid, 'user' || c || '@example.com' AS email, 'Donor ' || c AS name,
  CASE WHEN k % 4 <> 0 THEN 'cmp_' || (c % 50) END AS cmp, CASE WHEN k % 5 <> 0 THEN 'int_' || (k % 9) END AS intcmp,
  CASE WHEN k % 6 <> 0 THEN 'c' || (c % 25) END AS country_code, CAST(NULL AS VARCHAR) AS country_subdivision_code,
  CASE WHEN k % 8 = 0 THEN 'N' || k END AS postcode, 'pv' || k AS pageview_id, CASE WHEN k % 9 <> 0 THEN 'bw' || c END AS browser_id,
  CASE WHEN k % 7 <> 0 THEN 'visit' || c END AS visit_id, 'stripe-checkout:stripe' AS abtests
FROM base WHERE feed = 'Stripe'"""

ORACLE["contributors_merge"] = f"""WITH {_BASE},
saved AS (
  SELECT 'user' || c || '@example.com' AS receipt_email, k, received_at, delivery_id,
    CASE WHEN k % 3 <> 0 THEN c_name END AS firstname,
    CASE WHEN k % 5 <> 0 THEN 'of ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) END AS lastname,
    CASE WHEN k % 4 = 0 THEN CAST(c AS VARCHAR) END AS iduser, CASE WHEN k % 5 = 0 THEN 'N' || k END AS postcode,
    CASE WHEN k % 11 <> 0 THEN kid END AS contributor_id
  FROM base JOIN customer ON c = c_custkey
),
named AS (SELECT *, nullif(concat_ws(' ', firstname, lastname), '') AS name FROM saved),
ranked AS (SELECT *, row_number() OVER (ORDER BY received_at, delivery_id) AS seq FROM named)
SELECT receipt_email, arg_max(name, seq) AS name, arg_max(firstname, seq) AS firstname,
  arg_max(lastname, seq) AS lastname, arg_max(iduser, seq) AS iduser, arg_max(postcode, seq) AS postcode,
  (SELECT f.contributor_id FROM ranked f WHERE f.seq = min(r.seq)) AS contributor_id,
  {_time('max(received_at)')} AS updated
FROM ranked r GROUP BY receipt_email"""

_ACCOUNTS = f"""{_BASE},{_REQUESTS},
asked AS (
  SELECT b.*, r.id, CASE WHEN feed = 'Stripe' THEN 'stripe' ELSE 'paypal-' || path END AS kind,
    CASE WHEN feed = 'Stripe' THEN CASE WHEN r.id % 101 = 0 THEN 'token' END
      WHEN path = 'execute' THEN CASE WHEN r.id % 107 = 0 THEN 'paymentId' END
      WHEN r.id % 103 = 0 THEN 'paymentid' END AS problem,
    feed = 'Paypal' OR s <> 'F' AS charged, CASE WHEN k % 61 = 0 THEN 2 ELSE 1 END AS times
  FROM base b JOIN req r ON b.k % (SELECT count(*) FROM events) = r.id
),
payments AS (
  SELECT *, CASE WHEN feed = 'Paypal' AND k % 23 = 0 THEN 'not approved' WHEN problem IS NOT NULL THEN 'no request'
      WHEN feed = 'Paypal' AND (k % 31 = 0 OR k % 41 = 0 OR k % 37 = 0) THEN 'not storable'
      WHEN k % 43 = 0 THEN 'not stored' ELSE 'stored' END AS outcome,
    CASE WHEN k % 31 = 0 THEN 'contribution id' WHEN k % 41 = 0 THEN 'payer' ELSE 'amount' END AS lacks
  FROM asked WHERE charged
),
told AS (SELECT *, CASE WHEN outcome = 'not storable' THEN lacks ELSE outcome END AS reason FROM payments)"""

ORACLE["contribution_accounts"] = f"""WITH {_ACCOUNTS}
SELECT 'payment' AS side, kind, outcome, reason, count(*) AS n FROM told GROUP BY 2, 3, 4
UNION ALL
SELECT 'request', kind, 'rejected', problem, CAST(sum(times) AS BIGINT) FROM asked WHERE problem IS NOT NULL GROUP BY 2, 4
UNION ALL
SELECT 'request', kind, CASE WHEN charged THEN 'paid' ELSE 'no payment' END, CASE WHEN charged THEN 'paid' ELSE 'no payment' END,
  count(*) FROM asked WHERE problem IS NULL GROUP BY 2, 3, 4
UNION ALL
SELECT 'request', kind, 'repeated', 'repeated', CAST(sum(times - 1) AS BIGINT) FROM asked WHERE problem IS NULL GROUP BY 2
HAVING sum(times - 1) > 0"""

ORACLE["contribution_dead_letters"] = f"""WITH {_ACCOUNTS}
SELECT kind AS feed, 'payment' AS stage, reason, CASE WHEN feed = 'Stripe' THEN 'ch_' ELSE 'PAY-' END || k AS raw_id,
  CAST(NULL AS VARCHAR) AS raw_pageview_id
FROM told WHERE outcome <> 'stored'
UNION ALL
SELECT kind, 'request', problem, NULL, 'pv' || id FROM asked, (SELECT unnest([1, 2]) AS again) WHERE problem IS NOT NULL AND again <= times"""

ORACLE["ledger_metadata_reconcile"] = f"""WITH {_LEDGER_METADATA}
SELECT CASE WHEN m.cid IS NULL THEN 'ledger only' WHEN l.contributionid IS NULL THEN 'metadata only' ELSE 'both' END AS side,
  count(*) AS n, {_money('sum(l.minor)')} AS total
FROM ledger l FULL JOIN metadata m ON l.contributionid = m.cid GROUP BY 1"""

ORACLE["revenue_by_campaign"] = f"""WITH {_LEDGER_METADATA}
SELECT m.cmp AS cmp, m.country AS country, m.platform AS platform, l.cur AS currency, count(*) AS n,
  {_money('sum(l.minor)')} AS total
FROM ledger l JOIN metadata m ON l.contributionid = m.cid WHERE l.status = 'Paid' GROUP BY 1, 2, 3, 4"""

ORACLE["revenue_by_variant"] = f"""WITH {_LEDGER_METADATA}
SELECT split_part(m.abtests, ':', 1) AS test, split_part(m.abtests, ':', 2) AS variant, l.cur AS currency, count(*) AS n,
  {_money('sum(l.minor)')} AS total
FROM ledger l JOIN metadata m ON l.contributionid = m.cid WHERE l.status = 'Paid' AND m.abtests <> '' GROUP BY 1, 2, 3"""

ORACLE["receipts_outbox"] = f"""WITH {_CONTRIBUTIONS}
SELECT paymentid, email AS address, email AS subscriber_key,
  strftime(made_at, '%Y-%m-%dT%H:%M:%S.000Z') AS created, {_money('minor')} AS amount, cur AS currency,
  CASE cur WHEN 'GBP' THEN 'uk' WHEN 'USD' THEN 'us' WHEN 'AUD' THEN 'au' ELSE 'international' END AS edition,
  CASE WHEN feed = 'Stripe' THEN 'Donor ' || u
    ELSE concat_ws(' ', CASE WHEN k % 3 <> 0 THEN 'First' || c END, CASE WHEN k % 5 <> 0 THEN 'Last' || k END) END AS name,
  'contribution-thank-you' AS extension
FROM contributions
WHERE (feed = 'Stripe' OR k % 43 <> 0)
  AND coalesce(cmp NOT IN ({_NO_RECEIPT}), true)"""

ORACLE["consent_outbox"] = f"""WITH {_REQUESTS}
SELECT 'donor' || u || '@example.com' AS email, 'supporter' AS consents, count(*) AS n FROM req WHERE kk >= 50 GROUP BY 1"""

_ACQUISITION_ERROR = """CASE WHEN feed = 'Stripe' THEN NULL
    WHEN k % 31 = 0 THEN payment_source || ': unable to get transaction'
    WHEN k % 37 = 0 THEN payment_source || ': unable to get amount'
    WHEN k % 41 = 0 THEN payment_source || ': unable to get country code' END"""
ORACLE["acquisition_events"] = f"""WITH {_CONTRIBUTIONS}
SELECT paymentid, payment_source, 'Contribution' AS product, 'OneOff' AS payment_frequency,
  CASE WHEN feed = 'Stripe' THEN lower(cur) ELSE cur END AS currency, {_money('minor')} AS amount,
  feed AS payment_provider,
  CASE WHEN cmp = intcmp THEN cmp ELSE concat_ws(',', least(cmp, intcmp), CASE WHEN cmp IS NOT NULL AND intcmp IS NOT NULL
    THEN greatest(cmp, intcmp) END) END AS campaign_codes,
  ab_tests, 'c' || (c % 25) AS country_code, referrer_pageview_id, referrer_url, component_id, component_type, source,
  CASE WHEN payment_source <> 'paypal-capture' AND is_support THEN 'Support' ELSE 'Contribution' END AS platform,
  pageview_id, CASE WHEN payment_source <> 'paypal-capture' THEN 'visit' || u END AS visit_id, browser_id
FROM joined WHERE {_ACQUISITION_ERROR} IS NULL"""

ORACLE["acquisition_errors"] = f"""WITH {_CONTRIBUTIONS}
SELECT paymentid, payment_source, {_ACQUISITION_ERROR} AS error FROM joined WHERE {_ACQUISITION_ERROR} IS NOT NULL"""

ORACLE["paypal_approvals"] = f"""WITH {_BASE}
SELECT 'PAY-' || k AS paymentid, CASE WHEN k % 19 <> 0 THEN 'https://pay.example.com/approve/' || k END AS approval_url,
  CASE WHEN k % 19 = 0 THEN 'Unable to parse payment' END AS approval_error,
  CASE WHEN k % 31 <> 0 AND k % 37 <> 0 THEN (minor // 100) || '.' || lpad(CAST(minor % 100 AS VARCHAR), 2, '0') || cur END AS shown,
  k % 23 <> 0 AS accepted
FROM base WHERE feed = 'Paypal'"""

ORACLE["paypal_error_report"] = f"""WITH {_REQUESTS}
SELECT (['NotFound', 'PaymentAlreadyDone', 'InstrumentDeclined', 'Other'])[CAST(kk % 4 + 1 AS INTEGER)] AS error_type,
  CASE WHEN kk % 4 = 2 THEN 'warning' ELSE 'error' END AS severity,
  CASE WHEN kk % 6 IN (0, 5) THEN 'Unknown error message' ELSE 'payment failed' END AS message, count(*) AS n
FROM req WHERE kind = 'error' GROUP BY 1, 2, 3"""

ORACLE["auth_requests"] = f"""WITH {_REQUESTS}
SELECT id, CASE WHEN kk % 5 = 4 THEN 'country_group' WHEN value_minor < 100 THEN 'amount' END AS problem,
  (['uk', 'us', 'au', 'eu', NULL])[CAST(kk % 5 + 1 AS INTEGER)] AS country_group,
  CASE WHEN value_minor >= 100 THEN {_money('value_minor')} END AS amount, cmp, intcmp,
  'https://news.example.com/a?x=' || kk AS referrer_url, component_type, is_support FROM req"""

ORACLE["amount_caps"] = f"""WITH {_AMOUNTS}
SELECT request_id, cur AS known_currency, cur IS NOT NULL AND thousandths >= 1000 AS paypal_accepted,
  {_money('least((thousandths + 5) // 10, top * 100)')} AS paypal_amount,
  least(thousandths // 10, CAST(top * 100 AS BIGINT)) AS stripe_minor,
  CASE cur WHEN 'USD' THEN 'us' WHEN 'AUD' THEN 'au' WHEN 'EUR' THEN 'eu' ELSE 'uk' END AS card_group
FROM capped"""

ORACLE["submission_quality"] = f"""WITH {_AMOUNTS},
entered AS (
  SELECT *, CASE WHEN priority = '2-HIGH' THEN thousandths ELSE CASE WHEN priority <> '5-LOW' THEN thousandths * 1000 END END AS millionths
  FROM capped
)
SELECT priority, CASE WHEN millionths > top * 1000000 THEN 'above maximum'
  WHEN coalesce(millionths, 0) = 0 AND c % 2 <> 0 THEN 'no amount'
  WHEN coalesce(millionths, 0) <> 0 AND millionths < 1000000 THEN 'below minimum' ELSE 'ok' END AS rule, count(*) AS n
FROM entered GROUP BY 1, 2"""

ORACLE["preset_vs_custom"] = f"""WITH {_AMOUNTS},
picked AS (
  SELECT *, CASE WHEN priority = '5-LOW' THEN (thousandths + 5) // 10 ELSE ([2500, 5000, 10000, 25000, 50000])[CAST(c % 5 + 1 AS INTEGER)] END AS cents,
    CASE WHEN c % 3 = 0 THEN 'au' WHEN c % 3 = 1 THEN 'uk' ELSE 'none' END AS country_group, c % 10 = 0 AS in_amount_test
  FROM asked
)
SELECT country_group, in_amount_test,
  CASE WHEN in_amount_test THEN cents IN (300, 2500, 70000) WHEN country_group = 'au' THEN cents IN (5000, 10000, 25000, 50000)
    ELSE cents IN (2500, 5000, 10000, 25000) END AS is_preset, count(*) AS n
FROM picked GROUP BY 1, 2, 3"""

ORACLE["preset_monthly"] = f"""WITH {_AMOUNTS},
picked AS (
  SELECT *, ([2, 5, 10, 20, 25, 50, 100])[CAST(c % 7 + 1 AS INTEGER)] AS v,
    CASE WHEN c % 3 = 0 THEN 'au' WHEN c % 3 = 1 THEN 'uk' ELSE 'none' END AS country_group
  FROM asked
)
SELECT country_group, CASE WHEN c % 10 = 0 THEN 25 WHEN country_group = 'au' THEN 100 ELSE 50 END AS preselected,
  CASE WHEN country_group = 'au' THEN v IN (5, 10, 25, 50) ELSE v IN (2, 5, 10, 20) END AS is_preset, count(*) AS n
FROM picked GROUP BY 1, 2, 3"""

_RULES = {
    "text_required": "text <> ''",
    "text_length": "length(text) BETWEEN 200 AND 4000",
    "source_pattern": "regexp_matches(source, '^src[0-9]$')",
    "quality_required": "quality IS NOT NULL",
    "language_profile": "lang IN ('en', 'fr')",
    "disabled_rule": "true",
    "trimmed_text": "n_chars >= length(trim(text, ' '))",
}
ORACLE["field_rules_report"] = "WITH rows_ AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(
    f"SELECT lang, '{rule}' AS rule_id, count(*) FILTER (WHERE {test}) AS n_valid, "
    f"count(*) FILTER (WHERE NOT ({test})) AS n_invalid FROM rows_ GROUP BY lang"
    for rule, test in _RULES.items()
)

ORACLE["mode_split"] = f"""WITH {_BASE}
SELECT CASE WHEN 'Supplier#' || lpad(CAST(c AS VARCHAR), 9, '0') IN (SELECT s_name FROM supplier) THEN 'Testing' ELSE 'Default' END AS mode,
  count(*) AS n, {_money('sum(minor)')} AS total FROM base GROUP BY 1"""

ORACLE["request_modes"] = f"""WITH {_REQUESTS},
named AS (
  SELECT 'Supplier#' || lpad(CAST(CASE WHEN id % 5 = 0 THEN kk WHEN id % 3 = 0 THEN id WHEN id % 7 <> 0 THEN u END AS VARCHAR), 9, '0') AS name FROM req
)
SELECT CASE WHEN name IN (SELECT s_name FROM supplier) THEN 'Testing' ELSE 'Default' END AS mode, count(*) AS n FROM named GROUP BY 1"""

ORACLE["text_whitespace"] = """SELECT doc_id, CAST(length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS BIGINT) AS trimmed,
  CAST(length(regexp_replace(text, '\\s+', '', 'g')) AS BIGINT) AS solid FROM documents"""

ORACLE["ab_allocation"] = f"""WITH {_REQUESTS},{_TESTS}
SELECT id, test_id, "testName", "testSlug", "variantName", "variantSlug", "testSlug" AS event_test,
  "variantName" AS event_variant FROM native"""

ORACLE["ab_forced"] = f"""WITH {_REQUESTS},{_TESTS}
SELECT v.id AS id, any_value(v.ab) AS ab,
  coalesce(string_agg(a."testSlug" || ':' || a."variantSlug", ',' ORDER BY a."testSlug" || ':' || a."variantSlug"), '') AS allocations,
  CAST(count(a.id) AS INTEGER) AS n
FROM visits v LEFT JOIN allocs a ON v.id = a.id GROUP BY v.id"""

ORACLE["ab_registration"] = f"""WITH {_REQUESTS},{_TESTS}
SELECT "testSlug" AS test, "variantSlug" AS variant, 'false' AS complete, count(*) AS n FROM allocs GROUP BY 1, 2"""

ORACLE["ab_exposure"] = f"""WITH {_REQUESTS},{_TESTS}
SELECT "testSlug", "variantName", count(DISTINCT u) AS visitors, count(DISTINCT u) FILTER (WHERE kind = 'purchase') AS payers,
  CAST(count(DISTINCT u) FILTER (WHERE kind = 'purchase') AS DOUBLE) / count(DISTINCT u) AS rate
FROM allocs GROUP BY 1, 2"""

ORACLE["ab_exposure_by_day"] = f"""WITH {_REQUESTS},{_TESTS}
SELECT "testSlug", "variantName", count(DISTINCT u) AS visitors, true AS near FROM allocs GROUP BY 1, 2"""

ORACLE["ab_sticky_id"] = """WITH RECURSIVE seen AS (
  SELECT CAST(user_id AS VARCHAR) AS b, CAST(floor(epoch(ts)) AS BIGINT) AS sec, count(*) AS n FROM events GROUP BY 1, 2
),
starts AS (
  SELECT b, min(sec) AS start FROM seen GROUP BY b
  UNION ALL
  SELECT b, start FROM (
    SELECT s.b AS b, (SELECT min(e.sec) FROM seen e WHERE e.b = s.b AND e.sec >= s.start + 604800) AS start FROM starts s
  ) WHERE start IS NOT NULL
)
SELECT s.b AS browser_id, s.start AS assigned_second, CAST(sum(e.n) AS BIGINT) AS n_requests, s.start + 604800 AS expires_second,
  CAST(CAST('0x' || substr(md5(s.b || ':' || s.start), 1, 8) AS BIGINT) % 10000 AS INTEGER) AS test_id
FROM starts s JOIN seen e ON e.b = s.b AND e.sec >= s.start AND e.sec < s.start + 604800
GROUP BY s.b, s.start"""

_METRIC = f"""{_BEACONS},
metrics AS (
  SELECT ts, CASE kind
      WHEN 'view' THEN CASE WHEN kk % 7 = 0 THEN 'post-payment-page-displayed' ELSE 'home-page-displayed' END
      WHEN 'click' THEN CASE WHEN kk % 4 = 1 THEN 'payment-authorisation-attempt' ELSE 'payment-attempt' END
      WHEN 'purchase' THEN CASE WHEN kk % 4 = 1 THEN 'payment-authorisation-success'
        WHEN kk % 9 = 2 THEN 'payment-success-redirected-to-other-platform' ELSE 'payment-success' END
      WHEN 'error' THEN CASE WHEN kk % 4 = 1 THEN 'payment-authorisation-failure'
        WHEN kk % 9 = 2 THEN 'unhandled-payment-failure' ELSE 'payment-failure' END
      ELSE 'thank-you-page-displayed' END AS name,
    CASE WHEN kind = 'view' THEN 'na' WHEN kk < 40 THEN 'Stripe' WHEN kk < 80 THEN 'Paypal' ELSE 'unknown' END AS payment_provider,
    platform
  FROM beacons
)"""
ORACLE["metric_counts"] = f"""WITH {_METRIC}
SELECT {_time("date_trunc('hour', ts)")} AS window_start, name, payment_provider, platform, count(*) AS n
FROM metrics GROUP BY 1, 2, 3, 4"""

ORACLE["metric_rates"] = f"""WITH {_LEDGER_ROWS},{_METRIC},
done AS (
  SELECT t.feed AS payment_provider, t.outcome, p.processing_error FROM triaged t LEFT JOIN processed p ON t.delivery_id = p.delivery_id
),
hook_counts AS (
  SELECT payment_provider, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'parsed') AS parsed,
    count(*) FILTER (WHERE outcome = 'parsed' AND processing_error IS NULL) AS processed_n FROM done GROUP BY 1
),
pay_counts AS (
  SELECT payment_provider, count(*) FILTER (WHERE name = 'payment-attempt') AS pay_attempts,
    count(*) FILTER (WHERE name = 'payment-success') AS pay_successes,
    count(*) FILTER (WHERE name = 'payment-authorisation-attempt') AS auth_attempts,
    count(*) FILTER (WHERE name = 'payment-authorisation-success') AS auth_successes FROM metrics GROUP BY 1
)
SELECT payment_provider, coalesce(pay_attempts, 0) AS payment_attempts, CAST(auth_successes AS DOUBLE) / nullif(auth_attempts, 0) AS authorisation_rate,
  CAST(pay_successes AS DOUBLE) / nullif(pay_attempts, 0) AS payment_rate, coalesce(attempts, 0) AS hook_attempts,
  CAST(parsed AS DOUBLE) / nullif(attempts, 0) AS parse_rate, CAST(processed_n AS DOUBLE) / nullif(parsed, 0) AS processing_rate,
  true AS all_accounted
FROM pay_counts FULL JOIN hook_counts USING (payment_provider)"""

ORACLE["checkout_funnel"] = f"""WITH {_CHECKOUT},
steps AS (
  SELECT platform, pageview_id, step, CASE WHEN step < 4 THEN 1 ELSE count(*) END AS n FROM checkout GROUP BY 1, 2, 3
),
counts AS (
  SELECT platform, {", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE step = {i}), 0) AS BIGINT) AS step_{i}" for i in (1, 2, 3, 4))}
  FROM steps GROUP BY 1
)
SELECT *, {", ".join(f"CAST(step_{i} AS DOUBLE) / nullif(step_1, 0) AS rate_{i}" for i in (2, 3, 4))} FROM counts"""

ORACLE["checkout_first_steps"] = f"""WITH {_CHECKOUT}
SELECT pageview_id, step, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY pageview_id, step ORDER BY ts, event_id) AS rn FROM checkout
) WHERE rn = 1"""

_EVENT_REPORT = """SELECT action, label, count(*) AS n, CAST(coalesce(sum(value), 0) AS BIGINT) AS total_value
FROM {0} GROUP BY 1, 2"""
ORACLE["form_errors"] = f"WITH {_FORMS} {_EVENT_REPORT.format('submit_events')}"
ORACLE["form_abandonment"] = f"WITH {_FORMS} {_EVENT_REPORT.format('abandon_events')}"
ORACLE["top_form_errors"] = f"""WITH {_FORMS}
SELECT label, count(*) AS n FROM (SELECT * FROM submit_events UNION ALL SELECT * FROM abandon_events)
WHERE action IN ('submit:error', 'abandoned:empty') GROUP BY label ORDER BY n DESC, label LIMIT 5"""

ORACLE["stream_top_form_errors"] = f"""WITH {_FORMS}
SELECT label, count(*) AS n FROM submit_events WHERE action = 'submit:error' GROUP BY label ORDER BY n DESC, label LIMIT 5"""

ORACLE["beacon_hits"] = f"""WITH {_HITS}
SELECT hit_kind AS kind, problem, count(*) AS n FROM hits GROUP BY 1, 2"""

ORACLE["beacon_dead_letters"] = f"""WITH {_HITS}
SELECT raw, 'beacon' AS feed, problem AS reason, 'parse-error' AS stage FROM hits WHERE problem IS NOT NULL"""

ORACLE["beacon_revenue"] = f"""WITH {_PURCHASES}
SELECT currency, count(*) AS n, {_money('sum(value_minor)')} AS total FROM purchases GROUP BY 1"""

ORACLE["beacon_vs_ledger"] = f"""WITH {_LEDGER},{_PURCHASES},
seen AS (
  SELECT currency, count(*) AS beacons, {_money('sum(value_minor)')} AS reported FROM purchases GROUP BY 1
),
got AS (
  SELECT cur AS currency, count(*) AS payments, {_money('sum(minor)')} AS paid FROM ledger WHERE status = 'Paid' GROUP BY 1
)
SELECT currency, beacons, reported, payments, paid FROM seen FULL JOIN got USING (currency)"""

ORACLE["campaign_progress"] = f"""WITH {_LEDGER_METADATA},
raised AS (
  SELECT m.cmp AS campaign, {_money('sum(l.minor)')} AS raised
  FROM ledger l JOIN metadata m ON l.contributionid = m.cid WHERE l.status = 'Paid' GROUP BY 1
),
goals AS (
  SELECT 'cmp_' || kk AS campaign, CAST(count(*) AS DOUBLE) AS sheet_total, CAST((kk + 1) * 250 AS DOUBLE) AS goal FROM req0 GROUP BY kk
)
SELECT campaign, coalesce(raised, 0) AS raised, goal,
  CAST(floor(least(coalesce(raised, 0), goal) / goal * 100 - 100) AS BIGINT) AS shift_percent, goal / 1000 AS goal_thousands,
  CAST(floor(least(sheet_total, goal) / goal * 100 - 100) AS BIGINT) AS sheet_shift_percent
FROM goals LEFT JOIN raised USING (campaign)"""

ORACLE["last_contribution"] = f"""WITH {_REQUESTS},
bought AS (
  SELECT u AS browser_id, date_trunc('second', ts) - to_hours(kk) AS created,
    row_number() OVER (PARTITION BY u ORDER BY ts DESC, id DESC) AS rn, count(*) OVER (PARTITION BY u) AS n
  FROM req0 WHERE kind = 'purchase'
)
SELECT browser_id, {_time('created')} AS last_contribution, n AS n_contributions FROM bought WHERE rn = 1"""

ORACLE["request_tags"] = f"""WITH {_REQUESTS}
SELECT CASE WHEN kk >= 10 THEN sha256('0123456789abcdef' || 'bw' || u) ELSE 'unknown' END AS "BrowserId",
  CAST(id AS VARCHAR) AS "RequestId", '/' || kind AS "Path" FROM req0"""

ORACLE["visitor_dimensions"] = f"""WITH {_REQUESTS}
SELECT id, kk < 60 AS signed_in, kk >= 60 AS signed_out, 'contributions' AS platform,
  CASE WHEN id % 10 <> 0 THEN 'pv' || id END AS pageview_id, CASE WHEN id % 4 <> 0 AND id % 3 <> 0 THEN 'bw' || u END AS browser_id,
  CASE WHEN kind = 'purchase' THEN 'ch_' || id END AS charge_id,
  CASE WHEN kk < 60 THEN CAST(u AS VARCHAR) END AS identity_id, CASE WHEN kk < 60 THEN c_name || ' é?~ü' END AS display_name,
  intcmp FROM req LEFT JOIN customer ON u = c_custkey"""

ORACLE["session_platform"] = """WITH said AS (
  SELECT conv_id, turn, coalesce(CASE WHEN role = 'assistant' AND turn = 3 THEN 'web-app' END,
    CASE WHEN role = 'system' THEN 'ios' WHEN role = 'user' AND turn % 4 = 2 THEN 'android' END) AS own FROM conversations
),
carried AS (
  SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'web') AS platform FROM said
)
SELECT conv_id, turn, platform, platform IN ('android', 'ios') AS is_mobile FROM carried"""

ORACLE["sessions"] = f"""WITH marked AS (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1800 SECONDS THEN 0 ELSE 1 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
),
numbered AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_no FROM marked)
SELECT user_id, session_no, {_time('min(ts)')} AS started, {_time('max(ts)')} AS ended, count(*) AS n_events
FROM numbered GROUP BY 1, 2"""

_OK = "page_id % 13 <> 0 AND page_id % 11 <> 0"
ORACLE["landing_attribution"] = f"""
SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'not found' WHEN page_id % 11 = 0 THEN 'not json'
    WHEN page_id % 5 = 0 THEN 'component_type' ELSE 'ok' END AS outcome,
  CASE WHEN {_OK} THEN 'cmp_' || (page_id % 50) END AS campaign_code, CASE WHEN {_OK} THEN 'pv' || page_id END AS referrer_pageview_id,
  CASE WHEN {_OK} THEN split_part(url, '#', 1) END AS referrer_url,
  CASE WHEN {_OK} AND page_id % 5 <> 0 THEN 'AcquisitionsEpic' END AS component_type, CASE WHEN {_OK} THEN 'PartnerWeb' END AS source,
  CASE WHEN {_OK} AND page_id % 3 = 0 THEN 'banner' END AS test_name, CASE WHEN {_OK} THEN true END AS referrer_is_external,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS query_page,
  nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS query_utm
FROM pages"""

ORACLE["country_routing"] = """WITH countries AS (
  SELECT n_nationkey AS nk, CASE r_name WHEN 'AFRICA' THEN 'int' WHEN 'AMERICA' THEN 'us' WHEN 'ASIA' THEN 'au' WHEN 'EUROPE' THEN 'eu' END AS grp
  FROM nation JOIN region ON n_regionkey = r_regionkey
)
SELECT coalesce(grp, 'uk') AS path, coalesce(grp, 'uk') AS country_group, grp IS NULL AS is_fallback, count(*) AS n
FROM customer LEFT JOIN countries ON c_nationkey = nk AND c_mktsegment <> 'MACHINERY' GROUP BY 1, 2, 3"""

_PROFILE = """profiles AS (
  SELECT c_custkey AS pk, c_name || '@example.com' AS profile_email,
    CASE WHEN c_acctbal > 0 THEN c_name || ' ' || c_mktsegment END AS profile_name FROM customer WHERE c_mktsegment <> 'BUILDING'
)"""
ORACLE["profile_enrichment"] = f"""WITH {_REQUESTS},{_PROFILE},
visitors AS (SELECT u AS identity_id, count(*) AS n_requests FROM req0 WHERE kk < 70 GROUP BY 1)
SELECT identity_id, n_requests, profile_email, profile_name FROM visitors LEFT JOIN profiles ON identity_id = pk"""

ORACLE["request_enrichment"] = f"""WITH {_REQUESTS},{_PROFILE}
SELECT id, CASE WHEN kk < 70 THEN u END AS identity_id, profile_email, profile_name
FROM req0 LEFT JOIN profiles ON CASE WHEN kk < 70 THEN u END = pk"""

_SORRY = "Sorry, the card number that you have entered is incorrect. Please check and retype."
_GENERIC = "Sorry, we weren''t able to process your payment this time around. Please try again."
ORACLE["decline_report"] = f"""WITH {_REQUESTS},
failed AS (
  SELECT CASE WHEN kk % 5 = 0 THEN 'api_error' WHEN kk % 11 <> 0 THEN 'card_error' END AS error_type,
    (['card_declined', 'incorrect_number', 'expired_card', 'invalid_cvc', 'processing_error', 'no_such_code', 'card_declined'])[CAST(kk % 7 + 1 AS INTEGER)] AS code,
    CASE WHEN kk % 4 <> 0 THEN (['card_not_supported', 'try_again_later', 'do_not_honor'])[CAST(kk % 3 + 1 AS INTEGER)] END AS decline
  FROM req0 WHERE kind = 'error'
)
SELECT CASE WHEN error_type = 'card_error' THEN
    CASE WHEN code = 'card_declined' THEN CASE decline
        WHEN 'card_not_supported' THEN 'We''re sorry. We can''t take payment with this type of card. Please try again using Visa, Mastercard or American Express.'
        WHEN 'try_again_later' THEN 'We can''t process your payment right now. Please try again later.'
        ELSE 'We''re sorry. Your card has been declined.' END
      WHEN code = 'incorrect_number' THEN '{_SORRY}'
      WHEN code = 'expired_card' THEN 'Sorry, this card has expired. Please try again with another card.'
      WHEN code = 'invalid_cvc' THEN 'Sorry, the security code that you have entered is invalid. Please check and retype.'
      ELSE '{_GENERIC}' END
  ELSE '{_GENERIC}' END AS message, count(*) AS n
FROM failed GROUP BY 1"""

# --- streams: what the batch twin gives ----------------------------------------------------------------------------------

ORACLE["stream_ledger"] = ORACLE["payment_ledger"]
ORACLE["stream_dead_letters"] = f"""WITH {_LEDGER_ROWS}
SELECT lower(feed) AS feed, outcome AS stage, coalesce(problem, 'not signed') AS reason, count(*) AS n
FROM triaged WHERE outcome <> 'parsed' GROUP BY 1, 2, 3
UNION ALL
SELECT lower(feed), 'processing-error', processing_error, count(*) FROM processed WHERE processing_error IS NOT NULL GROUP BY 1, 2, 3"""
ORACLE["stream_late_hooks"] = f"SELECT * FROM ({ORACLE['ledger_regressions']}) WHERE is_regression OR is_late"
ORACLE["stream_contributors"] = ORACLE["contributors_merge"]
ORACLE["stream_metadata"] = ORACLE["metadata_table"]
ORACLE["stream_lost_payments"] = f"""SELECT * FROM ({ORACLE['contribution_dead_letters']}) WHERE stage = 'payment'"""
ORACLE["stream_metric_counts"] = ORACLE["metric_counts"]
ORACLE["stream_funnel"] = ORACLE["checkout_funnel"]
ORACLE["stream_abandonment"] = ORACLE["form_abandonment"]
ORACLE["stream_session_state"] = ORACLE["ab_sticky_id"]
ORACLE["stream_session_platform"] = f"""WITH ids AS ({ORACLE["ab_sticky_id"]}),
said AS (
  SELECT CAST(user_id AS VARCHAR) AS b, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id,
    CASE event_type WHEN 'click' THEN 'android' WHEN 'purchase' THEN 'ios' END AS own FROM events
),
carried AS (
  SELECT b, sec, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY b ORDER BY sec, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'web') AS platform FROM said
)
SELECT browser_id, assigned_second, platform, platform IN ('android', 'ios') AS is_mobile, count(*) AS n_requests
FROM carried JOIN ids ON b = browser_id AND sec >= assigned_second AND sec < expires_second GROUP BY 1, 2, 3"""
ORACLE["stream_receipts_outbox"] = (
    f"SELECT address, created, amount, currency, edition, name, extension FROM ({ORACLE['receipts_outbox']})"
)
ORACLE["stream_consent_outbox"] = ORACLE["consent_outbox"]
ORACLE["acquisition_messages"] = f"""SELECT paymentid,
  CASE component_type WHEN 'AcquisitionsEpic' THEN 'ACQUISITIONS_EPIC' WHEN 'AcquisitionsThrasher' THEN 'ACQUISITIONS_THRASHER' END AS component_type,
  CASE source WHEN 'PartnerWeb' THEN 'PARTNER_WEB' WHEN 'PartnerApps' THEN 'PARTNER_APPS' END AS source,
  'ONE_OFF' AS payment_frequency, upper(platform) AS platform FROM ({ORACLE['acquisition_events']})"""

ORACLE["stream_acquisitions"] = f"""SELECT a.paymentid, a.payment_source, a.currency, a.amount, a.campaign_codes, a.ab_tests,
  a.platform, d.month, d.day FROM ({ORACLE['acquisition_events']}) a
JOIN (WITH {_BASE} SELECT CASE WHEN feed = 'Stripe' THEN 'ch_' ELSE 'PAY-' END || k AS paymentid,
  strftime(made_at, '%Y-%m') AS month, strftime(made_at, '%Y-%m-%d') AS day FROM base) d ON a.paymentid = d.paymentid"""
