"""The same results in DuckDB's SQL, built from one chain of common table expressions."""

from __future__ import annotations

from ..functions import text
from ..operators.exceptions import REASONS
from . import workload

_CHAIN = [
    ("rows", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, external_ref ORDER BY seq) AS rn FROM feed) WHERE rn = 1"),
    ("j1", """SELECT c.txn_id AS left_id, b.right_id FROM rows c JOIN
        (SELECT external_ref, currency, min(txn_id) AS right_id FROM rows WHERE source = 'gl' GROUP BY 1, 2 HAVING count(*) = 1) b
        ON c.parent_ref = b.external_ref AND c.currency = b.currency WHERE c.source IN ('gateway', 'settlement') AND c.parent_ref <> ''"""),
    ("j2g", """SELECT g.ref, b.bank_id FROM
        (SELECT group_ref AS ref, sum(amount_minor) AS total, min(currency) AS lo, max(currency) AS hi FROM rows WHERE source = 'settlement' AND group_ref <> '' GROUP BY 1) g
        JOIN (SELECT external_ref AS ref, min(txn_id) AS bank_id, min(amount_minor) AS amount, min(currency) AS currency FROM rows WHERE source = 'bank' GROUP BY 1 HAVING count(*) = 1) b
        ON g.ref = b.ref WHERE lo = hi AND lo = currency AND total = amount"""),
    ("exact", """SELECT 'parent_ref|' || left_id AS match_id, 'parent_ref' AS pass, 'left' AS side, left_id AS txn_id FROM j1
        UNION ALL SELECT 'parent_ref|' || left_id, 'parent_ref', 'right', right_id FROM j1
        UNION ALL SELECT 'group_ref|' || bank_id, 'group_ref', 'left', txn_id FROM rows JOIN j2g ON group_ref = ref WHERE source = 'settlement'
        UNION ALL SELECT 'group_ref|' || bank_id, 'group_ref', 'right', bank_id FROM j2g"""),
    ("free1", "SELECT *, lower(trim(regexp_replace(coalesce(counterparty, ''), '\\s+', ' ', 'g'))) AS party FROM rows WHERE txn_id NOT IN (SELECT txn_id FROM exact)"),
    ("c3", """SELECT l.txn_id AS left_id, b.txn_id AS right_id, count(*) OVER (PARTITION BY l.txn_id) AS nl, count(*) OVER (PARTITION BY b.txn_id) AS nb
        FROM free1 l JOIN free1 b ON l.source = 'gl' AND b.source = 'bank' AND l.currency = b.currency AND l.direction = b.direction AND l.amount_minor = b.amount_minor
        AND l.party = b.party AND b.value_date - l.value_date BETWEEN 0 AND 2"""),
    ("j3", "SELECT left_id, right_id FROM c3 WHERE nl = 1 AND nb = 1"),
    ("free2", """SELECT *, CAST(round_even(CAST(amount_minor AS decimal(18,0)) * CAST(CASE currency WHEN 'USD' THEN 83.20 WHEN 'EUR' THEN 90.10 WHEN 'GBP' THEN 105.40 END AS decimal(10,2)), 0) AS BIGINT) AS expected
        FROM free1 WHERE txn_id NOT IN (SELECT left_id FROM j3 UNION ALL SELECT right_id FROM j3)"""),
    ("c4", """SELECT l.txn_id AS left_id, b.txn_id AS right_id, count(*) OVER (PARTITION BY l.txn_id) AS nl, count(*) OVER (PARTITION BY b.txn_id) AS nb
        FROM free2 l JOIN free2 b ON l.source = 'gl' AND l.currency <> 'INR' AND b.source = 'bank' AND b.currency = 'INR' AND l.direction = b.direction
        AND b.value_date - l.value_date BETWEEN 0 AND 2 AND abs(b.amount_minor - l.expected) <= 100"""),
    ("j4", "SELECT left_id, right_id FROM c4 WHERE nl = 1 AND nb = 1"),
    ("edges", """SELECT * FROM exact
        UNION ALL SELECT 'economic_pair|' || left_id, 'economic_pair', 'left', left_id FROM j3 UNION ALL SELECT 'economic_pair|' || left_id, 'economic_pair', 'right', right_id FROM j3
        UNION ALL SELECT 'fx|' || left_id, 'fx', 'left', left_id FROM j4 UNION ALL SELECT 'fx|' || left_id, 'fx', 'right', right_id FROM j4"""),
    ("matches", """SELECT match_id, pass, CASE WHEN pass IN ('parent_ref', 'group_ref') THEN 'exact' ELSE 'rule' END AS tier,
        CAST(CASE pass WHEN 'economic_pair' THEN 0.95 WHEN 'fx' THEN 0.92 ELSE 1.0 END AS DOUBLE) AS confidence,
        count(*) FILTER (side = 'left') AS n_left, count(*) FILTER (side = 'right') AS n_right,
        count(*) FILTER (side = 'left') > 1 OR count(*) FILTER (side = 'right') > 1 AS one_to_many FROM edges GROUP BY match_id, pass"""),
    ("unresolved", "SELECT * FROM rows WHERE txn_id NOT IN (SELECT txn_id FROM edges)"),
    ("anomalies", """SELECT primary_id, twin_id, CAST(lag AS INTEGER) AS lag, at_risk, currency, CAST(CASE WHEN lag = 0 THEN 0.8 ELSE 0.65 END AS DOUBLE) AS confidence FROM (
        SELECT u.txn_id AS primary_id, r.txn_id AS twin_id, abs(u.value_date - r.value_date) AS lag, u.amount_minor AS at_risk, u.currency,
               row_number() OVER (PARTITION BY u.txn_id ORDER BY abs(u.value_date - r.value_date), r.seq) AS rn
        FROM unresolved u JOIN rows r ON u.source = 'bank' AND r.source = 'bank' AND r.txn_id NOT IN (SELECT txn_id FROM unresolved) AND u.amount_minor = r.amount_minor AND u.currency = r.currency
        AND lower(coalesce(u.counterparty, '')) = lower(coalesce(r.counterparty, '')) AND abs(u.value_date - r.value_date) <= 1 AND u.external_ref <> r.external_ref) WHERE rn = 1"""),
    ("linked", """SELECT DISTINCT a.txn_id, s.source AS other FROM edges a JOIN edges b ON a.match_id = b.match_id AND a.side <> b.side JOIN rows s ON s.txn_id = b.txn_id
        JOIN rows o ON o.txn_id = a.txn_id"""),
    ("unbanked", "SELECT * FROM rows WHERE source = 'settlement' AND txn_id NOT IN (SELECT txn_id FROM linked WHERE other = 'bank')"),
    ("pool", """SELECT deposit_id, deposit, currency, line_id, line, CAST(place AS INTEGER) AS place FROM (
        SELECT u.txn_id AS deposit_id, u.amount_minor AS deposit, u.currency, l.txn_id AS line_id, l.amount_minor AS line,
               row_number() OVER (PARTITION BY u.txn_id ORDER BY abs(u.value_date - l.value_date), l.amount_minor DESC, l.seq) AS place
        FROM unresolved u JOIN unbanked l ON u.source = 'bank' AND u.direction = 'inbound' AND u.currency = l.currency AND lower(coalesce(u.counterparty, '')) = lower(coalesce(l.counterparty, ''))
        AND abs(u.value_date - l.value_date) <= 4 AND l.amount_minor <= u.amount_minor) WHERE place <= 20"""),
    ("combos", """SELECT a.deposit_id, 2 AS size, a.place AS p1, b.place AS p2, 0 AS p3, 0 AS p4, a.line_id || ',' || b.line_id AS line_ids
          FROM pool a JOIN pool b ON a.deposit_id = b.deposit_id AND a.place < b.place WHERE a.line + b.line = a.deposit
        UNION ALL SELECT a.deposit_id, 3, a.place, b.place, c.place, 0, a.line_id || ',' || b.line_id || ',' || c.line_id
          FROM pool a JOIN pool b ON a.deposit_id = b.deposit_id AND a.place < b.place JOIN pool c ON a.deposit_id = c.deposit_id AND b.place < c.place WHERE a.line + b.line + c.line = a.deposit
        UNION ALL SELECT a.deposit_id, 4, a.place, b.place, c.place, d.place, a.line_id || ',' || b.line_id || ',' || c.line_id || ',' || d.line_id
          FROM pool a JOIN pool b ON a.deposit_id = b.deposit_id AND a.place < b.place JOIN pool c ON a.deposit_id = c.deposit_id AND b.place < c.place
          JOIN pool d ON a.deposit_id = d.deposit_id AND c.place < d.place WHERE a.line + b.line + c.line + d.line = a.deposit"""),
    ("groupings", """SELECT deposit_id, CAST(r AS INTEGER) AS rank, CAST(size AS INTEGER) AS size, line_ids,
        CAST(round(greatest(0.4, (CASE WHEN n = 1 THEN 0.75 ELSE 0.6 END) - 0.05 * r), 2) AS DOUBLE) AS confidence FROM (
        SELECT *, count(*) OVER (PARTITION BY deposit_id) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY deposit_id ORDER BY size, p1, p2, p3, p4) - 1 AS r FROM combos) WHERE r < 5)"""),
    ("offered", "SELECT deposit_id AS txn_id, count(*) AS n FROM groupings GROUP BY 1"),
    ("e1", "SELECT 'one_to_many' AS category, 'one_to_many_unresolved' AS type, 'medium' AS severity, u.*, n AS candidates FROM unresolved u JOIN offered USING (txn_id)"),
    ("e2", "SELECT 'duplicate' AS category, 'duplicate_suspected' AS type, 'high' AS severity, u.*, 1 AS candidates FROM unresolved u WHERE txn_id IN (SELECT primary_id FROM anomalies) AND txn_id NOT IN (SELECT txn_id FROM e1)"),
    ("e3", "SELECT 'fx' AS category, 'fx_unresolved' AS type, 'medium' AS severity, u.*, 0 AS candidates FROM unresolved u WHERE source = 'gl' AND currency <> 'INR'"),
    ("e4", "SELECT 'settled_never_received' AS category, 'no_counterpart' AS type, 'high' AS severity, u.*, 0 AS candidates FROM unbanked u"),
    ("e5", """SELECT 'no_counterpart' AS category, 'no_counterpart' AS type, 'high' AS severity, u.*, 0 AS candidates FROM unresolved u
        WHERE txn_id NOT IN (SELECT txn_id FROM e1 UNION ALL SELECT txn_id FROM e2 UNION ALL SELECT txn_id FROM e3 UNION ALL SELECT txn_id FROM e4)"""),
    ("found", """SELECT category, type, severity, txn_id AS subject_id, source, direction, amount_minor AS at_risk, currency, CAST(candidates AS BIGINT) AS candidates
        FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e5)"""),
    ("truth", """SELECT DISTINCT k AS event_id, case_name AS case_type,
        CASE WHEN case_name IN ('one_to_many_no_utr', 'duplicate_double_pay', 'break_no_bank', 'break_no_gl') THEN 'exception' WHEN case_name = 'duplicate_same_ref' THEN 'deduped' ELSE 'matched' END AS handling,
        source, external_ref FROM feed JOIN ord ON k = seq // 64
        UNION SELECT seq // 64, 'outflow_recurring', 'matched', source, external_ref FROM feed WHERE seq // 64 > 1000000000000"""),
    ("events", """SELECT event_id, case_type, handling, coalesce(bool_and(r.txn_id IN (SELECT txn_id FROM edges)), false) AS whole, coalesce(bool_or(source = 'bank' AND r.txn_id IN (SELECT txn_id FROM edges)), false) AS banked, coalesce(bool_or(r.txn_id IN (SELECT subject_id FROM found)), false) AS flagged
        FROM truth JOIN rows r USING (source, external_ref) GROUP BY 1, 2, 3"""),
    ("wrong", """SELECT match_id, pass FROM edges JOIN (SELECT txn_id, event_id FROM rows JOIN truth USING (source, external_ref)) USING (txn_id) GROUP BY 1, 2 HAVING min(event_id) <> max(event_id)"""),
]


def chain(select: str, feed: str | None = None) -> str:
    """``select`` after the whole chain, over the workload or another ``feed``; DuckDB plans only what it needs."""
    return f"WITH {feed or workload.feed_sql()}, " + ", ".join(f"{n} AS ({q})" for n, q in _CHAIN) + f" {select}"


def _replay(name: str, near: str) -> str:
    """CTEs that replay ordered claims over ``near`` (left_id, right_id, seq), entry after entry of each group of rows that may meet."""
    return f"""{name}_n AS (SELECT *, dense_rank() OVER (ORDER BY seq, left_id) AS place FROM {near}),
        {name}_r AS (SELECT CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS left_id, CAST(NULL AS VARCHAR) AS right_id
          UNION ALL SELECT r.place + 1, CASE WHEN len(f.free) = 1 THEN list_append(r.taken, f.free[1]) ELSE r.taken END, CASE WHEN len(f.free) = 1 THEN f.left_id END, CASE WHEN len(f.free) = 1 THEN f.free[1] END
          FROM {name}_r r JOIN (SELECT place, min(left_id) AS left_id, list(right_id) AS rights FROM {name}_n GROUP BY 1) n ON n.place = r.place + 1,
          LATERAL (SELECT n.left_id, list_filter(n.rights, lambda x: NOT list_contains(r.taken, x)) AS free) f)"""


def greedy(select: str) -> str:
    """``select`` after the claims in list order, one entry after the other."""
    near1 = """(SELECT l.txn_id AS left_id, b.txn_id AS right_id, l.seq FROM free1 l JOIN free1 b ON l.source = 'gl' AND b.source = 'bank' AND l.currency = b.currency AND l.direction = b.direction
        AND l.amount_minor = b.amount_minor AND l.party = b.party AND b.value_date - l.value_date BETWEEN 0 AND 2)"""
    near2 = """(SELECT l.txn_id AS left_id, b.txn_id AS right_id, l.seq FROM gfree l JOIN gfree b ON l.source = 'gl' AND l.currency <> 'INR' AND b.source = 'bank' AND b.currency = 'INR' AND l.direction = b.direction
        AND b.value_date - l.value_date BETWEEN 0 AND 2 AND abs(b.amount_minor - l.expected) <= 100)"""
    chained = ", ".join(f"{n} AS ({q})" for n, q in _CHAIN if n in ("rows", "j1", "j2g", "exact", "free1"))
    later = dict(_CHAIN)["free2"].replace("SELECT left_id FROM j3 UNION ALL SELECT right_id FROM j3", "SELECT left_id FROM g1 UNION ALL SELECT right_id FROM g1")
    # A pair whose two ends have no other candidate is claimed whatever the order; only the rest is replayed.
    sole = lambda near: f"(SELECT *, count(*) OVER (PARTITION BY left_id) = 1 AND count(*) OVER (PARTITION BY right_id) = 1 AS sole FROM {near})"
    return f"""WITH RECURSIVE {workload.feed_sql()}, {chained}, w1 AS MATERIALIZED {sole(near1)}, {_replay("p1", "(SELECT left_id, right_id, seq FROM w1 WHERE NOT sole)")},
        g1 AS MATERIALIZED (SELECT left_id, right_id FROM w1 WHERE sole UNION ALL SELECT left_id, right_id FROM p1_r WHERE left_id IS NOT NULL), gfree AS MATERIALIZED ({later}),
        w2 AS MATERIALIZED {sole(near2)}, {_replay("p2", "(SELECT left_id, right_id, seq FROM w2 WHERE NOT sole)")},
        claimed AS (SELECT 'economic_pair' AS pass, left_id, right_id FROM g1 UNION ALL SELECT 'fx', left_id, right_id FROM w2 WHERE sole UNION ALL SELECT 'fx', left_id, right_id FROM p2_r WHERE left_id IS NOT NULL)
        {select}"""


SPARSE = """
WITH cash AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice * 100) AS BIGINT) AS amt, (CAST(o_orderkey AS BIGINT) * 7919) % 200 >= 100 AS out FROM orders),
daily AS (SELECT day, sum(CASE WHEN NOT out THEN amt ELSE 0 END) AS inflow, sum(CASE WHEN out THEN amt ELSE 0 END) AS outflow FROM cash GROUP BY 1),
flows AS (SELECT g.day, CAST(coalesce(inflow, 0) AS BIGINT) AS inflow, CAST(coalesce(outflow, 0) AS BIGINT) AS outflow, CAST(coalesce(inflow, 0) - coalesce(outflow, 0) AS BIGINT) AS net,
          coalesce(inflow, 0) = 0 AND coalesce(outflow, 0) = 0 AS quiet
          FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS DATE) AS day) g LEFT JOIN daily USING (day)),
idx AS (SELECT row_number() OVER (ORDER BY day) - 1 AS idx, net FROM flows)
"""


def _draw(n: str, sim: str = "sim", step: str = "step", seed: int = 7) -> str:
    x = f"(({sim} * 1000003 + {step} * 100000007 + {seed * 7919 + 12345}) % 2147483647)"
    lets, cur = [], x
    for i in range(3):
        lets.append(cur)
        cur = f"((x{i} * x{i} + {1013904223 + i}) % 2147483647)"
    # Nested so that each round is named once.
    q = f"SELECT *, {x} AS x0 FROM grid"
    for i in range(3):
        q = f"SELECT *, (x{i} * x{i} + {1013904223 + i}) % 2147483647 AS x{i + 1} FROM ({q})"
    return f"SELECT *, x3 % {n} AS idx FROM ({q})"


FORECAST = SPARSE + """,
grid AS (SELECT s.sim, t.step FROM (SELECT unnest(generate_series(0, 1999)) AS sim) s, (SELECT unnest(generate_series(1, 45)) AS step) t),
drawn AS (SELECT d.sim, d.step, i.net FROM (""" + _draw("(SELECT count(*) FROM idx)") + """) d JOIN idx i USING (idx)),
paths AS (SELECT sim, step, sum(net) OVER (PARTITION BY sim ORDER BY step) AS path FROM drawn),
ranked AS (SELECT step, path, row_number() OVER (PARTITION BY step ORDER BY path) AS r FROM paths),
bands AS (SELECT step, max(path) FILTER (r = 200) AS p10, max(path) FILTER (r = 1000) AS p50, max(path) FILTER (r = 1800) AS p90 FROM ranked GROUP BY step),
months AS (SELECT unnest(generate_series(date_trunc('month', (SELECT max(day) FROM flows)), (SELECT max(day) + 45 FROM flows), INTERVAL 1 MONTH)) AS m),
due AS (SELECT CAST(m + to_days(dom - 1) AS DATE) AS day, sum(amount) AS due FROM months, (VALUES (1, 185000000), (5, 22500000), (12, 4800000)) AS t(dom, amount) GROUP BY 1),
named AS (SELECT (SELECT max(day) FROM flows) + CAST(step AS INTEGER) AS day, p10, p50, p90, coalesce(due, 0) AS booked FROM bands LEFT JOIN due ON due.day = (SELECT max(day) FROM flows) + CAST(step AS INTEGER)),
band AS (SELECT day, CAST(base + p10 AS BIGINT) AS p10, CAST(base + p50 AS BIGINT) AS p50, CAST(base + p90 AS BIGINT) AS p90, CAST(booked AS BIGINT) AS booked_minor, base + p10 < 100000000 AS shortfall
         FROM (SELECT *, 500000000 - sum(booked) OVER (ORDER BY day) AS base FROM named))
"""

BACKTEST = SPARSE + """,
cuts AS (SELECT unnest(generate_series(60, (SELECT count(*) FROM idx) - 30, 7)) AS cutoff),
grid AS (SELECT cutoff, sim, step FROM cuts, (SELECT unnest(generate_series(0, 499)) AS sim), (SELECT unnest(generate_series(1, 30)) AS step)),
drawn AS (SELECT d.cutoff, d.sim, d.step, i.net FROM (""" + _draw("cutoff") + """) d JOIN idx i USING (idx)),
ends AS (SELECT cutoff, horizon, sim, sum(net) AS path FROM drawn JOIN (VALUES (7), (14), (30)) AS t(horizon) ON step <= horizon GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cutoff, horizon ORDER BY path) AS r FROM ends),
bands AS (SELECT cutoff, horizon, max(path) FILTER (r = 50) AS p10, max(path) FILTER (r = 250) AS p50, max(path) FILTER (r = 450) AS p90 FROM ranked GROUP BY 1, 2),
scored AS (SELECT b.*, (SELECT sum(net) FROM idx WHERE idx >= cutoff AND idx < cutoff + horizon) AS actual FROM bands b)
SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS samples, CAST(round_even(avg(abs(p50 - actual)), 0) AS BIGINT) AS mae,
       round(avg(CASE WHEN actual <> 0 THEN abs(p50 - actual) / abs(actual) END), 6) AS mape, round(avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
       abs(round(avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 6) - 0.8) <= 0.2 + 1e-9 AS calibrated
FROM scored GROUP BY horizon
"""


def told(i: int) -> str:
    """The reason (0) or suggestion (1) of an exception."""
    cases = " ".join(f"WHEN '{k}' THEN {'candidates || chr(32) || ' if k == 'one_to_many' and i == 0 else ''}'{v[i]}'" for k, v in REASONS.items())
    return f"CASE CASE WHEN category = 'no_counterpart' THEN category || ' ' || direction ELSE category END {cases} END"


def _line(phase: int, decision: str, actor: str, subject: str | None, reason: str, more: str = "''") -> str:
    subjects = f"'[\"' || {subject} || '\"]'" if subject else "'[]'"
    return f"""'{{"phase":{phase},"decision":"{decision}","actor":"' || {actor} || '","subjects":' || {subjects} || ',"reason":"' || {reason} || '"' || {more} || '}}'"""


_REJECTED = [
    ("gateway", "", "missing_reference"), ("gateway", "pay_x1", "unknown_status"), ("gateway", "pay_x2", "unknown_currency"), ("gateway", "pay_x3", "fee_above_amount"),
    ("settlement", "pout_x1", "bad_amount"), ("settlement", "pout_x2", "bad_date"), ("settlement", "", "missing_reference"),
    ("bank", "", "missing_reference"), ("bank", "UTR_x1", "debit_and_credit"), ("bank", "UTR_x2", "bad_date"), ("bank", "UTR_x3", "debit_and_credit"),
    ("gl", "v_x1", "compound_entry"), ("gl", "v_x2", "empty_entry"), ("gl", "v_x3", "negative_amount"), ("gl", "v_x4", "unknown_status"),
]
_VALUES = ", ".join(f"('{s}', '{r}', '{why}')" for s, r, why in _REJECTED)
AUDIT_LINES = " UNION ALL ".join([
    "SELECT " + _line(0, "batch_started", "'pipeline'", None, "((SELECT count(*) FROM feed) + 16) || ' rows received'") + " AS value",
    "SELECT " + _line(1, "record_ingested", "'pipeline'", None, "(SELECT count(*) FROM rows) || ' rows accepted'"),
    "SELECT " + _line(2, "record_deduplicated", "'pipeline'", None, "((SELECT count(*) FROM feed) - (SELECT count(*) FROM rows)) || ' re-imports dropped'"),
    "SELECT " + _line(3, "record_rejected", "'connector.' || s", "s || ':' || r", "why") + f" FROM (VALUES {_VALUES}) AS t(s, r, why)",
    "SELECT " + _line(4, "match_made", "'matcher.' || tier", "txn_id", "m.pass || ' of ' || (n_left + n_right) || ' rows'", """',"confidence":' || confidence || ',"tier":"' || tier || '"'""") + " FROM matches m JOIN edges e ON m.match_id = e.match_id AND side = 'right'",
    "SELECT " + _line(5, "match_refused", "'exception.' || category", "subject_id", "candidates || ' candidates, none certain'") + " FROM found WHERE candidates > 0",
    "SELECT " + _line(6, "exception_raised", "'exception.' || category", "subject_id", "category", """',"amount_minor":' || at_risk || ',"currency":"' || currency || '"'""") + " FROM found",
    "SELECT " + _line(7, "batch_completed", "'pipeline'", None, "(SELECT count(DISTINCT txn_id) FROM edges) || ' records matched, ' || (SELECT count(*) FROM found) || ' exceptions, ' || (SELECT sum(at_risk) FROM found) || ' minor units at risk'"),
])

#: This engine has no lookahead: the two phrases that are no names are set aside where nothing follows them.
REDACTED = r"""SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '%s', '[EMAIL]', 'g'), '%s', '[PHONE]', 'g'), '%s', '[ACCT:\1]', 'g'),
    '\bNEFT (CR|DR)\b', 'neft~\1', 'g'), '\b[A-Z][A-Z]+(?:\s+[A-Z][A-Z]+)+\b', '[NAME]', 'g'), 'neft~', 'NEFT ') AS text FROM documents""" % (text.EMAIL, text.PHONE, text.ACCOUNT)  # fmt: skip
