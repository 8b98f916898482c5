"""Independent SQL (DuckDB dialect) for every registered query.

Written from the operator definitions, not generated from the Spark plans.
Each string runs against the pre-registered views (orders, events, lineitem,
customer, documents, conversations, ...).
"""

from __future__ import annotations

# --- ledger views (same definitions as tallyspark.sources.tables) ----------

ORDERS_LEDGER = """
ledger AS (
  SELECT o_custkey AS account_id, o_orderkey AS txn_id, o_orderdate AS "Date",
         coalesce('Order ' || CAST(o_orderkey AS VARCHAR), '') AS Description,
         coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END, 0.0) AS Amount,
         coalesce(o_orderpriority, 'Uncategorized') AS Category,
         CASE WHEN coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END, 0.0) >= 0
              THEN 'Credit' ELSE 'Debit' END AS Type
  FROM orders)"""

EVENTS_LEDGER = """
ledger AS (
  SELECT user_id AS account_id, event_id AS txn_id, ts AS "Date",
         coalesce(upper(left(event_type, 1)) || lower(substr(event_type, 2)) || ' event '
                  || CAST(event_id AS VARCHAR), '') AS Description,
         coalesce(CASE WHEN event_type = 'purchase' THEN -value ELSE value END, 0.0) AS Amount,
         coalesce(event_type, 'Uncategorized') AS Category,
         CASE WHEN coalesce(CASE WHEN event_type = 'purchase' THEN -value ELSE value END, 0.0) >= 0
              THEN 'Credit' ELSE 'Debit' END AS Type
  FROM events)"""

LINEITEM_LEDGER = """
ledger AS (
  SELECT o.o_custkey AS account_id,
         concat_ws('-', l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber) AS txn_id,
         l.l_shipdate AS "Date",
         'Line ' || concat_ws('-', l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber) AS Description,
         coalesce(CASE WHEN l.l_returnflag = 'R' THEN l.l_extendedprice ELSE -l.l_extendedprice END, 0.0) AS Amount,
         coalesce('Flag ' || l.l_returnflag, 'Uncategorized') AS Category,
         CASE WHEN coalesce(CASE WHEN l.l_returnflag = 'R' THEN l.l_extendedprice ELSE -l.l_extendedprice END, 0.0) >= 0
              THEN 'Credit' ELSE 'Debit' END AS Type
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


HOT_LINEITEM_LEDGER = LINEITEM_LEDGER.replace(
    "SELECT o.o_custkey AS account_id,",
    "SELECT CASE WHEN l.l_orderkey % 3 = 0 THEN CAST(-1 AS BIGINT) ELSE o.o_custkey END AS account_id,")


CREDIT_SUM = "coalesce(sum(CASE WHEN Type = 'Credit' THEN CAST(Amount AS DECIMAL(38,10)) END), 0)"
DEBIT_SUM = "abs(coalesce(sum(CASE WHEN Type = 'Debit' THEN CAST(Amount AS DECIMAL(38,10)) END), 0))"


def cents(expr: str) -> str:
    return f"CAST(round({expr}, 2) AS DOUBLE)"


def pct(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den} * 100.0 ELSE 0.0 END"


# --- per-account aggregates ----------------------------------------------

def kpi_summary(ledger: str) -> str:
    return f"""WITH {ledger},
s AS (SELECT account_id, {CREDIT_SUM} AS inc, {DEBIT_SUM} AS exp FROM ledger GROUP BY account_id),
k AS (SELECT account_id, {cents('inc')} AS total_income, {cents('exp')} AS total_expenses,
             {cents('inc - exp')} AS net_savings FROM s)
SELECT account_id, total_income, total_expenses, net_savings,
       {pct('net_savings', 'total_income')} AS savings_rate,
       CASE WHEN {pct('net_savings', 'total_income')} >= 20 THEN 'green' ELSE 'blue' END AS rate_band
FROM k"""


def monthly_summary(ledger: str) -> str:
    return f"""WITH {ledger},
s AS (SELECT account_id, CAST(date_trunc('month', "Date") AS DATE) AS MonthDate,
             {CREDIT_SUM} AS inc, {DEBIT_SUM} AS exp
      FROM ledger WHERE "Date" IS NOT NULL GROUP BY ALL),
m AS (SELECT account_id, strftime(MonthDate, '%Y-%m') AS Month, {cents('inc')} AS Income,
             {cents('exp')} AS Expenses, {cents('inc - exp')} AS Savings FROM s)
SELECT *, {pct('Savings', 'Income')} AS SavingsRate FROM m"""


def monthly_series(ledger: str) -> str:
    return f"""WITH {ledger},
m AS (SELECT account_id, CAST(date_trunc('month', "Date") AS DATE) AS MonthDate,
       {cents(CREDIT_SUM)} AS Income, {cents(DEBIT_SUM)} AS Expenses,
       {cents(CREDIT_SUM + ' - ' + DEBIT_SUM)} AS Savings
FROM ledger WHERE "Date" IS NOT NULL GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY MonthDate) AS INTEGER) AS position FROM m"""


def category_expenses(ledger: str) -> str:
    return f"""WITH {ledger}
SELECT account_id, Category, {cents('abs(sum(CAST(Amount AS DECIMAL(38,10))))')} AS Amount
FROM ledger WHERE Type = 'Debit' GROUP BY ALL"""


def category_share(ledger: str) -> str:
    return f"""WITH {ledger},
c AS (SELECT account_id, Category, abs(sum(CAST(Amount AS DECIMAL(38,10)))) AS amt
      FROM ledger WHERE Type = 'Debit' GROUP BY ALL),
t AS (SELECT account_id, Category, {cents('amt')} AS Amount,
             {cents('sum(amt) OVER (PARTITION BY account_id)')} AS total_expenses FROM c)
SELECT *, {pct('Amount', 'total_expenses')} AS share_pct FROM t"""


def default_contribution(ledger: str) -> str:
    return f"""WITH {ledger},
s AS (SELECT account_id, {CREDIT_SUM} AS inc, {DEBIT_SUM} AS exp,
             count(DISTINCT date_trunc('month', "Date")) AS n_months
      FROM ledger GROUP BY account_id)
SELECT account_id, {cents('inc - exp')} AS net_savings, n_months,
       CASE WHEN n_months > 0 THEN greatest(100.0, {cents('inc - exp')} / n_months) ELSE 500.0 END
         AS monthly_contribution
FROM s"""


def latest_month(ledger: str) -> str:
    return f"""WITH {ledger},
m AS ({monthly_series_body()})
SELECT account_id, max(MonthDate) AS last_month, arg_max(Income, MonthDate) AS Income,
       arg_max(Expenses, MonthDate) AS Expenses, arg_max(Savings, MonthDate) AS Savings,
       count(*) AS n_months
FROM m GROUP BY account_id"""


def monthly_series_body() -> str:
    return f"""SELECT account_id, CAST(date_trunc('month', "Date") AS DATE) AS MonthDate,
       {cents(CREDIT_SUM)} AS Income, {cents(DEBIT_SUM)} AS Expenses,
       {cents(CREDIT_SUM + ' - ' + DEBIT_SUM)} AS Savings
FROM ledger WHERE "Date" IS NOT NULL GROUP BY ALL"""


# The four columns of a line item's key, as numbers.
LINE_KEY = ", ".join(f"CAST(split_part(txn_id, '-', {i}) AS BIGINT)" for i in range(1, 5))


def top_transactions(ledger: str, k: int = 5, tie: str = "txn_id") -> str:
    return f"""WITH {ledger},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY account_id
                                   ORDER BY abs(Amount) DESC, "Date" DESC NULLS LAST, {tie}) AS INTEGER) AS rank
      FROM ledger)
SELECT * FROM r WHERE rank <= {k}"""


def debits_only(ledger: str) -> str:
    return f"WITH {ledger}\nSELECT * FROM ledger WHERE Type = 'Debit'"


def ledger_rows(ledger: str) -> str:
    return f"WITH {ledger}\nSELECT * FROM ledger"


def ledger_newest_first(ledger: str) -> str:
    return (f"WITH {ledger}\nSELECT *, coalesce(-epoch_us(CAST(\"Date\" AS TIMESTAMP)), 9223372036854775807) "
            "AS sort_key FROM ledger")


def monthly_cash_flow_long(ledger: str) -> str:
    return f"""WITH {ledger},
m AS (SELECT account_id, strftime(date_trunc('month', "Date"), '%Y-%m') AS Month,
             {cents(CREDIT_SUM)} AS Income, {cents(DEBIT_SUM)} AS Expenses
      FROM ledger WHERE "Date" IS NOT NULL GROUP BY ALL)
SELECT account_id, Month, 'Income' AS variable, Income AS value FROM m
UNION ALL
SELECT account_id, Month, 'Expenses' AS variable, Expenses AS value FROM m"""


def search_transactions(ledger: str, pattern: str) -> str:
    q = pattern.replace("'", "''")
    return f"""WITH {ledger}
SELECT * FROM ledger
WHERE regexp_matches(Description, '{q}', 'i') OR regexp_matches(Category, '{q}', 'i')
   OR regexp_matches(CAST(Amount AS VARCHAR), '{q}')"""


# --- forecast -------------------------------------------------------------

def hud(num: str, den: str) -> str:
    """round(num / den) half away from zero on integers; null unless den > 0."""
    return (f"(CASE WHEN NOT ({den} > 0) THEN NULL WHEN ({num}) >= 0 "
            f"THEN (2 * ({num}) + {den}) // (2 * {den}) "
            f"ELSE -((2 * (-({num})) + {den}) // (2 * {den})) END)")


DAYNUM = "CAST(date_diff('day', DATE '1970-01-01', {d}) AS HUGEINT)"


def _trend_ctes(ledger: str) -> str:
    x = DAYNUM.format(d="MonthDate")
    return f"""WITH {ledger},
m AS (SELECT account_id, CAST(date_trunc('month', "Date") AS DATE) AS MonthDate,
             CAST(round({CREDIT_SUM}, 2) * 100 AS HUGEINT) AS inc_c,
             CAST(round({DEBIT_SUM}, 2) * 100 AS HUGEINT) AS exp_c
      FROM ledger WHERE "Date" IS NOT NULL GROUP BY ALL),
mx AS (SELECT *, {x} AS x FROM m),
s AS (SELECT account_id, CAST(count(*) AS HUGEINT) AS n, sum(x) AS sx, sum(x * x) AS sxx,
             sum(inc_c) AS sy_inc, sum(x * inc_c) AS sxy_inc,
             sum(exp_c) AS sy_exp, sum(x * exp_c) AS sxy_exp,
             max(MonthDate) AS last_month, arg_max(inc_c, MonthDate) AS last_inc_c,
             arg_max(exp_c, MonthDate) AS last_exp_c
      FROM mx GROUP BY account_id),
sd AS (SELECT *, n * sxx - sx * sx AS D, n * sxy_inc - sx * sy_inc AS N_inc,
              n * sxy_exp - sx * sy_exp AS N_exp FROM s)"""


def fit_trend(ledger: str) -> str:
    return _trend_ctes(ledger) + f"""
SELECT account_id, CAST(n AS BIGINT) AS n_months, last_month,
       CASE WHEN D > 0 THEN CAST({hud('N_inc * 10000', 'D')} AS DOUBLE) / 1e6 END AS income_slope_per_day,
       CASE WHEN D > 0 THEN CAST({hud('N_exp * 10000', 'D')} AS DOUBLE) / 1e6 END AS expenses_slope_per_day
FROM sd"""


def _projection_ctes(ledger: str, h: int) -> str:
    xf = DAYNUM.format(d="MonthDate")
    return _trend_ctes(ledger) + f""",
p AS (SELECT sd.*, t.step, CAST(last_month + to_months(CAST(t.step AS INTEGER)) AS DATE) AS MonthDate
      FROM sd CROSS JOIN (SELECT range AS step FROM range(1, {h + 1})) t),
q AS (SELECT *, n * D AS Q, sy_inc * D + N_inc * (n * {xf} - sx) AS P_inc,
             sy_exp * D + N_exp * (n * {xf} - sx) AS P_exp FROM p),
f AS (SELECT account_id, step, MonthDate,
             CASE WHEN n >= 2 THEN greatest(0, {hud('P_inc', 'Q')}) ELSE last_inc_c END AS inc_c,
             CASE WHEN n >= 2 THEN greatest(0, {hud('P_exp', 'Q')})
                  ELSE {hud('last_exp_c * (1000 - 15 * step)', '1000')} END AS exp_c
      FROM q),
proj AS (SELECT account_id, MonthDate, CAST(inc_c AS DOUBLE) / 100.0 AS Income,
                CAST(exp_c AS DOUBLE) / 100.0 AS Expenses,
                CAST(inc_c - exp_c AS DOUBLE) / 100.0 AS Savings, true AS IsProjected FROM f),
hist AS (SELECT account_id, MonthDate, CAST(inc_c AS DOUBLE) / 100.0 AS Income,
                CAST(exp_c AS DOUBLE) / 100.0 AS Expenses,
                CAST(inc_c - exp_c AS DOUBLE) / 100.0 AS Savings, false AS IsProjected FROM m),
fc AS (SELECT * FROM hist UNION ALL SELECT * FROM proj)"""


def forecast(ledger: str, h: int) -> str:
    return _projection_ctes(ledger, h) + "\nSELECT * FROM fc"


def projection_split(ledger: str, h: int) -> str:
    return _projection_ctes(ledger, h) + "\nSELECT * FROM fc WHERE IsProjected"


def projection_trend_line(ledger: str, h: int) -> str:
    return _projection_ctes(ledger, h) + """
SELECT account_id, MonthDate, Income, Expenses, Savings, IsProjected FROM (
  SELECT *, max(CASE WHEN NOT IsProjected THEN MonthDate END) OVER (PARTITION BY account_id) AS lh FROM fc)
WHERE IsProjected OR MonthDate = lh"""


def forecast_horizon(ledger: str, h: int) -> str:
    return f"""WITH {ledger},
l AS (SELECT account_id, CAST(date_trunc('month', max("Date")) AS DATE) AS last_month
      FROM ledger WHERE "Date" IS NOT NULL GROUP BY account_id)
SELECT account_id, CAST(t.step AS INTEGER) AS step,
       CAST(last_month + to_months(CAST(t.step AS INTEGER)) AS DATE) AS MonthDate
FROM l CROSS JOIN (SELECT range AS step FROM range(1, {h + 1})) t"""


# --- goals ------------------------------------------------------------------

GOALS = """goals AS (
  SELECT c_custkey AS account_id, 'Emergency Fund' AS goal_name, CAST(5000.0 AS DOUBLE) AS target_amount,
         c_acctbal AS current_savings, CAST(NULL AS DOUBLE) AS monthly_contribution FROM customer)"""


def _goal_ctes(ledger: str) -> str:
    return f"""WITH {ledger}, {GOALS},
s AS (SELECT account_id, {CREDIT_SUM} AS inc, {DEBIT_SUM} AS exp,
             count(DISTINCT date_trunc('month', "Date")) AS n_months FROM ledger GROUP BY account_id),
dc AS (SELECT account_id, CASE WHEN n_months > 0 THEN greatest(100.0, {cents('inc - exp')} / n_months)
                          ELSE 500.0 END AS dflt FROM s),
j AS (SELECT g.*, coalesce(g.monthly_contribution, dc.dflt, 500.0) AS eff FROM goals g
      LEFT JOIN dc ON g.account_id = dc.account_id),
r AS (SELECT *, CASE WHEN target_amount IS NULL OR target_amount < 100 THEN 'target_amount below 100'
                     WHEN current_savings IS NULL OR current_savings < 0 THEN 'current_savings below 0'
                     WHEN eff < 10 THEN 'monthly_contribution below 10' END AS reject_reason FROM j)"""


def goal_validation(ledger: str) -> str:
    return _goal_ctes(ledger) + """
SELECT account_id, goal_name, target_amount, current_savings, monthly_contribution,
       eff AS effective_monthly_contribution, reject_reason FROM r WHERE reject_reason IS NOT NULL"""


def savings_goal(ledger: str, as_of: str) -> str:
    return _goal_ctes(ledger) + f""",
v AS (SELECT account_id, goal_name, target_amount, current_savings, eff AS monthly_contribution,
             target_amount - current_savings AS remaining,
             (target_amount - current_savings) <= 0 AS achieved,
             CASE WHEN NOT ((target_amount - current_savings) <= 0)
                  THEN (target_amount - current_savings) / eff END AS months_required
      FROM r WHERE reject_reason IS NULL),
w AS (SELECT *, CAST(DATE '{as_of}' + to_months(CAST(ceil(months_required) AS INTEGER)) AS DATE) AS target_date
      FROM v)
SELECT *, {money_txt('remaining')} AS remaining_text, format('{{:.1f}}', months_required) AS months_required_text,
       strftime(target_date, '%B %Y') AS target_month FROM w"""


# --- statement ingest -------------------------------------------------------

RAW_STATEMENT = """raw AS (
  SELECT 'statement_' || CAST(o_custkey AS VARCHAR) || '.csv' AS source_file, o_orderkey AS line_no,
         o_custkey AS account_id,
         CASE WHEN o_orderkey % 29 = 3 THEN 'N/A' ELSE
         CASE (CASE WHEN o_custkey % 97 = 5 AND o_orderstatus = 'P' THEN 0 ELSE o_custkey % 9 END)
              WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
              WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%b %-d, %Y')
              WHEN 4 THEN strftime(o_orderdate, '%-m/%-d/%y') WHEN 5 THEN strftime(o_orderdate, '%-d %b %Y')
              WHEN 6 THEN strftime(o_orderdate, '%m-%d-%Y') WHEN 7 THEN strftime(o_orderdate, '%m/%d/%Y %H:%M')
              ELSE strftime(o_orderdate, '%d-%m-%Y') END END AS raw_date,
         'Payment ' || CAST(o_orderkey AS VARCHAR) AS raw_desc,
         CASE o_orderkey % 5
              WHEN 0 THEN '$' || format('{:,.2f}', CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END)
              WHEN 1 THEN '€' || format('{:,.2f}', CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END)
              WHEN 2 THEN (CASE WHEN o_orderstatus = 'F' THEN '£' ELSE '-£' END) || format('{:,.2f}', o_totalprice)
              WHEN 3 THEN '(' || format('{:,.2f}', o_totalprice) || ')'
              ELSE 'n/a' END AS raw_amount,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'N/A' ELSE o_orderpriority END AS raw_cat
  FROM orders)"""

MISSING = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
           "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")

FORMATS_SQL = [("iso", "try_cast(trim(d) AS TIMESTAMP)"),
               ("M/d/yyyy", "try_strptime(trim(d), '%m/%d/%Y')"),
               ("d/M/yyyy", "try_strptime(trim(d), '%d/%m/%Y')"),
               ("MMM d, yyyy", "try_strptime(trim(d), '%b %d, %Y')"),
               ("yyyyMMdd", "try_strptime(trim(d), '%Y%m%d')"),
               ("yyyy/M/d", "try_strptime(trim(d), '%Y/%m/%d')"),
               ("d.M.yyyy", "try_strptime(trim(d), '%d.%m.%Y')"),
               ("d-MMM-yyyy", "try_strptime(trim(d), '%d-%b-%Y')"),
               ("MMMM d, yyyy", "try_strptime(trim(d), '%B %d, %Y')"),
               ("M/d/yy", "try_strptime(trim(d), '%m/%d/%y')"),
               ("d/M/yy", "try_strptime(trim(d), '%d/%m/%y')"),
               ("M/d/yyyy H:mm", "try_strptime(trim(d), '%m/%d/%Y %H:%M')"),
               ("d/M/yyyy H:mm", "try_strptime(trim(d), '%d/%m/%Y %H:%M')"),
               ("M/d/yyyy H:mm:ss", "try_strptime(trim(d), '%m/%d/%Y %H:%M:%S')"),
               ("d/M/yyyy H:mm:ss", "try_strptime(trim(d), '%d/%m/%Y %H:%M:%S')"),
               ("d MMM yyyy", "try_strptime(trim(d), '%d %b %Y')"),
               ("d MMMM yyyy", "try_strptime(trim(d), '%d %B %Y')"),
               ("M-d-yyyy", "try_strptime(trim(d), '%m-%d-%Y')"),
               ("d-M-yyyy", "try_strptime(trim(d), '%d-%m-%Y')")]

# strptime's %Y also takes years of other lengths; statements write four digits.
FORMATS_SQL = [(f, f"CASE WHEN regexp_matches(trim(d), '(^|[^0-9])[0-9]{{4}}($|[^0-9])') THEN {e} END"
                if "%Y" in e and "%Y%m" not in e else e) for f, e in FORMATS_SQL]

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _statement_ctes() -> str:
    parsed = ", ".join(f"{e} AS p{i}" for i, (_, e) in enumerate(FORMATS_SQL))
    fails = " ".join(f"WHEN sum(CASE WHEN d IS NOT NULL AND p{i} IS NULL THEN 1 ELSE 0 END) = 0 THEN {i}"
                     for i in range(len(FORMATS_SQL)))
    date = " ".join(f"WHEN {i} THEN p{i}" for i in range(len(FORMATS_SQL)))
    label = " ".join(f"WHEN {i} THEN '{f}'" for i, (f, _) in enumerate(FORMATS_SQL))
    return f"""WITH {RAW_STATEMENT},
nt AS (SELECT *, CASE WHEN raw_date IN ({MISSING}) THEN NULL ELSE raw_date END AS d,
              CASE WHEN raw_desc IN ({MISSING}) THEN NULL ELSE raw_desc END AS ds,
              regexp_replace(CASE WHEN raw_amount IN ({MISSING}) THEN NULL ELSE raw_amount END,
                             '[$€£,]', '', 'g') AS a,
              CASE WHEN raw_cat IN ({MISSING}) THEN NULL ELSE raw_cat END AS c FROM raw),
p AS (SELECT *, {parsed} FROM nt),
e AS (SELECT source_file, CASE {fails} END AS fmt_idx FROM p GROUP BY source_file),
n AS (SELECT p.*, e.fmt_idx,
             coalesce(CASE WHEN regexp_matches(a, '{NUMERIC}') THEN try_cast(a AS DOUBLE) END, 0.0) AS amt
      FROM p LEFT JOIN e ON p.source_file = e.source_file),
st AS (SELECT account_id, line_no AS txn_id, CASE fmt_idx {date} END AS "Date",
              coalesce(ds, '') AS Description, CASE WHEN isfinite(amt) THEN amt ELSE 0.0 END AS Amount,
              coalesce(c, 'Uncategorized') AS Category, source_file, raw_date, raw_amount, raw_cat,
              CASE fmt_idx {label} END AS date_format,
              CASE WHEN fmt_idx IS NULL THEN 'no single date format fits the file' END AS reject_reason
       FROM n),
stt AS (SELECT *, CASE WHEN Amount >= 0 THEN 'Credit' ELSE 'Debit' END AS Type FROM st)"""


def parse_statement() -> str:
    return _statement_ctes() + """
SELECT account_id, txn_id, "Date", Description, Amount, Category, Type, source_file
FROM stt WHERE reject_reason IS NULL"""


def rejected_rows() -> str:
    return _statement_ctes() + """
SELECT account_id, txn_id, source_file, raw_date, raw_amount, reject_reason
FROM stt WHERE reject_reason IS NOT NULL"""


def parse_dates() -> str:
    return _statement_ctes() + """
SELECT account_id, txn_id, source_file, raw_date, date_format, "Date" FROM stt"""


def fill_category() -> str:
    return _statement_ctes() + "\nSELECT account_id, txn_id, raw_cat, Category FROM stt"


def clean_amounts() -> str:
    return _statement_ctes() + "\nSELECT txn_id, raw_amount, Amount, Type FROM stt"


def classify_type(ledger: str) -> str:
    return f"WITH {ledger}\nSELECT txn_id, Amount, CASE WHEN Amount >= 0 THEN 'Credit' ELSE 'Debit' END AS Type FROM ledger"


def _line_ctes(rules) -> str:
    """What the statements written from orders must give, straight from the orders."""
    signed = "CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE -o_totalprice END"
    return f"""WITH o AS (
  SELECT *, o_custkey // 50 AS statement, o_orderkey % 101 = 7 AND abs(o_totalprice) >= 1000 AS wide,
         row_number() OVER (PARTITION BY o_custkey // 50 ORDER BY o_orderkey) AS line_no,
         CASE o_orderkey % 6 WHEN 0 THEN 'Joe "Big" Deli, NY ' WHEN 1 THEN 'Corporate Payroll '
              WHEN 2 THEN 'Netflix' || chr(10) || 'subscription ' WHEN 3 THEN 'Landlord '
              WHEN 4 THEN 'Uber trip ' ELSE 'Transfer ' END || o_orderkey AS descr,
         round({signed}, 2) AS amt
  FROM orders),
lines AS (SELECT statement, line_no AS txn_id, wide,
  CASE WHEN o_orderkey % 29 = 3 THEN NULL
       WHEN statement % 9 = 7 THEN date_trunc('minute', CAST(o_orderdate AS TIMESTAMP))
       ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS "Date",
  descr AS Description, amt AS Amount,
  CASE WHEN statement % 2 = 0 THEN o_orderpriority ELSE {categorize_sql('descr', rules)} END AS Category,
  CASE WHEN amt >= 0 THEN 'Credit' ELSE 'Debit' END AS Type
  FROM o WHERE statement % 11 <> 5)"""


def read_statement_lines(rules) -> str:
    return _line_ctes(rules) + """
SELECT statement AS account_id, txn_id, "Date", Description, Amount, Category, Type FROM lines WHERE NOT wide"""


def rejected_statement_lines(rules) -> str:
    return _line_ctes(rules) + """
SELECT statement AS account_id, txn_id, 'more fields than the header' AS reject_reason FROM lines WHERE wide
UNION ALL
SELECT DISTINCT o_custkey // 50, CAST(NULL AS BIGINT), 'could not map date, description and amount columns'
FROM orders WHERE (o_custkey // 50) % 11 = 5"""


def statement_file_report(rules) -> str:
    no_rows = "CAST(0 AS BIGINT) AS ledger_rows, CAST(0 AS BIGINT) AS rejected_records"
    return _line_ctes(rules) + f"""
SELECT statement AS account_id, CAST(NULL AS VARCHAR) AS reject_reason,
       count(*) FILTER (NOT wide) AS ledger_rows, count(*) FILTER (wide) AS rejected_records FROM lines GROUP BY statement
UNION ALL SELECT DISTINCT o_custkey // 50, 'could not map date, description and amount columns', {no_rows}
FROM orders WHERE (o_custkey // 50) % 11 = 5
UNION ALL SELECT -1 - r_regionkey, 'no header line', {no_rows} FROM region
UNION ALL SELECT -11 - r_regionkey, 'a quoted field is never closed', {no_rows} FROM region
UNION ALL SELECT -100, 'no header line', {no_rows}
UNION ALL SELECT -200, 'unsupported file format', {no_rows}"""


def statement_layouts() -> str:
    return """WITH s AS (SELECT DISTINCT o_custkey // 50 AS statement FROM orders),
k AS (SELECT statement, CASE WHEN statement % 11 = 5 THEN 2 ELSE statement % 2 END AS kind FROM s)
SELECT statement AS account_id,
  CASE kind WHEN 0 THEN 'Posting Date|Merchant Details|Amount (USD)|Tag'
            WHEN 1 THEN 'Amount (USD)|Payee|Transaction Date' ELSE 'When|Who|How Much' END AS header,
  CAST(CASE kind WHEN 0 THEN 1 WHEN 1 THEN 3 END AS INTEGER) AS date_at,
  CAST(CASE kind WHEN 0 THEN 2 WHEN 1 THEN 2 END AS INTEGER) AS description_at,
  CAST(CASE kind WHEN 0 THEN 3 WHEN 1 THEN 1 END AS INTEGER) AS amount_at,
  CAST(CASE kind WHEN 0 THEN 4 END AS INTEGER) AS category_at, '' AS warnings FROM k"""


def categorize_sql(text: str, rules, other: str = "Other") -> str:
    """CASE over ordered keyword rules: substring of the lower-cased text."""
    arms = []
    for cat, kws in rules:
        cond = " OR ".join(f"contains(lower(coalesce({text}, '')), '{k.lower()}')" for k in kws)
        arms.append(f"WHEN {cond} THEN '{cat}'")
    return "CASE " + " ".join(arms) + f" ELSE '{other}' END"


def categorize_keywords(rules) -> str:
    return f"SELECT doc_id, {categorize_sql('text', rules)} AS Category FROM documents"


# --- context, prompts, display and report text -----------------------------

def money_txt(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', {x}))"


def pct_txt(x: str) -> str:
    return f"(replace(format('{{:,.1f}}', {x}), ',', '') || '%')"


def commas_txt(x: str) -> str:
    return f"regexp_replace(format('{{:,.2f}}', {x}), '(\\.\\d)0$', '\\1')"


def jstr(x: str) -> str:
    """``json.dumps`` of a string, built from its code points (Python's escape table)."""
    one = (r"""CASE WHEN c = '\' THEN '\\' WHEN c = '"' THEN '\"' WHEN c = chr(10) THEN '\n' """
           r"""WHEN c = chr(13) THEN '\r' WHEN c = chr(9) THEN '\t' WHEN c = chr(8) THEN '\b' """
           r"""WHEN c = chr(12) THEN '\f' WHEN unicode(c) >= 32 AND unicode(c) < 127 THEN c """
           r"""WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c)) """
           r"""ELSE printf('\u%04x\u%04x', 55296 + ((unicode(c) - 65536) >> 10), """
           r"""56320 + ((unicode(c) - 65536) & 1023)) END""")
    return (f"(CASE WHEN {x} IS NULL THEN 'null' "
            f"WHEN regexp_matches({x}, '^[\\x20-\\x7E]*$') "
            f"THEN '\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"' "
            f"ELSE '\"' || array_to_string(list_transform(regexp_extract_all({x}, '(?s)(.)', 1), "
            f"lambda c: {one}), '') || '\"' END)")


def pyrepr(x: str) -> str:
    esc = (f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), "
           f"chr(9), '\\t')")
    return (f"(CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {esc} || '\"' "
            f"ELSE '''' || replace({esc}, '''', '\\''') || '''' END)")


def _context_ctes(ledger: str, k: int = 5) -> str:
    line = (f"coalesce(strftime(\"Date\", '%Y-%m-%d'), '') || ' - ' || Description || ': $' || "
            f"CAST(Amount AS VARCHAR)")
    obj = f"'{{\"Category\": ' || {jstr('Category')} || ', \"Total Spent\": ' || CAST(Amount AS VARCHAR) || '}}'"
    obj_i = (f"'  {{' || chr(10) || '    \"Category\": ' || {jstr('Category')} || ',' || chr(10) || "
             f"'    \"Total Spent\": ' || CAST(Amount AS VARCHAR) || chr(10) || '  }}'")
    return f"""WITH {ledger},
s AS (SELECT account_id, {CREDIT_SUM} AS inc, {DEBIT_SUM} AS exp FROM ledger GROUP BY account_id),
k AS (SELECT account_id, {cents('inc')} AS total_income, {cents('exp')} AS total_expenses,
             {cents('inc - exp')} AS net_savings FROM s),
kr AS (SELECT *, CAST(round(CAST({pct('net_savings', 'total_income')} AS DECIMAL(38,10)), 2) AS DOUBLE)
                 AS savings_rate_pct FROM k),
c AS (SELECT account_id, Category, {cents('abs(sum(CAST(Amount AS DECIMAL(38,10))))')} AS Amount
      FROM ledger WHERE Type = 'Debit' GROUP BY ALL),
cl AS (SELECT account_id, '[' || string_agg({obj}, ', ' ORDER BY Amount DESC, Category) || ']' AS cj,
              '[' || chr(10) || string_agg({obj_i}, ',' || chr(10) ORDER BY Amount DESC, Category)
                  || chr(10) || ']' AS cji
       FROM c GROUP BY account_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY account_id
                                   ORDER BY abs(Amount) DESC, "Date" DESC NULLS LAST, txn_id) AS INTEGER) AS rank
      FROM ledger),
t AS (SELECT account_id, rank, {line} AS line FROM r WHERE rank <= {k}),
tl AS (SELECT account_id, '[' || string_agg({jstr('line')}, ', ' ORDER BY rank) || ']' AS tj,
              string_agg('- ' || line, chr(10) ORDER BY rank) AS tlines,
              '[' || string_agg({pyrepr('line')}, ', ' ORDER BY rank) || ']' AS trepr
       FROM t GROUP BY account_id),
ctx AS (SELECT kr.*, coalesce(cl.cj, '[]') AS category_json, coalesce(cl.cji, '[]') AS category_json_indented,
               coalesce(tl.tj, '[]') AS top_json, coalesce(tl.tlines, '') AS top_lines,
               coalesce(tl.trepr, '[]') AS top_repr
        FROM kr LEFT JOIN cl ON kr.account_id = cl.account_id LEFT JOIN tl ON kr.account_id = tl.account_id)"""


def top_transaction_lines(ledger: str, k: int = 5) -> str:
    line = ("coalesce(strftime(\"Date\", '%Y-%m-%d'), '') || ' - ' || Description || ': $' || "
            "CAST(Amount AS VARCHAR)")
    return f"""WITH {ledger},
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY account_id
                                   ORDER BY abs(Amount) DESC, "Date" DESC NULLS LAST, txn_id) AS INTEGER) AS rank
      FROM ledger)
SELECT account_id, rank, {line} AS line FROM r WHERE rank <= {k}"""


def category_json(ledger: str) -> str:
    return _context_ctes(ledger) + """
SELECT account_id, cj AS category_json, cji AS category_json_indented FROM cl"""


def financial_context(ledger: str, k: int = 5) -> str:
    cj = ("'{\"total_income\": ' || CAST(total_income AS VARCHAR) || ', \"total_expenses\": ' || "
          "CAST(total_expenses AS VARCHAR) || ', \"net_savings\": ' || CAST(net_savings AS VARCHAR) || "
          "', \"savings_rate_pct\": ' || CAST(savings_rate_pct AS VARCHAR) || ', \"category_expenses\": ' || "
          "category_json || ', \"top_5_largest_transactions\": ' || top_json || '}'")
    return _context_ctes(ledger, k) + f"""
SELECT account_id, total_income, total_expenses, net_savings, savings_rate_pct, category_json,
       {cj} AS context_json FROM ctx"""


def _template_sql(template: str, slots: dict[str, str]) -> str:
    """Template with ``<name>`` slots -> SQL string concatenation."""
    out, rest = [], template
    while "<" in rest:
        i = rest.index("<")
        j = rest.find(">", i)
        name = rest[i + 1:j]
        if j < 0 or name not in slots:
            out.append(_lit(rest[:i + 1]))
            rest = rest[i + 1:]
            continue
        out.append(_lit(rest[:i]))
        out.append(f"({slots[name]})")
        rest = rest[j + 1:]
    out.append(_lit(rest))
    return " || ".join(out)


def _lit(text: str) -> str:
    parts = text.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted)


def _kpi_slots() -> dict[str, str]:
    return {"income": commas_txt("total_income"), "expenses": commas_txt("total_expenses"),
            "net": commas_txt("net_savings"), "rate": "CAST(savings_rate_pct AS VARCHAR)"}


def review_prompt(ledger: str, template: str) -> str:
    slots = _kpi_slots()
    slots.update({"categories_indented": "category_json_indented", "top_lines": "top_lines"})
    return _context_ctes(ledger) + f"\nSELECT account_id, {_template_sql(template, slots)} AS prompt FROM ctx"


def dialog_assembly(ledger: str, context_template: str, opening_user: str, opening_model: str) -> str:
    slots = _kpi_slots()
    slots.update({"categories": "category_json", "top_list": "top_repr"})
    opening = _template_sql(opening_user, {"context": "coalesce(cx.context, '')"})
    return _context_ctes(ledger) + f""",
cx AS (SELECT account_id, {_template_sql(context_template, slots)} AS context FROM ctx),
cv AS (SELECT DISTINCT conv_id FROM conversations)
SELECT cv.conv_id, CAST(-2 AS BIGINT) AS position, 'user' AS role, {opening} AS text
FROM cv LEFT JOIN cx ON cv.conv_id = cx.account_id
UNION ALL
SELECT conv_id, CAST(-1 AS BIGINT) AS position, 'model' AS role, {_lit(opening_model)} AS text FROM cv
UNION ALL
SELECT conv_id, CAST(turn AS BIGINT) AS position, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role,
       text FROM conversations"""


PYSPACE = (r"[\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


REVIEW_TEXT = """documents AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
    CASE (i - 1 + doc_id) % 6 WHEN 0 THEN '## ' || x WHEN 1 THEN '- **' || left(x, 12) || '** ' || x
         WHEN 2 THEN '  * ' || x WHEN 3 THEN '**' || x || '** and *one*' WHEN 4 THEN '' ELSE x END),
    chr(10)) AS text FROM documents)"""


def review_blocks() -> str:
    return text_blocks().replace("WITH sp AS", f"WITH {REVIEW_TEXT},\nsp AS", 1)


def statement_monthly_summary() -> str:
    return monthly_summary(_statement_ledger())


def statement_top_lines(k: int) -> str:
    return top_transaction_lines(_statement_ledger(), k)


def _statement_ledger() -> str:
    """The parsed statements, undated rows among them, as a ledger."""
    ctes = _statement_ctes().removeprefix("WITH ")
    return ctes + """,
ledger AS (SELECT account_id, txn_id, "Date", Description, Amount, Category, Type
           FROM stt WHERE reject_reason IS NULL)"""


def context_categories(ledger: str) -> str:
    return f"""WITH {ledger},
c AS (SELECT account_id, Category, {cents('abs(sum(CAST(Amount AS DECIMAL(38,10))))')} AS amt
      FROM ledger WHERE Type = 'Debit' GROUP BY ALL)
SELECT account_id, CAST(row_number() OVER (PARTITION BY account_id ORDER BY amt DESC, Category) - 1 AS INTEGER) AS pos,
       Category, amt AS total_spent FROM c"""


def context_top_lines(ledger: str, k: int) -> str:
    return f"SELECT account_id, CAST(rank - 1 AS INTEGER) AS pos, line FROM ({top_transaction_lines(ledger, k)})"


def text_blocks() -> str:
    strip = f"regexp_replace(raw, '^{PYSPACE}+|{PYSPACE}+$', '', 'g')"
    return f"""WITH sp AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS raw FROM sp),
s AS (SELECT doc_id, line_no, {strip} AS s FROM l),
b AS (SELECT *, regexp_replace(s, '(?s)\\*\\*(.*?)\\*\\*', '<b>\\1</b>', 'g') AS bold,
             CASE WHEN starts_with(s, '#') THEN 'heading'
                  WHEN starts_with(s, '-') OR starts_with(s, '*') THEN 'bullet' ELSE 'paragraph' END AS kind
      FROM s WHERE s <> ''),
t AS (SELECT doc_id, line_no, kind,
             CASE kind WHEN 'heading' THEN regexp_replace(regexp_replace(s, '^#+', ''),
                                                          '^{PYSPACE}+|{PYSPACE}+$', '', 'g')
                       WHEN 'bullet' THEN regexp_replace(bold, '^[-*]{PYSPACE}*', '')
                       ELSE bold END AS text FROM b)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, kind, text,
       CASE kind WHEN 'heading' THEN '<b>' || text || '</b>' WHEN 'bullet' THEN '• ' || text ELSE text END
         AS markup
FROM t"""


def kpi_display(ledger: str) -> str:
    return f"""WITH {ledger},
s AS (SELECT account_id, {CREDIT_SUM} AS inc, {DEBIT_SUM} AS exp FROM ledger GROUP BY account_id),
k AS (SELECT account_id, {cents('inc')} AS ti, {cents('exp')} AS te, {cents('inc - exp')} AS ns FROM s),
r AS (SELECT *, {pct('ns', 'ti')} AS rate FROM k)
SELECT account_id, {money_txt('ti')} AS income_text, {money_txt('te')} AS expenses_text,
       {money_txt('ns')} AS net_text, {pct_txt('rate')} AS rate_text,
       CASE WHEN rate >= 20 THEN 'green' ELSE 'blue' END AS rate_band FROM r"""


def transactions_display(ledger: str) -> str:
    return f"""WITH {ledger}
SELECT *, strftime("Date", '%Y-%m-%d') AS date_text, {money_txt('Amount')} AS amount_text FROM ledger"""


def report_kpis(ledger: str, labels: list[str]) -> str:
    texts = [money_txt("ti"), money_txt("te"), money_txt("ns"), pct_txt(pct("ns", "ti"))]
    arms = "\nUNION ALL\n".join(
        f"SELECT account_id, {i + 1} AS position, {_lit(lbl)} AS metric, {t} AS value FROM k"
        for i, (lbl, t) in enumerate(zip(labels, texts)))
    return f"""WITH {ledger},
s AS (SELECT account_id, {CREDIT_SUM} AS inc, {DEBIT_SUM} AS exp FROM ledger GROUP BY account_id),
k AS (SELECT account_id, {cents('inc')} AS ti, {cents('exp')} AS te, {cents('inc - exp')} AS ns FROM s)
{arms}"""


def report_categories(ledger: str) -> str:
    return category_share(ledger).replace(
        "SELECT *, " + pct('Amount', 'total_expenses') + " AS share_pct FROM t",
        f"""SELECT account_id, Category, Amount, share_pct, {money_txt('Amount')} AS amount_text,
       {pct_txt('share_pct')} AS share_text
FROM (SELECT *, {pct('Amount', 'total_expenses')} AS share_pct FROM t)""")


def report_document(ledger: str, generated_at: str, title: str, kpi_labels: list[str],
                    kpi_header: list[str], cat_header: list[str], sections: list[str]) -> str:
    def row(section, seq, kind, c1="NULL", c2="NULL", c3="NULL"):
        return (f"SELECT account_id, CAST({section} AS INTEGER) AS section, CAST({seq} AS BIGINT) AS seq, "
                f"'{kind}' AS kind, CAST({c1} AS VARCHAR) AS cell1, CAST({c2} AS VARCHAR) AS cell2, "
                f"CAST({c3} AS VARCHAR) AS cell3 FROM k")
    stamp = (f"'Report Generated: ' || strftime(TIMESTAMP '{generated_at}', '%B %d, %Y at %I:%M %p')")
    texts = [money_txt("ti"), money_txt("te"), money_txt("ns"), pct_txt(pct("ns", "ti"))]
    rows = [row(0, 0, "title", _lit(title)), row(0, 1, "subtitle", stamp),
            row(1, 0, "heading", _lit(sections[0])),
            row(1, 1, "table_header", _lit(kpi_header[0]), _lit(kpi_header[1]))]
    rows += [row(1, 2 + i, "table_row", _lit(lbl), t) for i, (lbl, t) in enumerate(zip(kpi_labels, texts))]
    rows += [row(2, 0, "heading", _lit(sections[1])),
             row(2, 1, "table_header", *[_lit(h) for h in cat_header]),
             row(3, 0, "page_break"), row(4, 0, "heading", _lit(sections[2]))]
    head = "\nUNION ALL\n".join(rows)
    return f"""WITH {ledger},
s AS (SELECT account_id, {CREDIT_SUM} AS inc, {DEBIT_SUM} AS exp FROM ledger GROUP BY account_id),
k AS (SELECT account_id, {cents('inc')} AS ti, {cents('exp')} AS te, {cents('inc - exp')} AS ns FROM s),
c AS (SELECT account_id, Category, abs(sum(CAST(Amount AS DECIMAL(38,10)))) AS amt
      FROM ledger WHERE Type = 'Debit' GROUP BY ALL),
t AS (SELECT account_id, Category, {cents('amt')} AS Amount,
             {cents('sum(amt) OVER (PARTITION BY account_id)')} AS total FROM c),
cr AS (SELECT account_id, CAST(2 AS INTEGER) AS section,
              CAST(row_number() OVER (PARTITION BY account_id ORDER BY Amount DESC, Category) + 1 AS BIGINT) AS seq,
              'table_row' AS kind, Category AS cell1, {money_txt('Amount')} AS cell2,
              {pct_txt(pct('Amount', 'total'))} AS cell3 FROM t)
{head}
UNION ALL
SELECT * FROM cr"""


def credits_only(ledger: str) -> str:
    return f"WITH {ledger}\nSELECT * FROM ledger WHERE Type = 'Credit'"


def search_literal(ledger: str, text: str) -> str:
    q = text.replace("'", "''")
    return f"""WITH {ledger}
SELECT * FROM ledger
WHERE contains(lower(Description), lower('{q}')) OR contains(lower(Category), lower('{q}'))
   OR contains(CAST(Amount AS VARCHAR), '{q}')"""
