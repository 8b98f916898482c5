"""The ledger contract shared by every operator.

A ledger DataFrame has one row per transaction:

    account_id   key of the ledger (any type); one result set per account
    txn_id       tie-breaker for ordering (one or more key columns)
    Date         TIMESTAMP_NTZ, nullable; undated rows count in totals only
    Description  STRING not null
    Amount       DOUBLE not null; credits >= 0, debits < 0
    Category     STRING not null
    Type         STRING not null, 'Credit' or 'Debit'
"""

from __future__ import annotations

ACCOUNT = "account_id"
TXN = "txn_id"
DATE = "Date"
DESC = "Description"
AMOUNT = "Amount"
CATEGORY = "Category"
TYPE = "Type"

CREDIT = "Credit"
DEBIT = "Debit"

LEDGER_COLUMNS = [ACCOUNT, TXN, DATE, DESC, AMOUNT, CATEGORY, TYPE]

# Money is summed as exact decimals of ten places and rounded to cents once, after
# the sum (see functions.money). A row may be up to 1e18, a sum up to 1e28.
ROW_DECIMAL = "decimal(28,10)"
MONEY_DECIMAL = "decimal(38,10)"
