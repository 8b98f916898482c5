"""Ledger views over the test tables (TPC-H-like parquet).

The driver tables hold no bank ledger, so these adapters define one. Each is
a projection (plus one join for lineitem) that Catalyst prunes and pushes
into the parquet scan; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.money import classify_type
from tallyspark.schema import ACCOUNT, AMOUNT, CATEGORY, DATE, DESC, TXN, TYPE


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ledger(account, txn, date, desc, amount, category) -> list:
    amount = F.coalesce(amount, F.lit(0.0))
    return [account.alias(ACCOUNT), txn.alias(TXN), date.alias(DATE),
            F.coalesce(desc, F.lit("")).alias(DESC), amount.alias(AMOUNT),
            F.coalesce(category, F.lit("Uncategorized")).alias(CATEGORY),
            classify_type(amount).alias(TYPE)]


def orders_ledger(orders: DataFrame) -> DataFrame:
    """One account per customer; fulfilled orders are credits, others debits."""
    price = F.col("o_totalprice")
    amount = F.when(F.col("o_orderstatus") == "F", price).otherwise(-price)
    return orders.select(*_ledger(
        F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderdate"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")),
        amount, F.col("o_orderpriority")))


def events_ledger(events: DataFrame) -> DataFrame:
    """One account per user; purchases are debits, other events credits."""
    value = F.col("value")
    amount = F.when(F.col("event_type") == "purchase", -value).otherwise(value)
    return events.select(*_ledger(
        F.col("user_id"), F.col("event_id"), F.col("ts"),
        F.concat(F.initcap(F.col("event_type")), F.lit(" event "), F.col("event_id").cast("string")),
        amount, F.col("event_type")))


LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


def lineitem_keyed(lineitem: DataFrame, orders: DataFrame, hot_every: int | None = None) -> DataFrame:
    """Line items as ledger rows that still carry their key columns and no texts.

    ``hot_every=k`` books every k-th order (all its lines) to one hot account
    (-1) instead, a skew test: with k=3 one key holds a third of all rows. The
    join is an equi-join on the order key: the planner broadcasts orders only
    when its measured size is under the threshold, otherwise both sides
    shuffle (or not at all when both are bucketed by order key).
    """
    li = lineitem.select(*LINE_KEY, "l_extendedprice", "l_returnflag", "l_shipdate")
    od = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    price = F.col("l_extendedprice")
    amount = F.coalesce(F.when(F.col("l_returnflag") == "R", price).otherwise(-price), F.lit(0.0))
    account = F.col("o_custkey")
    if hot_every:
        account = F.when(F.col("l_orderkey") % hot_every == 0, F.lit(-1).cast("bigint")).otherwise(account)
    return li.join(od, "l_orderkey").select(
        account.alias(ACCOUNT), *LINE_KEY, F.col("l_shipdate").alias(DATE), amount.alias(AMOUNT),
        "l_returnflag", classify_type(amount).alias(TYPE))


def lineitem_texts(keyed: DataFrame, more: list[str] | None = None) -> DataFrame:
    """Ledger columns of ``lineitem_keyed`` rows. ``txn_id`` is the four-column
    line key as text (order and line number alone repeat)."""
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in LINE_KEY])
    category = F.coalesce(F.concat(F.lit("Flag "), F.col("l_returnflag")), F.lit("Uncategorized"))
    return keyed.select(ACCOUNT, key.alias(TXN), DATE, F.concat(F.lit("Line "), key).alias(DESC), AMOUNT,
                        category.alias(CATEGORY), TYPE, *(more or []))


def lineitem_ledger(lineitem: DataFrame, orders: DataFrame, hot_every: int | None = None) -> DataFrame:
    """Line items booked to the ordering customer; returned lines are credits."""
    return lineitem_texts(lineitem_keyed(lineitem, orders, hot_every))


def review_text(documents: DataFrame) -> DataFrame:
    """Documents as review text: headings, bullets, bold words and blank lines by line and key."""
    x = lambda line, i: (
        F.when(kind(i) == 0, F.concat(F.lit("## "), line))
         .when(kind(i) == 1, F.concat(F.lit("- **"), F.left(line, F.lit(12)), F.lit("** "), line))
         .when(kind(i) == 2, F.concat(F.lit("  * "), line))
         .when(kind(i) == 3, F.concat(F.lit("**"), line, F.lit("** and *one*")))
         .when(kind(i) == 4, F.lit("")).otherwise(line))
    kind = lambda i: (i + F.col("doc_id")) % 6
    return documents.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), x), "\n").alias("text"))


# Header of the raw statement built from orders (all text, as read from CSV).
RAW_HEADERS = ["Posting Date", "Merchant Details", "Amount (USD)", "Tag", "Balance"]


# Date styles of the raw statements, by customer.
RAW_DATE_STYLES = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMM d, yyyy", "M/d/yy", "d MMM yyyy",
                   "MM-dd-yyyy", "MM/dd/yyyy HH:mm", "dd-MM-yyyy"]


def raw_statement(orders: DataFrame) -> DataFrame:
    """Orders rendered as raw statement text, one statement file per customer.

    Date text style is chosen per customer (``RAW_DATE_STYLES``), and some rows
    have no date; for customers with ``o_custkey % 97 = 5`` pending orders
    use ISO while the rest of the file does not, so those files fail the
    one-format-per-file rule. Amount text varies by order key: ``$1,234.56``,
    ``€-1,234.56``, ``-£1,234.56``, ``(1,234.56)``, ``n/a``. Priority
    ``4-NOT SPECIFIED`` is written ``N/A`` (a missing token).
    """
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    d = F.col("o_orderdate")
    style = F.when((ck % 97 == 5) & (F.col("o_orderstatus") == "P"), F.lit(0)).otherwise(ck % len(RAW_DATE_STYLES))
    date_text = F.when(ok % 29 == 3, F.lit("N/A"))
    for i, pattern in enumerate(RAW_DATE_STYLES):
        date_text = date_text.when(style == i, F.date_format(d, pattern))
    price = F.col("o_totalprice")
    credit = F.col("o_orderstatus") == "F"
    signed = F.when(credit, price).otherwise(-price)
    kind = ok % 5
    amount_text = (F.when(kind == 0, F.concat(F.lit("$"), F.format_number(signed, 2)))
                    .when(kind == 1, F.concat(F.lit("€"), F.format_number(signed, 2)))
                    .when(kind == 2, F.concat(F.when(credit, F.lit("£")).otherwise(F.lit("-£")),
                                              F.format_number(price, 2)))
                    .when(kind == 3, F.concat(F.lit("("), F.format_number(price, 2), F.lit(")")))
                    .otherwise(F.lit("n/a")))
    tag = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("N/A")).otherwise(
        F.col("o_orderpriority"))
    return orders.select(
        F.concat(F.lit("statement_"), ck.cast("string"), F.lit(".csv")).alias("source_file"),
        ok.alias("line_no"),
        ck.alias(ACCOUNT),
        date_text.alias(RAW_HEADERS[0]),
        F.concat(F.lit("Payment "), ok.cast("string")).alias(RAW_HEADERS[1]),
        amount_text.alias(RAW_HEADERS[2]),
        tag.alias(RAW_HEADERS[3]),
        F.lit("").alias(RAW_HEADERS[4]))


def goals_table(customer: DataFrame) -> DataFrame:
    """One savings goal per customer: target 5000, current = account balance.

    The monthly contribution is left empty so the ledger default applies;
    negative balances fail the input bounds.
    """
    return customer.select(
        F.col("c_custkey").alias(ACCOUNT),
        F.lit("Emergency Fund").alias("goal_name"),
        F.lit(5000.0).alias("target_amount"),
        F.col("c_acctbal").alias("current_savings"),
        F.lit(None).cast("double").alias("monthly_contribution"))


# A second header layout for the exported statements: other order, other names.
RAW_HEADERS_B = ["Amount (USD)", "Category", "Payee", "Transaction Date"]


def export_raw_statements(raw: DataFrame, folder: str) -> str:
    """Write ``raw_statement`` rows as CSV files, one folder per account.

    Accounts are assigned to one of two header layouts (even and odd keys);
    layout B writes its columns in another order under other names. Every
    row is written once; the shuffle puts each account's rows in one file.
    """
    layout_b = (F.col(ACCOUNT) % 2) == 1
    a = raw.where(~layout_b).select(ACCOUNT, *RAW_HEADERS)
    b = raw.where(layout_b).select(
        ACCOUNT, F.col("`Amount (USD)`"), F.col("Tag").alias("Category"),
        F.col("`Merchant Details`").alias("Payee"), F.col("`Posting Date`").alias("Transaction Date"))
    for name, df in (("layout=A", a), ("layout=B", b)):
        (df.repartition(ACCOUNT).write.mode("errorifexists").partitionBy(ACCOUNT)
         .option("header", "true").csv(f"{folder.rstrip('/')}/{name}"))
    return folder


# Statements of several customers as CSV text, one file per statement.
STATEMENT_CUSTOMERS = 50
STATEMENT_HEADERS = ("Posting Date,Merchant Details,Amount (USD),Tag", "Amount (USD), Payee ,Transaction Date",
                     "When,Who,How Much")


def statement_lines(orders: DataFrame) -> DataFrame:
    """Orders as the CSV lines of bank statements: (statement, pos, line).

    A statement holds the orders of ``STATEMENT_CUSTOMERS`` customers. By
    statement number: two header layouts (every eleventh has a header without
    the roles), a blank first line in every fourth, nine date styles. By order
    key: quoted commas, doubled quotes and line breaks inside fields, missing
    dates, records with more fields than the header, and descriptions that
    reach the categoriser's rules.
    """
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    no = F.floor(ck / STATEMENT_CUSTOMERS).cast("bigint")
    date_text = F.when(ok % 29 == 3, F.lit(""))
    for i, pattern in enumerate(RAW_DATE_STYLES):
        date_text = date_text.when(no % len(RAW_DATE_STYLES) == i, F.date_format("o_orderdate", pattern))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    key = ok.cast("string")
    desc = (F.when(ok % 6 == 0, quote(F.concat(F.lit('Joe ""Big"" Deli, NY '), key)))
             .when(ok % 6 == 1, F.concat(F.lit("Corporate Payroll "), key))
             .when(ok % 6 == 2, quote(F.concat(F.lit("Netflix\nsubscription "), key)))
             .when(ok % 6 == 3, F.concat(F.lit("Landlord "), key))
             .when(ok % 6 == 4, F.concat(F.lit("Uber trip "), key))
             .otherwise(F.concat(F.lit("Transfer "), key)))
    signed = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    money = F.format_number(signed, 2)
    amount = F.when(ok % 101 == 7, money).otherwise(quote(F.concat(F.lit("$"), money)))  # unquoted: too many fields
    dated = F.when(F.col("_d").contains(","), quote(F.col("_d"))).otherwise(F.col("_d"))
    a = F.concat_ws(",", dated, desc, amount, F.col("o_orderpriority"))
    b = F.concat_ws(",", amount, desc, dated)
    rows = orders.withColumn("_d", date_text).select(
        no.alias("statement"), ok.alias("pos"), F.when(no % 2 == 0, a).otherwise(b).alias("line"))
    kind = F.when(F.col("statement") % 11 == 5, 2).otherwise(F.col("statement") % 2).cast("int")
    header = F.element_at(F.array(*[F.lit(h) for h in STATEMENT_HEADERS]), kind + 1)
    top = F.array(F.struct(F.lit(-2).cast("bigint").alias("pos"), F.when(F.col("statement") % 4 == 1, F.lit("")).alias("line")),
                  F.struct(F.lit(-1).cast("bigint").alias("pos"), header.alias("line")))
    heads = rows.select("statement").distinct().select("statement", F.inline(top)).where(F.col("line").isNotNull())
    return rows.unionByName(heads)


def write_statement_lines(orders: DataFrame, folder: str) -> str:
    """Write the lines as text files, one folder and file per statement, in order.

    The time goes into opening files, not into bytes: a fixed number of tasks
    keeps every core busy where partitions merged by their bytes would not.
    """
    spark = orders.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (statement_lines(orders).repartition(tasks, "statement").sortWithinPartitions("statement", "pos")
     .select("statement", "line").write.mode("errorifexists").partitionBy("statement").text(folder))
    return folder


def write_unusable_files(region: DataFrame, folder: str) -> str:
    """Beside statements: files without a byte, with blank lines, an unclosed quote or another suffix.

    By region: ``statement=-1 - r_regionkey`` holds a blank line only, ``-11 -
    r_regionkey`` opens a quoted field and never closes it. ``-100`` is a
    file of no bytes, ``-200`` one in another format.
    """
    folder = folder.rstrip("/")
    key = F.col("r_regionkey").cast("bigint")
    blank = region.select((-1 - key).alias("statement"), F.lit("").alias("line"))
    unclosed = region.select((-11 - key).alias("statement"), F.concat(F.lit('Date,Payee,Amount\n2026-01-05,"'), "r_name").alias("line"))
    (blank.unionByName(unclosed).repartition("statement").write.mode("append").partitionBy("statement").text(folder))
    region.where(F.lit(False)).select("r_name").coalesce(1).write.text(f"{folder}/statement=-100")
    region.coalesce(1).write.json(f"{folder}/statement=-200")
    return folder
