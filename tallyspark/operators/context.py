"""Text products per account: the financial context record, prompt texts,
display strings, report tables and review-text blocks.

All text is built with Spark string functions so it is produced in batch for
every account at once; the language-model call itself is out of scope (an
external consumer reads these rows). Lists are bounded per account: at most k
top transactions and one entry per expense category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import (amount_text, exact_sum, float_commas_text, money_text,
                                        percent_text, round_half_up, safe_ratio_pct, to_cents)
from tallyspark.functions.text import PY_SPACE_CLASS, bold_to_tags, json_string, py_strip
from tallyspark.operators.aggregates import category_expenses, kpi_summary, top_transactions
from tallyspark.schema import ACCOUNT, AMOUNT, CATEGORY, CREDIT, DATE, DEBIT, DESC, MONEY_DECIMAL, TYPE

# The advisor prompt templates. ``{advisor}`` names the
# assistant; the placeholders in angle brackets are filled per account.
DEFAULT_ADVISOR = "Ledger Advisor"

REVIEW_PROMPT = """
You are {advisor}, an elite personal finance advisor. Analyze the following user financial ledger summary and provide a professional, actionable financial health review.

### FINANCIAL LEDGER SUMMARY:
- Total Income: $<income>
- Total Expenses: $<expenses>
- Net Savings: $<net>
- Savings Rate: <rate>%

### EXPENSES BY CATEGORY:
<categories_indented>

### TOP 5 LARGEST TRANSACTIONS:
<top_lines>

Please provide:
1. **Overview & Health Score (out of 100)**: A brief evaluation of their current situation.
2. **Key Spending Insights**: Identify any potential areas of overspending or concerning patterns.
3. **Actionable Budget & Saving Suggestions**: 3 specific recommendations to optimize savings.
4. **Investment & Goal Recommendations**: Suggestions on how to allocate net savings based on their profiles.

Keep your response professional, concise, and formatted beautifully in markdown.
"""

CHAT_CONTEXT = "\n".join([
    "",
    "You are {advisor}, a friendly and experienced personal finance advisor chat assistant. ",
    "You have access to the user's financial profile summary:",
    "- Total Income: $<income>",
    "- Total Expenses: $<expenses>",
    "- Net Savings: $<net>",
    "- Savings Rate: <rate>%",
    "- Category Expenses: <categories>",
    "- Largest Transactions: <top_list>",
    "",
    "Use this profile context to answer the user's questions. Be encouraging, precise, and practical.",
    "Keep the advice realistic and explain financial concepts simply if asked.",
    "",
])

CHAT_OPENING_USER = "System Context: <context>\n\nHi {advisor}! Please help me manage my finances."
CHAT_OPENING_MODEL = ("Hello! I am {advisor}, your personal finance advisor. I have reviewed your "
                      "transaction metrics. How can I help you optimize your budgets, investments, "
                      "or savings goals today?")

# Report table labels, in row order.
REPORT_KPI_LABELS = ["Total Credits / Income", "Total Debits / Expenses",
                     "Net Cash Position / Savings", "Calculated Savings Rate"]

# The report document's headings and table headers.
REPORT_TITLE = "Personal Finance Review"
REPORT_GENERATED = "Report Generated: "
REPORT_GENERATED_FORMAT = "MMMM dd, yyyy 'at' hh:mm a"
REPORT_SECTION_1 = "1. Executive Financial Summary"
REPORT_KPI_HEADER = ["Financial KPI Metric", "Value Summary"]
REPORT_SECTION_2 = "2. Expense Breakdown by Category"
REPORT_CATEGORY_HEADER = ["Expense Category", "Total Amount Spent", "Percentage of Debits"]
REPORT_SECTION_3 = "3. AI Financial Advisor Strategic Review"


def _keys(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Template with ``<name>`` slots -> concat of literal parts and columns."""
    parts: list[Column] = []
    rest = template
    while "<" in rest:
        i = rest.index("<")
        j = rest.find(">", i)
        name = rest[i + 1:j]
        if j < 0 or name not in values:
            parts.append(F.lit(rest[:i + 1]))
            rest = rest[i + 1:]
            continue
        parts.append(F.lit(rest[:i]))
        parts.append(values[name])
        rest = rest[j + 1:]
    parts.append(F.lit(rest))
    return F.concat(*[p for p in parts])


# Characters that Python's repr writes as an escape: controls, format and
# private characters, unassigned code points and every separator but the blank.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def _escaped_char(ch: Column) -> Column:
    code = F.call_function("ascii", ch)
    digits = F.lower(F.hex(code))
    return (F.when(ch == "\n", F.lit("\\n")).when(ch == "\r", F.lit("\\r")).when(ch == "\t", F.lit("\\t"))
             .when(code < 0x100, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
             .when(code < 0x10000, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
             .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0"))))


def py_str_repr(c: Column) -> Column:
    """Python ``repr`` of a string: its choice of quotes, and escapes for what is not printable."""
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    chars = F.transform(F.split(esc, ""), lambda ch: F.when(ch.rlike(UNPRINTABLE), _escaped_char(ch)).otherwise(ch))
    esc = F.when(esc.rlike(UNPRINTABLE), F.array_join(chars, "")).otherwise(esc)
    dq = c.contains("'") & ~c.contains('"')
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


def top_transaction_lines(ledger: DataFrame, k: int = 5, by=ACCOUNT) -> DataFrame:
    """``YYYY-MM-DD - Description: $amount`` for the k largest transactions.

    The amount prints as Python prints a float (``$-1200.0``); an undated row
    prints an empty date.
    """
    keys = _keys(by)
    top = top_transactions(ledger, k, keys)
    line = F.concat(F.coalesce(F.date_format(F.col(DATE), "yyyy-MM-dd"), F.lit("")), F.lit(" - "),
                    F.col(DESC), F.lit(": $"), amount_text(F.col(AMOUNT)))
    return top.select(*keys, "rank", line.alias("line"))


def _category_item(amount: Column) -> Column:
    """Sortable record for one expense category: (-amount, name, JSON texts, record)."""
    obj = F.concat(F.lit('{"Category": '), json_string(F.col(CATEGORY)), F.lit(', "Total Spent": '),
                   amount_text(amount), F.lit("}"))
    obj_ind = F.concat(F.lit('  {\n    "Category": '), json_string(F.col(CATEGORY)),
                       F.lit(',\n    "Total Spent": '), amount_text(amount), F.lit("\n  }"))
    return F.struct((-amount).alias("k1"), F.col(CATEGORY).alias("k2"), obj.alias("o"),
                    obj_ind.alias("oi"), F.struct(F.col(CATEGORY), amount.alias("Total Spent")).alias("rec"))


def _category_texts(items: Column) -> list[Column]:
    """From a sorted array of ``_category_item``s: count, records, JSON texts."""
    return [F.size(items).alias("n_categories"),
            F.transform(items, lambda x: x["rec"]).alias("categories"),
            F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: x["o"]), ", "), F.lit("]"))
            .alias("category_json"),
            F.when(F.size(items) == 0, F.lit("[]")).otherwise(
                F.concat(F.lit("[\n"), F.array_join(F.transform(items, lambda x: x["oi"]), ",\n"),
                         F.lit("\n]"))).alias("category_json_indented")]


def category_lists(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Per account, expense categories largest first, as JSON texts.

    ``category_json`` is ``json.dumps(list)``, ``category_json_indented`` the
    ``indent=2`` form; ``categories`` keeps the records as an array of structs.
    The list per account has one entry per category (bounded by the category
    vocabulary, not by the number of transactions).
    """
    keys = _keys(by)
    cats = category_expenses(ledger, keys)
    grouped = cats.groupBy(*keys).agg(
        F.sort_array(F.collect_list(_category_item(F.col("Amount")))).alias("_items"))
    return grouped.select(*keys, *_category_texts(F.col("_items")))


def _top_lists(ledger: DataFrame, k: int, keys: list) -> DataFrame:
    lines = top_transaction_lines(ledger, k, keys)
    return lines.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("_l")).select(
        *keys, F.transform("_l", lambda x: x["line"]).alias("top_lines"))


def financial_context(ledger: DataFrame, k: int = 5, by=ACCOUNT) -> DataFrame:
    """The context record per account: KPIs (2 dp), categories, top-k lines.

    Two passes over the ledger: one aggregate by (account, Category) with
    exact credit and debit sums, rolled up per account into both the KPIs and
    the category list (one more aggregate over the small per-category rows);
    and the top-k window. The two per-account results are joined on the key;
    an account with no debits gets an empty category list. ``context_json``
    is the record as ``json.dumps`` prints it.
    """
    keys = _keys(by)
    zero = F.lit(0).cast(MONEY_DECIMAL)
    per_cat = ledger.groupBy(*keys, CATEGORY).agg(
        exact_sum(F.when(F.col(TYPE) == CREDIT, F.col(AMOUNT))).alias("_inc"),
        exact_sum(F.when(F.col(TYPE) == DEBIT, F.col(AMOUNT))).alias("_deb"))
    item = F.when(F.col("_deb").isNotNull(), _category_item(to_cents(F.abs(F.col("_deb")))))
    acct = per_cat.groupBy(*keys).agg(
        F.coalesce(F.try_sum("_inc"), zero).alias("_inc"),
        F.abs(F.coalesce(F.try_sum("_deb"), zero)).alias("_exp"),
        F.sort_array(F.collect_list(item)).alias("_items"))
    inc, exp = to_cents(F.col("_inc")), to_cents(F.col("_exp"))
    net = to_cents(F.col("_inc") - F.col("_exp"))
    kpi = acct.select(*keys, inc.alias("total_income"), exp.alias("total_expenses"),
                      net.alias("net_savings"),
                      round_half_up(safe_ratio_pct(net, inc), 2).alias("savings_rate_pct"),
                      *_category_texts(F.col("_items")))
    ctx = kpi.join(_top_lists(ledger, k, keys), keys, "left")
    top = F.coalesce(F.col("top_lines"), F.array().cast("array<string>"))
    top_json = F.concat(F.lit("["), F.array_join(F.transform(top, json_string), ", "), F.lit("]"))
    context_json = F.concat(
        F.lit('{"total_income": '), amount_text(F.col("total_income")),
        F.lit(', "total_expenses": '), amount_text(F.col("total_expenses")),
        F.lit(', "net_savings": '), amount_text(F.col("net_savings")),
        F.lit(', "savings_rate_pct": '), amount_text(F.col("savings_rate_pct")),
        F.lit(', "category_expenses": '), F.col("category_json"),
        F.lit(', "top_5_largest_transactions": '), top_json, F.lit("}"))
    return ctx.select(
        *keys, "total_income", "total_expenses", "net_savings", "savings_rate_pct",
        F.col("categories").alias("category_expenses"),
        top.alias("top_5_largest_transactions"),
        "category_json", "category_json_indented", context_json.alias("context_json"))


def _kpi_values(prefix_rate: str = "savings_rate_pct") -> dict[str, Column]:
    return {"income": float_commas_text(F.col("total_income")),
            "expenses": float_commas_text(F.col("total_expenses")),
            "net": float_commas_text(F.col("net_savings")),
            "rate": amount_text(F.col(prefix_rate))}


def review_prompt(ledger: DataFrame, advisor: str = DEFAULT_ADVISOR, k: int = 5,
                  by=ACCOUNT) -> DataFrame:
    """The financial-review prompt text, one row per account."""
    keys = _keys(by)
    ctx = financial_context(ledger, k, keys)
    vals = _kpi_values()
    vals["categories_indented"] = F.col("category_json_indented")
    vals["top_lines"] = F.array_join(
        F.transform("top_5_largest_transactions", lambda x: F.concat(F.lit("- "), x)), "\n")
    return ctx.select(*keys, _fill(REVIEW_PROMPT.replace("{advisor}", advisor), vals).alias("prompt"))


def chat_context(ledger: DataFrame, advisor: str = DEFAULT_ADVISOR, k: int = 5,
                 by=ACCOUNT) -> DataFrame:
    """The chat system-context text, one row per account."""
    keys = _keys(by)
    ctx = financial_context(ledger, k, keys)
    vals = _kpi_values()
    vals["categories"] = F.col("category_json")
    vals["top_list"] = F.concat(
        F.lit("["), F.array_join(F.transform("top_5_largest_transactions", py_str_repr), ", "),
        F.lit("]"))
    return ctx.select(*keys, _fill(CHAT_CONTEXT.replace("{advisor}", advisor), vals).alias("context"))


def dialog_assembly(conversations: DataFrame, ledger: DataFrame, advisor: str = DEFAULT_ADVISOR,
                    conv_account: str = "conv_id") -> DataFrame:
    """Chat request rows: two opening turns per conversation, then its history.

    Output ``(conv_id, position, role, text)``, ordered by ``position``:
    -2 the context as a ``user`` turn, -1 the greeting as ``model``, then each
    history turn at its own ``turn`` with role ``user`` kept and every other
    role sent as ``model``. The newest message is already the last history
    turn and is not repeated. No list is built per conversation: history rows
    are a projection, openings one row per conversation.
    """
    convs = conversations.select("conv_id", F.col(conv_account).alias("_acct")).distinct()
    # Contexts are only built for accounts that have a conversation.
    asked = ledger.join(convs.select(F.col("_acct").alias(ACCOUNT)).distinct(), ACCOUNT, "left_semi")
    ctx = chat_context(asked, advisor).withColumnRenamed(ACCOUNT, "_acct")
    opening_user = CHAT_OPENING_USER.replace("{advisor}", advisor)
    opening = (convs.join(ctx, "_acct", "left")
               .select("conv_id", F.coalesce(F.col("context"), F.lit("")).alias("context")))
    # Both opening turns from one row per conversation (one branch, one scan).
    turns = F.array(
        F.struct(F.lit(-2).cast("bigint").alias("position"), F.lit("user").alias("role"),
                 _fill(opening_user, {"context": F.col("context")}).alias("text")),
        F.struct(F.lit(-1).cast("bigint").alias("position"), F.lit("model").alias("role"),
                 F.lit(CHAT_OPENING_MODEL.replace("{advisor}", advisor)).alias("text")))
    openings = opening.select("conv_id", F.inline(turns))
    hist = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("position"),
        F.when(F.col("role") == "user", F.lit("user")).otherwise(F.lit("model")).alias("role"),
        F.col("text"))
    return openings.unionByName(hist)


def text_blocks(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Split review text into blocks: heading, bullet or paragraph, in order.

    Lines are split on ``\\n``, stripped, blanks dropped. ``#`` lines are
    headings (all leading ``#`` removed, bold markers kept); lines starting
    with ``-`` or ``*`` are bullets (marker removed after the bold rewrite);
    others are paragraphs. ``markup`` is the rendered text.
    """
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "_raw"))
    s = py_strip(F.col("_raw"))
    bold = bold_to_tags(s)
    heading = py_strip(F.regexp_replace(s, "^#+", ""))
    bullet = F.regexp_replace(bold, f"^[-*]{PY_SPACE_CLASS}*", "")
    kind = (F.when(s.startswith("#"), F.lit("heading"))
             .when(s.startswith("-") | s.startswith("*"), F.lit("bullet"))
             .otherwise(F.lit("paragraph")))
    text = (F.when(kind == "heading", heading).when(kind == "bullet", bullet).otherwise(bold))
    markup = (F.when(kind == "heading", F.concat(F.lit("<b>"), text, F.lit("</b>")))
               .when(kind == "bullet", F.concat(F.lit("• "), text)).otherwise(text))
    return (lines.where(s != "")
            .select(id_col, "line_no", kind.alias("kind"), text.alias("text"), markup.alias("markup")))


def kpi_display(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Dashboard KPI strings: ``$1,234.56`` and ``12.3%`` plus the rate colour."""
    keys = _keys(by)
    k = kpi_summary(ledger, keys)
    return k.select(*keys, money_text(F.col("total_income")).alias("income_text"),
                    money_text(F.col("total_expenses")).alias("expenses_text"),
                    money_text(F.col("net_savings")).alias("net_text"),
                    percent_text(F.col("savings_rate"), 1).alias("rate_text"), "rate_band")


def transactions_display(ledger: DataFrame) -> DataFrame:
    """Transaction table with ``YYYY-MM-DD`` dates and money text."""
    return ledger.select(*[c for c in ledger.columns],
                         F.date_format(F.col(DATE), "yyyy-MM-dd").alias("date_text"),
                         money_text(F.col(AMOUNT)).alias("amount_text"))


def report_kpis(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Executive summary table: four (position, metric, value) rows per account."""
    keys = _keys(by)
    k = kpi_summary(ledger, keys)
    texts = [money_text(F.col("total_income")), money_text(F.col("total_expenses")),
             money_text(F.col("net_savings")), percent_text(F.col("savings_rate"), 1)]
    rows = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(lbl).alias("metric"), t.alias("value"))
                     for i, (lbl, t) in enumerate(zip(REPORT_KPI_LABELS, texts))])
    return k.select(*keys, F.inline(rows))


def report_categories(ledger: DataFrame, by=ACCOUNT) -> DataFrame:
    """Category table: amount and share of all debits, as report text."""
    from tallyspark.operators.aggregates import category_share
    keys = _keys(by)
    c = category_share(ledger, keys)
    return c.select(*keys, CATEGORY, "Amount", "share_pct",
                    money_text(F.col("Amount")).alias("amount_text"),
                    percent_text(F.col("share_pct"), 1).alias("share_text"))


def report_document(ledger: DataFrame, generated_at: str, review_text: DataFrame | None = None,
                    title: str = REPORT_TITLE, by=ACCOUNT) -> DataFrame:
    """The review report of each account as ordered content rows.

    Columns ``(account_id, section, seq, kind, cell1, cell2, cell3)``, ordered
    by (section, seq): title and generated-at line, section 1 with the KPI
    table, section 2 with the category table (largest first), a page break,
    section 3 with the review text blocks when ``review_text``
    (``account_id, text``) is given. ``generated_at`` is a timestamp text
    (an explicit parameter, not the clock). A renderer only lays these out.
    """
    keys = _keys(by)
    # One aggregate by (account, category) gives both tables: the account's own figures are windows over its categories.
    per_cat = ledger.groupBy(*keys, CATEGORY).agg(
        exact_sum(F.when(F.col(TYPE) == CREDIT, F.col(AMOUNT))).alias("_inc"),
        F.abs(exact_sum(F.when(F.col(TYPE) == DEBIT, F.col(AMOUNT)))).alias("_spent"))
    mine = Window.partitionBy(*keys)
    zero = F.lit(0).cast(MONEY_DECIMAL)
    whole = lambda c: F.coalesce(F.try_sum(c).over(mine), zero)
    largest = F.row_number().over(mine.orderBy(F.col("Amount").desc_nulls_last(), F.col(CATEGORY)))
    # The net is taken from exact sums; spending adds up to the same as the debits.
    per_cat = per_cat.withColumn("Amount", to_cents("_spent")).withColumns({
        "_all_in": whole("_inc"), "_all_out": whole("_spent"), "_rank": largest})
    inc, exp, net = to_cents("_all_in"), to_cents("_all_out"), to_cents(F.col("_all_in") - F.col("_all_out"))
    kpi = per_cat.select(*keys, CATEGORY, "Amount", "_rank", inc.alias("total_income"), exp.alias("total_expenses"),
                         net.alias("net_savings"), safe_ratio_pct(net, inc).alias("savings_rate"))
    stamp = F.concat(F.lit(REPORT_GENERATED),
                     F.date_format(F.lit(generated_at).cast("timestamp_ntz"), REPORT_GENERATED_FORMAT))

    def row(section, seq, kind, c1, c2=None, c3=None):
        return F.struct(F.lit(section).alias("section"), F.lit(seq).cast("bigint").alias("seq"),
                        F.lit(kind).alias("kind"), c1.cast("string").alias("cell1"),
                        (c2 if c2 is not None else F.lit(None)).cast("string").alias("cell2"),
                        (c3 if c3 is not None else F.lit(None)).cast("string").alias("cell3"))

    texts = [money_text(F.col("total_income")), money_text(F.col("total_expenses")),
             money_text(F.col("net_savings")), percent_text(F.col("savings_rate"), 1)]
    fixed = [row(0, 0, "title", F.lit(title)), row(0, 1, "subtitle", stamp),
             row(1, 0, "heading", F.lit(REPORT_SECTION_1)),
             row(1, 1, "table_header", F.lit(REPORT_KPI_HEADER[0]), F.lit(REPORT_KPI_HEADER[1]))]
    fixed += [row(1, 2 + i, "table_row", F.lit(lbl), t) for i, (lbl, t) in enumerate(zip(REPORT_KPI_LABELS, texts))]
    fixed += [row(2, 0, "heading", F.lit(REPORT_SECTION_2)),
              row(2, 1, "table_header", *[F.lit(h) for h in REPORT_CATEGORY_HEADER]),
              row(3, 0, "page_break", F.lit(None)),
              row(4, 0, "heading", F.lit(REPORT_SECTION_3))]
    share = percent_text(safe_ratio_pct(F.col("Amount"), F.col("total_expenses")), 1)
    category = F.struct(F.lit(2).alias("section"), (F.col("_rank") + 1).cast("bigint").alias("seq"), F.lit("table_row").alias("kind"),
                        F.col(CATEGORY).alias("cell1"), money_text(F.col("Amount")).alias("cell2"), share.alias("cell3"))
    # The account's fixed rows come with its first category; one without spending has no table row.
    rows = F.concat(F.when(F.col("_rank") == 1, F.array(*fixed)).otherwise(F.array()),
                    F.when(F.col("Amount").isNotNull(), F.array(category)).otherwise(F.array()))
    out = kpi.select(*keys, F.inline(rows))
    if review_text is not None:
        blocks = text_blocks(review_text.select(F.col(ACCOUNT).alias("_doc"), "text"), "text", "_doc")
        out = out.unionByName(blocks.select(
            F.col("_doc").alias(keys[0]), F.lit(4).alias("section"),
            (F.col("line_no") + 1).cast("bigint").alias("seq"), F.col("kind"),
            F.col("markup").alias("cell1"), F.lit(None).cast("string").alias("cell2"),
            F.lit(None).cast("string").alias("cell3")))
    return out
