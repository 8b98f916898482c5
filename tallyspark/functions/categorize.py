"""Keyword categoriser: ordered rules, substring match, first hit wins.

The rules are data; ``categorize`` turns any rule list into one expression
over ``lower(description)``: a CASE in generated code, or one pattern for long lists.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default rule list. Order matters (first hit wins); each
# keyword is a lower-case substring of the lower-cased description.
DEFAULT_RULES: list[tuple[str, list[str]]] = [
    ("Income", ["salary", "paycheck", "payroll", "income", "direct deposit", "dividend",
                "interest"]),
    ("Rent & Housing", ["rent", "landlord", "housing", "mortgage", "apartment", "hoa"]),
    ("Food & Dining", ["food", "dining", "restaurant", "cafe", "grocery", "whole foods", "trader",
                       "safeway", "kroger", "burger", "sushi", "starbucks", "eats", "pizza", "pub",
                       "deli", "market"]),
    ("Utilities & Bills", ["power", "light", "electric", "water", "internet", "comcast", "netflix",
                           "spotify", "subscription", "utility", "utilities", "bill", "insurance",
                           "phone", "verizon", "t-mobile"]),
    ("Shopping & Entertainment", ["amazon", "target", "apple", "walmart", "store", "retail",
                                  "clothing", "shopping", "movie", "ticket", "mall", "best buy",
                                  "steam", "game"]),
    ("Investments & Savings", ["vanguard", "etf", "stock", "investment", "savings", "fidelity",
                               "crypto", "coinbase", "ira", "401k"]),
    ("Travel & Transport", ["gas", "fuel", "chevron", "shell", "uber", "lyft", "transit", "metro",
                            "travel", "flight", "airline", "cab", "parking", "toll"]),
]
DEFAULT_OTHER = "Other"


# Above so many keywords a CASE no longer fits the JVM's methods: one pattern takes its place.
MOST_CASES = 300


def categorize(description, rules=None, other: str = DEFAULT_OTHER, most_cases: int = MOST_CASES) -> Column:
    """The category of the first rule one of whose keywords is in the lower-cased text.

    Up to ``most_cases`` keywords this is a CASE in generated code (``contains``
    is a plain byte search); longer lists become one pattern. Both give the same.
    """
    rules = DEFAULT_RULES if rules is None else rules
    desc = F.col(description) if isinstance(description, str) else description
    text = F.lower(F.coalesce(desc, F.lit("")))
    if sum(len(keywords) for _, keywords in rules) > most_cases:
        return _by_pattern(text, rules, other)
    expr = None
    for category, keywords in rules:
        if not keywords:
            continue
        hit = None
        for kw in keywords:
            cond = text.contains(kw.lower())
            hit = cond if hit is None else (hit | cond)
        expr = F.when(hit, F.lit(category)) if expr is None else expr.when(hit, F.lit(category))
    return F.lit(other) if expr is None else expr.otherwise(F.lit(other))


def _by_pattern(text: Column, rules, other: str) -> Column:
    """The first rule by one look-ahead over all keywords.

    At each place of the text the pattern captures the longest keyword that
    begins there. All others that begin there are prefixes of it, so a keyword
    stands for the first rule of itself and its prefixes; the least of the
    captured ones decides.
    """
    first: dict[str, int] = {}
    for i, (_, keywords) in enumerate(rules):
        for kw in keywords:
            first.setdefault(kw.lower(), i)
    empty = first.pop("", len(rules))  # an empty keyword is in every text
    other = rules[empty][0] if empty < len(rules) else other
    first = {kw: i for kw, i in first.items() if i < empty}
    if not first:
        return F.lit(other)
    rank = {kw: min(first[kw[:n]] for n in range(1, len(kw) + 1) if kw[:n] in first) for kw in first}
    order = sorted(rank, key=lambda kw: (rank[kw], kw))
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({_longest_of(order)}))"), F.lit(1)))
    places = F.transform(found, lambda kw: F.array_position(F.array(*[F.lit(k) for k in order]), kw))
    categories = F.array(*[F.lit(rules[rank[kw]][0]) for kw in order])
    return F.coalesce(F.get(categories, (F.array_min(places) - 1).cast("int")), F.lit(other))


def _longest_of(words: list[str]) -> str:
    """A pattern of the longest of some words at a place: common beginnings are written once."""
    tree: dict = {}
    for word in words:
        node = tree
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [_literal(ch) + pattern(below) for ch, below in sorted(node.items()) if ch]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?+" if "" in node else "")

    return pattern(tree)


def _literal(ch: str) -> str:
    return ch if ch.isalnum() else rf"\x{{{ord(ch):x}}}"
