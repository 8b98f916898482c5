"""Long rule lists: one pattern gives what the CASE gives, and thousands of rules run."""

import random

from pyspark.sql import functions as F

from tallyspark.functions.categorize import DEFAULT_RULES, categorize


def plain(text, rules, other="Other"):
    low = (text or "").lower()
    return next((c for c, kws in rules if any(k.lower() in low for k in kws)), other)


def test_pattern_and_case_and_plain_agree(spark):
    rng = random.Random(4)
    pieces = [k for _, kws in DEFAULT_RULES for k in kws] + ["a", " ", "x.", "ST", "é", "(b", "\n"]
    texts = ["".join(rng.choice(pieces)[: rng.randint(1, 9)] for _ in range(rng.randint(0, 5))) for _ in range(800)] + [None, ""]
    mixed = [("A", ["gasoline", "st."]), ("B", ["gas", "(b", "a\n"]), ("C", []), ("D", ["s", "asol", "É"]), ("E", ["x"])]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for rules in (DEFAULT_RULES, mixed, [("All", [""]), ("B", ["b"])], [("B", ["b"]), ("All", ["zz", ""]), ("X", ["x"])], []):
        rows = df.select("t", categorize("t", rules).alias("case"), categorize("t", rules, most_cases=-1).alias("pattern")).collect()
        for r in rows:
            assert r["case"] == r["pattern"] == plain(r["t"], rules), (r["t"], rules)


def test_five_thousand_rules(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(4, 9)))
    rules = [(f"cat{i}", [word(), word().upper()]) for i in range(5000)]
    texts = [" ".join(word() for _ in range(4)) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", categorize(F.col("t"), rules).alias("c")).collect()
    assert all(r["c"] == plain(r["t"], rules) for r in got) and len({r["c"] for r in got}) > 100
