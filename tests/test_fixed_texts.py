"""Texts and rules that are outputs: any drift from these digests is a change of results."""

import hashlib

from tallyspark.functions.categorize import DEFAULT_RULES
from tallyspark.operators import context


def digest(x) -> str:
    return hashlib.sha256(repr(x).encode()).hexdigest()[:16]


def test_categoriser_rules():
    assert [c for c, _ in DEFAULT_RULES] == ["Income", "Rent & Housing", "Food & Dining", "Utilities & Bills",
                                             "Shopping & Entertainment", "Investments & Savings", "Travel & Transport"]
    assert digest([(c, list(k)) for c, k in DEFAULT_RULES]) == "3dd9bf8a8a8091c4"


def test_prompt_templates():
    assert digest(context.REVIEW_PROMPT) == "8b582937243c7ed1"
    assert digest((context.CHAT_CONTEXT, context.CHAT_OPENING_USER, context.CHAT_OPENING_MODEL)) == "01a8297c86f91006"


def test_report_labels():
    assert digest((context.REPORT_TITLE, context.REPORT_KPI_LABELS, context.REPORT_KPI_HEADER, context.REPORT_CATEGORY_HEADER,
                   context.REPORT_SECTION_1, context.REPORT_SECTION_2, context.REPORT_SECTION_3)) == "b6a3d3de58c291dc"
