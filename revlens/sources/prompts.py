"""Prompt templates as data.

A template is cut at its placeholders once, when the plan is built; review text
is then concatenated, never substituted into a pattern, so text that looks like
a placeholder or a regex group stays as it is.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTIMENT = (
    "Task: opinion mining, one label for one text.\n"
    "Allowed answers: positive / negative / neutral. Print the answer and stop.\n"
    "Count what the writer thinks of the product or its maker. A text that only states facts, "
    "or weighs good against bad without deciding, is neutral. Read irony as it is meant.\n"
    "Text:\n{review}\nAnswer:"
)
SUMMARY = (
    "Condense the text between the marks to a single statement of at most forty words. Name the "
    "product part, the fault or merit, and any wish; add nothing of your own.\n<<<\n {review} \n>>>"
)
RESPONSE_V1 = (
    "Customer name: {user_name}\nCustomer text:\n{review}\n\n"
    "Draft the shop's public answer: thank or apologise as the text deserves, say for every "
    "complaint what happens now, promise nothing that is not in the text, sign as the service "
    "desk, stay under ninety words."
)
RESPONSE_V2 = (
    "You draft public answers for a shop's service desk: courteous, concrete, under ninety words, "
    "addressed by name, without promises that the text does not support.\n\n"
    "Customer name: {user_name}\nCustomer text:\n{review}"
)

# (task, version) -> template; version 1 is used by the single-task comparisons,
# version 2 by the end-to-end report.
TEMPLATES: dict[tuple[str, int], str] = {
    ("sentiment", 1): SENTIMENT,
    ("sentiment", 2): SENTIMENT,
    ("summary", 1): SUMMARY,
    ("summary", 2): SUMMARY,
    ("response", 1): RESPONSE_V1,
    ("response", 2): RESPONSE_V2,
}


def pieces(template: str) -> list[tuple[str, str]]:
    """[('text', '...'), ('column', 'review'), ...] in order."""
    out = []
    for part in re.split(r"(\{\w+\})", template):
        if not part:
            continue
        if part.startswith("{") and part.endswith("}"):
            out.append(("column", part[1:-1]))
        else:
            out.append(("text", part))
    return out


def render(template: str) -> Column:
    return F.concat(
        *[F.lit(v) if kind == "text" else F.col(v) for kind, v in pieces(template)]
    )


def render_sql(template: str) -> str:
    """The same prompt as a SQL expression, for the cross-engine check."""
    quoted = [
        "'" + v.replace("'", "''") + "'" if kind == "text" else v for kind, v in pieces(template)
    ]
    return " || ".join(quoted)
