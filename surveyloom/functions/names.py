"""Rules on column names: identifiers, component scores, run labels."""

from __future__ import annotations

import os
import re

# The naming conventions that mark identifiers, component scores
# and plot-axis columns.
IDENTIFIER_PATTERNS = (
    re.compile(r"^(?:id|uuid|guid)$", re.IGNORECASE),
    re.compile(r"[_\-\s]id$", re.IGNORECASE),
    re.compile(r"(?:[^A-Z]|^)ID$"),
)
SCORE_PATTERN = re.compile(r"^PC\d+(_|$)", re.IGNORECASE)
AXIS_PATTERN = re.compile(r"^(PC\d|Axis|Component|COMP_)", re.IGNORECASE)
ID_WORD_PATTERN = re.compile(r"\bid\b", re.IGNORECASE)


def is_identifier(name: str) -> bool:
    return any(p.search(name.strip()) for p in IDENTIFIER_PATTERNS)


def is_score_column(name: str) -> bool:
    return SCORE_PATTERN.match(name) is not None


def is_axis_like(name: str) -> bool:
    return AXIS_PATTERN.match(name) is not None


def names_an_id(name: str) -> bool:
    return ID_WORD_PATTERN.search(name) is not None


def clean_label(text: str) -> str:
    """A run label as part of a column name: its runs of letters, digits and hyphens, joined by one underscore."""
    return "_".join(re.findall(r"[A-Za-z0-9-]+", text))


def shared_label(names: list[str]) -> str | None:
    """The words several names begin or end with, whichever are longer, without counters; None if they share none."""
    if len(names) < 2:
        return None
    ends = (os.path.commonprefix(names), os.path.commonprefix([n[::-1] for n in names])[::-1])
    counters = r"[\d\W_]*"
    shared = [re.fullmatch(rf"{counters}(.*?){counters}" if i else rf"(.*?){counters}", e, re.DOTALL)[1] for i, e in enumerate(ends)]
    label = clean_label(max(shared, key=len))
    return label if len(label) > 1 else None


def score_names(label: str, k: int) -> list[str]:
    """Names of the columns a run of ``k`` components adds."""
    if label and k == 1:
        return [f"COMP_{label}"]
    return [f"PC{i}_{label}" if label else f"PC{i}" for i in range(1, k + 1)]


def owned_scores(columns: list[str], label: str) -> list[str]:
    """Columns left by an earlier run of the same label, whatever its size."""
    if not label:
        return [c for c in columns if re.fullmatch(r"PC\d+", c)]
    mine = re.compile(rf"PC\d+_{re.escape(label)}|COMP_{re.escape(label)}")
    return [c for c in columns if mine.fullmatch(c)]
