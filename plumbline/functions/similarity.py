"""Similarity of short lines, and what it says of who changed a log."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else difflib.SequenceMatcher(a=a, b=b).ratio()


def sequence_ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all characters, by longest matching blocks; null for a null side."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_ratio(s, t) for s, t in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def nearest_line(target: Column, lines: Column) -> Column:
    """{score, line}: of an array of lines the most similar one, the first of equals; without lines 0 and empty."""

    @F.pandas_udf("score double, line string")
    def run(t: pd.Series, ls: pd.Series) -> pd.DataFrame:
        out = []
        for own, others in zip(t, ls, strict=True):
            best = (0.0, "")
            for line in others if others is not None and own is not None else ():
                score = _ratio(own.strip(), line.strip())
                if score > best[0] or not best[1]:
                    best = (score, line)
            out.append(best)
        return pd.DataFrame(out, columns=["score", "line"])

    return run(target, lines)


def mixed_review(change: Column, attribution: Column, own: Column, agent: Column, committed: Column, nearest: Column, least: float = 0.72) -> Column:
    """What the versions of a file of mixed authorship say of a log line `own`: agent and committed are the log lines of
    the two versions, nearest the result of nearest_line among the agent's."""
    a, c = F.array_contains(agent, own), F.array_contains(committed, own)
    return (
        F.when((attribution != "mixed") | (F.size(agent) == 0), "not_review_target")
        .when((change == "add") & c & ~a & (nearest["score"] >= least), "confirmed_by_version_diff_human_modified_ai_log")
        .when((change == "remove") & a & ~c, "confirmed_by_version_diff_human_removed_ai_log").when(c & a, "mixed_file_agent_log_unchanged")
        .when((change == "add") & c & ~a, "likely_human_added_log_in_mixed_file").otherwise("same_file_agent_log_edit_needs_manual_review")
    )
