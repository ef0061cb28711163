"""All registered queries that do not belong to the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from . import analysis, core, labelling, logs, weekly

MODULES = [core, analysis, weekly, labelling, logs]

#: Sums of doubles depend on the order of the rows in their last digits; these columns are rounded, in queries and SQL alike.
DIGITS = 9
ROUNDED = {
    "matched_gap": ["matched_a", "matched_b", "matched_gap"],
    "pair_comparison": ["matched_a", "matched_b", "matched_gap", "ci_low", "ci_high"],
    "before_after": ["matched_a", "matched_b", "matched_gap", "ci_low", "ci_high", "placebo_gap", "placebo_low", "placebo_high", "mde_points"],
    "poisson_bootstrap": ["ci_low", "ci_high"],
    "exact_bootstrap": ["ci_low", "ci_high"],
    "unpaired_change": ["a_low", "a_high", "b_low", "b_high", "gap_low", "gap_high"],
    "weighted_score": ["usage_weighted_score", "unweighted_mean", "covered_weight"],
    "weighted_intents": ["mean"],
    "routing_policies": ["one_and_done_rate", "refusal_rate", "correction_rate", "repeat_rate", "cost_per_1k", "one_and_done_change", "cost_change"],
    "tfidf_words": ["weight"],
    "tfidf_characters": ["weight"],
    "events_stream_weekly": ["total"],
    "story_numbers": ["mean_return", "repeat_rate", "one_and_done_rate", "correction_rate", "refusal_rate"],
    "classification_gate": ["macro_f1"],
    "run_facts": ["classifier_macro_f1"],
}


def _rounded(query: Callable, columns: list[str]) -> Callable:
    return lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: F.round(c, DIGITS) for c in columns})


def queries() -> dict[str, Callable]:
    found = {name: q for m in MODULES for name, q in m.QUERIES.items()}
    return found | {name: _rounded(found[name], columns) for name, columns in ROUNDED.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: text for m in MODULES for name, text in m.ORACLE_SQL.items()}
    for name, columns in ROUNDED.items():
        changed = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in columns)
        found[name] = f"SELECT * REPLACE ({changed}) FROM (\n{found[name]}\n)"
    return found
