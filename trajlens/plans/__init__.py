"""Compositions of operators: profile, prepare, fit, evaluate, compare."""

from trajlens.plans.steps import (
    Prepared,
    PrepareConfig,
    evaluate,
    fit_and_threshold,
    prepare,
    profile,
    report_rows,
    score_models,
)

__all__ = ["PrepareConfig", "Prepared", "evaluate", "fit_and_threshold", "prepare", "profile", "report_rows", "score_models"]
