"""Named queries over the shared test tables, each with its DuckDB oracle."""

from fedsight.plans.registry import ORACLES, QUERIES

MODULES = ["features_q", "clean_q", "relational_q", "sample_q", "eval_q", "agg_q", "report_q", "train_q", "perceptron_q", "explain_q", "io_q", "runs_q"]


def load_all() -> None:
    """Import every query module (registration happens at import)."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"fedsight.plans.{m}")


__all__ = ["QUERIES", "ORACLES", "load_all"]
