"""Drift of current traffic against the frozen reference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from creditmill.contract.schema import KEY, LABEL
from creditmill.operators.drift import count_cells, count_logged, drift_tests
from creditmill.operators.sampling import stratified_sample
from creditmill.plans.feature_store import reference_rows
from creditmill.plans.prediction_log import current_features

# --- fixed values ---------------------------------------------------------------------------
REFERENCE_ROWS = 10000
CURRENT_ROWS = 100


def build_reference(app: DataFrame, store: DataFrame, n: int = REFERENCE_ROWS, seed: int = 42) -> DataFrame:
    """``n`` contract rows with the label mix of all applications that have a store row."""
    return stratified_sample(reference_rows(app, store), KEY, LABEL, n, seed)


def freeze_reference(reference: DataFrame, contract: Sequence[str], path: str) -> None:
    """Keeps of the reference what the tests need: its counted cells, in ranges of feature and value."""
    cells = count_cells(reference, [c for c in contract if c in set(reference.columns)])
    cells.repartitionByRange("feature", "value").sortWithinPartitions("feature", "value").write.mode("overwrite").parquet(path)


def drift_report(frozen: DataFrame, log: DataFrame, contract: Sequence[str], limit: int = CURRENT_ROWS) -> DataFrame:
    """Tests the last ``limit`` successful log rows against the cells of ``freeze_reference``.

    Every contract feature with a value on both sides has a row; the reference's rows are not read again.
    """
    return drift_tests(frozen, count_logged(current_features(log, limit), contract))
