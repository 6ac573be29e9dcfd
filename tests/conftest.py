from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
for folder in (ROOT, ROOT / "tests"):
    if str(folder) not in sys.path:
        sys.path.insert(0, str(folder))

from compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield session(4)


@pytest.fixture(scope="session")
def small() -> str:
    return "/root/testdata/sf0.001"


def rows(df, *columns):
    """Rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in chosen.collect())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
