from __future__ import annotations

import pytest

from chronoseal.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted(tuple(r) for r in picked.collect())
