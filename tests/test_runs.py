"""Two runs that differ by whole bundles."""

from pathlib import Path

import pytest

from chronoloom.plans.queries import facts
from chronoloom.plans.queries.registry import forget

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables")
def test_lines_of_two_runs_are_joined_and_folded_once(spark, monkeypatch):
    asked = []
    made = facts.tables.item_bullets
    monkeypatch.setattr(facts.tables, "item_bullets", lambda *a: asked.append(a) or made(*a))
    forget()
    facts._changes(spark, FOLDER)
    assert len(asked) == 1
    forget()
