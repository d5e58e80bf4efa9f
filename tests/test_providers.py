"""The provider registry: files, deep merge, errors, and a run by a provider's name."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from logtide import providers
from logtide.functions.columns import LOC
from logtide.operators.locations import FeatureGroup
from logtide.operators.rules import BASE_TAXONOMY
from logtide.plans.run import label_log

CONFIG = """
schema: {preset: canonical, min_year: 2001, user_field: who}
behavior_type:
  organic:
    - {id: only_one, unique_users: {max: 3}}
automation_category: {new_kind: [{id: x, unique_users: {min: 1}}]}
rule_based: {organic_max_users: 7}
"""


@pytest.fixture
def from_file(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text(CONFIG)
    return providers.Provider("mine", {"schema": {"min_year": 2005}, "rule_based": {"bot_min_users": 9}}, str(path))


def test_file_and_overrides_are_merged(from_file):
    assert (from_file.schema.min_year, from_file.schema.user_field) == (2005, "who")
    assert (from_file.rules.organic_max_users, from_file.rules.bot_min_users) == (7, 9)
    assert from_file.behavior_type["organic"] == [{"id": "only_one", "unique_users": {"max": 3}}]
    assert from_file.behavior_type["automated"] == BASE_TAXONOMY["behavior_type"]["automated"]
    assert set(from_file.automation_category) == {"bot", "legitimate_automation", "new_kind"}
    assert "new_kind" not in BASE_TAXONOMY["automation_category"]


def test_errors_name_what_is_wrong(tmp_path):
    with pytest.raises(ValueError, match="unknown provider 'none'"):
        providers.get_provider("none")
    with pytest.raises(FileNotFoundError):
        providers.Provider("x", config_path=str(tmp_path / "gone.yaml")).schema
    with pytest.raises(ValueError, match="min_yaer"):
        providers.Provider("x", {"schema": {"min_yaer": 3}}).schema
    with pytest.raises(ValueError, match="rule_based"):
        providers.Provider("x", {"rule_based": {"nothing": 3}}).rules
    with pytest.raises(ValueError, match="no extractors"):
        providers.Provider("x").run_config(("odd",))
    (tmp_path / "list.yaml").write_text("- 1")
    with pytest.raises(ValueError, match="mapping"):
        providers.Provider("x", config_path=str(tmp_path / "list.yaml")).settings
    (tmp_path / "empty.yaml").write_text("")
    assert providers.Provider("x", config_path=str(tmp_path / "empty.yaml")).taxonomy == BASE_TAXONOMY


def test_a_run_by_name_uses_schema_rules_and_extractors(make_log):
    twice = FeatureGroup("twice", from_table=lambda t: t.selectExpr(LOC, "total_downloads * 2 AS twice"))
    providers.register_provider(providers.Provider("test", {
        "schema": {"preset": "canonical", "min_year": 2001},
        "behavior_type": {"automated": [{"id": "busy", "total_downloads": {"min": 5}}], "organic": []},
    }, extractors=(twice,)))
    assert "test" in providers.provider_names()
    start = datetime(2024, 1, 1)
    log = make_log([{"ts": start + timedelta(hours=i), "geo_location": f"{i % 2 * (i > 3)}.0,1.0", "usr": f"u{i}"}
                    for i in range(12)]).log
    config = providers.get_provider("test").run_config(anomaly=False, groups=())
    assert config.schema.min_year == 2001
    rows = {r[LOC]: r for r in label_log(log, config).locations.collect()}
    assert {k: (r["behavior_type"], r["twice"]) for k, r in rows.items()} == {
        "0.0,1.0": ("automated", 16), "1.0,1.0": ("organic", 8)}
