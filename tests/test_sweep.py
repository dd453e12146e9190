import json

from fedsight.operators import sweep as sw


def test_experiment_rows_numbering_and_defaults(spark, tmp_path):
    cfg = {"experiment_groups": [
        {"group_name": "plain", "experiments": [{"name": "first_run", "task": "mortality"}]},
        {"group_name": "noise_levels", "experiments": [{"name": "eps1"}, {"name": "eps0.1", "task": "los"}]}]}
    p = tmp_path / "c.json"
    p.write_text(json.dumps(cfg, indent=2))
    rows = sw.experiment_rows(spark, str(p), defaults={"task": "mortality"}).orderBy("experiment_id").collect()
    assert [(r["experiment_id"], r["group"], r["name"], r["task"]) for r in rows] == [
        (1, "plain", "first_run", "mortality"), (2, "noise_levels", "eps1", "mortality"),
        (3, "noise_levels", "eps0.1", "los")]


def test_experiment_sets(spark, tmp_path):
    cfg = {"privacy": {"none": {"epsilon": 0}, "high": {"epsilon": 0.1}}, "explainer": {"second_run": {"use_lime": True}}}
    p = tmp_path / "e.json"
    p.write_text(json.dumps(cfg))
    rows = sw.experiment_sets(spark, str(p)).orderBy("experiment_id").collect()
    assert [(r["experiment_id"], r["set_name"], r["experiment"]) for r in rows] == [
        (1, "privacy", "none"), (2, "privacy", "high"), (3, "explainer", "second_run")]
