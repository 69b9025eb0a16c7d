"""Forests grown together: Spark's own trees where nothing is drawn, and what must hold of the rest."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.catalog import model_queries
from freshet.functions import complete_cases, is_complete
from freshet.plans import forests, training
from freshet.plans.forests import fit_together
from freshet.plans.scoring import score_table
from freshet.plans.training import ForestModel, feature_importance, fit
from freshet.sources import load_model, save_model
from freshet.storage import new_path

SPEC = training.FeatureSpec(numeric=("a", "b", "c"), category="location", trees=6, depth=6)
PLACES = replace(SPEC, numeric=("b",))
BARE = replace(SPEC, use_category=False, weighted=False, numeric=("a", "c"))


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows are positive, so that weights are exact; 50 locations, one of them often positive."""
    made = spark.range(3000).selectExpr(
        "id",
        "cast(id % 3 = 0 as int) AS flood_event",
        "cast(id * 7919 % 1009 + if(id % 3 = 0, hash(id, 2) % 300, 0) as double) AS a",
        "cast(id % 11 as double) AS b",
        "cast(hash(id) % 100 as double) / 3 AS c",
        "concat('p', if(id % 3 = 0 and hash(id, 5) % 2 = 0, id % 7, abs(hash(id, 1)) % 50)) AS location",
        "timestamp_ntz '2024-03-01' AS datetime",
    )
    # One partition: where rows are dealt otherwise, samples fall otherwise.
    return made.coalesce(1).localCheckpoint()


def trees(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.forest.trees]


@pytest.fixture
def undrawn(monkeypatch):
    plain = training.build_pipeline

    def build(*args):
        made = plain(*args)
        made.getStages()[-1].setBootstrap(False)
        return made

    monkeypatch.setattr(training, "build_pipeline", build)
    monkeypatch.setattr(forests, "build_pipeline", build)


@pytest.mark.parametrize("use_category", [False, True])
@pytest.mark.parametrize("weighted", [False, True])
def test_trees_are_sparks_where_nothing_is_drawn(rows, undrawn, use_category, weighted):
    """One tree takes all inputs: on all rows it has Spark's nodes, splits, leaves and importances."""
    spec = replace(SPEC, trees=1, depth=8, use_category=use_category, weighted=weighted)
    ours, sparks = fit_together(rows, {"one": spec})["one"], fit(rows, spec)
    assert trees(ours) == trees(sparks) and len(trees(ours)[0]) > 1000
    same = ours.forest.featureImportances.toArray()
    assert same == pytest.approx(sparks.forest.featureImportances.toArray())
    scored = [score_table(m, rows, spec).orderBy("id").collect() for m in (ours, sparks)]
    assert scored[0] == scored[1]


def test_each_forest_is_the_one_it_is_alone(rows, monkeypatch):
    """Forests do not depend on those grown with them, though they share blocks and samples of rows."""
    monkeypatch.setattr(forests, "BLOCK_ROWS", 700)
    specs = {"all": SPEC, "places": PLACES, "bare": BARE}
    together = fit_together(rows, specs)
    assert [*together] == [*specs]
    for name, spec in specs.items():
        made = together[name]
        assert made.forest.getNumTrees == 6 and len(set(trees(made))) == 6
        assert max(t.depth for t in made.forest.trees) == 6
        assert trees(fit_together(rows, {name: spec})[name]) == trees(made)
        assert {r.feature for r in feature_importance(made).collect()} == set(spec.inputs)


def test_counts_beyond_the_bytes_take_more_passes(rows, monkeypatch):
    """Trees are dealt over passes; tasks send counts on before cells are full. Forests are the same."""
    specs = {"all": SPEC, "bare": BARE}
    monkeypatch.setattr(forests, "BLOCK_ROWS", 64)
    whole = {name: trees(m) for name, m in fit_together(rows, specs).items()}
    passes = []
    plain = forests._level

    def level(blocks, plans, grown, chunk, *more):
        passes.append(len(chunk))
        return plain(blocks, plans, grown, chunk, *more)

    monkeypatch.setattr(forests, "_level", level)
    monkeypatch.setattr(forests, "COUNT_BYTES", 20_000)
    monkeypatch.setattr(forests, "CELL_ROWS", 100)
    assert {name: trees(m) for name, m in fit_together(rows, specs).items()} == whole
    assert passes[0] == 12 and len(passes) > 6 and sum(passes) <= 12 * 6


def test_four_forests_go_through_the_rows_together(spark, small_dir, monkeypatch):
    """The levels of all variants' forests are shared passes: no forest is fitted on its own."""
    passes = []
    plain = forests._level

    def level(blocks, plans, grown, chunk, *more):
        passes.append({name for _, name in chunk})
        return plain(blocks, plans, grown, chunk, *more)

    monkeypatch.setattr(forests, "_level", level)
    monkeypatch.setattr(model_queries, "fit", None)
    found = model_queries.rf_variants(spark, small_dir).collect()
    assert {r.variant for r in found} == set(model_queries.VARIANTS)
    assert all(r.in_range and r.left_out == 0 and r.n_rows == found[0].n_rows > 0 for r in found)
    assert passes[0] == set(model_queries.VARIANTS) and len(passes) <= 10


def test_batch_scores_are_the_pipelines(spark, rows):
    """Votes, probabilities and predictions are to the last bit those of Spark's model, also saved."""
    made = fit_together(rows, {"all": SPEC, "bare": BARE})
    some = rows.withColumn("location", F.when(F.col("id") % 5 != 0, F.col("location")).otherwise("new"))
    for model in made.values():
        plain = ForestModel(model.pipeline, model.encoding).transform(some).orderBy("id").collect()
        assert model.transform(some).orderBy("id").collect() == plain
        path = new_path(spark, "grown-model")
        save_model(model, path)
        assert load_model(path).transform(some).orderBy("id").collect() == plain


def test_incomplete_rows_count_for_the_forests_that_can_use_them(rows):
    """Rows, weights, splits and numbers of a forest come from the rows complete in its own inputs."""
    holed = rows.withColumns(
        {
            "a": F.when(F.col("id") % 7 != 0, F.col("a")),
            "c": F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c")),
        }
    )
    made = fit_together(holed, {"all": SPEC, "places": PLACES, "bare": BARE})
    drawn = {}
    for name, spec in (("all", SPEC), ("places", PLACES), ("bare", BARE)):
        used = complete_cases(holed, spec.required)
        assert used.count() == holed.filter(is_complete(holed, spec.required)).count()
        nodes = [t._call_java("rootNode").impurityStats() for t in made[name].forest.trees]
        rows_of_trees = [s.rawCount() for s in nodes]
        drawn[name] = np.mean(rows_of_trees)
        # Six samples as large as the rows: 5 times the mean's deviation on either side.
        assert abs(drawn[name] - used.count()) < 5 * np.sqrt(used.count() / 6)
    assert drawn["all"] < drawn["places"]


def test_samples_are_poisson():
    bags = [forests._bag(42, t, 7, 200_000) for t in range(3)]
    assert (bags[0] == forests._bag(42, 0, 7, 200_000)).all()
    expected = [np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120)]
    for bag in bags:
        for k, share in enumerate(expected):
            assert abs((bag == k).mean() - share) < 5 * np.sqrt(share / 200_000)
    assert abs(np.corrcoef(bags)[0, 1]) < 0.02


def test_few_and_one_sided_rows(spark, rows):
    """Fewer rows than bins; inputs that never change; one class alone is refused."""
    few = rows.filter("id < 12").withColumn("c", F.lit(1.0))
    made = fit_together(few, {"all": SPEC, "bare": BARE})
    for name, spec in (("all", SPEC), ("bare", BARE)):
        assert score_table(made[name], rows, spec).count() == rows.count()
    with pytest.raises(ValueError, match="classes"):
        fit_together(rows.filter("flood_event = 0"), {"all": SPEC})
    with pytest.raises(ValueError, match="one label"):
        fit_together(rows, {"all": SPEC, "other": replace(SPEC, label="b")})
