"""Plan shapes: the properties the scale design relies on, read from the
physical plans (`explain`), so a regression shows up as a failing test."""

import pytest
from pyspark.sql import functions as F

from paths import SF01
from tessera.plans.registry import all_queries
from tessera.sources import views as V

QUERIES = all_queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_ngram_metrics_shuffle_no_ngrams(spark):
    """Clipping runs inside each row, in the JVM; the suite has one Python function."""
    for name in ("bleu_corpus", "bleu_macro_vs_corpus", "chrf_corpus"):
        p = plan(QUERIES[name](spark, SF01))
        assert "Python" not in p and "_gram" not in p and "Generate explode" not in p, name
    assert plan(QUERIES["metric_suite"](spark, SF01)).count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["bleu_corpus", "chrf_corpus", "bleu_macro_vs_corpus", "metric_suite"])
def test_python_functions_run_once_per_row(spark, name):
    """No inferred filter may duplicate a Python function below a join."""
    p = plan(QUERIES[name](spark, SF01))
    for ln in p.split("\n"):
        if "Filter" in ln:
            assert "pythonUDF" not in ln, ln


def test_meteor_has_no_window(spark):
    assert "Window" not in plan(QUERIES["meteor_exact"](spark, SF01))


def test_filters_reach_the_scan(spark):
    """Scans by configuration or split read only the folders they name, in one
    scan and without a quantile pass."""
    p = plan(QUERIES["scan_config"](spark, SF01))
    assert "PartitionFilters: [isnotnull(language" in p and "percentile" not in p
    for name in ("scan_split", "mix_lengths", "head_rows"):
        p = plan(QUERIES[name](spark, SF01))
        assert p.count("FileScan parquet") == 1 and "percentile" not in p
    assert "PartitionFilters: [isnotnull(split" in plan(QUERIES["scan_split"](spark, SF01))


def test_pairs_is_an_equi_join_not_a_window(spark):
    p = plan(V.pairs(spark, SF01))
    assert "Window" not in p
    assert "Join" in p and "turn" in p


def test_vocabulary_is_broadcast(spark):
    """The vocabulary carries a proven row bound, so its join is a broadcast."""
    import re
    p = plan(QUERIES["encode_input"](spark, SF01))
    assert re.search(r"BroadcastHashJoin \[token#\d+\]", p)


def test_unbounded_side_is_not_hinted(spark):
    from tessera.functions.joins import broadcast_if_small
    # Rows built on the driver carry no size estimate; without a bound the
    # side is left to the planner / AQE, with a proven bound it is hinted.
    side = spark.createDataFrame([(i,) for i in range(10)], "k long")
    assert broadcast_if_small(side) is side
    assert broadcast_if_small(side, row_bound=10) is not side
    small = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()
    assert broadcast_if_small(small) is not small       # estimated small


def test_exact_sample_is_not_a_global_top_n(spark):
    p = plan(QUERIES["sample_exact"](spark, SF01))
    assert "TakeOrderedAndProject" not in p


@pytest.mark.parametrize("name", ["word_counts", "epoch_rollup", "pass_at_k", "token_freq"])
def test_counting_aggregates_are_partial(spark, name):
    p = plan(QUERIES[name](spark, SF01))
    assert "partial_" in p


def test_top_k_windows_are_group_limited(spark):
    p = plan(QUERIES["top_checkpoints"](spark, SF01))
    assert "WindowGroupLimit" in p


def test_writers_of_a_folder_grow_with_its_data(spark, tmp_out):
    """A folder is written by as many tasks as its bytes ask for."""
    import glob
    from tessera.sources.corpus_store import read_corpus, write_corpus
    view = V.corpus(spark, SF01)

    def files(advisory):
        path = f"{tmp_out}/corpus-{advisory}"
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
        try:
            write_corpus(view, path)
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        assert read_corpus(spark, path, view).count() == view.count()
        return sorted(len(glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{path}/*/*/*"))

    few, many = files("64m"), files("4k")
    # A shuffle partition is split between its map tasks, of which there are 8 here.
    assert max(few) <= 2 and max(many) >= 6, (few, many)


def test_bracket_filter_makes_the_candidate_once(spark):
    """The filter is pushed below the projection that joins a prefix's tokens."""
    filters = [ln for ln in plan(QUERIES["balanced_candidates"](spark, SF01)).split("\n") if "replace(" in ln]
    assert len(filters) == 1 and filters[0].count("array_join") == 1
