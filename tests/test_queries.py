"""Every query of the engine against its DuckDB SQL; those without SQL by what can be said of them."""

import pytest

from brisk import queries

from compare import database, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return database(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def ready_days(duck):
    return duck.sql(f"WITH {queries.E} SELECT count(*) FROM bas WHERE history_days >= 7").fetchall()[0][0]


@pytest.mark.parametrize("name", ["isolation_scores", "ocsvm_scores", "autoencoder_scores"])
def test_every_ready_day_has_a_score_that_tells_days_apart(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) == ready_days(duck) == len(got[["user", "day"]].drop_duplicates())
    assert got["anomaly"].notna().all() and got["anomaly"].nunique() > len(got) / 4


def test_kmeans_peers(spark, duck):
    got = queries.QUERIES["kmeans_peers"](spark, SF).toPandas()
    users = duck.sql(f"WITH {queries.E} SELECT count(DISTINCT \"user\") FROM pan").fetchall()[0][0]
    assert len(got) == users == got["user"].nunique() and set(got["cluster"]) == {0, 1, 2, 3}


def test_risk_scores(spark, duck):
    got = queries.QUERIES["risk_scores"](spark, SF).toPandas()
    ready = got[got["risk_score"].notna()]
    assert len(ready) == ready_days(duck) and ready["risk_score"].between(0, 100).all()
    assert (ready["risk_score"] - 100 * (0.7 * ready["anomaly_component"] + 0.3 * ready["peer_component"])).abs().max() < 1e-3
    assert set(ready["peer_source"]) <= {"ldap_role_department", "behavioral_cluster"}


def test_permutation_importance(spark):
    got = queries.QUERIES["permutation_importance"](spark, SF).toPandas()
    assert sorted(got["feature"]) == ["clicks", "ks", "views"] and got["baseline_pr_auc"].nunique() == 1 and (got["mean_pr_auc_drop"] <= got["baseline_pr_auc"]).all()
    assert (got.set_index("feature").loc["clicks", ["mean_pr_auc_drop", "std_pr_auc_drop"]] == 0).all()  # the score does not read it


def test_adwin(spark, duck):
    from brisk.operators.drift import Adwin

    rows = duck.sql("SELECT event_type, date_trunc('hour', ts) AS h, round(sum(value), 4) FROM events GROUP BY ALL ORDER BY ALL").fetchall()
    want, monitors = set(), {}
    for kind, hour, v in rows:
        monitor, n = monitors.get(kind, (Adwin(delta=0.05), 0))
        if monitor.update(v):
            want.add((kind, n + 1))
        monitors[kind] = (monitor, n + 1)
    got = {(r["series"], r["observations_at_detection"]) for r in queries.QUERIES["adwin"](spark, SF).collect()}
    assert got == want


def test_every_query_is_checked():
    by_hand = {"isolation_scores", "ocsvm_scores", "autoencoder_scores", "kmeans_peers", "risk_scores", "permutation_importance", "adwin", "family_comparison"}
    assert set(queries.QUERIES) == set(queries.ORACLES) | by_hand


def test_families_are_compared_on_the_same_folds(spark, duck):
    from brisk.plans import experiments

    rows = queries.stored(queries._model_rows(spark, SF))
    fold = experiments.folds_of(rows, **queries._FOLDS)[:1]
    got = experiments.compare_families(rows, queries.labelled(spark, SF), fold, ["isolation_forest", "lof", "ocsvm"], queries._SELECTION, trees=10, clusters=3).toPandas()
    want = duck.sql(queries.ORACLES["fold_observations"]).df().set_index("fold_id").loc[1]
    assert sorted(got["family"]) == ["isolation_forest", "lof", "ocsvm"] and set(got["status"]) == {"evaluated"}
    assert set(got["positives"]) == {want["positives"]} and set(got["observations"]) == {want["observations"]}
    assert got["roc_auc"].between(0, 1).all() and got["pr_auc"].between(0, 1).all() and got["n_features"].between(2, 6).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["user", "day", "ks", "z_ks"]
    assert set(e.oracle_sql()) <= set(e.queries())
