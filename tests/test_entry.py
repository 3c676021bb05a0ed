"""Driver contract: entry() on sf0.001, every oracle key is a query, oracles agree on sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from paths import SF_SMALL
from slantspark.sources.tables import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:2] == ["label", "article_id"] and len(df.columns) == 28
    assert df.count() > 0


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


FAST = ["valid_id_counts", "merged_articles", "relabelled", "clean_pages", "clean_text_dl", "all_doc_features",
        "feature_table", "fit_tagger", "hash_split", "knn_predict", "class_report", "vocab_encode", "xml_articles",
        "tsv_roundtrip", "csv_roundtrip", "features_csv_roundtrip", "rejected_ids", "dataset_profile", "default_label", "knn_probabilities",
        "knn_log_loss", "gazetteer_entities", "stream_features"]


@pytest.mark.parametrize("name", FAST)
def test_oracle_matches(spark, duck, name):
    def norm(rows, cols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        fix = lambda v: f"{v:.9g}" if isinstance(v, float) else v
        return sorted(tuple(str(fix(r[i])) for i in order) for r in rows)
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(cur.fetchall(), dcols)
