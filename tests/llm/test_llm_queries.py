from compare import differences, duck

from creditgrain.llm.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.01"


def test_exact_dedup_matches_sql(spark):
    for name, sql in ORACLE.items():
        assert differences(QUERIES[name](spark, DATA), duck(DATA).sql(sql)) == []
