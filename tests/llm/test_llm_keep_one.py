from llm_cases import docs, prose, with_clashes

from evalspark.llm import simhash


def test_a_row_goes_only_for_its_own_group(spark):
    a, b, c = prose(9, 80), prose(10, 80), prose(11, 80)
    texts = [(3, a), (5, a), (5, b), (7, c), (7, prose(12, 80)), (7, c), (7, c.upper()), (8, b), (None, a)]
    got = simhash.keep_one(docs(spark, [(i, t, None, None, None) for i, t in texts])).collect()
    kept = sorted(((r.doc_id or 0, r.text.lower()) for r in got))
    assert kept == sorted([(0, a.lower()), (3, a.lower()), (5, b.lower()), (7, c.lower()), (7, prose(12, 80).lower())])


def test_repeated_ids_with_clashing_columns(spark):
    a, b = prose(9, 80), prose(10, 80)
    df = with_clashes(docs(spark, [(i, t, None, None, None) for i, t in [(3, a), (3, a), (3, b), (5, a), (6, prose(13, 80))]]))
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(3, a), (3, b), (6, prose(13, 80))])
