"""Greedy groups, folded as a stream of records."""

from pyspark.sql import functions as F

from fusegrid.functions.fuzzy import token_sort_ratio
from fusegrid.operators import match


def test_greedy_groups_fold_across_batches(spark):
    """Groups of one entity are kept from batch to batch, and no entity is handed over as a whole."""
    names = ["Ada Stone", "Stone Ada", "Bo Rivers", None, "Ada Ston", "Cy Marsh", ""]
    rows = [(e, p, names[(e * 3 + p) % 7], [f"U{(e + p * p) % 5}@x.y"] if p % 3 else [], ["+91"] if p % 11 == 5 else None, [["Acme"], ["Beta"], [], ["acme "]][(p + e) % 4]) for e in range(6) for p in range(e * 9)]
    d = spark.createDataFrame(rows, "entity_key int, pos int, full_name string, emails array<string>, phones array<string>, firms array<string>")
    got = match.greedy_groups(d.withColumn("experience", F.transform("firms", lambda c: F.struct(c.alias("company")))))
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = {(r[0], r[1]): r[2] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want, firsts = {}, {}
    for e, p, name, mails, phones, firms in rows:
        mine = ({x.lower() for x in mails}, set(phones or []), name, {x.strip().lower() for x in firms})

        def same(a, b=mine):
            score = token_sort_ratio(a[2], b[2]) if a[2] and b[2] else 0
            return bool(a[0] & b[0] or a[1] & b[1] or score >= 85 and (a[3] & b[3] or not a[3] and not b[3] and score >= 95))

        groups = firsts.setdefault(e, [])
        want[e, p] = next((k for k, g in enumerate(groups) if same(g)), len(groups))
        if want[e, p] == len(groups):
            groups.append(mine)
    assert found == want and len({g for g in want.values()}) > 3
