"""Quotes against their SQL on odd texts: within words, other forms of letters and spaces, repeated rows, null ids, short quotes."""

import __spark_entry__
from tests import oracle

LONG = "one two three four five six seven eight nine ten"


def test_as_sql_on_odd_texts(spark, tmp_path):
    quotes = [(1, LONG), (2, LONG), (2, LONG), (3, "wo"), (4, "ΟΔΟΣ ΟΔΟΣ x"), (5, "İx y z"), (6, "ﬁne day out"), (7, "  "), (8, None), (None, "a b c"), (9, "straße und weg")]
    docs = [(1, f'said "{LONG}"'), (1, f"x{LONG}y"), (1, f'said "{LONG}"'), (2, LONG.replace(" ", " ")), (3, LONG.upper().replace(" ", "\n\t")), (4, "οδοσ οδοσ xx ix y z"), (5, "fine day out"), (6, None), (None, f"{LONG} xa b cx"), (7, "strasse und weg"), (8, "a\x0bb c a b  c")]
    for name, ids, rows in (("benchmark", "item_id", quotes), ("documents", "doc_id", docs)):
        spark.createDataFrame(rows, f"{ids} long, text string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    c = oracle.connect("/root/testdata/sf0.001")
    for name in ("benchmark", "documents"):
        c.execute(f"create or replace view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    assert oracle.same(__spark_entry__.queries()["quotes_verified"](spark, str(tmp_path)), c, __spark_entry__.oracle_sql()["quotes_verified"]) > 8
