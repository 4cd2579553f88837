"""Added spans of personal data reach to the end of what they name."""

from __future__ import annotations

from veilscan.llm import pii

IBANS = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "CH9300762011623852957",
         "NL91ABNA0417164300", "NO9386011117947", "AT611904300234573201", "DE89 3704 0044 0532 0130 00",
         "FR14 2004 1010 0505 0001 3M02 606", "AT61 1904 3002 3457 3201"]
NAMES = ["Dr. Jane Smith", "Mrs O\u2019Neil", "Prof. J. R. Miller-Jones", "Herr Hans Peter M\u00fcller", "Ms. Lee"]


def test_accounts_and_names_are_whole(spark):
    rows = [(k, f"my iban account {x} IN use") for k, x in enumerate(IBANS)]
    rows += [(100 + k, f"signed by {x}. and then {x} went") for k, x in enumerate(NAMES)]
    hits = pii.candidates(pii.matches(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("row", pii.F.col("doc_id")))
    got = {}
    for r in hits.where("not base and kind in ('account', 'name')").collect():
        got.setdefault(r.row, set()).add((r.kind, r.hit))
        assert rows[[i for i, _ in rows].index(r.row)][1][r.start : r.end] == r.hit
    assert got == {k: {("account", x)} for k, x in enumerate(IBANS)} | {100 + k: {("name", x)} for k, x in enumerate(NAMES)}
