import pytest
from pyspark.sql import functions as F

from litlens.functions.identifiers import clean_null, doi_key, pmid_key

DOIS = {
    "10.1000/AbC.1": "10.1000/abc.1", " https://doi.org/10.1000/ab ": "10.1000/ab", "HTTP://DX.DOI.ORG/10.1000/ab": "10.1000/ab", "doi: 10.1000/a b": "10.1000/ab", "doi 10.1000//ab": "10.1000/ab",
    "<10.1000/1-2(199)1:2<3::AID-X>3.0.CO;2-4>": "10.1000/1-2(199)1:2<3::aid-x>3.0.co;2-4", "10.1000/S1(12)919-9.": "10.1000/s1(12)919-9", "{10.1000/s-1.}": "10.1000/s-1", "(10.1000/s(1)2)": "10.1000/s(1)2",
    "10.1000/ab [doi] S12-3 [pii]": "10.1000/ab", "S12-3 [pii] 10.1000/ab [doi]": "10.1000/ab", "10.1000/s1‐a−b": "10.1000/s1-a-b", "10.1000/a​b\r\n": "10.1000/ab", "10.1000/A(b": "10.1000/a(b", "10.1000/x.1.2": "10.1000/x.1.2", "10.1000/x.12": "10.1000/x.12",
    "10.1000%2Fab": "10.1000/ab", "10.1000/a&lt;b&gt;": "10.1000/a<b>", "nan": None, "": None, "  ": None, "None": None, "10.1000": None, "10.1000/": None, "ab/cd": None,
}
PMIDS = {"123": "123", " 0123 ": "123", "PMID: 123": "123", "pmid123": "123", "123.0": "123", "0": None, "nan": None, "": None, "12a": None}


@pytest.mark.parametrize("function,cases", [(doi_key, DOIS), (pmid_key, PMIDS)])
def test_keys(spark, function, cases):
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "x string").select("x", function(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases | {None: None}


def test_clean_null(spark):
    rows = spark.createDataFrame([("a",), (" a ",), ("NaN",), ("none",), ("",), (None,)], "x string").select(clean_null(F.col("x")).alias("y")).collect()
    assert [r.y for r in rows] == ["a", "a", None, None, None, None]
