"""The search by the interface's parameters."""

import datetime

import pytest
from pyspark.sql import functions as F

from terrier.operators import search as P


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "C2", "R1", "07331", "Ouvert", datetime.date(2020, 1, 5), True, None, ["a"], {"chantier": "Pont", "note": "Vieux"}), (2, "C1", "R9", "07331", "Clos", datetime.date(2021, 2, 1), False, "m", [], {"chantier": "pont"}),
        (3, "C1", "R2", "07019", "Ouvert", datetime.date(2020, 6, 30), True, "m", None, {}), (4, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "id int, enr_cab_createur string, enr_ref_dossier string, enr_code_insee string, enr_statut string, enr_date_dossier date, enr_visible boolean, enr_memo string, dmpc array<string>, enr_extra map<string, string>")


@pytest.mark.parametrize(
    ("params", "ids"),
    [
        ({}, [1, 2, 3, 4]), ({"enr_statut": "Ouvert"}, [1, 3]), ({"enr_cab_createur": ["C1", "C2"], "enr_code_insee": "07331"}, [1, 2]), ({"enr_date_min": "30-06-2020"}, [2, 3]), ({"enr_date_max": "2020-06-30"}, [1, 3]), ({"enr_visible": "False"}, [2]),
        ({"enr_memo": "true"}, [2, 3]), ({"enr_memo": False}, [1, 4]), ({"dmpc": "true"}, [1]), ({"dmpc": "false"}, [2, 3, 4]), ({"enr_extra": "chantier:PONT"}, [1, 2]), ({"enr_extra": "vieux"}, [1]), ({"enr_extra": ["chantier:pont", "note: vieux"]}, [1]),
    ],
)
def test_parameters(records, params, ids):
    assert sorted(r.id for r in P.matching(records, params).collect()) == ids


def test_pages_are_in_order(records):
    page, links = P.found(records, {"enr_memo": "true", "limit": "1", "offset": "1"})
    assert [r.id for r in page.collect()] == [2] and links == {"count": 2, "next": None, "previous": 0}
    page, links = P.found(records, {"enr_date_max": "2021-12-31", "limit": 2})
    assert [r.id for r in page.collect()] == [3, 2] and links == {"count": 3, "next": 2, "previous": None}


@pytest.mark.parametrize("params", [{"enr_date_min": "1/2/2020"}, {"enr_visible": "oui"}, {"nothing": 1}])
def test_wrong_parameters_raise(records, params):
    with pytest.raises(ValueError):
        P.matching(records, params)


def test_filters_reach_the_scan(spark, capsys):
    table = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", F.col("o_orderstatus").alias("enr_statut"), F.col("o_orderdate").cast("date").alias("enr_date_dossier"))
    P.matching(table, {"enr_statut": ["F", "O"], "enr_date_min": "1993-01-01"}).select("o_orderkey").explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "In(o_orderstatus, [F,O])" in pushed and "o_orderdate" in pushed
