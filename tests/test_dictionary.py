"""The data dictionary: two kinds of records, codes, ranges and blanks."""

import pytest

from surveyloom.operators.design import DesignSpec
from surveyloom.sources import dictionary

LINES = '''NAME,SEX,C,1,"Sex"
VAL,SEX,C,1,"1","1","Male"
VAL,SEX,C,1,"2","2","Female"
NAME,AGEP,N,2,"Age"
VAL,AGEP,N,2,"0","0","Under 1 year"
VAL,AGEP,N,2,"0","99","0 to 99 years, ""top-coded"""
VAL,AGEP,N,2,"90","99","Old"
NAME,WKHP,N,2,"Hours"
VAL,WKHP,N,2,"bb","bb","N/A (did not work)"
VAL,WKHP,N,2,"1","98","Hours"
NAME,PUMA,C,5,"Area"
VAL,PUMA,C,5,"00100","00199","North"
VAL,PUMA,C,5,"00150","00150","Town, old"
'''


@pytest.fixture()
def found(spark, tmp_path):
    (tmp_path / "d.csv").write_text(LINES, encoding="utf-8")
    return dictionary.read_dictionary(spark, str(tmp_path / "d.csv"))


def test_both_kinds_of_records(found):
    assert sorted(map(tuple, found.columns.collect())) == [("AGEP", "N", 2, "Age"), ("PUMA", "C", 5, "Area"), ("SEX", "C", 1, "Sex"), ("WKHP", "N", 2, "Hours")]
    assert found.values.count() == 9


def test_codes_for_the_design(spark, found):
    assert found.codes(["SEX", "WKHP", "PUMA", "none"]) == {"SEX": {"1": "Male", "2": "Female"}, "PUMA": {"00150": "Town, old"}}
    assert found.codes(["WKHP"], blank="NA") == {"WKHP": {"NA": "N/A (did not work)"}}
    df = spark.createDataFrame([("1",), ("2",)], "SEX string")
    assert DesignSpec(found.codes(["SEX"])).fit_transform(df).columns == ["SEX_Male", "SEX_Female"]


def test_labels_by_code_range_and_blank(spark, found):
    rows = [("1", 0, "40", "00150"), ("2", 95, None, "00123"), ("3", 40, "NA", "100"), (None, None, "99", "00200")]
    df = spark.createDataFrame(rows * 3, "SEX string, AGEP int, WKHP string, PUMA string")
    got = dictionary.label_values(df, ["SEX", "AGEP", "WKHP", "PUMA"], found).collect()
    assert len(got) == 48
    assert {(r["feature"], r["value"]): r["label"] for r in got} == {
        ("SEX", "1"): "Male", ("SEX", "2"): "Female", ("SEX", "3"): None, ("SEX", None): None,
        ("AGEP", "0"): "Under 1 year", ("AGEP", "95"): "Old", ("AGEP", "40"): '0 to 99 years, "top-coded"', ("AGEP", None): None,
        ("WKHP", "40"): "Hours", ("WKHP", None): "N/A (did not work)", ("WKHP", "NA"): "N/A (did not work)", ("WKHP", "99"): None,
        ("PUMA", "00150"): "Town, old", ("PUMA", "00123"): "North", ("PUMA", "100"): None, ("PUMA", "00200"): None,
    }


@pytest.mark.parametrize("line", ['OTHER,SEX,C,1,"x"', "VAL,SEX,C,1,1", 'VAL,,C,1,"1","1","x"', 'VAL,SEX,Z,1,"1","1","x"'])
def test_other_records_are_refused(spark, tmp_path, line):
    (tmp_path / "bad.csv").write_text(LINES + line + "\n")
    with pytest.raises(ValueError, match="data dictionary"):
        dictionary.read_dictionary(spark, str(tmp_path / "bad.csv"))
