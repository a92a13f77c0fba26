"""Column functions on single values, one for each case that the layouts are known for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from idweft.functions import columns as C

DAY = dt.date(2026, 1, 1)
MRZ = "P<INDGUPTA<<NISHA<RANI<<<<<<<<<<<<<<<<<<<<<<"
CASES = [
    (C.half_width, "Ｈｏｕｓｅ　１２，\u00a0Ｒｏａｄ", "House 12, Road"), (C.half_width, "oﬃce ﬁve ﬂat", "office five flat"), (C.half_width, "plain é", "plain é"),
    (C.clean_name, "JAY\nVERMA", "Jay Verma"), (C.clean_name, "JayVerma", "Jay Verma"), (C.clean_name, "RAHULGUPTA", "Rahul Gupta"),
    (C.clean_name, "POOJA MPALANDE", "Pooja M Palande"), (C.clean_name, "R.K. O'BRIEN", "R.K. O'Brien"), (C.clean_name, "GUPTA", "Gupta"), (C.clean_name, None, ""), (C.clean_name, "  ", ""),
    (C.title, "o'brien D-404", "O'Brien D-404"), (C.dmy_to_iso, "1/2/1999", "1999-02-01"), (C.dmy_to_iso, "x", "x"), (C.dmy_to_iso, "31/02/1999", "1999-02-31"),
    (C.to_iso_date, "09JUN2004", "2004-06-09"), (C.to_iso_date, "09-Aug-2022", "2022-08-09"), (C.to_iso_date, "08JUN-2044", "2044-06-08"), (C.to_iso_date, "1 2 2003", "2003-02-01"),
    (C.to_iso_date, "32/01/2000", ""), (C.to_iso_date, "01/13/2000", ""), (C.to_iso_date, "05-Foo-2000", ""), (C.to_iso_date, "HR41 2022", ""), (C.to_iso_date, None, ""),
    (C.mrz_date, "600528", "28/05/1960"), (C.mrz_date, "300101", "01/01/2030"), (C.mrz_date, "31010", ""), (lambda c: C.mrz_date(c, True), "790801", "01/08/2079"),
    (lambda c: C.plausible_dob(c, F.lit(DAY)), "1999-02-31", True), (lambda c: C.plausible_dob(c, F.lit(DAY)), "2027", False), (lambda c: C.plausible_dob(c, F.lit(DAY)), "1899-01-01", False), (lambda c: C.plausible_dob(c, F.lit(DAY)), "1999-13-01", False),
    (lambda c: C.dob_from_digits(c, F.lit(DAY)), "2102/2002", "2002-02-21"), (lambda c: C.dob_from_digits(c, F.lit(DAY)), "99999999", ""),
    (lambda c: C.age(c, F.lit(dt.date(2023, 2, 28))), "2004-02-29", "18"), (lambda c: C.age(c, F.lit(dt.date(2023, 3, 1))), "2004-02-29", "19"), (lambda c: C.age(c, F.lit(DAY)), "2030-01-01", ""), (lambda c: C.age(c, F.lit(DAY)), "x", ""),
    (lambda c: C.licence_issue_year(c, F.lit(DAY)), "HR4120220002435", 2022), (lambda c: C.licence_issue_year(c, F.lit(DAY)), "DLFAP025184122010", 2010), (lambda c: C.licence_issue_year(c, F.lit(DAY)), "12", 0),
    (C.clean_guardian, "W Of MILIND PALANDE", "Milind Palande"), (C.clean_guardian, "WILLIAM", "William"), (C.clean_guardian, "DWOfRANGNATH", "Rang Nath"),
    (C.is_pan_name, "RAHUL GUPTA", True), (C.is_pan_name, "Hteak", False), (C.is_pan_name, "INCOME TAX", False), (C.is_aadhaar_name, "JAYVERMA", True), (C.is_aadhaar_name, "GOVEMMENT OF", False),
    (C.is_licence_name, "09-Jun-2004", False), (C.is_licence_name, "B+", False), (C.is_licence_name, "Inv Carr No.", False), (C.is_licence_name, "JAY VERMA", True), (C.is_blood_group, "AB-", True), (C.is_blood_group, "Nil", True),
    (C.is_licence_address, "Issue Date", False), (C.is_licence_address, "09-Aug-2022", False), (C.is_licence_address, "7-34", False), (C.is_licence_address, "House 12 Sector 7", True),
    (C.is_address_line, "Punjab - 140301", True), (C.is_address_line, "395017", True), (C.is_address_line, "hello", False),
    (C.is_script_garbage, "S/O:α，-404，0", True), (C.is_script_garbage, "S/O: bbR, -404, 3Tq mt", True), (C.is_script_garbage, "UtarPradesh", False), (C.is_script_garbage, "VTC:", False), (C.is_script_garbage, "395017", False),
    (C.half_width, "（a，b：c）", "(a,b:c)"), (C.comparable, "Ab-1 c", "ab1c"), (C.confidence, 0.455, 46), (C.confidence, 0.445, 44), (C.confidence, None, 0),
    (lambda c: C.mrz_names(c)[2], MRZ, "Gupta"), (lambda c: C.mrz_names(c)[3], MRZ, "Nisha Rani"), (lambda c: C.mrz_names(c)[1], "P<<<DOE<<JOHN<<<<<<<<<<<<<<<<<<<<", ""),
    (lambda c: C.mrz_numbers(c)[0], "AH386374<0IND8001011M3001019<<", "AH386374"), (lambda c: C.mask_id(c, F.lit("PAN")), "ABCDE1234F", "ABXXXXX34F"), (lambda c: C.mask_id(c, F.lit("PASSPORT")), "A1234567", "XXXX4567"),
    (lambda c: C.states_in(c), "12 Lane, west bengal", "WEST BENGAL"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_column(spark, i):
    f, value, wanted = CASES[i]
    kind = "double" if isinstance(value, float) or (value is None and f is C.confidence) else "string"
    row = spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()
    assert row["y"] == wanted
