"""Values are looked at by one short piece of code, and each text is what it was before."""

from tallyloom import fixed
from tallyloom.operators import mapping

TEXTS = {
    "1998-01-02": ("yyyy-M-d",),
    " 1998-1-2\t": ("yyyy-M-d",),
    "1998-13-02": (),
    "1/2/2020": ("M/d/yyyy", "d/M/yyyy"),
    "13/2/2020": ("d/M/yyyy",),
    "3 May 2020": ("d MMM yyyy", "d MMMM yyyy"),
    "3 June 2020": ("d MMMM yyyy",),
    "May 3, 2020": ("MMM d, yyyy", "MMMM d, yyyy"),
    "12": ("numbers", "integers"),
    "-3.25": ("numbers", "integers"),
    "1e3": ("numbers", "integers"),
    ".5": ("numbers", "integers"),
    "1,234.5": ("numbers",),
    "₹ 12": ("numbers",),
    "1 234": ("numbers",),
    "": (),
    "5D": (),
    "N/A": (),
    "--5": (),
}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_text_counts_as_what_it_is(spark):
    cells = spark.createDataFrame([(t, "h", t) for t in TEXTS] + [("none", "h", None)], "upload string, header string, value string")
    found = {row["upload"]: row for row in mapping.profile(cells).collect()}
    assert set(found) == set(TEXTS)
    for text, kinds in TEXTS.items():
        dates = [f for f in fixed.DATE_FORMATS if f in kinds]
        row = found[text]
        assert (row["date_format"], row["sampled"]) == (dates[0] if dates else None, 1), text
        assert (row["is_date"], row["is_numeric"], row["is_integer"]) == (bool(dates), "numbers" in kinds, "integers" in kinds), text


def test_looks_of_many_columns_are_no_more_code_than_of_one(spark):
    df = spark.createDataFrame([tuple("1" for _ in range(8))], [f"c{i}" for i in range(8)])
    one, all_ = (_plan(mapping.profile_upload(df, df.columns[:n])) for n in (1, 8))
    assert one.count("RLIKE") == all_.count("RLIKE") > 0


def test_cells_are_counted_by_look_before_the_shuffle(spark):
    cells = spark.createDataFrame([("u", "h", "1")], "upload string, header string, value string")
    first = _plan(mapping.profile(cells)).split("Aggregate [")[-1].split("\n")[0]
    assert "looks" in first and first.count("count(") == 1
