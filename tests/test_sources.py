"""Strict readers and the findings' manifest."""

import pytest

from lexishift.sources import records as R


def test_a_catalog_with_problems_is_refused(spark, tmp_path):
    f = tmp_path / "catalog"
    f.write_text("sv_SE|UTF8|sv_SE.utf8\nC||C\nsv_SE|LATIN1|sv_SE\n")
    assert {tuple(r) for r in R.read_catalog(spark, str(f)).collect()} == {("sv_SE", "UTF8", "sv_SE.utf8"), ("C", None, "C"), ("sv_SE", "LATIN1", "sv_SE")}
    for bad, why in (("sv_SE|UTF8\n", "not three fields"), ("a|b|c|d\n", "not three fields"), ("|UTF8|x\n", "no name"), ("a|UTF8|x\na|UTF8|y\n", "told twice")):
        f.write_text("C||C\n" + bad)
        with pytest.raises(ValueError, match=why):
            R.read_catalog(spark, str(f))


GOOD = """confirmation|id1|LATIN1
database encoding|LATIN1
server|18.6
collation|sv|usable|glibc 2.28
collation|C|usable|glibc NULL
test|1|sv|>|old >, new <|measured|like the OLD machine
test|2|sv|<|old >, new <|measured|like the NEW machine
ctype|1|C|t|old t, new f|measured|like the OLD machine
gone|collation|x|y
end|id1|3 tests
"""


def problems(spark, tmp_path, text):
    f = tmp_path / "out.txt"
    f.write_text(text)
    answers = R.read_answers(spark, str(f))
    tests = spark.createDataFrame([("sv", 1), ("sv", 2), ("C", 1)], "collation string, id long")
    return answers, {(r.problem, r.n) for r in R.answer_problems(answers, tests, "LATIN1").collect()}


def test_answers_are_typed_records(spark, tmp_path):
    answers, found = problems(spark, tmp_path, GOOD)
    assert found == set() and answers.unknown.count() == 0
    assert {(r.collation, r.usable, r.version) for r in answers["collation"].collect()} == {("sv", True, "2.28"), ("C", True, None)}
    assert {(r.id, r.collation, r.answer) for r in answers["test"].collect()} == {(1, "sv", ">"), (2, "sv", "<")}
    assert answers["end"].first().n == 3 and answers["gone"].first().object == "x" and answers["ctype"].first().answer == "t"


@pytest.mark.parametrize(("old", "new", "want"), [
    ("end|id1|3 tests\n", "", {("is cut short", 1)}),
    ("end|id1", "end|id2", {("ends as another output", 1)}),
    ("3 tests", "4 tests", {("states another number of answers", 4)}),
    ("confirmation|id1|LATIN1\n", "", {("is no output of a confirmation", 1)}),
    ("database encoding|LATIN1", "database encoding|UTF8", {("comes from a database of another encoding", 1)}),
    ("test|2|sv|<", "test|1|sv|<", {("answers a test twice", 1), ("lacks answers", 1)}),
    ("test|2|sv|<", "test|2|sv|?", {("holds unknown lines", 1), ("lacks answers", 1), ("states another number of answers", 3)}),
    ("test|2|sv", "test|9|sv", {("lacks answers", 1), ("answers what was not asked", 1)}),
    ("collation|C|usable|glibc NULL", "collation|C|CANNOT BE USED", {("has collations that cannot be used", 1)}),
    ("collation|C|usable|glibc NULL\n", "", {("says nothing of collations", 1)}),
    ("collation|C|usable|glibc NULL", "collation|C|usable|glibc NULL\ncollation|zz|usable|glibc 1", {("reports collations that were not asked for", 1)}),
    ("server|18.6", "server|18.6\nconfirmation|id1|LATIN1", {("holds more than one run", 2)}),
])
def test_answers_that_are_not_whole(spark, tmp_path, old, new, want):
    assert old in GOOD
    assert problems(spark, tmp_path, GOOD.replace(old, new))[1] == want


def test_findings_and_counts_become_visible_together(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(ValueError, match="no findings"):
        R.read_findings(spark, path)
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "pair string, x int")
    R.write_findings(found, path)
    rows, counts = R.read_findings(spark, path)
    assert {tuple(r) for r in counts.select("pair", "n").collect()} == {("a", 2), ("b", 1)} and rows.count() == 3
    # a write that fails in its rows leaves the earlier findings and counts
    with pytest.raises(Exception, match="boom"):
        R.write_findings(found.selectExpr("pair", "if(x = 3, raise_error('boom'), x) as x"), path)
    assert R.read_findings(spark, path)[1].count() == 2
    R.write_findings(found.limit(0), path)
    assert R.read_findings(spark, path)[0].count() == 0 and R.read_findings(spark, path)[1].columns == ["pair", "n"]


def test_rows_that_go_missing_are_refused(spark, tmp_path):
    path = tmp_path / "out"
    R.write_findings(spark.createDataFrame([("a", 1), ("b", 3)], "pair string, x int"), str(path))
    gone = next(path.glob("run-*/findings/pair=a/*.parquet"))
    gone.unlink()
    with pytest.raises(ValueError, match="states 2 rows"):
        R.read_findings(spark, str(path))
