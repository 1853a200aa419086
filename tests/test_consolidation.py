"""The whole consolidation on a tiny star in the source layout, read from CSV."""

import pytest
from rows import records

from sessionloom.operators import features
from sessionloom.plans import consolidation as c

CSV = {
    "courses": "code_module,code_presentation,module_presentation_length\nA,2013J,268\nB,2014B,240\n",
    "assessments": "code_module,code_presentation,id_assessment,assessment_type,date,weight\n"
    "A,2013J,10,TMA,19,10.0\nA,2013J,11,CMA,,20.0\nA,2013J,12,Exam,,100.0\n",
    "vle": "id_site,code_module,code_presentation,activity_type,week_from,week_to\n"
    "1,A,2013J,quiz,,\n2,A,2013J,url,1,3\n3,A,2013J,url,,\n",
    "studentInfo": "code_module,code_presentation,id_student,gender,region,highest_education,imd_band,age_band,"
    "num_of_prev_attempts,studied_credits,disability,final_result\n"
    "A,2013J,1,M,Wales,HE,20-30%,0-35,0,60,N,Pass\nA,2013J,2,F,London,HE,,35-55,1,120,Y,Withdrawn\n",
    "studentRegistration": "code_module,code_presentation,id_student,date_registration,date_unregistration\n"
    "A,2013J,1,-30,\nA,2013J,2,-5,12\n",
    "studentAssessment": "id_assessment,id_student,date_submitted,is_banked,score\n"
    "10,1,0,0,80\n11,1,0,0,60\n12,1,9,0,\n10,2,4,0,50\n",
    "studentVle": "code_module,code_presentation,id_student,id_site,date,sum_click\n"
    "A,2013J,1,1,0,2\nA,2013J,1,1,0,3\nA,2013J,1,2,0,1\nA,2013J,1,3,5,3\nA,2013J,1,2,5,1\nA,2013J,1,99,7,8\n",
}
LEVELS = ["quiz", "url", "page"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("star")
    for name, text in CSV.items():
        (folder / f"{name}.csv").write_text(text)
    return c.load_sources(spark, str(folder))


def test_session_info_keeps_courses_without_students(tables):
    info = c.session_info(tables["courses"], tables["studentInfo"], tables["studentRegistration"])
    got = {(r.code_module, r.id_student): (r.module_presentation_length, r.date_unregistration) for r in info.collect()}
    assert got == {("A", 1): (268, None), ("A", 2): (268, 12), ("B", None): (240, None)}
    assert len(info.columns) == 15


def test_daily_activity(tables):
    daily = c.daily_activity(tables["studentVle"], tables["vle"], LEVELS)
    assert records(daily.select("id_student", "date", *LEVELS)) == [(1, 0, 5, 1, 0), (1, 5, 0, 4, 0)]


def test_consolidated(tables):
    final = c.consolidated(tables, LEVELS)
    cols = ["id_student", "date", *LEVELS, "id_assessment", "score", "assessment_type", "gender"]
    assert set(records(final.select(*cols))) == {
        (1, 0, 5, 1, 0, 10, 80.0, "TMA", "M"),
        (1, 0, 5, 1, 0, 11, 60.0, "CMA", "M"),
        (1, 5, 0, 4, 0, None, None, None, "M"),
        (1, 9, 0, 0, 0, 12, None, "Exam", "M"),
        (2, 4, 0, 0, 0, 10, 50.0, "TMA", "F"),
    }
    assert {"due_date", "weight", "is_banked", "date_registration", "module_presentation_length"} <= set(final.columns)
    assert "date_submitted" not in final.columns


def test_dayless_totals(tables):
    r = c.dayless_totals(tables).first()
    assert (r.left_rows, r.right_rows, r.merged_rows) == (6, 3, 18)
    assert (r.sum_sum_click, r.sum_score) == (18 * 3, 140.0 * 6)


def test_snapshot_of_the_final_table(tables):
    snap = features.session_snapshot(c.consolidated(tables, LEVELS), c.SESSION, LEVELS, ["studied_credits"])
    got = {r.id_student: (r.quiz, r.url, r.page, r.studied_credits) for r in snap.collect()}
    assert got == {1: (10, 6, 0, 60.0), 2: (0, 0, 0, 120.0)}


def test_sources_from_a_zip(spark, tables, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "star.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in CSV.items():
            z.writestr(f"data/{name}.csv", text)
    zipped = c.load_sources(spark, str(tmp_path / "star.zip"))
    for name in CSV:
        assert zipped[name].dtypes == tables[name].dtypes and records(zipped[name]) == records(tables[name])


def test_activities_from_the_site_table(tables):
    final = c.consolidated(tables, None)
    assert c.activity_levels(tables["vle"]) == ["quiz", "url"] and {"quiz", "url"} <= set(final.columns)


def test_clicks_outside_the_list_are_counted(tables):
    daily = c.daily_activity(tables["studentVle"], tables["vle"], ["quiz"], "other")
    assert records(daily.select("date", "quiz", "other")) == [(0, 5, 1), (5, 0, 4), (7, 0, 8)]
    loss = c.activity_loss(tables["studentVle"], tables["vle"], ["quiz"]).first()
    assert tuple(loss) == (18, 5, 5, 8, 0)
