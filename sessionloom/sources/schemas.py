"""Declared schemas of the course-log source files, so no read needs an inference pass."""

from __future__ import annotations

from pyspark.sql import types as T

# File layouts, activity names and result codes that results must match.
COURSES = "code_module string, code_presentation string, module_presentation_length int"
ASSESSMENTS = (
    "code_module string, code_presentation string, id_assessment int, assessment_type string, "
    "date int, weight double"
)
VLE = (
    "id_site int, code_module string, code_presentation string, activity_type string, "
    "week_from int, week_to int"
)
STUDENT_INFO = (
    "code_module string, code_presentation string, id_student int, gender string, region string, "
    "highest_education string, imd_band string, age_band string, num_of_prev_attempts int, "
    "studied_credits int, disability string, final_result string"
)
STUDENT_REGISTRATION = (
    "code_module string, code_presentation string, id_student int, date_registration int, "
    "date_unregistration int"
)
STUDENT_ASSESSMENT = (
    "id_assessment int, id_student int, date_submitted int, is_banked int, score double"
)
STUDENT_VLE = (
    "code_module string, code_presentation string, id_student int, id_site int, date int, "
    "sum_click int"
)
ACTIVITIES = [
    "forumng", "homepage", "oucontent", "subpage", "url", "resource", "dataplus", "glossary",
    "oucollaborate", "ouelluminate", "sharedsubpage", "questionnaire", "page", "externalquiz",
    "ouwiki", "dualpane", "repeatactivity", "folder", "htmlactivity", "quiz",
]
STUDENT_ATTRIBUTES = [
    "gender", "region", "highest_education", "imd_band", "age_band", "num_of_prev_attempts",
    "disability", "studied_credits", "final_result",
]
RESULT_LABELS = {0: "Withdrawn", 1: "Fail", 2: "Passed", 3: "Distinction"}

SOURCES: dict[str, str] = {
    "courses": COURSES,
    "assessments": ASSESSMENTS,
    "vle": VLE,
    "studentInfo": STUDENT_INFO,
    "studentRegistration": STUDENT_REGISTRATION,
    "studentAssessment": STUDENT_ASSESSMENT,
    "studentVle": STUDENT_VLE,
}


def flat_schema(counters: list[str]) -> T.StructType:
    """Layout of the flat daily log: keys, numeric-coded attributes, day, counters, score."""
    fields = [T.StructField("id_student", T.LongType())]
    coded = ["code_module", "code_presentation", *STUDENT_ATTRIBUTES, "date", *counters, "score"]
    fields += [T.StructField(c, T.DoubleType()) for c in coded]
    return T.StructType(fields)
