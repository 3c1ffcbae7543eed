"""Small tables and a brute-force search to compare with."""

import math

SURVEY = "perm string, r1 string, r2 string, r3 string, r4 string"
EMBEDDINGS = "student_id string, question_id string, embedding array<float>"
QUERIES = "qid int, vector array<float>"

NO_BROADCAST = ("spark.sql.autoBroadcastJoinThreshold", "-1")


def plan_of(df, executed=False):
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def distance(a, b):
    if a is None:
        return None
    return math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b, strict=True)))


def _order(row):
    d, perm, question = row[:3]
    number = (2, 0.0) if d is None else (1, 0.0) if math.isnan(d) else (0, d)
    return number, (perm is None, perm or ""), (question is None, question or "")


def brute_force(survey, embeddings, vector, limit):
    """(distance, perm, question, text) of the left join, ranked."""
    rows = []
    for person in survey:
        answers = [e for e in embeddings if e[0] is not None and e[0] == person[0]]
        for _, question, embedding in answers:
            text = person[1 + int(question[1:]) - 1]
            rows.append((distance(embedding, vector), person[0], question, text))
        if not answers:
            rows.append((None, person[0], None, None))
    rows.sort(key=_order)
    return rows[:limit] if limit > 0 else rows


def rounded(rows):
    def number(d):
        return None if d is None else "nan" if math.isnan(d) else round(d, 6)

    return [(number(d), *rest) for d, *rest in rows]


def result_rows(df):
    rows = df.select("result_distance", "perm", "result_question_id", "result_text").collect()
    return rounded([tuple(r) for r in rows])
