"""Mail records as JSON and back."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from postsieve.functions import records as J


def back(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", J.from_record(F.col("t")).alias("x")).orderBy("i").collect()]


def test_every_field_there_and_back(spark):
    shape = ", ".join(f"`{f}` {kind}" for f, (kind, _) in J.FIELDS.items())
    full = ("i", "r" * 64, "n", "src", "a/b", "spam", datetime(2024, 2, 29, 23, 59, 58, 123456, timezone.utc), 'é "q" \\ \n \x01 世界 😀', "a@b.example", "", "c", {"x": "1", "dots.and $": "é"}, "t" * 1000, 0.25, ["u1", "u2"], 3, ["exe", ""])
    bare = ("i", "r", "n", "", "", None, None, "", "", "", "", {}, "", 0.0, [], 0, [])
    df = spark.createDataFrame([full, bare], shape)
    for row, x in zip(df.collect(), df.select(J.from_record(J.to_record()).alias("x")).collect(), strict=True):
        got = x.x.asDict()
        assert got.pop("unknown") == [] and got == row.asDict()
    text = json.loads(df.select(J.to_record().alias("t")).first().t)
    assert text["date"] == "2024-02-29T23:59:58.123456Z" and set(text) == set(J.FIELDS)


def test_records_of_other_shapes(spark):
    texts = ["{}", '{"subject": 5, "urls": "no list", "n_attachments": "many", "html_share": 1, "zeta": {"a": [1]}, "alpha": null}', "[1]", "no json", "", None, '{"date": "soon", "headers": {"n": 7, "l": [1]}}', '{"date": "2024-01-01T10:00:00+02:00", "urls": ["a", null, 3]}']
    empty, other, listed, bad, blank, none, odd, dated = back(spark, texts)
    assert (empty.subject, empty.urls, empty.n_attachments, empty.headers, empty.label, empty.date, empty.unknown) == ("", [], 0, {}, None, None, [])
    assert (other.subject, other.n_attachments, other.html_share, other.unknown) == ("5", 0, 1.0, ["alpha", "zeta"])
    assert listed.subject == "" and listed.unknown == []
    assert bad is None and none is None
    assert blank is None or blank.subject == ""
    assert odd.date is None
    assert dated.date.replace(tzinfo=None) in (datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 10))
    assert dated.urls == ["a", None, "3"]


def test_a_record_is_parsed_once(spark, capsys):
    df = spark.range(3).select(F.concat(F.lit('{"more":1,"subject":"s'), F.col("id").cast("string"), F.lit('"}')).alias("t"))
    x = df.select(J.from_record(F.col("t")).alias("x"))
    x.select("x.subject", "x.text", "x.urls", "x.unknown").explain()
    assert capsys.readouterr().out.count("parseJson") == 1
    assert [(r.x.subject, r.x.unknown) for r in x.collect()] == [(f"s{i}", ["more"]) for i in range(3)]
