"""Rows that are no copies stay, whatever their keys."""

from quarry.llm.simhash import keep_one


def test_null_and_shared_keys(spark):
    rows = [(None, "a text of its own under no key"), (3, "one of two texts of a shared key"), (3, "quite another thing with that key too"), (5, "a copy of some other words"), (None, "a copy of some other words")]
    got = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text for r in got) == sorted({t for _, t in rows})
    assert [r.doc_id for r in got if r.text == rows[3][1]] == [5]
