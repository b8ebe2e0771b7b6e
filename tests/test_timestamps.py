from datetime import UTC, datetime

from strandline.operators import timestamps

CLOCKS = [("ny", "America/New_York", False), ("be", "Europe/Berlin", True), ("utc", "UTC", False)]


def us(*a):
    d = datetime(*a, tzinfo=UTC) - datetime(1970, 1, 1, tzinfo=UTC)
    return (d.days * 86400 + d.seconds) * 10**6 + d.microseconds


def read(spark, rows):
    clocks = spark.createDataFrame(CLOCKS, "tool string, tz_name string, day_first boolean")
    df = spark.createDataFrame([(i, s, v) for i, (s, v) in enumerate(rows)], "n int, source string, value string")
    return [(r["epoch_us"], r["state"]) for r in timestamps.normalise(df, clocks).orderBy("n").collect()]


def test_formats(spark):
    want = [
        (("ny", "2026-02-12T14:04:38Z"), us(2026, 2, 12, 14, 4, 38)),
        (("ny", " 2025-08-24t01:42:07z "), us(2025, 8, 24, 1, 42, 7)),
        (("ny", "Thu, 28 Aug 2025 15:30:24 -0400"), us(2025, 8, 28, 19, 30, 24)),
        (("ny", "1710180612.919789"), 1710180612919789),
        (("ny", "1721107226121"), 1721107226121000),
        (("ny", "1720469775170057"), 1720469775170057),
        (("be", "2025-12-06T23:30:25.027+0100"), us(2025, 12, 6, 22, 30, 25, 27000)),
        (("be", "2025-10-22T13:49:06.788347935Z"), us(2025, 10, 22, 13, 49, 6, 788347)),
        (("be", "07.01.2026 12:57"), us(2026, 1, 7, 11, 57)),
        (("be", "20260428 04:51:24 UTC"), us(2026, 4, 28, 4, 51, 24)),
        (("be", "20260612T070157Z"), us(2026, 6, 12, 7, 1, 57)),
        (("be", "25 Oct 2025 04:25:57 CEST"), us(2025, 10, 25, 2, 25, 57)),
        (("ny", "2025-10-01 10:52:37 UTC+05:45"), us(2025, 10, 1, 5, 7, 37)),
        (("ny", "2025-08-18T11:48:12-04:00[America/New_York]"), us(2025, 8, 18, 15, 48, 12)),
        (("ny", "2025-11-25T04:17:45,910+01:00"), us(2025, 11, 25, 3, 17, 45, 910000)),
        (("be", "2024-10-25"), us(2024, 10, 24, 22)),
        (("ny", "Jul 18, 2026 12:03 AM EDT"), us(2026, 7, 18, 4, 3)),
        (("ny", "Jul 18, 2026 12:03 PM"), us(2026, 7, 18, 16, 3)),
        (("ny", "3/4/2025 3:15 PM"), us(2025, 3, 4, 20, 15)),
        (("be", "3/4/2025 15:15"), us(2025, 4, 3, 13, 15)),
    ]
    assert read(spark, [w[0] for w in want]) == [(w[1], "resolved") for w in want]


def test_daylight_saving_edges(spark):
    rows = [("ny", "2 Nov 2025 01:30:00 EDT"), ("ny", "2 Nov 2025 01:30:00 EST"), ("ny", "2025-11-02 01:30:00"), ("ny", "2025-03-09 02:30:00"), ("be", "2025-10-26 02:30:00")]
    assert [x for x, _ in read(spark, rows)] == [us(2025, 11, 2, 5, 30), us(2025, 11, 2, 6, 30), us(2025, 11, 2, 5, 30), us(2025, 3, 9, 7, 30), us(2025, 10, 26, 0, 30)]


def test_values_that_are_no_instant(spark):
    rows = [("ny", v) for v in ("", "-", "TBD", "yesterday", "0000-00-00 00:00:00", "13/32/2025 10:00 AM", "2026-02-30", "2025-01-01T25:00:00Z", None, "x" * 50000)]
    assert all(r == (None, "unparsed") for r in read(spark, rows))


def test_mixture_settles_or_marks_ambiguity(spark):
    rows = [("unknown", "25/11/2025 10:00")] * 30 + [("unknown", "3/4/2025 10:00"), ("lone", "3/4/2025 10:00"), ("lone", "4/4/2025 10:00"), (None, "2025-01-01")]
    got = read(spark, rows)
    assert got[30] == (us(2025, 4, 3, 10), "resolved")
    assert got[31] == (None, "ambiguous")
    assert got[32] == (us(2025, 4, 4, 10), "resolved")  # both readings agree
    assert got[33] == (us(2025, 1, 1), "resolved")


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([("a", "ny", "2025-01-01T00:00:00Z", None, 1)] * 2, "doc_id string, tool string, created_at string, updated_at string, value int")
    xc = spark.createDataFrame([], "xc_id bigint, source_tool string, asserted_at string")
    clocks = spark.createDataFrame(CLOCKS, "tool string, tz_name string, day_first boolean")
    assert [tuple(r) for r in timestamps.found(docs, xc, clocks).collect()] == [("raw_docs", "a", "created_at", us(2025, 1, 1))]
    assert timestamps.found(docs.where("false"), xc, clocks).count() == 0
