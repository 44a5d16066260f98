from datetime import datetime, timezone

import pytest

from chronoweave.operators import timestamps as T


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2025-05-22t10:10:15z", "Europe/Paris", "de-DE", us(2025, 5, 22, 10, 10, 15)),
    (" 2023-05-27T04:11:56Z\t", None, "de-DE", us(2023, 5, 27, 4, 11, 56)),
    ("2023-03-27T10:58:08.000000813Z", None, None, us(2023, 3, 27, 10, 58, 8)),
    ("2023-01-25t05:58:59,544z", None, None, us(2023, 1, 25, 5, 58, 59) + 544_000),
    ("2024-06-10T06:33:01+02:00[Europe/Berlin]", "Asia/Tokyo", None, us(2024, 6, 10, 4, 33, 1)),
    ("2025-05-07 11:18:43+0530", None, None, us(2025, 5, 7, 5, 48, 43)),
    ("2023-02-14 20:51:54-03", None, None, us(2023, 2, 14, 23, 51, 54)),
    ("2023-03-07 19:00:41 CST", "America/Chicago", None, us(2023, 3, 8, 1, 0, 41)),
    ("2023-03-07 19:00:41 CST", "Asia/Shanghai", None, us(2023, 3, 7, 11, 0, 41)),
    ("18.3.2024, 05:31 Uhr", "Europe/Berlin", None, us(2024, 3, 18, 4, 31)),
    ("22 de mayo de 2023 07:26", "Europe/Madrid", None, us(2023, 5, 22, 5, 26)),
    ("13 février 2024 02h30", None, "fr-FR", us(2024, 2, 13, 2, 30)),
    ("10. August 2023 01:43", "Europe/Berlin", None, us(2023, 8, 9, 23, 43)),
    ("December 17, 2024 12:53 AM", None, None, us(2024, 12, 17, 0, 53)),
    ("Thu, 17 Aug 2023 13:00:51 +0000", "Asia/Tokyo", None, us(2023, 8, 17, 13, 0, 51)),
    ("2023-W36-1T09:11:42Z", None, None, us(2023, 9, 4, 9, 11, 42)),
    ("20230209T002820Z", None, None, us(2023, 2, 9, 0, 28, 20)),
    ("1682120241004573", None, None, 1682120241004573),
    ("1682120241", "Asia/Tokyo", None, 1682120241000000),
    ("03/04/2023 10:00", None, "en-US", us(2023, 3, 4, 10)),
    ("03/04/2023 10:00", None, "en-GB", us(2023, 4, 3, 10)),
    ("26/10/2024 11:40", None, "en-US", None),
    ("2023-07-17", "Asia/Tokyo", None, us(2023, 7, 16, 15)),
    ("29.10.2023 02:30", "Europe/Berlin", None, us(2023, 10, 29, 0, 30)),  # twice: the earlier
    ("2024-03-31 02:30", "Europe/Berlin", None, us(2024, 3, 31, 1, 30)),  # never: moved forward
    ("2024-10-06 02:15:00", "Australia/Lord_Howe", None, us(2024, 10, 5, 15, 45)),
    ("31.04.2024 09:00", None, None, None), ("24:61", None, None, None), ("2024", None, None, None), ("2023-07", None, None, None), ("yesterday", None, None, None), ("", None, None, None),
    ("2024-01-01 10:00", "Mars/Base", None, None), ("x" * 100_000, None, None, None), ("13/13/2024", None, "en-US", None),
]


def values(spark, cases):
    rows = [("t", str(i), "f", v, z, loc, 1) for i, (v, z, loc, _) in enumerate(cases)]
    return spark.createDataFrame(rows, "tbl string, record_key string, field string, value string, zone string, locale string, notation int")


def test_cases(spark):
    got = {int(r.record_key): r.utc_us for r in T.normalise(values(spark, CASES)).collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: c[3] for i, c in enumerate(CASES)}


def test_empty_and_nulls(spark):
    assert T.normalise(values(spark, [])).collect() == []
    df = spark.createDataFrame([("a", None, None, None)], "id string, v string, z string, l string")
    assert T.long_form(df, "t", "id", ["v"], "z", "l").collect() == []


def test_mixture_learns_the_order(spark):
    cases = [(f"{d:02d}/{m:02d}/2024", None, None, None) for d in range(13, 28) for m in range(1, 6)] + [("03/04/2024", None, None, None)]
    rows = T.normalise(values(spark, cases), month_first=None).collect()
    last = next(r for r in rows if r.record_key == str(len(cases) - 1))
    assert last.notation == "slash_day" and last.utc_us == us(2024, 4, 3) and not last.ambiguous
    even = T.normalise(values(spark, [("03/04/2024", None, None, None)]), month_first=None).first()
    assert even.ambiguous


@pytest.mark.parametrize("counts,high", [((90, 0, 10), True), ((0, 90, 10), False)])
def test_fit(counts, high):
    assert (T.fit_mixture(*counts, 0.5) > 0.9) is high or (T.fit_mixture(*counts, 0.5) < 0.1) is not high


def test_long_values():
    for value in ("2024-03-05" + " " * 90 + "10:20:30Z", "2024-03-05T10:20:30+00:00[" + "Area/" * 20 + "Place]"):
        notation, month, day, offset, _, problem = T.read(value, None)
        assert (notation, offset, problem) == ("iso", 0, None) and month == day == us(2024, 3, 5, 10, 20, 30)
    assert T.read("x" * 100_000, None)[-1] == "unreadable"


def read_freely(spark, cases):
    return {int(r.record_key): r for r in T.normalise(values(spark, cases), binding=False).collect()}


@pytest.mark.parametrize("locale,evidence,both,want", [
    ("en-US", "{:02d}/03/2024", "04/05/2024", us(2024, 5, 4)), ("en-GB", "03/{:02d}/2024", "04/05/2024", us(2024, 4, 5)),
    ("de-DE", "03.{:02d}.2024", "04.05.2024", us(2024, 4, 5)), ("en-US", "{:02d}-03-2024", "04-05-2024", us(2024, 5, 4)),
])
def test_a_source_is_read_as_it_writes(spark, locale, evidence, both, want):
    cases = [(both, None, locale, None)] * 40 + [(evidence.format(d), None, locale, None) for d in range(13, 28)]
    got = read_freely(spark, cases)
    assert got[0].utc_us == want and got[0].posterior > 0.9 and not got[0].ambiguous and got[0].other_us not in (None, want)
    assert all(got[i].problem is None for i in got)
    alone = read_freely(spark, cases[:1])[0]  # without the source's other values the declaration decides
    assert alone.utc_us == got[0].other_us and not alone.ambiguous


def test_the_fit_overcomes_a_declaration():
    assert T.fit_mixture(0, 100_000, 100_000, 1.0) < 0.001 and T.fit_mixture(0, 5, 100_000, 1.0) < 0.5 < T.fit_mixture(0, 0, 100_000, 1.0)


def test_ambiguity_keeps_both_instants(spark):
    cases = [(f"{d:02d}/03/2024", None, "xx", None) for d in range(13, 17)] + [(f"03/{d:02d}/2024", None, "xx", None) for d in range(13, 18)] + [("04/05/2024", "Europe/Berlin", "xx", None), ("2024-03-05 10:00 CST", None, "xx", None)]
    got = read_freely(spark, cases)
    mixed, zone = got[len(cases) - 2], got[len(cases) - 1]
    assert mixed.ambiguous and {mixed.utc_us, mixed.other_us} == {us(2024, 4, 4, 22), us(2024, 5, 3, 22)}
    assert zone.ambiguous and {zone.utc_us, zone.other_us} <= {us(2024, 3, 5, 16), us(2024, 3, 5, 2), us(2024, 3, 5, 0, 30)}


def test_digits_of_a_source(spark):
    stamps = [(f"202403{d}1020", None, "en-GB", None) for d in range(10, 29)]
    assert read_freely(spark, stamps)[0].ambiguous  # fits a count of milliseconds in 1976 just as well
    got = read_freely(spark, [*stamps, *[(f"202403{d}102030", None, "en-GB", None) for d in range(10, 29)]])
    assert got[0].utc_us == us(2024, 3, 10, 10, 20) and got[0].notation == "stamp" and not got[0].ambiguous
    got = read_freely(spark, [("1682120241004573123", None, None, None), ("-682120241", None, None, None), ("123456789", None, None, None), ("5", None, None, None)])
    assert (got[0].utc_us, got[1].utc_us, got[2].utc_us, got[3].problem) == (1682120241004573, -682120241000000, 123456789000000, "unreadable")


def test_many_sources_are_joined(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_LITERAL_SOURCES", 1)
    cases = [("04/05/2024", None, "en-US", None)] + [(f"{d:02d}/03/2024", None, "en-US", None) for d in range(13, 28)] + [("04/05/2024", None, "en-GB", None)]
    got = read_freely(spark, cases)
    assert got[0].utc_us == us(2024, 5, 4) == got[len(cases) - 1].utc_us
