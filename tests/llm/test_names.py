import pytest

from chronoweave.llm import names as N

LEX = N.Lexicon.of([("Marelin", "Marelin"), ("Mary", "Marelin"), ("Wilmarra", "Wilmarra"), ("Olbrecht", "Olbrecht"), ("Tobrecht", "Tobrecht"), ("Quenby", "Quenby"), ("Quy", "Quenby"), ("Corvandir", "Corvandir"), ("Corvy", "Corvandir"), ("Kerwick", "Kerwick"), ("Kerwy", "Kerwick")])
COMMON = {"company", "works", "partners", "textiles", "association"}


def verdict(a, b):
    (x, _), (y, _) = N.tokens_of(a, LEX), N.tokens_of(b, LEX)
    return N.verdict(x, y, lambda t: 1.0 if t in COMMON or t in LEX.formal else 4.0 if len(t) > 1 else 0.1, LEX, N.Linkage(), COMMON)


@pytest.mark.parametrize("a,b", [
    ("Wilmarra Trolutreth", "TROLUTRETH, Wilmárra"), ("Wilmarra Trolutreth", "WlimarraTrolutreth"), ("Wilmarra Trolutreth", "wilmarra.troluthreth"), ("Marelin Dropon", "Mary Dropon"), ("Pellandro Prironitreth", "Pellandro N. Prironitreth"),
    ("Megrabregoth Textiles Association BV", "Association of Text. Megrabregoth"), ("Movatibull Printing Company BV", "Movvatibull Printing Co."), ("Klonibull Robotics Works S.A.", "Klonibull Robotics Wks Sociedad Anónima"), ("Prof. Wilmarra Mosidul", "wilmarra_mosidul"),
])
def test_same(a, b):
    assert verdict(a, b) == "strong"


@pytest.mark.parametrize("a,b", [
    ("Olbrecht Nimogoth", "Tobrecht Nimogoth"), ("Marelin Dropon", "Quenby Dropon"), ("Robrofilux Catering Company 1", "Robrofilux Catering Company 10"), ("M. Dropon", "Quenby Dropon"), ("Marelin Dropon", "Marelin Busuresil"), ("belt feeder 00-1370VQ", "belt feeder 00-1500ZN"),
])
def test_different(a, b):
    assert verdict(a, b) is None


def test_weak():
    assert N.tokens_of("Mr. Trolutreth", LEX)[1] and N.tokens_of("W. Trolutreth", LEX)[1] and not N.tokens_of("Wilmarra Trolutreth", LEX)[1]
    assert verdict("W. Trolutreth", "Wilmarra Trolutreth") == "weak"
    assert N.distance("Marelin", "Mraelin", 2) == 1 and N.distance("abc", "xyz", 1) == 2


def link(spark, rows):
    s = spark.createDataFrame([(*r, "x") for r in rows], "role string, rec string, grp string, surface string, token string")
    lex = spark.createDataFrame([(k, f) for k, fs in LEX.formal.items() for f in fs], "token string, formal_name string")
    out = {}
    for r in N.link_variants(s, lex).collect():
        out.setdefault(r.cluster, set()).add(r.rec)
    return sorted(map(sorted, out.values()))


def test_groups(spark):
    rows = [("name", "1", "g", "Wilmarra Trolutreth"), ("name", "2", "g", "Trolutréth, Wilmarra"), ("name", "3", "g", "Mr. Trolutreth"), ("name", "4", "h", "Wilmarra Trolutreth"), ("name", "5", "g", "S.A.F.I.L."), ("name", "6", "g", "Silumetz Acoustics Foundation Ltd"), ("known", "6", "g", "SAFIL"),
            ("name", "7", "g", "Marelin Dropon"), ("name", "8", "g", "Quenby Dropon"), ("name", "9", "g", "Dr. Dropon"), ("name", "n", "g", None), ("name", None, "g", "x"), ("name", "e", "g", "  "), ("name", "1", "g", "Wilmarra Trolutreth"), ("name", "long", "g", "Ab" * 5000)]
    assert link(spark, rows) == [["1", "2", "3"], ["5", "6"]]


def test_empty(spark):
    assert link(spark, []) == []


def test_rarest_tokens_of_both_sides_differ(spark):
    crowd = [("name", f"c{i}", "g", f"Gorogometz {chr(97 + i % 26) * 4}{chr(97 + i // 26) * 4}") for i in range(10)]  # rarer than Xandrelle, so the prefix of b
    known = [("name", f"k{i}", "g", f"Xandrelle {chr(97 + i) * 3}qu{chr(98 + i) * 3}") for i in range(20)]
    rows = [*crowd, *known, ("name", "a", "g", "Xandrekle Gorogometz"), ("name", "b", "g", "Xandrelle Gorogometz")]
    lex = spark.createDataFrame([("robert", "robert")], "token string, formal_name string")
    got = {r.rec: r.cluster for r in N.link_variants(spark.createDataFrame(rows, "role string, rec string, grp string, surface string"), lex).collect()}
    assert "a" in got and got["a"] == got.get("b")


def test_legal_forms_and_inner_capitals():
    assert N.tokens_of("Silumetz Acoustics GmbH", LEX) == N.tokens_of("Silumetz Acoustics gmbh", LEX) == (["acoustics", "silumetz"], False)
    assert "mcdonald" in N.tokens_of("Angus McDonald", LEX)[0] and N.tokens_of("WilmarraTrolutreth", LEX)[0] == ["trolutreth", "wilmarra"]
    assert verdict("Meridian Harbour Zylograph Ltd", "Meridian Harbour Ltd") == "strong"


def test_partners_that_no_edit_reaches_still_meet(spark):
    # Each name's rarest token has its partner by nickname or abbreviation; the other token is frequent.
    crowd = [("name", f"c{i}", "g", f"Dropon {chr(97 + i % 26) * 4}{chr(97 + i // 26) * 4}") for i in range(40)]
    rows = [*crowd, ("name", "a", "g", "Corvandir Dropon"), ("name", "b", "g", "Corvy Dropon"), ("name", "h", "g", "Meridian Harbour Zylograph Ltd"), ("name", "i", "g", "Meridian Harbour Ltd")]
    groups = link(spark, rows)
    assert ["a", "b"] in groups and ["h", "i"] in groups


def test_groups_have_one_row_a_record(spark):
    rows = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "x"), ("d", "y"), ("e", "y")], "rec string, cluster string")
    assert sorted(map(tuple, N.record_groups(rows).collect())) == [("a", "a", 2), ("b", "a", 2), ("c", "a", 2), ("d", "d", 1), ("e", "d", 1)]
