import random

import pytest

from chronoweave.llm import pii

GIVEN = ["Marelin", "Joravek", "Tesmina", "Olbrecht", "Quenby", "Dariken", "Hestrel", "Ansovin"]
UNLISTED = ["Yorvask", "Orlenta", "Garimond"]
GOODS = ["label printer", "meter feed", "soil probe", "cargo lift"]


def surname(rng):
    return "".join(rng.choice(["bro", "ta", "gru", "fi", "pe", "ko", "lam", "dri"]) for _ in range(3)).title() + rng.choice(["sk", "tz", "pon", "nard"])


def text(rng):
    out, at, truth = [], 0, []

    def say(*parts):
        nonlocal at
        for p in parts:
            s, kind = p if isinstance(p, tuple) else (p, None)
            if kind:
                truth.append((kind, at, at + len(s)))
            out.append(s)
            at += len(s)

    def name():
        g, s = rng.choice(GIVEN * 3 + UNLISTED), surname(rng)
        return (rng.choice([f"{g} {s}", f"{s}, {g}", f"{g.upper()} {s.upper()}", f"{g} {rng.choice('ABK')}. {s}"]), "person_name")

    phone = lambda: (rng.choice([f"+49 (0)30 / 23125-{rng.randrange(100, 999)}", f"555-555-01{rng.randrange(10, 99)}", f"+33(0)1990 0{rng.randrange(1000, 9999)}", f"(555) 555-01{rng.randrange(10, 99)} ext. {rng.randrange(10, 99)}"]), "phone")
    number = lambda: (rng.choice([f"9{rng.randrange(10, 99)}-00-{rng.randrange(1000, 9999)}", f"X00{rng.randrange(100000, 999999)}K", f"27-{rng.randrange(100000, 999999)}/5Z"]), "id_number")
    street = lambda: (rng.choice([f"{rng.randrange(1, 250)} Harrow Street, Apt {rng.randrange(1, 30)}B", f"Flat {rng.randrange(1, 9)}, {rng.randrange(1, 99)} Old Tannery St.", f"{rng.randrange(1, 250)} copper lane"]), "street_address")
    mail = lambda: (rng.choice([f"{rng.choice(GIVEN).lower()}.x@mail.example", f"{rng.choice(GIVEN).lower()} (at) post dot net dot test", f"q[at]mail.test"]), "email")
    for _ in range(rng.randrange(2, 5)):
        rng.choice([
            lambda: say("I spoke with ", name(), f" about the {rng.choice(GOODS)} yesterday. "), lambda: say("My name is ", name(), ", call ", phone(), " after six. "), lambda: say("Passport no. ", number(), " was issued to ", name(), ". "),
            lambda: say("Ship it to ", street(), ", Tesselburg please. "), lambda: say("You can reach me at ", mail(), " or ", phone(), ". "), lambda: say("Write to ", name(), " (", mail(), ") about the invoice. "),
            lambda: say(f"Order {rng.randrange(1000, 9999)}-{rng.randrange(10000, 99999)} ships with firmware 117.{rng.randrange(10, 99)}.76. "), lambda: say(f"We moved the {rng.choice(GOODS)} to Brack Point before the audit. "), lambda: say(f"Ticket 982-341-{rng.randrange(1000, 9999)} is closed. "),
        ])()
    return "".join(out), truth


@pytest.fixture(scope="module")
def world():
    rng = random.Random(4)
    rows = [text(rng) for _ in range(1300)]
    crf = pii.train([t for t, _ in rows[:900]], frozenset(pii.plain(g) for g in GIVEN))
    return rows[900:], crf


def test_held_out(world):
    rows, crf = world
    got = pii.mentions([t for t, _ in rows], crf)
    hit = sum(len(set(g) & set(t)) for g, (_, t) in zip(got, rows))
    assert hit >= 0.95 * sum(len(t) for _, t in rows) and hit >= 0.95 * sum(len(g) for g in got)


def test_redaction_keeps_the_rest(world):
    rows, crf = world
    for (t, _), g in zip(rows[:50], pii.mentions([t for t, _ in rows[:50]], crf)):
        out = pii.redact(t, g)
        for kind, a, b in g:
            assert t[a:b] and f"[{kind.upper()}]" in out
        bare = "".join(t[j] for j in range(len(t)) if not any(a <= j < b for _, a, b in g))
        assert pii.re.sub(r"\[(?:EMAIL|PHONE|ID_NUMBER|STREET_ADDRESS|PERSON_NAME)\]", "", out) == bare


def test_skip_edges_carry_a_reading(world):
    _, crf = world
    t = pii.tokenize("I spoke with Marelin Brotagru about the soil probe. Brotagru Brotagru")
    cls = crf.encode([t])[1]
    assert [len(ts) for _, ts in crf.skips([t], cls)] == [3]


def test_dirty_rows(spark):
    lex = spark.createDataFrame([(g, "given") for g in GIVEN] + [(None, "x")], "token string, token_kind string")
    rows = [("a", "I spoke with Marelin Brotagru about it. " * 3, 1), ("a", "I spoke with Marelin Brotagru about it. " * 3, 1), ("b", None, 1), ("c", "", 1), (None, "x", 1), ("d", "x " * 60_000 + "q@mail.example", 1)]
    df = spark.createDataFrame(rows, "uuid string, content string, pii_kind int")
    got = pii.find_mentions(df, lex).collect()
    assert ("d", "email") in {(r.uuid, r.pii_kind) for r in got} and len(got) == len(set(got))
    assert pii.find_mentions(df.limit(0), lex).collect() == []


def masked(t, crf, rng):
    """The text without some trigger words, and the spans' new places."""
    hidden, cut = crf.hideable(), []
    for (a, b), kind, w in zip(*(lambda d: (d.spans, d.types, d.words))(pii.tokenize(t))):
        if kind == "word" and w in hidden and rng.random() < 0.6:
            cut.append((a, b))
    return cut


def f1(found, want):
    hit = sum(len(set(f) & set(w)) for f, w in zip(found, want))
    return 2 * hit / max(1, sum(map(len, found)) + sum(map(len, want)))


def ablation(crf, rows):
    """F1 of rules, chain, and chain with skip edges on texts whose triggers are hidden and whose mentions come twice."""
    rng, texts, want = random.Random(8), [], []
    known = pii.Statistics(crf.given, crf.common, crf.triggers)
    for t, truth in rows:
        rest = "".join(f" {t[a:b]} about the audit yesterday." for kind, a, b in truth if kind in ("person_name", "id_number"))
        whole = t + rest
        at, more = len(t), list(truth)
        for kind, a, b in truth:
            if kind in ("person_name", "id_number"):
                more.append((kind, at + 1, at + 1 + b - a))
                at += 1 + b - a + len(" about the audit yesterday.")
        out, pos, shift, moved = [], 0, [], []
        for a, b in masked(whole, crf, rng):
            if not any(s < b and a < e for _, s, e in more):
                out.append(whole[pos:a] + "the")
                shift.append((a, 3 - (b - a)))
                pos = b
        off = lambda x: x + sum(d for a, d in shift if a < x)
        moved = [(k, off(a), off(b)) for k, a, b in more]
        texts.append("".join(out) + whole[pos:])
        want.append(moved)
    by_rules = [pii.spans(d, pii.rules(d, known)) for d in map(pii.tokenize, texts)]
    return f1(by_rules, want), f1(pii.mentions(texts, crf, skip=False), want), f1(pii.mentions(texts, crf), want)


def test_field_adds_to_the_rules(world):
    rows, crf = world
    by_rules, chain, skip = ablation(crf, rows)
    assert by_rules + 0.02 < chain and chain <= skip + 0.001, (by_rules, chain, skip)


def number_text(rng):
    """A number whose form tells nothing: its first place has a trigger, its second none."""
    n = f"{rng.randrange(10**7, 10**8)}"
    personal = rng.random() < 0.5
    head = f"Passport no. {n} was issued to {rng.choice(GIVEN)} {surname(rng)}. " if personal else f"Order {n} ships with the {rng.choice(GOODS)}. "
    head += f"We moved the {rng.choice(GOODS)} to Brack Point before the audit. " * rng.randrange(1, 3)
    whole = head + f"The audit is about {n} and the {rng.choice(GOODS)}."
    at = whole.index(n)
    return whole, [("id_number", i, i + 8) for i in (at, whole.rindex(n))] if personal else []


def test_skip_edges_add_to_the_chain():
    rng = random.Random(12)
    rows = [text(rng) for _ in range(300)] + [number_text(rng) for _ in range(300)]
    crf = pii.train([t for t, _ in rows], frozenset(pii.plain(g) for g in GIVEN))
    held = [number_text(rng) for _ in range(200)]
    numbers = lambda found: [[m for m in f if m[0] == "id_number"] for f in found]
    known, want, texts = pii.Statistics(crf.given, crf.common, crf.triggers), [w for _, w in held], [t for t, _ in held]
    by_rules = f1(numbers(pii.spans(d, pii.rules(d, known)) for d in map(pii.tokenize, texts)), want)
    chain, skip = f1(numbers(pii.mentions(texts, crf, skip=False)), want), f1(numbers(pii.mentions(texts, crf)), want)
    print("numbers:", by_rules, chain, skip)
    assert max(by_rules, chain) + 0.05 < skip and skip > 0.9, (by_rules, chain, skip)


def test_similar_words_and_numbers_share_edges(world):
    _, crf = world
    t = pii.tokenize("Brotagru wrote, Brotagru's card and Brotagrus too; 27-123456 was 27/123456.")
    assert sorted(len(ts) for _, ts in crf.skips([t], crf.encode([t])[1])) == [2, 3]
    assert (crf.skip == crf.skip.T).all() or abs(crf.skip - crf.skip.T).max() < 1e-9


def test_table_statistics_equal_those_in_memory(spark, tmp_path):
    rng = random.Random(9)
    texts = sorted({text(rng)[0] for _ in range(300)})
    df = spark.createDataFrame([(t,) for t in texts], "content string").repartition(3)
    given = frozenset(pii.plain(g) for g in GIVEN)
    assert pii.table_statistics(df, given, len(texts), pii.Scratch(spark, "test")) == pii.statistics([pii.tokenize(t) for t in texts], given)


def test_redacted_table(spark):
    lex = spark.createDataFrame([(g, "given") for g in GIVEN], "token string, token_kind string")
    rng = random.Random(10)
    rows = [(str(i), text(rng)[0], 1) for i in range(120)]
    rows += [("n", None, 1), ("e", "", 1), (None, "x", 1), rows[0], ("same", rows[0][1], 1), ("s", "Reach me at 🙂 q@mail.example or so", 1)]
    got = {r.uuid: r for r in pii.redact_texts(spark.createDataFrame(rows, "uuid string, content string, n_mentions int"), lex).collect()}
    assert len(got) == 124 and got["n"].content is None and got["e"].content == "" and got["s"].content == "Reach me at 🙂 [EMAIL] or so"
    assert got["same"].content == got["0"].content
    assert sum(r.n_mentions for r in got.values()) > 100 and all(r.content.count("@mail.example") == 0 for r in got.values() if r.content)
