"""Timestamps written in many notations, brought to one UTC instant.

Every value is matched against a mixture of notations; some values fit several. A date with slashes, dots or dashes that
ends in the year may have the month or the day first, twelve digits may be a date with a time or count milliseconds, and
a zone abbreviation may mean different offsets. A source (table, field, locale) mixes notations in unknown shares.
Expectation-maximisation estimates the shares per source from aggregated counts: each value gives likelihood to every
notation under which it is an existing date, the posterior picks one, and values whose posterior stays undecided are
marked and keep the second instant. What a source declares enters as a prior worth ``strength`` values, so a source that
says one order and writes the other is read as it writes.

Trying the notations is per-value work with a dozen outcomes, so it runs in Arrow batches; going through the zone's
daylight-saving rules is a built-in column function again.
"""

from __future__ import annotations

import re
import zoneinfo
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names in English, German, French and Spanish, full and usual short forms.
MONTHS = {
    1: "january jan januar jänner janvier janv enero ene",
    2: "february feb februar février fevrier févr fevr febrero",
    3: "march mar märz maerz mär mrz mars marzo",
    4: "april apr avril avr abril abr",
    5: "may mai mayo",
    6: "june jun juni juin junio",
    7: "july jul juli juillet juil julio",
    8: "august aug août aout agosto ago",
    9: "september sep sept septembre septiembre setiembre",
    10: "october oct oktober okt octobre octubre",
    11: "november nov novembre noviembre",
    12: "december dec dezember dez décembre decembre déc diciembre dic",
}
#: Usual offsets of zone abbreviations in minutes; ``abbreviation|area`` goes before the abbreviation.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "brt": -180, "brst": -120, "art": -180, "jst": 540,
    "kst": 540, "npt": 345, "ist": 330, "ist|europe": 60, "cst|asia": 480, "cst|australia": 570, "cdt|australia": 630,
    "est|australia": 600, "edt|australia": 660, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "awst": 480,
    "lhst": 630, "lhdt": 660, "nzst": 720, "nzdt": 780, "sgt": 480, "hkt": 480, "pkt": 300, "sast": 120,
}

_ZONE = r"(z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,4})?(?:\[[^\]]*\])?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_WORD = r"([^\W\d_]+)"
#: notation: (pattern over the lower-case value, names of its groups)
NOTATIONS = {
    "iso": (rf"(\d{{4}})([-/])(\d{{2}})\2(\d{{2}})(?:(?:t|\s+){_TIME}\s*{_ZONE})?$", ("y", "-", "m", "d", "h", "mi", "s", "f", "z")),
    "basic": (rf"(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d+))?\s*{_ZONE}$", ("y", "m", "d", "h", "mi", "s", "f", "z")),
    "week": (rf"(\d{{4}})-?w(\d{{2}})-?(\d)(?:(?:t|\s+){_TIME}\s*{_ZONE})?$", ("y", "m", "d", "h", "mi", "s", "f", "z")),
    "slash": (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,?\s+{_TIME}\s*([ap]\.?m\.?)?\s*{_ZONE})?$", ("m", "d", "y", "h", "mi", "s", "f", "half", "z")),
    "dots": (rf"(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_TIME}(?:\s*uhr)?\s*{_ZONE})?$", ("d", "m", "y", "h", "mi", "s", "f", "z")),
    "day_name": (rf"(?:[^\W\d_]+\.?,\s*)?(\d{{1,2}})\.?\s+(?:de\s+)?{_WORD}\.?,?\s+(?:de\s+)?(\d{{4}})(?:,?\s+(\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?(?:\s*uhr)?\s*{_ZONE})?$", ("d", "m", "y", "h", "mi", "s", "f", "z")),
    "dash": (rf"(\d{{1,2}})-(\d{{1,2}})-(\d{{4}})(?:(?:t|,?\s+){_TIME}\s*([ap]\.?m\.?)?\s*{_ZONE})?$", ("d", "m", "y", "h", "mi", "s", "f", "half", "z")),
    "stamp": (r"(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})?)?$", ("y", "m", "d", "h", "mi", "s")),
    "name_day": (rf"(?:[^\W\d_]+\.?,\s*)?{_WORD}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+{_TIME}\s*([ap]\.?m\.?)?\s*{_ZONE})?$", ("m", "d", "y", "h", "mi", "s", "f", "half", "z")),
}
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$"

#: Up to so many sources are kept as literals in the plan; more are joined.
MAX_LITERAL_SOURCES = 2000


@dataclass(frozen=True)
class Mixture:
    """Settings of the mixture of notations.

    ``strength``: values of evidence that a declared order counts for; ``base``: the same for every notation;
    ``undecided``: a posterior below ``1 - undecided`` marks the value as ambiguous; ``rounds`` and ``tolerance`` end the fit.
    """

    strength: float = 1.0
    base: float = 0.05
    undecided: float = 0.1
    rounds: int = 200
    tolerance: float = 1e-9


def fit_shares(counts: dict[tuple[str, ...], float], prior: dict[str, float], conf: Mixture = Mixture()) -> dict[str, float]:
    """Shares of the notations of one source, by expectation-maximisation with a Dirichlet prior.

    ``counts`` has the number of values for each set of notations that fit a value; ``prior`` the pseudo-counts of
    notations beyond ``conf.base``. The fit starts from the values that fit one notation only.
    """
    names = sorted({n for fits in counts for n in fits} | set(prior))
    weight = {n: conf.base + prior.get(n, 0.0) for n in names}
    total = sum(counts.values()) + sum(weight.values())
    if not names or not total:
        return {}
    share = {n: (weight[n] + counts.get((n,), 0)) / total for n in names}
    for _ in range(conf.rounds):
        new = dict(weight)
        for fits, n in counts.items():
            whole = sum(share[f] for f in fits)
            for f in fits:
                new[f] += n * share[f] / whole
        new = {n: v / total for n, v in new.items()}
        moved = max(abs(new[n] - share[n]) for n in names)
        share = new
        if moved < conf.tolerance:
            break
    return share


def fit_mixture(only_month: float, only_day: float, both: float, prior_month: float, conf: Mixture = Mixture()) -> float:
    """Share of month-first values among two orders; ``prior_month`` is the declared chance of the month-first order."""
    counts = {("day",): only_day, ("month",): only_month, ("day", "month"): both}
    share = fit_shares({k: n for k, n in counts.items() if n}, {"month": conf.strength * prior_month, "day": conf.strength * (1 - prior_month)}, conf)
    return share["month"] / (share["month"] + share["day"])


_MONTH = {word: month for month, words in MONTHS.items() for word in words.split()}
_COMPILED = {name: (re.compile(pattern), parts) for name, (pattern, parts) in NOTATIONS.items()}
#: Microseconds of the units that digits alone may count in; such a count names a time from 1973 to 2286.
_UNITS = {"epoch_s": 1_000_000, "epoch_ms": 1_000, "epoch_us": 1}
_ERA = (10**14, 10**16)
_ORDERED = {"slash", "dots", "dash"}
_DAY_US = 86_400_000_000
_EPOCH_DAY = date(1970, 1, 1).toordinal()
_ZONES = frozenset(zoneinfo.available_timezones())


def _midnight(y: int, m: int, d: int) -> int | None:
    try:
        return (date(y, m, d).toordinal() - _EPOCH_DAY) * _DAY_US
    except ValueError:
        return None


def _offsets(zone: str, area: str) -> dict[str, int]:
    """Minutes east of UTC of a written offset or abbreviation; several if no area tells its meaning."""
    if zone[0] in "+-":
        digits = zone[1:].replace(":", "")
        return {"": (-1 if zone[0] == "-" else 1) * (int(digits[:2]) * 60 + int(digits[2:] or 0))}
    if area and f"{zone}|{area}" in ABBREVIATIONS:
        return {"": ABBREVIATIONS[f"{zone}|{area}"]}
    if zone not in ABBREVIATIONS:
        return {}
    others = {} if area else {f"+{k}": v for k, v in ABBREVIATIONS.items() if k.startswith(f"{zone}|")}
    return {"+" + zone if others else "": ABBREVIATIONS[zone]} | others


def _digits(low: str) -> list[tuple[str, int, int | None, bool]]:
    n = int(low)
    out = [(unit, n * us, 0, True) for unit, us in _UNITS.items() if _ERA[0] <= abs(n * us) < _ERA[1]]
    if _ERA[0] <= abs(n) // 1000 < _ERA[1]:
        out.append(("epoch_ns", n // 1000, 0, True))
    return out


def readings(value: str, zone: str | None) -> tuple[list[tuple[str, int, int | None, bool]], str | None, str | None]:
    """All readings (notation, local time, offset, instant) of one value, the notation's family, and a problem if none.

    Local times count microseconds from 1970-01-01 00:00 on the writer's clock. ``offset`` is null without a
    written zone; an ``instant`` needs no zone at all. Runs of blanks are read as one; a value may have any length.
    """
    low = " ".join(value.lower().split())
    out: list[tuple[str, int, int | None, bool]] = []
    if len(low) <= 20 and low.lstrip("+-").isdigit() and low.isascii() and len(low) - len(low.lstrip("+-")) <= 1:
        out = _digits(low)
    for family, (pattern, names) in _COMPILED.items():
        if found := pattern.match(low):
            part = dict(zip(names, found.groups()))
            break
    else:
        return out, "epoch" if out else None, None if out else "unreadable"
    y, d = int(part["y"]), int(part["d"])
    m = int(part["m"]) if part["m"].isdigit() else _MONTH.get(part["m"])
    if m is None:
        return [], None, "unreadable"
    if family == "week":
        try:
            days = {family: (date.fromisocalendar(y, m, d).toordinal() - _EPOCH_DAY) * _DAY_US}
        except ValueError:
            days = {family: None}
    elif family in _ORDERED:
        first, second = (m, d) if family == "slash" else (d, m)
        days = {f"{family}_month": _midnight(y, first, second), f"{family}_day": _midnight(y, second, first)}
    else:
        days = {family: _midnight(y, m, d)}
    days = {n: v for n, v in days.items() if v is not None}
    if not days:
        return (out, "epoch", None) if out else ([], family, "no_such_date")
    hour, half = int(part.get("h") or 0), (part.get("half") or "")[:1]
    minute, second = int(part.get("mi") or 0), int(part.get("s") or 0)
    if minute > 59 or second > 59 or (not 1 <= hour <= 12 if half else hour > 23):
        return (out, "epoch", None) if out else ([], family, "no_such_time")
    if half:
        hour = hour % 12 + (12 if half == "p" else 0)
    clock = ((hour * 60 + minute) * 60 + second) * 1_000_000 + int((part.get("f") or "")[:6].ljust(6, "0"))
    offsets: dict[str, int | None] = {"": None}
    if written := part.get("z"):
        offsets = _offsets(written, (zone or "").split("/")[0].lower())
        if not offsets:
            return [], family, "unknown_zone"
    elif zone is not None and zone not in _ZONES:
        return [], family, "unknown_zone"
    out += [(n + tag, v + clock, None if o is None else o * 60_000_000, False) for n, v in days.items() for tag, o in offsets.items()]
    return out, family, None


def read(value: str, zone: str | None) -> tuple:
    """(family, local time month first, local time day first, offset, instant, problem) of one value's first readings."""
    found, family, problem = readings(value, zone)
    if not found:
        return family, None, None, None, False, problem
    by = {n.partition("+")[0].rpartition("_")[2]: us for n, us, _, _ in found}
    one = found[0][1] if family not in _ORDERED else None
    return family, by.get("month", one), by.get("day", one), found[0][2], found[0][3], None


def long_form(df: DataFrame, table: str, record: str, fields: list[str], zone: str, locale: str) -> DataFrame:
    """One row per record and text field: ``tbl, record_key, field, value, zone, locale``; nulls are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    rows = df.select(F.lit(table).alias("tbl"), F.col(record).cast("string").alias("record_key"), F.col(zone).alias("zone"), F.col(locale).alias("locale"), pairs.alias("p"))
    return rows.select("tbl", "record_key", "p.field", "p.value", "zone", "locale").where("value is not null")


#: Values that several notations may fit. The ratio of two shares of a source depends on no other values.
_COMPETING = r"^\s*\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|^\s*[+-]?\d+\s*$|[A-Za-z]\s*$"


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers of values of a partition for each source and set of notations."""
    n: Counter = Counter()
    for pdf in batches:
        for v, z, s in zip(pdf["value"], pdf["zone"].where(pdf["zone"].notna(), None), pdf["source"]):
            if fits := readings(v, z)[0]:
                n[s, "|".join(sorted(f[0] for f in fits))] += 1
    yield pd.DataFrame([(s, f, c) for (s, f), c in n.items()], columns=["source", "fits", "n"])


_CHOSEN = "tbl string, record_key string, field string, value string, zone string, notation string, posterior double, undecided boolean, local long, offset_us long, instant boolean, other_local long, other_offset_us long, other_instant boolean, problem string"


def _choose(shares: dict[str, dict[str, float]] | None, prior, month_first: tuple[str, ...] | None, binding: bool, conf: Mixture):
    """Arrow function: the reading of the greatest posterior, and the next one."""

    def against(name: str, value: str, locale: str | None) -> bool:
        if not binding or month_first is None:
            return False
        if name.startswith("epoch"):
            return len(value.strip()) not in (10, 13, 16)
        if name.startswith("slash"):
            return name.startswith("slash_month") != (locale in month_first)
        return name.startswith("dots_month")

    def one(value: str, zone: str | None, locale: str | None, source: str, share: dict[str, float]) -> tuple:
        found, family, problem = readings(value, zone)
        if not found:
            return family, None, False, None, None, False, None, None, False, problem
        if len(found) == 1:
            ranked, top = found, 1.0
        else:
            declared = prior(source)
            p = [share.get(f[0], conf.base + declared.get(f[0], 0.0)) for f in found]
            order = sorted(range(len(found)), key=lambda i: (-p[i], i))
            ranked, top = [found[i] for i in order], p[order[0]] / sum(p)
        kept = [f for f in ranked if not against(f[0], value, locale)]
        best, other = (kept or ranked)[0], next((f for f in ranked if f is not (kept or ranked)[0]), (None, None, None, False))
        undecided = len(found) > 1 and top < 1 - conf.undecided and other[1:3] != best[1:3]
        return best[0].partition("+")[0], top, undecided, *best[1:], *other[1:], None if kept else "order"

    names = ["notation", "posterior", "undecided", "local", "offset_us", "instant", "other_local", "other_offset_us", "other_instant", "problem"]
    whole = {"local": "Int64", "offset_us": "Int64", "other_local": "Int64", "other_offset_us": "Int64", "posterior": "float64", "undecided": bool, "instant": bool, "other_instant": bool}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            null = lambda c: pdf[c].where(pdf[c].notna(), None)
            own = [dict(x) if x is not None else {} for x in pdf["shares"]] if shares is None else [shares.get(s, {}) for s in pdf["source"]]
            got = [one(*x) for x in zip(pdf["value"], null("zone"), null("locale"), pdf["source"], own)]
            yield pd.concat([pdf[["tbl", "record_key", "field", "value", "zone"]], pd.DataFrame(got, columns=names, index=pdf.index).astype(whole)], axis=1)

    return run


def normalise(values: DataFrame, month_first: tuple[str, ...] | None = ("en-US",), conf: Mixture = Mixture(), binding: bool = True) -> DataFrame:
    """UTC instants of the values of :func:`long_form`.

    Returns ``tbl, record_key, field, value``, ``canonical`` (already written as ``YYYY-MM-DDTHH:MM:SS[.f]Z``), ``notation``,
    ``posterior`` of the most likely notation, ``ambiguous``, ``utc_us``, ``other_us`` (the instant of the next likely
    reading, null if there is none) and ``problem`` (null, ``unreadable``, ``no_such_date``, ``no_such_time``,
    ``unknown_zone`` or ``order``). ``month_first`` names the locales that declare the month-first order, all others declare
    day first; None declares nothing and leaves the order to the mixture.

    With ``binding`` a declaration is a rule that is checked after the posterior: slash dates go by the locale, dates with dots
    have the day first, digits alone have 10, 13 or 16 places; the most likely reading that keeps the rule stands, and a value
    that has none is given up (``order``). Without it the posterior alone chooses.

    A value without zone is local to ``zone`` (UTC where that is null). A repeated local time is the earlier
    instant, a skipped one moves forward. Blank, unreadable and incomplete dates have null ``utc_us``. Rows stay as they
    are, repeats included. An empty table gives no rows.
    """
    cols = [F.col(c) for c in ("tbl", "record_key", "field", "value", "zone", "locale")]
    well_formed = F.col("locale").rlike(r"^[A-Za-z]{2,3}([-_][A-Za-z]{2})?$")
    v = values.select(*cols, F.concat_ws("|", "tbl", "field", F.when(well_formed, F.col("locale")).otherwise("")).alias("source"))

    def prior(source: str) -> dict[str, float]:
        if month_first is None:
            return {}
        order = "month" if source.rpartition("|")[2] in month_first else "day"
        return {f"slash_{order}": conf.strength, f"dash_{order}": conf.strength, "dots_day": conf.strength}

    def fit(source: str, counts: dict[str, float]) -> dict[str, float]:
        return fit_shares({tuple(k.split("|")): n for k, n in counts.items()}, prior(source), conf)

    counts = v.where(F.col("value").rlike(_COMPETING) & ~F.col("value").rlike(CANONICAL)).select("value", "zone", "source").mapInPandas(_count, "source string, fits string, n long")
    per_source = counts.groupBy("source", "fits").agg(F.sum("n").alias("n")).groupBy("source").agg(F.collect_list(F.struct("fits", "n")).alias("counts"))  # one entry a set of notations
    few = per_source.limit(MAX_LITERAL_SOURCES + 1).collect()
    if len(few) <= MAX_LITERAL_SOURCES:
        chosen = v.mapInPandas(_choose({r.source: fit(r.source, {c.fits: c.n for c in r.counts}) for r in few}, prior, month_first, binding, conf), _CHOSEN)
    else:

        def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"source": pdf["source"], "shares": [fit(s, {c["fits"]: c["n"] for c in cs}) for s, cs in zip(pdf["source"], pdf["counts"])]})

        shares = per_source.mapInPandas(fitted, "source string, shares map<string,double>")
        chosen = v.join(shares, "source", "left").mapInPandas(_choose(None, prior, month_first, binding, conf), _CHOSEN)

    def utc(local: str, offset: str, instant: str) -> Column:
        in_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.col("zone")))
        return F.when(F.col(instant) | (F.col(offset).isNull() & F.col("zone").isNull()), F.col(local)).when(F.col(offset).isNotNull(), F.col(local) - F.col(offset)).otherwise(in_zone).cast("long")

    return chosen.select(
        "tbl", "record_key", "field", "value", F.col("value").rlike(CANONICAL).alias("canonical"), "notation", "posterior", F.col("undecided").alias("ambiguous"),
        F.when(F.col("problem").isNull(), utc("local", "offset_us", "instant")).alias("utc_us"), utc("other_local", "other_offset_us", "other_instant").alias("other_us"), "problem",
    )
