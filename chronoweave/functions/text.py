"""Text functions of the memory graph, as column expressions where built-ins can say them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words that carry no cue; the second list never counts, not even in upper case.
STOP = """a about all am an and any are as at be been being by can cool could did do does for from get going good great has have he hello help her here hey him his how
i if in is it its just know like make me my need nice no not of okay on or our out please really she should so sure tell than thank thanks that the them then there they
think this to us want was we were what when where which who will with would yes you your""".split()
ALWAYS_STOP = ["hi", "ok", "uh", "um"]
#: A cue token.
CUE = r"[A-Za-z0-9_]+(?:[.-][A-Za-z0-9_]+)*"
#: Phrases by which a writer states a belief.
BELIEF = r"(?i)\b(?:I think|I believe|I feel(?: like)?|feels like|seems(?: like)?|might be|I suspect|in my opinion|I guess|probably)\b"
#: Words that ask for something better.
OPTIMISE = r"(?i)\b(?:best|optimal|optimi[sz]e|improve|better|tune|refine|tweak|sharper|tighter)\b"
#: How goals are told; the last group is the goal.
GOALS = (
    r"(?i)\bI (?:want|wanna|need|plan|hope) to ([^.?!]+)", r"(?i)\bI(?:'m| am) (?:trying|working|learning) (?:to|on) ([^.?!]+)", r"(?i)\bI(?:'m| am) (?:going to|gonna) ([^.?!]+)",
    r"(?i)\bmy goal (?:is|was) (?:to )?([^.?!]+)", r"(?i)\bI aim to ([^.?!]+)", r"(?i)\bI want ([^.?!]+)", r"(?i)\bI(?:'d| would) like to ([^.?!]+)",
)


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def normalize_alias(name: Column) -> Column:
    """Lower case, everything but letters, digits, ``_ ' -`` as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s'-]", " "), r"\s+", " "))


def cue_tokens(text: Column, limit: int = 16) -> Column:
    """Distinct telling words in order; short words in upper case count as acronyms."""
    stop, always = F.array(*map(F.lit, STOP)), F.array(*map(F.lit, ALWAYS_STOP))

    def keep(raw: Column) -> Column:
        low = F.lower(raw)
        acronym = (F.length(raw) <= 2) & (raw == F.upper(raw)) & ~low.isin("a", "i")
        return ~F.array_contains(always, low) & (~F.array_contains(stop, low) | acronym) & ((F.length(raw) > 2) | acronym)

    return F.slice(F.array_distinct(F.transform(F.filter(all_of(text, CUE), keep), F.lower)), 1, limit)


def lexical_matches(query_tokens: Column, *texts: Column) -> Column:
    """How many query tokens occur in the texts."""
    return F.size(F.array_intersect(query_tokens, F.transform(all_of(F.concat_ws(" ", *texts), CUE), F.lower)))


def query_ngrams(query: Column) -> Column:
    """Phrases of three, two and one words, the first of each spelling; one-letter words are left out."""
    words = F.filter(F.split(F.trim(F.regexp_replace(query, r"[,\s]+", " ")), " "), lambda w: F.octet_length(w) > 1)

    def grams(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    every = F.concat(grams(3), grams(2), grams(1))
    return F.filter(every, lambda p, i: F.array_position(F.transform(every, F.lower), F.lower(p)) == i + 1)


def snake_case(text: Column) -> Column:
    """Lower-case words joined by ``_``; ``unknown`` if there are none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unknown").otherwise(s)


def profile_summary(name: Column, lines: Column, most: int = 800) -> Column:
    """``name: a; b; c.`` from the lines in order, ending before the one that would exceed ``most`` characters."""
    clean = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.trim(x), r"\.+$", ""))), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def add(acc: Column, x: Column) -> Column:
        size = F.length(x) + F.when(F.size(acc["kept"]) > 0, 2).otherwise(0)
        over = acc["full"] | (acc["used"] + size > most)
        return F.struct(F.when(over, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"), F.when(over, acc["used"]).otherwise(acc["used"] + size).alias("used"), over.alias("full"))

    joined = F.aggregate(clean, start, add, lambda acc: F.array_join(acc["kept"], "; "))
    return F.when(F.size(lines) > 0, F.concat(name, F.lit(": "), joined, F.lit("."))).otherwise("")


def looks_like_belief(text: Column) -> Column:
    return F.coalesce(text.rlike(BELIEF), F.lit(False))


def telling_words(text: Column) -> Column:
    """Distinct words of more than three letters."""
    return F.array_distinct(F.filter(all_of(F.lower(text), "[a-zA-Z']+"), lambda w: F.length(w) > 3))


def classify_episode(text: Column, prior: Column) -> Column:
    """What an episode does, given the text before it."""
    questions = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    overlap = F.size(F.array_intersect(telling_words(text), telling_words(prior)))
    told = F.coalesce(prior, F.lit("")) != ""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "one_off_query").when(text.rlike(OPTIMISE), "optimization_request").when((questions == 0) & (words >= 60), "narrative_share")
        .when(told & (overlap >= 3) & (questions >= 1), "iterative_refinement").when(told & (overlap >= 2) & (words < 40), "clarification").otherwise("one_off_query")
    )


def goal_clauses(text: Column) -> Column:
    """Goals told in a text, 8 to 200 bytes each."""
    found = F.flatten(F.array(*[all_of(text, p, 1) for p in GOALS]))
    clean = F.transform(found, lambda g: F.regexp_replace(F.regexp_replace(g, r"\s+", " "), r"^[ ,.;:]+|[ ,.;:]+$", ""))
    return F.filter(clean, lambda g: F.octet_length(g).between(8, 200))


_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def snippets(text: str, tokens: list[str], k: int = 2, most: int = 240) -> list[str]:
    """The k sentences with most query tokens, cut to a window around the first; sizes are in characters."""
    scored = []
    for sentence in _SENTENCE.split(text):
        sentence = sentence.strip()
        low = sentence.lower()
        hits = len(set(tokens) & set(re.findall(CUE, low)))
        if len(sentence.encode()) < 12 or not hits:
            continue
        shown = sentence
        if len(sentence) > most:
            first = min((p for t in tokens if (p := low.find(t)) >= 0), default=0)
            start = min(max(0, first - most // 3), len(sentence) - most)
            shown = ("..." if start else "") + sentence[start : start + most] + ("..." if start + most < len(sentence) else "")
        scored.append((-hits, len(shown), shown))
    return [s for _, _, s in sorted(scored, key=lambda x: x[:2])[:k]]


@F.pandas_udf(ArrayType(StringType()))
def evidence_snippets(text: pd.Series, tokens: pd.Series) -> pd.Series:
    """Snippets of the texts for the query's cue tokens."""
    return pd.Series([snippets(t or "", list(q) if q is not None else []) for t, q in zip(text, tokens)])
