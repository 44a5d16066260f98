"""Variant spellings of the names of persons and organisations.

Names become sets of tokens without diacritics, case, order, forms of address and legal forms. Tokens are
weighted by how rare they are over all names. A prefix-filtered set-similarity join works on the q-grams of
tokens: of two tokens within the tolerated edits, one shares a gram among the rarest few of the other. Only
a name's rarest tokens enter the join (its prefix), against all tokens of the other name: a match leaves one of the two
names without a token that has no partner, so that name's rarest token has one, anywhere in the other. Candidate names are verified by soft token similarity, in which rare tokens count more and
unlike rare tokens, unlike given names or other numbers exclude a match.

Full names that match are linked and grouped. Weak names (a surname with a form of address or an initial)
denote whoever has that surname: they join a group only if exactly one group of the same tenant fits.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.components import components
from chronoweave.plans.scratch import Scratch

#: Forms of address.
TITLES = frozenset("mr mrs ms miss mx dr prof professor doctor sir madam herr frau dipl ing mme mlle monsieur madame maître sr sra srta señor señora don doña dona".split())
#: Legal forms of organisations, without dots.
LEGAL = frozenset("gmbh ag kg ohg ug ev bv nv inc incorporated ltd limited llc llp lp plc corp corporation sa sas sarl srl spa sl slu ab oy as aps pty pte".split())
#: Legal forms written out.
LEGAL_PHRASES = (
    "sociedad anonima", "sociedad limitada", "societe anonyme", "societe a responsabilite limitee", "societa per azioni",
    "gesellschaft mit beschrankter haftung", "aktiengesellschaft", "kommanditgesellschaft", "besloten vennootschap", "naamloze vennootschap",
    "limited liability company", "public limited company", "private limited",
)
#: Words that carry no name.
FILLERS = frozenset("the of and de du des la le les el los für und et y &".split())
_LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})
_DOTTED = re.compile(r"^(?:[A-Za-z]\.){2,}[A-Za-z]?\.?$")
_LEGAL_DOTS = re.compile(r"\b(?:[A-Za-z]\.){1,3}(?:[A-Za-z]\b\.?)?", re.U)
_CAMEL = re.compile(r"(?<=[a-z])(?<!\bMc)(?<!\bMac)(?=[A-Z])")
_TOKEN = re.compile(r"[^\W_]+\.?")
_DIGIT_SLIP = re.compile(r"(?<=[A-Za-z])[0135](?=[A-Za-z])")
_PHRASES = re.compile(r"\b(?:" + "|".join(LEGAL_PHRASES) + r")\b", re.I)


@dataclass(frozen=True)
class Linkage:
    """``edits``: edits tolerated in a token of at least ``long`` letters, one less in shorter ones;
    ``grams``: q; ``agree``: least soft similarity of a match."""

    edits: int = 2
    long: int = 7
    grams: int = 3
    agree: float = 0.6


@dataclass
class Lexicon:
    """Formal names behind given names and nicknames, in lower case without diacritics.

    ``endings`` are the endings of short forms that the list shows at least three times; with them, a short
    form of a name outside the list is recognised by its stem.
    """

    formal: dict[str, frozenset[str]] = field(default_factory=dict)
    endings: tuple[str, ...] = ()

    @classmethod
    def of(cls, rows) -> Lexicon:
        found: dict[str, set[str]] = {}
        for token, formal in rows:
            if token and formal:
                found.setdefault(plain(token).lower(), set()).add(plain(formal).lower())
        seen: dict[str, int] = {}
        for short, names in found.items():
            for name in names - {short}:
                stem = next((short[:n] for n in range(len(short), 2, -1) if short[:n] in name), None)
                if stem:
                    seen[short[len(stem) :]] = seen.get(short[len(stem) :], 0) + 1
        return cls({k: frozenset(v) for k, v in found.items()}, tuple(e for e, n in seen.items() if n >= 3))

    def same(self, a: str, b: str) -> bool:
        return bool(self.formal.get(a, frozenset((a,))) & self.formal.get(b, frozenset((b,))))


    def short_for(self, short: str, name: str) -> bool:
        """Whether one word looks like a short form of the other."""
        if len(short) >= len(name):
            return False
        return any(short.endswith(e) and len(short) - len(e) >= 3 and (name.startswith(short[: len(short) - len(e)]) if len(e) != 1 else short[: len(short) - len(e)] in name) for e in self.endings)


def plain(text: str) -> str:
    """Latin letters without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_LETTERS)) if not unicodedata.combining(c))


def tokens_of(name: str, lexicon: Lexicon) -> tuple[list[str], bool]:
    """Sorted tokens of a name, and whether it is weak. Abbreviated words keep their dot."""
    text = plain(name).strip()
    if _DOTTED.match(text):
        text = text.replace(".", "")
    text = _LEGAL_DOTS.sub(lambda m: m[0].replace(".", "") + " " if m[0].replace(".", "").lower() in LEGAL else m[0], text)
    text = _TOKEN.sub(lambda m: m[0].lower() if m[0].rstrip(".").lower() in LEGAL else m[0], text)  # GmbH is one word
    text = _CAMEL.sub(" ", text)
    text = _DIGIT_SLIP.sub(lambda m: {"0": "o", "1": "l", "3": "e", "5": "s"}[m[0]], text)
    text, written_out = _PHRASES.subn(" ", text)
    out, titled, legal = [], False, written_out
    for raw in _TOKEN.findall(text):
        t = raw.rstrip(".").lower()
        if t in TITLES:
            titled = True
        elif t in LEGAL:
            legal += 1
        elif t not in FILLERS:
            if raw[-1] == "." and len(t) > 2 and not t.isdigit() and t not in lexicon.formal:
                t += "."
            out.append(t)
    if not out:
        out = [t.rstrip(".").lower() for t in _TOKEN.findall(text)]
    if len(out) == 1 and len(out[0]) >= 8 and out[0] not in lexicon.formal:  # two names written as one word
        for cut in range(4, len(out[0]) - 3):
            if out[0][:cut] in lexicon.formal and len(out[0][cut:]) >= 4:
                out = [out[0][:cut], out[0][cut:]]
                break
    full = [t for t in out if len(t.rstrip(".")) > 1]
    weak = not legal and len(full) <= 1 and (titled or len(out) > 1 or (len(full) == 1 and full[0] in lexicon.formal))
    return sorted(out), bool(weak)


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words, ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
    return row[-1]


def _contracted(short: str, word: str) -> bool:
    """Whether the letters of ``short`` occur in ``word`` in their order, from its first letter on."""
    rest = iter(word)
    return 2 <= len(short) <= 0.7 * len(word) and short[0] == word[0] and all(c in rest for c in short)


def alike(a: str, b: str, lexicon: Lexicon, conf: Linkage, common=()) -> float:
    """Similarity of two tokens from 0 to 1. Words in ``common`` may be contracted."""
    if a == b:
        return 1.0
    x, y = a.rstrip("."), b.rstrip(".")
    if any(c.isdigit() for c in x + y):
        return 0.0
    if len(x) == 1 or len(y) == 1:
        return 0.5 if x[0] == y[0] else 0.0
    if x == y:
        return 1.0
    if (a[-1] == "." and y.startswith(x)) or (b[-1] == "." and x.startswith(y)):
        return 0.9
    if (y in common and _contracted(x, y)) or (x in common and _contracted(y, x)):
        return 0.9
    known = (x in lexicon.formal) + (y in lexicon.formal)
    if known and lexicon.same(x, y):
        return 0.95
    if known == 2:
        return 0.0
    short = min(len(x), len(y))
    most = conf.edits if short >= conf.long else conf.edits - 1 if short >= 4 else 0
    d = distance(x, y, most)
    if d <= most:
        return 1.0 - 0.1 * d
    if lexicon.short_for(x, y) or lexicon.short_for(y, x):
        return 0.85
    if known == 1:  # a nickname with a slip of the pen
        known_one, other = (x, y) if x in lexicon.formal else (y, x)
        if any(distance(f, other, 1) <= 1 for f in lexicon.formal[known_one] if len(f) >= 5):
            return 0.85
    return 0.0


def verdict(a: list[str], b: list[str], weight, lexicon: Lexicon, conf: Linkage, common=()) -> str | None:
    """``strong`` or ``weak`` if two token lists can denote the same, else None. ``weight`` rates a token's rarity."""
    digits = lambda ts: sorted(t for t in ts if any(c.isdigit() for c in t))
    if digits(a) != digits(b):
        return None
    scored = sorted(((alike(x, y, lexicon, conf, common), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda s: (-s[0], s[1], s[2]))
    left, right, pairs = set(range(len(a))), set(range(len(b))), []
    for sim, i, j in scored:
        if sim > 0 and i in left and j in right:
            left.discard(i)
            right.discard(j)
            pairs.append((sim, a[i], b[j]))
    full = lambda ts: [t for t in ts if len(t.rstrip(".")) > 1]
    only_a, only_b = full([a[i] for i in left]), full([b[j] for j in right])
    if only_a and only_b:
        return None
    lone_a, lone_b = [a[i] for i in left], [b[j] for j in right]
    initial = lambda ts: any(len(t.rstrip(".")) == 1 for t in ts)
    if (initial(lone_a) and lone_b) or (initial(lone_b) and lone_a):
        return None  # an initial that fits neither the other's initial nor its name
    mass = sum(sim * max(weight(x), weight(y)) for sim, x, y in pairs)
    whole = mass + sum(weight(t) for t in only_a + only_b) + sum((1 - sim) * max(weight(x), weight(y)) for sim, x, y in pairs)
    named = [(x, y) for sim, x, y in pairs if sim > 0.5 and len(full([x, y])) == 2]
    if not any(x.rstrip(".") not in lexicon.formal and y.rstrip(".") not in lexicon.formal for x, y in named):
        return None  # nothing but given names agree
    if not only_a and not only_b and len(named) == len(pairs):
        return "strong" if mass >= conf.agree * whole else None
    if len(named) >= 2 and mass >= conf.agree * whole:
        return "strong"
    return "weak"


_BUCKETS = 65536
_NODE = "role string, rec string, grp string, node string, toks array<string>, weak boolean"


def link_variants(surfaces: DataFrame, lexicon: DataFrame, conf: Linkage = Linkage()) -> DataFrame:
    """``rec`` and ``cluster`` of all records whose name has another record of the same cluster.

    ``surfaces``: ``role`` (``name`` for the name of a record, ``known`` for another name that is known to denote the
    record), ``rec``, ``grp`` (tenant; names of different tenants are never linked) and ``surface``. ``lexicon``:
    ``token`` and ``formal_name``; read to the driver, so it must be the fixed list of given names.

    Rows with a null or blank part are left out, repeated rows count once, an empty table gives no rows. A
    known record without a ``name`` row may connect others and is not returned.
    """
    spark = surfaces.sparkSession
    scratch = Scratch(spark, "names")
    lex = Lexicon.of([tuple(r) for r in lexicon.select("token", "formal_name").collect()])

    def to_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [tokens_of(s, lex) for s in pdf["surface"]]
            toks = [t for t, _ in got]
            yield pd.DataFrame({"role": pdf["role"], "rec": pdf["rec"], "grp": pdf["grp"], "node": [" ".join(t) + ("?" if w else "") for t, w in got], "toks": toks, "weak": [w for _, w in got]})

    clean = surfaces.select("role", "rec", "grp", "surface").where("role is not null and rec is not null and grp is not null and surface is not null and trim(surface) != ''")
    named = scratch.save(clean.mapInPandas(to_nodes, _NODE).where("node not in ('', '?')"))
    nodes = scratch.save(named.select("grp", "node", "toks", "weak").distinct())

    # Rarity: only tokens with at least sqrt(rows) / 4 occurrences are told apart; there are at most 4 * sqrt(rows) of them
    # a token position, which bounds what the driver and the tasks hold. All others are equally rare.
    counts = nodes.select(F.explode("toks").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rows = max(1, nodes.select(F.sum(F.size("toks"))).first()[0] or 1)
    least = max(3, math.isqrt(rows) // 4)
    common = {r.token: r.n for r in counts.where(F.col("n") >= least).collect()}

    def weight(token: str) -> float:
        if len(token.rstrip(".")) == 1:
            return 0.1
        n = common.get(token, least)
        return (0.5 if token in lex.formal else 1.0) * math.log(1 + rows / n)

    def to_prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for grp, node, toks in zip(pdf["grp"], pdf["node"], pdf["toks"]):
                rated = [(weight(t), t.rstrip("."), t[-1] != "." and len(t) >= 4 and t not in lex.formal and t not in common) for t in set(toks)]
                top = max(w for w, _, _ in rated)
                # A rarest token may have its partner by nickname, abbreviation or contraction only; the rarest of the others cannot.
                sure = max((w for w, _, own in rated if own), default=top)
                out += [(grp, node, t, w >= 0.99 * top or (own and w >= 0.99 * sure)) for w, t, own in rated]
            yield pd.DataFrame(out, columns=["grp", "node", "token", "rarest"])

    tokens = scratch.save(nodes.select("grp", "node", "toks").mapInPandas(to_prefix, "grp string, node string, token string, rarest boolean").groupBy("grp", "node", "token").agg(F.max("rarest").alias("rarest")))
    prefix = tokens.where("rarest")
    terms = scratch.save(tokens.select("grp", "token").distinct())
    words = terms.where(~F.col("token").rlike(r"\d")).where(F.length("token") >= 4)
    q = conf.grams
    padded = F.concat(F.lit("#"), F.col("token"), F.lit("#"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - q + 1), lambda i: F.substring(padded, i, F.lit(q)))
    # Grams are ordered by how often their bucket occurs; the number of buckets is fixed.
    frequent = {r.bucket: r.n for r in words.select(F.explode(grams).alias("gram")).groupBy(F.pmod(F.crc32("gram"), F.lit(_BUCKETS)).alias("bucket")).agg(F.count("*").alias("n")).collect()}

    def to_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for grp, token in zip(pdf["grp"], pdf["token"]):
                text = f"#{token}#"
                # A swap of neighbours touches q + 1 grams, any other edit at most q.
                touched = (q + 1) * (conf.edits if len(token) >= conf.long else conf.edits - 1) + 1
                own = sorted({text[i : i + q] for i in range(len(text) - q + 1)}, key=lambda g: (frequent.get(zlib.crc32(g.encode()) % _BUCKETS, 0), g))
                out += [(grp, token, g) for g in own[:touched]]
            yield pd.DataFrame(out, columns=["grp", "token", "gram"])

    keyed = scratch.save(words.mapInPandas(to_grams, "grp string, token string, gram string"))
    most = F.when(F.least(F.length("token"), F.length("token_b")) >= conf.long, 2 * conf.edits).otherwise(2 * conf.edits - 2)
    other = keyed.select("grp", F.col("token").alias("token_b"), "gram")
    near = keyed.join(other, ["grp", "gram"]).where("token < token_b and abs(length(token) - length(token_b)) <= 2").where(F.levenshtein("token", "token_b", 2 * conf.edits) >= 0).where(F.levenshtein("token", "token_b") <= most).select("grp", "token", "token_b").distinct()
    twins = near.unionByName(near.select("grp", F.col("token_b").alias("token"), F.col("token").alias("token_b"))).unionByName(terms.select("grp", "token", F.col("token").alias("token_b")))
    # Given names that the list takes for the same; the list is small.
    formal = sorted({(x, y) for x in lex.formal for y in lex.formal if x != y and lex.same(x, y)})
    if formal:
        listed = spark.createDataFrame(formal, "token string, token_b string")
        twins = twins.unionByName(terms.join(listed, "token").select("grp", "token", "token_b"))
    hits = prefix.select("grp", "node", "token").join(twins, ["grp", "token"]).select("grp", "node", F.col("token_b").alias("token")).distinct()
    met = hits.join(tokens.select("grp", F.col("node").alias("node_b"), "token"), ["grp", "token"]).where("node != node_b")
    cand = met.select("grp", F.least("node", "node_b").alias("node"), F.greatest("node", "node_b").alias("node_b")).distinct()
    side = lambda s: nodes.select("grp", F.col("node").alias(f"node{s}"), F.col("toks").alias(f"toks{s}"), F.col("weak").alias(f"weak{s}"))
    cand = cand.join(side(""), ["grp", "node"]).join(side("_b"), ["grp", "node_b"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(kind=[verdict(list(a), list(b), weight, lex, conf, common) for a, b in zip(pdf["toks"], pdf["toks_b"])])
            pdf = pdf[pdf["kind"].notna()]
            pdf = pdf.assign(kind=pdf["kind"].where(~(pdf["weak"] | pdf["weak_b"]), "weak"))
            yield pdf[["grp", "node", "node_b", "weak", "weak_b", "kind"]]

    pairs = scratch.save(cand.mapInPandas(verify, "grp string, node string, node_b string, weak boolean, weak_b boolean, kind string"))

    vertex = lambda n: F.concat_ws("|", "grp", n)
    edges = pairs.where("kind = 'strong'").select(vertex("node").alias("a"), vertex("node_b").alias("b"))
    # The strong names of one record are one group: a star around the smallest.
    strong = named.where("not weak").select("rec", vertex("node").alias("b")).distinct()
    home = strong.groupBy("rec").agg(F.min("b").alias("v"), F.max("b").alias("last"))
    star = strong.join(home.where("v != last"), "rec").where("v != b").select(F.col("v").alias("a"), "b")
    groups = scratch.save(components(edges.unionByName(star), "a", "b"))
    at_node = groups.select(F.col("id").alias("v"), "component")
    placed = scratch.save(home.select("rec", "v").join(at_node, "v", "left").select("rec", F.coalesce("component", "v").alias("cluster")))

    # Weak names: the one group that a known name, or else a similar full name, points to.
    told = named.where("weak and role = 'known'").select("grp", F.col("node").alias("weak_node"), "rec").join(placed, "rec").select("grp", "weak_node", F.col("cluster").alias("component"), F.lit(0).alias("rank"))
    weak_pairs = pairs.where("weak != weak_b")
    seen = weak_pairs.select("grp", F.when(F.col("weak"), F.col("node")).otherwise(F.col("node_b")).alias("weak_node"), vertex(F.when(F.col("weak"), F.col("node_b")).otherwise(F.col("node"))).alias("v"))
    seen = seen.join(at_node, "v", "left").select("grp", "weak_node", F.coalesce("component", "v").alias("component"), F.lit(1).alias("rank"))
    options = told.unionByName(seen)
    best = options.withColumn("top", F.min("rank").over(Window.partitionBy("grp", "weak_node"))).where("rank = top")
    chosen = best.groupBy("grp", "weak_node").agg(F.min("component").alias("component"), F.max("component").alias("last")).select("grp", F.col("weak_node").alias("node"), F.when(F.col("component") == F.col("last"), F.col("component")).alias("component"), F.lit(True).alias("pointed"))
    weak_named = named.where("weak and role = 'name'").select("grp", "node", "rec").join(chosen, ["grp", "node"], "left")
    weak_rec = weak_named.where("component is not null or pointed is null").select("rec", F.coalesce("component", vertex("node")).alias("cluster"))
    strong_rec = placed
    # A record known only by name variants keeps them; records with a strong and a weak row take the strong one.
    own = named.where("role = 'name'").select("rec").distinct()
    every = strong_rec.join(own, "rec", "left_semi").unionByName(weak_rec.join(strong_rec, "rec", "left_anti")).groupBy("rec").agg(F.min("cluster").alias("cluster"))
    shared = every.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    return every.join(shared, "cluster").select("rec", "cluster")


def record_groups(clusters: DataFrame) -> DataFrame:
    """``rec``, ``cluster`` (its smallest record) and ``n_links``, the number of other records of the cluster: one row a record."""
    whole = clusters.groupBy("cluster").agg(F.min("rec").alias("first"), (F.count("*") - 1).alias("n_links"))
    return clusters.join(whole, "cluster").select("rec", F.col("first").alias("cluster"), "n_links")


def record_pairs(clusters: DataFrame) -> DataFrame:
    """All pairs of the records of a cluster, ``rec_a < rec_b``."""
    return clusters.select("cluster", F.col("rec").alias("rec_a")).join(clusters.select("cluster", F.col("rec").alias("rec_b")), "cluster").where("rec_a < rec_b").select("rec_a", "rec_b")
