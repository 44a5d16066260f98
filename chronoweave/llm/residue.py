"""Template residue, filler, error pages and script notices among documents.

Seeds are documents that rules can trust: unfilled placeholders outside code and quotations, or a body whose
every sentence is filler, an error message or a notice about scripts. Near-duplicates of seeds are found
with partitioned SimHash tables over five-word shingles: a table keeps some bits of the fingerprint, and only
documents with equal bits in a table meet within a Hamming distance. The tables miss pairs, more of them the larger
the input; a prefix filter over the shingles is exact and adds what they miss. The Jaccard similarity of the shingles
verifies a pair. Labels then spread from seeds through the connected components, one ring of neighbours a round; only
components that hold a seed are walked, and all of these: what lies between may be clean. A document that got its
label this way must show residue itself: residue in enough of its sentences, or, in a component with a placeholder,
text that looks unfilled.

Equal bodies are one class throughout, so a notice that a third of all documents repeat is one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.plans.scratch import Scratch


@dataclass(frozen=True)
class NearDuplicates:
    """``tables``: SimHash tables; ``distance``: most unlike bits of a pair; ``similarity``: least Jaccard similarity of
    the shingles of ``shingle`` words; ``evidence``: least share of residue sentences of a labelled neighbour."""

    tables: int = 16
    distance: int = 14
    similarity: float = 0.8
    shingle: int = 5
    evidence: float = 0.5


#: Notations of placeholders that a template engine or a writer fills in.
PLACEHOLDERS = (
    r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^%\n]{1,60}%\}", r"<%[=-]?[^%\n]{1,60}%>", r"#\{[\w. ]{1,40}\}", r"\$\{(?!(?:HOME|PATH|USER|PWD|SHELL|LANG|TMPDIR|HOSTNAME|EDITOR|TERM)\})[\w. ]{1,40}\}",
    r"%%[A-Za-z_]{2,40}%%", r"\[\[[\w. ]{1,40}\]\]", r"\b__(?!FILE__|LINE__|DATE__|TIME__)[A-Z][A-Z_]{1,40}__", r"\bXX_[A-Z_]{2,40}_XX\b", r"(?<!\w)\$[A-Z_]{2,40}\$(?!\w)",
    r"<(?i:your|insert|enter|add|company|first|last|user|customer|product)\b(?i:[\w ]{0,40})>", r"\[(?i:insert|your|enter|add|company|first name|last name|customer|product|placeholder)\b[^\[\]\n]{0,40}\](?!\()",
    r"(?<![\w{$%#])\{\d\}(?![\w}])",
)
#: Looser notations, which count only in near-duplicates of a text with a placeholder.
UNFILLED = (
    r"\[ *[A-Za-z][\w .'/-]{0,40}\](?!\()", r"\{ *[A-Za-z][\w .-]{0,40}\}", r"<< *[A-Za-z][\w .-]{0,40}>>", r"<[A-Z][A-Z_ ]{2,40}>", r"\(\( *[A-Za-z][\w .-]{0,40}\)\)",
    r"(?<!\w)(?P<mark>[@#%^$|]{1,2})[A-Za-z][A-Za-z_]{1,40}(?P=mark)(?!\w)", r"(?<=[\w:,] )_{3,}", r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b", r"\b[Xx]{3,}\b",
)
#: Words of the usual Latin filler.
LATIN = frozenset("""lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate
velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split())
#: Lines around a page's body.
FURNITURE = r"(?:©.*|.*\ball rights reserved\b.*|cookie (?:settings|policy|preferences)|skip to (?:main )?content|powered by [\w .-]{1,40}|(?:[\w ]{1,20}\s[|·»]\s){2,}[\w ]{1,20}|privacy policy|terms of (?:use|service)|back to top|sign up|share this (?:page|post)|subscribe to our newsletter|advertisement|menu|search)"
_REASON = r"(?:bad request|unauthori[sz]ed|payment required|forbidden|(?:page )?not found|method not allowed|request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|access denied|permission denied|moved permanently)"
#: Sentences of error pages, in English, German, French and Spanish.
ERRORS = (
    rf"(?:(?:http|server)\s+)?(?:status|error|fehler|erreur|code)?(?:\s+code)?[\s:#-]*[45]\d\d[\s.:()\[\]–-]*(?:{_REASON}|error|fehler|erreur)?[\s.)!]*", rf"(?:error\s*[:–-]?\s*)?{_REASON}[.!]*",
    r"(?:http )?(?:error|fehler|erreur) [45]\d\d\s*[:–-].{0,60}", r"[\w.-]+/\d+(?:\.\d+)+", r"(?:reference|request|incident|trace|ray|support|error)\s*(?:id|no\.?|number|code)?\s*[:#].{0,48}",
    r".*\b(?:oops|something went wrong|an (?:unexpected )?error (?:has )?occurred|try again later|temporarily unavailable|down for maintenance|due to maintenance)\b.*",
    r".*\b(?:could not|cannot|can't|couldn't) be (?:found|reached|displayed|loaded)\b.*", r".*\bwe (?:could not|cannot|can't|couldn't) find (?:the|that|this|your) (?:page|site|file|document)\b.*", r".*\b(?:was removed or never existed|no longer (?:exists|available)|does not exist|page you (?:requested|are looking for))\b.*",
    r".*\byour session (?:has )?(?:expired|timed out)\b.*", r"(?:please )?(?:log|sign) in to continue\b.*", r".*\bcontact (?:the|your|our) (?:site |system )?(?:administrator|webmaster|support)\b.*",
    r"(?:please )?(?:go |return )?(?:back )?to (?:the )?home ?page\.?", r"the server (?:did not|failed to|could not|is (?:too )?busy|encountered).*", r".*\byou (?:do not|don't) have (?:permission|access|rights)\b.*", r".*\b(?:please )?slow down\b.*",
    r".*\berror establishing\b.*", r"checking your browser\b.*", r".*\bbefore you continue\b.{0,5}", r".*\b(?:cannot|could not) (?:load|connect)\b.*",
    r".*\b(?:seite|datei) (?:wurde )?nicht gefunden\b.*", r".*\bein (?:unerwarteter )?fehler aufgetreten\b.*", r".*\bversuchen sie es (?:bitte )?(?:später|erneut|noch einmal)\b.*", r".*\b(?:dienst|server|seite) (?:ist )?(?:derzeit |zurzeit |vorübergehend )?nicht (?:verfügbar|erreichbar)\b.*", r".*\b(?:zugriff|zugang) verweigert\b.*", r".*\bsitzung ist abgelaufen\b.*",
    r".*\bpage (?:introuvable|non trouvée)\b.*", r".*\bune erreur (?:s'est produite|est survenue)\b.*", r".*\bveuillez réessayer\b.*", r".*\b(?:momentanément|temporairement) indisponible\b.*", r".*\baccès (?:refusé|interdit)\b.*", r".*\bsession a expiré\b.*",
    r".*\bpágina no (?:encontrada|existe)\b.*", r".*\bha ocurrido un error\b.*", r".*\bint[eé]ntelo de nuevo\b.*", r".*\b(?:no está disponible|temporalmente no disponible)\b.*", r".*\bacceso denegado\b.*", r".*\bsesión ha (?:caducado|expirado)\b.*",
)
_SCRIPT = r"(?:java-?\s?scripts?|\bjs\b|\bscripts?\b|\bscripting\b|\bskripte?n?\b|\bcookies\b)"
_ENABLE = r"(?:\b(?:re-?)?enabl|\bactivat|\bturn(?:ed)?\b|\bswitch(?:ed)?\b|\ballow|\bpermit|\brequire|\bdisabl|\bneed|\bblock|\baktivier|\beinschalt|\bzulass|\berlaub|\bnicht aktiv|\bdeaktivier|\bautoris|\bactiver\b|\bdésactiv|\bactiv[ae]|\bhabilit|\bpermit|\bdesactiv|\bdeshabilit)"
#: Sentences of notices that scripts are needed.
NOTICES = (rf"(?=.*{_SCRIPT})(?=.*{_ENABLE}).*", r".*\b(?:widget|page|site|comments?) cannot (?:load|be shown|be displayed)\b.*", r"(?:please )?(?:then )?reload(?: the page)?\.?", r"sorry[.!]*")
#: Sentences of filler.
FILLER = (
    r"(\S+)(?:\s+\1){2,}[.!]*", r"(?:(?:asdf|qwer|qwerty|test|blah?|foo|bar|x{3,}|hjkl)[\s.]*){2,}", r"(?:todo|tbd|fixme)\b[:. ]*(?:$|(?:write|add|fill|insert|text|content).{0,60})", r".{0,40}\b(?:text|content|body|title|answer|question|name) goes here\b.{0,10}",
    r".{0,20}\b(?:sample|example|dummy|placeholder|filler) (?:question|answer|text|body|content|title)\b.{0,40}", r".{0,10}\breplace this (?:text|content)\b.{0,40}", r"(?:your )?(?:text|content) here\.?",
    r".{0,20}\b(?:texto|contenido) de (?:ejemplo|relleno)\b.{0,40}", r".{0,20}\btexte d['’](?:exemple|attente)\b.{0,40}", r".{0,10}\bhier steht (?:später|bald)\b.{0,40}", r".{0,20}\b(?:beispieltext|blindtext|platzhaltertext|mustertext)\b.{0,40}", r"coming soon[.!]*",
)
#: Words by which a writer speaks for themself or asks. A site says we, so that is none.
_PERSONAL = re.compile(r"(?<![\w'])(?:i|i'm|i've|my|me|ich|mir|mein\w*|je|j'\w*|mon|ma|mes|yo|mi|uso)(?![\w'])|[?`\"“”«»„]|https?://", re.I)

_PLACEHOLDER = re.compile(r"(?=[{<\[%_$#X])(?:" + "|".join(PLACEHOLDERS) + ")")  # all start with one of these
_UNFILLED = re.compile("|".join(f"(?:{p})" for p in UNFILLED))
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|<(code|pre)\b.*?</\1>|^(?: {4}|\t).*$", re.S | re.M | re.I)
_CODE_LINES = re.compile(r"^(?: {4}|\t).*$", re.M)
_QUOTED = re.compile(r"\"[^\"\n]{0,80}\"|“[^”\n]{0,80}”|„[^“”\n]{0,80}[“”]|«[^»\n]{0,80}»")
_FURNITURE = re.compile(FURNITURE, re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_UNIT = re.compile(r"(?<=[.!?…])\s+|\n+")
# A sentence matches ``.*x.*`` as a whole if x is found in it; one search for all such x is much faster.
_INSIDE = [p for p in (*ERRORS, *NOTICES[1:], *FILLER[1:]) if p.startswith(".*") and p.endswith(".*")]
_FOUND = re.compile("|".join(f"(?:{p[2:-2]})" for p in _INSIDE), re.I)
_WHOLE = re.compile("|".join(f"(?:{p})" for p in (*ERRORS, *NOTICES[1:], *FILLER[1:]) if p not in _INSIDE), re.I)
_HAS_SCRIPT, _HAS_ENABLE = re.compile(_SCRIPT, re.I), re.compile(_ENABLE, re.I)
_RUN = re.compile(r"(?<!\S)" + FILLER[0] + r"(?!\S)", re.I)
_ALL_WE_KNOW = re.compile(r"that(?: is|'s) all we know\.?")
_WORD = re.compile(r"[^\W_]+", re.U)
_NUMBER = re.compile(r"\b(?=\w*\d)[\da-f]+\b|\d+")


def _latin(words: list[str]) -> bool:
    return len(words) >= 4 and sum(w in LATIN for w in words) >= 0.8 * len(words)


def is_residue(unit: str) -> bool:
    """Whether one sentence is filler, an error message or a notice about scripts."""
    low = unit.strip().lower()
    if _ALL_WE_KNOW.fullmatch(low):
        return True
    if _PERSONAL.search(low):
        return False
    words = _WORD.findall(low)
    if _latin(words):
        return True
    low, repeats = _RUN.subn(" ", low)
    low = low.strip(" .!")
    if repeats and not low:
        return True
    if _WHOLE.fullmatch(low):
        return True
    # The longer a sentence, the more of it must say so: a cue for each 24 words.
    need = 1 + (len(words) - 1) // 24 if words else 1
    cues = min(len(_HAS_SCRIPT.findall(low)), len(_HAS_ENABLE.findall(low)))
    return cues >= need or (cues + sum(1 for _ in _FOUND.finditer(low)) if need > 1 else bool(_FOUND.search(low))) >= need


def body_of(text: str) -> tuple[list[str], list[str]]:
    """Lines of the body without tags and furniture, and the same without a title line before a blank line."""
    text = _TAG.sub("\n", text)
    parts = [[u for u in (line.strip() for line in p.split("\n")) if u and not _FURNITURE.fullmatch(u)] for p in re.split(r"\n\s*\n", text)]
    raw = [p for p in parts if p]
    lines = [u for p in raw for u in p]
    # A title is a first paragraph of its own; furniture may have joined it, so blank lines of the source decide.
    untitled = [u for p in raw[1:] for u in p] if len(raw) > 1 and len(raw[0]) == 1 and len(raw[0][0]) <= 160 and not raw[0][0].endswith(".") else lines
    return lines, untitled


def inspect(text: str, evidence: float = NearDuplicates.evidence) -> tuple[int, float, list[str]]:
    """(kind, share of residue sentences, words of the body): kind 2 for a residue body, 1 for placeholders, else 0.

    The share is of all sentences; it is 0 if it is below ``evidence``."""
    lines, untitled = body_of(text)
    kind, best = 0, 0.0
    known: dict[str, bool] = {}
    for version in (untitled, lines) if untitled is not lines else (lines,):
        units = [u for line in version for u in _UNIT.split(line) if u.strip()]
        hit = miss = 0
        for u in units:
            if u not in known:
                known[u] = is_residue(u)
            hit, miss = hit + known[u], miss + (not known[u])
            if miss and len(units) - miss < evidence * len(units):  # below it even if all others are residue
                break
        else:
            best = max(best, hit / len(units) if hit else 0.0)
        if hit and not miss:
            kind = 2
            break
    if not kind and _PLACEHOLDER.search(text) and _PLACEHOLDER.search(_QUOTED.sub(" ", _CODE.sub(" ", text))):
        kind = 1
    words = _WORD.findall(" ".join(untitled).lower())
    return kind, best, [w if w.isalpha() else _NUMBER.sub("0", w) for w in words]


def unfilled(text: str) -> bool:
    """Whether some text outside code and quotations looks like a placeholder, in looser notations too."""
    return any(p.search(text) and p.search(_QUOTED.sub(" ", _CODE.sub(" ", text))) for p in (_UNFILLED, _PLACEHOLDER))


_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: list[str], size: int, known: dict[str, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``size`` words; of all words together if they are fewer."""
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            acc = acc * _P + h[i : i + n]
        acc ^= acc >> np.uint64(31)
        acc *= np.uint64(0xBF58476D1CE4E5B9)
        acc ^= acc >> np.uint64(29)
    return np.unique(acc)


def simhash(hashes: np.ndarray) -> int:
    """64-bit fingerprint: each bit is the majority of that bit over the hashes; signed."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int(np.packbits(ones * 2 > len(hashes)).view(np.int64)[0])


def _fingerprint(conf: NearDuplicates):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            if len(known) > 500_000:
                known.clear()
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                kind, share, words = inspect(text, conf.evidence)
                body = " ".join(words)
                out.append((doc, xxhash.xxh3_128_digest(body), simhash(shingles(words, conf.shingle, known)), kind, share, not kind and unfilled(text), body))
            yield pd.DataFrame(out, columns=["doc_id", "key", "print", "kind", "share", "unfilled", "body"])

    return run


_BUCKETS = 65536


def _frequencies(conf: NearDuplicates):
    """How many shingles of a partition fall into each bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        total = np.zeros(_BUCKETS, np.int64)
        for pdf in batches:
            if len(known) > 500_000:
                known.clear()
            for body in pdf["body"]:
                total += np.bincount((shingles(body.split(), conf.shingle, known) % np.uint64(_BUCKETS)).astype(np.int64), minlength=_BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return run


def prefix(hashes: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets of at least ``similarity`` share one of them.

    They have at least ``similarity`` of either set in common, so in one order of all shingles the sets cannot agree only
    after this many. The order is by the bucket's frequency, then by the hash; any order is exact.
    """
    most = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return hashes[np.lexsort((hashes, frequent[(hashes % np.uint64(_BUCKETS)).astype(np.int64)]))[:most]]


def _prefixes(frequent: np.ndarray, conf: NearDuplicates):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            if len(known) > 500_000:
                known.clear()
            for key, body in zip(pdf["key"], pdf["body"]):
                h = shingles(body.split(), conf.shingle, known)
                if len(h):
                    own = prefix(h, frequent, conf.similarity).view(np.int64)
                    yield pd.DataFrame({"key": [key] * len(own), "shingle": own, "place": np.arange(len(own)), "size": len(h)})

    return run


def _verify(conf: NearDuplicates):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            keep = []
            for a, b in zip(pdf["body"], pdf["body_b"]):
                x, y = shingles(a.split(), conf.shingle, known), shingles(b.split(), conf.shingle, known)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= conf.similarity * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["key", "kind"]]

    return run


def _tables(df: DataFrame, bits: int, conf: NearDuplicates) -> DataFrame:
    """A row per SimHash table: the table's number and its ``bits`` bits of the fingerprint."""

    def part(t: int) -> Column:
        off = t * 64 // conf.tables
        turned = F.expr(f"shiftrightunsigned(print, {off}) | shiftleft(print, {64 - off})") if off else F.col("print")
        return F.struct(F.lit(t).alias("t"), turned.bitwiseAND(F.lit((1 << bits) - 1)).alias("bits"))

    return df.select("key", "print", F.explode(F.array(*[part(t) for t in range(conf.tables)])).alias("p")).select("key", "print", "p.t", "p.bits")


def residue_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", conf: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``doc_id`` and ``reason`` (``placeholder``, ``residue`` or ``near_duplicate``) of the documents to leave out.

    Null and blank texts, texts of furniture only and rows without an id are no case. Repeated rows of an id
    give one row. Long texts are read as a whole. An empty table gives no rows. Other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "residue")
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null and text rlike '\\\\S'")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    prints = scratch.save(rows.mapInPandas(_fingerprint(conf), f"doc_id {id_type}, key binary, print long, kind int, share double, unfilled boolean, body string"))
    classes = scratch.save(prints.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("print").alias("print")))
    n = max(2, classes.count())
    bits = min(28, max(12, math.ceil(math.log2(n))))
    bodies = scratch.save(prints.join(classes.select("key", "rep"), "key").where("doc_id = rep").select("key", "body").dropDuplicates(["key"]))
    frequent = np.zeros(_BUCKETS, np.int64)  # the number of buckets is fixed
    for row in bodies.select("body").mapInPandas(_frequencies(conf), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequent[row.bucket] = row.n
    index = scratch.save(bodies.mapInPandas(_prefixes(frequent, conf), "key binary, shingle long, place long, size long"))
    index_b = index.select("shingle", F.col("key").alias("key_b"), F.col("place").alias("place_b"), F.col("size").alias("size_b"))
    # A shared shingle and all after it, in the shorter rest, must make up the overlap of the least similarity.
    enough = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b")) >= conf.similarity / (1 + conf.similarity) * (F.col("size") + F.col("size_b")) - 1e-6
    other = scratch.save(_tables(classes, bits, conf).select("t", "bits", F.col("key").alias("key_b"), F.col("print").alias("print_b")))
    # A class is walked once for each kind of seed that reaches it; the evidence is asked of documents, not on the way.
    ring = scratch.save(prints.where("kind > 0").select("key", "kind").distinct())
    walked = ring
    while not ring.isEmpty():
        at = ring.select("key").distinct()
        near = _tables(classes.join(at, "key", "left_semi"), bits, conf).join(other, ["t", "bits"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("print_b"))) <= conf.distance).select("key", "key_b")
        exact = index.join(at, "key", "left_semi").join(index_b, "shingle").where(enough).select("key", "key_b")
        near = near.unionByName(exact).distinct().join(ring, "key").join(walked.select(F.col("key").alias("key_b"), "kind"), ["key_b", "kind"], "left_anti")
        sides = near.join(bodies, "key").select(F.col("key_b").alias("key"), "kind", F.col("body").alias("body_b")).join(bodies, "key")
        ring = scratch.save(sides.mapInPandas(_verify(conf), "key binary, kind int").distinct())
        walked = walked.unionByName(ring)
    label = prints.where("kind > 0").select("doc_id", F.when(F.col("kind") == 1, "placeholder").otherwise("residue").alias("reason"))
    beside = walked.groupBy("key").agg(F.min("kind").alias("seed"))
    shown = (F.col("share") >= conf.evidence) | ((F.col("seed") == 1) & F.col("unfilled"))
    label = label.unionByName(prints.where("kind = 0").join(beside, "key").where(shown).select("doc_id", F.lit("near_duplicate").alias("reason")))
    return label.groupBy("doc_id").agg(F.max("reason").alias("reason"))
