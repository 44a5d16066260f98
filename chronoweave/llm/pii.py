"""Personal information in free text, by a skip-chain conditional random field.

Text is cut into tokens; runs that have the form of a mail address, a number or a street with a house
number are one token each, so their extent is a matter of form and their kind a matter of context. A
linear-chain CRF over tokens looks at words and word classes around a token. Equal or similar rare words and equal
long numbers of a document are joined by skip edges: they share a learned potential over pairs of labels, and loopy
belief propagation alternates between the chain and the skip edges. Names are labelled by begin and inside.

No labels are given, so the model is trained on labels of its own: forms, trigger words and the list of
given names label a bounded sample of texts, contexts that mostly precede listed names are applied to
unlisted ones. In every other round of training the trigger words are hidden from the field while the labels stay, so it
has to learn what else tells a mention, and it labels texts that the rules cannot. What decides which word is everyday,
which context a trigger and which word a given name is counted over all distinct texts. Training and inference run over
padded batches in numpy.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.plans.scratch import Scratch

LABELS = ("O", "email", "phone", "id_number", "street_address", "B", "I")
O, EMAIL, PHONE, ID, STREET, B, I = range(7)
KINDS = {EMAIL: "email", PHONE: "phone", ID: "id_number", STREET: "street_address"}


@dataclass(frozen=True)
class Field:
    """``sample``: most texts to learn weights from; ``epochs``, ``batch``, ``rate``: of training; ``hide``: chance that a
    trigger word is hidden in a round of training that hides them, and ``drop`` that any other word is; ``common``: share of the texts in which a word must occur
    to be an everyday word (and at least ``common_rows`` texts); ``trigger`` and ``given``: the same for contexts of names and
    for given names beyond the list, so what the driver holds is bounded whatever the corpus; ``vocabulary``: most words with
    weights of their own; ``skip``: log potential that a skip edge starts from; ``partners``: so many copies of a word count
    in full; ``sweeps``: rounds of belief propagation; ``decay``: of the weights."""

    sample: int = 2000
    epochs: int = 8
    batch: int = 250
    rate: float = 0.1
    hide: float = 0.8
    drop: float = 0.15
    common: float = 0.002
    common_rows: int = 6
    trigger: float = 0.0005
    trigger_rows: int = 4
    given: float = 0.0001
    given_rows: int = 2
    vocabulary: int = 8000
    skip: float = 0.8
    partners: int = 3
    sweeps: int = 3
    decay: float = 1e-4
    seed: int = 5


_W = r"[^\W\d_][\w'’-]*"
#: How mail addresses, streets and numbers are written in English, German, French and Spanish.
EMAIL_FORM = r"[\w.+-]*\w@[\w-]+(?:\.[\w-]+)+|[\w.+-]*\w\s?[\[({<]\s?(?i:at|arroba|chez|æt|ät|@)\s?[\])}>]\s?[\w-]+(?:(?:\s?\.\s?|\s?[\[({<]\s?(?i:dot|punto|punkt|point|\.)\s?[\])}>]\s?|\s(?i:dot|punto|punkt|point)\s)[\w-]+)+"
_UNIT = r"(?i:flat|apt|apartment|unit|suite|room|floor)\.? \w{1,4}\b"
STREET_FORM = "|".join((
    rf"(?:{_UNIT}, )?\b\d{{1,5}}[a-zA-Z]? (?:[NSEWnsew]\. )?(?:{_W} ){{1,3}}?(?i:street|st\.|road|rd\.|lane|avenue|ave|boulevard|blvd|close|drive|court|square|terrace|crescent|gardens|st|rd)(?![\w])(?:, {_UNIT})?",
    rf"\b(?i:am|an der|auf dem|im|zum|zur|unter den) {_W} \d{{1,4}}(?: ?[a-z]\b(?!\.))?(?:, (?:\d+\. ?(?:OG|Stock|Etage)|EG))?",
    r"\b[^\W\d_]+(?:[sS]traße|[sS]trasse|[sS]tr\.|[gG]asse|[wW]eg|[pP]latz|[aA]llee|[rR]ing|[dD]amm|[uU]fer)  ?\d{1,4}(?: ?[a-z]\b(?!\.))?(?:, (?:\d+\. ?(?:OG|Stock|Etage)|EG))?".replace("  ?", " "),
    rf"\b\d{{1,4}}(?: (?i:bis|ter|quater))?,? (?i:rue|avenue|av\.|boulevard|bd\.?|allée|impasse|place|chemin|route|quai|cours|passage) (?i:de la |de l['’]|du |des |de |d['’])?{_W}(?:, (?i:appt?\.?|apt\.?|bât\.?|esc\.?|étage) ?\w+)*",
    rf"\b(?i:calle|c/|avda\.?|avenida|plaza|pza\.?|paseo|camino|carretera|ronda|travesía) ?(?i:de la |de las |de los |del |de )?{_W}(?: {_W})?,? (?:n\.?º ?)?\d{{1,4}}(?:,? (?:(?i:bajo|ático)\b|\d{{1,2}}\.?[ºª](?: ?(?:[A-Z]\b|(?i:dcha|izda|izq)\b\.?))?))?",
))
NUMBER_FORM = r"(?:\+ ?)?(?:\b[A-Z](?=\d))?(?:\(\d+\)[ /]?)?\d+(?!\d*:\d)(?:(?: ?[-./] ?| ?\(| ?\) ?/? ?| )\d+(?!\d*:\d))*(?:(?<=\d)[A-Z]\b)?(?:,? (?i:ext|extension|durchwahl|poste)\.? ?\d{1,5}\b)?"
_TOKEN = re.compile(rf"(?P<email>{EMAIL_FORM})|(?P<street>{STREET_FORM})|(?P<number>{NUMBER_FORM})|(?P<word>[^\W\d_]+(?:['’-][^\W\d_]+)*)|(?P<other>\S)")
#: Words before numbers that name a person's document, or a phone.
ID_WORDS = frozenset("passport passeport pasaporte reisepass ausweisnummer ausweis personalausweis licence license führerschein permis security ssn tax steuer steuer-id steuernummer fiscal member mitglied mitgliedsnummer adhérent identidad identité dni nif nie".split())
PHONE_WORDS = frozenset("call tel tél teléfono telefon phone fax mobile mobil handy appelez appeler llamar llame anrufen ring reach erreichen".split())
NEITHER_WORDS = frozenset("order ticket part version firmware build probe invoice scores port commit bestellung teilenummer rechnung sonde commande pièce facture pedido pieza factura sonda versión".split())
#: Forms of address.
TITLES = frozenset("mr mrs ms miss dr prof herr frau mme mlle madame monsieur sr sra srta señor señora don doña".split())


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


@dataclass
class Tokens:
    """Tokens of one text: spans, types, lower-case words (numbers as shapes) and raw strings."""

    spans: list[tuple[int, int]]
    types: list[str]
    words: list[str]
    raw: list[str]


def tokenize(text: str) -> Tokens:
    spans, types, words, raw = [], [], [], []
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m[0]
        spans.append(m.span())
        types.append(kind)
        raw.append(s)
        words.append(re.sub(r"\d", "9", s) if kind == "number" else s.lower() if kind in ("word", "other") else f"<{kind}>")
    return Tokens(spans, types, words, raw)


CLASSES = ["pad", "email", "street", "comma", "dot", "other", "n_plus", "n_zero", "n_letter", "n_long", "n_mid", "n_short"]
_CASES = ("lower", "title", "upper", "single")
CLASSES += [f"w_{c}_{k}" for c in _CASES for k in ("given", "common", "rare", "address")]
_CLASS = {c: i for i, c in enumerate(CLASSES)}


def class_of(kind: str, word: str, raw: str, given: frozenset[str], common: frozenset[str]) -> int:
    if kind in ("email", "street"):
        return _CLASS[kind]
    if kind == "other":
        return _CLASS["comma" if raw == "," else "dot" if raw == "." else "other"]
    if kind == "number":
        digits = sum(c.isdigit() for c in raw)
        if raw[0] == "+" or raw.startswith("00"):
            return _CLASS["n_plus"]
        if any(c.isalpha() for c in raw) and "ext" not in raw:
            return _CLASS["n_letter"]
        if raw[0] in "(0" and digits >= 8:
            return _CLASS["n_zero"]
        return _CLASS["n_long" if digits >= 9 else "n_mid" if digits >= 6 else "n_short"]
    case = "single" if len(raw) == 1 else "upper" if raw.isupper() else "title" if raw[0].isupper() else "lower"
    p = plain(raw)
    kind = "address" if word in TITLES and case != "lower" else "given" if p in given else "common" if word in common else "rare"
    return _CLASS[f"w_{case}_{kind}"]


_IS_GIVEN = frozenset(_CLASS[f"w_{c}_given"] for c in _CASES)
_IS_RARE = frozenset(_CLASS[f"w_{c}_rare"] for c in _CASES if c != "single")
_IS_SINGLE = frozenset(_CLASS[f"w_single_{k}"] for k in ("given", "common", "rare"))
_IS_TITLE = frozenset(_CLASS[f"w_{c}_address"] for c in _CASES)


def _name_at(cls: list[int], i: int, strict: bool) -> int:
    """End of a name that starts at token i, i if there is none. ``strict`` wants a listed given name in it."""
    n = len(cls)
    first = lambda k: k < n and (cls[k] in _IS_GIVEN or (not strict and cls[k] in _IS_RARE))
    last = lambda k: k < n and (cls[k] in _IS_RARE or (cls[k] in _IS_GIVEN and k > i))
    dot, comma = _CLASS["dot"], _CLASS["comma"]

    def initial(k: int) -> int:
        if k < n and cls[k] in _IS_SINGLE:
            return k + 2 if k + 1 < n and cls[k + 1] == dot else k + 1
        return k

    if i < n and cls[i] in _IS_RARE and i + 2 < n and cls[i + 1] == comma and (cls[i + 2] in _IS_GIVEN or (not strict and cls[i + 2] in _IS_SINGLE)):
        k = i + 3 if cls[i + 2] in _IS_GIVEN else initial(i + 2)
        return initial(k)
    if first(i):
        k = initial(i + 1)
        if last(k):
            return k + 1
    k = initial(i)
    if not strict and k > i and k < n and cls[k] in _IS_RARE:
        return k + 1
    return i


def label(t: Tokens, cls: list[int], triggers: frozenset[tuple[str, str, str]]) -> list[int]:
    """Labels of one text by form, trigger words and the list of given names."""
    n = len(cls)
    out = [O] * n
    for i, kind in enumerate(t.types):
        before = [w.strip("-") for w in t.words[max(0, i - 6) : i]]
        if kind == "email":
            out[i] = EMAIL
        elif kind == "street":
            out[i] = STREET
        elif kind == "number":
            digits = sum(c.isdigit() for c in t.raw[i])
            hit = next((w for w in reversed(before) if w in ID_WORDS or w in PHONE_WORDS or w in NEITHER_WORDS), None)
            if digits >= 7 and hit not in NEITHER_WORDS:
                phone = cls[i] in (_CLASS["n_plus"], _CLASS["n_zero"])
                if hit in ID_WORDS:
                    out[i] = ID
                elif hit in PHONE_WORDS or (phone and t.raw[i][0] in "+("):
                    out[i] = PHONE
    i = 0
    while i < n:
        end = i
        if i and cls[i] in _IS_RARE and (cls[i - 1] in _IS_TITLE or (i > 1 and cls[i - 1] == _CLASS["dot"] and cls[i - 2] in _IS_TITLE)):
            end = i + 1
        end = max(end, _name_at(cls, i, True))
        if end == i and (loose := _name_at(cls, i, False)) > i and (_before(t, i) in triggers or _after(t, loose) in triggers):
            end = loose
        if end > i:
            out[i:end] = [B] + [I] * (end - i - 1)
            i = end
        else:
            i += 1
    return out


def consistent(t: Tokens, labels: list[int]) -> list[int]:
    """The labels, with those of a phone or id number carried to its other places in the text that say nothing against it."""
    places = defaultdict(list)
    for i, kind in enumerate(t.types):
        if kind == "number" and sum(c.isdigit() for c in t.raw[i]) >= 7:
            places["".join(c for c in t.raw[i] if c.isalnum())].append(i)
    out = list(labels)
    for at in places.values():
        said = {labels[i] for i in at} - {O}
        if len(at) > 1 and len(said) == 1:
            for i in at:
                if not any(w.strip("-") in NEITHER_WORDS for w in t.words[max(0, i - 6) : i]):
                    out[i] = next(iter(said))
    return out


def _before(t: Tokens, i: int) -> tuple[str, str, str]:
    return ("<", *([""] * 2 + t.words[max(0, i - 2) : i])[-2:])


def _after(t: Tokens, end: int) -> tuple[str, str, str]:
    return (">", *(t.words[end : end + 2] + [""] * 2)[:2])


def word_counts(docs: Iterable[Tokens]) -> tuple[Counter, Counter]:
    """In how many texts each word occurs, and how often each plain word occurs."""
    texts, total = Counter(), Counter()
    for d in docs:
        texts.update({w for w, kind in zip(d.words, d.types) if kind in ("word", "number", "other")})
        total.update(plain(w) for w, kind in zip(d.words, d.types) if kind == "word" and len(w) > 1)
    return texts, total


def name_contexts(docs: Iterable[Tokens], given: frozenset[str], common: frozenset[str]) -> tuple[Counter, Counter]:
    """Counts of (context, listed, given name) of what reads like a name, and of (context before, word) of what may open one."""
    names, openers = Counter(), Counter()
    for t in docs:
        cls = [class_of(k, w, r, given, common) for k, w, r in zip(t.types, t.words, t.raw)]
        for i, w in enumerate(t.words):
            if t.types[i] != "word":
                continue
            if len(w) > 1 and t.raw[i][0].isupper() and i + 1 < len(cls) and (cls[i + 1] in _IS_RARE or cls[i + 1] in _IS_SINGLE):
                openers[_before(t, i), plain(w)] += 1
            if (end := _name_at(cls, i, False)) == i:
                continue
            listed = _name_at(cls, i, True) > i
            slot = plain(t.words[i + 2] if i + 2 < end and t.raw[i + 1] == "," else w)
            for context in (_before(t, i), _after(t, end)):
                if any(context[1:]) and not (context[0] == ">" and context[1] in ",.;"):
                    names[context, listed, slot] += 1
    return names, openers


def find_triggers(names: Counter, learned: frozenset[str], least: float) -> frozenset[tuple[str, str, str]]:
    """Pairs of words that mostly stand before (``<``) or after (``>``) what reads like a name, if that is a known one."""
    seen, named = Counter(), Counter()
    for (context, listed, slot), n in names.items():
        seen[context] += n
        named[context] += n * (listed or slot in learned)
    return frozenset(c for c, n in named.items() if n >= least and n >= 0.6 * seen[c])


def learn_given(openers: Counter, total: Counter, triggers: frozenset[tuple[str, str, str]], least: float) -> frozenset[str]:
    """Words that often open a name after a trigger: given names that the list lacks."""
    opened = Counter()
    for (context, word), n in openers.items():
        opened[word] += n * (context in triggers)
    return frozenset(w for w, n in opened.items() if n >= least and n >= 0.2 * total[w])


@dataclass(frozen=True)
class Statistics:
    """What all texts say: everyday words, given names (the list's and learned ones) and contexts of names."""

    given: frozenset[str]
    common: frozenset[str]
    triggers: frozenset[tuple[str, str, str]]


def everyday(texts: Counter, given: frozenset[str], n: int, conf: Field) -> frozenset[str]:
    return frozenset(w for w, k in texts.items() if k >= max(conf.common_rows, conf.common * n) and plain(w) not in given)


def statistics(docs: list[Tokens], given: frozenset[str], conf: Field = Field()) -> Statistics:
    """The statistics of texts in memory; :func:`find_mentions` counts the same over a table."""
    texts, total = word_counts(docs)
    common = everyday(texts, given, len(docs), conf)
    names, openers = name_contexts(docs, given, common)
    learned: frozenset[str] = frozenset()
    for _ in range(2):  # triggers show given names outside the list, these show more triggers
        triggers = find_triggers(names, learned, max(conf.trigger_rows, conf.trigger * len(docs)))
        learned = learn_given(openers, total, triggers, max(conf.given_rows, conf.given * len(docs)))
    given |= learned
    return Statistics(given, everyday(texts, given, len(docs), conf), triggers)


_NAMELESS = np.array([B if x == I else x for x in range(len(LABELS))])
OFFSETS = (-3, -2, -1, 0, 1, 2, 3)
PAIRS = ((0, 1), (-1, 0), (0, 2), (-2, 0))


def by_length(docs: list[Tokens], most: int, tokens: int = 100_000) -> Iterator[np.ndarray]:
    """Batches of texts of like length, at most ``most`` texts and about ``tokens`` padded positions each."""
    size = np.array([len(d.words) for d in docs], int)
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < most and (end - at + 1) * size[order[end]] <= tokens:
            end += 1
        yield order[at:end]
        at = end


def _merge_similar(at: dict[str, list[int]]) -> dict[str, list[int]]:
    """Position lists with those of similar words joined, by shared forms with one letter left out."""
    root = {w: w for w in at}

    def find(w: str) -> str:
        while root[w] != w:
            root[w] = w = root[root[w]]
        return w

    first: dict[str, str] = {}
    for w in at:
        bare = w.removesuffix("'s").removesuffix("’s")
        forms = {bare} if w[0] == "#" or len(bare) < 5 else {bare, *(bare[:i] + bare[i + 1 :] for i in range(len(bare)))}
        for f in forms if w[0] != "#" else ():
            other = first.setdefault(f, w)
            if other != w:
                root[find(w)] = find(other)
    out: dict[str, list[int]] = defaultdict(list)
    for w, ts in at.items():
        out[find(w)] += ts
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _with_copies(docs: list[Tokens], labels: list[list[int]], rng: np.random.Generator) -> tuple[list[Tokens], list[list[int]]]:
    """Each text followed by copies of its mentions between ordinary words of its own, where no context tells what they are."""
    out, named = [], []
    for d, own in zip(docs, labels):
        n = len(own)
        take, got = list(range(n)), list(own)
        plain_at = [i for i in range(n) if own[i] == O and d.types[i] == "word" and d.raw[i].islower()]
        i = 0
        while i < n:
            end = i + 1
            while own[i] == B and end < n and own[end] == I:
                end += 1
            if own[i] != O:
                between = [plain_at[j] for j in rng.integers(0, len(plain_at), 2)] if plain_at else []
                take += [*range(i, end), *between]
                got += [*own[i:end], *[O] * len(between)]
            i = end
        pick = lambda x: [x[j] for j in take]
        out.append(Tokens(pick(d.spans), pick(d.types), pick(d.words), pick(d.raw)))
        named.append(got)
    return out, named


class Crf:
    """Weights and batch inference of the chain; positions are right-padded, ``mask`` tells tokens from padding."""

    def __init__(self, words: list[str], given: frozenset[str], common: frozenset[str], triggers: frozenset, conf: Field):
        self.conf, self.given, self.common, self.triggers = conf, given, common, triggers
        self.vocab = {w: i + 1 for i, w in enumerate(words)}
        k, c = len(LABELS), len(CLASSES)
        z = lambda *s: np.zeros(s, np.float32)
        self.w = {"words": z(len(OFFSETS), len(words) + 1, k), "classes": z(len(OFFSETS), c, k), "pairs": z(len(PAIRS), c * c, k), "trans": z(k, k), "start": z(k)}
        same = _NAMELESS[:, None] == _NAMELESS[None, :]
        self.skip = conf.skip * same.astype(np.float64)
        self.allowed = np.zeros((k, k), np.float32)
        self.allowed[[a for a in range(k) if a not in (B, I)], I] = -1e4
        self.no_start = np.where(np.arange(k) == I, -1e4, 0).astype(np.float32)

    def hideable(self) -> frozenset[str]:
        """Words by which the rules tell mentions."""
        return frozenset(w for c in self.triggers for w in c[1:] if w.isalpha()) | ID_WORDS | PHONE_WORDS | TITLES

    def encode(self, docs: list[Tokens], hidden: frozenset[str] = frozenset(), rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, classes and mask; ``hidden`` words lose their number and class by ``conf.hide``, others the number by ``conf.drop``."""
        top = max((len(d.words) for d in docs), default=0)
        wid, cls = np.zeros((len(docs), top), np.int32), np.zeros((len(docs), top), np.int32)
        mask = np.zeros((len(docs), top), bool)
        known: dict[tuple[str, str], tuple[int, int]] = {}
        for r, d in enumerate(docs):
            for t, (kind, w, raw) in enumerate(zip(d.types, d.words, d.raw)):
                got = known.get((kind, raw))
                if got is None:
                    got = known[kind, raw] = (self.vocab.get(w, 0), class_of(kind, w, raw, self.given, self.common))
                wid[r, t], cls[r, t] = got
                if hidden and kind == "word" and rng.random() < (self.conf.hide if w in hidden else self.conf.drop):
                    wid[r, t] = 0
                    if w in hidden:
                        cls[r, t] = _CLASS["w_lower_common"]
            mask[r, : len(d.words)] = True
        return wid, cls, mask

    @staticmethod
    def _shift(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        n = x.shape[1]
        if abs(by) < n:
            out[:, max(0, -by) : n - max(0, by)] = x[:, max(0, by) : n - max(0, -by)]
        return out

    def _keys(self, wid, cls):
        for o, by in enumerate(OFFSETS):
            yield "words", o, self._shift(wid, by)
            yield "classes", o, self._shift(cls, by)
        for p, (a, b) in enumerate(PAIRS):
            yield "pairs", p, self._shift(cls, a) * len(CLASSES) + self._shift(cls, b)

    def emissions(self, wid, cls) -> np.ndarray:
        out = np.zeros((*wid.shape, len(LABELS)), np.float32)
        for name, i, key in self._keys(wid, cls):
            out += self.w[name][i][key]
        return out

    def marginals(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log marginals of labels, expected transitions and log partition of each text."""
        n, top, k = e.shape
        trans = self.w["trans"] + self.allowed
        alpha, beta = np.zeros((n, top, k)), np.zeros((n, top, k))  # sums over long texts need double precision
        alpha[:, 0] = e[:, 0] + self.w["start"] + self.no_start
        for t in range(1, top):
            step = _logsumexp(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        pair = np.zeros((k, k))
        z = _logsumexp(alpha[:, -1], 1)
        for t in range(top - 2, -1, -1):
            step = trans[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            live = mask[:, t + 1, None]
            beta[:, t] = np.where(live, _logsumexp(step, 2), beta[:, t + 1])
            pair += np.exp((alpha[:, t, :, None] + step - z[:, None, None])[mask[:, t + 1]]).sum(0)
        return alpha + beta - z[:, None, None], pair, z

    def fit(self, docs: list[Tokens], labels: list[list[int]]) -> None:
        conf, k = self.conf, len(LABELS)
        rng = np.random.default_rng(conf.seed)
        square = {n: np.full_like(w, 1e-6) for n, w in self.w.items()}
        versions = []
        for hidden, (ds, ls) in ((self.hideable(), _with_copies(docs, labels, rng)), (frozenset(), (docs, labels))):
            parts = list(by_length(ds, conf.batch))
            versions.append([([ds[i] for i in b], [ls[i] for i in b], self.encode([ds[i] for i in b], hidden, rng)) for b in parts])
        for epoch in range(conf.epochs):
            batches = versions[epoch % 2]
            for at in rng.permutation(len(batches)):
                _, gold_of, (wid, cls, mask) = batches[at]
                if not wid.shape[1]:
                    continue
                gold = np.zeros(wid.shape, int)
                for r, own in enumerate(gold_of):
                    gold[r, : len(own)] = own
                e = self.emissions(wid, cls)
                logm, pair, _ = self.marginals(e, mask)
                diff = (np.eye(k, dtype=np.float32)[gold] - np.exp(np.minimum(logm, 0))) * mask[:, :, None]
                grads = {n: np.zeros_like(w) for n, w in self.w.items()}
                flat = diff[mask]
                for name, i, key in self._keys(wid, cls):
                    keys = key[mask]
                    order = np.argsort(keys, kind="stable")
                    ks = keys[order]
                    cut = np.flatnonzero(np.r_[True, ks[1:] != ks[:-1]])
                    grads[name][i][ks[cut]] += np.add.reduceat(flat[order], cut, axis=0)
                both = mask[:, 1:]
                np.add.at(grads["trans"], (gold[:, :-1][both], gold[:, 1:][both]), 1)
                grads["trans"] -= pair.astype(np.float32)
                grads["start"] += diff[:, 0].sum(0)
                for n, w in self.w.items():
                    g = grads[n] / len(gold_of) - conf.decay * w
                    square[n] += g * g
                    w += conf.rate * g / np.sqrt(square[n])

        self._fit_skip(versions[0])

    def _fit_skip(self, batches: list, rounds: int = 60) -> None:
        """Potential over the labels at the two ends of a skip edge: likelihood of the pairs given the chain's marginals
        without trigger words, with the starting value as prior."""
        left, right, ends = [], [], []
        for ds, ls, (wid, cls, mask) in batches:
            groups = self.skips(ds, cls)
            rows = sorted({r for r, _ in groups})
            if not rows:
                continue
            logm, _, _ = self.marginals(self.emissions(wid[rows], cls[rows]), mask[rows])
            at = {r: i for i, r in enumerate(rows)}
            for r, ts in groups:
                left.append(logm[at[r], ts[:-1]])
                right.append(logm[at[r], ts[1:]])
                ends += [(ls[r][a], ls[r][b]) for a, b in zip(ts[:-1], ts[1:])]
        if not ends:
            return
        alone = np.concatenate(left)[:, :, None] + np.concatenate(right)[:, None, :]
        seen = np.zeros_like(self.skip)
        np.add.at(seen, tuple(np.array(ends).T), 1.0)
        seen, start = (seen + seen.T) / 2, self.skip.copy()
        tie = (_NAMELESS[:, None] == _NAMELESS[None, :]).astype(np.float64)
        for _ in range(rounds):
            p = alone + self.skip
            p = np.exp(p - p.max(axis=(1, 2), keepdims=True))
            want = (p / p.sum(axis=(1, 2), keepdims=True)).sum(0)
            # Both labels of a name are one entity label here: a name's parts may stand in any order.
            step = tie @ (seen - (want + want.T) / 2) @ tie.T
            self.skip += 0.5 * (step - (self.skip - start)) / (1 + len(ends) / 10)

    def skips(self, docs: list[Tokens], cls: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Groups of positions, per text, with the same or a similar rare or given word, or with the same long number.

        Similar are words of five letters or more that one edit or a genitive s tells apart."""
        out = []
        for r, d in enumerate(docs):
            at = defaultdict(list)
            for t, w in enumerate(d.words):
                if cls[r, t] in _IS_RARE or (cls[r, t] in _IS_GIVEN and len(w) > 1):
                    at[plain(w)].append(t)
                elif d.types[t] == "number" and len(digits := "".join(c for c in d.raw[t] if c.isalnum())) >= 6:
                    at["#" + digits].append(t)
            if len(at) > 1:
                at = _merge_similar(at)
            out += [(r, np.sort(np.array(ts))) for ts in at.values() if len(ts) > 1]
        return out

    def predict(self, docs: list[Tokens], skip: bool = True) -> list[list[int]]:
        """Labels of greatest belief, made consistent along the chain and, with ``skip``, between its copies of words."""
        wid, cls, mask = self.encode(docs)
        if not wid.size:
            return [[] for _ in docs]
        e = self.emissions(wid, cls)
        groups = self.skips(docs, cls) if skip else []
        if groups:
            rows = sorted({r for r, _ in groups})
            slot = {r: i for i, r in enumerate(rows)}
            base, live = e[rows].astype(np.float64), mask[rows]
            sent = np.zeros_like(base)
            for _ in range(self.conf.sweeps):
                logm, _, _ = self.marginals(base + sent, live)
                new = np.zeros_like(base)
                for r, ts in groups:
                    own = logm[slot[r], ts] - sent[slot[r], ts]  # without what the group said itself
                    own -= _logsumexp(own, 1)[:, None]
                    says = _logsumexp(own[:, :, None] + self.skip[None], 1)
                    says -= _logsumexp(says, 1)[:, None]
                    new[slot[r], ts] += (says.sum(0) - says) * min(1.0, self.conf.partners / (len(ts) - 1))
                sent = new
            e = e.copy()
            e[rows] = base + sent
        return self._decode(e, mask)

    def _decode(self, e: np.ndarray, mask: np.ndarray) -> list[list[int]]:
        n, top, k = e.shape
        trans = self.w["trans"] + self.allowed
        score = e[:, 0] + self.w["start"] + self.no_start
        back = np.zeros((n, top, k), np.int8)
        for t in range(1, top):
            all_ = score[:, :, None] + trans
            best = all_.argmax(1)
            step = np.take_along_axis(all_, best[:, None, :], 1)[:, 0] + e[:, t]
            live = mask[:, t, None]
            back[:, t] = np.where(live, best, np.arange(k))
            score = np.where(live, step, score)
        at = score.argmax(1)
        out = np.zeros((n, top), int)
        for t in range(top - 1, -1, -1):
            out[:, t] = at
            at = back[np.arange(n), t, at]
        return [list(out[r, : mask[r].sum()]) for r in range(n)]


def train_field(texts: list[str], known: Statistics, conf: Field = Field()) -> Crf:
    """A field learned from the texts, labelled by the rules."""
    docs = [tokenize(t) for t in texts]
    seen, _ = word_counts(docs)
    crf = Crf([w for w, n in seen.most_common(conf.vocabulary) if n >= 3], known.given, known.common, known.triggers, conf)
    if docs:
        crf.fit(docs, [consistent(d, rules(d, known)) for d in docs])
    return crf


def rules(t: Tokens, known: Statistics) -> list[int]:
    """Labels of one text by forms, triggers and the list alone."""
    return label(t, [class_of(k, w, r, known.given, known.common) for k, w, r in zip(t.types, t.words, t.raw)], known.triggers)


def train(texts: list[str], given: frozenset[str], conf: Field = Field()) -> Crf:
    """A field learned from texts in memory alone."""
    return train_field(texts, statistics([tokenize(t) for t in texts], given, conf), conf)


def spans(t: Tokens, labels: list[int]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the labelled mentions. The form must fit the kind: the exact check."""
    out = []
    i, n = 0, len(labels)
    while i < n:
        k = labels[i]
        if k in KINDS:
            digits = sum(c.isdigit() for c in t.raw[i])
            fits = {EMAIL: t.types[i] == "email", STREET: t.types[i] == "street", PHONE: t.types[i] == "number" and digits >= 7, ID: t.types[i] == "number" and digits >= 6}[k]
            if fits:
                out.append((KINDS[k], *t.spans[i]))
            i += 1
        elif k == B:
            end = i + 1
            while end < n and labels[end] == I:
                end += 1
            last = end
            while last > i and (t.raw[last - 1] == "," or (t.raw[last - 1] == "." and not (last - 1 > i and len(t.raw[last - 2]) == 1))):
                last -= 1
            words = [j for j in range(i, last) if t.types[j] == "word"]
            title = t.raw[i - 1] if i and t.raw[i - 1] != "." else t.raw[i - 2] if i > 1 else ""
            titled = title.lower() in TITLES and title[0].isupper()
            if any(len(t.raw[j]) > 1 for j in words) and (len(words) > 1 or titled):
                out.append(("person_name", t.spans[i][0], t.spans[last - 1][1]))
            i = end
        else:
            i += 1
    return out


def mentions(texts: list[str], crf: Crf, batch: int = 256, skip: bool = True) -> list[list[tuple[str, int, int]]]:
    docs = [tokenize(t) for t in texts]
    found: list[list[tuple[str, int, int]]] = [[] for _ in docs]
    for take in by_length(docs, batch):
        part = [docs[i] for i in take]
        for i, t, labels in zip(take, part, crf.predict(part, skip)):
            found[i] = spans(t, labels)
    return found


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, total = word_counts(map(tokenize, pdf["content"]))
        yield pd.DataFrame([("text", w, n) for w, n in texts.items()] + [("total", w, n) for w, n in total.items()], columns=["kind", "word", "n"])


def _count_contexts(given: frozenset[str], common: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names, openers = name_contexts(map(tokenize, pdf["content"]), given, common)
            out = [("name", *c, listed, w, n) for (c, listed, w), n in names.items()] + [("opener", *c, False, w, n) for (c, w), n in openers.items()]
            yield pd.DataFrame(out, columns=["kind", "side", "first", "second", "listed", "word", "n"])

    return run


def table_statistics(texts: DataFrame, given: frozenset[str], n: int, scratch: Scratch, conf: Field = Field()) -> Statistics:
    """:func:`statistics` of all texts of a table, by two passes over them and sums over the counts."""
    words = scratch.save(texts.select("content").mapInPandas(_count_words, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n")))
    often = Counter({r.word: r.n for r in words.where((F.col("kind") == "text") & (F.col("n") >= max(conf.common_rows, conf.common * n))).select("word", "n").collect()})  # few: a share of the texts
    common = everyday(often, given, n, conf)
    counts = scratch.save(
        texts.select("content").mapInPandas(_count_contexts(given, common), "kind string, side string, first string, second string, listed boolean, word string, n long")
        .groupBy("kind", "side", "first", "second", "listed", "word").agg(F.sum("n").alias("n"))
    )
    context = ["side", "first", "second"]
    totals = words.where("kind = 'total'").select("word", F.col("n").alias("total"))
    learned: frozenset[str] = frozenset()
    for _ in range(2):
        known = F.col("listed") | (F.col("word").isin(*learned) if learned else F.lit(False))
        named = counts.where("kind = 'name'").groupBy(context).agg(F.sum("n").alias("seen"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("named"))
        named = named.where((F.col("named") >= max(conf.trigger_rows, conf.trigger * n)) & (F.col("named") >= 0.6 * F.col("seen")))
        triggers = frozenset((r.side, r.first, r.second) for r in named.collect())
        after = counts.where("kind = 'opener'").join(named.select(context), context, "left_semi").groupBy("word").agg(F.sum("n").alias("opened"))
        learned = frozenset(r.word for r in after.where(F.col("opened") >= max(conf.given_rows, conf.given * n)).join(totals, "word").where("opened >= 0.2 * total").collect())
    given |= learned
    return Statistics(given, everyday(often, given, n, conf), triggers)


#: A capitalised word or a long number that comes twice, by which texts with skip edges are sampled.
_TWICE = r"(?s)\b(\p{Lu}\p{L}{3,}|\d[\d/-]{5,})\b.*\b\1\b"


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("uuid"), F.col(text_col).cast("string").alias("content")).where("uuid is not null and content != ''").withColumn("h", F.md5("content"))


def _text_mentions(rows: DataFrame, lexicon: DataFrame, scratch: Scratch, conf: Field) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (``h``, ``content``) and their mentions (``h``, ``pii_kind``, ``start_at``, ``end_at``)."""
    texts = scratch.save(rows.groupBy("h").agg(F.min("content").alias("content")))
    given = frozenset(plain(r.token) for r in lexicon.select("token").collect() if r.token)
    n = texts.count()
    known = table_statistics(texts, given, n, scratch, conf)
    picked: list[str] = []
    for part, share in ((texts, conf.sample), (texts.where(F.col("content").rlike(_TWICE)), conf.sample // 10)):
        every = max(1, n // share)  # both shares together are at most 2.2 samples
        picked += [r.content for r in part.where(F.pmod(F.xxhash64("h"), F.lit(every)) == 0).select("content").limit(2 * share).collect()]
    crf = train_field(sorted(set(picked), key=lambda t: xxhash.xxh3_64_intdigest(t)), known, conf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = mentions(pdf["content"].tolist(), crf)
            yield pd.DataFrame([(u, *m) for u, ms in zip(pdf["h"], got) for m in ms], columns=["h", "pii_kind", "start_at", "end_at"])

    return texts, texts.mapInPandas(run, "h string, pii_kind string, start_at long, end_at long")


def find_mentions(df: DataFrame, lexicon: DataFrame, id_col: str = "uuid", text_col: str = "content", conf: Field = Field()) -> DataFrame:
    """``uuid, pii_kind, start_at, end_at`` of all mentions; offsets in characters from 0, the end exclusive.

    ``lexicon`` is the fixed list of given names (``token``), read to the driver. Weights are learned from a sample of at
    most 2.2 times ``conf.sample`` texts, picked by a hash of the text; word statistics are of all distinct texts, and all
    texts are read for mentions, as a whole, equal ones once. Null and empty texts and rows without an id have no mentions;
    repeated rows of an id give their mentions once; an empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "pii")
    rows = _rows(df, id_col, text_col)
    _, found = _text_mentions(rows, lexicon, scratch, conf)
    return rows.select("uuid", "h").distinct().join(found, "h").drop("h").distinct()


def redact_texts(df: DataFrame, lexicon: DataFrame, id_col: str = "uuid", text_col: str = "content", conf: Field = Field()) -> DataFrame:
    """``uuid, content, n_mentions``: every text with its mentions replaced by typed placeholders such as ``[EMAIL]``.

    All other characters stay as they are. Rows without an id are left out, null and empty texts stay null and empty with no
    mentions, repeated rows of an id and text are one row. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "redact")
    rows = _rows(df, id_col, text_col)
    texts, found = _text_mentions(rows, lexicon, scratch, conf)
    spans_of = found.groupBy("h").agg(F.collect_list(F.struct("pii_kind", "start_at", "end_at")).alias("spans"))  # of one text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans_ = [[] if s is None else [(m["pii_kind"], m["start_at"], m["end_at"]) for m in s] for s in pdf["spans"]]
            yield pd.DataFrame({"h": pdf["h"], "content": [redact(t, s) for t, s in zip(pdf["content"], spans_)], "n_mentions": [len(s) for s in spans_]})

    clean = texts.join(spans_of, "h", "left").mapInPandas(run, "h string, content string, n_mentions long")
    empty = df.select(F.col(id_col).cast("string").alias("uuid"), F.col(text_col).cast("string").alias("content"), F.lit(0).cast("long").alias("n_mentions")).where("uuid is not null and (content is null or content = '')")
    return rows.select("uuid", "h").distinct().join(clean, "h").drop("h").unionByName(empty).distinct()


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every mention replaced by its kind in square brackets; all else stays as it is."""
    out, at = [], 0
    for kind, start, end in sorted(found, key=lambda m: m[1]):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])
