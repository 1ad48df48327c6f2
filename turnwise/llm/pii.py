"""Personal information inside free text (problem 4).

A skip-chain conditional random field over candidate spans.  Patterns propose spans (name-like,
address-like, digit runs, mail notations); the field labels each of them as a kind of personal
information or as nothing.  Neighbouring candidates are linked as a chain, and candidates with the
same or a similar text anywhere in the document by skip edges, so that one clear mention decides the
unclear ones.  Marginals come from loopy sum-product message passing.

The field is trained on a generated, labelled sample (``training_documents``) by pseudo-likelihood: the
weights of the nodes and the chain and skip potentials together, each node given its neighbours.  In the
sample, as in real texts, a name that no list holds is clear in one place only and unclear in others.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

LABELS = ("none", "person", "email", "phone", "id_number", "address")
PLACEHOLDERS = {"person": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}

#: Given names of many languages.
GIVEN = frozenset(
    """amara mira tobias leila marco jonas carla noor ines idris yuki emil oskar piotr hugo hanna rahul nadia sanna anouk viktor elena wren felix mateo samir greta dario zofia lucia
    anna maria peter paul laura julia thomas michael martin stefan andreas sophie marie jean pierre camille louis antoine claire jose juan carlos ana sofia miguel pablo isabel pedro luis
    james john robert david william emma olivia noah liam mia ahmed omar fatima layla ali hassan yusuf aisha chen wei mei hiroshi kenji sakura priya arjun anita ravi lena lukas nina erik
    ingrid lars astrid bjorn katarina ivan olga dmitri natasha alice bob charlotte henry george sarah rachel daniel simon giulia luca francesca alessandro mariana beatriz joao ewa marek jan""".split()
)
_FAMILY_END = re.compile(r"(?:str[öo]m|sky|ska|vic|vich|[hk]eimer|dale|illo|ough|mund|marsh|wyn|quist|vanen|nen|ander|eira|ett|bridge|son|sen|berg|mann|escu|ez|oglu|ova|enko|ton|ley|ini|elli|meyer|maier|schmidt|stein|feld)$")
_PARTICLE = r"(?:van der|van den|von der|de la|de los|van|von|de|del|della|di|da|dos|du|la|le|ter|ten|bin|ibn|al|el)"

_WORDCHAR = "A-Za-zÀ-ÖØ-öø-ÿŁłŚśŻżŹźĆćŃńĘęĄąŠšŽžČčŘřŐőŰűĞğİıŞş"
_W = rf"[{_WORDCHAR}]"
_CAPITALS = "A-ZÀ-ÖØ-ÞŁŚŻŹĆŃĘĄŠŽČŘŐŰĞİŞ"
_CAPITAL_NEXT = re.compile(rf" (?:{_W}\. )*[{_CAPITALS}][a-zß-öø-ÿ]")
_NAME_WORDS = re.compile(rf"(?<![\w@`/])({_W}[{_WORDCHAR}’'-]+)(?![\w@`/(])")
_REST_OF_NAME = re.compile(rf"((?: {_W}\.)*) ((?:{_PARTICLE} |al-|el-|d'|D'|AL-|Al-|EL-|El-|{_PARTICLE.upper()} )?)({_W}[{_WORDCHAR}’']+(?:-{_W}[{_WORDCHAR}’']+)*)(?![\w@`/(]|\.\w)")
_INVERTED = re.compile(rf"(?<![\w@`/])((?:(?:{_PARTICLE} )|al-|el-|{_PARTICLE.upper()} |AL-|Al-)?{_W}[{_WORDCHAR}’']+(?:-{_W}[{_WORDCHAR}’']+)*), $")

_EMAIL = re.compile(
    r"(?<![\w.+@/-])[A-Za-z0-9][\w.+-]*(?:@| ?\[at\] ?| ?\(at\) ?| ?\{at\} ?| at )[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.| ?\[dot\] ?| ?\(dot\) ?| ?\{dot\} ?| dot )[A-Za-z0-9][A-Za-z0-9-]*)*", re.I
)
_DIGITS = re.compile(r"(?<![\w@#$-])(?<!\d[.,/:])(?:\+ ?|\()?\(?\d+(?:(?:\) ?|[ ./-]| \(|\(|-\()\(?\d+)*")
_CODE = re.compile(r"(?<![\w@#-])(?:[A-Z]{1,3}\d[0-9A-Z]*(?:-\d+)*|[XYZ]?\d{7,8}[- ]?[A-Z])(?![\w-])")
_STREET_WORD = r"(?:street|st|road|rd|avenue|ave|court|ct|lane|ln|drive|dr|way|square|sq|terrace|close|crescent|boulevard|blvd|place|pl|gardens|row|hill|parade|mews|walk)"
_STREET_END = r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|chaussee|steig|pfad)"
_STREET_START = r"(?:calle|c/|avenida|avda\.|av\.|plaza|paseo|camino|carrera|ronda|travesía)"
_UP = "(?-i:[A-ZÀ-ÖØ-Ý])"
_NAME_PART = rf"{_UP}[{_WORDCHAR}’'-]*"
_STREET = re.compile(
    rf"(?<![\w/-])\d{{1,4}} ?(?-i:[A-Za-z])?(?: ?(?:bis|ter|quater))?,? (?:{_NAME_PART} ){{1,3}}{_STREET_WORD}\b"
    rf"|(?<![\w/-])\d{{1,4}} ?[A-Za-z]?(?: (?:bis|ter|quater))?,? (?:rue|avenue|av\.|boulevard|bd|place|chemin|allée|impasse|quai|cours|route|square)(?: (?:de la|de l'|de|du|des|le|la|les))? ?(?:d'|l')?{_NAME_PART}(?: {_NAME_PART})*"
    rf"|(?<![\w/-]){_UP}[{_WORDCHAR}-]*{_STREET_END}(?: |, ?)\d{{1,4}}(?: ?[a-z](?!\w))?"
    rf"|(?<![\w/-]){_STREET_START}(?: (?:de la|de los|de las|de|del|la|el))? ?{_NAME_PART}(?: {_NAME_PART}){{0,2}}(?:,? (?:nº|no\.|n\.º) ?|, ?| )\d{{1,4}}(?: ?[A-Za-z](?!\w))?",
    re.I,
)

#: Words next to a value that tell its kind.
CUES = {
    "phone": "phone tel telephone mobile cell call callback sms fax number reach ring whatsapp dial ruf rufnummer telefon handy nummer téléphone tél portable appelez rappelle numéro llámame teléfono móvil número shift",
    "id": "id identity passport licence license tax social security ssn insurance national idno id_no nino dni nif nie steuer-id steuer ausweis ausweisnummer personalausweis führerschein sozialversicherungsnummer passeport permis sécurité sociale fiscal carnet pasaporte seguridad conducir identidad fiscale identité driving",
    "decoy": "ticket order version part build server release box port runtime commit line exit code rows samples issue pr revision ip host isbn sku invoice batch range row took ms seconds bytes item article bestellung bestellnummer commande pedido ticketnummer versión version:",
    "strong": "author regards contact assigned talked spoke hi hello dear thanks signed reviewer owner maintainer colleague manager mr mrs ms dr herr frau señor señora madame monsieur nenne menciona",
    "name": "by author was names mention hi regards contact assigned talked to from name reported hello dear thanks menciona nenne citer notificó gemeldet est reviewer owner maintainer signed forward record is customer patient",
    "place": "lives moved ship address at street invoice sent deliver home flat wohnt anschrift adresse habite vive dirección domicilio adr",
    "login": "ssh scp git clone rsync sftp pull remote fetch",
}
_CUES = {w: [] for words in CUES.values() for w in words.split()}
for _kind, _ws in CUES.items():
    for _w in _ws.split():
        _CUES[_w].append(_kind)
_CUE_WORD = re.compile(r"[^\W\d]+(?:-[^\W\d]+)*")
_FUNCTION = frozenset("the a an is was were are and or for from in on at to of with about by can could this that it we you i be see laut siehe voir ver has have had not no yes as if then than will would should may der die das und ist le la les et est el los y en de por para con que look please can when before after".split())


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    text: str
    shape: str
    features: tuple[str, ...]


def _style(word: str) -> str:
    bare = re.sub(r"[^\w]", "", word)
    if bare.isupper() and len(bare) > 1:
        return "U"
    return "T" if bare[:1].isupper() else "l"


def _context(text: str, start: int, end: int) -> list[str]:
    left = text[max(0, start - 60) : start]
    cut = max(left.rfind("\n"), left.rfind(". ") if not left.endswith((" no. ", "No. ")) else left.rfind("\n"), left.rfind("? "))
    left = left[cut + 1 :]
    words = _CUE_WORD.findall(left.lower())
    out = []
    for distance, w in enumerate(reversed(words[-6:])):
        for kind in _CUES.get(w, ()):
            out.append(f"left:{kind}" if distance > 1 else f"near:{kind}")
    right = _CUE_WORD.findall(text[end : end + 45].split("\n")[0].lower())[:6]
    for distance, w in enumerate(right):
        for kind in _CUES.get(w, ()):
            out.append(f"right:{kind}" if distance > 1 else f"next:{kind}")
    if start == 0 or text[start - 1] == "\n":
        out.append("line_start")
    return list(dict.fromkeys(out))


def _number_shape(value: str) -> list[str]:
    groups = re.findall(r"\d+", value)
    n = sum(map(len, groups))
    out = [f"digits:{min(n, 16)}", "groups:" + "-".join(str(len(g)) for g in groups[:6])]
    for mark, name in (("+", "plus"), ("(", "bracket")):
        if value.startswith(mark):
            out.append(f"starts:{name}")
    if groups[0].startswith("00") or groups[0].startswith("0"):
        out.append("starts:zero")
    if re.fullmatch(r"(?:1[-. ])?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}|\d{10}", value):
        out.append("like:plan")
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", value):
        out.append("like:host")
    elif re.fullmatch(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}.*|\d{1,2}[./]\d{1,2}[./]\d{4}", value):
        out.append("like:date")
    elif re.fullmatch(r"\d{1,2}(?:\.\d{1,3}){2,3}(?:\.\d+)?", value) and not re.fullmatch(r"\d\.\d{3}\.\d{3}\.\d{4}", value):
        out.append("like:version")
    elif re.fullmatch(r"\d{3}-\d{3}-\d{4}", value) is None and re.fullmatch(r"\d{3}-\d{3}-(?:19|20)\d\d", value):
        out.append("like:ticket")
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", value):
        out.append("like:social")
    if re.fullmatch(r"\d{2} \d{3} \d{3} \d{3}", value):
        out.append("like:tax")
    seps = sorted(set(re.sub(r"[\d]", "", value)))
    return [*out, "seps:" + "".join(seps)]


def _family_features(word: str) -> list[str]:
    parts = word.lower().split("-")
    return ["family_end"] if any(_FAMILY_END.search(p) for p in parts) else []


#: Which of overlapping spans is kept.
_RANK = {"mail": 0, "street": 1, "code": 2, "number": 3, "name": 4, "pair": 5}


def candidates(text: str) -> list[Candidate]:
    """The spans a document's field is built over, in order, not overlapping."""
    low = text.lower()
    spans: list[tuple[int, int, str, list[str]]] = []
    if "@" in low or "at]" in low or "at)" in low or "at}" in low or " at " in low:
        for m in _EMAIL.finditer(text):
            value = m[0].rstrip(".-")
            at = re.search(r"@|at", value[1:], re.I)
            worded = "@" not in value and "]" not in value and ")" not in value and "}" not in value
            if worded and " dot " not in value.lower():
                continue
            domain = re.split(r"@| ?[\[({]at[\])}] ?| at ", value, maxsplit=1, flags=re.I)[1]
            dotted = "." in domain or "dot" in domain.lower()
            f = ["dotted" if dotted else "plain_host"]
            if at is None:
                continue
            after = text[m.start() + len(value) : m.start() + len(value) + 1]
            if after in (":", "/") and text[m.start() + len(value) + 1 : m.start() + len(value) + 2].strip():
                f.append("path_follows")
            spans.append((m.start(), m.start() + len(value), "mail", f))
    if any(c.isdigit() for c in low):
        for m in _STREET.finditer(text):
            spans.append((m.start(), m.end(), "street", ["worded"]))
        for m in _CODE.finditer(text):
            if sum(c.isdigit() for c in m[0]) >= 5:
                pattern = re.sub(r"[A-Z]", "A", re.sub(r"\d+", lambda d: str(len(d[0])), m[0]))
                spans.append((m.start(), m.end(), "code", [f"code:{pattern}"]))
        for m in _DIGITS.finditer(text):
            value = m[0].rstrip(" (-./")
            if sum(c.isdigit() for c in value) >= 7:
                f = _number_shape(value)
                nxt = text[m.start() + len(value) : m.start() + len(value) + 2]
                if nxt[:1].isalnum() or nxt[:1] in ("_", "@") or re.match(r"[.,:/-]\w", nxt):
                    continue  # part of a hash, an identifier or a longer number
                spans.append((m.start(), m.start() + len(value), "number", f))
    words = list(_NAME_WORDS.finditer(text))
    for m in words:
        first = m[1]
        if first.lower() not in GIVEN:
            continue
        style = _style(first)
        rest = _REST_OF_NAME.match(text, m.end())
        done = False
        if rest:
            family = rest[3]
            if _style(family) == style and family.lower() not in _FUNCTION and (style != "l" or len(family) > 3):
                f = ["given", "direct", f"style:{style}", *_family_features(family)]
                f += ["initial"] if rest[1] else []
                f += ["particle"] if rest[2] else []
                spans.append((m.start(), rest.end(), "name", f))
                done = True
        if not done:
            before = _INVERTED.search(text[max(0, m.start() - 60) : m.start()])
            if before and _style(re.sub(rf"^(?:{_PARTICLE} |al-|el-)", "", before[1], flags=re.I)) == style and before[1].lower() not in _FUNCTION:
                start = max(0, m.start() - 60) + before.start(1)
                end = m.end()
                extra = re.compile(rf"(?: {_W}\.)+(?!\w)").match(text, end)
                if extra:
                    end = extra.end()
                f = ["given", "inverted", f"style:{style}", *_family_features(before[1])]
                spans.append((start, end, "name", f))
    # Capitalised pairs without a known given name, for the field to judge.
    for m in words:
        first = m[1]
        if _style(first) != "T" or first.lower() in GIVEN or first.lower() in _FUNCTION or not first[1:].islower():
            continue
        rest = _REST_OF_NAME.match(text, m.end())
        if rest and _style(rest[3]) == "T" and rest[3].lower() not in _FUNCTION and rest[3][1:2].islower():
            f = ["pair", *_family_features(rest[3])] + (["initial"] if rest[1] else []) + (["particle"] if rest[2] else [])
            opens = m.start() == 0 or text[: m.start()].rstrip(" \"'(")[-1:] in ("", ".", "!", "?", ":", "\n", "-", "#", "*", ";")
            if opens and _CAPITAL_NEXT.match(text, rest.end()):
                continue  # the capital only opens the sentence, the pair is the next two words
            spans.append((m.start(), rest.end(), "pair", [*f, "opens" if opens else "inside"]))
    spans.sort(key=lambda s: (_RANK[s[2]], s[0], s[0] - s[1]))
    starts: list[int] = []  # of what is taken, in order
    kept: dict[int, tuple[int, int, str, list[str]]] = {}
    for span in spans:
        at = bisect_left(starts, span[0])
        if (at == 0 or kept[starts[at - 1]][1] <= span[0]) and (at == len(starts) or span[1] <= starts[at]):
            starts.insert(at, span[0])
            kept[span[0]] = span
    taken = [kept[x] for x in starts]
    out = []
    for start, end, shape, f in sorted(taken):
        features = [f"shape:{shape}", *f, *_context(text, start, end)]
        if shape in ("name", "pair"):  # what numbers are called says nothing of names
            features = [x for x in features if not x.endswith((":decoy", ":phone", ":id"))]
        if shape == "pair":
            features.append("pair:clear" if "near:strong" in features else "pair:vague")
        out.append(Candidate(start, end, text[start:end], shape, tuple(features)))
    return out


def similarity_keys(c: Candidate) -> set[str]:
    """Keys by which distant candidates count as repeated or similar."""
    low = c.text.lower()
    if c.shape in ("number", "code"):
        return {"d:" + re.sub(r"\W", "", low)}
    if c.shape == "mail":
        return {"m:" + re.sub(r"\W|at|dot", "", low)}
    if c.shape == "street":
        return {"s:" + " ".join(sorted(re.findall(r"\w+", low)))}
    return {"n:" + w for w in re.findall(r"[^\W\d_]{4,}", low)}


# --- the field -----------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights of the skip-chain field."""

    index: dict[str, int]
    node: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray

    def scores(self, c: Candidate) -> np.ndarray:
        rows = [self.index[f] for f in c.features if f in self.index]
        return self.node[rows].sum(axis=0) + self.node[0]

    def marginals(self, nodes: list[Candidate], rounds: int = 12, epsilon: float = 1e-4) -> np.ndarray:
        """Loopy sum-product in logs; exact where the graph is a tree."""
        unary = np.array([self.scores(c) for c in nodes])
        near, far = _edges(nodes)
        edges = [(i, j, self.chain) for i, j in near] + [(i, j, self.skip) for i, j in far]
        if not edges:
            e = np.exp(unary - unary.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        messages = {}
        around: dict[int, list[tuple[int, np.ndarray]]] = {i: [] for i in range(len(nodes))}
        for i, j, w in edges:
            messages[i, j] = np.zeros(len(LABELS))
            messages[j, i] = np.zeros(len(LABELS))
            around[i].append((j, w))
            around[j].append((i, w.T))
        for _ in range(rounds):
            moved = 0.0
            fresh = {}
            for i in around:
                total = unary[i] + sum((messages[k, i] for k, _ in around[i]), np.zeros(len(LABELS)))
                for j, w in around[i]:
                    m = _log_sum((total - messages[j, i])[:, None] + w)
                    m -= m.max()
                    fresh[i, j] = m
                    moved = max(moved, float(np.abs(m - messages[i, j]).max()))
            messages = fresh
            if moved < epsilon:
                break
        belief = np.array([unary[i] + sum((messages[k, i] for k, _ in around[i]), np.zeros(len(LABELS))) for i in range(len(nodes))])
        e = np.exp(belief - belief.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _log_sum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=0)
    return top + np.log(np.exp(a - top).sum(axis=0))


def training_documents(n: int = 1200, seed: int = 4) -> list[tuple[str, list[tuple[str, str]]]]:
    """Generated documents with their labelled spans: (text, [(span text, label)]).

    Built from cue words and value shapes, so the size and the seed are the only parameters.
    """
    rng = random.Random(seed)
    given = sorted(GIVEN)
    syllables = "bar den fel gor hin kal lum mar nor pel ras sol tam ver wil zor".split()
    endings = "ström sky vic heimer dale illo son berg mann quist ez ova nen wyn".split()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    letters = lambda k: "".join(rng.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(k))
    family = lambda: (rng.choice(syllables) + rng.choice(endings)).title()

    def person() -> str:
        g, f = rng.choice(given).title(), family()
        style = rng.random()
        middle = f" {letters(1)}." if rng.random() < 0.15 else ""
        particle = rng.choice(["de ", "van der ", "al-"]) if rng.random() < 0.12 else ""
        text = f"{g}{middle} {particle}{f}" if rng.random() < 0.8 else f"{f}, {g}"
        return text.upper() if style < 0.08 else text.lower() if style < 0.30 else text

    nouns = "Order Build Cache Queue Load Event Data Test Search User Payment Report Session Retry Batch Index Stream Token Budget Release".split()
    heads = "Service Server Pattern Balancer Store Runner Manager Factory Team Board Parser Gateway Module Index Model Plan Review Report".split()
    german = "Neue Alte Erste Letzte Kleine Große Diese Jede Andere Weitere".split()
    things = "Funktion Klasse Abfrage Tabelle Anwendung Datei Prüfung Schnittstelle Änderung Version".split()
    unlisted = lambda: (rng.choice(syllables) + rng.choice(["a", "o", "i", "an", "el", "us", "in", "ek"])).title()

    def stranger() -> str:
        """A name that no list holds, with a family name of any ending."""
        middle = f" {letters(1)}." if rng.random() < 0.1 else ""
        tail = rng.choice(["en", "er", "o", "ah", "well", "ks", "am", "ida", "ano", "in", "ong"])
        return f"{unlisted()}{middle} {(rng.choice(syllables) + rng.choice(['', rng.choice(syllables)]) + tail).title()}"

    def thing() -> str:
        return f"{rng.choice(nouns)} {rng.choice(heads)}" if rng.random() < 0.7 else f"{rng.choice(german)} {rng.choice(things)}"

    clear = [
        "The author is {}.", "Regards, {}", "Contact {} at the desk.", "I talked to {} today.", "Hi {}, thanks.", "It was assigned to {} in May.",
        "Thanks, {}", "# maintainer: {}", "The reviewer was {}.", "My colleague {} asks.", "Signed, {}", "Bitte nenne {} dort.", "Menciona a {} ahora.",
    ]
    vague = [
        "{} was here before.", "The change of {} is in.", "See {} again.", "It came from {} then.", "We looked at {} twice.", "{} wins.", "That is for {} only.",
        "{} has the last word on it.", "Ask whether {} agrees.", "{} in the second row.", "Move it to {} first.", "It is by {} as well.",
    ]

    def email() -> str:
        name, host = f"{rng.choice(given)}{rng.choice(['.', '_', ''])}{rng.choice(syllables)}{rng.choice(['', digits(2)])}", f"{rng.choice(syllables)}.example"
        at, dot = rng.choice([("@", "."), ("@", "."), ("[at]", "."), (" (at) ", " (dot) "), (" at ", " dot ")])
        return name + at + host.replace(".", dot)

    def phone() -> str:
        return rng.choice(
            [
                f"+{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{rng.randint(2, 9)}{digits(2)}-{digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}",
                f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(2)}/{digits(5)}-{digits(3)}", f"00{digits(2)} {digits(2)} {digits(8)}", f"{rng.randint(2, 9)}{digits(9)}", f"1.{digits(3)}.{digits(3)}.{digits(4)}",
                f"+{digits(2)} (0){digits(2)} {digits(4)} {digits(4)}", f"+{digits(11)}", f"+{digits(2)} {digits(2)} {digits(5)} {digits(3)}", f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
            ]
        )

    def identity() -> str:
        return rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}", digits(9), f"{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"{letters(2)}{digits(7)}", f"{letters(1)}{digits(2)}{letters(1)}{digits(5)}", f"{letters(1)}{digits(3)}-{digits(4)}-{digits(4)}", f"{letters(1)}{digits(8)}", f"{digits(8)}-{letters(1)}", f"{digits(8)}{letters(1)}"])

    def address() -> str:
        s, n = rng.choice(syllables).title() + rng.choice(["ford", "wick", "ham"]), rng.randint(1, 180)
        return rng.choice([f"{n} {s} Street", f"{n}B {s} Court", f"{n} {s} Rd", f"{s}straße {n}", f"{s}weg {n}a", f"{n} rue de {s}", f"{n} bis, avenue du {s}", f"Calle de {s} {n}", f"C/ {s}, {n}"])

    cue = {
        "person": ["The author is {}.", "(reported by {})", "Hi {}, thanks.", "I talked to {} today.", "Regards, {}", "name={};plan=x", "{} wrote this first.", "It was assigned to {} in May.", "Bitte nenne {} dort.", "Menciona a {} ahora.", "C'est {} qui le dit.", "# maintainer: {}"],
        "email": ["Write to {} please.", "cc {}", "mail={},x=1", "The account {} fails.", "<{}>", "Das Konto {} fehlt."],
        "phone": ["Call me at {} today.", "My number is {}.", "phone {} and no plan", "sms to {} bounced", "Ruf mich unter {} an.", "Llámame al {}.", "reach the desk at {}, please", "He left {} as a callback number.", "Rappelle-moi au {}."],
        "id_number": ["passport no. {} fails", "Her national ID is {}, check it.", "Driving licence {} is fine.", "tax ID {} in clear text", "social security number {}.", "Steuer-ID {} steht da.", "The {} in column id_no is real.", "ssn / social security: {}", "Le passeport numéro {} est refusé.", "Die Ausweisnummer {} fehlt.", "El DNI {} falta."],
        "address": ["She lives at {}.", "Ship it to {}, Bern.", "moved to {} last month", "The invoice shows {}, the old flat.", "address={}; city=X", "Wohnt in der {}."],
    }
    make = {"person": person, "email": email, "phone": phone, "id_number": identity, "address": address}
    decoys = [
        lambda: (f"Ticket {digits(3)}-{digits(3)}-20{digits(2)} covers this."), lambda: f"Order number {digits(11)} is slow.", lambda: f"Version {rng.randint(1, 9)}.{digits(2)}.{digits(3)}.{digits(4)} is out.", lambda: f"Part code {letters(1)}{digits(6)}-{digits(2)} has no price.",
        lambda: f"Build 20{digits(2)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} passed.", lambda: f"The box at {rng.randint(1, 255)}.{digits(2)}.{digits(2)}.{digits(2)} is down.", lambda: f"Server {rng.randint(100, 255)}.0.2.{digits(2)} answers.", lambda: f"git clone git@{rng.choice(syllables)}.example:tools/x.git",
        lambda: f"ssh deploy@{rng.choice(syllables)}-box and look.", lambda: f"written as user@{rng.choice(syllables)} in the pattern", lambda: f"runtime {digits(2)}.{digits(2)}.{digits(2)} is old, row {digits(8)}", lambda: f"commit {digits(7)} of {digits(8)} bytes", lambda: f"The {family()} Pattern is used.", lambda: f"Use {rng.choice(syllables).title()} {family()} Runner here.",
        lambda: f"item {digits(9)} took {digits(7)} ms", lambda: f"ssh {rng.choice(given)}@{rng.choice(syllables)}.example and look",
    ]
    out = []
    for _ in range(n):
        parts, gold, kept = [], [], []
        if rng.random() < 0.3:  # one clear mention, or a thing never clear, and unclear ones around it
            name, label = (stranger(), "person") if rng.random() < 0.5 else (thing(), "none")
            told = [rng.choice(vague).format(name) for _ in range(rng.randint(1, 3))]
            if label == "person":
                if rng.random() < 0.4:
                    told = []  # clear by itself
                told.insert(rng.randint(0, len(told)), rng.choice(clear).format(name))
                gold.append((name, label))
            parts += told
        for _ in range(rng.randint(1, 4)):
            r = rng.random()
            if r < 0.35:
                parts.append(rng.choice(decoys)())
            elif r < 0.45:
                p, a, i, t, e = person(), address(), identity(), phone(), email()
                form, values = rng.choice(
                    [
                        ("The record is {} | {} | {}.", [(p, "person"), (a, "address"), (i, "id_number")]),
                        ("Contact: {}, {}, {}.", [(p, "person"), (t, "phone"), (e, "email")]),
                        ("Forward it to {} at {}, phone {}.", [(p, "person"), (a, "address"), (t, "phone")]),
                        ("Regards, {} ({})", [(p, "person"), (e, "email")]),
                    ]
                )
                parts.append(form.format(*[v for v, _ in values]))
                gold += values
            else:
                kind = rng.choice(list(make))
                value = rng.choice(kept)[0] if kept and rng.random() < 0.2 and (kind := (again := rng.choice(kept))[1]) else make[kind]()
                if kind in [k for _, k in kept] and rng.random() < 0.15:
                    value = next(v for v, k in kept if k == kind)
                template = "See {} again." if value in [v for v, _ in kept] else rng.choice(cue[kind])
                kept.append((value, kind))
                parts.append(template.format(value))
                gold.append((value, kind))
        out.append((rng.choice(["\n", " "]).join(parts), gold))
    return out


def _edges(nodes: list[Candidate]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain and skip edges of a document: neighbours close by, and each mention with the latest alike.

    A long document has as many skip edges as mentions, not as pairs of them.
    """
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1].start - nodes[i].end <= 40]
    skip: dict[tuple[int, int], None] = {}
    last: dict[str, int] = {}
    for j, c in enumerate(nodes):
        for key in similarity_keys(c):
            i = last.get(key)
            if i is not None and i != j:
                skip[i, j] = None
            last[key] = j
    both = set(skip)
    return [e for e in chain if e not in both], list(skip)


def fit(documents: list[tuple[str, list[tuple[str, str]]]], rounds: int = 400, rate: float = 1.0, decay: float = 3e-4) -> Field:
    """Pseudo-likelihood: each node's label given its features and the labels of its neighbours, all weights together."""
    nodes: list[Candidate] = []
    labels: list[int] = []
    chains: list[tuple[int, int]] = []
    skips: list[tuple[int, int]] = []
    for text, gold in documents:
        known = dict(gold)
        found = candidates(text)
        near, far = _edges(found)
        chains += [(i + len(nodes), j + len(nodes)) for i, j in near]
        skips += [(i + len(nodes), j + len(nodes)) for i, j in far]
        nodes += found
        labels += [LABELS.index(known.get(c.text, "none")) for c in found]
    index = {"bias": 0}
    for c in nodes:
        for f in c.features:
            index.setdefault(f, len(index))
    x = np.zeros((len(nodes), len(index)), dtype=np.float32)
    x[:, 0] = 1
    for row, c in enumerate(nodes):
        x[row, [index[f] for f in c.features]] = 1
    n, k, y = len(nodes), len(LABELS), np.array(labels)
    target = np.eye(k, dtype=np.float32)[y]
    ends = [np.array(e, dtype=np.int64).reshape(-1, 2).T for e in (chains, skips)]
    # How many neighbours of each kind and label a node has: before it, after it, and alike anywhere.
    around = [np.zeros((n, k), dtype=np.float32) for _ in range(3)]
    np.add.at(around[0], ends[0][1], target[ends[0][0]])
    np.add.at(around[1], ends[0][0], target[ends[0][1]])
    np.add.at(around[2], ends[1][1], target[ends[1][0]])
    np.add.at(around[2], ends[1][0], target[ends[1][1]])
    w = np.zeros((len(index), k), dtype=np.float32)
    chain, skip = np.zeros((k, k), dtype=np.float32), np.zeros((k, k), dtype=np.float32)
    speed = [np.zeros_like(v) for v in (w, chain, skip)]
    for _ in range(rounds):
        z = x @ w + around[0] @ chain + around[1] @ chain.T + around[2] @ skip
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = (target - p) / n
        slopes = [x.T @ gap, around[0].T @ gap + (around[1].T @ gap).T, around[2].T @ gap]
        slopes[2] = (slopes[2] + slopes[2].T) / 2
        for i, v in enumerate((w, chain, skip)):
            speed[i] = 0.9 * speed[i] + rate * (slopes[i] - decay * v)
            v += speed[i]
    return Field(index, w.astype(float), chain.astype(float), skip.astype(float))


@lru_cache(maxsize=1)
def default_field() -> Field:
    """The field fitted on the generated sample; fitted once per process (about two seconds)."""
    return fit(training_documents())


_GATE_NUMBER = re.compile(r"\d[\d ./()-]{5}|(?<![\w@#-])[A-Z]{1,3}\d[\dA-Z-]{4}")
_LETTERS = re.compile(r"[^\W\d_]+")
#: A street needs a number beside one of its words; a pair two capitalised words in a row, with what may stand between.
_GATE_PLACE = re.compile(rf"\d ?[a-z]?(?: ?(?:bis|ter|quater))?,? [^\W\d_]|{_STREET_END}(?: |, ?)\d|(?<![\w/-]){_STREET_START}", re.I)
_GATE_PAIR = re.compile(rf"[{_CAPITALS}][{_WORDCHAR}’'-]+ (?:{_W}\. )*(?:(?i:{_PARTICLE}) |al-|el-|d'|D'|AL-|Al-|EL-|El-)?[{_CAPITALS}]")


def may_hold(text: str) -> bool:
    """A quick test that every text with a candidate passes."""
    low = text.lower()
    if "@" in low or "at]" in low or "at)" in low or "at}" in low or (" at " in low and "dot" in low):
        return True
    if not GIVEN.isdisjoint(_LETTERS.findall(low)):
        return True
    if _GATE_NUMBER.search(text) or _GATE_PLACE.search(text) and _STREET.search(text):
        return True
    return _GATE_PAIR.search(text) is not None


def find_pii(text: str | None, field: Field | None = None, least: float = 0.5) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each piece of personal information."""
    if not text or not may_hold(text):
        return []
    nodes = candidates(text)
    if not nodes:
        return []
    p = (field or default_field()).marginals(nodes)
    best = p.argmax(axis=1)
    return [(c.start, c.end, LABELS[b]) for c, b, row in zip(nodes, best, p) if b and row[b] >= least]


def redact(text: str | None, field: Field | None = None) -> str | None:
    """The text with a typed placeholder for each piece of personal information."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_pii(text, field):
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


_FOUND = T.ArrayType(T.StructType([T.StructField("pii_kind", T.StringType()), T.StructField("pii_text", T.StringType())]))


def _finder(field: Field):
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"pii_kind": k, "pii_text": t[a:b]} for a, b, k in find_pii(t, field)])

    return F.pandas_udf(find, _FOUND)


def find_personal(turns: DataFrame, messages: DataFrame, field: Field | None = None) -> DataFrame:
    """(origin, owner_id, idx, pii_kind, pii_text), distinct.

    The field is fitted on the driver and travels with the function (a few kilobytes).  Texts are read
    whole, in one pass without a shuffle; only what was found is shuffled to make it distinct.  Null
    and empty texts hold nothing.
    """
    find = _finder(field or default_field())
    a = turns.select(F.lit("turns").alias("origin"), F.col("transcript_id").cast("long").alias("owner_id"), F.col("turn_idx").cast("long").alias("idx"), F.col("content").alias("text"))
    b = messages.select(F.lit("session_messages").alias("origin"), F.col("session_id").cast("long").alias("owner_id"), F.col("msg_idx").cast("long").alias("idx"), F.col("message").alias("text"))
    x = a.unionByName(b).where("text IS NOT NULL AND text <> ''")
    return x.select("origin", "owner_id", "idx", F.explode(find("text")).alias("p")).select("origin", "owner_id", "idx", "p.pii_kind", "p.pii_text").distinct()


def redact_personal(df: DataFrame, column: str, field: Field | None = None) -> DataFrame:
    """The rows with one text column redacted; nulls stay null."""
    known = field or default_field()

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, known) if isinstance(t, str) else t)

    return df.withColumn(column, clean(F.col(column)))
