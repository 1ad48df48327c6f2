"""Subject area of each document (problem 8).

Curated subject terms are matched with a multi-pattern automaton (Aho-Corasick) over the document's
statements.  A term weighs by its rarity and its specificity; a statement deals with the subjects whose
terms reach the statement threshold; a document has every subject whose share of statements reaches
the calibrated document threshold.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: Curated terms (fixed values) by subject, in English, German, French and Spanish.
TERMS = {
    "education": "lecture hall; lecture; open day; reading list; homework; student; school term; school trip; field trip; parents evening; parents' evening; essay; essay mark; lesson plan; class register; scholarship; quiz bank; marking scheme; seminar; seminar room; exam paper; exam; teaching assistant; timetable; question bank; tutor; tutor group; thesis; thesis draft; module credit; attendance sheet; attendance; report card; kindergarten; grade book; grade; curriculum; course author; prüfung; klassenbuch; stundenplan; stipendium; zeugnis; seminarraum; hausaufgabe; lehrplan; examen; emploi du temps; cahier de notes; programme scolaire; devoir; bourse d'études; bulletin; salle de cours; plan de estudios; aula; horario escolar; beca; libro de notas; boletín; deberes",
    "farming": "feed ration; plough depth; fertiliser; orchard row; orchard; herd register; herd; frost warning; sowing plan; sowing; vineyard block; vineyard; lambing; lambing season; grain silo; grain; compost; compost heap; crop rotation; crop; irrigation valve; irrigation; silo; beehive; barn sensor; barn; field boundary; drainage ditch; greenhouse; greenhouse vent; milk yield; harvester; tractor route; tractor; hay bale; hay; pest trap; soil moisture; soil; pasture; seed batch; milchertrag; getreidesilo; weide; saatgut; gewächshaus; bodenfeuchte; fruchtfolge; mähdrescher; pâturage; silo à grain; rotation des cultures; rendement laitier; humidité du sol; serre; semence; moissonneuse; silo de grano; cosechadora; pasto; producción de leche; invernadero; humedad del suelo; rotación de cultivos; semilla",
    "finance": "credit note; share price; hedge ratio; budget line; budget; exchange rate; cash flow; tax return; invoice; closing price; margin call; payroll run; payroll; treasury bill; treasury; portfolio weight; portfolio; mortgage; audit trail; interest rate; credit limit; bond yield; branch teller; accrual; settlement date; loan schedule; ledger balance; depreciation; chargeback; dividend; overdraft; zinssatz; rechnung; aktienkurs; kredit; wechselkurs; steuererklärung; kontostand; anleihe; taux d'intérêt; taux de change; action cotée; facture; solde du compte; crédit; obligation; déclaration fiscale; saldo de la cuenta; bono; crédito; tipo de cambio; declaración fiscal; factura; tasa de interés; acción",
    "health": "blood pressure; blood; therapy; patient chart; patient; pharmacy stock; pharmacy; lab result; rehabilitation plan; rehabilitation; pulse reading; consent form; referral letter; referral; ward; ward round; triage score; triage; symptom diary; nurse rota; nurse; cell count; allergy flag; allergy; clinical trial; diagnosis; diagnosis code; diagnosis codes; discharge note; vaccine lot; vaccine; insulin pump; insulin; infection rate; infection; prescription; bed occupancy; operating theatre; dosage; x-ray image; x ray image; therapie; blutdruck; dosierung; impfstoff; diagnose; rezept; station; patientenakte; ordonnance; diagnostic; vaccin; tension artérielle; posologie; dossier patient; dossier du patient; infirmière; thérapie; presión arterial; diagnóstico; terapia; receta médica; historia clínica; enfermera; vacuna; dosis",
    "law": "appeal deadline; appeal; licence term; evidence bundle; evidence; defendant; contract clause; contract; hearing date; hearing; tribunal; indemnity; settlement offer; statute; injunction; case docket; docket; plaintiff; power of attorney; copyright notice; copyright; bail; bail hearing; liability cap; liability; notary seal; notary; witness statement; witness; deposition; judge's order; legal hold; notice period; jurisdiction; arbitration; court filing; trial brief; berufungsfrist; zeugenaussage; notar; haftung; vertragsklausel; kläger; gericht; gesetz; témoignage; plaignant; clause du contrat; tribunal; loi; responsabilité civile; notaire; délai d'appel; plazo de apelación; responsabilidad civil; juzgado; notario; ley; demandante; cláusula del contrato; testimonio",
    "music": "key signature; time signature; sound check; vocal take; vinyl pressing; vinyl; string section; concert; concert hall; chord chart; chord; drum loop; rehearsal; bass track; orchestra; orchestra pit; sheet music; harmony; choir part; choir; mixing desk; encore; octave; tempo map; tempo; melody line; melody; guitar tab; guitar; reverb tail; reverb; conductor; setlist; pitch bend; record label; record labels; melodie; takt; konzertsaal; chor; akkord; tonart; schlagzeug; partitur; chœur; mesure; accord; mélodie; partition musicale; batterie; tonalité; salle de concert; partitura; coro; acorde; sala de conciertos; melodía; percusión; compás; tonalidad",
    "science": "light curve; plasma density; reaction yield; seismic wave; titration curve; titration; telescope exposure; telescope; sediment core; sediment; protein fold; protein; microscope slide; microscope; enzyme assay; enzyme; wavelength; petri dish; isotope ratio; isotope; hypothesis; control group; covalent bond; centrifuge run; centrifuge; genome read; genome; molecule; cell culture; redshift; spectrometer; orbital period; particle track; field sample; isotop; molekül; zellkultur; enzym; wellenlänge; spektrometer; teleskop; mikroskop; molécule; culture cellulaire; spectromètre; microscope; télescope; longueur d'onde; isotope; isótopo; espectrómetro; enzima; longitud de onda; molécula; cultivo celular; microscopio; telescopio",
    "software": "stack trace; merge conflict; service mesh; thread pool; garbage collector; canary release; package registry; class loader; feature flag; kernel module; heap dump; linker flag; type checker; container image; syscall trace; syscall; static analyser; memory leak; memory protection; debugger; lockfile; code coverage; mutex contention; mutex; branch protection; compiler pass; compiler; build pipeline; bytecode; breakpoint; load balancer; paketverwaltung; containerabbild; speicherleck; lastverteiler; merge-konflikt; débogueur; compilateur; conflit de fusion; fuite de mémoire; fuite mémoire; image de conteneur; gestionnaire de paquets; noyau; depurador; contenedor; fuga de memoria; compilador; conflicto de fusión; gestor de paquetes; hilo de ejecución; répartiteur de charge; balanceador de carga; noyau du système; imagen de contenedor",
    "sport": "season ticket; penalty kick; penalty; offside line; offside; lap record; referee call; referee; sprint time; marathon split; marathon; tennis court; tennis; substitution; batting order; transfer window; transfer fee; heat sheet; goalkeeper; match report; playoff seed; playoff; final score; relay team; relay; home pitch; tournament draw; tournament; training load; league table; league; podium; goal difference; coach; scrum; half-time; half time; schiedsrichter; tabellenplatz; trainingsplan; torwart; staffel; halbzeit; elfmeter; turnier; but; plan d'entraînement; entraînement; relais; mi-temps; tournoi; tir au but; classement; gardien de but; arbitre; relevo; descanso; plan de entrenamiento; entrenamiento; árbitro; torneo; clasificación; portero; penalti",
    "travel": "rail pass; visa stamp; visa; seat map; ferry crossing; ferry; layover; fare class; departure gate; city break; passport control; passport; cruise cabin; cruise; platform; platform change; itinerary; flight leg; flight; mountain hut; tour guide; luggage tag; luggage; hotel booking; hotel; car hire; beach resort; travel agent; boarding pass; room rate; hostel; hostel bed; customs form; customs; sightseeing; check-in desk; check in desk; visum; hotelbuchung; flugabschnitt; bordkarte; bahnsteig; reiseroute; fähre; gepäck; carte d'embarquement; bagage; quai de gare; itinéraire; vol; réservation d'hôtel; itinerario; tarjeta de embarque; equipaje; andén; reserva de hotel; visado; transbordador; vuelo",
}

#: Words of one language that are also everyday words elsewhere count only in that language's letters or context.
SHARED_WEIGHT = 0.5
_SHARED = frozenset("but vol action loi mesure accord obligation examen station ward platform grade transfer coach concert soil crop student school school term evidence contract patient budget flight hotel tribunal bulletin takt ley bono aula".split())
#: Calibrated on hand labels: the score of a statement, and the share of statements.
STATEMENT = 0.5
DOCUMENT = 0.17

_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)]*\s+|\n+")
_PREFIX = re.compile(r"^\s*(?:\[[^\]\n]{8,40}\]\s*)?(?:User|AI|Developer|Assistant|Tool|System|Human|Copilot|Model)\s*[:-]\s*", re.I)
_FENCE = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)", re.S)
_NOT_WORD = re.compile(r"[^\w']+")


def normalised(text: str) -> str:
    """Lower-case words with single spaces, identifiers taken apart."""
    text = _CAMEL.sub(" ", text).replace("_", " ").lower().replace("’", "'")
    return " " + _NOT_WORD.sub(" ", text).strip() + " "


def statements(text: str) -> list[str]:
    """Sentences of the running text; code blocks, headings and speaker marks are none."""
    out = []
    for line in _FENCE.sub("\n", text).split("\n"):
        if line.lstrip().startswith("#"):
            continue
        line = _PREFIX.sub("", line)
        for sentence in _SENTENCE.split(line):
            words = normalised(sentence)
            if words.count(" ") >= 3:
                out.append(words)
    return out


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    entries: dict[str, list[tuple[str, float]]] = {}
    for subject, terms in TERMS.items():
        for term in dict.fromkeys(t.strip() for t in terms.split(";")):
            weight = SHARED_WEIGHT if term in _SHARED else 1.0
            plain = normalised(term).strip()
            forms = {plain}
            head = plain.split(" ")
            for ending in ("s", "es", "n", "en", "e"):
                forms.add(plain + ending)
            if plain.endswith("y"):
                forms.add(plain[:-1] + "ies")
            if len(head) > 1:  # plural of the first noun, and compounds written in one word
                forms |= {" ".join([head[0] + "s", *head[1:]]), " ".join([head[0] + "s", *head[1:-1], head[-1] + "s"]), "".join(head), "".join(head) + "s"}
            for form in forms:
                entries.setdefault(f" {form} ", []).append((subject, weight))
    for form, found in entries.items():
        a.add_word(form, (len(form), tuple(dict.fromkeys(found))))
    a.make_automaton()
    return a


def statement_scores(words: str) -> dict[str, float]:
    """Score of each subject in one statement; a term inside a longer one does not count."""
    hits = []
    for end, (size, found) in automaton().iter(words):
        hits.append((end - size + 1, end, found))
    hits.sort(key=lambda h: (h[0] - h[1], h[0]))
    taken: list[tuple[int, int]] = []
    scores: dict[str, float] = {}
    for a, b, found in hits:
        if any(a < y and x < b for x, y in taken):
            continue
        taken.append((a, b))
        share = 1.0 / len({s for s, _ in found})
        for subject, weight in found:
            scores[subject] = scores.get(subject, 0.0) + weight * share
    return scores


def subject_shares(text: str | None) -> dict[str, float]:
    """Share of the document's statements that deal with each subject."""
    if not text:
        return {}
    all_statements = statements(text)
    counts: dict[str, float] = {}
    for words in all_statements:
        for subject, score in statement_scores(words).items():
            if score >= STATEMENT:
                counts[subject] = counts.get(subject, 0) + 1
    return {s: n / len(all_statements) for s, n in counts.items()}


_SHARES = T.ArrayType(T.StructType([T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType())]))


@F.pandas_udf(_SHARES)
def shares_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"subject": s, "share": v} for s, v in subject_shares(t).items()])


def document_shares(documents: DataFrame) -> DataFrame:
    """(doc_id, subject, share) of every subject a document touches; one scan, no shuffle."""
    texts = documents.select("doc_id", "text").where("text IS NOT NULL AND text <> ''")
    return texts.select("doc_id", F.explode(shares_of("text")).alias("s")).select("doc_id", "s.subject", "s.share")


def calibrate(documents: DataFrame, labels: DataFrame, bound: int = 5000) -> dict[str, float]:
    """The share with the best F1 on at most ``bound`` hand-labelled documents (the smallest hashes of their ids)."""
    gold = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where("subject IS NOT NULL").distinct()
    ids = gold.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(bound)
    rows = document_shares(documents.join(ids, "doc_id", "left_semi")).join(gold.join(ids, "doc_id", "left_semi").withColumn("told", F.lit(1)), ["doc_id", "subject"], "full").selectExpr("coalesce(share, 0.0)", "coalesce(told, 0)").collect()
    best = {"threshold": DOCUMENT, "f1": 0.0}
    for t in [x / 100 for x in range(10, 41)]:
        tp = sum(1 for s, y in rows if s >= t and y)
        fp, fn = sum(1 for s, y in rows if s >= t and not y), sum(1 for s, y in rows if s < t and y)
        f1 = 2 * tp / max(1, 2 * tp + fp + fn)
        if f1 > best["f1"]:
            best = {"threshold": t, "f1": f1}
    return best


def find_subjects(documents: DataFrame, subjects: DataFrame, least: float = DOCUMENT) -> DataFrame:
    """(doc_id, subject), spelled as in ``subjects``, distinct.

    Defined results: a null or empty text, or one without statements, has no subject; equal texts under
    several ids are each reported; subjects without curated terms are never found.
    """
    names = subjects.select(F.col("subject").alias("name")).where("name IS NOT NULL").distinct()
    found = document_shares(documents).where(F.col("share") >= least - 1e-9)
    return found.join(names, F.lower(F.trim("name")) == F.col("subject")).select("doc_id", F.col("name").alias("subject")).distinct()
