"""Secret scans: three fixed patterns, and Markov models of random strings against ordinary words and identifiers.

Tokens of 16 characters or more are scored with the log-likelihood ratio of two
character Markov models, one trained on random strings and one on ordinary
ones: words of several languages and their compounds, identifiers, paths and
numbers.  The ratio alone decides.  Tokens over the threshold become spans of
kind "markov" beside those of the patterns; of a token that a pattern's span
covers in part, the rest is scored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs, as a shorter match would go on
LEAST = {"assign": 8, "access": 16}

#: Characters of the shortest token that is scored.
SHORTEST = 16
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: Mean log-likelihood ratio a character from which a token counts as random.
THRESHOLD = 0.2
#: Samples of each label that a model is trained on.
SAMPLES = 12000

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, 0, dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1

# Parts of ordinary identifiers in source code and addresses.
PARTS = """access account action address admin after alert alias append apply array asset async attribute author auto
backup base batch before binary block body bool border bottom boundary branch bucket buffer build button byte cache call
callback cancel category cell center chain change channel char check child class clean click client clone close cluster
code collection color column command comment commit common compare component config connect console const container
content context control convert cookie copy count create current cursor custom daily data database date debug default
delete demo depth detail device dialog digest disable display document domain double download draft draw driver dummy
edit element email empty enable encode engine entry enum error escape event example execute expand export extend factory
false feature feed fetch field file filter final find first flag float flush folder font footer force form format forward
frame function gateway generate get global graph grid group guide handle hash header health height helper hidden history
home hook hook host html http icon image import index info inner input insert install int integer internal invalid item
iterator job join json key kind label language last layer layout left length level library limit line link list listener
load local lock log login logout long loop main make manager map margin mark master match matrix max media member memory
menu merge message meta method metric middle migration min mobile mode model module monitor month mouse move multi name
native navigation network new next node normal note null number object offset open operator option order origin output
owner package page panel param parent parse partition pass patch path pattern payload pending percent permission phone
pipeline pixel plan platform player plugin point policy pool popup port position post prefix preview price primary print
priority private process product profile program project property protocol provider proxy public publish query queue
radius random range rate ratio read ready record recursive redirect reduce reference refresh region register release
remote remove render replace reply report request reset resize resource response result retry return review right role
root rotate round route row rule run sample save scale scan schedule schema scope screen script scroll search section
segment select send sequence serial server service session set shape share short show shuffle sidebar signal simple single
size skip slot socket sort source space span split stack stage start state static status step stop storage store stream
string strip style submit summary super suffix support switch symbol sync system tab table tag target task template test
text theme thread throw time timeout title toggle token tool top total trace track transaction transform tree trigger
true type unique unit update upload url user util valid value variable vector version video view virtual visible volume
wait warning watch web week weight widget width window word worker wrapper write xml year zone""".split()


# The first articles of a public declaration in six languages, and everyday words, without accents.
TEXT = """All human beings are born free and equal in dignity and rights They are endowed with reason and conscience and should act
towards one another in a spirit of brotherhood Everyone is entitled to all the rights and freedoms set forth in this declaration
without distinction of any kind such as race colour sex language religion political or other opinion national or social origin
property birth or other status Everyone has the right to life liberty and security of person
the of and to in is that it was for on are with as his they be at one have this from or had by not but what some we can out other
were all there when up use your how said an each she which their time will way about many then them would write like these long
make thing see him two has look more day could go come did my sound no most number who over know water than call first people may
down side been now find any new work part take get place made live where after back little only round man year came show every good
through thought through weather whether nothing something together against question international understanding communication
Alle Menschen sind frei und gleich an Wurde und Rechten geboren Sie sind mit Vernunft und Gewissen begabt und sollen einander im
Geist der Bruderlichkeit begegnen Jeder hat Anspruch auf die in dieser Erklarung verkundeten Rechte und Freiheiten ohne irgendeinen
Unterschied etwa nach Rasse Hautfarbe Geschlecht Sprache Religion politischer oder sonstiger Uberzeugung nationaler oder sozialer
Herkunft Vermogen Geburt oder sonstigem Stand Jeder hat das Recht auf Leben Freiheit und Sicherheit der Person
der die und in den von zu das mit sich des auf fur ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
einer um am sind noch wie einem uber einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde schon wenn ihre alle
Geschwindigkeit Gesellschaft Wirtschaft Verantwortung Entwicklung Zusammenarbeit Zeitschrift tatsachlich wahrscheinlich schlechthin
Moglichkeit Gerechtigkeit Wissenschaft verschiedene zwischen Deutschland Versicherung freundlich Pfeffer Schiff zwanzig schreiben
Tous les etres humains naissent libres et egaux en dignite et en droits Ils sont doues de raison et de conscience et doivent agir les
uns envers les autres dans un esprit de fraternite Chacun peut se prevaloir de tous les droits et de toutes les libertes proclames
dans la presente declaration sans distinction aucune notamment de race de couleur de sexe de langue de religion politique ou de toute
autre opinion origine nationale ou sociale de fortune de naissance ou de toute autre situation Tout individu a droit a la vie
le de un a etre et en avoir que pour dans ce il qui ne sur se pas plus par je avec tout faire son mettre autre on mais nous comme ou si
leur y dire elle devoir avant deux meme prendre aussi celui donner bien fois vous encore nouveau aller cela entre premier vouloir deja
grand mon moins aucun lui temps tres savoir falloir voir quelque sans raison notre dont non monde jour monsieur demander alors apres
Todos los seres humanos nacen libres e iguales en dignidad y derechos y dotados como estan de razon y conciencia deben comportarse
fraternalmente los unos con los otros Toda persona tiene todos los derechos y libertades proclamados en esta declaracion sin distincion
alguna de raza color sexo idioma religion opinion politica o de cualquier otra indole origen nacional o social posicion economica
nacimiento o cualquier otra condicion Todo individuo tiene derecho a la vida a la libertad y a la seguridad de su persona
de la que el en y a los se del las un por con no una su para es al lo como mas o pero sus le ha me si sin sobre este ya entre cuando
todo esta ser son dos tambien fue habia era muy anos hasta desde nos mi porque que solo han yo hay vez puede todos asi ni parte tiene
Todos os seres humanos nascem livres e iguais em dignidade e em direitos Dotados de razao e de consciencia devem agir uns para com os
outros em espirito de fraternidade Todos os seres humanos podem invocar os direitos e as liberdades proclamados sem distincao alguma
nao uma com para mais por isso tambem muito entao porque trabalho informacoes desenvolvimento universidade conhecimento
Tutti gli esseri umani nascono liberi ed eguali in dignita e diritti Essi sono dotati di ragione e di coscienza e devono agire gli uni
verso gli altri in spirito di fratellanza Ad ogni individuo spettano tutti i diritti e tutte le liberta senza distinzione alcuna
""".split()


def _digits(seed: str) -> Iterator[int]:
    """An endless stream of bytes that hangs on the seed alone."""
    n = 0
    while True:
        yield from hashlib.sha256(f"{seed}:{n}".encode()).digest()
        n += 1


LOWER, UPPER, NUMBERS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
#: What random strings are drawn from: letters and digits, base64, hex, base32, letters of one case.
ALPHABETS = (LOWER + UPPER + NUMBERS, ALPHABET[:64], LOWER + UPPER + NUMBERS + "_-", NUMBERS + "abcdef", NUMBERS + "ABCDEF", UPPER + "234567", UPPER + NUMBERS, LOWER + NUMBERS, LOWER, UPPER, LOWER + UPPER)
_STYLES = 12


def labelled_samples(count: int = SAMPLES, seed: str = "train") -> list[tuple[str, int]]:
    """(string, label): label 1 for random strings of every alphabet, a fourth of them grouped, label 0 for ordinary ones."""
    out, source = [], _digits(seed)
    take = lambda n: (next(source) << 16 | next(source) << 8 | next(source)) % n
    pick = lambda words: words[take(len(words))]

    def natural(joint: str = "") -> str:
        words = [pick(TEXT).lower()]
        while sum(map(len, words)) < SHORTEST:
            words.append(pick(TEXT).lower())
        return joint.join(words)

    def ordinary(style: int) -> str:
        words = [pick(PARTS if take(2) else TEXT).lower() for _ in range(3 + take(4))]
        if take(2) and style < 5:
            words.insert(1 + take(len(words)), str(take(3000)))
        if style == 0:
            return words[0] + "".join(w.capitalize() for w in words[1:])
        if style in (1, 2, 4):
            return ("_", "-", "/")[style // 2].join(words)
        if style == 3:
            return "_".join(words).upper()
        if style == 5:
            return "".join(str(take(10)) for _ in range(SHORTEST + take(8)))
        if style == 6:
            return f"{1990 + take(40)}-{1 + take(12):02}-{1 + take(28):02}T{take(24):02}-{take(60):02}-{take(60):02}"
        if style == 7:
            return pick("=-_+/") * (SHORTEST + take(40))
        return (natural(), natural().capitalize(), natural().upper(), natural("-"))[style - 8]

    for i in range(count):
        letters = ALPHABETS[i % len(ALPHABETS)]
        drawn = "".join(pick(letters) for _ in range(SHORTEST + take(33)))
        if take(4) == 0:
            size, joint = 4 + take(5), pick("-_")
            drawn = joint.join(drawn[at : at + size] for at in range(0, len(drawn), size))
        out.append((drawn, 1))
        out.append((ordinary(i % _STYLES), 0))
    return out


class MarkovPair:
    """Log-likelihood ratios of character bigrams: random against ordinary."""

    def __init__(self, samples: Iterable[tuple[str, int]], smoothing: float = 0.5):
        n = len(ALPHABET) + 1
        counts = np.full((2, n, n), smoothing)
        for text, label in samples:
            np.add.at(counts[label], tuple(self._pairs(text)), 1)
        chance = np.log(counts / counts.sum(2, keepdims=True))
        self.ratio = chance[1] - chance[0]

    @staticmethod
    def _pairs(text: str) -> tuple[np.ndarray, np.ndarray]:
        code = _CODE[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8) & 127]
        return np.concatenate([[0], code[:-1]]), code

    def score(self, text: str) -> float:
        """Mean ratio a character; above 0 random strings are likelier."""
        return float(self.ratio[self._pairs(text)].mean()) if text else -math.inf


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind as listed."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def added_spans(text: str, base: list[tuple[str, int, int]], model: MarkovPair, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Tokens, or what base spans (sorted by start) leave of them, that read as random."""
    out, at = [], 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][2] <= start:
            at += 1
        free, i = [], at
        while i < len(base) and base[i][1] < end:
            free.append((start, base[i][1]))
            start = max(start, base[i][2])
            i += 1
        for a, b in (*free, (start, end)):
            if b - a >= SHORTEST and model.score(text[a:b]) >= threshold:
                out.append(("markov", a, b))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes [SECRET]; of an assignment the value alone goes."""
    cuts = sorted((ASSIGN.match(text, a, b).start(2) if kind == "assign" else a, b) for kind, a, b in spans)
    out, at = [], 0
    for a, b in cuts:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(model: MarkovPair, threshold: float, rewrite: bool):
    def run(batches):
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            counts, digests, spans, clean = [], [], [], []
            for text in texts:
                text = text or ""
                base = base_spans(text)
                found = sorted(base + added_spans(text, base, model, threshold), key=lambda s: (s[1], KINDS.index(s[0])))
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS[:3]])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
                clean.append(redact(text, found) if found else text)
            columns = [keys, *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            if rewrite:
                columns.append(pa.array([c if t is not None else None for c, t in zip(clean, texts)], pa.string()))
                names.append("text")
            yield pa.record_batch(columns, names)

    return run


_COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, model: MarkovPair | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of documents(doc_id, text): base counts, digest of the base spans, all spans.

    Spans are kind:start:end in code points, end exclusive, of whole matches.
    Null texts count as empty (no spans, the digest of the empty string); null
    and repeated doc_ids are passed on; other columns are ignored; the time for
    a very long text grows with its length and its spans; an empty table gives
    an empty result.
    """
    model = model or MarkovPair(labelled_samples())
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(model, threshold, False), _COLUMNS)


def redact_secrets(docs: DataFrame, model: MarkovPair | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the secrets of column text replaced by [SECRET]; null texts stay null, other columns stay.

    n_chars, if there, follows the new text.
    """
    model = model or MarkovPair(labelled_samples())

    def texts(batches):
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text) if text else []
                found = sorted(base + added_spans(text, base, model, threshold), key=lambda s: (s[1], KINDS.index(s[0]))) if text else []
                out.append(redact(text, found) if found else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    at = docs.columns.index("text")
    clean = docs.mapInArrow(texts, docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
