r"""Personal information in free text, by a skip-chain conditional random field over candidate spans.

A scanner finds every span that could be an e-mail address, a phone or identity number, a street address or a person's name, over
whole texts; it is meant to miss none and is often wrong. The spans of a document are the nodes of a field: each has a label (O for
none), scored from its shape and the words around it. Three kinds of edges have potentials of their own: spans that follow each other in a
line, spans that overlap (of a run of capitalised words each two are a span), and mentions that repeat a word or a number anywhere in the
document. Loopy message passing gives every node its beliefs, so that a mention that is clear by its words decides for those that aren't.
Found spans are replaced by typed placeholders.

The weights are trained here, by gradient ascent on the pseudo-likelihood of EXAMPLES invented texts (pii_training); no row of the data is
used. In half of the texts a name or a thing stands once where words tell which it is, and again where either could stand, so the
repeated mention can only be told by its edge. Training is deterministic and takes seconds, once per session; the weights are sent to the
executors.

Defined cases: a null or empty text holds nothing; lines are what "\n" separates, counted from 1; equal texts count for each id, equal
rows once; names inside e-mail addresses don't count; a name needs a given name with a surname, or a title with a surname.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.pii_training import COMMON, DEEDS, GIVEN, IDENTITY_WORDS, OPENERS, PHONE_WORDS, ROLES, STREETS, Maker

LABELS = ["O", "email", "phone", "id_number", "address", "name"]
EXAMPLES = 16000
ROUNDS = 6

_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]*[a-zß-öø-ÿ](?:-[A-ZÀ-ÖØ-Þ][\w'’]*)?"
_UP = r"[A-ZÀ-ÖØ-Þ]{2,}(?:[-'’][A-ZÀ-ÖØ-Þ]{2,})?"
#: Titles before a surname, and words that introduce a person.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Professor Doctor Sir Herr Frau Monsieur Madame Mademoiselle Mme Mlle M Señor Señora Srta Sr Sra Don Doña Ing".split()
CUES = "Dear Contact Maintainer Maintained Author Authors Reviewer Reviewed Thanks Merci Dank Gracias Reported Signalé Gemeldet Informado Hi Hello Hallo Bonjour Hola Lieber Liebe Cher Chère Estimado Estimada From To Cc By Von Par Por Ask Call Attn Regards Sincerely Signed Written Holder Owner Questions Write Ship Office Invoices Adresse Anschrift Dirección Passport Kontakt Contacto".split()
#: Titles that are also written small.
SMALL_TITLES = "señor señora señorita don doña monsieur madame mademoiselle docteur doctor doctora professeur professor profesor profesora".split()
_TITLE = rf"(?:{'|'.join(sorted({*TITLES, *(t.upper() for t in TITLES), *SMALL_TITLES}, key=lambda t: (-len(t), t)))})\b\.?"
_PARTICLE = r"(?:(?:van|von|de|di|da|del|bin|al)\ (?:(?:der|den|la|las|los)\ )?)?"
_CITY = r"(?:,?\ (?:(?:[A-Z]{1,2}-)?\d{4,5}\ )?[A-ZÀ-ÖØ-Þ][\w'’-]+(?:\ \d{4,5}\b)?)?"
_WORD = r"[A-ZÀ-ÖØ-Þ][\w'’-]*"
_NO_CUE = rf"(?!(?:{'|'.join(CUES)})\b)"
_OUTSIDE = r"(?![\w]|[\w.+-]*@)"
_DOT = r"(?:\[dot\]|\(dot\)|\{dot\}|<dot>)"
MAILBOX = re.compile(
    rf"""@(?:[\w-]+\.)+[A-Za-z]\w+|\ ?(?:\[at\]|\(at\)|\{{at\}}|<at>)\ ?[\w-]+(?:\ ?(?:{_DOT}|\.)\ ?[\w-]+)+|\ at\ [\w-]+(?:(?:\ dot\ |\ ?{_DOT}\ ?)[\w-]+)+""", re.X | re.I
)
_LOCAL = re.compile(r"[\w.+-]")
#: Where an address, a number or a name may begin: a capital, a digit, + or ( after no letter, and what must follow a capital.
STARTER = re.compile(rf"(?<!\w)(?:{'|'.join(SMALL_TITLES)}) (?=[A-ZÀ-ÖØ-Þ])|" r"[A-ZÀ-ÖØ-Þ\d+(](?<![\w.+\-].)(?:(?<=[\d+(])|[A-Z]?\d{6}|-\d{7}|[\w'’./-]*,? (?=[A-ZÀ-ÖØ-Þ\d]|(?:van|von|de|di|da|del|bin|al|la|las|los|el|postale) ))")
SCANNER = re.compile(
    rf"""(?:
    (?P<address>
        (?:(?:Flat|Apt\.?|Apartment|Suite|Unit|Room)\ \d+\w?,\ )?\d{{1,5}}[a-zA-Z]?,?\ (?:{_WORD}\ ){{1,3}}(?:{'|'.join(STREETS)}|{'|'.join(x.upper() for x in STREETS)})\b\.?{_CITY}
        |(?:[Pp]\.?\ ?[Oo]\.?\ ?[Bb][Oo][Xx]|POSTFACH|Postfach|Boîte\ postale|B\.?P\.?|Apartado(?:\ de\ [Cc]orreos)?|Casilla)\ \d+{_CITY}
        |\d{{1,4}}(?:\ ?(?:bis|ter))?,?\ (?:[Rr]ue|[Aa]venue|[Aa]v\.|[Bb]oulevard|[Bb]d\.?|[Pp]lace|[Cc]hemin|[Ii]mpasse|[Aa]llée|[Qq]uai|[Rr]oute|[Cc]ours|[Ss]quare|[Pp]assage)\ (?:(?:de|du|des|la|le)\ |l['’]|d['’])*{_WORD}(?:[ -]{_WORD})?{_CITY}
        |{_WORD}(?:straße|strasse|str\.|weg|platz|allee|gasse|damm|ring|ufer|chaussee)\ \d{{1,4}}[a-z]?\b{_CITY}
        |(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|Carrera|Ronda|Travesía|Via|Viale|Piazza)\ (?:(?:de|del|la|las|los|el)\ )*{_WORD}(?:\ {_WORD})?,?\ (?:n[.º°]*\ ?)?\d{{1,4}}\b{_CITY})
    |(?P<digits>(?:\+|\()?\d(?:[ ()./-]{{0,2}}\d){{6,17}}(?:[ -]?[A-Z])?(?![\w]|[.:-]\d)|[XYZ][ -]?\d{{7}}[ -]?[A-Z]\b|[A-Z]{{1,2}}\d{{6,8}}[A-Z]?\b)
    |(?P<name>
        {_TITLE}\ (?:{_CAP}\ (?:[A-Z]\.\ )?)?{_PARTICLE}(?:{_CAP}|{_UP}){_OUTSIDE}
        |{_NO_CUE}{_CAP}\ (?:[A-ZÀ-Þ]\.\ ?){{0,2}}{_PARTICLE}{_CAP}{_OUTSIDE}
        |{_NO_CUE}{_CAP},\ {_CAP}(?:\ [A-Z]\.)?{_OUTSIDE}
        |{_UP}\ (?:[A-ZÀ-Þ]\.\ )?{_UP}{_OUTSIDE}|{_UP},\ {_UP}{_OUTSIDE})
    )""",
    re.X,
)


_TITLED = re.compile(_TITLE + " ")


def _mailboxes(text: str) -> list[tuple[int, int, str]]:
    """Spans of e-mail addresses: a host found by its sign, and the local part before it, of any length."""
    found, last = [], 0
    for m in MAILBOX.finditer(text):
        a = m.start()
        while a > last and _LOCAL.match(text[a - 1]):
            a -= 1
        while a < m.start() and text[a] in ".+-":
            a += 1
        if a < m.start():
            if text.startswith("mailto:", a - 7, a) and a - 7 >= last:
                a -= 7
            found.append((a, m.end(), "email"))
            last = m.end()
    return found


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the spans that could be personal, in order. Only names overlap: each two words of a run of capitalised ones are a
    candidate."""
    mail = _mailboxes(text) if "@" in text or "at" in text.lower() else []
    found, k, last = [], 0, 0
    for s in STARTER.finditer(text):
        a = s.start()
        while k < len(mail) and mail[k][1] <= a:
            found.append(mail[k])
            k += 1
        if a < last or (k < len(mail) and mail[k][0] <= a):
            continue
        if m := SCANNER.match(text, a):
            if k < len(mail) and mail[k][0] < m.end():
                continue
            found.append((a, m.end(), m.lastgroup))
            last = m.end()
            if m.lastgroup == "name" and not _TITLED.match(text, a) and "," not in m[0]:
                last = a + m[0].rfind(" ") + 1
    return found + mail[k:]


_ALLOWED = {"email": (0, 1), "address": (0, 4), "digits": (0, 2, 3), "name": (0, 5)}
_MASK = {kind: [0.0 if k in own else -1e9 for k in range(len(LABELS))] for kind, own in _ALLOWED.items()}
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[^\w\s]")
#: Words to the left and right that features may ask for.
_LEFT, _RIGHT = 6, 2
_OPENERS = set(OPENERS)


def _before(text: str, line: int, a: int) -> list[str]:
    """The last _LEFT words and signs of the line before a place, whole."""
    size = 48
    while True:
        at = max(line, a - size)
        found = [m for m in _TOKEN.finditer(text, at, a) if m.start() > at or at == line]
        if at == line or len(found) >= _LEFT:
            return [m[0] for m in found[-_LEFT:]]
        size *= 4


def _after(text: str, z: int, end: int) -> list[str]:
    found = []
    for m in _TOKEN.finditer(text, z, end):
        found.append(m[0])
        if len(found) == _RIGHT:
            break
    return found


def _features(text: str, a: int, z: int, kind: str, line: int, end: int) -> list[str]:
    """What is told of a candidate in the line from LINE to END: its kind and shape, and the words beside it."""
    span = text[a:z]
    beside, right = _before(text, line, a), _after(text, z, end)
    left = beside[-3:]
    low = [w.lower() for w in left]
    words = [w for w in low if w[0].isalnum()]
    after = right[0].lower() if right else "$"
    f = [f"{kind}", f"{kind} l1 {low[-1] if low else '^'}", f"{kind} w1 {words[-1] if words else '^'}", f"{kind} w2 {' '.join(words[-2:])}", f"{kind} r1 {after}"]
    if len(right) > 1:
        f.append(f"{kind} r2 {after} {right[1].lower()}")
    if kind == "digits":
        groups, marks = [str(len(x)) for x in re.findall(r"\d+", span)], "".join(sorted(set(re.findall(r"[^0-9A-Z]", span))))
        lead = "+" if span[0] == "+" else "(" if span[0] == "(" else "00" if span[:2] == "00" else span[0] if not span[0].isdigit() else "0" if span[0] == "0" else "d"
        shape = f"{'-'.join(groups)} {marks} {lead if lead in ('+', '(', '00', '0') else ''} {bool(re.search('[A-Z]$', span))} {span[0].isalpha()}"
        near = next(("phone" if w.lower() in PHONE_WORDS else "identity" for w in reversed(beside) if w.lower() in PHONE_WORDS or w.lower() in IDENTITY_WORDS), "neither")
        f += [f"g {'-'.join(groups)}", f"lead {lead}", f"marks {marks}", f"letter {bool(re.search('[A-Z]$', span))} {span[0].isalpha()}", f"size {sum(map(int, groups))}", f"shape {shape}", f"near {near}", f"near {near} shape {shape}"]
    elif kind == "name":
        form = "title" if _TITLED.match(span) else "comma" if "," in span else "caps" if span.isupper() else "initial" if re.search(r" [A-ZÀ-Þ]\.", span) else "plain"
        own = [w.capitalize() if w.isupper() else w for w in re.findall(r"[^\W\d_]+", span)]
        first = own[-1] if form == "comma" else own[0]
        role = bool(words) and words[-1] in ROLES
        f += [f"form {form}", f"form {form} l1 {low[-1] if low else '^'}", f"form {form} w1 {words[-1] if words else '^'}", f"first {own[0].lower()}", f"given {first in GIVEN} {form}", f"common {sum(w in COMMON for w in own)}", f"role {role} {form}", f"deed {after in DEEDS} {form}", f"own role {any(w.lower() in ROLES for w in own)}", f"one side {not left} {not right} {form}"]
        loud = sum(len(w) > 1 and w.isupper() for w in [*beside, *right])
        quiet = sum(w.islower() for w in [*beside, *right])
        f += [f"loud {min(loud, 3)} {quiet > 0} {form}", f"own opener {sum(w in _OPENERS for w in own)} {form}"]
        if left and left[-1].isupper() and len(left[-1]) > 1:
            f.append(f"shout {form}")
        if right and right[0].isupper() and len(right[0]) > 1:
            f.append(f"shouted {form}")
        if not left or left[-1] in ".!?":
            f.append("starts a sentence")
            f.append(f"starts with {own[0].lower()}")
    return f


def _keys(kind: str, span: str) -> list[str]:
    """What mentions may have in common: a word of a name, a number's digits and the last seven of them, a mailbox, an address."""
    if kind == "name":
        return [f"n {w.lower()}" for w in re.findall(r"[^\W\d_]{2,}", _TITLED.sub("", span))]
    if kind == "digits":
        plain = re.sub(r"\D", "", span)
        return [f"d {plain}", f"t {plain[-7:]}"]
    return [f"{kind} {span.lower()}"]


#: The kinds of edges: neighbours in a line, overlapping names, repeated mentions.
EDGES = ("chain", "cross", "skip")


class Field:
    """Weights of the field, and inference over any number of documents at once."""

    def __init__(self, index: dict[str, int], unary: np.ndarray, pair: dict[str, np.ndarray]) -> None:
        self.index, self.unary, self.pair = index, unary, pair

    def nodes(self, texts: list[str | None]) -> tuple[list[tuple[int, int, int, str]], list[list[str]], dict[str, np.ndarray]]:
        """(document, start, end, kind) of the candidates, their features, and the pairs of each kind of edges."""
        nodes, features, edges = [], [], {e: [] for e in EDGES}
        for d, text in enumerate(texts):
            if not text:
                continue
            before, line, end, seen = -1, 0, -1, {}
            for a, z, kind in candidates(text):
                n = len(nodes)
                same = before >= 0 and a <= end
                if not same:
                    line = text.rfind("\n", line, a) + 1 or line
                if z > end:
                    end = text.find("\n", z)
                    end = len(text) if end < 0 else end
                nodes.append((d, a, z, kind))
                features.append(_features(text, a, z, kind, line, end))
                if same:
                    edges["cross" if a < nodes[before][2] else "chain"].append((before, n))
                linked = {seen[k] for k in _keys(kind, text[a:z]) if k in seen}
                edges["skip"] += [(m, n) for m in sorted(linked) if nodes[m][2] <= a]
                seen.update(dict.fromkeys(_keys(kind, text[a:z]), n))
                before = n
        return nodes, features, {e: np.array(x, np.int64).reshape(-1, 2) for e, x in edges.items()}

    def rows(self, features: list[list[str]]) -> np.ndarray:
        """Each node's features as rows of the weights; unknown ones point to the row of zeros after the last."""
        none, get = len(self.index), self.index.get
        out = np.full((len(features), max(map(len, features), default=1)), none, np.int64)
        for n, f in enumerate(features):
            out[n, : len(f)] = [get(x, none) for x in f]
        return out

    def scores(self, nodes: list[tuple[int, int, int, str]], rows: np.ndarray) -> np.ndarray:
        weights = np.concatenate([self.unary, np.zeros((1, len(LABELS)))])
        return weights[rows].sum(axis=1) + np.array([_MASK[kind] for *_, kind in nodes])

    def beliefs(self, scores: np.ndarray, edges: dict[str, np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
        """Log beliefs after ROUNDS of damped sum-product messages along all edges, both ways."""
        every = np.concatenate([edges[e] for e in edges]) if edges else np.empty((0, 2), np.int64)
        if not len(every):
            return scores
        forward = np.concatenate([np.repeat(self.pair[e][None], len(edges[e]), 0) for e in edges])
        source, target = np.concatenate([every[:, 0], every[:, 1]]), np.concatenate([every[:, 1], every[:, 0]])
        potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(every)) + len(every), np.arange(len(every))])
        messages = np.zeros((len(source), len(LABELS)))
        for _ in range(rounds):
            belief = scores.copy()
            np.add.at(belief, target, messages)
            cavity = belief[source] - messages[back]
            x = cavity[:, :, None] + potential
            top = x.max(axis=1, keepdims=True)
            new = (np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]).astype(float)
            new -= new.max(axis=1, keepdims=True)
            messages = 0.5 * messages + 0.5 * new
        belief = scores.copy()
        np.add.at(belief, target, messages)
        return belief

    def labels(self, texts: list[str | None], without: tuple[str, ...] = ()) -> tuple[list[tuple[int, int, int, str]], np.ndarray]:
        """The candidates and their labels; edges of kinds WITHOUT are left out."""
        nodes, features, edges = self.nodes(texts)
        if not nodes:
            return [], np.empty(0, np.int64)
        return nodes, self.beliefs(self.scores(nodes, self.rows(features)), {e: x for e, x in edges.items() if e not in without}).argmax(axis=1)

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(document, start, end, label) of the spans that are personal, in order and apart: overlapping names are one."""
        found: list[tuple[int, int, int, int]] = []
        for (d, a, z, _), k in zip(*self.labels(texts), strict=True):
            if k and found and found[-1][0] == d and a < found[-1][2]:
                found[-1] = (d, found[-1][1], max(z, found[-1][2]), found[-1][3])
            elif k:
                found.append((d, a, z, int(k)))
        return found


def _truth(text: str, kind: str, a: int, z: int, gold: list[tuple[int, int, int]]) -> int:
    """A candidate's label: that of the detail it touches; a name without a title must lie in it."""
    for x, y, label in gold:
        touches = x < z and a < y
        if label in _ALLOWED[kind] and touches and (kind != "name" or (x <= a and z <= y) or _TITLED.match(text, a)):
            return label
    return 0


def trained(examples: int = EXAMPLES, seed: int = 7, steps: int = 60) -> Field:
    """A field trained on invented texts."""
    make = Maker(seed)
    texts, gold = zip(*(make.text() for _ in range(examples)), strict=True)
    n = len(LABELS)
    field = Field({}, np.zeros((0, n)), {e: np.zeros((n, n)) for e in EDGES})
    nodes, features, edges = field.nodes(list(texts))
    counts = Counter(x for f in features for x in f)
    field.index = {f: k for k, f in enumerate(sorted(f for f, c in counts.items() if c >= 3))}
    field.unary = np.zeros((len(field.index), n))
    rows = field.rows(features)
    truth = np.array([_truth(texts[d], kind, a, z, gold[d]) for d, a, z, kind in nodes])
    flat, width, none = rows.ravel(), rows.shape[1], len(field.index)
    order = np.argsort(flat, kind="stable")
    order = order[flat[order] < none]
    owner, firsts = order // width, np.searchsorted(flat[order], np.arange(none))
    size = np.diff(np.append(firsts, len(order)))[:, None]
    one, mask, base = np.eye(n, dtype=np.float32)[truth], np.array([_MASK[kind] for *_, kind in nodes], np.float32), np.zeros((1, n), np.float32)
    weights, drift = np.zeros((none, n), np.float32), np.zeros((none, n), np.float32)
    for _ in range(steps):  # diagonal-scaled gradient ascent with momentum on the pseudo-likelihood, with a quadratic penalty
        ahead = np.concatenate([weights + 0.7 * drift, base])
        s = mask.copy()
        for k in range(width):
            s += ahead[rows[:, k]]
        for e, w in field.pair.items():
            np.add.at(s, edges[e][:, 1], w[truth[edges[e][:, 0]]])
            np.add.at(s, edges[e][:, 0], w.T[truth[edges[e][:, 1]]])
        p = np.exp(s - s.max(axis=1, keepdims=True))
        g = one - p / p.sum(axis=1, keepdims=True)
        grad = np.add.reduceat(g[owner], firsts, axis=0)
        drift = 0.7 * drift + (grad - 0.05 * ahead[:-1]) / (size + 2)
        weights += drift
        for e, w in field.pair.items():
            d, x, y = np.zeros_like(w), truth[edges[e][:, 0]], truth[edges[e][:, 1]]
            np.add.at(d, x, g[edges[e][:, 1]])
            np.add.at(d.T, y, g[edges[e][:, 0]])
            w += 0.5 * (d - 0.5 * w) / (np.bincount(x, minlength=n)[:, None] + np.bincount(y, minlength=n)[None, :] + 20)
    field.unary = weights.astype(float)
    return field


_TRAINED: dict = {}


def _field(examples: int = EXAMPLES) -> Field:
    if examples not in _TRAINED:
        _TRAINED[examples] = trained(examples)
    return _TRAINED[examples]


def find_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, pii_kind) of each line that holds a detail of the kind. One pass, no shuffle but of the findings."""
    field = documents.sparkSession.sparkContext.broadcast(_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = part.column(1).to_pylist()
                found = field.value.find(texts)
                at = part.column(0).take(pa.array([d for d, *_ in found], pa.int64()))
                lines = [texts[d].count("\n", 0, a) + 1 for d, a, _, _ in found]
                yield pa.RecordBatch.from_arrays([at, pa.array(lines, pa.int64()), pa.array([LABELS[y] for *_, y in found], pa.string())], ["doc_id", "line_no", "pii_kind"])

    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return d.mapInArrow(run, "doc_id bigint, line_no bigint, pii_kind string").distinct()


def masked(documents: DataFrame) -> DataFrame:
    """(doc_id, text, n_masked): texts with a placeholder such as [EMAIL] in place of each detail."""
    field = documents.sparkSession.sparkContext.broadcast(_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = part.column(1).to_pylist()
                spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for d, a, z, y in field.value.find(texts):
                    spans[d].append((a, z, y))
                out = []
                for t, own in zip(texts, spans, strict=True):
                    pieces, last = [], 0
                    for a, z, y in own:
                        pieces += [t[last:a], f"[{LABELS[y].upper()}]"]
                        last = z
                    out.append("".join([*pieces, t[last:]]) if own else t)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string()), pa.array([len(x) for x in spans], pa.int32())], ["doc_id", "text", "n_masked"])

    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    return d.mapInArrow(run, "doc_id bigint, text string, n_masked int")
