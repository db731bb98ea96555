"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Patterns find e-mail and IP addresses, card and international phone numbers. The random field
finds what needs context: names after a title or cue, local phone numbers, identity numbers. It is
trained from the small labelled table below by maximum likelihood, over the shapes (or cue
words) of a word and of the two on each side, and decoded by Viterbi in numpy over many lines
at once, one step for all lines that are still running.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import free, map_texts

KINDS = ("email", "ip", "card", "phone", "name", "tel", "id")
BASE = 4
LABELS = ("O", "B-name", "I-name", "B-tel", "I-tel", "B-id", "I-id")
WINDOW = (-2, -1, 0, 1, 2)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is only tried from its start: a later start would meet the same end.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Words that are features themselves, whatever their shape.
CUES = frozenset("mr mrs ms dr prof name named called dear signed sincerely regards by from phone tel telephone call fax mobile cell dial ssn passport id nino iban no number license licence account born contact page chapter version figure table section year order invoice room".split())

#: The labelled table. Each form is filled three times, with the pools' entries in turn; {name}, {tel} and {id} are labelled.
NAMES = (
    "John Smith", "Maria Lopez", "Chen", "Anna-Lena Weber", "Sean O'Brien", "Peter J. Novak", "Ivanova", "Li Wei", "Omar Hassan", "Jean-Paul Roux",
    "Brown", "Priya Raghavan", "Tom Baker", "Fatima al-Sayed", "Ludwig van Dyck", "Grace Okafor", "Green", "Mary Ann Cole", "McAllister", "Diego Ruiz Vega",
)
TELS = (
    "(555) 201-4477", "555-201-4477", "020 7946 0958", "030 1234567", "415-555-0132", "0171 5550123", "(212) 555-0199", "555 0147", "1-800-555-0123", "01.42.68.53.00",
    "303.555.7788", "089/636-48018",
)
IDS = (
    "123-45-6789", "987-65-4321", "219-09-9999", "AB1234567", "X9876543", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "QQ123456C", "L1234567", "FR76 3000 6000 0112 3456 7890 189",
)
FORMS = (
    "Please contact Mr. {name} about the invoice.", "Mrs. {name} called yesterday and left a message.", "I spoke with Dr. {name} this morning.", "Dear Ms. {name}, thank you for your order.",
    "Prof. {name} teaches here on Mondays.", "My name is {name} and I live nearby.", "Her name: {name}", "The customer's name is {name}.", "Signed {name}", "Sincerely, {name}", "Best regards, {name}",
    "A man named {name} came in and asked for the key.", "Mr. {name} and Mrs. {name} left early.", "Dr. {name} said that the results were fine.", "Ms. {name} wrote to us about the delay.",
    "Ask for Mr. {name} or Ms. {name} at the desk.", "Contact: {name}, {tel}", "Contact {name} at {tel} with questions.", "Name: {name} Phone: {tel}", "Dear {name}, we have moved.", "Mr. {name} will see you at noon.",
    "The patient, Mrs. {name}, was sent home.", "It was Dr. {name} who found it first.", "a girl called {name} lived here", "Kind regards {name}", "Written by Prof. {name} in spring",
    "Phone {tel} for details.", "Call {tel} now.", "tel: {tel}", "Tel. {tel} or by mail.", "Our phone number is {tel}.", "mobile {tel}", "fax {tel}", "You can call {tel} after noon.", "Reach the office by phone at {tel} any time.",
    "dial {tel} to order", "call me on my cell, {tel}, tonight", "SSN {id} on file.", "His SSN is {id}.", "ssn: {id}", "Passport {id} expires soon.", "passport no. {id}", "IBAN {id} for the payment", "iban: {id}",
    "NINO {id} was given.", "id {id}", "license no. {id}", "Mr. {name}, passport number {id}, phone {tel}",
)
#: Text without personal data, much of it with the same cues, capitals and digits.
PLAIN = (
    "They left the house early. The day was cold and the road was empty.", "He paid 12 dollars for 3 books in 1999.", "See page 12 of chapter 4, figure 2.", "Version 3.2.1 came out in 2021.",
    "Order 66 was shipped on 2023-05-17 to the Main Street shop.", "It costs 1,200.50 and weighs 12 kg.", "Section 4.1 and Table 7 list all 350 items.", "The New York office opened in May 2003.",
    "Between 1914 and 1918 the prices rose by 25%.", "Room 101, floor 3.", "Written by the staff. From the start it was hard.", "By Monday all were back. They called the next day.", "The number of cases fell. No one knew.",
    "Number 5 is alive. Year 2000 came.", "Call the next one. Contact the office. Dear all, the page is up.", "Ah. Oh. Yes. No. So it goes. Then. Later. Here. There. Well.",
    "Old stones lay there. Rain. Wind. It was late. Night fell. Quiet.", "A day. Two. Three more. Up the hill. Down. On and on. Next. More.", "He left. Soon. She stayed, alone. Snow. Ice melted. Spring. Green leaves.",
    "Far, far away. Long ago. Once, there was peace. Kings came. Queens ruled.", "BREAKING NEWS! ALL SEATS SOLD OUT! BOOK NOW!", "THIS IS LOUD. VERY LOUD! STOP. GO.", "a | red | Stone | blue | Sky | over | The | hills | Green |",
    "Second-hand goods, half-price. Third. O'Clock; fourth: fifth.", "It is (of course) a test... Well? Yes! Perhaps - or not - who knows.", "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "The phone rang. The account was closed. Names are hard.", "The ID card is blue, the passport is red.", "A license number has eight signs, an account number ten.",
    "Open a passport office account online or call us any day.", "Name the file first, then press Enter. The name is shown in the list.", "The company's name was changed in 1987 to Northern Rail.", "Dear Sir or Madam, please find the report enclosed.",
    "Dear customer, your order number 48213 has left.", "Sincerely, The Team", "Regards from the coast. Signed and sealed, it was sent on 4 June 2011.", "Dr. and Mrs. are titles. Mr. is one too. Ms. also is.",
    "Born in 1950, closed in 2004, the mill is a museum.", "Total: 1,024 units (512 x 2) at 3.50 each.", "On 12/05/2021 at 10:45 the train 1184 left from track 7.", "ISBN 978-3-16-148410-0, 240 pages, 19.99", "Part no. 300-114-22 fits model 88-A.",
    "The ratio was 16:9, later 4:3. In 16 of 20 runs it failed.", "Tickets from 12-15 dollars, rooms from 80-120.", "Flight LH 456 lands at 18:20 in Los Angeles.", "Tel Aviv and San Francisco are cities. Cell walls are thick.",
    "The fax machine broke. The mobile app is new. Dial tone lost.", "Professor means teacher. Named pipes are fast. Called twice, it returns once.", "if x > 10 and y < 20: return x * 100", "int main(void) { return 0; }  // version 2",
    "Die Tage waren kurz und das Licht war grau. Niemand kam.", "Il faisait froid ce matin. Les rues sont vides. La mer est loin.", "El agua estaba clara. No vino nadie. Los campos son grandes.", "Chapter One. The Long Road. Part Two: Home Again.",
    "Monday, March 4. Tuesday, April 12. Sunday.", "The United Nations met in Geneva. The Red Cross sent help to Haiti.", "Mount Everest is 8,849 m high; the Nile is 6,650 km long.", "## Heading ** bold ** and * list * of things | cells |",
    "Press Ctrl+C, then F5. Use Ms. Office? No: use the Excel sheet.", "100 200 300 400 500 600", "3.14159 2.71828 1.41421", "Q1 2020, Q2 2020 and H1 2021 were weak.", "Win 5,000 points! Code SAVE20 ends 31 Dec.",
    "Home News Sport Weather Shop Travel Culture Music Food Games Radio Video More Menu Search Help About Careers Privacy Terms Sitemap", "A Short Guide To Growing Roses And Herbs In Small Town Gardens",
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday", "Red Red Red Red Red Red Red Red Red Blue Blue Blue Blue Blue Blue green green", "Buy Buy Buy Buy Buy Buy Buy Buy Buy Buy Buy now and save.",
    "How The West Coast Lost Its Old Harbour Towns And What Came After The Great Storm Of Last Winter", "It ended. Was Was Was Was Was Was Was Was Was it so?", "Le Petit Journal Du Matin Et Du Soir Pour Tous Les Gens", "The End The End The End The End The End",
    "Alabama Alaska Arizona Arkansas California Colorado Connecticut Delaware Florida Georgia Hawaii Idaho Illinois Indiana Iowa Kansas",
)


def labelled() -> list[str]:
    """Lines of text with {label words} around personal data."""
    pools = {"name": list(NAMES), "tel": list(TELS), "id": list(IDS)}

    def slot(m: re.Match) -> str:
        pool = pools[m[1]]
        pool.append(pool.pop(0))
        return "{" + m[1] + " " + pool[-1] + "}"

    return [re.sub(r"\{(\w+)\}", slot, form) for _ in range(3) for form in FORMS] + list(PLAIN)


def shape(word: bytes) -> str:
    """The cue word, or runs of letters by case, digits one by one up to five, and other ASCII signs as they are."""
    text = word.decode()
    bare = text.strip(".,;:!?\"'()[]").lower()
    if bare in CUES:
        return bare
    if len(text) > 24:
        return "long" + ("d" if any(c.isdigit() for c in text) else "")
    out = []
    for c in text:
        k = "X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c if c < "\x7f" else "?"
        if k == "d" and out[-5:] == ["d"] * 5 or k in "Xx?" and out[-1:] == [k]:
            continue
        out.append(k)
    return "".join(out)


def coarse(s: str) -> str:
    return "<" + "".join(k for k in "Xxd" if k in s) + ("+" if any(c not in "Xxd" for c in s) else "") + ">"


class Field:
    """The random field: weights by shape and place in the window, and transitions."""

    def __init__(self, shapes: dict[str, int], unary: np.ndarray, moves: np.ndarray):
        self.shapes, self.unary, self.moves = shapes, unary, moves
        self.memo: dict[bytes, int] = {}

    def feature(self, word: bytes) -> int:
        if (f := self.memo.get(word)) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            s = shape(word)
            f = self.memo[word] = self.shapes.get(s, self.shapes.get(coarse(s), 0))
        return f

    def scores(self, f: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(words, labels); ``first`` and ``last`` give for each word the bounds of its line."""
        at = np.arange(len(f))
        out = np.zeros((len(f), len(LABELS)), np.float32)
        for k, d in enumerate(WINDOW):
            to = at + d
            inside = (to >= first) & (to < last)
            out += self.unary[k][np.where(inside, f[np.where(inside, to, 0)], 1)]
        return out

    def decode(self, f: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The likeliest label of every word of these lines, laid end to end."""
        ends = np.cumsum(lengths)
        starts = ends - lengths
        u = self.scores(f, np.repeat(starts, lengths), np.repeat(ends, lengths))
        order = np.argsort(-lengths, kind="stable")
        start, size = starts[order], lengths[order]
        running = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        back = np.zeros((len(f), len(LABELS)), np.int8)
        first = self.moves[0] * 0 + np.where([x.startswith("I") for x in LABELS], -1e4, 0).astype(np.float32)
        best = np.zeros((len(size), len(LABELS)), np.float32)
        for t, n in enumerate(running.tolist()):
            at = start[:n] + t
            if t == 0:
                best[:n] = u[at] + first
                continue
            step = best[:n, :, None] + self.moves[None]
            back[at] = step.argmax(1)
            best[:n] = step.max(1) + u[at]
        out = np.zeros(len(f), np.int8)
        now = best.argmax(1)
        for t in range(len(running) - 1, -1, -1):
            n = running[t]
            at = start[:n] + t
            out[at] = now[:n]
            if t:
                now[:n] = back[at, now[:n]]
        return out


def table() -> list[tuple[list[bytes], list[int]]]:
    out = []
    for line in labelled():
        words, labels = [], []
        for part in re.findall(r"\{(\w+) ([^}]*)\}([^\s{]*)|([^\s{]+)", line):
            if part[0]:
                own = (part[1] + part[2]).split()
                words += own
                labels += [LABELS.index("B-" + part[0])] + [LABELS.index("I-" + part[0])] * (len(own) - 1)
            else:
                words.append(part[3])
                labels.append(0)
        out.append(([w.encode() for w in words], labels))
    return out


def gradient(unary: np.ndarray, moves: np.ndarray, f: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the labels and its gradients, by the forward and backward sums of all lines at once.

    ``f`` (places of the window, lines, words) holds features, ``y`` labels, and ``real`` tells words from padding.
    """
    total = lambda x, axis: np.log(np.exp(x - (top := x.max(axis, keepdims=True))).sum(axis)) + top.squeeze(axis)
    u = sum(unary[k][f[k]] for k in range(len(f)))
    ahead, behind = u.copy(), np.zeros_like(u)
    n = u.shape[1]
    for t in range(1, n):
        ahead[:, t] = np.where(real[:, t, None], u[:, t] + total(ahead[:, t - 1, :, None] + moves, 1), ahead[:, t - 1])
    for t in range(n - 2, -1, -1):
        behind[:, t] = np.where(real[:, t + 1, None], total(moves + (u[:, t + 1] + behind[:, t + 1])[:, None], 2), 0)
    z = total(ahead[:, -1], 1)
    at, word = np.nonzero(real)
    missed = -np.exp(ahead + behind - z[:, None, None])[at, word]
    score = u[at, word, y[at, word]].sum() - z.sum()
    missed[np.arange(len(at)), y[at, word]] += 1
    du, dm = np.zeros_like(unary), np.zeros_like(moves)
    for k in range(len(f)):
        np.add.at(du[k], f[k][at, word], missed)
    for t in range(1, n):
        on = real[:, t]
        dm -= np.exp(ahead[on, t - 1, :, None] + moves + (u[on, t] + behind[on, t])[:, None] - z[on, None, None]).sum(0)
        np.add.at(dm, (y[on, t - 1], y[on, t]), 1)
        score += moves[y[on, t - 1], y[on, t]].sum()
    return float(score), du, dm


def padded(data: list[tuple[list[bytes], list[int]]], shapes: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features in the window, labels and which words are real; each line also by coarse shapes, for shapes that the table lacks."""
    lines = [([shapes[x if x in CUES else level(x)] for x in map(shape, words)], labels) for words, labels in data for level in (str, coarse)]
    n = max(len(y) for _, y in lines)
    f, y, real = np.ones((len(WINDOW), len(lines), n), np.int64), np.zeros((len(lines), n), np.int64), np.zeros((len(lines), n), bool)
    for i, (own, labels) in enumerate(lines):
        y[i, : len(own)], real[i, : len(own)] = labels, True
        for k, d in enumerate(WINDOW):
            f[k, i, : len(own)] = [own[j + d] if 0 <= j + d < len(own) else 1 for j in range(len(own))]
    return f, y, real


@lru_cache(1)
def trained(turns: int = 150, rate: float = 0.2, decay: float = 0.01) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Shapes, unary weights and transitions of greatest penalised likelihood on the labelled table."""
    data = table()
    shapes = {"": 0, "<edge>": 1}
    for words, _ in data:
        for w in words:
            for s in (shape(w), coarse(shape(w))):
                shapes.setdefault(s, len(shapes))
    n = len(LABELS)
    unary, moves = np.zeros((len(WINDOW), len(shapes), n)), np.zeros((n, n))
    lines = padded(data, shapes)
    seen: list[np.ndarray] = [np.zeros_like(unary), np.zeros_like(moves)]
    for _ in range(turns):
        _, du, dm = gradient(unary, moves, *lines)
        for x, d, g in ((unary, du - decay * unary, seen[0]), (moves, dm - decay * moves, seen[1])):
            g += d * d
            x += rate * d / (np.sqrt(g) + 1e-8)
    for i, a in enumerate(LABELS):
        for j, b in enumerate(LABELS):
            if b.startswith("I-") and a[1:] != b[1:]:
                moves[i, j] = -1e4
    return shapes, unary.astype(np.float32), moves.astype(np.float32)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fixed(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = []
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, begin, end := m.end()))
        at = max(at + 1, end)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def context(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the random field finds in each text."""
    features: list[int] = []
    lengths: list[int] = []
    bounds = [0]
    feature = field.feature
    for text in texts:
        for line in text.encode().split(b"\n"):
            if words := line.split():
                features += map(feature, words)
                lengths.append(len(words))
        bounds.append(len(features))
    labels = field.decode(np.array(features, np.int64), np.array(lengths, np.int64))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hits = np.unique(np.searchsorted(bounds, np.flatnonzero(labels), side="right") - 1)
    for i in hits.tolist():
        own = labels[bounds[i] : bounds[i + 1]].tolist()
        places = [m.span() for m in WORD.finditer(texts[i])]
        k = 0
        while k < len(own):
            if not own[k]:
                k += 1
                continue
            begin, kind = k, (own[k] - 1) // 2
            k += 1
            while k < len(own) and own[k] == 2 * kind + 2:
                k += 1
            a, b = places[begin][0], places[k - 1][1]
            piece = texts[i][a:b]
            a += len(piece) - len(piece.lstrip(".,;:!?\"'[{"))
            b -= len(piece) - len(piece.rstrip(".,;:!?\"']}"))
            if a < b:
                out[i].append((BASE + kind, a, b))
    return out


def found(texts: list[str], field: Field) -> list[list[tuple[int, int, int]]]:
    """All spans; those of the random field that touch a fixed one are left out."""
    out = []
    for text, more in zip(texts, context(texts, field)):
        base = fixed(text)
        taken = sorted((a, b) for _, a, b in base)
        more = [x for x in more if not any(a < x[2] and x[1] < b for a, b in taken)] if more and taken else more
        out.append(sorted(base + more))
    return out


def line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span (or run of spans that overlap) replaced by its kind in brackets."""
    parts, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def worker(model, mode: str, new: str = "") -> Callable[[list[str]], dict[str, list]]:
    field = Field(*model)

    def work(texts: list[str]) -> dict[str, list]:
        spans = found(texts, field)
        if mode == "redact":
            return {new: [redacted(t, s) if s else t for t, s in zip(texts, spans)]}
        got: dict[str, list] = {f"n_{KINDS[i]}": [sum(k == i for k, _, _ in s) for s in spans] for i in range(len(KINDS))}
        got["base_sha256"] = [hashlib.sha256(line([x for x in s if x[0] < BASE]).encode()).hexdigest() for s in spans]
        got["spans"] = [line(s) for s in spans]
        return got

    return work


FIELDS = "n_email long, n_ip long, n_card long, n_phone long, n_name long, n_tel long, n_id long, base_sha256 string, spans string"


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add counts by kind, base_sha256 and spans (kind:start:end by kind, then start).

    Null and empty texts have none; repeated rows are scanned each; an empty table stays empty;
    input columns with the names of added ones are replaced. The model is trained on the driver
    from the labelled table and sent with the tasks; its size does not depend on the data.
    """
    return map_texts(df, text, FIELDS, worker, trained(), "scan", keep=keep)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace what is found by its kind in brackets; a null text stays null, other columns stay as they are."""
    new = free("__redacted", df.columns)
    out = map_texts(df, text, f"{new} string", worker, trained(), "redact", new)
    body = F.when(F.col(f"`{text}`").isNotNull(), F.col(new)).alias(text)
    return out.select(*[body if c == text else F.col(f"`{c}`") for c in df.columns])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts, digests and spans. Nulls, ties and repeats as in ``scan``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
