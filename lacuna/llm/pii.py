"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation estimates
their reliabilities, and a span classifier trained on the resulting labels decides."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from datetime import date
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut

#: Kinds with a base pattern, then those that only the labelers find.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "birth", "name"]
LABELERS = ["check", "gazetteer", "context", "edges"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# forms that the base patterns don't know
WEAK = [
    (0, re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9_%+-]{2,64}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{2,63}\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z]{2,10}(?![A-Za-z0-9])")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Fa-f:])")),
    (3, re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")),
]
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{1,64}+(?:\x20dot\x20[A-Za-z0-9_%+-]{1,64}+){0,4}+\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{2,63}+){1,4}+(?![A-Za-z0-9])")
SHORT_IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{3,39}+(?![0-9A-Za-z:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DATE = re.compile(r"(?<![0-9A-Za-z./-])(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4}))(?![0-9A-Za-z/-])")
NAME = re.compile(r"(?<!\w)[A-Z][a-z\u00DF-\u00FF'-]{1,20}+(?:\x20[A-Z]\.)?(?:\x20[A-Z][a-z\u00DF-\u00FF'-]{1,24}+){1,2}+(?!\w)")
#: Lengths of IBANs by country, from the public registry.
IBAN_LENGTHS = {k[:2]: int(k[2:]) for k in "AD24 AE23 AT20 BE16 BG22 BR29 CH21 CY28 CZ24 DE22 DK18 EE20 ES24 FI18 FR27 GB22 GR27 HR21 HU28 IE22 IL23 IS26 IT27 LI21 LT20 LU20 LV21 MC27 MT31 NL18 NO15 PL28 PT25 RO24 SA24 SE24 SI19 SK24 TR26".split()}
#: Words that make "at ... dot ..." prose, and endings that are words of English, too.
PROSE = frozenset("a an any each every her his its my no one our some that the their this your".split())
WORDS = frozenset("at be in it no us".split())
#: Gazetteers: given names, words that names don't hold, last parts of domains, calling codes.
GIVEN = frozenset(
    """Adam Alan Albert Alexander Alice Amanda Amy Andrea Andrew Angela Anna Anne Anthony Antonio Barbara Ben Benjamin Bernard Brian Carlos Carmen Carol Caroline Catherine Charles Christian Christine
    Christopher Claire Claudia Daniel David Deborah Diana Diego Donna Dorothy Edward Elena Elizabeth Emily Emma Eric Eva Fernando Francisco Frank Gary George Hannah Hans Heather Helen Helga Henry Isabel Jack
    Jacob James Jane Janet Jason Javier Jean Jennifer Jessica Joan John Jonathan Jorge Jose Joseph Joshua Juan Julia Julie Karen Karl Kathleen Kevin Klaus Laura Lauren Linda Lisa Lucas Lucia Luis Manuel
    Margaret Maria Marie Mark Martha Martin Mary Matthew Michael Michelle Miguel Monica Nancy Nathalie Nicholas Nicole Olivia Pablo Pamela Patricia Patrick Paul Pedro Peter Philip Pierre Rachel Rebecca Richard Robert
    Ruth Samuel Sandra Sarah Sharon Simon Sofia Sophie Stephen Steven Susan Theresa Thomas Timothy Ursula Victoria Virginia Walter William Wolfgang""".split()
)
NO_NAME = frozenset("Account Avenue Bank Board Center Centre City College Committee Company Corporation Council Customer Day Department Group Hotel House Institute Island Lake Limited Ltd Madam Manager Office Park Partner Police Reader River School Service Services Sir Square State Street Support Team The This University World".split())
ENDINGS = frozenset("com org net edu gov io info biz de fr es uk it nl eu us ca ch at be pl se no dk fi pt ru cn jp in br mx au example test".split())
CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 351 352 353 354 358 420 421 972".split())
CONTEXT = [
    re.compile(r"mail|contact|write|courriel|correo|schreib|reach", re.I),
    re.compile(r"\bip\b|host|server|address|addr|login from|dns|client", re.I),
    re.compile(r"card|visa|master|amex|credit|debit|carte|tarjeta|karte|payment", re.I),
    re.compile(r"phone|\btel|call|mobile|cell|fax|whatsapp|anruf|llam|appel|contact", re.I),
    re.compile(r"iban|account|bank|transfer|konto|compte|cuenta", re.I),
    re.compile(r"\bborn\b|birth|\bdob\b|geboren|\bgeb\.|naissance|\bnée?\b|nacid|nacimiento", re.I),
    re.compile(r"(?:\b(?:mr|mrs|ms|dr|prof|herr|frau|monsieur|madame|señora?|dear|signed|regards|patient|employee|name)[.:,]?\s{1,2}(?:is\s)?)$", re.I),
]
AGAINST = re.compile(r"version|release|isbn|issn|doi|order no|invoice|serial|\bv$|section|figure|table", re.I)
SPAN = "array<struct<kind:int,start:int,end:int,base:boolean,cell:int>>"


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of the base pattern, found from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def candidates(text: str) -> list[tuple[int, int, int, bool, int]]:
    """(kind, start, end, base, what the kind's own check says: against 0, nothing 1, for 2). Base spans are those
    of the base patterns that pass their checks; matches that fail are candidates too, which teach the labelers
    what is not personal data. Other candidates come from looser forms, gazetteers and context, and don't overlap
    a base span; an IBAN may, as its check digits are proof enough."""
    out = [(0, a, b, True, 2) for a, b in emails(text)]
    for m in IP.finditer(text):
        ok = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))
        out.append((1, *m.span(), ok, 2 * ok))
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start():
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) >= 12:
                ok = 14 <= len(digits) <= 19 and luhn(digits)
                out.append((2, *m.span(), ok, 2 * ok))
    for m in PHONE.finditer(text):
        ok = 10 <= sum(map(str.isdigit, m[0])) <= 15
        out.append((3, *m.span(), ok, 2 * ok))
    taken = covered([(a, b) for _, a, b, kept, _ in out if kept])

    def free(start: int, end: int) -> bool:
        at = bisect_right(taken, (end - 1, len(text))) - 1  # the last that begins before the span ends
        return at < 0 or taken[at][1] <= start

    for kind, pattern in WEAK:
        if kind == 0 and "at" not in text:
            continue
        more = [(kind, *m.span(), False, 2) for m in pattern.finditer(text) if free(*m.span())]
        taken = covered(taken + [(a, b) for _, a, b, _, _ in more])
        out += more
    more = list(ibans(text))
    if " dot " in text and " at " in text:
        more += [(0, *m.span(), False, int(PROSE.isdisjoint(m[0].lower().split(" ")))) for m in SPELLED.finditer(text) if free(*m.span())]
    if "::" in text:
        more += [(1, *m.span(), False, address(m[0])) for m in SHORT_IP6.finditer(text) if "::" in m[0] and free(*m.span())]
    more += [(5, *m.span(), False, int(real_day(m))) for m in DATE.finditer(text) if free(*m.span())]
    for m in NAME.finditer(text):
        words = m[0].split(" ")
        if (words[0] in GIVEN or CONTEXT[6].search(text, max(0, m.start() - 40), m.start())) and free(*m.span()):
            more.append((6, *m.span(), False, int(NO_NAME.isdisjoint(words))))
    return out + more


def ibans(text: str) -> Iterator[tuple[int, int, int, bool, int]]:
    """Candidates of the kind iban; where the country's length is known the rest of a match, a word behind it, is cut off."""
    for m in IBAN.finditer(text):
        s, length = m[0], IBAN_LENGTHS.get(m[0][:2], 0)
        places = [i for i, c in enumerate(s) if c != " "]
        if 0 < length < len(places) and s[places[length] - 1] == " ":
            s = s[: places[length - 1] + 1]
        plain = s.replace(" ", "")
        yield 4, m.start(), m.start() + len(s), False, 2 * (int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1)


def address(s: str) -> int:
    """What the check says of a shortened IPv6 address: against words between colons (a::b), nothing on two short numbers (3::4)."""
    try:
        return IPv6Address(s) is not None and any(c.isdigit() for c in s) and 1 + (len(re.findall("[0-9A-Fa-f]+", s)) > 2)
    except AddressValueError:
        return 0


def real_day(m: re.Match) -> bool:
    """Whether a match of DATE is a day of the calendar, day or month first."""
    y, a, b = (int(x) for x in (m[1] or m[6], m[2] or m[5], m[3] or m[4]))
    for month, day in ((a, b), (b, a)):
        try:
            return date(y, month, day) is not None
        except ValueError:
            if m[1]:
                return False
    return False


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def votes(text: str, kind: int, start: int, end: int, well: int) -> int:
    """The cell of a span: what four labelers say (against 0, nothing 1, for 2), its length and its
    neighbours, packed. Labelers: the pattern's own checks; gazetteer; words before it; edges."""
    s, before = text[start:end], text[max(0, start - 40) : start]
    digits = re.sub(r"\D", "", s)
    if kind == 0:
        ending = re.split("[.\\x20\\])]", s.rstrip("])"))[-1].lower()
        known = 2 if ending in ENDINGS and not (ending in WORDS and " dot " in s) else 1
    elif kind == 1:
        head = re.split("[.:]", s)[0]
        if ":" in s:  # global, local and link-local ranges, the loopback
            known = 2 if s == "::1" or re.match("[23][0-9a-f]{3}$|f[cd][0-9a-f]{2}$|fe[89ab][0-9a-f]$", head.lower()) else 1
        else:
            known = 2 if 1 <= int(head[:6]) <= 223 else 0
    elif kind == 2:
        known = 2 if digits[:1] in ("3", "4", "5", "6") else 0
    elif kind == 3:
        known = 2 if any(digits[:n] in CODES for n in (1, 2, 3)) else 1
    elif kind == 4:
        known = 1 if s[:2] not in IBAN_LENGTHS else 2 if len(s.replace(" ", "")) == IBAN_LENGTHS[s[:2]] else 0
    elif kind == 5:
        year = int(s[:4] if s[4] == "-" else s[-4:])
        known = 1 if 1900 <= year <= 2100 else 0
    else:
        known = 2 if s.split(" ")[0] in GIVEN else 1
    said = 0 if AGAINST.search(before) else 2 if CONTEXT[kind].search(before) else 0 if kind == 5 else 1  # most dates are no birth dates
    left, right = text[start - 1 : start], text[end : end + 1]
    shape = lambda c: 0 if not c or c.isspace() else 2 if c.isalnum() else 1
    edges = 0 if 2 in (shape(left), shape(right)) else 2 if shape(left) == 0 else 1
    size = min(3, (end - start) // 10)
    return (((((well * 3 + known) * 3 + said) * 3 + edges) * 4 + size) * 3 + shape(left)) * 3 + shape(right)


def unpack(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells -> votes (n x 4) and the classifier's indicator features."""
    right, rest = cell % 3, cell // 3
    left, rest = rest % 3, rest // 3
    size, rest = rest % 4, rest // 4
    four = np.stack([rest // 27, rest // 9 % 3, rest // 3 % 3, rest % 3], axis=1)
    one = lambda x, n: np.eye(n)[x]
    return four, np.hstack([*[one(four[:, k], 3) for k in range(4)], one(size, 4), one(left, 3), one(right, 3), np.ones((len(cell), 1))])


def estimate(four: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over a two-class model in which labelers vote independently given the truth;
    rows are vote patterns with their counts. Starts from the majority; returns P(true) of each row and
    P(vote | truth, labeler), of shape truth x labelers x votes. A labeler that votes alike on all candidates tells
    them not apart: it has its say at the start only, else it would pull all of them into one class. The share of true ones is held halfway to that of the start,
    as candidates of which one labeler alone tells anything don't fix it."""
    lean = (four - 1.0).sum(1)
    p = 1 / (1 + np.exp(-1.5 * (lean - 0.5)))
    first = p
    given = np.zeros((2, four.shape[1], 3))
    varies = np.ptp(four, axis=0) > 0
    for _ in range(rounds):
        share = np.clip(((p + first) / 2 * n).sum() / n.sum(), 0.01, 0.99)
        log = np.tile(np.log([1 - share, share]), (len(four), 1))
        for k in range(four.shape[1]):
            for c, w in ((0, (1 - p) * n), (1, p * n)):
                prior = np.array([2.0, 1.0, 0.5] if c == 0 else [0.5, 1.0, 2.0])  # labelers are better than chance
                f = np.bincount(four[:, k], weights=w, minlength=3) + prior
                given[c, k] = f / f.sum()
                log[:, c] += varies[k] * np.log(given[c, k])[four[:, k]]
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return p, given


def reliabilities(four: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """P(true) of each row by estimate()."""
    return estimate(four, n, rounds)[0]


def train(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels with counts as weights, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (q - p)) + ridge * w
        h = (x * (n * q * (1 - q) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans: array of kind, start, end, base, cell) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                t = t or ""
                out.append([{"kind": k, "start": a, "end": e, "base": base, "cell": votes(t, k, a, e, well)} for k, a, e, base, well in candidates(t)])
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": out})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def fit(spans: DataFrame) -> tuple[dict[tuple[int, int], float], dict[int, np.ndarray]]:
    """From find_spans()'s rows: the classifier's probability of each (kind, cell), and each kind's P(vote | truth, labeler)."""
    cells = spans.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.cell").agg(F.count("*").alias("n")).toPandas()
    chance: dict[tuple[int, int], float] = {}
    given: dict[int, np.ndarray] = {}
    for kind, own in cells.groupby("kind"):
        cell, n = own["cell"].to_numpy(), own["n"].to_numpy(dtype=float)
        order = np.argsort(cell)
        cell, n = cell[order], n[order]
        four, x = unpack(cell)
        p, given[int(kind)] = estimate(four, n)
        w = train(x, p, n)
        chance |= {(int(kind), int(c)): float(q) for c, q in zip(cell, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True)}
    return chance, given


def labelers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kind, labeler, truth, vote, share): how often each labeler votes against (0), not at all (1) or for (2) a span
    that is none or is one (truth), as estimated on docs. Kinds without a candidate have no rows."""
    _, given = fit(find_spans(docs, id_col, text_col))
    rows = [(KINDS[k], LABELERS[j], bool(c), v, float(g[c, j, v])) for k, g in sorted(given.items()) for c in (0, 1) for j in range(len(LABELERS)) for v in range(3)]
    return docs.sparkSession.createDataFrame(rows, "kind string, labeler string, truth boolean, vote int, share double")


def stays(kind: int, cell: int, base: bool, chance: float, accept: float) -> bool:
    """Base spans always stay. Another candidate needs the classifier's `accept`, a check that didn't fail (digits,
    range, Luhn, calendar), and, where its kind has no check that proves it, a vote of gazetteer or context."""
    well, known, said = cell // 972, cell // 324 % 3, cell // 108 % 3
    return base or chance >= accept and well > 0 and (well == 2 or 2 in (known, said))


def detect(docs: DataFrame, accept: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found) of every row of docs; found is an array of (kind, start, end, base, probability) by
    start, then kind; offsets in code points, end exclusive.

    Kinds: those of the base patterns, also in other forms (spelled-out addresses, IPv6, phones without a plus), and
    iban, birth (dates that context calls birth dates) and name (behind a title or with a given name of the gazetteer).
    Whole texts are scanned once. Vote patterns and features are counted over all candidates of the corpus;
    the table of counts has at most a few thousand cells whatever the input, and only it comes to the driver,
    where reliabilities and the classifier are fitted. Base spans always stay; another candidate stays if the
    classifier gives it at least `accept` (see stays()). Null and empty texts have no spans. Repeated rows give repeated
    results; null ids pass through; other columns are ignored; an empty table gives no rows.
    """
    spans = cut(find_spans(docs, id_col, text_col))
    chance, _ = fit(spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for spans in b["spans"]:
                kept = [(s["start"], s["kind"], s["end"], s["base"], round(chance[s["kind"], s["cell"]], 6)) for s in spans if stays(s["kind"], s["cell"], s["base"], chance[s["kind"], s["cell"]], accept)]
                kept.sort()
                out.append([{"kind": KINDS[k], "start": a, "end": e, "base": base, "probability": q} for a, k, e, base, q in kept])
            yield pd.DataFrame({"doc_id": b["doc_id"], "found": out})

    kind = spans.schema["doc_id"].dataType.simpleString()
    return spans.mapInPandas(run, f"doc_id {kind}, found array<struct<kind:string,start:int,end:int,base:boolean,probability:double>>")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of detect()'s rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for spans in b["found"]:
                said = [(s["base"], s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                base = ",".join(x for kept, _, x in said if kept)
                rows.append([*[sum(kept and k == kind for kept, k, _ in said) for kind in BASE], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for *_, x in said), len(said)])
            yield pd.DataFrame(rows, columns=names).assign(doc_id=b["doc_id"].to_numpy())[["doc_id", *names]]

    names = [*[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"]
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
