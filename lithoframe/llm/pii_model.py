"""The boosted trees that select proposed personal-data spans: features, training examples, fit and calibration.

Everything here is small and driver-side: TRAIN_ROWS made-up examples, TREES trees of depth two. Scoring happens as a
Column expression in pii.py."""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: What proposals may be: the kinds above, and secrets (keys and tokens that stand behind their name).
PROPOSED_KINDS = (*KINDS, "secret")
FEATURES = ("kind", "digits", "length", "marks", "luhn", "context", "dated", "dots", "joined", "labels", "letters", "opens", "capitals")
#: What stands between the labels of a host name, and how national phone numbers begin.
DOT, OPENS = r"\.|[(\[{]dot[)\]}]|\x20dot\x20", r"^[0(]"
#: Words before a span that speak for personal data, and against it.
FOR = r"(?i)(?:phone|tel\b|tel[.:]|telef|call|mobile|fax|e-?mail|mail|contact|card|visa|credit|karte|tarjeta|carte|ip\b|host|server|address|whatsapp|sms)"
AGAINST = r"(?i)(?:version|\bv\.?$|release|isbn|issn|rfc|section|article|figure|table|order|invoice|serial|date|since|page|chapter|model|doi|total|score|build)"
DATED = r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2})"
CONTEXT = 30
TREES, RATE, TRAIN_ROWS, PRECISION = 40, 0.3, 6000, 0.98


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def features(kind: str | int, span: str, before: str, after: str) -> list[float]:
    digits = re.sub("[^0-9]", "", span)
    before = before[-CONTEXT:]
    return [
        float(PROPOSED_KINDS.index(kind) if isinstance(kind, str) else kind), float(len(digits)), float(len(span)), float(len(re.findall("[^0-9A-Za-z]", span))),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        1.0 if re.search(FOR, before) else -1.0 if re.search(AGAINST, before) else 0.0,
        float(bool(re.search(DATED, span))), float(span.count(".")),
        float(bool(re.search("[0-9A-Za-z]$", before)) or bool(re.search("^[0-9A-Za-z]", after))),
        float(len(re.findall(DOT, span))), float(len(re.findall("[A-Za-z]", span))), float(bool(re.search(OPENS, span))),
        float(len(re.findall("[A-Z]", span))),
    ]


def templates(r: random.Random) -> tuple[list[list], list[list]]:
    """(personal data, look-alikes) by kind: lists of makers of spans, each of one format."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    word = lambda a=3, b=9: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(a, b)))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-") for _ in range(k))
    year = lambda: str(r.randint(1900, 2030))

    def card(size: int = 16) -> str:
        body = r.choice("3456") + n(size - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    grouped = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
    seps = (".", "  ", "/", "_", " - ", "--")
    good = [
        [lambda: f"{word()}.{word()} (at) {word()} (dot) com", lambda: f"{word()}[at]{word()}.org", lambda: f"{word()}{n(2)}{{at}}{word()}{{dot}}net", lambda: f"{word()} at {word()} dot com", lambda: f"{word()}.{word()} at {word()} dot co dot uk", lambda: f"{word()}_{n(3)} [at] {word()}.{word()}.de"],
        [lambda: ":".join(h(4) for _ in range(8)), lambda: ":".join(h(r.randint(1, 4)) for _ in range(8)), lambda: f"2001:{h(3)}:{h(4)}::{h(4)}", lambda: f"fe80::{h(4)}:{h(4)}:{h(4)}:{h(4)}", lambda: f"{h(4)}:{h(2)}::{h(1)}", lambda: f"{h(4)}::{h(4)}:{h(3)}"],
        [lambda: grouped(card(), r.choice(seps[:2])), lambda: grouped(card(), r.choice(seps[2:4])), lambda: grouped(card(), seps[4][:2]), lambda: f"{(c := card(15))[:4]}/{c[4:10]}/{c[10:]}", lambda: grouped(card(), seps[5]), lambda: f"{(c := card(15))[:4]}.{c[4:10]}.{c[10:]}"],
        [lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"{n(3)}-{n(3)}-{n(4)}", lambda: f"{n(3)}.{n(3)}.{n(4)}", lambda: f"0{n(3)} {n(3)} {n(4)}", lambda: f"0{n(10)}", lambda: f"0{n(9)}"],
        [lambda: h(40), lambda: h(32), lambda: mixed(40), lambda: mixed(24), lambda: f"AKIA{mixed(16).upper()}", lambda: f"{mixed(12)}.{mixed(30)}"],
    ]
    bad = [
        [lambda: f"{word()}(at){word()}", lambda: f"{word()} [at] {n(2)}.{n(2)}", lambda: f"{word()} (at) {n(1)}", lambda: f"{word()} at {n(1)} dot {n(2)}"],
        [lambda: ":".join(n(2) for _ in range(8)), lambda: f"{n(2)}::{n(2)}", lambda: f"{word(3, 4)}::{word(3, 4)}", lambda: f"{n(1)}::{n(1)}"],
        [lambda: grouped(n(16), r.choice(seps)), lambda: grouped(n(16), seps[1]), lambda: f"{n(4)}/{n(6)}/{n(5)}", lambda: f"{year()}-{n(4)}-{n(4)}"],
        [lambda: f"{year()}-{n(3)}-{n(4)}", lambda: f"{year()} {n(3)} {n(3)}", lambda: f"{n(3)}.{n(3)}.{n(3)}", lambda: f"{n(2)}-{n(3)}-{n(3)}", lambda: f"{n(3)} {n(3)} {n(3)}", lambda: n(r.randint(9, 12))],
        [lambda: word(16, 30), lambda: f"{word()}.{word()}.{word()}.{word()}", lambda: f"{word()}_{word()}_{word()}_{word()}", lambda: "-" * r.randint(16, 40), lambda: "=" * r.randint(16, 30), lambda: "x" * r.randint(16, 30)],
    ]
    return good, bad


HINTS = (
    ("my email is ", "contact ", "mail: ", "reach me by e-mail, "), ("server ", "IP address ", "host ", "ip "), ("credit card ", "visa ", "my card: ", "carte "),
    ("phone: ", "call me at ", "tel. ", "mobile "), ('token = "', "password: ", "api_key=", "secret: '"),
)
WARNINGS = ("version ", "ISBN ", "order ", "serial ", "page ", "invoice no. ", "total ", "dated ")


def examples(rows: int = TRAIN_ROWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Made-up spans in context: features, whether they are personal data, and the number of their format. Real formats of odd
    numbers are held out from the fit; look-alikes and contexts are dealt by chance."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 9)))
    good, bad = templates(r)
    x, y, form = [], [], []
    for i in range(rows):
        kind, real = i % len(PROPOSED_KINDS), r.random() < 0.5
        made = (good if real else bad)[kind]
        at = r.randrange(len(made))
        span, lead = made[at](), r.random()
        told = r.choice(HINTS[kind]) if kind == 4 or lead < (0.95 if real else 0.03) else r.choice(WARNINGS) if lead < (0.96 if real else 0.6) else word() + " "
        x.append(features(PROPOSED_KINDS[kind], span, word() + " " + told, r.choice([" ", ".", ",", "\n", '" ']) + word()))
        y.append(float(real))
        form.append(at if real else r.randrange(2))
    return np.array(x), np.array(y), np.array(form)


def _split(x: np.ndarray, g: np.ndarray, rows: np.ndarray) -> tuple[int, float]:
    best = (-1.0, 0, -np.inf)
    for f in range(x.shape[1]):
        values = np.unique(x[rows, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = rows & (x[:, f] <= cut)
            a, b = left.sum(), rows.sum() - left.sum()
            gain = g[left].sum() ** 2 / a + g[rows & ~left].sum() ** 2 / b
            if gain > best[0]:
                best = (gain, f, cut)
    return best[1], best[2]


@lru_cache(maxsize=4)
def fitted(rows: int = TRAIN_ROWS, seed: int = 11) -> dict:
    """trees: (feature, cut, (feature, cut, leaf, leaf), (feature, cut, leaf, leaf)); thresholds: by kind, on the log-odds
    scale, the lowest that reaches PRECISION on formats held out; precision, and recall by kind: on these."""
    x, y, form = examples(rows, seed)
    fit, held = form % 2 == 0, form % 2 == 1
    xf, yf, score, trees = x[fit], y[fit], np.zeros(fit.sum()), []
    leaf = lambda m, g, h: float(RATE * g[m].sum() / (h[m].sum() + 1.0))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = yf - p, p * (1 - p)
        f, cut = _split(xf, g, np.ones(len(yf), bool))
        tree = [f, cut]
        for side in (xf[:, f] <= cut, xf[:, f] > cut):
            f2, cut2 = _split(xf, g, side)
            low, high = side & (xf[:, f2] <= cut2), side & (xf[:, f2] > cut2)
            tree.append((f2, cut2, leaf(low, g, h), leaf(high, g, h)))
            score += np.where(low, tree[-1][2], 0) + np.where(high, tree[-1][3], 0)
        trees.append(tuple(tree))
    s, yh, kinds = predict(trees, x[held]), y[held], x[held][:, 0]
    thresholds = []
    for k in range(len(PROPOSED_KINDS)):
        own, truth = s[kinds == k], yh[kinds == k]
        fine = [t for t in np.unique(own) if truth[own >= t].mean() >= PRECISION]
        thresholds.append(float(min(fine)) if fine else float("inf"))
    chosen = s >= np.array(thresholds)[kinds.astype(int)]
    recall = {name: float(chosen[(yh == 1) & (kinds == k)].mean()) for k, name in enumerate(PROPOSED_KINDS)}
    return {"trees": trees, "thresholds": thresholds, "precision": float(yh[chosen].mean()), "recall": recall}


def predict(trees: list, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for f, cut, low, high in trees:
        for side, (f2, cut2, a, b) in ((x[:, f] <= cut, low), (x[:, f] > cut, high)):
            out += np.where(side, np.where(x[:, f2] <= cut2, a, b), 0.0)
    return out
