"""Personal data by patterns and a character BiLSTM-CRF trained in numpy (operator 5)."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import give_back, mix
from .store import fresh, ship, table

KINDS = ("email", "ip", "card", "phone")
#: Documents whose pattern spans train the model, at most, chosen by a hash of their id.
TRAIN_DOCS = 1_500
#: Training windows at most, and labelled spans of each kind at least (values are made up where the documents have fewer).
TRAIN_WINDOWS, LEAST_SPANS = 4_000, 250
WINDOW, STRIDE, HIDDEN = 64, 32, 32
#: Characters around a hint that the model reads, and how far from there on to the next blank.
MARGIN, REACH = 32, 64
#: Windows that are decoded at once; a worker holds about 0.13 MB for each.
DECODED = 256
#: Mean probability of its tags that a span of the model must have.
SCORE = 0.9
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
#: What some printed form of every kind has: digits and at-signs, full-width too, or a spelt-out dot or at in brackets.
_SEEN = re.compile(r"[0-9@\uff10-\uff19\uff20]|\bdot\b|[\[(]at[\])]")
#: What continues a domain whose dots are spelt out.
_MORE = re.compile(r"(?: dot |\x20?\[dot\]\x20?|\(dot\)| \. )[A-Za-z0-9-]+")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CHARS = 130  # ASCII, anything else, and the filling of short windows


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap, in time linear in the text: each starts at its @'s run of local characters."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind, then start; code points, end exclusive."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    if _HINT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def regions(text: str, margin: int = MARGIN) -> list[tuple[int, int]]:
    """Stretches within `margin` of a hint, and on to the next blank that is near."""
    out: list[list[int]] = []
    for m in _SEEN.finditer(text):
        if out and m.end() + margin <= out[-1][1]:
            continue
        a, b = max(0, m.start() - margin), min(len(text), m.end() + margin)
        blank = text.rfind(" ", max(0, a - REACH), a)
        a = blank + 1 if blank >= 0 else max(0, a - REACH)
        blank = text.find(" ", b, b + REACH)
        b = blank if blank >= 0 else min(len(text), b + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


# Printed forms that the patterns miss, for training and for tests

_WIDE = str.maketrans({**{str(d): chr(0xFF10 + d) for d in range(10)}, "@": "\uff20"})


def made_value(kind: int, r: np.random.Generator) -> str:
    """A value of a kind in the form that the patterns know."""
    n = lambda low, high: int(r.integers(low, high))
    word = lambda: "".join(chr(97 + n(0, 26)) for _ in range(n(3, 9)))
    if kind == 0:
        return f"{word()}{'.' + word() if n(0, 2) else ''}{n(1, 99) if n(0, 2) else ''}@{word()}.{('com', 'org', 'net', 'de', 'fr', 'es')[n(0, 6)]}"
    if kind == 1:
        return ".".join(str(n(0, 256)) for _ in range(4))
    if kind == 2:
        digits = "".join(str(n(0, 10)) for _ in range(15))
        return next(digits + str(c) for c in range(10) if luhn(digits + str(c)))
    return f"+{n(1, 99)} {n(10, 999)} {n(100, 9999)} {n(1000, 99999)}"


def rewritten(kind: int, value: str, r: np.random.Generator) -> str:
    """The value in a printed form that the patterns miss."""
    turn = int(r.integers(0, 5))
    if turn == 4:
        return value.translate(_WIDE)
    if kind == 0:
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", " . "))[turn]
        local, domain = value.split("@", 1)
        return local.replace(".", dot) + at + domain.replace(".", dot)
    if kind == 1:
        return value.replace(".", ("[.]", " . ", " dot ", "(.)")[turn])
    digits = re.sub("[^0-9]", "", value)
    if kind == 2:
        return (".", "/", "_", " - ")[turn].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    rest = digits[2:]
    return (f"0{rest[:3]}/{rest[3:]}", f"00{digits[:2]} {rest[:3]} {rest[3:]}", f"(0{rest[:2]}) {rest[2:5]}-{rest[5:]}", f"0{rest[:2]}.{rest[2:5]}.{rest[5:]}")[turn]


def decoy(r: np.random.Generator) -> str:
    """Digits that are no personal data: dates, times, amounts, versions, counts and longer numbers."""
    n = lambda low, high: int(r.integers(low, high))
    long = "".join(str(n(0, 10)) for _ in range(n(13, 17)))
    return (
        f"{n(1, 29)}.{n(1, 13)}.{n(1950, 2030)}", f"{n(1950, 2030)}-{n(10, 13)}-{n(10, 29)}", f"{n(1, 13)}/{n(1, 29)}/{n(1950, 2030)}", f"{n(0, 24)}:{n(10, 60)}", f"{n(1, 999)},{n(10, 99)} EUR",
        f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}", f"{n(1, 100_000)}", f"{n(1, 999)} {n(100, 999)} {n(100, 999)}", long if not luhn(long) else long[:9], f"{n(1, 99)}-{n(1, 99)}", f"dot {n(1, 9)}", f"at {n(1, 99)} dot",
    )[n(0, 12)]


def labelled(pieces: list[str], seed: int = 0, least: int = LEAST_SPANS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts and labelled spans from stretches of documents: as they stand, and with values in printed forms that the patterns miss.

    Every pattern span is printed in another form in its place; where a kind has
    fewer than `least` spans, made-up values take the places of others or stand
    between words.  Every other one of these texts has digits that are no
    personal data.
    """
    r, out, places = np.random.default_rng(seed), [], []
    for t in pieces:
        spans = base_spans(t)
        clear = [s for s in spans if all(s is o or s[2] <= o[1] or o[2] <= s[1] for o in spans)]
        out.append((t, clear))
        places += [(t, clear, *s) for s in clear]
        if not spans and " " in t:
            places.append((t, [], -1, t.find(" ") + 1, t.find(" ") + 1))
    if not places:
        places = [("a  b", [], -1, 2, 2)]
    own = [[p for p in places if p[2] == k] for k in range(len(KINDS))]
    for kind in range(len(KINDS)):
        for k in range(max(least, min(len(own[kind]), 2 * least))):
            t, clear, was, a, b = own[kind][k] if k < len(own[kind]) else places[int(r.integers(0, len(places)))]
            value = t[a:b] if was == kind else made_value(kind, r)
            told, left, right = rewritten(kind, value, r), t[:a], t[b:]
            if was < 0:
                right = " " + right
            other = f"{decoy(r)} " if k % 2 else ""
            start = len(left) + len(other)
            moved = lambda d: [s if s[2] <= a else (s[0], s[1] + d, s[2] + d) for s in clear if s[2] <= a or s[1] >= b]  # noqa: B023, E731
            out.append((left + other + told + right, sorted([*moved(start + len(told) - b + (was < 0)), (kind, start, start + len(told))])))
            if k % 4 == 0:
                plain = decoy(r)
                out.append((left + plain + right, moved(len(left) + len(plain) - b + (was < 0))))
    return out


def encode(piece: str) -> np.ndarray:
    codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
    return np.minimum(codes, 128).astype(np.int64)


class Tagger:
    """A bidirectional LSTM over characters with a CRF over tags, for windows of one length.

    Both directions run at once: arrays have an axis of 2, forward and backward.
    """

    def __init__(self, hidden: int = HIDDEN, seed: int = 0):
        r = np.random.default_rng(seed)
        h, k = hidden, len(TAGS)
        self.hidden = h
        self.p = {
            "x": (r.normal(size=(2, CHARS, 4 * h)) * 0.1).astype(np.float32),
            "h": (r.normal(size=(2, h, 4 * h)) / np.sqrt(h)).astype(np.float32),
            "c": np.tile(np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]), (2, 1, 1)).astype(np.float32),
            "o": (r.normal(size=(2 * h, k)) * 0.1).astype(np.float32),
            "ob": np.zeros(k, np.float32),
            "t": np.zeros((k, k), np.float32),
        }
        # an inside tag may only follow its own kind
        self.barred = np.array([[b.startswith("I") and a[2:] != b[2:] for b in TAGS] for a in TAGS])
        self.barred_first = np.array([b.startswith("I") for b in TAGS])

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of tags (T, B, K) for characters (T, B)."""
        h = self.hidden
        ways = np.stack([x, x[::-1]], 1)
        z_in = np.stack([self.p["x"][0][ways[:, 0]], self.p["x"][1][ways[:, 1]]], 1) + self.p["c"]
        out = np.zeros((len(x), 2, x.shape[1], h), np.float32)
        state, cell, steps = np.zeros_like(out[0]), np.zeros_like(out[0]), []
        for t in range(len(x)):
            z = z_in[t] + state @ self.p["h"]
            gates = np.tanh(z[..., : 3 * h] * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            new, before = np.tanh(z[..., 3 * h :]), cell
            cell = gates[..., h : 2 * h] * cell + gates[..., :h] * new
            bent = np.tanh(cell)
            if keep is not None:
                steps.append((gates, new, before, bent))
            state = gates[..., 2 * h :] * bent
            out[t] = state
        both = np.concatenate([out[:, 0], out[::-1, 1]], 2)
        if keep is not None:
            keep |= {"steps": steps, "states": out, "both": both, "ways": ways}
        return both @ self.p["o"] + self.p["ob"]

    def _scores(self) -> tuple[np.ndarray, np.ndarray]:
        return np.where(self.barred, -1e4, self.p["t"]), np.where(self.barred_first, -1e4, 0.0)

    def _sweep(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward sums (T, B, K) of emissions, log totals, transition weights, lifted emissions."""
        move, first = self._scores()
        go = np.exp(move)
        top = e.max(2, keepdims=True)
        lift = np.exp(e - top, dtype=np.float64)
        alpha, beta = np.zeros(lift.shape), np.ones(lift.shape)
        alpha[0] = np.exp(first) * lift[0]
        total = top.sum(0, dtype=np.float64)[:, 0]
        for t in range(len(e)):
            if t:
                alpha[t] = (alpha[t - 1] @ go) * lift[t]
            size = alpha[t].sum(1, keepdims=True)
            alpha[t] /= size
            total += np.log(size[:, 0])
        for t in range(len(e) - 2, -1, -1):
            beta[t] = (lift[t + 1] * beta[t + 1]) @ go.T
            beta[t] /= beta[t].sum(1, keepdims=True)
        return alpha, beta, total, go, lift

    def _crf(self, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log likelihood of tags y (T, B), its gradients to emissions and transitions."""
        move, first = self._scores()
        n, rows, k = e.shape[1], np.arange(e.shape[1]), e.shape[2]
        alpha, beta, total, go, lift = self._sweep(e)
        grad = alpha * beta
        grad /= grad.sum(2, keepdims=True)
        left, right = alpha[:-1].reshape(-1, k), (lift[1:] * beta[1:]).reshape(-1, k)
        size = ((left @ go) * right).sum(1, keepdims=True)
        moves = (left.T @ (right / size)) * go
        np.add.at(moves, (y[:-1].ravel(), y[1:].ravel()), -1)
        gold = first[y[0]] + e[np.arange(len(e))[:, None], rows, y].sum(0) + move[y[:-1], y[1:]].sum(0)
        grad[np.arange(len(e))[:, None], rows, y] -= 1
        moves[self.barred] = 0
        return float((total - gold).mean()), (grad / n).astype(np.float32), (moves / n).astype(np.float32)

    def _back(self, keep: dict, dout: np.ndarray, grads: dict) -> None:
        """Gradients from those of the states (T, 2, B, H), each direction in its own order."""
        h, steps = self.hidden, keep["steps"]
        back = self.p["h"].transpose(0, 2, 1).copy()
        dstate, dcell = np.zeros_like(dout[0]), np.zeros_like(dout[0])
        dz_all = np.zeros((*dout.shape[:3], 4 * h), np.float32)
        for t in range(len(steps) - 1, -1, -1):
            gates, new, before, bent = steps[t]
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            ds = dout[t] + dstate
            dcell = dcell + ds * o * (1 - bent**2)
            dz = dz_all[t]
            dz[..., :h] = dcell * new
            dz[..., h : 2 * h] = dcell * before
            dz[..., 2 * h : 3 * h] = ds * bent
            dz[..., : 3 * h] *= gates * (1 - gates)
            dz[..., 3 * h :] = dcell * i * (1 - new**2)
            dstate, dcell = dz @ back, dcell * f
        states = np.concatenate([np.zeros_like(keep["states"][:1]), keep["states"][:-1]])
        grads["c"] = dz_all.sum((0, 2))[:, None]
        for d in (0, 1):
            flat = dz_all[:, d].reshape(-1, 4 * h)
            grads["h"][d] = states[:, d].reshape(-1, h).T @ flat
            hot = np.zeros((len(flat), CHARS), np.float32)
            hot[np.arange(len(flat)), keep["ways"][:, d].ravel()] = 1
            grads["x"][d] = hot.T @ flat

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 48, rate: float = 0.03, seed: int = 0) -> list[float]:
        """Adam on windows x and tags y, both (N, T), its rate falling to a tenth; the mean loss of each epoch."""
        r, told = np.random.default_rng(seed), []
        m, v = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}
        step, steps = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            losses = []
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                own = order[at : at + batch]
                keep: dict = {}
                e = self.emissions(x[own].T, keep)
                loss, de, dt = self._crf(e, y[own].T)
                grads = {k: np.zeros_like(w) for k, w in self.p.items()}
                grads["t"], grads["ob"] = dt, de.sum((0, 1))
                grads["o"] = keep["both"].reshape(-1, 2 * self.hidden).T @ de.reshape(-1, len(TAGS))
                dboth = de @ self.p["o"].T
                self._back(keep, np.stack([dboth[:, :, : self.hidden], dboth[::-1, :, self.hidden :]], 1), grads)
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                losses.append(loss)
            told.append(float(np.mean(losses)))
        return told

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (N, T) of windows (N, T), and how probable each is; 1 throughout windows without a span."""
        move, first = self._scores()
        e = self.emissions(x.T)
        steps = len(e)
        best, back = first + e[0], np.zeros(e.shape, np.int8)
        for t in range(1, steps):
            options = best[:, :, None] + move
            back[t] = options.argmax(1)
            best = options.max(1) + e[t]
        out = np.zeros((steps, e.shape[1]), np.int8)
        out[-1] = best.argmax(1)
        rows = np.arange(e.shape[1])
        for t in range(steps - 1, 0, -1):
            out[t - 1] = back[t, rows, out[t]]
        sure = np.ones(out.shape, np.float32)
        some = np.flatnonzero(out.any(0))
        if len(some):
            p = self._marginals(e[:, some])
            sure[:, some] = np.take_along_axis(p, out[:, some, None].astype(np.int64), 2)[:, :, 0]
        return out.T, sure.T

    def _marginals(self, e: np.ndarray) -> np.ndarray:
        """Probability of every tag (T, B, K) from emissions."""
        alpha, beta, *_ = self._sweep(e)
        both = alpha * beta
        return both / both.sum(2, keepdims=True)


def windows(length: int) -> list[int]:
    """Starts of overlapping windows that cover a stretch."""
    return [0] if length <= WINDOW else [*range(0, length - WINDOW, STRIDE), length - WINDOW]


def filled(codes: np.ndarray, start: int) -> np.ndarray:
    out = np.full(WINDOW, CHARS - 1)
    own = codes[start : start + WINDOW]
    out[: len(own)] = own
    return out


def reconciled(tags: np.ndarray, starts: list[int], length: int) -> np.ndarray:
    """One value for each place of a stretch: of the window whose middle is nearest, the earlier at a tie."""
    first = np.array(starts)
    between = (first[1:] + first[:-1] + WINDOW) / 2
    nearest = np.searchsorted(between, np.arange(length) + 0.5)
    return tags[nearest, np.arange(length) - first[nearest]]


def tag_spans(tags: np.ndarray, offset: int) -> list[tuple[int, int, int]]:
    out, i = [], 0
    while i < len(tags):
        if not tags[i]:
            i += 1
            continue
        kind, start = (int(tags[i]) - 1) // 2, i
        i += 1
        while i < len(tags) and tags[i] == 2 * kind + 2:
            i += 1
        out.append((kind, offset + start, offset + i))
    return out


def plausible(kind: int, piece: str) -> bool:
    """What holds for a kind in whatever form it is printed: an at, four numbers below 256, Luhn's digit, 9 to 15 digits."""
    plain = unicodedata.normalize("NFKC", piece)
    digits = re.sub("[^0-9]", "", plain)
    if piece != piece.strip():
        return False
    if kind == 0:
        return re.search(r"@|\bat\b", plain) is not None and len(plain) >= 6
    if kind == 1:
        numbers = re.findall("[0-9]+", plain)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def model_spans(tagger: Tagger, texts: list[str], bases: list[list], score: float = SCORE) -> list[list[tuple[int, int, int]]]:
    """The spans that the tagger adds to each text's pattern spans: with tags of at least that probability, overlapping none of them."""
    jobs, rows = [], []
    for i, t in enumerate(texts):
        for a, b in regions(t):
            codes, starts = encode(t[a:b]), windows(b - a)
            jobs.append((i, a, b - a, starts, len(rows)))
            rows += [filled(codes, s) for s in starts]
    added: list[list] = [[] for _ in texts]
    if not rows:
        return added
    x = np.stack(rows)
    parts = [tagger.decode(x[k : k + DECODED]) for k in range(0, len(x), DECODED)]
    tags, sure = (np.concatenate(p) for p in zip(*parts, strict=True))
    for i, a, n, starts, at in jobs:
        if not tags[at : at + len(starts)].any():
            continue
        held = np.append(0, np.cumsum(reconciled(sure[at : at + len(starts)], starts, n)))
        for kind, s, e in tag_spans(reconciled(tags[at : at + len(starts)], starts, n), a):
            mean, t = (held[e - a] - held[s - a]) / (e - s), texts[i]
            # a number, a word or a spelt-out domain is never cut
            while e < len(t) and (t[e].isalnum() if kind == 0 else t[e].isdigit()):
                e += 1
            while kind == 0 and (more := _MORE.match(t, e)):
                e = more.end()
            while s and (t[s - 1] in _LOCAL or t[s - 1].isalnum() if kind == 0 else t[s - 1].isdigit()):
                s -= 1
            if mean < score or not plausible(kind, t[s:e]):
                continue
            if all(e <= bs or be <= s for _, bs, be in bases[i]) and all(e <= bs or be <= s for _, bs, be in added[i]):
                added[i].append((kind, s, e))
    return added


def training_windows(texts: list[tuple[str, list[tuple[int, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the stretches around hints, tagged by the labelled spans."""
    xs, ys = [], []
    for t, spans in texts:
        for a, b in regions(t):
            tags = np.zeros(b - a, np.int64)
            for kind, s, e in spans:
                if a <= s and e <= b and not tags[s - a : e - a].any():
                    tags[s - a] = 2 * kind + 1
                    tags[s - a + 1 : e - a] = 2 * kind + 2
            codes = encode(t[a:b])
            for s in windows(b - a):
                own = np.zeros(WINDOW, np.int64)
                own[: len(tags[s : s + WINDOW])] = tags[s : s + WINDOW]
                if own[0] and own[0] % 2 == 0:
                    cut = np.argmax(own != own[0]) or WINDOW
                    own[:cut] = 0  # the rest of a span that began before
                xs.append(filled(codes, s))
                ys.append(own)
    return np.array(xs, np.int64).reshape(-1, WINDOW), np.array(ys, np.int64).reshape(-1, WINDOW)


def picked(n: int, most: int) -> np.ndarray:
    """At most `most` of n places, by a hash of the place, in order."""
    return np.sort(np.argsort(mix(np.arange(n, dtype=np.uint64)), kind="stable")[:most])


def train(docs: DataFrame, most: int = TRAIN_DOCS, windows_most: int = TRAIN_WINDOWS, epochs: int = 12, stretches: int = 8, longest: int = 8 * WINDOW) -> Tagger:
    """Train on labelled spans in the stretches of about `most` documents with hints, chosen by a hash of their id.

    Spans are the patterns' own and those of `labelled`, in forms that the
    patterns miss.  The hash bound comes from the number of documents with
    hints, so no more than twice `most` documents' stretches come to the driver:
    of a document's first `stretches` those of at most `longest` characters.  At
    most `windows_most` windows are used, picked by a hash over all of them.
    """
    ship(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for k, t in zip(ids, batch.column(1).to_pylist(), strict=True):
                out.append((k, [t[a:b] for a, b in regions(t)[:stretches] if b - a <= longest]))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.string()))], names=["doc_id", "pieces"])

    luck = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(1 << 20))
    hinted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", luck.alias("luck")).where(F.col("text").rlike("[0-9@]"))
    # a histogram of at most 1024 bins gives the bound that about `most` rows meet
    bins = sorted((r.b, r.n) for r in hinted.groupBy(F.shiftright("luck", 10).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    bound, held = 0, 0
    for b, n in bins:
        if held and held + n > 2 * most:
            break
        bound, held = b + 1, held + n
        if held >= most:
            break
    rows = hinted.where(F.col("luck") < bound * 1024).select("doc_id", "text").mapInArrow(cut, "doc_id long, pieces array<string>").collect()
    rows.sort(key=lambda r: (mix(np.array([r.doc_id or 0], np.int64).view(np.uint64))[0], r.pieces))
    x, y = training_windows(labelled([p for r in rows[:most] for p in r.pieces]))
    tagger = Tagger()
    if rows and len(x):
        own = picked(len(x), windows_most)
        tagger.fit(x[own], y[own], epochs)
    return tagger


_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span as its kind's name; overlapping spans become one, named by the first."""
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= done:
            out += [text[done:s], f"<{KINDS[kind].upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame, tagger: Tagger, keep: list[str] | None = None, redact: bool = False, names: tuple[str, str] = ("base", "added")) -> DataFrame:
    """`keep` columns and two of the given `names`, base and added: arrays of (kind, start, end) spans of every whole text.

    `base` holds the patterns' spans, `added` the model's beside them; both by
    kind, then start.  With `redact` the text column is rewritten too.  A null
    text has no spans and stays null; empty texts have none; long texts are read
    whole; a null doc_id stays; repeated rows give a row each, an empty table
    none.  Columns that already have one of the `names` are replaced, all others
    stay.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kept = [c for c in (keep or docs.columns) if c not in names]

    def find(batches):
        give_back()
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            plain = [t or "" for t in texts]
            bases = [base_spans(t) for t in plain]
            added = [sorted(x) for x in model_spans(shared.value, plain, bases)]
            columns = [batch.column(i) for i in range(len(kept))]
            if redact:
                columns[kept.index("text")] = pa.array([t if not t else redacted(t, [*b, *a]) for t, b, a in zip(texts, bases, added, strict=True)], pa.string())
            lists = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in rows], _SPANS) for rows in (bases, added)]
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=[*kept, *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    span = "array<struct<kind:int,start:bigint,end:bigint>>"
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{c}` {span}" for c in names])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(fresh(docs.columns, "_text")[0])).mapInArrow(find, schema)


def _told(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, train(docs), keep=["doc_id"])
    # a second parameter of the lambda would be the place in the array
    of_kind = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")).cast("binary"), 256).alias("base_sha256"), _told(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
