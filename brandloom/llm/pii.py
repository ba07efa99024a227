"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The base spans are what the four patterns match and their checks accept; they always stay. The network reads characters by
class, in windows of WIDTH characters that overlap by half. It is trained in numpy from labelled spans in texts that a
seeded generator invents: contacts in many notations, spelled-out and spaced ones among them, and look-alikes (versions,
dates, keys, amounts, order numbers). Its weights are kept as a table in the shared folder, named by a digest of this file,
so that a cluster trains once.

Windows are reconciled over the whole text: the CRF's marginals of the two windows that cover a character are averaged, the
nearer to its window's middle counting the more, and the best tag sequence over these is found for each stretch that is more
likely tagged than not. So no span hangs on where a window cuts it, and none overlaps another. A span is added if every
character of it is sure (SURE or more for its kind), it doesn't overlap a base span, and its digits fit the kind (Luhn,
digit counts, parts of an address) or, of an email, there is an at and a dot after it. Nothing else is asked of it.

A window without a digit, an @ sign or a spelled-out one ("at" or "dot" in brackets or between spaces, with an end of a
host) is not decoded: no notation that the network learns lacks them all, and decoding all windows would take some 4,000 CPU
seconds a GB.

Edge cases: a null or empty text has no spans. Texts of any length are read whole, a block at a time. Repeated rows and null
ids are returned as they are; an empty table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept

KINDS = ("email", "ip", "card", "phone")
WIDTH = 96
SURE = 0.6
HIDDEN = 24
SAMPLES, EPOCHS, BATCH, RATE = 8_000, 9, 100, 0.02

# The base patterns. Possessive repeats and the look-behinds only keep the search linear; they match the same spans.
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_host = re.compile(r"(?i)(?:@|\bat\b).*(?:\.|\bdot\b)")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def passes(kind: str, text: str) -> bool:
    if kind == "ip":
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in parts)
    if kind == "card":
        digits = _digits(text)
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_digits(text)) <= 15
    return _host.search(text) is not None


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@label(.label)+, found from the @ signs."""
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        local = text[low:at]
        begin = low + len(local.rstrip(_LOCAL))
        match = _domain.match(text, at + 1) if begin < at else None
        if match:
            found.append((begin, match.end()))
            low = match.end()
        else:
            low = at + 1
        at = text.find("@", low)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then in the order of KINDS."""
    found = [(b, e, "email") for b, e in _emails(text)] if "@" in text else []
    for kind, pattern in (("ip", _ip), ("card", _card), ("phone", _phone)):
        if kind != "phone" or "+" in text:
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if passes(kind, m.group())]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# The network.

#: Characters with a class of their own, the letters of "at" and "dot" among them; then lower, upper, digit, other ASCII, other, padding.
_OWN = "@.+-()_%/:=,\"' \n[]!adot"
CLASSES = len(_OWN) + 6
PAD = CLASSES - 1
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind


def _class_table() -> np.ndarray:
    table = np.full(128, len(_OWN) + 3, dtype=np.uint8)
    for first, last, number in (("a", "z", 0), ("A", "Z", 1), ("0", "9", 2)):
        table[ord(first) : ord(last) + 1] = len(_OWN) + number
    for i, c in enumerate(_OWN):
        table[[ord(c), ord(c.upper())]] = i
    return table


_TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], len(_OWN) + 4).astype(np.uint8)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Network:
    """Bidirectional LSTM over character classes, with a linear chain CRF over the tags. Arrays have both directions first."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {
            "x": r.normal(0, 0.3, (2, CLASSES, 4 * h)), "h": r.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)), "b": np.tile(np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)]), (2, 1, 1)),
            "o": r.normal(0, 0.3, (2 * h, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS),
        }
        for tag in range(2, TAGS, 2):  # I follows only B and I of its kind; a window may begin inside a span
            self.p["t"][[t for t in range(TAGS) if t not in (tag - 1, tag)], tag] = -1e4
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _states(self, x, keep=False):
        """Hidden states (time, batch, 2 h) over classes x (time, batch)."""
        n, h = x.shape[1], HIDDEN
        steps = np.stack([x, x[::-1]], axis=1)  # time, direction, batch
        state = cell = np.zeros((2, n, h), dtype=np.float32)
        out, tape = np.empty((len(x), 2, n, h), dtype=np.float32), []
        way = np.arange(2)[:, None]
        for t in range(len(x)):
            z = self.p["x"][way, steps[t]] + state @ self.p["h"] + self.p["b"]
            gates = _sigmoid(z[:, :, : 3 * h])
            g = np.tanh(z[:, :, 3 * h :])
            before = (state, cell)
            cell = gates[:, :, h : 2 * h] * cell + gates[:, :, :h] * g
            tc = np.tanh(cell)
            state = gates[:, :, 2 * h :] * tc
            out[t] = state
            if keep:
                tape.append((gates, g, tc, *before))
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2), (steps, tape)

    def _back(self, grad, kept, grads):
        steps, tape = kept
        h, n = HIDDEN, grad.shape[1]
        grad = np.stack([grad[:, :, :h], grad[::-1, :, h:]], axis=1)
        dh = dc = np.zeros((2, n, h), dtype=np.float32)
        dzs, befores = [], []
        back = self.p["h"].transpose(0, 2, 1)
        for t in range(len(tape) - 1, -1, -1):
            gates, g, tc, h0, c0 = tape[t]
            i, f, o = gates[:, :, :h], gates[:, :, h : 2 * h], gates[:, :, 2 * h :]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=2)
            dzs.append(dz)
            befores.append(h0)
            dh, dc = dz @ back, dc * f
        dz = np.stack(dzs[::-1], axis=1).reshape(2, -1, 4 * h)  # direction, time and batch, gates
        h0 = np.stack(befores[::-1], axis=1).reshape(2, -1, h)
        classes = steps.transpose(1, 0, 2).reshape(2, -1)
        grads["h"] = h0.transpose(0, 2, 1) @ dz
        grads["b"] = dz.sum(axis=1, keepdims=True)
        grads["x"] = np.stack([(np.arange(CLASSES)[:, None] == c[None, :]).astype(np.float32) @ d for c, d in zip(classes, dz, strict=True)])

    def emissions(self, x, keep=False):
        both, kept = self._states(x, keep)
        return both @ self.p["o"] + self.p["ob"], both, kept

    def _sums(self, e):
        """Log sums over the tag sequences up to and after each character, and over all."""
        n, trans = len(e), np.exp(self.p["t"])
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[0] = e[0] + self.p["s"]
        for t in range(1, n):
            top = a[t - 1].max(axis=1, keepdims=True)
            a[t] = np.log(np.exp(a[t - 1] - top) @ trans + 1e-30) + top + e[t]
        for t in range(n - 2, -1, -1):
            v = b[t + 1] + e[t + 1]
            top = v.max(axis=1, keepdims=True)
            b[t] = np.log(np.exp(v - top) @ trans.T + 1e-30) + top
        return a, b, _lse(a[-1], 1)

    def step(self, x, y):
        """Gradients of the mean negative log-likelihood; x, y: (time, batch)."""
        e, both, kept = self.emissions(x, True)
        a, b, total = self._sums(e)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(a + b - total[None, :, None])
        grads["s"] = de[0].sum(0) - np.bincount(y[0], minlength=TAGS)
        pair = np.exp(a[:-1, :, :, None] + self.p["t"] + (e + b)[1:, :, None, :] - total[None, :, None, None])
        grads["t"] = pair.sum((0, 1)) - np.bincount((y[:-1] * TAGS + y[1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        de[np.arange(len(x))[:, None], np.arange(x.shape[1])[None, :], y] -= 1
        grads["o"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        grads["ob"] = de.sum((0, 1))
        self._back(de @ self.p["o"].T, kept, grads)
        return {k: g / x.shape[1] for k, g in grads.items()}

    def train(self, x, y, seed: int = 3):
        r = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(EPOCHS):
            order = r.permutation(x.shape[1])
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                grads = self.step(x[:, own], y[:, own])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] = (self.p[k] - RATE * 0.72**epoch * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def marginals(self, x):
        """(time, batch, TAGS) probabilities of each character's tag, over all tag sequences of its window."""
        e = self.emissions(x)[0]
        a, b, total = self._sums(e)
        return np.exp(a + b - total[None, :, None])

    def best(self, probabilities: np.ndarray) -> np.ndarray:
        """The best tags of a stretch (time, TAGS) under the order of tags: I only after B or I of its kind, or at the start."""
        score, back = np.log(probabilities + 1e-12), []
        allowed = np.where(self.p["t"] < -1e3, -1e4, 0)
        best = score[0]
        for row in score[1:]:
            z = best[:, None] + allowed
            back.append(z.argmax(0))
            best = z.max(0) + row
        tags = [int(best.argmax())]
        for k in back[::-1]:
            tags.append(int(k[tags[-1]]))
        return np.array(tags[::-1])


# Labelled spans to learn from.


def _invent(r: np.random.Generator) -> list[tuple[str, str | None]]:
    """A text in parts, each with its kind or None."""
    word = lambda: "".join(r.choice(["the", "an", "er", "ou", "st", "ion", "é", "ch", "ß", "en", "ti", "ó", "ra", "at", "do"]) for _ in range(r.integers(1, 4)))
    num = lambda n: "".join(str(d) for d in r.integers(0, 10, n))
    name = lambda: "".join(r.choice(list("abcdefghiklmnoprstuvwyz")) for _ in range(r.integers(2, 9)))
    cased = lambda x: pick(x, x, x.title(), x.upper())
    pick = lambda *x: x[r.integers(len(x))]

    def groups(sizes, sep):
        return sep.join(num(n) for n in sizes)

    def email():
        at, dot = pick(("@", "."), ("@", "."), (" @ ", "."), ("@ ", "."), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" AT ", " DOT "))
        local = name() + pick("", "", ".", "_", "-", dot) + pick("", num(2), name(), "é" + name())
        return cased(local.strip("._-") + at + name() + pick("", num(1), f"{dot}{name()}") + dot + pick("com", "org", "net", "de", "io", f"co{dot}uk"))

    def card():
        sizes = pick((4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (16,), (4, 4, 4, 4, 3))
        one = groups(sizes, pick("", " ", "-", ".", "  ", "/", "\u00a0", " - "))
        return one if r.random() < 0.8 else num(4) + "".join(pick(" ", ".", "-") + num(4) for _ in range(3))

    def phone():
        begin = pick("+1 ", "+49 ", "+44", "", "", "", "00", "0", "1-")
        return begin + pick("({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "{a}/{b}{c}", "({a}){b}.{c}", "{a}\u00a0{b}\u00a0{c}").format(a=num(3), b=num(3), c=num(4))

    things = {"email": email, "ip": lambda: pick(".", ".", " . ", "[.]", ". ", "(.)").join(str(r.integers(1, 256)) for _ in range(4)), "card": card, "phone": phone}
    fakes = (
        lambda: f"{r.integers(1, 9)}.{r.integers(0, 30)}" + pick("", f".{r.integers(0, 9)}"), lambda: pick("v", "") + ".".join(num(pick(1, 2)) for _ in range(3)),
        lambda: f"{r.integers(1990, 2040)}{pick('-', '/', '.')}{r.integers(1, 13):02d}{pick('-', '/', '.')}{r.integers(1, 29):02d}",
        lambda: "".join(r.choice(list("0123456789abcdef")) for _ in range(pick(18, 32, 40))),
        lambda: "AKIA" + "".join(r.choice(list("ABCDEFGHJKMNPQRSTUVWXYZ234567")) for _ in range(16)),
        lambda: "$" + num(pick(2, 3, 5)) + pick("", "." + num(2)), lambda: f"{num(3)},{num(3)}" + pick("", f",{num(3)}"),
        lambda: num(pick(1, 2, 4, 5, 7, 8, 9, 12, 13, 20, 24)), lambda: "@" + name(), lambda: f"{num(2)}:{num(2)}" + pick("", f":{num(2)}"), lambda: f"{num(2)}-{num(2)}", lambda: name() + " @ " + num(2),
        lambda: f"{name()} at {name()}", lambda: f"the dot {name()} at {num(2)}", lambda: f"{name()} dot {name()} at {num(1)} {name()}", lambda: f"{num(4)}-{num(4)}", lambda: " ".join(num(pick(1, 2, 4)) for _ in range(pick(3, 5, 8))),
        lambda: f"ISBN {num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"#{num(6)}", lambda: f"{num(4)} {name()} {num(4)}",
        lambda: "!! ".join(word().upper() for _ in range(pick(2, 4, 7))) + pick("!!", "!! " + num(pick(3, 7))), lambda: num(16) + " " + num(16),
    )
    parts: list[tuple[str, str | None]] = []
    for _ in range(r.integers(1, 4)):
        parts.append((" ".join(cased(word()) for _ in range(r.integers(1, 8))) + pick(" ", " ", " ", ", ", ". ", "\n", ": ", ' = "', "=", " ("), None))
        if r.random() < 0.55:
            kind = KINDS[r.integers(4)]
            parts.append((things[kind](), kind))
        else:
            parts.append((fakes[r.integers(len(fakes))](), None))
        parts.append((pick(" ", " ", ", ", ". ", "\n", '"', ")", "### ", "!! ", ""), None) if r.random() < 0.9 else (" " + word(), None))
        if parts[-1][0] == "":
            parts[-1] = ("\n", None)
    return parts


def labelled_windows(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    x, y = np.full((WIDTH, n), PAD, dtype=np.int64), np.zeros((WIDTH, n), dtype=np.int64)
    for i in range(n):
        parts = _invent(r)
        tags = [t for text, kind in parts for t in ([0] * len(text) if kind is None else [1 + 2 * KINDS.index(kind)] + [2 + 2 * KINDS.index(kind)] * (len(text) - 1))]
        chars = classes_of("".join(t for t, _ in parts))
        low = int(r.integers(0, max(1, len(tags) - WIDTH + 1)))
        size = min(WIDTH, len(tags) - low)
        x[:size, i], y[:size, i] = chars[low : low + size], tags[low : low + size]
    return x, y


@functools.lru_cache(maxsize=1)
def trained() -> Network:
    return Network().train(*labelled_windows(SAMPLES))


def network(spark: SparkSession) -> Network:
    """The trained network: from the shared folder, or else trained here and put there."""
    with open(__file__, "rb") as f:
        name = hashlib.sha256(f.read() + f"{KINDS}{WIDTH}{HIDDEN}{SAMPLES}{EPOCHS}{BATCH}{RATE}".encode()).hexdigest()[:24]
    rows = lambda: [(k, list(v.shape), bytearray(v.astype(np.float32).tobytes())) for k, v in trained().p.items()]
    stored = kept(spark, f"pii-{name}", lambda: spark.createDataFrame(rows(), "name string, shape array<int>, numbers binary").coalesce(1))
    out = Network()
    out.p = {r.name: np.frombuffer(r.numbers, dtype=np.float32).reshape(r.shape) for r in stored.collect()}  # a dozen rows
    return out


_spelled = re.compile(r"(?i)\bdot [a-z]{2,3}\b|[\[(](?:at|dot|\.)[\])]")


def _window_starts(chars: np.ndarray, text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit, an @ sign or a spelled-out one."""
    marks = (chars == len(_OWN) + 2) | (chars == 0)
    for m in _spelled.finditer(text):
        marks[m.start()] = True
    mark = np.concatenate(([0], np.cumsum(marks)))
    n, half = len(chars), WIDTH // 2
    starts = np.arange(0, max(1, n - half), half)
    return starts[mark[np.minimum(starts + WIDTH, n)] > mark[starts]].tolist()


#: How much a window has to say of a character, by its place: the more the nearer to the middle.
_SAY = np.minimum(np.arange(1, WIDTH + 1), np.arange(WIDTH, 0, -1)).astype(np.float32)[:, None]


class Reconciled:
    """The tagged stretches of a text, from its windows' marginals in order of start; only characters likely tagged are held."""

    def __init__(self, model: Network):
        self.model, self.held, self.end, self.at, self.rows = model, None, -1, [], []

    def window(self, start: int, marginals: np.ndarray) -> None:
        half = WIDTH // 2
        say = _SAY[:half]
        if self.end == start + half:  # the window before ends half a window into this one
            self._take(start, (self.held * _SAY[half:] + marginals[:half] * say) / (_SAY[half:] + say))
        else:
            self.flush()
            self._take(start, marginals[:half])
        self.held, self.end = marginals[half:], start + WIDTH

    def flush(self) -> None:
        if self.held is not None:
            self._take(self.end - WIDTH // 2, self.held)
        self.held, self.end = None, -1

    def _take(self, start: int, probabilities: np.ndarray) -> None:
        tagged = np.flatnonzero(probabilities[:, 0] < 0.5)
        self.at += (start + tagged).tolist()
        self.rows += list(probabilities[tagged])

    def spans(self) -> list[tuple[int, int, int, float]]:
        """(start, end, kind, least certainty) of each span, in order."""
        self.flush()
        out = []
        at, rows = np.array(self.at, dtype=np.int64), np.array(self.rows)
        for k in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1) if len(at) else []:
            tags = self.model.best(rows[k])
            for i, tag in zip(k, tags.tolist(), strict=True):
                if not tag:
                    continue
                kind = (tag - 1) // 2
                sure = float(rows[i][1 + 2 * kind] + rows[i][2 + 2 * kind])
                if out and out[-1][1] == at[i] and out[-1][2] == kind and tag % 2 == 0:
                    out[-1] = (out[-1][0], int(at[i]) + 1, kind, min(out[-1][3], sure))
                else:
                    out.append((int(at[i]), int(at[i]) + 1, kind, sure))
        return out


def added_spans(texts: list[str], bases: list[list], model: Network) -> list[list[tuple[int, int, str]]]:
    """What the network adds to the base spans of each text."""
    found = [Reconciled(model) for _ in texts]
    jobs = ((i, s, c) for i, t in enumerate(texts) for c in [classes_of(t)] for s in _window_starts(c, t))
    while part := list(itertools.islice(jobs, 256)):
        x = np.full((WIDTH, len(part)), PAD, dtype=np.int64)
        for k, (_, s, c) in enumerate(part):
            own = c[s : s + WIDTH]
            x[: len(own), k] = own
        marginals = model.marginals(x)
        for k, (i, s, c) in enumerate(part):
            own = marginals[:, k]
            own[max(0, len(c) - s) :] = np.eye(TAGS)[0]  # what is past the text
            found[i].window(s, own)
    return [_fitting(t, base, f.spans()) for t, base, f in zip(texts, bases, found, strict=True)]


def _fitting(text: str, base: list, spans: list) -> list[tuple[int, int, str]]:
    free = lambda b, e: not any(b < y and x < e for x, y, _ in base)
    return [(b, e, KINDS[kind]) for b, e, kind, sure in spans if sure >= SURE and free(b, e) and passes(KINDS[kind], text[b:e])]


_TRIGGER = np.zeros(256, dtype=bool)
_TRIGGER[[*range(48, 58), ord("@"), ord("+"), ord("["), ord("(")]] = True


def _candidates(column: pa.Array) -> np.ndarray:
    """Numbers of the rows that hold a digit, @, + or bracket, or the word dot; only they can have spans."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0] or column.buffers()[2] is None:
        return np.zeros(0, dtype=np.int64)
    spelled = pc.match_substring(column, " dot ", ignore_case=True).fill_null(False)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    marks = np.flatnonzero(_TRIGGER[data])
    rows = np.searchsorted(offsets - offsets[0], marks, side="right") - 1
    return np.union1d(rows, np.flatnonzero(spelled.to_numpy(zero_copy_only=False)))


def spans_of_batch(column: pa.Array, model: Network) -> dict[int, tuple[list, list]]:
    """row -> (base spans, all spans) for the rows of a batch that have any."""
    rows = _candidates(column)
    found = {}
    for at in range(0, len(rows), 500):
        own = rows[at : at + 500]
        texts = [t or "" for t in column.take(pa.array(own)).to_pylist()]
        bases = [base_spans(t) for t in texts]
        for i, base, more in zip(own.tolist(), bases, added_spans(texts, bases, model), strict=True):
            if base or more:
                found[i] = (base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]))))
    return found


SPAN = "array<struct<kind:string,start:int,end:int>>"
_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """id_col, base and spans: the base spans and all spans of every row, in code points, by start and kind."""
    shared = docs.sparkSession.sparkContext.broadcast(network(docs.sparkSession))  # a few thousand numbers

    def run(batches):
        for batch in batches:
            found = spans_of_batch(batch.column(1), shared.value)
            pick = lambda k: pa.array([[{"kind": s[2], "start": s[0], "end": s[1]} for s in found[i][k]] if i in found else [] for i in range(batch.num_rows)], _span)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0), pick(0), pick(1)], [id_col, "base", "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, base {SPAN}, spans {SPAN}")


def hide(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap are replaced as one, by the first's kind."""
    out, done = [], 0
    for b, e, kind in spans:
        if b >= done:
            out += [text[done:b], f"[{kind.upper()}]"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, text_col="text") -> DataFrame:
    """docs with all their columns, personal data in text_col replaced by its kind."""
    shared = docs.sparkSession.sparkContext.broadcast(network(docs.sparkSession))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            if found := spans_of_batch(column, shared.value):
                changed = column.to_pylist()
                for i, (_, spans) in found.items():
                    changed[i] = hide(changed[i], spans)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(changed, column.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame, id_col="doc_id") -> DataFrame:
    """The columns of the op7 query; the counts are of base spans."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *map(count, KINDS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
