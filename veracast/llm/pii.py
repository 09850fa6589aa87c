"""Personal data by patterns and a semi-Markov conditional random field.

Patterns find base spans of four kinds, leftmost and without overlap within a kind.  Stretches of text with digits, at signs or
spelled-out addresses that no base span explains are cut into tokens, and a semi-Markov field chooses their best segmentation:
features look at a whole candidate span (its shape, digit count, check digit, octet range, what stands beside it), entities are bounded
in tokens, and dynamic programming picks boundaries and kinds together.  So a telephone and a card number that run into one another,
which no single pattern takes apart, are both found.  The field is trained by gradient ascent on its likelihood over sentences
made from templates with a fixed seed.

Long texts: whatever a stretch's length, the sweep over it holds the last few tokens and what is not settled yet; time is linear.

Defined results: a null or empty text has no span; repeated rows each get a row; an empty table gives an empty result; other columns
are ignored.  Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import random
import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, lean, texts

KINDS = ("email", "ip", "card", "phone")
#: Tokens and characters of the longest entity.
LONGEST, LONGEST_CHARS = 22, 128
#: Tokens after which a sweep looks for what is settled; forms of spans whose weights are remembered.
SETTLE, FORMS = 4096, 20_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never starts inside a run of digits that an earlier start has already failed on
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octets(text: str) -> bool:
    """Four parts, none above 255."""
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the pattern matches, in order."""
    out = []
    at = text.find("@")
    free = 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            out.append((start, free, 0))
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if octets(m.group())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            out += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


#: Stretches worth a look: seven digits or more with little between them, or an address with its signs spelled out.
_NUMBERS = re.compile(r"[(+]{0,2}[0-9](?:[ ().+-]{0,3}[0-9]){6,}")
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|[\[({] ?at ?[\])}]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,6}", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\w]|\w", re.ASCII)
_LETTER = re.compile(r"[A-Za-z]")
_AT = re.compile(r"@|[\[({] ?at ?[\])}]", re.IGNORECASE)
_OCTETS, _FOUR = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), re.compile(r"9+(?:\.9+){3}")
_LOCAL_NUMBER = re.compile(r"\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}")
_NINES = str.maketrans("012345678", "9" * 9)
_CUES = ((re.compile(r"(?:tel|phone|fax|call|mobile|cell)\W*$", re.I), "said-phone"), (re.compile(r"(?:card|visa|credit)\W*$", re.I), "said-card"), (re.compile(r"(?:mail|contact|write to)\W*$", re.I), "said-email"), (re.compile(r"(?:\bip|host|server|address)\W*$", re.I), "said-ip"))


def form_features(form: str) -> tuple[str, ...]:
    """What a candidate looks like as a whole, whatever its digits (each a 9 in ``form``)."""
    n = form.count("9")
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"9+", "9", form))
    out = ["digits" + str(min(n, 20)), "shape" + shape[:24]]
    if "a" not in shape:
        out.append("runs" + "-".join(str(min(len(r), 20)) for r in re.findall(r"9+", form)[:8]))
        if 12 <= n <= 19:
            kinds = set(re.findall(r"[^9]+", form))
            out.append("card-shape" if kinds <= {" "} or kinds <= {"-"} else "mixed-shape")
        if 9 <= n <= 15 and form[0] == "+":
            out.append("plus-number")
    elif _SPELLED.fullmatch(form):
        out.append("spelled-address")
        out.append("known-end" if re.search(r"(?:com|org|net|edu|info|io|de|fr|es|uk)$", form, re.I) else "other-end")
    if form[0] == " " or form[-1] in " (.-+" or form.count("(") != form.count(")"):
        out.append("ragged")
    return tuple(out)


def digit_features(span: str, form: str) -> list[str]:
    """What a candidate's digits say."""
    out, n = [], form.count("9")
    if 12 <= n <= 19 and not _LETTER.search(form):
        out.append("check" if luhn(_NOT_DIGIT.sub("", span)) else "no-check")
    elif n == 10 and _LOCAL_NUMBER.fullmatch(span):
        out.append("local-number")
    if _FOUR.fullmatch(form) and octets(span):
        out.append("octets")
    return out


def left_features(text: str, start: int) -> list[str]:
    """What stands before a candidate, in the text itself."""
    out = ["glued-left"] if start and (text[start - 1].isalnum() or text[start - 1] in "_+@") else []
    before = text[max(0, start - 16) : start]
    return out + [name for cue, name in _CUES if cue.search(before)]


def right_features(text: str, end: int) -> list[str]:
    return ["glued-right"] if end < len(text) and (text[end].isalnum() or text[end] in "_@") else []


def tokens(text: str, start: int, end: int) -> Iterator[int]:
    """Token boundaries of a stretch, both ends included."""
    for m in _TOKEN.finditer(text, start, end):
        yield m.start()
    yield end


class Recent:
    """The last ``LONGEST`` + 1 token boundaries of a stretch, with the digits and letters before each."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.cuts: deque[int] = deque(maxlen=LONGEST + 1)
        self.digits: deque[int] = deque(maxlen=LONGEST + 1)
        self.letters: deque[int] = deque(maxlen=LONGEST + 1)

    def add(self, cut: int) -> None:
        digits = letters = 0
        if self.cuts:
            last = self.cuts[-1]
            head = self.text[last]
            digits, letters = self.digits[-1], self.letters[-1]
            if "0" <= head <= "9":
                digits += cut - last
            elif head.isascii() and head.isalpha():
                letters += 1
        self.cuts.append(cut)
        self.digits.append(digits)
        self.letters.append(letters)

    def candidates(self) -> list[int]:
        """How many tokens back the spans begin that end at the last boundary and may be entities: numbers of seven to nineteen
        digits, four octets, and what holds letters and an at sign, none longer than ``LONGEST_CHARS``."""
        text, cuts, out = self.text, self.cuts, []
        last = len(cuts) - 1
        if not last or not text[cuts[last] - 1].isalnum():
            return out
        end, digits, letters = cuts[last], self.digits[last], self.letters[last]
        for back in range(1, last + 1):
            k = last - back
            start = cuts[k]
            if end - start > LONGEST_CHARS:
                break
            n = digits - self.digits[k]
            words = letters - self.letters[k]
            if n > 19 and not words:
                break
            head = text[start]
            if not (head.isalnum() or head in "+("):
                continue
            if words:
                if back > 2 and _AT.search(text, start, end):
                    out.append(back)
            elif 7 <= n <= 19 or back == 7 and 4 <= n and _OCTETS.fullmatch(text, start, end):
                out.append(back)
        return out


def outside(head: str) -> str:
    """The feature of a token outside entities, by its first character."""
    return "one-digits" if head.isdigit() else "one-letters" if head.isalpha() else "one-" + head


class Field:
    """A semi-Markov conditional random field: label 0 is one token outside, labels from 1 are the kinds."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.weights = np.zeros((0, len(KINDS) + 1))
        self.steps = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        self.cache: dict = {}
        self.forms: dict[str, list[float]] = {}

    def ids(self, names: list[str], grow: bool) -> list[int]:
        if grow:
            return [self.number.setdefault(x, len(self.number)) for x in names]
        return [self.number[x] for x in names if x in self.number]

    def candidates(self, text: str, grow: bool = False) -> tuple[list[int], list[tuple[int, int, list[int]]]]:
        """Token boundaries of a (short) text, and (first token, token after, features) of all spans that an entity may be and of
        single tokens outside."""
        cuts, out, recent = list(tokens(text, 0, len(text))), [], Recent(text)
        for b, cut in enumerate(cuts):
            recent.add(cut)
            if b:
                out.append((b - 1, b, self.ids(["one", outside(text[cuts[b - 1]])], grow)))
            for back in recent.candidates():
                span = text[cuts[b - back] : cut]
                form = span.translate(_NINES)
                names = ["span", *form_features(form), *digit_features(span, form), *left_features(text, cuts[b - back]), *right_features(text, cut)]
                out.append((b - back, b, self.ids(names, grow)))
        return cuts, sorted(out, key=lambda x: x[:2])

    def scores(self, spans: list[tuple[int, int, list[int]]]) -> np.ndarray:
        s = np.array([self.weights[f].sum(0) for _, _, f in spans])
        for k, (_, _, f) in enumerate(spans):
            if f and f[0] == self.number.get("span", -1):
                s[k, 0] = -np.inf
            else:
                s[k, 1:] = -np.inf
        return s

    def weight(self, names: tuple[str, ...]) -> list[float]:
        """The summed weights of some features, one number a label."""
        return self.weights[self.ids(list(names), False)].sum(0).tolist()

    def best(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, kind number) of the entities of the best segmentation of a stretch.

        One sweep over the boundaries keeps the values of the last ``LONGEST`` only.  Each boundary and label has one byte
        that tells where it came from; once the paths back from all that is still open meet, what lies before is settled.
        """
        steps = self.steps.tolist()
        labels = range(1, len(KINDS) + 1)
        low = -math.inf
        recent = Recent(text)
        enter: deque[list[float]] = deque(maxlen=LONGEST + 1)
        left: deque[tuple | None] = deque(maxlen=LONGEST + 1)
        out: list[tuple[int, int, int]] = []
        cuts, came, base = array("q"), bytearray(), 0
        width = len(KINDS) + 1
        values: deque[list[float]] = deque(maxlen=LONGEST + 1)

        def back(b: int, y: int) -> tuple[int, int]:
            code = came[(b - base) * width + y]
            return b - code // width - 1, code % width

        def settle(b: int, y: int) -> None:
            """Entities on the path from ``base`` to a boundary and label."""
            found = []
            while b > base:
                a, before = back(b, y)
                if y:
                    found.append((cuts[a - base], cuts[b - base], y - 1))
                b, y = a, before
            out.extend(reversed(found))

        b = -1
        for b, cut in enumerate(tokens(text, start, end)):
            recent.add(cut)
            cuts.append(cut)
            value, code = [low] * width, [0] * width
            if not b:
                value[0] = 0.0
            else:
                value[0], code[0] = enter[-1][0][0] + self._one(outside(text[recent.cuts[-2]])), enter[-1][1][0]
                spans = recent.candidates()
                right = self._some(tuple(right_features(text, cut))) if spans else None
                for n in spans:
                    if left[-n] is None:
                        left[-n] = self._some(tuple(left_features(text, recent.cuts[-n - 1])))
                    score, before, far = self._span(text[recent.cuts[-n - 1] : cut]), left[-n], enter[-n]
                    for y in labels:
                        total = far[0][y] + score[y] + before[y] + right[y]
                        if total > value[y]:
                            value[y], code[y] = total, (n - 1) * width + far[1][y]
            came.extend(code)
            values.append(value)
            live = [y for y in range(width) if value[y] > low]
            reach = [max((value[x] + steps[x][y], -x) for x in live) for y in range(width)] if live else [(low, 0)] * width
            enter.append(([r[0] for r in reach], [-r[1] for r in reach]))
            left.append(None)
            if b - base >= SETTLE:
                open_ = {(b - k, y) for k, v in enumerate(reversed(values)) for y in range(width) if v[y] > low}
                while len(open_) > 1 and (last := max(open_))[0] > base:
                    open_.remove(last)
                    open_.add(back(*last))
                at, y = max(open_)
                if len(open_) == 1 and at > base:
                    settle(at, y)
                    del cuts[: at - base], came[: (at - base) * width]
                    base = at
                    # what came to the new base is settled: its own label alone is open there, as every open path has it
        if b >= 0:
            settle(b, max(range(width), key=lambda y: values[-1][y]))
        return out

    def _one(self, kind: str) -> float:
        if kind not in self.cache:
            self.cache[kind] = self.weight(("one", kind))[0]
        return self.cache[kind]

    def _some(self, names: tuple[str, ...]) -> list[float]:
        if names not in self.cache:
            self.cache[names] = self.weight(names)
        return self.cache[names]

    def _span(self, span: str) -> list[float]:
        """Summed weights of a candidate by itself; those of its form are remembered."""
        form = span.translate(_NINES)
        score = self.forms.get(form)
        if score is None:
            if len(self.forms) >= FORMS:
                self.forms.clear()
            score = self.forms[form] = self.weight(("span", *form_features(form)))
        if names := digit_features(span, form):
            score = [x + w for x, w in zip(score, self._some(tuple(names)), strict=True)]
        return score

    def _gradient(self, spans, score: np.ndarray, gold: dict[tuple[int, int], int], n: int, g_w: np.ndarray, g_s: np.ndarray) -> None:
        """Adds what the likelihood gains by each weight: the true segmentation's counts less the expected ones."""
        labels = len(KINDS) + 1
        order = sorted(range(len(spans)), key=lambda k: spans[k][:2])
        alpha, beta = np.full((n + 1, labels), -np.inf), np.full((n + 1, labels), -np.inf)
        alpha[0, 0], beta[n] = 0, 0
        enter = {}
        for k in order:
            a, b, _ = spans[k]
            if a not in enter:
                enter[a] = np.logaddexp.reduce(alpha[a][:, None] + self.steps, axis=0)
            alpha[b] = np.logaddexp(alpha[b], enter[a] + score[k])
        for k in sorted(order, key=lambda k: -spans[k][0]):
            a, b, _ = spans[k]
            beta[a] = np.logaddexp(beta[a], np.logaddexp.reduce(self.steps + (score[k] + beta[b])[None, :], axis=1))
        z = np.logaddexp.reduce(alpha[n])
        before = 0
        for k in order:
            a, b, f = spans[k]
            edge = np.exp(alpha[a][:, None] + self.steps + (score[k] + beta[b])[None, :] - z)
            expected = edge.sum(0)
            g_s -= edge
            y = gold.get((a, b))
            if y is not None:
                expected[y] -= 1
                g_s[before, y] += 1
                before = y
            g_w[f] -= expected

    def train(self, sentences: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 14, rate: float = 0.6, decay: float = 1e-3) -> Field:
        """Gradient ascent with per-weight step sizes over (text, entities)."""
        data = []
        for text, entities in sentences:
            cuts, spans = self.candidates(text, grow=True)
            at = {c: k for k, c in enumerate(cuts)}
            gold = {(at[s], at[e]): kind + 1 for s, e, kind in entities}
            covered = {t for a, b in gold for t in range(a, b)}
            gold |= {(t, t + 1): 0 for t in range(len(cuts) - 1) if t not in covered}
            data.append((spans, gold, len(cuts) - 1))
        self.weights = np.zeros((len(self.number), len(KINDS) + 1))
        seen_w, seen_s = np.full_like(self.weights, 1e-6), np.full_like(self.steps, 1e-6)
        for _ in range(rounds):
            g_w, g_s = -decay * len(data) * self.weights, -decay * len(data) * self.steps
            for spans, gold, n in data:
                self._gradient(spans, self.scores(spans), gold, n, g_w, g_s)
            seen_w += g_w**2
            seen_s += g_s**2
            self.weights += rate * g_w / np.sqrt(seen_w)
            self.steps += rate * g_s / np.sqrt(seen_s)
        return self


def _card(rng: random.Random, sep: str) -> str:
    n = rng.choice((13, 15, 16, 16, 16, 16, 19))
    body = str(rng.randint(3, 6)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 2))
    body += next(c for c in "0123456789" if luhn(body + c))
    return sep.join(body[k : k + 4] for k in range(0, n, 4)) if sep else body


def _examples(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """One made-up stretch with its entities."""

    def digits(n: int, first: str = "0123456789") -> str:
        return rng.choice(first) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))

    def word(n: int = 8) -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, n)))

    def email() -> str:
        at, dot = rng.choice((("@", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" @ ", " . ")))
        name = word() + rng.choice(("", "." + digits(2), "_" + word(), digits(2)))
        return name + at + word() + rng.choice(("", digits(1), dot + word(5))) + dot + rng.choice(("com", "org", "net", "de", "fr", "es"))

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        area, a, b = digits(3, "23456789"), digits(3, "23456789"), digits(4)
        return rng.choice((f"+1 ({area}) {a}-{b}", f"+1 {area} {a} {b}", f"+1-{area}-{a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}", f"+{digits(2, '3456789')} {digits(3)} {digits(7)}", f"+{digits(11, '123456789')}"))

    def noise() -> str:
        bad = digits(16, "123456789")
        while luhn(bad):
            bad = digits(16, "123456789")
        return rng.choice((bad, digits(rng.randint(1, 11)), digits(rng.randint(20, 30)), f"{digits(4, '12')}-{digits(2, '01')}-{digits(2, '0123')}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(3)},{digits(3)}", f"{digits(4)} {digits(4)}", f"{digits(3)} {digits(3)} {digits(3)} {digits(2)}", f"{digits(3, '3456789')}.{digits(3, '3456789')}.{digits(1)}.{digits(1)}", word() + digits(7) + word(), word() + " @ " + word(), f"{digits(1)}-{digits(4)}-{digits(5)}-{digits(1)}"))

    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += rng.choice(("", "", word() + " ", "tel " if rng.random() < 0.3 else ""))
        kind = rng.choice((0, 1, 2, 2, 3, 3, 4, 4, 4))
        piece = (email, ip, lambda: _card(rng, rng.choice(("", "", " ", "-"))), phone, noise)[kind]()
        if kind < 4:
            spans.append((len(text), len(text) + len(piece), kind))
        text += piece + " "
    return text[:-1], spans


_FIELDS: list[Field] = []


def trained_field(sentences: int = 220, seed: int = 11) -> Field:
    """The field, trained once a process."""
    if not _FIELDS:
        rng = random.Random(seed)
        _FIELDS.append(Field().train([_examples(rng) for _ in range(sentences)]))
    return _FIELDS[0]


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Entities that the field finds outside the base spans."""
    stretches = [m.span() for m in _NUMBERS.finditer(text)] if _DIGIT.search(text) else []
    if "@" in text or "at" in text:
        stretches += [m.span() for m in _SPELLED.finditer(text)] if "@" in text or re.search(r"[\[({] ?at ?[\])}]", text, re.I) else []
    if not stretches:
        return []
    out, taken = [], sorted(base)
    merged: list[list[int]] = []
    for s, e in sorted(stretches):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    k = 0
    for s, e in merged:
        while k and taken[k - 1][1] > s:
            k -= 1
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        at = s
        gaps, j = [], k
        while j < len(taken) and taken[j][0] < e:
            if taken[j][0] > at:
                gaps.append((at, taken[j][0]))
            at = max(at, taken[j][1])
            j += 1
        if at < e:
            gaps.append((at, e))
        for a, b in gaps:
            if b - a >= 7:
                out += field.best(text, a, b)
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlaps merged, replaced by its (first) kind in brackets."""
    at, out = 0, []
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), mask: bool = False) -> DataFrame:
    """The columns ``id_col`` and ``keep``, n_email, n_ip, n_card, n_phone and base (of the patterns), spans (of all), and with
    ``mask`` the masked text as masked_text; a scan without any shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(field or trained_field())
    columns = list(dict.fromkeys((id_col, *keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col):
            counts, base, every, clean = np.zeros((4, batch.num_rows), np.int64), [], [], []
            for k, text in enumerate(texts(batch.column(text_col))):
                found = base_spans(text)
                for _, _, kind in found:
                    counts[kind, k] += 1
                full = sorted([*found, *added_spans(text, found, shared.value)], key=lambda s: (s[0], s[2]))
                base.append(written(found))
                every.append(written(full))
                if mask:
                    clean.append(masked(text, full))
            more = [pa.array(clean, pa.string())] if mask else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(every, pa.string()), *more], [*columns, "n_email", "n_ip", "n_card", "n_phone", "base", "spans", *(["masked_text"] if mask else [])])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    schema += ", n_email long, n_ip long, n_card long, n_phone long, base string, spans string" + ", masked_text string" * mask
    return docs.select(*dict.fromkeys((*columns, text_col))).mapInArrow(lean(run), schema)
