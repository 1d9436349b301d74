"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans."""

from __future__ import annotations

import ipaddress
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, whole

KINDS = ("email", "ip", "card", "phone")
#: Atoms and characters of the longest entity (a longer address is none by the standards), characters of the shortest (seven digits).
LONGEST, CHARS, SHORTEST = 32, 254, 7

# The base patterns. Quantifiers are possessive or anchored where that cannot change what is found.
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches, by kind as in KINDS, then by start. Leftmost, non-overlapping per kind; failing matches are dropped."""
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        # The leftmost match over this '@' starts at its run of local characters; no other start could do better.
        start = at
        while start > end and text[start - 1] in _local:
            start -= 1
        m = _domain.match(text, at) if start < at else None
        if m:
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if _digit.search(text):
        found += [("ip", m.start(), m.end()) for m in _ip.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _card.finditer(text):
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in _phone.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# --- the semi-Markov conditional random field ---

#: An atom: a run of digits, of letters, of white space, or one other character.
_atoms = re.compile(r"[0-9]+|[^\W\d_]+|\s+|[^\w\s]|_|\w")
# Regions where an entity can be. Runs are possessive, so each is read once whatever its length.
_numbers = re.compile(r"[(+]?[0-9](?:[0-9 ().+/\[\]-]*[0-9])?")
_colons = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z])")
_sign = re.compile(r"@|(?<![^\W_])at(?![^\W_])", re.I)
_host = re.compile(r"[\])}]? ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({]\.[\])}] ?| ?[\[({]?(?<![^\W_])dot(?![^\W_])[\])}]? ?)[A-Za-z0-9-]++)+", re.I)
_words = re.compile(r"[^\W\d_]+")
_cues = {
    "phone": set("phone tel telephone call mobile cell fax dial ring telefon anruf anrufen tél téléphone appelez teléfono llame móvil".split()),
    "card": set("card visa mastercard amex credit debit karte kreditkarte carte tarjeta".split()),
    "ip": set("ip host server address login addr adresse dirección from via".split()),
    "email": set("mail email contact write reach kontakt courriel correo schreiben".split()),
}
#: Characters before a piece in which its cue words stand, and how many words back they may be.
CUE_CHARS, CUE_WORDS = 40, 3


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that may hold entities, ascending and disjoint: numbers with their separators, and addresses around a sign or its word."""
    found = [m.span() for m in _numbers.finditer(text) if m.end() - m.start() >= SHORTEST]
    found += [m.span() for m in _colons.finditer(text)]
    floor = 0  # a run of local characters is walked once: signs and separators are none
    for m in _sign.finditer(text):
        start = m.start()
        if start > floor and text[start - 1] in "[({":
            start -= 1
        if start > floor and text[start - 1] == " ":
            start -= 1
        end = start
        while start > floor and text[start - 1] in _local:
            start -= 1
        floor = m.end()
        host = _host.match(text, floor) if start < end else None
        if host:
            found.append((start, host.end()))
    found.sort()
    joined: list[tuple[int, int]] = []
    for a, b in found:
        if joined and a < joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def _beside(text: str, at: int, step: int) -> str:
    """What stands beside a segment: a letter or digit (w), a sign that joins numbers (j), a number behind one space (n), or else (s)."""
    if not 0 <= at < len(text):
        return "s"
    c = text[at]
    if c.isalnum():
        return "w"
    if c in "-/.+_#@:" and 0 <= at + step < len(text) and text[at + step].isalnum():
        return "j"
    return "n" if c == " " and 0 <= at + step < len(text) and text[at + step].isdigit() else "s"


def _is_v6(span: str) -> bool:
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


@lru_cache(maxsize=50_000)
def span_features(kind: str, span: str) -> tuple[str, ...]:
    """Features of a whole candidate segment: its shape and its arithmetic."""
    digits = _digits(span)
    groups = re.findall(r"[0-9]+", span)
    marks = "".join(sorted({c for c in span if not c.isalnum()}))
    f = [f"{kind}:bias"]
    if kind == "email":
        m = re.fullmatch(r"([A-Za-z0-9._%+-]+) ?([\[({]?)(@|at)[\])}]? ?([A-Za-z0-9-]+)((?:(?:\.| ?[\[({]\.[\])}] ?| ?[\[({]?dot[\])}]? ?)[A-Za-z0-9-]+)+)", span, re.I)
        f.append(f"email:form={bool(m)}")
        if m:
            last = re.split(r"[^A-Za-z]+", span)[-1].lower()
            top = last in ("com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io", "eu", "info")
            f += [f"email:at={m[3].lower()},{bool(m[2])},dot={'dot' in m[5].lower()}", f"email:top={top}", f"email:end={len(last) if last.isalpha() and len(last) < 5 else 'long'}"]
    elif kind == "ip":
        v6 = _is_v6(span)
        f.append(f"ip:six={v6},{len(span) > 8}")
        if not v6:
            plain = re.sub(r"[ \[\]()]|dot", "", span)
            parts = plain.split(".")
            f.append(f"ip:parts={min(len(parts), 5)}")
            f.append(f"ip:range={len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}")
            f.append(f"ip:even={len({span[m.end() : n.start()] for m, n in zip(*[list(re.finditer('[0-9]+', span))[k:] for k in (0, 1)])}) == 1}")
    elif kind == "card":
        f.append(f"card:length={len(digits)}")
        f.append(f"card:luhn={luhn(digits)}")
        f.append(f"card:groups={'one' if len(groups) == 1 else 'fours' if {len(g) for g in groups} == {4} else 'amex' if [len(g) for g in groups] == [4, 6, 5] else 'other'}")
        f.append(f"card:marks={marks if len(marks) < 2 else 'many'}")
        f.append(f"card:first={digits[0] if digits[0] in '3456' else 'other'}")
    else:
        prefix = "+" if span[0] == "+" else "(" if span[0] == "(" else "00" if digits.startswith("00") else digits[0] if digits[0] in "01" else "none"
        f.append(f"phone:length={len(digits)}")
        f.append(f"phone:prefix={prefix}")
        f.append(f"phone:groups={min(len(groups), 6)}")
        f.append(f"phone:shape={prefix},{'-'.join(str(len(g)) for g in groups) if len(groups) <= 5 else 'many'}")
        f.append(f"phone:marks={marks}")
        f.append(f"phone:single={sum(len(g) == 1 for g in groups) > 2}")
        f.append(f"phone:last={min(len(groups[-1]), 5)}")
        f.append(f"phone:year={len(groups) <= 3 and any(len(g) == 4 and g[:2] in ('19', '20') for g in groups) and len(digits) == 8}")
    return tuple(f)


class Piece:
    """A stretch of text to be segmented: atoms, and the candidate entities among them with their features.

    A candidate has at most LONGEST atoms and CHARS characters, starts and ends with a letter, a digit, '+' or '(',
    and holds what its kind cannot do without (phone numbers 7 to 15 digits in at most 8 groups and no letter, and so on).
    """

    def __init__(self, text: str, start: int, end: int):
        atoms = _atoms.findall(text, start, end)
        self.offsets = [start]
        for t in atoms:
            self.offsets.append(self.offsets[-1] + len(t))
        self.text, self.size = text, len(atoms)
        cues = {w.lower() for w in _words.findall(text, max(0, start - CUE_CHARS), start)[-CUE_WORDS:]}
        self.cued = {kind: bool(cues & words) for kind, words in _cues.items()}
        self.begins = [t[0].isalnum() or t in "+(" for t in atoms]
        self.ends = [t[0].isalnum() for t in atoms]

        def sums(count) -> list[int]:
            out = [0]
            for t in atoms:
                out.append(out[-1] + count(t))
            return out

        self.digits = sums(lambda t: len(t) if "0" <= t[0] <= "9" else 0)
        self.groups = sums(lambda t: "0" <= t[0] <= "9")
        self.letters = sums(lambda t: t[0].isalpha())
        self.signs = sums(lambda t: t == "@" or t.lower() == "at")
        self.dots = sums(lambda t: t == "." or t.lower() == "dot")
        self.marks = sums(lambda t: t == ":")

    def kinds(self, i: int, j: int) -> list[str]:
        def held(sums: list[int]) -> int:
            return sums[j] - sums[i]

        digits, letters, dots = held(self.digits), held(self.letters), held(self.dots)
        out = []
        if held(self.signs) and dots and letters > 1:
            out.append("email")
        if digits >= 4 and dots == 3 and not letters and not held(self.marks) or held(self.marks) >= 2 and digits:
            out.append("ip")
        if 13 <= digits <= 19 and not letters and held(self.groups) <= 6:
            out.append("card")
        if 7 <= digits <= 15 and not letters and not held(self.marks) and held(self.groups) <= 8:
            out.append("phone")
        return out

    def candidates(self, j: int) -> Iterator[tuple[str, int, tuple[str, ...]]]:
        """(kind, start, features) of the candidates that end behind atom j."""
        if not self.ends[j - 1]:
            return
        for i in range(j - 1, max(-1, j - LONGEST - 1), -1):
            if self.offsets[j] - self.offsets[i] > CHARS:
                break
            if not self.begins[i]:
                continue
            kinds = self.kinds(i, j)
            if kinds:
                a, b = self.offsets[i], self.offsets[j]
                before, after = _beside(self.text, a - 1, -1), _beside(self.text, b, 1)
                for kind in kinds:
                    more = (f"{kind}:before={before}", f"{kind}:after={after}", f"{kind}:cue={self.cued[kind]}")
                    yield kind, i, span_features(kind, self.text[a:b]) + more


class SemiMarkov:
    """Weights of whole-segment features; segments outside entities are single atoms of score 0."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def score(self, features: tuple[str, ...]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def decode(self, piece: Piece) -> list[tuple[str, int, int]]:
        """The best segmentation into entities and single atoms, boundaries and types jointly: (kind, start, end) in the text."""
        n = piece.size
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for kind, i, features in piece.candidates(j):
                s = best[i] + self.score(features)
                if s > best[j]:
                    best[j], back[j] = s, (kind, i)
        found, j = [], n
        while j:
            if back[j]:
                kind, i = back[j]
                found.append((kind, piece.offsets[i], piece.offsets[j]))
                j = i
            else:
                j -= 1
        return found[::-1]

    def posteriors(self, n: int, spans: list[tuple[str, int, int, tuple[str, ...]]]) -> list[float]:
        """The probability of each candidate (kind, start, end, features) among n atoms, by the forward-backward recursion over segments."""
        scores = [self.score(f) for _, _, _, f in spans]
        ends, begins = defaultdict(list), defaultdict(list)
        for (_, i, j, _), s in zip(spans, scores):
            ends[j].append((i, s))
            begins[i].append((j, s))

        def total(xs: list[float]) -> float:
            top = max(xs)
            return top + math.log(sum(math.exp(x - top) for x in xs))

        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = total([forward[j - 1], *(forward[i] + s for i, s in ends[j])])
        for i in range(n - 1, -1, -1):
            backward[i] = total([backward[i + 1], *(backward[j] + s for j, s in begins[i])])
        return [math.exp(forward[i] + s + backward[j] - forward[n]) for (_, i, j, _), s in zip(spans, scores)]


def _examples(rng: random.Random, n: int) -> Iterator[list[tuple[str, str | None]]]:
    """Made-up texts as pieces (string, kind or None): entities, and numbers and phrases that are none."""

    def d(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def check(k: int) -> str:
        head = rng.choice("3456") + d(k - 2)
        return next(head + x for x in "0123456789" if luhn(head + x))

    def fours(s: str, mark: str) -> str:
        return mark.join(s[i : i + 4] for i in range(0, len(s), 4))

    def name() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))

    def part() -> str:
        return str(rng.randint(0, 255))

    def year() -> str:
        return str(rng.randint(1900, 2030))

    def phone() -> str:
        return rng.choice(
            [f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"0{d(3)} {d(7)}", f"0{d(3)}/{d(6)}", f"({d(3)}){d(3)}-{d(4)}"]
            + [f"1-{d(3)}-{d(3)}-{d(4)}", f"1 ({d(3)}) {d(3)}-{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)} {d(3)} {d(4)}", f"00{d(2)}-{d(3)}-{d(7)}", f"0{d(4)} {d(3)} {d(3)}"]
        )

    def address() -> str:
        at, dot = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("@", " dot "), (" AT ", " DOT "), ("[at]", "."), (" (at) ", "."), ("@", "[.]")])
        host = name() if rng.random() < 0.7 else f"{name()}{dot}{name()}"
        local = rng.choice([name(), f"{name()}.{name()}", f"{name()}{d(2)}"])
        return f"{local}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'edu'])}"

    for _ in range(n):
        cue = lambda kind: rng.choice(sorted(_cues[kind])) if rng.random() < 0.4 else name()
        tail = rng.choice(["", ".", ", " + name(), " " + name()])
        yield [(cue("phone") + rng.choice([" ", ": "]), None), (phone(), "phone"), (tail, None)]
        if rng.random() < 0.5:
            one = f"{d(3)}-{d(3)}-"
            yield [(name() + " ", None), (one + d(4), "phone"), (" ", None), (one + d(4), "phone"), (" ", None), (one + d(4), "phone")]
        yield [(rng.choice(sorted(_cues["phone"])) + " ", None), (rng.choice([d(10), d(3) + " " + d(4), d(3) + "-" + d(4)]), "phone"), (tail, None)]
        plus = rng.choice([f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(7)}"])  # too many digits follow for a base match
        yield [(name() + " ", None), (plus, "phone"), (" ", None), (".".join(part() for _ in range(4)), None)]
        card = check(16)
        yield [(cue("card") + " ", None), (rng.choice([fours(card, "."), check(15), check(13), "{0[0]} {0[1]} {0[2]}".format([(c := check(15))[:4], c[4:10], c[10:]]), "-".join([(c := check(15))[:4], c[4:10], c[10:]])]), "card"), (tail, None)]
        dots = rng.choice([" . ", "[.]", "(.)", " .", "[.] "])
        yield [(cue("ip") + " ", None), (dots.join(part() for _ in range(4)), "ip"), (tail, None)]
        six = [f"{rng.randint(0, 65535):x}" for _ in range(8)]
        yield [(cue("ip") + " ", None), (rng.choice([":".join(six), "2001:db8::" + ":".join(six[:2]), f"fe80::{':'.join(six[:4])}", f"{six[0]}:{six[1]}::{six[2]}:1"]), "ip"), (tail, None)]
        yield [(cue("email") + " ", None), (address(), "email"), (tail, None)]
        wrong = next(x for x in iter(lambda: d(16), "") if not luhn(x))
        for none in rng.sample(
            [wrong, fours(wrong, "."), year(), f"{year()}-{rng.randint(10, 12)}-{d(2)}", f"{d(2)}.{d(2)}.{year()}", f"{d(2)}/{d(2)}/{year()}", f"{d(1)}.{d(2)}", f"{d(2)}.{d(2)}.{d(1)}", f"{year()}-{year()}", f"{year()} {year()}"]
            + [d(rng.randint(2, 12)), d(9), d(8), f"{d(3)} {d(3)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"978{d(10)}", f"{d(4)} {d(4)}", f"{d(1)} {d(2)} {d(3)}", f"{d(2)} ({d(4)})", f"{d(3)}-{d(2)}-{d(4)}", f"{d(2)} {d(3)} {d(3)}"]
            + [f"{rng.randint(1, 999)} {d(3)} {d(3)} {d(3)}", f"{rng.randint(1, 99)} {d(3)} {d(3)}", " ".join(d(1) for _ in range(rng.randint(4, 12))), " ".join(d(2) for _ in range(rng.randint(4, 8))), ".".join(str(rng.randint(256, 999)) for _ in range(4)), f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}"]
            + [f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"GB{d(2)} ABCD {d(4)} {d(4)} {d(4)} {d(2)}", f"{d(2)}:{d(2)}:{d(2)}", ":".join(f"{rng.randint(0, 255):02x}" for _ in range(6)), f"{d(5)}-{d(4)}", f"{d(2)}-{d(7)}", f"{d(3)}.{d(3)}.{d(3)}", f"No. {d(5)}-{d(3)}"]
            + [f"x{d(3)}-{d(3)}-{d(4)}", f"{d(4)}-{d(3)}-{d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}-{d(3)}", f"{d(1)}, {d(2)}, {d(2)}, {d(3)}", f"[{d(1)}] [{d(1)}] [{d(2)}] ({year()})", f"{name()}::{name()}"],
            6,
        ):
            yield [(rng.choice([name(), "order", "page", "price", "total", "id", "from"]) + " ", None), (none, None), (tail, None)]
        yield [(rng.choice([f"{name()} at {name()}. {name()}", f"look at {name()}.{name()}", f"{name()} at {name()}.{name()}", f"{name()} at the {name()}. {name()}", f"{name()} at {name()} dot {name()}", f"meet at {name()} . {name()}"]), None)]


def _gold(pieces: list[tuple[str, str | None]]) -> tuple[str, set[tuple[str, int, int]]]:
    text, gold = "", set()
    for string, kind in pieces:
        if kind:
            gold.add((kind, len(text), len(text) + len(string)))
        text += string
    return text, gold


@lru_cache(maxsize=1)
def trained(seed: int = 7, examples: int = 90, passes: int = 8, rate: float = 0.15, ridge: float = 0.001) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the conditional likelihood of made-up examples; the same in every run."""
    rng = random.Random(seed)
    data = []
    for pieces in _examples(rng, examples):
        text, gold = _gold(pieces)
        for x, y in untouched(text, base_spans(text)):
            piece = Piece(text, x, y)
            spans = [(kind, i, j, f) for j in range(1, piece.size + 1) for kind, i, f in piece.candidates(j)]
            if spans:
                data.append((piece.size, spans, [float((k, piece.offsets[i], piece.offsets[j]) in gold) for k, i, j, _ in spans]))
    weights: dict[str, float] = {}
    model = SemiMarkov(weights)
    for number in range(passes):
        rng.shuffle(data)
        step = rate / (1 + number / 2)
        for size, spans, wanted in data:
            gradient: dict[str, float] = defaultdict(float)
            for (_, _, _, features), p, y in zip(spans, model.posteriors(size, spans), wanted):
                if abs(y - p) > 1e-3:
                    for f in features:
                        gradient[f] += y - p
            for f, g in gradient.items():
                weights[f] = weights.get(f, 0.0) * (1 - ridge) + step * g
    return weights


def untouched(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of the regions that no base span touches; parts shorter than any entity are left out."""
    taken = sorted((a, b) for _, a, b in base)
    found, k = [], 0
    for a, b in regions(text):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        at, i = a, k
        while i < len(taken) and taken[i][0] < b:
            found.append((at, taken[i][0]))
            at = max(at, taken[i][1])
            i += 1
        found.append((at, b))
    return [(x, y) for x, y in found if y - x >= SHORTEST]


def added_spans(text: str, model: SemiMarkov, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Entities that the field finds outside the base spans."""
    return [span for x, y in untouched(text, base) for span in model.decode(Piece(text, x, y))]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base matches), base and spans strings of kind:start:end.

    base lists the base matches, spans these and the field's, by kind, then start. Offsets count code
    points. Null text is empty; repeated rows stay rows; an id that is no whole number is null. Empty input
    gives no rows. The field never overlaps a base match.
    """
    weights = trained()
    slim = docs.select(whole(key).alias("doc_id"), plain_text(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkov(weights)
        for b in batches:
            counts: list[list[int]] = []
            bases, alls = [], []
            for t in b.column(1):
                t = t.as_py()
                base = base_spans(t)
                more = added_spans(t, model, base)
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                bases.append(_joined(base))
                alls.append(_joined(sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))) if more else bases[-1])
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(bases, pa.string()), pa.array(alls, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return slim.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
