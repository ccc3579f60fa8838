"""Personal data and secrets: high-recall generators, boosted trees, calibrated thresholds.

Base spans (email, ip, card, phone) come from fixed patterns and always stay.  Wider
generators propose further, overlapping spans: spelt-out addresses, account numbers, national
numbers, local phone numbers, dates of birth, access keys and the values of named secrets.
Gradient-boosted trees judge each from its format and context.  A span stays if its calibrated
probability reaches its kind's threshold and it touches no base span; of overlapping ones the
likelier stays, and what then overlaps nothing that stayed, stays too.

The trees are trained here, in numpy, on candidates of generated text (fixed seed): personal
data and look-alikes set into neutral sentences.  Calibration and thresholds come from text of
another make, with formats, cues and sentences that the training text doesn't have: the lowest
probability at which precision is at least PRECISION.

Offsets are code points, ends exclusive.  Defined results: null and empty texts have no
spans; rows with a null doc_id and repeated rows each get their row; an empty table gives
an empty result; :func:`judge` ignores further columns and :func:`redacted` keeps them,
whatever their names.  Texts are searched whole, a bounded number of bytes of rows at a time,
in time linear in their length; a worker holds a text a few times over.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .textscan import slices

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_words", "iban", "national_id", "phone_local", "birth_date", "access_key", "secret")
PRECISION, TREES, DEPTH, RATE = 0.98, 60, 4, 0.3

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
#: Matches begin where a run of digits begins, so the check before it changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, leftmost and non-overlapping, in linear time."""
    out, at, low = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            low = found.end()
            at = text.find("@", low)
        else:
            low = at + 1
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as in BASE_KINDS, then start."""
    out = emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_GENERATORS = {
    "email_words": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,63}){1,4}"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "national_id": re.compile(r"(?<![A-Za-z0-9.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])"),
    "phone_local": re.compile(r"(?<![A-Za-z0-9.+-])\(?[0-9]{3,5}\)?[\x20./-]?[0-9]{2,4}(?:[\x20./-]?[0-9]{2,4}){1,3}(?![A-Za-z0-9])"),
    "birth_date": re.compile(rf"(?<![A-Za-z0-9./-])(?:[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}\.? (?:{_MONTHS}) [0-9]{{4}}|(?:{_MONTHS}) [0-9]{{1,2}}, [0-9]{{4}})(?![A-Za-z0-9/-])"),
    "access_key": re.compile(r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/-]{0,60}[0-9])[A-Za-z0-9_+/-]{16,256}={0,2}(?![A-Za-z0-9_+/-])"),
}
#: The names of secrets, what sets them, and their values.
_NAMED = re.compile(r"(?i)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|passwort|contraseña|mot de passe)s?[\"']?\s{0,3}(?::=|=>|[:=]|\bis\b)\s{0,3}[\"'`]?([^\s\"'`,;]{4,200})")
_NAMES = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "contraseña")
#: What keys of well-known services begin with (fixed values, publicly documented).
_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "rk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "hf_", "npm_", "SG", "ya29")
#: Words before a span that speak for personal data, by kind (fixed values).
_CUES = {
    "email_words": ("mail", "email", "e-mail", "contact", "write", "reach"),
    "iban": ("iban", "account", "konto", "cuenta", "compte", "bank"),
    "national_id": ("ssn", "social", "security", "national", "id"),
    "phone_local": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "teléfono", "téléphone"),
    "birth_date": ("born", "birth", "birthday", "birthdate", "dob", "geboren", "geburtsdatum", "née", "né", "nacido", "nacida", "nacimiento", "naissance"),
    "access_key": ("key", "token", "secret", "apikey", "api_key", "access", "credential", "bearer", "auth", "authorization"),
    "secret": ("password", "passwd", "passwort", "secret", "token", "passphrase", "pwd", "api", "access", "bearer"),
}
_AGAINST = ("order", "invoice", "version", "ticket", "isbn", "article", "part", "page", "serial", "no", "price", "year", "record", "case", "commit", "sha", "sha256", "md5", "hash", "checksum", "revision", "uuid", "path", "file", "on", "until", "dated", "published", "released")
_WORDS = re.compile(r"[^\W_]+(?:[-_][^\W_]+)?")
_HEX = frozenset("0123456789abcdefABCDEF")


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    turned = s[4:] + s[:4]
    return 15 <= len(s) <= 34 and turned.isalnum() and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def candidates(text: str) -> list[Span]:
    """What the generators propose; spans may overlap."""
    out: list[Span] = []
    if "dot" in text:
        out += [("email_words", m.start(), m.end()) for m in _GENERATORS["email_words"].finditer(text)]
    if _DIGIT.search(text):
        for kind in ("iban", "national_id", "phone_local", "birth_date", "access_key"):
            out += [(kind, m.start(), m.end()) for m in _GENERATORS[kind].finditer(text)]
    low = text.lower()
    if any(name in low for name in _NAMES):
        for m in _NAMED.finditer(text):
            value = m[1].rstrip(".)]}>")
            if len(value) >= 4:
                out.append(("secret", m.start(1), m.start(1) + len(value)))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    s = text[start:end]
    digits = digits_of(s)
    before = [w.lower() for w in _WORDS.findall(text[max(0, start - 40) : start])][-3:]
    area = int(digits[:3] or 0)
    groups = re.findall("[0-9]+", s)
    letters = re.findall("[A-Za-z]+", s)
    years = [int(g) for g in groups if len(g) == 4]
    share = np.array([*Counter(s).values()]) / len(s)
    turns = sum((a in _ALPHA) != (b in _ALPHA) for a, b in zip(s, s[1:], strict=False))
    return [
        float(MORE_KINDS.index(kind)),
        float(len(s)),
        float(len(digits)),
        float(len(groups)),
        float(max(map(len, groups), default=0)),
        float(s.count("-")),
        float(s.count(" ")),
        float(s.count(".")),
        float(s.count("/")),
        float("(" in s),
        float(sum(c.isalpha() for c in s)),
        float(kind == "iban" and iban_valid(s)),
        float(any(w in _CUES[kind] for w in before)),
        float(any(w in _AGAINST for w in before)),
        float(area == 0 or area == 666 or area >= 900),
        float(digits == digits[::-1] and bool(digits)),
        float(text[start - 1 : start] in ("#", "$", "€", "£")),
        float(text[end : end + 1] in ("%", "€", "$")),
        float(len(set(digits)) <= 2),
        float(bool(re.search(r"(?:\(dot\)|\[dot\]|\sdot\s)\s?(?:com|org|net|edu|de|fr|es|io|info|gov|uk|it)$", s))),
        float(-(share * np.log2(share)).sum()),
        float(sum("A" <= c <= "Z" for c in s)),
        float(sum("a" <= c <= "z" for c in s)),
        float(s.startswith(_PREFIXES)),
        float(all(c in _HEX for c in s)),
        float(bool(re.search("[:=][\\s\"'`]*$", text[max(0, start - 6) : start]))),
        float(bool(years) and 1900 <= years[0] <= 2015),
        float(max(map(len, letters), default=0)),
        turns / len(s),
        float(s[:1] in "<{$[*%("),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s))),
    ]


_ALPHA = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


@dataclass
class Trees:
    """Boosted regression trees of fixed depth: each a list of (feature, cut) by node, and leaf values."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> Trees:
    """Newton boosting of the logistic loss; every cut between two values is tried."""
    model = Trees(float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))))
    raw = np.full(len(x), model.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(2**DEPTH - 1, dtype=np.int64), np.full(2**DEPTH - 1, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(DEPTH):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                best = 1e-6
                all_g, all_h = g[rows].sum(), h[rows].sum() + 1
                for f in range(x.shape[1]):
                    values = x[rows, f]
                    order = np.argsort(values, kind="stable")
                    v, gs, hs = values[order], np.cumsum(g[rows][order]), np.cumsum(h[rows][order])
                    ends = np.flatnonzero(v[1:] > v[:-1]) if len(v) else np.zeros(0, dtype=np.int64)
                    if not len(ends):
                        continue
                    gain = gs[ends] ** 2 / (hs[ends] + 1) + (all_g - gs[ends]) ** 2 / (all_h - hs[ends]) - all_g**2 / all_h
                    if gain.max() > best:
                        j = ends[int(np.argmax(gain))]
                        best, feature[k], cut[k] = float(gain.max()), f, (v[j] + v[j + 1]) / 2
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        place = node - (2**DEPTH - 1)
        leaf = -rate * np.bincount(place, g, 2**DEPTH) / (np.bincount(place, h, 2**DEPTH) + 1)
        model.trees.append((feature, cut, leaf))
        raw += leaf[place]
    return model


def _made_iban(rng) -> str:
    body = "".join(str(d) for d in rng.integers(0, 10, 18))
    code = ["DE", "FR", "ES", "GB"][rng.integers(4)]
    turned = body + code + "00"
    check = 98 - int("".join(str(int(c, 36)) for c in turned)) % 97
    s = f"{code}{check:02d}{body}"
    return s if rng.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))


def _example(kind: str, good: bool, other: bool, rng) -> tuple[str, str, str]:
    """(what stands before, the span, what stands after); ``other``: of the calibration's make."""
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    pick = lambda *x: x[rng.integers(len(x))]
    of = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    cue = pick(*_CUES[kind][other::2]) + pick("", ":", " is") if rng.random() < (0.7 if good else 0.1) else ""
    against = pick(*_AGAINST[other::2]) if not good and rng.random() < 0.5 else ""
    before = against or cue
    if kind == "email_words":
        name = (pick("anna", "j.doe", "info7", "max_m", "sales") if not other else pick("peter", "k-lee", "office", "mia22", "help.desk")) + pick("", digits(2))
        form = pick((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"))
        home, end = (pick("mail", "example", "firm", "uni"), pick("com", "org", "net", "de")) if not other else (pick("post", "shop", "lab-x", "web"), pick("edu", "fr", "io", "es"))
        return before, name + form[0] + home + form[1] + (end if good else pick("matrix", "product", "line", "plot") if not other else pick("notation", "sum", "graph")), ""
    if kind == "iban":
        return before, _made_iban(rng) if good else pick("AB", "XK", "SN", "ID", "MX", "QR")[: 2] + digits(2) + pick("", " ") + digits(4) + digits(pick(8, 12, 14)), ""
    if kind == "national_id":
        right = f"{rng.integers(1, 666):03d}{(sep := pick('-', '-', '-', ' ') if cue else '-')}{rng.integers(1, 100):02d}{sep}{rng.integers(1, 10000):04d}"
        return before, right if good else pick(f"{rng.integers(900, 1000)}-{digits(2)}-{digits(4)}", f"000 {digits(2)} {digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}"), ""
    if kind == "phone_local":
        a, b, c = digits(3), digits(3), digits(4)
        right = pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"0{a} {b} {c}") if not other else pick(f"{a}.{b}.{c}", f"({a}) {b} {c}", f"0{a}/{b}{c}" if cue else f"{a}-{b}-{c}")
        wrong = pick(digits(8), digits(10), digits(16), f"{digits(4)}/{digits(2)}/{digits(2)}", f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(4)}-{digits(2)}-{digits(2)}", digits(12))
        return before, right if good else wrong, ""
    if kind == "birth_date":
        y, m, d = pick(int(rng.integers(1925, 2012)), int(rng.integers(1960, 2005))) if good else int(rng.integers(1850, 2040)), int(rng.integers(1, 13)), int(rng.integers(1, 29))
        month = _MONTHS.split("|")[m - 1]
        form = pick(f"{d:02d}.{m:02d}.{y}", f"{y}-{m:02d}-{d:02d}", f"{month} {d}, {y}") if not other else pick(f"{m}/{d}/{y}", f"{d} {month} {y}", f"{d:02d}-{m:02d}-{y}")
        by = pick(*_CUES[kind][other::2]) + pick("", ":", " on", " am") if good else pick("on", "until", "dated", "published", "released", "the", "since")
        return by, form, ""
    if kind == "access_key":
        if good:
            made = pick("AKIA" + of(upper + pick("2", "234567", "0123456789" * 2), 15) + digits(1), "ghp_" + of(upper + lower + "0123456789", 36), "sk_live_" + of(upper + lower + "0123456789", 24)) if not other else pick("ASIA" + of(upper + "234567", 16), "AIza" + of(upper + lower + "0123456789_-", 35), "xoxb-" + digits(11) + "-" + of(upper + lower + "0123456789", 24), "eyJ" + of(upper + lower + "0123456789_-", 60))
            if not made.startswith(_PREFIXES) or rng.random() < 0.3:
                made, before = of(upper + lower + "0123456789" + ("+/" if other else ""), int(rng.integers(24, 64))), before or pick(*_CUES[kind])
            return before, made, ""
        hexed = of("0123456789abcdef", pick(32, 40, 64))
        words = lambda sep: sep.join(pick("alpha", "build", "report", "final", "data", "image", "north") for _ in range(4)) + pick("", "_", "-") + digits(pick(1, 2, 4))
        uuid = "-".join(of("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
        return pick(against, "commit", "sha256", "id", "see", "file"), pick(hexed, hexed.upper(), words("_"), words("/"), words("-"), uuid, "a" * int(rng.integers(16, 40)) + digits(2), digits(int(rng.integers(17, 30)))) if not other else pick(hexed.upper(), words("/") + "/x", uuid, digits(20), words("-")), ""
    name = (pick("password", "token", "secret", "api_key") if not other else pick("pwd", "passwd", "access_key", "passphrase", "Passwort")) + pick("=", ": ", " = ", ' = "')
    if good:
        value = pick(of("0123456789abcdef", int(rng.integers(12, 48))), of(upper + lower + "0123456789", int(rng.integers(8, 40))), pick("Sommer", "hunter", "Qwerty", "dragon") + digits(pick(2, 4)) + pick("!", "#", "")) if not other else pick(of(upper + lower + "0123456789!@#%&*", int(rng.integers(8, 24))), of("0123456789abcdef", 32), pick("Winter", "monkey", "P4ss", "letmein") + digits(3) + pick("$", "?", ""))
        return name, value, '"' if name.endswith('"') else ""
    value = pick("required", "string", "<your-token>", "None", "optional", "********", "${SECRET}", "missing", "field") if not other else pick("{password}", "null", "os.environ", "[hidden]", "invalid", "changed", "$TOKEN", "expired")
    return name, value, '"' if name.endswith('"') else ""


#: Kinds that name the same thing.
_ALIKE = {"access_key": "secret"}


def generated(count: int, seed: int, other: bool) -> tuple[list[Span], list[str], np.ndarray]:
    """Candidates in generated texts, the texts, and whether each is personal data or a secret."""
    rng = np.random.default_rng(seed)
    filler = ("the", "and", "was", "nur", "les", "con", "from", "this", "see", "value", "of", "about", "with") if not other else ("a", "which", "der", "para", "dans", "they", "may", "some", "had", "more", "when", "und")
    few = lambda low, high: [filler[k] for k in rng.integers(0, len(filler), rng.integers(low, high))]
    spans, texts, labels = [], [], []
    while len(spans) < count:
        kind, good = MORE_KINDS[rng.integers(len(MORE_KINDS))], bool(rng.random() < 0.5)
        before, s, after = _example(kind, good, other, rng)
        head = " ".join([*few(1, 6), *([before] if before else [])])
        head += "" if before[-1:] in ("=", '"') else " "
        text = head + s + after + ("," if rng.random() < 0.1 else "") + " " + " ".join(few(1, 4))
        start = len(head)
        for found in candidates(text):
            if found[1] < start + len(s) and found[2] > start:
                same = found[0] == kind or _ALIKE.get(found[0], found[0]) == _ALIKE.get(kind, kind)
                right = good and same and found[1] <= start + 1 and found[2] >= start + len(s) - 1
                spans.append(found)
                texts.append(text)
                labels.append(right)
    return spans[:count], texts[:count], np.array(labels[:count], dtype=np.float64)


@dataclass
class Model:
    trees: Trees
    slope: float
    offset: float
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.raw(x) + self.offset)))

    def more_spans(self, text: str, base: list[Span]) -> list[Span]:
        """The method's own spans, by kind as in MORE_KINDS, then start."""
        found = candidates(text)
        if not found:
            return []
        taken = sorted((a, b) for _, a, b in base)
        starts = np.array([a for a, _ in taken], dtype=np.int64)
        reach = np.maximum.accumulate(np.array([b for _, b in taken], dtype=np.int64)) if taken else starts
        free = []
        for s in found:
            k = int(np.searchsorted(starts, s[2], "left"))
            if not k or reach[k - 1] <= s[1]:
                free.append(s)
        if not free:
            return []
        p = self.probability(np.array([features(text, s) for s in free]))
        good = [(-q, s[1], s[2], s[0]) for s, q in zip(free, p.tolist(), strict=True) if q >= self.thresholds[s[0]]]
        kept: list[tuple[int, int, str]] = []
        for _, a, b, kind in sorted(good):
            k = bisect.bisect_left(kept, (b,))
            if not k or kept[k - 1][1] <= a:
                kept.insert(k, (a, b, kind))
        return sorted(((kind, a, b) for a, b, kind in kept), key=lambda s: (MORE_KINDS.index(s[0]), s[1]))


@functools.lru_cache(maxsize=1)
def trained(count: int = 6000, seed: int = 3) -> Model:
    spans, texts, y = generated(count, seed, False)
    trees = boost(np.array([features(t, s) for s, t in zip(spans, texts, strict=True)]), y)
    spans, texts, held = generated(count // 2, seed + 1, True)
    x = np.array([features(t, s) for s, t in zip(spans, texts, strict=True)])
    raw = trees.raw(x)
    w = np.array([1.0, 0.0])
    z = np.stack([raw, np.ones(len(raw))], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (p - held) + 0.1 * (w - [1.0, 0.0]))
    model = Model(trees, float(w[0]), float(w[1]), {})
    p, kinds = model.probability(x), x[:, 0]
    for k, kind in enumerate(MORE_KINDS):
        order = np.argsort(-p[kinds == k], kind="stable")
        q, right = p[kinds == k][order], held[kinds == k][order]
        precise = np.flatnonzero(np.cumsum(right) >= PRECISION * np.arange(1, len(right) + 1))
        model.thresholds[kind] = max(0.5, float(q[precise[-1]])) if len(precise) else 1.1
    return model


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, the method's further spans)."""
    text = text or ""
    base = base_spans(text)
    return base, model.more_spans(text, base)


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def judge(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, the numbers of base spans, their digest, and all spans."""
    shared = documents.sparkSession.sparkContext.broadcast(trained())
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in RESULT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                rows = []
                for text in batch.column(1).slice(low, high - low).to_pylist():
                    base, more = find(text, shared.value)
                    counts = Counter(s[0] for s in base)
                    rows.append([*(counts[kind] for kind in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined([*base, *more])])
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], schema=schema)

    return small_batches(documents).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def redact(text: str | None, model: Model) -> str | None:
    """The text with each span, overlapping ones together, replaced by its kind in angle brackets."""
    if not text:
        return text
    base, more = find(text, model)
    if not base and not more:
        return text
    out, at, until = [], 0, 0
    for kind, a, b in sorted([*base, *more], key=lambda s: (s[1], -s[2])):
        if a >= until:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = until = max(until, b)
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame) -> DataFrame:
    """``documents``, all their columns, with texts redacted and n_chars, where there is one, counted anew for those changed."""
    shared = documents.sparkSession.sparkContext.broadcast(trained())
    place, count = documents.columns.index("text"), documents.columns.index("n_chars") if "n_chars" in documents.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(place)):
                columns = [c.slice(low, high - low) for c in batch.columns]
                old = columns[place].to_pylist()
                new = [redact(t, shared.value) for t in old]
                columns[place] = pa.array(new, columns[place].type)
                if count >= 0:
                    columns[count] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, columns[count].to_pylist(), strict=True)], columns[count].type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return small_batches(documents).mapInArrow(run, documents.schema)
