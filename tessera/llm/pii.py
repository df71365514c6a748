"""Personal data: patterns, and a semi-Markov conditional random field for what they miss.

The base patterns (e-mail, IP address, card, phone) are found first and always stay. The model then
reads the text's tokens (words, digit runs, other characters). A candidate segment of up to LONGEST tokens, no two of them more
than GAP characters apart, is scored as a whole: its shape with the lengths of its digit runs, checksums, the words around it. A
segment can be personal data only if it could be an address (a token, an at sign or the word "at", and after it a dot between letters or digits
or the word "dot") or a number (no letters; LEAST_DIGITS to MOST_DIGITS digits). A dynamic
program over these bounded segments chooses boundaries and types jointly. Where no candidate covers a token, its label
can only be "none", so the program runs over the stretches that candidates cover, each with the token after it, and
decides what it would over the whole text (tests compare them). Segments of a type that touch no base span are added.

The model is trained here: maximum likelihood by stochastic gradient on EXAMPLES labelled lines that a
seeded generator writes (spelled-out addresses, national phone formats, grouped cards, and numbers
that are none of these: dates, versions, prices, failing checksums).

Defined results: null or empty texts have no spans; repeated rows have equal results; null ids are kept; an
empty table gives an empty table; other columns are ignored. Base matching is linear in the text, and so is the
model's work: a token begins at most LONGEST candidates, and only back pointers are kept.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import id_and_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LONGEST = 18
GAP = 2
LEAST_DIGITS, MOST_DIGITS = 7, 19
REMEMBERED = 20_000
TIE = 1e-9  # scores nearer than this are equal: the first label stays, wherever the sums began
EXAMPLES = 800
EPOCHS = 3
SEED = 7
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does: every later place in the run fails alike
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Every candidate holds one of these: an at sign or word, or LEAST_DIGITS digits with no letter between.
_SEED = re.compile(r"@|(?<![^\W\d_])[aA][tT](?![^\W\d_])|(?:[0-9][\W_]*){%d}" % LEAST_DIGITS)
_AT_WORD = re.compile(r"(?<![^\W\d_])at(?![^\W\d_])")
_DOT_WORD = re.compile(r"(?<![^\W\d_])dot(?![^\W\d_])")
_DOT_INSIDE = re.compile(r"[^\W_]\.[^\W_]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\s]")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by start, then kind as listed."""
    found: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


#: Top-level domains that speak for an address. Fixed values.
DOMAINS = frozenset("com org net edu gov io info biz co uk de fr es it nl ch at be se no dk pl ru cn jp in br au ca us eu".split())
#: Words that announce a kind. Fixed values.
CUES = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "pay", "account"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}
_CUE = {w: k for k, words in CUES.items() for w in words}


class Tokens:
    """Tokens of a text, or of a part of it that ends at spaces, and running sums that tell what a segment holds."""

    def __init__(self, text: str, lo: int = 0, hi: int | None = None) -> None:
        self.text, self.spans = text, [m.span() for m in _TOKEN.finditer(text, lo, len(text) if hi is None else hi)]
        self.words = [text[a:b] for a, b in self.spans]
        n = len(self.words)
        kind = np.fromiter((0 if "0" <= w[0] <= "9" else 1 if w[0].isalnum() else 2 for w in self.words), np.int8, n)
        starts, ends = np.array(self.spans, np.int64).reshape(-1, 2).T
        glued = np.append(starts[1:] == ends[:-1], False) if n else np.zeros(0, bool)
        single = {"@": 1, "at": 1, "dot": 2, ".": 3}
        mark = np.fromiter((single.get(w if len(w) == 1 else w.lower(), 0) if len(w) < 4 else 0 for w in self.words), np.int8, n)
        inside = np.zeros(n, bool)
        if n > 2:
            inside[1:-1] = (mark[1:-1] == 3) & glued[:-2] & glued[1:-1] & (kind[:-2] < 2) & (kind[2:] < 2)
        upto = lambda x: np.append(0, np.cumsum(x, dtype=np.int64)).tolist()
        self.letters, self.digits = upto(kind == 1), upto(np.where(kind == 0, ends - starts, 0))
        self.ats, self.dots = upto(mark == 1), upto((mark == 2) | inside)
        places = np.flatnonzero(mark == 1)
        #: The first at sign or word from token k on.
        self.next_at = np.append(places, n + 1)[np.searchsorted(places, np.arange(n + 2))].tolist()
        self.first = [k == 0 or k == 1 or w in "+([" for k, w in zip(kind.tolist(), self.words, strict=True)]
        self.last = (kind < 2).tolist()
        self.alnum = self.last
        #: The first token after k that a segment from k can't reach.
        far = np.flatnonzero(np.append(False, starts[1:] - ends[:-1] > GAP)) if n else np.zeros(0, np.int64)
        stop = np.append(far, n)[np.searchsorted(far, np.arange(n), side="right")]
        self.stop = np.minimum(stop, np.arange(n) + LONGEST).tolist()
        self.glued = glued.tolist()

    def possible(self, i: int, j: int) -> bool:
        """Whether tokens i to j could be personal data."""
        if not self.last[j - 1]:
            return False
        at = self.next_at[i + 1]
        if at < j - 1 and self.dots[j] > self.dots[at + 1]:
            return True
        digits = self.digits[j] - self.digits[i]
        return self.letters[j] == self.letters[i] and LEAST_DIGITS <= digits <= MOST_DIGITS

    def candidates(self, i: int) -> list[int]:
        """Ends of the segments from token i."""
        stop = self.stop[i]
        if not self.first[i] or (self.digits[stop] - self.digits[i] < LEAST_DIGITS and self.ats[stop] == self.ats[i]):
            return []
        return [j for j in range(i + 1, stop + 1) if self.possible(i, j)]

    def none_key(self, k: int) -> tuple:
        w = self.words[k]
        return ("digits" if "0" <= w[0] <= "9" else "word" if w[0].isalnum() else w, min(len(w), 12), w.lower() in ("at", "dot", "@"))

    def segment_key(self, i: int, j: int) -> tuple:
        before = self.words[i - 1].lower() if i else ""
        if before == ":" and i > 1:
            before = self.words[i - 2].lower()
        touches = lambda k: k > 0 and self.glued[k - 1] and self.alnum[k - 1] and self.alnum[k]
        return self.text[self.spans[i][0] : self.spans[j - 1][1]], j - i, _CUE.get(before, "other"), touches(i), j < len(self.words) and touches(j)

    def stretches(self) -> Iterator[tuple[int, int, dict[int, list[int]]]]:
        """(from, to, ends of the candidates by their start) of the stretches that candidates cover, each with the token after it."""
        n, k = len(self.words), 0
        while k < n:
            own = self.candidates(k)
            if not own:
                k += 1
                continue
            lo, hi, ends = k, own[-1], {k: own}
            k += 1
            while k <= hi and k < n:  # a candidate right behind follows on the label before it
                if own := self.candidates(k):
                    ends[k], hi = own, max(hi, own[-1])
                k += 1
            yield lo, min(n, hi + 1), ends
            k = hi + 1


def none_features(kind: str, length: int, spelled: bool) -> list[str]:
    return ["none", f"one-{kind}", f"long{length if kind == 'digits' else 0}", f"spelled{spelled}"]


def features(s: str, n: int, cue: str, glued_before: bool, glued_after: bool) -> list[str]:
    """What is true of the segment s of n tokens, as names."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    runs = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 9)), re.sub(r"[^\W\d_]+", "a", s))
    out = [f"digits{min(len(digits), 20)}", f"tokens{min(n, 12)}", f"before-{cue}", f"glued{glued_before:d}{glued_after:d}"]
    out.append("shape" + re.sub(r"[0-9]", "9", runs)[:24])
    if digits and "a" not in runs:
        out.append("runs" + runs[:24])
        if 14 <= len(digits) <= 19:
            out.append(f"luhn{luhn(digits):d}{'.' in s:d}")
    parts = s.split(".")
    if len(parts) == 4 and all("0" <= c <= "9" for p in parts for c in p) and all(0 < len(p) < 4 for p in parts):
        out.append(f"quad{all(int(p) <= 255 for p in parts):d}")
    low = s.lower()
    at = s.count("@") + len(_AT_WORD.findall(low))
    dot = len(_DOT_WORD.findall(low)) + len(_DOT_INSIDE.findall(s))
    if at:
        out.append(f"domain{low.rpartition('.')[2].rpartition(' ')[2] in DOMAINS:d}")
    out += [f"at{min(at, 2)}dot{min(dot, 2)}", f"ends{s[0].isalnum():d}{s[-1].isalnum():d}", f"inside{'@' in s and ' ' in s:d}"]
    return out


class Lattice:
    """All candidate segments of a text, for training: ends, label sets and feature numbers."""

    def __init__(self, tokens: Tokens, number) -> None:
        self.n = len(tokens.words)
        self.segments: list[tuple[int, int]] = []
        self.kinds: list[bool] = []
        self.rows: list[list[int]] = []
        for i in range(self.n):
            for j, names in [(i + 1, none_features(*tokens.none_key(i))), *((j, None) for j in tokens.candidates(i))]:
                self.segments.append((i, j))
                self.kinds.append(names is None)
                self.rows.append([x for x in map(number, names or features(*tokens.segment_key(i, j))) if x is not None])
        self.ending: list[list[int]] = [[] for _ in range(self.n + 1)]
        for k, (_, j) in enumerate(self.segments):
            self.ending[j].append(k)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """[segment, label]; a label that a segment can't have is minus infinity."""
        out = np.full((len(self.rows), len(LABELS)), -np.inf)
        for k, (row, kind) in enumerate(zip(self.rows, self.kinds, strict=True)):
            total = weights[row].sum(0)
            if kind:
                out[k, 1:] = total[1:]
            else:
                out[k, 0] = total[0]
        return out

    def gradient(self, weights: np.ndarray, moves: np.ndarray, truth: list[tuple[int, int, int]], rate: float) -> float:
        """One step uphill on the log-likelihood of truth; returns it."""
        score, n = self.scores(weights), self.n
        alpha, beta = np.full((n + 1, len(LABELS)), -np.inf), np.full((n + 1, len(LABELS)), -np.inf)
        alpha[0, 0] = 0
        beta[n] = 0
        summed = lambda x, axis: np.logaddexp.reduce(x, axis)
        for j in range(1, n + 1):
            parts = [summed(alpha[self.segments[k][0]][:, None] + moves, 0) + score[k] for k in self.ending[j]]
            alpha[j] = summed(np.array(parts), 0)
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, _) in enumerate(self.segments):
            starting[i].append(k)
        for i in range(n - 1, -1, -1):
            parts = [summed(moves + (score[k] + beta[self.segments[k][1]])[None, :], 1) for k in starting[i]]
            beta[i] = summed(np.array(parts), 0)
        total = summed(alpha[n], 0)
        gold = {(i, j): y for i, j, y in truth}
        value, y0 = -total, 0
        for i, j, y in truth:
            k = next(k for k in self.ending[j] if self.segments[k][0] == i and self.kinds[k] == bool(y))
            value += score[k, y] + moves[y0, y]
            moves[y0, y] += rate
            y0 = y
        step = np.zeros_like(moves)
        for k, (i, j) in enumerate(self.segments):
            joint = np.exp(alpha[i][:, None] + moves_of(moves, truth, rate) + (score[k] + beta[j])[None, :] - total)
            step -= joint
            up = -joint.sum(0)
            if self.kinds[k] == bool(gold.get((i, j), -1) > 0) and (i, j) in gold:
                up[gold[i, j]] += 1
            if np.abs(up).max() > 1e-4:
                weights[self.rows[k]] += rate * up
        moves += rate * step
        return float(value)


class Trained:
    """Feature numbers, weights [feature, label] and label-to-label weights; scores of segments met before are at hand."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.names, self.weights, self.moves = names, weights, moves
        self.met: dict[tuple, np.ndarray] = {}

    def __reduce__(self):
        return Trained, (self.names, self.weights, self.moves)

    def score(self, key: tuple, names: Callable[..., list[str]]) -> np.ndarray:
        found = self.met.get(key)
        if found is None:
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            found = self.met[key] = self.weights[[x for x in map(self.names.get, names(*key)) if x is not None]].sum(0)
        return found


def decode(tokens: Tokens, lo: int, hi: int, ends: dict[int, list[int]], trained: Trained) -> list[tuple[int, int, int]]:
    """The segmentation of greatest score of tokens lo to hi, entered from "none": (first token, end, label) in order."""
    moves, n = trained.moves, hi - lo
    top, back = np.full((n + 1, len(LABELS)), -np.inf), np.zeros((n + 1, len(LABELS), 2), np.int32)
    top[0, 0] = 0
    for i in range(n):
        through = top[i][:, None] + moves
        before = (through >= through.max(0) - TIE).argmax(0)
        through = through[before, range(len(LABELS))]
        v = through[0] + trained.score(tokens.none_key(lo + i), none_features)[0]
        if v > top[i + 1, 0] + TIE:
            top[i + 1, 0], back[i + 1, 0] = v, (i, before[0])
        for end in ends.get(lo + i, ()):
            j = end - lo
            score = through[1:] + trained.score(tokens.segment_key(lo + i, end), features)[1:]
            better = np.flatnonzero(score > top[j, 1:] + TIE)
            top[j, better + 1] = score[better]
            back[j, better + 1, 0], back[j, better + 1, 1] = i, before[better + 1]
    out, j, y = [], n, int((top[n] >= top[n].max() - TIE).argmax())
    while j:
        i, last = back[j, y].tolist()
        out.append((lo + i, lo + j, y))
        j, y = i, last
    return out[::-1]


def moves_of(moves: np.ndarray, truth: list[tuple[int, int, int]], rate: float) -> np.ndarray:
    """moves as they were before the truth's own steps."""
    out, y0 = moves.copy(), 0
    for _, _, y in truth:
        out[y0, y] -= rate
        y0 = y
    return out


def example(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A generated line and the spans of personal data in it."""
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick(*"bcdfglmnprstv") + pick(*"aeiou", "é") for _ in range(rng.integers(1, 5)))
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    some = lambda: " ".join(word() + pick("", "", "", ",", ".") for _ in range(rng.integers(2, 6)))

    def card(good: bool) -> str:
        n = int(pick(15, 16, 16, 16, 19))
        body = pick("4", "5", "3", "6") + digits(n - 2)
        last = next(str(d) for d in range(10) if luhn(f"{body}{d}") == good)
        gap = pick("", " ", "-")
        return gap.join(re.findall(".{1,4}", body + last))

    def one() -> tuple[str, str]:
        kind = pick("email", "phone", "card", "ip", "not", "not", "not")
        host, end = word() + pick("", digits(1)), pick("com", "org", "net", "de", "example.com")
        if kind == "email":
            user = word() + pick("", "." + word(), digits(2), "." + digits(2))
            at, dot = pick("at", "at", "AT"), pick("dot", "dot", "DOT")
            return kind, pick(f"{user}@{host}.{end}", f"{user} {at} {host} {dot} {end}", f"{user} ({at}) {host} ({dot}) {end}", f"{user}[{at}]{host}.{end}", f"{user} @ {host}.{end}").replace("example.com", pick("example.com", "com"))
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return kind, pick(f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b}{c}", f"{a} {b} {c}")
        if kind == "card":
            return kind, card(True)
        if kind == "ip":
            return kind, ".".join(str(x) for x in rng.integers(0, 256, 4))
        y, m, d = f"{rng.integers(1900, 2100)}", f"{rng.integers(1, 13):02d}", f"{rng.integers(1, 29):02d}"
        return kind, pick(
            f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{m}/{d}/{y}", f"{y}-{m}-{d} 10:{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", digits(int(rng.integers(5, 14))), digits(int(rng.integers(20, 30))), card(False),
            f"{y}-{y}", f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}", f"{digits(3)}.{digits(3)}.{digits(3)}.999", f"{digits(4)} {digits(4)}", f"{y} {y} {y}", f"@{word()}", f"{word()} at {word()}", f"{word()} at {word()}.{word()}x", f"{digits(3)}.{digits(2)} {word()} at {digits(2)}.{digits(2)}", f"{word()} @ {digits(1)}.{digits(2)}", f"{word()} at {y}-{m}-{d} {word()} {digits(1)}.{digits(1)}", f"{digits(2)} dot {word()}",
            "".join(pick(*"0123456789abcdef") for _ in range(32)), f"password={digits(6)}{pick(*'abcdef')}{digits(5)}", f"{digits(3)}-{digits(5)}-{digits(2)}", f"{digits(6)}-{digits(6)}", f"{digits(2)}:{digits(2)}:{digits(2)}",
        )

    text, spans = some(), []
    for _ in range(int(rng.integers(1, 3))):
        kind, value = one()
        text += " "
        if kind != "not":
            text += pick("", "", "", pick(*CUES[kind]) + pick(" ", ": "))
            spans.append((len(text), len(text) + len(value), kind))
        text += value + pick(" ", " ", ", ", ". ") + some()
    return text, spans


@lru_cache(maxsize=1)
def model() -> Trained:
    """The model, trained on generated lines."""
    rng = np.random.default_rng(SEED)
    names: dict[str, int] = {}
    lattices = []
    for _ in range(EXAMPLES):
        text, spans = example(rng)
        tokens = Tokens(text)
        found = tokens.spans
        lattice = Lattice(tokens, lambda x: names.setdefault(x, len(names)))
        begins, ends = {a: k for k, (a, _) in enumerate(found)}, {b: k + 1 for k, (_, b) in enumerate(found)}
        truth, at = [], 0
        for a, b, kind in spans:
            if a not in begins or b not in ends or ends[b] - begins[a] > LONGEST:
                break
            truth += [(k, k + 1, 0) for k in range(at, begins[a])] + [(begins[a], ends[b], LABELS.index(kind))]
            at = ends[b]
        else:
            known = {(*s, k) for s, k in zip(lattice.segments, lattice.kinds, strict=True)}
            truth += [(k, k + 1, 0) for k in range(at, len(found))]
            if all((i, j, bool(y)) in known for i, j, y in truth):
                lattices.append((lattice, truth))
    weights, moves = np.zeros((len(names), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(lattices)):
            lattices[k][0].gradient(weights, moves, lattices[k][1], 0.2 / (1 + epoch))
    return Trained(names, weights, moves)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Parts of the text around its seeds: as many words to each side as a candidate and its context can reach."""
    lo = hi = -1
    for m in _SEED.finditer(text):
        if m.start() >= hi:
            begin = m.start()
            for _ in range(LONGEST + 3):
                begin = max(0, text.rfind(" ", 0, begin))
            if begin >= hi:
                if hi >= 0:
                    yield lo, hi
                lo = begin
        if hi == len(text):
            continue
        hi = m.end() - 1
        for _ in range(LONGEST + 3):
            hi = text.find(" ", hi + 1)
            if hi < 0:
                hi = len(text)
                break
    if hi >= 0:
        yield lo, hi


def added_spans(text: str, base: list[Span], trained: Trained) -> list[Span]:
    """What the model finds beside the base spans."""
    out, starts, furthest = [], [s for s, _, _ in base], [0, *accumulate((e for _, e, _ in base), max)]
    for start, stop in regions(text):
        tokens = Tokens(text, start, stop)
        for lo, hi, ends in tokens.stretches():
            for i, j, y in decode(tokens, lo, hi, ends, trained):
                a, b = tokens.spans[i][0], tokens.spans[j - 1][1]
                if y and furthest[bisect_left(starts, b)] <= a:
                    out.append((a, b, LABELS[y]))
    return out


def rows_of(text: str, trained: Trained) -> tuple:
    base = base_spans(text)
    more = added_spans(text, base, trained)
    spelled = lambda spans: ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
    everything = sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))
    return (*(sum(s[2] == k for s in base) for k in KINDS), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(everything), len(more))


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of SCHEMA for each row of df."""
    shared = df.sparkSession.sparkContext.broadcast(model())
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in SCHEMA.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [rows_of(x.as_py().decode("utf-8", "replace"), shared.value) for x in b.column(1)]
            columns = list(zip(*found, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return id_and_text(df, id_col, text_col).mapInArrow(rows, SCHEMA)
