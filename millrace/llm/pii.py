"""Personal data: checked patterns, and a BiLSTM-CRF over characters.

Base spans are e-mail addresses, IP numbers, payment cards and phone numbers
found by pattern and check. The tagger finds what the patterns miss: the same
things disguised or written otherwise (``x (at) y [dot] z``, spaced numbers,
other separators, phones without ``+``). It is trained in numpy on the driver
from windows around labelled base spans, a sample bounded by ``TRAIN_WINDOWS``
rows of least hash over all windows of all texts. Its spans are rewritten
(``disguise``) and look-alikes (versions, dates, order numbers) are put beside
them, so it meets both. The least posterior that keeps precision on held-out
windows is its threshold. What it weighs is some thousand numbers, sent with
the task.

It reads windows around every digit, ``@``, bracketed ``at`` and ``dot`` (no
kind can do without one, so no text is left out), half of each overlapping the
next; all windows are decoded, and the spans of all of a text's windows are
reconciled by the best-scored set that doesn't overlap. A model span is added,
under the names ``lstm_...``, when its mean posterior reaches the threshold, it
passes its kind's check (``plausible``) and touches no base span.

Narrow: one pass for the training windows, one for the spans, no shuffle. Null
and empty texts have no spans; a very long text costs time in proportion to its
windows; repeated rows get equal spans; ties between overlapping spans go to
the set found first from the left. Without any training window (empty tables
too) only base spans are found. Further columns aren't read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import Tagger, encode
from .secrets import SPANS, spans_array
from .tables import stored
from .textkit import LOWER, buffers, slices

KINDS = ("email", "ip", "card", "phone")
ORDER = (*KINDS, *(f"lstm_{k}" for k in KINDS))
#: Tags: outside, then begin and inside of each kind.
N_TAGS = 1 + 2 * len(KINDS)
WINDOW, STEP = 128, 64
#: Bound on the labelled windows that the tagger is fitted on, half of them without spans; variants of each; steps of training.
TRAIN_WINDOWS, VARIANTS, STEPS = 1200, 6, 600
#: Precision that the threshold must keep on held-out windows, and the thresholds tried.
PRECISION, POSTERIORS = 0.98, (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98)

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = r"[\[({] ?at ?[\])}]| dot |[\[({] ?dot ?[\])}]"
_TRIGGERS = re.compile(rf"[0-9@]+|{_MARK}", re.IGNORECASE)
_MARKS = re.compile(_MARK.encode())
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_AT, _DOT = re.compile(r"\s*(?:[\[({]\s?at\s?[\])}]|\sat\s|@)\s*", re.IGNORECASE), re.compile(r"\s*(?:[\[({]\s?(?:dot|\.)\s?[\])}]|\sdot\s|\s\.\s|\.)\s*", re.IGNORECASE)
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[0x40, *range(0x30, 0x3A)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern would find them from left to right, in linear time: from each ``@`` outwards."""
    end, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            yield a, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """The spans that pass their checks, sorted, and the candidates that don't."""
    found, failed = [("email", a, b) for a, b in _emails(text)], []

    def put(kind: str, m: re.Match, good: bool) -> None:
        if good:
            found.append((kind, m.start(), m.end()))
        else:
            failed.append((m.start(), m.end()))

    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        put("ip", m, all(len(p) <= 3 and int(p or "0") <= 255 for p in parts))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        put("card", m, 12 <= len(digits) <= 19 and luhn(digits))
    for m in _PHONE.finditer(text):
        put("phone", m, 9 <= sum(map(str.isdigit, m[0])) <= 15)
    return sorted(found, key=lambda s: (s[1], ORDER.index(s[0]))), failed


def plausible(kind: str, s: str) -> bool:
    """Whether a span can be of its kind at all: the patterns' checks on what it says without its disguise."""
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        return _EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", s))) is not None
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and re.sub(r"[0-9\s.,\[\](){}_-]", "", s).lower() in ("", "dot", "dotdot", "dotdotdot")
    if re.search(r"[^0-9\s().+/_,–-]", s):
        return False
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows that together hold every trigger with context on both sides."""
    starts: list[int] = []
    for m in _TRIGGERS.finditer(text):
        a, b = max(0, m.start() - STEP), m.end() + STEP // 2
        at = a - a % STEP
        if starts and at <= starts[-1]:
            at = starts[-1] + STEP
        while at < b:
            starts.append(at)
            at += STEP
    return starts


# --- training ----------------------------------------------------------------


def disguise(kind: str, s: str, r: random.Random) -> str:
    """The span rewritten as the patterns don't find it."""
    if kind == "email":
        local, domain = s.split("@", 1)
        dot = r.choice([" dot ", " (dot) ", "(dot)", "[dot]", " [dot] ", "[.]", " . ", "{dot}", "."])
        at = r.choice([" (at) ", "(at)", "[at]", " [at] ", "{at}", " at ", " @ "] if dot != "." else [" (at) ", "(at)", "[at]", " [at] ", "{at}", " @ "])
        if r.random() < 0.3:
            local = r.choice(_NAMES) + r.choice(["", "." + r.choice(_NAMES), "_" + str(r.randint(1, 99))])
        if r.random() < 0.3:
            domain = r.choice(_NAMES) + r.choice([".com", ".org", ".net", ".de", ".co.uk", ".edu"])
        s = local + at + domain.replace(".", dot)
        return s.upper() if r.random() < 0.15 else s
    if kind == "ip":
        return s.replace(".", r.choice(["[.]", "(.)", " . ", " dot ", "[dot]", "(dot)", " [.] "]))
    digits = re.sub("[^0-9]", "", s)
    if kind == "card":
        by = r.choice([".", "_", "/", " - ", "  ", " . ", "--"])
        cuts = [4, 10] if len(digits) == 15 or r.random() < 0.15 else range(4, len(digits), 4)
        return by.join(digits[a:b] for a, b in zip([0, *cuts], [*cuts, len(digits)], strict=True))
    own = digits[-10:] if len(digits) >= 10 else digits
    a, b, c = own[:-7], own[-7:-4], own[-4:]
    form = r.choice(["({}) {}-{}", "({}){}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "{}/{}-{}", "1-{}-{}-{}", "1 ({}) {}-{}", "001 {} {} {}", "00 1 {} {} {}", "+1/{}/{}-{}", "{} {}-{}", "tel:{}-{}-{}"])
    return form.format(a, b, c).removeprefix("tel:")


#: Parts of names in made-up addresses.
_NAMES = ("anna", "info", "mueller", "jdoe", "contact", "maria", "lopez", "sales", "peter", "office", "webmaster", "nguyen", "smith", "team", "acme", "initech", "mail", "post", "uni", "shop")


def look_alike(r: random.Random) -> str:
    """Numbers and words that are none of the kinds."""
    n = lambda k: "".join(r.choices("0123456789", k=k))
    return r.choice([
        lambda: f"{r.randint(1, 20)}.{r.randint(0, 30)}.{r.randint(0, 99)}", lambda: f"v{r.randint(1, 9)}.{r.randint(0, 9)}", lambda: f"{r.randint(1950, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
        lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1950, 2030)}", lambda: f"{r.randint(1, 12)}/{r.randint(1, 28)}/{r.randint(1950, 2030)}", lambda: f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}",
        lambda: f"{r.randint(1950, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{r.randint(0, 59):02}", lambda: f"{r.choice(['ORD', 'INV', 'No.', 'ref', 'ID', 'Az.', '#'])}{r.choice(['-', ' ', ''])}{n(r.randint(3, 6))}-{n(r.randint(3, 7))}",
        lambda: f"{r.choice(['ORD', 'INV', 'ticket', 'case'])}-{r.randint(1990, 2030)}-{n(6)}", lambda: n(r.randint(1, 11)), lambda: f"{n(r.randint(1, 6))}.{n(r.randint(1, 6))}", lambda: f"{r.randint(1, 999)},{n(3)},{n(3)}", lambda: f"${r.randint(1, 999)},{n(3)}.{n(2)}", lambda: f"pp. {r.randint(100, 900)}-{r.randint(100, 999)}",
        lambda: f"978-{r.randint(0, 9)}-{n(2)}-{n(6)}-{r.randint(0, 9)}", lambda: f"{n(4)}/{n(4)}", lambda: f"{n(3)}.{n(3)}.{n(3)}.{n(3)}.{n(3)}", lambda: f"{r.randint(256, 999)}.{n(3)}.{n(2)}.{n(1)}", lambda: f"{r.randint(1, 99)} % of {r.randint(100, 9999)}", lambda: f"{n(3)} {n(3)}", lambda: f"@{r.choice(_NAMES)}", lambda: "(at home)", lambda: f"meet at {r.randint(1, 12)} dot",
        lambda: f"the dot of {r.choice(_NAMES)}", lambda: f"{r.choice(_NAMES)} dot product {r.choice(_NAMES)}", lambda: f"[{r.randint(1, 99)}] ({r.randint(1950, 2030)})", lambda: "".join(r.choices("0123456789abcdef", k=r.randint(8, 40))), lambda: f"{n(2)}-{n(2)}-{n(2)}", lambda: f"{r.randint(1, 90)}.{n(5)}, -{r.randint(1, 90)}.{n(5)}",
    ])()


def variant(text: str, found: list[Span], r: random.Random) -> tuple[str, list[Span]]:
    """The text with spans disguised or as they are, and look-alikes between words."""
    parts, spans, size, end = [], [], 0, 0

    def put(s: str) -> None:
        nonlocal size
        parts.append(s)
        size += len(s)

    hide = r.random() < 0.75
    for kind, a, b in found:
        if a < end:
            continue
        gap = text[end:a]
        at = gap.rfind(" ", 0, max(1, int(len(gap) * r.random())))
        if at >= 0 and r.random() < 0.5:
            put(f"{gap[:at]} {look_alike(r)}")
            gap = gap[at:]
        put(gap)
        own = disguise(kind, text[a:b], r) if hide and r.random() < 0.9 else text[a:b]
        spans.append((kind, size, size + len(own)))
        put(own)
        end = b
    rest = text[end:]
    at = rest.find(" ", int(len(rest) * r.random()))
    if at >= 0 and r.random() < 0.7:
        put(f"{rest[:at]} {look_alike(r)}")
        rest = rest[at:]
    put(rest)
    return "".join(parts), spans


def _padded(codes: np.ndarray, starts: list[int]) -> np.ndarray:
    out = np.zeros((len(starts), WINDOW), np.int64)
    for k, a in enumerate(starts):
        own = codes[a : a + WINDOW]
        out[k, : len(own)] = own
    return out


def tags(found: list[tuple[str, int, int]], start: int) -> list[int]:
    """Tags of one window; a span that the window cuts is tagged as far as it goes."""
    out, end = [0] * WINDOW, 0
    for kind, a, b in found:
        if a < end or a >= start + WINDOW or b <= start:
            continue
        k = 1 + 2 * KINDS.index(kind)
        for i in range(max(a, start), min(b, start + WINDOW)):
            out[i - start] = k if i == a else k + 1
        end = b
    return out


def triggered(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """Index and text of those that hold a trigger."""
    data, offsets = buffers(texts)
    at = np.concatenate([np.flatnonzero(_TRIGGER[data]), np.array([m.start() for m in _MARKS.finditer(LOWER[data].tobytes())], np.int64)])
    if len(at):
        for k in np.unique(np.searchsorted(offsets, at, "right") - 1):
            yield int(k), data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")


def shapes(text: str) -> list[Span]:
    """What the tagger is to learn: base spans without overlap, and digits shaped like a card whatever their check digit, which a tagger can't compute."""
    found, failed = base_spans(text)
    for a, b in failed:
        if _CARD.fullmatch(text[a:b]) and 13 <= len(re.sub("[^0-9]", "", text[a:b])) <= 16:
            found.append(("card", a, b))
    out: list[Span] = []
    for s in sorted(found, key=lambda s: (s[1], -s[2])):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def training_windows(docs: DataFrame, text: str = "text", most: int = TRAIN_WINDOWS) -> DataFrame:
    """(held, text, spans) of ``most`` windows at most, half of them with spans: those of least hash."""
    half = -(-most // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                best: dict[bool, dict[int, tuple[str, list[Span]]]] = {True: {}, False: {}}
                for _, t in triggered(b.column("text")):
                    found = shapes(t)
                    for at in windows(t):
                        a, e = max(0, at - STEP // 2), at + WINDOW + STEP // 2
                        own = [(k, x - a, y - a) for k, x, y in found if x >= a and y <= e]
                        if any(x < a < y or x < e < y for _, x, y in found):
                            continue  # it would be cut; another window holds it whole
                        best[bool(own)][xxhash.xxh3_64_intdigest(t[a:e]) >> 1] = (t[a:e], own)
                for held, rows in best.items():
                    rows = sorted(rows.items())[:half]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([held] * len(rows)), pa.array([h for h, _ in rows]), pa.array([t for _, (t, _) in rows]), spans_array([x for _, (_, x) in rows])], ["held", "hash", "text", "spans"])

    # stored first: what reaches the driver then grows with the stored table's few partitions, not with the tasks
    rows = stored(docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, f"held boolean, hash long, text string, spans {SPANS}"), "windows")
    some = [rows.where(F.col("held") == held).dropDuplicates(["hash"]).orderBy("hash", "text").limit(half) for held in (True, False)]
    return some[0].unionByName(some[1])


def examples(rows: list[tuple[str, list[Span]]], variants: int, seed: int) -> tuple[list[str], list[list[Span]], np.ndarray, np.ndarray]:
    """Texts, their spans, and windows and tags to learn from."""
    r = random.Random(seed)
    texts, spans, x, y = [], [], [], []
    for t, found in rows:
        for k in range(variants):
            own, at = variant(t, found, r) if k else (t, found)
            start = r.randint(0, max(0, len(own) - WINDOW))
            texts.append(own)
            spans.append(at)
            x.append(_padded(encode(own), [start])[0])
            y.append(tags(at, start))
    return texts, spans, np.array(x, np.int64), np.array(y, np.int64)


class Finder:
    """A tagger and its threshold."""

    def __init__(self, tagger: Tagger, least: float = POSTERIORS[-1]) -> None:
        self.tagger, self.least = tagger, least

    def measure(self, texts: list[str], spans: list[list[Span]], least: float) -> tuple[float, float]:
        """Precision and recall on texts with known spans."""
        found = model_spans(self.tagger, texts, least)
        right = sum(len(set(a) & set(b)) for a, b in zip(found, spans, strict=True))
        return right / max(1, sum(map(len, found))), right / max(1, sum(map(len, spans)))

    def choose(self, texts: list[str], spans: list[list[Span]]) -> Finder:
        for least in POSTERIORS:
            self.least = least
            if self.measure(texts, spans, least)[0] >= PRECISION:
                break
        return self


def fit_tagger(docs: DataFrame, text: str = "text", most: int = TRAIN_WINDOWS, steps: int = STEPS) -> Finder | None:
    """Learns from four of five sampled windows and chooses the threshold on the fifth."""
    rows = [(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in training_windows(docs, text, most).collect()]
    if not any(found for _, found in rows):
        return None
    inside = [r for k, r in enumerate(rows) if k % 5] or rows
    texts, spans, _, _ = examples([r for k, r in enumerate(rows) if not k % 5], 2, 5)
    _, _, x, y = examples(inside, VARIANTS, 3)
    valid = [[s for s in own if plausible(s[0], t[s[1] : s[2]])] for t, own in zip(texts, spans, strict=True)]
    return Finder(Tagger(N_TAGS).fit(x, y, steps)).choose(texts, valid)


def _window_spans(em: np.ndarray, best: np.ndarray, posterior: np.ndarray, starts: list[int], lengths: list[int], least: float) -> list[tuple[float, str, int, int]]:
    """Decoded spans of each window with their score; those cut by a window's edge inside the text are left to its neighbour."""
    out = []
    for w, start in enumerate(starts):
        n, t = min(WINDOW, lengths[w] - start), 0
        while t < n:
            k = best[t, w]
            if not k:
                t += 1
                continue
            kind, u = (k - 1) // 2, t + 1
            while u < n and best[u, w] == 2 * kind + 2:
                u += 1
            cut = (t == 0 and start > 0) or (u == n and start + n < lengths[w]) or k % 2 == 0
            sure = float(posterior[np.arange(t, u), w, best[t:u, w]].mean())
            if not cut and sure >= least:
                out.append((sure * (u - t), KINDS[kind], start + t, start + u))
            t = u
    return out


def reconcile(spans: list[tuple[float, str, int, int]]) -> list[tuple[float, str, int, int]]:
    """The set of spans without overlap whose scores sum highest."""
    own = sorted(set(spans), key=lambda s: (s[3], s[2], s[1]))
    ends = [s[3] for s in own]
    best: list[tuple[float, int]] = [(0.0, 0)]
    for k, (score, _, a, _) in enumerate(own):
        before = int(np.searchsorted(ends[:k], a, "right"))
        best.append(max((best[k][0], 0), (best[before][0] + score, k + 1)))
    out, k = [], len(own)
    while k:
        if best[k][1] == k and best[k][0] > best[k - 1][0]:
            out.append(own[k - 1])
            k = int(np.searchsorted(ends[: k - 1], own[k - 1][2], "right"))
        else:
            k -= 1
    return out[::-1]


def model_spans(tagger: Tagger, texts: list[str], least: float, batch: int = 512) -> list[list[Span]]:
    """The tagger's plausible spans of each text, reconciled."""
    jobs = [(k, a) for k, t in enumerate(texts) for a in windows(t)]
    codes = [encode(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    for at in range(0, len(jobs), batch):
        own = jobs[at : at + batch]
        em = tagger.emissions(np.concatenate([_padded(codes[k], [a]) for k, a in own]))
        best = tagger.decode(em)
        some = np.flatnonzero(best.any(0))
        if not len(some):
            continue
        _, posterior, _ = tagger.marginals(em[:, some])
        for j, w in enumerate(some):
            k, a = own[w]
            spans = _window_spans(em[:, w : w + 1], best[:, w : w + 1], posterior[:, j : j + 1], [a], [len(texts[k])], least)
            for score, kind, x, y in spans:
                s = texts[k][x:y]
                x, y = x + len(s) - len(s.lstrip()), y - len(s) + len(s.rstrip())  # a blank at an edge is not the span's
                if plausible(kind, texts[k][x:y]):
                    found[k].append((score, kind, x, y))
    return [[(k, a, b) for _, k, a, b in reconcile(x)] for x in found]


def find_pii(docs: DataFrame, id: str = "doc_id", text: str = "text", finder: Finder | None = None) -> DataFrame:
    """The id and ``spans`` (code points, end exclusive) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                out: list[list[Span]] = [[] for _ in range(len(b))]
                hit = list(triggered(b.column("text")))
                more = model_spans(finder.tagger, [t for _, t in hit], finder.least) if finder else [[] for _ in hit]
                for (k, t), extra in zip(hit, more, strict=True):
                    found, _ = base_spans(t)
                    added = [(f"lstm_{kind}", x, y) for kind, x, y in extra if not any(p < y and q > x for _, p, q in found)]
                    out[k] = sorted(found + added, key=lambda s: (s[1], ORDER.index(s[0])))
                yield pa.RecordBatch.from_arrays([b.column("id"), spans_array(out)], ["id", "spans"])

    d = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    return d.mapInArrow(run, f"id {d.schema['id'].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("id", id)


def detect_pii(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fits the tagger on ``docs`` and finds the spans of every row."""
    return find_pii(docs, id, text, fit_tagger(docs, text))


def count(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
