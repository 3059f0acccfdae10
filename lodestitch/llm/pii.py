"""Personal data in texts: fixed rules, and a character-level BiLSTM-CRF that adds what they miss.

Rules find e-mail and IP addresses, card and phone numbers (``base_spans``). They are greedy: a card next to
another number is one long chain of digits, a phone number swallows an address behind it, and what then fails
its check is dropped. The tagger (:mod:`pii_model`) is trained on the driver from labelled spans: at most
``FIT_WINDOWS`` windows around the rules' own finds and as many plain ones, from at most about ``FIT_DOCS`` documents, and
planted spans of further forms. Its weights (some 12 kB) go to the tasks, where every text is cut into
windows of ``WINDOW`` characters that overlap by ``OVERLAP``, whatever its length; each is decoded by itself.

Reconciliation is global in a text: finds of all its windows are put at their places, one cut by a window's
edge is united with those of its kind that it overlaps or touches, of contradicting ones the set with the largest summed
gain stays, and what overlaps a rule's find goes. A find must have ``LEAST_GAIN`` over "outside", stand
free of letters and digits, and pass its kind's check (at most 255 in an address, 12 to 19 digits and Luhn, 9 to 15 digits);
of a chain of digits that fails, the runs of groups that pass are taken.

Defined results: a null text is empty and has no spans; ties and repeated rows are judged alike, each row by
itself; an empty table gives no rows; other columns are not read. Offsets are code points, ends exclusive. The
counts and the digest are of the rules' finds, ``spans`` has all.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii_model
from .pii_model import KINDS, Tagger

WINDOW = 512
OVERLAP = 64
#: Windows that are run through the tagger at once.
TOGETHER = 512
LEAST_GAIN = 4.0
FIT_DOCS = 4096
FIT_WINDOWS = 512
FIT_LENGTH = 64
PLANTED = 2048
EPOCHS = 10

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: What a find of the tagger must look like.
_FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+(?:@| ?[(\[]at[)\]] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(?:\.[0-9]+){3}"),
    re.compile(r"[0-9](?:[\x20.-]?[0-9])+"),
    re.compile(r"(?:\+?[0-9]|\()[\x20().0-9-]+[0-9]"),
)
_FREE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _small_parts(address: str) -> bool:
    return all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in address.split(".")))


def _card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", text)) <= 15


_CHECKS = (lambda text: True, _small_parts, _card, _phone)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the rule's expression finds them, from the signs backwards: linear in any text."""
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            last = m.end()
            yield start, last


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of all matches of the rules' expressions, before their checks."""
    for s, e in _emails(text):
        yield 0, s, e
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    return sorted((s, k, e) for k, s, e in matches(text) if _CHECKS[k](text[s:e]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---- Training -----------------------------------------------------------------------


def _tags(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int8)
    for kind, s, e in spans:
        s, e = max(s, 0), min(e, length)
        if s < e:
            out[s:e] = 2 + 2 * kind
            out[s] = 1 + 2 * kind
    return out


def _cuts(text: str, rng: random.Random) -> Iterator[tuple[bool, str, bytes]]:
    """(with spans, window, tags): at most four windows around a text's finds, and a plain one. Windows with
    numbers that only a check refused are left out, since no character tells them from good ones."""
    found = base_spans(text)
    kept = {(k, s, e) for s, k, e in found}
    unsure = [(s, e) for k, s, e in matches(text) if (k, s, e) not in kept and k and sum(c.isdigit() for c in text[s:e]) >= 9]
    starts = [(True, s - rng.randrange(FIT_LENGTH - 4)) for s, _, _ in rng.sample(found, min(4, len(found)))]
    starts.append((False, rng.randrange(max(1, len(text) - FIT_LENGTH + 1))))
    for wanted, at in starts:
        at = max(0, min(at, len(text) - FIT_LENGTH))
        end = at + FIT_LENGTH
        near = [(k, s - at, e - at) for s, k, e in found if s < end and e > at]
        if text[at:end] and not any(s < end and e > at for s, e in unsure) and wanted == bool(near):
            yield wanted, text[at:end], _tags(len(text[at:end]), near).tobytes()


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*row, h) for h, text in zip(*(c.to_pylist() for c in batch.columns)) for row in _cuts(text, random.Random(h))]
        types = [pa.bool_(), pa.string(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, types)], names=["found", "window", "tags", "h"])


def labelled_windows(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS) -> tuple[list, list]:
    """(window, tags) around the rules' finds, and plain ones: at most ``fit_windows`` each, of the
    documents whose texts' hashes fall into a share of about ``fit_docs``."""
    texts = docs.select(F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    share = min(1.0, fit_docs / max(1, docs.count()))
    chosen = texts.where(F.pmod("h", F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    cut = chosen.mapInArrow(_sampled, "found boolean, window string, tags binary, h long")
    # The least of equal windows, so that the sample does not depend on arrival.
    once = cut.groupBy("found", "window").agg(F.min(F.struct("h", "tags")).alias("x")).select("found", "window", "x.h", "x.tags")
    first = lambda found: [(r["window"], np.frombuffer(bytes(r["tags"]), np.int8)) for r in once.where(F.col("found") == found).orderBy("h", "window").limit(fit_windows).collect()]
    return first(True), first(False)


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _grouped(rng: random.Random, digits: str, sign: str) -> str:
    return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))


def planted(kind: int, rng: random.Random) -> str:
    """A span of a kind, in forms that the rules know and further ones."""
    if kind == 0:
        local = rng.choice([_word(rng), f"{_word(rng)}.{_digits(rng, 2)}", f"{_word(rng)}_{_word(rng)}", f"{_word(rng).title()}.{_word(rng).title()}"])
        at, dot = rng.choice([("@", "."), ("@", "."), ("@", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] ")])
        host = dot.join(rng.choice([[_word(rng), "com"], [_word(rng) + _digits(rng, 1), _word(rng), "org"], [_word(rng), "co", "uk"]]))
        return local + at + host
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        digits = _digits(rng, rng.choice([12, 14, 15, 16, 16, 16, 16, 19]))
        digits = next(d for d in (digits[:-1] + c for c in "0123456789") if luhn(d))
        return rng.choice([digits, digits, _grouped(rng, digits, " "), _grouped(rng, digits, "-"), _grouped(rng, digits, ".")])
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    lead = rng.choice(["+1 ", "+1-", f"+{rng.randint(20, 99)} ", "+1 ", ""])
    return lead + rng.choice([f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}"])


def _decoy(rng: random.Random) -> str:
    """Digits and signs that are no personal data."""
    return rng.choice([
        "".join(rng.choice("0123456789abcdef") for _ in range(32)), f"{rng.randint(1990, 2030)}-{_digits(rng, 2)}-{_digits(rng, 2)}", f"{_digits(rng, 2)}:{_digits(rng, 2)}:{_digits(rng, 2)}",
        f"{rng.randint(1, 99)},{_digits(rng, 3)}.{_digits(rng, 2)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"#{_digits(rng, 6)}", f"{_digits(rng, 3)}", f"({rng.randint(1, 99)})",
        f"{_word(rng)}.{_word(rng)}", f"https://{_word(rng)}.{_word(rng)}.com/{_digits(rng, 4)}", f"@{_word(rng)}", f"ISBN {_digits(rng, 3)}-{_digits(rng, 1)}-{_digits(rng, 5)}", f"{_digits(rng, 5)}",
    ])


def _planted_window(plain: str, rng: random.Random) -> tuple[str, np.ndarray]:
    """A plain window with one or two spans or a decoy in it; two spans often stand side by side."""
    cut = rng.randrange(len(plain) + 1)
    before, after, spans = plain[:cut][-rng.randint(0, 40) :], plain[cut:], []
    text = before + rng.choice([" ", " ", " ", "\n", "", "(", ": "])
    if rng.random() < 0.3:
        text += _decoy(rng)
    else:
        for i in range(rng.choice([1, 1, 2])):
            text += rng.choice([" ", " ", ", ", " | "]) if i else ""
            kind = rng.randrange(len(KINDS))
            put = planted(kind, rng)
            spans.append((kind, len(text), len(text) + len(put)))
            text += put
    text += rng.choice([" ", " ", ". ", "\n", ""]) + after
    shift = max(0, min(len(text) - FIT_LENGTH, (spans[0][1] if spans else len(before)) - rng.randrange(FIT_LENGTH // 2)))
    text = text[shift : shift + FIT_LENGTH]
    return text, _tags(len(text), [(k, s - shift, e - shift) for k, s, e in spans])


def fit(docs: DataFrame) -> Tagger:
    """The tagger, trained on the driver from a bounded number of labelled windows."""
    found, plain = labelled_windows(docs)
    rng = random.Random(11)
    prose = [w for w, _ in plain if not any(c.isdigit() or c == "@" for c in w)] or [" ".join(_word(rng) for _ in range(12))[:FIT_LENGTH] for _ in range(64)]
    windows = found + plain + [_planted_window(rng.choice(prose), rng) for _ in range(PLANTED)]
    classes, tags = np.zeros((len(windows), FIT_LENGTH), np.int8), np.zeros((len(windows), FIT_LENGTH), np.int8)
    for i, (window, own) in enumerate(windows):
        classes[i, : len(window)] = pii_model.codes(window)
        tags[i, : len(own)] = own
    return pii_model.train(classes.astype(np.intp), tags.astype(np.intp), EPOCHS)


# ---- Finding ------------------------------------------------------------------------


def _windows(text: str) -> Iterator[tuple[int, bool, np.ndarray]]:
    """(place, whether it is the last, classes) of the overlapping windows of a whole text."""
    step, size = WINDOW - OVERLAP, 1 << 12
    at, held, base = 0, np.empty(0, np.int8), 0
    while True:
        if at + WINDOW > base + len(held) and base + len(held) < len(text):
            base, held = at, pii_model.codes(text[at : at + step * size + OVERLAP])
        last = at + WINDOW >= len(text)
        yield at, last, held[at - base : at - base + WINDOW]
        if last:
            return
        at += step


def _free(text: str, start: int, end: int) -> bool:
    return not (start and text[start - 1] in _FREE) and not (end < len(text) and text[end] in _FREE)


def _cards_within(part: str) -> Iterator[tuple[int, int]]:
    """Runs of a chain's groups of digits that are cards by themselves: what stands beside them failed the whole."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(part)]
    for i, (start, _) in enumerate(groups):
        for _, end in groups[i : i + 19]:
            if (i, end) != (0, len(part)) and end - start <= 37 and _card(part[start:end]):
                yield start, end


def reconcile(text: str, finds: list[tuple[int, int, int, float, bool]], base: list[Span]) -> list[Span]:
    """The spans to add, of all windows' finds (start, end, kind, gain, cut by an edge)."""
    joined: list[list] = []
    for start, end, kind, gain, cut in sorted(finds):
        other = next((x for x in reversed(joined[-8:]) if x[2] == kind and start <= x[1] and (cut or x[4]) and (start, end) != (x[0], x[1])), None)
        if other is None:
            joined.append([start, end, kind, gain, cut])
        else:
            other[1], other[3], other[4] = max(other[1], end), max(other[3], gain), other[4] or cut
    good = {}
    for start, end, kind, gain, _ in joined:
        s = text[start:end]
        start, end = start + len(s) - len(s.lstrip()), end - (len(s) - len(s.rstrip()))
        part = text[start:end]
        if gain >= LEAST_GAIN and _free(text, start, end) and _FORMS[kind].fullmatch(part):
            for s, e in [(0, len(part))] if _CHECKS[kind](part) else _cards_within(part) if kind == 2 else ():
                share = gain * (e - s) / len(part)
                good[start + s, start + e, kind] = max(share, good.get((start + s, start + e, kind), 0.0))
    taken: list[list[int]] = []
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    starts, open_ = [s for s, _ in taken], []
    for start, end, kind in good:
        at = bisect_left(starts, end) - 1
        if at < 0 or taken[at][1] <= start:
            open_.append((end, start, kind, good[start, end, kind]))
    # Weighted choice of spans that do not overlap, by their ends.
    open_.sort()
    best: list[tuple[float, int, bool]] = []  # sum, previous place, taken
    ends = [e for e, *_ in open_]
    for j, (end, start, kind, gain) in enumerate(open_):
        p = bisect_right(ends, start, 0, j) - 1
        with_it = gain + (best[p][0] if p >= 0 else 0.0)
        without = best[j - 1][0] if j else 0.0
        best.append((with_it, p, True) if with_it > without else (without, j - 1, False))
    added, j = [], len(open_) - 1
    while j >= 0:
        _, before, take = best[j]
        if take:
            end, start, kind, _ = open_[j]
            added.append((start, kind, end))
        j = before
    return sorted(added)


class _Doc:
    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.text = doc_id, text
        self.finds: list = []
        self.waiting, self.cut_up = 0, False


def _finder(model: Tagger, id_type: pa.DataType):
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]

    def row(doc: _Doc) -> tuple:
        base = base_spans(doc.text)
        added = reconcile(doc.text, doc.finds, base)
        counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
        return doc.doc_id, *counts, sha256(written(base).encode()).hexdigest(), written(sorted(base + added))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: deque[_Doc] = deque()
        held: list[tuple[_Doc, int, bool, np.ndarray]] = []

        def run() -> None:
            count = -(-len(held) // 64) * 64  # whole blocks: a window's result does not depend on its company
            windows = np.zeros((count, WINDOW), np.int8)
            for i, (*_, classes) in enumerate(held):
                windows[i, : len(classes)] = classes
            for w, s, e, kind, gain in model.spans(np.ascontiguousarray(windows.T)):
                if w < len(held):
                    doc, at, last, classes = held[w]
                    cut = (s == 0 and at > 0) or (e == WINDOW and not last)
                    doc.finds.append((at + s, at + min(e, len(classes)), kind, gain, cut))
            for doc, *_ in held:
                doc.waiting -= 1
            held.clear()

        def ready(all_: bool = False) -> Iterator[pa.RecordBatch]:
            rows = []
            while docs and docs[0].cut_up and not docs[0].waiting:
                rows.append(row(docs.popleft()))
            if rows:
                types = [id_type, *[pa.int64()] * 4, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                doc = _Doc(doc_id, text or "")
                docs.append(doc)
                for at, last, classes in _windows(doc.text) if doc.text else ():
                    held.append((doc, at, last, classes))
                    doc.waiting += 1
                    if len(held) == TOGETHER:
                        run()
                doc.cut_up = True
                if not held:
                    yield from ready()
            yield from ready()
        if held:
            run()
        yield from ready()

    return find


def find_personal_data(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the rules' finds, and all spans."""
    model = model or fit(docs)
    id_type = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    arrow = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(id_type, pa.string())
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_finder(model, arrow), out)
