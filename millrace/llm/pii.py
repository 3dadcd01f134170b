"""Personal data: fixed patterns, and a trained character tagger that adds what they miss."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.memory import lean, sliced
from millrace.llm.tagger import BASE_KINDS, KINDS, WINDOW, Tagger, char_ids, trained

Span = tuple[str, int, int]

STEP = WINDOW // 2
MARGIN = WINDOW // 4
#: Windows decoded together.
TOGETHER = 128

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_NAMED = re.compile(r"[0-9@]")
#: Words, between white space, with more than ASCII letters and punctuation behind them.
_WORDS = re.compile(r"(?<!\S)[A-Za-z]*+(?:[^\sA-Za-z.,;:!?]|[.,;:!?]++(?=[^\s.,;:!?]))\S*+")
#: What ``reconcile`` takes off a span's ends, and the least length of a secret.
_LEAD, _TRAIL, LEAST = ",;:", ".,;:!?", 6


def _digits(text: str) -> list[int]:
    return [ord(c) - 48 for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    """Whether the check digit is right."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, in time linear in the text: each ``@`` looks back over its local part
    as far as the previous address and the previous ``@``."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            after = host.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str | None) -> list[Span]:
    """What the patterns find, by start and then kind; code points, ends exclusive.

    A look-behind keeps the address pattern from starting inside a run of digits, where it could
    only fail as it did at the run's start; so every pattern takes time linear in the text.
    """
    if not text or not _TRIGGER.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def lettered(word: str) -> bool:
    """Whether all is letters, of any script, beside asterisks around it: a plain word, in whatever language."""
    bare = word.strip("*")
    return bare.isalpha() or all(unicodedata.category(c)[0] in "LM" for c in bare)


def plausible(kind: str, found: str) -> bool:
    """What a span of the tagger must satisfy, whatever its score."""
    d = _digits(found)
    if kind == "email":
        return re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", found) is not None
    if kind == "ip":
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", found) is not None and all(int(p) <= 255 for p in found.split("."))
    if kind == "secret":
        return len(found) >= LEAST and re.search(r"\s", found) is None and not lettered(found)
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d) and re.fullmatch(r"[0-9 .-]+", found) is not None
    return 9 <= len(d) <= 15 and re.fullmatch(r"\+?[0-9 ().-]+", found) is not None and re.search(r"[() -]", found) is not None


def window_starts(text: str) -> list[int]:
    """Starts of the windows, of ``WINDOW`` characters every ``STEP``, that decide the tag of some character of
    a word that can be of a plausible span.

    By ``plausible`` such a span holds a digit or an ``@``, or lies in one word, of which ``LEAST`` characters that
    aren't all letters are left when its ends are cleaned. Any other word is of no such span whatever its tags.
    """
    starts: set[int] = set()
    for m in _WORDS.finditer(text):
        word = m.group()
        bare = word.lstrip(_LEAD).rstrip(_TRAIL)
        if _NAMED.search(word) or len(bare) >= LEAST and not lettered(bare):
            starts.update(range(_owner(m.start()), _owner(m.end() - 1) + STEP, STEP))
    last = (len(text) - 1) // STEP * STEP
    if last - STEP in starts:  # which else would speak for the last one's characters
        starts.add(last)
    return sorted(starts)


def _owner(place: int) -> int:
    """The start of the window in which a character is nearest the middle."""
    return max(0, (place - MARGIN) // STEP) * STEP


def _decoded(texts: list[str | None], model: Tagger, jobs: list[tuple[int, int]], known: set[tuple[int, int]], joined: list[dict[int, int]]) -> None:
    """Adds the tags other than 0 of the windows ``jobs`` (text, start); ``known`` are all windows there are."""
    for lo in range(0, len(jobs), TOGETHER):
        part = jobs[lo : lo + TOGETHER]
        ids = np.zeros((len(part), WINDOW), np.int64)
        for row, (i, s) in enumerate(part):
            codes = char_ids(texts[i][s : s + WINDOW])
            ids[row, : len(codes)] = codes
        tags = model.decode(ids)
        for row in np.flatnonzero(tags.any(axis=1)).tolist():
            i, s = part[row]
            a = 0 if s == 0 else MARGIN
            last = s + WINDOW >= len(texts[i]) and (i, s + STEP) not in known
            b = len(texts[i]) - s if last else min(WINDOW - MARGIN, len(texts[i]) - s)
            for p in (np.flatnonzero(tags[row, a:b]) + a).tolist():
                joined[i][s + p] = int(tags[row, p])


def tag_texts(texts: list[str | None], model: Tagger, whole: bool = False) -> list[list[Span]]:
    """Spans of the tagger in each text. All windows of all texts are decoded in blocks; each
    character takes its tag from the window in which it is nearest the middle, and spans are read
    from the joined tags. With ``whole`` the windows into which a span runs on are decoded too, so
    that every plausible span is as if all windows of the text were."""
    jobs = [(i, s) for i, t in enumerate(texts) if t for s in window_starts(t)]
    known, joined = set(jobs), [{} for _ in texts]
    while jobs:
        _decoded(texts, model, jobs, known, joined)
        beside = [(i, _owner(q)) for i, s in jobs for q in (s + MARGIN - 1, s + WINDOW - MARGIN) if whole and 0 <= q < len(texts[i]) and {q - 1, q + 1} & joined[i].keys()]
        jobs = sorted(set(beside) - known)
        known.update(jobs)
    out = []
    for text, tags in zip(texts, joined):
        spans, open_at, kind, before = [], None, 0, -2
        for p in [*sorted(tags), None]:
            tag = tags[p] if p is not None else 0
            if open_at is not None and (p != before + 1 or tag % 2 == 1 or (tag - 1) // 2 != kind):
                spans.append((KINDS[kind], open_at, before + 1))
                open_at = None
            if p is not None and open_at is None:
                open_at, kind = p, (tag - 1) // 2
            before = p if p is not None else before
        out.append(spans)
    return out


def reconcile(text: str, base: list[Span], tagged: list[Span]) -> list[Span]:
    """Base spans stay; a tagger's span joins them if it is plausible and meets none of them."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    added = []
    for kind, a, b in tagged:
        while a < b and (text[a].isspace() or text[a] in _LEAD):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in _TRAIL):
            b -= 1
        last = bisect_left(taken, [b, 0]) - 1  # the last of the base spans that starts before b
        if b > a and plausible(kind, text[a:b]) and (last < 0 or taken[last][1] <= a):
            added.append((kind, a, b))
    return sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spelled(spans: list[Span]) -> str:
    """``kind:start:end``, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(texts: list[str | None], model: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    return [(b, reconcile(t, b, g)) if t else ([], []) for t, b, g in zip(texts, base, tag_texts(texts, model, whole=True))]


def _over(text: Column, model: Tagger, kind: str, fields: pa.DataType, make) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in sliced(batches, 512):
            texts = batch.to_pylist()
            yield pa.array([make(t, *found) for t, found in zip(texts, find_pii(texts, model))], fields)

    return F.arrow_udf(lean(run), kind).asNondeterministic()(text)


def pii_columns(text: Column, model: Tagger) -> Column:
    """Struct (n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of each text."""
    fields = pa.struct([*((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])
    kind = ",".join(f"n_{k}:bigint" for k in BASE_KINDS)

    def make(_: str | None, base: list[Span], every: list[Span]) -> dict:
        counts = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE_KINDS}
        return counts | {"base_sha256": hashlib.sha256(spelled(base).encode()).hexdigest(), "spans": spelled(every), "n_added": len(every) - len(base)}

    return _over(text, model, f"struct<{kind},base_sha256:string,spans:string,n_added:bigint>", fields, make)


def redact_text(text: str | None, spans: list[Span]) -> str | None:
    """The text with ``<KIND>`` in place of each span; overlapping spans become the first one's."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(text: Column, model: Tagger) -> Column:
    """The text with all spans, of patterns and tagger, replaced."""
    return _over(text, model, "string", pa.string(), lambda t, _, every: redact_text(t, every))


def find_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """One row per document: id, counts of the base spans by kind, base_sha256, spans, n_added.

    A null or empty text has no spans, and base_sha256 is that of the empty string. Repeated rows
    are each reported. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("key"), pii_columns(F.col(text_col), model or trained()).alias("pii"))
    return rows.select(F.col("key").alias(id_col), "pii.*")


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = None, model: Tagger | None = None) -> DataFrame:
    """The documents with personal data in ``text_col`` replaced, other columns as they were;
    ``length_col``, if given, becomes the code points of the new text (null if it is null)."""
    kind = dict(docs.dtypes).get(length_col, "bigint") if length_col else ""
    out = docs.withColumn(text_col, redacted(F.col(text_col), model or trained()))
    return out.withColumn(length_col, F.char_length(text_col).cast(kind)).select(docs.columns) if length_col else out
