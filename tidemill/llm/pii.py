"""Personal data in plain and disguised form, with offsets into the source text.

Plain identifiers are matched on the text as it stands.  A text with disguises is also
rewritten by small transducers (look-alike characters, spelled digits, "at" and "dot" in
words or brackets); each rewrite remembers which source characters it stands for, so what is
found in the rewritten text maps back to source offsets.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bound_batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Digit words of English, German, French and Spanish, and look-alikes of Latin letters in other scripts.
_DIGIT_WORDS = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0", "zwo": "2"}
_LOOK_ALIKES = dict(zip("АВЕЅІЈКМНОРСТУХаеоѕіјрсухԁһѵѡɡɑΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTYXaeosijpcyxdhvwgaABEZHIKMNOPTYXoav"))
_INVISIBLE = "­​‌‍⁠﻿"

#: Words for "+", "." and "@".
_PLUS_WORDS = "(?:plus|más)"
_DOT_WORDS = "(?:dot|punkt|point|punto)"
_AT_WORDS = "(?:arroba|arobase|ät)"

_WORD = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
#: Blanks around the brackets go too; they are taken from the bracket outwards, as a pattern that starts with blanks takes quadratic time.
_BRACKETED = re.compile(r"(?i)[\[({<][ \t]*+(at|arroba|arobase|ät|@|dot|punkt|point|punto|\.)[ \t]*+[\])}>][ \t]*+")
_SPELLED_RUN = re.compile(rf"(?i)\b(?:{_PLUS_WORDS}[ ,-]+)?(?:{_WORD}|[0-9]+)(?:(?:[ ,-]+|[ ]+{_DOT_WORDS}[ ]+)(?:{_WORD}|[0-9]+)\b)++")
_SPELLED_HINT = re.compile(rf"(?i)\b{_WORD}[ ,-]+(?:{_DOT_WORDS}[ ]+)?{_WORD}\b")
_TOKEN = re.compile(rf"(?i){_PLUS_WORDS}|{_DOT_WORDS}|{_WORD}|[0-9]+")
_LABEL = r"[A-Za-z0-9-]+"
#: Endings that make "at" and "dot" in plain words an address after any word.
_ENDINGS = "(?:com|org|net|edu|gov|info|biz|io|ai|app|dev|eu|uk|de|fr|es|it|nl|ch|at|us|ca|au|br|in|jp|cn|ru|example|test)"
#: Words that open plain prose after "at", where only those endings count.
_OPENERS = "(?:the|an?|one|this|that|these|those|each|every|any|some|no|his|her|its|their|my|your|our|which|what)"
_HIDDEN_DOT = r"(?:[ \t]+dot[ \t]+|[ \t]*[\[({<][ \t]*dot[ \t]*[\])}>][ \t]*)"
_SPACED_AT = re.compile(
    rf"(?i)(?<=[A-Za-z0-9._%+-])[ \t]+at[ \t]+(?={_LABEL}(?:{_HIDDEN_DOT}{_LABEL})*?{_HIDDEN_DOT}{_ENDINGS}\b"
    rf"|(?!{_OPENERS}[ \t]){_LABEL}(?:\.{_LABEL})*{_HIDDEN_DOT}(?:{_LABEL}(?:{_HIDDEN_DOT}|\.))*[A-Za-z]{{2,}}\b)"
)
#: "at" before a domain with real dots; what stands before it decides.
_DOTTED_AT = re.compile(r"(?i)(?<=[A-Za-z0-9])[ \t]+at[ \t]+(?=(?!www\.)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?<=\.[A-Za-z]{2}|[A-Za-z]{3})(?![A-Za-z0-9@]))")
_BEFORE_AT = re.compile(r"(?i)(^|[\n:;<(\[\"']|\b(?:to|mail|e-mail|email|address|contact|reach|is))[ \t]*([A-Za-z0-9._%+-]+)$")
_ODD_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9]+[._%+][A-Za-z0-9._%+-]*$|(?<![A-Za-z0-9._%+-])[A-Za-z]+[0-9]+$")
#: Words that stand before "at" and a site in plain prose.
_PROSE = re.compile(r"(?i)(?:.*(?:ed|ing|able|ible|s)|us|me|him|her|them|it|you|more|online|see|look|find|visit|buy|read|work|live|here|there|now|up|out|site|page|home|shop|store|book|apply|join|learn|meet|team|support|free|be|go|get|only|also|direct|blog|start|stay|order|register|download|available|founder|engineer|editor|manager|director)")
#: The words for "@" that mean nothing else, and the dots after them.
_NAMED_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9._%+-])[ \t]+{_AT_WORDS}[ \t]+(?={_LABEL}(?:\.{_LABEL}|[ \t]+{_DOT_WORDS}[ \t]+{_LABEL})+)")
_NAMED_DOTS = re.compile(rf"(?i)(?<=@){_LABEL}(?:[ \t]+{_DOT_WORDS}[ \t]+{_LABEL}\b)+")
_NAMED_DOT = re.compile(rf"(?i)[ \t]+{_DOT_WORDS}[ \t]+")
_SPACED_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])[ \t]+dot[ \t]+(?=[A-Za-z0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def find_plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all plain identifiers, sorted.

    Leftmost and non-overlapping for each kind; a match that fails its check is dropped and
    not tried again.  Each search takes time in proportion to the text.
    """
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if _DOTTED.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(found)


@lru_cache(maxsize=1)
def _odd_characters() -> dict[str, str]:
    """Non-ASCII characters that stand for one ASCII character or for nothing.

    Besides the fixed look-alikes these are all compatibility forms (full width, styled
    letters and digits) and decimal digits of any script.
    """
    table = dict(_LOOK_ALIKES) | dict.fromkeys(_INVISIBLE, "")
    for cp in range(0x80, 0x1FBFA):
        c = chr(cp)
        plain = unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and "!" <= plain <= "~":
            table[c] = plain
        elif unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
    return table


@lru_cache(maxsize=256)
def _one_of(characters: str) -> re.Pattern:
    return re.compile("[" + re.escape(characters) + "]")


class Rewritten:
    """A text after rewrites, which maps its spans back to the source."""

    def __init__(self, text: str):
        self.text = text
        self.layers: list[tuple[list[int], list[tuple[int, int, int]]]] = []

    def apply(self, pattern: re.Pattern, replace, blanks_before: bool = False) -> None:
        """Replace the matches for which ``replace`` returns a string, if asked with the blanks before them."""
        parts, last, size, starts, edits = [], 0, 0, [], []
        for m in pattern.finditer(self.text):
            new = replace(m)
            if new is None:
                continue
            first = m.start()
            while blanks_before and first > last and self.text[first - 1] in " \t":
                first -= 1
            parts += [self.text[last:first], new]
            size += first - last
            starts.append(size)
            edits.append((size + len(new), first, m.end()))
            size += len(new)
            last = m.end()
        if edits:
            self.text = "".join([*parts, self.text[last:]])
            self.layers.append((starts, edits))

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source span, and whether any rewrite lies inside it."""
        touched = False
        for starts, edits in reversed(self.layers):
            first, last = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
            touched |= last > first
            new_start, new_end = start, end
            if first >= 0:
                stop, a, b = edits[first]
                inside = start < stop
                touched |= inside
                new_start = a if inside else b + start - stop
            if last >= 0:
                stop, a, b = edits[last]
                new_end = b if end <= stop else b + end - stop
            start, end = new_start, new_end
        return start, end, touched


def _digits_of_run(m: re.Match) -> str | None:
    tokens = [t.lower() for t in _TOKEN.findall(m[0])]
    if not any(t in _DIGIT_WORDS for t in tokens):
        return None
    out = "".join("+" if re.fullmatch(_PLUS_WORDS, t) else "." if re.fullmatch(_DOT_WORDS, t) else _DIGIT_WORDS.get(t, t) for t in tokens)
    return out if sum(c.isdigit() for c in out) >= 4 else None


def _at_of_address(m: re.Match) -> str | None:
    """"@" if the word before looks like a local part, or stands where an address does and isn't plain prose."""
    before = m.string[max(0, m.start() - 80) : m.start()]
    if _ODD_LOCAL.search(before):
        return "@"
    found = _BEFORE_AT.search(before)
    if not found or (not found[1] and m.start() > 80) or _PROSE.fullmatch(found[2]):
        return None
    return "@"


def find_disguised(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) in source offsets of identifiers that only rewriting shows."""
    low = text.lower()
    odd = "" if text.isascii() else "".join(sorted(_odd_characters().keys() & set(text)))
    spelled = any(w in low for w in _DIGIT_WORDS) and _SPELLED_HINT.search(text)
    spaced = (" at" in low or "\tat" in low) and _DOTTED_AT.search(text)
    named = any(w in low for w in (" arroba ", " arobase ", " ät ")) and _NAMED_AT.search(text)
    if not (odd or spelled or spaced or named or "dot" in low or _BRACKETED.search(text)):
        return []
    new = Rewritten(text)
    if odd:
        table = _odd_characters()
        new.apply(_one_of(odd), lambda m: table[m[0]])
    new.apply(_SPELLED_RUN, _digits_of_run)
    if named:
        new.apply(_NAMED_AT, lambda m: "@")
        new.apply(_NAMED_DOTS, lambda m: _NAMED_DOT.sub(".", m[0]))
    new.apply(_SPACED_AT, lambda m: "@")
    new.apply(_DOTTED_AT, _at_of_address)
    new.apply(_BRACKETED, lambda m: "@" if m[1].lower() in ("at", "@") or re.fullmatch(_AT_WORDS, m[1].lower()) else ".", blanks_before=True)
    new.apply(_SPACED_DOT, lambda m: ".")
    if not new.layers:
        return []
    spans = ((new.source(a, b), kind) for a, kind, b in find_plain(new.text))
    return sorted((a, kind, b) for (a, b, touched), kind in spans if touched)


def find_all(text: str | None) -> tuple[list, list]:
    """Plain spans and the spans that deobfuscation adds: those not within a plain one of their kind."""
    text = text or ""
    plain = find_plain(text)
    disguised = find_disguised(text)
    if not disguised:
        return plain, []
    starts, ends = [[] for _ in KINDS], [[] for _ in KINDS]
    for a, kind, b in plain:  # those of a kind don't overlap
        starts[kind].append(a)
        ends[kind].append(b)
    added = [(a, kind, b) for a, kind, b in disguised if not (i := bisect_right(starts[kind], a)) or ends[kind][i - 1] < b]
    return plain, added


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    plain, added = find_all(text)
    out, last = [], 0
    for a, k, b in sorted(plain + added):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row per input row: the id, a count of plain spans for each kind, ``base_sha256``, ``spans``, ``n_added``.

    With ``redacted`` a column of that name has the text with every span replaced.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind;
    ``base_sha256`` is over the plain ones, ``spans`` has all.  Null text counts as empty
    (its ``redacted`` is null).  Repeated rows and null ids give rows of their own; other
    columns are not read.
    """

    bound_batches(docs.sparkSession)
    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"] + ["redacted"] * redacted

    @F.pandas_udf(", ".join(f"{n} {'long' if n[:2] == 'n_' else 'string'}" for n in names))
    def search(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            plain, added = find_all(text)
            counts = [sum(k == i for _, k, _ in plain) for i in range(len(KINDS))]
            row = (*counts, hashlib.sha256(_joined(plain).encode()).hexdigest(), _joined(plain + added), len(added))
            rows.append((*row, redact(text)) if redacted else row)
        return pd.DataFrame(rows, columns=names)

    return docs.select(F.col(id_col), search(F.col(text_col)).alias("_found")).select(id_col, "_found.*")
