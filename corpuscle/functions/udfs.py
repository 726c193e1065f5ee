"""The few text functions that have no built-in form, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def each(function, kind: T.DataType = T.StringType()):  # noqa: B008
    """A pandas UDF that applies a function to every value that isn't null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    return run


def nfc(text: Column) -> Column:
    """Normalisation to NFC; ASCII texts are so already and don't go to Python."""
    return F.coalesce(each(lambda t: unicodedata.normalize("NFC", t))(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def unescape(text: Column) -> Column:
    """HTML entities resolved; texts without `&` have none and don't go to Python."""
    return F.coalesce(each(html.unescape)(F.when(text.contains("&"), text)), text)


def balanced(text: str) -> str:
    """Without closing brackets that nothing opened and opening ones that nothing closes."""
    depth, drop_close = 0, set()
    for k, c in enumerate(text):
        if c == "(":
            depth += 1
        elif c == ")":
            if depth:
                depth -= 1
            else:
                drop_close.add(k)
    need, drop_open = 0, set()
    for k in range(len(text) - 1, -1, -1):
        c = text[k]
        if c == ")" and k not in drop_close:
            need += 1
        elif c == "(":
            if need:
                need -= 1
            else:
                drop_open.add(k)
    return "".join(c for k, c in enumerate(text) if k not in drop_close and k not in drop_open)


SENTENCE = re.compile(r"(\.\.\.|[.?!])")


def sentence_case(text: str) -> str:
    """A capital at the start and after `.`, `?`, `!`; after `...` letters stay. A stop at the end."""
    out, raise_next = [], True
    for part in SENTENCE.split(text):
        if SENTENCE.fullmatch(part):
            raise_next = part != "..."
        elif raise_next and part.strip():
            at = len(part) - len(part.lstrip())
            part, raise_next = part[:at] + part[at].upper() + part[at + 1 :], False
        out.append(part)
    text = "".join(out).strip()
    return text if not text or text[-1] in ".?!" else text + "."


POLISH_SPACE, POLISH_DOTS = re.compile(r"\s+([.?!:;])"), re.compile(r"\.\s*\.\s*\.")


def polished(text: str) -> str:
    text = balanced(unicodedata.normalize("NFC", text.strip()))
    return sentence_case(POLISH_DOTS.sub("...", POLISH_SPACE.sub(r"\1", text)))


def final_polish(text: Column) -> Column:
    return each(polished)(text)


def longest_match(syllables: list[str], phrases: set[str], most: int) -> list[str]:
    """Joins the longest runs of syllables that are phrases by `_`, from the left."""
    out, at = [], 0
    while at < len(syllables):
        for n in range(min(most, len(syllables) - at), 1, -1):
            if " ".join(syllables[at : at + n]).lower() in phrases:
                break
        else:
            n = 1
        out.append("_".join(syllables[at : at + n]))
        at += n
    return out


def segmenter(phrases: Iterable[str]):
    """Word segmentation by dictionary: a stand-in for a trained segmenter, with the same form of output."""
    known = {p.lower().replace("_", " ") for p in phrases}
    most = max((p.count(" ") + 1 for p in known), default=1)
    return lambda text: " ".join(longest_match(text.split(), known, most))


#: Terms that are joined already, such as `rtx_3060_ti`; marks around which words are told apart; runs of blanks.
TERM, STOPS, MARKS, BLANKS = re.compile(r"\b\w+(?:_\w+)+\b"), re.compile(r"(?<!\d)[.,](?!\d)"), re.compile(r"[!?;:()\[\]{}”\"’']"), re.compile(r"[ \t]{2,}")


def term_segmenter(phrases: Iterable[str], fixed: bool = False):
    """Segmentation that leaves joined terms whole. Stops and commas that aren't between digits are set apart; other
    marks are deleted, or set apart as well if fixed."""
    segment = segmenter(phrases)

    def run(text: str) -> str:
        terms: list[str] = []

        def mask(found: re.Match) -> str:
            terms.append(found[0])
            return f"\ue000{len(terms) - 1}\ue001"  # letters for private use, which texts don't have

        own = TERM.sub(mask, text)
        own = MARKS.sub(lambda m: f" {m[0]} " if fixed else "  ", STOPS.sub(lambda m: f" {m[0]} ", own))
        own = segment(BLANKS.sub(" ", own).strip())
        own = re.sub("\ue000(\\d+)\ue001", lambda m: terms[int(m[1])], own)
        return BLANKS.sub(" ", own).strip()

    return run


#: Letters that match others in any case without sharing their folded form with them.
ODD_CASE = re.compile("[\u0130\u0131]")


def translator(entries: list[tuple[str, str]]):
    """Applies a slang dictionary to a text, first put in NFC: longest key first, whole words, any case, one key after
    another, so a later key may rewrite what an earlier one put in. Values are literal. Keys that a text doesn't hold
    cost a search for a substring each."""
    ordered = sorted(entries, key=lambda e: -len(e[0]))
    patterns = [(k.casefold(), re.compile(rf"\b{re.escape(k)}\b", re.I), v) for k, v in ordered]

    def run(text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        held = text.casefold()
        odd = ODD_CASE.search(text) is not None
        for key, pattern, value in patterns:
            if odd or key in held:
                text, n = pattern.subn(lambda _, v=value: v, text)
                held = text.casefold() if n else held
        return text

    return run
