"""Sentences of texts in any script, with their places.

Blocks come first: a fenced code block, a heading and a list item are one unit each, and a
blank line ends whatever precedes it. Inside running text the terminators of all scripts
(every character with the sentence-break property STerm or ATerm in the Unicode tables of the
``regex`` package) end a sentence after the closing marks that follow them, unless a rule
keeps it open: a lower-case continuation, a comma, an abbreviation, a number or name with an
inner full stop, inline code, or a quotation that the sentence goes on after. Abbreviations
hold in their own language, which common words of the text tell, not the declared language
alone. Thai has no terminator; a blank between two Thai letters ends a sentence there, outside
quotations. Every rule looks at its own surroundings only, so long texts take no more time a
character than short ones.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable
from functools import cache, cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import arrays

EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
#: Terminators that need a gap or a capital after them; the first four and the ellipses may also stand inside a sentence.
WEAK = frozenset(regex.findall(r"\p{SB=ATerm}", EVERY)) | frozenset("!?…‥")
#: All others.
STRONG = frozenset(regex.findall(r"\p{SB=STerm}", EVERY)) - WEAK
TERMINATORS = WEAK | STRONG
# Closing marks, quotation pairs, abbreviations by language, common words of languages, month names.
CLOSING = frozenset(")]}）］｝】》〉〕*_")
COMMAS = ",;:，、；：،؛-–—"
OPENING = "([{（［【《〈¿¡*_"
QUOTES = {"“": "”", "„": "“", "«": "»", "»": "«", "「": "」", "『": "』", "‹": "›", "‘": "’", '"': '"'}
TITLES = {
    "": "Dr Prof Mr Mrs Ms St Jr vs cf e.g i.e eg ie U.S al т е тыс млн д-р проф гр ул им см ดร นพ พญ ผศ รศ ศ น พ.ศ ค.ศ डॉ प्रो श्री मि.ग्रा د أ م",
    "en": "incl resp Sr",
    "de": "Hr Fr Herr Ing Dipl bzw sog vgl Vgl evtl ggf inkl exkl incl resp Bd Hrsg z d ggü",
    "fr": "Mme Mlle ex resp incl",
    "es": "Dra Sra Sr Srta ej incl",
}
NUMBERED = {
    "": "No no Nr nr Nos Fig fig Figs Sec sec Eq eq Abb Tab vol Vol pp p ca min max рис Рис табл стр с прибл гл п №",
    "en": "Art art chap Chap approx",
    "de": "Kap S Art approx",
    "fr": "art Art chap Chap env approx",
    "es": "art Art cap Cap aprox núm",
}
COMMON = {
    "en": "the of and is are to in it that was for with on we you this be as at by not from has have then she they my",
    "de": "der die das und ist nicht ein eine wir mit von den dem zu auf für sich es im wird sind",
    "fr": "le la les des et est une du que qui dans pour pas sur avec il nous au ce par sont",
    "es": "el la los las de y es una que en del para con por se no un su al como son",
}
FINAL = frozenset("etc usw p.m a.m др г гг ч".split())
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
#: Numbered words after which a capital goes on as well as a digit.
NAMED_PARTS = frozenset(("Nr", "Fig", "Sec", "Abb"))
TITLES_OF = {x: frozenset(w.split()) for x, w in TITLES.items()}
NUMBERED_OF = {x: frozenset(w.split()) for x, w in NUMBERED.items()}
ABBREVIATED = frozenset().union(*TITLES_OF.values(), *NUMBERED_OF.values())
COMMON_OF = {x: frozenset(w.split()) for x, w in COMMON.items()}
#: No listed abbreviation is longer.
LONGEST = 64

FENCE = re.compile(r"[ \t]{0,3}(`{3,}|~{3,})")
HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
ITEM = re.compile(r"[ \t]*(?:[-*+•‣▪·–]|\d{1,9}[.)]|[A-Za-z][.)])[ \t]+\S")
ENDS = re.compile("[" + re.escape("".join(sorted(TERMINATORS))) + "]+")
THAI_GAP = re.compile(r"(?<=[ก-๛])\s+(?=[ก-๛])")
CODE = re.compile(r"`[^`]*`")
NAME = re.compile(r"[a-z][A-Za-z0-9]*(?:_[A-Za-z0-9_]+|[A-Z][A-Za-z0-9]*)")
BREAK = re.compile(r"[\s(\[{\"“„«‘'`,;:/]")
LETTERS = re.compile(r"\w+")


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole): the blocks of a text; a whole block is one unit."""
    found: list[tuple[int, int, bool]] = []
    at, size = 0, len(text)
    begin, items, fence = -1, False, ""

    def close(end: int) -> None:
        nonlocal begin, items
        if begin >= 0:
            found.append((begin, end, items))
        begin, items = -1, False

    while at < size:
        end = text.find("\n", at)
        end = size if end < 0 else end
        line = text[at:end]
        if fence:
            m = FENCE.match(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line[m.end() :].strip():
                found.append((begin, end, True))
                begin, fence = -1, ""
        elif not line.strip():
            close(at)
        elif m := FENCE.match(line):
            close(at)
            begin, fence = at, m[1]
        elif HEADING.match(line):
            close(at)
            found.append((at, end, True))
        elif ITEM.match(line) and (begin < 0 or items):
            close(at)
            begin, items = at, True
        elif begin < 0:
            begin = at
        at = end + 1
    if begin >= 0:
        found.append((begin, size, bool(fence) or items))
    return found


def quotations(text: str) -> list[tuple[int, int]]:
    """Places of the opening and the closing mark of each outermost quotation that is closed."""
    found: list[tuple[int, int]] = []
    wanted, begin = "", -1
    for m in re.finditer("[“”„«»「」『』‹›‘’\"]", text):
        k, c = m.start(), m[0]
        if wanted:
            if c == wanted and not (c == '"' and text[k - 1 : k].isspace() and k + 1 < len(text) and not text[k + 1].isspace() and text.find('"', k + 1) > 0):
                found.append((begin, k))
                wanted = ""
        elif c in QUOTES and not (c == "»" and k and text[k - 1].isspace()):
            if c == "‘" or (c == '"' and k and (text[k - 1].isalnum())):
                continue
            wanted, begin = QUOTES[c], k
    return found


def script(c: str) -> str:
    o = ord(c)
    if 0x3040 <= o <= 0x30FF:
        return "kana"
    if 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "han"
    if 0x0900 <= o <= 0x0DFF or 0x0600 <= o <= 0x08FF or 0x0E00 <= o <= 0x0EFF:
        return "caseless"
    return "cased"


def languages_of(text: str) -> frozenset[str]:
    """The listed languages whose common words a text in Latin letters holds most of; none without any."""
    found = Counter(LETTERS.findall(text.lower()))
    sizes = {x: sum(found[w] for w in words) for x, words in COMMON_OF.items()}
    most = max(sizes.values())
    return frozenset(x for x, n in sizes.items() if n == most) if most else frozenset()


class Running:
    """A block of running text: where it is quoted or code, and where its sentences end."""

    def __init__(self, text: str, of_document: Callable[[], frozenset[str]], hint: str = ""):
        self.text, self.of_document, self.hint = text, of_document, hint
        self.closed = quotations(text)
        self.opens = [a for a, _ in self.closed]
        self.opening = frozenset(self.opens)
        self.code = [m.span() for m in CODE.finditer(text)]
        self.code_opens = [a for a, _ in self.code]
        self.breaks = [m.end() for m in BREAK.finditer(text)]

    @cached_property
    def languages(self) -> frozenset[str]:
        """The languages of the block, or of the document where the block has no common word."""
        return languages_of(self.text) or self.of_document()

    @staticmethod
    def around(spans: list[tuple[int, int]], begins: list[int], at: int) -> tuple[int, int] | None:
        """The span that holds a place; its first and last do not count."""
        k = bisect_right(begins, at - 1) - 1
        return spans[k] if k >= 0 and spans[k][0] < at < spans[k][1] else None

    def word_before(self, at: int) -> tuple[str, bool]:
        """The word that ends at a place (of a very long one its end), and whether it holds a full stop."""
        k = bisect_right(self.breaks, at) - 1
        begin = self.breaks[k] if k >= 0 else 0
        return self.text[max(begin, at - LONGEST) : at].lstrip("*_"), self.text.rfind(".", begin, at) >= 0

    def cuts(self) -> list[int]:
        """Ends of the sentences, except the last."""
        text, found = self.text, set()
        for m in ENDS.finditer(text):
            first, after, marks, quoted = m.start(), m.end(), m[0], False
            if self.around(self.code, self.code_opens, first):
                continue
            inside = self.around(self.closed, self.opens, first)
            if inside:
                k = after
                while k < inside[1] and (text[k] in CLOSING or text[k] in " \u00a0\u202f"):
                    k += 1
                if k < inside[1]:
                    continue
                after, quoted = inside[1] + 1, True
            while after < len(text) and (text[after] in CLOSING or (text[after] in "”’»\"'" and after not in self.opening)):
                after += 1
            if after < len(text) and text[after] in TERMINATORS:
                continue
            if self.ends_sentence(first, marks, after, quoted):
                found.add(after)
        for m in THAI_GAP.finditer(text):
            if not self.around(self.closed, self.opens, m.start()):
                found.add(m.start())
        return sorted(found)

    def ends_sentence(self, first: int, marks: str, after: int, quoted: bool) -> bool:
        """Whether the terminators ``marks`` at ``first``, closed up to ``after``, end a sentence."""
        text, k = self.text, after
        size = len(text)
        while k < size and text[k].isspace():
            k += 1
        if k >= size:
            return True
        gap, c = k > after, text[k]
        if c in COMMAS and not (c in "-–—" and gap):
            return False
        head = k
        while head < size and (text[head] in OPENING or text[head] in QUOTES):
            head += 1
        lead = text[head] if head < size else c
        opened = head > k
        kind = script(lead)
        if any(x in STRONG for x in marks):
            return not quoted or kind in ("cased", "han") or opened or (kind == "kana" and gap)
        if quoted and kind in ("caseless", "kana"):
            return False
        if lead.islower():
            name = NAME.match(text, head)
            named = bool(name) and not text.startswith(("(", "."), name.end()) and "…" not in marks and ".." not in marks and not quoted
            if not named or c == "(":
                return False
            if not gap and "_" not in name[0]:
                return False
        if all(x in "…‥" for x in marks):
            return gap or opened
        if marks[0] != "." or len(marks) > 1:
            return gap or lead.isupper() or kind != "cased" or opened
        word, dotted = self.word_before(first)
        if not gap and not opened:
            if lead.isdigit() or (kind == "cased" and not (lead.isupper() or lead.islower())):
                return False
            if lead.isupper() and not (len(word) > 1 and (word[-1].islower() or word[-1].isdigit() or word[-1] in ")`")) or dotted and word not in FINAL:
                return False
            if kind == "caseless" and (len(word) < 3 or script(word[-1]) != "caseless"):
                return False
        if word in ABBREVIATED and self.abbreviated(word, lead, c):
            return False
        if len(word) == 1 and word.isupper() and word.isalpha() and not lead.isdigit():
            return False
        if word.isdigit() and lead.isupper():
            follows = LETTERS.match(text, head)
            if follows and follows[0] in MONTHS:
                return False
        return True

    def abbreviated(self, word: str, lead: str, c: str) -> bool:
        """Whether a listed word is an abbreviation here that the sentence goes on after."""
        if any(word in TITLES_OF[x] for x in ("", *self.languages)):
            return True
        return (lead.isdigit() or word in NAMED_PARTS or c == "`") and any(word in NUMBERED_OF[x] for x in ("", self.hint if self.hint in COMMON else "", *self.languages))


def sentences(text: str | None, hint: str = "") -> list[tuple[int, int]]:
    """(start, end) of each sentence without blanks at its ends; none for null or blank texts. hint: the declared language, which decides where no word does."""
    found: list[tuple[int, int]] = []

    @cache
    def of_document() -> frozenset[str]:
        return languages_of(text) or frozenset((hint,) if hint in COMMON else ())

    for begin, end, whole in blocks(text or ""):
        part = text[begin:end]
        last = 0
        for cut in [*([] if whole else Running(part, of_document, hint).cuts()), len(part)]:
            unit = part[last:cut]
            if bare := unit.strip():
                start = begin + last + len(unit) - len(unit.lstrip())
                found.append((start, start + len(bare)))
            last = cut
    return found


def split_sentences(df: DataFrame, id: str, text: str, lang: str | None = None) -> DataFrame:
    """(id, start_char, end_char), one row per sentence of each text of ``df``.

    lang: column of the declared language; it may be null or wrong. Other columns are not read. Null, empty and blank texts have no rows; a row without an id
    keeps null as its id. Repeated rows give repeated sentences.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
        who: list[int | None] = []
        start: list[int] = []
        end: list[int] = []
        for one, body, hint in zip(ids, texts, arrays.strings(batch, "lang"), strict=True):
            for a, b in sentences(body, hint):
                who.append(one)
                start.append(a)
                end.append(b)
        return pa.RecordBatch.from_pydict({"id": pa.array(who, pa.int64()), "start_char": pa.array(start, pa.int32()), "end_char": pa.array(end, pa.int32())})

    narrow = df.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), (F.lower(F.trim(arrays.text(lang))) if lang else F.lit("")).alias("lang"))
    return arrays.arrow_map(narrow, run, "id long, start_char int, end_char int")
