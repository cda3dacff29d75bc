"""Figures of one page text, computed in Arrow batches: shared by the quality and the spam operator.

The profile of a page is counted in one pass over its words and lines, for every page. Its shares, how much of it is
no sentence and how much of it is stuffed or links, take a look at each line and are for the pages that a profile flags.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

from pagesieve.llm.charset import CHAINS, undo

# Common function words by language.
COMMON = {
    "en": "the a an of in on to and with for by that this their our every one another its from at after before during is are was were not it as be or but if when while inside near",
    "de": "der die das ein eine einen dem den des und im in mit für bei nach vor ist nicht auf aus durch gegen hinter neben ohne über um unter war wir sie auch als zu von",
    "fr": "le la les un une des et à a au aux pour avec sur sous dans par mais est pas ne que qui sans vers après avant pendant derrière devant de du en il elle",
    "es": "el la los las un una y con por del en sin tras según desde hasta bajo sobre que pero es no se su de al como para o",
    "pt": "o a os as um uma e de da do com sob até para por sem mas que no na após contra desde sobre em não se ao é como",
    "it": "il lo la i gli le un una e di da con per su tra fra che ma non è del della nel si al come",
    "nl": "de het een en van in op met voor bij na niet is dat die te zijn als aan uit maar door om ook er",
    "ru": "и в во на не что но с со у из к ко за от до по о об для без под при около возле после перед как это если когда хотя или же бы он она они",
}
_sets = {k: frozenset(v.split()) for k, v in COMMON.items()}
ALL_COMMON = frozenset().union(*_sets.values())
LANGUAGES = tuple(COMMON)

_word = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")
_end = re.compile(r"[.!?…]+[”\"»’')\]]*(?=\s|$)")
_ends_line = re.compile(r"[.!?…;:,][”\"»’')\]]*\s*$")
_closes = re.compile(r"[.!?…][”\"»’')\]]*\s*$")
_symbol = re.compile(r"[^\w\s.,;:!?'\"’“”„«»()–—…-]|_")
_slashed = re.compile(r"(?<!\w)\w/\w(?!\w)")
_LEADS = "ÐÑÃÂâРСГвĂÄ├┬Γ√‚╨╤"
_foreign, _foreign_run = re.compile(r"[^\x00-\x7f]"), re.compile(r"[^\x00-\x7f]+")
_unit = re.compile(r"(?<=[.!?…])\s+")
_cyr = re.compile(r"[Ѐ-ӿ]")
# Endings of host names.
_TOP = "example|test|com|org|net|edu|gov|info|biz|io|co|eu|de|fr|es|pt|it|nl|ru|uk|us|br|mx|ch|at|be|pl|cz|se|no|dk|fi|jp|cn|in|au|ca"
_domain_end = re.compile(rf"\.(?:{_TOP})(?![\w.-])")
_url = re.compile(rf"<a\s[^>]*>|(?:https?://|www\.)\S+|(?:[A-Za-z0-9-]+\.)+(?:{_TOP})(?![\w.-])(?:/\S*)?")
_may_link = re.compile(rf"://|www\.|<a |\.(?:{_TOP})(?![\w.-])")
_token = re.compile(r"(?<![\w/])[^\W\d_]+(?:[’'-][^\W\d_]+)*(?![\w/])")
_measure = re.compile(r"\d\s+([^\W\d_]+)")
#: Share of a page that a single further word must stuff to be a key word of it.
KEY_SHARE = 0.125
#: Marks of program code beside words: a unit with them is junk and no product tag.
_code = re.compile(r"\w[=\[({]\w|[)\]}]\s*[;{.]|\|\||&&")
_enumerated = re.compile(r"^\W*\d{1,3}[.)]\s+")


def language(words: list[str] | Counter, text: str) -> str:
    """The language whose common words occur most; Cyrillic script is Russian; `xx` without any."""
    if _cyr.search(text) and len(_cyr.findall(text)) * 3 > len(text):
        return "ru"
    known = words if isinstance(words, Counter) else Counter(filter(ALL_COMMON.__contains__, words))
    seen = {w: known[w] for w in known.keys() & ALL_COMMON}
    best, n = "xx", 0
    for k in LANGUAGES:
        s = sum(c for w, c in seen.items() if w in _sets[k])
        if s > n:
            best, n = k, s
    return best


class Line:
    """One line with its words in small letters and the counts that tell sentences from lists, tables and junk."""

    __slots__ = ("text", "n", "words", "common", "mostly_words", "ends", "closes")

    def __init__(self, text: str) -> None:
        bare = text.strip()
        self.text, self.n = text, len(bare)
        if bare and not bare[0].isalpha():
            bare = _enumerated.sub("", bare)
        low = (_slashed.sub("-", bare) if "/" in bare else bare).lower()
        self.words = _word.findall(low)
        self.common = sum(map(ALL_COMMON.__contains__, self.words))
        # letters of words make up most of what is no blank, and it is no row of hash tags
        self.mostly_words = sum(map(len, self.words)) * 100 >= 72 * (len(bare) - bare.count(" ")) and bare.count("#") * 4 <= len(self.words)
        self.ends = len(_end.findall(bare)) if "." in bare or "!" in bare or "?" in bare or "…" in bare else 0
        self.closes = self.ends > 0 and bool(_closes.search(bare))


def prose_flags(lines: list[Line]) -> list[bool]:
    """For each line whether it is part of sentences: mostly words, and either a sentence that closes, or function words
    in a neighbourhood where sentences end. Neighbours count so that prose with hard line breaks stays prose, while the
    items of a list, which end no sentence, do not become it."""
    out = []
    for i, x in enumerate(lines):
        if not x.mostly_words or not x.words:
            out.append(False)
            continue
        around = lines[max(0, i - 1) : i + 2]
        words = sum(len(y.words) for y in around)
        own = x.common / len(x.words) if x.words else 0.0
        near = sum(y.common for y in around) / words if words else 0.0
        ends = sum(y.ends for y in lines[max(0, i - 2) : i + 3])
        sentence = x.closes and len(x.words) >= 3 or x.ends and own >= 0.05
        flows = ends > 0 and (own >= 0.08 and near >= 0.12 or near >= 0.04 and len(x.words) >= 5 and sum(y.ends for y in around) > 0)
        out.append(bool(sentence or flows))
    return out


def _link_line(line: str) -> bool:
    """Whether a line is a link or the caption of one: addresses or anchors take three tenths of it, or stand in a short line
    that ends no sentence."""
    if "://" not in line and "www." not in line and "<a " not in line and not _domain_end.search(line):
        return False
    found = sum(map(len, _url.findall(line)))
    bare = line.strip()
    return found > 0 and (found * 10 >= len(bare) * 3 or bare.count(" ") < 16 and not _closes.search(bare))


def spam_share(text: str, counts: Counter, seen: Counter) -> tuple[float, float]:
    """(share of characters in stuffed units and link lines, share in link lines alone).

    A unit is a line or sentence. It is stuffed when a key word or key phrase of the page makes up a quarter of its
    words, or comes twice and makes an eighth; stuffed units of all keys count together. A line is a link line when
    addresses take three tenths of it. Keys are the three most frequent words, inside compounds and hash tags too
    (the key word may be outnumbered by a modifier), any word that stuffs KEY_SHARE of the page by itself, and any pair
    of words that comes four times; the rows of a list share its other words without being made of them.
    """
    total, low = len(text) or 1, text.lower()
    lines = low.split("\n")
    links = [_link_line(line) for line in lines] if _may_link.search(low) else [False] * len(lines)
    linked = sum(len(line) + 1 for line, link in zip(lines, links, strict=True) if link)
    rest = [u for line, link in zip(lines, links, strict=True) if not link and not _code.search(line) for u in _unit.split(line) if u.strip()]
    stuffed: set[int] = set()
    best, measures = 0, None
    for key, n in counts.most_common(3):
        if n >= 4:
            at = set()
            for i, unit in enumerate(rest):
                if key in unit:
                    h, k = unit.count(key), unit.count(" ") + 1
                    if h * 4 >= k or h >= 2 and h * 8 >= k:
                        at.add(i)
            best = max(best, sum(len(rest[i]) + 1 for i in at))
            # the measures of a list of amounts don't add up
            if measures is None:
                measures = Counter(_measure.findall(low))
            if at and measures[key] * 2 < n:
                stuffed |= at
    size = linked + sum(len(rest[i]) + 1 for i in stuffed)
    keys = {w for w, n in seen.items() if n >= 4} if max(size, linked + best) * 2 <= total else set()
    if keys:
        # by distinct words, so that a stuffed word which is common in another language does not make the page one of that
        keys -= _sets.get(language(list(seen), text), ALL_COMMON)
    if keys:
        # a unit of more than four words takes a key that comes twice
        may, room = [], 0
        for i, u in enumerate(rest):
            if i not in stuffed:
                k = len(u.split())
                hits = [w for w in _word.findall(u) if w in keys]
                if hits and (k <= 4 or len(set(hits)) < len(hits)):
                    may.append((i, k))
                    room += len(u) + 1
        if (size + room) * 2 > total:
            stuffed |= _stuffed_by_others(rest, may, keys, Counter(_measure.findall(low)), KEY_SHARE * (total - linked))
            size = linked + sum(len(rest[i]) + 1 for i in stuffed)
    size = max(size, linked + best)
    return min(1.0, size / total), min(1.0, linked / total)


def _stuffed_by_others(rest: list[str], may: list[tuple[int, int]], keys: set[str], measures: Counter, least: float) -> set[int]:
    """Those units of may, given with their words, that are stuffed by a word whose units add up to least characters, or by
    a pair of words. The measure behind a number is no key, nor is a letter beside a slash."""
    seen, pairs = Counter(), Counter()
    for u in rest:
        t = _token.findall(u)
        seen.update(t)
        pairs.update(zip(t, t[1:], strict=False))
    keys = {w for w in keys if seen[w] >= 4 and measures[w] * 2 < seen[w]}
    phrases = {p for p, n in pairs.items() if n >= 4 and p[0] in keys and p[1] in keys}
    by_word: dict[str, set[int]] = {}
    out: set[int] = set()
    for i, k in may:
        t = _token.findall(rest[i])
        for w, h in Counter(w for w in t if w in keys).items():
            if h * 4 >= k or h >= 2 and h * 8 >= k:
                by_word.setdefault(w, set()).add(i)
        many = Counter(p for p in zip(t, t[1:], strict=False) if p in phrases)
        if any(h * 4 >= k or h >= 2 and h * 8 >= k for h in many.values()):
            out.add(i)
    for at in by_word.values():
        if sum(len(rest[i]) + 1 for i in at) >= least:
            out |= at
    return out


PROFILE = ("n_words", "mean_word", "symbol_ratio", "punct_lines", "common_share", "closed", "density", "entropy", "repetition", "marks")
SHARES = ("not_prose", "spam", "links")


#: The runs of wrongly decoded text are few and come again and again.
_undo = lru_cache(maxsize=1 << 17)(undo)


def sound(text: str) -> str:
    """The text with wrongly decoded UTF-8 undone where most of its non-ASCII characters look like it: wrongly decoded prose
    is still prose, and its words are those of the original."""
    if text.isascii():
        return text
    strange = sum(map(text.count, _LEADS))
    if strange < 8 or strange * 5 < len(_foreign.findall(text)):
        return text
    best = text
    for chain in CHAINS:
        if chain[1] == "utf-8":
            got = _foreign_run.sub(lambda m, chain=chain: _undo(m.group(), chain) or m.group(), text)
            if len(got) < len(best):
                best = got
                if sum(map(got.count, _LEADS)) * 10 < strange:
                    break
    return best


def profile(text: str) -> dict:
    """The counted figures of one non-null text: closed is the share of characters in lines that end a sentence, marks the marks
    of links a line, repetition, density and entropy are of words. An empty text has zeros and language `xx`."""
    text = sound(text)
    low = text.lower()
    words = _word.findall(low)
    n, seen = len(words), Counter(words)
    chars = closed = punct = full = 0
    for x in text.split("\n"):
        x = x.strip()
        if x:
            full += 1
            chars += len(x)
            last = x.rstrip("”\"»“’')]")[-1:]
            if last in ".!?…":
                closed += len(x)
            punct += last in ".!?…;:,"
    counts = [c for w, c in seen.items() if len(w) >= 3 and w not in ALL_COMMON]
    content = sum(counts)
    marks = low.count("://") + low.count("www.") + low.count("<a ") + len(_domain_end.findall(low)) if _may_link.search(low) else 0
    return {
        "language": language(seen, text),
        "n_words": float(n),
        "mean_word": sum(map(len, words)) / n if n else 0.0,
        "symbol_ratio": len(_symbol.findall(text)) / chars if chars else 0.0,
        "punct_lines": punct / full if full else 0.0,
        "common_share": sum(seen[w] for w in seen.keys() & ALL_COMMON) / n if n else 0.0,
        "closed": closed / chars if chars else 0.0,
        "density": max(counts, default=0) / content if content else 0.0,
        # a word that comes once adds nothing to the sum of c log c
        "entropy": 1 - sum([c * math.log(c) for c in counts if c > 1]) / (content * math.log(content)) if content > 1 else 1.0,
        "repetition": 1 - len(seen) / n if n else 0.0,
        "marks": marks / full if full else 0.0,
    }


def shares(text: str) -> dict:
    """Shares of the characters of one non-null text: outside sentences, in stuffed units and link lines, in link lines."""
    text = sound(text)
    full = [x for x in map(Line, text.split("\n")) if x.n]
    chars = sum(x.n for x in full)
    flags = [f and not _link_line(x.text) for x, f in zip(full, prose_flags(full), strict=True)]
    seen = Counter(w for x in full for w in x.words)
    spam, links = spam_share(text, Counter({w: c for w, c in seen.items() if len(w) >= 3 and w not in ALL_COMMON}), seen)
    return {"not_prose": sum(x.n for x, f in zip(full, flags, strict=True) if not f) / chars if chars else 0.0, "spam": spam, "links": links}


def figures(text: str) -> dict:
    """Profile and shares of one non-null text."""
    return profile(text) | shares(text)


PROFILE_DDL = "url STRING, text_id BIGINT, own STRING, language STRING, " + ", ".join(f"{c} DOUBLE" for c in PROFILE)
SHARES_DDL = "url STRING, " + ", ".join(f"{c} DOUBLE" for c in SHARES)


def profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (url, text_id, own) with the profile of own."""
    for batch in batches:
        rows = [profile(t) for t in batch.column("own").to_pylist()]
        cols = [*batch.columns, pa.array([r["language"] for r in rows], pa.string()), *(pa.array([r[c] for r in rows], pa.float64()) for c in PROFILE)]
        yield pa.record_batch(cols, ["url", "text_id", "own", "language", *PROFILE])


def share_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (url, own) with the shares of own in its place."""
    for batch in batches:
        rows = [shares(t) for t in batch.column("own").to_pylist()]
        yield pa.record_batch([batch.column("url"), *(pa.array([r[c] for r in rows], pa.float64()) for c in SHARES)], ["url", *SHARES])
