"""Documents that hold template residue or an error page where content should be.

Each document is cut into passages, its sentences and short lines, with unfilled fields, numbers, paths and names masked.
A few trusted signs (unfilled fields, filler words, status lines, script notices) mark passages, and a document that
such passages lead, without a full text of its own, is residue. Labels then travel in two ways: a passage that stands
in several different texts led by signs and hardly anywhere else is residue too and nobody's own text, so that the long
wording of an error page is no full text, and documents made of such passages are residue; and a document linked to a residue document, over any number of links, is residue. Links come from SimHash tables and, as
near-duplicates of 0.8 may differ in more bits than tables can be keyed by, an exact index of shingle prefixes; both are
verified. Every text is read to its end and every document stands in the tables, whatever its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.llm.neardup import first, reached, shingles, simhash
from pagesieve.llm.pagestats import ALL_COMMON, Line, prose_flags
from pagesieve.session import keyed_join, stage

#: A document with so many words of its own in sentences that are no residue has a full text; so has one with LONG_TEXT words in
#: sentences without a sign, even if other documents hold the same ones.
FULL_TEXT, LONG_TEXT = 40, 90
#: A passage without a sign is residue if so many different texts that signs lead hold it, and these are this share of all that do.
SUPPORT, CERTAINTY = 3, 0.9

# Unfilled template fields.
FIELD = (
    r"\{\{[^{}\n]{1,60}\}\}|[#$]?\{[A-Za-z_][\w.]{0,40}\}|<%=?[^%\n]{1,60}%>|%[A-Za-z_][\w.]{1,40}%|%%[\w.]{1,40}%%|\*\|[^|\n]{1,40}\|\*"
    r"|\[\[[^\[\]\n]{1,60}\]\]|\[(?!(?:sic|edit|note|citation|audio|video|image|photo|laughter|laughs|applause|music|ed|eds)\])[A-Za-z]\w*(?:[._]\w+)*\]|(?<!\w)__[A-Za-z][\w.]{0,40}?__(?!\w)|@@[\w.]{1,40}@@|<[A-Za-z]\w*(?:[._]\w+)*>|\|\|[\w.]{1,40}\|\||~~[\w.]{1,40}~~"
)
# Words of the usual filler text.
FILLER = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat "
    "nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum vitae porta augue massa felis".split()
)
# Wording of status lines, script notices and editor stubs, in the languages of web servers and frameworks.
SIGNS = (
    r"\b[45]\d\d\b\W{0,4}(?:not found|forbidden|bad gateway|bad request|unauthorized|service|gateway|internal|page|error|erreur|fehler|erro)"
    r"|\b(?:http |erreur |error |fehler |erro |ошибка |код )[45]\d\d\b|error \(?[45]\d\d|\([45]\d\d\)\s*$"
    r"|page (?:not found|can[’']t be found|cannot be found|does not exist)|page\b.{0,80}\bintrouvable|seite (?:wurde )?nicht gefunden|página no encontrada|página não encontrada|страница не найдена"
    r"|\bforbidden\b|access denied|accès refusé|zugriff verweigert|acceso denegado|acesso negado|доступ запрещ"
    r"|(?:page|story|article|content|item|document|file|resource|post|link)\b.{0,60}\b(?:(?:has been|was|were) removed|(?:is )?no longer (?:available|exists?|here)|has expired|could not be found)"
    r"|bad gateway|gateway time-?out|service (?:is )?(?:temporarily )?unavailable|under maintenance|maintenance mode|internal (?:server )?error|interner serverfehler|erreur interne|(?:error|erro|errore) interno|внутренняя ошибка|ошибка сервера"
    r"|fatal error|stack trace|traceback \(most|uncaught \w*(?:error|exception)|undefined (?:index|variable|method|offset)|call to undefined|sqlstate|database (?:connection )?(?:error|failed|failure|unavailable)|error establishing|connection (?:refused|timed out|reset|failed)|too many connections"
    r"|session (?:has |is )?(?:expired|ended)|session expirée|sitzung (?:ist )?abgelaufen|sesión (?:ha )?(?:caducado|expirado)|sessão expir|сеанс (?:истёк|истек)"
    r"|\[object object\]|^\W*(?:undefined|null|nan|none)(?:\W+(?:undefined|null|nan|none))*\W*$"
    r"|javascript|\bjava script\b|(?:support|enable|allow|activate|turn on|block)\w*\W+(?:\w+\W+){0,3}scripts?\b|scripts? (?:is|are) (?:required|disabled|blocked|needed)"
    r"|checking (?:your|the|that your|if the|if your) (?:browser|connection|site)|verify(?:ing)? (?:that )?you are (?:a )?human|verifying your browser|are you a robot|ddos protection"
    r"|untitled document|enter text here|add a subtitle|your (?:title|text|content) here|click to (?:edit|add)|insert (?:text|title|image) here|sample (?:text|page|content)\b|placeholder text|(?:title|subtitle|text|content|headline|caption|image|name) (?:goes )?here\b|replace this (?:text|title|image)|dummy (?:text|paragraph|content|copy)|insert your \w+|write something about|tell us about yourself|describe yourself here|texte ici|text hier eingeben|escriba aquí|texto aqui"
)
# One of these stands in whatever SIGNS match, besides a number from 400 to 599; they spare most lines the match.
HINTS = (
    "page", "seite", "página", "страница", "forbidden", "denied", "refus", "verweigert", "denegado", "negado", "доступ", "gateway", "unavailable", "maintenance",
    "serverfehler", "erreur interne", "fatal error", "stack trace", "traceback", "uncaught", "undefined", "sqlstate", "database", "establishing",
    "connection", "session", "sitzung", "sesión", "sessão", "сеанс", "object object", "null", "nan", "none", "javascript", "java script", "script", "checking", "verify", "robot", "ddos",
    "untitled", "enter text", "subtitle", " here", "click to", "insert ", "sample ", "placeholder", "texte ici", "eingeben", "escriba", "texto aqui", "replace this", "interno",
    "internal", "внутренняя ошибка", "ошибка", "removed", "no longer", "expired", "not be found", "dummy ", "write something", "yourself", "error 4", "error 5",
)
# Lines that may stand beside residue and say nothing by themselves.
IDLE = re.compile(r"^\W*(?:loading|please wait|one moment|just a moment|wait|chargement|laden|bitte warten|cargando|carregando|загрузка|veuillez patienter|aguarde)\W*$", re.I)
TRACE = re.compile(r"^\W*(?:#\d+\s|at\s+[\w$.<>]+\s*\(|file\s+\S+.*\(\S+:\d+\)|\S+\.(?:php|js|py|rb|java|inc)\b.{0,30}\d)", re.I)
CHROME = re.compile(r"[|·›»/–]\s|©|\bcopyright\b|all rights reserved|alle rechte vorbehalten|derechos reservados|direitos reservados|droits réservés", re.I)

_field, _signs = re.compile(FIELD), re.compile(SIGNS, re.I)
_opens, _status = re.compile(r"[{%*\[<_@|~]"), re.compile(r"[45]\d\d")
_OPENS = "{%*[<_@|~"
_quoted = re.compile(r"[“\"«„‘'][^”\"»“’']{1,60}[”\"»“’']")
_same = re.compile(r"\W*(\w+)(?:\W+\1){2,}\W*", re.I)
_unit = re.compile(r"(?<=[.!?…])[”\"»]?\s+")
# what stands between blanks and holds a number or a path is one word, else words are runs of letters
_number = re.compile(r"[\d/\\@]")
_LOWER = "(?>[a-zß-öø-ÿа-џ]+)"
# and words in small letters between single blanks come in one piece, behind the last of which there is no number or path
_loose = re.compile(rf"(?<!\S){_LOWER}(?: {_LOWER})*(?=[.,;:!?…)”’\"»]*+(?!\S))|(?<!\S)[^\s\d/\\@]*+[\d/\\@]\S*|\w+|[{{}}]+|\n")
_token = re.compile(r"[^\W\d_]+")
_ENDS = frozenset(".!?…")
_hints = ahocorasick.Automaton()
for _h in HINTS:
    _hints.add_word(_h, _h)
_hints.make_automaton()
# whatever line is filler has one of the longer words that are no function words
_fillers = ahocorasick.Automaton()
for _h in FILLER - ALL_COMMON:
    if len(_h) >= 4:
        _fillers.add_word(_h, _h)
_fillers.make_automaton()


def filler(words: list[str], least: int = 3) -> bool:
    """Whether words are filler: some of the usual ones, a twelfth at least, and hardly a function word among the rest."""
    if FILLER.isdisjoint(words):
        return False
    seen = [w for w in words if w in FILLER]
    if len(seen) < least or len(seen) * 12 < len(words):
        return False
    rest = [w for w in words if w not in FILLER]
    return len(set(seen)) >= min(least, 3) and sum(w in ALL_COMMON for w in rest) * 10 <= len(words)


def _hinted(text: str, low: str) -> bool:
    """Whether a sign may stand in the text, given in small letters too: every sign has an opening mark, a status number or a hint."""
    if any(map(text.__contains__, _OPENS)) or ("4" in text or "5" in text) and _status.search(text):
        return True
    return next(_hints.iter(low), None) is not None


def is_residue(unit: str) -> bool:
    """Whether a line or sentence is residue by a trusted sign. Signs that are quoted are talked about."""
    if _opens.search(unit) and _field.search(unit) or _same.fullmatch(unit):
        return True
    if not _status.search(unit) and next(_hints.iter(unit.lower()), None) is None:
        return False
    return bool(_signs.search(unit)) and bool(_signs.search(_quoted.sub(" ", unit)))


@dataclass
class Look:
    """What stands in one document: its masked words, and of each passage the masked words, the number of words, whether a
    sign marks it, and whether it is prose; and whether a sign stands in the first lines."""

    words: list[str] = field(default_factory=list)
    passages: list[tuple[str, int, bool, bool]] = field(default_factory=list)
    leads: bool = False


def _masked(units: list[str]) -> list[list[str]]:
    """The words of each unit, with fields, numbers, paths and names inside sentences masked."""
    text = "\n".join(units)
    if _opens.search(text):
        text = _field.sub("{}", text)
    capitals = [u.isupper() for u in units]
    words = _loose.findall(text)
    out: list[list[str]] = [[]]
    got, at, start, last = out[0], 0, True, len(words) - 1
    for i, w in enumerate(words):
        if " " in w:
            got += w.split(" ")
            start = False
        elif not w.isalpha():
            if w == "\n":
                got, at, start = [], at + 1, True
                out.append(got)
            else:
                got.append("0" if _number.search(w) else w.lower())
                start = False
        elif w.islower():
            got.append(w)
            start = False
        else:
            low = w.lower()
            # a name starts a sentence only before another capital
            if low == w or capitals[at] or start and (i == last or words[i + 1] == words[i + 1].lower()):
                got.append(low)
            elif not got or got[-1] != "N":
                got.append("N")
            start = False
    return out


def _prose(lines: list[str], signed: set[int]) -> list[bool]:
    """Whether each line is prose. Once the lines without a sign hold LONG_TEXT words of prose the text is a full one whatever
    else is prose in it, so the flags of the lines behind are left False."""
    words, stop = 0, len(lines)
    for i, x in enumerate(lines):
        words += x.count(" ") + 1
        if words >= LONG_TEXT + 60:
            stop = i + 1
            break
    parsed = [Line(x) for x in lines[: stop + 2]]
    flags = prose_flags(parsed)[:stop]
    if stop < len(lines) and sum({x.text: len(x.words) for i, (x, f) in enumerate(zip(parsed, flags, strict=False)) if f and i not in signed}.values()) < LONG_TEXT + 10:
        return prose_flags(parsed + [Line(x) for x in lines[stop + 2 :]])
    return flags + [False] * (len(lines) - len(flags))


def look(text: str, prose: bool = True) -> Look:
    """The passages of a whole text but for its menu and footer lines. A filler line, a sentence that fills half of the document
    by three copies or more, and a stack trace are marked like signs; a copy of a sentence is no prose of its own. Without prose, no passage of a text that
    has no mark is called prose."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    whole = text.lower()
    hinted = _hinted(text, whole)
    filling = next(_fillers.iter(whole), None) is not None
    units: list[str] = []
    facts: list[list] = []  # line, signed, whether a trace
    chrome: list[str] = []
    weak = 3
    for at, x in enumerate(lines):
        blanks = x.count(" ")
        if blanks < 3 and IDLE.search(x):
            continue
        closes = x.rstrip("”\"»“’')]")[-1:] in _ENDS
        filled = filling and filler(_token.findall(x.lower()), weak)
        trace = not closes and bool(TRACE.search(x))
        signed = not filled and not trace and (hinted or blanks > 1 and _same.fullmatch(x)) and is_residue(x)
        if not (filled or trace or signed or closes) and (blanks < 8 or CHROME.search(x)):
            chrome.append(x)
            continue
        parts = [x] if blanks < 3 else [u for u in _unit.split(x) if u and not u.isspace()]
        if filled:
            marks, weak = [True] * len(parts), 1
        elif signed:
            marks = [is_residue(u) for u in parts]
            marks = marks if any(marks) else [True] * len(parts)
        else:
            marks = [False] * len(parts)
        units += parts
        facts += [[at, mark, trace] for mark in marks]
    lows = list(map(str.lower, units))
    seen = Counter(lows)
    if units and len(seen) * 2 < len(units) + 2:
        most = max(seen, key=lambda u: (seen[u], u))
        if seen[most] >= 3 and seen[most] * len(most) * 2 >= sum(map(len, units)):
            for u, f in zip(lows, facts, strict=True):
                f[1] |= u == most
    if sum(f[2] for f in facts) >= 2:
        for f in facts:
            f[1] |= f[2]
    words = _masked(units or chrome)
    got = Look([w for u in words for w in u])
    if units:
        signs = {f[0] for f in facts if f[1]}
        flags = _prose(lines, signs) if prose or signs else [False] * len(lines)
        first: set[str] = set()
        for low, w, (at, mark, _) in zip(lows, words, facts, strict=True):
            got.passages.append((" ".join(w), max(1, len(w)), mark, flags[at] and low not in first))
            first.add(low)
        places = list(dict.fromkeys(f[0] for f in facts))[:2]
        got.leads = any(f[1] for f in facts if f[0] in places)
    return got


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


_LOOKED = "doc_id BIGINT, class_id BIGINT, sim BIGINT, n INT, keys ARRAY<BIGINT>, p ARRAY<BIGINT>, size ARRAY<INT>, signed ARRAY<BOOLEAN>, prose ARRAY<BOOLEAN>, leads BOOLEAN"


def _lists(sizes: list[int], flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32()), flat)


def _looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
    names = [x.split()[0] for x in _LOOKED.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        keys: list[np.ndarray] = []
        passages: list[tuple[str, int, bool, bool]] = []
        many: list[int] = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # what is prose in a text without a sign matters only where its passages turn out to be residue
            got = look(text, False)
            if got.words:
                s = shingles(got.words)
                rows.append((i, _digest(" ".join(got.words)), simhash(s), len(s), got.leads))
                keys.append(first(s))
                passages += got.passages
                many.append(len(got.passages))
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
        *one, leads = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        p, size, signed, prose = zip(*passages, strict=True) if passages else [()] * 4
        flat = (pa.array(list(map(_digest, p)), pa.int64()), pa.array(size, pa.int32()), pa.array(signed, pa.bool_()), pa.array(prose, pa.bool_()))
        at = _lists(list(map(len, keys)), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        yield pa.record_batch([*one, at, *(_lists(many, x) for x in flat), leads], names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [look(t).words for t in batch.column(0).to_pylist()]
        ids = pa.array([_digest(" ".join(w)) for w in words], pa.int64())
        yield pa.record_batch([ids, pa.array([shingles(w).tolist() for w in words], pa.list_(pa.int64()))], ["id", "shingles"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = [look(t) for t in batch.column(0).to_pylist()]
        ids = pa.array([_digest(" ".join(x.words)) for x in seen], pa.int64())
        p = pa.array([[_digest(x) for x, *_ in s.passages] for s in seen], pa.list_(pa.int64()))
        yield pa.record_batch([ids, p, pa.array([[x for *_, x in s.passages] for s in seen], pa.list_(pa.bool_()))], ["class_id", "p", "prose"])


def _total(keep: Callable[[Column], Column], trusted: Column | None = None) -> Column:
    """Words of those passages of a text that are kept, by their flags t (trusted), m (signed) and x (prose)."""
    zipped = F.arrays_zip(F.col("size").alias("n"), (F.col("signed") if trusted is None else trusted).alias("t"), F.col("signed").alias("m"), F.col("prose").alias("x"))
    return F.aggregate(zipped, F.lit(0), lambda a, z: a + F.when(keep(z), z["n"]).otherwise(0))


def _led(trusted: Column | None = None) -> Column:
    """Whether trusted passages lead a text: half of its words, or in its first lines."""
    part = _total(lambda z: z["t"], trusted)
    return (part > 0) & ((part * 2 >= F.aggregate("size", F.lit(0), lambda a, x: a + x)) | F.col("leads"))


def _residue(trusted: Column | None = None) -> Column:
    return _led(trusted) & (_total(lambda z: z["x"] & ~z["t"], trusted) < FULL_TEXT) & (_total(lambda z: z["x"] & ~z["m"]) < LONG_TEXT)


def _classes(looked: DataFrame, parsed: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(classes, labels): one row for each masked text, and those that passages alone make residue, with how. parsed gives
    (class_id, p, prose) of the texts of some documents, for a frame of their ids and its bytes."""
    classes = stage(looked.dropDuplicates(["class_id"]).withColumn("led", _led()).withColumn("sure", _residue()), "classes")
    labels = classes.where("sure").select("class_id", F.lit("signs").alias("how"))
    spread = F.col("class_id")
    every = classes.select("class_id", F.explode(F.array_distinct("p")).alias("p"))
    led = classes.where("led").select("class_id", F.explode(F.array_distinct("p")).alias("p"))
    while True:
        # passages that stand in texts led by signs, then how many texts of any kind hold them
        often = stage(led.groupBy("p").agg(F.count(F.lit(1)).alias("led")).where(F.col("led") >= SUPPORT), "often")
        held = keyed_join(every, often, ["p"], often.count() * 32, spread).groupBy("p").agg(F.count(F.lit(1)).alias("texts"), F.first("led").alias("led"))
        sure = stage(held.where(F.col("led") >= CERTAINTY * F.col("texts")).select("p"), "sure")
        hits = keyed_join(every, sure, ["p"], sure.count() * 16, spread).groupBy("class_id").agg(F.collect_set("p").alias("ps"))
        rest = classes.where("NOT sure").join(hits, "class_id").join(labels.select("class_id"), "class_id", "left_anti")
        known = F.zip_with("signed", F.transform("p", lambda x: F.array_contains("ps", x)), lambda a, b: a | b)
        may = stage(rest.withColumn("known", known).drop("ps").where(_led(F.col("known"))), "may")
        marked = F.exists("signed", lambda x: x)
        bare = may.where(~marked)
        n = bare.count()
        if n:
            told = bare.drop("prose").join(parsed(bare.select("doc_id"), n * 16), ["class_id", "p"])
            may = may.where(marked).unionByName(told)
        more = stage(may.where(_residue(F.col("known"))).select("class_id", "p", "led"), "more")
        if not more.count():
            return classes, labels
        labels = stage(labels.unionByName(more.select("class_id", F.lit("passages").alias("how"))), "labels")
        led = stage(led.unionByName(more.where("NOT led").select("class_id", F.explode(F.array_distinct("p")).alias("p"))), "led")


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, component, how) of the documents that are residue: how is `signs` where trusted signs show it, `passages`
    where it is made of passages of other residue documents, `links` where it is a near-duplicate, over any number of
    links, of a residue document; component is the least class that its label comes from.

    documents has doc_id and text; other columns are ignored. Null, empty and blank texts are no cases; copies are
    cases together; no rows in, no rows out.
    """
    texts = documents.where("text IS NOT NULL").select("doc_id", "text")
    looked = stage(texts.mapInArrow(_looked, _LOOKED), "looked")

    def parsed(ids: DataFrame, size: int) -> DataFrame:
        """Prose of some documents, read again; what else a key brings along has other passages or comes twice."""
        key = F.coalesce("doc_id", F.lit(0)).alias("key")
        found = keyed_join(texts.select(key, "text"), ids.select(key).distinct(), ["key"], size, F.xxhash64("text"))
        return found.select("text").mapInArrow(_parsed, "class_id BIGINT, p ARRAY<BIGINT>, prose ARRAY<BOOLEAN>").dropDuplicates(["class_id", "p"])

    classes, labels = _classes(looked, parsed)
    nodes = classes.select(F.col("class_id").alias("id"), "sim", "n", "keys")

    def sets(ids: DataFrame, size: int) -> DataFrame:
        """Shingle sets of some classes, read again from one document of each."""
        first = keyed_join(looked.select("doc_id", F.col("class_id").alias("id")), ids, ["id"], size, F.col("doc_id")).groupBy("id").agg(F.min("doc_id").alias("doc_id"))
        found = keyed_join(texts, first.select("doc_id").distinct(), ["doc_id"], size, F.col("doc_id")).select("text").mapInArrow(_sets, "id BIGINT, shingles ARRAY<BIGINT>")
        return found.dropDuplicates(["id"])

    linked = reached(nodes, labels.select(F.col("class_id").alias("id")), sets)
    cases = linked.select(F.col("id").alias("class_id"), F.col("root").alias("component")).join(labels, "class_id", "left")
    cases = stage(cases.withColumn("how", F.coalesce("how", F.lit("links"))), "cases")
    return keyed_join(looked.select("doc_id", "class_id"), cases, ["class_id"], cases.count() * 32, F.col("doc_id"))


def without_residue(documents: DataFrame) -> DataFrame:
    """documents but for the residue ones."""
    return documents.join(residue_documents(documents).select("doc_id").distinct(), "doc_id", "left_anti")
