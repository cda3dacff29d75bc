"""Text decoded with the wrong charset: the affected records and their original text.

A chain is a pair (read as, written in), maybe applied twice. Every run of non-ASCII characters with the classes
of its neighbours is a cell. Expectation-maximization treats the chain of a cell as latent: the chance of a chain
is pooled per site and field, with the share over all sites behind it, and the chance of the restored characters
in their context is pooled over all records. Cells are counted once; the iterations run over counts of distinct
cells, not over records. Each record is then restored by the posterior of its chain, cell by cell, so that a
record garbled in part keeps its sound part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.text import site_of
from pagesieve.session import keyed_join, rows_and_bytes, stage

ROUNDS = 4
#: Pseudo-count of cells by which all sites' chain shares stand behind one site's.
BACKING = 20.0
#: Share of cells taken for garbled at the start, spread over the chains.
START_GARBLED = 0.05
#: Chance of a restored character never seen, in units of one over all characters.
UNSEEN = 0.5
#: Share of a character's chance left to contexts in which it was never seen.
BACKOFF = 0.02
#: Assigned characters of Unicode, about.
CHARACTERS = 150_000
#: Characters of other scripts share the chances of their block of so many code points.
SHARED = 1024

# The encoding chains, (read as, written in, times).
CHAINS = (
    ("cp1252", "utf-8", 1), ("latin-1", "utf-8", 1), ("mac_roman", "utf-8", 1), ("cp437", "utf-8", 1), ("cp850", "utf-8", 1),
    ("cp1251", "utf-8", 1), ("cp1250", "utf-8", 1), ("iso8859-2", "utf-8", 1), ("iso8859-15", "utf-8", 1), ("koi8-r", "utf-8", 1),
    ("cp866", "utf-8", 1), ("cp1252", "utf-8", 2), ("latin-1", "utf-8", 2),
    ("cp437", "cp1252", 1), ("cp850", "cp1252", 1), ("mac_roman", "cp1252", 1), ("cp1251", "cp1252", 1), ("cp1250", "cp1252", 1),
    ("cp1252", "mac_roman", 1), ("cp1252", "cp437", 1), ("cp1252", "cp850", 1), ("cp1252", "cp1251", 1), ("mac_roman", "cp1251", 1),
    ("koi8-r", "cp1251", 1), ("cp866", "cp1251", 1), ("cp1251", "koi8-r", 1), ("cp1252", "koi8-r", 1), ("cp1251", "cp866", 1), ("cp1252", "cp866", 1),
)
#: Place of each explanation in arrays: sound text, the chains, then bytes lost to U+FFFD.
SOUND, LOST = 0, len(CHAINS) + 1
STATES = len(CHAINS) + 2

_break = re.compile("\n")
_run = re.compile(r"[^\x00-\x7f]+")
_utf8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _bytes_of(codec: str) -> dict[str, int]:
    """Characters that each byte from 0x80 may have become; bytes without one stay control characters."""
    table = {chr(b): b for b in range(0x80, 0x100)} if codec in ("latin-1", "cp1252", "cp1250", "cp1251") else {}
    for b in range(0x80, 0x100):
        try:
            table[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    if codec in ("cp1252", "cp1250", "cp1251"):
        # a character of latin-1 stands for its byte only where the codec leaves the byte undefined
        for b in range(0x80, 0x100):
            try:
                if bytes([b]).decode(codec) != chr(b) and table.get(chr(b)) == b:
                    del table[chr(b)]
            except UnicodeDecodeError:
                pass
    return table


_back = {codec: _bytes_of(codec) for codec, _, _ in CHAINS}
_single = {}
for _, _right, _ in CHAINS:
    if _right != "utf-8":
        _single[_right] = [bytes([b]).decode(_right, "replace") for b in range(0x80, 0x100)]


def _undo_once(run: str, wrong: str, right: str) -> str | None:
    back = _back[wrong]
    if right != "utf-8":
        out = []
        for ch in run:
            b = back.get(ch)
            got = _single[right][b - 0x80] if b is not None else "�"
            if got == "�" or "\x80" <= got <= "\x9f":
                return None
            out.append(got)
        got = "".join(out)
        return got if got != run else None
    # parts of the run that map back to bytes, with the valid sequences among them decoded
    out, part, fixed = [], bytearray(), False

    def flush() -> None:
        nonlocal fixed
        raw, at = bytes(part), 0
        for m in _utf8.finditer(raw):
            out.append(chars(raw[at : m.start()]))
            out.append(m.group().decode())
            at, fixed = m.end(), True
        out.append(chars(raw[at:]))
        part.clear()
        source.clear()

    source: list[str] = []

    def chars(raw: bytes) -> str:
        back_again = {b: c for c, b in zip(source, part, strict=True)}
        return "".join(back_again[b] for b in raw)

    for ch in run:
        b = back.get(ch)
        if b is None:
            flush()
            out.append(ch)
        else:
            part.append(b)
            source.append(ch)
    flush()
    return "".join(out) if fixed else None


def undo(run: str, chain: tuple[str, str, int]) -> str | None:
    """The run as it was before the chain, or None where the chain can't have made it."""
    wrong, right, times = chain
    for _ in range(times):
        got = _undo_once(run, wrong, right)
        if got is None:
            return None
        run = got
    return run


def _kind(ch: str) -> str:
    """Class of a character next to a cell: l and u Latin letters, c and C Cyrillic, g and G Greek, a and A other
    letters (the capital for upper case), d digit, s blank, p ASCII mark, y other sign."""
    o = ord(ch)
    if o < 0x80:
        return "l" if "a" <= ch <= "z" else "u" if "A" <= ch <= "Z" else "d" if ch.isdigit() else "s" if ch.isspace() else "p"
    if not ch.isalpha():
        return "s" if ch == "\xa0" else "y"
    if 0x400 <= o < 0x530:
        return "C" if ch.isupper() else "c"
    if 0x370 <= o < 0x400:
        return "G" if ch.isupper() else "g"
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "u" if ch.isupper() else "l"
    return "A" if ch.isupper() else "a"


_LETTERS = "lucCgGaA"
_SCRIPT = {"l": "l", "u": "l", "c": "c", "C": "c", "g": "g", "G": "g", "a": "a", "A": "a"}


def _beside(me: str, neighbour: str) -> str:
    """A neighbour's class, with its case against mine in place of its own, so that capitals read like small letters."""
    if neighbour not in _LETTERS:
        return neighbour
    rel = "=" if me not in _LETTERS or me.isupper() == neighbour.isupper() else "^" if neighbour.isupper() else "v"
    return _SCRIPT[neighbour] + rel


def units(cell: str) -> list[str]:
    """Each non-ASCII character of a cell, in small letters, with its neighbours. A cell starts and ends with a class."""
    run, n = cell[1:-1], len(cell) - 2
    kinds = [_kind(c) for c in run]
    out = []
    for i, c in enumerate(run):
        if c >= "\x80":
            me = kinds[i]
            left, right = kinds[i - 1] if i else cell[0], kinds[i + 1] if i + 1 < n else cell[-1]
            out.append(c.lower()[:1] + _beside(me, left) + _beside(me, right))
    return out


def implausible(unit: str) -> float:
    """Log penalty of a character in its context that hardly occurs in sound text of any language: control and
    box-drawing characters, letters of two scripts side by side, a lone accented letter."""
    c, around = unit[0], unit[1:]
    if "\x80" <= c <= "\x9f":
        return math.log(0.01)
    if "\u2300" <= c <= "\u23ff" or "\u2500" <= c <= "\u259f":
        return math.log(0.02)
    kind = _kind(c)
    if kind in _LETTERS:
        script = _SCRIPT[kind]
        if any(x in "lcga" and x != script for x in around if x.isalpha() and x in "lcga"):
            return math.log(0.01)
        if around == "ss" and kind in "lu":
            return math.log(0.3)
    return 0.0


_ASCII = {chr(i): _kind(chr(i)) for i in range(0x80)}


def cells(text: str) -> list[tuple[str, int, int]]:
    """(cell, start, end) of every run of non-ASCII characters; what stands beside a run is ASCII or the text's end."""
    out, text_end = [], text + " "
    for m in _run.finditer(text):
        a, b = m.span()
        out.append((_ASCII[text_end[a - 1]] + m.group() + _ASCII[text_end[b]], a, b))
    return out


def undo_cell(cell: str, chain: tuple[str, str, int]) -> tuple[str, bool] | None:
    """(restored run, whether the blank after it belonged to it). A no-break space that ended a sequence may have
    become a blank on the way."""
    run = cell[1:-1]
    if chain[1] == "utf-8" and cell[-1] == "s" and run[-1] in "ÃÂ├┬√¬":
        got = undo(run + "\xa0", chain)
        if got is not None and not got.endswith("\xa0"):
            return got, True
    got = undo(run, chain)
    return None if got is None else (got, False)


@lru_cache(maxsize=1 << 14)
def explanations(cell: str) -> dict[int, list[str]]:
    """For each state that can explain the cell, the restored characters in their context. Distinct cells are few, and a worker
    meets them again in each round."""
    if "�" in cell:
        return {LOST: []}
    out = {SOUND: units(cell)}
    for i, chain in enumerate(CHAINS, 1):
        got = undo_cell(cell, chain)
        if got is not None:
            out[i] = units(cell[0] + got[0] + cell[-1])
    return out


def shared(unit: str) -> str:
    """The unit as it is counted: characters of the scripts that the chains write, of punctuation and of signs stand for
    themselves, all others for their block. So there are at most 6,100 of them, in 256 contexts, whatever the corpus."""
    o = ord(unit[0])
    return unit if o < 0x590 or 0x1E00 <= o < 0x2C00 else chr(o // SHARED * SHARED if o // SHARED * SHARED != 0xD800 else 0xE000) + unit[1:]


class Chances:
    """Log chance of a character in its context; an unseen context backs off to the character, and an unseen
    character shares its mass with all of Unicode."""

    def __init__(self, counts: dict[str, float]) -> None:
        self.total = sum(counts.values()) or 1.0
        single: Counter = Counter()
        for u, w in counts.items():
            single[u[0]] += w
        self.log = {u: math.log((w + UNSEEN * 0.1) / self.total) for u, w in counts.items()}
        self.single = {c: math.log(BACKOFF * (w + UNSEEN * 0.1) / self.total) for c, w in single.items()}
        self.none = math.log(UNSEEN / self.total / CHARACTERS)
        self.known: dict[str, float] = {}

    def __call__(self, unit: str) -> float:
        got = self.known.get(unit)
        if got is None:
            u = shared(unit)
            got = self.log.get(u)
            if got is None:
                got = self.single.get(u[0], self.none)
            got += implausible(unit) - (math.log(SHARED) if u[0] != unit[0] or u is not unit else 0.0)
            if len(self.known) < 200_000:
                self.known[unit] = got
        return got


def _logs(cell: str, chance: Chances) -> dict[int, float]:
    return {s: sum(map(chance, us)) for s, us in explanations(cell).items()}


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for f, s, t in zip(*(batch.column(c).to_pylist() for c in ("field", "site", "text")), strict=True):
            for cell, _, _ in cells(t):
                seen[f, s, cell] += 1
        if seen:
            f, s, c = zip(*seen, strict=True)
            yield pa.record_batch([pa.array(f, pa.string()), pa.array(s, pa.string()), pa.array(c, pa.string()), pa.array(seen.values(), pa.int64())], ["field", "site", "cell", "n"])


def _cell_logs(chance: Chances):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_logs(c, chance) for c in batch.column("cell").to_pylist()]
            logs = [[r.get(i) for i in range(STATES)] for r in rows]
            yield pa.record_batch([batch.column("cell"), pa.array(logs, pa.list_(pa.float64()))], ["cell", "logs"])

    return run


def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for cell, weights in zip(batch.column("cell").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            for state, us in explanations(cell).items():
                if weights[state] > 0:
                    for u in us:
                        seen[shared(u)] += weights[state]
        yield pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.float64())], ["unit", "w"])


def _chances(weighted: DataFrame) -> Chances:
    """Log chances of the restored characters: at most 6,100 characters and blocks in 256 contexts come to the driver, some 20
    bytes each, whatever the corpus."""
    got = weighted.mapInArrow(_unit_counts, "unit STRING, w DOUBLE").groupBy("unit").agg(F.sum("w").alias("w")).toArrow()
    return Chances(dict(zip(got["unit"].to_pylist(), got["w"].to_pylist(), strict=True)))


def _prior() -> list[float]:
    return [1 - START_GARBLED] + [START_GARBLED / (STATES - 1)] * (STATES - 1)


def fit(records: DataFrame) -> tuple[Chances, DataFrame, list[float]]:
    """(log chances, chain shares by field and site, shares over all) from
    records of (field, site, text)."""
    counts = stage(records.mapInArrow(_count_cells, "field STRING, site STRING, cell STRING, n BIGINT").groupBy("field", "site", "cell").agg(F.sum("n").alias("n")), "cells")
    first = F.array(F.lit(1.0), *[F.lit(0.0)] * (STATES - 1))
    chance = _chances(counts.groupBy("cell").agg(F.sum("n").cast("double").alias("n")).select("cell", F.transform(first, lambda x: x * F.col("n")).alias("weights")))
    overall, shares = _prior(), None
    distinct = stage(counts.select("cell").distinct(), "distinct")
    n, size = rows_and_bytes(distinct, "cell")
    cells_bytes = size + n * STATES * 9
    for _ in range(ROUNDS):
        logs = distinct.mapInArrow(_cell_logs(chance), "cell STRING, logs ARRAY<DOUBLE>")
        joined = keyed_join(counts, logs, ["cell"], cells_bytes, F.xxhash64("field", "site"))
        if shares is not None:
            joined = joined.join(shares, ["field", "site"], "left")
        prior = F.array(*map(F.lit, overall)) if shares is None else F.coalesce("share", F.array(*map(F.lit, overall)))
        likely = F.zip_with(prior, F.col("logs"), lambda p, x: F.when(x.isNull(), 0.0).otherwise(p * F.exp(x)))
        joined = joined.select("field", "site", "cell", "n", likely.alias("p"))
        total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
        post = stage(joined.select("field", "site", "cell", "n", F.transform("p", lambda x: x * F.col("n") / total).alias("p")), "posterior")
        sums = [F.sum(F.col("p")[i]).alias(f"p{i}") for i in range(STATES)]
        chance = _chances(post.groupBy("cell").agg(*sums).select("cell", F.array(*(f"p{i}" for i in range(STATES))).alias("weights")))
        per = post.groupBy("field", "site").agg(F.sum("n").alias("n"), *sums)
        row = per.agg(F.sum("n").alias("n"), *(F.sum(f"p{i}").alias(f"p{i}") for i in range(STATES))).first()
        if not row["n"]:
            break
        overall = [(row[f"p{i}"] + 1e-3) / (row["n"] + 1e-3 * STATES) for i in range(STATES)]
        shares = stage(per.select("field", "site", F.array(*((F.col(f"p{i}") + BACKING * overall[i]) / (F.col("n") + BACKING) for i in range(STATES))).alias("share")), "shares")
    if shares is None:
        shares = counts.select("field", "site", first.alias("share")).limit(0)
    return chance, shares, overall


#: Log chance that a garbled line keeps a cell that its chain can't have made.
_KEPT = math.log(0.1)
#: Log gain over a sound reading by which a UTF-8 chain plainly explains a cell by itself.
_PLAIN = 5.0
#: Shares of garbled lines that a garbled record may have.
_MIXES = (0.1, 0.5, 0.9)


def restore(text: str, share, logs, tilted: bool = True) -> tuple[int, float, str] | None:
    """(state, posterior, restored text) of a garbled record, None for a sound one. logs gives a cell's log chances
    by state and what each state gains over a sound reading; share gives the chain shares when they are needed.
    tilted is False where no share is greater than that of sound text, so that nothing is garbled without a gain."""
    found = cells(text)
    gains: dict[int, float] = {}
    alike = Counter(c for c, _, _ in found)
    # one word repeated is little more evidence than once: the weight of cells alike grows slowly, by the logarithm of their number
    weight = {c: 1 + math.log(n) / 3 for c, n in alike.items()}
    for c in alike:
        for state, gain in logs(c)[1]:
            gains[state] = gains.get(state, 0.0) + gain * weight[c]
    if not gains and not tilted:
        return None
    share = share()
    known = [(c, a, b, logs(c)[0]) for c, a, b in found]
    # no mix of lines scores more than the gains of its cells together, and a state without any no more than its share
    top = max((math.log(share[s]) + gains.get(s, 0.0) for s in {s for *_, g in known for s in g if s != SOUND}), default=-math.inf)
    if top <= math.log(share[SOUND]):
        return None
    if any(LOST in g for *_, g in known):
        best, sure = LOST, 1.0
    else:
        # the cells of a line are garbled together or not at all
        lines: dict[int, dict[str, float]] = {}
        breaks = [m.start() for m in _break.finditer(text)]
        for c, a, _, _ in known:
            line = lines.setdefault(bisect_left(breaks, a), {})
            line[c] = line.get(c, 0.0) + weight[c] / alike[c]
        by = {c: g for c, _, _, g in known}
        score = {SOUND: math.log(share[SOUND]) + sum(n * by[c][SOUND] for line in lines.values() for c, n in line.items())}
        for state in {s for g in by.values() for s in g if s != SOUND}:
            sums = []
            for line in lines.values():
                sound = sum(n * by[c][SOUND] for c, n in line.items())
                off = sum(n * (by[c][state] if state in by[c] else by[c][SOUND] + _KEPT) for c, n in line.items())
                sums.append((sound, off))
            mixed = []
            for mix in _MIXES:
                ll = 0.0
                for sound, off in sums:
                    x, y = sound + math.log(1 - mix), off + math.log(mix)
                    ll += max(x, y) + math.log1p(math.exp(-abs(x - y)))
                mixed.append(ll)
            score[state] = math.log(share[state]) + max(mixed)
        best = max(score, key=score.get)
        if best == SOUND:
            return None
        top = score[best]
        sure = 1 - math.exp(score[SOUND] - top) / sum(math.exp(x - top) for x in score.values())
    # bytes lost can't be had, but a record with some may have others that a UTF-8 chain plainly explains
    out, at = [], 0
    # where more text is garbled by the chain than sound, the shares speak for the chain in each cell
    ahead = max(0.0, math.log(share[best]) - math.log(share[SOUND]))
    for c, a, b, g in known:
        if best != LOST:
            state = best if g.get(best, -math.inf) + ahead > g[SOUND] else SOUND
        else:
            state = max((s for s in g if s not in (SOUND, LOST) and CHAINS[s - 1][1] == "utf-8" and g[s] > g[SOUND] + _PLAIN), key=g.get, default=SOUND)
        if state != SOUND:
            run, blank = undo_cell(c, CHAINS[state - 1])
            out += [text[at:a], run]
            at = b + blank
    return best, sure, "".join(out) + text[at:]


def _tilted(shares: pa.Array, overall: list[float]) -> list[bool]:
    """For each row whether some chain has a greater share than sound text; null shares stand for overall."""
    out = np.full(len(shares), max(overall) > overall[SOUND])
    own = np.asarray(shares.flatten()).reshape(-1, STATES)
    out[np.asarray(shares.is_valid())] = own.max(1) > own[:, SOUND]
    return out.tolist()


def _mark(chance: Chances, overall: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[dict[int, float], list[tuple[int, float]]]] = {}

        def logs(cell: str) -> tuple[dict[int, float], list[tuple[int, float]]]:
            got = memo.get(cell)
            if got is None:
                if len(memo) > 200_000:
                    memo.clear()
                by = _logs(cell, chance)
                sound = by.get(SOUND, -math.inf)
                got = memo[cell] = by, [(s, x - sound) for s, x in by.items() if x > sound]
            return got

        for batch in batches:
            rows, shares = [], batch.column("share")
            tilted = _tilted(shares, overall)
            for k, (f, u, i, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("field", "url", "node_id", "text")), strict=True)):
                got = restore(t, lambda k=k, shares=shares: shares[k].as_py() or overall, logs, tilted[k])
                if got is not None:
                    state, sure, text = got
                    chain = "bytes lost" if state == LOST else "{1} read as {0}".format(*CHAINS[state - 1]) + (" twice" if CHAINS[state - 1][2] > 1 else "")
                    rows.append((f, u, i, chain, sure, "�" not in text, text))
            if rows:
                cols = list(zip(*rows, strict=True))
                types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["table_name", "url", "node_id", "chain", "posterior", "restorable", "restored"])

    return run


def garbled(records: DataFrame) -> DataFrame:
    """(table_name, url, node_id, chain, posterior, restorable, restored) of the records with garbled text.

    records has field, url, node_id, text; other columns are ignored. Null urls and texts are no cases, nor is pure
    ASCII; repeated rows repeat; records with U+FFFD are cases whose lost bytes stay lost.
    """
    kept = records.where("url IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike("[^\\x00-\\x7f]"))
    kept = kept.select("field", "url", "node_id", "text", site_of(F.col("url")).alias("site"))
    chance, shares, overall = fit(kept.select("field", "site", "text"))
    joined = keyed_join(kept, shares, ["field", "site"], shares.count() * (STATES * 8 + 64), F.xxhash64("url", "node_id"), "left")
    ddl = "table_name STRING, url STRING, node_id INT, chain STRING, posterior DOUBLE, restorable BOOLEAN, restored STRING"
    return joined.select("field", "url", "node_id", "text", "share").mapInArrow(_mark(chance, overall), ddl)
