"""Problem 2: statistics of a text that tell prose from lists, tables and junk.

Around every line of a text two distributions are taken: the characters by class (function
words, words of likely, middling and unlikely letters, names, numbers, marks, separators,
oddities, repetitions) and the lines by form (how they begin, end, are divided, how long they
are). Their Jensen-Shannon divergence from profiles decides what the line belongs to. The
profiles are measured: those of prose on the clean samples of each language, as they are,
wrapped, in capitals and as scanned; those of lists, tables and junk on the same samples'
words set out as such (`structures`). The kind of a text is what most of its characters belong to.

Defined results: null, empty and blank texts have null statistics and kind; repeated
rows give one row for `p2_found` and `p2_stats`; texts of any length are read whole.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import spread, table

KINDS = ("list", "table", "junk")
#: Classes of characters, then forms of lines: how a line begins, how it ends, separators in it, its length.
CLASSES = ("function", "likely", "middling", "unlikely", "name", "number", "mark", "separator", "odd", "repeated")
FORMS = ("begin:mark", "begin:figure", "begin:capital", "begin:other", "end:stop", "end:figure", "end:other", "cells:1", "cells:2", "cells:more", "length:short", "length:half", "length:full")
_FUNCTION, _LIKELY, _MIDDLING, _UNLIKELY, _NAME, _NUMBER, _MARK, _SEPARATOR, _ODD, _REPEATED = range(len(CLASSES))
#: Lines before and behind that count with a line, half as much as itself; what a separator weighs in characters.
NEAR, SEPARATOR = 2, 3
#: Characters from which a line counts as several.
FULL = 80

_BULLETS = "-*+•–—‣◦·▪●○☐☑☒✓✔>"
_NUMBERED = re.compile(r"\(?(?:\d{1,3}|[a-zA-Z]|[ivxlc]{1,5})[.)]")
_DIVIDES = re.compile(r"\t|\||[ \u00a0]{2,}|(?:\.\s?){4,}|…{2,}|_{4,}|;|,(?=\S)(?!\d{3}(?!\d))")
#: One of these stands wherever `_DIVIDES` matches anything but a comma.
_DIVIDERS = ("|", "  ", "\t", ";", "\u00a0", "....", ". .", "……", "____")
_CELL = re.compile(r"[(\[+$€£-]*\d[\d,.'%)\]]*|-|–|—|n/a|N/A|million|billion")
_STOP = re.compile(r"[.!?。！？:;…][\"'”»)\]]*\s*$")
_STOPS, _CLOSES = ".!?。！？:;…", "\"'”»)]"
_EDGE = "\"'“”«»‘’()[]{}<>.,;:!?¡¿…·*_—–-/\\|`´"
_CODE = re.compile(r"[A-Za-z]{1,2}[-/]?\d{1,4}(?:-\d+)?[a-z]?|\d{1,3}[a-z]?")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_LINES = re.compile(r"[\n\r\f\v\x85\u2028\u2029]+")


def _letters(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


class _Deck:
    """Deals all cards in a random order, then all of them again."""

    def __init__(self, cards: list[str], rng: random.Random) -> None:
        self.cards, self.rng = cards, rng
        self.anew()

    def anew(self) -> None:
        self.left, self.through = self.rng.sample(self.cards, len(self.cards)), False

    def deal(self) -> str:
        if not self.left:
            self.left = self.rng.sample(self.cards, len(self.cards))
        card = self.left.pop()
        self.through = self.through or not self.left
        return card


def structures(samples: list[tuple[str, str]], seed: int = 7) -> list[tuple[str, str, str]]:
    """(kind, sort, text): all the samples' texts as prose and junk, all their content words as every sort of list and table."""
    rng = random.Random(seed)
    by: dict[str, list[str]] = defaultdict(list)
    for lang, text in samples:
        by[lang].append(text)
    out = []
    for lang, texts in by.items():
        wide = 2 * sum(bool(_WIDE.search(t)) for t in texts) > len(texts)
        pieces = [x for t in texts for x in (re.findall(r"[^\W\d_]+", t) if wide else _letters(t).split())]
        # Entries are made of content words: the ones that come rarely.
        often = Counter(pieces)
        rare = [w for w in pieces if often[w] <= 2 and len(w) > (1 if wide else 4)] or pieces
        if wide:
            rare = [w[i : i + 12] for w in rare for i in range(0, len(w), 12)]
        words = _Deck(rare or texts, rng)
        clauses = _Deck([x.strip() for t in texts for x in re.split(r"[.。,，;；]", t) if x.strip()] or texts, rng)
        word = words.deal
        name = lambda: word().capitalize()
        figure = lambda: rng.choice([f"{rng.randrange(1, 99_999):,}", str(rng.randrange(1, 999)), f"({rng.randrange(99_999):,})", f"{rng.randrange(1, 999) / 10}", "-", "n/a", f"{rng.randrange(1, 999) / 10} million", f"{rng.randrange(100)}%"])
        year = lambda: str(rng.randrange(1990, 2030))
        phrase = lambda n: " ".join(word() for _ in range(n))

        def wrapped(t: str, width: int) -> str:
            if wide:
                return "\n".join(t[i : i + width // 2] for i in range(0, len(t), width // 2))
            lines, line = [], ""
            for w in t.split():
                if len(line) + len(w) > width:
                    lines.append(line)
                    line = ""
                line += " " * bool(line) + w
            return "\n".join([*lines, line])

        def scanned(t: str) -> str:
            swaps = {"e": "c", "i": "1", "l": "1", "o": "0", "m": "rn", "s": "5", "n": "ri", "a": "@", "t": "f"}
            text = "".join(swaps[c] if c in swaps and rng.random() < 0.04 else c for c in t)
            return re.sub(r"(\w{3})\n", lambda m: m[1] + rng.choice(["-\n", "\n"]), wrapped(text, 70))

        def shuffled(w: str) -> str:
            return "".join(rng.sample(w, len(w)))

        def rows(make: Callable[[int], str]) -> Callable[[], str]:
            return lambda: "\n".join(make(i) for i in range(20))

        def every(deck: _Deck, kind: str, sort: str, *ways: Callable[[], str]) -> None:
            """Texts of a sort, all ways in turn, until every card stands in one."""
            deck.anew()
            while not deck.through:
                out.extend((kind, sort, way()) for way in ways)

        for t in texts:
            out += [("prose", lang, t), ("prose", lang, wrapped(t, 72)), ("prose", f"{lang} scanned", scanned(t)), ("prose", f"{lang} capitals", wrapped(t.upper(), 72))]
            out.append(("junk", f"{lang} shuffled", " ".join(map(shuffled, t.split())) if not wide else shuffled(t)))
            out += [("junk", "repeated", (t[i : i + 120] + " ") * 30) for i in range(0, len(t), 120)]
        every(words, "junk", "repeated", lambda: f"{phrase(rng.randrange(1, 3))} " * 60)
        group = "wide" if wide else "narrow"
        marks = [lambda i: rng.choice("-*•–☐") + " ", lambda i: f"{i + 1}. ", lambda i: f"({chr(97 + i % 26)}) ", lambda i: f"{chr(97 + i % 26)}) ", lambda i: f"({_roman(i + 1)}) "]
        every(words, "list", f"{group} marked", *(rows(lambda i, mark=mark: mark(i) + phrase(rng.randrange(1, 5))) for mark in marks))
        every(clauses, "list", f"{group} marked sentences", *(rows(lambda i, mark=mark: mark(i) + clauses.deal() + rng.choice([";", ".", ""])) for mark in marks))
        every(words, "list", f"{group} marked fields", *(rows(lambda i, mark=mark: mark(i) + "; ".join([phrase(2), name()]) + ";") for mark in marks))
        names = [lambda i, sep=sep: f"{name()}{sep}{name()}" for sep in (", ", " – ", "; ")]
        every(words, "list", f"{group} names", *map(rows, [*names, lambda i: " ".join(name() for _ in range(rng.randrange(1, 5)))]))
        every(words, "list", f"{group} short", rows(lambda i: phrase(rng.randrange(1, 4))))

        def grid(left: str, sep: str, right: str, n: int) -> str:
            cells = [[name(), *(year() for _ in range(n))], *([name(), *(figure() for _ in range(n))] for _ in range(20))]
            return "\n".join(left + sep.join(r) + right for r in cells)

        for sort, *marks in (("piped", "| ", " | ", " |"), ("tabbed", "", "\t", ""), ("fields", "", ";", ""), ("commas", "", ",", ""), ("columns", "", "      ", ""), ("cells", "", "\n", "")):
            every(words, "table", f"{group} {sort}", *(lambda n=n, marks=marks: grid(*marks, n) for n in (2, 3, 4)))
        every(words, "table", f"{group} records", rows(lambda i: f"{i},{name()} {word()},{year()},{figure().replace(',', '')}"))
        every(words, "table", f"{group} form", rows(lambda i: f"{i + 1}{rng.choice('ab')} {name()} {word()} {'.' * rng.randrange(6, 30)} {figure()}"))
        every(words, "table", f"{group} blanks", rows(lambda i: f"{name()} {word()}: {'_' * rng.randrange(6, 20)}"))
    signs = "§†‡°¬¤¦µ¶ƒ∂∆∫≈≠≤≥÷×ßæç^~#@&%$*{}[]<>|/\\"
    for _ in range(20):
        out.append(("junk", "signs", "\n".join("".join(rng.choice(signs + " 0x") for _ in range(rng.randrange(5, 60))) for _ in range(12))))
        out.append(("junk", "undecoded", "".join(rng.choice("\ufffd\ufffd\u25a1?? ") for _ in range(400))))
        out.append(("junk", "figures", "\n".join(" ".join(f"{rng.randrange(65536):04x}" for _ in range(8)) for _ in range(20))))
        out.append(("junk", "letters", " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxzqwaeiou") for _ in range(rng.randrange(2, 9))) for _ in range(80))))
    return out


def _roman(n: int) -> str:
    return "".join(("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[d] if k else "x" * d for k, d in enumerate(divmod(n, 10)))


@dataclass
class Profiles:
    """What the samples teach: function words, letter pairs, and the profile of each sort of text."""

    function: frozenset[str]
    wide_function: tuple[str, ...]
    pairs: dict[str, float]
    floor: float
    unlikely: float = -1e9
    likely: float = -1e9
    sorts: list[tuple[str, str]] = field(default_factory=list)
    matrix: np.ndarray | None = None

    @staticmethod
    def learn(samples: Iterable[tuple[str, str]], words: Iterable[str]) -> Profiles:
        """From (language, passage) pairs and frequent words; both are small fixed tables."""
        samples, words = sorted(set(samples)), [w.lower() for w in words]  # repeated rows teach once
        counts: Counter[str] = Counter()
        first: Counter[str] = Counter()
        for _, text in samples:
            for w in _letters(text).split():
                w = f" {w} "
                counts.update(w[i : i + 2] for i in range(len(w) - 1))
                first.update(w[:-1])
        pairs = {p: math.log((n + 0.1) / (first[p[0]] + 5)) for p, n in counts.items()}
        narrow = frozenset(w for w in words if not _WIDE.search(w))
        wide = tuple(w for w in words if _WIDE.search(w))
        out = Profiles(narrow, wide, pairs, math.log(0.1 / 500))
        scores = sorted(s for _, text in samples for w in _letters(text).split() if w not in narrow and (s := out.readable(w)) is not None)
        if scores:
            out.unlikely, out.likely = scores[len(scores) // 20], scores[len(scores) // 2]
        by: dict[tuple[str, str], list[np.ndarray]] = defaultdict(list)
        reader = Reader(out)
        for kind, sort, text in structures(samples):
            found = reader.lines(text)
            if found is not None:
                by[kind, sort].append(np.average(found.spread, axis=0, weights=found.size))
        out.sorts = list(by)
        out.matrix = np.array([_share(np.mean(m, axis=0)) for m in by.values()], np.float32)
        return out

    def readable(self, text: str) -> float | None:
        """Mean log probability of the letter pairs of a text's narrow words; None without such words."""
        get, floor = self.pairs.get, self.floor
        total, n = 0.0, 0
        for w in _letters(text).split():
            if _WIDE.search(w):
                continue
            w = f" {w} "
            for i in range(len(w) - 1):
                total += get(w[i : i + 2], floor)
            n += len(w) - 1
        return total / n if n else None


def _share(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, float) + 1e-4
    return m / m.sum(-1, keepdims=True)


def _head(token: str) -> bool:
    """Whether a line's first token marks an entry."""
    return token in _BULLETS or token == "o" or token[-1] in ".)" and len(token) < 7 and _NUMBERED.fullmatch(token) is not None


#: Columns of what is known of a token: characters of each class, letters, digits, function words, wide, a word, a figure.
_LETTERS, _DIGITS, _SMALL, _WIDES, _WORD, _FIGURE = range(len(CLASSES), len(CLASSES) + 6)
_COLS = len(CLASSES) + 6
MOST_TOKENS = 200_000


@dataclass
class Lines:
    """The lines of a text: characters, and the distribution of classes and forms around each."""

    spread: np.ndarray
    size: np.ndarray
    words: int
    letters: int
    digits: int
    function: float
    stops: int


class Reader:
    """Measures texts and finds the nearest profile of each line."""

    def __init__(self, profiles: Profiles) -> None:
        self.p = profiles
        self.known: dict[str, int] = {}
        self.facts = np.zeros((1024, _COLS), np.float32)
        self.prose = [i for i, (k, _) in enumerate(profiles.sorts) if k == "prose"]

    def tokens(self, raw: list[str]) -> np.ndarray:
        """What is known of each token, a row each."""
        known = self.known
        if len(known) > MOST_TOKENS:
            known.clear()
        ids = list(map(known.get, raw))
        if None in ids:
            for i, t in enumerate(raw):
                if ids[i] is None:
                    k = known.get(t)
                    if k is None:
                        k = known[t] = len(known)
                        if k >= len(self.facts):
                            self.facts = np.concatenate((self.facts, np.zeros_like(self.facts)))
                        self.facts[k] = self._token(t)
                    ids[i] = k
        return self.facts[ids]

    def _token(self, raw: str) -> list[float]:
        word = raw.strip(_EDGE)
        plain = word.isalpha()
        letters = len(word) if plain else sum(map(str.isalpha, raw))
        digits = 0 if plain else sum(map(str.isdigit, raw))
        wide = not raw.isascii() and bool(_WIDE.search(raw))
        kind = _MIDDLING if wide else self._class(raw, word, letters, digits)
        out = [0.0] * _COLS
        if word and kind != _ODD and kind != _MARK:
            out[kind], out[_MARK] = len(word), len(raw) - len(word)
        else:
            out[kind] = len(raw)
        figure = kind == _NUMBER or _CELL.fullmatch(raw) is not None
        out[_LETTERS:] = letters, digits, kind == _FUNCTION, wide, letters > digits and not figure, figure
        return out

    def _class(self, raw: str, word: str, letters: int, digits: int) -> int:
        """The class of a token's characters."""
        if not word:
            return _MARK if len(raw) <= 3 or not raw.strip(".…_-=*|·") else _ODD
        n = len(word)
        if n > letters:
            odd = n - letters - digits - sum(c in "'’-.,/&%$€+:" for c in word)
            if "\ufffd" in raw or odd > max(1, n // 3) or (odd > 0 and n < 3):
                return _ODD
        if not letters:
            return _NUMBER
        if digits:
            if _CODE.fullmatch(word) or digits * 2 <= letters and letters >= 3 and digits < 3 and n < 25:
                return _NUMBER if digits > letters else _MIDDLING
            return _ODD
        low = word.lower()
        if low in self.p.function:
            return _FUNCTION
        if not (word == low or word.isupper() or word.istitle()) and sum(a.islower() and b.isupper() for a, b in zip(word, word[1:])) > ("-" in word):
            return _ODD
        if n > 40 and "-" not in word:
            return _ODD
        if word[1:].islower() and word[0].isupper():
            return _NAME  # names follow no language's letter pairs
        score = self.p.readable(low)
        return _MIDDLING if score is None else _LIKELY if score >= self.p.likely else _UNLIKELY if score < self.p.unlikely else _MIDDLING

    def lines(self, text: str) -> Lines | None:
        """Measures of a text's lines; None of a blank text."""
        found: list[tuple[str, int, int]] = []
        words: list[str] = []
        for line in _LINES.split(text):
            s = line.strip()
            if not s:
                continue
            n = 0
            # Semicolons and commas divide cells where several of them do, or where figures stand between them.
            if s.count(",") > s.count(", ") or any(map(s.__contains__, _DIVIDERS)):
                parts = _DIVIDES.findall(s)
                hard = sum(p not in ";," for p in parts)
                soft = len(parts) - hard
                if soft >= 2 or soft and not hard:
                    s = _DIVIDES.sub(lambda m: m[0] + " " if m[0] in ";," else m[0], s)
                n = hard + (soft if soft >= 2 else 0)
            raw = s.replace("|", " ").split() if n else s.split()
            if raw:
                found.append((s, len(raw), n))
                words += raw
        if not words:
            return None
        facts = self.tokens(words)
        again = self._repeated(words, facts)
        if again.any():
            facts = facts.copy()
            facts[again, _REPEATED] = facts[again, : len(CLASSES)].sum(1)
            facts[again, :_REPEATED] = 0
        counts = np.array([k for _, k, _ in found])
        starts = np.zeros(len(found), np.int64)
        np.cumsum(counts[:-1], out=starts[1:])
        sums = np.add.reduceat(facts, starts, axis=0)
        chars = sums[:, : len(CLASSES)]
        size = chars.sum(1)
        for i in np.flatnonzero(sums[:, _WIDES] > 0).tolist():
            # Without blanks between words, function words are found by their characters.
            small = min(chars[i, _MIDDLING], 3 * sum(found[i][0].count(x) * len(x) for x in self.p.wide_function))
            chars[i, _FUNCTION] += small
            chars[i, _MIDDLING] -= small
        chars[:, _SEPARATOR] += [SEPARATOR * n for _, _, n in found]
        begin = np.where(facts[starts, _FIGURE] > 0, 1, 3)
        end = np.where(facts[starts + counts - 1, _FIGURE] > 0, 5, 6)
        stops = 0
        for i, ((s, k, _), at) in enumerate(zip(found, starts.tolist())):
            if k > 1 and _head(words[at]):
                begin[i] = 0
            elif s[0].isupper() and begin[i] == 3:
                begin[i] = 2
            if s[-1] in _STOPS or s[-1] in _CLOSES and _STOP.search(s[-4:]):
                stops += 1
                if end[i] == 6:
                    end[i] = 4
        long = np.array([len(s) for s, _, _ in found])
        cells = 7 + np.minimum([n for _, _, n in found], 2)
        forms = np.zeros((len(found), len(FORMS)), np.float32)
        for column in (begin, end, cells, 10 + (long >= 14) + (long >= 50)):
            forms[np.arange(len(found)), column] = np.maximum(1.0, long / FULL)
        spread_ = np.concatenate((_near(chars), _near(forms) / 4), 1)
        spread_[:, : len(CLASSES)] /= np.maximum(spread_[:, : len(CLASSES)].sum(1, keepdims=True), 1e-9)
        spread_[:, len(CLASSES) :] /= np.maximum(spread_[:, len(CLASSES) :].sum(1, keepdims=True), 1e-9)
        total = facts.sum(0)
        return Lines(spread_ / 2, size, len(words), int(total[_LETTERS]), int(total[_DIGITS]), float(chars[:, _FUNCTION].sum()), stops)

    @staticmethod
    def _repeated(words: list[str], facts: np.ndarray) -> np.ndarray:
        """Tokens in three words that come again and again: four times and in an eightieth of the text at least."""
        n = len(words)
        out = np.zeros(n, bool)
        if n < 8:
            return out
        three = list(zip(words, words[1:], words[2:]))
        least = max(4, n // 80)
        often = {t for t, k in Counter(three).items() if k >= least}
        if often:
            word = facts[:, _WORD] + facts[:, _ODD] > 0
            for i, t in enumerate(three):
                if t in often and word[i : i + 3].sum() >= 2:
                    out[i : i + 3] = True
        return out

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest profile, all divergences) of each row of q."""
        m = self.p.matrix
        if not hasattr(self, "_own"):
            self._own = (m * np.log2(m)).sum(1)
        q = _share(q).astype(np.float32)
        far = np.empty((len(q), len(m)), np.float32)
        own = (q * np.log2(q)).sum(1)
        for lo in range(0, len(q), 512):
            mid = (q[lo : lo + 512, None, :] + m[None]) / 2
            far[lo : lo + 512] = (own[lo : lo + 512, None] + self._own) / 2 - (mid * np.log2(mid)).sum(2)
        return far.argmin(1), far


def _near(rows: np.ndarray) -> np.ndarray:
    """Each row and, half as much, the rows near it."""
    out = rows.copy()
    for k in range(1, NEAR + 1):
        out[k:] += rows[:-k] / 2
        out[:-k] += rows[k:] / 2
    return out


SCHEMA = (
    "text_id long, kind string, words int, mean_word_length double, symbol_ratio double, digit_ratio double, stop_line_ratio double, "
    "common_word_ratio double, list_ratio double, table_ratio double, junk_ratio double, profile string, divergence double, prose_divergence double"
)


def text_stats(df: DataFrame, samples: DataFrame, common: DataFrame, key: str = "text_id", text: str = "pdf_text") -> DataFrame:
    """Statistics and kind of each distinct (key, text). `samples` and `common` are reference tables of fixed size."""
    learned = Profiles.learn(
        ((r.lang, r.text) for r in samples.select("lang", "text").collect() if r.text), (r.word for r in common.select("word").collect() if r.word)
    )
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(learned)
        for batch in batches:
            rows = [(k, *_stats(reader, t)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            types = [pa.int64(), pa.string(), pa.int32(), *[pa.float64()] * 8, pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    out = df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, SCHEMA.replace("text_id", key, 1))
    return out.dropDuplicates()


def _stats(reader: Reader, text: str | None) -> tuple:
    found = reader.lines(text) if text and text.strip() else None
    if found is None:
        return (None,) * 13
    near, far = reader.nearest(found.spread)
    sorts, visible = reader.p.sorts, float(found.size.sum())
    weight = np.bincount(near, found.size, len(sorts)).tolist()
    by = dict.fromkeys(("prose", *KINDS), 0.0)
    for (k, _), n in zip(sorts, weight):
        by[k] += n
    kind = max(("prose", *KINDS), key=lambda k: by[k])
    mean = lambda d: float((d * found.size).sum() / max(visible, 1))
    return (
        kind, found.words, visible / found.words, (visible - found.letters - found.digits) / max(visible, 1), found.digits / max(visible, 1),
        found.stops / len(near), found.function / max(visible, 1), *(by[k] / max(visible, 1) for k in KINDS),
        " ".join(sorts[int(np.argmax(weight))]), mean(far[np.arange(len(near)), near]), mean(far[:, reader.prose].min(1)),
    )


def p2_stats(spark, sf_dir):
    return text_stats(spread(table(spark, sf_dir, "report_filter")), table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "common_words"))


def p2_found(spark, sf_dir):
    return p2_stats(spark, sf_dir).filter(F.col("kind").isin(*KINDS)).select("text_id", "kind")
