"""Problem 4: cut oversized texts at natural boundaries by dynamic programming.

The boundaries of one level after another join the candidate cuts, from coarse to fine, until the
programme, which minimises cut penalties and size imbalance under the maximum length
and the overlap, finds a way. A text's level is the first at which it finds one
without an overlap. Where even words leave a stretch that no cut can close, the stretch
may be cut at every eighth of a piece's length.

Defined results: null, empty and texts within the limit are no cases and give one
piece (null and empty give none). Lengths are code points. Texts are handled one by
one, so repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import spread, table

LIMIT, OVERLAP = 6000, 300
_BREAKS = r"\n\r\x0b\x85\u2028\u2029"
_EOL = rf"(?:\r\n|[{_BREAKS}])"
#: Levels from coarse to fine: a cut lies behind each match.
LEVELS = (
    ("page", re.compile("\f")),
    ("paragraph", re.compile(rf"{_EOL}[^\S{_BREAKS}\f]*(?={_EOL})")),
    ("line", re.compile(_EOL)),
    ("sentence", re.compile(r"[.!?](?=\s)|[。！？]")),
    ("word", re.compile(r"\s")),
)
#: Cost of a cut at each level; a piece's imbalance adds between 0 and 1.
PENALTY = {"page": 0.0, "paragraph": 0.5, "line": 1.5, "sentence": 2.5, "word": 5.0, "char": 12.0}


def _cuts(pattern: re.Pattern[str], text: str) -> np.ndarray:
    return np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)


def _paragraph_cuts(pattern: re.Pattern[str], text: str) -> np.ndarray:
    """Behind the blank line itself: the break that ends it is taken along."""
    eol = re.compile(_EOL)
    return np.fromiter((eol.match(text, m.end()).end() for m in pattern.finditer(text)), np.int64)


def boundaries(text: str, limit: int = LIMIT) -> tuple[str, np.ndarray, np.ndarray]:
    """(level, inner cut positions, their levels' numbers): the first level at which no stretch exceeds limit."""
    n, at, kind = len(text), np.empty(0, np.int64), np.empty(0, np.int64)
    for k, (name, pattern) in enumerate(LEVELS):
        at, kind = add_level(text, k, at, kind)
        if np.diff(np.concatenate(([0], at, [n]))).max() <= limit:
            return name, at, kind
    return "char", at, kind


def add_level(text: str, k: int, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = (_paragraph_cuts if LEVELS[k][0] == "paragraph" else _cuts)(LEVELS[k][1], text)
    new = np.setdiff1d(new[(new > 0) & (new < len(text))], at)
    both, kinds = np.concatenate((at, new)), np.concatenate((kind, np.full(len(new), k)))
    order = np.argsort(both, kind="stable")
    return both[order], kinds[order]


def best_cuts(n: int, at: np.ndarray, cost: np.ndarray, limit: int, overlap: int) -> list[int] | None:
    """Cut positions of least cost, or None where the boundaries leave no way.

    `at` are inner positions with their costs; the piece that ends at cut j and
    begins behind cut i spans from at[i] - overlap to at[j].
    """
    pos = np.concatenate(([0], at, [n]))
    pay = np.concatenate(([0.0], cost, [0.0]))
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    target = (n - overlap) / pieces
    total = np.full(len(pos), np.inf)
    back = np.zeros(len(pos), np.int64)
    total[0] = 0.0
    reach = np.searchsorted(pos, pos - (limit - overlap), "left")
    for j in range(1, len(pos)):
        lo = 0 if pos[j] <= limit else reach[j]
        if lo >= j:
            continue
        size = pos[j] - pos[lo:j]
        off = (size - target) / limit
        way = total[lo:j] + off * off
        b = int(way.argmin())
        if way[b] < np.inf:
            total[j], back[j] = way[b] + pay[j], lo + b
    if total[-1] == np.inf:
        return None
    out, j = [], len(pos) - 1
    while j:
        j = int(back[j])
        if j:
            out.append(int(pos[j]))
    return out[::-1]


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[str | None, list[tuple[int, int]]]:
    """(level, [(start, end) of each piece]); pieces after the first start `overlap` before the last cut."""
    n = len(text)
    if n <= limit:
        return None, [(0, n)] if n else []
    costs = np.array([PENALTY[name] for name, _ in LEVELS])
    level, at, kind, cuts = None, np.empty(0, np.int64), np.empty(0, np.int64), None
    for k, (name, _) in enumerate(LEVELS):
        at, kind = add_level(text, k, at, kind)
        cuts = best_cuts(n, at, costs[kind], limit, overlap)
        if level is None and (cuts is not None or best_cuts(n, at, costs[kind], limit, 0) is not None):
            level = name
        if cuts is not None:
            break
    else:
        # No way even at words: wide stretches may be cut inside, at every eighth of a piece.
        step = max(1, (limit - overlap) // 8)
        pos = np.concatenate(([0], at, [n]))
        wide = np.flatnonzero(np.diff(pos) > (limit - overlap) // 2)
        extra = np.concatenate([np.arange(pos[i] + step, pos[i + 1], step) for i in wide])
        both = np.concatenate((at, extra))
        order = np.argsort(both, kind="stable")
        cost = np.concatenate((costs[kind], np.full(len(extra), PENALTY["char"])))[order]
        cuts = best_cuts(n, both[order], cost, limit, overlap)
    level = level or "char"
    assert cuts is not None
    ends = [*cuts, n]
    return level, [(max(0, s - overlap) if i else 0, e) for i, (s, e) in enumerate(zip([0, *cuts], ends))]


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(key, level, piece_no, start, end[, piece]) for each text over the limit."""
    schema = f"{key} long, level string, piece_no int, start int, `end` int" + (", piece string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6 if with_text else 5)]
            for k, t in zip(batch.column(0), batch.column(1)):
                value = t.as_py()
                level, parts = split(value, limit, overlap)
                for i, (s, e) in enumerate(parts):
                    for c, v in zip(cols, (k.as_py(), level, i, s, e, value[s:e] if with_text else None)):
                        c.append(v)
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            names = [key, "level", "piece_no", "start", "end", "piece"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names[: len(cols)])

    # Octets bound code points from above, so short texts are dropped before the exact count.
    long = df.select(key, text).filter((F.octet_length(text) > limit) & (F.char_length(text) > limit))
    return long.mapInArrow(run, schema)


def p4_pieces(spark, sf_dir):
    return split_texts(spread(table(spark, sf_dir, "report_analysis_text")), "text_id", "pdf_text")


def p4_found(spark, sf_dir):
    pieces = split_texts(spread(table(spark, sf_dir, "report_analysis_text")), "text_id", "pdf_text", with_text=False)
    return pieces.filter("piece_no = 0").select("text_id", "level")


def _level_sql(limit: int = LIMIT) -> str:
    """The first sufficient level by regular expressions: a mark behind every boundary, the longest stretch between marks."""
    eol = r"(?:\r\n|[\n\r\x{0b}\x{85}\x{2028}\x{2029}])"
    marks = (
        ("page", r"(\f)", r"\1"), ("paragraph", rf"({eol}[^\S\n\r\x{{0b}}\x{{85}}\x{{2028}}\x{{2029}}\f]*{eol})", r"\1"), ("line", f"({eol})", r"\1"),
        ("sentence", r"([.!?])([\s\p{Z}\x{85}\x{0b}])", r"\1#\2"), ("stop", r"([。！？])", r"\1"), ("word", r"([\s\p{Z}\x{85}\x{0b}\x{1c}-\x{1f}])", r"\1"),
    )
    steps, last = [f"s0 AS (SELECT text_id, pdf_text AS s FROM report_analysis_text WHERE length(pdf_text) > {limit})"], "s0"
    for name, pattern, keep in marks:
        new = "'" + (keep if "#" in keep else keep + "#").replace("#", "' || chr(1) || '") + "'"
        steps.append(f"s_{name} AS (SELECT *, regexp_replace({'s' if last == 's0' else 's_' + last[2:]}, '{pattern}', {new}, 'g') AS s_{name} FROM {last})")
        last = f"s_{name}"
    longest = lambda name: f"list_max(list_transform(string_split(s_{name}, chr(1)), lambda x: length(x))) <= {limit}"
    cases = " ".join(f"WHEN {longest('stop' if name == 'sentence' else name)} THEN '{name}'" for name, *_ in marks if name != "stop")
    return f"WITH {', '.join(steps)} SELECT text_id, CASE {cases} ELSE 'char' END AS level FROM {last}"


SQL = {"p4_found": _level_sql()}
