"""Problem 8: language of documents and passages by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of a passage in frames of eight; each step's input is the sum
of one learned vector per byte and place in the frame, two recurrent layers run in opposite
directions, and a softmax labels every frame and so every byte. It is trained in numpy by
backpropagation through time on the labelled samples, a table of fixed size, with random
crops. A passage's probability is the mean over its positions, a document's the mean over
all of its passages' positions. A passage that mixes languages is cut where the labels of its
positions turn, at the cost of a turn.

A network is trained once for what it learns from: its weights lie in the session's shared
folder under a digest of that, and all queries and later calls read them.

Defined results: null, empty and blank texts have no passage and a null language; text
without letters is labelled with low confidence and is no sentence; a repeated row gives the
same rows again (`p8_found`: once). Texts are read whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import read_file, spread, table, write_file
from docmill.session import shared_dir

FRAME, HIDDEN, PIECE = 8, 32, 384
#: Labelled rows that may join the samples for the second fit, their greatest length, and their passages per language.
FIT_ROWS, FIT_CHARS, FIT_PASSAGES = 3000, 20_000, 2500
#: Steps of both fits.
FIRST_STEPS, SECOND_STEPS = 150, 800
#: Bytes of a passage that are read by themselves to find turns between languages, what a turn costs in
#: log probability, and the mean probability from which a passage is not cut.
WINDOW, TURN, WHOLE = 40, 6.0, 0.97

#: The languages with the codes and names that labels use.
NAMES = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "ingles", "inglês", "inglese", "engels", "английский", "英语", "英文"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "espagnol", "spanisch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "francese"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "tedesco", "duits"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portugais", "portugiesisch"),
    "it": ("it", "ita", "italian", "italiano", "italien", "italienisch"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "néerlandais", "flemish", "vlaams"),
    "ru": ("ru", "rus", "russian", "русский", "russe", "russisch", "russkij"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "中文", "汉语", "漢語", "普通话", "mandarin", "zhongwen"),
}


def labelled(label: Column) -> Column:
    """Array of the language codes a label names: by code, code with region or script, or name, one or several."""
    parts = F.split(F.lower(F.coalesce(label, F.lit(""))), r"[^\p{L}\p{M}_\-]+|\band\b|\bund\b|\by\b|\bet\b")
    heads = F.transform(parts, lambda p: F.regexp_replace(p, r"[_\-].*$", ""))
    both = F.concat(parts, heads)
    hits = [F.when(F.arrays_overlap(both, F.array(*(F.lit(n) for n in names))), F.lit(code)) for code, names in NAMES.items()]
    return F.array_compact(F.array(*hits))


# --- passages ---------------------------------------------------------------

_DROP = re.compile("[­​-‏⁠﻿]")
_DAMAGED = re.compile("[ÂÃÅÐÑâ-é][\u0080-¿Œ-™]")
#: Ends of sentences, with what may close them, before white space or after a full-width stop.
_CUT = re.compile("[.!?][\"”’»)\\]¹²³⁰-⁹]*\\s+|[。！？][\"”’»)\\]]*\\s*")
_LINE = re.compile("[\r\n\f\v\x85  ]+")
_MARK = re.compile("(?:[-*+•–—‣◦·▪●○☐☑✓>→]|\\(?(?:\\d{1,3}|[a-zA-Z]|[ivx]{1,5})[.)])\\s")
_QUOTE = re.compile("[\"“„«‘][^\"“”«»’]*[\"“”»’]")
_WORD = re.compile("[^\\W\\d_]{2,}|[^\\W\\d_](?=['’\\s])")
_HAN = re.compile("[㐀-鿿]")
_STOP = re.compile("[.!?。！？][\"”’»)\\]¹²³⁰-⁹]*\\s*$")
_LINK = re.compile(r"https?://\S+|www\.\S+|\S+@\S+")


def mend(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte encoding, where that leads back to valid text."""
    if not _DAMAGED.search(text):
        return text
    for encoding in ("cp1252", "latin-1"):
        try:
            return text.encode(encoding).decode("utf-8")
        except UnicodeError:
            pass
    raw = b"".join(_one_byte(c) for c in text)
    fixed = raw.decode("utf-8", "replace")
    return fixed if fixed.count("�") <= text.count("�") + len(text) // 100 else text


def _one_byte(c: str) -> bytes:
    for encoding in ("cp1252", "latin-1"):
        try:
            return c.encode(encoding)
        except UnicodeError:
            pass
    return c.encode("utf-8", "replace")


def passages(text: str) -> list[str]:
    """Sentences, headings, list items and the like, in order; a line that goes on in lower case is joined to the one before."""
    if not text.isascii():
        text = mend(_DROP.sub("", text))
    out: list[str] = []
    open_line = ""
    for line in _LINE.split(text):
        line = line.strip()
        if not line:
            continue
        if open_line:
            first = line[:1]
            if first.islower() and not _MARK.match(line) and not _STOP.search(open_line[-6:]):
                open_line += " " + line
                continue
            _cut(open_line, out)
        open_line = line
    if open_line:
        _cut(open_line, out)
    return out


def _cut(line: str, out: list[str]) -> None:
    at = 0
    for m in _CUT.finditer(line):
        end = m.end()
        out.append(line[at:end].strip())
        at = end
    if at < len(line):
        out.append(line[at:].strip())


def sentence(s: str) -> bool:
    """A passage that ends like a sentence and has its words outside quotation marks; no list item."""
    if s[-1] not in ".!?。！？" and not _STOP.search(s) or _MARK.match(s):
        return False
    if '"' in s or "“" in s or "«" in s or "„" in s:
        s = _QUOTE.sub(" ", s)
    if "://" in s or "@" in s:
        s = _LINK.sub(" ", s)
    if s.isascii():
        return sum(map(str.isalpha, s.split())) >= 3 or len(_WORD.findall(s)) >= 3
    return len(_WORD.findall(s)) >= 3 or len(_HAN.findall(s)) >= 5


_DIGITS = re.compile(r"\d[\d.,]*")


def as_bytes(s: str) -> bytes:
    """What the network reads: lower case, figures and runs of white space as one mark."""
    return _DIGITS.sub("0", " ".join(s.lower().split())).encode("utf-8", "replace")


# --- network ----------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def frames(items: list[bytes], steps: int) -> np.ndarray:
    """(steps, items, FRAME) bytes, padded with blanks."""
    width = steps * FRAME
    joined = b"".join(b.ljust(width) for b in items)
    return np.frombuffer(joined, np.uint8).reshape(len(items), steps, FRAME).transpose(1, 0, 2)


@dataclass
class Layer:
    """One direction: byte vectors for the three gates, recurrent weights, output weights."""

    embed: np.ndarray  # FRAME, 256, 3 H: update, reset, candidate
    recur: np.ndarray  # H, 2 H: update, reset
    cand: np.ndarray  # H, H
    out: np.ndarray  # H, languages

    @staticmethod
    def new(rng: np.random.Generator, classes: int) -> Layer:
        h = HIDDEN
        embed = rng.normal(0, 0.15, (FRAME, 256, 3 * h)).astype(np.float32)
        embed[0, :, :h] += 1.0  # at first the state is kept rather than replaced
        q = lambda n: np.concatenate([np.linalg.qr(rng.normal(size=(h, h)))[0] for _ in range(n)], 1).astype(np.float32)
        return Layer(embed, q(2) * np.float32(0.7), q(1), rng.normal(0, 0.2, (h, classes)).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.cand, self.out]


class ByteGRU:
    """Two layers in opposite directions and one softmax over the languages."""

    def __init__(self, langs: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.layers = [Layer.new(rng, len(langs)) for _ in range(2)]
        self.bias = np.zeros(len(langs), np.float32)
        self._tables: list[list[np.ndarray]] | None = None

    # training: everything is kept for the way back

    def _run(self, layer: Layer, x: np.ndarray) -> dict[str, np.ndarray]:
        t, b, _ = x.shape
        h = HIDDEN
        gates = sum(layer.embed[p][x[:, :, p]] for p in range(FRAME))
        hs = np.zeros((t + 1, b, h), np.float32)
        zr = np.empty((t, b, 2 * h), np.float32)
        cs = np.empty((t, b, h), np.float32)
        for i in range(t):
            a = gates[i, :, : 2 * h] + hs[i] @ layer.recur
            zr[i] = _sigmoid(a)
            cs[i] = np.tanh(gates[i, :, 2 * h :] + (zr[i, :, h:] * hs[i]) @ layer.cand)
            hs[i + 1] = zr[i, :, :h] * hs[i] + (1 - zr[i, :, :h]) * cs[i]
        return {"hs": hs, "zr": zr, "cs": cs}

    def _back(self, layer: Layer, x: np.ndarray, kept: dict[str, np.ndarray], dh_out: np.ndarray) -> list:
        t, b, _ = x.shape
        h = HIDDEN
        hs, zr, cs = kept["hs"], kept["zr"], kept["cs"]
        dgates = np.empty((t, b, 3 * h), np.float32)
        drecur, dcand = np.zeros_like(layer.recur), np.zeros_like(layer.cand)
        dh = np.zeros((b, h), np.float32)
        for i in range(t - 1, -1, -1):
            dh = dh + dh_out[i]
            z, r, c, before = zr[i, :, :h], zr[i, :, h:], cs[i], hs[i]
            da = dh * (1 - z) * (1 - c * c)
            drh = da @ layer.cand.T
            dz = dh * (before - c) * z * (1 - z)
            dr = drh * before * r * (1 - r)
            dzr = np.concatenate((dz, dr), 1)
            dgates[i, :, : 2 * h], dgates[i, :, 2 * h :] = dzr, da
            drecur += before.T @ dzr
            dcand += (r * before).T @ da
            dh = dh * z + drh * r + dzr @ layer.recur.T
        flat = dgates.reshape(-1, 3 * h)
        # Of the byte vectors only those of the bytes at hand have a slope: (numbers of their rows, slopes).
        rows, sums = [], []
        for p in range(FRAME):
            byte = x[:, :, p].ravel()
            order = np.argsort(byte, kind="stable")
            byte = byte[order]
            starts = np.flatnonzero(np.diff(byte, prepend=np.uint8(byte[0] ^ 1)))
            rows.append(byte[starts].astype(np.int64) + 256 * p)
            sums.append(np.add.reduceat(flat[order], starts, axis=0))
        dembed = np.concatenate(rows), np.concatenate(sums)
        return [dembed, drecur, dcand]

    def train(self, texts: list[bytes], labels: list[int], steps: int, batch: int = 96, length: int = 12, rate: float = 0.012, seed: int = 9) -> None:
        """Adam on random crops of `length` frames; the loss is the mean cross-entropy of all positions."""
        rng = np.random.default_rng(seed)
        by = [[t for t, y in zip(texts, labels) if y == k] for k in range(len(self.langs))]
        # A language of many different sentences comes up more often, up to four times.
        share = np.array([min(4.0, max(1.0, len(some) / 400)) if some else 0.0 for some in by])
        share /= share.sum()
        wide = lambda q: q.reshape(-1, q.shape[-1]) if q.ndim == 3 else q
        params = [wide(p) for layer in self.layers for p in layer.parts()] + [self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        width = length * FRAME
        for step in range(1, steps + 1):
            items, y = [], []
            for k in rng.choice(len(self.langs), batch, p=share):
                t = by[k][rng.integers(len(by[k]))]
                at = int(rng.integers(max(1, len(t) - width // 3)))
                items.append(t[at : at + width])
                y.append(k)
            x = frames(items, length)
            used = np.array([-(-len(t) // FRAME) for t in items])
            mask = (np.arange(length)[:, None] < used).astype(np.float32)
            kept = [self._run(self.layers[0], x), self._run(self.layers[1], x[::-1])]
            logits = kept[0]["hs"][1:] @ self.layers[0].out + kept[1]["hs"][:0:-1] @ self.layers[1].out + self.bias
            logits -= logits.max(2, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(2, keepdims=True)
            d = p.copy()
            d[:, np.arange(len(y)), y] -= 1
            d *= (mask / mask.sum())[:, :, None]
            grads: list = []
            for layer, k, xs, ds in ((self.layers[0], kept[0], x, d), (self.layers[1], kept[1], x[::-1], d[::-1])):
                dout = k["hs"][1:].reshape(-1, HIDDEN).T @ ds.reshape(-1, len(self.langs))
                grads += [*self._back(layer, xs, k, ds @ layer.out.T), dout]
            grads.append(d.sum((0, 1)))
            slopes = [g if isinstance(g, tuple) else (slice(None), g) for g in grads]
            norm = np.sqrt(sum(float((g * g).sum()) for _, g in slopes))
            scale = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * min(1, step / 20) * (1 - step / (steps + 1))
            for q, (at, g), a, b in zip(params, slopes, m, v):
                g = g * scale
                a[at] += 0.1 * (g - a[at])
                b[at] += 0.005 * (g * g - b[at])
                q[at] -= lr * (a[at] / (1 - 0.9**step)) / (np.sqrt(b[at] / (1 - 0.995**step)) + 1e-7)
        self._tables = None

    # reading: two bytes at a time by tables, in blocks of equal lengths

    def _lookup(self) -> list[list[np.ndarray]]:
        if self._tables is None:
            self._tables = [
                [(layer.embed[p][None, :, :] + layer.embed[p + 1][:, None, :]).reshape(65536, -1) for p in range(0, FRAME, 2)]
                for layer in self.layers
            ]
        return self._tables

    def _states(self, layer: Layer, tables: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
        """Hidden states (steps, items, H); pairs are (steps, items, FRAME / 2) two-byte numbers."""
        t, b, _ = pairs.shape
        h = HIDDEN
        hs = np.empty((t, b, h), np.float32)
        state = np.zeros((b, h), np.float32)
        for i in range(t):
            g = tables[0].take(pairs[i, :, 0], 0)
            for k in range(1, len(tables)):
                g += tables[k].take(pairs[i, :, k], 0)
            a = state @ layer.recur
            a += g[:, : 2 * h]
            _sigmoid(a)
            c = (a[:, h:] * state) @ layer.cand
            c += g[:, 2 * h :]
            np.tanh(c, out=c)
            state = np.multiply(state - c, a[:, :h], out=hs[i])
            state += c
        return hs

    def read(self, items: list[bytes], block: int = 768) -> tuple[np.ndarray, np.ndarray]:
        """(mean probability of each language, positions) of each item."""
        probs = np.zeros((len(items), len(self.langs)), np.float32)
        steps = np.array([max(1, -(-len(b) // FRAME)) for b in items], np.int64)
        tables = self._lookup()
        order = np.argsort(steps, kind="stable")
        for lo in range(0, len(items), block):
            part = order[lo : lo + block]
            n = steps[part]
            top = int(n[-1])
            x = np.ascontiguousarray(frames([items[i] for i in part], top)).view("<u2").astype(np.int64)
            # Every item is turned by itself, so that padding comes last in both directions.
            turn = np.maximum(n[None, :] - 1 - np.arange(top)[:, None], 0)
            cols = np.arange(len(part))[None, :]
            fore = self._states(self.layers[0], tables[0], x)
            hind = self._states(self.layers[1], tables[1], x[turn, cols])
            logits = fore @ self.layers[0].out + (hind @ self.layers[1].out)[turn, cols] + self.bias
            logits -= logits.max(2, keepdims=True)
            np.exp(logits, out=logits)
            logits /= logits.sum(2, keepdims=True)
            logits *= (np.arange(top)[:, None] < n)[:, :, None]
            probs[part] = logits.sum(0) / n[:, None]
        return probs, steps

    def runs(self, item: bytes) -> list[tuple[int, np.ndarray, int]]:
        """The item's runs of one language, the likeliest if a turn costs TURN: (language, sum of probabilities, positions).

        Windows are read by themselves: what stands far behind a turn would colour the positions before it.
        """
        p, n = self.read([item[at : at + WINDOW] for at in range(0, max(len(item), 1), WINDOW)])
        logs = np.log(np.maximum(p, 1e-6)) * n[:, None]
        score, back = logs[0], []
        for row in logs[1:]:
            best = int(score.argmax())
            stay = score >= score[best] - TURN
            back.append(np.where(stay, np.arange(len(score)), best))
            score = np.where(stay, score, score[best] - TURN) + row
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        cuts = [0, *(i for i in range(1, len(path)) if path[i] != path[i - 1]), len(path)]
        return [(path[a], (p[a:b] * n[a:b, None]).sum(0), int(n[a:b].sum())) for a, b in zip(cuts, cuts[1:])]

    def dump(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, langs=np.array(self.langs), bias=self.bias, **{f"p{i}_{k}": q for i, layer in enumerate(self.layers) for k, q in enumerate(layer.parts())})
        return to.getvalue()

    @staticmethod
    def restore(data: bytes) -> ByteGRU:
        got = np.load(io.BytesIO(data), allow_pickle=False)
        net = ByteGRU(got["langs"].tolist())
        net.bias, net.layers = got["bias"], [Layer(*(got[f"p{i}_{k}"] for k in range(4))) for i in range(2)]
        return net


def fit(samples: Iterable[tuple[str, str]], rows: Iterable[tuple[str, str]] = (), steps: int = FIRST_STEPS, more: int = SECOND_STEPS) -> ByteGRU:
    """Train on (language, text) samples, each also without accents and sentence by sentence.

    `rows` are labelled texts whose labels may be wrong: of their sentences those join a
    second training on which the first network and the label agree. Both inputs are bounded.
    """
    clean = [(lang, t) for lang, t in samples if lang and t]
    langs = sorted({lang for lang, _ in clean})
    texts, labels = [], []
    for lang, text in clean:
        for form in sorted({text, _bare(text)}) if lang not in ("ru", "zh") else [text]:
            for part in [form, *passages(form)]:
                texts.append(as_bytes(part))
                labels.append(langs.index(lang))
    net = ByteGRU(langs)
    net.train(texts, labels, steps)
    rows = [(langs.index(lang), t) for lang, t in rows if lang in langs and t]
    if not rows:
        return net
    taken: list[dict[bytes, None]] = [{} for _ in langs]
    reader = Reader(net)
    for (k, text), found in zip(rows, reader.passages([t for _, t in rows])):
        total = sum((p * n for _, p, n in found), np.zeros(len(langs)))
        if found and total.argmax() == k and total[k] >= 0.6 * total.sum():
            for s, (ok, p, _) in zip(passages(text), found):
                # Most of the text is of the label's language; a sentence that looks surely foreign is left out.
                if ok and p[k] >= 0.2 and len(taken[k]) < FIT_PASSAGES:
                    taken[k][as_bytes(s)] = None
    for k, some in enumerate(taken):
        for i, b in enumerate(some):
            texts.append(b)
            labels.append(k)
            if i % 3 == 0 and langs[k] not in ("ru", "zh"):
                texts.append(as_bytes(_bare(b.decode("utf-8", "replace"))))
                labels.append(k)
    net = ByteGRU(langs)
    net.train(texts, labels, more)
    return net


def _bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


class Reader:
    """Labels the passages of texts; passages met again are looked up."""

    def __init__(self, net: ByteGRU, remember: int = 200_000) -> None:
        self.net, self.remember = net, remember
        self.known: dict[str, tuple[bool, np.ndarray, int]] = {}
        self.read: dict[bytes, tuple[np.ndarray, int]] = {}
        self.cut: dict[str, list[tuple[int, np.ndarray, int, int]]] = {}

    def passages(self, texts: list[str | None]) -> list[list[tuple[bool, np.ndarray, int]]]:
        """Per text, for each of its passages: is it a sentence, probabilities, positions."""
        known, read = self.known, self.read
        cut = [passages(t) if t else [] for t in texts]
        new = list({s: None for row in cut for s in row if s not in known})
        if len(known) + len(new) > self.remember:
            known.clear()
            new = list({s: None for row in cut for s in row})
        if new:
            raw = list(map(as_bytes, new))
            if len(read) > self.remember:
                read.clear()
            unread = list({b: None for b in raw if b not in read})
            if unread:
                read.update(zip(unread, self._label(unread)))
            for s, b in zip(new, raw):
                known[s] = (sentence(s), *read[b])
        return [[known[s] for s in row] for row in cut]

    def segments(self, s: str, p: np.ndarray, n: int) -> list[tuple[int, np.ndarray, int, int]]:
        """(language, sum of probabilities, positions, characters) of a passage's stretches of one language."""
        lang = int(p.argmax())
        if p[lang] >= WHOLE or n < 6:
            return [(lang, p * n, n, len(s))]
        if s not in self.cut:
            if len(self.cut) > self.remember:
                self.cut.clear()
            got = self.net.runs(as_bytes(s))
            total, at, done, out = sum(c for _, _, c in got), 0, 0, []
            for i, (k, sums, count) in enumerate(got):
                done += count
                end = len(s)
                if i < len(got) - 1:
                    # Positions cover bytes of the squeezed text: the nearest blank is the place in the passage.
                    guess = len(s) * done // total
                    blanks = [x for x in (s.rfind(" ", at, guess), s.find(" ", guess)) if x > at]
                    end = min(blanks, key=lambda x: abs(x - guess)) + 1 if blanks else guess
                out.append((k, sums, count, end - at))
                at = end
            self.cut[s] = out
        return self.cut[s]

    def _label(self, items: list[bytes]) -> list[tuple[np.ndarray, int]]:
        pieces, owner = [], []
        for i, b in enumerate(items):
            for at in range(0, max(len(b), 1), PIECE):
                pieces.append(b[at : at + PIECE])
                owner.append(i)
        p, n = self.net.read(pieces)
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        total = np.add.reduceat(p * n[:, None], starts, axis=0)
        count = np.add.reduceat(n, starts)
        total /= count[:, None]
        return list(zip(total, count.tolist()))


# --- Spark ------------------------------------------------------------------


def _network(df: DataFrame, samples: DataFrame, key: str, text: str, label: str | None) -> ByteGRU:
    """The network of the samples and of at most FIT_ROWS rows up to FIT_CHARS long whose label names one language.

    These rows are chosen by a hash of their key. Trained only where the shared folder
    has no network of the same input.
    """
    clean = [(r.lang, r.text) for r in samples.select("lang", "text").orderBy("lang", "text").collect()]
    rows: list[tuple[str, str]] = []
    if label:
        one = labelled(F.col(label))
        some = df.filter(F.char_length(text) <= FIT_CHARS).select(F.col(key).alias("k"), one.alias("l")).filter(F.size("l") == 1)
        keys = some.select("k").orderBy(F.xxhash64("k"), "k").limit(FIT_ROWS)
        picked = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.get(one, F.lit(0)).alias("l")).join(F.broadcast(keys), "k", "left_semi")
        picked = picked.filter(F.char_length("t") <= FIT_CHARS)
        rows = [(r.l, r.t) for r in picked.orderBy(F.xxhash64("k"), "k", "t").limit(2 * FIT_ROWS).collect() if r.l]
    return trained(df.sparkSession, clean, rows)


def trained(spark: SparkSession, clean: list[tuple[str, str]], rows: list[tuple[str, str]]) -> ByteGRU:
    """The network fitted on both, from the shared folder if it lies there."""
    what = repr((FRAME, HIDDEN, FIRST_STEPS, SECOND_STEPS, FIT_PASSAGES, clean, rows)).encode("utf-8", "replace")
    path = os.path.join(shared_dir(spark), f"p8-network-{hashlib.sha256(what).hexdigest()}.npz")
    kept = read_file(spark, path)
    if kept is not None:
        return ByteGRU.restore(kept)
    net = fit(clean, rows)
    write_file(spark, path, net.dump())
    return net


def label_passages(df: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", label: str | None = "lang") -> DataFrame:
    """(key, passage_no, lang, confidence, is_sentence, n_chars): neighbouring sentences of a language are one passage, a sentence that mixes languages several."""
    shared = df.sparkSession.sparkContext.broadcast(_network(df, samples, key, text, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in _slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            texts = batch.column(1).to_pylist()
            for k, t, row in zip(batch.column(0).to_pylist(), texts, reader.passages(texts)):
                merged: list[list] = []
                for (ok, p, n), s in zip(row, passages(t) if t else []):
                    for lang, sums, count, chars in reader.segments(s, p, n):
                        if merged and merged[-1][0] == lang and merged[-1][2] == ok:
                            merged[-1][1] += sums
                            merged[-1][3] += count
                            merged[-1][4] += chars
                        else:
                            merged.append([lang, sums, ok, count, chars])
                for i, (lang, p, ok, n, chars) in enumerate(merged):
                    for c, v in zip(cols, (k, i, reader.net.langs[lang], float(p[lang]) / n, ok, chars)):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [key, "passage_no", "lang", "confidence", "is_sentence", "n_chars"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, passage_no int, lang string, confidence double, is_sentence boolean, n_chars int")


#: Least confidence of a sentence that counts, of the surest of several in a language, and of the only one.
SURE, SURE_BEST, SURE_ALONE = 0.6, 0.9, 0.97


def label_documents(df: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", label: str | None = "lang") -> DataFrame:
    """(key, lang, confidence, in_sentences): pooled language, and the languages that have a complete sentence."""
    shared = df.sparkSession.sparkContext.broadcast(_network(df, samples, key, text, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in _slices(batches):
            langs, sure, found = [], [], []
            for row in reader.passages(batch.column(1).to_pylist()):
                total, positions, said = 0.0, 0, 0.0
                best: dict[int, list[float]] = {}
                for ok, p, n in row:
                    total = total + p * n
                    positions += n
                    if ok:
                        said = said + p * n
                        k = int(p.argmax())
                        if p[k] >= SURE:
                            best.setdefault(k, []).append(float(p[k]))
                if positions:
                    k = int(total.argmax())
                    langs.append(reader.net.langs[k])
                    sure.append(float(total[k]) / positions)
                else:
                    langs.append(None)
                    sure.append(None)
                sure_of = {k for k, c in best.items() if max(c) >= (SURE_BEST if len(c) > 1 else SURE_ALONE)}
                if not sure_of and not isinstance(said, float):
                    sure_of = {int(said.argmax())}  # a text with sentences has some language
                found.append(sorted(reader.net.langs[k] for k in sure_of))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(found, pa.list_(pa.string()))],
                [key, "lang", "confidence", "in_sentences"],
            )

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, lang string, confidence double, in_sentences array<string>")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def p8_documents(spark, sf_dir):
    return label_documents(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "lang_samples"))


def p8_passages(spark, sf_dir):
    return label_passages(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "lang_samples"))


def found(df: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, lang) of each language with a complete sentence that the label does not name."""
    # The label travels beside the text by the stage's own key: labels are joined on small columns only.
    named = df.select(F.col(key).cast("long").alias(key), labelled(F.col(label)).alias("named")).groupBy(key).agg(F.flatten(F.collect_set("named")).alias("named"))
    got = label_documents(df, samples, key, text, label).select(key, F.explode("in_sentences").alias("lang")).distinct()
    return got.join(named, key).filter(~F.array_contains("named", F.col("lang"))).select(key, "lang")


def p8_found(spark, sf_dir):
    return found(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "lang_samples"))
