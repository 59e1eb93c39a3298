"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built from a bounded sample of labelled text. A text is
parsed from left to right into the longest phrases that occur in the sample of a language; the
language needing the fewest phrases, each weighed by the bits that name a place in its sample, wins.
All symbols of a text are parsed: texts are cut into stretches of ``STRETCH`` symbols, and the
stretches of many texts take their steps together. A text belongs to no language, and is
rejected, if even the best language's phrases, the last one aside, need more bits than naming the symbols
one by one out of its letters (``NAMED`` at least). Every letter of the samples has a symbol of its own.

Only letters (A-Z and others lower-cased) and single spaces between them count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termbridge.llm import arrays

col = F.col
SAMPLE_ROWS = 200  # labelled documents a language
SAMPLE_SYMBOLS = 30_000  # symbols a language, from all of them alike: fits 16-bit states
FEW = 200  # labels up to which the picked rows are sent to all
NAMED = 64  # symbols among which naming one is weighed at least
DENSE = 1 << 26  # bytes of all languages' full tables; beyond, only the steps that exist are kept
STRETCH = 1024
UNKNOWN = "und"


def transitions(symbols: list[int]) -> list[dict[int, int]]:
    """Per state of the suffix automaton symbol -> state; 0 is the start."""
    following, link, length = [{}], [-1], [0]
    last = 0
    for s in symbols:
        state, at = len(following), last
        following.append({})
        link.append(0)
        length.append(length[last] + 1)
        while at != -1 and s not in following[at]:
            following[at][s] = state
            at = link[at]
        if at != -1:
            to = following[at][s]
            if length[at] + 1 == length[to]:
                link[state] = to
            else:
                copy = len(following)
                following.append(dict(following[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                while at != -1 and following[at].get(s) == to:
                    following[at][s] = copy
                    at = link[at]
                link[to] = link[state] = copy
        last = state
    return following


def _full(following: list[dict[int, int]], n_symbols: int) -> np.ndarray:
    """State x symbol -> state, 0 for none."""
    table = np.zeros((len(following), n_symbols), np.uint16 if len(following) < 65536 else np.uint32)
    for state, steps in enumerate(following):
        for s, to in steps.items():
            table[state, s] = to
    return table


def automaton(symbols: list[int], n_symbols: int) -> np.ndarray:
    """Transitions of the suffix automaton: state x symbol -> state, 0 for none; 0 is the start."""
    return _full(transitions(symbols), n_symbols)


class Sparse:
    """The steps of an automaton, sorted by state and symbol."""

    def __init__(self, following: list[dict[int, int]], n_symbols: int):
        steps = sorted((state * n_symbols + s, to) for state, own in enumerate(following) for s, to in own.items())
        self.keys = np.array([k for k, _ in steps] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([to for _, to in steps] + [0], np.uint32)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.to[at], 0)


def _letters() -> np.ndarray:
    """Per code point its lower-case letter, or 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            table[c] = ord(x.lower()[0])
    return table


_LETTERS: list[np.ndarray] = []


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters with one 0 between words, none at the ends, and the offsets of the rows."""
    if not _LETTERS:
        _LETTERS.append(_letters())
    joined = "".join(t or "" for t in texts)
    offsets = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])]).astype(np.int64)
    codes = _LETTERS[0][np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edge = np.zeros(len(codes) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[0], codes[:-1]])
    keep = (codes != 0) | ((before != 0) & ~edge[:-1])  # a space only after a letter of the row
    place = np.concatenate([[0], np.cumsum(keep)])
    codes, offsets = codes[keep], place[offsets]
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    trailing = np.zeros(len(codes), bool)
    trailing[ends] = codes[ends] == 0
    place = np.concatenate([[0], np.cumsum(~trailing)])
    return codes[~trailing], place[offsets]


class LanguageModel:
    """Automata of all languages over one alphabet."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        codes = {name: letters_of([samples[name]])[0] for name in self.languages}
        everything = np.concatenate([c for c in codes.values()] or [np.zeros(0, np.uint32)])
        found = np.unique(everything[everything != 0])
        self.symbols = {int(c): k + 1 for k, c in enumerate(found)}
        self.width = len(found) + 2
        self.bits, self.naming, made = [], [], []
        for name in self.languages:
            own = self.encode(codes[name])
            made.append(transitions(own.tolist()))
            self.bits.append(float(np.log2(max(len(own), 2))))
            self.naming.append(float(np.log2(max(len(np.unique(own)) + 1, NAMED))))
        full = sum(self.width * len(m) * (2 if len(m) < 65536 else 4) for m in made) <= DENSE
        self.tables = [_full(m, self.width).reshape(-1) if full else Sparse(m, self.width) for m in made]

    def encode(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of letters; those that no sample has share one."""
        if not hasattr(self, "_table"):
            self._table = np.full(0x110000, self.width - 1, np.uint8 if self.width <= 256 else np.uint32)
            self._table[0] = 0
            for c, k in self.symbols.items():
                self._table[c] = k
        return self._table[codes]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows x languages: phrases of each row."""
        sizes = np.diff(offsets)
        made = -(-sizes // STRETCH)
        row = np.repeat(np.arange(len(sizes)), made)
        part = np.arange(len(row)) - np.repeat(np.cumsum(made) - made, made)
        start = offsets[:-1][row] + part * STRETCH
        length = np.minimum(STRETCH, offsets[1:][row] - start)
        order = np.argsort(-length, kind="stable")
        start, length, row = start[order], length[order], row[order]
        active = np.searchsorted(-length, -np.arange(1, STRETCH + 1), "right")  # stretches with a k-th symbol
        out = np.zeros((len(sizes), len(self.tables)), np.int64)
        for n, table in enumerate(self.tables):
            first = table[np.arange(self.width)].astype(np.int64)
            state, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
            for k in range(int(length[0]) if len(length) else 0):
                m = int(active[k])
                s = symbols[start[:m] + k]
                before = state[:m]
                after = table[before * self.width + s].astype(np.int64)
                stuck = after == 0
                alone = first[s]
                # A phrase ends where it can't go on; a symbol that the sample lacks is a phrase by itself.
                count[:m] += (stuck & (before != 0)).astype(np.int64) + (stuck & (alone == 0))
                state[:m] = np.where(stuck, alone, after)
            count += state != 0
            out[:, n] = np.bincount(row, weights=count, minlength=len(sizes)).astype(np.int64)
        return out


def learn(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model of the labelled rows' languages.

    Of each language the ``SAMPLE_ROWS`` documents with the smallest hash of doc_id and text are
    taken, and ``SAMPLE_SYMBOLS`` symbols of them, alike from each as far as they reach. Rows
    without label or without a letter teach nothing. Every label is learned, so the model grows with their number.
    """
    labelled = documents.where(col(lang).isNotNull() & col(text).rlike(r"\p{L}"))
    labelled = labelled.select(col(lang).cast("string").alias("lang"), col(doc_id).alias("doc_id"), col(text).alias("text"))
    labelled = labelled.withColumn("at", F.xxhash64("doc_id", "text"))
    few = labelled.select("lang").distinct().count() <= FEW
    order = Window.partitionBy("lang").orderBy("at")
    picked = labelled.select("lang", "at").withColumn("nth", F.row_number().over(order)).where(col("nth") <= SAMPLE_ROWS)
    picked = picked.select("lang", "at").distinct()
    # At most FEW * SAMPLE_ROWS rows of two short columns are broadcast.
    sampled = labelled.join(F.broadcast(picked) if few else picked, ["lang", "at"]).select("lang", "at", "text")

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(set(rows["text"]), key=lambda t: (len(t), t))
        taken, left = [], SAMPLE_SYMBOLS
        for n, t in enumerate(texts):  # short ones whole, the rest shares what is left
            codes, _ = letters_of([t])
            codes = codes[: left // (len(texts) - n)]
            left -= len(codes) + 1
            taken.append("".join(map(chr, np.where(codes == 0, 32, codes))))
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "sample": [" ".join(taken)]})

    samples = sampled.groupBy("lang").applyInPandas(gather, "lang string, sample string").collect()
    return LanguageModel({r["lang"]: r["sample"] for r in samples})


def identify(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``documents`` with lang_pred, score (0 to 1), bits (per symbol, of the best language) and accepted.

    lang_pred is `und`, score 0, bits null and accepted false for texts that are null or have no
    letter, and for all texts if no language was learned. The score is the share of
    phrases that the best language saves against the second. Equal languages go to the first name.
    Input columns with the four names are replaced. Rows may repeat. An empty table gives no rows.
    """
    made = ["lang_pred", "score", "bits", "accepted"]
    carried = [c for c in documents.columns if c not in made]
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most DENSE bytes, or else about 1 MB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        costs, naming = np.array(m.bits), np.array(m.naming)
        for batch in batches:
            for part in arrays.pieces(batch, "text"):
                codes, offsets = letters_of(part.column("text").to_pylist())
                sizes = np.diff(offsets)
                n = len(sizes)
                if not m.languages:
                    sizes = np.zeros(n, int)
                    best, bits, score, accepted = sizes, sizes.astype(float), sizes.astype(float), sizes > 0
                else:
                    weighed = m.phrases(m.encode(codes), offsets) * costs
                    best = weighed.argmin(axis=1)
                    least = weighed[np.arange(n), best]
                    bits = least / np.maximum(sizes, 1)
                    score, accepted = np.ones(n), (sizes > 0) & (least - costs[best] < naming[best] * sizes)
                    if len(m.languages) > 1:
                        second = np.partition(weighed, 1, axis=1)[:, 1]
                        score = 1 - least / np.maximum(second, 1e-9)
                some = sizes > 0
                names = [m.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
                columns = [
                    pa.array(names, pa.string()),
                    pa.array(np.where(some, score, 0.0)),
                    pa.array(bits, mask=~some),
                    pa.array(accepted),
                ]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("text"), *columns], ["row", "text", *made])

    others = [c for c in carried if c != text]
    rows = documents.select(F.struct(*[col(f"`{c}`") for c in others]).alias("row"), col(text).cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, lang_pred string, score double, bits double, accepted boolean"
    done = rows.mapInArrow(run, schema)
    return done.select(*[col("text").alias(text) if c == text else col(f"row.`{c}`") for c in carried], *made)
