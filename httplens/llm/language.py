"""Language of a text: first its family, then one-versus-one linear support vector machines within the family.

A text is its relative frequencies of byte n-grams, hashed to :data:`WIDTH` places. Letters keep
their bytes (A-Z as a-z), everything else of ASCII is a blank. Families are told apart by one linear support vector machine per family
against the rest, the languages of a family by one per pair and a vote. All of them are linear in the frequencies,
so that a text is scored by adding up the weights of its n-grams, slice by slice, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from httplens.llm.text import ALNUM, LOWER, Block, blocks, mix, released

MAX_ROWS = 4_000
WIDTH, SIZES = 1 << 12, (2, 3, 4)
COST, ROUNDS = 4.0, 12
UNKNOWN = "und"

# Language families by code. Languages that are not listed are told apart from each other as one more family.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "celtic": ("br", "cy", "ga", "gd"),
    "baltic": ("lt", "lv"),
    "sino-tibetan": ("bo", "my", "zh"),
    "austronesian": ("id", "jv", "ms", "tl"),
    "dravidian": ("kn", "ml", "ta", "te"),
}

RESULT = "struct<lang:string, score:double>"
_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64())])

_SLICE = 1 << 17
_BLANK = 0x20

_KEPT = LOWER.copy()
_KEPT[:0x80][~ALNUM[:0x80]] = _BLANK
_KEPT[0x30:0x3A] = _BLANK


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((name for name, own in FAMILIES.items() if code in own), "other")


# --- n-grams ------------------------------------------------------------------------------


def grams(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and place of all n-grams of the block that are not blank, a slice at a time."""
    data = _KEPT[block.data].astype(np.uint64)
    ends = np.repeat(block.bounds[1:], np.diff(block.bounds))
    text = np.repeat(np.arange(len(block)), np.diff(block.bounds))
    for a in range(0, len(data), _SLICE):
        for size in SIZES:
            n = min(a + _SLICE, len(data) - size + 1) - a
            if n <= 0:
                continue
            code = np.full(n, size, np.uint64)
            for i in range(size):
                code = (code << np.uint64(8)) | data[a + i:a + i + n]
            blank = sum(_BLANK << (8 * i) for i in range(size)) | size << (8 * size)
            good = (np.arange(a, a + n) + size <= ends[a:a + n]) & (code != np.uint64(blank))
            yield text[a:a + n][good], (mix(code[good]) & np.uint64(WIDTH - 1)).astype(np.int64)


def has_letter(block: Block) -> np.ndarray:
    """Whether each text has a letter of any script."""
    low = _KEPT[block.data]
    ascii_letters = np.append(0, np.cumsum((low >= 0x61) & (low <= 0x7A)))
    found = np.diff(ascii_letters[block.bounds]) > 0
    for i in np.flatnonzero(~found).tolist():
        found[i] = any(c.isalpha() for c in block.text(i).decode())
    return found


def frequencies(block: Block) -> np.ndarray:
    """A row of relative frequencies per text, for texts to learn from; zeros without n-grams."""
    found = np.zeros((len(block), WIDTH), np.float32)
    for text, place in grams(block):
        for i in np.unique(text).tolist():
            found[i] += np.bincount(place[text == i], minlength=WIDTH)
    return found / np.maximum(found.sum(axis=1, keepdims=True), 1)


# --- linear support vector machines ---------------------------------------------------------


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights, the last one the bias, for labels -1 and 1: squared hinge loss, dual coordinate descent, balanced classes."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    positive = max(1, int((y > 0).sum()))
    weight = np.where(y > 0, len(y) / (2 * positive), len(y) / (2 * max(1, len(y) - positive)))
    slack = 1 / (2 * cost * weight)
    curve = (x.astype(np.float64) ** 2).sum(axis=1) + slack
    random = np.random.default_rng(12)
    for _ in range(rounds):
        for i in random.permutation(len(y)).tolist():
            step = max(alpha[i] - (y[i] * (w @ x[i]) - 1 + alpha[i] * slack[i]) / curve[i], 0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


@dataclass
class Model:
    """Families with their languages, and the machines' weights: a column per family, then one per pair of a family."""

    families: list[list[str]]
    pairs: list[tuple[int, int, int]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, block: Block) -> np.ndarray:
        total = np.zeros((len(block), len(self.bias)))
        n = np.zeros(len(block))
        for text, place in grams(block):
            n += np.bincount(text, minlength=len(block))
            for k in range(len(self.bias)):
                total[:, k] += np.bincount(text, self.weights[place, k], len(block))
        return total / np.maximum(n, 1)[:, None] + self.bias

    def predict(self, block: Block) -> tuple[list[str], np.ndarray]:
        """Language and confidence per text: the family's and the least sure duel's logistic margins, multiplied."""
        margins = self.margins(block)
        sure = 1 / (1 + np.exp(-np.clip(2 * margins, -60, 60)))
        n = len(self.families)
        family = margins[:, :n].argmax(axis=1)
        score = sure[np.arange(len(block)), family] if n > 1 else np.ones(len(block))
        lang = np.zeros(len(block), np.int64)
        for f, langs in enumerate(self.families):
            own = np.flatnonzero(family == f)
            duels = [(n + k, a, b) for k, (of, a, b) in enumerate(self.pairs) if of == f]
            votes, lead = np.zeros((len(own), len(langs))), np.zeros((len(own), len(langs)))
            for k, a, b in duels:
                won = margins[own, k] > 0
                votes[:, a] += won
                votes[:, b] += ~won
                lead[:, a] += margins[own, k]
                lead[:, b] -= margins[own, k]
            # Equal votes go to the larger sum of margins, then to the first code.
            best = (votes + np.tanh(lead) / 4).argmax(axis=1)
            least = np.ones(len(own))
            for k, a, b in duels:
                least = np.where(best == a, np.minimum(least, sure[own, k]), least)
                least = np.where(best == b, np.minimum(least, 1 - sure[own, k]), least)
            lang[own], score[own] = best, score[own] * least
        return [self.families[f][k] for f, k in zip(family.tolist(), lang.tolist())], score


def fit(x: np.ndarray, langs: list[str], **options) -> Model | None:
    """The machines for rows of frequencies; None without rows."""
    if not langs:
        return None
    names: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        names.setdefault(family_of(lang), []).append(lang)
    families = [names[name] for name in sorted(names)]
    own = np.array(langs, object)
    # Rare n-grams weigh as much as frequent ones; the mean row has length 1.
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    scale /= np.sqrt(((x * scale) ** 2).sum(axis=1).mean()) or 1
    x = (x * scale).astype(np.float32)
    columns, pairs = [], []
    for family in families:
        inside = np.isin(own, family)
        columns.append(fit_machine(x, np.where(inside, 1, -1), **options) if len(families) > 1 else np.zeros(x.shape[1] + 1))
    for f, family in enumerate(families):
        for a, b in combinations(range(len(family)), 2):
            rows = np.isin(own, [family[a], family[b]])
            columns.append(fit_machine(x[rows], np.where(own[rows] == family[a], 1, -1), **options))
            pairs.append((f, a, b))
    found = np.column_stack(columns)
    return Model(families, pairs, (found[:-1] * scale[:, None]).astype(np.float32), found[-1])


# --- on tables ---------------------------------------------------------------------------------


def held_out(key: str | Column) -> Column:
    """Rows kept from training: those whose key's text has a CRC-32 of remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS, **options) -> Model | None:
    """Machines learned from at most ``max_rows`` labelled rows, shared equally between the languages.

    Of each language those keys count that have the smallest hash; of rows that share key and language the smallest
    text. Null keys, null languages and texts without n-grams are left out. Leave held-out rows out before.
    """
    marked = docs.where(F.col(key).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("_key"), F.col(lang).alias("_lang"))
    # One row per language; the narrow rows are limited per task before they are shuffled.
    n_langs = marked.select("_lang").distinct().count()
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("_key"), "_key")
    limited = marked.withColumn("_at", F.dense_rank().over(order)).where(F.col("_at") <= max(1, max_rows // max(1, n_langs)))
    chosen = limited.select("_key", "_lang").distinct()
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    own = rows.join(chosen, ["_key", "_lang"]).groupBy("_key", "_lang").agg(F.min("_text").alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in blocks(batch.column(2), 1 << 17):
                for i in range(0, len(some), 64):
                    at = some.bounds[i:i + 65]
                    part = Block(some.data[at[0]:at[-1]], at - at[0], some.first + i)
                    found = [row.tobytes() for row in frequencies(part)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(part.first, len(part)).cast(pa.string()),
                         batch.column(1).slice(part.first, len(part)), pa.array(found, pa.binary())], ["key", "lang", "x"])

    found = sorted(own.mapInArrow(released(counted), "key string, lang string, x binary").collect())
    x = np.frombuffer(b"".join(bytes(r.x) for r in found), np.float32).reshape(len(found), WIDTH)
    some = x.any(axis=1)
    return fit(x[some], [r.lang for r, good in zip(found, some.tolist()) if good], **options)


def identified(text: str | Column, model: Model | None) -> Column:
    """``lang`` and ``score`` of each whole text; ``und`` and 0 where the text is null or has no letter, or nothing was learned."""

    @F.arrow_udf(RESULT)
    @released
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores = [], [np.zeros(0)]
            for block in blocks(texts):
                known = has_letter(block) if model else np.zeros(len(block), bool)
                own, score = model.predict(block) if model else ([UNKNOWN] * len(block), np.zeros(len(block)))
                langs += [lang if good else UNKNOWN for lang, good in zip(own, known.tolist())]
                scores.append(np.where(known, score, 0.0))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], fields=list(_RESULT))

    return found(text)
