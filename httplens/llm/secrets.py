"""Secret scans: high-recall candidates, and a random forest that removes false positives.

A candidate is a run of key characters of at least ``MIN_LENGTH`` that holds a digit, or upper-case letters after
lower-case ones; the password of ``user:password@host``; and what is assigned to a name that holds a naming word, quoted or up
to the next space, of at least ``MIN_VALUE`` bytes and of any characters. Assigned values may hold other
candidates. The forest looks at its length, changes between character kinds, how much of it the
dictionary covers, what looks like a path, an address or a number, and at the words beside it.

The dictionary is the letter trigrams of all texts with their counts: at most 17,576 numbers, summed over the whole
corpus. Equal labelled findings are one row with their count as weight. The forest is fitted on at most ``max_findings`` of
these rows, those of each label with the smallest hash: the rarer label has up to half of them, and each label weighs what it
does in the whole corpus. Findings in a format in which providers issue keys are secrets whatever the forest says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from httplens.llm.quality import Trees, edges_of
from httplens.llm.text import LOWER, Block, Words, blocks, released
from httplens.session import stage

MIN_LENGTH = 12
MIN_VALUE = 4
MAX_FINDINGS = 20_000
TREES, DEPTH, BINS = 40, 6, 32
REDACTED = "[SECRET]"

_KEY = np.zeros(256, bool)
_KEY[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.~@-"]] = True
_LETTERS = 26 ** 3
_BESIDE = 32

# Words that name a secret, and formats in which providers issue keys.
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "credential", "bearer")
_NAMED = re.compile(r"(?:" + "|".join(SECRET_WORDS) + r")\w*[\"']?\s*[=:]\s*[\"']?$", re.I)
_NAME = re.compile(rb"(?:" + "|".join(SECRET_WORDS).encode() + rb")\w*\\?[\"']?\]?\s*\Z", re.I)
# A value: quoted, quoted within quoted text, or up to a space, the next name, a closing quote or a closing tag.
_VALUE = re.compile(
    rb"(?!::|://)(?:=>|:=|=|:)[=>]?[\x20\t]*+(?:\r?\n[\x20\t]*+)?+(?:(?:bearer|basic|token)[\x20\t]++)?+(?:"
    rb"(?P<a>[\"'`])(?P<quoted>(?:\\.|(?!(?P=a))[^\n\\]){4,}+)(?P=a)"
    rb"|\\(?P<b>[\"'`])(?P<inner>(?:(?!\\(?P=b))[^\n]){4,}+)\\(?P=b)"
    rb"|\\?[\"'`]*+(?P<plain>(?:(?![?&;,][\w.-]++\s?[=:])(?!\\?[\"'`](?=[\s,;)\]}>]|\Z))(?!</\w)\S)++))", re.I)
_PLACEHOLDER = re.compile(
    r"\$?\{.*\}|\$\(.*\)|<.*>|%\w|(.)\1+|none|null|true|false|undefined|(?:os\.(?:environ|getenv)|process\.env|getenv)\b.*", re.I | re.S)
# Words that prose puts before a colon, too.
_PROSE = re.compile(r"(?:key|token|auth|credential)\w*\s*:\s*$", re.I)
_ISSUED = re.compile(r"(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})\Z")
_HARMLESS = re.compile(
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9.+-]+|[A-Za-z.-]+|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    r"|(?:[\w.~-]*/){2,}[\w.~-]*|(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)+/?[^@]*")
# user:password@host: the password ends at the last @ before the path.
_NO_USER = np.zeros(256, bool)
_NO_USER[[*b" \t\n\x0b\x0c\r:/@\"'<>"]] = True
_PASSWORD = re.compile(rb"([^\s/\"'<>]+)@(?=[\w\[])")

FEATURES = (
    "length", "upper", "lower", "digit", "other", "transitions", "entropy", "hex", "dictionary", "slashes", "dots", "at",
    "dashes", "distinct", "longest_letters", "longest_digits", "named", "assigned", "quoted", "word_before", "word_after",
    "letters_before", "letters_after")

FINDING = "struct<start:int, end:int, label:int, x:array<double>>"
_FINDING = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])


# --- the dictionary -----------------------------------------------------------------------


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The code of the letter trigram from each byte on, -1 where there is none."""
    letters = LOWER[data].astype(np.int32) - 0x61
    inside = (letters >= 0) & (letters < 26)
    n = max(0, len(data) - 2)
    whole = inside[:n] & inside[1:n + 1] & inside[2:n + 2]
    return np.where(whole, (letters[:n] * 26 + letters[1:n + 1]) * 26 + letters[2:n + 2], -1)


def dictionary(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Which letter trigrams occur in the corpus at least as often as the mean."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_LETTERS, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                codes = _trigrams(block.data)
                total += np.bincount(codes[codes >= 0], minlength=_LETTERS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    counts = np.zeros(_LETTERS, np.int64)
    sums = docs.select(text).mapInArrow(released(counted), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        counts[row.gram] = row.n
    return counts >= max(1.0, counts.sum() / _LETTERS)
# A private key in its envelope, whatever stands for the line ends.
_ENVELOPE = re.compile(
    rb"-----BEGIN (?:[A-Z0-9]++ )*PRIVATE KEY-----(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END (?:[A-Z0-9]++ )*PRIVATE KEY-----")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = np.zeros(256, bool)
_WORD[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = True


# --- candidates ------------------------------------------------------------------------------


def _longest(text: str, pattern: str) -> int:
    return max(map(len, re.findall(pattern, text)), default=0)


def _features(found: str, before: str, after: str, named: bool, known: np.ndarray) -> list[float]:
    n = len(found)
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in found]
    counts = np.unique(list(found), return_counts=True)[1] / n
    codes = _trigrams(np.frombuffer(found.encode(), np.uint8))
    codes = codes[codes >= 0]
    beside, behind = before.split(), after.split()
    return [
        n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("d") / n, kinds.count("o") / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, float(-(counts * np.log2(counts)).sum()),
        sum(c in "0123456789abcdefABCDEF" for c in found) / n,
        float(known[codes].mean()) if len(codes) else 0.0,
        found.count("/"), found.count("."), found.count("@"), found.count("-"), len(set(found)) / n,
        _longest(found, "[A-Za-z]+") / n, _longest(found, "[0-9]+") / n,
        float(named), float(before.rstrip(" \"'").endswith(("=", ":"))),
        float(before.endswith(("\"", "'")) and after.startswith(("\"", "'"))),
        float(any(w in before.lower() for w in SECRET_WORDS)), float(any(w in after.lower() for w in SECRET_WORDS)),
        len(beside[-1]) if beside else 0, len(behind[0]) if behind else 0]


def _label(found: str, before: str, after: str, named: bool, password: bool) -> int:
    """What the rules of known formats say: 1 a secret, 0 none, -1 nothing.

    Behind a naming word nothing is harmless by its form: what has a digit and could be a path without dots or
    a UUID is a secret, and what could be an address, a number or words is left to the forest, but for a placeholder, or a
    word in prose.
    """
    if password or _ISSUED.match(found):
        return 1
    harmless = _HARMLESS.fullmatch(found)
    if not named:
        return 0 if harmless else -1
    if _PLACEHOLDER.fullmatch(found) or (found.isalpha() and _PROSE.search(before) and re.match(r",? [a-z]", after)):
        return 0
    if len(found) < 8 or not re.search(r"\d", found) or re.search(r"\s|://", found):
        return -1
    return 1 if not harmless or re.fullmatch(r"[\w/~-]*[A-Za-z][\w/~-]*", found) else -1


def _last(mask: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The last place before each of ``places`` where the mask holds, -1 where there is none."""
    latest = np.maximum.accumulate(np.where(mask, np.arange(len(mask)), -1))
    return np.where(places > 0, latest[places - 1], -1)


def _name_start(data: bytes, low: int, end: int, breaks: np.ndarray) -> int:
    """Where the word before a sign begins, whatever its length; ``end`` is its last letter, or the quote or bracket behind it."""
    for marks in (b"]", b"\"'", b"\\"):
        if end >= low and data[end] in marks:
            end -= 1
    return max(low, int(breaks[end]) + 1) if end >= low else low


def _values(block: Block) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Start and end of what stands where a secret does: keys in envelopes, passwords of user:password@host, and values behind
    naming words."""
    data, named, last, held = block.data.tobytes(), [], 0, 0
    signs = np.flatnonzero((block.data == 0x3A) | (block.data == 0x3D))
    owner = np.searchsorted(block.bounds, signs, "right") - 1
    breaks = np.maximum.accumulate(np.where(_WORD[block.data], -1, np.arange(len(block.data))))
    ends, users = _last(~_SPACE[block.data], signs), _last(_NO_USER[block.data], signs)
    passwords = [m.span() for m in _ENVELOPE.finditer(data)] if b"PRIVATE KEY-----" in data else []
    # An envelope lies within one text.
    passwords = [(s, e) for s, e in passwords if np.searchsorted(block.bounds, s, "right") == np.searchsorted(block.bounds, e - 1, "right")]
    for i, at, end, user in zip(owner.tolist(), signs.tolist(), ends.tolist(), users.tolist()):
        low, high = int(block.bounds[i]), int(block.bounds[i + 1])
        if at >= last and data[at] == 0x3A and user - 2 >= low and data[user - 2:user + 1] == b"://":
            value = _PASSWORD.match(data, at + 1, high)
            if value:
                passwords.append(value.span(1))
                last = value.end()
        # A name inside an unquoted value is part of that value, which keeps long runs linear.
        elif at >= held and _NAME.search(data, _name_start(data, low, end, breaks), at):
            value = _VALUE.match(data, at, high)
            if value:
                s, e = value.span(value.lastgroup)
                if value.lastgroup == "plain":
                    held = e
                    # Marks at the end belong to the sentence.
                    while e > s and data[e - 1] in b".,;:)]}>\"'`\\":
                        e -= 1
                if e - s >= MIN_VALUE:
                    named.append((s, e))
    return passwords, named


def _candidates(block: Block, known: np.ndarray) -> Iterator[list[dict]]:
    """Per text of a block its candidates, by code points."""
    passwords, values = _values(block)
    rest = block.data
    if passwords:
        rest = rest.copy()
        for s, e in passwords:
            rest[s:e] = 0x20
    words = Words(Block(rest, block.bounds, block.first), _KEY)
    long_ones = np.flatnonzero(words.ends - words.starts >= MIN_LENGTH)
    data = block.data
    digit = np.append(0, np.cumsum((data >= 0x30) & (data <= 0x39)))
    lower = (data >= 0x61) & (data <= 0x7A)
    turn = np.zeros(len(data), np.int64)
    turn[1:] = ((data >= 0x41) & (data <= 0x5A))[1:] & lower[:-1]
    turns = np.append(0, np.cumsum(turn))
    a, b = words.starts[long_ones], words.ends[long_ones]
    some = (digit[b] > digit[a]) | (turns[b] > turns[np.minimum(a + 1, b)])
    spans = []
    for s, e in zip(a[some].tolist(), b[some].tolist()):
        # Marks at the ends belong to the sentence.
        while e > s and data[e - 1] in b".-+/~@":
            e -= 1
        while s < e and data[s] in b".-+/~@":
            s += 1
        if e - s >= MIN_LENGTH:
            spans.append((s, e))
    secret, behind = set(passwords), set(values)
    spans = sorted({*spans, *secret, *behind})
    owner = np.searchsorted(block.bounds, [s for s, _ in spans], "right") - 1
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80)) if spans else None
    out: list[list[dict]] = [[] for _ in range(len(block))]
    for i, (s, e) in zip(owner.tolist(), spans):
        low, high = int(block.bounds[i]), int(block.bounds[i + 1])
        found = data[s:e].tobytes().decode()
        before = data[max(low, s - _BESIDE):s].tobytes().decode(errors="ignore")
        after = data[e:min(high, e + _BESIDE)].tobytes().decode(errors="ignore")
        named = (s, e) in behind or bool(_NAMED.search(before))
        out[i].append({
            "start": int(points[s] - points[low]), "end": int(points[e] - points[low]), "label": _label(found, before, after, named, (s, e) in secret),
            "issued": bool(_ISSUED.match(found)) or (s, e) in secret and found.startswith("-----BEGIN "), "x": _features(found, before, after, named, known)})
    return out


def candidates(text: str | Column, known: np.ndarray) -> Column:
    """The candidates of each text with their features, and a label where the rules of known formats give one."""

    @F.arrow_udf(f"array<{FINDING}>")
    @released
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [own for block in blocks(texts) for own in _candidates(block, known)]
            yield pa.array(rows, pa.list_(_FINDING))

    return found(text)


# --- the forest --------------------------------------------------------------------------------


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, seed: int = 5,
               weights: np.ndarray | None = None) -> Trees:
    """Trees of gini splits, each on a bootstrap sample, each split among a random part of the features.

    A row stands for as many findings as it weighs, one by default. Leaves hold the share of ones; the forest's raw value is their mean. Without labelled rows every
    candidate scores one, as nothing is known to be false.
    """
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if not len(y):
        return Trees(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)), 1.0, depth)
    random = np.random.default_rng(seed)
    edges, n_features = edges_of(x, bins), x.shape[1]
    binned = np.column_stack([np.searchsorted(cuts, column, "left") for cuts, column in zip(edges, x.T)])
    cells = binned + np.arange(n_features) * bins
    feature = np.zeros((trees, inner), np.int32)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    part = max(1, int(np.sqrt(n_features)) + 1)
    weights = np.ones(len(y)) if weights is None else weights
    share = weights / weights.sum()
    mean = float((share * y).sum())
    for t in range(trees):
        weight = random.multinomial(round(weights.sum()), share).astype(float)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            at = ((node - first)[:, None] * (n_features * bins) + cells).ravel()
            shape, size = (count, n_features, bins), count * n_features * bins
            n = np.bincount(at, np.repeat(weight, n_features), size).reshape(shape).cumsum(axis=2)
            ones = np.bincount(at, np.repeat(weight * y, n_features), size).reshape(shape).cumsum(axis=2)
            total, all_ones = n[:, :, -1:], ones[:, :, -1:]
            rest, rest_ones = total - n, all_ones - ones
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.nan_to_num(ones ** 2 / n) + np.nan_to_num(rest_ones ** 2 / rest) - np.nan_to_num(all_ones ** 2 / total)
            gain[(n < 1) | (rest < 1)] = 0
            for f, cuts in enumerate(edges):
                gain[:, f, len(cuts):] = 0
            for k in range(count):
                allowed = random.permutation(n_features)[:part]
                f = int(allowed[gain[k, allowed].max(axis=1).argmax()])
                b = int(gain[k, f].argmax())
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        own = node - inner
        # One row of the whole sample's mean keeps empty leaves defined.
        leaf[t] = (np.bincount(own, weight * y, leaves) + mean) / (np.bincount(own, weight, leaves) + 1) / trees
    return Trees(feature, threshold, leaf, 0.0, depth)


def train(labelled: DataFrame, max_findings: int = MAX_FINDINGS) -> Trees:
    """The forest from findings with ``label`` (0 or 1) and features ``x``."""
    groups = stage(labelled.where("label IN (0, 1)").groupBy("label", "x").agg(F.count("*").alias("n")), "findings")
    totals = {r.label: r for r in groups.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()}
    rows, weights = [], []
    for label, total in sorted(totals.items()):
        others = sum(t.rows for other, t in totals.items() if other != label)
        most = max(max_findings - max_findings // 2, max_findings - others)
        sample = groups.where(F.col("label") == label).orderBy(F.xxhash64("x", "label"), "x").limit(most).collect()
        rows += sample
        # What was left out is made up for by those of its label.
        weights += [r.n * total.n / sum(s.n for s in sample) for r in sample]
    x = np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES))
    return fit_forest(x, np.array([r.label for r in rows], float), weights=np.array(weights))


def labelled_findings(docs: DataFrame, known: np.ndarray, text: str = "text") -> DataFrame:
    """The candidates of ``docs`` that the rules of known formats label."""
    found = docs.select(F.explode(candidates(text, known)).alias("f")).select("f.*")
    return found.where("label >= 0")


def scored(text: str | Column, known: np.ndarray, forest: Trees) -> Column:
    """The candidates of each text with the forest's score; those in an issued format score one."""

    @F.arrow_udf("array<struct<start:int, end:int, score:double>>")
    @released
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [own for block in blocks(texts) for own in _candidates(block, known)]
            flat = [c["x"] for own in rows for c in own]
            scores = iter(forest.raw(np.array(flat)).tolist() if flat else [])
            yield pa.array(
                [[{"start": c["start"], "end": c["end"], "score": max(next(scores), float(c["issued"]))} for c in own] for own in rows],
                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))

    return found(text)


def scanner(docs: DataFrame, text: str = "text", max_findings: int = MAX_FINDINGS) -> tuple[np.ndarray, Trees]:
    """Dictionary and forest learned from ``docs``."""
    known = dictionary(docs, text)
    return known, train(labelled_findings(docs, known, text), max_findings)


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5,
             max_findings: int = MAX_FINDINGS) -> DataFrame:
    """One row per candidate: key, ``start_char``, ``end_char``, ``finding``, ``score``, ``is_secret``.

    Null texts have none; null and repeated keys and repeated rows are scanned like any other.
    """
    known, forest = scanner(docs, text, max_findings)
    found = docs.select(F.col(key), F.col(text).alias("_text"), scored(text, known, forest).alias("_f"))
    found = found.select(key, "_text", F.explode("_f").alias("_f"))
    return found.select(
        key, F.col("_f.start").alias("start_char"), F.col("_f.end").alias("end_char"),
        F.substring("_text", F.col("_f.start") + 1, F.col("_f.end") - F.col("_f.start")).alias("finding"),
        F.col("_f.score").alias("score"), (F.col("_f.score") >= threshold).alias("is_secret"))


def redacted(text: str | Column, found: str | Column, threshold: float = 0.5) -> Column:
    """``text`` with each finding of at least ``threshold`` replaced by :data:`REDACTED`, overlapping ones as one; null stays null."""

    def replaced(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for own, found in zip(texts.to_pylist(), spans.to_pylist()):
            gone = sorted((f["start"], f["end"]) for f in found or () if f["score"] >= threshold)
            if own is not None and gone:
                parts, at = [], 0
                for start, end in gone:
                    if start >= at:
                        parts += [own[at:start], REDACTED]
                    at = max(at, end)
                own = "".join([*parts, own[at:]])
            out.append(own)
        return pa.array(out, pa.string())

    return F.arrow_udf(replaced, "string")(text, found)
