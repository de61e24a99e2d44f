"""Personal data: overlapping candidates, boosted trees over format and context, calibrated thresholds.

Only DataFrame functions work on texts. Four *base* kinds are found by their format and always stay. High-recall
generators propose further spans, which may overlap. Each candidate becomes a few small integers (its
format, and the characters beside it). Three generators have a check of their own format: what passes is an example of
personal data, what fails a counter-example. Candidates of the others are examples where they overlap a base span, and
counter-examples where they overlap what has a base format and failed its check. All examples of the corpus are summed
into cells, one per combination of the integers; the number of cells is bounded by the features alone, and boosted trees of
depth two are fitted to them. Per kind the threshold is the lowest score that keeps the wanted precision on the cells of a
fifth of the documents, which the trees have not seen; a kind without examples there has the threshold of all kinds
together. The trees are applied as nested CASE expressions.

Spans are code points, end exclusive.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# The formats: fixed values. A guard before a class and possessive repeats keep long runs linear without changing what
# matches; at least twelve digits are asked for at once, as shorter runs fail their check whole.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# An address with a domain of letters at its end.
_BARE_EMAIL = r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
# Cheap conditions that every match meets.
_GUARDS = {"email": "contains({t}, '@')", "ip": r"{t} RLIKE '[0-9]\\.[0-9]'", "card": None, "phone": "contains({t}, '+')"}

GENERATORS = {
    "national": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "number": r"(?<![0-9])[0-9]{9,19}(?![0-9])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "masked": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9.-]++",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){2,4}(?![0-9])",
}
_GENERATOR_GUARDS = {
    "national": r"{t} RLIKE '[0-9]{{3}}[ .-][0-9]{{4}}'", "identity": r"{t} RLIKE '[0-9]-[0-9]{{2}}-[0-9]'",
    "number": "{t} RLIKE '[0-9]{{9}}'", "account": "{t} RLIKE '[A-Z]{{2}}[0-9]{{2}}'",
    "masked": r"{t} RLIKE '[(\\[]at[)\\]]'", "address": r"{t} RLIKE '[0-9]\\.[0-9]'"}

# Generators whose format has a check of its own.
CHECKED = ("identity", "account", "masked")

KINDS = (*BASE, *GENERATORS)
_PLACE = {kind: place for place, kind in enumerate(KINDS)}
PRECISION = 0.95
ROUNDS, RATE, L2 = 30, 0.3, 1.0

# Features and the number of values each can take.
FEATURES = {"kind": len(KINDS), "digits": 8, "length": 6, "groups": 5, "before": 7, "after": 7, "word": 4, "check": 2}

SPAN = "struct<start:int, place:int, end:int>"


# --- spans of one pattern ---------------------------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, combine) -> Column:
    """``combine`` of every value with all before it, for an array of int without nulls.

    Arrays that grow are copied at each step, so values are folded in about as many parts as a part has values.
    """
    def fold(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda out, v: F.concat(
            out, F.array(F.coalesce(combine(F.try_element_at(out, F.lit(-1)), v), v))))

    def joined(parts: Column) -> Column:
        return _let(fold(F.transform(parts, lambda part: F.element_at(part, -1))), lambda carried: F.flatten(F.transform(
            parts, lambda part, i: _let(F.get(carried, i - 1), lambda before: F.transform(
                part, lambda v: F.coalesce(combine(before, v), v))))))

    def folded(all_values: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(all_values))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(all_values), step), lambda first: fold(F.slice(all_values, first, step)))
        return F.when(F.size(all_values) > 0, _let(parts, joined)).otherwise(F.array().cast("array<int>"))

    return _let(values, folded)


def _spans(text: Column, pattern: str, guard: str | None, name: str) -> Column:
    """The matches of a pattern in order: start, end, the match, and the text just before and after."""
    def placed(steps: Column) -> Column:
        ends = _running(F.transform(steps, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        return F.zip_with(steps, ends, lambda x, end: F.struct(
            (end - x["size"]).alias("start"), end.alias("end"), x["hit"].alias("hit"), x["before"].alias("before"),
            x["after"].alias("after")))

    def steps(hits: Column, gaps: Column) -> Column:
        return F.transform(hits, lambda h, i: F.struct(
            F.char_length(F.get(gaps, i)).alias("gap"), F.char_length(h).alias("size"), h.alias("hit"),
            F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(8)).alias("after")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = _let(F.split(text, pattern, -1), lambda gaps: _let(steps(hits, gaps), placed))
    if guard:
        found = F.when(F.expr(guard.format(t=name)), found)
    return F.coalesce(found, F.array().cast("array<struct<start:int, end:int, hit:string, before:string, after:string>>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 1, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _byte(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.char_length(bare) <= 3) & (F.substring(bare, 1, 3).cast("int") <= 255)


def _mod_97(account: Column) -> Column:
    """The remainder of an account number by 97, its first four characters last and letters as 10 to 35."""
    moved = F.concat(F.substring(account, 5, 64), F.left(account, F.lit(4)))
    digits = F.transform(F.regexp_extract_all(moved, F.lit("[A-Z0-9]"), F.lit(0)), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda rest, d: (rest * F.when(d > 9, 100).otherwise(10) + d) % 97)


def _own_check(kind: str, hit: Column) -> Column | None:
    """Whether a generated span is valid in its own format; None for kinds not in :data:`CHECKED`."""
    if kind == "identity":
        return hit.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    if kind == "account":
        bare = F.regexp_replace(hit, r"\x20", "")
        return F.char_length(bare).between(15, 34) & (_mod_97(bare) == 1)
    if kind == "masked":
        return F.regexp_replace(hit, r"\x20?[\[(]at[\])]\x20?", "@").rlike(f"^{_BARE_EMAIL}\\.?$")
    return None


def _passes(kind: str, hit: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), _byte)
    digits = _digits(hit)
    low, high = {"card": (12, 19), "phone": (9, 15)}[kind]
    within = F.char_length(digits).between(low, high)
    return within & _luhn(digits) if kind == "card" else within


# --- candidates ------------------------------------------------------------------------------------


def _cut(value: Column, *edges: int) -> Column:
    """The number of edges a value reaches."""
    found = F.lit(0)
    for edge in edges:
        found = found + (value >= edge).cast("int")
    return found


def _side(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike("[0-9]"), 1).when(c.rlike("[A-Za-z]"), 2).when(c.rlike(r"[\s]"), 3)
            .when(c.rlike(r"[.,;:!?]"), 4).when(c.rlike(r"[\"'()+]"), 5).otherwise(6))


def _features(kind: str, c: Column) -> Column:
    hit, before, after = c["hit"], c["before"], c["after"]
    digits = _digits(hit)
    n = F.char_length(digits)
    word = F.regexp_extract(before, r"(\S*)\s*$", 1)
    checked = _own_check(kind, hit)
    checked = _luhn(digits) & (n > 0) if checked is None else checked
    return F.struct(
        F.lit(_PLACE[kind]).alias("kind"), _cut(n, 1, 7, 9, 10, 12, 15, 17).alias("digits"),
        _cut(F.char_length(hit), 8, 12, 16, 20, 28).alias("length"),
        _cut(F.size(F.split(F.trim(hit), r"[^A-Za-z0-9]+")), 2, 3, 4, 5).alias("groups"),
        _side(F.right(before, F.lit(1))).alias("before"), _side(F.left(after, F.lit(1))).alias("after"),
        F.when(word == "", 0).when(word.rlike(r"^\+[0-9]{1,3}$"), 1).when(word.rlike("[0-9]"), 2).otherwise(3).alias("word"),
        checked.cast("int").alias("check"))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_text``, ``_base`` (spans that pass), ``_failed`` (those that do not) and ``_more`` (generated, with features)."""
    rows = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    patterns = {k: (p, _GUARDS[k]) for k, p in BASE.items()} | {k: (p, _GENERATOR_GUARDS[k]) for k, p in GENERATORS.items()}
    rows = rows.select("*", *[
        _spans(F.col("_text"), pattern, guard, "_text").alias(f"_s_{kind}") for kind, (pattern, guard) in patterns.items()])

    def spans(kind: str, keep: bool) -> Column:
        chosen = F.filter(F.col(f"_s_{kind}"), lambda c: _passes(kind, c["hit"]) if keep else ~_passes(kind, c["hit"]))
        return F.transform(chosen, lambda c: F.struct(
            c["start"].alias("start"), F.lit(_PLACE[kind]).alias("place"), c["end"].alias("end")))

    def generated(kind: str) -> Column:
        return F.transform(F.col(f"_s_{kind}"), lambda c: F.struct(
            F.struct(c["start"].alias("start"), F.lit(_PLACE[kind]).alias("place"), c["end"].alias("end")).alias("span"),
            _features(kind, c).alias("x")))

    rows = rows.select(
        *docs.columns, "_text",
        F.array_sort(F.concat(*[spans(k, True) for k in BASE])).alias("_base"),
        F.concat(*[spans(k, False) for k in BASE if k != "email"]).alias("_failed"),
        F.concat(*[generated(k) for k in GENERATORS]).alias("_more"))
    return rows


def _cover(spans: Column) -> Column:
    """Spans by start, and for each the largest end so far: a search in them tells what they reach."""
    return _let(F.array_sort(spans), lambda own: F.struct(
        F.transform(own, lambda s: s["start"]).alias("starts"),
        _running(F.transform(own, lambda s: s["end"]), F.greatest).alias("reach")))


def _reach(cover: Column, before: Column) -> Column:
    """The largest end of the spans that start before a place, or -1: a binary search, from high bits to low."""
    bits = F.sequence(F.ceil(F.log2(F.size(cover["starts"]) + 1)).cast("int"), F.lit(0), F.lit(-1))
    below = F.aggregate(bits, F.lit(0), lambda n, bit: _let(n + F.pow(F.lit(2), bit).cast("int"), lambda more: F.when(
        F.get(cover["starts"], more - 1) < before, more).otherwise(n)))
    return F.coalesce(F.get(cover["reach"], below - 1), F.lit(-1))


def _overlaps(cover: Column, span: Column) -> Column:
    return _reach(cover, span["end"]) > span["start"]


def _holds(cover: Column, span: Column) -> Column:
    """Whether one of the spans holds ``span`` whole."""
    return _reach(cover, span["start"] + 1) >= span["end"]


# --- boosted trees over cells ------------------------------------------------------------------------


@dataclass
class Model:
    """Trees of depth two: (feature, cut, left pair, right pair), where a pair is (feature, cut, below, above)."""

    start: float
    trees: list[tuple]
    thresholds: dict[int, float]

    def raw(self, x: dict[str, int]) -> float:
        total = self.start
        for feature, cut, left, right in self.trees:
            f, c, below, above = left if x[feature] <= cut else right
            total += below if x[f] <= c else above
        return total

    def expression(self, x: Column) -> Column:
        total = F.lit(self.start)
        for feature, cut, left, right in self.trees:
            sides = [F.when(x[f] <= c, F.lit(below)).otherwise(F.lit(above)) for f, c, below, above in (left, right)]
            total = total + F.when(x[feature] <= cut, sides[0]).otherwise(sides[1])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def kept(self, x: Column) -> Column:
        limit = F.lit(2.0)
        for kind, threshold in self.thresholds.items():
            limit = F.when(x["kind"] == kind, F.lit(threshold)).otherwise(limit)
        return self.expression(x) >= limit


def _best(cells: list[tuple[dict, float, float]]) -> tuple[float, str, int]:
    """The split of (features, gradient, weight) with the largest gain."""
    all_g, all_h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    best = (0.0, "kind", len(KINDS))
    for feature, values in FEATURES.items():
        g, h = [0.0] * values, [0.0] * values
        for x, gradient, weight in cells:
            g[x[feature]] += gradient
            h[x[feature]] += weight
        for cut, (a, b) in enumerate(zip(itertools.accumulate(g[:-1]), itertools.accumulate(h[:-1]))):
            gain = a * a / (b + L2) + (all_g - a) ** 2 / (all_h - b + L2) - all_g * all_g / (all_h + L2)
            if gain > best[0] + 1e-9:
                best = (gain, feature, cut)
    return best


def _leaf(cells) -> float:
    return -RATE * sum(c[1] for c in cells) / (sum(c[2] for c in cells) + L2)


def fit(cells: list[dict], rounds: int = ROUNDS, precision: float = PRECISION) -> Model:
    """The model from cells: features, ``held`` (kept for calibration), ``ones`` and ``n``.

    Without examples nothing but base spans is selected.
    """
    seen = [c for c in cells if not c["held"]]
    n, ones = sum(c["n"] for c in seen), sum(c["ones"] for c in seen)
    if not n:
        return Model(0.0, [], {})
    # Half an example of each sort keeps the start finite where there is but one.
    start = ones / (n - ones) if 0 < ones < n else (ones + 0.5) / (n - ones + 0.5)
    model = Model(math.log(start), [], {})
    raw = [model.start] * len(seen)
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-r)) for r in raw]
        work = [(c, q * c["n"] - c["ones"], q * (1 - q) * c["n"]) for c, q in zip(seen, p)]
        _, feature, cut = _best(work)
        sides = []
        for side in ([w for w in work if w[0][feature] <= cut], [w for w in work if w[0][feature] > cut]):
            _, f, c = _best(side) if side else (0, "kind", len(KINDS))
            sides.append((f, c, _leaf([w for w in side if w[0][f] <= c]), _leaf([w for w in side if w[0][f] > c])))
        tree = (feature, cut, *sides)
        model.trees.append(tree)
        one = Model(0.0, [tree], {})
        raw = [r + one.raw(c) for r, c in zip(raw, seen)]
    held = [c for c in cells if c["held"]] or seen
    scored = sorted(((1 / (1 + math.exp(-model.raw(c))), c["ones"], c["n"], c["kind"]) for c in held), reverse=True)
    for kind in map(_PLACE.get, GENERATORS):
        limit = _threshold([c for c in scored if c[3] == kind] or scored, precision)
        if limit is not None:
            model.thresholds[kind] = limit
    return model


def _threshold(scored: list[tuple], precision: float) -> float | None:
    """The lowest score from which on the cells, highest score first, have the wanted precision."""
    found, ones, n = None, 0, 0
    for score, group in itertools.groupby(scored, key=lambda c: c[0]):
        for _, a, b, _ in group:
            ones, n = ones + a, n + b
        if ones >= precision * n:
            found = score
    return found


def train(found: DataFrame, key: str, **options) -> Model:
    """The model from all candidates of ``found`` (see :func:`with_candidates`)."""
    cells = found.select(
        F.coalesce(F.pmod(F.xxhash64(key), F.lit(5)) == 0, F.lit(False)).alias("held"),
        F.explode(_let(_cover(F.col("_base")), lambda base: _let(_cover(F.col("_failed")), lambda failed: F.transform(
            "_more", lambda m: F.struct(
                m["x"].alias("x"), _overlaps(base, m["span"]).alias("one"), _overlaps(failed, m["span"]).alias("none")))))).alias("m")
    ).select("held", "m.x.*", "m.one", "m.none")
    # A check of the own format outweighs what else lies there.
    own = F.col("kind").isin([_PLACE[kind] for kind in CHECKED])
    cells = cells.withColumn("one", F.when(own, F.col("check") == 1).otherwise(F.col("one"))).withColumn("none", own | F.col("none"))
    summed = cells.where("one OR none").groupBy("held", *FEATURES).agg(
        F.sum(F.col("one").cast("int")).alias("ones"), F.count("*").alias("n"))
    # A row per combination of features at most.
    rows = sorted(tuple(r) for r in summed.collect())
    names = summed.columns
    return fit([dict(zip(names, r)) for r in rows], **options)


# --- the operator ---------------------------------------------------------------------------------------


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, place, end), ``place`` an index of :data:`KINDS`.

    ``base`` holds the base spans by start and kind; ``spans`` those and the selected candidates that no base
    span holds whole. Null texts have none; null and repeated keys and repeated rows are treated like any other. Texts are
    searched whole; the time for one grows a little faster than its hits (with their number to the power of 1.5, at
    a small factor). Other columns are left out.
    """
    found = with_candidates(docs.select(key, text), text)
    model = train(found, key, **options)
    more = _let(_cover(F.col("_base")), lambda base: F.transform(
        F.filter("_more", lambda m: model.kept(m["x"]) & ~_holds(base, m["span"])), lambda m: m["span"]))
    # Generated kinds are no base kinds, so that no span is there twice.
    return found.select(key, text, F.col("_base").alias("base"), F.array_sort(F.concat("_base", more)).alias("spans"))


def report(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and written spans of :func:`personal_data`."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["place"] == _PLACE[kind])).cast("long").alias(f"n_{kind}")

    return found.select(
        key, *[count(k) for k in BASE], F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(chars: Column, cover: Column) -> Column:
        """What stands before each span, and its name; nothing where it begins within another."""
        parts = F.transform(cover["own"], lambda s, i: _let(F.coalesce(F.get(cover["reach"], i - 1), F.lit(0)), lambda at: F.when(
            s["start"] >= at, F.concat(F.array_join(F.slice(chars, at + 1, s["start"] - at), ""), F.get(names, s["place"])))
            .otherwise("")))
        last = F.coalesce(F.try_element_at(cover["reach"], F.lit(-1)), F.lit(0))
        return F.concat(F.array_join(parts, ""), F.array_join(F.slice(chars, last + 1, F.size(chars)), ""))

    cover = _let(F.array_sort(spans), lambda own: F.struct(
        own.alias("own"), _running(F.transform(own, lambda s: s["end"]), F.greatest).alias("reach")))
    # A text without characters is one empty part.
    return _let(F.split(text, ""), lambda chars: _let(cover, lambda c: cut(chars, c)))
